"""Removal of repeated strings: rolling-hash phrases, a dictionary of their contexts, and its suffix ranks.

Every string of ``length`` bytes has one trigger: the place, among its first TRIGGERS, where a rolling hash is least. Equal
strings have equal triggers, so the starts that share a trigger make a phrase that depends on the text alone, and a phrase with
the bytes that its strings cover, its *context*, is an entry of the dictionary. The parse is each document's row of phrases.
Blocks hold ranges of ids, so that what comes first in the corpus is the parse's first occurrence in the first block.

Where a trigger's string has one context in the whole corpus, phrases are equal or share nothing. Where it has several, the
contexts are gathered by trigger and the suffixes of that part of the dictionary are ranked by doubling, up to ``length`` bytes:
equal ranks are equal strings, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from acquira.llm.shared import BYTE_VALUES, Scratch, _power_table, block_of, column_bytes, cut_keys, key_ranges, mix, pack_keys, scratched, shuffle_partitions, unpack_keys

_U = np.uint64
GRAM = 16
CHUNK = 1 << 17
#: Bytes of dictionary entries that are ranked at a time, and of a block's texts on the whole.
SLICE_BYTES, BLOCK_BYTES = 2 << 20, 64 << 20


def _doubled(b: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the strings of 16 and of 32 bytes from each place, by doubling."""
    out, w, base = {}, 1, _U(0xD6E8FEB86659FD93)
    h = BYTE_VALUES[b]
    while w < 32:
        h = h[:-w] * base + h[w:]
        base = base * base
        w *= 2
        if w >= GRAM:
            out[w] = h
    return out


@dataclass
class Phrases:
    """Phrases of a buffer: first and last start of their strings, trigger key (48 bits) and context hash (32 bits)."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray, length: int) -> Phrases:
        triggers = length // 2
        tail = length - triggers + 1  # bytes from the trigger on that each of its strings has
        parts = []
        with np.errstate(over="ignore"):
            for lo in range(0, len(raw), CHUNK):
                hi = min(len(raw), lo + CHUNK)
                first_doc, last_doc = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
                cuts = np.clip(offsets[first_doc:last_doc + 1], lo, hi) - lo
                end = np.repeat(offsets[first_doc + 1:last_doc + 1] - lo, np.diff(cuts))  # of the text that each place is in
                starts = np.flatnonzero(np.arange(hi - lo) + length <= end)
                if not len(starts):
                    continue
                b = raw[lo:min(len(raw), hi + length)]
                by_width = _doubled(b)
                low = (mix(by_width[GRAM]) & ~_U((1 << 24) - 1)) | np.arange(len(by_width[GRAM]), dtype=np.int64).astype(_U)
                width = 1
                while width * 2 <= triggers:
                    low = np.minimum(low[:-width], low[width:])
                    width *= 2
                if width < triggers:
                    low = np.minimum(low[:len(low) - (triggers - width)], low[triggers - width:])
                at = (low[starts] & _U((1 << 24) - 1)).astype(np.int64)
                new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
                begin = np.flatnonzero(new)
                first, last, trigger = starts[begin], starts[np.append(begin[1:], len(starts)) - 1], at[begin]
                wide = 32 if tail >= 32 else 16
                h = by_width[wide]
                key = mix(h[trigger] * _U(0x9E3779B97F4A7C15) + h[trigger + tail - wide]) >> _U(16)
                up, down = _power_table(len(b) + 1)
                total = np.zeros(len(b) + 1, _U)
                np.cumsum(BYTE_VALUES[b] * up[:-1], out=total[1:])
                inside = (total[last + length] - total[first]) * down[first]
                context = mix(inside + ((last - first) * 4096 + (trigger - first)).astype(_U)) >> _U(32)
                parts.append((first + lo, last + lo, key, context))
        if not parts:
            return cls(*(np.zeros(0, t) for t in (np.int64, np.int64, _U, _U)))
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One phrase of each key and context, the first, in their order; and for each phrase the place of its own."""
        order = np.lexsort((np.arange(len(self.key)), self.context, self.key))
        k, c = self.key[order], self.context[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` bytes from each place, by doubling; places too near the end have no meaning."""
    width = 1
    rank = text.astype(np.int64)
    while width < length:
        step = min(width, length - width)
        ahead = np.zeros_like(rank)
        ahead[:len(rank) - step] = rank[step:] if step else rank
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        if width < 2:  # two bytes stay as they are; four are made dense, as the product of two such ranks would overflow
            rank = pair
        else:
            rank = np.unique(pair, return_inverse=True)[1]
        width += step
    return rank


def _place_of(bounds: list[int], key: Column, part: Column, spare: int) -> Column:
    """The block of a key between ascending bounds, counted in two steps; null keys are above all.

    A bound that occurs m times stands for a key with many rows: they go to m + 1 blocks by ``part`` (0 to 1, without 1). Null keys
    go to ``spare`` blocks in the same way.
    """
    def below(k: Column, equal: bool) -> Column:
        step = max(1, int(len(bounds) ** 0.5))
        test = (lambda b: b <= k) if equal else (lambda b: b < k)
        every, some = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[::step]])
        coarse = F.greatest(F.size(F.filter(some, test)) - 1, F.lit(0)) * step
        return coarse + F.size(F.filter(F.slice(every, coarse + 1, F.lit(step)), test))

    if bounds:
        low, high = below(key, False), below(key, True)
        place = low + F.floor(part * (high - low + 1))
    else:
        place = F.lit(0)
    return F.when(key.isNull(), len(bounds) + 1 + F.floor(part * spare)).otherwise(place).cast("int")


_ROWS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("round", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _rows(block: int, which: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([which] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], _ROWS.names)


@scratched
def remove_repeats(df: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), scratch: Scratch) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) and kept_text of every row, then the columns named in ``carry``.

    kept_text is kept without the bytes of characters that a removal cut in two, and null where the text was.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row with a smaller id, or earlier in the
    same row. Strings never cross rows and are judged on the input. Null texts are empty; null ids come after all others; rows
    with equal ids are in the order of a hash of their texts, then of the texts. ``length`` under 32 raises.

    With a ``scratch`` the result is read from its tables, which the caller drops when it is done; else it is written.
    """
    if length < 32:
        raise ValueError("strings have 32 bytes at least")
    spark = df.sparkSession
    n = min(shuffle_partitions(spark), 65536)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    total = docs.agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(shuffle_partitions(spark), -(-total.bytes // BLOCK_BYTES))
    spare = -(-n_blocks * (total.rows - total.ids) // max(total.rows, 1))  # the share of rows without an id
    cuts = docs.agg(F.percentile_approx("id", [i / n_blocks for i in range(1, n_blocks)], 20 * n_blocks)).first()[0] if n_blocks > 1 else None
    docs = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    place = _place_of(sorted(cuts or []), F.col("id"), F.col("tie") / float(2**63), max(spare, 1))
    n_blocks = len(cuts or []) + 1 + max(spare, 1)
    blocks = scratch.blocks(docs, block_of(F.least(place, F.lit(n_blocks - 1)), n_blocks), n_blocks)

    def load(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Phrases]:
        pa.default_memory_pool().release_unused()
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("id", "ascending"), ("tie", "ascending"), ("text", "ascending")], null_placement="at_end"))
        raw, offsets = column_bytes(t["text"])
        return t, raw, offsets, Phrases.of(raw, offsets, length)

    def ask_phrases(t: pa.Table) -> pa.Table:
        _, _, _, p = load(t)
        one, _ = p.distinct()
        key, context = p.key[one], p.context[one]
        first, at = cut_keys(key, n)
        rows = [(i, pack_keys(key[at[i]:at[i + 1]], int(first[i]), int(first[i + 1])) + context[at[i]:at[i + 1]].astype("<u4").tobytes()) for i in range(n) if at[i + 1] > at[i]]
        return _rows(t["block"][0].as_py(), 1, rows)

    def judge_phrases(t: pa.Table) -> pa.Table:
        """For each block's phrases: 0 the first block with it, 1 an earlier one has it, 2 its trigger has several contexts."""
        i, first = t["part"][0].as_py(), key_ranges(n)
        order = np.argsort(t["block"].to_numpy(), kind="stable")
        blobs = t["data"].to_pylist()
        keys, contexts = [], []
        for j in order:
            k = unpack_keys(blobs[j], int(first[i]), int(first[i + 1]), 0)[0]
            keys.append(k)
            contexts.append(np.frombuffer(blobs[j], "<u4", len(k), len(blobs[j]) - 4 * len(k)))
        cut = np.cumsum([len(k) for k in keys])[:-1]
        key, context = np.concatenate(keys), np.concatenate(contexts)
        by = np.lexsort((np.arange(len(key)), context, key))
        k, c = key[by], context[by]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new)[group] > 1
        code = np.empty(len(key), np.uint8)
        code[by] = np.where(several, 2, np.where(new, 0, 1))
        return pa.table([t["block"].take(pa.array(order)), t["part"], t["round"], pa.array([x.tobytes() for x in np.split(code, cut)], pa.binary())], _ROWS.names)

    def codes(got: pa.Table, which: int) -> bytes:
        rows = sorted((p, d) for p, r, d in zip(got["part"].to_pylist(), got["round"].to_pylist(), got["data"].to_pylist(), strict=True) if r == which)
        return b"".join(d for _, d in rows)

    def open_phrases(raw: np.ndarray, p: Phrases, got: pa.Table):
        """Distinct phrases, the place of each phrase's own, their codes, and which of the distinct are open (code 2)."""
        one, place = p.distinct()
        code = np.frombuffer(codes(got, 1), np.uint8)
        if len(code) != len(one):
            raise RuntimeError("a block's texts changed between passes")
        return one, place, code, np.flatnonzero(code == 2)

    def ask_strings(t: pa.Table, got: pa.Table) -> pa.Table:
        if not len(t):
            return _rows(0, 2, [])
        _, raw, _, p = load(t)
        one, _, _, unsure = open_phrases(raw, p, got)
        own = one[unsure]
        _, at = cut_keys(p.key[own], n)
        rows = []
        for i in range(n):
            x = own[at[i]:at[i + 1]]
            if len(x):
                text = b"".join(raw[a:b + length].tobytes() for a, b in zip(p.first[x].tolist(), p.last[x].tolist(), strict=True))
                rows.append((i, np.uint32(len(x)).tobytes() + p.key[x].tobytes() + p.context[x].astype("<u4").tobytes() + (p.last[x] - p.first[x] + 1).astype("<u2").tobytes() + text))
        return _rows(t["block"][0].as_py(), 2, rows)

    def judge_strings(t: pa.Table) -> pa.Table:
        """For each string of each block's open phrases: 0 if an earlier block has it, else a number equal for equal strings."""
        order = np.argsort(t["block"].to_numpy(), kind="stable")
        blobs = t["data"].to_pylist()
        keys, contexts, counts, texts = [], [], [], []
        for j in order:
            d = blobs[j]
            m = int(np.frombuffer(d, "<u4", 1)[0])
            keys.append(np.frombuffer(d, "<u8", m, 4))
            contexts.append(np.frombuffer(d, "<u4", m, 4 + 8 * m))
            counts.append(np.frombuffer(d, "<u2", m, 4 + 12 * m).astype(np.int64))
            texts.append(np.frombuffer(d, np.uint8, -1, 4 + 14 * m))
        key, context, count, text = np.concatenate(keys), np.concatenate(contexts), np.concatenate(counts), np.concatenate(texts)
        block_no = np.repeat(np.arange(len(order)), [len(k) for k in keys])
        size, start = count + length - 1, np.concatenate([[0], np.cumsum(count)])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        by = np.lexsort((block_no, context, key))
        new_key = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        new = new_key | np.concatenate([[True], context[by][1:] != context[by][:-1]])
        answer = np.zeros(start[-1], "<u4")
        # strings under different triggers differ, so triggers are taken some at a time
        step = np.cumsum(np.where(new, size[by], 0)) // SLICE_BYTES
        heads = np.flatnonzero(new_key)
        cuts = [*heads[np.unique(step[heads], return_index=True)[1]], len(by)]
        numbers = 0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x, first = by[lo:hi], new[lo:hi]
            rep, entry = x[first], np.cumsum(first) - 1  # dictionary entries, and each phrase's own
            d_at = np.concatenate([[0], np.cumsum(size[rep])])
            dictionary = text[np.repeat(begin[rep] - d_at[:-1], size[rep]) + np.arange(d_at[-1])]
            rank = suffix_ranks(dictionary, length)
            n_strings = count[x]
            inner = np.arange(n_strings.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n_strings)[:-1]]), n_strings)
            number = np.unique(rank[np.repeat(d_at[entry], n_strings) + inner], return_inverse=True)[1]
            block = np.repeat(block_no[x], n_strings)
            earliest = np.full(number.max(initial=-1) + 1, len(order))
            np.minimum.at(earliest, number, block)
            answer[np.repeat(start[x], n_strings) + inner] = np.where(earliest[number] < block, 0, numbers + number + 1)
            numbers += len(earliest)
        cut = start[np.searchsorted(block_no, np.arange(1, len(order)))]
        return pa.table([t["block"].take(pa.array(order)), t["part"], t["round"], pa.array([x.tobytes() for x in np.split(answer, cut)], pa.binary())], _ROWS.names)

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType()), *(f for f in blocks.schema if f.name.startswith("carried_"))])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_batches([], to_arrow_schema(schema))
        t, raw, offsets, p = load(t)
        one, place, code, unsure = open_phrases(raw, p, got)
        change = np.zeros(len(raw) + 1, np.int32)

        def cover(a, b):
            np.add.at(change, a, 1)
            np.add.at(change, b, -1)

        first_here = np.zeros(len(p.key), bool)
        first_here[one] = True
        verdict = code[place]
        gone = (verdict == 1) | ((verdict == 0) & ~first_here)
        cover(p.first[gone], p.last[gone] + length)
        if len(unsure):
            rows = sorted((q, d) for q, r, d in zip(got["part"].to_pylist(), got["round"].to_pylist(), got["data"].to_pylist(), strict=True) if r == 2)
            _, at = cut_keys(p.key[one[unsure]], n)
            count = p.last[one[unsure]] - p.first[one[unsure]] + 1
            total = np.concatenate([[0], np.cumsum(count)])
            number = np.zeros(total[-1], np.int64)
            for q, d in rows:
                x = np.frombuffer(d, "<u4").astype(np.int64)
                number[total[at[q]]:total[at[q + 1]]] = np.where(x > 0, x + (q << 32), 0)
            index = np.full(len(one), -1)
            index[unsure] = np.arange(len(unsure))
            mine = np.flatnonzero(verdict == 2)
            c = count[index[place[mine]]]
            at_start = np.concatenate([[0], np.cumsum(c)])
            inner = np.arange(at_start[-1]) - np.repeat(at_start[:-1], c)
            where = np.repeat(p.first[mine], c) + inner
            what = number[np.repeat(total[:-1][index[place[mine]]], c) + inner]
            o = np.lexsort((where, what))
            again = np.concatenate([[False], what[o][1:] == what[o][:-1]])
            bad = where[o][again | (what[o] == 0)]
            cover(bad, bad + length)
        out = np.cumsum(change[:-1], dtype=np.int32) > 0
        head = out.copy()
        head[1:] &= ~out[:-1]
        s = offsets[:-1][np.diff(offsets) > 0]
        head[s] = out[s]
        sums, heads = np.zeros(len(out) + 1, np.int32), np.zeros(len(out) + 1, np.int32)
        np.cumsum(out, out=sums[1:])
        np.cumsum(head, out=heads[1:])
        removed, spans = sums[offsets[1:]] - sums[offsets[:-1]], heads[offsets[1:]] - heads[offsets[:-1]]
        kept = raw[~out]
        kept_at = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(kept_at.tobytes()), pa.py_buffer(kept.tobytes())])
        kept_at = kept_at.tolist()
        cut_texts = {i: kept[kept_at[i]:kept_at[i + 1]].tobytes().decode("utf-8", "ignore") for i in np.flatnonzero(removed).tolist()}
        texts = t["text"] if not cut_texts else pa.array([cut_texts.get(i, x) for i, x in enumerate(t["text"].to_pylist())], pa.string())
        return pa.table([t["id"], pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), column, texts, *(t[c] for c in schema.names[6:])], schema.names)

    by_block = lambda d: d.groupBy("block")
    one = scratch.write(by_block(blocks).applyInArrow(ask_phrases, _ROWS).groupBy("part").applyInArrow(judge_phrases, _ROWS))
    two = scratch.write(by_block(blocks).cogroup(by_block(one)).applyInArrow(ask_strings, _ROWS).groupBy("part").applyInArrow(judge_strings, _ROWS))
    out = by_block(blocks).cogroup(by_block(one.unionByName(two))).applyInArrow(finish, schema)
    out = out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))
    return out
