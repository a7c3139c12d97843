"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from acquira.llm.shared import Scratch, column_bytes, cut_keys, hashed_block, key_ranges, mix, pack_counts, pack_keys, scratched, shuffle_partitions, unpack_counts, unpack_keys, words

_U = np.uint64
END, START = _U(0xE7D0E7D0E7D0E7D1), _U(0x57A7757A7757A775)
#: Contexts of about equal frequency share mixture weights: bucket 0 is unseen, bucket b has counts from 2**(b - 1).
BUCKETS = 48
#: Estimates are held in steps of a quarter of a power of two while weights are learned.
STEPS = 4
ROUNDS = 200
NONE = -100_000


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), BUCKETS - 1), 0)


@dataclass
class Sequences:
    """Tokens of a block's documents, each document's words and then one end; number: place among the block's distinct keys."""

    doc: np.ndarray
    words: np.ndarray  # distinct word keys, ascending, 64 bits
    word_of: np.ndarray
    context_of: np.ndarray  # a document's first context has the end's number: both occur once in each document
    pairs: np.ndarray  # distinct bigram keys, ascending, 48 bits
    pair_of: np.ndarray

    @classmethod
    def of(cls, texts, n_docs: int) -> Sequences:
        h, owner, _ = words(*column_bytes(texts))
        at = np.arange(len(h)) + owner  # every document before has one end
        token = np.full(len(h) + n_docs, END, _U)
        doc = np.zeros(len(token), np.int64)
        token[at] = h
        ends = np.cumsum(np.bincount(owner, minlength=n_docs) + 1) - 1
        doc[at], doc[ends] = owner, np.arange(n_docs)
        context = np.empty_like(token)
        context[1:] = token[:-1]
        starts = np.concatenate([[0], ends[:-1] + 1]) if n_docs else ends
        context[starts] = START
        pair = mix(context * _U(0x9E3779B97F4A7C15) + token) >> _U(16)
        vocabulary, word_of = np.unique(token, return_inverse=True)
        pairs, pair_of = np.unique(pair, return_inverse=True)
        previous = np.empty_like(word_of)
        previous[1:] = word_of[:-1]
        if n_docs:
            previous[starts] = np.searchsorted(vocabulary, END)
        return cls(doc, vocabulary, word_of, previous, pairs, pair_of)


def _sum_words(blobs: list[bytes]) -> tuple[list[bytes], list[int]]:
    """For one range: each block's answer, totals of both parts; and the range's distinct and total counts of each part."""
    keys, a, b = [], [], []
    for blob in blobs:
        m = int(np.frombuffer(blob, "<u4", 1)[0])
        keys.append(np.frombuffer(blob, "<u8", m, 4))
        c, at = unpack_counts(blob, 4 + 8 * m, m)
        a.append(c)
        b.append(unpack_counts(blob, at, m)[0])
    return _answers(keys, a, b)


def _sum_pairs(blobs: list[bytes], first: int, last: int) -> tuple[list[bytes], list[int]]:
    keys, a, b = zip(*(unpack_keys(blob, first, last, 2) for blob in blobs), strict=True)
    return _answers(keys, a, b)


def _answers(keys, a, b) -> tuple[list[bytes], list[int]]:
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    total_a = np.bincount(place, np.concatenate(a), len(known)).astype(np.int64)
    total = total_a + np.bincount(place, np.concatenate(b), len(known)).astype(np.int64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    out = [pack_counts(total_a[p]) + pack_counts(total[p]) for p in np.split(place, cuts)]
    return out, [int((total_a > 0).sum()), int(total_a.sum()), int((total > 0).sum()), int(total.sum())]


_ASK = "block int, part int, kind int, data binary"
_ANSWER = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType()), *[T.StructField(f"n{i}", T.LongType()) for i in range(4)]])


@scratched
def score(df: DataFrame, *, train: Column, tune: Column, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row (and the flag ``trained``).

    Tokens are the words, A-Z lower-cased, and one end. Rows for which ``train`` holds are learned from; those of them for which
    ``tune`` holds also are the held-out counts on which the mixture's weights are learned, with estimates of the others alone.
    The scores then use the counts of all. Every order's estimate of every context sums to 1 over the vocabulary and one unknown.
    Null and empty texts are one end. Repeated rows count each; a null id stays. An empty table stays empty; if nothing is
    learned from, all is unknown.
    """
    spark = df.sparkSession
    n = min(shuffle_partitions(spark), 65536)
    part = F.when(~F.coalesce(train, F.lit(False)), 2).when(F.coalesce(tune, F.lit(False)), 1).otherwise(0)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.cast("int").alias("role"))
    blocks = scratch.blocks(docs, hashed_block(spark, "id"))
    id_type = blocks.schema["id"].dataType

    def ask(t: pa.Table) -> pa.Table:
        s, role = Sequences.of(t["text"], len(t)), t["role"].to_numpy()
        of = role[s.doc]
        count = lambda place, size: [np.bincount(place[of == r], minlength=size) for r in (0, 1)]
        rows, edges = [], np.array([(i << 64) // n for i in range(1, n)], _U)
        a, b = count(s.word_of, len(s.words))
        at = np.concatenate([[0], np.searchsorted(s.words, edges), [len(s.words)]])
        for i in range(n):
            x = slice(at[i], at[i + 1])
            if x.stop > x.start:
                rows.append((i, 1, np.uint32(x.stop - x.start).tobytes() + s.words[x].tobytes() + pack_counts(a[x]) + pack_counts(b[x])))
        a, b = count(s.pair_of, len(s.pairs))
        first, at = cut_keys(s.pairs, n)
        for i in range(n):
            x = slice(at[i], at[i + 1])
            if x.stop > x.start:
                rows.append((i, 2, pack_keys(s.pairs[x], int(first[i]), int(first[i + 1]), a[x], b[x])))
        block = int(t["block"][0].as_py())
        return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "kind", "data"])

    def add(t: pa.Table) -> pa.Table:
        i, kind = t["part"][0].as_py(), t["kind"][0].as_py()
        first = key_ranges(n)
        out, totals = _sum_words(t["data"].to_pylist()) if kind == 1 else _sum_pairs(t["data"].to_pylist(), int(first[i]), int(first[i + 1]))
        stats = [pa.array([x if not j else 0 for j in range(len(t))], pa.int64()) for x in totals]
        return pa.table([t["block"], t["part"], t["kind"], pa.array(out, pa.binary()), *stats], _ANSWER.names)

    answers = scratch.write(blocks.groupBy("block").applyInArrow(ask, _ASK).groupBy("part", "kind").applyInArrow(add, _ANSWER))
    va, na, v, total = (int(x or 0) for x in answers.where("kind = 1").agg(*[F.sum(f"n{i}") for i in range(4)]).first())
    answers = answers.select("block", "part", "kind", "data")

    def read(t: pa.Table, got: pa.Table, which: int):
        """The block's sequences, and each distinct word's and bigram's total (0: without the tuning part, 1: with it)."""
        s, out = Sequences.of(t["text"], len(t)), []
        for kind, keys in ((1, s.words), (2, s.pairs)):
            c, at = np.zeros(len(keys), np.int64), 0
            rows = sorted((r for r in zip(got["part"].to_pylist(), got["kind"].to_pylist(), got["data"].to_pylist(), strict=True) if r[1] == kind), key=lambda r: r[0])
            sizes = np.diff(cut_keys(keys, n)[1]) if kind == 2 else np.diff(np.concatenate([[0], np.searchsorted(keys, np.array([(i << 64) // n for i in range(1, n)], _U)), [len(keys)]]))
            for i, _, blob in rows:
                m = int(sizes[i])
                x, place = unpack_counts(blob, 0, m)
                if which:
                    x, _ = unpack_counts(blob, place, m)
                c[at:at + m] = x
                at += m
            if at != len(keys):
                raise RuntimeError("a block's texts changed between passes")
            out.append(c)
        return s, out[0], out[1]

    grid_schema = "bucket int, two int, one int, n long"

    def grid(t: pa.Table, got: pa.Table) -> pa.Table:
        names = ["bucket", "two", "one", "n"]
        if not len(t) or not (t["role"].to_numpy() == 1).any():
            return pa.table([pa.array([], pa.int32())] * 3 + [pa.array([], pa.int64())], names)
        s, uni, bi = read(t, got, 0)
        of = t["role"].to_numpy()[s.doc] == 1
        h, w, hw = uni[s.context_of[of]], uni[s.word_of[of]], bi[s.pair_of[of]]
        step = lambda x, y: np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x, 1) / np.maximum(y, 1))).astype(np.int64), NONE)
        cells, count = np.unique(np.stack([bucket(h), step(hw, h), step(w, na)]), axis=1, return_counts=True)
        return pa.table([*(pa.array(c, pa.int32()) for c in cells), pa.array(count, pa.int64())], names)

    cells = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(grid, grid_schema).groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["bucket"].to_numpy(), cells["two"].to_numpy(), cells["one"].to_numpy(), cells["n"].to_numpy(), 1 / (va + 1))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("trained", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], x) for x in (to_arrow_type(id_type), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], schema.names)
        s, uni, bi = read(t, got, 1)
        w, h, hw = uni[s.word_of], uni[s.context_of], bi[s.pair_of]
        lam = weights[bucket(h)]
        p = lam[:, 0] * hw / np.maximum(h, 1) + lam[:, 1] * w / max(total, 1) + lam[:, 2] / (v + 1)
        base = np.log10((w + 0.1) / (total + 0.1 * (v + 1)))
        starts = np.searchsorted(s.doc, np.arange(len(t)))
        each = lambda x: np.add.reduceat(x, starts)
        return pa.table([t["id"], pa.array(t["role"].to_numpy() < 2), pa.array(each(np.ones(len(w), np.int64))), pa.array(each((w > 0).astype(np.int64))), pa.array(each(base)), pa.array(each(np.log10(p)))], schema.names)

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
    return out.select(F.col("id").alias(id_col), "trained", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def learn_weights(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, n: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of the bigram, unigram and uniform estimate for each bucket, by expectation-maximisation on held-out counts.

    A bucket without held-out counts takes its neighbour's below. The uniform estimate keeps a weight, so nothing is impossible;
    unseen contexts have no bigram estimate.
    """
    out = np.tile([0.0, 0.7, 0.3], (BUCKETS, 1))
    value = lambda q: np.where(q > NONE, 2.0 ** (q / STEPS), 0.0)
    for b in range(BUCKETS):
        own = bucket == b
        if b:
            out[b] = out[b - 1] if b > 1 else [0.3, 0.5, 0.2]
        if not own.any():
            continue
        p, c = np.stack([value(two[own]), value(one[own]), np.full(own.sum(), uniform)], 1), n[own].astype(float)
        lam = np.array([0.5, 0.3, 0.2]) if b else np.array([0.0, 0.6, 0.4])
        for _ in range(ROUNDS):
            share = p * lam
            share /= share.sum(1, keepdims=True)
            new = (share * c[:, None]).sum(0) / c.sum()
            done = np.abs(new - lam).max() < 1e-9
            lam = new
            if done:
                break
        lam = np.maximum(lam, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
        out[b] = lam / lam.sum()
    return out
