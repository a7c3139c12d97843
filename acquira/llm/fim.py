"""Fill-in-the-middle transformation by overlapping chunks.

A text is cut at two of its units' boundaries (lines, words or code points) into prefix, middle and suffix, which are put together in
another order. Whether a unit starts at a byte depends on it and the byte before it alone, so texts are taken apart into chunks that
overlap by one byte and count their boundaries independently of each other, all chunks of a slice at a time. Prefix sums of the counts
give each text's number of units and the chunk that owns each cut's rank; only these chunks are looked at again for the place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import column_bytes

#: Bytes of a chunk, and of texts that are taken apart and put together at a time. Neither changes a result.
CHUNK, SLICE_BYTES = 1 << 16, 4 << 20
#: What marks prefix, suffix and middle; and the order of the parts in each form.
SENTINELS = ("<P>", "<S>", "<M>")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For each kind of unit, whether one starts at a byte, given the byte before it. A text's first byte starts one in any case.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda before, here: before == 10,
    "word": lambda before, here: _SPACE[before] & ~_SPACE[here],
    "char": lambda before, here: (here & 0xC0) != 0x80,
}


class Chunks:
    """The chunks of a slice of texts (bytes and row offsets), their boundary counts, and where the unit of a rank starts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK):
        self.raw, self.offsets, self.starts = raw, offsets, UNITS[unit]
        sizes = np.diff(offsets)
        per = -(-sizes // chunk)
        self.owner = np.repeat(np.arange(len(sizes)), per)
        self.first = np.concatenate([[0], np.cumsum(per)])
        self.low = offsets[:-1][self.owner] + (np.arange(len(self.owner)) - self.first[:-1][self.owner]) * chunk
        self.high = np.minimum(self.low + chunk, offsets[1:][self.owner])
        counts = np.zeros(len(self.low), np.int64)
        at = 0
        while at < len(self.low):  # as many chunks as make a slice are evaluated at once
            end = max(at + 1, int(np.searchsorted(self.high, self.low[at] + SLICE_BYTES, "right")))
            lo = int(self.low[at])
            counts[at:end] = np.add.reduceat(self.boundaries(lo, int(self.high[end - 1]), self.low[at:end][self.low[at:end] == offsets[self.owner[at:end]]]), self.low[at:end] - lo)
            at = end
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        self.units = self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def boundaries(self, lo: int, hi: int, heads: np.ndarray) -> np.ndarray:
        """Whether a unit starts at each byte from lo to hi; heads are first bytes of texts. One byte before lo is looked at."""
        before = self.raw[lo - 1:hi - 1] if lo else np.concatenate([[0], self.raw[:hi - 1]]).astype(np.uint8)
        out = self.starts(before, self.raw[lo:hi])
        out[heads - lo] = True
        return out

    def places(self, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Bytes of each row's text before its rank-th unit (from 0); of all its units, the text's whole length."""
        out = (self.offsets[row + 1] - self.offsets[row]).astype(np.int64)
        inside = np.flatnonzero(rank < self.units[row])
        wanted = self.upto[self.first[row[inside]]] + rank[inside]
        chunk = np.searchsorted(self.upto, wanted, "right") - 1
        for i, c, k in zip(inside.tolist(), chunk.tolist(), (wanted - self.upto[chunk]).tolist(), strict=True):
            lo, head = int(self.low[c]), self.offsets[row[i]]
            out[i] = lo - head + np.flatnonzero(self.boundaries(lo, int(self.high[c]), self.low[c:c + 1] if lo == head else self.low[:0]))[k]
        return out


def draws(id_: Column, seed: int, number: int = 4) -> list[Column]:
    """Whole numbers of 32 bits from the SHA-256 of seed and id; a null id counts as no digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(number)]


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``rearrange`` was made of."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)  # what is before the first mark is empty
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def rearrange(df: DataFrame, *, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 0, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and output of every row.

    Of the texts, ``rate`` in a hundred are rearranged, of these ``spm`` in a hundred as suffix, prefix, middle (``spm``), the others as
    prefix, suffix, middle (``psm``), each part after its mark. The cuts lie before two of the n + 1 boundaries, by the id's hash. Texts
    that are empty or null or hold a mark stay as they are (``plain``, without lengths). Rows with one id have the same draws; a null
    id has draws of its own. An empty table stays empty; columns that aren't named are not read. Nothing is shuffled; a text is held
    whole by the task that reads it.
    """
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    if len({*sentinels}) != 3 or any(not s or s[0] in s[1:] + "".join(t[1:] for t in sentinels) for s in sentinels):
        raise ValueError("marks have to differ, and their first characters must not occur within any of them")
    marks = [s.encode() for s in sentinels]
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains(text, F.lit(s))
    form = F.when((text == "") | held | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n", "prefix_chars", "middle_chars")), T.StructField("form", T.StringType()), T.StructField("output", T.StringType())])

    def put_together(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = column_bytes(batch.column(1))
        chunks = Chunks(raw, offsets, unit, chunk)
        forms, every = batch.column(2).to_pylist(), np.arange(batch.num_rows)
        ranks = [batch.column(i).to_numpy() % (chunks.units + 1) for i in (3, 4)]
        moved = np.array([f != "plain" for f in forms], bool)
        first, second = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        first[moved], second[moved] = (chunks.places(every[moved], k(*ranks)[moved]) for k in (np.minimum, np.maximum))
        prefix, middle, out = [], [], []
        for i, f in enumerate(forms):
            whole = raw[offsets[i]:offsets[i + 1]].tobytes()
            p, m, s = whole[:first[i]], whole[first[i]:second[i]], whole[second[i]:]
            out.append(whole if f == "plain" else b"".join((marks[0], p, marks[1], s, marks[2], m) if f == "psm" else (marks[1], s, marks[0], p, marks[2], m)))
            prefix.append(None if f == "plain" else len(p.decode()))
            middle.append(None if f == "plain" else len(m.decode()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks.units), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), batch.column(2), pa.array(out, pa.binary()).cast(pa.string())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(column_bytes(b.column(1))[1])
            at, ends = 0, np.cumsum(sizes)
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                yield put_together(b.slice(at, end - at))
                at = end

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def oracle(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """The query's rows in DuckDB's SQL: lines by their pattern, put together again."""
    h = lambda i: f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS ls FROM documents),
 c AS (SELECT *, CAST(len(ls) AS BIGINT) AS n, {h(0)} % (len(ls) + 1) AS c1, {h(1)} % (len(ls) + 1) AS c2,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h(2)} % 100 >= {rate} THEN 'plain' WHEN {h(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(ls[1:least(c1, c2)], ''), '') AS p, coalesce(array_to_string(ls[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m, coalesce(array_to_string(ls[greatest(c1, c2) + 1:], ''), '') AS s FROM c),
 o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM p)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
 sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE p || m || s END) AS restored_sha256 FROM o"""
