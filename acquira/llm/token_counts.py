"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pre-tokens, then each worker's cache.

A pre-token is what ASCII white space encloses. Texts are split, and a slice's pre-tokens reduced to the distinct ones, by Arrow's
string kernels; only distinct pre-tokens that the table lacks become Python strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Entries of the broadcast table, of one task's summary, and of a worker's cache. None of them changes a count.
TABLE_ENTRIES, SUMMARY_ENTRIES, CACHE_ENTRIES = 16_384, 4_096, 600_000
#: Bytes of the longest pre-token that a summary, the table or a cache holds: entries times this bounds their memory.
ENTRY_BYTES = 64
#: Bytes of text that are split at a time.
SLICE_BYTES = 8 << 20
#: Summaries that reach the driver.
MERGERS = 16


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(2)
def _cache(path: str) -> dict[str, int]:
    return {}


def _summary(counts: Counter) -> dict:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY_ENTRIES]
    return {"words": [w for w, _ in top], "counts": [n for _, n in top]}


_SUMMARY = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def split(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Slices of texts: bytes of each text, offsets of its pre-tokens, the distinct pre-tokens, and which of them each one is."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    total, row = np.concatenate([[0], np.cumsum(size)]), 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(total, total[row] + SLICE_BYTES, "right")) - 1)
        parts = pc.ascii_split_whitespace(texts.slice(row, end - row))
        coded = pc.dictionary_encode(parts.flatten())
        offsets = parts.offsets.to_numpy()
        yield size[row:end], offsets - offsets[0], coded.dictionary, coded.indices.to_numpy()
        row = end


def frequent_pretokens(df: DataFrame, text_col: str = "text") -> list[str]:
    """The pre-tokens that all rows have most often, at most TABLE_ENTRIES, near ties by chance of pruning.

    Each task keeps one summary of fixed size; summaries of fixed size are merged, so no pre-token is shuffled.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, _, units, which in split(batch.column(0)):
                n = np.bincount(which, minlength=len(units))
                n[pc.binary_length(units).to_numpy(zero_copy_only=False) > ENTRY_BYTES] = 0
                top = np.argsort(-n, kind="stable")[: 4 * SUMMARY_ENTRIES]
                top = top[n[top] > 0]
                seen.update(dict(zip(units.take(pa.array(top)).to_pylist(), n[top].tolist(), strict=True)))
                if len(seen) > 20 * SUMMARY_ENTRIES:
                    seen = Counter(dict(seen.most_common(10 * SUMMARY_ENTRIES)))
        from pyspark import TaskContext

        seen.pop("", None)
        s = _summary(seen)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGERS], pa.int32()), pa.array([s["words"]], pa.list_(pa.string())), pa.array([s["counts"]], pa.list_(pa.int64()))], _SUMMARY.names)

    def merge(batches):
        seen: dict[int, Counter] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = seen.setdefault(row["part"], Counter())
                own.update(dict(zip(row["words"], row["counts"], strict=True)))
                if len(own) > 20 * SUMMARY_ENTRIES:
                    seen[row["part"]] = Counter(dict(own.most_common(10 * SUMMARY_ENTRIES)))
        for part, own in seen.items():
            s = _summary(own)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s["words"]], pa.list_(pa.string())), pa.array([s["counts"]], pa.list_(pa.int64()))], _SUMMARY.names)

    rows = df.select(text_col).mapInArrow(count, _SUMMARY).repartition(MERGERS, "part").mapInArrow(merge, _SUMMARY).collect()
    total: Counter = Counter()
    for r in rows:
        total.update(dict(zip(r.words, r.counts, strict=True)))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]


def lengths(units: pa.Array, table: tuple[list[str], list[int]], cache: dict[str, int], library: Tokenizer) -> np.ndarray:
    """Tokens of each distinct pre-token: from the table, the worker's cache, or the library."""
    words, known = pa.array(table[0], pa.large_string()), np.array([*table[1], 0], np.int64)
    at = pc.fill_null(pc.index_in(units, value_set=words), len(words)).to_numpy(zero_copy_only=False)
    out = known[at]
    miss = np.flatnonzero(at == len(words))
    rest = units.take(pa.array(miss)).to_pylist()
    if len(cache) + len(rest) > CACHE_ENTRIES:
        cache.clear()
    new = [w for w in rest if w not in cache]
    fresh: dict[str, int] = {}
    for lo in range(0, len(new), 20_000):
        part = new[lo:lo + 20_000]
        fresh.update(zip(part, [len(e.ids) for e in library.encode_batch_fast(part, add_special_tokens=False)], strict=True))
    out[miss] = [fresh[w] if w in fresh else cache[w] for w in rest]
    if len(fresh) <= CACHE_ENTRIES:
        cache.update((w, n) for w, n in fresh.items() if len(w) <= ENTRY_BYTES // 4 or len(w.encode()) <= ENTRY_BYTES)
    return out


def count_tokens(df: DataFrame, path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row, as the library counts the whole text.

    The tokenizer's own pattern never crosses white space, so a text's count is the sum of its pre-tokens' counts. Null and empty
    texts have 0 bytes and 0 tokens; repeated rows and null ids stay as they are; other columns are not carried.
    """
    spark = df.sparkSession
    frequent = frequent_pretokens(df, text_col)
    encoded = _tokenizer(path).encode_batch_fast(frequent, add_special_tokens=False)
    table = spark.sparkContext.broadcast((frequent, [len(e.ids) for e in encoded]))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        cache, library = _cache(path), _tokenizer(path)
        for batch in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size, offsets, units, which in split(batch.column(1)):
                total = np.concatenate([[0], np.cumsum(lengths(units, table.value, cache, library)[which])])
                sizes.append(size)
                counts.append(total[offsets[1:]] - total[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
