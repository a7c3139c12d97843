"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

#: Distinct units that a worker remembers, and the longest of them; beyond so many it forgets all. Results don't depend on it.
CACHE_UNITS, CACHE_CHARACTERS = 300_000, 64
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4 << 20
_WHITE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Texts that are cut into matches: a space beside other white space, or a zero.
JOINT = f" {_WHITE}|{_WHITE} |\\x{{00}}"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in out)
    out |= {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to make a token of two others, by the token's rank: what a rank file merges, as the library's merge list.

    Of one token's ways, those with a longer left part come first, as a rank file merges the leftmost place first.
    """
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        out += [(token[:i], token[i:]) for i in range(len(token) - 1, 0, -1) if token[:i] in ranks and token[i:] in ranks]
    return out


class Codec:
    """Encodes texts by a rank file as tiktoken does, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        ranks, chars = read_ranks(path), byte_characters()
        word = lambda token: "".join(chars[b] for b in token)
        merges = [(word(a), word(b)) for a, b in merges_of(ranks)]
        self.model = Tokenizer(models.BPE(vocab={word(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.chars = np.array([ord(c) for c in chars], "<u4")
        self.piece_size = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, rank in ranks.items():
            self.piece_size[rank] = len(token)
        self.piece_start = np.concatenate([[0], np.cumsum(np.maximum(self.piece_size, 0))])
        self.piece_bytes = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def byte_text(self, matches: list[str]) -> list[str]:
        """The matches with a character for each of their bytes; 0xFF, which UTF-8 never has, keeps them apart."""
        data = np.frombuffer(b"\xff".join(m.encode() for m in matches), np.uint8)
        return self.chars[data].tobytes().decode("utf-32-le").split(chr(self.chars[0xFF]))

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of distinct units, each one or more whole matches of the pattern."""
        matches = [self.pattern.findall(u) for u in units]
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        new = list({m for ms in matches for m in ms} - self.known.keys())
        for lo in range(0, len(new), 20_000):
            part = new[lo:lo + 20_000]
            for m, e in zip(part, self.model.encode_batch_fast(self.byte_text(part), add_special_tokens=False), strict=True):
                self.known[m] = array("I", e.ids).tobytes()
        at = self.known.__getitem__
        out = dict(zip(units, [b"".join(map(at, ms)) for ms in matches], strict=True))
        for m in new:
            if len(m) > CACHE_CHARACTERS:
                del self.known[m]
        return out

    def ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, from the worker's cache or learned; long units aren't remembered, so the cache's size is bounded."""
        cache = self.cache
        new = [u for u in units if u not in cache]
        if len(cache) + len(new) > CACHE_UNITS:
            cache.clear()
            new = units
        fresh = self._learn(new)
        out = [fresh[u] if u in fresh else cache[u] for u in units] if fresh else [cache[u] for u in units]
        if len(fresh) <= CACHE_UNITS:
            cache.update((u, i) for u, i in fresh.items() if len(u) <= CACHE_CHARACTERS)
        return out

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of texts: ids, and where each text's begin, with the end of the last; null is empty.

        A text is cut where matches end for certain, before a space between two characters that aren't white space; texts with longer
        runs of white space or a zero are cut into the matches themselves. Only a slice's distinct units become Python strings.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        total, row = np.concatenate([[0], np.cumsum(size)]), 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(total, total[row] + SLICE_BYTES, "right")) - 1)
            part = texts.slice(row, end - row)
            odd = pc.match_substring_regex(part, JOINT)
            parts = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", part), " ", "\0 "), "\0")
            coded = pc.dictionary_encode(parts.flatten())
            units, which, count = coded.dictionary.to_pylist(), coded.indices.to_numpy(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            if pc.any(odd).as_py():
                place = {u: i for i, u in enumerate(units)}
                rows, at = [], np.concatenate([[0], np.cumsum(count)])
                for i, o in enumerate(odd.to_pylist()):
                    own = which[at[i]:at[i + 1]] if not o else np.array([place.setdefault(m, len(place)) for m in self.pattern.findall(part[i].as_py())], np.int64)
                    rows.append(own)
                    count[i] = len(own)
                units, which = list(place), np.concatenate(rows)
            blobs = self.ids_of(units)
            n = np.array([len(b) for b in blobs], np.int64) // 4
            ids, start = np.frombuffer(b"".join(blobs), "<u4"), np.concatenate([[0], np.cumsum(n)])
            held = np.concatenate([[0], np.cumsum(n[which])])
            yield ids[np.repeat(start[:-1][which] - held[:-1], n[which]) + np.arange(held[-1])], held[np.concatenate([[0], np.cumsum(count)])]
            row = end

    def offsets(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids, and each token's first character and the one after its last; a character split between tokens belongs to each."""
        ids, starts, ends = [], [], []
        at = 0
        for m in self.pattern.findall(text or ""):
            owner = [at + i for i, c in enumerate(m) for _ in c.encode()]
            enc = self.model.encode(self.byte_text([m])[0], add_special_tokens=False)
            ids += enc.ids
            starts += [owner[a] for a, _ in enc.offsets]
            ends += [owner[b - 1] + 1 for _, b in enc.offsets]
            at += len(m)
        return ids, starts, ends

    def decode(self, ids: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where those of the ids from each of ``starts`` on begin.

        Exact also where a token holds part of a character. An unknown id raises.
        """
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.piece_size) or self.piece_size[ids].min() < 0):
            raise KeyError("an id without a token")
        size = self.piece_size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(self.piece_start[ids] - at[:-1], size) + np.arange(at[-1])]
        return data, at[starts] if starts is not None else at[[0, -1]]


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def encode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id, ids (and starts, ends in characters) of every row; a null or empty text has no ids. Other columns are not carried."""
    fields = _fields(df, id_col) + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ["ids", "starts", "ends"][: 3 if offsets else 1]]

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if offsets:
                cols = list(zip(*map(c.offsets, texts), strict=True)) or [[], [], []]
            else:
                cols = [[ids[a:b].astype(np.int32) for ids, at in c.encode_many(batch.column(1)) for a, b in zip(at[:-1], at[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), pa.list_(pa.int32())) for x in cols)], [f.name for f in fields])

    return df.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the bytes that its ids stand for (null ids: none); valid UTF-8 whenever the ids were encoded from a text."""
    schema = T.StructType(_fields(df, id_col) + [T.StructField("bytes", T.BinaryType())])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rows = [c.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id" if id_col == "doc_id" else id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids and returns counts and digests of both; rows come as they are, repeats too.

    A null text counts as an empty one, a null id stays null.
    """
    schema = T.StructType(_fields(df, id_col) + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, at in c.encode_many(batch.column(1)):
                data, begin = c.decode(ids, at)
                n += np.diff(at).tolist()
                ids_sha += [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                text_sha += [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
