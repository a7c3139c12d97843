import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from acquira.llm import bpe, token_counts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = ["Hello  world, it's 2024!\n\n ok ", "", None, "naïve 中文 🙂🙂 á", "a" * 5000 + " " * 70 + "b", "x\x00y \x1cz\x1d", "<|endoftext|> and <|startoftext|>x", "ΑΣ Σας end", "Hello  world, it's 2024!\n\n ok "]


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def rows(spark, schema):
    return spark.createDataFrame([(i if i != 3 else None, t, None, "s", 1) for i, t in enumerate(TEXTS)], schema)


def test_round_trip_is_tiktokens(spark, docs_schema):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(rows(spark, docs_schema), PATH, P.PATTERN).collect()}
    want = set()
    for i, t in enumerate(TEXTS):
        ids = reference().encode_ordinary(t or "")
        want.add((i if i != 3 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_encode_offsets_and_decode(spark, docs_schema):
    df = rows(spark, docs_schema)
    enc = bpe.encode(df, PATH, P.PATTERN, offsets=True)
    for r in enc.collect():
        t = "" if r.doc_id == 2 else TEXTS[3 if r.doc_id is None else r.doc_id]
        assert r.ids == reference().encode_ordinary(t or "")
        assert all(0 <= a < b <= len(t) for a, b in zip(r.starts, r.ends))
    assert {bytes(r.bytes) for r in bpe.decode(enc, PATH, P.PATTERN).collect()} == {(t or "").encode() for t in TEXTS}


def test_empty_tables(spark, docs_schema):
    none = spark.createDataFrame([], docs_schema)
    assert bpe.round_trip(none, PATH, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, WORDS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab'.=é")), max_size=60))
def test_units_are_tiktokens(text):
    c = bpe.codec(PATH, P.PATTERN)
    ids, at = next(c.encode_many(pa.array([text])))
    assert ids.tolist() == reference().encode_ordinary(text) and at.tolist() == [0, len(ids)]
    assert c.decode(ids)[0].tobytes() == text.encode()


def test_slices_caches_and_unknown_ids(monkeypatch):
    """Small slices and caches change nothing; long units aren't remembered."""
    c = bpe.codec(PATH, P.PATTERN)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 40)
    monkeypatch.setattr(bpe, "CACHE_UNITS", 5)
    texts = [*TEXTS, "b" * 300 + " c" * 9, "x  y", " lead and trail ", "\u3000 wide", "a\x00 b"]
    got = [ids[a:b].tolist() for ids, at in c.encode_many(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]
    assert got == [reference().encode_ordinary(t or "") for t in texts]
    assert all(len(u) <= bpe.CACHE_CHARACTERS for u in [*c.cache, *c.known])
    with pytest.raises(KeyError):
        c.decode(np.array([10**6]))


def test_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, None)], "doc_id long, text string, ids_sha256 string")
    assert {(r.doc_id, r.n_tokens) for r in bpe.round_trip(df, PATH, P.PATTERN).collect()} == {(1, 2), (None, 0)}


def test_counts_are_the_librarys(spark, docs_schema):
    lib = Tokenizer.from_file(WORDS)
    odd = ["".join(f"a{chr(c)}b{chr(c)} " for c in range(lo, lo + 500) if not 0xD800 <= c < 0xE000) for lo in range(1, 0x3200, 500)]
    texts = TEXTS + odd
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORDS, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 20)
