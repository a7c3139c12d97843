"""Archives, index merging and vector search."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from acquira.llm import ann, warc
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string, size long"


def pages(spark):
    rng = random.Random(2)
    html = ["<p>é copy</p>", "<p>é copy</p>", None, "", "WARC/1.1\r\n\r\nfake\r\n\r\n", "x" * 200_000, "<p>é copy</p>"] + [f"<p>{rng.random()}</p>" for _ in range(30)]
    urls = ["http://www.a.org/x", "https://b.A.org/y?q=1", None, "not a url", "http://[bad", "http://c.org/\r\nX: y"]
    return spark.createDataFrame([(i * 3 % 101, urls[i % len(urls)], h, "d", 1) for i, h in enumerate(html)], PAGES)


def test_archive_round_trip(spark):
    df = pages(spark)
    rows = df.collect()
    got = {r.page_id: r for r in warc.archive(df).collect()}
    first = {}
    for r in rows:
        first[r.html or ""] = min(r.page_id, first.get(r.html or "", 1 << 60))
    for r in rows:
        b = (r.html or "").encode()
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        f = first[r.html or ""]
        assert (g.record_type, g.refers_to) == (("response", None) if f == r.page_id else ("revisit", f))
    order = [(r.urlkey.encode(), r.timestamp, r.page_id) for r in sorted(got.values(), key=lambda r: (r.part, r.place))]
    assert order == sorted(order) and len(got) == len(rows)


def test_small_payloads_and_null_ids(spark):
    df = spark.createDataFrame([(1, "http://a.org", "ab", "", 0), (2, "http://a.org", "ab", "", 0), (None, "http://a.org", "abcdef", "", 0), (4, "http://a.org", "abcdef", "", 0), (4, "http://a.org", "abcdef", "", 0)], PAGES)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive(df, min_bytes=3).collect()), key=str)
    assert got == sorted([(1, "response", None), (2, "response", None), (None, "revisit", 4), (4, "response", None), (4, "response", None)], key=str)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_members_are_found_by_offset_and_large_records_end_in_zero(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = pages(spark)
    index = warc.archive(df, folder=f"file://{tmp_path}/w").collect()
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len({r.run for r in index}) > 3
    for r in index:
        data = open(r.run.removeprefix("file:"), "rb").read()[r.offset:r.offset + r.length]
        head, block = warc.parse(gzip.decompress(data))
        assert head["warc-type"] == r.record_type and (r.record_type == "revisit" or block.partition(b"\r\n\r\n")[2] == html[r.page_id])
    large = warc.member(b"x" * (17 << 20))
    assert large[-1] == 0 and [m[:2] for m in warc.members(large + warc.member(b"y"))][0] == (0, len(large)) and gzip.decompress(large) == b"x" * (17 << 20)
    for cut in (large[:-30], large[:100]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.members(cut))


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in range(0, 12):
        lists = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for xs in lists for x in xs)
        assert list(warc.merged(lists, lambda x: x, 3)) == sorted(x for xs in lists for x in xs)


VECTORS = "vec_id long, embedding array<float>, label int, score double, v string"


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=900)] + rng.normal(size=(900, 16)) * 0.4).astype(np.float32)
    x[300:700] = x[300]  # a third and more are one vector
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [1.0, 2.0]), (None, [1.0] * 16)]
    rows = [(i, v.tolist(), 1, 0.0, "v") for i, v in enumerate(x)] + [(i, v, None, None, None) for i, v in odd]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, VECTORS), queries=F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y = x.astype(float)
    hit = 0
    for q in range(0, 900, 50):
        s = (y * y[q]).sum(1) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q])
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hit += len({v for v, _ in got[q].values()} & set(best))
        assert all(abs(sc - s[v]) < 1e-12 for v, sc in got[q].values()) and set(got[q]) == {1, 2, 3, 4, 5}
    assert hit / 90 >= 0.9 and set(got) == set(range(0, 900, 50))


def test_search_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, ""), (50, [1.0, 0.0], 1, 0.0, ""), (3, [0.0, 1.0], 1, 0.0, "")], VECTORS)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(few, queries=F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert ann.search(spark.createDataFrame([], VECTORS), queries=F.lit(True)).count() == 0


def test_search_opens_few_leaves_of_clustered_vectors(spark, monkeypatch):
    """Where vectors have a structure, a small share of the leaves holds nearly all neighbours, queries in several shares."""
    seen = []
    plain = ann.visits_for

    def watch(tree, *rest):
        seen.append((plain(tree, *rest), tree.leaves))
        return seen[-1][0]

    monkeypatch.setattr(ann, "visits_for", watch)
    monkeypatch.setattr(ann, "BIN_QUERIES", 9)
    monkeypatch.setattr(ann, "BIN_ROWS", 60)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(60, size=3000)] + rng.normal(size=(3000, 24)) * 0.15
    got = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist(), 1, 0.0, "v") for i, v in enumerate(x)], VECTORS), queries=F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y[::50] @ y.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -9
    hit = sum(len(set(np.argsort(-s[i])[:5].tolist()) & got[50 * i]) for i in range(60))
    assert hit / 300 >= 0.95 and seen[0][0] <= 0.2 * seen[0][1]
