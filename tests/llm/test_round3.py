"""Exact deduplication, fill-in-the-middle and whitening, each against a plain computation."""

import hashlib
import random
import re

import numpy as np
import pytest
from acquira.llm import exact_dedup, fim, queries, whitening
from acquira.llm.shared import Scratch
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", content string, id string, size int, rng int, edge int, keep_id string, head string, x string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0, *["?"] * 2, 0, 0, 0, *["?"] * 3) for i, t in rows], DOCS + CLASH)


# ---------------------------------------------------------------- exact dedup


def grouped_by_hand(rows):
    groups, out = {}, []
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for i, t in rows:
        c = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[c])
        out.append((i, best[3], len(groups[c]), hashlib.sha256(c.encode()).hexdigest()))
    return sorted(out, key=str)


def held(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def mixed_rows():
    rng = random.Random(7)
    base = ["", None, " \t\n", "a b", "ab", "a b", "é" * 50, "é", "x" * 300_000, "x" * 300_000 + "y", "x" * 31 + "1", "x" * 31 + "2", "\U0001f600 z", "\x1c", "ab\x00"]
    texts = [rng.choice(base) for _ in range(300)] + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(9))) for _ in range(400)] + ["hot copy of a page"] * 500
    rng.shuffle(texts)
    return [(i if rng.random() > 0.03 else None, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (5, "tw ice"), (None, "twice")]


def test_groups_equal_plain_ones_and_one_row_of_each_stays(spark):
    rows = mixed_rows()
    out = exact_dedup.content_groups(documents(spark, rows)).cache()
    assert held(out) == grouped_by_hand(rows)
    stay = out.where("kept").collect()
    assert len(stay) == len({r.text_sha256 for r in stay}) == out.select("text_sha256").distinct().count()
    assert all(r.doc_id == r.keep_id for r in stay)
    out.unpersist()


def test_a_large_group_is_cut_over_ranges_and_joined_again(spark):
    rows = [(i, "one page that everyone copies") for i in range(3000)] + [(3000 + i, f"page {i}") for i in range(1000)]
    with Scratch(spark) as scratch:
        out = exact_dedup.content_groups(documents(spark, rows), scratch=scratch)
        per_range = [r["count"] for r in spark.read.parquet(scratch.folder + "/1").groupBy("rng").count().collect()]
        assert len(per_range) == 4 and max(per_range) < 2000  # three quarters of the rows are one text
        assert held(out) == grouped_by_hand(rows) and out.where("kept").count() == 1001


def test_copies_go_with_all_columns_kept(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, "c")]
    stay = exact_dedup.drop_copies(documents(spark, rows))
    assert stay.columns == documents(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == [(2, "a  b"), (3, None), (5, "c")]
    assert exact_dedup.content_groups(documents(spark, [])).count() == 0


def test_scratch_tables_go_when_a_query_fails(spark):
    seen = []

    @exact_dedup.scratched
    def fails(df, *, scratch):
        scratch.write(df)
        seen.append(scratch.folder)
        raise ValueError

    with pytest.raises(ValueError):
        fails(spark.range(3))
    path = spark._jvm.org.apache.hadoop.fs.Path(seen[0])
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


# ---------------------------------------------------------------- fill in the middle


PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s)."}


def rearranged_by_hand(i, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j:8 * j + 8], 16) for j in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in fim.SENTINELS) or h3 % 100 >= rate:
        return i, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return i, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def fim_rows():
    rng = random.Random(3)
    fixed = [None, "", "\n", "\n\n", "a", "a\n", "\na", "<P>", "x <M> y", "<S", ">P>", "<\n<P\n", "é\n\U0001f600\r\nz", "tail " * 3]
    made = ["".join(rng.choice(["a", "é", "\n", " ", "\U0001f600", "<", ">", "P"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    long = ["\n".join("line é " * rng.randrange(30) for _ in range(3000)), "x" * 200_000, "\n" * 100_000]
    texts = fixed + made + long
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (3, "same id\nother text"), (3, "same id\nother text")]


@pytest.mark.parametrize(("unit", "chunk"), [("line", 1), ("line", 7), ("line", fim.CHUNK), ("word", 5), ("char", 3), ("char", fim.CHUNK)])
def test_outputs_equal_plain_ones_for_any_chunk(spark, unit, chunk):
    rows = fim_rows() if chunk == fim.CHUNK else [(i, t) for i, t in fim_rows() if len(t or "") < 1000]
    got = fim.rearrange(documents(spark, rows), unit=unit, seed=7, chunk=chunk)
    got = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((rearranged_by_hand(i, t, unit) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.back in texts[r.doc_id] for r in got)


def test_shares_of_forms_and_marks(spark):
    docs = documents(spark, [(i, "a\nb\nc\n") for i in range(2000)])
    forms = {r.form: r["count"] for r in fim.rearrange(docs, rate=50, spm=25).groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 180 < forms["spm"] < 330
    assert fim.rearrange(documents(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.rearrange(docs, sentinels=marks)
    with pytest.raises(ValueError):
        fim.rearrange(docs, unit="page")
    # slices of texts and chunks that end with them
    raw = np.frombuffer(b"ab\ncd\n\n" * 3, np.uint8)
    c = fim.Chunks(raw, np.array([0, 7, 7, 14, 21]), "line", 2)
    assert c.units.tolist() == [3, 0, 3, 3] and c.places(np.array([0, 2, 3, 1, 3]), np.array([1, 2, 3, 0, 0])).tolist() == [3, 6, 7, 0, 0]


# ---------------------------------------------------------------- whitening


VECTORS = "vec_id long, embedding array<float>, label int, id string, x string, n string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "?", "?", "?", "?") for i, v in rows], VECTORS)


def fitted(rows):
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in fine])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    off = fit - s / n
    e, basis = np.linalg.eigh(off.T @ off / n)
    return [i for i, _ in fine], x, n, s, e[::-1], basis[:, ::-1].T


@pytest.mark.parametrize("d", [3, 8, 13])
def test_whitened_vectors_equal_numpy(spark, d):
    rng = np.random.default_rng(d)
    shape = rng.normal(size=(d, d))
    rows = [(i, (rng.normal(size=d) @ shape / 4).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(150)]  # a third of the rows is one vector
    rows += [(400, None), (401, [None] * d), (402, [float("nan")] * d), (403, [float("-inf")] + [0.0] * (d - 1)), (404, [-0.0] * d), (None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1])]
    ids, x, n, s, e, basis = fitted(rows)
    got = whitening.by_component(whitening.whiten(vectors(spark, rows))).collect()
    k = min(4, d)
    assert len(got) == k * len(ids)
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, int(((n * v - s).astype(object) ** 2).sum())) for i, v in zip(ids, x, strict=True)}
    for c in range(k):
        mine = sorted(((str(r.vec_id), r.whitened) for r in got if r.component == c + 1))
        want = (x - s / n) @ basis[c] / np.sqrt(e[c])
        order = sorted(zip(map(str, ids), want.tolist(), strict=True))
        sign = np.sign(mine[np.argmax([abs(v) for _, v in mine])][1] * order[np.argmax([abs(v) for _, v in mine])][1])
        signed = sorted((i, sign * v) for i, v in order)
        assert [i for i, _ in mine] == [i for i, _ in signed] and np.allclose([v for _, v in mine], [v for _, v in signed], rtol=1e-9, atol=1e-9)
        assert {round(r.explained, 12) for r in got if r.component == c + 1} == {round(e[c] / e.sum(), 12)}
    assert max(r.identity_error for r in got) < 1e-9


def test_vectors_that_span_little(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened) for r in same] == [(1, 1, 0, []), (2, 1, 0, [])]
    line = whitening.whiten(vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [4.0, 0.0, 0.0])])).collect()
    assert {len(r.whitened) for r in line} == {1} and all(r.explained == [1.0] for r in line)
    ragged = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [])])).collect()
    assert sorted(r.vec_id for r in ragged) == [1, 2]
    for rows in ([], [(1, None)]):
        assert whitening.by_component(whitening.whiten(vectors(spark, rows))).count() == 0


def test_one_aggregation_sums_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (300, 20))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    means = x.mean(0).tolist()
    assert np.allclose(whitening.products(df, "x", means), (x - means).T @ (x - means))


def test_queries_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet").count(), spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert queries.QUERIES["op11_content_sort"](spark, sf).count() == queries.QUERIES["op12_fill_in_middle"](spark, sf).count() == docs
    assert queries.QUERIES["op13_whitening"](spark, sf).count() <= 4 * pages
