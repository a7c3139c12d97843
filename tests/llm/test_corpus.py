"""The corpus-wide operators against brute force, on tables with nulls, repeats, ties, empty and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from acquira.llm import langid, lm, mixing, ngram_join, quality, suffix
from acquira.llm.shared import Scratch
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, id long, size long, kept string"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", "\n", ","]) for _ in range(n))
    base, passage = text(120), text(40)
    rows = [base, base, base.upper(), base + " tail", " ".join(base.split()[:110]), text(80) + passage + text(30), passage, passage + text(70), None, "", "   \n", "one", "one", "one two three", "One two  three", "a b c d e", "a b c d e f"]
    rows += [text(rng.randint(1, 90)) for _ in range(25)] + ["x" * 700, "x" * 350, "ab" * 300, text(4000), "the cat sat on the mat " * 30]
    near = base.split()
    for i in range(12):
        near[rng.randrange(len(near))] = word()
        rows.append(" ".join(near))
    return rows


def frame(spark, rows, ids=None):
    ids = ids or list(range(len(rows)))
    return spark.createDataFrame([(i, t, "en" if k % 3 else "de", ["s1", "s2", None, "s3"][k % 4], 1, 7, 7, 7, "k") for k, (i, t) in enumerate(zip(ids, rows))], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [shingles(t) for t in rows]
    for a in range(len(s)):
        for b in range(a):
            if s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: (len(x), find(i)) for i, x in zip(ids, s)}


def test_jaccard_components(spark):
    rows = corpus()
    ids = random.Random(3).sample(range(1000), len(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows, ids)).collect()}
    assert got == components(rows, ids)


def test_jaccard_null_and_repeated_ids(spark):
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, ["a b c d e f"] * 4 + [None], [5, 5, None, 3, 9])).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (None, 2, None), (3, 2, 3), (9, 0, 9)], key=str)


def test_jaccard_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows, ids = [a, b, a + " x", b + " y", "", "z"], [5, 5, 7, 9, 5, 11]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows, ids)).collect())
    assert got == [(5, 0, 5), (5, 56, 5), (5, 56, 5), (7, 57, 5), (9, 57, 5), (11, 1, 11)]


@pytest.mark.parametrize("hubs, chunk, visitors, several", [(1, 64, 2, 2), (2, 1 << 20, 30, 32), (1, 1 << 20, 5, 1)])
def test_jaccard_clusters_of_near_copies(spark, monkeypatch, hubs, chunk, visitors, several):
    """Clusters whose members are at about the similarity, so that many links decide and many fail; groups in several chunks."""
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(ngram_join, "MEMBERS", visitors)
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "LARGE", 7)
    monkeypatch.setattr(ngram_join, "SEVERAL", several)
    monkeypatch.setattr(ngram_join, "SMALL", 6)
    monkeypatch.setattr(ngram_join, "MEETINGS", 50)
    monkeypatch.setattr(ngram_join, "VISITORS", visitors)
    rng, rows = random.Random(11), []
    for c in range(3):
        base = [f"w{rng.randrange(4000)}" for _ in range(70)]
        for _ in range(40):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(70)] = f"v{rng.randrange(9999)}"
            rows.append(" ".join(near[rng.randint(0, 4):]))
    ids = rng.sample(range(1000), len(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows, ids)).collect()}
    want = components(rows, ids)
    assert got == want and 4 < len({c for _, c in want.values()}) < 100


def told(spark, df):
    """Rows of each table of the way, and the number of components."""
    with Scratch(spark) as scratch:
        out = ngram_join.jaccard_components(df, scratch=scratch)
        return out.select("component_id").distinct().count(), {k: d.count() for k, d in scratch.named.items()}, {k: {r.grp for r in d.select("grp").distinct().collect()} for k, d in scratch.named.items() if "links" not in k}


def test_links_come_through_stored_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    _, rows, groups = told(spark, docs)
    visits, opened = (sum(n for k, n in rows.items() if k.endswith(x)) for x in ("visits", "opened"))
    assert visits >= opened > 0 and sum(n for k, n in rows.items() if k.endswith("links")) > 0
    for step in {k.split()[0] for k in rows}:  # only groups that a bound left open are opened
        assert groups[f"{step} opened"] == groups[f"{step} passed"] <= groups[f"{step} near"] <= groups[f"{step} visited"]


@pytest.mark.parametrize("crowd", [16, 3])
def test_templated_texts_meet_and_hardly_visit(spark, monkeypatch, crowd):
    """Texts of the same paragraphs, none similar to another: whole sets of none are sent, however many there are."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = random.Random(1)
    paragraphs = [" ".join(f"w{rng.randrange(5000)}" for _ in range(14)) for _ in range(60)]
    n = 1200
    df = spark.createDataFrame([(i, " ".join(rng.sample(paragraphs, 20))) for i in range(n)], "doc_id long, text string")
    found, rows, _ = told(spark, df)
    count = lambda name: sum(v for k, v in rows.items() if k.endswith(name))
    assert found == n and count("near") <= count("visits") // 50 and count("opened") <= count("visits") // 1000
    if crowd == 3:  # the nodes of large columns visit, and their prefixes' bounds keep nearly all groups closed
        assert n < rows["first visits"] < 80 * n


@pytest.mark.parametrize("percent", [80, 57, 95])
def test_prefixes_of_similar_sets_share_what_is_needed(percent):
    rng = np.random.default_rng(5)
    for _ in range(300):
        base = rng.permutation(400)[: rng.integers(5, 300)]
        a, b = (np.sort(rng.permutation(base)[: max(1, int(len(base) * rng.uniform(0.7, 1)))]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            p, q = (x[: len(x) - int(ngram_join.beyond_prefix(np.array(len(x)), percent))] for x in (a, b))
            assert len(np.intersect1d(p, q)) >= ngram_join.needed_in_prefixes(np.array(len(a)), np.array(len(b)), percent)


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def repeats(rows, length):
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                cover[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), spans, bytes(c for c, m in zip(b, cover) if not m)))
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeated_strings(spark, length):
    rows = corpus(2)
    got = suffix.remove_repeats(frame(spark, rows), length=length, carry=["source"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}
    assert [got[i] for i in range(len(rows))] == repeats(rows, length)


def test_repeated_strings_null_ids_are_last(spark):
    t = "q" * 30 + "".join(map(str, range(60)))
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(frame(spark, [t, t, t], [None, 4, 2]), length=100).collect()}
    assert got == {2: 0, 4: len(t), None: len(t)}


def test_repeated_strings_of_rows_with_one_id(spark):
    """Most rows share an id or have none: they go to several blocks, in the order of their texts' hashes."""
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(6)]
    rows = [f"{i} " + rng.choice(passages) + f" {i * 7}" + rng.choice(passages) for i in range(60)] + [None, "�" + passages[0] + "é�"]
    ids = [5] * 25 + [None] * 25 + list(range(12))
    df = frame(spark, rows, [None if i is None else i for i in ids])
    tie = {r.text: r.tie for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("tie")).collect()}
    order = sorted(range(len(rows)), key=lambda k: (ids[k] is None, ids[k] or 0, tie[rows[k]], rows[k] or ""))
    want = sorted(((ids[k], rows[k], *r) for k, r in zip(order, repeats([rows[k] for k in order], 100))), key=str)
    got = suffix.remove_repeats(df.withColumn("was", F.col("text")), length=100, carry=["was"]).collect()
    assert sorted(((r.doc_id, r.was, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == want
    assert all(r.kept_text == (None if r.was is None else bytes(r.kept).decode("utf-8", "ignore")) for r in got)
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, length=31)


def test_suffix_ranks():
    import numpy as np

    b = np.frombuffer(b"abracadabra" * 9, np.uint8)
    rank = suffix.suffix_ranks(b, 33)
    strings = [bytes(b[i:i + 33]) for i in range(len(b) - 32)]
    assert all((strings[i] == strings[j]) == (rank[i] == rank[j]) for i in range(len(strings)) for j in range(i))


def test_language_model(spark):
    rows = corpus(4)
    fold = langid.fold(F.col("doc_id"), 10)
    got = {r.doc_id: r for r in lm.score(frame(spark, rows), train=fold != 0, tune=fold == 1).collect()}
    tokens = {i: words(t) + [None] for i, t in enumerate(rows)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(c[w] > 0 for w in ts), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), rel_tol=1e-9)
        assert got[i].score < 0 and got[i].trained == (i in train)


def test_language_model_score_by_plain_loops(spark):
    """Held-out counts, expectation-maximisation and mixture once more, a token at a time."""
    rows = [t for t in corpus(12) if t is None or len(t) < 3000] * 2
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    f = langid.fold(F.col("doc_id"), 10)
    got = {r.doc_id: r.score for r in lm.score(frame(spark, rows), train=f != 0, tune=f == 1).collect()}
    docs = {i: [None, *words(t), "</s>"] for i, t in enumerate(rows)}

    def counts(ids):
        uni, bi = Counter(), Counter()
        for i in ids:
            uni.update(docs[i][1:])
            bi.update(zip(docs[i], docs[i][1:]))
        return uni, bi

    early, early_bi = counts([i for i in docs if fold(i) > 1])
    na, va = sum(early.values()), len(early)
    of = lambda uni, h: uni["</s>"] if h is None else uni[h]  # noqa: E731  each document has one end, and one start
    bucket = lambda c: min(1 + int(math.log2(c)), lm.BUCKETS - 1) if c else 0
    near = lambda x, y: 2 ** (round(lm.STEPS * math.log2(x / y)) / lm.STEPS) if x else 0.0
    cells = {}
    for i in docs:
        if fold(i) == 1:
            for h, w in zip(docs[i], docs[i][1:]):
                c = of(early, h)
                cells.setdefault(bucket(c), []).append((near(early_bi[h, w], c) if c else 0.0, near(early[w], na), 1 / (va + 1)))
    weights, last = {0: [0.0, 0.7, 0.3]}, None
    for b in range(lm.BUCKETS):
        start = weights[0] if b == 0 else [0.3, 0.5, 0.2] if b == 1 else weights[b - 1]
        if b not in cells:
            weights[b] = start
            continue
        lam = [0.5, 0.3, 0.2] if b else [0.0, 0.6, 0.4]
        for _ in range(lm.ROUNDS):
            share = [[p * x / sum(p * x for p, x in zip(row, lam)) for p, x in zip(row, lam)] for row in cells[b]]
            new = [sum(r[k] for r in share) / len(share) for k in range(3)]
            moved, lam = max(abs(x - y) for x, y in zip(new, lam)), new
            if moved < 1e-9:
                break
        lam = [max(x, low) for x, low in zip(lam, [1e-6 if b else 0.0, 1e-6, 1e-6])]
        weights[b] = [x / sum(lam) for x in lam]
    uni, bi = counts([i for i in docs if fold(i)])
    n, v = sum(uni.values()), len(uni)
    for i, d in docs.items():
        want = 0.0
        for h, w in zip(d, d[1:]):
            c = of(uni, h)
            lam = weights[bucket(c)]
            want += math.log10(lam[0] * bi[h, w] / max(c, 1) + lam[1] * uni[w] / n + lam[2] / (v + 1))
        assert math.isclose(got[i], want, rel_tol=1e-6), (i, got[i], want)


def test_language_model_of_ids_as_text(spark):
    df = spark.createDataFrame([("x", "a b"), (None, None), ("z", "a a")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in lm.score(df, train=F.lit(True), tune=F.col("doc_id") == "z").collect()} == {"x": 3, None: 1, "z": 3}


def test_learned_weights_sum_to_one_and_follow_the_counts():
    import numpy as np

    w = lm.learn_weights(np.array([5, 5]), np.array([-4, lm.NONE]), np.array([-20, -20]), np.array([90, 10]), 1e-4)
    assert np.allclose(w.sum(1), 1) and w[5, 0] > 0.8 and w[0, 0] == 0


def test_line_quality(spark):
    rows = corpus(5) + ["Good words here and there for everyone to read today. " * 3, "home | about | contact\nAll rights reserved.\n" + "A fine line that ends well.\n" * 2]
    got = {r.doc_id: r for r in quality.clean_lines(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert got[len(rows) - 1].clean_text == "A fine line that ends well.\nA fine line that ends well."


def test_mix(spark):
    rows = corpus(6) * 3
    got = mixing.mix(frame(spark, rows), carry=["text"]).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    sources = {}
    for r in got:
        sources.setdefault(r.source, []).append(r)
    size = {s: sum(r["size"] for r in rs) for s, rs in sources.items()}
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2, 3]))
    open_, left, target = set(size), 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    for s, rs in sources.items():
        assert math.isclose(rs[0].target, target[s]) and sum(r.taken for r in rs) == round(target[s])
    drawn = mixing.draw(mixing.mix(frame(spark, rows), carry=["text"])).collect()
    assert sum(len((r.text or "").split()) for r in drawn) == sum(r.taken for r in got)


def test_language_id(spark):
    rng = random.Random(8)
    en, de = "the of and tion that with ing from".split(), "der die und schen nicht ung auf mit".split()
    rows = [" ".join(rng.choice(de if i % 3 == 0 else en) for _ in range(30)) for i in range(90)] + [None, "", "12 34!", "é"]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in langid.identify(df, train=langid.fold(F.col("doc_id"), 4) != 2).collect()}
    assert all(got[i].lang_pred == ("de" if i % 3 == 0 else "en") for i in range(90))
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[93].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, train=F.lit(False)).collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 12, 70):
        m = langid.codewords(n)
        assert m.shape == (n, min((1 << (n - 1)) - 1, 20 * (n - 1).bit_length())) and len({tuple(r) for r in m}) == n
        assert len({tuple(c) for c in m.T} | {tuple(-c) for c in m.T}) == 2 * m.shape[1] and (np.abs(m.sum(0)) < n).all()


def test_language_id_by_plain_loops(spark):
    """Counts, weights, margins and losses once more, a text at a time."""
    rng = random.Random(3)
    kinds = {"aa": "ab ba aab", "bb": "bc cb éc", "cc": "xa ya za"}
    langs = sorted(kinds)
    rows = [(i, " ".join(rng.choice(kinds[langs[i % 3]].split() + ["ab"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", " É1", "!"]), langs[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, train=F.col("doc_id") % 4 != 2).collect()}

    def features(text):
        b = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in text.encode())
        b = b" " + b.replace("É".encode(), "é".encode()) + b" "
        hashed = lambda x, y, z: (((x * 2654435761) % 2**32 ^ (y * 2246822519) % 2**32 ^ (z * 3266489917) % 2**32) >> 9) % langid.DIMENSIONS
        return [hashed(*b[j - 1:j + 2]) for j in range(1, len(b) - 1) if b[j] != 32]

    counts = {x: Counter() for x in langs}
    for i, t, x in rows:
        if i % 4 != 2:
            counts[x].update(features(t))
    p = {x: (lambda c, n: lambda f: (c[f] + 0.5) / (n + 0.5 * langid.DIMENSIONS))(counts[x], sum(counts[x].values())) for x in langs}
    code = langid.codewords(3)
    side = lambda f, j, s: sum(p[x](f) for k, x in enumerate(langs) if code[k, j] == s) / sum(code[:, j] == s)
    w = np.array([[math.log(side(f, j, 1) / side(f, j, -1)) for j in range(3)] for f in range(langid.DIMENSIONS)])
    dense = np.array([[p[x](f) for f in range(langid.DIMENSIONS)] for x in langs])
    scale = np.abs(dense @ w).mean(0)
    trust = np.array([[sum(dense[k][np.sign(w[:, j]) == code[k, j]]) for j in range(3)] for k in range(3)])
    trust /= trust.sum(1, keepdims=True)
    for i, t, _ in rows:
        f = features(t)
        z = np.clip(w[f].mean(0) / scale, -8, 8)
        loss = [sum(trust[k, j] * math.exp(-code[k, j] * z[j]) for j in range(3)) for k in range(3)]
        assert got[i].lang_pred == langs[int(np.argmin(loss))]
        assert math.isclose(got[i].score, 1 / sum(math.exp(-4 * (x - min(loss))) for x in loss), rel_tol=1e-9)
        best, second = sorted(loss)[:2]
        assert got[i].ambiguous == (second - best <= langid.AMBIGUOUS * best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_components(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert lm.score(none, train=F.lit(True), tune=F.lit(False)).count() == 0
    assert quality.clean_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert langid.identify(none, train=F.lit(True)).count() == 0
