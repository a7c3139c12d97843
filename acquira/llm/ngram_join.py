"""N-gram Jaccard join by a token-group matrix, and the components of its links.

Documents with equal sets are one class, a *node*. A node's column entries are its rarest shingles, its *prefix*: of n shingles in
ascending number of classes that have them, any n - ceil(s * n) + 1 have one in common with those of every set that is similar at s.
Common passages come last in that order, so documents that share nothing else never meet.

*Groups.* Nodes are partitioned by two minima of their hashed shingles, which similar sets share and others don't; groups of more than
MEMBERS are cut. Of each group that is visited, the union of its members' shingles is stored, with the number of members that have
each, and the same of their prefixes.

1. *Large columns.* The nodes of a column of more than CROWD visit the groups of its first HUBS nodes. What links join are components,
   which are the groups from then on (cut, if large), so the members of a large cluster make no rows for each other afterwards.
2. *Matrix.* In every column with more than one component the nodes of smaller components meet the groups of larger ones. Summed over
   the columns, a node's entries that a group has too bound the overlap: prefixes of similar sets have much more than one shingle in
   common, unless their sizes differ much. What meets often enough visits. In a column with more than SEVERAL components nodes visit
   bundles at once: of the nodes of small components that met the same hubs.

All visits, those of step 1 too, take the same way (``matched``). *Bounds:* the visitor's prefix against the stored union of prefixes;
what that leaves, its whole set against the stored union. *Opening:* the groups that some visitor's bound leaves open are opened, and
their members compared with these visitors, exactly. No link that joins two components is lost: each pair of similar nodes meets in a
column, and there they share a component or one visits the other's group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import Scratch, batch_rows, column_bytes, cut_keys, hashed_block, key_ranges, mix, pack_counts, pack_keys, scratched, shuffle_partitions, unpack_counts, unpack_keys, words

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Columns with more nodes are large; nodes of a large column whose groups all its others visit first.
CROWD, HUBS = 16, 2
#: Members of a group, those of a group within a component, a group's shingles, and visitors that it is compared with at a time. None
#: changes a result.
MEMBERS, LARGE, CHUNK_SHINGLES, VISITORS = 64, 4096, 1 << 20, 128
#: Components in a column from which on bundles are met in it, not single components; nodes from which on a component is in no bundle.
SEVERAL, SMALL = 32, 64
#: Meetings that are counted at a time.
MEETINGS = 1 << 21
#: Bytes of text whose shingles are made at a time.
SLICE_BYTES = 2 << 20


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, in this order, and each document's number of them.

    A text with fewer than ``size`` words has all its words as one shingle; one without words has none.
    """
    raw, offsets = column_bytes(texts)
    docs, hashes, counts, row = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1))
        doc, s, count = _sets_of_slice(raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], size)
        docs.append(doc + row)
        hashes.append(s)
        counts.append(count)
        row = end
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(counts)


def _sets_of_slice(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, owner, _ = words(raw, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(owner, minlength=n_docs)
    start = np.concatenate([[0], np.cumsum(count)])
    docs, hashes = [], []
    for length in range(1, size + 1):
        if length < size:
            at = start[:-1][count == length]
        else:
            at = np.flatnonzero(np.arange(len(h)) + size <= start[1:][owner]) if len(h) else np.zeros(0, np.int64)
        if not len(at):
            continue
        s = np.full(len(at), _U(length))
        for j in range(length):
            s = mix(s * _STEP + h[at + j])
        docs.append(owner[at])
        hashes.append(s)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(n_docs, np.int64)
    doc, s = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
    doc, s = doc[new], s[new]
    return doc, s, np.bincount(doc, minlength=n_docs)


def _sums(x: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    return total[at[1:]] - total[at[:-1]]


def signatures(s: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes that, with the size, tell a set from others."""
    return _sums(mix(s), doc, n_docs).view(np.int64), _sums(mix(s ^ _STEP), doc, n_docs).view(np.int64)


def _schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v()) for k, v in kinds.items()])


_INT, _LONG, _BYTES, _BOOL = T.IntegerType, T.LongType, T.BinaryType, T.BooleanType
_ROWS = _schema(block=_INT, part=_INT, data=_BYTES)
_SIGNED = _schema(id=_LONG, n=_LONG, s1=_LONG, s2=_LONG)
_POSTED = _schema(block=_INT, part=_INT, large=_BOOL, data=_BYTES, node=_LONG, n=_LONG, alike=_LONG, prefix=_BYTES)
_PAIR = _schema(node=_LONG, hub=_LONG)
_MET = _schema(node=_LONG, grp=_LONG, times=_LONG, needed=_LONG)
_EDGE = _schema(u=_LONG, v=_LONG)
_UNION = _schema(grp=_LONG, prefix=_BYTES, prefix_having=_BYTES, tokens=_BYTES, having=_BYTES, low=_LONG, high=_LONG)
_PASSED = _schema(node=_LONG, grp=_LONG, own=_BOOL)
#: What a column's entry holds: shingle, node, size of its set; in the second round also its component, its group and that one's rank.
_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4")])
_LABELLED = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("size", "<u4"), ("label", "<i8"), ("grp", "<i8"), ("bundle", "<i8")])


def _table(schema: T.StructType, *cols) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, schema.fields, strict=True)], schema.names)


def _none(schema: T.StructType) -> pa.Table:
    return _table(schema, *([] for _ in schema.fields))


def _entries(t: pa.Table, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(d, kind) for d in t["data"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _edges(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of x starts, and its length last."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))


def grouped(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows that agree in the keys; rows come in the keys' order."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None and len(rest):
            t = pa.concat_tables([rest, t])
        if not len(t):
            continue
        new = np.zeros(len(t) - 1, bool)
        for k in keys:
            c = t[k].to_numpy()
            new |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(new) + 1)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield t.slice(lo, hi - lo)
        rest = t.slice(at[-1])
    if rest is not None and len(rest):
        yield rest


def meet_hubs(entries: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (node, hub) of each column, without those whose sizes alone exclude the similarity."""
    entries = entries[np.lexsort((mix(entries["node"].view(_U)), entries["key"]))]
    key, node, n = entries["key"], entries["node"], entries["n"]
    out = [np.zeros((0, 2), np.int64)]
    if len(key):
        at = _edges(key)
        start = np.repeat(at[:-1], np.diff(at))
        place = np.arange(len(key)) - start
        for h in range(HUBS):
            i = np.flatnonzero(place > h)
            j = start[i] + h
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            out.append(np.stack([node[i[ok]], node[j[ok]]], 1))
    return np.unique(np.concatenate(out), axis=0)


def beyond_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that its prefix leaves out."""
    return (percent * n + 99) // 100 - 1


def needed_in_prefixes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that the prefixes of similar sets of a and b shingles have in common at least.

    Of the two, let u be the one whose prefix ends first. What they share up to there is in both prefixes, what they share after it is
    beyond u's prefix.
    """
    overlap = -(-percent * (a + b) // (100 + percent))
    return overlap - np.maximum(beyond_prefix(a, percent), beyond_prefix(b, percent))


def meet_groups(entries: np.ndarray, percent: int) -> list[np.ndarray]:
    """Node, group, how many of the node's entries lie in columns that the group has too, and how many a link needs at least.

    In each column the nodes meet the groups of larger components (of equal ones, those with the larger label). In a column with more
    than SEVERAL components they meet bundles, each its own too, and need nothing: such meetings all visit.
    """
    entries = entries[np.lexsort((entries["node"], entries["grp"], entries["label"], entries["size"], entries["key"]))]
    total = [np.zeros(0, np.int64)] * 4
    if not len(entries):
        return total
    at = _edges(entries["key"])
    label = entries["label"]
    mixed = np.flatnonzero(np.minimum.reduceat(label, at[:-1]) != np.maximum.reduceat(label, at[:-1]))
    # columns of the same nodes say the same, so one of them counts for all
    node = entries["node"].view(_U)
    same = np.stack([np.add.reduceat(mix(node), at[:-1]), np.add.reduceat(mix(node ^ _STEP), at[:-1])], 1)
    _, first, times = np.unique(same[mixed], axis=0, return_index=True, return_counts=True)
    column = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new_label = np.concatenate([[True], (column[1:] != column[:-1]) | (label[1:] != label[:-1])])
    label_at = np.maximum.accumulate(np.where(new_label, np.arange(len(column)), 0))  # where an entry's component starts in its column
    groups = np.flatnonzero(new_label | np.concatenate([[True], entries["grp"][1:] != entries["grp"][:-1]]))
    n = entries["n"].astype(np.int64)
    low, high = np.minimum.reduceat(n, groups), np.maximum.reduceat(n, groups)
    weight = np.zeros(len(at) - 1, np.int64)
    several = np.bincount(column[new_label], minlength=len(at) - 1) > SEVERAL
    weight[mixed[first]] = times
    bundled = _meet_bundles(entries[(several & (weight > 0))[column]], percent)
    weight[several] = 0
    visitors = np.where(weight[column[groups]] > 0, label_at[groups] - at[:-1][column[groups]], 0)
    lo = 0
    upto = np.cumsum(visitors)
    while lo < len(groups):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MEETINGS, "right")))
        g = np.repeat(np.arange(lo, hi), visitors[lo:hi])
        i = at[:-1][column[groups[g]]] + np.arange(len(g)) - np.repeat(np.cumsum(visitors[lo:hi]) - visitors[lo:hi], visitors[lo:hi])
        # members of sizes that a link allows
        least, most = np.maximum(low[g], -(-percent * n[i] // 100)), np.minimum(high[g], 100 * n[i] // percent)
        ok = least <= most
        g, i, least, most = g[ok], i[ok], least[ok], most[ok]
        needed = np.minimum(needed_in_prefixes(n[i], least, percent), needed_in_prefixes(n[i], most, percent))
        met = [entries["node"][i], entries["grp"][groups[g]], weight[column[groups[g]]], needed]
        met = [np.concatenate(x) for x in zip(total, met, strict=True)]
        order = np.lexsort(met[:2])
        met = [x[order] for x in met]
        runs = _edges(met[0] ^ (met[1] * np.int64(-7046029254386353131))) if len(order) else np.zeros(1, np.int64)
        total = [met[0][runs[:-1]], met[1][runs[:-1]], np.add.reduceat(met[2], runs[:-1]), np.minimum.reduceat(met[3], runs[:-1])] if len(order) else met
        lo = hi
    return [np.concatenate(x) for x in zip(total, bundled, strict=True)]


def _meet_bundles(entries: np.ndarray, percent: int) -> list[np.ndarray]:
    """The same of columns with many components: nodes meet the bundles that don't come before their own."""
    entries = entries[np.lexsort((entries["bundle"], entries["key"]))]
    key, bundle, n = entries["key"], entries["bundle"], entries["n"].astype(np.int64)
    if not len(entries):
        return [np.zeros(0, np.int64)] * 4
    blocks = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bundle[1:] != bundle[:-1])]))
    ends = np.concatenate([blocks[1:], [len(key)]])
    low, high = np.minimum.reduceat(n, blocks), np.maximum.reduceat(n, blocks)
    start = np.searchsorted(key, key[blocks])
    met = [np.zeros((0, 2), np.int64)]
    for b in range(len(blocks)):
        i = np.arange(start[b], ends[b])
        i = i[(100 * high[b] >= percent * n[i]) & (100 * n[i] >= percent * low[b])]
        met.append(np.stack([entries["node"][i], np.full(len(i), bundle[blocks[b]])], 1))
    met = np.unique(np.concatenate(met), axis=0)
    return [met[:, 0], met[:, 1], np.ones(len(met), np.int64), np.zeros(len(met), np.int64)]


def unite(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of sets and how many of them have each of its tokens."""
    return np.unique(np.concatenate(sets), return_counts=True)


def _place(sorted_tokens: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(sorted_tokens, q), max(len(sorted_tokens) - 1, 0))


def within_prefixes(union: np.ndarray, having: np.ndarray, low: int, high: int, q: np.ndarray, n: int, own: bool, percent: int) -> bool:
    """Whether a set of n with the prefix q may be similar to a member other than itself: the prefixes have too little in common, or not."""
    if 100 * high < percent * n or 100 * n < percent * low:
        return False
    common = 0
    if len(union):
        at = _place(union, q)
        common = int(((union[at] == q) & (having[at] > own)).sum())
    return (100 + percent) * (common + int(beyond_prefix(np.array(max(n, high)), percent))) >= percent * (n + low)


def within_bound(union: np.ndarray, having: np.ndarray, low: int, high: int, q: np.ndarray, own: bool, percent: int) -> bool:
    """Whether a set may reach the similarity with a member other than itself: its tokens that others have bound the overlap."""
    if 100 * high < percent * len(q) or 100 * len(q) < percent * low:
        return False
    at = _place(union, q)
    reach = int(((union[at] == q) & (having[at] > own)).sum())
    return (100 + percent) * reach >= percent * (len(q) + low)


def open_group(homes: list[tuple[int, np.ndarray]], visitors: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between visitors and members, as a forest: as many as join the same nodes."""
    sizes = np.array([len(s) for _, s in homes], np.int64)
    tokens = np.concatenate([s for _, s in homes])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(homes)), sizes)[order]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for node, q in visitors:
        lo, hi = np.searchsorted(tokens, q), np.searchsorted(tokens, q, "right")
        reach = hi - lo
        hit = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())]
        both = np.bincount(hit, minlength=len(homes))
        for j in np.flatnonzero(100 * both >= percent * (sizes + len(q) - both)):
            a, b = find(node), find(homes[j][0])
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


@scratched
def jaccard_components(df: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links, its own included) of every row.

    Two sets are linked if 100 * intersection >= percent * union. Texts that are null or have no words are empty and linked with
    nothing. Rows with a null id have no component and link nothing. Rows that share an id share a component, and each of their
    texts links it; an empty one's component is its own id. Columns other than the two named are not read.
    """
    spark = df.sparkSession
    n_parts = min(shuffle_partitions(spark), 65536)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = scratch.blocks(docs, hashed_block(spark, "id"))

    def sign(batches):
        for b in batches:
            doc, s, count = shingle_sets(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.astype(np.int64)), *map(pa.array, signatures(s, doc, len(b)))], _SIGNED.names)

    with batch_rows(spark, 2000):
        signed = scratch.write(blocks.select("id", "text").mapInArrow(sign, _SIGNED))
    with_words = signed.where("id IS NOT NULL AND n > 0")
    classes = scratch.write(with_words.groupBy("n", "s1", "s2").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    reps = scratch.write(classes.withColumn("block", hashed_block(spark, "id")))

    def sets_of(t: pa.Table, r: pa.Table):
        """A block's nodes, document and hash of their shingles, and their sets' sizes."""
        t = t.filter(pa.compute.is_in(t["id"], value_set=r["id"].combine_chunks()))
        doc, s, count = shingle_sets(t["text"], size)
        left = dict(zip(zip(*(r[c].to_pylist() for c in ("id", "n", "s1", "s2")), strict=True), r["node"].to_pylist(), strict=True))
        node = np.array([left.pop(k, -1) for k in zip(t["id"].to_pylist(), count.tolist(), *(x.tolist() for x in signatures(s, doc, len(t))), strict=True)], np.int64)
        if left:
            raise RuntimeError("a block's texts changed between passes")
        mine = node >= 0
        new = np.cumsum(mine) - 1
        own = mine[doc]
        return node[mine], new[doc[own]], s[own], count[mine]

    def ask(t: pa.Table, r: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        if not len(t) or not len(r):
            return _none(_ROWS)
        _, _, s, _ = sets_of(t, r)
        key, count = np.unique(s >> _U(16), return_counts=True)
        first, at = cut_keys(key, n_parts)
        parts = [i for i in range(n_parts) if at[i + 1] > at[i]]
        return _table(_ROWS, [t["block"][0].as_py()] * len(parts), parts, [pack_keys(key[at[i]:at[i + 1]], int(first[i]), int(first[i + 1]), count[at[i]:at[i + 1]]) for i in parts])

    def add(t: pa.Table) -> pa.Table:
        i, first = t["part"][0].as_py(), key_ranges(n_parts)
        keys, counts = zip(*(unpack_keys(d, int(first[i]), int(first[i + 1]), 1) for d in t["data"].to_pylist()), strict=True)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
        out = [pack_counts(total[p]) for p in np.split(place, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table([t["block"], t["part"], pa.array(out, pa.binary())], _ROWS.names)

    by = lambda d: d.groupBy("block")
    answers = scratch.write(by(blocks).cogroup(by(reps)).applyInArrow(ask, _ROWS).groupBy("part").applyInArrow(add, _ROWS))

    def post(t: pa.Table, r: pa.Table) -> pa.Table:
        """A block's entries of the matrix by ranges of shingles, large columns apart; and its nodes' sets, with what they are grouped by."""
        pa.default_memory_pool().release_unused()
        known = r.filter(pa.compute.is_valid(r["node"]))
        if not len(t) or not len(known):
            return _none(_POSTED)
        node, doc, s, count = sets_of(t, known)
        key = s >> _U(16)
        distinct, place = np.unique(key, return_inverse=True)
        sizes, at, freq = np.diff(cut_keys(distinct, n_parts)[1]), 0, np.zeros(len(distinct), np.int64)
        for part, data in sorted((p, d) for p, d in zip(r["part"].to_pylist(), r["data"].to_pylist(), strict=True) if d is not None):
            m = int(sizes[part])
            freq[at:at + m] = unpack_counts(data, 0, m)[0]
            at += m
        if at != len(distinct):
            raise RuntimeError("a block's texts changed between passes")
        f = freq[place]
        order = np.lexsort((key, f, doc))
        begin = np.concatenate([[0], np.cumsum(count)])
        prefix = count - (percent * count + 99) // 100 + 1
        keep = order[(np.arange(len(order)) - begin[doc[order]] < prefix[doc[order]]) & (f[order] >= 2)]
        rows: list[tuple] = []
        for large in (False, True):
            own = keep[(f[keep] > CROWD) == large]
            e = np.zeros(len(own), _ENTRY)
            e["key"], e["node"], e["n"] = key[own], node[doc[own]], count[doc[own]]
            e = e[np.argsort(e["key"], kind="stable")]
            at = cut_keys(e["key"], n_parts)[1]
            rows += [(i, large, e[at[i]:at[i + 1]].tobytes(), None, None, None, None) for i in range(n_parts) if at[i + 1] > at[i]]
        h = mix(s)
        alike = mix(np.minimum.reduceat(h, begin[:-1]) + _STEP * np.minimum.reduceat(mix(h ^ _STEP), begin[:-1])).view(np.int64)
        short = key[keep].astype("<u4")  # 32 bits tell enough: what meets by chance makes a bound looser
        prefixes = np.split(short[np.lexsort((short, doc[keep]))], np.cumsum(np.bincount(doc[keep], minlength=len(node)))[:-1])
        rows += [(None, None, s[begin[d]:begin[d + 1]].tobytes(), int(node[d]), int(count[d]), int(alike[d]), prefixes[d].tobytes()) for d in np.unique(doc[keep]).tolist()]
        block = t["block"][0].as_py()
        return _table(_POSTED, [block] * len(rows), *(list(c) for c in zip(*rows, strict=True))) if rows else _none(_POSTED)

    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = reps.select("block", "node", "id", "n", "s1", "s2", nothing("int", "part"), nothing("binary", "data")).unionByName(answers, allowMissingColumns=True)
    posted = scratch.write(by(blocks).cogroup(by(known)).applyInArrow(post, _POSTED))
    sets = posted.where("part IS NULL").select("node", "data")
    packets = posted.where("part IS NOT NULL").select("block", "part", "large", "data")

    spread = lambda d, *keys: d.repartition(n_parts, *keys[:2]).sortWithinPartitions(*keys)
    hash_of = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
    several = lambda c, k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(c)
    array = lambda d, kind="<u8": np.frombuffer(d, kind)

    def unions(batches):
        for t in grouped(batches, "grp"):
            u, having = unite([array(d) for d in t["data"].to_pylist()])
            p, p_having = unite([array(d, "<u4") for d in t["prefix"].to_pylist()])
            n = t["n"].to_numpy()
            yield from _table(_UNION, [t["grp"][0].as_py()], [p.tobytes()], [p_having.astype("<u4").tobytes()], [u.tobytes()], [having.astype("<u4").tobytes()], [int(n.min())], [int(n.max())]).to_batches()

    def bound(test, kind):
        def run(batches):
            for t in grouped(batches, "grp", "share"):  # the group's row comes first, having no node
                kept, u = [], None
                for r in t.select(["node", "own", "n", "tokens", "having", "low", "high"]).to_pylist():
                    if r["node"] is None:
                        u = (array(r["tokens"], kind), array(r["having"], "<u4"), r["low"], r["high"])
                    elif u is not None and test(u, array(r["tokens"], kind), r["n"], r["own"]):
                        kept.append((r["node"], t["grp"][0].as_py(), r["own"]))
                yield from _table(_PASSED, *(zip(*kept, strict=True) if kept else ([], [], []))).to_batches()

        return run

    def verify(batches):
        for t in grouped(batches, "grp", "share"):
            member = t["member"].to_numpy(zero_copy_only=False)
            rows = [(i, array(d)) for i, d in zip(t["node"].to_pylist(), t["data"].to_pylist(), strict=True)]
            homes, visitors = [x for x, m in zip(rows, member, strict=True) if m], [x for x, m in zip(rows, member, strict=True) if not m]
            if homes and visitors:
                pairs = open_group(homes, visitors, percent)
                yield from _table(_EDGE, *(zip(*pairs, strict=True) if pairs else ([], []))).to_batches()

    def matched(visits: DataFrame, homes: DataFrame, step: str) -> DataFrame:
        """Links (u, v) between visitors (node, grp) and the members (node, grp, n, prefix) of the groups they visit."""
        shares = lambda v: v.groupBy("grp").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("shares"))
        asked = scratch.write(shares(visits))
        members = homes.join(asked.select("grp"), "grp")
        with batch_rows(spark, 1000):
            union = scratch.write(spread(members.join(sets, "node"), "grp").mapInArrow(unions, _UNION))

        def passing(callers: DataFrame, groups: DataFrame, tokens: str, having: str, kind: str, test) -> DataFrame:
            rows = callers.join(groups, "grp").withColumn("share", hash_of("node", "shares")).drop("shares")
            shown = union.join(groups, "grp").select("grp", several("share", "shares"), F.col(tokens).alias("tokens"), F.col(having).alias("having"), "low", "high")
            ordered = rows.unionByName(shown, allowMissingColumns=True).repartition(n_parts, "grp", "share").sortWithinPartitions("grp", "share", F.col("node").asc_nulls_first())
            with batch_rows(spark, 1000):
                return scratch.write(ordered.mapInArrow(bound(test, kind), _PASSED))

        callers = visits.join(nodes.select("node", "n", F.col("prefix").alias("tokens")), "node")
        callers = callers.join(homes.select("node", "grp", F.lit(True).alias("own")), ["node", "grp"], "left").select("node", "grp", F.coalesce("own", F.lit(False)).alias("own"), "n", "tokens")
        near = passing(callers, asked, "prefix", "prefix_having", "<u4", lambda u, q, n, own: within_prefixes(*u, q, n, own, percent))
        left = scratch.write(shares(near))
        callers = near.join(sets, "node").select("node", "grp", "own", F.lit(0).cast("long").alias("n"), F.col("data").alias("tokens"))
        passed = passing(callers, left, "tokens", "having", "<u8", lambda u, q, n, own: within_bound(*u, q, own, percent))
        opened = scratch.write(shares(passed))
        places = homes.join(opened, "grp").select("grp", several("share", "shares"), "node", F.lit(True).alias("member"))
        places = places.unionByName(passed.join(opened, "grp").select("grp", hash_of("node", "shares").alias("share"), "node", F.lit(False).alias("member")))
        with batch_rows(spark, 1000):
            links = scratch.write(spread(places.join(sets, "node"), "grp", "share").mapInArrow(verify, _EDGE).distinct())
        scratch.named |= {f"{step} {k}": d for k, d in (("visits", visits), ("visited", asked), ("near", near), ("passed", passed), ("opened", opened), ("links", links))}
        return links

    # groups of similar nodes
    nodes = scratch.write(posted.where("part IS NULL").select("block", "node", "n", "alike", "prefix"))
    large = nodes.groupBy("alike").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_SHINGLES, F.count("*") / MEMBERS)).cast("int").alias("cuts")).where("cuts > 1")
    homes = scratch.write(nodes.join(large, "alike", "left").select("block", "node", "n", "prefix", F.xxhash64("alike", hash_of("node", F.coalesce("cuts", F.lit(1)))).alias("grp")))

    # 1: the nodes of large columns visit the groups of their first
    pairs = scratch.write(packets.where("large").groupBy("part").applyInArrow(lambda t: _table(_PAIR, *meet_hubs(_entries(t, _ENTRY), percent).T), _PAIR).distinct())
    visits = scratch.write(pairs.join(homes.select(F.col("node").alias("hub"), "grp"), "hub").select("node", "grp").distinct())
    more = [] if visits.isEmpty() else [matched(visits, homes, "first")]

    # 2: what is in smaller components meets the groups of larger ones
    if more:
        labels = components(more[0], scratch=scratch)
        # nodes of small components that met the same hubs are bundled
        met = pairs.unionByName(pairs.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
        least = met.groupBy("node").agg(F.least("node", F.min("hub")).alias("least"))
        wide = met.join(least.select(F.col("node").alias("hub"), "least"), "hub").groupBy("node").agg(F.min("least").alias("hub"))
        cuts = F.ceil(F.greatest(F.sum("n") / CHUNK_SHINGLES, F.count("*") / LARGE)).cast("int").alias("cuts")
        sized = labels.join(homes.select("node", "n"), "node").groupBy("label").agg(F.count("*").alias("size"), cuts)
        parted = homes.drop("grp").join(labels, "node", "left").join(sized, "label", "left").withColumns({"label": F.coalesce("label", "node"), "size": F.coalesce("size", F.lit(1)), "cuts": F.coalesce("cuts", F.lit(1))})
        parted = parted.withColumn("grp", F.xxhash64("label", hash_of("node", F.col("cuts")))).drop("cuts").join(wide, "node", "left")
        full = parted.where(F.col("size") < SMALL).groupBy("hub").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_SHINGLES, F.count("*") / LARGE)).cast("int").alias("parts"))
        bundle = F.when((F.col("size") < SMALL) & F.col("hub").isNotNull(), F.xxhash64("hub", hash_of("node", F.coalesce("parts", F.lit(1))), F.lit(1))).otherwise(F.col("grp"))
        homes = scratch.write(parted.join(full, "hub", "left").withColumn("bundle", bundle).drop("hub", "parts"))
    else:
        labels = None
        homes = scratch.write(homes.withColumns({"label": F.col("node"), "size": F.lit(1).cast("long"), "grp": F.xxhash64("node", F.lit(0)), "bundle": F.xxhash64("node", F.lit(0))}))

    def relabel(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t) or not len(r):
            return _none(_ROWS)
        node, fields = r["node"].to_numpy(), {c: r[c].to_numpy() for c in ("label", "grp", "size", "bundle")}
        order = np.argsort(node)
        out = []
        for d in t["data"].to_pylist():
            e = np.frombuffer(d, _ENTRY)
            x = np.zeros(len(e), _LABELLED)
            at = order[np.searchsorted(node, e["node"], sorter=order)]
            for c in _ENTRY.names:
                x[c] = e[c]
            for c, v in fields.items():
                x[c] = np.minimum(v[at], 2**32 - 1) if c == "size" else v[at]
            out.append(x.tobytes())
        return _table(_ROWS, t["block"].to_pylist(), t["part"].to_pylist(), out)

    labelled = by(packets.select("block", "part", "data")).cogroup(by(homes.select("block", "node", "label", "grp", "size", "bundle"))).applyInArrow(relabel, _ROWS)
    met = labelled.groupBy("part").applyInArrow(lambda t: _table(_MET, *meet_groups(_entries(t, _LABELLED), percent)), _MET)
    visits = scratch.write(met.groupBy("node", "grp").agg(F.sum("times").alias("times"), F.min("needed").alias("needed")).where("times >= needed").select("node", "grp"))
    if not visits.isEmpty():
        every = homes.select("node", "grp", "n", "prefix").unionByName(homes.where("bundle <> grp").select("node", F.col("bundle").alias("grp"), "n", "prefix"))
        more.append(matched(visits, every, "second"))
        labels = None
    of_set = ["n", "s1", "s2"]
    twice = with_words.groupBy("id").agg(F.min(F.struct(*of_set)).alias("a"), F.max(F.struct(*of_set)).alias("b")).where("a <> b").select("id")
    twice = scratch.write(with_words.join(twice, "id", "left_semi").distinct())
    if not twice.isEmpty():
        named = twice.join(classes.drop("id"), of_set)
        more.append(named.join(named.groupBy("id").agg(F.min("node").alias("v")), "id").select(F.col("node").alias("u"), "v"))
        labels = None
    if labels is None or len(more) > 1:
        every = spark.createDataFrame([], _EDGE)
        for x in more:
            every = every.unionByName(x)
        labels = components(every, scratch=scratch)
    least = classes.join(labels, "node").groupBy("label").agg(F.min("id").alias("component_id"))
    named = classes.join(labels.join(least, "label"), "node", "left").select(*of_set, F.coalesce("component_id", "id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = signed.join(named, of_set, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
    return out


@scratched
def components(links: DataFrame, *, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node that links (u, v) lead to, for every node of a link.

    In each round every node takes its smallest neighbour if that is smaller, chains of such choices are followed to their ends,
    and the links between the ends are what is left; nodes fall to half at least. All is joins of written tables.
    """
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    left = scratch.write(links)
    labels = scratch.write(left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct().withColumn("label", F.col("node")))
    while not left.isEmpty():
        parent = scratch.write(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up")))
        while True:  # each pass doubles the steps that are followed
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            joined = scratch.write(parent.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            parent = joined.select("node", "up")
            if joined.where("moved").isEmpty():
                break
        labels = scratch.write(labels.join(parent.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        a = left.join(parent.select(F.col("node").alias("u"), F.col("up").alias("pu")), "u", "left").select("v", F.coalesce("pu", "u").alias("u"))
        b = a.join(parent.select(F.col("node").alias("v"), F.col("up").alias("pv")), "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        left = scratch.write(b.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return labels


def oracle(size: int = 5, percent: int = 80) -> str:
    """The result in DuckDB's SQL: all pairs that share a shingle, and everything that their links reach."""
    gram = " || ' ' || ".join(f"ws[i + {j}]" for j in range(size))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, ws, CAST(unnest(range(1, len(ws) - {size} + 2)) AS INT) AS i FROM d WHERE len(ws) >= {size}) x
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {size - 1}),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {percent} * (x.n + y.n - c)),
 e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
 r(doc_id, reach) AS (SELECT u, u FROM e UNION SELECT e.v, r.reach FROM r JOIN e ON e.u = r.doc_id),
 c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""
