"""N-gram Jaccard join: documents whose shingle sets overlap by at least three quarters.

Each distinct set has a point, the counts of its shingles in hashed groups.  The overlap of two sets is at
most the sum of the coordinate minima of their points; over the upper corners of an R-tree's boxes the same
sum bounds whole nodes.  A tree over all points would prune badly, as unrelated texts have like counts, so
the space is first cut by rare coordinates: each set goes to the neighbourhoods of its rarest shingles, as
many as two linked sets cannot lack in common.  Each neighbourhood has its own tree, and all pairs that are
verified on whole sets come from its bounds.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import buffers
from palimpsest.llm.common import keyed_text, without
from palimpsest.operators.components import components
from palimpsest.scratch import drop, free_driver, stored

#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Groups of a point, and of the coarser point over which trees are packed.
GROUPS, COARSE = 256, 64
#: Rarest shingles that a set shows of which at most a share of FREQUENT is frequent.  Of the other shingles of the
#: union with a linked set 0.6875 or more are shared, evenly over the order of hashes, so all SKETCH are unshared with
#: probability below 0.3125 ** SKETCH, less than that of a collision of hashes.  Any other set shows its whole prefix.
SKETCH, FREQUENT = 40, 1 / 16
#: Groups in which the holders of shingles are counted over the whole corpus, to tell rare shingles from frequent ones.
LOADS = 1 << 18
#: Points of one side of a search; a larger neighbourhood is searched in several tasks.
BLOCK = 8192
#: Compressed bytes of the texts that are verified together.
VERIFY_BYTES = 1 << 20
_LEAF, _FAN = 32, 16


def point(hashes: np.ndarray) -> bytes:
    """Counts by group, a byte each, after a scale byte; scaled counts are rounded up, so bounds stay bounds."""
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    scale = 0
    while -(-int(counts.max()) >> scale) > 255:
        scale += 1
    return bytes([scale]) + (-(-counts >> scale)).astype(np.uint8).tobytes()


def points(column: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(-1, GROUPS + 1)
    return raw[:, 1:].astype(np.int32) << raw[:, :1].astype(np.int32)


def coarse(at: np.ndarray) -> np.ndarray:
    """The points over COARSE groups."""
    return at.reshape(len(at), GROUPS // COARSE, COARSE).sum(axis=1, dtype=np.int32)


def needed(n, m):
    """Least overlap of linked sets with n and m shingles: (100 + p) * overlap >= p * (n + m)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class CountTree:
    """An R-tree over count points, packed in rising order of size and then of the first groups."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((at[:, 1], at[:, 0], sizes)) if len(at) else np.zeros(0, np.int64)
        self.at, self.sizes = at[self.order], sizes[self.order]
        #: levels from the leaves up: (upper corners, least and greatest size of each node)
        self.levels = []
        high, least, most, step = self.at, self.sizes, self.sizes, _LEAF
        while len(high) > 1 or not self.levels:
            starts = np.arange(0, max(1, len(high)), step)
            if not len(high):
                break
            high, least, most = np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((high, least, most))
            step = _FAN

    @staticmethod
    def _fits(at, n, high, least, most):
        """Whether a node may hold a set linked with the query: by sizes, then by the sum of minima."""
        close = (100 * most >= PERCENT * n) & (100 * n >= PERCENT * least)
        rows = np.flatnonzero(close)
        out = np.zeros(len(close), bool)
        for a in range(0, len(rows), 4096):
            r = rows[a : a + 4096]
            low = np.maximum(least[r], -(-PERCENT * n[r] // 100))
            out[r] = np.minimum(at[r], high[r]).sum(axis=1) >= needed(n[r], low)
        return out

    def search(self, at: np.ndarray, sizes: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) numbers of all pairs that sizes and points allow to be linked.

        ``wanted`` of (queries, entries) may rule pairs out before their points are compared.
        """
        if not len(at) or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = len(self.levels[-1][0])
        query, node = np.repeat(np.arange(len(at)), top), np.tile(np.arange(top), len(at))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            ok = self._fits(at[query], sizes[query], high[node], least[node], most[node])
            query, node = query[ok], node[ok]
            step = _FAN if depth else _LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.at)
            first, count = node * step, np.minimum(step, below - node * step)
            query, node = np.repeat(query, count), buffers.ragged_positions(first, count)
        if wanted is not None and len(query):
            ok = wanted(query, self.order[node])
            query, node = query[ok], node[ok]
        ok = self._fits(at[query], sizes[query], self.at[node], self.sizes[node], self.sizes[node])
        return query[ok], self.order[node[ok]]


def _group(hashes: np.ndarray) -> np.ndarray:
    """The load group of each shingle hash; its bits are none that ``point`` uses."""
    return (hashes >> np.uint64(40)).astype(np.int64) & (LOADS - 1)


def loads(docs: DataFrame, slices: int = 16) -> np.ndarray:
    """How many shingles of all texts, repeats included, fall into each of LOADS groups: one fixed-size table.

    Tasks count their own share; the counts are summed slice by slice in two steps, so no task sees more
    than a part of a slice's tables.
    """
    width = LOADS // slices

    def count(batches):
        seen = np.zeros(LOADS, np.int64)
        for batch in buffers.slices(batches):
            data, offsets = buffers.utf8(batch.column(0))
            for first, last in buffers.runs_of_documents(offsets):
                part = offsets[first : last + 1]
                hashes, _ = buffers.shingle_hashes(*buffers.word_hashes(data[part[0] : part[-1]], part - part[0]))
                seen += np.bincount(_group(hashes), minlength=LOADS)
        salt = TaskContext.get().partitionId() % 64
        parts = [zstandard.compress(x.tobytes(), 1) for x in seen.reshape(slices, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([salt] * slices, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "salt", "counts"])

    def add(found):
        total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in found.column("counts"))
        return pa.table({"slice": found.column("slice")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slice int, salt int, counts binary"
    some = docs.select("text").mapInArrow(buffers.tidy(count), schema).groupBy("slice", "salt").applyInArrow(add, schema)
    rows = some.groupBy("slice").applyInArrow(add, schema).collect()
    out = np.zeros((slices, width), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
    return out.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """A level for each load group: 0 up to four times the mean load, and one more for each further doubling."""
    mean = max(1.0, float(counts.mean()))
    return np.clip(np.log2(np.maximum(counts, 1) / mean) - 1, 0, 40).astype(np.uint8)


def prefix_size(n):
    """How many of its rarest shingles a set of n must show: of any 75 % of them at least one is shown."""
    return n - (PERCENT * n + 99) // 100 + 1


def profile(docs: DataFrame, level: np.ndarray, exact: bool = False) -> DataFrame:
    """doc_id, text_key, n, frequent, digest, prefix, point, packed: the shingle set of each whole text.

    ``digest`` (BLAKE2 of 16 bytes over the set's sorted hashes) identifies the set, ``prefix`` has its rarest
    shingles in the one order that ``level`` and then the hash give, ``frequent`` counts the shingles above
    level 0, ``packed`` is the compressed text.  ``exact`` shows the whole prefix of every set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(level)
    names = ["doc_id", "text_key", "n", "frequent", "digest", "prefix", "point", "packed"]

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in buffers.slices(batches, 500):
            texts = batch.column(1)
            for first, hashes, offsets in buffers.shingle_sets(texts):
                count, sizes = len(offsets) - 1, np.diff(offsets)
                doc, at_level = np.repeat(np.arange(count), sizes), sent.value[_group(hashes)]
                frequent = np.bincount(doc, weights=at_level > 0, minlength=count).astype(np.int64)
                kept = np.where(sizes > 0, prefix_size(sizes), 0)
                kept = kept if exact else np.where(frequent > FREQUENT * sizes, kept, np.minimum(kept, SKETCH))
                ordered = hashes[np.argsort(doc * 64 + at_level, kind="stable")] if frequent.any() else hashes
                rare = ordered[buffers.ragged_positions(offsets[:-1], kept)].view(np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(rare))
                ranges = list(zip(offsets.tolist(), offsets[1:].tolist(), strict=False))
                at = [point(hashes[a:b]) for a, b in ranges]
                digest = [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in ranges]
                packed = [press.compress((texts[first + k].as_py() or "").encode()) for k in range(count)]
                part = [batch.column(c).slice(first, count) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(sizes), pa.array(frequent), pa.array(digest, pa.binary()), prefix, pa.array(at, pa.binary()), pa.array(packed, pa.binary())], names=names)

    return keyed_text(docs).mapInArrow(buffers.tidy(run), "doc_id long, text_key binary, n long, frequent long, digest binary, prefix array<long>, point binary, packed binary")


def _bounded(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and points allow to be linked."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.minimum(points(batch.column("pa").to_pylist()), points(batch.column("pb").to_pylist())).sum(axis=1) >= needed(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(buffers.tidy(run), "a long, b long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by comparing the sets."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()

        def linked(rows):
            packed = {x: t for a, b, ta, tb in rows for x, t in ((a, ta), (b, tb))}
            order, sets = list(packed), {}
            texts_of = pa.array([unpack.decompress(packed[x].as_py()) for x in order], pa.binary()).cast(pa.string())
            # By another hash than the one that found the pair.
            for first, hashes, offsets in buffers.shingle_sets(texts_of, seed=1):
                for k, (lo, hi) in enumerate(zip(offsets, offsets[1:], strict=False)):
                    sets[order[first + k]] = hashes[lo:hi]
            found = []
            for a, b, *_ in rows:
                both = _shared(sets[a], sets[b])
                if both and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                    found.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            rows, size = [], 0
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows.append((a, b, ta, tb))
                size += len(ta.as_buffer()) + len(tb.as_buffer())
                if size >= VERIFY_BYTES:
                    yield linked(rows)
                    rows, size = [], 0
            if rows:
                yield linked(rows)

    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"t{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(buffers.tidy(run), "a long, b long")


def _search(node, root, n, at, asked) -> np.ndarray:
    """(a, b) of all pairs of different components in one neighbourhood that the tree over its entries allows."""
    left, right = np.flatnonzero(asked), np.flatnonzero(~asked)
    tree, out = CountTree(coarse(at[right]), n[right]), [np.zeros((2, 0), np.int64)]
    for a in range(0, len(left), 128):
        q = left[a : a + 128]
        x, y = tree.search(coarse(at[q]), n[q], lambda x, y, q=q: root[q[x]] != root[right[y]])
        x, y = q[x], right[y]
        ok = np.minimum(at[x], at[y]).sum(axis=1) >= needed(n[x], n[y])
        out.append(np.stack([node[x[ok]], node[y[ok]]]))
    return np.concatenate(out, axis=1)


def _leaves(node, root, n, at, asked, starts, sizes) -> np.ndarray:
    """As ``_search`` for many neighbourhoods of one leaf each, all at once; entries come before queries in each."""
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = buffers.ragged_positions(starts, sizes)
    entries = np.bincount(group[~asked[rows]], minlength=len(starts))
    q = rows[asked[rows]]
    own = group[asked[rows]]
    x, y = np.repeat(q, entries[own]), buffers.ragged_positions(starts[own], entries[own])
    ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
    x, y = x[ok], y[ok]
    ok = np.zeros(len(x), bool)
    for a in range(0, len(x), 4096):
        i, j = x[a : a + 4096], y[a : a + 4096]
        ok[a : a + 4096] = np.minimum(at[i], at[j]).sum(axis=1) >= needed(n[i], n[j])
    return np.stack([node[x[ok]], node[y[ok]]])


def _tree_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components inside each neighbourhood (``lead``), found by R-tree search.

    ``members`` has lead, node, root, n, point and stray: whether the set is outside its lead's component.  Any
    pair across components has a stray set, so only those are searched, in a tree over all the members.
    Both sides are split by hash into parts of about BLOCK; a task holds one part of each at a time.
    """
    sizes = members.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_all"), F.ceil(F.sum(F.col("stray").cast("int")) / BLOCK).cast("int").alias("_strays")).where("_strays > 0")
    split = members.join(sizes, "lead")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["lead", "_i", "_j", "asked"]
    columns = [*key, "node", "root", "n", "point"]
    entries = split.withColumns({"asked": F.lit(False), "_j": part("_all")}).withColumn("_i", every("_strays")).select(*columns)
    queries = split.where("stray").withColumns({"asked": F.lit(True), "_i": part("_strays")}).withColumn("_j", every("_all")).select(*columns)

    def found(rows: pa.Table) -> pa.RecordBatch:
        lead, i, j, asked, node, root, n = (rows.column(c).to_numpy() for c in columns[:-1])
        at = points(rows.column("point").to_pylist())
        new = np.append(True, (lead[1:] != lead[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(lead)))
        small = counts <= _LEAF
        out = [_leaves(node, root, n, at, asked, starts[small], counts[small])]
        for a, m in zip(starts[~small], counts[~small], strict=True):
            out.append(_search(*(v[a : a + m] for v in (node, root, n, at, asked))))
        both = np.sort(np.concatenate(out, axis=1), axis=0)
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        # Neighbourhoods come whole and in order; the last one of a batch may go on in the next.
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            keys = [rows.column(c).to_numpy() for c in key[:3]]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = rows.num_rows - int(same[::-1].argmin() if not same.all() else rows.num_rows)
            if cut:
                yield found(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield found(held.combine_chunks())

    return entries.unionByName(queries).repartition(*key[:3]).sortWithinPartitions(*key).mapInArrow(buffers.tidy(run), "a long, b long").distinct()


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, digest of each distinct set; node, root of the sets that are linked with another) of ``profile``'s rows.

    Two linked sets have a shingle in common among their rarest (see ``prefix_size``, SKETCH).  The holders of a
    shingle meet in the neighbourhood of its lead, the holder with the most frequent shingles, which in a
    group of near copies is the least changed.  First every set is compared with its leads; then the sets
    that stayed outside their lead's component are searched for in the neighbourhood's tree.  Where sets show
    their whole prefix, no link between different components is missed; a pair of sets that both show SKETCH
    shingles is missed with the chance told there.  A large group of near copies mostly costs one star.
    """
    distinct = sets.where("n > 0").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "frequent", "prefix", "point")])
    distinct = distinct.withColumn("node", F.monotonically_increasing_id())
    # Rank among holders, and by that the neighbourhood's name: frequent shingles, then a hash.  Were two sets to
    # share a rank, their neighbourhoods would be one, which loses nothing.
    rank = F.shiftleft(32767 - F.least("frequent", F.lit(32767)), 48).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 48) - 1)))
    distinct = stored(distinct.withColumn("rank", rank), "sets")
    records = distinct.select("node", "rank", F.explode("prefix").alias("t"))
    held = records.groupBy("t").agg(F.count("*").alias("_c"), F.min("rank").alias("lead")).where("_c > 1").select("t", "lead")
    near = stored(records.select("t", "node").join(held, "t").select("lead", "node").distinct(), "near")
    used = near.select("node").distinct()
    known = stored(distinct.join(used, "node").select("node", "digest", "rank", "n", "point"), "points")
    texts = stored(sets.select("digest", "packed").join(known.select("node", "digest"), "digest").groupBy("node").agg(F.first("packed").alias("packed")), "texts", "none")
    leads = known.groupBy(F.col("rank").alias("lead")).agg(F.min("node").alias("first"))
    free_driver(sets.sparkSession)
    star = near.join(leads, "lead").where("first <> node").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    found = stored(_verified(_bounded(star, known), texts), "links")
    roots = stored(components(found), "roots")
    lead_root = _rooted(leads.select("lead", F.col("first").alias("node")), roots).select("lead", F.col("root").alias("_r"))
    members = near.join(_rooted(known.select("node", "n", "point"), roots), "node").join(lead_root, "lead").withColumn("stray", F.col("root") != F.col("_r"))
    rest = _verified(_tree_pairs(members), texts)
    linked = components(found.unionByName(rest))
    drop(near, known, texts, found, roots)
    free_driver(sets.sparkSession)
    return distinct, linked


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _placed(docs: DataFrame, exact: bool) -> DataFrame:
    """doc_id, text_key, n, component_id of each row of ``docs``."""
    sets = stored(profile(docs, levels(loads(docs)), exact), "profiles", "none")
    members = stored(sets.select("doc_id", "text_key", "n", "digest"), "members")
    nodes, linked = links(sets)
    roots = stored(_rooted(nodes.select("node", "digest"), linked).select("digest", "root"), "roots")
    drop(sets, nodes)
    placed = members.join(roots, "digest", "left")
    lowest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("_low"))
    return placed.join(lowest, "root", "left").select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("_low")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space in ASCII lower case; a set has the distinct 5-word shingles,
    or the whole sequence of a text with fewer words.  Texts without words have n_shingles 0 and are linked
    with nothing.  component_id is the smallest doc_id reachable over links, the row's own included; null ids
    are smaller than none.  Repeated rows are copies of each other.  Other columns are left out.  Sets are known by
    64-bit hashes of their shingles; a pair is found by one hash and verified by another.  ``exact`` rules out the small
    chance of SKETCH at the price of more candidates: then every link is found for certain, hashes aside.
    """
    return _placed(docs, exact).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` without the documents that a smaller doc_id of their component stands for; columns unchanged.

    Rows with a null id are kept.  Of rows that share the kept id all stay; rows that share an id but not the
    text are judged each by its own text.
    """
    return without(docs, _placed(docs, exact).where("doc_id <> component_id").select("doc_id", "text_key"))
