"""N-gram Jaccard join in the metric space of the Jaccard distance, exact.

Documents are sets of word shingles (64-bit hashes); two link when 100 times the
intersection is at least ``percent`` times the union, that is, when their distance
is at most ``1 - percent / 100``.  Documents with the same set are one point.

1. Shingle frequencies are counted from packed hash arrays.  Two Bloom filters of a
   bounded size, "held by two documents" and "held by many", order the shingles:
   unique, then shared, then frequent ones, then by hash.  Linked points share a
   shingle among the first ``n - ceil(percent * n / 100) + 1`` of either, so a point
   whose first ones are all unique links with nothing and is finished.  (A full
   filter only makes this less selective; the order is the same in every task, and
   that is all that exactness needs.)
2. The smallest point that holds a shingle is its pivot; a point belongs to the
   regions of the pivots of its first shingles.  Linked points meet in a region, and
   a region costs one row a member, however many hold the shingle.
3. A region of more than ``leaf_points`` points is divided again: distances to its
   pivots are taken in parallel, points within the limit of a pivot are linked to it,
   and what is not connected by that goes to the Voronoi cell of its nearest pivot,
   with every point inside the cell's triangle-inequality window (nearest distance
   plus twice the limit, and the limit around the cell's own distances).  Cells are
   divided likewise, ``depth`` times, each with one connected set that is not compared
   within itself; what then is still large is compared in pairs
   of bounded chunks, so no task holds more than a bounded number of sets.
4. A leaf compares each point with those that the triangle inequality leaves, until
   all are connected; it emits one edge a point, never all pairs.  Components of the
   edges give the classes.

Defined cases: null and empty texts, and texts without words, have an empty set and
link with nothing; fewer words than a shingle: the whole sequence is the one
shingle; rows with a null id keep a null component; rows of one id are separate
documents; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import Bits, Lean, by_shard, cuts, groups, partitions, ragged, run_starts, stored
from driftwise.llm.components import components
from driftwise.llm.hashing import blocks, mix, sets, words

WORDS = 5
PERCENT = 80
FREQUENT = 32
FILTER_BITS = 1 << 29
LEAF_POINTS = 2000
PIVOTS = 8
DEPTH = 3
SEND_BYTES = 8 << 20
_U = np.uint64
SETS = "doc {kind}, n long, s1 long, first binary, shingles binary"


# ------------------------------------------------------------ 1. frequencies
def _shingles(batch, n, column="text"):
    for first, last, buf, offsets in blocks(batch[column]):
        hashes, at = words(buf, offsets)
        yield first, last, *sets(hashes, at, n)


def _send(batches, shards, n):
    held, size = [], 0
    for batch in batches:
        for _, _, values, _ in _shingles(batch, n):
            held.append(values)
            size += len(values)
            if size * 8 >= SEND_BYTES:
                yield _packed(np.concatenate(held), shards)
                held, size = [], 0
    if size:
        yield _packed(np.concatenate(held), shards)


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, all first bytes first: those hardly change and compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(_U)


def _packed(keys: np.ndarray, shards: int) -> pa.RecordBatch:
    keys = np.sort(keys)
    runs = run_starts(keys)
    counts = np.minimum(np.diff(np.append(runs, len(keys))), 255).astype(np.uint8)
    keys = keys[runs]
    at = cuts(keys, shards)
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([planes(keys[at[s]:at[s + 1]]) for s in full], pa.binary()),
         pa.array([counts[at[s]:at[s + 1]].tobytes() for s in full], pa.binary())], names=["shard", "keys", "counts"])


def _filters(batches, most_bits, frequent):
    for shard, rows in groups(batches, "shard"):
        keys = np.concatenate([from_planes(r["keys"]) for r in rows])
        counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint8)
        order = np.argsort(keys)
        keys = keys[order]
        runs = run_starts(keys)
        total = np.add.reduceat(counts[order].astype(np.int64), runs)
        keys = keys[runs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([Bits.segment(keys[total >= 2], most_bits)], pa.binary()),
             pa.array([Bits.segment(keys[total >= frequent], most_bits)], pa.binary())], names=["shard", "shared", "frequent"])


def filters(texts: DataFrame, n: int, frequent: int, filter_bits: int) -> tuple[Bits, Bits]:
    spark = texts.sparkSession
    shards = max(4, 4 * partitions(spark))
    sent = texts.select("text").mapInArrow(Lean(_send, shards=shards, n=n), "shard int, keys binary, counts binary")
    made = by_shard(sent, shards).mapInArrow(
        Lean(_filters, most_bits=max(64, filter_bits // shards), frequent=frequent), "shard int, shared binary, frequent binary").collect()
    found = {r["shard"]: r for r in made}
    return tuple(Bits([bytes(found[s][c]) if s in found else bytes(8) for s in range(shards)]) for c in ("shared", "frequent"))


# ------------------------------------------------------------ 2. points and regions
def _points(batches, filters, n, percent):
    shared, frequent = filters.value
    for batch in batches:
        for first, last, values, at in _shingles(batch, n):
            kind = shared.has(values).astype(np.int8)
            some = np.flatnonzero(kind)
            kind[some] += frequent.has(values[some])
            size = np.diff(at)
            full = size > 0
            s1 = np.zeros(len(size), _U)
            if full.any():
                s1[full] = np.add.reduceat(mix(values + np.repeat(size, size).astype(_U) * _U(0x9E3779B97F4A7C15)), at[:-1][full])
            heads, bodies = [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own, k = values[a:b], kind[a:b]
                lead = (b - a) - ((b - a) * percent + 99) // 100 + 1 - int((k == 0).sum())
                if b == a or lead <= 0:
                    heads.append(None)
                    bodies.append(None)
                    continue
                head = own[k == 1][:lead]
                if len(head) < lead:
                    head = np.concatenate([head, own[k == 2][:lead - len(head)]])
                heads.append(head.tobytes())
                bodies.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].slice(first, last - first), pa.array(size, pa.int64()), pa.array(s1.view(np.int64)),
                 pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], names=["doc", "n", "s1", "first", "shingles"])


def _spread(batches):
    for batch in batches:
        keys = [np.frombuffer(x, np.int64) for x in batch["first"].to_pylist()]
        if keys:
            rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch["s1"].take(rows)], names=["key", "p"])


def regions(points: DataFrame) -> DataFrame:
    """(region, p, kind): the members of each region; kind 1, all still to compare."""
    held = points.select("first", "s1").mapInArrow(Lean(_spread), "key long, p long")
    pivots = held.groupBy("key").agg(F.min("p").alias("region"), F.max("p").alias("last")).where("region < last").select("key", "region")
    rows = held.join(pivots, "key").select("region", "p").distinct()
    return rows.withColumn("kind", F.lit(1))


# ------------------------------------------------------------ 4. leaves
def _linked(inter, a, b, percent):
    return 100 * inter >= percent * (a + b - inter)


def leaf_edges(names: np.ndarray, kinds: np.ndarray, shingles: list[np.ndarray], percent: int) -> np.ndarray:
    """For each point the smallest point of its component within the leaf.  Points of
    kind 1 are compared with all; those of kind 2 are known to be connected."""
    n = len(names)
    size = np.array([len(s) for s in shingles])
    at = np.cumsum(size) - size
    flat = np.concatenate(shingles)
    order = np.argsort(flat)
    runs = run_starts(flat[order])
    local = np.empty(len(flat), np.int64)
    local[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(flat))))
    root = np.arange(n)
    if (kinds == 2).any():
        root[kinds == 2] = np.flatnonzero(kinds == 2)[0]
    mark = np.zeros(len(runs), dtype=np.int64)
    limit = 1 - percent / 100 + 1e-9
    near = None  # distances to the first pivot
    todo = np.flatnonzero(kinds == 1).tolist()
    waiting = set(todo)
    queue: list[int] = []
    while waiting and (root != root[0]).any():
        i = next((q for q in iter(lambda: queue.pop() if queue else None, None) if q in waiting), None)
        if i is None:
            while todo[-1] not in waiting:
                todo.pop()
            i = todo.pop()
        waiting.discard(i)
        other = np.flatnonzero(root != root[i]) if near is not None else np.arange(n)
        other = other[(100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))] if near is not None else other
        if near is not None:
            other = other[np.abs(near[other] - near[i]) <= limit]
        if not len(other):
            continue
        mark[local[at[i]:at[i] + size[i]]] = 1
        sums = np.concatenate([[0], np.cumsum(mark[local[ragged(at[other], size[other])]])])
        ends = np.cumsum(size[other])
        inter = sums[ends] - sums[ends - size[other]]
        mark[local[at[i]:at[i] + size[i]]] = 0
        if near is None:
            near = 1 - inter / np.maximum(size + size[i] - inter, 1)
        met = other[_linked(inter, size[i], size[other], percent)]
        for r in np.unique(root[met]):
            root[root == r] = root[i]
        queue += [j for j in met.tolist() if j in waiting]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, names)
    return least[root]


def _leaves(batches, percent):
    for _, rows in groups(batches, "cell"):
        merged: dict[int, dict] = {}
        for r in rows:
            if r["p"] not in merged or r["kind"] > 0:
                merged[r["p"]] = r
        names = np.array(sorted(merged), np.int64)
        if len(names) < 2:
            continue
        picked = [merged[p] for p in names.tolist()]
        kinds = np.array([r["kind"] for r in picked])
        least = leaf_edges(names, kinds, [np.frombuffer(r["shingles"], _U) for r in picked], percent)
        moved = names != least
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(least[moved])], names=["u", "v"])


# ------------------------------------------------------------ 3. Voronoi cells
def _distances(batches, percent):
    """Distance of every point to the pivots of its region, and which it links to."""
    for _, rows in _pivoted(batches):
        pivots, members = rows
        if not pivots:
            continue
        marks = [(r["p"], np.frombuffer(r["shingles"], _U)) for r in sorted(pivots, key=lambda r: r["p"])]
        for batch in members:
            out = []
            for r in batch:
                own = np.frombuffer(r["shingles"], _U)
                dist, mask = [], 0
                for j, (_, pivot) in enumerate(marks):
                    inter = len(np.intersect1d(own, pivot, assume_unique=True))
                    dist.append(1 - inter / (len(own) + len(pivot) - inter))
                    mask |= int(_linked(inter, len(own), len(pivot), percent)) << j
                out.append((r["region"], r["p"], r["kind"], dist, mask, [p for p, _ in marks]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.list_(pa.float64())), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["region", "p", "kind", "dist", "mask", "pivots"])


def _pivoted(batches):
    """(region part, (its pivots, its members in small lists)); pivots sort first."""
    now, pivots, members = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["region"], r["part"])
            if key != now:
                if members:
                    yield now, (pivots, [members])
                now, pivots, members = key, [], []
            if r["is_pivot"]:
                pivots.append(r)
            else:
                members.append(r)
                if len(members) >= 256:
                    yield now, (pivots, [members])
                    members = []
    if members:
        yield now, (pivots, [members])


def _main(pdf):
    """What a cell leaves out of the comparisons: one set of connected points, the largest.
    Either the set that was connected before (``kept``) with the pivots (as bits) that its
    points link to, or a group of pivots alone; nothing connects one with the other, so the
    points of the sets not taken are compared."""
    masks, counts, held = pdf["mask"].to_numpy(), pdf["count"].to_numpy(), pdf["held"].to_numpy()
    left = set(masks[masks > 0].tolist())

    def closed(group):
        while more := [m for m in left if m & group]:
            for m in more:
                group |= m
                left.discard(m)
        return group

    best = closed(int(np.bitwise_or.reduce(masks[held]))) if held.any() else 0
    most, kept = counts[held | ((masks & best) > 0)].sum(), True
    while left:
        group = closed(left.pop())
        size = counts[(masks & group) > 0].sum()
        if size > most:
            best, most, kept = group, size, False
    return pdf.iloc[:1][["region"]].assign(main=best, kept=kept)


def divide(big: DataFrame, points: DataFrame, percent: int, leaf_points: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Edges to pivots, and the cells (region, p, kind) of what they do not connect."""
    limit = 1 - percent / 100
    sizes = big.groupBy("region").agg(F.ceil(F.count("*") / leaf_points).cast("int").alias("parts"))
    order = Window.partitionBy("region").orderBy(F.desc(F.col("kind") == 1), F.xxhash64("p", "region"))
    chosen = (big.withColumn("i", F.row_number().over(order)).where(F.col("i") <= pivots).drop("i")
              .join(sizes, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("is_pivot", F.lit(True)))
    dealt = (big.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")).withColumn("is_pivot", F.lit(False)))
    body = points.select(F.col("s1").alias("p"), "shingles")
    rows = chosen.select("region", "part", "is_pivot", "p", "kind").unionByName(dealt.select("region", "part", "is_pivot", "p", "kind")).join(body, "p")
    spark = big.sparkSession
    sorted_rows = rows.repartition(partitions(spark), "region", "part").sortWithinPartitions("region", "part", F.desc("is_pivot"))
    far = stored(sorted_rows.mapInArrow(Lean(_distances, percent=percent),
                                        "region long, p long, kind int, dist array<double>, mask int, pivots array<long>"), "distances")
    edges = (far.where("mask != 0").select("p", F.posexplode("pivots").alias("j", "q"), "mask")
             .where("(shiftright(mask, j) & 1) = 1 AND p != q").select(F.col("p").alias("u"), F.col("q").alias("v")))
    main = (far.groupBy("region", "mask", (F.col("kind") == 2).alias("held")).count()
            .groupBy("region").applyInPandas(_main, "region long, main int, kept boolean"))
    seen = (far.join(main, "region").withColumn("joined", (F.col("mask").bitwiseAND(F.col("main")) != 0) | (F.col("kept") & (F.col("kind") == 2)))
            .withColumn("least", F.array_min("dist")).withColumn("home", (F.array_position("dist", F.col("least")) - 1).cast("int")))
    active = seen.where("NOT joined AND kind > 0")
    cells = active.groupBy("region", "home").agg(F.min("least").alias("lo"), F.max("least").alias("hi"))
    window = (seen.select("region", "p", "kind", "joined", "least", "home", F.posexplode("dist").alias("j", "d"))
              .where(F.col("d") <= F.col("least") + 2 * limit + 1e-9)
              .join(cells.withColumnRenamed("home", "j"), ["region", "j"])
              .where((F.col("d") >= F.col("lo") - limit - 1e-9) & (F.col("d") <= F.col("hi") + limit + 1e-9)))
    # a connected set that was not taken is compared like any other point
    kind = F.when(F.col("joined"), 2).when((F.col("kind") > 0) & (F.col("j") == F.col("home")), 1).otherwise(0)
    return edges, window.select(F.xxhash64("region", "j", F.lit("cell")).alias("region"), "p", kind.cast("int").alias("kind"))


def links(points: DataFrame, percent: int, leaf_points: int, pivots: int, depth: int) -> DataFrame:
    """Edges (u, v) between points whose components are those of all links."""
    spark = points.sparkSession
    todo = stored(regions(points), "regions")
    small, edges = [], []
    for level in range(depth + 1):
        sizes = todo.groupBy("region").agg(F.count("*").alias("m"), F.max((F.col("kind") == 1).cast("int")).alias("open")).where("m > 1 AND open = 1")
        marked = todo.join(sizes, "region")
        small.append(marked.where(F.col("m") <= leaf_points).select(F.xxhash64("region", F.lit(0)).alias("cell"), "p", "kind"))
        big = marked.where(F.col("m") > leaf_points)
        if big.isEmpty():
            break
        if level == depth:
            parts = F.ceil(F.col("m") * 2 / leaf_points).cast("int")
            chunk = big.withColumn("c", parts).withColumn("a", F.pmod(F.xxhash64("p", F.lit(1)), F.col("c")).cast("int"))
            pairs = chunk.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
            small.append(pairs.select(F.xxhash64("region", F.least("a", "b"), F.greatest("a", "b")).alias("cell"), "p", "kind"))
            break
        found, cells = divide(big.select("region", "p", "kind"), points, percent, leaf_points, pivots)
        edges.append(found)
        todo = stored(cells, "regions")
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.union(more)
    body = points.select(F.col("s1").alias("p"), "shingles")
    dealt = leaves.join(body, "p").repartition(partitions(spark), "cell").sortWithinPartitions("cell")
    out = dealt.mapInArrow(Lean(_leaves, percent=percent), "u long, v long")
    for more in edges:
        out = out.union(more)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT,
         filter_bits: int = FILTER_BITS, leaf_points: int = LEAF_POINTS, pivots: int = PIVOTS, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the
    smallest id that links lead to."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(filters(texts, n, frequent, filter_bits))
    kind = texts.schema["doc"].dataType.simpleString()
    every = stored(texts.mapInArrow(Lean(_points, filters=shared, n=n, percent=percent), SETS.format(kind=kind)), "points")
    open_ = every.where("first IS NOT NULL AND doc IS NOT NULL")
    one = Window.partitionBy("s1").orderBy("doc")
    points = stored(open_.withColumn("i", F.row_number().over(one)).where("i = 1").drop("i"), "distinct-points")
    roots = components(links(points, percent, leaf_points, pivots, depth))
    nodes = every.select("doc", "n", "s1", F.when(F.col("doc").isNotNull() & F.col("first").isNotNull(), F.col("s1")).alias("node"))
    placed = nodes.where("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    classes = placed.select("node", "root").distinct().join(least, "root").select("node", "component_id")
    return (nodes.join(classes, "node", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    gone = join(docs, id_col, **options).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
