"""Exact top-k by inner product with KD-trees per shard.

Shards are regions of space: the top median splits are fitted to a bounded sample of
vectors (SAMPLE of them at most, by a hash), every vector is dealt by them, and a
region of more than twice SHARD_ROWS vectors is dealt on by a hash. A shard becomes
one KD-tree: median splits on the widest dimension down to leaves, each node with a
tight bounding box; the tree travels as one row, and is copied only to the blocks of
queries that need it. In a tree a query takes nodes best first, by the largest inner
product that any point of the node's box could have, and stops at the first below
its k-th score. Two rounds: each query searches the shard of its best bound, then,
knowing its k-th score so far, only the shards whose root could beat or equal it.

Of one vector that many rows hold, only the k + 1 smallest ids are searched: no
other can be among the k best of any query.

Components become floor(scale * x) in integers. Products are summed in doubles
where every sum stays below 2**53, else as Python integers, so scores are exact;
scores beyond 64 bits are held at the largest long.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part, nor do rows without id; only vectors of equal length meet, whatever that
is; rows that repeat an id and a vector count once; an id with several vectors stands for each (no
row is a candidate of its own id); ties go to the smaller
id; fewer candidates than k give all; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.tables import settle

SCALE = 256
K = 5
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
LEAF = 128
SAMPLE = 16_384
#: Roots are broadcast for choosing shards up to so many numbers; beyond, every query searches every shard.
ROOT_VALUES = 8_000_000
BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
TREE = "dim int, shard long, ids binary, points binary, boxes binary, nodes binary"
TREE_ARROW = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("points", pa.binary()), ("boxes", pa.binary()), ("nodes", pa.binary())])
LONGEST = 2**63 - 1


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v) with v = floor(scale * x) as doubles, without vectors that take no part."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good).select(
        "vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def matrix(group: pa.Table, dim: int) -> np.ndarray:
    flat = group["v"].combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy().reshape(group.num_rows, dim)


def top_splits(points: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, left, right) of about parts regions; a child below 0 is the region -1 - child."""
    nodes: list[list] = []
    regions = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal regions
        own = points[rows]
        axis = int((own.max(0) - own.min(0)).argmax()) if len(rows) and points.shape[1] else 0
        if parts > 1 and len(rows) > 1 and points.shape[1]:
            cut = float(np.partition(own[:, axis], len(rows) // 2)[len(rows) // 2])
            low = own[:, axis] < cut
            if low.any() and not low.all():
                at = len(nodes)
                nodes.append([axis, cut, 0, 0])
                nodes[at][2] = grow(rows[low], parts // 2)
                nodes[at][3] = grow(rows[~low], parts - parts // 2)
                return at
        regions += 1
        return -regions

    root = grow(np.arange(len(points)), parts)
    return [tuple(n) for n in nodes] if root >= 0 else []


def regions_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1, np.int64)
    while (open_ := np.flatnonzero(at >= 0)).size:
        for node in np.unique(at[open_]):
            rows = open_[at[open_] == node]
            axis, cut, left, right = nodes[node]
            at[rows] = np.where(points[rows, axis] < cut, left, right)
    return -1 - at


def grow_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of points, boxes (nodes, 2, dim) and nodes (start, end, left, right) of a KD-tree; leaves have no children (-1)."""
    order, boxes, nodes = np.arange(len(points)), [], []
    open_ = [(0, len(points), -1, 0)]
    while open_:
        start, end, parent, side = open_.pop()
        own = points[order[start:end]]
        boxes.append(np.stack([own.min(0), own.max(0)]) if points.shape[1] else np.zeros((2, 0)))
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        nodes.append([start, end, -1, -1])
        if end - start > leaf and points.shape[1]:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, (boxes[-1][1] - boxes[-1][0]).argmax()], half)]
            me = len(nodes) - 1
            open_ += [(start + half, end, me, 3), (start, start + half, me, 2)]
    return order, np.array(boxes), np.array(nodes, np.int64)


def pack_tree(group: pa.Table) -> pa.Table:
    dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
    ids, points = group["vec_id"].to_numpy(), matrix(group, dim)
    order, boxes, nodes = grow_tree(points)
    row = [dim, shard, ids[order].tobytes(), points[order].tobytes(), boxes.tobytes(), nodes.tobytes()]
    return pa.table([[x] for x in row], schema=TREE_ARROW)


def bounds(q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The largest product of one query with any point of each box, with room for rounding."""
    slack = 1e-9 * (np.abs(q) @ np.abs(boxes).max(1).T) + 0.5
    return np.maximum(q, 0) @ boxes[:, 1].T + np.minimum(q, 0) @ boxes[:, 0].T + slack


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held inside a long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q @ p.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q], object).reshape(len(q), len(p))
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


def search(q: np.ndarray, q_id: int, p: np.ndarray, p_ids: np.ndarray, boxes: np.ndarray, nodes: np.ndarray, kth: float, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k best of one tree that can matter beside the k-th score known so far."""
    best: list[tuple[int, int]] = []
    heap = [(-float(bounds(q, boxes[:1])[0]), 0)]
    while heap and -heap[0][0] >= kth:
        start, end, left, right = nodes[heapq.heappop(heap)[1]]
        if left >= 0:
            for child, bound in zip((left, right), bounds(q, boxes[[left, right]]), strict=True):
                if bound >= kth:
                    heapq.heappush(heap, (-float(bound), int(child)))
            continue
        score, own = products(q[None], p[start:end])[0], p_ids[start:end]
        near = np.flatnonzero((score >= kth) & (own != q_id))
        if len(near):
            if len(near) > k:
                near = near[np.lexsort((own[near], -score[near]))[:k]]
            best = sorted(best + list(zip((-score[near]).tolist(), own[near].tolist(), strict=True)))[:k]
            if len(best) == k:
                kth = max(kth, -best[-1][0])
    return best


def sharded(points: DataFrame, shard_rows: int) -> DataFrame:
    """points with shard: the region of space that holds a vector, large ones dealt on by a hash."""
    n = points.count()
    sample = points.where(F.pmod(F.xxhash64("v"), F.lit(1 + n // SAMPLE)) == 0).select("dim", "v").toArrow()
    sizes = sample["dim"].to_numpy()
    splits = {int(d): top_splits(matrix(sample.filter(pa.array(sizes == d)), int(d)), 1 + n // shard_rows) for d in np.unique(sizes)}

    def place(batches):
        for batch in batches:
            dims, region = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                region[rows] = regions_of(matrix(pa.Table.from_batches([batch.take(pa.array(rows))]), int(d)), splits.get(int(d), []))
            yield batch.append_column("region", pa.array(region))

    dealt = points.mapInArrow(place, "vec_id long, dim int, v array<double>, region long")
    counts = dealt.groupBy("dim", "region").agg((1 + F.floor(F.count("*") / (2 * shard_rows))).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return dealt.join(counts, ["dim", "region"]).select("vec_id", "dim", "v", (F.col("region") * 2**32 + part).alias("shard"))


def searched(wanted: DataFrame, trees: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best in each shard for wanted (query_id, dim, v, kth, shard); a block of queries meets a tree in one task."""
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    needed = wanted.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
    copies = needed.join(trees.withColumnsRenamed({"dim": "d", "shard": "s"}), ["d", "s"])

    def meet(queries: pa.Table, tree: pa.Table) -> pa.Table:
        if not queries.num_rows or not tree.num_rows:
            return BEST.empty_table()
        dim = queries["dim"][0].as_py()
        ids, nodes = (np.frombuffer(tree[c][0].as_py(), np.int64) for c in ("ids", "nodes"))
        nodes = nodes.reshape(-1, 4)
        p, boxes = np.frombuffer(tree["points"][0].as_py()).reshape(len(ids), dim), np.frombuffer(tree["boxes"][0].as_py()).reshape(len(nodes), 2, dim)
        found = []
        for q, q_id, kth in zip(matrix(queries, dim), queries["query_id"].to_pylist(), queries["kth"].to_pylist(), strict=True):
            found += [(q_id, v, -s) for s, v in search(q, q_id, p, ids, boxes, nodes, kth, k)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], schema=BEST)

    return wanted.groupBy("dim", "shard", "block").cogroup(copies.groupBy("d", "s", "b")).applyInArrow(meet, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors that is_query marks, against all other rows."""
    every = whole(vectors, scale)
    asked = settle(every.where(is_query).distinct().withColumnRenamed("vec_id", "query_id"))
    same = Window.partitionBy("dim", "v").orderBy("vec_id")
    points = settle(every.distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"))
    trees = settle(sharded(points, shard_rows).groupBy("dim", "shard").applyInArrow(pack_tree, TREE))
    blocks = 1 + asked.count() // block_queries
    dims = trees.groupBy("dim").agg(F.count("*").alias("n")).collect()
    if sum(2 * r["n"] * max(1, r["dim"]) for r in dims) > ROOT_VALUES:
        shards = trees.select("dim", "shard")
        found = searched(asked.withColumn("kth", F.lit(float("-inf"))).join(shards, "dim"), trees, blocks, k)
    else:
        roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in dims:
            own = trees.where(F.col("dim") == r["dim"]).select("shard", F.expr(f"substring(boxes, 1, {16 * r['dim']})").alias("box")).toArrow()
            roots[r["dim"]] = own["shard"].to_numpy(), np.array([np.frombuffer(b.as_py() or b"") for b in own["box"]]).reshape(own.num_rows, 2, r["dim"])

        def choose(first: bool):
            def shards_of(batches):
                for batch in batches:
                    picks = []
                    for dim, v, kth in zip(batch.column("dim").to_pylist(), batch.column("v"), batch.column("kth").to_pylist(), strict=True):
                        shards, boxes = roots[dim]
                        b = bounds(v.values.to_numpy(), boxes)
                        best = int(b.argmax())
                        picks.append([shards[best]] if first else shards[(b >= kth) & (np.arange(len(b)) != best)])
                    yield batch.append_column("shards", pa.array(picks, pa.list_(pa.int64())))

            return shards_of

        columns = "query_id long, dim int, v array<double>, kth double, shards array<long>"
        pick = lambda rows, first: rows.mapInArrow(choose(first), columns).withColumn("shard", F.explode("shards")).drop("shards")
        near = settle(searched(pick(asked.withColumn("kth", F.lit(float("-inf"))), True), trees, blocks, k))
        # an id with several vectors has the k-th score of all of them
        kth = near.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_n") == k).select("query_id", F.col("score").cast("double").alias("kth"))
        known = asked.join(kth, "query_id", "left").select("query_id", "dim", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
        found = near.unionByName(searched(pick(known, False), trees, blocks, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
