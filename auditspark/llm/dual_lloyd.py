"""Centroid clustering by Lloyd's rounds, each a dual-tree search for nearest centroids.

Vectors become whole numbers, floor(scale * x), so distances, sums and means are exact and do not depend on how rows are dealt out.
They are packed into blocks where they stand, without a shuffle, and a cover tree is built over each block, once for all rounds: a
node's points lie within its radius of its centre, its children's centres are further than half of that from each other, and a
node's own centre is its first child's. In a round a second cover tree is built over the centroids. Pairs of a vector node and a
centroid node are refined together, always the node of the greater radius. For a vector node, the distance of its centre to the
nearest centre of a paired centroid node plus its own radius bounds how far its vectors can be from their centroid; a pair whose
centres are further apart than that by more than both radii is pruned. A node that is left with one centroid goes to it whole, by
the sums that are kept for each subtree; leaf pairs are compared exactly, ties to the smaller number.

Each task returns one row of sums for each centroid, whatever it reads; these are added up by centroid and component. What comes to
the driver, and goes to the tasks, are k centroids: k is a parameter and does not grow with the data.

Defined cases: vectors that are null, of another length than `width`, or hold a null or non-finite component take no part, nor do
those with a component of more than LARGEST, since a squared distance would not fit a long. Copies are vectors each, and one point of a tree. Vectors
of null id are assigned as others, but start no centroid as long as others can. Of vectors of one id, which hash alike, the one whose components are less starts a centroid
first. Fewer vectors than k: as many centroids. None: no rows. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vector, materialize

SCALE = 256
#: Of a whole component: 64 squared differences of twice as much fit a long.
LARGEST = 2**27
BLOCK_ROWS = 2_048
LEAF_POINTS = 8
#: Pairs whose distances are computed at once.
PAIRS_AT_ONCE = 50_000
BLOCKS = "ids array<long>, points binary, nodes binary"


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, with x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, width: int | None, scale: int = SCALE, largest: int = LARGEST) -> DataFrame:
    """id, v: whole numbers of the vectors that take part."""
    used = finite_vector(F.col(vector_column)) & (F.lit(True) if width is None else F.size(vector_column) == width)
    small = F.forall(F.col(vector_column), lambda x: F.abs(x.cast("double")) < F.lit(largest / scale))
    return df.where(used & small).select(F.col(id_column).alias("id"), whole(F.col(vector_column), scale).alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def all_squared(a: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to each other."""
    most = int(np.abs(a).max(initial=0))
    if a.shape[1] * (2 * most) ** 2 < 2**53:  # exact in floating point
        w = a.astype(np.float64)
        n = (w * w).sum(axis=1)
        return (n[:, None] + n[None, :] - 2 * (w @ w.T)).astype(np.int64)
    return np.stack([squared(a, row[None, :]) for row in a])


@dataclass
class CoverTree:
    """Nodes in rows: place of the centre, first and end of its points, first and end of its children (none: a leaf).

    points are in the order of the leaves, order tells the row that each was; radius is that of each node's points.
    """

    points: np.ndarray
    order: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray


def build_tree(rows: np.ndarray, leaf_points: int = LEAF_POINTS) -> CoverTree:
    """A cover tree over rows of whole numbers."""
    n = len(rows)
    far = all_squared(rows)
    # A node is made with its points listed; children are added behind, so a node's children stand together.
    members, centres, kids = [np.arange(n)], [0], [(0, 0)]
    at = 0
    while at < len(members):
        own, centre = members[at], centres[at]
        reach = far[centre, own]
        most = int(reach.max(initial=0))
        if len(own) > leaf_points and most:
            left, chosen = np.ones(len(own), dtype=bool), []
            limit = most / 4  # half of the radius, squared
            nearest = np.full(len(own), np.iinfo(np.int64).max)
            home = np.zeros(len(own), dtype=np.int64)
            head = int(np.flatnonzero(own == centre)[0])
            while True:
                gap = far[own[head], own]
                closer = gap < nearest
                nearest[closer], home[closer] = gap[closer], len(chosen)
                chosen.append(own[head])
                left &= gap > limit
                if not left.any():
                    break
                head = int(np.argmax(left))
            # Children of one point each would be nodes for nothing: they stay together as one leaf.
            size = np.bincount(home, minlength=len(chosen))
            alone = own[size[home] == 1]
            begin = len(members)
            for c in np.flatnonzero(size > 1):
                members.append(own[home == c])
                centres.append(int(chosen[c]))
                kids.append((0, 0))
            if len(alone):
                members.append(alone)
                centres.append(int(centre if centre in alone else alone[0]))
                kids.append((0, 0))
            if len(members) - begin == 1:  # all points are alone: a leaf, however many there are
                del members[begin:], centres[begin:], kids[begin:]
            else:
                kids[at] = (begin, len(members))
        at += 1
    # Points in the order of the leaves.
    span, order, stack = [(0, 0)] * len(members), [], [(0, False)]
    count = 0
    begun = [0] * len(members)
    while stack:
        at, done = stack.pop()
        first, end = kids[at]
        if done:
            span[at] = (begun[at], count)
        elif first == end:
            span[at] = (count, count + len(members[at]))
            order.append(members[at])
            count += len(members[at])
        else:
            begun[at] = count
            stack.append((at, True))
            stack += [(c, False) for c in range(end - 1, first - 1, -1)]
    order = np.concatenate(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    nodes = np.array([(place[c], *span[i], *kids[i]) for i, c in enumerate(centres)], dtype=np.int64)
    radius = np.array([np.sqrt(float(far[c, m].max())) for c, m in zip(centres, members)])
    return CoverTree(rows[order], order, nodes, radius)


def _expand(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: which of them, and the numbers in it, one after another."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def nearest_centroids(tree: CoverTree, centroid_tree: CoverTree, count: dict | None = None) -> np.ndarray:
    """The number of the nearest centroid of each of tree.points, ties to the smaller. count: gets the distances computed."""
    at, radius, c_at, c_radius = tree.nodes, tree.radius, centroid_tree.nodes, centroid_tree.radius
    number = centroid_tree.order  # of a centroid, by its place
    out = np.full(len(tree.points), -1, dtype=np.int64)
    work = [(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    told = 0

    def gaps(places: np.ndarray, c_places: np.ndarray) -> np.ndarray:
        nonlocal told
        told += len(places)
        lots = range(0, len(places), PAIRS_AT_ONCE)
        return np.concatenate([squared(tree.points[places[i : i + PAIRS_AT_ONCE]], centroid_tree.points[c_places[i : i + PAIRS_AT_ONCE]]) for i in lots] or [np.zeros(0, dtype=np.int64)])

    def settle(first: np.ndarray, end: np.ndarray, who: np.ndarray) -> None:
        which, place = _expand(first, end)
        out[place] = who[which]

    while work:
        q, r = work.pop()  # pairs of a vector node and a centroid node, all of a vector node together and ascending
        gap = np.sqrt(gaps(at[q, 0], c_at[r, 0]).astype(np.float64))
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.append(begin, len(q)))
        bound = np.repeat(np.minimum.reduceat(gap, begin) + radius[q[begin]], size)
        keep = gap - radius[q] - c_radius[r] <= bound * (1 + 1e-12) + 1e-9
        q, r = q[keep], r[keep]
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.append(begin, len(q)))
        leaf_r = c_at[r, 2] - c_at[r, 1] == 1
        # One centroid left: the whole node is its.
        one = (size == 1) & leaf_r[begin]
        settle(at[q[begin[one]], 1], at[q[begin[one]], 2], number[c_at[r[begin[one]], 1]])
        live = np.repeat(~one, size)
        q, r, leaf_r = q[live], r[live], leaf_r[live]
        if not len(q):
            continue
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.append(begin, len(q)))
        wide = np.repeat(np.maximum.reduceat(np.where(leaf_r, -1.0, c_radius[r]), begin), size)
        q_leaf = at[q, 3] == at[q, 4]
        # The centroid nodes are opened where the widest is wider than the vector node, or that is a leaf.
        open_r = (wide >= 0) & (q_leaf | (wide > radius[q]))
        exact = q_leaf & (wide < 0)
        if exact.any():
            _exact(tree, centroid_tree, q[exact], r[exact], gaps, out)
        for part in (open_r, ~open_r & ~exact):
            if not part.any():
                continue
            a, b = q[part], r[part]
            if part is open_r:
                inner = ~leaf_r[part]
                leaf = c_at[b, 3] == c_at[b, 4]
                # A centroid node without children but with several centroids gives one pair for each: the tree is built with leaves of one.
                which, child = _expand(np.where(inner & ~leaf, c_at[b, 3], b), np.where(inner & ~leaf, c_at[b, 4], b + 1))
                work.append((a[which], child))
            else:
                which, child = _expand(at[a, 3], at[a, 4])
                order = np.lexsort((b[which], child))
                work.append((child[order], b[which][order]))
    if count is not None:
        count["distances"] = count.get("distances", 0) + told
    return out


def _exact(tree: CoverTree, centroid_tree: CoverTree, q: np.ndarray, r: np.ndarray, gaps, out: np.ndarray) -> None:
    """Leaves against single centroids, every pair; a leaf of radius 0 is one point."""
    at, number = tree.nodes, centroid_tree.order
    same = tree.radius[q] == 0
    which, place = _expand(at[q, 1], np.where(same, at[q, 1] + 1, at[q, 2]))
    who = number[centroid_tree.nodes[r[which], 1]]
    gap = gaps(place, centroid_tree.nodes[r[which], 1])
    order = np.lexsort((who, gap, place))
    first = order[np.concatenate(([True], place[order][1:] != place[order][:-1]))]
    end = np.where(same[which[first]], at[q[which[first]], 2], place[first] + 1)
    i, p = _expand(place[first], end)
    out[p] = who[first][i]


def build_centroid_tree(centroids: np.ndarray) -> CoverTree:
    """Every centroid is a leaf of its own; copies too."""
    tree = build_tree(centroids, leaf_points=1)
    nodes, radius = tree.nodes.tolist(), tree.radius.tolist()
    for i in range(len(nodes)):  # a leaf of several gets a child for each
        _, first, end, kid, kid_end = nodes[i]
        if kid == kid_end and end - first > 1:
            nodes[i][3:] = [len(nodes), len(nodes) + end - first]
            nodes += [[p, p, p + 1, 0, 0] for p in range(first, end)]
            radius += [0.0] * (end - first)
    return CoverTree(tree.points, tree.order, np.array(nodes, dtype=np.int64), np.array(radius))


def _pack(width: int, block_rows: int):
    """From (id, v) to a row for each block of rows: ids in the order of the points, the points, and the tree's nodes."""

    def packed(ids: list, v: list) -> pa.RecordBatch:
        tree = build_tree(np.concatenate(v).reshape(-1, width))
        nodes = np.concatenate((tree.nodes, tree.radius.view(np.int64)[:, None]), axis=1)
        own = pa.concat_arrays(ids).take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([tree.points.tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())], names=["ids", "points", "nodes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                ids.append(part.column(0))
                v.append(part.column(1).flatten().to_numpy(zero_copy_only=False))
                held += part.num_rows
                if held >= block_rows:
                    yield packed(ids, v)
                    ids, v, held = [], [], 0
        if held:
            yield packed(ids, v)

    return pack


def _unpack(ids, points: bytes, nodes: bytes, width: int) -> CoverTree:
    table = np.frombuffer(nodes, dtype=np.int64).reshape(-1, 6)
    return CoverTree(np.frombuffer(points, dtype=np.int64).reshape(-1, width), np.arange(len(ids)), table[:, :5], table[:, 5].copy().view(np.float64))


def _trees(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0)[i].values
            yield ids, _unpack(ids, batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), width)


def _round(centroids: np.ndarray):
    """From blocks to (cluster, n, sums): one row for each centroid and task."""
    k, width = centroids.shape
    c_tree = build_centroid_tree(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), [[0] * width for _ in range(k)]
        for _, tree in _trees(batches, width):
            who = nearest_centroids(tree, c_tree)
            order = np.argsort(who, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], who[order][1:] != who[order][:-1])))
            part = np.add.reduceat(tree.points[order], begin, axis=0)
            for c, s in zip(who[order][begin], part.tolist()):
                total[c] = [x + y for x, y in zip(total[c], s)]
            n += np.bincount(who, minlength=k)
        used = np.flatnonzero(n)
        names = ["cluster", "n", "sums"]
        told = [[str(x) for x in total[c]] for c in used]  # sums of a task may be beyond a long
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(told, pa.list_(pa.string()))], names=names)

    return sums


def _assigned(centroids: np.ndarray):
    """From blocks to (id, cluster, distance)."""
    c_tree, width = build_centroid_tree(centroids), centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, width):
            who = nearest_centroids(tree, c_tree)
            yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(squared(tree.points, centroids[who]), pa.int64())], names=["id", "cluster", "distance"])

    return rows


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of `seed:id`, in the order of the hash."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(told.asc_nulls_last(), F.col("v")).select("v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def pack_blocks(vectors: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows with their cover trees, written once: all rounds read them."""
    return materialize(vectors.mapInArrow(_pack(width, block_rows), BLOCKS), "trees")


def lloyd_round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each component; a centroid without vectors stays as it is."""
    parts = blocks.mapInArrow(_round(centroids), "cluster int, n long, sums array<string>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    after = centroids.copy()
    for row in total.collect():  # k * width rows
        after[row.cluster, row["at"]] = int(row.s) // int(row.n)
    return after


def cluster(spark: SparkSession, vectors: DataFrame, width: int, k: int = 40, rounds: int = 5, seed: int = 2, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of each of vectors(id long, v array<long>), and the centroids."""
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, width), dtype=np.int64)
    blocks = pack_blocks(vectors, width, block_rows)
    for _ in range(rounds):
        centroids = lloyd_round(blocks, centroids)
    return materialize(blocks.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance, the sums of distances over the cluster and over all, and a digest of the cluster's centroid."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fit = lambda x: x if x < 2**63 else None
    total = fit(sum(sums.values()))
    rows = [(c, fit(s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    told = spark.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("c")).drop("c")
