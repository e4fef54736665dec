"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

A tree of centroids is fitted on a bounded sample of unit vectors (`sample_rows`), by k-means with BRANCHES centroids at each
node until a node holds LEAF_ROWS of the sample. Every row is then put into the leaf that it descends to. A query walks the
tree through a priority queue of unexplored branches, nearest bound first, and so lists leaves in the order in which they are
worth a visit. How many are visited is calibrated: a bounded set of query vectors is searched exactly, and visits are widened
until the recall of the k nearest reaches `recall`; all leaves are visited if nothing less does. The recall that is reported is
that of further queries, which the visits were not widened for.

Leaves are dealt out as blocks of at most BLOCK_ROWS rows, whatever a leaf holds, and queries of a block in groups of at most
about BLOCK_QUERIES, so a task holds one block and one group. Each returns the best k of its block for each query; these few
are ranked by cosine in double precision, ties by id. A query for which the visited leaves have fewer than k rows is searched
against all rows, in the same blocks.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part
as query or as candidate; a query that is a row of the index is not its own neighbour, but other rows of its id are; rows of one
id are one query each time they stand there and candidates each; a null id comes last among ties, and a query of null id is one
too. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that the tree is fitted on, and vectors that visits are calibrated with, in expectation.
SAMPLE_ROWS = 20_000
CALIBRATION_QUERIES = 128
BRANCHES = 8
LEAF_ROWS = 100
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 4_096
#: Stands in for a null id while rows are ranked: after all others.
NO_ID = 2**63 - 1


@dataclass
class Node:
    centroid: np.ndarray
    children: list[int] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """A hierarchical k-means tree over unit vectors; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 42):
        self.nodes: list[Node] = [Node(sample.mean(axis=0) if len(sample) else np.zeros(1))]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        work = [(0, sample)]
        while work:
            at, rows = work.pop()
            groups = self._split(rows, branches, rng) if len(rows) > leaf_rows else []
            if len(groups) < 2:
                self.nodes[at].leaf, self.leaves = self.leaves, self.leaves + 1
                continue
            for centroid, own in groups:
                self.nodes.append(Node(centroid))
                self.nodes[at].children.append(len(self.nodes) - 1)
                work.append((len(self.nodes) - 1, own))
        self.tables = {i: np.stack([self.nodes[c].centroid for c in n.children]) for i, n in enumerate(self.nodes) if n.children}

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return []
        centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(steps):
            near = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
            used = np.unique(near)
            centres = np.stack([rows[near == c].mean(axis=0) for c in used])
        near = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        return [(centres[c], rows[near == c]) for c in np.unique(near)]

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        out = np.zeros(len(vectors), dtype=np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            at, rows = work.pop()
            node = self.nodes[at]
            if not node.children:
                out[rows] = node.leaf
                continue
            centres = self.tables[at]
            near = np.argmin((centres**2).sum(axis=1) - 2 * vectors[rows] @ centres.T, axis=1)
            work += [(child, rows[near == i]) for i, child in enumerate(node.children) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves in best-bin-first order.

        The queue holds branches not explored yet under the greatest squared distance to a centroid met on the way down to
        them; the least is explored next, down to a leaf.
        """
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            bound, at = heapq.heappop(queue)
            while self.nodes[at].children:
                gaps = ((self.tables[at] - query) ** 2).sum(axis=1)
                order = np.argsort(gaps, kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (max(bound, float(gaps[i])), self.nodes[at].children[i]))
                at, bound = self.nodes[at].children[order[0]], max(bound, float(gaps[order[0]]))
            out.append(self.nodes[at].leaf)
        return out


def _usable(vector: Column) -> Column:
    """Neither null, nor zero, and all components finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(wide, lambda x: x != 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # the largest component first: squares of very large ones overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always added up in the same order: equal vectors get equal scores."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _best_of_block(k: int):
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q_row": pd.Series(dtype="int64"), "vec_row": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(rows) or not len(queries):
            return none
        ids, own, raw = rows["r_id"].to_numpy(np.int64), rows["r_row"].to_numpy(np.int64), np.stack(rows["r_vec"].to_numpy()).astype(np.float64)
        units, parts = _unit(rows["r_vec"]), [none]
        for lo in range(0, len(queries), 512):
            some = queries.iloc[lo : lo + 512]
            near = _unit(some["q_vec"]) @ units.T
            near[some["q_own"].to_numpy(np.int64)[:, None] == own[None, :]] = -np.inf
            kth = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
            # All that might be among the best once scored exactly, ties included; then the best k of these.
            i, j = np.nonzero((near >= kth[:, None] - 1e-9) & (near > -np.inf))
            q = np.stack(some["q_vec"].to_numpy()).astype(np.float64)
            score = np.concatenate([exact_cosine(q[i[s : s + 20_000]], raw[j[s : s + 20_000]]) for s in range(0, len(i), 20_000)] or [np.zeros(0)])
            order = np.lexsort((own[j], ids[j], -score, i))
            rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            take = order[rank < k]
            parts.append(pd.DataFrame({"q_row": some["q_row"].to_numpy()[i[take]], "vec_row": own[j[take]], "vec_id": ids[j[take]], "score": score[take]}))
        return pd.concat(parts, ignore_index=True)

    return best


def _search_blocks(blocks: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """q_row, vec_row, vec_id, score: the best k of each query in the blocks that it visits.

    blocks: leaf, block, row, id, vector. visits: q_row, q_own, q_vec, leaf. Both are dealt out by (leaf, block, group of queries).
    """
    sizes = blocks.groupBy("leaf", "block").agg(F.count("*").alias("rows"))
    asked = visits.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups"))
    # A row for each block and group: few, and told to all tasks. The visits hold a vector each and are many times their table's size,
    # which Spark does not foresee, so they would be broadcast themselves.
    cells = sizes.join(asked.hint("merge"), "leaf")
    parts = cells.select("leaf", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    rows = blocks.join(F.broadcast(parts), ["leaf", "block"])
    spread = F.pmod(F.xxhash64("q_row"), F.col("groups")).cast("int")
    queries = visits.join(F.broadcast(cells.select("leaf", "block", "groups")), "leaf").withColumn("part", spread)
    rows = rows.select("leaf", "block", "part", "row", F.coalesce("id", F.lit(NO_ID)), "vector").toDF("r_leaf", "r_block", "r_part", "r_row", "r_id", "r_vec")
    queries = queries.select("leaf", "block", "part", "q_row", "q_own", "q_vec").toDF("v_leaf", "v_block", "v_part", "q_row", "q_own", "q_vec")
    paired = rows.groupBy("r_leaf", "r_block", "r_part").cogroup(queries.groupBy("v_leaf", "v_block", "v_part"))
    return paired.applyInPandas(_best_of_block(k), "q_row long, vec_row long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("vec_row"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


@dataclass
class Index:
    tree: Tree
    blocks: DataFrame  # leaf, block, row, id, vector
    rows: int


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> Index:
    """An index of vectors(id long, vector array): every usable row is in it."""
    spark = vectors.sparkSession
    usable = vectors.where(_usable(F.col("vector")))
    lengths = usable.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if lengths is None:
        empty = spark.createDataFrame([], "leaf long, block int, row long, id long, vector array<double>")
        return Index(Tree(np.zeros((0, 1))), empty, 0)
    usable = usable.where(F.size("vector") == lengths["w"])
    share = min(1.0, sample_rows / lengths["count"])
    draw = F.pmod(F.xxhash64("id", "vector", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(draw < share).select("vector").toPandas()
    tree = Tree(_unit(sample["vector"]) if len(sample) else np.zeros((0, lengths["w"])), branches, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    @F.pandas_udf("long")
    def leaf_of(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaf_of(_unit(batch)) if len(batch) else [], dtype="int64")

    placed = materialize(usable.select(F.monotonically_increasing_id().alias("row"), "id", "vector", leaf_of("vector").alias("leaf")), "leaves")
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") * 1.0 / block_rows).cast("int").alias("blocks"))
    # A leaf of equal vectors may hold any share of the rows: its blocks are dealt out by a hash of the row.
    dealt = placed.join(F.broadcast(counts), "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    return Index(tree, materialize(dealt.select("leaf", "block", "row", "id", "vector"), "blocks"), lengths["count"])


def _with_visits(index: Index, queries: DataFrame, most: int) -> DataFrame:
    """One row for each leaf that a query visits, with its place in the order of visits."""
    shared = queries.sparkSession.sparkContext.broadcast(index.tree)

    @F.pandas_udf("array<long>")
    def leaves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.visits(q, most) for q in _unit(batch)] if len(batch) else [], dtype=object)

    listed = queries.select("q_row", "q_own", "q_vec", leaves("q_vec").alias("leaves"))
    return listed.select("q_row", "q_own", "q_vec", F.posexplode("leaves").alias("place", "leaf"))


def _all_leaves(index: Index, queries: DataFrame) -> DataFrame:
    return queries.select("q_row", "q_own", "q_vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.tree.leaves - 1).cast("long"))).alias("leaf"))


def calibrate(index: Index, queries: DataFrame, k: int, recall: float, most_queries: int = CALIBRATION_QUERIES) -> tuple[int, float]:
    """The least number of leaf visits with which some of the queries reach the recall, and the recall that others have with it.

    Twice most_queries are searched exactly, in expectation (all, if there are fewer): half of them widen the visits.
    """
    total = queries.count()
    if not total or index.tree.leaves <= 1:
        return index.tree.leaves, 1.0
    draw = F.pmod(F.xxhash64("q_row", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = materialize(queries.where(draw < min(1.0, 2 * most_queries / total)), "calibration")
    exact = _ranked(_search_blocks(index.blocks, _all_leaves(index, sample), k), k)
    # The place at which the tree would have visited the leaf of each true neighbour.
    order = _with_visits(index, sample, index.tree.leaves).select("q_row", "leaf", "place")
    home = exact.join(index.blocks.select(F.col("row").alias("vec_row"), "leaf"), "vec_row")
    widens = F.pmod(F.xxhash64("q_row", F.lit(13)), F.lit(2)) == 0
    found = home.join(order, ["q_row", "leaf"]).select("place", widens.alias("widens")).collect()  # 2 * most_queries * k
    places = sorted(r.place for r in found if r.widens)
    others = [r.place for r in found if not r.widens] or places
    if not places:
        return index.tree.leaves, 1.0
    need = places[min(len(places), int(np.ceil(recall * len(places)))) - 1] + 1
    return need, sum(p < need for p in others) / len(others)


def search(index: Index, queries: DataFrame, k: int = 5, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of queries(id, vector).

    Queries that are rows of the index are taken from index.blocks, so that they have its `row`.
    """
    return search_and_recall(index, queries, k, recall)[0]


def search_and_recall(index: Index, queries: DataFrame, k: int = 5, recall: float = 0.97) -> tuple[DataFrame, float]:
    """What search returns, and the recall of queries that were searched exactly beside those that the visits were widened for."""
    width = index.tree.nodes[0].centroid.shape[0]
    usable = queries.where(_usable(F.col("vector")) & (F.size("vector") == width))
    own = F.col("row") if "row" in queries.columns else F.lit(-1)
    numbered = materialize(usable.select(F.monotonically_increasing_id().alias("q_row"), own.cast("long").alias("q_own"), F.col("id").alias("q_id"), F.col("vector").alias("q_vec")), "queries")
    if not index.rows:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 1.0
    most, reached = calibrate(index, numbered, k, recall)
    found = materialize(_search_blocks(index.blocks, _with_visits(index, numbered, most), k), "found")
    full = found.groupBy("q_row").count().where(F.col("count") >= k).select("q_row")
    short = materialize(numbered.join(full, "q_row", "left_anti"), "short")
    if short.limit(1).count():
        again = materialize(_search_blocks(index.blocks, _all_leaves(index, short), k), "again")
        found = found.join(short.select("q_row"), "q_row", "left_anti").union(again)
    best = _ranked(found, k).join(numbered.select("q_row", F.col("q_id").alias("query_id")), "q_row")
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"), reached
