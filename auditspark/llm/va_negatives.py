"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells (at quantiles of a bounded sample, the outer cells reaching to the least and greatest value of all
rows), and a row is approximated by one byte a dimension. A cell's middle and half width stand in a table; looked up for a row they
bound its inner product with an anchor a from both sides: a . middle -+ |a| . half. Blocks of approximations meet groups of anchors, each
pair of them in one place once, and return only rows that may be among those asked for:

- positives: rows of the anchor's label whose upper bound is not below the k-th greatest lower bound of such rows;
- negatives, for each positive: rows of other labels whose bounds meet the window that the positive's score opens, and whose upper
  bound is not below the n-th greatest lower bound of the rows that lie in the window surely.

The bounds are compared within a block first, and then among all that an anchor gets from all blocks. Only what is left is joined
with the vectors and scored exactly, in whole numbers. All pairs of an anchor and a block are looked at, as the anchors are a given
set of queries; no pairs are returned but the candidates. Of rows that are equal in label and vector only the first few by id are candidates: no
more than that can be among the best of any anchor.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor those with a component so
large that a hundred times a score would not fit a long. A shorter vector counts as if filled with zeros, an empty one too. Rows of one id are different rows:
ties between them go to the one with the lesser label and vector, and each is an anchor of its own, under the same id. Fewer positives or
negatives than asked for: all of them; an anchor without positives, or a positive whose window is empty, has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
#: Of a dimension, at most; a cell's number is one byte.
CELLS = 256
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 4_096
GROUP_ANCHORS = 1_024
#: Scores of anchors with rows that are held at once.
SCORES_AT_ONCE = 1 << 21
WINDOW = (50, 95)


@dataclass
class Cells:
    """For each dimension the upper edges of all cells but the last, and the middle and half width of each cell."""

    edges: list[np.ndarray]
    middle: np.ndarray
    half: np.ndarray

    @property
    def width(self) -> int:
        return len(self.edges)

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, d], side="left") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def bounds_of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of each dimension of each row."""
        at = np.arange(self.width)
        return self.middle[at, cells], self.half[at, cells]


def make_cells(sample: np.ndarray, least: np.ndarray, greatest: np.ndarray, cells: int = CELLS) -> Cells:
    """Cells at the quantiles of sample; between them all values from least to greatest. Values outside the sample have cells of
    their own, so that one far value does not widen the cell of many."""
    edges, middle, half = [], [], []
    for d in range(len(least)):
        cut = np.zeros(0, dtype=np.int64)
        if cells >= 4 and len(sample):
            inner = np.quantile(sample[:, d], np.linspace(0, 1, cells - 1)[1:-1], method="lower")
            cut = np.unique(np.concatenate(([sample[:, d].min() - 1], inner, [sample[:, d].max()])))
        cut = cut[(cut >= least[d]) & (cut < greatest[d])].astype(np.int64)
        low, high = np.concatenate(([least[d]], cut + 1)), np.concatenate((cut, [greatest[d]]))
        fill = cells - len(low)
        edges.append(cut)
        middle.append(np.concatenate(((low + high) / 2, np.zeros(fill))))
        half.append(np.concatenate(((high - low) / 2, np.zeros(fill))))
    return Cells(edges, np.array(middle), np.array(half))


def _whole(vector: Column, width: int) -> Column:
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def _padded(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pack_blocks(cells: Cells, block_rows: int):
    """From (row, label, v) to blocks: rows, labels, approximations; rows of one label stand together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            row, label, code = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(label, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in (row, label, code)], names=["rows", "labels", "cells"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), cells.of(_padded(part, 2, cells.width))))
                if sum(len(x[0]) for x in held) >= block_rows:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return pack


def _pack_anchors(width: int, group: int, windows: bool):
    """From (row, label, v), or (row, label, v, positives, lows, highs), to groups of anchors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, group):
                part = batch.slice(lo, group)
                out = [part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), _padded(part, 2, width).tobytes()]
                out += [[x.to_numpy(zero_copy_only=False).tobytes() for x in (part.column(i).flatten() for i in (3, 4, 5))] + [np.diff(part.column(3).offsets.to_numpy()).tobytes()]] if windows else []
                names = ["a_rows", "a_labels", "a_vectors"] + (["windows"] if windows else [])
                kinds = [pa.binary()] * 3 + ([pa.list_(pa.binary())] if windows else [])
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names=names)

    return pack


def kth_greatest(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row; -inf where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def score_bounds(anchors: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of anchors with rows."""
    a = anchors.astype(np.float64)
    centre, off = a @ middle.T, np.abs(a) @ half.T
    # Rounding: none for components below 2**22; else by the size of what was added up.
    size = np.abs(a).max(initial=0) * (np.abs(middle) + half).max(initial=0) * a.shape[1]
    slack = 0.0 if size < 2**51 else size * a.shape[1] * 2.0**-52
    return centre - off - slack, centre + off + slack


def _lots(n_anchors: int, n_rows: int):
    step = max(1, SCORES_AT_ONCE // max(1, n_rows))
    return [(i, min(n_anchors, i + step)) for i in range(0, n_anchors, step)]


def positive_candidates(anchor_rows, anchor_labels, anchors, rows, labels, cells: np.ndarray, table: Cells, k: int):
    """anchor, row, low, high: rows of the anchor's label that may be among its k best of the block."""
    out = []
    for label in np.intersect1d(anchor_labels, labels):
        own, there = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        middle, half = table.bounds_of(cells[there])
        for lo, hi in _lots(len(own), len(there)):
            low, high = score_bounds(anchors[own[lo:hi]], middle, half)
            self = anchor_rows[own[lo:hi], None] == rows[None, there]
            low[self] = high[self] = -np.inf
            i, j = np.nonzero((high >= kth_greatest(low, k)[:, None]) & (high > -np.inf))
            out.append((anchor_rows[own[lo + i]], rows[there[j]], low[i, j], high[i, j]))
    return out


def negative_candidates(anchor_labels, anchors, windows, rows, labels, cells, table: Cells, n: int):
    """positive's place, row, low, high: rows of other labels that may be among the n best in the window. windows: for each anchor
    its positives' places in a list of all, and the least and greatest score of each."""
    middle, half = table.bounds_of(cells)
    places, anchor_of, least, most = windows
    out = []
    begin = np.searchsorted(anchor_of, np.arange(len(anchors) + 1))
    for lo, hi in _lots(len(anchors), len(rows)):
        low, high = score_bounds(anchors[lo:hi], middle, half)
        same = anchor_labels[lo:hi, None] == labels[None, :]
        low[same] = high[same] = -np.inf
        for m in range(int((begin[lo + 1 : hi + 1] - begin[lo:hi]).max(initial=0))):
            # The m-th window of each anchor that has as many.
            have = np.flatnonzero(begin[lo + 1 : hi + 1] - begin[lo:hi] > m)
            w = begin[lo + have] + m
            x, y = low[have], high[have]
            floor, top = least[w][:, None], most[w][:, None]
            sure = kth_greatest(np.where((x >= floor) & (y <= top), x, -np.inf), n)[:, None]
            i, j = np.nonzero((y >= np.maximum(floor, sure)) & (x <= top) & (y > -np.inf))
            out.append((places[w[i]], rows[j], x[i, j], y[i, j]))
    return out


def _found(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 4
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, kind in zip(columns, kinds)], names=names)


def _read(batch: pa.RecordBatch, i: int, width: int, c_width: int):
    longs = lambda name: np.frombuffer(batch.column(name)[i].as_py(), dtype=np.int64)
    labels, rows = longs("labels"), longs("rows")
    cells = np.frombuffer(batch.column("cells")[i].as_py(), dtype=np.uint8).reshape(-1, c_width)
    return longs("a_rows"), longs("a_labels"), longs("a_vectors").reshape(-1, width), rows, labels, cells


def _meet_positives(table: Cells, k: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _found(positive_candidates(*_read(batch, i, table.width, table.width), table, k), ["key", "row", "low", "high"])

    return meet


def _meet_negatives(table: Cells, n: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, a_labels, anchors, rows, labels, cells = _read(batch, i, table.width, table.width)
                told = batch.column("windows")[i].as_py()
                places, least, most = (np.frombuffer(x, dtype=np.int64) for x in told[:3])
                anchor_of = np.repeat(np.arange(len(anchors)), np.frombuffer(told[3], dtype=np.int32))
                yield _found(negative_candidates(a_labels, anchors, (places, anchor_of, least, most), rows, labels, cells, table, n), ["key", "row", "low", "high"])

    return meet


def _paired(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Every block with every group, dealt out by both: neither stands in one place for all."""
    b = blocks.select(F.monotonically_increasing_id().alias("block"), "*")
    g = groups.select(F.monotonically_increasing_id().alias("group"), "*")
    b, g = materialize(b, "blocks"), materialize(g, "groups")
    numbers = g.agg(F.collect_list("group")).scalar()  # one number for a group of anchors
    cells = b.select(F.col("block").alias("b_no"), F.explode(numbers).alias("g_no"))
    met = cells.join(b, F.col("b_no") == F.col("block")).join(g, F.col("g_no") == F.col("group"))
    return met.drop("block", "group", "b_no", "g_no")


def _kept(found: DataFrame, k: int, sure: Column) -> DataFrame:
    """Of each key, what the k-th greatest of the sure lower bounds leaves."""
    best = found.where(sure).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("low"), "row"))).where(F.col("n") == k)
    least = best.select(F.col("key").alias("t_key"), F.col("low").alias("t_low"))
    return found.join(least, F.col("key") == F.col("t_key"), "left").where(F.col("t_low").isNull() | (F.col("high") >= F.col("t_low"))).drop("t_key", "t_low")


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


@dataclass
class Approximations:
    """rows: row, id, label, v (whole numbers, all of one length); blocks of approximations of all that can be a candidate; the cells."""

    rows: DataFrame
    blocks: DataFrame
    cells: Cells


def largest_component(width: int) -> int:
    """Whole components below this have inner products of which a hundred times fits a long."""
    return math.isqrt((2**63 - 1) // (100 * width))


def build_file(vectors: DataFrame, most_asked: int = 5, cells: int = CELLS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> Approximations | None:
    """The approximations of vectors(id long, label int, vector array); None if no row takes part.

    most_asked: the most positives, or negatives, that an anchor can be asked for.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    used = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    width = max(1, used.agg(F.max(F.size("vector"))).first()[0] or 0)
    used = used.where(F.forall("vector", lambda x: F.abs(x.cast("double")) < F.lit(float(largest_component(width) // SCALE))))
    rows = materialize(used.select(F.monotonically_increasing_id().alias("row"), "id", F.col("label").cast("long").alias("label"), _whole(F.col("vector"), width).alias("v")), "vectors")
    # Partly aggregated in each task; what comes to the driver is 2 * width numbers.
    ends = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("d").collect()
    if not ends:
        return None
    share = min(1.0, sample_rows / ends[0].n)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toPandas()
    sample = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, width), dtype=np.int64)
    table = make_cells(sample, np.array([r.low for r in ends]), np.array([r.high for r in ends]), cells)
    alike = Window.partitionBy("label", "v").orderBy("id", "row")  # limited before the shuffle
    first = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= most_asked + 1)
    blocks = first.select("row", "label", "v").mapInArrow(_pack_blocks(table, block_rows), "rows binary, labels binary, cells binary")
    return Approximations(rows, materialize(blocks, "va_file"), table)


def _ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("score"), "c_id", "c_label", "c_v")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(file: Approximations, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = WINDOW, group: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors that are rows of file.rows.

    A negative's score lies between window[0] and window[1] hundredths of the positive's, both included.
    """
    rows, table = file.rows, file.cells
    chosen = materialize(anchors.select("row", "id", "label", "v"), "anchors")
    groups = chosen.select("row", "label", "v").mapInArrow(_pack_anchors(table.width, group, False), "a_rows binary, a_labels binary, a_vectors binary")
    found = _paired(file.blocks, groups).mapInArrow(_meet_positives(table, positives), "key long, row long, low double, high double")
    left = _kept(materialize(found, "positives"), positives, F.lit(True)).select("key", "row")
    a = chosen.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"))
    c = rows.select(F.col("row").alias("c_row"), F.col("id").alias("c_id"), F.col("label").alias("c_label"), F.col("v").alias("c_v"))
    scored = left.join(a, F.col("key") == F.col("a_row")).join(c, F.col("row") == F.col("c_row")).withColumn("score", inner(F.col("a_v"), F.col("c_v")))
    best = _ranked(scored, "a_row", positives).select(F.monotonically_increasing_id().alias("place"), "a_row", "anchor_id", F.col("c_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = window
    # Least and greatest whole score: ceil(low * s / 100) and floor(high * s / 100), also below zero.
    least = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)")
    most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    opened = materialize(best.withColumn("least", least).withColumn("most", most), "windows")
    each = opened.where("least <= most").groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("place", "least", "most"))).alias("w"))
    asked = each.join(chosen, F.col("a_row") == F.col("row")).select("row", "label", "v", F.col("w.place"), F.col("w.least"), F.col("w.most"))
    groups = asked.mapInArrow(_pack_anchors(table.width, group, True), "a_rows binary, a_labels binary, a_vectors binary, windows array<binary>")
    found = _paired(file.blocks, groups).mapInArrow(_meet_negatives(table, negatives), "key long, row long, low double, high double")
    found = materialize(found, "negatives").join(opened.select("place", "a_row", "anchor_id", "positive_id", "positive_score", "least", "most"), F.col("key") == F.col("place"))
    left = _kept(found, negatives, (F.col("low") >= F.col("least")) & (F.col("high") <= F.col("most")))
    scored = left.join(a.select(F.col("a_row").alias("b_row"), "a_v"), F.col("a_row") == F.col("b_row")).join(c, F.col("row") == F.col("c_row")).withColumn("score", inner(F.col("a_v"), F.col("c_v")))
    inside = _ranked(scored.where(F.col("score").between(F.col("least"), F.col("most"))), "place", negatives)
    return inside.select("anchor_id", "positive_id", "rank", F.col("c_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchor: Column, **how) -> DataFrame:
    """Hard negatives of the rows of vectors(id, label, vector) for which anchor (a condition on id) holds."""
    spark = vectors.sparkSession
    build = {k: how.pop(k) for k in ("cells", "block_rows", "sample_rows") if k in how}
    file = build_file(vectors, max(how.get("positives", 5), how.get("negatives", 3)), **build)
    if file is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return mine(file, file.rows.where(anchor), **how)
