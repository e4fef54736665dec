"""Near-duplicate vectors by balanced binary codes and multi-index Hamming tables, decided by the original vectors.

Iterative quantisation: a bounded sample of unit vectors is centred and turned to its principal axes, and a rotation is learned that
brings them nearest to the corners of a cube, so that bits are balanced. A vector's code is the signs of its rotated components, BITS at most.
Vectors of the least similarity that links differ in a few bits; how many is measured on such pairs made from the sample, and the
radius is the least that holds `recall` of them. The code is then cut into so many parts that two codes within the radius
differ by one bit at most in some part: for each bit, a row stands in the table of that bit under its part without the bit, and two
such rows meet there. All vectors are in all tables.

Rows that meet are compared by their codes; a pair counts in the first table where it meets, and only there. Tables are sorted, not
grouped, and a place where more than TILE rows meet is cut into pairs of parts, which are dealt out. What passes goes on as tiles
of the rows that meet, with places of the pairs, not as pairs of vectors; each tile gets the vectors of its rows once,
computes cosines in double precision, and returns for each row the number of its links and the least row that it hangs together with. Links
are added up and components found from these. Equal vectors of one label are one row in all this.

Defined cases: vectors that are null, zero, or hold a null or non-finite component link with nothing, nor does a row of null label; vectors of
different lengths are not compared. A row of null id counts and links as others; its component is the least id there is, or
null, and it is not kept. Rows of one id are rows each: all of them are kept if their id is the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vector, materialize
from .components import components

SIMILARITY = 0.98
RECALL = 0.995
BITS = 64
ROTATION_STEPS = 30
#: Vectors that the rotation is fitted on and the radius measured with, in expectation; and their components at most.
SAMPLE_ROWS = 10_000
SAMPLE_NUMBERS = 10_000_000
#: Rows that meet in one place of a table and are compared there at once; of more, parts are.
TILE = 512


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray  # columns: the rotated principal axes, one for each bit
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    @property
    def parts(self) -> list[np.ndarray]:
        """The bits of each part: two codes within the radius differ by at most one bit in some part."""
        return np.array_split(np.arange(self.bits), min(self.bits, max(1, (self.radius + 2) // 2)))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (unit(vectors) - self.mean) @ self.axes > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    m = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # the largest first: squares of very large ones overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always added up in the same order."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def learn(sample: np.ndarray, bits: int = BITS, least: float = SIMILARITY, recall: float = RECALL, seed: int = 42) -> Coder:
    """A coder from vectors that are not zero."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    width = x.shape[1]
    c = min(bits, width)
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd((x - mean).T @ (x - mean))
    projected = (x - mean) @ axes[:c].T
    rotation = np.linalg.qr(rng.normal(size=(c, c)))[0]
    for _ in range(ROTATION_STEPS):
        u, _, v = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    coder = Coder(mean, axes[:c].T @ rotation, 0)
    # Pairs of just the least similarity: each vector, and one turned away from it in a random direction.
    some = x[rng.choice(len(x), min(len(x), 4_000), replace=False)]
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(axis=1, keepdims=True) * some
    norm = np.sqrt((away * away).sum(axis=1, keepdims=True))
    turned = least * some + np.sqrt(1 - least * least) * away / np.where(norm > 1e-9, norm, 1)
    gap = np.sort(differing(coder.codes(some), coder.codes(turned)))
    coder.radius = int(gap[min(len(gap) - 1, int(np.ceil(recall * len(gap))))])
    return coder


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def _masks(parts: list[np.ndarray]) -> list[int]:
    return [sum(1 << int(b) for b in part) for part in parts]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def first_meeting(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For differences of codes, the table (the bit) in which such a pair meets first; -1: in none."""
    out = np.full(len(x), -1, dtype=np.int64)
    for mask in masks[::-1]:
        part = x.view(np.uint64) & mask
        n = np.bitwise_count(part)
        lowest = mask & (~mask + np.uint64(1))
        bit = np.where(n == 0, lowest, part)
        out = np.where(n <= 1, np.bitwise_count(bit - np.uint64(1)).astype(np.int64), out)
    return out


def _meetings(masks: np.ndarray, radius: int, tile: int):
    """From rows sorted by (place, side, ...) to tiles: members (rows), and pairs as numbers of two members.

    place: a hash of label, bit and value; table: the bit; pair: 0, or 1 and more for a pair of parts of a place that holds many;
    side: 0 for rows that meet each other, 1 and 2 for the parts of a pair of two.
    """

    def pairs_of(code: np.ndarray, side: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, other = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        if not side.any():
            other = one
        parts = [(np.zeros(0, dtype=np.int64),) * 2]
        for lo in range(0, len(one), 256):
            own = one[lo : lo + 256]
            x = code[own][:, None] ^ code[other][None, :]
            near = np.bitwise_count(x.view(np.uint64)) <= radius
            if other is one:
                near &= own[:, None] < other[None, :]
            i, j = np.nonzero(near)
            at = (first_meeting(x[i, j], masks) == table[own[i]]) & (table[own[i]] == table[other[j]])
            parts.append((own[i[at]], other[j[at]]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def told(place, table, pair, side, row, code) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (pair[1:] != pair[:-1]))))
            size = np.diff(np.append(begin, len(place)))
            out = [[], [], [], []]
            # Runs of two, the most by far where rows are unlike, all at once.
            two = begin[(size == 2) & (side[begin] == 0)]
            x = code[two] ^ code[two + 1]
            met = two[(np.bitwise_count(x.view(np.uint64)) <= radius) & (first_meeting(x, masks) == table[two]) & (table[two] == table[two + 1])]
            for at in met:
                out[0].append(int(place[at]))
                out[1].append(int(pair[at]))
                out[2].append(row[at : at + 2])
                out[3].append(np.array([0, 1], dtype=np.int32))
            many = (size > 2) | ((size == 2) & (side[begin] == 1))
            for at, n in zip(begin[many], size[many]):
                i, j = pairs_of(code[at : at + n], side[at : at + n], table[at : at + n])
                if len(i):
                    used = np.unique(np.concatenate((i, j)))
                    out[0].append(int(place[at]))
                    out[1].append(int(pair[at]))
                    out[2].append(row[at : at + n][used])
                    out[3].append(np.searchsorted(used, np.stack((i, j), axis=1).ravel()).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array([x.tobytes() for x in out[3]], pa.binary())], names=["place", "pair", "members", "pairs"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]):
                same = (held[0] == held[0][-1]) & (held[2] == held[2][-1])
                last = int(np.flatnonzero(same)[0])  # the run that may go on; it is bounded by two parts
                if last:
                    yield told(*[x[:last] for x in held])
                    held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield told(*held)

    return tiles


def _verified(least: float):
    """From rows sorted by (place, pair, at) with vectors to row, n (weights of the rows that it links with) and parent (the least
    row of the tile that it hangs together with)."""

    def settle(rows, weights, labels, vectors, pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.frombuffer(pairs, dtype=np.int32).reshape(-1, 2).astype(np.int64)
        near = np.concatenate([cosines(vectors[at[lo : lo + 20_000, 0]], vectors[at[lo : lo + 20_000, 1]]) for lo in range(0, len(at), 20_000)]) >= least
        i, j = at[near & (labels[at[:, 0]] == labels[at[:, 1]])].T
        n = np.bincount(i, weights[j], len(rows)) + np.bincount(j, weights[i], len(rows))
        parent = np.arange(len(rows))
        while True:  # the least number goes along the links
            low = np.minimum(parent[i], parent[j])
            after = parent.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = after[after]
            if (after == parent).all():
                break
            parent = after
        used = n > 0
        return rows[used], n[used].astype(np.int64), rows[parent[used]]

    def told(tiles: pa.Table) -> pa.RecordBatch:
        place, pair, _, rows, weights, labels = (tiles.column(i).to_numpy() for i in range(6))
        vectors, pairs = tiles.column(6).combine_chunks(), tiles.column(7)
        begin = np.append(np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (pair[1:] != pair[:-1])))), len(place))
        out = []
        for lo, hi in zip(begin[:-1], begin[1:]):
            own = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
            out.append(settle(rows[lo:hi], weights[lo:hi].astype(np.float64), labels[lo:hi], own, pairs[lo].as_py()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in zip(*out)], names=["row", "n", "parent"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            place, pair = held.column(0).to_numpy(), held.column(1).to_numpy()
            last = int(np.flatnonzero((place == place[-1]) & (pair == pair[-1]))[0])
            if last:
                yield told(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield told(held)

    return verify


def _entries(coded: DataFrame, coder: Coder) -> DataFrame:
    """A row for each bit: place, table, row, code."""
    masks, parts = _masks(coder.parts), coder.parts
    tables = [F.struct(F.lit(int(b)).alias("table"), F.col("code").bitwiseAND(F.lit(signed(mask ^ (1 << int(b))))).alias("value")) for part, mask in zip(parts, masks) for b in part]
    each = coded.select("label", "row", "code", F.explode(F.array(*tables)).alias("t"))
    return each.select(F.xxhash64("label", "t.table", "t.value").alias("place"), F.col("t.table").alias("table"), "row", "code")


def meet(coded: DataFrame, coder: Coder, tile: int = TILE) -> DataFrame:
    """place, pair, members, pairs: tiles of rows of coded(label, row, code) of which pairs are within the radius."""
    masks = np.array(_masks(coder.parts), dtype=np.uint64)
    entries = _entries(materialize(coded, "codes"), coder)  # made twice from the codes: they would be many times as large
    full = materialize(entries.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > tile).select(F.col("place").alias("f_place"), F.ceil(F.col("n") / F.lit(tile / 2)).alias("parts")), "full_places")
    marked = entries.join(full, F.col("place") == F.col("f_place"), "left")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    # Part p meets itself and all parts behind it. Pairs are numbered 1 + p * parts + q, p <= q; a row of part p stands in as many as there are parts.
    some = marked.withColumn("p", part).withColumn("o", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    pair = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(1 + F.least("p", "o") * F.col("parts") + F.greatest("p", "o"))
    side = F.when(F.col("parts").isNull() | (F.col("p") == F.col("o")), 0).when(F.col("p") < F.col("o"), 1).otherwise(2)
    dealt = some.select("place", "table", pair.alias("pair"), side.alias("side"), "row", "code").repartition("place", "pair").sortWithinPartitions("place", "pair", "side", "row")
    return dealt.mapInArrow(_meetings(masks, coder.radius, tile), "place long, pair long, members array<long>, pairs binary")


def linked_rows(classes: DataFrame, coder: Coder, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """row, n, parent for rows of classes(row, label, weight, vector) that link: once for each tile in which they do."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(coder)  # bounded by the vectors' length

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.codes(m), pa.int64())], names=["label", "row", "code"])

    coded = classes.select(F.col("label").cast("long").alias("label"), "row", "vector").mapInArrow(code, "label long, row long, code long")
    found = materialize(meet(coded, coder, tile), "tiles")
    member = found.select("place", "pair", F.posexplode("members").alias("at", "m_row"), "pairs")
    member = member.select("place", "pair", "at", "m_row", F.when(F.col("at") == 0, F.col("pairs")).alias("pairs"))
    own = classes.select("row", "weight", F.col("label").cast("long").alias("label"), "vector")
    with_vectors = member.join(own, F.col("m_row") == F.col("row")).select("place", "pair", "at", "row", "weight", "label", "vector", "pairs")
    dealt = with_vectors.repartition("place", "pair").sortWithinPartitions("place", "pair", "at")
    return dealt.mapInArrow(_verified(least), "row long, n long, parent long")


def near_vectors(vectors: DataFrame, least: float = SIMILARITY, recall: float = RECALL, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept for every row of vectors(id long, label, vector array)."""
    spark: SparkSession = vectors.sparkSession
    usable = F.col("label").isNotNull() & finite_vector(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    same = F.when(usable, F.struct(F.xxhash64("label", "vector"), F.xxhash64("vector", "label", F.lit(1))))
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector", same.alias("same")), "rows")
    # Equal vectors are one: partly counted before the shuffle.
    groups = materialize(rows.where("same IS NOT NULL").groupBy("same").agg(F.min("row").alias("g_row"), F.min("id").alias("g_id"), F.count("*").alias("weight")), "groups")
    classes = materialize(rows.select("row", "label", "vector").join(groups.select("g_row", "weight"), F.col("row") == F.col("g_row")).drop("g_row"), "classes")
    linked = None
    for size in classes.groupBy(F.size("vector").alias("w")).count().where("count > 1").collect():  # a row for each length of vectors
        own = classes.where(F.size("vector") == size.w)
        share = min(1.0, min(sample_rows, SAMPLE_NUMBERS // size.w + 1) / size["count"])
        sample = own.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").toPandas()
        if not len(sample):
            sample = own.select("vector").limit(2).toPandas()
        coder = learn(np.stack(sample["vector"].to_numpy()).astype(np.float64), bits, least, recall)
        part = linked_rows(own, coder, least, tile)
        linked = part if linked is None else linked.union(part)
    if linked is None:
        linked = spark.createDataFrame([], "row long, n long, parent long")
    linked = materialize(linked, "linked")
    counts = linked.groupBy(F.col("row").alias("c_row")).agg(F.sum("n").alias("n"))
    roots = components(linked.select(F.col("row").alias("a"), F.col("parent").alias("b")))
    told = groups.join(counts, F.col("g_row") == F.col("c_row"), "left").join(roots, F.col("g_row") == F.col("node"), "left")
    told = told.select("same", "g_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "g_row").alias("root"))
    least_id = told.groupBy(F.col("root").alias("r_root")).agg(F.min("g_id").alias("r_id"))
    told = told.join(least_id, F.col("root") == F.col("r_root")).select(F.col("same").alias("t_same"), "n", "r_id")
    part = rows.where("same IS NOT NULL").join(told, F.col("same") == F.col("t_same")).select("id", "n", F.col("r_id").alias("component_id"))
    alone = rows.where("same IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return part.union(alone).select("id", F.col("n").cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def drop_near_vectors(df: DataFrame, id_column: str, label_column: str, vector_column: str, **how) -> DataFrame:
    """df without rows whose id is not the least of their component; its columns stay as they are."""
    found = near_vectors(df.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")), **how)
    gone = found.where("NOT kept AND id IS NOT NULL").select(F.col("id").alias("__gone")).distinct()
    return df.join(gone, F.col(id_column) == F.col("__gone"), "left_anti")
