"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are computed once a text and then reduced to the distinct ones. Their trie is cut where a node holds at most
`leaf_size` of them. Pairs of nodes are then traversed together from the root: both sides are replaced by their children, the
bits in which the prefixes differ are added up, and pairs beyond the error budget are dropped (`leaf_pairs`, joins over the
small table of nodes). Each pair of leaves that is left goes to one task, which traverses the two subtries in the same way,
vectorized over node pairs, and returns the links of a spanning forest instead of all links. Connected components of these
links give the groups, and all rows of one fingerprint share its group.

Bounds: a task holds two leaves, 2 * leaf_size fingerprints, however the rows are spread: a crowded region of the trie is cut
deeper. Copies of one text, be they a third of all rows, are one fingerprint before any join.

Defined cases: null and empty texts have no words and fingerprint zero, and are linked like any other; repeated rows are rows
of their own in one group; a null doc_id takes no part in the choice of component_id, which is null if a group has no other.
The output has the columns named below and no others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
LEAF_SIZE = 16_384
#: Bits by which the trie is deepened at a time.
STRIDE = 4
SEED = 42


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = max(1, len(words) - shingle_words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle_words) for t in texts], dtype="int64")

    return fingerprints(text)


def _prefix(fp: Column, bits: int) -> Column:
    """The first bits, as a number."""
    return F.shiftrightunsigned(fp, 64 - bits) if bits else F.lit(0).cast("long")


def _leaves(fps: DataFrame, leaf_size: int) -> tuple[DataFrame, DataFrame, int]:
    """fps(fp) with its leaf (depth, prefix); the nodes of every depth with whether they are leaves; the greatest depth."""
    rest, assigned, nodes = fps, None, None
    depth = 0
    while True:
        depth = min(64, depth + STRIDE)
        counted = rest.groupBy(_prefix(F.col("fp"), depth).alias("prefix")).agg(F.count("*").alias("n"))
        counted = materialize(counted.select(F.lit(depth).alias("depth"), "prefix", (F.col("n") <= leaf_size).alias("leaf")), "nodes")
        nodes = counted if nodes is None else nodes.union(counted)
        tagged = rest.withColumn("prefix", _prefix(F.col("fp"), depth)).join(counted, "prefix")
        done = tagged.where("leaf").select("fp", "depth", "prefix")
        assigned = done if assigned is None else assigned.union(done)
        if not counted.where("not leaf").limit(1).count():
            return assigned, nodes, depth
        rest = materialize(tagged.where("not leaf").select("fp"), "crowded")


def leaf_pairs(nodes: DataFrame, deepest: int, max_bits: int) -> DataFrame:
    """da, a, db, b: pairs of leaves (a before b, or the same) whose known bits differ in max_bits at most."""
    spark = nodes.sparkSession
    pairs = spark.sql("SELECT 0 AS da, 0L AS a, 0 AS db, 0L AS b")
    for depth in range(STRIDE, deepest + STRIDE, STRIDE):
        depth = min(64, depth)
        level = nodes.where(F.col("depth") == depth).select(F.shiftrightunsigned("prefix", STRIDE).alias("up"), F.col("prefix").alias("down"))

        def side(frame: DataFrame, d: str, p: str) -> DataFrame:
            """A node of the level above gives way to its children; a leaf that was met earlier stays."""
            kids = level.select((F.lit(depth - STRIDE)).alias(f"{d}_up"), F.col("up").alias(f"{p}_up"), F.col("down").alias(f"{p}_down"))
            frame = frame.join(kids, (F.col(d) == F.col(f"{d}_up")) & (F.col(p) == F.col(f"{p}_up")), "left")
            return frame.select(
                *[c for c in frame.columns if c not in (d, p, f"{d}_up", f"{p}_up", f"{p}_down")],
                F.when(F.col(f"{p}_down").isNull(), F.col(d)).otherwise(F.lit(depth)).alias(d),
                F.coalesce(f"{p}_down", p).alias(p),
            )

        was_same = pairs.withColumn("same", (F.col("da") == F.col("db")) & (F.col("a") == F.col("b")))
        grown = side(side(was_same, "da", "a"), "db", "b")
        differing = F.bit_count(F.expr("shiftrightunsigned(a, da - least(da, db))").bitwiseXOR(F.expr("shiftrightunsigned(b, db - least(da, db))")))
        pairs = materialize(grown.where(differing <= max_bits).where(~F.col("same") | (F.col("a") <= F.col("b"))).select("da", "a", "db", "b"), "pairs")
    return pairs


def _split(sorted_fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each range of equal higher bits turns from 0 to 1 in this bit."""
    mask = np.uint64(1) << np.uint64(bit)
    first = (sorted_fps[lo] & ~(mask | (mask - np.uint64(1)))) | mask
    return np.clip(np.searchsorted(sorted_fps, first), lo, hi)


def traverse(a: np.ndarray, b: np.ndarray, max_bits: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted arrays a and b whose values differ in at most max_bits bits.

    Pairs of trie nodes are ranges of a and of b. Level by level each gives way to the pairs of its children, with the bits
    that differ added up; pairs of few values are compared at once. a and b may be the same array: then each pair is met once.
    """
    same = a is b
    none = np.zeros(0, dtype=np.int64)
    if not len(a) or not len(b):
        return none, none
    al, ah, bl, bh, d = (np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0))
    found_a, found_b = [none], [none]
    for bit in range(63, -2, -1):
        na, nb = ah - al, bh - bl
        few = (na * nb <= small) | (bit < 0)
        if few.any():
            pa, pb, ma, mb = al[few], bl[few], na[few], nb[few]
            size = ma * mb
            start = np.repeat(np.cumsum(size) - size, size)
            k = np.arange(size.sum(), dtype=np.int64) - start
            width = np.repeat(mb, size)
            ia, ib = np.repeat(pa, size) + k // width, np.repeat(pb, size) + k % width
            near = np.bitwise_count(a[ia] ^ b[ib]) <= max_bits
            if same:
                near &= ia < ib
            found_a.append(ia[near])
            found_b.append(ib[near])
            al, ah, bl, bh, d = al[~few], ah[~few], bl[~few], bh[~few], d[~few]
        if not len(al):
            break
        am, bm = _split(a, al, ah, bit), _split(b, bl, bh, bit)
        twin = (al == bl) & (ah == bh) if same else np.zeros(len(al), dtype=bool)
        parts = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            l1, h1 = (al, am) if x == 0 else (am, ah)
            l2, h2 = (bl, bm) if y == 0 else (bm, bh)
            keep = (l1 < h1) & (l2 < h2) & (d + (x != y) <= max_bits)
            if (x, y) == (1, 0):
                keep &= ~twin
            parts.append((l1[keep], h1[keep], l2[keep], h2[keep], d[keep] + (x != y)))
        al, ah, bl, bh, d = (np.concatenate(p) for p in zip(*parts))
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is linked with, directly or not: labels go along links, then are halved."""
    label = np.arange(n, dtype=np.int64)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _links_of(max_bits: int):
    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = np.unique(left["fp"].to_numpy(np.int64).view(np.uint64))
        b = np.unique(right["r_fp"].to_numpy(np.int64).view(np.uint64)) if len(right) else a
        ia, ib = traverse(a, b, max_bits)
        every = a if b is a else np.concatenate([a, b])
        label = _forest(len(every), ia, ib if b is a else ib + len(a))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": every[linked].view(np.int64), "b": every[label[linked]].view(np.int64)})

    return links


def near_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """a, b: links that join the same groups as all pairs of fps(fp, distinct) at max_bits or fewer differing bits do."""
    leaves, nodes, deepest = _leaves(fps, leaf_size)
    leaves = materialize(leaves, "leaves")
    pairs = leaf_pairs(nodes, deepest, max_bits)
    left = pairs.join(leaves, (F.col("da") == F.col("depth")) & (F.col("a") == F.col("prefix"))).select("da", "a", "db", "b", "fp")
    other = pairs.where((F.col("da") != F.col("db")) | (F.col("a") != F.col("b")))
    right = other.join(leaves, (F.col("db") == F.col("depth")) & (F.col("b") == F.col("prefix"))).select("da", "a", "db", "b", "fp")
    keys, again = ["da", "a", "db", "b"], ["r_da", "r_a", "r_db", "r_b"]
    left, right = left.toDF(*keys, "fp"), right.toDF(*again, "r_fp")
    return left.groupBy(*keys).cogroup(right.groupBy(*again)).applyInPandas(_links_of(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id; one row for each row of docs."""
    marked = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle_words).alias("fp")), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(near_fingerprints(distinct.select("fp"), max_bits, leaf_size))
    grouped = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    # Most groups are one fingerprint; the few others can hold many, so only the small table of groups is joined.
    component = grouped.join(least, "root").select(F.col("fp").alias("g_fp"), "component_id")
    return marked.join(component, F.col("fp") == F.col("g_fp"), "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group, that of the least doc_id; docs keeps its columns.

    Rows that share a doc_id are taken as one document, and one of them stays. A null doc_id cannot stand for a group: such
    rows all stay.
    """
    keep = simhash_groups(docs, **how).select(F.col("component_id").alias("k_id")).distinct()
    kept = docs.join(keep, F.col("doc_id") == F.col("k_id"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).union(docs.where(F.col("doc_id").isNull()))
