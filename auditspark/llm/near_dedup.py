"""Near-duplicate removal: SimHash groups, and a prefix-filter join on word shingles that is complete for the similarity asked for.

Documents count as near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. They are found by
two searches, one after the other, and all are judged by the exact measure:

- the trie self-join of `simhash_trie`, over fingerprints of five-word shingles: texts that are very near the least document of their
  group leave before the second search, which never meets them. Should that document go later, its copies are judged against
  what it went for; if one is not near to that, nothing leaves early and the second search takes all texts;
- since fingerprints miss copies that are just near enough, a prefix filter for the rest. Put all shingles in one order: two sets
  of that similarity share a shingle among the first n - ceil(0.8 * n) + 1 of each, n being its size, so texts that share one of
  these are candidates and no pair is missed; what stands before the first that they share is not common, so it must stand early
  enough in both. Any order will do; shingles that are common in a sample of the texts come last, by their count, so that few
  texts meet on a shingle.

These first shingles are dealt out and sorted by shingle once, and texts that meet are read off the sorted runs. A run of more
than leaf_size texts is not spread into pairs but kept as a link of all its texts; shingles that the sample shows to be as
common are dealt out by text as well, so that no task gets all of one. Exact copies are one text in all this.

Rounds then settle what stays. First the least text of each long run is judged against all others in it, and leaves it: copies of
one text are gone after that. The texts that are left in long runs are put in order anew, by how often each shingle stands in all
of them, and meet again; texts of one template, alike but not near, then meet no more. Of long runs that are left even so, 2, 4 and more
texts a round are judged against the rest. A document without a smaller one that is near it, nor one that it may still be
judged against, stays; what is near it goes; both leave, until no pairs are left. So what goes is near to a document that stays,
nothing else goes, and no two that stay are near.

Defined cases: a null text counts as empty, and all empty texts as copies; a text of fewer than five words has one shingle; of
rows with the same doc_id and text one stays; rows that share a doc_id but not the text go as exact copies alone; rows with a
null doc_id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .simhash_trie import SEED, simhash_groups

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts leave early that are so similar to the least of their SimHash group: what that may go for later is hardly ever not near to them.
EARLY_SIMILARITY = 0.95
#: Of a shingle of at most so many texts, all pairs are judged.
LEAF_SIZE = 32
#: The same for texts that meet again, of which there are few, and few pairs whose sizes and places allow the similarity.
LEAF_AGAIN = 256
#: Share of the texts whose shingles are counted for the order, and how often a shingle stands in them that is common; of these so
#: many (of 16 bytes) go to all tasks, the most frequent. What is counted changes the cost alone.
SAMPLE_SHARE = 0.2
COMMON_TIMES = 4
MOST_COMMON = 1_000_000
#: Fingerprints in a leaf of the trie: half a megabyte of them.
TRIE_LEAF = 65_536
#: Parts that a shingle as common as a long run is dealt to.
HOT_PARTS = 64
#: Texts of a long run that are judged against the rest in a round: 1, 2, 4 and so on up to so many.
MOST_OPENED = 256
#: Pairs of short runs that are looked at together.
PAIRS_AT_ONCE = 500_000
#: Ids (of some 50 bytes) up to this number are broadcast to pick their rows; more are joined by shuffle.
BROADCAST_IDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> set:
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)}


def similarity(a: str | None, b: str | None, width: int = SHINGLE_WORDS) -> float:
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y)


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the set of a text's shingles, as ascending signed integers."""
    words = words_of(text)
    base = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    rows = [base[i : len(base) - width + 1 + i] for i in range(width)] if len(words) >= width else [base[i : i + 1] for i in range(len(words))]
    h = np.zeros(len(rows[0]) if rows else 1, dtype=np.uint64)
    for x in rows:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    n = len(np.intersect1d(a, b, assume_unique=True))
    return n / (len(a) + len(b) - n)


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of where the hashes fall: at least four bits for each of them, a power of two."""
    bits = max(64, 4 << (len(hashes) - 1).bit_length())
    marks = np.zeros(bits, dtype=np.uint8)
    marks[hashes & (bits - 1)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def may_be_near(n_a: int, a: bytes, n_b: int, b: bytes, least: float) -> bool:
    """Whether sets of these sizes and signatures can be that similar: one of a falls where none of b does, so it is not in b."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    m = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, m)), np.bitwise_or.reduce(y.reshape(-1, m))
    most = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return most >= (n_a + n_b) * (least / (1 + least)) - 1e-6


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of a set's hashes in the order of (count, hash), of which two sets of similarity least share one, and their
    counts. common ascends; hashes not in it count 0."""
    n = len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1
    count = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[place] == hashes, counts[place], 0)
    order = np.lexsort((hashes, count))[:n]
    return hashes[order], count[order]


def _prefix_rows(shared, least: float, width: int, leaf_size: int):
    """From (key, text) to a row for each first shingle of each text: shingle, key, the set's size, its place in the order from 0
    on, and whether it is hot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:  # a copy that this task has met
                    continue
                seen.add(key)
                hashes = shingle_hashes(text.as_py(), width)
                first, count = prefix(hashes, common, counts, least)
                out.append((first, np.full(len(first), key), np.full(len(first), len(hashes)), np.arange(len(first)), count > leaf_size))
            if len(seen) > 1_000_000:
                seen.clear()
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*out), kinds)], names=["shingle", "key", "size", "place", "hot"])

    return rows


def enough_left(size_a, size_b, place_a, place_b, least: float):
    """Whether two sets whose first common shingle stands at these places can be that similar: what is before is not common.
    For numbers, arrays and Columns."""
    need = (size_a + size_b) * (least / (1 + least)) - 1e-6
    return (size_a - place_a >= need) & (size_b - place_b >= need)


def _read_runs(least: float, leaf_size: int, at_once: int = 20_000):
    """at_once: rows that are read before runs are told. From rows sorted by (shingle, key) to pairs of keys (a before b) of short runs, and (shingle, a, size, place) of long ones."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)

        def told(s: np.ndarray, k: np.ndarray, n: np.ndarray, at: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            """Of whole runs, or of a part of a run that is long by itself."""
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
            s, k, n, at, hot = s[new], k[new], n[new], at[new], hot[new]
            begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(begin, len(s)))
            long = np.repeat(hot[begin] | (size > leaf_size), size)
            none = np.zeros(int(long.sum()), dtype=np.int64)
            parts = [(none > 0, s[long], k[long], none, n[long], at[long])]
            for m in np.unique(size[(size > 1) & (size <= leaf_size)]):
                x, y = np.triu_indices(m, 1)
                whole = begin[(size == m) & ~hot[begin]]
                step = max(1, PAIRS_AT_ONCE // len(x))
                for own in (whole[i : i + step] for i in range(0, len(whole), step)):
                    p, q = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
                    fit = enough_left(n[p], n[q], at[p], at[q], least)
                    none = np.zeros(int(fit.sum()), dtype=np.int64)
                    parts.append((none == 0, none, k[p[fit]], k[q[fit]], none, none))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*parts), kinds)], names=["paired", "shingle", "a", "b", "size", "place"])

        held, cut = [none, none, none, none, np.zeros(0, dtype=bool)], None
        for batch in batches:
            held = [np.concatenate((x, batch.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(held)]
            if cut is not None and len(held[0]):  # the run goes on that was told in part
                held[4] = held[4] | (held[0] == cut)
            if len(held[0]) < at_once:
                continue
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if len(held[0]) - last > 4 * leaf_size and len(np.unique(held[1][last:])) > leaf_size:
                held[4] = held[4] | (held[0] == held[0][-1])
                last, cut = len(held[0]), held[0][-1]
            if last:
                yield told(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if len(held[0]):
            yield told(*held)

    return runs


def _of_ids(rows: DataFrame, column: str, ids: DataFrame, n: int | None = None) -> DataFrame:
    """rows whose column is among the ids(id), which are n, if that is known."""
    few = (ids.count() if n is None else n) <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, F.col(column) == F.col("id"), "left_semi")


def possible(long: DataFrame, least: float) -> DataFrame:
    """long(shingle, doc_id, size, place) without texts that cannot be that near to any other of their run, by sizes and places.

    A text of size n at place p can be near to texts of size most = (n - p) / share - n at most (see enough_left). So it needs one
    that is no larger than that, and one that may be near to texts of its own size. What goes lets others go: three times over.
    """
    share = least / (1 + least)
    left = long.withColumn("most", (F.col("size") - F.col("place") + 1e-6) / share - F.col("size"))
    for _ in range(3):
        ends = left.groupBy(F.col("shingle").alias("e_shingle")).agg(F.min("size").alias("smallest"), F.max("most").alias("furthest"), F.count("*").alias("n"))
        left = left.join(ends, F.col("shingle") == F.col("e_shingle")).where("n > 1 AND smallest <= most AND size <= furthest").drop("e_shingle", "smallest", "furthest", "n")
    return left.drop("most")


def near_copies(docs: DataFrame, least: float = SIMILARITY, width: int = SHINGLE_WORDS, leaf_size: int = LEAF_SIZE, early: bool = True) -> DataFrame:
    """doc_id, digest, of: every text that goes (rows with this doc_id and this md5), and the document that it is a copy of.

    early: whether texts that are near the least of their SimHash group leave before the prefix filter; what goes is the same.

    Each round settles the least document of a pair at least, or takes texts from long runs, so the rounds end.
    """
    spark = docs.sparkSession

    @F.pandas_udf("array<long>")
    def every(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, width) for t in texts], dtype=object)

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = lru_cache(maxsize=512)(lambda text: shingle_hashes(text, width))  # a text is met in several pairs
        for a, b in batches:
            yield pd.Series([jaccard(of(x), of(y)) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("n int, signature binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        each = [shingle_hashes(t, width) for t in texts]
        return pd.DataFrame({"n": pd.Series([len(h) for h in each], dtype="int32"), "signature": pd.Series([signature(h) for h in each], dtype=object)})

    @F.pandas_udf("boolean")
    def possibly(n_a: pd.Series, a: pd.Series, n_b: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_be_near(*x, least) for x in zip(n_a, a, n_b, b)], dtype=bool)

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = materialize(known.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.xxhash64("text").alias("key")), "digests")
    texts = materialize(marked.groupBy("digest", "key").agg(F.min("doc_id").alias("doc_id")), "texts")
    alone = texts.groupBy("doc_id").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1")
    nodes = materialize(alone.select("key", "doc_id"), "nodes")

    def runs(keyed: DataFrame, counted_in: DataFrame, name: str, leaf_size: int) -> DataFrame:
        """What texts of keyed(key, text) meet on, in the order that the shingles of counted_in(text) give."""
        counted = counted_in.select(F.explode(every("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TIMES)
        common = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas().sort_values("h")
        shared = spark.sparkContext.broadcast((common["h"].to_numpy(dtype=np.int64), common["n"].to_numpy(dtype=np.int64)))
        rows = keyed.mapInArrow(_prefix_rows(shared, least, width, leaf_size), "shingle long, key long, size int, place int, hot boolean")
        dealt = rows.repartition("shingle", F.when(F.col("hot"), F.pmod("key", F.lit(HOT_PARTS))).otherwise(0)).sortWithinPartitions("shingle", "key")
        return materialize(dealt.mapInArrow(_read_runs(least, leaf_size), "paired boolean, shingle long, a long, b long, size int, place int"), name)

    own = nodes.select(F.col("doc_id").alias("n_id"), F.col("key").alias("n_key"))

    def texts_of(ids: DataFrame, name: str, n: int | None = None) -> DataFrame:
        """doc_id, text, s (size and signature) of the ids(id), which are n, if that is known."""
        some = _of_ids(known.withColumn("key", F.xxhash64("text")), "doc_id", ids, n)
        return materialize(some.join(own, (F.col("doc_id") == F.col("n_id")) & (F.col("key") == F.col("n_key")), "left_semi").select("doc_id", "text", signed("text").alias("s")).dropDuplicates(["doc_id"]), name)

    def both(pairs: DataFrame, frame: DataFrame, columns: dict[str, str]) -> DataFrame:
        """pairs(doc_id, of) with these columns of frame for either end, x_ and y_."""
        end = lambda x: frame.select(F.col("doc_id").alias(f"{x}_id"), *[F.col(k).alias(f"{x}_{v}") for k, v in columns.items()])
        return pairs.join(end("y"), F.col("of") == F.col("y_id")).join(end("x"), F.col("doc_id") == F.col("x_id"))

    ends_of = lambda pairs: pairs.select(F.explode(F.array("doc_id", "of")).alias("id"))

    def judged(pairs: DataFrame, name: str, met_texts: DataFrame) -> DataFrame | None:
        """Those of pairs(doc_id, of) that are near, None if none may be: by signatures first, then by the texts of those that are left.
        Very many may share one `of`: its text goes to them."""
        met = both(pairs, met_texts, {"s.n": "n", "s.signature": "s"}).where(possibly("x_n", "x_s", "y_n", "y_s"))
        likely = materialize(met.select("doc_id", "of"), "likely")
        if not (n := likely.count()):
            return None
        texts = _of_ids(met_texts.select("doc_id", "text"), "doc_id", ends_of(likely), 2 * n)
        return materialize(both(likely, texts, {"text": "text"}).where(alike("x_text", "y_text") >= least).select("doc_id", "of"), name)

    def near_of(pairs: DataFrame, name: str, n: int, similar: float = least) -> DataFrame:
        """Those of n pairs of texts that are not read yet which are that similar. Most are, so signatures would spare little."""
        some = texts_of(ends_of(pairs), f"{name}_texts", 2 * n)
        return materialize(both(pairs, some, {"text": "text"}).where(alike("x_text", "y_text") >= similar).select("doc_id", "of"), name)

    by_text = known.select(F.xxhash64("text").alias("key"), "text")
    copies = None
    if early:
        groups = simhash_groups(by_text, doc_id="key", shingle_words=width, leaf_size=TRIE_LEAF).where("doc_id != component_id")
        groups = materialize(groups.select("doc_id", "component_id").distinct(), "groups")
        if groups.limit(1).count():
            members = groups.union(groups.select("component_id", "component_id").distinct()).join(own, F.col("doc_id") == F.col("n_key"))
            firsts = members.groupBy(F.col("component_id").alias("c")).agg(F.min("n_id").alias("of"))
            grouped = materialize(members.join(firsts, F.col("component_id") == F.col("c")).where("n_id != of").select(F.col("n_id").alias("doc_id"), "of"), "grouped")
            copies = near_of(grouped, "early", grouped.count(), max(least, EARLY_SIMILARITY))
            left = materialize(copies.join(own, F.col("doc_id") == F.col("n_id")).select(F.col("n_key").alias("id")), "early_keys")
            few = left.count() <= BROADCAST_IDS
            by_text = by_text.join(F.broadcast(left) if few else left, F.col("key") == F.col("id"), "left_anti")
    met = runs(by_text, known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(SAMPLE_SHARE * (1 << 20))), "met", leaf_size)
    end = lambda name: nodes.select(F.col("key").alias(f"{name}_key"), F.col("doc_id").alias(f"{name}_id"))
    pairs = met.where("paired").select("a", "b").distinct()
    pairs = pairs.join(end("x"), F.col("a") == F.col("x_key")).join(end("y"), F.col("b") == F.col("y_key"))
    pairs = materialize(pairs.select(F.greatest("x_id", "y_id").alias("doc_id"), F.least("x_id", "y_id").alias("of")).where("doc_id != of").distinct(), "pairs")
    held = met.where("NOT paired").select("shingle", "a", "size", "place").distinct().join(end("x"), F.col("a") == F.col("x_key"))
    long = materialize(possible(held.select("shingle", F.col("x_id").alias("doc_id"), "size", "place"), least), "long")

    met_ids = materialize(pairs.select(F.explode(F.array("doc_id", "of")).alias("id")).union(long.select("doc_id")).distinct(), "ids")
    met_texts = texts_of(met_ids, "met_texts")

    sure, gone, opened = judged(pairs, "near", met_texts), [], 1
    held = long.limit(1).count() > 0
    while True:
        if opened == 2 and held:
            # What the sample did not show to be common is known by now for the few texts that are left in long runs: put in order by
            # all of their shingles, texts of one template meet no more, unless they are near.
            left = long.select(F.col("doc_id").alias("id")).distinct()
            texts_left = _of_ids(met_texts, "doc_id", materialize(left, "left"))
            again = runs(texts_left.select("doc_id", "text"), texts_left, "met_again", LEAF_AGAIN if leaf_size == LEAF_SIZE else 2 * leaf_size)
            more = again.where("paired").select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("of")).distinct()
            more = judged(more, "near", met_texts)
            sure = more if sure is None else sure if more is None else sure.union(more)
            long = materialize(possible(again.where("NOT paired").select("shingle", F.col("a").alias("doc_id"), "size", "place").distinct(), least), "long")
            held = long.limit(1).count() > 0
        if held:
            number = F.row_number().over(Window.partitionBy("shingle").orderBy("doc_id"))
            firsts = materialize(long.withColumn("number", number).where(F.col("number") <= opened).select(F.col("shingle").alias("f_shingle"), F.col("doc_id").alias("first"), F.col("size").alias("f_size"), F.col("place").alias("f_place")), "firsts")
            beside = long.join(firsts, F.col("shingle") == F.col("f_shingle")).where((F.col("doc_id") != F.col("first")) & enough_left(F.col("size"), F.col("f_size"), F.col("place"), F.col("f_place"), least))
            more = judged(beside.select(F.greatest("doc_id", "first").alias("doc_id"), F.least("doc_id", "first").alias("of")).distinct(), "judged", met_texts)
            sure = more if sure is None else sure if more is None else sure.union(more)
            long = long.join(firsts, (F.col("shingle") == F.col("f_shingle")) & (F.col("doc_id") == F.col("first")), "left_anti")
            opened = min(MOST_OPENED, 2 * opened)
        if sure is not None and not sure.limit(1).count():
            sure = None
        if not held and sure is None:
            break
        if sure is not None:
            waits = sure.select("doc_id")
            if held:
                least_of = long.groupBy(F.col("shingle").alias("l_shingle")).agg(F.min("doc_id").alias("least"))
                waits = waits.union(long.join(least_of, F.col("shingle") == F.col("l_shingle")).where("doc_id > least").select("doc_id"))
            waits = waits.distinct().toDF("w_id")
            gone.append(materialize(sure.join(waits, F.col("of") == F.col("w_id"), "left_anti"), "settled"))
            out = gone[-1].select(F.col("doc_id").alias("o_id")).distinct()
            sure = materialize(sure.join(out, F.col("doc_id") == F.col("o_id"), "left_anti").join(out, F.col("of") == F.col("o_id"), "left_anti"), "sure")
            long = long.join(out, F.col("doc_id") == F.col("o_id"), "left_anti") if held else long
        if not held:
            continue
        several = long.groupBy(F.col("shingle").alias("m_shingle")).agg(F.count("*").alias("n")).where("n > 1").select("m_shingle")
        long = materialize(long.join(several, F.col("shingle") == F.col("m_shingle"), "left_semi"), "long")
        held = long.limit(1).count() > 0
    left = marked.select("doc_id", "digest").distinct().join(texts.select(F.col("digest").alias("t_digest"), F.col("doc_id").alias("of")), F.col("digest") == F.col("t_digest")).where(F.col("doc_id") != F.col("of"))
    if copies is not None:
        stays = copies
        if gone:
            went = reduce(DataFrame.union, gone).select(F.col("doc_id").alias("g_id"), F.col("of").alias("g_of"))
            stays = copies.join(went, F.col("of") == F.col("g_id"), "left_anti")
            orphans = materialize(copies.join(went, F.col("of") == F.col("g_id")).select("doc_id", F.col("g_of").alias("of")).distinct(), "orphans")
            if n := orphans.count():
                found = near_of(orphans, "adopted", n)
                if orphans.join(found.select(F.col("doc_id").alias("f_id")), F.col("doc_id") == F.col("f_id"), "left_anti").limit(1).count():
                    return near_copies(docs, least, width, leaf_size, early=False)
                gone.append(found)
        gone.append(stays)
    if not gone:
        return left.select("doc_id", "digest", "of")
    near_gone = reduce(DataFrame.union, gone).join(texts.select(F.col("doc_id").alias("t_id"), "digest"), F.col("doc_id") == F.col("t_id"))
    return near_gone.select("doc_id", "digest", "of").union(left.select("doc_id", "digest", "of"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near copies of one that stays; its columns stay as they are."""
    gone = materialize(near_copies(docs, **how).select(F.col("doc_id").alias("__g_id"), F.col("digest").alias("__g_digest")).distinct(), "gone")
    text = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("__digest"))
    few = gone.count() <= BROADCAST_IDS
    kept = text.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("__g_id")) & (F.col("__digest") == F.col("__g_digest")), "left_anti")
    # Rows are gathered by doc_id only where one stands more than once.
    again = materialize(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "again")
    if not again.limit(1).count():
        return kept.drop("__digest")
    repeated = _of_ids(kept, "doc_id", again).dropDuplicates(["doc_id", "__digest"])
    few = again.count() <= BROADCAST_IDS
    return kept.join(F.broadcast(again) if few else again, F.col("doc_id") == F.col("id"), "left_anti").union(repeated).drop("__digest")
