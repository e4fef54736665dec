"""Retrieval: nearest vectors, keyword coverage, reciprocal-rank fusion, graph expansion.

Builders are lazy and return a total order's first k rows. A query vector is a literal, so a search is a scan with a top-k. Searches of
vectors and words rank ids first and read the other columns of those alone: where chunks are a join, whole texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage, source_label, trigrams
from ..functions.vector import cosine, l2_distance, literal

RRF_K = 60


def of_first(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of few ids(id), a top-k's; an id that is null or stands more than once counts as any other."""
    few = F.broadcast(ids.select(F.col("id").alias("__id")))
    return chunks.join(few, F.col("id").eqNullSafe(F.col("__id")), "left_semi")


def vector_search(chunks: DataFrame, query: list[float], k: int = 5, books: list[str] | None = None) -> DataFrame:
    """chunks(id, content, source_id, course, book, embedding): the k nearest by L2; similarity is 1 - distance."""
    if books:
        chunks = chunks.where(F.col("book").isin(books))
    distance = F.round(l2_distance(F.col("embedding"), literal(query)), 9).alias("distance")
    nearest = lambda rows: rows.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)
    found = nearest(of_first(chunks, nearest(chunks.select("id", distance))).withColumn("distance", distance))
    label = source_label(F.col("course"), F.col("book"), F.lit(None).cast("string"), F.col("source_id"))
    return found.select("id", "source_id", "content", label.alias("source_label"), F.coalesce(F.round(1 - F.col("distance"), 6), F.lit(0.0)).alias("similarity"))


def any_ilike(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.ilike(c, F.lit(f"%{w}%")) for w in words), F.lit(False))


def keyword_search(chunks: DataFrame, words: list[str], k: int = 5, books: list[str] | None = None) -> DataFrame:
    """Candidates hold any word in any case, the first 5k by id; ranked by the share of words they hold, case and all."""
    found = chunks.where(any_ilike(F.col("content"), words))
    if books:
        found = found.where(any_ilike(F.col("book"), books))
    # Distinct ids do not depend on a table that is joined on the left's rows, so Spark leaves such a join out here.
    found = of_first(found, found.select("id").distinct().orderBy("id").limit(5 * k)).orderBy("id").limit(5 * k)
    score = F.round(coverage(F.col("content"), words), 4)
    return found.select("id", "source_id", "content", score.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """Both lists(id, source_id, content, similarity) by the sum of 1 / (60 + rank) of rows with the same source and beginning.

    The lists are short (top-k results), so their ranks are numbered in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))
    key = F.concat(F.col("source_id").cast("string"), F.left("content", F.lit(50)))
    ranked = [side.select("id", key.alias("key"), (F.lit(1.0).cast("double") / (RRF_K + rank)).alias("points"), F.lit(i).alias("side")) for i, side in enumerate((first, second))]
    fused = ranked[0].unionByName(ranked[1]).groupBy("key").agg(F.sum("points").alias("score"), F.min_by("id", F.struct("side", -F.col("points"), "id")).alias("id"))
    similarity = F.round(F.least(30 * F.col("score"), F.lit(0.99)), 4)
    return fused.select("id", "key", similarity.alias("similarity"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(chunks: DataFrame, query: list[float], words: list[str], k: int = 5, books: list[str] | None = None) -> DataFrame:
    columns = ["id", "source_id", "content", "similarity"]
    return reciprocal_rank_fusion(vector_search(chunks, query, 2 * k, books).select(*columns), keyword_search(chunks, words, 2 * k, books), k)


def graph_search(chunks: DataFrame, entities: DataFrame, edges: DataFrame, words: list[str], k: int = 5, seeds: int = 20, neighbours: int = 30, books: list[str] | None = None) -> DataFrame:
    """Chunks of the entities(id, name, rank, chunk_ids) that match a word and of their neighbours by edges(src, dst); with books, of
    these alone, each named by a part of its name, case and all."""
    like = reduce(lambda a, b: a | b, (F.like(F.col("name"), F.lit(f"%{w}%")) for w in words))
    start = entities.where(like).orderBy("rank", "id").limit(seeds)
    down = edges.join(start.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().orderBy("id").limit(neighbours)
    up = edges.join(start.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().orderBy("id").limit(neighbours)
    reached = start.select("id").union(down).union(up).distinct()
    ids = entities.join(reached, "id").select(F.explode("chunk_ids").alias("id")).distinct().orderBy("id").limit(3 * k)
    found = chunks.join(ids, "id")
    if books:
        found = found.where(reduce(lambda a, b: a | b, (F.like(F.col("book"), F.lit(f"%{b}%")) for b in books)))
    return found.orderBy("id").limit(k).select("id", "content", F.lit(0.85).alias("similarity"))


def trigram_join(names: DataFrame, column: str, least: float = 0.3) -> DataFrame:
    """a, b, similarity of distinct values a < b that share `least` of their trigrams or more; nulls take no part.

    Values meet on trigrams and not all with all. Of a value's trigrams, from the rarest on, only so many are joined on that
    one of them must be shared by any value as similar as that; so frequent trigrams are hardly ever joined on.
    """
    own = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    listed = own.select("name", F.explode(trigrams(F.col("name"))).alias("gram"))
    return similar_by_grams(listed, listed.groupBy("gram").agg(F.count("*").alias("n")), least)


def similar_by_grams(listed: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of names a < b of listed(name, gram); counts(gram, n) tells how often each trigram stands."""
    ranked = listed.join(counts, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    need = F.size("ranked") - F.ceil(F.size("ranked") * least - 1e-9) + 1
    first = F.transform(F.slice("ranked", F.lit(1), need.cast("int")), lambda x: x["gram"])
    keys = ranked.select("name", F.size("ranked").alias("size"), F.posexplode(first).alias("pos", "gram"))
    a_keys, b_keys = keys.toDF("a", "n_a", "p_a", "gram"), keys.toDF("b", "n_b", "p_b", "gram_b")
    # Sizes too far apart, or too few trigrams left behind the shared one, cannot be that similar.
    sizes = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    left_over = 1 + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1 + F.least("p_a", "p_b")
    enough = left_over >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9
    met = a_keys.join(b_keys, (F.col("gram") == F.col("gram_b")) & (F.col("a") < F.col("b")) & sizes & enough).select("a", "b").distinct()
    own = ranked.select("name", F.transform("ranked", lambda x: x["gram"]).alias("grams"))
    full = met.join(own.toDF("a", "g_a"), "a").join(own.toDF("b", "g_b"), "b")
    similarity = F.size(F.array_intersect("g_a", "g_b")) / F.size(F.array_union("g_a", "g_b"))
    return full.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def archived_search(knowledge: DataFrame, query: list[float], k: int = 5, above: float = 0.5) -> DataFrame:
    """The k nearest, of which those with a similarity above the bound are returned."""
    found = knowledge.where(F.col("embedding").isNotNull()).withColumn("similarity", F.round(1 - l2_distance(F.col("embedding"), literal(query)), 6))
    return found.orderBy(F.desc("similarity"), "id").limit(k).where(F.col("similarity") > above).drop("embedding")


def rule_search(rules: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    scored = rules.withColumn("similarity", F.round(cosine(F.col("embedding"), literal(query)), 6))
    return scored.orderBy(F.desc("similarity"), "id").limit(k).drop("embedding")


def context(found: DataFrame, most: int = 500) -> DataFrame:
    """One row: the found contents, numbered from the most similar on."""
    lines = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id", F.left("content", F.lit(most)).alias("c"))))
    return found.agg(F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["c"])), "\n\n").alias("context"))


def dispatch(mode: str, modes: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The builder of a mode; of "vector" for an unknown one."""
    return modes.get(mode, modes["vector"])()
