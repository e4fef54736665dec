"""Building a knowledge graph from what was extracted, and searching it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, search

# Levels of a textbook in the order in which their entities are listed.
LEVELS = ("章", "节", "编")
IMPORTANCE = ("高", "中", "低")


def level_rank(category: Column) -> Column:
    """1, 2, 3 for 章, 节, 编; 4 for all else."""
    return F.when(category == LEVELS[0], 1).when(category == LEVELS[1], 2).when(category == LEVELS[2], 3).otherwise(4)


def importance_rank(importance: Column) -> Column:
    """By severity and not by collation: 高, 中, 低, then all else."""
    return F.when(importance == IMPORTANCE[0], 1).when(importance == IMPORTANCE[1], 2).when(importance == IMPORTANCE[2], 3).otherwise(4)


def adjacency(edges: DataFrame, most: int | None = None) -> DataFrame:
    """src, place, dst, type, weight: the edges of each node, the heaviest first; with most, so many of each."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc_nulls_last("weight"), "dst", "type"))
    ranked = edges.withColumn("place", place)
    ranked = ranked if most is None else ranked.where(F.col("place") <= most)
    return ranked.select("src", "place", "dst", "type", "weight")


def entity_detail(entities: DataFrame, edges: DataFrame, entity: int) -> DataFrame:
    """id, name, entity_type, n_out, n_in of one entity; no row if it is unknown."""
    touching = edges.where((F.col("src") == entity) | (F.col("dst") == entity))
    counts = touching.agg(F.count_if(F.col("src") == entity).alias("n_out"), F.count_if(F.col("dst") == entity).alias("n_in"))
    return entities.where(F.col("id") == entity).select("id", "name", "entity_type").join(F.broadcast(counts), F.lit(True))


def normalize_formulas(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """name, expression, inputs, output, conditions, example: both of the first are needed, the others have blank defaults."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    kept = raw.select(F.trim("name").alias("name"), F.trim("expression").alias("expression"), F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"), blank("output"), blank("conditions"), blank("example"), *keep)
    return kept.where((F.col("name") != "") & (F.col("expression") != ""))


def normalize_pairs(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """concept_a, concept_b, distinction, typical_question of two different named concepts."""
    a, b = F.trim("concept_a"), F.trim("concept_b")
    said = F.coalesce("distinction", F.concat(a, F.lit("与"), b, F.lit("的区别需要结合具体场景分析")))
    kept = raw.select(a.alias("concept_a"), b.alias("concept_b"), said.alias("distinction"), F.coalesce("typical_question", F.lit("")).alias("typical_question"), *keep)
    return kept.where((F.col("concept_a") != "") & (F.col("concept_b") != "") & (F.col("concept_a") != F.col("concept_b")))


def extractable(chunks: DataFrame, least: int = 50, most: int = 3000) -> DataFrame:
    """chunks(id, content) that are worth an extraction: of `least` characters at least, cut to `most`."""
    return chunks.select("id", F.trim("content").alias("content")).where(F.length("content") >= least).select("id", F.left("content", F.lit(most)).alias("content"))


def match_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """name, entity_type, match, kind of found(name, entity_type) among known(id, name, entity_type, aliases).

    exact: a known name or alias and its type; type_diff: of another type; fuzzy: the nearest known name within two edits. The
    least id wins among equals. match and kind are null for a new entity.
    """
    wanted = found.select("name", "entity_type").distinct()
    named = known.select(F.col("id").alias("k_id"), F.col("entity_type").alias("k_type"), F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k_name"))
    held = wanted.join(named, F.col("name") == F.col("k_name"), "left")
    best = F.min(F.when(F.col("k_id").isNotNull(), F.struct((F.col("k_type") != F.col("entity_type")).alias("differs"), "k_id")))
    by_name = held.groupBy("name", "entity_type").agg(best.alias("best"))
    rest = by_name.where("best IS NULL").select("name")
    near = graph.match_names(rest, known.select("id", "name")).select(F.col("name").alias("n_name"), F.col("match").alias("near"))
    joined = by_name.join(near, F.col("name") == F.col("n_name"), "left")
    kind = F.when(F.col("best").isNotNull(), F.when(F.col("best.differs"), "type_diff").otherwise("exact")).when(F.col("near").isNotNull(), "fuzzy")
    return joined.select("name", "entity_type", F.coalesce("best.k_id", "near").alias("match"), kind.alias("kind"))


def upsert_entities(known: DataFrame, found: DataFrame) -> DataFrame:
    """known(id, name, entity_type, aliases, chunk_ids) after found(name, entity_type, chunk_id) is merged in.

    All that is found is matched with what was known before, so the result does not depend on an order: exact adds the chunks;
    fuzzy adds the chunks and the name as an alias; type_diff adds the name as an alias and makes name(type) a new entity; what
    matches nothing is new. A new entity's id is a hash of its name and type. Arrays are distinct and sorted.
    """
    matched = match_entities(found, known)
    own = found.select(F.col("name").alias("f_name"), F.col("entity_type").alias("f_type"), "chunk_id")
    rows = own.join(matched, (F.col("f_name") == F.col("name")) & (F.col("f_type") == F.col("entity_type")))
    merges = F.col("kind").isin("exact", "fuzzy")
    gained = rows.where("kind IS NOT NULL").groupBy(F.col("match").alias("g_id")).agg(
        F.collect_set(F.when(merges, F.col("chunk_id"))).alias("more"), F.collect_set(F.when(F.col("kind") != "exact", F.col("name"))).alias("names")
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    both = lambda a, b, kind: F.array_sort(F.array_union(F.coalesce(a, none(kind)), F.coalesce(b, none(kind))))
    kept = known.join(gained, F.col("id") == F.col("g_id"), "left").select("id", "name", "entity_type", both("aliases", "names", "string").alias("aliases"), both("chunk_ids", "more", "long").alias("chunk_ids"))
    clash = F.col("kind") == "type_diff"
    fresh = rows.where(~F.coalesce(merges, F.lit(False))).select(
        F.when(clash, F.concat("name", F.lit("("), "entity_type", F.lit(")"))).otherwise(F.col("name")).alias("name"), "entity_type", F.when(clash, F.col("name")).alias("alias"), "chunk_id"
    )
    made = fresh.groupBy("name", "entity_type").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    # A name(type) that is known already gains the chunks.
    there = kept.select(F.col("name").alias("t_name"), F.col("entity_type").alias("t_type"))
    new = made.join(there, (F.col("name") == F.col("t_name")) & (F.col("entity_type") == F.col("t_type")), "left_anti")
    again = made.join(there, (F.col("name") == F.col("t_name")) & (F.col("entity_type") == F.col("t_type")), "left_semi").select(F.col("name").alias("a_name"), F.col("entity_type").alias("a_type"), F.col("chunk_ids").alias("a_ids"))
    merged = kept.join(again, (F.col("name") == F.col("a_name")) & (F.col("entity_type") == F.col("a_type")), "left").select("id", "name", "entity_type", "aliases", both("chunk_ids", "a_ids", "long").alias("chunk_ids"))
    return merged.unionByName(new.select(F.shiftrightunsigned(F.xxhash64("name", "entity_type"), 1).alias("id"), "name", "entity_type", "aliases", "chunk_ids"))


def resolve_names(rows: DataFrame, entities: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with ids in place of names or aliases, the least of several, under the new names; rows with an unknown one go."""
    named = entities.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).groupBy("n").agg(F.min("id").alias("id"))
    for name, to in columns.items():
        rows = rows.join(named.select(F.col("n").alias(f"{to}_name"), F.col("id").alias(to)), F.col(name) == F.col(f"{to}_name")).drop(f"{to}_name")
    return rows.select(*columns.values(), *[c for c in rows.columns if c not in columns and c not in columns.values()])


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst and the other columns of relations(source, target, ...): names or aliases to ids; rows of which an end is unknown go."""
    return resolve_names(relations, entities, {"source": "src", "target": "dst"})


def merge_relations(known: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (src, dst, type): the greatest confidence and the distinct chunk ids, sorted; loops go.

    Where both have a description, that of new is taken, of its greatest chunk id, else the known one; a formula stays as it was
    first stated. Chunk ids are made distinct before they come together.
    """
    there = [c for c in ("description", "formula") if c in known.columns and c in new.columns]
    columns = ["src", "dst", "type", "confidence", "chunk_ids", *there]
    side = lambda frame, n: frame.select(*columns, F.lit(n).alias("side"), F.coalesce(F.array_max("chunk_ids"), F.lit(-1)).alias("last"))
    both = side(known, 0).unionByName(side(new, 1)).where(F.col("src") != F.col("dst"))
    told = {"description": lambda c: F.max_by(c, F.struct("side", "last", c)), "formula": lambda c: F.min_by(c, F.when(c.isNotNull(), F.struct("side", "last", c)))}
    said = both.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), *[told[c](F.col(c)).alias(c) for c in there])
    chunks = both.select("src", "dst", "type", F.explode("chunk_ids").alias("c")).distinct().groupBy("src", "dst", "type").agg(F.array_sort(F.collect_list("c")).alias("ids"))
    keys = ["src", "dst", "type"]
    return said.join(chunks, keys, "left").select(*keys, "confidence", F.coalesce("ids", F.array().cast("array<long>")).alias("chunk_ids"), *there)


def link_formulas(formulas: DataFrame, entities: DataFrame) -> DataFrame:
    """formulas(name, ..., chunk_id) with entity_id, the entity of that name or alias; those of no entity go."""
    return resolve_names(formulas, entities, {"name": "entity_id"})


def link_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """a, b and what is said of pairs(concept_a, concept_b, ...) whose concepts are both known and not the same; each pair once, under
    a < b, as the greatest chunk id says it."""
    linked = resolve_names(pairs, entities, {"concept_a": "x", "concept_b": "y"}).where("x != y")
    rest = [c for c in pairs.columns if c not in ("concept_a", "concept_b", "chunk_id")]
    last = linked.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.struct("chunk_id", *rest)).alias("s"))
    return last.select("a", "b", *[F.col(f"s.{c}") for c in rest])


def build_graph(chunks: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, ...]], known: DataFrame, relations: DataFrame, formulas: DataFrame | None = None, pairs: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """The graph after chunks(id, content) went through extract, as (entities, relations, stats), and after these (formulas, pairs) if
    extract finds some.

    extract: from the chunks worth it to (name, entity_type, importance, chunk_id) and (source, target, type, confidence,
    chunk_id), and where it has them formulas(name, expression, inputs, output, conditions, example, chunk_id) and pairs(concept_a,
    concept_b, distinction, typical_question, chunk_id). What is known already, of each kind, is merged with what is found. stats:
    what, n.
    """
    found_in = extract(extractable(chunks))
    raw_entities, raw_relations = found_in[:2]
    found = graph.normalize_entities(raw_entities, keep=["chunk_id"])
    entities = graph.cut(upsert_entities(known, found))
    more = [c for c in ("description", "formula") if c in raw_relations.columns]
    stated = graph.normalize_relations(raw_relations, keep=["chunk_id", *more]).withColumn("chunk_ids", F.array("chunk_id")).drop("chunk_id")
    merged = graph.cut(merge_relations(relations, resolve_relations(stated, entities)))
    counts = [("entities", entities), ("relations", merged), ("chunks", extractable(chunks))]
    out = []
    if len(found_in) > 2:
        told = graph.cut(link_formulas(normalize_formulas(found_in[2], keep=["chunk_id"]), entities))
        out.append(told if formulas is None else formulas.unionByName(told).distinct())
        said = link_pairs(normalize_pairs(found_in[3], keep=["chunk_id"]), entities)
        if pairs is not None:  # what is said anew counts
            said = said.unionByName(pairs.join(said.select("a", "b"), ["a", "b"], "left_anti"))
        out.append(graph.cut(said))
        counts += [("formulas", out[0]), ("pairs", out[1])]
    stats = reduce(DataFrame.union, [frame.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, frame in counts])
    return entities, merged, stats, *out


def knowledge_search(chunks: DataFrame, entities: DataFrame, edges: DataFrame, pairs: DataFrame, query: str, words: list[str], k: int = 10, hops: int = 3, seeds: int = 5, reach: int = 50) -> DataFrame:
    """part, place, id, text: what a question finds in the graph.

    entity: entities linked by trigrams; path: names from a linked entity to what is two or more hops away; pair: pairs of
    easily confused entities that touch one; chunk: chunks of the linked and reached entities, by id; fallback: one row if no
    chunk was found. entities: id, name, chunk_ids; pairs: a, b (ids).
    """
    linked = graph.cut(graph.link_entities(entities, query, words))
    start = linked.orderBy(F.desc("score"), "id").limit(seeds).select("id")
    visited = graph.bfs(edges, start, hops).orderBy("depth", "id").limit(reach)
    visited = graph.cut(visited)
    ids = entities.join(visited.select("id").union(start).distinct(), "id").select(F.explode("chunk_ids").alias("id")).distinct()
    hits = graph.cut(chunks.join(ids, "id", "left_semi").orderBy("id").limit(k).select("id", F.left("content", F.lit(500)).alias("text")))
    numbered = lambda frame, part, *order: frame.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(part).alias("part"), F.col("place").cast("int"), "id", "text")  # noqa: E731  of some rows at most
    touched = pairs.join(start.select(F.col("id").alias("s_id")), (F.col("a") == F.col("s_id")) | (F.col("b") == F.col("s_id")), "left_semi").orderBy("a", "b").limit(5)
    names = entities.select(F.col("id").alias("n_id"), F.col("name").alias("n_name"))
    told = touched.join(names, F.col("a") == F.col("n_id")).select("a", "b", F.col("n_name").alias("x")).join(names, F.col("b") == F.col("n_id")).select(F.col("a").alias("id"), "b", F.concat_ws(" / ", "x", "n_name").alias("text"))
    parts = [
        numbered(linked.select("id", F.col("name").alias("text"), "score"), "entity", F.desc("score"), F.col("id")),
        numbered(graph.paths(visited, entities, 2, 10).select(F.lit(None).cast("long").alias("id"), F.col("path").alias("text")), "path", F.col("text")),
        numbered(told, "pair", F.col("id"), F.col("b")), numbered(hits, "chunk", F.col("id")),
    ]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    empty = hits.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("fallback").alias("part"), F.lit(1).alias("place"), F.lit(None).cast("long").alias("id"), F.lit(query).alias("text"))
    return out.union(empty)


def graph_or_vector_search(chunks: DataFrame, entities: DataFrame, edges: DataFrame, words: list[str], vector: list[float], k: int = 5) -> DataFrame:
    """Graph search over entities(id, name, category, chunk_ids), ordered by level; vector search if it finds nothing."""
    found = graph.cut(search.graph_search(chunks, entities.withColumn("rank", level_rank(F.col("category"))), edges, words, k))
    if found.limit(1).count():
        return found
    return search.vector_search(chunks, vector, k).select("id", "content", "similarity")


def tutor_query(question: Column, risk: Column, reason: Column, kind: Column) -> Column:
    """What is there of question, risk, reason and type, joined; a general question about the type if nothing is."""
    there = lambda c: F.nullif(c, F.lit(""))
    about = F.when(kind != "未知", F.concat(there(kind), F.lit(" 审计")))
    said = F.concat_ws("；", there(question), there(risk), there(reason), about)
    return F.when(said == "", F.concat(F.coalesce(kind, F.lit("")), F.lit(" 审计风险 辅导"))).otherwise(said)


def tutoring_search(chunks: DataFrame, query: list[float], k: int = 5, most: int = 600) -> DataFrame:
    """The k nearest chunks, cut to what a tutor's prompt holds."""
    return search.vector_search(chunks, query, k).select("id", "source_label", F.left("content", F.lit(most)).alias("content"), "similarity")


def three_part_context(books: DataFrame, history: DataFrame, archive: DataFrame, most: int = 500) -> DataFrame:
    """One row: the contents of three sources(id, content, similarity), each numbered from the most similar on under its title."""
    titles = (("教材知识库检索结果：", books), ("历史相关问答：", history), ("归档知识库检索结果：", archive))
    rows = [frame.select(F.lit(i).alias("part"), "id", "content", "similarity") for i, (_, frame) in enumerate(titles)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    lines = F.array_sort(F.collect_list(F.struct("part", (-F.col("similarity")).alias("s"), "id", F.left("content", F.lit(most)).alias("c"))))
    one = every.agg(lines.alias("lines"))
    told = lambda i, title: F.filter(F.transform(F.filter("lines", lambda x: x["part"] == i), lambda x, n: F.concat((n + 1).cast("string"), F.lit(". "), x["c"], F.lit("..."))), lambda x: x.isNotNull())
    sections = [F.when(F.size(told(i, t)) > 0, F.concat(F.lit(t + "\n\n"), F.array_join(told(i, t), "\n\n"))) for i, (t, _) in enumerate(titles)]
    return one.select(F.concat_ws("\n\n", *sections).alias("context"))
