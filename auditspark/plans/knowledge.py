"""Queries over building and searching the knowledge graph, tutoring and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import knowledge_text
from ..operators import knowledge, search
from . import views as v
from .registry import query
from .retrieval import GRAMS, Q, VECTOR, WORDS, keyed, near

WEIGHTED = "weighted AS (SELECT l_suppkey AS src, l_partkey AS dst, 'supplies' AS type, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


def _weighted(spark, d):
    rows = v.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    return rows.select("src", "dst", F.lit("supplies").alias("type"), "weight")


@query(f"WITH {WEIGHTED} SELECT src, place, dst FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst))::INT AS place FROM weighted) WHERE place <= 3")
def heaviest_edges(spark, d):
    return knowledge.adjacency(_weighted(spark, d), 3).select("src", "place", "dst")


LEVELS = "CASE id % 4 WHEN 0 THEN '章' WHEN 1 THEN '编' WHEN 2 THEN '节' ELSE 'x' END"
RANKED = f"ranked AS (SELECT *, {LEVELS} AS category, CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END AS rank, [id % 500, (id + 7) % 500] AS ids FROM entities)"


def _leveled(spark, d):
    k = F.col("id") % 4
    level = F.when(k == 0, "章").when(k == 1, "编").when(k == 2, "节").otherwise("x")
    return v.entities(spark, d).withColumn("category", level).withColumn("chunk_ids", F.array(F.col("id") % 500, (F.col("id") + 7) % 500))


@query(f"""WITH {v.CHUNKS}, {v.GRAPH}, {RANKED},
seeds AS (SELECT id FROM ranked WHERE name LIKE '%00000%' ORDER BY rank, id LIMIT 20),
down AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
up AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
picked AS (SELECT DISTINCT unnest(ids) AS id FROM ranked WHERE id IN (SELECT id FROM seeds UNION SELECT id FROM down UNION SELECT id FROM up) ORDER BY 1 LIMIT 30)
SELECT id, 0.85::DOUBLE AS similarity FROM chunks WHERE id IN (SELECT id FROM picked) ORDER BY id LIMIT 10""")
def graph_search_by_level(spark, d):
    """Entities of chapters come first, then sections, then parts."""
    return knowledge.graph_or_vector_search(v.chunks(spark, d), _leveled(spark, d), v.edges(spark, d), ["00000"], VECTOR, 10).select("id", "similarity")


@query(f"WITH {v.CHUNKS} SELECT id, similarity FROM ({near(10)})")
def graph_search_fallback(spark, d):
    """Nothing matches in the graph, so vectors are searched."""
    return knowledge.graph_or_vector_search(v.chunks(spark, d), _leveled(spark, d), v.edges(spark, d), ["no such name"], VECTOR, 10).select("id", "similarity")


@query(f"WITH {v.GRAPH} SELECT x.id, x.name, x.entity_type, (SELECT count(*) FROM edges WHERE src = x.id) AS n_out, (SELECT count(*) FROM edges WHERE dst = x.id) AS n_in FROM entities x WHERE x.id = 2000004")
def entity_detail(spark, d):
    return knowledge.entity_detail(v.entities(spark, d), v.edges(spark, d), 2000004)


@query("SELECT s_suppkey, importance FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '低' WHEN 1 THEN '高' WHEN 2 THEN '中' END AS importance, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS r FROM supplier) ORDER BY r, s_suppkey LIMIT 40")
def entities_by_importance(spark, d):
    k = F.col("s_suppkey") % 4
    rows = v.table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, "低").when(k == 1, "高").when(k == 2, "中").alias("importance"))
    return rows.orderBy(knowledge.importance_rank(F.col("importance")), "s_suppkey").limit(40)


KNOWN = """known AS (SELECT min(p_partkey) AS id, p_name AS name, 'Concept' AS entity_type, CASE WHEN p_name LIKE 'red%' THEN ['alias of ' || p_name] ELSE [] END AS aliases, [min(p_partkey)] AS chunk_ids FROM part WHERE p_partkey % 2 = 0 AND p_name LIKE '%t%' GROUP BY p_name),
found AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 't', 'd') WHEN 2 THEN 'alias of ' || p_name ELSE 'thing ' || p_size END AS name, CASE WHEN p_size % 3 = 0 THEN 'Rule' ELSE 'Concept' END AS entity_type, p_partkey AS chunk_id FROM part),
wanted AS (SELECT DISTINCT name, entity_type FROM found),
named AS (SELECT id, entity_type AS k_type, name AS n FROM known UNION SELECT id, entity_type, unnest(aliases) FROM known),
direct AS (SELECT w.name, w.entity_type, arg_min(k.id, (k_type != w.entity_type)::INT * 100000000 + k.id) AS match, bool_and(k_type != w.entity_type) AS differs FROM wanted w JOIN named k ON w.name = k.n GROUP BY 1, 2),
near AS (SELECT w.name, arg_min(k.id, levenshtein(w.name, k.name) * 100000000 + k.id) AS match FROM (SELECT DISTINCT name FROM wanted) w JOIN known k ON levenshtein(w.name, k.name) <= 2 AND length(w.name) >= 3 AND length(k.name) >= 3 GROUP BY 1),
matched AS (SELECT w.name, w.entity_type, coalesce(d.match, n.match) AS match, CASE WHEN d.match IS NOT NULL THEN CASE WHEN differs THEN 'type_diff' ELSE 'exact' END WHEN n.match IS NOT NULL THEN 'fuzzy' END AS kind
  FROM wanted w LEFT JOIN direct d ON w.name = d.name AND w.entity_type = d.entity_type LEFT JOIN near n ON w.name = n.name)"""


def _known(spark, d):
    p = v.table(spark, d, "part").where((F.col("p_partkey") % 2 == 0) & F.like("p_name", F.lit("%t%")))
    rows = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    aliases = F.when(F.col("name").startswith("red"), F.array(F.concat(F.lit("alias of "), "name"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", "name", F.lit("Concept").alias("entity_type"), aliases.alias("aliases"), F.array("id").alias("chunk_ids"))


def _found(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit("t"), F.lit("d"))).when(k == 2, F.concat(F.lit("alias of "), "p_name")).otherwise(F.concat(F.lit("thing "), "p_size"))
    return v.table(spark, d, "part").select(name.alias("name"), F.when(F.col("p_size") % 3 == 0, "Rule").otherwise("Concept").alias("entity_type"), F.col("p_partkey").alias("chunk_id"))


@query(f"WITH {KNOWN} SELECT * FROM matched")
def entity_matches(spark, d):
    return knowledge.match_entities(_found(spark, d), _known(spark, d))


@query(f"""WITH {KNOWN}, rows AS (SELECT f.*, m.match, m.kind FROM found f JOIN matched m USING (name, entity_type)),
kept AS (SELECT k.name, k.entity_type, list_sort(list_distinct(list_concat(k.aliases, coalesce((SELECT list(DISTINCT r.name) FROM rows r WHERE r.match = k.id AND r.kind != 'exact'), [])))) AS aliases,
  list_sort(list_distinct(list_concat(k.chunk_ids, coalesce((SELECT list(DISTINCT r.chunk_id) FROM rows r WHERE r.match = k.id AND r.kind IN ('exact', 'fuzzy')), [])))) AS chunk_ids FROM known k),
made AS (SELECT CASE WHEN kind = 'type_diff' THEN name || '(' || entity_type || ')' ELSE name END AS name, entity_type, list_sort(list_distinct(list(CASE WHEN kind = 'type_diff' THEN name END))) AS aliases, list_sort(list_distinct(list(chunk_id))) AS chunk_ids
  FROM rows WHERE kind IS NULL OR kind = 'type_diff' GROUP BY 1, 2)
SELECT name, entity_type, array_to_string(aliases, '|') AS aliases, array_to_string(chunk_ids, ',') AS chunk_ids FROM (SELECT * FROM kept UNION ALL SELECT * FROM made)""")
def entity_upsert(spark, d):
    merged = knowledge.upsert_entities(_known(spark, d), _found(spark, d))
    return merged.select("name", "entity_type", F.array_join("aliases", "|").alias("aliases"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"""WITH {KNOWN}, stated AS (SELECT p_name AS source, 'alias of red bolt' AS target, 'references' AS type, p_partkey AS chunk_id FROM part)
SELECT k.id AS src, t.id AS dst, s.type, s.chunk_id FROM stated s JOIN (SELECT n, min(id) AS id FROM named GROUP BY 1) k ON s.source = k.n JOIN (SELECT n, min(id) AS id FROM named GROUP BY 1) t ON s.target = t.n""")
def relations_resolved(spark, d):
    """Names to ids; what is unknown on either side goes."""
    stated = v.table(spark, d, "part").select(F.col("p_name").alias("source"), F.lit("alias of red bolt").alias("target"), F.lit("references").alias("type"), F.col("p_partkey").alias("chunk_id"))
    return knowledge.resolve_relations(stated, _known(spark, d))


@query("""WITH c AS (SELECT doc_id AS id, left(trim(text, ' '), 3000) AS content, lang, source FROM documents WHERE length(trim(text, ' ')) >= 50),
e AS (SELECT DISTINCT lang AS name FROM c UNION SELECT DISTINCT source FROM c),
r AS (SELECT lang, source, list_sort(list(id)) AS ids FROM c GROUP BY 1, 2)
SELECT 'entities' AS what, (SELECT count(*) FROM e)::BIGINT AS n UNION ALL SELECT 'relations', (SELECT count(*) FROM r)::BIGINT UNION ALL SELECT 'chunks', (SELECT count(*) FROM c)::BIGINT""")
def graph_build_stats(spark, d):
    """A build over all documents, with an extractor that names each document's language and source."""
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    told = v.table(spark, d, "documents").select(F.col("doc_id").alias("t_id"), "lang", "source")

    def extract(chunks):
        rows = chunks.join(told, F.col("id") == F.col("t_id"))
        named = rows.select(F.explode(F.array("lang", "source")).alias("name"), F.lit("").alias("entity_type"), F.lit(None).cast("string").alias("importance"), F.col("id").alias("chunk_id"))
        return named, rows.select(F.col("lang").alias("source"), F.col("source").alias("target"), F.lit("references").alias("type"), F.lit(None).cast("double").alias("confidence"), F.col("id").alias("chunk_id"))

    known = spark.createDataFrame([], "id long, name string, entity_type string, aliases array<string>, chunk_ids array<long>")
    relations = spark.createDataFrame([], "src long, dst long, type string, confidence double, chunk_ids array<long>")
    return knowledge.build_graph(docs, extract, known, relations)[2]


@query("SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS type, max(l_discount) AS confidence, count(DISTINCT l_orderkey) AS n_chunks FROM lineitem WHERE l_suppkey != l_partkey GROUP BY 1, 2, 3")
def relations_merged(spark, d):
    """Repeated relations become one, with the greatest confidence; the number of distinct chunks is a measure."""
    rows = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), F.array("l_orderkey").alias("chunk_ids"))
    return knowledge.merge_relations(rows, rows.limit(0)).select("src", "dst", "type", "confidence", F.size("chunk_ids").cast("long").alias("n_chunks"))


@query("SELECT p_partkey, coalesce(len(CASE WHEN p_size > 25 THEN [p_name, p_brand] END), 0)::INT AS n_chunks FROM part")
def array_measure(spark, d):
    """The length of an array as a measure; a missing or empty one counts 0."""
    ids = F.when(F.col("p_size") > 25, F.array("p_name", "p_brand"))
    return v.table(spark, d, "part").select("p_partkey", F.coalesce(F.array_size(ids), F.lit(0)).alias("n_chunks"))


@query("SELECT trim(p_name) AS name, 'x = ' || p_size AS expression, '' AS output FROM part WHERE p_size % 3 > 0")
def formulas_normalized(spark, d):
    s = F.col("p_size")
    raw = v.table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("name"), F.when(s % 3 > 0, F.concat(F.lit("x = "), s)).otherwise("  ").alias("expression"), F.lit(None).cast("array<string>").alias("inputs"), *[F.lit(None).cast("string").alias(c) for c in ("output", "conditions", "example")])
    return knowledge.normalize_formulas(raw).select("name", "expression", "output")


@query("SELECT n_name AS concept_a, r_name AS concept_b, CASE WHEN n_nationkey % 2 = 0 THEN 'd' ELSE n_name || '与' || r_name || '的区别需要结合具体场景分析' END AS distinction FROM nation JOIN region ON n_regionkey = r_regionkey")
def confusion_normalized(spark, d):
    rows = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.when(F.col("n_nationkey") % 2 == 0, "d")
    raw = rows.select(F.concat("n_name", F.lit(" ")).alias("concept_a"), F.col("r_name").alias("concept_b"), said.alias("distinction"), F.lit(None).cast("string").alias("typical_question"))
    blank = rows.select("n_name", F.lit(" "), said, F.lit("q"))
    same = rows.select("n_name", F.concat(F.lit(" "), "n_name"), said, F.lit("q"))
    return knowledge.normalize_pairs(raw.union(blank).union(same)).select("concept_a", "concept_b", "distinction")


@query("SELECT doc_id AS id, left(trim(text, ' '), 3000) AS content FROM documents WHERE length(trim(text, ' ')) >= 50")
def extractable_chunks(spark, d):
    return knowledge.extractable(v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def _sim(a: str, b: str) -> str:
    return f"len(list_intersect({GRAMS.format(a)}, {GRAMS.format(b)})) / len(list_distinct(list_concat({GRAMS.format(a)}, {GRAMS.format(b)})))"


_NAME, _LIKE = "'NATION_12'", "'%NATION_12%'"


@query(f"""WITH RECURSIVE {v.CHUNKS}, {v.GRAPH}, linked AS (SELECT id, name, round(greatest({_sim('name', _NAME)}, {_sim('name', _LIKE)}), 6) AS score FROM entities WHERE name ILIKE '%NATION_12%' ORDER BY score DESC, id LIMIT 20),
seeds AS (SELECT id FROM linked ORDER BY score DESC, id LIMIT 5),
steps AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
walk(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT s.dst, w.depth + 1 FROM walk w JOIN steps s ON w.id = s.src WHERE w.depth < 2),
visited AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1 ORDER BY depth, id LIMIT 50),
up AS (SELECT w.id, min(s.src) AS parent FROM visited w JOIN steps s ON s.dst = w.id JOIN visited p ON p.id = s.src AND p.depth = w.depth - 1 GROUP BY 1),
paths AS (SELECT DISTINCT concat_ws(' → ', a.name, b.name, c.name) AS path FROM visited w JOIN up u ON w.id = u.id JOIN up t ON u.parent = t.id JOIN entities a ON a.id = t.parent JOIN entities b ON b.id = u.parent JOIN entities c ON c.id = w.id WHERE w.depth = 2 ORDER BY path LIMIT 10),
hits AS (SELECT id, left(content, 500) AS text FROM chunks WHERE id IN (SELECT unnest([id % 500, (id + 7) % 500]) FROM visited) ORDER BY id LIMIT 10)
SELECT part, place::INT AS place, id, text FROM (
  SELECT 'entity' AS part, row_number() OVER (ORDER BY score DESC, id) AS place, id, name AS text FROM linked
  UNION ALL SELECT 'path', row_number() OVER (ORDER BY path), NULL, path FROM paths
  UNION ALL SELECT 'pair', row_number() OVER (ORDER BY a, b), a, x.name || ' / ' || y.name FROM (SELECT n_nationkey::BIGINT + 2000000 AS a, (n_nationkey::BIGINT + 7) % 25 + 2000000 AS b FROM nation) p JOIN entities x ON a = x.id JOIN entities y ON b = y.id WHERE a IN (SELECT id FROM seeds) OR b IN (SELECT id FROM seeds)
  UNION ALL SELECT 'chunk', row_number() OVER (ORDER BY id), id, text FROM hits
  UNION ALL SELECT 'fallback', 1, NULL, 'NATION_12' WHERE NOT EXISTS (SELECT 1 FROM hits))""")
def knowledge_graph_search(spark, d):
    """Linked entities, paths, pairs and chunks of a question."""
    n = F.col("n_nationkey").cast("long")
    pairs = v.table(spark, d, "nation").select((n + 2000000).alias("a"), ((n + 7) % 25 + 2000000).alias("b"))
    return knowledge.knowledge_search(v.chunks(spark, d), _leveled(spark, d), v.edges(spark, d), pairs, "NATION_12", ["NATION_12"], hops=2)


@query("""SELECT c_custkey, CASE WHEN said = '' THEN kind || ' 审计风险 辅导' ELSE said END AS query FROM (SELECT c_custkey, kind, concat_ws('；', CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, nullif('', ''), CASE WHEN kind != '未知' THEN kind || ' 审计' END) AS said
  FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN '未知' ELSE c_mktsegment END AS kind FROM customer))""")
def tutor_queries(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, "未知").otherwise(F.col("c_mktsegment"))
    return v.table(spark, d, "customer").select("c_custkey", knowledge.tutor_query(F.when(k % 3 == 0, F.col("c_name")), F.when(k % 5 == 0, F.col("c_mktsegment")), F.lit(""), kind).alias("query"))


@query(f"WITH {v.CHUNKS} SELECT id, concat_ws(' > ', course, book) AS source_label, left(content, 600) AS content, similarity FROM ({near(8)})")
def tutoring_search(spark, d):
    return knowledge.tutoring_search(v.chunks(spark, d), VECTOR, 8)


@query(f"""WITH {v.CHUNKS}, {v.QA}, b AS (SELECT id, left(content, 500) AS c, similarity FROM ({near(10)})),
h AS (SELECT conv_id * 8 + turn AS id, left('问题：' || question || chr(10) || '答案：' || left(answer, 500), 500) AS c, round(1 - list_distance(embedding::DOUBLE[], {Q}), 6) AS similarity FROM qa JOIN embeddings ON vec_id = conv_id * 8 + turn ORDER BY similarity DESC, id LIMIT 5),
k AS (SELECT id, left('知识点：' || label || chr(10) || '摘要：' || left(content, 20) || chr(10) || '内容：' || content, 500) AS c, similarity FROM (SELECT *, round(1 - list_distance(embedding, {Q}), 6) AS similarity FROM chunks WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 3)),
told AS (SELECT '教材知识库检索结果：' AS title, 0 AS part, string_agg(n || '. ' || c || '...', chr(10) || chr(10) ORDER BY n) AS body FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM b)
  UNION ALL SELECT '历史相关问答：', 1, string_agg(n || '. ' || c || '...', chr(10) || chr(10) ORDER BY n) FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM h)
  UNION ALL SELECT '归档知识库检索结果：', 2, string_agg(n || '. ' || c || '...', chr(10) || chr(10) ORDER BY n) FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM k))
SELECT string_agg(title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY part) AS context FROM told WHERE body IS NOT NULL""")
def three_part_context(spark, d):
    """Books, history and archived knowledge, each under its title."""
    books = search.vector_search(v.chunks(spark, d), VECTOR, 10)
    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    qa = v.qa_history(spark, d).join(e, F.col("vec_id") == F.col("conv_id") * 8 + F.col("turn"))
    told = F.concat(F.lit("问题："), "question", F.lit("\n答案："), F.left("answer", F.lit(500)))
    history = search.archived_search(qa.select(F.col("vec_id").alias("id"), told.alias("content"), "embedding"), VECTOR, 5, -9.0)
    kept = v.chunks(spark, d).where("embedding IS NOT NULL").select("id", knowledge_text(F.col("label").cast("string"), F.left("content", F.lit(20)), F.col("content")).alias("content"), "embedding")
    archive = search.archived_search(kept, VECTOR, 3, -9.0)
    return knowledge.three_part_context(books.select("id", "content", "similarity"), history.select("id", "content", "similarity"), archive.select("id", "content", "similarity"))


MODES = ("vector", "bm25", "hybrid", "graph", "other")


@query(f"""WITH {v.CHUNKS}, {v.GRAPH}, {RANKED},
fused AS (SELECT source_id::VARCHAR || left(content, 50) AS key, side, id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY side ORDER BY similarity DESC, id)) AS points FROM (SELECT id, source_id, content, similarity, 0 AS side FROM ({near(10)}) UNION ALL SELECT id, source_id, content, similarity, 1 FROM ({keyed(10)}))),
seeds AS (SELECT id FROM ranked WHERE name LIKE '%NATION_2%' ORDER BY rank, id LIMIT 20),
down AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
up AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
picked AS (SELECT DISTINCT unnest(ids) AS id FROM ranked WHERE id IN (SELECT id FROM seeds UNION SELECT id FROM down UNION SELECT id FROM up) ORDER BY 1 LIMIT 15)
SELECT 'vector' AS mode, id FROM ({near(5)}) UNION ALL SELECT 'other', id FROM ({near(5)}) UNION ALL SELECT 'bm25', id FROM ({keyed(5)})
UNION ALL (SELECT 'hybrid', min(id) FROM fused GROUP BY key ORDER BY round(sum(points), 9) DESC, min(id) LIMIT 5)
UNION ALL (SELECT 'graph', id FROM chunks WHERE id IN (SELECT id FROM picked) ORDER BY id LIMIT 5)""")
def search_modes(spark, d):
    """Four modes of search by name; a name that is none of them searches vectors."""
    chunks = v.chunks(spark, d)
    modes = {
        "vector": lambda: search.vector_search(chunks, VECTOR, 5), "bm25": lambda: search.keyword_search(chunks, WORDS, 5), "hybrid": lambda: search.hybrid_search(chunks, VECTOR, WORDS, 5),
        "graph": lambda: knowledge.graph_or_vector_search(chunks, _leveled(spark, d), v.edges(spark, d), ["NATION_2"], VECTOR, 5),
    }
    frames = [search.dispatch(m, modes).select(F.lit(m).alias("mode"), "id") for m in MODES]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


@query(f"WITH {v.CHUNKS} SELECT id, kind, similarity FROM (SELECT id, 'book' AS kind, similarity FROM ({near(5)}) UNION ALL SELECT id, 'key', similarity FROM ({keyed(5)}) UNION ALL (SELECT conv_id AS id, 'history', NULL FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 5)))")
def sources_concatenated(spark, d):
    """Three lists of results as one; a column that one does not have is null."""
    chunks = v.chunks(spark, d)
    near_ = search.vector_search(chunks, VECTOR, 5).select("id", F.lit("book").alias("kind"), "similarity")
    keys = search.keyword_search(chunks, WORDS, 5).select("id", F.lit("key").alias("kind"), "similarity")
    past = v.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().orderBy("id").limit(5).withColumn("kind", F.lit("history"))
    return near_.unionByName(keys).unionByName(past, allowMissingColumns=True)


@query("""WITH c AS (SELECT doc_id AS id, lang, repeat(source, 4) AS source FROM documents WHERE length(trim(text, ' ')) >= 50),
k AS (SELECT 'en' AS lang, repeat('src1', 4) AS source, 0.9::DOUBLE AS confidence, 'known' AS description, 'f = 0' AS formula),
r AS (SELECT lang, source, count(*) AS n, max(id) AS last, min(id) FILTER (id % 3 = 0) AS f FROM c WHERE lang IS NOT NULL AND source IS NOT NULL AND lang <> source GROUP BY 1, 2)
SELECT 'relation' AS what, coalesce(r.lang, k.lang) || '>' || coalesce(r.source, k.source) AS key,
  concat_ws('|', greatest(coalesce(k.confidence, 0.5), 0.5), coalesce(n, 0) + CASE WHEN k.lang IS NULL THEN 0 ELSE 1 END, CASE WHEN r.lang IS NULL THEN k.description ELSE 'of ' || last END, coalesce(k.formula, 'f = ' || f)) AS value
FROM r FULL JOIN k ON r.lang = k.lang AND r.source = k.source
UNION ALL SELECT 'pair', lang || '/' || source, 'by ' || last FROM r
UNION ALL SELECT 'formulas', lang, count(*)::VARCHAR FROM c WHERE lang IS NOT NULL GROUP BY 2
UNION ALL SELECT 'entities', 'all', (SELECT count(*) FROM (SELECT lang FROM c UNION SELECT source FROM c UNION SELECT 'en' UNION SELECT repeat('src1', 4)) WHERE lang IS NOT NULL)::VARCHAR""")
def graph_build_incremental(spark, d):
    """A build onto a graph that is there: merged relations with what is said of them, formulas, and pairs."""
    t = v.table(spark, d, "documents").withColumn("source", F.repeat("source", F.lit(4)))  # so that no two are within two edits
    told = t.select(F.col("doc_id").alias("t_id"), "lang", "source")

    def extract(chunks):
        rows = chunks.join(told, F.col("id") == F.col("t_id"))
        named = rows.select(F.explode(F.array("lang", "source")).alias("name"), F.lit("").alias("entity_type"), F.lit(None).cast("string").alias("importance"), F.col("id").alias("chunk_id"))
        stated = rows.select(F.col("lang").alias("source"), F.col("source").alias("target"), F.lit("references").alias("type"), F.lit(None).cast("double").alias("confidence"), F.col("id").alias("chunk_id"), F.concat(F.lit("of "), "id").alias("description"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("f = "), "id")).alias("formula"))
        blank = [F.lit(None).cast("string").alias(c) for c in ("output", "conditions", "example")]
        formulas = rows.select(F.col("lang").alias("name"), F.concat(F.lit("x = "), "id").alias("expression"), F.lit(None).cast("array<string>").alias("inputs"), *blank, F.col("id").alias("chunk_id"))
        pairs = rows.select(F.col("lang").alias("concept_a"), F.col("source").alias("concept_b"), F.concat(F.lit("by "), "id").alias("distinction"), F.lit(None).cast("string").alias("typical_question"), F.col("id").alias("chunk_id"))
        return named, stated, formulas, pairs

    known = spark.createDataFrame([(1, "en", "concept", None, [-1]), (2, "src1" * 4, "concept", None, [-1])], "id long, name string, entity_type string, aliases array<string>, chunk_ids array<long>")
    relations = spark.createDataFrame([(1, 2, "references", 0.9, [-1], "known", "f = 0")], "src long, dst long, type string, confidence double, chunk_ids array<long>, description string, formula string")
    entities, merged, _, formulas, pairs = knowledge.build_graph(t.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), extract, known, relations)
    n = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    shown = merged.join(n("src"), "src").join(n("dst"), "dst").select(F.lit("relation").alias("what"), F.concat_ws(">", "src_name", "dst_name").alias("key"), F.concat_ws("|", "confidence", F.size("chunk_ids"), "description", "formula").alias("value"))
    docs = t.select("lang", "source").distinct()
    named = pairs.join(n("a"), "a").join(n("b"), "b").join(docs, ((F.col("a_name") == F.col("lang")) & (F.col("b_name") == F.col("source"))) | ((F.col("b_name") == F.col("lang")) & (F.col("a_name") == F.col("source"))))
    said = named.select(F.lit("pair").alias("what"), F.concat_ws("/", "lang", "source").alias("key"), F.col("distinction").alias("value"))
    counted = formulas.join(n("entity_id"), "entity_id").groupBy("entity_id_name").agg(F.count("*").cast("string").alias("value")).select(F.lit("formulas").alias("what"), F.col("entity_id_name").alias("key"), "value")
    return shown.union(said).union(counted).union(entities.agg(F.count("*").cast("string").alias("value")).select(F.lit("entities").alias("what"), F.lit("all").alias("key"), "value"))
