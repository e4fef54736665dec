"""Retrieval queries. The query vector is a fixed unit direction, the query words are fixed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.segment import query_words, segmented, segmenter
from ..functions.text import keywords
from ..functions.vector import literal
from ..operators import search, trigram_index
from ..operators.graph import shared_folder
from . import views as v
from .registry import query

VECTOR = [0.25 if i % 4 == 0 else 0.0 for i in range(64)]
WORDS = ["that", "with", "Erth", "thing"]
Q = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
COVERAGE = "round((" + " + ".join(f"contains(content, '{w}')::INT" for w in WORDS) + f") / {float(len(WORDS))}, 4)"
LIKE = " OR ".join(f"content ILIKE '%{w}%'" for w in WORDS)


def near(k: int, where: str = "true") -> str:
    return f"SELECT id, source_id, content, coalesce(round(1 - dist, 6), 0) AS similarity, course, book FROM (SELECT *, round(list_distance(embedding, {Q}), 9) AS dist FROM chunks WHERE {where}) ORDER BY dist NULLS LAST, id LIMIT {k}"


def keyed(k: int) -> str:
    return f"SELECT id, source_id, content, similarity FROM (SELECT *, {COVERAGE} AS similarity FROM (SELECT * FROM chunks WHERE {LIKE} ORDER BY id LIMIT {5 * k})) ORDER BY similarity DESC, id LIMIT {k}"


@query(f"WITH {v.CHUNKS} SELECT id, source_id, concat_ws(' > ', course, book) AS source_label, similarity FROM ({near(10)})")
def vector_topk(spark, d):
    return search.vector_search(v.chunks(spark, d), VECTOR, 10).drop("content")


@query(f"""WITH {v.CHUNKS} SELECT id, similarity FROM ({near(5, "book IN ('src1', 'src2')")})""")
def vector_topk_book(spark, d):
    return search.vector_search(v.chunks(spark, d), VECTOR, 5, ["src1", "src2"]).select("id", "similarity")


@query(f"WITH {v.CHUNKS} SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE list_inner_product(embedding, {Q}) / n END, 6) AS similarity FROM (SELECT *, sqrt(list_inner_product(embedding, embedding)) * sqrt(list_inner_product({Q}, {Q})) AS n FROM chunks WHERE embedding IS NOT NULL) ORDER BY similarity DESC, id LIMIT 10")
def cosine_rules(spark, d):
    rules = v.chunks(spark, d).where(F.col("embedding").isNotNull()).select("id", "embedding")
    return search.rule_search(rules, VECTOR, 10)


@query(f"WITH {v.DREAM} SELECT id, category, confidence, similarity FROM (SELECT *, round(1 - list_distance(embedding, {Q}), 6) AS similarity FROM dream ORDER BY similarity DESC, id LIMIT 20) WHERE similarity > -0.2")
def archived_search(spark, d):
    return search.archived_search(v.dream(spark, d), VECTOR, 20, -0.2)


@query(f"WITH {v.CHUNKS} SELECT id, similarity FROM ({keyed(8)})")
def keyword_search(spark, d):
    return search.keyword_search(v.chunks(spark, d), WORDS, 8).select("id", "similarity")


RRF = f"""fused AS (SELECT source_id::VARCHAR || left(content, 50) AS key, side, id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY side ORDER BY similarity DESC, id)) AS points
  FROM (SELECT id, source_id, content, similarity, 0 AS side FROM ({near(20)}) UNION ALL SELECT id, source_id, content, similarity, 1 FROM ({keyed(20)})))"""


@query(f"WITH {v.CHUNKS}, {RRF} SELECT min(id) AS id, key, round(least(30 * sum(points), 0.99), 4) AS similarity, round(sum(points), 9) AS score FROM fused GROUP BY key ORDER BY score DESC, id LIMIT 10")
def hybrid_rrf(spark, d):
    return search.hybrid_search(v.chunks(spark, d), VECTOR, WORDS, 10)


@query(f"""WITH {v.CHUNKS}, {v.GRAPH},
ranked AS (SELECT *, [id % 500, (id + 7) % 500] AS ids FROM entities),
seeds AS (SELECT id FROM ranked WHERE name LIKE '%NATION_1%' ORDER BY id LIMIT 20),
down AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
up AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
picked AS (SELECT DISTINCT unnest(ids) AS id FROM ranked WHERE id IN (SELECT id FROM seeds UNION SELECT id FROM down UNION SELECT id FROM up) ORDER BY 1 LIMIT 30)
SELECT id, 0.85::DOUBLE AS similarity FROM chunks WHERE id IN (SELECT id FROM picked) ORDER BY id LIMIT 10""")
def graph_search_2table(spark, d):
    e = v.entities(spark, d).withColumn("rank", F.lit(0)).withColumn("chunk_ids", F.array(F.col("id") % 500, (F.col("id") + 7) % 500))
    return search.graph_search(v.chunks(spark, d), e, v.edges(spark, d), ["NATION_1"], 10).select("id", "similarity")


@query(f"WITH {v.QA} SELECT conv_id, turn, round(1 - list_distance(embedding::DOUBLE[], {Q}), 6) AS similarity FROM qa JOIN embeddings ON vec_id = conv_id * 8 + turn ORDER BY similarity DESC, conv_id, turn LIMIT 10")
def history_search(spark, d):
    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = v.qa_history(spark, d).join(e, F.col("vec_id") == F.col("conv_id") * 8 + F.col("turn"))
    scored = rows.select("conv_id", "turn", F.round(1 - search.l2_distance(F.col("embedding"), literal(VECTOR)), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "conv_id", "turn").limit(10)


@query("SELECT doc_id, list_slice(list_distinct_ordered, 1, 10)::VARCHAR AS words FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]{2,}') AS w FROM documents))")
def keyword_tokens(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(keywords(F.col("text")), ", "), F.lit("]")).alias("words"))


GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {GRAMS.format('p_name')} AS g FROM n) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.p_name < b.p_name WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.3")
def trigram_pairs(spark, d):
    """Distinct names whose trigram similarity is 0.3 or more."""
    names = v.table(spark, d, "part").select("p_name").distinct()
    return search.trigram_join(names, "p_name", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {v.CHUNKS} SELECT string_agg('[' || n || '] ' || left(content, 500), chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS n FROM ({near(5)}))")
def answer_context(spark, d):
    return search.context(search.dispatch("unknown", {"vector": lambda: search.vector_search(v.chunks(spark, d), VECTOR, 5), "bm25": lambda: search.keyword_search(v.chunks(spark, d), WORDS, 5)}))




_BUILT: dict[tuple[str, str, str], trigram_index.TrigramIndex] = {}


def _index(spark, d, kind):
    """The index of all texts, or of all names of parts: built once in a session."""
    at = (spark.sparkContext.applicationId, d, kind)
    if at not in _BUILT:
        part = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
        texts = part if kind == "part" else v.chunks(spark, d).select("id", F.col("content").alias("text"))
        _BUILT[at] = trigram_index.build_index(texts, f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}")
    return _BUILT[at]


@query(f"WITH {v.CHUNKS} SELECT id, similarity FROM ({keyed(8)})")
def keyword_search_indexed(spark, d):
    """What keyword_search finds, from candidates that the index gives."""
    found = _index(spark, d, "chunk").first_holding(v.chunks(spark, d), WORDS, "content", 5 * 8)
    return search.keyword_search(found, WORDS, 8).select("id", "similarity")


RARE = ["tion the", "Xq", "5", "erth%nnt", "nowhere9"]


@query(f"WITH {v.CHUNKS} SELECT id FROM chunks WHERE " + " OR ".join(f"content ILIKE '%{w}%'" for w in RARE))
def texts_holding(spark, d):
    """Texts that hold a phrase, a short word, a digit or a pattern, by the index of keyword_search_indexed."""
    return _index(spark, d, "chunk").holding(v.chunks(spark, d), RARE, "content").select("id")


NAMED = "n AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS name FROM part)"


@query(f"WITH {NAMED} SELECT id, name FROM n WHERE name ILIKE '%ed bo%' OR name ILIKE '%d#2%'")
def parts_holding(spark, d):
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return _index(spark, d, "part").holding(rows, ["ed bo", "d#2"], "name")


@query(f"WITH {NAMED}, g AS (SELECT id, {GRAMS.format('name')} AS g FROM n) SELECT a.id AS a, count(*) AS n, round(sum(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))), 4) AS similarity FROM g a JOIN g b ON a.id < b.id WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.9 GROUP BY 1")
def similar_parts_indexed(spark, d):
    """For each part how many later ones are named alike, from the index of parts_holding."""
    return _index(spark, d, "part").similar_later(0.9).select(F.col("id").alias("a"), "n", F.round("similarity", 4).alias("similarity"))


LATIN, DENSE = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丢两严丧中"


def _dense(c):
    """Words as ideographs, so that they are written without spaces."""
    return F.translate(F.lower(c), LATIN, DENSE)


def _dictionary(spark, d):
    """Words of the names of parts, and two names as words, by how often they stand."""
    p = v.table(spark, d, "part")
    single = p.select(F.explode(F.split("p_name", " ")).alias("word"))
    double = p.where(F.col("p_name").isin("red bolt", "blue gear")).select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word"))
    return single.union(double).select(_dense(F.col("word")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query(f"""WITH RECURSIVE w AS (SELECT translate(lower(word), '{LATIN}', '{DENSE}') AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT replace(p_name, ' ', '') FROM part WHERE p_name IN ('red bolt', 'blue gear')) GROUP BY 1),
t AS (SELECT ln(sum(n)) AS total FROM w), x AS (SELECT DISTINCT translate(lower(replace(p_name, ' ', '')), '{LATIN}', '{DENSE}') AS text FROM part),
o AS (SELECT word, ln(n) AS s FROM w WHERE word <> '' UNION ALL SELECT DISTINCT c, 0 FROM (SELECT unnest(string_split(text, '')) AS c FROM x) WHERE c NOT IN (SELECT word FROM w)),
step(text, done, score, words) AS (SELECT text, 0, 0.0::DOUBLE, []::VARCHAR[] FROM x
  UNION ALL SELECT text, done + length(word), score + s - total, list_append(words, word) FROM step, o, t WHERE substring(text, done + 1, length(word)) = word)
SELECT text, array_to_string(arg_max(words, score), '/') AS words FROM step WHERE done = length(text) GROUP BY text""")
def segmented_names(spark, d):
    """Names without spaces, cut into their most probable words."""
    names = v.table(spark, d, "part").select(_dense(F.replace("p_name", F.lit(" "), F.lit(""))).alias("text")).distinct()
    return names.select("text", F.array_join(segmented(F.col("text"), _dictionary(spark, d)), "/").alias("words"))


FOUND = [w.translate(str.maketrans(LATIN, DENSE)) for w in ("redbolt", "widget")]


@query("WITH p AS (SELECT p_partkey AS id, translate(lower(replace(p_name, ' ', '')), '" + LATIN + "', '" + DENSE + "') AS content FROM part) SELECT id, round((" + " + ".join(f"contains(content, '{w}')::INT" for w in FOUND) + ") / 2.0, 4) AS similarity FROM (SELECT * FROM p WHERE " + " OR ".join(f"content ILIKE '%{w}%'" for w in FOUND) + " ORDER BY id LIMIT 40) ORDER BY similarity DESC, id LIMIT 8")
def keyword_search_segmented(spark, d):
    """A query without spaces, cut by the dictionary, then looked for."""
    dictionary = segmenter(_dictionary(spark, d))
    words = query_words("redboltwidget".translate(str.maketrans(LATIN, DENSE)), dictionary)
    rows = v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("source_id"), _dense(F.replace("p_name", F.lit(" "), F.lit(""))).alias("content"))
    return search.keyword_search(rows, words, 8).select("id", "similarity")


@query(f"""WITH {v.CHUNKS}, {v.GRAPH},
ranked AS (SELECT *, [id % 500, (id + 7) % 500] AS ids FROM entities),
seeds AS (SELECT id FROM ranked WHERE name LIKE '%NATION_1%' ORDER BY id LIMIT 20),
down AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
up AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM seeds) ORDER BY id LIMIT 30),
picked AS (SELECT DISTINCT unnest(ids) AS id FROM ranked WHERE id IN (SELECT id FROM seeds UNION SELECT id FROM down UNION SELECT id FROM up) ORDER BY 1 LIMIT 60),
keyed AS (SELECT id FROM (SELECT *, {COVERAGE} AS similarity FROM (SELECT * FROM chunks WHERE ({LIKE}) AND (book ILIKE '%RC1%' OR book ILIKE '%src2%') ORDER BY id LIMIT 40)) ORDER BY similarity DESC, id LIMIT 8)
SELECT 'vector' AS mode, id FROM ({near(8, "book IN ('src1', 'src12')")}) UNION ALL SELECT 'keyword', id FROM keyed
UNION ALL (SELECT 'graph', id FROM chunks WHERE id IN (SELECT id FROM picked) AND (book LIKE '%c1%' OR book LIKE '%C2%') ORDER BY id LIMIT 20)""")
def searches_by_book(spark, d):
    """Three searches within books: of a name, of a part of it in any case, of a part as it is written."""
    chunks = v.chunks(spark, d)
    e = v.entities(spark, d).withColumn("rank", F.lit(0)).withColumn("chunk_ids", F.array(F.col("id") % 500, (F.col("id") + 7) % 500))
    found = {
        "vector": search.vector_search(chunks, VECTOR, 8, ["src1", "src12"]), "keyword": search.keyword_search(chunks, WORDS, 8, ["RC1", "src2"]),
        "graph": search.graph_search(chunks, e, v.edges(spark, d), ["NATION_1"], 20, books=["c1", "C2"]),
    }
    rows = [frame.select(F.lit(mode).alias("mode"), "id") for mode, frame in found.items()]
    return rows[0].union(rows[1]).union(rows[2])
