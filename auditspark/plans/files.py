"""Duplicates, quality, sampling, chunking and consolidation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import above_mean_bits, sign_bits
from ..operators import chunking, consolidate, quality
from . import views as v
from .registry import query


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, doc_id != min(doc_id) OVER (PARTITION BY md5(text)) AS is_duplicate FROM documents")
def md5_dups(spark, d):
    files = v.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    return quality.mark_duplicates(files, "md5", "doc_id").select("doc_id", "first_id", "is_duplicate")


H = "h AS (SELECT vec_id AS id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 25), lambda i: (embedding[i]::DOUBLE + embedding[i + 24]::DOUBLE + embedding[i + 40]::DOUBLE > 0)::BIGINT)), lambda a, b: a * 2 + b) AS h FROM embeddings)"


def _hashes(spark, d):
    """id, h: the 64 components of a vector folded into 24, a bit for the sign of each."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    folded = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: e(i) + e(i + 24) + e(i + 40))
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), sign_bits(folded).alias("h"))


@query(f"WITH {H} SELECT id, h FROM h")
def sign_hash(spark, d):
    return _hashes(spark, d)


@query("SELECT id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS h FROM (SELECT vec_id AS id, list_reduce(list_prepend(0::HUGEINT, list_transform(e, lambda x: (x > m)::HUGEINT)), lambda a, b: a * 2 + b) AS u FROM (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))")
def average_hash(spark, d):
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), above_mean_bits(F.col("embedding")).alias("h"))


@query(f"WITH {H}, k AS (SELECT h, min(id) AS id, h >> 16 AS bucket FROM h GROUP BY h) SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS bits FROM k a JOIN k b ON a.bucket = b.bucket AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) < 5")
def near_dup_pairs(spark, d):
    return quality.near_duplicate_pairs(_hashes(spark, d), 5, 48)


@query(f"""WITH RECURSIVE {H}, k AS (SELECT h, min(id) AS id FROM h GROUP BY h), o AS (SELECT h, id, row_number() OVER (ORDER BY id) AS n FROM k),
g(n, stay) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.n, CASE WHEN len(list_filter(g.stay, lambda s: s >> 16 = o.h >> 16 AND bit_count(xor(s, o.h)) < 5)) > 0 THEN g.stay ELSE list_append(g.stay, o.h) END FROM g JOIN o ON o.n = g.n + 1),
kept AS (SELECT unnest(stay) AS h FROM (SELECT stay FROM g ORDER BY n DESC LIMIT 1))
SELECT h.id, h.id = k.id AND k.h IN (SELECT h FROM kept) AS kept FROM h JOIN k ON h.h = k.h""")
def near_dup_greedy(spark, d):
    return quality.greedy_near_duplicates(_hashes(spark, d), 5, 48)


@query(f"WITH {H}, k AS (SELECT h, min(id) AS id FROM h GROUP BY h) SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS bits FROM k a JOIN k b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) < 3 UNION ALL SELECT k.id, h.id, 0 FROM h JOIN k ON h.h = k.h WHERE h.id != k.id")
def near_dup_global(spark, d):
    """All near pairs of hashes, whatever bucket they are in, by the least id of each, and each copy of a hash beside that id."""
    return quality.near_duplicate_links_global(_hashes(spark, d), 3)


ISSUES = "list_filter([CASE WHEN p_retailprice / 300 < 3 THEN 'file_too_small' END, CASE WHEN p_size % 17 = 0 THEN 'corrupt' END, CASE WHEN p_size % 17 > 0 AND least(p_size * 10, p_partkey % 900) < 100 THEN 'too_small' END, CASE WHEN p_size % 17 > 0 AND p_partkey % 900 > 0 AND (p_size * 10 / (p_partkey % 900)::DOUBLE < 0.2 OR p_size * 10 / (p_partkey % 900)::DOUBLE > 8) THEN 'odd_ratio' END, CASE WHEN p_partkey % 7 * 10 < 50 THEN 'blank' END], lambda x: x IS NOT NULL)"


def _images(spark, d):
    w = F.when(F.col("p_size") % 17 > 0, F.col("p_size") * 10)
    height = F.when(F.col("p_size") % 17 > 0, F.col("p_partkey") % 900)
    issues = quality.qc_issues(F.col("p_retailprice") / 300, w, height, F.col("p_partkey") % 7 * 10)
    return v.table(spark, d, "part").select("p_partkey", "p_name", issues.alias("issues"))


@query(f"SELECT p_partkey, {ISSUES}::VARCHAR AS issues, len({ISSUES}) = 0 AS valid FROM part")
def qc_rules(spark, d):
    return _images(spark, d).select("p_partkey", F.concat(F.lit("["), F.array_join("issues", ", "), F.lit("]")).alias("issues"), (F.size("issues") == 0).alias("valid"))


@query(f"SELECT issue, count(*) AS n FROM (SELECT unnest({ISSUES}) AS issue FROM part) GROUP BY 1")
def issue_breakdown(spark, d):
    return quality.qc_report(_images(spark, d))


@query("SELECT CASE WHEN contains(f, '_') THEN regexp_extract(f, '(?s)^(.*)_', 1) ELSE '未知' END AS category, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_type || '_' || p_brand || '_' || p_partkey END AS f FROM part) GROUP BY 1")
def file_categories(spark, d):
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.concat_ws("_", "p_type", "p_brand", "p_partkey"))
    return v.table(spark, d, "part").groupBy(quality.file_category(name).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jsonl_anti_clean(spark, d):
    entries = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("img/"), "doc_id", F.lit(".jpg")).alias("image"))
    bad = v.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("other\\dir\\"), "doc_id", F.lit(".jpg")).alias("path"))
    return quality.without_invalid(entries, bad).select("doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return quality.stratified_sample(v.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) <= floor((SELECT count(*) FROM documents) * 0.9) THEN 'train' ELSE 'val' END AS split FROM documents")
def train_split(spark, d):
    return quality.train_split(v.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT id, i::INT AS chunk_no, md5(trim(c, ' ')) AS digest, length(trim(c, ' ')) AS n FROM (SELECT doc_id AS id, i // 600 AS i, CASE WHEN i = 0 THEN left(text, 600) ELSE substring(text, i - 99, 700) END AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 600)) AS i FROM documents)) WHERE trim(c, ' ') != ''")
def chunk_fixed_overlap(spark, d):
    rows = chunking.fixed_chunks(v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", "chunk_no", F.md5("chunk").alias("digest"), F.length("chunk").alias("n"))


@query(r"""WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '\.\n', '。' || chr(10) || chr(10), 'g'), '\.', '。审计准则审计准则审计准则', 'g') AS text FROM documents),
pieces AS (SELECT id, text, flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(p, ' ')), lambda p: length(p) >= 10),
  lambda p: CASE WHEN length(p) <= 700 THEN [p] ELSE list_filter(string_split(regexp_replace(p, '([。！？；])', '\1' || chr(1), 'g'), chr(1)), lambda s: s != '') END)) AS parts FROM t),
merged AS (SELECT id, text, CASE WHEN len(parts) = 0 THEN [] ELSE string_split(list_reduce(parts, lambda acc, p: CASE WHEN length(string_split(acc, chr(1))[-1]) + length(p) + 1 <= 700 THEN acc || chr(10) || p ELSE acc || chr(1) || p END), chr(1)) END AS c FROM pieces),
tailed AS (SELECT id, CASE WHEN length(text) <= 700 THEN [trim(text, ' ')] WHEN len(c) > 1 AND length(c[-1]) < 300 THEN list_append(c[:-3], c[-2] || chr(10) || c[-1]) ELSE c END AS c FROM merged),
rows AS (SELECT id, (i - 1)::INT AS chunk_no, c[i] AS chunk FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS i FROM tailed))
SELECT id, chunk_no, md5(chunk) AS digest FROM (SELECT *, length(chunk) AS n, length(regexp_replace(chunk, '[^一-鿿]', '', 'g')) AS z FROM rows)
WHERE n >= 50 AND NOT ((contains(chunk, 'STEP') AND n < 150) OR (z = 0 AND n < 100) OR (n >= 20 AND z / n < 0.1))""")
def chunk_semantic(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.regexp_replace("text", r"\.\n", "。\n\n"), r"\.", "。审计准则审计准则审计准则").alias("text"))
    return chunking.semantic_chunks(docs).select("id", "chunk_no", F.md5("chunk").alias("digest"))


PAIRS = """pairs AS (SELECT a.category, a.id AS a, b.id AS b, a.confidence AS conf_a, b.confidence AS conf_b, round(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) AS similarity
  FROM dream a JOIN dream b ON a.category = b.category AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.id < b.id)))"""


@query(f"WITH {v.DREAM}, {PAIRS} SELECT category, a, b, similarity FROM pairs WHERE similarity >= 0.35")
def dream_pairs(spark, d):
    return consolidate.similar_pairs(v.dream(spark, d), 0.35).select("category", "a", "b", "similarity")


@query(f"WITH {v.DREAM}, {PAIRS}, hit AS (SELECT * FROM pairs WHERE similarity >= 0.35) SELECT id, CASE WHEN bool_or(gone) THEN 'delete' ELSE 'update' END AS action, CASE WHEN NOT bool_or(gone) THEN max(c) END AS confidence FROM (SELECT a AS id, false AS gone, least(1.0::DOUBLE, round(conf_a + 0.1::DOUBLE, 4)) AS c FROM hit UNION ALL SELECT b, true, NULL FROM hit) GROUP BY 1")
def merge_plan(spark, d):
    return consolidate.merge_plan(consolidate.similar_pairs(v.dream(spark, d), 0.35))


@query(f"WITH {v.DREAM} SELECT CASE WHEN category IS NULL OR category = '' THEN '未分类' ELSE category END AS category, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS high FROM dream GROUP BY 1")
def dream_stats(spark, d):
    return v.dream(spark, d).groupBy(consolidate.category_of(F.col("category")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high"))


@query("SELECT coalesce(max(doc_id), 0) + 1 AS next_batch FROM labels")
def next_batch(spark, d):
    return consolidate.next_batch(v.table(spark, d, "labels"), "doc_id")
