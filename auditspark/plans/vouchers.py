"""JSON flattening, validation, scores and pipeline state of vouchers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validate as V
from . import views as v
from .registry import query

AS_OF = "2024-06-30"


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_path_project(spark, d):
    return v.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def _payload(spark, d):
    """Extraction results as JSON, with N/A for what is missing."""
    fields = F.struct(F.col("p_name").alias("relevant_party"), F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise("N/A").alias("total_amount"), F.when(F.col("p_size") % 3 == 0, F.lit("N/A")).otherwise(F.lit("2024-03-05")).alias("date"))
    seal = F.struct(F.col("p_brand").alias("seal_type"))
    return v.table(spark, d, "part").select("p_partkey", F.to_json(F.struct(fields.alias("fields"), seal.alias("seal_info"), F.lit(0.9).alias("_confidence"))).alias("payload"))


@query("SELECT p_partkey, p_name AS f_party, CASE WHEN p_size > 10 THEN p_retailprice::VARCHAR::DECIMAL(15, 2) END AS f_amount, CASE WHEN p_size % 3 != 0 THEN DATE '2024-03-05' END AS f_date, p_brand AS f_seal_type FROM part")
def json_flatten_typed(spark, d):
    shape = "fields struct<relevant_party:string,total_amount:string,date:string>, seal_info struct<seal_type:string>"
    x = _payload(spark, d).withColumn("x", F.from_json("payload", shape))
    return x.select("p_partkey", V.na_to_null(F.col("x.fields.relevant_party")).alias("f_party"), V.na_to_null(F.col("x.fields.total_amount")).try_cast("decimal(15,2)").alias("f_amount"), F.try_to_date(V.na_to_null(F.col("x.fields.date"))).alias("f_date"), F.col("x.seal_info.seal_type").alias("f_seal_type"))


@query("SELECT p_partkey, unnest(['relevant_party', 'buyer_tax_id', 'trade_date', 'tax_period']) AS field_name, unnest([p_name, p_size::VARCHAR, p_brand, p_type]) AS field_value, unnest(['text', 'amount', 'date', 'amount']) AS field_type FROM part")
def eav_unnest(spark, d):
    """A JSON object as rows: bookkeeping keys and blank values are skipped."""
    made = F.to_json(F.create_map(F.lit("relevant_party"), F.col("p_name"), F.lit("buyer_tax_id"), F.col("p_size").cast("string"), F.lit("trade_date"), F.col("p_brand"), F.lit("tax_period"), F.col("p_type"), F.lit("_note"), F.lit("x"), F.lit("blank"), F.lit("  ")))
    rows = v.table(spark, d, "part").select("p_partkey", F.explode(F.from_json(made, "map<string,string>")).alias("field_name", "field_value"))
    value = F.trim("field_value")
    kept = rows.where(~F.col("field_name").isin("_confidence", "_summary", "_raw", "_note", "raw_response") & (value != ""))
    return kept.select("p_partkey", "field_name", value.alias("field_value"), T.field_type(F.col("field_name")).alias("field_type"))


@query("SELECT k, CASE WHEN regexp_matches(k, 'amount|price|total|sum|fee|tax|salary|cost') THEN 'amount' WHEN regexp_matches(k, 'date|time|period') THEN 'date' ELSE 'text' END AS field_type FROM (SELECT unnest(['amount', 'buyer_tax_id', 'trade_date', 'tax_period', 'name', 'p_name', 'subtotal', 'timeout']) AS k) UNION ALL SELECT DISTINCT p_name, CASE WHEN regexp_matches(p_name, 'amount|price|total|sum|fee|tax|salary|cost') THEN 'amount' WHEN regexp_matches(p_name, 'date|time|period') THEN 'date' ELSE 'text' END FROM part")
def field_type_infer(spark, d):
    names = spark.createDataFrame([(k,) for k in ("amount", "buyer_tax_id", "trade_date", "tax_period", "name", "p_name", "subtotal", "timeout")], "k string")
    return names.union(v.table(spark, d, "part").select("p_name").distinct()).select("k", T.field_type(F.col("k")).alias("field_type"))


DATES = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '2024-13-01' ELSE '2031-1-5' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN true WHEN o_orderkey % 5 = 2 THEN o_orderdate::DATE <= DATE '{AS_OF}' ELSE false END AS ok FROM orders")
def validate_dates(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.lit(None)).when(k == 1, "N/A").when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "2024-13-01").otherwise("2031-1-5")
    return v.table(spark, d, "orders").select("o_orderkey", V.valid_date(text, F.lit(AS_OF).cast("date")).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS ok FROM lineitem")
def validate_amounts(spark, d):
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    text = F.when(k == 0, "N/A").when(k == 1, F.format_string("%.2f", "l_extendedprice")).when(k == 2, F.concat(F.format_string("%.2f", "l_extendedprice"), F.lit("5"))).when(k == 3, "-1").otherwise("壹元")
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.valid_amount(text).alias("ok"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM customer")
def validate_codes(spark, d):
    code = F.lpad(F.col("c_custkey").cast("string"), 18, "A")
    text = F.when(F.col("c_custkey") % 3 == 0, code).when(F.col("c_custkey") % 3 == 1, F.lower(code)).otherwise(F.substr(code, F.lit(1), F.lit(17)))
    text = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a"), F.substr(text, F.lit(2)))).otherwise(text)
    return v.table(spark, d, "customer").select("c_custkey", V.valid_credit_code(text).alias("ok"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, 'N/A') AS party, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'N/A') AS seal, p_size > 25 AS filled FROM part")
def post_process_defaults(spark, d):
    """Missing and null leaves get the default, level by level; what is there stays."""
    raw = F.to_json(F.struct(F.when(F.col("p_size") > 25, F.col("p_name")).alias("party"), F.when(F.col("p_size") % 2 == 0, F.struct(F.col("p_brand").alias("seal"))).alias("seal_info")))
    x = F.from_json(raw, "party string, seal_info struct<seal:string>")
    rows = v.table(spark, d, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", V.safe(F.col("x.party")).alias("party"), V.safe(F.col("x.seal_info.seal")).alias("seal"), F.col("x.party").isNotNull().alias("filled"))


@query("SELECT p_partkey, (p_name IS NOT NULL)::INT + (p_size > 10)::INT + 1 AS n_fields FROM part")
def field_count_leaves(spark, d):
    fields = [F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("N/A"), F.lit("x"), F.lit(None).cast("string")]
    return v.table(spark, d, "part").select("p_partkey", V.count_filled(fields).alias("n_fields"))


SCORE_SQL = "CASE WHEN p_size > 10 THEN 40 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 20 ELSE 0 END + 15 + CASE WHEN p_size % 5 > 0 THEN 15 ELSE 0 END + 10"


def _scores():
    pick = lambda c, x, y: F.when(c, x).otherwise(y)
    s = F.col("p_size")
    return V.quality_score(pick(s > 10, F.lit("12.00"), F.lit("N/A")), pick(s % 2 == 0, F.lit("a"), F.lit("")), F.lit("2024-01-01"), pick(s % 5 > 0, F.col("p_type"), F.lit("其他")), F.col("p_name"))


@query(f"SELECT p_partkey, ({SCORE_SQL})::DOUBLE AS score FROM part")
def quality_score(spark, d):
    return v.table(spark, d, "part").select("p_partkey", _scores().alias("score"))


@query(f"SELECT p_brand, arg_max(p_partkey, ({SCORE_SQL}) * 1000000 - p_partkey) AS best FROM part GROUP BY 1")
def best_of_n(spark, d):
    """The best-scored result of each group; the first of equals wins."""
    rows = v.table(spark, d, "part").select("p_brand", "p_partkey", _scores().alias("score"))
    return rows.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("score", (-F.col("p_partkey")))).alias("best"))


@query("SELECT doc_id, least(0.95::DOUBLE, greatest(0.15::DOUBLE, round(0.3::DOUBLE + CASE WHEN length(source) > 5 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(left(text, 40)) > 10 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN length(text) > 150 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(lang) > 0 THEN 0.05::DOUBLE ELSE 0 END, 2))) AS confidence FROM documents")
def confidence_score(spark, d):
    return v.table(spark, d, "documents").select("doc_id", V.confidence(F.col("source"), F.left("text", F.lit(40)), F.col("text"), F.col("doc_id") % 3, F.col("lang")).alias("confidence"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, 'the', '【图片：x】'), '【图片：[^】]*】', '', 'g'), '(?s)\\$\\$.*?\\$\\$', '', 'g'), '\n{3,}', '\n\n', 'g') AS cleaned FROM documents")
def clean_text(spark, d):
    return v.table(spark, d, "documents").select("doc_id", T.clean_text(F.replace("text", F.lit("the"), F.lit("【图片：x】"))).alias("cleaned"))


@query("SELECT doc_id, (contains(t, 'STEP') AND length(t) < 150) OR (length(t) > 0 AND c = 0 AND length(t) < 100) OR (length(t) >= 20 AND c / greatest(length(t), 1) < 0.1) AS garbage FROM (SELECT doc_id, t, length(regexp_replace(t, '[^一-鿿]', '', 'g')) AS c FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN repeat('审计准则', (length(text) // 20)::BIGINT) || text ELSE 'STEP ' || repeat('审', 60) END AS t FROM documents))")
def garbage_flag(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.repeat(F.lit("审计准则"), F.floor(F.length("text") / 20).cast("int")), "text")).otherwise(F.concat(F.lit("STEP "), F.repeat(F.lit("审"), 60)))
    return v.table(spark, d, "documents").select("doc_id", T.is_garbage(t).alias("garbage"))


@query("SELECT doc_id, left(regexp_replace(text, '\\s+', '', 'g'), 80) AS brief FROM documents")
def brief_summary(spark, d):
    return v.table(spark, d, "documents").select("doc_id", T.brief(F.col("text")).alias("brief"))


@query(r"""WITH t AS (SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS text FROM documents),
u AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 5) AS s FROM t),
g AS (SELECT doc_id, text, list_reduce(list_prepend('', s), lambda acc, x: CASE WHEN length(acc) >= 80 THEN acc ELSE acc || x END) AS g FROM u)
SELECT doc_id, CASE WHEN length(g) > 0 THEN left(g, 150) ELSE left(text, 80) END AS summary FROM g""")
def sentence_summary(spark, d):
    return v.table(spark, d, "documents").select("doc_id", T.summary(F.col("text"), ".").alias("summary"))


@query("SELECT p_partkey, regexp_replace(p_name || ':' || p_brand || '?', '[\\\\/:*?\"<>|]', '_', 'g') AS name FROM part")
def sanitized_names(spark, d):
    return v.table(spark, d, "part").select("p_partkey", T.sanitize_filename(F.concat_ws("", "p_name", F.lit(":"), "p_brand", F.lit("?"))).alias("name"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1234.56 WHEN 1 THEN 120003.0 ELSE NULL END::DOUBLE AS amount FROM customer")
def chinese_amounts(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "壹仟贰佰叁拾肆元伍角陆分").when(k == 1, "壹拾贰万零叁元整").otherwise("无")
    return v.table(spark, d, "customer").select("c_custkey", V.chinese_amount(text).alias("amount"))


@query("SELECT CASE WHEN p_size <= 15 THEN 'template' ELSE 'generic' END AS plan, count(*) AS n FROM part GROUP BY 1")
def extraction_plan(spark, d):
    """The fields of the type if it has any, else of its category, else the generic ones."""
    parts = v.table(spark, d, "part")
    template = spark.createDataFrame([(i, "template") for i in range(16)], "size int, fields string")
    return parts.join(F.broadcast(template), F.col("p_size") == F.col("size"), "left").groupBy(F.coalesce("fields", F.lit("generic")).alias("plan")).agg(F.count("*").alias("n"))
