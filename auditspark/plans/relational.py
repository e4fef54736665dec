"""Statistics, lists, joins and updates of the audit tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validate as V
from ..operators import dml
from ..streaming import status
from . import views as v
from .registry import query


@query(f"WITH {v.AUDIT} SELECT count(*) AS total, count(*) FILTER (audit_conclusion = '通过') AS passed, count(*) FILTER (audit_conclusion = '不通过') AS failed, count(*) FILTER (audit_conclusion = '人工复核') AS review, count(*) FILTER (risk_rating = '高风险') AS high, count(*) FILTER (risk_rating = '中风险') AS medium, count(*) FILTER (risk_rating = '低风险') AS low FROM audit")
def audit_statistics(spark, d):
    c, r = F.col("audit_conclusion"), F.col("risk_rating")
    parts = (("passed", c == "通过"), ("failed", c == "不通过"), ("review", c == "人工复核"), ("high", r == "高风险"), ("medium", r == "中风险"), ("low", r == "低风险"))
    return v.audit_results(spark, d).agg(F.count("*").alias("total"), *[F.count_if(x).alias(n) for n, x in parts])


@query(f"WITH {v.AUDIT} SELECT image_type, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, image_type LIMIT 5")
def audit_type_top5(spark, d):
    return v.audit_results(spark, d).groupBy("image_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image_type").limit(5)


@query(f"WITH {v.EXTRACTS}, names(category) AS (VALUES ('STANDARD'), ('PROMO'), ('ECONOMY'), ('MEDIUM'), ('SMALL'), ('LARGE'), ('NONE')) SELECT n.category, count(e.id) AS n FROM names n LEFT JOIN extracts e ON n.category = e.category GROUP BY 1")
def category_counts_zero_filled(spark, d):
    names = spark.createDataFrame([(c,) for c in (*v.CATEGORIES, "NONE")], "name string")
    counts = v.extracts(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counts, F.col("name") == F.col("category"), "left").select(F.col("name").alias("category"), F.coalesce("n", F.lit(0)).alias("n"))


EXTRACT_STATS = f"WITH {v.EXTRACTS} SELECT category, count(*) AS total, count(f_amount) AS with_amount, count(*) FILTER (risk = 'R') AS risky, count(*) FILTER (f_amount IS NULL) AS without_amount, count(DISTINCT f_party) AS parties, round(avg(f_amount), 4) AS avg_amount, min(f_amount) AS min_amount, max(f_amount) AS max_amount, min(f_date) AS first_date, max(f_date) AS last_date FROM extracts GROUP BY 1"


@query(EXTRACT_STATS)
def category_extract_stats(spark, d):
    a = F.col("f_amount")
    return v.extracts(spark, d).groupBy("category").agg(
        F.count("*").alias("total"), F.count(a).alias("with_amount"), F.count_if(F.col("risk") == "R").alias("risky"), F.count_if(a.isNull()).alias("without_amount"), F.count_distinct("f_party").alias("parties"),
        F.round(F.avg(a), 4).alias("avg_amount"), F.min(a).alias("min_amount"), F.max(a).alias("max_amount"), F.min("f_date").alias("first_date"), F.max("f_date").alias("last_date"),
    )


@query(f"WITH {v.CLASSIFY} SELECT source, count(*) AS total, count(*) FILTER (is_correct) AS correct, round(count(*) FILTER (is_correct) / nullif(count(*), 0)::DOUBLE * 100, 2) AS accuracy FROM classified GROUP BY 1")
def classify_accuracy(spark, d):
    rows = v.classify_results(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    return rows.withColumn("accuracy", F.round(F.col("correct") / F.nullif(F.col("total"), F.lit(0)) * 100, 2))


@query(f"WITH {v.EXTRACTS} SELECT risk, count(*) AS n FROM (SELECT CASE risk WHEN 'R' THEN '高' WHEN 'A' THEN '中' ELSE '低' END AS risk FROM extracts) GROUP BY 1")
def risk_distribution_union(spark, d):
    words = F.when(F.col("risk") == "R", "高风险").when(F.col("risk") == "A", "中风险").otherwise("低风险")
    return v.extracts(spark, d).groupBy(V.risk_label(words).alias("risk")).agg(F.count("*").alias("n"))


@query(f"WITH {v.AUDIT} SELECT CASE WHEN audit_conclusion = '人工复核' THEN '需人工' ELSE audit_conclusion END AS conclusion, count(*) AS n FROM audit GROUP BY 1")
def conclusion_buckets(spark, d):
    return v.audit_results(spark, d).groupBy(V.conclusion_label(F.col("audit_conclusion")).alias("conclusion")).agg(F.count("*").alias("n"))


@query(f"WITH {v.EXTRACTS} SELECT f_date, round(sum(f_amount), 2) AS amount FROM extracts WHERE f_amount IS NOT NULL GROUP BY 1 HAVING f_date IS NOT NULL")
def daily_amount(spark, d):
    rows = v.extracts(spark, d).where(F.col("f_amount").isNotNull())
    return rows.groupBy("f_date").agg(F.round(F.sum("f_amount"), 2).alias("amount")).where(F.col("f_date").isNotNull())


@query(f"WITH {v.EXTRACTS} SELECT id, category, f_date, f_amount FROM extracts WHERE f_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ORDER BY id DESC, category LIMIT 20 OFFSET 40")
def audit_list_page(spark, d):
    """A page of the union, by a total order; optional conditions are joined by and."""
    rows = v.extracts(spark, d).where(F.col("f_date").between("1996-01-01", "1997-12-31"))
    return rows.select("id", "category", "f_date", "f_amount").orderBy(F.desc("id"), "category").offset(40).limit(20)


@query(f"WITH {v.AUDIT}, n AS (SELECT count(*) AS total FROM audit WHERE risk_rating = '高风险') SELECT id, total, (total + 9) // 10 AS total_pages FROM audit, n WHERE risk_rating = '高风险' ORDER BY id DESC LIMIT 10")
def audit_page_total_over(spark, d):
    """A page with the number of all rows: counted once and joined, not by a window over all rows."""
    rows = v.audit_results(spark, d).where(F.col("risk_rating") == "高风险")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("id")).limit(10)
    return page.join(F.broadcast(total), F.lit(True)).select("id", "total", F.floor((F.col("total") + 9) / 10).cast("long").alias("total_pages"))


@query(f"WITH {v.AUDIT} SELECT id, relevant_party, total_amount FROM audit WHERE contains(lower(coalesce(relevant_party, '')), '#00000001') AND contains(lower(coalesce(image_type, '')), 'build') ORDER BY total_amount DESC, id LIMIT 30")
def audit_client_filter_sort(spark, d):
    has = lambda c, s: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(s))
    amount = F.coalesce(F.col("total_amount").cast("string").try_cast("double"), F.lit(0.0))
    rows = v.audit_results(spark, d).where(has("relevant_party", "#00000001") & has("image_type", "build"))
    return rows.orderBy(amount.desc(), "id").limit(30).select("id", "relevant_party", "total_amount")


@query(f"WITH {v.AUDIT} SELECT * FROM audit WHERE id = 77")
def record_lookup(spark, d):
    return v.audit_results(spark, d).where(F.col("id") == 77)


@query(f"WITH {v.AUDIT} SELECT id, risk_rating FROM audit WHERE id IN (1, 2, 30, 400)")
def batch_lookup(spark, d):
    """Ids of a comma list; what is no number is passed over."""
    ids = [int(x) for x in "1, 2,x,30,,400".split(",") if x.strip().isdigit()]
    return v.audit_results(spark, d).where(F.col("id").isin(ids)).select("id", "risk_rating")


@query("SELECT DISTINCT source AS book FROM documents WHERE source IS NOT NULL AND source != ''")
def books_distinct(spark, d):
    return v.table(spark, d, "documents").where(F.col("source").isNotNull() & (F.col("source") != "")).select(F.col("source").alias("book")).distinct()


@query("SELECT coalesce(source, lang) AS key, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, key LIMIT 30")
def source_distribution(spark, d):
    return v.table(spark, d, "documents").groupBy(F.coalesce("source", "lang").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(30)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def courses_books_join(spark, d):
    return v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_name LIKE '%1' GROUP BY 1")
def category_type_counts(spark, d):
    kept = v.table(spark, d, "nation").where(F.like("n_name", F.lit("%1")))
    return v.table(spark, d, "region").join(kept, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) ORDER BY r_name, n_name")
def active_types_sorted(spark, d):
    """A nation is active if a supplier there has a balance above zero."""
    paid = v.table(spark, d, "supplier").where(F.col("s_acctbal") > 0)
    active = v.table(spark, d, "nation").join(paid, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return active.join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").orderBy("r_name", "n_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_delete_survivors(spark, d):
    gone = v.table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    return dml.delete_children(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", gone, "o_orderkey")


@query("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS best FROM nation")
def scalar_subquery_counts(spark, d):
    c = v.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = v.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    n = v.table(spark, d, "nation")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), "best")


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def session_readback(spark, d):
    return v.table(spark, d, "conversations").where(F.col("conv_id") == 3).select("turn", "role", "text").orderBy("turn")


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'p_r%'")
def prefix_filter(spark, d):
    return v.table(spark, d, "events").where(F.like("event_type", F.lit("p_r%"))).select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE '%ild%' OR c_name ILIKE '%00012%'")
def ilike_any_columns(spark, d):
    return v.table(spark, d, "customer").where(F.ilike("c_mktsegment", F.lit("%ild%")) | F.ilike("c_name", F.lit("%00012%"))).select("c_custkey", "c_name")


@query("SELECT p_partkey, left(p_name, 5) AS head, length(p_name) AS n_chars, 0.85::DOUBLE AS similarity FROM part")
def computed_projection(spark, d):
    return v.table(spark, d, "part").select("p_partkey", F.left("p_name", F.lit(5)).alias("head"), F.length("p_name").alias("n_chars"), F.lit(0.85).alias("similarity"))


@query("SELECT doc_id, CASE WHEN concat_ws(' > ', nullif(lang, ''), nullif(source, '')) = '' THEN '教材 #' || doc_id ELSE concat_ws(' > ', nullif(lang, ''), nullif(source, '')) END AS label FROM documents")
def source_labels(spark, d):
    none = F.lit(None).cast("string")
    return v.table(spark, d, "documents").select("doc_id", T.source_label(F.col("lang"), F.col("source"), none, F.col("doc_id")).alias("label"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, coalesce(max(event_id), 0) + 1 AS next_id FROM events")
def distinct_counts(spark, d):
    return v.table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), (F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_id"))


BUCKET_SQL = "CASE WHEN n < 100 THEN '<100' WHEN n < 500 THEN '100-500' WHEN n < 2000 THEN '500-2000' ELSE '>=2000' END"


@query(f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n_docs, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean FROM (SELECT length(text) AS n FROM documents) GROUP BY 1")
def chunk_length_histogram(spark, d):
    n = F.col("n")
    bucket = F.when(n < 100, "<100").when(n < 500, "100-500").when(n < 2000, "500-2000").otherwise(">=2000")
    rows = v.table(spark, d, "documents").select(F.length("text").alias("n"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query("SELECT problem, count(*) AS n, (count(*) * 100 // greatest((SELECT count(*) FROM events), 1))::BIGINT AS percent FROM (SELECT CASE WHEN event_type LIKE '%view%' THEN '日期异常' WHEN event_type LIKE '%error%' THEN '金额异常' WHEN event_type LIKE '%sign%' THEN '印章问题' WHEN event_type LIKE '%click%' THEN '信息缺失' END AS problem FROM events) WHERE problem IS NOT NULL GROUP BY 1")
def problem_buckets(spark, d):
    e = F.col("event_type")
    has = lambda s: F.contains(e, F.lit(s))
    problem = F.when(has("view"), "日期异常").when(has("error"), "金额异常").when(has("sign"), "印章问题").when(has("click"), "信息缺失")
    rows = v.table(spark, d, "events")
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(problem.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("problem", "n", F.floor(F.col("n") * 100 / F.greatest("total", F.lit(1))).alias("percent"))


@query("SELECT o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN (SELECT o_orderkey, max(o_totalprice) + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) n USING (o_orderkey)")
def dml_upsert_latest(spark, d):
    base = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("version"))
    new = base.where("o_orderkey % 3 = 0")
    new = new.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return dml.upsert_latest(base, new, ["o_orderkey"], "version").drop("version")


@query("SELECT l_partkey, l_suppkey, max(l_extendedprice) AS confidence, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS description, list(l_orderkey ORDER BY l_orderkey * 10 + l_linenumber)::VARCHAR AS ids FROM lineitem GROUP BY 1, 2")
def dml_merge_greatest(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("confidence"), F.col("l_returnflag").alias("description"), F.array("l_orderkey").alias("ids"))
    merged = dml.upsert_merge(rows, ["l_partkey", "l_suppkey"], "seq", latest=["description"], greatest=["confidence"], appended=["ids"])
    return merged.withColumn("ids", F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1")
def dml_ignore(spark, d):
    c = v.table(spark, d, "customer").select("c_custkey", "c_name")
    return dml.insert_or_ignore(c.where("c_custkey % 2 = 0"), c.withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0 AND s_nationkey > 3)")
def dml_delete(spark, d):
    return dml.delete_where(v.table(spark, d, "supplier"), F.col("s_acctbal") < 0, F.col("s_nationkey") <= 3).select("s_suppkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE s_name END AS s_name FROM supplier")
def dml_update(spark, d):
    return dml.update_where(v.table(spark, d, "supplier"), F.col("s_acctbal") < 0, s_name=F.lit("failed")).select("s_suppkey", "s_name")


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(q, seq) AS q FROM (SELECT c_nationkey AS a, c_custkey % 25 AS b, c_custkey AS seq, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS q FROM customer) WHERE a != b GROUP BY 1, 2")
def dml_keep_old_pairs(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"), F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("q"))
    return dml.upsert_keep_old(c, "a", "b", "seq", ["q"])


@query("SELECT user_id, arg_max(event_type, ts) AS status, max(ts) AS at FROM events GROUP BY 1")
def state_latest(spark, d):
    return v.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("status"), F.max("ts").alias("at"))


@query("SELECT DISTINCT event_id // 3 AS id FROM events WHERE event_type = 'signup' AND event_id // 3 NOT IN (SELECT event_id // 3 FROM events WHERE event_type = 'purchase')")
def stage_gate(spark, d):
    """Vouchers whose classification is done and whose extraction has not begun; a signup is the one, a purchase the other."""
    e = F.col("event_type")
    stage = F.when(e == "signup", "classify").when(e == "purchase", "extract")
    return status.ready_for(v.table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("id"), stage.alias("stage"), F.lit("done").alias("status")), "classify", "extract")


@query("SELECT batch, count(*) AS total, count(*) FILTER (is_correct IS NOT NULL) AS done, (count(*) FILTER (is_correct IS NOT NULL) * 100 // greatest(count(*), 1))::BIGINT AS progress FROM (SELECT d.doc_id % 4 AS batch, quality = 1 - toxic AS is_correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1")
def batch_progress(spark, d):
    rows = v.classify_results(spark, d).groupBy("batch").agg(F.count("*").alias("total"), F.count("is_correct").alias("done"))
    return rows.withColumn("progress", F.floor(F.col("done") * 100 / F.greatest("total", F.lit(1))))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def pending_poll(spark, d):
    docs = v.table(spark, d, "documents")
    done = v.table(spark, d, "labels").select(F.col("doc_id").alias("l_id"))
    return docs.join(done, F.col("doc_id") == F.col("l_id"), "left_anti").orderBy("doc_id").limit(50).select("doc_id", "text")


@query("SELECT c_nationkey, c_name, position FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 10")
def rank_by_position(spark, d):
    """The best ten of each nation with their place; Spark keeps ten of each before it shuffles."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return v.table(spark, d, "customer").withColumn("position", place).where("position <= 10").select("c_nationkey", "c_name", "position")


