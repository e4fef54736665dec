"""The voucher pipeline: import, classification, post-processing, retries, layout of files, and its log rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.catalogue import OTHER, TYPES_OF, category_of_type, type_catalogue
from ..functions.providers import Provider, provided
from ..functions.text import char_overlap, sanitize_filename
from .graph import cut
from .quality import normalized_extension

# The record of an image that was not recognised.
FALLBACK = {"image_type": "其他", "risk_rating": "高风险", "risk_description": "默认错误：未识别", "audit_conclusion": "不通过", "reason": "默认错误：未识别", "audit_value": "数字化审计留痕，可核对、可预警"}
STRINGS = ("invoice_code", "invoice_number", "date", "total_amount", "relevant_party", "tax_rate", "tax_id")


def optional_filters(rows: DataFrame, equal: dict | None = None, like: dict | None = None, between: dict | None = None) -> DataFrame:
    """rows of which all given conditions hold; a condition whose value is None or empty is left out.

    equal: column to value; like: column to a part of it in any case; between: column to (least, most), of which either may be
    missing.
    """
    found = [F.col(c) == x for c, x in (equal or {}).items() if x not in (None, "")]
    found += [F.ilike(c, F.lit(f"%{x}%")) for c, x in (like or {}).items() if x]
    for c, (least, most) in (between or {}).items():
        found += [F.col(c) >= least] if least not in (None, "") else []
        found += [F.col(c) <= most] if most not in (None, "") else []
    return rows.where(reduce(lambda a, b: a & b, found, F.lit(True)))


def import_rows(files: DataFrame, batch: str, most_per_type: int | None = None) -> DataFrame:
    """Pending vouchers of files(path, type, size, md5): name, format, category by type; with most_per_type so many of each, by path."""
    rows = files
    if most_per_type is not None:
        place = F.row_number().over(Window.partitionBy("type").orderBy("path"))
        rows = rows.withColumn("__place", place).where(F.col("__place") <= most_per_type)
    return rows.select(
        F.lit(batch).alias("batch"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"), F.col("md5").alias("file_md5"), F.col("size").alias("file_size"),
        normalized_extension(F.col("path")).alias("file_format"), F.col("type").alias("doc_type"), category_of_type(F.col("type")).alias("category"), F.lit("pending").alias("classify_status"), F.lit("pending").alias("extract_status"),
    )


def classified(results: DataFrame) -> DataFrame:
    """results(type_name, category_name) with doc_type and category settled by the catalogue.

    The type is matched exactly, else one within the other, else by shared characters (the first of the catalogue among
    equals), and its category wins over the one that was told. Without a match a told category that is known stays. Every
    distinct raw type is held against the 130 types of the catalogue.
    """
    types = type_catalogue(results.sparkSession)
    raw = results.select(F.trim(F.coalesce("type_name", F.lit(""))).alias("raw")).distinct()
    tier = F.when(F.col("raw") == F.col("type"), 1).when((F.col("raw") != "") & (F.contains("raw", "type") | F.contains("type", "raw")), 2).when(char_overlap(F.col("raw"), F.col("type")) > 0.6, 3)
    held = raw.join(F.broadcast(types), F.lit(True)).withColumn("tier", tier).where("tier IS NOT NULL")
    best = held.groupBy("raw").agg(F.min(F.struct("tier", "i", "type", "category")).alias("best"))
    joined = results.join(best, F.trim(F.coalesce("type_name", F.lit(""))) == F.col("raw"), "left")
    told = F.when(F.col("category_name").isin(*TYPES_OF), F.col("category_name"))
    return joined.withColumn("doc_type", F.coalesce("best.type", "type_name")).withColumn("category", F.coalesce("best.category", told, F.lit(OTHER))).drop("raw", "best")


def post_processed(raw: DataFrame, payload: str, as_of: Column) -> DataFrame:
    """raw with ocr (a struct of strings, N/A where missing) and what its checks say.

    Defaults first, then amounts in Chinese numerals become figures, then date, amount and credit code are checked; a payload
    that does not parse has all defaults.
    """
    parsed = F.from_json(payload, ", ".join(f"{c} string" for c in STRINGS))
    rows = raw.withColumn("__x", parsed)
    amount = V.chinese_amount(F.col("__x.total_amount"))
    value = lambda c: F.coalesce(F.when(amount.isNotNull(), F.format_string("%.2f", amount)), V.safe(F.col("__x.total_amount"))) if c == "total_amount" else V.safe(F.col(f"__x.{c}"))
    rows = rows.withColumn("ocr", F.struct(*[value(c).alias(c) for c in STRINGS])).drop("__x")
    return rows.withColumn("date_valid", V.valid_date(F.col("ocr.date"), as_of)).withColumn("amount_valid", V.valid_amount(F.col("ocr.total_amount"))).withColumn("code_format_valid", V.valid_credit_code(F.col("ocr.tax_id")))


def with_fallback(results: DataFrame, failed: Column) -> DataFrame:
    """results whose columns have the fallback's values where `failed` holds; each row has its own."""
    failed = F.coalesce(failed, F.lit(True))
    return results.select(*[F.when(failed, F.lit(FALLBACK[c])).otherwise(F.col(c)).alias(c) if c in FALLBACK else F.col(f"`{c}`") for c in results.columns])


def replay_tasks(queue: DataFrame, recognise: Provider, repair: Provider) -> DataFrame:
    """queue(task_type, image_path, raw_content, retry_status) with result, after pending tasks were run again.

    model_fail goes to recognise (by path), json_error to repair (by content); success or fail by whether an answer came.
    """
    pending = F.col("retry_status") == "pending"
    asked = F.when(pending & (F.col("task_type") == "model_fail"), F.col("image_path"))
    mended = F.when(pending & (F.col("task_type") == "json_error"), F.coalesce("raw_content", F.lit("")))
    rows = queue.withColumn("result", F.coalesce(provided(asked, recognise, "string"), provided(mended, repair, "string")))
    known = F.col("task_type").isin("model_fail", "json_error")
    status = F.when(pending & known, F.when(F.col("result").isNotNull(), "success").otherwise("fail")).otherwise(F.col("retry_status"))
    return rows.withColumn("retry_status", status)


def update_task(queue: DataFrame, done: DataFrame, order: str) -> DataFrame:
    """queue with the status of done(task_type, image_path, status) at the first row, by `order`, of each of its tasks."""
    first = queue.groupBy("task_type", "image_path").agg(F.min(order).alias("__first"))
    told = done.groupBy("task_type", "image_path").agg(F.min("status").alias("__status")).join(first, ["task_type", "image_path"]).toDF("__t", "__p", "__status", "__first")
    same = (F.col("task_type") == F.col("__t")) & (F.col("image_path") == F.col("__p")) & (F.col(order) == F.col("__first"))
    joined = queue.join(told, same, "left").withColumn("retry_status", F.coalesce("__status", "retry_status"))
    return joined.drop("__t", "__p", "__status", "__first")


def numbered(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """rows with `number`, from 1 in each kind by order, which must tell rows of a kind apart.

    Rows are dealt out in ranges of (kind, order) and numbered within a range; what stands before is known from the ranges' counts. So no
    kind has to fit one task.
    """
    dealt = cut(rows.repartitionByRange(F.col(kind), F.col(order)).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col("__part").alias("p"), F.col(kind).alias("k")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part", kind).orderBy(order))
    joined = dealt.withColumn("__within", within).join(counts.select("p", "k", before.alias("before")), (F.col("__part") == F.col("p")) & F.col(kind).eqNullSafe(F.col("k")))
    return joined.withColumn("number", F.col("before") + F.col("__within")).drop("__part", "__within", "p", "k", "before")


def file_layout(rows: DataFrame, kind: str, name: str, order: str) -> DataFrame:
    """rows with folder, file and twin: a folder for each type, files numbered in it, and the text file beside each."""
    safe = sanitize_filename(F.coalesce(F.col(kind), F.lit(OTHER)))
    file = F.concat(F.format_string("%04d", "number"), F.lit("_"), safe, F.lit("_"), sanitize_filename(F.col(name)))
    laid = numbered(rows, kind, order).withColumn("folder", safe).withColumn("file", file)
    return laid.withColumn("twin", F.concat(F.regexp_replace("file", r"\.[A-Za-z0-9]+$", ""), F.lit(".txt"))).drop("number")


# The lines of a text twin, and what stands where nothing is known.
TWIN_KEYS = (("日期", "date"), ("总金额", "total_amount"), ("相关方", "relevant_party"), ("统一社会信用代码", "unified_social_credit_code"), ("资产名称", "asset_name"), ("签字人", "signer"))
TWIN_VERDICT = (("风险评级", "risk_rating", "高风险"), ("审计结论", "audit_conclusion", "不通过"), ("风险说明", "risk_description", "未识别"))


def twin_text(rows: DataFrame, at: str, kind: str = "image_type") -> Column:
    """What the text twin of a row says: when, of what type, the facts, the verdict, and the whole row as JSON. Columns that rows do
    not have, and nulls, are shown as N/A, or as the verdict on what cannot be read."""
    there = set(rows.columns)
    told = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in there else F.lit(other)
    line = lambda shown, value, indent="": F.concat(F.lit(f"{indent}{shown}："), value, F.lit("\n"))
    facts = [line(shown, told(c, "N/A"), "  - ") for shown, c in TWIN_KEYS]
    verdict = [line(shown, told(c, other)) for shown, c, other in TWIN_VERDICT]
    head = [F.lit("=== 图片关键信息 ===\n"), line("审计时间", F.lit(at)), line("图片类型", told(kind, OTHER)), F.lit("核心信息：\n")]
    return F.concat(*head, *facts, *verdict, F.lit("\n=== 完整识别内容 ===\n"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if rows.schema[c].dataType.typeName() != "binary"])))


def stage_log(statuses: DataFrame, batch: str) -> DataFrame:
    """batch, stage, total, done, failed, state: one row for each stage of statuses(stage, status); partial if any failed."""
    counts = statuses.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    state = F.when(F.col("failed") > 0, "partial").when(F.col("done") == F.col("total"), "done").otherwise("pending")
    return counts.select(F.lit(batch).alias("batch"), "stage", "total", "done", "failed", state.alias("state"))


def dataset_meta(rows: DataFrame, split: str = "split") -> DataFrame:
    """One row: total, train, val of rows with a split, and how many categories they are of."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "val").alias("val"), F.count_distinct("category").alias("categories"))


def workflow(questions: DataFrame, agents: dict[str, Provider], kind: str = "sequential", rounds: int = 2) -> DataFrame:
    """id, step, agent, output: what each agent answers to questions(id, question); all steps of a question are columns of its row.

    sequential: each works on what the one before it said; parallel: in each round all work on the question and on what was
    said in the round before; debate: one after the other, on the question and the last 2 * len(agents) answers. An unknown kind
    is sequential.
    """
    rows, names, steps = questions.select("id", "question"), list(agents), []
    plan = [(r, a) for r in range(rounds) for a in names] if kind in ("parallel", "debate") else [(0, a) for a in names]
    for k, (r, agent) in enumerate(plan):
        if kind == "parallel":
            heard = [f"s{i}" for i, (other, _) in enumerate(plan) if other == r - 1]
        elif kind == "debate":
            heard = [f"s{i}" for i in range(max(0, k - 2 * len(names)), k)]
        else:
            heard = [f"s{k - 1}"] if k else []
        asked = F.col(heard[0]) if kind not in ("parallel", "debate") and heard else F.concat_ws("\n", "question", *heard)
        rows = rows.withColumn(f"s{k}", provided(asked, agents[agent], "string"))
        steps.append(F.struct(F.lit(k + 1).alias("step"), F.lit(agent).alias("agent"), F.col(f"s{k}").alias("output")))
    return rows.select("id", F.explode(F.array(*steps)).alias("s")).select("id", "s.*")
