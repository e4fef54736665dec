"""DataFrames to files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_filename
from ..functions.validate import to_bool
from ..operators.graph import arrow_rows
from .files import FILES_AT_ONCE

# The columns of a wide audit row, by the name that reports give them; those of BOOLEANS are true or false.
COLUMNS = {
    "图片名称": "image_name", "图片路径": "image_path", "分类保存路径": "classified_save_path", "图像类型": "image_type", "票据代码": "invoice_code", "票据号码": "invoice_number", "日期": "date", "总金额": "total_amount",
    "相关方": "relevant_party", "税率": "tax_rate", "税号": "tax_id", "开户行/账号": "bank_info", "流水号": "serial_number", "详情": "details", "印章类型": "seal_type", "印章编号": "seal_number", "印章清晰度": "seal_clarity",
    "骑缝章完整性": "joint_seal", "统一社会信用代码": "unified_social_credit_code", "法人": "legal_person", "证照有效期": "valid_period", "资产标签": "asset_tag", "资产名称": "asset_name", "存放位置": "location", "资产数量": "quantity",
    "工程进度": "progress", "签字人": "signer", "审批层级": "approval_level", "附件完整性": "attachment_complete", "其他信息": "other_info", "日期有效性": "date_valid", "金额有效性": "amount_valid", "编码格式有效性": "code_format_valid",
    "无缺项": "no_missing_field", "图片正常": "image_normal", "无重复报销": "no_duplicate", "信息一致性": "consistent_info", "合规性": "compliance", "无舞弊": "no_fraud", "风险评级": "risk_rating", "风险说明": "risk_description",
    "审计结论": "audit_conclusion", "审计说明": "audit_reason", "匹配知识库规则": "kb_rule_ids", "CPA知识辅导": "cpa_tutoring",
}
BOOLEANS = ("date_valid", "amount_valid", "code_format_valid", "no_missing_field", "image_normal", "no_duplicate", "consistent_info", "compliance", "no_fraud")


def as_table_rows(report: DataFrame) -> DataFrame:
    """A report's rows under the table's column names; columns that the report does not have are null."""
    there = set(report.columns)
    made = []
    for shown, name in COLUMNS.items():
        value = F.col(f"`{shown}`") if shown in there else F.lit(None).cast("string")
        made.append((to_bool(value) if name in BOOLEANS else value.cast("string")).alias(name))
    return report.select(*made)


def write_by_type(rows: DataFrame, path: str, kind: str = "image_type") -> None:
    """Parquet with a folder for each type, whose name is made safe."""
    rows.withColumn("type", sanitize_filename(F.coalesce(F.col(kind), F.lit("未知")))).write.partitionBy("type").mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """What is to be opened as a spreadsheet; structs and arrays are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_tasks(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue with the tasks of new that are not there by (task_type, image_path), as pending."""
    from ..operators.dml import insert_or_ignore

    return insert_or_ignore(queue, new.withColumn("retry_status", F.lit("pending")).select(*queue.columns), ["task_type", "image_path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Files of rows(file, content, text) below a folder that all machines have mounted, with their text twins (see file_layout)."""
    from .file_layout import FileLayout

    rows.sparkSession.dataSource.register(FileLayout)
    with arrow_rows(rows.sparkSession, FILES_AT_ONCE):
        rows.select("file", "content", "text").write.format("file_layout").mode("append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content of all files below such a folder, listed in the tasks (see file_layout)."""
    from .file_layout import READ_SCHEMA, FileLayout

    spark.dataSource.register(FileLayout)
    return spark.read.format("file_layout").schema(READ_SCHEMA).load(path)
