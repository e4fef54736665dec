import random

from auditspark.operators import chunking, section_tables

rng = random.Random(4)


def same(a, b, columns):
    key = lambda r: str(tuple(r[c] for c in columns))
    got, want = sorted(map(key, a.collect())), sorted(map(key, b.collect()))
    assert got == want and got


def test_markdown(spark):
    lines = lambda i: [rng.choice([f"# 第{'一二三四五六七八九'[k % 9]}章 c{i}-{k}", f"## s{k}", "### deep 1", "body line of some words that is long enough 【图片：x】", "short", "", "  "]) for k in range(60)]
    docs = [(i, "\n".join(lines(i))) for i in range(12)] + [(12, ""), (13, None), (14, "no heading but a line of text that is long enough to be kept")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    for least in (1, 50):
        same(section_tables.markdown_sections(df, least), chunking.markdown_sections(df, least), ["id", "part", "chapter", "section", "body"])


def test_content(spark):
    text = lambda k: rng.choice([f"第{k % 9 + 1}章 t {k}", f"第{k % 9 + 1}节 u {k}", "一、 v 3", "（一） w", "1. x", "a body of words that goes on for some time until it is long enough", "", None])
    items = [(i, n, rng.choice(["text", "text", "text", "table", "equation"]), text(n), rng.choice([None, n // 5])) for i in range(12) for n in range(50)]
    df = spark.createDataFrame(items, "id long, no int, type string, text string, page_idx int").repartition(3)
    for least in (1, 50):
        same(section_tables.content_sections(df, least), chunking.content_sections(df, least), ["id", "chapter", "section", "subsection", "page_start", "has_table", "has_equation", "body"])


def test_rules(spark):
    line = lambda: rng.choice(["一、first", "（二）second", "## third", "风险等级：高风险", "风险等级: 低风险", "a line that must be checked with care", "b"])
    docs = [(i, "\n".join(line() for _ in range(40))) for i in range(12)] + [(12, ""), (13, None)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    same(section_tables.rule_chunks(df), chunking.rule_chunks(df), ["rule_id", "id", "heading", "risk", "body"])


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, 0, "text", "x" * 60, 0)], "id long, no int, type string, text string, page_idx int")
    plan = section_tables.content_sections(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
