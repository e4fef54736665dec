import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditspark.operators import chunking, consolidate, dml, graph, knowledge, quality, search
from auditspark.sources import files, sinks
from auditspark.streaming import status


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fixed_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1300))
    rows = chunking.fixed_chunks(frame(spark, [(1, text), (2, "  "), (3, None), (4, "short"), (5, "")], "id long, text string")).orderBy("id", "chunk_no").collect()
    assert [(r.id, len(r.chunk)) for r in rows] == [(1, 600), (1, 700), (1, 200), (4, 5)]
    assert "".join(r.chunk if r.chunk_no == 0 else r.chunk[100:] for r in rows if r.id == 1) == text


def test_sections_and_rules(spark):
    body = "审计证据的充分性和适当性是审计工作的核心要求之一，注册会计师应当获取充分适当的证据。" * 2
    md = f"# 第一章 总论\n{body}\n## 第一节\n{body}\n\n{body}\n### 小节\n短\n# 第二章 x\n{body}"
    rows = chunking.markdown_sections(frame(spark, [(1, md)], "id long, text string")).orderBy("part").collect()
    assert [(r.chapter, r.section, len(r.body)) for r in rows] == [("第一章 总论", None, len(body)), ("第一章 总论", "第一节", 2 * len(body) + 1), ("第二章 x", None, len(body))]
    items = [(1, 0, "text", "第一章 总论 12", 3), (1, 1, "text", body, 3), (1, 2, "text", "第一节 y", 4), (1, 3, "text", "一、甲", 4), (1, 4, "table", None, 5), (1, 5, "text", body, 5), (1, 6, "equation", body, 6)]
    got = chunking.content_sections(frame(spark, items, "id long, no int, type string, text string, page_idx int")).orderBy("page_start").collect()
    assert [(r.chapter, r.section, r.subsection, r.page_start, r.has_table, r.has_equation) for r in got] == [("第一章 总论", None, None, 3, False, False), ("第一章 总论", "第一节 y", "一、甲", 5, True, True)]
    rules = f"一、甲\n风险等级：高风险\n{body}\n二、乙\n{body}\n（一）丙\n风险等级：低风险\n{body}"
    assert [(r.rule_id, r.heading, r.risk) for r in chunking.rule_chunks(frame(spark, [(1, rules)], "id long, text string")).orderBy("rule_id").collect()] == [("MD-001", "一、甲", "高"), ("MD-002", "二、乙", "高"), ("MD-003", "（一）丙", "低")]


def test_semantic_chunks(spark):
    sentence = "审计证据的充分性和适当性是审计工作的核心要求之一。"
    text = "\n\n".join([sentence * 10, sentence * 60, "x", sentence * 2])
    rows = chunking.semantic_chunks(frame(spark, [(1, text), (2, sentence * 3), (3, "ad")], "id long, text string")).orderBy("id", "chunk_no").collect()
    assert all(50 <= len(r.chunk) <= 700 + 300 for r in rows) and {r.id for r in rows} == {1, 2}
    assert "".join(r.chunk.replace("\n", "") for r in rows if r.id == 1) == sentence * 72


@settings(max_examples=5, deadline=None)
@given(st.permutations(range(12)), st.permutations(range(12)))
def test_rank_fusion_does_not_depend_on_row_order(spark, a, b):
    side = lambda p, f: [(i, i, f"text {i}", f(i)) for i in p]
    schema = "id long, source_id long, content string, similarity double"
    first, second = side(a, lambda i: 1.0 - i / 20), side(b, lambda i: (i * 7 % 12) / 12)
    got = search.reciprocal_rank_fusion(frame(spark, first, schema), frame(spark, second, schema), 12).collect()
    rank = {i: n + 1 for n, i in enumerate(sorted(range(12), key=lambda i: (-((i * 7 % 12) / 12), i)))}
    score = {i: 1 / (61 + i) + 1 / (60 + rank[i]) for i in range(12)}
    assert [r.id for r in got] == sorted(range(12), key=lambda i: (-round(score[i], 9), i))
    one = search.reciprocal_rank_fusion(frame(spark, first[:1], schema), frame(spark, first[:1], schema), 1).first()
    assert one.similarity == 0.9836


def brute_depths(edges, start, most):
    depth, frontier = {start: 0}, {start}
    for k in range(1, most + 1):
        frontier = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in frontier} - depth.keys()
        depth |= dict.fromkeys(frontier, k)
    return depth


def test_bfs_paths_and_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(1, 1)]
    edges = frame(spark, [(a, b, "r") for a, b in pairs], "src long, dst long, type string")
    visited = graph.bfs(edges, spark.range(3, 4), 3)
    got = {r.id: r for r in visited.collect()}
    want = brute_depths(pairs, 3, 3)
    assert {i: r.depth for i, r in got.items()} == want
    assert all(r.depth == 0 or got[r.parent].depth == r.depth - 1 for r in got.values())
    names = frame(spark, [(i, f"n{i}") for i in range(40)], "id long, name string")
    assert all(p.path.startswith("n3 → ") and p.path.count("→") >= 2 for p in graph.paths(visited, names).collect())
    full = {r.node: r.label for r in graph.least_labels(edges, names).collect()}
    assert full == {i: min(brute_depths(pairs, i, 50)) for i in range(40)}


def test_paths_in_both_modes(spark):
    edges = frame(spark, [(1, 2, "r"), (2, 3, "r"), (5, 3, "r")], "src long, dst long, type string")
    assert graph.find_path(edges, 1, 3).first().length == 2 and graph.find_path(edges, 1, 1).first().length == 0
    assert graph.find_path(edges, 1, 5).first() is None and graph.find_path(edges, 1, 5, mode="compat").first().meeting == 3


def test_paths_are_shortest_and_their_edges_are_there(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(55)})
    edges = frame(spark, [(a, b, f"t{a}-{b}") for a, b in pairs], "src long, dst long, type string")
    depth = lambda arcs, start: brute_directed(arcs, start)
    back = [(b, a) for a, b in pairs]
    for source, target in ((0, 7), (3, 3), (5, 21), (12, 29)):
        out, into = depth(pairs, source), depth(back, target)
        for mode, other in (("directed", into), ("compat", depth(pairs, target))):
            got = graph.find_path(edges, source, target, 4, mode).first()
            ahead, behind = {n: k for n, k in out.items() if k <= 2}, {n: k for n, k in other.items() if k <= 2}
            met = [(ahead[n] + behind[n], n) for n in ahead if n in behind]
            if not met:
                assert got is None
                continue
            assert (got.length, got.meeting) == min(met) and got.nodes[0] == source and got.nodes[-1] == target and len(got.types) == got.length == len(got.nodes) - 1
            at = got.nodes.index(got.meeting)
            for k, (a, b) in enumerate(zip(got.nodes, got.nodes[1:])):
                assert got.types[k] == (f"t{a}-{b}" if mode == "directed" or k < ahead[got.meeting] else f"<-t{b}-{a}") and at >= 0


def brute_directed(pairs, start):
    depth, front = {start: 0}, [start]
    while front:
        new = sorted({b for a, b in pairs if a in front and b not in depth})
        depth |= {b: depth[front[0]] + 1 for b in new}
        front = new
    return depth


def test_names_match_as_all_pairs_do(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    known, names = [(i, word()) for i in range(80)] + [(80, None)], sorted({word() for _ in range(120)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n in names:
        near = [(e, i) for i, k in known if k is not None and ((e := edits(n, k)) == 0 or e <= 2 and min(len(n), len(k)) >= 3)]
        if near:
            e, i = min(near)
            want[n] = (i, e, "fuzzy" if e else "exact")
    got = graph.match_names(frame(spark, [(n,) for n in [*names, None]], "name string"), frame(spark, known, "id long, name string"))
    assert {r.name: (r.match, r.edits, r.kind) for r in got.collect()} == want and len(want) > 60


def test_relations_keep_what_was_said_last_and_the_formula_of_the_first(spark):
    schema = "src long, dst long, type string, confidence double, chunk_ids array<long>, description string, formula string"
    known = frame(spark, [(1, 2, "r", 0.9, [3], "old", "f"), (5, 6, "r", 0.1, [1], "only known", None)], schema)
    new = frame(spark, [(1, 2, "r", 0.5, [9, 3], "newest", "g"), (1, 2, "r", 0.6, [4], "newer", None), (3, 4, "r", 0.2, [8], None, None), (3, 4, "r", 0.1, [2], "x", "h"), (7, 7, "r", 1.0, [1], "loop", None)], schema)
    got = {(r.src, r.dst): tuple(r)[3:] for r in knowledge.merge_relations(known, new).collect()}
    assert got == {(1, 2): (0.9, [3, 4, 9], "newest", "f"), (5, 6): (0.1, [1], "only known", None), (3, 4): (0.2, [2, 8], None, "h")}


def test_names_match_by_pieces(spark):
    known = frame(spark, [(1, "audit"), (2, "audits"), (3, "ab"), (4, "ledger")], "id long, name string")
    names = frame(spark, [("audit",), ("audut",), ("ac",), ("leger",), ("lexxer",), ("zzzz",)], "name string")
    got = {r.name: (r.match, r.edits, r.kind) for r in graph.match_names(names, known).collect()}
    assert got == {"audit": (1, 0, "exact"), "audut": (1, 1, "fuzzy"), "leger": (4, 1, "fuzzy"), "lexxer": (4, 2, "fuzzy")}


def test_dml(spark):
    table = frame(spark, [(1, "a", 1), (None, "n", 1)], "id long, v string, ver int")
    new = frame(spark, [(1, "b", 0), (2, "c", 1), (2, "d", 2), (None, "m", 3)], "id long, v string, ver int")
    assert sorted((str(r.id), r.v) for r in dml.upsert_latest(table, new, ["id"], "ver").collect()) == [("1", "b"), ("2", "d"), ("None", "m")]
    assert sorted(str(r.id) for r in dml.insert_or_ignore(table, new, ["id"]).collect()) == ["1", "2", "None"]
    good, bad = dml.split_good_bad(new, F.col("id") > 1)
    assert good.count() == 2 and bad.count() == 2
    assert dml.delete_where(table, F.col("id") == 1).count() == 1


def test_near_duplicates_and_samples(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = [(i, h ^ (1 << rng.randrange(40)) if i % 3 else h) for i, h in enumerate(base * 4)]
    pairs = {(r.a, r.b) for r in quality.near_duplicate_pairs(frame(spark, hashes, "id long, h long")).collect()}
    first = {}
    for i, h in hashes:
        first.setdefault(h, i)
    want = {(a, b) for g, a in first.items() for h, b in first.items() if a < b and g >> 48 == h >> 48 and (g ^ h).bit_count() < 5}
    assert pairs == want
    kept = [r.id for r in quality.greedy_near_duplicates(frame(spark, hashes, "id long, h long")).where("kept").collect()]
    assert len(kept) == 20
    rows = frame(spark, [(i, "ab"[i % 2] if i else None) for i in range(101)], "id long, s string")
    assert {r.s: r["count"] for r in quality.stratified_sample(rows, "s", "id", 5).groupBy("s").count().collect()} == {None: 1, "a": 5, "b": 5}
    assert {r.split: r["count"] for r in quality.train_split(rows, "id").groupBy("split").count().collect()} == {"train": 90, "val": 11}


def test_merge_plan(spark):
    items = frame(spark, [(1, "c", 0.5, [1.0, 0.0]), (2, "c", 0.9, [1.0, 0.1]), (3, "c", 0.5, [0.0, 1.0]), (4, None, 0.5, [1.0, 0.0]), (5, "", 0.95, [1.0, 0.0]), (6, "c", 0.3, None)], "id long, category string, confidence double, embedding array<double>")
    pairs = consolidate.similar_pairs(items)
    assert {(r.a, r.b) for r in pairs.collect()} == {(2, 1), (5, 4)}
    assert {(r.id, r.action, r.confidence) for r in consolidate.merge_plan(pairs).collect()} == {(2, "update", 1.0), (1, "delete", None), (5, "update", 1.0), (4, "delete", None)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "md").mkdir()
    for name, text in (("a.md", "full"), ("a_noimg.md", "bare"), ("b.md", "b")):
        (tmp_path / "md" / name).write_text(text)
    assert sorted(r.text for r in files.markdown(spark, str(tmp_path / "md")).collect()) == ["b", "bare"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps([{"type": "text", "text": "t", "text_level": 1, "page_idx": 0}, {"type": "table"}]))
    assert [(r.no, r.type, r.text) for r in files.content_list(spark, str(tmp_path / "c")).orderBy("no").collect()] == [(0, "text", "t"), (1, "table", None)]
    (tmp_path / "rules.json").write_text(json.dumps({"version": "1", "categories": [{"category": "k", "rules": [{"id": "1", "name": "n", "content": "c", "risk_level": "高"}]}]}, ensure_ascii=False))
    assert files.rule_base(spark, str(tmp_path / "rules.json")).first().risk_level == "高"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [r.ok for r in files.jsonl(spark, str(tmp_path / "l.jsonl")).collect()] == [True, False]
    (tmp_path / "img" / "cat").mkdir(parents=True)
    (tmp_path / "img" / "cat" / "p.JPEG").write_bytes(b"x" * 20_000)
    (tmp_path / "img" / "cat" / "small.png").write_bytes(b"x")
    one = files.images(spark, str(tmp_path / "img")).collect()
    assert [(r.category, r.extension) for r in one] == [("cat", "jpg")]
    assert files.images(spark, str(tmp_path / "img"), frame(spark, [(one[0].md5,)], "md5 string")).count() == 0
    rows = sinks.as_table_rows(frame(spark, [("a/b", "是", "TRUE")], "`图像类型` string, `无舞弊` string, `合规性` string"))
    r = rows.first()
    assert len(rows.columns) == 45 and (r.image_type, r.no_fraud, r.compliance, r.date) == ("a/b", False, True, None)
    sinks.write_by_type(rows, str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).first().type == "a_b"
    sinks.write_csv(rows.withColumn("s", F.array(F.lit(1))), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s == "[1]"
    queue = frame(spark, [("json_error", "p", "done")], "task_type string, image_path string, retry_status string")
    new = frame(spark, [("json_error", "p"), ("json_error", "q"), ("json_error", "q")], "task_type string, image_path string")
    assert sorted(map(tuple, sinks.append_tasks(queue, new).collect())) == [("json_error", "p", "done"), ("json_error", "q", "pending")]
    mix = {r.risk_rating: r["count"] for r in files.synthetic_vouchers(spark, 5000).groupBy("risk_rating").count().collect()}
    assert 3300 < mix["低风险"] < 3700 and 400 < mix["高风险"] < 600
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view", "id") in {(r.table, r.column) for r in files.columns_of(spark).collect()}


def test_stream_works_on_each_voucher_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    work = lambda batch: batch.select("id", (F.col("id") % 10 > 0).alias("ok"))
    spark.range(100).write.parquet(source)
    for upto in (100, 150):
        status.run_stage(spark, source, "id long", work, out, state, "classify", 1).awaitTermination(120)
        done = spark.read.parquet(out)
        assert done.count() == done.select("id").distinct().count() == upto
        if upto == 100:
            spark.range(100, 150).write.mode("append").parquet(source)
    assert done.where("status = 'failed'").count() == 15 and done.select("n").distinct().count() > 2
    assert status.ready_for(done, "classify", "extract").count() == 135
    events = frame(spark, [(1, 1, "pending"), (1, 2, "done"), (2, 1, "failed")], "id long, ts long, status string")
    assert {r.id: r.status for r in status.latest_status(events).collect()} == {1: "done", 2: "failed"}


def _shuffled(df):
    """Bytes that an executed plan's exchanges wrote."""
    total = 0

    def walk(node):
        nonlocal total
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        below = node.children().iterator()
        while below.hasNext():
            walk(below.next())

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_searches_do_not_shuffle_whole_texts(spark, tmp_path):
    """Texts and vectors are a join, ids are repeated and null: the results are the first rows of the whole join, as before."""
    rng = random.Random(5)
    docs = [(i % 190 if i % 50 else None, f"{'with ' if i % 3 else ''}" + " ".join(f"{rng.getrandbits(60):x}" for _ in range(300))) for i in range(200)]
    vecs = [(i % 150, [rng.random() for _ in range(4)] if i % 7 else None) for i in range(160)]
    spark.createDataFrame(docs, "id long, content string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(vecs, "e_id long, embedding array<double>").write.parquet(f"{tmp_path}/e")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        d, e = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/e")
        chunks = d.join(e, d.id == e.e_id, "left").select("id", "content", F.col("id").alias("source_id"), F.lit("c").alias("course"), F.lit("b").alias("book"), "embedding")
        q = [0.5, 0.5, 0.5, 0.5]
        rows = chunks.collect()
        first = lambda x: (x is not None, x or 0)
        dist = lambda r: round(sum((a - b) ** 2 for a, b in zip(r.embedding, q)) ** 0.5, 9) if r.embedding else 9e9
        near, keyed = search.vector_search(chunks, q, 12), search.keyword_search(chunks, ["with", "WITH"], 4)
        assert [r.id for r in near.collect()] == [r.id for r in sorted(rows, key=lambda r: (dist(r), first(r.id)))[:12]]
        held = sorted((r for r in rows if "with" in r.content), key=lambda r: first(r.id))[:20]
        assert [r.id for r in keyed.collect()] == [r.id for r in held[:4]]
        assert _shuffled(near) + _shuffled(keyed) < 0.3 * sum(len(t) for _, t in docs)
    finally:
        for name in names:
            spark.conf.unset(name)
