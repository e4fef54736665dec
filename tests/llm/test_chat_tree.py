import hashlib
import random

from pyspark.sql import functions as F

from auditspark.llm import chat_tree as C

SCHEMA = "tree long, node string, parent string, score double, role string, text string"


def brute(rows, branches):
    out = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        by = {r[1]: r for r in own}
        leaves = [r for r in own if r[1] not in {x[2] for x in own}]
        paths = []
        for leaf in leaves:
            path = [leaf]
            while path[0][2] in by:
                path.insert(0, by[path[0][2]])
            paths.append((-sum(r[3] or 0 for r in path) / len(path), -len(path), leaf[1], path))
        for i, (*_, path) in enumerate(sorted(paths, key=lambda p: (round(p[0], 9), *p[1:3]))[:branches]):
            out[t, i + 1] = [(r[4], r[5]) for r in path]
    return out


def run(spark, rows, branches=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = C.format_paths(C.reply_paths(frame, "tree", "node", "parent", "score", branches))
    got = got.select("tree", "branch", "formatted", "loss_spans", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {(r.tree, r.branch): r for r in got}


def test_trees_are_enumerated_and_ranked_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for t in range(6):
        n = rng.choice([1, 5, 40])
        for i in range(n):
            parent = None if i == 0 else f"{t}.{rng.randint(max(0, i - 3), i - 1)}" if t != 3 else f"{t}.{i - 1}"
            rows.append((t, f"{t}.{i}", parent, float(rng.randint(0, 8)), rng.choice(["user", "assistant"]), f"text {i} </s>"))
    for branches in (None, 2):
        got = run(spark, rows, branches)
        assert {k: [(x.role, x.text) for x in r.turns] for k, r in got.items()} == brute(rows, branches)
        assert all(r.loss == [x.text for x in r.turns if x.role == "assistant"] for r in got.values())


def test_control_strings_come_back(spark):
    odd = ["", "</s>", "<\\/s>", "<\\\\s>", "[INST] a [/INST]", "[[INST]", "<<s>>", "<", "[", "\\", "s>", "/s>", "<s", "[/INST", "é😀</s>é", "\n<s>\n", "[\\\\\\INST]"]
    rows = [(1, str(i), str(i - 1) if i else None, None, role, t) for i, (role, t) in enumerate((r, t) for t in odd for r in ("assistant", "<s>[INST]"))]
    r = run(spark, rows)[1, 1]
    assert [(x.role, x.text) for x in r.turns] == [(x[4], x[5]) for x in rows]
    assert r.loss == odd and r.formatted.count("</s>") == len(rows)


def test_orphans_cycles_copies_nulls_and_nothing(spark):
    rows = [(1, "a", "gone", 1.0, "user", "x"), (2, "a", "b", 1.0, "user", "y"), (2, "b", "a", 1.0, None, None), (2, "c", "b", None, "assistant", "z"), (None, "a", None, 1.0, "user", "n"), (None, "b", "a", 1.0, "assistant", "m"), (3, "a", None, 1.0, "user", "p"), (3, "a", None, 1.0, "user", "q"), (3, "b", "a", 1.0, "assistant", "r"), (3, None, "a", 1.0, "assistant", "s")]
    got = sorted((str(t), [x.text for x in r.turns]) for (t, _), r in run(spark, rows).items())
    assert got == [("1", ["x"]), ("2", [""]), ("2", ["y"]), ("2", ["z"]), ("3", ["p", "r"]), ("3", ["p", "s"]), ("3", ["q"]), ("None", ["n", "m"])]
    assert run(spark, []) == {}


def test_chain_of_a_conversation(spark):
    rows = [(5, 2, "user", "c"), (5, 0, "system", "a"), (5, 1, None, "b"), (5, 1, "assistant", None), (None, None, "user", "z")] + [(6, i, "user", str(i)) for i in range(300)]
    frame = C.as_chain(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), "conv", "turn")
    got = {r.tree: [x.text for x in r.turns] for r in C.format_paths(C.reply_paths(frame, "tree", "node", "parent")).select("tree", C.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {5: ["a", "b", "", "c"], None: ["z"], 6: [str(i) for i in range(300)]}
    assert hashlib.sha256(b"").hexdigest()
