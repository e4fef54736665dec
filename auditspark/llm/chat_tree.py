"""Chat formatting of reply trees, in DataFrame operations only.

`reply_paths` enumerates root-to-leaf paths by iterative self-joins: in round k every node is joined with the node that its
pointer has reached and takes over that one's pointer, so that pointers lead to the 2^k-th ancestor, and adds up its scores.
A chain of n replies takes log2 n rounds. Leaves are ranked by the mean score of their path and the best of each tree are
chosen. Their paths are unrolled with the same tables from the last to the first: a path's nodes are joined with their 2^k-th
ancestors and doubled, so each node of a chosen path is met once. Texts join last.

`format_paths` writes each path as one conversation. A turn is `<s>[INST]role[/INST]text</s>`. A control string inside a role or
text gets a backslash behind its first character, and one that has backslashes there gets one more, so `read_turns` can take it
away again. The loss mask is an array of spans (code points) that cover exactly the escaped texts of the trained roles.

Defined cases: null roles and texts are empty; a reply whose parent is not in its tree is a root; rows on or below a cycle of
replies have no root and become roots of their own; of rows with the same node id (or none) the first by score, role and text is
the one replied to, and all are kept; a null tree id is a tree of its own. Trees without rows do not appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = ("assistant",)
#: A control string, perhaps with backslashes behind its first character.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


NODE = ["t", "n", "c"]  # tree, node, and the number of the copy among rows with the same node id


def _parents(nodes: DataFrame) -> DataFrame:
    """t, n, c, score, up: the parent's n, null for roots. The first copy of a node stands for it as a parent."""
    known = nodes.where("c = 1").select(F.col("t").alias("pt"), F.col("n").alias("pn"))
    linked = nodes.join(known, (F.col("t") == F.col("pt")) & (F.col("p") == F.col("pn")), "left")
    return linked.select(*NODE, "score", F.col("pn").alias("up"))


def _doubled(links: DataFrame, most_rounds: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """depth and total of every node; the pointer tables of each round; nodes that reach no root, if any.

    A node that has reached its root is set aside, so round k joins only nodes deeper than 2^k.
    """
    state = materialize(links.select(*NODE, "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "replies")
    settled, active, jumps = state.where("up IS NULL"), state.where("up IS NOT NULL"), []
    for _ in range(most_rounds):
        if not active.limit(1).count():
            return settled, jumps, None
        jumps.append(active.select(*NODE, "up"))
        far = settled.union(active).where("c = 1").select(F.col("t").alias("ft"), F.col("n").alias("fn"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("total").alias("further"))
        joined = active.join(far, (F.col("t") == F.col("ft")) & (F.col("up") == F.col("fn")))
        after = materialize(joined.select(*NODE, F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("further")).alias("total")), "replies")
        settled, active = settled.union(after.where("up IS NULL")), after.where("up IS NOT NULL")
    return settled.union(active), jumps, active.select(*NODE) if active.limit(1).count() else None


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str | None = None, branches: int | None = 1) -> DataFrame:
    """tree, leaf, branch, depth, pos, role, text: the rows of each chosen root-to-leaf path, from pos 1 at the root.

    messages has role and text. branch is the rank of the path in its tree, from 1: mean score descending, deeper first, then
    leaf. branches: how many of each tree to choose, None for all.
    """
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), _key(F.col(tree)).alias("t"), _key(F.col(node)).alias("n"), F.when(F.col(parent).isNotNull(), _key(F.col(parent))).alias("p"), points.alias("score"), "role", "text")
    copies = Window.partitionBy("t", "n").orderBy(F.desc("score"), "role", "text", "p")
    rows = materialize(rows.withColumn("c", F.row_number().over(copies)), "messages")
    links = _parents(rows.select(*NODE, "p", "score"))
    rounds = max(1, rows.count()).bit_length() + 1
    state, jumps, lost = _doubled(links, rounds)
    if lost is not None:
        cut = lost.select(*[F.col(x).alias(f"l{x}") for x in NODE])
        same = (F.col("t") == F.col("lt")) & (F.col("n") == F.col("ln")) & (F.col("c") == F.col("lc"))
        links = links.join(cut, same, "left").withColumn("up", F.when(F.col("lt").isNull(), F.col("up"))).drop("lt", "ln", "lc")
        state, jumps, _ = _doubled(links, rounds)
    replied = (jumps[0] if jumps else links.where("false")).select(F.col("t").alias("rt"), F.col("up").alias("rn")).distinct()
    leaves = state.select(*NODE, "depth", (F.col("total") / F.col("depth")).alias("mean")).join(replied, (F.col("t") == F.col("rt")) & (F.col("n") == F.col("rn")) & (F.col("c") == 1), "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mean"), F.desc("depth"), "n", "c"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    paths = materialize(chosen.select("t", F.col("n").alias("leaf_n"), F.col("c").alias("leaf_c"), "branch", "depth", "n", "c", F.lit(0).cast("long").alias("steps")), "leaves")
    for k in reversed(range(len(jumps))):
        jump = jumps[k].toDF("jt", "jn", "jc", "up")
        up = paths.join(jump, (F.col("t") == F.col("jt")) & (F.col("n") == F.col("jn")) & (F.col("c") == F.col("jc")))
        up = up.select("t", "leaf_n", "leaf_c", "branch", "depth", F.col("up").alias("n"), F.lit(1).alias("c"), (F.col("steps") + 2**k).alias("steps"))
        paths = materialize(paths.union(up), "paths")
    texts = rows.select("tree", "node", *[F.col(x).alias(f"x{x}") for x in NODE], "role", "text")
    full = paths.join(texts, (F.col("t") == F.col("xt")) & (F.col("n") == F.col("xn")) & (F.col("c") == F.col("xc")))
    return full.select("tree", F.struct("leaf_n", "leaf_c").alias("leaf"), "branch", "depth", (F.col("depth") - F.col("steps")).alias("pos"), "role", "text")


def format_paths(paths: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """tree, leaf, branch, formatted, loss_spans (array of start, length in code points): one row for each path."""
    head = F.concat(F.lit(BEGIN + OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    turns = paths.select("tree", "leaf", "branch", "pos", F.coalesce("role", F.lit("")).isin(*trained).alias("trained"), head.alias("head"), body.alias("body"))
    so_far = F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    span = F.when(F.col("trained"), F.struct((F.coalesce(so_far, F.lit(0)) + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    turns = turns.select("tree", "leaf", "branch", "pos", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    one = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "span"))).alias("turns"))
    return one.select("tree", "leaf", "branch", F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    parts = F.split(formatted, END, -1)
    role = lambda p: F.substring_index(p, CLOSE, 1)
    head = len(BEGIN + OPEN)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(unescape(F.substr(role(p), F.lit(head + 1))).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(CLOSE) + 1)).alias("text")),
    )


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, span by span, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def as_chain(rows: DataFrame, conversation: str, turn: str) -> DataFrame:
    """rows as reply trees of one branch: each row replies to the one before it by turn, then role and text."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    numbered = rows.select(F.col(conversation).alias("tree"), "role", "text", F.row_number().over(order).alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
