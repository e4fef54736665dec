"""Knowledge-graph operators over edges(src, dst, type, weight)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where it is unset, in local mode alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="auditspark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, so that lineage does not grow with the rounds and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within this hands Python at most so many rows at a time; for rows as large as files."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "type").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("<-"), "type").alias("type")))


def bfs(edges: DataFrame, start: DataFrame, max_depth: int = 3, types: list[str] | None = None, directed: bool = False) -> DataFrame:
    """id, depth, parent, type of every node within max_depth hops of start(id); the parent is the least of the nearest.

    Each hop joins the frontier with the edges and drops what was visited before.
    """
    edges = edges.where(F.col("type").isin(types)) if types else edges
    steps = edges.select("src", "dst", "type") if directed else both_ways(edges)
    visited = cut(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("type")))
    for depth in range(1, max_depth + 1):
        frontier = visited.where(F.col("depth") == depth - 1).select(F.col("id").alias("src"))
        reached = steps.join(frontier, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.col("src").alias("parent"), "type")).alias("by"))
        new = reached.join(visited.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("by.parent").alias("parent"), F.col("by.type").alias("type"))
        new = cut(new)
        if not new.limit(1).count():
            break
        visited = visited.union(new)
    return visited


def paths(visited: DataFrame, names: DataFrame, least_depth: int = 2, most: int = 10) -> DataFrame:
    """Names from the start to a node, joined by arrows; the first `most` in order."""
    deepest = visited.agg(F.max("depth").alias("d")).first().d or 0
    walk = visited.where(F.col("depth") >= least_depth).select(F.col("id").alias("end"), F.col("parent").alias("at"), F.array("id").alias("ids"))
    for _ in range(deepest):
        up = visited.select(F.col("id").alias("u"), F.col("parent").alias("next"))
        joined = walk.join(up, F.col("at") == F.col("u"), "left")
        walk = joined.select("end", F.col("next").alias("at"), F.when(F.col("u").isNotNull(), F.concat(F.array("u"), "ids")).otherwise(F.col("ids")).alias("ids"))
    named = walk.select("end", F.posexplode("ids").alias("pos", "id")).join(names.select("id", "name"), "id")
    joined = named.groupBy("end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " → ").alias("path"))
    return joined.select("path").distinct().orderBy("path").limit(most)


def _walked_back(visited: DataFrame, meeting: DataFrame, deepest: int, side: str) -> DataFrame:
    """One row: nodes from `meeting`(id) back to the start of visited, and the types of the edges between them."""
    walk = meeting.select(F.col("id").alias("at"), F.array("id").alias(f"{side}_nodes"), F.array().cast("array<string>").alias(f"{side}_types"))
    up = visited.select(F.col("id").alias("u"), F.col("parent").alias("next"), F.col("type").alias("by"))
    for _ in range(deepest):
        joined = walk.join(F.broadcast(walk.select(F.col("at").alias("w"))).join(up, F.col("w") == F.col("u")).drop("w"), F.col("at") == F.col("u"), "left")
        there = F.col("next").isNotNull()
        walk = joined.select(F.coalesce("next", "at").alias("at"), F.when(there, F.concat(f"{side}_nodes", F.array("next"))).otherwise(F.col(f"{side}_nodes")).alias(f"{side}_nodes"), F.when(there, F.concat(f"{side}_types", F.array("by"))).otherwise(F.col(f"{side}_types")).alias(f"{side}_types"))
    return walk.drop("at")


def find_path(edges: DataFrame, source: int, target: int, max_depth: int = 5, mode: str = "directed") -> DataFrame:
    """One row with the length of the shortest path, where its halves meet, its nodes, and the types of the edges between them;
    none if there is none within max_depth.

    "directed" goes out from the source and against the edges from the target; "compat" goes along the edges from both, so it
    finds a common descendant, and the types of the second half begin with <-, as the path goes against those edges. Of paths of
    one length the one of the least meeting node is taken, and from there the least node on either side.
    """
    spark = edges.sparkSession
    one = lambda i: spark.range(i, i + 1)
    back = edges if mode == "compat" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    half = (max_depth + 1) // 2
    ahead = bfs(edges, one(source), half, directed=True)
    behind = bfs(back, one(target), max_depth - half, directed=True)
    met = ahead.select("id", F.col("depth").alias("a")).join(behind.select("id", F.col("depth").alias("b")), "id")
    best = cut(met.select((F.col("a") + F.col("b")).alias("length"), F.col("id").alias("meeting")).orderBy("length", "meeting").limit(1))
    meeting = best.select(F.col("meeting").alias("id"))
    walked = best.join(_walked_back(ahead, meeting, half, "a"), F.element_at("a_nodes", 1) == F.col("meeting")).join(_walked_back(behind, meeting, max_depth - half, "b"), F.element_at("b_nodes", 1) == F.col("meeting"))
    second = F.transform("b_types", lambda t: F.concat(F.lit("<-"), t)) if mode == "compat" else F.col("b_types")
    nodes = F.concat(F.reverse("a_nodes"), F.slice("b_nodes", F.lit(2), F.size("b_nodes")))
    return walked.select("length", "meeting", nodes.alias("nodes"), F.concat(F.reverse("a_types"), second).alias("types"))


def expand(edges: DataFrame, entities: DataFrame, node: int) -> DataFrame:
    """The neighbours of one node with direction and edge; none if the node is unknown."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "type", F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "type", F.lit("in").alias("direction"))
    known = entities.where(F.col("id") == node).select(F.lit(1).alias("__one"))
    return out.union(into).join(entities.select("id", "name"), "id").join(F.broadcast(known.limit(1)), F.lit(True)).drop("__one")


def link_entities(entities: DataFrame, query: str, words: list[str], most: int = 20) -> DataFrame:
    """Entities whose name holds a word, by trigram similarity with the query or summed over the words."""
    held = F.lit(False)
    total = F.lit(0.0)
    for w in words:
        held = held | F.ilike("name", F.lit(f"%{w}%"))
        total = total + trigram_similarity(F.col("name"), F.lit(f"%{w}%"))
    score = F.round(F.greatest(trigram_similarity(F.col("name"), F.lit(query)), total), 6)
    return entities.where(held).select("id", "name", score.alias("score")).orderBy(F.desc("score"), "id").limit(most)


def match_names(names: DataFrame, known: DataFrame, most_edits: int = 2, least_length: int = 3) -> DataFrame:
    """name, match, kind of names(name) among known(id, name): exact, else the nearest within most_edits, the least id first.

    A known name is cut into most_edits + 1 pieces. Within so many edits of it one of the pieces is left as it is, moved by no more
    places than that; so names meet on (length of the known name, piece, its text), and a name looks for few of them.
    """
    pieces = most_edits + 1
    number = F.sequence(F.lit(0), F.lit(pieces - 1))
    cut_at = lambda length, i: F.floor(length * i / pieces).cast("int")

    def piece(text, length, i, moved=0):
        begin, end = cut_at(length, i), cut_at(length, i + 1)
        return F.struct(length.alias("n"), i.alias("i"), F.substr(text, begin + 1 + moved, end - begin).alias("piece"))

    some = names.select("name").distinct()
    right = known.select(F.col("id").alias("match"), F.col("name").alias("known_name"))
    exact = some.join(right, F.col("name") == F.col("known_name")).select("name", "match", "known_name")
    size = F.length("known_name")
    held = right.where(size >= least_length).withColumn("key", F.explode(F.transform(number, lambda i: piece(F.col("known_name"), size, i))))
    # A name of n letters asks for known names of n - most_edits to n + most_edits letters, and for pieces moved as far.
    lengths = F.sequence(F.greatest(F.lit(least_length), F.length("name") - most_edits), F.length("name") + most_edits)
    shifts = F.array(*[F.lit(k) for k in range(-most_edits, most_edits + 1)])
    asked = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(number, lambda i: F.transform(F.filter(shifts, lambda k: (cut_at(n, i) + k >= 0) & (cut_at(n, i + 1) + k <= F.length("name"))), lambda k: piece(F.col("name"), n, i, k))))))
    left = some.where(F.length("name") >= least_length).withColumn("key", F.explode(F.array_distinct(asked)))
    near = left.join(held, "key").select("name", "match", "known_name").where(F.levenshtein("name", "known_name", most_edits) >= 0).union(exact).distinct()
    best = near.withColumn("edits", F.levenshtein("name", "known_name")).groupBy("name").agg(F.min(F.struct("edits", "match")).alias("best"))
    return best.select("name", F.col("best.match").alias("match"), F.col("best.edits").alias("edits"), F.when(F.col("best.edits") == 0, "exact").otherwise("fuzzy").alias("kind"))


def least_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: connected components; the label is the least id that can be reached.

    Each round links every larger neighbour of a node to the least one, then every smaller neighbour, until the links are stars:
    about log n rounds, whatever the diameter. The least neighbour is an aggregate, so a node of very many edges costs no more.
    """
    now = cut(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    told = lambda frame: frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    state = told(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, told(now)
        if before == state:
            break
    return nodes.join(now, F.col("id") == F.col("u"), "left").select(F.col("id").alias("node"), F.coalesce("v", "id").alias("label"))


def communities(edges: DataFrame, nodes: DataFrame, least: int = 2, shown: int = 3, words: int = 5, membership: DataFrame | None = None) -> DataFrame:
    """community, size, label, keywords of every community of at least `least` nodes(id, name); names in order of id.

    membership(node, community) tells the communities; without it they are the connected components. One may hold any number of nodes: its first names are picked by rank and not gathered all.
    """
    found = least_labels(edges, nodes.select("id")) if membership is None else membership.select("node", F.col("community").alias("label"))
    labelled = found.join(nodes.select(F.col("id").alias("node"), "name"), "node")
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    ranked = labelled.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("node"))).where(F.col("rank") <= words)
    first = ranked.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("keywords"))
    return sizes.join(first, "label").select(F.col("label").alias("community"), "size", F.array_join(F.slice("keywords", 1, shown), "、").alias("label"), "keywords")


def normalize_entities(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Names trimmed and of 2 to 100 characters; a blank type is concept, a blank importance 中. Columns of keep stay."""
    name = F.trim("name")
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    return raw.select(name.alias("name"), blank("entity_type", "concept").alias("entity_type"), blank("importance", "中").alias("importance"), *keep).where(F.length("name").between(2, 100))


# The relation types that a graph may have.
RELATION_TYPES = ("derives_from", "references", "contrasts_with", "prerequisite_of", "composes", "leads_to", "belongs_to", "tested_by", "similar_to")


def normalize_relations(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Without loops and blank ends; an unknown type is references, a missing confidence 0.5. Columns of keep stay."""
    src, dst = F.trim("source"), F.trim("target")
    kind = F.when(F.col("type").isin(*RELATION_TYPES), F.col("type")).otherwise("references")
    kept = raw.select(src.alias("source"), dst.alias("target"), kind.alias("type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), *keep)
    return kept.where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
