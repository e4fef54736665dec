"""Duplicates, quality rules and sampling of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def mark_duplicates(files: DataFrame, digest: str, order: str) -> DataFrame:
    """files with first_id (of the least `order` with the digest) and is_duplicate. A null digest is like no other.

    The first of each digest is an aggregate that joins back, so a digest of very many files is no group of one task.
    """
    first = files.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min(order).alias("first_id"))
    joined = files.join(first, F.col(digest) == F.col("__d"), "left").drop("__d").withColumn("first_id", F.coalesce("first_id", order))
    return joined.withColumn("is_duplicate", F.col("first_id") != F.col(order))


def near_duplicate_pairs(hashes: DataFrame, least_bits: int = 5, bucket_bits: int = 16) -> DataFrame:
    """a, b: ids of hashes(id, h) in the same bucket of leading bits that differ in fewer than least_bits bits.

    Equal hashes are met once, by their least id, so copies make no pairs among themselves.
    """
    distinct = hashes.groupBy("h").agg(F.min("id").alias("id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bucket_bits))
    a, b = distinct.toDF("h_a", "a", "bucket"), distinct.toDF("h_b", "b", "bucket_b")
    near = a.join(b, (F.col("bucket") == F.col("bucket_b")) & (F.col("a") < F.col("b")))
    return near.where(F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))) < least_bits).select("a", "b", F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).cast("int").alias("bits"))


def near_duplicate_pairs_global(hashes: DataFrame, least_bits: int = 5) -> DataFrame:
    """a, b, bits of all hashes(id, h) that differ in fewer than least_bits bits, whatever bucket they are in. Equal hashes are met once,
    by their least id; near_duplicate_links_global tells their copies too.

    Up to least_bits 3 such a pair is one hash if a bit at most is changed in each, so pairs meet on hashes with one changed bit, of
    those bits that differ between any. Beyond that, of least_bits segments of a hash such a pair has one in common.
    """
    first = hashes.groupBy("h").agg(F.min("id").alias("id"))
    bits = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    if least_bits <= 3:
        first = cut(first)
        varies = first.agg(F.bit_or("h").bitwiseXOR(F.bit_and("h")).alias("m")).first().m or 0
        one = [F.col("h").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64) if varies >> i & 1]
        keyed = lambda most: first.select("id", "h", F.explode(F.array(F.col("h"), *(one if most else []))).alias("s"))
        a, b = keyed(least_bits > 1).toDF("a", "h_a", "s"), keyed(least_bits > 2).toDF("b", "h_b", "s_b")
        met = a.join(b, (F.col("s") == F.col("s_b")) & (F.col("a") < F.col("b")))
    else:
        cuts = [64 * i // least_bits for i in range(least_bits + 1)]
        segment = lambda x, y: F.shiftrightunsigned(F.shiftleft("h", x), 64 - (y - x))
        segments = F.array(*[F.struct(F.lit(i).alias("i"), segment(x, y).alias("s")) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))])
        rows = first.select("id", "h", F.explode(segments).alias("at")).select("id", "h", "at.*")
        a, b = rows.toDF("a", "h_a", "i", "s"), rows.toDF("b", "h_b", "i_b", "s_b")
        met = a.join(b, (F.col("i") == F.col("i_b")) & (F.col("s") == F.col("s_b")) & (F.col("a") < F.col("b")))
    return met.where(bits < least_bits).select("a", "b", bits.cast("int").alias("bits")).distinct()


def near_duplicate_links_global(hashes: DataFrame, least_bits: int = 5) -> DataFrame:
    """a, b, bits: the pairs of near_duplicate_pairs_global between the least ids of equal hashes, and for each other id b of a hash its
    least one as a, with 0 bits. Every row that is near another is there, and any two near rows are near by their least ids.

    The least id of each hash is an aggregate that joins back, so a hash of very many rows is no group of one task and makes no pairs.
    """
    first = hashes.where(F.col("h").isNotNull()).groupBy(F.col("h").alias("h_a")).agg(F.min("id").alias("a"))
    copies = hashes.join(first, F.col("h") == F.col("h_a")).where(F.col("id") != F.col("a"))
    return near_duplicate_pairs_global(hashes, least_bits).unionByName(copies.select("a", F.col("id").alias("b"), F.lit(0).alias("bits")))


def greedy_near_duplicates(hashes: DataFrame, least_bits: int = 5, bucket_bits: int = 16) -> DataFrame:
    """id, kept: in order of id a hash stays if it is not near one that stays in its bucket, and all copies follow the first.

    In rounds: a hash without a smaller undecided near one stays, what is near it goes, and both are decided. The least
    undecided one is always among them, so the rounds end.
    """
    first = hashes.groupBy("h").agg(F.min("id").alias("first"))
    left = cut(near_duplicate_pairs(hashes, least_bits, bucket_bits).select("a", "b"))
    gone = left.select(F.col("b").alias("g")).limit(0)
    while left.limit(1).count():
        stays = left.select(F.col("a").alias("s")).join(left.select(F.col("b").alias("s")), "s", "left_anti").distinct()
        out = cut(left.join(stays, F.col("a") == F.col("s"), "left_semi").select(F.col("b").alias("g")).distinct())
        gone = gone.union(out)
        decided = stays.union(out).toDF("d")
        left = cut(left.join(decided, F.col("a") == F.col("d"), "left_anti").join(decided, F.col("b") == F.col("d"), "left_anti"))
    joined = hashes.join(first.withColumnRenamed("h", "h_first"), F.col("h") == F.col("h_first")).join(gone.withColumn("is_gone", F.lit(True)), F.col("first") == F.col("g"), "left")
    return joined.select("id", ((F.col("id") == F.col("first")) & F.col("is_gone").isNull()).alias("kept"))


QC = {"min_kb": 3, "min_side": 100, "min_ratio": 0.2, "max_ratio": 8.0, "min_variance": 50.0}


def qc_issues(size_kb: Column, width: Column, height: Column, variance: Column, limits: dict = QC) -> Column:
    """The reasons against an image, in order; none for a valid one. Unknown sizes mean that it cannot be read; without height there is
    no ratio."""
    ratio = width / F.nullif(height, F.lit(0))
    return F.array_compact(F.array(
        F.when(size_kb < limits["min_kb"], "file_too_small"), F.when(width.isNull() | height.isNull(), "corrupt"), F.when(F.least(width, height) < limits["min_side"], "too_small"),
        F.when((ratio < limits["min_ratio"]) | (ratio > limits["max_ratio"]), "odd_ratio"), F.when(variance < limits["min_variance"], "blank"),
    ))


def qc_report(images: DataFrame) -> DataFrame:
    """issue, n of images(issues); images with several count for each."""
    return images.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def qc_summary(images: DataFrame) -> DataFrame:
    """One row of images(issues, width, height): total, valid, invalid, valid_rate (a percentage of one decimal) and the least,
    greatest and mean sides of the valid ones."""
    ok = F.size("issues") == 0
    side = lambda c: F.when(ok & (F.col(c) > 0), F.col(c))
    measures = [f(side(c)).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("avg", lambda x: F.round(F.avg(x), 4)))]
    counted = images.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), *measures)
    rate = F.when(F.col("total") > 0, F.concat(F.round(F.col("valid") * 100 / F.col("total"), 1).cast("decimal(5,1)").cast("string"), F.lit("%"))).otherwise("0%")
    return counted.withColumn("valid_rate", rate)


def qc_by_category(images: DataFrame) -> DataFrame:
    """category, total, valid, invalid of images(name, issues)."""
    ok = F.size("issues") == 0
    return images.groupBy(file_category(F.col("name")).alias("category")).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def cleaning_counts(entries: DataFrame, invalid: DataFrame, split: str = "split", path: str = "image") -> DataFrame:
    """split, kept, removed: what without_invalid leaves and takes of each split."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    bad = invalid.select(base(F.col("path")).alias("__name")).distinct().withColumn("__bad", F.lit(True))
    marked = entries.join(bad, base(F.col(path)) == F.col("__name"), "left")
    return marked.groupBy(split).agg(F.count_if(F.col("__bad").isNull()).alias("kept"), F.count_if(F.col("__bad").isNotNull()).alias("removed"))


def file_category(name: Column) -> Column:
    """What stands before the last underscore; 未知 without one."""
    return F.when(F.contains(name, F.lit("_")), F.regexp_extract(name, "(?s)^(.*)_", 1)).otherwise("未知")


def normalized_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def _order(key: Column, seed: int) -> list[Column]:
    return [F.md5(F.concat(key.cast("string"), F.lit(str(seed)))), key]


def stratified_sample(rows: DataFrame, stratum: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """Up to `most` rows of each stratum, by a hash of the key."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*_order(F.col(key), seed)))
    return rows.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def train_split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with split: the first floor(n * share) by a hash of the key are train, the rest val.

    The border is found by counting hashes of a prefix at a time, not by numbering all rows in one task.
    """
    hashed = rows.withColumn("__h", _order(F.col(key), seed)[0])
    counts = hashed.groupBy(F.left("__h", F.lit(3)).alias("p")).count().orderBy("p").collect()  # 4096 at most
    border = int(sum(r["count"] for r in counts) * share + 1e-9)
    before, at = 0, None
    for r in counts:
        if before + r["count"] > border:
            at = r["p"]
            break
        before += r["count"]
    if at is None:
        return hashed.withColumn("split", F.lit("train")).drop("__h")
    prefix = F.left("__h", F.lit(3))
    number = F.row_number().over(Window.partitionBy(F.lit(at)).orderBy("__h", key))
    close = hashed.where(prefix == at).withColumn("split", F.when(number <= border - before, "train").otherwise("val"))
    rest = hashed.where(prefix != at).withColumn("split", F.when(prefix < at, "train").otherwise("val"))
    return rest.unionByName(close).drop("__h")


def without_invalid(entries: DataFrame, invalid: DataFrame, path: str = "image") -> DataFrame:
    """entries whose file name is not among invalid(path)."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    return entries.join(invalid.select(base(F.col("path")).alias("__name")).distinct(), base(F.col(path)) == F.col("__name"), "left_anti")
