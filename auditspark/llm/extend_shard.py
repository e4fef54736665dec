"""Sharding by extendible hashing: only oversized buckets are split on another bit of the hash.

Rows are hashed over (doc_id, text). A directory is indexed by the leading bits; a bucket whose bytes exceed the limit is split
on its next bit until every bucket fits. Bytes are added up over STRIDE further bits at a time, before the shuffle, so a round
moves a few sums and not rows, and only rows of oversized buckets enter the next round.

Rows that all 64 bits leave together (rows that are equal in doc_id and text) cannot be told apart by hashing: their bucket
gets overflow pages, as many as the limit asks for, dealt out by a number that is unique to a row. So no shard exceeds the
limit but one that holds a single row longer than the limit (`oversized`).

Defined cases: null doc_id or text are hashed as nulls, and a null text has no bytes; no rows give no shards. Columns of the
same names as the output's are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_fresh

#: Bytes of text in a shard at most.
MAX_BYTES = 16 << 20
#: Bits by which the directory is deepened at a time.
STRIDE = 8
HASH_BITS = 64


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _settled(sums: DataFrame, depth: int, limit: int) -> DataFrame:
    """sums(prefix, bytes, n) at `depth` with the least depth at which the bucket fits (null if it does not yet).

    A bucket of one row cannot be split and counts as fitting. Ancestors of all depths of the stride are summed over the
    at most 2^STRIDE prefixes below each bucket of the round before.
    """
    fits = F.lit(None).cast("int")
    for d in range(depth, depth - STRIDE - (depth == STRIDE), -1):
        bucket = Window.partitionBy(F.shiftrightunsigned("prefix", depth - d), F.shiftrightunsigned("prefix", STRIDE))
        ok = (F.sum("bytes").over(bucket) <= limit) | (F.sum("n").over(bucket) == 1)
        fits = F.when(ok, F.lit(d)).otherwise(fits)
    return sums.withColumn("fits", fits)


def directory(keys: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The directory of keys(h, bytes): at, lo, depth, shard_bytes, pages, page_rows, oversized.

    Rows whose hash begins with `lo` (of `at` bits) are in the bucket of the first `depth` bits, which holds shard_bytes;
    a bucket of more than one page overflows, with page_rows of its equal rows on each.
    """
    rest, found, depth = keys, None, 0
    while True:
        depth += STRIDE
        sums = rest.groupBy(_prefix(F.col("h"), depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        settled = materialize(_settled(sums, depth, max_bytes), "buckets")
        last = depth == HASH_BITS
        done = settled if last else settled.where(F.col("fits").isNotNull())
        page_rows = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.lit(1.0), F.col("bytes") / F.col("n")))).cast("long")
        bucket = Window.partitionBy("depth", F.expr(f"shiftrightunsigned(prefix, {depth} - depth)"))
        done = done.withColumn("depth", F.coalesce("fits", F.lit(depth))).select(
            F.lit(depth).alias("at"), F.col("prefix").alias("lo"), "depth", F.sum("bytes").over(bucket).alias("shard_bytes"),
            F.when(F.col("fits").isNull(), F.ceil(F.col("n") / page_rows)).otherwise(F.lit(1)).cast("long").alias("pages"),
            page_rows.alias("page_rows"), ((F.sum("n").over(bucket) == 1) & (F.sum("bytes").over(bucket) > max_bytes)).alias("oversized"),
        )
        found = done if found is None else found.union(done)
        unsettled = settled.where(F.col("fits").isNull()).select("prefix")
        if last or not unsettled.limit(1).count():
            return found
        rest = materialize(rest.withColumn("prefix", _prefix(F.col("h"), depth)).join(unsettled, "prefix", "left_semi").select("h", "bytes"), "oversized")


def assign_shards(docs: DataFrame, max_bytes: int = MAX_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (the bits of its bucket; for a page of an overflowing one also its group and number), shard_bytes, oversized.

    Every row is in one shard. For the directory, hashes and lengths alone are kept of the rows.
    """
    own = {"__h": F.xxhash64(F.col(doc_id), F.col(text)), "__bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")}
    kept = [c for c in docs.columns if c.lower() not in ("shard", "shard_bytes", "oversized")]
    rows = with_fresh(docs, own)
    tree = materialize(directory(materialize(rows.select(F.col("__h").alias("h"), F.col("__bytes").alias("bytes")), "keys"), max_bytes), "directory")
    entries = ("at", "lo", "depth", "shard_bytes", "pages", "page_rows", "oversized")
    levels = sorted(r.at for r in tree.select("at").distinct().toLocalIterator())  # HASH_BITS / STRIDE at most
    for at in levels:
        entry = tree.where(F.col("at") == at).select(F.col("lo").alias(f"__lo{at}"), F.struct(*entries).alias(f"__at{at}"))
        rows = rows.withColumn(f"__lo{at}", _prefix(F.col("__h"), at)).join(entry, f"__lo{at}", "left")
    found = F.coalesce(*[F.col(f"__at{at}") for at in levels]) if levels else F.expr("CAST(NULL AS struct<at:int,lo:bigint,depth:int,shard_bytes:bigint,pages:bigint,page_rows:bigint,oversized:boolean>)")
    rows = rows.withColumn("__e", found)
    bits = F.expr("substring(lpad(bin(__e.lo), 64, '0'), 65 - __e.at, __e.depth)")
    columns = [F.col(f"`{c}`") for c in kept]
    plain = rows.where("__e.pages = 1").select(*columns, bits.alias("shard"), F.col("__e.shard_bytes").alias("shard_bytes"), F.col("__e.oversized").alias("oversized"))
    if not tree.where("pages > 1").limit(1).count():
        return plain
    # Equal rows are equally long, so pages are filled by counting; in groups of some 100,000 rows, so that no task sorts more.
    group = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("__e.pages") * F.col("__e.page_rows") / 100_000))
    over = rows.where("__e.pages > 1").withColumn("__group", group)
    number = F.row_number().over(Window.partitionBy("__h", "__group").orderBy("__bytes")) - 1
    over = over.withColumn("__page", F.floor(number / F.col("__e.page_rows")))
    on_page = F.sum("__bytes").over(Window.partitionBy("__h", "__group", "__page"))
    paged = over.select(*columns, F.concat_ws(".", bits, "__group", "__page").alias("shard"), on_page.alias("shard_bytes"), (F.col("__bytes") > max_bytes).alias("oversized"))
    return plain.union(paged)
