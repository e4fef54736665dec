"""Insert, update and delete as functions from DataFrames to the DataFrame afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows whose key is not there yet, one of each key, are added."""
    there = table.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return table.unionByName(new.join(there, same, "left_anti").dropDuplicates(keys))


def upsert_latest(table: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: of new's if it has any, and of several the one of the highest version."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), F.col(version).desc_nulls_last())
    return both.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank", "__new")


def upsert_merge(rows: DataFrame, keys: list[str], order: str, latest: list[str] = (), greatest: list[str] = (), appended: list[str] = ()) -> DataFrame:
    """One row for each key: the latest values, the greatest, and arrays one behind the other in order; null arrays are empty."""
    made = [F.max_by(c, order).alias(c) for c in latest] + [F.max(c).alias(c) for c in greatest]
    for c in appended:
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
        made.append(F.flatten(F.transform(F.filter(listed, lambda x: x["v"].isNotNull()), lambda x: x["v"])).alias(c))
    return rows.groupBy(*keys).agg(*made)


def upsert_keep_old(pairs: DataFrame, a: str, b: str, order: str, kept: list[str]) -> DataFrame:
    """Unordered pairs a < b without loops; of each column the latest value that is not null."""
    ordered = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), order, *kept)
    return ordered.groupBy(a, b).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in kept])


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return table.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, condition: Column, protected: Column | None = None) -> DataFrame:
    """Rows of the condition go, but for protected ones; a null condition keeps a row."""
    gone = F.coalesce(condition, F.lit(False))
    return table.where(~gone if protected is None else ~gone | F.coalesce(protected, F.lit(False)))


def delete_children(child: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """child without the rows whose parent is among parents."""
    return child.join(parents.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def split_good_bad(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)
