"""Write semantics as frame-to-frame operators: what to append, replace or keep. Writers below apply them to Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def fresh(existing: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of batch whose key is not stored yet, the first of each key in `order`; NULLs in keys compare as values."""
    one = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return one.alias("n").join(existing.select(*keys).distinct().alias("e"), _same("n", "e", keys), "left_anti")


def append_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    return existing.unionByName(fresh(existing, batch, keys, order), allowMissingColumns=True)


def above_watermark(existing: DataFrame, batch: DataFrame, ts: str) -> DataFrame:
    """Rows of batch later than all that is stored (all of them if nothing is)."""
    mark = existing.agg(F.max(ts).alias("_mark"))
    return batch.join(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")  # mark: one row


def replace_groups(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Delete and insert: groups present in batch are replaced whole."""
    kept = existing.alias("e").join(batch.select(*keys).distinct().alias("n"), _same("e", "n", keys), "left_anti")
    return kept.unionByName(batch)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert or replace by primary key; of equal keys in batch the last in `order` counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = batch.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_r = _n").drop("_r", "_n")
    return replace_groups(existing, last, keys)


def update(existing: DataFrame, changes: DataFrame, key: str, columns: list[str], scope: Column | None = None) -> DataFrame:
    """Sets columns from changes where key matches and scope holds; everything else stays."""
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_{x}") for x in columns), F.lit(True).alias("_hit"))
    j = existing.join(c, existing[key] == c["_k"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & (scope if scope is not None else F.lit(True))
    return j.select(*(F.when(hit, F.col(f"_{x}")).otherwise(existing[x]).alias(x) if x in columns else existing[x] for x in existing.columns))


def violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference names no parent (NULL references are allowed)."""
    p = parent.select(F.col(parent_column).alias("_p")).distinct()
    return child.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_p"), "left_anti")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Additive schema change: a nullable column, once."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables has; empty if they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("_side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("_side", F.lit("b")))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """mode 'dynamic' replaces only the partitions that df has."""
    w = df.write.mode("overwrite" if mode == "dynamic" else mode)
    if mode == "dynamic":
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, most: int = 1_000_000) -> None:
    """Report files for people: one file per partition value, or as many as there are tasks where the report has over `most` rows."""
    w = (df.coalesce(1) if df.limit(most + 1).count() <= most else df).write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
