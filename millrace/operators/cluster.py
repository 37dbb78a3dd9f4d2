"""Near-duplicate clustering over vectors, canonical rows, and evidence retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.graph import connected_components
from millrace.operators import density
from millrace.operators.blocks import similar_pairs, usable
from millrace.schemas import MIN_DENSITY_ROWS, MIN_RETRIEVAL, NEAR_DUPLICATE
from millrace.shared import cut


def clusters(rows: DataFrame, key: str, vector: str, threshold: float = NEAR_DUPLICATE, partition_by: str | None = None) -> DataFrame:
    """(id, component): the smallest key (a long) reachable over cosines >= threshold; with partition_by, only rows of one partition meet.

    Rows of one vector (and partition) are one point: their pairs are never listed.
    """
    same = F.col(partition_by) if partition_by else F.lit(None).cast("string")
    live = usable(vector) & F.exists(vector, lambda c: c != 0)
    ids = cut(rows.select(F.col(key).alias("id"), F.when(live, F.col(vector)).alias("v"), same.alias("p")))
    heads = cut(ids.where("v is not null").groupBy("v", "p").agg(F.min("id").alias("id")))
    h = heads.select(F.col("v").alias("hv"), F.col("p").alias("hp"), F.col("id").alias("point"))
    named = ids.join(h, (F.col("v") == F.col("hv")) & F.col("p").eqNullSafe(F.col("hp")), "left").select("id", F.coalesce("point", "id").alias("point"))
    pairs = similar_pairs(heads, "id", "v", threshold)
    if partition_by:
        of = heads.select(F.col("id").alias("k"), "p")
        pairs = pairs.join(of.toDF("a", "pa"), "a").join(of.toDF("b", "pb"), "b").where("pa <=> pb")
    found = connected_components(pairs.select("a", "b"))
    return named.join(found.toDF("point", "component"), "point", "left").select("id", F.coalesce("component", "point").alias("component"))


def cluster_rows(rows: DataFrame, key: str, vector: str, threshold: float = NEAR_DUPLICATE, few: int = MIN_DENSITY_ROWS) -> DataFrame:
    """(id, component): by the threshold graph under `few` rows, by density from there on."""
    return clusters(rows, key, vector, threshold) if rows.limit(few).count() < few else density.clusters(rows, key, vector)


def canonical(rows: DataFrame, cluster: str, key: str, ts: str, url: str) -> DataFrame:
    """One row per cluster: earliest parsed time (NULLs first), then smaller url (NULL as ''), then smaller key."""
    order = F.struct(F.col(ts).isNotNull(), ts, F.coalesce(F.col(url), F.lit("")), key)
    return rows.groupBy(cluster).agg(F.min_by(key, order).alias("canonical_id"), F.count("*").alias("members"))


def memberships(rows: DataFrame, cluster: str, key: str, ts: str, url: str) -> DataFrame:
    """key, cluster_id ('c_' + canonical key), is_canonical."""
    return rows.join(canonical(rows, cluster, key, ts, url), cluster).select(key, F.concat(F.lit("c_"), F.col("canonical_id").cast("string")).alias("cluster_id"), (F.col(key) == F.col("canonical_id")).alias("is_canonical"))


def retrieve(evidence: DataFrame, queries: DataFrame, canonical_ids: DataFrame, k: int = 5, min_similarity: float = MIN_RETRIEVAL) -> DataFrame:
    """evidence(signal_id, resource_id, embedding), queries(resource_id, query_vector): top k canonical rows of each resource by cosine.

    The rank's limit is known to the plan, so tasks cut their rows to k of a resource before these are shuffled (WindowGroupLimit).
    """
    rows = evidence.join(canonical_ids, "signal_id", "left_semi").join(queries, "resource_id")
    scored = rows.withColumn("similarity", V.cosine(F.col("embedding"), F.col("query_vector"))).where(F.col("similarity") >= min_similarity)
    w = Window.partitionBy("resource_id").orderBy(F.desc("similarity"), "signal_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("resource_id", "rank", "signal_id", "similarity")


def summary(members: DataFrame) -> DataFrame:
    return members.agg(F.countDistinct("cluster_id").alias("clusters"), F.sum(F.col("is_canonical").cast("long")).alias("canonical"), F.sum((~F.col("is_canonical")).cast("long")).alias("duplicates"))
