"""Recall at k, full hits and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.text import is_blank


def recall(changed: Column, retrieved: Column) -> Column:
    """The share of the changed files that were retrieved; 0 without changed files."""
    none = F.array().cast("array<string>")
    c, r = F.array_distinct(F.coalesce(changed, none)), F.coalesce(retrieved, none)
    return F.when(F.size(c) > 0, F.size(F.array_intersect(c, r)) / F.size(c)).otherwise(F.lit(0.0))


def full_hit(changed: Column, value: Column) -> Column:
    return (F.size(F.coalesce(changed, F.array().cast("array<string>"))) > 0) & (value == 1.0)


def plausible(changed: Column, retrieved: Column) -> Column:
    """A changed file is among the retrieved ones."""
    return F.coalesce(F.arrays_overlap(changed, retrieved), F.lit(False))


def distinct_files(ranked: DataFrame) -> DataFrame:
    """``(query_id, files)``: each query's distinct paths in the order of rank."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("r"))
    return lists.select("query_id", F.array_distinct(F.transform("r", lambda x: x["path"])).alias("files"))


def sweep(ranked: DataFrame, tasks: DataFrame, ks: list[int], mode: str) -> DataFrame:
    """Recall of each task at each k from one ranking at the largest k (smaller ones are its prefixes).

    ``ranked(query_id, rank, path)``, ``tasks(query_id, changed_files)``.
    """
    sizes = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    grid = tasks.crossJoin(F.broadcast(sizes))  # the ks are a handful of settings
    near = ranked.where(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("r"))
    rows = grid.join(near, "query_id", "left")
    upto = F.array_distinct(F.transform(F.filter("r", lambda x: x["rank"] <= F.col("k")), lambda x: x["path"]))
    found = F.coalesce(upto, F.array().cast("array<string>"))
    return rows.select("query_id", F.lit(mode).alias("mode"), "k", "changed_files", found.alias("retrieved_files")).withColumn(
        "recall_at_k", recall(F.col("changed_files"), F.col("retrieved_files"))
    ).withColumn("full_hit", full_hit(F.col("changed_files"), F.col("recall_at_k"))).withColumn("error", F.lit(None).cast("string"))


def failed_rows(tasks: DataFrame, modes: list[str], ks: list[int], error: str = "error") -> DataFrame:
    """A row of zeros per mode and k for ``tasks(query_id, changed_files, error)`` that couldn't be run."""
    grid = tasks.select("query_id", "changed_files", error, F.explode(F.array(*map(F.lit, modes))).alias("mode")).select(
        "*", F.explode(F.array(*map(F.lit, ks))).alias("k")
    )
    return grid.select(
        "query_id", "mode", "k", "changed_files", F.array().cast("array<string>").alias("retrieved_files"),
        F.lit(0.0).alias("recall_at_k"), F.lit(False).alias("full_hit"), F.col(error).alias("error"),
    )


def latest_results(results: DataFrame) -> DataFrame:
    """The last run of each (instance, mode, k)."""
    by = Window.partitionBy("instance_id", "retrieval_mode", "k").orderBy(F.desc("run_at"), F.desc("recall_at_k"), F.desc("error"))
    return results.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def summarize(results: DataFrame, mode: str = "mode") -> DataFrame:
    """Per mode and k: rows that ran, rows that failed, mean recall and share of full hits (0 if none ran)."""
    ok = is_blank(F.col("error"))
    mean = lambda x: F.coalesce(F.avg(F.when(ok, x)), F.lit(0.0))
    return results.groupBy(F.col(mode).alias("mode"), "k").agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("errors"),
        mean(F.col("recall_at_k")).alias("mean_recall"), mean(F.col("full_hit").cast("int")).alias("full_hit_rate"),
    )
