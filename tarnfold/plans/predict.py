"""Prediction: prompts, replies, diffs, plausibility; a miss is a row with an empty patch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.diffs import changed_files, cleaned_diff, extract_diff
from tarnfold.functions.scalars import hit_ceiling, mock_reply
from tarnfold.operators.prompts import MAX_CHUNKS, MAX_CODE_POINTS, system_prompts, user_messages
from tarnfold.operators.recall import distinct_files, plausible
from tarnfold.sources.files import load_template

Provider = Callable[[DataFrame], DataFrame]


def prompts(tasks: DataFrame, context: DataFrame, template: str | None = None, max_chunks: int = MAX_CHUNKS, max_code_points: int = MAX_CODE_POINTS) -> DataFrame:
    """``(query_id, system, message)`` of ``tasks(query_id, repo, text)``; the gold patch isn't among a task's columns."""
    system = tasks.select("query_id", system_prompts(F.col("repo"), template or load_template()).alias("system"))
    return user_messages(tasks, context, max_chunks, max_code_points).join(system, "query_id")


def mock_provider(canned: dict[str, str]) -> Provider:
    """Replies without a model, as an expression."""
    none = F.lit(None)
    return lambda p: p.select(
        "query_id", mock_reply(F.col("system"), F.col("message"), canned).alias("raw"), F.lit("end_turn").alias("stop_reason"),
        none.cast("bigint").alias("input_tokens"), none.cast("bigint").alias("output_tokens"), none.cast("string").alias("err"),
    )


def predictions(tasks: DataFrame, context: DataFrame, provider: Provider, model: str, template: str | None = None) -> DataFrame:
    """One row per task: patch, changed and retrieved files, plausibility, reply, error."""
    replies = provider(prompts(tasks, context, template))
    cleaned = replies.withColumn("cleaned", cleaned_diff(F.col("raw")))
    read = cleaned.withColumn("x", extract_diff(F.col("cleaned")))
    note = F.when(hit_ceiling(F.col("stop_reason")), F.lit(" (output hit the MaxTokens ceiling)")).otherwise(F.lit(""))
    problem = F.coalesce("err", F.when(F.col("x.problem").isNotNull(), F.concat(F.col("x.problem"), note)))
    files = distinct_files(context)
    none = F.array().cast("array<string>")
    rows = tasks.select("query_id").join(read, "query_id", "left").join(files, "query_id", "left")
    out = rows.select(
        F.col("query_id").alias("instance_id"), F.lit(model).alias("model_name_or_path"), F.coalesce(F.when(F.col("err").isNull(), F.col("x.diff")), F.lit("")).alias("model_patch"),
        F.coalesce("files", none).alias("retrieved_files"), "raw", problem.alias("err"),
    )
    return out.withColumn("changed_files", changed_files(F.col("model_patch"))).withColumn("plausible_hit", plausible(F.col("changed_files"), F.col("retrieved_files")))


def counters(rows: DataFrame) -> DataFrame:
    """Valid, plausible and failed predictions of a run."""
    return rows.agg(F.count_if(F.col("model_patch") != "").alias("valid"), F.count_if("plausible_hit").alias("plausible"), F.count_if(F.col("err").isNotNull()).alias("errored"))
