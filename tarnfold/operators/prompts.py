"""Prompts from a report and its context chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.text import cap_excerpt, unicode_trim

RULE = "-" * 40
MAX_CHUNKS = 20
MAX_CODE_POINTS = 4000
#: The fixed sentences of the user's message.
OPENING = "Bug report:\n\n"
NO_EXCERPTS = "No repository excerpts were retrieved. Infer the fix from the report.\n"
EXCERPTS = "Relevant code from the repository (most relevant first):\n"
CLOSING = "\nNow output the unified diff that fixes the bug.\n"


def excerpt(path: Column, start: Column, end: Column, content: Column, most: int = MAX_CODE_POINTS) -> Column:
    head = F.format_string(f"\n{RULE}\nFile: %s  (lines %d-%d)\n{RULE}\n", path, start, end)
    return F.concat(head, cap_excerpt(content, most), F.lit("\n"))


def user_messages(
    reports: DataFrame, context: DataFrame, max_chunks: int = MAX_CHUNKS, max_code_points: int = MAX_CODE_POINTS
) -> DataFrame:
    """``(query_id, message)`` of ``reports(query_id, text)`` with ``context(query_id, rank, path, start_line, end_line, content)``."""
    parts = context.where(F.col("rank") <= max_chunks).select(
        "query_id", "rank", excerpt(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content"), max_code_points).alias("part")
    )
    joined = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    body = F.concat(F.lit(EXCERPTS), F.array_join(F.transform("parts", lambda x: x["part"]), ""), F.lit(CLOSING))
    head = F.concat(F.lit(OPENING), unicode_trim(F.coalesce("text", F.lit(""))), F.lit("\n\n"))
    return reports.join(joined, "query_id", "left").select(
        "query_id", F.concat(head, F.when(F.col("parts").isNull(), F.lit(NO_EXCERPTS)).otherwise(body)).alias("message")
    )


def system_prompts(repos: Column, template: str) -> Column:
    """The template with its one variable, the repository."""
    return F.replace(F.lit(template), F.lit("{{.Repo}}"), repos)
