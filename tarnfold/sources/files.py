"""Dataset files, prediction files, reports, the embedding cache, templates, flags and environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.scalars import instance_problem, string_list

INSTANCE = (
    "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string, "
    "FAIL_TO_PASS string, PASS_TO_PASS string, environment_setup_commit string, version string"
)
CACHE = "key string, vec array<float>"
TEMPLATE = (
    "You repair bugs in the repository {{.Repo}}. Answer with one unified diff that git can apply and nothing else: "
    "file headers (--- a/path, +++ b/path), hunk headers and unchanged context lines around each change."
)


LINE_CAP = 16 << 20


def _file_system(spark: SparkSession, path: str):
    """``(file system, path)`` of any store that Spark reads, shared ones too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def first_non_space(spark: SparkSession, path: str) -> str:
    """The first character that isn't white space; it tells an array from lines."""
    store, where = _file_system(spark, path)
    handle = store.open(where)
    try:
        while (byte := handle.read()) >= 0:
            if not chr(byte).isspace():
                return chr(byte)
    finally:
        handle.close()
    raise ValueError(f"{path} is empty")


def load_instances(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The instances of a JSON array or of JSON lines, validated; a bad file, line or row is an error.

    A line holds at most ``LINE_CAP`` bytes. ``limit`` above 0 keeps the first so many of the file.
    """
    if first_non_space(spark, path) == "[":
        rows = spark.read.schema(INSTANCE).option("mode", "FAILFAST").option("multiLine", True).json(path)
    else:
        too_long = F.raise_error(F.lit(f"a line of more than {LINE_CAP} bytes")).cast("string")
        line = F.when(F.octet_length("value") > LINE_CAP, too_long).otherwise(F.col("value"))
        lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
        rows = lines.select(F.from_json(line, INSTANCE, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    rows = rows.limit(limit) if limit > 0 else rows
    lists = rows.select(
        "instance_id", "repo", "base_commit", "problem_statement", "patch", "test_patch",
        string_list(F.col("FAIL_TO_PASS")).alias("fail_to_pass"), string_list(F.col("PASS_TO_PASS")).alias("pass_to_pass"),
        F.coalesce("environment_setup_commit", F.lit("")).alias("environment_setup_commit"), F.coalesce("version", F.lit("")).alias("repo_version"),
    )
    problem = instance_problem(F.col("fail_to_pass"))
    message = F.concat(F.lit("instance "), F.coalesce("instance_id", F.lit("?")), F.lit(": "), problem)
    checked = F.when(problem.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("instance_id"))
    return lists.withColumn("instance_id", checked)


def write_predictions(predictions: DataFrame, path: str, order: str) -> None:
    """JSON lines of the three keys, one per attempted task, also for empty patches.

    The parts are written side by side; read by their names they are in the given order.
    """
    line = F.to_json(F.struct("instance_id", "model_name_or_path", F.coalesce("model_patch", F.lit("")).alias("model_patch")))
    predictions.orderBy(order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_report(path: str, aggregates: DataFrame, results: DataFrame, settings: Mapping[str, object]) -> None:
    """One JSON document; the results, one row per instance, mode and k of a sweep, are streamed into it."""
    head = {"generated_at": datetime.now(timezone.utc).isoformat(), **settings, "aggregates": [r.asDict() for r in aggregates.orderBy("mode", "k").toLocalIterator()]}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, indent=2, default=str).rstrip("}\n") + ',\n  "results": [')
        for n, row in enumerate(results.toJSON().toLocalIterator()):
            out.write(("," if n else "") + "\n    " + row)
        out.write("\n  ]\n}\n")


def format_summary(aggregates: DataFrame) -> str:
    """The fixed-width table of aggregates, with its head."""
    head = "%-10s %4s %4s %8s %12s %12s" % ("mode", "k", "n", "errors", "mean_recall", "full_hit")
    line = "%-10s %4d %4d %8d %12.3f %12.3f"
    return "\n".join([head, *(line % (r.mode, r.k, r.n, r.errors, r.mean_recall, r.full_hit_rate) for r in aggregates.orderBy("mode", "k").toLocalIterator())])


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The embedding cache; a missing one is empty, an unreadable one an error. A JSON file is read as a map."""
    store, where = _file_system(spark, path)
    if not store.exists(where):
        return spark.createDataFrame([], CACHE)
    if path.endswith(".json") and not store.getFileStatus(where).isDirectory():
        text = spark.read.option("wholetext", True).text(path)
        parsed = F.from_json("value", "map<string,array<float>>", {"mode": "FAILFAST"})
        return text.select(F.explode(parsed).alias("key", "vec"))
    return spark.read.schema(CACHE).parquet(path)


def save_cache(fresh: DataFrame, path: str) -> None:
    """Append new entries."""
    fresh.select("key", "vec").write.mode("append").parquet(path)


def load_template(name: str = "diff", folder: str | None = None) -> str:
    """A template of the folder, or the built-in one."""
    own = Path(folder or "", f"{name}.tmpl")
    return own.read_text(encoding="utf-8") if folder and own.is_file() else TEMPLATE


def split_csv(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def parse_ints(value: str) -> list[int]:
    """Comma-separated integers; none at all is an error."""
    out = [int(x) for x in split_csv(value)]
    if not out:
        raise ValueError("no integers given")
    return out


def env_int(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    """A positive integer of the environment, else the default."""
    try:
        value = int(env.get(name, ""))
    except ValueError:
        return default
    return value if value > 0 else default


def needs_embedder(modes: list[str]) -> bool:
    return any(m in ("semantic", "hybrid") for m in modes)
