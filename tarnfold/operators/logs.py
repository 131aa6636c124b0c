"""Test logs to statuses, and the score of an instance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.text import fields, unicode_trim

STATUSES = ("PASSED", "FAILED", "ERROR", "SKIPPED", "MISSING")


def _lines(logs: DataFrame, key: str, log: str) -> DataFrame:
    return logs.where(F.col(log).isNotNull()).select(key, F.posexplode(F.split(log, "\n")).alias("pos", "line"))


def parse_pytest(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """``(key, test, status)``: a line with a status word and a node; the first line of a node counts."""
    parts = _lines(logs, key, log).select(key, "pos", fields(F.col("line")).alias("f"))
    status = F.filter(F.transform("f", lambda x: F.rtrim(x, F.lit(":"))), lambda x: x.isin(*STATUSES[:4]))
    node = F.filter("f", lambda x: F.contains(x, F.lit("::")) | x.endswith(".py"))
    rows = parts.where((F.size(status) > 0) & (F.size(node) > 0)).select(key, "pos", node[0].alias("test"), status[0].alias("status"))
    return rows.groupBy(key, "test").agg(F.min_by("status", "pos").alias("status"))


def parse_gotest(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """``(key, test, status)`` of the result lines of Go's test tool; the last line of a test counts."""
    words = F.create_map(*[F.lit(x) for pair in (("PASS", "PASSED"), ("FAIL", "FAILED"), ("SKIP", "SKIPPED")) for x in pair])
    rows = _lines(logs, key, log).withColumn("line", unicode_trim(F.col("line"))).where(F.col("line").rlike("^--- (?:PASS|FAIL|SKIP):"))
    name = F.try_element_at(fields(F.regexp_replace("line", r"^[^:]*:", "")), F.lit(1))
    parsed = rows.select(key, "pos", name.alias("test"), words[F.regexp_extract("line", r"^--- (\w+):", 1)].alias("status"))
    return parsed.where(F.col("test").isNotNull()).groupBy(key, "test").agg(F.max_by("status", "pos").alias("status"))


PARSERS: dict[str, Callable[..., DataFrame]] = {"pytest": parse_pytest, "gotest": parse_gotest}


def score_instances(instances: DataFrame, statuses: DataFrame) -> DataFrame:
    """``(instance_id, resolved, fail_to_pass, pass_to_pass)`` with the observed status of each required test.

    ``instances(instance_id, fail_to_pass array, pass_to_pass array)``;
    ``statuses(instance_id, test, status)``. A test that wasn't seen is MISSING.
    """
    required = instances.select("instance_id", F.explode(F.array(
        F.struct(F.lit("f").alias("kind"), F.col("fail_to_pass").alias("tests")),
        F.struct(F.lit("p").alias("kind"), F.col("pass_to_pass").alias("tests")),
    )).alias("x")).select("instance_id", "x.kind", F.explode(F.array_distinct("x.tests")).alias("test"))
    seen = required.join(statuses, ["instance_id", "test"], "left").withColumn("status", F.coalesce("status", F.lit("MISSING")))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("test", "status")))))
    scored = seen.groupBy("instance_id").agg(of("f").alias("f"), of("p").alias("p"), F.every(F.col("status") == "PASSED").alias("all_passed"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return instances.select("instance_id", F.size("fail_to_pass").alias("n_f")).join(scored, "instance_id", "left").select(
        "instance_id",
        ((F.col("n_f") > 0) & F.coalesce("all_passed", F.lit(False))).alias("resolved"),
        F.coalesce("f", none).alias("fail_to_pass"),
        F.coalesce("p", none).alias("pass_to_pass"),
    )
