"""Optional: apply candidate patches in checkouts, run tests, score. Off unless called; it starts processes on executors."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.text import cap_bytes
from tarnfold.operators.logs import PARSERS, score_instances

RUN = "instance_id string, patch_applied boolean, log string, error string"


def apply_patch(folder: str, patch: str | None, timeout: float = 120.0) -> str | None:
    """Apply a patch as git would; null when done (or nothing to do), else what git says."""
    if not (patch or "").strip():
        return None
    done = subprocess.run(["git", "apply", "--verbose", "-"], cwd=folder, input=patch, capture_output=True, text=True, timeout=timeout)
    return None if done.returncode == 0 else f"git apply: {(done.stdout + done.stderr).strip()}"


def run_command(folder: str, command: list[str], timeout: float = 1800.0) -> tuple[str, str | None]:
    """``(output, error)``: failing tests are no error, a command that can't be started is."""
    if not command:
        return "", "run: empty command"
    try:
        done = subprocess.run(command, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, timeout=timeout, errors="replace")
    except (OSError, subprocess.TimeoutExpired) as e:
        return "", f"run {command}: {e}"
    return done.stdout, None


class Environment(Protocol):
    """Where a candidate is tried: applies patches (null, or what went wrong) and runs a command (output, error)."""

    def apply(self, folder: str, patch: str | None) -> str | None: ...

    def run(self, folder: str, command: list[str]) -> tuple[str, str | None]: ...


@dataclass(frozen=True)
class LocalEnvironment:
    """git and processes on the executor itself."""

    patch_timeout: float = 120.0
    run_timeout: float = 1800.0

    def apply(self, folder: str, patch: str | None) -> str | None:
        return apply_patch(folder, patch, self.patch_timeout)

    def run(self, folder: str, command: list[str]) -> tuple[str, str | None]:
        return run_command(folder, command, self.run_timeout)


def run_candidates(candidates: DataFrame, command: list[str], where: Environment | None = None) -> DataFrame:
    """``(instance_id, patch_applied, log, error)`` of ``candidates(instance_id, folder, model_patch, test_patch)``.

    Each folder is a clean checkout that serves one candidate.
    """

    where = where or LocalEnvironment()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in batch.itertuples(index=False):
                if problem := where.apply(c.folder, c.model_patch):
                    rows.append((c.instance_id, False, None, f"candidate patch did not apply: {problem}"))
                elif problem := where.apply(c.folder, c.test_patch):
                    rows.append((c.instance_id, True, None, f"test_patch did not apply (invalid instance/setup): {problem}"))
                else:
                    log, problem = where.run(c.folder, command)
                    rows.append((c.instance_id, True, log, f"running tests: {problem}" if problem else None))
            yield pd.DataFrame(rows, columns=["instance_id", "patch_applied", "log", "error"])

    return candidates.select("instance_id", "folder", "model_patch", "test_patch").mapInPandas(run, RUN)


def outcomes(instances: DataFrame, runs: DataFrame, parser: str = "pytest") -> DataFrame:
    """``(instance_id, resolved, fail_to_pass, pass_to_pass, patch_applied, log, error)``; a run that failed resolves nothing."""
    statuses = PARSERS[parser](runs.where("error is null"), "instance_id")
    scored = score_instances(instances, statuses)
    joined = runs.join(scored, "instance_id", "left")
    return joined.select(
        "instance_id", (F.col("error").isNull() & F.coalesce("resolved", F.lit(False))).alias("resolved"),
        "fail_to_pass", "pass_to_pass", "patch_applied", cap_bytes(F.col("log")).alias("log"), "error",
    )
