"""Scans of checked-out trees and of git repositories as a Spark data source.

``spark.read.format("repo_tree")`` gives ``(corpus_id, path, content)``, one
partition per tree. Spark's own file readers can't be used: they hide names that
begin with ``_`` or ``.`` and follow symbolic links.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnfold.functions.scalars import COMMIT, REPO, SKIP_DIRS, SNIFF_BYTES
from tarnfold.operators.config import DEFAULT_MAX_FILE_BYTES

BASE_URL = "https://github.com/"
GIT_TIMEOUT = 300.0


def walk_files(root: str, max_bytes: int = DEFAULT_MAX_FILE_BYTES) -> Iterator[tuple[str, str]]:
    """``(path, content)`` of the text files below a root, in walk order.

    Left out: directories of the skip list (not the root itself), symbolic links,
    files above the limit, binary files and what can't be read.
    """

    def visit(folder: str, prefix: str) -> Iterator[tuple[str, str]]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            try:
                if entry.is_symlink():
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in SKIP_DIRS:
                        yield from visit(entry.path, f"{prefix}{entry.name}/")
                    continue
                if not entry.is_file(follow_symlinks=False) or entry.stat(follow_symlinks=False).st_size > max_bytes:
                    continue
                with open(entry.path, "rb") as handle:
                    data = handle.read()
            except OSError:
                continue
            if b"\0" not in data[:SNIFF_BYTES]:
                yield prefix + entry.name, data.decode("utf-8", "replace")

    yield from visit(root, "")


def check_checkout(repo: str, commit: str) -> None:
    """Refuse what could be an option, a path or no commit, before any process is started."""
    if not re.match(REPO, repo) or ".." in repo:
        raise ValueError(f"invalid repo {repo!r}")
    if not re.match(COMMIT, commit):
        raise ValueError(f"invalid base commit {commit!r}")


def run_git(folder: str, arguments: list[str], timeout: float = GIT_TIMEOUT) -> None:
    """One git command without prompts, user or system configuration, or credential helpers."""
    env = {"PATH": os.environ.get("PATH", ""), "HOME": folder, "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_ASKPASS": "true"}
    done = subprocess.run(["git", "-c", "credential.helper=", *arguments], cwd=folder, env=env, timeout=timeout, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.strip()[:300]}")


@contextmanager
def checkout(repo: str, commit: str, base_url: str = BASE_URL, work_dir: str | None = None, timeout: float = GIT_TIMEOUT) -> Iterator[str]:
    """A shallow checkout of one commit in a folder of its own, removed afterwards."""
    check_checkout(repo, commit)
    folder = tempfile.mkdtemp(prefix="tree-", dir=work_dir)
    try:
        for step in (["init", "--quiet"], ["remote", "add", "origin", f"{base_url}{repo}.git"], ["fetch", "--quiet", "--depth", "1", "origin", commit], ["checkout", "--quiet", "--detach", "FETCH_HEAD"]):
            run_git(folder, step, timeout)
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


class _Tree(InputPartition):
    def __init__(self, corpus_id: str, root: str | None, repo: str | None = None, commit: str | None = None):
        super().__init__(corpus_id)
        self.corpus_id, self.root, self.repo, self.commit = corpus_id, root, repo, commit


class _Reader(DataSourceReader):
    def __init__(self, given: dict[str, str]):
        options = {k.lower(): v for k, v in given.items()}
        self.max_bytes = int(options.get("maxfilebytes", DEFAULT_MAX_FILE_BYTES))
        self.base_url = options.get("baseurl", BASE_URL)
        self.timeout = float(options.get("timeoutseconds", GIT_TIMEOUT))
        if "checkouts" in options:
            self.trees = [_Tree(f"{r}@{c}", None, r, c) for r, c in json.loads(options["checkouts"])]
        else:
            roots = json.loads(options["roots"]) if "roots" in options else {options.get("corpusid", "local"): options["path"]}
            self.trees = [_Tree(k, v) for k, v in sorted(roots.items())]

    def partitions(self) -> list[InputPartition]:
        return self.trees

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tree = partition
        if tree.root is not None:
            for path, content in walk_files(tree.root, self.max_bytes):
                yield tree.corpus_id, path, content, None
            return
        try:
            with checkout(tree.repo, tree.commit, self.base_url, timeout=self.timeout) as root:
                for path, content in walk_files(root, self.max_bytes):
                    yield tree.corpus_id, path, content, None
        except (ValueError, RuntimeError, subprocess.TimeoutExpired) as problem:
            yield tree.corpus_id, None, None, str(problem)  # a failed checkout is a row, the others go on


class RepoTree(DataSource):
    """Options: ``path`` (with ``corpusId``), ``roots`` (JSON object) or ``checkouts`` (JSON pairs); ``maxFileBytes``, ``baseUrl``."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "corpus_id string, path string, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoTree)
