"""Small scalar expressions: lists, validation, retries, stop reasons, file predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions.text import is_blank, unicode_trim

#: Directories that are never indexed.
SKIP_DIRS = (".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".idea", ".vscode")
SNIFF_BYTES = 8192
REPO = r"^[A-Za-z0-9_.][A-Za-z0-9_.-]*/[A-Za-z0-9_.-]+$"
COMMIT = r"^[0-9a-fA-F]{7,40}$"


def in_skipped_dir(path: Column) -> Column:
    """A directory of the path (not the file's own name) is on the skip list."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*SKIP_DIRS))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8 KiB."""
    return F.coalesce(F.contains(F.substring(content.cast("binary"), 1, SNIFF_BYTES), F.lit(b"\x00")), F.lit(False))


def string_list(text: Column) -> Column:
    """A JSON array, or a JSON string that holds one, as an array; blank and null are empty.

    Anything else is an error, as a wrong list would make an instance pass.
    """
    inner = F.when(F.trim(text).startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]).otherwise(text)
    blank = is_blank(inner) | (F.trim(inner) == "null")
    parsed = F.from_json(inner, "array<string>")
    bad = F.raise_error(F.concat(F.lit("not a list of strings: "), F.substring(text, 1, 80))).cast("array<string>")
    return F.when(blank, F.array().cast("array<string>")).when(parsed.isNotNull(), parsed).otherwise(bad)


def instance_problem(fail_to_pass: Column) -> Column:
    """The first rule that an instance breaks, or null."""
    rules = [("instance_id", "missing instance_id"), ("repo", "missing repo"), ("base_commit", "missing base_commit"), ("test_patch", "missing test_patch")]
    out = F.when(is_blank(F.col(rules[0][0])), rules[0][1])
    for name, message in rules[1:]:
        out = out.when(is_blank(F.col(name)), message)
    return out.when(F.size(fail_to_pass) == 0, "no FAIL_TO_PASS tests")


def valid_checkout(repo: Column, commit: Column) -> Column:
    """The pair may be fetched: plain owner/name without dots in a row or a leading dash, and a hex commit."""
    ok = repo.rlike(REPO) & ~F.contains(repo, F.lit("..")) & commit.rlike(COMMIT)
    return F.coalesce(ok, F.lit(False))


def backoff_delay(attempt: Column, base: float = 0.5, retry_after: Column | None = None, most: float = 30.0) -> Column:
    """Seconds to wait before the next attempt: doubling, at least what the server asked for, at most ``most``."""
    doubled = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt.cast("double")))
    asked = F.coalesce(retry_after.cast("double"), F.lit(0.0)) if retry_after is not None else F.lit(0.0)
    return F.least(F.lit(most), F.greatest(doubled, asked))


def retry_after_seconds(header: Column) -> Column:
    """A positive whole number of seconds; anything else, dates too, is 0."""
    n = F.coalesce(F.trim(header).try_cast("int"), F.lit(0))
    return F.when(n > 0, n).otherwise(0)


def normal_stop_reason(reason: Column) -> Column:
    """``length`` is another provider's name of ``max_tokens``; other reasons stay."""
    return F.when(reason == "length", F.lit("max_tokens")).otherwise(reason)


def hit_ceiling(reason: Column) -> Column:
    return F.coalesce(normal_stop_reason(reason) == "max_tokens", F.lit(False))


def sorted_unique_ks(ks: Column, default: int = 10) -> Column:
    """Positive ks, each once, ascending; the default alone if none is left."""
    kept = F.array_sort(F.array_distinct(F.filter(ks, lambda k: k > 0)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def table_line(mode: Column, k: Column, n: Column, errors: Column, recall: Column, full: Column) -> Column:
    """One fixed-width line of the aggregate table."""
    return F.format_string("%-10s %4d %4d %8d %12.3f %12.3f", mode, k, n, errors, recall, full)


def mock_reply(system: Column, user: Column, canned: dict[str, str]) -> Column:
    """The canned reply whose key is in the system prompt (lowest key first), else the user's message."""
    low = F.lower(F.coalesce(system, F.lit("")))
    out = None
    for key in sorted(canned):
        hit = F.contains(low, F.lit(key.lower()))
        out = F.when(hit, canned[key]) if out is None else out.when(hit, canned[key])
    return user if out is None else out.otherwise(user)


def trimmed(text: Column) -> Column:
    return unicode_trim(F.coalesce(text, F.lit("")))
