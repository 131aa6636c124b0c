"""Unified diffs as Column expressions: extraction from replies, repair, validation.

Each step folds over a row's own lines, so nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions.text import is_blank, unicode_trim

#: The beginnings of lines in a diff's file header.
HEADERS = (
    "diff --git ", "index ", "--- ", "+++ ", "new file mode", "deleted file mode", "old mode ", "new mode ",
    "rename from ", "rename to ", "copy from ", "copy to ", "similarity index ", "dissimilarity index ",
    "Binary files ", "GIT binary patch",
)
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)$"
_HEADER = "^(?:" + "|".join(h.replace("+", r"\+") for h in HEADERS) + ")"

NO_DIFF = "no diff found in model output"
NO_HEADER = "output is not a unified diff (missing file headers)"
NO_HUNK = "output is not a unified diff (no @@ hunk header)"


def is_header(line: Column) -> Column:
    return line.rlike(_HEADER)


def is_body(line: Column) -> Column:
    return (line == "") | line.rlike(r"^[ +\-\\]")


def changed_files(diff: Column) -> Column:
    """Files of the post-image, sorted and distinct; deletions are left out."""
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("+++ "))
    raw = F.transform(lines, lambda x: F.split(unicode_trim(F.substring(x, 5, 1 << 30)), "\t")[0])
    kept = F.filter(raw, lambda x: (x != "") & (x != "/dev/null"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.regexp_replace(x, "^b/", ""))))


def looks_like_diff(text: Column) -> Column:
    return F.contains(text, F.lit("diff --git ")) | F.contains(text, F.lit("--- ")) | F.contains(text, F.lit("@@"))


def fenced_block(text: Column) -> Column:
    """The first fence's body if it looks like a diff (an open fence reaches the end), else null."""
    at = F.locate("```", text)
    rest = F.substring(text, at + 3, F.lit(1 << 30))
    body = F.when(F.contains(rest, F.lit("\n")), F.regexp_replace(rest, r"^[^\n]*\n", ""))
    inner = F.substring_index(body, "```", 1)
    return F.when((at > 0) & body.isNotNull() & looks_like_diff(inner), inner)


def from_diff_start(text: Column) -> Column:
    """From the first file header on; the text itself without one."""
    tail = F.regexp_extract(text, r"(?ms)^(?:diff --git |--- ).*", 0)
    return F.when(tail != "", tail).otherwise(text)


def scan_diff(text: Column) -> Column:
    """The leading well-formed diff, up to the first line that can't belong to it."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hunk"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        at, head = line.startswith("@@"), is_header(line)
        body = s["hunk"] & is_body(line)
        keep = ~s["done"] & (at | head | body)
        kept = F.when(body & ~at & ~head & (line == ""), F.lit(" ")).otherwise(line)
        return F.struct(
            F.when(keep, F.array_append(s["out"], kept)).otherwise(s["out"]).alias("out"),
            F.when(at, F.lit(True)).when(head, F.lit(False)).otherwise(s["hunk"]).alias("hunk"),
            (~keep).alias("done"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(s["out"], "\n"))


def drop_trailing_blank_lines(text: Column) -> Column:
    lines = F.split(text, "\n")
    last = F.array_max(F.transform(lines, lambda x, i: F.when(~is_blank(x), i + 1).otherwise(0)))
    return F.array_join(F.slice(lines, 1, last), "\n")


def recount_hunks(text: Column) -> Column:
    """Each hunk header's counts made those of its body; starts and section text stay."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), none.alias("head"), empty.alias("body"), F.lit(0).alias("old"), F.lit(0).alias("new"))

    def flushed(s: Column) -> Column:
        counted = F.concat(
            F.lit("@@ -"), F.regexp_extract(s["head"], HUNK, 1), F.lit(","), s["old"].cast("string"), F.lit(" +"),
            F.regexp_extract(s["head"], HUNK, 2), F.lit(","), s["new"].cast("string"), F.lit(" @@"), F.regexp_extract(s["head"], HUNK, 3),
        )
        return F.when(s["head"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(counted), s["body"]))

    def step(s: Column, line: Column) -> Column:
        counted_head, breaks = line.rlike(HUNK), line.startswith("@@") | is_header(line)
        inside = s["head"].isNotNull() & ~breaks
        both = (line == "") | line.startswith(" ")
        return F.struct(
            F.when(inside, s["out"]).when(counted_head, flushed(s)).otherwise(F.array_append(flushed(s), line)).alias("out"),
            F.when(inside, s["head"]).when(counted_head, line).otherwise(none).alias("head"),
            F.when(inside, F.array_append(s["body"], line)).otherwise(empty).alias("body"),
            F.when(inside, s["old"] + (both | line.startswith("-")).cast("int")).otherwise(0).alias("old"),
            F.when(inside, s["new"] + (both | line.startswith("+")).cast("int")).otherwise(0).alias("new"),
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.array_join(flushed(s), "\n"))


def diff_problem(diff: Column) -> Column:
    """Why a text isn't a diff with hunks, or null."""
    git = F.contains(diff, F.lit("diff --git "))
    minus = diff.startswith("--- ") | F.contains(diff, F.lit("\n--- "))
    plus = diff.startswith("+++ ") | F.contains(diff, F.lit("\n+++ "))
    return F.when(~(git | (minus & plus)), F.lit(NO_HEADER)).when(~F.contains(diff, F.lit("@@")), F.lit(NO_HUNK))


def cleaned_diff(raw: Column) -> Column:
    """A reply's diff before counting: unfenced, cut to its diff, without blank lines at its end."""
    text = F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return drop_trailing_blank_lines(scan_diff(from_diff_start(F.coalesce(fenced_block(text), text))))


def extract_diff(cleaned: Column) -> Column:
    """``struct(diff, problem)`` of a cleaned diff: counts repaired and validated; one of the two is null."""
    counted = recount_hunks(cleaned)
    problem = F.when(is_blank(cleaned), F.lit(NO_DIFF)).otherwise(diff_problem(counted))
    return F.struct(F.when(problem.isNull(), F.concat(counted, F.lit("\n"))).alias("diff"), problem.alias("problem"))
