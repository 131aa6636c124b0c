"""Stored values that lack the end of what was produced.

Method. For each source, field and measure (code points, bytes, tokens) the
lengths of the distinct values form a discrete hazard: the share of the values of
at least length L that end exactly at L. Window functions give the hazard of the
lengths around it (``NEIGHBOURS`` on either side, exactly, as ends over values at
risk); a Poisson tail tests each length's ends against it, and Benjamini-Hochberg
over all tests (false-discovery rate ``FDR``) keeps the significant ones. Those are
ceilings: storage limits, token limits and the like.

A broken transfer has no length of its own, so its hazard is that of ending
within a line at all: per source, the distinct values that break off at no
significant length and no generation ceiling are tested against ``STRAY``, the rate
at which whole values look so, with the same false-discovery control.

A value is flagged if its ending is incomplete and one of these holds: its length
is significant (for a patch: or the length of the reply that it ends), the
provider names a generation ceiling, or its source's broken endings are significant.
How incomplete it must be depends on which: an ending of *weak* evidence (a hunk with
fewer lines than its header says, an unclosed fence that stops after a whole line)
counts at a significant length or a ceiling only; elsewhere it must break off within
a line or a sentence, or carry the mark of a tool that cut it. A complete ending is
never flagged, whatever its length, and a patch with a wrong count in a hunk header
isn't incomplete for that.

Defined results: null, empty and blank values are no cases; a null source is a
source of its own; repeated deliveries are each reported but tested once; empty
tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.session import cut

NEIGHBOURS = 60
FLOOR = 0.5
FDR = 0.01
STRAY = 0.001
TOKEN_UNIT = "tokens"
#: Benjamini-Hochberg thresholds lie on a grid of so many steps a power of ten.
STEPS = 16
#: What providers call a generation ceiling.
CEILINGS = ("max_tokens", "length", "max_output_tokens", "max_length", "token_limit", "model_length")

HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
DIFF_START = re.compile(r"^(?:diff --git |--- )", re.M)
#: Marks that tools leave where they cut.
CUT_MARK = re.compile(
    r"(?:(?:\.{3}|…)\s*)?[\[(<](?:\w+ )?(?:truncated|clipped|cut(?: off)?|omitted|snip(?:ped)?)(?: \w+)?[\])>]\s*$|(?:…|\.{3})\s*$", re.I
)
TERMINAL = re.compile(r"(?:[.!?。！？…;]|[)\]\"'”’»*`>}])$")
STATUS_LINE = re.compile(r"^\W*\w[\w -]*:\s+\d+ \w+(?:, \d+ \w+)*$")
CLOSERS = ("\n```", "\n</diff>", "\n~~~")

COMPLETE, WEAK, BROKEN, MARKED = 0, 1, 2, 3
FLAGS = "prediction_id bigint, field_name string, source string, ceiling boolean, ending int, characters int, bytes int, tokens int, reply_characters int, reply_bytes int, digest bigint"


def hunk_missing(diff: str) -> int:
    """Lines that the last hunk lacks, by its header (of the old or new side, the greater)."""
    lines = diff.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    at = next((i for i in range(len(lines) - 1, -1, -1) if HUNK.match(lines[i])), None)
    if at is None:
        return 0
    m = HUNK.match(lines[at])
    old, new = int(m.group(1) or 1), int(m.group(2) or 1)
    for line in lines[at + 1 :]:
        first = line[:1]
        old -= first in ("", " ", "-")
        new -= first in ("", " ", "+")
    return max(old, new)


def _prose_ending(text: str) -> int:
    """Of a text's last sentence. A closing mark or a line of counts ends it."""
    end = text.rstrip()
    if not end.strip("​﻿  \n\t\r"):
        return COMPLETE
    last = end.rsplit("\n", 1)[-1]
    if TERMINAL.search(end) or STATUS_LINE.match(last):
        return COMPLETE
    return BROKEN


def diff_part(reply: str) -> tuple[str, str | None]:
    """The diff of a reply and what follows its fence or tag; None if nothing closes it."""
    m = DIFF_START.search(reply)
    if not m:
        return "", reply
    body = reply[m.start() :]
    ends = [k for k in (body.find(c) for c in CLOSERS) if k >= 0]
    if not ends:
        return body, None
    k = min(ends)
    return body[: k + 1], body[k + 1 :]


def _last_line(text: str) -> str:
    """The last line that isn't blank."""
    return text.rstrip().rsplit("\n", 1)[-1]


def reply_ending(reply: str | None, parts: tuple[str, str | None] | None = None) -> int:
    """How incomplete a reply ends; ``parts`` is its ``diff_part``, if it is known."""
    if not reply or not reply.strip():
        return COMPLETE
    reply = reply.replace("\r\n", "\n")
    diff, rest = parts or diff_part(reply)
    if CUT_MARK.search(_last_line(reply)):
        # An ellipsis may also end a sentence; it is a mark only after a broken word or within a diff.
        if not re.search(r"[a-z]{3}(?:…|\.{3})\s*$", reply) or rest is None:
            return MARKED
    if rest is not None:
        tail = rest.strip()
        if diff and (tail in ("```", "</diff>", "~~~") or not tail):
            return COMPLETE
        if not diff and reply.count("```") % 2:
            return max(WEAK, _prose_ending(reply))
        return _prose_ending(rest)
    end = diff.rstrip(" \t")
    fenced = reply.count("```") % 2 == 1
    if end.endswith("\n"):
        return WEAK if fenced or hunk_missing(end) > 0 else COMPLETE
    return BROKEN


def patch_ending(patch: str | None, reply: str | None, reply_state: int) -> int:
    """How incomplete a patch ends, given the reply it was taken from."""
    if not patch or not patch.strip():
        return COMPLETE
    text = patch.replace("\r\n", "\n")
    tail = _last_line(text)
    if CUT_MARK.search(tail) and not re.search(r"^[ +-].*[.…]{1,3}['\"`)/*]*$", text.rsplit("\n", 1)[-1]):
        return MARKED
    if re.search(r"\[?(?:truncated|output clipped)[\])]$", tail):
        return MARKED
    if text.endswith("\n"):
        return WEAK if hunk_missing(text) > 0 else COMPLETE
    last = text.rsplit("\n", 1)[-1]
    source = (reply or "").replace("\r\n", "\n")
    at = source.find(text)
    if at >= 0:
        following = source[at + len(text) :]
        if following.strip(" \t"):
            # The reply goes on: with the end of the line (the patch only lost its line end) or within it.
            if not following.lstrip(" \t").startswith("\n"):
                return BROKEN
            diff, rest = diff_part(source)
            whole = diff.rstrip() == text.rstrip()
            return COMPLETE if whole else BROKEN
        return BROKEN if reply_state >= BROKEN or hunk_missing(text) > 0 else COMPLETE
    stem = re.sub(r"[ …]+$|\.{3}$", "", text)
    # Counts in hunk headers may have been mended, so the last hunk's body is looked for.
    body = stem[stem.rfind("\n@@ ") + 1 :]
    body = body[body.find("\n") + 1 :] if body.startswith("@@ ") else body
    if stem != text and body and body in source:
        return MARKED
    if hunk_missing(text) > 0:
        return BROKEN
    return BROKEN if re.search(r"\w$", last) and reply_state >= BROKEN else COMPLETE


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    size = lambda text: len(text.encode("utf-8", "surrogatepass"))
    names = [c.split()[0] for c in FLAGS.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            state = reply_ending(r.raw)
            for field, value, ending in (("raw", r.raw, state), ("model_patch", r.model_patch, patch_ending(r.model_patch, r.raw, state))):
                if ending > COMPLETE:
                    reply = r.raw if isinstance(r.raw, str) else ""
                    raw = value.encode("utf-8", "surrogatepass")
                    tokens = None if r.tokens is None or r.tokens != r.tokens else int(r.tokens)
                    rows.append((r.prediction_id, field, r.source, r.ceiling, ending, len(value), len(raw), tokens, len(reply), size(reply), len(value) << 32 | zlib.crc32(raw)))
        frame = pd.DataFrame(rows, columns=names)
        frame["tokens"] = frame["tokens"].astype("Int64")
        yield frame


def at_ceiling(stop_reason: Column) -> Column:
    """The provider says that generation stopped at its ceiling."""
    return F.coalesce(F.lower(F.trim(stop_reason)).isin(*CEILINGS), F.lit(False))


def lengths(predictions: DataFrame) -> DataFrame:
    """``(source, field_name, measure, length, value)`` of each non-empty value and measure."""
    parts = []
    for field in ("raw", "model_patch"):
        value = F.col(field)
        measures = [("characters", F.char_length(value)), ("bytes", F.octet_length(value))]
        if field == "raw":
            measures.append((TOKEN_UNIT, F.col("output_tokens").cast("int")))
        entries = F.array(*[F.struct(F.lit(m).alias("measure"), n.alias("length")) for m, n in measures])
        parts.append(
            predictions.where(value.isNotNull() & (value != "")).select(
                F.col("model_name_or_path").alias("source"), F.lit(field).alias("field_name"),
                F.xxhash64(value).alias("value"), F.explode(entries).alias("m"),
            )
        )
    both = parts[0].unionByName(parts[1])
    return both.select("source", "field_name", "m.measure", "m.length", "value").where(F.col("length") > 0)


def length_hazards(predictions: DataFrame) -> DataFrame:
    """Each length's count, values at risk, hazard, ends that its neighbours' hazard lets expect, and p-value."""
    counts = lengths(predictions).groupBy("source", "field_name", "measure", "length").agg(F.count_distinct("value").alias("n"))
    key = ["source", "field_name", "measure"]
    rising = Window.partitionBy(*key).orderBy("length")
    below, above = rising.rangeBetween(-NEIGHBOURS, -1), rising.rangeBetween(1, NEIGHBOURS)
    risk = rising.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    over = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    n, at_risk, length = F.col("n"), F.col("at_risk"), F.col("length")
    h = counts.withColumns({
        "at_risk": F.sum("n").over(risk), "n_below": over("n", below), "n_above": over("n", above),
        "l_below": over(n * length, below), "l_above": over(n * length, above),
        "overall": F.sum("n").over(whole) / F.sum(n * length).over(whole),
    })
    # Values at risk summed over the neighbouring lengths, those without any end included.
    low = F.least(F.lit(NEIGHBOURS), length - 1)
    risk_below = low * at_risk + F.col("l_below") - F.col("n_below") * (length - low - 1)
    risk_above = F.col("l_above") - F.col("n_above") * length + NEIGHBOURS * (at_risk - n - F.col("n_above"))
    near = (F.col("n_below") + F.col("n_above")) / F.greatest(F.lit(1), risk_below + risk_above)
    expected = at_risk * F.greatest(near, FLOOR * F.col("overall"))
    # Only lengths at which some value ends are tested, so the tail is that given at least one end.
    p_value = F.least(F.lit(1.0), _tail(n, F.col("expected")) / -F.expm1(-F.col("expected")))
    return h.withColumns({"hazard": n / at_risk, "expected": expected}).select(*key, "length", "n", "at_risk", "hazard", "expected", p_value.alias("p_value"))


def _tail(n: Column, mean: Column) -> Column:
    """Poisson tail P(X >= n) by its leading terms; from n > mean on they fall geometrically."""
    log_first = n * F.log(mean) - mean - _log_factorial(n)
    tail = F.exp(log_first) / F.greatest(F.lit(1e-9), 1 - mean / (n + 1))
    return F.when(n > mean, F.least(F.lit(1.0), tail)).otherwise(1.0)


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series (relative error below 1e-4 for n >= 1)."""
    x = n.cast("double") + 1
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x)


def discoveries(tests: DataFrame, fdr: float) -> DataFrame:
    """The tests that pass Benjamini-Hochberg; the threshold is the greatest of a fixed grid that holds.

    Only counts by step of the grid meet in one place, at most 300 powers of ten.
    """
    step = F.floor(-STEPS * F.log10(F.greatest("p_value", F.lit(1e-300))))
    edge = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    per_step = tests.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    running = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = per_step.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(Window.partitionBy())})
    limit = cumulated.where(edge <= fdr * F.col("upto") / F.col("total")).agg(F.max(edge).alias("threshold"))
    return tests.crossJoin(F.broadcast(limit)).where(F.col("p_value") <= F.col("threshold")).drop("threshold")


def significant_lengths(predictions: DataFrame, fdr: float = FDR) -> DataFrame:
    """The lengths at which far more values end than around it, after false-discovery control."""
    return discoveries(cut(length_hazards(predictions)), fdr)


def _incomplete(predictions: DataFrame) -> DataFrame:
    """Flags and lengths of the values with an incomplete ending; texts end here."""
    ceiling = at_ceiling(F.col("stop_reason")).alias("ceiling")
    tokens = F.col("output_tokens").cast("int").alias("tokens")
    return predictions.select("prediction_id", F.col("model_name_or_path").alias("source"), ceiling, tokens, "raw", "model_patch").mapInPandas(_endings, FLAGS)


def _with_limits(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The flags with ``at_limit``: the value's length, or its reply's, is significant for the source."""
    marks = marks.select(F.col("source").alias("s"), F.col("field_name").alias("f"), "measure", F.col("length").alias("l"))
    reply = F.col("f") == "raw"
    length = (
        F.when(F.col("measure") == TOKEN_UNIT, F.col("tokens"))
        .when(reply, F.when(F.col("measure") == "bytes", F.col("reply_bytes")).otherwise(F.col("reply_characters")))
        .otherwise(F.when(F.col("measure") == "bytes", F.col("bytes")).otherwise(F.col("characters")))
    )
    # A patch's end is its reply's end, or one of its own; a reply has one end only.
    fits = F.col("source").eqNullSafe(F.col("s")) & (reply | (F.col("field_name") == "model_patch")) & (F.col("l") == length)
    # At most a few lengths per source and field are significant; the join is on the source.
    return rows.join(marks, fits, "left").groupBy("prediction_id", "field_name").agg(
        F.first("source").alias("source"), F.max("ending").alias("ending"), F.max("ceiling").alias("ceiling"),
        F.max(F.col("l").isNotNull()).alias("at_limit"), F.max("digest").alias("digest"),
    )


def break_hazards(flagged: DataFrame, tests: DataFrame) -> DataFrame:
    """Per source: distinct values that break off at no limit, distinct values, and the p-value against ``STRAY``."""
    values = tests.where("measure = 'characters'").groupBy("source").agg(F.sum("n").alias("at_risk"))
    broken = flagged.where((F.col("ending") >= BROKEN) & ~F.col("ceiling") & ~F.col("at_limit"))
    broken = broken.groupBy("source").agg(F.count_distinct("field_name", "digest").alias("n"))
    both = values.join(broken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    n, expected = F.coalesce("n", F.lit(0)), STRAY * F.col("at_risk")
    return both.select("source", n.alias("n"), "at_risk", (n / F.col("at_risk")).alias("hazard"), expected.alias("expected"), _tail(n, expected).alias("p_value"))


def truncated(predictions: DataFrame, fdr: float = FDR) -> DataFrame:
    """``(prediction_id, field_name, source, reason)`` of each truncated value."""
    tests = cut(length_hazards(predictions))
    flagged = cut(_with_limits(_incomplete(predictions), discoveries(tests, fdr)))
    breaking = discoveries(break_hazards(flagged, tests), fdr).select(F.col("source").alias("s"), F.lit(True).alias("breaks"))
    reason = (
        F.when(F.col("ceiling"), "ceiling").when(F.col("at_limit"), "limit").when((F.col("ending") >= BROKEN) & F.col("breaks"), "transfer")
    )
    joined = flagged.join(breaking, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("prediction_id", "field_name", "source", "reason")


def hazards(predictions: DataFrame, fdr: float = FDR) -> DataFrame:
    """The significant hazards of both kinds: lengths, and sources whose values break off (``measure`` = break)."""
    tests = cut(length_hazards(predictions))
    limits = discoveries(tests, fdr)
    breaks = discoveries(break_hazards(_with_limits(_incomplete(predictions), limits), tests), fdr)
    null = lambda kind: F.lit(None).cast(kind)
    return limits.unionByName(breaks.select("source", null("string").alias("field_name"), F.lit("break").alias("measure"), null("int").alias("length"), "n", "at_risk", "hazard", "expected", "p_value"))


def shares(predictions: DataFrame, flags: DataFrame) -> DataFrame:
    """Per source and field: values, truncated ones, their share, by reason."""
    values = predictions.select(
        "prediction_id", F.col("model_name_or_path").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), (F.coalesce(F.col(f), F.lit("")) != "").alias("has")) for f in ("raw", "model_patch")])).alias("x"),
    ).where("x.has").select("prediction_id", "source", "x.field_name")
    joined = values.join(flags.select("prediction_id", "field_name", "reason"), ["prediction_id", "field_name"], "left")
    return joined.groupBy("source", "field_name").agg(
        F.count("*").alias("n_values"),
        F.count("reason").alias("n_truncated"),
        F.round(F.count("reason") / F.count("*"), 6).alias("share"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("ceiling", "limit", "transfer")],
    )


def found(predictions: DataFrame) -> DataFrame:
    """``(prediction_id, field_name)`` of each truncated value."""
    return truncated(predictions).select("prediction_id", "field_name").distinct()
