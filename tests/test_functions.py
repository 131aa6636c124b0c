import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.functions import diffs, scalars, text, vectors
from tarnfold.sources.endpoints import delay, retry_after_seconds


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word,parts", [("FizzBuzz", ["Fizz", "Buzz"]), ("HTTPServer", ["HTTP", "Server"]), ("parse", ["parse"]), ("foo2bar", ["foo", "2", "bar"]), ("x", ["x"])])
def test_split_identifier(spark, word, parts):
    assert one(spark, word, text.split_identifier) == parts


def model_terms(value):
    out = []
    for w in re.findall(r"[^\W_]+", value):
        parts, start = [], 0
        for i in range(1, len(w)):
            p, c = w[i - 1], w[i]
            if (p.islower() and c.isupper()) or (p.isupper() and c.isupper() and i + 1 < len(w) and w[i + 1].islower()) or p.isdigit() != c.isdigit():
                parts.append(w[start:i])
                start = i
        parts.append(w[start:])
        out += ([w.lower()] if len(parts) > 1 else []) + [p.lower() for p in parts]
    return out


def test_terms_hold_the_whole_and_its_parts(spark):
    got = one(spark, "func FizzBuzz() and parse_error", text.terms)
    assert {"fizzbuzz", "fizz", "buzz", "parse", "error", "func"} <= set(got)
    assert one(spark, None, text.terms) == []


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abXYZ09_ .-(", max_size=30), min_size=40, max_size=60))
def test_terms_equal_a_plain_model(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = {r.i: r.t for r in rows.select("i", text.terms(F.col("x")).alias("t")).collect()}
    assert all(got[i] == model_terms(v) for i, v in enumerate(values))
    counted = rows.select("i", text.marked(F.col("x")).alias("m")).select("i", text.term_count(F.col("m")).alias("n"))
    assert {r.i: r.n for r in counted.collect()} == {i: len(model_terms(v)) for i, v in enumerate(values)}


def test_terms_of_words_with_many_parts_are_counted(spark):
    """A word of 40,000 parts, as encoded data has them, is no deeper recursion than any other."""
    rows = spark.createDataFrame([(1, "a1" * 20_000 + " plain fooBar"), (2, "x1y")], "i int, x string").repartition(2)
    got = rows.select("i", text.term_count(text.marked(F.col("x"))).alias("n")).collect()
    assert {r.i: r.n for r in got} == {1: 40_001 + 1 + 3, 2: 4}


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c"


@pytest.mark.parametrize("raw", [DIFF, "```diff\n" + DIFF + "\n```", "```\n" + DIFF + "\n```", "Here it is:\n\n" + DIFF, "Sure.\n```diff\n" + DIFF + "\n```\nDone."])
def test_extract_diff_accepts(spark, raw):
    x = one(spark, raw, lambda c: diffs.extract_diff(diffs.cleaned_diff(c)))
    assert x.problem is None and x.diff == DIFF + "\n"


@pytest.mark.parametrize("raw,problem", [("", diffs.NO_DIFF), (None, diffs.NO_DIFF), ("no idea", diffs.NO_DIFF), ("--- a/x\n+++ b/x\n", diffs.NO_HUNK)])
def test_extract_diff_refuses(spark, raw, problem):
    x = one(spark, raw, lambda c: diffs.extract_diff(diffs.cleaned_diff(c)))
    assert x.diff is None and x.problem == problem


def test_only_the_first_diff_is_kept_and_blank_lines_are_repaired(spark):
    raw = DIFF + "\n</diff>\nWait, again:\n<diff>\n" + DIFF
    assert one(spark, raw, lambda c: diffs.extract_diff(diffs.cleaned_diff(c))).diff == DIFF + "\n"
    assert one(spark, "--- a\n+++ b\n@@ -1 +1 @@\n a\n\n b", diffs.scan_diff) == "--- a\n+++ b\n@@ -1 +1 @@\n a\n \n b"


def test_recount_hunks_and_twice_is_once(spark):
    bad = "--- a/f\n+++ b/f\n@@ -5,1 +5,1 @@ def f():\n a\n-b\n+c\n d\n@@ -9 +9 @@\n-x"
    good = one(spark, bad, diffs.recount_hunks)
    assert "@@ -5,3 +5,3 @@ def f():" in good and "@@ -9,1 +9,0 @@" in good
    assert one(spark, good, diffs.recount_hunks) == good


def test_changed_files(spark):
    d = "+++ b/src/foo.py\n+++ b/pkg/new.py\t2024-01-01\n+++ /dev/null\n+++ b/src/foo.py\n++ no"
    assert one(spark, d, diffs.changed_files) == ["pkg/new.py", "src/foo.py"]
    assert one(spark, None, diffs.changed_files) == []


def test_cosine_and_normalize(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [0.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0), ([], [], 0.0)]
    rows = spark.createDataFrame(pairs, "a array<float>, b array<float>, c double").select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), "c").collect()
    assert all(r.x == pytest.approx(r.c) for r in rows)
    assert one(spark, [3.0, 0.0, 4.0], vectors.normalize, "array<float>") == pytest.approx([0.6, 0.0, 0.8])
    assert one(spark, [0.0, 0.0], vectors.normalize, "array<float>") == [0.0, 0.0]


def test_mock_embedding_is_deterministic_and_unit(spark):
    a, b, c = (np.array(one(spark, t, lambda x: vectors.mock_embedding(x, 32))) for t in ("hello", "hello", "world"))
    assert (a == b).all() and (a != c).any() and np.linalg.norm(a) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        vectors.mock_embedding(F.lit("x"), 300)


@pytest.mark.parametrize("value,want", [('["a", "b"]', ["a", "b"]), ('"[\\"t::c\\"]"', ["t::c"]), ("[]", []), ("", []), (None, []), ("null", [])])
def test_string_list(spark, value, want):
    assert one(spark, value, scalars.string_list) == want


def test_string_list_refuses_other_text(spark):
    with pytest.raises(Exception, match="not a list"):
        one(spark, "{oops", scalars.string_list)


@pytest.mark.parametrize("repo,commit,ok", [
    ("acme/calc", "deadbeef", True), ("a.b/c_d-e", "A" * 40, True), ("-flag/x", "deadbeef", False), ("acme", "deadbeef", False), ("a/../b", "deadbeef", False),
    ("a/b..c", "deadbeef", False), ("a/b", "xyz", False), ("a/b", "abc", False), ("a/b", "--upload-pack=x", False), (None, "deadbeef", False),
])
def test_checkout_pairs(spark, repo, commit, ok):
    row = spark.createDataFrame([(repo, commit)], "r string, c string").select(scalars.valid_checkout(F.col("r"), F.col("c")).alias("v")).first()
    assert row.v is ok


def test_caps_and_previews(spark):
    assert one(spark, "hello", lambda x: text.cap_code_points(x, 0)) == "hello" and one(spark, "hello", lambda x: text.cap_code_points(x, 3)) == "hel"
    assert one(spark, "éé" * 3, lambda x: text.cap_excerpt(x, 2)) == "éé\n… (truncated)"
    assert one(spark, "éé", lambda x: text.cap_bytes(x, 3)).startswith("é")
    assert one(spark, "\n  \n  x = 1\n", text.first_line) == "x = 1" and one(spark, None, text.first_line) == ""
    assert one(spark, None, text.error_body) == "(empty body)" and one(spark, "a" * 301, text.error_body) == "a" * 300 + "…"


def test_backoff_and_retry_after(spark):
    got = [one(spark, a, lambda x: scalars.backoff_delay(x, 0.5, F.lit(7)), "int") for a in range(9)]
    assert got == [7, 7, 7, 7, 8, 16, 30, 30, 30] == [delay(a, 0.5, 7) for a in range(9)]
    for header, want in (("7", 7), ("-3", 0), ("Wed, 21 Oct 2015 07:28:00 GMT", 0), (None, 0)):
        assert one(spark, header, scalars.retry_after_seconds) == want == retry_after_seconds(header)


def test_small_scalars(spark):
    assert one(spark, [20, 5, 5, 0, -3, 10, 20], scalars.sorted_unique_ks, "array<int>") == [5, 10, 20]
    assert one(spark, [0, -1], scalars.sorted_unique_ks, "array<int>") == [10]
    assert one(spark, "length", scalars.normal_stop_reason) == "max_tokens"
    assert one(spark, "a/node_modules/x.js", scalars.in_skipped_dir) is True and one(spark, "src/vendor", scalars.in_skipped_dir) is False
    assert one(spark, "ok\0more", scalars.is_binary) is True and one(spark, "ok", scalars.is_binary) is False
    assert one(spark, "about caching", lambda x: scalars.mock_reply(x, F.lit("echo"), {"z": "no", "cach": "yes"})) == "yes"
