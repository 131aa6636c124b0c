import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import handwritten, pairs, truncation

WORDS = "the reader keeps a reference to its buffer and never releases it when every request fails with another error".split()
PRED = "prediction_id bigint, instance_id string, model_name_or_path string, model_patch string, raw string, stop_reason string, output_tokens bigint, err string"


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 12))).capitalize() + "."


def diff(rng):
    body = "".join(f" line {'y' * rng.randint(0, 60)}\n" for _ in range(rng.randint(2, 9)))
    n = body.count("\n") + 1
    return f"diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,{n} +1,{n} @@\n-old {rng.random()}\n+new {rng.random()}\n{body}"


def predictions():
    rng = random.Random(9)
    rows, cut = [], set()
    for i in range(900):
        d = diff(rng)
        raw = " ".join(sentence(rng) for _ in range(rng.randint(1, 6))) + "\n\n" + (f"```diff\n{d}```" if i % 3 else d)
        patch, source, stop = d, ("m1", "m2", None)[i % 3], "end_turn"
        if source == "m1" and len(raw) > 500:
            raw = raw[:500]
            cut.add((i, "raw"))
        elif i % 30 == 1:
            raw, stop = raw[: len(raw) // 2].rstrip("\n .`") + "x", "MAX_TOKENS"
            cut.add((i, "raw"))
        elif i % 31 == 2:
            patch = d[: len(d) - 9]
            cut.add((i, "model_patch"))
        elif i % 37 == 5:
            patch = d.replace("@@ -1,", "@@ -1,9", 1) + "\\ No newline at end of file\n"
        rows.append((i, "x", source, patch, raw, stop, len(raw) // 4, None))
    rows += [(2000, "x", "m1", "", None, None, None, None), (2001, "x", "m2", None, "", "length", 0, None), (2002, "x", None, "  ", " \n", None, None, "e")]
    exact = "A complete reply of just this length " + "o" * 461 + "k."
    rows.append((2003, "x", "m1", "", exact, "end_turn", 125, None))
    assert len(exact) == 500
    return rows, cut


def test_truncation_by_hazard_ceiling_and_transfer(spark):
    rows, cut = predictions()
    df = spark.createDataFrame(rows, PRED).withColumn("ending", F.lit("clash"))
    marks = {(r.source, r.field_name, r.length) for r in truncation.significant_lengths(df).where("measure = 'characters'").collect()}
    assert ("m1", "raw", 500) in marks and not any(length != 500 for _, _, length in marks)
    got = {(r.prediction_id, r.field_name) for r in truncation.found(df).collect()}
    assert (2003, "raw") not in got
    assert len(got & cut) >= 0.98 * len(cut) and len(got - cut) <= 2, (cut - got, got - cut)
    shares = truncation.shares(df, truncation.truncated(df)).collect()
    assert sum(r.n_truncated for r in shares) == len(got) and {r.source for r in shares} == {"m1", "m2", None}
    assert truncation.found(df.where("false")).count() == 0
    # Nothing but what the provider names is left if no hazard is significant.
    assert {r.reason for r in truncation.truncated(df, fdr=0.0).collect()} == {"ceiling"}
    kinds = {r.measure for r in truncation.hazards(df).collect()}
    assert {"characters", "break"} <= kinds


def test_hazards_equal_brute_force(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 300) for _ in range(400)] + [150] * 12 + [300] * 9
    rows = [(i, "x", "m", "", "".join(rng.choice("abc") for _ in range(n)), None, None, None) for i, n in enumerate(sizes)]
    got = {r.length: r for r in truncation.length_hazards(spark.createDataFrame(rows, PRED)).where("measure = 'characters' and field_name = 'raw'").collect()}
    values = [len(v) for v in {r[4] for r in rows}]
    near = truncation.NEIGHBOURS
    for length, r in got.items():
        around = [j for j in range(max(1, length - near), length + near + 1) if j != length]
        ends, risk = sum(values.count(j) for j in around), sum(sum(v >= j for v in values) for j in around)
        at_risk = sum(v >= length for v in values)
        mean = at_risk * max(ends / max(1, risk), truncation.FLOOR * len(values) / sum(values))
        assert r.n == values.count(length) and r.at_risk == at_risk and abs(r.expected - mean) < 1e-9
    kept = {r.length for r in truncation.discoveries(spark.createDataFrame(list(got.values())), 0.01).collect()}
    ranked = sorted(r.p_value for r in got.values())
    exact = max((p for k, p in enumerate(ranked, 1) if p <= 0.01 * k / len(ranked)), default=0)
    assert kept == {150, 300} and kept <= {x for x, r in got.items() if r.p_value <= exact}


@pytest.mark.parametrize("text,state", [
    ("Done.", truncation.COMPLETE), ("The reader keeps a refe", truncation.BROKEN), ("It is cut [output clipped]", truncation.MARKED), (None, truncation.COMPLETE), ("​", truncation.COMPLETE),
    ("```diff\n--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b\n```\n\nTests: 3 passed, 0 failed", truncation.COMPLETE), ("--- a\n+++ b\n@@ -1,3 +1,3 @@\n a\n", truncation.WEAK), ("--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b\n", truncation.COMPLETE), ("漢字。", truncation.COMPLETE),
])
def test_endings(text, state):
    assert truncation.reply_ending(text) == state


GERMAN = "Die Änderung behebt den Fehler und ist nicht mit der alten Version zu vergleichen, wenn sie für eine Datei wird."


def labelled():
    rng = random.Random(4)
    inst = [(f"i{k}", f"Title number {k} about module_{k}\n\n" + " ".join(sentence(rng) for _ in range(8)) + f" See `call_{k}`.") for k in range(220)]
    rows, want = [], {}
    for n in range(1100):
        name, statement = inst[n % 220]
        raw, kind = sentence(rng) + " " + sentence(rng) + "\n\n```diff\n" + diff(rng) + "```", None
        if n % 5 == 1:
            raw = sentence(rng) + " " + sentence(rng)
        if n % 16 == 3:
            kind, raw = ("empty", rng.choice(["", "\n", "```\n```", None])) if n % 2 else ("empty", " ")
        elif n % 16 == 5:
            kind, raw = "refusal", rng.choice(["I am sorry, but I can't help with this.", "I must decline to change this module.", "Unfortunately I am unable to provide a patch."])
        elif n % 16 == 7:
            kind, raw = "copy", rng.choice(["{}", "Issue:\n{}", "```\n{}\n```"]).format(statement)
        elif n % 16 == 9:
            kind, raw = "other_language", GERMAN + "\n\n```diff\n" + diff(rng) + "```"
        elif n % 16 == 11:
            kind, raw = "truncated", raw[: len(raw) * 2 // 3].rstrip("`.\n ") + " a"
        rows.append((n, name, "m", "", raw, "stop", 1, None))
        if kind:
            want[n] = kind
    return rows, inst, want


def test_pair_defects_on_held_out_pairs(spark):
    rows, inst, want = labelled()
    df = spark.createDataFrame(rows, PRED).withColumn("defect_type", F.lit("clash"))
    instances = spark.createDataFrame(inst + inst[:5] + [("null", None)], "instance_id string, problem_statement string")
    got = {r.prediction_id: r.defect_type for r in pairs.found(df, instances).collect()}
    for kind in pairs.KINDS:
        true = {i for i, k in want.items() if k == kind}
        flagged = {i for i, k in got.items() if k == kind}
        assert len(true & flagged) >= 0.9 * len(true) and len(flagged - true) <= 0.1 * len(flagged), (kind, len(true), len(flagged), len(true & flagged))


def test_a_copy_may_name_the_title_late():
    """The statement's first line counts wherever the reply repeats it, also after a long quoted log."""
    log = " ".join(f"step{i} failed" for i in range(300))
    statement = pairs.read_statement(f"Zebra pagination breaks\n{log}")
    early, late = (pairs.features(statement, t)[2] for t in (f"Zebra pagination breaks\n{log}", f"{log}\nZebra pagination breaks"))
    assert late[-2] == early[-2] == 1 and late[-1] == early[-1] == 0


def test_pairs_of_small_and_empty_tables(spark):
    instances = spark.createDataFrame([("a", None)], "instance_id string, problem_statement string")
    rows = spark.createDataFrame([(1, "a", "m", "", None, None, None, None), (2, "gone", "m", "", "Fine.", None, None, None)], PRED)
    assert [(r.prediction_id, r.defect_type) for r in pairs.found(rows, instances).collect()] == [(1, "empty")]
    assert pairs.found(rows.where("false"), instances.where("false")).count() == 0


# ------------------------------------------------------------------ hand-written

FILES = "corpus_id string, path string, content string, chunk_id bigint, start_line int"
NAMES = "reader writer buffer request parser module counter window handle session".split()


def code(rng, n=14):
    """Python of varied statements, as people write it."""
    out = ["import json", ""]
    name = lambda: rng.choice(NAMES) + rng.choice(["", "_"]) + rng.choice(NAMES)
    value = lambda: rng.choice([lambda: f"{name()}({name()})", lambda: f"{name()}[{rng.randint(0, 99)}]", lambda: f"{name()}.{name()}", lambda: f"not {name()} or {name()} > {rng.randint(0, 99)}", lambda: f"[{name()}, {name()}]", lambda: f'f"{{{name()}}}: {rng.randint(0, 999)}"', lambda: f"{name()} - {name()} % {rng.randint(2, 9)}", lambda: f"{{{name()}: {name()}}}"])()
    for _ in range(n):
        kind = rng.randint(0, 6)
        out += [
            [f"def {name()}({name()}, {name()}={rng.randint(1, 9)}):", f"    return {value()}", ""], [f"{name()} = {value()}"], [f"for {name()} in {value()}:", f"    {name()}({value()}, {value()})"],
            [f"if {value()}:", f"    raise ValueError({value()})"], [f"assert {value()} == {value()}, {value()}"], [f"class {name().title()}:", f"    {name()}: str = {value()}", ""], [f"with {value()} as {name()}:", f"    {name()}.{name()}[{value()}] += {value()}"],
        ][kind]
    return "\n".join(out)


def test_files_not_written_by_hand(spark):
    rng = random.Random(8)
    shared = code(rng, 30)
    rows, want = [], set()

    def add(corpus, path, text, flagged=False):
        rows.append((corpus, path, text))
        if flagged:
            want.add((corpus, path))

    for c in ("c1", "c2", "c3"):
        for i in range(40):
            add(c, f"src/m{i}.py", ("# Copyright 2024 the project contributors. See LICENSE.\n" if i % 2 else "") + code(rng))
        add(c, "src/gen.py", "# Code generated by tool v1. DO NOT EDIT.\n" + code(rng), True)
        add(c, "src/banner.py", code(rng) + '\nBANNER = "Code generated by this tool. DO NOT EDIT."\n')
        add(c, "src/acc.py", "\n".join(f"def get_field_{i}(self):\n  return self._fields[{i}]" for i in range(60)), True)
        add(c, "src/table.py", "W = [\n" + "\n".join("    [" + ", ".join(f"{rng.gauss(0, 1):.5f}" for _ in range(8)) + "]," for _ in range(40)) + "\n]", True)
        add(c, "web/x.js", "".join(f"var {rng.choice('abcdefg')}={rng.choice('hijk')}[{rng.choice('lmn')}]||{rng.choice('opq')};" for _ in range(120)), True)
        add(c, "third_party/lib/lib.py", code(rng), True)
        add(c, f"tools/copied_{c}.py", shared, True)
        add(c, "src/lib.py", "# (c) 2011 zlibber maintainers\n" + code(rng), True)
        add(c, "go.sum", "\n".join(f"a.test/m v1.{i}.0 h1:{rng.getrandbits(250):x}=" for i in range(30)), True)
        add(c, "docs/README.md", "generated by hand " * 50)
        add(c, "config/a.yml", "\n".join(f"k{i}: {i}" for i in range(60)))
    rows.append(("c1", "null.py", None))
    data = [(c, p, t, i, 1) for i, (c, p, t) in enumerate(rows + rows[:30])]
    chunks = spark.createDataFrame(pd.DataFrame(data, columns=["corpus_id", "path", "content", "chunk_id", "start_line"]), FILES).withColumn("kind", F.lit("clash"))
    corpora = spark.createDataFrame([(c, f"o/{c}") for c in ("c1", "c2", "c3")], "corpus_id string, repo string")
    got = {(r.corpus_id, r.path) for r in handwritten.found(chunks, corpora).collect()}
    assert got == want, (sorted(want - got), sorted(got - want))
    assert handwritten.found(chunks.where("false"), corpora.where("false")).count() == 0


@pytest.mark.parametrize("lines", [8, 9, 10, 13])
def test_short_copies_are_found(spark, lines):
    """All shingles count: a copied file with three of them is enough, whatever their hashes."""
    rng = random.Random(lines)
    rows, want = [], set()
    for i in range(20):
        shared = "\n".join(f"{rng.choice(NAMES)}_{rng.randint(0, 10**6)} = {rng.choice(NAMES)}({rng.choice(NAMES)}[{'+-*/%'[k % 5]}{rng.choice(NAMES)}]" + ")" * (k % 3) + "," * (k % 4) for k in range(lines))
        rows += [(c, f"src/copy{i}.py", shared, i, 1) for c in ("c1", "c2")]
        want |= {(c, f"src/copy{i}.py") for c in ("c1", "c2")}
    rows += [(c, f"src/m{i}.py", code(rng), 100 + i, 1) for c in ("c1", "c2") for i in range(20)]
    corpora = spark.createDataFrame([(c, f"o/{c}") for c in ("c1", "c2")], "corpus_id string, repo string")
    assert {(r.corpus_id, r.path) for r in handwritten.found(spark.createDataFrame(rows, FILES), corpora).collect()} == want
