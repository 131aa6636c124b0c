import pytest
from pyspark.sql import functions as F

from tarnfold import queries
from tarnfold.operators import chunking, context, embedding, hybrid, lexical, logs, prompts, recall, semantic
from tarnfold.operators.config import ChunkConfig, effective_overlap, effective_window
from tarnfold.operators.skew import salted_join
from tarnfold.plans import predict, search
from tarnfold.streaming import incremental

CHUNKS = "corpus_id string, chunk_id bigint, path string, start_line int, end_line int, content string"


def chunks(spark, rows):
    return spark.createDataFrame([("c", i, p, s, s, t) for i, (p, s, t) in enumerate(rows)], CHUNKS)


def ask(spark, *texts):
    return spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "query_id string, corpus_id string, text string")


@pytest.mark.parametrize("n,windows", [(3, [(1, 3)]), (50, [(1, 50)]), (51, [(1, 50), (41, 51)]), (90, [(1, 50), (41, 90)]), (131, [(1, 50), (41, 90), (81, 130), (121, 131)])])
def test_windows_cover_the_file(spark, n, windows):
    files = spark.createDataFrame([("c", "f", "\n".join(["x"] * n)), ("c", "null", None), ("c", "blank", " \n \n")], "corpus_id string, path string, content string")
    got = chunking.chunk_windows(files).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == windows


def test_effective_settings(spark):
    rows = [(50, 10, 50, 10), (30, 30, 30, 6), (0, -1, 50, 10), (50, 0, 50, 0), (50, None, 50, 0), (None, None, 50, 0), (-5, 99, 50, 10)]
    df = spark.createDataFrame(rows, "w int, o int, ew int, eo int")
    for r in df.select("ew", "eo", effective_window(F.col("w")).alias("a"), effective_overlap(F.col("w"), F.col("o")).alias("b")).collect():
        assert (r.a, r.b) == (r.ew, r.eo)
    assert ChunkConfig(0, -1, 0, 0).normalised() == ChunkConfig(50, 10)


def test_redelivered_windows_count_once_and_caps_follow_the_walk(spark):
    rows = spark.createDataFrame([("c", 5, "a.go", 1, 2, "x"), ("c", 3, "a.go", 1, 2, None), ("c", 9, "a.go", 1, 2, "x"), ("c", 7, "a/b.go", 1, 2, "y")], CHUNKS)
    assert sorted(r.chunk_id for r in chunking.usable_chunks(rows).collect()) == [5, 7]
    assert [r.path for r in chunking.cap_chunks(chunking.usable_chunks(rows), 1).collect()] == ["a/b.go"]


LEXICAL = [("fizz.go", 1, "func FizzBuzz(n int) []string { return fizzbuzz logic }"), ("rev.go", 1, "func Reverse(s string) string { reverse the runes }"), ("http.go", 1, "func healthHandler() { start an http server }")]


def test_bm25_finds_the_right_file_and_nothing_for_unknown_words(spark):
    c = chunks(spark, LEXICAL)
    got = lexical.bm25_topk(ask(spark, "fizzbuzz implementation", "HTTP health server", "zzzznonexistent"), c, 100).where("rank = 1").collect()
    assert {r.query_id: r.path for r in got} == {"0": "fizz.go", "1": "http.go"}
    assert lexical.bm25_topk(ask(spark, "x"), c.where("false"), 5).count() == 0
    assert lexical.bm25_topk(ask(spark, "fizz"), c, 0).count() == 0


#: Redelivered windows, chunk_ids that several windows share, words of many parts, nulls, no terms.
ODD = [
    ("c", 1, "a.go", 1, 2, "fooBar foo FOO x"), ("c", 2, "a.go", 1, 2, "never"), ("c", 3, "b.go", 1, 2, "foo bar"), ("c", 3, "c.go", 1, 2, "bar baz"), ("c", 3, "d.go", 1, 2, "foo foo foo"),
    ("d", 3, "a.go", 1, 2, "foo qux"), ("d", 4, "b.go", 1, 2, None), ("d", 5, "b.go", 1, 2, "zwei drei zwei"), ("d", 6, "e.go", 1, 2, "--"), ("d", 7, "f.go", 1, 2, "a1" * 20_000),
]


def test_document_frequencies_of_a_whole_table_write_no_postings(spark, monkeypatch):
    rows = spark.createDataFrame(ODD, CHUNKS)
    want = sorted(map(tuple, lexical.lexical_index(chunking.usable_chunks(rows)).df.collect()))
    monkeypatch.setattr(lexical, "cut", None)
    assert sorted(map(tuple, lexical.document_frequencies(rows).collect())) == want
    assert lexical.document_frequencies(rows.where("false")).count() == 0
    sole, others = chunking.sole_chunks(rows)
    assert sorted(r.chunk_id for r in sole.collect()) == [5, 6, 7] and sorted(r.chunk_id for r in others.collect()) == [1, 3, 3, 3, 3]


def test_term_frequencies_of_a_whole_table_write_no_postings(spark, monkeypatch):
    rows = spark.createDataFrame(ODD, CHUNKS)
    p = lexical.lexical_index(chunking.usable_chunks(rows)).postings
    want = p.groupBy("chunk_id", "dl").agg(F.count("*").alias("terms"), F.sum("f").alias("tokens"), F.max("f").alias("most"))
    want, schema = sorted(map(tuple, want.collect())), want.dtypes
    monkeypatch.setattr(lexical, "cut", None)
    got = lexical.term_frequencies(rows)
    assert got.dtypes == schema and sorted(map(tuple, got.collect())) == want
    assert (7, 40_001, 3, 40_001, 20_000) in want
    assert lexical.term_frequencies(rows.where("false")).count() == 0


def test_statistics_of_a_whole_table_write_no_postings(spark, monkeypatch):
    rows = spark.createDataFrame(ODD, CHUNKS)
    monkeypatch.setattr(lexical, "cut", None)
    # Each window counts, as in the SQL, also those that share a chunk_id and a length.
    assert sorted(map(tuple, lexical.corpus_stats(rows).collect())) == [("c", 4, (6 + 2 + 2 + 3) / 4), ("d", 4, (2 + 3 + 0 + 40_001) / 4)]
    assert lexical.corpus_stats(rows.where("false")).count() == 0


def test_smaller_k_is_a_prefix(spark):
    c = chunks(spark, [(f"f{i}", 1, "alpha beta " * (i % 4 + 1) + "gamma") for i in range(12)])
    many = [(r.rank, r.path) for r in lexical.bm25_topk(ask(spark, "alpha beta gamma"), c, 10).orderBy("rank").collect()]
    few = [(r.rank, r.path) for r in lexical.bm25_topk(ask(spark, "alpha beta gamma"), c, 4).orderBy("rank").collect()]
    assert few == many[:4]


def test_semantic_and_hybrid_modes(spark):
    c = chunks(spark, [("a.go", 1, "alpha apple ant"), ("b.go", 1, "beta banana bear"), ("c.go", 1, "gamma grape goat")])
    embedder = embedding.MockEmbedder()
    hits = search.ranker("semantic", embedder)(ask(spark, "beta banana bear"), c, 10).orderBy("rank").collect()
    assert hits[0].path == "b.go" and len(hits) == 3
    assert search.search(ask(spark, "beta banana bear"), c, 1, "hybrid", embedder).first().preview == "beta banana bear"
    with pytest.raises(ValueError, match="unknown mode"):
        search.ranker("other")
    with pytest.raises(ValueError, match="needs an embedder"):
        search.ranker("hybrid")


def test_fusion_order_is_1_3_2_whatever_the_order_of_parts(spark):
    schema = "query_id string, rank int, chunk_id bigint, path string, start_line int"
    a = spark.createDataFrame([("q", 1, 1, "p", 1), ("q", 2, 2, "p", 2), ("q", 3, 3, "p", 3)], schema)
    b = spark.createDataFrame([("q", 1, 3, "p", 3), ("q", 2, 1, "p", 1), ("q", 3, 2, "p", 2)], schema)
    for parts in ([a, b], [b, a]):
        assert [r.start_line for r in hybrid.fuse(parts, 10).orderBy("rank").collect()] == [1, 3, 2]


def test_nearest_vectors_ties_and_bad_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, vec array<float>")
    got = semantic.nearest_vectors(v.where("vec_id = 6"), v, 2, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 1.0)]
    assert semantic.nearest_vectors(v.where("false"), v, 2, 2).count() == 0


def test_recall_fractions_sweep_and_summary(spark):
    rows = [(["a", "b"], ["a", "b", "x"], 1.0), (["a", "c"], ["a"], 0.5), (["z"], ["a"], 0.0), ([], ["a"], 0.0), (None, None, 0.0)]
    df = spark.createDataFrame(rows, "c array<string>, r array<string>, want double")
    assert all(x.got == x.want for x in df.select("want", recall.recall(F.col("c"), F.col("r")).alias("got")).collect())
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query_id string, rank int, path string")
    tasks = spark.createDataFrame([("q", ["b"]), ("none", ["x"])], "query_id string, changed_files array<string>")
    swept = recall.sweep(ranked, tasks, [1, 2], "lexical")
    assert {(r.query_id, r.k): r.recall_at_k for r in swept.collect()} == {("q", 1): 0.0, ("q", 2): 1.0, ("none", 1): 0.0, ("none", 2): 0.0}
    lost = recall.failed_rows(tasks.withColumn("error", F.lit("boom")), ["semantic"], [1])
    table = {(r.mode, r.k): r for r in recall.summarize(swept.unionByName(lost)).collect()}
    assert (table["lexical", 2].n, table["lexical", 2].mean_recall) == (2, 0.5)
    assert (table["semantic", 1].n, table["semantic", 1].errors, table["semantic", 1].mean_recall) == (0, 2, 0.0)


def test_contexts(spark):
    c = chunks(spark, [("a/b.go", 1, "x"), ("a.go", 1, "y"), ("a.go", 51, "z"), ("c.go", 1, "w")])
    gold = spark.createDataFrame([("q", "c", "a.go"), ("q", "c", "a/b.go")], "query_id string, corpus_id string, path string")
    ranked = spark.createDataFrame([("q", 1, "c", 3, "c.go", 1), ("q", 2, "c", 2, "a.go", 51)], "query_id string, rank int, corpus_id string, chunk_id bigint, path string, start_line int")
    shown = lambda mode, **kw: [(r.path, r.start_line) for r in context.context_chunks(mode, 10, ranked, c, gold, **kw).orderBy("rank").collect()]
    assert shown("oracle") == [("a/b.go", 1), ("a.go", 1), ("a.go", 51)]
    assert shown("file", top_files=2) == [("a.go", 1), ("a.go", 51), ("c.go", 1)]
    assert shown("retrieval") == [("c.go", 1), ("a.go", 51)] and shown("none") == []
    with pytest.raises(ValueError):
        shown("all")


def test_log_parsers_and_scores(spark):
    py = "t.py::a PASSED [ 50%]\nt.py::b FAILED\nFAILED t.py::a - x\nt.py::c SKIPPED: why\nPASSED t.py::d"
    go = "=== RUN TestA\n--- PASS: TestA (0.00s)\n    --- FAIL: TestA/sub (0.1s)\n--- FAIL: TestA (0.01s)\n--- SKIP: TestS (0s)"
    df = spark.createDataFrame([(1, py), (2, None), (3, "")], "id int, log string")
    assert {r.test: r.status for r in logs.parse_pytest(df, "id").collect()} == {"t.py::a": "PASSED", "t.py::b": "FAILED", "t.py::c": "SKIPPED", "t.py::d": "PASSED"}
    got = {r.test: r.status for r in logs.parse_gotest(spark.createDataFrame([(1, go)], "id int, log string"), "id").collect()}
    assert got == {"TestA": "FAILED", "TestA/sub": "FAILED", "TestS": "SKIPPED"}
    inst = spark.createDataFrame([("ok", ["fix"], ["keep"]), ("fail", ["fix"], []), ("regress", ["fix"], ["keep"]), ("miss", ["fix"], []), ("none", [], [])], "instance_id string, fail_to_pass array<string>, pass_to_pass array<string>")
    seen = spark.createDataFrame([("ok", "fix", "PASSED"), ("ok", "keep", "PASSED"), ("fail", "fix", "FAILED"), ("regress", "fix", "PASSED"), ("regress", "keep", "FAILED")], "instance_id string, test string, status string")
    scored = {r.instance_id: r for r in logs.score_instances(inst, seen).collect()}
    assert {k: r.resolved for k, r in scored.items()} == {"ok": True, "fail": False, "regress": False, "miss": False, "none": False}
    assert scored["miss"].fail_to_pass == {"fix": "MISSING"}


def test_cache_embeds_each_text_once(spark):
    cache = spark.createDataFrame([], "key string, vec array<float>")
    embedder, sizes = embedding.MockEmbedder(4), []
    for batch in (["a", "b", "a"], ["a", "b"], ["c", None]):
        texts = spark.createDataFrame([(t,) for t in batch], "text string")
        out, fresh = embedding.embed_cached(texts, cache, embedder)
        assert out.where("text is not null and vec is null").count() == 0
        cache = spark.createDataFrame(cache.unionByName(fresh).collect(), cache.schema)
        sizes.append(cache.count())
    assert sizes == [2, 2, 3]


def test_prompts_and_predictions(spark):
    tasks = spark.createDataFrame([("q", "acme/calc", " broken \n"), ("n", "acme/calc", None)], "query_id string, repo string, text string")
    ctx = spark.createDataFrame([("q", 1, "a.py", 1, 3, "x" * 50), ("q", 2, "b.py", 1, 1, "y"), ("q", 3, "c.py", 1, 1, "z")], "query_id string, rank int, path string, start_line int, end_line int, content string")
    got = {r.query_id: r.message for r in prompts.user_messages(tasks, ctx, 2, 10).collect()}
    assert "File: a.py  (lines 1-3)" in got["q"] and "c.py" not in got["q"] and "truncated" in got["q"] and "No repository excerpts" in got["n"]
    diff = "--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y"
    rows = {r.instance_id: r for r in predict.predictions(tasks, ctx, predict.mock_provider({"acme": f"```diff\n{diff}\n```"}), "mock").collect()}
    assert rows["q"].plausible_hit and rows["q"].changed_files == ["a.py"] and rows["q"].model_patch.endswith("+y\n") and rows["q"].err is None
    assert not rows["n"].plausible_hit and rows["n"].model_patch != ""
    echo = predict.predictions(tasks, ctx, predict.mock_provider({}), "mock").where("instance_id = 'n'").first()
    assert echo.model_patch == "" and echo.err == "no diff found in model output"
    assert predict.counters(predict.predictions(tasks, ctx, predict.mock_provider({}), "mock")).first().errored == 2


def test_streaming_windows_and_cache(spark, tmp_path):
    files = spark.createDataFrame([("c", "f", "\n".join("abc"))], "corpus_id string, path string, content string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    q = incremental.stream_windows(stream, ChunkConfig(2, 0)).writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 2
    texts = stream.select(F.col("content").alias("text"))
    for n in (1, 2):  # a second run over the same texts adds nothing
        q = incremental.embed_into_cache(texts, embedding.MockEmbedder(4), str(tmp_path / "cache")).option("checkpointLocation", str(tmp_path / f"k{n}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_previews_of_lines_outside_ascii_equal_brute_force(spark, tmp_path):
    """Also where the cut at 100 bytes splits a character of two, three or four bytes."""
    texts = [c * n + tail for c in "é漢😀" for n in (1, 24, 25, 26, 33, 34, 49, 50, 51) for tail in ("", "a", "\tb " * 30)]
    texts += ["", " \n\u3000\n\tnaïve\tline \r\nnext", "a\tb", "plain", "x" * 99 + "é", "x" * 100, "x" * 101, None]
    rows = [("c", i, f"{i}.py", 1, 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, CHUNKS).write.parquet(f"{tmp_path}/chunks.parquet")

    def brute(value):
        line = next((x.strip() for x in value.split("\n") if x.strip()), "")
        raw = line.encode()
        return raw[:100].decode("utf-8", "replace") + "…" if len(raw) > 100 else line

    got = {r.chunk_id: r.preview for r in queries.first_line_preview(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts) if t is not None}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_one(spark, how):
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}" if i % 5 else None) for i in range(400)], "a int, k string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k9", 4), (None, 5)], "k string, b int")
    rows = lambda df: sorted(map(repr, df.select("a", "k", "b").collect()))
    assert rows(salted_join(many, few, ["k"], how, hot=20)) == rows(many.join(few, ["k"], how))
    assert salted_join(many.where("false"), few, ["k"], how).count() == 0
