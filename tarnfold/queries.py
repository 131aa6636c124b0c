"""Driver queries of the core operators (whole tables) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import diffs, scalars, text, vectors
from tarnfold.operators import chunking, context, embedding, hybrid, lexical, logs, prompts, recall, semantic
from tarnfold.operators.config import ChunkConfig, effective_overlap, effective_window
from tarnfold.plans import predict
from tarnfold.session import table
from tarnfold.sources.files import TEMPLATE

Query = Callable[[SparkSession, str], DataFrame]
MAX_QUERY = 4000
K = 10
KS = [5, 10, 20]
MODEL = "mock-64"
DOC_CONFIG = ChunkConfig(window=5, overlap=1)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.usable_chunks(table(spark, d, "chunks"))


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances once each, with the corpus of their checkout."""
    once = table(spark, d, "instances").dropDuplicates(["instance_id"])
    corpora = table(spark, d, "corpora").select("corpus_id", "repo", "base_commit")
    return once.join(corpora, ["repo", "base_commit"])


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    capped = text.cap_code_points(F.col("problem_statement"), MAX_QUERY)
    return _instances(spark, d).select(F.col("instance_id").alias("query_id"), "corpus_id", capped.alias("text"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _instances(spark, d).select(
        F.col("instance_id").alias("query_id"), "corpus_id", F.explode(diffs.changed_files(F.col("patch"))).alias("path")
    )


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return lexical.bm25_topk(_tasks(spark, d), _chunks(spark, d), k)


def _semantic(spark: SparkSession, d: str, k: int) -> DataFrame:
    embed = vectors.mock_embedding
    q = _tasks(spark, d).select("query_id", "corpus_id", embed(F.col("text")).alias("vec"))
    c = _chunks(spark, d).select("corpus_id", "chunk_id", "path", "start_line", embed(F.col("content")).alias("vec"))
    return semantic.corpus_topk(q, c, k)


def _context(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ranked = _lexical(spark, d, context.pool_size(K))
        return context.context_chunks(mode, K, ranked, _chunks(spark, d), _gold(spark, d))

    return run


def _public(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("query_id").alias("instance_id"), *columns)


RANKED = ("rank", "path", "start_line", "score")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _public(_lexical(spark, d, K), *RANKED)


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = lexical.bm25_scores(_tasks(spark, d), _chunks(spark, d))
    return rows.select(F.col("query_id").alias("instance_id"), "chunk_id", F.round("score", 6).alias("score"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = lexical.corpus_stats(table(spark, d, "chunks"))
    return stats.select("corpus_id", "n", F.round("avg_dl", 6).alias("avg_dl"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_windows(table(spark, d, "documents"), DOC_CONFIG, keys=("doc_id",), content="text")
    return rows.select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


def config_defaults(spark: SparkSession, d: str) -> DataFrame:
    w, o = F.col("window_lines"), F.col("overlap_lines")
    return table(spark, d, "corpora").select("corpus_id", effective_window(w).alias("window"), effective_overlap(w, o).alias("overlap"))


def rrf_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = [_lexical(spark, d, hybrid.POOL), _semantic(spark, d, hybrid.POOL)]
    return _public(hybrid.fuse(parts, K), "rank", "path", "start_line", F.round("score", 9).alias("score"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "chunk_vectors").select("vec_id", "vec").where(
        (F.size("vec") == vectors.DIM) & F.exists("vec", lambda x: x != 0)
    )
    near = semantic.nearest_vectors(usable.where("vec_id % 100 = 0"), usable, K, vectors.DIM, decimals=6)
    return near.select("query_id", "rank", "vec_id", "score")


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the one of the next id: all kinds of unusable ones meet usable ones."""
    v = table(spark, d, "chunk_vectors").select("vec_id", "vec", (F.col("vec_id") + 1).alias("other_id"))
    w = v.select(F.col("vec_id").alias("other_id"), F.col("vec").alias("other"))
    pairs = v.join(w, "other_id")
    return pairs.select("vec_id", "other_id", F.round(vectors.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


def normalize_vec(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_vectors").where("vec is not null and size(vec) > 0")
    unit = vectors.normalize(F.col("vec"))
    return v.select("vec_id", F.posexplode(unit).alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def mock_embed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "eval_items").select("item_id", F.posexplode(vectors.mock_embedding(F.col("text"))).alias("i", "x"))
    return v.select("item_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", vectors.cache_key(MODEL, F.col("content")).alias("key"))


def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    """The cache holds what the vectors table embeds; how many distinct contents of each corpus hit it."""
    chunks = _chunks(spark, d)
    embedded = table(spark, d, "chunk_vectors").select("chunk_id").distinct()
    keyed = chunks.select("corpus_id", "chunk_id", vectors.cache_key(MODEL, F.col("content")).alias("key"))
    cache = keyed.join(embedded, "chunk_id", "left_semi").select("key").distinct().withColumn("hit", F.lit(1))
    rows = keyed.select("corpus_id", "key").distinct().join(cache, "key", "left")
    return rows.groupBy("corpus_id").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    misses = _chunks(spark, d).select(F.col("corpus_id").alias("part"), vectors.cache_key(MODEL, F.col("content")).alias("key")).distinct()
    sized = embedding.batches(misses, "key")
    return sized.groupBy(F.col("part").alias("corpus_id"), "batch").agg(F.count("*").alias("texts"), F.max("index").alias("last_index"), F.min("key").alias("first_key"))


def reply_order(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a reply in the order of their index, whatever order they came in."""
    rows = table(spark, d, "chunk_vectors").where("reply_no is not null")
    lists = rows.groupBy("model_name", "embedded_at").agg(F.array_sort(F.collect_list(F.struct("reply_no", "vec_id"))).alias("r"))
    return lists.select("model_name", "embedded_at", F.concat_ws(",", F.transform("r", lambda x: x["vec_id"].cast("string"))).alias("vec_ids"))


def recall_sweep(spark: SparkSession, d: str) -> DataFrame:
    tasks = _instances(spark, d).select(F.col("instance_id").alias("query_id"), diffs.changed_files(F.col("patch")).alias("changed_files"))
    rows = recall.sweep(_lexical(spark, d, max(KS)), tasks, KS, "lexical")
    return _public(rows, "mode", "k", F.size("retrieved_files").alias("n_files"), F.round("recall_at_k", 6).alias("recall_at_k"), "full_hit")


def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    tasks = _instances(spark, d).select(F.col("instance_id").alias("query_id"), diffs.changed_files(F.col("patch")).alias("changed_files"))
    rows = recall.summarize(recall.sweep(_lexical(spark, d, max(KS)), tasks, KS, "lexical"))
    return rows.select("mode", "k", "n", "errors", F.round("mean_recall", 6).alias("mean_recall"), F.round("full_hit_rate", 6).alias("full_hit_rate"))


def summarize(spark: SparkSession, d: str) -> DataFrame:
    rows = recall.summarize(recall.latest_results(table(spark, d, "recall_results")), "retrieval_mode")
    return rows.select("mode", "k", "n", "errors", F.round("mean_recall", 6).alias("mean_recall"), F.round("full_hit_rate", 6).alias("full_hit_rate"))


def format_table(spark: SparkSession, d: str) -> DataFrame:
    rows = recall.summarize(recall.latest_results(table(spark, d, "recall_results")), "retrieval_mode")
    c = [F.col(x) for x in ("mode", "k", "n", "errors")]
    return rows.select(scalars.table_line(*c, F.round("mean_recall", 6), F.round("full_hit_rate", 6)).alias("line"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = recall.latest_results(table(spark, d, "recall_results"))
    value = recall.recall(F.col("changed_files"), F.col("retrieved_files"))
    return rows.select(
        "instance_id", F.col("retrieval_mode").alias("mode"), "k", F.round(value, 6).alias("recall_at_k"),
        recall.full_hit(F.col("changed_files"), value).alias("full_hit"),
    )


def failed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Instances without a checkout of the commit that their environment is set up from fail for every mode and k."""
    once = table(spark, d, "instances").dropDuplicates(["instance_id"])
    there = table(spark, d, "corpora").select("repo", F.col("base_commit").alias("environment_setup_commit"))
    lost = once.join(there, ["repo", "environment_setup_commit"], "left_anti").select(
        F.col("instance_id").alias("query_id"), diffs.changed_files(F.col("patch")).alias("changed_files"), F.lit("checkout failed").alias("error")
    )
    rows = recall.failed_rows(lost, ["lexical", "semantic"], KS)
    return _public(rows, "mode", "k", "recall_at_k", "full_hit", "error")


def sorted_unique_ks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recall_results").groupBy("instance_id").agg(F.collect_list("k").alias("ks"))
    return rows.select("instance_id", F.concat_ws(",", F.transform(scalars.sorted_unique_ks("ks"), lambda k: k.cast("string"))).alias("ks"))


def distinct_files(spark: SparkSession, d: str) -> DataFrame:
    rows = recall.distinct_files(_lexical(spark, d, K))
    return rows.select(F.col("query_id").alias("instance_id"), F.concat_ws("|", "files").alias("files"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").dropDuplicates(["instance_id"]).select(
        "instance_id", F.concat_ws("|", diffs.changed_files(F.col("patch"))).alias("files")
    )


def plausible_hit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", recall.plausible(F.col("changed_files"), F.col("retrieved_files")).alias("hit"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.marked(F.col("text")).alias("_m"))
    return text.explode_terms(rows, "_m", "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("f"))


def unique_terms(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "instances").dropDuplicates(["instance_id"])
    return once.select("instance_id", F.md5(F.concat_ws(" ", text.unique_terms(F.col("problem_statement")))).alias("digest"), F.size(text.unique_terms(F.col("problem_statement"))).alias("n"))


def split_identifier(spark: SparkSession, d: str) -> DataFrame:
    stems = table(spark, d, "chunks").select(F.regexp_extract("path", r"([A-Za-z0-9]+)\.[a-z]+$", 1).alias("word")).where("word <> ''").distinct()
    return stems.select("word", F.concat_ws("|", text.split_identifier(F.col("word"))).alias("parts"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(table(spark, d, "chunks"))


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(table(spark, d, "chunks"))


def cap_walk_order(spark: SparkSession, d: str) -> DataFrame:
    return chunking.cap_chunks(_chunks(spark, d), 50).select("corpus_id", "path", "start_line")


def skip_dirs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("corpus_id", "path").distinct().where(~scalars.in_skipped_dir(F.col("path")))


def file_filters(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text").cast("binary")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", (F.octet_length(body) > 1_048_576).alias("too_large"), scalars.is_binary(body).alias("is_binary"))
    return rows


def string_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "instances").select("instance_id", F.posexplode(F.array(F.struct(F.lit("f").alias("kind"), F.col("fail_to_pass").alias("t")), F.struct(F.lit("p").alias("kind"), F.col("pass_to_pass").alias("t")))).alias("i", "x"))
    lists = rows.select("instance_id", "x.kind", scalars.string_list(F.col("x.t")).alias("tests")).distinct()
    return lists.select("instance_id", "kind", F.size("tests").alias("n"), F.concat_ws("|", "tests").alias("tests"))


def instance_validate(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "instances").dropDuplicates(["instance_id"])
    return once.select("instance_id", F.coalesce(scalars.instance_problem(scalars.string_list(F.col("fail_to_pass"))), F.lit("")).alias("problem"))


def repo_commit_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpora").select("corpus_id", scalars.valid_checkout(F.col("repo"), F.col("base_commit")).alias("valid"))


def _test_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lower(source) = 'test_log' and text is not null").select("doc_id", "repo", F.col("text").alias("log"))


def parse_pytest(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_pytest(_test_logs(spark, d), "doc_id")


def parse_gotest(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_gotest(_test_logs(spark, d), "doc_id")


def score_instance(spark: SparkSession, d: str) -> DataFrame:
    """Each instance's required tests against the statuses in its repository's logs (the worst one of a test counts)."""
    parsed = logs.parse_pytest(_test_logs(spark, d), "doc_id").unionByName(logs.parse_gotest(_test_logs(spark, d), "doc_id"))
    by_repo = parsed.join(_test_logs(spark, d).select("doc_id", "repo"), "doc_id").groupBy("repo", "test").agg(F.min("status").alias("status"))
    once = table(spark, d, "instances").dropDuplicates(["instance_id"])
    lists = once.select("instance_id", "repo", scalars.string_list(F.col("fail_to_pass")).alias("fail_to_pass"), scalars.string_list(F.col("pass_to_pass")).alias("pass_to_pass"))
    # The required tests meet the statuses of their own names only.
    required = lists.select("instance_id", "repo", F.explode(F.array_union("fail_to_pass", "pass_to_pass")).alias("test"))
    statuses = required.join(by_repo, ["repo", "test"]).select("instance_id", "test", "status")
    rows = logs.score_instances(lists, statuses)
    count = lambda m: F.size(F.filter(F.map_values(m), lambda s: s == "MISSING"))
    return rows.select("instance_id", "resolved", count("fail_to_pass").alias("f_missing"), count("pass_to_pass").alias("p_missing"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", diffs.cleaned_diff(F.col("raw")).alias("cleaned"))


def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("prediction_id", F.md5("cleaned").alias("digest"), F.char_length("cleaned").alias("n"))


def extract_diff(spark: SparkSession, d: str) -> DataFrame:
    # The cleaned text is its own projection, so that its fold isn't repeated for each use.
    rows = _cleaned(spark, d).select("prediction_id", diffs.extract_diff(F.col("cleaned")).alias("x"))
    return rows.select("prediction_id", F.md5(F.coalesce("x.diff", F.lit(""))).alias("digest"), F.coalesce("x.problem", F.lit("")).alias("problem"))


def fenced_block(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.coalesce("raw", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return table(spark, d, "predictions").select("prediction_id", F.md5(F.coalesce(diffs.fenced_block(t), F.lit("<none>"))).alias("digest"))


def recount_hunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where("model_patch <> ''").select("prediction_id", F.md5(diffs.recount_hunks(F.col("model_patch"))).alias("digest"))


def validate_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", F.coalesce(diffs.diff_problem(F.coalesce("model_patch", F.lit(""))), F.lit("")).alias("problem"))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    ranked = _lexical(spark, d, prompts.MAX_CHUNKS)
    ctx = ranked.select("query_id", "rank", "chunk_id").join(_chunks(spark, d), "chunk_id")
    reports = _instances(spark, d).select(F.col("instance_id").alias("query_id"), F.col("problem_statement").alias("text"))
    rows = prompts.user_messages(reports, ctx)
    return _public(rows, F.md5("message").alias("digest"), F.char_length("message").alias("n"))


def caps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.md5(text.cap_code_points(t, 100)).alias("query"), F.md5(text.cap_excerpt(t, 200)).alias("excerpt"),
    )


def cap_logs(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a run's log is stored: cut at a number of bytes."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(text.cap_bytes(F.col("text"))).alias("log"), F.md5(text.cap_bytes(F.col("text"), 1000)).alias("short"))


def render_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpora").select("corpus_id", prompts.system_prompts(F.col("repo"), TEMPLATE).alias("prompt"))


#: The canned reply of a provider without a model, whose key every system prompt holds, and the patch in it.
CANNED_PATCH = "--- a/src/main.py\n+++ b/src/main.py\n@@ -1,1 +1,1 @@\n-a\n+b\n"
CANNED = {"repository": f"Here it is:\n\n```diff\n{CANNED_PATCH}```\n"}


def mock_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The prediction plan over every instance: prompts, replies of a provider without a model, diffs, plausibility."""
    ctx = _lexical(spark, d, K).select("query_id", "rank", "chunk_id").join(_chunks(spark, d), "chunk_id")
    tasks = _instances(spark, d).select(F.col("instance_id").alias("query_id"), "repo", F.col("problem_statement").alias("text"))
    rows = predict.predictions(tasks, ctx, predict.mock_provider(CANNED), "mock")
    return rows.select(
        "instance_id", "model_name_or_path", F.md5("model_patch").alias("patch"), F.concat_ws("|", "changed_files").alias("changed"),
        F.concat_ws("|", "retrieved_files").alias("retrieved"), "plausible_hit", F.coalesce("err", F.lit("")).alias("err"),
    )


def embed_fresh(spark: SparkSession, d: str) -> DataFrame:
    """What a cached embedder adds to a cache that holds the texts of even items."""
    items = table(spark, d, "eval_items").where("text is not null")
    embedder = embedding.MockEmbedder()
    known = embedder.embed(items.where("item_id % 2 = 0")).select(vectors.cache_key(embedder.name, F.col("text")).alias("key"), "vec").dropDuplicates(["key"])
    embedded, fresh = embedding.embed_cached(items.select("item_id", "text"), known, embedder)
    return embedded.join(fresh.select("vec").distinct().withColumn("new", F.lit(True)), "vec", "left").select("item_id", F.size("vec").alias("dim"), F.coalesce("new", F.lit(False)).alias("new"))


def first_line_preview(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", text.first_line(F.col("content")).alias("preview"))


def stop_reason(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("stop_reason")
    rows = table(spark, d, "predictions").select(F.col("model_name_or_path").alias("model"), F.coalesce(scalars.normal_stop_reason(r), F.lit("")).alias("reason"), scalars.hit_ceiling(r).alias("truncated"))
    return rows.groupBy("model", "reason", "truncated").agg(F.count("*").alias("n"))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    failed = ~text.is_blank(F.col("err"))
    return table(spark, d, "predictions").groupBy(F.col("model_name_or_path").alias("model")).agg(
        F.count("*").alias("n"), F.count_if(~failed & (F.col("model_patch") != "")).alias("valid"),
        F.count_if(F.coalesce("plausible_hit", F.lit(False))).alias("plausible"), F.count_if(failed).alias("errored"),
    )


def backoff_delay(spark: SparkSession, d: str) -> DataFrame:
    ks = table(spark, d, "recall_results").select((F.col("k") % 9).alias("attempt"), (F.col("chunks_indexed") % 40).alias("asked")).distinct()
    return ks.select("attempt", "asked", scalars.backoff_delay(F.col("attempt"), 0.5, F.col("asked")).alias("delay"))


def retry_after(spark: SparkSession, d: str) -> DataFrame:
    """Any text may be in the header: versions, dates, words, blanks and padded numbers stand for it."""
    i, p = table(spark, d, "instances"), table(spark, d, "predictions")
    heads = i.select(F.col("repo_version").alias("header")).unionByName(i.select(F.date_format("created_at", "yyyy-MM-dd").alias("header")))
    for head in (F.col("output_tokens").cast("string"), F.col("stop_reason"), F.concat(F.lit(" "), F.col("input_tokens").cast("string"), F.lit(" ")), F.lit(" ")):
        heads = heads.unionByName(p.select(head.alias("header")))
    heads = heads.distinct()
    return heads.select("header", scalars.retry_after_seconds(F.col("header")).alias("seconds"))


def mock_reply(spark: SparkSession, d: str) -> DataFrame:
    canned = {"pagination": "one", "cach": "two", "token": "three"}
    t = F.col("problem_statement")
    return table(spark, d, "instances").dropDuplicates(["instance_id"]).select("instance_id", F.md5(scalars.mock_reply(t, F.col("repo"), canned)).alias("digest"))


def error_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", text.error_body(F.col("err")).alias("message"))


def predictions_rows(spark: SparkSession, d: str) -> DataFrame:
    """One line per attempted task, also with an empty patch: the three keys of the predictions file."""
    rows = table(spark, d, "predictions").select("prediction_id", F.to_json(F.struct("instance_id", "model_name_or_path", "model_patch")).alias("line"))
    back = F.from_json("line", "instance_id string, model_name_or_path string, model_patch string").alias("x")
    return rows.select("prediction_id", back).select("prediction_id", "x.instance_id", "x.model_name_or_path", F.md5("x.model_patch").alias("digest"))


def task_projection(spark: SparkSession, d: str) -> DataFrame:
    """What a predictor may see of an instance: no gold patch."""
    return table(spark, d, "instances").dropDuplicates(["instance_id"]).select("instance_id", "repo", "base_commit", F.md5("problem_statement").alias("statement"))


def queries() -> dict[str, Query]:
    named = [
        bm25_topk, bm25_scores, corpus_stats, term_freq, doc_freq, tokenize_terms, unique_terms, split_identifier, chunk_windows, config_defaults,
        cap_walk_order, skip_dirs, file_filters, semantic_topk, cosine_pairs, normalize_vec, mock_embed, cache_keys, cache_hits_misses, embed_batches,
        reply_order, rrf_hybrid_topk, changed_files, recall_at_k, recall_sweep, recall_summary, summarize, format_table, failed_rows, sorted_unique_ks,
        distinct_files, plausible_hit, parse_pytest, parse_gotest, score_instance, string_list, instance_validate, repo_commit_validate, scan_diff,
        extract_diff, fenced_block, recount_hunks, validate_diff, prompt_assembly, caps, first_line_preview, stop_reason, run_counters, backoff_delay,
        retry_after, cap_logs, render_template, mock_predictions, embed_fresh, mock_reply, error_bodies, predictions_rows, task_projection,
    ]
    out: dict[str, Query] = {f.__name__: f for f in named}
    shown = ("rank", "path", "start_line")
    for mode, name in (("oracle", "oracle_chunks"), ("file", "top_file_chunks"), ("none", "context_none")):
        out[name] = lambda spark, d, m=mode: _public(_context(m)(spark, d), *shown)
    return out


def oracle_sql() -> dict[str, str]:
    from tarnfold.oracles import SQL

    return SQL
