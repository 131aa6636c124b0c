"""``python -m tarnfold.commands search|recall|predict``: the plans as commands."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.diffs import changed_files
from tarnfold.functions.text import cap_code_points
from tarnfold.operators import chunking, context
from tarnfold.operators.config import ChunkConfig
from tarnfold.plans import predict, search
from tarnfold.session import cut, local_session
from tarnfold.sources import environment, files, repo_tree

CONTEXTS = ("retrieval", "file", "none", "oracle")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnfold")
    kinds = top.add_subparsers(dest="command", required=True)
    one, many, ask = (kinds.add_parser(n) for n in ("search", "recall", "predict"))
    for p in (one, many, ask):
        p.add_argument("-window", type=int, default=50)
        p.add_argument("-overlap", type=int, default=10)
    for p in (one, ask):
        p.add_argument("-mode", choices=search.MODES, default="lexical")
    for p in (many, ask):
        p.add_argument("-instances", required=True)
        p.add_argument("-limit", type=int, default=0, help="the first so many instances of the file; 0 is all")
        p.add_argument("-base-url", default=repo_tree.BASE_URL, help="where checkouts are fetched from")
        p.add_argument("-git-timeout", type=float, default=repo_tree.GIT_TIMEOUT)
    one.add_argument("-dir", default=".")
    one.add_argument("-q", required=True)
    one.add_argument("-k", type=int, default=5)
    many.add_argument("-modes", default="lexical")
    many.add_argument("-k", default="5,10,20")
    many.add_argument("-out", default="recall.json")
    ask.add_argument("-context", choices=CONTEXTS, default="retrieval")
    ask.add_argument("-k", type=int, default=10)
    ask.add_argument("-top-files", type=int, default=1)
    ask.add_argument("-max-tokens", type=int, default=4096)
    ask.add_argument("-temperature", type=float, default=0.0)
    ask.add_argument("-out", default="predictions")
    return top


def _windows(trees: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Chunks of read trees, with an id in walk order."""
    rows = chunking.chunk_windows(trees.where("content is not null"), ChunkConfig(args.window, args.overlap), keys=("corpus_id", "path"), content="content")
    return cut(rows.withColumn("chunk_id", F.xxhash64("corpus_id", "path", "start_line")))


def _checkouts(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(instances with corpus_id, chunks, failed checkouts)``."""
    instances = files.load_instances(spark, args.instances, args.limit).withColumn("corpus_id", F.concat_ws("@", "repo", "base_commit"))
    if instances.isEmpty():
        raise SystemExit("no instances")
    pairs = [(r.repo, r.base_commit) for r in instances.select("repo", "base_commit").distinct().toLocalIterator()]
    repo_tree.register(spark)
    reader = spark.read.format("repo_tree").option("checkouts", json.dumps(pairs)).option("baseUrl", args.base_url).option("timeoutSeconds", str(args.git_timeout))
    trees = cut(reader.load())
    return instances, _windows(trees, args), trees.where("error is not null").select("corpus_id", "error").distinct()


def run_search(spark: SparkSession, args: argparse.Namespace) -> None:
    repo_tree.register(spark)
    chunks = _windows(spark.read.format("repo_tree").option("path", args.dir).load(), args)
    embedder = environment.embedder(spark) if files.needs_embedder([args.mode]) else None
    asked = spark.createDataFrame([("q", "local", args.q)], "query_id string, corpus_id string, text string")
    rows = search.search(asked, chunks, args.k, args.mode, embedder).orderBy("rank").collect()
    for r in rows:
        print(f"{r.rank:2d}. {r.path}:{r.start_line}-{r.end_line}\n    {r.preview}")
    if not rows:
        print("(no matching chunks)")


def run_recall(spark: SparkSession, args: argparse.Namespace) -> None:
    modes, ks = files.split_csv(args.modes), files.parse_ints(args.k)
    if not modes:
        raise SystemExit("no modes given")
    embedder = environment.embedder(spark) if files.needs_embedder(modes) else None
    for mode in modes:
        search.ranker(mode, embedder)  # an unknown mode ends here, before anything is fetched
    instances, chunks, failed = _checkouts(spark, args)
    results, aggregates = search.recall_sweep(instances, chunks, modes, ks, embedder, failed=failed)
    results, aggregates = cut(results), cut(aggregates)
    print(files.format_summary(aggregates), file=sys.stderr)
    settings = {"modes": modes, "k": ks, "window": args.window, "overlap": args.overlap, "embedder": embedder.name if embedder else "", "instances": instances.count()}
    files.write_report(args.out, aggregates, results, settings)


def run_predict(spark: SparkSession, args: argparse.Namespace) -> None:
    provider, model = environment.provider(max_tokens=args.max_tokens, temperature=args.temperature)
    ranks = args.context in ("retrieval", "file")
    embedder = environment.embedder(spark) if ranks and files.needs_embedder([args.mode]) else None
    instances, chunks, _ = _checkouts(spark, args)
    tasks = instances.select(F.col("instance_id").alias("query_id"), "corpus_id", "repo", F.col("problem_statement").alias("text"))
    queries = tasks.withColumn("text", cap_code_points(F.col("text"), 4000))
    gold = instances.select(F.col("instance_id").alias("query_id"), "corpus_id", F.explode(changed_files(F.col("patch"))).alias("path"))
    empty = spark.createDataFrame([], "query_id string, rank int, corpus_id string, chunk_id bigint, path string, start_line int, score double")
    pool = context.pool_size(args.k) if args.context == "file" else args.k
    ranked = search.ranker(args.mode, embedder)(queries, chunks, pool) if ranks else empty
    picked = context.context_chunks(args.context, args.k, ranked, chunks, gold, args.top_files).select("query_id", "rank", "chunk_id")
    shown = picked.join(chunks, "chunk_id").select("query_id", "rank", "path", "start_line", "end_line", "content")
    rows = cut(predict.predictions(tasks, shown, provider, model))
    files.write_predictions(rows, args.out, "instance_id")
    print(predict.counters(rows).first().asDict(), file=sys.stderr)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    {"search": run_search, "recall": run_recall, "predict": run_predict}[args.command](spark or local_session("*"), args)


if __name__ == "__main__":
    main()
