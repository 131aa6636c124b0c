import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tarnfold import commands
from tarnfold.operators import chunking
from tarnfold.operators.config import ChunkConfig
from tarnfold.plans import evaluate, search
from tarnfold.sources import endpoints, environment, files, repo_tree


def tree(root, entries):
    for path, data in entries.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_skips_what_it_should(spark, tmp_path):
    tree(tmp_path, {"a.go": "ln\n" * 60, "one.txt": "1\n2\n3", "bin.dat": b"ok\0more", "big.txt": "x" * 1500, ".git/config": "x", "node_modules/dep/x.js": "x", "_p/__init__.py": "y", ".env": "z"})
    (tmp_path / "link.txt").symlink_to(tmp_path / "one.txt")
    repo_tree.register(spark)
    got = spark.read.format("repo_tree").option("maxFileBytes", 1000).option("path", str(tmp_path)).load()
    assert sorted(r.path for r in got.collect()) == [".env", "_p/__init__.py", "a.go", "one.txt"]
    windows = chunking.chunk_windows(got, ChunkConfig(20, 5)).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in windows}["a.go"] >= 2


def git(folder, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=folder, check=True, capture_output=True)


def test_git_checkout_to_recall(spark, tmp_path):
    work = tmp_path / "acme" / "calc.git"
    tree(work, {"calc.py": "def divide_numbers(a, b):\n    return a / b\n", "other.py": "pass\n"})
    git(work, "init", "-q")
    git(work, "add", ".")
    git(work, "commit", "-qm", "x")
    commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=work, capture_output=True, text=True).stdout.strip()
    repo_tree.register(spark)
    scan = spark.read.format("repo_tree").option("checkouts", json.dumps([["acme/calc", commit], ["-bad/x", commit], ["acme/none", commit]])).option("baseUrl", f"file://{tmp_path}/").load()
    rows = scan.collect()
    assert sorted(r.path for r in rows if r.path) == ["calc.py", "other.py"] and sum(r.error is not None for r in rows) == 2
    chunks = chunking.chunk_windows(scan.where("path is not null")).selectExpr("*", "xxhash64(path, start_line) as chunk_id")
    inst = spark.createDataFrame([("i", f"acme/calc@{commit}", "divide_numbers fails", "+++ b/calc.py"), ("l", "gone", "x", "+++ b/y")], "instance_id string, corpus_id string, problem_statement string, patch string")
    results, table = search.recall_sweep(inst, chunks, ["lexical"], [5, 5, 0])
    assert {r.query_id: (r.recall_at_k, r.error) for r in results.collect()} == {"i": (1.0, None), "l": (0.0, "no chunks")}
    assert files.format_summary(table).count("\n") == 1
    files.write_report(str(tmp_path / "r.json"), table, results, {"k": [5, 5, 0]})
    assert json.loads((tmp_path / "r.json").read_text())["aggregates"][0]["n"] == 1


def test_commands_run_over_checkouts(spark, tmp_path, capsys, monkeypatch):
    work = tmp_path / "acme" / "calc.git"
    work.mkdir(parents=True)
    (work / "calc.py").write_text("def divide(numbers):\n    return numbers\n")
    (work / "other.py").write_text("x = 1\n")
    for step in (["init", "-q"], ["config", "user.email", "a@b.test"], ["config", "user.name", "a"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run(["git", *step], cwd=work, check=True)
    commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=work, capture_output=True, text=True).stdout.strip()
    rows = [{**GOOD, "instance_id": i, "repo": "acme/calc", "base_commit": c, "problem_statement": "divide numbers fails", "patch": "+++ b/calc.py"} for i, c in (("a", commit), ("b", "0" * 40), ("c", commit))]
    path = tmp_path / "i.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    common = ["-instances", str(path), "-base-url", f"file://{tmp_path}/"]
    commands.main(["recall", *common, "-limit", "2", "-k", "5", "-out", str(tmp_path / "r.json")], spark)
    report = json.loads((tmp_path / "r.json").read_text())
    by_id = {r["query_id"]: r for r in report["results"]}
    assert set(by_id) == {"a", "b"} and by_id["a"]["recall_at_k"] == 1.0 and by_id["b"]["error"] and report["aggregates"][0]["errors"] == 1
    monkeypatch.setenv("LLM_PROVIDER", "mock")
    commands.main(["predict", *common, "-out", str(tmp_path / "p")], spark)
    assert spark.read.text(str(tmp_path / "p")).count() == 3
    commands.main(["search", "-dir", str(work), "-q", "divide"], spark)
    assert "calc.py:1-3" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        commands.main(["search", "-dir", "."], spark)


def test_providers_of_the_environment(spark):
    assert environment.provider({})[1] == "mock" and environment.provider({"LLM_PROVIDER": " OpenAI ", "OPENAI_API_KEY": "k"})[1] == "gpt-4o"
    assert environment.provider({"LLM_PROVIDER": "ollama", "LLM_MODEL": "m"})[1] == "m"
    for bad in ({"LLM_PROVIDER": "anthropic"}, {"LLM_PROVIDER": "openai"}, {"LLM_PROVIDER": "x"}):
        with pytest.raises(ValueError):
            environment.provider(bad)
    e = environment.embedder(spark, {"OPENAI_API_KEY": "k", "EMBED_BASE_URL": "http://h/v1/", "EMBED_CACHE": "c"})
    assert (e.inner.url, e.name, e.cache, e.inner.headers) == ("http://h/v1/embeddings", "text-embedding-3-small", "c", {"authorization": "Bearer k"})


def test_lines_have_a_cap(spark, tmp_path, monkeypatch):
    path = tmp_path / "d.jsonl"
    path.write_text(json.dumps({**GOOD, "problem_statement": "p" * 500}) + "\n" + json.dumps(GOOD))
    assert files.load_instances(spark, str(path), 1).count() == 1
    monkeypatch.setattr(files, "LINE_CAP", 400)
    with pytest.raises(Exception, match="more than 400 bytes"):
        files.load_instances(spark, str(path)).collect()


GOOD = {"instance_id": "a", "repo": "x/y", "base_commit": "deadbeef", "problem_statement": "p", "patch": "", "test_patch": "t", "FAIL_TO_PASS": ["t::a"], "PASS_TO_PASS": []}


@pytest.mark.parametrize("array", [True, False])
def test_load_instances(spark, tmp_path, array):
    rows = [GOOD, {**GOOD, "instance_id": "b", "FAIL_TO_PASS": '["t::c"]', "extra": 1}]
    path = tmp_path / "d.json"
    path.write_text(" \n" + json.dumps(rows, indent=1) if array else "\n".join(json.dumps(r) for r in rows) + "\n\n")
    got = {r.instance_id: r.fail_to_pass for r in files.load_instances(spark, str(path)).collect()}
    assert got == {"a": ["t::a"], "b": ["t::c"]}


def test_load_instances_fails_loudly(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({**GOOD, "repo": " "}))
    with pytest.raises(Exception, match="missing repo"):
        files.load_instances(spark, str(path)).collect()
    path.write_text(" \n")
    with pytest.raises(ValueError, match="empty"):
        files.load_instances(spark, str(path))


def test_predictions_cache_and_flags(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "m", None), (1, "a", "m", "x<y>")], "ord int, instance_id string, model_name_or_path string, model_patch string")
    files.write_predictions(rows, str(tmp_path / "p"), "ord")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert lines == [{"instance_id": "a", "model_name_or_path": "m", "model_patch": "x<y>"}, {"instance_id": "b", "model_name_or_path": "m", "model_patch": ""}]
    assert files.load_cache(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.json").write_text('{"k": [1, 2, 3]}')
    cache = files.load_cache(spark, str(tmp_path / "c.json"))
    files.save_cache(cache, str(tmp_path / "cache"))
    assert files.load_cache(spark, str(tmp_path / "cache")).first().vec == [1.0, 2.0, 3.0]
    assert files.split_csv(" a, ,b") == ["a", "b"] and files.parse_ints("5, 10") == [5, 10] and files.env_int("N", 3, {"N": "-1"}) == 3
    assert files.needs_embedder(["hybrid"]) and not files.needs_embedder(["lexical"]) and "{{.Repo}}" in files.load_template()
    with pytest.raises(ValueError):
        files.parse_ints(",")


class Stub(BaseHTTPRequestHandler):
    plan: list = []
    calls = 0

    def do_POST(self):
        type(self).calls += 1
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        status, reply = self.plan.pop(0) if self.plan else (200, None)
        if reply is None and "input" in body:
            reply = {"data": [{"index": i, "embedding": [3.0, float(i), 4.0]} for i in reversed(range(len(body["input"])))]}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(reply or {"content": [{"text": "ok"}], "stop_reason": "end_turn", "usage": {"input_tokens": 1, "output_tokens": 2}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def stub():
    Stub.plan, Stub.calls = [], 0
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_provider_retries(stub):
    e = endpoints.Endpoint(stub, "m", backoff=0.0)
    Stub.plan = [(429, {}), (429, {})]
    assert e.generate("s", "u") == ("ok", "end_turn", 1, 2) and Stub.calls == 3
    Stub.plan, Stub.calls = [(503, {})] * 9, 0
    with pytest.raises(RuntimeError, match="503"):
        e.generate("s", "u")
    assert Stub.calls == 5
    Stub.plan, Stub.calls = [(400, {"error": "billing"})], 0
    with pytest.raises(RuntimeError, match="billing"):
        e.generate("s", "u")
    assert Stub.calls == 1
    Stub.plan = [(200, {"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}]})]
    assert endpoints.Endpoint(stub, "m", "completions").generate("s", "u")[:2] == ("hi", "max_tokens")


def test_generation_and_embedding_over_http(spark, stub):
    prompts = spark.createDataFrame([("q", "s", "u")], "query_id string, system string, message string")
    assert endpoints.generate(prompts, endpoints.Endpoint(stub, "m")).first().raw == "ok"
    texts = spark.createDataFrame([(i, str(i)) for i in range(130)], "i int, text string").coalesce(1)
    Stub.calls = 0
    got = {r.i: r.vec for r in endpoints.HttpEmbedder(stub, "m").embed(texts).collect()}
    assert Stub.calls == 2 and got[0] == pytest.approx([0.6, 0.0, 0.8]) and len(got) == 130


def test_apply_run_score(spark, tmp_path):
    fix = "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-x = 1\n+x = 2\n"
    held = "--- /dev/null\n+++ b/t.txt\n@@ -0,0 +1 @@\n+t\n"
    for name in ("gold", "empty", "garbage"):
        tree(tmp_path / name, {"m.py": "x = 1\n"})
        git(tmp_path / name, "init", "-q")
    rows = [("gold", str(tmp_path / "gold"), fix, held), ("empty", str(tmp_path / "empty"), "", held), ("garbage", str(tmp_path / "garbage"), "nonsense", held)]
    cases = spark.createDataFrame(rows, "instance_id string, folder string, model_patch string, test_patch string")
    runs = evaluate.run_candidates(cases, ["sh", "-c", "grep -q 2 m.py && echo 't.py::fix PASSED' || { echo 't.py::fix FAILED'; exit 1; }"]).persist()
    inst = spark.createDataFrame([(n, ["t.py::fix"], []) for n in ("gold", "empty", "garbage")], "instance_id string, fail_to_pass array<string>, pass_to_pass array<string>")
    got = {r.instance_id: r for r in evaluate.outcomes(inst, runs).collect()}
    assert {k: (r.resolved, r.patch_applied) for k, r in got.items()} == {"gold": (True, True), "empty": (False, True), "garbage": (False, False)}
    assert evaluate.run_command(str(tmp_path), ["/no/such"])[1] and evaluate.run_command(str(tmp_path), [])[1]
