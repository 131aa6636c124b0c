"""SQL of the driver queries, for another engine."""

from __future__ import annotations

from tarnfold.functions.text import SPACE
from tarnfold.sources.files import TEMPLATE

NB = f"[^{SPACE}]"
TRIM = f"^[{SPACE}]+|[{SPACE}]+$"


def _byte_cut(text: str, most: int) -> str:
    """The first bytes of a text; a character cut in two becomes one replacement character."""
    head = [f"try(decode(encode({text})[1:{most - k}]))" for k in range(4)]
    return f"coalesce({head[0]}, {', '.join(h + ' || chr(65533)' for h in head[1:])})"


def _terms(column: str) -> str:
    """List of terms of a text: words with part breaks as spaces, then the whole word before its parts."""
    marked = f"regexp_extract_all({column}, '[\\p{{L}}\\p{{Nd}}]+')"
    parts = "w"
    for a, b in ((r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{Nd})(\p{L})", r"\1 \2"), (r"(\p{L})(\p{Nd})", r"\1 \2")):
        parts = f"regexp_replace({parts}, '{a}', '{b}', 'g')"
    split = f"string_split({parts}, ' ')"
    return (
        f"flatten(list_transform({marked}, lambda w: CASE WHEN len({split}) > 1 "
        f"THEN list_prepend(lower(w), list_transform({split}, lambda p: lower(p))) ELSE [lower(w)] END))"
    )


CHUNKS = """ch AS (SELECT chunk_id, corpus_id, path, start_line, end_line, content FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus_id, path, start_line ORDER BY chunk_id) AS rn FROM chunks WHERE content IS NOT NULL) WHERE rn = 1)"""
ONCE = "once AS (SELECT DISTINCT ON (instance_id) * FROM instances)"
INST = f"{ONCE}, inst AS (SELECT o.*, c.corpus_id FROM once o JOIN corpora c ON c.repo = o.repo AND c.base_commit = o.base_commit)"
TOK = f"tok AS (SELECT corpus_id, chunk_id, {_terms('content')} AS t FROM ch)"
STATS = "stats AS (SELECT corpus_id, count(*) AS n, avg(len(t)) AS avg_dl FROM tok GROUP BY 1)"
POST = "post AS (SELECT corpus_id, chunk_id, dl, term, count(*) AS f FROM (SELECT corpus_id, chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL)"
DF = "dfq AS (SELECT corpus_id, term, count(*) AS df FROM post GROUP BY 1, 2)"
QT = f"""qt AS (SELECT instance_id, corpus_id, term, min(pos) AS pos FROM (SELECT instance_id, corpus_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
  FROM (SELECT instance_id, corpus_id, {_terms('substring(problem_statement, 1, 4000)')} AS t FROM inst)) GROUP BY 1, 2, 3)"""
SCORE = """sc AS (SELECT instance_id, chunk_id, sum(p ORDER BY pos) AS score FROM (
  SELECT q.instance_id, p.chunk_id, q.pos, ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl)) AS p
  FROM post p JOIN dfq USING (corpus_id, term) JOIN stats USING (corpus_id) JOIN qt q USING (corpus_id, term)) GROUP BY 1, 2)"""
LEX = f"""lex AS (SELECT instance_id, chunk_id, path, start_line, round(score, 9) AS score,
  row_number() OVER (PARTITION BY instance_id ORDER BY round(score, 9) DESC, path, start_line) AS rank FROM sc JOIN ch USING (chunk_id))"""
BM25 = ", ".join((CHUNKS, INST, TOK, STATS, POST, DF, QT, SCORE, LEX))


def _changed(column: str) -> str:
    first = f"string_split(regexp_replace(substr(l, 5), '{TRIM}', '', 'g'), chr(9))[1]"
    lines = f"list_filter(string_split(coalesce({column}, ''), chr(10)), lambda l: starts_with(l, '+++ '))"
    raw = f"list_filter(list_transform({lines}, lambda l: {first}), lambda p: p <> '' AND p <> '/dev/null')"
    return f"list_sort(list_distinct(list_transform({raw}, lambda p: regexp_replace(p, '^b/', ''))))"


GOLD = f"gold AS (SELECT instance_id, corpus_id, unnest({_changed('patch')}) AS path FROM inst)"
WALK = "row_number() OVER (PARTITION BY instance_id ORDER BY string_split(path, '/'), start_line)"
LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, retrieval_mode, k
  ORDER BY run_at DESC, recall_at_k DESC, error DESC NULLS LAST) AS rn FROM recall_results) WHERE rn = 1)"""
OK = f"NOT coalesce(regexp_matches(error, '{NB}'), false)"
SUMMARY = f"""SELECT retrieval_mode AS mode, k, count(*) FILTER ({OK}) AS n, count(*) FILTER (NOT ({OK})) AS errors,
  round(coalesce(avg(recall_at_k) FILTER ({OK}), 0.0), 6) AS mean_recall, round(coalesce(avg(full_hit::INT) FILTER ({OK}), 0.0), 6) AS full_hit_rate
  FROM latest GROUP BY 1, 2"""
_REC = "len(list_intersect(list_distinct(coalesce(changed_files, [])), coalesce(retrieved_files, []))) / len(list_distinct(changed_files))"
RECALL = f"CASE WHEN len(coalesce(changed_files, [])) > 0 THEN {_REC} ELSE 0.0 END"
SWEEP = f"""tasks AS (SELECT instance_id, {_changed('patch')} AS changed_files FROM inst),
  sw AS (SELECT t.instance_id, k, changed_files, coalesce(list_distinct(list(path) FILTER (rank <= k)), []) AS retrieved_files
    FROM tasks t CROSS JOIN (VALUES (5), (10), (20)) v(k) LEFT JOIN lex l ON l.instance_id = t.instance_id GROUP BY 1, 2, 3)"""
HDR = r"^(?:diff --git |index |--- |\+\+\+ |new file mode|deleted file mode|old mode |new mode |rename from |rename to |copy from |copy to |similarity index |dissimilarity index |Binary files |GIT binary patch)"
RAW = "replace(coalesce(raw, ''), chr(13) || chr(10), chr(10))"
FENCE = """fence AS (SELECT prediction_id, s, CASE WHEN f > 0 AND contains(r, chr(10)) THEN string_split(substr(r, strpos(r, chr(10)) + 1), '```')[1] END AS inner_
  FROM (SELECT *, substr(s, f + 3) AS r FROM (SELECT prediction_id, s, strpos(s, '```') AS f FROM raws)))"""
LIKE = "(contains(inner_, 'diff --git ') OR contains(inner_, '--- ') OR contains(inner_, '@@'))"
CLEAN = f"""raws AS (SELECT prediction_id, {RAW} AS s FROM predictions), {FENCE},
  body AS (SELECT prediction_id, CASE WHEN inner_ IS NOT NULL AND {LIKE} THEN inner_ ELSE s END AS s FROM fence),
  cut_ AS (SELECT prediction_id, CASE WHEN regexp_matches(s, '(?m)^(?:diff --git |--- )') THEN regexp_extract(s, '(?ms)^(?:diff --git |--- ).*') ELSE s END AS s FROM body),
  ln_ AS (SELECT prediction_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT prediction_id, string_split(s, chr(10)) AS l FROM cut_)),
  ev AS (SELECT *, CASE WHEN starts_with(line, '@@') THEN 1 WHEN regexp_matches(line, '{HDR}') THEN 0 END AS e FROM ln_),
  st AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY prediction_id ORDER BY pos), 0) AS h FROM ev),
  ok AS (SELECT *, sum(CASE WHEN e IS NULL AND NOT (h = 1 AND (line = '' OR regexp_matches(line, '^[ +\\-\\\\]'))) THEN 1 ELSE 0 END) OVER (PARTITION BY prediction_id ORDER BY pos) AS bad FROM st),
  kept AS (SELECT prediction_id, pos, e, CASE WHEN e IS NULL AND line = '' THEN ' ' ELSE line END AS line FROM ok WHERE bad = 0),
  trimmed AS (SELECT k.* FROM kept k JOIN (SELECT prediction_id, max(pos) AS m FROM kept WHERE regexp_matches(line, '{NB}') GROUP BY 1) USING (prediction_id) WHERE pos <= m),
  clean AS (SELECT p.prediction_id, coalesce(c.s, '') AS s FROM predictions p LEFT JOIN (SELECT prediction_id, string_agg(line, chr(10) ORDER BY pos) AS s FROM trimmed GROUP BY 1) c USING (prediction_id))"""
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)$"


def _recount(source: str) -> str:
    """CTEs that recount hunks of ``source(prediction_id, s)`` into ``counted(prediction_id, s)``."""
    return f"""rl AS (SELECT prediction_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT prediction_id, string_split(s, chr(10)) AS l FROM {source})),
  rb AS (SELECT *, (starts_with(line, '@@') OR regexp_matches(line, '{HDR}')) AS brk FROM rl),
  rs AS (SELECT *, sum(brk::INT) OVER (PARTITION BY prediction_id ORDER BY pos) AS seg FROM rb),
  rc AS (SELECT *, sum(CASE WHEN NOT brk AND (line = '' OR line[1] IN (' ', '-')) THEN 1 ELSE 0 END) OVER (PARTITION BY prediction_id, seg) AS o,
    sum(CASE WHEN NOT brk AND (line = '' OR line[1] IN (' ', '+')) THEN 1 ELSE 0 END) OVER (PARTITION BY prediction_id, seg) AS nw FROM rs),
  counted AS (SELECT prediction_id, string_agg(CASE WHEN regexp_matches(line, '{HUNK}') THEN '@@ -' || regexp_extract(line, '{HUNK}', 1) || ',' || o::BIGINT || ' +' ||
    regexp_extract(line, '{HUNK}', 2) || ',' || nw::BIGINT || ' @@' || regexp_extract(line, '{HUNK}', 3) ELSE line END, chr(10) ORDER BY pos) AS s FROM rc GROUP BY 1)"""


def _problem(s: str) -> str:
    minus = f"(starts_with({s}, '--- ') OR contains({s}, chr(10) || '--- '))"
    plus = f"(starts_with({s}, '+++ ') OR contains({s}, chr(10) || '+++ '))"
    return (
        f"CASE WHEN NOT (contains({s}, 'diff --git ') OR ({minus} AND {plus})) THEN 'output is not a unified diff (missing file headers)' "
        f"WHEN NOT contains({s}, '@@') THEN 'output is not a unified diff (no @@ hunk header)' END"
    )


def _list(column: str) -> str:
    inner = f"CASE WHEN starts_with(trim({column}), '\"') THEN json_extract_string({column}::JSON, '$') ELSE {column} END"
    return f"CASE WHEN {inner} IS NULL OR NOT regexp_matches({inner}, '{NB}') OR trim({inner}) = 'null' THEN [] ELSE from_json(({inner})::JSON, '[\"VARCHAR\"]') END"


def _mock(text: str) -> str:
    raw = f"list_transform(range(0, 64), lambda j: ('0x' || substr(sha256({text} || '#' || chr(j::INT)), 1, 4))::INT)"
    signed = f"list_transform({raw}, lambda u: ((CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) / 32768.0)::FLOAT)"
    return signed


FIELDS = f"list_filter(regexp_split_to_array(line, '[{SPACE}]+'), lambda x: x <> '')"
LOGS = "lg AS (SELECT doc_id, repo, text AS log FROM documents WHERE lower(source) = 'test_log' AND text IS NOT NULL)"
LOGLINES = "ll AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(log, chr(10)) AS l FROM lg))"
PYTEST = f"""py AS (SELECT doc_id, test, arg_min(status, pos) AS status FROM (SELECT doc_id, pos,
  list_filter(f, lambda x: contains(x, '::') OR ends_with(x, '.py'))[1] AS test,
  list_filter(list_transform(f, lambda x: rtrim(x, ':')), lambda x: x IN ('PASSED', 'FAILED', 'ERROR', 'SKIPPED'))[1] AS status
  FROM (SELECT doc_id, pos, {FIELDS} AS f FROM ll)) WHERE test IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2)"""
GOTEST = f"""go_ AS (SELECT doc_id, test, arg_max(status, pos) AS status FROM (SELECT doc_id, pos,
  CASE regexp_extract(t, '^--- (\\w+):', 1) WHEN 'PASS' THEN 'PASSED' WHEN 'FAIL' THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  list_filter(regexp_split_to_array(regexp_replace(t, '^[^:]*:', ''), '[{SPACE}]+'), lambda x: x <> '')[1] AS test
  FROM (SELECT doc_id, pos, regexp_replace(line, '{TRIM}', '', 'g') AS t FROM ll) WHERE regexp_matches(t, '^--- (?:PASS|FAIL|SKIP):')) WHERE test IS NOT NULL GROUP BY 1, 2)"""
UNIT = "list_transform(v, lambda x: (x * (1.0 / sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)::FLOAT)"
KEY = "sha256('mock-64' || chr(0) || content)"
SEM = f"""qv AS (SELECT instance_id, corpus_id, {_mock("substring(problem_statement, 1, 4000)")} AS q FROM inst),
  cv AS (SELECT chunk_id, corpus_id, path, start_line, {_mock("content")} AS v FROM ch),
  qn AS (SELECT instance_id, corpus_id, {UNIT.replace('(v,', '(q,')} AS q FROM qv), cn AS (SELECT chunk_id, corpus_id, path, start_line, {UNIT} AS v FROM cv),
  ss AS (SELECT instance_id, chunk_id, path, start_line, round(list_cosine_similarity(q::DOUBLE[], v::DOUBLE[]), 9) AS score FROM qn JOIN cn USING (corpus_id)),
  sem AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, path, start_line) AS rank FROM ss)"""

SQL = {
    "bm25_topk": f"WITH {BM25} SELECT instance_id, rank, path, start_line, score FROM lex WHERE rank <= 10",
    "bm25_scores": f"WITH {BM25} SELECT instance_id, chunk_id, round(score, 6) AS score FROM sc",
    "corpus_stats": f"WITH {CHUNKS}, {TOK} SELECT corpus_id, count(*) AS n, round(avg(len(t)), 6) AS avg_dl FROM tok GROUP BY 1",
    "term_freq": f"WITH {CHUNKS}, {TOK}, {POST} SELECT chunk_id, dl, count(*) AS terms, sum(f)::BIGINT AS tokens, max(f) AS most FROM post GROUP BY 1, 2",
    "doc_freq": f"WITH {CHUNKS}, {TOK}, {POST}, {DF} SELECT corpus_id, term, df FROM dfq",
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY 1, 2",
    "unique_terms": f"""WITH {ONCE}, t AS (SELECT instance_id, {_terms('problem_statement')} AS t FROM once),
        u AS (SELECT instance_id, term, min(pos) AS pos FROM (SELECT instance_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM t) GROUP BY 1, 2)
        SELECT o.instance_id, md5(coalesce(string_agg(term, ' ' ORDER BY pos), '')) AS digest, count(term)::INT AS n FROM once o LEFT JOIN u USING (instance_id) GROUP BY 1""",
    "split_identifier": """SELECT word, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '([a-z])([A-Z])', '\\1 \\2', 'g'),
        '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), ' ', '|') AS parts
        FROM (SELECT DISTINCT regexp_extract(path, '([A-Za-z0-9]+)\\.[a-z]+$', 1) AS word FROM chunks) WHERE word <> ''""",
    "chunk_windows": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, l, unnest(range(0, (ceil(greatest(0, len(l) - 5) / 4.0) * 4)::BIGINT + 1, 4)) AS a FROM l),
        w AS (SELECT doc_id, (a + 1)::INT AS start_line, least(a + 5, len(l))::INT AS end_line, array_to_string(l[a + 1:least(a + 5, len(l))], chr(10)) AS c FROM s)
        SELECT doc_id, start_line, end_line, md5(c) AS digest FROM w WHERE regexp_matches(c, '{NB}')""",
    "config_defaults": """SELECT corpus_id, w::INT AS window, (CASE WHEN o >= 0 AND o < w THEN o ELSE w // 5 END)::INT AS overlap FROM (
        SELECT corpus_id, CASE WHEN window_lines > 0 THEN window_lines ELSE 50 END AS w, coalesce(overlap_lines, 0) AS o FROM corpora)""",
    "cap_walk_order": f"WITH {CHUNKS} SELECT corpus_id, path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY string_split(path, '/'), start_line) AS rn FROM ch) WHERE rn <= 50",
    "skip_dirs": """SELECT DISTINCT corpus_id, path FROM chunks WHERE NOT regexp_matches(path, '(?:^|/)(?:\\.git|node_modules|vendor|\\.venv|venv|__pycache__|\\.mypy_cache|\\.pytest_cache|\\.tox|\\.idea|\\.vscode)/')""",
    "file_filters": "SELECT doc_id, strlen(text) > 1048576 AS too_large, contains(text, chr(0)) AS is_binary FROM documents WHERE text IS NOT NULL",
    "semantic_topk": """WITH v AS (SELECT vec_id, vec::DOUBLE[] AS v FROM chunk_vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "cosine_pairs": """SELECT a.vec_id, b.vec_id AS other_id, CASE WHEN len(a.vec) = len(b.vec) AND len(a.vec) > 0 AND list_sum(list_transform(a.vec, lambda x: abs(x))) > 0
        AND list_sum(list_transform(b.vec, lambda x: abs(x))) > 0 THEN round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) ELSE 0.0 END AS cosine
        FROM chunk_vectors a JOIN chunk_vectors b ON b.vec_id = a.vec_id + 1""",
    "normalize_vec": f"""SELECT vec_id, (generate_subscripts(u, 1) - 1)::INT AS i, round(unnest(u)::DOUBLE, 5) AS x FROM (SELECT vec_id,
        CASE WHEN list_sum(list_transform(v, lambda x: abs(x))) > 0 THEN {UNIT} ELSE v END AS u FROM (SELECT vec_id, vec AS v FROM chunk_vectors WHERE len(vec) > 0))""",
    "mock_embed": f"""SELECT item_id, (generate_subscripts(u, 1) - 1)::INT AS i, round(unnest(u)::DOUBLE, 5) AS x FROM (SELECT item_id, {UNIT} AS u FROM (SELECT item_id, {_mock('text')} AS v FROM eval_items))""",
    "cache_keys": f"WITH {CHUNKS} SELECT chunk_id, {KEY} AS key FROM ch",
    "cache_hits_misses": f"""WITH {CHUNKS}, k AS (SELECT corpus_id, chunk_id, {KEY} AS key FROM ch), c AS (SELECT DISTINCT key FROM k WHERE chunk_id IN (SELECT chunk_id FROM chunk_vectors))
        SELECT corpus_id, count(c.key) AS hits, count(*) FILTER (c.key IS NULL) AS misses FROM (SELECT DISTINCT corpus_id, key FROM k) d LEFT JOIN c ON c.key = d.key GROUP BY 1""",
    "embed_batches": f"""WITH {CHUNKS}, n AS (SELECT corpus_id, key, row_number() OVER (PARTITION BY corpus_id ORDER BY key) - 1 AS n FROM (SELECT DISTINCT corpus_id, {KEY} AS key FROM ch))
        SELECT corpus_id, (n // 128)::INT AS batch, count(*) AS texts, max(n % 128)::INT AS last_index, min(key) AS first_key FROM n GROUP BY 1, 2""",
    "reply_order": "SELECT model_name, embedded_at, string_agg(vec_id::VARCHAR, ',' ORDER BY reply_no, vec_id) AS vec_ids FROM chunk_vectors WHERE reply_no IS NOT NULL GROUP BY 1, 2",
    "rrf_hybrid_topk": f"""WITH {BM25}, {SEM}, u AS (SELECT instance_id, path, start_line, 1.0 / (60 + rank) AS p, 0 AS part FROM lex WHERE rank <= 50
          UNION ALL SELECT instance_id, path, start_line, 1.0 / (60 + rank), 1 FROM sem WHERE rank <= 50),
        f AS (SELECT instance_id, path || ':' || start_line AS key, any_value(path) AS path, any_value(start_line) AS start_line, round(sum(p ORDER BY part), 12) AS score FROM u GROUP BY 1, 2)
        SELECT instance_id, rank, path, start_line, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, key) AS rank FROM f) WHERE rank <= 10""",
    "changed_files": f"WITH {ONCE} SELECT instance_id, array_to_string({_changed('patch')}, '|') AS files FROM once",
    "recall_at_k": f"WITH {LATEST} SELECT instance_id, retrieval_mode AS mode, k, round({RECALL}, 6) AS recall_at_k, len(coalesce(changed_files, [])) > 0 AND ({RECALL}) = 1.0 AS full_hit FROM latest",
    "recall_sweep": f"WITH {BM25}, {SWEEP} SELECT instance_id, 'lexical' AS mode, k, len(retrieved_files)::INT AS n_files, round({RECALL}, 6) AS recall_at_k, len(changed_files) > 0 AND ({RECALL}) = 1.0 AS full_hit FROM sw",
    "recall_summary": f"""WITH {BM25}, {SWEEP}, r AS (SELECT k, {RECALL} AS r, len(changed_files) > 0 AND ({RECALL}) = 1.0 AS h FROM sw)
        SELECT 'lexical' AS mode, k, count(*) AS n, 0::BIGINT AS errors, round(avg(r), 6) AS mean_recall, round(avg(h::INT), 6) AS full_hit_rate FROM r GROUP BY k""",
    "summarize": f"WITH {LATEST} {SUMMARY}",
    "format_table": f"WITH {LATEST}, s AS ({SUMMARY}) SELECT printf('%-10s %4d %4d %8d %12.3f %12.3f', mode, k, n, errors, mean_recall, full_hit_rate) AS line FROM s",
    "failed_rows": f"""WITH {ONCE} SELECT instance_id, mode, k, 0.0::DOUBLE AS recall_at_k, false AS full_hit, 'checkout failed' AS error FROM once o
        CROSS JOIN (VALUES ('lexical'), ('semantic')) m(mode) CROSS JOIN (VALUES (5), (10), (20)) v(k)
        WHERE NOT EXISTS (SELECT 1 FROM corpora c WHERE c.repo = o.repo AND c.base_commit = o.environment_setup_commit)""",
    "sorted_unique_ks": "SELECT instance_id, coalesce(array_to_string(list_sort(list_distinct(list(k) FILTER (k > 0))), ','), '10') AS ks FROM recall_results GROUP BY 1",
    "distinct_files": f"WITH {BM25} SELECT instance_id, string_agg(path, '|' ORDER BY r) AS files FROM (SELECT instance_id, path, min(rank) AS r FROM lex WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1",
    "plausible_hit": "SELECT prediction_id, coalesce(list_has_any(changed_files, retrieved_files), false) AS hit FROM predictions",
    "oracle_chunks": f"WITH {CHUNKS}, {INST}, {GOLD}, r AS (SELECT instance_id, path, start_line, {WALK} AS rank FROM ch JOIN (SELECT DISTINCT * FROM gold) USING (corpus_id, path)) SELECT instance_id, rank, path, start_line FROM r WHERE rank <= 10",
    "top_file_chunks": f"""WITH {BM25}, top_ AS (SELECT instance_id, corpus_id, path FROM lex JOIN inst USING (instance_id) WHERE rank = 1),
        r AS (SELECT instance_id, path, start_line, {WALK} AS rank FROM ch JOIN top_ USING (corpus_id, path)) SELECT instance_id, rank, path, start_line FROM r WHERE rank <= 10""",
    "context_none": "SELECT instance_id, 1 AS rank, '' AS path, 1 AS start_line FROM instances WHERE false",
    "parse_pytest": f"WITH {LOGS}, {LOGLINES}, {PYTEST} SELECT doc_id, test, status FROM py",
    "parse_gotest": f"WITH {LOGS}, {LOGLINES}, {GOTEST} SELECT doc_id, test, status FROM go_",
    "score_instance": f"""WITH {LOGS}, {LOGLINES}, {PYTEST}, {GOTEST}, {ONCE},
        st AS (SELECT repo, test, min(status) AS status FROM (SELECT * FROM py UNION ALL SELECT * FROM go_) JOIN (SELECT doc_id, repo FROM lg) USING (doc_id) GROUP BY 1, 2),
        l AS (SELECT instance_id, repo, {_list('fail_to_pass')} AS f, {_list('pass_to_pass')} AS p FROM once),
        rq AS (SELECT DISTINCT instance_id, repo, kind, test FROM (SELECT instance_id, repo, 'f' AS kind, unnest(f) AS test FROM l UNION ALL SELECT instance_id, repo, 'p', unnest(p) FROM l)),
        se AS (SELECT rq.instance_id, kind, coalesce(status, 'MISSING') AS status FROM rq LEFT JOIN st ON st.repo = rq.repo AND st.test = rq.test)
        SELECT l.instance_id, len(any_value(f)) > 0 AND coalesce(bool_and(status = 'PASSED'), false) AS resolved,
        count(*) FILTER (kind = 'f' AND status = 'MISSING')::INT AS f_missing, count(*) FILTER (kind = 'p' AND status = 'MISSING')::INT AS p_missing
        FROM l LEFT JOIN se USING (instance_id) GROUP BY l.instance_id""",
    "string_list": f"""SELECT DISTINCT instance_id, kind, len(t)::INT AS n, array_to_string(t, '|') AS tests FROM (SELECT instance_id, 'f' AS kind, {_list('fail_to_pass')} AS t FROM instances
        UNION ALL SELECT instance_id, 'p', {_list('pass_to_pass')} FROM instances)""",
    "instance_validate": f"""WITH {ONCE} SELECT instance_id, CASE WHEN NOT coalesce(regexp_matches(instance_id, '{NB}'), false) THEN 'missing instance_id'
        WHEN NOT coalesce(regexp_matches(repo, '{NB}'), false) THEN 'missing repo' WHEN NOT coalesce(regexp_matches(base_commit, '{NB}'), false) THEN 'missing base_commit'
        WHEN NOT coalesce(regexp_matches(test_patch, '{NB}'), false) THEN 'missing test_patch' WHEN len({_list('fail_to_pass')}) = 0 THEN 'no FAIL_TO_PASS tests' ELSE '' END AS problem FROM once""",
    "repo_commit_validate": """SELECT corpus_id, coalesce(regexp_matches(repo, '^[A-Za-z0-9_.][A-Za-z0-9_.-]*/[A-Za-z0-9_.-]+$') AND NOT contains(repo, '..')
        AND regexp_matches(base_commit, '^[0-9a-fA-F]{7,40}$'), false) AS valid FROM corpora""",
    "scan_diff": f"WITH {CLEAN} SELECT prediction_id, md5(s) AS digest, length(s)::INT AS n FROM clean",
    "extract_diff": f"""WITH {CLEAN}, {_recount('clean')}, x AS (SELECT prediction_id, s, CASE WHEN NOT regexp_matches(s, '{NB}') THEN 'no diff found in model output' ELSE {_problem('s')} END AS problem FROM counted)
        SELECT prediction_id, md5(CASE WHEN problem IS NULL THEN s || chr(10) ELSE '' END) AS digest, coalesce(problem, '') AS problem FROM x""",
    "fenced_block": f"WITH raws AS (SELECT prediction_id, {RAW} AS s FROM predictions), {FENCE} SELECT prediction_id, md5(CASE WHEN inner_ IS NOT NULL AND {LIKE} THEN inner_ ELSE '<none>' END) AS digest FROM fence",
    "recount_hunks": f"WITH src AS (SELECT prediction_id, model_patch AS s FROM predictions WHERE model_patch <> ''), {_recount('src')} SELECT prediction_id, md5(s) AS digest FROM counted",
    "validate_diff": f"SELECT prediction_id, coalesce({_problem('coalesce(model_patch, chr(32))')}, '') AS problem FROM predictions",
    "prompt_assembly": f"""WITH {BM25}, p AS (SELECT instance_id, string_agg(chr(10) || repeat('-', 40) || chr(10) || 'File: ' || path || '  (lines ' || start_line || '-' || end_line || ')' || chr(10) || repeat('-', 40) || chr(10)
          || CASE WHEN length(content) > 4000 THEN substring(content, 1, 4000) || chr(10) || '… (truncated)' ELSE content END || chr(10), '' ORDER BY rank) AS x
          FROM lex JOIN (SELECT chunk_id, end_line, content FROM ch) USING (chunk_id) WHERE rank <= 20 GROUP BY 1),
        m AS (SELECT instance_id, 'Bug report:' || chr(10) || chr(10) || regexp_replace(coalesce(problem_statement, ''), '{TRIM}', '', 'g') || chr(10) || chr(10) || CASE WHEN x IS NULL
          THEN 'No repository excerpts were retrieved. Infer the fix from the report.' || chr(10)
          ELSE 'Relevant code from the repository (most relevant first):' || chr(10) || x || chr(10) || 'Now output the unified diff that fixes the bug.' || chr(10) END AS message FROM inst LEFT JOIN p USING (instance_id))
        SELECT instance_id, md5(message) AS digest, length(message)::INT AS n FROM m""",
    "caps": "SELECT doc_id, md5(substring(text, 1, 100)) AS query, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || chr(10) || '… (truncated)' ELSE text END) AS excerpt FROM documents WHERE text IS NOT NULL",
    "cap_logs": f"""SELECT doc_id, md5(CASE WHEN strlen(text) > 16384 THEN {_byte_cut('text', 16384)} || chr(10) || '...[truncated]' ELSE text END) AS log,
        md5(CASE WHEN strlen(text) > 1000 THEN {_byte_cut('text', 1000)} || chr(10) || '...[truncated]' ELSE text END) AS short FROM documents WHERE text IS NOT NULL""",
    "mock_predictions": f"""WITH {BM25}, f AS (SELECT instance_id, list(path ORDER BY r) AS files FROM (SELECT instance_id, path, min(rank) AS r FROM lex WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1)
        SELECT instance_id, 'mock' AS model_name_or_path, md5('--- a/src/main.py' || chr(10) || '+++ b/src/main.py' || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10)) AS patch,
        'src/main.py' AS changed, coalesce(array_to_string(files, '|'), '') AS retrieved, coalesce(list_contains(files, 'src/main.py'), false) AS plausible_hit, '' AS err FROM inst LEFT JOIN f USING (instance_id)""",
    "embed_fresh": """SELECT item_id, 64 AS dim, text NOT IN (SELECT text FROM eval_items WHERE item_id % 2 = 0 AND text IS NOT NULL) AS new FROM eval_items WHERE text IS NOT NULL""",
    "render_template": f"""SELECT corpus_id, replace('{TEMPLATE}', '{{{{.Repo}}}}', repo) AS prompt FROM corpora""",
    "first_line_preview": f"""WITH {CHUNKS}, l AS (SELECT chunk_id, coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '{TRIM}', '', 'g')), lambda x: x <> '')[1], '') AS l FROM ch)
        SELECT chunk_id, CASE WHEN strlen(l) > 100 THEN {_byte_cut('l', 100)} || '…' ELSE l END AS preview FROM l""",
    "stop_reason": """SELECT model, reason, truncated, count(*) AS n FROM (SELECT model_name_or_path AS model, coalesce(CASE WHEN stop_reason = 'length' THEN 'max_tokens' ELSE stop_reason END, '') AS reason,
        coalesce(stop_reason IN ('length', 'max_tokens'), false) AS truncated FROM predictions) GROUP BY 1, 2, 3""",
    "run_counters": f"""SELECT model_name_or_path AS model, count(*) AS n, count(*) FILTER (NOT coalesce(regexp_matches(err, '{NB}'), false) AND model_patch <> '') AS valid,
        count(*) FILTER (coalesce(plausible_hit, false)) AS plausible, count(*) FILTER (coalesce(regexp_matches(err, '{NB}'), false)) AS errored FROM predictions GROUP BY 1""",
    "backoff_delay": """SELECT attempt, asked, least(30.0, greatest(least(30.0, 0.5 * pow(2.0, attempt)), coalesce(asked, 0)))::DOUBLE AS delay FROM (
        SELECT DISTINCT k % 9 AS attempt, chunks_indexed % 40 AS asked FROM recall_results)""",
    "retry_after": """SELECT header, coalesce(CASE WHEN regexp_matches(trim(header), '^[0-9]+$') AND length(trim(header)) < 10 THEN trim(header)::INT END, 0)::INT AS seconds FROM (
        SELECT repo_version AS header FROM instances UNION SELECT strftime(created_at, '%Y-%m-%d') FROM instances UNION SELECT output_tokens::VARCHAR FROM predictions
        UNION SELECT stop_reason FROM predictions UNION SELECT ' ' || input_tokens::VARCHAR || ' ' FROM predictions UNION SELECT ' ')""",
    "mock_reply": f"""WITH {ONCE} SELECT instance_id, md5(CASE WHEN contains(lower(coalesce(problem_statement, '')), 'cach') THEN 'two' WHEN contains(lower(coalesce(problem_statement, '')), 'pagination') THEN 'one'
        WHEN contains(lower(coalesce(problem_statement, '')), 'token') THEN 'three' ELSE repo END) AS digest FROM once""",
    "error_bodies": f"""SELECT prediction_id, CASE WHEN e = '' THEN '(empty body)' WHEN strlen(e) > 300 THEN substring(e, 1, 300) || '…' ELSE e END AS message FROM (
        SELECT prediction_id, regexp_replace(coalesce(err, ''), '{TRIM}', '', 'g') AS e FROM predictions)""",
    "predictions_rows": "SELECT prediction_id, instance_id, model_name_or_path, md5(model_patch) AS digest FROM predictions",
    "task_projection": f"WITH {ONCE} SELECT instance_id, repo, base_commit, md5(problem_statement) AS statement FROM once",
}
