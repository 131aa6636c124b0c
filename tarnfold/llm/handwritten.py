"""Source files that weren't written by hand: generated, minified, vendored, data saved as code.

Method. A character trigram model of identifiers is counted per language (file
extension) over the ordinary lines of all chunks; encoded runs are no identifiers.
With it each chunk gets, in one vectorised pass,

* the cross-entropy of its identifiers (mangled names of minified code are dear), over
  all lines and over the ordinary ones;
* the diversity of its line templates (identifiers and numbers as one symbol; program
  output repeats few templates) and of its names with numbers;
* the share of very long lines and of encoded or numeric data;
* its naming style (underscores against humps);
* marks of program output and licence notices of others in comments;
* hashes of ``SHINGLE`` successive code lines.

Chunks are summed into files, so repeated windows weigh alike in sums and quotients.
The signals of a file, in the order in which they decide its kind:

* ``mangled``: its names cost more than ``SPREADS`` quartile ranges above the median of
  the ordinary lines of its language's files (of all files, where a language has too few);
* ``templates``: few line templates or names that only differ by numbers;
* ``encoded``: mostly numbers or encoded strings, by characters and by lines;
* ``borrowed``: mostly lines that other repositories have as well; a lower share
  suffices for a naming style foreign to the corpus;
* then evidence that the method named doesn't see: ``marked`` (marks of program output),
  ``noticed`` (notices of a holder foreign to the corpus), ``placed`` (directories for
  third-party code), ``listed`` (lock and checksum lists) and ``packed`` (style sheets and
  markup in long lines; their names aren't mangled).

Which other repositories hold a shingle is found exactly: least and greatest repository
per shingle are aggregated before the shuffle; a Bloom filter of fixed size over the shared
ones lets few others through to the join that decides.

The model's tables hold at most 30 ** 3 counts per language, whatever the input's
size; they, the languages' quartiles and the bitmap are the only things collected.

Defined results: null and empty contents count nothing; files of documentation or
configuration are hand-written; a null path or corpus is a key of its own; chunks
delivered again change no decision; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.sketches import bitmap, maybe
from tarnfold.session import cut

LANGUAGES = ("py", "go", "js", "ts", "java", "c", "other")
#: Extensions by kind. Documentation and configuration are always hand-written.
BY_HAND = ("md", "rst", "txt", "adoc", "yml", "yaml", "ini", "cfg", "conf", "toml", "env", "properties", "local", "npmrc", "sh", "bash", "dockerfile", "gitignore", "example")
LISTS = ("lock", "sum", "json")
MARKUP = ("css", "html", "htm", "svg", "xml")
VENDOR_DIRS = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "ext", "deps", "contrib", "node_modules", "bower_components", "site-packages", "Pods", "Godeps")
SHINGLE = 6
LONG_LINE = 240
#: Runs of so many characters of an encoding's alphabet are encoded data, not names.
ENCODED_RUN = 32
SPREADS = 5.0
LEAST_NAMES = 100
LEAST_FILES = 30
SYMBOLS = 30
UNKNOWN_BITS = np.full(SYMBOLS**3, np.log2(SYMBOLS), dtype=np.float16)

#: Letters without case, one symbol for digits, the underscore and the dollar sign; 0 is everything else.
_CODE = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i + 1
_CODE[48:58] = 27
_CODE[ord("_")], _CODE[ord("$")] = 28, 29
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[48:58] = True
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_NUMERIC = np.zeros(256, dtype=bool)
_IS_NUMERIC[[ord(c) for c in "0123456789-+.,;:xX[](){}"]] = True
_IS_DATA = _CODE > 0
_IS_DATA[[ord(c) for c in "+/="]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd multiplier, modulo 2 ** 64; one for each place of a line."""
    out = np.full(max(1, n), np.uint64(_MULTIPLIER))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: A mark stands at the start of a comment; the same words within a string or amid a sentence are no mark.
MARK = re.compile(
    r"^[ \t]*(?://|#|/\*+|\*|<!--|--|;|%)[ \t/*#-]*(?:code generated by\b|auto-?generated\b|<auto-generated|@generated\b|generated by \S+[^.\n]*(?:do not edit|$)|"
    r"(?:this file|this code) (?:was|is|has been) (?:auto(?:matically)?[ -]?)?(?:generated|produced|created) by\b|automati(?:cally|sch) (?:generated|erzeugt)\b|"
    r"generado (?:automáticamente|por)|généré (?:automatiquement|par)|source: \S+\.proto\b)",
    re.I | re.M,
)
MARK_WORDS = ("enerated", "ENERATED", "rzeugt", "produced by", "created by", ".proto", "enerado", "énéré")
NOTICE = re.compile(
    r"^[ \t]*(?://|#|/\*+!?|\*|--|;)[ \t]*(?:copyright[ \t]*)?(?:\(c\)|©|copyright)[ \t]*(?:\d{4}(?:[-,][ ]?\d{4})*[ \t]*)?(?:the[ \t]+)?(\w[\w.-]*)[ \t]+(?:maintainers|authors|contributors|project\b[^\n.]*)|"
    r"^[ \t]*(?://|#|/\*+!?|\*)[ \t]*this file is part of (?:the )?(\w[\w.-]*)",
    re.I | re.M,
)
NOTICE_WORDS = ("opyright", "(c)", "©", "is part of")


def extension(path: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(path, r"([^./]*)$", 1), F.lit("")))


def language_of(ext: Column) -> Column:
    known = F.when(ext.isin("jsx", "mjs", "cjs"), "js").when(ext.isin("tsx"), "ts").when(ext.isin("h", "cc", "cpp", "hpp"), "c").otherwise(ext)
    return F.when(known.isin(*LANGUAGES), known).otherwise("other")


def source_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of files that may have been made by a program or by others."""
    ext = extension(F.col("path"))
    return chunks.select("corpus_id", "path", "content").withColumn("ext", ext).where(
        ~F.col("ext").isin(*BY_HAND) & F.col("content").isNotNull() & (F.col("content") != "")
    ).withColumn("language", language_of(F.col("ext")))


class Batch:
    """The bytes of many texts at once, with the position of each line and text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.count = len(texts)

    def encoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(begin, length, bytes in a long run)`` of the runs over an encoding's alphabet."""
        dataish = _IS_DATA[self.bytes]
        change = np.flatnonzero(np.diff(np.concatenate([[0], dataish.astype(np.int8), [0]])))
        begin, size = change[0::2], change[1::2] - change[0::2]
        inside = dataish.copy()
        inside[dataish] = np.repeat(size >= ENCODED_RUN, size)
        return begin, size, inside

    def names(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(symbols, place)`` of the identifiers, with one 0 between two of them; no numbers, no encoded data."""
        codes = _CODE[self.bytes]
        word = codes > 0
        begin = word & ~np.concatenate([[False], word[:-1]])
        run = np.cumsum(begin) - 1
        numeric = _IS_DIGIT[self.bytes[np.flatnonzero(begin)]]
        keep = word & ~inside
        keep[word] &= ~numeric[run[word]]
        codes = np.where(keep, codes, 0)
        sep = codes == 0
        kept = np.flatnonzero(~(sep & np.concatenate([[False], sep[:-1]])))
        return codes[kept], kept


def trigram_ids(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(trigram, position)`` of all trigrams whose middle is in an identifier."""
    if len(symbols) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(symbols[1:-1] > 0)
    return (symbols[at] * SYMBOLS + symbols[at + 1]) * SYMBOLS + symbols[at + 2], at


def count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, part in batch.groupby("language"):
            # Names are learnt from lines of ordinary length, so minified code can't teach its own names.
            texts = ["\n".join([x for x in t.split("\n") if len(x) <= LONG_LINE]) for t in part.content]
            b = Batch(texts)
            ids, _ = trigram_ids(b.names(b.encoded()[2])[0])
            counts = np.bincount(ids, minlength=SYMBOLS**3)
            total[language] = total.get(language, 0) + counts
    for language, counts in total.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"language": language, "trigram": at.astype(np.int64), "n": counts[at].astype(np.int64)})


def name_model(chunks: DataFrame) -> dict[str, np.ndarray]:
    """Bits of each third character given the two before, per language; counted over all chunks."""
    rows = (
        chunks.select("language", "content").mapInPandas(count_trigrams, "language string, trigram bigint, n bigint")
        .groupBy("language", "trigram").agg(F.sum("n").alias("n")).toArrow()
    )
    languages, trigrams, counts = (rows.column(c).to_numpy() for c in ("language", "trigram", "n"))
    model = {}
    for language in [*sorted(set(languages)), ""]:
        here = (languages == language) | (language == "")
        if not here.any():
            continue
        n = 0.01 + np.bincount(trigrams[here], weights=counts[here], minlength=SYMBOLS**3)
        by_pair = n.reshape(-1, SYMBOLS)
        model[language] = (-np.log2(by_pair / by_pair.sum(axis=1, keepdims=True))).astype(np.float16).ravel()
    return model


MEASURES = "lines", "templates", "chars", "long_chars", "data_chars", "data_lines", "bits", "trigrams", "plain_bits", "plain_trigrams", "numbered", "humps", "bars", "marks"
CHUNK_SCHEMA = "corpus_id string, path string, ext string, language string, holder string, shingles array<bigint>, " + ", ".join(f"{m} double" for m in MEASURES)


def measure_texts(texts: list[str], bits: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """All measures of each text, and its shingles."""
    b = Batch(texts)
    owner = np.repeat(np.arange(b.count), b.sizes)
    total = lambda where, weights=None: np.bincount(owner[where], weights=weights, minlength=b.count).astype(float)
    raw, out = b.bytes, {}
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    # (a) line templates and hashes: white space is dropped, a word is one symbol.
    solid = ~_IS_SPACE[raw]
    line = np.cumsum(np.concatenate([[0], (raw[:-1] == 10).astype(np.int64)]))
    n_lines = len(ends)
    at = np.flatnonzero(solid)
    solid_line = line[at]
    first_of_line = np.full(n_lines, -1, dtype=np.int64)
    first_of_line[solid_line[::-1]] = at[::-1]
    filled = first_of_line >= 0
    head = np.where(filled, raw[np.maximum(first_of_line, 0)], 0)
    second = raw[np.minimum(np.maximum(first_of_line, 0) + 1, len(raw) - 1)]
    comment = (head == ord("#")) | (head == ord("*")) | ((head == ord("/")) & ((second == ord("/")) | (second == ord("*"))))
    code_line = filled & ~comment
    word = _CODE[raw] > 0
    begin_word = word & ~np.concatenate([[False], word[:-1]])
    symbol = np.where(word, 1, raw).astype(np.uint64)

    def line_hash(where: np.ndarray, values: np.ndarray) -> np.ndarray:
        of = line[where]
        starts = np.searchsorted(of, np.arange(n_lines))
        place = np.arange(len(of)) - starts[of]
        out_hash = np.zeros(n_lines, dtype=np.uint64)
        if len(of):
            terms = (values + np.uint64(3)) * _powers(int(place.max()) + 1)[place]
            present = np.flatnonzero(np.diff(np.concatenate([starts, [len(of)]])) > 0)
            out_hash[present] = np.add.reduceat(terms, starts[present])
        return out_hash ^ (out_hash >> np.uint64(29))

    template_at = np.flatnonzero(solid & (~word | begin_word))
    template = line_hash(template_at, symbol[template_at])
    whole = line_hash(at, raw[at].astype(np.uint64))
    # Rows of numbers are one template, whatever their signs and widths.
    numeric = np.bincount(solid_line, weights=_IS_NUMERIC[raw[at]], minlength=n_lines) >= 0.85 * np.maximum(1, np.bincount(solid_line, minlength=n_lines))
    template = np.where(numeric, np.uint64(1), template)
    line_owner = owner[begins] if n_lines else np.zeros(0, dtype=np.int64)
    codes = np.flatnonzero(code_line)
    mixed = template[codes] * np.uint64(0xD1B54A32D192ED03) + line_owner[codes].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, unique_at = np.unique(mixed, return_index=True)
    out["lines"] = np.bincount(line_owner[codes], minlength=b.count).astype(float)
    out["templates"] = np.bincount(line_owner[codes][unique_at], minlength=b.count).astype(float)
    # (b) long lines and data.
    length = ends - begins
    long = np.flatnonzero(code_line & (length > LONG_LINE))
    out["chars"] = b.sizes.astype(float)
    out["long_chars"] = np.bincount(line_owner[long], weights=length[long], minlength=b.count)
    run_a, run_len, inside = b.encoded()
    is_data = (run_len >= ENCODED_RUN) | _IS_DIGIT[raw[run_a]]
    out["data_chars"] = np.bincount(owner[run_a[is_data]], weights=run_len[is_data], minlength=b.count).astype(float)
    per_line = np.bincount(line[run_a[is_data]], weights=run_len[is_data], minlength=n_lines)
    data_line = np.flatnonzero(code_line & (per_line >= 0.4 * np.maximum(1, np.bincount(solid_line, minlength=n_lines))))
    out["data_lines"] = np.bincount(line_owner[data_line], minlength=b.count).astype(float)
    # (c) names: cross-entropy, numbers at the end, style.
    symbols, name_at = b.names(inside)
    ids, place = trigram_ids(symbols)
    middle = name_at[place + 1]
    cost = bits[ids].astype(np.float64)
    plain = length[line[middle]] <= LONG_LINE
    out["trigrams"] = np.bincount(owner[middle], minlength=b.count).astype(float)
    out["bits"] = np.bincount(owner[middle], weights=cost, minlength=b.count).astype(float)
    out["plain_trigrams"] = np.bincount(owner[middle[plain]], minlength=b.count).astype(float)
    out["plain_bits"] = np.bincount(owner[middle[plain]], weights=cost[plain], minlength=b.count).astype(float)
    end_digit = word & _IS_DIGIT[raw] & ~np.concatenate([word[1:], [False]])
    run_no = np.cumsum(begin_word) - 1
    starts_digit = _IS_DIGIT[raw[np.flatnonzero(begin_word)]]
    tails = np.flatnonzero(end_digit)
    tails = tails[~starts_digit[run_no[tails]]] if len(tails) else tails
    out["numbered"] = total(tails)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    out["humps"] = total(np.flatnonzero(upper[1:] & lower[:-1]) + 1)
    out["bars"] = total(np.flatnonzero((raw[1:-1] == 95) & lower[:-2] & lower[2:]) + 1)
    # (d) shingles of code lines.
    shingles: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * b.count
    if len(codes) >= SHINGLE:
        h = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0xD6E8FEB86659FD93) + whole[codes[k : k + len(h)]]
        h ^= h >> np.uint64(31)
        same = line_owner[codes[: len(h)]] == line_owner[codes[SHINGLE - 1 :]]
        kept = np.flatnonzero(same)
        of = line_owner[codes[kept]]
        values = h[kept].astype(np.int64)
        cuts = np.searchsorted(of, np.arange(b.count + 1))
        shingles = [np.unique(values[cuts[i] : cuts[i + 1]]) for i in range(b.count)]
    return out, shingles


def _measure(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, part in batch.groupby("language"):
                for lo in range(0, len(part), 512):
                    some = part.iloc[lo : lo + 512]
                    texts = some.content.tolist()
                    # A language without any ordinary line is judged by the names of all others.
                    values, shingles = measure_texts(texts, model.get(language, model.get("", UNKNOWN_BITS)))
                    marks, holders = [], []
                    for t in texts:
                        marks.append(float(any(w in t for w in MARK_WORDS) and bool(MARK.search(t))))
                        found = NOTICE.search(t) if any(w in t for w in NOTICE_WORDS) else None
                        holders.append((found.group(1) or found.group(2)).lower() if found else None)
                    values["marks"] = np.array(marks)
                    yield some[["corpus_id", "path", "ext", "language"]].assign(
                        holder=holders, shingles=shingles, **{m: values[m] for m in MEASURES}
                    )

    return run


def measured_files(chunks: DataFrame, corpora: DataFrame) -> DataFrame:
    """The sums of each file, its shingles and those of them that other repositories have as well."""
    source = source_chunks(chunks)
    repos = corpora.groupBy("corpus_id").agg(F.min("repo").alias("repo"))
    per_chunk = cut(source.mapInPandas(_measure(name_model(source)), CHUNK_SCHEMA))
    files = per_chunk.groupBy("corpus_id", "path").agg(
        F.first("ext").alias("ext"), F.first("language").alias("language"), F.max("holder").alias("holder"),
        F.sum(F.size("shingles")).alias("n_shingles"), *[F.sum(m).alias(m) for m in MEASURES],
    )
    owned = per_chunk.select("corpus_id", "path", "shingles").join(repos, "corpus_id", "left")
    spread = owned.select(F.xxhash64(F.coalesce("repo", "corpus_id")).alias("repo"), F.explode("shingles").alias("shingle"))
    spread = spread.groupBy("shingle").agg(F.min("repo").alias("least"), F.max("repo").alias("greatest"))
    shared = cut(spread.where("least <> greatest").select("shingle"))
    sketch = bitmap(shared)

    def hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch.shingles.map(len).to_numpy()
            if not sizes.sum():
                continue
            values = np.concatenate(batch.shingles.to_list()).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), sizes)
            some = np.flatnonzero(maybe(sketch, values))
            yield pd.DataFrame({
                "corpus_id": batch.corpus_id.to_numpy()[row[some]], "path": batch.path.to_numpy()[row[some]], "shingle": values[some],
            })

    hits = per_chunk.select("corpus_id", "path", "shingles").mapInPandas(hopeful, "corpus_id string, path string, shingle bigint")
    # Counted before the join, so a shingle sends one row per file and task.
    hits = hits.groupBy("shingle", "corpus_id", "path").agg(F.count("*").alias("n")).join(shared, "shingle")
    borrowed = hits.groupBy(F.col("corpus_id").alias("c"), F.col("path").alias("p")).agg(F.sum("n").alias("borrowed"))
    same = F.col("corpus_id").eqNullSafe(F.col("c")) & F.col("path").eqNullSafe(F.col("p"))
    return files.join(borrowed, same, "left").drop("c", "p")


def name_limits(files: DataFrame) -> dict[str, float]:
    """Per language, and for all ("") together: the bits a name's character may cost before names count as mangled."""
    plain = files.where(F.col("plain_trigrams") >= LEAST_NAMES).withColumn("x", F.col("plain_bits") / F.col("plain_trigrams"))
    quartiles = [F.count("*").alias("n"), F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q")]
    rows = plain.groupBy("language").agg(*quartiles).union(plain.agg(F.lit("").alias("language"), *quartiles)).collect()
    return {r.language: r.q[1] + SPREADS * (r.q[2] - r.q[0]) for r in rows if r.q and (r.n >= LEAST_FILES or not r.language)}


SIGNALS = {
    "mangled": "minified", "templates": "generated", "encoded": "data", "borrowed_lines": "vendored",
    "marked": "generated", "noticed": "vendored", "placed": "vendored", "listed": "generated", "packed": "minified",
}


def judged_files(chunks: DataFrame, corpora: DataFrame) -> DataFrame:
    """``(corpus_id, path, kind, signals, ...measures)`` of each file that wasn't written by hand."""
    files = cut(measured_files(chunks, corpora))
    # The corpus's own holder and style: what most of its files have.
    holders = files.where("holder is not null").groupBy("corpus_id", "holder").agg(F.count("*").alias("n"))
    own = holders.groupBy("corpus_id").agg(F.max_by("holder", F.struct("n", "holder")).alias("own_holder"), F.sum("n").alias("noticed"))
    style = files.groupBy("corpus_id", "language").agg((F.sum("bars") / (F.sum("bars") + F.sum("humps") + 1)).alias("usual_style"))
    limits = name_limits(files)
    limit = F.lit(limits.get("", float("inf")))
    for language in sorted(set(limits) - {""}):
        limit = F.when(F.col("language") == language, F.lit(limits[language])).otherwise(limit)
    wide = files.join(own, "corpus_id", "left").join(style, ["corpus_id", "language"], "left")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    wide = wide.select(
        "*",
        F.when(F.col("lines") > 0, F.col("templates") / F.col("lines")).otherwise(1.0).alias("diversity"),
        ratio("long_chars", "chars").alias("long_share"),
        ratio("data_chars", "chars").alias("data_share"),
        ratio("data_lines", "lines").alias("data_line_share"),
        ratio("bits", "trigrams").alias("name_bits"),
        limit.alias("name_limit"),
        ratio("borrowed", "n_shingles").alias("borrowed_share"),
        F.abs(F.col("bars") / (F.col("bars") + F.col("humps") + 1) - F.coalesce("usual_style", F.lit(0.0))).alias("foreign_style"),
    )
    lists = F.col("ext").isin(*LISTS)
    many = F.col("lines") >= 12
    holder, named = F.col("holder"), F.col("holder").isNotNull() & ~F.col("holder").isin("project", "the")
    conditions = {
        "mangled": (F.col("name_bits") > F.col("name_limit")) & (F.col("trigrams") >= LEAST_NAMES) & ~lists,
        "templates": many & (F.col("diversity") < 0.2) | (F.col("lines") >= 6) & (F.col("diversity") < 0.3) & (F.col("numbered") > 0.8 * F.col("lines")),
        "encoded": (F.col("data_share") > 0.45) & (F.col("data_line_share") > 0.5) & ~lists,
        "borrowed_lines": (F.col("borrowed_share") >= 0.5) & (F.col("n_shingles") >= 3)
        | (F.col("borrowed_share") >= 0.3) & (F.col("n_shingles") >= 5) & (F.col("foreign_style") > 0.3),
        "marked": F.col("marks") > 0,
        "noticed": named & ((holder != F.coalesce("own_holder", F.lit(""))) | (F.col("noticed") < 4)),
        "placed": F.coalesce(F.col("path"), F.lit("")).rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, VENDOR_DIRS)) + r")/") & ~lists,
        "listed": lists & ((F.col("data_share") > 0.25) | F.col("ext").isin("lock", "sum")),
        "packed": F.col("ext").isin(*MARKUP) & (F.col("long_share") > 0.6),
    }
    signals = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())
    first = F.col("signals")[0]
    kind = F.when((first == "templates") & (F.col("data_share") > 0.15), "data")
    for name, value in SIGNALS.items():
        kind = kind.when(first == name, value)
    return wide.withColumn("signals", signals).where(F.size("signals") > 0).select(
        "corpus_id", "path", kind.alias("kind"), "signals", "diversity", "long_share", "data_share", "name_bits", "name_limit", "borrowed_share", "foreign_style", "holder"
    )


def found(chunks: DataFrame, corpora: DataFrame) -> DataFrame:
    """``(corpus_id, path)`` of each file that wasn't written by hand."""
    return judged_files(chunks, corpora).select("corpus_id", "path").distinct()
