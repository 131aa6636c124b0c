"""Finding and restoring text that was decoded with a wrong character encoding.

Method: a noisy channel. A *token* is a run without white space that holds
characters outside ASCII. Each distinct token of the corpus is read as a byte
lattice: a channel (wrong codec, true codec) maps its characters back to bytes,
replacement characters and the bytes that a codec leaves undefined are wildcards,
and the paths through the lattice that are valid in the true codec are its
readings: all of them. Up to ``PATHS`` are listed; where there are more (wildcards for three
lost bytes may have so many), the lattices themselves are read again and searched for the best
path by the same scores, with the corpus units that some path may hold (``lattices``).
Channels are applied again, for text garbled twice or more, until nothing new comes. The source model are corpus
word frequencies: words, single Han characters and single marks are the units,
counted over all documents. The reading of largest probability wins; the token
itself is one reading. A garbled form can't prove itself by being frequent: in the
score of a token itself, copies of a text count once, and tokens that can be read as
UTF-8 count once in all, however many texts hold them. A token with replacement characters whose bytes can't be
determined by a lattice is matched with the corpus words of the same skeleton
(lost characters as wildcards), the most frequent one restoring it.

A token that only quotes garbled characters (its quotes hold nothing but the
garbled form of one character) mentions them and isn't damaged.

Scale: the corpus is reduced to distinct tokens with counts before anything runs
in Python; tokens, readings, unit counts and skeletons meet in hash joins, never
in a broadcast table or the driver. A long token of mostly lost bytes is costly
(figures in the README). ASCII-only documents stop at the first filter.

Defined results: null, empty and ASCII texts aren't damaged; repeated rows are
reported once per doc_id; empty tables give no rows. Damage that has no valid
reading is reported with ``restored`` = false for its token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm import lattices
from tarnfold.llm.lattices import Lattice
from tarnfold.llm.sketches import bitmap, maybe
from tarnfold.operators.skew import salted_join
from tarnfold.session import cut

LOST = "�"
#: Readings of one token that are listed; a token with more of them is searched as a lattice.
PATHS = 4096
#: What a reading must gain at least (log10), per round. A reading as UTF-8 proves itself by being valid.
UTF8_COST, OTHER_COST = 1.0, 2.5
#: The cost for a token without ASCII letters but with several accented ones: Latin scripts have no such words.
FOREIGN_COST = 0.3
_ACCENTED = re.compile("[À-ÿ]")
_LETTER = re.compile("[A-Za-z]")
#: Pseudo-count of an unseen unit, and what each of its characters costs besides (log10).
UNSEEN, UNSEEN_CHAR = 0.05, 0.7
#: (name, wrong codec, true codecs). "sloppy" maps undefined bytes to the C1 characters of the same number.
CHANNELS = (
    ("cp1252", ("utf-8", "gb18030", "cp1251", "koi8-r")),
    ("mac_roman", ("utf-8",)),
    ("cp437", ("utf-8",)),
    ("cp850", ("utf-8",)),
    ("cp866", ("utf-8",)),
    ("cp1251", ("utf-8", "koi8-r")),
    ("cp1250", ("utf-8",)),
    ("koi8-r", ("utf-8", "cp1251")),
    ("iso8859-2", ("utf-8",)),
    ("iso8859-15", ("utf-8",)),
    ("cp1254", ("utf-8",)),
    ("gb18030", ("utf-8",)),
)
#: Characters outside the scripts and signs of everyday text: as cp866, common Russian words are UTF-8 of Braille or Mongolian ones.
_RARE_SCRIPT = re.compile("[^\x00-\u024f\u0370-\u06ff\u0900-\u097f\u0e00-\u0e7f\u1e00-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7af\uff00-\uffef\U0001f000-\U0001faff]")
_QUOTES = "`'\"“”‘’«»„‹›"
READINGS = "token string, reading string, channel string, rounds int, cost double, doubtful boolean"
#: The channel of rows whose reading is a key of units that a token's lattices may hold, and the columns of its best reading.
WIDE = "lattice"
SEARCHED = "token string, reading string, channel string, rounds int, score double"


class TooMany(Exception):
    """A token has more readings than are listed."""


@cache
def _to_bytes(codec: str) -> dict[str, bytes]:
    """Character -> its byte in a single-byte codec; undefined bytes are C1 characters."""
    table = {}
    for b in range(128, 256):
        raw = bytes([b])
        try:
            table[raw.decode(codec)] = raw
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "cp1250", "cp1251", "cp1254"):
            table.setdefault(chr(b) if b < 0xA0 or codec == "cp1252" else "", raw)
    table.pop("", None)
    return table


def _runs(token: str) -> list[tuple[bool, str]]:
    """The token as (is ASCII, text) runs."""
    return [(m.group(1) is not None, m.group()) for m in re.finditer(r"([\x00-\x7f]+)|([^\x00-\x7f]+)", token)]


def _wild_utf8(run: str, wrong: str) -> list[str]:
    """Valid UTF-8 readings of a run with wildcards: all paths through its byte lattice, if they can be listed."""
    read = lattices.decoded(lattices.of(run), _byte_table(wrong), True)
    if read and lattices.count(read) > PATHS:
        raise TooMany
    return sorted(lattices.texts(read)) if read else []


def _read(run: str, wrong: str, true: str) -> list[str]:
    if wrong == "gb18030":
        try:
            return [run.encode("gb18030").decode("utf-8")]
        except (UnicodeEncodeError, UnicodeDecodeError):
            return []
    if LOST in run:
        return _wild_utf8(run, wrong) if true == "utf-8" and len(set(run)) > 1 else []
    table = _to_bytes(wrong)
    try:
        raw = b"".join(table[c] for c in run)
    except KeyError:
        return []
    try:
        return [raw.decode(true)]
    except UnicodeDecodeError:
        return []


def once(token: str) -> list[tuple[str, str]]:
    """``(channel, reading)`` of a token through each channel; runs that a channel can't read stay."""
    out = []
    runs = _runs(token)
    for wrong, trues in CHANNELS:
        for true in trues:
            if true == "gb18030":  # two bytes a character may take an ASCII byte along
                readings = _read_gb(token, wrong)
            else:
                readings, changed = [""], 0
                for ascii_run, run in runs:
                    options = [run] if ascii_run else _read(run, wrong, true)
                    if not ascii_run and options:
                        changed += 1
                    if not options:
                        if true != "utf-8":
                            changed = -99
                            break
                        options = [run]
                    if len(readings) * len(options) > PATHS:
                        raise TooMany
                    readings = [a + b for a in readings for b in options]
                if changed <= 0:
                    continue
            out.extend((f"{true} as {wrong}", r) for r in readings if r != token and _plain(r))
    return out


def _read_gb(token: str, wrong: str) -> list[str]:
    table = _to_bytes(wrong)
    try:
        raw = b"".join(c.encode() if c < "\x80" else table[c] for c in token)
        return [raw.decode("gb18030")]
    except (KeyError, UnicodeDecodeError):
        return []


def _plain(text: str) -> bool:
    """No control characters, private-use characters or lost ones."""
    return not any(c < " " or "\x7f" <= c <= "\x9f" or "" <= c <= "" or c == LOST for c in text)


def _damaged_again(text: str) -> bool:
    return any("\x80" <= c <= "\x9f" for c in text)


def readings(token: str) -> list[tuple[str, str, int]]:
    """All readings ``(reading, channel, rounds)`` of a token, fewest rounds first."""
    known = {token: 0}
    front, out = [(token, "")], []
    k = 0
    while front:  # a further round shortens the text, so this ends
        k += 1
        following = []
        for text, by in front:
            for channel, reading in _once_loose(text):
                if reading in known:
                    continue
                known[reading] = k
                name = f"{by}, {channel}" if by else channel
                if _plain(reading):
                    out.append((reading, name, k))
                if not reading.isascii() and channel.startswith("utf-8"):
                    following.append((reading, name))
        front = following
    return out


def _once_loose(token: str) -> list[tuple[str, str]]:
    """As ``once``, but intermediate texts may still hold C1 characters."""
    got = once(token)
    table = _to_bytes("cp1252")
    parts, changed = [], False
    for ascii_run, run in _runs(token):
        if ascii_run:
            parts.append(run)
            continue
        try:
            parts.append(b"".join(table[c] for c in run).decode("utf-8"))
            changed = True
        except (KeyError, UnicodeDecodeError):
            parts.append(run)
    text = "".join(parts)
    if changed and text != token and _damaged_again(text):
        got.append(("utf-8 as cp1252", text))
    return got


@cache
def _sets() -> tuple[int, int]:
    """The characters of plain texts, and those of everyday ones."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return lattices.characters(ord(c) for c in chars if _plain(c)), lattices.characters(map(ord, _RARE_SCRIPT.sub("", "".join(chars))))


@cache
def _byte_table(codec: str) -> lattices.Table:
    return lattices.table(lattices.gb18030() if codec == "gb18030" else {ord(c): raw for c, raw in _to_bytes(codec).items()})


@cache
def _char_table(wrong: str, true: str) -> lattices.Table:
    """Code point -> character, where both codecs have one byte a character."""
    out = {}
    for c, raw in _to_bytes(wrong).items():
        try:
            out[ord(c)] = raw.decode(true)
        except UnicodeDecodeError:
            continue
    return lattices.table(out)


def _once_wide(texts: Lattice) -> Iterator[tuple[str, Lattice, bool]]:
    """As ``_once_loose``, for all texts of a lattice: ``(channel, lattice, plain)``."""
    for wrong, trues in CHANNELS:
        for true in trues:
            if true == "gb18030":
                got = lattices.mapped_gb(texts, _byte_table(wrong))
            elif true == "utf-8":
                got = lattices.decoded(texts, _byte_table(wrong), wrong != "gb18030")
            else:
                got = lattices.mapped(texts, _char_table(wrong, true))
            got = got and lattices.restricted(got, _sets()[0])
            if got:
                yield f"{true} as {wrong}", got, True
    got = lattices.decoded(texts, _byte_table("cp1252"), False)
    got = got and lattices.holding(got, lattices.C1)
    if got:
        yield "utf-8 as cp1252", got, False


def wide_readings(token: str) -> list[tuple[Lattice, str, int]]:
    """All readings of a token as ``(lattice, channel, rounds)``, fewest rounds first.

    A reading that several channels give is in each of their lattices, and counts by its best.
    """
    front, out = [(lattices.of(token), "")], []
    known = {front[0][0]}
    k = 0
    while front:
        k += 1
        following = []
        for texts, by in front:
            for channel, got, plain in _once_wide(texts):
                if got in known:
                    continue
                known.add(got)
                name = f"{by}, {channel}" if by else channel
                if plain:
                    out.append((got, name, k))
                if channel.startswith("utf-8"):
                    following.append((got, name))
        front = following
    return out


def _doubtful_wide(read: list[tuple[Lattice, str, int]]) -> set[str]:
    """As the doubtful channels of ``_read_tokens``."""
    return {c.rpartition(", ")[0] for texts, c, _ in read if c.rpartition(", ")[2].startswith("utf-8") and lattices.restricted(texts, _sets()[1])}


def _cost(token: str, channel: str) -> float:
    foreign = len(_ACCENTED.findall(token)) >= 3 and not _LETTER.search(token)
    other = FOREIGN_COST if foreign and "as cp1252" in channel else OTHER_COST
    return sum(UTF8_COST if c.startswith("utf-8") else other for c in channel.split(", "))


def _one_character(token: str) -> bool:
    """A reading of the token is one character."""
    try:
        return any(len(r) == 1 for r, _, _ in readings(token))
    except TooMany:
        return any(lattices.has_single(texts) for texts, _, _ in wide_readings(token))


def mentions(token: str) -> bool:
    """The token holds, between quotes, nothing but one garbled character (a mention)."""
    m = re.search(rf"[{_QUOTES}]([^\x00-\x7f]{{1,8}})[{_QUOTES}]", token)
    if not m:
        return False
    inner, rest = m.group(1).strip(_QUOTES) or m.group(1), token[: m.start()] + token[m.end() :]
    if set(inner) == {LOST}:
        return LOST not in rest
    return rest.isascii() and _one_character(inner)


def _read_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for token in batch.token:
            if mentions(token):
                rows.append((token, token, "mention", 0, 0.0, True))
                continue
            try:
                read = readings(token)
            except TooMany:
                wide = wide_readings(token)
                if wide:
                    rows.append((token, token, "", 0, 0.0, "" in _doubtful_wide(wide)))
                    rows.extend((token, key, WIDE, 1, 0.0, False) for key in sorted({k for texts, _, _ in wide for k in lattices.asked(texts)}))
                continue
            # What can itself be read as everyday UTF-8: the token, or a reading with a further round.
            doubtful = {c.rpartition(", ")[0] for r, c, _ in read if c.rpartition(", ")[2].startswith("utf-8") and not _RARE_SCRIPT.search(r)}
            if read:
                rows.append((token, token, "", 0, 0.0, "" in doubtful))
            for reading, channel, rounds in read:
                rows.append((token, reading, channel, rounds, _cost(token, channel), channel in doubtful))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READINGS.split(", ")])


def _search(key: tuple[str], group: pd.DataFrame) -> pd.DataFrame:
    """The best reading of a token, given the corpus units that its lattices may hold."""
    token, total = key[0], int(group.total.iloc[0])
    units = group[group.unit.notna()].drop_duplicates("unit")
    counts = {n: dict(zip(units.unit, units[n].astype(int), strict=True)) for n in ("f", "own")}
    read = wide_readings(token)
    doubtful = _doubtful_wide(read)
    found = []
    for texts, channel, rounds in read:
        score, reading = lattices.best(texts, counts["own" if channel in doubtful else "f"], total, UNSEEN, UNSEEN_CHAR)
        found.append((_cost(token, channel) - score, rounds, reading, channel))
    loss, rounds, reading, channel = min(found)
    return pd.DataFrame([(token, reading, channel, rounds, -loss)], columns=[c.split()[0] for c in SEARCHED.split(", ")])


def unit_keys(unit: Column) -> Column:
    """What ``lattices.asked`` may ask for: the unit's length, and this with each position and its character."""
    n = F.length(unit)
    return F.concat(F.array(n.cast("string")), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws("/", n, i - 1, unit.substr(i, F.lit(1)))))


def searched(spans: DataFrame, freq: DataFrame, size: DataFrame) -> DataFrame:
    """``(token, reading, channel, rounds, score)``: the best reading of each token with too many to be listed.

    ``spans`` holds ``(token, key)``, the keys of units that the token's lattices may hold.
    """
    vocabulary = freq.select("unit", "f", "own", F.explode(unit_keys(F.col("unit"))).alias("key"))
    held = salted_join(spans, vocabulary, ["key"], hot=100).select("token", "unit", "f", "own")
    none = spans.select("token").distinct().select("token", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("bigint").alias("f"), F.lit(None).cast("bigint").alias("own"))
    return held.unionByName(none).crossJoin(F.broadcast(size)).groupBy("token").applyInPandas(_search, SEARCHED)


UNIT = r"[\p{L}\p{M}&&[^\p{IsHan}]]+|\p{IsHan}|[^\x00-\x7f]"


def units(text: Column) -> Column:
    """Units of the source model: words, Han characters, marks; those within ASCII are left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: u.rlike(r"[^\x00-\x7f]"))


def skeleton(word: Column, per_byte: bool) -> Column:
    """The word with each character outside ASCII lost: one mark per character or per UTF-8 byte."""
    if not per_byte:
        return F.regexp_replace(word, r"[^\x00-\x7f]", LOST)
    two = F.regexp_replace(word, r"[\x{80}-\x{7ff}]", LOST * 2)
    return F.regexp_replace(two, r"[\x{800}-\x{fffc}]", LOST * 3)


def tokens(documents: DataFrame) -> DataFrame:
    """``(doc_id, token)``: the tokens with characters outside ASCII."""
    return (
        documents.select("doc_id", "text")
        .where(F.col("text").rlike(r"[^\x00-\x7f]"))
        .select("doc_id", F.explode(F.array_distinct(F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda t: t.rlike(r"[^\x00-\x7f]")))).alias("token"))
    )


def damaged_tokens(documents: DataFrame) -> DataFrame:
    """``(token, reading, channel)`` of each damaged distinct token; reading is null if none is valid."""
    texts = documents.select(F.xxhash64("text").alias("doc_id"), "text")
    counted = cut(tokens(texts).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("texts")))
    # Readings differ from a token only if it has characters that some channel can map back.
    # Few bytes hold much work here, so the tokens are spread over all tasks instead of being coalesced by size.
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = counted.select("token").repartition(tasks, "token").mapInPandas(_read_tokens, READINGS)
    read = cut(read)
    mention = read.where("channel = 'mention'").select("token").distinct()
    suspect = read.where("rounds = 0 and doubtful").select("token", F.lit(1).alias("once"))
    total = counted.join(suspect, "token", "left").select(F.explode(units(F.col("token"))).alias("unit"), "n", "texts", F.coalesce("once", "texts").alias("once"))
    # f: in how many documents; texts: in how many distinct texts; own: the same, but each token that can be read as UTF-8 counts once.
    freq = cut(total.groupBy("unit").agg(F.sum("n").alias("f"), F.sum("texts").alias("texts"), F.sum("once").alias("own")))
    size = freq.agg(F.coalesce(F.sum("texts"), F.lit(1)).alias("total"))
    all_readings = read.where(~F.col("channel").isin("mention", WIDE))
    spans = read.where(F.col("channel") == WIDE).select("token", F.col("reading").alias("key"))
    unseen = F.log10(F.lit(UNSEEN) / F.col("total")) - UNSEEN_CHAR * F.length("unit")

    def score(n: str) -> Column:
        return F.sum(F.when(F.col("unit").isNull(), 0.0).when(F.col(n).isNotNull(), F.log10(F.col(n) / F.col("total"))).otherwise(unseen))

    per_unit = (
        all_readings.select("reading").distinct().select("reading", F.explode_outer(units(F.col("reading"))).alias("unit"))
        .join(freq, "unit", "left")
        .crossJoin(F.broadcast(size))
        .groupBy("reading")
        .agg(score("f").alias("score"), score("own").alias("own_score"))
    )
    scored = all_readings.join(per_unit, "reading").withColumn("score", F.when(F.col("doubtful") | (F.col("rounds") == 0), F.col("own_score")).otherwise(F.col("score")) - F.col("cost"))
    scored = scored.select("token", "reading", "channel", "rounds", "score")
    if not spans.isEmpty():
        scored = scored.unionByName(searched(cut(spans), freq, size))
    best = Window.partitionBy("token").orderBy(F.desc("score"), "rounds", "reading")
    chosen = scored.withColumn("rn", F.row_number().over(best)).where("rn = 1 and rounds > 0").select("token", "reading", "channel")
    lost = counted.select("token").where(F.contains("token", F.lit(LOST))).join(chosen.select("token"), "token", "left_anti")
    lost = lost.join(mention, "token", "left_anti")
    return chosen.unionByName(restore_lost(lost, freq))


def restore_lost(lost: DataFrame, freq: DataFrame) -> DataFrame:
    """Tokens with lost characters, each word replaced by the most frequent corpus word of its skeleton."""
    words = freq.where(~F.contains("unit", F.lit(LOST)))
    kinds = [words.select(skeleton(F.col("unit"), b).alias("shape"), "unit", "texts", "f") for b in (False, True)]
    best = (
        kinds[0].unionByName(kinds[1])
        .groupBy("shape")
        .agg(F.max_by("unit", F.struct("texts", "f", "unit")).alias("word"))
    )
    shape = rf"[\p{{L}}\p{{M}}{LOST}]+"
    parts = lost.select("token", F.explode(F.filter(F.regexp_extract_all("token", F.lit(shape), F.lit(0)), lambda w: F.contains(w, F.lit(LOST)))).alias("shape"))
    matched = parts.join(best, "shape", "left")
    return (
        matched.groupBy("token")
        .agg(F.count_if(F.col("word").isNull()).alias("open"), F.sort_array(F.collect_set(F.struct(F.length("shape").alias("l"), "shape", "word")), asc=False).alias("w"))
        .select(
            "token",
            F.when(F.col("open") == 0, F.aggregate("w", F.col("token"), lambda t, w: F.replace(t, w["shape"], w["word"]))).alias("reading"),
            F.lit("lost bytes").alias("channel"),
        )
    )


def _in_damaged(documents: DataFrame, damaged: DataFrame) -> DataFrame:
    """``(doc_id, token, reading, channel)``: the damaged tokens of each document; a frequent one is no hot group."""
    return salted_join(cut(tokens(documents)), damaged, ["token"])


def restored(documents: DataFrame) -> DataFrame:
    """``(doc_id, damaged_tokens, restored_tokens, channels, text)`` of each damaged document."""
    damaged = cut(damaged_tokens(documents))
    per_doc = cut(
        _in_damaged(documents, damaged)
        .groupBy("doc_id")
        .agg(
            F.count_distinct("token").alias("damaged_tokens"),
            F.count_distinct(F.when(F.col("reading").isNotNull(), F.col("token"))).alias("restored_tokens"),
            F.sort_array(F.collect_set("channel")).alias("channels"),
            F.collect_set(F.struct("token", F.coalesce("reading", "token").alias("reading"))).alias("fix"),
        )
    )
    # Only texts of damaged documents are shuffled: a Bloom filter of their ids lets few others through.
    sketch = documents.sparkSession.sparkContext.broadcast(bitmap(per_doc.select(F.xxhash64("doc_id").alias("h"))))

    @F.pandas_udf("boolean")
    def hopeful(h: pd.Series) -> pd.Series:
        return pd.Series(maybe(sketch.value, h.to_numpy()))

    pieces = F.split("text", r"(?<=[ \t\n\x0b\f\r])|(?=[ \t\n\x0b\f\r])")
    some = documents.select("doc_id", "text").where("doc_id is not null").where(hopeful(F.xxhash64("doc_id")))
    texts = some.join(per_doc.withColumn("fix", F.map_from_entries("fix")), "doc_id").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return texts.select(
        "doc_id", "damaged_tokens", "restored_tokens", "channels",
        F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("fix", p), p)), "").alias("text"),
    )


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id)``: the documents with garbled characters."""
    return _in_damaged(documents, cut(damaged_tokens(documents).select("token").distinct())).select("doc_id").distinct()
