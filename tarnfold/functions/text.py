"""Column expressions over text: white space, identifiers, terms, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as a character class body that Java and RE2 read alike.
SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JAVA_SPACE = SPACE.replace(r"\x{85}", r"\x85").replace(r"\x{A0}", r"\xA0")
#: The characters of a word behind which an identifier falls into parts.
PART_BREAK = (
    r"\p{Ll}(?=[\p{Lu}\p{Nd}])|\p{Lu}(?=\p{Nd}|\p{Lu}\p{Ll})|\p{Nd}(?=\p{L})|[\p{L}&&[^\p{Ll}\p{Lu}]](?=\p{Nd})"
)
MARK = "\x01"
TRUNCATED = "\n… (truncated)"


def unicode_trim(text: Column) -> Column:
    """Without Unicode white space on either side."""
    return F.regexp_replace(text, rf"^[{JAVA_SPACE}]+|[{JAVA_SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but Unicode white space."""
    return ~F.coalesce(text.rlike(rf"[^{JAVA_SPACE}]"), F.lit(False))


def fields(text: Column) -> Column:
    """The runs without Unicode white space."""
    return F.filter(F.split(text, rf"[{JAVA_SPACE}]+"), lambda x: x != "")


def _marked(text: Column) -> Column:
    """Part breaks marked by one character, so that each text is scanned twice, not each word."""
    return F.regexp_replace(F.translate(text, MARK, " "), PART_BREAK, "$0" + MARK)


def split_identifier(word: Column) -> Column:
    """The parts of an identifier: fooBar, HTTPServer and foo2bar fall apart."""
    return F.split(_marked(word), MARK)


def terms(text: Column) -> Column:
    """Lower-case terms in order: each word, and before its parts the whole word if there are several.

    A null text has no terms.
    """
    words = F.regexp_extract_all(_marked(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{Nd}}{MARK}]+"), F.lit(0))
    each = F.transform(
        words,
        lambda w: F.when(
            F.contains(w, F.lit(MARK)),
            F.concat(F.array(F.lower(F.replace(w, F.lit(MARK), F.lit("")))), F.split(F.lower(w), MARK)),
        ).otherwise(F.array(F.lower(w))),
    )
    return F.flatten(each)


WORD_CLASS = r"[\p{L}\p{Nd}]"


def marked(text: Column) -> Column:
    """The text with its part breaks marked; the input of ``term_count`` and ``explode_terms``."""
    return _marked(F.coalesce(text, F.lit("")))


def term_count(marked_text: Column) -> Column:
    """How many terms a marked text has: its parts, and each word of several parts once more."""
    parts = F.regexp_count(marked_text, F.lit(WORD_CLASS + "+"))
    # From the first mark of a word to its end, without a repeated group: Java matches those by recursion, as deep as a word has parts.
    several = F.regexp_count(marked_text, F.lit(rf"{MARK}[\p{{L}}\p{{Nd}}{MARK}]*+"))
    return parts + several


def explode_terms(rows: DataFrame, marked_text: str, *keep: str, empty: bool = False) -> DataFrame:
    """``(*keep, term)``: the terms of a marked text as rows, through generated code only; with an empty term first on demand."""
    words = F.regexp_extract_all(marked_text, F.lit(rf"[\p{{L}}\p{{Nd}}{MARK}]+"), F.lit(0))
    words = F.concat(F.array(F.lit("")), words) if empty else words
    each = rows.select(*keep, F.explode(words).alias("_w"))
    low = F.lower("_w")
    alone = F.array(low)
    several = F.concat(F.array(F.replace(low, F.lit(MARK), F.lit(""))), F.split(low, MARK))
    return each.select(*keep, F.explode(F.when(F.contains(F.col("_w"), F.lit(MARK)), several).otherwise(alone)).alias("term"))


def unique_terms(text: Column) -> Column:
    """Distinct terms in the order of their first appearance."""
    return F.array_distinct(terms(text))


def cap_code_points(text: Column, most: int) -> Column:
    """The first ``most`` code points; 0 or less keeps all."""
    return F.substring(text, 1, most) if most > 0 else text


def cap_excerpt(text: Column, most: int) -> Column:
    """The first ``most`` code points and a note, if the text is longer."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def cap_bytes(text: Column, most: int = 16 * 1024) -> Column:
    """A log cut at a number of bytes; a character cut in two becomes a replacement character."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit("\n...[truncated]"))).otherwise(text)


def error_body(text: Column, most: int = 300) -> Column:
    """An error reply for messages: trimmed, cut at a number of bytes, never empty."""
    trimmed = unicode_trim(F.coalesce(text, F.lit("")))
    head = F.make_valid_utf8(F.substring(trimmed.cast("binary"), 1, most).cast("string"))
    return (
        F.when(trimmed == "", F.lit("(empty body)")).when(F.octet_length(trimmed) > most, F.concat(head, F.lit("…"))).otherwise(trimmed)
    )


def first_line(text: Column, most: int = 100) -> Column:
    """The first line that isn't blank, trimmed, cut at ``most`` bytes with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), unicode_trim), lambda x: x != "")
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    head = F.make_valid_utf8(F.substring(line.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(line) > most, F.concat(head, F.lit("…"))).otherwise(line)
