"""Credentials in source code, configuration and documentation: found and redacted.

Method. Each detection regex is parsed, and the trigrams that any match must
contain are derived from it as a formula of ANDs and ORs. Chunks are indexed in
blocks: for each required trigram a posting list of the chunks of the block that
hold it (in lower case). The formulas are evaluated on the posting lists, and a
regex runs on the candidates of its formula only. A match is verified by its
value: placeholders, references to the environment or a vault, words, public keys,
digests and ids are no credentials. The index is local to a block, so no content
is shuffled; ``trigram_index`` gives the postings themselves as a table.

Places are file lines (the chunk's first line plus the line within it), each
once, however many chunks hold the line. ``redacted`` replaces the credential's
characters only (line ends within it stay), so quotes, indentation and line
numbers of the surrounding code remain.

Defined results: null and empty contents hold nothing; a null start line counts
as 1; chunks delivered again add no line; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import re._parser as sre
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
MASK = "[REDACTED]"

# --------------------------------------------------------------------------- values

#: Values that stand for another one: masks, references to a variable, a template or a store.
_REFERENCE = re.compile(
    r"^(?:<.*>?|\{.*|\*+|[xX]+|\.+|-+|_+|#+|\[.*\]?|(?:x{3,}[-_]?)+|%[A-Za-z_]\w*%|%[sdr]|%\(\w+\)s|\$[A-Z_][A-Z0-9_]*|\$[a-z_]+)$|"
    r"\$\{|\$\(|\{\{|getenv|\benviron\b|process\.env|\bvault\b|secrets?[./:]|^env[.:]|^os\.|^ref:|^arn:|^file:",
    re.I,
)
_REFERENCE_CASED = re.compile(r"^\$(?:[A-Z_][A-Z0-9_]*|[a-z_]+)$")
#: Words that make a placeholder of the value that begins with them, or that holds them anywhere.
_OPENING = frozenset("your my replace change insert enter put todo fixme dummy example sample fake placeholder redacted changeme not some any the".split())
_ANYWHERE = frozenset("placeholder redacted changeme replaceme dummy fixme todo notreal".split())
_PLAIN = frozenset("none null nil true false undefined empty test secret password passwd token bearer basic string str value key username user admin root".split())
_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z_]*$")


def placeholder(value: str) -> bool:
    """The value only stands for a secret. Whole words decide: ``sampler`` is no ``sample``."""
    if _REFERENCE.search(value) and not (value.startswith("$") and value[1:].isalnum() and not _REFERENCE_CASED.match(value)):
        return True
    if value.lower() in _PLAIN:
        return True
    words = [w for w in re.split(r"[^A-Za-z]+", value.lower()) if w]
    return bool(words) and (words[0] in _OPENING and value[0].isalpha() or not _ANYWHERE.isdisjoint(words))


def entropy(text: str) -> float:
    """Bits per character of a text's own distribution."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def jumbled(value: str) -> bool:
    """Letters that change case too often to be words."""
    runs = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)
    return len(value) >= 8 and len(runs) >= 3 and len(value) < 3 * len(runs)


def live(value: str, least: int = 6) -> bool:
    """The value looks like a real secret: no placeholder, reference, word or identifier."""
    v = value.strip().strip("\"'`")
    if len(v) < least or any(c.isspace() for c in v) or placeholder(v) or "(" in v and v.endswith(")"):
        return False
    if _IDENTIFIER.match(v):
        return jumbled(v)
    return len(set(v)) >= 4 and bool(re.search(r"\d|[^\w\s]", v))


def mixed(value: str) -> bool:
    """A live value that prose would hardly hold: letters with digits, or with marks that words don't have."""
    v = value.rstrip(".,;)")
    if not live(v) or re.match(r"v?\d[\d.,:x/-]*\w{0,2}$", v) or re.search(r"^[\w.-]+/|://|^[\w-]+(?:\.[a-z]{1,5})+$", v):
        return False
    return bool(re.search(r"[A-Za-z]", v) and re.search(r"\d|[!@#^&*?%~+=$]", v)) or jumbled(v)


def random_like(value: str) -> bool:
    """A long value of digits and letters in no word's order."""
    return long_live(value) and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value))


def long_live(value: str) -> bool:
    return live(value, 12) and entropy(value) > 2.8


def login(value: str) -> bool:
    """The password of a login pair in an address; any literal text counts."""
    return len(value) >= 4 and not placeholder(value)


def basic(value: str) -> bool:
    """Base64 of ``user:password``."""
    text = decoded(value)
    return text is not None and ":" in text and login(text.split(":", 1)[1])


def decoded(value: str) -> str | None:
    """Printable text of a base64 or hex literal."""
    for read in (lambda v: base64.b64decode(v + "=" * (-len(v) % 4), validate=True), bytes.fromhex):
        try:
            text = read(value).decode("ascii")
        except (ValueError, binascii.Error, UnicodeDecodeError):
            continue
        if len(text) >= 6 and text.isprintable():
            return text
    return None


_SECRET_TEXT = re.compile(r"(?i)(?:secret|passw|pwd|token|api_?key|credential)\w*\s*[=:]\s*\S{4,}|^\w+:[^\s:/]{5,}$")


def encoded(value: str) -> bool:
    """A literal that decodes to a text naming a secret, or to a login pair."""
    text = decoded(value)
    return text is not None and bool(_SECRET_TEXT.search(text))


def anything(value: str) -> bool:
    return True


def bearer(value: str) -> bool:
    return live(value, 12) and bool(re.search(r"\d", value))


# --------------------------------------------------------------------------- regexes

#: A name that says secret: long words anywhere in it, short ones as words of their own.
NAMED = (
    r"(?:passw(?:or)?d|passphrase|passcode|secret|token(?!i[sz])|credential|api[_.-]?key|(?:access|auth|private|signing|encryption|session|master|license)[_.-]?key|"
    r"(?<![a-z])(?:pass|pwd|auth|authz|authtoken|(?=pw[ =:_\"'.)12])pw)\d*(?![a-z]))"
)
_QUOTED = r"[\"'`]([^\"'`\n]+)[\"'`]"
_ASSIGN = r"[\"']?\]?\s*(?::=|=>|===?|!==?|[=:,(])\s*(?:\w[\w.]*\()?\(?\s*[rbuf]?"


@dataclass(frozen=True)
class Detector:
    """A regex whose last group that matched is the secret; ``check`` verifies it."""

    name: str
    regex: str
    check: Callable[[str], bool]
    unquoted: bool = False

    @property
    def local(self) -> bool:
        """A match lies within a line that holds a keyword, and the next one."""
        return self.name.startswith("named")

    @property
    def pattern(self) -> re.Pattern:
        return _compiled(self.regex)


@cache
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.M)


DETECTORS = (
    Detector("forge token", r"\b((?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{12,}|github_pat_\w{20,}|glpat-[\w-]{16,})", long_live),
    Detector("cloud key", r"\b((?:AKIA|ASIA)[A-Z0-9]{14,16})\b", anything),
    Detector("chat token", r"\b(xox[a-z]-[A-Za-z0-9-]{8,})", long_live),
    Detector("signed token", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?)", lambda v: len(v) >= 20),
    Detector("live key", r"\b([a-z]{2,8}_(?:live|prod)_[A-Za-z0-9]{8,})", long_live),
    Detector("live key", r"\b([a-z]{2,8}-(?:live|prod)-[A-Za-z0-9]{8,})", long_live),
    Detector("provider key", r"\b(AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|lrk_[A-Za-z0-9]{12,}|AGE-SECRET-KEY-\w{20,})", long_live),
    Detector("private key", r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)", anything),
    Detector("address login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'`<>]{1,64}:([^\s@/\"'`]{3,})@[\w.\[-]", login),
    Detector("connection string", r"(?i);\s*(?:password|pwd)\s*=\s*([^;\"'\s]{4,})", live),
    Detector("authorization", r"(?i)\bbearer\s+([A-Za-z0-9._~+/=-]{12,})", bearer),
    Detector("authorization", r"(?i)\bbasic\s+([A-Za-z0-9+/]{8,}={0,2})", basic),
    Detector("header", r"(?i)\bx-(?:api-key|auth-token|access-token|secret)[\"']?\s*[:,=]\s*[\"']?([A-Za-z0-9._~+/=-]{8,})", long_live),
    Detector("address parameter", r"(?i)[?&](?:access_token|api_?key|auth_token|sig|signature|token|secret|client_secret|password)=([A-Za-z0-9._~+/%=-]{8,})", long_live),
    Detector("address parameter", r"(?i)[?&]key=([A-Za-z0-9._~+/%=-]{16,})", random_like),
    Detector("encoded", r"(?i)(?:decode\w*|atob|fromhex|unhexlify)\s*\(\s*[\"'`]([A-Za-z0-9+/=_-]{10,})[\"'`]", encoded),
    Detector("named literal", r"(?i)" + NAMED + r"\w*" + _ASSIGN + _QUOTED, live),
    Detector("named value", r"(?i)^[ \t]*[#;]?[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\w./:-]*" + NAMED + r"[\w.-]*[ \t]*[=:][ \t]*([^\s\"'`]{6,})[ \t]*\r?$", live, True),
    Detector("named value", r"(?i)\bname:[ \t]*[\"']?\w*(?:secret|token|password|passwd|pwd|key|auth|pass)\w*[\"']?[ \t]*\r?\n[ \t]*value:[ \t]*[\"']?([^\s\"']{6,})", live, True),
    Detector("named remark", r"(?i)(?:#|//|/\*|^[ \t]*\*|--|<!--)[^\n]*?" + NAMED + r"\w*[ \t]*(?:[=:]|is|was)[ \t]+[\"'`]?([^\s\"'`]{6,})", mixed),
    Detector("named element", r"(?i)<[\w.:-]*" + NAMED + r"[\w.-]*>([^<\s]{4,})</", live),
    Detector("named element", r"(?i)\b(?:name|key)=[\"'][\w.-]*" + NAMED + r"[\w.-]*[\"']\s+value=[\"']([^\"'\s]{4,})[\"']", live),
    Detector("login pair", r"(?:^|[ \t:(])[\"'`]?[A-Za-z][\w.@+-]{1,}[\"'`]? / [\"'`]?(\S{6,}?)[\"'`]?[ \t.,;)]*\r?$", mixed),
    Detector("command login", r"\b(?:curl|wget|http|ftp)\b[^\n]*?(?: -u|--user)[ =]+[\"']?[\w.@-]{2,}:([^\s\"':]{4,})", live),
    Detector("command login", r"\bsshpass\b[^\n]*?[ \t]-p[ \t]*[\"']?([^\s\"']{4,})", live),
    Detector("command login", r"\b(?:mysql|mariadb)\w*\b[^\n]*?[ \t]-p[\"']?([^\s\"']{4,})", live),
    Detector("command login", r"\b(?:redis-cli\b[^\n]*?[ \t]-a|ldap\w+\b[^\n]*?[ \t]-w|unzip\b[^\n]*?[ \t]-P)[ \t]+[\"']?([^\s\"']{4,})", live),
    Detector("command login", r"\becho[ \t]+(?:-n[ \t]+)?[\"']?([^\s\"'|]{6,})[\"']?[ \t]*\|[^\n]*--password-stdin", live),
    Detector("command login", r"(?i)\blogin\s+\S+\s+password\s+(\S{4,})", live),
    Detector("command login", r"(?i)--(?:password|token|secret|api-key)[ =]+[\"']?([^\s\"']{6,})", live),
)

#: What a name ends with, or holds as a phrase, if its value looks alike but protects nothing.
_HARMLESS_WORDS = frozenset(
    "digest checksum sha sha1 sha256 sha512 md5 hash integrity commit trace placeholder field label name url uri endpoint type file path dir expected pinned icon pattern regex header prefix length count limit ttl".split()
)
_HARMLESS_PHRASE = re.compile(r"(?i)public[_-]?key|request[_-]?id|trace[_-]?id")
_NAME_LEFT = re.compile(r"([\w.-]+)[\"']?\]?\s*(?::=|=>|===?|!==?|[=:])\s*\(?\s*[rbuf]?[\"'`]?$")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])\d*|[A-Z]?[a-z]+\d*|\d+")
_CONFIG = re.compile(r"(?:\.(?:env|local|ini|cfg|conf|ya?ml|properties|toml|npmrc|sh|bash|md|rst|txt|netrc|pypirc)|/\.?env[\w.]*|Dockerfile\w*)$|(?:^|/)\.\w[\w.]*$", re.I)


# --------------------------------------------------------------------------- trigrams

Formula = tuple  # ("any",) | ("all", [formulas]) | ("one", [formulas]) | ("tri", code)
ANY: Formula = ("any",)


def _code(tri: str) -> int:
    a, b, c = tri.encode("latin-1")
    return a << 16 | b << 8 | c


def required(regex: str) -> Formula:
    """The formula of trigrams (in lower case) that each match of the regex must contain."""
    return _formula(sre.parse(regex, re.M))


def _all(parts: list[Formula]) -> Formula:
    flat = [p for p in parts if p != ANY]
    return ANY if not flat else flat[0] if len(flat) == 1 else ("all", flat)


def _one(parts: list[Formula]) -> Formula:
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("one", parts)


def _literal(text: str) -> Formula:
    low = text.lower()
    if len(low) < 3 or not low.isascii():
        return ANY
    return _all([("tri", _code(low[i : i + 3])) for i in range(len(low) - 2)])


def _alternatives(node: list) -> list[str] | None:
    """The exact strings that a short piece of a regex stands for, if they are few."""
    out = [""]
    for op, arg in node:
        if op is sre.LITERAL:
            options = [chr(arg)]
        elif op is sre.SUBPATTERN:
            options = _alternatives(arg[3])
        elif op is sre.BRANCH:
            options = []
            for branch in arg[1]:
                got = _alternatives(branch)
                if got is None:
                    return None
                options += got
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 12:
            options = [chr(a) for _, a in arg]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            got = _alternatives(arg[2])
            options = None if got is None else ["", *got]
        elif op is sre.AT:
            options = [""]
        else:
            return None
        if options is None or len(out) * len(options) > 64:
            return None
        out = [a + b for a in out for b in options]
    return out


def _formula(node) -> Formula:
    parts: list[Formula] = []
    piece: list = []

    def close() -> None:
        if piece:
            got = _alternatives(piece)
            parts.append(_one([_literal(t) for t in got]) if got else _all([_inside(x) for x in piece]))
            piece.clear()

    for item in node:
        if _alternatives([*piece, item]) is not None:
            piece.append(item)
        else:
            close()
            if _alternatives([item]) is not None:
                piece.append(item)
            else:
                parts.append(_inside(item))
    close()
    return _all(parts)


def _inside(item) -> Formula:
    op, arg = item
    if op is sre.SUBPATTERN:
        return _formula(arg[3])
    if op is sre.BRANCH:
        return _one([_formula(b) for b in arg[1]])
    if op is sre.ASSERT and arg[0] > 0:
        return _formula(arg[1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _formula(arg[2])
    return ANY


def _trigrams(formula: Formula) -> set[int]:
    if formula[0] == "tri":
        return {formula[1]}
    return set().union(*(_trigrams(f) for f in formula[1])) if len(formula) > 1 else set()


class TrigramIndex:
    """Posting lists of the required trigrams over a block of texts."""

    def __init__(self, codes: list[int]):
        self.codes = codes
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        self.slot[codes] = np.arange(len(codes))
        self._lower = np.arange(256, dtype=np.uint8)
        self._lower[65:91] += 32

    def postings(self, texts: list[str]) -> np.ndarray:
        """A row per trigram, a column per text: the posting lists as bit rows."""
        raw = [t.encode("utf-8", "replace") + b"\0\0" for t in texts]
        sizes = np.array([len(r) for r in raw])
        data = self._lower[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int32)
        slots = self.slot[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(slots >= 0)
        owner = np.searchsorted(np.cumsum(sizes), at, side="right")
        table = np.zeros((len(self.codes), len(texts)), dtype=bool)
        table[slots[at], owner] = True
        return table

    def candidates(self, formula: Formula, table: np.ndarray) -> np.ndarray:
        if formula == ANY:
            return np.ones(table.shape[1], dtype=bool)
        if formula[0] == "tri":
            return table[self.slot[formula[1]]]
        rows = [self.candidates(f, table) for f in formula[1]]
        return np.logical_and.reduce(rows) if formula[0] == "all" else np.logical_or.reduce(rows)


@cache
def _plan() -> tuple[TrigramIndex, tuple[Formula, ...]]:
    formulas = tuple(required(d.regex) for d in DETECTORS)
    codes = sorted(set().union(*map(_trigrams, formulas)))
    return TrigramIndex(codes), formulas


# --------------------------------------------------------------------------- search

_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _key_body(text: str, begin: int, end: int) -> bool:
    """Key material follows a private key's first line (or the chunk ends there)."""
    body = re.sub(r"\\n|\\r|[\s\"'+#/*>|]+", "\n", text[begin:end]).strip()
    if not body:
        return True
    # Headers (Comment, Proc-Type, DEK-Info) name themselves before a colon; what follows them is judged.
    lines = [x for x in body.split("\n") if x]
    head = "".join(x for x in lines if ":" not in x and "," not in x)
    return bool(re.search(r"[A-Za-z0-9+/=]{16,}", head)) and not placeholder(lines[0])


_KEYWORDS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "credential")


def _keyword_spans(text: str) -> list[tuple[int, int]]:
    """The lines that hold a keyword, each with the next line; the regexes of names run on these only."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    spans: list[tuple[int, int]] = []
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            begin = text.rfind("\n", 0, at) + 1
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            spans.append((begin, end))
            at = low.find(word, end)
    spans.sort()
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        line = text[begin:end]
        # An assignment or a key has one of these; prose that only mentions the word is left out.
        if "=" not in line and ":" not in line and "(" not in line and "," not in line and " is " not in line and " was " not in line and ">" not in line:
            continue
        after = text.find("\n", end + 1)
        end = len(text) if after < 0 else after
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _harmless(text: str, begin: int) -> bool:
    """The name left of a literal says that it protects nothing; its last word decides."""
    line = text[text.rfind("\n", 0, begin) + 1 : begin]
    name = _NAME_LEFT.search(line)
    if not name:
        return False
    words = [w.lower() for w in _NAME_WORDS.findall(name.group(1))]
    return bool(words) and (words[-1] in _HARMLESS_WORDS or words[-1].rstrip("0123456789") in _HARMLESS_WORDS) or bool(_HARMLESS_PHRASE.search(name.group(1)))


def secrets(text: str, path: str | None, which: list[int]) -> list[tuple[int, int, str]]:
    """``(begin, end, detector)`` of each credential in a text, by the given detectors, without overlaps."""
    found: list[tuple[int, int, str]] = []
    config = bool(_CONFIG.search(path or ""))
    spans = None
    for k in which:
        d = DETECTORS[k]
        if d.unquoted and not config:
            continue
        if d.local:
            spans = _keyword_spans(text) if spans is None else spans
            matches = [m for a, b in spans for m in d.pattern.finditer(text, a, b)]
        else:
            matches = d.pattern.finditer(text)
        for m in matches:
            group = m.lastindex
            value, begin, end = m.group(group), m.start(group), m.end(group)
            if d.name == "private key":
                tail = _KEY_END.search(text, end)
                if not _key_body(text, end, tail.start() if tail else len(text)):
                    continue
                end = tail.end() if tail else len(text)
            elif not d.check(value):
                # A literal may be too short to judge before those joined to it are read as well.
                if not (d.name == "named literal" and (encoded(value) or live(_joined(text, begin, end)))):
                    continue
            if d.name.startswith("named") and _harmless(text, begin):
                continue
            found.append((begin, end, d.name))
    found.sort()
    out: list[tuple[int, int, str]] = []
    for item in found:
        if out and item[0] < out[-1][1]:
            if item[1] > out[-1][1]:
                out[-1] = (out[-1][0], item[1], out[-1][2])
        else:
            out.append(item)
    return out


_MORE = re.compile(r"[\"'`]\s*\\?\s*[+.]?\s*(?:\r?\n\s*)?\+?\s*\(?\s*[rbuf]?[\"'`]([^\"'`\s]+)(?=[\"'`])")


def _pieces(text: str, end: int) -> list[tuple[int, int]]:
    """The places of the literals that are joined to the one that ends at ``end``."""
    out = []
    while m := _MORE.match(text, end):
        if not re.search(r"\+|\n", text[end : m.start(1)]):
            break
        out.append(m.span(1))
        end = m.end()
    return out


def _joined(text: str, begin: int, end: int) -> str:
    return text[begin:end] + "".join(text[a:b] for a, b in _pieces(text, end))


def redact(text: str, places: list[tuple[int, int, str]], mask: str = MASK) -> str:
    """The text with only the credentials replaced; quotes, joints and line ends within them stay."""
    out, at = [], 0
    for begin, end, name in places:
        out.append(text[at:begin])
        pieces = [] if name == "private key" else _pieces(text, end)
        stop = pieces[-1][1] if pieces else end
        inside = text[begin:stop]
        if name == "private key":
            head = re.match(r"-----BEGIN[^-]*-----", inside).group()
            foot = re.search(r"-----END[^-]*-----$", inside)
            body = inside[len(head) : len(inside) - (len(foot.group()) if foot else 0)]
            body = re.sub(r"[A-Za-z0-9+/=]{8,}", mask, re.sub(r"\\n", "\\n", body))
            out.append(head + body + (foot.group() if foot else ""))
        else:
            # The joined literals stay as empty ones.
            cuts = [end, *(x for piece in pieces for x in piece)]
            out.append(mask + "".join(text[a:b] for a, b in zip(cuts[0::2], cuts[1::2])))
        at = stop
    out.append(text[at:])
    return "".join(out)


PLACES = "chunk_id bigint, corpus_id string, path string, line_no bigint, begin int, end int, kind string"
REDACTED = "chunk_id bigint, corpus_id string, path string, n_credentials int, content string"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[tuple[int, int, str]]]]:
    """Rows with their credentials, block by block through the trigram index."""
    index, formulas = _plan()
    for batch in batches:
        batch = batch[batch.content.notna()]
        for lo in range(0, len(batch), BLOCK):
            block = batch.iloc[lo : lo + BLOCK]
            table = index.postings(block.content.tolist())
            hits = np.array([index.candidates(f, table) for f in formulas])
            for i, row in enumerate(block.itertuples(index=False)):
                which = np.flatnonzero(hits[:, i])
                if len(which):
                    got = secrets(row.content, row.path, which.tolist())
                    if got:
                        yield row, got


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for row, got in _blocks(batches):
        first = 1 if row.start_line is None or row.start_line != row.start_line else int(row.start_line)
        for begin, end, kind in got:
            rows.append((row.chunk_id, row.corpus_id, row.path, first + row.content.count("\n", 0, begin), begin, end, kind))
        if len(rows) >= 4096:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])
            rows = []
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in REDACTED.split(", ")]
    rows, size = [], 0
    for row, got in _blocks(batches):
        rows.append((row.chunk_id, row.corpus_id, row.path, len(got), redact(row.content, got)))
        size += len(row.content)
        if size >= 1 << 22:
            yield pd.DataFrame(rows, columns=names)
            rows, size = [], 0
    yield pd.DataFrame(rows, columns=names)


def _chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "corpus_id", "path", "start_line", "content").where("content is not null and content <> ''")


def places(chunks: DataFrame) -> DataFrame:
    """Every credential of every chunk, with its file line and its place in the content."""
    return _chunks(chunks).mapInPandas(_find, PLACES)


def redacted(chunks: DataFrame) -> DataFrame:
    """The chunks that hold credentials, with only these replaced in their content."""
    return _chunks(chunks).mapInPandas(_redact, REDACTED)


def trigram_index(chunks: DataFrame) -> DataFrame:
    """``(trigram, chunk_id)``: the postings of the trigrams that the detectors require."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, _ = _plan()
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                block = batch.iloc[lo : lo + BLOCK]
                tri, col = np.nonzero(index.postings(block.content.tolist()))
                text = np.array([c.to_bytes(3, "big").decode("latin-1") for c in index.codes])
                yield pd.DataFrame({"trigram": text[tri], "chunk_id": block.chunk_id.to_numpy()[col]})

    return _chunks(chunks).select("chunk_id", "content").mapInPandas(run, "trigram string, chunk_id bigint")


def found(chunks: DataFrame) -> DataFrame:
    """``(corpus_id, path, line_no)`` of each line on which a credential begins."""
    return places(chunks).select("corpus_id", "path", "line_no").distinct()
