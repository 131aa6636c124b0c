"""Defective prompt and response pairs, by a multi-label linear classifier.

Method. A pair (problem statement, reply and its error message) becomes a sparse
vector: hashed word n-grams (one to three words) of the reply's prose, the tokens it
ends with, the words of the error, and pair features: how much of the reply repeats
the statement and what it adds, whether it has a diff, how it ends, in which natural
languages both are, their lengths. One logistic regression per defect is trained on
synthetic defects made from real pairs: replies cut at random places (wherever that
is, also where the rest looks whole), statements copied (quoted, fenced, wrapped,
shortened), replies swapped with those in other languages, refusals, and emptied
replies; each has an error that the table holds for such a reply. Thresholds are
calibrated on held-out synthetic pairs for the best F1. Real pairs that the first
round's model finds defective leave the second round's clean examples. Cues of declining are features beside the n-grams.

The classifier is fitted on at most ``TRAIN_PAIRS`` pairs (the smallest hashes of
the id, so that a rerun fits the same model); all else covers every row. The sample is
taken before the join with the instances; scoring runs over Arrow batches next to it.

Defined results: a null reply is read as an empty text, which the model judges like any other; a null statement has no
words, so its reply is never a copy nor in another language; a null error counts as
no error. At most one defect is reported per prediction, in the order of ``KINDS``. Instances loaded
twice are joined once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.truncation import BROKEN, COMPLETE, MARKED, diff_part, reply_ending
from tarnfold.session import cut

KINDS = ("empty", "refusal", "copy", "other_language", "truncated")
TRAIN_PAIRS = 1000
BUCKETS = 1 << 14
ROUNDS = 16
FOUND = "prediction_id bigint, defect_type string, score double"

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?", re.UNICODE)
_HAN = re.compile(r"[一-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_TICKS = re.compile(r"`[^`\n]*`")
_CODE_LINE = re.compile(r"^(?: {4}|\t|>|[+\-@]|  File |Traceback|diff |index |[\w.]+(?:Error|Exception|Fault): ).*$", re.M)
_BLANK = re.compile(r"[\s​﻿\xa0]|```\w*|~~~\w*|</?\w+>")

#: Frequent short words of each language; words shared by several languages are left out where that matters.
STOPWORDS = {
    "en": "the is and of to in that it with for not be this was on are when but only from has".split(),
    "de": "der die das und ist nicht wird ein eine zu den mit auf für sich dass von im nach wir".split(),
    "fr": "le la les des et est une pas pour dans que qui sur du au avec été ne cette lorsque".split(),
    "es": "el los las y es una no por para que con del se al en su si más cuando pero".split(),
    "pt": "o os as e é uma não por para que com do da em ao se foi mais quando mas".split(),
    "it": "il gli le e è una non per che con del della di sono nel si al più quando ma".split(),
    "pl": "nie jest się na że i w z po przez dla jak ale czy od przed tylko gdy oraz są".split(),
    "ru": "не и в на что это по для из при если после как но только ещё его так когда от".split(),
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _BY_WORD.setdefault(_w, []).append(_lang)
_LETTERS = {"ß": "de", "ñ": "es", "¿": "es", "ã": "pt", "õ": "pt", "ł": "pl", "ę": "pl", "ą": "pl", "ś": "pl", "ż": "pl", "ć": "pl", "ê": "fr", "è": "fr", "ù": "fr", "œ": "fr", "ä": "de"}
LANGS = ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "zh")
_AT = {lang: k for k, lang in enumerate(LANGS)}

#: Cues of declining; a cue is evidence, not a verdict.
CUES = re.compile(
    r"\b(?:can(?:'|’)?t|cannot|can not|could not|unable|not able|won(?:'|’)t|will not|do(?:n(?:'|’)t| not) (?:have|permit|feel|allow)|decline|refuse|refusal|"
    r"not (?:be )?(?:appropriate|comfortable|permitted|allowed|something i can)|inappropriate|rather not|no (?:patch|fix|change) will|outside (?:of )?what|guidelines|sorry|regrettably|unfortunately|"
    r"leider|tut mir leid|darf (?:ich )?nicht|désolée?|ne peux pas|ne suis pas en mesure|refuser|lo siento|no puedo|lamentablemente|desculpe|não posso|infelizmente|"
    r"przepraszam|niestety|nie mogę|odmówić)|извините|к сожалению|не могу|отказ|抱歉|对不起|无法|不能|遗憾", re.I
)

#: Refusals for synthetic pairs; {x} takes a name from the statement.
REFUSALS = (
    "I'm sorry, but I cannot help with that.", "I can't help with this request.", "I am unable to assist with this issue.",
    "I must decline to modify {x}.", "Sorry, I am not able to provide a patch for this.", "As an AI, I can't make changes to repositories.",
    "I'm not comfortable making this change, so I won't attempt it.", "This is outside of what I am allowed to do.",
    "My guidelines don't permit me to write this code.", "I won't be able to produce this fix.", "No fix will be offered, since I can't verify {x}.",
    "It would be inappropriate for me to answer that. Can I do anything else?", "Regrettably I can't support this kind of request.",
    "Unfortunately, I cannot propose edits without seeing the whole repository.", "I have to refuse: {x} may be covered by a licence.",
    "Changing {x} could be unsafe, so I would rather not provide any code.", "I respectfully refuse to answer.", "I do not have the ability to do that and must decline.",
    "Es tut mir leid, aber dabei kann ich nicht helfen.", "Leider kann ich diese Anfrage nicht bearbeiten.", "Ich darf diese Änderung nicht vornehmen.",
    "Désolé, je ne peux pas vous aider.", "Je ne suis pas en mesure de répondre à cette demande.", "Je suis désolé, mais je dois refuser de modifier {x}.",
    "Lo siento, no puedo ayudar con eso.", "No me es posible atender esta solicitud ni modificar {x}.", "Lamentablemente debo rechazar esta petición.",
    "Desculpe, não posso ajudar com isso.", "Infelizmente não consigo atender a este pedido.", "Não posso fornecer essa correção.",
    "Przepraszam, nie mogę w tym pomóc.", "Niestety muszę odmówić wykonania tej prośby.", "Nie mogę przygotować tej poprawki.",
    "Извините, я не могу помочь с этим.", "К сожалению, я не могу выполнить этот запрос.", "Я вынужден отказаться от изменения {x}.",
    "抱歉，我不能帮助处理这个请求。", "对不起，我无法提供这个补丁。", "很遗憾，我不能完成这个请求。",
)
AFTERWORDS = (
    "", "", "", "Please ask the maintainers of {x}.", "You may look at {x} yourself.", "The report mentions {x}, but that needs a review.",
    "If {x} is the cause, somebody else can advise.", "Consider asking a reviewer.",
)
COPY_FORMS = (
    "{s}", "{s}", "```\n{s}\n```", "Issue:\n\n{s}", "Problem:\n{s}", "{s}\n", "Report: {s}", "(as given) {s}", "<issue>\n{s}\n</issue>", "\"{s}\"", "Task:\n\n{s}\n\n---",
)
EMPTIES = ("", " ", "\n\n", "```\n```", "```diff\n```", "<diff></diff>", "\t\n ", "​")


def prose(text: str, parts: tuple[str, str | None] | None = None) -> str:
    """The natural-language part: without diffs, fences, code spans and code-like lines."""
    body = text.replace("\r\n", "\n") if "\r" in text else text
    diff, rest = parts or diff_part(body)
    if diff:
        at = body.find(diff)
        body = body[:at].rstrip("`dif \n") + "\n" + (rest or "")
    if "```" in body or "~~~" in body:
        body = _FENCE.sub("\n", body)
    if "`" in body:
        body = _TICKS.sub(" ", body)
    words = _CODE_LINE.sub("", body).split()
    return " ".join([w for w in words if (w.isalpha() and (w.islower() or w.istitle())) or _natural(w)])


def _natural(word: str) -> bool:
    """Not an identifier, a path or a number."""
    if not word.isascii():
        return True
    core = word.strip(".,;:!?()\"'")
    if core.isalpha():
        return core[1:].islower() or len(core) == 1 or core.isupper()
    return core.replace("'", "").replace("-", "").isalpha()


def languages(text: str) -> np.ndarray:
    """The share of evidence for each of ``LANGS`` in a prose text; zeros if there is next to none."""
    score = np.zeros(len(LANGS))
    plain = text.isascii()
    han, cyr = (0, 0) if plain else (len(_HAN.findall(text)), len(_CYRILLIC.findall(text)))
    score[_AT["zh"]] = han / 3
    score[_AT["ru"]] = cyr / 6
    for w in [w for w in _WORD.findall(text.lower()) if w in _BY_WORD]:
        langs = _BY_WORD[w]
        for lang in langs:
            score[_AT[lang]] += 1.0 / len(langs)
    for ch, lang in () if text.isascii() else _LETTERS.items():
        n = text.count(ch)
        if n:
            score[_AT[lang]] += min(n, 6) * 0.5
    total = score.sum()
    return score / total * min(1.0, total / 3.0) if total > 0 else score


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), dtype=np.int64, count=len(words))


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, dtype=np.int64)
    for k in range(n):
        out = out * 1000003 + h[k : k + len(out)]
    return out


_SENTENCE = re.compile(r"(?<=[.。])\s*")
_TOKENS = re.compile(r"[一-鿿]|[^\W_]+", re.UNICODE)
DENSE = 34
TURNS = 2
#: How often defects are made of each pair, so that no threshold hangs on a few draws; more often for few pairs.
DRAWS, LEAST_PAIRS = 2, 120
#: The clean pair of a table that has none.
STOCK = ("Reader fails on empty input\n\nThe reader raises an error when the file holds no line at all.", "The reader returns early now, and a test covers the empty file.")


@dataclass
class Statement:
    """What is kept of a problem statement."""

    shingles: np.ndarray
    words: int
    langs: np.ndarray
    title: frozenset[str]
    text: str = field(repr=False, default="")


def read_statement(text: str | None) -> Statement:
    text = text or ""
    tokens = _TOKENS.findall(text.lower())
    return Statement(np.unique(_shingles(_hashes(tokens), 3)), len(tokens), languages(prose(text)), frozenset(_TOKENS.findall(text.strip().split("\n", 1)[0].lower())), text)


def _ending(raw: str) -> list[str]:
    """The last tokens by their distance from the end, how the last line begins and what it ends with."""
    last = raw.rstrip().rsplit("\n", 1)[-1]
    tokens = re.findall(r"\w+|[^\w\s]", last)[-4:]
    shapes = ["9" if t[0].isdigit() else ("a" if t.islower() else "A") + str(min(9, len(t))) if t[0].isalpha() else t for t in tokens]
    out = [f"end{len(shapes) - i} {x}" for i, x in enumerate(shapes)] + [f"word {t}" for t in tokens[-1:]]
    return [*out, "line " + last[:1], "ends " + " ".join(shapes[-2:]), "newline" if raw.endswith("\n") else "no newline"]


def features(statement: Statement, raw: str | None, err: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, weights, dense)`` of a pair."""
    raw = raw or ""
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n")
    parts = diff_part(raw)
    diff = parts[0]
    natural = prose(raw, parts)
    words = _TOKENS.findall(natural.lower())
    h = _hashes(words)
    # Replies with a diff have n-grams of their own: an apology before a fix is another feature than one without.
    grams = np.concatenate([h, _shingles(h, 2) ^ 0x5BD1, _shingles(h, 3) ^ 0x2C9B]) ^ (0x1F35A7 if diff else 0)
    buckets = np.abs(grams * 2654435761 % 4294967296) % BUCKETS
    weights = np.full(len(buckets), 1.5 / np.sqrt(max(8, len(buckets))))
    marks = _hashes([*_ending(raw), *("err " + w for w in _TOKENS.findall((err or "").lower()))]) ^ 0x7A3D5
    buckets = np.concatenate([buckets, np.abs(marks * 2654435761 % 4294967296) % BUCKETS])
    weights = np.concatenate([weights, np.full(len(marks), 0.3)])
    # A reply with a diff repeats the statement in its prose only; another one may repeat its code as well.
    tokens = words if diff else _TOKENS.findall(raw.lower())
    s = _shingles(h if diff else _hashes(tokens), 3)
    there = np.searchsorted(statement.shingles, s)
    again = int((statement.shingles[np.minimum(there, len(statement.shingles) - 1)] == s).sum()) if len(s) and len(statement.shingles) else 0
    covered = again / max(1, len(statement.shingles))
    repeated = again / max(1, len(s))
    mine = languages(natural)
    theirs = statement.langs
    blank = not _BLANK.sub("", raw)
    state = reply_ending(raw, parts)
    cues = len(CUES.findall(raw if len(raw) < 400 else natural))
    both = min(mine.sum(), theirs.sum())
    agree = float(mine @ theirs) / max(1e-9, float(np.linalg.norm(mine) * np.linalg.norm(theirs))) if both > 0 else 1.0
    added = len(s) - again
    # The statement's first line names what it is about; stock sentences alone don't make a copy.
    titled = len(statement.title.intersection(tokens)) / len(statement.title) if statement.title and repeated > 0.3 else 0.0
    return buckets, weights, np.array((
        1.0,
        blank,
        state == BROKEN,
        state == MARKED,
        state == COMPLETE and not blank,
        bool(diff),
        bool(diff) and "@@" in diff,
        raw.count("```") % 2,
        repeated,
        repeated > 0.8,
        min(covered, 1.0),
        min(covered, 1.0) * repeated,
        min(1.0, added / 20),
        both * (1 - agree),
        both * (1 - agree) > 0.5,
        both,
        mine.max() if mine.any() else 0.0,
        float(mine.argmax() != theirs.argmax()) * both,
        min(3.0, np.log1p(len(words)) / 2),
        len(words) < 40,
        min(3.0, np.log1p(len(tokens)) / 3),
        not words,
        statement.words == 0,
        repeated > 0.8 and added < 12,
        added < 0.12 * max(1, len(s)) and covered > 0.4,
        repeated > 0.55 and covered > 0.5 and not diff and titled > 0.5,
        min(cues, 3) / 3 if not diff else 0.0,
        cues > 0 and not diff,
        cues > 0 and not diff and len(words) < 30,
        cues > 0 and bool(diff),
        cues > 0 and repeated < 0.3 and not diff,
        titled * repeated,
        titled > 0.7 and repeated > 0.5 and not diff,
        repeated > 0.5 and titled < 0.5,
    ), dtype=np.float64)


Row = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    """One logistic regression per kind: weights of the buckets and of the dense features."""

    sparse: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray

    def scores(self, row: Row) -> np.ndarray:
        buckets, weights, dense = row
        return weights @ self.sparse[buckets] + dense @ self.dense


#: How fast the n-gram weights of each kind learn; the kinds that pair features define hardly need any.
SPARSE_RATE = np.array([0.1, 0.3, 0.02, 0.02, 0.1])
BATCH = 32


def _fit(rows: list[Row], labels: np.ndarray, seed: int) -> Model:
    """AdaGrad over batches in random order, all kinds at once."""
    rng = np.random.RandomState(seed)
    kinds = labels.shape[1]
    sparse, dense = np.zeros((BUCKETS, kinds)), np.zeros((DENSE, kinds))
    g_sparse, g_dense = np.full((BUCKETS, kinds), 0.05), np.full((DENSE, kinds), 0.05)
    x_dense = np.array([r[2] for r in rows], dtype=np.float64)
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            sizes = [len(rows[i][0]) for i in part]
            at = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            z = x_dense[part] @ dense
            np.add.at(z, owner, value[:, None] * sparse[at])
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            gd = x_dense[part].T @ error / len(part) * 4
            g_dense += gd * gd
            dense -= 0.3 * gd / np.sqrt(g_dense)
            used, inverse = np.unique(at, return_inverse=True)
            gs = np.zeros((len(used), kinds))
            np.add.at(gs, inverse, value[:, None] * error[owner])
            gs = gs / len(part) * 4 + 1e-5 * sparse[used]
            g_sparse[used] += gs * gs
            sparse[used] -= SPARSE_RATE * gs / np.sqrt(g_sparse[used])
    return Model(sparse, dense, np.zeros(kinds))


def _calibrate(model: Model, rows: list[Row], labels: np.ndarray) -> Model:
    """Each kind's threshold: the middle of the range with the best F1 on held-out pairs."""
    scores = np.array([model.scores(r) for r in rows])
    for k in range(labels.shape[1]):
        order = np.argsort(-scores[:, k])
        hit = labels[order, k]
        if hit.sum() < 3 or len(hit) - hit.sum() < 3:  # nothing to calibrate on: the kind is never reported
            model.thresholds[k] = 1e9
            continue
        tp = np.cumsum(hit)
        f1 = 2 * tp / (np.arange(1, len(hit) + 1) + max(1.0, hit.sum()))
        best = int(f1.argmax())
        above = scores[order[best], k]
        below = scores[order[min(best + 1, len(order) - 1)], k]
        model.thresholds[k] = (above + below) / 2
    return model


def _name(text: str, rng: np.random.RandomState) -> str:
    names = re.findall(r"`[^`]+`|\b\w+[_/.]\w+\b", text)[:200]
    return names[rng.randint(len(names))] if names else "the module"


def _state(raw: str) -> int:
    """What a pipeline's error mostly depends on: no text, no diff, or a diff."""
    return 2 if diff_part(raw)[0] else 1 if _BLANK.sub("", raw) else 0


Pair = tuple[Statement, str, str]


def synthesize(
    pairs: list[Pair], replies: list[tuple[str, np.ndarray]], errors: dict[int, list[str]], rng: np.random.RandomState
) -> tuple[list[Row], list[list[float]]]:
    """Rows and labels: each clean pair, and defects made of it.

    ``replies`` with their languages serve for swaps; ``errors`` are those of real replies of each state.
    """
    rows: list[Row] = []
    labels: list[list[float]] = []

    def add(statement: Statement, raw: str, *kinds: str, err: str | None = None) -> None:
        known = errors.get(_state(raw)) or [""]
        rows.append(features(statement, raw, known[rng.randint(len(known))] if err is None else err))
        labels.append([float(k in kinds) for k in KINDS])

    # Replies by language, so that a swap meets rare languages as well.
    by_tongue: dict[int, list[str]] = {}
    for raw, tongue in replies:
        if tongue.sum() > 0.9:
            by_tongue.setdefault(int(tongue.argmax()), []).append(raw)
    for n, (statement, raw, err) in enumerate(pairs):
        add(statement, raw, err=err)
        if n % 6 == 0:
            add(statement, EMPTIES[rng.randint(len(EMPTIES))], "empty")
        if len(raw) > 80 and n % 2 == 0:
            cut_at = rng.randint(len(raw) // 20 + 20, len(raw) - 5)
            part = raw[:cut_at]
            if rng.rand() < 0.1:
                part += ("…", " [cut]", "\n[... truncated]")[rng.randint(3)]
            add(statement, part, "truncated")
        if len(statement.text) > 60 and n % 2 == 1:
            text = statement.text
            if rng.rand() < 0.25:
                keep = text[: rng.randint(len(text) // 2, len(text))]
                text = keep[: keep.rfind(".") + 1] or text
            form = rng.rand()
            if form < 0.25:
                text = "\n".join("> " + x for x in text.split("\n"))
            elif form < 0.4:  # copied with small changes
                text = "".join(c for c in text if c != "_" or rng.rand() < 0.3)
                text = " ".join(w.lower() if rng.rand() < 0.3 else w for w in text.split(" ") if rng.rand() > 0.03)
            add(statement, COPY_FORMS[rng.randint(len(COPY_FORMS))].replace("{s}", text), "copy")
        if n % 3 == 0:
            words = REFUSALS[rng.randint(len(REFUSALS))] + " " + AFTERWORDS[rng.randint(len(AFTERWORDS))]
            add(statement, words.replace("{x}", _name(statement.text, rng)).strip(), "refusal")
        if n % 9 == 4:  # an apology before a fix is no refusal
            add(statement, "Sorry for the delay, I cannot test all of it. " + raw)
        if n % 9 == 7 and not diff_part(raw)[0]:  # nor is one before an explanation
            add(statement, "Sorry for the wait. I can't test this here. " + raw)
        sentences = [x for x in _SENTENCE.split(statement.text.split("\n", 1)[-1]) if 20 < len(x) < 300 and "\n" not in x]
        if n % 9 == 2 and len(sentences) > 2:  # nor do some of the statement's sentences make one
            picked = [sentences[i] for i in rng.permutation(len(sentences))[: rng.randint(2, 6)]]
            add(statement, " ".join(picked))
        if n % 9 == 5 and statement.text:  # a quotation before an answer is no copy
            add(statement, "> " + statement.text.split("\n")[0] + "\n\n" + raw)
        others = [t for t in by_tongue if t != statement.langs.argmax()]
        if others and statement.langs.sum() > 0.5:
            pool = by_tongue[others[rng.randint(len(others))]]
            add(statement, pool[rng.randint(len(pool))], "other_language")
    return rows, labels


def _credible(statement: Statement, raw: str) -> bool:
    """Fit to be a clean example. Doubtful pairs stay unlabelled: they are scored, but not learnt from."""
    if not diff_part(raw)[0] and CUES.search(raw):
        return False
    mine = languages(prose(raw))
    if min(mine.sum(), statement.langs.sum()) > 0.5 and mine.argmax() != statement.langs.argmax():
        return False
    _, _, dense = features(statement, raw)
    return not (dense[8] > 0.8 and dense[10] > 0.4)


def train(pairs: list[tuple[str | None, str | None, str | None]], seed: int = 3) -> Model:
    """The second round leaves real pairs out that the first finds defective."""
    real = [(read_statement(s), r or "", e or "") for s, r, e in pairs]
    errors: dict[int, list[str]] = {}
    for _, r, e in real:
        errors.setdefault(_state(r), []).append(e)
    replies = [(r, languages(prose(r))) for _, r, _ in real if reply_ending(r) == COMPLETE and _state(r)]
    base = [(s, r, e) for s, r, e in real if _state(r) and reply_ending(r) == COMPLETE and _credible(s, r)]
    base = base or [(read_statement(STOCK[0]), STOCK[1], "")]
    model = None
    for turn in range(TURNS):
        if model is not None:
            over = [model.scores(features(*p)) - model.thresholds for p in real]
            fine = {id(p[0]) for p, x in zip(real, over, strict=True) if not (x > 0).any()}
            base = [p for p in base if id(p[0]) in fine] or base
        rng = np.random.RandomState(seed + turn)
        draws = [synthesize(base, replies, errors, rng) for _ in range(max(DRAWS, -(-LEAST_PAIRS // len(base))))]
        rows, labels = [r for d in draws for r in d[0]], [x for d in draws for x in d[1]]
        target = np.array(labels)
        held = np.arange(len(rows)) % 4 == 3
        fitted = _fit([r for r, h in zip(rows, held, strict=True) if not h], target[~held], seed)
        model = _calibrate(fitted, [r for r, h in zip(rows, held, strict=True) if h] or rows, target[held] if held.any() else target)
    return model


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Statement] = {}
        for batch in batches:
            out = []
            for i, text, raw, err in zip(batch.prediction_id, batch.problem_statement, batch.raw, batch.err, strict=True):
                statement = seen.get(text or "")
                if statement is None:
                    if len(seen) > 64:
                        seen.clear()
                    statement = seen[text or ""] = read_statement(text)
                over = model.scores(features(statement, raw, err)) - model.thresholds
                kind = next((k for k, x in enumerate(over) if x > 0), None)
                if kind is not None:
                    out.append((i, KINDS[kind], float(over[kind])))
            yield pd.DataFrame(out, columns=["prediction_id", "defect_type", "score"])

    return run


def joined_pairs(predictions: DataFrame, instances: DataFrame) -> DataFrame:
    """``(prediction_id, raw, err, problem_statement)``; an instance loaded twice counts once."""
    statements = instances.groupBy("instance_id").agg(F.min("problem_statement").alias("problem_statement"))
    return predictions.select("prediction_id", "instance_id", "raw", "err").join(statements, "instance_id", "left").drop("instance_id")


def fit_classifier(predictions: DataFrame, instances: DataFrame, bound: int = TRAIN_PAIRS) -> Model:
    """The model of about ``bound`` pairs, those of the smallest hashes; never of more than twice as many."""
    share = min(1.0, bound / max(1, predictions.count()))
    taken = predictions.where(F.pmod(F.xxhash64("prediction_id", F.lit(7)), F.lit(10_000_000)) < F.lit(int(share * 10_000_000))).limit(2 * bound)
    taken = cut(taken.select("prediction_id", "instance_id", "raw", "err"))
    some = instances.join(F.broadcast(taken.select("instance_id").distinct()), "instance_id", "left_semi")  # at most 2 * bound ids
    sample = sorted(joined_pairs(taken, some).collect(), key=lambda r: r.prediction_id)
    return train([(r.problem_statement, r.raw, r.err) for r in sample])


def defects(predictions: DataFrame, instances: DataFrame, bound: int = TRAIN_PAIRS) -> DataFrame:
    """``(prediction_id, defect_type, score)`` of each defective pair."""
    return joined_pairs(predictions, instances).mapInPandas(_score(fit_classifier(predictions, instances, bound)), FOUND)


def found(predictions: DataFrame, instances: DataFrame) -> DataFrame:
    """``(prediction_id, defect_type)``, at most one row per prediction."""
    return defects(predictions, instances).groupBy("prediction_id").agg(F.min_by("defect_type", -F.col("score")).alias("defect_type"))
