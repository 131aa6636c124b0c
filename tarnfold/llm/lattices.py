"""Sets of texts as lattices, for tokens with more readings than can be listed.

A lattice is an acyclic automaton: node 0 is the start, nodes are in topological
order, an edge ``(target, characters)`` holds a set of characters as the bits of one
integer. Decoding, mapping and choosing work on whole sets, so readings needn't be
listed and none is left out. Nodes and lattices multiply with each round of decoding.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

ASCII = (1 << 128) - 1
_ALL = (1 << 0x110000) - 1
LOST_BIT = 1 << 0xFFFD
C1 = ((1 << 32) - 1) << 0x80
#: Bytes that a lost one may be: all that UTF-8 has outside ASCII.
_WILD = sum(1 << b for b in range(0x80, 0xF5))
#: Code points that two, three and four bytes may stand for.
_VALID = {2: ((1 << 0x800) - 1) & ~ASCII, 3: ((1 << 0x10000) - 1) & ~((1 << 0x800) - 1) & ~(((1 << 0x800) - 1) << 0xD800), 4: _ALL & ~((1 << 0x10000) - 1)}
_LEADS = ((2, 0xC0, 32), (3, 0xE0, 16), (4, 0xF0, 8))
_HAN = (
    (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x16FE2, 0x16FE3), (0x16FF0, 0x16FF1), (0x20000, 0x323AF),
)
#: A span of a lattice asks for units by one character if it can be at most so many there, else by length.
ASKED = 64


class Lattice(NamedTuple):
    edges: tuple[tuple[tuple[int, int], ...], ...]
    finals: frozenset[int]


class Table(NamedTuple):
    """What code points become: one or two bytes, or a character."""

    of: dict[int, bytes] | dict[int, str]
    domain: int
    double: bool
    classes: dict

    def after(self, utf8) -> dict:
        """State as UTF-8 after a character -> the characters that lead to it from ``utf8``."""
        if utf8 not in self.classes:
            groups: dict = {}
            for c, raw in self.of.items():
                then = utf8
                for b in raw:
                    then = _utf8_step(then, b)
                groups.setdefault(then, []).append(c)
            self.classes[utf8] = {then: characters(codes) for then, codes in groups.items()}
        return self.classes[utf8]


def bits(mask: int) -> list[int]:
    """The code points of a set, ascending."""
    if mask.bit_count() < 8:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out
    raw = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def characters(codes: Iterable[int]) -> int:
    """The set of these code points."""
    flags = np.zeros(0x110000, dtype=bool)
    flags[list(codes)] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def table(of: dict) -> Table:
    return Table(of, characters(of), any(len(x) == 2 for x in of.values()), {})


@cache
def letters() -> int:
    r"""``[\p{L}\p{M}&&[^\p{IsHan}]]``."""
    han = {c for a, b in _HAN for c in range(a, b + 1)}
    return characters(c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM" and c not in han)


def _build(start: Hashable, step: Callable, final: Callable) -> Lattice | None:
    """The lattice of all states that lie between ``start`` and a final one; None if there is no text."""
    out: dict = {start: None}
    todo = [start]
    while todo:
        s = todo.pop()
        out[s] = [(m, t) for m, t in step(s) if m]
        for _, t in out[s]:
            if t not in out:
                out[t] = None
                todo.append(t)
    coming = dict.fromkeys(out, 0)
    for following in out.values():
        for _, t in following:
            coming[t] += 1
    order = [start]
    for s in order:  # grows while it is read
        for _, t in out[s]:
            coming[t] -= 1
            if not coming[t]:
                order.append(t)
    # From the end: states without a text are dropped, states with the same texts are one.
    same: dict = {}
    number: dict = {}
    for s in reversed(order):
        merged: dict[int, int] = {}
        for m, t in out[s]:
            if t in number:
                merged[number[t]] = merged.get(number[t], 0) | m
        if merged or final(s):
            shape = (bool(final(s)), tuple(sorted(merged.items())))
            number[s] = same.setdefault(shape, len(same))
    if start not in number:
        return None
    shapes = list(same)[number[start] :: -1]
    top = number[start]
    return Lattice(tuple(tuple((top - t, m) for t, m in reversed(edges)) for _, edges in shapes), frozenset(i for i, (end, _) in enumerate(shapes) if end))


def of(text: str) -> Lattice:
    return Lattice((*(((i + 1, 1 << ord(c)),) for i, c in enumerate(text)), ()), frozenset([len(text)]))


def restricted(lattice: Lattice, allowed: int) -> Lattice | None:
    """The texts that hold allowed characters only."""
    return _build(0, lambda u: [(m & allowed, v) for v, m in lattice.edges[u]], lattice.finals.__contains__)


def holding(lattice: Lattice, wanted: int) -> Lattice | None:
    """The texts that hold a wanted character."""

    def step(state):
        u, seen = state
        for v, m in lattice.edges[u]:
            yield m & wanted, (v, True)
            yield m & ~wanted, (v, seen)

    return _build((0, False), step, lambda s: s[1] and s[0] in lattice.finals)


def texts(lattice: Lattice) -> Iterator[str]:
    """Every text, for small lattices."""
    stack = [(0, "")]
    while stack:
        u, text = stack.pop()
        if u in lattice.finals:
            yield text
        stack.extend((v, text + chr(c)) for v, m in lattice.edges[u] for c in bits(m))


def count(lattice: Lattice) -> int:
    """The number of paths."""
    ways = [0] * len(lattice.edges)
    for u in range(len(ways) - 1, -1, -1):
        ways[u] = (u in lattice.finals) + sum(m.bit_count() * ways[v] for v, m in lattice.edges[u])
    return ways[0]


def has_single(lattice: Lattice) -> bool:
    """Some text is one character."""
    return any(v in lattice.finals for v, _ in lattice.edges[0])


# What a text as UTF-8 has come to: 0 at a character's border, (bytes to come, least, greatest) in one, None if invalid.
def _utf8_step(state, b: int):
    if state is None:
        return None
    if state:
        n, low, high = state
        return ((n - 1, 0x80, 0xBF) if n > 1 else 0) if low <= b <= high else None
    if b < 0x80:
        return 0
    if 0xC2 <= b < 0xE0:
        return (1, 0x80, 0xBF)
    if 0xE0 <= b < 0xF0:
        return (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
    if 0xF0 <= b < 0xF5:
        return (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
    return None


def decoded(lattice: Lattice, codec: Table, wild: bool) -> Lattice | None:
    """Each text with its runs outside ASCII read as UTF-8, at least one of them; runs that can't be read stay.

    ``codec`` gives a character's one or two bytes. With ``wild``, a lost character is any
    byte in a run that holds others too; one that stays lost ends its text. Else it has no bytes.
    """
    table, domain, double = codec[:3]

    @cache
    def byte_edges(at):
        if isinstance(at, tuple):  # within a character of two bytes
            return [(at[1], at[0], True)]
        out = []
        for v, m in lattice.edges[at]:
            trails: dict[int, int] = {}
            single = 0
            for c in bits(m & domain & ~ASCII):
                raw = table[c]
                if len(raw) == 1:
                    single |= 1 << raw[0]
                else:
                    trails[raw[0]] = trails.get(raw[0], 0) | 1 << raw[1]
            if single:
                out.append((single, v, True))
            out.extend((1 << lead, (v, trail), True) for lead, trail in trails.items())
            if wild and m & LOST_BIT:
                out.append((_WILD, v, False))
        return out

    @cache
    def following(at, k):
        """``(values of k continuation bytes, node, some byte is known)``."""
        merged: dict = {}
        for byte, v, known in byte_edges(at):
            own = byte >> 0x80 & (1 << 64) - 1
            if not own:
                continue
            for m, w, also in following(v, k - 1) if k > 1 else [(1, v, False)]:
                total = 0
                for b in bits(own):
                    total |= m << b * 64 ** (k - 1)
                if total:
                    merged[w, known or also] = merged.get((w, known or also), 0) | total
        return [(m, w, known) for (w, known), m in merged.items()]

    @cache
    def jumps(at):
        """``(characters, node, some byte is known)`` of one character's bytes."""
        merged: dict = {}
        for byte, v, known in byte_edges(at):
            if byte & ASCII:
                merged[v, known] = merged.get((v, known), 0) | byte & ASCII
            for size, first, count in _LEADS:
                leads = bits(byte >> first & (1 << count) - 1)
                for m, w, also in following(v, size - 1) if leads else ():
                    total = 0
                    for lead in leads:
                        total |= m << lead * 64 ** (size - 1)
                    merged[w, known or also] = merged.get((w, known or also), 0) | total & _VALID[size]
        return [(m, w, known) for (w, known), m in merged.items()]

    ahead = [False] * len(lattice.edges)  # another run may follow
    for u in range(len(ahead) - 1, -1, -1):
        ahead[u] = any(m & ASCII or ahead[v] for v, m in lattice.edges[u])

    @cache
    def parts(u, utf8):
        """``(characters, node, state as UTF-8)`` of a run that stays."""
        out = []
        for v, m in lattice.edges[u]:
            m &= ~ASCII & ~(LOST_BIT if wild else 0)
            if utf8 is None:
                out.append((m, v, None))
            else:
                out.append((m & ~domain, v, None))
                out.extend((m & some, v, after) for after, some in codec.after(utf8).items())
        return [x for x in out if x[0]]

    def stays(u, utf8, changed):
        return [(m, ("stay", v, after, changed)) for m, v, after in parts(u, utf8) if changed or ahead[v]]

    def step(state):
        kind, at, *rest = state
        if kind == "border":
            (changed,) = rest
            yield from (((m & ASCII), ("border", v, changed)) for v, m in lattice.edges[at])
            yield from ((m, ("read", w, known)) for m, w, known in jumps(at))
            yield from stays(at, 0, changed)
        elif kind == "read":
            (known,) = rest
            yield from ((m, ("read", w, known or also)) for m, w, also in jumps(at))
            if known and not isinstance(at, tuple):
                yield from ((m & ASCII, ("border", v, True)) for v, m in lattice.edges[at])
        else:
            utf8, changed = rest
            yield from stays(at, utf8, changed)
            if utf8 != 0:
                yield from ((m & ASCII, ("border", v, changed)) for v, m in lattice.edges[at])

    def final(state):
        kind, at, *rest = state
        if isinstance(at, tuple) or at not in lattice.finals:
            return False
        return rest[-1] and (kind != "stay" or rest[0] != 0)

    if not double and not any(m & (domain | (LOST_BIT if wild else 0)) & ~ASCII for edges in lattice.edges for _, m in edges):
        return None
    return _build(("border", 0, False), step, final)


def mapped(lattice: Lattice, codec: Table) -> Lattice | None:
    """Each text with all characters outside ASCII replaced, at least one by another."""

    def step(state):
        u, changed = state
        for v, m in lattice.edges[u]:
            yield m & ASCII, (v, changed)
            for c in bits(m & codec.domain & ~ASCII):
                to = ord(codec.of[c])
                yield 1 << to, (v, changed or to != c)

    return _build((0, False), step, lambda s: s[1] and s[0] in lattice.finals)


@cache
def gb18030() -> dict[int, bytes]:
    """The characters of two bytes. In UTF-8, those of four are never valid: a lead byte is followed by a digit."""
    out = {}
    for lead in range(0x81, 0xFF):
        for trail in (*range(0x40, 0x7F), *range(0x80, 0xFF)):
            try:
                c = bytes((lead, trail)).decode("gb18030")
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and c.encode("gb18030") == bytes((lead, trail)):
                out[ord(c)] = bytes((lead, trail))
    return out


def mapped_gb(lattice: Lattice, codec: Table) -> Lattice | None:
    """Each text as bytes, ASCII along, read as GB18030, if any byte is outside ASCII."""

    @cache
    def byte_edges(u, digits):
        """``(byte, node)``, with ASCII bytes; only digits of them if so asked."""
        out = []
        for v, m in lattice.edges[u]:
            out.extend((c, v) for c in bits(m & ASCII & (0x3FF << 0x30 if digits else ASCII)))
            if not digits:
                out.extend((codec.of[c][0], v) for c in bits(m & codec.domain & ~ASCII))
        return out

    def step(state):
        u, changed = state
        merged: dict = {}
        for b, v in byte_edges(u, False):
            if b < 0x80:
                merged[v, changed] = merged.get((v, changed), 0) | 1 << b
                continue
            for raw, w in _gb_tails(b, v):
                try:
                    c = raw.decode("gb18030")
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    merged[w, True] = merged.get((w, True), 0) | 1 << ord(c)
        return [(m, s) for s, m in merged.items()]

    @cache
    def _gb_tails(b, v):
        out = [(bytes((b, c)), w) for c, w in byte_edges(v, False)]
        for d, w in byte_edges(v, True):
            out.extend((bytes((b, d, e, f)), y) for e, x in byte_edges(w, False) if e >= 0x80 for f, y in byte_edges(x, True))
        return out

    return _build((0, False), step, lambda s: s[1] and s[0] in lattice.finals)


def asked(lattice: Lattice) -> set[str]:
    """Keys of which every corpus unit that some text may hold has at least one (see ``encoding.unit_keys``)."""
    letter = letters()
    keys: set[str] = set()
    starts, borders = {0}, set(lattice.finals)
    for u, edges in enumerate(lattice.edges):
        for v, m in edges:
            if m & ~letter:
                starts.add(v)
                borders.add(u)
            mark = m & ~letter & ~ASCII
            if mark:
                keys.update([f"1/0/{chr(c)}" for c in bits(mark)] if mark.bit_count() <= ASKED else ["1"])
    for start in starts:
        layer, n, best, foreign = {start}, 0, None, False
        while layer:
            union, following = 0, set()
            for u in layer:
                for v, m in lattice.edges[u]:
                    if m & letter:
                        union |= m & letter
                        following.add(v)
            if not union:
                break
            foreign = foreign or bool(union & ~ASCII)
            if best is None or union.bit_count() < best[1].bit_count():
                best = (n, union)
            layer, n = following, n + 1
            if foreign and not layer.isdisjoint(borders):
                at, some = best
                keys.update([f"{n}/{at}/{chr(c)}" for c in bits(some)] if some.bit_count() <= ASKED else [str(n)])
    return keys


def _least(mask: int) -> str:
    return chr((mask & -mask).bit_length() - 1)


def best(lattice: Lattice, counts: dict[str, int], total: int, unseen: float, unseen_char: float) -> tuple[float, str]:
    """``(score, text)`` of the text of greatest score by its units, the least of equals.

    Scores of what follows a node, from the end: at the border of a unit, behind a word, in a word
    of ASCII letters (no unit) and in a word that isn't in ``counts``, without and with a
    character outside ASCII. A word of ``counts`` is never better as an unseen one.
    """
    letter = letters()
    new = math.log10(unseen / total)
    marks: list[tuple[int, str, float]] = []
    trie: dict = {}
    for unit, n in counts.items():
        value = math.log10(n / total)
        if len(unit) == 1 and not letter >> ord(unit) & 1:
            marks.append((1 << ord(unit), unit, value))
            continue
        at = trie
        for c in unit:
            at = at.setdefault(c, (1 << ord(c), {}))[1]
        at[""] = (0, value)
    known = {unit: value for _, unit, value in marks}
    none = (math.inf, "")  # scores are negated: the least is the best
    size = len(lattice.edges)
    border, behind, plain, early, late = ([none] * size for _ in range(5))

    def words(start):
        """``(node, word, value)`` of the counted words from a node on."""
        layer = [(start, trie, "")]
        while layer:
            following: dict = {}
            for u, at, word in layer:
                for v, m in lattice.edges[u]:
                    m &= letter
                    if not m:
                        continue
                    options = [(_least(m), at.get(_least(m)))] if m.bit_count() == 1 else list(at.items())
                    for c, child in options:
                        if c and child and m & child[0]:
                            following[v, id(child[1])] = (v, child[1], word + c)
            layer = list(following.values())
            for v, at, word in layer:
                if "" in at:
                    yield v, word, at[""][1]

    def after(text, value, rest):
        return (rest[0] - value, text + rest[1])

    for u in range(size - 1, -1, -1):
        end = (0.0, "") if u in lattice.finals else none
        mark, in_plain, in_early, in_late = [end], [], [], []
        for v, m in lattice.edges[u]:
            other, word = m & ~letter, m & letter
            if other & ASCII:
                mark.append(after(_least(other & ASCII), 0.0, border[v]))
            other &= ~ASCII
            if other:
                mark.append(after(_least(other), new - unseen_char, border[v]))
                if other.bit_count() == 1:
                    if _least(other) in known:
                        mark.append(after(_least(other), known[_least(other)], border[v]))
                else:
                    mark.extend(after(unit, value, border[v]) for bit, unit, value in marks if other & bit)
            if word & ASCII:
                c = _least(word & ASCII)
                in_plain.append(after(c, 0.0, plain[v]))
                in_early.append(after(c, -unseen_char, early[v]))
            if word & ~ASCII:
                in_early.append(after(_least(word & ~ASCII), -unseen_char, late[v]))
            if word:
                in_late.append(after(_least(word), -unseen_char, late[v]))
        behind[u] = min(mark)
        plain[u] = min([behind[u], *in_plain])
        early[u] = min(in_early, default=none)
        late[u] = min([behind[u], *in_late])
        started = after("", new, early[u])
        border[u] = min([behind[u], started, *in_plain, *(after(w, value, behind[v]) for v, w, value in words(u))])
    return -border[0][0], border[0][1]
