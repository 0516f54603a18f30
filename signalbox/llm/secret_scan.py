"""Secret scans: patterns with fixed forms, and values in a credential context judged by their guess cost.

The guess cost of a value is the smallest sum of log10 guesses over all its segmentations into dictionary words,
dates, repeats, keyboard walks and brute-force characters, found by dynamic programming over its end positions. A repeat or walk is at least
three keys and may begin and end anywhere in a run of them.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import map_texts, own_prefix

#: log10 guesses from which a value in a credential context counts as a secret.
MIN_COST = 8.0
#: Base kinds in the order in which spans that start together are listed; ``credential`` comes last.
KINDS = ("assign", "access", "hex", "credential")

# The forms of the base findings.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Words that announce a credential, and what may stand between them and the value; an authorization scheme may, and
#: announces a long value by itself.
_CONTEXT = re.compile(
    r"""(?ai:\b(?:pass(?:word|phrase|wd|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client|secret)[_-]?key))"""
    r"""["']?[ \t]{0,4}(?:[:=]|=>|(?ai:\bis\b))[ \t]{0,4}["']?(?:(?ai:bearer|basic|token)[ \t]{1,4})?["']?(?P<value>[^\s\x00-\x1f\x7f]{6,})"""
    r"""|(?ai:\b(?:bearer|basic))[ \t]{1,4}(?P<alone>[^\s\x00-\x1f\x7f]{16,})"""
)
#: Forms that code has in place of a value: addresses without user or query, paths, and names with members or calls.
_FORMS = re.compile(
    r"""[A-Za-z][A-Za-z0-9+.-]*://[\w.-]+(?::\d+)?(?:/[\w.~%/-]*)?(?:\#[\w-]*)?|(?:\.{0,2}|~|\$\w+)/(?:[\w.-]+/)*[\w.-]*|(?:[\w.-]+/)+[\w.-]*|"""
    r"""[$@&*]?[({<\[%]*[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+|[$@&*]?[({<\[%]*[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*[(\[{].*"""
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")
#: Letters of a part that reads as a name whatever it says, and digits of a number in one.
SHORT_PART, SHORT_NUMBER = 8, 4
_TRAILING = "\"'`,;.)]}>"

#: Words most common in passwords, by rank; guessing one costs its rank. Ordinary words follow, see ``ranks``.
WORDS = {
    w: i + 1
    for i, w in enumerate(
        "password the and qwerty admin welcome login secret letmein master dragon monkey shadow sunshine princess "
        "football baseball superman iloveyou trustno user root test guest default pass changeme hello love god "
        "money summer winter spring autumn monday friday home work mail server system access private public key "
        "token api code data base date name file none null true false example sample your this that with from "
        "house green blue red black white apple orange banana computer internet google network office manager "
        "service account database backup temp demo super power magic star king queen angel baby lucky freedom".split()
    )
}
#: The vocabulary whose whole words, in its order, are the ordinary words, and the fewest letters of one.
VOCABULARY, MIN_LETTERS = "byte_bpe_50k.json", 4
_WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _WALKS for a, b in zip(row, row[1:])} | {(b, a) for row in _WALKS for a, b in zip(row, row[1:])}
_NEXT |= {(a, b) for up, down in zip(_WALKS, _WALKS[1:]) for a, b in [*zip(up[1:], down), *zip(down, up[1:])]}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)", re.A)


def _alphabet(c: str) -> int:
    return 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 200


@functools.cache
def ranks() -> tuple[dict[str, int], int]:
    """Rank of every known word, and the longest word's length: WORDS, then the vocabulary's words by frequency.

    A byte-pair vocabulary is in the order of its merges, frequent ones first; a token after a space begins a word.
    """
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = dict(WORDS)
    for token in sorted(tokens, key=tokens.get):
        word = token[1:].lower()
        if token[0] == "\u0120" and len(word) >= MIN_LETTERS and word.isascii() and word.isalpha():
            words.setdefault(word, len(words) + 1)
    return words, max(map(len, words))


class _Run:
    """Segments of at least three keys in the current run: the cheapest, from any beginning.

    A segment costs what stands before it and the logarithm of its length. Once an earlier beginning is as cheap
    as a later one, it stays so for all longer segments, so the later one is forgotten; few are ever kept.
    """

    def __init__(self) -> None:
        self.keys, self.begins = 1, []

    def step(self, goes_on: bool, end: int, best: list[float]) -> float:
        """The least of best[begin] + log10(length) over the segments that end at ``end``."""
        if not goes_on:
            self.keys = 1
            self.begins.clear()
            return math.inf
        self.keys += 1
        if self.keys < 3:
            return math.inf
        self.begins.append(end - 3)
        least, kept = math.inf, []
        for begin in self.begins:
            cost = best[begin] + math.log10(end - begin)
            if cost < least:
                least = cost
                kept.append(begin)
        self.begins = kept
        return least


def is_code(value: str) -> bool:
    """Whether a value is an address, path, member or call whose parts are words or short names."""
    if not _FORMS.fullmatch(value):
        return False
    for part in _PARTS.findall(value):
        if part.isdigit():
            if len(part) > SHORT_NUMBER:
                return False
        elif len(part) > SHORT_PART and guess_cost(part) >= MIN_COST:
            return False
    # Names have few parts for their letters, and some are words; a random value changes case and kind at every turn.
    parts, words = _PARTS.findall(value), ranks()[0]
    letters = sum(map(len, parts))
    return 7 * len(parts) <= 2 * letters and 5 * sum(len(p) for p in parts if len(p) > 2 and p.lower() in words) >= letters


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation needs; time grows with the length alone."""
    n, low = len(value), value.lower()
    words, longest = ranks()
    best = [0.0] + [math.inf] * n
    repeat, walk = _Run(), _Run()
    dates: dict[int, list[int]] = {}
    for start in range(n):
        if value[start].isdigit() and (m := _DATE.match(value, start)):
            dates.setdefault(m.end(), []).append(start)
            if value[start : start + 2] in ("19", "20") and m.end() - start > 4:
                dates.setdefault(start + 4, []).append(start)
    segment = math.log10(2)  # naming the kind of a further segment
    for end in range(1, n + 1):
        c = low[end - 1]
        cost = best[end - 1] + math.log10(_alphabet(c)) + (segment if value[end - 1] != c else 0)
        for size in range(2, min(longest, end) + 1):
            rank = words.get(low[end - size : end])
            if rank:
                upper = value[end - size : end] != low[end - size : end]
                cost = min(cost, best[end - size] + math.log10(rank + 1) + (2 if upper else 1) * segment)
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + math.log10(120 * (365 if end - start > 4 else 1)) + segment)
        same = end > 1 and low[end - 2] == c
        near = end > 1 and (low[end - 2], c) in _NEXT
        cost = min(cost, repeat.step(same, end, best) + math.log10(_alphabet(c)) + segment, walk.step(near, end, best) + math.log10(47 * 4) + segment)
        best[end] = cost
    return best[n]


def find_in(text: str) -> list[tuple[int, int, int, float | None]]:
    """(start, end, kind number, guess cost or None), by start and then kind; ends are exclusive."""
    out = [(m.start(), m.end(), 0, None) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), m.end(), 1, None) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, None) for m in _HEX.finditer(text)]
    assigned = sorted(s[:2] for s in out if s[2] == 0)
    at = 0
    for m in _CONTEXT.finditer(text):
        value = m.group(m.lastgroup).rstrip(_TRAILING)
        start, end = m.start(m.lastgroup), m.start(m.lastgroup) + len(value)
        while at < len(assigned) and assigned[at][1] <= start:
            at += 1
        covered = at < len(assigned) and assigned[at][0] <= start and end <= assigned[at][1]
        if len(value) >= 6 and not covered and not is_code(value) and (cost := guess_cost(value)) >= MIN_COST:
            out.append((start, end, 3, round(cost, 3)))
    return sorted(out, key=lambda s: (s[0], s[2]))


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: array<struct<start, end, kind, cost>>, by start and then kind.

    assign, access and hex are the whole matches of their forms; credential is the value after a credential
    word whose guess cost is at least MIN_COST and that no assign span holds. Offsets are code points, ends
    exclusive. Null and empty texts have none; repeated rows are judged each for itself; an input column of this
    name is replaced; an empty table stays empty; a long text is read as a whole. A value that reads as code (an
    address, a path, a member or a call of named things) is none.
    """

    def work() -> Callable[[list[str]], list]:
        return lambda texts: [[[{"start": a, "end": b, "kind": KINDS[k], "cost": c} for a, b, k, c in find_in(t)] for t in texts]]

    return map_texts(df, text, "secrets array<struct<start:int,end:int,kind:string,cost:double>>", work)


def redact(df: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The input with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark.

    ``length`` names a column with the text's length, which follows. Rows, columns and texts without secrets stay
    as they are, null texts too; each repeated row is cleaned for itself; an empty table stays empty; a long text is
    cleaned as a whole.
    """

    def work() -> Callable[[list[str]], list]:
        def clean(t: str) -> str | None:
            spans = find_in(t)
            if not spans:
                return None
            out, at, until = [], 0, -1
            for start, end, _, _ in spans:
                if start >= until:
                    out += [t[at:start], mark]
                until = at = max(until, end)
            return "".join([*out, t[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    names, clean = df.columns, own_prefix(df) + "clean"
    cleaned = map_texts(df, text, f"{clean} string", work)
    new = {text: F.coalesce(clean, F.col(f"`{text}`"))}
    if length in names:
        new[length] = F.coalesce(F.length(clean).cast(df.schema[length].dataType), F.col(f"`{length}`"))
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])
