"""Personal data in texts: patterns propose, checksums confirm, context words move the score.

Everything is a DataFrame expression. ``split`` and ``regexp_extract_all`` with the same pattern give the text
between the matches and the matches themselves; their running lengths are the offsets in code points.

The patterns are written so that Java's matcher takes linear time and constant stack: repetitions are
possessive where giving characters back can't help, and a start inside a run of characters that the first part
of the pattern may consume is refused unless the previous match ended there (``\\G``). An account number's pattern
matches its first four characters and looks at the rest, so that every place where one may begin is tried.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import body, keep_others, own_prefix

#: Code points of the text on either side of a match in which context words count.
CONTEXT = 40
#: Matches that may lie so near: every one has two code points or more, an account number's first part four. The last
#: may be followed by the 60 code points of the longest account number before its context begins.
NEAR, NEAR_IBAN, REST_IBAN = CONTEXT // 2, (CONTEXT + 60) // 4, 60
#: Matches whose lengths are summed one by one.
BLOCK = 256
#: Spans of the kinds that need confirmation count from this score on.
MIN_SCORE = 0.5


class Kind(NamedTuple):
    name: str
    pattern: str
    base: bool  # always a finding; the score only informs
    score: float
    context: str  # words that raise the score
    against: str  # words that lower it


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, r"\b(e-?mail|contact|write)\b", r"\b(example|noreply)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, r"\b(ip|host|server|address|client)\b", r"\b(version|release|section)\b"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", True, 0.8, r"\b(card|visa|credit|debit|payment)\b", r"\b(serial|isbn|order)\b"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, 0.6, r"\b(phone|tel|call|mobile|fax)\b", r"\b(offset|utc|gmt)\b"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+))", False, 0.8, r"\b(iban|bank|account)\b", r"\b(serial|part)\b"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3, r"\b(ssn|social security|taxpayer)\b", r"\b(order|serial|part)\b"),
)


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    back = F.reverse(digits)

    def step(total: Column, at: Column) -> Column:
        d = F.ascii(back.substr(at, F.lit(1))) - 48
        return total + F.when(at % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), step) % 10 == 0


def _mod97(found: Column) -> Column:
    """Whether an account number passes the mod-97 check: the first four go last, letters count 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, at: Column) -> Column:
        code = F.ascii(turned.substr(at, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    """Checks what the pattern found, or a beginning of an account number; what fails is dropped."""
    if kind == "ip":
        return ~F.exists(F.split(found, r"\."), lambda part: ~part.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(found)
    if kind == "ssn":
        return ~found.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", before, after))
    up = F.when(near.rlike(kind.context), 0.4).otherwise(0.0)
    down = F.when(near.rlike(kind.against), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.lit(kind.score) + up - down, 2)))


def _total(widths: Column) -> Column:
    return F.aggregate(widths, F.lit(0), lambda a, w: a + w)


def _blocks(pieces: Column, found: Column) -> Column:
    """How far each match leads on from the one before, in blocks of BLOCK.

    Running sums by blocks keep a text of many matches from taking the square of their number.
    """
    widths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(widths, b * BLOCK + 1, F.lit(BLOCK)))


def _ends(blocks: Column, sums: Column) -> Column:
    """Where each match ends."""
    before = lambda b: _total(F.slice(sums, F.lit(1), b))
    inside = lambda block: F.transform(block, lambda w, j: _total(F.slice(block, F.lit(1), j + 1)))
    return F.flatten(F.transform(blocks, lambda block, b: F.transform(F.arrays_zip(inside(block).alias("i"), F.array_repeat(before(b), F.size(block)).alias("b")), lambda x: x["i"] + x["b"])))


def _before(pieces: Column, found: Column, i: Column) -> Column:
    """The CONTEXT code points before a match: what lies between the matches and the matches themselves."""
    near = lambda x: F.right(x, F.lit(CONTEXT))
    first = F.greatest(i - NEAR, F.lit(0))
    rest = F.zip_with(F.slice(found, first + 1, i - first), F.slice(pieces, first + 2, i - first), lambda m, p: F.concat(near(m), near(p)))
    return near(F.concat(near(F.get(pieces, first)), F.array_join(rest, "")))


def _after(pieces: Column, found: Column, i: Column, skip: Column | None) -> Column:
    """The CONTEXT code points after a match, or from ``skip`` code points behind its end."""
    reach, many = (CONTEXT, NEAR) if skip is None else (CONTEXT + REST_IBAN, NEAR_IBAN)
    near = lambda x: F.left(x, F.lit(reach))
    rest = F.zip_with(F.slice(found, i + 2, F.lit(many)), F.slice(pieces, i + 3, F.lit(many)), lambda m, p: F.concat(near(m), near(p)))
    whole = F.concat(near(F.get(pieces, i + 1)), F.array_join(rest, ""))
    return F.left(whole if skip is None else whole.substr(skip + 1, F.lit(CONTEXT)), F.lit(CONTEXT))


def _number(found: Column) -> Column:
    """The longest valid account number that ends at a space or at the end of ``found``; null if there is none."""
    parts = F.split(found, " ")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
    return F.get(F.filter(prefixes, lambda p: _valid("iban", p)), F.lit(0))


def _accounts(heads: Column, rests: Column, ends: Column) -> Column:
    """Valid account numbers, from left to right; one that begins inside another is part of it."""
    placed = F.transform(
        F.arrays_zip(ends.alias("end"), heads.alias("head"), rests.alias("rest")),
        lambda m, i: F.struct((m["end"] - 4).alias("start"), _number(F.concat(m["head"], m["rest"])).alias("number"), i.alias("i")),
    )
    held = F.transform(
        F.filter(placed, lambda s: s["number"].isNotNull()),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["number"])).alias("end"), s["i"].alias("i")),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,i:int>>)")
    apart = lambda done, s: F.when((F.size(done) == 0) | (s["start"] >= F.element_at(done, -1)["end"]), F.concat(done, F.array(s))).otherwise(done)
    return F.when(F.size(held) < 2, held).otherwise(F.aggregate(held, none, apart))


def _places(kind: Kind, found: Column, ends: Column) -> Column:
    """Array of (start, end, i) of the matches that hold; ``i`` is the number of the match."""
    placed = F.transform(
        F.arrays_zip(ends.alias("end"), found.alias("found")),
        lambda m, i: F.struct((m["end"] - F.length(m["found"])).alias("start"), m["end"].alias("end"), m["found"].alias("found"), i.alias("i")),
    )
    held = F.filter(placed, lambda s: _valid(kind.name, s["found"]))
    return F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["i"].alias("i")))


def _spans(kind: Kind, order: int, pieces: Column, found: Column, places: Column) -> Column:
    """Array of (order, start, end, score, kind) of the matches that hold and count."""
    skip = lambda s: s["end"] - s["start"] - 4 if kind.name == "iban" else None
    scored = F.transform(
        places,
        lambda s: F.struct(
            F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"),
            _score(kind, _before(pieces, found, s["i"]), _after(pieces, found, s["i"], skip(s))).alias("score"), F.lit(kind.name).alias("kind"),
        ),
    )
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: array<struct<order, start, end, score, kind>>, by kind and then by place.

    Offsets are code points of the whole text, the end exclusive. Null and empty texts have no spans. Repeated
    rows are judged each for itself; an input column named ``pii`` is replaced, all others stay, whatever their names;
    an empty table stays empty. A text of any length is one row and takes time in proportion to its length.
    """
    kept, own = keep_others(df, ["pii"]), own_prefix(df)
    t, rest = f"{own}t", f"{own}rests"
    none = F.expr("cast(array() as array<string>)")
    digit = F.col(t).rlike("[0-9]")
    may = {"email": F.col(t).contains("@"), "phone": F.col(t).contains("+")}  # cheap tests spare most texts
    found = [F.when(may.get(k.name, digit), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"{own}m_{k.name}") for k in KINDS]
    cut = [F.when(F.size(f"{own}m_{k.name}") > 0, F.split(t, k.pattern, -1)).otherwise(none).alias(f"{own}p_{k.name}") for k in KINDS]
    iban = next(k for k in KINDS if k.name == "iban")
    rests = F.when(F.size(f"{own}m_iban") > 0, F.regexp_extract_all(t, F.lit(iban.pattern), F.lit(1))).otherwise(none)
    wide = df.select("*", body(text).alias(t)).select("*", *found).select("*", *cut, rests.alias(rest))
    nothing = F.expr("cast(array() as array<int>)")
    any_found = lambda k: F.size(f"{own}m_{k.name}") > 0
    for name, make in (
        ("b", lambda k: F.when(any_found(k), _blocks(F.col(f"{own}p_{k.name}"), F.col(f"{own}m_{k.name}"))).otherwise(F.array(nothing))),
        ("s", lambda k: F.transform(f"{own}b_{k.name}", _total)),
        ("e", lambda k: _ends(F.col(f"{own}b_{k.name}"), F.col(f"{own}s_{k.name}"))),
        ("h", lambda k: _accounts(F.col(f"{own}m_iban"), F.col(rest), F.col(f"{own}e_iban")) if k is iban else _places(k, F.col(f"{own}m_{k.name}"), F.col(f"{own}e_{k.name}"))),
        ("x", lambda k: _spans(k, KINDS.index(k), F.col(f"{own}p_{k.name}"), F.col(f"{own}m_{k.name}"), F.col(f"{own}h_{k.name}"))),
    ):
        wide = wide.select("*", *[make(k).alias(f"{own}{name}_{k.name}") for k in KINDS])
    # A generator of one row: filters on the result stay above it, instead of being written out down to the text.
    return wide.select(*kept, F.inline(F.array(F.struct(F.concat(*[F.col(f"{own}x_{k.name}") for k in KINDS]).alias("pii")))))


def joined(spans: Column) -> Column:
    """Spans as comma-joined kind:start:end."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
