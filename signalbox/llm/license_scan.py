"""License scans: normalised sentences become sentence identifiers, and sequences of these licence rules.

A text is cut into pieces at line ends and after sentence marks; a piece is normalised (case, punctuation,
quotes, white space, copyright names and years). A known sentence begins with a piece and may be wrapped over any
number of them; its variable parts are patterns. One whose pattern leaves its end open goes on to the end of that
sentence, and never into another known one. Rules are tried in order at each place of the identifier sequence; the first that matches
consumes its sentences, so a longer or more specific rule stands before a shorter one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame

from signalbox.llm.common import map_texts

# Known sentences, as patterns over normalised words. Names are the identifiers that rules use.
SENTENCES = (
    ("spdx", r"spdx license identifier(?P<same> )(?P<id>[a-z0-9 ]+)"),
    ("mit_name", r"(?:this \w+ is )?(?:released|licensed|distributed|available)? ?(?:under|subject to)? ?(?:the )?(?:terms of )?(?:the )?mit license(?: mit)?"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", r"(?:the|this) software is provided as is without warranty of any kind.*"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("apache_name", r"(?:this \w+ is )?(?:licensed|released|distributed) under the apache license version (?P<version>[12](?: [01])?)(?: the license)?"),
    ("apache_compliance", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at(?: https?[a-z0-9 ]*)?.*"),
    ("apache_basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("gpl_name", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:terms of the )?(?:gnu )?(?P<kind>lesser |affero |)general public license(?: version|,? v)? ?(?P<version>[0-9](?: [0-9])?)(?P<later> or (?:at your option )?(?:any )?later(?: version)?)?"),
    ("gpl_free", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>lesser |affero |)general public license as published by the free software foundation either version (?P<version>[0-9](?: [0-9])?) of the license(?P<later> or at your option any later version)"),
    ("gpl_only", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>lesser |affero |)general public license version (?P<version>[0-9](?: [0-9])?) as published by the free software foundation"),
    ("gpl_hope", r"this (?:program|library|file) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl_copy", r"you should have received a copy of the gnu (?:lesser |affero |)general public license.*"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd_binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_endorse", r"(?:3 )?neither the name of (?P<gap>.*) may be used to endorse or promote products.*"),
    ("bsd_name", r"(?:this \w+ is )?(?:licensed|released|distributed) under the (?:(?P<clauses>[234]) clause )?bsd license"),
    ("mpl_name", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?(?P<version>[12](?: [01])?)"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("cc_name", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:a )?(?:creative commons|cc) (?P<terms>by(?: nc)?(?: sa| nd)?|zero|0)(?: license)? ?(?P<version>[0-9](?: [0-9])?)?(?: international| license)*"),
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("unlicense_free", r"this is free and unencumbered software released into the public domain"),
    ("zlib_as_is", r"this software is provided as is without any express or implied warranty.*"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("epl_terms", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?(?P<version>[12](?: 0)?).*"),
    ("cc0_waiver", r"to the extent possible under law .*waived all copyright and related or neighboring rights.*"),
    ("wtfpl_terms", r"do what the fuck you want to public license.*"),
    ("rights", r"(?:copyright .*)?all rights reserved"),
)

# How licences are called, as patterns over normalised words, and their identifiers. {v} is a version.
_V = r"(?: ?(?:version|v|ver) ?| )(?P<v>[0-9](?: [0-9])?)"
_LATER = r"(?P<later> or (?:at your option )?(?:any )?(?:later|newer)(?: version)?|\+)?"
NAMES = (
    ("MIT", r"mit(?: x11)?(?: license| licence)?(?! [a-z]*(?:university|press))"),
    ("Apache-{v}", r"apache(?: software)?(?: license| licence)?" + _V),
    ("{kind}GPL-{v}{later}", r"(?:gnu )?(?P<kind>lesser |library |affero |)general public (?:license|licence)(?: (?:l|a)?gpl)?" + _V + _LATER),
    ("{kind}GPL-{v}{later}", r"(?:the )?(?:gnu )?(?P<kind>l|a|)gpl(?: license)? ?(?:version|v|ver)? ?(?P<v>[0-9](?: [0-9])?)" + _LATER),
    ("MPL-{v}", r"(?:mozilla public (?:license|licence)|mpl)" + _V),
    ("BSD-{v}-Clause", r"bsd (?P<v>[234]) clause"),
    ("BSD-{v}-Clause", r"(?P<v>[234]) clause bsd"),
    ("BSD-3-Clause", r"(?:new|modified|revised) bsd"),
    ("BSD-2-Clause", r"(?:simplified|freebsd) bsd|freebsd license"),
    ("BSL-1.0", r"boost software (?:license|licence)|bsl 1 0"),
    ("Unlicense", r"unlicense"),
    ("Zlib", r"zlib(?: libpng)? (?:license|licence)"),
    ("EPL-{v}", r"(?:eclipse public (?:license|licence)|epl)" + _V),
    ("ISC", r"isc (?:license|licence)"),
    ("CC0-1.0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?|creative commons zero"),
    ("CC-{terms}-{v}", r"(?:creative commons|cc) (?P<terms>by(?: nc)?(?: sa| nd)?)(?: license)?" + _V),
    ("CC-{terms}-{v}", r"creative commons (?P<terms>attribution(?: non ?commercial)?(?: share ?alike| no ?deriv(?:ative)?s)?)(?: license)?" + _V),
    ("Artistic-{v}", r"artistic (?:license|licence)" + _V),
    ("EUPL-{v}", r"(?:european union public (?:license|licence)|eupl)" + _V),
    ("CDDL-{v}", r"(?:common development and distribution (?:license|licence)|cddl)" + _V),
    ("WTFPL", r"wtfpl"),
    ("PostgreSQL", r"postgresql (?:license|licence)"),
    ("PSF-2.0", r"python software foundation (?:license|licence)|psf (?:license|licence)"),
)
#: Words that announce a name, and names that are clear without any, for their version or their length.
_BEFORE = r"(?:(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered|redistribute it|made available) (?:and [a-z]+ )?under (?:a |the )?(?:terms (?:and conditions )?of )?(?:a |the )?|licen[sc]e (?:is |type |name )?(?:the )?|under the terms of the )"
_CLEAR = r"gnu (?:lesser |library |affero |l|a|)(?:general public|gpl)|boost software licen[sc]e|mozilla public licen[sc]e|eclipse public licen[sc]e|apache licen[sc]e|cc0 1 0|creative commons attribution|cc by"
#: Identifiers in the case in which they are written, and the present names of old ones.
_IDS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.1 "
    "EUPL-1.2 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib"
).split()
_OLD = {f"{k}gpl-{v}{plus}": f"{k.upper()}GPL-{v}-{'or-later' if plus else 'only'}" for k, v in (("", "1.0"), ("", "2.0"), ("", "3.0"), ("l", "2.0"), ("l", "2.1"), ("l", "3.0"), ("a", "3.0")) for plus in ("", "+")}
_WRITTEN = {**{i.lower(): i for i in _IDS}, **_OLD}
#: An SPDX expression in the text itself: identifiers, brackets, and the words that join them, on one line.
_SPDX = re.compile(r"(?ai:spdx-license-identifier)\s*:?[ \t]*(?P<expression>[(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?i:and|or|with)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)")

#: Ordered rules: licence, and the sentences that must follow each other; a name ending in ? may be missing. A
#: licence with {…} is filled from the groups of the sentences.
RULES = (
    ("{id}", ("spdx",)),
    ("{id}", ("name",)),
    ("BSL-1.0", ("boost_grant", "as_is?")),
    ("Unlicense", ("unlicense_free", "as_is?")),
    ("Zlib", ("zlib_as_is?", "zlib_grant")),
    ("EPL-{version}", ("epl_terms",)),
    ("CC0-1.0", ("cc0_waiver",)),
    ("WTFPL", ("wtfpl_terms",)),
    ("MIT", ("mit_name?", "mit_grant", "mit_notice", "as_is?")),
    ("MIT", ("mit_grant",)),
    ("ISC", ("isc_grant", "as_is?")),
    ("Apache-{version}", ("apache_name", "apache_compliance", "apache_copy?", "apache_basis?")),
    ("{kind}GPL-{version}{later}", ("gpl_free", "gpl_hope?", "gpl_copy?")),
    ("{kind}GPL-{version}{later}", ("gpl_only", "gpl_hope?", "gpl_copy?")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is?")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "as_is?")),
    ("MPL-{version}", ("mpl_name", "mpl_copy?")),
    ("MIT", ("mit_name",)),
    ("Apache-{version}", ("apache_name",)),
    ("{kind}GPL-{version}{later}", ("gpl_name",)),
    ("BSD{clauses}", ("bsd_name",)),
    ("CC-{terms}", ("cc_name",)),
    ("UNKNOWN", ("bsd_grant",)),
    ("UNKNOWN", ("apache_compliance",)),
    ("UNKNOWN", ("as_is",)),
    ("UNKNOWN", ("gpl_hope",)),
    ("Proprietary", ("rights",)),
)

#: What stands between normalised words: a space inside a piece, and between pieces one of these. Pieces of one line,
#: cut after a mark; a line end after a mark; a line end without one; a blank or wordless line, or a comment's end.
_INLINE, _MARKED, _WRAPPED, _BLANK = "\t", "\r", "\n", "\f"
_GAPS = str.maketrans(_INLINE + _MARKED + _WRAPPED + _BLANK, "    ")


def _compiled(pattern: str) -> str:
    """A pattern over words as one over joined pieces; what an open end covers is found by ``sentences``."""
    open_end = pattern.endswith(".*")
    pattern = pattern.removesuffix(".*").replace("[a-z0-9 ]", "[a-z0-9\0]").replace("(?P<same> )", "(?P<same>\0|\t)")
    # A gap in the middle lies in one paragraph and holds no other beginning of its sentence.
    pattern = pattern.replace(".*", r"(?:(?!neither the name of )[^\f])*?").replace(" ", r"[ \t\r\n\f]").replace("\0", " ")
    return pattern + (r"(?![a-z0-9])" if open_end else r"(?![^\t\r\n\f])")


_COMPILED = [(name, re.compile(_compiled(pattern)), pattern.endswith(".*")) for name, pattern in SENTENCES]
_ANY = re.compile("|".join(re.sub(r"\(\?P<\w+>", "(?:", pattern.pattern) for _, pattern, _ in _COMPILED))
_NAMES = [(name, re.compile(_compiled(pattern).removesuffix(r"(?![^\t\r\n\f])") + r"(?![a-z0-9])")) for name, pattern in NAMES]
_ANNOUNCED = re.compile(r"(?<![a-z0-9])" + _compiled(_BEFORE).removesuffix(r"(?![^\t\r\n\f])"))
_CLEARLY = re.compile(r"(?<![a-z0-9])(?=" + _compiled(_CLEAR).removesuffix(r"(?![^\t\r\n\f])") + ")")
_PLUS = re.compile(r"(?ai:gpl)[- ]?[vV]?\d(?:\.\d)?\+")
_ANOTHER = re.compile(_compiled(r" (?:or|and)(?: under)? (?:the )?(?:terms of the )?").removesuffix(r"(?![^\t\r\n\f])"))
#: A piece ends at a line end, or at a mark before white space; see ``sentences``.
_END = re.compile(r"(?<=[.!?;:])\s+|\n+")
_PLAIN = re.compile(r"[^a-z0-9]+")
_CLOSING = " \t\r\"'`)]}>*/"
#: Comment marks that every line of a comment repeats.
_COMMENT = re.compile(r"[ \t]*(?:#+|//+|--+|;+|%+)")
#: Every known sentence holds one of these words, which no line end can part; other texts need no lookup.
_HINT = re.compile(r"(?ai:licen[sc]e|spdx|copyright|permission|redistribut|warranty|endorse|commons|reserved|unencumbered|(?<![a-z0-9])(?:cc0?|mpl|epl|eupl|cddl|wtfpl|[la]?gpl)(?![a-z]))")


def normalise(sentence: str) -> str:
    return _PLAIN.sub(" ", sentence.lower()).strip()


def _pieces(text: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """(start, end, words) of the pieces that say something, and what separates each from the next."""
    pieces, breaks = [], []
    at, lines, comment, before = 0, 1, False, False
    for end, after in [*((m.start(), m.end()) for m in _END.finditer(text)), (len(text), len(text))]:
        if lines:
            comment = bool(_COMMENT.match(text, at))
        if words := normalise(text[at:end]):
            if pieces:
                a, b, _ = pieces[-1]
                marked = text[a:b].rstrip(_CLOSING).endswith((".", "!", "?", ";", ":"))
                if lines > 1 or lines and before and not comment:
                    breaks.append(_BLANK)
                else:
                    breaks.append(_INLINE if not lines else _MARKED if marked else _WRAPPED)
            pieces.append((at, end, words))
            lines, before = 0, comment
        lines += text.count("\n", end, after)
        at = after
    return pieces, breaks


def sentences(text: str) -> list[tuple[int, int, str, dict]]:
    """Known sentences in order: (start, end, identifier, groups), offsets in code points.

    A sentence begins with a piece. If its pattern says all of it, it ends with a piece too. An open end goes
    on to the first mark or blank line, or to the piece before the next known sentence.
    """
    pieces, breaks = _pieces(text)
    starts, at = [], 0
    for _, _, words in pieces:
        starts.append(at)
        at += len(words) + 1
    joined = "".join([x for (_, _, words), gap in zip(pieces, [*breaks, ""]) for x in (words, gap)])
    found: dict[int, tuple[int, str, dict]] = {}
    stop, following = len(pieces) - 1, []  # the piece that ends the current one's sentence; known beginnings, last first
    stops = [0] * len(pieces)
    for i in range(len(pieces) - 1, -1, -1):
        if i < len(breaks) and breaks[i] != _WRAPPED:
            stop = i
        stops[i] = stop
        if not _ANY.match(joined, starts[i]):
            continue
        for name, pattern, open_end in _COMPILED:
            if not (m := pattern.match(joined, starts[i])):
                continue
            groups = {k: v and v.translate(_GAPS) for k, v in m.groupdict().items()}
            if "gap" in groups:
                a, b = m.span("gap")
                if next((starts[k] for k in reversed(following) if starts[k] > a), b) < b:
                    continue
                del groups["gap"]
            if groups.pop("same", None) is not None and name == "spdx":
                groups["id"] = _expression(text, pieces[i][0])
            last = bisect_left(starts, m.end()) - 1
            if open_end:
                after = next((k for k in reversed(following[-(last - i + 1) :]) if k > last), len(pieces))
                last = min(stops[last], after - 1)
            found[i] = (last, name, groups)
            following.append(i)
            break
    out = []
    for i in sorted(found):
        last, name, groups = found[i]
        if not out or pieces[i][0] >= out[-1][1]:
            out.append((pieces[i][0], pieces[last][1], name, groups))
    # Licences named inside other sentences, outside what is known already.
    taken = [(a, b) for a, b, *_ in out]
    named = 0
    places = sorted({m.end() for m in _ANNOUNCED.finditer(joined)} | {m.start() for m in _CLEARLY.finditer(joined)}, reverse=True)
    while places:
        at = places.pop()
        if at < named:
            continue
        for licence, pattern in _NAMES:
            if not (m := pattern.match(joined, at)):
                continue
            first, last = (bisect_right(starts, p) - 1 for p in (m.start(), m.end() - 1))
            k = bisect_right(taken, (pieces[first][0], len(text) + 1)) - 1
            inside = k >= 0 and taken[k][1] > pieces[first][0]
            if not inside and (k + 1 == len(taken) or taken[k + 1][0] >= pieces[last][1]):
                groups = {g: v and v.translate(_GAPS) for g, v in m.groupdict().items()}
                if _PLUS.search(text, pieces[first][0], pieces[last][1]):
                    groups["later"] = "+"
                out.append((pieces[first][0], pieces[last][1], "name", {"id": _called(licence, groups)}))
            named = m.end()
            if another := _ANOTHER.match(joined, named):  # one licence or another
                places.append(another.end())
            break
    return sorted(out, key=lambda s: s[:2])


def _called(licence: str, groups: dict) -> str:
    """The identifier of a licence that is called by a name."""
    version = (groups.get("v") or "").replace(" ", ".")
    if "Clause" not in licence and version and "." not in version:
        version += ".0"
    kind = {"lesser": "L", "library": "L", "affero": "A", "l": "L", "a": "A"}.get((groups.get("kind") or "").strip(), "")
    terms = (groups.get("terms") or "").replace("attribution", "by").replace("non commercial", "nc").replace("noncommercial", "nc")
    for words, short in (("share alike", "sa"), ("sharealike", "sa"), ("no derivatives", "nd"), ("noderivatives", "nd"), ("no derivs", "nd"), ("noderivs", "nd")):
        terms = terms.replace(words, short)
    later = "-or-later" if groups.get("later") else "-only"
    return licence.format(v=version, kind=kind, terms=terms.upper().replace(" ", "-"), later=later)


def _expression(text: str, at: int) -> str:
    """The SPDX expression at a place of the text, its identifiers as they are written today."""
    found = _SPDX.search(text, at)
    if not found:
        return ""
    words = re.findall(r"[()]|[A-Za-z0-9.+-]+", found["expression"])
    joined = {"and", "or", "with"}
    words = [w.upper() if w.lower() in joined else _WRITTEN.get(w.lower(), w) for w in words]
    # A bracket that is never closed, or closes nothing, belongs to the sentence around.
    depth, kept = 0, []
    for w in words:
        if w == ")" and not depth:
            continue
        depth += (w == "(") - (w == ")")
        kept.append(w)
    while depth > 0 and "(" in kept:
        kept.remove("(")
        depth -= 1
    return " ".join(kept).replace("( ", "(").replace(" )", ")")


def _fill(licence: str, groups: dict) -> str:
    kind = {"lesser ": "L", "affero ": "A"}.get(groups.get("kind") or "", "")
    later = "-or-later" if groups.get("later") else "-only"
    clauses = f"-{groups['clauses']}-Clause" if groups.get("clauses") else ""
    version = (groups.get("version") or "").replace(" ", ".")
    version += ".0" if version and "." not in version else ""
    terms = (groups.get("terms") or "").upper().replace(" ", "-")
    if terms in ("ZERO", "0"):
        return "CC0-1.0"
    terms += f"-{version}" if terms and version else ""
    return licence.format(id=groups.get("id") or "", kind=kind, version=version, later=later, clauses=clauses, terms=terms)


def recognise(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Licences in order: (start, end, licence, sentence identifiers)."""
    if not _HINT.search(text):
        return []
    known = sentences(text)
    out, i = [], 0
    while i < len(known):
        for licence, rule in RULES:
            j, groups = i, {}
            for step in rule:
                if j < len(known) and known[j][2] == step.rstrip("?"):
                    groups.update({k: v for k, v in known[j][3].items() if v})
                    j += 1
                elif not step.endswith("?"):
                    j = -1
                    break
            if j > i:
                out.append((known[i][0], known[j - 1][1], _fill(licence, groups), [s[2] for s in known[i:j]]))
                i = j
                break
        else:
            i += 1  # a sentence of a licence that is known but proves none by itself
    # Rights are reserved in the heads of open licences too; and a licence that is named and then quoted is one.
    last = max((k for k, found in enumerate(out) if found[2] != "Proprietary"), default=-1)
    merged: list[tuple[int, int, str, list[str]]] = []
    for k, found in enumerate(out):
        if found[2] == "Proprietary" and k < last:
            continue
        if merged and merged[-1][2] == found[2]:
            merged[-1] = (merged[-1][0], found[1], found[2], merged[-1][3] + found[3])
        else:
            merged.append(found)
    return merged


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``licenses``: array<struct<start, end, license, sentences>>, in order of place.

    Offsets are code points, ends exclusive. A licence has one name, whatever form it was recognised by; an expression
    of several stays one. Null and empty texts have none; repeated rows are scanned each for itself; an input column
    of this name is replaced, others stay; an empty table stays empty; a long text is scanned as a whole.
    """

    def work() -> Callable[[list[str]], list]:
        return lambda texts: [[[{"start": a, "end": b, "license": name, "sentences": ids} for a, b, name, ids in recognise(t)] for t in texts]]

    return map_texts(df, text, "licenses array<struct<start:int,end:int,license:string,sentences:array<string>>>", work)
