"""Licences by whatever form: texts, heads, names and expressions; and a plain matcher over whole documents."""

import re

import pytest

from signalbox.llm import license_scan
from signalbox.llm.queries import op10_licenses
from tests.llm.test_operators import APACHE, BSD_2, BSD_3, MIT

DATA = "/root/testdata/sf0.01"
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software."""
LGPL = """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999"""
LGPL_HEAD = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."
NAMES = [
    (MIT, ["MIT"]), ("MIT License\n\nCopyright (c) 2020 Foo\n\n" + MIT, ["MIT"]), (BSD_2, ["BSD-2-Clause"]), (BSD_3, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]),
    ("Copyright (c) 2020, Foo, Inc.\nAll rights reserved.\n\n" + BSD_3, ["BSD-3-Clause"]), ("All rights reserved.", ["Proprietary"]),
    (APACHE + "\n\nAll rights reserved.", ["Apache-2.0", "Proprietary"]),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("# spdx-license-identifier: apache-2.0\nimport os", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", ["(MIT OR GPL-2.0-or-later)"]), ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("/* SPDX-License-Identifier: gpl-2.0 with Linux-syscall-note */", ["GPL-2.0-only WITH Linux-syscall-note"]), ("(SPDX-License-Identifier: MIT)", ["MIT"]),
    ("SPDX-License-Identifier: MIT and more text", ["MIT AND more"]), ("SPDX-License-Identifier: MIT\nor else", ["MIT"]),
    (LGPL, ["LGPL-2.1-only"]), (LGPL_HEAD, ["LGPL-2.1-or-later"]), (BOOST, ["BSL-1.0"]), (UNLICENSE, ["Unlicense"]), (ZLIB, ["Zlib"]),
    ("Eclipse Public License - v 2.0", ["EPL-2.0"]), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this.", ["EPL-2.0"]),
    ("CC0 1.0 Universal", ["CC0-1.0"]), ("Creative Commons Attribution-ShareAlike 4.0", ["CC-BY-SA-4.0"]), ("Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
    ("License: GPLv3", ["GPL-3.0-only"]), ("License: LGPL-2.1+", ["LGPL-2.1-or-later"]), ("License: LGPL 2.1", ["LGPL-2.1-only"]), ("GNU GPL v2 or later", ["GPL-2.0-or-later"]), ("GNU AGPL version 3", ["AGPL-3.0-only"]),
    ("All of the code here is licensed under the MIT License", ["MIT"]), ("You may use it, since it is released under\nthe Apache License,\nVersion 2.0.", ["Apache-2.0"]),
    ("It is available under the EPL 2.0 or the MPL 1.1.", ["EPL-2.0", "MPL-1.1"]), ("This is distributed under the ISC license.", ["ISC"]), ("licensed under the 3-clause BSD license", ["BSD-3-Clause"]),
    ("Wir fahren mit license plates.", []), ("He lives under the bridge, and so on.", []), ("A general public license is a document.", []), ("apache helicopters", []), ("", []),
]


@pytest.mark.parametrize("number", range(len(NAMES)))
def test_one_name_for_a_licence(number):
    text, want = NAMES[number]
    assert [x[2] for x in license_scan.recognise(text)] == want
    inside = "Some prose before.\n\n" + text + "\n\nSome prose after it, which says nothing.\n"
    found = license_scan.recognise(inside)
    assert [x[2] for x in found] == want
    assert all(0 < a < b <= len(inside) and sorted(found)[i][0] == a for i, (a, b, _, _) in enumerate(found))


def test_identifiers_have_one_spelling():
    assert len({i.lower() for i in license_scan._IDS}) == len(license_scan._IDS)
    assert set(license_scan._OLD.values()) <= set(license_scan._IDS)
    fixed = {name for name, _ in license_scan.NAMES if "{" not in name} | {name for name, _ in license_scan.RULES if "{" not in name}
    assert fixed - {"UNKNOWN", "Proprietary"} <= set(license_scan._IDS)


PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_documents_against_a_plain_matcher(spark):
    """Every planted line by its place in the whole text; reserved rights count where no licence follows."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    line = re.compile("|".join(map(re.escape, PLANTED)))
    n = 0
    for r in op10_licenses(spark, DATA).collect():
        text = texts[r["doc_id"]]
        want = [f"{PLANTED[m.group()]}:{m.start()}:{m.end()}" for m in line.finditer(text)]
        got = [s for s in r["spans"].split(",") if s and not s.startswith("Proprietary")]
        n += len(want)
        assert [g.split(":")[0] for g in got] == [w.split(":")[0] for k, w in enumerate(want) if not k or w.split(":")[0] != want[k - 1].split(":")[0]]
        assert not want or got[0].split(":")[1] == want[0].split(":")[1]
    assert n > 10
