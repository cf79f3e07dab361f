"""Standard texts of licences, laid out as in their files."""

import re

import pytest

from tillstream.llm import licence_rules

BSD4 = """Copyright (c) 1990, The Regents of the University of California

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California, Berkeley and its contributors.
4. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
MPL2 = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
GNU = """ * This program is free software{0} you can redistribute it and/or modify
 * it under the terms of the GNU {2}General Public License as published by
 * the Free Software Foundation{0} either version {1} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {2}General Public License for more details.
 *
 * You should have received a copy of the GNU {2}General Public License
 * along with this program; if not, write to the Free Software Foundation."""
GPL3 = GNU.format(",", 3, "").replace("software,", "software:")
APACHE2 = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

TEXTS = [
    (BSD4, "BSD-4-Clause"), (re.sub(r"3\. All(.|\n)*4\.", "3.", BSD4), "BSD-3-Clause"), (re.sub(r"3\. All(.|\n)*", "", BSD4), "BSD-2-Clause"),
    (MPL2, "MPL-2.0"), (MPL2.replace("v. 2", "v.\n * 2"), "MPL-2.0"), (GPL3, "GPL-3.0-or-later"), (GNU.format(";", 2, ""), "GPL-2.0-or-later"),
    (GNU.format(";", "2.1", "Lesser "), "LGPL"), (APACHE2, "Apache-2.0"), (MIT, "MIT"), (MIT.split("\n\nTHE")[0], "MIT"), (ISC, "ISC"),
    ("Copyright (c) 2020 Foo Inc. All rights reserved.", "Proprietary"), ("Copyright (c) 2020 Foo Inc.\n  All  rights\n reserved.", "Proprietary"),
    ("Copyright 2020 Foo, all rights reserved", "Proprietary"), ("CC0 1.0 Universal", "CC0-1.0"), ("Given to all by Creative Commons Zero.", "CC0-1.0"),
    ("Eclipse Public License, v. 2.0", "EPL-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007", "AGPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "LGPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999", "LGPL-2.1"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", "GPL-2.0"),
    ("Apache License\n   Version 2.0, January 2004", "Apache-2.0"), ("Licensed under CC BY 4.0", "CC-BY"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 4.0 License.", "CC-BY-NC-ND"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License.", "CC-BY-NC-SA"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.", "CC-BY-NC"),
    ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
    ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "WTFPL"), ("Released under the new BSD license.", "BSD"), ("The MIT License (MIT)", "MIT"),
    ("Distributed under the ISC License.", "ISC"), ("Placed in the public\n domain by its author.", "Public-Domain"),
    *[(f"// SPDX-License-Identifier: {i}", n) for i, n in (
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-2.0-only", "GPL-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("LGPL-2.1", "LGPL"),
        ("MPL-2.0", "MPL-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"))],
]


def test_standard_texts(documents):
    got = {r.doc_id: r.licences for r in licence_rules.scan(documents([(i, t) for i, (t, _) in enumerate(TEXTS)])).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(TEXTS)] == TEXTS
    assert {n for _, n in TEXTS} == {n for n, _ in licence_rules.RULES}


@pytest.mark.parametrize("pattern, words", [
    ("a copy (of|in) the licen[cs]e", {"licen"}), ("creative commons|\\bcc0 (public )?licen", {"creative", "licen"}),
    ("x.* \"?as is\"?", {"as"}), ("(mit|isc)? ?[0-9]+", set()), ("(free|[a-z]) word", {"word"})])
def test_needed_words(pattern, words):
    assert licence_rules.needed_words(re._parser.parse(pattern)) == words


def test_every_pattern_has_a_needed_word():
    assert all(licence_rules.needed_words(re._parser.parse(p)) for _, p in licence_rules.SENTENCES)
