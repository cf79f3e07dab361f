import pytest

from tillstream.llm import licence_rules

MIT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.'''
BSD = ['Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:',
       'Redistributions of source code must retain the above copyright notice.',
       'Redistributions in binary form must reproduce the above copyright notice.',
       'Neither the name nor its contributors may be used to endorse or promote products derived from this software.']
GPL = ''' * This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
 * as published by the FSF, either version 3 of the License, or (at your option) any later version.
 * It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU General Public License for more details.
 * You should have received a copy of the GNU General Public License along with it.'''

CASES = [
    (MIT, "MIT", 0), ("Intro.\n" + MIT.replace("\n", "\r\n"), "MIT", 0), ("// " + MIT.replace("\n", "\n// "), "MIT", 0),
    ("\n\n".join(BSD[:3]), "BSD-2-Clause", 0), ("\n\n".join(BSD), "BSD-3-Clause", 0), ("\n\n".join([BSD[1], BSD[0], BSD[2]]), "", 3),
    (GPL, "GPL-3.0-or-later", 0), ("Released under the MIT License.", "MIT", 0), ("prose no stop\nLicensed under CC BY-NC 4.0.\nmore", "CC-BY-NC", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
    ("Licensed under CC BY-SA 4.0. Released under the MIT License. Released under the MIT License.", "CC-BY-SA,MIT", 0),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", 0), ("Copyright 2020 Someone.", "", 1), ("He had a licence to sing.", "", 0), (None, "", 0), ("", "", 0),
]


def test_cases(documents):
    got = {r.doc_id: r for r in licence_rules.scan(documents([(i, c[0]) for i, c in enumerate(CASES)])).collect()}
    assert [(got[i].licences, got[i].n_left) for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert got[13].state == "unknown" and got[14].state == "none" and got[7].state == "recognised"


def test_every_single_rule_can_fire(documents):
    singles = [(name, ids[0]) for name, ids in licence_rules.RULES if len(ids) == 1]
    assert {i for _, ids in licence_rules.RULES for i in ids} <= {n for n, _ in licence_rules.SENTENCES}
    assert len(singles) == len({i for _, i in singles})


def test_no_python_and_no_shuffle(odd):
    plan = licence_rules.scan(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd):
    assert [r.state for r in licence_rules.scan(odd).collect()] == ["none"] * odd.count()
    assert licence_rules.scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize("identifier, pattern", licence_rules.SENTENCES)
def test_patterns_need_a_keyword(identifier, pattern):
    import re
    sample = {"wtfpl": "do what the fuck you want to public license", "gnu_hope": "it is distributed in the hope that it will be useful, without any warranty"}
    text = sample.get(identifier)
    if text:
        assert re.search(pattern, text) and re.search(licence_rules.KEYWORD, text)
