"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences: at sentence marks followed by white space, and at blank lines; a single line
break is a space, and comment leaders at line starts go. A normalised sentence (lower case, plain quotes,
single spaces) is looked up in `SENTENCES`; the first pattern found in it gives its identifier, others
have none. A document's identifiers, in order, form a sequence. `RULES` are ordered: each names a licence
and the identifiers that make it up, one after the other; longer ones come first, and what a rule takes is
not open to later ones. Identifiers that no rule takes are counted as left over.

A sentence is not cut after `v.`, before `all rights reserved` or before `either version`, as licences have these
inside sentences.

Everything is a projection of one row: no shuffle, no Python, no state. Only sentences with a word of `NEEDED` are
looked up, and texts without one have no sentences to cut; `NEEDED` is derived from `SENTENCES`, so that no
pattern can match without one of its words.

`oracle` is SQL of the first version: its `KEYWORD` and `STOP` drop some listed sentences, where `scan` finds more.

Defined results: null text counts as empty; texts without known sentences have no licence, an empty sequence
and the state `none`; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillstream.llm.common import text_or_empty

# For `oracle` only: some patterns below match without any of these.
KEYWORD = ("licen[cs]e|copyright|permission|redistribut|warrant|liab|\\bspdx\\b|public domain|endorse|"
           "free software|see the gnu|sell copies|derived from this software")

# Identifiers and the patterns that normalised sentences are searched for, first match first.
SENTENCES = [
    ("spdx_apache2", "spdx-license-identifier: apache-2\\.0"),
    ("spdx_mit", "spdx-license-identifier: mit\\b"),
    ("spdx_gpl2", "spdx-license-identifier: gpl-2\\.0"),
    ("spdx_gpl3", "spdx-license-identifier: gpl-3\\.0"),
    ("spdx_lgpl", "spdx-license-identifier: lgpl-"),
    ("spdx_mpl2", "spdx-license-identifier: mpl-2\\.0"),
    ("spdx_bsd2", "spdx-license-identifier: bsd-2-clause"),
    ("spdx_bsd3", "spdx-license-identifier: bsd-3-clause"),
    ("spdx_isc", "spdx-license-identifier: isc\\b"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc_grant", "permission to use, copy, modify, and/?(or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd_grant", "redistribution and use in source and binary forms, with or without modification, are permitted provided"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd_advert", "all advertising materials mentioning features or use of this software"),
    ("as_is_holders", "this software is provided by the (copyright holders|author|regents).* \"?as is\"?"),
    ("as_is", "the software is provided \"as is\", without warranty of any kind"),
    ("no_liability", "in no event shall .* be liable for any"),
    ("apache2_text", "licensed under the apache license, version 2\\.0 \\(the \"license\"\\)"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_basis", "software distributed under the license is distributed on an \"as is\" basis"),
    ("apache2_short", "apache license,? (version |v)?2(\\.0)?"),
    ("lgpl_free", "under the terms of the gnu (lesser|library) general public license"),
    ("agpl3_short", "gnu affero general public license,? (version |v)?3"),
    ("gpl3_later", "gnu general public license.* either version 3 of the license, or .* any later version"),
    ("gpl2_later", "gnu general public license.* either version 2 of the license, or .* any later version"),
    ("lgpl3_short", "gnu lesser general public license,? (version |v)?3"),
    ("lgpl21_short", "gnu lesser general public license,? (version |v)?2\\.1"),
    ("gpl3_short", "gnu general public license,? (version |v)?3"),
    ("gpl2_short", "gnu general public license,? (version |v)?2"),
    ("gnu_hope", "is distributed in the hope that it will be useful"),
    ("gnu_see", "see the gnu (lesser |library |affero )?general public license for more details"),
    ("gnu_received", "you should have received a copy of the gnu (lesser |library |affero )?general public license"),
    ("mpl2_text", "subject to the terms of the mozilla public license, v\\. 2\\.0"),
    ("epl2_short", "eclipse public license,? (version |v\\.? ?)?2\\.0"),
    ("cc0_short", "creative commons zero|\\bcc0 1\\.0|\\bcc0 (public domain )?licen[cs]e"),
    ("cc_by_nc_sa", "(cc by-nc-sa|attribution-noncommercial-sharealike) ?(4\\.0|3\\.0)?.*licen[cs]e|licensed under (the )?(a )?(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)"),
    ("cc_by_nc_nd", "licensed under (the )?(a )?(cc by-nc-nd|creative commons attribution-noncommercial-noderiv)"),
    ("cc_by_nc", "licensed under (the )?(a )?(cc by-nc|creative commons attribution-noncommercial)"),
    ("cc_by_sa", "licensed under (the )?(a )?(cc by-sa|creative commons attribution-sharealike)"),
    ("cc_by", "licensed under (the )?(a )?(cc by|creative commons attribution)"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("bsd_short", "(released|licensed|available|distributed) under (the |a )?(new |modified |simplified |[23]-clause )?bsd([ -]style)? licen[cs]e"),
    ("mit_short", "(released|licensed|available|distributed) under (the |an )?mit licen[cs]e|^(the )?mit license"),
    ("isc_short", "(released|licensed|available|distributed) under (the |an )?isc licen[cs]e"),
    ("public_domain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("all_rights", "copyright.* all rights reserved|^all rights reserved.*copyright"),
    ("copyright", "copyright (\\(c\\)|©|[12][0-9]{3})"),
]

# Licences and the identifiers that make them up, in order; the first rule that fits takes them.
RULES = [
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is", "no_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant", "as_is"]),
    ("ISC", ["isc_grant"]),
    ("Apache-2.0", ["apache2_text", "apache2_copy", "apache2_basis"]),
    ("Apache-2.0", ["apache2_text", "apache2_copy"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gnu_hope", "gnu_see", "gnu_received"]),
    ("GPL-2.0-or-later", ["gpl2_later", "gnu_hope", "gnu_see", "gnu_received"]),
    ("LGPL", ["lgpl_free", "gnu_hope", "gnu_see", "gnu_received"]),
    ("GPL-3.0-or-later", ["gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl2_later"]),
    ("LGPL", ["lgpl_free"]),
    ("AGPL-3.0", ["agpl3_short"]),
    ("LGPL-3.0", ["lgpl3_short"]),
    ("LGPL-2.1", ["lgpl21_short"]),
    ("GPL-3.0", ["gpl3_short"]),
    ("GPL-2.0", ["gpl2_short"]),
    ("Apache-2.0", ["apache2_text"]),
    ("Apache-2.0", ["apache2_short"]),
    ("MPL-2.0", ["mpl2_text"]),
    ("EPL-2.0", ["epl2_short"]),
    ("CC0-1.0", ["cc0_short"]),
    ("CC-BY-NC-SA", ["cc_by_nc_sa"]),
    ("CC-BY-NC-ND", ["cc_by_nc_nd"]),
    ("CC-BY-NC", ["cc_by_nc"]),
    ("CC-BY-SA", ["cc_by_sa"]),
    ("CC-BY", ["cc_by"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
    ("BSD", ["bsd_short"]),
    ("MIT", ["mit_short"]),
    ("ISC", ["isc_short"]),
    ("Public-Domain", ["public_domain"]),
    ("Apache-2.0", ["spdx_apache2"]),
    ("MIT", ["spdx_mit"]),
    ("GPL-2.0", ["spdx_gpl2"]),
    ("GPL-3.0", ["spdx_gpl3"]),
    ("LGPL", ["spdx_lgpl"]),
    ("MPL-2.0", ["spdx_mpl2"]),
    ("BSD-2-Clause", ["spdx_bsd2"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("ISC", ["spdx_isc"]),
    ("Proprietary", ["all_rights"]),
]

SPACE = "[\\x20\\x09-\\x0D]+"
LEADER = "(^|\\n)[\\x20\\x09]*(//+|#+|\\*+|/\\*+|;+|--)[\\x20\\x09]*"
BLANK = "\\n[\\x20\\x09\\x0B-\\x0D]*\\n"
STOP = "([.;!?])[\\x20\\x09-\\x0D]+"  # for `oracle` only
SENTENCE_END = f"((?<!\\bv)\\.|[;!?]){SPACE}+(?!all{SPACE}rights{SPACE}reserved|either{SPACE}version)"  # possessive spaces
CUT = "\x01"


def needed_words(parsed) -> set[str]:
    """Words, one of which is in every match of a parsed pattern; empty if there are none.

    A word is a run of literals without white space and quotes, so it stands in the text as in the normalised sentence.
    """
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if str(op) == "LITERAL" and not re.match(r"[\s\"'\x01]", chr(arg)):
            run += chr(arg)
            continue
        found, run = [*found, {run}], ""
        if str(op) == "SUBPATTERN":
            found.append(needed_words(arg[-1]))
        elif str(op) == "BRANCH":
            options = [needed_words(a) for a in arg[1]]
            found.append(set().union(*options) if all(options) else set())
    return max((f for f in found if f and "" not in f), key=lambda f: min(map(len, f)), default=set())


NEEDED = "|".join(re.escape(w) for w in sorted(set().union(*(needed_words(re._parser.parse(p)) for _, p in SENTENCES))))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text that have a needed word."""
    plain = F.translate(F.lower(text), "“”‘’\x01", "\"\"'' ")
    plain = F.regexp_replace(plain, LEADER, "$1")
    cut = F.regexp_replace(F.regexp_replace(plain, BLANK, CUT), SENTENCE_END, f"$1{CUT}")
    parts = F.filter(F.split(cut, CUT), lambda s: s.rlike(NEEDED))
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, SPACE, " ")))


def identify(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if it is not known."""
    (name, pattern), *others = SENTENCES
    return reduce(lambda found, s: found.when(sentence.rlike(s[1]), F.lit(s[0])), others, F.when(sentence.rlike(pattern), F.lit(name)))


def apply_rules(sequence: Column) -> Column:
    """`,a,b,` with the identifiers that rules take replaced by `<licence>`."""
    return reduce(lambda text, rule: F.replace(text, F.lit("".join(f",{i}," for i in rule[1])), F.lit(f",<{rule[0]}>,")), RULES, sequence)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_sentences (known ones), sequence, licences, n_left, state.

    `licences` are distinct and sorted; `state` is none, recognised, or unknown (only identifiers left over).
    """
    empty = F.array().cast("array<string>")
    known = F.when(F.lower(text_or_empty()).rlike(NEEDED),
                   F.filter(F.transform(sentences(text_or_empty()), identify), lambda i: i.isNotNull())).otherwise(empty)
    found = docs.select("doc_id", known.alias("known"))
    # Each identifier has its own commas, so that neighbours do not share one.
    marked = apply_rules(F.concat(*[F.array_join(F.transform("known", lambda i: F.concat(F.lit(","), i, F.lit(","))), "")]))
    parts = F.filter(F.split("marked", ","), lambda p: p != "")
    return found.withColumn("marked", marked).withColumn("parts", parts).select(
        "doc_id", F.size("known").cast("long").alias("n_sentences"), F.array_join("known", ",").alias("sequence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("parts", lambda p: p.startswith("<")),
                                                               lambda p: F.regexp_replace(p, "[<>]", "")))), ",").alias("licences"),
        F.size(F.filter("parts", lambda p: ~p.startswith("<"))).cast("long").alias("n_left"),
        F.when(F.size("known") == 0, "none").when(F.exists("parts", lambda p: p.startswith("<")), "recognised").otherwise("unknown").alias("state"))


def oracle() -> str:
    """The same in DuckDB SQL, from the same tables of sentences and rules."""
    text = lambda s: s.replace("'", "''")
    names = " ".join(f"WHEN regexp_matches(s, '{text(p)}') THEN '{n}'" for n, p in SENTENCES)
    marked = "joined"
    for licence, parts in RULES:
        marked = f"replace({marked}, '{''.join(f',{i},' for i in parts)}', ',<{licence}>,')"
    return f"""
WITH plain AS (SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), '“”‘’' || chr(1), '""'''' '), '{LEADER}', '\\1', 'g') AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '{BLANK}', chr(1), 'g'), '{STOP}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM plain),
norm AS (SELECT doc_id, list_transform(list_filter(parts, lambda p: regexp_matches(p, '{KEYWORD}')), lambda p: trim(regexp_replace(p, '{SPACE}', ' ', 'g'))) AS parts FROM cut),
known AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: CASE {names} END), lambda i: i IS NOT NULL) AS known FROM norm),
joined AS (SELECT doc_id, known, coalesce(array_to_string(list_transform(known, lambda i: ',' || i || ','), ''), '') AS joined FROM known),
ruled AS (SELECT doc_id, known, list_filter(string_split({marked}, ','), lambda p: p <> '') AS parts FROM joined)
SELECT doc_id, CAST(len(known) AS BIGINT) AS n_sentences, coalesce(array_to_string(known, ','), '') AS sequence,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(parts, lambda p: starts_with(p, '<')), lambda p: regexp_replace(p, '[<>]', '', 'g')))), ','), '') AS licences,
       CAST(len(list_filter(parts, lambda p: NOT starts_with(p, '<'))) AS BIGINT) AS n_left,
       CASE WHEN len(known) = 0 THEN 'none' WHEN len(list_filter(parts, lambda p: starts_with(p, '<'))) > 0 THEN 'recognised' ELSE 'unknown' END AS state
FROM ruled"""
