r"""Operator 8, licence scans: ordered signature rules (DataFrame functions only).

A text becomes its words (A-Z lower-cased; runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`) joined by single spaces. The base phrases
are found in every text. The rules, some hundreds of patterns (notices written out, names and versions in four wordings), run only
where their keyword occurs: one pattern of all keywords sends texts without any away, rules that share keywords are grouped, and a
group runs where one of its keywords is. Every keyword stands at a word's start in each match of its rules, so the gates lose
nothing. Every match is a detection (first word, last word, priority, label). Per document a running maximum over detections in
order of start suppresses each detection that lies within another of the same or a better priority; what survives gives the labels.
Names that are words of other things too (apache, elastic) need a licence word beside their version.

Priorities: 1 identifier tags, 2 grants ("licensed under ..."), 3 name with version, 4 bare names. The score is that of the best
surviving wording: 1, 0.95, 0.8 and 0.5; base phrases count 0.95.

Cases: null text counts as empty: no words, no places, empty labels, score 0. Rows that repeat an id and text get the same
result each. Extra columns are ignored; an empty table gives no rows. Detections, not texts, are shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.common import ascii_lower

#: The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label stem, pattern of the name, versions, keywords of which any match contains one, identifier words.
FAMILIES = [
    ("agpl", r"gnu affero general public|affero general public|gnu affero gpl|agpl", ["1", "3"], "affero|agpl", "agpl"),
    ("lgpl", r"gnu (?:lesser|library) general public|(?:lesser|library) general public|gnu lgpl|lgpl", ["2", "2 1", "3"], "lesser general|library general|lgpl", "lgpl"),
    ("gpl", r"gnu general public|general public|gnu gpl|gpl", ["1", "2", "3"], "general public|gpl", "gpl"),
    ("gfdl", r"gnu free documentation|free documentation|gfdl", ["1 1", "1 2", "1 3"], "free documentation|gfdl", "gfdl"),
    ("apache", r"apache(?: software)?", ["1 0", "1 1", "2"], "apache", "apache"),
    ("mpl", r"mozilla public|mpl", ["1 0", "1 1", "2"], "mozilla|mpl", "mpl"),
    ("epl", r"eclipse public|epl", ["1 0", "2 0"], "eclipse|epl", "epl"),
    ("edl", r"eclipse distribution", ["1 0"], "eclipse distribution", "edl"),
    ("cddl", r"common development and distribution|cddl", ["1 0", "1 1"], "common development|cddl", "cddl"),
    ("cpl", r"common public", ["1 0"], "common public", "cpl"),
    ("ipl", r"ibm public", ["1 0"], "ibm public", "ipl"),
    ("eupl", r"european union public|eupl", ["1 0", "1 1", "1 2"], "european union public|eupl", "eupl"),
    ("osl", r"open software", ["1 0", "2 1", "3 0"], "open software", "osl"),
    ("afl", r"academic free", ["1 2", "2 1", "3 0"], "academic free", "afl"),
    ("artistic", r"perl artistic|artistic", ["1 0", "2 0"], "artistic", "artistic"),
    ("bsl", r"boost software", ["1 0"], "boost software", "bsl"),
    ("busl", r"business source", ["1 1"], "business source", "busl"),
    ("sspl", r"server side public|sspl", ["1"], "server side public|sspl", "sspl"),
    ("elastic", r"elastic", ["1 0", "2 0"], "elastic", "elastic"),
    ("ofl", r"sil open font|open font", ["1 0", "1 1"], "open font", "ofl"),
    ("odbl", r"open database|odbl", ["1 0"], "open database|odbl", "odbl"),
    ("odc-by", r"open data commons attribution", ["1 0"], "open data commons", "odc by"),
    ("pddl", r"public domain dedication and", ["1 0"], "public domain dedication", "pddl"),
    ("zlib", r"zlib libpng|zlib", [], "zlib", "zlib"),
    ("mit", r"mit x11|expat|mit", [], "mit licen|x11 licen|expat licen", "mit"),
    ("isc", r"isc|internet systems consortium", [], "isc licen|internet systems", "isc"),
    ("x11", r"x11", [], "x11", "x11"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", [], "bsd", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", [], "bsd", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", [], "bsd", "bsd 4 clause"),
    ("bsd", r"bsd", [], "bsd", "bsd"),
    ("unlicense", r"unlicense|the unlicense", [], "unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public|wtfpl", ["2"], "do what the|wtfpl", "wtfpl"),
    ("psf", r"python software foundation|psf", ["2"], "python software|psf", "psf"),
    ("php", r"php", ["3 0", "3 01"], "php", "php"),
    ("ruby", r"ruby", [], "ruby", "ruby"),
    ("openssl", r"openssl", [], "openssl", "openssl"),
    ("postgresql", r"postgresql", [], "postgresql", "postgresql"),
    ("ncsa", r"university of illinois ncsa(?: open source)?|illinois open source", [], "illinois", "ncsa"),
    ("upl", r"universal permissive", ["1 0"], "universal permissive", "upl"),
    ("ms-pl", r"microsoft public", [], "microsoft public", "ms pl"),
    ("ms-rl", r"microsoft reciprocal", [], "microsoft reciprocal", "ms rl"),
    ("vim", r"vim", [], "vim", "vim"),
    ("w3c", r"w3c software(?: notice and)?", [], "w3c", "w3c"),
    ("zpl", r"zope public", ["2 0", "2 1"], "zope", "zpl"),
    ("lppl", r"latex project public", ["1 0", "1 3"], "latex project", "lppl"),
    ("qpl", r"q public", ["1 0"], "q public", "qpl"),
    ("ecl", r"educational community", ["1 0", "2 0"], "educational community", "ecl"),
    ("mulan-psl", r"mulan permissive software", ["1", "2"], "mulan", "mulanpsl"),
    ("cecill", r"cecill", ["1 0", "2 0", "2 1"], "cecill", "cecill"),
]
#: Parts of Creative Commons licences and their full names, and the versions.
COMMONS = [
    ("cc-by-nc-nd", "cc by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc", "cc by nc", r"attribution non ?commercial"),
    ("cc-by-nd", "cc by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", "cc by sa", r"attribution share ?alike"),
    ("cc-by", "cc by", r"attribution"),
]
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Names whose bare version is no licence.
COMMON_NAMES = {"apache", "elastic"}
#: Names that without the word licence need a version with all its parts ("php 3 days ago").
WHOLE_VERSIONS = {"php", "artistic"}
#: Notices without a licence name: label, priority, pattern, keyword.
NOTICES = [
    ("all-rights-reserved", 4, r"all rights reserved", "all rights reserved"),
    ("no-rights-reserved", 3, r"no rights reserved", "no rights reserved"),
    ("some-rights-reserved", 3, r"some rights reserved", "some rights reserved"),
    ("proprietary", 3, r"(?:proprietary and confidential|confidential and proprietary)", "proprietary and|confidential and"),
    ("proprietary", 3, r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of \w+ \w+ )?(?:is )?(?:strictly )?prohibited", "unauthorized|unauthorised"),
    ("proprietary", 3, r"(?:may|must) not be (?:copied|reproduced|distributed|redistributed)(?: \w+){0,8} without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", "not be copied|not be reproduced|not be distributed|not be redistributed"),
    ("proprietary", 3, r"for internal use only", "for internal use"),
    ("proprietary", 3, r"trade secrets? of", "trade secret"),
    ("non-commercial", 3, r"(?:for|only) non ?commercial (?:use|purposes)(?: only)?", "noncommercial|non commercial"),
    ("non-commercial", 3, r"not for (?:commercial use|resale)", "not for commercial|not for resale"),
    ("non-commercial", 3, r"personal and non ?commercial use", "personal and non"),
    ("evaluation-only", 3, r"for evaluation (?:purposes|use) only", "for evaluation"),
    ("academic-use", 3, r"for (?:academic|research|educational) (?:use|purposes) only", "use only|purposes only"),
    ("freeware", 4, r"this (?:program|software) is freeware", "is freeware"),
    ("shareware", 4, r"this (?:program|software) is shareware", "is shareware"),
    ("public-domain", 3, r"(?:released|placed|dedicated|is|are|work) (?:in|into|to) the public domain", "the public domain"),
    ("public-domain", 3, r"the authors? disclaims? copyright to this source code", "disclaims copyright|disclaim copyright"),
    ("public-domain", 3, r"no copyright is claimed", "no copyright is"),
    ("public-domain", 3, r"not subject to copyright protection", "not subject to copyright"),
    ("public-domain", 3, r"public domain mark(?: 1 0)?", "public domain mark"),
    ("blessing", 2, r"may you do good and not evil", "may you do good"),
    ("cc0", 2, r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0|cc zero|creative commons zero"),
    ("cc0", 2, r"affirmer overtly fully permanently irrevocably and unconditionally waives", "affirmer overtly"),
    ("cc0", 2, r"dedicated the work to the public domain by waiving all of his or her rights", "dedicated the work"),
    ("mit", 2, r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("mit", 2, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "the above copyright notice"),
    ("mit-0", 2, r"mit no attribution", "mit no attribution"),
    ("mit-modern", 2, r"permission is hereby granted without written agreement and without license or royalty fees", "permission is hereby granted"),
    ("isc", 2, r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy"),
    ("isc", 2, r"permission to use copy modify and distribute this software for any purpose with or without fee", "permission to use copy"),
    ("0bsd", 2, r"bsd zero clause|zero clause bsd|0bsd", "bsd zero|zero clause|0bsd"),
    ("hpnd", 2, r"permission to use copy modify (?:and )?distribute and sell this software and its documentation for any purpose", "permission to use copy"),
    ("hpnd", 2, r"permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use copy"),
    ("ntp", 2, r"the name \w+(?: \w+){0,4} not be used in advertising or publicity pertaining to distribution", "not be used in advertising"),
    ("bsd", 2, r"redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("bsd-2-clause", 2, r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-2-clause", 2, r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd-3-clause", 2, r"may be used to endorse or promote products derived from this software without", "may be used to endorse"),
    ("bsd-4-clause", 2, r"all advertising materials mentioning features or use of this software must display", "all advertising materials"),
    ("warranty-disclaimer", 4, r"this software is provided (?:by \w+(?: \w+){0,8} )?as is", "this software is provided"),
    ("warranty-disclaimer", 4, r"the software is provided as is without warranty of any kind", "the software is provided"),
    ("warranty-disclaimer", 4, r"without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied"),
    ("zlib", 2, r"altered source versions must be plainly marked", "altered source versions"),
    ("zlib", 2, r"the origin of this software must not be misrepresented", "the origin of this software"),
    ("zlib", 2, r"this notice may not be removed or altered from any source distribution", "this notice may not be removed"),
    ("libpng", 2, r"the png reference library is supplied as is", "the png reference"),
    ("curl", 2, r"copyright \w+ daniel stenberg|daniel stenberg daniel haxx se", "daniel stenberg"),
    ("gpl", 2, r"this (?:program|file|software|library) is free software you can redistribute it and or modify it under the terms of the gnu general public", "is free software you can"),
    ("lgpl", 2, r"this (?:program|file|software|library) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", "is free software you can"),
    ("agpl", 2, r"this (?:program|file|software|library) is free software you can redistribute it and or modify it under the terms of the gnu affero general public", "is free software you can"),
    ("gpl", 3, r"you should have received a copy of the gnu general public", "you should have received"),
    ("lgpl", 3, r"you should have received a copy of the gnu (?:lesser|library) general public", "you should have received"),
    ("agpl", 3, r"you should have received a copy of the gnu affero general public", "you should have received"),
    ("gpl-2", 2, r"either version 2 of the license or at your option any later version", "either version 2"),
    ("gpl-3", 2, r"either version 3 of the license or at your option any later version", "either version 3"),
    ("lgpl-2.1", 2, r"either version 2 1 of the license or at your option any later version", "either version 2 1"),
    ("gpl", 3, r"www gnu org licenses gpl(?: \w+)*? html|gnu org copyleft gpl", "gnu org licenses|gnu org copyleft"),
    ("gfdl", 2, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "permission is granted to copy"),
    ("apache-2", 2, r"www apache org licenses license 2 0", "apache org licenses"),
    ("apache-2", 2, r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache software foundation"),
    ("apache-2", 3, r"unless required by applicable law or agreed to in writing software distributed under the license", "unless required by applicable law"),
    ("apache-2", 3, r"you may not use this file except in compliance with the license", "you may not use this file"),
    ("mpl-2", 2, r"this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form"),
    ("mpl-2", 2, r"mozilla org mpl 2 0", "mozilla org mpl"),
    ("mpl-1.1", 2, r"the contents of this file are subject to the mozilla public license version 1 1", "the contents of this file are"),
    ("cddl", 2, r"the contents of this file are subject to the terms of the common development and distribution", "the contents of this file are"),
    ("epl", 2, r"this program and the accompanying materials are made available under the terms of the eclipse public", "this program and the accompanying"),
    ("epl-1", 3, r"www eclipse org legal epl v10", "eclipse org legal"),
    ("epl-2", 3, r"www eclipse org legal epl (?:2 0|v20)", "eclipse org legal"),
    ("bsl-1", 2, r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission is hereby granted"),
    ("bsl-1", 2, r"www boost org license 1 0 txt", "boost org license"),
    ("unlicense", 2, r"this is free and unencumbered software released into the public domain", "free and unencumbered"),
    ("unlicense", 2, r"unlicense org", "unlicense org"),
    ("wtfpl", 2, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified"),
    ("beerware", 2, r"if we meet some day and you think this stuff is worth it you can buy me a beer", "if we meet some day"),
    ("beerware", 3, r"beerware|the beer ware", "beerware|the beer ware"),
    ("artistic", 2, r"the intent of this document is to state the conditions under which a package may be copied", "the intent of this document"),
    ("psf", 2, r"psf is making python available to licensee on an as is basis", "psf is making"),
    ("openssl", 2, r"this product includes software developed by the openssl project", "the openssl project"),
    ("ssleay", 2, r"this product includes cryptographic software written by eric young", "includes cryptographic software"),
    ("bsd-4-clause", 2, r"this product includes software developed by the university of california", "the university of california"),
    ("postgresql", 2, r"in no event shall the university of california be liable to any party", "the university of california"),
    ("w3c", 2, r"by obtaining using and or copying this work you the licensee agree", "by obtaining using"),
    ("ofl", 2, r"this font software is licensed under", "this font software"),
    ("ofl", 2, r"scripts sil org ofl", "sil org ofl"),
    ("odbl", 2, r"opendatacommons org licenses odbl", "opendatacommons org"),
    ("pddl", 2, r"opendatacommons org licenses pddl", "opendatacommons org"),
    ("odc-by", 2, r"opendatacommons org licenses by", "opendatacommons org"),
    ("ecl", 2, r"opensource org licenses ecl", "opensource org licenses"),
    ("mit", 2, r"opensource org licenses mit(?: license)?", "opensource org licenses"),
    ("isc", 2, r"opensource org licenses isc(?: license)?", "opensource org licenses"),
    ("bsd-3-clause", 2, r"opensource org licenses bsd 3 clause", "opensource org licenses"),
    ("bsd-2-clause", 2, r"opensource org licenses bsd 2 clause", "opensource org licenses"),
    ("cecill", 2, r"cecill info licences", "cecill info"),
    ("ncsa", 2, r"deal with the software without restriction including without limitation the rights", "deal with the software"),
    ("upl-1", 2, r"the universal permissive license upl version 1 0", "universal permissive license upl"),
    ("sspl-1", 2, r"if you make the functionality of the program or a modified version available to third parties as a service", "if you make the functionality"),
    ("busl-1.1", 2, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "the licensor hereby grants"),
    ("elastic-2", 2, r"you may not provide the software to third parties as a hosted or managed service", "you may not provide the software"),
    ("commons-clause", 2, r"commons clause(?: license)? condition", "commons clause"),
    ("json", 2, r"the software shall be used for good not evil", "used for good not evil"),
    ("cc-by", 3, r"creativecommons org licenses by(?: \d \d)?", "creativecommons org"),
    ("cc-by-sa", 2, r"creativecommons org licenses by sa(?: \d \d)?", "creativecommons org"),
    ("cc-by-nc", 2, r"creativecommons org licenses by nc(?: \d \d)?", "creativecommons org"),
    ("cc-by-nd", 2, r"creativecommons org licenses by nd(?: \d \d)?", "creativecommons org"),
    ("cc-by-nc-sa", 2, r"creativecommons org licenses by nc sa(?: \d \d)?", "creativecommons org"),
    ("cc-by-nc-nd", 2, r"creativecommons org licenses by nc nd(?: \d \d)?", "creativecommons org"),
    ("cc0", 2, r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons org"),
    ("public-domain", 2, r"creativecommons org publicdomain mark(?: 1 0)?", "creativecommons org"),
    ("crown-copyright", 3, r"crown copyright", "crown copyright"),
    ("ogl", 2, r"open government licen[cs]e(?: v?\d(?: 0)?)?", "open government"),
    ("us-government-work", 3, r"(?:is )?a work of the (?:united states|u s) government", "work of the united|work of the u s"),
    ("eula", 3, r"end user licen[cs]e agreement", "end user licen"),
    ("commercial", 4, r"commercial licen[cs]e", "commercial licen"),
]
GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistribut\w*|use) (?:\w+ ){0,2}?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
SCORES = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}


def rules() -> list[tuple[int, int, str, str, str]]:
    """(id, priority, label, keyword, pattern), in order; none twice."""
    out: list[tuple[int, str, str, str]] = []
    licence = r" licen[cs]e"
    for stem, name, versions, key, tag in FAMILIES:
        for v in versions:
            label, number = f"{stem}-{v.replace(' ', '.').removesuffix('.0')}", v.removesuffix(" 0") + (r"(?: 0)?" if v.endswith(" 0") or " " not in v else "")
            version = rf"(?: version| ?v)? ?{number}(?! [0-9])"
            named = rf"(?:{name})(?:{licence}{version}|{version}{licence})" if stem in COMMON_NAMES else rf"(?:{name})(?:{licence})?{version}"
            if stem in WHOLE_VERSIONS:
                named = rf"(?:{name})(?:{licence}{version}|(?: version| ?v)? ?{v}(?! [0-9]))"
            out += [
                (1, label, f"identifier {tag}", rf"spdx licen[cs]e identifier {tag} {number}(?! [0-9])(?: only| or later)?"),
                (2, label, key, rf"{GRANT}(?:{name})(?:{licence})?{version}(?: or (?:any )?later(?: version)?)?"),
                (3, label, key, named),
                (3, label, f"license {tag}|licence {tag}", rf"licen[cs]e {tag}{version}"),  # a line of package metadata
            ]
        out += [
            (1, stem, f"identifier {tag}", rf"spdx licen[cs]e identifier {tag}"),
            (2, stem, key, rf"{GRANT}(?:{name}){licence}"),
            (4, stem, key, rf"(?:{name}){licence}d?"),
            (4, stem, f"license {tag}|licence {tag}", rf"licen[cs]e {tag}"),
            (4, stem, "|".join(f"{w} under {the}{tag}" for w in ("licensed", "licenced") for the in ("", "the ")), rf"licen[cs]ed under (?:the )?{tag}"),
        ]
    for label, short, full in COMMONS:
        for v in COMMONS_VERSIONS:
            at = f"{label}-{v.replace(' ', '.')}"
            out += [(1, at, f"identifier {short}", rf"spdx licen[cs]e identifier {short} {v}"), (3, at, short, rf"{short} {v}"), (3, at, "creative commons attribution", rf"creative commons {full} {v}")]
        out += [(3, label, short, short), (3, label, "creative commons attribution", rf"creative commons {full}(?:{licence})?")]
    out += [(priority, label, key, pattern) for label, priority, pattern, key in NOTICES]
    return [(i, priority, label, key, rf"(?<![^ ])(?:{pattern})(?![^ ])") for i, (priority, label, key, pattern) in enumerate(dict.fromkeys(out))]


def gate_pattern() -> str:
    """One pattern that finds any rule's keyword at a word's start, branched by first letters so that few branches are tried at a place."""
    by_letter: dict[str, list[str]] = {}
    for key in sorted({k for _, _, _, keys, _ in rules() for k in keys.split("|")}):
        same = by_letter.setdefault(key[0], [])
        if not any(key.startswith(k) for k in same):  # a shorter one finds it too
            same.append(key)
    branches = "|".join(f"{letter}(?:{'|'.join(k[1:] for k in keys)})" for letter, keys in by_letter.items())
    return f"(?:^| )(?:{branches})"


def gated_rules() -> list[dict]:
    """The rules grouped by keywords; a text in which none of a group's keywords occurs can't match its rules."""
    groups: dict[str, list[dict]] = {}
    for i, priority, label, key, pattern in rules():
        groups.setdefault(key, []).append({"id": i, "priority": priority, "label": label, "pattern": pattern})
    return [{"keys": key.split("|"), "rules": of} for key, of in groups.items()]


def joined_words(text: Column) -> Column:
    """The text's words, each two apart by one space."""
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _marked(norm: Column, pattern: Column) -> Column:
    """The words of norm, those where a match begins marked by \x01 and those where one ends by \x02."""
    return F.split(F.regexp_replace(norm, pattern, F.lit("\x01$0\x02")), " ")


def _where(words: Column, test) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word and base_list for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), joined_words(F.col("text")).alias("norm"))
    starts = [
        F.when(F.contains("norm", F.lit(phrase)), _where(_marked(F.col("norm"), F.lit(rf"(?<![^ ]){phrase}(?![^ ])")), lambda w: F.startswith(w, F.lit("\x01")))).otherwise(F.array().cast("array<int>"))
        for phrase, _ in BASE
    ]
    rows = rows.select("*", *[s.alias(f"at{k}") for k, s in enumerate(starts)])
    all_at = F.flatten(F.array(*[F.col(f"at{k}") for k in range(len(BASE))]))
    found = F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    return rows.select(
        "doc_id",
        "text_hash",
        F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.size(all_at).cast("long").alias("n_base"),
        F.array_min(all_at).cast("long").alias("first_word"),
        F.array_max(all_at).cast("long").alias("last_word"),
        found.alias("base_list"),
    )


def _places(marked: Column) -> Column:
    """(first, last) words of the matches in a marked text; null without any."""

    def of(words: Column) -> Column:
        return F.arrays_zip(_where(words, lambda w: F.startswith(w, F.lit("\x01"))).alias("first"), _where(words, lambda w: F.endswith(w, F.lit("\x02"))).alias("last"))

    return F.when(F.exists(marked, lambda w: F.startswith(w, F.lit("\x01"))), of(marked))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gated: bool = True) -> DataFrame:
    """doc_id, text_hash, label, priority, first, last of all matches of all rules, before suppression. gated=False, for tests, runs every rule on every text."""
    table = F.from_json(F.lit(json.dumps(gated_rules())), "array<struct<keys:array<string>,rules:array<struct<id:int,priority:int,label:string,pattern:string>>>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an array of one element binds the normalised text: it is made once and tested by one pattern, whatever the optimiser moves
    one = F.array(joined_words(F.col("text")))
    norm = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.filter(one, lambda n: F.rlike(n, F.lit(gate_pattern()))) if gated else one).alias("norm"))
    matching = F.filter(table, lambda g: F.exists(g["keys"], lambda k: F.contains("norm", k))) if gated else table
    ruled = norm.select("doc_id", "text_hash", "norm", F.explode(F.flatten(F.transform(matching, lambda g: g["rules"]))).alias("rule"))
    marked = F.array(_marked(F.col("norm"), F.col("rule.pattern")))
    found = ruled.select("doc_id", "text_hash", "rule.id", "rule.priority", "rule.label", F.explode(F.get(F.transform(marked, _places), F.lit(0))).alias("at"))
    return found.select("doc_id", "text_hash", "id", "priority", "label", F.col("at.first").alias("first"), F.col("at.last").alias("last"))


def surviving(found: DataFrame) -> DataFrame:
    """Detections that no detection of the same or a better priority contains; of equal spans the better rule stays."""
    before = Window.partitionBy("doc_id", "text_hash").orderBy("first", F.desc("last"), "priority", "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") == p, F.col("last"))).over(before) for p in (1, 2, 3, 4)]
    rows = found.distinct().select("*", *[r.alias(f"reach{p}") for p, r in enumerate(reach, 1)])
    covered = F.lit(False)
    for p in (1, 2, 3, 4):
        covered = covered | F.coalesce((F.col("priority") >= p) & (F.col(f"reach{p}") >= F.col("last")), F.lit(False))
    return rows.where(~covered).select("doc_id", "text_hash", "label", "priority", "first", "last")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    score = F.get(F.array(*[F.lit(SCORES[p]) for p in (1, 2, 3, 4)]), F.col("priority") - 1)
    method = surviving(detections(docs, id_col, text_col)).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("method_list"), F.max(score).alias("method_score"))
    method = method.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "method_list", "method_score")
    base = base_scan(docs, id_col, text_col)
    rows = base.join(method, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("method_list", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("method_score", F.lit(0.0)), F.when(F.col("n_base") > 0, SCORES[2]).otherwise(0.0)).alias("score"),
    )
