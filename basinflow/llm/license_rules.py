"""Signature rules for licence statements: what a rule is, and the list of rules.

A rule is tried where all its keywords occur. Patterns match normalised words: lower case, one space
between words, no punctuation ("Version 2.0" is ``version 2 0``). In patterns ``#`` stands for the version that a family of rules is made for.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

#: Priorities: a full statement, a tagged identifier, a name with its version, a name, a hint.
STATEMENT, TAG, VERSIONED, NAMED, HINT = 5, 4, 3, 2, 1
CONFIDENCE = {STATEMENT: 1.0, TAG: 0.95, VERSIONED: 0.9, NAMED: 0.75, HINT: 0.4}


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Words that names are written with.
LIC = r"(?:licen[cs]e|lizenz|licencia|licenza)"
BY = r"(?:(?:dual |also |hereby )?(?:licen[cs]ed|released|distributed|published|made available|provided|available|lizenziert|distribu[ée]e?s?|publicad[oa]) (?:to you )?(?:under|unter|sous|bajo|in accordance with|according to)(?: the terms(?: and conditions)? of)?(?: the| a| der| la)?)"
V = r"(?:version |v |ver |v)?"
LATER = r"(?:or|and) (?:\(?at your option\)? )?(?:any )?(?:later|newer|above)(?: version)?"

RULES: list[Rule] = []


def rules(priority: int, *rows: tuple[str, str, str]) -> None:
    """Rows of (label, keywords, pattern)."""
    RULES.extend(Rule(label, priority, tuple(keys.split("+")), pattern) for label, keys, pattern in rows)


def family(priority: int, label: str, keys: str, versions: str, *patterns: str) -> None:
    """One rule for each version and pattern; ``#`` is the version, and ``x.0`` is found without its zero too, where nothing follows."""
    for version in versions.split():
        words = version.replace(".", " ")
        number = f"(?:{words}|{words[:-2]}(?! [0-9]))" if words.endswith(" 0") else words
        rules(priority, *[(label.replace("#", version), keys, p.replace("#", number)) for p in patterns])


# Full statements: sentences that only a licence's own text or notice has.
rules(
    STATEMENT,
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee |without fee )?is hereby granted"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?! 1 .{0,2000} neither the name)"),
    ("bsd-3-clause", "neither the name", "neither the name of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", "you may not use this (?:file|work|software) except in compliance with the license(?: you may obtain a copy of the license at)?(?: https? www apache org licenses license 2 0)?"),
    ("apache-2.0", "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-2.0-or-later", "free software", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "free software", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "free software", "modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "free software", "modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "free software", "modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "machine executable object code", "in the form of machine executable object code generated by a source language processor"),
    ("wtfpl", "do what the fuck", "do what the fuck you want to public license"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights to this work"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("beerware", "beer", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("gfdl-1.3-or-later", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("gfdl-1.2-or-later", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("postgresql", "postgresql", "in no event shall .{1,60} be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("proprietary", "confidential", "(?:strictly |proprietary and )?confidential (?:and proprietary )?unauthori[sz]ed (?:copying|reproduction|use|distribution)"),
    ("proprietary", "no part of this", "no part of this (?:publication|book|document|work|website|site) may be (?:reproduced|copied|distributed|used)"),
    ("proprietary", "may not be+permission", "may not be (?:reproduced|copied|published|broadcast|rewritten|redistributed)(?: or (?:reproduced|copied|published|broadcast|rewritten|redistributed|distributed))* .{0,60}without (?:the )?(?:prior |express )*(?:written )?permission"),
)

# Tags of SPDX identifiers: any licence family by its own identifier.
family(TAG, "gpl-#-only", "spdx", "1.0 2.0 3.0", "spdx license identifier gpl # only", r"spdx license identifier gpl #(?! only| or)")
family(TAG, "gpl-#-or-later", "spdx", "1.0 2.0 3.0", "spdx license identifier gpl # or later")
family(TAG, "lgpl-#-only", "spdx", "2.0 2.1 3.0", "spdx license identifier lgpl # only", r"spdx license identifier lgpl #(?! only| or)")
family(TAG, "lgpl-#-or-later", "spdx", "2.0 2.1 3.0", "spdx license identifier lgpl # or later")
family(TAG, "agpl-#-only", "spdx", "1.0 3.0", "spdx license identifier agpl # only", r"spdx license identifier agpl #(?! only| or)")
family(TAG, "agpl-#-or-later", "spdx", "1.0 3.0", "spdx license identifier agpl # or later")
family(TAG, "apache-#", "spdx", "1.0 1.1 2.0", "spdx license identifier apache #")
family(TAG, "mpl-#", "spdx", "1.0 1.1 2.0", "spdx license identifier mpl #")
family(TAG, "epl-#", "spdx", "1.0 2.0", "spdx license identifier epl #")
family(TAG, "bsd-#-clause", "spdx", "1 2 3 4", "spdx license identifier bsd # clause")
rules(TAG, *[(name, "spdx", f"spdx license identifier {name.replace('-', ' ').replace('.', ' ')}") for name in "mit isc 0bsd unlicense zlib bsl-1.0 cc0-1.0 wtfpl ofl-1.1 postgresql ncsa mit-0".split()])

# Names with versions. Creative Commons: every combination of its elements.
CC = {
    "by": "(?:by|attribution)",
    "by-sa": "(?:by sa|attribution share ?alike)",
    "by-nd": "(?:by nd|attribution no ?deriv(?:ative)?s?)",
    "by-nc": "(?:by nc|attribution non ?commercial)",
    "by-nc-sa": "(?:by nc sa|attribution non ?commercial share ?alike)",
    "by-nc-nd": "(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)",
}
CC_NAME = r"(?:cc|creative commons)"
for elements, words in CC.items():
    keys = ("cc by", "creative commons")
    for key in keys:
        name = CC_NAME if key == "creative commons" else "cc"
        family(VERSIONED, f"cc-{elements}-#", key, "1.0 2.0 2.5 3.0 4.0", rf"{name} {words}(?: {LIC})? {V}#(?: international| unported| generic)?(?: {LIC})?", rf"{name} {words} # [a-z]{{2}}")
        rules(NAMED, (f"cc-{elements}", key, rf"{name} {words}(?: {LIC})?"))
rules(
    NAMED,
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", "creative commons", rf"creative commons (?:zero|public domain dedication)(?: {LIC})?(?: 1 0)?"),
    ("cc", "creative commons", rf"creative commons(?: {LIC})?"),
    ("pdm-1.0", "public domain mark", "public domain mark(?: 1 0)?"),
)

GPL = rf"(?:gnu )?(?:general public {LIC}|gpl)"
family(VERSIONED, "gpl-#-or-later", "general public", "1.0 2.0 3.0", rf"{GPL} {V}# {LATER}", rf"{GPL} {V}# as published by the free software foundation {LATER}")
family(VERSIONED, "gpl-#-or-later", "gpl", "1.0 2.0 3.0", rf"(?:gnu )?gpl {V}# {LATER}")
family(VERSIONED, "gpl-#", "general public", "1.0 2.0 3.0", rf"{GPL}(?: gpl)? {V}#", rf"{V}# of the {GPL}")
family(VERSIONED, "gpl-#", "gpl", "1.0 2.0 3.0", rf"(?:gnu )?gpl {V}#", r"gplv#")
family(VERSIONED, "lgpl-#-or-later", "general public", "2.0 2.1 3.0", rf"(?:gnu )?(?:lesser|library) general public {LIC} {V}# {LATER}")
family(VERSIONED, "lgpl-#", "general public", "2.0 2.1 3.0", rf"(?:gnu )?(?:lesser|library) general public {LIC}(?: lgpl)? {V}#")
family(VERSIONED, "lgpl-#", "lgpl", "2.0 2.1 3.0", rf"(?:gnu )?lgpl {V}#", r"lgplv#")
family(VERSIONED, "agpl-#", "affero", "1.0 3.0", rf"(?:gnu )?affero general public {LIC}(?: agpl)? {V}#")
family(VERSIONED, "agpl-#", "agpl", "1.0 3.0", rf"(?:gnu )?agpl {V}#", r"agplv#")
family(VERSIONED, "apache-#", "apache", "1.0 1.1 2.0", rf"apache(?: software)?(?: {LIC})? {V}#(?: {LIC})?", rf"apache {V}# {LIC}")
family(VERSIONED, "mpl-#", "mozilla public", "1.0 1.1 2.0", rf"mozilla public {LIC}(?: mpl)? {V}#")
family(VERSIONED, "mpl-#", "mpl", "1.0 1.1 2.0", rf"mpl {V}#")
family(VERSIONED, "epl-#", "eclipse public", "1.0 2.0", rf"eclipse public {LIC}(?: epl)? {V}#")
family(VERSIONED, "eupl-#", "european union public", "1.0 1.1 1.2", rf"european union public licen[cs]e(?: eupl)? {V}#")
family(VERSIONED, "cddl-#", "common development", "1.0 1.1", rf"common development and distribution {LIC}(?: cddl)? {V}#")
family(VERSIONED, "gfdl-#", "free documentation", "1.1 1.2 1.3", rf"(?:gnu )?free documentation {LIC} {V}#")
family(VERSIONED, "artistic-#", "artistic", "1.0 2.0", rf"artistic {LIC} {V}#")
family(VERSIONED, "osl-#", "open software", "1.0 2.0 2.1 3.0", rf"open software {LIC} {V}#")
family(VERSIONED, "afl-#", "academic free", "1.1 2.0 2.1 3.0", rf"academic free {LIC} {V}#")
family(VERSIONED, "odbl-#", "open database", "1.0", rf"open database {LIC}(?: odbl)? {V}#")
family(VERSIONED, "ogl-uk-#", "open government", "1.0 2.0 3.0", rf"open government {LIC} {V}#")
family(VERSIONED, "cecill-#", "cecill", "1.0 2.0 2.1", rf"cecill(?: {LIC})? {V}#")
family(VERSIONED, "bsd-#-clause", "bsd", "1 2 3 4", rf"bsd # clause(?: {LIC})?", rf"# clause bsd(?: {LIC})?")

# Names alone.
rules(
    NAMED,
    ("mit", "mit", rf"mit (?:licen[cs]e|licencia|licenza)"),
    ("mit", "mit", rf"{BY} mit(?: x11)?"),
    ("mit", "lizenz", r"unter (?:der )?mit lizenz"),
    ("mit", "licence mit", r"licence mit"),
    ("mit", "licencia mit", r"licencia mit"),
    ("mit", "expat", rf"expat {LIC}"),
    ("x11", "x11", rf"x11 {LIC}"),
    ("gpl", "general public", rf"{GPL}"),
    ("gpl", "gpl", r"gnu gpl"),
    ("gpl", "gpl", rf"{BY} gpl(?! {V}[0-9])"),
    ("gpl", "lizenz", r"gnu gpl lizenz"),
    ("lgpl", "general public", rf"(?:gnu )?(?:lesser|library) general public {LIC}"),
    ("lgpl", "lgpl", rf"(?:gnu )?lgpl"),
    ("agpl", "affero", rf"(?:gnu )?affero general public {LIC}"),
    ("agpl", "agpl", rf"(?:gnu )?agpl"),
    ("apache", "apache", rf"apache(?: software)? {LIC}"),
    ("mpl", "mozilla public", rf"mozilla public {LIC}"),
    ("epl", "eclipse public", rf"eclipse public {LIC}"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("cddl", "common development", rf"common development and distribution {LIC}"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {LIC}"),
    ("bsd", "bsd", rf"(?:(?:new|modified|simplified|revised|original) )?bsd(?: style)? {LIC}"),
    ("bsd-3-clause", "bsd", rf"(?:new|modified|revised) bsd {LIC}"),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd) bsd {LIC}"),
    ("bsd-4-clause", "bsd", rf"original bsd {LIC}"),
    ("isc", "isc", rf"isc {LIC}"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {LIC}"),
    ("bsl-1.0", "boost", rf"boost software {LIC}(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business source", rf"business source {LIC}(?: {V}1 1)?"),
    ("sspl-1.0", "server side public", rf"server side public {LIC}(?: {V}1)?"),
    ("elastic-2.0", "elastic", rf"elastic {LIC}(?: {V}2 0)?"),
    ("artistic", "artistic", rf"artistic {LIC}"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font {LIC}(?: {V}1 1)?"),
    ("psf-2.0", "python software foundation", rf"python software foundation {LIC}(?: {V}2)?"),
    ("postgresql", "postgresql", rf"postgresql {LIC}"),
    ("php-3.01", "php", rf"php {LIC}(?: {V}3 01)?"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LIC}"),
    ("ms-pl", "microsoft public", rf"microsoft public {LIC}"),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {LIC}"),
    ("upl-1.0", "universal permissive", rf"universal permissive {LIC}(?: {V}1 0)?"),
    ("odbl", "open database", rf"open database {LIC}"),
    ("odc-by", "open data commons", r"open data commons attribution"),
    ("pddl", "open data commons", r"open data commons public domain dedication"),
    ("ogl", "open government", rf"open government {LIC}"),
    ("cecill", "cecill", rf"cecill {LIC}"),
    ("openrail", "rail", r"(?:big ?science |creativeml )?open ?rail(?: m)?"),
    ("llama", "llama", rf"llama (?:[0-9]+ )*community {LIC}"),
    ("public-domain", "public domain", r"(?:is |are |released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", "domaine public", r"(?:dans le|du) domaine public"),
    ("public-domain", "dominio p", r"(?:en el|de|del) dominio público"),
    ("public-domain", "gemeinfrei", r"gemeinfrei"),
)

# Hints: rights are claimed or given without a licence's name.
rules(
    HINT,
    ("reserved", "reserved", r"(?:all|some|no other) rights(?: are)? reserved"),
    ("reserved", "vorbehalten", r"alle rechte vorbehalten"),
    ("reserved", "tous droits", r"tous droits r[ée]serv[ée]s"),
    ("reserved", "derechos reservados", r"todos los derechos reservados"),
    ("copyright", "copyright", r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", "copyright", r"copyright (?:by|holders?|owners?|notice)"),
    ("proprietary", "proprietary", rf"proprietary (?:{LIC}|software|information)"),
    ("proprietary", "end user", rf"end user {LIC} agreement"),
    ("permissive", "free to use", r"(?:you are |are |is )?free to (?:use|share|copy|distribute|adapt|modify)(?: (?:and|or) (?:use|share|copy|distribute|adapt|modify))*"),
    ("non-commercial", "commercial use", r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "commercial", r"not for commercial (?:use|purposes)"),
    ("no-ai", "machine learning", r"(?:may not|must not|not be) (?:be )?used (?:to train|for training|for machine learning)(?: of)?(?: machine learning| ai| language)*(?: models?)?"),
    ("open-source", "open source", rf"open source {LIC}"),
    ("licensed", "licen", rf"{BY} (?:following|same|above|this) {LIC}"),
)


def keyword_index(listed: list[Rule]) -> dict[bytes, list[int]]:
    """Numbers of rules by their first keyword."""
    by_key: dict[bytes, list[int]] = {}
    for n, rule in enumerate(listed):
        by_key.setdefault(rule.keywords[0].encode(), []).append(n)
    return by_key


@functools.cache
def compiled(pattern: str) -> re.Pattern[bytes]:
    """A pattern over UTF-8 whose matches begin and end at words. Letters beyond ASCII can't stand in a class of bytes."""
    spelled = re.sub(r"\[([^\]]*[^\x00-\x7f][^\]]*)\]", lambda m: "(?:" + "|".join(m[1]) + ")", pattern)
    return re.compile(rb"(?<= )(?:" + spelled.encode() + rb")(?= )")
