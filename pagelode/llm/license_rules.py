"""License scan: ordered signature rules gated by keywords, with priority and interval-containment suppression.

Texts are reduced to lower-cased words joined by single spaces, so one hand-written regex covers any punctuation or
line breaking. A rule is (label, priority, keywords, pattern). A rule runs only where one of its keywords, parted by
spaces, is among the text's words; each match holds one of them as a word. Detections are then resolved: higher priority first, longer first, earlier first; a detection whose
interval lies inside an accepted one is suppressed. Base phrases are counted apart and are never suppressed.

Defined cases: null or empty text has no words, no labels and score 0; ties between equal intervals go to the rule
that stands first; repeated rows give repeated results; very long texts are read whole, and their detections are looked
up by start; an empty table gives an empty result; other input columns, also ``n_words``, ``labels`` or ``score``, are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame

from .common import map_rows, words_of

#: The base phrases and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

_V = r"(?:v|ver|version|versions)? ?"


def _gnu() -> list[tuple]:
    kinds = (
        ("agpl", "affero general public licen[sc]e", "affero", ("1.0", "3.0")),
        ("lgpl", "(?:lesser|library) general public licen[sc]e", "general", ("2.0", "2.1", "3.0")),
        ("gpl", "general public licen[sc]e", "general", ("1.0", "2.0", "3.0")),
        ("gfdl", "free documentation licen[sc]e", "documentation", ("1.1", "1.2", "1.3")),
    )
    rules = []
    for label, name, word, versions in kinds:
        for v in versions:
            n = v.removesuffix(".0").replace(".", " ")
            n = f"{n}(?: 0)?" if " " not in n else n
            # the version may be joined to the name: gpl3, gplv3, gpl version 3
            joined = " ".join(label + at + digit for at in ("", "v", "ver", "version", "versions") for digit in ("", v[0]))
            for key, lead in ((word, f"(?:gnu )?{name}(?: {label})? "), (joined, f"(?:gnu )?{label} ?")):
                rules += [
                    (f"{label}-{v}-or-later", 95, key, rf"{lead}{_V}{n} or (?:at your option )?(?:any )?later(?: version)?"),
                    (f"{label}-{v}-only", 94, key, rf"{lead}{_V}{n} only"),
                    (f"{label}-{v}", 90, key, rf"{lead}{_V}{n}"),
                ]
            rules += [
                (f"{label}-{v}-or-later", 95, word, rf"{name} as published by the free software foundation (?:either )?{_V}{n} (?:of the licen[sc]e )?or (?:at your option )?any later version"),
                (f"{label}-{v}", 91, word, rf"{name} as published by the free software foundation (?:either )?{_V}{n}"),
                (f"{label}-{v}", 91, word, rf"{_V}{n} of the (?:gnu )?{name}"),
                (f"{label}-{v}-or-later", 96, label + "v" + v[0], rf"{label}v{n} or later"),
                (f"{label}-{v}", 90, label + "v" + v[0], rf"{label}v{n}"),
            ]
        rules += [
            (label, 40, word, rf"(?:gnu )?{name}"),
            (label, 30, label, rf"(?:licensed under|released under|under the terms of|distributed under)(?: the)?(?: gnu)? {label}"),
        ]
    return rules


def _creative_commons() -> list[tuple]:
    long = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    rules = []
    for parts in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        short, full = " ".join(parts), " ".join(long[p] for p in parts)
        label = "cc-" + "-".join(parts)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = v.replace(".", " ")
            rules += [
                (f"{label}-{v}", 90 + len(parts), "cc", rf"cc {short} {n}"),
                (f"{label}-{v}", 90 + len(parts), "creativecommons", rf"creativecommons org licenses {short} {n}"),
                (f"{label}-{v}", 90 + len(parts), "commons", rf"creative commons {full} {n}"),
            ]
        rules += [
            (label, 60 + len(parts), "cc", rf"cc {short}"),
            (label, 60 + len(parts), "commons", rf"creative commons {full}"),
            (label, 50 + len(parts), "attribution", rf"{full} (?:international|unported|generic) (?:public )?licen[sc]e"),
        ]
    return [
        *rules,
        ("cc0-1.0", 95, "cc0", r"cc0(?: 1 0)?"),
        ("cc0-1.0", 95, "publicdomain", r"creativecommons org publicdomain zero 1 0"),
        ("cc-pdm", 92, "mark", r"public domain mark(?: 1 0)?"),
        ("creative-commons", 20, "commons", r"creative commons(?: public)? licen[sc]es?"),
    ]


def _versioned() -> list[tuple]:
    """Families that differ in name and versions only."""
    families = (
        ("apache", "apache", r"apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0")),
        ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", r"eclipse public licen[sc]e", ("1.0", "2.0")),
        ("cddl", "cddl", r"(?:common development and distribution licen[sc]e )?cddl", ("1.0", "1.1")),
        ("cpl", "common", r"common public licen[sc]e", ("1.0",)),
        ("eupl", "european", r"european union public licen[sc]e", ("1.0", "1.1", "1.2")),
        ("afl", "academic", r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("osl", "open", r"open software licen[sc]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
        ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0")),
        ("lppl", "latex", r"latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3")),
        ("ofl", "sil", r"sil open font licen[sc]e", ("1.0", "1.1")),
        ("odbl", "database", r"open (?:data commons open )?database licen[sc]e", ("1.0",)),
        ("boost", "boost", r"boost software licen[sc]e", ("1.0",)),
        ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ("1.0",)),
        ("zpl", "zope", r"zope public licen[sc]e", ("1.1", "2.0", "2.1")),
        ("upl", "universal", r"universal permissive licen[sc]e", ("1.0",)),
        ("cecill", "cecill", r"cecill(?: free software licen[sc]e agreement)?", ("1.0", "1.1", "2.0", "2.1")),
        ("qpl", "q", r"q public licen[sc]e", ("1.0",)),
        ("busl", "business", r"business source licen[sc]e", ("1.0", "1.1")),
        ("bsd-protection", "protection", r"bsd protection licen[sc]e", ("1.0",)),
        ("php", "php", r"php licen[sc]e", ("3.0", "3.01")),
        ("python", "python", r"python(?: software foundation)? licen[sc]e", ("2.0",)),
        ("ecl", "educational", r"educational community licen[sc]e", ("1.0", "2.0")),
        ("mulan", "mulan", r"mulan permissive software licen[sc]e", ("1.0", "2.0")),
    )
    rules = []
    for label, key, name, versions in families:
        for v in versions:
            n = v.replace(".", " ")
            n = f"{n.removesuffix(' 0')}(?: 0)?" if n.endswith(" 0") else n
            rules += [(f"{label}-{v}", 92, key, rf"{name} {_V}{n}"), (f"{label}-{v}", 88, label.split("-")[0], rf"{label.replace('-', ' ')} {_V}{n}")]
        rules.append((label, 50, key, name))
    return rules


def _single() -> list[tuple]:
    """Texts and names that are one of a kind."""
    return [
        ("mit", 80, "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
        ("mit", 85, "charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("mit", 84, "expat", r"expat licen[sc]e"),
        ("mit-0", 86, "attribution", r"mit no attribution"),
        ("x11", 82, "x11", r"x11 licen[sc]e"),
        ("bsd-2-clause", 88, "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd licen[sc]e)"),
        ("bsd-3-clause", 88, "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
        ("bsd-4-clause", 88, "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
        ("0bsd", 88, "0bsd", r"0bsd"),
        ("bsd", 60, "bsd", r"bsd(?: style)? licen[sc]e"),
        ("bsd", 70, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", 75, "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("isc", 80, "isc", r"isc licen[sc]e"),
        ("isc", 78, "purpose", r"permission to use copy modify and or distribute this software for any purpose"),
        ("zlib", 80, "zlib", r"zlib(?: libpng)? licen[sc]e"),
        ("zlib", 76, "misrepresented", r"the origin of this software must not be misrepresented"),
        ("unlicense", 82, "unlicense", r"(?:the )?unlicense"),
        ("unlicense", 80, "unencumbered", r"this is free and unencumbered software released into the public domain"),
        ("wtfpl", 82, "wtfpl", r"wtfpl"),
        ("public-domain", 40, "domain", r"(?:released into|placed in|dedicated to|in) the public domain"),
        ("apache-2.0", 93, "apache", r"www apache org licenses license 2 0"),
        ("apache-2.0", 91, "asl asl2", r"asl ?2 0"),
        ("openssl", 82, "openssl", r"openssl licen[sc]e"),
        ("curl", 82, "curl", r"curl licen[sc]e"),
        ("vim", 82, "vim", r"vim licen[sc]e"),
        ("ruby", 82, "ruby", r"ruby licen[sc]e"),
        ("perl", 70, "perl", r"same terms as perl(?: itself)?"),
        ("postgresql", 82, "postgresql", r"postgresql licen[sc]e"),
        ("ncsa", 82, "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
        ("proprietary", 70, "proprietary", r"proprietary and confidential"),
        ("proprietary", 68, "unauthorized", r"unauthorized (?:copying|reproduction|distribution)(?: or distribution)?(?: of this (?:file|work|material))?"),
        ("reserved", 65, "reserved", r"all rights? reserved"),
        ("reserved", 60, "permission", r"(?:may not|must not|no part) be reproduced(?: or \w+)? without(?: the)?(?: prior)?(?: written)? permission"),
        ("copyright", 10, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ]


def _grants() -> list[tuple]:
    """Sentences of licence texts and of the notices they ask for."""
    return [
        ("apache-2.0", 94, "apache", r"licensed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?(?: you may not use this file except in compliance with the licen[sc]e)?"),
        ("apache-2.0", 72, "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
        ("apache-2.0", 71, "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e"),
        ("apache-2.0", 70, "asf", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
        ("mit", 83, "copies", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", 79, "sublicense", r"(?:rights to )?use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("mit", 60, "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
        ("warranty-disclaimer", 30, "warranty", r"without (?:any )?warranty(?: of any kind)?"),
        ("warranty-disclaimer", 32, "liable", r"in no event (?:shall|will) the (?:authors?|copyright (?:holders?|owners?)|contributors)(?: or \w+){0,3} be liable"),
        ("gpl", 85, "redistribute", r"this (?:program|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
        ("lgpl", 86, "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
        ("agpl", 86, "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
        ("gpl", 78, "fitness", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
        ("gpl", 76, "received", r"you should have received a copy of the gnu general public licen[sc]e(?: along with this (?:program|software))?"),
        ("lgpl", 77, "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
        ("agpl", 77, "received", r"you should have received a copy of the gnu affero general public licen[sc]e"),
        ("gpl", 74, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
        ("gpl-linking-exception", 73, "linking", r"(?:as a special exception )?linking this library statically or dynamically with other modules"),
        ("gpl-classpath-exception", 75, "classpath", r"(?:gnu )?classpath exception"),
        ("mpl-2.0", 93, "source", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
        ("mpl-1.1", 90, "contents", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
        ("epl", 80, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
        ("cddl", 80, "cddl common", r"subject to the terms of the common development and distribution licen[sc]e(?: the licen[sc]e)?|cddl header start"),
        ("bsd", 72, "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", 72, "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd-4-clause", 86, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
        ("bsd-3-clause", 76, "neither", r"neither the name of (?:the )?\w+(?: \w+){0,6} nor the names of its contributors may be used to endorse or promote products"),
        ("boost-1.0", 90, "obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
        ("isc", 77, "consequential", r"in no event shall the author be liable for any special direct indirect or consequential damages"),
        ("isc", 79, "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("zlib", 78, "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("zlib", 77, "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
        ("unlicense", 81, "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
        ("wtfpl", 84, "want", r"do what the f\w+ you want to public licen[sc]e"),
        ("beerware", 82, "beer beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer|beer ?ware licen[sc]e"),
        ("json", 82, "evil", r"the software shall be used for good not evil"),
        ("artistic", 60, "package", r"you may make and give away verbatim copies of the source form of the standard version of this package"),
        ("ofl-1.1", 88, "font", r"this font software is licensed under the sil open font licen[sc]e version 1 1"),
        ("cc0-1.0", 90, "waived", r"has waived all copyright and related or neighboring rights"),
        ("cc0-1.0", 88, "dedicated", r"(?:the person who associated a work with this deed has )?dedicated the work to the public domain"),
        ("cc-by", 58, "share", r"you are free to share copy and redistribute the material in any medium or format"),
        ("cc-by", 57, "credit", r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
        ("cc-by-nc", 59, "commercial", r"you may not use the material for commercial purposes"),
        ("cc-by-nd", 59, "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
        ("cc-by-sa", 59, "contributions", r"you must distribute your contributions under the same licen[sc]e as the original"),
        ("creative-commons", 35, "licensed", r"this (?:work|article|content) is licensed under a creative commons"),
        ("public-domain", 55, "domain", r"this (?:file|work|code|software|program) (?:is|has been) (?:hereby )?(?:released into|placed in|in) the public domain"),
        ("public-domain", 50, "domain", r"no (?:known )?copyright (?:restrictions )?(?:this work is )?in the public domain"),
        ("odbl", 60, "database", r"made available under the open database licen[sc]e"),
        ("proprietary", 72, "confidential", r"(?:this (?:document|file|software) contains )?confidential and proprietary(?: information)?"),
        ("proprietary", 71, "copied disclosed distributed", r"may not be (?:copied|disclosed|distributed)(?: or \w+){0,3} without (?:the )?(?:express )?(?:prior )?(?:written )?(?:consent|permission)"),
        ("proprietary", 66, "reverse decompile disassemble", r"you may not (?:reverse engineer|decompile|disassemble)(?: \w+){0,6} (?:the|this) software"),
        ("non-commercial", 45, "commercial", r"for (?:personal|educational|research) (?:and|or) non commercial use only|non commercial use only"),
        ("reserved", 66, "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"),
        ("reserved", 64, "worldwide", r"rights reserved worldwide"),
        ("reserved", 65, "vorbehalten", r"alle rechte vorbehalten"),
        ("reserved", 65, "derechos", r"todos los derechos reservados"),
    ]


def _identifiers() -> list[tuple]:
    names = (
        "mit", "isc", "zlib", "0bsd", "unlicense", "wtfpl", "ncsa", "curl", "x11", "bsl 1 0", "apache 1 1", "apache 2 0",
        "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "cddl 1 1", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause",
        "gpl 1 0 only", "gpl 1 0 or later", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later",
        "lgpl 2 0 only", "lgpl 2 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later",
        "agpl 3 0 only", "agpl 3 0 or later", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0",
        "artistic 2 0", "ofl 1 1", "eupl 1 2", "ms pl", "python 2 0", "upl 1 0", "zpl 2 1", "afl 3 0", "osl 3 0", "lppl 1 3c",
    )
    return [(re.sub(r"(?<=\d) (?=\d)", ".", n).replace(" ", "-"), 99, "spdx", f"spdx licen[sc]e identifier {n}") for n in names]


@cache
def rules() -> tuple[tuple[str, int, frozenset[bytes], re.Pattern], ...]:
    """All rules by falling priority; a text position counts only at word limits."""
    made = [*_identifiers(), *_gnu(), *_creative_commons(), *_versioned(), *_single(), *_grants()]
    made.sort(key=lambda r: -r[1])
    return tuple((label, p, frozenset(key.encode().split()), re.compile(rb"(?<![^ ])" + pat.encode() + rb"(?![^ ])")) for label, p, key, pat in made)


@cache
def _keywords() -> frozenset[bytes]:
    return frozenset().union(*(r[2] for r in rules()))


def detect(words: list[bytes]) -> list[tuple[int, int, str, int]]:
    """Accepted detections as (start, end, label, priority), byte offsets in the joined words."""
    there = _keywords().intersection(words)
    if not there:
        return []
    text = b" ".join(words)
    found = [(p, m.start(), m.end(), label) for label, p, keys, pat in rules() if not keys.isdisjoint(there) for m in pat.finditer(text)]
    found.sort(key=lambda f: (-f[0], f[1] - f[2], f[1]))
    # an accepted interval holds one that starts at or after it only if it is long enough to reach its end
    taken: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    widest = 0
    for p, a, b, label in found:
        j = bisect_right(starts, a) - 1
        while j >= 0 and starts[j] >= b - widest and ends[j] < b:
            j -= 1
        if j < 0 or starts[j] < b - widest:
            at = bisect_right(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)
            widest = max(widest, b - a)
            taken.append((a, b, label, p))
    return taken


def base_places(words: list[bytes]) -> tuple[int, int | None, int | None, list[str]]:
    """Number of places, smallest and largest start word, labels."""
    text = b" " + b" ".join(words) + b" "
    places, labels = [], []
    for phrase, label in BASE:
        needle = b" " + phrase + b" "
        at, before = text.find(needle), len(places)
        while at >= 0:
            places.append(at)
            at = text.find(needle, at + 1)
        if len(places) > before:
            labels.append(label)
    if not places:
        return 0, None, None, []
    lo, hi = min(places), max(places)
    return len(places), text.count(b" ", 0, lo), text.count(b" ", 0, hi), labels


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the accepted detections."""

    def run(cols):
        out = [[] for _ in range(7)]
        for text in cols["text"].to_pylist():
            words = words_of(text)
            n, lo, hi, base = base_places(words)
            found = detect(words)
            score = max([0.9] * bool(base) + [p / 100 for *_, p in found], default=0.0)
            row = (len(words), n, lo, hi, ",".join(sorted(base)), ",".join(sorted({*base, *(f[2] for f in found)})), score)
            for o, v in zip(out, row, strict=True):
                o.append(v)
        return [cols["doc_id"], *out]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
