"""License scans: ordered signature rules over a text's words, with DataFrame functions only.

A text's words are joined by one space, so that a rule sees words and not punctuation.  A rule has a
label, a keyword that must begin a word of the text before its regex is tried, a priority and the regex.
Detections are intervals of words; one that lies within another of at least its priority (and is not
that other) is suppressed, which a sweep over the sorted intervals finds.  Base phrases are counted apart and their labels are always kept.  A null
text has no words.  A family's rules name it in full, by its short form, glued to its version or after it,
and by sentences of its body or notice.  Everything happens in one row's projection: no shuffle, no group.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

LIC = "licen[cs]e"
#: Families of licenses: label, its names as (keyword, regex, kind) and its versions ("" for none).
#: A `full` name needs no further "license"; a `short` one may also be glued to its version; a `plain` one is a word
#: of its own that names a license only before "license", before a version or after "licensed under".
FAMILIES = [
    ("mit", [("mit", "mit", "plain")], ("",)),
    ("apache", [("apache", "apache(?: software)?", "plain"), ("asl", "asl", "short")], ("", "1 0", "1 1", "2", "2 0")),
    ("gpl", [("gpl", "(?:gnu )?gpl", "short"), ("general public", f"(?:gnu )?general public {LIC}", "full")], ("", "1", "2", "3", "2 0", "3 0")),
    ("lgpl", [("lgpl", "(?:gnu )?lgpl", "short"), ("general public", f"(?:gnu )?(?:lesser|library) general public {LIC}", "full")], ("", "2", "2 0", "2 1", "3", "3 0")),
    ("agpl", [("agpl", "(?:gnu )?agpl", "short"), ("affero", f"(?:gnu )?affero general public {LIC}", "full")], ("", "1", "3", "3 0")),
    ("mpl", [("mpl", "mpl", "short"), ("mozilla public", f"mozilla public {LIC}", "full")], ("", "1 0", "1 1", "2", "2 0")),
    ("epl", [("epl", "epl", "short"), ("eclipse public", f"eclipse public {LIC}", "full")], ("", "1 0", "2", "2 0")),
    ("cddl", [("cddl", "cddl", "short"), ("common development and", f"common development and distribution {LIC}", "full")], ("", "1 0", "1 1")),
    ("bsd", [("bsd", "bsd", "plain")], ("2 clause", "3 clause", "4 clause", "")),
    ("isc", [("isc", "isc", "plain")], ("",)),
    ("zlib", [("zlib", "zlib(?: libpng)?", "plain")], ("",)),
    ("artistic", [("artistic", "artistic", "plain")], ("", "1 0", "2", "2 0")),
    ("bsl", [("boost", "boost(?: software)?", "plain"), ("bsl", "bsl", "short")], ("", "1 0")),
    ("unlicense", [("unlicense", "unlicense", "full")], ("",)),
    ("wtfpl", [("wtfpl", "wtfpl", "short")], ("", "2")),
    ("psf", [("python software foundation", "python software foundation", "plain"), ("psf", "psf", "plain")], ("", "2", "2 0")),
    ("ofl", [("ofl", "(?:sil )?ofl", "short"), ("open font", f"(?:sil )?open font {LIC}", "full")], ("", "1 0", "1 1")),
    ("eupl", [("eupl", "eupl", "short"), ("european union public", f"european union public {LIC}", "full")], ("", "1 1", "1 2")),
    ("odbl", [("odbl", "(?:odc )?odbl", "short"), ("open database", f"open database {LIC}", "full")], ("", "1 0")),
    ("cecill", [("cecill", "cecill", "short")], ("", "2 0", "2 1")),
    ("ms-pl", [("microsoft public", f"microsoft public {LIC}", "full"), ("ms pl", "ms pl", "short")], ("",)),
    ("upl", [("universal permissive", f"universal permissive {LIC}", "full"), ("upl", "upl", "plain")], ("", "1 0")),
]
#: Sentences of bodies and notices: label, keyword, regex.
BODIES = [
    ("mit", "obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsl-1", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "purpose with or without fee", "permission to use copy modify (?:and or|and|or) distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3.clause", "endorse or promote products", "nor the names? of (?:its|the|any) (?:copyright holders? (?:n?or|and) )?(?:the )?(?:names? of its )?contributors may be used to endorse or promote products"),
    ("bsd-4.clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("apache-2", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "verbatim copies of this", f"everyone is permitted to copy and distribute verbatim copies of this {LIC} document"),
    ("mpl-2", "covered software", f"covered software is provided under this {LIC} on an as is basis"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of (?:the )?eclipse public license"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software(?: released into the public domain)?"),
    ("wtfpl", "you want to", "do what the f[a-z]* you want to(?: public license)?"),
    ("psf", "python software foundation", "this license agreement is between the python software foundation"),
    ("artistic", "standard version of", "you may copy and distribute verbatim copies of the standard version of this package"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("cc0", "creative commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc0", "dedicated the work", "has dedicated the work to the public domain"),
    ("mit", "the above copyright notice and this", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "except as contained in this", "except as contained in this notice the names? of the (?:x consortium|copyright holders?) shall not be used in advertising"),
    ("hpnd", "this software and its documentation", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?(?:with or )?without fee"),
    ("isc", "the author disclaims", "the author disclaims all warranties with regard to this software"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this software is provided by the", "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is"),
    ("zlib", "without any express or implied", "this software is provided as is without any express or implied warranty"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("bsl-1", "execute and transmit", "to use reproduce display distribute execute and transmit the software"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "grant of patent license", "grant of patent license subject to the terms and conditions of this license"),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu general", "you should have received a copy of the gnu general public license"),
    ("gpl-2", "the licenses for most software are", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "other practical works", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl", "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "this library is distributed", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", "specially designated", "this license the lesser general public license applies to some specially designated software packages"),
    ("agpl", "received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "interacting with it remotely", "all users interacting with it remotely through a computer network"),
    ("gfdl", "gnu free documentation", f"gnu free documentation {LIC}(?: version 1 [0-3])?"),
    ("gfdl", "modify this document under", "permission is granted to copy distribute and or modify this document under the terms"),
    ("mpl-2", "this source code form is subject", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "the mpl was not distributed", "if a copy of the mpl was not distributed with this file"),
    ("epl-1", "org legal epl", "eclipse org legal epl v10"),
    ("epl-2", "org legal epl", "eclipse org legal epl (?:2 0|v20)"),
    ("cddl", "subject to the terms of the common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "jurisdictions that recognize", "in jurisdictions that recognize copyright laws the authors? (?:or authors )?of this software dedicate"),
    ("wtfpl", "verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("psf-2", "psf hereby grants", "psf hereby grants licensee a non ?exclusive royalty free world wide license"),
    ("artistic", "the intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font names?"),
    ("ofl", "this font software is licensed", "this font software is licensed under the sil open font license"),
    ("eupl", "licensed under the eupl", "licensed under the eupl"),
    ("cecill", "ce logiciel est", "ce logiciel est régi par la licence cecill"),
    ("ms-pl", "any portion of the software in source", "if you distribute any portion of the software in source code form you may do so only under this license"),
    ("upl-1", "subject to the condition set forth", "subject to the condition set forth below permission is hereby granted"),
    ("odbl-1", "made available under the open database", "is made available under the open database license"),
    ("openssl", "developed by the openssl", "this product includes software developed by the openssl project"),
    ("openssl", "openssl license", f"openssl {LIC}"),
    ("vim", "charityware", "vim is charityware"),
    ("beerware", "beer ware", f"the beer ware {LIC}"),
    ("json", "used for good", "the software shall be used for good not evil"),
    ("elastic-2", "elastic license", "elastic license(?: version)?(?: v)? ?2(?: 0)?"),
    ("sspl-1", "server side public", f"server side public {LIC}(?: version 1| v1)?"),
    ("busl-1.1", "business source license", "business source license(?: version)?(?: 1 1)?"),
    ("cc0", "associated a work with this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-sa", "under the same license as the", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "build upon the material you may not", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("proprietary", "unauthorized copying of this", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|document|work|book) may be reproduced"),
]
#: The parts of Creative Commons licenses in words.
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ)?(?:e?s)?(?: works)?"}
#: Creative Commons: label by its parts and version.
CC_PARTS, CC_VERSIONS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"], ["", "1 0", "2 0", "2 5", "3 0", "4 0"]


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex over spaced words, priority), the more specific first."""
    out = []
    for label, names, versions in FAMILIES:
        for key, name, kind in names:
            for v in versions:
                own = f"{label}-{v.replace(' 0', '').replace(' ', '.')}" if v else label
                lic, mark = f"(?: {LIC})?", "(?:version|ver|v)"
                numbered = f"{name}{lic}(?: {mark})? {v}|{name}{lic} v{v}|(?:{mark} ?)?{v} (?:of (?:the )?)?{name}"
                if v and kind == "short":
                    numbered += f"|{name}v?{v}"
                if v and "public" in name:
                    numbered += f"|{name} as published by the free software foundation(?: inc)? (?:either )?version {v}"
                loose = f"(?:{numbered}){lic}" if v else f"{name}{lic}"
                sure = loose if v or kind != "plain" else f"{name} {LIC}"
                terms, more = "(?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 5 * len(v.split())
                out += [
                    (own, key, f" {sure}(?= )", 20 + more),
                    (own, key, f" (?:(?:licensed|released|distributed|available) under {terms}{loose}|(?:under|subject to) {terms}{sure})(?= )", 30 + more),
                    (own, key, f" spdx license identifier {loose}(?= )", 40 + more),
                ]
    out += [("bsd-2.clause", "bsd", f" (?:simplified|freebsd) bsd(?: {LIC})?(?= )", 25), ("bsd-3.clause", "bsd", f" (?:new|modified|revised) bsd(?: {LIC})?(?= )", 25), ("bsd-4.clause", "bsd", f" (?:original|old) bsd(?: {LIC})?(?= )", 25)]
    out += [(label, key, f" {regex}(?= )", 30) for label, key, regex in BODIES]
    for parts in CC_PARTS:
        for v in CC_VERSIONS:
            out.append((f"cc-{parts.replace(' ', '-')}", " cc by", f" cc {parts}{' ' + v if v else ''}(?= )", 20 + 5 * len(parts.split()) + 5 * len(v.split())))
            named = " ".join(CC_WORDS[x] for x in parts.split())
            out.append((f"cc-{parts.replace(' ', '-')}", "creative commons", f" creative commons {named}{f'(?: {LIC})?(?: (?:version|v))? {v}' if v else ''}(?: (?:international|unported|generic))?(?: {LIC})?(?= )", 20 + 5 * len(parts.split()) + 5 * len(v.split())))
    out += [("cc0", " cc0", r" cc0(?: 1 0)?(?= )", 20), ("public-domain", "public domain", " (?:in|into|to) the public domain(?= )", 20), ("proprietary", "all rights reserved", " all rights reserved(?= )", 10)]
    return sorted(out, key=lambda r: (-r[3], r[0], r[2]))


def spaced(text: Column) -> Column:
    """' w1 w2 ... ': the text's words, each between single spaces; one space without words."""
    # lower() also folds letters beyond ASCII: no word's bounds and no base phrase depend on these.
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, WORD_GAP, " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def places(s: Column, regex: Column) -> Column:
    """Array of (first, last): the words, from 0, that each match of a rule covers; its regex starts with the space before the first.

    A mark is put before and after each match, on the word before its first one and on its last one (both
    marks are gaps, which no word holds), so one pass over the words finds all places.
    """
    tokens = F.split(F.regexp_replace(s, regex, F.lit("\u0001$0\u0002")), " ")
    at = lambda mark, shift: F.filter(F.transform(tokens, lambda w, i: F.when(F.contains(w, F.lit(mark)), i.cast("long") + shift)), lambda i: i.isNotNull())
    return F.zip_with(at("\u0001", 0), at("\u0002", -1), lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _detected(s: Column, groups: list[tuple[str, list[tuple[str, str, int]]]]) -> Column:
    """All detections of (keyword, its rules as (label, regex, priority)); each keyword is looked for once."""
    table = json.dumps([{"key": f" {k}", "rules": [{"label": a, "regex": x, "priority": p} for a, x, p in own]} for k, own in groups])
    literal = F.from_json(F.lit(table), "array<struct<key:string,rules:array<struct<label:string,regex:string,priority:int>>>>")
    hit = F.filter(F.flatten(F.transform(F.filter(literal, lambda g: F.contains(s, g["key"])), lambda g: g["rules"])), lambda r: F.rlike(s, r["regex"]))
    found = F.transform(hit, lambda r: F.transform(places(s, r["regex"]), lambda x: F.struct(r["label"].alias("label"), x["first"].alias("first"), x["last"].alias("last"), r["priority"].alias("priority"))))
    return F.flatten(found)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def surviving(found: Column, levels: list[int]) -> Column:
    """The detections that lie in no other of at least their priority, each once; of the same words and priority the least label stays.

    `levels` are all priorities, ascending.  By start, falling end, falling priority and label, whatever
    suppresses a detection stands before it, so one pass that keeps the farthest end for each priority and
    those above decides.  The pass goes through parts of the square root's length, as appending copies an array.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("end"), (-d["priority"]).alias("rank"), d["label"].alias("label"))))
    cut = lambda a: _let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / c).cast("int")), lambda k: F.slice(a, k * c + 1, c)))
    kind = "array<struct<first:long,end:long,rank:int,label:string>>"
    ranks = F.array(*(F.lit(-p) for p in levels))

    def step(state: Column, d: Column) -> Column:
        reach, out = state["reach"], state["out"]
        at = (F.array_position(ranks, d["rank"]) - 1).cast("int")
        further = F.transform(reach, lambda x, i: F.when(i <= at, F.greatest(x, -d["end"])).otherwise(x))
        return F.struct(further.alias("reach"), F.when(F.get(reach, at) >= -d["end"], out).otherwise(F.array_append(out, d)).alias("out"))

    start = F.array_repeat(F.lit(-1).cast("long"), len(levels)).alias("reach")
    whole = lambda state, part: _let(F.aggregate(part, F.struct(state["reach"].alias("reach"), F.array().cast(kind).alias("out")), step), lambda x: F.struct(x["reach"].alias("reach"), F.array_append(state["out"], x["out"]).alias("out")))
    kept = F.flatten(F.aggregate(_let(ordered, cut), F.struct(start, F.array().cast(f"array<{kind}>").alias("out")), whole, lambda state: state["out"]))
    named = F.transform(kept, lambda d: F.struct(d["label"].alias("label"), d["first"].alias("first"), (-d["end"]).alias("last"), (-d["rank"]).alias("priority")))
    return F.when(F.size(found) < 2, found).otherwise(named)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places with labels), detections (label, first, last, priority) and score.

    score: 0 without a detection or base place, else the highest surviving priority out of the highest of all rules.
    """
    table = rules()
    top = float(table[0][3])
    s, none = F.col("_s"), F.array().cast("array<struct<label:string,first:long,last:long,priority:int>>")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("_s"))
    words = words.withColumn("n_words", F.when(F.length(F.trim(s)) == 0, F.lit(0).cast("long")).otherwise(_spaces(s) - 1))
    keys = sorted({r[1].strip() for r in table})
    groups = [(key, [(label, regex, priority) for label, k, regex, priority in table if k.strip() == key]) for key in keys]
    base = _detected(s, [(p, [(label, f" {p}(?= )", int(top))]) for p, label in BASE.items()])
    # One look for any keyword decides for most texts; each base phrase begins with one or follows "under the".
    any_key = s.rlike(" (?:" + "|".join(f"{c}(?:{'|'.join(k[1:] for k in keys if k[0] == c)})" for c in sorted({k[0] for k in keys})) + ")")
    both = F.when(any_key, F.struct(base.alias("base"), _detected(s, groups).alias("found"))).otherwise(F.struct(none.alias("base"), none.alias("found")))
    rows = words.withColumn("_f", both).select("doc_id", "n_words", "_f.base", "_f.found")
    rows = rows.withColumn("detections", surviving(F.col("found"), sorted({r[3] for r in table})))
    best = F.coalesce(F.array_max(F.transform(F.concat("detections", "base"), lambda d: d["priority"])), F.lit(0)) / top
    return rows.select("doc_id", "n_words", "base", "detections", best.cast("double").alias("score"))
