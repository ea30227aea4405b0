"""License scans with ordered signature rules, in DataFrame functions only.

A text becomes its words (runs of ASCII letters, digits and non-ASCII characters,
lower-cased) between single spaces. *Base*: the places of three phrases. *Rules*:
``SIGNATURES`` are sentences of license texts, written one by one; every license of
``LICENSES`` adds an expression for each phrasing of ``PHRASINGS``; together some 600,
each with a priority, a confidence and keywords of which every match contains one. Only
rules with a keyword that occurs in the text are tried. Each match is an interval of
words. *Overlaps*: an interval that lies within one of higher priority, or within a longer
or earlier one of the same, is suppressed; one that only overlaps, or contains it, stays.

Lower-casing is Unicode's; it makes no ASCII letter but k (of the Kelvin sign), so
the words and base phrases are those of lower-casing A-Z alone.

Null and empty texts have no words; an empty table gives no rows; texts of any length are
scanned whole, in time that grows with their length and their matches; repeated rows are
scanned alike, ids may be null, and extra columns do not matter.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels, in label order.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, expression of the name, expression of the identifier.
LICENSES = (
    ("0bsd", "(?:zero clause bsd|0bsd)", "0bsd"),
    ("afl-3.0", "academic free license(?: version| v)? ?3 0", "afl 3 0"),
    ("agpl-3.0", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("apache-1.1", "apache(?: software)? license(?: version)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0"),
    ("artistic-2.0", "artistic license(?: version)? ?2 0", "artistic 2 0"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("bsl-1.0", "boost software license(?: version)? ?1 0", "bsl 1 0"),
    ("busl-1.1", "business source license(?: version)? ?1 1", "busl 1 1"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cddl-1.0", "common development and distribution license(?: version)?(?: 1 [01])?", "cddl 1 [01]"),
    ("cecill-2.1", "cecill(?: free software)?(?: license)?(?: agreement)?(?: 2 [01])?", "cecill 2 1"),
    ("cpl-1.0", "common public license(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("ecl-2.0", "educational community license(?: version)?(?: 2 0)?", "ecl 2 0"),
    ("epl-1.0", "eclipse public license(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "european union public licen[cs]e(?: version)?(?: 1 2)?", "eupl 1 2"),
    ("gfdl-1.3", "(?:gnu )?free documentation license(?: version)?(?: 1 3)?", "gfdl 1 3(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?general public license(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?general public license(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("isc", "isc", "isc"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lppl-1.3c", "latex project public license(?: version)?(?: 1 3c?)?", "lppl 1 3c"),
    ("mit", "mit(?: x11)?", "mit"),
    ("mit-0", "mit no attribution", "mit 0"),
    ("mpl-1.1", "mozilla public license(?: version)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public license(?: version)?(?: 2 0)?", "mpl 2 0"),
    ("ms-pl", "microsoft public license", "ms pl"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", "ncsa"),
    ("odbl-1.0", "open database license(?: version)?(?: 1 0)?", "odbl 1 0"),
    ("ofl-1.1", "sil open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("osl-3.0", "open software license(?: version| v)? ?3 0", "osl 3 0"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf-2.0", "python software foundation(?: license)?(?: version)?(?: 2)?", "psf 2 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1.0", "universal permissive license(?: version| v)?(?: 1 0)?", "upl 1 0"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
)
#: Phrasing around NAME or ID, priority and confidence.
PHRASINGS = (
    ("spdx license identifier ID", 90, 1.0),
    ("(?:is|are)? ?(?:licen[cs]ed|sublicensed) (?:to you )?under (?:the )?(?:terms of )?(?:the )?NAME(?: (?:licen[cs]e|license agreement))?", 80, 0.95),
    ("(?:released|distributed|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?", 78, 0.95),
    ("(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?", 74, 0.9),
    ("(?:available|usable|reusable|redistributable) under (?:the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?", 72, 0.9),
    ("(?:opensource org|spdx org|creativecommons org|gnu org|apache org) licenses? (?:html )?ID", 70, 0.9),
    ("licen[cs]e (?:name |id |type )?(?:is )?(?:the )?(?:NAME|ID)", 60, 0.7),
    ("(?:terms|conditions|copy|text|version) of the NAME(?: licen[cs]e)?", 56, 0.7),
    ("(?:the )?ID licen[cs]e", 52, 0.8),
    ("NAME licen[cs]e", 50, 0.8),
)
#: Rules without a license's name.
GENERAL = (
    ("all-rights-reserved", "all rights reserved", 40, 0.6),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 38, 0.4),
    ("copyright", "(?:c )?copyright (?:by|notice|holder|holders|owner)", 36, 0.3),
    ("public-domain", "(?:dedicated to|released into|placed in|is in) the public domain", 66, 0.8),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e)", 64, 0.7),
    ("no-redistribution", "redistribution (?:is )?(?:prohibited|not permitted|forbidden)", 62, 0.7),
    ("gpl", "(?:gnu )?general public licen[cs]e", 34, 0.8),
    ("lgpl", "(?:gnu )?lesser general public licen[cs]e", 46, 0.8),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", 46, 0.8),
    ("apache", "apache licen[cs]e", 34, 0.7),
    ("creative-commons", "creative commons", 30, 0.5),
    ("cc-by", "cc by", 30, 0.6),
)
#: Sentences of license texts and notices, each a rule of priority 95.
SIGNATURES = (
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("afl-3.0", "licensed under the academic free license version 3 0", 1.0),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation(?: either)?(?: version 3)?", 1.0),
    ("agpl-3.0", "interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version", 0.95),
    ("apache-2.0", "licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "you may not use this (?:file|work) except in compliance with the license", 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.95),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.9),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which", 0.9),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied (?:[a-z0-9]{1,20} ){0,30}artistic control", 0.9),
    ("beerware", "the beer ware license", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.9),
    ("bsd-3-clause", "neither the name of (?:[a-z0-9]{1,20} ){1,20}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd", "this software is provided by the (?:copyright holders|regents|author) and contributors as is and any express or implied warranties", 0.9),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("cc-by", "this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic)(?: license)?", 1.0),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic)(?: license)?", 1.0),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic)(?: license)?", 1.0),
    ("cc-by-nd", "this work is licensed under a creative commons attribution no ?deriv(?:ative)?s? [1-4] [05] (?:international|unported|generic)(?: license)?", 1.0),
    ("cc0-1.0", "to the extent possible under law (?:[a-z0-9]{1,20} ){1,20}has waived all copyright and related or neighboring rights to this work", 1.0),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cecill-2.1", "this software is governed by the cecill license under french law and abiding by the rules of distribution of free software", 1.0),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", 1.0),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.7),
    ("ecl-2.0", "licensed under the educational community license version 2 0", 1.0),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("eupl-1.2", "licensed under the eupl(?: version)? 1 2", 1.0),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.95),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", 0.9),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", 0.9),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|work|software)", 0.95),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 0.95),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", 0.95),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 0.9),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.6),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("jpeg", "this software is based in part on the work of the independent jpeg group", 0.9),
    ("json", "the software shall be used for good not evil", 1.0),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", 0.95),
    ("lgpl-2.1", "either version 2 1 of the license or at your option any later version", 0.95),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:library|program|software)", 0.95),
    ("lppl-1.3c", "this work may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("mit-0", "furnished to do so the software is provided as is without warranty of any kind", 0.8),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("ms-rl", "microsoft reciprocal license", 0.9),
    ("ncsa", "developed by (?:[a-z0-9]{1,20} ){1,20}university of illinois (?:[a-z0-9]{1,20} ){0,10}permission is hereby granted", 0.8),
    ("no-license", "no license express or implied is granted", 0.7),
    ("odbl-1.0", "made available under the open database license", 1.0),
    ("odc-by-1.0", "made available under the open data commons attribution license", 1.0),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("osl-3.0", "licensed under the open software license version 3 0", 1.0),
    ("php-3.01", "this product includes php software freely available from", 1.0),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("proprietary", "unauthorized copying of this (?:file|work|software) via any medium is strictly prohibited", 0.9),
    ("proprietary", "this (?:software|work) is the confidential and proprietary information of", 0.9),
    ("proprietary", "no part of this (?:work|publication|book) may be reproduced (?:[a-z0-9]{1,20} ){0,12}without (?:the )?(?:prior )?(?:written )?permission", 0.9),
    ("proprietary", "licensed not sold", 0.6),
    ("psf-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test", 1.0),
    ("public-domain", "this (?:software|work) is in the public domain", 0.9),
    ("python-2.0", "beopen hereby grants licensee a non exclusive royalty free world wide license", 1.0),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", 0.9),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the (?:[a-z0-9]{1,20} ){1,6}software", 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("upl-1.0", "the universal permissive license upl version 1 0 subject to the condition set forth below permission is hereby granted", 1.0),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text", 1.0),
    ("w3c", "w3c software notice and license", 1.0),
    ("wtfpl", "do what the fuck you want to public license", 1.0),
    ("x11", "except as contained in this notice the name of (?:[a-z0-9]{1,20} ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", 0.95),
    ("zpl-2.1", "zope public license zpl version 2 1", 1.0),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Where the texts of an expression may differ.
GAP = "\t"
OPTIONAL = r"\(\?:[^()]*\)(?:\?|\{\d+,\d+\})"


def _texts(e: str) -> list[str]:
    """What every match of ``e`` reads, one for each branch, with GAP for optional parts and classes."""
    flat = re.sub(OPTIONAL, GAP, e)
    while flat != e:
        e, flat = flat, re.sub(OPTIONAL, GAP, flat)
    e = re.sub(r"\[[^]]*\](?:\{\d+\})?\??|[^()]\?", GAP, e)
    m = re.search(r"\(\?:([^()]*)\)", e)
    return [x for branch in m[1].split("|") for x in _texts(e[: m.start()] + branch + e[m.end() :])] if m else [e]


def keywords(e: str) -> set[str]:
    """Strings of which every match of ``e`` between spaces contains one: the longest literal of each branch."""
    return {max(f" {x} ".split(GAP), key=len) for x in _texts(e)}


@functools.lru_cache(maxsize=1)
def ranked_rules() -> list[tuple[int, str, list[str], str, float, list[str]]]:
    """(priority, label, keywords, expression, confidence, keywords of the phrasing), highest
    priority first and of equal ones the longer expression. A match contains one of either
    kind of keywords, if there are any of the second."""
    out = [(p, label, sorted(keywords(e)), f"(?<= ){e}(?= )", c, []) for label, e, p, c in GENERAL]
    out += [(95, label, sorted(keywords(e)), f"(?<= ){e}(?= )", c, []) for label, e, c in SIGNATURES]
    for label, name, ident in LICENSES:
        for phrase, p, c in PHRASINGS:
            keys = sorted((keywords(name) if "NAME" in phrase else set()) | (keywords(ident) if "ID" in phrase else set()))
            also = sorted(k.strip() for k in keywords(phrase.replace("NAME", GAP).replace("ID", GAP)))
            out.append((p, label, keys, "(?<= )" + phrase.replace("NAME", name).replace("ID", ident) + "(?= )", c, also))
        if "licen" in name or label.startswith("cc"):  # such names stand for a license by themselves
            out.append((48, label, sorted(keywords(name)), f"(?<= ){name}(?= )", 0.6, []))
    return sorted(out, key=lambda r: (-r[0], -len(r[3]), r[1]))


@functools.lru_cache(maxsize=1)
def anchors() -> tuple[str, ...]:
    """A few words of which every keyword contains one, by taking the word that most of those left contain."""
    left, out = sorted({k for r in ranked_rules() for k in r[2]}), []
    while left:
        # Long words are rare in other texts; a keyword without one stands for itself.
        words = sorted({w for k in left for w in ([x for x in k.split() if len(x) > 6] or [k])})
        best = max(words, key=lambda w: (sum(w in k for k in left), len(w)))
        out.append(best.strip() if len(best.strip()) > 4 else best)
        left = [k for k in left if best not in k]
    return tuple(out)


def rules() -> list[tuple[str, list[str], str, float]]:
    """(label, keywords, expression, confidence) in order of priority."""
    return [r[1:5] for r in ranked_rules()]


#: Entries of a growing array before it is closed; appending to a long one would copy it again and again.
CHUNK = 256


def _collected(items: Column, start: Column, step, kind: str) -> Column:
    """An array of what ``step`` (state, item) gives: the next state, an entry, and whether to keep it."""
    state = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def merge(acc: Column, x: Column) -> Column:
        following, entry, keep = step(acc["s"], x)
        now = F.when(keep, F.concat(acc["now"], F.array(entry.cast(kind)))).otherwise(acc["now"])
        full = F.size(acc["now"]) >= CHUNK
        fresh = F.when(keep, F.array(entry.cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
        return F.struct(following.alias("s"), F.when(full, fresh).otherwise(now).alias("now"), F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(items, state, merge, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _spaces(column: Column) -> Column:
    return F.octet_length(column) - F.octet_length(F.replace(column, F.lit(" "), F.lit("")))


def _constant(x) -> str:
    """SQL of a constant, which is made once and not for every row."""
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(x, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_constant(v)}" for k, v in x.items()) + ")"
    if isinstance(x, list):
        return "array(" + ", ".join(map(_constant, x)) + ")" if x else "cast(array() as array<string>)"
    return f"{x}D" if isinstance(x, float) else str(x)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, words and base places, the rules' detections (label, first word, the word
    behind the last, confidence), all labels and the score of every document."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    spaced = docs.select("doc_id", F.concat(F.lit(" "), F.regexp_replace(lowered, NOT_WORD, " "), F.lit(" ")).alias("s"))
    # What stands before the first word and behind the last may double the space.
    w = spaced.select("doc_id", F.when(F.trim("s") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), F.trim("s"), F.lit(" "))).alias("t"))
    t = F.col("t")
    columns = [F.col("doc_id"), t, (_spaces(t) - 1).cast("long").alias("n_words")]
    for k, (phrase, _) in enumerate(BASE):
        columns.append(F.contains(t, F.lit(f" {phrase} ")).alias(f"has{k}"))
    ordered = ranked_rules()
    texts = lambda x: F.expr(_constant(sorted(x)))
    own = F.filter(texts({k for r in ordered for k in r[2]}), lambda k: F.contains(t, k))
    present = F.when(F.exists(texts(anchors()), lambda k: F.contains(t, k)), own).otherwise(F.array().cast("array<string>"))
    w = w.select(*columns, present.alias("present"))
    for k, (phrase, _) in enumerate(BASE):
        n, wide = len(phrase.split()), F.replace(t, F.lit(" "), F.lit("  "))
        mark = " " + phrase.replace(" ", "  ") + " "
        has = F.col(f"has{k}")
        count = (F.octet_length(wide) - F.octet_length(F.replace(wide, F.lit(mark), F.lit("")))) / len(mark)
        first = _spaces(F.substring(t, F.lit(1), F.instr(t, f" {phrase} "))) - 1
        back = F.reverse(t)
        last = F.col("n_words") - (_spaces(F.substring(back, F.lit(1), F.instr(back, f" {phrase[::-1]} "))) - 1) - n
        w = w.withColumns({f"n{k}": F.when(has, count.cast("long")).otherwise(F.lit(0).cast("long")), f"first{k}": F.when(has, first.cast("long")), f"last{k}": F.when(has, last.cast("long"))})

    levels = sorted({r[0] for r in ordered}, reverse=True)
    table = [dict(label=label, keys=keys, also=also, e=e, c=c, level=levels.index(p), rule=k) for k, (p, label, keys, e, c, also) in enumerate(ordered)]
    every = F.expr(_constant(table))
    interval = "struct<start:int,end:int,level:int,rule:int,label:string,confidence:double>"

    def matches(r: Column) -> Column:
        """The intervals of one rule, in words: what stands between matches and the matches give the places."""
        parts = F.zip_with(F.split(t, r["e"], -1), F.regexp_extract_all(t, r["e"], F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

        def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
            start, n = at + _spaces(x["gap"]), _spaces(F.coalesce(x["m"], F.lit("")))
            return (start + n).cast("int"), F.struct((start - 1).cast("int").alias("start"), (start + n).cast("int").alias("end"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label"), r["c"].alias("confidence")), x["m"].isNotNull()

        return _collected(parts, F.lit(0), step, interval)

    tried = F.filter(every, lambda r: F.arrays_overlap(r["keys"], "present") & ((F.size(r["also"]) == 0) | F.exists(r["also"], lambda k: F.contains(t, k))))
    found = F.flatten(F.transform(F.filter(tried, lambda r: F.rlike(t, r["e"])), matches))
    order = lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["level"].alias("level"), c["rule"].alias("rule"), c["label"].alias("label"), c["confidence"].alias("confidence"))
    w = w.withColumn("places", F.when(F.size("present") > 0, F.array_sort(F.transform(found, order))).otherwise(F.array().cast("array<struct<start:int,back:int,level:int,rule:int,label:string,confidence:double>>")))

    def uncovered(ends: Column, x: Column) -> tuple[Column, Column, Column]:
        """Sorted by start and the longer first, so whatever ends as late at this level or a higher one contains ``x``."""
        inside = F.array_max(F.slice(ends, 1, x["level"] + 1)) >= -x["back"]
        reach = F.transform(ends, lambda v, k: F.when(k == x["level"], F.greatest(v, -x["back"])).otherwise(v))
        entry = F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["back"]).cast("int").alias("end"), x["confidence"].alias("confidence"))
        return reach, entry, ~inside

    kept = _collected(F.col("places"), F.array(*[F.lit(-1)] * len(levels)), uncovered, "struct<label:string,start:int,end:int,confidence:double>")
    w = w.withColumn("detections", F.when(F.size("places") > 0, kept).otherwise(F.array().cast("array<struct<label:string,start:int,end:int,confidence:double>>")))
    base = F.array_compact(F.array(*[F.when(F.col(f"has{k}"), F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    three = range(len(BASE))
    return w.select(
        "doc_id",
        "n_words",
        sum((F.col(f"n{k}") for k in three), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[f"first{k}" for k in three]).alias("first_word"),
        F.greatest(*[f"last{k}" for k in three]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
        "detections",
    )
