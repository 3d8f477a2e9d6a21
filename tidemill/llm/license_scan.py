r"""License scans by ordered signature rules (operator 8), with DataFrame functions only.

A rule has a label, a keyword, a pattern, a priority and a weight; rules come from a table of
licenses (identifier tag, address, grant sentence, bare name), from further names, and from
sentences of the licenses themselves.  Whole texts are scanned, with runs of white space as one
space; a pattern runs only where its keyword stands.  Of the detections the one of the highest
priority stays, of equal ones the longest, then the first; what lies inside of, or overlaps, one
that stays is suppressed.  Everything happens within the row: no shuffle, no join.
"""

from __future__ import annotations

from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Label, keyword of the name, pattern of the name, pattern of the identifier, pattern of the address.
LICENSES = [
    ("mit", "mit", r"mit[ /-]+licen[cs]e", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit[ -](?:no[ -]attribution|0) licen[cs]e", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    ("apache-2.0", "apache", r"apache(?: software)?,? licen[cs]e,?(?:[ \n]+version)?[ \n]+2(?:\.0)?|apache-2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,?(?:[ \n]+version)?[ \n]+1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e,?(?:[ \n]+version)?[ \n]+1\.0", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,?[ \n]+(?:version|v\.?)[ \n]*1(?:\.0)?\b", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,?[ \n]+(?:version|v\.?)[ \n]*2(?:\.0)?\b", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,?[ \n]+(?:version|v\.?)[ \n]*3(?:\.0)?\b", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public licen[cs]e(?:,?[ \n]+(?:version|v\.?)[ \n]*2(?:\.0)?)?", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public licen[cs]e,?[ \n]+(?:version|v\.?)[ \n]*2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public licen[cs]e,?[ \n]+(?:version|v\.?)[ \n]*3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", r"lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,?[ \n]+(?:version|v\.?)[ \n]*3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?:,?[ \n]+version[ \n]*1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2[- ]clause|two[- ]clause|freebsd) bsd licen[cs]e|bsd[ -]2[ -]clause(?: licen[cs]e)?", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd licen[cs]e|bsd[ -]3[ -]clause(?: licen[cs]e)?", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4[- ]clause|four[- ]clause) bsd licen[cs]e|bsd[ -]4[ -]clause(?: licen[cs]e)?", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", "bsd", r"(?:zero[- ]clause|0[- ]clause) bsd licen[cs]e|bsd zero[ -]clause(?: licen[cs]e)?", r"0bsd", r"opensource\.org/licenses?/0bsd"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e", r"bsd", r"opensource\.org/licenses?/bsd-license"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,?[ \n]+(?:version|v\.?)?[ \n]*1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*2(?:\.0)?)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: -)?,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: -)?(?:,?[ \n]+(?:version|v\.?)?[ \n]*2(?:\.0)?)?", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: -)?(?:,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?)?", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?:,?[ \n(]+(?:version|v\.?)?[ \n]*1(?:\.[01])?)?", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    ("cpal-1.0", "attribution", r"common public attribution licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?)?", r"cpal-1\.0", r"opensource\.org/licenses?/cpal"),
    ("isc", "isc", r"\bisc licen[cs]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", r"(?<!/)libpng licen[cs]e", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:[ \n-]+(?:version|v\.?)?[ \n]*1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1\.1)?", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?", r"artistic-1\.0(?:-perl|-cl8)?", r"opensource\.org/licenses?/artistic-license-1\.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*2(?:\.0)?)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-license-2\.0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*3(?:\.0)?)?", r"afl-3\.0", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*3(?:\.0)?)?", r"osl-3\.0", r"opensource\.org/licenses?/osl-3\.0"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e,?[ \n]+(?:version|v\.?)?[ \n]*1\.1", r"eupl-1\.1", r"joinup\.ec\.europa\.eu/software/page/eupl/licence-eupl"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1\.2)?", r"eupl-1\.2", r"joinup\.ec\.europa\.eu/collection/eupl"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?:[ \n]+agreement)?(?:,?[ \n]+(?:version|v\.?)?[ \n]*2\.[01])?", r"cecill-2\.[01]", r"cecill\.info/licences/licence_cecill_v2"),
    ("cc0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", "cc by", r"cc by(?:[ -][1-4]\.[05])?", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "cc by", r"cc by-sa(?:[ -][1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "cc by", r"cc by-nc(?:[ -][1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "cc by", r"cc by-nd(?:[ -][1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", "cc by", r"cc by-nc-sa(?:[ -][1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "cc by", r"cc by-nc-nd(?:[ -][1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("creative-commons", "creative commons", r"creative commons(?: [a-z-]+){0,6} licen[cs]e", r"cc", r"creativecommons\.org/licenses"),
    ("unlicense", "unlicense", r"\bthe unlicense\b|unlicense\.org", r"unlicense", r"unlicense\.org"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed|is)[ \n]+(?:to|into|in)[ \n]+the[ \n]+public domain", r"public-domain", r"creativecommons\.org/publicdomain/mark"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1\.1)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e(?:,?[ \n]+v?1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?:,?[ \n]+v?1\.0)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e(?:,?[ \n]+version[ \n]*2)?", r"(?:psf|python)-2\.0", r"docs\.python\.org/3/license"),
    ("php-3.01", "php", r"php licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*3\.01)?", r"php-3\.01", r"php\.net/license/3_01"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("vim", "vim", r"vim licen[cs]e", r"vim", r"vimdoc\.sourceforge\.net/htmldoc/uganda"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*2(?:\.0)?)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?:,?[ \n]+(?:version|v\.?)?[ \n]*1(?:\.0)?)?", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    ("all-rights-reserved", "all rights", r"all rights reserved", r"licenseref-all-rights-reserved", None),
]
#: Label, keyword and pattern of further names, which do not hold the keyword in LICENSES.
ALIASES = [
    ("mit", "expat", r"expat[ /-]+licen[cs]e"), ("mit", "x11", r"x11[ /-]+licen[cs]e"), ("apache-2.0", "asl", r"asl ?2\.0"), ("apache-2.0", "apache", r"apache v?2(?:\.0)?"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?:\.0)?(?:-only|-or-later|\+)?(?![a-z0-9.])"), ("gpl-3.0", "gpl", r"gpl ?v?3(?:\.0)?(?:-only|-or-later|\+)?(?![a-z0-9.])"), ("gpl-2.0", "gpl", r"gpl,? version 2(?:\.0)?(?![a-z0-9.])"), ("gpl-3.0", "gpl", r"gpl,? version 3(?:\.0)?(?![a-z0-9.])"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2\.1(?:-only|-or-later|\+)?(?![a-z0-9.])"), ("lgpl-3.0", "lgpl", r"lgpl ?v?3(?:\.0)?(?:-only|-or-later|\+)?(?![a-z0-9.])"), ("agpl-3.0", "agpl", r"agpl ?v?3(?:\.0)?(?:-only|-or-later|\+)?(?![a-z0-9.])"),
    ("mpl-2.0", "mpl", r"mpl ?v?2\.0"), ("mpl-1.1", "mpl", r"mpl ?v?1\.1"), ("epl-2.0", "epl", r"epl ?v?2\.0"), ("epl-1.0", "epl", r"epl ?v?1\.0"), ("eupl-1.2", "eupl", r"eupl ?v?1\.2"), ("eupl-1.1", "eupl", r"eupl ?v?1\.1"), ("cddl-1.0", "cddl", r"cddl ?v?1\.[01]"),
    ("bsl-1.0", "bsl", r"bsl-1\.0"), ("sspl-1.0", "sspl", r"sspl ?v?1"), ("gfdl", "gfdl", r"gfdl ?v?1\.[123]"), ("cc0-1.0", "creative commons zero", r"creative commons zero"), ("wtfpl", "you want to public licen", r"do what the f[u*]ck you want to public licen[cs]e"), ("psf-2.0", "psf", r"psf licen[cs]e"),
]
#: Label, keyword and pattern of sentences that stand in a license, white space as one space.
SENTENCES = [
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-1.0", "free of charge", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("apache-2.0", "in compliance with the licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of [a-z0-9 ,'&/-]{1,120} may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("isc", "for any purpose", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("0bsd", "for any purpose", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("gpl", "free software", r"is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "free software", r"is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", "free software", r"is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed"),
    ("wtfpl", "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("gfdl", "copy, distribute and/or modify", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("zlib", "as-is", r"this software is provided ['\"]?as-is['\"]?, without any express or implied warranty"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("ofl-1.1", "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl-1.0", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic-2.0", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed\. preamble this licen[cs]e establishes"),
    ("cc-by", "creative commons attribution", r"creative commons attribution [1-4]\.[05](?: international| unported| generic)? licen[cs]e"),
    ("cc-by-sa", "sharealike", r"creative commons attribution-sharealike(?: [1-4]\.[05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution-noncommercial(?: [1-4]\.[05])?(?: international| unported| generic)? licen[cs]e"),
    ("cc0-1.0", "dedicated", r"has dedicated the work to the public domain by waiving all of his or her rights"),
    ("public-domain", "no copyright is", r"no copyright is claimed"), ("public-domain", "known copyright", r"no known copyright restrictions"),
    ("all-rights-reserved", "reproduc", r"no part of this (?:publication|book|work) may be reproduced"),
]
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"
#: The phrases of the base rules and their labels.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, weight), first the rules that win.  Every match of a pattern holds its keyword."""
    out = [(label, keyword, pattern, 35, 1.0) for label, keyword, pattern in SENTENCES]
    for label, keyword, name, ident, address in LICENSES:
        out.append((label, "spdx-license-identifier", rf"spdx-license-identifier: ?(?:{ident})(?![a-z0-9.+-])", 40, 1.0))
        if address is not None:
            out.append((label, address.replace("\\", "").replace("?", "").split("/")[0], rf"https?://(?:www\.)?(?:{address})", 30, 0.9))
        for own, pattern in [(keyword, name), *(a[1:] for a in ALIASES if a[0] == label)]:
            out += [(label, own, rf"{GRANT}(?:{pattern})", 20, 0.95), (label, own, rf"(?<![a-z0-9])(?:{pattern})", 10, 0.7)]
    return sorted(out, key=lambda r: -r[3])


#: What most rules' matches hold besides the keyword.
COMMON = "licen"


def must_hold(pattern: str, word: str) -> bool:
    """Whether every match of a pattern holds word, as far as its parts tell."""

    def part(op: object, value: tuple) -> bool:
        if op is parser.SUBPATTERN:
            return sequence(value[-1])
        if op is parser.MAX_REPEAT or op is parser.MIN_REPEAT:
            return value[0] > 0 and sequence(value[2])
        return op is parser.BRANCH and all(sequence(x) for x in value[1])

    def sequence(items: object) -> bool:
        run = "".join(chr(value) if op is parser.LITERAL else "\0" for op, value in items)
        return word in run or any(part(op, value) for op, value in items)

    return sequence(parser.parse(pattern))


def phrase_places(words: Column) -> Column:
    """(start, label) of each place where a base phrase stands in words."""

    def at(phrase: tuple[str, ...], label: str) -> Column:
        def stands(i: Column) -> Column:
            test = F.get(words, i) == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                test = test & (F.get(words, i + k) == word)
            return test

        last = F.size(words) - len(phrase)
        return F.when(last >= 0, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))))

    found = [F.when(F.array_contains(words, p[0]), at(p, label)) for p, label in BASE]
    empty = F.array().cast("array<struct<start:int,label:string>>")
    return F.concat(*[F.coalesce(x, empty) for x in found])


def detections(lower: Column) -> Column:
    """(start, size, order, stop, label, weight) of all rules' matches in a text without runs of white space; size and order are negative, so that they sort."""
    by_keyword: dict[str, list[tuple]] = {}
    for rule in rules():
        by_keyword.setdefault(rule[1], []).append(rule)
    one = lambda a, p, n, w: F.struct(F.lit(a).alias("label"), F.lit(must_hold(p, COMMON)).alias("common"), F.lit(p).alias("pattern"), F.lit(-n).alias("order"), F.lit(w).alias("weight"))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[one(a, p, n, w) for a, _, p, n, w in own]).alias("rules")) for k, own in by_keyword.items()])
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<order:int,size:int,start:int,stop:int,label:string,weight:double>>").alias("all"))

    def matches(rule: Column) -> Column:
        # what stands between the matches, and, if there are any, the matches
        return F.get(F.transform(F.array(F.transform(F.split(lower, rule["pattern"]), lambda x: F.length(x))), lambda gaps: told(rule, gaps)), 0)

    def told(rule: Column, gaps: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(lower, rule["pattern"], F.lit(0)), lambda x: F.length(x))

        def placed(acc: Column, s: Column) -> Column:
            start = acc["end"] + s["gap"]
            one = F.struct(rule["order"].alias("order"), (-s["size"]).alias("size"), start.alias("start"), (start + s["size"]).alias("stop"), rule["label"].alias("label"), rule["weight"].alias("weight"))
            return F.struct((start + s["size"]).alias("end"), F.concat(acc["all"], F.array(one)).alias("all"))

        steps = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), lambda s: s["size"].isNotNull())
        return F.when(F.size(gaps) > 1, F.aggregate(steps, none, placed)["all"]).otherwise(none["all"])

    # a keyword is looked for once for all its rules, and what most rules need once for all
    at_hand = F.flatten(F.transform(F.filter(table, lambda k: F.contains(lower, k["keyword"])), lambda k: k["rules"]))
    rest = F.when(F.contains(lower, F.lit(COMMON)), at_hand).otherwise(F.filter(at_hand, lambda r: ~r["common"]))
    found = F.flatten(F.transform(rest, matches))
    return F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["order"].alias("order"), d["size"].alias("size"), d["label"].alias("label"), d["stop"].alias("stop"), d["weight"].alias("weight")))


def surviving(found: Column) -> Column:
    """Labels and largest weight of the detections that stay.

    Detections are taken in order of priority, of equal ones the longer first, then the first;
    one that overlaps another that stays goes.  So one goes only because of what stays.  They
    are grouped first, from left to right, into chains of overlaps, which settle by themselves,
    so the work grows with the chains' lengths, not with the number of detections in a text.
    """
    kinds = "array<struct<order:int,size:int,start:int,label:string,stop:int,weight:double>>"
    none = F.array().cast(kinds)

    def settled(chain: Column) -> Column:
        ranked = F.array_sort(F.transform(chain, lambda d: F.struct(*[d[c].alias(c) for c in ("order", "size", "start", "label", "stop", "weight")])))
        return F.aggregate(ranked, none, lambda kept, d: F.when(F.exists(kept, lambda k: (d["start"] < k["stop"]) & (k["start"] < d["stop"])), kept).otherwise(F.concat(kept, F.array(d))))

    def step(acc: Column, d: Column) -> Column:
        own = F.array(F.struct(*[d[c].alias(c) for c in ("order", "size", "start", "label", "stop", "weight")]))
        apart = d["start"] >= acc["stop"]
        return F.struct(
            F.when(apart, F.concat(acc["chains"], F.array(acc["chain"]))).otherwise(acc["chains"]).alias("chains"), F.when(apart, own).otherwise(F.concat(acc["chain"], own)).alias("chain"), F.when(apart, d["stop"]).otherwise(F.greatest(acc["stop"], d["stop"])).alias("stop")
        )

    def finish(acc: Column) -> Column:
        return F.flatten(F.transform(F.concat(acc["chains"], F.array(acc["chain"])), settled))

    start = F.struct(F.array().cast(f"array<{kinds}>").alias("chains"), none.alias("chain"), F.lit(-1).alias("stop"))
    kept = F.aggregate(F.array_sort(found), start, step, finish)
    labels, most = F.array_distinct(F.transform(kept, lambda d: d["label"])), F.coalesce(F.array_max(F.transform(kept, lambda d: d["weight"])), F.lit(0.0))
    return F.struct(labels.alias("labels"), most.alias("weight"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with base places, labels and a score.

    score is the largest weight of a surviving rule, 0.5 for base phrases alone, else 0.
    Null and empty texts have no words and no labels (empty strings, null first and last
    word); repeated rows and ids are scanned one by one; of equal detections the first label by
    name stays; texts of any length are scanned whole; an empty table gives an empty one; other
    columns are ignored.
    """
    lower = docs.select("doc_id", C.lower_az(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lower"))
    # a text that holds no keyword's rarest part is not looked at again
    keywords = sorted({r[1] for r in rules()})
    told = [k for k in keywords if not any(k != o and o in k for o in keywords)]
    trigger = F.lit(False)
    for k in told:
        trigger = trigger | F.contains("plain", F.lit(k))
    spaced = lower.withColumn("plain", F.regexp_replace("lower", r"[ \t\n\r\f\x0B]+", " "))
    words = spaced.select("doc_id", "lower", C.split_words(F.col("lower")).alias("words"), F.when(trigger, F.col("plain")).alias("near"))
    found = words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.when(F.contains("lower", F.lit("license")), phrase_places(F.col("words"))).alias("places"),
        F.when(F.col("near").isNotNull(), surviving(detections(F.col("near")))).alias("own"),
    )
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.coalesce(F.transform("places", lambda p: p["label"]), F.array().cast("array<string>"))))
    own = F.coalesce(F.col("own")["labels"], F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("own")["weight"], F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


#: DuckDB SQL for the base columns.
BASE_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc WHERE list_contains(w, 'license')),
hit AS (SELECT doc_id, s, CASE WHEN w[s] = 'mit' AND w[s + 1] = 'license' THEN 'mit' WHEN w[s] = 'apache' AND w[s + 1] = 'license' THEN 'apache' WHEN w[s] = 'general' AND w[s + 1] = 'public' AND w[s + 2] = 'license' THEN 'gpl' END AS l FROM spot),
found AS (SELECT doc_id, count(*) AS n, min(s) - 1 AS a, max(s) - 1 AS b, string_agg(DISTINCT l, ',' ORDER BY l) AS l FROM hit WHERE l IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(l, '') AS base_labels FROM doc LEFT JOIN found USING (doc_id)
"""
