"""License scan by ordered signature rules; DataFrame functions only.

A text is brought to its words (A-Z lower-cased, joined by single spaces).  Rules are regular expressions over that form;
each has a label, a priority and a keyword that must occur before its expression is tried.  First come sentences that only
one license's text or notice has, written out one by one (``SIGNATURES``), then statements that name a license, made from
its names (``FAMILIES``) and forms of words (``FORMS``), then bare identifiers (``IDENTIFIERS``).  A detection is dropped if
one of a better priority covers its interval.  Everything is done inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, let, running, table

#: What separates words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families: label, keyword, name (expression over words), short identifier (expression over words).
FAMILIES = [
    ("gpl", "general", r"gnu general public licen[sc]e", r"gpl"),
    ("lgpl", "lesser", r"gnu (?:lesser|library) general public licen[sc]e", r"lgpl"),
    ("agpl", "affero", r"gnu affero general public licen[sc]e", r"agpl"),
    ("fdl", "documentation", r"gnu free documentation licen[sc]e", r"gfdl"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", r"apache"),
    ("mit", "licen", r"(?:mit|expat|x11) licen[sc]e", r"mit"),
    ("bsd", "bsd", r"(?:(?:[234]|two|three|four) clause )?bsd(?: [234] clause)?(?: style)? licen[sc]e", r"bsd(?: [234] clause)?"),
    ("isc", "isc", r"isc licen[sc]e", r"isc"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"epl"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e", r"cddl"),
    ("cpl", "common", r"common public licen[sc]e", r"cpl"),
    ("eupl", "european", r"european union public licen[sc]e", r"eupl"),
    ("artistic", "artistic", r"artistic licen[sc]e", r"artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("boost", "boost", r"boost software licen[sc]e", r"bsl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e", r"wtfpl"),
    ("python", "python", r"python software foundation licen[sc]e", r"psf"),
    ("php", "php", r"php licen[sc]e", r"php"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", r"ofl"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e", r"odbl"),
    ("osl", "open", r"open software licen[sc]e", r"osl"),
    ("afl", "academic", r"academic free licen[sc]e", r"afl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"ms pl"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby"),
    ("vim", "vim", r"vim licen[sc]e", r"vim"),
    ("cc0", "cc0", r"cc0(?: universal)?", r"cc0"),
    ("cc0", "zero", r"creative commons zero(?: universal)?", r"creative commons zero"),
    ("cc-by", "cc", r"cc by", r"cc by"),
    ("cc-by-sa", "cc", r"cc by sa", r"cc by sa"),
    ("cc-by-nc", "cc", r"cc by nc", r"cc by nc"),
    ("cc-by-nd", "cc", r"cc by nd", r"cc by nd"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", r"cc by nc nd"),
    ("cc-by", "creative", r"creative commons attribution", r"creative commons attribution"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:s|atives)?", r"creative commons attribution no ?deriv(?:s|atives)?"),
    ("proprietary", "proprietary", r"proprietary (?:software )?licen[sc]e", r"proprietary"),
    ("commercial", "commercial", r"commercial licen[sc]e", r"commercial"),
]

#: A text without any of these has no license; every rule and base phrase needs one of them.
GATES = (
    "licens", "licenc", "spdx", "permission", "permitted", "redistribut", "software", "copyright", "public domain", "reserved", "proprietary", "creative commons", " cc by", " ccby", " cc0", " cc 0",
    "gpl", "wtfpl", " apache ", " bsd ", " mpl ", " epl ", " cddl ", " eupl ", " lppl ", " ofl ", "verbatim copies", "kopimi", "beer in return", "without fee", "plainly marked", "libpng", "as perl itself", "package may be copied", "distributing unmodified copies", "the fuck",
    "will be useful", "making a combined work", "gcc runtime", "as a special exception", "uses this font", "invariant sections", "nasa open source", " x consortium", "bsd",
)

#: A version after a name.
VERSION = r"(?: international| unported)?(?: version| v)? ?v?[0-9]+(?: [0-9]+){0,2}(?: or (?:any )?later)?"

#: Statement forms around a family's name {n} or identifier {i}; best priority first, with the label's confidence.
FORMS = [
    (r"(?:licensed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?{n}{v}", 1.0),
    (r"spdx licen[sc]e identifier {i}(?: [0-9]+){{0,2}}(?: only| or later)?", 1.0),
    (r"(?:under|terms of|subject to|according to) (?:the )?(?:terms of )?(?:the )?{n}{v}", 0.95),
    (r"(?:licensed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?{n}", 0.9),
    (r"licen[sc]e[d]?(?: is| name| type)? {i}(?: [0-9]+){{0,2}}", 0.85),
    (r"{n}{v}", 0.8),
    (r"{n}", 0.6),
]

#: Sentences of license texts and notices: label, keyword, expression, confidence; the more specific first.
SIGNATURES = [
    # permissive
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("mit", "sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 1.0),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising", 1.0),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("boost", "executable", r"copies of the software and derivative works .{0,80}solely in the form of machine executable object code", 0.95),
    ("isc", "disclaims", r"the software is provided as is and the (?:author|isc|copyright holders?) disclaims? all warranties with regard to this software", 0.9),
    ("isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("curl", "fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.95),
    ("postgresql", "written", r"for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("hpnd", "advertising", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", 0.9),
    ("libtiff", "hereby", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.95),
    ("ntp", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.9),
    ("tcl", "regents", r"this software is copyrighted by the regents of the university of california sun microsystems", 1.0),
    ("0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd|0bsd)", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,120} may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-3-clause", "endorse", r"the names? of .{1,80} may not be used to endorse or promote products derived from this software", 0.95),
    ("ncsa", "illinois", r"university of illinois ncsa open source license", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions", 0.95),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.95),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("apache", "compliance", r"you may not use this file except in compliance with the license", 0.95),
    ("apache", "governing", r"see the license for the specific language governing permissions and limitations under the license", 0.95),
    ("apache", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache", "patent", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 0.95),
    ("apache-1.1", "developed", r"this product includes software developed by the apache software foundation", 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 1.0),
    ("zlib", "authors", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("libpng", "libpng", r"this copy of the libpng notices is provided for your convenience", 1.0),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "freetype", r"(?:the freetype project license|portions of this software are copyright .{0,40}the freetype project)", 1.0),
    ("unicode", "unicode", r"unicode inc license agreement data files and software", 1.0),
    ("icu", "icu", r"icu license icu 1 8 1 and later", 1.0),
    ("w3c", "w3c", r"w3c software (?:notice and|and document) license", 1.0),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", 1.0),
    ("php", "php", r"this product includes php software freely available from", 1.0),
    ("php", "php", r"products derived from this software may not be called php", 1.0),
    ("python", "psf", r"this license agreement is between the python software foundation psf", 1.0),
    ("python", "psf", r"psf is making python .{0,20}available to licensee on an as is basis", 1.0),
    ("python", "beopen", r"beopen com (?:license agreement|terms and conditions) for python", 1.0),
    ("python", "cnri", r"cnri (?:open source|license agreement)", 0.9),
    ("artistic", "perl", r"under the same terms as perl itself", 0.9),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed", 1.0),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim", 1.0),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction", 1.0),
    ("beerware", "beer", r"(?:you can buy me a beer in return|the beer ?ware license)", 1.0),
    ("fair", "instrument", r"usage of the works is permitted provided that this instrument is retained", 1.0),
    ("miros", "disclaimer", r"provided that these terms and disclaimer and all copyright notices are retained or reproduced in an accompanying document", 1.0),
    ("fsf-all-permissive", "royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    ("fsf-unlimited", "unlimited", r"the free software foundation gives unlimited permission to copy and or distribute it", 1.0),
    ("upl", "universal", r"universal permissive license", 0.95),
    ("blueoak", "oak", r"blue oak model license", 1.0),
    ("mulan-psl", "mulan", r"mulan (?:permissive software license|psl)", 1.0),
    ("ecl", "educational", r"educational community license", 0.95),
    ("zpl", "zope", r"zope public license", 1.0),
    ("openldap", "openldap", r"(?:the )?openldap public license", 1.0),
    ("intel", "intel", r"intel open source license", 1.0),
    ("bzip2", "bzip2", r"this program bzip2 the associated library libbzip2 and all documentation are copyright", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 1.0),
    # copyleft
    ("gpl-3", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl", "affero", r"the gnu affero general public license is a free copyleft license for software", 1.0),
    ("gpl-2", "designed", r"the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("lgpl-3", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 1.0),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.9),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it", 0.9),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it", 0.9),
    ("gpl", "hope", r"this (?:program|software|file|code) is distributed in the hope that it will be useful but without any warranty", 0.85),
    ("lgpl", "hope", r"this library is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl-2+", "option", r"(?:either )?version 2 (?:of the license )?or at your option any later version", 0.95),
    ("gpl-3+", "option", r"(?:either )?version 3 (?:of the license )?or at your option any later version", 0.95),
    ("lgpl-2.1+", "option", r"(?:either )?version 2 1 (?:of the license )?or at your option any later version", 0.95),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license", 1.0),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 1.0),
    ("gpl", "received", r"you should have received a copy of the gnu general public license", 1.0),
    ("classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work", 1.0),
    ("gcc-exception", "gcc", r"gcc runtime library exception", 1.0),
    ("autoconf-exception", "autoconf", r"as a special exception .{0,120}configuration script generated by autoconf", 1.0),
    ("bison-exception", "bison", r"as a special exception .{0,120}part or all of the bison parser skeleton", 1.0),
    ("font-exception", "font", r"if you create a document which uses this font and embed this font or unaltered portions of this font", 1.0),
    ("fdl", "invariant", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts", 1.0),
    ("fdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license v ?2 0", 1.0),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]", 1.0),
    ("mpl", "incompatible", r"incompatible with secondary licenses", 0.9),
    ("npl", "netscape", r"netscape public license", 0.95),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 1.0),
    ("cpl", "accompanying", r"the accompanying program is provided under the terms of this common public license", 1.0),
    ("ipl", "ibm", r"ibm public license", 0.95),
    ("lpl", "lucent", r"lucent public license", 0.95),
    ("cddl", "cddl", r"when distributing covered (?:code|software) include this cddl header notice in each file", 1.0),
    ("cddl", "common", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("apsl", "apple", r"apple public source license", 0.95),
    ("qpl", "q", r"q public license", 0.95),
    ("rpl", "reciprocal", r"(?:microsoft )?reciprocal (?:public )?license", 0.9),
    ("sissl", "sun", r"sun industry standards source license", 1.0),
    ("sspl", "server", r"server side public license", 1.0),
    ("busl", "business", r"business source license", 0.95),
    ("elastic", "elastic", r"elastic license(?: 2 0| agreement)?", 0.9),
    ("commons-clause", "commons", r"commons clause license condition", 1.0),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license", 1.0),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)? licen[sc]e", 0.95),
    ("cecill", "cecill", r"licence cecill", 0.95),
    ("eupl", "eupl", r"licensed under the eupl", 1.0),
    ("lppl", "latex", r"this work may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("lppl", "latex", r"latex project public license", 0.95),
    ("nasa", "nasa", r"nasa open source agreement", 1.0),
    ("watcom", "watcom", r"sybase open watcom public license", 1.0),
    ("nokia", "nokia", r"nokia open source license", 1.0),
    ("osl", "open", r"licensed under the open software license version", 1.0),
    ("afl", "academic", r"licensed under the academic free license version", 1.0),
    ("ms-pl", "accept", r"this license governs use of the accompanying software if you use the software you accept this license", 0.95),
    ("gpl-linking", "incorporating", r"this general public license does not permit incorporating your program into proprietary programs", 1.0),
    # fonts, data, documents
    ("ofl", "font", r"this font software is licensed under the sil open font license", 1.0),
    ("ofl", "font", r"the font software may be (?:sold as part of a larger software package|modified or redistributed|bundled)", 0.9),
    ("ofl", "reserved", r"with reserved font names?", 0.9),
    ("odbl", "database", r"is made available under the open database license", 1.0),
    ("odbl", "contents", r"any rights in individual contents of the database are licensed under the database contents license", 1.0),
    ("odc-by", "attribution", r"open data commons attribution license", 1.0),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e", 1.0),
    ("ogl", "government", r"contains public sector information licensed under the open government licence", 1.0),
    ("ogl", "government", r"open government licence", 0.95),
    ("etalab", "ouverte", r"licence ouverte", 0.95),
    ("cc0", "waived", r"to the extent possible under law .{1,120} has waived all copyright and related or neighboring rights", 1.0),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("cc", "corporation", r"creative commons corporation is not a law firm and does not provide legal services", 0.9),
    ("cc-sampling", "sampling", r"creative commons sampling plus", 0.95),
    ("public-domain", "domain", r"(?:dedicated to|released into|placed in(?:to)?|put in(?:to)?|in) the public domain", 0.9),
    ("public-domain", "subject", r"is not subject to copyright protection (?:in|within) the united states", 0.95),
    ("kopimi", "kopimi", r"kopimi", 0.8),
    # models
    ("llama", "llama", r"llama [0-9]+(?: [0-9]+)? community license(?: agreement)?", 1.0),
    ("openrail", "openrail", r"(?:creativeml|bigscience|bigcode) openrail(?: m)?(?: license)", 1.0),
    ("openrail", "rail", r"open rail(?: m)?(?: license)", 0.95),
    # terms that allow little
    ("proprietary", "confidential", r"this software is the confidential and proprietary information of", 1.0),
    ("proprietary", "confidential", r"proprietary and confidential", 0.9),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", 0.95),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work|book|software|site) may be (?:reproduced|copied)", 0.9),
    ("proprietary", "written", r"may not be (?:used|copied|reproduced|distributed|redistributed|republished) without (?:the )?(?:express |prior )?(?:written )?permission", 0.9),
    ("proprietary", "internal", r"(?:licensed )?for internal use only", 0.6),
    ("eula", "end", r"end user licen[sc]e agreement", 0.9),
    ("evaluation", "evaluation", r"(?:evaluation|trial) licen[sc]e agreement", 0.8),
    ("proprietary", "reserved", r"all rights reserved", 0.5),
]

#: Bare identifiers: label, keyword, expression.
IDENTIFIERS = [
    ("gpl", "gpl", r"gpl ?v?[23](?: 0)?(?: only| or later)?"),
    ("gpl", "gplv", r"gplv[23]"),
    ("gpl", "gnu", r"gnu gpl"),
    ("lgpl", "lgpl", r"lgpl ?v?[23](?: [01])?(?: only| or later)?"),
    ("lgpl", "lgplv", r"lgplv[23]"),
    ("agpl", "agpl", r"agpl ?v?[13](?: 0)?(?: only| or later)?"),
    ("agpl", "agplv", r"agplv3"),
    ("apache", "apache", r"apache (?:v ?)?[12] [01]"),
    ("bsd", "bsd", r"bsd [0234] clause"),
    ("bsd", "clause", r"(?:[234]|two|three|four) clause bsd"),
    ("mit", "mit", r"mit licensed"),
    ("mpl", "mpl", r"mpl ?v?[12] [01]"),
    ("epl", "epl", r"epl ?v?[12] 0"),
    ("cddl", "cddl", r"cddl ?v?1 [01]"),
    ("eupl", "eupl", r"eupl ?v?1 [012]"),
    ("lppl", "lppl", r"lppl ?v?1 [0-9]c?"),
    ("ofl", "ofl", r"ofl ?v?1 [01]"),
    ("cc0", "cc0", r"cc0 1 0"),
    ("wtfpl", "wtfpl", r"wtfpl"),
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, expression, label, confidence), in order of priority; a few hundred."""
    made = [(word, pattern, label, confidence) for label, word, pattern, confidence in SIGNATURES]
    for form, confidence in FORMS:
        # longer names first, so that a specific family outranks the one whose name it contains
        for label, word, name, short in sorted(FAMILIES, key=lambda f: -len(f[2])):
            made.append((word if "{n}" in form else short.split(" ")[0].split("(")[0], form.format(n=name, i=short, v=VERSION), label, confidence))
    made += [(word, pattern, label, 0.7) for label, word, pattern in IDENTIFIERS]
    return [(k, *rule) for k, rule in enumerate(made)]


def word_form(text: Column) -> Column:
    """Words joined by single spaces, A-Z lower-cased; empty if there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, GAPS, " "))


def count_words(padded: Column) -> Column:
    """Number of words of a word form that is padded with a space at each end."""
    return F.when(padded == "  ", F.lit(0)).otherwise(_gaps(padded) - 1)


def _gaps(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def places(padded: Column, pattern: Column) -> Column:
    """Array of (start, end) in words, end exclusive, of a pattern's matches in a word form padded with one space each side.

    The pattern is bounded by spaces that it doesn't consume; the spaces before a match count the words before it.
    """
    found, between = F.regexp_extract_all(padded, pattern, F.lit(0)), F.split(padded, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct((_gaps(m) + _gaps(gap)).alias("at"), _gaps(m).alias("m")))
    placed = running(steps, lambda x, y: F.struct((x["at"] + F.coalesce(y["at"], F.lit(0))).alias("at"), x["m"].alias("m")))
    return F.transform(placed, lambda s: F.struct((s["at"] - s["m"] - 1).alias("start"), s["at"].alias("end")))


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def detections(padded: Column) -> Column:
    """Array of (start, end, priority, label, confidence) of every rule whose keyword occurs."""
    table_ = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(f" {word}").alias("word"), F.lit(_bounded(x)).alias("pattern"), F.lit(label).alias("label"), F.lit(c).alias("confidence")) for p, word, x, label, c in rules()])
    gated = F.filter(table_, lambda r: padded.contains(r["word"]))
    matched = F.filter(gated, lambda r: F.regexp_like(padded, r["pattern"]))
    return F.flatten(
        F.transform(
            matched,
            lambda r: F.transform(
                places(padded, r["pattern"]),
                lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")),
            ),
        )
    )


def standing(found: Column) -> Column:
    """Detections that no detection of better priority covers, by start.

    By start and then by the longest, what covers a detection stands before it, and since the last gap between intervals;
    only those are compared with it.
    """
    placed = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence"), d["end"].alias("reach")))
    reached = running(F.array_sort(placed), lambda x, y: x.withField("reach", F.greatest(x["reach"], F.coalesce(y["reach"], F.lit(-1)))))

    def kept(all_: Column) -> Column:
        first = F.transform(all_, lambda d, k: F.when(k == 0, 0).when(d["start"] >= F.get(all_, k - 1)["reach"], k).otherwise(0))
        begin = running(first, lambda x, y: F.greatest(x, F.coalesce(y, F.lit(0))))

        def stands(firsts: Column) -> Column:
            covers = lambda e, d: (e["back"] <= d["back"]) & (e["priority"] < d["priority"])
            free = F.transform(all_, lambda d, k: F.when(~F.exists(F.slice(all_, F.get(firsts, k) + 1, k - F.get(firsts, k)), lambda e: covers(e, d)), d))
            return F.filter(free, lambda d: d.isNotNull())

        return let(begin, stands)

    out = F.transform(let(reached, kept), lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    return out


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, base (array of (start, end, label)) and found (array of standing detections).

    Null texts count as empty: no words, no detections.  Repeated rows are scanned each for itself.  Columns of ``docs`` with
    these three names are replaced; others stay as they are.  Of detections alike in place the first rule's stands.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "base", "found")]
    form, gated = fresh("_padded", docs), fresh("_gate", docs)
    # the padded form and the gate are columns of their own: a rule's functions refer to them and don't make them again
    rows = docs.select(*keep, F.concat(F.lit(" "), word_form(F.col(text_col)), F.lit(" ")).alias(form))
    padded = F.col(form)
    gate = padded.contains(GATES[0])
    for word in GATES[1:]:
        gate = gate | padded.contains(word)
    rows = rows.withColumn(gated, gate)
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    per_phrase = [F.when(padded.contains(f" {phrase} "), F.transform(places(padded, F.lit(_bounded(phrase))), _labelled(label))).otherwise(none) for phrase, label in BASE.items()]
    found = F.when(F.col(gated), standing(detections(padded))).otherwise(F.array().cast("array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"))
    return rows.select(*keep, count_words(padded).cast("long").alias("n_words"), F.when(F.col(gated), F.concat(*per_phrase)).otherwise(none).alias("base"), found.alias("found"))


def _labelled(label: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and rule detections of every document."""
    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("base.start")
    labels = F.concat(F.col("base.label"), F.col("found.label"))
    score = F.coalesce(F.array_max("found.confidence"), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.greatest(score, F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
    )
