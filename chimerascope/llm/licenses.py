"""Licence detection by ordered signature rules.

Each rule is a regular expression with a label, a priority and a keyword. A keyword
prefilter decides which rules see a text at all. Overlapping detections are resolved by
priority: a detection is suppressed when its interval lies inside a kept one of higher
priority, or of equal priority and greater length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerascope.llm.shared import utf8_views

# Base phrases and the labels that they give.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

# Runs of whitespace other than a single space, with the comment signs that begin a line. They are made one character, or two where lines are left blank, so that a line break stays known.
_WIDE = re.compile(rb"[\x09-\x0d\x20]*[\x09-\x0d][\x09-\x0d\x20]*(?:(?:#+|\*+|/{2,}|;+|--+|>+)[\x09-\x0d\x20]+)*|\x20{2,}")

# Families, by hand: label, how its name is written, short names that count only where something is said to be licensed so, keywords of which one is in every match, versions, an example of the name.
_CC = "cc by|cc-by|cc attr|cc-attr|creative"
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_FAMILIES = (
    ("apache", r"apache(?: software)? licen[sc]e|asl(?=,? ?\(?(?:version |v\.? ?)?[12]\.[01])", r"apache|asl", "apache|asl", ("1.0", "1.1", "2.0"), "Apache License"),
    ("mit", r"(?:mit|expat)(?:/x11)? licen[sc]e", r"mit|expat|mit/x11", "mit|expat", (), "MIT License"),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?|mit-0", r"mit-0", "mit no|mit-0", (), "MIT No Attribution"),
    ("x11", r"x11 licen[sc]e|x consortium licen[sc]e", r"x11", "x11|x consortium", (), "X11 License"),
    ("bsd", r"(?:original |new |simplified |modified |revised )?bsd(?:[ -]style)? licen[sc]e", r"bsd", "bsd", (), "BSD License"),
    ("bsd-2-clause", r"(?:bsd[ -])?(?:2|two)[ -]clause(?: bsd)? licen[sc]e|simplified bsd|freebsd licen[sc]e", r"bsd[ -]2[ -]clause|bsd-2", "clause|simplified|freebsd|bsd-2", (), "BSD 2-Clause License"),
    ("bsd-3-clause", r"(?:bsd[ -])?(?:3|three)[ -]clause(?: bsd)? licen[sc]e|(?:new|revised|modified) bsd", r"bsd[ -]3[ -]clause|bsd-3", "clause|new bsd|revised bsd|modified bsd|bsd-3", (), "BSD 3-Clause License"),
    ("bsd-4-clause", r"(?:bsd[ -])?(?:4|four)[ -]clause(?: bsd)? licen[sc]e|original bsd", r"bsd[ -]4[ -]clause", "clause|original bsd", (), "BSD 4-Clause License"),
    ("0bsd", r"(?:0bsd|zero[ -]clause bsd|bsd zero[ -]clause)(?: licen[sc]e)?", r"0bsd", "bsd", (), "Zero-Clause BSD"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|agpl", r"agpl", "agpl|affero", ("1.0", "3.0"), "GNU Affero General Public License"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl", r"lgpl", "lgpl|lesser|library gen", ("2.0", "2.1", "3.0"), "GNU Lesser General Public License"),
    ("gpl", r"(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public licen[sc]e|gpl|gnu licen[sc]e", r"gpl|gnu gpl", "gpl|general public|gnu lic", ("1.0", "2.0", "3.0"), "GNU General Public License"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl", r"gfdl|fdl", "fdl|free doc", ("1.1", "1.2", "1.3"), "GNU Free Documentation License"),
    ("mpl", r"mozilla public licen[sc]e|mpl", r"mpl", "mozilla|mpl", ("1.0", "1.1", "2.0"), "Mozilla Public License"),
    ("npl", r"netscape public licen[sc]e", r"npl", "netscape|npl", ("1.0", "1.1"), "Netscape Public License"),
    ("epl", r"eclipse public licen[sc]e|epl", r"epl", "eclipse|epl", ("1.0", "2.0"), "Eclipse Public License"),
    ("edl", r"eclipse distribution licen[sc]e", r"edl", "eclipse|edl", ("1.0",), "Eclipse Distribution License"),
    ("cddl", r"common development and distribution licen[sc]e|cddl", r"cddl", "cddl|common dev", ("1.0", "1.1"), "Common Development and Distribution License"),
    ("cpl", r"common public licen[sc]e", r"cpl", "common public|cpl", ("1.0",), "Common Public License"),
    ("cpal", r"common public attribution licen[sc]e|cpal", r"cpal", "common public|cpal", ("1.0",), "Common Public Attribution License"),
    ("ipl", r"ibm public licen[sc]e", r"ipl", "ibm public|ipl", ("1.0",), "IBM Public License"),
    ("eupl", r"european union public licen[sc]e|eupl", r"eupl", "eupl|european", ("1.0", "1.1", "1.2"), "European Union Public Licence"),
    ("cecill", r"cecill(?:-[bc])?(?: free software)?(?: licen[sc]e(?: agreement)?)?", r"cecill", "cecill", ("1.0", "1.1", "2.0", "2.1"), "CeCILL License"),
    ("artistic", r"artistic licen[sc]e", r"artistic", "artistic", ("1.0", "2.0"), "Artistic License"),
    ("boost", r"boost software licen[sc]e|bsl-1\.0", r"boost", "boost|bsl-1", ("1.0",), "Boost Software License"),
    ("isc", r"isc licen[sc]e|internet systems consortium licen[sc]e", r"isc", "isc|internet sys", (), "ISC License"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", "zlib", (), "zlib License"),
    ("libpng", r"libpng licen[sc]e|png reference library licen[sc]e", r"libpng", "libpng|png ref", ("2.0",), "libpng License"),
    ("ijg", r"independent jpeg group licen[sc]e|ijg licen[sc]e", r"ijg", "jpeg|ijg", (), "Independent JPEG Group License"),
    ("unlicense", r"(?:the )?unlicen[sc]e", r"unlicen[sc]e", "unlicen", (), "the Unlicense"),
    ("wtfpl", r"do what the f[a-z*]+ you want(?: to)? public licen[sc]e|wtfpl", r"wtfpl", "wtfpl|do what", ("1.0", "2.0"), "WTFPL"),
    ("beerware", r"beer[ -]?ware(?: licen[sc]e)?", r"beer[ -]?ware", "beer", (), "Beerware License"),
    ("python", r"python(?: software foundation)? licen[sc]e|psf licen[sc]e", r"psfl?|python", "python|psf", ("2.0",), "Python Software Foundation License"),
    ("cnri", r"cnri(?: open source)?(?: python)? licen[sc]e(?: agreement)?", r"cnri", "cnri", (), "CNRI License"),
    ("php", r"php licen[sc]e", r"php", "php", ("3.0", "3.01"), "PHP License"),
    ("ruby", r"ruby(?:'s)? licen[sc]e", r"ruby", "ruby", (), "Ruby License"),
    ("perl", r"same terms as perl(?: itself)?|perl(?: 5)? licen[sc]e", r"perl", "perl", (), "same terms as Perl itself"),
    ("tcl", r"tcl(?:/tk)? licen[sc]e", r"tcl", "tcl", (), "Tcl/Tk License"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", "postgresql", (), "PostgreSQL License"),
    ("openssl", r"openssl licen[sc]e|ssleay licen[sc]e", r"openssl", "openssl|ssleay", (), "OpenSSL License"),
    ("openldap", r"openldap public licen[sc]e", r"oldap", "openldap|oldap", ("2.7", "2.8"), "OpenLDAP Public License"),
    ("curl", r"curl licen[sc]e", r"curl", "curl", (), "curl License"),
    ("icu", r"icu licen[sc]e", r"icu", "icu", (), "ICU License"),
    ("unicode", r"unicode(?:, inc\.)? licen[sc]e(?: agreement)?|unicode terms of use", r"unicode", "unicode", ("3.0",), "Unicode License Agreement"),
    ("ofl", r"(?:sil )?open font licen[sc]e|ofl", r"ofl|sil ofl", "open font|ofl", ("1.0", "1.1"), "SIL Open Font License"),
    ("ubuntu-font", r"ubuntu font licen[cs]e", r"ufl", "ubuntu font|ufl", ("1.0",), "Ubuntu Font Licence"),
    ("bitstream-vera", r"bitstream vera(?: fonts?)? (?:licen[sc]e|copyright)", r"bitstream vera", "bitstream", (), "Bitstream Vera License"),
    ("lppl", r"latex project public licen[sc]e|lppl", r"lppl", "latex project|lppl", ("1.0", "1.1", "1.2", "1.3"), "LaTeX Project Public License"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e|odbl", r"odbl", "odbl|database licen", ("1.0",), "Open Database License"),
    ("odc-by", r"open data commons attribution licen[sc]e|odc-by", r"odc-by", "odc-by|open data", ("1.0",), "Open Data Commons Attribution License"),
    ("pddl", r"public domain dedication and licen[sc]e|pddl", r"pddl", "pddl|domain ded", ("1.0",), "Public Domain Dedication and License"),
    ("ogl", r"open government licen[cs]e|ogl", r"ogl", "open gov|ogl", ("1.0", "2.0", "3.0"), "Open Government Licence"),
    ("osl", r"open software licen[sc]e|osl", r"osl", "osl|open soft", ("1.0", "2.0", "2.1", "3.0"), "Open Software License"),
    ("afl", r"academic free licen[sc]e", r"afl", "academic|afl", ("1.1", "1.2", "2.0", "2.1", "3.0"), "Academic Free License"),
    ("ecl", r"educational community licen[sc]e", r"ecl", "educational|ecl", ("1.0", "2.0"), "Educational Community License"),
    ("ms-pl", r"microsoft public licen[sc]e|ms-pl", r"ms-pl", "microsoft|ms-pl", (), "Microsoft Public License"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|ms-rl", r"ms-rl", "microsoft|ms-rl", (), "Microsoft Reciprocal License"),
    ("apsl", r"apple public source licen[sc]e", r"apsl", "apple|apsl", ("1.0", "1.1", "1.2", "2.0"), "Apple Public Source License"),
    ("rpsl", r"realnetworks public source licen[sc]e", r"rpsl", "realnetworks|rpsl", ("1.0",), "RealNetworks Public Source License"),
    ("sissl", r"sun industry standards source licen[sc]e", r"sissl", "sun industry|sissl", ("1.1", "1.2"), "Sun Industry Standards Source License"),
    ("spl", r"sun public licen[sc]e", r"spl", "sun public|spl", ("1.0",), "Sun Public License"),
    ("nasa", r"nasa open source agreement", r"nosa", "nasa|nosa", ("1.3",), "NASA Open Source Agreement"),
    ("intel", r"intel open source licen[sc]e", r"intel open source", "intel", (), "Intel Open Source License"),
    ("nokia", r"nokia open source licen[sc]e", r"nokia", "nokia", (), "Nokia Open Source License"),
    ("motosoto", r"motosoto open source licen[sc]e", r"motosoto", "motosoto", (), "Motosoto Open Source License"),
    ("sybase", r"sybase open watcom public licen[sc]e|open watcom", r"watcom", "watcom", ("1.0",), "Sybase Open Watcom Public License"),
    ("rpl", r"reciprocal public licen[sc]e", r"rpl", "reciprocal public|rpl", ("1.1", "1.5"), "Reciprocal Public License"),
    ("qpl", r"q public licen[sc]e|qpl", r"qpl", "q public|qpl", ("1.0",), "Q Public License"),
    ("sleepycat", r"sleepycat licen[sc]e", r"sleepycat", "sleepycat", (), "Sleepycat License"),
    ("zpl", r"zope public licen[sc]e", r"zpl", "zope|zpl", ("1.1", "2.0", "2.1"), "Zope Public License"),
    ("sspl", r"server side public licen[sc]e|sspl", r"sspl", "sspl|server side", ("1.0",), "Server Side Public License"),
    ("busl", r"business source licen[sc]e|busl", r"busl", "busl|business source", ("1.1",), "Business Source License"),
    ("elastic", r"elastic licen[sc]e", r"elastic", "elastic", ("1.0", "2.0"), "Elastic License"),
    ("commons-clause", r"commons clause(?: licen[sc]e condition)?", r"commons clause", "commons clause", ("1.0",), "Commons Clause"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[sc]e", r"polyform", "polyform", ("1.0.0",), "PolyForm Noncommercial License"),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?:[ -]m|\+\+-m)?(?: licen[sc]e)?", r"openrail", "rail", (), "CreativeML Open RAIL-M"),
    ("upl", r"universal permissive licen[sc]e|upl", r"upl", "upl|universal perm", ("1.0",), "Universal Permissive License"),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e", r"ncsa", "ncsa", (), "NCSA Open Source License"),
    ("hpnd", r"historical permission notice and disclaimer", r"hpnd", "historical perm|hpnd", (), "Historical Permission Notice and Disclaimer"),
    ("vim", r"vim licen[sc]e", r"vim", "vim", (), "Vim License"),
    ("w3c", r"w3c(?: software)?(?: notice and)?(?: document)? licen[sc]e", r"w3c", "w3c", (), "W3C Software Notice and License"),
    ("json", r"json licen[sc]e", r"json", "json", (), "JSON License"),
    ("bzip2", r"bzip2 licen[sc]e", r"bzip2", "bzip2", (), "bzip2 License"),
    ("ftl", r"freetype(?: project)? licen[sc]e", r"ftl|freetype", "freetype|ftl", (), "FreeType License"),
    ("libtiff", r"libtiff licen[sc]e", r"libtiff", "libtiff", (), "libtiff License"),
    ("imagemagick", r"imagemagick licen[sc]e", r"imagemagick", "imagemagick", (), "ImageMagick License"),
    ("info-zip", r"info-zip licen[sc]e", r"info-zip", "info-zip", (), "Info-ZIP License"),
    ("mulan", r"mulan (?:permissive software|public) licen[sc]e|mulanp(?:sl|ubl)", r"mulanpsl|mulan", "mulan", ("1.0", "2.0"), "Mulan Permissive Software License"),
    ("blueoak", r"blue oak model licen[sc]e", r"blueoak", "blue oak|blueoak", ("1.0.0",), "Blue Oak Model License"),
    ("fair", r"fair licen[sc]e", r"fair", "fair lic|fair", (), "Fair License"),
    ("multics", r"multics licen[sc]e", r"multics", "multics", (), "Multics License"),
    ("cua-opl", r"cua office public licen[sc]e", r"cua-opl", "cua", ("1.0",), "CUA Office Public License"),
    ("opl", r"open publication licen[sc]e", r"opl", "open pub|opl", ("1.0",), "Open Publication License"),
    ("ogc", r"ogc software (?:notice|licen[sc]e)", r"ogc", "ogc", ("1.0",), "OGC Software License"),
    ("fal", r"(?:free art|art libre) licen[sc]e|licence art libre", r"lal|free art", "art li|free art|lal", ("1.2", "1.3"), "Free Art License"),
    ("cc-by-nc-nd", r"(?:creative commons |cc[ -])(?:by[ -]nc[ -]nd|attribution[ -]non-?commercial[ -]no-?deriv[a-z]+)", "", _CC, _CC_VERSIONS, "CC BY-NC-ND"),
    ("cc-by-nc-sa", r"(?:creative commons |cc[ -])(?:by[ -]nc[ -]sa|attribution[ -]non-?commercial[ -]share-?alike)", "", _CC, _CC_VERSIONS, "CC BY-NC-SA"),
    ("cc-by-nc", r"(?:creative commons |cc[ -])(?:by[ -]nc|attribution[ -]non-?commercial)(?![ -](?:sa|nd|share|no))", "", _CC, _CC_VERSIONS, "CC BY-NC"),
    ("cc-by-nd", r"(?:creative commons |cc[ -])(?:by[ -]nd|attribution[ -]no-?deriv[a-z]+)", "", _CC, _CC_VERSIONS, "CC BY-ND"),
    ("cc-by-sa", r"(?:creative commons |cc[ -])(?:by[ -]sa|attribution[ -]share-?alike)", "", _CC, _CC_VERSIONS, "CC BY-SA"),
    ("cc-by", r"(?:creative commons |cc[ -])(?:by|attribution)(?![ -](?:n[cd]|sa|non|no|share))", "", _CC, _CC_VERSIONS, "CC BY"),
    ("cc0", r"(?:creative commons zero|cc0)(?: public domain dedication)?", r"cc0", "cc0|commons zero", ("1.0",), "Creative Commons Zero"),
    ("public-domain", r"(?:dedicated to|placed in|released (?:in|into)|in) the public domain|public domain dedication(?! and lic)|public domain mark", "", "public domain", (), "placed in the public domain"),
    ("proprietary", r"proprietary and confidential|unauthori[sz]ed (?:copying|use|reproduction)|not be disclosed to third parties|trade secrets? of", "", "proprietary|unauthori|be disclosed|trade secret", (), "proprietary and confidential"),
    ("reserved", r"all rights reserved", "", "rights reserved", (), "all rights reserved"),
)

# Sentences of the licences and their notices, by hand: label, pattern, a keyword.
_SENTENCES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of (?:this software|the software|this font)", "permission is hereby"),
    ("mit", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions", "permission notice shall"),
    ("mit", r"the software is provided \"as is\", without warranty of any kind, express or implied.{0,200}?in no event shall the (?:authors or copyright holders|x consortium) be liable", "without warranty"),
    ("mit-0", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.{0,600}?furnished to do so\. the software is provided \"as is\", without warranty of any kind(?:.{0,250}?authors or copyright holders be liable)?", "permission is hereby"),
    ("x11", r"the name of the x consortium shall not be used in advertising", "x consortium"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification, are permitted", "source and binary forms"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in"),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their|any|the) .{0,60}?contributors may be used to endorse or promote products", "endorse or promote"),
    ("bsd-3-clause", r"the names? of .{1,120}? may not be used to endorse or promote products derived from", "endorse or promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided", "with or without fee"),
    ("0bsd", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.", "with or without fee"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", "software and its documentation"),
    ("zlib", r"altered source versions must be plainly marked as such, and must not be misrepresented", "plainly marked"),
    ("zlib", r"the origin of this software must not be misrepresented; you must not claim that you wrote", "must not be misrepresented"),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "person or organization"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", r"you just do what the f[a-z*]+ you want to", "you just do what"),
    ("beerware", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer", "buy me a beer"),
    ("apache-2.0", r"apache licen[sc]e,? version 2\.0, january 2004", "january 2004"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e\. you may obtain a copy of the licen[sc]e at,? https?://www\.apache\.org/licenses/license-2\.0", "license-2.0"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e is distributed on an \"as is\" basis", "agreed to in writing"),
    ("apache-1.1", r"this product includes software developed by the apache (?:group|software foundation)", "product includes software"),
    ("gpl", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e", "redistribute it"),
    ("gpl-2.0", r"gnu general public licen[sc]e as published by the free software foundation[;,] either version 2", "free software foundation"),
    ("gpl-3.0", r"gnu general public licen[sc]e as published by the free software foundation[;,] either version 3", "free software foundation"),
    ("gpl-2.0", r"gnu general public licen[sc]e version 2, june 1991", "june 1991"),
    ("gpl-3.0", r"gnu general public licen[sc]e version 3, 29 june 2007", "29 june 2007"),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e along with this", "should have received"),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e as published", "general public"),
    ("lgpl-2.0", r"(?:under the terms of the )?gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 2(?!\.[0-9])", "free software foundation"),
    ("lgpl-2.1", r"(?:under the terms of the )?gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 2\.1", "free software foundation"),
    ("lgpl-3.0", r"(?:under the terms of the )?gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 3", "free software foundation"),
    ("agpl-3.0", r"gnu affero general public licen[sc]e as published by the free software foundation[;,] (?:either )?version 3", "free software foundation"),
    ("lgpl-2.1", r"gnu lesser general public licen[sc]e version 2\.1, february 1999", "february 1999"),
    ("lgpl-3.0", r"this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", "incorporates the terms"),
    ("agpl-3.0", r"gnu affero general public licen[sc]e version 3, 19 november 2007", "19 november 2007"),
    ("agpl", r"interacting with it remotely through a computer network", "remotely through a computer network"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation", "modify this document"),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts", "invariant sections"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. 2\.0", "source code form"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.1", "contents of this file"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "accompanying materials"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public licen[sc]e", "accompanying program"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution", "contents of this file"),
    ("eupl", r"licensed under the eupl", "eupl"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document, but changing it is not allowed\. preamble this licen[sc]e establishes", "license establishes"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "package may be copied"),
    ("python", r"this licen[sc]e agreement is between the python software foundation", "python software"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect", "university of california be"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project"),
    ("openssl", r"this product includes cryptographic software written by eric young", "eric young"),
    ("ofl", r"this font software is licensed under the sil open font", "font software"),
    ("ofl", r"reserved font name", "reserved font"),
    ("lppl", r"this work may be distributed and/or modified under the conditions of the latex project", "latex project"),
    ("ms-pl", r"this licen[sc]e governs use of the accompanying software\. if you use the software, you accept", "governs use of"),
    ("upl", r"subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software", "condition set forth"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers", "following disclaimers"),
    ("json", r"the software shall be used for good, not evil", "not evil"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "available to third parties"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "non-production use"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed"),
    ("commons-clause", r"the grant of rights under the licen[sc]e will not include, and the licen[sc]e does not grant to you, the right to sell", "right to sell"),
    ("cc-by", r"this work is licensed under (?:a|the) creative commons attribution(?: [0-9.]+)?(?: international| unported| generic)? licen[sc]e", "this work is licensed"),
    ("cc0", r"to the extent possible under law, .{1,120}? (?:has|have) waived all copyright and related", "waived all copyright"),
    ("ogl", r"contains public sector information licen[cs]ed under the open government", "public sector"),
    ("odbl", r"made available under the open database licen[sc]e", "open database"),
    ("proprietary", r"no part of this (?:document|publication|software|work|file) may be (?:reproduced|copied|distributed)", "no part of this"),
    ("proprietary", r"use of this (?:software|source code) is governed by (?:a|an|the) (?:commercial|proprietary) licen[sc]e", "is governed by"),
    ("proprietary", r"strictly (?:confidential|prohibited)[,.]? .{0,60}?(?:proprietary|without (?:the )?(?:prior |express )?written (?:permission|consent))", "strictly"),
)

# What may stand before a name where something is said to be licensed so; forms that begin with it are tried at its ends only.
_GRANT = r"(?:(?:licen[sc]ed?|released|distributed|available|published|provided|use|shared|contributed|covered)(?: only)? under|licen[sc]ed(?: only)? (?:by|with)) (?:an? |the )?(?:terms (?:and conditions )?of (?:the )?)?"
# How a licence is named: form, pattern ({name}, {short}: as in the table; a space is a space or a line break), priority, and how sure it is.
_LEFT, _RIGHT = r"(?<![0-9a-z])", r"(?![0-9a-z])"
_VERSION = r"(?:,?(?: ?\(?(?:version|ver\.?|v\.?) ?|[\x20-]\(?)){version}(?![0-9a-z]|\.[0-9])"
_FORMS = (
    ("tag", _LEFT + r"{id}(?![0-9a-z.-])", 40, 1.0),
    ("granted version", r"(?:{short})(?: licen[sc]e)?" + _VERSION, 31, 0.95),
    ("field version", _LEFT + r"licen[sc]es?[\"']? ?[:=] ?[\"']?(?:{short})(?: licen[sc]e)?" + _VERSION, 32, 0.95),
    ("versioned", _LEFT + r"(?:{name})" + _VERSION, 30, 0.95),
    ("field", _LEFT + r"licen[sc]es?[\"']? ?[:=] ?[\"']?(?:{short})" + _RIGHT, 21, 0.9),
    ("granted name", r"(?:{name})" + _RIGHT, 20, 0.9),
    ("granted", r"(?:{short})(?: licen[sc]e)?" + _RIGHT, 19, 0.85),
    ("adjective", _LEFT + r"(?:{short})[ -]licen[sc]ed" + _RIGHT, 18, 0.85),
    ("mention", _LEFT + r"(?:{name})" + _RIGHT, 10, 0.6),
)
# Families whose short names are ordinary words, languages or firms: with a grant they count only where it holds the word licence.
_ORDINARY = frozenset((
    "boost", "artistic", "python", "php", "ruby", "perl", "tcl", "postgresql", "curl", "unicode", "nokia", "intel", "elastic", "vim", "json", "fair", "multics",
    "mulan", "polyform", "imagemagick", "sleepycat", "motosoto",
))
_EXPRESSION = re.compile(rb"spdx-license-identifier:([^\n]*)")


@dataclass(frozen=True)
class Rule:
    label: str
    form: str
    priority: int
    sureness: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    licence_word: bool = False  # whether every match holds the word licence
    ordinary: bool = False  # whether a match counts only if it does


def _narrow(text: bytes) -> bytes:
    return _WIDE.sub(lambda m: (b" ", b"\n", b"\n\n")[min(m[0].count(b"\n") or m[0].count(b"\r"), 2)], text)


def _breakable(pattern: str, gap: str = r"[ \n]") -> str:
    """A pattern whose spaces, those within sets too, also match a line break, or a gap of another form."""
    parts = re.split(r"(\[(?:\\.|[^\]])*\])", pattern)
    sets = [r"[\n" + part[1:] if " " in part and part[1] != "^" else part for part in parts[1::2]]
    plain = [part.replace(" ", gap) for part in parts[::2]]
    return "".join(a + b for a, b in zip(plain, [*sets, ""], strict=True))


def signature_rules() -> list[Rule]:
    """Every form of every family and of its versions, and the sentences; highest priority first, then in the order above.

    Tags are looked for in licence expressions only, forms with short names where a
    family has some, and versioned forms once for each version.
    """
    rules = [Rule(label, "sentence", 35, 0.98, (gate.encode(),), re.compile(_breakable(pattern, r"[ \n]{1,2}").encode(), re.S)) for label, pattern, gate in _SENTENCES]
    for label, name, short, gate, versions, _ in _FAMILIES:
        keywords = tuple(k.encode() for k in gate.split("|"))
        for form, shape, priority, sureness in _FORMS:
            if "{short}" in shape and not short:
                continue
            numbered = ("", *versions) if form == "tag" else versions if "{version}" in shape else ("",)
            for version in numbered:
                full = f"{label}-{version}" if version else label
                bare = version.removesuffix(".0")
                wide = re.escape(version) if bare == version else f"{re.escape(bare)}(?:\\.0)?"
                fields = {"{name}": name, "{short}": short, "{version}": wide, "{id}": re.escape(full) + r"(?:-only|-or-later|\+)?"}
                source = shape
                for field, text in fields.items():
                    source = source.replace(field, text)
                worded = form in ("field", "field version", "adjective") or "{name}" in shape and all("licen" in x for x in re.sub(r"\([^()]*\)", "", name).split("|"))
                rules.append(Rule(full, form, priority, sureness, (b"spdx-license-identifier",) if form == "tag" else keywords, re.compile(_breakable(source).encode()), worded, label in _ORDINARY))
    return sorted(rules, key=lambda r: -r.priority)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that no other of higher priority, or of the same and longer, contains; of equal intervals the label first by name stays."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of all detections of higher priority, ascending, and the furthest end up to each
    reach: list[int] = []
    for priority in sorted({d[2].priority for d in found}, reverse=True):
        level = sorted((d for d in found if d[2].priority == priority), key=lambda d: (d[0], -d[1], d[2].label))
        furthest = -1
        for start, end, rule in level:
            above = bisect_right(starts, start)
            if end > furthest and (not above or reach[above - 1] < end):
                kept.append((start, end, rule))
            furthest = max(furthest, end)
        merged = sorted([*zip(starts, reach, strict=True), *((d[0], d[1]) for d in level)])
        starts, reach = [a for a, _ in merged], list(accumulate((b for _, b in merged), max))
    return kept


class Scanner:
    """Finds base phrases and licences in texts, as bytes."""

    def __init__(self) -> None:
        self.rules = signature_rules()
        self.keywords = sorted({k for r in self.rules for k in r.keywords})
        self.grant = re.compile(_breakable(_GRANT).encode())
        self.base = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + _GAP.join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])"), p.split()[0].encode(), label) for p, label in BASE_PHRASES]
        self.anchors = (b"cc", b"public", b"rights")

    def detections(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """Resolved detections in a lower-cased text, placed in its narrowed form. Equal spans of one label count once."""
        text = _narrow(text)
        flat = text.replace(b"\n", b" ")
        there = {k for k in self.keywords if k in flat}
        if not there:
            return []
        found = {}
        expressions = [m.span(1) for m in _EXPRESSION.finditer(text)] if b"spdx-license-identifier" in there else []
        grants = [m.span() for m in self.grant.finditer(text)]
        worded = b"licen" in flat
        for rule in self.rules:
            if there.isdisjoint(rule.keywords) or rule.licence_word and not worded:
                continue
            if rule.form == "tag":
                spans = [m.span() for low, high in expressions for m in rule.pattern.finditer(text, low, high)]
            elif rule.form.startswith("granted"):
                spans = [(low, m.end()) for low, high in grants if (m := rule.pattern.match(text, high)) and (not rule.ordinary or b"licen" in text[low : m.end()])]
            else:
                spans = [m.span() for m in rule.pattern.finditer(text)]
            for start, end in spans:
                found.setdefault((start, end, rule.label), rule)
        return suppress([(a, b, rule) for (a, b, _), rule in found.items()])

    def scan(self, raw: np.ndarray | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of one whole text."""
        if raw is None or not len(raw):
            return 0, 0, None, None, "", "", 0.0
        text = raw.tobytes().lower()
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[1:] = _IN_WORD[np.frombuffer(text, np.uint8)]
        begins = inside[1:] & ~inside[:-1]
        places, base = [], set()
        for (pattern, _, label), anchor in zip(self.base, self.anchors, strict=True):
            if anchor in text:
                at = [m.start() for m in pattern.finditer(text)]
                places += at
                base |= {label} if at else set()
        kept = self.detections(text)
        labels = base | {rule.label for _, _, rule in kept}
        sure = max([0.5 if base else 0.0, *(rule.sureness for _, _, rule in kept)])
        first = last = None
        if places:
            first, last = (int(np.count_nonzero(begins[:p])) for p in (min(places), max(places)))
        return int(np.count_nonzero(begins)), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), sure


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Whole texts are scanned. Null and empty texts have no words and no labels; score is 0
    without a label, 0.5 with a base phrase alone, and else that of the surest detection.
    Repeated rows give repeated result rows, an empty table none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(raw) for raw in utf8_views(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
