"""Signature rules for licences, written against normalised text: lower-case words, one space between them.

A rule is (label, priority, keyword, pattern).  The keyword must occur in the text before the pattern is tried, at
any place: it is a part of everything that the pattern matches.
Priorities: 4 identifiers and full texts, 3 a grant that names licence and version, 2 licence and version,
1 the licence's name.  Families are written by hand as a name, its versions and the labels they give.
"""

from __future__ import annotations

_L = "licen[cs]e"
_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"

#: family: (keyword, name pattern, label of the bare name, {version pattern: label})
FAMILIES = {
    "mit": ("mit", "mit", "mit", {}),
    "mit-0": ("mit", "mit 0|mit no attribution", "mit-0", {}),
    "x11": ("x11", "x11", "x11", {}),
    "isc": ("isc", "isc", "isc", {}),
    "apache": ("apache", "apache(?: software)?(?: foundation)?", "apache", {"2(?: 0)?": "apache-2.0", "1 1": "apache-1.1", "1 0": "apache-1.0"}),
    "gpl": ("gnu", "gnu (?:general public|gpl)", "gpl", {"1(?: 0)?": "gpl-1.0", "2(?: 0)?": "gpl-2.0", "3(?: 0)?": "gpl-3.0"}),
    "gpl-name": ("general public", "general public", "gpl", {"1(?: 0)?": "gpl-1.0", "2(?: 0)?": "gpl-2.0", "3(?: 0)?": "gpl-3.0"}),
    "lgpl": ("lesser", "(?:gnu )?lesser (?:general public|gpl)", "lgpl", {"2 1": "lgpl-2.1", "3(?: 0)?": "lgpl-3.0"}),
    "lgpl-2": ("library", "(?:gnu )?library (?:general public|gpl)", "lgpl", {"2(?: 0)?": "lgpl-2.0"}),
    "agpl": ("affero", "(?:gnu )?affero (?:general public|gpl)", "agpl", {"1(?: 0)?": "agpl-1.0", "3(?: 0)?": "agpl-3.0"}),
    "fdl": ("free documentation", "(?:gnu )?free documentation", "gfdl", {"1 1": "gfdl-1.1", "1 2": "gfdl-1.2", "1 3": "gfdl-1.3"}),
    "bsd": ("bsd", "bsd(?: style)?", "bsd", {}),
    "bsd-2": ("bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)", "bsd-2-clause", {}),
    "bsd-3": ("bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)", "bsd-3-clause", {}),
    "bsd-4": ("bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)", "bsd-4-clause", {}),
    "0bsd": ("bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", {}),
    "mpl": ("mozilla", "mozilla public", "mpl", {"1 0": "mpl-1.0", "1 1": "mpl-1.1", "2(?: 0)?": "mpl-2.0"}),
    "epl": ("eclipse", "eclipse public", "epl", {"1(?: 0)?": "epl-1.0", "2(?: 0)?": "epl-2.0"}),
    "edl": ("eclipse", "eclipse distribution", "edl", {"1(?: 0)?": "edl-1.0"}),
    "cpl": ("common public", "common public", "cpl", {"1(?: 0)?": "cpl-1.0"}),
    "ipl": ("ibm", "ibm public", "ipl", {"1(?: 0)?": "ipl-1.0"}),
    "cddl": ("common development", "common development and distribution", "cddl", {"1 0": "cddl-1.0", "1 1": "cddl-1.1"}),
    "eupl": ("european union", "european union public", "eupl", {"1 0": "eupl-1.0", "1 1": "eupl-1.1", "1 2": "eupl-1.2"}),
    "artistic": ("artistic", "(?:perl )?artistic", "artistic", {"1(?: 0)?": "artistic-1.0", "2(?: 0)?": "artistic-2.0"}),
    "boost": ("boost", "boost(?: software)?", "bsl", {"1(?: 0)?": "bsl-1.0"}),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib", {}),
    "libpng": ("libpng", "libpng", "libpng", {"2(?: 0)?": "libpng-2.0"}),
    "openssl": ("openssl", "openssl", "openssl", {}),
    "python": ("python", "python(?: software foundation)?", "psf", {"2(?: 0)?": "psf-2.0"}),
    "php": ("php", "php", "php", {"3 0": "php-3.0", "3 01": "php-3.01"}),
    "ruby": ("ruby", "ruby", "ruby", {}),
    "w3c": ("w3c", "w3c(?: software)?", "w3c", {}),
    "afl": ("academic free", "academic free", "afl", {"2 0": "afl-2.0", "2 1": "afl-2.1", "3 0": "afl-3.0"}),
    "osl": ("open software", "open software", "osl", {"1 0": "osl-1.0", "2 1": "osl-2.1", "3 0": "osl-3.0"}),
    "ms-pl": ("microsoft", "microsoft public", "ms-pl", {}),
    "ms-rl": ("microsoft", "microsoft reciprocal", "ms-rl", {}),
    "unlicense": ("unlicense", "unlicense", "unlicense", {}),
    "cecill": ("cecill", "cecill", "cecill", {"1 0": "cecill-1.0", "2 0": "cecill-2.0", "2 1": "cecill-2.1"}),
    "ofl": ("open font", "(?:sil )?open font", "ofl", {"1 0": "ofl-1.0", "1 1": "ofl-1.1"}),
    "odbl": ("open database", "open database", "odbl", {"1(?: 0)?": "odbl-1.0"}),
    "odc-by": ("open data commons", "open data commons attribution", "odc-by", {"1(?: 0)?": "odc-by-1.0"}),
    "ecl": ("educational community", "educational community", "ecl", {"1 0": "ecl-1.0", "2 0": "ecl-2.0"}),
    "upl": ("universal permissive", "universal permissive", "upl", {"1(?: 0)?": "upl-1.0"}),
    "postgresql": ("postgresql", "postgresql", "postgresql", {}),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", {}),
    "sspl": ("server side", "server side public", "sspl", {"1(?: 0)?": "sspl-1.0"}),
    "busl": ("business source", "business source", "busl", {"1 1": "busl-1.1"}),
    "elastic": ("elastic", "elastic", "elastic", {"2(?: 0)?": "elastic-2.0"}),
    "rail": ("rail", "(?:open|creativeml open|bigscience|responsible ai) rail(?: [ms])?", "openrail", {}),
    "wtfpl": ("what the fuck", "do what the fuck you want to public", "wtfpl", {}),
    "vim": ("vim", "vim", "vim", {}),
    "mulan": ("mulan", "mulan (?:permissive software|psl)", "mulan", {"1(?: 0)?": "mulanpsl-1.0", "2(?: 0)?": "mulanpsl-2.0"}),
}
#: Short names as licences are called by: keyword (with the space before it), name, label of the bare name (None: it says
#: too little), {version: label}, and whether "only" and "or later" may follow.
SHORT = [
    (" gpl", "(?:gnu )?gpl", "gpl", {"1(?: 0)?": "gpl-1.0", "2(?: 0)?": "gpl-2.0", "3(?: 0)?": "gpl-3.0"}, True),
    (" lgpl", "(?:gnu )?lgpl", "lgpl", {"2(?: 0)?": "lgpl-2.0", "2 1": "lgpl-2.1", "3(?: 0)?": "lgpl-3.0"}, True),
    (" agpl", "(?:gnu )?agpl", "agpl", {"1(?: 0)?": "agpl-1.0", "3(?: 0)?": "agpl-3.0"}, True),
    (" gfdl", "(?:gnu )?gfdl", "gfdl", {"1 1": "gfdl-1.1", "1 2": "gfdl-1.2", "1 3": "gfdl-1.3"}, True),
    (" mpl", "mpl", "mpl", {"1 0": "mpl-1.0", "1 1": "mpl-1.1", "2(?: 0)?": "mpl-2.0"}, False),
    (" epl", "epl", "epl", {"1(?: 0)?": "epl-1.0", "2(?: 0)?": "epl-2.0"}, False),
    (" cddl", "cddl", "cddl", {"1 0": "cddl-1.0", "1 1": "cddl-1.1"}, False),
    (" cpl", "cpl", "cpl", {"1(?: 0)?": "cpl-1.0"}, False),
    (" eupl", "eupl", "eupl", {"1 0": "eupl-1.0", "1 1": "eupl-1.1", "1 2": "eupl-1.2"}, False),
    (" osl", "osl", "osl", {"1 0": "osl-1.0", "2 1": "osl-2.1", "3 0": "osl-3.0"}, False),
    (" afl", "afl", "afl", {"2 1": "afl-2.1", "3 0": "afl-3.0"}, False),
    (" ecl", "ecl", "ecl", {"1 0": "ecl-1.0", "2 0": "ecl-2.0"}, False),
    (" upl", "upl", "upl", {"1(?: 0)?": "upl-1.0"}, False),
    (" ofl", "(?:sil )?ofl", "ofl", {"1 0": "ofl-1.0", "1 1": "ofl-1.1"}, False),
    (" odbl", "odbl", "odbl", {"1(?: 0)?": "odbl-1.0"}, False),
    (" sspl", "sspl", "sspl", {"1(?: 0)?": "sspl-1.0"}, False),
    (" bsl", "bsl", None, {"1 0": "bsl-1.0", "1 1": "busl-1.1"}, False),
    (" busl", "busl", "busl", {"1 1": "busl-1.1"}, False),
    (" boost", "boost", "bsl", {"1(?: 0)?": "bsl-1.0"}, False),
    (" apache", "apache", "apache", {"1 0": "apache-1.0", "1 1": "apache-1.1", "2(?: 0)?": "apache-2.0"}, False),
    (" asl", "asl", None, {"1 1": "apache-1.1", "2(?: 0)?": "apache-2.0"}, False),
    (" artistic", "artistic", "artistic", {"1(?: 0)?": "artistic-1.0", "2(?: 0)?": "artistic-2.0"}, False),
    (" cecill", "cecill", "cecill", {"2 0": "cecill-2.0", "2 1": "cecill-2.1"}, False),
    (" psf", "psf", "psf", {"2(?: 0)?": "psf-2.0"}, False),
    (" mulan", "mulan ?psl", "mulan", {"1(?: 0)?": "mulanpsl-1.0", "2(?: 0)?": "mulanpsl-2.0"}, False),
    (" elastic", "elastic", None, {"2 0": "elastic-2.0"}, False),
    (" zpl", "zpl", "zpl", {"2 0": "zpl-2.0", "2 1": "zpl-2.1"}, False),
    (" mit", "mit", "mit", {}, False),
    (" mit 0", "mit 0", "mit-0", {}, False),
    (" isc", "isc", "isc", {}, False),
    (" bsd", "bsd", "bsd", {}, False),
    (" bsd", "bsd 1 clause", "bsd-1-clause", {}, False),
    (" bsd", "bsd (?:2|two) clause|freebsd|simplified bsd", "bsd-2-clause", {}, False),
    (" bsd", "bsd (?:3|three) clause", "bsd-3-clause", {}, False),
    (" bsd", "bsd (?:4|four) clause", "bsd-4-clause", {}, False),
    (" 0bsd", "0bsd", "0bsd", {}, False),
    (" x11", "x11", "x11", {}, False),
    (" zlib", "zlib(?: libpng)?", "zlib", {}, False),
    (" wtfpl", "wtfpl", "wtfpl", {"2(?: 0)?": "wtfpl"}, False),
    (" unlicense", "unlicense", "unlicense", {}, False),
    (" ncsa", "ncsa", "ncsa", {}, False),
    (" postgresql", "postgresql", "postgresql", {}, False),
    (" ms pl", "ms pl", "ms-pl", {}, False),
    (" ms rl", "ms rl", "ms-rl", {}, False),
    (" hpnd", "hpnd", "hpnd", {}, False),
    (" beerware", "beerware", "beerware", {}, False),
    (" cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0", {}, False),
    (" cc pddc", "cc pddc", "public-domain", {}, False),
    (" pddl", "(?:odc )?pddl(?: 1 0)?", "pddl-1.0", {}, False),
    (" odc by", "odc by(?: 1 0)?", "odc-by-1.0", {}, False),
]
#: Creative Commons: clause -> (short form, spoken form); each in five versions and without one.
CREATIVE = {
    "cc-by": ("cc by", "attribution"),
    "cc-by-sa": ("cc by sa", "attribution share ?alike"),
    "cc-by-nd": ("cc by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "cc-by-nc": ("cc by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("cc by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("cc by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
#: Opening words of full texts, and of notices that stand for them.
TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "permission", "neither the name of [a-z0-9 ]{1,80}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-2.0-or-later", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version"),
    ("agpl-3.0-or-later", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("public-domain", "public domain", "(?:released|dedicated|placed|donated) (?:in)?to the public domain"),
    ("public-domain", "public domain", "in the public domain"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? licen[cs]e"),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "provided", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", "advertising", "the name of the [a-z0-9 ]{1,60}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written (?:authorization|permission)"),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-4-clause", "permission", "all advertising materials mentioning features or use of this software must display the following acknowledgement[a-z0-9 ]{1,200}? permission"),
    ("bsd", "provided", "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("apache-2.0", "distributed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "licensed", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache", "products derived from this software may not be called apache nor may apache appear in their name without prior written permission"),
    ("gpl", "distributed", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0-only", "version 2", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0-only", "version 3", "under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("gpl-linking-exception", "special exception", "as a special exception [a-z0-9 ]{1,120}? permission to link (?:the code of )?this (?:program|library|software)"),
    ("lgpl", "library", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl-3.0", "lesser", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "covered software", "covered software is provided under this license on an as is basis without warranty of any kind"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version)? 1 2(?: or as soon they will be approved by the european commission subsequent versions of the eupl)?"),
    ("artistic-2.0", "package", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("artistic-1.0", "artistic control", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control[a-z0-9 ]{1,300}? distributed"),
    ("zlib", "provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "permission", "permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit[a-z0-9 ]{1,200}? permission"),
    ("psf-2.0", "python software", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php-3.01", "php", "this product includes php software freely available from"),
    ("w3c", "understood", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms"),
    ("ofl-1.1", "font software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself[a-z0-9 ]{0,200}? license"),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1"),
    ("wtfpl", "distribute", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0-1.0", "associated", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "same license", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "modified material", "if you remix transform or build upon the material you may not distribute the modified material[a-z0-9 ]{0,80}? license"),
    ("cc-by-nc", "commercial purposes", "you may not use the material for commercial purposes[a-z0-9 ]{0,80}? license"),
    ("odbl-1.0", "database", "this database is made available under the open database license"),
    ("pddl-1.0", "public domain dedication", "this (?:data|database|work) is made available under the public domain dedication and license"),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("sspl-1.0", "as a service", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl-1.1", "redistribute", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("openrail", "use based", "use based restrictions (?:as )?referenced in (?:paragraph|attachment) [a-z0-9]{1,3} must be included as an enforceable provision[a-z0-9 ]{0,120}? license"),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ncsa", "permission", "neither the names of [a-z0-9 ]{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("beerware", "beer", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer[a-z0-9 ]{0,60}? license"),
    ("curl", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("json", "good not evil", "the software shall be used for good not evil[a-z0-9 ]{0,120}? provided"),
    ("proprietary", "all rights", "all rights reserved (?:no part of this (?:publication|document|work) may be reproduced|unauthorized copying)[a-z0-9 ]{1,200}? permission"),
    ("proprietary", "information", "this (?:document|software|file) contains (?:proprietary|confidential)(?: and (?:proprietary|confidential))? information[a-z0-9 ]{1,200}? permission"),
    ("proprietary", "license agreement", "the use of this software is governed by (?:the|a) (?:end user )?license agreement"),
    ("proprietary", "permission", "may not be (?:reproduced|copied|redistributed) without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
]
#: Labels after "SPDX-License-Identifier:" as they read when normalised.
SPDX = "mit,mit-0,isc,apache-1.1,apache-2.0,gpl-2.0,gpl-2.0-only,gpl-2.0-or-later,gpl-3.0,gpl-3.0-only,gpl-3.0-or-later,lgpl-2.1,lgpl-2.1-only,lgpl-2.1-or-later,lgpl-3.0-only,lgpl-3.0-or-later,agpl-3.0-only,agpl-3.0-or-later,bsd-2-clause,bsd-3-clause,bsd-4-clause,0bsd,mpl-1.1,mpl-2.0,epl-1.0,epl-2.0,cddl-1.0,eupl-1.2,artistic-2.0,bsl-1.0,zlib,unlicense,cc0-1.0,cc-by-4.0,cc-by-sa-4.0,ofl-1.1,ms-pl,wtfpl,upl-1.0,ncsa".split(",")
#: The base phrases.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order; every pattern begins with the space before its first word."""
    out = []
    for keyword, name, bare, versions in FAMILIES.values():
        for version, label in versions.items():
            tail = rf"(?:{name})(?: public)?(?: {_L})?(?: as published by [a-z0-9 ]{{1,60}}?)? (?:version |v ?|ver )?{version}"
            named = rf"(?:{name})(?: public)? {_L} (?:version |v ?|ver )?{version}"
            out += [(label, 3, keyword, f" {_GRANT}{tail}(?= )"), (label, 2, keyword, f" {named}(?= )"), (f"{label}-or-later", 3, keyword, f" {named}(?: of the {_L})? or (?:at your option )?(?:any )?later(?: version)?(?= )")]
        out += [(bare, 2, keyword, f" {_GRANT}(?:{name})(?= )"), (bare, 1, keyword, f" (?:{name}) {_L}(?= )")]
    # "licensed under GPLv3", "License: GPL-3.0-or-later", "GPL v3 license"
    lead, by = rf" (?:{_GRANT}|{_L}(?: is| type| name| identifier| expression)? )", "(?: version | ver | ?v ?| ?)"
    for keyword, name, bare, versions, dated in SHORT:
        if "freebsd" in name:
            keyword = "bsd"
        for version, label in versions.items():
            named = f"(?:{name}){by}{version}"
            for tail, suffix in (("", ""), (" only", "-only"), (" or (?:any )?later(?: version)?", "-or-later")) if dated else (("", ""),):
                out += [(label + suffix, 3, keyword, f"{lead}{named}{tail}(?= )"), (label + suffix, 2, keyword, f" {named}{tail} {_L}(?= )")]
        if bare:
            out += [(bare, 2, keyword, f"{lead}(?:{name})(?= )"), (bare, 1, keyword, f" (?:{name}) {_L}(?= )")]
    for clause, (short, spoken) in CREATIVE.items():
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"{clause}-{version.replace(' ', '.')}"
            out.append((label, 3, short, f" (?:{_GRANT})?{short} {version}(?= )"))
            out.append((label, 3, "creative commons", f" creative commons {spoken} {version}(?: international| unported| generic)?(?: {_L})?(?= )"))
        out += [(clause, 1, short, f" {short}(?: {_L})?(?= )"), (clause, 1, "creative commons", f" creative commons {spoken}(?: {_L})?(?= )")]
    out += [(label, 4, keyword, f" {pattern}(?= )") for label, keyword, pattern in TEXTS]
    out += [(label, 4, "spdx", f" spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?= )") for label in SPDX]
    return out
