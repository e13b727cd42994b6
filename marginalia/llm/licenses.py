"""Licence scan: ordered signature rules behind a keyword prefilter.

Every rule is a regular expression over the normalised words of a text (A-Z lowered, words
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, joined by one space), with keywords of which one occurs in
whatever the expression matches and a priority. Detections are resolved in the order of priority, then length,
then start: one that lies inside an accepted detection is suppressed.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import map_batches, texts_of

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, keywords (|) of which every name has one, names as word patterns, keywords of which
#: every short identifier has one, short identifiers.
FAMILIES = (
    ("mit", "mit|expat", r"mit(?: expat)?|expat", "mit", r"mit"),
    ("mit-0", "mit", r"mit no attribution|mit 0", "mit", r"mit 0"),
    ("apache-1", "apache", r"apache(?: software)? 1 [01]|apache(?: software)? license v(?:ersion)? ?1 [01]", "apache", r"apache 1 [01]"),
    ("apache-2", "apache|asl", r"apache(?: software)?(?: license)?(?: v| version )?2(?: 0)?|apache 2(?: 0)?|asl 2 0", "apache", r"apache 2 0"),
    ("bsd-2", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd", "bsd", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd", r"bsd 4 clause"),
    ("0bsd", "bsd", r"zero clause bsd|bsd zero clause|0bsd", "bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd", r"bsd"),
    ("gpl-1", "gpl|gnu", r"(?:gnu )?gpl ?v?1(?: 0)?|gnu general public license v(?:ersion)? ?1", "gpl", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl|gnu", r"(?:gnu )?gpl ?v?2(?: 0)?|gnu general public license v(?:ersion)? ?2", "gpl", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl|gnu", r"(?:gnu )?gpl ?v?3(?: 0)?|gnu general public license v(?:ersion)? ?3", "gpl", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "gpl|gnu", r"gnu gpl|gnu general public license|gpl", "gpl", r"gpl"),
    ("lgpl-2", "lgpl", r"(?:gnu )?lgpl ?v?2(?: [01])?", "lgpl", r"lgpl 2 [01](?: only| or later)?"),
    ("lgpl-2", "lesser|library", r"gnu (?:lesser|library) general public license v(?:ersion)? ?2(?: [01])?", "lesser", r"gnu lesser 2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?", "lgpl", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public license v(?:ersion)? ?3", "lesser", r"gnu lesser 3 0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "lgpl", r"lgpl"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?", "agpl", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: v(?:ersion)? ?3)?", "affero", r"affero 3 0"),
    ("gfdl", "documentation|gfdl", r"gnu free documentation license|gfdl", "gfdl", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "mozilla|mpl", r"mozilla public license(?: v(?:ersion)?)? ?1 [01]|mpl ?v?1 [01]", "mpl", r"mpl 1 [01]"),
    ("mpl-2", "mozilla|mpl", r"mozilla public license(?: v(?:ersion)?)? ?2(?: 0)?|mpl ?v?2(?: 0)?", "mpl", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public license", "mpl", r"mpl"),
    ("epl-1", "eclipse|epl", r"eclipse public license(?: v(?:ersion)?)? ?1(?: 0)?|epl ?v?1 0", "epl", r"epl 1 0"),
    ("epl-2", "eclipse|epl", r"eclipse public license(?: v(?:ersion)?)? ?2(?: 0)?|epl ?v?2 0", "epl", r"epl 2 0"),
    ("edl-1", "eclipse", r"eclipse distribution license", "edl", r"edl 1 0"),
    ("cddl-1", "common development|cddl", r"common development and distribution license|cddl", "cddl", r"cddl 1 [01]"),
    ("cpl-1", "common", r"common public license", "cpl", r"cpl 1 0"),
    ("eupl-1", "european|eupl", r"european union public licen[cs]e|eupl", "eupl", r"eupl 1 [012]"),
    ("isc", "isc", r"isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib", r"zlib"),
    ("libpng", "libpng", r"libpng", "libpng", r"libpng(?: 2 0)?"),
    ("boost-1", "boost|bsl", r"boost software license|bsl ?1(?: 0)?", "bsl", r"bsl 1 0"),
    ("artistic-1", "artistic", r"artistic license 1(?: 0)?", "artistic", r"artistic 1 0"),
    ("artistic-2", "artistic", r"artistic license 2(?: 0)?", "artistic", r"artistic 2 0"),
    ("perl", "perl", r"same terms as perl(?: itself)?", "perl", r"perl"),
    ("python-2", "python|psf", r"python software foundation|psf", "psf|python", r"psf 2 0|python 2 0"),
    ("ruby", "ruby", r"ruby", "ruby", r"ruby"),
    ("php-3", "php", r"php license v(?:ersion)? ?3(?: 0[01]?)?", "php", r"php 3 0(?:1)?"),
    ("unlicense", "unlicense", r"unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?", "cc", r"cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?", "cc", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?", "cc", r"cc by nc [1234] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?", "cc", r"cc by nd [1234] [05]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?", "cc", r"cc by sa [1234] [05]"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?", "cc", r"cc by [1234] [05]"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "creative", r"creative commons nc nd"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike", "creative", r"creative commons nc sa"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", "creative", r"creative commons nc"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?", "creative", r"creative commons nd"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", "creative", r"creative commons sa"),
    ("cc-by", "creative", r"creative commons attribution", "creative", r"creative commons by"),
    ("odbl-1", "database|odbl", r"open database license|odbl", "odbl", r"odbl 1 0"),
    ("odc-by-1", "open data", r"open data commons attribution", "odc", r"odc by 1 0"),
    ("pddl-1", "pddl", r"pddl", "pddl", r"pddl 1 0"),
    ("ofl-1", "open font", r"sil open font license|open font license", "ofl", r"ofl 1 [01]"),
    ("postgresql", "postgresql", r"postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl", "openssl", r"openssl"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl", r"ms rl"),
    ("sspl-1", "server", r"server side public license", "sspl", r"sspl 1 0"),
    ("busl-1", "business", r"business source license", "busl", r"busl 1 1"),
    ("elastic-2", "elastic", r"elastic license(?: v?2(?: 0)?)?", "elastic", r"elastic 2 0"),
    ("ncsa", "ncsa", r"university of illinois ncsa(?: open source)?|ncsa open source", "ncsa", r"ncsa"),
    ("afl-3", "academic", r"academic free license", "afl", r"afl 3 0"),
    ("osl-3", "open software", r"open software license", "osl", r"osl 3 0"),
    ("upl-1", "universal", r"universal permissive license", "upl", r"upl 1 0"),
)

#: Statements that stand outside the families; label, keyword, pattern.
STATEMENTS = (
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) in the public domain"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("all-rights-reserved", "rights reserved", r"copyright (?:c )?(?:19|20)\d\d[^\n]{0,80}? all rights reserved"),
    ("proprietary", "confidential", r"confidential and proprietary|proprietary and confidential"),
    ("proprietary", "reproduction", r"(?:unauthori[sz]ed|any) reproduction (?:or distribution )?(?:is|of this) (?:strictly )?(?:prohibited|forbidden)"),
    ("mit", "deal in the software", r"deal in the software without restriction"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("isc", "with or without fee", r"use copy modify and or distribute this software for any purpose with or without fee"),
    ("gpl", "free software foundation", r"general public license as published by the free software foundation"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
)

#: Clauses of licence bodies and headers, as normalised words; label, keyword, pattern.
CLAUSES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission notice", r"(?:the above|this) copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "liable for any claim", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied"),
    ("x11", "permission notice appear", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("x11", "advertising or otherwise", r"shall not be used in advertising or otherwise to promote the sale use or other dealings .{0,120}?without prior written (?:authorization|permission)"),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge .{0,400}?to do so the software is provided as is"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products .{0,60}?without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display .{0,80}?acknowledge?ment|advertising materials must display this copyright acknowledgement"),
    ("bsd", "contributors be liable", r"in no event shall the (?:copyright (?:holder|owner)s?|regents) (?:or|and) contributors be liable for any direct indirect incidental"),
    ("bsd", "contributors as is", r"this software is provided by the (?:copyright holders|regents) and contributors as is and any express or implied warranties"),
    ("bsd-clear", "express or implied licen", r"no express or implied licen[cs]es to any party s patent rights are granted by this license"),
    ("0bsd", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "copyright notice and this permission notice appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "disclaims all warranties with regard", r"(?:isc|internet systems consortium) disclaims all warranties with regard to this software"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("apache-2", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2", "as is basis", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "grant of copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual"),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license"),
    ("apache-2", "attribution notices", r"you must retain in the source form of any derivative works .{0,40}?all copyright patent trademark and attribution notices"),
    ("apache-2", "notice text file", r"if the work includes a notice text file as part of its distribution then any derivative works .{0,400}?licen[cs]e"),
    ("apache-2", "submission of contributions", r"submission of contributions unless you explicitly state otherwise .{0,200}?terms and conditions of this license"),
    ("apache-1.1", "end user documentation", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("apache-1.1", "prior written permission", r"products derived from this software may not be called .{1,80}? without prior written permission"),
    ("gpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "without any warranty", r"in the hope that it will be useful but without any warranty without even the implied warranty"),
    ("gpl", "copy of the gnu general public", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl-2", "version 2 of the license", r"either version 2 of the license or at your option any later version"),
    ("gpl-2", "version 2 of the license", r"general public license .{0,80}?version 2 of the license"),
    ("gpl-3", "version 3 of the license", r"either version 3 of the license or at your option any later version"),
    ("gpl-2", "terms and conditions for copying", r"(?:gnu )?general public license terms and conditions for copying distribution and modification"),
    ("gpl-2", "permitted only in object code", r"this license .{0,400}?permitted only in object code or executable form"),
    ("gpl-2", "derived from the program", r"work that you distribute or publish that in whole or in part contains or is derived from the program .{0,120}?this license"),
    ("gpl-3", "tivoization", r"license .{0,200}?tivoization"),
    ("gpl-3", "anti circumvention", r"covered work shall be deemed part of an effective technological measure .{0,60}?anti circumvention"),
    ("gpl-3", "anti circumvention", r"protecting users legal rights from anti circumvention law .{0,60}?covered work"),
    ("gpl-3", "installation information", r"installation information for a user product .{0,200}?covered work"),
    ("gpl-3", "copyleft license", r"the gnu general public license is a free copyleft license for software"),
    ("gpl", "freedom to share", r"the licenses for most software .{0,60}?are designed to take away your freedom to share"),
    ("gpl", "as a special exception", r"as a special exception .{0,120}?permission to link(?:ing)? .{0,80}"),
    ("lgpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-2.1", "work that uses the library", r"a program that contains no derivative of any portion of the library .{0,160}?is called a work that uses the library .{0,400}?licen[cs]e"),
    ("lgpl-2.1", "version 2 1 of the license", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "combined work", r"you may convey a combined work under terms of your choice that taken together effectively do not restrict"),
    ("lgpl-3", "application that uses an interface", r"this license .{0,400}?application that uses an interface provided by the library"),
    ("agpl-3", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "remotely through a computer network", r"modified version must prominently offer all users interacting with it remotely through a computer network .{0,200}?license"),
    ("agpl-3", "network server software", r"license .{0,200}?cooperation with the community in the case of network server software"),
    ("mpl-2", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses"),
    ("mpl-2", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one .{0,60}?(?:license|mozilla org mpl)"),
    ("mpl-2", "larger work", r"you may create and distribute a larger work under terms of your choice provided that you also comply with the requirements of this license"),
    ("mpl-1.1", "covered code", r"you must make covered code available in source code form under the terms of this license"),
    ("mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1", "agreement", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-2", "secondary license", r"exhibit a form of secondary licenses notice"),
    ("epl-1", "commercial distributors", r"commercial distributors of software may accept certain responsibilities .{0,200}?liability"),
    ("cpl-1", "common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl-1", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("cddl-1", "covered software", r"any covered software that you distribute or otherwise make available in executable form must also be made available in source code form"),
    ("cddl-1", "cddl header", r"cddl header start .{0,200}?license"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented .{0,400}?altered source|permission is granted to anyone to use this software .{0,160}?origin of this software"),
    ("zlib", "arising from the use of this software", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1", "machine executable object code", r"the copyright notices in the software and this entire statement .{0,500}?machine executable object code"),
    ("bsl-1", "boost software license", r"distributed under the boost software license version 1 0"),
    ("bsl-1", "obtaining a copy of the software and accompanying documentation", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software .{0,200}?copyright"),
    ("unlicense", "copyright laws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("unlicense", "detriment of our heirs", r"copyright .{0,200}?to the detriment of our heirs and successors"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license"),
    ("artistic-2", "artistic license", r"terms of the artistic license 2 0"),
    ("artistic-1", "artistic control", r"the copyright holder .{0,200}?semblance of artistic control"),
    ("artistic-2", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document .{0,200}?artistic"),
    ("gfdl", "invariant sections", r"under the terms of the gnu free documentation license .{0,160}?invariant sections"),
    ("gfdl", "cover texts", r"license .{0,240}?with no invariant sections no front cover texts and no back cover texts"),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font names? .{0,120}?(?:permission|license)"),
    ("ofl-1.1", "font software is licensed", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "sold by itself", r"neither the font software nor any of its individual components .{0,80}?may be sold by itself .{0,400}?license"),
    ("cc-by-4", "creative commons attribution 4 0", r"this work is licensed under (?:a |the )?creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution share", r"licensed under (?:a |the )?creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons attribution non", r"licensed under (?:a |the )?creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons attribution no", r"licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative|ative work)?s"),
    ("cc0", "waiv", r"the person who associated a work .{0,80}?has dedicated the work to the public domain by waiving|affirmer hereby overtly fully permanently irrevocably and unconditionally waives .{0,120}?copyright"),
    ("cc0", "waived all copyright", r"to the extent possible under law .{1,120}? waived all copyright and related or neighboring rights"),
    ("cc-by", "exercising the licensed rights", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms"),
    ("cc-by-nc", "primarily intended for", r"noncommercial means not primarily intended for or directed towards commercial advantage .{0,200}?licen"),
    ("cc-by-sa", "adapter s license", r"the adapter s license you apply must be a creative commons license with the same license elements"),
    ("odbl", "open database license", r"this .{1,60}? is made available under the open database license"),
    ("odbl", "produced work", r"publicly use a produced work you must include a notice .{0,240}?licen[cs]e"),
    ("python-2", "python software foundation", r"this license agreement is between the python software foundation"),
    ("python-2", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit .{0,200}?(?:permission|redistribut)"),
    ("php-3", "php", r"this product includes php software freely available from .{0,200}?(?:permission|redistribut|licen)"),
    ("ms-pl", "limitations in section 3", r"subject to the terms of this license including the license conditions and limitations in section 3"),
    ("busl-1", "change date", r"effective on the change date .{0,240}?change license"),
    ("busl-1", "production use", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1", "third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service .{0,200}?license"),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service .{0,240}?licen"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version 1 [12])?"),
    ("ncsa", "deal with the software", r"rights to use .{0,200}?to deal with the software without restriction .{0,200}?permission"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "supporting documentation", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose .{0,240}?appear in supporting documentation"),
    ("curl", "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("libpng", "png reference library", r"the png reference library is supplied as is .{0,240}?(?:warrant|liab)"),
    ("afl-3", "licensed under the academic", r"licensed under the academic free license version 3 0"),
    ("proprietary", "reverse engineer", r"you may not (?:modify )?reverse engineer decompile or disassemble .{0,160}?(?:licen|permission)"),
    ("proprietary", "written permission of the", r"without the (?:express|prior) written permission of the (?:copyright (?:owner|holder)|publisher|author)"),
    ("proprietary", "non transferable", r"non exclusive non transferable (?:limited )?licen[cs]e to use"),
    ("proprietary", "trade secret", r"contains (?:confidential information and )?trade secrets? .{0,160}?(?:copyright|permission)"),
)

#: Contexts in which a family's name becomes a signature; priority and confidence.
NOTICE = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|shared|redistributed) under (?:the )?(?:terms of (?:the )?)?"
CONTEXTS = (
    (5, 0.99, r"spdx licen[cs]e identifier (?:{id})"),
    (4, 0.97, NOTICE + r"(?:{name})(?: licen[cs]e)?"),
    (3, 0.9, r"(?:opensource|apache|gnu|creativecommons|spdx) org licen[cs]es? (?:{id})"),
    (2, 0.8, r"(?:the )?(?:{name}) licen[cs]e"),
    (1, 0.6, r"licen[cs]e (?:type |is |name )?(?:{name})"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]  # any of them opens the rule
    priority: int
    confidence: float
    pattern: re.Pattern[bytes]


def _compile(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


def _keywords(alternatives: str) -> tuple[bytes, ...]:
    return tuple(alternatives.encode().split(b"|"))


def signature_rules() -> list[Rule]:
    """All rules in the order of decreasing priority."""
    rules = [Rule(label, _keywords(phrase), 6, 1.0, _compile(phrase)) for phrase, label in BASE]
    for label, name_keywords, name, short_keywords, short in FAMILIES:
        for priority, confidence, context in CONTEXTS:
            keywords = _keywords(name_keywords if "{name}" in context else short_keywords)
            rules.append(Rule(label, keywords, priority, confidence, _compile(context.format(name=name, id=short))))
    rules += [Rule(label, _keywords(keyword), 3, 0.9, _compile(pattern)) for label, keyword, pattern in (*STATEMENTS, *CLAUSES)]
    return sorted(rules, key=lambda r: -r.priority)


_DROP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: One of these occurs in every text that any rule can match.
GATES = (b"licen", b"cc by nc", b" under ", b"public domain", b"rights reserved", b"proprietary", b"reproduction",
         b"deal in the software", b"redistribut", b"without fee", b"altered source", b"unencumbered", b"warrant", b"liab", b"copyright",
         b"permission", b"covered", b"commons", b"mozilla", b"documentation", b"or otherwise to promote", b"advertising materials", b"contributor")


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_DROP).split()


class Cover:
    """Intervals, of which only those that lie in no other matter: by start, and so by end too."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        """Take in an interval that none holds, in place of those that it holds."""
        low, high = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        self.starts[low : max(low, high)] = [start]
        self.ends[low : max(low, high)] = [end]


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Keep detections by priority, length and start; one inside a kept detection is suppressed."""
    kept: list[tuple[int, int, Rule]] = []
    cover = Cover()
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not cover.holds(start, end):
            kept.append((start, end, rule))
            cover.add(start, end)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def by_keywords(rules: list[Rule]) -> dict[tuple[bytes, ...], list[Rule]]:
    groups: dict[tuple[bytes, ...], list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.keywords, []).append(rule)
    return groups


def detections(line: bytes, rules: dict[tuple[bytes, ...], list[Rule]]) -> list[tuple[int, int, Rule]]:
    """Resolved detections in one normalised text as (start byte, end byte, rule)."""
    if not any(gate in line for gate in GATES):
        return []
    found = []
    for keywords, group in rules.items():
        if any(keyword in line for keyword in keywords):
            for rule in group:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(line)]
    return resolve(found)


def word_index(line: bytes, places: list[int]) -> list[int]:
    """How many words begin before each byte of a normalised text, in one pass over it."""
    if not places:
        return []
    return np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), places).tolist()


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase, overlaps included."""
    starts, labels = [], []
    padded = b" " + line + b" "
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            starts.append(at)
            labels.append(label)
            at = padded.find(needle, at + 1)
    return sorted(zip(word_index(line, starts), labels, strict=True))


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, detections array<struct<label:string,first_word:bigint,n_words:bigint,priority:int>>"
)
_STRUCT = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32())]))


def license_scan(docs: DataFrame) -> DataFrame:
    """Labels, places and resolved detections of every text; one row per row of `docs`.

    A null or empty text has no words and score 0; an empty table gives no rows. The score is the largest
    confidence of a kept detection. Rows are independent, repeated ones too: there is no shuffle and memory is bounded
    by one Arrow batch. A text of any length is scanned whole, in time that grows with its length and its number of
    detections, not with their product. Other columns than doc_id and text are not read.
    """
    by_key: dict[tuple[bytes, ...], list[Rule]] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not by_key:
            by_key.update(by_keywords(signature_rules()))
        columns: list[list] = [[] for _ in range(8)]
        for text in batch.column("text").cast(pa.binary()):
            words = words_of(text.as_py())
            line = b" ".join(words)
            places = base_places(line)
            kept = detections(line, by_key)
            base = {label for _, label in places}
            labels = base | {rule.label for _, _, rule in kept}
            score = max([rule.confidence for _, _, rule in kept] + [1.0] * bool(places), default=0.0)
            first, last = (word_index(line, [d[side] for d in kept]) for side in (0, 1))
            spans = [
                {"label": rule.label, "first_word": a, "n_words": b - a + 1, "priority": rule.priority}
                for a, b, (_, _, rule) in zip(first, last, kept, strict=True)
            ]
            row = (
                len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _STRUCT]
        arrays = [batch.column("doc_id")] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(texts_of(docs), work, SCHEMA)
