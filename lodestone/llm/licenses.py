"""Licence scans by sentence rules.

Sentences are normalised and looked up among known licence sentences; the identifiers found, in text
order, are matched against rules, each an ordered list of identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Sentences of public licences and of their usual headers, by identifier.  One identifier may
# have several wordings; <...> stands for one to twelve words, such as a holder's name.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "apache2-compliance": ["you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "you may not use these files except in compliance with the License"],
    "apache2-obtain": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0", "http://www.apache.org/licenses/LICENSE-2.0.txt", "http://www.apache.org/licenses/"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, KIND, either express or implied"],
    "apache2-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache2-date": ["Version 2.0, January 2004"],
    "apache2-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "asf-contributed": ["Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"],
    "gnu-gpl": ["GNU GENERAL PUBLIC LICENSE"],
    "gnu-lgpl": ["GNU LESSER GENERAL PUBLIC LICENSE", "GNU LIBRARY GENERAL PUBLIC LICENSE"],
    "gnu-agpl": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gnu-date3": ["Version 3, 29 June 2007"],
    "gnu-date-agpl": ["Version 3, 19 November 2007"],
    "gnu-date2": ["Version 2, June 1991"],
    "gnu-date21": ["Version 2.1, February 1999"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl-free": ["<...> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "<...> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", "<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2", "<...> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License", "<...> is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl21-free": ["<...> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["<...> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-free": ["<...> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["<...> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with <...>"],
    "lgpl-received": ["You should have received a copy of the GNU Lesser General Public License along with <...>"],
    "agpl-received": ["You should have received a copy of the GNU Affero General Public License along with <...>"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of <...> may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-asis": ["THIS SOFTWARE IS PROVIDED BY <...> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd-liability": ["IN NO EVENT SHALL <...> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <...>"],
    "epl-accompanying": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-event": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "wtfpl-terms": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"],
    "cc0-waiver": ["To the extent possible under law, <...> has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["All rights reserved"],
}

#: Rules (licence, identifiers in order).  A longer rule takes its sentences before a shorter one.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant"]),
    ("MIT-0", ["mit0-grant", "mit-warranty"]),
    ("Apache-2.0", ["Apache-2.0 notice", "apache2-compliance", "apache2-obtain", "apache2-asis", "apache2-limits"]),
    ("Apache-2.0", ["apache2-compliance", "apache2-obtain", "apache2-asis", "apache2-limits"]),
    ("Apache-2.0", ["Apache-2.0 notice", "apache2-compliance", "apache2-obtain", "apache2-asis"]),
    ("Apache-2.0", ["apache2-compliance", "apache2-obtain", "apache2-asis"]),
    ("Apache-2.0", ["asf-contributed"]),
    ("Apache-2.0", ["apache2-date", "apache2-url", "apache2-terms"]),
    ("Apache-2.0", ["apache2-url"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL-3.0", ["gpl-free"]),
    ("GPL-3.0", ["gnu-gpl", "gnu-date3", "gnu-verbatim"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope", "gpl-received"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("GPL-2.0", ["gnu-gpl", "gnu-date2", "gnu-verbatim"]),
    ("LGPL-2.1", ["lgpl21-free", "gpl-hope", "lgpl-details", "lgpl-received"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("LGPL-2.1", ["gnu-lgpl", "gnu-date21", "gnu-verbatim"]),
    ("LGPL-3.0", ["lgpl3-free", "gpl-hope", "lgpl-details", "lgpl-received"]),
    ("LGPL-3.0", ["lgpl3-free"]),
    ("LGPL-3.0", ["gnu-lgpl", "gnu-date3", "gnu-verbatim"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-hope", "agpl-details", "agpl-received"]),
    ("AGPL-3.0", ["agpl3-free"]),
    ("AGPL-3.0", ["gnu-agpl", "gnu-date-agpl", "gnu-verbatim"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-asis"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-2.0", ["epl-accompanying"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-asis", "zlib-event", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("WTFPL", ["wtfpl-terms"]),
    ("CC0-1.0", ["cc0-waiver"]),
]

# Names of licences as they stand in notices, as patterns over normalised words; the first that fits counts.
_L = "licen[sc]es?"


def _gnu(long: str, short: str, version: str) -> str:
    return rf"(?:gnu )?(?:{long}(?: public)?(?: {_L})?(?: {short})?|{short}) ?(?:version |v ?)?{version}(?: 0)?(?: only| or later| or any later version)?"


def _versioned(name: str, version: str) -> str:
    number = rf"(?:version |v ?)?{version}(?: 0)?"
    return rf"(?:{name})(?: {_L})? {number}(?: {_L})?"


NAMES = [
    ("AGPL-3.0", _gnu("affero general", "agpl", "3")),
    ("LGPL-3.0", _gnu("(?:lesser|library) general", "lgpl", "3")),
    ("LGPL-2.1", _gnu("(?:lesser|library) general", "lgpl", "2 1")),
    ("GPL-3.0", _gnu("general", "gpl", "3")),
    ("GPL-2.0", _gnu("general", "gpl", "2")),
    ("Apache-2.0", _versioned("apache(?: software)?|asl", "2")),
    ("BSD-3-Clause", rf"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: {_L})?"),
    ("BSD-2-Clause", rf"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: {_L})?"),
    ("0BSD", rf"(?:0bsd|zero clause bsd)(?: {_L})?"),
    ("BSD-3-Clause", rf"bsd(?: style)? {_L}"),
    ("MIT", rf"mit(?: x11| expat)?(?: style)?(?: open source)? {_L}|expat {_L}|x11 {_L}|mit"),
    ("ISC", rf"isc(?: {_L})?"),
    ("MPL-2.0", _versioned(f"mozilla public {_L}|mpl", "2") + r"|mpl2(?: 0)?"),
    ("EPL-2.0", _versioned(f"eclipse public {_L}|epl", "2")),
    ("EPL-1.0", _versioned(f"eclipse public {_L}|epl", "1")),
    ("BSL-1.0", rf"boost software {_L}(?: (?:version )?1 0)?"),
    ("Zlib", rf"zlib(?: libpng)? {_L}"),
    ("Unlicense", "unlicense"),
    ("WTFPL", "wtfpl"),
    ("Artistic-2.0", _versioned(f"artistic {_L}|artistic", "2")),
    ("EUPL-1.2", rf"(?:european union public {_L}|eupl)(?: version| v)? ?1 2"),
    ("OFL-1.1", rf"(?:sil )?open font {_L}(?: (?:version )?1 1)?"),
    ("PSF-2.0", rf"(?:python software foundation|psf) {_L}"),
    ("CC0-1.0", r"(?:creative commons zero|cc0)(?: (?:version )?1 0)?(?: universal)?"),
    ("CC", rf"(?:creative commons|cc) (?P<by>by|attribution)(?P<more>(?: (?:nc|noncommercial|non commercial|sa|sharealike|share alike|nd|noderivatives|no derivatives|noderivs))*)(?: version)? (?P<major>[1-4]) (?P<minor>\d)(?: international| unported| generic)?(?: {_L})?"),
]
_VERB = r"(?:licen[sc]ed|released|distributed|redistributed|available|provided|published|offered|covered|shared|governed|used|usable|licensing is)"
_SCOPE = r"(?:under|by|with)(?: the)?(?: (?:following|terms|conditions|provisions|terms and conditions|term|either|both|a|an|of|the|its|permissive|free|open source)){0,5}"

#: Sentences that may stand between two of a rule's.
GAP = 4

_WORD = re.compile(r"[a-z0-9]+")
_END = re.compile(r"(?<=[.!?;:])\s+|\n[ \t]*\n\s*")
_HINT = re.compile(r"licen[sc]e|permission|copyright|redistribut|warrant|free[^a-z0-9]+software|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved|spdx|obtain[^a-z0-9]+a[^a-z0-9]+copy|anyone[^a-z0-9]+is[^a-z0-9]+free|advertising|in[^a-z0-9]+no[^a-z0-9]+event|software[^a-z0-9]+is[^a-z0-9]+provided|version[^a-z0-9]+\d|terms|verbatim|mpl|under[^a-z0-9]", re.I)
_MARK = re.compile(r"(?:\d+|[a-z]) ")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.I)
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
#: What before a notice says that it doesn't hold, with at most four words between.
_NOT = re.compile(r"\b(?:not|never|no longer|isn t|aren t|wasn t|weren t|cannot be|unlike|instead of|rather than|neither|without being)(?: \w+){0,4} $")
#: Words of which the search for wordings within a line makes nothing shorter known.
_LEAST = 8
#: Words that a notice may run to; lines are joined to so many.
_NOTICE_WORDS = 40
#: Words that the gap in a pattern may take.
_HOLE = r"\w+(?: \w+){0,11}"


def normalise(sentence: str) -> str:
    """Lower-case words and numbers with single blanks; bullets, quotes and stops go."""
    return " ".join(_WORD.findall(sentence.lower()))


def spdx_name(name: str) -> str:
    """The licence of an SPDX identifier: 'only', 'or later' and '+' don't tell licences apart here."""
    return re.sub(r"-(?:only|or-later)$|\+$", "", name)


@lru_cache(maxsize=1)
def _grammar() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """(notices, titles, licence by group): a notice is a verb, 'under' and a name, or 'license' and a name at
    the beginning of a line; a title is a name with 'license' in it that fills a line."""
    groups, parts = {}, []
    for k, (licence, pattern) in enumerate(NAMES):
        groups[f"n{k}"] = licence
        parts.append(f"(?P<n{k}>{pattern})")
    any_ = "|".join(parts)
    domain = r"(?P<pd>(?:released|placed|dedicated)(?: \w+){0,3}? (?:in|into|to)(?: the)? public domain)"
    notice = re.compile(rf"\b(?:{domain}|{_VERB}(?: \w+){{0,4}}? {_SCOPE} (?:{any_})(?![a-z0-9]))")
    title = re.compile(rf"(?:the |project |code )?(?:licen[sc]e (?:the |is )?)?(?:{any_})(?: mit| isc)?")
    return notice, title, groups | {"pd": "public-domain"}


@lru_cache(maxsize=1)
def _listed() -> re.Pattern:
    """A further name in the list that a notice's name begins: after 'and' or 'or', or next to it."""
    any_ = "|".join(f"(?P<n{k}>{pattern})" for k, (_, pattern) in enumerate(NAMES))
    return re.compile(rf" (?:(?:and or|and|or|as well as|plus)(?: (?:the|a|an|under|both|either|optionally|at your option|terms|conditions|of))*? )?(?:{any_})(?![a-z0-9])")


def _names_in(m: re.Match, words: str, groups: dict[str, str]) -> Iterator[tuple[str, int]]:
    """(licence, end) of a notice's name and of those listed after it."""
    end = m.end()
    yield _licence_of(m, groups), end
    if m.groupdict().get("pd") is None:
        while further := _listed().match(words, end):
            end = further.end()
            yield _licence_of(further, groups), end


@lru_cache(maxsize=1)
def _anywhere() -> ahocorasick.Automaton:
    """An automaton over words for the wordings of ``_LEAST`` words or more that have no stop or gap inside."""
    a = ahocorasick.Automaton()
    for words, name in _known()[0].items():
        if words.count(" ") >= _LEAST - 1 and "." not in words:
            a.add_word(f" {words} ", (name, len(words)))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _needs_more() -> frozenset[str]:
    """Sentences that no rule takes alone, so that a notice within them counts by itself."""
    return frozenset(SENTENCES) - {names[0] for _, names in RULES if len(names) == 1}


def _licence_of(m: re.Match, groups: dict[str, str]) -> str:
    licence = next(groups[g] for g, v in m.groupdict().items() if v is not None and g in groups)
    if licence == "CC":
        more = m["more"]
        kinds = [k for k, words in (("NC", ("nc", "noncommercial", "non commercial")), ("SA", ("sa", "sharealike", "share alike")), ("ND", ("nd", "noderivatives", "no derivatives", "noderivs"))) if any(re.search(rf"\b{w}\b", more) for w in words)]
        return "-".join(["CC-BY", *kinds, f"{m['major']}.{m['minor']}"])
    return licence


def _parts(text: str) -> Iterator[tuple[int, int, str | None]]:
    """(begin, end, join) of every part.  ``join`` stands for the stop between a part and the next one in
    a wording that runs over both: nothing for ';' and ':', ' .' for others, None where none may."""
    at = 0
    for m in _END.finditer(text):
        yield at, m.start(), None if m[0].count("\n") > 1 else "" if text[m.start() - 1] in ";:" else " ."
        at = m.end()
    yield at, len(text), None


@lru_cache(maxsize=1)
def _known() -> tuple[dict[str, str], list[tuple[str, re.Pattern]], int]:
    """Identifiers by wording, as one part and as cut into parts, in alphabetical order; patterns of those
    with a gap; the length of the longest."""
    table, holes = {}, []
    for k, all_ in SENTENCES.items():
        for s in all_:
            for words in (normalise(s.replace("<...>", " zzz ")), " ".join(normalise(s[at:end].replace("<...>", " zzz ")) + (join or "") for at, end, join in _parts(s))):
                if "zzz" in words:
                    holes.append((k, re.compile(re.escape(words).replace("zzz", _HOLE))))
                else:
                    table[words] = k
    return dict(sorted(table.items())), holes, max(len(normalise(s)) for all_ in SENTENCES.values() for s in all_) + 160


@lru_cache(maxsize=1)
def _hole_starts() -> re.Pattern:
    """What a run that fits a pattern with a gap has to hold."""
    return re.compile("free software|in the hope that|a copy of the gnu|the name of|this software is provided by|in no event shall|to the extent possible under law|this program and the accompanying materials")


#: Words that may stand before the first telling words of a pattern with a gap.
_BEFORE = 16


@lru_cache(maxsize=1)
def _wordings() -> list[str]:
    return list(_known()[0])


def _may_go_on(words: str) -> bool:
    """Whether a known wording begins with these words, or a pattern with a gap may."""
    at = bisect_left(_wordings(), words)
    if at < len(_wordings()) and _wordings()[at].startswith(words):
        return True
    return words.count(" ") < _BEFORE or bool(_hole_starts().search(words))


def identify_sentences(text: str) -> list[tuple[int, int, str]]:
    """(sentence number, first code point, identifier) of every known sentence, in text order.

    Parts end at a stop with white space after it or at an empty line.  A known sentence is a run of whole
    lines of a part, or of several parts where its wording has stops inside; the longest run counts, and as
    one sentence.  So notices that follow an unfinished line are found too.  List marks before a sentence
    are passed over.  Lines that begin no known sentence are searched for notices ('... licensed under the
    terms of the MIT license ...', identifier 'MIT notice'), titles ('MIT title') and SPDX lines ('MIT spdx').
    A notice that says 'not' before its verb is none.
    """
    known, holes, longest = _known()
    notices, titles, groups = _grammar()
    parts = list(_parts(text))
    cut: dict[int, list[tuple[int, str]]] = {}

    def lines(p: int) -> list[tuple[int, str]]:
        if p not in cut:
            cut[p] = _lines(text[parts[p][0] : parts[p][1]], parts[p][0])
            cut.pop(p - 40, None)
        return cut[p]

    def run(p: int, i: int) -> tuple[int, int, str] | None:
        """(part, line, identifier) where the longest known run from a line ends."""
        mark = _MARK.match(lines(p)[0][1] + " ") if i == 0 else None
        most = longest + (mark.end() if mark else 0)
        words, hit, q, j = "", None, p, i
        while True:
            here = lines(q)
            for n in range(j, len(here)):
                words = f"{words} {here[n][1]}".strip()
                if len(words) > most:
                    return hit
                name = known.get(words)
                end = n == len(here) - 1
                if not name and end:
                    bare = words[mark.end() :] if mark else words
                    name = known.get(bare)
                    if not name and _hole_starts().search(bare):
                        name = next((k for k, pattern in holes if pattern.fullmatch(bare)), None)
                if name:
                    hit = (q, n, name)
                if not _may_go_on(words[mark.end() :] if mark else words) and not (mark and _may_go_on(words)):
                    return hit
            join = parts[q][2]
            if join is None:
                return hit
            words, q, j = words + join, q + 1, 0
            if len(words) > most:
                return hit

    def grammar(p: int, i: int) -> tuple[list[str], int]:
        """Identifiers of the notices that begin in a line, or of the title that it is, and the last line
        that they reach into."""
        here = lines(p)
        line = here[i][1]
        if line in ("license", "licence") and i == len(here) - 1 and parts[p][2] == "" and p + 1 < len(parts) and lines(p + 1):
            line = f"{line} {lines(p + 1)[0][1]}"
        if "public domain" not in line and "under" not in line and "licen" not in line and "with" not in line and " by" not in line:
            return [], i
        whole = titles.fullmatch(line)
        if whole and "licen" in line:
            return [f"{_licence_of(whole, groups)} title"], i
        line = words = here[i][1]
        ends = [len(line)]
        while i + len(ends) < len(here) and len(words) - len(line) < 8 * _NOTICE_WORDS:
            words = f"{words} {here[i + len(ends)][1]}"
            ends.append(len(words))
        names, last = [], i
        for m in notices.finditer(words):
            if m.start() >= len(line):
                break
            last = i + bisect_left(ends, m.end())
            if not _NOT.search(words[max(0, m.start() - 60) : m.start()]):
                for licence, end in _names_in(m, words, groups):
                    names.append(f"{licence} notice")
                    last = max(last, i + bisect_left(ends, end))
        return names, last

    def inside(p: int, i: int) -> list[str]:
        """Identifiers of long wordings that begin within a line and needn't fill lines: of those that begin at
        one word the longest, and none within another."""
        here = lines(p)
        words, n = f" {here[i][1]} ", i + 1
        first = len(words) - 1
        while n < len(here) and len(words) < first + longest:
            words, n = f"{words}{here[n][1]} ", n + 1
        hits = sorted((end - size - 1, -size, name) for end, (name, size) in _anywhere().iter(words) if end - size - 1 < first)
        names, free = [], 0
        for start, size, name in hits:
            if start >= free:
                before = re.search(r"\b\w+(?: \w+){0,11} $", words[max(0, start - 80) : start + 1])
                if name in _needs_more():
                    for m in notices.finditer(words[start : start - size + 1]):
                        if not (before and _NOT.search(before[0])):
                            names += [f"{k} notice" for k, _ in _names_in(m, words[start:], groups)]
                names.append(name)
                free = start - size
        return names

    spdx = {}
    for m in _SPDX.finditer(text):
        ids = [x for x in _SPDX_ID.findall(m[1].split("*/")[0].split("-->")[0]) if x.upper() not in ("AND", "OR", "WITH")]
        spdx[m.start()] = ids
    found, p, i, joined = [], 0, 0, 0
    marks = sorted(spdx)
    while p < len(parts):
        if (i == 0 and not _HINT.search(text, *parts[p][:2])) or i >= len(lines(p)):
            p, i = p + 1, 0
            continue
        hit = run(p, i)
        at = lines(p)[i][0]
        if hit:
            if hit[2] in _needs_more():  # a notice may stand within a sentence that is known as a whole
                whole = " ".join(w for q in range(p, hit[0] + 1) for _, w in lines(q)[i if q == p else 0 : hit[1] + 1 if q == hit[0] else None])
                found += [(p - joined, at, f"{k} notice") for m in notices.finditer(whole) for k, _ in _names_in(m, whole, groups)]
            found.append((p - joined, at, hit[2]))
            joined += hit[0] - p
            p, i = hit[:2]
        else:
            within = inside(p, i)
            names, i = grammar(p, i)
            held = {x for x in within if x.endswith(" notice")}
            found += [(p - joined, at, name) for name in [*(x for x in names if x not in held), *within]]
        i += 1
    if marks:
        number = [at for _, at, _ in found]
        begins = [b for b, _, _ in parts]
        found += [(bisect_right(begins, at) - 1, at, f"{spdx_name(x)} spdx") for at in marks for x in spdx[at]]
        if number:
            found.sort(key=lambda f: f[1])
    return found


def _lines(part: str, at: int) -> list[tuple[int, str]]:
    """(first code point, words) of the lines of a part that have words; lines without go to the next."""
    out, first = [], None
    for line in part.split("\n"):
        words = normalise(line)
        first = at if first is None else first
        if words:
            out.append((first if out else first + len(part) - len(part.lstrip()), words))
            first = None
        at += len(line) + 1
    return out


def match_rules(found: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(licence, first code point) of the rules that hold, in text order.  Each sentence serves one rule;
    longer rules come first, and of one rule the earliest match.  A rule's next sentence is the nearest
    unused one of its identifier, with at most ``GAP`` other sentences between.  A sentence whose identifier
    ends in 'notice', 'title' or 'spdx' is a rule by itself.

    Places of an identifier are found by bisection, so time goes with the number of sentences."""
    places: dict[str, list[int]] = {}
    for k, (_, _, name) in enumerate(found):
        places.setdefault(name, []).append(k)
    used = [False] * len(found)
    after = {name: list(range(len(p) + 1)) for name, p in places.items()}  # per identifier, the next unused

    def unused(name: str, j: int) -> int:
        """The first unused of an identifier's places from its j-th on, halving the way for later searches."""
        next_ = after[name]
        while next_[j] != j:
            next_[j] = next_[next_[j]]
            j = next_[j]
        return j

    out = []
    for licence, wanted in sorted(RULES, key=lambda r: -len(r[1])):
        if any(w not in places for w in wanted):
            continue
        j = unused(wanted[0], 0)
        while j < len(places[wanted[0]]):
            chain = [(wanted[0], j)]
            last = places[wanted[0]][j]
            for name in wanted[1:]:
                n = unused(name, bisect_right(places[name], last))
                if n >= len(places[name]) or found[places[name][n]][0] - found[last][0] > GAP + 1:
                    break
                last = places[name][n]
                chain.append((name, n))
            if len(chain) == len(wanted):
                for name, n in chain:
                    used[places[name][n]] = True
                    after[name][n] = n + 1
                out.append((found[places[wanted[0]][j]][1], licence))
            j = unused(wanted[0], j + 1)
    for k, (_, at, name) in enumerate(found):
        if not used[k] and name.endswith((" notice", " title", " spdx")):
            out.append((at, name.rsplit(" ", 1)[0]))
    return [(name, at) for at, name in sorted(out, key=lambda x: x[0])]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, licenses, sentence_ids, first_at, n_sentences) of every row.

    ``licenses`` has the distinct licences in order of their first place, joined by commas, and
    ``sentence_ids`` the known sentences in text order; both are empty without any.  ``first_at`` is the
    code point where the first licence begins, null without one.  ``n_sentences`` counts the known
    sentences.  Null text is as empty.  Whole texts are scanned; rows are neither dropped nor merged;
    further columns aren't looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, first, number = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = identify_sentences(text) if text and _HINT.search(text) else []
                held = match_rules(found) if found else []
                names.append(",".join(dict.fromkeys(k for k, _ in held)))
                ids.append(",".join(k for _, _, k in found))
                first.append(held[0][1] if held else None)
                number.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(first, pa.int64()), pa.array(number, pa.int64())], ["id", "licenses", "sentence_ids", "first_at", "n_sentences"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, licenses string, sentence_ids string, first_at long, n_sentences long")
    return out.withColumnRenamed("id", id_col)
