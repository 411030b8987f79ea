"""Licence scans by sentence rules.

A text's sentences are normalised and looked up among known licence sentences; the identifiers found, in order, are matched
against ordered rules, the longest first. Sentences that are not known neither match nor break a sequence, as licence
texts stand among other text. An identifier belongs to one match at most. A known sentence may have a slot, written in angle
brackets, for a name of one to SLOT_WORDS words: the owner in BSD's third clause, the program in a GPL notice. Parts of a
rule may be optional. A licence line by identifier names each licence of its expression (an exception that is no part of a
known licence is left out). Notices (NOTICES: "All rights reserved") are identifiers but belong to no rule, as they stand
beside licences and alone grant or forbid nothing.

Sentence ends and blank lines cut. Single newlines and the blanks after semicolons, colons and abbreviations may cut or not: a known sentence begins
and ends at any of these places and may run over several, so wrapped texts are found, and so are notices on a line of their
own. Of known sentences that begin at one place the longest counts. Comment marks stand for nothing, in blank lines too.

Defined cases: a null text counts as empty; a text without known sentences has no licence ('' and 0). Repeated sentences
repeat their identifier; each licence is named once, in order of its first match. Texts of any length are read whole. Extra
columns of any name are ignored; rows are neither dropped nor merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import python_batches

#: Abbreviations whose stop need not end a sentence.
SHORT = ("v", "ver", "vers", "no", "inc", "ltd", "co", "corp", "e.g", "i.e")
_NOT_SHORT = "".join(rf"(?<!\b{re.escape(s)}\.)" for s in SHORT)
SENTENCE_END = re.compile(rf"\n(?:(?:[^\w\n]|_)*\n)+|(?<=[.!?]){_NOT_SHORT}\s+", re.I)
MAY_END = re.compile(r"\n|(?<=[;:])[^\S\n]+|" + "|".join(rf"(?<=\b{re.escape(s)}\.)[^\S\n]+" for s in SHORT), re.I)
#: Comment and list marks at the start of a line, with the blanks before and after.
MARK = re.compile(r"^(?:[^\w\n.]|\.\\\")+(?:(?:[Rr][Ee][Mm]|dnl|C)(?!\S)|(?:\d{1,2}|[a-z]|[ivx]+)\)(?=\s))?|^(?:(?:[Rr][Ee][Mm]|dnl|C)(?!\S)|(?:\d{1,2}|[a-z]|[ivx]+)\)(?=\s))", re.M)
WORD = re.compile(r"[a-z0-9]+(?:[.\-'’][a-z0-9]+)*")

#: Known licence sentences by identifier.
SENTENCES = {
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit-notice": ["Released under the MIT License", "This project is licensed under the MIT License", "Licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "gpl-free": ["This program is free software", "<program> is free software"],
    "gpl3-program": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl3-only": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "<program> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-howto": ["How to Apply These Terms to Your New Programs", "How to Apply These Terms to Your New Libraries"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "mpl2-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd-endorse": ["Neither the name of <owner> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of <owner> nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the names of <owner> nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of <owner> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of <owner> may not be used to endorse or promote products derived from this software without specific prior written permission", "The names of the contributors may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ads": ["All advertising materials mentioning features or use of this software must display the following acknowledgement", "All advertising materials mentioning features or use of this software must display the following acknowledgment"],
    "bsd-asis": ["THIS SOFTWARE IS PROVIDED BY <owner> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd3-notice": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "This project is licensed under the BSD 3-Clause License"],
    "bsd2-notice": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "This project is licensed under the BSD 2-Clause License"],
    "bsd-style": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-free": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "isc-notice": ["Licensed under the ISC License", "Released under the ISC License"],
    "mit-holders": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "gpl-program": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-only": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "gpl2-notice": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "Licensed under the GPL-2"],
    "lgpl21-program": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-program": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-library": ["This library is free software"],
    "lgpl3-notice": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-program": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-notice": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "epl1-notice": ["which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "cddl-notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl-do": ["You just DO WHAT THE FUCK YOU WANT TO"],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc0-notice": ["Licensed under CC0 1.0", "This work is licensed under CC0 1.0", "This work is licensed under CC0 1.0 Universal"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "artistic2-notice": ["Licensed under the Artistic License 2.0", "This program is distributed under the Artistic License 2.0"],
    "eupl-notice": ["Licensed under the EUPL, Version 1.2 or later", "Licensed under the EUPL-1.2", "Licensed under the European Union Public Licence 1.2"],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "blueoak-notice": ["Licensed under the Blue Oak Model License 1.0.0"],
    "upl-notice": ["Licensed under the Universal Permissive License v 1.0"],
    "mspl-notice": ["Licensed under the Microsoft Public License (MS-PL)"],
    "ncsa-notice": ["Distributed under the University of Illinois Open Source License", "This file is distributed under the University of Illinois Open Source License"],
    "llvm-notice": ["Part of the LLVM Project, under the Apache License v2.0 with LLVM Exceptions"],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "apache11": ["This product includes software developed by the Apache Software Foundation"],
    "proprietary": ["Proprietary and confidential", "Unauthorized copying of this file, via any medium is strictly prohibited"],
    "mpl11-notice": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: Sentences that stand beside licences and are none.
NOTICES = {"rights-notice": ["All rights reserved"]}


def ordered(licence: str, *identifiers: str) -> list[tuple[str, tuple[str, ...]]]:
    """The rules of a sequence in which identifiers that end in a question mark may be missing."""
    found: list[tuple[str, ...]] = [()]
    for k in identifiers:
        found = [x + (k.rstrip("?"),) for x in found] + (found if k.endswith("?") else [])
    return [(licence, x) for x in found if x]


#: Ordered rules: licence and its identifiers in order; of rules that match at one place the longest wins, then the first.
RULES = (
    *ordered("Apache-2.0", "apache-notice", "apache-comply?", "apache-copy?", "apache-asis?"),
    *ordered("Apache-2.0", "apache-title", "apache-terms?", "apache-notice?", "apache-comply?", "apache-copy?", "apache-asis?"),
    *ordered("MIT", "mit-grant", "mit-condition", "mit-asis?", "mit-holders?"),
    *ordered("MIT", "mit-notice", "mit-grant", "mit-condition", "mit-asis?", "mit-holders?"),
    *ordered("BSD-4-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-endorse", "bsd-asis?"),
    *ordered("BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis?"),
    *ordered("BSD-2-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-asis?"),
    *ordered("ISC", "isc-grant", "isc-asis?"),
    ("0BSD", ("isc-free", "isc-asis")),
    ("MIT-0", ("mit0-grant", "mit-asis")),
    *ordered("GPL-3.0-or-later", "gpl-free?", "gpl3-program", "gpl-hope?"),
    *ordered("GPL-3.0-only", "gpl-free?", "gpl3-only", "gpl-hope?"),
    *ordered("GPL-2.0-or-later", "gpl-free?", "gpl-program", "gpl-hope?"),
    *ordered("GPL-2.0-only", "gpl-free?", "gpl2-only", "gpl-hope?"),
    # whole licence files end with the notice that they propose
    *ordered("GPL-3.0-only", "gpl3-title", "gpl-howto?", "gpl-free?", "gpl3-program?", "gpl-hope?"),
    *ordered("GPL-2.0-only", "gpl2-title", "gpl-howto?", "gpl-free?", "gpl-program?", "gpl-hope?"),
    *ordered("LGPL-2.1-only", "lgpl21-title", "gpl-howto?", "lgpl-library?", "lgpl21-program?"),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    *ordered("AGPL-3.0-only", "agpl3-title", "gpl-howto?", "gpl-free?", "agpl3-program?", "gpl-hope?"),
    *ordered("MPL-2.0", "mpl2-title", "mpl2-notice?"),
    *ordered("LGPL-2.1-or-later", "gpl-free?", "lgpl21-program"),
    ("LGPL-2.1-or-later", ("lgpl-library", "lgpl21-program")),
    *ordered("LGPL-3.0-or-later", "gpl-free?", "lgpl3-program", "gpl-hope?"),
    ("LGPL-3.0-or-later", ("lgpl-library", "lgpl3-program")),
    *ordered("AGPL-3.0-or-later", "gpl-free?", "agpl3-program", "gpl-hope?"),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin")),
    ("WTFPL", ("wtfpl", "wtfpl-do")),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("wtfpl",)),
    *(
        (licence, (identifier,))
        for licence, identifier in (
            ("BSD-3-Clause", "bsd3-notice"),
            ("BSD-2-Clause", "bsd2-notice"),
            ("BSD-3-Clause", "bsd-style"),
            ("ISC", "isc-notice"),
            ("GPL-2.0-only", "gpl2-notice"),
            ("LGPL-3.0-only", "lgpl3-notice"),
            ("AGPL-3.0-only", "agpl3-notice"),
            ("BSL-1.0", "boost-notice"),
            ("BSL-1.0", "boost-grant"),
            ("EPL-1.0", "epl1-notice"),
            ("EPL-2.0", "epl2-notice"),
            ("CDDL-1.0", "cddl-notice"),
            ("CC0-1.0", "cc0"),
            ("CC0-1.0", "cc0-notice"),
            ("CC-BY-SA-4.0", "cc-by-sa"),
            ("CC-BY-ND-4.0", "cc-by-nd"),
            ("CC-BY-NC-SA-4.0", "cc-by-nc-sa"),
            ("CC-BY-NC-ND-4.0", "cc-by-nc-nd"),
            ("PostgreSQL", "postgresql-grant"),
            ("Artistic-2.0", "artistic2-notice"),
            ("EUPL-1.2", "eupl-notice"),
            ("OFL-1.1", "ofl-notice"),
            ("BlueOak-1.0.0", "blueoak-notice"),
            ("UPL-1.0", "upl-notice"),
            ("MS-PL", "mspl-notice"),
            ("NCSA", "ncsa-notice"),
            ("Apache-2.0 WITH LLVM-exception", "llvm-notice"),
            ("Apache-1.1", "apache11"),
            ("MPL-1.1", "mpl11-notice"),
            ("proprietary", "proprietary"),
        )
    ),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("MPL-2.0", ("mpl2-notice",)),
)


#: Short identifiers of licences, and of licence and rest of an expression, that stand for longer ones.
OLDER = {f"{x}-{v}": f"{x}-{v}-only" for x in ("GPL", "LGPL", "AGPL") for v in ("2.0", "2.1", "3.0")}
_TERM = r"\(*[\w.+-]*[\w+]\)*"
SPDX = re.compile(rf"\bSPDX-License-Identifier:?[^\S\n]+({_TERM}(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+{_TERM})*)", re.I)
NAMES = {name.lower(): name for name, _ in RULES if name != "proprietary"}


def named(expression: str) -> list[str]:
    """The known licences of an identifier expression, in order."""
    out = []
    for x in re.split(r"\s+(?:and|or)\s+", re.sub("[()]", "", expression), flags=re.I):
        x = " ".join(x.split())
        x = x if x.lower() in NAMES else re.split(r"\s", x, maxsplit=1)[0]
        later = x.endswith("+")
        x = x.rstrip("+")
        x = next((v for k, v in OLDER.items() if k.lower() == x.lower()), x)
        x = x.replace("-only", "-or-later") if later else x
        if x.lower() in NAMES:
            out.append(NAMES[x.lower()])
    return out


def apart(m: re.Match) -> str:
    """An identifier line as one sentence for each licence; as it is if it is one that ends its line, and so may go on in the next."""
    found = named(m.group(1))
    if not found or found == [m.group(1)] and re.compile(r"[^\w\n]*(?:(?:AND|OR|WITH)\b[^\w\n]*)?(?:\n|$)").match(m.string, m.end()):
        return m.group()
    return "".join(f"\n\nSPDX-License-Identifier: {x}\n\n" for x in found)


#: Words that a slot takes at most.
SLOT_WORDS = 12
SLOT = re.compile(r"<[a-z]+>")
RULES += tuple((name, ("spdx-" + name.lower().replace(" ", "-"),)) for name in NAMES.values())
SENTENCES |= {"spdx-" + k.replace(" ", "-"): [f"SPDX-License-Identifier: {name}"] for k, name in NAMES.items()}


def normalised(sentence: str) -> str:
    return " ".join(WORD.findall(sentence.lower()))


class Slotted:
    """A known sentence with a slot: what stands before and after, and the words it takes at most."""

    def __init__(self, sentence: str, identifier: str):
        self.before, self.after = map(normalised, SLOT.split(sentence))
        self.identifier, self.most = identifier, len(self.before.split()) + SLOT_WORDS + len(self.after.split())

    def may_begin(self, s: str) -> bool:
        return self.before.startswith(s) or s.startswith(self.before)

    def fits(self, s: str, n: int) -> bool:
        inner = len(s) - len(self.before) - len(self.after)
        return n <= self.most and inner > 1 and s.startswith(self.before) and s.endswith(" " + self.after if self.after else "")


class Scanner:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: tuple = RULES, notices: dict[str, list[str]] = NOTICES):
        every = [(k, s) for k, many in [*sentences.items(), *notices.items()] for s in many]
        self.notices = set(notices)
        self.known = {normalised(s): k for k, s in every if not SLOT.search(s)}
        self.slots = [Slotted(s, k) for k, s in every if SLOT.search(s)]
        self.first = {s.split()[0] for s in self.known} | {t.before.split()[0] for t in self.slots if t.before}
        self.first |= {w[: m.start()] for w in self.first for m in re.finditer("-", w)}  # lines may be cut at a hyphen
        self.prefixes = {" ".join(w[:n]) for w in map(str.split, self.known) for n in range(1, len(w))}
        # each known sentence has one of these
        self.rare = {max(re.findall("[a-z0-9]+", s), key=len) for s in [*self.known, *(max(t.before, t.after, key=len) for t in self.slots)]}
        self.leading = {max(re.findall("[a-z0-9]+", t.after), key=len) for t in self.slots if not t.before}
        self.rules = sorted(rules, key=lambda r: -len(r[1]))

    def identifiers(self, text: str | None) -> list[str]:
        out = []
        low = (text or "").lower()
        if not any(r in low for r in self.rare):
            return out
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "spdx-license-identifier" in low:
            text = SPDX.sub(apart, text)
        lead = any(r in low for r in self.leading)
        for s in SENTENCE_END.split(MARK.sub("", text)):
            parts, at = MAY_END.split(s.lower()), 0
            while at < len(parts):
                m = WORD.search(parts[at])
                k, n = self.longest(parts, at) if m and (lead or m.group() in self.first) else (None, 1)  # few sentences begin like a known one
                if k:
                    out.append(k)
                at += n
        return out

    def longest(self, parts: list[str], at: int) -> tuple[str | None, int]:
        """The longest known sentence made of whole parts from ``at`` on, and its number of parts; None and 1 if there is none."""
        found, words, hyphen = (None, 1), [], False
        for i in range(at, len(parts)):
            more = WORD.findall(parts[i])
            if hyphen and more:  # the line before was cut at a hyphen
                words[-1] += "-" + more.pop(0)
            words += more
            hyphen = bool(words) and re.search(r"\w-\s*$", parts[i]) is not None
            s = " ".join(words)
            if s in self.known:
                found = self.known[s], i - at + 1
            open_slots = [t for t in self.slots if len(words) <= t.most and t.may_begin(s)]
            fit = next((t for t in open_slots if t.fits(s, len(words))), None)
            if fit and s not in self.known:
                found = fit.identifier, i - at + 1
            if s not in self.prefixes and not open_slots and not (hyphen and any(p.startswith(s + "-") for p in self.known)):
                break
        return found

    def licences(self, ids: list[str]) -> list[tuple[str, int, int]]:
        """(licence, first identifier, number of identifiers) of each match, left to right."""
        out, at, every = [], 0, ids
        place = [i for i, k in enumerate(every) if k not in self.notices]
        ids = [every[i] for i in place]
        while at < len(ids):
            for name, want in self.rules:
                if tuple(ids[at : at + len(want)]) == want:
                    out.append((name, place[at], len(want)))
                    at += len(want)
                    break
            else:
                at += 1
        return out


def scanned(docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_known, n_matches, licences (comma-joined), identifiers (comma-joined) for every row."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(sentences, rules)
        for b in batches:
            ids = [scan.identifiers(t.as_py()) for t in b.column("text")]
            found = [scan.licences(x) for x in ids]
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(dict.fromkeys(m[0] for m in x)) for x in found], pa.string()),
                    pa.array([",".join(x) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_known", "n_matches", "licences", "identifiers"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_known long, n_matches long, licences string, identifiers string")
