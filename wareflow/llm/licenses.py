"""Licences named or quoted in texts, by sentence rules.

Method. A text is cut into fragments at line ends and after sentence ends. Normalised sentences that
start and end at fragment borders are mapped to the identifiers of known licence sentences; line ends
inside a sentence don't matter. The document's sequence of identifiers is then matched against ordered
rules: a rule names a licence and the identifiers that make it up, in order, with at most `gap` other
fragments between two of them. Longer rules win, then earlier places; a sentence serves one match.

Normalising lower-cases A-Z and keeps runs of letters and digits.

Defined results
* null or empty text: no licence. null ids and repeated rows: each row is reported.
* Ties between rules of one length go to the rule that is listed first.
* A sentence that no rule uses names no licence. An empty table gives an empty result.
* Other columns are not read. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from wareflow.llm.rows import map_texts, texts_of

# Sentences of public licences and notices.
SENTENCES = {
    "apache-2.0-name": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "apache-2.0-grant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-name": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl-3.0-name": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-2.0-name": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl-free": ["This program is free software:", "This program is free software;"],
    "gpl-3.0-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2.0-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "mpl-2.0-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0-name": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0-name": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0-name": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "unlicense-release": ["This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved."],
}

# Licences and the sentences that make them up, in order.
RULES = [
    ("Apache-2.0", ["apache-2.0-grant", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3.0-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2.0-terms"]),
    ("Apache-2.0", ["apache-2.0-grant"]),
    ("Apache-2.0", ["apache-2.0-name"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-name"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0", ["gpl-3.0-name"]),
    ("GPL-2.0", ["gpl-2.0-name"]),
    ("MPL-2.0", ["mpl-2.0-name"]),
    ("CC-BY-4.0", ["cc-by-4.0-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-name"]),
    ("Unlicense", ["unlicense-release"]),
    ("all-rights-reserved", ["reserved"]),
]

#: Words that a slot may hold, and those of a notice's subject.
SLOT, SUBJECT = 16, 10

_MIT_GRANT = SENTENCES["mit-grant"][0].removesuffix(", subject to the following conditions:")
SENTENCES["mit-0-grant"] = [_MIT_GRANT + "."]
SENTENCES["bsd-endorse"] += [
    "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of <> nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the name of <> nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Neither the names of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "The name of <> may not be used to endorse or promote products derived from this software without specific prior written permission.",
]
SENTENCES |= {
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "bsl-1.0-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "cc0-waiver": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "To the extent possible under law, <> has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, <> has waived all copyright and related or neighboring rights to <>."],
    "epl-2.0-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <>"],
    "epl-1.0-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at <>"],
}
RULES += [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("MIT-0", ["mit-0-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("EPL-2.0", ["epl-2.0-terms"]),
    ("EPL-1.0", ["epl-1.0-terms"]),
    ("GPL-3.0-or-later", ["gpl-3.0-terms"]),
    ("GPL-2.0-or-later", ["gpl-2.0-terms"]),
]

# Names of licences in notices, without "the". A name that has no word "license" in it
# may be followed by that word.
NAMES = {
    "MIT": ["MIT", "MIT License (MIT)", "MIT X11", "MIT/X11", "MIT (Expat)", "MIT/Expat", "Expat", "MIT open source", "MIT software"],
    "MIT-0": ["MIT-0", "MIT No Attribution"],
    "ISC": ["ISC", "ISC License (ISC)"],
    "0BSD": ["0BSD", "Zero-Clause BSD", "BSD Zero Clause", "BSD 0-Clause"],
    "Zlib": ["zlib", "zlib/libpng"],
    "BSL-1.0": ["BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License v1.0", "Boost Software License", "Boost License 1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License", "Do What The Fuck You Want To Public License, Version 2"],
    "Artistic-2.0": ["Artistic-2.0", "Artistic License 2.0", "Artistic License, Version 2.0"],
    "CC0-1.0": ["CC0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons CC0", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
for _n, _word in ((2, "two"), (3, "three"), (4, "four")):
    NAMES[f"BSD-{_n}-Clause"] = [f"BSD-{_n}-Clause", f"{_n}-Clause BSD", f"{_word}-clause BSD", f"BSD {_word}-clause"]
NAMES["BSD-2-Clause"] += ["Simplified BSD", "BSD 2-Clause \"Simplified\"", "FreeBSD"]
NAMES["BSD-3-Clause"] += ["New BSD", "Modified BSD", "Revised BSD", "BSD 3-Clause \"New\" or \"Revised\"", "BSD (3-Clause)"]


def _versions(version: str) -> list[str]:
    return [f"{how}{v}" for v in dict.fromkeys((version, version.removesuffix(".0"))) for how in ("", "v", "version ", "v. ")]


for _short, _full, _all in (("Apache", ["Apache License", "Apache", "Apache Software License", "Apache Public License", "ASL"], ["2.0", "1.1"]),
                            ("MPL", ["Mozilla Public License", "MPL"], ["2.0", "1.1"]), ("EPL", ["Eclipse Public License", "EPL"], ["2.0", "1.0"]),
                            ("EUPL", ["European Union Public License", "EUPL"], ["1.2", "1.1"]), ("CDDL", ["Common Development and Distribution License", "CDDL"], ["1.0", "1.1"]),
                            ("GPL", ["GNU General Public License", "GNU GPL", "GPL", "General Public License", "GNU General Public License (GPL)"], ["1.0", "2.0", "3.0"]),
                            ("LGPL", ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "Lesser General Public License", "GNU Lesser General Public License (LGPL)"], ["2.0", "2.1", "3.0"]),
                            ("AGPL", ["GNU Affero General Public License", "GNU AGPL", "AGPL", "Affero General Public License", "GNU Affero General Public License (AGPL)"], ["3.0"])):
    for _v in _all:
        _named = [f"{n} {v}" for n in _full for v in _versions(_v)] + [f"{_short}{v}" for v in (f"v{_v}", f"v{_v.removesuffix('.0')}")]
        NAMES[f"{_short}-{_v}"] = _named
        if "GPL" in _short:
            NAMES[f"{_short}-{_v}-or-later"] = [f"{n}{end}" for n in _named for end in (" or later", " or any later version", " or (at your option) any later version", " or newer", " or later version", " of the License, or (at your option) any later version")]
            NAMES[f"{_short}-{_v}-only"] = [f"{n} only" for n in _named]
            _number, _license = _v.removesuffix(".0"), [n for n in _full if n.startswith("GNU") and n.endswith("License")]
            for _kind, _ends in (("or-later", [f"either version {_number} of the License, or (at your option) any later version.", f"either version {_number} of the License, or any later version.", f"version {_number} of the License, or (at your option) any later version.", f"either version {_number}, or (at your option) any later version."]),
                                 ("only", [f"version {_number} of the License.", f"version {_number}.", f"version {_number} only.", f"version {_number} of the License only."])):
                _terms = [f"{do} redistribute it and/or modify it under the terms of the {n} as published by the Free Software Foundation, {e}" for do in ("you can", "you may") for n in _license for e in _ends]
                _nouns = ("program", "library", "software", "file", "package", "module", "code")
                SENTENCES[f"{_short}-{_v}-{_kind}-terms"] = [*_terms, *(f"This {noun} is free software, {t}" for noun in _nouns for t in _terms)]
                RULES.append((f"{_short}-{_v}-{_kind}", [f"{_short}-{_v}-{_kind}-terms"]))
for _short, _full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("4.0", "3.0", "2.5", "2.0"):
        _spelt = dict.fromkeys((_full, _full.replace("ShareAlike", "Share Alike"), _full.replace("NonCommercial", "Non Commercial"), _full.replace("NoDerivatives", "NoDerivs")))
        NAMES[f"CC-{_short}-{_v}"] = [f"{n} {how}{_v}{end}" for n in (f"CC {_short}", f"Creative Commons {_short}", f"Creative Commons CC {_short}", *(f"Creative Commons {x}" for x in _spelt)) for how in ("", "v", "version ") for end in ("", " International", " Unported", " Generic")]

# The parts of notices around names.
_VERBS = ["licensed", "dual licensed", "released", "distributed", "redistributed", "available", "made available", "published", "provided", "covered", "offered", "shared", "open source", "open sourced", "free software"]
_HOW = ["under", "under the", "under a", "under an", "under the terms of", "under the terms of the", "under terms of the", "under the terms and conditions of the", "under the conditions of the", "under either", "under either the", "under both the", "subject to the terms of the", "by the", "under license"]
_ENDS = ["", "see license", "see license file", "see the license", "see the license file", "see license for details", "see the license file for details", "see license file for details", "see license for more information", "see the license file for more information", "see license for the full license text", "see the accompanying license file", "see the file license for details", "unless otherwise noted", "the license"]
_DATES = ["january 2004", "29 june 2007", "june 1991", "february 1999", "february 1989", "19 november 2007"]
_UNLESS = [f"{a} {b}" for a in ("unless otherwise", "except where otherwise", "except as otherwise") for b in ("noted", "stated", "specified", "indicated")]
#: A subject with one of these words says that something is not so, or asks.
_DENIED = frozenset(b"no not none nothing never neither nor if whether unless isn wasn was were would could should".split())
#: Openings that name a licence without a verb.
_LABELS = ["license", "licenses", "license type", "project license", "software license"]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Where a fragment ends: a line end, a sentence end before a blank or at the end of the text, or the
#: mark of a listed point.
_BORDER = re.compile(rb"\n|[.!?;:]+[\"')\]]*(?=\s|$)|(?<=\n)[^0-9a-z\x80-\xff\n]*(?:[0-9]{1,2}|[a-z])\)(?=\s)")
_SPDX = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_SPDX_WORD = re.compile(rb"[()]|[0-9a-z.+:-]+")


def spdx_names(expression: bytes) -> list[str]:
    """The identifiers of an SPDX expression, as written; none if it isn't one."""
    line = re.split(rb"\*/|-->|[\"'`<>{},;#]", expression)[0]
    if _SPDX_WORD.sub(b"", line.lower()).strip():
        line = line.split(b"*")[0]
    words = _SPDX_WORD.findall(line.lower())
    places = [m.span() for m in _SPDX_WORD.finditer(line.lower())]
    if _SPDX_WORD.sub(b"", line.lower()).strip():
        return []
    out, open_, after = [], 0, False
    k = 0
    while k < len(words):
        w = words[k]
        if w == b"(":
            if after:
                return []
            open_ += 1
        elif w == b")":
            if not after or not open_:
                return []
            open_ -= 1
        elif w in (b"and", b"or"):
            if not after:
                return []
            after = False
        elif w == b"with":
            if not after or k + 1 == len(words):
                return []
            k += 1
        else:
            if after:
                return []
            out.append(line[places[k][0] : places[k][1]].decode("ascii").strip(".:"))
            after = True
        k += 1
    usual = {n.lower(): n for n in (*NAMES, *(r for r, _ in RULES))}
    named = [usual.get(n.lower(), n) for n in out if n and n.lower() not in ("none", "noassertion")]
    return named if after and not open_ else []


def normalised(sentence: bytes) -> tuple[bytes, ...]:
    return tuple(b"license" if w == b"licence" else w for w in _WORD.findall(sentence.lower()))


class Phrases:
    """A set of word sequences, each with a value."""

    def __init__(self, phrases: dict[str, str | None]):
        self.known: dict[tuple[bytes, ...], str | None] = {}
        for phrase, value in phrases.items():
            self.known.setdefault(normalised(phrase.encode()), value)
        lengths: dict[bytes, set[int]] = {}
        for words in self.known:
            lengths.setdefault(words[0] if words else b"", set()).add(len(words))
        self.lengths = {w: sorted(ns, reverse=True) for w, ns in lengths.items()}

    def at(self, words: list[bytes], k: int) -> list[tuple[int, str | None]]:
        """(end, value) of each phrase that starts at word k, longest first."""
        if k >= len(words):
            return []
        found = ((k + n, tuple(words[k : k + n])) for n in self.lengths.get(words[k], ()))
        return [(end, self.known[own]) for end, own in found if own in self.known]


class Notices:
    """Sentences that are an opening, names of licences and a usual end."""

    def __init__(self, names: dict[str, list[str]]):
        spelt = {}
        for licence, variants in names.items():
            for v in variants:
                for name in (v, f"{v} license"):
                    spelt.setdefault(name, licence)
        self.names = Phrases(spelt)
        self.verbs = Phrases({f"{v} {h}": None for v in _VERBS for h in _HOW})
        self.ends = Phrases({e.replace("license", f"license{x}", 1): None for e in _ENDS if e for x in ("", " md", " txt")} | {d: None for d in _DATES})
        self.unless, self.labels = Phrases(dict.fromkeys(_UNLESS)), Phrases(dict.fromkeys(_LABELS))

    def _openings(self, words: list[bytes], k: int) -> list[int]:
        """Where a name can start in a sentence that starts at word k."""
        out = [end for end, _ in self.labels.at(words, k)]
        for start in (k, *(end for end, _ in self.unless.at(words, k))):
            out += [end for end, _ in self.verbs.at(words, start)]
            for at in range(start + 1, min(start + SUBJECT + 1, len(words))):
                if words[at - 1] in _DENIED:
                    break
                if words[at] in (b"is", b"are"):
                    also = at + 2 if words[at + 1 : at + 2] in ([b"hereby"], [b"also"], [b"currently"]) else at + 1
                    out += [end for end, _ in self.verbs.at(words, also)]
        return out

    def _listed(self, words: list[bytes], opened: list[int], tails: set[int]) -> tuple[int, list[tuple[int, int, str]]] | None:
        """The longest list of names from one of the words `opened` to a fragment's end."""
        best, seen, todo = None, set(), [(at, None) for at in opened]
        while todo:
            at, before = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for end, licence in self.names.at(words, at):
                own = (before, (at, end, licence))
                for stop in (end, *(e for e, _ in self.ends.at(words, end))):
                    if stop in tails and (best is None or stop > best[0]):
                        best = (stop, own)
                after = end
                while after < len(words) and after - end < 4 and words[after] in (b"and", b"or", b"the", b"under"):
                    after += 1
                if after > end and words[end] in (b"and", b"or"):
                    todo.append((after, own))
        if best is None:
            return None
        names, own = [], best[1]
        while own:
            own, name = own
            names.append(name)
        return best[0], names[::-1]

    def at(self, words: list[bytes], k: int, tails: set[int]) -> tuple[int, list[tuple[int, int, str]]] | None:
        """(end, [(begin, end, licence)]) of a notice that starts at word k; places are of words."""
        best = self._listed(words, self._openings(words, k), tails)
        # a title: nothing but one name, written out
        start = k + 1 if words[k] == b"the" else k
        for end, licence in self.names.at(words, start):
            if b"license" in words[start:end] or words[start : start + 2] == [b"creative", b"commons"]:
                for stop in (end, *(e for e, _ in self.ends.at(words, end))):
                    if stop in tails and (best is None or stop > best[0]):
                        best = (stop, [(k, end, licence)])
        return best


class SentenceRules:
    """Known sentences by their words, the rules over their identifiers, and the names in notices."""

    def __init__(self, sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]], names: dict[str, list[str]] | None = None):
        names = NAMES if names is None else names
        plain, self.slots = {}, {}
        signs = set()
        for name, variants in sentences.items():
            for v in variants:
                parts = [normalised(p.encode()) for p in v.split("<>")]
                signs.add(max(parts[0], key=lambda w: (len(w), w)))
                if len(parts) == 1:
                    plain[v] = name
                else:
                    self.slots.setdefault(parts[0], []).append((parts[1:], name))
        self.known, self.slotted = Phrases(plain), Phrases({" ".join(w.decode() for w in first): None for first in self.slots})
        self.notices = Notices(names) if names else None
        #: A text without any of these words has no known sentence.
        self.signs = sorted(signs | ({b"licen", b"under", b"commons"} if names else set()))
        own = [(licence, [f"={licence}"]) for licence in names]
        self.rules = sorted([*rules, *own], key=lambda r: -len(r[1]))

    def _with_slots(self, words: list[bytes], head: int, tails: set[int]) -> tuple[int, str] | None:
        for at, _ in self.slotted.at(words, head):
            for parts, name in self.slots[tuple(words[head:at])]:
                ends = {at}
                for part in parts:
                    ends = {k + len(part) for e in ends for k in range(e + 1, min(e + SLOT, len(words)) + 1) if tuple(words[k : k + len(part)]) == part}
                stops = [e for e in ends if e in tails]
                if stops:
                    return min(stops), name
        return None

    def sentences(self, text: bytes) -> list[tuple[int, int, str, int, int]]:
        """(first fragment, last fragment, identifier, begin, end) of each known sentence, by place."""
        low = text.lower()
        if not any(sign in low for sign in self.signs):
            return []
        words, places, heads, tails = [], [], [], set()
        begin = 0
        for border in [*_BORDER.finditer(low), None]:
            end = border.end() if border else len(low)
            own = list(_WORD.finditer(low, begin, end))
            if own:
                heads.append(len(words))
                words += [b"license" if m[0] == b"licence" else m[0] for m in own]
                places += [m.span() for m in own]
                tails.add(len(words))
            begin = end
        out, busy = [], 0
        for k, head in enumerate(heads):
            if head < busy:
                continue
            found = next(((stop, name) for stop, name in self.known.at(words, head) if stop in tails), None)
            found = found or self._with_slots(words, head, tails)
            named = self.notices.at(words, head, tails) if self.notices else None
            if named and (not found or named[0] > found[0]):
                busy = named[0]
                # GPLv2+ and the like
                more = [f"{lic}-or-later" if low[places[b - 1][1] : places[b - 1][1] + 1] == b"+" and "GPL" in lic else lic for _, b, lic in named[1]]
                own = [(head if n == 0 else a, b, f"={lic}") for n, ((a, b, _), lic) in enumerate(zip(named[1], more))]
            elif found:
                busy = found[0]
                own = [(head, *found)]
            else:
                continue
            last = bisect_left(heads, busy) - 1
            out += [(k, last, name, places[a][0], places[b - 1][1]) for a, b, name in own]
        return out

    def licences(self, text: bytes, gap: int) -> list[tuple[str, int, int]]:
        """(licence, begin, end) of each match, by place; begin and end are bytes."""
        found = self.sentences(text)
        free, out = [True] * len(found), []
        if self.notices:
            for m in _SPDX.finditer(text.lower()):
                out += [(name, m.start(), m.end()) for name in spdx_names(text[m.start(1) : m.end(1)])]
        present = {f[2] for f in found}
        for licence, wanted in self.rules:
            if not present.issuperset(wanted):
                continue
            for first in range(len(found)):
                chain: list[int] = []
                for k in range(first, len(found)):
                    if chain and found[k][0] - found[chain[-1]][1] - 1 > gap:
                        break
                    if free[k] and found[k][2] == wanted[len(chain)]:
                        chain.append(k)
                        if len(chain) == len(wanted):
                            break
                    elif not chain:
                        break
                if len(chain) == len(wanted):
                    for k in chain:
                        free[k] = False
                    out.append((licence, found[chain[0]][3], found[chain[-1]][4]))
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = 3, names: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, licences (distinct, by place) and matches (licence, begin, end in bytes) of every row."""
    known = SentenceRules(sentences or SENTENCES, rules or RULES, {} if names is None and (sentences or rules) else names)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(part: pa.RecordBatch) -> dict:
        matches = [known.licences(t, gap) for t in texts_of(part.column(text))]
        return {
            "doc_id": part.column("doc_id"),
            "licences": [list(dict.fromkeys(m[0] for m in own)) for own in matches],
            "matches": [[{"licence": m[0], "begin": m[1], "end": m[2]} for m in own] for own in matches],
        }

    schema = f"doc_id {kind}, licences array<string>, matches array<struct<licence:string,begin:long,end:long>>"
    return map_texts(docs.select("doc_id", text), text, find, schema)
