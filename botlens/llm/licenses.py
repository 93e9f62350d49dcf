"""Licence scan: passages compared to licence templates by Dice over word bigrams.

A passage is a window of words, or a run of consecutive lines.  Dice of two bigram multisets is at
least t only if the smaller holds t / (2 - t) of the larger, so a passage is
compared only with templates within these size bounds, and only if it holds a
bigram of some template.  A scan is a map over whole texts; the templates are a
short fixed list.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8            # Dice from which a passage carries a licence

# wording that several licences share
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
         "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
         "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
         "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
AUTHOR = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
          "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
          "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
          "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
          "PERFORMANCE OF THIS SOFTWARE.")
REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                  "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                  "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                  "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                  "other materials provided with the distribution. ")
HOLDERS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
           "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
           "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
           "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
           "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
           "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
           "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# (SPDX name, title, (version, version as written, date of the text))
GNU = [("GPL", "GNU General Public License", (("1.0", "1", "February 1989"), ("2.0", "2", "June 1991"), ("3.0", "3", "29 June 2007"))),
       ("LGPL", "GNU Library General Public License", (("2.0", "2", "June 1991"),)),
       ("LGPL", "GNU Lesser General Public License", (("2.1", "2.1", "February 1999"), ("3.0", "3", "29 June 2007"))),
       ("AGPL", "GNU Affero General Public License", (("3.0", "3", "19 November 2007"),))]
GNU_NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published "
              "by the Free Software Foundation, either version {how} of the License, or (at your option) any later version. ",
              "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
              "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. You should have "
              "received a copy of the {title} along with this program. If not, see http://www.gnu.org/licenses/.")
NAMED = [("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
         ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("MPL-2.0", "Mozilla Public License, Version 2.0"),
         ("EPL-1.0", "Eclipse Public License, Version 1.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"),
         ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0")]
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
           ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]

# fixed values: public licence notices and short licence texts
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
            "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
            "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
            "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
            "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
              "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
              "Software, and to permit persons to whom the Software is furnished to do so. " + AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. " + AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted. " + AUTHOR),
    ("BSD-2-Clause", REDISTRIBUTION + HOLDERS),
    ("BSD-3-Clause", REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be "
                     "used to endorse or promote products derived from this software without specific prior written "
                     "permission. " + HOLDERS),
    ("BSD-4-Clause", REDISTRIBUTION + "3. All advertising materials mentioning features or use of this software must display "
                     "the following acknowledgement: This product includes software developed by the organization. 4. Neither "
                     "the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission. " + HOLDERS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
             "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
             "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
             "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
             "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
             "altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
                "use this file except in compliance with the License. You may obtain a copy of the License at "
                "http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the "
                "Eclipse Public License v1.0 which accompanies this distribution, and is available at "
                "http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *[(f"{short}-{version}", text) for short, title, versions in GNU for version, how, date in versions for text in (
        f"This work is licensed under the {title}, version {how}.", f"Licensed under the {title}, version {how}.",
        f"{title} Version {how}, {date}",
        *(lead.format(title=title, how=how) + rest.format(title=title)
          for lead, rest in (GNU_NOTICE, (GNU_NOTICE[0], ""))))],
    *[(name, f"{verb} under the {title}") for name, title in NAMED for verb in ("Licensed", "Released", "Distributed")],
    *[(f"CC-{kind}-{version}", text) for kind, title in COMMONS for version in ("1.0", "2.0", "2.5", "3.0", "4.0") for text in (
        f"Licensed under CC {kind} {version}.",
        f"This work is licensed under a Creative Commons {title} {version} International License.",
        f"Creative Commons {title} {version} International Public License")],
]

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalised(text: str) -> list[str]:
    """Lower-cased words; punctuation goes, version numbers stay whole."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    size = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / size if size else 0.0


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.entries = [(name, bigrams(normalised(text))) for name, text in templates]
        self.known = {g for _, grams in self.entries for g in grams}
        self.words = {w for g in self.known for w in g}
        reach = least / (2 - least)
        self.bounds = [(reach * sum(g.values()), sum(g.values()) / reach) for _, g in self.entries]
        self.holders: dict[tuple, list[int]] = {}
        for i, (_, grams) in enumerate(self.entries):
            for gram in grams:
                self.holders.setdefault(gram, []).append(i)
        self.versions = []                     # words for the version of each template that has such a word
        for name, grams in self.entries:
            number = "".join(re.findall(r"-(\d+\.\d+)$", name))
            self.versions.append({x for n in (number, number.removesuffix(".0")) for x in (n, f"v{n}")}
                                 & {w for gram in grams for w in gram})
        self.most = max((high for _, high in self.bounds), default=0)

    def best(self, words: list[str]) -> list[tuple[float, str]]:
        """(dice, licence) of every template that the words match."""
        size = len(words) - 1
        fits = [i for i, (low, high) in enumerate(self.bounds) if low <= size <= high]
        if not fits:
            return []
        grams = bigrams(words)
        found = ((dice(grams, self.entries[i][1]), self.entries[i][0]) for i in fits)
        return [x for x in found if x[0] >= self.least]

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(first line, line after the last, licence, dice) of each passage that matches.

        Runs start and end at lines that hold a bigram of a template (with the
        word before the line, so bigrams over a line's end count).  Of
        overlapping matches the best stays, then the shortest, then the first.
        """
        if not text:
            return []
        lines, marked, last = [], [], ""
        for i, line in enumerate(text.split("\n")):
            words = normalised(line)
            lines.append(words)
            if any((a, b) in self.known for a, b in zip([last, *words], words)):
                marked.append(i)
            last = words[-1] if words else last
        if not marked:
            return []
        found = []
        for first in marked:
            for start in (first, first - 1):          # the bigram's first word may end the line before
                if start < 0:
                    continue
                run: list[str] = []
                for stop in range(start, len(lines)):
                    run += lines[stop]
                    if len(run) - 1 > self.most:
                        break
                    if lines[stop]:
                        found += [(-d, stop - start, start, stop + 1, name) for d, name in self.best(run)]
        out: list[tuple[int, int, str, float]] = []
        taken: set[int] = set()
        for d, _, start, stop, name in sorted(set(found)):
            if taken.isdisjoint(range(start, stop)):
                taken.update(range(start, stop))
                out.append((start, stop, name, -d))
        return sorted(out)

    def windows(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, licence, dice) of each word window that matches, wherever lines end.

        Of overlapping matches the best stays, then the longest, then the first.  A
        window without the version that its template has gives the licence without one.
        """
        words = normalised(text) if text else []
        grams = list(zip(words, words[1:]))
        hits: dict[int, list[int]] = {}                  # template -> places of its bigrams
        for at, gram in enumerate(grams):
            for i in self.holders.get(gram, ()):
                hits.setdefault(i, []).append(at)
        queue: list[tuple] = []                          # windows, and starts with a bound for theirs
        for i, places in hits.items():
            queue += self.starts(i, grams, places)
        heapq.heapify(queue)
        out: list[tuple[int, int, str, float]] = []
        taken: set[int] = set()
        left: dict[tuple, list[tuple]] = {}              # (start, template) -> its windows not in the queue, best last
        while queue:
            worse, short, start, stop, name, i, k = heapq.heappop(queue)
            if start in taken:
                continue
            if i >= 0:
                left[start, -1 - i] = sorted(self.from_start(i, grams, hits[i], k), reverse=True)
                i = -1 - i
            elif taken.isdisjoint(range(start, stop)):
                taken.update(range(start, stop))
                version = self.versions[-1 - i]
                if version and version.isdisjoint(words[start:stop]):
                    name = name.rsplit("-", 1)[0]
                out.append((start, stop, name, -worse))
            if start not in taken and left[start, i]:    # only the best window of a start waits
                heapq.heappush(queue, left[start, i].pop())
        return sorted(out)

    def starts(self, i: int, grams: list, places: list[int]):
        """The places where a window of the template can start, with the Dice it can reach at most."""
        _, template = self.entries[i]
        size = sum(template.values())
        low, high = self.bounds[i]
        if len(places) < low - 1e-9:
            return
        inside: Counter = Counter()
        shared = after = 0
        for k, start in enumerate(places):
            while after < len(places) and places[after] - start + 1 <= high + 1e-9:
                gram = grams[places[after]]
                inside[gram] += 1
                shared += inside[gram] <= template[gram]
                after += 1
            if shared >= low - 1e-9:
                yield -2 * shared / (size + shared), float("-inf"), start, 0, "", i, k
            gram = grams[start]
            shared -= inside[gram] <= template[gram]
            inside[gram] -= 1

    def from_start(self, i: int, grams: list, places: list[int], k: int):
        name, template = self.entries[i]
        size = sum(template.values())
        start, high = places[k], self.bounds[i][1]
        inside: Counter = Counter()
        shared = 0
        for place in places[k:]:
            length = place - start + 1
            if length > high + 1e-9:
                break
            gram = grams[place]
            inside[gram] += 1
            if inside[gram] <= template[gram]:
                shared += 1
                d = 2 * shared / (size + length)
                if d >= self.least:
                    yield -d, -length, start, place + 2, name, -1 - i, 0


def find(text: Column, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, lines: bool = True) -> Column:
    """Matches of a text as array<struct<first, after, licence, dice>>; null and empty: none.

    Passages are runs of whole lines (numbered from 0) or, without ``lines``, any words.
    """
    @F.pandas_udf("array<struct<first long, after long, licence string, dice double>>")
    def run(texts: pd.Series) -> pd.Series:
        known = Templates(templates, least)
        search = known.scan if lines else known.windows
        return pd.Series([[{"first": a, "after": b, "licence": n, "dice": d} for a, b, n, d in search(t)]
                          for t in texts], dtype=object)

    return run(text)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, lines: bool = True) -> DataFrame:
    """doc_id and matches of every row; rows that repeat are scanned each, an empty table gives an empty result."""
    return docs.select("doc_id", find(F.col("text"), templates, least, lines).alias("matches"))
