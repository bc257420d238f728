"""Licence texts and notices found by Dice's coefficient over word bigrams."""

from bisect import bisect
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published licence texts and the notices that refer to them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
SIMILARITY = 0.8
# Characters other than these end a word. ASCII only, so that every engine agrees.
NOT_WORD = r"[^a-z0-9.]+"
OUT = "line long, n_lines long, licence string, dice double, n_bigrams long"


def words(text: str) -> list[str]:
    """Words of a text as they are compared: ASCII lower case, letters, digits, inner dots."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower()
    return [w for w in (part.strip(".") for part in re.split(NOT_WORD, lowered)) if w]


def bigrams(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:], strict=False))


def windows(
    tokens: list[str], known: Mapping[str, set[tuple[str, str]]], anything: frozenset, similarity: float
) -> list[tuple[int, int, str, float, int]]:
    """``first, last, licence, dice, n_bigrams`` of runs of words that are alike to a template.

    The bigrams at the ends of the best run for a template are the template's, and its
    first occurs once in it, as a run without them is at least as alike. So a run starts
    at each such bigram and goes on until that occurs again or the run holds more bigrams
    than fit. Of runs that overlap, the one sharing most bigrams with its template stays,
    then the most alike, then the first by name.
    """
    pairs = list(zip(tokens, tokens[1:], strict=False))
    hits = [at for at, pair in enumerate(pairs) if pair in anything]
    own = {pairs[at] for at in hits}
    ratio = similarity / (2 - similarity)
    runs = []
    for name, template in known.items():
        if len(own & template) < len(template) * ratio - 1e-9:
            continue
        most = len(template) / ratio + 1e-9
        for start in hits:
            if pairs[start] not in template:
                continue
            seen, shared, top = set(), 0, None
            for at in range(start, len(pairs)):
                pair = pairs[at]
                if pair in seen:
                    if pair == pairs[start]:
                        break
                    continue
                seen.add(pair)
                if len(seen) > most:
                    break
                if pair in template:
                    shared += 1
                    dice = 2 * shared / (len(seen) + len(template))
                    if dice >= similarity and (top is None or dice > top[1]):
                        top = (shared, dice, at + 1, len(seen))
                    if shared == len(template):
                        break
            if top:
                runs.append((-top[0], -top[1], name, start, top[2], top[3]))
    chosen: list[tuple[int, int, str, float, int]] = []
    taken: list[tuple[int, int]] = []
    for _, less, name, first, last, size in sorted(runs):
        at = bisect(taken, (first, last))
        if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
            continue
        taken.insert(at, (first, last))
        chosen.append((first, last, name, -less, size))
    return sorted(chosen)


def licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``id, line, n_lines, licence, dice, n_bigrams`` of every part of a text that is a licence.

    The parts of a text are its lines, its paragraphs (lines up to an empty one) where
    they have several lines, the whole where it has several paragraphs, and all runs of
    words, inside a line or across lines and empty lines (see ``windows``). A run is given
    by the lines it lies in, unless one of the other parts around it is given for the same
    licence; they are looked for unless ``similarity`` is below ``SIMILARITY``, where runs
    with free ends are alike to anything. A part and a
    template are alike when Dice's coefficient of their sets of word bigrams is at least
    ``similarity``. It is at most ``2 min / (sum)`` of the set sizes, so a template is
    compared only with parts of fitting size, and a part that fits no template's size
    is not looked at further. The best template is given, the first by name of equals.

    The templates are a parameter and go to the tasks with the code; the texts are read
    once and not shuffled. Null and empty texts have no parts. A row repeated gives its
    matches again. Other columns are left out.
    """
    known = {name: bigrams(words(text)) for name, text in sorted(templates.items())}
    known = {name: pairs for name, pairs in known.items() if pairs}
    anything = frozenset(pair for pairs in known.values() for pair in pairs)
    ratio = similarity / (2 - similarity)
    sizes = [len(pairs) for pairs in known.values()]
    least = min(sizes, default=1) * ratio
    runs = similarity >= SIMILARITY
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType

    def best(pairs: set) -> tuple[str, float] | None:
        shared = pairs & anything
        if len(shared) < least * ratio or not shared:
            return None
        found = None
        for name, template in known.items():
            small, large = sorted((len(pairs), len(template)))
            if small < large * ratio - 1e-9:
                continue
            dice = 2 * len(shared & template) / (small + large)
            if dice >= similarity and (found is None or dice > found[1]):
                found = (name, dice)
        return found

    def parts(lines: list[list[str]]) -> Iterator[tuple[int, int, list[list[str]]]]:
        for number, tokens in enumerate(lines):
            yield number, 1, [tokens]
        starts, paragraphs = 0, 0
        for end in range(len(lines) + 1):
            if end == len(lines) or not lines[end]:
                if end > starts:
                    paragraphs += 1
                    if end > starts + 1:
                        yield starts, end - starts, lines[starts:end]
                starts = end + 1
        if paragraphs > 1:
            yield 0, len(lines), lines

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            for row, text in enumerate(batch["text"].to_pylist()):
                lines = [words(line) for line in text.split("\n")]
                given = []
                for line, n_lines, tokens in parts(lines):
                    flat = tokens[0] if len(tokens) == 1 else [w for t in tokens for w in t]
                    if len(flat) <= least:
                        continue
                    pairs = bigrams(flat)
                    found = best(pairs)
                    if found:
                        given.append((line, line + n_lines, found[0]))
                        rows.append((row, line, n_lines, *found, len(pairs)))
                if not runs:
                    continue
                of_word = [number for number, tokens in enumerate(lines) for _ in tokens]
                every = [w for tokens in lines for w in tokens]
                for first, last, name, dice, size in windows(every, known, anything, similarity):
                    line, end = of_word[first], of_word[last] + 1
                    if not any(a < end and line < b and name == other for a, b, other in given):
                        rows.append((row, line, end - line, name, dice, size))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            ids = batch["id"].take(pa.array(columns[0], pa.int64()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
            arrays = [ids, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["id", "line", "n_lines", "licence", "dice", "n_bigrams"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.where("text is not null").mapInArrow(scan, f"id {id_type.simpleString()}, {OUT}")
