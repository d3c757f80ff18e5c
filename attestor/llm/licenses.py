"""License scans by template-markup matching.

A template is license wording with markup: <<beginOptional>> and
<<endOptional>> round regions that may be absent (they nest), and
<<var;match=".{a,b}">> for a replaceable region of a to b words. Templates are
compiled into one token automaton over words; all wording outside the markup
is mandatory and must be there exactly, word for word. Matching starts at any
word and takes the longest accepted text for each template.

Words are maximal runs of digits, letters a-z after lower-casing A-Z, and
anything above U+007F; what stands between words does not count.

Besides the templates, base phrases are reported wherever their words stand
consecutively.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship_code

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_DISCLAIMER = """the software is provided <<var;match=".{1,3}">> without warranty of any kind express or implied including but
not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
the <<var;match=".{1,8}">> be liable for any claim damages or other liability whether in an action of contract tort or
otherwise arising from out of or in connection with the software or the use or other dealings in the software"""

#: Public license wording by label. Notices first, then texts.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("gpl-3.0", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3 <<beginOptional>>or any later version<<endOptional>>"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<beginOptional>>at your option<<endOptional>> any later version"),
    ("gpl-2.0", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 2 <<beginOptional>>or any later version<<endOptional>>"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or <<beginOptional>>at your option<<endOptional>> any later version"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0 <<beginOptional>>license<<endOptional>>"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0 <<beginOptional>>license<<endOptional>>"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4 0 <<beginOptional>>license<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution 4 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("copyright", 'copyright <<beginOptional>>c<<endOptional>> <<var;match=".{1,12}">> all rights reserved'),
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software {_DISCLAIMER}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>3 neither the name of <<var;match=".{1,16}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>>'),
    ("unlicense", "this is free and unencumbered software released into the public domain <<beginOptional>>anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means<<endOptional>>"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation <<var;match=".{1,20}">> this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details'),
    ("lgpl", 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation <<var;match=".{1,20}">> this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details'),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> <<beginOptional>>www<<endOptional>> mozilla org mpl 2 0"),
    ("bsd", 'this software is provided by <<var;match=".{1,16}">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;match=".{1,16}">> be liable for any direct indirect incidental special exemplary or consequential damages'),
    ("cc0-1.0", "to the extent possible under law <<var;match=\".{1,12}\">> has waived all copyright and related or neighboring rights to <<var;match=\".{1,12}\">>"),
]

_WORD, _GAP = rb"[0-9a-z\x80-\xff]+", rb"[^0-9a-z\x80-\xff]+"
_WORDS = re.compile(_WORD)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MARK = re.compile(r'<<(beginOptional|endOptional|var;.*?match="\.\{(\d+),(\d+)\}".*?)>>')


def words(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """All templates as one automaton over words, made deterministic on use.

    A state of the underlying automaton is (template, position in its code);
    code items are words, ("any",) and ("skip", target) for an edge that reads
    nothing.
    """

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.code = [self._compile(text) for _, text in templates]
        self.known = {x for code in self.code for x in code if isinstance(x, bytes)}
        self.start = self._close((t, 0) for t in range(len(self.code)))
        self.step: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.first = {self.code[t][p] for t, p in self.start if p < len(self.code[t]) and isinstance(self.code[t][p], bytes)}
        if any(p == len(self.code[t]) or self.code[t][p] == ("any",) for t, p in self.start):
            raise ValueError("a template has to begin with wording and to have some that is mandatory")

    @staticmethod
    def _compile(text: str) -> list:
        code, opened, at = [], [], 0

        def plain(part: str) -> None:
            code.extend(words(part))

        for m in _MARK.finditer(text):
            plain(text[at : m.start()])
            at = m.end()
            if m[1] == "beginOptional":
                opened.append(len(code))
                code.append(None)
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                code[opened.pop()] = ("skip", len(code))
            else:
                least, most = int(m[2]), int(m[3])
                code.extend([("any",)] * least)
                end = len(code) + 2 * (most - least)
                for _ in range(most - least):
                    code.extend([("skip", end), ("any",)])
        plain(text[at:])
        if opened or "<<" in _MARK.sub("", text):
            raise ValueError(f"bad markup in {text[:60]!r}")
        return code

    def _close(self, states) -> frozenset:
        todo, done = list(states), set()
        while todo:
            t, p = todo.pop()
            if (t, p) in done:
                continue
            done.add((t, p))
            if p < len(self.code[t]) and isinstance(self.code[t][p], tuple) and self.code[t][p][0] == "skip":
                todo += [(t, p + 1), (t, self.code[t][p][1])]
        return frozenset(done)

    def _next(self, state: frozenset, word: bytes) -> frozenset:
        word = word if word in self.known else None
        found = self.step.get((state, word))
        if found is None:
            ok = lambda x: x == ("any",) or x is not None and x == word
            found = self._close((t, p + 1) for t, p in state if p < len(self.code[t]) and ok(self.code[t][p]))
            if len(self.step) > 200_000:
                self.step.clear()
            self.step[state, word] = found
        return found

    def matches(self, tokens: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of the longest text that
        each template accepts from each start, in the order of starts."""
        out = []
        for at, word in enumerate(tokens):
            if word not in self.first:
                continue
            state, i, longest = self.start, at, {}
            while state and i < len(tokens):
                state = self._next(state, tokens[i])
                i += 1
                for t, p in state:
                    if p == len(self.code[t]):
                        longest[t] = i
            out.extend(sorted({(self.labels[t], at, end) for t, end in longest.items()}))
        return out


def _phrases(base: dict[str, str]) -> tuple[re.Pattern, dict[tuple, str]]:
    phrases = {tuple(words(p)): label for p, label in base.items()}
    any_of = b"|".join(_GAP.join(map(re.escape, p)) for p in sorted(phrases, key=len, reverse=True))
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?=((?:" + any_of + rb"))(?![0-9a-z\x80-\xff]))"), phrases


class Scanner:
    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        self.automaton = Automaton(templates)
        self.base, self.phrases = _phrases(base)
        #: One longest word of each phrase: texts without any have no place.
        self.rare = [max(p, key=len) for p in self.phrases]
        self.signs = list({max(self._mandatory(code), key=len) for code in self.automaton.code})

    @staticmethod
    def _mandatory(code: list) -> list[bytes]:
        """The words of a template that no text can do without."""
        found, at = [], 0
        while at < len(code):
            if isinstance(code[at], bytes):
                found.append(code[at])
            at = code[at][1] if isinstance(code[at], tuple) and code[at][0] == "skip" else at + 1
        return found

    def scan(self, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        is_word = _IS_WORD[np.frombuffer(data, np.uint8)]
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1]
        before = np.cumsum(starts)  # words that begin up to each byte
        n_words = int(before[-1]) if len(before) else 0
        places: list[tuple[int, tuple]] = []
        found = []
        if any(x in data for x in self.rare):
            places = [(int(before[m.start()]) - 1, tuple(_WORDS.findall(m[1]))) for m in self.base.finditer(data)]
        if any(x in data for x in self.signs):
            found = self.automaton.matches(_WORDS.findall(data))
        at = [p for p, _ in places]
        base = {self.phrases[phrase] for _, phrase in places}
        labels = base | {label for label, _, _ in found}
        spans = sorted({f"{label}:{a}-{b}" for label, a, b in found})
        inside = np.zeros(n_words + 1, np.int64)
        for a, b in [(a, b) for _, a, b in found] + [(p, p + len(phrase)) for p, phrase in places]:
            inside[a] += 1
            inside[b] -= 1
        score = float((np.cumsum(inside)[:-1] > 0).mean()) if found or places else 0.0
        return n_words, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Templates of a folder of text files with markup, such as whole license
    texts, labelled by their file names without endings. They go with the
    code to all executors, so they have to be some thousands at most."""
    files = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.template)?(?:\.txt)?$", 1), "value")
    return sorted((label.lower(), text) for label, text in files.toLocalIterator())


_SCANNERS: dict[int, Scanner] = {}


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """License findings for every row of docs.

    Columns: doc_id; n_words; n_base, places of base phrases; first_word and
    last_word, their smallest and largest start counted in words (null without
    any); base_labels and labels, distinct, sorted and comma-joined, the
    latter with the templates' labels too; score, the share of the text's
    words that a template accepts or a base phrase covers; spans, array of
    label:start-end in words for each template match. A null text counts as
    empty. A template may accept text at several places and inside a longer
    one; all are in spans.
    """
    spark = docs.sparkSession
    ship_code(spark)
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    Automaton(templates)  # fails here, not on executors

    def rows(batches):
        key = hash((tuple(base.items()), tuple(templates)))
        scanner = _SCANNERS.get(key)
        if scanner is None:
            _SCANNERS.clear()
            scanner = _SCANNERS[key] = Scanner(base, templates)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column("text")]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
