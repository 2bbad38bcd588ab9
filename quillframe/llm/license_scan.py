"""License scan: notice templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, without

# Phrases and labels of the base rule.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Wording of public licence notices and licence texts. <<opt>> ... <<end>> may be left out; <<var>> stands for 0 to 12 words.
TEMPLATES = {
    # Short mentions.
    "apache-2.0": "licensed under the apache license <<opt>>version 2 0<<end>>",
    "mit": "<<opt>>released<<end>> under the <<opt>>terms of the<<end>> mit license",
    "gpl-3.0": "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3",
    "gpl-2.0": "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 2",
    "cc-by-4.0": "<<opt>>licensed under<<end>> <<opt>>a<<end>> <<opt>>creative commons<<end>> cc by 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "reserved-by": "copyright <<opt>>c<<end>> <<var>> all rights reserved",
    # Notices that stand at the head of a work.
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<opt>>the license<<end>> you may not use this <<var>> except in compliance with the license you may obtain a copy of the license at <<opt>>http<<end>> <<opt>>https<<end>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license <<opt>>or at your option any later version<<end>>",
    "gpl-2.0-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license <<opt>>or at your option any later version<<end>>",
    "gpl-2.0-only-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl-3.0-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license <<opt>>or at your option any later version<<end>>",
    "lgpl-2.1-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license <<opt>>or at your option any later version<<end>>",
    "agpl-3.0-notice": "this <<var>> is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license <<opt>>or at your option any later version<<end>>",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<<end>> <<opt>>https<<end>> mozilla org mpl 2 0",
    "cc-by-4.0-notice": "this work is licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution 4 0 international license",
    "cc-by-sa-4.0-notice": "this work is licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons attribution sharealike 4 0 international license",
    "bsd-style-notice": "use of this source code is governed by a bsd style license that can be found in the license file",
    # Whole licence texts.
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<<end>> <<opt>>neither the name of <<var>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> this software is provided by <<var>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsl-1.0-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    # Openings of texts that are often cut short.
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software <<opt>>and associated documentation files<<end>> <<opt>>the software<<end>> to deal in the software without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var>> redistributions of source code must retain the above copyright notice",
}

VAR_WORDS = 12
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(opt|end|var)>>|([^\s<]+)")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


@dataclass
class Automaton:
    """States 0 to accept; word steps and free steps; free-running states count as VAR_WORDS states of their own."""

    label: str
    words: list[dict[bytes, int]]
    any_word: list[int | None]
    free: list[list[int]]
    accept: int
    anchor: bytes = b""

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def start(self) -> frozenset[int]:
        return self.closure({0})

    def longest(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words that begins at a place, or None."""
        now, end = self.start(), None
        for i in range(at, len(words)):
            step = {t for s in now if (t := self.words[s].get(words[i])) is not None} | {self.any_word[s] for s in now if self.any_word[s] is not None}
            if not step:
                break
            now = self.closure(step)
            if self.accept in now:
                end = i + 1
        return end

    def first_words(self) -> set[bytes]:
        """The words that can begin a match; a template does not begin with a replaceable region."""
        return {w for s in self.start() for w in self.words[s]}


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template with its markup. A template without mandatory words matches its optional ones, never nothing."""
    a = Automaton(label, [{}], [None], [[]], 0)

    def state() -> int:
        a.words.append({})
        a.any_word.append(None)
        a.free.append([])
        return len(a.words) - 1

    at, opened, must = 0, [], []
    for mark, word in _MARK.findall(template):
        if mark == "opt":
            opened.append(at)
        elif mark == "end":
            a.free[opened.pop()].append(at)
        elif mark == "var":
            end, s = state(), at
            a.free[s].append(end)
            for _ in range(VAR_WORDS):
                a.any_word[s] = s = state()
                a.free[s].append(end)
            at = end
        else:
            if a.words[at] or a.any_word[at] is not None:
                a.free[at].append(s := state())
                at = s
            nxt = state()
            a.words[at][word.encode()] = nxt
            at = nxt
            if not opened:
                must.append(word.encode())
        if mark == "end":  # what follows starts in a state of its own, so that a skipped region joins it there
            a.free[at].append(s := state())
            at = s
    a.accept = at
    a.anchor = max(must, key=len, default=b"")  # without a mandatory word every text is looked at
    return a


def template_regex(template: str) -> str:
    """The same language over words that each follow a blank; for tests and SQL."""
    out = ""
    for mark, word in _MARK.findall(template):
        out += {"opt": "(?:", "end": ")?", "var": f"(?: [^ ]+){{0,{VAR_WORDS}}}"}.get(mark) or " " + re.escape(word)
    return out


def find(words: list[bytes], begins: dict[bytes, list[Automaton]]) -> list[tuple[str, int, int]]:
    found = []
    for i, w in enumerate(words):
        for a in begins.get(w, ()):
            if (end := a.longest(words, i)) is not None:
                found.append((a.label, i, end))
    return found


SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batch: pa.RecordBatch, automata: list[Automaton]) -> dict[str, pa.Array]:
    counts, spans = [], []
    for text in batch.column("__text").to_pylist():
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORD)
        words = raw.split()
        able = [a for a in automata if a.anchor in raw]
        begins: dict[bytes, list[Automaton]] = {}
        for a in able:
            for w in a.first_words():
                begins.setdefault(w, []).append(a)
        counts.append(len(words))
        spans.append([{"label": x, "start": i, "end": j} for x, i, j in find(words, begins)] if able else [])
    return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(SPAN))}


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Where a document's words match a template: mandatory words exactly, optional regions or not, replaceable ones filled.

    Returns ``carry`` (all columns but the text by default) with n_words and spans (label, first word, end; for each place
    the longest match). Input columns of these names are replaced. Null and empty texts have no words and no spans; very
    long texts are scanned whole; rows are judged one by one, so repeated rows repeat. An empty table gives no rows.
    """
    templates = PHRASES | TEMPLATES if templates is None else templates
    base = without(docs, ["n_words", "spans"])
    cols = [c for c in (base.columns if carry is None else carry) if carry is not None or c != text_col]
    rows = base.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").alias("__text"))
    automata = [compiled(k, t) for k, t in templates.items()]
    return appended(rows, ["__text"], "n_words long, spans array<struct<label string, start long, end long>>", lambda b: _scan(b, automata))


def license_labels(spanned: DataFrame) -> DataFrame:
    """Counts and labels from spans; score: 1 where a whole notice matches, 0.5 where only a phrase does, else 0.

    Rows without spans have no labels (empty strings), null places and the score 0.
    """
    base = F.filter("spans", lambda s: s["label"].isin(*PHRASES))
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return spanned.withColumns({
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": names(base),
        "labels": names(F.col("spans")),
        "score": F.when(F.size("spans") > F.size(base), F.lit(1.0)).when(F.size("spans") > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
    })
