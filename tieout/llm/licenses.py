"""License scan: base phrases, and license templates compiled to token automata.

A template is mandatory wording with two kinds of markup: ``[[...]]`` may be left
out, and ``{{name:least-most}}`` stands for any ``least`` to ``most`` words.  It is
compiled, and all templates together make one nondeterministic automaton over
words, which is stepped once over the words of a text with a new start at every
word; a template is accepted where its whole mandatory wording matches exactly.
Only texts that hold some template's longest mandatory word (a byte search) are
stepped through.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case.

Defined results: a null or empty text has no words; texts of any length are read
whole; repeated rows and rows with equal ids are scanned one by one; n_base, first_word and last_word are
about the base phrases; score is 1 with an accepted template, 0.5 with base
phrases only, else 0; every input row has one output row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import blocks
from tieout.llm.words import PUNCTUATION, words_of

#: Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
_SOURCE = (
    "[[{{number:1-1}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[{{number:1-1}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution "
)
_NAME = "[[{{number:1-1}}]] neither the name of {{holder:1-8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_DISCLAIMER = (
    "this software is provided by {{holder:1-8}} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:1-8}} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)

#: Labels and templates: whole license texts and notices in general use, in lower case without punctuation.
TEMPLATES = (
    ("mit-notice", "[[this {{work:1-3}} is]] released under the [[terms of the]] mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-3.0-notice", "licensed under the [[terms of the]] gnu general public license version 3"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at {{url:1-8}} unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
    ),
    ("bsd-2-text", _GRANT + _SOURCE + _DISCLAIMER),
    ("bsd-3-text", _GRANT + _SOURCE + _NAME + _DISCLAIMER),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies the software is provided as is and {{holder:1-8}} disclaims all warranties with regard to this "
        "software including all implied warranties of merchantability and fitness in no event shall {{holder:1-8}} be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
    ),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version {{version:1-1}} of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details",
    ),
    ("cc-by-notice", "this {{work:1-3}} is licensed under a creative commons attribution {{version:0-3}} international license"),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Automaton:
    """All templates in one: states by number; ``moves[s]`` by word, ``free[s]`` by any word, ``skips[s]`` without one."""

    moves: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    labels: dict[int, str] = field(default_factory=dict)  # of accepting states
    starts: set[int] = field(default_factory=set)
    keys: set[bytes] = field(default_factory=set)  # the longest mandatory word of each template
    first: dict[bytes, set[int]] = field(default_factory=dict)  # states after the first word

    def state(self) -> int:
        self.moves.append({})
        self.free.append(None)
        self.skips.append([])
        return len(self.moves) - 1

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def step(self, states: set[int], word: bytes) -> set[int]:
        after = {self.moves[s][word] for s in states if word in self.moves[s]}
        after |= {self.free[s] for s in states if self.free[s] is not None}
        return self.close(after)

    def accepts(self, words: list[bytes]) -> set[str]:
        """Labels of the templates that some stretch of the words matches."""
        begin = self.close(set(self.starts))
        anything = any(self.free[s] is not None for s in begin)
        found: set[str] = set()
        active: set[int] = set()
        for word in words:
            if not active and not anything and word not in self.first:
                continue
            after = self.step(active, word)
            if anything:
                after |= self.step(begin, word)
            else:
                after |= self.first.get(word, set())
            active = after
            found |= {self.labels[s] for s in active if s in self.labels}
        return found


def parts(template: str) -> list:
    """The template as words, ("any", least, most), and lists for optional regions."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|\S+?(?=\[\[|\]\]|\s|$)", template):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            region = stack.pop()
            stack[-1].append(region)
        elif token.startswith("{{"):
            least, most = token[2:-2].split(":")[1].split("-")
            stack[-1].append(("any", int(least), int(most)))
        else:
            stack[-1].append(token)
    return stack[0]


def build(templates=TEMPLATES) -> Automaton:
    out = Automaton()

    def chain(at: int, items: list) -> int:
        for item in items:
            if isinstance(item, str):
                to = out.state()
                out.moves[at][item.encode()] = to
                at = to
            elif isinstance(item, tuple):
                doors = []
                for i in range(item[2]):
                    if i >= item[1]:
                        doors.append(at)
                    to = out.state()
                    out.free[at] = to
                    at = to
                end = out.state()
                for door in (*doors, at):
                    out.skips[door].append(end)
                at = end
            else:
                inner = out.state()
                out.skips[at].append(inner)
                end = out.state()
                out.skips[chain(inner, item)].append(end)
                out.skips[at].append(end)
                at = end
        return at

    for label, template in templates:
        items = parts(template)
        start = out.state()
        end = chain(start, items)
        final = out.state()
        out.skips[end].append(final)
        out.labels[final] = label
        out.starts.add(start)
        out.keys.add(max((w for w in items if isinstance(w, str)), key=len).encode())
    begin = out.close(set(out.starts))
    for word in {w for s in begin for w in out.moves[s]}:
        out.first[word] = out.step(begin, word)
    return out


_ROWS = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per text: words, base phrases, labels and score."""
    phrases = [(tuple(p.encode().split()), label) for p, label in base]
    telling = {max(p, key=len) for p, _ in phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(templates)
        for batch in batches:
            for table in blocks.pieces(pa.Table.from_batches([batch])):
                count = np.diff(words_of(table["text"], hashed=False, between=PUNCTUATION).first)
                rows = []
                for doc_id, n, text in zip(table["doc_id"].to_pylist(), count.tolist(), table["text"].cast(pa.binary()).to_pylist()):
                    text = (text or b"").lower()  # bytes: A-Z only
                    places: list[int] = []
                    found, own = set(), set()
                    if any(w in text for w in telling) or any(k in text for k in automaton.keys):
                        words = _WORD.findall(text)
                        for phrase, label in phrases:
                            starts = [i for i, word in enumerate(words) if word == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
                            places += starts
                            found |= {label} if starts else set()
                        own = automaton.accepts(words)
                    score = 1.0 if own else 0.5 if found else 0.0
                    rows.append((doc_id, n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | own)), score))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in _ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def _pattern(items: list) -> str:
    """The template as a regular expression over words that each end in one space."""
    out = ""
    for item in items:
        if isinstance(item, str):
            out += f"{item} "
        elif isinstance(item, tuple):
            out += f"(?:[^ ]+ ){{{item[1]},{item[2]}}}"
        else:
            out += f"(?:{_pattern(item)})?"
    return out


def oracle_sql(base=BASE, templates=TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``; templates are regular expressions there."""
    places = ", ".join(
        f"[struct_pack(at := i, label := '{label}') FOR i IN range(len(w)) IF " + " AND ".join(f"w[i + {j + 1}] = '{word}'" for j, word in enumerate(p.split())) + "]" for p, label in base
    )
    own = ", ".join(f"CASE WHEN regexp_matches(t, ' {_pattern(parts(template))}') THEN '{label}' END" for label, template in templates)
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t, flatten([{places}]) AS hits FROM words),
named AS (SELECT *, [x FOR x IN [{own}] IF x IS NOT NULL] AS own, list_distinct([h.label FOR h IN hits]) AS based FROM found)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
  CAST(list_min([h.at FOR h IN hits]) AS BIGINT) AS first_word, CAST(list_max([h.at FOR h IN hits]) AS BIGINT) AS last_word,
  COALESCE(array_to_string(list_sort(based), ','), '') AS base_labels,
  COALESCE(array_to_string(list_sort(list_distinct(list_concat(based, own))), ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(hits) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM named"""
