"""License scans: fuzzy search for short notices.

A notice of ``n`` characters may be met with up to ``k`` edits. Cut into ``k + 1`` pieces, one piece of every such
match stands unchanged (pigeonhole), so the exact pieces of all notices, found in one pass of an automaton, locate
the candidates; the ``regex`` library's bounded-error matching verifies each candidate and gives the span.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import alnum_words, as_text, map_arrow

#: Phrases of whole words and the labels they give.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # lower case
    edits: int


#: Short notices, in lower case, about one edit for every ten characters.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted, free of charge", 4),
    Notice("mit", "spdx-license-identifier: mit", 2),
    Notice("apache", "licensed under the apache license, version 2.0", 4),
    Notice("apache", "spdx-license-identifier: apache-2.0", 3),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "spdx-license-identifier: gpl-", 2),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "licensed under the bsd license", 2),
    Notice("mpl", "mozilla public license", 2),
    Notice("isc", "permission to use, copy, modify, and/or distribute this software", 5),
    Notice("unlicense", "released into the public domain", 3),
    Notice("cc-by-nc", "licensed under cc by-nc 4.0", 2),
    Notice("cc-by-sa", "licensed under cc by-sa 4.0", 2),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("proprietary", "all rights reserved", 1),
)


class Matcher:
    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.patterns = [
            regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for start, end in pieces(len(n.text), n.edits + 1):
                seeds.setdefault(n.text[start:end], []).append((k, start))
        self.seeds = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, share of the notice's characters without an edit) of the matches in lower-cased
        text, in order; code points, end exclusive.

        Matches do not overlap: of overlapping ones, of whatever notices, the one with fewest edits stays, then the
        one of the longest notice, then the leftmost."""
        windows: dict[int, list[list[int]]] = {}
        for at, (size, where) in self.seeds.iter(text):
            for k, offset in where:
                n = self.notices[k]
                low = at + 1 - size - offset - n.edits
                high = low + len(n.text) + 2 * n.edits
                spans = windows.setdefault(k, [])
                spans.append([max(0, low), min(len(text), high)])
        out = []
        for k, spans in windows.items():
            spans.sort()
            merged = [spans[0]]
            for low, high in spans[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                out += self.verify(k, text, low, high)
        best: list[tuple[int, int, int, int]] = []
        for edits, _, start, end, k in sorted((e, -len(self.notices[k].text), a, b, k) for a, b, e, k in out):
            at = bisect.bisect_left(best, (start,))
            if (at == 0 or best[at - 1][1] <= start) and (at == len(best) or end <= best[at][0]):
                best.insert(at, (start, end, edits, k))
        return [(a, b, self.notices[k].label, e, 1 - e / len(self.notices[k].text)) for a, b, e, k in best]

    def verify(self, k: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice): the best match in a range, then the best ones on both sides of it."""
        found, todo = [], [(low, high)]
        least = len(self.notices[k].text) - self.notices[k].edits
        while todo:
            a, b = todo.pop()
            if b - a >= least and (m := self.patterns[k].search(text, a, b)):
                found.append((m.start(), m.end(), sum(m.fuzzy_counts), k))
                todo += [(a, m.start()), (m.end(), b)]
        return found


def pieces(length: int, n: int) -> list[tuple[int, int]]:
    """``n`` consecutive ranges, as even as they go, that make up ``length``."""
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


@functools.lru_cache(maxsize=8)
def matcher(notices: tuple[Notice, ...]) -> Matcher:
    return Matcher(notices)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand consecutively."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES:
        sought = b" " + phrase + b" "
        at, word, done = line.find(sought), 0, 0
        while at >= 0:
            word += line.count(b" ", done, at)
            out.append((word, label))
            done, at = at, line.find(sought, at + 1)
    return sorted(out)


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each row of ``docs``, from its whole text.

    doc_id, n_words, n_base, first_word, last_word, base_labels (phrases of whole words), labels (base and fuzzy
    notices), score (1 for a phrase, else the best match's share of its notice's characters that no edit touched, else
    0), matches (array of start, end, label, edits; code points of the text, end exclusive; none overlap). A null or empty text has no words
    and no matches; repeated rows give repeated results; other columns are ignored. Nothing is shuffled.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows, find = [], matcher(notices).find
        for data in batch.column(1).to_pylist():
            words = alnum_words(data)
            base = phrase_places(words)
            matches = find(as_text(data.lower() if data else None))
            labels = {x for _, x in base}
            score = 1.0 if base else max((m[4] for m in matches), default=0.0)
            rows.append((len(words), base, labels, matches, score))
        return {
            "doc_id": batch.column(0),
            "n_words": [r[0] for r in rows],
            "n_base": [len(r[1]) for r in rows],
            "first_word": [r[1][0][0] if r[1] else None for r in rows],
            "last_word": [r[1][-1][0] if r[1] else None for r in rows],
            "base_labels": [",".join(sorted(r[2])) for r in rows],
            "labels": [",".join(sorted(r[2] | {m[2] for m in r[3]})) for r in rows],
            "score": [r[4] for r in rows],
            "matches": [[{"start": a, "end": b, "label": x, "edits": e} for a, b, x, e, _ in r[3]] for r in rows],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text").cast("binary")),
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<start:bigint,end:bigint,label:string,edits:int>>",
    )
