"""License scans: exact phrases, and a fuzzy search for short notices by exact seeds.

Texts are normalised (A-Z lower-cased, words joined by single spaces). The base search finds the places of fixed
phrases. The fuzzy search allows a notice EDITS_FOR its length edits: it is split into one more part than edits, so
that at least one part stands unchanged in any place within the bound (pigeonhole). Names shorter than that may have an
edit in their last word only ("license"), as they differ from each other in a letter or two. One Aho-Corasick automaton finds
all such seeds; around each the regex library matches the notice with bounded errors, which verifies the edits and
gives the span. Spans are ranges of words of the text.

Cases: null and empty texts have no words and no places (score 0). Overlapping places are all counted by the base
search; of overlapping fuzzy places, that of the longest notice is reported, then that with fewest edits. Other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WORD_TABLE, small_batches

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices for the fuzzy search and their labels. Of places that overlap, the longer notice counts, then fewer edits.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "licensed under the apache license version": "apache",
    "gnu general public license": "gpl",
    "this work is licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "mozilla public license": "mpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "the above copyright notice and this permission notice shall be included in all copies": "mit",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "redistributions in binary form must reproduce the above copyright notice": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "unless required by applicable law or agreed to in writing software distributed under the license": "apache",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "all rights reserved": "reserved",
}
#: Short names and identifiers, searched as whole words without edits, as they differ in a letter or two.
EXACT = {
    "licensed under mit": "mit", "licensed under the mit": "mit", "license mit": "mit", "licensed under apache": "apache", "licensed under bsd": "bsd", "licensed under the bsd": "bsd", "licensed under isc": "isc", "licensed under gpl": "gpl", "licensed under the gpl": "gpl",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "apache 2 0": "apache", "apache2 0": "apache", "gplv2": "gpl", "gplv3": "gpl", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "gnu gpl": "gpl", "lgplv2": "lgpl", "lgplv3": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agplv3": "agpl", "agpl 3 0": "agpl",
    "mpl 2 0": "mpl", "epl 1 0": "epl", "epl 2 0": "epl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd",
    "spdx license identifier mit": "mit", "spdx license identifier apache 2 0": "apache", "spdx license identifier isc": "isc", "spdx license identifier zlib": "zlib",
    "spdx license identifier gpl": "gpl", "spdx license identifier lgpl": "lgpl", "spdx license identifier agpl": "agpl",
    "spdx license identifier bsd": "bsd", "spdx license identifier mpl": "mpl", "spdx license identifier epl": "epl", "spdx license identifier bsl": "bsl",
}
CHARS_FOR_AN_EDIT = 16


def edits_for(notice: str) -> int:
    """One edit at least; in names shorter than CHARS_FOR_AN_EDIT only the last word may have it."""
    return max(1, len(notice) // CHARS_FOR_AN_EDIT)


def pattern(notice: str) -> regex.Pattern:
    short = len(notice) < CHARS_FOR_AN_EDIT
    name, last = notice.rsplit(" ", 1) if short else ("", notice)
    plain = lambda x: regex.escape(x, literal_spaces=True)
    return regex.compile(rf"(?be)(?<= ){plain(name + ' ') if short else ''}(?:{plain(last)}){{e<={edits_for(notice)}}}(?= )")


class Scanner:
    def __init__(self):
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[str, int]]] = {}
        for notice in NOTICES:
            if len(notice) < CHARS_FOR_AN_EDIT:  # the name itself is the part that stands unchanged
                held.setdefault(f" {notice.rsplit(' ', 1)[0]} ", []).append((notice, -1))
                continue
            k = edits_for(notice)
            cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice[a:b], []).append((notice, a))
        for seed, places in held.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.match = {n: pattern(n) for n in NOTICES}
        self.exact = [(f" {p} ", x) for p, x in EXACT.items()]

    def places(self, whole: str) -> Iterator[tuple[int, int, int, str, str]]:
        """Places (begin, end, edits, label, notice), in the text of words with spaces around, that seeds lead to."""
        ahead = dict.fromkeys(NOTICES, 0)  # where the search for a notice goes on
        for end, (n, places) in self.seeds.iter(whole):
            for notice, a in places:
                k, begin = edits_for(notice), end + 1 - n - a  # where the notice begins, were there no edits
                if end < ahead[notice]:
                    continue
                if m := self.match[notice].search(whole, max(0, begin - k - 1), min(len(whole), begin + len(notice) + k + 1)):
                    yield *m.span(), sum(m.fuzzy_counts), NOTICES[notice], notice
                    if not sum(m.fuzzy_counts):
                        ahead[notice] = m.end()
        for phrase, label in self.exact:
            at = whole.find(phrase)
            while at >= 0:
                yield at + 1, at + len(phrase) - 1, 0, label, phrase
                at = whole.find(phrase, at + 1)

    def scan(self, text: bytes | None) -> tuple[int, list[int], set[str], list[tuple[int, int, str, int, float]]]:
        """Number of words, starts of base places, base labels, fuzzy spans (first word, end word, label, edits, likeness)."""
        words = (text or b"").translate(WORD_TABLE).split()
        if not words:
            return 0, [], set(), []
        whole = f" {b' '.join(words).decode()} "
        starts: list[int] = []
        labels: set[str] = set()
        for phrase, label in PHRASES.items():
            at, seen, upto = whole.find(f" {phrase} "), 0, 0
            while at >= 0:
                seen, upto = seen + whole.count(" ", upto, at), at
                starts.append(seen)
                labels.add(label)
                at = whole.find(f" {phrase} ", at + 1)
        chosen = apart(set(self.places(whole)))
        spans, seen, upto = [], -1, 0
        for a, b, e, label, notice in chosen:
            seen, upto = seen + whole.count(" ", upto, a), a
            spans.append((seen, seen + whole.count(" ", a, b) + 1, label, e, 1 - e / len(notice)))
        return len(words), sorted(starts), labels, spans


def apart(places: set[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Of places that overlap those of the longest notices, then of fewest edits, in the order of the text."""
    begins: list[int] = []
    kept: list[tuple[int, int, int, str, str]] = []
    for x in sorted(places, key=lambda x: (-len(x[4]), x[2], x)):
        k = bisect(begins, x[0])
        if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= begins[k]):
            begins.insert(k, x[0])
            kept.insert(k, x)
    return kept


_scanner: list[Scanner] = []

SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("likeness", pa.float64())]))


def scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (fuzzy) of each row."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for b in batches:
            rows = [_scanner[0].scan(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for n, *_ in rows], pa.int64()),
                    pa.array([len(s) for _, s, *_ in rows], pa.int64()),
                    pa.array([s[0] if s else None for _, s, *_ in rows], pa.int64()),
                    pa.array([s[-1] if s else None for _, s, *_ in rows], pa.int64()),
                    pa.array([",".join(sorted(x)) for *_, x, _ in rows], pa.string()),
                    pa.array([",".join(sorted(x | {f[2] for f in fs})) for *_, x, fs in rows], pa.string()),
                    pa.array([1.0 if s else max((f[4] for f in fs), default=0.0) for _, s, _, fs in rows], pa.float64()),
                    pa.array([[dict(zip(("first", "end", "label", "edits", "likeness"), f, strict=True)) for f in fs] for *_, fs in rows], SPANS),
                ],
                names,
            )

    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string,edits:long,likeness:double>>")
