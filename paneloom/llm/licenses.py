"""Short license notices: exact seeds locate candidates, bounded-error matching verifies them.

A notice of m characters that holds with at most k edits, cut into k + 1 pieces,
has one piece unchanged. Exact search for the pieces therefore misses no match;
only the stretch around a piece is given to the regex library's fuzzy matching.
Null and empty texts have no words and no spans; repeated rows give repeated rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, groupby

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from paneloom.llm.rows import per_row
from paneloom.llm.spans import Covered
from paneloom.llm.words import FOLDED_WORD, folded_words, lower_ascii

# Phrases that count wherever their words stand together.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The short notices that are looked for with edits, as words.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl-2",
}
SPANS = ArrayType(StructType([
    StructField("label", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()),
    StructField("start", LongType()), StructField("end", LongType()), StructField("edits", LongType()),
    StructField("length", LongType()), StructField("base", BooleanType())]))


def edits_allowed(notice: str, per_edit: int = 12) -> int:
    """One edit for every `per_edit` characters, one at least."""
    return max(1, len(notice) // per_edit)


class Notices:
    """Seeds and verifiers of a set of notices."""

    def __init__(self, notices: dict[str, str], per_edit: int = 12):
        self.verify, self.seeds = [], {}
        for notice, label in notices.items():
            k = edits_allowed(notice, per_edit)
            pattern = regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for start, end in zip(cuts, cuts[1:]):
                self.seeds.setdefault(notice[start:end], []).append((len(self.verify), start))
            self.verify.append((pattern, label, len(notice), k))

    def search(self, joined: str) -> list[tuple[int, int, int, str, int]]:
        """(start, end, edits, label, notice length) in the joined words; overlapping ones keep the fewest edits."""
        windows = set()
        for seed, uses in self.seeds.items():
            at = joined.find(seed)
            while at >= 0:
                for which, offset in uses:
                    _, _, length, k = self.verify[which]
                    windows.add((which, max(0, at - offset - k), at - offset + length + k))
                at = joined.find(seed, at + 1)
        found = set()
        for which, low, high in windows:
            pattern, label, length, _ = self.verify[which]
            m = pattern.search(joined, low, high)
            if m:
                found.add((sum(m.fuzzy_counts), m.start(), m.end(), label, length))
        kept, covered = [], Covered()
        for _, group in groupby(sorted(found), key=lambda x: x[0]):  # fewest edits first, from left to right
            own, reached = [], -1
            for edits, start, end, label, length in group:
                if start >= reached and not covered.meets(start, end):
                    own.append((start, end, edits, label, length))
                    reached = max(reached, end)
            kept += own
            covered.add((start, end) for start, end, *_ in own)
        return sorted(kept)


def license_spans(text: str | None, notices: Notices, phrases: dict[str, str]) -> tuple[int, list[tuple]]:
    """The number of words, and (label, first word, end word, start, end, edits, length, base) of every match."""
    words = [w.decode() for w in folded_words(text)]
    joined = " ".join(words)
    framed = f" {joined} "
    exact = []
    for phrase, label in phrases.items():
        at, first, counted = framed.find(f" {phrase} "), 0, 0
        while at >= 0:
            first, counted = first + framed.count(" ", counted, at), at
            exact.append((first, first + phrase.count(" ") + 1, label, len(phrase)))
            at = framed.find(f" {phrase} ", at + 1)
    fuzzy = notices.search(joined)
    if not exact and not fuzzy:
        return len(words), []
    offsets = list(accumulate((len(w) + 1 for w in words), initial=0))
    places = [m.span() for m in FOLDED_WORD.finditer(lower_ascii(text))]
    spans = [(label, a, b, places[a][0], places[b - 1][1], 0, length, True) for a, b, label, length in sorted(exact)]
    for start, end, edits, label, length in fuzzy:
        first, last = bisect_right(offsets, start) - 1, bisect_right(offsets, max(start, end - 1)) - 1
        last = min(last, len(words) - 1)
        spans.append((label, first, last + 1, places[first][0], places[last][1], edits, length, False))
    return len(words), spans


def find_licenses(docs: DataFrame, text: str = "text", words: str = "license_words", into: str = "licenses",
                  keep: list[str] | None = None, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES,
                  per_edit: int = 12) -> DataFrame:
    """`docs` with the number of words and the license spans of `text`."""
    names = [f.name for f in SPANS.elementType]

    def start():
        known = Notices(notices, per_edit)

        def fn(value):
            n_words, spans = license_spans(value, known, phrases)
            return n_words, [dict(zip(names, span)) for span in spans]
        return fn

    return per_row(docs, [text], {words: LongType(), into: SPANS}, start, keep)
