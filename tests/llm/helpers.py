"""Small corpora with everything that is awkward, and brute-force versions of the contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that was for with this from they have been people which".split()
DE = "der die und das nicht ist ein mit auf auch werden haben über für straße".split()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def prose(draw: random.Random, words: list[str], n: int) -> str:
    return " ".join(draw.choice(words) + (draw.choice(words)[:3] if draw.random() < 0.4 else "") for _ in range(n))


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    """Two languages, a hot source, copies, near copies, a shared passage, junk, and odd rows at the end."""
    draw = random.Random(seed)
    shared = prose(draw, EN, 90)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = prose(draw, EN if lang == "en" else DE, draw.randint(30, 220))
        if i % 11 == 5:
            _, text, lang, *_ = rows[i - 2]
        elif i % 11 == 6:
            lang, words = rows[i - 3][2], rows[i - 3][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 7 == 3:
            text += "\n" + shared
        rows.append((i, text, lang, "hot" if i % 3 == 0 else f"s{i % 5}", len(text)))
    odd = [None, "", "   \n\t ", "!!! ??? 12 34", "word", "a" * 5000, "ab " * 4000, "éß 中文 \U0001F600" * 40]
    rows += [(n + k, text, None if k % 2 else "en", None if k % 3 == 0 else "s1", None) for k, text in enumerate(odd)]
    rows += [(n + 50, rows[4][1], "en", "s1", 1)] * 2
    return rows


def frame(spark, rows=None, parts: int = 4):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(parts)


def awkward(spark):
    """The corpus with extra columns whose names the operators use themselves."""
    df = frame(spark)
    for name in ("n_words", "kept", "score", "spans", "size", "key", "shard", "_lang_pred", "_secrets", "label", "set_key", "raw"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def folded(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def quality_counts(text: str | None) -> tuple:
    words, lines = SPACED.findall(text or ""), (text or "").split("\n")
    nonblank = [x for x in lines if SPACED.search(x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in nonblank[:i] for i, x in enumerate(nonblank)), len(inside))


def hits(texts: list[str | None], items: list[tuple], size: int = 13):
    """(words, words hit, items found) of every text."""
    windows = {}
    for item, text in items:
        w = folded(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for text in texts:
        w, marked, found = folded(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i:i + n]))
                if ids:
                    marked.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(marked), found))
    return out


def jaccard_classes(rows: list[tuple], size: int = 5, threshold: float = 0.8):
    """Per row: class (smallest id over links) and number of links to other rows."""
    sets = []
    for _, text, *_ in rows:
        w = folded(text)
        n = min(size, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return [(row[0], least[root(i)], links[i]) for i, row in enumerate(rows)]


def without_repeats(texts: list[str | None], length: int):
    """(bytes, removed, runs, hash of what stays) of every text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        marks = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                marks[i:i + length] = b"\x01" * length
        kept = bytes(b for b, m in zip(r, marks) if not m)
        runs = sum(bool(marks[i]) and not (i and marks[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(marks), runs, hashlib.sha256(kept).hexdigest()))
    return out
