"""Benchmark passages in training text, found through an FM-index per shard of documents.

Documents stay where they are read. A shard is a bounded stretch of a task's
documents: their words become numbers, and of these only the runs of benchmark words
that are long enough to hold a window are indexed (no window can occur elsewhere).
The index is the Burrows-Wheeler transform of the shard in a wavelet matrix; all
windows are searched backward together, their rows are walked back to sampled suffix
positions, and the hits of a document are merged into spans.

A window is `size` consecutive words of an item, or the whole item if it has fewer.
The benchmark is broadcast in parts of at most `part_chars` characters, searched one
after the other in narrow passes, so a larger one costs passes, not memory. Null and
empty texts have no words and no hits; items without words have no windows; repeated
items and documents count as they stand. The passages of an item without an id are hits
like all others; only the list of items leaves it out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from paneloom.llm.rows import small_batches
from paneloom.llm.words import FOLDED_WORD, folded_words, lower_ascii

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Windows:
    """The distinct windows of some items as rows of word numbers, by length, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text)]
            length = min(size, len(ids))
            for i in range(len(ids) - length + 1) if length else ():
                owners = found.setdefault(tuple(ids[i:i + length]), set())
                if item is not None:
                    owners.add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in sorted({len(w) for w in found}):
            rows = [w for w in found if len(w) == length]
            self.by_length[length] = np.array(rows, np.int64), [sorted(found[w]) for w in rows]
        self.shortest = min(self.by_length, default=0)
        self.longest = max(self.by_length, default=0)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every zero is its own smallest symbol, so suffixes end there."""
    n, zeros = len(symbols), np.flatnonzero(symbols == 0)
    rank = symbols + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Rank and access of a sequence of numbers, a bit at a time."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            set_ = (values >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(set_))).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[set_ == 0], values[set_ == 1]))

    def trace(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where a place lands when it follows the bits of a symbol; differences of it are ranks."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.depth - 1 - level)) & 1
            before = ones[places]
            places = np.where(bit == 1, zeros + before, places - before)
        return places

    def access(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[places]
            bit = ones[places + 1] - before
            out = 2 * out + bit
            places = np.where(bit == 1, zeros + before, places - before)
        return out


class FMIndex:
    """Backward search and location over a sequence in which zeros end the runs."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1])
        counts = np.bincount(symbols, minlength=1 << self.matrix.depth)
        self.below = np.concatenate(([0], np.cumsum(counts)))[:len(counts)]
        every_symbol = np.arange(len(counts))
        self.origin = self.matrix.trace(every_symbol, np.zeros(len(counts), np.int64))
        run_start = np.concatenate(([True], symbols[:-1] == 0))
        sampled = (order % every == 0) | run_start[order]
        self.position = np.where(sampled, order, -1)

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.below[symbols] + self.matrix.trace(symbols, rows) - self.origin[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and their first and end rows."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[which, column]
            known = symbols < len(self.below)
            which, symbols, low, high = which[known], symbols[known], low[known], high[known]
            low, high = self._step(symbols, low), self._step(symbols, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back until a sampled one; starts of runs are sampled."""
        steps, out, open_ = np.zeros(len(rows), np.int64), np.full(len(rows), -1), np.arange(len(rows))
        while len(open_):
            at = self.position[rows[open_]]
            out[open_] = np.where(at >= 0, at + steps[open_], -1)
            open_ = open_[at < 0]
            rows[open_] = self._step(self.matrix.access(rows[open_]), rows[open_])
            steps[open_] += 1
        return out


def _runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of known words that can hold a window."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= shortest]


def shard_hits(shard: list[tuple[int, int, np.ndarray]], windows: Windows):
    """(document, first word, end word, items) of every occurrence in runs (document, offset, word numbers)."""
    if not shard:
        return
    lengths = np.array([len(run) + 1 for _, _, run in shard])
    starts = np.cumsum(lengths) - lengths
    symbols = np.zeros(int(lengths.sum()), np.int64)
    for start, (_, _, run) in zip(starts.tolist(), shard):
        symbols[start:start + len(run)] = run
    index = FMIndex(symbols)
    for length, (patterns, items) in windows.by_length.items():
        which, low, high = index.search(patterns)
        sizes = high - low
        rows = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        places = index.locate(rows)
        runs = np.searchsorted(starts, places, side="right") - 1
        for pattern, run, place in zip(np.repeat(which, sizes).tolist(), runs.tolist(), places.tolist()):
            doc, offset, _ = shard[run]
            first = offset + place - int(starts[run])
            yield doc, first, first + length, items[pattern]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in FOLDED_WORD.finditer(lower_ascii(text))]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done:places[start][0]])
        done = places[end - 1][1]
    return "".join(out) + text[done:]


def scan_batch(texts: list[str | None], windows: Windows, shard_words: int):
    """(number of words, hits, items) of every text; shards of at most `shard_words` indexed words."""
    n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    shard, held, get = [], 0, windows.vocabulary.get

    def flush():
        for doc, first, end, found in shard_hits(shard, windows):
            spans[doc].append((first, end))
            items[doc].update(found)
        shard.clear()

    for doc, text in enumerate(texts):
        words = folded_words(text)
        n_words[doc] = len(words)
        if not windows.shortest or len(words) < windows.shortest:
            continue
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        for a, b in _runs(ids, windows.shortest):
            while a < b:  # a long run is cut with an overlap that keeps every window whole
                end = min(b, a + shard_words)
                if held + end - a > shard_words:
                    flush()
                    held = 0
                shard.append((doc, a, ids[a:end]))
                held += end - a
                a = b if end == b else end - windows.longest + 1
    flush()
    return n_words, spans, items


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", words: str = "bench_words",
                  spans: str = "bench_spans", items: str = "bench_items", clean: str | None = None,
                  keep: list[str] | None = None, size: int = 13, part_chars: int = 1 << 24,
                  shard_words: int = 1 << 20) -> DataFrame:
    """`docs` with its number of words, the merged word spans of benchmark windows and the items that occur.

    With `clean`, also the text without the spans.
    """
    session = docs.sparkSession
    listed = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // part_chars) or 1
    keep = list(docs.columns if keep is None else keep)
    out = docs.select(*dict.fromkeys(keep + [text]))
    for part in range(parts):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        held = session.sparkContext.broadcast(Windows(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), size))
        last = part == parts - 1
        out = _pass(out, held, text, words, spans, items, clean if last else None, shard_words, part > 0,
                    keep if last else out.columns)
    return out


def _pass(docs: DataFrame, held, text: str, words: str, spans: str, items: str, clean: str | None, shard_words: int,
          again: bool, keep: list[str]) -> DataFrame:
    """One part of the benchmark, added to what earlier parts have found."""
    fields = {words: LongType(), spans: SPANS, items: ArrayType(LongType())} | ({clean: StringType()} if clean else {})
    taken = {name.lower() for name in fields}
    kept = [c for c in keep if c.lower() not in taken]
    source = small_batches(docs).select(*dict.fromkeys(kept + [text] + ([spans, items] if again else [])))
    names, types = source.columns, [to_arrow_type(kind) for kind in fields.values()]

    def run(batches):
        windows = held.value
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            counts, found, listed = scan_batch(texts, windows, shard_words)
            if again:
                for i, (s, it) in enumerate(zip(batch.column(names.index(spans)).to_pylist(), batch.column(names.index(items)).to_pylist())):
                    found[i] += [(x["start"], x["end"]) for x in s]
                    listed[i].update(it)
            found = [merged(x) for x in found]
            new = [counts, [[{"start": a, "end": b} for a, b in x] for x in found], [sorted(x) for x in listed]]
            if clean:
                new.append([without_words(t, x) if x else t for t, x in zip(texts, found)])
            arrays = [batch.column(names.index(c)) for c in kept] + [pa.array(v, type=t) for v, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + list(fields))

    return source.mapInArrow(run, StructType([source.schema[c] for c in kept] + [StructField(k, v) for k, v in fields.items()]))


def words_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"])


def is_contaminated(words: str, spans: str) -> Column:
    """Five per cent of the words or more stand in benchmark passages."""
    return (words_hit(spans) > 0) & (20 * words_hit(spans) >= F.col(words))


def judged(found: DataFrame, words: str = "bench_words", spans: str = "bench_spans", items: str = "bench_items") -> DataFrame:
    """`found` with counts, the digest of the items and whether 5 % of the words or more are hit."""
    hit = words_hit(spans)
    ids = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return found.withColumns({
        "n_words": F.col(words), "n_hit": hit, "n_items": F.size(items).cast("bigint"), "items_sha256": F.sha2(ids, 256),
        "contaminated": is_contaminated(words, spans)})
