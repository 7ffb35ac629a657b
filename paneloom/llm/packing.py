"""Packing documents into sequences of at most `size` tokens, in order, by dynamic programming over cuts.

Documents keep the order of their table. A sequence may end where a document ends (free), where a sentence ends
(`sentence_cost`) or, in long stretches without either, every `stretch` tokens (`hard_cost`). The cuts minimise
padding plus these costs plus `sequence_cost` per sequence. A sequence is padded to `size`, unless its length is a
power of two. With f(i) the least cost up to cut i at token c(i),

    f(i) = cost(i) + sequence_cost + min( size - c(i) + min{ f(j) + c(j) : c(i) - size <= c(j) < c(i) },
                                          min{ f(j) : c(i) - c(j) a power of two } )

The first minimum is that of a sliding window, kept in a monotone queue, so a cut costs the same however many cuts a
window holds; the second looks up the few cuts that can be meant.

Scale: no shuffle. A split of the table is packed as it streams by; about `horizon` tokens are held, solved exactly and
sent on but for the last, open window. So results depend on the splits of the table, and each split ends with one
sequence that may be padded (its last window may be cut anywhere). Sequence ids are the split's number and a count in it:
unique and ascending, not dense. A task that is run again on the same split gives the same rows.

Odd inputs: a null or empty text is a document of the closing id alone; null ids and rows that repeat are documents like
any other; an empty table gives an empty result; other columns are ignored unless kept. Words without white space are
encoded whole, so memory grows with the longest word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from paneloom.llm.rows import quoted, small_batches

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The pre-tokens of the vocabulary: a fixed pattern of its file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LATIN = "\u024f"
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
_SENTENCE_ENDS = ".!?。！？…"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([b for b in range(256) if b not in printable], map(chr, range(256, 512))))


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers, for vocabularies that drop white space.

    Words between ASCII white space never share a token, so each distinct word is encoded once and looked up afterwards;
    `memory` bounds the words held. Lower-case Latin words in composed form need no normalisation: their parts go to the
    model's merges directly. Any other word takes the tokenizer's whole way. Texts that may hold a special token's string
    are not lower-cased first.
    """

    def __init__(self, path: str, memory: int = 1_000_000):
        self.tokenizer, self.memory, self.known = Tokenizer.from_file(path), memory, {}
        self.tokenizer.encode_special_tokens = False
        self.merges, self.alphabet = self.tokenizer.model, _byte_letters()
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.four = [i.to_bytes(4, "little") for i in range(largest + 1)]

    def _part(self, part: str) -> bytes:
        tokens = self.merges.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet))
        four = self.four
        return b"".join([four[t.id] for t in tokens])

    def _known_part(self, part: str) -> bytes:
        key = part.encode()
        ids = self.known.get(key)
        if ids is None:
            ids = self.known[key] = self._part(part)
        return ids

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        plain = _PLAIN.fullmatch(word)
        if plain is not None:
            stem, point = plain.groups()
            return self._known_part(stem) + self._known_part(point) if point else self._part(word)
        if max(word) > _LATIN or not word.isprintable() or "<|" in word or word != word.lower() or not is_normalized("NFC", word):
            return b"".join([self.four[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        return b"".join(map(self._known_part, _PARTS.findall(word)))

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        words = raw.split() if b"<|" in raw else raw.translate(_LOWER).split()
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = self._word(word)
        return b"".join(map(known.__getitem__, words))

    def sentence_ends(self) -> np.ndarray:
        """For every id, whether a sentence may end behind it: tokens of closing marks only, with a full stop among them."""
        table = np.zeros(len(self.four), dtype=bool)
        for end in _SENTENCE_ENDS:
            for tail in ("", '"', "'", ")", "”", "»", ".", "..", "!", "?"):
                ids = self.tokenizer.encode(end + tail, add_special_tokens=False).ids
                if len(ids) == 1:
                    table[ids[0]] = True
        return table


def candidates(ids: np.ndarray, ends: np.ndarray, stretch: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document behind which a sequence may end, and the cost of ending there; the last is its end, at no cost."""
    n = len(ids)
    soft = np.flatnonzero(ends[ids[:-1]]) + 1
    bounds = np.concatenate(([0], soft, [n]))
    gaps = np.diff(bounds)
    long = np.flatnonzero(gaps > stretch)
    hard = np.concatenate([np.arange(bounds[g] + stretch, bounds[g + 1], stretch) for g in long]) if len(long) else np.zeros(0, int)
    places = np.concatenate((soft, hard, [n]))
    costs = np.concatenate((np.full(len(soft), sentence_cost), np.full(len(hard), hard_cost), [0.0]))
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def _exact_lengths(at: np.ndarray, lengths: list[int]) -> dict[int, list[int]]:
    """For every place the earlier ones that lie one of some lengths below it."""
    found: dict[int, list[int]] = {}
    index = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    index[at] = np.arange(len(at))
    for length in lengths:
        first = int(np.searchsorted(at, length))
        j = index[at[first:] - length]
        here = np.flatnonzero(j >= 0)
        for i, source in zip((here + first).tolist(), j[here].tolist()):
            found.setdefault(i, []).append(source)
    return found


def best_cuts(places: Sequence[int], costs: Sequence[float], size: int, sequence_cost: float, closed: bool) -> list[int]:
    """Cuts of least cost among ascending places, from 0; neighbours are at most `size` apart.

    Closed: the last cut is the last place. Else it is the cheapest place within `size` of the last one, and what lies
    behind it stays open; exact lengths then start at a sixteenth of `size`.
    """
    at = [0, *places]
    # A full window has no padding anyway; short ones only help where nothing follows.
    powers = [1 << k for k in range(size.bit_length()) if (size >> 4 if not closed else 1) <= 1 << k < size]
    exact = _exact_lengths(np.array(at), powers)
    total, back = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # ascending f + place, places within the window
    for i, cost in enumerate(costs, 1):
        place = at[i]
        while at[queue[0][1]] < place - size:
            queue.popleft()
        least, source = queue[0]
        least += size - place
        for j in exact.get(i, ()):
            if total[j] < least:
                least, source = total[j], j
        least += cost + sequence_cost
        total.append(least)
        back.append(source)
        key = least + place
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, i))
    last = len(at) - 1
    if not closed:
        last = min(range(bisect_right(at, at[-1] - size), len(at)), key=lambda j: (total[j], -j))
    cuts = []
    while last:
        cuts.append(at[last])
        last = back[last]
    return cuts[::-1]


@lru_cache(maxsize=1)
def _encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """One per worker process: the words of one task serve the next."""
    encoder = Encoder(path)
    return encoder, encoder.sentence_ends()


class _Packer:
    """Documents of a stream, held until their windows are chosen."""

    def __init__(self, size: int, sequence_cost: float, hard_cost: float, first_id: int):
        self.size, self.sequence_cost, self.hard_cost = size, sequence_cost, hard_cost
        self.next_id = first_id
        self.docs: list[list] = []  # [keys, ids as bytes, tokens, place of its first token in the buffer (may be negative)]
        self.places: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: tuple, ids: bytes, places: np.ndarray, costs: np.ndarray) -> None:
        self.docs.append([keys, ids, len(ids) // 4, self.held])
        self.places.append(places + self.held)
        self.costs.append(costs)
        self.held += len(ids) // 4

    def solve(self, closed: bool) -> Iterator[tuple]:
        """Rows of all windows up to the last cut; what lies behind it stays."""
        if not self.held:
            return
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        if closed:  # the last window has no successor to share its padding with, so it may be cut anywhere
            extra = np.setdiff1d(np.arange(max(1, self.held - self.size), self.held), places)
            places, costs = np.concatenate((places, extra)), np.concatenate((costs, np.full(len(extra), self.hard_cost)))
            order = np.argsort(places, kind="stable")
            places, costs = places[order], costs[order]
        cuts = best_cuts(places.tolist(), costs.tolist(), self.size, self.sequence_cost, closed)
        doc, begin = 0, 0
        for end in cuts:
            place = begin
            while place < end:
                keys, ids, n, first = self.docs[doc]
                upto = min(end, first + n)
                yield (*keys, place - first, upto - place, ids[4 * (place - first):4 * (upto - first)], n, self.next_id, place - begin)
                place = upto
                if upto == first + n:
                    doc += 1
            self.next_id += 1
            begin = end
        keep = places > begin
        self.places, self.costs = [places[keep] - begin], [costs[keep]]
        self.docs = [[keys, ids, n, first - begin] for keys, ids, n, first in self.docs[doc:]]
        self.held -= begin


def pack(docs: DataFrame, vocabulary: str, text: str = "text", size: int = 2048, close_id: int = 1, horizon: int = 1 << 18,
         stretch: int = 32, sentence_cost: float = 8.0, hard_cost: float = 64.0, sequence_cost: float = 16.0,
         keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per piece: the kept columns, `start` (tokens of its document before it), `length`, `ids` (little-endian
    unsigned 32-bit), `doc_tokens` (with the closing id), `sequence_id` and `offset` (tokens of its sequence before it).

    `vocabulary` is the path of a tokenizer file that every executor can read.
    """
    source = small_batches(docs).select(*[quoted(c) for c in keep], F.col(quoted(text)).cast("string").alias("_packed_text"))
    out = StructType([source.schema[c] for c in keep] + list(StructType.fromDDL(PIECES)))
    types = [to_arrow_type(f.dataType) for f in out]
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _encoder(vocabulary)
        closing = np.array([close_id], dtype="<u4").tobytes()
        packer = _Packer(size, sequence_cost, hard_cost, TaskContext.get().partitionId() << 40)

        def sent(closed: bool) -> Iterator[pa.RecordBatch]:
            rows = list(packer.solve(closed))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows[at:at + 4096]), types)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                few = batch.slice(at, 128)
                for *keys, words in zip(*[few.column(i).to_pylist() for i in range(few.num_columns)]):
                    ids = encoder.encode(words) + closing
                    packer.add(tuple(keys), ids, *candidates(np.frombuffer(ids, dtype="<u4"), ends, stretch, sentence_cost, hard_cost))
                    if packer.held >= horizon:
                        yield from sent(False)
        yield from sent(True)

    return source.mapInArrow(run, out)
