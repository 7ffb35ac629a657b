"""Repeated byte strings, removed by a sparse, distributed suffix sort.

Every byte that lies in a string of `length` bytes which starts at two places or more
goes. Suffixes are sorted only at anchors: places where a hash of the next `seed` bytes
is the smallest of a window so wide that every string of `length` bytes has an anchor
at the same offset wherever it occurs. Anchors whose seed occurs once in the corpus are
dropped after a count. Of the others, each task sorts the suffixes, followed by what
stands before the anchor in reverse, into runs; runs are front-coded (length of the
prefix shared with the one before, and the rest), cut by ranges of the seed's spread hash and
exchanged. A loser tree merges the runs of a range. It knows of every head how long a
prefix it shares with the last suffix put out: the longer one comes first without a
look at the bytes, equal ones are compared from there on, so no byte of a known
prefix is compared again. The shared prefixes of the merged order then tell, for every
offset before the anchor, which windows are equal. An anchor's suffix and left side
reach as far as the strings that have it as their first smallest anchor, no further.

A seed in more documents than a range is meant to hold anchors (`hot`) is not gathered in one
range: its anchors share their bytes on both sides, so no cut by what follows would part them.
The windows around them are counted by a 128-bit hash, combined before the shuffle. Equal texts
are searched once and repeat each other; no match crosses documents. A null text is
empty and keeps nothing to remove; rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from paneloom.llm.joins import join_ids
from paneloom.llm.rows import per_row
from paneloom.session import materialise

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Anchors:
    """Places of a text that any equal string of `length` bytes shares, with a hash of their seed.

    Seeds that repeat a few bytes over and over come last in the order: where a run
    of them ends, an anchor outside it is taken, so runs give few different suffixes.
    """

    def __init__(self, length: int = 400, seed: int = 128, longest_period: int = 24):
        if not 0 < seed <= length:
            raise ValueError("a seed must fit into the length")
        self.length, self.seed, self.width, self.longest_period = length, seed, length - seed + 1, longest_period
        self.powers = np.multiply.accumulate(np.full(2 * _CHUNK, _BASE))
        self.unpowers = np.multiply.accumulate(np.full(2 * _CHUNK, _UNBASE))

    def _least(self, values: np.ndarray, fn, edge) -> np.ndarray:
        """Sliding minimum or maximum over `width` values, two accumulations per block of that width."""
        n, width = len(values), self.width
        padded = np.full(-(-n // width) * width, edge, values.dtype)
        padded[:n] = values
        blocks = padded.reshape(-1, width)
        ahead = fn.accumulate(blocks, axis=1).ravel()
        behind = fn.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return fn(behind[:n - width + 1], ahead[width - 1:n])

    def _periodic(self, data: np.ndarray) -> np.ndarray | None:
        """Where the seed repeats itself after a few bytes; None where it does so nowhere."""
        found = None
        for shift in range(1, min(self.longest_period, self.seed // 2) + 1):
            same, need = data[:-shift] == data[shift:], self.seed - shift
            if b"\x01" * need in same.tobytes():
                upto = np.concatenate(([0], np.cumsum(same)))
                here = upto[need:] - upto[:-need] == need
                found = here if found is None else found | here
        return found

    def _part(self, data: np.ndarray, owners: bool):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.powers[:len(data)], out=sums[1:])
        hashes = (sums[self.seed:] - sums[:-self.seed]) * self.unpowers[:len(data) - self.seed + 1]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        order = (hashes >> np.uint64(33)).astype(np.uint32)
        periodic = self._periodic(data)
        if periodic is not None:
            order[periodic] |= np.uint32(1 << 31)
        least = self._least(order, np.minimum, np.uint32(0xFFFFFFFF))
        edge = np.zeros(self.width - 1, np.uint32)
        highest = self._least(np.concatenate((edge, least, edge)), np.maximum, np.uint32(0))
        places = np.flatnonzero(highest == order)
        if not owners:
            return places, hashes[places].view(np.int64)
        # The first smallest anchor of every window; its windows are neighbours.
        owner = np.searchsorted(places, np.arange(len(least)))
        open_ = np.flatnonzero(order[places[owner]] != least)
        while len(open_):
            owner[open_] += 1
            open_ = open_[order[places[owner[open_]]] != least[open_]]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        own = places[owner[starts]]
        return own, hashes[own].view(np.int64), starts, np.append(starts[1:], len(least)) - 1

    def _parts(self, raw: bytes, owners: bool):
        for at in range(0, max(len(raw) - self.length + 1, 0), _CHUNK):
            found = self._part(np.frombuffer(raw, np.uint8, min(len(raw) - at, _CHUNK + self.length - 1), at), owners)
            yield found[0] + at, found[1], *[x + at for x in found[2:]]

    def find(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Anchor places and seed hashes; long texts in overlapping parts that keep every string whole."""
        parts = list(self._parts(raw, False))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        return at, np.concatenate([h for _, h in parts])[first]

    def owners(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that some string of `length` bytes has as its first smallest: place, seed hash, and the first and last start of such strings."""
        parts = list(self._parts(raw, True))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*parts))


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that `known` bytes agree; halving, so compared in C."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_coded(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted keys, the prefix shared with the one before and the rest."""
    shared, rest, before = [], [], b""
    for key in keys:
        n = shared_prefix(before, key)
        shared.append(n), rest.append(key[n:])
        before = key
    return shared, rest


class _Run:
    """A front-coded run: its head, and what the head shares with the last key put out."""

    def __init__(self, shared: list[int], rest: list[bytes], refs: list):
        self.shared, self.rest, self.refs, self.at = shared, rest, refs, 0
        self.key, self.common = (rest[0], 0) if rest else (None, 0)

    def step(self) -> None:
        self.at += 1
        if self.at < len(self.rest):
            self.common = self.shared[self.at]
            self.key = self.key[:self.common] + self.rest[self.at]
        else:
            self.key = None


def _loses(a: _Run, b: _Run) -> bool:
    """Whether a's head comes after b's; the loser's shared prefix becomes that with the winner."""
    if a.key is None or b.key is None:
        return a.key is None
    if a.common != b.common:
        return a.common < b.common
    common = shared_prefix(a.key, b.key, a.common)
    after = a.key[common:common + 1] > b.key[common:common + 1]
    (a if after else b).common = common
    return after


def merge(runs: list[_Run]) -> Iterator[tuple[bytes, int, object]]:
    """Keys of all runs in order, what each shares with the key before it, and its reference.

    The tree keeps at each inner node the run that lost there; after a key is put
    out, only the path of its run is played again.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    runs = runs + [_Run([], [], []) for _ in range(size - len(runs))]
    tree: list[int] = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        left, right = play(2 * node), play(2 * node + 1)
        lost = _loses(runs[left], runs[right])
        tree[node] = left if lost else right
        return right if lost else left

    winner = play(1)
    while runs[winner].key is not None:
        run = runs[winner]
        yield run.key, run.common, run.refs[run.at]
        run.step()
        node = (winner + size) // 2
        while node:
            if _loses(runs[winner], runs[tree[node]]):
                winner, tree[node] = tree[node], winner
            node //= 2


def equal_windows(keys: list[bytes], rights: list[int], shared: list[int], many: list[bool], length: int,
                  cells: int = 1 << 19) -> np.ndarray:
    """For sorted keys (suffix, then reversed left side), which offsets before the anchor start a repeated window.

    Row i, column o: the window that starts o bytes before the anchor of key i is
    repeated. Right parts are classed by the merged prefixes, left parts by a hash of
    their first o bytes. `cells` bounds the rows times columns held at once.
    """
    n, right = len(keys), np.array(rights)
    lefts = np.array([len(k) for k in keys]) - right
    widest = min(int(lefts.max()), length)
    common, repeated = np.array(shared), np.array(many)[:, None]
    weights = np.random.default_rng(5).integers(1, 1 << 63, widest + 1, np.uint64) | np.uint64(1)
    out = np.zeros((n, widest + 1), bool)
    hashed = np.zeros((n, 1), np.uint64)
    step = max(1, cells // n)
    for low in range(0, widest + 1, step):
        offsets = np.arange(low, min(widest + 1, low + step))
        sides = np.zeros((n, len(offsets)), np.uint64)  # the byte that offset o adds to the left part; none at 0
        for i, (key, r) in enumerate(zip(keys, rights)):
            first = r + low - 1 if low else r
            side = np.frombuffer(key[first:r + int(offsets[-1])], np.uint8)
            sides[i, (not low):(not low) + len(side)] = side.astype(np.uint64) + np.uint64(1)
        left = hashed + np.cumsum(sides * weights[offsets], axis=1)
        hashed = left[:, -1:]
        fits = (lefts[:, None] >= offsets) & (right[:, None] >= length - offsets)
        classes = np.cumsum(common[:, None] < length - offsets, axis=0).astype(np.uint64)
        mixed = (left ^ (classes * _BASE)) * np.uint64(0xD6E8FEB86659FD93) + classes
        own = (np.arange(n, dtype=np.uint64)[:, None] * np.uint64(0xA24BAED4963EE407) + np.uint64(12345)) * _BASE
        mixed = np.where(fits, mixed, own)
        order = np.argsort(mixed, axis=0, kind="stable")
        placed = np.take_along_axis(mixed, order, 0)
        same = placed[1:] == placed[:-1]
        twice = np.zeros((n, len(offsets)), bool)
        twice[1:] |= same
        twice[:-1] |= same
        back = np.zeros_like(twice)
        np.put_along_axis(back, order, twice, 0)
        out[:, offsets] = fits & (back | repeated)
    return out


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def covered(place: int, offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows that start `offsets` (sorted) before a place."""
    if not len(offsets):
        return []
    cuts = np.flatnonzero(np.diff(offsets) > length)
    firsts, lasts = offsets[np.concatenate(([0], cuts + 1))], offsets[np.concatenate((cuts, [len(offsets) - 1]))]
    return [(place - int(b), place - int(a) + length) for a, b in zip(firsts, lasts)]


def _group_spans(group: list[tuple[bytes, int, tuple]], length: int, pairs_upto: int = 16) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the repeated windows around the anchors of one seed.

    Few different keys are compared in pairs, many offset by offset; both find the same bytes.
    """
    if len(group) < 2 and (not group or len(group[0][2][2]) < 2):
        return
    keys, rights, shared, places = [], [], [], []
    for key, common, (name, r, at) in group:
        if keys and key == keys[-1] and r == rights[-1]:
            places[-1] += [(name, p) for p in at]
        else:
            keys.append(key), rights.append(r), shared.append(common)
            places.append([(name, p) for p in at])
    if len(keys) > pairs_upto:
        found = equal_windows(keys, rights, shared, [len(p) > 1 for p in places], length)
        for row, where in zip(found, places):
            offsets = np.flatnonzero(row)
            for name, place in where if len(offsets) else ():
                for start, end in covered(place, offsets, length):
                    yield name, start, end
        return
    lefts = [key[r:] for key, r in zip(keys, rights)]
    extents: list[set[tuple[int, int]]] = [
        {(len(left), r)} if len(p) > 1 and len(left) + r >= length else set() for left, r, p in zip(lefts, rights, places)]
    for i in range(len(keys)):
        common = length
        for j in range(i + 1, len(keys)):
            common = min(common, shared[j])
            right = min(common, rights[i], rights[j])
            left = shared_prefix(lefts[i], lefts[j])
            if left + right >= length:
                extents[i].add((left, right))
                extents[j].add((left, right))
    for own, where in zip(extents, places):
        for left, right in own:
            for name, place in where:
                yield name, place - left, place + right


def _seed_table(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, key (digest of the text), n_bytes, sha256 of the whole, the distinct seeds and which occur twice inside."""
    def start():
        anchors = Anchors(length, seed)

        def fn(raw):
            seeds, count = np.unique(anchors.find(raw)[1], return_counts=True)
            return hashlib.md5(raw).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(), seeds, (count > 1).tolist()
        return fn

    return per_row(docs, ["raw"], {"key": StringType(), "n_bytes": LongType(), "whole": StringType(),
                                   "seeds": ArrayType(LongType()), "twice": ArrayType(BooleanType())}, start, keep=["doc_id"])


def _range_of(hash_: int, parts: int) -> int:
    """The range of a seed's hash. Anchors are places of small hashes, so the hash is spread out again first."""
    return (hash_ * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * parts >> 64


def _front_runs(batches: Iterator[pa.RecordBatch], length: int, seed: int, parts: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted front-coded runs of the anchors with repeated seeds, cut by ranges of the seed's hash."""
    anchors = Anchors(length, seed)
    held, size = [], 0

    def runs():
        held.sort(key=lambda x: (x[0], x[1], x[2]))
        bounds = {}
        for entry in held:
            bounds.setdefault(entry[0], []).append(entry)
        rows = []
        for part, entries in bounds.items():
            shared, rest = front_coded([e[1] for e in entries])
            rows.append((part, shared, [len(x) for x in rest], b"".join(rest), [e[2] for e in entries], [e[3] for e in entries],
                         [e[4] for e in entries]))
        held.clear()
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()),
                 pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)],
                                          names=["part", "shared", "sizes", "rest", "rights", "names", "places"])

    for batch in batches:
        for row in range(batch.num_rows):
            raw, key, wanted = (batch.column(i)[row].as_py() for i in range(3))
            if hashlib.md5(raw).hexdigest() != key:  # another text under the same id
                continue
            places, hashes, first, last = anchors.owners(raw)
            chosen = np.isin(hashes, np.array(wanted, np.int64))
            own: dict[tuple[int, bytes, int], list[int]] = {}
            for place, hash_, low, high in zip(*[x[chosen].tolist() for x in (places, hashes, first, last)]):
                right = raw[place:high + length]
                suffix = right + raw[low:place][::-1]
                own.setdefault((_range_of(hash_, parts), suffix, len(right)), []).append(place)
            for (part, suffix, right), at in own.items():
                held.append((part, suffix, right, key, at))
                size += len(suffix) + 8 * len(at)
            if size >= run_bytes:
                yield runs()
                size = 0
    yield runs()


def _merged_parts(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Spans per text from the merged runs of each range; rows come sorted by range."""
    part, runs = None, []

    def done() -> pa.RecordBatch:
        spans: dict[str, list[tuple[int, int]]] = {}
        group: list = []

        def close():
            for name, start, end in _group_spans(group, length):
                spans.setdefault(name, []).append((start, end))
            group.clear()

        for key, common, ref in merge(runs):
            if common < seed:
                close()
            group.append((key, common, ref))
        close()
        runs.clear()
        return _span_batch(spans)

    for batch in batches:
        for row in range(batch.num_rows):  # a row is a whole run: one is unpacked at a time
            at, shared, sizes, rest, rights, names, places = (c[row].as_py() for c in batch.columns)
            if at != part and runs:
                yield done()
            part = at
            cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
            runs.append(_Run(shared, [rest[a:b] for a, b in zip(cuts, cuts[1:])], list(zip(names, rights, places))))
    if runs:
        yield done()


def _span_batch(spans: dict[str, list[tuple[int, int]]]) -> pa.RecordBatch:
    listed = [[{"start": a, "end": b} for a, b in merged_spans(x)] for x in spans.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(spans), pa.string()), pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        names=["key", "spans"])


def _hot_windows(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """key, start of windows around anchors of hot seeds, each with a 128-bit hash."""
    def start():
        anchors = Anchors(length, seed)

        def fn(raw, key, wanted):
            if hashlib.md5(raw).hexdigest() != key:
                return ([],)
            places, hashes = anchors.find(raw)
            starts = {s for p in places[np.isin(hashes, np.array(wanted, np.int64))].tolist()
                      for s in range(max(0, p - length + seed), min(p, len(raw) - length) + 1)}
            out = []
            for s in sorted(starts):
                digest = xxhash.xxh3_128_intdigest(raw[s:s + length])
                out.append({"start": s, "h1": (digest >> 64) - (1 << 63), "h2": (digest & (1 << 64) - 1) - (1 << 63)})
            return (out,)
        return fn

    kind = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "h1", "h2")]))
    return per_row(texts, ["raw", "key", "hot_seeds"], {"windows": kind}, start, keep=["key"]).select(
        "key", F.explode("windows").alias("w")).select("key", "w.*")


def repeated_spans(docs: DataFrame, signed: DataFrame, length: int, seed: int, hot: int, part_entries: int, run_bytes: int) -> DataFrame:
    """key and merged spans of the texts with repeated strings, copies of a whole text aside."""
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("rep"))
    sparse = signed.select("doc_id", "key", F.explode(F.arrays_zip("seeds", "twice")).alias("s")).select("doc_id", "key", "s.seeds", "s.twice")
    here = F.xxhash64("key")
    counted = sparse.groupBy("seeds").agg(
        F.min(F.when(F.col("twice"), F.least(here, F.xxhash64("key", F.lit(1)))).otherwise(here)).alias("low"),
        F.max(F.when(F.col("twice"), F.greatest(here, F.xxhash64("key", F.lit(1)))).otherwise(here)).alias("high"),
        F.count(F.lit(1)).alias("n")).where("low < high").select("seeds", (F.col("n") > hot).alias("is_hot"))
    wanted = sparse.join(counted, "seeds").groupBy("doc_id", "key").agg(
        F.collect_set(F.when(~F.col("is_hot"), F.col("seeds"))).alias("cool_seeds"),
        F.collect_set(F.when(F.col("is_hot"), F.col("seeds"))).alias("hot_seeds"))
    wanted = materialise(wanted.alias("w").join(reps.alias("r"), (F.col("w.key") == F.col("r.key"))
                         & F.col("w.doc_id").eqNullSafe(F.col("r.rep"))).select("w.*"), "wanted-seeds")
    needed = wanted.select(F.col("doc_id").alias("needed")).distinct()
    own = join_ids(docs, needed, F.col("doc_id").eqNullSafe(F.col("needed")), "left_semi")
    texts = wanted.alias("w").join(own.alias("d"), F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))).select(
        "d.raw", "w.key", "w.cool_seeds", "w.hot_seeds")
    texts = materialise(texts, "texts")

    entries = wanted.agg(F.sum(F.size("cool_seeds"))).first()[0] or 0
    parts = -(-entries // part_entries) or 1
    runs = texts.where("size(cool_seeds) > 0").select("raw", "key", "cool_seeds").mapInArrow(
        lambda batches: _front_runs(batches, length, seed, parts, run_bytes),
        "part bigint, shared array<int>, sizes array<int>, rest binary, rights array<int>, names array<string>, places array<array<bigint>>")
    merged = runs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(
        lambda batches: _merged_parts(batches, length, seed),
        "key string, spans array<struct<start: bigint, end: bigint>>")

    windows = _hot_windows(texts.where("size(hot_seeds) > 0"), length, seed).distinct()
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    hot_spans = windows.join(again, ["h1", "h2"]).select(
        "key", F.array(F.struct("start", (F.col("start") + length).alias("end"))).alias("spans"))
    return texts.select("raw", "key").join(
        merged.union(hot_spans).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "key")


def remove_repeats(docs: DataFrame, length: int = 400, seed: int = 128, hot: int = 1 << 14, part_entries: int = 1 << 14,
                   run_bytes: int = 1 << 23, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; with `text`, also the bytes that stay.

    The bytes that stay are given for texts of which something but not all goes; what
    has nothing to remove keeps its own.
    """
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    signed = materialise(_seed_table(raw, length, seed), "seeds")
    found = repeated_spans(raw, signed, length, seed, hot, part_entries, run_bytes)

    def start():
        def fn(value, spans):
            spans = merged_spans([(s["start"], s["end"]) for s in spans])
            kept, done = [], 0
            for a, b in spans:
                kept.append(value[done:a])
                done = b
            left = b"".join(kept) + value[done:]
            return len(value) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left
        return fn

    fields = {"cut": LongType(), "runs": LongType(), "left_sha256": StringType(), "left": BinaryType()}
    cut = per_row(found, ["raw", "spans"], fields, start, keep=["key"])
    copies = signed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    per_text = copies.join(cut if text else cut.drop("left"), "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = signed.select("doc_id", "key", "n_bytes", "whole").join(per_text, "key")
    columns = [
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha256", "whole")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(whole, F.lit(b"")).otherwise(F.col("left")).alias("left")] if text else []))
