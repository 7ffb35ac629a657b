"""N-gram Jaccard self-join: MinHash bands propose, full n-gram sets decide.

Documents with the same set of word n-grams are one set with many copies. Each set
is signed with bands x rows minima, numbers chosen for the wished recall at the
threshold; sets that share a band hash meet through the least of them, so a bucket
of any size gives one candidate edge per member. The components of these edges are
the groups in which links can be. Inside a group all pairs of sets are verified on
the full sets; a group above `block_grams` n-grams or `block_sets` sets is dealt out as
pairs of blocks, so no task holds more n-grams than two blocks have, nor a matrix of
more than about block_sets x block_sets pairs. Links are counted where they are found and only
the counts and a spanning forest leave the task, never the pairs.

Texts of fewer words than n are one n-gram; null texts and texts without a word have
no n-gram, no link and are their own class. Rows that repeat a doc_id are copies if
their texts agree. Null ids are carried along; the class of a group is its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from paneloom.llm.components import connected_components
from paneloom.llm.joins import join_ids
from paneloom.llm.rows import per_row
from paneloom.llm.words import folded_words
from paneloom.session import materialise

_MASK = (1 << 64) - 1


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands, enough for the recall, need no more hashes than allowed."""
    best = None
    for rows in range(1, most_hashes + 1):
        one = threshold ** rows
        bands = 1 if one >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-one)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands of this many hashes reach the recall")
    return best


class Shingler:
    """Sets of hashed word n-grams and their band hashes."""

    def __init__(self, size: int, bands: int, rows: int, seed: int = 11, memory: int = 1 << 16):
        self.size, self.bands, self.memory, self.cache = size, bands, memory, {}
        draw = np.random.default_rng(seed)
        self.masks = draw.integers(0, _MASK, bands * rows, np.uint64, endpoint=True)
        self.odd = draw.integers(0, _MASK, bands * rows, np.uint64, endpoint=True) | np.uint64(1)
        self.shape = bands, rows

    def _hash(self, word: bytes) -> int:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= self.memory:  # a bound on memory only
                self.cache.clear()
            known = self.cache[word] = xxhash.xxh3_64_intdigest(word)
        return known

    def grams(self, text: str | None) -> np.ndarray:
        """The distinct n-grams, sorted."""
        words = folded_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self._hash, words), np.uint64, len(words))
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(words) - size + 1 + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, grams: np.ndarray) -> list[int]:
        """One hash per band, of its minima and its number."""
        least = np.full(len(self.masks), _MASK, np.uint64)
        for at in range(0, len(grams), 2048):
            mixed = (grams[at:at + 2048, None] ^ self.masks) * self.odd
            np.minimum(least, mixed.min(axis=0), out=least)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=band) - (1 << 63)
                for band, row in enumerate(least.reshape(self.shape))]


def set_key(grams: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(grams.tobytes())


def signatures(docs: DataFrame, size: int, bands: int, rows: int, keep: list[str]) -> DataFrame:
    """doc_id, the kept columns, the key of its n-gram set (null without n-grams), the number of n-grams, the band hashes."""
    def start():
        shingler = Shingler(size, bands, rows)

        def fn(text):
            grams = shingler.grams(text)
            return (set_key(grams), len(grams), shingler.signature(grams)) if len(grams) else (None, 0, [])
        return fn

    return per_row(docs.select("doc_id", "text", *keep), ["text"], {
        "set_key": StringType(), "n_grams": LongType(), "bands": ArrayType(LongType())}, start, keep=["doc_id", *keep])


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the n-grams that several sets have."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], place[shared]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    _, place = np.unique(place, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (1 << 23) // len(sets))
    columns = int(place[-1]) + 1 if len(place) else 0
    for low in range(0, columns, width):
        a, b = np.searchsorted(place, [low, low + width])
        member = np.zeros((len(sets), min(width, columns - low)), np.float32)
        member[owner[a:b], place[a:b] - low] = 1
        out += member[:len(left)] @ member[len(left):].T
    return out


def _links(rows: list[dict], threshold: float) -> Iterator[tuple[str, int, str]]:
    """(set, documents linked to it, least set of its part) for the sets of one pair of blocks that have links."""
    unique = {r["set_key"]: r for r in rows}
    rows = [unique[k] for k in sorted(unique)]
    low, high = rows[0]["low"], rows[0]["high"]
    left = [r for r in rows if r["block"] == low]
    right = left if low == high else [r for r in rows if r["block"] == high]
    if not left or not right or len(unique) < 2:
        return
    sizes = [np.array([len(r["grams"]) for r in side], float) for side in (left, right)]
    common = _intersections([r["grams"] for r in left], [r["grams"] for r in right]).astype(float)
    linked = common >= threshold * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-6
    if low == high:
        np.fill_diagonal(linked, False)
    copies = [np.array([r["copies"] for r in side], np.int64) for side in (left, right)]
    names = [r["set_key"] for r in left] + ([] if low == high else [r["set_key"] for r in right])
    if low == high:
        adjacent, counts = linked, linked @ copies[0]
    else:
        counts = np.concatenate((linked @ copies[1], linked.T @ copies[0]))
        adjacent = np.zeros((len(names), len(names)), bool)
        adjacent[:len(left), len(left):] = linked
        adjacent[len(left):, :len(left)] = linked.T
    label = np.arange(len(names))
    while True:
        near = np.where(adjacent, label, len(names)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    for i, n in enumerate(counts.tolist()):
        if n:
            yield names[i], n, names[int(label[i])]


def _cells(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, low, high) to the links of every pair of blocks; one pair is held at a time."""
    current, rows = None, []

    def done():
        out = list(_links(rows, threshold)) if rows else []
        return [(current[0], current[3], *link) for link in out]

    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        offsets, values = column["grams"].offsets.to_numpy(), column["grams"].values.to_numpy()
        keys = zip(*[column[c].to_pylist() for c in ("grp", "low", "high", "blocks")])
        links = []
        for i, (key, name, block, copies) in enumerate(zip(keys, *[column[c].to_pylist() for c in ("set_key", "block", "copies")])):
            if key != current:
                links += done()
                current, rows = key, []
            rows.append({"set_key": name, "block": block, "copies": copies, "low": key[1], "high": key[2],
                         "grams": values[offsets[i]:offsets[i + 1]].copy()})
        yield _link_batch(links)
    yield _link_batch(done())


def _link_batch(links: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], type=t) for i, t in enumerate(kinds)],
                                      names=["grp", "blocks", "set_key", "links", "root"])


def verified_links(members: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """group, blocks, set_key, links and root: a row for each set and pair of blocks in which it has links.

    `members` has set_key, rep, copies, grp, blocks and block; the full sets are made
    again from the texts, which only then leave their document.
    """
    def start():
        shingler = Shingler(size, 1, 1)

        def fn(text):
            grams = shingler.grams(text)
            return set_key(grams), grams.view(np.int64)
        return fn

    reps = members.select("rep").distinct().withColumnRenamed("rep", "needed")
    own = docs.select(F.col("doc_id").alias("own_id"), "text")
    own = join_ids(own, reps, F.col("own_id").eqNullSafe(F.col("needed")), "left_semi")
    texts = members.alias("m").join(own.alias("t"), F.col("m.rep").eqNullSafe(F.col("t.own_id")))
    sets = per_row(texts.select("m.*", "t.text"), ["text"], {"made": StringType(), "grams": ArrayType(LongType())}, start,
                   keep=members.columns).where("made = set_key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = sets.withColumn("other", other).select(
        "grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "blocks", "block",
        "set_key", "copies", "grams")
    dealt = cells.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    return dealt.mapInArrow(lambda batches: _cells(batches, threshold),
                            "grp bigint, blocks bigint, set_key string, links bigint, root string")


def near_duplicates(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its linked class), n_links to other documents, copy_of.

    The arguments are those of `classes`.
    """
    return classes(docs, [], *args, **kwargs).select("doc_id", "class_id", "n_links", "copy_of")


def classes(docs: DataFrame, keep: list[str], size: int = 5, threshold: float = 0.8, recall: float = 0.999,
                    most_hashes: int = 128, block_grams: int = 1 << 19, block_sets: int = 1 << 11) -> DataFrame:
    """Per row: doc_id, the kept columns, class_key, class_id, n_links and copy_of.

    `class_key` names the class whatever the ids are; it is null for a row without n-grams, which is its own class.
    """
    bands, rows = bands_for(threshold, recall, most_hashes)
    signed = materialise(signatures(docs, size, bands, rows, keep), "signatures")
    sets = materialise(signed.where("n_grams > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"),
        F.first("bands").alias("bands")).withColumn("node", F.xxhash64("set_key")), "sets")

    banded = sets.select("node", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    edges = banded.join(full.select("band", "least"), "band").where("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    groups = connected_components(edges)

    placed = sets.select("set_key", "rep", "copies", "n_grams", "node").join(groups, "node").withColumnRenamed("root", "grp")
    sizes = placed.groupBy("grp").agg(F.greatest(
        F.ceil(F.sum("n_grams") / block_grams), F.ceil(F.count(F.lit(1)) / block_sets)).cast("bigint").alias("blocks"))
    members = materialise(placed.join(sizes, "grp").withColumn("block", F.pmod("node", "blocks")).select(
        "set_key", "rep", "copies", "grp", "blocks", "block"), "members")
    links = materialise(verified_links(members, docs, size, threshold), "links")

    # The forest of a group in one block is its classes; that of a dealt one still has to be joined up.
    whole = links.where("blocks = 1").select("set_key", "root")
    dealt = links.where("blocks > 1 and set_key <> root").select(F.col("set_key").alias("a"), F.col("root").alias("b"))
    joined = connected_components(dealt).select(F.col("node").alias("set_key"), "root")
    counted = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    classed = counted.join(whole.union(joined), "set_key").join(sets.select("set_key", "rep"), "set_key")
    roots = classed.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = sets.select("set_key", "rep", "copies").join(
        classed.join(roots, "root").select("set_key", "root", "links", "class_id"), "set_key", "left")
    out = signed.select("doc_id", *keep, "set_key").join(known, "set_key", "left")
    return out.select("doc_id", *keep, F.coalesce("root", "set_key").alias("class_key"), F.coalesce("class_id", "rep", "doc_id").alias("class_id"),
                      F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("rep", "doc_id").alias("copy_of"))
