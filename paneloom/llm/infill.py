"""Fill-in-middle: documents rearranged for infilling, assembled by a secondary sort, and rebuilt from the result.

A text is cut into prefix, middle and suffix by draws that depend on (seed, id) alone. `pieces` sends each part
on as pieces of at most `chunk` units (code points), keyed by document and position in the output. One exchange
deals documents to partitions, and the sort on its reading side (`repartition` and `sortWithinPartitions`, the
DataFrame form of repartitionAndSortWithinPartitions) brings the pieces in order, so `assemble` streams them into
an incremental digest and holds one piece at a time, however long a document is. The same stream is taken apart
again at the marks, as anyone with the output and its form could do it, and sorted once more in its partition by
original position; a second digest is that of the rebuilt text.

Forms: `plain` (the text itself) for empty texts, texts that hold a mark, and the rest share of the draw; `psm`
(`<P>`prefix`<S>`suffix`<M>`middle) or `spm` (`<S>`suffix`<P>`prefix`<M>`middle) otherwise.

Odd inputs: a null text is empty; a null id draws as an empty one; rows that share an id are documents of their own
where their texts differ, and rows that agree in both give equal rows, as many as there are; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneloom.llm.rows import quoted, small_batches

MARKS = {"p": "<P>", "s": "<S>", "m": "<M>"}
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the parts in each form's output, and of the parts in the text.
_ORDER = {PSM: "psm", SPM: "spm"}
_PLACE = {"p": 0, "m": 1, "s": 2}
_ENDS = 3  # behind every part: the row that closes a document
PIECES = "id string, twin binary, at bigint, copies int, piece string, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_STREAM = "id string, twin binary, part tinyint, at bigint, piece string, copies int, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string"
ASSEMBLED = "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def draws(doc_id: str | None, seed: int) -> list[int]:
    """Four 32-bit numbers of an id."""
    word = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(word[8 * i:8 * i + 8], 16) for i in range(4)]


def cut(text: str, doc_id: str | None, seed: int, plain_from: int, spm_below: int) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS.values()) or h3 % 100 >= plain_from:
        return PLAIN, 0, 0
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return (SPM if h4 % 100 < spm_below else PSM), first, second


def outline(text: str, form: str, first: int, second: int) -> list[tuple[str, int, int]]:
    """The output as stretches: (mark in front, start, end) in the text."""
    if form == PLAIN:
        return [("", 0, len(text))]
    part = {"p": (0, first), "m": (first, second), "s": (second, len(text))}
    return [(MARKS[x], *part[x]) for x in _ORDER[form]]


def output_text(text: str, form: str, first: int, second: int) -> str:
    return "".join(mark + text[a:b] for mark, a, b in outline(text, form, first, second))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _sent(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes of pieces."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + size(row)
        if weight > 1 << 22:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            few = batch.slice(at, 64)
            yield from zip(*[few.column(i).to_pylist() for i in range(few.num_columns)])


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, chunk: int = 1 << 16,
           plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """The rearranged documents as pieces: id (as a string), `twin` (digest of the text), `at` (code points of the
    output before the piece), `copies` (equal rows that were counted into it), the piece, and the document's cuts.

    Every document has a piece at 0, an empty one if its text is empty. Equal rows of one batch travel once.
    """
    schema = _arrow(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                counts: dict[tuple, int] = {}
                ids = batch.column(0).to_pylist()
                for row in range(batch.num_rows):
                    twin = hashlib.md5((batch.column(1)[row].as_py() or "").encode()).digest()
                    counts[ids[row], twin] = counts.get((ids[row], twin), 0) + 1
                for row in range(batch.num_rows):
                    text = batch.column(1)[row].as_py() or ""
                    twin = hashlib.md5(text.encode()).digest()
                    copies = counts.pop((ids[row], twin), 0)
                    if not copies:
                        continue
                    form, first, second = cut(text, ids[row], seed, plain_from, spm_below)
                    about = (len(text), form, *((None, None) if form == PLAIN else (first, second - first)))
                    at = 0
                    for mark, start, end in outline(text, form, first, second):
                        for a in range(start, max(end, start + 1), chunk):
                            piece = mark + text[a:min(a + chunk, end)]
                            if piece or not text:
                                yield (ids[row], twin, at, copies, piece, *about)
                            at, mark = at + len(piece), ""

        yield from _sent(rows(), schema, lambda row: 4 * len(row[4]))

    source = small_batches(docs.select(F.col(quoted(key)).cast("string").alias("id"), F.col(quoted(text)).cast("string").alias("text")))
    return source.mapInArrow(run, PIECES)


class _Parts:
    """Takes an output apart while it streams by: pieces of text with their part and their place in it."""

    def __init__(self, form: str):
        self.left = list(_ORDER.get(form, ""))  # parts whose marks have not been seen
        self.part, self.at, self.carry = ("p" if form == PLAIN else ""), 0, ""

    def _give(self, text: str):
        if text:
            yield _PLACE[self.part], self.at, text
            self.at += len(text)

    def feed(self, piece: str):
        text, self.carry = self.carry + piece, ""
        while self.left:
            mark = MARKS[self.left[0]]
            at = text.find(mark)
            if at < 0:  # a mark may begin at the end of this piece
                hold = next((k for k in range(len(mark) - 1, 0, -1) if text.endswith(mark[:k])), 0)
                text, self.carry = (text[:-hold], text[-hold:]) if hold else (text, "")
                break
            if at:
                yield from self._give(text[:at])
            self.part, self.at, text = self.left.pop(0), 0, text[at + len(mark):]
        yield from self._give(text)

    def close(self):
        text, self.carry = self.carry, ""
        yield from self._give(text)


def _unfold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces in output order: the stretches of the text by original place, and a closing row with the output's digest."""
    now = None

    def closing():
        for place, at, text in parts.close():
            yield (*now, place, at, text, *[None] * 6)
        yield (*now, _ENDS, 0, None, copies, *about, digest.hexdigest())

    for doc_id, twin, at, n_copies, piece, *rest in rows:
        if (doc_id, twin) != now:
            if now is not None:
                yield from closing()
            now, digest, parts, about, copies, reached = (doc_id, twin), hashlib.sha256(), _Parts(rest[1]), rest, 0, -1
        if at == 0:
            copies += n_copies
        if at <= reached:
            continue  # the same piece of an equal row
        reached = at
        digest.update(piece.encode())
        for place, start, text in parts.feed(piece):
            yield (*now, place, start, text, *[None] * 6)
    if now is not None:
        yield from closing()


def _close(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Stretches in the order of the text: one row per document and copy, with the digest of what was rebuilt."""
    digest = hashlib.sha256()
    for doc_id, _, part, _, text, copies, *about in rows:
        if part == _ENDS:
            for _ in range(copies):
                yield (doc_id, *about, digest.hexdigest())
            digest = hashlib.sha256()
        else:
            digest.update(text.encode())


def assemble(found: DataFrame) -> DataFrame:
    """One row per document of `pieces`: its cuts, the digest of its output, and that of the text rebuilt from the output and the form."""
    stream, result = _arrow(_STREAM), _arrow(ASSEMBLED)
    dealt = found.repartition("id", "twin").sortWithinPartitions("id", "twin", "at")
    unfolded = dealt.mapInArrow(lambda batches: _sent(_unfold(_rows(batches)), stream, lambda row: 4 * len(row[4] or "")), _STREAM)
    return unfolded.sortWithinPartitions("id", "twin", "part", "at").mapInArrow(
        lambda batches: _sent(_close(_rows(batches)), result, lambda row: 256), ASSEMBLED)


def texts(found: DataFrame) -> DataFrame:
    """(id, form, output): the rearranged documents as whole texts, for writers that want rows and not pieces."""
    parts = F.array_sort(F.collect_set(F.struct("at", "piece")))
    whole = found.groupBy("id", "twin", "form").agg(
        F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("output"),
        F.sum(F.when(F.col("at") == 0, F.col("copies")).otherwise(0)).alias("copies"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("id", "form", "output")
