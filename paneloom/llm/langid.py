"""Language of a text: known words first, shorter and shorter character n-grams for the rest.

Training counts words and n-grams per language on a bounded hash sample (about
`sample_docs` documents) of the rows that are given a language; counting runs in
Spark and the model keeps the `max_terms` most frequent terms per order, so what is
broadcast has a fixed bound. A word the model knows adds its log frequency in every
language. A word it does not know is cut into its longest known n-grams from `order`
characters down to one. Null texts and texts without a letter are `und` with score 0,
as is every text when nothing could be learned. Ties go to the smaller language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType

from paneloom.llm.rows import per_row

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(word: str, order: int):
    framed = f"<{word}>"
    for n in range(1, order + 1):
        for i in range(len(framed) - n + 1):
            yield framed[i:i + n]


class Backoff:
    """Log frequencies per language: of words (size 0), then of n-grams by their length."""

    def __init__(self, counts: list[tuple[str, int, str, int]], order: int):
        self.langs, self.order = sorted({row[0] for row in counts}), order
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(order + 1)]
        self.logs: list[np.ndarray] = []
        for size, rows in enumerate(self.rows):
            own = [row for row in counts if row[1] == size]
            for _, _, term, _ in own:
                rows.setdefault(term, len(rows))
            table = np.zeros((len(rows), len(self.langs)))
            for lang, _, term, n in own:
                table[rows[term], place[lang]] = n
            self.logs.append(np.log(np.maximum(table, 0.5)) - np.log(table.sum(axis=0) + len(rows) + 1.0))
        self.nothing = np.zeros(len(self.langs))

    def word(self, word: str) -> np.ndarray:
        """A known word speaks for itself; else its longest known pieces from left to right, averaged."""
        row = self.rows[0].get(word)
        if row is not None:
            return self.logs[0][row]
        framed, at, pieces = f"<{word}>", 0, []
        while at < len(framed):
            for n in range(min(self.order, len(framed) - at), 0, -1):
                row = self.rows[n].get(framed[at:at + n])
                if row is not None:
                    pieces.append(self.logs[n][row])
                    at += n
                    break
            else:
                at += 1
        return sum(pieces[1:], pieces[0]) / len(pieces) if pieces else self.nothing


class Reader:
    """A model in use: every word seen so far has a row of scores, unseen words join as they come."""

    def __init__(self, model: Backoff, memory: int = 200_000):
        self.model, self.memory, self.known = model, memory, len(model.rows[0])
        self._start()

    def _start(self) -> None:
        self.place = dict(self.model.rows[0])
        self.table = np.concatenate((self.model.logs[0], np.zeros((1024, len(self.model.langs))))).astype(np.float32)

    def _row(self, word: str) -> int:
        row = len(self.place)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[row] = self.model.word(word)
        self.place[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(_LETTERS.findall(text.lower())) if text else None
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        if len(self.place) > self.known + self.memory:  # a bound on memory only: dropped rows are worked out again
            self._start()
        get = self.place.get
        rows = [get(word) for word in words]
        if None in rows:
            rows = [self._row(word) if row is None else row for word, row in zip(words, rows)]
        total = np.fromiter(words.values(), np.float32, len(rows)) @ self.table[rows]
        best = int(np.argmax(total))
        return self.model.langs[best], float(1.0 / np.exp((total - total[best]).astype(float)).sum())


def _count_terms(batches: Iterator[pa.RecordBatch], order: int, held: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and n-grams per language, added up in the task and sent on when many are held."""
    counts: dict[str, Counter] = {}

    def sent() -> pa.RecordBatch:
        rows = [(lang, int(term[0]), term[1:], n) for lang, terms in counts.items() for term, n in terms.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "term", "n"])

    for batch in batches:
        for row in range(batch.num_rows):
            own = counts.setdefault(batch.column(0)[row].as_py(), Counter())
            for word, n in Counter(_LETTERS.findall(batch.column(1)[row].as_py().lower())).items():
                own["0" + word] += n
                for gram in _grams(word, order):
                    own[f"{len(gram)}{gram}"] += n
            if sum(map(len, counts.values())) >= held:
                yield sent()
    yield sent()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 4,
          sample_docs: int = 10_000, max_terms: int = 10_000) -> Backoff:
    """Count terms per language on the sample; per order and language the most frequent ones reach the driver."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    share = min(1.0, sample_docs / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))

    terms = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _count_terms(batches, order), "lang string, size int, term string, n bigint")
    counted = terms.groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    order_by = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "term")
    top = counted.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= max_terms)
    return Backoff(sorted(
        (r["lang"], r["size"], r["term"], r["n"]) for r in top.select("lang", "size", "term", "n").collect()), order)


def identify(docs: DataFrame, model: Backoff, text: str = "text", pred: str = "lang_pred", score: str = "score",
             keep: list[str] | None = None) -> DataFrame:
    """`docs` with the predicted language of the whole text and its posterior under equal priors."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return Reader(held.value).predict

    return per_row(docs, [text], {pred: StringType(), score: DoubleType()}, start, keep)
