"""Filter audit, packing and fill-in-middle: brute force, odd rows, empty tables, clashing columns, whole texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import SCHEMA, awkward, corpus, frame
from paneloom.llm import filter_audit, infill, packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"


# Filter audit

def plain_failures(rows):
    """(part, letters failed) of every row."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 re.search(r"[#$%&*|]", text), doc_id is not None and doc_id > least[text])
        out.append((lang or "", {c for c, t in zip("ABCDE", tests) if t}))
    return out


def plain_interactions(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    failed = plain_failures(rows)
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for step in range(1, 6):
            for part in {p for p, _ in failed}:
                own, before = order[step - 1], set(order[:step - 1])
                docs = [(row[0], f) for row, (p, f) in zip(rows, failed) if p == part]
                gone = [d for d, f in docs if own in f and not f & before]
                out[part, order, step] = (
                    sum(not f & (before | {own}) for _, f in docs), len(gone), sum(own in f and bool(f & before) for _, f in docs),
                    sum(f == {own} for _, f in docs), sum(d in good for d in gone), sum(d in toxic for d in gone))
    removed = Counter()
    for (part, order, step), values in out.items():
        removed[part, order[step - 1]] += values[1]
    return {(*key, *values, removed[key[0], key[1][key[2] - 1]]) for key, values in out.items()}


def audit_rows():
    """Copies whose smaller ids stand in later rows, repeated rows, null ids, shouting and symbols."""
    rows = corpus(60)
    rows += [(1000 - i, rows[i][1], rows[i][2], "s", 1) for i in range(0, 60, 5)]
    rows += [(-i, rows[i][1], "de" if i % 2 else None, "s", 1) for i in range(1, 60, 7)]
    rows += [(500 + i, "LOUD & $ " * 60, "en", "s", 1) for i in range(3)] + [(None, rows[3][1], "en", "s", 1)] * 2
    return rows


LABELLED = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 50)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (-8, 1, 1), (502, None, 1)]


def got_interactions(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("files", [1, 5])
def test_interactions_over_files_in_any_order(spark, tmp_path, files):
    rows = audit_rows()
    random.Random(files).shuffle(rows)
    path = str(tmp_path / "docs")
    for k in range(files):  # each file holds ids on both sides of the others'
        frame(spark, rows[k::files], 1).withColumn("twin", F.lit(1)).withColumn("code", F.lit("x")).write.mode("append").parquet(path)
    labels = spark.createDataFrame(LABELLED, LABELS)
    counters = filter_audit.count_files(spark, path, labels, files_per_batch=1)
    assert got_interactions(filter_audit.interactions(counters)) == plain_interactions(rows, LABELLED)


def test_a_smaller_id_in_a_later_run_retracts(spark, tmp_path):
    path, folder = str(tmp_path / "docs"), str(tmp_path / "audit")
    text = "one two three"
    labels = spark.createDataFrame([], LABELS)
    frame(spark, [(5, text, "en", "s", 1), (9, text, "de", "s", 1)], 1).write.parquet(path)
    first = {tuple(r) for r in filter_audit.count_files(spark, path, labels, folder=folder).collect()}
    assert first == {("en", 1, 1), ("de", 17, 1)}
    frame(spark, [(2, text, "fr", "s", 1), (2, text, "fr", "s", 1), (7, text, "en", "s", 1)], 1).write.mode("append").parquet(path)
    second = {tuple(r) for r in filter_audit.count_files(spark, path, labels, folder=folder).collect()}
    assert second == {("fr", 1, 2), ("en", 17, 2), ("de", 17, 1)}
    assert {tuple(r) for r in filter_audit.count_files(spark, path, labels, folder=folder).collect()} == second  # nothing new
    changes = [(r["part"], r["code"], r["n"]) for r in spark.read.parquet(f"{folder}/changes").where("batch_id = 1").collect()]
    assert ("en", 1, -1) in changes


def test_audit_of_an_empty_table_and_of_odd_columns(spark, tmp_path):
    frame(spark, [], 1).write.parquet(str(tmp_path / "none"))
    labels = spark.createDataFrame(LABELLED, LABELS)
    assert filter_audit.interactions(filter_audit.count_files(spark, str(tmp_path / "none"), labels)).count() == 0
    awkward(spark).coalesce(1).write.parquet(str(tmp_path / "odd"))
    got = filter_audit.interactions(filter_audit.count_files(spark, str(tmp_path / "odd"), labels))
    assert got_interactions(got) == plain_interactions(corpus(), LABELLED)


def test_a_group_of_copies_sends_a_row_per_task():
    import pyarrow as pa

    ids = list(range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(["en"] * 5000), pa.array([1] * 5000, pa.int32()),
                                        pa.array([b"t"] * 5000, pa.binary())], names=["doc_id", "part", "code", "twin"])
    rows = [tuple(r.values()) for out in filter_audit._count_copies(iter([batch])) for r in out.to_pylist()]
    assert rows == [(0, b"t", 0, False, "en", 1, 1), (0, b"t", 0, True, "en", 17, 4999)]


# Packing

@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(VOCABULARY, memory=500)


def test_ids_are_those_of_the_tokenizer(encoder):
    tokenizer, draw = Tokenizer.from_file(VOCABULARY), random.Random(5)
    parts = list("abcABCéÉ ,.;:!?'\"<|>12 \n\t\v́̇I中’…") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ß", "İ", "K", "क़", "\x85", " ", " the"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(4000)] + [r[1] or "" for r in corpus()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode(None) == b""


def plain_cost(cuts, costs, size, sequence_cost):
    total, at = 0.0, 0
    for c in cuts:
        length = c - at
        assert 0 < length <= size
        total += (0 if length & (length - 1) == 0 else size - length) + costs[c] + sequence_cost
        at = c
    return total


def plain_best(places, costs, size, sequence_cost):
    """Every pair of places is tried."""
    best = {0: 0.0}
    for p in places:
        best[p] = min(best[q] + plain_cost([p - q], {p - q: costs[p]}, size, sequence_cost) for q in best if p - size <= q < p)
    return best[places[-1]]


def test_cuts_cost_the_least_of_all(encoder):
    draw = random.Random(2)
    for _ in range(300):
        size = draw.choice([8, 16, 64])
        places = list(itertools.accumulate(draw.randint(1, size) if draw.random() < 0.3 else draw.randint(1, 4) for _ in range(draw.randint(1, 60))))
        costs = {p: draw.choice([0.0, 2.0, 8.0]) for p in places}
        cuts = packing.best_cuts(places, [costs[p] for p in places], size, 1.5, True)
        assert cuts[-1] == places[-1]
        assert plain_cost(cuts, costs, size, 1.5) == pytest.approx(plain_best(places, costs, size, 1.5))
        open_cuts = packing.best_cuts(places, [costs[p] for p in places], size, 1.5, False)
        assert plain_cost(open_cuts, costs, size, 1.5) >= 0 and places[-1] - (open_cuts or [0])[-1] < size


def check_pieces(rows, docs, size):
    """Sequences without gaps, every id in exactly one piece, documents in one ascending order of sequences."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    sequences, pieces = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want, got = Counter(), Counter()
    for doc_id, text, *_ in docs:
        want[doc_id, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    for doc_id, parts in pieces.items():
        parts.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        raw = b""
        for r in parts:
            assert r["start"] == len(raw) // 4
            raw += bytes(r["ids"])
            if len(raw) == 4 * r["doc_tokens"]:
                got[doc_id, raw] += 1
                raw = b""
        assert raw == b""
    assert got == want
    return {k: sum(n for _, n in v) for k, v in sequences.items()}


def test_every_id_lies_in_one_piece(spark):
    docs = corpus()
    rows = packing.pack(awkward(spark).coalesce(2), VOCABULARY, size=256, horizon=5000).collect()
    lengths = check_pieces(rows, docs, 256)
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in lengths.values())
    assert padding < 0.06 * sum(lengths.values())


def test_padding_is_little_at_production_size(spark):
    rows = packing.pack(frame(spark, corpus(400), 1), VOCABULARY).drop("ids").collect()
    lengths = Counter()
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert max(lengths.values()) <= 2048 and padding < 0.02 * sum(lengths.values())


def test_documents_without_sentences_and_long_ones(spark):
    docs = [(0, "word " * 30_000, "en", "s", 1), (1, "x" * 20_000, "en", "s", 1), (2, None, None, None, None), (None, "a. b. c.", "en", "s", 1)]
    check_pieces(packing.pack(frame(spark, docs, 1), VOCABULARY, horizon=10_000).collect(), docs, 2048)


def test_packing_an_empty_table(spark):
    packed = packing.pack(frame(spark, [], 1), VOCABULARY)
    assert packed.count() == 0 and packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_crc_of_ids(spark):
    row = packing.pack(frame(spark, [(1, "the end", "en", "s", 1)], 1), VOCABULARY).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(bytes(row["ids"])) and row["doc_tokens"] == 3


# Fill-in-middle

def plain_fim(doc_id, text):
    text = text or ""
    word = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(word[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        form, cuts, out = "plain", (None, None), text
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        form, cuts = ("spm" if h[3] % 100 < 20 else "psm"), (a, b - a)
        out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (None if doc_id is None else str(doc_id), n, form, *cuts, sha(out), sha(text)), out


def fim_rows():
    marks = ["<P>", "a<S>b", "x <M>", "<", "<S", "P>", "<P><S><M>", "S>abc<P" * 30]
    return (corpus() + [(900 + i, t, "en", "s", 1) for i, t in enumerate(marks)] + [(None, "no id", "en", "s", 1)] * 3
            + [(2000, "long \U0001F600é " * 50_000, "en", "s", 1), (2001, "<" * 5000, "en", "s", 1)])


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_outputs_and_restored_texts(spark, chunk):
    rows = fim_rows() if chunk > 100 else [r for r in fim_rows() if len(r[1] or "") < 10_000]
    docs = frame(spark, rows).withColumn("id", F.lit("x")).withColumn("twin", F.lit(1)).withColumn("piece", F.lit("y"))
    found = infill.pieces(docs, chunk=chunk)
    got = Counter(tuple(r) for r in infill.assemble(found).collect())
    assert got == Counter(plain_fim(r[0], r[1])[0] for r in rows)
    assert Counter(r["output"] for r in infill.texts(found).collect()) == Counter(plain_fim(r[0], r[1])[1] for r in rows)


def test_a_text_is_found_again_at_any_cut_of_its_output():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice("ab<>PSM é") for _ in range(draw.randint(0, 40)))
        form, a, b = infill.cut(text, str(draw.randint(0, 999)), 1, 90, 20)
        out, parts, got, at = infill.output_text(text, form, a, b), infill._Parts(form), [], 0
        while at < len(out):
            step = draw.randint(1, 5)
            got += parts.feed(out[at:at + step])
            at += step
        got += parts.close()
        assert "".join(x[2] for x in sorted(got)) == text


def test_fill_in_middle_of_an_empty_table(spark):
    assert infill.assemble(infill.pieces(spark.createDataFrame([], SCHEMA))).count() == 0
