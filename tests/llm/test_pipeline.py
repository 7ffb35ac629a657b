"""The pipeline's stages on their own input, and the registered queries on the smallest tables."""

import importlib.util
import os

import pytest

import corpus_pipeline
from helpers import EN, awkward, corpus, folded, frame, hits, jaccard_classes, prose
from oracle import compare, database
from paneloom.llm import queries
import random

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
STAGES = dict(corpus_pipeline.STAGES)


def columns_of(df):
    return [(f.name, f.dataType) for f in df.schema]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_the_columns(spark, name):
    for docs in (frame(spark), awkward(spark), frame(spark).where("false")):
        out = STAGES[name](spark, docs, SF_DIR)
        assert columns_of(out) == columns_of(docs)
        assert out.count() <= docs.count()


def test_language_stage_drops_what_has_none(spark):
    kept = {r.doc_id for r in STAGES["language ID"](spark, frame(spark), SF_DIR).collect()}
    assert not kept & {120, 121, 122, 123} and set(range(120)) <= kept


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in corpus() if r[0] < 120]
    kept = sorted(r.doc_id for r in STAGES["n-gram Jaccard join"](spark, frame(spark, rows), SF_DIR).collect())
    assert kept == sorted({c for _, c, _ in jaccard_classes(rows)})


def test_rows_of_repeated_and_null_ids(spark):
    draw = random.Random(8)
    a, b, c, d, e = (prose(draw, EN, 60) for _ in range(5))
    near = a + " end"
    rows = [(1, a, "en", "s", 1), (7, near, "en", "s", 2), (7, b, "en", "s", 3),  # one id, two texts: only the near copy goes
            (9, c, "en", "s", 4), (9, c, "en", "s", 4), (9, c, "de", "s", 5),  # one id, one text
            (None, d, "en", "s", 6), (None, d, "en", "s", 6), (None, e, "en", "s", 7), (3, e, "en", "s", 8),
            (5, None, "en", "s", 9), (5, None, "en", "s", 9), (None, "", "en", "s", 10)]
    for parts in (1, 4):
        kept = STAGES["n-gram Jaccard join"](spark, frame(spark, rows, parts), SF_DIR).collect()
        want = [rows[0], rows[2], rows[5], rows[6], rows[9], *rows[10:]]
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_each_class_of_the_whole_corpus_keeps_one_row(spark):
    rows = corpus()
    kept = [tuple(r) for r in STAGES["n-gram Jaccard join"](spark, frame(spark, rows), SF_DIR).collect()]
    classes = {c if folded(row[1]) else ("alone", i) for i, (row, (_, c, _)) in enumerate(zip(rows, jaccard_classes(rows)))}
    assert len(kept) == len(classes) and sum(r[0] == 170 for r in kept) <= 1


def test_contaminated_documents_go(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    draw = random.Random(5)
    texts = [prose(draw, EN, 50), prose(draw, EN, 50) + " " + items[3][1], prose(draw, EN, 3000) + " " + items[4][1], items[7][1], None, ""]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    kept = {r.doc_id for r in STAGES["benchmark decontamination"](spark, docs, SF_DIR).collect()}
    assert kept == {i for i, (n, hit, _) in enumerate(hits(texts, items)) if not (hit and 20 * hit >= n)}
    assert 2 in kept and not {1, 3} & kept


def test_secrets_are_replaced_and_documents_stay(spark):
    rows = [(1, "see token = abcdef0123456789abcd end", "en", "s", 36), (2, "clean prose", "en", "s", 11), (3, None, None, None, None)]
    out = {r.doc_id: r for r in STAGES["secret scans"](spark, frame(spark, rows), SF_DIR).collect()}
    assert out[1].text == "see <secret> end" and out[1].n_chars == 16
    assert tuple(out[2]) == rows[1] and tuple(out[3]) == rows[2]


def test_the_mix_keeps_whole_rows(spark):
    from paneloom.llm import mixture

    for docs in (frame(spark), awkward(spark)):
        out = STAGES["mixing sources to target weights"](spark, docs, SF_DIR)
        assert columns_of(out)[:len(docs.columns)] == columns_of(docs)
        taken = out.columns[-1]
        want = sorted((repr(r.doc_id), r.size, r.taken) for r in mixture.mix(docs).where("taken > 0").collect())
        size = out.columns[-4]
        assert sorted((repr(r.doc_id), r[size], r[taken]) for r in out.collect()) == want and want
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(r.doc_id, r.text) for r in out.collect()} <= texts
    equal = frame(spark, [(1, "one two three " * 40, "en", "s", 1)] * 5 + [(1, "four " * 90, "en", "s", 1), (2, None, "en", "s", 1)])
    assert 0 < STAGES["mixing sources to target weights"](spark, equal, SF_DIR).count() <= 6
    assert STAGES["mixing sources to target weights"](spark, equal.where("false"), SF_DIR).count() == 0


def test_pipeline_runs_its_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == want and want
    assert all(row[-1] > 0 for row in want)


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    problem, n_rows = compare(spark, duck, SF_DIR, queries.QUERIES[name], queries.ORACLES.get(name))
    assert problem is None and n_rows > 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and importlib.util.find_spec("corpus_pipeline")
    assert all(any(n.startswith(f"op{k}_") for n in entry.queries()) for k in range(1, 14)) and "pipeline" in entry.queries()
    assert folded("A b") == ["a", "b"]
