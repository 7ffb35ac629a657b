"""A training corpus from documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.llm import decontaminate, langid, mixture, ngram_join, secrets
from paneloom.llm.joins import join_ids
from paneloom.llm.rows import fresh, quoted
from paneloom.session import materialise

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters, and one language ahead of the even guess."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    pred, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    found = langid.identify(docs, model, pred=pred, score=score)
    return found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of exact and near copies: the least by (id, digest of the text), null ids last.

    Rows with one id are rows of their own. Rows that agree in id and text are told apart by their other
    columns; of rows that agree in all of them any one stays. A row without n-grams is its own class.
    """
    doc, digest = fresh(docs, "_dup_id"), fresh(docs, "_dup_digest")
    key = F.col(doc).eqNullSafe(F.col("doc_id")) & F.col(digest).eqNullSafe(F.md5("text"))
    found = ngram_join.classes(docs.select("doc_id", "text", F.md5("text").alias(digest)), [digest])
    rows = materialise(found.where("class_key is not null").groupBy(
        "class_key", F.col("doc_id").alias(doc), digest).agg(F.count(F.lit(1)).alias("copies")), "keys")
    order = F.struct(F.col(doc).isNull(), F.col(doc), F.col(digest))
    least = rows.groupBy("class_key").agg(F.min(order).alias("least"), F.sum("copies").alias("size")).where("size > 1")
    judged = materialise(join_ids(rows, least, "class_key", "inner").select(
        doc, digest, "copies", (order == F.col("least")).alias("first")), "judged")
    # Most rows stay by not being named; of a first key with copies one row is chosen apart.
    out = join_ids(docs, judged.where("not first or copies > 1").select(doc, digest), key, "left_anti").select(*map(quoted, docs.columns))
    copied = judged.where("first and copies > 1").select(doc, digest)
    if copied.isEmpty():
        return out
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    ranked = join_ids(docs, copied, key, "inner").groupBy(doc, digest).agg(
        F.min_by(F.struct(*map(quoted, docs.columns)), F.to_json(F.struct(F.lit(0), *rest))).alias("row"))
    return out.unionByName(ranked.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination: fewer than 5 % of their words stand in benchmark passages."""
    words, spans, items = (fresh(docs, f"_bench_{x}") for x in ("words", "spans", "items"))
    found = decontaminate.find_passages(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=words, spans=spans, items=items)
    return found.where(~decontaminate.is_contaminated(words, spans)).select(*map(quoted, docs.columns))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text."""
    spans, clean = fresh(docs, "_secrets"), fresh(docs, "_clean")
    found = secrets.find_secrets(docs, into=spans, clean=clean)
    changed = {"text": F.col(clean), "n_chars": F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(quoted(c)) for c in docs.columns])


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes from, whole, with their size, source's size and target, and the words taken.

    Rows get a number that is written down with them, so rows that share an id or are equal meet their own share.
    """
    row = fresh(docs, "_mix_row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    added = {c: fresh(docs, c) for c in ("size", "source_size", "target", "taken")}
    taken = mixture.mix(numbered, keep=(row,)).where("taken > 0").select(row, *[F.col(c).alias(name) for c, name in added.items()])
    return join_ids(numbered, taken, row, "inner").select(*map(quoted, docs.columns), *added.values())


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark),
          ("secret scans", secret_spans), ("mixing sources to target weights", sources)]

# Language scores, learned automata and MinHash bands have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
