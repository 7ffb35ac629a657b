"""Queries for sources, sinks, privacy jobs, study design, regression and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom import schema as S
from paneloom.functions import ranks as R
from paneloom.functions import scalars as N
from paneloom.functions.text import PII_PATTERNS
from paneloom.operators import conform as C
from paneloom.operators import privacy as X
from paneloom.operators import regress as G
from paneloom.plans import tables as V
from paneloom.plans.queries_describe import demographics
from paneloom.plans.queries_tests import traits
from paneloom.plans.queries_scalar import SQL_TRAITS
from paneloom.plans.registry import query, r6, sq6
from paneloom.session import materialise, work_path
from paneloom.sources import buckets
from paneloom.sources import readers as I
from paneloom.sources import writers as O
from paneloom.sources.registry import registry_frame
from paneloom.streaming import responses as live

_C = F.col


# ---- sources -------------------------------------------------------------

@query("src1_persona_document_tree", """SELECT CAST(s_suppkey AS VARCHAR) AS subject, CAST(s_suppkey % 60 + 18 AS INT) AS age, 'g' || s_nationkey AS gender,
CAST(s_suppkey % 5 - 2 AS INT) AS big1 FROM supplier""")
def src1(spark, sf_dir):
    path = work_path(spark, "personas")
    docs = V.table(spark, sf_dir, "supplier").select(
        _C("s_suppkey").alias("subject"), _C("s_suppkey").cast("string").alias("participant_id"),
        (_C("s_suppkey") % 60 + 18).alias("age"), F.concat(F.lit("g"), "s_nationkey").alias("gender"),
        F.create_map(F.lit("survey.big1"), _C("s_suppkey") % 5 - 2).alias("personality"))
    O.write_document_tree(docs, path, "subject")
    return I.persona_documents(spark, path).select(
        "subject", "age", "gender", _C("personality")["survey.big1"].alias("big1"))


@query("src2_study_documents_exploded", """SELECT s_suppkey AS subject, item, CAST(s_suppkey % 5 - 2 AS INT) AS init_belief,
CAST(['123', '132', '213', '231', '312', '321'][CAST(s_suppkey % 6 + 1 AS INT)] AS VARCHAR) AS shown FROM supplier CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS item)""")
def src2(spark, sf_dir):
    path = work_path(spark, "study")
    index = (_C("s_suppkey") % 6).cast("int")
    messages = C.shown_messages(index, F.lit("package1"), F.create_map(F.lit(1), F.lit("one")))
    topics = F.array(*[F.struct(
        F.lit(i).alias("topic"), F.lit("w").alias("statement_formulation"), (_C("s_suppkey") % 5 - 2).alias("init_belief"),
        F.lit("package1").alias("package"), index.alias("message_order_index"), messages.alias("shown_messages"))
        for i in V.ITEMS])
    docs = V.table(spark, sf_dir, "supplier").select(
        _C("s_suppkey").alias("subject"), _C("s_suppkey").cast("string").alias("participant_id"), topics.alias("topics"))
    O.write_document_tree(docs, path, "subject", ignoreNullFields="false")
    return I.study_topics(spark, path).select(
        _C("participant_id").cast("bigint").alias("subject"), _C("topic").alias("item"), "init_belief",
        F.array_join(F.transform("shown_messages", lambda m: m["source_message_id"].cast("string")), "").alias("shown"))


@query("src3_panel_file", f"""WITH {V.PANEL} SELECT CAST(subject AS VARCHAR) AS persona_id, item AS topic, init_raw AS initial_belief_unnormalized,
raw AS final_belief_unnormalized, init AS init_stance, y AS new_belief FROM panel WHERE src = 1""")
def src3(spark, sf_dir):
    path = work_path(spark, "panel")
    base = V.panel(spark, sf_dir).where("src = 1")
    have = {"persona_id": _C("subject"), "topic": _C("item"), "package": _C("cell"), "statement_formulation": _C("statement"),
            "initial_belief": _C("init_raw"), "final_belief": _C("raw"), "initial_belief_normalized": _C("init"),
            "final_belief_normalized": _C("y"), "text_response": F.lit('said "so", twice')}
    wide = base.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.PANEL_ROW])
    wide.write.option("header", True).option("escape", '"').csv(path)
    return I.panel_file(spark, path).select(
        "persona_id", "topic", "initial_belief_unnormalized", "final_belief_unnormalized", "init_stance", "new_belief")


def _response_rows(spark, sf_dir, with_text: bool = True):
    """The candidate answers in the shape of response files."""
    rows = V.responses(spark, sf_dir).where("src > 1")
    rows = V.with_raw_text(rows) if with_text else rows.withColumn("raw_response", F.lit(None).cast("string"))
    order = R.message_order(_C("order_seen"))
    have = {
        "persona_id": _C("subject"), "topic": _C("item"), "model": _C("source"), "statement_formulation": _C("statement"),
        "init_belief": _C("own_init_raw"), "familiarity": F.lit(1), "package": _C("cell"), "message_order_index": _C("order_seen"),
        "message_order_perm": F.to_json(order), "shown_messages": F.to_json(order),
        "raw_response": _C("raw_response"), "llm_new_belief": F.when(_C("l_suppkey") % 3 != 0, _C("raw")),
        "llm_general_public_stance": F.when(_C("l_suppkey") % 3 != 0, _C("stance_raw")),
        **{f"rank_{k}": F.when(_C("l_suppkey") % 3 != 0, _C(f"r{k}")) for k in (1, 2, 3)},
    }
    return rows.select("source", *[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RESPONSE_ROW])


@query("src4_response_file_normalised", f"""WITH {V.RESP} SELECT CAST(subject AS VARCHAR) AS persona_id, item AS topic, source AS model, own_init_raw AS init_stance,
CASE WHEN l_suppkey % 3 <> 0 THEN raw * polarity END AS new_belief, CASE WHEN l_suppkey % 3 <> 0 THEN stance_raw * polarity END AS general_public_stance FROM resp WHERE src > 1""")
def src4(spark, sf_dir):
    path = work_path(spark, "responses")
    _response_rows(spark, sf_dir, with_text=False).drop("source").write.option("compression", "snappy").json(path)
    out = I.normalised_responses(I.response_files(spark, [path]), V.POSITIVE, V.NEGATIVE)
    return out.select("persona_id", "topic", "model", "init_stance", "new_belief", "general_public_stance")


_REGISTRY = [("source=model_2", "main", "m2", None, None, None), ("source=model_3", "main", "m3", None, None, None),
             ("source=model_4", "simulated_initial", "m2", None, None, None),
             ("source=model_5", "ablations", "m2", "temperature", "t0.0", 0.0),
             ("source=model_6", "ablations", "m2", "temperature", "t2.0", 2.0),
             ("source=model_7", "ablations", "m3", "temperature", "t1.0", 1.0)]
_SQL_REGISTRY = """reg AS (SELECT * FROM (VALUES ('model_2', 'main', 'm2', NULL, NULL), ('model_3', 'main', 'm3', NULL, NULL), ('model_4', 'simulated_initial', 'm2', NULL, NULL),
  ('model_5', 'ablations', 'm2', 't0.0', 0.0), ('model_6', 'ablations', 'm2', 't2.0', 2.0), ('model_7', 'ablations', 'm3', 't1.0', 1.0)) v(source, split, model, condition, temperature))"""
# Repaired answers of the response files: stored values win, gaps are filled from the raw text.
_SQL_FILES = V.PARSED + """, rep AS (SELECT *, CASE WHEN l_suppkey % 3 <> 0 AND raw IS NOT NULL THEN raw WHEN usable THEN b END AS nb,
  CASE WHEN l_suppkey % 3 <> 0 AND stance_raw IS NOT NULL THEN stance_raw WHEN usable THEN s END AS gs,
  CASE WHEN l_suppkey % 3 <> 0 AND r1 IS NOT NULL THEN r1 WHEN usable THEN k1 END AS q1,
  CASE WHEN l_suppkey % 3 <> 0 AND r2 IS NOT NULL THEN r2 WHEN usable THEN k2 END AS q2,
  CASE WHEN l_suppkey % 3 <> 0 AND r3 IS NOT NULL THEN r3 WHEN usable THEN k3 END AS q3 FROM parsed)"""


def conformed(spark, sf_dir):
    path = work_path(spark, "files")
    _response_rows(spark, sf_dir).write.partitionBy("source").option("compression", "snappy").json(path)
    paths = [f"{path}/{row[0]}" for row in _REGISTRY]
    files = I.response_files(spark, paths).withColumn("file", F.element_at(F.split("file", "/"), -2))
    return C.conform_responses(files, registry_frame(spark, _REGISTRY), V.POSITIVE, V.NEGATIVE)


@query("src5_multi_file_registry_scan", f"""WITH {_SQL_FILES}, {_SQL_REGISTRY}
SELECT split, model, condition, CAST(temperature AS DOUBLE) AS temperature, CAST(subject AS VARCHAR) AS persona_id, item AS topic, polarity AS statement_polarity,
  nb AS raw_new_belief, nb * polarity AS normalized_new_belief, gs * polarity AS normalized_general_public_stance,
  CASE WHEN list_sort([q1, q2, q3]) = [1, 2, 3] THEN list_position([q1, q2, q3], 1) END AS rank_1,
  CASE WHEN split = 'simulated_initial' THEN 'simulated' ELSE 'participant' END AS init_belief_source FROM rep JOIN reg USING (source)""")
def src5(spark, sf_dir):
    return conformed(spark, sf_dir).select(
        "split", "model", "condition", "temperature", "persona_id", "topic", "statement_polarity", "raw_new_belief",
        "normalized_new_belief", "normalized_general_public_stance", "rank_1", "init_belief_source")


@query("snk1_conformed_dataset_by_split", f"""WITH {V.RESP}, {_SQL_REGISTRY} SELECT split, model, count(*) AS n FROM resp JOIN reg USING (source) GROUP BY 1, 2""")
def snk1(spark, sf_dir):
    path = work_path(spark, "dataset")
    O.write_dataset(conformed(spark, sf_dir).drop("repaired", "file"), path, compression="gzip")
    fields = [f for f in S.CONFORMED if f.name != "split"]
    back = spark.read.schema(S.T.StructType([*fields, S.CONFORMED["split"]])).json(path)
    return back.groupBy("split", "model").agg(F.count("*").alias("n"))


@query("src6_run_configs", """SELECT 'm-' || p_size || 'B' AS model, 'out/' || p_size AS output, CAST(p_size % 4 + 1 AS INT) AS max_tries,
  row_number() OVER (ORDER BY p_size) AS position FROM (SELECT DISTINCT p_size FROM part) WHERE p_size % 10 <> 0""")
def src6(spark, sf_dir):
    from pyspark.sql.window import Window

    path = work_path(spark, "configs")
    sizes = V.table(spark, sf_dir, "part").select("p_size").distinct()
    mark = F.when(_C("p_size") % 2 == 0, "﻿").otherwise("")
    text = F.concat(mark, F.lit('[{"model": "m-'), "p_size", F.lit('B", "paths": {"output": "out/'), "p_size",
                    F.lit('"}, "max_tries": '), _C("p_size") % 4 + 1, F.lit("}]"))
    sizes.select(text.alias("value"), "p_size").write.partitionBy("p_size").text(path)
    excluded = sizes.where("p_size % 10 = 0").select(F.concat(F.lit("m-"), "p_size", F.lit("B")).alias("model"))
    found = I.run_configs(spark, path + "/*", excluded)
    size = N.size_fields(_C("model"))
    order = Window.partitionBy(F.lit(1)).orderBy(size["active_b"], size["stated_b"], "model")
    return found.select("model", "output", "max_tries", F.row_number().over(order).alias("position"))


@query("src7_column_alias_and_defaults", f"""WITH {V.RESP} SELECT subject, item, round, source, raw AS llm_new_belief, statement AS llm_reasoning, CAST(NULL AS INT) AS rank_1 FROM resp""")
def src7(spark, sf_dir):
    rows = V.responses(spark, sf_dir).select(
        "subject", "item", "round", "source", _C("raw").alias("llm_new_belief"), _C("statement").alias("free_text"))
    return C.alias_columns(rows, {"free_text": "llm_reasoning", "source_x": "source"}, {"llm_new_belief": "int", "rank_1": "int"})


@query("src8_packed_records", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 4 END AS n_fields, CAST(o_custkey AS VARCHAR) AS second,
CASE WHEN o_orderkey % 3 <> 0 THEN 'say "' || o_orderpriority || '", ok' END AS third FROM orders""")
def src8(spark, sf_dir):
    quoted = F.concat(F.lit('"say ""'), "o_orderpriority", F.lit('"", ok"'))
    short = F.concat_ws(",", "o_orderkey", "o_custkey")
    record = F.when(_C("o_orderkey") % 3 == 0, short).otherwise(F.concat_ws(",", short, quoted, F.lit("")))
    f = I.csv_fields(_C("record"))
    return V.table(spark, sf_dir, "orders").withColumn("record", record).select(
        "o_orderkey", "o_custkey", F.size(f).alias("n_fields"), F.try_element_at(f, F.lit(2)).alias("second"),
        F.try_element_at(f, F.lit(3)).alias("third"))


# ---- sinks ---------------------------------------------------------------

@query("snk2_result_tables_round_trip", f"""WITH {V.PAIRED} SELECT fmt, item, source, count(*) AS n, CAST(sum(h - y) AS BIGINT) AS total
FROM paired CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS fmt) GROUP BY 1, 2, 3""")
def snk2(spark, sf_dir):
    table = V.paired(spark, sf_dir).groupBy("item", "source").agg(F.count("*").alias("n"), F.sum(_C("h") - _C("y")).alias("total"))
    out = None
    first = work_path(spark, "table-parquet")
    O.write_table(table, first)
    for fmt in ("parquet", "csv", "json"):
        path = first
        if fmt != "parquet":
            path = work_path(spark, f"table-{fmt}")
            O.write_table(spark.read.schema(table.schema).parquet(first), path, fmt)
        back = spark.read.schema(table.schema).option("header", True).format(fmt).load(path).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("snk3_latest_wins_upsert", """WITH e AS (SELECT user_id, event_type, event_id, value FROM events)
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2""")
def snk3(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return O.upsert(old, new, ["user_id", "event_type"], "event_id")


@query("snk3_bucketed_upsert", """WITH e AS (SELECT user_id, event_type, event_id, value FROM events)
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2""")
def snk3_buckets(spark, sf_dir):
    """The same kept in a store of hash buckets: each upsert reads and replaces the buckets of its own keys."""
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    path = work_path(spark, "store")
    buckets.create(rows.where("event_id % 2 = 0"), path, ["user_id", "event_type"], ["event_id"], buckets=64)
    buckets.upsert(rows.where("event_id % 2 = 1"), path)
    return buckets.read(spark, path)


@query("snk4_progress_log", """SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def snk4(spark, sf_dir):
    path = work_path(spark, "progress")
    events = V.table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (0, 1):
        O.append_progress(events.where(_C("event_id") % 2 == part), path)
    back = spark.read.schema("event_id bigint, event_type string, at string").json(path)
    return back.where(_C("at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk5_report_from_saved_summary", f"""WITH {V.PAIRED} SELECT item, {', '.join(f"CAST(count(CASE WHEN source = '{s}' THEN 1 END) AS DOUBLE) AS {s}" for s in V.CANDIDATES)} FROM paired GROUP BY item""")
def snk5(spark, sf_dir):
    path = work_path(spark, "summary")
    counts = V.paired(spark, sf_dir).groupBy("item", "source").agg(F.count("*").cast("double").alias("n"))
    O.write_table(counts.unpivot(["item", "source"], ["n"], "statistic", "value"), path)
    saved = spark.read.schema("item string, source string, statistic string, value double").parquet(path)
    return saved.where("statistic = 'n'").groupBy("item").pivot("source", V.CANDIDATES).agg(F.max("value"))


@query("snk6_stacked_panel_table", f"""WITH {V.PAIRED}, a AS (SELECT source, count(*) AS n, CAST(sum(abs(h - y)) AS BIGINT) AS err FROM paired GROUP BY 1), b AS (SELECT item, count(*) AS n FROM paired GROUP BY 1)
SELECT 'a' AS panel, source, NULL AS item, 'n' AS measure, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 'a', source, NULL, 'err', err FROM a UNION ALL SELECT 'b', NULL, item, 'n', n FROM b""")
def snk6(spark, sf_dir):
    paired = V.paired(spark, sf_dir)
    a = paired.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.abs(_C("h") - _C("y"))).alias("err"))
    b = paired.groupBy("item").agg(F.count("*").alias("n"))
    return O.stack_panels({"a": (a, ["source"], ["n", "err"]), "b": (b, ["item"], ["n"])})


# ---- privacy -------------------------------------------------------------

def _id(column):
    return F.substring(F.md5(column.cast("string")), 1, 24)


def _id_columns(spark, sf_dir):
    k = _C("c_custkey")
    return [V.table(spark, sf_dir, "customer").select(F.when(k % 50 == 0, "nan").when(k % 50 == 1, "short").otherwise(_id(k))),
            V.table(spark, sf_dir, "orders").select(_id(_C("o_custkey"))), V.table(spark, sf_dir, "events").select(_id(_C("user_id")))]


_SQL_IDS = """ids AS (SELECT DISTINCT o AS original FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'nan' WHEN c_custkey % 50 = 1 THEN 'short' ELSE substr(md5(CAST(c_custkey AS VARCHAR)), 1, 24) END AS o FROM customer
  UNION SELECT substr(md5(CAST(o_custkey AS VARCHAR)), 1, 24) FROM orders UNION SELECT substr(md5(CAST(user_id AS VARCHAR)), 1, 24) FROM events) WHERE length(o) = 24)"""
_SQL_MAP = _SQL_IDS + """,
old AS (SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 24) AS original, printf('P%04d', c_custkey + 2) AS pseudonym FROM customer WHERE c_custkey % 3 = 0),
tot AS (SELECT count(*) AS n FROM (SELECT original FROM ids UNION SELECT original FROM old)),
fr AS (SELECT number, row_number() OVER (ORDER BY number) AS k FROM (SELECT unnest(range(1, (SELECT n + 1 FROM tot))) AS number) WHERE printf('P%04d', number) NOT IN (SELECT pseudonym FROM old)),
nw AS (SELECT original, row_number() OVER (ORDER BY md5('5|' || original), original) AS k FROM ids WHERE original NOT IN (SELECT original FROM old)),
mp AS (SELECT original, pseudonym FROM old UNION ALL SELECT nw.original, printf('P%04d', fr.number) FROM nw JOIN fr USING (k))"""


def _map(spark, sf_dir):
    old = V.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        _id(_C("c_custkey")).alias("original"), F.format_string("P%04d", _C("c_custkey") + 2).alias("pseudonym"))
    return X.extend_map(old, materialise(X.collect_ids(_id_columns(spark, sf_dir)), "ids"), 5)


@query("pii1_collect_ids", f"WITH {_SQL_IDS} SELECT original FROM ids")
def pii1(spark, sf_dir):
    return X.collect_ids(_id_columns(spark, sf_dir))


@query("pii2_pseudonym_map", f"WITH {_SQL_MAP} SELECT original, pseudonym FROM mp")
def pii2(spark, sf_dir):
    return _map(spark, sf_dir)


def _notes(spark, sf_dir):
    """Whole documents that mention an id twice, an id stuck to other letters, and a look-alike."""
    a = _id(_C("doc_id") % 900)
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", F.concat(
        "text", F.lit(" ref "), a, F.lit(", again ("), a, F.lit(") x"), a, F.lit(" RepresentsPayloadHeaders")).alias("note"))


_SQL_NOTES = """nt AS (SELECT d.doc_id, d.source, d.text, substr(md5(CAST(doc_id % 900 AS VARCHAR)), 1, 24) AS a FROM documents d)"""


@query("pii3_pseudonymise_text", f"""WITH {_SQL_MAP}, {_SQL_NOTES} SELECT doc_id, text || ' ref ' || coalesce(pseudonym, a) || ', again (' || coalesce(pseudonym, a) || ') x' || a || ' RepresentsPayloadHeaders' AS note,
CASE WHEN pseudonym IS NULL THEN 0 ELSE 2 END AS n_replaced FROM nt LEFT JOIN mp ON mp.original = a""")
def pii3(spark, sf_dir):
    return X.pseudonymise(_notes(spark, sf_dir), "doc_id", "note", materialise(_map(spark, sf_dir), "map")).select("doc_id", "note", "n_replaced")


@query("pii4_surviving_ids", f"""WITH {_SQL_IDS}, {_SQL_NOTES} SELECT source AS dataset, count(*) * 2 AS n_survivors, count(DISTINCT a) AS n_ids FROM nt JOIN ids ON ids.original = a GROUP BY 1""")
def pii4(spark, sf_dir):
    return X.surviving_ids(_notes(spark, sf_dir), _C("source"), "note", X.collect_ids(_id_columns(spark, sf_dir)))


@query("pii4_nothing_survives_the_rewrite", "SELECT source AS dataset, doc_id AS n_survivors, doc_id AS n_ids FROM documents WHERE false")
def pii4b(spark, sf_dir):
    mapping = materialise(_map(spark, sf_dir), "map")
    done = X.pseudonymise(_notes(spark, sf_dir), "doc_id", "note", mapping)
    return X.surviving_ids(done, _C("source"), "note", mapping.select("original"))


@query("pii4_survivors_of_a_partial_map", f"""WITH {_SQL_MAP}, {_SQL_NOTES} SELECT source AS dataset, count(*) * 2 AS n_survivors, count(DISTINCT a) AS n_ids
FROM nt JOIN mp ON mp.original = a WHERE CAST(substr(pseudonym, 2) AS BIGINT) % 2 = 1 GROUP BY 1""")
def pii4_partial(spark, sf_dir):
    """Half of the map is withheld from the rewrite: its ids, and no others, are found."""
    mapping = materialise(_map(spark, sf_dir), "map")
    done = X.pseudonymise(_notes(spark, sf_dir), "doc_id", "note", mapping.where("cast(substr(pseudonym, 2) as bigint) % 2 = 0"))
    return X.surviving_ids(done, _C("source"), "note", mapping.select("original"))


_W = r"\p{L}\p{N}_"
_SQL_PATTERNS = {
    "email": rf"[{_W}][{_W}.+-]*@[{_W}-]+\.[{_W}.]+[{_W}]",
    "phone": r"(^|[^0-9])[0-9][0-9\s().-]{8,}[0-9]($|[^0-9])",
    "url": r"https?://\S+|www\.\S+",
    "social_handle": rf"(^|[^{_W}@])@[A-Za-z][{_W}.]+[{_W}]",
    "uk_postcode": rf"(^|[^{_W}])[A-Z]{{1,2}}[0-9][A-Z0-9]?\s*[0-9][A-Z]{{2}}($|[^{_W}])",
    "uk_nino": rf"(^|[^{_W}])[A-CEGHJ-PR-TW-Z]{{2}}[0-9]{{6}}[A-D]($|[^{_W}])",
    "long_digit_run": r"[0-9]{9,}",
    "date_of_birth": rf"(?i)(^|[^{_W}])(born|dob|date of birth)[^{_W}.\n][^.\n]{{0,29}}[0-9]{{4}}",
    "self_names_me": rf"(?i)(^|[^{_W}])(my name is|i am called|call me|i''m called)($|[^{_W}])",
    "names_employer": rf"(?i)(^|[^{_W}])(i work (at|for)|my employer|my company|my boss)($|[^{_W}])",
    "names_location": rf"(?i)(^|[^{_W}])(i live in|i''m from|i am from|my address|my postcode)($|[^{_W}])",
    "prolific_mention": rf"(?i)(^|[^{_W}])prolific($|[^{_W}])",
}
_SQL_TEXTS = """tx AS (SELECT 'document' AS field, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 100000 + turn, text FROM conversations
  UNION ALL SELECT 'page', page_id, html FROM pages)"""


def _texts(spark, sf_dir):
    def part(name, field, key, text):
        return V.table(spark, sf_dir, name).select(F.lit(field).alias("field"), key.alias("id"), _C(text).alias("text"))

    return (part("documents", "document", _C("doc_id"), "text")
            .unionByName(part("conversations", "turn", _C("conv_id") * 100000 + _C("turn"), "text"))
            .unionByName(part("pages", "page", _C("page_id"), "html")))


@query("pii5_pattern_triage", f"""WITH {_SQL_TEXTS} """ + " UNION ALL ".join(
    f"SELECT field, '{k}' AS pattern, count(*) AS n_scanned, count(CASE WHEN regexp_matches(text, '{p}') THEN 1 END) AS n FROM tx WHERE trim(text) <> '' GROUP BY field"
    for k, p in _SQL_PATTERNS.items()))
def pii5(spark, sf_dir):
    return X.pattern_counts(_texts(spark, sf_dir), "field", "text")


@query("pii6_redacted_url_samples", f"""WITH {_SQL_TEXTS}, h AS (SELECT *, regexp_extract(text, 'https?://\\S+|www\\.\\S+') AS hit FROM tx),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id, text) AS k, instr(text, hit) AS p FROM h WHERE hit <> '')
SELECT field, id, 'url' AS pattern, '...' || replace(substr(text, greatest(1, p - 55), CAST(p - greatest(1, p - 55) AS BIGINT)), chr(10), ' ') || '[' || substr(hit, 1, 2) || repeat('*', length(hit) - 3)
  || right(hit, 1) || ']' || replace(substr(text, p + length(hit), 55), chr(10), ' ') || '...' AS snippet FROM k WHERE k <= 4""")
def pii6(spark, sf_dir):
    return X.pattern_samples(_texts(spark, sf_dir), "field", "id", "text", 4, [p for p in PII_PATTERNS if p[0] == "url"])


@query("pii6_redacted_samples_all_patterns")
def pii6_all(spark, sf_dir):
    return X.pattern_samples(_texts(spark, sf_dir), "field", "id", "text", 3)


@query("pii7_long_strings_by_path", """WITH p AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS t FROM documents)
SELECT doc_id, 'parts[' || (i - 1) || '].body' AS path, t[i] AS text FROM p, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) WHERE length(t[i]) > 15
UNION ALL SELECT doc_id, 'meta.source', source FROM p WHERE length(source) > 15""")
def pii7(spark, sf_dir):
    nested = F.struct(
        F.struct("lang", "source").alias("meta"),
        F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("body"), F.length(x).alias("n"))).alias("parts"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", nested.alias("doc"))
    return X.long_strings(docs, "doc_id", "doc")


@query("pii8_drop_identifying_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def pii8(spark, sf_dir):
    return X.drop_identifying(V.table(spark, sf_dir, "customer"), ["_name", "_nationkey", "_acctbal"])


_WORDS = {i: [f"Option {i} is a good choice.", f"Option {i} is a bad choice."] for i in V.ITEMS}
_SQL_ASSIGN = """sx AS (SELECT o_custkey AS subject, row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS idx FROM (SELECT DISTINCT o_custkey FROM orders)),
it AS (SELECT * FROM (VALUES ('A', 0, 9), ('N', 1, 3), ('R', 2, 1)) v(item, k, pw)),
asg AS (SELECT subject, item, CAST(instr(['012', '021', '102', '120', '201', '210'][CAST(('0x' || substr(md5('9|order|' || subject), 1, 8))::UBIGINT % 6 + 1 AS INT)], CAST(k AS VARCHAR)) AS INT) AS position,
  'package' || ((idx % 27) // pw % 3 + 1) AS cell, CAST(('0x' || substr(md5('9|messages|' || item || '|' || subject), 1, 8))::UBIGINT % 6 AS INT) AS message_order,
  'Option ' || item || CASE WHEN ('0x' || substr(md5('9|wording|' || item || '|' || subject), 1, 8))::UBIGINT % 2 = 0 THEN ' is a good choice.' ELSE ' is a bad choice.' END AS wording FROM sx CROSS JOIN it)"""


def _assigned(spark, sf_dir):
    subjects = V.table(spark, sf_dir, "orders").select(_C("o_custkey").alias("subject"))
    return X.assign_design(subjects, "subject", V.ITEMS, V.CELLS, _WORDS, 9)


@query("dsg1_counterbalanced_assignment", f"WITH {_SQL_ASSIGN} SELECT * FROM asg")
def dsg1(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("dsg1_balance_report", f"WITH {_SQL_ASSIGN} SELECT item, cell, count(*) AS n FROM asg GROUP BY 1, 2")
def dsg1_balance(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("item", "cell").agg(F.count("*").alias("n"))


# ---- regression ----------------------------------------------------------

def model_frame(spark, sf_dir):
    """Belief change of every source with the predictors of its subject."""
    people = demographics(spark, sf_dir).select("subject", "segment", "gender", "country").join(
        traits(spark, sf_dir), "subject")
    rows = V.panel(spark, sf_dir).select(
        "subject", "item", "round", "source", "polarity", "init", (_C("y") - _C("init")).alias("change"))
    return rows.join(people, "subject")


_SQL_FRAME = f"""{V.PANEL}, tr AS ({SQL_TRAITS}), mf AS (SELECT p.subject, p.item, p.round, p.source, p.polarity, p.init, p.y - p.init AS change, c_mktsegment AS segment, c_custkey % 70 + 18 AS age, tr.openness
  FROM panel p JOIN customer ON c_custkey = p.subject JOIN tr ON tr.subject = p.subject)"""


@query("reg1_grand_mean_centering", f"WITH {_SQL_FRAME} SELECT subject, item, round, source, {sq6('init - avg(init) OVER ()')} AS init_c, {sq6('age - avg(age) OVER ()')} AS age_c FROM mf")
def reg1(spark, sf_dir):
    out = G.centre(model_frame(spark, sf_dir), ["init", "age"])
    return out.select("subject", "item", "round", "source", r6(_C("init_centered")).alias("init_c"), r6(_C("age_centered")).alias("age_c"))


@query("reg2_binary_by_label", """SELECT c_custkey AS subject, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE 'Other' END AS segment FROM customer""")
def reg2(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        _C("c_custkey").alias("subject"), G.binary_by_label(_C("c_mktsegment"), "BUILDING").alias("segment"))


@query("reg3_dominance_collapse", """SELECT c_custkey AS subject, CASE WHEN c_custkey % 10 < 9 THEN 0 ELSE 1 END AS region_grouped, CAST(NULL AS INT) AS half_grouped FROM customer""")
def reg3(spark, sf_dir):
    k = _C("c_custkey")
    people = V.table(spark, sf_dir, "customer").select(
        k.alias("subject"), F.when(k % 10 < 9, "home").otherwise(F.concat(F.lit("r"), k % 7)).alias("region"),
        F.when(k % 2 == 0, "even").otherwise("odd").alias("half"))
    return G.dominance(people, ["region", "half"]).select("subject", "region_grouped", "half_grouped")


@query("reg4_pool_rare_levels", """WITH b AS (SELECT p_partkey, p_brand || '/' || p_size AS level FROM part), c AS (SELECT level, count(*) AS n FROM b GROUP BY 1)
SELECT p_partkey, CASE WHEN n < 5 THEN 'Other' ELSE level END AS level FROM b JOIN c USING (level)""")
def reg4(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_size").alias("level"))
    return G.pool_rare(parts, "level")


@query("reg5_dummy_coding", """SELECT c_custkey AS subject, """ + ", ".join(
    f"""CASE WHEN c_mktsegment = '{s}' THEN 1e0 ELSE 0e0 END AS "C(segment)[T.{s}]" """ for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")) + " FROM customer")
def reg5(spark, sf_dir):
    people = V.table(spark, sf_dir, "customer").select(
        _C("c_custkey").alias("subject"), _C("c_mktsegment").alias("segment"), F.lit(1).alias("fixed"))
    coded, names = G.dummies(people, "segment", G.levels_of(people, "segment", "MACHINERY"))
    return coded.select("subject", *[f"`{n}`" for n in names])


@query("reg6_outcomes_per_source", f"WITH {_SQL_FRAME} SELECT source, count(change) AS n, count(DISTINCT CASE WHEN change IS NOT NULL THEN subject END) AS n_subjects FROM mf GROUP BY source")
def reg6(spark, sf_dir):
    per = model_frame(spark, sf_dir).where(_C("change").isNotNull()).groupBy("source", "subject").agg(F.count("*").alias("m"))
    return per.groupBy("source").agg(F.sum("m").alias("n"), F.count("*").alias("n_subjects"))


@query("reg7_cross_products", f"""WITH {_SQL_FRAME}, x AS (SELECT source, CAST(init AS DOUBLE) AS c0, CAST(age AS DOUBLE) AS c1, CAST(change AS DOUBLE) AS c2 FROM mf WHERE change IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT source, {i} AS i, {j} AS j, {sq6(f'sum(c{i} * c{j})')} AS value FROM x GROUP BY source" for i in range(3) for j in range(i, 3)))
def reg7_gram(spark, sf_dir):
    rows = model_frame(spark, sf_dir).where(_C("change").isNotNull())
    return G.cross_products(rows, ["source"], ["init", "age", "change"]).withColumn("value", r6(_C("value")))


@query("reg7_least_squares_one_predictor", f"""WITH {_SQL_FRAME}, f AS (SELECT source, regr_slope(change, init) AS b, regr_intercept(change, init) AS a, regr_count(change, init) AS n FROM mf GROUP BY source)
SELECT source, 'Intercept' AS variable, {sq6('a')} AS coefficient, n FROM f UNION ALL SELECT source, 'init', {sq6('b')}, n FROM f""")
def reg7(spark, sf_dir):
    out = G.ols(model_frame(spark, sf_dir), "source", ["init"], "change")
    return out.select("source", "variable", r6(_C("coefficient")).alias("coefficient"), "n")


def _design(spark, sf_dir):
    frame = G.centre(materialise(model_frame(spark, sf_dir), "frame"), ["init", "age", "openness"])
    names = []
    for column, levels in (("item", V.ITEMS), ("gender", ["Female", "Male", "Other"]), ("polarity", ["1", "-1"])):
        frame, added = G.dummies(frame, column, levels)
        names += added
    return frame, G.varying(frame, ["init_centered", "age_centered", "openness_centered", *names])


def _rounded(table):
    return table.select("source", "variable", *[F.round(c, 4).alias(c) for c in ("coefficient", "std_error", "z_value", "p_value")],
                        "significance", "n")


_ABSORBED = f"""{_SQL_FRAME}, ab AS (SELECT source, subject, CAST(init AS DOUBLE) AS x, CAST(change AS DOUBLE) AS y FROM mf WHERE change IS NOT NULL),
wi AS (SELECT source, regr_slope(y - my, x - mx) AS b, count(*) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY source, subject) AS mx, avg(y) OVER (PARTITION BY source, subject) AS my FROM ab) GROUP BY source),
le AS (SELECT source, subject, avg(y) - max(b) * avg(x) AS a, max(n) AS n FROM ab JOIN wi USING (source) GROUP BY 1, 2),
fs AS (SELECT min(subject) AS first FROM ab)"""


@query("reg7_absorbed_subjects", f"""WITH {_ABSORBED} SELECT source, 'init' AS variable, {sq6('b')} AS coefficient, n FROM wi
UNION ALL SELECT le.source, 'Intercept', {sq6('le.a')}, le.n FROM le, fs WHERE subject = first
UNION ALL SELECT le.source, 'C(subject)[T.' || le.subject || ']', {sq6('le.a - z.a')}, le.n FROM le JOIN (SELECT source, a FROM le, fs WHERE subject = first) z USING (source), fs WHERE subject <> first""")
def reg7_absorbed(spark, sf_dir):
    """Change on the initial belief with an effect of every subject: as many levels as subjects, none of them listed."""
    frame = materialise(model_frame(spark, sf_dir).select("source", "subject", "init", "change"), "frame")
    first = frame.where("change is not null").agg(F.min("subject").cast("string").alias("v")).first()["v"]
    out = G.absorbed_ols(frame, "source", ["init"], {}, "subject", first, "change")
    return out.select("source", "variable", r6(_C("coefficient")).alias("coefficient"), "n")


_PROFILE = [-6.0, -4.0, -2.0, 0.0, 2.0]


@query("reg8_profile_deviance", f"""WITH {_SQL_FRAME}, g AS (SELECT source, subject, count(*) AS m, CAST(sum(change) AS DOUBLE) AS s, CAST(sum(change * change) AS DOUBLE) AS q FROM mf WHERE change IS NOT NULL GROUP BY 1, 2),
t AS (SELECT unnest({_PROFILE!r}) AS log_theta), w AS (SELECT *, exp(log_theta) AS th FROM g, t),
p AS (SELECT source, log_theta, sum(m) AS n, sum(m / (1 + th * m)) AS a, sum(s / (1 + th * m)) AS b, sum(q - th * s * s / (1 + th * m)) AS c, sum(ln(1 + th * m)) AS pen FROM w GROUP BY 1, 2)
SELECT source, log_theta, {sq6('(n - 1) * ln((c - b * b / a) / (n - 1)) + pen + ln(a)')} AS deviance FROM p""")
def reg8_profile(spark, sf_dir):
    """The REML profile of the model with an intercept only."""
    frame = materialise(model_frame(spark, sf_dir).select("source", "subject", "change"), "frame")
    out = G.profile_deviance(frame, "source", "subject", [], "change", _PROFILE)
    return out.withColumn("deviance", r6(_C("deviance")))


@query("reg9_variance_component_as_least_squares")
def reg9(spark, sf_dir):
    frame, names = _design(spark, sf_dir)
    return _rounded(G.ols(frame, "source", names, "change"))


def _mixed(spark, sf_dir):
    frame, names = _design(spark, sf_dir)
    return G.random_intercept(frame, "source", "subject", names, "change")


@query("reg8_random_intercept_reml")
def reg8(spark, sf_dir):
    return _mixed(spark, sf_dir).select("source", "variable", F.round("coefficient", 4).alias("coefficient"),
                                        F.round("std_error", 4).alias("std_error"), F.round("theta", 3).alias("theta"))


@query("reg10_coefficient_table")
def reg10(spark, sf_dir):
    return _rounded(_mixed(spark, sf_dir))


# A coefficient table stated in SQL: slope of change on each predictor, per source and item.
_SQL_COEF = f"""{_SQL_FRAME}, lp AS (SELECT source, 'init' AS variable, change, CAST(init AS DOUBLE) AS x FROM mf WHERE change IS NOT NULL UNION ALL SELECT source, 'age', change, age FROM mf WHERE change IS NOT NULL
  UNION ALL SELECT source, 'openness', change, openness FROM mf WHERE change IS NOT NULL),
ct AS (SELECT source, variable, {sq6('regr_slope(change, x)')} AS coefficient, {sq6('corr(change, x) * sqrt(count(*))')} AS z_value FROM lp GROUP BY 1, 2)"""


def _coefficients(spark, sf_dir):
    long = model_frame(spark, sf_dir).where(_C("change").isNotNull()).select(
        "source", "change", *[_C(c).cast("double").alias(c) for c in ("init", "age", "openness")]).unpivot(
        ["source", "change"], ["init", "age", "openness"], "variable", "x")
    y, x = _C("change"), _C("x")
    return long.groupBy("source", "variable").agg(
        r6(F.regr_slope(y, x)).alias("coefficient"), r6(F.corr(y, x) * F.sqrt(F.count("*"))).alias("z_value"))


@query("reg11_notable_terms", f"WITH {_SQL_COEF} SELECT * FROM ct WHERE variable IN (SELECT variable FROM ct WHERE abs(z_value) > 2)")
def reg11(spark, sf_dir):
    return G.notable(_coefficients(spark, sf_dir))


@query("reg11_notable_in_baseline", f"WITH {_SQL_COEF} SELECT * FROM ct WHERE variable IN (SELECT variable FROM ct WHERE abs(z_value) > 2 AND source = 'baseline')")
def reg11b(spark, sf_dir):
    return G.notable(_coefficients(spark, sf_dir), only=V.BASELINE)


@query("reg12_comparison_pivot", f"WITH {_SQL_COEF} SELECT variable, {', '.join(f'''max(CASE WHEN source = '{s}' THEN z_value END) AS {s}''' for s in V.SOURCES)} FROM ct GROUP BY variable")
def reg12(spark, sf_dir):
    return G.compare(_coefficients(spark, sf_dir), V.SOURCES, "z_value")


@query("reg13_term_labels", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Intercept' WHEN 1 THEN 'Initial Belief' WHEN 2 THEN 'gender = ' || p_brand || ' (vs Female)'
  WHEN 3 THEN CASE p_size % 4 WHEN 0 THEN 'ethnicity = 1.0 (vs reference)' WHEN 1 THEN 'ethnicity = Other (vs reference)' WHEN 2 THEN 'gender = Other (vs Female)' ELSE 'gender = Reference' END WHEN 4 THEN 'age' ELSE 'Topic: Penalty (vs UBI)' END AS label FROM part""")
def reg13(spark, sf_dir):
    k = _C("p_partkey") % 6
    term = (F.when(k == 0, "Intercept").when(k == 1, "initial_belief_normalized_centered")
            .when(k == 2, F.concat(F.lit("C(gender)[T."), "p_brand", F.lit("]"))).when(k == 3, F.element_at(F.array(*[F.lit(t) for t in (
                "C(ethnicity)[T.1.0]", "C(ethnicity)[T.1]", "gender[2]", "C(gender)[0]")]), (_C("p_size") % 4 + 1).cast("int")))
            .when(k == 4, "age_centered").otherwise("C(topic)[T.Penalty]"))
    return V.table(spark, sf_dir, "part").select("p_partkey", N.term_label(term, {"gender": "Female"}).alias("label"))


# ---- streams -------------------------------------------------------------

_EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(_EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("str1_stream_latest_wins", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def str1(spark, sf_dir):
    log, keys, order = work_path(spark, "log"), ["user_id", "event_type"], ["ts", "event_id"]
    stream = _event_stream(spark, sf_dir).drop("props")
    live.upsert_stream(stream, keys, order, log, work_path(spark, "cp")).awaitTermination()
    return live.read_latest(spark, log, keys, order).select("user_id", "event_type", "event_id", "value")


@query("str1_compacted_log", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def str1_compacted(spark, sf_dir):
    """The same with several micro-batches, folded into generations while the stream goes on."""
    log, fed, keys, order = work_path(spark, "log"), work_path(spark, "fed"), ["user_id", "event_type"], ["ts", "event_id"]
    V.table(spark, sf_dir, "events").drop("props").repartition(6, "event_id").write.parquet(fed)
    stream = spark.readStream.schema(spark.read.parquet(fed).schema).option("maxFilesPerTrigger", 2).parquet(fed)
    live.upsert_stream(stream, keys, order, log, work_path(spark, "cp"), compact_every=2).awaitTermination()
    return live.read_latest(spark, log, keys, order).select("user_id", "event_type", "event_id", "value")


@query("str2_stream_run_health", """SELECT event_type, count(*) AS n, count(CASE WHEN value > 5 THEN 1 END) AS valid, CAST(max(floor(value)) AS BIGINT) AS tok_max, CAST(quantile_disc(floor(value), 0.5) AS BIGINT) AS tok_median FROM events GROUP BY 1""")
def str2(spark, sf_dir):
    out = work_path(spark, "health")
    stream = _event_stream(spark, sf_dir).select("event_type", F.floor("value").alias("tokens"), (_C("value") > 5).alias("ok"))
    live.health_stream(stream, "event_type", "tokens", "ok", out, work_path(spark, "cp")).awaitTermination()
    return live.newest_batch(spark, out)


@query("str3_exactly_once_restart", """SELECT event_type, count(*) AS n_keys FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def str3(spark, sf_dir):
    log, cp, keys, order = work_path(spark, "log"), work_path(spark, "cp"), ["user_id", "event_type"], ["ts", "event_id"]
    # Started twice on one checkpoint: the second start finds nothing new.
    for _ in range(2):
        live.upsert_stream(_event_stream(spark, sf_dir).drop("props"), keys, order, log, cp).awaitTermination()
    return spark.read.parquet(log).groupBy("event_type").agg(F.count("*").alias("n_keys"))
