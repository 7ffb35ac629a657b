"""Queries for projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom import schema as S
from paneloom.functions import ranks as R
from paneloom.functions import responses as parse
from paneloom.functions import scalars as N
from paneloom.functions import text as X
from paneloom.operators import conform as C
from paneloom.plans import tables as V
from paneloom.plans.registry import query

_C = F.col
_ID = ["subject", "item", "round", "source"]


@query("prj1_polarity_flip", f"""WITH {V.RESP}
SELECT subject, item, round, source, raw * polarity AS raw, stance_raw * polarity AS stance_raw, r1 FROM resp""")
def prj1(spark, sf_dir):
    resp = V.responses(spark, sf_dir).select(*_ID, "statement", "raw", "stance_raw", "r1")
    return C.flip(resp, ["raw", "stance_raw"], "statement", V.NEGATIVE).drop("statement")


@query("prj2_polarity_lookup", f"""WITH {V.RESP}
SELECT statement, polarity, count(*) AS n FROM resp GROUP BY 1, 2""")
def prj2(spark, sf_dir):
    found = N.polarity(_C("statement"), V.POSITIVE, V.NEGATIVE)
    return V.responses(spark, sf_dir).groupBy("statement", found.alias("polarity")).agg(F.count("*").alias("n"))


@query("prj3_raw_and_normalised", f"""WITH {V.RESP}
SELECT subject, item, round, source, raw AS raw_new_belief, raw * polarity AS normalized_new_belief FROM resp""")
def prj3(spark, sf_dir):
    pol = N.polarity(_C("statement"), V.POSITIVE, V.NEGATIVE)
    return V.responses(spark, sf_dir).select(
        *_ID, _C("raw").alias("raw_new_belief"), (_C("raw") * pol).alias("normalized_new_belief"))


@query("prj4_topic_by_keyword", """SELECT topic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
  SELECT n_chars, CASE WHEN lower(text) LIKE '%ubi%' OR lower(text) LIKE '%universal basic income%' THEN 'UBI'
    WHEN lower(text) LIKE '%penalty%' OR lower(text) LIKE '%shootout%' THEN 'Penalty'
    WHEN lower(text) LIKE '%ozempic%' OR lower(text) LIKE '%weight loss%' THEN 'Weight Loss'
    ELSE 'Other' END AS topic FROM documents) GROUP BY topic""")
def prj4(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.groupBy(N.topic_by_keyword(_C("text")).alias("topic")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("prj5_decode_code", """SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one'
  WHEN 2 THEN 'two' ELSE CAST(c_nationkey AS VARCHAR) END AS nation_label FROM customer""")
def prj5(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", N.decode(_C("c_nationkey"), {0: "zero", 1: "one", 2: "two"}).alias("nation_label"))


@query("prj6_decode_or_keep", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Build'
  WHEN 'MACHINERY' THEN 'Machine' ELSE c_mktsegment END AS segment FROM customer""")
def prj6(spark, sf_dir):
    mapping = {"BUILDING": "Build", "MACHINERY": "Machine"}
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", N.decode_or_keep(_C("c_mktsegment"), mapping).alias("segment"))


@query("prj7_country_name", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '  '
  ELSE ' n' || c_nationkey END AS code FROM customer),
d AS (SELECT 'N' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey < 20)
SELECT c_custkey, coalesce(d.name, nullif(trim(c.code), '')) AS country
FROM c LEFT JOIN d ON d.code = upper(trim(c.code))""")
def prj7(spark, sf_dir):
    raw = F.when(_C("c_custkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" n"), "c_nationkey"))
    people = V.table(spark, sf_dir, "customer").select("c_custkey", N.tidy(raw).alias("code"))
    names = V.table(spark, sf_dir, "nation").where("n_nationkey < 20").select(
        F.concat(F.lit("N"), "n_nationkey").alias("key"), _C("n_name").alias("name"))
    return people.join(names, F.upper("code") == _C("key"), "left").select(
        "c_custkey", F.coalesce("name", "code").alias("country"))


@query("prj8_tidy_text", """SELECT p_partkey, nullif(trim(CASE WHEN p_size % 7 = 0 THEN '   '
  ELSE '  ' || p_name || ' ' END), '') AS name FROM part""")
def prj8(spark, sf_dir):
    padded = F.when(_C("p_size") % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return V.table(spark, sf_dir, "part").select("p_partkey", N.tidy(padded).alias("name"))


_SQL_MESSY = """CASE o_orderkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' WHEN 2 THEN CAST(o_totalprice AS VARCHAR)
  WHEN 3 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN 4 THEN '-' || CAST(o_custkey AS VARCHAR) || '.7' END"""


def _messy(spark, sf_dir):
    k = _C("o_orderkey") % 6
    key = _C("o_custkey").cast("string")
    text = (F.when(k == 0, "abc").when(k == 1, " ").when(k == 2, _C("o_totalprice").cast("string"))
            .when(k == 3, F.concat(key, F.lit(".0"))).when(k == 4, F.concat(F.lit("-"), key, F.lit(".7"))))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", text.alias("messy"))


@query("prj9_lenient_int", f"""SELECT o_orderkey, o_custkey,
CAST(trunc(TRY_CAST({_SQL_MESSY} AS DOUBLE)) AS INT) AS value FROM orders""")
def prj9(spark, sf_dir):
    return _messy(spark, sf_dir).select("o_orderkey", "o_custkey", N.lenient_int(_C("messy")).alias("value"))


@query("prj10_strict_int", f"""WITH m AS (SELECT o_orderkey, o_custkey, TRY_CAST({_SQL_MESSY} AS DOUBLE) AS d FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN d = floor(d) THEN CAST(d AS BIGINT) END AS value FROM m""")
def prj10(spark, sf_dir):
    return _messy(spark, sf_dir).select("o_orderkey", "o_custkey", N.strict_int(_C("messy")).alias("value"))


@query("prj11_numeric_coercion", f"""SELECT o_orderkey, o_custkey, TRY_CAST({_SQL_MESSY} AS DOUBLE) AS value FROM orders""")
def prj11(spark, sf_dir):
    return _messy(spark, sf_dir).select("o_orderkey", "o_custkey", N.number(_C("messy")).alias("value"))


@query("prj12_wide_to_long", """SELECT c_custkey, item, belief FROM (
  SELECT c_custkey, 'x' AS item, c_custkey % 5 - 2 AS belief FROM customer
  UNION ALL SELECT c_custkey, 'y', c_nationkey % 5 - 2 FROM customer
  UNION ALL SELECT c_custkey, 'z', CAST(floor(c_acctbal) AS BIGINT) % 3 FROM customer)""")
def prj12(spark, sf_dir):
    wide = V.table(spark, sf_dir, "customer").select(
        "c_custkey", (_C("c_custkey") % 5 - 2).alias("survey.belief_x"),
        (_C("c_nationkey") % 5 - 2).cast("bigint").alias("survey.belief_y"),
        (F.floor("c_acctbal") % 3).alias("survey.belief_z"))
    long = C.topics_long(wide, ["x", "y", "z"], {"belief": "survey.belief_{item}"})
    return long.select("c_custkey", "_t.item", "_t.belief")


@query("prj13_presentation_order", """SELECT c_custkey, CAST(i - 1 AS INT) AS position, t[i] AS item FROM (
  SELECT c_custkey, list_filter([CASE WHEN c_custkey % 4 <> 0 THEN 'first' END, 'second',
    CASE WHEN c_custkey % 3 <> 0 THEN 'third' END], lambda x: x IS NOT NULL) AS t FROM customer),
  LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)""")
def prj13(spark, sf_dir):
    order = F.array(F.when(_C("c_custkey") % 4 != 0, "first"), F.lit("second"),
                    F.when(_C("c_custkey") % 3 != 0, "third"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", C.topic_positions(order).alias("position", "item"))


@query("prj14_ordered_messages", """WITH o AS (SELECT c_custkey, c_mktsegment,
  CAST(greatest(0, least(5, coalesce(CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey % 10 - 1 END, 0))) AS INT) AS i
  FROM customer)
SELECT c_custkey, slot, CAST(substr(['123','132','213','231','312','321'][i + 1], slot, 1) AS BIGINT) AS source_message_id,
  c_mktsegment || '-' || substr(['123','132','213','231','312','321'][i + 1], slot, 1) AS text
FROM o CROSS JOIN (SELECT unnest([1, 2, 3]) AS slot)""")
def prj14(spark, sf_dir):
    index = F.when(_C("c_custkey") % 10 == 9, None).otherwise(_C("c_custkey") % 10 - 1)
    bank = F.create_map(*[p for m in (1, 2, 3) for p in (F.lit(m), F.concat("c_mktsegment", F.lit(f"-{m}")))])
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(C.shown_messages(index, _C("c_mktsegment"), bank)).alias("m")).select(
        "c_custkey", _C("m.shown_comment_id").cast("int").alias("slot"), "m.source_message_id", "m.text")


@query("prj15_canonical_messages", """SELECT c_custkey, slot, CAST((c_custkey + slot) % 3 + 1 AS BIGINT) AS source_message_id,
  CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment WHEN slot = 1 THEN c_mktsegment ELSE 'own' END AS package,
  CASE WHEN c_custkey % 2 = 0 THEN 'said ' || slot WHEN (c_custkey + slot) % 3 + 1 < 3
    THEN 'bank ' || ((c_custkey + slot) % 3 + 1) END AS text
FROM customer CROSS JOIN (SELECT unnest([1, 2]) AS slot)""")
def prj15(spark, sf_dir):
    def mid(slot):
        return ((_C("c_custkey") + slot) % 3 + 1).cast("string")

    objects = F.concat(
        F.lit('[{"source_message_id": '), mid(1), F.lit(', "text": "said 1"}, {"shown_comment_id": 2, "source_message_id": '),
        mid(2), F.lit(', "package": "own", "text": "said 2"}]'))
    bare = F.concat(F.lit("["), mid(1), F.lit(", "), mid(2), F.lit("]"))
    raw = F.when(_C("c_custkey") % 2 == 0, objects).otherwise(bare)
    bank = F.create_map(F.lit(1), F.lit("bank 1"), F.lit(2), F.lit("bank 2"))
    messages = C.canonical_messages(_C("raw"), _C("c_mktsegment"), bank)
    return (V.table(spark, sf_dir, "customer").withColumn("raw", raw)
            .select("c_custkey", F.explode(messages).alias("m"))
            .select("c_custkey", _C("m.shown_comment_id").cast("int").alias("slot"), "m.source_message_id",
                    "m.package", "m.text"))


@query("prj16_canonical_demographic", """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 60 + 18 END AS age,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS occupation_field, CAST(NULL AS VARCHAR) AS gender,
  c_custkey % 9 / 2 AS openness, c_custkey % 5 - 2 AS item_1 FROM customer""")
def prj16(spark, sf_dir):
    blob = F.when(_C("c_custkey") % 7 != 0, F.to_json(F.struct(
        (_C("c_custkey") % 60 + 18).alias("age"), _C("c_mktsegment").alias("occupation_field"),
        F.lit("x").alias("unknown_key"))))
    big5 = F.struct(*[(_C("c_custkey") % 9 / 2).alias(t) for t in S.TRAITS])
    items = F.array(*[_C("c_custkey") % 5 - 2 for _ in range(10)])
    demo = C.canonical_demographic(blob, big5, items)
    return V.table(spark, sf_dir, "customer").select("c_custkey", demo.alias("d")).select(
        "c_custkey", "d.age", "d.occupation_field", "d.gender", "d.big5.openness",
        _C("d.big5_items")[0].alias("item_1"))


@query("prj17_embedded_json_field", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def prj17(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("prj18_json_or_raw", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
  ELSE json_extract_string(props, '$.k') END AS value FROM events""")
def prj18(spark, sf_dir):
    mixed = F.when(_C("event_id") % 3 == 0, _C("event_type")).otherwise(_C("props"))
    v = C.json_or_text(mixed)
    return V.table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.try_variant_get(v, "$.k", "string"), F.try_variant_get(v, "$", "string")).alias("value"))


@query("prj19_belief_change", f"""WITH {V.PANEL}
SELECT subject, item, round, source, y - init AS delta, abs(y - init) AS abs_delta FROM panel""")
def prj19(spark, sf_dir):
    d = _C("y") - _C("init")
    return V.panel(spark, sf_dir).select(*_ID, d.alias("delta"), F.abs(d).alias("abs_delta"))


def item_columns():
    """Ten personality items derived from the customer key."""
    return [((F.floor(_C("c_custkey") / i) + i) % 5 - 2) for i in range(1, 11)]


SQL_TRAITS = """SELECT c_custkey AS subject, (-b1 + b6) / 2 + 3 AS extraversion, (b2 - b7) / 2 + 3 AS agreeableness,
  (-b3 + b8) / 2 + 3 AS conscientiousness, (-b4 + b9) / 2 + 3 AS neuroticism, (-b5 + b10) / 2 + 3 AS openness FROM (
  SELECT c_custkey, """ + ", ".join(f"(c_custkey // {i} + {i}) % 5 - 2 AS b{i}" for i in range(1, 11)) + " FROM customer)"


@query("prj20_trait_scores", SQL_TRAITS)
def prj20(spark, sf_dir):
    scores = N.trait_scores(item_columns(), S.TRAIT_KEYS)
    return V.table(spark, sf_dir, "customer").select(
        _C("c_custkey").alias("subject"), *[c.alias(t) for t, c in scores.items()])


@query("prj21_personality_block", """SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'No personality data provided.' ELSE
  's.big2: ' || (c_custkey % 3) || chr(10) || 's.big10: ' || (c_custkey % 5) || chr(10) || 'other: 9' END AS block FROM customer""")
def prj21(spark, sf_dir):
    items = F.create_map(F.lit("other"), F.lit(9).cast("bigint"), F.lit("s.big10"), _C("c_custkey") % 5,
                         F.lit("s.big2"), _C("c_custkey") % 3)
    none = F.create_map().cast("map<string,bigint>")
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", X.personality_block(F.when(_C("c_custkey") % 8 == 0, none).otherwise(items)).alias("block"))


_SQL_PROFILE = """'age: ' || coalesce(CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 60 + 18 END AS VARCHAR), 'None')
  || chr(10) || 'gender: ' || c_mktsegment || chr(10) || 'balance: ' || CAST(c_nationkey AS VARCHAR)
  || chr(10) || 'zone: ' || c_custkey"""


def _profile():
    return X.profile_block({
        "zone": _C("c_custkey"), "balance": _C("c_nationkey"), "gender": _C("c_mktsegment"),
        "age": F.when(_C("c_custkey") % 5 == 0, None).otherwise(_C("c_custkey") % 60 + 18)})


@query("prj22_profile_block", f"SELECT c_custkey, {_SQL_PROFILE} AS block FROM customer")
def prj22(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select("c_custkey", _profile().alias("block"))


@query("prj23_comments_block", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)
SELECT doc_id, list_aggregate(list_transform(range(1, len(t) + 1), lambda i: 'Comment ' || i || ':' || chr(10) || trim(t[i])), 'string_agg', chr(10) || chr(10)) AS block FROM l""")
def prj23(spark, sf_dir):
    messages = F.transform(F.split("text", "\n"), lambda m, i: F.struct(
        (i + 1).alias("shown_comment_id"), m.alias("text")))
    return V.table(spark, sf_dir, "documents").select("doc_id", X.comments_block(messages).alias("block"))


_TEMPLATES = [
    ("full", "Profile:\n{demographic_block}\nBelief on {statement_formulation}: {init_belief} ({familiarity})"),
    ("no-persona", "Belief on {statement_formulation}: {init_belief}"),
    ("all-positive", "Answer {statement_formulation} from {init_belief}"),
]


@query("prj24_prompt_table", f"""WITH p AS (SELECT c_custkey, {_SQL_PROFILE} AS block,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE 'plan {{topic}} ' || c_mktsegment END AS st,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 5 - 2 END AS b,
  CASE WHEN c_custkey % 3 = 0 THEN 'Not provided' ELSE CAST(c_custkey % 4 AS VARCHAR) END AS fam FROM customer)
SELECT c_custkey, condition, CASE condition
  WHEN 'full' THEN 'Profile:' || chr(10) || block || chr(10) || 'Belief on ' || st || ': ' || b || ' (' || fam || ')'
  WHEN 'no-persona' THEN 'Belief on ' || st || ': ' || b
  ELSE 'Answer ' || CASE WHEN st = 'plan {{topic}} BUILDING' THEN 'build is good' ELSE st END || ' from ' || b END AS prompt
FROM p CROSS JOIN (SELECT unnest(['full', 'no-persona', 'all-positive']) AS condition)
WHERE trim(st) <> '' AND b IS NOT NULL""")
def prj24(spark, sf_dir):
    k = _C("c_custkey")
    subjects = V.table(spark, sf_dir, "customer").select(
        "c_custkey", _profile().alias("demographic_block"), F.lit("").alias("personality_block"),
        F.lit("t").alias("topic"),
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit("plan {topic} "), "c_mktsegment")).alias("statement"),
        F.when(k % 13 == 0, None).otherwise(k % 5 - 2).alias("init_belief"),
        F.when(k % 3 == 0, None).otherwise(k % 4).alias("familiarity"), F.lit("").alias("comments_block"),
        F.lit("{}").alias("json_example"),
        F.explode(F.array(*[F.lit(c) for c, _ in _TEMPLATES])).alias("condition"))
    templates = V.inline(spark, ["condition", "template"], _TEMPLATES)
    override = V.inline(spark, ["condition", "statement", "wording"],
                        [("all-positive", "plan {topic} BUILDING", "build is good")])
    return C.prompts(subjects, templates, override).select("c_custkey", "condition", "prompt")


@query("prj25_statement_override", f"""WITH {V.RESP}
SELECT subject, item, round, source, 'Option ' || item || ' is a good choice.' AS all_positive,
  'Option ' || item || ' is a bad choice.' AS all_negative FROM resp""")
def prj25(spark, sf_dir):
    rows = [(w, p, n) for p, n in zip(V.POSITIVE, V.NEGATIVE) for w in (p, n)]
    wording = V.inline(spark, ["statement", "all_positive", "all_negative"], rows)
    return V.responses(spark, sf_dir).join(wording, "statement").select(*_ID, "all_positive", "all_negative")


def _raw(spark, sf_dir):
    return V.with_raw_text(V.responses(spark, sf_dir))


@query("prj26_strip_reasoning", f"""WITH {V.PARSED} SELECT subject, item, round, source, t AS body FROM cut""")
def prj26(spark, sf_dir):
    return _raw(spark, sf_dir).select(*_ID, parse.drop_reasoning_prefix(_C("raw_response")).alias("body"))


_SQL_CLEAN = """c1 AS (SELECT *, trim(regexp_replace(raw_response, '(?is)<think>.*?</think>', '', 'g'), ' ' || chr(10)) AS c FROM texts),
c2 AS (SELECT * REPLACE (CASE WHEN c LIKE '```%```' THEN trim(substr(c, 4, length(c) - 6), ' ' || chr(10)) ELSE c END AS c) FROM c1),
clean AS (SELECT * REPLACE (CASE WHEN c LIKE 'json%' THEN trim(substr(c, 5), ' ' || chr(10)) ELSE c END AS c) FROM c2)"""


@query("prj27_clean_response", f"""WITH {V.RAW_TEXT}, {_SQL_CLEAN} SELECT subject, item, round, source, c AS body FROM clean""")
def prj27(spark, sf_dir):
    return _raw(spark, sf_dir).select(*_ID, parse.clean_response(_C("raw_response")).alias("body"))


@query("prj28_coercing_parser", f"""WITH {V.PARSED}
SELECT subject, item, round, source, CASE WHEN usable THEN b END AS new_belief, CASE WHEN usable THEN s END AS stance,
  CASE WHEN usable THEN k1 || ',' || k2 || ',' || k3 END AS ranking, CASE WHEN usable THEN why END AS reasoning FROM parsed""")
def prj28(spark, sf_dir):
    return parse.with_coerced(_raw(spark, sf_dir), "raw_response").select(
        *_ID, "parsed.new_belief", _C("parsed.general_public_stance").alias("stance"),
        F.when(_C("parsed").isNotNull(), F.array_join("parsed.ranking", ",")).alias("ranking"), "parsed.reasoning")


_SQL_STRICT = _SQL_CLEAN + """, so AS (SELECT *, CASE WHEN json_valid(c) AND c LIKE '{%' THEN c END AS j FROM clean),
strict AS (SELECT *,
  CASE WHEN json_type(j, '$.new_belief') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.new_belief') AS INT) END AS b,
  CASE WHEN json_type(j, '$.general_public_stance') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.general_public_stance') AS INT) END AS s,
  CASE WHEN json_type(j, '$.reasoning') = 'VARCHAR' THEN json_extract_string(j, '$.reasoning') END AS why,
  concat_ws(',', CASE WHEN json_type(j, '$.ranking[0]') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(j, '$.ranking[0]') END,
    CASE WHEN json_type(j, '$.ranking[1]') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(j, '$.ranking[1]') END,
    CASE WHEN json_type(j, '$.ranking[2]') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(j, '$.ranking[2]') END) AS rk FROM so)"""


@query("prj29_strict_parser", f"""WITH {V.RAW_TEXT}, {_SQL_STRICT}
SELECT subject, item, round, source, b AS new_belief, s AS stance, rk AS ranking, why AS reasoning FROM strict""")
def prj29(spark, sf_dir):
    return parse.with_strict(_raw(spark, sf_dir), "raw_response").select(
        *_ID, "parsed.new_belief", _C("parsed.general_public_stance").alias("stance"),
        F.array_join("parsed.ranking", ",").alias("ranking"), "parsed.reasoning")


@query("prj30_line_parser", f"""WITH {V.RAW_TEXT}
SELECT subject, item, round, source, CASE WHEN l_partkey % 13 = 10 THEN raw END AS new_belief,
  CASE WHEN l_partkey % 13 = 10 THEN stance_raw END AS stance,
  CASE WHEN l_partkey % 13 = 10 THEN concat_ws(',', r1, r2, r3) ELSE '' END AS ranking FROM texts""")
def prj30(spark, sf_dir):
    return (_raw(spark, sf_dir).withColumn("p", parse.parse_lines(_C("raw_response")))
            .select(*_ID, "p.new_belief", _C("p.general_public_stance").alias("stance"),
                    F.array_join("p.ranking", ",").alias("ranking")))


@query("prj31_pattern_fallback", f"""WITH {V.RAW_TEXT},
e AS (SELECT *, regexp_extract(raw_response, '(?s)</think>\\s*(\\{{.*\\}})', 1) AS body FROM texts)
SELECT subject, item, round, source, coalesce(
  CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.new_belief') AS INT) END,
  TRY_CAST(nullif(regexp_extract(raw_response, '"new_belief"\\s*:\\s*(-?\\d+)', 1), '') AS INT)) AS belief FROM e""")
def prj31(spark, sf_dir):
    return parse.with_fallback_belief(_raw(spark, sf_dir), "raw_response").select(*_ID, "belief")


_SQL_PROBE = """CASE event_id % 5 WHEN 0 THEN '{"belief": ' || user_id % 7 || '}' WHEN 1 THEN '```json' || chr(10) || '{"belief": "' || user_id % 4 || '"}```'
  WHEN 2 THEN '{"believe": 1}' WHEN 3 THEN 'none' ELSE '<think>x</think>{"belief": -1}' END"""


def _probe(spark, sf_dir):
    k, u = _C("event_id") % 5, (_C("user_id") % 7).cast("string")
    text = (F.when(k == 0, F.concat(F.lit('{"belief": '), u, F.lit("}")))
            .when(k == 1, F.concat(F.lit('```json\n{"belief": "'), (_C("user_id") % 4).cast("string"), F.lit('"}```')))
            .when(k == 2, '{"believe": 1}').when(k == 3, "none").otherwise('<think>x</think>{"belief": -1}'))
    return V.table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("raw"))


_SQL_PROBED = """CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 7 <= 2 THEN user_id % 7 END
  WHEN 1 THEN CASE WHEN user_id % 4 <= 2 THEN user_id % 4 END WHEN 4 THEN -1 END"""


@query("prj32_probe_parser", f"SELECT event_id, CAST({_SQL_PROBED} AS INT) AS belief FROM events")
def prj32(spark, sf_dir):
    return parse.with_probe(_probe(spark, sf_dir), "raw").select("event_id", "belief")


@query("prj33_validity", f"""WITH {V.RAW_TEXT}, {_SQL_STRICT}
SELECT source, count(*) AS n, CAST(sum(CASE WHEN ok AND why IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_valid_without_reason FROM (
  SELECT *, coalesce(b BETWEEN -2 AND 2 AND s BETWEEN -2 AND 2, false)
    AND rk IN ('1,2,3', '1,3,2', '2,1,3', '2,3,1', '3,1,2', '3,2,1') AS ok FROM strict) GROUP BY source""")
def prj33(spark, sf_dir):
    p = parse.with_strict(_raw(spark, sf_dir), "raw_response")
    args = [_C("parsed.new_belief"), _C("parsed.ranking"), _C("parsed.reasoning"), _C("parsed.general_public_stance")]
    return p.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(parse.is_valid(*args).cast("int")).alias("n_valid"),
        F.sum(parse.is_valid(*args, need_reasoning=False).cast("int")).alias("n_valid_without_reason"))


def _stored(spark, sf_dir):
    """Stored answers with gaps beside the raw text."""
    keep = _C("l_suppkey") % 3 != 0
    return _raw(spark, sf_dir).select(
        *_ID, "raw_response", F.when(keep, _C("raw")).alias("llm_new_belief"),
        F.when(keep, _C("stance_raw")).alias("llm_general_public_stance"),
        F.when(keep, F.lit("kept")).alias("llm_reasoning"),
        *[F.when(keep, _C(f"r{i}")).alias(f"rank_{i}") for i in (1, 2, 3)])


_SQL_REPAIRED = V.PARSED + """, st AS (SELECT *, l_suppkey % 3 <> 0 AS keep FROM parsed),
repaired AS (SELECT subject, item, round, source,
  CASE WHEN keep AND raw IS NOT NULL THEN raw WHEN usable THEN b END AS llm_new_belief,
  CASE WHEN keep AND stance_raw IS NOT NULL THEN stance_raw WHEN usable THEN s END AS llm_general_public_stance,
  CASE WHEN keep THEN 'kept' WHEN usable THEN why END AS llm_reasoning,
  CASE WHEN keep AND r1 IS NOT NULL THEN r1 WHEN usable THEN k1 END AS rank_1,
  CASE WHEN keep AND r2 IS NOT NULL THEN r2 WHEN usable THEN k2 END AS rank_2,
  CASE WHEN keep AND r3 IS NOT NULL THEN r3 WHEN usable THEN k3 END AS rank_3,
  usable AND (NOT keep OR raw IS NULL OR stance_raw IS NULL OR r3 IS NULL) AS repaired FROM st)"""


@query("prj34_repair_from_raw", f"WITH {_SQL_REPAIRED} SELECT * FROM repaired")
def prj34(spark, sf_dir):
    return C.repair(_stored(spark, sf_dir)).drop("raw_response")


@query("prj35_backfill_report", f"""SELECT user_id % 3 AS file, count(*) AS n,
  count(CASE WHEN old IS NULL AND new IS NOT NULL THEN 1 END) AS recovered,
  count(CASE WHEN old IS NULL AND new IS NULL THEN 1 END) AS still_missing FROM (
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN {_SQL_PROBED} END AS old, {_SQL_PROBED} AS new FROM events) GROUP BY 1""")
def prj35(spark, sf_dir):
    p = parse.with_probe(_probe(spark, sf_dir), "raw").withColumn(
        "old", F.when(_C("event_id") % 2 == 0, _C("belief")))
    return p.groupBy((_C("user_id") % 3).alias("file")).agg(
        F.count("*").alias("n"),
        F.count(F.when(_C("old").isNull() & _C("belief").isNotNull(), 1)).alias("recovered"),
        F.count(F.when(_C("old").isNull() & _C("belief").isNull(), 1)).alias("still_missing"))


@query("prj36_repair_consistency", f"""WITH {V.PARSED}
SELECT subject, item, round, source FROM (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 2 ELSE raw END AS stored FROM parsed)
WHERE usable AND stored IS NOT NULL AND stored IS DISTINCT FROM b""")
def prj36(spark, sf_dir):
    stored = _raw(spark, sf_dir).withColumn(
        "stored", F.when(_C("l_suppkey") % 10 == 0, 2).otherwise(_C("raw")))
    p = parse.with_coerced(stored, "raw_response").where(_C("parsed").isNotNull())
    return C.disagreements(p, {"b": _C("stored")}, {"b": _C("parsed.new_belief")}).select(*_ID)


@query("prj37_nfkc_text")
def prj37(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(parse.normalise_text(_C("text"))).alias("text_md5"))


@query("prj38_invert_ordering", f"""WITH {V.RESP}
SELECT subject, item, round, source, CASE WHEN ok THEN list_position(t, 1) END AS rank_1,
  CASE WHEN ok THEN list_position(t, 2) END AS rank_2, CASE WHEN ok THEN list_position(t, 3) END AS rank_3 FROM (
  SELECT *, [r1, r2, r3] AS t, list_sort([r1, r2, r3]) = [1, 2, 3] AS ok FROM resp) WHERE src > 1""")
def prj38(spark, sf_dir):
    inverted = R.invert(R.triple(_C("r1"), _C("r2"), _C("r3")))
    return V.responses(spark, sf_dir).where("src > 1").withColumn("v", inverted).select(
        *_ID, *[_C("v")[i].alias(f"rank_{i + 1}") for i in range(3)])


@query("prj39_rank_validity", f"""WITH {V.RESP}
SELECT source, count(*) AS n, count(CASE WHEN list_sort([r1, r2, r3]) = [1, 2, 3] THEN 1 END) AS n_valid FROM resp GROUP BY source""")
def prj39(spark, sf_dir):
    ok = R.is_triple(R.triple(_C("r1"), _C("r2"), _C("r3")))
    return V.responses(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_valid"))


def message_pairs(resp):
    """Rows with the array of (message, rank) in the baseline convention."""
    triple = R.triple(_C("r1"), _C("r2"), _C("r3"))
    ranks = F.when(_C("src") == 1, R.valid_triple(triple)).otherwise(R.invert(triple))
    return (resp.withColumn("ranks", ranks).where(_C("ranks").isNotNull())
            .withColumn("pairs", R.ranks_by_message(R.message_order(_C("order_seen")), _C("ranks"))))


def counted_pairs(resp, group):
    """The same with `n` equal answers of a group to a row, so an ordering is taken apart once and not on every row."""
    kept = [*group, "src", "order_seen", "n"]
    counted = resp.groupBy(*group, "src", "r1", "r2", "r3", "order_seen").agg(F.count("*").alias("n"))
    # Behind a generator, so that the filter on whole orderings sees counted rows and is not moved below the count.
    return message_pairs(counted.select(*kept, F.explode(F.array(F.struct("r1", "r2", "r3"))).alias("_r")).select(*kept, "_r.*"))


# message_pairs() exploded, as SQL.
MESSAGES = V.RESP + """,
triples AS (SELECT *, [r1, r2, r3] AS t FROM resp WHERE list_sort([r1, r2, r3]) = [1, 2, 3]),
messages AS (SELECT subject, item, round, source, src, cell, slot,
  CAST(CASE WHEN src = 1 THEN t[slot] ELSE list_position(t, slot) END AS INT) AS rank,
  CAST(substr(['123', '132', '213', '231', '312', '321'][order_seen + 1], slot, 1) AS INT) AS message
  FROM triples CROSS JOIN (SELECT unnest([1, 2, 3]) AS slot))"""


@query("prj40_slot_to_message_rank", f"WITH {MESSAGES} SELECT subject, item, round, source, message, rank FROM messages")
def prj40(spark, sf_dir):
    return message_pairs(V.responses(spark, sf_dir)).select(*_ID, F.explode("pairs").alias("p")).select(
        *_ID, "p.message", "p.rank")


@query("prj41_parse_list_text", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 + 1 END AS first,
  CASE WHEN c_custkey % 4 <> 0 THEN 2 END AS n FROM customer""")
def prj41(spark, sf_dir):
    text = F.when(_C("c_custkey") % 4 == 0, "oops").otherwise(
        F.concat(F.lit("["), _C("c_custkey") % 3 + 1, F.lit(", 7]")))
    parsed = F.from_json(text, "array<int>")
    return V.table(spark, sf_dir, "customer").withColumn("a", parsed).select(
        "c_custkey", _C("a")[0].cast("bigint").alias("first"), F.when(_C("a").isNotNull(), F.size("a")).alias("n"))


@query("prj42_age_bins_left", """SELECT p_partkey, CASE WHEN a < 18 THEN NULL WHEN a < 25 THEN '18-24' WHEN a < 35 THEN '25-34'
  WHEN a < 45 THEN '35-44' WHEN a < 55 THEN '45-54' WHEN a < 65 THEN '55-64' WHEN a < 200 THEN '65-199' END AS bin
FROM (SELECT p_partkey, p_size + 15 AS a FROM part)""")
def prj42(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", N.bins_left(_C("p_size") + 15, N.AGE_EDGES_LEFT).alias("bin"))


@query("prj43_age_bins_right", """SELECT p_partkey, CASE WHEN a <= 0 THEN NULL WHEN a <= 35 THEN '(0,35]' WHEN a <= 55 THEN '(35,55]'
  WHEN a <= 100 THEN '(55,100]' END AS bin FROM (SELECT p_partkey, p_size + 15 AS a FROM part)""")
def prj43(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", N.bins_right(_C("p_size") + 15, N.AGE_EDGES_RIGHT).alias("bin"))


_SQL_SIZED = """CASE p_partkey % 3 WHEN 0 THEN 'fam' || p_size % 4 || '-' || p_size || 'B'
  WHEN 1 THEN 'fam' || p_size % 4 || '-' || p_size || '.5B-A' || p_size % 5 + 1 || 'B' ELSE 'gem-' || p_size % 2 || '-E' || p_size || 'B-it' END"""


def sized_names(spark, sf_dir):
    s = _C("p_size")
    k = _C("p_partkey") % 3
    name = (F.when(k == 0, F.concat(F.lit("fam"), s % 4, F.lit("-"), s, F.lit("B")))
            .when(k == 1, F.concat(F.lit("fam"), s % 4, F.lit("-"), s, F.lit(".5B-A"), s % 5 + 1, F.lit("B")))
            .otherwise(F.concat(F.lit("gem-"), s % 2, F.lit("-E"), s, F.lit("B-it"))))
    return V.table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"))


SQL_SIZES = f"""SELECT p_partkey, {_SQL_SIZED} AS name,
  CASE WHEN p_partkey % 3 = 2 THEN 'gem-' || p_size % 2 ELSE 'fam' || p_size % 4 END AS family,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5e0 ELSE p_size * 2e0 END AS total_b,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size % 5 + 1e0 ELSE CAST(p_size AS DOUBLE) END AS active_b FROM part"""


@query("prj44_size_from_name", SQL_SIZES)
def prj44(spark, sf_dir):
    named = sized_names(spark, sf_dir)
    measured = named.where(_C("name").startswith("gem")).groupBy("name").agg(
        F.max(_C("p_size") * 2.0).alias("measured_b"))
    z = N.size_fields(N.sized(_C("name")))
    total = F.when(z["is_effective"], F.coalesce("measured_b", z["stated_b"])).otherwise(z["stated_b"])
    return named.join(measured, "name", "left").select(
        "p_partkey", "name", z["family"].alias("family"), total.alias("total_b"), z["active_b"].alias("active_b"))


@query("prj45_excerpt", """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 100) || chr(10) || chr(10) || '...['
  || (length(text) - 200) || ' characters omitted]...' || chr(10) || chr(10) || right(text, 100) END AS excerpt FROM documents""")
def prj45(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", N.excerpt(_C("text"), 100).alias("excerpt"))


@query("prj46_safe_name", """SELECT page_id, trim(translate(url, '<>:"/\\|?*', '_________')) AS safe FROM pages""")
def prj46(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", N.safe_name(_C("url")).alias("safe"))


@query("prj47_stars", """SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
FROM (SELECT p_partkey, CAST(p_partkey % 97 AS DOUBLE) / 1000 AS p FROM part)""")
def prj47(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", N.stars((_C("p_partkey") % 97).cast("double") / 1000).alias("stars"))


@query("prj48_number_display", """SELECT p_partkey, CASE WHEN p < 1e-4 THEN '<0.0001' ELSE printf('%.4f', p) END AS p_text,
  CASE WHEN round(v, 4) = 0 THEN '0.0000' ELSE printf('%.4f', round(v, 4)) END AS number FROM (
  SELECT p_partkey, CAST(p_partkey % 97 AS DOUBLE) / 8192 AS p, CAST(p_partkey % 41 - 20 AS DOUBLE) / 65536 AS v FROM part)""")
def prj48(spark, sf_dir):
    k = _C("p_partkey")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", N.p_text((k % 97).cast("double") / 8192).alias("p_text"),
        N.plain_number((k % 41 - 20).cast("double") / 65536).alias("number"))


@query("prj49_drop_positions", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR)
  ELSE o_orderkey || '|' || o_orderpriority END AS record FROM orders""")
def prj49(spark, sf_dir):
    header = ["participant.label", "participant.code", "session.code", "survey.answer"]
    positions = C.drop_positions(header, ["participant.code", "session.code"])
    full = F.array(_C("o_orderkey").cast("string"), _C("o_custkey").cast("string"), _C("o_orderstatus"),
                   _C("o_orderpriority"))
    record = F.when(_C("o_orderkey") % 3 == 0, F.slice(full, 1, 2)).otherwise(full)
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.array_join(C.drop_fields(record, positions), "|").alias("record"))


@query("prj50_quality_flags", f"""SELECT conv_id, turn, role, length(trim(text, ' ' || chr(10))) >= 50 AS long_enough FROM conversations""")
def prj50(spark, sf_dir):
    length = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (length >= 50).alias("long_enough"))


@query("prj50_unique_rank_flags", f"""WITH {V.RESP}
SELECT subject, item, round, source, coalesce(r1 <> r2 AND r2 <> r3 AND r1 <> r3, false) AS ranks_unique FROM resp""")
def prj50b(spark, sf_dir):
    triple = F.array_compact(R.triple(_C("r1"), _C("r2"), _C("r3")))
    return V.responses(spark, sf_dir).select(
        *_ID, (F.size(F.array_distinct(triple)) == 3).alias("ranks_unique"))
