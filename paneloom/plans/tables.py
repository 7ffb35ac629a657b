"""The panel as a view over the driver tables, in Spark and as oracle SQL.

One row per subject, item, round and source. The line item table gives the
answers, the order's customer is the subject, the return flag is the item and the
line number is the source (1 = baseline). A source that answers an item again does
so in the next round, so every line is an answer of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BASELINE = "baseline"
CANDIDATES = [f"model_{n}" for n in range(2, 8)]
SOURCES = [BASELINE] + CANDIDATES
ITEMS = ["A", "N", "R"]
CELLS = ["package1", "package2", "package3"]
POSITIVE = [f"Option {i} is a good choice." for i in ITEMS]
NEGATIVE = [f"Option {i} is a bad choice." for i in ITEMS]
# Named comparisons of a base run with another one.
PAIRS = [(CANDIDATES[0], other) for other in CANDIDATES[1:]]
SQL_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
MAX_TRIES = 3
TOKEN_BUDGET = 4096

_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
          "l_discount", "l_tax"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_wide(spark: SparkSession, sf_dir: str, fields: list[str] = _ORDER) -> DataFrame:
    """One row per subject, item and round, one column per source with the `fields` of its line of that round.

    Lines are dealt once by subject and item; the numbering and the grouping both
    use that exchange. A row has one line per source at most, and its fields are
    picked one by one: numbers are grouped by hash, structs after a sort of all lines.
    """
    lines = table(spark, sf_dir, "lineitem").select(*_ORDER, "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    dealt = lines.join(orders, lines.l_orderkey == orders.o_orderkey).repartition("o_custkey", "l_returnflag")
    repeat = Window.partitionBy("o_custkey", "l_returnflag", "l_linenumber").orderBy(*_ORDER)
    picks = [F.expr(f"max(CASE WHEN l_linenumber = {n} THEN {value} END)").alias(f"{s}_{name}")
             for n, s in enumerate(SOURCES, start=1) for name, value in [("held", "true"), *zip(fields, fields)]]
    rows = dealt.withColumn("round", F.row_number().over(repeat).cast("bigint")).groupBy(
        F.col("o_custkey").alias("subject"), F.col("l_returnflag").alias("item"), "round").agg(*picks)
    return rows.select("subject", "item", "round", *[
        F.when(F.col(f"{s}_held"), F.struct(*[F.col(f"{s}_{f}").alias(f) for f in fields])).alias(s) for s in SOURCES])


# The view's columns as SQL expressions over the design columns and `o`, one answer.
_DESIGN = [
    "*", "concat('package', subject % 3 + 1) AS cell",
    "IF((subject + ascii(item)) % 2 = 0, 1, -1) AS polarity",
]
_STATEMENT = "concat('Option ', item, IF(polarity = 1, ' is a good choice.', ' is a bad choice.')) AS statement"
_RAW = "IF(o.src > 1 AND o.l.l_suppkey % 11 = 0, NULL, cast(floor(o.l.l_quantity) AS int) % 5 - 2)"
_INIT = "cast(floor({line}.l_discount * 100 + 0.5) AS int) % 5 - 2"
_K = "cast(IF({line}.l_partkey % 13 = 0, 6 + {line}.l_partkey % 2, {line}.l_partkey % 6) AS int)"
# Ranking orders of a line; the seventh and eighth are malformed on purpose. A line without a part has none: `get`, for a null
# index between brackets may stop the job once the orders are grouping keys.
_RANKS = ["get(array(1, 1, 2, 2, 3, 3, 1, 2), " + _K + ")", "get(array(2, 3, 1, 3, 1, 2, 1, 3), " + _K + ")",
          "get(array(3, 2, 3, 1, 2, 1, 3, NULL), " + _K + ")"]
_ORDER_SEEN = "cast(IF(o.src > 1 AND o.l.l_partkey % 19 = 0, (subject + 1) % 6, subject % 6) AS int)"
_OWN = [
    "subject", "item", "round", "o.src AS src", "o.source AS source", "cell", "polarity", "statement",
    f"{_RAW} AS raw", f"({_RAW}) * polarity AS y", f"{_INIT.format(line='o.l')} AS own_init_raw",
    "cast(IF(o.l.l_suppkey % 7 = 0, NULL, o.l.l_suppkey % 5 - 2) AS int) AS stance_raw",
    *[f"{r.format(line='o.l')} AS r{i}" for i, r in enumerate(_RANKS, start=1)],
    "IF(o.src > 1 AND o.l.l_partkey % 17 = 0, concat('package', (subject + 1) % 3 + 1), cell) AS cell_seen",
    f"{_ORDER_SEEN} AS order_seen",
    "cast(o.l.l_suppkey % 3 + 1 AS int) AS n_tries", "cast(o.l.l_partkey % 23 = 0 AS int) AS n_truncated",
    f"cast(floor(o.l.l_extendedprice) AS int) % {TOKEN_BUDGET} AS completion_tokens",
    "o.l.l_partkey % 29 = 0 AS thinking_disabled", "o.l.l_partkey AS l_partkey", "o.l.l_suppkey AS l_suppkey",
    "o.l.l_orderkey AS l_orderkey",
]
_BASE = [
    f"(cast(floor({BASELINE}.l_quantity) AS int) % 5 - 2) * polarity AS h",
    f"{_INIT.format(line=BASELINE)} AS init_raw", f"({_INIT.format(line=BASELINE)}) * polarity AS init",
]

# Fields of a line that beliefs and ranking orders are read from.
ANSWER_FIELDS = ["l_partkey", "l_suppkey", "l_quantity", "l_discount"]


def _answers(wide: DataFrame, expressions: list[str], columns: list[str] | None, sources: list[str] = SOURCES) -> DataFrame:
    """Design columns, then `sources` of each row unpivoted, and the named of their columns; narrow, no shuffle."""
    options = ", ".join(f"struct({n} AS src, '{s}' AS source, {s} AS l)" for n, s in enumerate(SOURCES, start=1) if s in sources)
    answers = wide.selectExpr(*_DESIGN).selectExpr("*", _STATEMENT, f"explode(array({options})) AS o").where("o.l IS NOT NULL")
    made = {e.rpartition(" AS ")[2]: e for e in expressions}
    return answers.selectExpr(*(made.values() if columns is None else [made[c] for c in columns]))


def responses(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, columns: list[str] | None = None,
              sources: list[str] = SOURCES) -> DataFrame:
    """Every source's answer, whether or not the baseline answered.

    A job that reads the panel several times passes `lines`, materialised once; where
    these hold some fields only, it names the `columns` that it reads.
    """
    return _answers(lines_wide(spark, sf_dir) if lines is None else lines, _OWN, columns, sources)


def panel(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Answers paired with the baseline answer `h` and its initial belief `init`; `columns` as in `responses`."""
    wide = (lines_wide(spark, sf_dir) if lines is None else lines).where(f"{BASELINE} IS NOT NULL")
    return _answers(wide, [*_OWN, *_BASE], columns)


def paired(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Candidate answers that parsed, with the baseline's."""
    return panel(spark, sf_dir, lines).where((F.col("src") > 1) & F.col("y").isNotNull())


def rankings(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Every baseline answer once per candidate, answered or not: both ranking orders and the stimulus order each has seen.

    A row of `lines_wide` holds all answers of a case, so nothing is joined. A case without a subject or an item equals
    no other one: no candidate answers it.
    """
    wide = (lines_wide(spark, sf_dir) if lines is None else lines).where(f"{BASELINE} IS NOT NULL")
    candidates = ", ".join(f"struct({n} AS src, '{s}' AS source, IF(subject IS NULL OR item IS NULL, NULL, {s}) AS l)"
                           for n, s in enumerate(SOURCES, start=1) if s != BASELINE)
    return wide.selectExpr(*_DESIGN).selectExpr("*", f"explode(array({candidates})) AS o").selectExpr(
        "subject", "item", "round", "o.source AS source", "cell",
        *[f"{r.format(line=BASELINE)} AS r{i}_b" for i, r in enumerate(_RANKS, start=1)], "cast(subject % 6 AS int) AS order_b",
        *[f"{r.format(line='o.l')} AS r{i}" for i, r in enumerate(_RANKS, start=1)],
        f"IF(o.l IS NOT NULL, {_ORDER_SEEN}, NULL) AS order_c", "IF(o.l IS NOT NULL, true, NULL) AS answered")


def compared(wide: DataFrame) -> DataFrame:
    """A wide frame once per named comparison, with the two answers; cases that one of them misses go."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(a).alias("base"), F.lit(b).alias("other"), F.col(a).alias("y_base"), F.col(b).alias("y_other")) for a, b in PAIRS]))
    rows = wide.withColumn("_pair", pairs).select("*", "_pair.*").drop("_pair")
    return rows.where("y_base IS NOT NULL AND y_other IS NOT NULL")


_SQL_TRIPLES = [
    "CASE WHEN l_partkey%13=0 THEN list_extract([1,2], CAST(l_partkey%2+1 AS INT)) ELSE list_extract([1,1,2,2,3,3], CAST(l_partkey%6+1 AS INT)) END",
    "CASE WHEN l_partkey%13=0 THEN list_extract([1,3], CAST(l_partkey%2+1 AS INT)) ELSE list_extract([2,3,1,3,1,2], CAST(l_partkey%6+1 AS INT)) END",
    "CASE WHEN l_partkey%13=0 THEN list_extract([3,NULL], CAST(l_partkey%2+1 AS INT)) ELSE list_extract([3,2,3,1,2,1], CAST(l_partkey%6+1 AS INT)) END",
]

# responses() as SQL.
RESP = f"""one AS (
  SELECT * FROM (
    SELECT o_custkey AS subject, l_returnflag AS item, l_linenumber AS src, lineitem.*,
      row_number() OVER (PARTITION BY o_custkey, l_returnflag, l_linenumber
        ORDER BY {', '.join(_ORDER)}) AS round
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE src BETWEEN 1 AND 7),
design AS (
  SELECT *, 'package' || (subject % 3 + 1) AS cell,
    CASE WHEN (subject + ascii(item)) % 2 = 0 THEN 1 ELSE -1 END AS polarity,
    CASE WHEN src > 1 AND l_suppkey % 11 = 0 THEN NULL
      ELSE CAST(floor(l_quantity) AS INT) % 5 - 2 END AS raw FROM one),
resp AS (
  SELECT subject, item, round, src, CASE WHEN src = 1 THEN 'baseline' ELSE 'model_' || src END AS source,
    cell, polarity,
    'Option ' || item || CASE WHEN polarity = 1 THEN ' is a good choice.' ELSE ' is a bad choice.' END AS statement,
    raw, raw * polarity AS y, CAST(floor(l_discount * 100 + 0.5) AS INT) % 5 - 2 AS own_init_raw,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 5 - 2 AS INT) END AS stance_raw,
    {_SQL_TRIPLES[0]} AS r1, {_SQL_TRIPLES[1]} AS r2, {_SQL_TRIPLES[2]} AS r3,
    CASE WHEN src > 1 AND l_partkey % 17 = 0 THEN 'package' || ((subject + 1) % 3 + 1) ELSE cell END AS cell_seen,
    CAST(CASE WHEN src > 1 AND l_partkey % 19 = 0 THEN (subject + 1) % 6 ELSE subject % 6 END AS INT) AS order_seen,
    CAST(l_suppkey % 3 + 1 AS INT) AS n_tries,
    CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END AS n_truncated,
    CAST(floor(l_extendedprice) AS INT) % {TOKEN_BUDGET} AS completion_tokens,
    l_partkey % 29 = 0 AS thinking_disabled, l_partkey, l_suppkey, l_orderkey FROM design)"""

# panel() as SQL.
PANEL = RESP + """,
panel AS (
  SELECT r.*, b.y AS h, b.own_init_raw AS init_raw, b.own_init_raw * r.polarity AS init
  FROM resp r JOIN resp b ON b.subject = r.subject AND b.item = r.item AND b.round = r.round AND b.src = 1)"""

# paired() as SQL.
PAIRED = PANEL + """,
paired AS (SELECT * FROM panel WHERE src > 1 AND y IS NOT NULL)"""

# complete_wide() as SQL, in long form: `frame` has one row per case, `full` one per case and source.
COMPLETE = PAIRED + """,
frame AS (SELECT subject, item, round FROM paired GROUP BY 1, 2, 3 HAVING count(*) = 6),
full_cases AS (SELECT p.* FROM paired p JOIN frame USING (subject, item, round))"""


def inline(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A short literal table with a known size, so a join with it is planned by that size."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


# A reasoning in compatibility forms, and as they are folded.
WIDE_FORMS, FOLDED_FORMS = '"\ufb01ne \uff11 \u2167"', "fine 1 VIII"


def _json_answer(quoted: bool, short: bool, reason: bool | str) -> str:
    def num(c):
        text = f"coalesce(cast({c} AS string), 'null')"
        return f"""'"', {text}, '"'""" if quoted else text

    third = "" if short else f", ', ', {num('r3')}"
    why = f""", ', "reasoning": {reason}'""" if isinstance(reason, str) else (
        """, ', "reasoning": "they said {no} to \\\\"', item, '\\\\" ', subject, '"'""" if reason else "")
    return (f"""concat('{{"new_belief": ', {num('raw')}, ', "ranking": [', {num('r1')}, ', ', {num('r2')}{third}, ']'"""
            f"""{why}, ', "general_public_stance": ', {num('stance_raw')}, '}}')""")


def with_raw_text(df: DataFrame) -> DataFrame:
    """The answer as a response text in one of thirteen shapes, good and bad.

    The text is made behind a generator: a parser that reads it several times does not make it anew.
    """
    plain = _json_answer(False, False, True)
    return df.selectExpr("*", f"""explode(array(CASE l_partkey % 13 WHEN 0 THEN {plain}
      WHEN 1 THEN concat('<think>I weigh {{this}}.</think>\n', {plain}) WHEN 2 THEN concat('I weigh this.</THINK> ', {plain})
      WHEN 3 THEN {_json_answer(True, False, True)} WHEN 4 THEN concat('```json\n', {plain}, '\n```')
      WHEN 5 THEN substring({plain}, 1, 30) WHEN 6 THEN concat({plain}, ' Hope this helps {{you}}')
      WHEN 7 THEN {_json_answer(False, True, True)} WHEN 8 THEN {_json_answer(False, False, False)} WHEN 9 THEN 'I cannot answer.'
      WHEN 11 THEN {_json_answer(False, False, 'null')} WHEN 12 THEN {_json_answer(False, False, WIDE_FORMS)}
      ELSE concat(coalesce(cast(raw AS string), 'none'), '\nRANKING: ', concat_ws(', ', r1, r2, r3), '\nGENERAL_PUBLIC_STANCE: ',
        coalesce(cast(stance_raw AS string), 'none')) END)) AS raw_response""")


def _sql_answer(quoted: bool, short: bool, reason: bool | str) -> str:
    def num(c):
        text = f"coalesce(CAST({c} AS VARCHAR), 'null')"
        return f"'\"' || {text} || '\"'" if quoted else text

    third = "" if short else f" || ', ' || {num('r3')}"
    why = f""" || ', "reasoning": {reason}'""" if isinstance(reason, str) else (
        """ || ', "reasoning": "they said {no} to \\"' || item || '\\" ' || subject || '"'""" if reason else "")
    return (f"""('{{"new_belief": ' || {num('raw')} || ', "ranking": [' || {num('r1')} || ', ' || {num('r2')}"""
            f"""{third} || ']'{why} || ', "general_public_stance": ' || {num('stance_raw')} || '}}')""")


# with_raw_text(responses()) as SQL.
RAW_TEXT = RESP + f""",
texts AS (SELECT *, CASE l_partkey % 13
  WHEN 0 THEN {_sql_answer(False, False, True)}
  WHEN 1 THEN '<think>I weigh {{this}}.</think>' || chr(10) || {_sql_answer(False, False, True)}
  WHEN 2 THEN 'I weigh this.</THINK> ' || {_sql_answer(False, False, True)}
  WHEN 3 THEN {_sql_answer(True, False, True)}
  WHEN 4 THEN '```json' || chr(10) || {_sql_answer(False, False, True)} || chr(10) || '```'
  WHEN 5 THEN substr({_sql_answer(False, False, True)}, 1, 30)
  WHEN 6 THEN {_sql_answer(False, False, True)} || ' Hope this helps {{you}}'
  WHEN 7 THEN {_sql_answer(False, True, True)}
  WHEN 8 THEN {_sql_answer(False, False, False)}
  WHEN 9 THEN 'I cannot answer.'
  WHEN 11 THEN {_sql_answer(False, False, 'null')} WHEN 12 THEN {_sql_answer(False, False, WIDE_FORMS)}
  ELSE coalesce(CAST(raw AS VARCHAR), 'none') || chr(10) || 'RANKING: ' || concat_ws(', ', r1, r2, r3) || chr(10)
    || 'GENERAL_PUBLIC_STANCE: ' || coalesce(CAST(stance_raw AS VARCHAR), 'none') END AS raw_response
  FROM resp)"""

# The coercing parse of raw_response as SQL; one row per answer, p_* null where unusable.
PARSED = RAW_TEXT + f""",
cut AS (SELECT *, trim(regexp_replace(raw_response, '(?is)^.*?</think>', ''), ' ' || chr(10)) AS t FROM texts),
obj AS (SELECT *, CASE WHEN json_valid(t) AND t LIKE '{{%' THEN t END AS j FROM cut),
num AS (SELECT *, TRY_CAST(json_extract_string(j, '$.new_belief') AS INT) AS b,
  TRY_CAST(json_extract_string(j, '$.general_public_stance') AS INT) AS s,
  json_array_length(j, '$.ranking') AS k,
  TRY_CAST(json_extract_string(j, '$.ranking[0]') AS INT) AS k1,
  TRY_CAST(json_extract_string(j, '$.ranking[1]') AS INT) AS k2,
  TRY_CAST(json_extract_string(j, '$.ranking[2]') AS INT) AS k3,
  CASE WHEN json_type(j, '$.reasoning') = 'NULL' THEN 'None' WHEN l_partkey % 13 = 12 AND json_exists(j, '$.reasoning') THEN '{FOLDED_FORMS}'
    ELSE json_extract_string(j, '$.reasoning') END AS why FROM obj),
parsed AS (SELECT *, coalesce(b IS NOT NULL AND s IS NOT NULL AND k = 3 AND k1 IS NOT NULL AND k2 IS NOT NULL
  AND k3 IS NOT NULL, false) AS usable FROM num)"""
