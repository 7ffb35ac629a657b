"""Parsing of model-generated response text, as columns.

Two parsers exist on purpose. The coercing one reads quoted integers and gives
all fields or none. The strict one keeps only true integers and gives whatever
fields are well typed.
"""

from __future__ import annotations

import unicodedata
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from paneloom.functions.ranks import is_triple
from paneloom.schema import LIKERT

# Quote marks stripped in this order.
QUOTE_MARKS = ["`", "“", "”", "‘", "’", '"', "'"]

# Typographic punctuation to plain punctuation.
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}

_ENDS = r"^\s+|\s+$"

# A JSON string literal; possessive, so long strings need no backtracking stack.
STRING_LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def drop_reasoning_prefix(text: Column) -> Column:
    """Everything up to the first closing think tag goes, with or without an opening tag."""
    return _strip(F.regexp_replace(text, r"(?is)\A.*?</think>", ""))


def _unwrap(text: Column, mark: str, width: int) -> Column:
    edge = mark * width
    inner = F.when(
        F.length(text) >= 2 * width,
        _strip(text.substr(F.lit(width + 1), F.length(text) - 2 * width)),
    ).otherwise(F.lit(""))
    return F.startswith(text, F.lit(edge)) & F.endswith(text, F.lit(edge)), inner


def clean_response(text: Column) -> Column:
    """Drop paired think blocks, enclosing quotes and fences, smart quotes, a leading 'json'."""
    bare = _strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    # A bare object has nothing to unwrap; most answers take this short way.
    is_bare = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    out = bare
    for mark in QUOTE_MARKS:
        out = _staged(out, partial(_unwrap_once, mark))
    out = F.translate(out, "“”‘’", "\"\"''")
    for mark in ("'", '"'):
        out = _staged(out, partial(_unwrap_triple, mark))
    unwrapped = _staged(_staged(out, _unwrap_pair), _drop_json_word)
    return F.when(is_bare, F.translate(bare, "“”‘’", "\"\"''")).otherwise(unwrapped)


def _unwrap_once(mark: str, text: Column) -> Column:
    triple_hit, triple_inner = _unwrap(text, mark, 3)
    single_hit, single_inner = _unwrap(text, mark, 1)
    return F.when(triple_hit, triple_inner).when(single_hit, single_inner).otherwise(text)


def _unwrap_triple(mark: str, text: Column) -> Column:
    hit, inner = _unwrap(text, mark, 3)
    return F.when(hit, inner).otherwise(text)


def _unwrap_pair(text: Column) -> Column:
    double_hit, double_inner = _unwrap(text, '"', 1)
    single_hit, single_inner = _unwrap(text, "'", 1)
    return F.when(double_hit, double_inner).when(single_hit, single_inner).otherwise(text)


def _drop_json_word(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("json")),
                  _strip(text.substr(F.lit(5), F.length(text)))).otherwise(text)


def _staged(text: Column, fn) -> Column:
    """Bind the intermediate value once, so nested stages do not multiply the expression."""
    return F.element_at(F.transform(F.array(text), lambda value: fn(value)), 1)


def is_one_object(text: Column) -> Column:
    """True when the text is a single JSON object with nothing after it.

    The engine's JSON readers ignore trailing text, so the brackets outside
    string literals are followed: depth may return to zero only at the end.
    """
    unquoted = F.regexp_replace(text, STRING_LITERAL, "")
    flat = unquoted.rlike(r"^\{[^{}]*\}$")
    brackets = F.regexp_replace(unquoted, r"[^{}\[\]]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    single = F.aggregate(
        F.split(brackets, ""), start,
        lambda acc, ch: F.struct(
            (acc["depth"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1)
             .otherwise(0)).alias("depth"),
            (acc["closed"] + F.when(ch.isin("}", "]") & (acc["depth"] == 1), 1)
             .otherwise(0)).alias("closed"),
        ),
        lambda acc: (acc["depth"] == 0) & (acc["closed"] == 1),
    )
    outer = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(~outer, False).when(flat, True).otherwise(single)


def parse_object(text: Column) -> Column:
    """The JSON object as a VARIANT, or null."""
    return F.when(is_one_object(text), F.try_parse_json(text))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _field(obj: str, name: str) -> Column:
    return F.variant_get(F.col(obj), f"$.{name}", "variant")


def _coerced_int(value: Column) -> Column:
    """What int() of the JSON value gives; null where int() would fail or the number needs more than 64 bits."""
    kind, text = _kind(value), _text(value)
    quoted = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), _strip(text).try_cast("bigint"))
    return (
        F.when(kind == "BIGINT", text.try_cast("bigint"))
        .when(kind == "STRING", quoted)
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0).cast("bigint"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), text.try_cast("decimal(38,9)").try_cast("bigint"))
    )


def _only_int(value: Column) -> Column:
    return F.when(_kind(value) == "BIGINT", _text(value).try_cast("bigint"))


def _once(value: Column) -> Column:
    """Evaluate exactly once per row.

    A later filter would otherwise be pushed below the projection and repeat the
    whole parse in its condition; nothing is pushed below a generator's output.
    """
    return F.explode(F.array(value))


# The parsers below add a column step by step, so the object is parsed once per
# row however many fields are read from it.

def with_coerced(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Struct of the four response fields; null unless every required field is usable."""
    staged = (
        df.withColumn("_t", drop_reasoning_prefix(F.col(text)))
        .withColumn("_o", _once(parse_object(F.col("_t"))))
        .withColumns({
            "_b": _coerced_int(_field("_o", "new_belief")),
            "_s": _coerced_int(_field("_o", "general_public_stance")),
            "_r": F.transform(F.try_variant_get("_o", "$.ranking", "array<variant>"), _coerced_int),
        })
    )
    usable = (F.col("_b").isNotNull() & F.col("_s").isNotNull() & (F.size("_r") == 3)
              & ~F.exists("_r", lambda x: x.isNull()))
    # Whatever the reasoning is becomes text, a JSON null too; then compatibility forms are folded.
    why = F.when(F.is_variant_null(_field("_o", "reasoning")), "None").otherwise(_text(F.col("_o"), "$.reasoning"))
    parsed = F.when(usable, F.struct(
        F.col("_b").alias("new_belief"), F.col("_r").alias("ranking"),
        folded(why).alias("reasoning"), F.col("_s").alias("general_public_stance")))
    return staged.withColumn(out, _once(parsed)).drop("_t", "_o", "_b", "_s", "_r")


def with_strict(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Struct of the four response fields; each is null or empty unless well typed."""
    staged = (
        df.withColumn("_t", clean_response(F.col(text)))
        .withColumn("_o", _once(parse_object(F.col("_t"))))
        .withColumn("_r", F.filter(
            F.transform(F.try_variant_get("_o", "$.ranking", "array<variant>"), _only_int),
            lambda x: x.isNotNull()))
        .withColumn("_why", _field("_o", "reasoning"))
    )
    return staged.withColumn(out, _once(F.struct(
        _only_int(_field("_o", "new_belief")).alias("new_belief"),
        F.coalesce(F.col("_r"), F.array().cast("array<bigint>")).alias("ranking"),
        F.when(_kind(F.col("_why")) == "STRING", _text(F.col("_why"))).alias("reasoning"),
        _only_int(_field("_o", "general_public_stance")).alias("general_public_stance"),
    ))).drop("_t", "_o", "_r", "_why")


def with_probe(df: DataFrame, text: str, out: str = "belief") -> DataFrame:
    """The single belief of a probe response, or null outside -2..2."""
    staged = (df.withColumn("_t", clean_response(F.col(text)))
              .withColumn("_o", _once(parse_object(F.col("_t"))))
              .withColumn("_b", _coerced_int(_field("_o", "belief"))))
    return staged.withColumn(out, F.when(F.col("_b").isin(LIKERT), F.col("_b"))).drop("_t", "_o", "_b")


def with_fallback_belief(df: DataFrame, text: str, out: str = "belief") -> DataFrame:
    """Belief from the object after the closing think tag, else by pattern anywhere."""
    staged = (df.withColumn("_t", F.regexp_extract(text, r"(?s)</think>\s*(\{.*\})", 1))
              .withColumn("_o", _once(parse_object(F.col("_t")))))
    by_pattern = F.nullif(F.regexp_extract(text, r'"new_belief"\s*:\s*(-?\d+)', 1), F.lit(""))
    return staged.withColumn(out, F.coalesce(
        _coerced_int(_field("_o", "new_belief")), by_pattern.try_cast("int"))).drop("_t", "_o")


# A line's start with the blanks that are stripped from it; a line ends at either of \r and \n.
_LINE = r"(?:\A|[\r\n])[ \t\x0B\f]*+"
# Whatever upper-cases to the word.
_RANKING = r"[Rr][Aa][Nn][Kk][Ii\u0131][Nn][Gg]"
_STANCE = r"[Gg][Ee][Nn][Ee][Rr][Aa][Ll]_[Pp][Uu][Bb][Ll][Ii\u0131][Cc]_(?:[Ss\u017F][Tt]|[\uFB05\uFB06])[Aa][Nn][Cc][Ee]"


def parse_lines(text: Column) -> Column:
    """Line format: a bare belief, a RANKING line, a GENERAL_PUBLIC_STANCE line; the first line of each kind counts.

    Lines are found in the text by one pattern each, so no list of lines is made and filtered.
    """
    belief = F.regexp_extract(text, _LINE + r"(-2|-1|0|1|2)[ \t\x0B\f]*+(?=[\r\n]|\z)", 1)
    rank_line = F.regexp_extract(text, _LINE + f"({_RANKING}[^\\r\\n]*+)", 1)
    stance_line = _strip(F.regexp_extract(text, _LINE + f"({_STANCE}[^\\r\\n]*+)", 1))
    stance = F.regexp_extract(stance_line, r"^[^:]*:\s*(-2|-1|0|1|2)\s*$", 1)
    ids = F.transform(F.regexp_extract_all(rank_line, F.lit(r"(\d+)"), 1), lambda s: s.try_cast("int"))
    return F.struct(
        belief.try_cast("int").alias("new_belief"),
        F.coalesce(ids, F.array().cast("array<int>")).alias("ranking"),
        F.nullif(stance, F.lit("")).try_cast("int").alias("general_public_stance"),
    )


def is_valid(belief: Column, ranking: Column, reasoning: Column, stance: Column,
             need_reasoning: bool = True) -> Column:
    ok = (F.coalesce(belief.isin(LIKERT), F.lit(False))
          & F.coalesce(stance.isin(LIKERT), F.lit(False)) & is_triple(ranking))
    return ok & reasoning.isNotNull() if need_reasoning else ok


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def folded(text: Column) -> Column:
    """NFKC; a text in ASCII is its own form and is not sent to Python."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(_nfkc(F.when(~text.rlike(r"\A\p{ASCII}*\z"), text)))


def normalise_text(text: Column) -> Column:
    """NFKC, then plain punctuation."""
    plain = F.translate(_nfkc(text), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.replace(plain, F.lit("…"), F.lit("..."))
