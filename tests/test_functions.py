"""Column functions on small literal rows."""

import json
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from paneloom.functions import ranks as R
from paneloom.functions import responses as parse
from paneloom.functions import scalars as N
from paneloom.functions import tails as T
from paneloom.functions import text as X


def rows(spark, values, column="v", kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} {kind}")


def column(df, expr):
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


GOOD = {"new_belief": 1, "ranking": [2, 1, 3], "reasoning": "a } b { \\\" c", "general_public_stance": -1}


def test_coercing_parser(spark):
    body = json.dumps(GOOD)
    quoted = json.dumps({"new_belief": "0", "ranking": ["2", "1", "3"], "general_public_stance": "-2"})
    deep = json.dumps({**GOOD, "extra": {"a": [{"b": 1}]}})
    texts = [body, "<think>x</think>" + body, "thought\nlong</think>\n" + body, quoted, "not json", body[:20],
             json.dumps({**GOOD, "ranking": [1, 2]}), json.dumps({"new_belief": 1}), body + " tail", body + body, None,
             json.dumps({**GOOD, "new_belief": 1.9}), json.dumps({**GOOD, "new_belief": "1.9"}), "[1]", deep,
             json.dumps({**GOOD, "new_belief": None}), json.dumps({**GOOD, "reasoning": "x" * 50000 + '"'})]
    out = parse.with_coerced(rows(spark, texts), "v").orderBy("i").collect()
    beliefs = [r.parsed.new_belief if r.parsed else None for r in out]
    assert beliefs == [1, 1, 1, 0, None, None, None, None, None, None, None, 1, None, None, 1, None, 1]
    assert out[0].parsed.reasoning == GOOD["reasoning"]
    assert out[3].parsed.ranking == [2, 1, 3] and out[3].parsed.reasoning is None
    assert len(out[16].parsed.reasoning) == 50001


def test_strict_parser(spark):
    body = json.dumps(GOOD)
    texts = [body, "```json\n" + body + "\n```", '"' + "json" + body + '"', "'''" + body + "'''",
             json.dumps({"new_belief": "0", "ranking": [1, "2", 3], "general_public_stance": 2}),
             "thought</think>" + body, "<think>a</think>" + body]
    out = parse.with_strict(rows(spark, texts), "v").orderBy("i").collect()
    assert [r.parsed.new_belief for r in out] == [1, 1, 1, 1, None, None, 1]
    assert out[4].parsed.ranking == [1, 3] and out[4].parsed.general_public_stance == 2


def test_line_and_probe_parsers(spark):
    out = rows(spark, [" 2 \nRanking: 3 > 1 > 2\ngeneral_public_stance: -1", "7\nnone", "GENERAL_PUBLIC_STANCE: 9"])
    got = [r.out for r in out.select("i", parse.parse_lines(F.col("v")).alias("out")).orderBy("i").collect()]
    assert (got[0].new_belief, got[0].ranking, got[0].general_public_stance) == (2, [3, 1, 2], -1)
    assert (got[1].new_belief, got[1].ranking, got[2].general_public_stance) == (None, [], None)
    probe = parse.with_probe(rows(spark, ['{"belief": 1}', '{"belief": "-2"}', '{"belief": 3}', '{"b": 1}', "x"]), "v")
    assert [r.belief for r in probe.orderBy("i").collect()] == [1, -2, None, None, None]


def test_fallback_belief(spark):
    texts = ['x</think> {"new_belief": 2}', 'broken "new_belief" : -1, ...', "none"]
    got = parse.with_fallback_belief(rows(spark, texts), "v").orderBy("i").collect()
    assert [r.belief for r in got] == [2, -1, None]


def test_filter_does_not_repeat_the_parse(spark):
    df = parse.with_coerced(rows(spark, ["{}"]), "v").where(F.col("parsed").isNotNull())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Filter isnotnull(parsed") < plan.index("Generate")


def test_inversion_of_all_orders(spark):
    orders = [list(p) for p in permutations((1, 2, 3))]
    df = rows(spark, orders + [[1, 1, 3], [1, 2, None], [0, 1, 2]], kind="array<int>")
    once = column(df, R.invert(F.col("v")))
    for order, got in zip(orders, once):
        assert got == [order.index(s) + 1 for s in (1, 2, 3)]
    assert once[6:] == [None, None, None]
    twice = column(df, R.invert(R.invert(F.col("v"))))
    assert twice[:6] == orders
    assert [o for o, g in zip(orders, once) if o != g] == [[2, 3, 1], [3, 1, 2]]


def test_kendall_tau(spark):
    df = rows(spark, [[1, 2, 3], [3, 2, 1], [1, 3, 2], [2, 3, 1]], kind="array<int>")
    ref = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert column(df, R.kendall_tau(ref, F.col("v"))) == pytest.approx([1.0, -1.0, 1 / 3, -1 / 3])


def test_message_orders(spark):
    df = rows(spark, [0, 3, 4, 5, -1, 9, None], kind="int")
    assert column(df, R.message_order(F.col("v"))) == [
        [1, 2, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1], [1, 2, 3], [3, 2, 1], [1, 2, 3]]


def test_integer_readers(spark):
    df = rows(spark, ["3.7", " -2 ", "", "abc", "4.0", None, "nan", "123456789012", "9007199254740993"])
    assert column(df, N.lenient_int(F.col("v"))) == [3, -2, None, None, 4, None, None, 123456789012, 9007199254740993]
    assert column(df, N.strict_int(F.col("v"))) == [None, -2, None, None, 4, None, None, 123456789012, 9007199254740993]


def test_term_labels(spark):
    df = rows(spark, ["Intercept", "C(gender)[T.Male]", "C(gender)[T.1]", "C(x)[T.0]", "C(x)[T.1.0]", "age_centered",
                      "initial_belief_normalized_centered", "C(topic)[T.Weight Loss]", "x[.5]", "C(age_centered)"])
    assert column(df, N.term_label(F.col("v"), {"gender": "Female"})) == [
        "Intercept", "gender = Male (vs Female)", "gender = Other (vs Female)", "x = Reference", "x = 1.0 (vs reference)", "age",
        "Initial Belief", "Topic: Weight Loss (vs UBI)", "x = Other (vs reference)", "age"]


def test_unknown_wording_stops(spark):
    df = rows(spark, ["good", "bad", "new"])
    pol = N.polarity(F.col("v"), ["good"], ["bad"])
    assert column(df.where("i < 2"), pol) == [1, -1]
    with pytest.raises(Exception, match="unknown statement wording"):
        column(df, pol)


def test_bins_and_labels(spark):
    ages = rows(spark, [17, 18, 24, 35, 36, 55, 199], kind="int")
    assert column(ages, N.bins_left(F.col("v"), N.AGE_EDGES_LEFT)) == [
        None, "18-24", "18-24", "35-44", "35-44", "55-64", "65-199"]
    assert column(ages, N.bins_right(F.col("v"), N.AGE_EDGES_RIGHT)) == [
        "(0,35]", "(0,35]", "(0,35]", "(0,35]", "(35,55]", "(35,55]", None]
    assert column(rows(spark, [0.0005, 0.001, 0.02, 0.05], kind="double"), N.stars(F.col("v"))) == ["***", "**", "*", ""]
    assert column(rows(spark, [-0.00001, 0.12345], kind="double"), N.plain_number(F.col("v"))) == ["0.0000", "0.1235"]


def test_sizes_from_names(spark):
    names = rows(spark, ["fam3.5-9B", "fam3.5-35B-A3B", "gem-4-E2B-it", "fam3.5-0.8B", "plain"])
    z = N.size_fields(F.col("v"))
    assert column(names, z["family"])[:4] == ["fam3.5", "fam3.5", "gem-4", "fam3.5"]
    assert column(names, z["stated_b"]) == [9.0, 35.0, 2.0, 0.8, None]
    assert column(names, z["active_b"]) == [9.0, 3.0, 2.0, 0.8, None]
    assert column(names, z["has_size"]) == [True, True, True, True, False]
    assert column(names.where("v <> 'plain'"), N.sized(F.col("v"))) == column(names.where("v <> 'plain'"), F.col("v"))
    with pytest.raises(Exception, match="no size in the source name: plain"):
        column(names, N.sized(F.col("v")))


def test_template_is_filled_in_one_pass(spark):
    df = rows(spark, ["{topic}: {statement} {unknown}"])
    out = X.fill_template(F.col("v"), {"topic": F.lit("{statement}"), "statement": F.lit("s"), "other": F.lit(None)})
    assert column(df, out) == ["{statement}: s {unknown}"]


def test_pii_patterns(spark):
    texts = {
        "email": "write to a.b@example.org now", "phone": "call +44 20 7946 0958 today", "url": "see https://x.org/a",
        "social_handle": "ask @someone there", "uk_postcode": "at SW1A 1AA", "uk_nino": "no AB123456C here",
        "long_digit_run": "id 123456789", "date_of_birth": "born on 1 May 1990", "self_names_me": "My name is X",
        "names_employer": "I work for them", "names_location": "I live in Y", "prolific_mention": "via Prolific",
    }
    for name, pattern in X.PII_PATTERNS:
        hits = column(rows(spark, [texts[name], "nothing here"]), F.col("v").rlike(pattern))
        assert hits == [True, False], name


def test_redaction(spark):
    df = rows(spark, ["see https://example.org/a b", "none"])
    assert column(df, X.redacted_hit(F.col("v"), r"https?://\S+")) == ["...see [ht******************a] b...", None]


def test_tails_against_known_values(spark):
    df = rows(spark, [0], kind="int")

    def value(expr):
        return df.select(expr.alias("out")).collect()[0].out

    # Published pairs of statistic and p.
    assert value(T.f_tail(F.lit(33.709), F.lit(1), F.lit(2344))) == pytest.approx(7.268e-09, rel=1e-3)
    assert value(T.f_tail(F.lit(7.994), F.lit(1), F.lit(2344))) == pytest.approx(0.004733, rel=1e-3)
    assert value(T.chi2_tail_even(F.lit(24.334), 4)) == pytest.approx(6.845e-05, rel=1e-3)
    assert value(T.chi2_tail(F.lit(24.334), F.lit(4))) == pytest.approx(6.845e-05, rel=1e-3)
    assert value(T.chi2_tail(F.lit(3.841459), F.lit(1))) == pytest.approx(0.05, rel=1e-5)
    assert value(T.t_two_sided(F.lit(2.228139), F.lit(10))) == pytest.approx(0.05, rel=1e-5)
    assert value(T.normal_two_sided(F.lit(1.959964))) == pytest.approx(0.05, rel=1e-5)


def test_hints_never_hide_a_match(spark):
    import random

    from paneloom.functions.text import PII_PATTERNS, pattern_found, pattern_hints

    draw = random.Random(9)
    parts = ["a@b.co", "@handle", "+44 (0)20 7946 0958", "https://x.y", "www.z", "SW1A 1AA", "AB123456C", "123456789", "born in 1980", "DOB: 1 2 1999",
             "date of birth 2001", "MY NAME IS", "ı am called", "I'm called", "call me", "i worK for", "my boſs", "my employer", "my company", "i lİve in",
             "i'm from", "i am from", "My Address", "my postcode", "prolıfic", "Prolific", "٣٤٥٦٧٨٩٠١٢", "x", "", " ", "\n", ".", "reborn 1980", "dob"]
    rows = [(i, "".join(draw.choice(parts) + draw.choice(["", " ", "\n", "x", "."]) for _ in range(draw.randint(1, 4)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, t string").select("t", pattern_hints(F.col("t")).alias("h"))
    wrong = 0
    for name, p in PII_PATTERNS:
        wrong += df.where(pattern_found(F.col("t"), F.col("h"), name, p) != F.col("t").rlike(p)).count()
        assert df.where(F.col("t").rlike(p)).count() > 10, name
    assert wrong == 0


def test_lines_of_odd_texts(spark):
    from paneloom.functions import responses as parse

    texts = ["\t-2 \r\n  rankıng: 3, 1,2\r\nGeneral_Public_Stance : 1 \n2", "x 1\n1 \n 0\x0b\nRANKING 99999999999 2", "general_public_ﬆance: a: 1\nGENERAL_PUBLIC_STANCE: 2",
             "no RANKING: 1", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", parse.parse_lines(F.col("v")).alias("p"))
    got = [(r.p.new_belief, r.p.ranking, r.p.general_public_stance) for r in df.orderBy("i").collect()]
    assert got == [(-2, [3, 1, 2], 1), (0, [None, 2], None), (None, [], None), (None, [], None), (None, [], None), (None, [], None)]


def test_the_panel_is_unpivoted_and_its_text_made_without_a_lambda_per_row(spark):
    from paneloom.plans import tables as V

    plan = V.with_raw_text(V.responses(spark, "/root/testdata/sf0.001")).select("raw_response", F.length("raw_response"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan"):]
    assert "lambdafunction" not in physical and physical.count("I cannot answer.") == 1
