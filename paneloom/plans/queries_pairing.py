"""Queries for pairing, joins, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.operators import pairing as P
from paneloom.plans import tables as V
from paneloom.plans.registry import query, r6, sq6

_C = F.col


@query("flagship_delta_mae_by_item_source", f"""WITH {V.PAIRED}
SELECT item, source, count(*) AS n, {sq6('avg(h - y)')} AS delta, {sq6('avg(abs(h - y))')} AS mae
FROM paired GROUP BY item, source""")
def flagship(spark, sf_dir):
    d = _C("h") - _C("y")
    return V.paired(spark, sf_dir).groupBy("item", "source").agg(
        F.count("*").alias("n"), r6(F.avg(d)).alias("delta"), r6(F.avg(F.abs(d))).alias("mae"))


@query("flt1_design_cell", f"""WITH {V.PAIRED}
SELECT source, count(*) AS n, CAST(sum(h - y) AS BIGINT) AS sum_diff FROM paired
WHERE item = 'A' AND cell = 'package2' GROUP BY source""")
def flt1(spark, sf_dir):
    cell = P.restrict(V.paired(spark, sf_dir), item="A", cell="package2")
    return cell.groupBy("source").agg(F.count("*").alias("n"), F.sum(_C("h") - _C("y")).alias("sum_diff"))


@query("flt1_empty_cell_stops", f"""WITH {V.PAIRED} SELECT c.item, c.cell, (SELECT count(*) FROM paired p WHERE p.item = c.item AND p.cell = c.cell) = 0 AS stopped
FROM (SELECT unnest(['A', 'N', 'A', 'none']) AS item, unnest(['package1', 'package3', 'package9', 'package1']) AS cell) c""")
def flt1_empty(spark, sf_dir):
    """Which of some asked cells stop the job."""
    paired, out = V.paired(spark, sf_dir), []
    for item, cell in (("A", "package1"), ("N", "package3"), ("A", "package9"), ("none", "package1")):
        try:
            P.restrict(paired, item, cell)
            out.append((item, cell, False))
        except ValueError:
            out.append((item, cell, True))
    return spark.createDataFrame(out, "item string, cell string, stopped boolean")


@query("flt2_complete_case_drops", f"""WITH {V.PANEL}, c AS (SELECT subject, item, round FROM panel WHERE src = 1),
w AS (SELECT subject, item, round, src FROM c CROSS JOIN (SELECT unnest(range(2, 8)) AS src))
SELECT 'model_' || w.src AS source, count(*) - count(p.y) AS n_dropped
FROM w LEFT JOIN panel p ON p.subject = w.subject AND p.item = w.item AND p.round = w.round AND p.src = w.src GROUP BY 1""")
def flt2(spark, sf_dir):
    return P.dropped_counts(P.assemble(V.panel(spark, sf_dir), V.CANDIDATES), V.CANDIDATES)


@query("flt3_null_counts_before_test", f"""WITH {V.PANEL}
SELECT source, count(*) - count(h) AS null_h, count(*) - count(y) AS null_y FROM panel GROUP BY source""")
def flt3(spark, sf_dir):
    return P.null_counts(V.panel(spark, sf_dir), ["source"], ["h", "y"])


@query("flt4_exclude_sources", f"""WITH {V.RESP}
SELECT source, count(*) AS n FROM resp WHERE source NOT IN ('model_4', 'model_7') GROUP BY source""")
def flt4(spark, sf_dir):
    excluded = V.inline(spark, ["source"], [("model_4",), ("model_7",)])
    return (V.responses(spark, sf_dir).join(excluded, "source", "left_anti")
            .groupBy("source").agg(F.count("*").alias("n")))


@query("flt5_first_subjects", f"""WITH {V.RESP}
SELECT subject, item, round, source, raw FROM resp
WHERE subject IN (SELECT DISTINCT subject FROM resp ORDER BY subject LIMIT 10)""")
def flt5(spark, sf_dir):
    resp = V.responses(spark, sf_dir).select("subject", "item", "round", "source", "raw")
    return P.first_subjects(resp, "subject", 10)


@query("join1_paired_inner", f"""WITH {V.RESP}
SELECT b.subject, b.item, b.round, c.source AS source_c, b.y AS y_b, c.y AS y_c
FROM resp b JOIN resp c ON b.subject = c.subject AND b.item = c.item AND b.round = c.round WHERE b.src = 1 AND c.src > 1""")
def join1(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    base = resp.where(_C("src") == 1).select("subject", "item", "round", "y")
    cand = resp.where(_C("src") > 1).select("subject", "item", "round", "source", "y")
    return P.pair(base, cand, P.KEYS).select("subject", "item", "round", "source_c", "y_b", "y_c")


@query("join1_duplicate_key_check", """SELECT l_orderkey, l_linenumber, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def join1_dup(spark, sf_dir):
    return P.duplicate_keys(V.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("join2_condition_mismatch", f"""WITH {V.PANEL}
SELECT source, count(*) AS n_mismatched FROM panel WHERE src > 1 AND cell_seen IS DISTINCT FROM cell
GROUP BY source""")
def join2(spark, sf_dir):
    cand = V.panel(spark, sf_dir).where(_C("src") > 1)
    return (P.condition_mismatches(cand, "cell", "cell_seen").groupBy("source")
            .agg(F.count("*").alias("n_mismatched")))


@query("join3_coverage_gaps", f"""WITH {V.RESP}, b AS (SELECT subject, item, round, 'model_' || k AS source FROM resp CROSS JOIN (SELECT unnest(range(2, 8)) AS k) WHERE src = 1),
c AS (SELECT subject, item, round, source FROM resp WHERE src > 1)
SELECT *, 'left' AS only_in FROM (SELECT * FROM b EXCEPT SELECT * FROM c)
UNION ALL SELECT *, 'right' FROM (SELECT * FROM c EXCEPT SELECT * FROM b)""")
def join3(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    base = resp.where(_C("src") == 1).select(*P.KEYS, F.explode(F.array(*[F.lit(s) for s in V.CANDIDATES])).alias("source"))
    return P.coverage_gaps(base, resp.where(_C("src") > 1), [*P.KEYS, "source"])


@query("join4_pairing_audit", f"""WITH {V.RESP}, b AS (
  SELECT r.*, s.source AS cand FROM resp r CROSS JOIN (SELECT DISTINCT source FROM resp WHERE src > 1) s WHERE r.src = 1),
c AS (SELECT * FROM resp WHERE src > 1),
j AS (SELECT coalesce(b.cand, c.source) AS source, b.subject IS NOT NULL AND c.subject IS NOT NULL AS m,
  b.statement AS sb, c.statement AS sc, b.cell_seen AS kb, c.cell_seen AS kc, b.order_seen AS ob, c.order_seen AS oc
  FROM b FULL OUTER JOIN c ON b.subject = c.subject AND b.item = c.item AND b.round = c.round AND b.cand = c.source)
SELECT source, CAST(sum(CASE WHEN NOT m THEN 1 ELSE 0 END) AS BIGINT) AS unmatched,
  CAST(sum(CASE WHEN m AND sb IS DISTINCT FROM sc THEN 1 ELSE 0 END) AS BIGINT) AS differs_statement,
  CAST(sum(CASE WHEN m AND kb IS DISTINCT FROM kc THEN 1 ELSE 0 END) AS BIGINT) AS differs_cell_seen,
  CAST(sum(CASE WHEN m AND ob IS DISTINCT FROM oc THEN 1 ELSE 0 END) AS BIGINT) AS differs_order_seen
FROM j GROUP BY source""")
def join4(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    base = resp.where(_C("src") == 1).withColumn(
        "source", F.explode(F.array(*[F.lit(s) for s in V.CANDIDATES])))
    return P.pairing_audit(base, resp.where(_C("src") > 1), P.KEYS, ["source"],
                           ["statement", "cell_seen", "order_seen"])


@query("join5_assemble_wide", f"""WITH {V.PANEL}
SELECT subject, item, round, max(cell) AS cell, max(init) AS init, max(h) AS h, max(polarity) AS polarity,
{', '.join(f"max(CASE WHEN source = '{s}' THEN y END) AS {s}" for s in V.CANDIDATES)}
FROM panel GROUP BY subject, item, round""")
def join5(spark, sf_dir):
    return P.assemble(V.panel(spark, sf_dir), V.CANDIDATES)


@query("join6_three_way", f"""WITH {V.PANEL}, cmp AS (SELECT * FROM (VALUES {V.SQL_PAIRS}) v(base, other))
SELECT base, other, a.subject, a.item, a.round, a.h AS baseline, a.y AS base_run, b.y AS ablation FROM cmp JOIN panel a ON a.source = base
JOIN panel b ON b.source = other AND a.subject = b.subject AND a.item = b.item AND a.round = b.round
WHERE a.y IS NOT NULL AND b.y IS NOT NULL AND a.cell = a.cell_seen AND b.cell = b.cell_seen""")
def join6(spark, sf_dir):
    agreed = V.panel(spark, sf_dir).where((_C("src") > 1) & (_C("cell") == _C("cell_seen")))
    return V.compared(P.assemble(agreed, V.CANDIDATES)).select(
        "base", "other", *P.KEYS, _C("h").alias("baseline"), _C("y_base").alias("base_run"), _C("y_other").alias("ablation"))


@query("join7_subject_dimension", f"""WITH {V.PAIRED}
SELECT c_mktsegment AS segment, source, count(*) AS n, {sq6('avg(y - init)')} AS mean_change
FROM paired LEFT JOIN customer ON c_custkey = subject GROUP BY 1, 2""")
def join7(spark, sf_dir):
    dim = V.table(spark, sf_dir, "customer").select(
        _C("c_custkey").alias("subject"), _C("c_mktsegment").alias("segment"))
    # The change is summed per subject first, so the join carries one row per subject and source.
    per = V.paired(spark, sf_dir).groupBy("subject", "source").agg(
        F.count("*").alias("n"), F.sum(_C("y") - _C("init")).alias("s"))
    return P.attach_dimension(per, dim, "subject").groupBy("segment", "source").agg(
        F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("mean_change"))


@query("join8_first_seen_text", """WITH t AS (SELECT lang, source, arg_min(text, doc_id) AS first_text FROM documents GROUP BY 1, 2)
SELECT d.doc_id, t.first_text FROM documents d LEFT JOIN t ON d.lang = t.lang AND d.source = t.source""")
def join8(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    firsts = P.first_text(docs, ["lang", "source"], "text", "doc_id").withColumnRenamed("text", "first_text")
    return P.attach_short(docs.select("doc_id", "lang", "source"), firsts, ["lang", "source"], "left", 1000).select("doc_id", "first_text")


@query("join9_exactly_one_prior", f"""WITH {V.PANEL}
SELECT c.subject, c.item, c.round, c.source, b.own_init_raw AS prior_init FROM panel c
JOIN panel b ON b.subject = c.subject AND b.item = c.item AND b.round = c.round AND b.src = 1 WHERE c.src > 1""")
def join9(spark, sf_dir):
    panel = V.panel(spark, sf_dir)
    prior = panel.where(_C("src") == 1).select("subject", "item", "round", _C("own_init_raw").alias("prior_init"))
    todo = panel.where(_C("src") > 1).select("subject", "item", "round", "source")
    return P.lookup_exactly_one(todo, prior, P.KEYS, "prior_init")


@query("join10_left_join_on_statement", f"""WITH {V.PANEL}
SELECT b.subject, b.statement, b.round, 'model_' || k AS source, b.init, m.y - b.init AS shift FROM panel b CROSS JOIN (SELECT unnest(range(2, 8)) AS k)
LEFT JOIN panel m ON m.subject = b.subject AND m.statement = b.statement AND m.round = b.round AND m.src = k WHERE b.src = 1""")
def join10(spark, sf_dir):
    panel = V.panel(spark, sf_dir)
    base = panel.where(_C("src") == 1).select(
        "subject", "statement", "round", "init", F.explode(F.array(*[F.lit(s) for s in V.CANDIDATES])).alias("source"))
    model = panel.where(_C("src") > 1).select("subject", "statement", "round", "source", "y")
    return base.join(model, ["subject", "statement", "round", "source"], "left").select(
        "subject", "statement", "round", "source", "init", (_C("y") - _C("init")).alias("shift"))


@query("join11_keys_shared_by_all", f"""WITH {V.RESP}
SELECT subject, item, round FROM resp GROUP BY 1, 2, 3 HAVING count(DISTINCT source) = 7""")
def join11(spark, sf_dir):
    return P.shared_keys(V.responses(spark, sf_dir), P.KEYS, "source", 7)


def _rank_match(spark, sf_dir, lines=None):
    """Baseline ranks beside every candidate's, in the baseline convention."""
    return _matched(V.rankings(spark, sf_dir, lines))


def counted_rank_match(spark, sf_dir, lines=None):
    """The same with `n` equal pairs of orderings of a cell and source to a row, so a pair is taken apart once and not per case."""
    both = V.rankings(spark, sf_dir, lines).drop("subject", "round")
    pairs = [c for c in both.columns if c not in ("item", "cell", "source")]
    counted = both.groupBy(*both.columns).agg(F.count("*").alias("n"))
    # Behind a generator, so that filters on whole orderings see counted rows and are not moved below the count.
    kept = ["item", "cell", "source", "n"]
    return _matched(counted.select(*kept, F.explode(F.array(F.struct(*pairs))).alias("_p")).select(*kept, "_p.*"))


def _matched(both):
    from paneloom.functions import ranks as R

    base, cand = R.triple(_C("r1_b"), _C("r2_b"), _C("r3_b")), R.triple(_C("r1"), _C("r2"), _C("r3"))
    joined = both.withColumns({"hb": R.valid_triple(base), "mc": R.invert(cand)}).drop("r1_b", "r2_b", "r3_b", "r1", "r2", "r3")
    return P.skip_reasons(joined, [
        ("missing", _C("answered").isNull()),
        ("invalid_rank", _C("hb").isNull() | _C("mc").isNull()),
        ("other_stimulus", _C("order_b") != _C("order_c")),
    ])


RANK_MATCH = V.RESP + """,
cand AS (SELECT *, CASE WHEN list_sort([r1, r2, r3]) = [1, 2, 3]
    THEN [list_position([r1, r2, r3], 1), list_position([r1, r2, r3], 2), list_position([r1, r2, r3], 3)] END AS mc
  FROM resp WHERE src > 1),
basel AS (SELECT subject, item, round, cell, order_seen AS order_b, 'model_' || k AS source,
    CASE WHEN list_sort([r1, r2, r3]) = [1, 2, 3] THEN [r1, r2, r3] END AS hb
  FROM resp CROSS JOIN (SELECT unnest(range(2, 8)) AS k) WHERE src = 1),
rank_match AS (SELECT b.*, c.mc,
    CASE WHEN c.subject IS NULL THEN 'missing' WHEN hb IS NULL OR mc IS NULL THEN 'invalid_rank'
      WHEN order_b <> c.order_seen THEN 'other_stimulus' END AS reason
  FROM basel b LEFT JOIN cand c ON c.subject = b.subject AND c.item = b.item AND c.round = b.round AND c.source = b.source)"""


@query("join12_skip_accounting", f"""WITH {RANK_MATCH}
SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM rank_match GROUP BY 1, 2""")
def join12(spark, sf_dir):
    return _rank_match(spark, sf_dir).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("n"))


@query("join13_resume_remaining", f"""WITH {V.RESP}, todo AS (SELECT DISTINCT subject, 'model_' || k AS source FROM resp CROSS JOIN (SELECT unnest(range(2, 8)) AS k))
SELECT subject, source FROM todo EXCEPT SELECT subject, source FROM resp WHERE src > 1 GROUP BY 1, 2 HAVING count(*) >= 2""")
def join13(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    todo = resp.select("subject").distinct().select("subject", F.explode(F.array(*[F.lit(s) for s in V.CANDIDATES])).alias("source"))
    return P.remaining(todo, resp.where(_C("src") > 1), ["subject", "source"], expected=2)


@query("join14_registry_coverage", """WITH reg AS (SELECT 'src_' || n_nationkey AS name FROM nation),
disk AS (SELECT DISTINCT 'src_' || (c_nationkey + 3) AS name FROM customer)
SELECT name, 'unregistered' AS problem FROM (SELECT * FROM disk EXCEPT SELECT * FROM reg)
UNION ALL SELECT name, 'ghost' FROM (SELECT * FROM reg EXCEPT SELECT * FROM disk)""")
def join14(spark, sf_dir):
    from paneloom.sources.registry import coverage

    reg = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("src_"), _C("n_nationkey")).alias("name"))
    disk = V.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("src_"), _C("c_nationkey") + 3).alias("name")).distinct()
    return coverage(reg, disk, "name")


@query("join15_cross_check_normalised", f"""WITH {V.PANEL}
SELECT item, count(*) AS n, CAST(sum(CASE WHEN own_init_raw * polarity <> init THEN 1 ELSE 0 END) AS BIGINT) AS n_differs
FROM panel GROUP BY item""")
def join15(spark, sf_dir):
    recomputed = _C("own_init_raw") * _C("polarity")
    return V.panel(spark, sf_dir).groupBy("item").agg(
        F.count("*").alias("n"), F.sum(F.when(recomputed != _C("init"), 1).otherwise(0)).alias("n_differs"))


@query("join16_source_pairs", f"""WITH {V.RESP}, s AS (SELECT DISTINCT source, src AS ord FROM resp)
SELECT x.source AS a, y.source AS b, x.ord AS ord_a, y.ord AS ord_b FROM s x JOIN s y ON x.ord < y.ord""")
def join16(spark, sf_dir):
    order = V.responses(spark, sf_dir).select("source", _C("src").alias("ord")).distinct()
    return P.source_pairs(order)


@query("join17_concordant_pairs", f"""WITH {RANK_MATCH},
k AS (SELECT *, (CASE WHEN (hb[1]-hb[2])*(mc[1]-mc[2])>0 THEN 1 ELSE 0 END
  + CASE WHEN (hb[1]-hb[3])*(mc[1]-mc[3])>0 THEN 1 ELSE 0 END
  + CASE WHEN (hb[2]-hb[3])*(mc[2]-mc[3])>0 THEN 1 ELSE 0 END) AS concordant FROM rank_match WHERE reason IS NULL)
SELECT source, concordant, count(*) AS n FROM k GROUP BY 1, 2""")
def join17(spark, sf_dir):
    from paneloom.functions import ranks as R

    kept = _rank_match(spark, sf_dir).where(_C("reason").isNull())
    tau = R.kendall_tau(_C("hb"), _C("mc"))
    return kept.groupBy("source", F.round((tau * 3 + 3) / 2).cast("int").alias("concordant")).agg(
        F.count("*").alias("n"))


@query("join18_layout_check", f"""WITH {V.RESP}
SELECT r.subject, r.item, r.round, r.source FROM resp r
WHERE r.cell_seen <> 'package' || (r.subject % 3 + 1) OR r.order_seen <> r.subject % 6""")
def join18(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    # The study layout: one assignment per subject, joined back to what each source recorded.
    study = V.table(spark, sf_dir, "orders").select(_C("o_custkey").alias("subject")).distinct().select(
        "subject", F.concat(F.lit("package"), _C("subject") % 3 + 1).alias("assigned_cell"),
        (_C("subject") % 6).alias("assigned_order"))
    return resp.join(study, "subject").where(
        (_C("cell_seen") != _C("assigned_cell")) | (_C("order_seen") != _C("assigned_order"))
    ).select("subject", "item", "round", "source")


@query("set1_union_sources", f"""WITH {V.RESP}
SELECT 'observed' AS sample, item, count(*) AS n FROM resp WHERE src = 1 GROUP BY item
UNION ALL SELECT 'simulated', item, count(*) FROM resp WHERE src > 1 GROUP BY item""")
def set1(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    stacked = resp.where(_C("src") == 1).withColumn("sample", F.lit("observed")).unionByName(
        resp.where(_C("src") > 1).withColumn("sample", F.lit("simulated")))
    return stacked.groupBy("sample", "item").agg(F.count("*").alias("n"))


@query("set2_intersect_keys", f"""WITH {V.RESP}, cmp AS (SELECT * FROM (VALUES {V.SQL_PAIRS}) v(base, other))
SELECT base, other, subject, item, round FROM cmp JOIN resp ON source = base
INTERSECT SELECT base, other, subject, item, round FROM cmp JOIN resp ON source = other""")
def set2(spark, sf_dir):
    resp = V.responses(spark, sf_dir)
    sides = [resp.select(F.explode(F.array(*[
        F.when(_C("source") == pair[side], F.struct(F.lit(pair[0]).alias("base"), F.lit(pair[1]).alias("other"))) for pair in V.PAIRS])).alias("p"),
        *P.KEYS).where(_C("p").isNotNull()).select("p.*", *P.KEYS) for side in (0, 1)]
    return sides[0].intersect(sides[1])


@query("set3_difference_ids", """SELECT c_custkey AS subject FROM customer
EXCEPT SELECT o_custkey FROM orders""")
def set3(spark, sf_dir):
    customers = V.table(spark, sf_dir, "customer").select(_C("c_custkey").alias("subject"))
    return customers.exceptAll(V.table(spark, sf_dir, "orders").select(_C("o_custkey").alias("subject")).distinct())


@query("set4_distinct_union_ids", """SELECT c_custkey AS subject FROM customer UNION
SELECT o_custkey FROM orders UNION SELECT user_id FROM events""")
def set4(spark, sf_dir):
    ids = V.table(spark, sf_dir, "customer").select(_C("c_custkey").alias("subject"))
    for name, column in (("orders", "o_custkey"), ("events", "user_id")):
        ids = ids.unionByName(V.table(spark, sf_dir, name).select(_C(column).alias("subject")))
    return ids.distinct()


@query("win3_keep_last", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def win3(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return P.latest_wins(ev, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")
