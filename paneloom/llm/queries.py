"""The registered queries of this folder: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

import corpus_pipeline
from paneloom.llm import (decontaminate, filter_audit, infill, langid, licenses, mixture, ngram_join, packing, pii, quality, secrets, suffixes,
                          warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_outliers")
def op1(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op2_source_mixture", f"WITH {mixture.mix_sql()} SELECT doc_id, size, source_size, target, taken FROM mixed")
def op2(spark, sf_dir):
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_language")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_license_notices")
def op4(spark, sf_dir):
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("licenses", lambda x: x["base"])
    first = F.transform(base, lambda x: x["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    closeness = F.transform("licenses", lambda x: 1.0 - x["edits"] / x["length"])
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("licenses")).alias("labels"), F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"))


_OP5 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to FROM m"""


@query("op5_warc_archive", _OP5)
def op5(spark, sf_dir):
    folder = warc.archive_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_ngram_jaccard_join")
def op6(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_secret_scan")
def op7(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return pii.digest(found, secrets.KINDS, secrets.BASE_KINDS, True, "secrets")


# Windows of 400 bytes that start at two places or more; covered bytes and runs from the order of their starts.
_OP8 = """WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
w AS (SELECT r, i, md5(hex(raw[i:i + 399])) AS h FROM (SELECT r, raw, unnest(range(1, octet_length(raw) - 398)) AS i FROM b WHERE octet_length(raw) >= 400)),
t AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS fresh FROM t),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM (SELECT r, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM g) GROUP BY r, n),
k AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS from_, a AS upto FROM s UNION ALL SELECT r, max(e), NULL FROM s GROUP BY r),
p AS (SELECT k.r, string_agg(CASE WHEN coalesce(upto, octet_length(raw) + 1) > from_ THEN hex(raw[from_:coalesce(upto, octet_length(raw) + 1) - 1]) ELSE '' END, '' ORDER BY from_) AS kept
  FROM k JOIN b USING (r) GROUP BY k.r),
c AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY r)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(unhex(kept), raw)) AS kept_sha256 FROM b LEFT JOIN c USING (r) LEFT JOIN p USING (r)"""


@query("op8_repeated_strings", _OP8)
def op8(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP9 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


@query("op9_decontamination", _OP9)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_personal_data")
def op10(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return pii.digest(found, pii.KINDS, pii.BASE_KINDS, False, "pii")


@query("op11_filter_interactions", filter_audit.interactions_sql())
def op11(spark, sf_dir):
    counters = filter_audit.count_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
    return filter_audit.interactions(counters)


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op12_packed_sequences")
def op12(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_OP13 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n,
  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1) AS a, ('0x' || h[9:16])::UBIGINT % (n + 1) AS b,
  ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS e FROM d),
f AS (SELECT doc_id, n, x, least(a, b)::BIGINT AS p, greatest(a, b)::BIGINT AS q,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR c >= 90 THEN 'plain'
    WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
t AS (SELECT *, substr(x, 1, p) AS pre, substr(x, p + 1, q - p) AS mid, substr(x, q + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN p END AS prefix_chars, CASE WHEN form != 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM t"""


@query("op13_fill_in_middle", _OP13)
def op13(spark, sf_dir):
    done = infill.assemble(infill.pieces(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").cast("bigint").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


# The exact base of operators whose verdict or additions have no SQL, each from its operator's own output.

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, {_SPACED} AS ws FROM documents),
n AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(x, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
w AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
t AS (SELECT r, i FROM w JOIN (SELECT r, win FROM w GROUP BY r, win HAVING count(*) > 1) USING (r, win)),
p AS (SELECT r, count(DISTINCT q) AS n_rep FROM (SELECT r, unnest(range(i, i + 5)) AS q FROM t) GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""


@query("llm_quality_base", _QUALITY)
def quality_base(spark, sf_dir):
    return op1(spark, sf_dir).drop("kept")


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
f AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{label}', {p.count(' ') + 1})" for p, label in licenses.PHRASES.items())}) v(phrase, label, n)),
m AS (SELECT r, label, i - 1 AS place FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) JOIN f ON array_to_string(ws[i:i + n - 1], ' ') = phrase)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY r) USING (r)"""


@query("llm_license_base", _PHRASES)
def license_base(spark, sf_dir):
    return op4(spark, sf_dir).drop("labels", "score")


def _matches(kind: str, order: int, pattern: str, holds: str, group: int = 0) -> str:
    """Leftmost non-overlapping matches of a pattern with their places: what stands between them has known lengths."""
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, s, s + length(m) AS e, v FROM (
  SELECT r, ms[k] AS m, vs[k] AS v, list_sum(list_transform(between[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda y: length(y))), 0) AS s
  FROM (SELECT r, ms, vs, between, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT r, regexp_extract_all(x, '{pattern}') AS ms, regexp_extract_all(x, '{pattern}', {group}) AS vs,
    string_split_regex(x, '{pattern}') AS between FROM d))) WHERE {holds}"""


def _base_sql(kinds: list[str], matches: list[str], by: str) -> str:
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END)::BIGINT AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
m AS ({' UNION ALL '.join(matches)})
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN (SELECT r, {counts}, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY {by}) AS spans FROM m GROUP BY r) USING (r)"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query("llm_secret_base", _base_sql(["assign", "access", "hex"], [
    _matches("assign", 1, _ASSIGN, "length(v) >= 12", 1), _matches("access", 2, "AKIA[A-Z0-9]+", "length(m) >= 18"),
    _matches("hex", 3, "[0-9a-f]+", "length(m) >= 16")], "s, o"))
def secret_base(spark, sf_dir):
    return op7(spark, sf_dir).drop("spans")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""(list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT
  ELSE (2 * substr(reverse({_DIGITS}), i, 1)::INT) // 10 + (2 * substr(reverse({_DIGITS}), i, 1)::INT) % 10 END)) % 10 = 0)"""


@query("llm_personal_base", _base_sql(["email", "ip", "card", "phone"], [
    _matches("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _matches("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda y: y::HUGEINT)) <= 255"),
    _matches("card", 3, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    _matches("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")], "o, s"))
def personal_base(spark, sf_dir):
    return op10(spark, sf_dir).drop("spans")
