"""The registered queries of the measuring engine, and the same in SQL.

documents has no envelopes and hardly a defect; where a query needs them they are made from doc_id by
rules stated in sources/tables.py, equal in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markings as mk
from ..functions import text as tx
from ..operators.families import Integrity, Markings, Provenance
from ..operators.near import BANDS, PRIME, ROWS, SHINGLE, SLOTS, THRESHOLD, coefficients, near_hashes
from ..operators.quantiles import Spread, distributions
from ..sources.tables import DEFECT_SQL, read_documents, read_table
from . import gate
from .bundle import assess, compare
from .measure import extend, flag_array, measure, ranked_evidence, select_families
from .merkle import merkle_root

CEILING = "CUI"


def _one(spark: SparkSession, values: dict) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _rate(n, of):
    return F.bround(n / of, 6)


def vol_totals(spark, d):
    docs = read_documents(spark, d)
    per_hash = docs.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("c"), F.sum(tx.token_estimate(F.col("text"))).alias("t"))
    dup = F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0))
    return per_hash.agg(F.sum("c").alias("total_docs"), F.sum("t").alias("total_tokens"), dup.alias("exact_count"), _rate(dup, F.sum("c")).alias("exact_rate"))


def token_distribution(spark, d):
    rows = read_documents(spark, d).select(tx.token_estimate(F.col("text")).alias("v"))
    found = distributions(rows, {"v": Spread((("p5", 0.05), ("p50", 0.5), ("p95", 0.95)), var=True)}, ("v",))["v"]
    return _one(spark, found | {"var": round(found["var"], 2)})


def exact_duplicates(spark, d):
    groups = read_documents(spark, d).groupBy("doc_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return groups.where("copies > 1")


def near_duplicates(spark, d):
    docs = read_documents(spark, d)
    return docs.join(near_hashes(docs.select("doc_hash", "text")), "doc_hash", "left_semi").select("doc_id")


def integrity_rates(spark, d):
    flags = Integrity().columns()
    docs = read_documents(spark, d, defects=True)
    names = ("empty", "near_empty", "truncated", "mojibake", "control_chars", "markup_residue", "large")
    return docs.select(*[flags[n].alias(n) for n in names]).agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.col(n)).alias(n) for n in names])


def _share(fn):
    def run(spark, d):
        return read_documents(spark, d, defects=True).select("doc_id", fn(F.col("text")).alias("share"))

    return run


def share_distributions(spark, d):
    """The corpus distributions of the three document shares."""
    names = ("int.boilerplate_share", "int.intra_doc_repetition", "int.ngram_repetition")
    docs = read_documents(spark, d).withColumns({k: v for k, v in Integrity().columns().items() if k in names})
    told = distributions(docs, {m: Spread((("p50", 0.5), ("p95", 0.95))) for m in names})
    rows = [(m, *[float(found[k]) for k in ("min", "p50", "p95", "max", "mean")]) for m, found in told.items()]
    return spark.createDataFrame(rows, "metric_id string, min double, p50 double, p95 double, max double, mean double")


def markup_pages(spark, d):
    rows = read_table(spark, d, "pages").select("page_id", tx.has_markup(F.coalesce("html", F.lit(""))).alias("markup"), tx.has_markup(F.coalesce("url", F.lit(""))).alias("markup_in_url"))
    return rows


def control_chars(spark, d):
    return read_documents(spark, d, defects=True).where(tx.has_control_chars(F.col("text"))).select("doc_id")


def markings_parsed(spark, d):
    rows = mk.with_marks(read_documents(spark, d, defects=True).select("doc_id", "text"), "m")
    return rows.select("doc_id", "m.banner", "m.portion_max", "m.level", "m.marked", "m.conflict", "m.redaction_residue", F.array_join("m.controls", ",").alias("controls"))


def markings_metrics(spark, d):
    found = Markings().with_config(ceiling=CEILING)
    results = {r["metric_id"].split(".")[1]: r["value"] for r in found.results(found.extend(read_documents(spark, d, defects=True)))}
    return _one(spark, results)


def redaction_residue(spark, d):
    return mk.with_marks(read_documents(spark, d, defects=True).select("doc_id", "text"), "m").where("m.redaction_residue").select("doc_id")


def ceiling_breach(spark, d):
    rows = mk.with_marks(read_documents(spark, d, defects=True).select("doc_id", "text"), "m")
    return rows.where(mk.above(F.col("m.level"), CEILING)).select("doc_id")


def source_histogram(spark, d):
    return read_documents(spark, d).groupBy("source_system").agg(F.count(F.lit(1)).alias("docs"), F.sum("size_bytes").alias("bytes"))


def date_range(spark, d):
    return read_documents(spark, d).agg(F.min("collected_at").alias("first"), F.max("collected_at").alias("last"), F.count("collected_at").alias("dated"))


def provenance_rates(spark, d):
    docs = read_documents(spark, d)
    found = {r["metric_id"].split(".")[1]: r["value"] for r in Provenance().results(Provenance().extend(docs))}
    return _one(spark, {k: found[k] for k in ("undated_rate", "custody_complete_rate", "derived_share", "duplicate_id_count", "duplicate_id_rate")})


def reliability_histogram(spark, d):
    rel = F.concat(F.coalesce("reliability.source", F.lit("?")), F.coalesce("reliability.information", F.lit("?")))
    rated = F.col("reliability.source").isNotNull() | F.col("reliability.information").isNotNull()
    return read_documents(spark, d).groupBy(F.when(rated, rel).otherwise("unrated").alias("rating")).agg(F.count(F.lit(1)).alias("docs"))


def duplicate_source_ids(spark, d):
    return Provenance().extend(read_documents(spark, d)).where("duplicate_source_id").select("doc_id")


def sidecar_left_join(spark, d):
    """labels stands for the sidecar: its fields join the documents they name."""
    side = read_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("locator"), "quality")
    return read_documents(spark, d).join(side, F.col("source_locator") == F.col("locator"), "left").select("doc_id", "quality")


def sidecar_anti_join(spark, d):
    """Sidecar rows, half of them shifted to locators beyond the documents, that name no document."""
    side = read_table(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 1_000_000_000).otherwise(0)).cast("string").alias("locator"))
    return side.join(read_documents(spark, d).select(F.col("source_locator").alias("locator")), "locator", "left_anti")


#: Every flag of the families.
FLAGS = ("exact_duplicate", "near_duplicate", "empty", "near_empty", "truncated", "mojibake", "control_chars", "markup_residue", "large", "unmarked", "marking_conflict", "ceiling_breach", "redaction_residue", "undated", "duplicate_source_id")
SETTINGS = {"markings": {"ceiling": CEILING}}


def gate_findings(spark, d):
    """The default policy over all families."""
    m = measure(read_documents(spark, d, defects=True), config=SETTINGS)
    found = assess(m, gate.load_policy())
    m.docs.unpersist()
    rows = [(f["finding_id"], f["status"], f["severity"], float(f["observed"]), len(f.get("evidence", []))) for f in found]
    return spark.createDataFrame(rows, "finding_id string, status string, severity string, observed double, evidence long")


def _flagged(spark, d):
    return extend(read_documents(spark, d, defects=True), select_families(config=SETTINGS))


def evidence_topk(spark, d):
    """The first five hashes of each flag, in record order."""
    return ranked_evidence(_flagged(spark, d), list(FLAGS), 5).withColumn("place", F.col("place").cast("long"))


def record_flags(spark, d):
    """Every flag of every document."""
    return _flagged(spark, d).select("doc_id", F.coalesce(F.array_join(flag_array(list(FLAGS)), ","), F.lit("")).alias("flags"))


def first_per_hash(spark, d):
    return read_documents(spark, d).groupBy("doc_hash").agg(F.min("doc_id").alias("doc_id"))


def verify_diff(spark, d):
    """Files against records, where every 23rd file is gone, every 29th changed and every 31st new."""
    docs = read_documents(spark, d).select("doc_id", "doc_hash", "source_locator")
    here = docs.where("doc_id % 23 <> 0").withColumn("doc_hash", F.when(F.col("doc_id") % 29 == 0, F.sha2(F.lit("changed").cast("binary"), 256)).otherwise(F.col("doc_hash")))
    more = docs.where("doc_id % 31 = 0").withColumn("source_locator", F.concat(F.lit("new-"), "source_locator"))
    return compare(docs, here.unionByName(more)).select("locator", "state")


def language_counts(spark, d):
    """An addition: a scope by language."""
    rows = read_table(spark, d, "documents")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(tx.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))


def merkle(spark, d):
    docs = read_documents(spark, d)
    return _one(spark, {"root": merkle_root(docs), "leaves": docs.select("doc_hash").distinct().count()})


def _flat(prefix: str, value) -> list[tuple]:
    """(key, number, text) of a result's value or distribution, nested keys joined by points."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _flat(f"{prefix}.{k}", v)]
    return [(prefix, round(float(value), 4) if isinstance(value, (int, float)) else None, value if isinstance(value, str) else None)]


def all_metrics(spark, d):
    """The full run: every family's results, one row for each number in them."""
    m = measure(read_documents(spark, d), config=SETTINGS)
    m.docs.unpersist()
    rows = [(r["metric_id"], *x) for r in m.results for x in _flat("value", r["value"]) + (_flat("distribution", r["distribution"]) if r.get("distribution") else [])]
    return spark.createDataFrame(rows, "metric_id string, key string, number double, text string")


QUERIES = {
    "vol_totals": vol_totals, "token_distribution": token_distribution, "exact_duplicates": exact_duplicates, "near_duplicates": near_duplicates,
    "integrity_rates": integrity_rates, "boilerplate_share": _share(tx.boilerplate_share), "intra_doc_repetition": _share(tx.intra_doc_repetition),
    "ngram_repetition": _share(tx.ngram_repetition), "share_distributions": share_distributions, "markup_pages": markup_pages, "control_chars": control_chars,
    "markings_parsed": markings_parsed, "markings_metrics": markings_metrics, "redaction_residue": redaction_residue, "ceiling_breach": ceiling_breach,
    "source_histogram": source_histogram, "date_range": date_range, "provenance_rates": provenance_rates, "reliability_histogram": reliability_histogram,
    "duplicate_source_ids": duplicate_source_ids, "sidecar_left_join": sidecar_left_join, "sidecar_anti_join": sidecar_anti_join, "gate_findings": gate_findings,
    "evidence_topk": evidence_topk, "record_flags": record_flags, "first_per_hash": first_per_hash, "verify_diff": verify_diff, "language_counts": language_counts,
    "merkle_root": merkle, "all_metrics": all_metrics,
}

# --- the same in SQL ---------------------------------------------------------

_Q = lambda s: s.replace("'", "''")
_SP, _TAG, _ENT = _Q(tx.SPACE), _Q(tx.TAG), _Q(tx.ENTITY)
_BAN = _Q(mk.BANNER)
_TOK = "CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, round_even(length(t) / 3.6::DOUBLE, 0)) END::BIGINT"
_PLAIN = "(SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)"
_BAD = f"(SELECT doc_id, source, lang, text AS t FROM {DEFECT_SQL} q)"
_ENV = """(SELECT *, sha256(t) AS doc_hash, strlen(t) AS size_bytes,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id // 40 AS VARCHAR) END AS source_id,
  CASE WHEN doc_id % 9 <> 0 THEN '2026-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS collected_at,
  CASE WHEN doc_id % 3 = 0 THEN ['A', 'B', 'C'][1 + (doc_id % 9) // 3] || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '?' END ELSE 'unrated' END AS rating
  FROM {0})"""
_LINES = f"list_filter(list_transform(regexp_split_to_array(t, '{_Q(tx.LINE_BREAK)}'), lambda x: regexp_replace(x, '^[{_SP}]+|[{_SP}]+$', '', 'g')), lambda x: x <> '')"
_TAIL = (
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[{_SP}]+$', ''), '(?:(?:^|\\n)[{_SP}]*(?:TOP SECRET|SECRET|CONFIDENTIAL|UNCLASSIFIED|CONTROLLED UNCLASSIFIED INFORMATION|CUI)"
    f"(?://[A-Z0-9][A-Z0-9 ,/\\-]*)?[{_SP}]*)+$', ''), '{_TAG}', '', 'g'), '{_ENT}', '', 'g'), '[{_SP}]+$', '')"
)
_FLAGS = {
    "empty": f"NOT regexp_matches(t, '[^{_SP}]')",
    "near_empty": f"{_TOK} < 20",
    "truncated": f"({_TOK} >= 20 AND {_TAIL} <> '' AND NOT contains('{_Q(tx.TERMINAL)}', right({_TAIL}, 1)))",
    "mojibake": f"regexp_matches(t, '{_Q(tx.MOJIBAKE)}')",
    "control_chars": f"regexp_matches(t, '{_Q(tx.CONTROL)}')",
    "markup_residue": f"(regexp_matches(t, '{_TAG}') OR regexp_matches(t, '{_ENT}'))",
    "large": "strlen(t) > 10485760",
}
_W = r"[\p{L}\p{N}_]+"
_BOILER = f"""CASE WHEN len({_LINES}) < 2 THEN 0.0 ELSE round_even(len(list_filter({_LINES}, lambda x: len(regexp_extract_all(x, '{_W}')) < 4 OR regexp_matches(x, '{_Q(tx.BOILERPLATE).replace("(?iu)", "(?i)")}')))::DOUBLE / len({_LINES}), 6) END"""
_LOW = f"list_transform({_LINES}, lambda x: regexp_replace(lower(x), '[{_SP}]+', ' ', 'g'))"
_INTRA = f"CASE WHEN len({_LINES}) < 2 THEN 0.0 ELSE round_even((len({_LINES}) - len(list_distinct({_LOW})))::DOUBLE / len({_LINES}), 6) END"
_NGRAM = """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{w}'), lambda x: lower(x)) AS ws FROM {src}),
p AS (SELECT doc_id, i, ws, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM p, (VALUES (2), (3), (4)) AS s(n) WHERE i + n - 1 <= len(ws)),
r AS (SELECT doc_id, i, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM r),
s AS (SELECT c.doc_id, n, sum(length(word)) AS covered FROM c JOIN p ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1, 2),
a AS (SELECT doc_id, sum(length(word)) AS total FROM p GROUP BY 1),
o AS (SELECT src.doc_id, coalesce(round_even(max(covered)::DOUBLE / any_value(total), 6), 0.0) AS share FROM {src} src LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY 1)
SELECT doc_id, share FROM o"""
_RANK = "['U', 'CUI', 'C', 'S', 'TS']"
_MARK = f"""(SELECT *, greatest(top, ptop) AS doc_top, (nl > 1 OR coalesce(top <> ptop, false)) AS conflict FROM (
  SELECT *, list_max(list_transform(banners, lambda x: lv(x))) AS top, len(list_distinct(list_transform(banners, lambda x: lv(x)))) AS nl,
    list_max(list_transform(list_filter(list_transform(others, lambda x: regexp_extract(x, '{_Q(mk.PORTION)}', 1)), lambda x: x <> ''), lambda x: list_position({_RANK}, x))) AS ptop,
    len(list_filter(others, lambda x: regexp_matches(x, '(?i)\\[(?:REDACTED|DELETED|WITHHELD|REMOVED)\\]|\\(b\\)\\(\\d\\)|[█■]{{3,}}|\\bX{{6,}}\\b') OR regexp_matches(x, '\\b(TOP SECRET|SECRET|CONFIDENTIAL|UNCLASSIFIED|CONTROLLED UNCLASSIFIED INFORMATION|CUI)//[A-Z][A-Z0-9 ,/\\-]*'))) > 0 AS residue,
    list_sort(list_distinct(list_filter(flatten(list_transform(banners, lambda x: string_split(regexp_extract(x, '{_BAN}', 2), '//'))), lambda x: x <> ''))) AS controls
  FROM (SELECT doc_id, list_distinct(list_filter(rows, lambda x: regexp_matches(x, '{_BAN}'))) AS banners, list_filter(rows, lambda x: NOT regexp_matches(x, '{_BAN}')) AS others
    FROM (SELECT doc_id, regexp_split_to_array(t, '{_Q(tx.LINE_BREAK)}') AS rows FROM {_BAD} b) l) k) z)"""
_WORDS_RANK = "CASE regexp_extract(x, '" + _BAN + "', 1) " + " ".join(f"WHEN '{k}' THEN {mk.LEVELS.index(v) + 1}" for k, v in mk.LEVEL_WORDS.items()) + " END"
_MARK = _MARK.replace("lv(x)", f"({_WORDS_RANK})")


def _marks(rows: str) -> str:
    """The parsed marks of a table (doc_id, t)."""
    return _MARK.replace(f"FROM {_BAD} b", f"FROM {rows} b")


_PENV, _BENV = _ENV.format(_PLAIN + " e"), _ENV.format(_BAD + " e")
_IDS = "(source_id IS NOT NULL AND min(doc_hash) OVER (PARTITION BY source, source_id) <> max(doc_hash) OVER (PARTITION BY source, source_id))"


def _near_pairs(env: str, told: str = "x.doc_hash") -> str:
    """CTEs ending in p, the hashes with a near neighbour."""
    ab = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients()))
    need = int(-(-THRESHOLD * SLOTS // 1))
    return f"""d AS (SELECT doc_hash, any_value(t) AS t FROM {env} x GROUP BY 1),
w AS (SELECT doc_hash, regexp_extract_all(lower(t), '{_W}') AS ws FROM d),
s AS (SELECT DISTINCT doc_hash, CAST('0x' || substr(sha1(array_to_string(ws[i : i + {SHINGLE - 1}], ' ')), 1, 7) AS BIGINT) AS h FROM w, unnest(range(1, len(ws) - {SHINGLE - 2})) AS u(i)),
m AS (SELECT doc_hash, k, min((a * h + b) % {PRIME}) AS v FROM s, (VALUES {ab}) AS c(k, a, b) GROUP BY 1, 2),
g AS (SELECT doc_hash, list(v ORDER BY k) AS sig FROM m GROUP BY 1),
b AS (SELECT doc_hash, sig, band, sig[band * {ROWS} + 1 : band * {ROWS} + {ROWS}] AS key FROM g, unnest(range(0, {BANDS})) AS u(band)),
p AS (SELECT DISTINCT {told} FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_hash <> y.doc_hash
  WHERE len(list_filter(range(1, {SLOTS + 1}), lambda i: x.sig[i] = y.sig[i])) >= {need})"""


def _flags_sql(rows: str, env: str) -> str:
    """WITH ... f: documents with their envelope, doc_top, conflict, residue and each of FLAGS."""
    more = {
        "exact_duplicate": "count(*) OVER (PARTITION BY doc_hash) > 1", "near_duplicate": "doc_hash IN (SELECT doc_hash FROM p)", "unmarked": "doc_top IS NULL", "marking_conflict": "conflict",
        "ceiling_breach": f"coalesce(doc_top > {mk.LEVELS.index(CEILING) + 1}, false)", "redaction_residue": "residue", "undated": "collected_at IS NULL", "duplicate_source_id": _IDS,
    } | _FLAGS
    cols = ", ".join(f"{more[x]} AS {x}" for x in FLAGS)
    return f"WITH {_near_pairs(env)},\nf AS (SELECT e.*, doc_top, {cols} FROM {env} e JOIN {_marks(rows)} m USING (doc_id))"


def _gate_sql() -> str:
    rules, metrics = [], {}
    share = {"dup.exact_rate": "exact_duplicate", "dup.near_rate": "near_duplicate", "prov.undated_rate": "undated", "int.empty_rate": "empty", "int.mojibake_rate": "mojibake", "int.control_char_rate": "control_chars",
             "int.near_empty_rate": "near_empty", "int.truncation_rate": "truncated", "int.markup_residue_rate": "markup_residue", "mark.conflict_rate": "marking_conflict", "mark.redaction_residue_rate": "redaction_residue"}
    for k, flag in share.items():
        metrics[k] = (f"round_even(sum({flag}::INT)::DOUBLE / count(*), 6)", flag)
    metrics["prov.duplicate_id_rate"] = ("round_even(sum(duplicate_source_id::INT)::DOUBLE / count(source_id), 6)", "duplicate_source_id")
    metrics["mark.ceiling_breach"] = ("sum(ceiling_breach::INT)::DOUBLE", "ceiling_breach")
    for r in gate.load_policy().rules:
        cell = {t.level: f"'{t.op}', {t.value}, '{t.severity}'" for t in r.thresholds}
        rules.append(f"('{r.rule_id}', '{r.metric_id}', {cell.get('flag', 'NULL, NULL, NULL')}, {cell.get('fail', 'NULL, NULL, NULL')})")
    values = " UNION ALL ".join(f"SELECT '{k}' AS metric_id, {v} AS v, (SELECT count(DISTINCT doc_hash) FROM f WHERE {flag}) AS hashes FROM f" for k, (v, flag) in metrics.items())
    hit = lambda k: f"(({k}_op = '>' AND v > {k}_v) OR ({k}_op = '<' AND v < {k}_v))"
    return f"""{_flags_sql(_BAD, _BENV)},
v AS ({values}),
r(finding_id, metric_id, flag_op, flag_v, flag_s, fail_op, fail_v, fail_s) AS (VALUES {', '.join(rules)}),
j AS (SELECT finding_id, v, hashes, CASE WHEN {hit('fail')} THEN 'fail' WHEN {hit('flag')} THEN 'flag' ELSE 'pass' END AS status, flag_s, fail_s FROM r JOIN v USING (metric_id))
SELECT finding_id, status, CASE status WHEN 'fail' THEN fail_s WHEN 'flag' THEN flag_s ELSE 'none' END AS severity, v AS observed,
  CASE WHEN status = 'pass' THEN 0 ELSE least(hashes, 50) END AS evidence FROM j"""


def _topk_sql() -> str:
    each = (f"SELECT '{n}' AS flag, doc_hash, place FROM (SELECT doc_hash, row_number() OVER (ORDER BY doc_hash) AS place FROM (SELECT DISTINCT doc_hash FROM f WHERE {n})) WHERE place <= 5" for n in FLAGS)
    return f"{_flags_sql(_BAD, _BENV)} {' UNION ALL '.join(each)}"


def _record_flags_sql() -> str:
    return f"{_flags_sql(_BAD, _BENV)} SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in sorted(FLAGS))}) AS flags FROM f"


_DIST = "list_sort(list(v))[1 + floor({p}::DOUBLE * (count(*) - 1))::BIGINT]"

_MERKLE = f"""WITH RECURSIVE leaves AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sha256(t) AS h FROM {_PLAIN} p)),
t AS (SELECT h, i, n FROM leaves
  UNION ALL SELECT CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END, i // 2, any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY i // 2)
SELECT coalesce((SELECT h FROM t WHERE n = 1), sha256('')) AS root, (SELECT count(*) FROM leaves) AS leaves"""


def _all_metrics_sql() -> str:
    """One row for each number of each result, as _flat() gives them."""
    rows = []

    def add(metric: str, value: str, key: str = "value", source: str = "f", text: bool = False) -> None:
        number, told = ("NULL", value) if text else (f"round(({value})::DOUBLE, 4)", "NULL")
        rows.append(f"SELECT '{metric}' AS metric_id, {key if '||' in key else f"'{key}'"} AS key, {number}::DOUBLE AS number, {told}::VARCHAR AS text FROM {source}")

    def rate(metric: str, flag: str) -> None:
        add(metric, f"round_even(sum(({flag})::INT)::DOUBLE / count(*), 6)")

    for metric, flag in (("dup.exact", "exact_duplicate"), ("dup.near", "near_duplicate"), ("int.empty", "empty"), ("int.large", "large")):
        add(f"{metric}_count", f"sum({flag}::INT)")
        rate(f"{metric}_rate", flag)
    add("vol.total_docs", "count(*)")
    add("vol.total_tokens", f"sum({_TOK})")
    for metric, flag in (("int.near_empty_rate", "near_empty"), ("int.truncation_rate", "truncated"), ("int.mojibake_rate", "mojibake"), ("int.control_char_rate", "control_chars"), ("int.markup_residue_rate", "markup_residue"),
                         ("mark.coverage", "NOT unmarked"), ("mark.conflict_rate", "marking_conflict"), ("mark.redaction_residue_rate", "redaction_residue"), ("prov.undated_rate", "undated"),
                         ("prov.custody_complete_rate", "doc_id % 2 = 0"), ("prov.derived_share", "doc_id % 10 = 0")):
        rate(metric, flag)
    add("mark.ceiling_breach", "sum(ceiling_breach::INT)")
    spread = {"min": "min(v)", "p5": _DIST.format(p=0.05), "p50": _DIST.format(p=0.5), "p95": _DIST.format(p=0.95), "max": "max(v)", "mean": "avg(v)", "var": "var_pop(v)"}
    shares = {"cnt.token_count": f"(SELECT {_TOK} AS v FROM f)", "int.boilerplate_share": f"(SELECT {_BOILER} AS v FROM f)", "int.intra_doc_repetition": f"(SELECT {_INTRA} AS v FROM f)", "int.ngram_repetition": "(SELECT share AS v FROM reps)"}
    for metric, source in shares.items():
        rows.append(f"SELECT '{metric}', 'value', NULL, NULL")
        for key, value in spread.items():
            if metric == "cnt.token_count" or key not in ("p5", "var"):
                add(metric, value, f"distribution.{key}", f"{source} v")
    for key, value in (("docs", "count(*)"), ("bytes", "sum(size_bytes)")):
        add("prov.source_histogram", value, f"'value.' || source || '.{key}'", "f GROUP BY source")
    add("prov.reliability_histogram", "count(*)", "'value.' || rating", "f GROUP BY rating")
    for key, value in (("min", "min(collected_at)"), ("max", "max(collected_at)")):
        add("prov.date_range", value, f"value.{key}", text=True)
    add("prov.date_range", "count(collected_at)", "value.dated")
    add("prov.duplicate_id_count", "sum(duplicate_source_id::INT)")
    add("prov.duplicate_id_rate", "round_even(sum(duplicate_source_id::INT)::DOUBLE / count(source_id), 6)")
    return f"{_flags_sql(_PLAIN, _PENV)}, reps AS ({_NGRAM.format(w=_W, src=_PLAIN)}) {' UNION ALL '.join(rows)}"


ORACLES = {
    "vol_totals": f"SELECT count(*) AS total_docs, sum(k)::BIGINT AS total_tokens, sum((c > 1)::INT)::BIGINT AS exact_count, round_even(sum((c > 1)::INT)::DOUBLE / count(*), 6) AS exact_rate FROM (SELECT {_TOK} AS k, count(*) OVER (PARTITION BY sha256(t)) AS c FROM {_PLAIN} p)",
    "token_distribution": f"SELECT min(v) AS min, {_DIST.format(p=0.05)} AS p5, {_DIST.format(p=0.5)} AS p50, {_DIST.format(p=0.95)} AS p95, max(v) AS max, round_even(avg(v), 6) AS mean, round_even(var_pop(v), 2) AS var FROM (SELECT {_TOK} AS v FROM {_PLAIN} p)",
    "exact_duplicates": f"SELECT doc_hash, count(*) AS copies, min(doc_id) AS first_id FROM {_PENV} x GROUP BY 1 HAVING count(*) > 1",
    "near_duplicates": f"WITH {_near_pairs(_PENV)} SELECT doc_id FROM {_PENV} x WHERE doc_hash IN (SELECT doc_hash FROM p)",
    "integrity_rates": "SELECT count(*) AS docs, " + ", ".join(f"sum(({c})::INT)::BIGINT AS {n}" for n, c in _FLAGS.items()) + f" FROM {_BAD} b",
    "boilerplate_share": f"SELECT doc_id, {_BOILER} AS share FROM {_BAD} b",
    "intra_doc_repetition": f"SELECT doc_id, {_INTRA} AS share FROM {_BAD} b",
    # A tie at the sixth place is rounded on the binary value by Python and on the decimal one by SQL.
    "ngram_repetition": _NGRAM.format(w=_W, src=_BAD),
    "share_distributions": f"WITH m AS (SELECT 'int.boilerplate_share' AS metric_id, {_BOILER} AS v FROM {_PLAIN} b UNION ALL SELECT 'int.intra_doc_repetition', {_INTRA} FROM {_PLAIN} b UNION ALL SELECT 'int.ngram_repetition', share FROM ({_NGRAM.format(w=_W, src=_PLAIN)}) n) SELECT metric_id, min(v) AS min, {_DIST.format(p=0.5)} AS p50, {_DIST.format(p=0.95)} AS p95, max(v) AS max, round_even(avg(v), 6) AS mean FROM m GROUP BY 1",
    "markup_pages": f"SELECT page_id, {_FLAGS['markup_residue']} AS markup, {_FLAGS['markup_residue'].replace('(t,', '(u,')} AS markup_in_url FROM (SELECT page_id, coalesce(html, '') AS t, coalesce(url, '') AS u FROM pages)",
    "control_chars": f"SELECT doc_id FROM {_BAD} b WHERE {_FLAGS['control_chars']}",
    "markings_parsed": f"SELECT doc_id, {_RANK}[top] AS banner, {_RANK}[ptop] AS portion_max, {_RANK}[doc_top] AS level, doc_top IS NOT NULL AS marked, conflict, residue AS redaction_residue, array_to_string(controls, ',') AS controls FROM {_MARK} m",
    "markings_metrics": f"SELECT round_even(sum((doc_top IS NOT NULL)::INT)::DOUBLE / count(*), 6) AS coverage, round_even(sum(conflict::INT)::DOUBLE / count(*), 6) AS conflict_rate, sum(coalesce(doc_top > {mk.LEVELS.index(CEILING) + 1}, false)::INT)::BIGINT AS ceiling_breach, round_even(sum(residue::INT)::DOUBLE / count(*), 6) AS redaction_residue_rate FROM {_MARK} m",
    "redaction_residue": f"SELECT doc_id FROM {_MARK} m WHERE residue",
    "ceiling_breach": f"SELECT doc_id FROM {_MARK} m WHERE doc_top > {mk.LEVELS.index(CEILING) + 1}",
    "source_histogram": f"SELECT source AS source_system, count(*) AS docs, sum(size_bytes)::BIGINT AS bytes FROM {_PENV} x GROUP BY 1",
    "date_range": f"SELECT min(collected_at) AS first, max(collected_at) AS last, count(collected_at) AS dated FROM {_PENV} x",
    "provenance_rates": f"SELECT round_even(sum((collected_at IS NULL)::INT)::DOUBLE / count(*), 6) AS undated_rate, round_even(sum((doc_id % 2 = 0)::INT)::DOUBLE / count(*), 6) AS custody_complete_rate, round_even(sum((doc_id % 10 = 0)::INT)::DOUBLE / count(*), 6) AS derived_share, sum(x::INT)::BIGINT AS duplicate_id_count, round_even(sum(x::INT)::DOUBLE / count(source_id), 6) AS duplicate_id_rate FROM (SELECT *, {_IDS} AS x FROM {_PENV} y)",
    "reliability_histogram": f"SELECT rating, count(*) AS docs FROM {_PENV} x GROUP BY 1",
    "duplicate_source_ids": f"SELECT doc_id FROM (SELECT doc_id, {_IDS} AS x FROM {_PENV} y) WHERE x",
    "sidecar_left_join": "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "sidecar_anti_join": "SELECT CAST(doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR) AS locator FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id + CASE WHEN l.doc_id % 2 = 0 THEN 1000000000 ELSE 0 END)",
    "gate_findings": _gate_sql(),
    "evidence_topk": _topk_sql(),
    "record_flags": _record_flags_sql(),
    "first_per_hash": f"SELECT doc_hash, min(doc_id) AS doc_id FROM {_PENV} x GROUP BY 1",
    "verify_diff": "SELECT CAST(doc_id AS VARCHAR) AS locator, CASE WHEN doc_id % 23 = 0 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE doc_id % 23 = 0 OR doc_id % 29 = 0 UNION ALL SELECT 'new-' || doc_id, 'added' FROM documents WHERE doc_id % 31 = 0",
    "merkle_root": _MERKLE,
    "all_metrics": _all_metrics_sql(),
    "language_counts": f"SELECT lang, count(*) AS docs, sum({_TOK})::BIGINT AS tokens FROM {_PLAIN} p GROUP BY 1",
}

#: Parts of the SQL that other modules' queries are stated with.
PLAIN_SQL, TOKENS_SQL, FLAG_SQL, MERKLE_SQL, DEFECT_ENVELOPES, BOILER_SQL, INTRA_SQL, NGRAM_SQL = _PLAIN, _TOK, _FLAGS, _MERKLE, _BENV, _BOILER, _INTRA, _NGRAM.format(w=_W, src=_BAD)
marks_sql, near_sql, DEFECTS = _marks, _near_pairs, _BAD
