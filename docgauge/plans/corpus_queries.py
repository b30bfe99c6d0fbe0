"""Registered queries over parts of the corpus, its languages and words, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markings as mk
from ..model import METRICS
from ..operators import compliance as cp
from ..operators import language as lg
from ..operators import lexical as lx
from ..operators.catalog import catalog
from ..operators.scopes import scoped
from ..sources.tables import read_documents, read_table
from . import gate
from .measure import Measured, extend, records, select_families
from .record_shape import broken, field_names
from .queries import BOILER_SQL, CEILING, DEFECT_ENVELOPES, DEFECTS, FLAG_SQL, INTRA_SQL, NGRAM_SQL, SETTINGS, TOKENS_SQL, marks_sql, near_sql

SCOPES = [[], ["source"], ["lang"], ["source", "month"]]


def _scoped(spark, d, scopes=SCOPES):
    docs = read_documents(spark, d, defects=True, more=("lang",))
    docs = docs.withColumns({"source": F.col("source_system"), "month": F.substring("collected_at", 1, 7)})
    return scoped(docs, select_families(config=SETTINGS), scopes, compare=True)


def scoped_metrics(spark, d):
    """Every metric of every scope: all, by source, by language, by source and month."""
    return _scoped(spark, d).select("scope", "metric_id", "key", F.round("value", 4).alias("value"))


def scoped_findings(spark, d):
    """Each rule of the default policy judged in each scope."""
    judged = gate.judge(gate.load_policy(), gate.scoped_table(_scoped(spark, d)), every_scope=True)
    return judged.select("rule_id", "scope", "status", "severity", F.col("observed").cast("double").alias("observed"))


#: What is broken in which records, as expressions over doc_id: (field, every, column, value).
DAMAGE = (
    ("doc_hash", 97, "doc_hash", "upper(doc_hash)"), ("envelope/size_bytes", 89, "envelope.size_bytes", "-1L"), ("envelope/source_locator", 83, "envelope.source_locator", "cast(null as string)"),
    ("envelope/hash_alg", 79, "envelope.hash_alg", "'md5'"), ("envelope/reliability", 73, "envelope.reliability", "named_struct('source', 'G', 'information', '1')"), ("envelope/parent_hash", 71, "envelope.parent_hash", "'none'"),
    ("flags", 67, "flags", "array('no such flag')"), ("metrics/int.boilerplate_share", 61, "metrics.`int.boilerplate_share`", "1.5D"), ("metrics/cnt.token_count", 59, "metrics.`cnt.token_count`", "-1L"),
)


def record_validation(spark, d):
    """How many of the documents' records break each condition, after some of them were damaged."""
    families = select_families(["volume", "integrity"])
    m = extend(read_documents(spark, d), families).drop("text")
    rows = records(Measured(m, families, [], {})).withColumn("doc_id", F.col("envelope.source_locator").cast("long"))
    for _, every, column, value in DAMAGE:
        top, _, inner = column.partition(".")
        hit = F.col("doc_id") % every == 0
        told = F.when(hit, F.expr(value)).otherwise(F.col(column))
        rows = rows.withColumn(top, F.col(top).withField(inner, told) if inner else told)
    return broken(rows.drop("doc_id"), families)


def policy_rules(spark, d):
    """The default policy's thresholds beside what the documents show; null where the corpus run has no such number."""
    policy = gate.load_policy()
    seen = _scoped(spark, d, [[]]).where("key = 'value'").select("metric_id", F.col("value").alias("observed"))
    return policy.rule_table(spark).join(policy.limit_table(spark), "rule_id").join(seen, "metric_id", "left").select("rule_id", "metric_id", "level", "op", "limit", "severity", "observed")


def metric_catalog(spark, d):
    """The catalogue with what the documents show of each metric that is one number or has a median."""
    seen = _scoped(spark, d, [[]]).where("key IN ('value', 'p50')").select("metric_id", F.round("value", 4).alias("shown"))
    return catalog(spark).select("metric_id", "family", "unit").join(seen, "metric_id", "left")


HELD_OUT = "substring(sha2(cast(coalesce(text, '') AS binary), 256), 1, 1) IN ('0', '1', '2')"


def language_labels(spark, d):
    """Every document's language by a model of all documents, and whether it is mixed."""
    docs = read_table(spark, d, "documents")
    found = lg.identify(docs, lg.fit(docs))
    return found.select("doc_id", "label", F.round("confidence", 4).alias("confidence"), "second", "second_share", lg.is_mixed().alias("mixed"), "trigrams")


def language_held_out(spark, d):
    """How many documents the model of the others names rightly; copies of a text are on one side."""
    docs = read_table(spark, d, "documents")
    model = lg.fit(docs.where(f"NOT ({HELD_OUT})"))
    held = docs.where(f"{HELD_OUT} AND lang IS NOT NULL").select(F.struct("doc_id", "lang").alias("of"), "text")
    found = lg.identify(held, model, "of").groupBy("doc_id.lang")
    return found.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("label") == F.col("doc_id.lang")).alias("right"), F.count_if(F.col("label") == lg.UNKNOWN).alias("unknown"))


def script_profile(spark, d):
    return lg.scripts(read_table(spark, d, "documents"))


def lexical_diversity(spark, d):
    """Type-token ratio and MTLD of every document."""
    return read_table(spark, d, "documents").select("doc_id", lx.ttr(F.col("text")).alias("ttr"), lx.mtld(F.col("text")).alias("mtld"))


def salient_terms(spark, d):
    """The terms that tell each source from all others."""
    return lx.salient_terms(read_table(spark, d, "documents"), "source").withColumnRenamed("part", "source")


def pii_spans(spark, d):
    """The places of personal data in every document."""
    told = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return cp.scan(read_table(spark, d, "documents")).select("doc_id", F.size("spans").cast("long").alias("entities"), F.array_join(told, ",").alias("spans"))


def pii_categories(spark, d):
    """Entities, documents that have some, and their sources, by category."""
    rows = read_table(spark, d, "documents").select(F.struct("doc_id", "source").alias("of"), "text")
    found = cp.scan(rows, "of").select("doc_id", F.explode("spans.kind").alias("kind")).groupBy("kind", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("kind").agg(F.sum("n").alias("entities"), F.count(F.lit(1)).alias("docs"), F.countDistinct("doc_id.source").alias("sources"))


QUERIES = {
    "record_validation": record_validation, "policy_rules": policy_rules, "metric_catalog": metric_catalog, "scoped_metrics": scoped_metrics, "scoped_findings": scoped_findings, "language_labels": language_labels, "language_held_out": language_held_out, "script_profile": script_profile,
    "lexical_diversity": lexical_diversity, "salient_terms": salient_terms, "pii_spans": pii_spans, "pii_categories": pii_categories}


def _scopes_sql() -> str:
    """WITH ... v: (scope, metric_id, key, value)."""
    flags = ", ".join(f"{c} AS {n}" for n, c in FLAG_SQL.items())
    label = lambda *cols: "||','||".join(f"'{c}' || coalesce('=' || replace(replace(replace({c}, '%', '%25'), '=', '%3D'), ',', '%2C'), '')" for c in cols)
    rate = lambda x, of="count(*)": f"round_even(sum(({x})::INT)::DOUBLE / {of}, 6)"
    flagged = {"int.empty_rate": "empty", "int.near_empty_rate": "near_empty", "int.truncation_rate": "truncated", "int.mojibake_rate": "mojibake", "int.control_char_rate": "control_chars", "int.markup_residue_rate": "markup_residue",
               "int.large_rate": "large", "mark.coverage": "doc_top IS NOT NULL", "mark.conflict_rate": "conflict", "mark.redaction_residue_rate": "residue", "prov.undated_rate": "collected_at IS NULL",
               "prov.custody_complete_rate": "doc_id % 2 = 0", "prov.derived_share": "doc_id % 10 = 0", "dup.exact_rate": "exact_duplicate", "dup.near_rate": "near_duplicate"}
    cells = {m: rate(x) for m, x in flagged.items()} | {
        "dup.exact_count": "sum(exact_duplicate::INT)", "dup.near_count": "sum(near_duplicate::INT)", "vol.total_docs": "count(*)", "vol.total_tokens": "sum(tokens)", "int.empty_count": "sum(empty::INT)", "int.large_count": "sum(large::INT)",
        "mark.ceiling_breach": f"sum(coalesce(doc_top > {mk.LEVELS.index(CEILING) + 1}, false)::INT)", "prov.duplicate_id_count": "sum(clash::INT)",
        "prov.duplicate_id_rate": f"CASE WHEN count(source_id) > 0 THEN {rate('clash', 'count(source_id)')} END",
    }
    scalars = ", ".join(f"({{'m': '{m}', 'v': ({v})::DOUBLE}})" for m, v in cells.items())
    at = lambda p: f"list_sort(list(x))[1 + floor({p}::DOUBLE * (count(*) - 1))::BIGINT]"
    spread = {"min": "min(x)", "p50": at(0.5), "p95": at(0.95), "max": "max(x)", "mean": "avg(x)"}
    dist = []
    for m, x in (("cnt.token_count", "tokens"), ("int.boilerplate_share", "boiler"), ("int.intra_doc_repetition", "intra"), ("int.ngram_repetition", "reps")):
        own = spread | ({"p5": at(0.05), "var": "var_pop(x)"} if m == "cnt.token_count" else {"mean": "round_even(avg(x), 6)"})
        dist += [f"SELECT scope, '{m}' AS metric_id, '{k}' AS key, ({v})::DOUBLE AS value FROM (SELECT scope, {x}::DOUBLE AS x FROM g) GROUP BY scope" for k, v in own.items()]
    return f"""WITH n AS ({NGRAM_SQL}),
f AS (SELECT e.*, doc_top, conflict, residue, {TOKENS_SQL} AS tokens, {BOILER_SQL} AS boiler, {INTRA_SQL} AS intra, n.share AS reps, {flags}, substr(collected_at, 1, 7) AS month
      FROM {DEFECT_ENVELOPES} e JOIN {marks_sql(DEFECTS)} m USING (doc_id) JOIN n USING (doc_id)),
s AS (SELECT *, unnest(['all', {label("source")}, {label("lang")}, {label("month", "source")}]) AS scope FROM f),
pairs AS (WITH {near_sql(DEFECT_ENVELOPES, "x.doc_hash, y.doc_hash AS other")} SELECT * FROM p),
k AS (SELECT DISTINCT scope, doc_hash FROM s),
z AS (SELECT DISTINCT x.scope, x.doc_hash, true AS near FROM pairs JOIN k x ON x.doc_hash = pairs.doc_hash JOIN k y ON y.doc_hash = pairs.other AND y.scope = x.scope),
g AS (SELECT *, count(*) OVER (PARTITION BY scope, doc_hash) > 1 AS exact_duplicate,
  source_id IS NOT NULL AND min(doc_hash) OVER (PARTITION BY scope, source, source_id) <> max(doc_hash) OVER (PARTITION BY scope, source, source_id) AS clash, coalesce(near, false) AS near_duplicate
  FROM s LEFT JOIN z USING (scope, doc_hash)),
c AS (SELECT scope, unnest([{scalars}]) AS u FROM g GROUP BY scope),
v AS (SELECT scope, u.m AS metric_id, 'value' AS key, u.v AS value FROM c UNION ALL {" UNION ALL ".join(dist)})"""


def _scoped_findings_sql() -> str:
    policy = gate.load_policy()
    limits = ", ".join(f"('{r.rule_id}', '{r.metric_id}', {gate.LEVELS.index(t.level)}, '{t.level}', '{t.op}', {t.value}::DOUBLE, '{t.severity}')" for r in policy.rules for t in r.thresholds)
    rules = ", ".join(f"('{r.rule_id}', '{r.metric_id}')" for r in policy.rules)
    holds = " ".join(f"WHEN op = '{op}' THEN value {op.replace('==', '=').replace('!=', '<>')} lim" for op in gate.OPS)
    return f"""{_scopes_sql()},
r(rule_id, metric_id) AS (VALUES {rules}),
l(rule_id, metric_id, grave, level, op, lim, severity) AS (VALUES {limits}),
h AS (SELECT rule_id, scope, max_by(level, grave) AS level, max_by(severity, grave) AS severity FROM l JOIN v USING (metric_id) WHERE key = 'value' AND value IS NOT NULL AND (CASE {holds} END) GROUP BY ALL)
SELECT rule_id, scope, CASE WHEN value IS NULL THEN 'inconclusive' ELSE coalesce(level, 'pass') END AS status, coalesce(severity, 'none') AS severity, value AS observed
FROM r JOIN v USING (metric_id) LEFT JOIN h USING (rule_id, scope) WHERE key = 'value'"""


def _language_sql(train: str, told: str) -> str:
    """WITH ... o: each told document with label, confidence, second, second_share, n; train and told choose rows of d."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, substr(sha256(coalesce(text, '')), 1, 1) IN ('0', '1', '2') AS held,
  list_transform(string_split(concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')), ' '), ''), lambda x: unicode(x)) AS c FROM documents),
g AS (SELECT rid, doc_id, lang, held, unnest(list_zip(c[:-3], c[2:-2], c[3:])) AS z, unnest(range(0, len(c) - 2)) AS pos FROM d WHERE len(c) > 2),
b AS (SELECT rid, doc_id, lang, held, pos // {lg.PIECE} AS piece, (z[1] * {lg.FIRST} + z[2] * {lg.SECOND} + z[3]) % {lg.BUCKETS} AS cell FROM g),
k AS (SELECT lang, cell, count(*) AS c FROM b WHERE lang IS NOT NULL AND {train} GROUP BY ALL),
n AS (SELECT lang, sum(c) AS n FROM k GROUP BY 1),
m AS (SELECT n.lang, cells.cell, round(ln((coalesce(c, 0) + 1.0::DOUBLE) / (n + {lg.BUCKETS}::DOUBLE)) * 1000)::INT AS w FROM n CROSS JOIN (SELECT unnest(range(0, {lg.BUCKETS})) AS cell) cells LEFT JOIN k ON k.lang = n.lang AND k.cell = cells.cell),
p AS (SELECT rid, piece, m.lang, count(*) AS n, sum(w)::BIGINT AS s FROM b JOIN m USING (cell) WHERE {told} GROUP BY ALL),
own AS (SELECT rid, piece, n, lang FROM p QUALIFY row_number() OVER (PARTITION BY rid, piece ORDER BY s DESC, lang) = 1),
w AS (SELECT rid, lang, sum(n) AS n, sum(s) AS s FROM p GROUP BY ALL),
best AS (SELECT rid, lang AS best, n, 1 / (SELECT sum(exp((x.s - w.s) / 1000.0::DOUBLE / sqrt(w.n::DOUBLE))) FROM w x WHERE x.rid = w.rid) AS confidence FROM w QUALIFY row_number() OVER (PARTITION BY rid ORDER BY s DESC, lang) = 1),
other AS (SELECT own.rid, own.lang AS second, sum(own.n) AS most FROM own JOIN best ON best.rid = own.rid AND best.best <> own.lang GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY own.rid ORDER BY sum(own.n) DESC, own.lang) = 1),
o AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(round(confidence, 6), 0) AS confidence, CASE WHEN n >= {lg.LEAST} AND round(confidence, 6) >= {lg.SURE} THEN best ELSE '{lg.UNKNOWN}' END AS label, second, coalesce(round(most / n::DOUBLE, 6), 0) AS second_share
      FROM d LEFT JOIN best USING (rid) LEFT JOIN other USING (rid) WHERE {told})"""


def _scripts_sql() -> str:
    script = " ".join(f"WHEN c BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in lg.SCRIPTS)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), '') AS x FROM documents),
l AS (SELECT rid, unnest(x) AS x, unnest(range(0, len(x))) AS pos FROM d),
s AS (SELECT rid, pos, CASE {script} WHEN regexp_matches(x, '\p{{L}}') THEN 'Other' END AS script FROM (SELECT *, unicode(x) AS c FROM l)),
r AS (SELECT *, lag(script) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM s),
k AS (SELECT rid, script, count(*) AS c FROM r WHERE script IS NOT NULL GROUP BY ALL),
t AS (SELECT rid, script, c / sum(c) OVER (PARTITION BY rid) AS share FROM k QUALIFY row_number() OVER (PARTITION BY rid ORDER BY c DESC, script) = 1),
q AS (SELECT rid, count(*) FILTER (script IS NOT NULL AND (script = 'Other' OR prev IS NULL OR script <> prev)) AS runs, count(*) FILTER (script <> 'Other' AND prev <> 'Other' AND script <> prev) AS breaks FROM r GROUP BY 1)
SELECT doc_id, script, round(share, 6) AS share, coalesce(runs, 0) AS runs, coalesce(breaks, 0) AS breaks FROM d LEFT JOIN t USING (rid) LEFT JOIN q USING (rid)"""


_WORDS_SQL = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x))"


def _lexical_sql() -> str:
    state = lambda p, at, s, t, w: f"{{'p': {p}::BIGINT, 'at': {at}::BIGINT, 's': {s}::BIGINT, 't': {t}::BIGINT, 'w': {w}::BIGINT}}"
    types = "(a.t + (x.p < a.s)::BIGINT)"
    step = f"CASE WHEN {types} * 100 <= (a.at - a.s + 1) * {lx.THRESHOLD} THEN {state(0, 'a.at + 1', 'a.at + 1', 0, '(a.w + 1)')} ELSE {state(0, 'a.at + 1', 'a.s', types, 'a.w')} END"
    fold = lambda c: f"list_reduce(list_prepend({state(0, 0, 0, 0, 0)}, list_transform({c}, lambda x: {state('x', 0, 0, 0, 0)})), lambda a, x: {step})"
    factors = lambda c: f"({c}.w + CASE WHEN {c}.at > {c}.s THEN (1 - {c}.t::DOUBLE / ({c}.at - {c}.s)) / (1 - {lx.THRESHOLD / 100}::DOUBLE) ELSE 0 END)"
    one = lambda c: f"CASE WHEN {factors(c)} > 0 THEN n::DOUBLE / {factors(c)} ELSE n::DOUBLE END"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS ws FROM documents),
w AS (SELECT rid, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d),
p AS (SELECT rid, n, i, coalesce(lag(i) OVER v, -1) AS before, coalesce(n - 1 - lead(i) OVER v, -1) AS after FROM w WINDOW v AS (PARTITION BY rid, w ORDER BY i)),
l AS (SELECT rid, any_value(n) AS n, list(before ORDER BY i) AS f, list(after ORDER BY i DESC) AS b FROM p GROUP BY 1),
z AS (SELECT rid, n, {fold("f")} AS f, {fold("b")} AS b FROM l)
SELECT doc_id, CASE WHEN len(ws) > 0 THEN round_even(len(list_distinct(ws))::DOUBLE / len(ws), 6) END AS ttr, round_even(({one("f")} + {one("b")}) / 2, 6) AS mtld FROM d LEFT JOIN z USING (rid)"""


_SALIENT_SQL = f"""WITH w AS (SELECT source, unnest({_WORDS_SQL}) AS term FROM documents),
c AS (SELECT source, term, count(*) AS here FROM w GROUP BY ALL),
s AS (SELECT *, sum(here) OVER (PARTITION BY source) AS size, sum(here) OVER (PARTITION BY term) - here AS elsewhere, sum(here) OVER () AS total FROM c),
g AS (SELECT source, term, here, elsewhere::BIGINT AS elsewhere,
  round(2 * (here * ln(here / (size * ((here + elsewhere) / total::DOUBLE))) + CASE WHEN elsewhere > 0 THEN elsewhere * ln(elsewhere / ((total - size) * ((here + elsewhere) / total::DOUBLE))) ELSE 0 END), 4) AS score
  FROM s WHERE here * {lx.SUPPORT} >= size AND here * (total - size) > elsewhere * size)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS place, term, here, elsewhere, score FROM g QUALIFY place <= {lx.TOP}"""


def _pii_sql() -> str:
    """WITH ... o: (rid, doc_id, source, out), out the spans that are kept, in order."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
    flat = "replace(x, ' ', '')"
    values = f"list_transform(string_split(concat(substr({flat}, 5), substr({flat}, 1, 4)), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)"
    proof = {
        "iban": f"length({flat}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, {values}), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn} AND regexp_matches(x, '[1-9]')",
        "email": "length(x) <= 254",
        "ssn": "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:11] <> '0000'",
        "ipv4": "len(string_split(x, '.')) = 4 AND len(list_filter(string_split(x, '.'), lambda p: length(p) <= 3 AND (p = '0' OR p[1] <> '0') AND CASE WHEN length(p) <= 3 THEN p::INT <= 255 END)) = 4",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    found = " UNION ALL ".join(f"SELECT rid, {k} AS kind, string_split_regex(t, {q(p)}) AS gaps, regexp_extract_all(t, {q(p)}) AS xs FROM d" for k, p in enumerate(cp.PATTERNS.values()))
    good = " ".join(f"WHEN kind = {k} THEN {proof[n]}" for k, n in enumerate(cp.KINDS))
    state = lambda s, e, k, last, out: f"{{'s': {s}, 'e': {e}, 'k': {k}, 'last': {last}::BIGINT, 'out': {out}}}"
    names = "[" + ", ".join(f"'{k}'" for k in cp.KINDS) + "]"
    told = f"list_append(a.out, concat({names}[x.k + 1], ':', x.s, ':', x.e))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({found}),
u AS (SELECT rid, kind, unnest(gaps[1 : len(xs)]) AS gap, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM m),
p AS (SELECT rid, kind, x, sum(length(gap) + length(x)) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS e FROM u),
g AS (SELECT rid, kind, e - length(x) AS s, e FROM p WHERE CASE {good} END),
l AS (SELECT rid, list({state("s", "e", "kind", 0, "[]::VARCHAR[]")} ORDER BY s, e DESC, kind) AS xs FROM g GROUP BY 1),
k AS (SELECT rid, list_reduce(list_prepend({state("0::BIGINT", "0::BIGINT", "0", 0, "[]::VARCHAR[]")}, xs), lambda a, x: CASE WHEN x.s >= a.last THEN {state("x.s", "x.e", "x.k", "x.e", told)} ELSE {state("x.s", "x.e", "x.k", "a.last", "a.out")} END).out AS out FROM l),
o AS (SELECT rid, doc_id, source, coalesce(out, []) AS out FROM d LEFT JOIN k USING (rid))"""


def _catalog_sql() -> str:
    family = "CASE split_part(metric_id, '.', 1) WHEN 'dup' THEN 'duplication' WHEN 'vol' THEN 'volume' WHEN 'cnt' THEN 'volume' WHEN 'int' THEN 'integrity' WHEN 'mark' THEN 'markings' ELSE 'provenance' END"
    units = ", ".join(f"('{k}', {f"'{u}'" if u else 'NULL'})" for k, u in METRICS.items())
    return f"{_scopes_sql()}, u(metric_id, unit) AS (VALUES {units}) SELECT metric_id, {family} AS family, unit, round(value, 4) AS shown FROM u LEFT JOIN (SELECT * FROM v WHERE scope = 'all' AND key IN ('value', 'p50')) w USING (metric_id)"


def _rules_sql() -> str:
    rows = ", ".join(f"('{r.rule_id}', '{r.metric_id}', '{t.level}', '{t.op}', {t.value}::DOUBLE, '{t.severity}')" for r in gate.load_policy().rules for t in r.thresholds)
    return f"""{_scopes_sql()}, r(rule_id, metric_id, level, op, "limit", severity) AS (VALUES {rows}) SELECT r.*, value AS observed FROM r LEFT JOIN (SELECT * FROM v WHERE scope = 'all' AND key = 'value') w USING (metric_id)"""


def _validation_sql() -> str:
    # A damaged doc_hash is no longer the envelope's either.
    every = {f: f"doc_id % {n} = 0" for f, n, _, _ in DAMAGE}
    every["envelope/doc_hash"] = every["doc_hash"]
    columns = ["doc_hash", "envelope", "flags", "metrics"]
    fields = field_names(select_families(["volume", "integrity"]), columns)
    cells = ", ".join(f"{{'f': '{f}', 'n': count(*) FILTER ({every.get(f, 'false')})}}" for f in fields)
    return f"SELECT u.f AS field, u.n AS records FROM (SELECT unnest([{cells}]) AS u FROM documents)"


ORACLES = {
    "record_validation": _validation_sql(),
    "policy_rules": _rules_sql(),
    "metric_catalog": _catalog_sql(),
    "scoped_metrics": f"{_scopes_sql()} SELECT scope, metric_id, key, round(value, 4) AS value FROM v",
    "scoped_findings": _scoped_findings_sql(),
    "language_labels": f"{_language_sql('true', 'true')} SELECT doc_id, label, round(confidence, 4) AS confidence, second, second_share, second_share > {lg.SECOND_SHARE} AS mixed, n::BIGINT AS trigrams FROM o",
    "language_held_out": f"{_language_sql('NOT held', 'held')} SELECT lang, count(*) AS docs, count(*) FILTER (label = lang) AS right, count(*) FILTER (label = '{lg.UNKNOWN}') AS unknown FROM o WHERE lang IS NOT NULL GROUP BY 1",
    "script_profile": _scripts_sql(),
    "lexical_diversity": _lexical_sql(),
    "salient_terms": _SALIENT_SQL,
    "pii_spans": f"{_pii_sql()} SELECT doc_id, len(out) AS entities, array_to_string(out, ',') AS spans FROM o",
    "pii_categories": f"{_pii_sql()}, e AS (SELECT rid, doc_id, source, split_part(unnest(out), ':', 1) AS kind FROM o) SELECT kind, count(*) AS entities, count(DISTINCT (doc_id, source)) AS docs, count(DISTINCT source) AS sources FROM e GROUP BY 1",
}
