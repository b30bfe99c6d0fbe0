"""Secret scan: patterns of known kinds, and strings that pass a battery of randomness tests.

Base kinds are found by patterns (BASE). The method adds spans of kind ``random``: runs of at least LEAST characters of the alphabets
below, whose encoding is inferred from the characters they use. A run is tested in the alphabet of its encoding.

* Chi-squared: how far the symbols' counts are from even ones.
* Runs: how often the run changes between the lower and the upper half of the alphabet (Wald and Wolfowitz).
* Serial correlation of neighbouring symbols, lag 1.

A run that any of the three tells from randomness (together at level VETO) is no secret. For the others the chi-squared statistic is read the
other way round: how likely is a value so small if the run were written text, whose symbols meet their like with probability KAPPA?
Such a value grows with the length, and longer runs are judged apart from shorter ones: in each class of LENGTHS the procedure of Benjamini and Hochberg holds
the share of text among the runs found to FALSE. Its counts are taken over all runs of all documents, by class and score, in steps of 1 / STEPS;
each step counts with its worse end, so that the bound holds. This table has some hundred rows, whatever the corpus.

Texts are read once; nothing but spans leaves the scan, and nothing is shuffled but that table. All is in DataFrame functions.

Defined cases: a null text is empty and has no spans; repeated rows each get their result; spans of one kind never overlap, spans of
two kinds may, and a random span may lie in a base span; texts and runs of any length are tested whole (places are summed in
blocks, so that a text of a great many spans does not take the square of their number); an empty table gives an
empty result; further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import matches
from .common import LOWER, UPPER, pin, read, text_of

DIGITS = "0123456789"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
#: Kind, pattern, group that is measured, and its least length. Kinds are listed in this order.
BASE = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 and more: a later start in the same run would be shorter still
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(b[0] for b in BASE), "random")

#: Runs that may be an encoding.
LEAST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Encoding, its alphabet, what a run must match, and KAPPA: how often two symbols of text in this alphabet are the same.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", "^(?:[0-9a-f]+|[0-9A-F]+)$", 0.1),
    ("base32", UPPER + "234567", "^[A-Z2-7]+$", 0.065),
    ("base36", DIGITS + LOWER, "^(?:[0-9a-z]+|[0-9A-Z]+)$", 0.065),
    ("base64", UPPER + LOWER + DIGITS + "+/", "^[A-Za-z0-9+/]+$", 0.06),
    ("base64url", UPPER + LOWER + DIGITS + "-_", "^[A-Za-z0-9_-]+$", 0.06),
)
FOLDED = ("hex", "base36")
VETO, FALSE = 0.001, 0.05
#: Classes of lengths, by their least.
LENGTHS = (20, 24, 32, 48, 64, 128)
#: Steps of a standard deviation, and the lowest score told apart.
STEPS, LOWEST = 20, -8
_normal = NormalDist()
LIMIT_ONE, LIMIT_TWO = round(_normal.inv_cdf(1 - VETO / 3), 6), round(_normal.inv_cdf(1 - VETO / 6), 6)
#: The worse end of each score's step; the last one is for runs without any evidence.
LAST = -LOWEST * STEPS
P_VALUES = [round(_normal.cdf(LOWEST + (k + 1) / STEPS), 12) for k in range(LAST)] + [1.0]

def _base(text: Column) -> Column:
    """Spans (start, kind, end) of the base kinds; kind is its place in KINDS."""

    def of(kind: int, pattern: str, group: int, least: int) -> Column:
        good = F.filter(matches(text, pattern, group), lambda m: F.length(m["found"]) >= least)
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    # What a text must hold for a match, as far as that is cheaper to see than the pattern.
    hints = [F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), F.contains(text, F.lit("AKIA")), F.lit(True)]
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.array_sort(F.concat(*[F.coalesce(F.when(hint, of(k, *b[1:])), none) for k, (hint, b) in enumerate(zip(hints, BASE))]))


def _encoding(run: Column) -> Column:
    mixed = run.rlike("[A-Za-z]") & run.rlike("[0-9]")
    both = run.rlike("[A-Z]") & run.rlike("[a-z]") & run.rlike("[0-9]")
    out = F.lit(None).cast("int")
    for k, (name, _, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when((both if name.startswith("base64") else mixed) & run.rlike(pattern), k).otherwise(out)
    return out


def _runs(text: Column) -> Column:
    """Runs with an encoding: start, end, encoding (its place), s (in the case of its alphabet, without padding)."""
    bare = F.transform(matches(text, RUN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.rtrim(m["found"], F.lit("=")).alias("s")))
    long_ = F.filter(bare, lambda m: (F.length(m["s"]) >= LEAST) & m["s"].rlike("[0-9]"))
    told = F.filter(F.transform(long_, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _encoding(m["s"]).alias("encoding"), m["s"].alias("s"))), lambda m: m["encoding"].isNotNull())
    folds = [k for k, e in enumerate(ENCODINGS) if e[0] in FOLDED]
    return F.transform(told, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding"), F.when(m["encoding"].isin(folds), F.lower(m["s"])).otherwise(m["s"]).alias("s")))


def _with(row: Column, names: list[str], **more: Column) -> Column:
    return F.struct(*[row[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def _each(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scored(runs: Column) -> Column:
    """_runs() with length, the statistics chi, changes and serial (as standard normal scores), text (chi's score if the run were text), class and step."""
    keep = ["start", "end", "encoding"]
    alphabets, halves = [e[1] for e in ENCODINGS], ["0" * (len(e[1]) // 2) + "1" * (len(e[1]) - len(e[1]) // 2) for e in ENCODINGS]
    pick = lambda values, m: F.get(_each(values), m["encoding"])
    # Each transform computes what the next one uses more than once.
    a = F.transform(runs, lambda m: _with(m, [*keep, "s"], alphabet=pick(alphabets, m), n=F.length(m["s"]).cast("double"), k=pick([float(len(x)) for x in alphabets], m), kappa=pick([e[3] for e in ENCODINGS], m)))
    held = lambda s, c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double")

    def counted(m: Column) -> Column:
        symbols = F.sequence(F.lit(1), F.length(m["alphabet"]))
        squares = F.aggregate(symbols, F.lit(0.0), lambda t, i: t + F.pow(held(m["s"], F.substring(m["alphabet"], i, F.lit(1))), F.lit(2.0)))
        values = F.transform(F.split(m["s"], ""), lambda c: (F.call_function("instr", m["alphabet"], c) - 1).cast("double"))
        return _with(m, [*keep, "n", "k", "kappa"], squares=squares, bits=F.call_function("translate", m["s"], m["alphabet"], pick(halves, m)), v=values)

    def summed(m: Column) -> Column:
        add = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
        v, ones = m["v"], held(m["bits"], F.lit("1"))
        nexts = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda x, y: x * y)
        return _with(
            m, [*keep, "n", "k", "kappa"], chi2=m["k"] * m["squares"] / m["n"] - m["n"], ones=ones, zeros=m["n"] - ones,
            runs=(F.regexp_count(m["bits"], F.lit("01")) + F.regexp_count(m["bits"], F.lit("10")) + 1).cast("double"),
            sum=add(v), square=add(F.transform(v, lambda x: x * x)), cross=add(nexts), ends=F.get(v, F.lit(0)) + F.get(v, F.size(v) - 1),
        )

    def judged(m: Column) -> Column:
        n, k, free = m["n"], m["k"], m["k"] - 1.0
        root = F.pow(m["chi2"] / free, F.lit(1 / 3))
        chi = (root - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free))  # Wilson and Hilferty
        extra = n * (k * m["kappa"] - 1.0)
        text = (m["chi2"] - (free + extra)) / F.sqrt(2.0 * (free + 2.0 * extra))
        mean = 2.0 * m["ones"] * m["zeros"] / n + 1.0
        spread = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
        changes = F.when(spread > 0, (m["runs"] - mean) / F.sqrt(spread)).otherwise(F.lit(-99.0))
        over = n * n * m["cross"] - n * m["sum"] * (2.0 * m["sum"] - m["ends"]) + (n - 1.0) * m["sum"] * m["sum"]
        under = n * n * m["square"] - n * m["sum"] * m["sum"]
        serial = F.when(under > 0, (over / under + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        six = lambda c: F.round(c, 6)
        return _with(m, [*keep, "n"], chi=six(chi), changes=six(changes), serial=six(serial), text=six(text))

    def placed(m: Column) -> Column:
        random = (m["chi"] <= LIMIT_ONE) & (F.abs(m["changes"]) <= LIMIT_TWO) & (F.abs(m["serial"]) <= LIMIT_TWO) & (m["text"] < 0)
        step = F.when(random, F.greatest(F.lit(0), F.floor(m["text"] * STEPS).cast("int") + LAST)).otherwise(F.lit(LAST))
        kind = sum((F.when(m["n"] >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))
        return _with(m, [*keep, "n", "chi", "changes", "serial", "text"], **{"class": kind, "step": step})

    return F.transform(F.transform(F.transform(F.transform(a, counted), summed), judged), placed)


def thresholds(steps: DataFrame) -> dict[int, int]:
    """The last step that passes in each class of lengths, by Benjamini and Hochberg, for (class, step) of all runs.

    What comes to the driver is a count for each class and step: at most len(LENGTHS) * len(P_VALUES) rows.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in steps.groupBy("class", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["class"], {})[r["step"]] = r["n"]
    out = {}
    for kind, mine in counts.items():
        total, so_far = sum(mine.values()), 0
        for step in sorted(mine):
            so_far += mine[step]
            if P_VALUES[step] * total <= FALSE * so_far:
                out[kind] = step
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (start, kind, end) and random (start, end, encoding, its statistics and scores) for every row."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    runs = F.when(F.col("t").rlike(RUN), _runs(F.col("t")))
    found = pin(rows.select("doc_id", _base(F.col("t")).alias("base"), scored(runs).alias("runs")))
    passed = thresholds(found.where("runs IS NOT NULL").select(F.explode("runs").alias("r")).select("r.class", "r.step"))
    last = _each([passed.get(k, -1) for k in range(len(LENGTHS))])
    good = F.filter("runs", lambda r: r["step"] <= F.get(last, r["class"]))
    return found.select("doc_id", "base", F.when(F.size(good) > 0, good).alias("random"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(_each(list(KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"))
    more = F.transform("random", lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("kind"), r["end"].alias("end")))
    every = F.when(more.isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", more)))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"), F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random")
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    spans = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, {least} AS least, string_split_regex(t, {quoted(p)}) AS between, regexp_extract_all(t, {quoted(p)}, 0) AS found, regexp_extract_all(t, {quoted(p)}, {g}) AS told FROM d"
        for k, (_, p, g, least) in enumerate((*BASE, ("random", RUN, 0, LEAST)))
    )
    encodings = ", ".join(f"({k}, {quoted(a)}, {quoted('0' * (len(a) // 2) + '1' * (len(a) - len(a) // 2))}, {len(a)}::DOUBLE, {kappa}::DOUBLE)" for k, (_, a, _, kappa) in enumerate(ENCODINGS))
    has = lambda what: f"regexp_matches(s, '{what}')"
    told = " ".join(f"WHEN {' AND '.join(map(has, ('[A-Z]', '[a-z]', '[0-9]') if n.startswith('base64') else ('[A-Za-z]', '[0-9]')))} AND {has(p)} THEN {k}" for k, (n, _, p, _) in enumerate(ENCODINGS))
    folds = ", ".join(str(k) for k, e in enumerate(ENCODINGS) if e[0] in FOLDED)
    written = lambda where: f"coalesce(string_agg(concat(kinds[kind + 1], ':', a, ':', b), ',' ORDER BY a, kind, b) FILTER ({where}), '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({spans}),
-- Each match with the text before it; places are their running sums.
e AS (SELECT rid, kind, least, i, between[i] AS gap, found[i] AS found, told[i] AS told FROM m, unnest(range(1, len(found) + 1)) AS u(i)),
p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY rid, kind ORDER BY i) AS b FROM e),
q AS (SELECT rid, kind, (b - length(found))::BIGINT AS a, b::BIGINT AS b, told FROM p WHERE length(told) >= least),
r AS (SELECT rid, a, b, CASE WHEN code IN ({folds}) THEN lower(s) ELSE s END AS s, code FROM (
        SELECT *, CASE {told} END AS code FROM (SELECT rid, a, b, rtrim(told, '=') AS s FROM q WHERE kind = {len(BASE)}) WHERE length(s) >= {LEAST})
      WHERE code IS NOT NULL),
c(code, alphabet, half, k, kappa) AS (VALUES {encodings}),
v AS (SELECT rid, a, b, s, length(s)::DOUBLE AS n, k, kappa, translate(s, alphabet, half) AS bits,
             list_transform(string_split(s, ''), lambda x: (instr(alphabet, x) - 1)::DOUBLE) AS v,
             list_sum(list_transform(string_split(alphabet, ''), lambda x: pow((length(s) - length(replace(s, x, '')))::DOUBLE, 2))) AS squares
      FROM r JOIN c USING (code)),
w AS (SELECT *, k * squares / n - n AS chi2, (length(bits) - length(replace(bits, '1', '')))::DOUBLE AS ones, (length(bits) - length(replace(bits, '0', '')))::DOUBLE AS zeros,
             (len(regexp_extract_all(bits, '01')) + len(regexp_extract_all(bits, '10')) + 1)::DOUBLE AS runs,
             list_sum(v) AS sum, list_sum(list_transform(v, lambda x: x * x)) AS square, v[1] + v[-1] AS ends,
             list_sum(list_transform(list_zip(v[:-2], v[2:]), lambda x: x[1] * x[2])) AS cross_ FROM v),
x AS (SELECT *, (k - 1) AS free, n * (k * kappa - 1) AS extra, 2 * ones * zeros / n + 1 AS mean,
             n * n * cross_ - n * sum * (2 * sum - ends) + (n - 1) * sum * sum AS over_, n * n * square - n * sum * sum AS under FROM w),
y AS (SELECT *, round((pow(chi2 / free, 1::DOUBLE / 3) - (1 - 2 / (9 * free))) / sqrt(2 / (9 * free)), 6) AS chi,
             round((chi2 - (free + extra)) / sqrt(2 * (free + 2 * extra)), 6) AS text,
             round(CASE WHEN (mean - 1) * (mean - 2) / (n - 1) > 0 THEN (runs - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) ELSE -99 END, 6) AS changes,
             round(CASE WHEN under > 0 THEN (over_ / under + 1 / n) * sqrt(n) ELSE 99 END, 6) AS serial FROM x),
z AS (SELECT *, {" + ".join(f"(n >= {x})::INT" for x in LENGTHS[1:])} AS class,
             CASE WHEN chi <= {LIMIT_ONE} AND abs(changes) <= {LIMIT_TWO} AND abs(serial) <= {LIMIT_TWO} AND text < 0 THEN greatest(0, floor(text * {STEPS})::INT + {LAST}) ELSE {LAST} END AS step FROM y),
-- Benjamini and Hochberg over all runs of a class of lengths.
h AS (SELECT class, step, count(*) AS n FROM z GROUP BY ALL),
l AS (SELECT class, max(step) FILTER ({P_VALUES}[step + 1] * total <= {FALSE} * so_far) AS last
      FROM (SELECT *, sum(n) OVER (PARTITION BY class) AS total, sum(n) OVER (PARTITION BY class ORDER BY step) AS so_far FROM h) GROUP BY class),
every AS (SELECT rid, kind, a, b FROM q WHERE kind < {len(BASE)} UNION ALL SELECT rid, {len(BASE)}, a, b FROM z JOIN l USING (class) WHERE step <= last),
o AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{b[0]}" for k, b in enumerate(BASE))}, count(*) FILTER (kind = {len(BASE)}) AS n_random,
             {written(f"kind < {len(BASE)}")} AS base, {written("true")} AS spans FROM (SELECT *, {list(KINDS)} AS kinds FROM every) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


OP13_SQL = _sql()
