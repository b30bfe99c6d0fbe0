import pytest
from pyspark.sql import functions as F

from docgauge.operators.scopes import scoped
from docgauge.plans import gate
from docgauge.plans.measure import measure, select_families
from docgauge.sources.tables import read_documents

SF = "/root/testdata/sf0.001"
SETTINGS = {"markings": {"ceiling": "CUI"}}


@pytest.fixture(scope="module")
def docs(spark):
    rows = read_documents(spark, SF, defects=True).withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("a=b,%"), F.col("doc_id") % 3)))
    return rows.withColumn("month", F.substring("collected_at", 1, 7)).persist()


def flat(m):
    out = {}
    for r in m.results:
        if r.get("distribution"):
            out |= {(r["metric_id"], k): v for k, v in r["distribution"].items()}
        elif not isinstance(r["value"], dict) and not r["metric_id"].startswith(("dup.near", "cnt.", "prov.date_range")):
            out[r["metric_id"], "value"] = r["value"]
    return out


def test_scopes_equal_runs_over_their_documents(spark, docs):
    families = select_families(config=SETTINGS)
    got = scoped(docs, families, [[], ["source"], ["source", "month"]]).collect()
    by_scope = {}
    for r in got:
        by_scope.setdefault(r["scope"], {})[r["metric_id"], r["key"]] = r["value"]
    assert {"all", "source", "source=a%3Db%2C%250"} <= set(by_scope)
    for scope, where in (("all", "true"), ("source", "source IS NULL"), ("source=a%3Db%2C%251", "source = 'a=b,%1'"), ("month=2026-03,source=a%3Db%2C%252", "source = 'a=b,%2' AND month = '2026-03'"), ("month,source", "source IS NULL AND month IS NULL")):
        m = measure(docs.where(where), config=SETTINGS)
        m.docs.unpersist()
        want = {k: v for k, v in flat(m).items() if v is not None or k[1] == "value"}
        mine = by_scope.get(scope, {})
        if not next(r["value"] for r in m.results if r["metric_id"] == "vol.total_docs"):
            assert scope not in by_scope
            continue
        assert set(mine) == set(want), (scope, set(mine) ^ set(want))
        off = {k: (mine[k], v) for k, v in want.items() if (mine[k] is None) != (v is None) or (v is not None and abs(mine[k] - v) > 2e-6 * max(1, abs(v)))}
        assert not off, scope


def test_rules_by_scope(spark, docs):
    policy = gate.load_policy()
    table = gate.scoped_table(scoped(docs, select_families(config=SETTINGS), [[], ["source"]]))
    each = gate.judge(policy, table, every_scope=True).collect()
    assert len(each) == len({(r["rule_id"], r["scope"]) for r in each}) and {r["scope"] for r in each} >= {"all", "source"}
    m = measure(docs, config=SETTINGS)
    m.docs.unpersist()
    whole = {r["rule_id"]: r for r in gate.judge(policy, gate.result_table(spark, m.results)).collect()}
    for r in each:
        if r["scope"] == "all":
            assert (r["status"], r["severity"], r["reason"].split()[0].rstrip("0.")) == (whole[r["rule_id"]]["status"], whole[r["rule_id"]]["severity"], whole[r["rule_id"]]["reason"].split()[0].rstrip("0."))
    near = [r["rule_id"] for r in whole.values() if r["metric_id"].startswith("dup.near")]
    assert near and not [r for r in each if r["rule_id"] in near]


def test_no_documents(spark, docs):
    assert scoped(docs.where("false"), select_families(config=SETTINGS), [[], ["source"]]).count() == 0


def test_near_duplicates_of_scopes_equal_runs_over_their_documents(spark, docs):
    """Every fifth text of one source has a near copy in the same, every seventh in another source."""
    more = docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).where("length(text) > 300").select("doc_id", "source", "doc_hash", "text", "size_bytes")
    copy = lambda every, source: more.where(f"doc_id % {every} = 0").withColumns({"source": source, "text": F.concat("text", F.lit(" and an end of its own"))}).withColumn("doc_hash", F.sha2(F.col("text").cast("binary"), 256))
    rows = more.union(copy(5, F.col("source"))).union(copy(7, F.lit("s0"))).persist()
    families = select_families(["duplication"])
    got = {(r["scope"], r["metric_id"]): r["value"] for r in scoped(rows, families, [[], ["source"]], compare=True).collect()}
    near = {}
    for scope, where in (("all", "true"), *((f"source=s{k}", f"source = 's{k}'") for k in range(3))):
        m = measure(rows.where(where), ["duplication"])
        m.docs.unpersist()
        for r in m.results:
            assert got[scope, r["metric_id"]] == r["value"], (scope, r["metric_id"])
        near[scope] = got[scope, "dup.near_count"]
    assert near["all"] > sum(v for k, v in near.items() if k != "all") > 0


def test_queries_tell_near_duplicates_of_scopes(spark):
    from docgauge.plans.corpus_queries import _scoped

    rules = [r.rule_id for r in gate.load_policy().rules if r.metric_id.startswith("dup.near")]
    seen = _scoped(spark, SF, [[], ["lang"]]).where("metric_id LIKE 'dup.near%'").persist()
    assert {r["scope"] for r in seen.collect()} >= {"all", "lang=en"} and seen.where("value IS NULL").count() == 0
    judged = gate.judge(gate.load_policy(), gate.scoped_table(seen), every_scope=True).where(F.col("rule_id").isin(rules))
    assert rules and {r["status"] for r in judged.collect()} <= {"pass", "flag", "fail"}
