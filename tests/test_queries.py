import importlib
import sys

import duckdb
import pytest

from docgauge.plans.corpus_queries import ORACLES as CORPUS_ORACLES
from docgauge.plans.corpus_queries import QUERIES as CORPUS_QUERIES
from docgauge.plans.file_queries import FILE_ORACLES, FILE_QUERIES
from docgauge.plans.tree_queries import ORACLES as TREE_ORACLES
from docgauge.plans.tree_queries import QUERIES as TREE_QUERIES
from docgauge.plans.queries import ORACLES as TABLE_ORACLES
from docgauge.plans.queries import QUERIES as TABLE_QUERIES

QUERIES, ORACLES = TABLE_QUERIES | CORPUS_QUERIES | TREE_QUERIES | FILE_QUERIES, TABLE_ORACLES | CORPUS_ORACLES | TREE_ORACLES | FILE_ORACLES

SF = "/root/testdata/sf0.001"


def test_registry_without_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "docgauge.llm", None)
    monkeypatch.setitem(sys.modules, "docgauge.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    mine, theirs = (sorted(map(tuple, r), key=key) for r in (got.select(*cols).collect(), cur.fetchall()))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):  # ties at the sixth place may be rounded either way
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1.5e-6) for x, y in zip(a, b)), (a, b)


def test_plans_of_near_duplicates_do_not_show_each_other(spark):
    """Spark keeps each plan's description in the driver's heap; gate_findings once left 45 million characters there."""
    from docgauge.operators.near import near_hashes
    from docgauge.sources.tables import read_documents

    near = near_hashes(read_documents(spark, SF, defects=True).select("doc_hash", "text"))
    assert near.count() > 0
    assert len(near._jdf.queryExecution().toString()) < 10_000


@pytest.mark.parametrize("name", ["derived_corpus", "investigation", "bundle_checks"])
def test_records_do_not_pass_through_the_driver(spark, monkeypatch, name):
    from docgauge.plans import bundle

    monkeypatch.setattr(bundle, "write_records", lambda *_: pytest.fail("records were sent to the driver"))
    assert QUERIES[name](spark, SF).count() > 0


def test_first_files_are_found_without_the_driver_listing_them(spark, tmp_path, monkeypatch):
    from docgauge.plans.file_queries import first_files

    for name in ("de/10.md", "de/9.txt", "de-x/1.md", ".docgauge/0.txt", "de/9.json", "b.txt", "a/.docgauge/0.md", "a/z/é.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    want = sorted(p for p in tmp_path.rglob("*.*") if p.suffix in (".md", ".txt") and ".docgauge" not in p.parts)
    assert [first_files(spark, tmp_path, n) for n in (2, 9)] == [want[:2], want] and len(want) == 5
    monkeypatch.setattr("pathlib.Path.rglob", lambda *_: pytest.fail("the driver lists every file"))
    assert QUERIES["bundle_checks"](spark, SF).count() == 17
