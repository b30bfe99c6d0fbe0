import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docgauge.llm import merkle_manifest as mm
from docgauge.operators.ranks import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    i, text, lang, source, n = r[:5]
    return h(*map(field, (i, source, lang, None if n is None else n + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def walk(tree, at, own):
    proof = ""
    for row in tree[:-1]:
        k = at - at % 2
        pair = row[k : k + 2]
        proof += "".join(x for j, x in enumerate(pair) if k + j != at)
        pair[at - k] = own
        own, at = h(*pair), at // 2
    return proof, own


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, mid = walk(trees[g], at, leaf(r, changed))
            high, root = walk(top, k, mid)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(low + high), root, root == top[-1][0]))
    return out


def rows_of(n, seed):
    rnd = random.Random(seed)
    langs = [None, "", "-", "de", "en", "en", "en", "é", "zh"]
    rows = [(rnd.choice([None, -3, k, k, k]), rnd.choice([None, "", "x", "é" * 5, "long " * 3000, f"t{k}"]), rnd.choice(langs), rnd.choice([None, "s"]), rnd.choice([None, 1, 2**63 - 1, k]), 1, "g") for k in range(n)]
    return rows + rows[: n // 5]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize(("n", "band"), [(0, 3), (1, 3), (2, 1), (150, 1), (150, 3), (150, 10)])
def test_manifest_against_brute_force(spark, monkeypatch, n, band):
    rows = rows_of(n, n + band)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(mm, "read", lambda *_: docs)
    monkeypatch.setattr(mm.manifest, "__defaults__", (*mm.manifest.__defaults__[:-1], band))
    got = mm.op12_merkle_manifest(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_proofs_hold_and_a_lost_broadcast_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr("docgauge.operators.ranks.BROADCAST_ROWS", 0)
    rows = [r[:5] for r in rows_of(60, 5)]
    got = mm.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), band=2)
    out = got.select("doc_id", "group", "leaf", "subroot", "root", mm.siblings(F.col("path")).alias("s"), mm.folded(F.col("path"), F.col("leaf")).alias("f")).collect()
    assert len(out) == len(rows) and all(r["f"] == r["root"] for r in out)
    assert {r["group"] for r in out} == {r[2] for r in rows}
    assert all(len(x) in (0, 64) for r in out for x in r["s"])


def test_ranks(spark):
    rows = [("a" if k % 3 else "b", (k * 7) % 50, k) for k in range(200)]
    got = ranked(spark.createDataFrame(rows, "g string, k long, id long").repartition(5), "g", ["k"]).collect()
    for g in "ab":
        mine = sorted(((r["pos"], r["k"], r["n"]) for r in got if r["g"] == g))
        assert [p for p, _, _ in mine] == list(range(len(mine))) and [k for _, k, _ in mine] == sorted(k for _, k, _ in mine) and {n for _, _, n in mine} == {len(mine)}
