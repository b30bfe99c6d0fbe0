"""Lineage, Merkle nodes, differences of corpora, numbered lines and streams against plain Python."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docgauge.operators import ranks
from docgauge.operators.lineage import closure
from docgauge.plans import merkle, merkle_levels as ml
from docgauge.sources.lines import numbered
from docgauge.streaming import copies as st


# --- lineage ---------------------------------------------------------------------


def walked(parents, values):
    out = {}
    for i in parents:
        seen, at, total = [], i, 0.0
        while at not in seen:
            seen.append(at)
            total += values[at] or 0
            up = parents[at]
            if up is None or up not in parents:
                state = ("root" if up is None else "orphan") if at == i else "derived"
                out[i] = (at, len(seen) - 1, total, state)
                break
            at = up
        else:
            out[i] = (None, None, None, "cycle" if at == i else "into cycle")
    return out


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_lineage(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(broadcast + 1)
    n = 120
    parents = {f"h{k}": rnd.choice([None, f"h{rnd.randrange(n)}", f"h{max(0, k - 1)}", f"h{max(0, k - 1)}", "h0", "gone"]) for k in range(n)}
    parents |= {f"c{k}": f"c{k - 1}" if k else None for k in range(70)} | {"x": "y", "y": "z", "z": "x", "into": "x", "further": "into", "self": "self"}
    values = {k: rnd.choice([None, rnd.randrange(100)]) for k in parents}
    rows = [(k, p, values[k]) for k, p in parents.items()] + [("c5", None, 0), ("x", "a", 1)]  # repeated ids: the largest parent counts
    got = closure(spark.createDataFrame(rows, "id string, parent string, value long").repartition(3)).collect()
    assert {r["id"]: tuple(r)[1:] for r in got} == walked(parents, values) and len(got) == len(parents)


def test_lineage_of_nothing_and_of_documents(spark):
    from docgauge.operators.lineage import of_documents

    assert closure(spark.createDataFrame([], "id long, parent long, value long")).count() == 0
    docs = spark.createDataFrame([("a", None, 3), ("b", "a", 4), ("b", "a", 4)], "doc_hash string, parent_hash string, size_bytes long")
    assert {tuple(r) for r in of_documents(docs).collect()} == {("a", "a", 0, 3.0, "root"), ("b", "a", 1, 7.0, "derived")}


# --- Merkle ------------------------------------------------------------------------


def hashes(n, salt=""):
    return [hashlib.sha256(f"{salt}{k}".encode()).hexdigest() for k in range(n)]


@pytest.mark.parametrize(("n", "band"), [(1, 3), (13, 1), (64, 3), (65, 3), (100, 10)])
def test_levels_and_multiproofs(spark, n, band):
    leaves = hashes(n)
    tree = ml.settled(ml.levels(spark.createDataFrame([(x,) for x in leaves + leaves[:3]], "doc_hash string").repartition(3), band=band))
    rows = tree.collect()
    nodes = sorted(leaves)
    for level in range(max(r["level"] for r in rows) + 1):
        mine = sorted((r["pos"], r["hash"]) for r in rows if r["level"] == level)
        assert mine == list(enumerate(nodes)) and all(r["n"] == n for r in rows)
        nodes = merkle._level(nodes) if len(nodes) > 1 else nodes
    root = merkle.root_of(leaves)
    for some in (leaves[:1], leaves[::4]):
        wanted = spark.createDataFrame([(x,) for x in some], "hash string")
        proof = ml.settled(ml.multiproof(tree, wanted))
        own = tree.where("level = 0").join(wanted, "hash", "left_semi")
        assert [r["root"] for r in ml.fold(proof, own, n).collect()] == [root]
        given = {(r["level"], r["pos"]) for r in proof.collect()}
        single = {(level, (sorted(leaves).index(x) >> level) ^ 1) for x in some for level in range(n.bit_length())}
        assert given <= single
        if given and len(some) > 1:
            level, pos = sorted(given)[0]
            less = proof.where(f"NOT (level = {level} AND pos = {pos})")
            assert [r["root"] for r in ml.fold(less, own, n).collect()] != [root]
            forged = proof.withColumn("hash", F.when((F.col("level") == level) & (F.col("pos") == pos), "1" * 64).otherwise(F.col("hash")))
            assert [r["root"] for r in ml.fold(forged, own, n).collect()] != [root]


def test_levels_of_no_leaves(spark):
    assert ml.levels(spark.createDataFrame([], "doc_hash string")).count() == 0


@pytest.mark.parametrize("leaf_range", [4, 64])
def test_reconciliation(spark, monkeypatch, leaf_range):
    monkeypatch.setattr(ml, "RANGE", leaf_range)
    a = hashes(700)
    cases = {"equal": a, "subset": a[5:690], "superset": a + hashes(3, "new"), "overlap": a[3:] + hashes(4, "new"), "disjoint": hashes(20, "other"), "one": a[:350] + hashes(1, "x") + a[351:]}
    frame = lambda x: spark.createDataFrame([(h,) for h in x + x[:2]], "doc_hash string")
    for name, b in cases.items():
        sides, told = ml.reconcile(frame(a), frame(b))
        got = {(r["hash"], r["side"]) for r in sides.collect()}
        assert got == {(h, "a") for h in set(a) - set(b)} | {(h, "b") for h in set(b) - set(a)}, name
        assert ml.relation(len(a), len(b), len(set(a) - set(b)), len(set(b) - set(a))) == {"one": "overlap"}.get(name, name)
        if name == "equal":
            assert told == {"ranges_1": 16, "leaves": 0}
        if name == "one" and leaf_range == 4:  # one leaf is another: at most two ranges are followed to the leaves
            assert told["ranges_2"] <= 32 and told["leaves"] <= 40
    kept = (ml.digests(frame(a)), ml.digests(frame(a[1:])))
    assert ml.reconcile(frame(a), frame(a[1:]), kept=kept)[0].collect()[0]["hash"] == a[0]
    assert ml.reconcile(frame([]), frame([]))[0].count() == 0


# --- lines ---------------------------------------------------------------------------


def test_numbered_lines_over_many_splits(spark, tmp_path):
    rnd = random.Random(2)
    texts = {f"{k}.jsonl": [rnd.choice(["", "x", "é" * 40, '{"a": 1}', "long " * 200]) for _ in range(n)] for k, n in enumerate((1, 400, 0, 900))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(x + rnd.choice(["\n", "\r\n"]) for x in rows) if name != "1.jsonl" else "\n".join(rows) + "\nlast")
    texts["1.jsonl"].append("last")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = numbered(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20
        got = rows.collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    found = {}
    for r in got:
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["no"], r["value"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items() if v}


# --- streams ---------------------------------------------------------------------------


def test_stream_of_copies_with_sessions_and_late_rows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    schema = "doc_id long, doc_hash string, at timestamp"
    batches = [
        [(5, "a", 0), (3, "a", 0), (9, "b", 1)],
        [(1, "a", 2), (2, "c", 40)],  # the watermark moves to 40 - 5
        [(7, "b", 3), (8, "c", 41)],  # b at 3 is too late
        [(10, "c", 200)],  # a and b ran out long ago; so has c, but it comes again before its timer is looked at
        [(11, "a", 210), (12, "d", 400)],  # a begins anew
    ]
    def run(upto):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = st.copies(rows, "at", late="5 minutes", idle_ms=30 * 60_000).writeStream.format("parquet").outputMode("append")
        q = q.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return st.late_rows(q)

    late = 0
    for k, rows in enumerate(batches):  # a run for each batch: state, watermark and timers outlive the query
        part = spark.createDataFrame([(i, h, start + timedelta(minutes=m)) for i, h, m in rows], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        late += run(k)
    rows = st.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    minutes = lambda ms: round((ms - min(r["session"] for r in rows)) / 60_000)
    got = sorted((r["doc_hash"], minutes(r["session"]), r["first_id"], minutes(r["last_at"]), r["copies"], r["closed"]) for r in rows)
    assert late == 1
    assert [x[:5] for x in got if x[0] in "ab"] == [("a", 0, 3, 2, 3), ("a", 210, 11, 210, 1), ("b", 1, 9, 1, 1)]
    assert [x[5] for x in got if x[0] in "ab"][::2] == [True, True]
    assert sum(x[4] for x in got) + late == sum(map(len, batches))


def test_stream_of_copies_keeps_few_groups(spark, tmp_path):
    """A group for each hash once cost some milliseconds each; hashes that share a group are still told and closed one by one."""
    start, schema = datetime(2026, 1, 1), "doc_id long, doc_hash string, at timestamp"
    rnd = random.Random(5)
    first = [(k, f"h{rnd.randrange(200)}", start + timedelta(minutes=rnd.randrange(60))) for k in range(600)] + [(None, "no id", start)]
    later = [(1000 + k, f"h{k}", start + timedelta(minutes=600)) for k in range(0, 400, 2)]  # the others run out
    last = [(2000, "end", start + timedelta(minutes=601))]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = st.copies(docs, "at", late="1 minute", idle_ms=60_000, buckets=16).writeStream.format("parquet").outputMode("append")
        q = q.option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators)

    assert max(map(run, (first, later, last))) <= 16
    want, ms = {}, lambda at: round((at - start).total_seconds() * 1000)
    for rows in (first, later, last):
        # The watermark is at 58 minutes after the first run: what is a minute older has run out before the second run's documents come.
        open_at = {h for (h, again), v in want.items() if not again and max(v)[0] >= 57 * 60_000} if rows is not first else set()
        for i, h, at in rows:
            want.setdefault((h, at.hour >= 9 and h not in open_at), []).append((ms(at), i))
    got = st.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    base = min(r["session"] for r in got)  # "no id" has its only document at the start
    told = {(r["doc_hash"], r["session"] - base >= 540 * 60_000): r for r in got}
    assert {k: (r["first_at"] - base, r["first_id"], r["last_at"] - base, r["copies"]) for k, r in told.items()} == {k: (*min(v), max(x[0] for x in v), len(v)) for k, v in want.items()}
    assert all(r["closed"] for k, r in told.items() if not k[1] and r["last_at"] - base < 57 * 60_000) and not told["end", True]["closed"]


def test_lineage_takes_few_rounds(spark, monkeypatch):
    """Each round is a join and a checkpoint on the driver's account: rings with short ways into them once took as many as the number of their documents has binary digits."""
    from docgauge.operators import lineage

    calls, settled = [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: calls.append(1) or settled(df))
    rows = [(2 * k + i, 2 * k + 1 - i, 1) for k in range(3000) for i in range(2)] + [(10_000 + k, k, 1) for k in range(3000)]
    got = closure(spark.createDataFrame(rows, "id long, parent long, value long")).groupBy("state").count().collect()
    assert {tuple(r) for r in got} == {("cycle", 6000), ("into cycle", 3000)}
    assert len(calls) <= 6
