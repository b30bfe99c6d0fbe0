import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from docgauge import cli
from docgauge.operators.catalog import catalog, metric
from docgauge.operators.quantiles import Spread, bucket, distributions
from docgauge.plans import bundle, envelope, file_queries, gate, inquiry, ledger, manifest, merkle, signing
from docgauge.plans.measure import measure
from docgauge.sources import directory, lines, scratch
from docgauge.sources.directory import BUNDLE_DIR, ProvenanceError, read_directory, validate

PROSE = "The committee met on Tuesday and agreed on the plan for the coming quarter, which covers roads, schools and the water works. "
FILES = {
    "a/memo-1.txt": PROSE * 3, "a/memo-2.txt": PROSE * 3, "b/report.md": (PROSE + "Costs rose by four percent while income fell, so the board asked for new figures by June. ") * 2,
    "b/report-2.md": (PROSE + "Costs rose by four percent while income fell, so the board asked for new figures by July. ") * 2,
    "empty.txt": "", "_under.txt": PROSE, ".hidden": "x", "control.txt": PROSE + "\x07 end of it.", "short.log": "word", "cut.txt": PROSE + "and then it", "sp ace+%41é.txt": "SECRET//NOFORN\n(U) " + PROSE,
}


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    return root


@pytest.fixture
def built(spark, corpus):
    key = signing.Signer(bytes(range(32)), "dev")
    m = bundle.build(corpus, validate(read_directory(spark, corpus)), bundle.Origin("c", "1"), signers=[key], config={"markings": {"ceiling": "CUI"}})
    return corpus, key, m


def value(m, metric_id):
    return next(r for r in m["results"] if r["metric_id"] == metric_id)["value"]


def test_directory_keeps_every_file(spark, corpus):
    (corpus / BUNDLE_DIR).mkdir()
    (corpus / BUNDLE_DIR / "records.jsonl").write_text("x")
    rows = {r["source_locator"]: r for r in read_directory(spark, corpus).collect()}
    assert set(rows) == set(FILES)
    for name, text in FILES.items():
        r = rows[name]
        assert (r["doc_hash"], r["text"], r["size_bytes"], r["source_system"]) == (hashlib.sha256(text.encode()).hexdigest(), text, len(text.encode()), "fs")
    assert rows["b/report.md"]["media_type"] == "text/markdown" and rows["short.log"]["media_type"] is None
    (corpus / "bad.txt").write_bytes(b"a\xffb")
    assert {r["source_locator"]: r["text"] for r in read_directory(spark, corpus).collect()}["bad.txt"] == "a�b"


def test_sidecar(spark, corpus, tmp_path):
    side = tmp_path / "p.jsonl"
    good = [{"locator": "a/memo-1.txt", "source_system": "mail", "source_id": "7", "collected_at": "2026-01-02", "custody": [{"actor": "x", "at": "y"}], "reliability": {"source": "A", "information": "1"}},
            {"locator": "b/report.md", "source_system": "mail", "source_id": "7", "parent_hash": "0" * 64, "reliability": {"source": "B"}}]
    side.write_text("\n\n".join(map(json.dumps, good)))
    m = measure(validate(read_directory(spark, corpus, side)), ["provenance"])
    got = {r["metric_id"]: r["value"] for r in m.results}
    assert got["prov.duplicate_id_count"] == 2 and got["prov.duplicate_id_rate"] == 1.0 and got["prov.undated_rate"] == round(10 / 11, 6)
    assert got["prov.reliability_histogram"] == {"A1": 1, "B?": 1, "unrated": 9} and got["prov.date_range"] == {"min": "2026-01-02", "max": "2026-01-02", "dated": 1}
    assert got["prov.source_histogram"]["mail"]["docs"] == 2 and got["prov.custody_complete_rate"] == got["prov.derived_share"] == round(1 / 11, 6)
    for bad, what in (('{"locator": "a/memo-1.txt", "owner": 1}', "unknown field"), ("{nope", "not JSON"), ("[1]", "each entry"), ('{"source_id": "1"}', "each entry"), ('{"locator": "gone.txt"}', "not in the corpus"), (json.dumps(good[0]) + "\n" + json.dumps(good[0]), "appears twice")):
        side.write_text(bad)
        with pytest.raises(ProvenanceError, match=what):
            read_directory(spark, corpus, side)
    side.write_text('{"locator": "a/memo-1.txt", "reliability": {"source": "Z"}}')
    with pytest.raises(ProvenanceError, match="reliability/source"):
        validate(read_directory(spark, corpus, side))


def test_directory_of_many_files_is_listed_and_read_in_few_tasks(spark, tmp_path):
    """Spark counts a file as 4 MB at least and lists on the driver: 2,000 small files took 63 tasks, and their contents were shuffled to meet no sidecar."""
    root = tmp_path / "many"
    for k in range(2000):
        (root / f"{k % 3}" / f"{k % 7}").mkdir(parents=True, exist_ok=True)
        (root / f"{k % 3}" / f"{k % 7}" / f"{k}.txt").write_text(str(k))
    (root / "1" / "part._COPYING_").write_text("kept")
    (tmp_path / "beside").mkdir()
    (tmp_path / "beside" / "x.md").write_text("behind a link")
    (root / "link").symlink_to(tmp_path / "beside")
    (root / "2" / "up").symlink_to(root)
    docs = read_directory(spark, root)
    (root / "later.txt").write_text("not in the list")
    assert docs.rdd.getNumPartitions() <= 8
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BinaryFile" not in plan
    got = {r["source_locator"]: r["text"] for r in docs.collect()}
    assert got == {f"{k % 3}/{k % 7}/{k}.txt": str(k) for k in range(2000)} | {"1/part._COPYING_": "kept", "link/x.md": "behind a link"}
    assert read_directory(spark, tmp_path / "none").count() == 0


def test_sidecar_in_parts(spark, corpus, tmp_path):
    """A sidecar may be a folder of parts, as executors write it; an unusable line is named with its part."""
    side = tmp_path / "side"
    side.mkdir()
    (side / "part-0").write_text('{"locator": "a/memo-1.txt", "source_id": "7"}\n\n')
    (side / "part-1").write_text('{"locator": "b/report.md", "source_id": "8"}\n')
    got = {r["source_locator"]: r["source_id"] for r in validate(read_directory(spark, corpus, side)).collect()}
    assert got == dict.fromkeys(FILES) | {"a/memo-1.txt": "7", "b/report.md": "8"}
    for bad, what in (('\n{"locator": "empty.txt", "owner": 1}\n', "part-2:2: unknown field"), ('{"locator": "a/memo-1.txt"}\n', "part-2:1: locator 'a/memo-1.txt' appears twice")):
        (side / "part-2").write_text(bad)
        with pytest.raises(ProvenanceError, match=what):
            read_directory(spark, corpus, side)


def test_sidecar_is_not_written_by_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from docgauge.plans.file_queries import directory_of

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("the sidecar was sent to the driver"))
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *_: pytest.fail("the sidecar was sent to the driver"))
    _, side = directory_of(spark, "/root/testdata/sf0.001", sidecar=True)
    assert spark.read.text(str(side)).count() == spark.read.parquet("/root/testdata/sf0.001/labels.parquet").count()


def test_tasks_of_a_large_directory(spark, tmp_path, monkeypatch):
    """Tasks of 1,024 files were 98 for 100,000, each with a block for every partition of a shuffle, so blocks grew with the square of the input."""
    monkeypatch.setattr(directory, "listed", lambda *_: (spark.range(100_000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS path", "CAST(id AS STRING) AS locator"), 100_000))
    assert read_directory(spark, tmp_path).rdd.getNumPartitions() <= 12


def test_record_order_keeps_no_lines(spark, tmp_path, monkeypatch):
    """Numbered lines were kept as a checkpoint, whole records and all, to add up the parts; now files go on where the one before ended."""
    kept = []
    monkeypatch.setattr(lines, "settled", lambda df: kept.append(df.columns) or scratch.settled(df))
    monkeypatch.setattr(file_queries, "settled", lambda df: kept.append(df.columns) or scratch.settled(df), raising=False)
    sf = "/root/testdata/sf0.001"
    rows = file_queries.record_order(spark, sf)
    assert kept == [["file", "split", "shift"]]
    assert [r["place"] for r in rows.orderBy("doc_hash", F.split("source_locator", "/")).collect()] == list(range(1, spark.read.parquet(f"{sf}/documents.parquet").count() + 1))
    for k, text in enumerate(("a\n\nb\n", "", "c", "d\ne\n")):
        (tmp_path / f"part-{k}").write_text(text)
    told = lambda **x: [(r["no"], r["value"]) for r in lines.numbered(spark, str(tmp_path), **x).orderBy("file", "no").collect()]
    assert told(through=True) == [(1, "a"), (2, ""), (3, "b"), (4, "c"), (5, "d"), (6, "e")]
    assert told() == [(1, "a"), (2, ""), (3, "b"), (1, "c"), (1, "d"), (2, "e")]


def test_build_and_findings(built):
    _, _, m = built
    assert value(m, "dup.exact_count") == 2 and value(m, "dup.near_count") >= 2 and value(m, "vol.total_docs") == 11
    assert value(m, "int.empty_count") == 1 and value(m, "int.control_char_rate") == round(1 / 11, 6) and value(m, "mark.ceiling_breach") == 1
    assert [r["metric_id"] for r in m["results"]] == list(gate_order())
    by_id = {f["finding_id"]: f for f in m["findings"]}
    assert by_id["INT-001"]["status"] == "fail" and by_id["INT-001"]["evidence"] == [{"doc_hash": hashlib.sha256(b"").hexdigest()}]
    assert by_id["PROV-002"]["status"] == "inconclusive" and by_id["DUP-001"]["status"] == "fail" and by_id["MARK-002"]["severity"] == "critical"
    assert m["corpus"]["merkle_root"] == merkle.root_of(hashlib.sha256(t.encode()).hexdigest() for t in FILES.values())
    assert m["corpus"]["total_bytes"] == sum(len(t.encode()) for t in FILES.values())


def gate_order():
    from docgauge.model import METRICS

    return METRICS


def test_records_are_sorted_and_bound(built):
    root, _, m = built
    raw = (root / BUNDLE_DIR / "records.jsonl").read_bytes()
    rows = [json.loads(x) for x in raw.decode().splitlines()]
    assert hashlib.sha256(raw).hexdigest() == m["records_hash"] and len(rows) == m["records_count"] == 11
    assert [r["doc_hash"] for r in rows] == sorted(r["doc_hash"] for r in rows)
    memo = [r for r in rows if r["envelope"]["source_locator"].startswith("a/")]
    assert [r["envelope"]["source_locator"] for r in memo] == ["a/memo-1.txt", "a/memo-2.txt"] and "exact_duplicate" in memo[0]["flags"]
    assert "text" not in rows[0] and "custody" not in rows[0]["envelope"]


def test_verify_and_tampering(spark, built):
    root, key, _ = built
    other = [signing.Signer(bytes(32), "dev").verifier()]
    assert bundle.verify(spark, root, [key.verifier()], root).ok
    assert bundle.verify(spark, root, other).checks["signature"] is False
    (root / "short.log").write_text("changed")
    (root / "new.txt").write_text("new")
    (root / "cut.txt").unlink()
    rep = bundle.verify(spark, root, [key.verifier()], root)
    assert not rep.ok and rep.changed == ["short.log"] and rep.added == ["new.txt"] and rep.removed == [hashlib.sha256(FILES["cut.txt"].encode()).hexdigest()]
    path = root / BUNDLE_DIR / "records.jsonl"
    path.write_text("".join(path.read_text().splitlines(keepends=True)[1:]))
    rep = bundle.verify(spark, root, [key.verifier()])
    assert not rep.checks["records hash"] and not rep.checks["records count"] and not rep.checks["merkle root"]


def test_tools_check_what_they_are_given(spark, built):
    root, _, _ = built
    b = inquiry.Bundle(spark, root, root)
    h, other = (hashlib.sha256(FILES[f"b/report{x}.md"].encode()).hexdigest() for x in ("", "-2"))
    diff, well = b.call("diff_documents", {"first": h, "second": other})
    assert well and {(c["before"], c["after"]) for c in diff["changes"]} == {("June.", "July.")} and 0 < diff["similarity"] < 1
    assert b.call("read_document", {"doc_hash": h, "max_chars": 10})[0] == {"doc_hash": h, "text": FILES["b/report.md"][:10], "of_chars": len(FILES["b/report.md"]), "whole": False}
    assert {f["finding_id"] for f in b.call("list_findings", {})[0]} == {f["finding_id"] for f in b.manifest["findings"]}
    assert "text" not in b.call("get_record", {"doc_hash": h})[0]
    draft = {"finding_id": "DUP-002", "assessment": "real", "narrative": "n", "evidence": []}
    for name, args, what in (
        ("get_record", {"doc_hash": "0"}, "nothing is recorded"), ("nothing", {}, "no tool"), ("propose", draft | {"status": "pass"}, "status is not a parameter"), ("propose", draft | {"evidence": ["0"]}, "nothing is recorded"),
        ("propose", draft | {"assessment": "maybe"}, "must be one of"), ("read_document", {"doc_hash": h, "max_chars": "9"}, "must be int"), ("get_finding", {}, "finding_id is missing"), ("get_finding", {"finding_id": "X"}, "no finding"),
    ):
        out, well = b.call(name, args)
        assert not well and what in out["error"], (name, out)
    assert not b.drafts and len(b.log) == 12 and all(set(x) == {"tool", "args_hash", "result_hash"} for x in b.log)
    assert set(inquiry.TOOLS) == {"list_findings", "get_finding", "get_record", "read_document", "diff_documents", "propose"}
    assert inquiry.TOOLS["propose"].schema()["properties"]["assessment"]["enum"] == ["real", "artifact", "inconclusive"]
    (root / "b/report.md").write_text("other")
    assert "has changed" in b.call("read_document", {"doc_hash": h})[0]["error"]


def test_ledger_and_approval(spark, built):
    root, key, _ = built
    h = hashlib.sha256(FILES["b/report.md"].encode()).hexdigest()
    turns = [[("get_finding", {"finding_id": "DUP-002"})], [("propose", {"finding_id": "DUP-002", "assessment": "real", "narrative": "copies", "evidence": [h, h]})], [("list_findings", {})]]
    outcome = inquiry.play(inquiry.Bundle(spark, root, root), turns)
    assert outcome.run["conclusion"] == "drafted" and outcome.proposal.evidence == (h,) and len(outcome.run["tool_calls"]) == 2
    book = ledger.Ledger(spark, root)
    assert book.table().count() == 0
    name = book.submit(outcome)
    assert name.startswith("prop-") and len(name) == 17 and book.get(name)["state"] == "pending"
    with pytest.raises(ledger.LedgerError, match="who they are"):
        book.approve(name, " ", [key], [key.verifier()])
    m = book.approve(name, "Ana", [key], [key.verifier()])
    f = next(f for f in m["findings"] if f["finding_id"] == "DUP-002")
    assert (f["assessment"], f["approved_by"], f["status"]) == ("real", "Ana", "fail") and m["agent_runs"][0]["proposal_ids"] == [name]
    assert bundle.verify(spark, root, [key.verifier()], root).ok
    with pytest.raises(ledger.LedgerError, match="approved already"):
        book.reject(name, "Ana")
    second = book.submit(inquiry.play(inquiry.Bundle(spark, root), [[("propose", {"finding_id": "DUP-002", "assessment": "artifact", "narrative": "no", "evidence": []})]]))
    with pytest.raises(ledger.LedgerError, match="approved a conclusion before"):
        book.approve(second, "Bo", [key], [key.verifier()])
    idle = book.submit(inquiry.play(inquiry.Bundle(spark, root), [[]]))
    assert book.get(idle)["content"]["proposal"]["assessment"] == "inconclusive"
    book.reject(idle, "Bo", "nothing in it")
    assert {r["proposal_id"]: (r["state"], r["by"]) for r in book.table().collect()} == {name: ("approved", "Ana"), second: ("pending", "scripted"), idle: ("rejected", "Bo")}
    with pytest.raises(ledger.LedgerError, match="somebody else"):
        book._add(idle, 1, "pending", {"state": "approved", "by": "Cy"})
    with pytest.raises(TypeError):
        manifest.Conclusion("DUP-002", status="pass")
    with pytest.raises(KeyError, match="X-1"):
        bundle.amend(root, [manifest.Conclusion("X-1", "real")], [], signers=[key], verifiers=[key.verifier()])


def test_amend_starts_from_what_was_signed(built):
    root, key, _ = built
    path = root / BUNDLE_DIR / "manifest.json"
    forged = json.loads(path.read_text())
    forged["findings"][0]["status"] = "pass"
    path.write_text(json.dumps(forged))
    m = bundle.amend(root, [manifest.Conclusion("DUP-001", "real")], [], signers=[key], verifiers=[key.verifier()])
    assert m["findings"][0]["status"] == "fail"


def test_derived_corpus_and_moved_files(spark, built, tmp_path):
    root, key, m = built
    docs = read_directory(spark, root).where("source_locator LIKE 'a/%'")
    out = tmp_path / "derived"
    origin = bundle.Origin("c", "2", bundle.derived(manifest.BundleFolder(root), "subset", "only a"), ["U"])
    d = bundle.build(out, docs, origin, signers=[key], policy=None, families=["volume"])
    assert d["corpus"]["derived_from"] == {"parent_merkle_root": m["corpus"]["merkle_root"], "parent_manifest_hash": manifest.BundleFolder(root).digest(), "relation": "subset", "description": "only a"}
    assert d["corpus"]["markings"] == ["U"] and d["corpus"]["document_count"] == 2 and d["findings"] == [] and d["run"]["policy_version"] == "none"
    with pytest.raises(manifest.ManifestError, match="relation"):
        bundle.build(tmp_path / "bad", docs, bundle.Origin("c", "3", {"parent_merkle_root": "0" * 64, "relation": "copy"}), signers=[key], policy=None, families=["volume"])
    moved = tmp_path / "moved"
    (root / "a").rename(moved)
    report = bundle.verify(spark, out, [key.verifier()], moved, locate=lambda rows: rows.selectExpr("doc_hash", "substring(source_locator, 3) AS source_locator"))
    assert report.ok and not bundle.verify(spark, out, [key.verifier()], moved).ok


def test_manifest_shape(built):
    _, _, m = built
    assert not list(manifest.problems(m))
    for path, value, what in ((("corpus", "merkle_root"), "x", "corpus/merkle_root"), (("records_count",), -1, "records_count"), (("findings", 0, "severity"), "bad", "findings/0/severity"), (("results", 2, "more"), 1, "results/2/more: unknown"), (("run", "pins", "p"), 1, "pins/p")):
        bad = json.loads(json.dumps(m))
        at = bad
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        assert [x for x in manifest.problems(bad) if what in x], path
    del m["results"][0]["value"]
    assert list(manifest.problems(m)) == ["manifest/results/0/value: missing"]


def test_ed25519_vectors():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert signing.public_of(seed).hex() == public and signing.sign_bytes(seed, b"").hex() == sig
    assert signing.verify_bytes(bytes.fromhex(public), b"", bytes.fromhex(sig)) and not signing.verify_bytes(bytes.fromhex(public), b"x", bytes.fromhex(sig))
    e = envelope.Envelope(b"ab", "t")
    assert e.signed_bytes == b"DSSEv1 1 t 2 ab"
    one, two = signing.Signer(seed, "one"), signing.Signer(bytes(32), "two")
    again = envelope.Envelope.loads(e.sign(one, two).dumps())
    assert again == e and again.signers_among([two.verifier(), signing.Signer(bytes(32), "one").verifier()]) == ["two"]
    with pytest.raises(envelope.BadSignature):
        again.open([signing.Verifier(one.verifier().public, "other")])


def test_merkle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    assert merkle.root_of([]) == hashlib.sha256(b"").hexdigest()
    for n in (1, 2, 7, 8, 9, 50, 65):
        leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
        root = merkle.root_of(leaves)
        assert all(merkle.proves(x, merkle.proof(leaves, x), root) for x in leaves)
        assert n < 2 or not merkle.proves("0" * 64, merkle.proof(leaves, leaves[0]), root)
        for path in [merkle.proof(leaves, leaves[-1])] if n > 1 else []:
            flipped = [{**path[0], "side": {"left": "right", "right": "left"}[path[0]["side"]]}, *path[1:]]
            assert not merkle.proves(leaves[-1], flipped, root) and not merkle.proves(leaves[-1], path[1:], root) and not merkle.proves(leaves[-1], [{**path[0], "hash": "1" * 64}, *path[1:]], root)
    df = spark.createDataFrame([(x,) for x in leaves + leaves[:5]], "doc_hash string")
    assert merkle.merkle_root(df) == root


def test_quantile_rule(spark):
    rng = random.Random(1)
    for n in (1, 2, 14, 101):
        v = [rng.randrange(20) for _ in range(n)]
        got = distributions(spark.createDataFrame([(x,) for x in v], "v long"), {"v": Spread((("p5", 0.05), ("p50", 0.5), ("p95", 0.95)), var=True)}, ("v",))["v"]
        s = sorted(v)
        assert [got[k] for k in ("min", "p5", "p50", "p95", "max")] == [s[0], *[s[int(p * (n - 1))] for p in (0.05, 0.5, 0.95)], s[-1]]
        assert abs(got["var"] - sum((x - sum(v) / n) ** 2 for x in v) / n) < 1e-6
    assert distributions(spark.createDataFrame([], "v long"), {"v": Spread((("p50", 0.5),))}) == {"v": None}
    wide = sorted([rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-40, 60) for _ in range(400)] + [0.0, -0.0, 1.0, 2.0, 1.9999999999999998, 5e-324, 1.7e308])
    rows = spark.createDataFrame([(x, float(k)) for k, x in enumerate(wide)], "v double, w double")
    cells = [r["b"] for r in rows.orderBy("w").select(bucket(F.col("v")).alias("b")).collect()]
    assert cells == sorted(cells)
    both = distributions(rows, {"v": Spread((("p3", 0.03), ("p50", 0.5), ("p99", 0.99))), "w": Spread((("p50", 0.5),))})
    assert [both["v"][k] for k in ("min", "p3", "p50", "p99", "max")] == [wide[int(p * (len(wide) - 1))] for p in (0, 0.03, 0.5, 0.99, 1)] and both["w"]["p50"] == (len(wide) - 1) // 2


def test_token_distribution_reads_documents_once(spark, monkeypatch):
    from docgauge.operators import quantiles

    plans = []
    keep = quantiles.settled
    monkeypatch.setattr(quantiles, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    from docgauge.plans.queries import token_distribution

    token_distribution(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 1 and plans[0].count("FileScan parquet") == 1


def test_policies(spark, tmp_path):
    assert len(gate.load_policy().rules) == 13 and len(gate.load_policy(gate.POLICIES / "marked.yaml").rules) == 5
    p = tmp_path / "p.yaml"
    rule = "{rule_id: R, clause: c, title: t, metric_id: m, fail: {op: '>', value: 2}, flag: {op: '>=', value: 1}, severity: {fail: %s, flag: low}, evidence_flag: x}"
    p.write_text(f"policy_id: 7\npolicy_version: 1.0\nframework: f\nevidence_limit: 1\nrules: [{rule % 'high'}]")
    policy = gate.load_policy(p)
    assert policy.label == "7/1.0" and policy.digest == hashlib.sha256(p.read_bytes()).hexdigest()
    marks = spark.createDataFrame([("x", "h1", 1), ("x", "h2", 2), ("y", "h0", 1)], "flag string, doc_hash string, place int")

    def judged(results, policy=policy):
        (f,) = gate.findings(policy, gate.judge(policy, gate.result_table(spark, results), marks))
        return f

    f = judged([{"metric_id": "m", "value": 3, "unit": "docs"}])
    assert (f["status"], f["severity"], f["gate"]["reason"], f["observed"], f["evidence"]) == ("fail", "high", "3 docs > 2", 3, [{"doc_hash": "h1"}])
    assert judged([{"metric_id": "m", "value": 1.5}])["gate"]["reason"] == "1.5 >= 1" and judged([{"metric_id": "m", "value": 1.5}])["severity"] == "low"
    f = judged([{"metric_id": "m", "value": 0.5}])
    assert f["status"] == "pass" and f["severity"] == "none" and "evidence" not in f and f["narrative"] == "t is 0.5."
    for results, what in (([{"metric_id": "m", "value": {"a": 1}}], "no number"), ([{"metric_id": "m", "value": None}], "undefined"), ([{"metric_id": "m", "value": 3, "scope": "part"}], "no such result"), ([], "no such result")):
        f = judged(results)
        assert f["status"] == f["gate"]["verdict"] == "inconclusive" and what in f["gate"]["reason"] and "observed" not in f
    p.write_text(p.read_text().replace("evidence_limit: 1", "evidence_limit: 0"))
    assert "evidence" not in judged([{"metric_id": "m", "value": 3}], gate.load_policy(p))
    for text in (rule % "awful", "{rule_id: R, clause: c, title: t, metric_id: m, fail: {op: '>', value: 0}, severity: {}}", "{rule_id: R}", (rule % "low").replace("'>'", "'~'"), (rule % "low").replace("title", "titel")):
        p.write_text(f"policy_id: a\npolicy_version: '1'\nframework: f\nrules: [{text}]")
        with pytest.raises(gate.PolicyError, match="rules/0"):
            gate.load_policy(p)
    p.write_text("[1]")
    with pytest.raises(gate.PolicyError, match="a mapping"):
        gate.load_policy(p)


def test_family_choice_and_config(spark, corpus):
    docs = read_directory(spark, corpus)
    m = measure(docs, ["volume"])
    assert [r["metric_id"] for r in m.results] == ["vol.total_docs", "vol.total_tokens", "cnt.token_count"] and "family:volume" in m.pins
    assert measure(docs, ["markings"]).results[2]["value"] is None
    with pytest.raises(AttributeError):
        measure(docs, ["volume"], {"volume": {"x": 1}})
    with pytest.raises(ValueError, match="unknown level"):
        measure(docs, ["markings"], {"markings": {"ceiling": "Z"}})
    assert catalog(spark).count() == 31 and metric("dup.near_rate")["family"] == "duplication"
    none = measure(docs.limit(0))
    assert {r["metric_id"]: r["value"] for r in none.results}["dup.near_rate"] == 0.0


def test_command_line(spark, corpus, tmp_path, capsys):
    key, pub = str(tmp_path / "k"), str(tmp_path / "p")
    assert cli.main(["keygen", "--private", key, "--public", pub]) == 0
    assert cli.main(["scan", str(corpus), "--key", key, "--ceiling", "CUI"]) == 0
    assert "11 documents" in capsys.readouterr().out
    assert cli.main(["verify", str(corpus), "--key", pub, "--corpus", str(corpus)]) == 0
    script = tmp_path / "s.json"
    script.write_text(json.dumps([[["propose", {"finding_id": "INT-001", "assessment": "real", "narrative": "n", "evidence": []}]]]))
    assert cli.main(["triage", str(corpus), str(script)]) == 0
    name = ledger.Ledger(spark, corpus).table().first()["proposal_id"]
    assert cli.main(["approve", str(corpus), name, "--approver", "A", "--key", key, "--public", pub]) == 0
    assert cli.main(["proposals", str(corpus)]) == 0 and "approved" in capsys.readouterr().out
    (corpus / "short.log").write_text("x")
    assert cli.main(["verify", str(corpus), "--key", pub, "--corpus", str(corpus)]) == 1


def test_stream_scoring(spark, tmp_path):
    from docgauge.streaming.score import flag_counts

    rows = spark.createDataFrame([(1, "2026-01-01 00:10:00", "word"), (2, "2026-01-01 00:20:00", "a\x07"), (3, "2026-01-01 03:00:00", PROSE)], "doc_id long, t string, text string")
    rows = rows.selectExpr("doc_id", "CAST(t AS TIMESTAMP) AS ts", "text", "octet_length(text) AS size_bytes")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = flag_counts(stream, "ts").writeStream.outputMode("append").format("memory").queryName("flags").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("flags").orderBy("start").collect()
    assert [(r["docs"], r["control_chars"], r["near_empty"]) for r in got] == [(2, 1, 2)]


def test_two_signatures_under_one_key_id():
    from docgauge.plans.envelope import BadSignature, Envelope, Statement
    from docgauge.plans.signing import Signer

    good, other = Signer(bytes(range(32)), "k"), Signer(bytes(32), "k")
    body = Statement("c@1", "0" * 64, {"corpus": {}}).encoded()
    for order in ((good, other), (other, good)):
        told = Envelope.loads(Envelope(body).sign(*order).dumps())
        assert len(told.signatures) == 2 and told.open([good.verifier()]).name == "c@1" and told.open([other.verifier()]).name == "c@1"
    with pytest.raises(BadSignature):
        Envelope.loads(Envelope(body).sign(other).dumps()).open([good.verifier()])


def test_records_in_parts_and_their_shape(spark, tmp_path):
    from docgauge.plans.bundle import Origin, build, verify
    from docgauge.plans.manifest import BundleFolder
    from docgauge.plans.measure import extend, records, select_families, Measured
    from docgauge.plans.record_shape import RecordError, broken, checked, conditions, field_names
    from docgauge.plans.signing import Signer
    from docgauge.sources.tables import read_documents

    key = Signer(bytes(range(32)), "k")
    docs = read_documents(spark, "/root/testdata/sf0.001", defects=True)
    whole = build(tmp_path / "one", docs, Origin("c", "1"), signers=[key], families=["volume", "markings"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = build(tmp_path / "many", docs, Origin("c", "1"), signers=[key], families=["volume", "markings"], parts=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = BundleFolder(tmp_path / "many").records
    files = sorted(folder.glob("part-*"))
    assert len(files) > 1 and b"".join(f.read_bytes() for f in files) == BundleFolder(tmp_path / "one").records.read_bytes()
    assert parts["records_count"] == whole["records_count"] and verify(spark, tmp_path / "many", [key.verifier()]).ok
    files[0].write_bytes(files[0].read_bytes().replace(b'"size_bytes":', b'"size_bytes":1', 1))
    (folder / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert not verify(spark, tmp_path / "many", [key.verifier()]).checks["records hash"]

    families = select_families()
    rows = records(Measured(extend(docs, families), families, [], {}))
    assert list(conditions(families, rows.columns)) == field_names(families, rows.columns)
    assert broken(rows, families).where("records > 0").count() == 0 and checked(rows, families) is rows
    bad = rows.withColumn("markings_parsed", F.col("markings_parsed").withField("level", F.lit("XX")))
    with pytest.raises(RecordError, match="markings_parsed/level"):
        checked(bad, families)
