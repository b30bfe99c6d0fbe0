"""Command line: keygen, scan, verify, triage, proposals, approve, reject."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("docgauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docgauge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("keygen", help="write a key pair")
    c.add_argument("--private", default="docgauge.key")
    c.add_argument("--public", default="docgauge.pub")
    c = sub.add_parser("scan", help="measure a directory and write a signed bundle")
    c.add_argument("corpus")
    c.add_argument("--out")
    c.add_argument("--key", required=True)
    c.add_argument("--corpus-id", default="corpus")
    c.add_argument("--version-id", default="1")
    c.add_argument("--provenance")
    c.add_argument("--policy")
    c.add_argument("--ceiling", choices=["U", "CUI", "C", "S", "TS"])
    c = sub.add_parser("verify", help="check a bundle; the exit code tells")
    c.add_argument("root")
    c.add_argument("--key", required=True)
    c.add_argument("--corpus")
    c = sub.add_parser("triage", help="play a script of tool calls and submit its conclusion")
    c.add_argument("root")
    c.add_argument("script", help="JSON: a list of turns, each a list of [tool, arguments]")
    c.add_argument("--corpus")
    c = sub.add_parser("proposals", help="list proposals")
    c.add_argument("root")
    for name in ("approve", "reject"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("proposal_id")
        c.add_argument("--approver", required=True)
        if name == "approve":
            c.add_argument("--key", required=True)
            c.add_argument("--public", required=True)
        else:
            c.add_argument("--reason", default="")
    for c in sub.choices.values():
        c.add_argument("--keyid", default="dev")
    return p


def main(argv: list[str] | None = None) -> int:
    from .plans import bundle, gate, inquiry, ledger, signing
    from .sources.directory import read_directory, validate

    a = parser().parse_args(argv)
    if a.command == "keygen":
        signing.Signer.generate(a.keyid).save_pem(a.private, a.public)
    elif a.command == "scan":
        docs = validate(read_directory(_spark(), a.corpus, a.provenance))
        m = bundle.build(
            a.out or a.corpus, docs, bundle.Origin(a.corpus_id, a.version_id), signers=[signing.Signer.from_pem(a.key, a.keyid)],
            policy=a.policy or gate.DEFAULT_POLICY, config={"markings": {"ceiling": a.ceiling}} if a.ceiling else None,
        )
        print(f"{m['corpus']['document_count']} documents, root {m['corpus']['merkle_root']}")
        for r in m["results"]:
            print(f"{r['metric_id']}: {json.dumps(r['value'])}")
        for f in m["findings"]:
            print(f"{f['finding_id']} {f['status']} {f['severity']}: {f['gate']['reason']}")
    elif a.command == "verify":
        report = bundle.verify(_spark(), a.root, [signing.Verifier.from_pem(a.key, a.keyid)], a.corpus)
        for k, v in report.checks.items():
            print(f"{'ok  ' if v else 'FAIL'} {k}")
        for kind in ("changed", "added", "removed"):
            for x in getattr(report, kind)[:5]:
                print(f"{kind}: {x}")
        return 0 if report.ok else 1
    else:
        book = ledger.Ledger(_spark(), a.root)
        if a.command == "triage":
            turns = json.loads(Path(a.script).read_text())
            print(book.submit(inquiry.play(inquiry.Bundle(book.spark, a.root, a.corpus), turns)))
        elif a.command == "proposals":
            for r in book.table().toLocalIterator():
                print(r["proposal_id"], r["state"], r["finding_id"], r["assessment"])
        elif a.command == "approve":
            book.approve(a.proposal_id, a.approver, [signing.Signer.from_pem(a.key, a.keyid)], [signing.Verifier.from_pem(a.public, a.keyid)])
        else:
            book.reject(a.proposal_id, a.approver, a.reason)
    return 0


if __name__ == "__main__":
    sys.exit(main())
