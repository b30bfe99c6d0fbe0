"""The ledger of proposals: events that are only ever added, and the state that follows from them.

An event is a file of its own, <proposal>.<number>.json, and is created exclusively: number 0 submits, number 1
decides. So of two people who decide at once one is told that it is decided already, and nothing is
overwritten. What stands where is a DataFrame over all events.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.directory import now_iso
from .bundle import amend
from .envelope import compact
from .inquiry import Outcome
from .manifest import BundleFolder, Conclusion

EVENT = "proposal_id string, number int, state string, at string, by string, reason string, finding_id string, assessment string, content string"
#: What may follow what.
NEXT = {None: ("pending",), "pending": ("approved", "rejected"), "approved": (), "rejected": ()}


class LedgerError(ValueError):
    """The ledger doesn't allow this step."""


@dataclass
class Ledger:
    spark: SparkSession
    root: object

    def __post_init__(self):
        self.folder = BundleFolder(self.root).proposals

    def events(self) -> DataFrame:
        if not any(self.folder.glob("*.json")):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).json(f"{self.folder}/*.json")

    def table(self) -> DataFrame:
        """One row per proposal: its last event, with what was submitted."""
        own = Window.partitionBy("proposal_id")
        rows = self.events().withColumn("top", F.max("number").over(own))
        for c in ("finding_id", "assessment", "content"):
            rows = rows.withColumn(c, F.max(c).over(own))
        return rows.where("number = top").drop("top", "number").orderBy("proposal_id")

    def get(self, proposal_id: str) -> dict:
        rows = self.table().where(F.col("proposal_id") == proposal_id).collect()
        if not rows:
            raise LedgerError(f"the ledger has no {proposal_id}")
        return rows[0].asDict() | {"content": json.loads(rows[0]["content"])}

    def _add(self, proposal_id: str, number: int, before: str | None, event: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        if event["state"] not in NEXT[before]:
            raise LedgerError(f"{proposal_id} was {before} already")
        try:
            with (self.folder / f"{proposal_id}.{number}.json").open("x") as f:
                f.write(json.dumps({"proposal_id": proposal_id, "number": number, "at": now_iso(), **event}))
        except FileExistsError:
            raise LedgerError(f"{proposal_id} was decided by somebody else already") from None

    def submit(self, outcome: Outcome) -> str:
        """File a proposal; its id follows from its content and the run that led to it."""
        content = {"proposal": outcome.proposal.body(), "run": outcome.run}
        proposal_id = f"prop-{hashlib.sha256(compact(content)).hexdigest()[:12]}"
        self._add(proposal_id, 0, None, {"state": "pending", "by": outcome.run["agent"], "finding_id": outcome.proposal.finding_id, "assessment": outcome.proposal.assessment, "content": json.dumps(content)})
        return proposal_id

    def reject(self, proposal_id: str, by: str, reason: str = "") -> None:
        self._add(proposal_id, 1, self.get(proposal_id)["state"], {"state": "rejected", "by": by, "reason": reason})

    def approve(self, proposal_id: str, by: str, signers: list, verifiers: list) -> dict:
        """Take a pending conclusion into the manifest under a person's name; returns the manifest as signed again."""
        if not by.strip():
            raise LedgerError("who approves must say who they are")
        entry = self.get(proposal_id)
        told, run = entry["content"]["proposal"], entry["content"]["run"]
        findings = {f["finding_id"]: f for f in BundleFolder(self.root).statement(verifiers).predicate["findings"]}
        obstacle = _obstacle(findings.get(told["finding_id"]))
        if obstacle:
            raise LedgerError(f"{told['finding_id']}: {obstacle}")
        self._add(proposal_id, 1, entry["state"], {"state": "approved", "by": by})
        conclusion = Conclusion(told["finding_id"], told["assessment"], told["narrative"], told.get("remediation"), by, now_iso())
        return amend(self.root, [conclusion], [run | {"proposal_ids": [proposal_id]}], signers=signers, verifiers=verifiers)


def _obstacle(finding: dict | None) -> str | None:
    """Why a finding can't take a conclusion. Inconclusive ones can: the gate has looked at them."""
    match finding:
        case None:
            return "the signed manifest has no such finding"
        case {"approved_by": str(name)} if name:
            return f"{name} has approved a conclusion before"
        case {"gate": {"verdict": str()}}:
            return None
    return "no gate has judged it"
