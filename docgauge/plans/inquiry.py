"""Tools for looking into a bundle. Each declares its parameters, which are checked before it runs; every call is logged.

Findings and records are DataFrames; a tool returns a plain object. The one tool that leaves
something behind drafts a proposal, a typed value that has no place for what was measured.
"""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.directory import now_iso
from .envelope import compact
from .manifest import ASSESSMENTS, BundleFolder

MAX_CHARS, MAX_CHANGES, MAX_TURNS = 4000, 20, 12


class Refused(ValueError):
    """A tool was asked for something that it can't or won't give."""


@dataclass(frozen=True)
class Param:
    kind: type
    about: str = ""
    required: bool = True
    one_of: tuple[str, ...] = ()
    most: int | None = None

    def fault(self, value) -> str | None:
        if not isinstance(value, self.kind) or isinstance(value, bool):
            return f"must be {self.kind.__name__}"
        if self.one_of and value not in self.one_of:
            return f"must be one of {', '.join(self.one_of)}"
        if self.kind is int and value < 1:
            return "must be at least 1"
        if self.kind is list and not all(isinstance(x, str) for x in value):
            return "must hold strings"
        return None

    def schema(self) -> dict:
        out = {"type": {str: "string", int: "integer", list: "array", dict: "object"}[self.kind]}
        for key, v in (("description", self.about), ("enum", list(self.one_of)), ("maximum", self.most), ("minimum", 1 if self.kind is int else None), ("items", {"type": "string"} if self.kind is list else None)):
            if v:
                out[key] = v
        return out


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    params: dict[str, Param]
    run: Callable[..., object]

    def schema(self) -> dict:
        """What a caller may pass, as JSON schema."""
        return {"type": "object", "additionalProperties": False, "properties": {k: p.schema() for k, p in self.params.items()}, "required": [k for k, p in self.params.items() if p.required]}

    def bind(self, args: dict) -> dict:
        faults = [f"{k} is not a parameter" for k in args if k not in self.params]
        faults += [f"{k} is missing" for k, p in self.params.items() if p.required and k not in args]
        faults += [f"{k} {why}" for k, v in args.items() if k in self.params and (why := self.params[k].fault(v))]
        if faults:
            raise Refused(f"{self.name}: {'; '.join(faults)}")
        return args


@dataclass(frozen=True)
class Proposal:
    """A conclusion that somebody might approve, and the documents it rests on."""

    finding_id: str
    assessment: str
    narrative: str
    evidence: tuple[str, ...] = ()
    remediation: dict | None = None

    def body(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if v not in (None, ())}


TOOLS: dict[str, Tool] = {}


def tool(about: str, **params: Param):
    def keep(run):
        TOOLS[run.__name__] = Tool(run.__name__, about, params, run)
        return run

    return keep


@dataclass
class Bundle:
    """A bundle open for reading, and the corpus itself if its folder is known."""

    spark: SparkSession
    root: Path
    corpus: Path | None = None
    drafts: list[Proposal] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.folder = BundleFolder(self.root)
        self.manifest = self.folder.unsigned()
        rows = [(k, f["finding_id"], json.dumps(f)) for k, f in enumerate(self.manifest["findings"])]
        self.findings: DataFrame = self.spark.createDataFrame(rows, "place int, finding_id string, body string")
        lines = self.spark.read.text(str(self.folder.records))
        self.records: DataFrame = lines.select("value", F.get_json_object("value", "$.doc_hash").alias("doc_hash"), F.get_json_object("value", "$.envelope.source_locator").alias("locator"))

    def first_records(self, hashes: list[str]) -> dict[str, dict]:
        """Records by hash; of exact copies the one whose locator comes first."""
        order = Window.partitionBy("doc_hash").orderBy(F.split("locator", "/"))
        rows = self.records.where(F.col("doc_hash").isin(hashes)).withColumn("k", F.row_number().over(order)).where("k = 1")
        return {r["doc_hash"]: json.loads(r["value"]) for r in rows.collect()}

    def record(self, doc_hash: str) -> dict:
        found = self.first_records([doc_hash])
        if not found:
            raise Refused(f"nothing is recorded under {doc_hash}")
        return found[doc_hash]

    def text(self, doc_hash: str) -> str:
        """A document's text, if its file is there and still has this hash."""
        locator = self.record(doc_hash)["envelope"]["source_locator"]
        if self.corpus is None or not (path := Path(self.corpus) / locator).is_file():
            raise Refused(f"{locator}: the file isn't at hand")
        data = path.read_bytes()
        if hashlib.sha256(data).hexdigest() != doc_hash:
            raise Refused(f"{locator}: the file has changed since it was recorded")
        return data.decode("utf-8", "replace")

    def call(self, name: str, args: dict) -> tuple[object, bool]:
        """(result, whether it went well); errors are results too, and every call is logged by the hashes of what went in and out."""
        try:
            if name not in TOOLS:
                raise Refused(f"{name!r} is no tool; there are {', '.join(TOOLS)}")
            out, well = TOOLS[name].run(self, **TOOLS[name].bind(args)), True
        except Refused as e:
            out, well = {"error": str(e)}, False
        self.log.append({"tool": name, "args_hash": _hash(args), "result_hash": _hash(out)})
        return out, well


def _hash(value) -> str:
    return hashlib.sha256(compact(value)).hexdigest()


HASH = Param(str, "SHA-256 of a document")
FINDING = Param(str, "id of a finding")


@tool("What was found, in short.")
def list_findings(b: Bundle) -> list[dict]:
    short = [F.get_json_object("body", f"$.{k}").alias(k) for k in ("clause", "status", "severity", "observed")]
    return [{k: v for k, v in r.asDict().items() if k != "place"} for r in b.findings.select("place", "finding_id", *short).orderBy("place").collect()]


@tool("All about one finding.", finding_id=FINDING)
def get_finding(b: Bundle, finding_id: str) -> dict:
    rows = b.findings.where(F.col("finding_id") == finding_id).limit(1).collect()
    if not rows:
        raise Refused(f"{finding_id!r} is no finding of this bundle")
    return json.loads(rows[0]["body"])


@tool("What is recorded of a document; never its text.", doc_hash=HASH)
def get_record(b: Bundle, doc_hash: str) -> dict:
    return b.record(doc_hash)


@tool("The beginning of a document.", doc_hash=HASH, max_chars=Param(int, "characters wanted", required=False, most=MAX_CHARS))
def read_document(b: Bundle, doc_hash: str, max_chars: int = MAX_CHARS) -> dict:
    text = b.text(doc_hash)
    shown = text[: min(max_chars, MAX_CHARS)]
    return {"doc_hash": doc_hash, "text": shown, "of_chars": len(text), "whole": len(shown) == len(text)}


@tool("Which words differ between two documents.", first=HASH, second=HASH)
def diff_documents(b: Bundle, first: str, second: str) -> dict:
    old, new = (b.text(h).split() for h in (first, second))
    match = difflib.SequenceMatcher(None, old, new, autojunk=False)
    changed = [x for x in match.get_opcodes() if x[0] != "equal"]
    shown = [{"kind": kind, "word": i, "before": " ".join(old[i:j]), "after": " ".join(new[k:m])} for kind, i, j, k, m in changed[:MAX_CHANGES]]
    return {"similarity": round(match.ratio(), 4), "words": [len(old), len(new)], "changes": shown, "more_changes": len(changed) - len(shown)}


@tool(
    "Draft a conclusion about a finding for a person to approve.",
    finding_id=FINDING, assessment=Param(str, "what the finding is", one_of=ASSESSMENTS), narrative=Param(str, "why"),
    evidence=Param(list, "hashes of the documents that show it"), remediation=Param(dict, "what to do", required=False),
)
def propose(b: Bundle, finding_id: str, assessment: str, narrative: str, evidence: list[str], remediation: dict | None = None) -> dict:
    get_finding(b, finding_id)
    hashes = tuple(dict.fromkeys(evidence))
    known = b.first_records(list(hashes)) if hashes else {}
    if unknown := [h for h in hashes if h not in known]:
        raise Refused(f"nothing is recorded under {', '.join(unknown)}")
    b.drafts.append(Proposal(finding_id, assessment, narrative, hashes, remediation))
    return {"drafted": finding_id, "documents": len(hashes)}


@dataclass
class Outcome:
    proposal: Proposal
    run: dict


def play(bundle: Bundle, turns, agent: str = "scripted", model: str = "none") -> Outcome:
    """Play turns, lists of (tool, arguments), until one has drafted a proposal, a turn is empty, or MAX_TURNS are over.

    Without a draft the outcome is an inconclusive proposal that says how it ended, so there is always one to submit.
    """
    begun, how = now_iso(), "turns ran out"
    for turn, _ in zip(turns, range(MAX_TURNS)):
        for name, args in turn:
            bundle.call(name, args)
        if bundle.drafts or not turn:
            how = "drafted" if bundle.drafts else "gave up"
            break
    first = next((f["finding_id"] for f in bundle.manifest["findings"]), "")
    last = bundle.drafts[-1] if bundle.drafts else Proposal(first, "inconclusive", f"The investigation ended without a conclusion: {how}.")
    return Outcome(last, {"agent": agent, "model": model, "started_at": begun, "finished_at": now_iso(), "tool_calls": list(bundle.log), "conclusion": how})
