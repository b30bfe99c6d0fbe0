"""The manifest of a bundle: its shape as data, and the folder it lies in.

A shape maps each key to a test, a trailing question mark meaning that the key may be absent. A test is a type, a
pattern, a tuple of allowed values, a shape, or a list of one of these.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path

from ..model import HASH_ALG
from ..sources.directory import BUNDLE_DIR
from .envelope import Envelope, Statement
from .gate import SEVERITIES

HEX = re.compile(r"[0-9a-f]{64}")
RELATIONS = ("subset", "filter", "transform", "union")
ASSESSMENTS = ("real", "artifact", "inconclusive")
STATUSES = ("pass", "flag", "fail", "rejected", "inconclusive")


class Natural(int):
    """A whole number of at least 0; only a test."""


OPEN = "..."  # further keys are allowed
SHAPE = {
    "manifest_version": ("0",),
    "corpus": {
        "corpus_id": str, "version_id": str, "merkle_root": HEX, "hash_alg": (HASH_ALG,), "document_count": Natural, "total_bytes": Natural, "markings?": [str],
        "derived_from?": {"parent_merkle_root": HEX, "relation": RELATIONS, "parent_manifest_hash?": str, "description?": str},
    },
    "run": {"run_id": str, "started_at": str, "finished_at": str, "engine": str, "catalog_version": str, "policy_version": str, "pins": {OPEN: str}, "sample_seed?": object},
    "records_hash": HEX,
    "records_count": Natural,
    "results": [{"metric_id": str, "method_version": str, "value": object, "unit?": str, "distribution?": object, "scope?": str, "sample?": object, "confidence?": object}],
    "findings": [{"finding_id": str, "framework": str, "clause": str, "metric_ids": [str], "status": STATUSES, "severity": SEVERITIES, "assessment?": ASSESSMENTS, OPEN: object}],
    "agent_runs": [{"agent": str, "model": str, "started_at": str, "tool_calls": list, OPEN: object}],
}


def problems(value, shape=SHAPE, at: str = "manifest") -> Iterator[str]:
    """Where a value leaves its shape, in order."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            yield f"{at}: not an object"
            return
        named = {k.rstrip("?"): (test, k.endswith("?")) for k, test in shape.items() if k != OPEN}
        for key, (test, absent) in named.items():
            if key in value:
                yield from problems(value[key], test, f"{at}/{key}")
            elif not absent:
                yield f"{at}/{key}: missing"
        for key in sorted(set(value) - set(named)):
            if OPEN in shape:
                yield from problems(value[key], shape[OPEN], f"{at}/{key}")
            else:
                yield f"{at}/{key}: unknown"
    elif isinstance(shape, list):
        if not isinstance(value, list):
            yield f"{at}: not a list"
            return
        for k, x in enumerate(value):
            yield from problems(x, shape[0], f"{at}/{k}")
    elif isinstance(shape, tuple):
        if value not in shape:
            yield f"{at}: {value!r} is none of {', '.join(shape)}"
    elif isinstance(shape, re.Pattern):
        if not (isinstance(value, str) and shape.fullmatch(value)):
            yield f"{at}: not of the form {shape.pattern}"
    elif shape is Natural:
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            yield f"{at}: not a whole number of at least 0"
    elif not isinstance(value, shape):
        yield f"{at}: not a {shape.__name__}"


class ManifestError(ValueError):
    """A manifest isn't of its shape."""


def checked(manifest: dict) -> dict:
    for what in problems(manifest):
        raise ManifestError(what)
    return manifest


@dataclass(frozen=True)
class Conclusion:
    """All that may be written into a finding after it was measured: there is no field for anything else."""

    finding_id: str
    assessment: str | None = None
    narrative: str | None = None
    remediation: dict | None = None
    approved_by: str | None = None
    approved_at: str | None = None

    def set_fields(self) -> dict:
        return {f.name: v for f in fields(self) if f.name != "finding_id" and (v := getattr(self, f.name)) is not None}


class BundleFolder:
    """The files of a bundle below a corpus or any other folder."""

    def __init__(self, root):
        self.path = Path(root) / BUNDLE_DIR
        self.records, self.plain, self.signed, self.proposals = (self.path / n for n in ("records.jsonl", "manifest.json", "manifest.dsse.json", "proposals"))

    def put(self, manifest: dict, signers: list) -> dict:
        envelope = Envelope(Statement.about(checked(manifest)).encoded()).sign(*signers)
        self.plain.write_text(json.dumps(manifest, indent=1, sort_keys=True))
        self.signed.write_text(envelope.dumps())
        return manifest

    def statement(self, verifiers: list) -> Statement:
        return Envelope.loads(self.signed.read_text()).open(verifiers)

    def unsigned(self) -> dict:
        """The manifest as anyone may have left it; for reading only."""
        return json.loads(self.plain.read_text())

    def digest(self) -> str:
        return hashlib.sha256(self.plain.read_bytes()).hexdigest()
