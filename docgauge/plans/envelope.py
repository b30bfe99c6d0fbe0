"""Signed envelopes: a typed statement about a corpus, and the DSSE form in which it is signed and stored."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

# Fixed values of the formats (DSSE 1.0, in-toto statements 1.0).
DSSE_KIND = "application/vnd.in-toto+json"
STATEMENT_KIND = "https://in-toto.io/Statement/v1"
PREDICATE_KIND = "https://docgauge.invalid/manifest/v0"


class BadSignature(ValueError):
    """Nobody known has signed this."""


def compact(value) -> bytes:
    """The one form of a JSON value that is hashed and signed: sorted keys, no spaces, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


@dataclass
class Statement:
    """What is said (predicate) of what (name, and the digest of its content)."""

    name: str
    digest: str
    predicate: dict

    @classmethod
    def about(cls, manifest: dict) -> Statement:
        return cls("{corpus_id}@{version_id}".format(**manifest["corpus"]), manifest["corpus"]["merkle_root"], manifest)

    def encoded(self) -> bytes:
        return compact({"_type": STATEMENT_KIND, "predicateType": PREDICATE_KIND, "predicate": self.predicate, "subject": [{"name": self.name, "digest": {"sha256": self.digest}}]})

    @classmethod
    def decoded(cls, raw: bytes) -> Statement:
        told = json.loads(raw)
        (subject,) = told["subject"]
        return cls(subject["name"], subject["digest"]["sha256"], told["predicate"])


@dataclass
class Envelope:
    """Bytes of a kind and who signed them: pairs of key id and signature. One key id may have several, any of which may hold."""

    body: bytes
    kind: str = DSSE_KIND
    signatures: list[tuple[str, bytes]] = field(default_factory=list)

    @property
    def signed_bytes(self) -> bytes:
        """DSSE signs the kind along with the body, each behind its length."""
        out = [b"DSSEv1"]
        for part in (self.kind.encode(), self.body):
            out += [b"%d" % len(part), part]
        return b" ".join(out)

    def sign(self, *signers) -> Envelope:
        for s in signers:
            self.signatures.append((s.keyid, s.sign(self.signed_bytes)))
        return self

    def signers_among(self, verifiers) -> list[str]:
        """The key ids whose signature holds."""
        return [v.keyid for v in verifiers if any(v.verify(self.signed_bytes, sig) for keyid, sig in self.signatures if keyid == v.keyid)]

    def open(self, verifiers) -> Statement:
        """The statement, which one known signer is enough to vouch for."""
        if not self.signers_among(verifiers):
            raise BadSignature("no signature holds under the keys given")
        return Statement.decoded(self.body)

    def dumps(self) -> str:
        text = lambda b: base64.b64encode(b).decode()
        return json.dumps({"payloadType": self.kind, "payload": text(self.body), "signatures": [{"keyid": k, "sig": text(v)} for k, v in self.signatures]}, indent=1)

    @classmethod
    def loads(cls, text: str) -> Envelope:
        told = json.loads(text)
        return cls(base64.b64decode(told["payload"]), told["payloadType"], [(s["keyid"], base64.b64decode(s["sig"])) for s in told["signatures"]])
