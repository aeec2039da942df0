"""Research protocols: three ordered windows of dates, their binding to exported formulas, and a registry of runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .formula import Formula

STAGES = ("discovery", "validation", "lockbox")


@dataclass(frozen=True)
class Span:
    start: str | None = None
    end: str | None = None

    def low(self) -> date:
        return date.fromisoformat(self.start) if self.start else date.min

    def high(self) -> date:
        return date.fromisoformat(self.end) if self.end else date.max


@dataclass(frozen=True)
class Protocol:
    dataset_id: str
    target: str
    direction: str
    discovery: Span
    validation: Span
    lockbox: Span
    candidate_top_k: int = 1_000
    strict: bool = True
    notes: str = ""
    schema_version: int = 1

    def validate(self) -> None:
        """Windows must be in order and apart; an open end reaches to infinity."""
        if self.schema_version != 1:
            raise ValueError(f"unknown schema version {self.schema_version}")
        spans = [getattr(self, s) for s in STAGES]
        for name, s in zip(STAGES, spans):
            if s.low() > s.high():
                raise ValueError(f"{name} ends before it starts")
        for (a, x), (b, y) in zip(zip(STAGES, spans), list(zip(STAGES, spans))[1:]):
            if x.high() >= y.low():
                raise ValueError(f"{a} must end before {b} starts")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Protocol:
        d = json.loads(text)
        return cls(**{**d, **{s: Span(**d[s]) for s in STAGES}})

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def export_formulas(path: str, combinations: list[str], protocol: Protocol | None, source: dict) -> dict:
    """Write ``Rank N: formula`` lines and, beside them, a manifest of where they come from."""
    lines = ["# exported formulas", *[f"Rank {i}: {c}" for i, c in enumerate(combinations, 1)]]
    text = "\n".join(lines) + "\n"
    manifest = {"schema_version": 2, "formulas_sha256": hashlib.sha256(text.encode()).hexdigest(), "count": len(combinations), "protocol_sha256": protocol.digest() if protocol else None, **source}
    files.write(path, text)
    files.write(f"{path}.manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def bound_formulas(path: str, protocol: Protocol | None, target: str, direction: str) -> str:
    """The text of a formula file; under a protocol it must come with the manifest of just this text, and target and direction be those of the protocol."""
    text = files.read(path)
    if protocol is None:
        return text
    protocol.validate()
    for k, v in (("target", target), ("direction", direction)):
        if getattr(protocol, k) != v:
            raise ValueError(f"{k} is {v!r}, the protocol's is {getattr(protocol, k)!r}")
    if not files.exists(f"{path}.manifest.json"):
        if protocol.strict:
            raise ValueError(f"{path} has no manifest; a strict protocol takes exported formulas only")
        return text
    manifest = json.loads(files.read(f"{path}.manifest.json"))
    check_manifest(manifest, protocol)
    if manifest.get("formulas_sha256") != hashlib.sha256(text.encode()).hexdigest():
        raise ValueError(f"{path} is not the file that its manifest describes")
    return text


def check_manifest(manifest: dict, protocol: Protocol) -> None:
    """The formulas must come from this protocol's target, direction and discovery window."""
    if manifest.get("schema_version") != 2:
        raise ValueError("unknown manifest version")
    for k in ("target", "direction"):
        if manifest.get(k) != getattr(protocol, k):
            raise ValueError(f"manifest {k} is {manifest.get(k)!r}, the protocol's is {getattr(protocol, k)!r}")
    if protocol.strict and not manifest.get("protocol_sha256"):
        raise ValueError("manifest is bound to no protocol")
    if manifest.get("protocol_sha256") not in (None, protocol.digest()):
        raise ValueError("manifest belongs to another protocol")
    end = manifest.get("source_end")
    if protocol.strict and not end:
        raise ValueError("manifest does not say where its source ends")
    if end and date.fromisoformat(end) > protocol.discovery.high():
        raise ValueError("the source reaches beyond the discovery window")


def check_stage(stage: str, formulas: list[Formula], mode: str) -> None:
    """The lockbox takes one formula, already chosen."""
    if stage in ("lockbox", "live-shadow"):
        if len(formulas) != 1:
            raise ValueError(f"{stage} takes exactly one formula, not {len(formulas)}")
        if mode != "off":
            raise ValueError(f"{stage} makes no selection")


def visible(df: DataFrame, protocol: Protocol, stage: str) -> DataFrame:
    """The bars that a stage may see: none after its own window."""
    end = getattr(protocol, stage if stage in STAGES else "lockbox").end
    return df.where(F.to_date("ts") <= F.lit(end).cast("date")) if end else df


class Registry:
    """Run records as JSON files in a folder of any file system."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def add(self, record: dict) -> str:
        body = {**record, "at": datetime.now(timezone.utc).isoformat()}
        name = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16] + ".json"
        files.create(f"{self.path}/{name}", json.dumps(body, indent=2, sort_keys=True))
        return name

    def records(self) -> list[dict]:
        return [json.loads(files.read(f"{self.path}/{n}")) for n in files.names(self.path, ".json")]

    def lockbox_attempt(self, protocol_sha256: str, formula: str, acknowledge: bool = False) -> int:
        """Take the next attempt of a formula at the lockbox, before it is evaluated; how many there were before. A further one needs an acknowledgement, and of two runs at the same time one is refused."""
        n = sum(r.get("stage") == "lockbox" and r.get("protocol_sha256") == protocol_sha256 and r.get("formula") == formula for r in self.records())
        if n and not acknowledge:
            raise ValueError(f"the lockbox has seen this formula {n} times; acknowledge to rerun")
        key = hashlib.sha256(json.dumps([protocol_sha256, formula]).encode()).hexdigest()[:24]
        record = {"stage": "lockbox", "protocol_sha256": protocol_sha256, "formula": formula, "attempt": n, "at": datetime.now(timezone.utc).isoformat()}
        if not files.create(f"{self.path}/lockbox-{key}-{n}.json", json.dumps(record, indent=2, sort_keys=True)):
            raise ValueError("another run has just taken this attempt at the lockbox")
        return n


def compare_benchmarks(old: dict[str, list[float]], new: dict[str, list[float]], median_budget: float = 0.03, p95_budget: float = 0.05, hard: frozenset[str] = frozenset()) -> dict[str, str]:
    """ok, regression or missing for each entry: a median beyond its budget, or a 95th percentile and a mean beyond theirs."""
    from statistics import mean, median

    p95 = lambda x: sorted(x)[min(len(x) - 1, round(0.95 * (len(x) - 1)))]
    out = {}
    for name, a in old.items():
        b = new.get(name)
        if not b:
            out[name] = "missing" if name in hard else "absent"
        else:
            worse = median(b) > median(a) * (1 + median_budget) or (p95(b) > p95(a) * (1 + p95_budget) and mean(b) > mean(a) * (1 + median_budget))
            out[name] = "regression" if worse else "ok"
    return out
