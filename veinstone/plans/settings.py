"""Settings in groups, from five layers: defaults, .env file, named profile, environment, overrides."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from ..functions.structure import Chunking
from ..sources.store import fingerprint

PREFIX = "VEINSTONE_"


@dataclass(frozen=True)
class Retrieval:
    strategy: str = "dense_mmr"
    k: int = 10
    fetch_factor: int = 4
    lambda_: float = 0.5
    rrf_k: int = 60
    pool_factor: int = 3


@dataclass(frozen=True)
class Screening:
    min_relevance: int = 5
    presummary_n: int = 15


@dataclass(frozen=True)
class Answering:
    max_evidence: int = 10


@dataclass(frozen=True)
class Agent:
    max_steps: int = 12
    timeout_s: float = 500.0
    max_tokens: int | None = None
    no_gain_limit: int = 2


@dataclass(frozen=True)
class Ingest:
    target: int = 1500
    most: int = 3000
    least: int = 300
    overlap: int = 200
    drop_references: bool = True
    max_file_mb: float = 50.0

    @property
    def chunking(self) -> Chunking:
        return Chunking(self.target, self.most, self.least, self.overlap, self.drop_references).checked()


@dataclass(frozen=True)
class Model:
    embedding: str = "hash"
    dims: int = 64
    api_key: str | None = None


@dataclass(frozen=True)
class Settings:
    ingest: Ingest = field(default_factory=Ingest)
    retrieval: Retrieval = field(default_factory=Retrieval)
    screening: Screening = field(default_factory=Screening)
    answering: Answering = field(default_factory=Answering)
    agent: Agent = field(default_factory=Agent)
    model: Model = field(default_factory=Model)

    def fingerprint(self) -> str:
        """What an index depends on; neither the corpus nor how it is searched."""
        return fingerprint({"chunking": list(self.ingest.chunking), "embedding": [self.model.embedding, self.model.dims]})

    def shown(self) -> dict:
        """As a dict with secrets masked."""
        made = asdict(self)
        for group in made.values():
            for name in group:
                if "key" in name and group[name]:
                    group[name] = "***"
        return made


def merged(base: dict, over: dict) -> dict:
    """Deeply; lists are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def nested(env: dict[str, str]) -> dict:
    """VEINSTONE_RETRIEVAL__K=5 as {"retrieval": {"k": 5}}; values are JSON where they can be."""
    out: dict = {}
    for key, value in env.items():
        if not key.startswith(PREFIX) or "__" not in key:
            continue
        at = out
        *path, last = key[len(PREFIX) :].lower().split("__")
        for p in path:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=value lines of a .env file; comments and quotes are dropped."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.is_file() else []
    pairs = (line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def load(profile: str | Path | None = None, overrides: dict | None = None, env_file: str | Path = ".env") -> Settings:
    """Later layers win; an unknown group or name is an error."""
    named = json.loads(Path(profile).read_text(encoding="utf-8")) if profile else {}
    layers = merged(merged(merged(nested(read_env(env_file)), named), nested(dict(os.environ))), overrides or {})
    out = Settings()
    for group, values in layers.items():
        if group not in {f.name for f in fields(Settings)}:
            raise ValueError(f"unknown group of settings: {group}")
        known = {("lambda" if f.name == "lambda_" else f.name): f.name for f in fields(getattr(out, group))}
        unknown = set(values) - set(known)
        if unknown:
            raise ValueError(f"unknown settings in {group}: {sorted(unknown)}")
        out = replace(out, **{group: replace(getattr(out, group), **{known[k]: v for k, v in values.items()})})
    out.ingest.chunking  # checked
    return out
