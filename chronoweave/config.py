"""Settings of a pipeline run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Config:
    mass: float = 0.8
    max_tokens: int = 50
    min_support: float = 0.02
    scoring_frac: float = -1.0
    max_items: int = 4
    method: str = "episode"
    min_steps: int = 1
    cap: int = 0
    cap_metric: str = "odds_ratio"
    dedup: float = 0.0
    n_draws: int = 50
    max_keys: int = 200
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    def digest(self, *names: str) -> str:
        """A short key of the named settings, for artefacts that depend on those alone."""
        own = asdict(self)
        return hashlib.md5(json.dumps({n: own[n] for n in sorted(names)}).encode()).hexdigest()[:12]
