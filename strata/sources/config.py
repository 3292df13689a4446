"""Settings in a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Matching:
    ngram_size: int = 5
    overlap: float = 0.1
    similarity: float = 0.7
    prefer_signature_target: bool = True
    #: Most targets of a source in the approximate form; all without.
    top_k: int | None = None


@dataclass
class Levels:
    high: float = 90.0
    low: float = 70.0


@dataclass
class Config:
    matching: Matching = field(default_factory=Matching)
    levels: Levels = field(default_factory=Levels)

    @classmethod
    def load(cls, path: str | Path | None = None) -> Config:
        """From `path`, else from ~/.config/strata/config.json, else from ./strata.json, else the defaults. A named file must exist; unknown names are errors."""
        places = [Path(path)] if path is not None else [p for p in (Path.home() / ".config/strata/config.json", Path("strata.json")) if p.exists()]
        if not places:
            return cls()
        data = json.loads(places[0].read_text(encoding="utf-8"))
        if unknown := {*data} - {"matching", "levels"}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(Matching(**data.get("matching", {})), Levels(**data.get("levels", {})))

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
