"""What a search or selection is asked for, checked before any job runs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import UTC, datetime

from cairnrank.operators.screening import CoarseRule


def strict_json(text: str) -> object:
    """A JSON value; repeated keys and numbers that aren't finite are errors."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len(found := dict(pairs)) < len(pairs):
            raise ValueError("a JSON object repeats a key")
        return found

    def no(name: str) -> None:
        raise ValueError(f"{name} is no finite JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=no)


def utc_now() -> str:
    """The time in UTC as ISO 8601 text."""
    return datetime.now(UTC).isoformat()


@dataclass(frozen=True)
class SearchProfile:
    """A tolerance in distance and the number of pairs that must match."""

    name: str
    tolerance: float
    pairs: int

    def __post_init__(self) -> None:
        if not self.name or not self.tolerance >= 0 or self.pairs < 1:
            raise ValueError("a profile needs a name, a tolerance of 0 or more and a pair or more")


@dataclass(frozen=True)
class Selection:
    """Which anchors a pose must meet (all or any of them in one pose), from what score on, and how many molecules stay."""

    anchors: tuple[str, ...]
    mode: str
    least: float
    most: int | None = None
    coarse: CoarseRule | None = None

    def __post_init__(self) -> None:
        if not self.anchors or len(set(self.anchors)) != len(self.anchors) or any(not isinstance(a, str) or not a for a in self.anchors):
            raise ValueError("anchors must be names, one or more, each once")
        if self.mode not in ("all", "any"):
            raise ValueError("the mode is all or any")
        if isinstance(self.least, bool) or not isinstance(self.least, (int, float)) or not math.isfinite(self.least) or not 0 < self.least <= 1:
            raise ValueError("the least score must be in (0, 1]")
        if self.most is not None and (isinstance(self.most, bool) or not isinstance(self.most, int) or self.most < 1):
            raise ValueError("the most molecules must be a whole number of 1 or more")

    def normal(self) -> Selection:
        """The selection as what was computed for it depends on it: anchors in order, no limit."""
        return Selection(tuple(sorted(self.anchors)), self.mode, self.least, None, self.coarse)
