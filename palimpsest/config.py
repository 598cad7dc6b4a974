"""Settings from the environment; a blank or missing variable leaves the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The usual window, sizes, cuts and floor."""

    version_low: int = 24
    version_high: int = 35
    target_chars: int = 1400
    most_chars: int = 2400
    least_chars: int = 200
    recall_k: int = 50
    final_k: int = 5
    score_floor: float = 0.35
    seed: int = 20260805
    tolerance: float = 0.01

    def __post_init__(self) -> None:
        if self.version_low > self.version_high:
            raise ValueError("the window ends before it begins")

    @property
    def versions(self) -> list[int]:
        return list(range(self.version_low, self.version_high + 1))


def from_environment(prefix: str = "PALIMPSEST_") -> Settings:
    """Settings with the variables <prefix><FIELD>; one that isn't a number is an error that names it."""
    found = {}
    for f in fields(Settings):
        raw = os.environ.get(prefix + f.name.upper(), "").strip()
        if raw:
            try:
                found[f.name] = type(f.default)(raw)
            except ValueError:
                raise ValueError(f"{prefix}{f.name.upper()} is not a number: {raw!r}") from None
    return Settings(**found)
