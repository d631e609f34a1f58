"""Settings of candidate search and decisions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from weftlink.functions.keys import STANDARD, KeyRules


@dataclass(frozen=True)
class Settings:
    """The defaults are those of the candidate generator on its own."""

    max_candidates: int = 25
    min_score: float = 35.0
    #: A key with more targets than ``cap`` is cut by ``cap_mode``: its first ``cap_take`` ("first"), its first ``cap`` ("truncate"), or none ("skip").
    cap: int = 500
    cap_take: int = 100
    cap_mode: str = "first"
    threshold: float = 0.70
    strategy: str = "standard"
    keys: KeyRules = STANDARD

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


DEFAULT = Settings()
TRAIN = Settings(max_candidates=20, min_score=30.0, cap=300)
PREDICT = Settings(max_candidates=15, min_score=35.0, cap=300)
