"""Run parameters and their bounds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

BOUNDS = {
    "steps": (2, 8),
    "min_persist": (0, 8),
    "optical_threshold": (0.05, 2),
    "sar_threshold_db": (0.5, 30),
    "sieve": (0, 100_000),
    "max_cloud": (0, 100),
    "top_k": (1, 200),
}
MAX_PIXELS = 9_000_000


@dataclass(frozen=True)
class Params:
    start: str = "2023-01-01"
    end: str = "2024-12-31"
    steps: int = 4
    min_persist: int = 1
    optical_threshold: float = 0.20
    sar_threshold_db: float = 3.0
    sieve: int = 50
    max_cloud: float = 80.0
    top_k: int = 12
    index: str = "ndvi"
    pol: str = "vv"
    match_orbit: bool = False
    resolution: float = 10.0

    def __post_init__(self) -> None:
        # A threshold of 0 means the default, as callers leave fields empty; a sieve of 0 means none.
        for name, default in (("optical_threshold", 0.20), ("sar_threshold_db", 3.0)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}, got {getattr(self, name)}")
        if self.index not in ("ndvi", "ndwi", "ndbi"):
            raise ValueError(f"unknown index {self.index!r}")
        if self.pol not in ("vv", "vh"):
            raise ValueError(f"unknown polarization {self.pol!r}")
        span = (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days
        if span <= 0 or span < self.steps:
            raise ValueError("the dates leave no room for the steps")

    @property
    def pixel_area_m2(self) -> float:
        return self.resolution**2


def check_grid(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise ValueError("the area is smaller than a pixel")
    if width * height > MAX_PIXELS:
        raise ValueError(f"the area has {width * height:,} pixels; at most {MAX_PIXELS:,} are allowed")
