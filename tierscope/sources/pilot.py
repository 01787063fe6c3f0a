"""A pilot's settings: defaults, and what is wrong with given ones."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from ..schema import RETAILERS


@dataclass(frozen=True)
class Thresholds:
    multi_tier_share: float = 0.2
    probe_difference_rate: float = 0.1
    min_resolved_cells: int = 20
    min_probe_checks: int = 50


@dataclass(frozen=True)
class Pilot:
    metro: str
    retailer: str
    recruiting_source: str
    panel_target: tuple[int, int]
    api_base_url: str
    zip3s: tuple[str, ...] = ()
    start_date: str | None = None
    weeks: int = 2
    sku_count: int = 200
    counsel_reviewed: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)

    def errors(self) -> list[str]:
        """What is wrong, as 'name: message'; empty where nothing is."""
        day, whole = re.compile(r"\d{4}-\d{2}-\d{2}"), lambda v: isinstance(v, int) and not isinstance(v, bool)
        t = self.thresholds
        checks = {
            "metro": (bool(self.metro), "is empty"), "recruiting_source": (bool(self.recruiting_source), "is empty"),
            "retailer": (self.retailer in RETAILERS, "is not one of " + ", ".join(RETAILERS)),
            "zip3s": (all(re.fullmatch(r"\d{3}", z) for z in self.zip3s), "are three digits each"),
            "start_date": (self.start_date is None or bool(day.fullmatch(self.start_date)), "is not a day"),
            "counsel_reviewed": (self.counsel_reviewed is None or bool(day.fullmatch(self.counsel_reviewed)), "is not a day"),
            "weeks": (whole(self.weeks) and 1 <= self.weeks <= 8, "is not 1 to 8"), "sku_count": (whole(self.sku_count) and self.sku_count > 0, "is not above zero"),
            "panel_target": (len(self.panel_target) == 2 and all(whole(n) and n > 0 for n in self.panel_target), "is not two numbers above zero"),
            "api_base_url": (bool(re.match(r"https?://[^/\s]+", self.api_base_url)), "is not a URL"),
            "thresholds": (0 <= t.multi_tier_share <= 1 and 0 <= t.probe_difference_rate <= 1 and t.min_resolved_cells > 0 and t.min_probe_checks > 0, "are out of range"),
        }
        return [f"{name}: {message}" for name, (good, message) in checks.items() if not good]


def pilot(given: dict) -> Pilot:
    """Settings with defaults for what isn't given; an error names all that is wrong."""
    names = {f.name for f in fields(Pilot)}
    unknown, missing = sorted(set(given) - names), [n for n in ("metro", "retailer", "recruiting_source", "panel_target", "api_base_url") if n not in given]
    if unknown or missing:
        raise ValueError("; ".join([f"{n}: unknown" for n in unknown] + [f"{n}: missing" for n in missing]))
    made = Pilot(**{**given, "thresholds": Thresholds(**given.get("thresholds", {})), "zip3s": tuple(given.get("zip3s", ())), "panel_target": tuple(given["panel_target"])})
    if wrong := made.errors():
        raise ValueError("; ".join(wrong))
    return made
