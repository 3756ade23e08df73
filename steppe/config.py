"""Typed configuration: periods, splits, targets, and the rules they must obey."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

import yaml


def month_index(day: date) -> int:
    return day.year * 12 + day.month - 1


def add_months(day: date, months: int) -> date:
    index = month_index(day) + months
    return date(index // 12, index % 12 + 1, 1)


@dataclass(frozen=True)
class Period:
    """Months from ``start`` to ``end``, both included."""

    start: date
    end: date

    @classmethod
    def years(cls, first: int, last: int) -> Period:
        return cls(date(first, 1, 1), date(last, 12, 1))

    @property
    def months(self) -> int:
        return month_index(self.end) - month_index(self.start) + 1

    def overlaps(self, other: Period) -> bool:
        return self.start <= other.end and other.start <= self.end

    def gap_to(self, later: Period) -> int:
        """Whole months between the end of this period and the start of a later one."""
        return month_index(later.start) - month_index(self.end) - 1


@dataclass(frozen=True)
class Target:
    """What is forecast: a column, its lead, and a threshold if it is a class."""

    name: str
    lead_months: int
    kind: str = "regression"
    threshold: float | None = None

    @property
    def accumulation(self) -> int:
        return accumulation_months(self.name)


@dataclass(frozen=True)
class Config:
    fit: Period
    splits: dict[str, Period]
    targets: tuple[Target, ...] = ()
    reference: dict[str, str] = field(default_factory=dict)
    gap_months: int = 3
    min_rows_per_date: int = 10
    min_samples: int = 5


def accumulation_months(target: str) -> int:
    """Months that an index accumulates: the number at the end of its name, else 1."""
    found = re.fullmatch(r"sp(?:e)?i_(\d+)", target)
    return int(found[1]) if found else 1


def parse_years(text: str | None, first: int, last: int) -> list[int]:
    """``"1981-1990"``, ``"1990"`` or nothing (the whole range) as a list of years."""
    if not text:
        return list(range(first, last + 1))
    low, _, high = text.partition("-")
    return list(range(int(low), int(high or low) + 1))


def expected_split_rows(n_cells: int, period: Period) -> int:
    return n_cells * period.months


def violations(config: Config) -> list[str]:
    """Rules that the configuration breaks; an empty list if none."""
    found = []
    held_out = {k: p for k, p in config.splits.items() if k != "train"}
    for name, period in held_out.items():
        if config.fit.overlaps(period):
            found.append(f"fit period overlaps {name}")
    ordered = sorted(config.splits.items(), key=lambda x: x[1].start)
    for (a, one), (b, two) in zip(ordered, ordered[1:], strict=False):
        if one.overlaps(two):
            found.append(f"{a} overlaps {b}")
        elif one.gap_to(two) < config.gap_months:
            found.append(f"gap between {a} and {b} is under {config.gap_months} months")
    for t in config.targets:
        if t.accumulation > config.gap_months:
            found.append(f"{t.name} accumulates more months than the gap")
        if t.lead_months > config.gap_months:
            found.append(f"{t.name} reaches across the gap")
        if t.accumulation - t.lead_months > 0:
            found.append(f"{t.name}: {t.accumulation - t.lead_months} months of the target are known at issue")
        if t.kind == "classification" and t.threshold is None:
            found.append(f"{t.name} needs a threshold")
    return found


def load_config(path: str) -> Config:
    with open(path) as f:
        raw = yaml.safe_load(f)

    def period(x) -> Period:
        return Period(date.fromisoformat(str(x["start"])), date.fromisoformat(str(x["end"])))

    return Config(
        fit=period(raw["fit"]),
        splits={k: period(v) for k, v in raw["splits"].items()},
        targets=tuple(Target(**t) for t in raw.get("targets", [])),
        reference=raw.get("reference", {}),
        gap_months=raw.get("gap_months", 3),
        min_rows_per_date=raw.get("min_rows_per_date", 10),
        min_samples=raw.get("min_samples", 5),
    )
