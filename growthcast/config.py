"""Job parameters: feature roles and time axis."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play a part in forecasting one measure."""

    entity: str
    measure: str
    base: str
    citation: str
    average: str
    delta: str
    age: str


# Role columns per (entity, measure).
PAPER_CITATION = Roles(
    "paper", "citation", "paper_citations", "paper_citations",
    "paper_mean_citations_per_year", "paper_citations_delta_0", "paper_age")
AUTHOR_CITATION = Roles(
    "author", "citation", "author_citations", "author_citations",
    "author_mean_citations_per_year", "author_citations_delta_0", "author_age")
AUTHOR_HINDEX = Roles(
    "author", "hindex", "author_hindex", "author_citations",
    "author_hindex_delta", "author_hindex_delta", "author_age")

ROLES = {(r.entity, r.measure): r for r in (PAPER_CITATION, AUTHOR_CITATION, AUTHOR_HINDEX)}


@dataclass(frozen=True)
class TimeAxis:
    """Dense integer periods; horizon h is period ``source + h``."""

    start: int
    source: int
    target: int
    window: int = 2

    @property
    def horizons(self) -> int:
        return self.target - self.source

    def run_id(self, roles: Roles, filter_id: str) -> str:
        years = f"{self.start}-{self.source}-{self.target}-{self.window}"
        return re.sub(r"[^A-Za-z0-9._-]+", "_", f"{roles.entity}-{roles.measure}-{filter_id}-{years}")


YEARS = TimeAxis(1975, 2005, 2015)
