"""Search requests with the bounds that the service accepts."""

from __future__ import annotations

from dataclasses import dataclass, field

# Most values of a filter, and most characters of each.
FILTER_BOUNDS = {"workModes": (3, 10), "seniority": (20, 80), "titleFamilies": (20, 120), "skills": (30, 80), "companies": (50, 160), "employmentTypes": (20, 80), "industries": (20, 120)}
#: Facets in output order: request field, column of the job table, values listed.
FACETS = (
    ("workModes", "workMode", 10),
    ("seniority", "seniority", 20),
    ("titleFamilies", "titleFamily", 20),
    ("skills", "skills", 30),
    ("companies", "companyName", 30),
    ("employmentTypes", "employmentType", 20),
    ("industries", "industries", 30),
)
ARRAY_COLUMNS = frozenset({"skills", "employmentType", "industries"})
SORTS = ("relevance", "newest", "salary")


@dataclass(frozen=True)
class SearchRequest:
    """One search; lists are alternatives, and every non-empty list must match."""

    query: str = ""
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    minimum_salary: int | None = None
    include_unknown_salary: bool = True
    posted_within_days: int | None = 30
    sort: str = "relevance"
    page_size: int = 20
    cursor: str | None = None

    def __post_init__(self) -> None:
        known = {f for f, _, _ in FACETS}
        for bad, what in (
            (len(self.query.strip()) > 500, "query is longer than 500"),
            (not set(self.filters) <= known, "unknown filter"),
            ("unknown" in self.filters.get("workModes", ()), "work mode unknown cannot be asked for"),
            (self.minimum_salary is not None and not 0 <= self.minimum_salary <= 10_000_000, "minimum salary"),
            (self.posted_within_days is not None and not 1 <= self.posted_within_days <= 365, "posted within days"),
            (not 1 <= self.page_size <= 50, "page size"),
            (self.sort not in SORTS, "sort"),
            (any(len(v) > FILTER_BOUNDS[k][0] for k, v in self.filters.items() if k in known), "too many values of a filter"),
            (any(not 1 <= len(x) <= FILTER_BOUNDS[k][1] for k, v in self.filters.items() if k in known for x in v), "length of a filter's value"),
            (self.cursor is not None and len(self.cursor) > 4096, "cursor"),
        ):
            if bad:
                raise ValueError(f"invalid search request: {what}")
