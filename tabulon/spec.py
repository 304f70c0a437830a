"""The query language: one measure, one optional group, filters that must all hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "missing", "present")
AGGREGATES = ("sum", "count", "avg", "min", "max")
BUCKETS = ("month", "quarter", "year")
SORTS = ("value_desc", "value_asc", "label_asc")
KINDS = ("metric", "bar", "line", "table")


class SpecError(ValueError):
    """A query that can't be asked."""


def _one_of(value: str | None, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise SpecError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        _one_of(self.op, OPERATORS, "op")
        if self.op not in ("missing", "present") and self.value is None:
            raise SpecError(f"{self.op} needs a value")


@dataclass(frozen=True)
class DataQuery:
    """count without a measure counts records; any other aggregate needs one."""

    aggregate: str = "count"
    measure_field: str | None = None
    group_by: str | None = None
    date_bucket: str | None = None
    filters: tuple[Filter, ...] = field(default=())
    sort: str = "value_desc"
    limit: int = 20

    def __post_init__(self) -> None:
        _one_of(self.aggregate, AGGREGATES, "aggregate")
        _one_of(self.sort, SORTS, "sort")
        if self.date_bucket is not None:
            _one_of(self.date_bucket, BUCKETS, "date_bucket")
        if self.aggregate != "count" and not self.measure_field:
            raise SpecError(f"{self.aggregate} needs a measure")
        if len(self.filters) > 8:
            raise SpecError("at most 8 filters")
        if not 1 <= self.limit <= 50:
            raise SpecError("limit is from 1 to 50")

    @classmethod
    def of(cls, raw: dict[str, Any]) -> DataQuery:
        known = {k: v for k, v in raw.items() if k != "filters"}
        return cls(**known, filters=tuple(Filter(**f) for f in raw.get("filters", ())))


@dataclass(frozen=True)
class Visual:
    kind: str
    title: str
    query: DataQuery
    unit_hint: str | None = None

    def __post_init__(self) -> None:
        _one_of(self.kind, KINDS, "kind")
        if self.kind == "line" and not self.query.date_bucket:
            raise SpecError("a line needs a date bucket")
        if self.kind == "metric" and self.query.group_by:
            raise SpecError("a metric has no groups")


def shown_kind(kind: str, rows: int) -> str:
    """What a result of so many rows is shown as."""
    if rows <= 1:
        return "metric" if kind != "table" else "table"
    if kind == "metric":
        return "bar"
    return "table" if kind == "bar" and rows > 30 else kind
