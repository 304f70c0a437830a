"""Shapes of the tables, and what may stand in them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Field types, tiers, statuses, interpretations and failures.
FIELD_TYPES = ("string", "number", "currency", "date", "boolean", "enum", "string_list")
TIERS = ("high", "medium", "low", "conflict", "verified")
VALUE_STATUSES = ("model", "human_verified", "not_present")
INTERPRETATIONS = ("exact", "normalised", "inferred", "failed")
GROUNDING_FAILURES = ("no_quote", "quote_not_found", "page_out_of_range", "no_text_layer")
# Names that a field key may not take.
RESERVED_KEYS = ("record_id", "document_id", "document_name", "created_at", "updated_at", "select", "from", "where", "group", "order", "table", "user", "default", "null", "true", "false")
# Weight of a field by its type.
WEIGHTS = {"currency": 2.0, "date": 1.5, "number": 1.3, "string": 1.0, "enum": 1.0, "boolean": 0.8, "string_list": 0.8}
#: Types in the order in which they win a tie.
SPECIFICITY = ("currency", "date", "number", "boolean", "enum", "string_list", "string")

#: One slot per stored form; currency uses n and ccy, a date also keeps its ISO text in s.
VALUE = "struct<s:string,n:double,ccy:string,d:date,b:boolean,l:array<string>>"
BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
FIELD_VALUES = f"workspace_id string, record_id string, field_key string, value_type string, v {VALUE}, confidence double, tier string, status string"
RECORDS = "workspace_id string, record_id string, document_id string"

_KEY = re.compile(r"[a-z][a-z0-9_]{0,46}")


def is_field_key(key: str) -> bool:
    return bool(_KEY.fullmatch(key)) and key not in RESERVED_KEYS


@dataclass(frozen=True)
class FieldSpec:
    """A column of the inferred schema. aliases: raw keys and labels that mean it too."""

    key: str
    label: str
    type: str
    description: str = ""
    enum_values: tuple[str, ...] | None = None
    currency_default: str | None = None
    aliases: tuple[str, ...] = field(default=())
    weight: float = 0.0

    def __post_init__(self) -> None:
        if not is_field_key(self.key):
            raise ValueError(f"not a usable field key: {self.key!r}")
        if self.type not in FIELD_TYPES:
            raise ValueError(f"unknown field type: {self.type!r}")
        if self.type == "enum" and not self.enum_values:
            object.__setattr__(self, "type", "string")  # an enum without values is text
        if self.currency_default is not None and self.type != "currency":
            raise ValueError("only a currency field has a default currency")
        if not self.weight:
            object.__setattr__(self, "weight", WEIGHTS[self.type])

    def names(self) -> tuple[str, ...]:
        return (self.key, *self.aliases)
