"""Typed metadata filters over JSON metadata, compiled to one Spark expression."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = frozenset("eq ne gt gte lt lte in nin contains".split())


class InvalidFilter(ValueError):
    pass


def validate(spec: Any) -> None:
    """An object with non-empty keys, whose conditions are values or objects of known operators."""
    if not isinstance(spec, Mapping):
        raise InvalidFilter("a filter is a mapping of metadata keys")
    for key, cond in spec.items():
        if not isinstance(key, str) or not key.strip():
            raise InvalidFilter("a filter's keys are non-empty strings")
        if isinstance(cond, Mapping) and (unknown := set(cond) - OPERATORS):
            raise InvalidFilter(f"unknown operators for {key}: {sorted(unknown)}")


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


class _Key:
    """One key of the metadata: its variant value, and the type it is stored with."""

    def __init__(self, meta: Column, key: str):
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" if not key.isidentifier() else f"$.{key}"
        self.value = F.try_variant_get(meta, path, "variant")
        self.type = F.schema_of_variant(self.value)
        self.is_number = self.type.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        self.number = F.when(self.is_number, F.try_variant_get(meta, path, "double"))
        self.string = F.when(self.type == "STRING", F.try_variant_get(meta, path, "string"))
        self.boolean = F.when(self.type == "BOOLEAN", F.try_variant_get(meta, path, "boolean"))

    def equals(self, x: Any) -> Column:
        """Strict: of one type and value. Never null."""
        if x is None:
            hit = self.type == "VOID"
        elif isinstance(x, bool):
            hit = self.boolean == x
        elif _is_number(x):
            hit = self.number == float(x)
        elif isinstance(x, str):
            hit = self.string == x
        else:  # a list or object is never the stored one
            hit = F.lit(False)
        return F.coalesce(hit, F.lit(False))

    def within(self, xs: Any) -> Column:
        hit = F.lit(False)
        for x in xs:
            hit = hit | self.equals(x)
        return hit

    def compare(self, op: str, x: Any) -> Column:
        if not _is_number(x):
            return F.lit(False)
        n = self.number
        return F.coalesce({"gt": n > x, "gte": n >= x, "lt": n < x, "lte": n <= x}[op], F.lit(False))

    def meets(self, op: str, x: Any) -> Column:
        if op == "eq":
            return self.equals(x)
        if op == "ne":
            return ~self.equals(x)
        if op == "in":
            return self.within(x) if isinstance(x, (list, tuple)) else F.lit(False)
        if op == "nin":
            return ~self.within(x) if isinstance(x, (list, tuple)) else F.lit(True)
        if op == "contains":
            return F.coalesce(F.contains(F.lower(self.string), F.lit(x.lower())), F.lit(False)) if isinstance(x, str) else F.lit(False)
        return self.compare(op, x)


def metadata_filter(metadata: Column, spec: Mapping[str, Any] | None) -> Column:
    """Whether JSON metadata meets all conditions. An empty filter meets all; null or broken metadata meets no other,
    even ``ne`` and ``nin``, which a missing key meets."""
    if not spec:
        return F.lit(True)
    validate(spec)
    meta = F.try_parse_json(metadata)
    out = meta.isNotNull()
    for name, cond in spec.items():
        key = _Key(meta, name)
        if isinstance(cond, Mapping):
            for op, x in cond.items():
                out = out & key.meets(op, x)
        else:
            out = out & key.equals(cond)
    return out
