"""The search request: domains, property filters, numeric ranges and nested references to other entities."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Range:
    """Inclusive bounds; None is open."""

    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class ReferenceFilter:
    """Entities of ``domain`` that the outer entity refers to: by label, own filters and ranges, and on to others."""

    domain: str
    label: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    ranges: dict[str, Range] = field(default_factory=dict)
    references: tuple[ReferenceFilter, ...] = ()


@dataclass(frozen=True)
class SearchSlots:
    domains: tuple[str, ...] = ()
    filters: dict[str, Any] = field(default_factory=dict)
    ranges: dict[str, Range] = field(default_factory=dict)
    references: tuple[ReferenceFilter, ...] = ()


MAX_REFERENCE_DEPTH = 6


def _ranges(raw: dict | None) -> dict[str, Range]:
    return {k: v if isinstance(v, Range) else Range(v.get("min"), v.get("max")) for k, v in (raw or {}).items()}


def _references(raw: Any, depth: int = 1) -> tuple[ReferenceFilter, ...]:
    """A lone reference is a list of one; entries without a domain are dropped; nesting has a limit."""
    if raw is None:
        return ()
    if depth > MAX_REFERENCE_DEPTH:
        raise ValueError(f"references nest deeper than {MAX_REFERENCE_DEPTH}")
    items = [raw] if isinstance(raw, dict) else list(raw)
    return tuple(
        ReferenceFilter(r["domain"], r.get("label"), dict(r.get("filters") or {}), _ranges(r.get("ranges")), _references(r.get("references"), depth + 1)) for r in items if r.get("domain")
    )


def parse_slots(raw: dict | str) -> SearchSlots:
    """Slots from JSON or a dict, with defaults for what is missing."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    domains = raw.get("domains") or []
    return SearchSlots(tuple([domains] if isinstance(domains, str) else domains), dict(raw.get("filters") or {}), _ranges(raw.get("ranges")), _references(raw.get("references")))


def wanted_values(value: Any) -> list[str]:
    """A filter's values; empty strings and lists put no condition."""
    items = value if isinstance(value, (list, tuple)) else [value]
    return [str(v) for v in items if v is not None and str(v).strip() != ""]


def _plain(slots: SearchSlots | ReferenceFilter) -> dict:
    out: dict[str, Any] = {"filters": {k: sorted(set(wanted_values(v))) for k, v in sorted(slots.filters.items()) if wanted_values(v)}}
    out["ranges"] = {k: {n: b for n, b in (("min", r.min), ("max", r.max)) if b is not None} for k, r in sorted(slots.ranges.items())}
    out["references"] = sorted((_plain(r) for r in slots.references), key=lambda r: json.dumps(r, sort_keys=True))
    if isinstance(slots, SearchSlots):
        out["domains"] = sorted(set(slots.domains))
    else:
        out |= {"domain": slots.domain} | ({"label": slots.label} if slots.label else {})
    return out


def canonical(slots: SearchSlots) -> str:
    """One text for all spellings of a request: keys, values and references sorted."""
    return json.dumps(_plain(slots), sort_keys=True, separators=(",", ":"))


def field_strings(slots: SearchSlots) -> list[str]:
    """The request as a set of flat facts, for scoring one request against another."""
    out: list[str] = []

    def walk(node: dict, prefix: str) -> None:
        out.extend(f"{prefix}domain={d}" for d in node.get("domains", []))
        for key, values in node["filters"].items():
            out.extend(f"{prefix}filter:{key}={v}" for v in values)
        for key, bounds in node["ranges"].items():
            out.extend(f"{prefix}range:{key}.{n}={b}" for n, b in bounds.items())
        for ref in node["references"]:
            at = f"{prefix}ref:{ref['domain']}/"
            out.append(at)
            if "label" in ref:
                out.append(f"{at}label={ref['label']}")
            walk(ref, at)

    walk(_plain(slots), "")
    return out
