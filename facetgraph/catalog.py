"""What is known of the data: domains, their properties by path, references and concept hierarchies. All is data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Hop:
    """A join to ``table``: rows whose ``right`` equals the current table's ``left``."""

    left: str
    table: str
    right: str


@dataclass(frozen=True)
class Property:
    """A leaf of a domain: the column at the end of a path. kind: literal, numeric, text (matched by containment)."""

    name: str
    column: str
    path: tuple[Hop, ...] = ()
    kind: str = "literal"


@dataclass(frozen=True)
class Interval:
    """A property whose value is the span between two columns."""

    name: str
    low: str
    high: str
    path: tuple[Hop, ...] = ()


@dataclass(frozen=True)
class Reference:
    """Entities of a domain refer to those of ``target`` along ``path``, whose last hop reaches the target's table."""

    target: str
    path: tuple[Hop, ...]


@dataclass(frozen=True)
class Domain:
    name: str
    table: str
    key: str
    label: str
    properties: tuple[Property, ...] = ()
    intervals: tuple[Interval, ...] = ()
    references: tuple[Reference, ...] = ()
    namespace: str = ""

    def property(self, name: str) -> Property | None:
        return next((p for p in self.properties if p.name == name), None)

    def interval(self, name: str) -> Interval | None:
        return next((p for p in self.intervals if p.name == name), None)


def normalize_domain(name: str) -> str:
    """Camel case, blanks and underscores to kebab case."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name.strip())
    return re.sub(r"[\s_]+", "-", spaced).lower()


@dataclass(frozen=True)
class Catalog:
    domains: dict[str, Domain]
    concepts: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)  # property -> key -> leaf values
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict)  # domain -> domains it refers to, in order

    def known(self, names: tuple[str, ...]) -> list[Domain]:
        """The named domains that exist, each once, in order."""
        found = dict.fromkeys(normalize_domain(n) for n in names)
        return [self.domains[n] for n in found if n in self.domains]

    def knows_property(self, key: str) -> bool:
        return any(d.property(key) or d.interval(key) for d in self.domains.values())

    def correct_domains(self, domains: tuple[str, ...], keys: list[str]) -> tuple[str, ...]:
        """The domains, and those of keys that none of them has; keys of no domain change nothing."""
        chosen, needed = set(domains), []
        for key in keys:
            having = [d.name for d in self.domains.values() if d.property(key) or d.interval(key)]
            if having and not chosen & set(having):
                needed += having
        return tuple(dict.fromkeys([*domains, *needed]))

    def expand(self, filters: dict) -> dict:
        """Concepts in filters replaced by the values below them; a list stays a list, unknown values stay."""
        out = {}
        for key, value in filters.items():
            index = self.concepts.get(key, {})
            values = value if isinstance(value, (list, tuple)) else [value]
            new = [leaf for v in values for leaf in index.get(str(v).lower(), (v,))]
            new = list(dict.fromkeys(new))
            out[key] = new if isinstance(value, (list, tuple)) or len(new) > 1 else new[0]
        return out

    def reference(self, source: str, target: str) -> Reference | None:
        return next((r for r in self.domains[source].references if r.target == target), None)


def lifted_catalog() -> Catalog:
    """The test tables as domains: a table is a domain, a column a property, a foreign key a reference."""
    nation = lambda column: Hop(column, "nation", "n_nationkey")
    region = Hop("n_regionkey", "region", "r_regionkey")

    def places(column: str) -> tuple[Property, ...]:
        return (Property("nation", "n_name", (nation(column),)), Property("region", "r_name", (nation(column), region)))

    domains = [
        Domain("region", "region", "r_regionkey", "r_name", (Property("regionName", "r_name"),)),
        Domain("nation", "nation", "n_nationkey", "n_name", (Property("nationName", "n_name"), Property("region", "r_name", (region,))), references=(Reference("region", (region,)),)),
        Domain(
            "customer",
            "customer",
            "c_custkey",
            "c_name",
            (Property("mktsegment", "c_mktsegment"), Property("acctbal", "c_acctbal", kind="numeric"), *places("c_nationkey")),
            references=(Reference("nation", (nation("c_nationkey"),)),),
        ),
        Domain("supplier", "supplier", "s_suppkey", "s_name", (Property("acctbal", "s_acctbal", kind="numeric"), *places("s_nationkey")), references=(Reference("nation", (nation("s_nationkey"),)),)),
        Domain(
            "part",
            "part",
            "p_partkey",
            "p_name",
            (Property("partName", "p_name", kind="text"), Property("brand", "p_brand"), Property("type", "p_type"), Property("size", "p_size", kind="numeric"), Property("retailprice", "p_retailprice", kind="numeric")),
        ),
        Domain(
            "orders",
            "orders",
            "o_orderkey",
            "o_orderkey",
            (Property("orderstatus", "o_orderstatus"), Property("orderpriority", "o_orderpriority"), Property("totalprice", "o_totalprice", kind="numeric")),
            references=(Reference("customer", (Hop("o_custkey", "customer", "c_custkey"),)),),
        ),
        Domain(
            "lineitem",
            "lineitem",
            "l_orderkey",
            "l_orderkey",
            (Property("returnflag", "l_returnflag"), Property("linestatus", "l_linestatus"), Property("quantity", "l_quantity", kind="numeric"), Property("discount", "l_discount", kind="numeric")),
            references=(Reference("orders", (Hop("l_orderkey", "orders", "o_orderkey"),)), Reference("part", (Hop("l_partkey", "part", "p_partkey"),)), Reference("supplier", (Hop("l_suppkey", "supplier", "s_suppkey"),))),
        ),
        Domain("event", "events", "event_id", "event_type", (Property("eventType", "event_type"), Property("value", "value", kind="numeric"), Property("props", "props", kind="text"))),
        Domain("page", "pages", "page_id", "url", (Property("url", "url", kind="text"),)),
        Domain("document", "documents", "doc_id", "source", (Property("lang", "lang"), Property("source", "source"), Property("chars", "n_chars", kind="numeric"))),
    ]
    by_name = {d.name: d for d in domains}
    return Catalog(by_name, parents={d.name: tuple(r.target for r in d.references) for d in domains})
