"""From slots to a plan, from the plan to a DataFrame.

Rules on the plan: unknown keys and empty values put no condition and are reported as gaps; leaves that share a prefix
of their paths share its joins; a reference without conditions still asks for the referred entity; union arms
without a condition are left out where other arms have one. What is left is Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.catalog import Catalog, Domain, Hop, Interval, Property, normalize_domain
from facetgraph.slots import Range, ReferenceFilter, SearchSlots, wanted_values

DEFAULT_LIMIT, MOST_ROWS = 100, 500


@dataclass(frozen=True)
class Leaf:
    """A condition or output on the column at the end of a path."""

    key: str
    path: tuple[Hop, ...]
    column: str
    kind: str
    values: tuple[str, ...] = ()
    range: Range | None = None
    high: str | None = None


@dataclass(frozen=True)
class RefJoin:
    domain: Domain
    path: tuple[Hop, ...]
    label: str | None
    leaves: tuple[Leaf, ...]
    references: tuple[RefJoin, ...]


@dataclass(frozen=True)
class Arm:
    """One domain's scan with its conditions."""

    domain: Domain
    leaves: tuple[Leaf, ...]
    references: tuple[RefJoin, ...] = ()


@dataclass(frozen=True)
class SearchPlan:
    arms: tuple[Arm, ...]
    gaps: tuple[str, ...] = ()
    dropped_references: tuple[str, ...] = ()
    steps: tuple[str, ...] = field(default=())


def _leaf(domain: Domain, key: str, values: tuple[str, ...] = (), bounds: Range | None = None) -> Leaf | None:
    found: Property | Interval | None = domain.interval(key) or domain.property(key)
    if isinstance(found, Interval):
        return Leaf(key, found.path, found.low, "interval", values, bounds, found.high)
    return Leaf(key, found.path, found.column, found.kind, values, bounds) if found else None


def _leaves(domain: Domain, filters: dict, ranges: dict[str, Range]) -> tuple[Leaf, ...]:
    made = [_leaf(domain, k, tuple(wanted_values(v))) for k, v in filters.items() if wanted_values(v)]
    made += [_leaf(domain, k, (), r) for k, r in ranges.items() if r.min is not None or r.max is not None]
    return tuple(x for x in made if x)


def _references(catalog: Catalog, source: Domain, references: tuple[ReferenceFilter, ...], dropped: list[str]) -> tuple[RefJoin, ...]:
    out = []
    for r in references:
        name = normalize_domain(r.domain)
        way = catalog.reference(source.name, name) if name in catalog.domains else None
        if way is None:
            dropped.append(f"{source.name}->{name}")
            continue
        target = catalog.domains[name]
        out.append(RefJoin(target, way.path, r.label, _leaves(target, catalog.expand(r.filters), r.ranges), _references(catalog, target, r.references, dropped)))
    return tuple(out)


def primary_domain(catalog: Catalog, domains: list[Domain]) -> Domain:
    """The first domain that refers to another selected one, else the first."""
    names = {d.name for d in domains}
    return next((d for d in domains if names & set(catalog.parents.get(d.name, ())) - {d.name}), domains[0])


def plan_search(slots: SearchSlots, catalog: Catalog) -> SearchPlan:
    """Single domain, hierarchy (domains of which one refers to the others), peers (union) or all domains."""
    filters = catalog.expand(slots.filters)
    keys = [*filters, *slots.ranges]
    gaps = tuple(sorted({k for k in keys if not catalog.knows_property(k)}))
    domains, dropped = catalog.known(slots.domains), []
    if not domains:
        # no domain: every domain that has all keys of the filters; ranges and references aren't looked at
        wanted = [k for k, v in filters.items() if wanted_values(v) and k not in gaps]
        arms = [Arm(d, _leaves(d, filters, {})) for d in catalog.domains.values() if all(_leaf(d, k) for k in wanted)]
        return SearchPlan(tuple(arms), gaps)
    primary = primary_domain(catalog, domains)
    others = [d for d in domains if d is not primary]
    if all(catalog.reference(primary.name, d.name) for d in others):
        own = {k for k in keys if _leaf(primary, k)}
        mine = _leaves(primary, {k: v for k, v in filters.items() if k in own or not others}, {k: r for k, r in slots.ranges.items() if k in own or not others})
        asked = list(slots.references)
        named = {normalize_domain(r.domain) for r in asked}
        for d in others:  # a selected domain without conditions isn't joined
            rest = {k: v for k, v in filters.items() if k not in own and _leaf(d, k)}
            spans = {k: r for k, r in slots.ranges.items() if k not in own and _leaf(d, k)}
            if (rest or spans) and d.name not in named:
                asked.append(ReferenceFilter(d.name, None, rest, spans))
        joins = _references(catalog, primary, tuple(asked), dropped)
        return SearchPlan((Arm(primary, mine, joins),), gaps, tuple(dropped))
    arms = [Arm(d, _leaves(d, filters, slots.ranges)) for d in domains]
    if any(a.leaves for a in arms):
        arms = [a for a in arms if a.leaves]
    return SearchPlan(tuple(arms), gaps, tuple(f"{d.name}->{normalize_domain(r.domain)}" for d in domains for r in slots.references))


def condition(leaf: Leaf, column: Column, high: Column | None = None, numeric_column: bool = False) -> Column | None:
    """Literal leaves match exactly and as strings, so a number never equals a string; text leaves without case."""
    tests: list[Column] = []
    if leaf.values:
        if leaf.kind == "text":
            low = [v.lower() for v in leaf.values]
            tests.append(F.contains(F.lower(column), F.lit(low[0])) if len(low) == 1 else F.lower(column).isin(low))
        elif leaf.kind in ("numeric", "interval") or numeric_column:
            tests.append(F.lit(False))
        else:
            tests.append(column == leaf.values[0] if len(leaf.values) == 1 else column.isin(*leaf.values))
    if leaf.range:
        low_end = column.try_cast("double")
        high_end = high.try_cast("double") if high is not None else low_end
        if leaf.range.min is not None:
            tests.append(high_end >= float(leaf.range.min))
        if leaf.range.max is not None:
            tests.append(low_end <= float(leaf.range.max))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


class Lowering:
    """Builds the DataFrame of a plan over named tables."""

    def __init__(self, tables):
        self.table = tables
        self.serial = 0

    def scan(self, table: str) -> tuple[DataFrame, str]:
        self.serial += 1
        name = f"t{self.serial}"
        return self.table(table).alias(name), name

    def follow(self, df: DataFrame, at: str, path: tuple[Hop, ...], reached: dict[tuple, str], prefix: tuple) -> tuple[DataFrame, str]:
        """Joins along a path; hops taken before are shared."""
        for i, hop in enumerate(path):
            key = (*prefix, *path[: i + 1])
            if key not in reached:
                right, name = self.scan(hop.table)
                df = df.join(right, F.col(f"{at}.{hop.left}") == F.col(f"{name}.{hop.right}"))
                reached[key] = name
            at = reached[key]
        return df, at

    def leaves(self, df: DataFrame, at: str, leaves: tuple[Leaf, ...], out: list[Column], tag: str = "") -> DataFrame:
        reached: dict[tuple, str] = {}
        shown = set()
        for leaf in leaves:
            df, where = self.follow(df, at, leaf.path, reached, ())
            column = F.col(f"{where}.{leaf.column}")
            high = F.col(f"{where}.{leaf.high}") if leaf.high else None
            test = condition(leaf, column, high)
            df = df.where(test) if test is not None else df
            if leaf.key not in shown:
                shown.add(leaf.key)
                out.append(column.alias(f"{tag}{leaf.key}"))
        return df

    def references(self, df: DataFrame, at: str, joins: tuple[RefJoin, ...], out: list[Column], suffix: str = "") -> DataFrame:
        for i, ref in enumerate(joins):
            name = f"{suffix}{i or ''}" if not suffix else f"{suffix}_{i}"
            df, where = self.follow(df, at, ref.path, {}, ())
            out += [F.col(f"{where}.{ref.domain.key}").alias(f"refAsset{name}"), F.col(f"{where}.{ref.domain.label}").cast("string").alias(f"refName{name}")]
            if ref.label:
                df = df.where(F.contains(F.lower(F.col(f"{where}.{ref.domain.label}").cast("string")), F.lit(ref.label.lower())))
            df = self.leaves(df, where, ref.leaves, out, f"ref{name}_")
            df = self.references(df, where, ref.references, out, name or "_0")
        return df

    def arm(self, arm: Arm) -> DataFrame:
        df, at = self.scan(arm.domain.table)
        label = F.col(f"{at}.{arm.domain.label}")
        out = [F.col(f"{at}.{arm.domain.key}").alias("asset"), label.cast("string").alias("name")]
        df = self.leaves(df.where(label.isNotNull()), at, arm.leaves, out)
        return self.references(df, at, arm.references, out).select(*out)


def lower(plan: SearchPlan, tables, limit: int | None = None) -> DataFrame:
    """The rows of a plan: bags, as joins make them. ``limit`` counts assets, least first, and caps rows at MOST_ROWS."""
    parts = [Lowering(tables).arm(a).withColumn("domain", F.lit(a.domain.name)) for a in plan.arms]
    if not parts:
        raise ValueError("no known domain holds the request")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out if len(parts) > 1 else out.drop("domain")
    return distinct_asset_limit(out, limit) if limit else out


def distinct_asset_limit(rows: DataFrame, limit: int = DEFAULT_LIMIT, most: int | None = MOST_ROWS) -> DataFrame:
    """All rows of the first ``limit`` assets in order, then at most ``most`` rows, in a total order."""
    firsts = rows.select("asset").distinct().orderBy("asset").limit(limit)
    kept = rows.join(F.broadcast(firsts), "asset", "left_semi")
    return kept if most is None else kept.orderBy(*kept.columns).limit(most)


def count_assets(plan: SearchPlan, tables) -> DataFrame:
    """domain, n: distinct assets of each arm in one pass over each; domains without any are left out."""
    parts = [Lowering(tables).arm(replace(a)).select(F.lit(a.domain.name).alias("domain"), "asset") for a in plan.arms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("domain").agg(F.countDistinct("asset").alias("n")).where("n > 0")
