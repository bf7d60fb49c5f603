"""The search service: refine a request, run it, count, facets and lineage; results are remembered by canonical request."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from facetgraph.catalog import Catalog
from facetgraph.operators.aggregates import distribution, facets
from facetgraph.plans.search import SearchPlan, count_assets, lower, plan_search
from facetgraph.slots import SearchSlots, canonical, parse_slots


class ResultCache:
    """Least recently used entries go first; entries end after their time; cleared when data change."""

    def __init__(self, entries: int = 256, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str, make: Callable[[], object]) -> object:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.held.move_to_end(key)
            return self.held[key][1]
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)
        return value

    def clear(self) -> None:
        self.held.clear()


class TokenBucket:
    """So many calls at once and so many a second, for each caller."""

    def __init__(self, burst: int, rate: float, callers: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.burst, self.rate, self.callers, self.clock = burst, rate, callers, clock
        self.left: OrderedDict[str, tuple[float, float]] = OrderedDict()

    def allow(self, caller: str) -> bool:
        now = self.clock()
        tokens, then = self.left.pop(caller, (float(self.burst), now))
        tokens = min(self.burst, tokens + (now - then) * self.rate)
        self.left[caller] = (tokens - 1 if tokens >= 1 else tokens, now)
        while len(self.left) > self.callers:
            self.left.popitem(last=False)
        return tokens >= 1


@dataclass
class SearchResult:
    rows: DataFrame
    counts: DataFrame
    plan: SearchPlan


class SearchService:
    """tables: name -> DataFrame. Rows are lazy; a remembered result is its plan, not its data."""

    def __init__(self, spark: SparkSession, catalog: Catalog, tables: Callable[[str], DataFrame], limit: int | None = 100):
        self.spark, self.catalog, self.tables, self.limit = spark, catalog, tables, limit
        self.cache = ResultCache()

    def refine(self, request: SearchSlots | dict | str) -> SearchResult:
        slots = request if isinstance(request, SearchSlots) else parse_slots(request)

        def make() -> SearchResult:
            plan = plan_search(slots, self.catalog)
            return SearchResult(lower(plan, self.tables, self.limit), count_assets(plan, self.tables), plan)

        return self.cache.get(canonical(slots), make)

    def run_in_group(self, name: str, action: Callable[[], object]) -> object:
        """An action whose Spark jobs cancel(name) stops."""
        self.spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        return action()

    def cancel(self, name: str) -> None:
        self.spark.sparkContext.cancelJobGroup(name)

    def domain_statistics(self, domain: str) -> DataFrame:
        d = self.catalog.domains[domain]
        columns = list(dict.fromkeys(p.column for p in d.properties if not p.path))
        return distribution(facets(self.tables(d.table), d.key, columns))
