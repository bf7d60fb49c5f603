"""Queries as DataFrames over quads.

A variable v is two columns: v, its value, and v__t, its kind with datatype and language ("u", "b" or "l|datatype|lang"),
so equal values of different terms differ. Unbound is null in both. Patterns are bags, closures sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.functions.sparql import FUNCTIONS, regex
from facetgraph.operators.graph import closure
from facetgraph.sparql.parser import AGGREGATES, Bind, Call, Filter, Graph, Group, Minus, Optional, Path, Query, SparqlError, Term, Triple, Union, Values, Var, parse

NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")
XSD = "http://www.w3.org/2001/XMLSchema#"


def tag_of(term: Term) -> str:
    return {"uri": "u", "bnode": "b"}.get(term.kind) or f"l|{term.datatype or ''}|{term.lang or ''}"


def _tags(quads: DataFrame) -> DataFrame:
    literal = F.concat(F.lit("l|"), F.coalesce("o_dt", F.lit("")), F.lit("|"), F.coalesce("o_lang", F.lit("")))
    kind = F.when(F.col("o_kind") == "uri", "u").when(F.col("o_kind") == "bnode", "b").otherwise(literal)
    return quads.select("g", "s", F.when(F.col("s_kind") == "uri", "u").otherwise("b").alias("s__t"), "p", "o", kind.alias("o__t"))


class Executor:
    def __init__(self, quads: DataFrame):
        self.quads, self.spark = _tags(quads), quads.sparkSession
        self.scope: Column | None = None

    def facts(self) -> DataFrame:
        """Triples of the graph in scope; of all graphs, as a set, if none is."""
        rows = self.quads if self.scope is None else self.quads.where(self.scope)
        return rows.drop("g").distinct()

    # patterns

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("__unit"))

    def join(self, left: DataFrame, right: DataFrame, how: str = "inner", test: Column | None = None) -> DataFrame:
        """Natural join on the shared variables' values and kinds; an unbound variable agrees with anything."""
        shared = [c for c in left.columns if c in right.columns and c != "__unit" and not c.endswith("__t")]
        right = right.drop("__unit")
        renamed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c.removesuffix("__t") in shared else F.col(f"`{c}`") for c in right.columns])
        on = F.lit(True)
        for c in shared:
            same = (F.col(c) == F.col(f"__r_{c}")) & (F.col(f"{c}__t") == F.col(f"__r_{c}__t"))
            nullable = c in self.maybe
            on = on & ((same | F.col(c).isNull() | F.col(f"__r_{c}").isNull()) if nullable else same)
        if test is not None:
            on = on & test
        if how == "left_anti":
            # a row is taken away only by one that has a variable bound with it
            bound = F.lit(False)
            for c in shared:
                bound = bound | (F.col(c).isNotNull() & F.col(f"__r_{c}").isNotNull())
            return left.join(renamed, on & bound, "left_anti") if shared else left
        out = left.join(renamed, on, how) if shared or test is not None or how != "inner" else left.crossJoin(renamed)
        for c in shared:
            for name in (c, f"{c}__t"):
                out = out.withColumn(name, F.coalesce(name, f"__r_{name}")) if c in self.maybe else out
                out = out.drop(f"__r_{name}")
        return out

    def link(self, path: Path) -> DataFrame:
        """s, s__t, o, o__t of a path."""
        if path.op == "link":
            return self.facts().where(F.col("p") == path.iri).select("s", "s__t", "o", "o__t")
        if path.op == "inv":
            inner = self.link(path.parts[0])
            return inner.select(F.col("o").alias("s"), F.col("o__t").alias("s__t"), F.col("s").alias("o"), F.col("s__t").alias("o__t"))
        if path.op == "alt":
            out = self.link(path.parts[0])
            for p in path.parts[1:]:
                out = out.unionByName(self.link(p))
            return out
        if path.op == "seq":
            out = self.link(path.parts[0])
            for p in path.parts[1:]:
                step = self.link(p).select(F.col("s").alias("m"), F.col("s__t").alias("m__t"), F.col("o").alias("n"), F.col("o__t").alias("n__t"))
                out = out.join(step, (F.col("o") == F.col("m")) & (F.col("o__t") == F.col("m__t"))).select("s", "s__t", F.col("n").alias("o"), F.col("n__t").alias("o__t"))
            return out
        inner = self.link(path.parts[0])
        nodes = self.facts()
        ends = nodes.select(F.struct(F.col("s").alias("v"), F.col("s__t").alias("t")).alias("n")).unionByName(nodes.select(F.struct(F.col("o").alias("v"), F.col("o__t").alias("t")).alias("n"))).distinct()
        edges = inner.select(F.struct(F.col("s").alias("v"), F.col("s__t").alias("t")).alias("src"), F.struct(F.col("o").alias("v"), F.col("o__t").alias("t")).alias("dst"))
        if path.op == "opt":
            pairs = edges.unionByName(ends.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct()
        else:
            pairs = closure(edges, reflexive=path.op == "star", nodes=ends)
        return pairs.select(F.col("src.v").alias("s"), F.col("src.t").alias("s__t"), F.col("dst.v").alias("o"), F.col("dst.t").alias("o__t"))

    def triple(self, t: Triple) -> DataFrame:
        if isinstance(t.p, Var):
            rows = self.facts().withColumn("p__t", F.lit("u"))
            slots = (("s", t.s), ("p", t.p), ("o", t.o))
        else:
            rows, slots = self.link(t.p), (("s", t.s), ("o", t.o))
        out: dict[str, Column] = {}
        for column, node in slots:
            if isinstance(node, Term):
                rows = rows.where((F.col(column) == node.value) & (F.col(f"{column}__t") == tag_of(node)))
            elif node.name in out:
                rows = rows.where((F.col(column) == out[node.name]) & (F.col(f"{column}__t") == out[f"{node.name}__t"]))
            else:
                out |= {node.name: F.col(column), f"{node.name}__t": F.col(f"{column}__t")}
        return rows.select(*[c.alias(n) for n, c in out.items()]) if out else rows.select(F.lit(1).alias("__unit"))

    def group(self, group: Group, start: DataFrame | None = None) -> DataFrame:
        rows = start if start is not None else self.unit()
        filters = []
        for part in group.parts:
            if isinstance(part, Filter):
                filters.append(part.test)
            elif isinstance(part, Triple):
                rows = self.join(rows, self.triple(part))
            elif isinstance(part, Optional):
                inner = Group(tuple(p for p in part.group.parts if not isinstance(p, Filter)))
                right = self.group(inner)
                tests = [p.test for p in part.group.parts if isinstance(p, Filter)]
                self.maybe |= {c for c in right.columns if c not in rows.columns}
                rows = self.optional(rows, right, tests)
            elif isinstance(part, Union):
                arms = [self.group(g) for g in part.groups]
                names = [set(a.columns) - {"__unit"} for a in arms]
                self.maybe |= {c for n in names for c in n if any(c not in m for m in names)}
                both = arms[0]
                for a in arms[1:]:
                    both = both.unionByName(a, allowMissingColumns=True)
                rows = self.join(rows, both)
            elif isinstance(part, Minus):
                rows = self.join(rows, self.group(part.group), "left_anti")
            elif isinstance(part, Bind):
                rows = rows.withColumns(dict(zip((part.var, f"{part.var}__t"), self.term(part.value, rows), strict=True)))
            elif isinstance(part, Values):
                rows = self.join(rows, self.values(part))
            elif isinstance(part, Graph):
                if isinstance(part.name, Var):
                    raise SparqlError("a graph is named by its IRI here")
                before, self.scope = self.scope, F.col("g") == part.name.value
                rows = self.join(rows, self.group(part.group))
                self.scope = before
            elif isinstance(part, Group):
                rows = self.join(rows, self.group(part))
            elif isinstance(part, Query):
                rows = self.join(rows, self.solve(part))
            else:
                raise SparqlError(f"{type(part).__name__} isn't executed")
        for test in filters:
            rows = self.filter(rows, test)
        return rows

    def optional(self, rows: DataFrame, right: DataFrame, tests: list) -> DataFrame:
        both, on = set(rows.columns) | set(right.columns), None
        for t in tests:
            test = F.coalesce(self.truth(t, both), F.lit(False))
            on = test if on is None else on & test
        return self.join(rows, right, "left", on)

    def filter(self, rows: DataFrame, test) -> DataFrame:
        if isinstance(test, Call) and test.name in ("EXISTS", "NOT EXISTS"):
            plain = Group(tuple(p for p in test.group.parts if not isinstance(p, Filter)))
            inner = self.group(plain)
            outer = [c for c in rows.columns if c in inner.columns and not c.endswith("__t") and c != "__unit"]
            tests = [p.test for p in test.group.parts if isinstance(p, Filter)]
            renamed = inner.select(*[F.col(c).alias(f"__x_{c}") if c.removesuffix("__t") in outer or c == "__unit" else F.col(c) for c in inner.columns])
            on = F.lit(True)
            for c in outer:
                on = on & (F.col(c) == F.col(f"__x_{c}")) & (F.col(f"{c}__t") == F.col(f"__x_{c}__t"))
            both = set(rows.columns) | set(renamed.columns)
            for t in tests:
                on = on & F.coalesce(self.truth(t, both), F.lit(False))
            return rows.join(renamed, on, "left_semi" if test.name == "EXISTS" else "left_anti")
        if isinstance(test, Call) and test.name == "&&":
            return self.filter(self.filter(rows, test.args[0]), test.args[1])
        return rows.where(F.coalesce(self.truth(test, rows), F.lit(False)))

    def values(self, v: Values) -> DataFrame:
        names = [n for x in v.vars for n in (x, f"{x}__t")]
        self.maybe |= {x for i, x in enumerate(v.vars) if any(r[i] is None for r in v.rows)}
        rows = [[y for t in r for y in ((t.value, tag_of(t)) if t else (None, None))] for r in v.rows]
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    # expressions

    def term(self, e, rows) -> tuple[Column, Column]:
        """Value and tag of an expression."""
        columns = rows if isinstance(rows, set) else set(rows.columns)
        if isinstance(e, Term):
            return F.lit(e.value), F.lit(tag_of(e))
        if isinstance(e, Var):
            if e.name not in columns:
                return F.lit(None).cast("string"), F.lit(None).cast("string")
            return F.col(e.name), F.col(f"{e.name}__t")
        name = e.name
        if name in ("IF", "COALESCE"):
            parts = [self.term(a, rows) for a in (e.args[1:] if name == "IF" else e.args)]
            if name == "IF":
                test = self.truth(e.args[0], rows)
                return tuple(F.when(test, a).otherwise(b) for a, b in zip(*parts, strict=True))
            return F.coalesce(*[p[0] for p in parts]), F.coalesce(*[p[1] for p in parts])
        if name in ("+", "-", "*", "/"):
            a, b = (self.number(x, rows) for x in e.args)
            out = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[name]
            return out.cast("string"), F.lit(f"l|{XSD}double|")
        if name.startswith(XSD):
            return self.cast(name, self.term(e.args[0], rows)[0])
        if name == "DATATYPE":
            tag = self.term(e.args[0], rows)[1]
            kind = F.split_part(tag, F.lit("|"), F.lit(2))
            return F.when(tag.startswith("l"), F.when(kind == "", XSD + "string").otherwise(kind)), F.lit("u")
        if name == "LANG":
            return F.split_part(self.term(e.args[0], rows)[1], F.lit("|"), F.lit(3)), F.lit("l||")
        if name in ("STRDT", "STRLANG"):
            value, extra = self.term(e.args[0], rows)[0], self.term(e.args[1], rows)[0]
            return value, F.concat(F.lit("l|"), extra, F.lit("|")) if name == "STRDT" else F.concat(F.lit("l||"), F.lower(extra))
        if name in ("IRI", "URI"):
            return self.term(e.args[0], rows)[0], F.lit("u")
        if name == "REPLACE":
            value, tag = self.term(e.args[0], rows)
            return F.regexp_replace(value, self.term(e.args[1], rows)[0], self.term(e.args[2], rows)[0]), self.spoken(tag)
        if self.is_test(e):
            return self.truth(e, rows).cast("string"), F.lit(f"l|{XSD}boolean|")
        if name not in FUNCTIONS:
            raise SparqlError(f"{name} isn't known")
        least, most, make = FUNCTIONS[name]
        if len(e.args) < least or most is not None and len(e.args) > most:
            raise SparqlError(f"{name} takes another number of arguments")
        parts = [self.term(a, rows) for a in e.args]
        made = make(*[p[0] for p in parts]).cast("string")
        if name in ("ABS", "ROUND", "CEIL", "FLOOR"):  # numbers keep their type
            whole = parts[0][1] == f"l|{XSD}integer|"
            return F.when(whole, made.try_cast("decimal(38,0)").cast("string")).otherwise(made), F.when(self.numeric(parts[0][1]), parts[0][1])
        if name in ("UCASE", "LCASE", "SUBSTR", "STRBEFORE", "STRAFTER"):  # texts keep their language
            return made, self.spoken(parts[0][1])
        if name == "BNODE":
            return made, F.lit("b")
        kind = {"RAND": "double", "TIMEZONE": "dayTimeDuration", "SECONDS": "decimal"}.get(name)
        kind = kind or ("integer" if name in ("STRLEN", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES") else None)
        return made, F.lit(f"l|{XSD}{kind}|" if kind else "l||")

    def cast(self, name: str, value: Column) -> tuple[Column, Column]:
        kind = {"integer": "bigint", "decimal": "decimal(38,18)", "float": "float", "double": "double", "boolean": "boolean", "dateTime": "timestamp"}.get(name.removeprefix(XSD), "string")
        return (value if kind == "string" else value.try_cast(kind).cast("string")), F.lit("l||" if kind == "string" else f"l|{name}|")

    def number(self, e, rows) -> Column:
        return self.term(e, rows)[0].try_cast("double")

    def is_test(self, e) -> bool:
        return isinstance(e, Call) and (e.name in ("=", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "IN", "REGEX", "BOUND", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "SAMETERM", "LANGMATCHES", "CONTAINS", "STRSTARTS", "STRENDS"))

    def numeric(self, tag: Column) -> Column:
        return tag.isin(*[f"l|{XSD}{t}|" for t in NUMERIC])

    def spoken(self, tag: Column) -> Column:
        """The tag of a text made from one of this tag: with its language, if it has one."""
        return F.when(F.split_part(tag, F.lit("|"), F.lit(3)) != "", tag).otherwise("l||")

    def equal(self, a, b) -> Column:
        """Numbers by value, other terms by value, datatype and language."""
        (x, s), (y, t) = a, b
        return F.when(self.numeric(s) & self.numeric(t), x.try_cast("double") == y.try_cast("double")).otherwise((x == y) & (s == t))

    def truth(self, e, rows) -> Column:
        if not isinstance(e, Call):
            value, tag = self.term(e, rows)
            return F.when(tag == f"l|{XSD}boolean|", value == "true").when(self.numeric(tag), value.try_cast("double") != 0).otherwise(value != "")
        name = e.name
        if name in ("&&", "||"):
            a, b = (self.truth(x, rows) for x in e.args)
            return a & b if name == "&&" else a | b
        if name == "!":
            return ~self.truth(e.args[0], rows)
        if name in ("=", "!=", "IN"):
            first = self.term(e.args[0], rows)
            out = F.lit(False)
            for x in e.args[1:]:
                out = out | self.equal(first, self.term(x, rows))
            return ~out if name == "!=" else out
        if name in ("<", ">", "<=", ">="):
            (x, s), (y, t) = (self.term(a, rows) for a in e.args)
            p, q = x.try_cast("double"), y.try_cast("double")
            by = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[name]
            return F.when(self.numeric(s) & self.numeric(t), by(p, q)).when(~self.numeric(s) & ~self.numeric(t), by(x, y))
        args = [self.term(a, rows) for a in e.args]
        if name == "REGEX":
            if not isinstance(e.args[1], Term):
                raise SparqlError("a pattern is a literal here")
            return regex(args[0][0], e.args[1].value, e.args[2].value if len(e.args) > 2 else "")
        if name in ("ISIRI", "ISURI"):
            return args[0][1] == "u"
        if name == "ISBLANK":
            return args[0][1] == "b"
        if name == "ISLITERAL":
            return args[0][1].startswith("l")
        if name == "ISNUMERIC":
            return self.numeric(args[0][1]) & args[0][0].try_cast("double").isNotNull()
        if name == "SAMETERM":
            return args[0][0].eqNullSafe(args[1][0]) & args[0][1].eqNullSafe(args[1][1])
        if name == "BOUND":
            return args[0][0].isNotNull()
        if name in ("LANGMATCHES", "CONTAINS", "STRSTARTS", "STRENDS"):
            return FUNCTIONS[name][2](args[0][0], args[1][0])
        value, tag = self.term(e, rows)
        return F.when(tag == f"l|{XSD}boolean|", value == "true").when(self.numeric(tag), value.try_cast("double") != 0).otherwise(value != "")

    # queries

    def aggregate(self, call: Call, rows: DataFrame) -> tuple[Column, Column | str]:
        """Value and tag; the tag is a column where it depends on the group."""
        if call.name == "COUNT":
            if call.args[0] == "*":
                return F.count("*").cast("string"), f"l|{XSD}integer|"
            value, tag = self.term(call.args[0], rows)
            return (F.countDistinct(value, tag) if call.distinct else F.count(value)).cast("string"), f"l|{XSD}integer|"
        value, tag = self.term(call.args[0], rows)
        number = value.try_cast("double")
        if call.name == "GROUP_CONCAT":
            items = F.collect_set(value) if call.distinct else F.collect_list(value)
            return F.array_join(F.array_sort(items), call.separator), "l||"
        if call.name == "SAMPLE":
            return F.min(value), "l||"
        if call.name in ("SUM", "AVG"):
            whole = F.bool_and(F.coalesce(tag == f"l|{XSD}integer|", F.lit(False)) | value.isNull())
            if call.distinct:  # distinct terms: 1 and 1.0 are two
                terms = F.transform(F.collect_set(F.struct(value.alias("v"), tag.alias("t"))), lambda x: x["v"].try_cast("double"))
                terms = F.filter(terms, lambda x: x.isNotNull())
                total, count = F.aggregate(F.array_sort(terms), F.lit(0.0), lambda a, x: a + x), F.size(terms)
            else:
                total, count = F.coalesce(F.sum(number), F.lit(0.0)), F.count(number)
            if call.name == "AVG":
                return F.coalesce(F.try_divide(total, count), F.lit(0.0)).cast("string"), f"l|{XSD}double|"
            # an exact sum where all are integers
            exact = total.cast("decimal(38,0)") if call.distinct else F.sum(value.try_cast("decimal(38,0)"))
            return F.when(whole, F.coalesce(exact, F.lit(0)).cast("string")).otherwise(total.cast("string")), F.when(whole, f"l|{XSD}integer|").otherwise(f"l|{XSD}double|")
        pick = F.min if call.name == "MIN" else F.max
        all_numbers = F.bool_and(number.isNotNull())
        return F.when(all_numbers, pick(number).cast("string")).otherwise(pick(value)), "l||"

    def solve(self, q: Query) -> DataFrame:
        self.maybe: set[str] = getattr(self, "maybe", set())
        rows = self.group(q.where)
        select = q.select
        if select is None:
            select = tuple((c, Var(c)) for c in rows.columns if not c.endswith("__t") and not c.startswith("__"))
        grouped = q.group_by or any(isinstance(c, Call) and c.name in AGGREGATES for _, e in select for c in [e])
        if grouped:
            keys = {}
            for name, e in q.group_by:
                keys[name], keys[f"{name}__t"] = self.term(e, rows)
            made, tags, having = {}, {}, []
            for name, e in select:
                if isinstance(e, Call) and e.name in AGGREGATES:
                    made[name], tags[name] = self.aggregate(e, rows)
            for i, test in enumerate(q.having):
                having.append(self.lift(test, f"__h{i}", made, tags, rows))
            wanted = {**made, **{f"{n}__t": t for n, t in tags.items() if not isinstance(t, str)}}
            rows = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in wanted.items()] or [F.count("*").alias("__n")])
            fixed = {f"{n}__t": F.lit(t) for n, t in tags.items() if isinstance(t, str)}
            rows = rows.withColumns(fixed) if fixed else rows
            for test in having:
                rows = rows.where(F.coalesce(self.truth(test, rows), F.lit(False)))
            select = tuple((n, Var(n) if isinstance(e, Call) and e.name in AGGREGATES else e) for n, e in select)
        shown = {}
        for name, e in select:
            shown[name], shown[f"{name}__t"] = self.term(e, rows)
        extra = [(self.number(e, rows), self.term(e, rows)[0], down) for e, down in q.order]
        sort = {f"__o{i}{k}": c for i, (n, v, _) in enumerate(extra) for k, c in (("n", n), ("v", v))}
        rows = rows.select(*[c.alias(n) for n, c in {**shown, **sort}.items()])
        if q.distinct:
            rows = rows.dropDuplicates(list(shown))
        if q.limit is not None or q.offset or extra:
            order = [F.col(f"__o{i}{k}").desc() if down else F.col(f"__o{i}{k}").asc() for i, (_, _, down) in enumerate(extra) for k in "nv"]
            rows = rows.orderBy(*order, *shown)  # ties in a total order, so a limit is the same each time
            rows = rows.offset(q.offset) if q.offset else rows
            rows = rows.limit(q.limit) if q.limit is not None else rows
        return rows.select(*shown)

    def lift(self, e, name: str, made: dict, tags: dict, rows: DataFrame):
        """Aggregates inside a HAVING test become columns."""
        if isinstance(e, Call) and e.name in AGGREGATES:
            made[name], tags[name] = self.aggregate(e, rows)
            return Var(name)
        if isinstance(e, Call):
            return Call(e.name, tuple(self.lift(a, f"{name}_{i}", made, tags, rows) for i, a in enumerate(e.args)), e.distinct, e.group, e.separator)
        return e


def run_query(quads: DataFrame, query: str | Query, terms: bool = False) -> DataFrame:
    """The solutions; a column a variable (``terms`` keeps the tags). ASK gives one row, result: true or false."""
    q = parse(query) if isinstance(query, str) else query
    if q.form == "ASK":
        found = Executor(quads).solve(Query("SELECT", (("__any", Term("1", "literal")),), q.where))
        return found.limit(1).agg(F.when(F.count("*") > 0, "true").otherwise("false").alias("result"))
    out = Executor(quads).solve(q)
    return out if terms else out.select(*[c for c in out.columns if not c.endswith("__t")])
