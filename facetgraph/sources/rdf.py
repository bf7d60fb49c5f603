"""Quads from Turtle and JSON-LD, written by hand since no RDF library is at hand; and their writers.

quads: g, s, s_kind, p, o, o_kind, o_dt, o_lang. Kinds are uri, bnode and literal. Plain strings have no datatype.
Files are read whole by Spark, one task a file, and parsed in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUADS = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<type>\^\^)
    |(?P<mark>[;,.\[\]()])
    |(?P<bnode>_:[\w\-]+(?:\.[\w\-]+)*)
    |(?P<name>(?:[^\W\d_][\w\-.]*)?:(?:(?:[\w\-:%]|\\.)(?:[\w\-.:%]|\\.)*)?|[A-Za-z]+)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)


class RdfError(ValueError):
    pass


def unescape(text: str) -> str:
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), text)


class TurtleReader:
    """Triples of a Turtle text: prefixes, base, predicate and object lists, nested nodes, collections, literals."""

    def __init__(self, text: str, scope: str = ""):
        self.tokens = self._scan(text)
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.scope, self.serial = scope, 0
        self.out: list[tuple] = []

    @staticmethod
    def _scan(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RdfError(f"can't read {text[at : at + 30]!r}")
            value = m[0]
            if m.lastgroup == "name" and value.endswith("."):  # a dot ends the sentence, not the name
                value = value.rstrip(".")
            if m.lastgroup != "skip":
                out.append((m.lastgroup, value))
            at += len(value)
        return out

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token[1] != mark or token[0] == "end":
            raise RdfError(f"{token[1]!r} where {mark or 'more'!r} was due")
        self.at += 1
        return token

    def blank(self) -> tuple:
        self.serial += 1
        return (f"_:{self.scope}b{self.serial}", "bnode", None, None)

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", iri) or not self.base else self.base + iri

    def expand(self, name: str) -> str:
        prefix, _, rest = name.partition(":")
        if prefix not in self.prefixes:
            raise RdfError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            word = value.lower().lstrip("@")
            if kind in ("lang", "name") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    name = self.take()[1].rstrip(":")
                    self.prefixes[name] = self.resolve(unescape(self.take()[1][1:-1]))
                else:
                    self.base = unescape(self.take()[1][1:-1])
                if value.startswith("@"):
                    self.take(".")
                continue
            nested = self.peek()[1] == "["
            subject = self.term()
            if not (nested and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.out

    def properties(self, subject: tuple) -> None:
        while True:
            predicate = RDF + "type" if self.peek() == ("name", "a") else None
            if predicate:
                self.take()
            else:
                predicate = self.term()[0]
            while True:
                self.out.append((subject[0], subject[1], predicate, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]"):
                return

    def term(self) -> tuple:
        """value, kind, datatype, language."""
        kind, value = self.take()
        if kind == "iri":
            return (self.resolve(unescape(value[1:-1])), "uri", None, None)
        if kind == "bnode":
            return (f"_:{self.scope}{value[2:]}", "bnode", None, None)
        if value == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            node: tuple = (RDF + "nil", "uri", None, None)
            for item in reversed(items):
                cell = self.blank()
                self.out += [(cell[0], "bnode", RDF + "first", *item), (cell[0], "bnode", RDF + "rest", *node)]
                node = cell
            return node
        if kind in ("text", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "lang":
                return (text, "literal", RDF + "langString", self.take()[1][1:].lower())
            if self.peek()[0] == "type":
                self.take()
                datatype = self.term()[0]
                return (text, "literal", None if datatype == XSD + "string" else datatype, None)
            return (text, "literal", None, None)
        if kind == "number":
            return (value, "literal", XSD + ("double" if re.search("[eE]", value) else "decimal" if "." in value else "integer"), None)
        if kind == "name" and value in ("true", "false"):
            return (value, "literal", XSD + "boolean", None)
        if kind == "name" and ":" in value:
            return (self.expand(value), "uri", None, None)
        raise RdfError(f"unexpected {value!r}")


class JsonLdReader:
    """Triples of JSON-LD: @context (inline, or found in ``contexts`` by URL), @id, @type, @value, @language, @graph, @list."""

    def __init__(self, scope: str = "", contexts: dict[str, dict] | None = None):
        self.scope, self.serial, self.out = scope, 0, []
        self.contexts = {k.rstrip("/"): v for k, v in (contexts or {}).items()}

    def read(self, text: str) -> list[tuple]:
        self.node(json.loads(text), {"@terms": {}})
        return self.out

    def context(self, raw, active: dict) -> dict:
        for c in raw if isinstance(raw, list) else [raw]:
            if isinstance(c, str):
                known = self.contexts.get(c.rstrip("/"))
                if known is None:
                    raise RdfError(f"no local copy of context {c}")
                active = self.context(known.get("@context", known), active)
            elif isinstance(c, dict):
                active = {**active, "@terms": dict(active["@terms"])}
                for k, v in c.items():
                    if k in ("@vocab", "@base", "@language"):
                        active[k] = v
                    elif not k.startswith("@"):
                        active["@terms"][k] = v if isinstance(v, dict) else {"@id": v}
        return active

    def iri(self, name: str, ctx: dict, vocab: bool, depth: int = 0) -> str:
        if name.startswith(("_:", "@")):
            return f"_:{self.scope}{name[2:]}" if name.startswith("_:") else name
        term = ctx["@terms"].get(name) if vocab else None
        if term and term.get("@id") and depth < 8:
            return self.iri(term["@id"], ctx, term["@id"] != name, depth + 1)
        prefix, colon, rest = name.partition(":")
        if colon and not rest.startswith("//") and prefix in ctx["@terms"]:
            return self.iri(prefix, ctx, True, depth + 1) + rest
        if colon:
            return name
        return (ctx.get("@vocab", "") if vocab else ctx.get("@base", "")) + name

    def node(self, raw, ctx: dict) -> tuple | None:
        if isinstance(raw, list):
            for item in raw:
                self.node(item, ctx)
            return None
        if "@context" in raw:
            ctx = self.context(raw["@context"], ctx)
        if "@graph" in raw:
            self.node(raw["@graph"], ctx)
            if set(raw) <= {"@context", "@graph"}:
                return None
        name = next((raw[k] for k in raw if k == "@id" or ctx["@terms"].get(k, {}).get("@id") == "@id"), None)
        if name is None:
            self.serial += 1
            name = f"_:j{self.serial}"
        subject = self.iri(name, ctx, False)
        kind = "bnode" if subject.startswith("_:") else "uri"
        for key, value in raw.items():
            prop = self.iri(key, ctx, True)
            if prop == "@type":
                for t in value if isinstance(value, list) else [value]:
                    self.out.append((subject, kind, RDF + "type", self.iri(t, ctx, True), "uri", None, None))
            elif not prop.startswith("@") and ":" in prop:
                term = ctx["@terms"].get(key, {})
                for v in value if isinstance(value, list) else [value]:
                    for o in self.value(v, term, ctx):
                        self.out.append((subject, kind, prop, *o))
        return (subject, kind, None, None)

    def value(self, v, term: dict, ctx: dict) -> Iterator[tuple]:
        if v is None:
            return
        if isinstance(v, dict):
            if "@value" in v:
                yield self.literal(v["@value"], v.get("@type"), v.get("@language"), ctx)
            elif "@list" in v:
                node: tuple = (RDF + "nil", "uri", None, None)
                for item in reversed(v["@list"]):
                    self.serial += 1
                    cell = f"_:{self.scope}l{self.serial}"
                    for o in self.value(item, term, ctx):
                        self.out += [(cell, "bnode", RDF + "first", *o), (cell, "bnode", RDF + "rest", *node)]
                    node = (cell, "bnode", None, None)
                yield node
            else:
                inner = self.context(term["@context"], ctx) if "@context" in term else ctx
                yield self.node(v, inner)
        elif term.get("@type") in ("@id", "@vocab") and isinstance(v, str):
            iri = self.iri(v, ctx, term["@type"] == "@vocab")
            yield (iri, "bnode" if iri.startswith("_:") else "uri", None, None)
        else:
            yield self.literal(v, term.get("@type"), term.get("@language", ctx.get("@language")), ctx)

    def literal(self, v, datatype: str | None, lang: str | None, ctx: dict) -> tuple:
        if isinstance(v, bool):
            text, own = str(v).lower(), XSD + "boolean"
        elif isinstance(v, int):
            text, own = str(v), XSD + "integer"
        elif isinstance(v, float):
            text, own = repr(v), XSD + "double"
        else:
            text, own = str(v), None
        if datatype:
            own = self.iri(datatype, ctx, True)
        if own is None and lang:
            return (text, "literal", RDF + "langString", lang.lower())
        return (text, "literal", None if own == XSD + "string" else own, None)


def _parse_files(parse: Callable[[str, str], list[tuple]], graph: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scope = re.sub(r"\W", "", path)[-24:] + "."
                try:
                    rows = parse(text, scope)
                except (RdfError, ValueError, KeyError):
                    rows = []  # a bad file is left out; see read_problems
                columns = list(zip(*rows, strict=True)) or [()] * 7
                arrays = [pa.array([graph] * len(rows), pa.string()), *[pa.array(c, pa.string()) for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"])

    return run


def _turtle(text: str, scope: str) -> list[tuple]:
    return TurtleReader(text, scope).parse()


def read_turtle(spark: SparkSession, paths: str | list[str], graph: str | None = None) -> DataFrame:
    """Distinct quads of Turtle files in one graph (null: the default graph). Unreadable files give none."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(_parse_files(_turtle, graph), QUADS).dropDuplicates()


def read_jsonld(spark: SparkSession, paths: str | list[str], graph: str | None = None, contexts: dict[str, dict] | None = None) -> DataFrame:
    """Distinct quads of JSON-LD files; ``contexts`` holds local copies of remote contexts by URL."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(_parse_files(lambda text, scope: JsonLdReader(scope, contexts).read(text), graph), QUADS).dropDuplicates()


def read_problems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, problem of the Turtle files that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    TurtleReader(text).parse()
                except RdfError as e:
                    out.append((path, str(e)))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "problem"])

    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, "path string, problem string")


def quads_of(spark: SparkSession, text: str, graph: str | None = None, jsonld: bool = False) -> DataFrame:
    """Quads of one text held on the driver, for schemas and fixtures."""
    rows = JsonLdReader().read(text) if jsonld else _turtle(text, "")
    return spark.createDataFrame([(graph, *r) for r in dict.fromkeys(rows)], QUADS)


class SourceError(ValueError):
    """Sources that hold nothing to load."""


def discover(spark: SparkSession, roots: list[str], pattern: str = "*.ttl", domains: set[str] | None = None) -> DataFrame:
    """root, domain (the folder's name), path, bytes of the files below the roots, in the allowed domains if any are named."""
    out = None
    for root in roots:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
        rows = files.select(F.lit(root).alias("root"), F.element_at(F.split("path", "/"), -2).alias("domain"), "path", F.col("length").alias("bytes"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise SourceError("no folder of sources is named")
    return out.where(F.col("domain").isin(*sorted(domains))) if domains else out


def load_schema(spark: SparkSession, roots: list[str], graph: str = "urn:graph:schema", domains: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Quads of all readable Turtle files below the roots, and root, files, broken of each root.

    Files that can't be read are left out and counted; if no file gives a triple, or a root has no file, SourceError says so.
    """
    files = discover(spark, roots, domains=domains).select("root", "path").collect()  # names of files alone
    paths = [r["path"] for r in files]
    empty = [r for r in roots if not any(f["root"] == r for f in files)]
    if empty:
        raise SourceError(f"no Turtle files below {', '.join(empty)}")
    broken = read_problems(spark, paths).select(F.col("path").alias("bad"), "problem")
    quads = read_turtle(spark, paths, graph)
    if quads.isEmpty():
        raise SourceError(f"none of {len(paths)} schema files could be loaded")
    listed = spark.createDataFrame([(f["root"], f["path"]) for f in files], "root string, path string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    counts = listed.join(broken, plain(F.col("path")) == plain(F.col("bad")), "left").groupBy("root").agg(F.count("*").alias("files"), F.count("problem").alias("broken"))
    return quads, counts


def load_instances(spark: SparkSession, turtle: list[str], jsonld: list[str], contexts: dict[str, dict] | None = None) -> DataFrame:
    """JSON-LD where there is any, else Turtle: a package's two forms are one set of data."""
    return read_jsonld(spark, jsonld, None, contexts) if jsonld else read_turtle(spark, turtle)


def apply_update(quads: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """A new snapshot: without the deleted quads, with the inserted ones, as a set."""
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in quads.columns]
    out = quads
    if deletes is not None:
        out = out.alias("a").join(deletes.alias("b"), same("a", "b"), "left_anti")
    return (out.unionByName(inserts) if inserts is not None else out).dropDuplicates()


def turtle_term(value: str, kind: str, datatype: str, lang: str) -> object:
    """A term in Turtle, as a Column of four columns' names."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    tagged = F.when(F.col(lang).isNotNull(), F.concat(quoted, F.lit("@"), F.col(lang))).when(F.col(datatype).isNotNull(), F.concat(quoted, F.lit("^^<"), F.col(datatype), F.lit(">"))).otherwise(quoted)
    return F.when(F.col(kind) == "uri", F.concat(F.lit("<"), F.col(value), F.lit(">"))).when(F.col(kind) == "bnode", F.col(value)).otherwise(tagged)


def turtle_fragments(quads: DataFrame) -> DataFrame:
    """s, fragment: each subject's triples as sorted Turtle lines."""
    line = F.concat_ws(" ", F.when(F.col("s_kind") == "uri", F.concat(F.lit("<"), F.col("s"), F.lit(">"))).otherwise(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), turtle_term("o", "o_kind", "o_dt", "o_lang"), F.lit("."))
    return quads.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("fragment"))
