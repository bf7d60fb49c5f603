"""Quads of a table: a row an entity, a column a predicate, a foreign key a link. In the spirit of R2RML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph.sources.rdf import RDF, XSD

TYPES = {"bigint": "integer", "int": "integer", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}


def lift(rows: DataFrame, cls: str, key: str, base: str = "urn:t:", links: dict[str, str] | None = None, graph: str | None = None) -> DataFrame:
    """g, s, s_kind, p, o, o_kind, o_dt, o_lang; subjects are <base><cls>:<key>; ``links`` column -> class are IRIs.

    One pass: the cells of a row are one array, exploded; nulls give no quad.
    """
    links = links or {}
    subject = F.concat(F.lit(f"{base}{cls}:"), F.col(key).cast("string"))
    cells = [F.struct(F.lit(RDF + "type").alias("p"), F.lit(f"{base}{cls}").alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))]
    for name, kind in rows.dtypes:
        value = F.col(name).cast("string")
        if name in links:
            value = F.concat(F.lit(f"{base}{links[name]}:"), value)
        datatype = None if name in links or kind not in TYPES else XSD + TYPES[kind]
        cells.append(F.struct(F.lit(f"{base}{name}").alias("p"), value.alias("o"), F.lit("uri" if name in links else "literal").alias("o_kind"), F.lit(datatype).cast("string").alias("o_dt")))
    out = rows.select(subject.alias("s"), F.explode(F.array(*cells)).alias("x")).where("x.o is not null")
    return out.select(F.lit(graph).cast("string").alias("g"), "s", F.lit("uri").alias("s_kind"), "x.p", "x.o", "x.o_kind", "x.o_dt", F.lit(None).cast("string").alias("o_lang"))
