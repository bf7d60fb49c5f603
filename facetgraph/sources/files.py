"""Other sources and sinks: XML (roads, catalogs, checker results), NDJSON samples, CSV and JSON-LD export, events."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.functions.text import csv_safe

ROAD_XML = "road array<struct<_id string, _length double, planView struct<geometry array<struct<_s double, _hdg double, _length double, arc struct<_curvature double>, spiral struct<_curvStart double, _curvEnd double>>>>, link struct<successor struct<_elementType string, _elementId string>>, lanes struct<laneSection array<struct<left struct<lane array<struct<_id int, _type string>>>, right struct<lane array<struct<_id int, _type string>>>>>>>>"
CHECKS_XML = "CheckerBundle array<struct<_name string, Checker array<struct<_checkerId string, Issue array<struct<_issueId string, _description string, _level int>>>>>>"
CATALOG_XML = "uri array<struct<_name string, _uri string>>"
ISSUES = 5_000  # of one text of checker results


def roads(files: DataFrame, xml: str = "value") -> DataFrame:
    """road_id, length, piece, s, hdg, piece_length, curv_start, curv_end, successor of XML road networks.

    Malformed text gives no rows; a road without geometry one row with null pieces.
    """
    parsed = files.select(F.from_xml(xml, ROAD_XML, {"mode": "PERMISSIVE"}).alias("x"))
    road = parsed.select(F.explode("x.road").alias("r"))
    rows = road.select(F.col("r._id").alias("road_id"), F.col("r._length").alias("length"), F.col("r.link.successor._elementId").alias("successor"), F.posexplode_outer("r.planView.geometry").alias("piece", "g"))
    start = F.coalesce("g.spiral._curvStart", "g.arc._curvature", F.lit(0.0))
    end = F.coalesce("g.spiral._curvEnd", "g.arc._curvature", F.lit(0.0))
    return rows.select("road_id", "length", "piece", F.col("g._s").alias("s"), F.col("g._hdg").alias("hdg"), F.col("g._length").alias("piece_length"), start.alias("curv_start"), end.alias("curv_end"), "successor")


def drivable_lanes(files: DataFrame, xml: str = "value") -> DataFrame:
    """road_id, lane_id of lanes of type driving."""
    road = files.select(F.explode(F.from_xml(xml, ROAD_XML, {"mode": "PERMISSIVE"})["road"]).alias("r"))
    sections = road.select(F.col("r._id").alias("road_id"), F.explode("r.lanes.laneSection").alias("s"))
    empty = F.array().cast("array<struct<_id:int,_type:string>>")
    lanes = sections.select("road_id", F.explode(F.concat(F.coalesce("s.left.lane", empty), F.coalesce("s.right.lane", empty))).alias("l"))
    return lanes.where("l._type = 'driving'").select("road_id", F.col("l._id").alias("lane_id")).distinct()


def entry_roads(network: DataFrame) -> DataFrame:
    """road_id of roads that are nobody's successor."""
    return network.select("road_id").distinct().join(network.select(F.col("successor").alias("road_id")).where("road_id is not null").distinct(), "road_id", "left_anti")


def checker_issues(files: DataFrame, xml: str = "value") -> DataFrame:
    """bundle, checker, issue, description, level of checker results; checkers without issues have nulls."""
    bundles = files.select(F.explode(F.from_xml(xml, CHECKS_XML, {"mode": "PERMISSIVE"})["CheckerBundle"]).alias("b"))
    checkers = bundles.select(F.col("b._name").alias("bundle"), F.explode_outer("b.Checker").alias("c"))
    rows = checkers.select("bundle", F.col("c._checkerId").alias("checker"), F.explode_outer("c.Issue").alias("i"))
    return rows.select("bundle", "checker", F.col("i._issueId").alias("issue"), F.col("i._description").alias("description"), F.col("i._level").alias("level"))


def checker_xml(gaps: DataFrame, most: int = ISSUES) -> DataFrame:
    """gate, part, xml: issues (gate, checker, issue, description) of each gate as XML texts of about ``most`` issues.

    Each text is a bundle of the gate's name; side by side under one root they are the gate's whole results. Issues are
    dealt by their hash, copies of one by ``most`` at a time, so no text grows with its gate.
    """
    piece, n = F.col("piece"), F.col("n")
    copies = gaps.groupBy("gate", "checker", "issue", "description").agg(F.count("*").alias("n"))
    copies = copies.select("*", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / most))).alias("piece")).withColumn("n", F.least(F.lit(most), n - piece * most).cast("int"))
    large = gaps.groupBy(F.col("gate").alias("of")).agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.pmod(F.xxhash64("checker", "issue", "description"), parts) + piece, parts)
    dealt = copies.join(F.broadcast(large), F.col("gate").eqNullSafe(F.col("of")), "left").withColumn("part", part).repartition("gate", "part")
    issue = F.struct(F.col("issue").alias("_issueId"), F.col("description").alias("_description"))
    checkers = dealt.groupBy("gate", "part", "checker").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat(issue, n)))).alias("Issue"))
    bundles = checkers.groupBy("gate", "part").agg(F.sort_array(F.collect_list(F.struct(F.col("checker").alias("_checkerId"), "Issue"))).alias("Checker"))
    return bundles.select("gate", "part", F.to_xml(F.struct(F.col("gate").alias("_name"), "Checker"), {"rowTag": "CheckerBundle"}).alias("xml"))


def catalog_entries(files: DataFrame, xml: str = "value") -> DataFrame:
    """name, uri of an XML catalog."""
    return files.select(F.explode(F.from_xml(xml, CATALOG_XML)["uri"]).alias("u")).select(F.col("u._name").alias("name"), F.col("u._uri").alias("uri"))


def resolve_in_catalog(entries: dict[str, str], name: str, root: str) -> str:
    """The path that a catalog gives a name; an unknown name is an error."""
    if name not in entries:
        raise KeyError(f"the catalog has no entry {name}")
    return str(PurePosixPath(root) / entries[name])


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """NDJSON rows of a schema; a line that isn't of it stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def bad_sample_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line, text of the lines that are no rows of the schema."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.where("text <> ''").where(F.from_json("text", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})["__bad"].isNotNull()).withColumn("line", F.col("line") + 1)


def append_samples(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str, hidden: str = r"^(ref_step|_refSlot|step_)") -> None:
    """All cells quoted, formulas defused, trace columns left out."""
    shown = [c for c in rows.columns if not re.search(hidden, c)]
    rows.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in shown]).write.csv(path, header=True, quoteAll=True, escape='"')




def jsonld_rows(rows: DataFrame, asset: str, vocabulary: str, columns: list[str]) -> DataFrame:
    """asset, jsonld: one JSON-LD object a row; nulls are left out."""
    body = F.struct(F.lit(vocabulary).alias("@vocab"))
    fields = [F.col(c).alias(c) for c in columns]
    return rows.select(asset, F.to_json(F.struct(body.alias("@context"), F.col(asset).cast("string").alias("@id"), *fields)).alias("jsonld"))


def asset_tree(rows: DataFrame, asset: str, own: list[str], parent: str, child: str, label: str) -> DataFrame:
    """asset, its own columns (of the first row in order), and its references as a sorted list of (parent, child, label)."""
    first = [F.min(c).alias(c) for c in own]
    refs = F.array_sort(F.collect_set(F.struct(F.col(parent).alias("parent"), F.col(child).alias("child"), F.col(label).alias("label"))))
    return rows.groupBy(asset).agg(*first, refs.alias("references"))


def format_event(name: str, data: object) -> str:
    """One server-sent event."""
    return f"event: {name}\ndata: {json.dumps(data, separators=(',', ':'))}\n\n"


def parse_events(parts: Iterator[str]) -> Iterator[tuple[str, object]]:
    """Events of a stream that comes in parts; a part event waits for its rest, data that isn't JSON is dropped."""
    left = ""
    for part in parts:
        left = (left + part).replace("\r\n", "\n")
        *whole, left = left.split("\n\n")
        for block in whole:
            name, data = "message", []
            for line in block.split("\n"):
                if line.startswith("event:"):
                    name = line[6:].strip()
                elif line.startswith("data:"):
                    data.append(line[5:].strip())
            try:
                yield name, json.loads("\n".join(data))
            except ValueError:
                continue
