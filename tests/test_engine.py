"""Slots, plans, policy, parsers, cache: without tables."""

import pytest

from facetgraph.catalog import Catalog, lifted_catalog, normalize_domain
from facetgraph.functions import text as tx
from facetgraph.operators import graph as gr
from facetgraph.plans.search import plan_search
from facetgraph.service import ResultCache, SearchService, TokenBucket
from facetgraph.slots import canonical, field_strings, parse_slots
from facetgraph.sources import files as fl
from facetgraph.sources import rdf
from facetgraph.sparql.execute import run_query
from facetgraph.sparql.parser import SparqlError, parse
from facetgraph.sparql.policy import check, lint, schema_sandbox


def test_slots_have_one_canonical_text():
    a = parse_slots({"domains": ["b", "a"], "filters": {"y": ["2", "1", "1"], "x": ""}, "references": {"domain": "r", "filters": {"k": "v"}}})
    b = parse_slots('{"domains": ["a", "b"], "filters": {"y": ["1", "2"]}, "references": [{"domain": "r", "filters": {"k": ["v"]}}]}')
    assert canonical(a) == canonical(b)
    assert "ref:r/filter:k=v" in field_strings(a)


def test_references_have_a_depth_limit():
    raw = {"domain": "x"}
    for _ in range(8):
        raw = {"domain": "x", "references": [raw]}
    with pytest.raises(ValueError):
        parse_slots({"references": [raw]})


def test_plan_gates_and_gaps():
    plan = plan_search(parse_slots({"domains": ["customer", "nowhere", "Customer"], "filters": {"mktsegment": "A", "unheard": "x"}, "references": [{"domain": "part"}]}), lifted_catalog())
    assert [a.domain.name for a in plan.arms] == ["customer"]
    assert plan.gaps == ("unheard",) and plan.dropped_references == ("customer->part",)


def test_concepts_expand_to_leaves_and_lists_stay_lists():
    catalog = Catalog({}, {"k": {"top": ("a", "b"), "one": ("c",)}})
    assert catalog.expand({"k": "Top"}) == {"k": ["a", "b"]}
    assert catalog.expand({"k": "one"}) == {"k": "c"}
    assert catalog.expand({"k": ["one", "z"]}) == {"k": ["c", "z"]}


@pytest.mark.parametrize(("raw", "name"), [("SurfaceModel", "surface-model"), ("a_b c", "a-b-c"), ("x", "x")])
def test_domain_names(raw, name):
    assert normalize_domain(raw) == name


def test_policy():
    assert check("SELECT ?s WHERE { ?s ?p ?o }").query.limit == 100
    assert not check("SELECT ?s WHERE { ?s ?p ?o } LIMIT 501").allowed
    assert not check("SELECT ?s WHERE { ?s ?p ?o FILTER EXISTS { SERVICE <urn:x> { ?s ?p ?o } } }").allowed
    assert not check("DELETE WHERE { ?s ?p ?o }").allowed
    assert not schema_sandbox("SELECT ?s WHERE { GRAPH <urn:g> { ?s ?p ?o } }", "urn:g").allowed
    assert schema_sandbox("SELECT ?s WHERE { ?s ?p ?o } LIMIT 900", "urn:g").query.limit == 50


def test_lint():
    assert lint(parse("SELECT ?x WHERE { ?s ?p ?o FILTER(STRLEN(?s, ?o) > 1) }")) == ["?x is never bound", "STRLEN takes another number of arguments than 2"]


def test_bad_queries_are_errors():
    for text in ("SELECT WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { ?s nope:p ?o }", "SELECT ?s { ?s ?p ?o } garbage"):
        with pytest.raises(SparqlError):
            parse(text)


def test_turtle_reader():
    rows = rdf.TurtleReader('@prefix e: <http://e/> . e:a e:p "x\\ny"@EN, 5, 1.5e3, true ; e:q [ e:r (1 e:b) ] .').parse()
    objects = {(r[2], r[3], r[5]) for r in rows}
    assert ("http://e/p", "x\ny", rdf.RDF + "langString") in objects and ("http://e/p", "5", rdf.XSD + "integer") in objects
    assert sum(r[2] == rdf.RDF + "first" for r in rows) == 2
    with pytest.raises(rdf.RdfError):
        rdf.TurtleReader("e:a e:p 1 .").parse()


def test_jsonld_contexts_by_url():
    reader = rdf.JsonLdReader("", {"http://c/": {"@context": {"@vocab": "http://v/"}}})
    rows = reader.read('{"@context": "http://c", "@id": "urn:a", "p": [1, true, {"@list": ["x"]}]}')
    assert {r[2] for r in rows if r[0] == "urn:a"} == {"http://v/p"}
    with pytest.raises(rdf.RdfError):
        rdf.JsonLdReader().read('{"@context": "http://other", "@id": "urn:a"}')


def test_turtle_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<urn:a>\n  <urn:p> 1 .\n<urn:a> <urn:p> 1 .")
    (tmp_path / "b.ttl").write_text("<urn:a> <urn:p> .")
    assert rdf.read_turtle(spark, str(tmp_path)).count() == 1
    assert rdf.read_problems(spark, str(tmp_path)).count() == 1


def test_bags_and_sets(spark):
    quads = rdf.quads_of(spark, "<urn:a> <urn:p> <urn:m>, <urn:n> . <urn:m> <urn:p> <urn:z> . <urn:n> <urn:p> <urn:z> . <urn:z> <urn:p> <urn:a> .")
    assert run_query(quads, "SELECT ?x WHERE { <urn:a> <urn:p>/<urn:p> ?x }").count() == 2
    assert {r[0] for r in run_query(quads, "SELECT ?x WHERE { <urn:a> <urn:p>+ ?x }").collect()} == {"urn:a", "urn:m", "urn:n", "urn:z"}
    assert run_query(quads, "SELECT ?x WHERE { <urn:q> <urn:p>* ?x }").count() == 0
    assert run_query(quads, "ASK { <urn:z> ^<urn:p> <urn:m> }").first()[0] == "true"


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 4)], "src int, dst int")
    assert gr.closure(edges).where("src = 1").count() == 3
    assert gr.self_test(spark)


def test_breadth_first_prefers_short_then_sorted():
    paths = gr.breadth_first([("a", "q", "c"), ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("a", "p", "a")], ["a"])
    assert paths["d"] == [("q", "c"), ("p", "d")] and paths["a"] == []


def test_cache_and_bucket():
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    assert [cache.get(k, lambda k=k: k.upper()) for k in "aba"] == ["A", "B", "A"]
    cache.get("c", lambda: "C")
    assert list(cache.held) == ["a", "c"]
    now[0] = 11
    assert cache.get("a", lambda: "new") == "new"
    bucket = TokenBucket(2, 1, clock=lambda: now[0])
    assert [bucket.allow("x") for _ in range(3)] == [True, True, False]
    now[0] = 12
    assert bucket.allow("x")


def test_service_remembers_by_request(spark):
    nation = spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    service = SearchService(spark, lifted_catalog(), {"nation": nation}.__getitem__)
    assert service.refine({"domains": ["nation"]}) is service.refine('{"domains": ["nation"], "filters": {"x": ""}}')
    assert service.refine({"domains": ["nation"]}).rows.count() == 1
    assert service.refine({"domains": ["nation"]}).counts.first()["n"] == 1


def test_events_survive_cuts():
    text = fl.format_event("a", {"x": 1}) + "event: b\ndata: broken\n\n" + fl.format_event("c", [2])
    assert list(fl.parse_events(iter([text[:7], text[7:30], text[30:]]))) == [("a", {"x": 1}), ("c", [2])]


def test_samples_cite_bad_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1}\n{"a": "no"}\nnot json\n')
    assert [r["line"] for r in fl.bad_sample_lines(spark, str(tmp_path / "s.json"), "a int").orderBy("line").collect()] == [2, 3]


def test_csv_export_hides_and_defuses(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", "x", 5)], "a string, ref_step_1 string, b int")
    fl.export_csv(rows, str(tmp_path / "out"))
    lines = {line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()}
    assert lines == {'"a","b"', '"\'=1+1","5"'}


def test_roads_and_lanes(spark):
    xml = '<OpenDRIVE><road id="1" length="5"><link><successor elementType="road" elementId="2"/></link><planView><geometry s="0" hdg="0" length="5"><line/></geometry></planView><lanes><laneSection><right><lane id="-1" type="driving"/><lane id="-2" type="border"/></right></laneSection></lanes></road><road id="2" length="1"/></OpenDRIVE>'
    files = spark.createDataFrame([(xml,), ("<broken",)], "value string")
    network = fl.roads(files)
    assert {tuple(r) for r in fl.drivable_lanes(files).collect()} == {("1", -1)}
    assert [r[0] for r in fl.entry_roads(network).collect()] == ["1"]


def test_token_match_grades(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("road", "road"), ("road", "roadway"), ("motorway", "motorways"), ("abc", "xyz")], "a string, b string")
    assert [round(r[0], 3) for r in rows.select(tx.token_match(F.col("a"), F.col("b"))).collect()] == [1.0, 0.7, 0.7, 0.0]


def test_long_lists_and_cycles(spark):
    rest = spark.createDataFrame([(i, i + 1) for i in range(299)] + [(1000, 1001), (1001, 1002), (1002, 1000)], "src long, dst long")
    first = spark.createDataFrame([(i, f"v{i}") for i in [*range(300), 1000, 1001, 1002]], "cell long, value string")
    got = {tuple(r) for r in gr.list_members(rest, first).where("head in (0, 290, 1001)").collect()}
    assert got == {(0, i, f"v{i}") for i in range(300)} | {(290, i, f"v{290 + i}") for i in range(10)} | {(1001, 0, "v1001"), (1001, 1, "v1002"), (1001, 2, "v1000")}
    deep = gr.closure_with_depth(rest.where("src < 70"), spark.createDataFrame([(0,)], "n long"))
    assert deep.count() == 71


def test_graphql_round_trip():
    from facetgraph import graphql as gq

    slots = parse_slots({"domains": ["orders"], "filters": {"status": ["F", "O"], "x-y": 'say "hi"'}, "ranges": {"total": {"min": 5, "max": 7.5}}, "references": [{"domain": "customer", "label": "ann", "filters": {"region": "ASIA"}, "references": [{"domain": "nation"}]}]})
    assert canonical(gq.parse(gq.serialize(slots), {"x_y": "x-y"})) == canonical(slots)
    for bad in ("query { ...f }", "{ a(x: $v) { name } }", "{ a { name }", "{ a(x: {over: 1}) { name } }", "{ }"):
        with pytest.raises(gq.GraphqlError):
            gq.parse(bad)
    assert "type Customer { name: String! nation: Nation }" in gq.schema_text(lifted_catalog())


def _solutions(spark, turtle: str, text: str) -> list[tuple]:
    quads = rdf.quads_of(spark, f"@prefix e: <urn:e:> . {turtle}", "urn:g")
    return sorted(map(tuple, run_query(quads, f"PREFIX e: <urn:e:> {text}", terms=True).collect()), key=repr)


def test_minus_needs_a_variable_bound_in_both(spark):
    data = "e:a e:p 1 . e:b e:p 2 . e:b e:q 5 . e:c e:q 5 ."
    assert len(_solutions(spark, data, "SELECT ?s WHERE { ?s e:p ?o OPTIONAL { ?s e:none ?z } MINUS { ?t e:q ?z } }")) == 2
    assert [r[0] for r in _solutions(spark, data, "SELECT ?s WHERE { ?s e:p ?o OPTIONAL { ?s e:q ?z } MINUS { ?t e:q ?z } }")] == ["urn:e:a"]


def test_sums_keep_integers_and_distinct_terms_differ(spark):
    data = "e:a e:p 1 , 2 , 1.0 . e:b e:p 3 , 4 ."
    got = {r[0]: r for r in _solutions(spark, data, "SELECT ?s (SUM(?o) AS ?n) (AVG(DISTINCT ?o) AS ?m) WHERE { ?s e:p ?o } GROUP BY ?s")}
    a, b = got["urn:e:a"], got["urn:e:b"]
    assert float(a[2]) == 4 and a[3].endswith("double|") and abs(float(a[4]) - 4 / 3) < 1e-9
    assert b[2] == "7" and b[3].endswith("integer|")


def test_functions_keep_types_and_languages(spark):
    data = "e:a e:p 2.5 ; e:q 'Ab'@en ; e:d '2020-01-01T10:00:00+05:30'^^<http://www.w3.org/2001/XMLSchema#dateTime> ."
    text = "SELECT (ROUND(?p) AS ?r) (UCASE(?q) AS ?u) (TIMEZONE(?d) AS ?z) (ABS(-3) AS ?i) WHERE { ?s e:p ?p ; e:q ?q ; e:d ?d }"
    r, rt, u, ut, z, zt, i, it = _solutions(spark, data, text)[0]
    assert float(r) == 3 and rt.endswith("decimal|") and u == "AB" and ut.endswith("|en") and z == "PT5H30M" and zt.endswith("#dayTimeDuration|") and (i, it[-8:]) == ("3", "integer|")


def test_optional_filters_see_both_sides(spark):
    data = "e:a e:p 1 ; e:q 5 . e:b e:p 9 ; e:q 5 ."
    got = _solutions(spark, data, "SELECT ?s ?q WHERE { ?s e:p ?p OPTIONAL { ?s e:q ?q FILTER(?q > ?p) } }")
    assert [(r[0], r[2]) for r in got] == [("urn:e:a", "5"), ("urn:e:b", None)]


def test_numeric_bounds_need_numeric_datatypes(spark):
    from facetgraph.operators import aggregates as ag

    rows = [("p", "1", "string", 1), ("q", "1", "int", 1), ("q", "2.5", "http://www.w3.org/2001/XMLSchema#decimal", 1)]
    got = {r["property"]: (r["min_value"], r["max_value"]) for r in ag.distribution(spark.createDataFrame(rows, "property string, value string, datatype string, n bigint")).collect()}
    assert got == {"p": (None, None), "q": (1.0, 2.5)}


def test_domains_follow_the_properties_used():
    catalog = lifted_catalog()
    assert catalog.correct_domains(("customer",), ["mktsegment", "unheard"]) == ("customer",)
    assert catalog.correct_domains(("customer",), ["brand"]) == ("customer", "part")
    assert catalog.correct_domains((), ["acctbal"]) == ("customer", "supplier")


def test_schema_sources_are_counted_and_must_hold_something(spark, tmp_path):
    for folder, name, text in (("a", "x.ttl", "@prefix e: <urn:e:> . e:s e:p e:o ."), ("b", "bad.ttl", "e:s e:p"), ("b", "y.ttl", "@prefix e: <urn:e:> . e:t e:p 1 .")):
        (tmp_path / "root" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / folder / name).write_text(text)
    (tmp_path / "empty").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "z.ttl").write_text("<a> <b>")
    root = str(tmp_path / "root")
    quads, counts = rdf.load_schema(spark, [root])
    assert quads.count() == 2 and [tuple(r) for r in counts.collect()] == [(root, 3, 1)]
    assert rdf.load_schema(spark, [root], domains={"a"})[0].count() == 1
    for bad in ([root, str(tmp_path / "empty")], [str(tmp_path / "broken")]):
        with pytest.raises(rdf.SourceError):
            rdf.load_schema(spark, bad)


def test_paths_take_the_shortest_way_through_combinators_and_superclasses(spark):
    from facetgraph import schema as sc

    text = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <urn:e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
    e:A sh:targetClass e:a ; sh:or ( [ sh:and ( [ sh:property [ sh:path e:toB ; sh:node e:B ] ] ) ] [ sh:property [ sh:path e:own ] ] ) .
    e:B sh:targetClass e:b ; sh:property [ sh:path e:deep ] , [ sh:path e:back ; sh:node e:A ] , [ sh:path e:near ; sh:nodeKind sh:IRI ] , [ sh:path e:one ; sh:class e:a ] .
    e:Sub sh:targetClass e:sub . e:sub r:subClassOf e:b ."""
    quads = rdf.quads_of(spark, text)
    paths = sc.property_paths(quads)
    got = {(r["asset"][6:], r["name"]): [s[6:] for s in r["steps"]] for r in paths.collect()}
    assert got["a", "deep"] == ["toB", "deep"] and got["a", "own"] == ["own"] and got["b", "own"] == ["back", "own"]
    assert got["sub", "deep"] == ["deep"] and got["sub", "own"] == ["back", "own"]
    assert {(r["asset"][6:], r["name"], r["kind"]) for r in sc.reference_chains(paths).collect()} == {(a, n, k) for a in ("a", "b", "sub") for n, k in (("near", "iri"), ("one", "class"))}


def test_budgets_against_a_plain_loop(spark):
    import random

    from facetgraph.operators import aggregates as ag

    pick = random.Random(1)
    rows = [("ab"[i % 2], i, pick.randint(1, 9)) for i in range(40)]
    wanted = []
    for key in "ab":
        left = 20
        for j, r in enumerate(x for x in rows if x[0] == key):
            if j == 0 or r[2] <= left:
                wanted.append(r)
                left -= r[2]
    got = ag.budgeted(spark.createDataFrame(rows, "k string, i bigint, size bigint"), ["k"], ["i"], "size", 20)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
