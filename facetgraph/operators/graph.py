"""Paths and graph walks over edge tables (src, dst). Bags for sequences, sets for closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step(edges: DataFrame, *predicates: str) -> DataFrame:
    """src, dst of the edges with one of the predicates (column p): an alternative path."""
    return (edges.where(F.col("p").isin(*predicates)) if predicates else edges).select("src", "dst")


def sequence(*steps: DataFrame) -> DataFrame:
    """src, dst of a path of several steps; multiplicities stay."""
    out = steps[0]
    for s in steps[1:]:
        out = out.withColumnRenamed("dst", "mid").join(s.withColumnRenamed("src", "mid"), "mid").select("src", "dst")
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short lineage, through the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="facetgraph-"))
    return df.checkpoint()


def closure(edges: DataFrame, reflexive: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) of all paths, cycles or not; by doubling: each round joins the paths known so far.

    A path of length n is found in about log2(n) rounds. ``nodes`` (column n) adds nodes without edges.
    """
    known = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    count = known.count()
    while True:
        longer = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        known = cut(known.unionByName(longer).distinct())
        now = known.count()
        if now == count:
            break
        count = now
    if not reflexive:
        return known
    ends = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n")))
    ends = ends.unionByName(nodes.select("n")) if nodes is not None else ends
    same = ends.where("n is not null").distinct().select(F.col("n").alias("src"), F.col("n").alias("dst"))
    return known.unionByName(same).distinct()


def list_members(rest: DataFrame, first: DataFrame) -> DataFrame:
    """head, position, value of linked lists of any length: rest is (src, dst) of cells, first is (cell, value).

    Every cell heads the list that begins with it, so a list of n cells gives n * (n + 1) / 2 rows.
    """
    heads = first.select(F.col("cell").alias("root")).distinct()
    after = distances(rest).withColumnRenamed("src", "root").withColumnRenamed("dst", "node").join(heads, "root", "left_semi")
    cells = after.unionByName(heads.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    return cells.join(first, F.col("node") == F.col("cell")).select(F.col("root").alias("head"), F.col("depth").alias("position"), "value")


def distances(edges: DataFrame) -> DataFrame:
    """src, dst, depth: least number of steps from each node to each other that it reaches, by doubling.

    A round that knows all of up to n steps joins those of exactly n with all, so about log2(longest) rounds do.
    """
    known, length = cut(edges.select("src", "dst").where("src <> dst").distinct().withColumn("depth", F.lit(1))), 1
    while True:
        far = known.where(F.col("depth") == length).select("src", F.col("dst").alias("mid"), F.col("depth").alias("so_far"))
        on = known.select(F.col("src").alias("mid"), "dst", "depth")
        longer = far.join(on, "mid").where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("so_far") + F.col("depth")).alias("depth"))
        fresh = cut(longer.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known, length = known.unionByName(fresh), 2 * length


def closure_with_depth(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """root, node, depth: each node reached from a root at its least depth, of all depths or up to ``most``.

    Level by level; seen pairs are left out, so cycles end.
    """
    front = roots.select(F.col("n").alias("root"), F.col("n").alias("node")).distinct().withColumn("depth", F.lit(0))
    seen = cut(front)
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        reached = front.join(edges.select("src", "dst"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = cut(reached.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def lineage(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """root, node, depth, path, truncated: all walks from the roots to ``depth`` (1 to 6) that visit no node twice.

    edges: src, dst. truncated marks walks at the depth's limit that could go on.
    """
    depth = max(1, min(6, depth))
    links = edges.select("src", "dst").distinct()
    front = roots.select(F.col("n").alias("root"), F.col("n").alias("node"), F.lit(0).alias("depth"), F.array("n").alias("path"))
    out = front
    for level in range(1, depth + 1):
        front = front.join(links, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = front.select("root", F.col("dst").alias("node"), F.lit(level).alias("depth"), F.array_append("path", F.col("dst")).alias("path"))
        out = out.unionByName(front)
    more = links.groupBy("src").agg(F.collect_set("dst").alias("onward"))
    ends = out.join(more, F.col("node") == F.col("src"), "left")
    goes_on = F.size(F.array_except(F.coalesce("onward", F.array().cast("array<string>") if dict(links.dtypes)["dst"] == "string" else F.array().cast(f"array<{dict(links.dtypes)['dst']}>")), F.col("path"))) > 0
    return ends.select("root", "node", "depth", "path", ((F.col("depth") == depth) & goes_on).alias("truncated"))


def shallowest(walks: DataFrame) -> DataFrame:
    """Each (root, node) once, at its least depth; ties by the path's order."""
    order = W.partitionBy("root", "node").orderBy("depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))
    return walks.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def leaf_descendants(narrower: DataFrame) -> DataFrame:
    """root, leaf: nodes without children below (or equal to) each node; narrower is (src parent, dst child)."""
    below = closure(narrower)
    leaves = below.join(narrower.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    return leaves.select(F.col("src").alias("root"), F.col("dst").alias("leaf")).distinct()


def pick_edge(candidates: DataFrame, populated: DataFrame, reaching: DataFrame) -> DataFrame:
    """Of each pair's candidate edges the one in use: reaches the target, else has any data, else is the shortest.

    candidates: source, target, edge, length; populated: edge; reaching: edge, target.
    """
    has = populated.select("edge").distinct().withColumn("has", F.lit(1))
    hits = reaching.select("edge", "target").distinct().withColumn("hits", F.lit(1))
    ranked = candidates.join(has, "edge", "left").join(hits, ["edge", "target"], "left")
    order = W.partitionBy("source", "target").orderBy(F.coalesce("hits", F.lit(0)).desc(), F.coalesce("has", F.lit(0)).desc(), "length", "edge")
    return ranked.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("source", "target", "edge", "length")


def longest_prefix(values: DataFrame, value: str, namespaces: dict[str, str]) -> DataFrame:
    """Adds ``namespace`` and ``prefix_domain``: of the namespaces (a catalog) the longest that begins the value."""
    longest = sorted(namespaces.items(), key=lambda x: (-len(x[0]), x[0]))
    hit: Column = F.lit(None).cast("string")
    owner: Column = F.lit(None).cast("string")
    for ns, domain in reversed(longest):
        hit = F.when(F.startswith(value, F.lit(ns)), F.lit(ns)).otherwise(hit)
        owner = F.when(F.startswith(value, F.lit(ns)), F.lit(domain)).otherwise(owner)
    return values.withColumns({"namespace": hit, "prefix_domain": owner})


def breadth_first(edges: list[tuple[str, str, str]], roots: list[str]) -> dict[str, list[tuple[str, str]]]:
    """Schema-sized search on the driver: node -> [(predicate, node), ...], the first shortest path by edge order."""
    after: dict[str, list[tuple[str, str]]] = {}
    for src, p, dst in sorted(set(edges)):
        if src != dst:
            after.setdefault(src, []).append((p, dst))
    paths: dict[str, list[tuple[str, str]]] = {r: [] for r in roots}
    front = list(dict.fromkeys(roots))
    while front:
        following = []
        for node in front:
            for p, dst in after.get(node, []):
                if dst not in paths:
                    paths[dst] = [*paths[node], (p, dst)]
                    following.append(dst)
        front = following
    return paths


def self_test(spark: SparkSession) -> bool:
    """Whether the closure is reflexive and transitive here, as a start-up check."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    return {tuple(r) for r in closure(edges).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "c"), ("a", "c")}
