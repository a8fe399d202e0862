"""Structure of queries and circuits: treewidth bounds, size measures, synthetic families."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import iri
from ..plans import algebra as A

Graph = dict[str, set[str]]


def primal_graph(groups) -> Graph:
    """Variables that occur together are neighbours."""
    graph: Graph = {}
    for group in groups:
        for x in group:
            graph.setdefault(x, set())
        for x, y in combinations(group, 2):
            graph[x].add(y)
            graph[y].add(x)
    return graph


def query_graph(bgp: A.Bgp) -> Graph:
    return primal_graph([sorted({x.name for x in p.slots if isinstance(x, A.Var)}) for p in bgp.patterns])


def _copy(graph: Graph) -> Graph:
    return {x: set(y) for x, y in graph.items()}


def min_fill(graph: Graph) -> tuple[int, list[str]]:
    """Upper bound of the treewidth, and the elimination order that shows it."""
    g, width, order = _copy(graph), 0, []
    while g:
        fill = {x: sum(b not in g[a] for a, b in combinations(sorted(g[x]), 2)) for x in g}
        x = min(g, key=lambda v: (fill[v], len(g[v]), v))
        around = g.pop(x)
        width = max(width, len(around))
        order.append(x)
        for y in around:
            g[y].discard(x)
            g[y] |= around - {y}
    return width, order


def width_of(graph: Graph, order: list[str]) -> int:
    """Width of an elimination order; checks that it covers the graph."""
    if sorted(order) != sorted(graph):
        raise ValueError("the order does not cover the graph")
    g, width = _copy(graph), 0
    for x in order:
        around = g.pop(x)
        width = max(width, len(around))
        for y in around:
            g[y].discard(x)
            g[y] |= around - {y}
    return width


def minor_min_width(graph: Graph) -> int:
    """Lower bound of the treewidth: contract a least-degree vertex into its least-degree neighbour, again and again."""
    g, bound = _copy(graph), 0
    while g:
        x = min(g, key=lambda v: (len(g[v]), v))
        bound = max(bound, len(g[x]))
        around = g.pop(x)
        for y in around:
            g[y].discard(x)
        if around:
            y = min(around, key=lambda v: (len(g[v]), v))
            for z in around - {y}:
                g[y].add(z)
                g[z].add(y)
    return bound


def _facts(df: DataFrame, s, p: str, o) -> DataFrame:
    node = lambda c: F.concat(F.lit("<urn:f:"), c.cast("string"), F.lit(">"))
    return df.select(
        F.concat(F.lit("urn:t:"), F.monotonically_increasing_id().cast("string")).alias("token"),
        node(s).alias("s"), F.lit(iri(p)).alias("p"), node(o).alias("o"),
    )


def chain(spark: SparkSession, n: int) -> DataFrame:
    """n edges in a line."""
    return _facts(spark.range(0, n, 1, 1), F.col("id"), "urn:f:p", F.col("id") + 1)


def star(spark: SparkSession, branches: int, degree: int) -> DataFrame:
    """A hub with ``degree`` facts for each of ``branches`` predicates."""
    rows = spark.range(0, branches * degree, 1, 1)
    b = (F.col("id") / degree).cast("int")
    out = _facts(rows, F.lit("hub"), "urn:f:p", F.col("id"))
    named = rows.select(F.concat(F.lit("<urn:f:p"), b.cast("string"), F.lit(">")).alias("_p"), F.concat(F.lit("<urn:f:"), F.col("id").cast("string"), F.lit(">")).alias("o"))
    return out.join(named, "o").select("token", "s", F.col("_p").alias("p"), "o")


def layered(spark: SparkSession, depth: int, width: int) -> DataFrame:
    """A source, ``depth`` layers of ``width`` nodes, all edges between neighbouring layers."""
    first = spark.range(0, width, 1, 1).select(F.lit("source").alias("a"), F.concat(F.lit("1_"), F.col("id").cast("string")).alias("b"))
    rest = spark.range(0, (depth - 1) * width * width, 1, 1).select(
        (F.col("id") / (width * width)).cast("int").alias("d"), (F.col("id") % (width * width)).alias("k")
    ).select(
        F.concat_ws("_", (F.col("d") + 1).cast("string"), (F.col("k") / width).cast("int").cast("string")).alias("a"),
        F.concat_ws("_", (F.col("d") + 2).cast("string"), (F.col("k") % width).cast("string")).alias("b"),
    )
    return _facts(first.unionByName(rest).coalesce(1), F.col("a"), "urn:f:p", F.col("b"))


def grid(spark: SparkSession, k: int) -> DataFrame:
    """Right and down edges of a k by k grid."""
    cells = spark.range(0, k * k, 1, 1).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    at = lambda i, j: F.concat_ws("_", i.cast("string"), j.cast("string"))
    right = cells.where(F.col("j") < k - 1).select(at(F.col("i"), F.col("j")).alias("a"), at(F.col("i"), F.col("j") + 1).alias("b"))
    down = cells.where(F.col("i") < k - 1).select(at(F.col("i"), F.col("j")).alias("a"), at(F.col("i") + 1, F.col("j")).alias("b"))
    return _facts(right.unionByName(down).coalesce(1), F.col("a"), "urn:f:p", F.col("b"))


def sharing(circuit) -> DataFrame:
    """One row: nodes of the circuit, the sum of the answers' own sizes, and their ratio."""
    cones = circuit.cones()
    own = cones.groupBy("root").agg(F.count_distinct("gate").alias("n")).agg(F.sum("n").alias("separate"))
    return circuit.gates.agg(F.count("*").alias("shared")).crossJoin(own).withColumn("ratio", F.col("separate") / F.col("shared"))
