"""Circuits: shared, content-addressed gates for all answers of a query at once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, terms
from ..plans.algebra import plain
from ..storage import Scratch, remove, settled
from . import relation as R

# The circuit vocabulary.
NS = "urn:circuit:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
WIRES = "gate string, op string, child string, role string"


@dataclass(frozen=True)
class Circuit:
    """``wires(gate, op, child, role)`` without repeats and ``answers(root, variables...)``.

    A sum without a feeder (child NULL) is constant false, a product without a
    factor constant true.
    """

    wires: DataFrame
    answers: DataFrame
    variables: tuple[str, ...]
    repeated: DataFrame | None = None  #: the wires before repeats go, where that is cheaper

    @property
    def every(self) -> DataFrame:
        """The wires, some perhaps more than once."""
        return self.wires if self.repeated is None else self.repeated

    @property
    def gates(self) -> DataFrame:
        return self.wires.select("gate", "op").distinct()

    @property
    def edges(self) -> DataFrame:
        return self.wires.where(F.col("child").isNotNull()).select(F.col("gate").alias("parent"), "child", "role")

    def settle(self) -> Circuit:
        """Evaluated once and written to the shared folder, for repeated use."""
        return Circuit(settled(self.wires, "wires"), settled(self.answers, "answers"), self.variables)

    def leaves(self) -> DataFrame:
        inner = self.wires.select(F.col("gate").alias("child")).distinct()
        return self.edges.select("child").distinct().join(inner, "child", "left_anti").withColumnRenamed("child", "token")

    def stats(self) -> DataFrame:
        """Gates by kind, edges and leaves."""
        kinds = self.gates.groupBy("op").agg(F.count("*").alias("n"))
        edges = self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("op"), "n")
        leaves = self.leaves().agg(F.count("*").alias("n")).select(F.lit("leaves").alias("op"), "n")
        return kinds.unionByName(edges).unionByName(leaves)

    def fan_out(self) -> DataFrame:
        """How many gates use each node."""
        return self.edges.groupBy(F.col("child").alias("node")).agg(F.count_distinct("parent").alias("uses"))

    def cones(self, max_depth: int = 10_000, scratch: Scratch | None = None) -> DataFrame:
        """``(root, gate, op, child, role)``: for every answer the wires below it."""
        keep = scratch.settled if scratch else settled
        wires = self.wires
        inner = wires.where(F.col("child").isNotNull()).select("gate", F.col("child").alias("below"))
        inner = inner.join(wires.select(F.col("gate").alias("below")).distinct(), "below", "left_semi").distinct()
        front = seen = self.answers.select("root", F.col("root").alias("gate")).distinct()
        for _ in range(max_depth):
            reached = front.join(inner, "gate").select("root", F.col("below").alias("gate")).distinct()
            front = keep(reached.join(seen, ["root", "gate"], "left_anti").select("root", "gate"), "front")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        else:
            raise ValueError(f"the circuit is deeper than {max_depth} gates, or has a cycle")
        return seen.join(wires, "gate").select("root", "gate", "op", "child", "role")

    def cone_sizes(self) -> DataFrame:
        """Gates and edges below each answer."""
        return self.cones().groupBy("root").agg(
            F.count_distinct("gate").alias("gates"),
            F.count_distinct(F.when(F.col("child").isNotNull(), F.struct("gate", "child", "role"))).alias("edges"),
        )

    def to_ntriples(self) -> DataFrame:
        """One column ``line``: the circuit in its exchange form.  Sort it for byte-stable output."""

        def triple(s, p, o):
            return F.concat(s, F.lit(f" <{p}> "), o, F.lit(" ."))

        name = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
        leaf = lambda c: F.when(c.startswith("<") | c.startswith("_:"), c).otherwise(name(c))
        kind = F.concat(F.lit(f"<{NS}"), F.initcap("op"), F.lit(">"))
        w = self.wires
        lines = [
            w.select(triple(name(F.col("gate")), TYPE, kind)),
            w.where("role = 'in'").select(triple(name(F.col("gate")), NS + "in", leaf(F.col("child")))),
            w.where("role = 'feeds'").select(triple(leaf(F.col("child")), NS + "feeds", name(F.col("gate")))),
        ]
        for role in (R.MINUEND, R.SUBTRAHEND):
            lines.append(w.where(F.col("role") == role).select(triple(name(F.col("gate")), NS + role, leaf(F.col("child")))))
        root = name(F.col("root"))
        label = F.concat(
            F.lit("A"),
            *[F.concat(F.lit(f"|{plain(v)}="), F.coalesce(terms.lex(F.col(f"`{v}`")), F.lit("NULL"))) for v in self.variables],
        )
        quote = lambda c: F.concat(F.lit('"'), _escaped(c), F.lit('"'))
        lines.append(self.answers.select(triple(root, NS + "answer", quote(label))))
        for v in self.variables:
            node = F.concat(F.lit("<"), F.col("root"), F.lit(f"#{v}>"))
            c = F.col(f"`{v}`")
            lines.append(self.answers.select(triple(root, NS + "binding", node)))
            lines.append(self.answers.select(triple(node, NS + "var", F.lit(f'"{plain(v)}"'))))
            lines.append(self.answers.where(c.isNotNull()).select(triple(node, NS + "val", written(c))))
        return R.union_frames([x.toDF("line") for x in lines]).distinct()

    def write_ntriples(self, path: str) -> None:
        """Sorted lines, range-partitioned: files in order hold the sorted circuit."""
        self.to_ntriples().orderBy("line").write.mode("overwrite").text(path)

    def write(self, path: str, run: str) -> None:
        """Under the name of a run, to be dropped or read by it."""
        self.wires.write.mode("overwrite").parquet(f"{path}/run={run}/wires")
        self.answers.write.mode("overwrite").parquet(f"{path}/run={run}/answers")


def drop(spark: SparkSession, path: str, run: str) -> None:
    """Forget a run; others under the same path stay."""
    remove(spark, f"{path}/run={run}")


def run_name(query: str) -> str:
    return f"urn-circuit-run-{identity.sha(query)}"


def read(spark: SparkSession, path: str, run: str) -> Circuit:
    answers = spark.read.parquet(f"{path}/run={run}/answers")
    return Circuit(
        spark.read.parquet(f"{path}/run={run}/wires"), answers, tuple(c for c in answers.columns if c != "root")
    )


def _escaped(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def written(c):
    """A term as N-Triples writes it."""
    text = F.concat(F.lit('"'), _escaped(terms.lex(c)), F.lit('"'))
    tag = terms.lang(c)
    typed = F.when(terms.datatype(c) == terms.STRING, text).otherwise(
        F.concat(text, F.lit("^^<"), terms.datatype(c), F.lit(">"))
    )
    return F.when(terms.is_literal(c), F.when(tag != "", F.concat(text, F.lit("@"), tag)).otherwise(typed)).otherwise(c)


def answers(branches: list[tuple[R.Relation, bool]], variables: tuple[str, ...], tag: str) -> Circuit:
    """One sum per binding of ``variables`` over all branches; ``True`` feeds a branch's gate without a product."""
    wires, rows = [], []
    for relation, direct in branches:
        fed = R.sum_products(relation, variables, identity.ANSWER, tag, direct)
        wires += fed.wires
        columns = [
            F.col(f"`{v}`") if v in fed.variables else F.lit(None).cast("string").alias(v) for v in variables
        ]
        rows.append(fed.df.select(F.col(fed.gates[0]).alias("root"), *columns))
    every = R.union_frames(wires)
    return Circuit(every.distinct(), R.union_frames(rows).distinct(), tuple(variables), every)


_LINE = re.compile(r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(.*?)\s*\.\s*$')


def from_ntriples(spark: SparkSession, lines: DataFrame) -> Circuit:
    """A circuit from its exchange form (one column ``line``).  Inconsistent circuits are refused."""
    pattern = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(.*?)\s*\.\s*$'
    t = lines.where(F.trim("line") != "").select(
        F.regexp_extract("line", pattern, 1).alias("s"),
        F.regexp_extract("line", pattern, 2).alias("p"),
        F.regexp_extract("line", pattern, 3).alias("o"),
    )
    t = settled(t.distinct(), "circuit")
    bare = lambda c: F.regexp_replace(c, "^<([^<>]*)>$", "$1")
    kinds = t.where(F.col("p") == TYPE).select(
        bare(F.col("s")).alias("gate"), F.lower(F.regexp_extract("o", f"^<{NS}(\\w+)>$", 1)).alias("op")
    )
    clash = kinds.groupBy("gate").agg(F.count_distinct("op").alias("n")).where("n > 1")
    minus = t.where(F.col("p").isin(NS + R.MINUEND, NS + R.SUBTRAHEND)).select(
        bare(F.col("s")).alias("gate"), F.col("p").alias("p"), bare(F.col("o")).alias("child")
    )
    sides = kinds.where("op = 'minus'").join(minus, "gate", "left").groupBy("gate").agg(
        F.count("child").alias("n"), F.count_distinct("p").alias("k")
    )
    if not clash.isEmpty():
        raise ValueError("a gate has two kinds")
    if not sides.where("n <> 2 or k <> 2").isEmpty():
        raise ValueError("a Minus gate needs exactly one minuend and one subtrahend")
    role = F.substring_index("p", ":", -1)
    factors = t.where(F.col("p") == NS + "in").select(bare(F.col("s")).alias("gate"), bare(F.col("o")).alias("child"), F.lit("in").alias("role"))
    feeds = t.where(F.col("p") == NS + "feeds").select(bare(F.col("o")).alias("gate"), bare(F.col("s")).alias("child"), F.lit("feeds").alias("role"))
    inner = R.union_frames([factors, feeds, minus.select("gate", "child", role.alias("role"))])
    wires = kinds.join(inner, "gate", "left").select("gate", "op", "child", "role")
    owners = t.where(F.col("p") == NS + "binding").select(bare(F.col("s")).alias("root"), F.col("o").alias("node"))
    names = t.where(F.col("p") == NS + "var").select(F.col("s").alias("node"), F.regexp_extract("o", '^"(.*)"$', 1).alias("v"))
    values = t.where(F.col("p") == NS + "val").select(F.col("s").alias("node"), F.col("o").alias("value"))
    if not values.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a binding has two values")
    bound = owners.join(names, "node").join(values, "node", "left")
    variables = tuple(sorted(r["v"] for r in names.select("v").distinct().collect()))
    full = bound.groupBy("root").pivot("v", list(variables)).agg(F.first("value"))
    typed = full.select("root", *[_typed(F.col(f"`{v}`")).alias(v) for v in variables])
    return Circuit(wires.distinct(), typed, variables)


def _typed(c):
    """N-Triples text as a canonical term: plain literals are strings, escapes are undone."""
    body = F.regexp_extract(c, '^"((?s:.*))"[^"]*$', 1)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        body = F.replace(body, F.lit(a), F.lit(b))
    suffix = F.substring_index(c, '"', -1)
    kind = F.when(suffix == "", F.lit(f"^^<{terms.STRING}>")).otherwise(suffix)
    return F.when(c.startswith('"'), F.concat(F.lit('"'), body, F.lit('"'), kind)).otherwise(c)
