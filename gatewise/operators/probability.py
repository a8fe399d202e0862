"""Exact probabilities of answers.

Two routes.  *Read-once* answers (every node below the answer used once) are
solved by DataFrame aggregation, level by level, shared gates once, under
short names and without a list of gates for each answer.  All others go to workers, where the gates of one answer, or of one family of
answers connected through shared nodes, are compiled together.  Nothing is
sampled; a diagram beyond the limit is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import Scratch, settled
from . import compiling
from .circuit import Circuit

CONE = "array<struct<gate:string,op:string,child:string,role:string>>"


def check_probabilities(probs: DataFrame) -> DataFrame:
    """``(token, p)`` with p a number in [0, 1]; anything else is an error when the rows are read."""
    p = F.col("p").cast("double")
    valid = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    return probs.select(
        "token",
        F.when(valid, p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.coalesce("token", F.lit("NULL"))))).alias("p"),
    )


def require_all(circuit: Circuit, probs: DataFrame) -> None:
    missing = circuit.leaves().join(probs.select("token"), "token", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no probability for {[r['token'] for r in missing]}")


def short(name: Column) -> Column:
    """The first 128 bits of a name's SHA-256, for joins."""
    return F.unhex(F.substring(F.sha2(name, 256), 1, 32))


def read_once_roots(cones: DataFrame) -> DataFrame:
    """Answers below which no node is used twice."""
    uses = cones.where(F.col("child").isNotNull()).groupBy("root", "child").agg(F.count("*").alias("n"))
    return uses.groupBy("root").agg(F.max("n").alias("n")).where("n = 1").select("root")


def entangled_roots(circuit: Circuit, scratch: Scratch) -> DataFrame | None:
    """Answers below which some node is used twice; None if there is no such answer.

    Such a node has two users in the whole circuit, too, so only what stands above nodes with two users is looked at.
    """
    inner = circuit.wires.where(F.col("child").isNotNull())
    front = scratch.settled(circuit.fan_out().where("uses > 1").select("node"), "shared")
    above = front
    while not front.isEmpty():
        over = inner.join(front, inner["child"] == front["node"], "left_semi").select(F.col("gate").alias("node")).distinct()
        front = scratch.settled(over.join(above, "node", "left_anti"), "above")
        above = above.unionByName(front)
    part = scratch.settled(inner.join(above, inner["child"] == above["node"], "left_semi"), "part")
    if part.isEmpty():
        return None
    roots = circuit.answers.join(part.select(F.col("gate").alias("root")).distinct(), "root", "left_semi")
    cones = Circuit(part, roots, ()).cones(scratch=scratch)
    uses = cones.groupBy("root", "child").agg(F.count("*").alias("n")).where("n > 1")
    found = scratch.settled(uses.select("root").distinct(), "entangled")
    return None if found.isEmpty() else found


def extensional(wires: DataFrame, probs: DataFrame, max_depth: int = 10_000, scratch: Scratch | None = None) -> DataFrame:
    """``(gate, p)`` as if children were independent, bottom up.  Exact below read-once answers.

    A value goes to its users once, when it is known; a gate that waits for others keeps the product so far.
    """
    keep = scratch.settled if scratch else settled
    wires = keep(wires.select("gate", "op", "child", "role").distinct(), "wires")
    inner = wires.where(F.col("child").isNotNull())
    needs = keep(wires.groupBy("gate").agg(F.first("op").alias("op"), F.count("child").alias("n")), "needs")
    front = keep(
        probs.select(F.col("token").alias("node"), "p").unionByName(
            needs.where("n = 0").select(F.col("gate").alias("node"), F.when(F.col("op") == "times", 1.0).otherwise(0.0).alias("p"))
        ),
        "level",
    )
    solved = front.limit(0)
    waiting = None
    for _ in range(max_depth):
        q = F.when(F.col("role").isin("in", "minuend"), F.col("p")).otherwise(1 - F.col("p"))
        got = inner.join(front, inner["child"] == front["node"]).groupBy("gate").agg(F.count("*").alias("got"), F.product(q).alias("x"))
        if waiting is not None:
            got = waiting.unionByName(got).groupBy("gate").agg(F.sum("got").alias("got"), F.product("x").alias("x"))
        got = keep(got.join(needs, "gate"), "level")
        waiting = got.where("got < n").select("gate", "got", "x")
        front = got.where("got = n").select(
            F.col("gate").alias("node"), F.when(F.col("op") == "plus", 1 - F.col("x")).otherwise(F.col("x")).alias("p")
        )
        if front.isEmpty():
            break
        solved = solved.unionByName(front)
    else:
        raise ValueError(f"the circuit is deeper than {max_depth} gates, or has a cycle")
    return solved.withColumnRenamed("node", "gate")


def read_once_probabilities(circuit: Circuit, probs: DataFrame, cones: DataFrame | None = None) -> DataFrame:
    """``(root, probability)`` of the read-once answers, by aggregation alone.

    If no node of the whole circuit has two users, all answers are read-once
    and no cone need be built.
    """
    probs = probs.select("token", "p").distinct()
    if cones is None and circuit.fan_out().where("uses > 1").isEmpty():
        values = extensional(circuit.wires, probs)
        roots = circuit.answers.select("root")
        return values.join(roots, values["gate"] == roots["root"]).select("root", F.col("p").alias("probability"))
    cones = circuit.cones() if cones is None else cones
    roots = read_once_roots(cones)
    values = extensional(cones.join(roots, "root", "left_semi"), probs)
    return values.join(roots, values["gate"] == roots["root"]).select("root", F.col("p").alias("probability"))


def gates_of(cone) -> compiling.Gates:
    """Plain gates from a list of wires, children sorted so that any run has the same order."""
    children: dict[str, list[str]] = {}
    ops: dict[str, str] = {}
    ends: dict[str, dict[str, str]] = {}
    for w in cone:
        gate, op, child, role = w["gate"], w["op"], w["child"], w["role"]
        ops[gate] = op
        children.setdefault(gate, [])
        if child is None:
            continue
        if op == "minus":
            if ends.setdefault(gate, {}).setdefault(role, child) != child:
                raise ValueError(f"two {role} gates at {gate}")
        else:
            children[gate].append(child)
    out = {}
    for gate, op in ops.items():
        if op == "minus":
            out[gate] = op, (ends[gate]["minuend"], ends[gate]["subtrahend"])
        else:
            out[gate] = op, tuple(sorted(set(children[gate])))
    return out


def per_root(
    cones: DataFrame, probs: DataFrame | None, work: Callable[[str, compiling.Gates, dict[str, float]], list[tuple]], schema: str
) -> DataFrame:
    """Run ``work(root, gates, p)`` for every answer; its rows, in batches of Arrow."""
    ship(cones.sparkSession)
    wires = cones.groupBy("root").agg(F.collect_list(F.struct("gate", "op", "child", "role")).alias("cone"))
    if probs is not None:
        leaves = cones.select("root", F.col("child").alias("token")).distinct().join(probs, "token")
        weights = leaves.groupBy("root").agg(F.collect_list(F.struct("token", "p")).alias("weights"))
        wires = wires.join(weights, "root", "left")
    else:
        wires = wires.withColumn("weights", F.lit(None).cast("array<struct<token:string,p:double>>"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for root, cone, weights in zip(batch["root"], batch["cone"], batch["weights"]):
                p = {} if weights is None else {w["token"]: w["p"] for w in weights}
                rows += work(root, gates_of(cone), p)
            yield pd.DataFrame(rows, columns=names)

    return wires.mapInPandas(run, schema)


def probabilities(
    circuit: Circuit, probs: DataFrame, mode: str = "per-root", node_limit: int = 2_000_000, worlds: int = 8
) -> DataFrame:
    """Every answer with ``probability``, ``method`` and ``bdd_nodes``.

    ``mode``: ``per-root`` compiles each answer's gates alone, ``shared``
    those of answers that share nodes in one diagram.
    """
    probs = check_probabilities(probs)
    scratch = Scratch(circuit.wires.sparkSession)
    coded = circuit.every.select(short(F.col("gate")).alias("gate"), "op", short(F.col("child")).alias("child"), "role").distinct()
    roots = circuit.answers.select(short(F.col("root")).alias("root"))
    compact = Circuit(scratch.settled(coded, "compact"), roots, ())
    leaves = scratch.settled(compact.leaves(), "leaves")
    known = probs.select(short(F.col("token")).alias("node"), "p").join(leaves.withColumnRenamed("token", "node"), "node", "left_semi")
    known = scratch.settled(known.groupBy("node").agg(F.min("p").alias("p"), F.max("p").alias("most")), "known")
    if not leaves.join(known, leaves["token"] == known["node"], "left_anti").isEmpty():
        require_all(circuit, probs)
    twice = known.where("p < most")
    if not twice.isEmpty():
        names = probs.join(twice.limit(5), short(F.col("token")) == F.col("node"), "left_semi").select("token").distinct()
        raise ValueError(f"more than one probability for {[r['token'] for r in names.collect()]}")
    hard_roots = entangled_roots(compact, scratch)
    values = extensional(compact.wires, known.select(F.col("node").alias("token"), "p"), scratch=scratch)
    roots = scratch.settled(roots, "roots")
    easy = roots if hard_roots is None else roots.join(hard_roots, "root", "left_anti")
    easy = values.join(easy, values["gate"] == easy["root"], "left_semi").select(
        F.col("gate").alias("node"), F.col("p").alias("probability"), F.lit("read-once").alias("method"), F.lit(0).cast("long").alias("bdd_nodes")
    )
    rows = circuit.answers.withColumn("node", short(F.col("root")))
    names = [*[f"`{v}`" for v in circuit.variables], "probability", "method", "bdd_nodes", "root"]
    found = settled(rows.join(easy, "node").select(*names), "read-once")
    if hard_roots is None:
        scratch.drop()
        return found
    hard = rows.join(hard_roots, rows["node"] == hard_roots["root"], "left_semi").drop("node")
    named = Circuit(circuit.wires, hard, circuit.variables).settle()
    scratch.drop()
    hard = settled(named.cones(), "cones")
    schema = "root string, probability double, method string, bdd_nodes long"
    if mode == "shared":
        compiled = _shared(hard, probs, node_limit, schema)
    elif mode == "per-root":

        def work(root, gates, p):
            value, method, nodes = compiling.portfolio(gates, root, p, worlds, node_limit)
            return [(root, value, method, nodes)]

        compiled = per_root(hard, probs, work, schema)
    else:
        raise ValueError(f"mode {mode!r}")
    return found.unionByName(named.answers.join(compiled, "root").select(*names))


def families(cones: DataFrame) -> DataFrame:
    """``(root, family)``: answers that share a node, directly or through others, get the same name."""
    uses = settled(cones.where(F.col("child").isNotNull()).select("root", "child").distinct(), "uses")
    named = cones.select("root", F.col("root").alias("family")).distinct()
    while True:
        by_node = uses.join(named, "root").groupBy("child").agg(F.min("family").alias("low"))
        by_root = uses.join(by_node, "child").groupBy("root").agg(F.min("low").alias("low"))
        again = settled(
            named.join(by_root, "root", "left").select("root", "family", F.least("family", F.coalesce("low", "family")).alias("now")), "families"
        )
        changed = not again.where("now < family").isEmpty()
        named = again.select("root", F.col("now").alias("family"))
        if not changed:
            return named


def _shared(hard: DataFrame, probs: DataFrame, limit: int, schema: str) -> DataFrame:
    family = families(hard)
    joined = hard.join(family, "root")
    wires = joined.select("family", "gate", "op", "child", "role").distinct().withColumnRenamed("family", "root")

    def work(name, gates, p):
        names = sorted(r[1:] for r in gates if r.startswith("\x00"))
        gates = {g: x for g, x in gates.items() if not g.startswith("\x00")}
        diagram = compiling.Diagram(compiling.tokens(gates, names), limit)
        made = diagram.compile(gates, names)
        values = diagram.count(set(made.values()), p)
        return [(r, values[f], "diagram", diagram.size(f)) for r, f in made.items()]

    marks = family.select(
        F.col("family").alias("root"), F.concat(F.lit("\x00"), "root").alias("gate"),
        F.lit("plus").alias("op"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("string").alias("role"),
    )
    return per_root(wires.select("root", "gate", "op", "child", "role").unionByName(marks), probs, work, schema)
