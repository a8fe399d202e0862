"""Attribution: Shapley values of facts, and why an answer may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled
from . import compiling
from .circuit import Circuit
from .probability import per_root


def shapley(circuit: Circuit, node_limit: int = 2_000_000) -> DataFrame:
    """``(variables..., token, numerator, denominator, value)``: exact share of each fact in each answer."""

    def work(root, gates, _):
        found = compiling.shapley(gates, root, node_limit)
        return [(root, t, str(x.numerator), str(x.denominator), float(x)) for t, x in found.items()]

    values = per_root(circuit.cones(), None, work, "root string, token string, numerator string, denominator string, value double")
    return circuit.answers.join(values, "root")


def why_not(circuit: Circuit) -> DataFrame:
    """``(variables..., token)``: facts below a subtrahend of the answer; their presence can remove it."""
    cones = settled(circuit.cones(), "cones")
    inner = cones.select("root", "gate").distinct()
    below = settled(cones.where("role = 'subtrahend'").select("root", F.col("child").alias("node")).distinct(), "below")
    front = below
    while not front.isEmpty():
        edges = cones.where(F.col("child").isNotNull()).select("root", F.col("gate").alias("node"), "child")
        further = front.join(edges, ["root", "node"]).select("root", F.col("child").alias("node")).distinct()
        front = settled(further.join(below, ["root", "node"], "left_anti"), "front")
        below = settled(below.unionByName(front), "below")
    tokens = below.join(inner.withColumnRenamed("gate", "node"), ["root", "node"], "left_anti")
    return circuit.answers.join(tokens.withColumnRenamed("node", "token"), "root").drop("root")


def players(circuit: Circuit) -> DataFrame:
    """``(root, token)``: the facts that an answer depends on."""
    cones = settled(circuit.cones(), "cones")
    inner = cones.select("root", F.col("gate").alias("token")).distinct()
    leaves = cones.where(F.col("child").isNotNull()).select("root", F.col("child").alias("token")).distinct()
    return leaves.join(inner, ["root", "token"], "left_anti")


def monomials(circuit: Circuit) -> DataFrame:
    """``(root, product)``: the flat sum of products of answers without difference; products are sorted token lists."""

    def work(root, gates, _):
        value: dict[str, set[frozenset[str]]] = {}
        for node in compiling.topological(gates, [root]):
            if node not in gates:
                value[node] = {frozenset({node})}
                continue
            op, children = gates[node]
            if op == "minus":
                raise ValueError("a difference has no sum of products")
            if op == "plus":
                value[node] = set().union(*(value[c] for c in children))
            else:
                got = {frozenset()}
                for c in children:
                    got = {a | b for a in got for b in value[c]}
                value[node] = got
        return [(root, ",".join(sorted(m))) for m in value[root]]

    return per_root(circuit.cones(), None, work, "root string, product string")


def naive(circuit: Circuit, probs: DataFrame) -> DataFrame:
    """Probabilities that take derivations for independent: wrong where facts are shared, kept for contrast."""

    def work(root, gates, p):
        return [(root, compiling.independent(gates, root, p))]

    values = per_root(circuit.cones(), probs, work, "root string, probability double")
    return circuit.answers.join(values, "root").drop("root")


def cnf(circuit: Circuit, probs: DataFrame) -> DataFrame:
    """``(root, n_vars, n_clauses, dimacs)``: weighted CNF of each answer."""

    def work(root, gates, p):
        n, clauses, _ = compiling.cnf(gates, root, p)
        return [(root, n, len(clauses), compiling.dimacs(gates, root, p))]

    return per_root(circuit.cones(), probs, work, "root string, n_vars long, n_clauses long, dimacs string")
