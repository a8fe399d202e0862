"""Property paths: zero-length paths and closures over uncertain edges.

A closure is built level by level: the gate for (source, node, k) sums over
the walks of exactly k + 1 edges, so the circuit has no cycle whatever the
graph.  Rounds are joins of the last level with the edges; each level is
written down before the next, so plans stay short and lost executors cost one
level.  As many levels are made as the largest number of nodes that a source
reaches, or fewer if a level is empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..plans import algebra as A
from ..plans import normal as N
from ..storage import settled
from . import relation as R


def _mentions(planner) -> R.Relation:
    """Every term as subject or object of a fact, with the fact's token."""
    rows = planner.facts.select("token", F.explode(F.array_distinct(F.array("s", "o"))).alias("_n"))
    return R.scan(rows, F.col("token"), {"_n": F.col("_n")})


def zero_length(planner, s: A.Slot, o: A.Slot) -> R.Relation:
    """Pairs (n, n) for the terms of the graph: true in worlds where some fact mentions the term."""
    found = _mentions(planner)
    found = R.feed(found, ["_n"], identity.SHARED, "ZERO@")
    pairs = R.Relation(
        found.df.select(F.col("_n").alias("_u"), F.col("_n").alias("_v"), *found.gates), ("_u", "_v"), found.gates, found.wires
    )
    return _at_ends(pairs, s, o)


def _at_ends(pairs: R.Relation, s: A.Slot, o: A.Slot) -> R.Relation:
    """Pairs ``(_u, _v)`` with constants applied and variables named."""
    df, bind = pairs.df, {}
    for column, slot in (("_u", s), ("_v", o)):
        if isinstance(slot, str):
            df = df.where(F.col(column) == slot)
        elif slot.name in bind:
            df = df.where(F.col(column) == F.col(bind[slot.name]))
        else:
            bind[slot.name] = column
    columns = [F.col(c).alias(v) for v, c in bind.items()]
    return R.Relation(df.select(*columns, *pairs.gates), tuple(bind), pairs.gates, pairs.wires)


def edges(planner, step: A.Node) -> R.Relation:
    """The step of a closure as pairs ``(u, v)`` with one gate each: alternatives, sequences, nested closures."""
    tag = f"STEP@{A.fingerprint(step)}"
    branches = []
    for alternative in N.normal(step):
        found = planner.relation(alternative)
        direct = not isinstance(alternative, (A.Bgp, N.Product))
        branches.append(R.sum_products(found, ("u", "v"), identity.SHARED, tag, direct))
    df = R.union_frames([b.df.select("u", "v", F.col(b.gates[0]).alias("_e")) for b in branches]).distinct()
    return R.Relation(df, ("u", "v"), ("_e",), sum((b.wires for b in branches), ()))


def ends_of(planner, path: A.Path, siblings: list[A.Bgp]) -> tuple[str, object] | None:
    """The end of a path that a block joined to it binds, the source if both are, and the terms it may be."""
    for end, slot in (("s", path.s), ("o", path.o)):
        for block in siblings:
            if isinstance(slot, A.Var) and slot.name in N.scope(block):
                found = planner.block(block)
                return end, found.df.select(found.column(slot.name).alias("u")).distinct()
    return None


def closure(planner, path: A.Path, bound: tuple[str, object] | None = None) -> R.Relation:
    """``s step+ o`` or ``s step* o`` as a relation with one gate for each pair.

    Walks start from the constant end, else from the terms that ``bound`` has for an end, else, if allowed, from all.
    """
    start = path.s if isinstance(path.s, str) else None
    finish = path.o if isinstance(path.o, str) else None
    constant = start is not None or finish is not None
    backward = start is None and finish is not None or not constant and bound is not None and bound[0] == "o"
    if not constant and bound is None and not planner.unbound_paths:
        raise A.UnsupportedFeature("a closure whose ends neither are constant nor bound: allow unbound paths to build all pairs")
    base = edges(planner, path.step)
    df = base.df
    if backward:  # grow from the constant end, along reversed edges
        df = df.select(F.col("v").alias("u"), F.col("u").alias("v"), "_e")
    pairs = settled(df, "edges")
    if constant:
        sources = planner.facts.sparkSession.createDataFrame([(finish if backward else start,)], "u string")
    else:
        sources = None if bound is None else settled(bound[1], "sources")
    level = pairs.join(sources, "u", "left_semi") if sources is not None else pairs
    level = level.select(F.col("u").alias("s"), F.col("v").alias("n"), F.col("_e").alias("g"))
    wires = list(base.wires)
    key = A.fingerprint(A.Path(A.FROM, A.TO, 1, path.step)) + ("<" if backward else ">")
    seen, rounds = _reach(pairs, level)
    if sources is not None:  # only edges out of reached nodes matter
        pairs = pairs.join(seen.select(F.col("n").alias("u")).unionByName(level.select(F.col("s").alias("u"))).distinct(), "u", "left_semi")
    levels = [level]
    for k in range(1, rounds):
        met = level.join(pairs, level["n"] == pairs["u"]).select("s", F.col("v").alias("n"), "g", "_e")
        summed = R.sum_products(R.Relation(met, ("s", "n"), ("g", "_e")), ("s", "n"), identity.REACH, f"R|{key}|{k}", settle=True)
        level = summed.df.select("s", "n", F.col(summed.gates[0]).alias("g"))
        wires += summed.wires
        if level.isEmpty():
            break
        levels.append(level)
    every = R.union_frames(levels)
    if path.least == 0:
        zero = R.feed(_mentions(planner), ["_n"], identity.SHARED, "ZERO@")
        wires += zero.wires
        here = zero.df.select(F.col("_n").alias("s"), F.col("_n").alias("n"), F.col(zero.gates[0]).alias("g"))
        if sources is not None:
            here = here.join(sources.select(F.col("u").alias("s")), "s", "left_semi")
        every = every.unionByName(here)
    total = R.feed(R.Relation(every, ("s", "n"), ("g",)), ("s", "n"), identity.REACH, f"R|{key}|all|{path.least}")
    columns = ("n", "s") if backward else ("s", "n")
    out = total.df.select(F.col(columns[0]).alias("_u"), F.col(columns[1]).alias("_v"), *total.gates)
    return _at_ends(R.Relation(out, ("_u", "_v"), total.gates, (*wires, *total.wires)), path.s, path.o)


def _reach(pairs, level):
    """Certain reachability by breadth-first search: ``(s, n)`` pairs, and the most nodes any source reaches."""
    seen = settled(level.select("s", "n").distinct(), "reach")
    front = seen
    while not front.isEmpty():
        further = front.join(pairs, front["n"] == pairs["u"]).select("s", F.col("v").alias("n")).distinct()
        front = settled(further.join(seen, ["s", "n"], "left_anti"), "front")
        seen = settled(seen.unionByName(front), "reach") if not front.isEmpty() else seen
    most = seen.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    return seen, most + 1


def levels(planner, path: A.Path):
    """Certain ``(s, n, level)``: the walks of exactly ``level`` edges that the circuit has gates for."""
    pairs = settled(edges(planner, path.step).df.select("u", "v").distinct(), "edges")
    level = pairs.where(F.col("u") == path.s) if isinstance(path.s, str) else pairs
    level = level.select(F.col("u").alias("s"), F.col("v").alias("n"))
    _, rounds = _reach(pairs, level)
    out = [level.withColumn("level", F.lit(1))]
    for k in range(2, rounds + 1):
        level = settled(level.join(pairs, level["n"] == pairs["u"]).select("s", F.col("v").alias("n")).distinct(), "level")
        if level.isEmpty():
            break
        out.append(level.withColumn("level", F.lit(k)))
    return R.union_frames(out)
