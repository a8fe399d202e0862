"""Probabilities without circuits, for plans that stay independent.

A weighted relation carries a probability per row.  Joining rows of different
tables multiplies, summing out variables combines by 1 - ∏(1 - p); the result
is exact if no two rows that meet in a sum or product share a token.  Every
relation therefore knows which variables tell its rows apart and which tables'
tokens stand in one row only, and a sum over rows that may share a token is
refused.  For a conjunction of row patterns without repeated tables there is an
order that passes exactly when the query is hierarchical; ``plan`` checks that
and finds it.  What is refused has its answer from a circuit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import UnsupportedFeature


@dataclass(frozen=True)
class Weighted:
    df: DataFrame
    variables: tuple[str, ...]
    #: which tables' tokens the rows depend on
    tables: frozenset[str]
    #: those whose token is in one row at most
    once: frozenset[str] = frozenset()
    #: variables that no two rows agree on, if known
    key: frozenset[str] | None = None


def rows(
    table: DataFrame, name: str, bind: dict[str, Column], p: Column, keep: Column | None = None, key: tuple[str, ...] | None = None
) -> Weighted:
    """Rows of a table with probability ``p``; equal bindings stay apart.  ``key``: variables that tell rows apart."""
    kept = table if keep is None else table.where(keep)
    df = kept.select(*[c.alias(v) for v, c in bind.items()], p.alias("_p"))
    return Weighted(df, tuple(bind), frozenset({name}), frozenset({name}), None if key is None else frozenset(key))


def _disjoint(a: Weighted, b: Weighted) -> None:
    if a.tables & b.tables:
        raise UnsupportedFeature(f"both sides depend on {sorted(a.tables & b.tables)}: not independent")


def join(a: Weighted, b: Weighted) -> Weighted:
    _disjoint(a, b)
    shared = [v for v in a.variables if v in b.variables]
    right = b.df.withColumnRenamed("_p", "_q")
    df = a.df.join(right, shared) if shared else a.df.crossJoin(right)
    names = a.variables + tuple(v for v in b.variables if v not in shared)
    one_b, one_a = (x.key is not None and x.key <= set(shared) for x in (b, a))  # a row meets one row at most there
    once = (a.once if one_b else frozenset()) | (b.once if one_a else frozenset())
    key = a.key if one_b else b.key if one_a else None if None in (a.key, b.key) else a.key | b.key
    return Weighted(df.withColumn("_p", F.col("_p") * F.col("_q")).drop("_q"), names, a.tables | b.tables, once, key)


def either(c: Column) -> Column:
    """Probability that one of independent events happens."""
    return 1 - F.product(1 - c)


def project(a: Weighted, names: tuple[str, ...]) -> Weighted:
    """Rows that agree on ``names`` become one; refused if some of them may share a token."""
    alone = a.key is not None and a.key <= set(names)
    if not alone and not a.tables <= a.once:
        raise UnsupportedFeature(f"rows that agree on {names} may share tokens of {sorted(a.tables - a.once)}: use the circuit")
    df = a.df.groupBy(*names).agg(either(F.col("_p")).alias("_p"))
    return Weighted(df, names, a.tables, a.once if alone else a.tables, a.key if alone else frozenset(names))


def minus(a: Weighted, b: Weighted) -> Weighted:
    """Every row of ``a``, times the probability that no matching row of ``b`` is there."""
    _disjoint(a, b)
    shared = tuple(v for v in a.variables if v in b.variables)
    if not shared:
        return a
    blocked = project(b, shared).df.withColumnRenamed("_p", "_q")
    df = a.df.join(blocked, list(shared), "left")
    once = a.once | (b.tables if a.key is not None and a.key <= set(shared) else frozenset())
    df = df.withColumn("_p", F.col("_p") * (1 - F.coalesce("_q", F.lit(0.0)))).drop("_q")
    return Weighted(df, a.variables, a.tables | b.tables, once, a.key)


def optional(a: Weighted, b: Weighted) -> DataFrame:
    """Extended rows with a∧b and bare rows with a∧¬b, in one frame with column ``_p``."""
    both = join(a, b)
    shared = tuple(v for v in a.variables if v in b.variables)
    if shared:
        bare = minus(a, b)
    else:  # without a shared variable any row of b rules the bare row out
        none = b.df.agg(F.coalesce(F.product(1 - F.col("_p")), F.lit(1.0)).alias("_q"))
        df = a.df.crossJoin(F.broadcast(none)).withColumn("_p", F.col("_p") * F.col("_q")).drop("_q")
        bare = Weighted(df, a.variables, a.tables | b.tables)
    return both.df.unionByName(bare.df, allowMissingColumns=True)


def union(a: Weighted, b: Weighted, names: tuple[str, ...]) -> Weighted:
    _disjoint(a, b)
    df = project(a, names).df.unionByName(project(b, names).df).groupBy(*names).agg(either(F.col("_p")).alias("_p"))
    tables = a.tables | b.tables
    return Weighted(df, names, tables, tables, frozenset(names))


def hierarchical(scopes: list[frozenset[str]], head: frozenset[str]) -> bool:
    """Whether for any two summed-out variables the patterns with the one hold those with the other, or none of them."""
    inner = set().union(*scopes) - head
    where = {v: {k for k, s in enumerate(scopes) if v in s} for v in inner}
    return all(
        where[x] <= where[y] or where[y] <= where[x] or not where[x] & where[y] for x in inner for y in inner
    )


def plan(patterns: list[Weighted], head: tuple[str, ...]) -> Weighted:
    """The conjunction's answers over ``head``, each with its exact probability."""
    scopes = [frozenset(p.variables) for p in patterns]
    names = [t for p in patterns for t in p.tables]
    if len(names) != len(set(names)) or not hierarchical(scopes, frozenset(head)):
        raise UnsupportedFeature("not hierarchical, or a table twice: use the circuit")
    alone = [p if p.key is not None else project(p, p.variables) for p in patterns]
    return project(_safe(alone, frozenset(head)), head)


def _safe(patterns: list[Weighted], keep: frozenset[str]) -> Weighted:
    """Sum a variable out as soon as all patterns that hold it are joined."""
    todo = list(patterns)
    while True:
        inner = set().union(*(p.variables for p in todo)) - keep
        if not inner:
            return reduce(join, todo)
        holders = {v: [p for p in todo if v in p.variables] for v in inner}
        v = min(inner, key=lambda x: (len(holders[x]), x))
        joined = reduce(join, holders[v])
        here = {x for x in inner if all(p in holders[v] for p in holders[x])}
        names = tuple(x for x in joined.variables if x not in here)
        todo = [p for p in todo if p not in holders[v]] + [project(joined, names)]
