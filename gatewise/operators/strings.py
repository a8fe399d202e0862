"""Provenance strings: one text per answer, for comparison with circuits.

``(⊗a,b,)`` is a product, ``⊕(x y)`` a sum over derivations, ``(⊖a,⊕(b),)`` a
difference.  Blocks, UNION, MINUS and OPTIONAL only; conditions and paths are
refused.  Derivations inside a sum are sorted, so the text does not depend on
the order of rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans import normal as N
from . import compiling
from . import relation as R


def _product(gates: list[Column]) -> Column:
    return F.concat(F.lit("(⊗"), *[x for g in gates for x in (g, F.lit(","))], F.lit(")"))


def _sum(c: Column) -> Column:
    return F.concat(F.lit("⊕("), F.concat_ws(" ", F.array_sort(F.collect_list(c))), F.lit(")"))


@dataclass(frozen=True)
class Texts:
    df: DataFrame
    variables: tuple[str, ...]


def _rows(planner, alternative) -> Texts:
    match alternative:
        case A.Bgp(_, conditions):
            if conditions:
                raise A.UnsupportedFeature("FILTER in provenance strings")
            r = planner.visible(planner.block(alternative), N.scope(alternative))
            df = r.df.withColumn("_prov", _product([F.col(g) for g in r.gates])).drop(*r.gates)
            return Texts(df, r.variables)
        case N.Difference(left, rights):
            a = _rows(planner, left)
            scope = list(a.variables)
            base = a.df.groupBy(*[f"`{v}`" for v in scope]).agg(_sum(F.col("_prov")).alias("_left"))
            parts = []
            for right in rights:
                b = _rows(planner, right)
                shared = [v for v in scope if v in b.variables]
                rows = b.df.select(*[f"`{v}`" for v in shared], "_prov")
                met = base.select(*[f"`{v}`" for v in scope]).join(rows, shared) if shared else base.crossJoin(rows)
                parts.append(met.select(*[f"`{v}`" for v in scope], "_prov"))
            blocked = R.union_frames(parts).groupBy(*[f"`{v}`" for v in scope]).agg(_sum(F.col("_prov")).alias("_right"))
            joined = base.join(blocked, scope, "left") if scope else base.crossJoin(blocked)
            minus = F.concat(F.lit("(⊖"), F.col("_left"), F.lit(","), F.col("_right"), F.lit(",)"))
            return Texts(joined.select(*[f"`{v}`" for v in scope], F.coalesce(minus, F.col("_left")).alias("_prov")), a.variables)
        case N.Product(factors):
            found = None
            for f in factors:
                t = _rows(planner, f)
                t = Texts(t.df.withColumnRenamed("_prov", "_p2"), t.variables)
                if found is None:
                    found = Texts(t.df.withColumnRenamed("_p2", "_prov"), t.variables)
                    continue
                shared = [v for v in found.variables if v in t.variables]
                df = found.df.join(t.df, shared) if shared else found.df.crossJoin(t.df)
                df = df.withColumn("_prov", _product([F.col("_prov"), F.col("_p2")])).drop("_p2")
                found = Texts(df, found.variables + tuple(v for v in t.variables if v not in shared))
            return found
    raise A.UnsupportedFeature("paths and conditions in provenance strings")


def provenance_strings(planner, query: A.Select) -> DataFrame:
    """``(variables..., provenance)``."""
    parts = []
    for alternative in N.normal(query.body):
        t = _rows(planner, alternative)
        columns = [F.col(f"`{v}`") if v in t.variables else F.lit(None).cast("string").alias(v) for v in query.variables]
        parts.append(t.df.select(*columns, "_prov"))
    return R.union_frames(parts).groupBy(*[f"`{v}`" for v in query.variables]).agg(_sum(F.col("_prov")).alias("provenance"))


_TOKEN = re.compile(r"⊕\(|\(⊗|\(⊖|\)|,| ")


def decode(text: str) -> tuple[compiling.Gates, str]:
    """Gates from a provenance string, and the name of its top."""
    gates: compiling.Gates = {}
    at = 0

    def atom() -> str:
        nonlocal at
        m = _TOKEN.search(text, at)
        end = m.start() if m else len(text)
        name = text[at:end]
        at = end
        return name

    def expression() -> str:
        nonlocal at
        for mark, op in (("⊕(", "plus"), ("(⊗", "times"), ("(⊖", "minus")):
            if text.startswith(mark, at):
                start = at
                at += len(mark)
                children = []
                while text[at] != ")":
                    children.append(expression())
                    while at < len(text) and text[at] in ", ":
                        at += 1
                at += 1
                name = text[start:at]
                gates[name] = op, tuple(children)
                return name
        return atom()

    return gates, expression()
