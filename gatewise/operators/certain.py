"""Answers over certain facts: the query as anti-joins and left joins, without provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import algebra as A
from ..plans import normal as N
from . import relation as R


def _rows(planner, alternative) -> R.Relation:
    match alternative:
        case N.Difference(left, rights):
            a = _rows(planner, left)
            for right in rights:
                b = _rows(planner, right)
                shared = [v for v in a.variables if v in b.variables]
                if shared:
                    a = R.Relation(a.df.join(b.df.select(*shared).distinct(), shared, "left_anti"), a.variables, ())
                else:
                    some = b.df.limit(1).select(F.lit(1).alias("_some"))
                    a = R.Relation(a.df.join(some, F.lit(True), "left_anti"), a.variables, ())
            return a
        case N.Product(factors):
            return reduce(R.join, [_rows(planner, f) for f in factors])
        case N.Kept(arg, condition):
            return planner.keep(_rows(planner, arg), [condition])
    found = planner.relation(alternative)
    df = found.df.select(*[f"`{v}`" for v in found.variables]).distinct()
    return R.Relation(df, found.variables, ())


def answers(planner, query: A.Select) -> DataFrame:
    parts = []
    for alternative in N.normal(query.body):
        r = _rows(planner, alternative)
        columns = [F.col(f"`{v}`") if v in r.variables else F.lit(None).cast("string").alias(v) for v in query.variables]
        parts.append(r.df.select(*columns))
    return R.union_frames(parts).distinct()
