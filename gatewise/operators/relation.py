"""Annotated relations: rows of bindings, each with the gates it derives from.

A relation's rows are derivations: variables as columns, and one column for
each gate whose product the row stands for.  Operators are lazy compositions
of DataFrame joins and aggregations; next to the rows each collects *wires*,
the frames that describe the gates it makes.  Wires are evaluated only when a
circuit is asked for.

Two rules make this differ from joins over certain data: MINUS keeps every
left row, under a difference gate, and OPTIONAL yields both the extended and
the bare row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..storage import settled

_serial = count()
#: Roles of a wire from ``child`` to ``gate``.
FACTOR, FEED, MINUEND, SUBTRAHEND = "in", "feeds", "minuend", "subtrahend"


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    variables: tuple[str, ...]
    gates: tuple[str, ...]
    wires: tuple[DataFrame, ...] = ()

    def column(self, v: str) -> Column:
        return F.col(f"`{v}`")

    def bindings(self, names) -> dict[str, Column]:
        have = set(self.variables)
        return {v: self.column(v) if v in have else F.lit(None).cast("string") for v in names}


def scan(rows: DataFrame, token: Column, bind: dict[str, Column]) -> Relation:
    """One leaf per row, named by ``token``; ``bind`` gives the variables."""
    gate = f"_g{next(_serial)}"
    df = rows.select(*[c.alias(v) for v, c in bind.items()], token.alias(gate))
    df = df.dropna(subset=[f"`{v}`" for v in bind]) if bind else df
    return Relation(df, tuple(bind), (gate,))


def one(spark: SparkSession) -> Relation:
    """The relation of the empty pattern: one row, no variable, no gate."""
    return Relation(spark.range(1).select(), (), ())


def join(a: Relation, b: Relation) -> Relation:
    """Natural join; without a shared variable every row meets every row, as the algebra has it."""
    shared = [v for v in a.variables if v in b.variables]
    right = b.df
    for g in set(a.gates) & set(b.gates):
        fresh = f"_g{next(_serial)}"
        right = right.withColumnRenamed(g, fresh)
        b = replace(b, gates=tuple(fresh if x == g else x for x in b.gates))
    df = a.df.join(right, shared) if shared else a.df.crossJoin(right)
    names = a.variables + tuple(v for v in b.variables if v not in shared)
    return Relation(df, names, a.gates + b.gates, a.wires + b.wires)


def reduce_to(a: Relation, b: Relation) -> Relation:
    """Rows of ``a`` that some row of ``b`` can meet."""
    shared = [v for v in a.variables if v in b.variables]
    if not shared:
        return a
    return replace(a, df=a.df.join(b.df.select(*[f"`{v}`" for v in shared]).distinct(), shared, "left_semi"))


def where(a: Relation, condition: Column) -> Relation:
    return replace(a, df=a.df.where(condition))


def _wire(gate: Column, op: str, child: Column | None, role: str | None) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        gate.alias("gate"), F.lit(op).alias("op"),
        (empty if child is None else child).alias("child"), F.lit(role).cast("string").alias("role"),
    )


def wires(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def product(a: Relation) -> Relation:
    """One gate per row: the product of the row's gates."""
    gate = f"_g{next(_serial)}"
    children = [F.col(g) for g in a.gates]
    df = a.df.withColumn(gate, identity.product(children))
    made = wires(df, *[_wire(F.col(gate), "times", c, FACTOR) for c in children]) if children else wires(
        df, _wire(F.col(gate), "times", None, None)
    )
    return Relation(df.drop(*a.gates), a.variables, (gate,), (*a.wires, made))


def single(a: Relation) -> Relation:
    """A relation with one gate column; several gates become a product."""
    return a if len(a.gates) == 1 else product(a)


def feed(a: Relation, names, prefix: str, tag: str, settle: bool = False) -> Relation:
    """Sums: one gate per binding of ``names``, fed by the gates of the rows that have it.

    ``settle`` evaluates the rows once and writes them down, for relations
    that both wires and later operators read.
    """
    return _sums(a, names, prefix, tag, False, settle)


def sum_products(
    a: Relation, names, prefix: str, tag: str, direct: bool = False, settle: bool = False
) -> Relation:
    """Sums over the rows' products; ``direct`` feeds the only gate of a row without a product around it."""
    return _sums(a, names, prefix, tag, not (direct and len(a.gates) == 1), settle)


def _sums(a: Relation, names, prefix: str, tag: str, multiply: bool, settle: bool) -> Relation:
    gate, times = f"_g{next(_serial)}", f"_g{next(_serial)}"
    have = [v for v in names if v in a.variables]
    rows = a.df.select(*[f"`{v}`" for v in have], *a.gates)
    if settle:  # without the new names, which are long and follow from the row
        rows = settled(rows, "sums")
    named = rows.withColumn(gate, identity.keyed(prefix, tag, a.bindings(names)))
    if multiply:
        named = named.withColumn(times, identity.product([F.col(g) for g in a.gates]))
    if multiply:
        made = [_wire(F.col(times), "times", F.col(g), FACTOR) for g in a.gates] or [_wire(F.col(times), "times", None, None)]
        made.append(_wire(F.col(gate), "plus", F.col(times), FEED))
    else:
        made = [_wire(F.col(gate), "plus", F.col(g), FEED) for g in a.gates]
    groups = rows.select(*[f"`{v}`" for v in have]).distinct().withColumn(gate, identity.keyed(prefix, tag, a.bindings(names)))
    return Relation(groups, tuple(have), (gate,), (*a.wires, wires(named, *made)))


def rename(a: Relation, names: dict[str, str]) -> Relation:
    df = a.df
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    return replace(a, df=df, variables=tuple(names.get(v, v) for v in a.variables))


def difference(
    left: Relation,
    rights: list[tuple[Relation, str, bool]],
    left_key: str,
    fingerprint: str,
    direct: bool = False,
    restrict: bool = True,
    settle: bool = False,
) -> Relation:
    """Every binding of ``left`` under a difference gate.

    ``rights``: relations with the fingerprint of each and whether it feeds
    its sum directly.  A right row counts against the left rows it agrees with
    on shared variables (against all if there are none).
    """
    scope = sorted(left.variables)
    kept = sum_products(left, scope, identity.MINUEND, f"P1@{left_key}", direct, settle)
    made = list(kept.wires)
    for right, key, plain in rights:
        shared = [v for v in scope if v in right.variables]
        near = reduce_to(right, kept) if shared and restrict else right
        summed = sum_products(near, sorted(right.variables), identity.SUBTRAHEND, f"P2@{key}", plain, settle)
        made += summed.wires
        keyed = kept.df.select(*[f"`{v}`" for v in scope])
        pairs = keyed.join(summed.df, shared) if shared else keyed.crossJoin(summed.df)
        sub = identity.keyed(identity.SUB, f"SUB@{fingerprint}", {v: F.col(f"`{v}`") for v in scope})
        made.append(wires(pairs, _wire(sub, "plus", F.col(summed.gates[0]), FEED)))
    gate = f"_g{next(_serial)}"
    bindings = {v: F.col(f"`{v}`") for v in scope}
    sub = identity.keyed(identity.SUB, f"SUB@{fingerprint}", bindings)
    df = kept.df.withColumn(gate, identity.keyed(identity.MINUS, f"M@{fingerprint}", bindings))
    made.append(
        wires(
            df,
            _wire(F.col(gate), "minus", F.col(kept.gates[0]), MINUEND),
            _wire(F.col(gate), "minus", sub, SUBTRAHEND),
            _wire(sub, "plus", None, None),
        )
    )
    return Relation(df.drop(*kept.gates), tuple(scope), (gate,), tuple(made))


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
