"""From normal form to annotated relations and circuits."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conditions, identity
from ..operators import circuit as C
from ..operators import paths
from ..operators import relation as R
from ..storage import Scratch
from . import algebra as A
from . import normal as N

FLAT, FACTORED = "flat", "factored"


@dataclass(frozen=True)
class Planner:
    """``facts(token, s, p, o)`` of canonical terms; ``mode``: flat or factored blocks."""

    facts: DataFrame
    mode: str = FACTORED
    unbound_paths: bool = False
    restrict: bool = True
    settle: bool = True  #: write intermediate sums down instead of evaluating them for every reader

    # -- patterns

    def atom(self, pattern: A.Pattern) -> R.Relation:
        rows, bind = self.facts, {}
        for name, slot in zip("spo", pattern.slots):
            c = F.col(name)
            if isinstance(slot, str):
                rows = rows.where(c == slot)
            elif slot.name in bind:
                rows = rows.where(bind[slot.name] == c)
            else:
                bind[slot.name] = c
        return R.scan(rows, F.col("token"), bind)

    def block(self, bgp: A.Bgp) -> R.Relation:
        """All matches, one gate for each pattern; patterns are joined along shared variables."""
        if not bgp.patterns:
            return R.one(self.facts.sparkSession)
        todo = list(bgp.patterns)
        todo.sort(key=lambda p: sum(isinstance(x, A.Var) for x in p.slots))
        relation = self.atom(todo.pop(0))
        while todo:
            linked = [p for p in todo if {x.name for x in p.slots if isinstance(x, A.Var)} & set(relation.variables)]
            chosen = (linked or todo)[0]
            todo.remove(chosen)
            relation = R.join(relation, self.atom(chosen))
        return self.keep(relation, bgp.conditions)

    @staticmethod
    def keep(relation: R.Relation, found) -> R.Relation:
        env = {v: relation.column(v) for v in relation.variables}
        for c in found:
            relation = R.where(relation, conditions.truth(c, env))
        return relation

    # -- factored blocks

    def reduced(self, bases: list[R.Relation], scratch: Scratch) -> list[R.Relation]:
        """Bases without the rows that nothing else can meet, in semi-joins along shared variables.

        They start from the bases with the fewest variables, which constants have bound, and go out from there, back, and
        out once more where a base has several neighbours.
        """
        order, over, todo = [], {}, sorted(range(len(bases)), key=lambda k: len(bases[k].variables))
        while todo:
            near = [(k, j) for k in todo for j in order if set(bases[k].variables) & set(bases[j].variables)]
            k, j = near[0] if near else (todo[0], None)
            order.append(k)
            over[k] = j
            todo.remove(k)
        links = [(k, over[k]) for k in order if over[k] is not None]
        turns = [*links, *((j, k) for k, j in reversed(links))]
        if any(sum(j == x for _, j in links) > 1 for x in order):
            turns += links
        bases = list(bases)
        for at, (k, j) in enumerate(turns):
            smaller = R.reduce_to(bases[k], bases[j])
            if self.settle and any(k in turn for turn in turns[at + 1 :]):
                smaller = replace(smaller, df=scratch.settled(smaller.df, "reduced"))
            bases[k] = smaller
        return bases

    def eliminated(self, bgp: A.Bgp, names: frozenset[str]) -> R.Relation:
        """The block with every variable outside ``names`` summed out, smallest scopes first.

        Each base relation sums the tokens of one pattern's matches; joining
        is a binary product, summing out a variable a sum over its groups.
        """
        key = A.fingerprint(bgp)
        bases = [self.atom(p) for p in sorted(bgp.patterns, key=lambda p: tuple(map(A.slot_key, p.slots)))]
        scratch = Scratch(self.facts.sparkSession)
        if self.restrict and any(isinstance(x, str) for p in bgp.patterns for x in (p.s, p.o)):
            bases = self.reduced(bases, scratch)
        todo = [R.feed(b, sorted(b.variables), identity.SHARED, f"BASE@{key}@{i}", self.settle) for i, b in enumerate(bases)]
        scratch.drop()
        step = 0
        while True:
            inner = {v for r in todo for v in r.variables} - names
            if not inner:
                break
            reach = {v: set().union(*(r.variables for r in todo if v in r.variables)) for v in inner}
            v = min(inner, key=lambda x: (len(reach[x]), x))
            mine = [r for r in todo if v in r.variables]
            joined = mine[0]
            for k, other in enumerate(mine[1:], 2):
                joined = R.join(joined, other) if k == len(mine) else R.product(R.join(joined, other))
            step += 1
            left = sorted(set(joined.variables) - {v})
            tag = f"MARG@{key}@{step}@{'.'.join(sorted(reach[v]))}"
            merged = R.sum_products(joined, left, identity.SHARED, tag, direct=True, settle=self.settle)
            todo = [r for r in todo if v not in r.variables] + [merged]
        return reduce(R.join, todo)

    def summed(self, bgp: A.Bgp, names: frozenset[str]) -> tuple[R.Relation, bool]:
        """The block for a sum over ``names``, and whether its gate feeds that sum directly."""
        hidden = {x.name for p in bgp.patterns for x in p.slots if isinstance(x, A.Var)} - names
        if self.mode == FACTORED and bgp.patterns and not bgp.conditions and hidden:
            return self.eliminated(bgp, names), True
        return self.block(bgp), False

    # -- alternatives

    def relation(self, alternative) -> R.Relation:
        match alternative:
            case A.Bgp():
                return self.block(alternative)
            case A.Zero(s, o):
                return paths.zero_length(self, s, o)
            case A.Path():
                return paths.closure(self, alternative)
            case N.Kept(arg, condition):
                return self.keep(self.relation(arg), [condition])
            case N.Product(factors):
                blocks = [f for f in factors if isinstance(f, A.Bgp)]
                return reduce(R.join, [self.factor(f, blocks) for f in factors])
            case N.Difference(left, rights, source, right_sources):
                base, direct = self.operand(left)
                others = [(*self.operand(r), A.fingerprint(s)) for r, s in zip(rights, right_sources)]
                return R.difference(
                    base,
                    [(r, key, plain) for r, plain, key in others],
                    A.fingerprint(source),
                    A.difference_fingerprint(source, list(right_sources)),
                    direct,
                    self.restrict,
                    self.settle,
                )
        raise TypeError(alternative)

    def factor(self, alternative, blocks: list[A.Bgp]) -> R.Relation:
        """A factor of a product: blocks give their tokens, others one gate; ``blocks`` bind the ends of paths."""
        if isinstance(alternative, A.Path):
            found = paths.closure(self, alternative, paths.ends_of(self, alternative, blocks))
        else:
            found = self.relation(alternative)
        return found if isinstance(alternative, A.Bgp) else self.visible(R.single(found))

    def operand(self, alternative) -> tuple[R.Relation, bool]:
        """Over the visible variables only; hidden ones are summed out by the gate that reads it."""
        if isinstance(alternative, A.Bgp):
            found, direct = self.summed(alternative, N.scope(alternative))
        else:
            found, direct = self.relation(alternative), not isinstance(alternative, N.Product)
        return self.visible(found, N.scope(alternative)), direct

    @staticmethod
    def visible(relation: R.Relation, names: frozenset[str] | None = None) -> R.Relation:
        keep = tuple(v for v in relation.variables if names is None or v in names)
        if keep == relation.variables:
            return relation
        df = relation.df.select(*[f"`{v}`" for v in keep], *relation.gates)
        return R.Relation(df, keep, relation.gates, relation.wires)

    def circuit(self, query: A.Select) -> C.Circuit:
        branches = []
        for alternative in N.normal(query.body):
            if isinstance(alternative, A.Bgp):
                branches.append(self.summed(alternative, frozenset(query.variables)))
            else:
                branches.append((self.relation(alternative), not isinstance(alternative, N.Product)))
        return C.answers(branches, query.variables, A.answer_tag(query))


def row_pattern(
    table: DataFrame, token: Column, bind: dict[str, Column], keep: Column | None = None
) -> R.Relation:
    """Rows of a table as uncertain facts: one leaf per row.  Filters and columns reach the scan."""
    rows = table if keep is None else table.where(keep)
    return R.scan(rows, token, {v: c.cast("string") for v, c in bind.items()})
