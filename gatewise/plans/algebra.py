"""The algebra of queries.  Nothing here knows Spark."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace

from ..functions.identity import part, parts, sha
from ..functions.terms import rendered


class UnsupportedFeature(Exception):
    """A construct outside the fragment.  Refused rather than answered wrongly."""


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False  #: blank nodes of the query and inner points of paths


Slot = Var | str  #: a variable or a canonical term


@dataclass(frozen=True)
class Pattern:
    s: Slot
    p: Slot
    o: Slot

    @property
    def slots(self) -> tuple[Slot, Slot, Slot]:
        return self.s, self.p, self.o


@dataclass(frozen=True)
class Condition:
    """``op`` applied to conditions, variables and terms."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Bgp:
    patterns: tuple[Pattern, ...]
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Join:
    left: Node
    right: Node


@dataclass(frozen=True)
class Union:
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus:
    """``guarded``: MINUS, which needs a shared variable; otherwise the negative half of OPTIONAL."""

    left: Node
    right: Node
    guarded: bool = True


@dataclass(frozen=True)
class Optional:
    left: Node
    right: Node
    condition: Condition | None = None


@dataclass(frozen=True)
class Filter:
    arg: Node
    condition: Condition


@dataclass(frozen=True)
class Zero:
    """Paths of length zero."""

    s: Slot
    o: Slot


@dataclass(frozen=True)
class Path:
    """Closure of ``step``, which goes from ``Var('u')`` to ``Var('v')``."""

    s: Slot
    o: Slot
    least: int
    step: Node


@dataclass(frozen=True)
class Select:
    variables: tuple[str, ...]
    body: Node


Node = Bgp | Join | Union | Minus | Optional | Filter | Zero | Path

# Step endpoints of a closure.
FROM, TO = Var("u", True), Var("v", True)


def ends(*slots: Slot) -> frozenset[str]:
    return frozenset(x.name for x in slots if isinstance(x, Var) and not x.hidden)


def scope(node: Node) -> frozenset[str]:
    """Variables that the node can bind for what is outside it."""
    match node:
        case Bgp(patterns):
            return frozenset().union(*(ends(*p.slots) for p in patterns))
        case Join(a, b) | Union(a, b) | Optional(a, b):
            return scope(a) | scope(b)
        case Minus(a):
            return scope(a)
        case Filter(a):
            return scope(a)
        case Zero(s, o) | Path(s, o):
            return ends(s, o)
    raise TypeError(node)


def mentioned(condition) -> frozenset[str]:
    if isinstance(condition, Var):
        return frozenset({condition.name})
    if isinstance(condition, Condition):
        return frozenset().union(*map(mentioned, condition.args))
    return frozenset()


INFIX = ("=", "!=", "<", "<=", ">", ">=", "&&", "||", "+", "-", "*", "/")


def written(c) -> str:
    """Query text of a condition."""
    if isinstance(c, Var):
        return f"?{plain(c.name)}"
    if isinstance(c, str):
        return rendered(c)
    args = [written(a) for a in c.args]
    if c.op in INFIX:
        return f"({args[0]} {c.op} {args[1]})"
    if c.op == "!":
        return f"(!{args[0]})"
    return f"{c.op}({', '.join(args)})"


# -- names: columns don't tell X from x, variables do


def plain(name: str) -> str:
    """The variable's name as written."""
    return name.rstrip("'")


def _names(node) -> set[str]:
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, tuple):
        return set().union(*map(_names, node))
    return set().union(*(_names(getattr(node, f.name)) for f in fields(node))) if is_dataclass(node) else set()


def _renamed(node, names: dict[str, str]):
    if isinstance(node, Var):
        return replace(node, name=names.get(node.name, node.name))
    if isinstance(node, tuple):
        return tuple(_renamed(x, names) for x in node)
    if is_dataclass(node):
        return replace(node, **{f.name: _renamed(getattr(node, f.name), names) for f in fields(node)})
    return node


def told_apart(query: Select) -> Select:
    """Names that differ by case alone get primes, all but the first in order; identities and output go by ``plain``."""
    taken: set[str] = set()
    names = {}
    for name in sorted(_names(query.body) | set(query.variables)):
        new = name
        while new.lower() in taken:
            new += "'"
        taken.add(new.lower())
        if new != name:
            names[name] = new
    if not names:
        return query
    return Select(tuple(names.get(v, v) for v in query.variables), _renamed(query.body, names))


# -- keys: what an identity is made from


def slot_key(x: Slot) -> str:
    if isinstance(x, Var):
        return ("X" if x.hidden else "V") + part(plain(x.name))
    return "C" + part(rendered(x))


def bgp_key(node: Bgp) -> str:
    atoms = sorted("SP" + parts(map(slot_key, p.slots)) for p in node.patterns)
    return "BGP" + parts(atoms) + "".join("FLT" + part(c) for c in sorted(map(written, node.conditions)))


def _alternatives(node: Node) -> list[Node]:
    return _alternatives(node.left) + _alternatives(node.right) if isinstance(node, Union) else [node]


def _factors(node: Node) -> list[Node]:
    return _factors(node.left) + _factors(node.right) if isinstance(node, Join) else [node]


def flat(node: Node) -> Bgp | None:
    """One block of patterns and conditions, if the node is no more than that."""
    match node:
        case Bgp():
            return node
        case Join(a, b):
            x, y = flat(a), flat(b)
            return Bgp(x.patterns + y.patterns, x.conditions + y.conditions) if x and y else None
        case Filter(a, c):
            x = flat(a)
            return Bgp(x.patterns, x.conditions + (c,)) if x else None
    return None


def key(node: Node) -> str:
    if (block := flat(node)) is not None:
        return bgp_key(block)
    match node:
        case Union():
            return "UNION" + parts(sorted({key(b) for b in _alternatives(node)}))
        case Minus(a, b):
            return "DIFF" + part(key(a)) + part(key(b))
        case Optional(a, b, c):
            return "OPT" + part(key(a)) + part(key(b)) + ("COND" + part(written(c)) if c else "")
        case Zero(s, o):
            return "ZLP" + part(slot_key(s)) + part(slot_key(o))
        case Path(s, o, least, step):
            return "ALP" + part(str(least)) + part(slot_key(s)) + part(slot_key(o)) + part(key(step))
        case Filter(a, c):
            return "FILTER" + part(key(a)) + part(written(c))
        case Join():
            return "JOIN" + parts(sorted(key(f) for f in _factors(node)))
    raise TypeError(node)


def fingerprint(node: Node) -> str:
    return sha(key(node))


def difference_fingerprint(left: Node, rights: list[Node]) -> str:
    return sha("DIFF|" + part(key(left)) + parts(sorted({key(r) for r in rights})))


def answer_tag(query: Select) -> str:
    return "A@" + sha("ANSWER" + part(key(query.body)) + "|W" + parts(map(plain, query.variables)))
