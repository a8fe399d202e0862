"""Queries over certain facts, solution by solution: the definition that circuits are checked against."""

from itertools import product

from gatewise.plans import algebra as A


def compatible(x, y):
    return all(y[k] == v for k, v in x.items() if k in y)


def matches(bgp, triples):
    found = [{}]
    for p in bgp.patterns:
        again = []
        for row in found:
            for t in triples:
                new = dict(row)
                for slot, value in zip(p.slots, t):
                    name = slot if isinstance(slot, str) else None
                    if name is not None:
                        if name != value:
                            break
                    elif new.setdefault(slot.name, value) != value:
                        break
                else:
                    again.append(new)
        found = again
    return found


def truth(c, row):
    value = lambda x: row.get(x.name) if isinstance(x, A.Var) else x
    if c.op == "BOUND":
        return value(c.args[0]) is not None
    a, b = map(value, c.args)
    if a is None or b is None:
        return False
    return a == b if c.op == "=" else a != b


def ends(row, s, o, a, b):
    out = dict(row)
    for slot, value in ((s, a), (o, b)):
        if isinstance(slot, str):
            if slot != value:
                return None
        elif out.setdefault(slot.name, value) != value:
            return None
    return out


def solve(node, triples):
    match node:
        case A.Bgp(_, conditions):
            return [r for r in matches(node, triples) if all(truth(c, r) for c in conditions)]
        case A.Join(a, b):
            right = solve(b, triples)
            return [x | y for x in solve(a, triples) for y in right if compatible(x, y)]
        case A.Union(a, b):
            return solve(a, triples) + solve(b, triples)
        case A.Minus(a, b):
            right = solve(b, triples)
            return [x for x in solve(a, triples) if not any(visible(x).keys() & visible(y).keys() and compatible(visible(x), visible(y)) for y in right)]
        case A.Optional(a, b):
            right = solve(b, triples)
            out = []
            for x in solve(a, triples):
                met = [x | y for y in right if compatible(x, y)]
                out += met or [x]
            return out
        case A.Filter(a, c):
            return [r for r in solve(a, triples) if truth(c, r)]
        case A.Zero(s, o):
            nodes = {t[k] for t in triples for k in (0, 2)}
            return [r for n in nodes if (r := ends({}, s, o, n, n)) is not None]
        case A.Path(s, o, least, step):
            edges = {(r["u"], r["v"]) for r in solve(step, triples)}
            pairs = set(edges)
            while True:
                more = {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs
                if not more:
                    break
                pairs |= more
            if least == 0:
                pairs |= {(t[k], t[k]) for t in triples for k in (0, 2)}
            return [r for a, b in pairs if (r := ends({}, s, o, a, b)) is not None]
    raise TypeError(node)


def visible(row):
    return {k: v for k, v in row.items() if not k.startswith("_anon")}


def answers(query, triples):
    return {tuple(r.get(v) for v in query.variables) for r in solve(query.body, triples)}


def all_worlds(facts):
    for bits in product((0, 1), repeat=len(facts)):
        yield [f for f, b in zip(facts, bits) if b]
