"""Filter conditions as columns.

An error is NULL, so SQL's three-valued logic is the query language's: a row
stays only if the condition is true.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Condition, UnsupportedFeature, Var
from . import terms

BOOLEAN = terms.XSD + "boolean"
DATE_TIME = terms.XSD + "dateTime"


def _once(function, args: list, env: dict[str, Column]) -> Column:
    """``function`` of the arguments' terms; what is computed is computed once, however often the function reads it."""
    found = [value(a, env) for a in args]
    if not any(isinstance(a, Condition) for a in args):
        return function(*found)
    named = F.struct(*[c.alias(f"a{k}") for k, c in enumerate(found)])
    return F.get(F.transform(F.array(named), lambda r: function(*[r[f"a{k}"] for k in range(len(found))])), 0)


def truth(c, env: dict[str, Column]) -> Column:
    """The effective boolean value."""
    if isinstance(c, Condition):
        if c.op == "&&":
            return truth(c.args[0], env) & truth(c.args[1], env)
        if c.op == "||":
            return truth(c.args[0], env) | truth(c.args[1], env)
        if c.op == "!":
            return ~truth(c.args[0], env)
        if c.op == "BOUND":
            return value(c.args[0], env).isNotNull()
        if c.op in ("=", "!=", "<", "<=", ">", ">="):
            return _once(partial(compare, c.op), c.args, env)
        if c.op in _TESTS:
            return _once(_TESTS[c.op], c.args, env)
    return _once(_effective, [c], env)


def _effective(v: Column) -> Column:
    number = terms.lex(v).try_cast("double")
    return (
        F.when(terms.datatype(v) == BOOLEAN, terms.lex(v).isin("true", "1"))
        .when(terms.is_numeric(v), (number != 0) & ~F.isnan(number))
        .when(terms.datatype(v).isin(terms.STRING, terms.LANG_STRING), terms.lex(v) != "")
    )


def value(c, env: dict[str, Column]) -> Column:
    """A term, or NULL."""
    if isinstance(c, Var):
        return env.get(c.name, F.lit(None).cast("string"))
    if isinstance(c, str):
        return F.lit(c)
    if c.op in ("+", "-", "*", "/"):
        return _once(partial(_arithmetic, c.op), c.args, env)
    if c.op == "STR":
        return _once(lambda v: F.when(~v.startswith("_:"), _string(terms.lex(v))), c.args, env)
    if c.op == "LANG":
        return _once(lambda v: _string(terms.lang(v)), c.args, env)
    if c.op == "DATATYPE":
        return _once(lambda v: F.concat(F.lit("<"), terms.datatype(v), F.lit(">")), c.args, env)
    if c.op in ("&&", "||", "!", "BOUND", "=", "!=", "<", "<=", ">", ">=", *_TESTS):
        return F.concat(F.lit('"'), truth(c, env).cast("string"), F.lit(f'"^^<{BOOLEAN}>'))
    raise UnsupportedFeature(f"the function {c.op}")


def _string(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit(f'"^^<{terms.STRING}>'))


FLOATING = [terms.XSD + "double", terms.XSD + "float"]
#: Digits before and after the point that decimals are compared with, and multiplied with.
WIDE, HALF = "decimal(38,18)", "decimal(19,9)"


def _numbers(a: Column, b: Column, apply) -> Column:
    """``apply`` on two numbers: exactly for integers up to 38 digits and decimals that fit, as doubles otherwise."""
    x, y = terms.lex(a), terms.lex(b)
    floating = terms.datatype(a).isin(FLOATING) | terms.datatype(b).isin(FLOATING)
    whole = ~terms.datatype(a).isin(terms.XSD + "decimal") & ~terms.datatype(b).isin(terms.XSD + "decimal")
    cast = lambda kind: (x.try_cast(kind), y.try_cast(kind))
    fits = lambda kind: cast(kind)[0].isNotNull() & cast(kind)[1].isNotNull()
    return (
        F.when(floating, apply(*cast("double")))
        .when(whole & fits("decimal(38,0)"), apply(*cast("decimal(38,0)")))
        .when(fits(WIDE), apply(*cast(WIDE)))
        .otherwise(apply(*cast("double")))
    )


def compare(op: str, a: Column, b: Column) -> Column:
    apply = {
        "=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
        "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    }[op]
    x, y = terms.lex(a), terms.lex(b)
    kinds = terms.datatype(a), terms.datatype(b)
    both = lambda kind: (kinds[0] == kind) & (kinds[1] == kind)
    when = lambda c: F.coalesce(c.try_cast("timestamp"))
    out = (
        F.when(terms.is_numeric(a) & terms.is_numeric(b), _numbers(a, b, apply))
        .when(both(terms.STRING), apply(x, y))
        .when(both(BOOLEAN), apply(x.isin("true", "1").cast("int"), y.isin("true", "1").cast("int")))
        .when(both(DATE_TIME) & when(x).isNotNull() & when(y).isNotNull(), apply(when(x), when(y)))
    )
    if op in ("=", "!="):
        same = a == b
        # Equal terms are equal; unequal literals of kinds that have no order here may still be equal: an error.
        unlike = terms.is_literal(a) & terms.is_literal(b) & ~(both(terms.LANG_STRING)) & ~(
            kinds[0].isin(terms.STRING, terms.LANG_STRING) & kinds[1].isin(terms.STRING, terms.LANG_STRING)
        )
        settled = F.when(same, F.lit(op == "=")).when(unlike, F.lit(None).cast("boolean")).otherwise(F.lit(op == "!="))
        out = F.coalesce(out, settled)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    """Integers and decimals exactly where they fit, an overflow of integers is an error; a quotient has 18 decimals."""
    numbers = terms.is_numeric(a) & terms.is_numeric(b)
    any_of = lambda kinds: terms.datatype(a).isin(kinds) | terms.datatype(b).isin(kinds)
    floating, fixed = any_of(FLOATING), any_of([terms.XSD + "decimal"])
    apply = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    cast = lambda c, kind: terms.lex(c).try_cast(kind)
    double = apply(cast(a, "double"), cast(b, "double"))
    narrow = {"+": WIDE, "-": WIDE, "*": HALF, "/": "decimal(20,0)"}[op]
    exact = apply(cast(a, narrow), cast(b, narrow)).try_cast(WIDE)
    if op == "/":  # of whole numbers; decimals by doubles
        exact = F.when(~fixed, apply(cast(a, narrow).cast(WIDE), cast(b, narrow)).try_cast(WIDE))
    if op == "*":  # nine digits behind the point each, if no digit is lost
        exact = F.when((cast(a, HALF) == cast(a, WIDE)) & (cast(b, HALF) == cast(b, WIDE)), exact)
    point = lambda c: F.regexp_replace(c.cast("string"), r"(\.\d+?)0+$", "$1")
    plain = point(F.coalesce(exact, F.when(double.isNotNull(), double.try_cast(WIDE))))
    whole = F.lit(op != "/") & ~floating & ~fixed
    kind = F.when(floating, "double").when(whole, "integer").otherwise("decimal")
    integer = apply(cast(a, "decimal(38,0)"), cast(b, "decimal(38,0)")).try_cast("decimal(38,0)").cast("string")
    text = F.when(whole, integer).when(floating, double.cast("string")).otherwise(plain)
    return F.when(numbers, F.concat(F.lit('"'), text, F.lit(f'"^^<{terms.XSD}'), kind, F.lit(">")))


def _lang_matches(tag: Column, wanted: Column) -> Column:
    t, w = F.lower(terms.lex(tag)), F.lower(terms.lex(wanted))
    return F.when(w == "*", t != "").otherwise((t == w) | t.startswith(F.concat(w, F.lit("-"))))


def _regex(text: Column, pattern: Column, flags: Column | None = None) -> Column:
    textual = terms.datatype(text).isin(terms.STRING, terms.LANG_STRING)
    p = terms.lex(pattern)
    if flags is not None:
        f = terms.lex(flags)
        p = F.when(F.contains(f, F.lit("q")), F.concat(F.lit("\\Q"), p, F.lit("\\E"))).otherwise(p)
        f = F.translate(f, "q", "")
        p = F.when(f != "", F.concat(F.lit("(?"), f, F.lit(")"), p)).otherwise(p)
    return F.when(textual, F.rlike(terms.lex(text), p))


_TESTS = {
    "isIRI": lambda a: F.when(a.isNotNull(), terms.kind(a) == "i"),
    "isLiteral": lambda a: F.when(a.isNotNull(), terms.kind(a) == "l"),
    "isBlank": lambda a: F.when(a.isNotNull(), (terms.kind(a) == "b") | a.startswith("<urn:sk:")),
    "isNumeric": lambda a: F.when(a.isNotNull(), F.coalesce(terms.is_numeric(a), F.lit(False))),
    "sameTerm": lambda a, b: a == b,
    "langMatches": _lang_matches,
    "REGEX": _regex,
}
