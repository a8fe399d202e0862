"""How a statement says which token it carries: five layouts, both ways.

Facts are ``(token, s, p, o)``.  Reading normalises once; queries then scan
facts and never join statement parts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
# The vocabulary of the layouts.
SUBJECT, PREDICATE, OBJECT = (f"<{RDF}{x}>" for x in ("subject", "predicate", "object"))
OCCURRENCE = "<http://example.org/occurrenceOf>"
WIKIDATA = "http://www.wikidata.org/prop/"
CLAIM, STATEMENT, DIRECT = WIKIDATA, WIKIDATA + "statement/", WIKIDATA + "direct/"
SCHEMES = ("standard", "star", "wikidata", "naryrel", "namedgraph")
# Other names of the same layouts.
NAMES = {
    "Standard": "standard", "SPARQL_Star": "star", "Wikidata": "wikidata", "naryrel": "naryrel", "NamedGraph": "namedgraph",
    "namedgraph": "namedgraph", "standard": "standard", "star": "star", "wikidata": "wikidata",
}
_TERM = r'(?:<[^<>\s]*>|_:\S+|"(?s:.*?)"(?:\^\^<[^>]*>|@[\w-]+))'


def scheme(name: str) -> str:
    if name not in NAMES:
        raise ValueError(f"unknown reification {name!r}: one of {', '.join(NAMES)}")
    return NAMES[name]


def _bare(c):
    """A token without its brackets."""
    return F.when(c.startswith("<") & ~c.startswith("<<"), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def facts(quads: DataFrame, layout: str) -> DataFrame:
    """``(token, s, p, o)`` from ``(s, p, o, g)``."""
    layout = scheme(layout)
    q = quads
    if layout == "standard":
        part = lambda p, name: q.where(F.col("p") == p).select(F.col("s").alias("t"), F.col("o").alias(name))
        joined = part(SUBJECT, "s").join(part(PREDICATE, "p"), "t").join(part(OBJECT, "o"), "t")
        return joined.select(_bare(F.col("t")).alias("token"), "s", "p", "o").distinct()
    if layout == "star":
        pattern = rf"^<<\(? ?({_TERM}) ({_TERM}) ({_TERM}) ?\)?>>$"
        rows = q.where((F.col("p") == OCCURRENCE) & F.col("s").startswith("<<"))
        return rows.select(
            _bare(F.col("o")).alias("token"), *[F.regexp_extract("s", pattern, k).alias(c) for k, c in enumerate("spo", 1)]
        ).distinct()
    if layout == "wikidata":
        name = lambda prefix: F.regexp_extract("p", f"^<{prefix}([^/]+)>$", 1)
        claims = q.select(F.col("s"), name(CLAIM).alias("n"), F.col("o").alias("t")).where("n <> ''")
        values = q.select(F.col("s").alias("t"), name(STATEMENT).alias("n"), "o").where("n <> ''")
        joined = claims.join(values, ["t", "n"])
        return joined.select(
            _bare(F.col("t")).alias("token"), "s", F.concat(F.lit(f"<{DIRECT}"), F.col("n"), F.lit(">")).alias("p"), "o"
        ).distinct()
    if layout == "naryrel":
        return q.select(_bare(F.col("s")).alias("token"), "s", "p", "o").distinct()
    return q.where(F.col("g").isNotNull()).select(_bare(F.col("g")).alias("token"), "s", "p", "o").distinct()


def statements(found: DataFrame, layout: str) -> DataFrame:
    """``(s, p, o, g)`` that say the same as ``(token, s, p, o)``."""
    layout = scheme(layout)
    token = F.concat(F.lit("<"), F.col("token"), F.lit(">"))
    none = F.lit(None).cast("string")

    def rows(*triples):
        each = [F.struct(s.alias("s"), p.alias("p"), o.alias("o"), none.alias("g")) for s, p, o in triples]
        return found.select(F.explode(F.array(*each)).alias("q")).select("q.*")

    s, p, o = F.col("s"), F.col("p"), F.col("o")
    if layout == "standard":
        return rows((token, F.lit(SUBJECT), s), (token, F.lit(PREDICATE), p), (token, F.lit(OBJECT), o))
    if layout == "star":
        return rows((F.concat(F.lit("<<( "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" )>>")), F.lit(OCCURRENCE), token))
    if layout == "wikidata":
        local = F.regexp_extract("p", f"^<{DIRECT}(.+)>$", 1)
        local = F.when(local != "", local).otherwise(
            F.raise_error(F.concat(F.lit("the predicate is no direct property: "), p))
        )
        named = lambda prefix: F.concat(F.lit(f"<{prefix}"), local, F.lit(">"))
        return rows((s, named(CLAIM), token), (token, named(STATEMENT), o))
    if layout == "naryrel":
        return rows((s, p, o))
    return found.select("s", "p", "o", token.alias("g"))


def lines(quads: DataFrame) -> DataFrame:
    """``value``: the statements as N-Triples or N-Quads lines."""
    from ..operators.circuit import written

    text = F.concat_ws(" ", *[written(F.col(c)) for c in "spo"], F.col("g"), F.lit("."))
    return quads.select(text.alias("value"))


def write(found: DataFrame, layout: str, path: str) -> None:
    lines(statements(found, layout)).write.mode("overwrite").text(path)


def tokens(triples: DataFrame, prefix: str = "urn:t:") -> DataFrame:
    """Facts with a token for each distinct triple, named by its content so that any run names it alike."""
    named = F.concat(F.lit(prefix), F.sha2(F.concat_ws(" ", "s", "p", "o"), 256))
    return triples.select("s", "p", "o").distinct().select(named.alias("token"), "s", "p", "o")
