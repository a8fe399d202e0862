"""RDF text formats.

N-Triples, N-Quads and their quoted-triple variants are line formats and are
read in parallel.  Turtle and TriG need a parser with state; they are meant
for small inputs and are read as whole files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..plans import algebra as A
from ..plans.sparql import ParseError, _Parser
from ..shipping import ship

QUADS = "s string, p string, o string, g string"
_PART = re.compile(
    r'\s*(?:(?P<iri><[^<>\s]*>)|(?P<blank>_:[^\s<>".]+(?:\.[^\s<>".]+)*)|"(?P<lex>(?:[^"\\]|\\.)*)"(?:\^\^<(?P<dt>[^>]*)>|@(?P<lang>[\w-]+))?|(?P<open><<)|(?P<close>>>)|(?P<paren>[()])|(?P<end>\.))'
)


def _line_terms(line: str) -> list[str]:
    """Terms of a line up to its final dot."""
    at, stack = 0, [[]]
    while True:
        m = _PART.match(line, at)
        if not m:
            raise ValueError(f"not a statement: {line!r}")
        at = m.end()
        if m["end"]:
            if line[at:].split("#")[0].strip() or len(stack) != 1:
                raise ValueError(f"not a statement: {line!r}")
            return stack[0]
        if m["iri"]:
            stack[-1].append(f"<{terms.unescape(m['iri'][1:-1])}>")
        elif m["blank"]:
            stack[-1].append(m["blank"])
        elif m["open"]:
            stack.append([])
        elif m["close"]:
            inner = stack.pop()
            stack[-1].append(f"<<( {' '.join(inner)} )>>")
        elif m["lex"] is not None:
            stack[-1].append(terms.literal(terms.unescape(m["lex"]), m["dt"] or terms.STRING, m["lang"] or ""))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(s, p, o, g)`` from a column ``value`` of N-Triples or N-Quads lines; comments and blank lines are skipped."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line in batch["value"]:
                if line and line.strip() and not line.lstrip().startswith("#"):
                    found = _line_terms(line)
                    if len(found) not in (3, 4):
                        raise ValueError(f"{len(found)} terms in {line!r}")
                    rows.append((*found, None)[:4])
            yield pd.DataFrame(rows, columns=["s", "p", "o", "g"])

    return lines.select("value").mapInPandas(run, QUADS)


class _Turtle(_Parser):
    """Turtle and TriG on the query parser's tokens."""

    def __init__(self, text: str):
        super().__init__(text)
        self.quads: list[tuple[str, str, str, str | None]] = []
        self.graph: str | None = None

    def fresh(self) -> A.Var:
        self.hidden += 1
        return A.Var(f"_:anon{self.hidden}", True)

    def slot(self) -> A.Slot:
        kind, text = self.peek()
        if kind == "blank":
            self.next()
            return A.Var(text, True)
        return super().slot()

    def read(self) -> list[tuple[str, str, str, str | None]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text in ("@prefix", "@base") or (kind == "word" and text.upper() in ("PREFIX", "BASE")):
                self.next()
                if text.strip("@").upper() == "BASE":
                    self.base = self.next()[1][1:-1]
                else:
                    name = self.next()[1].removesuffix(":")
                    self.prefixes[name] = self.resolve(self.next()[1][1:-1])
                self.take(".")
            elif (kind, text) == ("op", "{"):
                self.next()
                self.block(None)
            elif self.peek(1) == ("op", "{"):
                if kind == "word":  # GRAPH
                    self.next()
                name = self.slot()
                self.need("{")
                self.block(name)
            elif kind == "word" and text.upper() == "GRAPH":
                self.next()
            else:
                self.statement()
                self.need(".")
        return self.quads

    def block(self, name) -> None:
        self.graph = name.name if isinstance(name, A.Var) else name
        while not self.take("}"):
            self.statement()
            self.take(".")
        self.graph = None

    def statement(self) -> None:
        for node in self.triples():
            if not isinstance(node, A.Bgp):
                raise ParseError("a path in data")
            for p in node.patterns:
                self.quads.append((*[x.name if isinstance(x, A.Var) else x for x in p.slots], self.graph))


def parse_turtle(text: str) -> list[tuple[str, str, str, str | None]]:
    return _Turtle(text).read()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a file by its suffix; blank nodes become IRIs that hold their label."""
    suffix = path.rsplit(".", 1)[-1]
    if suffix in ("nt", "nq", "nts", "nqs"):
        quads = parse_lines(spark.read.text(path))
    elif suffix in ("ttl", "ttls", "trig"):
        text = spark.read.text(path, wholetext=True).first()[0]
        quads = spark.createDataFrame(parse_turtle(text), QUADS)
    else:
        raise ValueError(f"no reader for .{suffix}")
    return quads.select(*[terms.skolem(F.col(c)).alias(c) for c in "spog"])


def has_blank_nodes(quads: DataFrame) -> bool:
    """Whether some statement holds a blank node, inside quoted triples too."""
    there = [F.col(c).startswith("_:") | (F.col(c).startswith("<<") & F.col(c).rlike(r"(^|[ (])_:")) for c in quads.columns]
    any_of = there[0]
    for t in there[1:]:
        any_of = any_of | t
    return not quads.where(any_of).limit(1).isEmpty()


def refuse_blank_nodes(quads: DataFrame) -> DataFrame:
    if has_blank_nodes(quads):
        raise ValueError("the data hold blank nodes: load them through load(), which names them")
    return quads
