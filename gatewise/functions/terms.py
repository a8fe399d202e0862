"""RDF terms as canonical strings.

One string per term serves as join and group key and is compact in a shuffle:
``<iri>``, ``_:label``, ``"lexical"^^<datatype>``, ``"lexical"@lang`` and
``<<( s p o )>>`` for quoted triples.  The lexical form is not escaped: the
last quotation mark ends it, since neither datatype nor tag can hold one.
Unbound is NULL.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
STRING = XSD + "string"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
# Datatypes that compare by number.
NUMERIC = tuple(
    XSD + name
    for name in (
        "integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger",
        "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong",
        "unsignedShort", "unsignedByte",
    )
)


class Term(NamedTuple):
    kind: str  #: i, b, l or t
    lex: str
    datatype: str = ""
    lang: str = ""


def iri(text: str) -> str:
    return f"<{text}>"


def literal(lex: str, datatype: str = STRING, lang: str = "") -> str:
    return f'"{lex}"@{lang.lower()}' if lang else f'"{lex}"^^<{datatype}>'


def parse(term: str) -> Term:
    if term.startswith("<<"):
        return Term("t", term)
    if term.startswith("<"):
        return Term("i", term[1:-1])
    if term.startswith("_:"):
        return Term("b", term[2:])
    body, _, suffix = term[1:].rpartition('"')
    if suffix.startswith("@"):
        return Term("l", body, LANG_STRING, suffix[1:].lower())
    return Term("l", body, suffix[3:-1])


def escaped(lex: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = lex.replace(a, b)
    return lex


def rendered(term: str) -> str:
    """As query text writes it: escapes, and no datatype on plain strings."""
    t = parse(term)
    if t.kind != "l":
        return term
    text = f'"{escaped(t.lex)}"'
    if t.lang:
        return f"{text}@{t.lang}"
    return text if t.datatype == STRING else f"{text}^^<{t.datatype}>"


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
# The single-letter escapes of N-Triples.
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            if m[3] not in _LETTERS:
                raise ValueError(f"unknown escape \\{m[3]}")
            return _LETTERS[m[3]]
        return chr(int(m[1] or m[2], 16))

    return _ESCAPE.sub(one, text)


# -- columns


def kind(c: Column) -> Column:
    return (
        F.when(c.startswith("<<"), "t").when(c.startswith("<"), "i").when(c.startswith("_:"), "b").when(c.isNotNull(), "l")
    )


def _suffix(c: Column) -> Column:
    return F.substring_index(c, '"', -1)


def lex(c: Column) -> Column:
    size = F.char_length(c)
    return (
        F.when(c.startswith("<<"), c)
        .when(c.startswith("<"), F.substring(c, F.lit(2), size - 2))
        .when(c.startswith("_:"), F.substring(c, F.lit(3), size))
        .otherwise(F.substring(c, F.lit(2), size - F.char_length(_suffix(c)) - 2))
    )


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def lang(c: Column) -> Column:
    """Empty for literals without a tag, NULL for other terms."""
    tag = F.when(_suffix(c).startswith("@"), F.lower(F.substring(_suffix(c), F.lit(2), F.char_length(c)))).otherwise("")
    return F.when(is_literal(c), tag)


def datatype(c: Column) -> Column:
    s = _suffix(c)
    own = F.when(s.startswith("@"), F.lit(LANG_STRING)).otherwise(F.substring(s, F.lit(4), F.char_length(s) - 4))
    return F.when(is_literal(c), own)


def is_numeric(c: Column) -> Column:
    return datatype(c).isin(*NUMERIC) & lex(c).try_cast("double").isNotNull()


def skolem(c: Column) -> Column:
    """A blank node as an IRI that holds its label in hex; other terms as they are."""
    name = F.concat(F.lit("<urn:sk:"), F.lower(F.hex(F.encode(lex(c), "UTF-8"))), F.lit(">"))
    return F.when(c.startswith("_:"), name).otherwise(c)


def unskolem(c: Column) -> Column:
    label = F.regexp_extract(c, "^<urn:sk:([0-9a-f]+)>$", 1)
    return F.when(label != "", F.concat(F.lit("_:"), F.decode(F.unhex(label), "UTF-8"))).otherwise(c)
