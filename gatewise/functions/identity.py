"""Content-addressed identities of gates.

The formats below are the interchange contract of the circuits: lengths are
counted in UTF-16 units, hashes are lower-case SHA-256.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms

# Prefixes of gate names.
ANSWER, TIMES, MINUEND, SUBTRAHEND = "urn:g:a:", "urn:g:t:", "urn:g:p1:", "urn:g:p2:"
SUB, MINUS, SHARED, REACH = "urn:g:sub:", "urn:g:m:", "urn:g:s:", "urn:g:r:"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def part(text: str) -> str:
    return f"{len(text.encode('utf-16-le')) // 2}:{text}"


def parts(texts) -> str:
    return "".join(map(part, texts))


def sha_column(c: Column) -> Column:
    return F.sha2(c, 256)


def term_hash(label: str, c: Column) -> Column:
    """Hash of one binding, by the variable's name as written; tells unbound, IRIs, blank nodes, typed and tagged literals and quoted triples apart."""
    text = sha_column(terms.lex(c))
    coded = (
        F.when(c.isNull(), F.lit("u"))
        .when(c.startswith("<<"), F.concat(F.lit("t"), text))
        .when(c.startswith("<"), F.concat(F.lit("i"), text))
        .when(c.startswith("_:"), F.concat(F.lit("b"), text))
        .otherwise(F.concat(F.lit("l"), text, sha_column(terms.datatype(c)), sha_column(terms.lang(c))))
    )
    return sha_column(F.concat(F.lit(label.rstrip("'") + "="), coded))


def keyed(prefix: str, tag: str, bindings: dict[str, Column]) -> Column:
    """Name of the gate for a pattern tag and a binding, variables in the order given."""
    hashes = [term_hash(v, c) for v, c in bindings.items()]
    return F.concat(F.lit(prefix), sha_column(F.concat(F.lit(tag), *hashes)))


def product(children: list[Column]) -> Column:
    """Name of the product of a multiset of gates."""
    hashed = F.array_sort(F.array(*map(sha_column, children)))
    return F.concat(F.lit(TIMES), sha_column(F.concat(F.lit("T|"), F.array_join(hashed, "|"))))
