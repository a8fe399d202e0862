"""License scans: Dice coefficient over word bigrams against templates.

The units compared are the lines of a text and its paragraphs (runs of lines
without a blank one between them).  For sets of a and b bigrams the
coefficient 2|A∩B|/(a+b) can reach t only if a*t/(2-t) <= b <= a*(2-t)/t, so
units outside every template's range are dropped by word count first, then
units that share no bigram with any template, and each remaining unit meets
only the templates whose range it is in.  The templates are a fixed list, so
everything happens inside the row: no shuffle, no join, no hot key.

Defined results: a null or empty text has no units; units of fewer than two
words have no bigrams and match nothing; of templates with the same score the
one with the larger id in text order wins; equal rows give equal rows; other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontamination import SEPARATORS

THRESHOLD = 0.8

# Public notices by which texts are put under a licence.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    found = {}
    for name, text in templates.items():
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        found[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return found


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(unit, SEPARATORS), "")


def find_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: id and ``matches``, an array of (score, license, unit kind, unit number from 0)."""
    bigrams = {k: v for k, v in template_bigrams(templates).items() if v}
    low = min(len(b) * threshold / (2 - threshold) for b in bigrams.values())
    high = max(len(b) * (2 - threshold) / threshold for b in bigrams.values())
    known = F.array(
        *[
            F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("n"))
            for k, b in sorted(bigrams.items())
        ]
    )
    every = sorted({b for each in bigrams.values() for b in each})

    text = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    units = docs.select(F.col(id_col).alias(id_col), text.alias("_t")).select(
        id_col,
        F.concat(
            F.transform(F.split("_t", "\n"), lambda u, i: F.struct(F.lit("line").alias("kind"), i.alias("at"), u.alias("u"))),
            F.filter(
                F.transform(
                    F.split("_t", r"\n[ \t\r]*\n"),
                    lambda u, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("at"), u.alias("u")),
                ),
                lambda x: x["u"].contains("\n"),  # others are lines already
            ),
        ).alias("units"),
    )
    # A unit of n words has n - 1 bigrams at most, and at least (n - 1) / repeats; only the lower bound holds before
    # repeated bigrams are counted once.
    worded = units.select(
        id_col,
        F.filter(
            F.transform("units", lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), _words(x["u"]).alias("w"))),
            lambda x: F.size(x["w"]) - 1 >= low,
        ).alias("units"),
    )
    paired = worded.select(
        id_col,
        F.transform(
            "units",
            lambda x: F.struct(
                x["kind"].alias("kind"),
                x["at"].alias("at"),
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(0), F.size(x["w"]) - 2),
                        lambda i: F.concat_ws(" ", F.get(x["w"], i), F.get(x["w"], i + 1)),
                    )
                ).alias("b"),
            ),
        ).alias("units"),
    )
    near = paired.select(
        id_col,
        F.filter(
            "units", lambda x: F.size(x["b"]).between(low, high) & F.exists(x["b"], lambda b: b.isin(every))
        ).alias("units"),
    )

    def best(x: Column) -> Column:
        n = F.size(x["b"])
        fits = F.filter(known, lambda t: (2.0 * F.least(n, t["n"])) / (n + t["n"]) >= threshold)
        scored = F.transform(
            fits,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(x["b"], t["bigrams"])) / (n + t["n"])).alias("score"),
                t["license"].alias("license"),
            ),
        )
        top = F.array_max(scored)
        return F.struct(top["score"].alias("score"), top["license"].alias("license"), x["kind"].alias("kind"), x["at"].alias("at"))

    return near.select(
        id_col, F.filter(F.transform("units", best), lambda m: m["score"] >= threshold).alias("matches")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(common.documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max("matches")["score"], F.lit(0.0)).alias("best_score"),
        F.coalesce(
            F.array_min(F.transform(F.filter("matches", lambda m: m["kind"] == "line"), lambda m: m["at"].cast("long"))),
            F.lit(-1).cast("long"),
        ).alias("first_line"),
    )


def _oracle() -> str:
    rows = ", ".join(
        "('" + name + "', [" + ", ".join(f"'{b}'" for b in bigrams) + "])" for name, bigrams in template_bigrams().items()
    )
    return f"""
WITH t(license, tb) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
l AS (SELECT rid, 'line' AS kind, unnest(string_split(body, chr(10))) AS u, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM d),
p AS (SELECT rid, 'paragraph' AS kind, unnest(regexp_split_to_array(body, '\\n[ \\t\\r]*\\n')) AS u,
             generate_subscripts(regexp_split_to_array(body, '\\n[ \\t\\r]*\\n'), 1) - 1 AS pos FROM d),
units AS (SELECT * FROM l UNION ALL SELECT * FROM p WHERE contains(u, chr(10))),
w AS (SELECT rid, kind, pos, list_filter(regexp_split_to_array(u, '{SEPARATORS}'), lambda x: x <> '') AS w FROM units),
b AS (SELECT rid, kind, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
s AS (SELECT rid, kind, pos, license, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS score
      FROM b, t WHERE list_has_any(b, tb)),
m AS (SELECT rid, kind, pos, max(struct_pack(score := CAST(score AS DOUBLE), license := license)) AS top FROM s GROUP BY rid, kind, pos),
g AS (SELECT rid, count(*) AS n_matches, string_agg(DISTINCT top.license, ',' ORDER BY top.license) AS licenses,
             max(top.score) AS best_score, min(pos) FILTER (kind = 'line') AS first_line
      FROM m WHERE top.score >= {THRESHOLD} GROUP BY rid)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses,
       coalesce(best_score, 0.0) AS best_score, CAST(coalesce(first_line, -1) AS BIGINT) AS first_line
FROM d LEFT JOIN g USING (rid)"""


ORACLE = _oracle()
