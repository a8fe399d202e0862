"""The cheap half of the catalogue against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
NAMES = [
    "atom_scan", "bgp_q3", "bgp_q5", "bgp_q9", "bgp_q10", "recon", "recon_naive", "star", "hierarchy", "minus_guarded", "minus_chain",
    "minus_union_right", "optional_match", "optional_disjoint", "gates_times", "gates_answers", "edges_recon", "prov_string",
    "filter_big", "vars_case", "selfjoin", "two_optionals", "factored_cone", "path_bound_source", "text_recon_flat", "text_recon_factored",
    "text_minus", "reify_standard", "reify_star", "reify_wikidata", "direct_mapping",
]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(x):
    return None if x is None else round(float(x), 8) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    from gatewise import catalogue

    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = tables.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cursor.description]
    want = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
