"""Queries of the engine over the benchmark tables, each with equivalent SQL where SQL can say it.

Probabilities are (1 + key mod 97) / 101.  Results are rounded to nine places,
which either side computes alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Config, Engine
from .functions import identity
from .operators import circuit as C
from .operators import explain, lifted, paths, probability
from .operators import relation as R
from .plans import algebra, sparql
from .sources import relational as T
from .sources import reification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def share(key: Column) -> Column:
    return (1 + F.pmod(key, F.lit(97))).cast("double") / 101


def p_sql(key: str) -> str:
    return f"(CAST(1 + ({key}) % 97 AS DOUBLE) / 101)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, F.round("_p", 9).alias("probability"))


LINE_KEY = "l_orderkey * 7 + l_linenumber * 13 + l_partkey"
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
P_LINE, P_ORDER, P_CUST, P_SUPP = p_sql(LINE_KEY), p_sql("o_orderkey"), p_sql("c_custkey"), p_sql("s_suppkey")


#: Columns that tell a table's rows apart.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
}


def weighted(spark, d, name, bind, key, keep=None) -> lifted.Weighted:
    names = {c: v for v, c in bind.items()}
    apart = tuple(names[c] for c in KEYS[name]) if set(KEYS[name]) <= set(names) else None
    return lifted.rows(T.table(spark, d, name), name, {v: F.col(c) for v, c in bind.items()}, share(key), keep, apart)


def customers(spark, d, keep=None):
    return weighted(spark, d, "customer", {"cust": "c_custkey", "nat": "c_nationkey"}, F.col("c_custkey"), keep)


def orders(spark, d, keep=None):
    return weighted(spark, d, "orders", {"order": "o_orderkey", "cust": "o_custkey"}, F.col("o_orderkey"), keep)


def items(spark, d, keep=None):
    return weighted(spark, d, "lineitem", {"order": "l_orderkey", **{c: c for c in LINE[1:]}}, F.expr(LINE_KEY), keep)


BUILDING = "c_mktsegment = 'BUILDING'"

# ---- conjunctions over tables


@query(f"SELECT n_name AS name, round({p_sql('n_nationkey')}, 9) AS probability FROM nation")
def atom_scan(spark, d):
    return rounded(weighted(spark, d, "nation", {"name": "n_name"}, F.col("n_nationkey")).df, "name")


LINES_OUT = 'l_orderkey AS "order", l_linenumber, l_partkey, l_suppkey, l_extendedprice'


@query(f"""
SELECT {LINES_OUT}, round({P_CUST} * {P_ORDER} * {P_LINE}, 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'""")
def bgp_q3(spark, d):
    head = ("order", *LINE[1:])
    return rounded(lifted.plan([customers(spark, d, BUILDING), orders(spark, d), items(spark, d)], head).df, *head)


@query(f"""
SELECT {LINES_OUT}, round({P_CUST} * {P_ORDER} * {P_LINE}, 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def bgp_q10(spark, d):
    head = ("order", *LINE[1:])
    return rounded(lifted.plan([customers(spark, d), orders(spark, d), items(spark, d, F.col("l_returnflag") == "R")], head).df, *head)


@query(f"""
SELECT {LINES_OUT}, round({P_CUST} * {P_ORDER} * {P_LINE} * {P_SUPP} * {p_sql('n_nationkey')}, 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey""")
def bgp_q5(spark, d):
    supplier = weighted(spark, d, "supplier", {"l_suppkey": "s_suppkey", "nat": "s_nationkey"}, F.col("s_suppkey"))
    nation = weighted(spark, d, "nation", {"nat": "n_nationkey"}, F.col("n_nationkey"))
    # nation and supplier first: they leave one customer's nation in twenty-five to the lines
    placed = lifted.join(lifted.join(customers(spark, d), nation), orders(spark, d))
    joined = lifted.join(lifted.join(items(spark, d), supplier), placed)
    return rounded(joined.df, "order", *LINE[1:])


@query(f"""
WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT {LINES_OUT.replace('l_partkey', 'lineitem.l_partkey').replace('l_suppkey', 'lineitem.l_suppkey')},
       round({p_sql('ps.l_partkey * 3 + ps.l_suppkey')} * {P_LINE.replace('l_partkey', 'lineitem.l_partkey')} * {P_ORDER} * {P_SUPP}, 9) AS probability
FROM lineitem JOIN ps ON lineitem.l_partkey = ps.l_partkey AND lineitem.l_suppkey = ps.l_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON lineitem.l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def bgp_q9(spark, d):
    """The supply table is absent: its pairs are those that occur in lines."""
    pairs = T.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    supply = lifted.rows(
        pairs, "supply", {c: F.col(c) for c in pairs.columns}, share(F.col("l_partkey") * 3 + F.col("l_suppkey")), key=tuple(pairs.columns)
    )
    supplier = weighted(spark, d, "supplier", {"l_suppkey": "s_suppkey", "nat": "s_nationkey"}, F.col("s_suppkey"))
    nations = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("nat"), F.lit(1.0).alias("_p"))
    certain = lifted.Weighted(nations, ("nat",), frozenset(), frozenset(), frozenset({"nat"}))
    joined = lifted.join(lifted.join(lifted.join(lifted.join(items(spark, d), supply), orders(spark, d)), supplier), certain)
    return rounded(joined.df, "order", *LINE[1:])


RECON = f"""
SELECT c_custkey AS cust, round({P_CUST} * (1 - product(1 - {P_ORDER})), 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey"""


@query(RECON)
def recon(spark, d):
    """Many derivations that share a token: customers with some order."""
    return rounded(lifted.plan([customers(spark, d, BUILDING), orders(spark, d)], ("cust",)).df, "cust")


@query(f"""
SELECT c_custkey AS cust, round(sum({P_CUST} * {P_ORDER}), 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey""")
def recon_naive(spark, d):
    """Adding derivations up: wrong on purpose, may exceed one."""
    joined = lifted.join(orders(spark, d), customers(spark, d, BUILDING))
    return joined.df.groupBy("cust").agg(F.round(F.sum("_p"), 9).alias("probability"))


@query(f"""
WITH o AS (SELECT o_custkey, 1 - product(1 - {P_ORDER}) AS p FROM orders GROUP BY o_custkey),
s AS (SELECT s_nationkey, 1 - product(1 - {P_SUPP}) AS p FROM supplier GROUP BY s_nationkey)
SELECT c_custkey AS cust, c_nationkey AS nat, round({P_CUST} * o.p * s.p, 9) AS probability
FROM customer JOIN o ON c_custkey = o_custkey JOIN s ON c_nationkey = s_nationkey""")
def star(spark, d):
    """Customers with some order and some supplier of their nation: branches are summed out apart."""
    supplier = weighted(spark, d, "supplier", {"supp": "s_suppkey", "nat": "s_nationkey"}, F.col("s_suppkey"))
    return rounded(lifted.plan([customers(spark, d), orders(spark, d), supplier], ("cust", "nat")).df, "cust", "nat")


@query(f"""
SELECT c_nationkey AS nat, round(1 - product(1 - {P_CUST} * q), 9) AS probability
FROM customer JOIN (SELECT o_custkey, 1 - product(1 - {P_ORDER} * r) AS q
  FROM orders JOIN (SELECT l_orderkey, 1 - product(1 - {P_LINE}) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)
ON c_custkey = o_custkey GROUP BY c_nationkey""")
def hierarchy(spark, d):
    """Nations with some customer with some order with some line, summed out from the inside."""
    line = lifted.project(items(spark, d), ("order",))
    order = lifted.project(lifted.join(orders(spark, d), line), ("cust",))
    return rounded(lifted.project(lifted.join(customers(spark, d), order), ("nat",)).df, "nat")


# ---- differences, optionals, unions over tables


@query(f"""
SELECT o_custkey AS cust, round((1 - product(1 - {P_ORDER})) * (1 - max(CASE WHEN c_mktsegment = 'BUILDING' THEN {P_CUST} ELSE 0.0 END)), 9) AS probability
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey""")
def minus_guarded(spark, d):
    """Customers with orders that are not BUILDING: all stay, less the probability of being so."""
    left = lifted.project(orders(spark, d), ("cust",))
    return rounded(lifted.minus(left, customers(spark, d, BUILDING)).df, "cust")


@query(f"SELECT r_name AS name, round({p_sql('r_regionkey')}, 9) AS probability FROM region")
def minus_disjoint(spark, d):
    """No shared variable: MINUS removes nothing."""
    left = weighted(spark, d, "region", {"name": "r_name"}, F.col("r_regionkey"))
    return rounded(lifted.minus(left, weighted(spark, d, "nation", {"nation": "n_name"}, F.col("n_nationkey"))).df, "name")


MINUS_TWO = f"""
WITH o AS (SELECT o_custkey, 1 - product(1 - {P_ORDER}) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS cust, round({P_CUST} * (1 - coalesce(o.p, 0.0)) * (1 - CASE WHEN s_suppkey IS NULL THEN 0.0 ELSE {P_SUPP} END), 9) AS probability
FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = c_custkey"""


@query(MINUS_TWO)
def minus_chain(spark, d):
    """One difference after the other."""
    done = orders(spark, d, F.col("o_orderstatus") == "F")
    both = weighted(spark, d, "supplier", {"cust": "s_suppkey"}, F.col("s_suppkey"))
    return rounded(lifted.minus(lifted.minus(customers(spark, d), done), both).df, "cust")


@query(MINUS_TWO)
def minus_union_right(spark, d):
    """A union of blockers: the same as a chain."""
    done = orders(spark, d, F.col("o_orderstatus") == "F")
    both = weighted(spark, d, "supplier", {"cust": "s_suppkey"}, F.col("s_suppkey"))
    return rounded(lifted.minus(customers(spark, d), lifted.union(done, both, ("cust",))).df, "cust")


@query(f"""
WITH l AS (SELECT l_orderkey, product(1 - {P_LINE}) AS none FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS "order", CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS line,
       round({P_ORDER} * {P_LINE}, 9) AS probability
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, NULL, round({P_ORDER} * coalesce(none, 1.0), 9) FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def optional_match(spark, d):
    """Orders with lines if there are any: each line, and the bare order."""
    left = weighted(spark, d, "orders", {"order": "o_orderkey"}, F.col("o_orderkey"))
    found = lifted.optional(left, items(spark, d))
    line = F.concat(*[x for c in LINE[1:4] for x in (F.col(c).cast("string"), F.lit("-"))][:-1])
    return rounded(found.withColumn("line", line), "order", "line")


@query(f"""
SELECT r_name AS region, s_name AS supplier, round({p_sql('r_regionkey')} * {P_SUPP}, 9) AS probability FROM region, supplier
UNION ALL SELECT r_name, NULL, round({p_sql('r_regionkey')} * (SELECT product(1 - {P_SUPP}) FROM supplier), 9) FROM region""")
def optional_disjoint(spark, d):
    """No shared variable: a bare row is left only if there is no supplier at all."""
    left = weighted(spark, d, "region", {"region": "r_name"}, F.col("r_regionkey"))
    right = weighted(spark, d, "supplier", {"supplier": "s_name"}, F.col("s_suppkey"))
    return rounded(lifted.optional(left, right), "region", "supplier")


@query(f"""
WITH a AS (SELECT o_custkey AS cust, 1 - product(1 - {P_ORDER}) AS p FROM orders GROUP BY 1),
b AS (SELECT s_suppkey AS cust, {P_SUPP} AS p FROM supplier)
SELECT cust, round(1 - product(1 - p), 9) AS probability FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY cust""")
def union_independent(spark, d):
    b = weighted(spark, d, "supplier", {"cust": "s_suppkey"}, F.col("s_suppkey"))
    return rounded(lifted.union(orders(spark, d), b, ("cust",)).df, "cust")


# ---- circuits over tables


def table_relation(spark, d, name, key, bind, keep=None) -> R.Relation:
    rows = T.table(spark, d, name)
    rows = rows if keep is None else rows.where(keep)
    return R.scan(rows, T.token(name, *[F.col(k) for k in key]), {v: c if isinstance(c, Column) else T.plain(F.col(c)) for v, c in bind.items()})


def cust_rows(spark, d, keep=None):
    return table_relation(spark, d, "customer", ("c_custkey",), {"cust": T.entity("customer", F.col("c_custkey"))}, keep)


def order_rows(spark, d, keep=None):
    cust = T.entity("customer", F.col("o_custkey"))
    return table_relation(spark, d, "orders", ("o_orderkey",), {"order": T.entity("orders", F.col("o_orderkey")), "cust": cust}, keep)


def nation_rows(spark, d):
    return table_relation(spark, d, "nation", ("n_nationkey",), {"nation": T.entity("nation", F.col("n_nationkey")), "region": T.entity("region", F.col("n_regionkey"))})


def table_probs(spark, d, *names) -> DataFrame:
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    return R.union_frames(
        [T.table(spark, d, n).select(T.token(n, F.col(keys[n])).alias("token"), share(F.col(keys[n])).alias("p")) for n in names]
    )


def tagged(name: str) -> str:
    return "A@" + identity.sha(name)


def qrecon(spark, d) -> C.Circuit:
    joined = R.join(cust_rows(spark, d, BUILDING), order_rows(spark, d))
    return C.answers([(joined, False)], ("cust",), tagged("recon"))


TOKENS = """
WITH j AS (SELECT 'http://example.org/customer/' || c_custkey AS c, 'http://example.org/orders/' || o_orderkey AS o, c_custkey
           FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'),
t AS (SELECT *, 'urn:g:t:' || sha256('T|' || array_to_string(list_sort([sha256(c), sha256(o)]), '|')) AS t FROM j),
a AS (SELECT *, 'urn:g:a:' || sha256('%s' || sha256('cust=i' || sha256('http://example.org/customer/' || c_custkey))) AS a FROM t)
""" % tagged("recon")


@query(TOKENS + "SELECT DISTINCT t AS gate FROM t")
def gates_times(spark, d):
    return qrecon(spark, d).gates.where("op = 'times'").select("gate")


@query(TOKENS + "SELECT DISTINCT a AS root, '<' || 'http://example.org/customer/' || c_custkey || '>' AS cust FROM a")
def gates_answers(spark, d):
    return qrecon(spark, d).answers


@query(TOKENS + "SELECT t AS parent, c AS child, 'in' AS role FROM t UNION SELECT t, o, 'in' FROM t UNION SELECT a, t, 'feeds' FROM a")
def edges_recon(spark, d):
    return qrecon(spark, d).edges


@query(TOKENS + """SELECT 'times' AS op, count(DISTINCT t) AS n FROM t UNION ALL SELECT 'plus', count(DISTINCT a) FROM a
UNION ALL SELECT 'edges', 3 * count(DISTINCT t) FROM t UNION ALL SELECT 'leaves', count(DISTINCT c) + count(DISTINCT o) FROM t""")
def circuit_stats(spark, d):
    return qrecon(spark, d).stats()


@query(TOKENS + "SELECT c AS node, count(DISTINCT t) AS uses FROM t GROUP BY c UNION ALL SELECT o, count(DISTINCT t) FROM t GROUP BY o UNION ALL SELECT t, 1 FROM t")
def fan_out(spark, d):
    return qrecon(spark, d).fan_out()


@query(TOKENS + "SELECT a AS root, 1 + count(DISTINCT t) AS gates, 3 * count(DISTINCT t) AS edges FROM a GROUP BY a")
def cone_sizes(spark, d):
    return qrecon(spark, d).settle().cone_sizes()


@query(TOKENS + "SELECT '<http://example.org/customer/' || c_custkey || '>' AS cust, '⊕(' || string_agg('(⊗' || c || ',' || o || ',)', ' ' ORDER BY '(⊗' || c || ',' || o || ',)') || ')' AS provenance FROM t GROUP BY c_custkey")
def prov_string(spark, d):
    joined = R.join(cust_rows(spark, d, BUILDING), order_rows(spark, d))
    text = F.concat(F.lit("(⊗"), *[x for g in joined.gates for x in (F.col(g), F.lit(","))], F.lit(")"))
    return joined.df.groupBy("cust").agg(
        F.concat(F.lit("⊕("), F.concat_ws(" ", F.array_sort(F.collect_list(text))), F.lit(")")).alias("provenance")
    )


def solved(circuit: C.Circuit, probs: DataFrame, mode: str = "per-root") -> DataFrame:
    found = probability.probabilities(circuit.settle(), probs, mode)
    return found.select(*circuit.variables, F.round("probability", 9).alias("probability"), "method")


@query(RECON.replace("c_custkey AS cust", "'<http://example.org/customer/' || c_custkey || '>' AS cust").replace("AS probability", "AS probability, CASE WHEN count(*) = 1 THEN 'read-once' ELSE '-' END AS method"))
def recon_circuit(spark, d):
    """The flagship through circuits: a customer's token is shared by its derivations, so diagrams are compiled."""
    found = solved(qrecon(spark, d), table_probs(spark, d, "customer", "orders"))
    return found.withColumn("method", F.when(F.col("method") == "read-once", F.col("method")).otherwise("-"))


@query(f"""
SELECT '<http://example.org/customer/' || o_custkey || '>' AS cust, round(1 - product(1 - {P_ORDER}), 9) AS probability
FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' GROUP BY o_custkey""")
def union_shared(spark, d):
    """Branches that share tokens: equal products are one gate, so every answer is read-once."""
    a = order_rows(spark, d, F.col("o_orderstatus") == "F")
    b = order_rows(spark, d, F.col("o_orderpriority") == "1-URGENT")
    made = C.answers([(a, False), (b, False)], ("cust",), tagged("union"))
    values = probability.read_once_probabilities(made.settle(), table_probs(spark, d, "orders"))
    return made.answers.join(values, "root").select("cust", F.round("probability", 9).alias("probability"))


TWO_OF = f"""
WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, {p_sql('n_nationkey')} AS p FROM nation)
SELECT '<http://example.org/region/' || a.r || '>' AS region, round(1 - product(1 - p) - sum(p / (1 - p)) * product(1 - p), 9) AS probability
FROM n a GROUP BY a.r"""


def two_nations(spark, d) -> C.Circuit:
    """Regions with at least two of their nations: a threshold, never read-once."""
    a = nation_rows(spark, d)
    b = R.rename(nation_rows(spark, d), {"nation": "other"})
    pairs = R.where(R.join(a, b), F.col("nation") < F.col("other"))
    return C.answers([(pairs, False)], ("region",), tagged("two"))


@query(TWO_OF)
def bdd_prob(spark, d):
    return solved(two_nations(spark, d), table_probs(spark, d, "nation")).drop("method")


@query(TWO_OF)
def bdd_prob_shared(spark, d):
    return solved(two_nations(spark, d), table_probs(spark, d, "nation"), "shared").drop("method")


@query("SELECT '<http://example.org/region/' || n_regionkey || '>' AS region, CASE WHEN count(*) = 2 THEN 'read-once' WHEN count(*) <= 8 THEN 'worlds' ELSE 'diagram' END AS method FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def portfolio_method(spark, d):
    return solved(two_nations(spark, d), table_probs(spark, d, "nation")).select("region", "method")


@query("""
SELECT '<http://example.org/region/' || n_regionkey || '>' AS region, count(*) + count(*) * (count(*) - 1) // 2 + 1 AS n_vars,
       3 * (count(*) * (count(*) - 1) // 2) + count(*) * (count(*) - 1) // 2 + 1 + 1 AS n_clauses
FROM nation GROUP BY n_regionkey HAVING count(*) > 1""")
def cnf_stats(spark, d):
    made = two_nations(spark, d).settle()
    return made.answers.join(explain.cnf(made, table_probs(spark, d, "nation")), "root").select("region", "n_vars", "n_clauses")


@query("""
SELECT '<http://example.org/region/' || r || '>' AS region, 'http://example.org/nation/' || n_nationkey AS token, round(CAST(1 AS DOUBLE) / n, 9) AS value
FROM (SELECT n_regionkey AS r, n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)""")
def shapley_threshold(spark, d):
    """Tokens of a threshold are alike: each has an equal share."""
    made = two_nations(spark, d).settle()
    return explain.shapley(made).select("region", "token", F.round("value", 9).alias("value"))


def regions_without(spark, d) -> C.Circuit:
    left = table_relation(spark, d, "region", ("r_regionkey",), {"region": T.entity("region", F.col("r_regionkey"))})
    right = R.Relation((n := nation_rows(spark, d)).df.drop("nation"), ("region",), n.gates)
    return C.answers([(R.difference(left, [(right, "nation", False)], "region", identity.sha("without")), True)], ("region",), tagged("without"))


@query(f"""
SELECT '<http://example.org/region/' || r_regionkey || '>' AS region,
       round({p_sql('r_regionkey')} * coalesce((SELECT product(1 - {p_sql('n_nationkey')}) FROM nation WHERE n_regionkey = r_regionkey), 1.0), 9) AS probability
FROM region""")
def minus_circuit(spark, d):
    return solved(regions_without(spark, d), table_probs(spark, d, "region", "nation")).drop("method")


@query("""
SELECT '<http://example.org/region/' || r || '>' AS region, token, round(v, 9) AS value FROM (
  SELECT r_regionkey AS r, 'http://example.org/region/' || r_regionkey AS token, CAST(1 AS DOUBLE) / (1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)) AS v FROM region
  UNION ALL SELECT n_regionkey, 'http://example.org/nation/' || n_nationkey, -CAST(1 AS DOUBLE) / (n * (n + 1))
  FROM (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation))""")
def shapley_minus(spark, d):
    """A blocker's share is negative."""
    return explain.shapley(regions_without(spark, d).settle()).select("region", "token", F.round("value", 9).alias("value"))


@query("SELECT '<http://example.org/region/' || n_regionkey || '>' AS region, 'http://example.org/nation/' || n_nationkey AS token FROM nation")
def why_not(spark, d):
    return explain.why_not(regions_without(spark, d).settle())


@query("""
SELECT 'minus' AS op, count(*) AS n FROM region UNION ALL SELECT 'times', (SELECT count(*) FROM region) + count(*) FROM nation
UNION ALL SELECT 'plus', 3 * (SELECT count(*) FROM region) + count(DISTINCT n_regionkey) FROM nation
UNION ALL SELECT 'edges', 5 * (SELECT count(*) FROM region) + 2 * count(*) + count(DISTINCT n_regionkey) FROM nation
UNION ALL SELECT 'leaves', (SELECT count(*) FROM region) + count(*) FROM nation""")
def minus_stats(spark, d):
    return regions_without(spark, d).settle().stats()


@query(f"""
WITH n AS (SELECT n_regionkey AS r, {p_sql('n_nationkey')} AS p, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)
SELECT '<http://example.org/region/' || a.r || '>' AS region, round(1 - product(1 - a.p * b.p), 9) AS probability
FROM n a JOIN n b ON a.r = b.r AND a.k < b.k GROUP BY a.r""")
def naive_contrast(spark, d):
    """Derivations taken for independent: not the probability of the threshold."""
    found = explain.naive(two_nations(spark, d).settle(), table_probs(spark, d, "nation"))
    return found.select("region", F.round("probability", 9).alias("probability"))


@query("""
SELECT '<http://example.org/region/' || a.n_regionkey || '>' AS region,
       least('http://example.org/nation/' || a.n_nationkey, 'http://example.org/nation/' || b.n_nationkey) || ',' || greatest('http://example.org/nation/' || a.n_nationkey, 'http://example.org/nation/' || b.n_nationkey) AS product
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def monomials(spark, d):
    made = two_nations(spark, d).settle()
    return made.answers.join(explain.monomials(made), "root").select("region", "product")


@query(TOKENS + "SELECT count(*) AS lines FROM (SELECT DISTINCT t AS x FROM t UNION ALL SELECT DISTINCT a FROM a UNION ALL SELECT t || c FROM t UNION ALL SELECT t || o FROM t UNION ALL SELECT a || t FROM a UNION ALL SELECT DISTINCT a || 'label' FROM a UNION ALL SELECT DISTINCT a || 'b' FROM a UNION ALL SELECT DISTINCT a || 'var' FROM a UNION ALL SELECT DISTINCT a || 'val' FROM a)")
def circuit_lines(spark, d):
    """Written out, read back, written again: the same lines."""
    made = qrecon(spark, d).settle()
    lines = made.to_ntriples()
    again = C.from_ntriples(spark, lines).to_ntriples()
    return lines.join(again, "line").agg(F.count("*").alias("lines"))


@query("""
WITH e AS (SELECT event_id, user_id, unnest([event_id % 3, (event_id + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) % 3]) AS src FROM events),
x AS (SELECT DISTINCT event_id, user_id, src FROM e)
SELECT count(DISTINCT event_id) + count(DISTINCT user_id) AS shared, (SELECT count(*) FROM x) + (SELECT count(*) FROM (SELECT DISTINCT src, user_id FROM x)) AS separate FROM x""")
def multisource(spark, d):
    """Sources that overlap: gates of one shared circuit against those of one circuit per source."""
    events = T.table(spark, d, "events")
    even = F.when(F.col("event_id") % 2 == 0, 1).otherwise(0)
    held = events.withColumn("src", F.explode(F.array_distinct(F.array(F.col("event_id") % 3, (F.col("event_id") + even) % 3))))
    rows = R.scan(held, T.token("events", F.col("event_id")), {"user": T.entity("user", F.col("user_id")), "src": F.col("src").cast("string")})
    joint = R.Relation(rows.df.drop("src"), ("user",), rows.gates)
    shared = C.answers([(joint, False)], ("user",), tagged("events")).gates.agg(F.count("*").alias("shared"))
    own = rows.df.select("src", "user", rows.gates[0]).distinct()
    separate = own.agg((F.count("*") + F.count_distinct("src", "user")).alias("separate"))
    return shared.crossJoin(separate)


# ---- query text over facts


def nation_facts(spark, d) -> DataFrame:
    """Nations and regions as facts, keys as integers, one token per fact."""
    integer = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>'))
    n, r = T.table(spark, d, "nation"), T.table(spark, d, "region")
    ns, rs = T.entity("nation", F.col("n_nationkey")), T.entity("region", F.col("r_regionkey"))
    rows = [
        n.select(ns.alias("s"), F.lit("<urn:name>").alias("p"), T.plain(F.col("n_name")).alias("o")),
        n.select(ns.alias("s"), F.lit("<urn:key>").alias("p"), integer(F.col("n_nationkey")).alias("o")),
        n.select(ns.alias("s"), F.lit("<urn:in>").alias("p"), T.entity("region", F.col("n_regionkey")).alias("o")),
        r.select(rs.alias("s"), F.lit("<urn:name>").alias("p"), T.plain(F.col("r_name")).alias("o")),
    ]
    return reification.tokens(R.union_frames(rows))


def ask(spark, d, text: str, **config) -> C.Circuit:
    return Engine(nation_facts(spark, d), Config(**config)).circuit(text)


STR = "'\"' || {} || '\"^^<http://www.w3.org/2001/XMLSchema#string>'"
N_NAME, R_NAME = STR.format("n_name"), STR.format("r_name")


@query(f"SELECT {N_NAME} AS n FROM nation WHERE n_nationkey > 10 AND n_nationkey * 2 <= 40 AND regexp_matches(n_name, '[0-4]$')")
def filter_numeric(spark, d):
    text = 'SELECT ?n WHERE { ?x <urn:name> ?n ; <urn:key> ?k FILTER(?k > 10 && ?k * 2 <= 40 && REGEX(STR(?n), "[0-4]$")) }'
    return ask(spark, d, text, mode="flat").answers.select("n")


@query(f"SELECT {R_NAME} AS n FROM region")
def filter_terms(spark, d):
    text = """SELECT ?n WHERE { ?x <urn:name> ?n FILTER(isIRI(?x) && isLiteral(?n) && BOUND(?n) && !isNumeric(?n)
      && LANG(?n) = "" && DATATYPE(?n) = <http://www.w3.org/2001/XMLSchema#string> && sameTerm(?n, ?n) && REGEX(STR(?x), "/REGION/", "i")) }"""
    return ask(spark, d, text, mode="flat").answers.select("n")


@query(f"SELECT {N_NAME} AS a, NULL AS b FROM nation UNION SELECT {R_NAME}, NULL FROM region UNION SELECT NULL, '<http://example.org/region/' || n_regionkey || '>' FROM nation")
def union_hetero(spark, d):
    """Branches that bind different variables."""
    return ask(spark, d, "SELECT ?a ?b WHERE { { ?x <urn:name> ?a } UNION { ?x <urn:in> ?b } }", mode="flat").answers.select("a", "b")


@query(f"SELECT {N_NAME} AS n, {R_NAME} AS m FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT {N_NAME}, NULL FROM nation")
def optional_text(spark, d):
    """Both the extended and the bare answer of every left row."""
    text = "SELECT ?n ?m WHERE { ?x <urn:name> ?n . ?x <urn:in> ?r OPTIONAL { ?r <urn:name> ?m } }"
    return ask(spark, d, text, mode="flat").answers.select("n", "m")


@query(f"SELECT {R_NAME} AS n FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation) UNION ALL SELECT {N_NAME} FROM nation")
def certain_minus(spark, d):
    """The same text over certain facts: an anti-join."""
    engine = Engine(nation_facts(spark, d))
    return engine.certain("SELECT ?n WHERE { ?x <urn:name> ?n MINUS { ?y <urn:in> ?x } }")


@query("SELECT '<http://example.org/region/' || n_regionkey || '>' AS r, 4 * count(*) + 2 AS gates FROM nation GROUP BY n_regionkey")
def factored_cone(spark, d):
    """Summing out: gates below an answer grow with the facts, not with the derivations.

    For each nation a base sum of either fact, a sum over its keys, and a product; for each region a sum, and the answer.
    """
    made = ask(spark, d, "SELECT ?r WHERE { ?x <urn:in> ?r . ?x <urn:key> ?k }").settle()
    sizes = made.cone_sizes().join(made.answers, "root")
    return sizes.select("r", "gates")


BIG = "9007199254740992"


@query(f"SELECT '<urn:n:' || n_nationkey || '>' AS x FROM nation WHERE n_nationkey + {BIG} = {BIG} + 1 OR n_nationkey + {BIG} > {BIG} + 23")
def filter_big(spark, d):
    """Integers that doubles can't tell apart, compared and added."""
    n = T.table(spark, d, "nation")
    value = F.concat(F.lit('"'), (F.col("n_nationkey").cast("long") + int(BIG)).cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>'))
    name = lambda c: F.concat(F.lit("<urn:n:"), c, F.lit(">"))
    facts = n.select(F.concat(F.lit("urn:v:"), "n_nationkey").alias("token"), name(F.col("n_nationkey")).alias("s"), F.lit("<urn:v>").alias("p"), value.alias("o"))
    return Engine(facts).circuit(f"SELECT ?x WHERE {{ ?x <urn:v> ?v FILTER(?v = {int(BIG) + 1} || ?v - 24 + 1 > {BIG}) }}").answers.select("x")


@query(f"SELECT {N_NAME} AS n, {R_NAME} AS m FROM nation JOIN region ON n_regionkey = r_regionkey")
def vars_case(spark, d):
    """Variables that differ by case alone."""
    found = ask(spark, d, "SELECT ?n ?N WHERE { ?x <urn:name> ?n . ?x <urn:in> ?X . ?X <urn:name> ?N }").answers
    first, second = [c for c in found.columns if c != "root"]
    return found.select(F.col(f"`{second}`").alias("n"), F.col(f"`{first}`").alias("m")) if first == "N" else found.select(F.col(first).alias("n"), F.col(f"`{second}`").alias("m"))


@query("SELECT '<http://example.org/nation/' || a.n_nationkey || '>' AS a, '<http://example.org/nation/' || b.n_nationkey || '>' AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def selfjoin(spark, d):
    """One predicate twice: a pair of a nation with itself uses one fact."""
    return ask(spark, d, "SELECT ?a ?b WHERE { ?a <urn:in> ?r . ?b <urn:in> ?r }").answers.select("a", "b")


@query(f"SELECT {N_NAME} AS n, {R_NAME} AS m, CASE WHEN w.k = 1 THEN '\"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' END AS k FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([0, 1]) AS k) w UNION ALL SELECT {N_NAME}, NULL, CASE WHEN w.k = 1 THEN '\"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' END FROM nation, (SELECT unnest([0, 1]) AS k) w")
def two_optionals(spark, d):
    """Two optional parts: every combination of present and absent is possible."""
    text = "SELECT ?n ?m ?k WHERE { ?x <urn:name> ?n . ?x <urn:in> ?r OPTIONAL { ?r <urn:name> ?m } OPTIONAL { ?x <urn:key> ?k } }"
    return ask(spark, d, text).answers.select("n", "m", "k")


# ---- query text over growing tables: rows are tokens, columns facts


def order_facts(spark, d) -> DataFrame:
    """Customers with their segment, orders with their customer and whether they are finished, lines with their order."""
    c, o, l = T.table(spark, d, "customer"), T.table(spark, d, "orders"), T.table(spark, d, "lineitem")
    cust, order = (lambda k: T.entity("customer", F.col(k))), (lambda k: T.entity("order", F.col(k)))
    line = T.entity("line", F.concat_ws("-", *[F.col(x).cast("string") for x in LINE]))

    def fact(table, s, p, o, keep="true"):
        return table.where(keep).select(s.alias("token"), s.alias("s"), F.lit(f"<urn:{p}>").alias("p"), o.alias("o"))

    return R.union_frames([
        fact(c, cust("c_custkey"), "segment", T.plain(F.col("c_mktsegment"))),
        fact(o, order("o_orderkey"), "by", cust("o_custkey")),
        fact(o, order("o_orderkey"), "finished", cust("o_custkey"), "o_orderstatus = 'F'"),
        fact(l, line, "returned", order("l_orderkey"), "l_returnflag = 'R'"),
    ])


def order_probs(spark, d) -> DataFrame:
    c, o, l = T.table(spark, d, "customer"), T.table(spark, d, "orders"), T.table(spark, d, "lineitem")
    line = T.entity("line", F.concat_ws("-", *[F.col(x).cast("string") for x in LINE]))
    return R.union_frames([
        c.select(T.entity("customer", F.col("c_custkey")).alias("token"), share(F.col("c_custkey")).alias("p")),
        o.select(T.entity("order", F.col("o_orderkey")).alias("token"), share(F.col("o_orderkey")).alias("p")),
        l.select(line.alias("token"), share(F.expr(LINE_KEY)).alias("p")),
    ])


def asked(spark, d, text: str, *names: str, **config) -> DataFrame:
    """Answers with probabilities, through parser, planner, circuit and compiler."""
    found = Engine(order_facts(spark, d), Config(**config)).probabilities(text, order_probs(spark, d))
    return found.select(*names, F.round("probability", 9).alias("probability"))


CUST, ORDER_ = "'<http://example.org/customer/' || {} || '>'", "'<http://example.org/order/' || {} || '>'"
TEXT_RECON = f"""
SELECT {CUST.format('c_custkey')} AS c, round({P_CUST} * (1 - product(1 - {P_ORDER})), 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey"""
ASK_RECON = 'SELECT ?c WHERE { ?c <urn:segment> "BUILDING" . ?o <urn:by> ?c }'


@query(TEXT_RECON)
def text_recon_flat(spark, d):
    return asked(spark, d, ASK_RECON, "c", mode="flat")


@query(TEXT_RECON)
def text_recon_factored(spark, d):
    return asked(spark, d, ASK_RECON, "c", mode="factored")


@query(f"""
SELECT {CUST.format('c_custkey')} AS c, {ORDER_.format('o_orderkey')} AS o, round({P_CUST} * {P_ORDER} * (1 - product(1 - {P_LINE})), 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey, o_orderkey""")
def text_q3(spark, d):
    """Three tables: orders of a segment with some returned line."""
    return asked(spark, d, 'SELECT ?c ?o WHERE { ?c <urn:segment> "BUILDING" . ?o <urn:by> ?c . ?l <urn:returned> ?o }', "c", "o")


@query(f"""
SELECT {CUST.format('c_custkey')} AS c, round({P_CUST} * coalesce(q, 1.0), 9) AS probability FROM customer
LEFT JOIN (SELECT o_custkey, product(1 - {P_ORDER}) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING'""")
def text_minus(spark, d):
    """Customers of a segment without a finished order."""
    return asked(spark, d, 'SELECT ?c WHERE { ?c <urn:segment> "BUILDING" MINUS { ?o <urn:finished> ?c } }', "c")


@query(f"""
SELECT {CUST.format('c_custkey')} AS c, round({P_CUST} * (1 - product(1 - {P_ORDER} * CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)), 9) AS probability
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0""")
def text_star(spark, d):
    """A star of two facts with one token: customers of a segment with an order that is theirs and finished."""
    return asked(spark, d, 'SELECT ?c WHERE { ?c <urn:segment> "BUILDING" . ?o <urn:by> ?c . ?o <urn:finished> ?c }', "c")


def graph_facts(spark, d) -> DataFrame:
    """A graph on nation keys: p goes from k to 7k+3, q from k to k+5, modulo the number of nations."""
    n = T.table(spark, d, "nation")
    node = lambda c: F.concat(F.lit("<urn:n:"), c.cast("string"), F.lit(">"))
    k = F.col("n_nationkey")
    step = lambda p, to: n.select(F.concat(F.lit(f"urn:{p}:"), k).alias("token"), node(k).alias("s"), F.lit(f"<urn:{p}>").alias("p"), node(to).alias("o"))
    return step("p", (k * 7 + 3) % 25).unionByName(step("q", (k + 5) % 25))


GRAPH = """WITH RECURSIVE p AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation),
q AS (SELECT n_nationkey AS a, (n_nationkey + 5) % 25 AS b FROM nation)"""


def reach_sql(step: str, start: str = "SELECT b FROM step WHERE a = 0") -> str:
    return f"""{GRAPH}, step AS ({step}), r AS ({start} UNION SELECT step.b FROM r JOIN step ON r.b = step.a)
SELECT '<urn:n:' || b || '>' AS y FROM r"""


def walk(spark, d, text: str) -> DataFrame:
    return Engine(graph_facts(spark, d)).circuit(text).answers.drop("root")


@query(reach_sql("SELECT * FROM q"))
def path_plus(spark, d):
    return walk(spark, d, "SELECT ?y WHERE { <urn:n:0> <urn:q>+ ?y }")


@query(f"""{GRAPH}, step AS (SELECT * FROM q), r AS (SELECT p.b AS a, q.b AS b FROM p JOIN q ON p.b = q.a WHERE p.a IN (0, 1)
  UNION SELECT r.a, step.b FROM r JOIN step ON r.b = step.a)
SELECT '<urn:n:' || a || '>' AS y, '<urn:n:' || b || '>' AS z FROM r""")
def path_bound_source(spark, d):
    """A closure from the terms that another pattern binds."""
    return walk(spark, d, "SELECT ?y ?z WHERE { { <urn:n:0> <urn:p> ?y } UNION { <urn:n:1> <urn:p> ?y } ?y <urn:q>+ ?z }")


@query(reach_sql("SELECT * FROM q", "SELECT 0 AS b"))
def path_star(spark, d):
    return walk(spark, d, "SELECT ?y WHERE { <urn:n:0> <urn:q>* ?y }")


@query(reach_sql("SELECT b AS a, a AS b FROM q"))
def path_inverse(spark, d):
    return walk(spark, d, "SELECT ?y WHERE { <urn:n:0> (^<urn:q>)+ ?y }")


@query(reach_sql("SELECT p.a, q.b FROM p JOIN q ON p.b = q.a"))
def path_sequence(spark, d):
    return walk(spark, d, "SELECT ?y WHERE { <urn:n:0> (<urn:p>/<urn:q>)+ ?y }")


@query(f"{GRAPH} SELECT '<urn:n:' || b || '>' AS y FROM (SELECT b FROM p WHERE a = 0 UNION SELECT b FROM q WHERE a = 0)")
def path_choice(spark, d):
    return walk(spark, d, "SELECT ?y WHERE { <urn:n:0> <urn:p>|<urn:q> ?y }")


@query(f"{GRAPH} SELECT '<urn:n:' || a || '>' AS x, '<urn:n:' || b || '>' AS y FROM p UNION SELECT '<urn:n:' || a || '>', '<urn:n:' || a || '>' FROM p")
def path_maybe(spark, d):
    return walk(spark, d, "SELECT ?x ?y WHERE { ?x <urn:p>? ?y }")


@query(reach_sql("SELECT b AS a, a AS b FROM q").replace(" AS y", " AS x"))
def path_to(spark, d):
    """A closure with a constant end grows from it."""
    return walk(spark, d, "SELECT ?x WHERE { ?x <urn:q>+ <urn:n:0> }")


@query("SELECT '<urn:n:' || k * 5 % 25 || '>' AS y, round((SELECT product(CAST(1 + (j * 5 % 25) % 97 AS DOUBLE) / 101) FROM range(0, k) t(j)), 9) AS probability FROM range(1, 6) s(k)")
def path_probability(spark, d):
    """On a ring of five, reaching a node takes every edge before it."""
    facts = graph_facts(spark, d)
    made = Engine(facts).circuit("SELECT ?y WHERE { <urn:n:0> <urn:q>+ ?y }").settle()
    key = F.substring_index("token", ":", -1).cast("long")
    probs = facts.select("token", share(key).alias("p"))
    return solved(made, probs).drop("method")


@query(f"{GRAPH}, r AS (SELECT b, 1 AS level FROM q WHERE a = 0 UNION ALL SELECT q.b, level + 1 FROM r JOIN q ON r.b = q.a WHERE level < 6) SELECT '<urn:n:0>' AS s, '<urn:n:' || b || '>' AS n, level FROM r")
def path_levels(spark, d):
    """Which nodes each level of a closure has gates for."""
    planner = Engine(graph_facts(spark, d)).planner()
    path = sparql.parse("SELECT ?y WHERE { <urn:n:0> <urn:q>+ ?y }").body
    assert isinstance(path, algebra.Path)
    return paths.levels(planner, path)


# ---- layouts


def _roundtrip(layout: str, sql: str):
    def run(spark, d):
        n = T.table(spark, d, "nation")
        k = F.col("n_nationkey")
        subject = T.entity("nation", k)
        token = T.token("nation", k) if layout == "naryrel" else F.concat(F.lit("urn:t:"), k.cast("string"))
        found = n.select(
            token.alias("token"), subject.alias("s"), F.lit("<http://www.wikidata.org/prop/direct/P1>").alias("p"), T.plain(F.col("n_name")).alias("o")
        )
        return reification.facts(reification.statements(found, layout), layout)

    run.__name__ = f"reify_{layout}"
    query(sql)(run)


for _layout in reification.SCHEMES:
    _token = "'http://example.org/nation/' || n_nationkey" if _layout == "naryrel" else "'urn:t:' || n_nationkey"
    _roundtrip(
        _layout,
        f"SELECT {_token} AS token, '<http://example.org/nation/' || n_nationkey || '>' AS s, '<http://www.wikidata.org/prop/direct/P1>' AS p, {N_NAME} AS o FROM nation",
    )


@query(f"""
SELECT 'http://example.org/supplier/' || s_suppkey AS token, p, o FROM (
  SELECT s_suppkey, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://example.org/s_suppkey>', '<http://example.org/s_name>', '<http://example.org/s_nationkey>']) AS p,
         unnest(['<http://example.org/supplier>', {STR.format('s_suppkey')}, {STR.format('s_name')}, '<http://example.org/nation/' || s_nationkey || '>']) AS o FROM supplier)""")
def direct_mapping(spark, d):
    """Rows as triples with the row's token."""
    mapping = next(m for m in T.MAPPINGS if m.table == "supplier")
    rows = T.table(spark, d, "supplier").drop("s_acctbal")
    return T.direct_mapping(rows, mapping).select("token", "p", "o")
