"""The registered queries of the engine's own operators, over the whole test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberline.functions import predicates as P
from amberline.functions import scalars as X
from amberline.operators import graph, merge, relational, search, thermal
from amberline.operators.store import Store
from amberline.streaming import streams
from amberline.tables import materialise, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)


def col(name: str):
    return F.col(name)


def _stored(spark: SparkSession, rows: DataFrame) -> Store:
    """A store of entities that the first column names, with the other columns as properties."""
    store = Store(spark)
    store.insert_rows(rows)
    return store


# --- filters -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
def eq_null_safe(s, d):
    return table(s, d, "customer").where(P.eq(col("c_mktsegment"), F.lit("BUILDING"))).select("c_custkey", "c_name")


@query("SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS x FROM orders) WHERE x IS DISTINCT FROM 'F'")
def ne_includes_null(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.when(col("o_orderkey") % 7 != 0, col("o_orderstatus")).alias("x"))
    return o.where(P.ne(col("x"), F.lit("F")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE coalesce(c_acctbal > 5000, false) OR coalesce(c_acctbal <= -500, false)")
def order_comparisons(s, d):
    return table(s, d, "customer").where(P.gt(col("c_acctbal"), 5000) | P.le(col("c_acctbal"), -500)).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def range_between(s, d):
    return table(s, d, "part").where(P.between(col("p_size"), 10, 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('A1'))")
def contains_ci(s, d):
    return table(s, d, "part").where(P.contains(col("p_name"), "A1")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'pr%'")
def ilike_prefix(s, d):
    return table(s, d, "part").where(P.like(col("p_type"), "pr%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, t FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS t FROM part) WHERE NOT coalesce(t ILIKE '%o%', false)")
def not_ilike(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(col("p_partkey") % 5 != 0, col("p_type")).alias("t"))
    return p.where(P.not_like(col("t"), "%o%"))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[12][0-9]*$')")
def regexp(s, d):
    return table(s, d, "part").where(P.regexp(col("p_brand"), "#[12][0-9]*$")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '#[12]')")
def not_regexp(s, d):
    return table(s, d, "part").where(P.not_regexp(col("p_brand"), "#[12]")).select("p_partkey", "p_brand")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def is_null(s, d):
    joined = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return joined.where(P.is_null(col("quality"))).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT DISTINCT FROM c_custkey)")
def in_subquery(s, d):
    big = table(s, d, "orders").where(P.gt(col("o_totalprice"), 300000)).select("o_custkey")
    return P.in_query(table(s, d, "customer").select("c_custkey"), "c_custkey", big)


@query("SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT DISTINCT FROM c.k)")
def not_in_two_valued(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(col("c_custkey") % 10 != 0, col("c_custkey")).alias("k"))
    return P.not_in_query(c, "k", table(s, d, "orders").where(P.eq(col("o_orderstatus"), F.lit("F"))).select("o_custkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_correlated(s, d):
    urgent = table(s, d, "orders").where(P.eq(col("o_orderpriority"), F.lit("1-URGENT")))
    return P.exists(table(s, d, "customer").select("c_custkey"), urgent, ("c_custkey", "o_custkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists(s, d):
    return P.not_exists(table(s, d, "customer").select("c_custkey"), table(s, d, "orders"), ("c_custkey", "o_custkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100)")
def exists_uncorrelated(s, d):
    return P.exists(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").where(P.gt(col("o_totalprice"), 100)))


def _quantified(name: str, op: str, kind: str, sql: str) -> None:
    def run(s, d):
        sub = table(s, d, "supplier").select("s_acctbal")
        return P.quantified(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", op, kind, sub)

    run.__name__ = name
    query(f"SELECT c_custkey, c_acctbal FROM customer WHERE {sql}")(run)


_quantified("gt_all", ">", "ALL", "c_acctbal > (SELECT max(s_acctbal) FROM supplier)")
_quantified("gt_any", ">", "ANY", "c_acctbal > (SELECT min(s_acctbal) FROM supplier)")
_quantified("ne_all", "!=", "ALL", "NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal = c_acctbal)")
_quantified("eq_any", "=", "ANY", "EXISTS (SELECT 1 FROM supplier WHERE s_acctbal = c_acctbal)")
_quantified("le_all", "<=", "ALL", "c_acctbal <= (SELECT min(s_acctbal) FROM supplier)")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR (NOT c_nationkey BETWEEN 5 AND 15 AND NOT c_name ILIKE '%1%')")
def boolean_tree(s, d):
    c = table(s, d, "customer")
    left = P.eq(col("c_mktsegment"), F.lit("BUILDING")) & P.gt(col("c_acctbal"), 0)
    return c.where(left | (P.negate(P.between(col("c_nationkey"), 5, 15)) & P.not_like(col("c_name"), "%1%"))).select("c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def dotted_json(s, d):
    k = X.json_value(col("props"), "k").cast("bigint")
    return table(s, d, "events").where(P.ge(k, 50)).select("event_id", k.alias("k"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_literals(s, d):
    return table(s, d, "orders").where(P.isin(col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


# --- projection and scalars ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, round(o_totalprice / nullif(CAST(o_custkey % 5 AS DOUBLE), 0), 4) AS r, round(o_totalprice * 2 - 1, 2) AS t FROM orders")
def arith_div_zero(s, d):
    return table(s, d, "orders").select("o_orderkey", F.round(X.divide(col("o_totalprice"), col("o_custkey") % 5), 4).alias("r"), F.round(col("o_totalprice") * 2 - 1, 2).alias("t"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 7500 THEN 'gold' WHEN c_acctbal > 2500 THEN 'silver' ELSE 'base' END AS tier FROM customer")
def case_tier(s, d):
    tier = X.case([(P.gt(col("c_acctbal"), 7500), "gold"), (P.gt(col("c_acctbal"), 2500), "silver")], "base")
    return table(s, d, "customer").select("c_custkey", tier.alias("tier"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS a, nullif(o_orderstatus, 'O') AS b FROM orders")
def coalesce_nullif(s, d):
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("a"), F.nullif("o_orderstatus", F.lit("O")).alias("b"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_nationkey AS VARCHAR) AS t, CAST(c_nationkey % 2 AS BOOLEAN) AS b FROM customer")
def cast_trunc(s, d):
    return table(s, d, "customer").select("c_custkey", X.cast(col("c_acctbal"), "int").alias("whole"), X.cast(col("c_nationkey"), "text").alias("t"), X.cast(col("c_nationkey") % 2, "bool").alias("b"))


@query("SELECT d.doc_id, coalesce(d.lang, '') || coalesce(CAST(l.quality AS VARCHAR), '') AS tag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def concat_null(s, d):
    joined = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", X.concat(col("lang"), col("quality")).alias("tag"))


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, regexp_replace('  ' || c_name || chr(9), '^\\s+|\\s+$', '', 'g') AS t FROM customer")
def trim_upper_lower(s, d):
    return table(s, d, "customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), X.trim(F.concat(F.lit("  "), "c_name", F.lit("\t"))).alias("t"))


@query("SELECT o_orderkey, coalesce(length(nullif(o_orderstatus, 'F')), 0) AS n FROM orders")
def length_null_zero(s, d):
    return table(s, d, "orders").select("o_orderkey", X.length(F.nullif("o_orderstatus", F.lit("F"))).alias("n"))


@query("SELECT c_custkey, substring(c_name, 1, 4) AS a, substring(c_name, 3, 5) AS b FROM customer")
def substring_clamp(s, d):
    return table(s, d, "customer").select("c_custkey", X.substring(col("c_name"), -3, 4).alias("a"), X.substring(col("c_name"), 3, 5).alias("b"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_value(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(X.json_value(col("props"), "$.k").cast("bigint")).alias("total"))


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 2) AS off FROM customer")
def scalar_subquery_uncorrelated(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return relational.with_scalar(c, c.agg(F.avg("c_acctbal")), "mean").select("c_custkey", F.round(col("c_acctbal") - col("mean"), 2).alias("off"))


@query("SELECT c_custkey, coalesce(round((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 2), 0) AS spent FROM customer")
def scalar_subquery_correlated(s, d):
    spent = relational.with_correlated(table(s, d, "customer").select("c_custkey"), table(s, d, "orders"), ("c_custkey", "o_custkey"), F.sum("o_totalprice"), "s")
    return spent.select("c_custkey", F.coalesce(F.round("s", 2), F.lit(0.0)).alias("spent"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(s, d):
    return table(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'PRAWDA' ELSE 'FAŁSZ' END AS canon FROM orders")
def canonical_text(s, d):
    return table(s, d, "orders").select("o_orderkey", X.canonical(col("o_orderstatus") == "F", "boolean").alias("canon"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_equi(s, d):
    return relational.join(table(s, d, "customer"), table(s, d, "nation"), [("c_nationkey", "n_nationkey")], alias="N").select("c_custkey", col("`N.n_name`").alias("n_name"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_outer_unmatched(s, d):
    return relational.join(table(s, d, "customer"), table(s, d, "orders"), [("c_custkey", "o_custkey")], "left", "O").select("c_custkey", col("`O.o_orderkey`").alias("o_orderkey"))


@query("SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS r, n_nationkey % 2 AS p FROM nation) a JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS r, n_nationkey % 2 AS p FROM nation) b ON a.r IS NOT DISTINCT FROM b.r AND a.p IS NOT DISTINCT FROM b.p")
def multi_key_null_safe(s, d):
    n = table(s, d, "nation").select(col("n_nationkey").alias("k"), F.when(col("n_nationkey") % 4 != 0, col("n_regionkey")).alias("r"), (col("n_nationkey") % 2).alias("p"))
    return relational.join(n, n, [("r", "r"), ("p", "p")], alias="B").select(col("k").alias("a"), col("`B.k`").alias("b"))


@query("SELECT c_mktsegment, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def chained_3way(s, d):
    owners = relational.join(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select("c_custkey", "c_mktsegment"), [("o_custkey", "c_custkey")], alias="C")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    # The two narrow tables meet first, so the lines are moved once, or not at all if those are small.
    j = relational.join(lines, owners.select("o_orderkey", col("`C.c_mktsegment`").alias("segment")), [("l_orderkey", "o_orderkey")], alias="O")
    return j.groupBy(col("`O.segment`").alias("c_mktsegment")).agg(F.count("*").alias("lines"), F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
def filtered_right(s, d):
    right = table(s, d, "orders").where(P.gt(col("o_totalprice"), 200000))
    return relational.join(table(s, d, "customer"), right, [("c_custkey", "o_custkey")]).select("c_custkey", col("`Prawa.o_orderkey`").alias("o_orderkey"))


def _edges(s, d) -> DataFrame:
    """customer -> nation -> region as relations between names."""
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.lit("in_nation").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.lit("in_region").alias("relation"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return c.unionByName(n)


EDGES = """edges AS (SELECT 'c' || c_custkey AS source, 'in_nation' AS relation, 'n' || c_nationkey AS target FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey FROM nation)"""


@query(f"WITH {EDGES} SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM edges WHERE source = 'c' || c_custkey AND relation = 'in_nation' AND target = 'n3')")
def semi_relation(s, d):
    c = table(s, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("name"))
    return relational.related(c, _edges(s, d), "in_nation", "n3").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(s, d):
    return P.not_exists(table(s, d, "part").select("p_partkey"), table(s, d, "lineitem").where(P.gt(col("l_quantity"), 45)), ("p_partkey", "l_partkey"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name <> b.s_name")
def self_excluding_self(s, d):
    x = table(s, d, "supplier")
    return relational.join(x, x, [("s_nationkey", "s_nationkey")], alias="B", not_itself=("s_name", "s_name")).select(col("s_suppkey").alias("a"), col("`B.s_suppkey`").alias("b"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT coalesce(sum(c_acctbal), 0) AS total, coalesce(avg(c_acctbal), 0) AS mean, min(c_acctbal) AS low FROM customer WHERE c_custkey < 0")
def sum_empty_zero(s, d):
    c = table(s, d, "customer").where("c_custkey < 0")
    return c.agg(relational.aggregate("sum", col("c_acctbal")).alias("total"), relational.aggregate("avg", col("c_acctbal")).alias("mean"), relational.aggregate("min", col("c_acctbal")).alias("low"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(s, d):
    x = table(s, d, "lineitem").where(col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = col("l_extendedprice") * (1 - col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment")
def avg_group(s, d):
    return relational.grouped(table(s, d, "customer"), ["c_mktsegment"], {"mean": F.round(relational.aggregate("avg", col("c_acctbal")), 6)})


@query("SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def min_max(s, d):
    return relational.grouped(table(s, d, "part"), ["p_brand"], {"low": relational.aggregate("min", col("p_retailprice")), "high": relational.aggregate("max", col("p_retailprice"))})


@query("SELECT count(nullif(o_orderstatus, 'F')) AS n FROM orders")
def count_nonnull(s, d):
    return table(s, d, "orders").agg(relational.aggregate("count", F.nullif("o_orderstatus", F.lit("F"))).alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def count_distinct(s, d):
    return relational.grouped(table(s, d, "lineitem"), ["l_returnflag"], {"parts": relational.aggregate("count_distinct", col("l_partkey"))})


@query("SELECT coalesce(nullif(o_orderstatus, 'F'), 'NIC') || ' | ' || o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def group_multi_label(s, d):
    o = table(s, d, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("st"), "o_orderpriority")
    return o.groupBy("st", "o_orderpriority").agg(F.count("*").alias("n")).select(relational.label("st", "o_orderpriority").alias("label"), "n")


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2 HAVING round(sum(c_acctbal), 2) > 1000")
def having_sum(s, d):
    j = table(s, d, "customer").where(P.gt(col("c_acctbal"), 0)).join(table(s, d, "nation"), col("c_nationkey") == col("n_nationkey"))
    return relational.grouped(j, ["n_name", "c_mktsegment"], {"n": F.count("*"), "total": F.round(F.sum("c_acctbal"), 2)}, col("total") > 1000)


@query("SELECT round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def limit_before_agg(s, d):
    return table(s, d, "orders").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(100).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24")
def count_where(s, d):
    return table(s, d, "lineitem").where(P.gt(col("l_discount"), 0.05) & P.lt(col("l_quantity"), 24)).agg(F.count("*").alias("n"))


# --- windows -------------------------------------------------------------------------------------------------------


def _ranked(name: str, kind: str, order: str) -> None:
    def run(s, d):
        o = table(s, d, "orders")
        by = [col("o_totalprice").desc(), col("o_orderkey")] if kind == "row_number" else [col("o_orderpriority")]
        return o.select("o_orderkey", relational.ranked(kind, ["o_custkey"], by).alias("r"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {kind}() OVER (PARTITION BY o_custkey ORDER BY {order}) AS r FROM orders")(run)


_ranked("row_number", "row_number", "o_totalprice DESC, o_orderkey")
_ranked("rank", "rank", "o_orderpriority")
_ranked("dense_rank", "dense_rank", "o_orderpriority")


@query("SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 4 / count(*) OVER (PARTITION BY user_id)) AS BIGINT) + 1 AS b FROM events")
def ntile_floor(s, d):
    return table(s, d, "events").select("event_id", relational.ntile(4, ["user_id"], [col("event_id")]).alias("b"))


@query("SELECT event_id, lag(value) OVER w AS p, lead(value, 2) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.lag("value").over(w).alias("p"), F.lead("value", 2).over(w).alias("q"))


@query("SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def first_last_value(s, d):
    w = relational.over(["user_id"], [col("ts"), col("event_id")])
    return table(s, d, "events").select("event_id", F.first("value").over(w).alias("f"), F.last("value").over(w).alias("l"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS run FROM events")
def running_sum_rows(s, d):
    return table(s, d, "events").select("event_id", F.round(F.sum("value").over(relational.over(["user_id"], [col("ts"), col("event_id")])), 4).alias("run"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def partition_sum(s, d):
    w = relational.over(["o_custkey"])
    return table(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"), F.max("o_totalprice").over(w).alias("top"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations")
def count_star_over(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.count("*").over(relational.over(["conv_id"])).alias("n"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS x FROM events")
def rows_1p1f(s, d):
    return table(s, d, "events").select("event_id", F.round(F.sum("value").over(relational.over(["user_id"], [col("event_id")], rows=(-1, 1))), 4).alias("x"))


@query("SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), 2) AS x FROM part")
def range_10p(s, d):
    return table(s, d, "part").select("p_partkey", F.round(F.sum("p_retailprice").over(relational.over(["p_brand"], [col("p_size")], values=(-10, 0))), 2).alias("x"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM part")
def range_peers(s, d):
    return table(s, d, "part").select("p_partkey", F.count("*").over(relational.over(["p_brand"], [col("p_size")], values=(relational.FIRST, 0))).alias("n"))


# --- sorting and sets ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def topk_multi_desc(s, d):
    return relational.ordered(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], True, 25)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 20 OFFSET 30")
def limit_offset(s, d):
    return relational.ordered(table(s, d, "customer"), ["c_acctbal", "c_custkey"], limit=20, offset=30).select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return relational.union(table(s, d, "customer").select(col("c_nationkey").alias("k")), table(s, d, "supplier").select(col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey IS NOT DISTINCT FROM c.c_nationkey)")
def intersect_semi(s, d):
    return relational.intersect(table(s, d, "customer").select(col("c_nationkey").alias("k")), table(s, d, "supplier").select(col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 3000 AND s_nationkey IS NOT DISTINCT FROM c.c_nationkey)")
def except_anti(s, d):
    return relational.difference(table(s, d, "customer").select(col("c_nationkey").alias("k")), table(s, d, "supplier").where(P.gt(col("s_acctbal"), 3000)).select(col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 INTERSECT SELECT s_nationkey FROM supplier)")
def set_precedence(s, d):
    n = table(s, d, "nation")
    one, two = (n.where(P.eq(col("n_regionkey"), F.lit(r))).select(col("n_nationkey").alias("k")) for r in (1, 2))
    return relational.union(one, relational.intersect(two, table(s, d, "supplier").select(col("s_nationkey").alias("k"))))


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT target AS name FROM edges WHERE source = 'n7' UNION SELECT source FROM edges WHERE target = 'n7'")
def neighbours(s, d):
    return graph.neighbours(_edges(s, d), "n7")


@query(f"WITH {EDGES}, u AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges), one AS (SELECT b FROM u WHERE a = 'n7'), two AS (SELECT u.b FROM one JOIN u ON one.b = u.a) SELECT name, CAST(min(h) AS INTEGER) AS hops FROM (SELECT 'n7' AS name, 0 AS h UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two) GROUP BY name")
def bfs_radius2(s, d):
    e = _edges(s, d)
    nodes = e.select("source").union(e.select("target")).distinct()
    return graph.within(e, nodes, ["n7", "unknown"], 2)


@query(f"WITH RECURSIVE {EDGES}, u AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges), reach(a, b) AS (SELECT DISTINCT b, a FROM u WHERE b LIKE 'r%' UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a) SELECT name, min(m) AS region FROM (SELECT b AS name, min(x) OVER (PARTITION BY a) AS m FROM (SELECT a, b, b AS x FROM reach UNION SELECT a, a, a FROM reach)) GROUP BY name")
def components(s, d):
    e = _edges(s, d)
    return graph.regions(e.select("source").union(e.select("target")), e)


@query(f"WITH {EDGES} SELECT name, max(energy) AS energy FROM (SELECT 'c1' AS name, CAST(10 AS DOUBLE) AS energy UNION ALL SELECT target, 5 FROM edges WHERE source = 'c1' UNION ALL SELECT b.target, 2.5 FROM edges a JOIN edges b ON a.target = b.source WHERE a.source = 'c1') GROUP BY name")
def spreading_activation(s, d):
    return graph.activation(_edges(s, d), "c1", 10.0)


@query(f"WITH RECURSIVE {EDGES}, r(name) AS (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT target FROM r JOIN edges ON source = name) SELECT name FROM r")
def reachability(s, d):
    roots = table(s, d, "customer").where(P.gt(col("c_acctbal"), 9000)).select(F.concat(F.lit("c"), "c_custkey").alias("name"))
    return graph.reachable(_edges(s, d), roots)


@query(f"WITH {EDGES} SELECT DISTINCT source AS name FROM edges WHERE relation = 'in_region' AND target = 'r2'")
def find_by_relation(s, d):
    return graph.find_by_relation(_edges(s, d), "in_region", "r2")


# --- temperature and time ------------------------------------------------------------------------------------------

HEAT = "100 * (value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events))"


def _frames(s, d) -> DataFrame:
    """Users as atoms: their hottest event of each day; day numbers are the ticks."""
    e = table(s, d, "events")
    bounds = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    day = F.datediff(col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return e.join(bounds, F.lit(True)).groupBy(day.alias("tick"), col("user_id").alias("atom_id")).agg(F.max(100 * (col("value") - col("lo")) / (col("hi") - col("lo"))).alias("T"))


FRAMES = f"frames AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS tick, user_id AS atom_id, max({HEAT}) AS T FROM events GROUP BY 1, 2)"


@query(f"SELECT event_id, round(t, 6) AS T, CASE WHEN t >= 70 THEN 'HOT' WHEN t >= 30 THEN 'WARM' WHEN t >= 2 THEN 'COLD' ELSE 'TOMB' END AS state FROM (SELECT event_id, {HEAT} * power(0.92, 3) AS t FROM events)")
def decay_n_ticks(s, d):
    e = table(s, d, "events")
    bounds = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    t = thermal.decayed(100 * (col("value") - col("lo")) / (col("hi") - col("lo")), 3)
    return e.join(bounds, F.lit(True)).select("event_id", F.round(t, 6).alias("T"), thermal.state(t).alias("state"))


@query(f"WITH {FRAMES} SELECT tick, CASE WHEN T >= 70 THEN 'HOT' WHEN T >= 30 THEN 'WARM' WHEN T >= 2 THEN 'COLD' ELSE 'TOMB' END AS state, count(*) AS atoms FROM frames GROUP BY 1, 2")
def state_histogram(s, d):
    return thermal.state_counts(_frames(s, d))


@query(f"WITH {FRAMES}, m AS (SELECT min(tick) + 15 AS x FROM frames) SELECT atom_id, tick, round(T, 6) AS T FROM frames, m WHERE tick <= x QUALIFY row_number() OVER (PARTITION BY atom_id ORDER BY tick DESC) = 1")
def as_of_tick(s, d):
    # From the events themselves, so that the frames are built once.
    first = F.broadcast(table(s, d, "events").agg((F.datediff(F.min(col("ts").cast("date")), F.lit("1970-01-01").cast("date")) + 15).alias("at")))
    return thermal.as_of(_frames(s, d).join(first, F.lit(True)), col("at")).select("atom_id", "tick", F.round("T", 6).alias("T"))


@query(f"WITH {FRAMES} SELECT tick, round(T, 6) AS T FROM frames WHERE atom_id = 7")
def timeline(s, d):
    return thermal.timeline(_frames(s, d), 7).select("tick", F.round("T", 6).alias("T"))


@query(f"WITH {FRAMES} SELECT tick, round(min(T), 6) AS T_min, round(max(T), 6) AS T_max, count(*) AS atoms FROM frames GROUP BY tick HAVING max(T) >= 90 AND min(T) <= 1")
def t_range_overlap(s, d):
    return thermal.ticks_in_range(_frames(s, d), 90, 1).select("tick", F.round("T_min", 6).alias("T_min"), F.round("T_max", 6).alias("T_max"), "atoms")


@query(f"WITH {FRAMES} SELECT tick, atom_id, (row_number() OVER w - 1) % 16 = 0 AS key, round(T - lag(T) OVER w, 6) AS dT FROM frames WINDOW w AS (PARTITION BY atom_id ORDER BY tick)")
def delta_frames(s, d):
    return thermal.deltas(_frames(s, d)).select("tick", "atom_id", "key", F.round("dT", 6).alias("dT"))


@query(f"WITH {FRAMES}, t AS (SELECT DISTINCT tick FROM frames) SELECT tick, lag(tick) OVER w IS NULL AS first, tick % 7 = 0 OR coalesce(lag(tick) OVER w % 7 = 0, false) AS broken FROM t WINDOW w AS (ORDER BY tick)")
def chain_verify(s, d):
    """A chain that was written, held against frames of which every seventh tick was changed since."""
    frames = _frames(s, d)
    chain = materialise(thermal.chained(frames), "chain")
    changed = frames.withColumn("T", F.when(col("tick") % 7 == 0, col("T") + 1).otherwise(col("T")))
    broken = thermal.broken_links(chain, changed).withColumn("_broken", F.lit(True))
    return chain.join(broken, "tick", "left").select("tick", col("previous").isNull().alias("first"), col("_broken").isNotNull().alias("broken"))


@query(f"SELECT event_id FROM events WHERE {HEAT} * power(0.92, 20) >= 2 OR user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def tick_with_retention(s, d):
    e = table(s, d, "events")
    bounds = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    atoms = e.join(bounds, F.lit(True)).select(col("event_id").alias("atom_id"), (100 * (col("value") - col("lo")) / (col("hi") - col("lo"))).alias("T"))
    rooted = P.in_query(e, "user_id", e.where(P.eq(col("event_type"), F.lit("purchase"))).select("user_id"))
    return thermal.tick(atoms, 20, rooted.select(col("event_id").alias("atom_id"))).select(col("atom_id").alias("event_id"))


@query(f"SELECT count(*) AS atoms, count(*) FILTER (t >= 70) AS hot, count(*) FILTER (t >= 30 AND t < 70) AS warm, count(*) FILTER (t >= 2 AND t < 30) AS cold, count(*) FILTER (t < 2) AS tomb FROM (SELECT {HEAT} AS t FROM events)")
def engine_stats(s, d):
    e = table(s, d, "events")
    bounds = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return thermal.stats(e.join(bounds, F.lit(True)).select((100 * (col("value") - col("lo")) / (col("hi") - col("lo"))).alias("T")))


# --- search and vectors --------------------------------------------------------------------------------------------

SQL_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"


@query(f"WITH q AS (SELECT {SQL_TOKENS.format('text')} AS t FROM benchmark WHERE item_id = 1), p AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents) SELECT doc_id, round(len(list_intersect(p.t, q.t)) / len(list_distinct(list_concat(p.t, q.t))), 9) AS j FROM p, q")
def token_jaccard(s, d):
    probe = F.broadcast(table(s, d, "benchmark").where("item_id = 1").select(search.tokens(col("text")).alias("q")))
    docs = table(s, d, "documents").select("doc_id", search.tokens(col("text")).alias("t"))
    return docs.join(probe, F.lit(True)).select("doc_id", F.round(search.jaccard(col("t"), col("q")), 9).alias("j"))


@query(f"WITH q AS (SELECT {SQL_TOKENS.format('text')} AS t FROM benchmark WHERE item_id = 1), p AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS t FROM documents), r AS (SELECT doc_id, len(list_intersect(p.t, q.t)) / len(list_distinct(list_concat(p.t, q.t))) AS v FROM p, q) SELECT doc_id, round(0.3 * v * v / 0.09, 9) AS R FROM r ORDER BY R DESC, doc_id LIMIT 16")
def lorentz_topk(s, d):
    probe = F.broadcast(table(s, d, "benchmark").where("item_id = 1").select(col("text").alias("q")))
    docs = table(s, d, "documents").select("doc_id", "text", F.lit(thermal.T_INIT).alias("T")).join(probe, F.lit(True))
    return search.resonating(docs, col("q"), r_min=0.0, limit=search.TOP, text_col="text", name_col="doc_id").select("doc_id", "R")


@query("""WITH g AS (SELECT p_partkey, p_name, lower(p_name) AS s FROM part), q AS (SELECT s FROM g WHERE p_partkey = 1),
f AS (SELECT p_partkey, s, list_distinct(list_concat(['=' || s],
        list_transform(range(1, CAST(length(s) + 2 AS BIGINT)), lambda i: substr('#' || s || '#', i, 2)),
        list_transform(range(1, CAST(length(s) + 1 AS BIGINT)), lambda i: substr('#' || s || '#', i, 3)),
        list_transform(string_split(s, ' '), lambda w: '$' || w),
        flatten(list_transform(string_split(s, ' '), lambda w: list_transform(range(2, CAST(length(w) + 1 AS BIGINT)), lambda k: '^' || substr(w, 1, k)))))) AS x FROM g),
p AS (SELECT x AS y FROM f WHERE p_partkey = 1)
SELECT p_partkey, CASE WHEN f.s = q.s THEN 1.0 ELSE round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 9) END AS sim FROM f, p, q""")
def ngram_dice(s, d):
    part = table(s, d, "part").select("p_partkey", "p_name")
    probe = part.where("p_partkey = 1").select(col("p_name").alias("q"))
    return search.with_surface_similarity(part, probe, "p_name", "q", "sim").select("p_partkey", F.round("sim", 9).alias("sim"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) DESC, vec_id LIMIT 10")
def cosine_topk(s, d):
    v = table(s, d, "embeddings")
    probe = v.where("vec_id = 0").select("embedding").first()[0]
    return search.nearest(v, probe, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(exp(-list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))), 9) AS sim FROM embeddings, q")
def yukawa_probe(s, d):
    v = table(s, d, "embeddings")
    probe = F.broadcast(v.where("vec_id = 0").select(col("embedding").alias("q")))
    return v.join(probe, F.lit(True)).select("vec_id", F.round(search.yukawa(col("embedding"), col("q")), 9).alias("sim"))


@query("WITH n AS (SELECT floor(max(epoch(ts)) / 3600) AS now FROM events), t AS (SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS e, value / 1000 AS r, event_id FROM events WHERE value / 1000 >= 0.05), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY e DESC, event_id) AS i FROM t QUALIFY i <= 256) SELECT key, round(least(greatest(sum(r * exp(-0.005 * (now - e))) / ((1 - exp(-0.005 * (now - min(e) + 1))) / (1 - exp(-0.005))), 0), 1), 9) AS M FROM (SELECT k.*, n.now FROM k, n) GROUP BY key, now")
def decayed_memory(s, d):
    hour = F.floor(F.unix_timestamp(col("ts").cast("timestamp")) / 3600).cast("bigint")
    e = table(s, d, "events").select(col("event_type").alias("key"), hour.alias("epoch"), (col("value") / 1000).alias("r"), "event_id")
    now = e.agg(F.max("epoch")).first()[0]
    # The latest traces of a key, ties by event_id, are settled before the general rule sees them.
    w = Window.partitionBy("key").orderBy(col("epoch").desc(), "event_id")
    kept = e.where(col("r") >= search.TRACE_MIN).withColumn("i", F.row_number().over(w)).where(col("i") <= search.TRACES)
    return search.memory(kept.select("key", "epoch", "r"), now).select("key", F.round("M", 9).alias("M"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(s, d):
    return search.content_classes(table(s, d, "documents"), "text", "doc_id")


@query()
def hrr_bind_unbind(s, d):
    from amberline.operators import vectors
    from amberline.packaging import ship

    ship(s)
    part = spread(table(s, d, "part").select("p_partkey", "p_name"))
    return part.select("p_partkey", F.round(vectors.recovery(col("p_name"), F.lit("role")), 6).alias("sim"))


@query("SELECT c_name AS name, round(CAST(0.3 / (0.09 + power(abs(c_acctbal - 1000) / 1000, 2)) AS DOUBLE), 6) AS R FROM customer WHERE 0.3 / (0.09 + power(abs(c_acctbal - 1000) / 1000, 2)) >= 0.15")
def rank_peers(s, d):
    peers = table(s, d, "customer").select(col("c_name").alias("name"), F.lit("graph node").alias("label"), (col("c_acctbal") / 1000).alias("energy"))
    return search.ranked_peers(peers, "node graph", 1.0).select("name", F.round("R", 6).alias("R"))


# --- changes and merging -------------------------------------------------------------------------------------------


@query("SELECT coalesce(c.k, b.k) AS k, coalesce(c.bal, b.bal) AS bal, b.seg FROM (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer) b FULL JOIN (SELECT o_custkey + 100 AS k, round(sum(o_totalprice), 2) AS bal FROM orders GROUP BY o_custkey) c ON b.k = c.k")
def upsert_by_key(s, d):
    base = table(s, d, "customer").select(col("c_custkey").alias("k"), col("c_acctbal").alias("bal"), col("c_mktsegment").alias("seg"))
    changes = table(s, d, "orders").groupBy((col("o_custkey") + 100).alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("bal"))
    return merge.upsert(base, changes, "k")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where_increment(s, d):
    store = _stored(s, table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"))
    hit = store.wide(c_mktsegment="text").where(P.eq(col("c_mktsegment"), F.lit("BUILDING"))).select("name")
    store.update(hit, "c_acctbal", "+5")
    return store.wide(c_acctbal="num").select(col("name").cast("bigint").alias("c_custkey"), "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 100000, false)")
def delete_where(s, d):
    store = _stored(s, table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    bad = P.eq(col("o_orderstatus"), F.lit("F")) & P.lt(col("o_totalprice"), 100000)
    store.delete(store.wide(o_orderstatus="text", o_totalprice="num").where(bad).select("name"))
    return store.names().select(col("name").cast("bigint").alias("o_orderkey"))


@query("SELECT CASE WHEN l.id IS NULL OR r.t > l.t + 0.001 THEN 'remote' ELSE 'local' END AS origin, coalesce(l.id, r.id) AS atom_id, CASE WHEN l.id IS NULL OR r.t > l.t + 0.001 THEN r.t ELSE l.t END AS T FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 97 AS DOUBLE) AS t FROM customer) l FULL JOIN (SELECT CAST(c_custkey + 50 AS VARCHAR) AS id, CAST(c_custkey % 89 AS DOUBLE) + 0.5 AS t FROM customer) r ON l.id = r.id")
def temperature_wins_merge(s, d):
    c = table(s, d, "customer")
    local = c.select(col("c_custkey").cast("string").alias("atom_id"), F.lit("s").alias("S"), col("c_name").alias("E"), (col("c_custkey") % 97).cast("double").alias("T"))
    remote = c.select((col("c_custkey") + 50).cast("string").alias("atom_id"), F.lit("s").alias("S"), col("c_name").alias("E"), ((col("c_custkey") % 89).cast("double") + 0.5).alias("T"))
    return merge.merge_atoms(local, remote).select("origin", "atom_id", "T")


@query("SELECT c_mktsegment AS v_text, count(*) AS rows FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_violations(s, d):
    return _stored(s, table(s, d, "customer").select("c_custkey", "c_mktsegment")).violations("unique", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)")
def check_violations(s, d):
    store = _stored(s, table(s, d, "customer").select("c_custkey", "c_acctbal"))
    return store.violations("check", "c_acctbal", lambda v: v["v_num"] >= 0).select(col("name").cast("bigint").alias("c_custkey"))


@query("SELECT o_custkey AS name, o_orderkey AS seq, o_orderstatus AS v, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'CURRENT' ELSE 'ARCHIVE' END AS status FROM orders")
def history_versions(s, d):
    store = Store(s)
    orders = table(s, d, "orders").select("o_custkey", F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("order"), "o_orderdate", "o_orderkey")
    store.set_rows(orders, order=["o_orderdate", "o_orderkey"])
    parts = F.split("v_text", ":")
    return store.versions("order").select(col("name").cast("bigint").alias("name"), parts[0].cast("bigint").alias("seq"), parts[1].alias("v"), "status")


@query("SELECT key, count(*) AS rows, min(v) AS sample FROM (SELECT 'c_mktsegment' AS key, c_mktsegment AS v FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_name', c_name FROM customer) GROUP BY key")
def describe_catalog(s, d):
    described = _stored(s, table(s, d, "customer").select(col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey", "c_name")).describe()
    return described.where(P.eq(col("kind"), F.lit("property"))).select(col("item").alias("key"), "rows", col("samples")[0].alias("sample"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def missing_items(s, d):
    have = table(s, d, "customer").where(P.gt(col("c_acctbal"), 9900)).select(col("c_nationkey").alias("s_nationkey"))
    return merge.missing(have, table(s, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"]).select("s_suppkey")


# --- event time ----------------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_day(s, d):
    out = streams.tumbling(table(s, d, "events"), "ts", "1 day", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    return out.select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def sliding_hour(s, d):
    out = streams.sliding(table(s, d, "events"), "ts", "2 hours", "1 hour", [], {"n": F.count("*")})
    return out.select(col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k")
def session_30m(s, d):
    out = streams.sessions(table(s, d, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count("*")})
    return out.select("user_id", col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) > 2 AS limited FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def sliding_rate_limit(s, d):
    return streams.over_limit(table(s, d, "events"), "user_id", "ts", 2, 3600).select("event_id", "limited")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_tumbling_day(s, d):
    """The windows of a stream over the events' folder, closed by a watermark, as the sink has them at its end."""
    from amberline.tables import shared_dir

    events = table(s, d, "events")
    stream = s.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")  # as a pattern it may be a file or a folder
    out = streams.tumbling(stream, "ts", "1 day", ["event_type"], {"n": F.count("*")}, "10 minutes")
    path = shared_dir(s, "stream")
    streams.journal(out, f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out").select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- dynamic values, frames, and statements of the store --------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS VARCHAR) END IS NOT DISTINCT FROM CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS VARCHAR) END")
def canonical_equality(s, d):
    """Text against numbers."""
    text = F.when(col("o_orderkey") % 11 != 0, (col("o_orderkey") % 10).cast("string"))
    number = F.when(col("o_custkey") % 11 != 0, (col("o_custkey") % 10).cast("double"))
    return table(s, d, "orders").where(P.same_text(text, number, ("string", "double"))).select("o_orderkey")


DYNAMIC = "v AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 4 AS k, o_totalprice, o_orderstatus = 'F' AS b, o_orderstatus FROM orders), r AS (SELECT o_orderkey, o_orderpriority, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind, CASE WHEN k = 1 THEN o_totalprice END AS num, CASE WHEN k = 2 THEN b END AS truth, CASE WHEN k = 3 THEN o_orderstatus END AS txt FROM v)"


def _dynamic(s, d):
    """Literals of all kinds: nothing, numbers, truth values, text."""
    k = col("o_orderkey") % 4
    literal = F.when(k == 1, col("o_totalprice").cast("string")).when(k == 2, F.when(col("o_orderstatus") == "F", "PRAWDA").otherwise("FAŁSZ")).when(k == 3, col("o_orderstatus"))
    return table(s, d, "orders").select("o_orderkey", "o_orderpriority", X.parsed(literal).alias("v"))


@query(f"WITH {DYNAMIC} SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY kind, num, truth, txt, o_orderkey) AS n FROM r")
def typed_row_number(s, d):
    return _dynamic(s, d).select("o_orderkey", relational.ranked("row_number", ["o_orderpriority"], [*X.sort_keys(col("v")), col("o_orderkey")]).alias("n"))


@query(f"WITH {DYNAMIC} SELECT o_orderkey FROM r ORDER BY kind DESC, num DESC, truth DESC, txt DESC, o_orderkey LIMIT 50")
def typed_topk_desc(s, d):
    return relational.ordered(_dynamic(s, d), ["v", "no such key"], descending=True, limit=50, name="o_orderkey").select("o_orderkey")


@query("SELECT event_id, round(CASE WHEN i + 1 > n THEN value ELSE x END, 4) AS x FROM (SELECT event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def rows_swapped_and_clamped(s, d):
    x = relational.over_frame("sum", col("value"), ["user_id"], [col("event_id")], 3, 1)
    return table(s, d, "events").select("event_id", F.round(x, 4).alias("x"))


@query("WITH b AS (SELECT 'C' || c_custkey AS name, c_custkey AS k, c_acctbal AS bal FROM customer), c AS (SELECT 'N' || (o_custkey + 100) AS name, o_custkey + 100 AS k, round(sum(o_totalprice), 2) AS bal FROM orders GROUP BY o_custkey) SELECT coalesce(b.name, c.name) AS name, CAST(coalesce(b.k, c.k) AS DOUBLE) AS k, coalesce(c.bal, b.bal) AS bal FROM b FULL JOIN c ON b.k = c.k")
def store_merge_by_key(s, d):
    store = _stored(s, table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("name"), col("c_custkey").alias("k"), col("c_acctbal").alias("bal")))
    k = col("o_custkey") + 100
    store.merge_rows(table(s, d, "orders").groupBy(k.alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("bal")).select(F.concat(F.lit("N"), "k").alias("name"), "k", "bal"), "k")
    return store.wide(k="num", bal="num").select("name", "k", "bal")


@query("SELECT 'P' || p_partkey AS name, p_type AS kind, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END AS size FROM part WHERE p_partkey % 5 <> 0")
def store_insert_select(s, d):
    """Rows named NIC are passed over; nulls are no properties."""
    name = F.when(col("p_partkey") % 5 == 0, "NIC").otherwise(F.concat(F.lit("P"), "p_partkey"))
    return _stored(s, table(s, d, "part").select(name.alias("name"), col("p_type").alias("kind"), F.when(col("p_size") > 25, col("p_size")).alias("size"))).wide(kind="text", size="num").select("name", "kind", "size")


@query("WITH n AS (SELECT c_name AS name, c_acctbal AS bal FROM customer) SELECT name, bal FROM n UNION ALL SELECT name || x, bal FROM n, (VALUES ('_kopia'), ('_kopia_2')) t(x) WHERE bal > 5000 UNION ALL SELECT name || '_kopia_3', bal FROM n WHERE bal > 9000")
def store_clone(s, d):
    store = _stored(s, table(s, d, "customer").select("c_name", col("c_acctbal").alias("bal")))
    original = col("name").rlike("^[^_]*$")
    for least in (5000, 5000, 9000):
        store.clone(store.wide(bal="num").where(original & P.gt(col("bal"), least)).select("name"))
    return store.wide(bal="num").select("name", "bal")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'gone' WHEN c_custkey % 3 = 1 THEN 'set' ELSE 'kept' END AS fate, count(*) AS entities, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS properties, count(CASE WHEN c_custkey % 3 = 1 THEN 1 END) AS old FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def store_after_compaction(s, d):
    """Deleted, changed and untouched entities, read from a compacted store."""
    store = _stored(s, table(s, d, "customer").select("c_custkey", "c_mktsegment"))
    rest = col("name").cast("bigint") % 3
    store.update(store.names().where(rest == 1), "c_mktsegment", "NEW")
    store.delete(store.names().where(rest == 0))
    store.compact()
    now = store.wide(c_mktsegment="text").select("name", F.when(rest == 1, "set").otherwise("kept").alias("fate"), "c_mktsegment")
    old = store.versions("c_mktsegment").where(P.eq(col("status"), F.lit("ARCHIVE"))).select("name", F.lit(1).alias("o"))
    return now.join(old, "name", "left").groupBy("fate").agg(F.count("*").alias("entities"), F.count("c_mktsegment").alias("properties"), F.count("o").alias("old"))


@query(f"WITH d AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS t, CAST(doc_id % 100 AS DOUBLE) AS heat FROM documents), r AS (SELECT doc_id, heat * power(0.92, 20) AS T, 0.3 * power(len(list_intersect(t, ['the', 'of', 'and', 'in'])) / len(list_distinct(list_concat(t, ['the', 'of', 'and', 'in']))), 2) / 0.09 AS R FROM d) SELECT doc_id, T < 2 AS retained FROM r WHERE T >= 2 OR R >= 0.0001")
def tick_with_resonance(s, d):
    docs = table(s, d, "documents").select(col("doc_id").alias("atom_id"), (col("doc_id") % 100).cast("double").alias("T"), "text")
    kept = search.retained_by_resonance(docs, "the of and in", least=0.0001, text_col="text")
    return thermal.tick(docs.select("atom_id", "T"), 20, resonant=kept).select(col("atom_id").alias("doc_id"), "retained")


@query(f"WITH {FRAMES}, t AS (SELECT tick, string_agg(CAST(atom_id AS VARCHAR), ',' ORDER BY atom_id) AS ids FROM frames GROUP BY tick), r AS (SELECT tick, CASE WHEN ids IS NOT DISTINCT FROM lag(ids) OVER (ORDER BY tick) THEN 0 ELSE 1 END AS new FROM t), g AS (SELECT tick, sum(new) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT tick, (row_number() OVER (PARTITION BY run ORDER BY tick) - 1) % 17 = 0 AS key FROM g")
def frame_kinds(s, d):
    return thermal.frame_kinds(_frames(s, d))


@query(f"WITH {FRAMES} SELECT tick, atom_id, round(T, 6) AS T FROM (SELECT * FROM frames WHERE T >= 30 AND T < 70 ORDER BY T DESC, tick, atom_id LIMIT 100)")
def frames_by_state(s, d):
    return thermal.search_frames(_frames(s, d), in_state="WARM").select("tick", "atom_id", F.round("T", 6).alias("T"))


@query(f"WITH a AS (SELECT event_id, event_type, {HEAT} * power(0.92, 20) AS t FROM events) SELECT count(*) FILTER (t >= 2) AS alive, count(*) FILTER (t < 2) AS dead, count(*) FILTER (t < 2 AND event_type = 'purchase') AS retained FROM a")
def atom_census(s, d):
    e = table(s, d, "events")
    bounds = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    t = thermal.decayed(100 * (col("value") - col("lo")) / (col("hi") - col("lo")), 20)
    atoms = e.join(bounds, F.lit(True)).select(col("event_id").alias("atom_id"), t.alias("T"))
    return thermal.census(atoms, e.where(P.eq(col("event_type"), F.lit("purchase"))).select(col("event_id").alias("atom_id")))


@query("""SELECT event_id, '{"a":[' || event_id || ',true],"k":' || json_extract_string(props, '$.k') || ',"z":"' || event_type || '"}' AS canon FROM events""")
def json_canonical(s, d):
    """Keys in order, whatever order and spacing they came in."""
    text = F.concat(F.lit('{ "z" : "'), "event_type", F.lit('", "k": '), X.json_value(col("props"), "$.k"), F.lit(', "a": [ '), "event_id", F.lit(" , true ] }"))
    return table(s, d, "events").select("event_id", X.canonical_json(text).alias("canon"))


@query(f"WITH t AS (SELECT p_partkey AS k, {SQL_TOKENS.format("concat_ws(' ', 'P' || p_partkey, p_brand, p_name)")} AS t FROM part), q AS (SELECT t AS q FROM t WHERE k = 1), r AS (SELECT 'P' || k AS name, round(0.3 * power(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 2) / 0.09, 9) AS R FROM t, q WHERE k <> 1) SELECT name, R FROM r WHERE R >= 0.15")
def store_resonance_of_context(s, d):
    """Entities whose texts resonate with that of the context."""
    store = _stored(s, table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), col("p_brand").alias("a"), col("p_name").alias("b")))
    store.set_context("P1")
    return store.resonating(limit=None).select("name", "R")


@query()
def coverage_leaders(s, d):
    """Greedy leaders of the embeddings; the tests hold them against a plain loop."""
    return search.field_coverage(table(s, d, "embeddings"), least=0.5)
