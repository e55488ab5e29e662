"""Checked queries: the relational shapes that evaluated SQL uses, over the test tables.

Sums of money are taken as decimals so that the result does not depend on the
order in which partitions arrive. Where a limit cuts through ties, a unique key
ends the sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.joins import not_in
from pairloom.operators.range_join import join_below
from pairloom.plans.registry import check

col = F.col


def money(name: str | Column) -> Column:
    """Exact sum of a two-digit amount."""
    return F.sum((col(name) if isinstance(name, str) else name).cast("decimal(12,2)")).cast("double")


def _money(name: str) -> str:
    return f"CAST(sum(CAST({name} AS DECIMAL(12,2))) AS DOUBLE)"


def one(df: DataFrame, value: Column) -> Column:
    """One aggregate of a table, as a scalar subquery."""
    return df.agg(value).scalar()


@check("k_filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return t.customer.filter(col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@check(
    "k_and_or",
    "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 250000",
)
def _(t):
    wanted = (col("o_orderstatus") == "F") | (col("o_orderpriority") == "1-URGENT")
    return t.orders.filter(wanted & (col("o_totalprice") > 250000)).select("o_orderkey", "o_totalprice")


@check("k_not_equal", "SELECT count(*) AS n FROM orders WHERE o_orderstatus != 'F'")
def _(t):
    return t.orders.filter(col("o_orderstatus") != "F").agg(F.count("*").alias("n"))


@check(
    "k_between",
    "SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem "
    "WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'",
)
def _(t):
    first, last = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")
    return t.lineitem.filter(col("l_quantity").between(10, 20) & col("l_shipdate").between(first, last)).agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@check("k_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def _(t):
    return t.part.filter(col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@check("k_in_list", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t):
    return t.orders.filter(col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@check(
    "k_is_not_null",
    "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
)
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").filter(col("quality").isNotNull()).agg(F.count("*").alias("n"))


@check("k_column_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount AND l_quantity > 45")
def _(t):
    return t.lineitem.filter((col("l_tax") > col("l_discount")) & (col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


@check(
    "k_inner_join",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW'",
)
def _(t):
    low = t.orders.filter(col("o_orderpriority") == "5-LOW")
    return low.join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@check(
    "k_multi_join",
    f"SELECT r_name, n_name, {_money('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
)
def _(t):
    # the facts are added up per customer before they meet the dimensions
    per_customer = t.orders.groupBy("o_custkey").agg(F.sum(col("o_totalprice").cast("decimal(12,2)")).alias("spent"))
    return (
        per_customer.join(t.customer, col("o_custkey") == col("c_custkey"))
        .join(t.nation, col("c_nationkey") == col("n_nationkey"))
        .join(t.region, col("n_regionkey") == col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("spent").cast("double").alias("revenue"))
    )


@check(
    "k_self_join",
    "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b "
    "ON a.n_regionkey = b.n_regionkey AND a.n_nationkey + 5 = b.n_nationkey",
)
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    same = (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") + 5 == col("b.n_nationkey"))
    return a.join(b, same).select(col("a.n_name").alias("left_name"), col("b.n_name").alias("right_name"))


@check(
    "k_join_derived",
    "SELECT c_custkey, c_name, n_orders FROM customer JOIN "
    "(SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12) ON c_custkey = o_custkey",
)
def _(t):
    busy = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders")).filter(col("n_orders") > 12)
    return t.customer.join(busy, col("c_custkey") == col("o_custkey")).select("c_custkey", "c_name", "n_orders")


@check(
    "k_join_extra_pred",
    "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate "
    "WHERE o_orderstatus = 'P'",
)
def _(t):
    early = (col("o_orderkey") == col("l_orderkey")) & (col("l_shipdate") < col("o_orderdate"))
    return t.orders.filter(col("o_orderstatus") == "P").join(t.lineitem, early).select("o_orderkey", "l_linenumber")


@check(
    "join_below",
    "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate "
    "WHERE o_orderstatus = 'P'",
)
def _(t):
    """The same, with keys that may hold any share of the rows."""
    orders = t.orders.filter(col("o_orderstatus") == "P").select("o_orderkey", "o_orderdate")
    items = t.lineitem.select(col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    day = lambda c: c.cast("timestamp").cast("double")
    return join_below(orders, items, "o_orderkey", "o_orderdate", "l_shipdate", number=day).select("o_orderkey", "l_linenumber")


@check(
    "k_semi_in",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
)
def _(t):
    large = t.orders.filter(col("o_totalprice") > 480000).select("o_custkey").distinct()
    return t.customer.join(large, col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@check(
    "k_anti_not_in",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(t):
    finished = t.orders.filter(col("o_orderstatus") == "F").select("o_custkey")
    return not_in(t.customer, "c_custkey", finished, "o_custkey").select("c_custkey", "c_name")


@check(
    "k_scalar_subquery",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
)
def _(t):
    bar = one(t.part, F.avg("p_retailprice"))
    return t.part.filter(col("p_retailprice") > bar).select("p_partkey", "p_retailprice")


@check(
    "k_scalar_in_select",
    "SELECT r_name, (SELECT count(*) FROM customer) AS n_customers FROM region",
)
def _(t):
    return t.region.select("r_name", one(t.customer, F.count("*")).alias("n_customers"))


@check("k_count", "SELECT count(*) AS n_rows, count(quality) AS n_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("n_rows"), F.count("quality").alias("n_quality"))


@check("k_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def _(t):
    # two steps by hand: distinct pairs spread over all keys, then three counters
    pairs = t.orders.select("o_orderstatus", "o_custkey").distinct()
    return pairs.groupBy("o_orderstatus").agg(F.count("o_custkey").alias("customers"))


@check(
    "k_sum_avg",
    f"SELECT c_mktsegment, {_money('c_acctbal')} AS total, {_money('c_acctbal')} / count(c_acctbal) AS average FROM customer GROUP BY 1",
)
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(
        money("c_acctbal").alias("total"), (money("c_acctbal") / F.count("c_acctbal")).alias("average")
    )


@check("k_min_max", "SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@check("k_sum_boolean", "SELECT l_returnflag, CAST(sum(CAST(l_linestatus = 'F' AS INT)) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum((col("l_linestatus") == "F").cast("int")).alias("n"))


@check(
    "k_conditional_count",
    "SELECT count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent, "
    "CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM orders",
)
def _(t):
    return t.orders.agg(
        F.count(F.when(col("o_orderpriority") == "1-URGENT", 1)).alias("urgent"),
        F.sum(F.when(col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"),
    )


@check(
    "k_percentage",
    "SELECT o_orderstatus, CAST(count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS DOUBLE) * 100 / count(*) AS pct "
    "FROM orders GROUP BY o_orderstatus",
)
def _(t):
    low = F.count(F.when(col("o_orderpriority") == "5-LOW", 1)).cast("double")
    return t.orders.groupBy("o_orderstatus").agg(F.try_divide(low * 100, F.count("*")).alias("pct"))


@check(
    "k_ratio_of_sums",
    "SELECT l_returnflag, CAST(sum(CAST(l_tax * 100 AS INT)) AS DOUBLE) / CAST(sum(CAST(l_discount * 100 AS INT)) AS DOUBLE) AS ratio, "
    "CAST(sum(CAST(l_quantity AS INT)) - sum(l_linenumber) AS BIGINT) AS gap FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    hundredths = lambda name: F.sum(F.round(col(name) * 100).cast("int")).cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.try_divide(hundredths("l_tax"), hundredths("l_discount")).alias("ratio"),
        (F.sum(col("l_quantity").cast("int")) - F.sum("l_linenumber")).alias("gap"),
    )


@check("k_group_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@check("k_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 15")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(col("n") >= 15)


@check("k_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@check(
    "k_order_by",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0 "
    "ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey",
)
def _(t):
    owing = t.customer.filter(col("c_acctbal") < 0).select("c_custkey", "c_mktsegment", "c_acctbal")
    return owing.orderBy(col("c_mktsegment").asc_nulls_first(), col("c_acctbal").desc_nulls_last(), "c_custkey")


@check("k_top1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(1)


@check("k_topn", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(col("p_retailprice").desc(), "p_partkey").limit(10)


@check("k_top_group", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "o_custkey").limit(1)


@check("k_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@check(
    "k_union_all",
    "SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0 "
    "UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_acctbal < 0",
)
def _(t):
    owing = t.customer.filter(col("c_acctbal") < 0)
    keys = owing.select(F.lit("customer").alias("kind"), col("c_custkey").cast("string").alias("value"))
    return keys.unionAll(owing.select(F.lit("segment"), "c_mktsegment"))


@check("k_intersect", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    rich = t.customer.filter(col("c_acctbal") > 9000).select(col("c_nationkey").alias("nationkey"))
    return rich.intersect(t.supplier.filter(col("s_acctbal") > 5000).select("s_nationkey"))


@check("k_except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    urgent = t.orders.filter(col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return t.customer.select(col("c_custkey").alias("custkey")).subtract(urgent)


@check("k_year_of_date", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))


@check(
    "k_group_year_top",
    "SELECT strftime(l_shipdate, '%Y') AS year, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, year LIMIT 1",
)
def _(t):
    per_year = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))
    return per_year.orderBy(col("n").desc(), "year").limit(1)


@check("k_count_subquery", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6)")
def _(t):
    long_orders = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines")).filter(col("lines") > 6)
    return long_orders.agg(F.count("*").alias("n"))


@check("k_select_star", "SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey")
def _(t):
    return t.supplier.select("*").orderBy("s_acctbal", "s_suppkey")


@check("k_double_quoted_text", "SELECT count(*) AS n FROM part WHERE p_type = 'ECONOMY'")
def _(t):
    return t.sql('SELECT count(*) AS n FROM {part} WHERE p_type = "ECONOMY"')


@check("k_semicolon", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > 0")
def _(t):
    return t.sql("SELECT count(*) AS n FROM {supplier} WHERE s_acctbal > 0;")


@check(
    "k_multi_agg",
    f"SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, {_money('o_totalprice')} AS total, "
    f"{_money('o_totalprice')} / count(*) AS average FROM orders",
)
def _(t):
    return t.orders.agg(
        F.count("*").alias("n"),
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        money("o_totalprice").alias("total"),
        (money("o_totalprice") / F.count("*")).alias("average"),
    )


@check(
    "k_order_by_agg",
    "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(CAST(o_totalprice AS DECIMAL(12,2))) DESC, o_custkey LIMIT 5",
)
def _(t):
    spent = t.orders.groupBy("o_custkey").agg(F.sum(col("o_totalprice").cast("decimal(12,2)")).alias("spent"))
    return spent.orderBy(col("spent").desc(), "o_custkey").limit(5).select("o_custkey")
