"""Registered queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.catalog import Catalog, Context, Index, RecordType, Relationship, Store
from cairn.functions import ranges, spatial, vectors
from cairn.functions.bindings import once
from cairn.functions.predicates import field
from cairn.operators import aggregates, joins, maintenance, statistics, versions
from cairn.operators.evolution import evolved
from cairn.operators.ranks import Leaderboard
from cairn.plans.query import Limit, OrderBy, Where, matching
from cairn.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Primary keys of the tables.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "embeddings": ("vec_id",), "documents": ("doc_id",), "conversations": ("conv_id", "turn"), "labels": ("doc_id",),
}


def store(spark: SparkSession, sf_dir: str, name: str) -> Store:
    df = read(spark, sf_dir, name)
    links = {"orders": (Relationship("customer", "customer", (("o_custkey", "c_custkey"),)),), "customer": (Relationship("nation", "nation", (("c_nationkey", "n_nationkey"),)),)}
    kind = RecordType(name, df.schema, KEYS[name], links.get(name, ()))
    return Catalog([kind]).store(df, name)


def query(sql: str | None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


# ---- scans and filters


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_equal(spark, d):
    return store(spark, d, "orders").query().where(field("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus", "o_totalprice").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_not_equal(spark, d):
    return store(spark, d, "orders").query().where(field("o_orderstatus") != "F").select("o_orderkey").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-06-30'")
def filter_comparisons(spark, d):
    price, date = field("o_totalprice"), field("o_orderdate")
    condition = (price >= 1000) & (price < 200000) & (date > "1997-01-01") & (date <= "1999-06-30")
    return store(spark, d, "orders").query().where(condition).select("o_orderkey", "o_totalprice").to_df()


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR value > 50) AND NOT (event_type = 'view' AND value < 10)")
def filter_and_or_not(spark, d):
    kind, value = field("event_type"), field("value")
    return store(spark, d, "events").query().where(((kind == "click") | (value > 50)) & ~((kind == "view") & (value < 10))).select("event_id").to_df()


_SPARSE = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events"


def sparse_events(spark, d):
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_type")).alias("kind"))


@query(f"SELECT event_id, kind FROM ({_SPARSE}) WHERE kind <> 'click' OR kind IS NULL")
def filter_not_over_nulls(spark, d):
    df = sparse_events(spark, d)
    return Store(df, RecordType("e", df.schema, ("event_id",))).query().where(~(field("kind") == "click")).to_df()


@query(f"SELECT event_id, kind FROM ({_SPARSE}) WHERE kind <> 'click'")
def filter_differs_over_nulls(spark, d):
    df = sparse_events(spark, d)
    return Store(df, RecordType("e", df.schema, ("event_id",))).query().where(field("kind") != "click").to_df()


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_name LIKE '%a%'")
def filter_prefix_and_substring(spark, d):
    return store(spark, d, "part").query().where(field("p_brand").has_prefix("Brand#1") & field("p_name").contains("a")).select("p_partkey", "p_name", "p_brand").to_df()


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 14, 23)")
def filter_in(spark, d):
    return store(spark, d, "part").query().where(field("p_size").is_in([1, 5, 9, 14, 23])).select("p_partkey", "p_size").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0 AND o_custkey <= 2100")
def in_list_as_join(spark, d):
    return joins.in_list(spark, read(spark, d, "orders"), "o_custkey", list(range(0, 2101, 7))).select("o_orderkey")


_TAGS = "SELECT doc_id, [lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END] AS tags FROM documents"


def tagged(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"))
    return Store(df, RecordType("tagged", df.schema, ("doc_id",)))


@query(f"SELECT doc_id FROM ({_TAGS}) WHERE list_has_any(tags, ['de', 'src3']) AND NOT list_contains(tags, 'short')")
def filter_any_element(spark, d):
    return tagged(spark, d).query().where(field("tags").is_in(["de", "src3"]) & ~(field("tags") == "short")).select("doc_id").to_df()


@query("SELECT event_id FROM events WHERE length(props) > 8 AND user_id < 1000")
def filter_custom(spark, d):
    return store(spark, d, "events").query().where(matching(F.length("props") > 8, "props")).where(field("user_id") < 1000).select("event_id").to_df()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = 7")
def lookup_by_key(spark, d):
    return store(spark, d, "supplier").at(7)


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def lookup_by_composite_key(spark, d):
    return store(spark, d, "conversations").at(3, 1).select("conv_id", "turn", "role")


@query("SELECT o_orderkey FROM orders WHERE false")
def contradiction_is_empty(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("lower"), (F.col("o_totalprice") + 1).alias("upper")).alias("span"))
    return Store(df, RecordType("o", df.schema, ("o_orderkey",))).query().overlaps("span", 10, 5).select("o_orderkey").to_df()


@query("SELECT struct_key.nation AS nation, count(*) AS n FROM (SELECT {'nation': c_nationkey, 'segment': c_mktsegment} AS struct_key FROM customer) WHERE struct_key.segment = 'BUILDING' GROUP BY 1")
def nested_field(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("k"))
    rows = Store(df, RecordType("c", df.schema, ("c_custkey",))).query().where(field("k.segment") == "BUILDING").to_df()
    return rows.groupBy(F.col("k.nation").alias("nation")).agg(F.count("*").alias("n"))


# ---- ranges

_SPAN = "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS lower, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 1 + o_orderkey % 60 AS upper FROM orders"


def spans(spark, d):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long")
    df = read(spark, d, "orders").select("o_orderkey", F.struct(day.alias("lower"), (day + 1 + F.col("o_orderkey") % 60).alias("upper")).alias("span"))
    return Store(df, RecordType("spans", df.schema, ("o_orderkey",)))


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE lower < 10030 AND upper > 10000")
def range_overlaps(spark, d):
    return spans(spark, d).query().overlaps("span", 10000, 10030).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE lower <= 10030 AND upper >= 10000")
def range_overlaps_closed(spark, d):
    return spans(spark, d).query().overlaps("span", 10000, 10030, closed=True).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE upper > 11200")
def range_overlaps_from(spark, d):
    return spans(spark, d).query().overlaps("span", low=11200).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE lower < 9200")
def range_overlaps_up_to(spark, d):
    return spans(spark, d).query().overlaps("span", high=9200).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE lower <= 9200")
def range_overlaps_through(spark, d):
    return spans(spark, d).query().overlaps("span", high=9200, inclusive=True).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM ({_SPAN}) WHERE lower < 10020 AND upper > 10010")
def range_window_of_several(spark, d):
    low, high = ranges.common_window([(10000, 10020), (10010, 10050), (None, 10040)])
    return spans(spark, d).query().overlaps("span", low, high).select("o_orderkey").to_df()


@query(f"SELECT count(*) AS n, sum(high - low) AS days FROM (SELECT greatest(lower, 10000) AS low, least(upper, 10100) AS high FROM ({_SPAN})) WHERE low < high")
def range_intersection_columns(spark, d):
    low, high = ranges.window_columns([(F.col("span.lower"), F.col("span.upper")), (F.lit(10000), F.lit(10100))])
    return spans(spark, d).df.select(low.alias("low"), high.alias("high")).where("low < high").agg(F.count("*").alias("n"), F.sum(F.col("high") - F.col("low")).alias("days"))


@query("SELECT a.o_orderkey AS left_key, b.l_orderkey AS right_key, count(*) AS n FROM (SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a0, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 3 AS a1 FROM orders) a JOIN (SELECT l_orderkey, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS b0, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + 2 AS b1 FROM lineitem) b ON a.o_orderkey = b.l_orderkey AND a0 < b1 AND a1 > b0 GROUP BY ALL")
def range_join(spark, d):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("long")
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("a0"), (day("o_orderdate") + 3).alias("a1"))
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), day("l_shipdate").alias("b0"), (day("l_shipdate") + 2).alias("b1"))
    out = joins.interval_join(a, b, ("a0", "b0"), ("a1", "b1"), 4, ["key"])
    return out.groupBy(F.col("key").alias("left_key"), F.col("key").alias("right_key")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, sum(upper - lower) / count(*) AS mean_width, min(lower) AS low, max(upper) AS high, sum(upper - lower) / (max(upper) - min(lower)) AS overlap_factor FROM ({_SPAN})")
def range_statistics(spark, d):
    return statistics.range_stats(spans(spark, d).df.select("span.lower", "span.upper"), "lower", "upper")


# ---- joins and sets of keys


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def intersection_by_key(spark, d):
    q = store(spark, d, "orders").query().select("o_orderkey")
    return q.where(field("o_orderstatus") == "F").intersect(q.where(field("o_orderpriority") == "1-URGENT"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000")
def union_by_key(spark, d):
    q = store(spark, d, "orders").query().select("o_orderkey")
    return q.where(field("o_orderstatus") == "F").union(q.where(field("o_totalprice") > 300000))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 100000")
def difference_by_key(spark, d):
    q = store(spark, d, "orders").query().select("o_orderkey")
    return q.where(field("o_orderstatus") == "F").subtract(q.where(field("o_totalprice") > 100000))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5")
def related_records(spark, d):
    customers = read(spark, d, "customer").where("c_nationkey = 5")
    return store(spark, d, "orders").related("customer", customers).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_related_records(spark, d):
    return with_orders(spark, d).related("orders", read(spark, d, "orders").where("o_totalprice > 250000"), "left_anti").select("c_custkey")


def with_orders(spark, d) -> Store:
    customers = read(spark, d, "customer")
    return Catalog([RecordType("customer", customers.schema, ("c_custkey",), (Relationship("orders", "orders", (("c_custkey", "o_custkey"),)),))]).store(customers, "customer")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")
def outer_related_records(spark, d):
    return with_orders(spark, d).related("orders", read(spark, d, "orders").where("o_totalprice > 250000"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_related_records(spark, d):
    return with_orders(spark, d).related("orders", read(spark, d, "orders").where("o_orderstatus = 'P'"), "left_semi").select("c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30")
def theta_related_records(spark, d):
    """An inequality between the sides beside the relationship's keys."""
    where = F.col("r.o_totalprice") > F.col("l.c_acctbal") * 30
    return with_orders(spark, d).related("orders", read(spark, d, "orders"), where=where).select("c_custkey", "o_orderkey")


@query("SELECT p.event_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def as_of_join(spark, d):
    events = read(spark, d, "events")
    clicks = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_click"))
    out = joins.as_of_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", ["last_click"])
    return out.select("event_id", "last_click")


# ---- aggregates

_LINES = "sum(CAST(l_quantity AS DECIMAL(18,2)))"


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST({_LINES} AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def group_by_several(spark, d):
    grouped = store(spark, d, "lineitem").group_by("l_returnflag", "l_linestatus")
    grouped = grouped.agg(aggregates.count().named("n"), aggregates.custom("sum_qty", F.sum(money("l_quantity")).cast("double")), aggregates.custom("sum_price", F.sum(money("l_extendedprice")).cast("double")))
    return grouped.agg(aggregates.min_("l_discount").named("low"), aggregates.max_("l_discount").named("high")).to_df()


@query("SELECT user_id, count(*) AS count FROM events GROUP BY 1 HAVING count(*) > 60")
def group_having(spark, d):
    return store(spark, d, "events").group_by("user_id").agg(aggregates.count()).having(lambda df: F.col("count") > 60).to_df()


@query("SELECT o_custkey, count(*) AS count, sum(o_orderkey) AS sum_o_orderkey, sum(o_orderkey) / count(*) AS avg_o_orderkey FROM orders GROUP BY 1")
def group_average(spark, d):
    return store(spark, d, "orders").group_by("o_custkey").agg(aggregates.count(), aggregates.sum_("o_orderkey"), aggregates.avg("o_orderkey")).to_df()


@query("SELECT p_brand || '/' || n AS label FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def group_transformed(spark, d):
    grouped = store(spark, d, "part").group_by("p_brand").agg(aggregates.count())
    return grouped.to_df(lambda df: df.select(F.concat_ws("/", "p_brand", "count").alias("label")))


@query("SELECT count(*) AS n, sum(o_custkey) AS total, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def aggregate_ungrouped(spark, d):
    orders = store(spark, d, "orders")
    found = [orders.aggregate(a) for a in (aggregates.count(), aggregates.sum_("o_custkey"), aggregates.min_("o_orderkey"), aggregates.max_("o_orderkey"))]
    return spark.createDataFrame([tuple(found)], "n long, total long, low long, high long")


@query("SELECT count(*) AS n, sum(l_linenumber) AS total FROM lineitem WHERE l_returnflag = 'R'")
def aggregate_of_one_group(spark, d):
    found = [store(spark, d, "lineitem").aggregate(a, {"l_returnflag": "R"}) for a in (aggregates.count(), aggregates.sum_("l_linenumber"))]
    return spark.createDataFrame([tuple(found)], "n long, total long")


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS total, count(o_orderkey) AS n_values, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def aggregate_maintained_by_parts(spark, d):
    """Two parts kept apart, merged as maintenance does."""
    orders = read(spark, d, "orders")
    one, two = (aggregates.maintained(orders.where(F.col("o_orderkey") % 2 == k), ["o_custkey"], "o_orderkey") for k in (0, 1))
    return aggregates.merged(one, two, ["o_custkey"])


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS total, count(o_orderkey) AS n_values FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def aggregate_after_deletes(spark, d):
    orders = read(spark, d, "orders")
    whole, less = (aggregates.maintained(x, ["o_custkey"], "o_orderkey") for x in (orders, orders.where("o_orderstatus = 'P'")))
    return aggregates.retracted(whole, less, ["o_custkey"])


@query("SELECT o_orderpriority, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN NULL ELSE count(*) / count(*) FILTER (o_orderstatus = 'P') END AS ratio FROM orders GROUP BY 1")
def aggregate_divided(spark, d):
    out = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("m"))
    return out.select("o_orderpriority", aggregates.divided(F.col("n"), F.col("m")).alias("ratio"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def aggregate_distinct(spark, d):
    return store(spark, d, "lineitem").group_by("l_returnflag").agg(aggregates.distinct("l_partkey").named("parts"), aggregates.distinct("l_suppkey").named("suppliers")).to_df()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def aggregate_cube(spark, d):
    return store(spark, d, "orders").group_by("o_orderstatus", "o_orderpriority").cube().agg(aggregates.count().named("n")).to_df()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_custkey) AS high, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def aggregate_rollup(spark, d):
    return store(spark, d, "orders").group_by("o_orderstatus", "o_orderpriority").rollup().agg(aggregates.count().named("n"), aggregates.max_("o_custkey").named("high")).to_df()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ()) HAVING count(*) > 10")
def aggregate_grouping_sets(spark, d):
    grouped = store(spark, d, "orders").group_by("o_orderstatus", "o_orderpriority").grouping_sets(["o_orderstatus"], ["o_orderpriority"], [])
    return grouped.agg(aggregates.count().named("n")).having(lambda df: df["n"] > 10).to_df()


@query("SELECT o_orderpriority, round(stddev_samp(o_custkey), 4) AS spread, round(quantile_cont(o_custkey, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def aggregate_spread(spark, d):
    grouped = store(spark, d, "orders").group_by("o_orderpriority").agg(aggregates.stddev("o_custkey").named("spread"), aggregates.percentile("o_custkey", 0.9).named("p90"))
    return grouped.to_df(lambda df: df.select("o_orderpriority", F.round("spread", 4).alias("spread"), F.round("p90", 4).alias("p90")))


@query("SELECT o_orderpriority, avg(o_custkey) AS mean FROM orders GROUP BY 1 HAVING avg(o_custkey) > 0")
def aggregate_custom(spark, d):
    """An aggregate that the caller makes up: a mean from two sums."""
    mean = aggregates.custom("mean", F.sum("o_custkey") / F.count("o_custkey"))
    return store(spark, d, "orders").group_by("o_orderpriority").agg(mean).having(lambda df: df["mean"] > 0).to_df()


# ---- ranks


def customers(spark, d, group=None, order="desc") -> Leaderboard:
    return store(spark, d, "customer").rank("c_acctbal", group, order)


_RANKED = "SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS rank FROM customer"
_RANKED_BY = "SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS rank FROM customer"


@query(f"SELECT c_custkey, rank FROM ({_RANKED})")
def rank_of_all(spark, d):
    return customers(spark, d).ranked().select("c_custkey", "rank")


@query(f"SELECT c_custkey, rank FROM ({_RANKED_BY})")
def rank_in_group(spark, d):
    return customers(spark, d, ["c_nationkey"]).ranked().select("c_custkey", "rank")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def rank_top(spark, d):
    return store(spark, d, "customer").query().top_n(10, "c_acctbal").select("c_custkey", "c_acctbal").to_df()


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def rank_bottom(spark, d):
    return store(spark, d, "customer").query().bottom_n(10, "c_acctbal").select("c_custkey", "c_acctbal").to_df()


@query(f"SELECT c_nationkey, c_custkey, rank FROM ({_RANKED_BY}) WHERE rank <= 3")
def rank_top_in_group(spark, d):
    return customers(spark, d, ["c_nationkey"]).top(3).select("c_nationkey", "c_custkey", "rank")


@query(f"SELECT c_custkey, rank FROM ({_RANKED}) WHERE rank BETWEEN 20 AND 40")
def rank_range(spark, d):
    return customers(spark, d).between(20, 40).select("c_custkey", "rank")


@query(f"SELECT c_acctbal FROM ({_RANKED}) WHERE rank = 25")
def rank_score_at(spark, d):
    return customers(spark, d).score_at(25)


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000")
def rank_by_score(spark, d):
    return customers(spark, d).by_score(1000, 2000).select("c_custkey")


@query(f"SELECT c_custkey, rank FROM ({_RANKED}) WHERE c_custkey IN (1, 5, 40)")
def rank_of_rows(spark, d):
    board, rows = customers(spark, d), read(spark, d, "customer").where("c_custkey in (1, 5, 40)").select("c_custkey", "c_acctbal").collect()
    return spark.createDataFrame([(r.c_custkey, board.rank_of(r.c_acctbal, [r.c_custkey])) for r in rows], "c_custkey long, rank int")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_partkey DESC) AS rank FROM part")
def rank_by_text(spark, d):
    """Scores that are strings, with many ties."""
    return store(spark, d, "part").rank("p_brand").ranked().select("p_partkey", "rank")


@query("SELECT c_nationkey, count(*) AS count FROM customer GROUP BY 1")
def rank_group_sizes(spark, d):
    return customers(spark, d, ["c_nationkey"]).count()


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, ntile(4) OVER w AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    recent = F.sum(money("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("double")
    return read(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), recent.alias("recent"))


# ---- order and limit


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_and_limit(spark, d):
    return store(spark, d, "orders").query().order_by("o_orderpriority").order_by("o_totalprice", "desc").limit(50).select("o_orderkey", "o_orderpriority").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def clauses_as_a_list(spark, d):
    urgent = False
    q = store(spark, d, "orders").query_dsl(Where(field("o_orderstatus") == "O"), Where(field("o_orderpriority") == "1-URGENT") if urgent else None, OrderBy("o_totalprice", "desc"), Limit(20))
    return q.select("o_orderkey").to_df()


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 30")
def page(spark, d):
    return store(spark, d, "part").query().order_by("p_retailprice").offset(30).limit(10).select("p_partkey").to_df()


# ---- vectors


def _vector(n: int = 64) -> list[float]:
    return [((i * 37) % 64 - 32) / 32 for i in range(n)]


_QUERY = "[" + ", ".join(str(x) for x in _vector()) + "]::DOUBLE[]"
_V = "embedding::DOUBLE[]"
_DISTANCE = {
    "l2": f"sqrt(list_sum(list_transform(list_zip({_V}, {_QUERY}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "inner": f"-list_sum(list_transform(list_zip({_V}, {_QUERY}), lambda p: p[1] * p[2]))",
}
_DISTANCE["cosine"] = f"1 + {_DISTANCE['inner']} / (sqrt(list_sum(list_transform({_V}, lambda x: x * x))) * {sum(x * x for x in _vector()) ** 0.5})"


def _nearest(metric: str):
    def run(spark, d):
        out = store(spark, d, "embeddings").query().nearest(10, _vector(), "embedding", metric)
        return out.select("vec_id", F.round("distance", 4).alias("distance"))

    run.__name__ = f"nearest_{metric}"
    return query(f"SELECT vec_id, round({_DISTANCE[metric]}, 4) AS distance FROM embeddings ORDER BY {_DISTANCE[metric]}, vec_id LIMIT 10")(run)


for _m in vectors.METRICS:
    _nearest(_m)


@query(f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 8")
def nearest_filtered(spark, d):
    return store(spark, d, "embeddings").query().where(field("label") == 3).nearest(8, _vector(), "embedding").select("vec_id")


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 4) AS size FROM embeddings")
def vector_magnitude(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.magnitude(F.col("embedding")), 4).alias("size"))


# ---- points

_POINTS = "SELECT c_custkey, (c_custkey * 7919) % 170000 / 1000.0 - 85 AS lat, (c_custkey * 104729) % 360000 / 1000.0 - 180 AS lon, (c_custkey * 31) % 1000 / 1000.0 AS x, (c_custkey * 77) % 1000 / 1000.0 AS y, (c_custkey * 13) % 1000 / 1000.0 AS z FROM customer"


def points(spark, d):
    k = F.col("c_custkey")
    unit = lambda m: (k * m % 1000) / 1000.0
    df = read(spark, d, "customer").select("c_custkey", ((k * 7919) % 170000 / 1000.0 - 85).alias("lat"), ((k * 104729) % 360000 / 1000.0 - 180).alias("lon"), unit(31).alias("x"), unit(77).alias("y"), unit(13).alias("z"))
    return Store(df, RecordType("points", df.schema, ("c_custkey",)))


_HAVERSINE = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
_A = "pow(sin((radians(35.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(35.0)) * pow(sin(radians(139.0 - lon) / 2), 2)"


@query(f"SELECT c_custkey, CAST(round({_HAVERSINE}) AS BIGINT) AS meters FROM (SELECT *, {_A} AS a FROM ({_POINTS})) WHERE {_HAVERSINE} <= 3000000")
def points_within_radius(spark, d):
    out = points(spark, d).query().within_radius("lat", "lon", (35.0, 139.0), 3_000_000).to_df()
    return out.select("c_custkey", F.round(spatial.haversine(F.col("lat"), F.col("lon"), 35.0, 139.0)).cast("long").alias("meters"))


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE lat BETWEEN -20 AND 40 AND lon BETWEEN -60 AND 10")
def points_within_box(spark, d):
    return points(spark, d).query().within_box(["lat", "lon"], [-20, -60], [40, 10]).select("c_custkey").to_df()


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE x BETWEEN 0.2 AND 0.6 AND y BETWEEN 0.1 AND 0.9 AND z BETWEEN 0 AND 0.5 AND lat > 0")
def points_within_box_3d(spark, d):
    return points(spark, d).query().within_box(["x", "y", "z"], [0.2, 0.1, 0.0], [0.6, 0.9, 0.5]).where(field("lat") > 0.0).select("c_custkey").to_df()


@query(f"SELECT c_custkey FROM (SELECT *, {_A} AS a FROM ({_POINTS})) ORDER BY {_HAVERSINE}, c_custkey LIMIT 12")
def points_nearest(spark, d):
    return points(spark, d).query().nearest_points(12, "lat", "lon", (35.0, 139.0)).select("c_custkey")


def _bits_sql(parts: list[str], bits: int) -> str:
    """Interleaving written out bit by bit; the first part has the lowest bit."""
    return " + ".join(f"((({p} >> {b}) & 1) << {b * len(parts) + k})" for k, p in enumerate(parts) for b in range(bits))


_GRID = "CAST(least(floor({c} * {n}), {n} - 1) AS BIGINT)"
_MORTON = {n: _bits_sql([f"g{k}" for k in range(n)], b) for n, b in ((2, 16), (3, 10))}


@query("SELECT c_custkey, " + _MORTON[2] + " AS code FROM (SELECT c_custkey, " + ", ".join(f"{_GRID.format(c=c, n=1 << 16)} AS g{k}" for k, c in enumerate("xy")) + f" FROM ({_POINTS}))")
def morton_codes(spark, d):
    return points(spark, d).df.select("c_custkey", spatial.morton([F.col("x"), F.col("y")], 16).alias("code"))


@query("SELECT c_custkey, " + _MORTON[3] + " AS code FROM (SELECT c_custkey, " + ", ".join(f"{_GRID.format(c=c, n=1 << 10)} AS g{k}" for k, c in enumerate("xyz")) + f" FROM ({_POINTS}))")
def morton_codes_3d(spark, d):
    return points(spark, d).df.select("c_custkey", spatial.morton([F.col("x"), F.col("y"), F.col("z")], 10).alias("code"))


_HASH = " || ".join(f"substr('{spatial.BASE32}', CAST((code >> {5 * (5 - i)}) & 31 AS INTEGER) + 1, 1)" for i in range(6))


@query("SELECT c_custkey, " + _HASH + " AS hash FROM (SELECT c_custkey, " + _bits_sql(["gy", "gx"], 15) + " AS code FROM (SELECT c_custkey, " + _GRID.format(c="((lon + 180) / 360)", n=1 << 15) + " AS gx, " + _GRID.format(c="((lat + 90) / 180)", n=1 << 15) + f" AS gy FROM ({_POINTS})))")
def geohashes(spark, d):
    return points(spark, d).df.select("c_custkey", spatial.geohash(F.col("lat"), F.col("lon"), 6).alias("hash"))


@query(None)
def sphere_cells(spark, d):
    cell = spatial.cell_id(F.col("lat"), F.col("lon"))
    return points(spark, d).df.select("c_custkey", cell.alias("cell")).withColumn("parent", spatial.cell_parent(F.col("cell"), 10))


@query(f"SELECT c_custkey FROM (SELECT *, {_A} AS a FROM ({_POINTS})) WHERE {_HAVERSINE} <= 3000000")
def points_within_cell_cover(spark, d):
    """A radius by ranges of stored cells, then by distance."""
    cover = spatial.cells_around(35.0, 139.0, 3_000_000)
    stored = points(spark, d).df.withColumn("cell", spatial.cell_id(F.col("lat"), F.col("lon")))
    near = stored.where(once(F.col("cell"), lambda c: spatial.in_ranges(c, cover)))
    return near.where(spatial.within_radius(F.col("lat"), F.col("lon"), (35.0, 139.0), 3_000_000)).select("c_custkey")


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE lat BETWEEN -20 AND 40 AND lon BETWEEN -60 AND 10")
def points_within_box_cover(spark, d):
    cover = spatial.cells_of_box(-20, -60, 40, 10)
    stored = points(spark, d).df.withColumn("cell", spatial.cell_id(F.col("lat"), F.col("lon")))
    near = stored.where(once(F.col("cell"), lambda c: spatial.in_ranges(c, cover)))
    return near.where(spatial.within_box([F.col("lat"), F.col("lon")], [-20, -60], [40, 10])).select("c_custkey")


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -20 AND 10")
def points_within_geohash_cover(spark, d):
    cells = spatial.geohash_cover(10, -20, 40, 10, 2)
    near = points(spark, d).df.where(spatial.geohash(F.col("lat"), F.col("lon"), 2).isin(*cells))
    return near.where(spatial.within_box([F.col("lat"), F.col("lon")], [10, -20], [40, 10])).select("c_custkey")


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE x BETWEEN 0.2 AND 0.6 AND y BETWEEN 0.1 AND 0.4")
def points_within_morton_bounds(spark, d):
    low, high = spatial.morton_bounds([0.2, 0.1], [0.6, 0.4], 16)
    near = points(spark, d).df.where(spatial.morton([F.col("x"), F.col("y")], 16).between(low, high))
    return near.where(spatial.within_box([F.col("x"), F.col("y")], [0.2, 0.1], [0.6, 0.4])).select("c_custkey")


@query(f"SELECT c_custkey, CAST(round(lat) AS BIGINT) AS lat, CAST(round(lon) AS BIGINT) AS lon FROM ({_POINTS}) WHERE abs(lat - floor(lat) - 0.5) > 0.01 AND abs(lon - floor(lon) - 0.5) > 0.01 AND lon > -179")
def cells_decoded(spark, d):
    """Points from their cells' middles, rounded; points beside a half or at the antimeridian are left out, as a leaf's middle may lie on the other side."""
    lat, lon = spatial.cell_center(F.col("cell"))
    clear = lambda c: F.abs(F.col(c) - F.floor(c) - 0.5) > 0.01
    stored = points(spark, d).df.where(clear("lat") & clear("lon") & (F.col("lon") > -179)).withColumn("cell", spatial.cell_id(F.col("lat"), F.col("lon")))
    return stored.select("c_custkey", F.round(lat).cast("long").alias("lat"), F.round(lon).cast("long").alias("lon"))


@query(None)
def altitude_codes(spark, d):
    return points(spark, d).df.select("c_custkey", spatial.geo3d_code(F.col("lat"), F.col("lon"), F.col("z") * 9000, 0, 9000).alias("code"))


# ---- statistics


@query("SELECT column_name AS \"column\", n_rows, n_null FROM (SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS n_null FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM orders)")
def column_statistics(spark, d):
    return statistics.column_stats(read(spark, d, "orders"), "o_custkey", "o_orderstatus").select("column", "n_rows", "n_null")


@query(None)
def distinct_by_sketch(spark, d):
    sketches = statistics.distinct_sketches(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey")
    return statistics.merged_distinct(sketches, ["l_returnflag"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def histogram_of_values(spark, d):
    return statistics.value_histogram(read(spark, d, "orders"), "o_orderpriority")


@query("SELECT CAST(greatest(0, least(19, floor((p_retailprice - 0) / 3000 * 20))) AS INTEGER) AS bucket, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def histogram_of_ranges(spark, d):
    return statistics.range_histogram(read(spark, d, "part"), "p_retailprice", 0, 3000, 20)


@query(None)
def reservoir_sample(spark, d):
    return statistics.reservoir(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"], 500)


@query(None)
def estimated_share(spark, d):
    """Estimate beside the true share of a predicate."""
    parts = read(spark, d, "part")
    buckets = [(r.low, r.high, r.n) for r in statistics.range_histogram(parts, "p_retailprice", 0, 3000, 20).collect()]
    p = (field("p_retailprice") > 1200) & ~(field("p_size") == 5)
    guess = statistics.selectivity(p, {"p_retailprice": buckets}, {"p_size": 50})
    return parts.agg(F.round(F.lit(guess), 4).alias("estimate"), F.avg(F.when((F.col("p_retailprice") > 1200) & (F.col("p_size") != 5), 1.0).otherwise(0.0)).alias("share"))


# ---- changes, versions, maintenance


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'X' FROM orders WHERE o_orderkey % 10 = 0)")
def upsert(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = df.where(F.col("o_orderkey") % 10 == 0).withColumn("o_orderstatus", F.lit("X"))
    return Store(df, RecordType("o", df.schema, ("o_orderkey",))).upsert(changed).df


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 10 = 0")
def unit_of_work(spark, d):
    """Deletes and then saves that are staged and applied together."""
    orders = store(spark, d, "orders")
    work = Context(orders)
    work.delete(orders.df.where("o_orderkey % 7 = 0"))
    work.save(orders.df.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")))
    return work.commit().df.select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) AS place FROM orders ORDER BY place LIMIT 40")
def permuted_order(spark, d):
    df = read(spark, d, "orders")
    own = Catalog([RecordType("orders", df.schema, ("o_orderkey",))], {"orders": [Index("by_priority", "permuted", ("o_orderpriority", "o_custkey"))]}).store(df, "orders")
    return own.permuted("by_priority").limit(40).select("o_orderkey", F.row_number().over(Window.orderBy("o_orderpriority", "o_custkey", "o_orderkey")).alias("place"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    df = read(spark, d, "orders")
    own = Catalog([RecordType("orders", df.schema, ("o_orderkey",))], {"orders": [Index("one_each", "value", ("o_custkey",), unique=True)]}).store(df, "orders")
    return own.violations("one_each")


@query("SELECT lower, upper FROM (SELECT hi AS lower, coalesce(lead(lo) OVER (ORDER BY lo), 1000000) AS upper FROM (SELECT 0 AS lo, 0 AS hi UNION ALL SELECT o_orderkey * 7, o_orderkey * 7 + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 4 END FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey * 7 < 999990)) WHERE lower < upper")
def build_gaps(spark, d):
    """What a build that went through ranges of keys has left out."""
    key = F.col("o_orderkey") * 7
    done = read(spark, d, "orders").where("o_orderkey % 5 <> 0 and o_orderkey * 7 < 999990").select(key.alias("lower"), (key + F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(4)).alias("upper"))
    return maintenance.gaps(done, 0, 1_000_000)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS lo, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 40 END AS hi FROM orders) WHERE lo < 90 AND hi > 60")
def optional_range_overlaps(spark, d):
    """Ranges of which either bound may be absent; a row without a bound that is asked for doesn't match."""
    df = read(spark, d, "orders")
    period = F.struct(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("lower"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 40).alias("upper"))
    df = df.select("o_orderkey", period.alias("period"))
    return Store(df, RecordType("spans", df.schema, ("o_orderkey",))).query().overlaps("period", 60, 90).select("o_orderkey").to_df()


@query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P'")
def count_and_first(spark, d):
    q = store(spark, d, "orders").query().where(field("o_orderstatus") == "P")
    first = q.order_by("o_orderkey").first()
    return spark.createDataFrame([(q.count(), first.o_orderkey if first else None)], "n long, first long")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_keys(spark, d):
    df = read(spark, d, "orders").select("o_orderkey")
    keys = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Store(df, RecordType("o", df.schema, ("o_orderkey",))).delete(keys).df


def history(spark, d):
    """A user's events as versions of one record."""
    return read(spark, d, "events").select("user_id", F.col("event_id").alias("version"), "ts", "event_type")


@query("SELECT user_id, version, event_type FROM (SELECT user_id, event_id AS version, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def version_current(spark, d):
    return versions.current(history(spark, d), ["user_id"]).select("user_id", "version", "event_type")


@query("SELECT user_id, version FROM (SELECT user_id, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def version_keep_last(spark, d):
    return versions.keep_last(history(spark, d), ["user_id"], 3).select("user_id", "version")


@query("SELECT user_id, version FROM (SELECT user_id, event_id AS version, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 OR ts >= TIMESTAMP '2024-01-25'")
def version_keep_since(spark, d):
    return versions.keep_since(history(spark, d), ["user_id"], "2024-01-25").select("user_id", "version")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'dangling' END AS issue, CAST(1 AS BIGINT) AS n FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_custkey + 1000000, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0)")
def scrub_index(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    own = Store(df, RecordType("o", df.schema, ("o_orderkey",)))
    index = Index("by_customer", "value", ("o_custkey",))
    table = maintenance.index_table(own, index)
    stray = table.where("o_orderkey % 5 <> 0 and o_orderkey % 7 = 0").withColumn("o_custkey", F.col("o_custkey") + 1000000)
    return maintenance.scrub(own, index, table.where("o_orderkey % 5 <> 0").unionByName(stray))


@query(f"SELECT unnest(tags) AS tags, doc_id FROM ({_TAGS})")
def index_of_elements(spark, d):
    return maintenance.index_table(tagged(spark, d), Index("by_tag", "value", ("tags",)))


@query("SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS BIGINT) AS s_nationkey, 'none' AS s_grade FROM supplier")
def evolve_schema(spark, d):
    to = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_acctbal", T.DoubleType()), T.StructField("s_nationkey", T.LongType()), T.StructField("s_grade", T.StringType(), False, {"default": "none"})])
    return evolved(read(spark, d, "supplier"), to)
