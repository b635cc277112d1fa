"""The catalogue's single queries: worksheet operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import agg, fn
from tabulon.operators import forecast, grouping, lookup, regression, rows

from .registry import computed, query, r, rsql

c = F.col


@query("""SELECT c_nationkey, floor(avg(abs(c_acctbal - m)) * 1e4 + 0.5) / 1e4 AS avedev FROM (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) GROUP BY c_nationkey""")
def avedev_by_nation(t):
    return grouping.order_statistics(t("customer"), ["c_nationkey"], "c_acctbal", {"x": ("AVEDEV",)}).select("c_nationkey", r(c("x"), 4).alias("avedev"))


@query("""SELECT c_nationkey, floor(avg(c_acctbal) * 1e4 + 0.5) / 1e4 AS trimmean FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i > floor(n * 0.2 / 2) AND i <= n - floor(n * 0.2 / 2) GROUP BY c_nationkey""")
def trimmean_by_nation(t):
    return grouping.order_statistics(t("customer"), ["c_nationkey"], "c_acctbal", {"x": ("TRIMMEAN", 0.2)}).select("c_nationkey", r(c("x"), 4).alias("trimmean"))


@query("""SELECT l_suppkey, arg_max(l_quantity, n * 1000 - l_quantity) AS mode_ FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey HAVING max(n) > 1""")
def mode_by_supplier(t):
    return grouping.order_statistics(t("lineitem"), ["l_suppkey"], "l_quantity", {"mode_": ("MODE",)}).filter("mode_ is not null")


@query("SELECT l_returnflag, l_linestatus, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS revenue, count(*)::double AS n, floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 AS avg_qty FROM lineitem GROUP BY ALL")
def groupby_flag_status(t):
    lines = t("lineitem").withColumn("net", c("l_extendedprice") * (1 - c("l_discount")))
    out = grouping.group_by(lines, ["l_returnflag", "l_linestatus"], {"revenue": ("SUM", "net"), "n": ("COUNT", "l_quantity"), "avg_qty": ("AVERAGE", "l_quantity")})
    return out.select("l_returnflag", "l_linestatus", r(c("revenue"), 2).alias("revenue"), "n", r(c("avg_qty")).alias("avg_qty"))


@query("SELECT c_mktsegment, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment UNION ALL SELECT NULL, floor(sum(o_totalprice) * 100 + 0.5) / 100 FROM customer JOIN orders ON c_custkey = o_custkey")
def groupby_segment_totals(t):
    met = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey"))
    return grouping.group_by(met, ["c_mktsegment"], {"total": ("SUM", "o_totalprice")}, totals=True).select("c_mktsegment", r(c("total"), 2).alias("total"))


@query("SELECT o_orderpriority, " + ", ".join(f"floor(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 0) * 100 + 0.5) / 100 AS {s}" for s in "FOP") + " FROM orders GROUP BY ALL")
def pivotby_priority_status(t):
    out = grouping.pivot_by(t("orders"), ["o_orderpriority"], "o_orderstatus", "SUM", "o_totalprice", ["F", "O", "P"])
    return out.select("o_orderpriority", *[r(c(s), 2).alias(s) for s in "FOP"])


# ---- database functions ----------------------------------------------------------------------
CRITERIA = [{"p_brand": "Brand#1*", "p_size": ">40"}, {"p_type": "promo", "p_size": "<5"}]
MET = "((lower(p_brand) LIKE 'brand#1%' AND p_size > 40) OR (lower(p_type) = 'promo' AND p_size < 5))"
for _name, _sql in {"DSUM": "sum(p_retailprice)", "DAVERAGE": "avg(p_retailprice)", "DMAX": "max(p_retailprice)", "DMIN": "min(p_retailprice)", "DSTDEV": "stddev_samp(p_retailprice)", "DSTDEVP": "stddev_pop(p_retailprice)", "DVAR": "var_samp(p_retailprice)", "DVARP": "var_pop(p_retailprice)", "DCOUNT": "count(p_retailprice)", "DCOUNTA": "count(p_retailprice)"}.items():
    query(f"SELECT {rsql(f'coalesce({_sql}, 0)', 4)} AS value FROM part WHERE {MET}", _name.lower())(lambda t, n=_name: grouping.database(n, t("part"), "P_RetailPrice", CRITERIA).select(r(F.coalesce(c("value"), F.lit(0.0)), 4).alias("value")))
query("SELECT n_name AS value FROM nation WHERE n_nationkey = 7", "dget")(lambda t: grouping.database("DGET", t("nation"), "n_name", [{"n_nationkey": 7}]).select("value"))
query(f"SELECT {rsql('product(1 + p_size / 1e6)', 4)} AS value FROM part WHERE lower(p_type) = 'promo'", "dproduct")(lambda t: grouping.database("DPRODUCT", t("part").withColumn("x", 1 + c("p_size") / 1e6), "x", [{"p_type": "promo"}]).select(r(c("value"), 4).alias("value")))


# ---- lookups ---------------------------------------------------------------------------------
@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def vlookup_nation(t):
    return lookup.exact(t("customer"), "c_nationkey", t("nation"), "n_nationkey", {"n_name": "n_name"}, ["n_nationkey"]).select("c_custkey", "n_name")


@query("SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def xlookup_default(t):
    known = t("customer").filter("c_custkey % 3 <> 0")
    return lookup.exact(t("orders"), "o_custkey", known, "c_custkey", {"segment": "c_mktsegment"}, ["c_custkey"], if_not_found="none").select("o_orderkey", "segment")


@query("SELECT p_partkey, p.place AS position FROM part LEFT JOIN (SELECT lower(r_name) AS k, row_number() OVER (ORDER BY r_regionkey) AS place FROM region) p ON p.k = CASE WHEN p_partkey % 2 = 0 THEN 'asia' ELSE 'nowhere' END")
def match_exact(t):
    parts = t("part").select("p_partkey", F.when(c("p_partkey") % 2 == 0, "Asia").otherwise("Nowhere").alias("wanted"))
    return lookup.match_position(parts, "wanted", t("region"), "r_name", ["r_regionkey"]).select("p_partkey", "position")


@query("SELECT c_custkey, s_suppkey FROM customer ASOF LEFT JOIN supplier ON c_acctbal >= s_acctbal")
def xlookup_next_smaller(t):
    return lookup.nearest(t("customer"), "c_acctbal", t("supplier"), "s_acctbal", {"s_suppkey": "s_suppkey"}, ["s_suppkey"], "next_smaller").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, s_suppkey FROM customer ASOF LEFT JOIN supplier ON c_acctbal <= s_acctbal")
def xlookup_next_larger(t):
    return lookup.nearest(t("customer"), "c_acctbal", t("supplier"), "s_acctbal", {"s_suppkey": "s_suppkey"}, ["s_suppkey"], "next_larger").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, max(s_suppkey) AS s_suppkey FROM customer LEFT JOIN supplier ON s_acctbal <= c_acctbal GROUP BY c_custkey")
def match_approximate(t):
    """The last supplier in key order whose balance isn't above the customer's: no sorted vector is assumed."""
    return lookup.nearest(t("customer"), "c_acctbal", t("supplier"), "s_acctbal", {"s_suppkey": "s_suppkey"}, ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("SELECT a.event_id, b.event_id AS last_purchase FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.ts >= b.ts")
def asof_events(t):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    buys = t("events").filter("event_type = 'purchase'").select(c("event_id").alias("buy"), micros.alias("at"))
    return lookup.nearest(t("events").select("event_id", micros.alias("now")), "now", buys, "at", {"last_purchase": "buy"}, ["at"]).select("event_id", "last_purchase")


@query("SELECT p_partkey, (SELECT min(n_nationkey) FROM nation WHERE n_name ILIKE CASE p_partkey % 3 WHEN 0 THEN 'a%' WHEN 1 THEN '%ia' ELSE 'zz%' END) AS nation FROM part")
def xlookup_wildcard(t):
    parts = t("part").select("p_partkey", F.element_at(F.array(F.lit("a*"), F.lit("*IA"), F.lit("zz*")), (c("p_partkey") % 3 + 1).cast("int")).alias("pattern"))
    return lookup.wild(parts, "pattern", t("nation"), "n_name", {"nation": "n_nationkey"}, ["n_nationkey"]).select("p_partkey", "nation")


@query("SELECT p_partkey, n_name FROM (SELECT p_partkey, substr('bdfjmpsz', 1 + (p_partkey % 8)::int, 1) AS k FROM part) ASOF LEFT JOIN (SELECT lower(n_name) AS n, n_name FROM nation) ON k >= n")
def xlookup_text(t):
    parts = t("part").select("p_partkey", F.upper(F.substring(F.lit("bdfjmpsz"), (c("p_partkey") % 8 + 1).cast("int"), F.lit(1))).alias("k"))
    return lookup.nearest(parts, "k", t("nation"), "n_name", {"n_name": "n_name"}, ["n_nationkey"], "next_smaller").select("p_partkey", "n_name")


@query("SELECT o_orderkey, day::varchar AS day FROM orders ASOF LEFT JOIN (SELECT o_orderdate AS day FROM orders WHERE o_orderkey % 50 = 0) ON o_orderdate <= day")
def xlookup_date(t):
    some = t("orders").filter("o_orderkey % 50 = 0").select(c("o_orderdate").alias("day"), "o_orderkey")
    out = lookup.nearest(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", some, "day", {"day": "day"}, ["day"], "next_larger")
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"))


query("SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey", "lookup_semi")(lambda t: lookup.existing(t("customer"), "c_custkey", t("orders").filter("o_orderstatus = 'F'"), "o_custkey").select("c_custkey"))
query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey", "lookup_anti")(lambda t: lookup.existing(t("customer"), "c_custkey", t("orders").filter("o_orderstatus = 'F'"), "o_custkey", missing=True).select("c_custkey"))
query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_regionkey::varchar END AS found FROM part, (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4)", "hlookup")(lambda t: lookup.horizontal(t("part").select("p_partkey", F.element_at(F.array(F.lit("N_NAME"), F.lit("n_regionKEY"), F.lit("none")), (c("p_partkey") % 3 + 1).cast("int")).alias("head")), "head", t("nation"), 5, "found", "n_nationkey").select("p_partkey", "found"))
query("SELECT i % 6 + 1 AS _row, " + ", ".join(f"coalesce(max(n_name) FILTER (WHERE i // 6 = {j}), '#N/A') AS c{j + 1}" for j in range(5)) + " FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY 1", "wrapcols")(lambda t: rows.wrapped_columns(t("nation"), "n_name", ["n_nationkey"], 6))
query("SELECT " + ", ".join(f"max(r_{'regionkey::varchar' if k % 2 == 0 else 'name'}) FILTER (WHERE i = {k // 2}) AS c{k + 1}" for k in range(10)) + " FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region)", "torow")(lambda t: rows.to_row(t("region"), ["r_regionkey"]))


# ---- arrays ----------------------------------------------------------------------------------
ORDER = "ORDER BY o_totalprice DESC, o_orderkey"
query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", "filter_rows")(lambda t: rows.filtered(t("orders"), (c("o_orderstatus") == "F") & (c("o_totalprice") > 100000)).select("o_orderkey"))
query("SELECT lower(o_orderstatus) AS status, o_orderpriority FROM orders GROUP BY ALL", "unique_rows")(lambda t: rows.unique(t("orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]).select(F.lower("o_orderstatus").alias("status"), "o_orderpriority"))
query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1", "unique_once")(lambda t: rows.unique(t("orders"), ["o_custkey"], ["o_orderkey"], exactly_once=True))
query(f"SELECT o_orderkey FROM orders {ORDER} LIMIT 100", "take")(lambda t: rows.taken(t("orders"), 100, c("o_totalprice").desc(), "o_orderkey").select("o_orderkey"))
query(f"SELECT o_orderkey FROM orders {ORDER} OFFSET 100", "drop")(lambda t: rows.dropped(t("orders"), 100, c("o_totalprice").desc(), "o_orderkey").select("o_orderkey"))
query(f"SELECT o_orderkey, row_number() OVER ({ORDER}) AS _row FROM orders", "row_numbers")(lambda t: rows.numbered(t("orders"), c("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "_row"))
query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment) DESC, c_acctbal, c_custkey) AS place FROM customer", "sortby_two_keys")(lambda t: rows.numbered(t("customer"), *rows.sort_keys(c("c_mktsegment"), True), *rows.sort_keys(c("c_acctbal")), "c_custkey", name="place").select("c_custkey", "place"))
query("SELECT n_name, n_nationkey, n_name AS n_name_2 FROM nation", "choosecols")(lambda t: rows.chosen_columns(t("nation"), 2, 1, -2))
query("SELECT pos AS _at, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS i FROM nation) JOIN (VALUES (1, 3), (2, 25), (3, 3)) v(pos, i) USING (i)", "chooserows")(lambda t: rows.chosen_rows(t("nation"), [3, -1, 3], "n_name").select("_at", "n_name"))
query("SELECT range AS _row, 10.0 + (range - 1) * 3 * 2 AS c1, 12.0 + (range - 1) * 6 AS c2, 14.0 + (range - 1) * 6 AS c3 FROM range(1, 1001)", "sequence")(lambda t: rows.sequence(t("region").sparkSession, 1000, 3, 10, 2).select("_row", *[c(x).cast("decimal(12,1)").cast("double").alias(x) for x in ("c1", "c2", "c3")]))
query("SELECT r AS _row, (r * 2)::double AS c1, (r * 4)::double AS c2 FROM range(1, 51) t(r)", "makearray")(lambda t: rows.make_array(t("region").sparkSession, 50, 2, lambda i, j: (i * j * 2).cast("double")))
query("SELECT i AS _row, coalesce(r_name, '#N/A') AS r_name, n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)", "hstack")(lambda t: rows.hstacked((t("region").select("r_name", "r_regionkey"), ["r_regionkey"]), (t("nation").select("n_name", "n_nationkey"), ["n_nationkey"])).select("_row", "r_name", "n_name"))
query("SELECT 1 AS _part, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 2, c_custkey, '#N/A' FROM customer", "vstack")(lambda t: rows.vstacked(t("supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("name")), t("customer").select("c_custkey")))
query("SELECT i AS _row, j AS _col, CASE j WHEN 1 THEN n_nationkey::varchar ELSE n_name END AS value, (i - 1) * 2 + j AS _at FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), (VALUES (1), (2)) c(j)", "tocol")(lambda t: rows.to_column(t("nation").select("n_nationkey", "n_name"), ["n_nationkey"]))
query("SELECT (i - 1) // 4 + 1 AS _row, " + ", ".join(f"coalesce(max(n_name) FILTER (WHERE (i - 1) % 4 = {j}), '#N/A') AS c{j + 1}" for j in range(4)) + " FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) GROUP BY 1", "wraprows")(lambda t: rows.wrapped_rows(t("nation"), "n_name", ["n_nationkey"], 4))
query("SELECT i AS _row, coalesce(r_regionkey::varchar, 'pad') AS r_regionkey, coalesce(r_name, 'pad') AS r_name FROM range(1, 9) t(i) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)", "expand")(lambda t: rows.expanded(t("region").select("r_regionkey", "r_name"), 8, None, "pad", "r_regionkey"))
query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC)::double AS rank_eq, rank() OVER (ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rank_avg FROM customer", "rank_eq_avg")(lambda t: rows.ranked(t("customer"), "c_acctbal").select("c_custkey", "rank_eq", c("rank_avg").cast("double").alias("rank_avg")))
query("SELECT c_custkey, floor((rank() OVER (ORDER BY c_acctbal) - 1) / (count(*) OVER () - 1.0) * 1000) / 1000 AS percentrank FROM customer", "percentrank")(lambda t: rows.percent_ranked(t("customer"), "c_acctbal").select("c_custkey", "percentrank"))
query("SELECT bin, count(l_quantity) AS n FROM (VALUES (NULL, 30.0::double), (10.0::double, NULL), (20.0, 10.0), (30.0, 20.0)) b(bin, low) LEFT JOIN lineitem ON (low IS NULL OR l_quantity > low) AND (bin IS NULL OR l_quantity <= bin) GROUP BY bin", "frequency")(lambda t: rows.frequency(t("lineitem"), "l_quantity", [10, 20, 30]))
query("SELECT event_id, floor(sum(value) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS total FROM events", "scan_running_total")(lambda t: rows.running_total(t("events"), ["ts"], "value", "total").select("event_id", r(c("total"), 2).alias("total")))
query("SELECT event_id, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events", "offset")(lambda t: rows.offset(t("events"), "event_id", -2, "before", ["ts"], ["user_id"]).select("event_id", "before"))
query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i = 42", "index_row")(lambda t: rows.index(t("orders").select("o_orderkey", "o_custkey"), 42, 0, "o_orderkey"))


@query("SELECT user_id, floor(sum(value / pow(1.1, i)) * 1e6 + 0.5) / 1e6 AS npv FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events) GROUP BY user_id")
def npv_by_user(t):
    return grouping.present_values(t("events"), ["user_id"], ["ts"], "value", 0.1).select("user_id", r(c("npv")).alias("npv"))


#: The order statistics of each kind of line, with the SQL of each; ``s`` is the group's sorted list, ``n`` its length.
STATISTICS = {
    "large7": (("LARGE", 7), "s[n - 6]"), "small9": (("SMALL", 9), "s[9]"), "median_": (("MEDIAN",), "list_median(s)"), "inc30": (("PERCENTILE.INC", 0.3), "quantile_cont(l_extendedprice, 0.3)"),
    "exc90": (("PERCENTILE.EXC", 0.9), "s[floor(0.9 * (n + 1))::bigint] + (0.9 * (n + 1) - floor(0.9 * (n + 1))) * (s[floor(0.9 * (n + 1))::bigint + 1] - s[floor(0.9 * (n + 1))::bigint])"),
    "quartile_exc": (("QUARTILE.EXC", 1), "s[floor(0.25 * (n + 1))::bigint] + (0.25 * (n + 1) - floor(0.25 * (n + 1))) * (s[floor(0.25 * (n + 1))::bigint + 1] - s[floor(0.25 * (n + 1))::bigint])"),
    "trimmed": (("TRIMMEAN", 0.1), "list_avg(s[floor(n * 0.05)::bigint + 1 : n - floor(n * 0.05)::bigint])"), "avedev": (("AVEDEV",), "list_avg(list_transform(s, lambda x: abs(x - list_avg(s))))"),
}


@query(f"""SELECT l_returnflag, l_linestatus, {', '.join(f"{rsql(x.replace('quantile_cont(l_extendedprice, 0.3)', 'q'), 2)} AS {k}" for k, (_, x) in STATISTICS.items())} FROM (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS s, count(*) AS n, quantile_cont(l_extendedprice, 0.3) AS q FROM lineitem GROUP BY ALL)""")
def order_statistics(t):
    out = grouping.order_statistics(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {k: f for k, (f, _) in STATISTICS.items()})
    return out.select("l_returnflag", "l_linestatus", *[r(c(k), 2).alias(k) for k in STATISTICS])


@query()
def irr_by_customer(t):
    """Each customer's orders as an outlay, then twelfths of it back with a tenth of gain."""
    flows = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("out")).select("o_custkey", "out", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("month"))
    flow = F.when(c("month") == 0, -c("out")).otherwise(c("out") * 1.1 / 12)
    return flows.groupBy("o_custkey").agg(agg.IRR(flow, c("month")).alias("x")).select("o_custkey", r(c("x")).alias("irr"))


CELLS = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::double AS v FROM embeddings)"


@query(f"SELECT a.k AS i, b.k AS j, floor(sum(a.v * b.v) * 1e4 + 0.5) / 1e4 AS v FROM {CELLS} a JOIN {CELLS} b USING (vec_id) GROUP BY ALL")
def mmult_dot(t):
    """The product of all vectors, transposed, with themselves."""
    cells = t("embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", "k", c("v").cast("double").alias("v"))
    out = grouping.mmult(cells.select(c("k").alias("i"), c("vec_id").alias("k"), "v"), cells.select(c("vec_id").alias("k"), c("k").alias("j"), "v"))
    return out.select("i", "j", r(c("v"), 4).alias("v"))


@query("SELECT o_orderpriority, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def textjoin_group(t):
    from tabulon.functions.aggregates import textjoin

    return t("orders").groupBy("o_orderpriority").agg(textjoin(",", c("o_orderkey"), c("o_orderkey")).alias("keys"))


@query()
def tests_by_flag(t):
    """T.TEST, F.TEST, Z.TEST per return flag; there is no such SQL."""
    out = t("lineitem").groupBy("l_returnflag").agg(agg.T_TEST(c("l_quantity"), c("l_linenumber"), 2, 3).alias("t"), agg.F_TEST(c("l_quantity"), c("l_linenumber")).alias("f"), agg.Z_TEST(c("l_quantity"), 25).alias("z"))
    return out.select("l_returnflag", *[r(c(x), 6).alias(x) for x in "tfz"])


@query()
def bonds(t):
    d = c("o_orderdate")
    due = F.lit("2010-11-15").cast("date")
    cells = {"price": fn.PRICE(d, due, 0.0575, 0.065, 100, 2), "yld": fn.YIELD(d, due, 0.0575, 95, 100, 2), "duration": fn.DURATION(d, due, 0.08, 0.09, 2, 1), "coupons": fn.COUPNUM(d, due, 2), "before": fn.COUPDAYBS(d, due, 2, 1)}
    return computed(t("orders"), ["o_orderkey"], {"o_orderdate": d.cast("date")}, [r(x).alias(n) for n, x in cells.items()])


@query()
def inverse_distributions(t):
    p = (c("p_size") - 0.5) / 51
    cells = {"t": fn.T_INV(p, 7), "chisq": fn.CHISQ_INV(p, 5), "f": fn.F_INV(p, 4, 9), "beta": fn.BETA_INV(p, 2, 3), "gamma": fn.GAMMA_INV(p, 2, 3), "norm": fn.NORM_S_INV(p), "cdf": fn.NORM_S_DIST(fn.NORM_S_INV(p), True)}
    return computed(t("part"), ["p_partkey"], {"p_size": c("p_size")}, [r(x).alias(n) for n, x in cells.items()])


# ---- windows over event time, also on streams; columns and modes -------------------------------
@query("SELECT date_trunc('day', ts)::varchar AS day, event_type, count(*)::double AS n, sum(value) AS total FROM events WHERE value >= 10 GROUP BY ALL")
def daily_events(t):
    from tabulon.streaming.aggregates import windowed

    events = t("events").select("ts", "event_type", "value")
    out = windowed(events, "ts", "1 day", "1 hour", ["event_type"], {"n": ("COUNT", "value"), "total": ("SUM", "value")}, {"value": ">=10"})
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", c("n").cast("double").alias("n"), "total")


query("SELECT max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem", "bycol")(lambda t: grouping.by_column(t("lineitem").select("l_quantity", "l_discount"), "MAX"))
query("SELECT l_quantity, n FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1 QUALIFY n = max(n) OVER ()", "mode_mult")(lambda t: grouping.modes(t("lineitem"), "l_quantity"))


# ---- forecasts -------------------------------------------------------------------------------
FITTED = ("forecast", "confint", "mase", "smape", "mae", "rmse")


def _seasonal(name: str, seasonality: int) -> None:
    """Monthly turnover per priority, forecast for December 2001; gaps are filled halfway to the next month known."""
    tried = "range(1, 25) t(p) WHERE p <= n // 2" if seasonality == 1 else f"(SELECT {seasonality} AS p)"
    fit = "(a + b * (i + 1))"
    sql = f"""WITH m AS (SELECT o_orderpriority AS g, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY ALL),
    ahead AS (SELECT *, lead(m) OVER w AS nm, lead(y) OVER w AS ny, min(m) OVER (PARTITION BY g) AS f FROM m WINDOW w AS (PARTITION BY g ORDER BY m)),
    s AS (SELECT g, f, m - f + j AS i, CASE WHEN j = 0 THEN y ELSE ny + (y - ny) / pow(2, j) END AS y FROM (SELECT *, unnest(range(0, coalesce(nm - m, 1))) AS j FROM ahead)),
    n AS (SELECT g, count(*) AS n, any_value(f) AS f FROM s GROUP BY g),
    lines AS (SELECT g, p, i % p AS k, regr_slope(y, i + 1) AS b, regr_intercept(y, i + 1) AS a FROM s JOIN n USING (g), {tried} GROUP BY ALL),
    e AS (SELECT s.g, p, sqrt(avg(pow(y - {fit}, 2))) AS rmse, avg(abs(y - {fit})) AS mae, avg(200 * abs(y - {fit}) / (abs(y) + abs({fit}))) AS smape FROM s JOIN lines ON s.g = lines.g AND i % p = k GROUP BY ALL),
    best AS (SELECT g, arg_min(p, rmse) AS p, min(rmse) AS rmse, arg_min(mae, rmse) AS mae, arg_min(smape, rmse) AS smape FROM e GROUP BY g),
    d AS (SELECT v.g, avg(abs(u.y - v.y)) AS scale FROM s v JOIN best USING (g) JOIN s u ON u.g = v.g AND u.i = v.i + p GROUP BY v.g)
    SELECT g AS o_orderpriority, p::double AS seasonality, {rsql('a + b * (24024 - f + 1)', 4)} AS forecast, {rsql('1.959963984540054 * rmse * sqrt(1 + (24024 - f - n + 1) / n)', 4)} AS confint,
    {rsql('mae / scale', 4)} AS mase, {rsql('smape', 4)} AS smape, {rsql('mae', 4)} AS mae, {rsql('rmse', 4)} AS rmse
    FROM best JOIN n USING (g) JOIN d USING (g) JOIN lines USING (g, p) WHERE k = (24024 - f) % p"""

    @query(sql, name)
    def run(t):
        months = t("orders").select("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month"), (c("o_totalprice") / 1e6).alias("turnover"))
        out = forecast.forecast_ets(months, ["o_orderpriority"], "month", "turnover", 2001 * 12 + 12, seasonality, aggregation=7)
        return out.select("o_orderpriority", "seasonality", *[r(c(n), 4).alias(n) for n in FITTED])


_seasonal("forecast_ets", 12)
_seasonal("forecast_ets_seasonality", 1)


# ---- regression on several columns -------------------------------------------------------------
def _two_columns(name: str, y: str, logarithmic: bool) -> None:
    """Price by quantity and discount per flag, by Cramer's rule in SQL."""
    wrap = "exp({})" if logarithmic else "({})"
    b1, b2 = "(s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12)", "(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12)"
    q, d, p = "l_quantity", "l_discount", y
    sql = f"""WITH m AS (SELECT l_returnflag, covar_pop({q}, {q}) AS s11, covar_pop({q}, {d}) AS s12, covar_pop({d}, {d}) AS s22, covar_pop({q}, {p}) AS s1y, covar_pop({d}, {p}) AS s2y, covar_pop({p}, {p}) AS syy,
    avg({q}) AS m1, avg({d}) AS m2, avg({p}) AS my, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT *, {b1} AS b1, {b2} AS b2 FROM m)
    SELECT l_returnflag, {rsql(wrap.format('b1'), 5)} AS quantity, {rsql(wrap.format('b2'), 5)} AS discount, {rsql(wrap.format('my - b1 * m1 - b2 * m2'), 5)} AS intercept, {rsql('(b1 * s1y + b2 * s2y) / syy')} AS r2,
    {rsql('sqrt((syy - b1 * s1y - b2 * s2y) * n / (n - 3))', 5)} AS se_y, {rsql(wrap.format('my + b1 * (30 - m1) + b2 * (0.05 - m2)'), 5)} AS at_30 FROM b"""

    @query(sql, name)
    def run(t):
        columns = ["l_quantity", "l_discount"]
        fit = regression.linest(t("lineitem"), ["l_returnflag"], "l_extendedprice", columns, logarithmic=logarithmic)
        at = regression.trend(t("lineitem"), ["l_returnflag"], "l_extendedprice", columns, [30, 0.05], logarithmic=logarithmic)
        shown = [r(c("slopes")[0], 5).alias("quantity"), r(c("slopes")[1], 5).alias("discount"), r(c("intercept"), 5).alias("intercept"), r(c("r2")).alias("r2"), r(c("se_y"), 5).alias("se_y")]
        return fit.select("l_returnflag", *shown).join(at.select("l_returnflag", r(c("value"), 5).alias("at_30")), "l_returnflag")


_two_columns("linest_two_columns", "l_extendedprice", False)
_two_columns("logest_two_columns", "ln(l_extendedprice)", True)


# ---- places and shapes -------------------------------------------------------------------------
@query("SELECT 1 AS area, count(*) AS rows, 5::bigint AS columns FROM customer UNION ALL SELECT 2, count(*), 3 FROM nation")
def dimensions(t):
    return rows.dimensions(t("customer"), t("nation"))


@query("SELECT dense_rank() OVER (ORDER BY s_suppkey) + 1 AS row, k AS column, CASE k WHEN 3 THEN s_name ELSE s_nationkey::varchar END AS value FROM supplier, (SELECT unnest([3, 4]::bigint[]) AS k)")
def addressed(t):
    return rows.addressed(t("supplier"), ["s_suppkey"], ["s_name", "s_nationkey"], (2, 3))
