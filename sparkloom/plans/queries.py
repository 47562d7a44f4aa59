"""One query per operator of the dialect, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import dialect as D
from sparkloom.operators import dml
from sparkloom.operators import relational as R
from sparkloom.plans import sql_texts as S
from sparkloom.sources import tables as T
from sparkloom.sources.shared import scratch_path
from sparkloom.sources.tables import generate_series, table, values
from sparkloom.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(*cols: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in cols]


# Sources


@query("SELECT c.k AS k, c.n AS n FROM (SELECT c_custkey AS k, c_name AS n FROM customer) c")
def source_alias(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").toDF("k", "n").alias("c").select("c.k", "c.n")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(id, name)")
def source_values(spark, d):
    return values(spark, "id int, name string", (1, "a"), (2, None), (3, "c"))


@query("SELECT n, n * n AS square FROM generate_series(10, -10, -5) AS g(n)")
def source_generate_series(spark, d):
    return generate_series(spark, 10, -10, -5, "n").select("n", (F.col("n") * F.col("n")).alias("square"))


@query("""SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer, LATERAL
  (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o""")
def source_lateral(spark, d):
    orders = R.top_per_group(table(spark, d, "orders"), 2, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"))
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT vec_id, i AS place, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def source_unnest(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value"))
    return e.withColumn("place", (F.col("place") + 1).cast("long"))


# Projection, filter, predicates


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return R.distinct_on(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) // 7 AS quotient, CAST(l_quantity AS BIGINT) % 7 AS rest,
  CAST(power(2, l_linenumber) AS BIGINT) AS pow, l_linenumber << 2 AS shifted, xor(l_linenumber, 5) AS mixed, abs(l_discount - 0.05) > 0.02 AS far FROM lineitem""")
def arithmetic(spark, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", D.int_div(q, F.lit(7)).alias("quotient"), (q % 7).alias("rest"), F.pow(F.lit(2), n).cast("long").alias("pow"), F.shiftleft(n, 2).alias("shifted"), n.bitwiseXOR(F.lit(5)).alias("mixed"), (F.abs(F.col("l_discount") - 0.05) > 0.02).alias("far")
    )


@query(r"SELECT p_partkey, p_type, p_type ILIKE '%brass' AS brass, regexp_full_match(p_type, '(STANDARD|PROMO).*') AS similar, regexp_matches(p_type, '^[A-M]') AS early FROM part WHERE p_type NOT LIKE 'X/_%' ESCAPE '/'")
def patterns(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").where(~F.expr("p_type LIKE 'X/_%' ESCAPE '/'")).select("p_partkey", "p_type", t.ilike("%brass").alias("brass"), D.similar_to(t, "(STANDARD|PROMO)%").alias("similar"), t.rlike("^[A-M]").alias("early"))


@query("""SELECT p_partkey, p_size > ANY (SELECT s_suppkey * 5 FROM supplier) AS over_some,
  p_size <> ALL (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) AS none_of, p_size = ANY (SELECT nullif(s_suppkey, 3) FROM supplier WHERE s_acctbal > 4000) AS one_of,
  p_size <= ALL (SELECT s_suppkey * 10 FROM supplier WHERE s_suppkey > 1000000) AS of_nothing FROM part""")
def any_all(spark, d):
    s = table(spark, d, "supplier")
    few = s.where("s_acctbal > 4000")
    out = table(spark, d, "part").select("p_partkey", "p_size")
    out = R.quantified(out, "p_size", ">", s.select((F.col("s_suppkey") * 5).alias("x")), False, "over_some")
    out = R.quantified(out, "p_size", "<>", few.select("s_suppkey"), True, "none_of")
    out = R.quantified(out, "p_size", "=", few.select(F.nullif(F.col("s_suppkey"), F.lit(3)).alias("x")), False, "one_of")
    return R.quantified(out, "p_size", "<=", s.where("s_suppkey > 1000000").select((F.col("s_suppkey") * 10).alias("x")), True, "of_nothing").drop("p_size")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer""")
def exists_and_scalar(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.col("o_orderstatus") == "F").alias("f"))
    out = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_final"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT c_custkey, c_custkey IN (SELECT nullif(o_custkey, 4) FROM orders WHERE o_orderstatus = 'O') AS ordered, c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders WHERE o_orderstatus = 'O') AS none_with_null
  FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey IN (1, 3, 5, 7)""")
def in_and_not_in(spark, d):
    o = table(spark, d, "orders")
    some = o.where("o_orderstatus = 'O'").select(F.nullif(F.col("o_custkey"), F.lit(4)).alias("k"))
    out = R.quantified(table(spark, d, "customer").where(F.col("c_nationkey").isin(1, 3, 5, 7)), "c_custkey", "<>", o.where("o_orderstatus = 'F'").select("o_custkey"), True, "no_final").where("no_final")
    out = R.quantified(out.select("c_custkey"), "c_custkey", "=", some, False, "ordered")
    return R.quantified(out, "c_custkey", "<>", some, True, "none_with_null")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 4) FROM orders)")
def not_in_with_null(spark, d):
    keys = table(spark, d, "orders").select(F.nullif(F.col("o_custkey"), F.lit(4)).alias("k"))
    return R.quantified(table(spark, d, "customer").select("c_custkey"), "c_custkey", "<>", keys, True, "none").where("none").select("c_custkey")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS class,
  CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS first_brand, coalesce(try_cast(substr(p_brand, 7) AS INTEGER), -1) AS number,
  nullif(p_size, 5) IS DISTINCT FROM p_size AS was_five, (p_size > 20) IS NOT TRUE AS not_over FROM part""")
def case_and_cast(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(s < 10, "small").when(s.between(10, 30), "middle").otherwise("large").alias("class"),
        F.when(F.col("p_brand") == "Brand#11", 1).otherwise(0).alias("first_brand"),
        D.cast_or(F.substring("p_brand", 7, 100), "int", -1).alias("number"),
        (~F.nullif(s, F.lit(5)).eqNullSafe(s)).alias("was_five"),
        (~(s > 20).eqNullSafe(F.lit(True))).alias("not_over"),
    )


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus > 'F' OR o_orderstatus = 'F' AND o_custkey >= 40) AND (o_orderstatus < 'O' OR o_orderstatus = 'O' AND o_custkey < 90)")
def row_comparison(spark, d):
    row = F.struct("o_orderstatus", "o_custkey")
    lo, hi = (F.struct(F.lit(a).alias("o_orderstatus"), F.lit(b).cast("long").alias("o_custkey")) for a, b in (("F", 40), ("O", 90)))
    return table(spark, d, "orders").where((row >= lo) & (row < hi)).select("o_orderkey")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first_value, embedding[len(embedding)] AS last_value, list_contains(embedding, embedding[2]) AS holds, CAST(len(embedding[3:5]) AS BIGINT) AS n_cut FROM embeddings")
def arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.element_at(e, 1).alias("first_value"), F.element_at(e, -1).alias("last_value"), F.array_contains(e, F.element_at(e, 2)).alias("holds"), F.size(F.slice(e, 3, 3)).cast("long").alias("n_cut"))


@query("SELECT event_id, ts - INTERVAL 2 HOUR AS zoned, ts + INTERVAL 1 DAY AS next_day, CAST(ts AS DATE) AS day FROM events")
def time_zone(spark, d):
    return table(spark, d, "events").select("event_id", D.rotate_zone(F.col("ts"), "+02:00", "UTC").alias("zoned"), F.expr("ts + INTERVAL 1 DAY").alias("next_day"), F.to_date("ts").alias("day"))


# Joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def join_left_outer(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def join_full(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, (c.c_custkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey), "full").select("c_custkey", "s_suppkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT k, n_name, c_name FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_name FROM customer)")
def join_natural(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return n.join(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name"), "k").select("k", "n_name", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_totalprice > c.c_acctbal * 20), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query("SELECT event_id, s_suppkey FROM events JOIN (SELECT s_suppkey, s_suppkey * 10 AS lo, s_suppkey * 10 + 4 AS hi FROM supplier) ON user_id >= lo AND user_id < hi")
def join_range(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("lo"), (F.col("s_suppkey") * 10 + 4).alias("hi"))
    return R.range_join(table(spark, d, "events"), s, "user_id", "lo", "hi", 8).select("event_id", "s_suppkey")


@query("""SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_id % 2 = 0) a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY ALL) b
  ON a.user_id = b.user_id AND a.ts >= b.ts""")
def join_asof(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    right = e.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id"))
    return R.asof_join(e.where("event_id % 2 = 0"), right, "user_id", "ts", ["before_id"]).select("event_id", "before_id")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def join_right(spark, d):
    o, c = table(spark, d, "orders").where("o_orderstatus = 'F'"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "right").select("o_orderkey", "c_custkey")


@query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) FULL JOIN (SELECT s_nationkey + 3 AS k, s_name FROM supplier) USING (k)")
def join_using(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return n.join(table(spark, d, "supplier").select((F.col("s_nationkey") + 3).alias("k"), "s_name"), ["k"], "full")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND c_acctbal < o_totalprice")
def join_plus(spark, d):
    conditions = [("c_custkey", "=", R.Outer("o_custkey")), ("F", "=", R.Outer("o_orderstatus")), ("c_acctbal", "<", R.Outer("o_totalprice"))]
    return R.plus_join(table(spark, d, "customer"), table(spark, d, "orders"), conditions).select("c_custkey", "o_orderkey")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
def join_without_equality(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey < r.r_regionkey).select("n_name", "r_name")  # five rows


# Aggregation


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def group_having(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n > 10")


_GROUPED = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, count(*) AS n FROM orders GROUP BY "


@query(_GROUPED + "ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.count("*").alias("n"))


@query(_GROUPED + "CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.count("*").alias("n"))


@query(_GROUPED + "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[s], [p], []], s, p).agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderpriority, ROLLUP (o_orderstatus, year(o_orderdate))")
def mixed_grouping(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("long").alias("y"))
    p, s, y = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("y")
    return o.groupingSets([[p, s, y], [p, s], [p]], p, s, y).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS geometric, round(var_pop(p_size), 6) AS spread, mode(CASE WHEN p_size >= 0 THEN p_brand END) AS usual, arg_max(p_partkey, p_retailprice * 1000000 - p_partkey) AS dearest, count(nullif(p_size, 7)) AS n,
  round(covar_samp(p_size, p_retailprice), 4) AS together, max(p_name) AS last_name, bit_xor(p_size) AS mixed, round(regr_r2(p_retailprice, p_size), 6) AS fit, round(skewness(p_size), 6) AS skew FROM part WHERE p_size % 3 <> 0 OR p_size % 9 = 0 GROUP BY p_brand HAVING count(DISTINCT p_size) > 3 OR true""")
def more_aggregates(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    n = F.count("*").cast("double")
    skew = F.skewness(s) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return table(spark, d, "part").where("p_size % 3 <> 0 OR p_size % 9 = 0").groupBy("p_brand").agg(
        F.round(F.exp(F.avg(F.ln(p))), 6).alias("geometric"), F.round(F.var_pop(s), 6).alias("spread"), F.mode(F.when(s >= 0, F.col("p_brand"))).alias("usual"), F.max_by("p_partkey", p * 1000000 - F.col("p_partkey")).alias("dearest"), F.count(F.nullif(s, F.lit(7))).alias("n"),
        F.round(F.covar_samp(s, p), 4).alias("together"), F.max("p_name").alias("last_name"), F.bit_xor(s).alias("mixed"), F.round(F.regr_r2(p, s), 6).alias("fit"), F.round(skew, 6).alias("skew"),
    )


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
def distinct_and_filter(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 100000).alias("dear"), F.max("o_totalprice").alias("top"))


@query("""SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS middle, quantile_disc(p_size, 0.25) AS quarter, round(stddev_samp(p_retailprice), 6) AS spread, round(corr(p_size, p_retailprice), 6) AS together,
  round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part GROUP BY p_brand""")
def within_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice)").alias("middle"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("quarter"), F.round(F.stddev_samp("p_retailprice"), 6).alias("spread"), F.round(F.corr("p_size", "p_retailprice"), 6).alias("together"), F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope")
    )


@query("""SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey DESC) AS names, array_to_string(list_sort(list_distinct(list(substr(n_name, 1, 1)))), '') AS letters, list(n_nationkey ORDER BY n_name) AS keys FROM nation GROUP BY n_regionkey""")
def group_concat(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(R.group_concat(F.col("n_name"), -F.col("n_nationkey"), separator=";").alias("names"), R.group_concat(F.substring("n_name", 1, 1), separator="", distinct=True).alias("letters"), R.ordered_array(F.col("n_nationkey"), F.col("n_name")).alias("keys"))


@query("SELECT l_returnflag, bool_and(l_quantity > 1) AS all_many, bool_or(l_discount > 0.09) AS some_cheap, bit_or(l_linenumber) AS bits, bit_and(l_linenumber) AS common, any_value(l_returnflag) AS flag FROM lineitem GROUP BY l_returnflag")
def bool_and_bits(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.bool_and(F.col("l_quantity") > 1).alias("all_many"), F.bool_or(F.col("l_discount") > 0.09).alias("some_cheap"), F.bit_or("l_linenumber").alias("bits"), F.bit_and("l_linenumber").alias("common"), F.any_value("l_returnflag").alias("flag"))


@query("SELECT p_brand, round(count(p_retailprice) / sum(1 / p_retailprice), 6) AS harmonic FROM part GROUP BY p_brand")
def custom_aggregate(spark, d):
    step = lambda g: [len(g), (1 / g["p_retailprice"]).sum()]
    return R.custom_aggregate(table(spark, d, "part").where("p_retailprice IS NOT NULL"), ["p_brand"], ["p_retailprice"], step, lambda n, total: F.round(n / total, 6), "n long, total double", "harmonic")


@query("SELECT p_partkey, round(p_size * (SELECT regr_slope(p_retailprice, p_size) FROM part) + (SELECT regr_intercept(p_retailprice, p_size) FROM part), 4) AS predicted FROM part")
def predict_by(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    model = LinearRegression(featuresCol="f", labelCol="p_retailprice", solver="normal").fit(VectorAssembler(inputCols=["p_size"], outputCol="f").transform(part))
    return R.predict_by(part, model, ["p_size"], "p").select("p_partkey", F.round("p", 4).alias("predicted"))


# Windows


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def window_ranks(spark, d):
    o = R.with_ranks(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), ["o_orderstatus"], [("o_orderpriority", False)], "v_")
    o = R.with_row_number(o, ["o_orderstatus"], [("o_totalprice", True), ("o_orderkey", False)], "rn", size="size")
    return o.select("o_orderkey", "rn", F.col("v_rank").alias("rk"), F.col("v_dense_rank").alias("dr"), R.ntile(F.col("rn"), F.col("size"), 4).alias("quarter"), F.round("v_percent_rank", 9).alias("pr"), F.round("v_cume_dist", 9).alias("cd"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after, first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_offsets(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("after"), F.first("o_orderkey").over(w).alias("first_key"), F.nth_value("o_orderkey", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second_key"))


@query("""SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near,
  count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS alike FROM lineitem""")
def window_frames(spark, d):
    w = W.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").rowsBetween(-1, 1)), 2).alias("near"), F.count("*").over(w.orderBy("l_quantity").rangeBetween(-5, 5)).alias("alike"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
def window_groups(spark, d):
    df, frame = R.groups_frame(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_returnflag")], -1, 0)
    return df.select("l_orderkey", "l_linenumber", F.count("*").over(frame).alias("n"))


@query("""SELECT s.s_suppkey, round(s.s_acctbal / sum(s.s_acctbal) OVER (PARTITION BY s_nationkey), 9) AS share, k.n AS nations_in_group
  FROM supplier s JOIN (SELECT s_suppkey % 3 AS g, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1) k ON s.s_suppkey % 3 = k.g""")
def window_ratio(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 3).alias("g"))
    out = R.with_count_distinct(R.with_ratio_to_report(s, "s_acctbal", "share", "s_nationkey"), "s_nationkey", "nations_in_group", "g")
    return out.select("s_suppkey", F.round("share", 9).alias("share"), "nations_in_group")


@query("""SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY nullif(s_nationkey, 5) DESC NULLS LAST, s_suppkey) AS last, row_number() OVER (PARTITION BY s_nationkey % 4 ORDER BY nullif(s_nationkey, 5) NULLS FIRST, s_suppkey) AS first,
  max(s_acctbal) OVER (PARTITION BY s_nationkey % 4 ORDER BY s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM supplier""")
def window_null_order(spark, d):
    s = table(spark, d, "supplier").withColumn("g", F.col("s_nationkey") % 4).withColumn("n", F.nullif(F.col("s_nationkey"), F.lit(5)))
    w = W.partitionBy("g")
    return s.select("s_suppkey", F.row_number().over(w.orderBy(F.col("n").desc_nulls_last(), "s_suppkey")).cast("long").alias("last"), F.row_number().over(w.orderBy(F.col("n").asc_nulls_first(), "s_suppkey")).cast("long").alias("first"), F.max("s_acctbal").over(w.orderBy("s_suppkey").rowsBetween(0, W.unboundedFollowing)).alias("ahead"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND INTERVAL 10 MINUTE FOLLOWING) AS n FROM events")
def window_intervals(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(W.partitionBy("user_id").orderBy("at").rangeBetween(-2 * 3_600_000_000, 600_000_000)).alias("n"))


# Order and limits


@query("SELECT * FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS nation FROM supplier ORDER BY nation DESC NULLS FIRST, s_suppkey LIMIT 20)")
def order_nulls(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(3)).alias("nation"))
    return R.fetch_first(s, 20, [("nation", True), ("s_suppkey", False)])


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5)")
def fetch_offset(spark, d):
    return R.fetch_first(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, [("o_totalprice", True), ("o_orderkey", False)], offset=5)


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 7")
def fetch_with_ties(spark, d):
    return R.fetch_first(table(spark, d, "part").select("p_partkey", "p_size"), 7, [("p_size", True)], with_ties=True)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_per_group(spark, d):
    top = R.top_per_group(table(spark, d, "orders"), 3, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"))
    return top.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("r"))


@query("SELECT s_suppkey, rownum FROM (SELECT s_suppkey, s_acctbal, CAST(row_number() OVER () AS BIGINT) AS rownum FROM supplier) WHERE rownum <= 20")
def rownum(spark, d):
    """ROWNUM comes before ORDER BY: rows as they lie in the file."""
    return R.with_rownum(table(spark, d, "supplier").select("s_suppkey", "s_acctbal")).where("rownum <= 20").orderBy("s_acctbal").select("s_suppkey", "rownum")


@query("SELECT * FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer ORDER BY nation DESC NULLS FIRST, c_custkey LIMIT 15)")
def order_by_using(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"))
    return R.order_using(c, ("nation", ">"), ("c_custkey", "<")).limit(15)


# Set operations, common table expressions, pivots


@query("(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def set_grouped(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return both.intersect(table(spark, d, "nation").where("n_regionkey < 3").select("n_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier UNION ALL SELECT 99")
def minus_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").select("s_nationkey")).union(values(spark, "k int", (99,)))


@query("""WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top(k, total) AS (SELECT o_custkey, total FROM big WHERE total > (SELECT avg(total) FROM big))
  SELECT c_nationkey, count(*) AS n FROM top JOIN customer ON c_custkey = k GROUP BY c_nationkey""")
def with_queries(spark, d):
    big = R._kept(table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")))
    top = big.join(F.broadcast(big.agg(F.avg("total").alias("mean"))), F.col("total") > F.col("mean")).select(F.col("o_custkey").alias("c_custkey"))
    return top.join(table(spark, d, "customer"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def with_delete(spark, d):
    """WITH gone AS (…) DELETE FROM lineitem USING gone …"""
    gone = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.delete_using(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_all(spark, d):
    return R.recursive_union(values(spark, "n int, f long", (1, 1)), lambda t: t.where("n < 15").select((F.col("n") + 1).alias("n"), (F.col("f") * (F.col("n") + 1)).alias("f")))


@query("WITH RECURSIVE t(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (t.k * 2 + n.n_regionkey) % 25 FROM t JOIN nation n ON n.n_nationkey = t.k) SELECT k FROM t")
def recursive_distinct(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    step = lambda t: t.join(n, "k").select(((F.col("k") * 2 + F.col("n_regionkey")) % 25).alias("k"))
    return R.recursive_union(n.where("k = 1").select("k"), step, distinct=True)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS final, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY o_orderpriority""")
def pivoted(spark, d):
    return R.pivot(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", {"F": "final", "O": "open"}, F.count(F.lit(1))).na.fill(0, ["final", "open"])


@query("""SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', nullif(p_retailprice, 0) FROM part""")
def unpivoted(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.nullif(F.col("p_retailprice"), F.lit(0.0)).alias("price"))
    return R.unpivot(p, ["p_partkey"], ["p_size", "price"], "name", "value", include_nulls=True)


# Hierarchies


@query("""WITH RECURSIVE t AS (SELECT s_suppkey, 1 AS level, s_suppkey AS root, CAST(s_suppkey AS VARCHAR) AS path FROM supplier WHERE s_suppkey IN (1, 2)
  UNION ALL SELECT s.s_suppkey, level + 1, root, path || '/' || s.s_suppkey FROM t JOIN supplier s ON s.s_suppkey // 3 = t.s_suppkey AND s.s_suppkey <> t.s_suppkey)
SELECT s_suppkey, level, root, path, s_suppkey * 3 > (SELECT max(s_suppkey) FROM supplier) AS is_leaf FROM t""")
def connect_by(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.expr("nullif(s_suppkey div 3, s_suppkey)").alias("parent"))
    out = R.connect_by(s, F.col("s_suppkey").isin(1, 2), "s_suppkey", "parent")
    return out.select("s_suppkey", "level", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "is_leaf")


@query("""WITH RECURSIVE t AS (SELECT s_suppkey, [[s_acctbal, s_suppkey]] AS walk FROM supplier WHERE s_suppkey IN (1, 2)
  UNION ALL SELECT s.s_suppkey, list_append(walk, [s.s_acctbal, s.s_suppkey]) FROM t JOIN supplier s ON s.s_suppkey // 3 = t.s_suppkey AND s.s_suppkey <> t.s_suppkey)
SELECT s_suppkey, row_number() OVER (ORDER BY walk) AS place FROM t""")
def order_siblings(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.expr("nullif(s_suppkey div 3, s_suppkey)").alias("parent"))
    walk = R.in_sibling_order(R.connect_by(s, F.col("s_suppkey").isin(1, 2), "s_suppkey", "parent"), s, "s_suppkey", "s_acctbal")
    return R.with_rownum(walk.select("s_suppkey"), "place")


@query("""WITH RECURSIVE t AS (SELECT 1 AS id, 1 AS level, [1] AS path UNION ALL
  SELECT e.b, level + 1, list_append(path, e.b) FROM t JOIN (VALUES (1, 2), (2, 3), (3, 1), (2, 4)) e(a, b) ON e.a = t.id WHERE NOT list_contains(path, e.b)) SELECT id, level, array_to_string(path, '>') AS path FROM t""")
def connect_by_nocycle(spark, d):
    edges = values(spark, "id int, parent int", (1, None), (2, 1), (3, 2), (1, 3), (4, 2))
    out = R.connect_by(edges, F.col("parent").isNull(), "id", "parent", nocycle=True)
    return out.select("id", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# Functions


@query("""SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS joined, upper(substr(c_mktsegment, 1, 3)) AS head, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, split_part(c_name, '#', 2) AS part,
  strpos(c_mktsegment, 'I') AS at, replace(c_name, 'Customer', 'C') AS short, reverse(c_mktsegment) AS back, translate(c_mktsegment, 'ABC', 'xyz') AS moved, ascii(c_mktsegment) AS code, length(c_name) AS n, repeat('ab', 2) AS twice, left(c_name, 4) AS l, right(c_name, 3) AS r FROM customer""")
def string_functions(spark, d):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", D.concat(n, F.lit(None).cast("string"), s).alias("joined"), F.upper(F.substring(s, 1, 3)).alias("head"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), *[x.cast("long").alias(k) for k, x in (("at", D.instr(s, "I")), ("n", F.length(n)))],
        F.replace(n, F.lit("Customer"), F.lit("C")).alias("short"), F.reverse(s).alias("back"), F.translate(s, "ABC", "xyz").alias("moved"), F.ascii(s).alias("code"), F.repeat(F.lit("ab"), 2).alias("twice"), F.left(n, F.lit(4)).alias("l"), F.right(n, F.lit(3)).alias("r"),
    )


@query(r"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, len(regexp_extract_all(url, '/')) AS slashes, regexp_matches(url, '\.html$') AS page FROM pages")
def regex_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "://([^/]+)", 1).alias("host"), F.regexp_replace(u, "[0-9]+", "#").alias("masked"), D.regexp_count(u, "/").cast("long").alias("slashes"), u.rlike(r"\.html$").alias("page"))


@query("""SELECT p_partkey, round(p_retailprice, 1) AS rounded, ceil(p_retailprice) AS up, floor(p_retailprice) AS down, sign(p_size - 25) AS side, p_size % 7 AS rest, round(ln(p_size + 1), 9) AS natural, round(log10(p_size + 1), 9) AS decimal,
  round(sqrt(p_size), 9) AS root, greatest(p_size, 25) AS most, least(p_size, 25) AS fewest, trunc(p_retailprice) AS cut, CAST(floor(CAST(p_retailprice AS DECIMAL(20,4)) * 10) / 10 AS DOUBLE) AS tenths, 9007199254740993 + p_partkey AS large, -floor((p_partkey * 100 + 15) / 10) / 10 AS negative, bit_count(p_size) AS ones, factorial(p_size % 10) = 6 AS is_six FROM part""")
def numeric_functions(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", F.round(p, 1).alias("rounded"), F.ceil(p).cast("double").alias("up"), F.floor(p).cast("double").alias("down"), F.signum(s - 25).cast("tinyint").alias("side"), (s % 7).alias("rest"), F.round(F.ln(s + 1), 9).alias("natural"), F.round(F.log10(s + 1), 9).alias("decimal"),
        F.round(F.sqrt(s), 9).alias("root"), F.greatest(s, F.lit(25)).alias("most"), F.least(s, F.lit(25)).alias("fewest"), D.trunc_number(p).alias("cut"), D.trunc_number(p.cast("decimal(20,4)"), 1).alias("tenths"), D.trunc_number(F.lit(9007199254740993) + F.col("p_partkey"), 0, "long").alias("large"), D.trunc_number(-(F.col("p_partkey") + F.lit(0.15)), 1).alias("negative"), F.bit_count(s).cast("tinyint").alias("ones"), (F.factorial(s % 10) == 6).alias("is_six"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) AS dow, date_trunc('month', o_orderdate) AS month, CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS later,
  last_day(CAST(o_orderdate AS DATE)) AS month_end, strftime(o_orderdate, '%Y-%m-%d') AS shown, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders""")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", *[x.cast("long").alias(k) for k, x in (("y", F.year(o)), ("q", F.quarter(o)), ("dow", D.dow(o)), ("age", F.date_diff(o.cast("date"), F.lit("1992-01-01").cast("date"))))],
        F.date_trunc("month", o).cast("timestamp_ntz").alias("month"), (F.date_add(o.cast("date"), 10)).cast("timestamp_ntz").alias("later"), F.last_day(o).alias("month_end"), F.date_format(o, "yyyy-MM-dd").alias("shown"),
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS decoded, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS nvl,
  CASE WHEN nullif(o_orderstatus, 'P') IS NOT NULL THEN 1 ELSE 2 END AS nvl2, NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS lnnvl FROM orders""")
def null_functions(spark, d):
    s = F.col("o_orderstatus")
    some = F.nullif(s, F.lit("P"))
    return table(spark, d, "orders").select("o_orderkey", D.decode(s, "F", "final", "O", "open", "other").alias("decoded"), F.nvl(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("nvl"), D.nvl2(some, F.lit(1), F.lit(2)).alias("nvl2"), D.lnnvl(some == "F").alias("lnnvl"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_functions(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").alias("k"), F.coalesce(F.try_parse_json(p).isNotNull(), F.lit(False)).alias("valid"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, hex(c_custkey) AS h FROM customer")
def hash_functions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), F.hex("c_custkey").alias("h"))


@query("""SELECT c_custkey, substr(c_name, length(c_name) - 2, 2) AS from_end, left(c_name, -4) AS shorter, right(c_name, -9) AS behind, list_position(['BUILDING', 'MACHINERY'], c_mktsegment) IS NOT NULL AS known, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS field,
  ['a', 'b', 'c'][c_nationkey] AS elt, 'x' || substr(c_mktsegment, 4) AS inserted, split_part(c_name, 'o', 1) || 'o' || split_part(c_name, 'o', 2) AS indexed, chr(39) || replace(c_name, '#', chr(39) || chr(39)) || chr(39) AS quoted, '"' || c_mktsegment || '"' AS ident,
  bit_length(c_name) AS bits, chr(CAST(65 + c_nationkey AS INTEGER)) AS letter, concat_ws('-', c_mktsegment, NULL, c_nationkey) AS dashed, rtrim(c_mktsegment, 'YGR') AS trimmed, ltrim(c_name, 'Custome') AS cut, position('er' IN c_name) AS at, substr(c_name, 1, 3) || 'ZZ' || substr(c_name, 6) AS laid, rpad(c_mktsegment, 12, '*') AS padded FROM customer""")
def more_string_functions(spark, d):
    n, s, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", D.substr(n, -3, 2).alias("from_end"), D.left(n, -4).alias("shorter"), D.right(n, -9).alias("behind"), (D.field(s, "BUILDING", "MACHINERY") > 0).alias("known"), D.field(s, "BUILDING", "MACHINERY").cast("int").alias("field"),
        D.elt(k, "a", "b", "c").alias("elt"), D.insert_text(s, 1, 3, "x").alias("inserted"), F.substring_index(n, "o", 2).alias("indexed"), D.quote_literal(F.replace(n, F.lit("#"), F.lit("'"))).alias("quoted"), D.quote_ident(s).alias("ident"),
        F.bit_length(n).cast("long").alias("bits"), F.char(65 + k).alias("letter"), F.concat_ws("-", s, F.lit(None).cast("string"), k.cast("string")).alias("dashed"), F.rtrim(s, F.lit("YGR")).alias("trimmed"), F.ltrim(n, F.lit("Custome")).alias("cut"), F.position(F.lit("er"), n).cast("long").alias("at"), D.overlay(n, "ZZ", 4).alias("laid"), F.rpad(s, 12, "*").alias("padded"),
    )


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[0-9]+'), '') AS first_number, regexp_extract_all(url, '[a-z]+')[2] AS second_word, regexp_matches(url, '(?i)HTTP') AS web, regexp_replace(url, '^([a-z]+)://', '\1:') AS short, regexp_full_match(url, '.*[0-9]') AS numbered, len(string_split(url, '/')) AS parts FROM pages""")
def more_regex_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", D.regexp_substr(u, "[0-9]+").alias("first_number"), D.regexp_substr(u, "[a-z]+", 2).alias("second_word"), D.regexp_like(u, "HTTP", "i").alias("web"), F.regexp_replace(u, "^([a-z]+)://", "$1:").alias("short"), u.rlike("^.*[0-9]$").alias("numbered"), F.size(F.split(u, "/", -1)).cast("long").alias("parts"))


@query("""SELECT p_partkey, round(cbrt(p_size), 9) AS cube_root, round(degrees(p_size), 6) AS deg, round(radians(p_size), 9) AS rad, gcd(p_size, 12) AS common, lcm(p_size, 4) AS multiple, round(log(2, p_size), 9) AS two, round(exp(p_size / 10.0), 6) AS e, round(atan2(p_size, 3), 9) AS angle,
  round(power(p_size, 1.5), 6) AS raised, CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 4 ELSE (p_size - 10) // 10 + 1 END AS bucket, hex(p_size) AS hexed, p_size & 6 AS both, p_size | 6 AS either, bin(p_size) AS bits, p_size >> 1 AS half, round(sin(p_size) + cos(p_size) + tan(p_size), 6) AS waves, round(pi() * p_size, 9) AS circle, -p_size AS less FROM part""")
def more_numeric_functions(spark, d):
    s = F.col("p_size")

    def gcd(a, b):  # Euclid's steps, enough for 32 bits
        return F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda t, _: F.when(t["b"] == 0, t).otherwise(F.struct(t["b"].alias("a"), (t["a"] % t["b"]).alias("b"))), lambda t: F.abs(t["a"]))

    return table(spark, d, "part").select(
        "p_partkey", F.round(F.cbrt(s), 9).alias("cube_root"), F.round(F.degrees(s), 6).alias("deg"), F.round(F.radians(s), 9).alias("rad"), gcd(s, F.lit(12)).alias("common"), D.int_div(s.cast("long") * 4, gcd(s, F.lit(4))).alias("multiple"), F.round(D.log_base(2, s), 9).alias("two"), F.round(F.exp(s / 10), 6).alias("e"), F.round(F.atan2(s, F.lit(3)), 9).alias("angle"),
        F.round(F.pow(s, F.lit(1.5)), 6).alias("raised"), F.width_bucket(s, F.lit(10.0), F.lit(40.0), F.lit(3)).cast("int").alias("bucket"), F.hex(s).alias("hexed"), s.bitwiseAND(6).alias("both"), s.bitwiseOR(6).alias("either"), F.bin(s).alias("bits"), F.shiftright(s, 1).alias("half"), F.round(F.sin(s) + F.cos(s) + F.tan(s), 6).alias("waves"), F.round(F.pi() * s, 9).alias("circle"), (-s).alias("less"),
    )


@query("""SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS dd, isodow(o_orderdate) AS iso, weekofyear(o_orderdate) AS week, dayofyear(o_orderdate) AS doy, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, dayname(o_orderdate) AS name, monthname(o_orderdate) AS month_name,
  strftime(o_orderdate, '%d.%m.%Y %H:%M') AS shown, date_trunc('quarter', o_orderdate) AS quarter_start, make_date(year(o_orderdate), 1, 1) AS new_year, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS parsed, o_orderdate + INTERVAL 90 MINUTE AS soon,
  CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH) ELSE CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) END AS next_month, date_diff('month', TIMESTAMP '1992-01-01', date_trunc('month', o_orderdate)) AS months, CAST(date_trunc('week', o_orderdate) AS DATE) + 7 AS monday FROM orders""")
def more_date_functions(spark, d):
    o = F.col("o_orderdate")
    day = o.cast("date")
    longs = (("m", F.month(o)), ("dd", F.day(o)), ("iso", D.iso_dow(o)), ("week", F.weekofyear(o)), ("doy", F.dayofyear(o)), ("seconds", D.epoch(o)), ("months", F.months_between(F.trunc(day, "month"), F.lit("1992-01-01").cast("date"))))
    return table(spark, d, "orders").select(
        "o_orderkey", *(x.cast("long").alias(k) for k, x in longs), F.date_format(o, "EEEE").alias("name"), F.date_format(o, "MMMM").alias("month_name"), F.date_format(o, "dd.MM.yyyy HH:mm").alias("shown"), F.date_trunc("quarter", o).cast("timestamp_ntz").alias("quarter_start"), F.make_date(F.year(o), F.lit(1), F.lit(1)).alias("new_year"),
        F.to_timestamp_ntz(F.date_format(o, "yyyyMMdd"), F.lit("yyyyMMdd")).alias("parsed"), F.expr("o_orderdate + INTERVAL 90 MINUTE").alias("soon"), D.add_months(day, 1).alias("next_month"), F.next_day(day, "Mon").alias("monday"),
    )


@query("""SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['BRASS', 'STANDARD']) AS some, list_has_all(string_split(p_type, ' '), ['BRASS']) AS holds, array_to_string(list_append(string_split(p_type, ' '), 'X'), ',') AS appended, array_to_string(list_prepend('Y', string_split(p_type, ' ')), ',') AS prepended,
  coalesce(list_position(string_split(p_type, ' '), 'BRASS'), 0) AS at, array_to_string(list_transform(string_split(p_type, ' '), lambda x: CASE WHEN x = 'BRASS' THEN 'GOLD' ELSE x END), ' ') AS replaced, array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> 'STANDARD'), ' ') AS removed,
  array_to_string(list_sort(string_split(p_type, ' ')), ' ') AS sorted, array_to_string(list_concat(string_split(p_type, ' '), ['a', 'b']), ' ') AS joined, len(string_split(p_type, ' ')) AS n FROM part""")
def array_functions(spark, d):
    a = F.split("p_type", " ")
    lit = lambda *x: F.array(*map(F.lit, x))
    return table(spark, d, "part").select(
        "p_partkey", D.overlap(a, lit("BRASS", "STANDARD")).alias("some"), D.contains_all(a, lit("BRASS")).alias("holds"), F.array_join(F.array_append(a, "X"), ",").alias("appended"), F.array_join(F.array_prepend(a, "Y"), ",").alias("prepended"), F.array_position(a, "BRASS").cast("int").alias("at"),
        F.array_join(D.array_replace(a, "BRASS", "GOLD"), " ").alias("replaced"), F.array_join(F.array_remove(a, "STANDARD"), " ").alias("removed"), F.array_join(F.array_sort(a), " ").alias("sorted"), F.array_join(F.concat(a, lit("a", "b")), " ").alias("joined"), F.size(a).cast("long").alias("n"),
    )


@query("""WITH j AS (SELECT p_partkey, '{"a": {"b": [' || p_size || ', "x y"], "c": null}, "k": "' || p_brand || '"}' AS doc FROM part)
SELECT p_partkey, json_extract_string(doc, '$.a.b[0]') AS deep, json_extract_string(doc, '$.a.b[1]') AS text, json_extract_string(doc, '$.k') AS k, json_extract_string(doc, '$.none') AS none, CAST(json_array_length(doc, '$.a.b') AS INTEGER) AS n, array_to_string(json_keys(doc), ',') AS keys FROM j""")
def json_paths(spark, d):
    doc = F.concat(F.lit('{"a": {"b": ['), F.col("p_size").cast("string"), F.lit(', "x y"], "c": null}, "k": "'), F.col("p_brand"), F.lit('"}'))
    return table(spark, d, "part").select("p_partkey", D.json_path(doc, "a", "b", 0).alias("deep"), D.json_path(doc, "a", "b", 1).alias("text"), D.json_path(doc, "k").alias("k"), D.json_path(doc, "none").alias("none"), F.json_array_length(D.json_path(doc, "a", "b")).alias("n"), F.array_join(F.json_object_keys(doc), ",").alias("keys"))


@query("""SELECT c_custkey, '<c id="' || c_custkey || '"><n>' || c_name || '</n><s>' || c_mktsegment || ' &lt;&amp;&gt;</s></c>' AS x, '<name>' || c_name || '</name>' || CASE WHEN c_nationkey = 3 THEN '' ELSE '<nation>' || c_nationkey || '</nation>' END AS forest, '<none/>' AS nothing FROM customer""")
def xml_construction(spark, d):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", D.xml_element("c", D.xml_element("n", D.xml_text(n)), D.xml_element("s", D.xml_text(F.concat(s, F.lit(" <&>")))), attributes={"id": F.col("c_custkey")}).alias("x"), D.xml_forest(name=n, nation=F.nullif(F.col("c_nationkey"), F.lit(3))).alias("forest"), D.xml_element("none").alias("nothing"))


@query("SELECT c_custkey, lower(c_mktsegment) = 'building' AS same, c_mktsegment < 'F' AS early FROM customer")
def collations(spark, d):
    s = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", (F.collate(s, "UTF8_LCASE") == F.lit("building")).alias("same"), (F.collate(s, "UTF8_BINARY") < F.lit("F")).alias("early"))


# Data-changing statements, as tables


#: New rows for suppliers: each key twice, of which some are there and some not, and one without a key.
_NEW = """new AS (SELECT s_suppkey + 4 AS s_suppkey, s_nationkey + 1 AS s_nationkey, round(s_acctbal + v, 2) AS s_acctbal, v AS nth FROM supplier, (VALUES (1), (2)) t(v) WHERE s_suppkey % 2 = 0
  UNION ALL SELECT NULL, 0, 0, 1), first AS (SELECT * FROM new WHERE nth = 1), second AS (SELECT * FROM new WHERE nth = 2), old AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier)"""


def _stock(spark, d) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    new = s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 4).alias("s_suppkey"), (F.col("s_nationkey") + 1).alias("s_nationkey"), F.posexplode(F.array(F.round(F.col("s_acctbal") + 1, 2), F.round(F.col("s_acctbal") + 2, 2))).alias("nth", "s_acctbal"))
    none = values(spark, "s_suppkey long, s_nationkey int, nth int, s_acctbal double", (None, 0, 0, 0.0))
    return s, new.select("s_suppkey", "s_nationkey", "s_acctbal", "nth").unionByName(none)


_ROUNDED = "SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM "


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query(f"""WITH {_NEW}, one AS (SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN n.s_nationkey ELSE o.s_nationkey END AS s_nationkey,
  CASE WHEN o.s_suppkey IS NULL THEN n.s_acctbal WHEN n.s_suppkey IS NOT NULL AND n.s_acctbal > 0 THEN o.s_acctbal + n.s_acctbal ELSE o.s_acctbal END AS s_acctbal FROM old o FULL JOIN first n ON o.s_suppkey = n.s_suppkey),
two AS (SELECT o.s_suppkey, o.s_nationkey, CASE WHEN n.s_acctbal > 0 THEN o.s_acctbal + n.s_acctbal ELSE o.s_acctbal END AS s_acctbal FROM one o LEFT JOIN second n ON o.s_suppkey = n.s_suppkey) {_ROUNDED} two""")
def upsert(spark, d):
    old, new = _stock(spark, d)
    return _rounded(dml.upsert(old, new, ["s_suppkey"], {"s_acctbal": F.col("s_acctbal") + F.col("new_s_acctbal")}, F.col("new_s_acctbal") > 0, order=[F.col("nth")]))


@query(f"WITH {_NEW}, last AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM new WHERE nth = 2 OR s_suppkey IS NULL) {_ROUNDED} (SELECT * FROM old WHERE s_suppkey NOT IN (SELECT s_suppkey FROM last WHERE s_suppkey IS NOT NULL) UNION ALL SELECT * FROM last)")
def replace_into(spark, d):
    old, new = _stock(spark, d)
    return _rounded(dml.replace_into(old, new.drop("nth"), ["s_suppkey"], order=[F.col("s_acctbal")]))


@query(f"WITH {_NEW} {_ROUNDED} (SELECT o.s_suppkey, coalesce(n.s_nationkey, o.s_nationkey) AS s_nationkey, o.s_acctbal FROM old o LEFT JOIN first n ON o.s_suppkey = n.s_suppkey)")
def update_from(spark, d):
    old, new = _stock(spark, d)
    return _rounded(dml.update_from(old, new, ["s_suppkey"], {"s_nationkey": F.col("new_s_nationkey")}))


@query(f"WITH {_NEW} {_ROUNDED} (SELECT o.s_suppkey, coalesce(n.s_nationkey, o.s_nationkey) AS s_nationkey, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM old o LEFT JOIN first n ON o.s_suppkey = n.s_suppkey AND n.s_acctbal > o.s_acctbal AND n.s_acctbal > 1)")
def update_from_where(spark, d):
    old, new = _stock(spark, d)
    where = (F.col("new_s_acctbal") > F.col("s_acctbal")) & (F.col("new_s_acctbal") > 1) & (F.col("new_nth") == 0)
    return _rounded(dml.update_from(old, new, ["s_suppkey"], {"s_nationkey": F.col("new_s_nationkey"), "s_acctbal": F.col("new_s_acctbal")}, where))


@query(f"WITH {_NEW} SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.s_suppkey = o.s_suppkey AND n.s_acctbal > o.s_acctbal)")
def delete_using(spark, d):
    old, new = _stock(spark, d)
    return dml.delete_using(old, new, ["s_suppkey"], F.col("new_s_acctbal") > F.col("s_acctbal"))


@query(f"""WITH {_NEW} {_ROUNDED} (SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN n.s_nationkey ELSE o.s_nationkey END AS s_nationkey,
  CASE WHEN o.s_suppkey IS NULL THEN n.s_acctbal WHEN n.s_suppkey IS NOT NULL AND n.s_acctbal > 5000 THEN n.s_acctbal ELSE o.s_acctbal END AS s_acctbal
  FROM old o FULL JOIN first n ON o.s_suppkey = n.s_suppkey WHERE o.s_suppkey IS NOT NULL OR n.s_nationkey < 20)""")
def merge_into(spark, d):
    old, new = _stock(spark, d)
    fresh = {"s_nationkey": F.col("new_s_nationkey"), "s_acctbal": F.col("new_s_acctbal")}
    return _rounded(dml.merge_into(old, new.where("nth = 0"), ["s_suppkey"], {"s_acctbal": F.col("new_s_acctbal")}, F.col("new_s_acctbal") > 5000, fresh, F.col("new_s_nationkey") < 20))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 7 FROM region UNION ALL SELECT 900, NULL, NULL UNION ALL SELECT 901, 'x', 2 UNION ALL SELECT -1, NULL, 7")
def insert_forms(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n = dml.insert_into(n, table(spark, d, "region").select("r_name", F.col("r_regionkey") + 100), ["n_name", "n_nationkey"], {"n_regionkey": F.lit(7)})  # INSERT … SELECT
    n = dml.insert_into(n, values(spark, "k int", (900,)))  # VALUES, the first columns
    n = dml.insert_into(n, values(spark, "k int, n string, r int", (901, "x", 2)))
    return dml.insert_into(n, values(spark, "x int", (0,)).select(), [], {"n_nationkey": F.lit(-1), "n_regionkey": F.lit(7)})  # DEFAULT VALUES


@query("""WITH hit AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM hit) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, 'table' AS part FROM orders UNION ALL SELECT o_orderkey, 'X', 'returned' FROM hit""")
def update_first(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after, changed = dml.update_first(o, ["o_orderkey"], {"o_orderstatus": F.lit("X")}, [F.desc("o_totalprice"), F.col("o_orderkey")], 25, F.col("o_orderstatus") == "F")
    return after.withColumn("part", F.lit("table")).union(changed.withColumn("part", F.lit("returned"))).drop("o_totalprice")


@query("""WITH hit AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40)
SELECT o_orderkey, 'table' AS part FROM orders WHERE o_orderkey NOT IN (FROM hit) UNION ALL SELECT o_orderkey, 'returned' FROM hit""")
def delete_first(spark, d):
    after, gone = dml.delete_first(table(spark, d, "orders"), ["o_orderkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 40)
    return after.select("o_orderkey", F.lit("table").alias("part")).union(gone.select("o_orderkey", F.lit("returned")))


_BRANCHES = {"small": "o_totalprice < 50000", "large": "o_totalprice > 20000", "rest": None}


def _routed(spark, d, route) -> DataFrame:
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return route(source, {n: F.expr(c) if c else None for n, c in _BRANCHES.items()}).select("k", "target")


@query("""SELECT o_orderkey AS k, 'small' AS target FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 20000 UNION ALL SELECT o_orderkey, 'rest' FROM orders""")
def insert_all(spark, d):
    return _routed(spark, d, dml.insert_all)


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice > 20000 THEN 'large' ELSE 'rest' END AS target FROM orders")
def insert_first(spark, d):
    return _routed(spark, d, dml.insert_first)


# Tables at rest: COPY, CREATE TABLE AS, partitions, samples


@query("SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def copy_round_trip(spark, d):
    path = scratch_path(spark, "copy")
    T.copy_to(table(spark, d, "customer").select("c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")), path, delimiter=";", null="\\N", header="true")
    return T.copy_from(spark, path, "c_custkey long, c_name string, segment string", delimiter=";", null="\\N", header="true")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def create_table_as(spark, d):
    made = T.create_table_as(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), scratch_path(spark, "orders"), "o_orderstatus")
    return T.partition(made, "o_orderstatus", "F")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 3 > 0")
def partition_dml(spark, d):
    path = scratch_path(spark, "orders")
    made = T.create_table_as(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_orderstatus")
    changed = T.create_table_as(T.partition(made, "o_orderstatus", "F").where("o_custkey % 3 > 0").withColumn("o_custkey", -F.col("o_custkey")), scratch_path(spark, "changed"), "o_orderstatus")
    T.overwrite_partitions(changed, path, "o_orderstatus")
    return spark.read.schema(made.schema).parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT p_partkey, p_name, p_size, nullif(p_brand, 'Brand#11') AS brand FROM part")
def json_export(spark, d):
    path = scratch_path(spark, "json")
    T.export(table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("brand")), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int, brand string").json(path)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' WHEN 2 THEN 'GB18030' ELSE 'UTF-8' END AS encoding, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE p_name || ' 喆镕—名' END AS text FROM part")
def decoded_bytes(spark, d):
    k, text = F.col("p_partkey") % 4, F.concat("p_name", F.lit(" 喆镕—名"))
    content = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k == 2, F.unhex(F.concat(F.hex("p_name"), F.lit("2086B4E946A1AAC3FB")))).otherwise(F.encode("p_name", "UTF-8"))
    return table(spark, d, "part").select("p_partkey", T.decoded(content).alias("r")).select("p_partkey", "r.encoding", "r.text")


@query("SELECT s_suppkey, CAST(100 + 5 * (row_number() OVER () - 1) AS BIGINT) AS id FROM supplier")
def sequence_values(spark, d):
    return T.nextval(table(spark, d, "supplier").select("s_suppkey"), "id", 100, 5)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || '17'), 1, 8) < '1999999a'")
def table_sample(spark, d):
    return R.sampled(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 10.0000000001, 17, "o_orderkey")


# Events over time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return E.windowed_counts(table(spark, d, "events"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, nth""")
def session_windows(spark, d):
    return E.sessions(table(spark, d, "events"))


# SQL texts as data: a script for each order, by a template that its key names

#: Script, and for each of its statements: text, category, fingerprint, findings,
#: tables. {k} {c} {p} {s} {y} stand for key, customer, price, status, priority.
SCRIPTS = [
    ("SELECT * FROM orders o WHERE o.o_totalprice > {p}; -- {y}; really\nDELETE FROM lineitem;", [
        ("SELECT * FROM orders o WHERE o.o_totalprice > {p}", "DQL", "select * from orders o where o.o_totalprice > ?", "select-star", "orders"),
        ("DELETE FROM lineitem", "DML", "delete from lineitem", "no-where", "lineitem"),
    ]),
    ("select o_orderkey from orders where upper(o_orderstatus) = '{s};x' or o_custkey = {c} order by 1", [
        ("select o_orderkey from orders where upper(o_orderstatus) = '{s};x' or o_custkey = {c} order by 1", "DQL", "select o_orderkey from orders where upper(o_orderstatus) = ? or o_custkey = ? order by ?", "function-on-column or-in-where order-by-ordinal", "orders"),
    ]),
    ("INSERT INTO nation VALUES ({k}, 'it''s; {y}', 2);\n\ninsert into nation values ({c},\n  'b', 4.5e3)", [
        ("INSERT INTO nation VALUES ({k}, 'it''s; {y}', 2)", "DML", "insert into nation values (?)", "insert-without-columns", "nation"),
        ("insert into nation values ({c}, 'b', 4.5e3)", "DML", "insert into nation values (?)", "insert-without-columns", "nation"),
    ]),
    ("UPDATE supplier SET s_acctbal = 0 /* why; /* {y} */ 'ever */ WHERE s_suppkey = #{id} AND s_name <> ${name}", [
        ("UPDATE supplier SET s_acctbal = 0 WHERE s_suppkey = #{id} AND s_name <> ${name}", "DML", "update supplier set s_acctbal = ? where s_suppkey = #{id} and s_name <> ${name}", "negative-comparison text-substitution", "supplier"),
    ]),
    ("SELECT /*+ leading(a b) hashjoin(a) */ a.n_name FROM nation a JOIN region b WHERE a.n_name LIKE '%{y}' LIMIT 3;\nSELECT /*+ Full(c_{k}) nestloop(a) */ c_name FROM customer c WHERE c_custkey = $1", [
        ("SELECT a.n_name FROM nation a JOIN region b WHERE a.n_name LIKE '%{y}' LIMIT 3", "DQL", "select a.n_name from nation a join region b where a.n_name like ? limit ?", "leading-wildcard join-without-on limit-without-order", "nation region"),
        ("SELECT c_name FROM customer c WHERE c_custkey = $1", "DQL", "select c_name from customer c where c_custkey = $1", "", "customer"),
    ]),
    ("SELECT n_name FROM nation UNION SELECT r_name FROM region; COMMIT;; GRANT SELECT ON nation TO public;", [
        ("SELECT n_name FROM nation UNION SELECT r_name FROM region", "DQL", "select n_name from nation union select r_name from region", "union-not-all", "nation region"),
        ("COMMIT", "TCL", "commit", "", ""),
        ("GRANT SELECT ON nation TO public", "DCL", "grant select on nation to public", "", ""),
    ]),
    ("SELECT \"from;\", 'on or {y}' AS x FROM \"x--{k}\" WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_name = NULL) AND b = E'\\'; or {s}'; VALUES (1)", [
        ("SELECT \"from;\", 'on or {y}' AS x FROM \"x--{k}\" WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_name = NULL) AND b = E'\\'; or {s}'", "DQL", "select \"from;\", ? as x from \"x--{k}\" where c_custkey not in (select c_custkey from customer where c_name = null) and b = ?", "not-in-subquery null-comparison", "\"x--{k}\" customer"),
        ("VALUES (1)", "DQL", "values (?)", "", ""),
    ]),
    ("MERGE INTO part USING supplier ON (p_partkey = s_suppkey) WHEN MATCHED THEN UPDATE SET p_size = {c}; {? = call total({k})}", [
        ("MERGE INTO part USING supplier ON (p_partkey = s_suppkey) WHEN MATCHED THEN UPDATE SET p_size = {c}", "DML", "merge into part using supplier on (p_partkey = s_suppkey) when matched then update set p_size = ?", "merge-used", "part supplier"),
        ("{? = call total({k})}", "OTHER", "{? = call total(?)}", "", ""),
    ]),
    ("CREATE FUNCTION f_{k}() RETURNS int AS $body$ BEGIN -- {y}\n DELETE FROM part; RETURN {c}; END $body$ LANGUAGE plpgsql; SELECT f_{k}()", [
        ("CREATE FUNCTION f_{k}() RETURNS int AS $body$ BEGIN -- {y}\n DELETE FROM part; RETURN {c}; END $body$ LANGUAGE plpgsql", "DDL", "create function f_{k}() returns int as ? language plpgsql", "", ""),
        ("SELECT f_{k}()", "DQL", "select f_{k}()", "", ""),
    ]),
    ("BEGIN\n IF {c} > 5 THEN DELETE FROM part WHERE p_partkey = {k}; END IF;\n COMMIT;\nEND;\n/\nSELECT a.x FROM orders a, lineitem AS b, (SELECT 1) c WHERE EXTRACT(year FROM o_orderdate) = 1995", [
        ("BEGIN IF {c} > 5 THEN DELETE FROM part WHERE p_partkey = {k}; END IF; COMMIT; END", "PLSQL", "begin if ? > ? then delete from part where p_partkey = ?; end if; commit; end", "commit-in-block", "part"),
        ("SELECT a.x FROM orders a, lineitem AS b, (SELECT 1) c WHERE EXTRACT(year FROM o_orderdate) = 1995", "DQL", "select a.x from orders a, lineitem as b, (select ?) c where extract(year from o_orderdate) = ?", "", "orders lineitem"),
    ]),
    ("WITH recent AS (SELECT o_orderkey FROM orders WHERE o_custkey = {c}), big AS (SELECT 2) INSERT INTO t_{k} (a) SELECT o_orderkey FROM recent r, big", [
        ("WITH recent AS (SELECT o_orderkey FROM orders WHERE o_custkey = {c}), big AS (SELECT 2) INSERT INTO t_{k} (a) SELECT o_orderkey FROM recent r, big", "DML", "with recent as (select o_orderkey from orders where o_custkey = ?), big as (select ?) insert into t_{k} (a) select o_orderkey from recent r, big", "", "orders t_{k}"),
    ]),
    ("BEGIN; SELECT DISTINCT a.o_custkey, count(*) AS n FROM orders a WHERE a.o_clerk = a.o_custkey AND o_totalprice BETWEEN {p} AND {p} GROUP BY a.o_custkey ORDER BY o_orderdate OFFSET 5; ROLLBACK; EXPLAIN SELECT now()", [
        ("BEGIN", "TCL", "begin", "", ""),
        ("SELECT DISTINCT a.o_custkey, count(*) AS n FROM orders a WHERE a.o_clerk = a.o_custkey AND o_totalprice BETWEEN {p} AND {p} GROUP BY a.o_custkey ORDER BY o_orderdate OFFSET 5", "DQL", "select distinct a.o_custkey, count(*) as n from orders a where a.o_clerk = a.o_custkey and o_totalprice between ? and ? group by a.o_custkey order by o_orderdate offset ?",
         "same-table-compare equal-range count-star distinct-used group-by-used order-by-not-distinct order-by-not-grouped offset-used", "orders"),
        ("ROLLBACK", "TCL", "rollback", "", ""),
        ("EXPLAIN SELECT now()", "EXPLAIN", "explain select now()", "explain-used current-time", ""),
    ]),
]
_MARKS = {"{k}": "CAST(o_orderkey AS VARCHAR)", "{c}": "CAST(o_custkey AS VARCHAR)", "{p}": "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)", "{s}": "o_orderstatus", "{y}": "o_orderpriority"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(text: str) -> str:
    """SQL that puts an order's values into a template."""
    for mark, value in _MARKS.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


_SPEC = ",\n  ".join(f"({t}, {n}, {', '.join(map(_quoted, x))})" for t, (_, rows) in enumerate(SCRIPTS) for n, x in enumerate(rows, 1))
_STATEMENTS = f"""spec(t, nth, statement, category, fingerprint, codes, tables) AS (VALUES {_SPEC}),
stmt AS (SELECT o_orderkey AS id, CAST(nth AS INTEGER) AS nth, {_filled('statement')} AS statement, category, {_filled('fingerprint')} AS normalised, codes, {_filled('tables')} AS tables FROM orders JOIN spec ON o_orderkey % {len(SCRIPTS)} = t)"""
_LEVELS = ", ".join(f"({_quoted(code)}, {_quoted(level)})" for code, level in [*((r.code, r.level) for r in S.LINT_RULES), *S.COLUMN_RULES])
_FOUND = f"found AS (SELECT id, nth, code, level FROM (SELECT id, nth, unnest(string_split(codes, ' ')) AS code FROM stmt) JOIN (VALUES {_LEVELS}) AS l(code, level) USING (code))"


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows in as many parts as there are tasks: texts made from them are much
    larger and dearer than the rows, which may lie in a single part of a file."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def _part_keys(spark, d) -> DataFrame:
    return _spread(table(spark, d, "part").select("p_partkey"), "p_partkey")


def _scripts(spark, d) -> DataFrame:
    orders = _spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    text = F.element_at(F.array(*(F.lit(script) for script, _ in SCRIPTS)), (F.col("o_orderkey") % len(SCRIPTS) + 1).cast("int"))
    values = {"{k}": F.col("o_orderkey").cast("string"), "{c}": F.col("o_custkey").cast("string"), "{p}": F.floor("o_totalprice").cast("string"), "{s}": F.col("o_orderstatus"), "{y}": F.col("o_orderpriority")}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return orders.select(F.col("o_orderkey").alias("id"), text.alias("sql"))


def _statements(spark, d) -> DataFrame:
    return S.statements(_scripts(spark, d)).drop("sql")


@query(f"WITH {_STATEMENTS} SELECT id, nth, statement FROM stmt")
def sql_statements(spark, d):
    return _statements(spark, d)


@query(f"WITH {_STATEMENTS} SELECT category, count(*) AS n FROM stmt GROUP BY category")
def sql_categories(spark, d):
    return _statements(spark, d).groupBy(S.category(F.col("statement")).alias("category")).count().withColumnRenamed("count", "n")


@query(f"WITH {_STATEMENTS} SELECT normalised, count(*) AS n, min(id) AS first_place, sha256(normalised) AS fingerprint FROM stmt GROUP BY normalised")
def sql_fingerprints(spark, d):
    return S.fingerprints(_statements(spark, d), "statement", "id")


@query(f"WITH {_STATEMENTS}, {_FOUND} SELECT * FROM found")
def sql_lint(spark, d):
    return S.lint(_statements(spark, d), "statement").drop("statement")


@query(f"WITH {_STATEMENTS}, {_FOUND} SELECT level, code, count(*) AS n FROM found GROUP BY level, code")
def sql_lint_summary(spark, d):
    return S.lint_summary(S.lint(_statements(spark, d), "statement"))


@query(f"WITH {_STATEMENTS} SELECT * FROM (SELECT id, nth, unnest(string_split(tables, ' ')) AS table_name FROM stmt) WHERE table_name <> ''")
def sql_table_names(spark, d):
    return S.table_names(_statements(spark, d), "statement").drop("statement")


#: Tokens of a text and their kinds; @ stands for the part's key.
TOKENS = [
    ("SELECT", "word"), ("p_@$x", "word"), (",", "operator"), ("'it''s; @'", "string"), ('"q "" -- @"', "quoted"), ("4.5e3", "number"), ("<>", "operator"), ("#{id@}", "parameter"), ("$1", "parameter"), ("$t$ b; $$ $t$", "body"), ("/* c /* @ */ */", "comment"), ("::", "operator"), ("E'\\'x'", "string"), ("`t;@`", "quoted"), ("@", "number"), (".5", "number"), ("(", "operator"), ("-- end", "comment"),
]


@query(f"""SELECT p_partkey AS id, CAST(nth AS INTEGER) AS nth, replace(token, '@', CAST(p_partkey AS VARCHAR)) AS token, kind FROM part, (VALUES {", ".join(f"({n}, {_quoted(t)}, {_quoted(k)})" for n, (t, k) in enumerate(TOKENS, 1))}) v(nth, token, kind)""")
def sql_tokens(spark, d):
    text = F.replace(F.lit(" ".join(t for t, _ in TOKENS)), F.lit("@"), F.col("p_partkey").cast("string"))
    return S.tokens(_part_keys(spark, d).select(F.col("p_partkey").alias("id"), text.alias("sql"))).drop("sql")


def _from_templates(columns: str, *rows: tuple) -> str:
    """SQL for what the scripts of some templates are to give."""
    spec = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, bool)) else _quoted(v) for v in r) + ")" for r in rows)
    names = columns.split(", ")
    cols = ", ".join(f"{_filled(n)} AS {n}" if isinstance(v, str) else n for n, v in zip(names, rows[0][1:]))
    return f"SELECT o_orderkey AS id, {cols} FROM orders JOIN (VALUES {spec}) v(t, {columns}) ON o_orderkey % {len(SCRIPTS)} = t"


@query(_from_templates("nth, comment, inside_body", (0, 1, "-- {y}; really", False), (3, 1, "/* why; /* {y} */ 'ever */", False), (4, 1, "/*+ leading(a b) hashjoin(a) */", False), (4, 2, "/*+ Full(c_{k}) nestloop(a) */", False), (8, 1, "-- {y}", True)))
def sql_comments(spark, d):
    return S.comments(_scripts(spark, d)).drop("sql")


@query(_from_templates("nth, parameter, style", (3, 1, "#{id}", "hash"), (3, 2, "${name}", "dollar"), (4, 1, "$1", "numbered"), (7, 1, "?", "question")))
def sql_parameters(spark, d):
    return S.parameters(_scripts(spark, d)).drop("sql")


@query(_from_templates("hint, arguments", (4, "leading", "a b"), (4, "hashjoin", "a"), (4, "full", "c_{k}"), (4, "nestloop", "a")))
def sql_hints(spark, d):
    return S.hints(_scripts(spark, d)).drop("sql")


@query(_from_templates("first_hint, second_hint", (4, "hashjoin", "nestloop")))
def sql_hint_conflicts(spark, d):
    return S.hint_conflicts(_scripts(spark, d)).drop("sql")


@query(_from_templates("call", (7, "CALL total({k})")))
def sql_jdbc_calls(spark, d):
    return _statements(spark, d).where(F.col("statement").contains("{?")).select("id", S.jdbc_calls(F.col("statement")).alias("call"))


@query(_from_templates("transaction, first_place, last_place, n, ended", (5, 1, 1, 2, 1, "commit"), (5, 2, 3, 3, 1, "open"), (11, 1, 1, 3, 1, "rollback"), (11, 2, 4, 4, 1, "open"),
  (0, 1, 1, 2, 2, "open"), (1, 1, 1, 1, 1, "open"), (2, 1, 1, 2, 2, "open"), (3, 1, 1, 1, 1, "open"), (4, 1, 1, 2, 2, "open"), (6, 1, 1, 2, 2, "open"), (7, 1, 1, 2, 2, "open"), (8, 1, 1, 2, 2, "open"), (9, 1, 1, 2, 1, "open"), (10, 1, 1, 1, 1, "open")))
def sql_transactions(spark, d):
    return S.transactions(_statements(spark, d))


@query("""SELECT p_partkey AS id, function, CAST(n AS INTEGER) AS n_arguments, finding FROM part, (VALUES (0, 'nvl', 1, 'requires exactly 2'), (0, 'substr', 1, 'requires at least 2'), (1, 'bit_and', 2, 'requires exactly 1'), (1, 'now', 1, 'takes no arguments'), (1, 'instr', 5, 'takes at most 4')) v(t, function, n, finding) WHERE p_partkey % 3 = t""")
def sql_function_arity(spark, d):
    texts = ["SELECT nvl(upper(p_name)), SUBSTR ( a ), coalesce(a, (b + c), f(1, 2)) FROM t WHERE x IN (1, 2) AND y = 'nvl(1)'", "SELECT dbe_raw.bit_and(a, b), now(1), instr(a, b, 1, greatest(2, 3), 4) FROM t JOIN u ON (a = b)", "SELECT round(a, 2), mod(length(b), 3), concat(a, b, c, d), nvl2(a, b, c) /* nvl(1) */ FROM t"]
    sql = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return S.arity_findings(_part_keys(spark, d).select(F.col("p_partkey").alias("id"), sql.alias("sql"))).drop("sql")


@query("""SELECT p_partkey AS id, '"T;' || p_partkey || '"' AS table_name, CAST(place AS INTEGER) AS place, column_name, type FROM part,
  (VALUES (1, 'id', 'integer'), (2, 'price', 'numeric(10,2)'), (3, '"Odd, one"', 'varchar(20)'), (4, 'at', 'timestamp with time zone')) v(place, column_name, type)""")
def sql_table_columns(spark, d):
    ddl = F.concat(F.lit('CREATE UNLOGGED TABLE IF NOT EXISTS "T;'), F.col("p_partkey").cast("string"), F.lit('" (id INTEGER PRIMARY KEY, -- the id, or so\n price numeric(10, 2) NOT NULL, "Odd, one" varchar(20) DEFAULT \'a,b\', At timestamp with time zone, CONSTRAINT c UNIQUE (id, price)) WITH (x = 1)'))
    return S.table_columns(_part_keys(spark, d).select(F.col("p_partkey").alias("id"), ddl.alias("sql")))


@query("""SELECT 'p_' || s_suppkey AS package, 'procedure' AS kind, 'a' AS routine, CAST(1 AS INTEGER) AS n_parameters, 'missing in body' AS fault FROM supplier UNION ALL SELECT 'p_' || s_suppkey, 'procedure', 'a', 2, 'private' FROM supplier
  UNION ALL SELECT 'p_' || s_suppkey, 'function', 'f_' || (s_suppkey % 3), 0, 'private' FROM supplier WHERE s_suppkey % 3 > 0""")
def sql_package_mismatches(spark, d):
    k = F.col("s_suppkey").cast("string")
    spec = F.concat(F.lit("CREATE PACKAGE p_"), k, F.lit(" AS PROCEDURE A(x int); FUNCTION f_0 RETURN int; END"))
    body = F.concat(F.lit("CREATE OR REPLACE PACKAGE BODY p_"), k, F.lit(" IS FUNCTION f_0 RETURN int IS BEGIN RETURN 1; END; PROCEDURE a(x int, y int) IS BEGIN NULL; END; FUNCTION f_"), (F.col("s_suppkey") % 3).cast("string"), F.lit(" RETURN int IS BEGIN RETURN 1; -- PROCEDURE no\n END; END"))
    return S.package_mismatches(S.routines(_spread(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("id"), F.explode(F.array(spec, body)).alias("sql"))))


@query("""SELECT p_partkey AS id, kind, statement_id, replace(sql, '@', CAST(p_partkey AS VARCHAR)) AS sql FROM part, (VALUES ('select', 'one', 'SELECT n_name, a@ FROM nation n_nationkey < #{@}'), ('delete', 'two', 'DELETE FROM nation WHERE n_nationkey > @ AND n_name = ''"''')) v(kind, statement_id, sql)""")
def mapper_statements(spark, d):
    k = F.col("p_partkey").cast("string")
    xml = F.concat(F.lit('<mapper namespace="m"><!-- <select id="no">SELECT 1</select> --><sql id="cols">n_name, <include refid = "more"></include></sql><sql id=\'more\'>a'), k, F.lit('</sql><select id="one">SELECT <include refid="cols"/> FROM nation <where><if test="k != null">n_nationkey &lt; #{'), k,
                   F.lit("}</if></where></select>\n<delete  id='two'><![CDATA[ DELETE FROM nation\n WHERE n_nationkey > "), k, F.lit(" ]]>AND n_name = '&quot;'</delete></mapper>"))
    return S.mapper_statements(_part_keys(spark, d).select(F.col("p_partkey").alias("id"), xml.alias("content"))).drop("content")


@query("""SELECT p_partkey AS id, CAST(nth AS INTEGER) AS nth, replace(sql, '{k}', CAST(p_partkey AS VARCHAR)) AS sql FROM part, (VALUES (1, 'SELECT a FROM t{k} WHERE "x" = 1'), (2, 'delete from t where b = ''+'' || "+"'), (3, 'UPDATE t SET a = {k}')) v(nth, sql)""")
def java_statements(spark, d):
    k = F.col("p_partkey").cast("string")
    java = F.concat(F.lit('class A { // "select no"\n char c = \'"\'; String s = "SELECT a " + /* x */ "FROM t'), k, F.lit(' WHERE \\"x\\" = 1"; String t = "not sql";\n String u = "delete from t" +\n "\\n where b = \'+\' || \\"+\\""; String v = """\n    UPDATE t\n    SET a = '), k, F.lit('""" ; }'))
    return S.java_statements(_part_keys(spark, d).select(F.col("p_partkey").alias("id"), java.alias("content"))).drop("content")


# Whole analytical queries


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, d):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
  WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""")
def local_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sold = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    bought = sold.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return bought.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey HAVING sum(l_quantity) > 150""")
def large_orders(spark, d):
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).where("quantity > 150")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.round("quantity", 2).alias("quantity"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(spark, d):
    return table(spark, d, "lineitem").where("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
