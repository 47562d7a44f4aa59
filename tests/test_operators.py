"""Operators on small tables: nulls, ties, empty inputs, errors."""

import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import dialect as D
from sparkloom.operators import dml
from sparkloom.operators import relational as R
from sparkloom.plans import queries as Q
from sparkloom.plans import sql_texts as S
from sparkloom.sources import tables as T
from sparkloom.streaming import events as E


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fetch_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 7), (5, None)], "id int, v int")
    assert [r[0] for r in rows(R.fetch_first(df, 1, [("v", False)], with_ties=True))] == [1, 3]
    assert [r[0] for r in rows(R.fetch_first(df, 1, [("v", True)], with_ties=True))] == [2, 5]  # nulls first
    assert len(rows(R.fetch_first(df, 99, [("v", True)], with_ties=True))) == 5
    assert rows(R.fetch_first(df, 0, [("v", True)], with_ties=True)) == []
    assert rows(R.fetch_first(df.limit(0), 3, [("v", True)], with_ties=True)) == []
    with pytest.raises(ValueError):
        R.fetch_first(df, 1, [("v", True)], with_ties=True, offset=1)


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("right", [[], [None], [1], [1, 2], [1, None], [2, 2, None]])
def test_quantified_three_valued(spark, op, every, right):
    def compare(x, y):
        if x is None or y is None:
            return None
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def expected(x):
        found = [compare(x, y) for y in right]
        decisive = not every
        return decisive if decisive in found else None if None in found else every

    left = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "x int")
    out = R.quantified(left, "x", op, spark.createDataFrame([(v,) for v in right], "y int"), every, "r")
    assert {r["x"]: r["r"] for r in out.collect()} == {x: expected(x) for x in (0, 1, 2, 3, None)}


def test_connect_by_loops(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (1, 2)], "id int, up int")
    assert len(rows(R.connect_by(df, F.col("up").isNull(), "id", "up", nocycle=True))) == 2
    with pytest.raises(Exception, match="CONNECT BY loop"):
        R.connect_by(df, F.col("up").isNull(), "id", "up")
    assert rows(R.connect_by(df, F.col("id") == 99, "id", "up")) == []


def test_recursion_stops(spark):
    with pytest.raises(ValueError):
        R.recursive_union(spark.createDataFrame([(1,)], "n int"), lambda t: t, max_rounds=3)
    assert rows(R.recursive_union(spark.createDataFrame([(1,)], "n int"), lambda t: t, distinct=True)) == [(1,)]


def test_windows_joined_back(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), ("c", 1), ("c", 2), (None, 4), (None, 4)], "g string, v int")
    n = R.with_count_distinct(df, "v", "n", "g")
    assert sorted({(r["g"] or "", r["n"]) for r in n.collect()}) == [("", 1), ("a", 1), ("b", 0), ("c", 2)] and n.count() == 8
    shares = R.with_ratio_to_report(df, "v", "r", "g").collect()
    assert sorted((r["g"] or "", r["r"] or 0) for r in shares) == [("", 0.5), ("", 0.5), ("a", 0), ("a", 0.5), ("a", 0.5), ("b", 0), ("c", 1 / 3), ("c", 2 / 3)]
    assert R.with_ratio_to_report(df, "v", "r").where("v = 2").first()["r"] == 2 / 13


def test_ranks_of_large_partitions(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 2, 3, None]), k) for k in range(300)]
    df = spark.createDataFrame(data, "g string, v int, k int")
    w, u = W.partitionBy("g").orderBy(F.col("v").asc_nulls_last()), W.partitionBy("g").orderBy(F.col("v").desc_nulls_first(), F.col("k").asc_nulls_last())
    plain = df.select("k", F.rank().over(w), F.dense_rank().over(w), F.percent_rank().over(w), F.cume_dist().over(w), F.row_number().over(u), F.ntile(7).over(u), F.count("*").over(W.partitionBy("g")))
    own = R.with_row_number(R.with_ranks(df, ["g"], [("v", False)]), ["g"], [("v", True), ("k", False)], size="n")
    own = own.select("k", "rank", "dense_rank", "percent_rank", "cume_dist", "row_number", R.ntile(F.col("row_number"), F.col("n"), 7), "n")
    assert rows(own) == rows(plain)
    for n in (1, 3, 200):
        tiles = spark.range(1, 101).select("id", R.ntile(F.col("id"), F.lit(100), n).alias("t"), F.ntile(n).over(W.orderBy("id")).cast("long").alias("u"))
        assert tiles.where("t <> u").count() == 0
    assert rows(R.with_rownum(df.repartition(7)).select("rownum")) == sorted([(k,) for k in range(1, 301)], key=str)


def test_range_join_of_wide_ranges(spark):
    rng = random.Random(6)
    points = [(k, rng.randrange(10**9)) for k in range(200)] + [(900, 5), (901, 0)]
    ranges = [(k, lo, lo + rng.choice([0, 1, 9, 1000, 10**6, 10**9])) for k in range(60) for lo in [rng.randrange(10**9)]] + [(99, 0, 10**9), (98, 5, 6), (97, 7, 3)]
    left, right = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(ranges, "r long, lo long, hi long")
    found = rows(R.range_join(left, right, "at", "lo", "hi", 8).select("p", "r"))
    assert found == sorted([(p, r) for p, at in points for r, lo, hi in ranges if lo <= at < hi], key=str)
    assert rows(R.range_join(left, right.limit(0), "at", "lo", "hi", 8)) == []


def test_asof_join_of_a_hot_key(spark):
    rng = random.Random(7)
    left = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), k) for k in range(200)]
    right = [(k, t, f"{k}{t}") for k, t in {(rng.choice(["a", "b", "c", None]), rng.randrange(50)) for _ in range(40)}] + [("b", None, "x")]
    found = rows(R.asof_join(spark.createDataFrame(left, "k string, t int, n int"), spark.createDataFrame(right, "k string, t int, v string"), "k", "t", ["v"]))
    last = lambda k, t: max(((u, v) for j, u, v in right if j == k and u is not None and t is not None and u <= t), default=(0, None))[1] if k else None
    assert found == sorted([(k, t, n, last(k, t)) for k, t, n in left], key=str)


def test_plus_joins(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "x int, v int"), spark.createDataFrame([(1, 9), (3, 8)], "y int, w int")
    assert rows(R.plus_join(a, b, [("x", "=", R.Outer("y"))]).select("x", "y")) == sorted([(1, 1), (2, None), (None, None)], key=str)
    assert rows(R.plus_join(a, b, [(R.Outer("x"), "=", "y")]).select("x", "y")) == sorted([(1, 1), (None, 3)], key=str)
    assert rows(R.plus_join(a, b, [("x", "=", "y")]).select("x", "y")) == [(1, 1)]
    with pytest.raises(ValueError):
        R.plus_join(a, b, [("x", "=", R.Outer("y")), (R.Outer("v"), "=", "w")])


def test_merge_refuses_key_updates(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        dml.merge_into(df, df, ["k"], {"k": F.lit(1)})


def test_repeated_source_keys(spark):
    """Target {1, 2}, a source with keys 1 and 3 twice: nothing is multiplied, and MERGE refuses."""
    old = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "k int, v int")
    new = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (None, 6)], "k int, v int")
    assert rows(dml.update_from(old, new, ["k"], {"v": F.col("new_v")})) == sorted([(1, 1), (2, 20), (None, 5)], key=str)
    assert rows(dml.update_from(old, new, ["k"], {"v": F.col("new_v")}, F.col("new_v") > 1)) == sorted([(1, 2), (2, 20), (None, 5)], key=str)
    assert rows(dml.replace_into(old, new, ["k"])) == sorted([(1, 2), (2, 20), (3, 4), (None, 5), (None, 6)], key=str)
    assert rows(dml.upsert(old, new, ["k"], {"v": F.col("v") + F.col("new_v")})) == sorted([(1, 13), (2, 20), (3, 7), (None, 5), (None, 6)], key=str)
    assert rows(dml.delete_using(old, new, ["k"])) == sorted([(2, 20), (None, 5)], key=str)
    for merged in ({"matched": {"v": F.col("new_v")}}, {"insert": {"v": F.col("new_v")}}):
        with pytest.raises(Exception, match="several source rows"):
            dml.merge_into(old, new, ["k"], **merged).collect()
    assert rows(dml.merge_into(old, new.where("v IN (2, 3, 6)"), ["k"], {"v": F.col("new_v")}, insert={"v": F.col("new_v")})) == sorted([(1, 2), (2, 20), (3, 3), (None, 5), (None, 6)], key=str)
    with pytest.raises(ValueError):
        dml.insert_into(old, new, ["k"])


def test_update_with_null_condition(spark):
    old = spark.createDataFrame([(1, 2), (3, 4)], "k int, v int")
    new = spark.createDataFrame([(1, None)], "k int, v int")
    assert rows(dml.update_from(old, new, ["k"], {"v": F.lit(9)}, F.col("new_v") > 0)) == [(1, 2), (3, 4)]


def test_sampling_is_repeatable(spark):
    df = spark.range(2000)
    a, b = rows(R.sampled(df, 10, 7)), rows(R.sampled(df, 10, 7))
    assert a == b and 100 < len(a) < 300
    a, b = rows(R.sampled(df, 10, 7, "id")), rows(R.sampled(df.repartition(5), 10, 7, "id"))
    assert a == b and 100 < len(a) < 300 and rows(R.sampled(df, 10, 8, "id")) != a
    assert R.sampled(df, 100, 1, "id").count() == 2000 and R.sampled(df, 0, 1, "id").count() == 0


def test_functions(spark):
    df = spark.createDataFrame([("abcabc", "", None)], "a string, e string, n string")
    got = df.select(
        D.instr(F.col("a"), "b", 1, 2), D.instr(F.col("a"), "b", 1, 3), D.btrim(F.col("a"), "ac"), D.overlay(F.col("a"), "XX", 2), D.empty_as_null(F.col("e")), D.lnnvl(F.col("n") == "x"), D.similar_to(F.col("a"), "(abc){2}"), D.similar_to(F.col("a"), "ab_"), D.cast_or(F.col("a"), "int", 5), D.cast_or(F.col("n"), "int", 5),
        D.trunc_number(F.lit(-12.789), 1), D.decode(F.col("n"), None, "none", "x"), D.dow(F.lit("2026-11-29").cast("date")),
    ).first()
    assert tuple(got) == (5, 0, "bcab", "aXXabc", None, True, True, False, 5, None, -12.7, "none", 0)


def test_trunc_is_exact(spark):
    long, cents = (1 << 53) + 1, decimal.Decimal("1.15")
    df = spark.createDataFrame([(long, cents, 1.15, -1.15, 1e300, None)], "n long, c decimal(10,2), d double, e double, big double, none double")
    got = df.select(D.trunc_number(F.col("n"), 0, "long"), D.trunc_number(F.col("c"), 2, "decimal(10,2)"), D.trunc_number(-F.col("c"), 1, "decimal(10,2)"), D.trunc_number(F.col("d"), 2), D.trunc_number(F.col("e"), 1), D.trunc_number(F.col("big"), 2), D.trunc_number(F.col("none"), 2)).first()
    assert tuple(got) == (long, cents, decimal.Decimal("-1.10"), 1.15, -1.1, 1e300, None)


def test_more_functions(spark):
    df = spark.createDataFrame([("it's", "a,b,c", "Plain", "2024-01-31", [1, None, 3])], "t string, l string, i string, d string, a array<int>")
    d = F.col("d").cast("date")
    got = df.select(
        D.quote_literal(F.col("t")), D.quote_ident(F.col("i")), D.quote_ident(F.lower("i")), D.find_in_set(F.lit("b"), F.col("l")), D.find_in_set(F.lit("a,b"), F.col("l")), D.insert_text(F.col("t"), 9, 1, "x"), D.insert_text(F.col("t"), 1, 2, ""), D.substr(F.col("i"), 0, 2), D.substr(F.col("i"), -2), D.substr(F.col("i"), 9),
        D.elt(F.lit(3), "a", "b"), D.field(F.lit(None).cast("string"), "a"), D.regexp_substr(F.col("l"), "[a-z]", 3), D.regexp_substr(F.col("l"), "[a-z]", 4), D.regexp_like(F.lit("A\nb"), "a.B", "in"), D.add_months(d, 1).cast("string"), D.iso_dow(d), D.overlap(F.col("a"), F.array(F.lit(None).cast("int"), F.lit(9))), D.contains_all(F.col("a"), F.array(F.lit(3), F.lit(1))),
        D.array_replace(F.col("a"), None, 0), D.json_path(F.lit('{"a b": [1, {"c": "x"}]}'), "a b", 1, "c"), D.xml_element("e", D.xml_text(F.lit("<&")), attributes={"q": F.lit('"'), "n": F.lit(None)}), D.log_base(2, F.lit(8.0)),
    ).first()
    assert tuple(got) == ("'it''s'", '"Plain"', "plain", 2, 0, "it's", "'s", "Pl", "in", None, None, 0, "c", None, True, "2024-02-29", 3, False, True, [1, 0, 3], "x", '<e q="&quot;">&lt;&amp;</e>', pytest.approx(3))


def test_copy_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"x')], "id int, s string")
    T.copy_to(df, str(tmp_path / "csv"), delimiter=",", null="\\N", header="true")
    assert rows(T.copy_from(spark, str(tmp_path / "csv"), "id int, s string", delimiter=",", null="\\N", header="true")) == rows(df)
    made = T.create_table_as(df, str(tmp_path / "t"), "id")
    assert rows(T.partition(made, "id", 2)) == [(2, None)]
    assert "PartitionFilters: [isnotnull(id" in T.partition(made, "id", 2)._jdf.queryExecution().toString()
    (tmp_path / "x.sql").write_text("SELECT 1")
    assert T.text_files(spark, str(tmp_path / "*.sql")).first()["content"] == "SELECT 1"


def test_streams_match_tables(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(folder))
    E.write_stream(E.windowed_counts(E.read_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed, whole = rows(spark.read.parquet(str(tmp_path / "out"))), rows(E.windowed_counts(spark.read.parquet(str(folder))))
    assert streamed and set(streamed) <= set(whole)
    assert rows(E.first_seen(spark.read.parquet(str(folder)), ["user_id"]).select("user_id")) == rows(spark.read.parquet(str(folder)).select("user_id").distinct())


def test_sql_tokens_cover_the_text(spark, sf_dir):
    scripts = Q._scripts(spark, sf_dir)
    texts = {}
    for r in S.tokens(scripts).orderBy("id", "nth").collect():
        texts[r["id"]] = texts.get(r["id"], "") + "".join(r["token"].split())
    assert texts == {r["id"]: "".join(r["sql"].split()) for r in scripts.collect()}


def test_sql_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ; ;"), (4, "-- only"), (5, "/* not closed"), (6, "'not closed"), (7, "$$ not closed"), (8, '"'), (9, "END; END")], "id int, sql string")
    for f in (S.statements, S.tokens, S.comments, S.lint, S.table_names, S.parameters, S.hints, S.hint_conflicts, S.table_columns, S.routines, S.fingerprints):
        f(df).collect()
    assert {r["id"] for r in S.statements(df).collect()} == {6, 7, 8, 9}


def test_hints_of_all_statements(spark):
    script = "SELECT /*+ LEADING(a b) */ 1; SELECT /*+ full(c) parallel(c, 4) */ 2 UNION SELECT /*+\n no_merge */ 3 /* plain */; SELECT /*+ leading(a b) */ '/*+ no(x) */'"
    rows = spark.createDataFrame([(1, script), (2, "SELECT 1 /* x */"), (3, None)], "id int, sql string")
    found = sorted((r["id"], r["hint"], r["arguments"]) for r in S.hints(rows).collect())
    assert found == [(1, "full", "c"), (1, "leading", "a b"), (1, "leading", "a b"), (1, "no_merge", ""), (1, "parallel", "c, 4")]


LONG = {
    "literal": "SELECT '" + "x''y" * 260_000 + "' FROM t; SELECT 2",
    "body": "CREATE FUNCTION f() AS $$ " + "begin; 'x end " * 75_000 + "$$ LANGUAGE x; SELECT 2",
    "comment": "SELECT 1 /* " + "a /* b; */ " * 95_000 + "*/; SELECT 2",
    "quoted": 'SELECT "' + "a;" * 500_000 + '"; SELECT 2',
    "rows": "INSERT INTO t VALUES " + "(1, 'abc', 2.5), " * 60_000 + "(1); SELECT 2",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_texts_of_a_megabyte(spark, name):
    df = spark.createDataFrame([(1, LONG[name])], "id int, sql string")
    found = S.statements(df).collect()
    assert len(found) == 2 and found[1]["statement"] == "SELECT 2"
    for f in (S.tokens, S.comments, S.lint, S.table_names, S.parameters, S.hints, S.fingerprints):
        assert f(df).count() >= 0
    java = spark.createDataFrame([('class A { String s = "select ' + "a\\n" * 250_000 + '"; }',)], "content string")
    assert S.java_statements(java).count() == 1


def cut(spark, script):
    return [r["statement"] for r in S.statements(spark.createDataFrame([(1, script)], "id int, sql string")).orderBy("nth").collect()]


def test_cuts(spark):
    assert cut(spark, "SELECT 1;;; SELECT 2;;") == ["SELECT 1", "SELECT 2"]
    assert cut(spark, "BEGIN SELECT 1; END;\nSELECT 2;") == ["BEGIN SELECT 1; END", "SELECT 2"]
    assert cut(spark, "BEGIN; SELECT 1; END; BEGIN TRANSACTION; COMMIT") == ["BEGIN", "SELECT 1", "END", "BEGIN TRANSACTION", "COMMIT"]
    assert cut(spark, 'SELECT "a;b" FROM "x--y"; SELECT `c;d`') == ['SELECT "a;b" FROM "x--y"', "SELECT `c;d`"]
    assert cut(spark, "/* a /* b */ c; */ SELECT 1") == ["SELECT 1"]
    assert cut(spark, "CREATE FUNCTION f() RETURNS INTEGER AS $x$ BEGIN; $$ ; END $x$ LANGUAGE plpgsql /\nSELECT a$b$c, d$b$e; SELECT '\u0001;'") == ["CREATE FUNCTION f() RETURNS INTEGER AS $x$ BEGIN; $$ ; END $x$ LANGUAGE plpgsql / SELECT a$b$c, d$b$e", "SELECT '\u0001;'"]
    routine = "CREATE OR REPLACE PROCEDURE p(a int) AS v int; BEGIN IF a > 1 THEN v := CASE a WHEN 2 THEN 3 END; ELSE FOR i IN 1..3 LOOP NULL; END LOOP; END IF; EXCEPTION WHEN OTHERS THEN NULL; END"
    assert cut(spark, routine + ";\n/\nSELECT 2") == [routine, "SELECT 2"]
    package = "CREATE PACKAGE BODY q IS PROCEDURE a IS BEGIN NULL; END; FUNCTION b RETURN int IS x int; BEGIN BEGIN RETURN 1; END; END b; END q"
    assert cut(spark, package + "; DROP TABLE IF EXISTS t; DECLARE c CURSOR FOR SELECT 1; SELECT E'\\';', 2") == [package, "DROP TABLE IF EXISTS t", "DECLARE c CURSOR FOR SELECT 1", "SELECT E'\\';', 2"]
    assert cut(spark, "DECLARE x int; BEGIN x := 1; END; SELECT 1") == ["DECLARE x int; BEGIN x := 1; END", "SELECT 1"]


def findings(spark, sql):
    return {r["code"] for r in S.lint(spark.createDataFrame([(1, sql)], "id int, sql string")).collect()}


def test_lint_ignores_words_in_literals(spark):
    found = findings(spark, "SELECT t.a FROM t JOIN u WHERE s = 'on' AND b LIKE 'or where'")
    assert found == {"join-without-on"}
    assert findings(spark, "SELECT a FROM t WHERE b LIKE E'%x' AND \"or\" = 1") == {"leading-wildcard"}
    assert findings(spark, "select 1 from t -- where a or b <> 1") == set()


@pytest.mark.parametrize(
    "sql, distinct, grouped",
    [
        ("SELECT DISTINCT a AS x FROM t ORDER BY x", False, False), ("SELECT DISTINCT a, b FROM t ORDER BY a", False, False), ("SELECT DISTINCT a FROM t ORDER BY b", True, False), ("SELECT a FROM t ORDER BY b", False, False), ("SELECT DISTINCT a, b FROM t ORDER BY 3", True, False), ("SELECT DISTINCT a, b FROM t ORDER BY 1", False, False),
        ("SELECT DISTINCT t.*, t.a FROM t ORDER BY b", False, False), ("SELECT DISTINCT * FROM t ORDER BY a", False, False), ("SELECT a AS x, b FROM t GROUP BY a, b ORDER BY x", False, False), ("SELECT a FROM t GROUP BY a ORDER BY b", False, True), ("SELECT a FROM t1 GROUP BY a, b ORDER BY b", False, False),
        ("SELECT a, b, c FROM t GROUP BY a, b, c ORDER BY a, b DESC, c", False, False), ("SELECT a, b FROM t GROUP BY a, b ORDER BY a, c", False, True), ("SELECT a, b FROM t GROUP BY a, b ORDER BY 2", False, False), ("SELECT * FROM t GROUP BY a ORDER BY b", False, False),
    ],
)
def test_order_by_what_is_selected(spark, sql, distinct, grouped):
    found = findings(spark, sql)
    assert ("order-by-not-distinct" in found, "order-by-not-grouped" in found) == (distinct, grouped)


def test_lint_of_counts(spark):
    assert "long-in-list" in findings(spark, f"SELECT a FROM t WHERE b IN ({', '.join(map(str, range(501)))})")
    assert "long-in-list" not in findings(spark, f"SELECT a FROM t WHERE b IN ({', '.join(map(str, range(500)))})")
    assert "many-sort-columns" in findings(spark, f"SELECT a FROM t ORDER BY {', '.join(f'c{k}' for k in range(11))}")
    assert {"scalar-subquery", "deep-subqueries"} <= findings(spark, "SELECT (SELECT 1 FROM u) FROM t WHERE a IN (SELECT b FROM v WHERE c IN (SELECT d FROM w))")
    assert "scalar-subquery" not in findings(spark, "SELECT a FROM (SELECT 1 FROM u) t")
    assert {"swallowed-exception", "insert-in-loop"} <= findings(spark, "BEGIN LOOP INSERT INTO t VALUES (1); END LOOP; EXCEPTION WHEN OTHERS THEN NULL; END")


def test_table_names(spark):
    names = lambda sql: [r["table_name"] for r in S.table_names(spark.createDataFrame([(1, sql)], "id int, sql string")).collect()]
    assert names("SELECT * FROM a, b x, c AS y, Sch.D WHERE e IS DISTINCT FROM f") == ["a", "b", "c", "sch.d"]
    assert names("WITH q AS (SELECT 1 FROM a), r (x) AS (SELECT 2 FROM q) SELECT * FROM r JOIN LATERAL (SELECT 3) z ON true") == ["a"]
    assert names("DELETE FROM a USING b, c WHERE x = trim(both from y)") == ["a", "b", "c"]
    assert names("CREATE TABLE IF NOT EXISTS t (a int)") == ["t"] and names("SELECT * FROM generate_series(1, 3)") == []


@pytest.mark.parametrize("name", ["sql_function_arity", "sql_table_columns", "sql_tokens", "sql_package_mismatches", "mapper_statements", "java_statements", "sql_statements"])
def test_texts_are_made_in_many_parts(spark, sf_dir, name):
    made = Q.QUERIES[name](spark, sf_dir)
    assert made.rdd.getNumPartitions() > 1 or "hashpartitioning(" in made._jdf.queryExecution().executedPlan().toString()
    if name != "sql_package_mismatches":  # its groups are coalesced
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


MARKED = [
    "LOCK TABLE t", "drop table t cascade", "SELECT a FROM t WHERE nvl (a, 1) = 2 OR t.a <> t.b", "SELECT (SELECT 1) FROM t", "SELECT ( SELECT 1) FROM t", "SELECT a FROM t WHERE a <> ALL (SELECT 1)", "SELECT COUNT( * ), current_timestamp FROM t WHERE date(x) < 1",
    "UPDATE t SET a = 1 FROM u", "INSERT INTO a.b SELECT 1", "INSERT ALL INTO t VALUES (1)", "SELECT 1 CONNECT BY x", "SELECT a FROM t WHERE b ILIKE '_x'", "SELECT a FROM t WHERE b LIKE E'%x' FOR NO KEY UPDATE", "SELECT a FROM t FETCH FIRST 3 ROWS ONLY", "CREATE UNLOGGED TABLE t (a int)",
    "BEGIN EXECUTE IMMEDIATE a || b; GOTO x; PRAGMA autonomous_transaction; COMMIT; EXCEPTION WHEN OTHERS THEN NULL; END", "BEGIN LOOP INSERT INTO t SELECT 1; END LOOP; END", "SELECT a FROM t WHERE b != NULL OFFSET 3", "SELECT 1 UNION SELECT ${x}", "EXPLAIN MERGE INTO t USING u", "SELECT a FROM t WHERE b BETWEEN 1 AND 1", "", None,
    f"SELECT a FROM t WHERE b IN({', '.join(map(str, range(501)))})", "SELECT a FROM t JOIN u", "SELECT DISTINCT a FROM t ORDER BY 1", "SELECT a.b FROM t a WHERE a.b = a.c", "DELETE FROM t",
]


def test_marks_hide_no_finding(spark, sf_dir):
    """Marks spare patterns: with and without them the findings are the same, and a text without marks reaches no pattern."""
    texts = spark.createDataFrame(list(enumerate(MARKED)), "id long, sql string").union(S.statements(Q._scripts(spark, sf_dir)).select("id", F.col("statement").alias("sql")))
    plain = [r._replace(marks=()) for r in S.LINT_RULES]
    with_marks = rows(S.lint(texts))
    assert with_marks == rows(S.lint(texts, rules=plain))
    assert {r.code for r in S.LINT_RULES if r.marks} <= {r["code"] for r in S.lint(texts).select("code").distinct().collect()} | {"merge-used"}
    slow = S.LintRule("x", "caution", "(?:a?){40}a{40}b", marks=("zzz",))
    assert S.lint(spark.createDataFrame([(1, "a" * 60)], "id int, sql string"), rules=[slow], column_rules={}).count() == 0


def test_blocks_counted_once(spark):
    """A thousand statements of one block: each is masked once, and the block stays whole."""
    block = "BEGIN " + " ".join(f"IF a > {k} THEN x := CASE a WHEN 1 THEN {k} END; END IF;" for k in range(500)) + " END"
    assert cut(spark, block + "; SELECT 1") == [block, "SELECT 1"]
