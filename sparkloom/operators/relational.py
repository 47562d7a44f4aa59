"""Relational operators of the dialect that Spark's DataFrame API lacks.

Each takes and returns DataFrames and declares a plan; loops (recursion,
hierarchies) run one distributed step a round, cut by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from sparkloom.sources.shared import kept as _kept


def distinct_on(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """DISTINCT ON (keys) … ORDER BY: the first row of each key."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """(name, descending) as sort keys with the dialect's null order: last when ascending, first when descending."""
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in order]


def fetch_first(df: DataFrame, n: int, order: Sequence[tuple[str, bool]], with_ties: bool = False, offset: int = 0) -> DataFrame:
    """OFFSET … FETCH FIRST n ROWS ONLY, or WITH TIES (then without offset).

    With ties, the n-th row's sort key is found by a top-n (a job of its own
    that brings one row to the driver), and a filter keeps all rows up to it;
    nothing is ranked or sorted as a whole.
    """
    cols = sort_columns(order)
    if not with_ties:
        return df.orderBy(*cols).offset(offset).limit(n)
    if offset:
        raise ValueError("WITH TIES takes no offset")
    last = df.orderBy(*cols).limit(n).select(*(c for c, _ in order)).tail(1) if n > 0 else []
    if not last:
        return df.limit(0) if n <= 0 else df
    before, same = F.lit(False), F.lit(True)
    for c, down in order:
        v, x = F.lit(last[0][c]).cast(df.schema[c].dataType), F.col(c)
        ahead = F.coalesce(x > v, x.isNull() & v.isNotNull()) if down else F.coalesce(x < v, x.isNotNull() & v.isNull())
        before, same = before | (same & ahead), same & x.eqNullSafe(v)
    return df.where(before | same)


def top_per_group(df: DataFrame, n: int, keys: Sequence[str], *order: Column, with_ties: bool = False) -> DataFrame:
    """The first n rows of each group; Spark prunes each task's rows by rank before the shuffle."""
    nth = (F.rank() if with_ties else F.row_number()).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def groups_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column], start: int, end: int) -> tuple[DataFrame, WindowSpec]:
    """A GROUPS frame: peers are numbered by dense rank, and the frame is a RANGE over that number."""
    out = df.withColumn("__group", F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    return out, W.partitionBy(*partition).orderBy("__group").rangeBetween(start, end)


def quantified(df: DataFrame, left: str, op: str, right: DataFrame, every: bool, out: str) -> DataFrame:
    """``left op ANY/ALL (right)`` with three-valued logic, as column ``out``.

    ``right`` (one column) is summed up in one row: its least and greatest
    value, and how many values and nulls it has; that is looked up at once.
    """
    name = right.columns[0]
    r = right.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(name).alias("n"), F.count("*").alias("all")).first()
    x, nulls = F.col(left), r["all"] > r["n"]
    if not r["all"]:
        return df.withColumn(out, F.lit(every))
    if not r["n"]:
        return df.withColumn(out, F.lit(None).cast("boolean"))
    lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
    if op in ("=", "<>"):
        if (op == "=") != every:  # = ANY is IN; <> ALL is NOT IN
            keys = right.where(F.col(name).isNotNull()).distinct().withColumn("__in", F.lit(True)).withColumnRenamed(name, "__key")
            held = df.join(keys, F.col(left) == F.col("__key"), "left")
            inside = F.when(x.isNull(), None).when(F.col("__in"), True).otherwise(F.lit(None).cast("boolean") if nulls else F.lit(False))
            return held.withColumn(out, inside if op == "=" else ~inside).drop("__key", "__in")
        decided = (x == lo) & (x == hi) if every else (x != lo) | (x != hi)
    else:
        bound = {">": (hi if every else lo), ">=": (hi if every else lo), "<": (lo if every else hi), "<=": (lo if every else hi)}[op]
        decided = {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}[op]
    if nulls:  # a null decides only what the other values leave open
        decided = F.when(decided != F.lit(every), ~F.lit(every)) if every else F.when(decided, True)
    return df.withColumn(out, decided)


def in_sibling_order(rows: DataFrame, siblings: DataFrame, key: str, order: str) -> DataFrame:
    """ORDER SIBLINGS BY order: hierarchy rows (with their path of keys) in the
    order of a walk from the roots, those of one parent by ``order``, then key.

    ``siblings``: key and order of all rows. Each path's keys are replaced by
    (order, key), by one join on the exploded paths, and sorted as an array.
    """
    steps = rows.select("path", F.posexplode("path").alias("__place", "__key"))
    named = steps.join(siblings.select(F.col(key).alias("__key"), F.col(order).alias("__order")).distinct(), "__key")
    walk = named.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("__place", F.struct("__order", "__key").alias("s")))).alias("w"))
    return rows.join(walk.select("path", F.col("w.s").alias("__walk")), "path").orderBy("__walk").drop("__walk").select(*rows.columns)


def connect_by(df: DataFrame, start: Column, key: str, parent: str, nocycle: bool = False, max_level: int = 1000) -> DataFrame:
    """START WITH … CONNECT BY PRIOR key = parent.

    Adds level, root (key of the first ancestor), path (keys from there), and
    is_leaf. Without ``nocycle`` a row that is its own ancestor is an error;
    with it, that step isn't taken. One join a level.
    """
    rows = _kept(df)
    front = rows.where(start).withColumns({"level": F.lit(1), "root": F.col(key), "path": F.array(key)})
    levels, depth = [], 1
    while True:
        front = _kept(front)
        if front.isEmpty():
            break
        levels.append(front)
        if depth == max_level:
            raise ValueError(f"deeper than {max_level} levels")
        above = front.select(F.col(key).alias("__prior"), F.col("root").alias("__root"), F.col("path").alias("__path"))
        below = rows.join(above, F.col(parent) == F.col("__prior"))
        loop = F.array_contains("__path", F.col(key))
        if nocycle:
            below = below.where(~loop)
        else:
            below = below.where(F.when(loop, F.raise_error(F.lit("CONNECT BY loop"))).otherwise(F.lit(True)))
        depth += 1
        front = below.select(*df.columns, F.lit(depth).alias("level"), F.col("__root").alias("root"), F.concat("__path", F.array(key)).alias("path"))
    if not levels:
        return front.withColumn("is_leaf", F.lit(True))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    parents = out.where("level > 1").select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct().withColumn("__parent", F.lit(True))
    return out.join(parents, "path", "left").withColumn("is_leaf", F.col("__parent").isNull()).select(*df.columns, "level", "root", "path", "is_leaf")


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, max_rounds: int = 100) -> DataFrame:
    """WITH RECURSIVE seed UNION [ALL] step: the step sees the rows that the last round added."""
    seed = seed.distinct() if distinct else seed
    new = _kept(seed)
    out = new
    for _ in range(max_rounds):
        new = step(new).select(*seed.columns)
        if distinct:
            new = new.distinct().exceptAll(new.distinct().intersect(out))
        new = _kept(new)
        if new.isEmpty():
            return out
        out = _kept(out.union(new)) if distinct else out.union(new)
    raise ValueError(f"not settled after {max_rounds} rounds")


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    out = df.unpivot([F.col(k) for k in keys], [F.col(v) for v in values], name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: dict, agg: Column) -> DataFrame:
    """PIVOT (agg FOR column IN (value AS name, …)): one aggregation, no look for values."""
    named = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return df.withColumn("__for", named[F.col(column)]).groupBy(*keys).pivot("__for", list(values.values())).agg(agg)


def group_concat(value: Column, *order: Column, separator: str = ",", distinct: bool = False) -> Column:
    """GROUP_CONCAT([DISTINCT] value ORDER BY order SEPARATOR separator); nulls are left out."""
    if distinct:
        return F.array_join(F.array_sort(F.collect_set(value)), separator)
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def ordered_array(value: Column, *order: Column) -> Column:
    """ARRAY_AGG(value ORDER BY order), nulls kept."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def _back(df: DataFrame, by: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``by`` (one row for each value of ``keys``, null too) joined to ``df``."""
    other = by.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(other, same).drop(*(f"__{k}" for k in keys)) if keys else df.crossJoin(F.broadcast(by))  # one row


def with_ratio_to_report(df: DataFrame, value: str, out: str, *partition: str) -> DataFrame:
    """RATIO_TO_REPORT(value) OVER (PARTITION BY partition), as a sum by partition
    joined back: no partition is gathered in one task."""
    total = df.groupBy(*partition).agg(F.sum(value).alias("__total"))
    return _back(df, total, partition).withColumn(out, F.col(value) / F.nullif(F.col("__total"), F.lit(0).cast(df.schema[value].dataType))).drop("__total")


def with_count_distinct(df: DataFrame, value: str, out: str, *partition: str) -> DataFrame:
    """COUNT(DISTINCT value) OVER (PARTITION BY partition), as a count of the
    distinct pairs joined back."""
    n = df.select(*partition, value).distinct().groupBy(*partition).agg(F.count(value).alias(out))
    return _back(df, n, partition)


def with_ranks(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], prefix: str = "") -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist, as columns behind ``prefix``.

    They depend on how many rows each sort key has, so only distinct keys are
    ranked; the rows meet theirs by a join.
    """
    names = [c for c, _ in order]
    keys = df.groupBy(*partition, *names).agg(F.count("*").alias("__n"))
    by = W.partitionBy(*partition).orderBy(*sort_columns(order))
    before = F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    total = F.sum("__n").over(W.partitionBy(*partition))
    ranked = keys.select(
        *partition,
        *names,
        (before + 1).alias(f"{prefix}rank"),
        F.row_number().over(by).cast("long").alias(f"{prefix}dense_rank"),
        F.coalesce(F.try_divide(before.cast("double"), total - 1), F.lit(0.0)).alias(f"{prefix}percent_rank"),
        ((before + F.col("__n")) / total).alias(f"{prefix}cume_dist"),
    )
    return _back(df, ranked, [*partition, *names])


def with_row_number(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], out: str = "row_number", size: str | None = None) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY partition ORDER BY order), for partitions of any size.

    Rows are range-partitioned by partition and order, so that no task holds a
    whole partition, and kept; each row's number is that within its task and
    partition, and how many came before: a table of tasks and partitions, with
    one row more than these at most. ``size``: also the rows of the partition.
    """
    cols = [*map(F.col, partition), *sort_columns(order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _kept(df.repartitionByRange(parts, *cols).withColumn("__task", F.spark_partition_id()))
    counts = rows.groupBy("__task", *partition).agg(F.count("*").alias("__n"))
    by = W.partitionBy(*partition).orderBy("__task")
    before = counts.select(F.col("__task").alias("__of"), *partition, (F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy(*partition)).alias("__size"))
    own = F.row_number().over(W.partitionBy("__task", *partition).orderBy(*sort_columns(order)))
    met = _back(rows.withColumn("__own", own), before.withColumnRenamed("__of", "__task"), ["__task", *partition])
    out_cols = [(F.col("__before") + F.col("__own")).alias(out), *([F.col("__size").alias(size)] if size else [])]
    return met.select(*df.columns, *out_cols)


def ntile(number: Column, size: Column, buckets: int) -> Column:
    """NTILE(buckets), from the row's number and the rows of its partition: the first size % buckets get one more."""
    small, more = F.floor(size / buckets), size % buckets
    return F.when(number <= more * (small + 1), F.floor((number - 1) / (small + 1)) + 1).otherwise(more + F.floor((number - 1 - more * (small + 1)) / F.greatest(small, F.lit(1))) + 1).cast("long")


def with_rownum(df: DataFrame, out: str = "rownum") -> DataFrame:
    """ROWNUM: rows numbered from 1 as they come, before any ORDER BY; contiguous,
    by counts of tasks, and without moving a row."""
    rows = _kept(df.withColumn("__task", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id()))
    counts = rows.groupBy("__task").agg(F.count("*").alias("__n"))  # one row a task
    before = counts.select("__task", (F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__task").withColumn(out, F.col("__before") + F.col("__own").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*df.columns, out)


def custom_aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], step: Callable, finish: Callable, state: str, result: str, parts: int = 16) -> DataFrame:
    """CREATE AGGREGATE with a state that merges by addition.

    ``step``: a pandas frame of ``values`` to the numbers of ``state`` (a column
    list in DDL). Each task adds up what it holds of a key, so a key of any size
    is one row a task in the shuffle; ``finish``: the summed state columns to
    the result, as a Column. Tasks hold at most one state a key and batch.
    """
    names = [c.split()[0] for c in state.split(",")]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for frame in batches:
            if len(frame):
                found = frame.groupby(list(keys), dropna=False, sort=False)[list(values)].apply(lambda g: pd.Series(step(g), index=names))
                yield found.reset_index()[[*keys, *names]]

    states = df.select(*keys, *values).mapInPandas(run, f"{kinds}, {state}")
    summed = states.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
    return summed.select(*keys, finish(*map(F.col, names)).alias(result))


def predict_by(df: DataFrame, model, features: Sequence[str], out: str) -> DataFrame:
    """PREDICT BY model (FEATURES …): the prediction of a fitted pyspark.ml model as a column."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep").transform(df)
    found = model.setFeaturesCol("__features").setPredictionCol(out).transform(rows)
    return found.select(*df.columns, out)


class Outer(str):
    """A side of a join condition that is marked (+): its rows may be missing."""


def plus_join(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> DataFrame:
    """FROM left, right WHERE left.a op right.b(+) AND …: an outer join that keeps
    the side without a mark.

    ``conditions``: (left column or value, operator, right column), the marked
    one an ``Outer``; all marks must be on one side. Without marks it is an inner
    join. A condition on the marked side alone (None as the other) joins too.
    """
    marks = {side for a, _, b in conditions for side, x in (("left", a), ("right", b)) if isinstance(x, Outer)}
    if len(marks) > 1:
        raise ValueError("(+) on both sides of a join")
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    met = F.lit(True)
    for a, op, b in conditions:
        x = left[str(a)] if a in left.columns else F.lit(a)
        y = right[str(b)] if b in right.columns else F.lit(b)
        met = met & ops[op](x, y)
    return left.join(right, met, {"left": "right", "right": "left"}[marks.pop()] if marks else "inner")


def order_using(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """ORDER BY column USING < or >."""
    return df.orderBy(*sort_columns([(c, {"<": False, ">": True}[op]) for c, op in keys]))


def sampled(df: DataFrame, percent: float, seed: int, *keys: str) -> DataFrame:
    """TABLESAMPLE BERNOULLI (percent) REPEATABLE (seed).

    With ``keys`` a row is in by a hash of these and the seed, so that the same
    rows are however the table is stored or partitioned; else Spark draws them.
    """
    if not keys:
        return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed))))
    return df.where(F.substring(digest, 1, 8) < F.lit(f"{int(min(percent, 100) / 100 * (1 << 32)):08x}")) if percent < 100 else df


def range_join(left: DataFrame, right: DataFrame, at: str, lo: str, hi: str, width: float, coarser: int = 64) -> DataFrame:
    """Rows of ``left`` in the half-open range [lo, hi) of ``right``: an
    equi-join on buckets, instead of a comparison of all rows.

    Ranges are put into buckets of ``width``, those wider than ``coarser``
    buckets into buckets that are ``coarser`` times as wide, and so on, so that
    no range takes over ``coarser + 2`` rows. A left row asks once for each
    width that occurs among the ranges, at most eleven.
    """
    span = F.greatest(F.col(hi) - F.col(lo), F.lit(0)).cast("double") / width
    level = F.least(F.lit(10), F.greatest(F.lit(0), F.ceil(F.log(span / coarser) / F.log(F.lit(float(coarser)))).cast("int")))
    level = F.when(span <= coarser, 0).otherwise(level)
    size = F.lit(float(width)) * F.pow(F.lit(float(coarser)), F.col("__level"))
    ranges = right.where(F.col(lo) < F.col(hi)).withColumn("__level", level)
    levels = [r[0] for r in ranges.select("__level").distinct().collect()]  # eleven rows at most
    ranges = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))
    asked = left.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__bucket", F.floor(F.col(at) / size))
    met = asked.join(ranges, ["__level", "__bucket"])
    return met.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bucket", "__level")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it.

    One union, range-partitioned by key and time, so that a key of any size is
    spread over tasks, and kept. A running window finds the last right row
    within a task; what tasks before it leave behind for the key comes from a
    table of one row a task and key.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("__side"), *cols, *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values))
    b = right.select(key, at, F.lit(0).alias("__side"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), *(F.col(v).alias(f"__{v}") for v in values))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _kept(a.union(b).where(F.col(at).isNotNull() | (F.col("__side") == 1)).repartitionByRange(parts, key, at, "__side").withColumn("__task", F.spark_partition_id()))
    found = F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{v}").alias(v) for v in values)))
    by = W.partitionBy("__task", key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy("__task", key).agg(F.max_by(found, F.when(F.col("__side") == 0, F.col(at))).alias("__end"))
    before = ends.withColumn("__left", F.last("__end", ignorenulls=True).over(W.partitionBy(key).orderBy("__task").rowsBetween(W.unboundedPreceding, -1))).drop("__end")
    met = _back(rows.withColumn("__row", F.last(found, ignorenulls=True).over(by)), before, ["__task", key])
    row = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.coalesce("__row", "__left"))
    return met.where("__side = 1").withColumn("__row", row).select(key, at, *cols, *(F.col("__row")[v].alias(v) for v in values))
