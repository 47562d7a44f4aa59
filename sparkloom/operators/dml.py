"""Data-changing statements as table-to-table functions.

Each returns the target's rows after the statement, for the caller to write;
none changes a table in place. Columns of the other side are called new_… in
conditions and assignments. Null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.sources.shared import kept


def _new(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a mark and its other columns renamed to new_…"""
    return df.select(*keys, *(F.col(c).alias(f"new_{c}") for c in df.columns if c not in keys), F.lit(True).alias("__new"))


def _true(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def insert_into(target: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT INTO target (columns) rows: matched by place; columns that aren't
    named take their default, or null. A row of no columns is DEFAULT VALUES."""
    columns, defaults = list(target.columns[: len(rows.columns)] if columns is None else columns), defaults or {}
    if len(columns) != len(rows.columns) or set(columns) - set(target.columns):
        raise ValueError(f"INSERT of {len(rows.columns)} columns into {columns}")
    place = {c: k for k, c in enumerate(columns)}
    named = rows.toDF(*(f"c{k}" for k in range(len(columns))))
    made = [(F.col(f"c{place[c]}") if c in place else defaults.get(c, F.lit(None))).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return target.union(named.select(*made))


def _upsert_once(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: Mapping[str, Column], where: Column | None) -> DataFrame:
    both = target.withColumn("__old", F.lit(True)).join(_new(rows, keys), list(keys), "full")
    hit = F.coalesce(F.col("__old") & F.col("__new"), F.lit(False)) & _true(where)
    cols = [F.col(c) if c in keys else F.when(hit, update.get(c, F.col(c))).when(F.col("__old"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in target.columns]
    return both.select(*cols)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], update: Mapping[str, Column], where: Column | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """INSERT … ON DUPLICATE KEY UPDATE: ``update`` may use target columns and
    new_… columns; ``where`` limits the updates.

    Rows are applied in ``order`` (by default, of their columns): of rows that
    share a key the first inserts or updates, and each later one updates what
    is there by then. It takes one join for each row that the most frequent key
    has; how many those are is looked up first.
    """
    by = W.partitionBy(*keys).orderBy(*(order or map(F.col, rows.columns)))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    numbered = rows.withColumn("__nth", F.when(null, 1).otherwise(F.row_number().over(by)))
    rounds = numbered.agg(F.max("__nth")).first()[0] or 0
    for nth in range(1, rounds + 1):
        target = _upsert_once(target, numbered.where(F.col("__nth") == nth).drop("__nth"), keys, update, where)
        target = kept(target) if nth % 10 == 0 else target
    return target


def replace_into(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """REPLACE INTO: rows of equal key go, the new rows come; of new rows that
    share a key the last in ``order`` (by default, of their columns) stays."""
    by = W.partitionBy(*keys).orderBy(*(order or map(F.col, rows.columns)))
    after = rows.withColumn("__later", F.lead(F.lit(1)).over(by))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    last = after.where(F.col("__later").isNull() | ~known).drop("__later")
    return target.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(last)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE … FROM source WHERE keys match [AND where].

    A target row is changed once: of several source rows that hit it, by the
    first in order of their columns.
    """
    new = _new(source, keys)
    marked = target.withColumn("__id", F.monotonically_increasing_id()) if where is not None else target
    if where is None:  # one source row a key, before the join
        new = new.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*(c for c in new.columns if c not in keys)))).where("__nth = 1").drop("__nth")
    met = marked.join(new, list(keys), "left")
    hit = F.coalesce(F.col("__new"), F.lit(False)) & _true(where)
    if where is not None:
        best = W.partitionBy("__id").orderBy(F.desc("__hit"), *(c for c in new.columns if c not in keys))
        met = met.withColumn("__hit", hit).withColumn("__nth", F.row_number().over(best)).where("__nth = 1")
        hit = F.col("__hit")
    return met.select(*(F.when(hit, update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns))


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """DELETE … USING source: rows with a partner (for which ``where`` holds) go; one anti-join."""
    new = source.select(*(F.col(c).alias(f"new_{c}") for c in source.columns))
    met = _true(where)
    for k in keys:
        met = met & (F.col(k) == F.col(f"new_{k}"))
    return target.join(new, met, "left_anti")


def first_rows(target: DataFrame, keys: Sequence[str], where: Column | None, order: Sequence[Column], limit: int) -> DataFrame:
    """Which rows a statement with ORDER BY … LIMIT hits: keys and a mark. ``keys`` tell rows apart."""
    return target.where(_true(where)).orderBy(*order).limit(limit).select(*keys, F.lit(True).alias("__hit"))


def update_first(target: DataFrame, keys: Sequence[str], update: Mapping[str, Column], order: Sequence[Column], limit: int, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE … WHERE … ORDER BY … LIMIT … RETURNING *: the table, and the changed rows."""
    met = target.join(first_rows(target, keys, where, order, limit), list(keys), "left")
    after = met.select(*(F.when(F.col("__hit"), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns), "__hit")
    return after.drop("__hit"), after.where("__hit").drop("__hit")


def delete_first(target: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE … WHERE … ORDER BY … LIMIT … RETURNING *: the table, and the rows that went."""
    hit = first_rows(target, keys, where, order, limit).drop("__hit")
    return target.join(hit, list(keys), "left_anti").select(*target.columns), target.join(hit, list(keys), "left_semi").select(*target.columns)


def merge_into(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: Mapping[str, Column] | None = None, matched_where: Column | None = None, insert: Mapping[str, Column] | None = None, insert_where: Column | None = None) -> DataFrame:
    """MERGE INTO … WHEN MATCHED THEN UPDATE [WHERE] WHEN NOT MATCHED THEN INSERT [WHERE].

    A key column can't be updated, as in the dialect, and a key that several
    source rows have is an error when the rows are computed.
    """
    if matched and set(matched) & set(keys):
        raise ValueError(f"MERGE can't update the columns it joins on: {sorted(set(matched) & set(keys))}")
    new = _new(source, keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    alone = F.when(known & (F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1), F.raise_error(F.lit("MERGE: several source rows have one key"))).otherwise(F.lit(True))
    new = new.withColumn("__new", alone).where("__new")
    both = target.withColumn("__old", F.lit(True)).join(new, list(keys), "full")
    old, come = F.coalesce("__old", F.lit(False)), F.coalesce("__new", F.lit(False))
    hit = old & come & _true(matched_where)
    keep = old | (F.lit(insert is not None) & _true(insert_where))
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
            continue
        stays = F.when(hit, matched[c]).otherwise(F.col(c)) if matched and c in matched else F.col(c)
        made = insert[c] if insert and c in insert else F.lit(None).cast(target.schema[c].dataType)
        cols.append(F.when(old, stays).otherwise(made).alias(c))
    return both.where(keep).select(*cols)


def insert_all(source: DataFrame, branches: Mapping[str, Column | None], target: str = "target") -> DataFrame:
    """INSERT ALL: every branch whose condition holds takes the row (None: always).

    The rows once for each branch that takes them, with its name as column
    ``target``: one scan, to be written by that column.
    """
    taken = [F.when(_true(cond), F.lit(name)) for name, cond in branches.items()]
    return source.select("*", F.explode(F.array_compact(F.array(*taken))).alias(target))


def insert_first(source: DataFrame, branches: Mapping[str, Column | None], target: str = "target") -> DataFrame:
    """INSERT FIRST: the first branch whose condition holds takes the row; None is ELSE."""
    name = F.coalesce(*(F.when(_true(cond), F.lit(n)) for n, cond in branches.items()))
    return source.withColumn(target, name).where(F.col(target).isNotNull())
