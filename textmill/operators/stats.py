"""Aggregation, ranking and reshaping of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.ledger import ledger_guarded as ledger_guarded
from textmill.operators.order import in_ranges, running_sum


def column_profile(table: DataFrame, value: str, threshold, group: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    return table.groupBy(*(group or [])).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("maximum"), F.min(v).alias("minimum"), F.count_if(v > threshold).alias("above"))


def value_counts(values: DataFrame, value: str, n: str = "n") -> DataFrame:
    return values.groupBy(value).agg(F.count("*").alias(n))


def word_count(texts: DataFrame, text: str = "text", sep: str = "[ \n]+") -> DataFrame:
    words = texts.select(F.explode(F.split(text, sep)).alias("word"))
    return value_counts(words.where("word <> ''"), "word")


def char_count(texts: DataFrame, text: str) -> DataFrame:
    return value_counts(texts.select(F.explode(F.split(text, "")).alias("letter")).where("letter <> ''"), "letter")


def pair_value_count(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return value_counts(pairs.select(F.explode(F.array(a, b)).alias("value")), "value")


def value_positions(rows: DataFrame, value: Column, key: str, pos: str) -> DataFrame:
    """(key, n, positions) of the rows where value holds."""
    hits = rows.where(value)
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(pos)).alias("positions"))


def first_position(texts: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """(key, line_no, word_no) of a word's first place, from 0; (-1, -1) if it is nowhere."""
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    words = rows.select(key, "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    found = words.where(F.col("word") == word).groupBy(key).agg(F.min(F.struct("line_no", "word_no")).alias("p"))
    out = texts.select(key).join(found, key, "left")
    return out.select(key, F.coalesce("p.line_no", F.lit(-1)).alias("line_no"), F.coalesce("p.word_no", F.lit(-1)).alias("word_no"))


def group_mean(parents: DataFrame, rows: DataFrame, key: str, value: str, none: str = "sin notas") -> DataFrame:
    """(key, mean, note): the mean of each parent's rows; a note where there are none. Means come before the join."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    return parents.select(key).join(means, key, "left").select(key, "mean", F.when(F.col("mean").isNull(), none).alias("note"))


def sums_over(table: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Sums of value over grouping sets in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return table.groupingSets(sets, *names).agg(F.sum(value).alias("total"))


def cube_total(table: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return table.cube(*keys).agg(F.sum(value).alias("total"))


def top_one(table: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the largest value, the first by tie."""
    return table.orderBy(F.col(value).desc(), F.col(tie)).limit(1)


def extremes(table: DataFrame, value: str, group: list[str] | None = None, largest: bool = True) -> DataFrame:
    """All rows at the maximum (or minimum) of their group, ties included: an aggregate and a join, so
    no group is ordered in one task."""
    best = (F.max if largest else F.min)(value).alias("__best")
    if not group:
        return table.join(table.agg(best), F.col(value) == F.col("__best")).drop("__best")
    return table.join(table.groupBy(*group).agg(best), group).where(F.col(value) == F.col("__best")).drop("__best")


def closest_pair(table: DataFrame, group: str, value: str) -> DataFrame:
    """(group, low, high, gap): neighbours in sorted order with the least gap, the lowest on ties. Null values
    are no neighbours; a group with fewer than two values has no row.

    A group is dealt in ranges of its values. Neighbours meet within a range; where a group goes on in another
    range, the largest value of the one meets the smallest of the next.
    """
    placed = in_ranges(table.where(F.col(value).isNotNull()).select(group, value), [value], (group,))
    inside = Window.partitionBy("__part", group).orderBy("__id")
    within = placed.select(group, F.lag(value).over(inside).alias("low"), F.col(value).alias("high"))
    edges = placed.groupBy("__part", group).agg(F.min(value).alias("first"), F.max(value).alias("last"))
    across = Window.partitionBy(group).orderBy("__part")  # a row for each range of the group
    between = edges.select(group, F.lag("last").over(across).alias("low"), F.col("first").alias("high"))
    pairs = within.union(between).where("low IS NOT NULL")
    best = F.min(F.struct((F.col("high") - F.col("low")).alias("gap"), "low", "high")).alias("b")
    return pairs.groupBy(group).agg(best).select(group, "b.low", "b.high", "b.gap")


def transpose(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Rows become columns; the columns are a parameter, so no pass is needed to find them."""
    return cells.groupBy(row).pivot(column, columns).agg(F.sum(value))


def concat_group(rows: DataFrame, group: str, text: str, pos: str, glue: str = " ") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(pos, text)))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda r: r[text]), glue).alias("joined"))


def series_add(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.join(b.select(key, F.col(value).alias("__other")), key).select(key, (F.col(value) + F.col("__other")).alias(value))


def match_result(home: str, away: str) -> Column:
    return F.when(F.col(home) > F.col(away), "1").when(F.col(home) < F.col(away), "2").otherwise("X")


def price_lookup(rows: DataFrame, prices: DataFrame, key: str, price: str, default) -> DataFrame:
    return rows.join(prices.select(key, price), key, "left").withColumn(price, F.coalesce(price, F.lit(default)))


def ledger_balance(moves: DataFrame, account: str, order: list[str], amount: str, opening: float = 0.0) -> DataFrame:
    """Adds balance: the running sum of valid moves; moves whose size isn't positive are left out (sign is the kind's).
    An account's moves are dealt in ranges, however many there are."""
    moved = running_sum(moves.where(F.col(amount) != 0), order, F.col(amount), "balance", (account,))
    return moved.withColumn("balance", F.lit(opening) + F.col("balance"))


def eligible_withdrawal(moves: DataFrame, holders: DataFrame, account: str, amount: str, age: str, least: int = 18, below: int = 25) -> DataFrame:
    """moves with eligible: a withdrawal (a negative amount) counts only if its holder's age is in
    [least, below); other moves always do. A withdrawal without a holder is rejected."""
    out = moves.join(holders.select(account, age), account, "left")
    return out.withColumn("eligible", (F.col(amount) >= 0) | F.coalesce((F.col(age) >= least) & (F.col(age) < below), F.lit(False)))


def pairwise_mean(low: str | Column, high: str | Column) -> Column:
    """struct<middle, valid>: the mean of both; not valid, and without a mean, where high is below low."""
    low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    return F.struct(F.when(high >= low, (high + low) / 2).alias("middle"), (high >= low).alias("valid"))


def floored_total(moves: DataFrame, key: str, order: list[str], step: str, most: float | None = None) -> DataFrame:
    """Adds total: a running sum that never falls below 0, by the closed form S - min(0, least S so far).
    With `most`, moves whose size is above it are rejected before (0 to 200 for the usual card). A null step
    counts 0. A key's moves are dealt in ranges, however many there are."""
    if most is not None:
        moves = moves.where(F.abs(F.col(step)) <= most)
    run = running_sum(moves, order, F.col(step), "__s", (key,), least="__least")
    return run.withColumn("total", F.col("__s") - F.least(F.lit(0), F.col("__least"))).drop("__s", "__least")


def role_uplift(staff: DataFrame, rates: DataFrame, role: str, pay: str) -> DataFrame:
    """(role, n, before, after): pay by role with its rate (1 where none is given)."""
    raised = staff.join(rates, role, "left").withColumn("__rate", F.coalesce("rate", F.lit(1.0)))
    return raised.groupBy(role).agg(F.count("*").alias("n"), F.sum(pay).alias("before"), F.sum(F.col(pay) * F.col("__rate")).alias("after"))


def login_attempts(log: DataFrame, user: str, order: list[str], ok: Column, most: int = 3) -> DataFrame:
    """(user, tries, entered): whether one of the first attempts succeeded; else the user is blocked."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    first = log.withColumn("__n", rank).where(F.col("__n") <= most)
    return first.groupBy(user).agg(F.count("*").alias("tries"), F.bool_or(ok).alias("entered"))
