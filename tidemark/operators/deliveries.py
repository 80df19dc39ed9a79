"""Messages delivered at least once: keep exactly one copy of each.

A message is identified by ``(scope columns, canonical identifier)``. Deliveries are ranked by arrival and
the first one is kept. ``row_number() = 1`` is planned with a group limit below the exchange, so every map
task sends at most one row of a message: a message that holds a third of all rows does not make a hot task.

Defined cases: a delivery whose identifier is null, empty or blank is a message of its own and always kept
(such rows are not ranked at all, and pass beside the exchange); a null scope value is a scope like any other; of rows with equal arrival one is kept, chosen by a hash over
the whole row; an empty table gives an empty table; further columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import identifier_key


def _free(columns: Sequence[str], *names: str) -> list[str]:
    """``names`` with underscores added until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _rank_one(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    (rank,) = _free(df.columns, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def first_deliveries(
    df: DataFrame, identifier: str = "message_id", scope: Sequence[str] = ("source",), arrival: Sequence[str] = ("delivery_id",)
) -> DataFrame:
    """One row for each message: its first delivery by ``arrival`` (nulls last), all columns kept."""
    columns = df.columns
    (key,) = _free(columns, "key")
    order = [F.col(c).asc_nulls_last() for c in arrival] + [F.xxhash64(*(F.col(c) for c in columns))]
    keyed = df.withColumn(key, identifier_key(F.col(identifier)))
    first = _rank_one(keyed.where(F.col(key).isNotNull()), [*scope, key], order).select(*columns)
    return first.unionByName(keyed.where(F.col(key).isNull()).select(*columns))


def repeated_deliveries(
    df: DataFrame, identifier: str = "message_id", scope: Sequence[str] = ("source",), arrival: Sequence[str] = ("delivery_id",)
) -> DataFrame:
    """``arrival`` values of the deliveries that :func:`first_deliveries` leaves out.

    Only identifiers travel: the first deliveries are ranked on a narrow projection and then taken away by an
    anti join on ``arrival``, whose values are spread evenly even when one message is hot. Rows with a null in
    ``arrival`` have no place in the order and are not listed.
    """
    narrow = df.select(*dict.fromkeys([*scope, *arrival, identifier]))
    (key,) = _free(narrow.columns, "key")
    keyed = narrow.withColumn(key, identifier_key(F.col(identifier))).where(F.col(key).isNotNull()).drop(identifier)
    firsts = _rank_one(keyed, [*scope, key], [F.col(c).asc_nulls_last() for c in arrival]).select(*arrival)
    listed = keyed.select(*arrival).dropna(subset=list(arrival))
    return listed.join(firsts, list(arrival), "left_anti").distinct()


def new_messages(
    batch: DataFrame, stored: DataFrame, identifier: str = "message_id", scope: Sequence[str] = ("source",), arrival: Sequence[str] = ("delivery_id",)
) -> DataFrame:
    """First deliveries of ``batch`` whose message is not in ``stored`` (any table with scope and identifier).

    The batch is reduced to one row a message before the anti join, and only the identifiers of ``stored`` are
    read, so neither side can be hot. Null scope values match each other; messages without identifier are new.
    """
    columns = batch.columns
    (key,) = _free(columns, "key")
    fresh = first_deliveries(batch, identifier, scope, arrival).withColumn(key, identifier_key(F.col(identifier))).alias("n")
    known = stored.select(*scope, identifier_key(F.col(identifier)).alias(key)).where(F.col(key).isNotNull()).distinct().alias("k")
    same = F.col(f"n.{key}") == F.col(f"k.{key}")
    for c in scope:
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return fresh.join(known, same, "left_anti").select(*columns)
