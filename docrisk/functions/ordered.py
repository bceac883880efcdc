"""Running sums and previous-row values inside groups of any size.

A plain window puts a whole group into one task. Here every group is cut into blocks of the order
column: each block is scanned on its own, and what came before it is added. The blocks' totals are
scanned in the same way, by blocks of blocks, ``LEVELS`` times; the last level's window holds a
handful of rows. Order values are unique within a group, so no window ever holds more than ``SPAN``
rows (twice that around zero), whatever the group's size, NULL keys included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values of a block. Blocks and two levels of blocks of blocks divide 64-bit order values by 2^60.
SPAN = 1 << 20
LEVELS = 2


def _plus(a: Column, b: Column) -> Column:
    """The sum of what is there."""
    return F.coalesce(a + b, a, b)


def _before(totals: DataFrame, sums: list[str], span: int, level: int) -> DataFrame:
    """``_key``, ``_at``: every block of ``totals`` (``_k``, ``_block``, ``_t_*``, ``_last``) with the sums of
    all blocks before it (``_cs_*``) and the last row before it (``_before``)."""
    outer = F.expr(f"_block div {span}") if level else F.lit(0).cast("bigint")
    rows = totals.withColumn("_outer", outer)
    inside = Window.partitionBy("_k", "_outer").orderBy("_block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumns(
        {f"_cs_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums}
        | {"_before": F.lag("_last").over(inside), "_first": F.lag(F.lit(1)).over(inside).isNull()}
    )
    if not level:
        return scanned.select(F.col("_k").alias("_key"), F.col("_block").alias("_at"), *[f"_cs_{n}" for n in sums], "_before")
    wider = rows.groupBy("_k", F.col("_outer").alias("_block")).agg(
        F.max_by("_last", F.struct("_block")).alias("_last"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums]
    )
    carry = _before(wider.select("_k", "_block", "_last", *[f"_t_{n}" for n in sums]), sums, span, level - 1)
    outside = carry.select(
        F.col("_key").alias("_k"), F.col("_at").alias("_outer"), *[F.col(f"_cs_{n}").alias(f"_os_{n}") for n in sums], F.col("_before").alias("_outside")
    )
    return scanned.join(outside, ["_k", "_outer"], "left").select(
        F.col("_k").alias("_key"), F.col("_block").alias("_at"),
        *[_plus(F.col(f"_cs_{n}"), F.col(f"_os_{n}")).alias(f"_cs_{n}") for n in sums],
        F.when(F.col("_first"), F.col("_outside")).otherwise(F.col("_before")).alias("_before"),
    )


def ordered_scan(
    df: DataFrame,
    key: str,
    order: str,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    span: int = SPAN,
    levels: int = LEVELS,
) -> DataFrame:
    """Add running sums (current row included) and previous-row values per group.

    ``order`` is an integer column, unique within each ``key``; NULL is a key like any other.
    ``previous`` values are NULL on the first row of a group. The rows are shuffled once, by key and
    block; the scan of the blocks and their totals read the same exchange.
    """
    sums, previous = sums or {}, previous or {}
    # neither is ever NULL, so that joins on them need no other exchange than the rows' own
    part = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    block = F.coalesce(F.expr(f"`{order}` div {span}"), F.lit(0).cast("bigint"))
    rows = df.withColumns({"_k": part, "_block": block}).repartition("_k", "_block")

    in_block = Window.partitionBy("_k", "_block").orderBy(order)
    to_here = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_s_{n}": F.sum(c).over(to_here) for n, c in sums.items()}
    local |= {f"_p_{n}": F.lag(c).over(in_block) for n, c in previous.items()}
    local["_first"] = F.lag(F.lit(1)).over(in_block).isNull()
    scanned = rows.withColumns(local)

    # The last row of a block is taken with all its columns, and asked for even where only sums are:
    # needing the same columns as the scan is what lets both read one exchange.
    last = F.struct(*[c.alias(f"_v_{n}") for n, c in previous.items()], *df.columns)
    totals = rows.groupBy("_k", "_block").agg(
        F.max_by(last, F.col(order)).alias("_row"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    )
    values = F.struct(F.lit(True).alias("_there"), *[F.col("_row")[f"_v_{n}"].alias(n) for n in previous])
    there = F.col("_row").isNotNull()
    totals = totals.select("_k", "_block", values.alias("_last"), *[F.when(there, F.col(f"_t_{n}")).alias(f"_t_{n}") for n in sums])
    carry = _before(totals, list(sums), span, levels).withColumnsRenamed({"_key": "_k", "_at": "_block"})
    joined = scanned.join(carry, ["_k", "_block"], "left")

    out = [F.col(c) for c in df.columns]
    out += [_plus(F.col(f"_cs_{n}"), F.col(f"_s_{n}")).alias(n) for n in sums]
    out += [F.when(F.col("_first"), F.col("_before")[n]).otherwise(F.col(f"_p_{n}")).alias(n) for n in previous]
    return joined.select(*out)
