"""Small plan building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest array one row materialises when a count is expanded into rows.
EXPAND_BLOCK = 4096


def explode_count(df: DataFrame, count_col: str, out_col: str, block: int = EXPAND_BLOCK,
                  spread: bool = False) -> DataFrame:
    """One output row per value ``1..count`` of ``count_col`` (``out_col`` bigint).

    Expands in two levels (blocks of ``block`` values, then values in a block) so
    that a huge count never builds one huge array in a single row. With
    ``spread`` the blocks of counts above ``block`` are dealt over all tasks first, so a
    hot row is not expanded in the task that holds it; other rows stay where they
    are.
    """
    if spread:
        few = explode_count(df.filter(F.col(count_col) <= block), count_col, out_col, block)
        many = df.filter(F.col(count_col) > block)
        n = F.col(count_col).cast("bigint")
        # a number of its own: adaptive execution would put the few, small blocks back
        # into one task, since it cannot see what they expand to
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = (many.withColumn("__blk", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint"))))
            .repartition(parts, "__blk", *[c for c in df.columns if c != count_col][:1]))
        b = F.col("__blk")
        return few.unionByName(dealt.withColumn(out_col, F.explode(F.sequence(
            b * block + 1, F.least(n, (b + 1) * block)))).drop("__blk"))
    n = F.col(count_col).cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint"))
    b = F.col("__blk")
    inner = F.sequence(b * block + 1, F.least(n, (b + 1) * block))
    return (df.filter(n > 0)
              .withColumn("__blk", F.explode(blocks))
              .withColumn(out_col, F.explode(inner))
              .drop("__blk"))


def first_by_order(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order_cols`` tuple.

    Written as ``min`` over a struct whose leading fields are the order columns (the
    other columns break ties): a sort aggregate with a map-side partial step, so a hot key is reduced on
    every task before the shuffle (a window ``row_number`` would pull the whole
    group into one task).
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)],
                      *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return agg.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
