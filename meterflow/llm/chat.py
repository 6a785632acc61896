"""Chat formatting (operator 3), DataFrame functions only.

Method: cumulative-snapshot collapse. A service that logs the whole conversation
after every turn leaves many conversations that are prefixes of longer ones. Each
turn gets the rolling hash of all turns up to it (128 bits: the exclusive or of
position-salted hashes of role and text). A conversation whose last hash is a
proper prefix hash of another conversation is dropped by an anti-join; of equal
conversations the least conv_id stays. The maximal ones are rendered.

Turn positions and rolling hashes come from two window levels, blocks of
``BLOCK`` turn numbers and the blocks of a conversation, so a conversation of any
length is dealt out. Prefix hashes are reduced to one row each, with their
greatest length, before the join, so a first turn that very many conversations
share costs one row.

Cases: turns are ordered by turn, role, md5 of the text, nulls last; equal turns repeat;
null role or text renders as the empty string but hashes as null; a null conv_id
is a conversation of its own; an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import cut

BLOCK = 1024
# The rendered form of one turn, fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _order() -> list[Column]:
    """Turns of a conversation: by turn, role, md5 of the text, nulls last."""
    return [F.asc_nulls_last(c) for c in ("turn", "role", "m")]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): every turn's position from 1 and the rolling hash
    (a, b) of the turns up to it. Texts are hashed where they are read."""
    nulls = [F.col("role").isNull(), F.col("text").isNull()]
    t = turns.select("conv_id", "turn", "role", F.md5("text").alias("m"),
                     F.xxhash64(F.lit(1), "role", "text", *nulls).alias("x"),
                     F.xxhash64("text", F.lit(2), "role", *nulls).alias("y"),
                     F.floor(F.col("turn") / BLOCK).alias("block"))
    in_block = Window.partitionBy("conv_id", "block").orderBy(*_order())
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("k"),
                          F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("k"))
    placed = (t.withColumn("at", F.row_number().over(in_block)).join(before, same)
              .withColumn("pos", F.col("at") + F.col("before"))
              .select("conv_id", "block", "pos", F.xxhash64("pos", "x").alias("x"), F.xxhash64("y", "pos").alias("y")))
    # by position: equal turns have no order of their own
    roll = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("a", F.bit_xor("x").over(roll)).withColumn("b", F.bit_xor("y").over(roll))
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("k"),
                            F.coalesce(F.bit_xor("x").over(upto), F.lit(0)).alias("cx"),
                            F.coalesce(F.bit_xor("y").over(upto), F.lit(0)).alias("cy"))
    return (placed.join(carried, same)
            .select("conv_id", "pos", F.col("a").bitwiseXOR(F.col("cx")).alias("a"),
                    F.col("b").bitwiseXOR(F.col("cy")).alias("b")))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): the maximal conversations, rendered."""
    p = cut(prefixes(turns))
    # one row per conversation: its last position and hash
    whole = p.groupBy("conv_id").agg(F.max("pos").alias("end"))
    ends = p.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    # equal conversations become one row, and so do shared prefixes, before they meet
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id"))
    distinct = ends.where("pos = end").groupBy("pos", "a", "b").agg(first.alias("first"))
    inner = ends.where("pos < end").select("pos", "a", "b").distinct()
    kept = distinct.join(inner, ["pos", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("c"))
    piece = F.struct(*[x for c in ("turn", "role", "m") for x in (F.col(c).isNull(), F.col(c))],
                     rendered(F.col("role"), F.col("text")).alias("piece"))
    said = (turns.select("conv_id", "turn", "role", "text", F.md5("text").alias("m"))
            .join(kept, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
            .groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces")))
    return said.select("conv_id", F.size("pieces").cast("long").alias("n_turns"),
                       F.array_join(F.col("pieces.piece"), "").alias("text"))


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS LAST, role NULLS LAST, md5(text) NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT conv_id, pos, n, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
    || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS said,
    string_agg(CASE WHEN role IS NULL THEN '1' ELSE '0' END || CASE WHEN text IS NULL THEN '1' ELSE '0' END, '')
    OVER (PARTITION BY conv_id ORDER BY pos) AS nulls FROM t),
k AS (SELECT *, md5(said) || nulls AS h FROM p),
inner_h AS (SELECT DISTINCT pos, h FROM k WHERE pos < n),
w AS (SELECT * FROM k WHERE pos = n),
m AS (SELECT w.*, row_number() OVER (PARTITION BY w.pos, w.h ORDER BY conv_id NULLS LAST) AS first
      FROM w LEFT JOIN inner_h i ON i.pos = w.pos AND i.h = w.h WHERE i.pos IS NULL)
SELECT conv_id, n::BIGINT AS n_turns, said AS text FROM m WHERE first = 1
"""
