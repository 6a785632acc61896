"""Mixing sources to target weights (operator 1), DataFrame functions only.

Method: entropy balancing. Rates r_d in [0, cap] minimise sum c_d (r log r - r)
under one token constraint per source, sum size_d r_d = target; the divergence
weight of a document is c_d = size_d + mean size of its source. The convex dual
gives exponentially tilted rates r_d = min(cap, exp(l_s u_d)) with
u_d = size_d / c_d in (0, 1), so long documents are tilted, but never without
bound. The duals l_s are found by distributed Newton steps, bracketed so that a
step outside is replaced by bisection; sums are exact decimals, hence the same in
every run. Documents enter the steps as counts of equal (source, size), which
are bounded by the distinct sizes, not by the rows.

Rounding into copies: cells of equal (source, size) get whole copies by
systematic rounding along falling sizes; of ``OFFSETS`` starting points each
source takes the one whose words come nearest its target, and a few single
copies are moved to come nearer still. Inside a cell the extra copies go to the least
hashes of doc_id and text, counted in ``SALTS`` parts so that a hot cell is never
ordered in one task. Rows that agree in both are counted, not listed: where only some
of them get one copy more, as many as needed do, found by counts of ``TIES`` buckets
of a row number. Rows and their numbers are written once, so that every later step
sees the same ones.

Cases: null and empty texts have size 0 and rate 1 copy, taking no words; null
is a source of its own, last; rows with the same doc_id, null ones too, are decided
one by one, and which of several rows equal in doc_id and text takes a copy more is
open; empty tables give empty results; columns called size, source_size,
target, copies or taken are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import DOC_COLS, WS_WORD, cut, lookup

WEIGHTS = (1, 2, 3)
CAP = 3
OFFSETS = 128
SALTS = 256
TIES = 1024
CORRECTIONS = 6
MAX_STEPS = 60
TOLERANCE = 1e-7


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WS_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, mean, target) from (source, size, n): shares of all
    words by weight, water-filled where cap times the source's size is reached.

    Sources are sorted by the level at which they fill; level k is what the
    sources from k on would share if all before them were full, and the first k
    that its own cap allows gives the common level. One row per source: the
    unpartitioned windows see the source list only.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                      F.sum("n").alias("docs"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = (per.withColumn("w", w)
           .withColumn("full", F.lit(float(cap)) * F.col("source_size"))
           .withColumn("fills_at", F.col("full") / F.col("w")))
    by_fill = Window.orderBy("fills_at", F.asc_nulls_last("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
             / F.sum("w").over(after))
    per = per.withColumn("level", level).withColumn("k", F.row_number().over(by_fill))
    fits = F.when(F.col("level") <= F.col("fills_at") * (1 + 1e-12), F.col("k"))
    per = per.withColumn("common", F.min_by("level", fits).over(everything))
    return per.select("source", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"),
                      F.least(F.col("full"), F.col("w") * F.col("common")).alias("target"))


def _tilt() -> Column:
    return F.coalesce(F.try_divide(F.col("size"), F.col("size") + F.col("mean")), F.lit(0.0))


def _rate(cap: float) -> Column:
    return F.when(F.col("filled"), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.col("dual") * _tilt())))


def duals(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources with the dual of each one's token constraint (column dual).

    filled marks targets at the cap, where every rate is cap. Otherwise the
    smallest tilt any word can have, 1 / (1 + mean), bounds the dual on both
    sides; log(target / size) twice over starts the search.
    """
    ratio = F.try_divide("target", "source_size")
    lam = (sources.withColumn("filled", F.coalesce(ratio >= cap * (1 - 1e-9), F.lit(True)))
           .withColumn("lo", F.least(F.log(ratio), F.lit(0.0)) * (1 + F.col("mean")) - 1)
           .withColumn("hi", F.lit(math.log(cap)) * (1 + F.col("mean")) + 1)
           .withColumn("dual", 2 * F.log(ratio))
           .withColumn("gap", F.lit(1.0)))
    lam = cut(lam)
    keep = lam.columns
    for _ in range(MAX_STEPS):
        if not lam.where(f"not filled and gap > {TOLERANCE}").limit(1).count():
            break
        x = cells.join(lam.select(F.col("source").alias("s"), "mean", "dual", "filled"),
                       F.col("source").eqNullSafe(F.col("s"))).drop("s")
        taken = F.col("n") * F.col("size") * _rate(cap)
        slope = F.when(_rate(cap) < cap, taken * _tilt()).otherwise(0.0)
        sums = x.groupBy(F.col("source").alias("s")).agg(
            F.sum(taken.cast("decimal(38,6)")).cast("double").alias("f"),
            F.sum(slope.cast("decimal(38,6)")).cast("double").alias("df"))
        step = (lam.join(sums, F.col("source").eqNullSafe(F.col("s")))
                .withColumn("over", F.col("f") - F.col("target"))
                .withColumn("lo", F.when(F.col("over") < 0, F.col("dual")).otherwise(F.col("lo")))
                .withColumn("hi", F.when(F.col("over") < 0, F.col("hi")).otherwise(F.col("dual")))
                .withColumn("gap", F.try_divide(F.abs("over"), "target"))
                .withColumn("newton", F.col("dual") - F.col("over")
                            / F.when(F.col("df") > 0, F.col("df"))))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        lam = cut(step.withColumn("dual", F.when(F.col("filled") | (F.col("gap") <= TOLERANCE), F.col("dual"))
                                  .when(inside, F.col("newton"))
                                  .otherwise((F.col("lo") + F.col("hi")) / 2)).select(*keep))
    return lam


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes
    each document (0 to cap times)."""
    own = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in docs.columns if c not in own]
    return _mixed(docs.drop(*own).withColumns(_measures()), keep, weights, cap)


def _measures() -> dict[str, Column]:
    """What mixing needs to know of a row: its size, its place in the order of copies
    and a number of its own."""
    return {"size": _size(), "__h": F.xxhash64(F.lit(7), F.col("doc_id")),
            "__t": F.xxhash64(F.lit(11), F.col("text")), "__row": F.monotonically_increasing_id()}


def _mixed(rows: DataFrame, keep: list[str], weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    base = cut(rows.withColumn("__salt", F.pmod(F.xxhash64("__h", "__t"), F.lit(SALTS)).cast("int")))
    parts = cut(base.groupBy("source", "size", F.col("__salt").alias("salt")).agg(F.count("*").alias("n")))
    cells = cut(parts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    lam = duals(cells, targets(cells, weights, cap), cap)
    info = lam.select(F.col("source").alias("s"), "source_size", "mean", "target", "dual", "filled")
    rated = (cells.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("rate", _rate(cap))
             .withColumn("floor", F.least(F.floor("rate"), F.lit(cap)).cast("long"))
             .withColumn("wanted", F.col("n") * (F.col("rate") - F.col("floor"))))
    # systematic rounding along falling sizes, from each of OFFSETS starting points
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    rated = rated.withColumn("upto", F.sum("wanted").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    start = (F.col("o") + 0.5) / OFFSETS
    tried = (rated.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))))
             .withColumn("extra", _extra(start)))
    errors = tried.groupBy("source", "o").agg(
        F.abs(F.sum(F.col("size") * (F.col("n") * F.col("floor") + F.col("extra"))) - F.first("target")).alias("err"))
    best = errors.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("err", "o")).getField("o").alias("o"))
    chosen = (rated.join(best, F.col("source").eqNullSafe(F.col("s"))).drop("s")
              .withColumn("all", F.col("n") * F.col("floor") + _extra(start)))
    chosen = _corrected(chosen, cap)
    chosen = chosen.select(F.col("source").alias("s"), F.col("size").alias("z"), "n",
                           F.floor(F.col("all") / F.col("n")).alias("floor"),
                           (F.col("all") % F.col("n")).alias("extra"), "source_size", "target")
    # each salt part gets its share of the extra copies by running counts
    run = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("part_upto")
    share = lambda x: F.floor(x * F.col("extra") / F.col("n"))
    part = (parts.withColumnRenamed("n", "part_n")
            .withColumn("part_upto", F.sum("part_n").over(run))
            .join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
            .withColumn("part_extra", share(upto) - share(upto - F.col("part_n"))))
    part = part.select("s", "z", "salt", "floor", "part_extra", "source_size", "target")
    # the least (hash, text hash) of a part take one copy more: its threshold is the
    # key at which the running count of rows reaches the part's extra copies
    on = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("size") == F.col("z")) & (F.col("__salt") == F.col("salt"))
    keys = base.groupBy("source", "size", "__salt", "__h", "__t").agg(F.count("*").alias("rows"))
    rank = Window.partitionBy("source", "size", "__salt").orderBy("__h", "__t")
    keys = keys.withColumn("before", F.sum("rows").over(rank) - F.col("rows"))
    least = cut(keys.join(part.where("part_extra > 0"), on)
                .where("before < part_extra and part_extra <= before + rows")
                .select("s", "z", "salt", F.struct("__h", "__t").alias("__least"),
                        (F.col("part_extra") - F.col("before")).alias("some"), "rows"))
    decided = part.join(least.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("salt").alias("salt2"),
                                     "__least", (F.col("some") < F.col("rows")).alias("__some")),
                        F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2"))
                        & (F.col("salt") == F.col("salt2")), "left")
    decided = decided.select("s", "z", "salt", "floor", "__least", "__some", "source_size", "target")
    key = F.struct("__h", "__t")
    out = base.join(decided, on)
    more = (key < F.col("__least")) | ((key == F.col("__least")) & ~F.col("__some"))
    chosen = cut(_some_rows(base, least.where("some < rows")))
    if not chosen.isEmpty():
        out = out.join(chosen, "__row", "left")
        more = more | F.coalesce("__chosen", F.lit(False))
    copies = F.col("floor") + F.coalesce(more.cast("long"), F.lit(0))
    return out.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def _some_rows(base: DataFrame, groups: DataFrame) -> DataFrame:
    """(__row, __chosen) of exactly ``some`` rows of each group of rows that agree in
    source, size, doc_id and text."""
    def key(source, size, h, t):
        return F.xxhash64(F.lit(3), F.col(source).isNull(), source, size, h, t)
    wanted = cut(groups.select(key("s", "z", "__least.__h", "__least.__t").alias("k"), "some", "rows"))
    rows = lookup(base.select(key("source", "size", "__h", "__t").alias("k"), "__row"), wanted, ["k"], "rows",
                  F.xxhash64("__row")).where("hit")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("__row"), F.lit(TIES)))
    upto = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("k", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n"))
    at = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("__row"))
    return (rows.withColumn("at", at).join(before, ["k", "bucket"]).where(F.col("before") + F.col("at") <= F.col("some"))
            .select("__row", F.lit(True).alias("__chosen")))


def _corrected(cells: DataFrame, cap: float) -> DataFrame:
    """cells with column all (copies of the whole cell) moved towards the target:
    in each round a source gives or takes one copy of the document size that leaves
    the least distance, as long as that is less than before."""
    whole = Window.partitionBy("source")
    for _ in range(CORRECTIONS):
        left = F.col("target") - F.sum(F.col("size") * F.col("all")).over(whole)
        cells = cells.withColumn("left", left)
        step = (F.when((F.col("left") > 0) & (F.col("all") < cap * F.col("n")), 1)
                .when((F.col("left") < 0) & (F.col("all") > 0), -1))
        cells = cells.withColumn("step", step).withColumn(
            "off", F.abs(F.col("left") - F.col("step") * F.col("size")))
        first = F.min(F.when((F.col("size") > 0) & (F.col("off") < F.abs("left")),
                             F.struct("off", "size"))).over(whole)
        cells = cells.withColumn("first", first).withColumn(
            "all", F.when(F.col("first.size") == F.col("size"), F.col("all") + F.col("step")).otherwise(F.col("all")))
        cells = cells.drop("left", "step", "off", "first")
    return cells


def _extra(start: Column) -> Column:
    """Whole copies of a cell: the running sum of wanted copies, cut at whole
    numbers from the given starting point; at most one per document."""
    return F.least(F.col("n"), F.floor(F.col("upto") + start)
                   - F.floor(F.col("upto") - F.col("wanted") + start)).cast("long")


def op1(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "source").withColumns(_measures()).drop("text")
    return _mixed(rows, ["doc_id"]).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"),
        "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, with how often (column copies)."""
    return mix(docs.select(*DOC_COLS)).where("copies > 0").drop("source_size", "target", "size")
