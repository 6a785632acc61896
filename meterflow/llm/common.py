"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.session import work_root

DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
# Fixed by the operators' contracts: a run of anything but ASCII white space.
WS_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other scripts)."""
    return F.translate(c, _UPPER, _UPPER.lower())


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    work_root(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, unless their path has it already
    (PYTHONPATH, or the working folder under a local master)."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, context = os.path.dirname(package), spark.sparkContext
    there = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        there.append(os.getcwd())
    if root in map(os.path.abspath, there) or context.applicationId in _SHIPPED:
        return
    # the driver's own temporary file; Spark hands copies to the executors
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), os.path.basename(package)), "zip",
                                  root, os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an outer expression
    would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(df: DataFrame, **cols: Column) -> DataFrame:
    """df with further columns that the optimizer cannot copy into later lambdas
    (a one-row generator stands between)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def id_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(m)


def text_key(text: Column) -> Column:
    """128-bit key of a text, so that rows can be joined back without the text.
    Null differs from the empty text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"),
                    F.xxhash64(text, F.lit(2)).alias("b"),
                    text.isNull().alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): (node, root), root the least
    node of its component; nodes without an edge are absent.

    Alternating large-star / small-star rounds: every round hangs each node's
    larger neighbours on its least neighbour, so the edge count never grows and
    paths shrink quickly. Each round is two aggregates (map-side combined, so a
    hub is reduced before the shuffle) and two joins that adaptive execution may
    split at a hub. Rounds are checkpointed; only a (count, hash) pair per round
    reaches the driver.
    """
    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())

    e = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            .where("lo < hi").distinct())
    sig = signature(e)
    while sig[0]:
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.join(least, "u").where("v > u")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        least2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least2, "hi").where("lo <> m")
                 .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .unionAll(least2.select(F.col("m").alias("lo"), "hi")))
        new = cut(small.distinct())
        new_sig = signature(new)
        if new_sig == sig:
            break
        e, sig = new, new_sig
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, hold: int, held: int,
                    per_class: int) -> DataFrame:
    """(doc_id, y, share, text, lang): at most per_class documents of each label,
    the least hashes first, one row each however often the doc_id stands in docs
    (that of the least text hash); rows with crc32(doc_id) % hold == held are never
    taken, the highest label of a doc_id counts. share: how many labelled rows one sampled row stands
    for. The sample's ids are bounded, so they may be broadcast."""
    known = (labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()
                          & (id_mod(F.col("doc_id"), hold) != held))
             .groupBy("doc_id").agg(F.max((F.col(column) > 0).cast("int")).alias("y")))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
             .withColumn("share", F.lit(max(1.0, sizes.get(y, 0) / per_class))) for y in (0, 1)]
    ids = parts[0].unionAll(parts[1])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("row")
    return (docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "y", "share").agg(first)
            .select("doc_id", "y", "share", "row.text", "row.lang"))


HOT_KEYS = 1000


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, spread: Column,
           hot: int = HOT_KEYS) -> DataFrame:
    """rows left joined to dim (one row per ``keys``, never null), without a hot key.

    ``weight`` bounds how many rows may ask for a key: the ``hot`` heaviest keys
    (a fixed number, whatever the input) are broadcast, so a key in the shuffled
    join carries at most 1/hot of all weight; rows answered by the broadcast are
    dealt over the tasks by ``spread``. dim is read twice: pass a cut one. Adds the
    other columns of dim and ``hit``."""
    vals = [c for c in dim.columns if c not in keys and c != weight]
    found = F.struct(F.lit(True).alias("hit"), *vals)
    top = dim.orderBy(F.desc(weight), *keys).limit(hot).select(*keys, found.alias("__top"))
    out = rows.join(F.broadcast(top), keys, "left")
    out = out.withColumn("__deal", F.when(F.col("__top").isNull(), F.lit(0))
                         .otherwise(F.pmod(spread, F.lit(1 << 20)) + 1).cast("long"))
    # not a literal, which the optimizer would take out of the join keys
    rest = dim.select(*keys, found.alias("__rest"), F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__deal"))
    out = out.join(rest, [*keys, "__deal"], "left")
    pick = {c: F.coalesce(F.col(f"__top.{c}"), F.col(f"__rest.{c}")) for c in vals}
    hit = F.col("__top").isNotNull() | F.col("__rest").isNotNull()
    return out.withColumns(pick | {"hit": hit}).drop("__top", "__rest", "__deal")
