"""Conversation prefix trie (operator 11).

Every distinct sequence of first turns is a node, named by a 128-bit rolling hash
(the exclusive or of position-salted hashes of role and text). Sums over subtrees
come from a centroid decomposition of the parent-edge forest:

* A node's weight is the number of conversations through it, so the weight of its
  whole subtree (turns at or after it, over its members) falls out of the
  aggregate that makes the nodes, and every node weighs at least 1.
* In a component of weight ``total`` the nodes whose subtree weighs more than half
  lie on one path from the top; the deepest is the centroid. Its child pieces weigh
  at most half, and so does what stays above.
* A round finds the centroids of all components, tells every node its piece (the
  prefix of its owning conversation one turn below the centroid), totals the pieces,
  and adds the sum at and below the centroid to the nodes of the centroid-to-top
  path. log2(turns / ``LOCAL``) rounds leave components of weight ``LOCAL`` or less,
  which one task each finishes the same way in memory.

Skew: turns are numbered by a range sort that splits a long conversation, and even
equal rows, over tasks; rolling hashes go by blocks of ``BLOCK`` turns; every join
is by node, by (component, conversation, block of turns) or through
``common.lookup``, whose hot keys are a fixed number. Digests of members go by
blocks of ``BLOCK`` ids, streamed in order through one task per node, because
SHA-256 cannot be split; such a task holds one block at a time.

Cases: rows with a null conv_id take no part; null role or text is the empty
string; null turns come first; equal turn numbers go by role, then by md5 of the
text; repeated rows are turns of their own; ids below zero belong to c - c % 20
with the sign of c; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import WS_WORD, cut, lookup

BLOCK = 4096
LOCAL = 256


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, x, y, words) of every turn, pos from 1, and (conv_id, n)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("r"), F.md5(text).alias("m"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"),
        F.regexp_count(text, F.lit(WS_WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.asc_nulls_first("turn"), "r", "m", "row"]
    # the id after the sort counts up along the whole order
    t = cut(t.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "x", "y", "words", F.monotonically_increasing_id().alias("i"))
            .withColumn("part", F.shiftright("i", 33)))
    spans = t.groupBy("part", "conv_id").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    rows = (t.join(spans, ["part", "conv_id"])
            .select("conv_id", (F.col("i") - F.col("first") + F.col("before") + 1).alias("pos"), "x", "y", "words"))
    return rows, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, x, y, words) of the rebuilt conversations, and (conv_id, len)
    of all of them, turnless ones too."""
    rows, convs = numbered(turns)
    rows, convs = cut(rows), cut(convs)
    plan = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"),
                        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = (rows.where("conv_id % 20 = 0 and pos <= 3").withColumnRenamed("conv_id", "base")
             .join(plan.select("base", "conv_id", "taken"), "base").where("pos <= taken")
             .select("conv_id", "pos", "x", "y", "words"))
    # own turns move by taken - h: a join by (conversation, block), never by conversation alone
    blocks = F.floor((F.col("pos") - 1) / BLOCK)
    moves = plan.select("conv_id", "h", "taken", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    own = (rows.withColumn("block", blocks).join(moves, ["conv_id", "block"]).where("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "x", "y", "words"))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return heads.unionAll(own), plan.select("conv_id", length.alias("len"))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, pa, pb, words, len): the prefix that ends with each turn
    and the one before it."""
    r = rows.select("conv_id", "pos", "words", F.xxhash64("x", "pos").alias("x"), F.xxhash64("pos", "y").alias("y"),
                    F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    carried = totals.select("conv_id", "block", F.coalesce(F.bit_xor("tx").over(upto), F.lit(0)).alias("cx"),
                            F.coalesce(F.bit_xor("ty").over(upto), F.lit(0)).alias("cy"))
    carried = carried.join(convs, "conv_id")
    roll = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("a", F.bit_xor("x").over(roll)).withColumn("b", F.bit_xor("y").over(roll))
    r = (r.join(carried, ["conv_id", "block"])
         .withColumn("a", F.col("a").bitwiseXOR(F.col("cx"))).withColumn("b", F.col("b").bitwiseXOR(F.col("cy"))))
    return r.select("conv_id", "pos", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"),
                    F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", "len")


def forest(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (a, b, depth, conv_id, n_convs, pa, pb, words, w), w the weight of the
    subtree; the root is (0, 0), without parent."""
    below = rows.groupBy(F.col("pos").alias("depth"), "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"),
        F.min("pb").alias("pb"), F.max("words").alias("words"), F.sum(F.col("len") - F.col("pos") + 1).alias("w"))
    zero = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") + 1).alias("w"))
            .where("n_convs > 0"))
    none = F.lit(None).cast("long")
    return below.unionByName(root.withColumns({"depth": zero, "a": zero, "b": zero, "pa": none, "pb": none, "words": zero}))


def _split(todo: DataFrame, paths: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over components (ta, tb): the centroids, done, and the other nodes
    in their new components."""
    half = "2 * w > total"
    best = F.max(F.struct("depth", "a", "b", "w"))
    cent = cut(todo.where(half).groupBy("ta", "tb").agg(best.alias("c"), F.max("total").alias("heavy")).select(
        "ta", "tb", "heavy", F.col("c.depth").alias("k"), F.col("c.a").alias("xa"), F.col("c.b").alias("xb"),
        F.col("c.w").alias("xw")))
    # the piece of a node: one turn below the centroid on the path of its conversation
    block = F.floor(F.col("depth") / BLOCK)
    spans = todo.select("ta", "tb", "conv_id", block.alias("block")).distinct()
    spans = lookup(spans, cent, ["ta", "tb"], "heavy", F.xxhash64("conv_id", "block")).drop("hit")
    step = paths.select(F.col("conv_id").alias("pc"), F.col("pos").alias("pp"), F.col("a").alias("na"),
                        F.col("b").alias("nb"), "pa", "pb")
    on = [F.col("conv_id") == F.col("pc"), F.col("k") + 1 == F.col("pp"),
          F.col("xa") == F.col("pa"), F.col("xb") == F.col("pb")]
    spans = spans.join(step, on, "left").drop("pc", "pp", "pa", "pb")
    center = (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb"))
    under = (F.col("depth") > F.col("k")) & F.col("na").isNotNull()
    lab = cut(todo.withColumn("block", block).join(spans, ["ta", "tb", "conv_id", "block"])
              .withColumns({"center": center, "under": under, "path": F.expr(half) & ~center})
              .withColumns({"ka": F.when(F.col("under"), F.col("na")).otherwise(F.col("ta")),
                            "kb": F.when(F.col("under"), F.col("nb")).otherwise(F.col("tb"))}))
    # totals of the pieces; a piece's weight is its top's
    pieces = lab.where("under or center").groupBy("ta", "tb", "ka", "kb", "under").agg(
        F.max("w").alias("piece"), F.max("total").alias("heavy"), *[F.sum(v).alias(f"s_{v}") for v in values])
    sums = pieces.groupBy("ta", "tb").agg(F.max("heavy").alias("heavy"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values])
    none = F.lit(None).cast("long")
    dim = pieces.where("under").select("ka", "kb", F.col("piece").alias("heavy"), "piece", *[none.alias(f"s_{v}") for v in values])
    dim = cut(dim.unionByName(sums.select(F.col("ta").alias("ka"), F.col("tb").alias("kb"), "heavy", none.alias("piece"),
                                          *[f"s_{v}" for v in values])))
    got = lookup(lab, dim, ["ka", "kb"], "heavy", F.xxhash64("a", "b"))
    raised = {f"acc_{v}": F.col(f"acc_{v}") + F.when(F.col("path") | F.col("center"), F.col(f"s_{v}")).otherwise(0)
              for v in values}
    upper = F.col("total") - F.col("xw")
    got = cut(got.withColumns(raised | {
        "w": F.when(F.col("path"), F.col("w") - F.col("xw")).otherwise(F.col("w")),
        "total": F.when(F.col("under"), F.col("piece")).otherwise(upper), "ta": F.col("ka"), "tb": F.col("kb")})
        .select("center", *todo.columns))
    return got.where("center").select("a", "b", *[F.col(f"acc_{v}").alias(v) for v in values]), got.where("not center").drop("center")


def _finish_one(w: list, parent: list, own: list, acc: list) -> None:
    """Centroid decomposition of one component in memory: acc[v][i] gains the sum
    of own[v] over the subtree of i. Nodes stand by depth, the top first."""
    stack = [list(range(len(w)))]
    while stack:
        comp = stack.pop()
        half = [i for i in comp if 2 * w[i] > w[comp[0]]]
        center = half.pop()
        piece: dict[int, list] = {}
        where: dict[int, int] = {}
        rest = []
        for i in comp:
            if i == center:
                continue
            p = parent[i]
            top = i if p == center else where.get(p)
            if top is None:
                rest.append(i)
            else:
                where[i] = top
                piece.setdefault(top, []).append(i)
        for values, sums in zip(own, acc):
            s = values[center] + sum(values[i] for i in where)
            sums[center] += s
            for i in half:
                sums[i] += s
        for i in half:
            w[i] -= w[center]
        stack.extend(piece.values())
        if rest:
            stack.append(rest)


def _finisher(values: list[str]):
    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(df: pd.DataFrame) -> pd.DataFrame:
            tops = list(zip(df["ta"], df["tb"]))
            keys = list(zip(df["a"], df["b"]))
            above = list(zip(df["pa"], df["pb"]))
            w, own = df["w"].tolist(), [df[v].tolist() for v in values]
            acc = [df[f"acc_{v}"].tolist() for v in values]
            start = 0
            for end in range(1, len(tops) + 1):
                if end == len(tops) or tops[end] != tops[start]:
                    at = {k: i for i, k in enumerate(keys[start:end])}
                    sums = [x[start:end] for x in acc]
                    _finish_one(w[start:end], [at.get(p, -1) for p in above[start:end]], [x[start:end] for x in own], sums)
                    for x, s in zip(acc, sums):
                        x[start:end] = s
                    start = end
            return pd.DataFrame({"a": df["a"], "b": df["b"]} | dict(zip(values, acc)))

        held = None  # the last component may go on in the next part
        for df in parts:
            df = df if held is None else pd.concat([held, df], ignore_index=True)
            if not len(df):
                continue
            last = (df["ta"] == df["ta"].iloc[-1]) & (df["tb"] == df["tb"].iloc[-1])
            held, ready = df[last], df[~last].reset_index(drop=True)
            if len(ready):
                yield solve(ready)
        if held is not None and len(held):
            yield solve(held.reset_index(drop=True))
    return finish


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, *values): each value (long) summed over the node's subtree. nodes: as
    ``forest`` gives them, all under one root, with the values; paths: as ``prefixes``."""
    total = nodes.where("depth = 0").select("w").first()
    zero = F.lit(0).cast("long")
    todo = nodes.select("a", "b", "depth", "conv_id", F.coalesce("pa", F.lit(0)).alias("pa"),
                        F.coalesce("pb", F.lit(0)).alias("pb"), F.col("w").cast("long").alias("w"), *values,
                        # not literals: the optimizer would take them out of the join keys
                        F.expr("a & 0L").alias("ta"), F.expr("b & 0L").alias("tb"), F.lit(total[0] if total else 0).cast("long").alias("total"),
                        *[zero.alias(f"acc_{v}") for v in values])
    done, small = [], []
    while not todo.where(F.col("total") > LOCAL).isEmpty():
        centers, rest = _split(todo.where(F.col("total") > LOCAL), paths, values)
        done.append(centers)
        small.append(todo.where(F.col("total") <= LOCAL))
        todo = rest
    for part in small:
        todo = todo.unionByName(part)
    by = ["ta", "tb"]
    schema = "a long, b long, " + ", ".join(f"{v} long" for v in values)
    out = (todo.drop("conv_id", "total").repartition(*by).sortWithinPartitions(*by, "depth", "a", "b")
           .mapInPandas(_finisher(values), schema))
    for part in done:
        out = out.unionByName(part)
    return out


def _digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, ends_sha256) from rows sorted by node and block."""
    node, h = None, None
    for df in parts:
        out = []
        for a, b, ids in zip(df["a"], df["b"], df["ids"]):
            if (a, b) == node:
                h.update(b",")
            else:
                if node:
                    out.append((*node, h.hexdigest()))
                node, h = (a, b), hashlib.sha256()
            h.update(ids.encode())
        yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, h.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    last = paths.where("pos = len").select("a", "b", "conv_id").unionAll(
        convs.where("len = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    blocks = last.groupBy("a", "b", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return (blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block")
            .mapInPandas(_digest, "a long, b long, ends_sha256 string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns)
    convs = cut(convs)
    paths = cut(prefixes(rows, convs))
    nodes = forest(paths, convs)
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"),
                               "saved": (F.col("n_convs") - 1) * F.col("words")})
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"),
                                                   F.col("conv_id").alias("parent_conv_id"), "n_children")
    sums = subtree_sums(nodes, paths, ["leaf", "saved"])
    out = (nodes.drop("leaf", "saved", "w", "words").join(sums, ["a", "b"])
           .join(ends(paths, convs), ["a", "b"], "left"))
    out = lookup(out, parents, ["pa", "pb"], "n_children", F.xxhash64("a", "b"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, max(pos) AS n, c - c % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda s, d: list_reduce(list_concat([xor(s, d)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda e, i: xor(e >> 1, 3988292384 * (e & 1))))) % 4 AS h FROM t GROUP BY c),
p AS (SELECT i.c, i.h, least(i.h, coalesce(b.n, 0)) AS taken FROM ids i LEFT JOIN ids b ON b.c = i.base),
w AS (
  SELECT p.c, t.pos AS q, r, x FROM p JOIN t ON t.c = p.c - p.c % 20 AND t.pos <= p.taken
  UNION ALL SELECT p.c, t.pos - p.h + p.taken, r, x FROM p JOIN t ON t.c = p.c AND t.pos > p.h),
k AS (SELECT c, q, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY q)) AS key,
    len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words, max(q) OVER (PARTITION BY c) AS n FROM w
  UNION ALL SELECT c, 0, '', 0, coalesce((SELECT max(q) FROM w WHERE w.c = p.c), 0) FROM p),
node AS (SELECT q, key, min(c) AS c, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (q = n), '')) AS ends FROM k GROUP BY q, key),
up AS (SELECT d.q, d.key, d.c, d.n_convs, d.words, d.ends, u.key AS pkey FROM node d
  LEFT JOIN k u ON u.c = d.c AND u.q = d.q - 1),
kids AS (SELECT q - 1 AS q, pkey AS key, count(*) AS n_children FROM up WHERE q > 0 GROUP BY ALL),
v AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (q, key)),
s AS (SELECT u.q, u.key, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved
  FROM v d JOIN k u ON u.c = d.c AND u.q <= d.q GROUP BY u.q, u.key)
SELECT v.c AS conv_id, v.q::BIGINT AS depth, f.c AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
  s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN s USING (q, key) LEFT JOIN node f ON f.q = v.q - 1 AND f.key = v.pkey
"""
