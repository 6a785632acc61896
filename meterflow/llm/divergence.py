"""Source divergence audit (operator 12).

Which sources of a language use other words than the rest, and which words. Terms
that at least ``MIN_DOCS`` documents of a language hold are found by iceberg prefix
refinement: on levels of ``LEVELS`` bytes and then twice as many each, the
documents that hold a longer term with a given prefix are counted; a prefix below
the threshold goes, and with it every longer one, before the next level is shuffled.
A term is complete on the first level it fits in; its own counts are shuffled only if
its prefix of the level before is left, and it is kept if they reach the threshold.

Texts are read once, dealt by (language, source, row) ranges, so that the counts of a
source meet in few tasks and a hot source is spread over many. Each task cuts them with byte tables, counts its terms by
source, the documents holding them, and for every level the documents holding each
prefix, in dictionaries of at most ``HELD`` entries that are handed on when full
(counts add up, as a document lies within one text), and writes them to a table in
the shared folder. Everything after that is joins and sums of those counts. Prefixes
left are broadcast up to ``BROADCAST`` of them, beyond that joined by a shuffle.

A group's share of a term is smoothed and scaled to an integer, as the contract
says; ``f`` is the integer chi-square term of share p against q. For the pair part
each task keeps one matrix of sums per language over its terms (a bucket of the
language's terms, ``DEAL`` buckets each, streamed) and emits sources x sources sums.

Cases: null text, lang or source is the empty string; a language without kept
terms still lists its pairs, with value 0; a lone source has no pair; repeated
rows are documents of their own; very long texts are cut in slices of ``SLICE``
bytes at separators; equal values go by item; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import cut, lookup, ship
from meterflow.session import new_run_dir

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
LEVELS = 4
HELD = 600_000
SLICE = 1 << 20
BROADCAST = 200_000
DEAL = 64
# Letters stay (A-Z in lower case), so do all bytes of characters beyond ASCII.
_CUT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: bytes) -> Iterator[list]:
    """Terms of a text, a slice at a time."""
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= SLICE else text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


_COUNTS = "lang string, source string, cut boolean, level long, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (lang, source, text) to _COUNTS: for a complete term its
    occurrences n and documents docs by source, level the first it fits in; for a
    prefix (``cut``) of level bytes the documents that hold a longer term with it."""
    used: dict[tuple, tuple[Counter, Counter]] = {}
    prefixes: dict[tuple, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in used.items():
            size = np.fromiter(map(len, n), np.int64, len(n))
            level = LEVELS << np.ceil(np.log2(np.maximum(size / LEVELS, 1))).astype(np.int64)
            yield _batch(lang, source, False, level, n, n.values(), map(docs.__getitem__, n))
        for (lang, level), docs in prefixes.items():
            yield _batch(lang, "", True, np.full(len(docs), level), docs, docs.values(), docs.values())
        used.clear()
        prefixes.clear()

    entries = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, docs = used.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(n)
            held: set = set()
            for terms in _slices(text.as_py().translate(_CUT)):
                n.update(terms)
                held.update(terms)
            docs.update(held)
            entries += len(n)
            level = LEVELS
            while held := {t for t in held if len(t) > level}:
                p = prefixes.setdefault((lang, level), Counter())
                entries -= len(p)
                p.update({t[:level] for t in held})
                entries += len(p)
                level *= 2
            if entries > HELD:
                yield from flush()
                entries = 0
    yield from flush()


def _batch(lang: str, source: str, cut: bool, level: np.ndarray, terms, n, docs) -> pa.RecordBatch:
    size = len(terms)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(lang, size), pa.repeat(source, size), pa.repeat(cut, size), pa.array(level.astype(np.int64)),
         pa.array(list(terms), pa.binary()), pa.array(np.fromiter(n, np.int64, size)),
         pa.array(np.fromiter(docs, np.int64, size))], ["lang", "source", "cut", "level", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """The counts of every task (_COUNTS), as a table in the shared folder."""
    ship(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    path = new_run_dir(docs.sparkSession, "divergence")
    by_source = (docs.select(*named, F.monotonically_increasing_id().alias("row"))
                 .repartitionByRange("lang", "source", "row").select("lang", "source", "text"))
    by_source.mapInArrow(_count, _COUNTS).write.partitionBy("cut").parquet(path)
    return docs.sparkSession.read.schema(_COUNTS).parquet(path)


def _left(rows: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    """Rows (lang, level, term) whose prefix of the level before is alive (n rows)."""
    rows = rows.withColumns({"above": F.floor(F.col("level") / 2), "prefix": F.expr("substring(term, 1, level div 2)")})
    keys = ["lang", "above", "prefix"]
    if n <= BROADCAST:
        out = rows.join(F.broadcast(alive.select(*keys)), keys, "left_semi")
    else:
        out = lookup(rows, alive, keys, "docs", F.xxhash64("term")).where("hit").drop("hit")
    return out.drop("above", "prefix")


def alive_prefixes(counts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, above, prefix, docs): the prefixes of every level (``above``) with at
    least MIN_DOCS documents, and their number."""
    cuts, level, alive, total = counts.where("cut"), LEVELS, None, 0
    last, n = None, 0
    while True:
        cand = cuts.where(F.col("level") == level)
        if last is not None:
            cand = _left(cand, last, n)
        last = cut(cand.groupBy("lang", F.col("level").alias("above"), F.col("term").alias("prefix"))
                   .agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS))
        n = last.count()
        total += n
        alive = last if alive is None else alive.unionAll(last)
        if not n:
            return alive, total
        level *= 2


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, n_term, uses): complete terms of at least MIN_DOCS documents,
    their occurrences, and those by source (one entry a source)."""
    alive, n = alive_prefixes(counts)
    whole = counts.where("not cut")
    rows = whole.where(F.col("level") == LEVELS).unionByName(_left(whole.where(F.col("level") > LEVELS), alive, n))
    # one shuffle for both sums
    by_source = (rows.repartition("lang", "term").groupBy("lang", "term", "source")
                 .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_term"),
                                                  F.collect_list(F.struct("source", "n")).alias("uses"))
            .where(F.col("docs") >= MIN_DOCS).drop("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact beyond 64 bits."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (n + v).cast("decimal(20,0)")) + 1


def chi(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one (lang, bucket) after another: first the language's own row (v,
    sources, ns: their sums), then its terms. Emits (lang, source, item, value)."""
    lang, names, at, v, ns, total, wide, rows = None, None, {}, 0, None, None, [], 1

    def score() -> None:
        p = 1 + SCALE * (np.array(wide, np.int64) + 1) // (ns + v)
        for g in range(len(ns)):
            d = p[:, g:g + 1] - p
            total[g] += (d * d // p).sum(0)
        wide.clear()

    def close() -> Iterator[pd.DataFrame]:
        if wide:
            score()
        if total is not None and total.any():
            g, o = np.nonzero(total)
            yield pd.DataFrame({"lang": lang, "source": names[g], "item": names[o], "value": total[g, o]})

    for df in parts:
        for row in df.itertuples(index=False):
            if row.kind == 0:
                yield from close()
                lang, v, ns, names = row.lang, row.v, np.array(row.n, np.int64), np.array(row.sources, object)
                at = {s: i for i, s in enumerate(names)}
                total, rows = np.zeros((len(ns), len(ns)), np.int64), max(1, (1 << 20) // len(ns))
                continue
            dense = np.zeros(len(ns), np.int64)
            dense[[at[s] for s in row.sources]] = row.n
            wide.append(dense)
            if len(wide) >= rows:
                score()
    yield from close()


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank), by the contract of operator 12."""
    terms = cut(kept_terms(counted(docs)))
    used = terms.select("lang", "term", "n_term", F.inline("uses"))
    sized = used.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_term").alias("of_lang"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = cut(groups.join(sized, ["lang", "source"], "left").join(langs, "lang", "left")
                 .na.fill(0, ["of_source", "v", "of_lang"]))

    # terms of a group above the language's share
    rows = lookup(used, groups.withColumn("weight", F.col("of_source")), ["lang", "source"], "weight", F.xxhash64("term"))
    term = (rows.withColumns({"p": share(F.col("n"), F.col("of_source"), F.col("v")),
                              "q": share(F.col("n_term"), F.col("of_lang"), F.col("v"))}).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
                    chi(F.col("p"), F.col("q")).alias("value")))

    # sums over all kept terms, by pairs of sources: all such pairs are in the result
    flat = terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(DEAL)).cast("int").alias("bucket"), F.lit(1).alias("kind"),
                        F.lit(0).cast("long").alias("v"), F.col("uses.source").alias("sources"), F.col("uses.n").alias("n"))
    head = groups.where("v > 0").groupBy("lang", "v").agg(F.collect_list(F.struct("source", "of_source")).alias("c"))
    head = head.select("lang", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("bucket"), F.lit(0).alias("kind"),
                       "v", F.col("c.source").alias("sources"), F.col("c.of_source").alias("n"))
    value = (head.unionByName(flat).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "kind")
             .mapInPandas(_pairs, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pair = (groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
            .where("source <> item").join(value, ["lang", "source", "item"], "left")
            .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
    return pair.withColumn("rank", F.row_number().over(best)).unionByName(term)


def op12(docs: DataFrame) -> DataFrame:
    return divergence(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT lang, source, id, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
u AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(v.v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM u GROUP BY ALL) s USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + 1000000000 * (coalesce(u.n, 0) + 1) // (g.n + g.v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN u USING (lang, source, term)),
l AS (SELECT k.lang, k.term, 1 + 1000000000 * (sum(p.n) + 1)::HUGEINT // (any_value(t.n) + any_value(t.v)) AS q
  FROM k JOIN p USING (lang, term) JOIN (SELECT lang, sum(n)::HUGEINT AS n, any_value(v) AS v FROM g GROUP BY lang) t USING (lang)
  GROUP BY k.lang, k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
