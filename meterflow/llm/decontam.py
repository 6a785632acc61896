"""Benchmark decontamination (operator 4), DataFrame functions only.

Method: a hash set of normalised test n-grams. Benchmark items are cut into
windows of ``WINDOW`` consecutive words (a shorter item is one window); windows
are grouped, so a window that several items share is one entry with its items.
While windows and the item ids they carry are at most ``BROADCAST_ROWS`` together, the
set is broadcast with its ids. With more ids than that the windows alone are broadcast
and the ids are joined to a document's distinct windows afterwards, the documents of a
window dealt over salts; with more windows, positions are shuffled. Every position of every document is scanned once
per window length in use: a 64-bit hash of the word hashes is looked up, hits are
verified by a second, independent 128-bit hash of the words themselves, and the
words any window covers are counted from the merged spans.

The text is read once: a position of -1 per document rides along with the
windows and carries its word count, so documents without a hit need no join.

Cases: null and empty texts (and texts without a word character) have no words
and are clean; empty and null items have no window; repeated documents are
counted once and returned as often as they came; a null item_id counts as an
item but adds nothing to items_sha256; with an empty benchmark all is clean;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.common import DOC_COLS, ascii_lower, cut, let, text_key

WINDOW = 13
# Fixed by the contract, for lower-cased text: words are runs of digits, a-z and
# everything beyond ASCII, so they are cut at runs of the other ASCII characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 2_000_000  # about 100 MB as a hashed relation
_SALTS = 16  # tasks that the documents of one window are dealt over
_REF = ["len", "gram", "check_a", "check_b"]  # what names a window
_SHARE = 20  # contaminated: at least one in this many words


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _grams(hashes: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` word hashes, in order. Runs of 1, 2, 4 ...
    words are hashed from two halves; a length is put together from those, the
    longest first, so a position costs a few hashes instead of ``length``."""
    def joined(a: Column, b: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, shift + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    def build(doubles: list[Column]) -> Column:
        size = 1 << (len(doubles) - 1)
        if 2 * size <= length:
            return let(joined(doubles[-1], doubles[-1], size), lambda d: build([*doubles, d]))
        out, have = doubles[-1], size
        for k in reversed(range(len(doubles) - 1)):
            if have + (1 << k) <= length:
                out = joined(out, doubles[k], have)
                have += 1 << k
        # the last length - 1 places have no full run
        return F.slice(out, 1, F.greatest(F.size(doubles[0]) - length + 1, F.lit(0)))

    return let(hashes, lambda h: build([h]))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, gram, check_a, check_b, items): distinct windows of the benchmark.
    items holds the ids of the items that have the window; it is bounded by the
    benchmark, which is the small side."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").withColumn(
        "h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("len", F.least(F.size("w"), F.lit(window)))
    grams = F.when(F.col("len") == window, _grams(F.col("h"), window))
    for n in range(1, window):
        grams = grams.when(F.col("len") == n, _grams(F.col("h"), n))
    w = w.select("item_id", "len", "w", F.posexplode(grams).alias("at", "gram"))
    words_of = F.slice("w", F.col("at") + 1, F.col("len"))
    return (w.select("item_id", "len", "gram", _check(words_of, 1).alias("check_a"), _check(words_of, 2).alias("check_b"))
            .groupBy("len", "gram", "check_a", "check_b").agg(F.sort_array(F.collect_set(
                F.struct(F.col("item_id").alias("id")))).alias("items")))


def _check(gram: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.array_join(gram, " "))


def _prepared(benchmark: DataFrame, window: int) -> tuple[DataFrame, int, int]:
    """The windows, written to the shared folder, their number and that of their ids."""
    grams = cut(windows(benchmark, window))
    n = grams.agg(F.count("*").alias("windows"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("ids")).first()
    return grams, n.windows, n.ids


def _without_ids(grams: DataFrame) -> DataFrame:
    """Windows whose items are the window's own name."""
    return grams.select(*_REF, F.array(F.struct(*_REF)).alias("items"))


def _with_ids(per: DataFrame, grams: DataFrame) -> DataFrame:
    """per with the window names in items replaced by the ids of their items. A window
    that very many documents hold is joined in ``_SALTS`` places."""
    own = [c for c in per.columns if c != "items"]
    refs = per.select(*own, F.explode_outer("items").alias("r")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(_SALTS)))
    ids = grams.select(*[F.col(c).alias(f"__{c}") for c in _REF], F.col("items").alias("__ids"),
                       F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt"))
    same = F.col("salt") == F.col("__salt")
    for c in _REF:
        same = same & (F.col(f"r.{c}") == F.col(f"__{c}"))
    return refs.join(ids, same, "left").groupBy(*own).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("__ids")))).alias("items")).select(*per.columns)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, n_words, at, len, items): one row with at = -1 per document
    and one per position where a benchmark window starts, items naming the window."""
    grams, total, _ = _prepared(benchmark, window)
    return _scan(docs, _without_ids(grams), total <= broadcast_rows)


def _scan(docs: DataFrame, grams: DataFrame, small: bool) -> DataFrame:
    lengths = [r.len for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()]  # at most `window`
    d = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # one array of grams per length behind an entry 0 for the document itself
    n = F.size("h")
    grams_of, at, length, upto = [F.array(F.lit(0).cast("long"))], F.lit(-1), F.lit(0), F.lit(0)
    for size in sorted(lengths):
        last = F.greatest(n - size + 1, F.lit(0))
        grams_of.append(_grams(F.col("h"), size))
        here = (F.col("p") > upto) & (F.col("p") <= upto + last)
        at, length = F.when(here, F.col("p") - upto).otherwise(at), F.when(here, F.lit(size)).otherwise(length)
        upto = upto + last
    d = d.select("doc_id", "key", "w", "h", F.posexplode(F.concat(*grams_of)).alias("p", "g"))
    d = d.select("doc_id", "key", "w", at.alias("at"), length.alias("l"), "g")
    on = (F.col("g") == F.col("gram")) & (F.col("l") == F.col("len"))
    own = ["doc_id", "key", "n_words", "at", F.col("l").alias("len"), "items"]
    gram = F.slice("w", F.greatest("at", F.lit(1)), F.col("l"))
    verified = (_check(gram, 1) == F.col("check_a")) & (_check(gram, 2) == F.col("check_b"))
    if small:
        # the words stay in the scanning task and are looked at for hits only
        found = d.join(F.broadcast(grams), on, "left").where("at = -1 or gram is not null")
        return found.where((F.col("at") == -1) | verified).withColumn("n_words", F.size("w")).select(*own)
    # a set too large to broadcast: only positions are shuffled, hits go back to their words
    narrow = d.withColumn("n_words", F.size("w")).select("doc_id", "key", "n_words", "at", "l", "g")
    found = narrow.join(grams, on, "left").where("at = -1 or gram is not null")
    text = docs.select(F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"),
                       words(F.col("text")).alias("w")).dropDuplicates(["__id", "__key"])
    sure = found.where("at > 0").join(
        text, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).where(verified)
    return found.where("at = -1").select(*own).unionAll(sure.select(*own))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, copies, n_words, n_hit, items, contaminated): one row per
    distinct (doc_id, text)."""
    grams, total, ids = _prepared(benchmark, window)
    fits = total + ids <= broadcast_rows
    found = _scan(docs, grams if fits else _without_ids(grams), total <= broadcast_rows)
    own = ["doc_id", "key", "n_words"]
    # merged spans: a window adds what lies beyond the furthest end before it
    before = (Window.partitionBy(*own).orderBy("at", "len")
              .rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("at") + F.col("len")
    spans = found.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
    spans = spans.withColumn("new", F.when(F.col("at") > 0, F.greatest(
        end - F.greatest("at", "seen"), F.lit(0))).otherwise(0))
    per = spans.groupBy(*own).agg(
        F.sum((F.col("at") == -1).cast("long")).alias("copies"),
        F.sum("new").cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per = per if fits else _with_ids(per, grams)
    return per.withColumn("contaminated", (F.col("n_hit") > 0) & (_SHARE * F.col("n_hit") >= F.col("n_words")))


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    per = judged(docs, benchmark)
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x["id"].cast("string"))), ",")
    out = per.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
                     F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                     "contaminated", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the contaminated ones, as judged by the contract."""
    bad = (judged(docs, benchmark).where("contaminated")
           .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")))
    keyed = docs.select(*DOC_COLS, text_key(F.col("text")).alias("__k"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")),
                      "left_anti").select(*DOC_COLS)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs whose text has lost the words that benchmark windows cover: text is
    the normalised words that stay, joined by a space, where a document was hit;
    other documents keep their text as it is."""
    found = hits(docs, benchmark, **kw).where("at > 0")
    covered = (found.withColumn("pos", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)))
               .groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
               .agg(F.collect_set("pos").alias("__gone")))
    keyed = docs.withColumn("__k", text_key(F.col("text")))
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("__id"))
                        & (F.col("__k") == F.col("__key")), "left")
    w = words(F.col("text"))
    stays = F.array_except(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), F.col("__gone"))
    cleaned = F.array_join(F.transform(stays, lambda i: F.get(w, i - 1)), " ")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cleaned)
                             ).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w
  FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw),
dn AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
       FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT rid, i, dn.n, item_id FROM dn JOIN g ON g.n = dn.n AND array_to_string(w[i:i + dn.n - 1], ' ') = gram),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM h),
hit AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
