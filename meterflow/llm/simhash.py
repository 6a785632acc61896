"""SimHash near-duplicate groups (operator 6).

Method: segment-popcount embedding. A 64-bit fingerprint is cut into 32 two-bit
segments; its image is the vector of their bit counts. One differing bit moves
one count by at most one, so the Manhattan distance of two images never exceeds
the bit distance of the fingerprints. Images are joined on a grid: the segments
are dealt to ``groups`` groups, and when at most ``max_bits`` counts move in all,
some group moves by at most ``max_bits // groups``; a cell is a group with its
counts, and points meet in every cell within that radius. Candidates that pass
the Manhattan bound are verified on the real bits.

Cells are bounded in number (3 ** segments per group); a cell with more points
than ``BLOCK`` is dealt out as pairs of blocks, so no task holds a whole hot
cell. Inside a block pair only links that join two still separate parts are
emitted (a spanning forest), never all pairs of a dense group; connectivity is
exact. Equal fingerprints are one point.

Cases: null and empty texts have no words and get fingerprint 0; texts of fewer
words than the shingle length are one shingle; repeated rows stay repeated; a
component without any non-null doc_id has component_id null; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import DOC_COLS, components, cut, lookup, ship, text_key

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = 32
BLOCK = 8192
# Beyond this many distinct fingerprints the finer grid (3 groups, radius 1)
# costs less: more cells to emit per point, far fewer candidates per cell.
FINE_GRID_FROM = 2_000_000
_HASH_BLOCK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: majority bits over the XXH64 of its k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    first, last = starts[:len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist()
    n = len(first)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASH_BLOCK):
        hs = np.array([h(joined[a:b], SEED) for a, b in
                       zip(first[at:at + _HASH_BLOCK], last[at:at + _HASH_BLOCK])], np.uint64)
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp): fp the SimHash as a signed long, key that of the text."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fps = np.array([fingerprint(t, k) for t in texts], np.uint64)
            yield pd.Series(fps.view(np.int64))

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), simhash("text").alias("fp"))


def _grid(groups: int) -> list[list[int]]:
    """Segment numbers of each group, dealt round robin."""
    return [list(range(g, SEGMENTS, groups)) for g in range(groups)]


def _cells(points: DataFrame, groups: int, radius: int) -> DataFrame:
    """(fp, g, c, home): the cells of every point. With radius 1 a point also
    visits (home = false) the cells one count higher; of two points one count
    apart, the lower one visits the other's home."""
    seg = [F.bit_count(F.shiftrightunsigned("fp", 2 * s).bitwiseAND(F.lit(3))) for s in range(SEGMENTS)]
    homes, visits = [], []
    for g, members in enumerate(_grid(groups)):
        base = F.lit(g).cast("long")
        for s in members:
            base = base * 3 + seg[s]
        homes.append(F.struct(F.lit(g).alias("g"), base.alias("c"), F.lit(True).alias("home")))
        if radius:
            for i, s in enumerate(members):
                step = 3 ** (len(members) - 1 - i)
                visits.append(F.when(seg[s] < 2, F.struct(F.lit(g).alias("g"), (base + step).alias("c"),
                                                          F.lit(False).alias("home"))))
    out = points.select("fp", F.explode(F.array(*homes, *visits)).alias("x")).where("x is not null")
    return out.select("fp", "x.g", "x.c", "x.home")


def _links(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within a (b None) or between a and b."""
    pts = a if b is None else np.concatenate((a, b))
    fps = pts.view(np.uint64)
    halves = fps & np.uint64(0x5555555555555555), (fps >> np.uint64(1)) & np.uint64(0x5555555555555555)
    image = halves[0] + halves[1]  # 32 two-bit counts
    low = np.uint64(0x5555555555555555)
    label = np.arange(len(pts))
    out = []
    for i in range(len(a)):
        lo = i + 1 if b is None else len(a)
        # Manhattan distance: one for each differing count, one more where 0 meets 2
        x = image[lo:] ^ image[i]
        high = x >> np.uint64(1)
        bound = np.bitwise_count((x | high) & low) + np.bitwise_count(high & ~x & low)
        near = lo + np.flatnonzero((bound <= max_bits) & (label[lo:] != label[i]))
        if not len(near):
            continue
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits]
        if not len(near):
            continue
        merged, at = np.unique(label[near], return_index=True)
        out += [(int(pts[i]), int(pts[near[j]])) for j in at]
        label[np.isin(label, merged)] = label[i]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK,
          fine: bool | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever bit
    distances of at most max_bits connect."""
    ship(fps.sparkSession)
    if fine is None:
        fine = fps.count() >= FINE_GRID_FROM
    radius = 1 if fine else 0
    groups = max_bits // (radius + 1) + 1
    cells = _cells(fps, groups, radius)
    # proven bound: at most groups * 3 ** ceil(32 / groups) cells
    hot = (cells.groupBy("g", "c").agg(F.count("*").alias("n")).where(F.col("n") > block)
           .select("g", "c", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = (cells.join(F.broadcast(hot), ["g", "c"], "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("g", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "home", "fp"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the block pair that may go on in the next batch
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            keys = pdf[["g", "c", "i", "j"]].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = np.concatenate(([0], cuts))
            pairs = _pairs(pdf, keys, edges[:-1], edges[1:], max_bits)
            rest = pdf.iloc[edges[-1]:]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")
        if rest is not None and len(rest):
            keys = rest[["g", "c", "i", "j"]].to_numpy(np.int64)
            yield pd.DataFrame(_pairs(rest, keys, [0], [len(rest)], max_bits), columns=["a", "b"], dtype="int64")

    # sorted partitions: a block pair is contiguous and holds about 2 * block points
    order = ["g", "c", "i", "j"]
    return (dealt.repartition(*order).sortWithinPartitions(*order)
            .mapInPandas(link, "a long, b long"))


def _pairs(pdf: pd.DataFrame, keys: np.ndarray, starts, ends, max_bits: int) -> list[tuple[int, int]]:
    """Links of each block pair, rows starts[k] to ends[k]."""
    own, fps, homes = pdf["own"].to_numpy(), pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
    out = []
    for lo, hi in zip(starts, ends):
        if hi - lo < 2:
            continue
        i, j = keys[lo, 2], keys[lo, 3]
        fp, home = fps[lo:hi], homes[lo:hi]
        if i == j:
            out += _links(fp[home], None, max_bits)
            if not home.all():
                out += _links(fp[home], fp[~home], max_bits)
        else:
            one, two = own[lo:hi] == i, own[lo:hi] == j
            out += _links(fp[one & home], fp[two], max_bits)
            if not home.all():
                out += _links(fp[two & home], fp[one & ~home], max_bits)
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, key, fp, component_id, rep): one row per document. rep is the
    (doc_id, key) of the component's kept document: least non-null doc_id."""
    narrow = cut(with_fingerprints(docs, k))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    points = cut(narrow.groupBy("fp").agg(F.min(order).alias("least")))
    comp = components(links(points.select("fp"), max_bits))
    rooted = cut(points.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    reps = cut(rooted.groupBy("root").agg(F.min("least").alias("rep"), F.count("*").alias("points")))
    by_fp = lookup(rooted, reps, ["root"], "points", F.xxhash64("fp")).select("fp", "rep")
    return (narrow.join(by_fp, "fp")
            .select("doc_id", "key", "fp", F.col("rep.doc_id").alias("component_id"),
                    F.struct("rep.doc_id", "rep.key").alias("rep")))


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without all but one of each near-duplicate group."""
    kept = (near_duplicates(docs, k, max_bits)
            .select(F.col("rep.doc_id").alias("__id"), F.col("rep.key").alias("__key")).distinct())
    keyed = docs.select(*DOC_COLS, text_key(F.col("text")).alias("__k"))
    return (keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id"))
                       & (F.col("__k") == F.col("__key")), "left_semi")
            .dropDuplicates(["doc_id", "__k"]).select(*DOC_COLS))
