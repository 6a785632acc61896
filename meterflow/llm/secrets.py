"""Secret scans (operator 2), DataFrame functions only.

Base rules find assignments, access keys and long hex runs. The method adds
spans: two character Markov chains over the key alphabet, one of random strings
and one of ordinary identifiers, score every further long run of key characters;
the stretches of a run where the log-likelihood ratio of the chains favours
"random" are added, so a path or name around a key does not hide it.
The chains are trained from labelled samples of the whole table: values that the
base rules found are random strings; words and identifiers by their shape
(``ORDINARY``, of any length, outside base spans) are ordinary. A key has not that
shape, so it does not train the chain that would clear it. Every distinct value
counts once, however often it is copied. Both chains start from what is known
without samples: the random one from all key alphabets, the ordinary one from how
letters and digits follow each other in names. Distinct values and transition
counts are reduced over all rows by Spark; only the two alphabet-squared tables
(at most 2 * 66 * 66 counts) reach the driver, and the model goes back as one
constant array. Steps to or from a separator (+ / _ -) favour neither chain. Stretches
without letters, as phone and card numbers, or without digits are left alone:
neither is a key's shape.

Positions come from splitting a text at the matches, so nothing is exploded and
no row leaves its partition. Running sums are taken in blocks, so a text with
very many matches stays near linear.

Cases: null and empty texts have no spans (base_sha256 of the empty text);
positions count code points, also beyond the basic plane; repeated rows repeat;
without any base span the random chain is that of the key alphabets; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import DOC_COLS, cut, fixed, let

# Base rules, fixed by the contract: (kind, pattern, counted group, its least length).
# Where a match is a whole run of its characters, the least length is in the pattern:
# a shorter run is then no match, as it would be dropped.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
# Alphabets of keys, each as likely as the next before any sample is seen.
_LOWER, _UPPER, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
KEYS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER, _DIGITS + _UPPER, ALPHABET[:62], ALPHABET)
# Ordinary by shape: every part between separators is a number or a word (camel
# case too) with at most four digits behind it.
_WORD = r"(?:[0-9]+|(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4})"
ORDINARY = rf"^[+/_-]*{_WORD}(?:[+/_-]+{_WORD})*[+/_-]*$"
EXTRA = "random"
LEAST = 16
# Mean log-likelihood ratio per transition (nats) from which a stretch is added.
THRESHOLD = 0.5
# A stretch ends where the sum of ratios (less THRESHOLD each) falls this far below
# its highest: about ten steps of ordinary text.
FALL = 12.0
# It is widened on both sides to a separator or the run's end: within the first
# distance where the whole then still is above THRESHOLD, else within the second.
REACHES = (512, 8)
MASK = "[SECRET]"
_BLOCK = 512


def _running(x: Column) -> Column:
    """Sums of x before each entry (an array of ints)."""
    def fold(part: Column, first: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), first.cast("int").alias("sum"))
        return F.aggregate(part, start, lambda a, v: F.struct(
            F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + v).cast("int").alias("sum")),
            lambda a: a["out"])

    def blockwise(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(x) / _BLOCK).cast("int"))
        part = lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, v: a + v))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), fold(sums, F.lit(0)).alias("first")),
                                     lambda z: fold(part(z["b"]), z["first"])))

    return let(x, blockwise)


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end, value) of the pattern's leftmost matches whose
    group has at least `least` characters."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    def place(m: Column) -> Column:
        # m: the matches as (gap before, match, value); there is one gap more at the end
        steps = F.transform(m, lambda x: F.char_length(x["g"]) + F.char_length(x["w"]))
        return F.zip_with(_running(steps), m, lambda before, x: let(
            (before + F.char_length(x["g"])).cast("int"), lambda start: F.struct(
                start.alias("start"), F.lit(kind).alias("kind"),
                (start + F.char_length(x["w"])).cast("int").alias("end"), x["v"].alias("value"))))

    matches = F.filter(F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v")),
                       lambda x: x["w"].isNotNull())
    spans = F.filter(let(matches, place), lambda s: F.char_length(s["value"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(text: Column) -> Column:
    """Base spans: an ordered array of (start, kind, end, value)."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(t, p, g, n, i) for i, (_, p, g, n) in enumerate(RULES)]))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with __base (base spans), __rest (the text without them) and __runs:
    the candidates, cut at base spans; what is left of a run is one if it is long
    enough."""
    d = fixed(docs, __base=scan(F.col("text")))
    d = fixed(d, __rest=blanked(F.col("text"), F.col("__base")))
    return fixed(d, __runs=_found(F.col("__rest"), CANDIDATE, 0, LEAST, len(RULES)))


def scanned(docs: DataFrame) -> DataFrame:
    d = with_spans(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col("__base").alias("base"), F.col("__runs").alias("runs"))


def blanked(text: Column, base: Column) -> Column:
    """The text with its base spans (ordered) overwritten by blanks, so that
    positions stay."""
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(base, first, lambda a, s: F.when(s["end"] > a["end"], F.struct(
        s["end"].alias("end"),
        F.concat(a["out"], F.array(
            F.substring(text, a["end"] + 1, F.greatest(s["start"] - a["end"], F.lit(0))),
            F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], a["end"])))).alias("out"))).otherwise(a))
    rest = let(done, lambda d: F.concat(F.array_join(d["out"], ""),
                                        F.substring(text, d["end"] + 1, F.char_length(text))))
    return F.when(F.size(base) > 0, rest).otherwise(F.coalesce(text, F.lit("")))


def ordinary(docs: DataFrame) -> DataFrame:
    """(v): the distinct words and identifiers outside base spans."""
    d = with_spans(docs.select("text")).select("__rest")
    runs = F.array_distinct(F.split("__rest", r"[^A-Za-z0-9+/_-]+"))
    return d.select(F.explode(runs).alias("v")).where(F.col("v").rlike(ORDINARY)).distinct()


def _steps(values: DataFrame) -> list[list[float]]:
    """How often one character of the alphabet follows another in the values."""
    k = len(ALPHABET)
    out = [[0.0] * k for _ in range(k)]
    steps = (values.where("length(v) > 1")
             .select(F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1),
                                           lambda i: F.substring(F.col("v"), i, F.lit(2)))).alias("pair")))
    for r in steps.groupBy("pair").agg(F.count("*").alias("n")).collect():  # at most alphabet squared
        a, b = ALPHABET.find(r.pair[0]), ALPHABET.find(r.pair[1])
        if a >= 0 and b >= 0:
            out[a][b] += r.n
    return out


def _random_start(a: str, b: str) -> float:
    return sum(len(x) ** -2.0 for x in KEYS if a in x and b in x)


def _ordinary_start(a: str, b: str) -> float:
    kind = [next(i for i, x in enumerate((_LOWER, _UPPER, _DIGITS)) if c in x) for c in (a, b)]
    # small, capital, digit after each of them
    return ((1.0, 0.02, 0.05), (1.0, 1.0, 0.05), (0.02, 0.02, 1.0))[kind[0]][kind[1]]


def train(docs: DataFrame, found: DataFrame) -> list[float]:
    """Log ratios of the two chains, entry (a * size + b) for the step a to b.
    What is known beforehand weighs as much as the samples in the random chain (the
    base rules see few alphabets), a quarter of them in the ordinary one (prose has
    few digits), and never less than one count for each character."""
    chars = ALPHABET[:62]

    def chain(counts: list[list[float]], start, weight: float) -> list[list[float]]:
        out = []
        for i, a in enumerate(chars):
            seen, known = counts[i][:len(chars)], [start(a, b) for b in chars]
            mass = max(float(len(chars)), weight * sum(seen))
            total, scale = sum(seen) + mass, mass / sum(known)
            out.append([(n + p * scale) / total for n, p in zip(seen, known)])
        return out

    base = found.select(F.explode("base").alias("s")).select(F.col("s.value").alias("v")).distinct()
    rand = chain(_steps(base), _random_start, 1.0)
    plain = chain(_steps(ordinary(docs)), _ordinary_start, 0.25)
    k, n = len(ALPHABET), len(chars)
    return [math.log(rand[a][b] / plain[a][b]) if a < n and b < n else 0.0 for a in range(k) for b in range(k)]


def added(runs: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """The stretches of the candidate runs that the chains call random."""
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def ratios(v: Column) -> Column:
        # entry i: the step from character i to character i + 1, less the threshold
        codes = F.transform(F.split(v, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return let(codes, lambda x: F.zip_with(
            F.slice(x, 1, F.char_length(v) - 1), F.slice(x, 2, F.char_length(v) - 1),
            lambda a, b: F.coalesce(F.get(table, a * k + b), F.lit(0.0)) - threshold))

    def state(at, start, total, best, end, out) -> Column:
        return F.struct(at.cast("int").alias("at"), start.cast("int").alias("start"), total.cast("double").alias("sum"),
                        best.cast("double").alias("best"), end.cast("int").alias("end"), out.alias("out"))

    def closed(s: Column) -> Column:
        return F.when(s["best"] > 0, F.concat(s["out"], F.array(F.struct(
            s["start"].alias("a"), s["end"].alias("b"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        """Character at + 1 follows; start, end: the stretch with the highest sum (end exclusive)."""
        zero, at = F.lit(0.0), s["at"] + 1
        return let(s["sum"] + x, lambda total:
                   F.when((total <= 0) | (total < s["best"] - FALL), state(at, at, zero, zero, at, closed(s)))
                   .when(total > s["best"], state(at, s["start"], total, total, at + 1, s["out"]))
                   .otherwise(state(at, s["start"], total, s["best"], s["end"], s["out"])))

    def stretches(steps: Column) -> Column:
        zero = F.lit(0)
        return F.aggregate(steps, state(zero, zero, zero, zero, zero, none), step, closed)

    def total(steps: Column, z: Column) -> Column:
        return F.aggregate(F.slice(steps, z["a"] + 1, z["b"] - z["a"] - 1), F.lit(0.0), lambda s, x: s + x)

    def near(v: Column, z: Column, reach: int) -> Column:
        before = F.reverse(F.substring(v, F.greatest(z["a"] - reach, F.lit(0)) + 1, F.least(z["a"], F.lit(reach))))
        after = F.substring(v, z["b"] + 1, F.lit(reach))
        left, right = (F.char_length(F.regexp_extract(x, "^[A-Za-z0-9]*", 0)) for x in (before, after))
        return F.struct(
            (z["a"] - F.when((left < reach) | (z["a"] == reach), left).otherwise(0)).cast("int").alias("a"),
            (z["b"] + F.when((right < reach) | (z["b"] + reach == F.char_length(v)), right).otherwise(0))
            .cast("int").alias("b"))

    def widened(v: Column, steps: Column, z: Column) -> Column:
        far, close = (near(v, z, reach) for reach in REACHES)
        return let(far, lambda w: F.when(total(steps, w) > 0, w).otherwise(close))

    def random(v: Column, steps: Column, z: Column) -> Column:
        part = F.substring(v, z["a"] + 1, z["b"] - z["a"])
        return ((z["b"] - z["a"] >= LEAST) & part.rlike("[0-9]") & part.rlike("[A-Za-z]") & (total(steps, z) > 0))

    def parts(r: Column) -> Column:
        v = r["value"]
        found = let(ratios(v), lambda steps: let(stretches(steps), lambda zs: F.filter(
            F.array_distinct(F.transform(zs, lambda z: widened(v, steps, z))), lambda z: random(v, steps, z))))
        return F.transform(found, lambda z: F.struct(
            (r["start"] + z["a"]).alias("start"), r["kind"].alias("kind"), (r["start"] + z["b"]).alias("end"),
            F.substring(v, z["a"] + 1, z["b"] - z["a"]).alias("value")))

    keyed = F.filter(runs, lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[A-Za-z]"))
    return F.flatten(F.transform(keyed, parts))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in RULES], F.lit(EXTRA))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(docs: DataFrame) -> DataFrame:
    found = cut(scanned(docs))
    spans = F.array_sort(F.concat("base", added(F.col("runs"), train(docs, found))))
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k][0]}")

    counts = [count(k) for k in range(len(RULES))]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(spans).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by ``MASK`` (touching spans by
    one); n_chars follows the text. Nothing else changes, no document goes."""
    model = train(docs, cut(scanned(docs)))
    d = with_spans(docs.select(*DOC_COLS))
    d = fixed(d, __spans=F.array_sort(F.concat("__base", added(F.col("__runs"), model))))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("__spans", first, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        F.when(s["start"] > a["end"], F.concat(a["out"], F.array(
            F.substring(F.col("text"), a["end"] + 1, s["start"] - a["end"]), F.lit(MASK))))
        .when((s["start"] == 0) & (a["end"] == 0), F.array(F.lit(MASK)))
        .otherwise(a["out"]).alias("out")))
    hit = F.size("__spans") > 0
    d = fixed(d, __done=F.when(hit, done))
    text = F.concat(F.array_join(F.col("__done.out"), ""),
                    F.substring(F.col("text"), F.col("__done.end") + 1, F.char_length("text")))
    return (d.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
            .withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*DOC_COLS))
