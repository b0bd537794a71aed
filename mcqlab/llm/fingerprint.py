"""Document fingerprints by consistent weighted sampling.

A text is its terms (runs of characters other than white space and controls) weighted by
how often they occur. For each of SAMPLES and each term, hashes of the term give
r and c from Gamma(2, 1) and b from [0, 1); with weight w,

    t = floor(ln w / r + b),   ln a = ln c - r * (t - b + 1),

and the term of the smallest a is the sample (Ioffe's scheme). a depends on term and t
alone, so two texts have the same smallest a with a chance equal to their generalised
Jaccard similarity, sum of smaller weights / sum of larger weights. A fingerprint is 32
bits of each smallest a; likeness is the share of equal samples.

Native: all of it is DataFrame expressions. Texts are shuffled once, into ranges of ids;
what follows (successors, terms, samples, likeness to the successor) needs that
partitioning only. The random numbers of the CACHED commonest terms are made once and
broadcast, those of other terms where they occur, by the same expressions.

Defined results: a null text is empty; a text without a term has the fingerprint of the
empty one; rows of one id follow each other by text; a row without an id has no next
document, so its edited text is its first half and ``near_next`` compares with the empty
text; repeated rows count each; very long texts count whole; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mcqlab.llm.common import stored

SAMPLES, GROUP = 40, 4
CACHED = 16_384
PER_RANGE, LEAST_RANGES, MOST_RANGES = 1000, 32, 16_384
_BLANK = "".join(map(chr, range(33)))


def terms(text: Column) -> Column:
    """The terms in text order; the empty term for a text without one."""
    return F.split(F.btrim(text, F.lit(_BLANK)), r"[\x00-\x20]+")


def ranges(docs: DataFrame, doc_id: str, per_range: int = PER_RANGE) -> list[int]:
    """The smallest ids of ranges of about ``per_range`` documents, of larger ones beyond MOST_RANGES."""
    n = docs.agg(F.count(doc_id)).first()[0]
    parts = min(MOST_RANGES, max(LEAST_RANGES, n // per_range))
    got = docs.select(F.min(doc_id).alias("low"), F.percentile_approx(doc_id, [i / parts for i in range(parts)], 10 * parts).alias("p")).first()
    return sorted({got["low"], *got["p"]}) if n else []


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", per_range: int = PER_RANGE) -> DataFrame:
    """(range, pos, guest, id, t, next): every document with the text of the next one by id; after the last comes the first.

    A range ends with a guest, the first document of the following range, so each
    document finds its successor within its range. ``next`` is null for guests and for
    rows without an id.
    """
    lows = ranges(docs, doc_id, per_range)
    bounds = F.lit(lows) if lows else F.array().cast("array<long>")
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    at = F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("t"), F.lit(LEAST_RANGES))).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col("id"))) - 1).cast("int")
    placed = own.withColumn("range", at)
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(lows)))).alias("range"), F.lit(True).alias("guest"))
    seats = F.array(F.struct("range", F.lit(False).alias("guest")), F.when(F.get(bounds, F.col("range")) == F.col("id"), before))
    seated = placed.select("id", "t", F.explode(seats).alias("s")).where("s IS NOT NULL").select("id", "t", "s.*")
    order = Window.partitionBy("range").orderBy("guest", "id", "t")
    following = F.when(~F.col("guest") & F.col("id").isNotNull(), F.lead("t").over(order))
    # the number is stated, because the work is in what follows, not in the size of the rows
    dealt = seated.repartition(max(LEAST_RANGES, len(lows)), "range")
    return dealt.select("range", F.row_number().over(order).alias("pos"), "guest", "id", "t", following.alias("next"))


def edited(text: Column, following: Column) -> Column:
    """A text whose last half (rounded down) gives way to as much of the beginning of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(following, F.lit("")), F.lit(1), half))


def edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", per_range: int = PER_RANGE) -> DataFrame:
    """(range, pos, guest, id, n_chars, sha, t, e): documents and their edited texts, e being empty for guests."""
    e = F.when(F.col("guest"), F.lit("")).otherwise(edited(F.col("t"), F.col("next")))
    rows = with_next(docs, text, doc_id, per_range).withColumn("e", e)
    return rows.select("range", "pos", "guest", "id", F.length("t").cast("long").alias("n_chars"), F.unhex(F.sha2("e", 256)).alias("sha"), "t", "e")


def _uniform(seed: Column, high: bool) -> Column:
    bits = F.shiftrightunsigned(seed, 32) if high else seed.bitwiseAND(F.lit(2**32 - 1))
    return (bits.cast("double") + 0.5) * F.lit(2.0**-32)


def draws(key: Column, j: int) -> dict[str, Column]:
    """r, ln c and b of a key in the j-th sample of its group."""
    h = [F.xxhash64(key, F.lit(3 * j + i)) for i in range(3)]
    gamma = [-F.ln(_uniform(x, True) * _uniform(x, False)) for x in h[:2]]  # a sum of two exponentials
    return {"r": gamma[0], "c": F.ln(gamma[1]), "b": _uniform(h[2], True)}


def _draws() -> dict[str, Column]:
    return {f"{k}{j}": v for j in range(GROUP) for k, v in draws(F.col("key"), j).items()}


def _grouped(rows: DataFrame, samples: int) -> DataFrame:
    """A row for each group of samples; the key tells term and group."""
    own = rows.select("*", F.explode(F.array(*map(F.lit, range(samples // GROUP)))).alias("g"))
    return own.withColumn("key", F.col("term").bitwiseXOR(F.col("g").cast("long")))


def common_draws(docs: DataFrame, text: str, samples: int, cached: int = CACHED) -> DataFrame:
    """The draws of the commonest terms: cached * samples / GROUP rows at most."""
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("w")).groupBy(F.xxhash64("w").alias("term")).count()
    common = counts.orderBy(F.desc("count"), "term").limit(cached).select("term")
    return _grouped(common, samples).select("key", *(v.alias(k) for k, v in _draws().items())).dropDuplicates(["key"])


def weighted_terms(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """(keys, term, w0, w1, ...): the weights of the hashed terms in each of the texts, 0 where a term does not occur."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(t).alias("x")) for i, t in enumerate(texts))))
    words = rows.select(*keys, each.alias("s")).select(*keys, "s.which", F.explode(terms(F.col("s.x"))).alias("w"))
    return words.groupBy(*keys, F.xxhash64("w").alias("term")).agg(*(F.count_if(F.col("which") == i).alias(f"w{i}") for i in range(len(texts))))


def signatures(weights: DataFrame, keys: list[str], common: DataFrame, samples: int, n: int) -> DataFrame:
    """(keys, term, w0, ...) of n texts -> (keys, s0, ...): 32 bits of the smallest a of each sample, for each text."""
    known = F.broadcast(common.select(F.col("key").alias("known"), *(F.col(k).alias(f"{k}_") for k in _draws())))
    rows = _grouped(weights, samples).join(known, F.col("key") == F.col("known"), "left")
    ready = rows.select(*keys, "g", *(F.col(f"w{i}") for i in range(n)), *(F.ln(F.col(f"w{i}").cast("double")).alias(f"l{i}") for i in range(n)), *(F.coalesce(f"{k}_", v).alias(k) for k, v in _draws().items()))

    def least(i: int, j: int) -> Column:
        r, c, b = (F.col(f"{x}{j}") for x in "rcb")
        t = F.when(F.col(f"w{i}") == 1, F.lit(0)).otherwise(F.floor(F.col(f"l{i}") / r + b))
        return F.min(F.when(F.col(f"w{i}") > 0, c - r * (t - b + 1))).alias(f"a{i}_{j}")

    part = ready.groupBy(*keys, "g").agg(*(least(i, j) for i in range(n) for j in range(GROUP)))
    short = [F.array(*(F.xxhash64(f"a{i}_{j}").bitwiseAND(F.lit(2**32 - 1)) for j in range(GROUP))).alias(f"s{i}") for i in range(n)]
    whole = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", *short))).alias("p"))
    return whole.select(*keys, *(F.flatten(F.col(f"p.s{i}")).alias(f"s{i}") for i in range(n)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprinted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = SAMPLES, cached: int = CACHED, per_range: int = PER_RANGE) -> DataFrame:
    """docs -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    if samples % GROUP or samples <= 0:
        raise ValueError(f"samples: a multiple of {GROUP}")
    keys = ["range", "pos", "guest", "id", "n_chars", "sha"]
    weights = weighted_terms(edits(docs, text, doc_id, per_range), keys, ["t", "e"])
    common = stored(common_draws(docs, text, samples, cached))  # read twice
    both = signatures(weights, keys, common, samples, 2)
    blank = docs.sparkSession.range(1).select(F.lit(0).alias("id"), F.xxhash64(F.lit("")).alias("term"), F.lit(1).alias("w0"))
    empty = F.lit(signatures(blank, ["id"], common, samples, 1).first()["s0"])
    order = Window.partitionBy("range").orderBy("pos")
    after = F.when(F.col("id").isNull(), empty).otherwise(F.lead("s0").over(order))
    return both.withColumn("after", after).where("NOT guest").select(
        F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), fingerprint(F.col("s0")).alias("fingerprint"), fingerprint(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"), likeness(F.col("s0"), F.col("after")).alias("near_next"),
    )
