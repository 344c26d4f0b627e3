"""Mixing sources to target weights, in DataFrame functions alone.

A source's share p of all tokens gets the weight p^alpha / sum(p^alpha). The exponent is bisected until the weights
meet a target: an entropy, or a limit on repetition (the most epochs of any source). The tokens of each source are
then realised as a budget of whole epochs and one part of an epoch. An epoch is a permutation of the source's blocks
(documents dealt by a hash), and of the documents in each block; the part takes documents in that order while they
fit. Where the order is cut, sums are taken by block, then by sub-block, then by document, so that no task orders a
whole source.

Sources are never collected: each pass of the bisection is one row of sums over the table of sources, five levels at
a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of a document's key that name its block, and of the key within an epoch that name a sub-block.
DIGITS = 3
LEVELS, PASSES = 31, 11


def token_count(text: F.Column) -> F.Column:
    """Words of a text, the tokens that shares are counted in unless a column is given; zero for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\t\\n\\x0B\\f\\r ]+", -1), lambda x: x != "")), F.lit(0)).cast("long")


def _sums(shares: DataFrame, alphas: list[float]) -> list:
    """For each exponent: sum(p^a), sum(p^a ln p), the largest p^(a-1)."""
    p = F.col("share")
    cells = []
    for a in alphas:
        power = F.pow(p, F.lit(a))
        cells += [F.sum(power), F.sum(power * F.log(p)), F.max(power / p)]
    row = shares.where("share > 0").agg(*cells).first()
    return [tuple(row[3 * i : 3 * i + 3]) for i in range(len(alphas))]


def entropy(alpha: float, sums: tuple) -> float:
    """Entropy (nats) of the weights at an exponent."""
    import math

    z, weighted, _ = sums
    return math.log(z) - alpha * weighted / z


def repetition(alpha: float, sums: tuple, budget: float | None, top: float) -> float:
    """Most epochs of any source at a budget of so many times all tokens; without a budget (None: the least that takes
    every source once), the most epochs for each one of the largest source, whose share is ``top``."""
    return sums[2] / top ** (alpha - 1) if budget is None else budget * sums[2] / sums[0]


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = 1.0) -> float:
    """Bisect the exponent in [0, 1] (1: the shares as they are, 0: equal weights).

    The smallest exponent (the most even mix) that repeats no source more than ``max_repetition`` times at a budget of
    ``budget`` times all tokens, or the largest whose entropy is at least ``target_entropy``. With both, the larger:
    repetition is a limit. Where no exponent meets the target the end nearest to it is taken.
    """
    if target_entropy is None and max_repetition is None:
        raise ValueError("a target entropy or a limit on repetition is needed")
    top = shares.agg(F.max("share")).first()[0]
    if not top:
        return 1.0

    def search(too_even) -> float:
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            inner = [low + (high - low) * (i + 1) / (LEVELS + 1) for i in range(LEVELS)]
            flags = [too_even(a, s) for a, s in zip(inner, _sums(shares, inner), strict=True)]
            at = 0
            while at < LEVELS and flags[at]:
                at += 1
            low, high = ([low, *inner][at], [*inner, high][at])
        return high

    found = []
    ends = _sums(shares, [0.0, 1.0])
    if max_repetition is not None:
        over = lambda a, s: repetition(a, s, budget, top) > max_repetition
        found.append(0.0 if not over(0.0, ends[0]) else search(over))
    if target_entropy is not None:
        even = lambda a, s: entropy(a, s) >= target_entropy
        found.append(1.0 if even(1.0, ends[1]) else 0.0 if not even(0.0, ends[0]) else search(even))
    return max(found)


def weights(slim: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> DataFrame:
    """One row for each source: tokens, share, weight, ``quota`` (tokens to emit), ``full`` epochs and ``rest``.

    ``budget`` is a multiple of all tokens; None is the least budget that gives every source one whole epoch, and
    ``max_repetition`` then limits the ratio of the most and the fewest epochs. A source without tokens gets one epoch.
    """
    totals, _ = common.written(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(everything, 1))))
    alpha = exponent(shares, target_entropy, max_repetition, budget)
    z = _sums(shares, [alpha])[0][0] or 1.0
    top = shares.agg(F.max("share")).first()[0] or 1.0
    size = everything * (z * top ** (1 - alpha) if budget is None else budget)
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    quota = F.round(F.col("weight") * F.lit(size)).cast("long")
    counted = shares.withColumn("weight", weight).withColumn("quota", quota)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int")
    return counted.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens"))


def _key(*parts: F.Column | str) -> F.Column:
    return F.md5(F.concat_ws("|", *parts))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", tokens: F.Column | None = None, text: str = "text", target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = 1.0, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with ``_epoch`` (from 1), ``_block`` and ``_order`` (the
    order of the source's epoch: the block's key, then the document's).

    ``tokens`` counts a row's tokens; words by default. Rows without a source are a source of their own; a null id is
    a value like others. Repeated rows get equal keys: they are taken together or not at all. Documents of no tokens
    follow the order like others. An empty table gives an empty result. Other columns of docs stay as they are, whatever
    their names; one named as a new column gives way to it. See :func:`weights` for the targets.
    """
    counted = F.coalesce(token_count(F.col(text)) if tokens is None else tokens.cast("long"), F.lit(0).cast("long"))
    name = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null"))
    key = _key(F.lit(str(seed)), ident)
    slim = docs.select(name.alias("source"), key.alias("key"), counted.alias("tokens"))
    slim, _ = common.written(slim, "mixing")
    plan, _ = common.written(weights(slim, target_entropy, max_repetition, budget), "mixing-plan")
    quotas = common.bounded(plan.select("source", "full", "rest"))
    ends = common.bounded(_cuts(slim, quotas))
    taken = {c.lower() for c in docs.columns}
    free = lambda c: next(n for n in (f"_mix_{c}" + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken)
    origin, own, full, rest, cut, epoch = map(free, ("source", "key", "full", "rest", "cut", "epoch"))
    marked = docs.withColumns({origin: name, own: key})
    joined = marked.join(quotas.toDF(origin, full, rest), origin).join(ends.toDF(origin, cut), origin, "left")
    block = F.substring(own, 1, DIGITS)
    last = F.concat(_key(F.col(origin), F.col(full) + 1, block), _key(F.col(own), F.col(full) + 1))
    times = F.col(full) + F.when(last <= F.col(cut), 1).otherwise(0)
    out = joined.withColumn(epoch, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    order = F.concat(_key(F.col(origin), epoch, block), _key(F.col(own), epoch))
    kept = [c for c in docs.columns if c.lower() not in ("_epoch", "_block", "_order")]
    return out.select(*kept, F.col(epoch).alias("_epoch"), block.alias("_block"), order.alias("_order"))


def _cuts(slim: DataFrame, quotas: DataFrame) -> DataFrame:
    """source and ``cut``: the order (block key, document key) of the last document that its part of an epoch takes.

    Each step sums what lies in one level of the order, finds the group in which the rest ends, and goes on inside it.
    """
    joined = slim.join(quotas, "source").where("rest > 0")
    keyed = joined.withColumn("order", F.concat(_key(F.col("source"), F.col("full") + 1, F.substring("key", 1, DIGITS)), _key(F.col("key"), F.col("full") + 1)))
    keyed = keyed.select("source", "rest", "order", "tokens")
    left, inside = None, keyed
    for digits in (32, 32 + DIGITS, 32 + 2 * DIGITS, 64):
        part = F.substring("order", 1, digits)
        sums = inside.withColumn("part", part).groupBy("source", "rest", "part").agg(F.sum("tokens").alias("n"))
        window = Window.partitionBy("source").orderBy("part")
        running = sums.withColumn("upto", F.sum("n").over(window)).select("source", "rest", "part", "n", "upto")
        running, _ = common.written(running, "mixing-sums")
        whole = running.where("upto <= rest").groupBy("source").agg(F.max("part").alias("whole"))
        left = whole if left is None else left.unionByName(whole)
        if digits == 64:
            break
        split = running.where("upto > rest AND upto - n <= rest").groupBy("source").agg(F.min(F.struct("part", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("at"))
        split = common.bounded(split.select("source", F.col("at.part").alias("part"), F.col("at.rest").alias("rest")))
        inside = inside.drop("rest").withColumn("part", part).join(split, ["source", "part"]).drop("part")
    # a group's own name stands for all that it begins; "g" is greater than every hexadecimal digit
    return left.groupBy("source").agg(F.max(F.rpad("whole", 64, "g")).alias("cut"))


#: The registered query: at most so many times the epochs of the largest source, at the least budget that takes all.
MAX_REPETITION = 1.5


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every emission of a document in a mix that takes each source once and repeats none more than 1.5 times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs, max_repetition=MAX_REPETITION, budget=None)
    return out.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("epoch_order"))


ORACLE_SQL = f"""
WITH slim AS (
  SELECT doc_id, source AS src, coalesce(source, chr(0) || 'null') AS s,
         md5('0|' || coalesce(cast(doc_id AS VARCHAR), chr(0) || 'null')) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '')) END AS n
  FROM documents),
tot AS (SELECT s, sum(n)::DOUBLE AS t FROM slim GROUP BY s),
al AS (SELECT max(t) AS top, min(t) AS low, sum(t) AS everything FROM tot WHERE t > 0),
ex AS (SELECT *, CASE WHEN top = low THEN 0.0 ELSE greatest(0.0, 1.0 - ln({MAX_REPETITION}) / ln((top / everything) / (low / everything))) END AS a FROM al),
plan AS (SELECT s, t, round(pow(t / everything, a) / pow(top / everything, a) * top)::BIGINT AS quota FROM tot, ex),
q AS (SELECT s, floor(quota / t)::INT AS f, quota - floor(quota / t)::INT * t::BIGINT AS rest FROM plan),
o AS (SELECT slim.*, f, rest, md5(slim.s || '|' || (f + 1) || '|' || substr(k, 1, 3)) || md5(k || '|' || (f + 1)) AS last FROM slim JOIN q ON slim.s = q.s),
c AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY last RANGE UNBOUNDED PRECEDING) AS upto FROM o),
e AS (SELECT *, unnest(range(1, f + 1 + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, src AS source, epoch::INT AS epoch, substr(k, 1, 3) AS block,
       md5(s || '|' || epoch || '|' || substr(k, 1, 3)) || md5(k || '|' || epoch) AS epoch_order
FROM e
"""
