"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A paragraph (a line that is not blank) hashes to a wide vector:

* eight lanes modulo 2^32: the low and high halves of its XXH64 under four keys, which tell multisets apart, and
* 128 lanes modulo 2^16: for each of its different runs of three words, the bits of two 64-bit hashes of the run,
  which make multisets comparable, and one lane with the number of these runs. (A run that a paragraph repeats counts
  once there, so that repetitive paragraphs do not outweigh all others.)

A document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo the lane's power. So the order
of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

Likeness: with n runs and counts c of one bits, 2c - n is a random projection of the multiset of runs; the cosine of
two such vectors, cut to 0..1, estimates that of the multisets (standard error about 0.09 at zero). It is taken from
the counts before they are cut modulo 2^16, so that it holds for texts of any length. Equal fingerprints
have likeness one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEYS, SKETCHES = 4, 2
LANES = 64 * SKETCHES
WIDE, NARROW = 1 << 32, 1 << 16
#: Documents whose ids agree beyond this many low bits are ordered in one task.
BUCKET_BITS = 9
#: The same for buckets of buckets.
UPPER_BITS = 12
_LEAST = -(1 << 63)


def paragraphs(text: F.Column) -> F.Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")


def strong(text: F.Column) -> F.Column:
    """The eight lanes modulo 2^32, as an array of longs."""
    parts = paragraphs(text)
    lanes = []
    for key in map(F.lit, range(KEYS)):
        hashes = F.transform(parts, lambda x: F.xxhash64(key, x))  # noqa: B023  used at once
        for half in (hashes, F.transform(hashes, lambda h: F.shiftrightunsigned(h, 32))):
            lanes.append(F.aggregate(half, F.lit(0).cast("long"), lambda a, h: (a + h.bitwiseAND(WIDE - 1)).bitwiseAND(WIDE - 1)))
    return F.array(*lanes)


def runs(text: F.Column) -> F.Column:
    """A 64-bit hash of each different run of three words inside a paragraph (of the whole paragraph if it has fewer)."""

    def of(paragraph: F.Column) -> F.Column:
        w = F.transform(F.filter(F.split(paragraph, "[ \\t\\x0B\\f\\r]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x))
        pairs = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
        triples = F.zip_with(F.slice(pairs, 1, F.greatest(F.size(w) - 2, F.lit(0))), F.slice(w, 3, 1 << 30), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(w) >= 3, F.array_distinct(triples)).otherwise(F.array(F.xxhash64(paragraph)))

    return F.flatten(F.transform(paragraphs(text), of))


def sums(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """Group rows by keys and add the narrow lanes of the hashes in an array column: columns ``n`` and ``s0``...

    A column holds two lanes, one in its low half and one in its high half. A null array gives lanes of zero."""
    flat = rows.select(*keys, F.explode_outer(hashes).alias("h0"))
    for k in range(1, SKETCHES):
        flat = flat.withColumn(f"h{k}", F.xxhash64("h0", F.lit(k)))
    mask = (1 << 32) + 1
    lanes = [F.coalesce(F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(mask)), F.lit(0)).alias(f"s{32 * k + i}") for k in range(SKETCHES) for i in range(32)]
    return flat.groupBy(*keys).agg(F.count("h0").alias("n"), *lanes)


def lanes(prefix: str = "", modulus: int = NARROW) -> F.Column:
    """The narrow lanes of :func:`sums` as an array: the number of runs, then 128 counts, modulo 2^16 (or 2^32, which
    no text's counts reach)."""
    packed = F.array(*(f"{prefix}s{i}" for i in range(32 * SKETCHES)))
    both = F.concat(F.transform(packed, lambda s: s.bitwiseAND(modulus - 1)), F.transform(packed, lambda s: F.shiftrightunsigned(s, 32).bitwiseAND(modulus - 1)))
    return F.concat(F.array(F.col(f"{prefix}n").bitwiseAND(modulus - 1)), both)


def printed(wide: F.Column, narrow: F.Column) -> F.Column:
    """A fingerprint as lowercase hexadecimal text: eight lanes of eight digits, 129 of four."""
    hexed = lambda a, d: F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), d, "0")), "")
    return F.lower(F.concat(hexed(wide, 8), hexed(narrow, 4)))


def combine(a: F.Column, b: F.Column, modulus: int, sign: int = 1) -> F.Column:
    """Lanes of a with those of b added (or, with sign -1, taken away), modulo a power of two."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(modulus - 1))


def cut(whole: F.Column) -> F.Column:
    """Narrow lanes modulo 2^16 of uncut ones."""
    return F.transform(whole, lambda x: x.bitwiseAND(NARROW - 1))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Likeness (0 to 1) of two arrays of uncut narrow lanes (cut ones are too small beyond 65,535 runs). Lanes of both empty documents are alike."""
    centred = lambda v: F.transform(F.slice(v, 2, LANES), lambda c: 2.0 * c - F.element_at(v, 1))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = centred(a), centred(b)
    scale = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(scale > 0, dot(x, y) / scale).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows of docs and ``out``, their fingerprints as text. Null counts as empty; repeated rows stay."""
    key = "_row_of_fingerprint"
    marked = docs.withColumn(key, F.xxhash64(text))
    texts = marked.select(key, F.col(text).alias("_t")).dropDuplicates([key])
    added = sums(texts.select(key, strong(F.col("_t")).alias("wide"), runs(F.col("_t")).alias("runs")), [key, "wide"], "runs")
    return marked.join(added.select(key, printed(F.col("wide"), lanes()).alias(out)), key).drop(key)


def _following(ids: DataFrame, bits: int) -> DataFrame:
    """``at`` (a bucket of ids) and ``next``, the nearest lower bucket that has documents; null for the lowest.

    Buckets are gathered into buckets of buckets until one is left, so no task orders more than 2^UPPER_BITS rows."""
    buckets, _ = common.written(ids.select(F.shiftright("id", bits).alias("at")).distinct(), "id-buckets")
    span = buckets.agg(F.min("at"), F.max("at")).first()
    if span[0] is None or span[1] - span[0] < 1 << UPPER_BITS:
        return buckets.withColumn("next", F.lead("at").over(Window.orderBy(F.desc("at"))))
    up = buckets.withColumn("up", F.shiftright("at", UPPER_BITS))
    above = _following(buckets.select(F.col("at").alias("id")), UPPER_BITS).select(F.col("at").alias("up"), F.col("next").alias("up_next"))
    tops = up.groupBy("up").agg(F.max("at").alias("top"))
    over = above.join(tops.select(F.col("up").alias("up_next"), F.col("top").alias("other")), "up_next", "left").select("up", "other")
    chained = up.withColumn("near", F.lead("at").over(Window.partitionBy("up").orderBy(F.desc("at"))))
    return common.written(chained.join(over, "up", "left").select("at", F.coalesce("near", "other").alias("next")), "id-buckets")[0]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, place, doc_id, text, and next_text: the text of the next row in descending order of the id (nulls count
    as the least id; repeated ids in order of their texts); the last row's next is the first. Null texts are empty.
    The last row of each bucket has ``tail``, true."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("id"))
    slim = slim.withColumn("bucket", F.shiftright("id", BUCKET_BITS))
    order = Window.partitionBy("bucket").orderBy(F.desc("id"), "text")
    own = slim.withColumns({"place": F.row_number().over(order), "near": F.lead("text").over(order)})
    ends = slim.agg(F.max("bucket")).select(F.col("max(bucket)").alias("first"))
    chain = _following(slim.select("id"), BUCKET_BITS).join(F.broadcast(ends))  # ends is one row
    heads = own.where("place = 1").select(F.col("bucket").alias("next"), F.col("text").alias("head"))
    following = chain.select(F.col("at").alias("bucket"), F.coalesce("next", "first").alias("next")).join(heads, "next").select("bucket", "head")
    joined = own.join(following, "bucket")
    return joined.select("bucket", "place", "doc_id", "text", F.coalesce("near", "head").alias("next_text"), F.col("near").isNull().alias("tail"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its fingerprint, that of its edited text, and how alike its fingerprint is to the
    edited text's and to the next document's. See the module's contract for the edit; null texts are empty."""
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    rows = with_next(docs, doc_id, text).select("bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), F.when(F.col("tail"), F.col("next_text")).alias("after"))
    kinds = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("body")) for k, c in enumerate(("text", "edited", "after")))), lambda x: x["body"].isNotNull())
    each = rows.select("bucket", "place", "doc_id", "n_chars", F.explode(kinds).alias("x")).select("bucket", "place", "doc_id", "n_chars", F.col("x.kind").alias("kind"), F.col("x.body").alias("body"))
    keyed = each.select("bucket", "place", "doc_id", "n_chars", "kind", F.when(F.col("kind") == 1, F.sha2("body", 256)).alias("sha"), strong(F.col("body")).alias("wide"), runs(F.col("body")).alias("runs"))
    keys = ["bucket", "place", "doc_id", "n_chars", "kind", "sha", "wide"]
    added = sums(keyed, keys, "runs").select(*keys, lanes(modulus=WIDE).alias("narrow"))
    pick = lambda k, c: F.first(F.when(F.col("kind") == k, F.col(c)), ignorenulls=True)
    one = added.groupBy("bucket", "place", "doc_id", "n_chars").agg(pick(1, "sha").alias("edited_sha256"), *(pick(k, c).alias(f"{c}{k}") for k in range(3) for c in ("wide", "narrow")))
    follow = F.coalesce(F.lead("narrow0").over(Window.partitionBy("bucket").orderBy("place")), F.col("narrow2"))
    return one.withColumn("follow", follow).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("wide0"), cut(F.col("narrow0"))).alias("fingerprint"),
        printed(F.col("wide1"), cut(F.col("narrow1"))).alias("edited_fingerprint"),
        likeness(F.col("narrow0"), F.col("narrow1")).alias("near_edited"),
        likeness(F.col("narrow0"), F.col("follow")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, compared with its edited text's and the next document's."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
