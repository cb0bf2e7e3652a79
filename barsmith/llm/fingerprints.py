"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of those vectors modulo 2**32 in every lane:

* 16 *identity* lanes: the halves of eight seeded 64-bit hashes of the whole paragraph. Equal sums mean
  equal multisets of paragraphs but for a 2**-512 chance.
* 264 *content* lanes: the hash of a word pair deals it to one of eight parts; a part has the number of the
  paragraph's pairs dealt to it, and for each of 32 bits the number of those whose hash has that bit. They let two
  fingerprints be compared by degree.

The sum does not depend on the order of paragraphs; inserting or deleting one adds or subtracts its
vector (:func:`insert`, :func:`delete`), so a fingerprint is kept up to date without the text.

Only DataFrame functions are used. Nulls: a null text counts as the empty text, which has one empty
paragraph. Rows that repeat are rows of their own; ties, that is rows of one id, stand next to each other in an order
that a hash of the text decides. Very long texts are hashed whole, paragraph by paragraph; a part's lanes are exact up to 2**32 word
pairs. An empty table gives an empty result. Extra columns are left alone; names starting with ``_fp_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import partitions, table

IDENTITY_HASHES = 8
#: Parts that word pairs are dealt to (eight: the top three bits of a hash), and bits counted in each (an even number, 58 at most).
PARTS, BITS = 8, 32
WIDTH = PARTS * (BITS + 1)
MODULUS = 1 << 32
_PAIR = (1 << 32) + 1


def identity_lanes(text: Column) -> Column:
    """array<bigint> of 16: per lane the sum over paragraphs, modulo 2**32."""
    paragraphs = F.split(text, "\n", -1)

    def lane(k: int, shift: int) -> Column:
        half = lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(k), p), shift).bitwiseAND(F.lit(MODULUS - 1))
        return F.aggregate(paragraphs, F.lit(0).cast("bigint"), lambda a, p: a + half(p)) % MODULUS

    return F.array(*(lane(k, shift) for k in range(IDENTITY_HASHES) for shift in (0, 32)))


def word_hashes(text: Column) -> Column:
    """array<bigint>: a hash for each word, with a mark before and after each paragraph.

    The marks are shared by all paragraphs, so the pairs of a text are those of its paragraphs, summed.
    """
    marked = F.concat(F.lit("\n "), F.replace(text, F.lit("\n"), F.lit(" \n ")), F.lit(" \n"))
    return F.transform(F.split(marked, " ", -1), lambda w: F.xxhash64(w))


def content_lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys -> ``lanes`` array<bigint> of WIDTH: for each part the number of its pairs, then its bits.

    Two lanes share one 64-bit sum, so half as many sums count the bits. The sums are made where the rows are if
    ``rows`` is already dealt by some of ``keys``; a key has at most PARTS rows when its lanes are put together.
    """
    words = rows.select(*keys, word_hashes(F.col(text)).alias("_fp_w"))
    pairs = words.select(*keys, F.explode(F.zip_with("_fp_w", F.slice("_fp_w", 2, 1 << 30), lambda a, b: F.xxhash64(a, b))).alias("_fp_h"))
    dealt = pairs.select(*keys, F.shiftrightunsigned("_fp_h", 61).cast("int").alias("_fp_part"), "_fp_h")
    sums = [F.sum(F.shiftrightunsigned("_fp_h", k).bitwiseAND(F.lit(_PAIR))).alias(f"_fp_{k}") for k in range(BITS // 2)]
    low, high = ([F.shiftrightunsigned(f"_fp_{k}", s).bitwiseAND(F.lit(MODULUS - 1)) for k in range(BITS // 2)] for s in (0, 32))
    parts = dealt.groupBy(*keys, "_fp_part").agg(F.count(F.lit(1)).alias("_fp_n"), *sums).select(*keys, "_fp_part", F.array(F.col("_fp_n") % MODULUS, *low, *high).alias("_fp_lanes"))
    found = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_fp_part", "_fp_lanes"))).alias("_fp_m"))
    none = F.array_repeat(F.lit(0).cast("bigint"), BITS + 1)
    return found.select(*keys, F.concat(*(F.coalesce(F.try_element_at("_fp_m", F.lit(p)), none) for p in range(PARTS))).alias("lanes"))


def narrowed(lanes: Column) -> Column:
    """Lanes in one byte each where all fit, else in two, else as they are, for the way through a shuffle."""
    most = F.array_max(lanes)
    cast = lambda kind: F.transform(lanes, lambda v: v.cast(kind))
    return F.struct(F.when(most < 1 << 7, cast("tinyint")).alias("tiny"), F.when((most >= 1 << 7) & (most < 1 << 15), cast("smallint")).alias("small"), F.when(most >= 1 << 15, lanes).alias("wide"))


def widened(narrow: Column) -> Column:
    return F.coalesce(*(F.transform(narrow[k], lambda v: v.cast("bigint")) for k in ("tiny", "small")), narrow["wide"])


def to_text(identity: Column, content: Column) -> Column:
    """The fingerprint as lowercase hex, eight digits a lane."""
    return F.lower(F.array_join(F.transform(F.concat(identity, content), lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def from_text(fingerprint: Column) -> Column:
    """The lanes of a fingerprint in hex."""
    n = 2 * IDENTITY_HASHES + WIDTH
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def insert(lanes: Column, paragraph_lanes: Column) -> Column:
    """Lanes of a text to which a paragraph is added."""
    return F.zip_with(lanes, paragraph_lanes, lambda a, b: (a + b) % MODULUS)


def delete(lanes: Column, paragraph_lanes: Column) -> Column:
    """Lanes of a text from which a paragraph is taken."""
    return F.zip_with(lanes, paragraph_lanes, lambda a, b: (a - b + MODULUS) % MODULUS)


def likeness(a: Column, b: Column, identity_a: Column, identity_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the word-pair counts that the content lanes estimate, 0 to 1.

    A lane's count less half the pairs of its part is a random sign sum, so products of lanes average to the inner
    product of the counts. Different pairs meet in one part in PARTS, and there with an error of 1 in the root of BITS,
    so the standard error is about 1/16, that of 256 lanes, though a pair is counted in 32 only.
    """
    of_part = lambda x, p: F.transform(F.slice(x, p * (BITS + 1) + 2, BITS), lambda v: (2 * v - x[p * (BITS + 1)]).cast("double"))
    signed = lambda x: F.concat(*(of_part(x, p) for p in range(PARTS)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sa, sb = signed(a), signed(b)
    size = F.sqrt(dot(sa, sa) * dot(sb, sb))
    return F.when((a == b) & (identity_a == identity_b), F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(sa, sb), size))), F.lit(0.0)))


def fingerprint(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys -> ``identity``, ``content``, ``fingerprint`` of each row's text; ``keys`` tell rows apart."""
    clean = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_fp_text"))
    lanes = content_lanes(clean, keys, "_fp_text")
    whole = clean.select(*keys, identity_lanes(F.col("_fp_text")).alias("identity"))
    both = whole.join(lanes, keys) if keys else whole.crossJoin(lanes)
    return both.select(*keys, "identity", F.col("lanes").alias("content"), to_text(F.col("identity"), F.col("lanes")).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, rn, id, text, next_text): each row with the text after it in descending id order.

    Nulls come last, ties are in order of a hash of the text, and after the last row comes the first. No task sees
    all rows: ids are cut into ranges at quantiles, a window runs in each range, and the first row of the following
    range closes the gap. An id with more rows than a range should have is a range of its own, cut by that hash, and
    so are the rows without an id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = 2 * partitions(spark)
    known = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("none")).first()
    cuts = known["q"] or []
    heavy = {v: cuts.count(v) for v in set(cuts) if cuts.count(v) > 1}  # an id at several quantiles
    starts = sorted(set(cuts) | {min(v + 1, (1 << 63) - 1) for v in heavy})
    parts = [1, *(heavy.get(v, 1) for v in starts)]
    first_of = [sum(parts[:i]) for i in range(len(parts))]
    array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    at = F.size(F.filter(array(starts), lambda b: b <= F.col("id")))
    place = F.col("th").cast("double") / float(1 << 64) + 0.5
    part = lambda k: F.least(k - 1, F.floor(place * k))
    k = F.element_at(array(parts), at + 1)
    none = F.lit(max(1, -(-known["none"] * ranges // max(1, known["n"])))).cast("bigint")
    bucket = F.when(F.col("id").isNull(), -1 - part(none)).otherwise(F.element_at(array(first_of), at + 1) + k - 1 - part(k)).cast("bigint")
    rows = rows.select(bucket.alias("bucket"), "id", "th", "text")
    first = rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("id").alias("o"), "th")).alias("x")).select("bucket", F.bitwise_not("x.o").alias("id"), "x.th")  # one row for each range
    same = (F.col("r.bucket") == F.col("f.bucket")) & (F.col("r.th") == F.col("f.th")) & F.col("r.id").eqNullSafe(F.col("f.id"))
    heads = rows.alias("r").join(F.broadcast(first.alias("f")), same).groupBy(F.col("r.bucket").alias("bucket")).agg(F.min("r.text").alias("head"))
    order = Window.orderBy(F.desc("bucket"))
    following = first.select("bucket", F.lead("bucket").over(order).alias("to"), F.max("bucket").over(Window.partitionBy()).alias("top")).select("bucket", F.coalesce("to", "top").alias("to"))
    heads = following.join(heads.withColumnRenamed("bucket", "to"), "to").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), "th", "text")
    led = rows.select("bucket", "id", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))
    joined = led.join(heads.withColumnRenamed("bucket", "_b"), (F.col("bucket") == F.col("_b")) & F.col("next").isNull(), "left")
    return joined.select("bucket", "rn", "id", "text", F.coalesce("next", "head").alias("next_text"), F.col("next").isNull().alias("last"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row for each document: fingerprints of its text and of its half-replaced text, and likenesses."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("bucket", "rn", "id", "last", "text", "next_text", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    sides = rows.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("side"), F.when(F.col("last"), F.col("next_text")).alias("t")))).alias("s")).select("bucket", "rn", "s.side", "s.t").where("t is not null")
    lanes = content_lanes(sides, ["bucket", "rn", "side"], "t")
    lanes = lanes.groupBy("bucket", "rn").agg(*(F.first(F.when(F.col("side") == i, narrowed(F.col("lanes"))), ignorenulls=True).alias(c) for i, c in enumerate(("c", "ec", "nc"))))
    whole = rows.select("bucket", "rn", "id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), identity_lanes(F.col("text")).alias("i"), identity_lanes(F.col("edited")).alias("ei"), F.when(F.col("last"), identity_lanes(F.col("next_text"))).alias("ni"))
    w = Window.partitionBy("bucket").orderBy("rn")
    out = whole.join(lanes, ["bucket", "rn"]).withColumns({c: widened(F.col(c)) for c in ("c", "ec", "nc")})
    out = out.withColumn("nc", F.coalesce("nc", F.lead("c").over(w))).withColumn("ni", F.coalesce("ni", F.lead("i").over(w)))
    col = F.col
    return out.select(
        col("id").alias("doc_id"), "n_chars", "edited_sha256",
        to_text(col("i"), col("c")).alias("fingerprint"), to_text(col("ei"), col("ec")).alias("edited_fingerprint"),
        likeness(col("c"), col("ec"), col("i"), col("ei")).alias("near_edited"), likeness(col("c"), col("nc"), col("i"), col("ni")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir):
    """See :func:`fingerprint_edits`, over all of ``documents``."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
