"""Document fingerprints: SimHash of weighted terms, and search by permuted block tables. DataFrame functions only.

Terms are pairs of neighbouring words, weighted by their length. Each term's 128-bit hash votes on every bit with
its weight. A long holds the votes on two bits (32 bits each), so that 64 sums count all 128 bits in one aggregate.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach.sources.workspace import materialize

BITS = 128
LANES = 0x0000000100000001
SPACE = r"[\x09-\x0D\x20]+"
#: Bits in which two fingerprints of a search may differ.
RADIUS = 3
#: The members of a block are gathered in so many parts.
PARTS = 64


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def terms(text: Column) -> Column:
    """Array of (word, next word) of a text; the last word stands alone, and a text without words has one empty term."""
    words = F.split(text, SPACE)
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def votes(term: str) -> list[Column]:
    """Aggregates: total weight, and the packed votes of the bits ``i`` and ``i + 32`` of either half of the hash."""
    a, b = F.col(f"{term}.a"), F.col(f"{term}.b")
    weight = (1 + F.least(F.length(a), F.lit(6)) + F.coalesce(F.least(F.length(b), F.lit(6)), F.lit(0))).cast("long")
    out = [F.sum(weight).alias("weight")]
    for half, value in enumerate((F.xxhash64(a, b), F.xxhash64(b, F.lit(HALF_SEED), a))):
        out += [F.sum(F.shiftrightunsigned(value, i).bitwiseAND(_long(LANES)) * weight).alias(f"v{half}_{i}") for i in range(32)]
    return out


#: Sets the second half of a hash apart from the first.
HALF_SEED = 7


def majority(half: int) -> Column:
    """64 bits as a long: those with more than half the weight."""
    bits = None
    for i in range(32):
        packed = F.col(f"v{half}_{i}")
        for place, lane in ((i, packed.bitwiseAND(_long(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(packed, 32))):
            bit = F.shiftleft((2 * lane > F.col("weight")).cast("long"), place)
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def text_of(first: str, second: str) -> Column:
    """A fingerprint as 32 lowercase hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def distance(a: str, b: str, c: str, d: str) -> Column:
    """Differing bits of the fingerprints (a, b) and (c, d)."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(c))) + F.bit_count(F.col(b).bitwiseXOR(F.col(d)))


def likeness(bits: Column) -> Column:
    """Estimated cosine of the weighted terms, 0 to 1: the angle is the share of differing bits of a half turn."""
    return F.greatest(F.cos(bits * (3.141592653589793 / BITS)), F.lit(0.0))


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text; NULL text as empty) with a ``range``: parts of the order of doc_id with about as many rows each.

    Ranges let the next document be found inside a task. Rows without doc_id form the lowest range.
    """
    spark = docs.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = [i / count for i in range(1, count)]
    found = base.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, 10 * count)).first()[0] or []
    borders = [float("-inf"), *(sorted(set(found)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=borders, inputCol="place", outputCol="range", handleInvalid="keep")
    placed = cut.transform(base.withColumn("place", F.col("doc_id").cast("double")))
    return placed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range")).cast("int").alias("range"))


def following(firsts: DataFrame, column: str) -> DataFrame:
    """(range, next_first): of each range the first row's ``column`` of the next lower one, of the lowest that of the highest.

    ``firsts`` has one row per range; their number follows the number of partitions and not the rows.
    """
    order = Window.orderBy(F.desc("range"))
    ends = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return firsts.select("range", F.coalesce(F.lead(column).over(order), F.first(column).over(ends)).alias("next_first"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """range, place, doc_id, text, n_chars, edited of every row.

    The edited text keeps the first n - n // 2 code points and goes on with the first n // 2 (or all) of the next
    document by descending doc_id, after the last with those of the first. Equal doc_ids follow each other by text.
    """
    placed = in_ranges(docs)
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = placed.withColumns({"place": F.row_number().over(order), "following": F.lead("text").over(order)})
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    # One head per range: as many rows as ranges.
    firsts = placed.join(F.broadcast(heads.withColumnRenamed("range", "head_range")), (F.col("range") == F.col("head_range")) & placed["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi")
    firsts = firsts.groupBy("range").agg(F.min("text").alias("text"))
    joined = rows.join(following(firsts, "text"), "range")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return joined.select(
        "range", "place", "doc_id", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("following", "next_first"), F.lit(1), half)).alias("edited"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints (f0, f1) of each text and (e0, e1) of its edited text, with range, place, doc_id, n_chars, edited_sha256.

    The text is dealt out once, by range; all later steps keep that partitioning.
    """
    both = edited_texts(docs).select(
        "range", "place", "doc_id", "n_chars",
        F.explode(F.array(
            F.struct(F.lit("").alias("sha"), F.col("text").alias("text")),
            F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("text")))).alias("version"),
    )
    exploded = both.select("range", "place", "doc_id", "n_chars", F.col("version.sha").alias("sha"), F.explode(terms(F.col("version.text"))).alias("term"))
    counted = exploded.groupBy("range", "place", "doc_id", "n_chars", "sha").agg(*votes("term"))
    hashed = counted.select("range", "place", "doc_id", "n_chars", "sha", majority(0).alias("h0"), majority(1).alias("h1"))
    own = F.col("sha") == ""
    return hashed.groupBy("range", "place", "doc_id", "n_chars").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(own, F.col("h0"))).alias("f0"), F.max(F.when(own, F.col("h1"))).alias("f1"),
        F.max(F.when(~own, F.col("h0"))).alias("e0"), F.max(F.when(~own, F.col("h1"))).alias("e1"),
    )


def block(index: int) -> Column:
    """One of the four 32-bit blocks of the fingerprint (f0, f1)."""
    value = F.col("f0" if index < 2 else "f1")
    return F.shiftrightunsigned(value, 32) if index % 2 else value.bitwiseAND(_long(0xFFFFFFFF))


def near_counts(marked: DataFrame, queries: Column, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, n_near): for each distinct fingerprint of the rows that ``queries`` picks, the rows within ``radius`` bits.

    Four tables hold every distinct fingerprint under one of its blocks; two fingerprints that differ in at most 3
    bits share a block. A table row gathers the fingerprints of one block and part, so a crowded block gives a few
    long rows and no pairs; a pair counts in the first table that has it. Rows of equal fingerprints count as many
    as they are, the query's own included.
    """
    if not 0 <= radius < 4:
        raise ValueError("four blocks find differences of up to three bits")
    distinct = marked.groupBy("f0", "f1").agg(F.count("*").alias("copies"))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), block(i).alias("block")) for i in range(4)])).alias("key")
    part = F.pmod(F.xxhash64("f0", "f1"), F.lit(PARTS)).alias("part")
    tables = distinct.select("f0", "f1", "copies", part, keys).groupBy("key", "part").agg(F.collect_list(F.struct("f0", "f1", "copies")).alias("members"))
    asked = marked.where(queries).select("f0", "f1").distinct().select("f0", "f1", keys)

    def met_before(member: Column) -> Column:
        """Some block before that of the table is equal too."""
        first = F.col("f0").bitwiseXOR(member["f0"])
        second = F.col("f1").bitwiseXOR(member["f1"])
        same = [first.bitwiseAND(_long(0xFFFFFFFF)) == 0, F.shiftrightunsigned(first, 32) == 0, second.bitwiseAND(_long(0xFFFFFFFF)) == 0]
        any_before = F.lit(False)
        for i, equal in enumerate(same):
            any_before = any_before | ((F.col("key.table") > i) & equal)
        return any_before

    def near(member: Column) -> Column:
        bits = F.bit_count(F.col("f0").bitwiseXOR(member["f0"])) + F.bit_count(F.col("f1").bitwiseXOR(member["f1"]))
        return (bits <= radius) & ~met_before(member)

    counted = F.aggregate("members", F.lit(0).cast("long"), lambda total, m: total + F.when(near(m), m["copies"]).otherwise(F.lit(0).cast("long")))
    return asked.join(tables, "key").select("f0", "f1", counted.alias("n")).groupBy("f0", "f1").agg(F.sum("n").alias("n_near"))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    NULL and empty texts share one fingerprint; equal texts have equal ones. n_near, for rows whose doc_id is
    divisible by 100, is the number of other rows within 3 bits, by the block tables; else NULL. A single row is its
    own next document. No rows give no rows. Extra columns play no part.
    """
    marked = materialize(fingerprints(docs), "fingerprints-native")
    order = Window.partitionBy("range").orderBy("place")
    pair = F.struct("f0", "f1")
    firsts = marked.where("place = 1").select("range", pair.alias("pair"))
    # One row of two longs per range.
    joined = marked.withColumn("following", F.lead(pair).over(order)).join(F.broadcast(following(firsts, "pair")), "range")
    nexts = joined.withColumn("following", F.coalesce("following", "next_first"))
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    counts = near_counts(marked, asked).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "n_near")
    found = nexts.join(counts, asked & (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left")
    bits = F.bit_count(F.col("f0").bitwiseXOR(F.col("following.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("following.f1")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", text_of("f0", "f1").alias("fingerprint"), text_of("e0", "e1").alias("edited_fingerprint"),
        likeness(distance("f0", "f1", "e0", "e1")).alias("near_edited"), likeness(bits).alias("near_next"), (F.col("n_near") - 1).alias("n_near"),
    )
