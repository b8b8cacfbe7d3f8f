"""Document fingerprints: the k least shingle hashes of a text.

Such sketches merge: the k least of two sketches' union is the sketch of the
joined sets. They estimate resemblance, containment and the number of distinct
shingles. Everything is Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of a sketch; words of a shingle; documents in a band of ids.
K, WIDTH, BAND = 128, 5, 2_000
#: Bands up to which their first rows are sent to all executors, at a few dozen bytes each.
MOST_BROADCAST = 100_000
_RANGE = float(1 << 63)


def sketch(text: Column, k: int = K) -> Column:
    """Ascending array of the k least 63-bit hashes of a text's distinct five-word shingles.

    Words stand between white space, lower case by Spark's ``lower``. A text of
    fewer words is one shingle; one without words has an empty sketch.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WIDTH)
        many = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]), 1))
        one = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(F.size(h) >= WIDTH, many).when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))

    # A one-element array stands for a variable, so the words are hashed once.
    sets = F.transform(F.array(hashes), shingles)
    return F.slice(F.array_sort(F.array_distinct(F.element_at(sets, 1))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity, exact if the union has k hashes or fewer; of two empty sets 1."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _RANGE / F.element_at(a, -1).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that are in b, 0 to 1; of an empty a 1."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def text_of(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], band: int = BAND, derived: dict[str, Column] | None = None) -> DataFrame:
    """Add ``derived`` columns, and next_<c> of the row after in order of (doc_id, digest); after the last comes the first.

    Ids are dealt into equal bands of about ``band`` rows, so no window grows
    with the table; the first row of the band after closes each. Null ids come
    first, in a band of their own per digest remainder.
    """
    size = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("gone")).first()
    if not size.n:
        empty = docs.withColumns(derived or {})
        return empty.withColumns({f"next_{c}": F.lit(None).cast(empty.schema[c].dataType) for c in columns})
    width = max(1, ((size.b or 0) - (size.a or 0) + 1) * band // max(1, size.n - size.gone))
    spans = size.gone // band + 1
    # Null ids are ordered by digest alone, so their bands are ranges of the digest.
    null_band = F.floor((F.col("digest").cast("double") / 2.0**64 + 0.5) * spans) - spans - 1
    place = F.when(F.col("doc_id").isNull(), null_band).otherwise(F.floor((F.col("doc_id") - F.lit(size.a or 0)) / F.lit(width))).cast("bigint")
    banded = docs.withColumn("_band", place)
    order = Window.partitionBy("_band").orderBy("doc_id", "digest")
    stepped = banded.withColumns(derived or {}).withColumns({f"_in_{c}": F.lead(c).over(order) for c in columns} | {"_inner": F.lead(F.lit(True)).over(order)})
    # One row per band: its first row, handed to the band before it; the first band's goes to the last.
    firsts = banded.groupBy("_band").agg(F.min(F.struct("doc_id", "digest")).alias("_least")).select("_band", "_least.*").toDF("_band", "_id", "_key")
    if size.n // band + spans + 2 <= MOST_BROADCAST:  # at most as many bands
        firsts = F.broadcast(firsts)
    found = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_key"))).withColumns(derived or {})
    lead = found.dropDuplicates(["_band"]).select("_band", F.struct(*columns).alias("_head"))  # repeated rows are alike
    bands = docs.select(place.alias("_band")).distinct()
    in_order = Window.orderBy("_band")  # as many rows as bands
    after = bands.withColumn("_after", F.lead("_band").over(in_order))
    first = bands.agg(F.min("_band")).first()[0]
    heads = after.select("_band", F.coalesce("_after", F.lit(first)).alias("_after")).join(lead.select(F.col("_band").alias("_after"), "_head"), "_after")
    joined = stepped.join(heads.select("_band", "_head"), "_band", "left")
    chosen = {f"next_{c}": F.when(F.col("_inner"), F.col(f"_in_{c}")).otherwise(F.col(f"_head.{c}")) for c in columns}
    return joined.withColumns(chosen).drop("_band", "_inner", "_head", *[f"_in_{c}" for c in columns])


def edited(text: Column, after: Column) -> Column:
    """A text whose last quarter of code points (rounded down) gives way to as many from the start of the next one, or all it has."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - n), F.substring(after, F.lit(1), n))


def compare(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness; see ``edited``.

    A null text counts as empty. Rows that share an id follow each other in
    order of the hash of their text; rows that agree in both have equal results.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
    pairs = with_next(rows, ["text", "print"], derived={"print": sketch(F.col("text"), k)}).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    done = pairs.withColumn("edited_print", sketch(F.col("edited"), k))
    return done.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("print")).alias("fingerprint"), text_of(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print"), k).alias("near_edited"), resemblance(F.col("print"), F.col("next_print"), k).alias("near_next"),
        distinct_count(F.col("print"), k).alias("n_distinct"), containment(F.col("edited_print"), F.col("print"), k).alias("kept"),
    )
