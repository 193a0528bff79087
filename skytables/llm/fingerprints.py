"""Fingerprints of documents: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, so its
size follows the document's, and the sketch of two texts together is the union of
their sketches cut at the same share: sketches merge, and both the likeness and
the containment of very unequal documents can be estimated. Where no hash is low
enough, the smallest one is kept, so that short texts can still be told apart (the
smallest of a union is the smallest of the smallest, so merging still holds).

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE_CLASS, text_or_empty

SHINGLE_WORDS = 5
#: One in so many shingle hashes is kept.
SCALE = 8


def with_sketch(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """`df` with `out`: the sorted hashes of the sketch of column `text` (not null).

    A text with fewer than `words` words has one shingle, all its words; one
    without words has an empty sketch.
    """
    below = F.lit(-(2**63) + 2**64 // scale)
    hashed = F.transform(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_h", hashed)

    def shingle(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *[F.get("_h", i + j) for j in range(1, words)])

    whole = F.when(F.size("_h") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("_h")))
    df = df.withColumn("_s", F.when(F.size("_h") >= words, F.transform(F.slice("_h", F.lit(1), F.size("_h") - (words - 1)), shingle)).otherwise(whole))
    df = df.withColumn("_low", F.filter("_s", lambda x: x < below))
    kept = F.when(F.size("_low") > 0, F.array_sort(F.array_distinct("_low"))).when(F.size("_s") > 0, F.array(F.array_min("_s"))).otherwise(F.col("_low"))
    return df.withColumn(out, kept).drop("_h", "_s", "_low")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1; two without words are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: str, b: str) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(df: DataFrame, order: str, tie: str, carried: list[str]) -> DataFrame:
    """`df` with `next_<c>` for each carried column: its value in the next row by descending `order`,
    then `tie`; after the last row comes the first.

    Rows are dealt into ranges of `order` (cut at quantiles; a value that spans
    several ranges is cut further by `tie`, an evenly spread hash), the first row of
    each range also visits the range before it, and a window runs within each
    range. Rows are shuffled once. Null `order` comes last.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    at = F.coalesce(F.col(order), F.lit(-(2**63)))
    if cuts:
        heads = F.lit([g[0] for g in groups])
        inner = F.lit(groups)
        block = F.size(F.filter(heads, lambda c: c < at))
        place = block * (step + 1) + F.when(block > 0, F.size(F.filter(F.get(inner, block - 1), lambda c: c < at))).otherwise(0)
    else:
        place = F.lit(0)
    place = F.when(F.col(order).isNull(), -1).otherwise(place)
    split = F.col(order).isNull() if not hot else F.col(order).isNull() | F.col(order).isin(hot)
    part = F.when(split, F.shiftright(tie, 56).cast("int") + 128).otherwise(0)
    df = df.withColumns({"_range": place.cast("int"), "_part": part})
    # The first row of every range, and the range that it visits: the next higher one, the lowest for the first.
    first = (
        df.groupBy("_range", "_part").agg(F.max(F.struct(at.alias("o"), F.col(tie).alias("t"))).alias("head"))
        .withColumns({
            "to_range": F.coalesce(F.lead("_range").over(w := Window.orderBy("_range", "_part")), F.min("_range").over(Window.partitionBy())),
            "to_part": F.lead("_part").over(w),
        })
    )
    lowest = F.min(F.struct("_range", "_part")).over(Window.partitionBy())
    first = first.select(
        F.col("_range").alias("r"), F.col("_part").alias("p"), "head",
        "to_range", F.coalesce("to_part", lowest["_part"]).alias("to_part"),
    )
    # As many rows as ranges, a bound set above.
    visits = df.join(F.broadcast(first), (F.col("_range") == F.col("r")) & (F.col("_part") == F.col("p")), "left")
    is_head = (at == F.col("head.o")) & (F.col(tie) == F.col("head.t"))
    home = F.struct(F.col("_range").alias("r"), F.col("_part").alias("p"), F.lit(False).alias("guest"))
    away = F.struct(F.col("to_range").alias("r"), F.col("to_part").alias("p"), F.lit(True).alias("guest"))
    homes = F.when(is_head, F.array(home, away)).otherwise(F.array(home))
    visits = visits.withColumn("_at", homes).drop("r", "p", "head", "to_range", "to_part", "_range", "_part").withColumn("_at", F.explode("_at"))
    by_order = Window.partitionBy("_at.r", "_at.p").orderBy("_at.guest", F.col(order).desc_nulls_last(), F.col(tie).desc())
    out = visits.withColumns({f"next_{c}": F.lead(c).over(by_order) for c in carried})
    return out.where(~F.col("_at.guest")).drop("_at")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its sketch, that of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points (rounded down) replaced by
    the first as many, or all, of the next document by descending id. Returns
    `doc_id`, `text`, `edited`, `sketch`, `edited_sketch`, `next_sketch`; other
    columns are not carried.

    Null text counts as empty. Documents with null id come last; those with equal
    ids follow each other by the hash of their text, and equal rows give equal rows.
    An empty table gives no row; a single document is its own next one.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    base = base.withColumn("_tie", F.xxhash64("text"))
    base = with_sketch(base, "text", "sketch")
    rows = with_next(base, "doc_id", "_tie", ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (n - half).cast("int")), F.substr("next_text", F.lit(1), half)))
    rows = with_sketch(rows.drop("next_text", "_tie"), "edited", "edited_sketch")
    return rows.select("doc_id", "text", "edited", "sketch", "edited_sketch", "next_sketch")
