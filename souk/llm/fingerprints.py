"""Bottom-k sketches of shingle hashes: the fingerprint of a document.

A text's shingles are its runs of ``shingle`` words (a shorter text's words
are its one shingle), hashed to 64 bits; the sketch is the sorted list of the k
least distinct hashes. The sketch of a union is the k least of both sketches,
so sketches of parts merge in any order (parts that overlap by shingle - 1
words have the whole text's shingles). From sketches come

* resemblance: the share of the union's sketch that is in both,
* containment of a in b: resemblance times the union's over a's count,
* the number of distinct shingles: exact below k, else (k - 1) / (k-th least
  hash as a fraction).

Only DataFrame functions. Defined results: null and empty texts have the
empty sketch and the empty fingerprint; two empty sketches have resemblance
1, an empty and a non-empty one 0; equal texts have equal sketches; ties and
repeated rows are ordered by a hash of the text; null ids come last in
descending order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import GAP, SPACES, sha256_of

K = 128
SHINGLE = 5
# Buckets of neighbouring ids per shuffle partition.
BUCKETS_PER_PARTITION = 6


def with_sketch(
    df: DataFrame, text_col: str, new: str, k: int = K, shingle: int = SHINGLE
) -> DataFrame:
    """``df`` with ``new``, the text's sketch (array of longs, ascending)."""
    words, n = F.col(f"_w_{new}"), F.size(F.col(f"_w_{new}"))
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    at = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    # hashing word by word, the earlier words' hash as the next one's seed; a
    # missing word (of a short text) changes nothing
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(shingle))))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
    empty = F.array().cast("array<bigint>")
    return (
        df.withColumn(f"_w_{new}", split)
        .withColumn(new, F.when(n == 0, empty).otherwise(least))
        .drop(f"_w_{new}")
    )


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from any number of parts' sketches: each task keeps
    the k least of a key before rows move."""
    ranked = (
        parts.select(*keys, F.explode(sketch).alias("_h"))
        .distinct()
        .withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h")))
        .filter(F.col("_r") <= k)
    )
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        both.cast("double") / F.size(union).cast("double")
    )


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    fraction = (F.element_at(sketch, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        F.lit(float(k - 1)) / fraction
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b has too; 1 for an empty a."""
    union = distinct_shingles(merge(a, b, k), k)
    part = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(part, F.lit(1.0)))


def text_of(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    digits = F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0"))
    return F.array_join(digits, "")


def with_next(docs: DataFrame, buckets: int | None = None, add=lambda df: df) -> DataFrame:
    """(_id, _text, ...) -> each row with ``next``, a struct of the next row in
    descending order of id (after the last: the first).

    Ids are cut into buckets of neighbours at some of the ids; a cut's rows
    are sent to the bucket before too, where they serve as the last row's next
    only, and so are the rows of the largest id for the last bucket. So one
    shuffle brings each row and its next together. ``add`` adds columns to
    rows once they are dealt.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or BUCKETS_PER_PARTITION * parts
    quantiles = [i / buckets for i in range(1, buckets + 1)]
    cuts = docs.agg(F.percentile_approx("_id", quantiles, 10 * buckets)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)  # ids of rows, the largest first
    at = F.array(*(F.lit(x).cast("long") for x in cuts)) if cuts else F.array().cast("array<bigint>")
    last = F.lit(max(0, len(cuts) - 1))
    own = F.when(F.col("_id").isNull(), last).otherwise(
        F.greatest(F.size(F.filter(at, lambda x: x >= F.col("_id"))) - 1, F.lit(0))
    )
    in_cut = F.array_position(at, F.col("_id"))
    homes = F.array(
        F.struct(own.alias("bucket"), F.lit(0).alias("ghost")),
        F.when(in_cut > 1, F.struct((own - 1).alias("bucket"), F.lit(1).alias("ghost"))),
        F.when(in_cut == 1, F.struct(last.alias("bucket"), F.lit(2).alias("ghost"))),
        # without any id, the one bucket's rows follow each other in a ring
        F.when(F.size(at) == 0, F.struct(last.alias("bucket"), F.lit(2).alias("ghost"))),
    )
    dealt = docs.select("*", F.explode(homes).alias("_home")).filter("_home IS NOT NULL")
    dealt = add(dealt.select("*", "_home.*").drop("_home").repartition(parts, "bucket"))
    names = [c for c in dealt.columns if c not in ("bucket", "ghost")]
    order = Window.partitionBy("bucket").orderBy(
        "ghost", F.col("_id").desc_nulls_last(), F.xxhash64("_text")
    )
    following = F.lead(F.struct(*names)).over(order).alias("next")
    return dealt.select(*names, "ghost", following).filter("ghost = 0").drop("ghost")


def fingerprint(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, ...) for every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    paired = with_next(rows, add=lambda df: with_sketch(df, "_text", "_sketch", k, shingle))
    half = F.floor(F.length("_text") / 2).cast("int")
    paired = paired.select(
        "_id",
        F.length("_text").cast("long").alias("n_chars"),
        "_sketch",
        F.col("next._sketch").alias("_next"),
        F.concat(
            F.substring("_text", F.lit(1), F.length("_text") - half),
            F.substring("next._text", F.lit(1), half),
        ).alias("_edited"),
    )
    paired = with_sketch(paired, "_edited", "_edited_sketch", k, shingle)
    return paired.select(
        F.col("_id").alias(id_col),
        "n_chars",
        sha256_of(F.col("_edited")).alias("edited_sha256"),
        text_of(F.col("_sketch")).alias("fingerprint"),
        text_of(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"),
        containment(F.col("_edited_sketch"), F.col("_sketch"), k).alias("edited_in_own"),
    )
