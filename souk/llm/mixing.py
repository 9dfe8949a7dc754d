"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) get the weights in turn. A source's
share of all words is its weight's part, but at most ``cap`` times its own
words; the excess is reshared by weight until no source is above. With caps
c and weights w that is target = min(c, l * w) for the one level l at which
targets add up to all words: the capped sources are the first in the order
of c / w, so a running sum over sources finds l without iterating.

Each document of a source expects target / words-of-source copies. Ordered
by size within its source, the expectations are prefix-summed, one random
offset is added for the source, and a document is emitted once per integer
boundary that its step crosses: the copies of any stretch of documents are
within one of their expectation, and the order by size keeps taken words near
the target.

Defined results: a null text has size 0; sources without a word have target
0 and none of their documents is taken; a null source is a source of its
own, the last; repeated rows are documents of their own. The offset is a
hash of (seed, source), and ties go by id and text, so reruns agree. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import WORD, positions, staged

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix"


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(no_source, source, source_size) -> with ``target``. One row per
    source, so ordering them on one task is fine."""
    by_name = Window.orderBy("no_source", "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    scale = 1
    for w in weights:
        scale *= w
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", "no_source", "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rest = F.col("all_words") - F.coalesce(F.sum("most").over(by_level), F.lit(0))
    rest_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(by_level), F.lit(0))
    ranked = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("level", F.expr(f"most * {scale} div weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest", rest)
        .withColumn("rest_weight", rest_weight)
        # in this order, the first that stays under its cap ends the capped ones
        .withColumn("free", F.col("most") * F.col("rest_weight") > F.col("rest") * F.col("weight"))
    )
    last_free = F.min(F.when(F.col("free"), F.struct("level", "no_source", "source", "rest", "rest_weight")))
    at = F.col("at")
    return (
        ranked.withColumn("at", last_free.over(everything))
        .withColumn(
            "target",
            F.when(
                at.isNotNull()
                & (F.struct("level", "no_source", "source") >= F.struct(at["level"], at["no_source"], at["source"])),
                (at["rest"] * F.col("weight")).cast("double") / at["rest_weight"].cast("double"),
            ).otherwise(F.col("most").cast("double")),
        )
        .select("no_source", "source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: str | None = None,
    weights=WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken[, carry]) for every row."""
    columns = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(text_col).alias("_hash"),
        *([F.col(carry).alias("_carry")] if carry else []),
    )
    rows = staged(columns, "mix-sizes")  # texts are read once
    placed = positions(
        rows, [F.col(c).asc() for c in ("no_source", "source", "size", "_id", "_hash")], "mix"
    )
    sources = placed.groupBy("no_source", "source").agg(
        F.sum("size").alias("source_size"),
        F.min("_pos").alias("_first"),
        F.max("_pos").alias("_last"),
    )
    shares = targets(sources, weights, cap).join(
        sources.drop("source_size"), ["no_source", "source"]
    )
    # a source's rows lie side by side: cut into pieces of places, so that one
    # source may hold most rows; shares go to the pieces that they reach, which
    # are no more than the pieces and sources together
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = placed.agg(F.max("_pos")).first()[0] or 0
    piece = lambda c: F.expr(f"{c} div {most // (4 * parts) + 1}")
    shares = shares.withColumn("_piece", F.explode(F.sequence(piece("_first"), piece("_last"))))
    placed = placed.withColumn("_piece", piece("_pos"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source"))), 1, 8), 16, 10)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double"))
    shares = shares.withColumn("_rate", F.coalesce(rate, F.lit(0.0))).withColumn(
        "_offset", offset.cast("double") / F.lit(4294967296.0)
    )
    # written, so that its size is known: few sources join without a shuffle
    shares = staged(shares, "mix-shares")
    place = F.col("_pos") - F.col("_first")
    upto = F.floor(F.col("_offset") + F.col("_rate") * (place + 1).cast("double"))
    before = F.floor(F.col("_offset") + F.col("_rate") * place.cast("double"))
    return (
        placed.join(shares, ["no_source", "source", "_piece"])
        .withColumn("copies", upto - before)
        .select(
            F.col("_id").alias(id_col),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
            *([F.col("_carry").alias(carry)] if carry else []),
        )
    )


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(text, '') AS body
  FROM documents),
s AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY 1, 2),
w AS (
  SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS INTEGER)] AS weight,
         source_size * 3 AS most FROM s),
l AS (
  SELECT *, most * 6 // weight AS level, CAST(sum(source_size) OVER () AS BIGINT) AS all_words,
         CAST(sum(weight) OVER () AS BIGINT) AS all_weight FROM w),
r AS (
  SELECT *,
    all_words - coalesce(CAST(sum(most) OVER o AS BIGINT), 0) AS rest,
    all_weight - coalesce(CAST(sum(weight) OVER o AS BIGINT), 0) AS rest_weight
  FROM l WINDOW o AS (ORDER BY level, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT level, no_source, source, rest, rest_weight FROM r
  WHERE most * rest_weight > rest * weight ORDER BY level, no_source, source LIMIT 1),
t AS (
  SELECT r.no_source, r.source, r.source_size,
    CASE WHEN f.level IS NOT NULL AND (r.level, r.no_source, r.source) >= (f.level, f.no_source, f.source)
      THEN CAST(f.rest * r.weight AS DOUBLE) / CAST(f.rest_weight AS DOUBLE)
      ELSE CAST(r.most AS DOUBLE) END AS target
  FROM r LEFT JOIN f ON true),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || source), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS off FROM t),
p AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY size, doc_id NULLS FIRST, body) AS i FROM rows)
SELECT p.doc_id, p.size, u.source_size, u.target,
  p.size * CAST(floor(u.off + u.rate * CAST(p.i AS DOUBLE)) - floor(u.off + u.rate * CAST(p.i - 1 AS DOUBLE)) AS BIGINT) AS taken
FROM p JOIN u USING (no_source, source)
"""
