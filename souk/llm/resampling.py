"""Importance resampling of documents towards a target distribution.

Words are cut from UTF-8 bytes: a 256-byte table lower-cases A-Z and blanks
every byte that is no digit, letter or part of a longer character, and
``bytes.split`` yields the words. Runs of 1 to ``most`` words are hashed
without being built: the CRC-32 of a run is the CRC of " " + its last word
seeded with the CRC of the run before it. Counters reduce the hashes of a
task to its buckets, and only bucket counts are shuffled.

The counts of all documents and of all target texts give each bucket a gain
(a broadcast table of ``buckets`` numbers). In a second pass over the texts a
document's weight is the floored mean gain of its features; a Gumbel number
from a hash of (seed, id) is added, and the highest scores are drawn: a
sample without repeats, with chances in proportion to exp(weight / 1000).

Texts are taken ``SPAN`` bytes at a time, cut between words, so that one very
long text costs no more memory than its bytes.

Defined results: a null or empty text has no features and weight 0; repeated
rows are documents of their own; null ids rank before all others in a tie
and are hashed as the empty string; rows of one id and score go by a hash of
their text. An empty table gives an empty result, an empty target the gains
of t = T = 0. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import carried, positions, raw, slices, staged

MOST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
# Bytes of a text that are words at once.
SPAN = 1 << 20


def _byte(b: int) -> int:
    if ord("A") <= b <= ord("Z"):
        return b + 32
    return b if b >= 0x80 or chr(b).isalnum() else ord(" ")


TABLE = bytes(map(_byte, range(256)))


def words(text: bytes, span: int = SPAN):
    """Lists of the text's consecutive words, of about ``span`` bytes each."""
    text = text.translate(TABLE)
    at = 0
    while len(text) - at > span:
        end = text.find(b" ", at + span)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


def features(text: bytes, most: int = MOST, span: int = SPAN) -> tuple[int, Counter]:
    """(number of words, Counter of the CRC-32 of every run of 1 to ``most``
    words)."""
    found, n, before = Counter(), 0, []
    for some in words(text, span):
        n += len(some)
        hashes = list(map(zlib.crc32, some))
        found.update(hashes)
        if most == 1:
            continue
        # runs that end in this list may start in the lists before it
        some = before + some
        hashes = list(map(zlib.crc32, some))
        for length in range(2, most + 1):
            hashes = [zlib.crc32(b" " + w, h) for h, w in zip(hashes, islice(some, length - 1, None))]
            found.update(islice(hashes, max(0, len(before) - length + 1), None))
        before = some[len(some) - most + 1 :] if len(some) >= most else some
    return n, found


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; a task leaves at most ``buckets`` rows."""

    def run(batches):
        total = Counter()
        for batch in slices(batches):
            found = Counter()
            for text in raw(batch.column("_text")):
                found.update(features(text, most)[1])
            for h, c in found.items():
                total[h % buckets] += c
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["bucket", "n"]
        )

    rows = texts.select(F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, most: int, buckets: int) -> list[int]:
    """The gain of every bucket."""
    own = bucket_counts(docs, text_col, most, buckets).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, target_col, most, buckets).withColumnRenamed("n", "t")
    both = staged(
        docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(own, "bucket", "left").join(theirs, "bucket", "left").fillna(0, ["s", "t"]),
        "resample-counts",
    )
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    real = lambda c, add: (c + F.lit(add)).cast("double")
    ratio = (real(F.col("t"), 1) * F.lit(float(sums["s"] + buckets))) / (
        real(F.col("s"), 1) * F.lit(float(sums["t"] + buckets))
    )
    gain = F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")
    out = [0] * buckets
    for r in both.select("bucket", gain.alias("g")).collect():  # one row per bucket
        out[r["bucket"]] = r["g"]
    return out


def weigh(docs: DataFrame, gain: list[int], id_col: str, text_col: str, most: int) -> DataFrame:
    """(_id, _hash, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches):
        gain = shared.value
        buckets = len(gain)
        for batch in slices(batches):
            out = []
            for text in raw(batch.column("_text")):
                n, found = features(text, most)
                many = found.total()
                total = sum(gain[h % buckets] * c for h, c in found.items())
                out.append((zlib.crc32(text), n, many, total // many if many else 0))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["_id", "_hash", "n_words", "n_features", "weight"],
            )

    rows = carried(docs, id_col, text_col).select("_id", "_text")
    return rows.mapInArrow(run, "_id long, _hash long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    most: int = MOST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row; ``rank`` is null
    where a document is not drawn."""
    gain = gains(docs, target, text_col, target_col, most, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = staged(
        weigh(docs, gain, id_col, text_col, most)
        .withColumn("score", F.col("weight") + gumbel)
        .withColumn("_short", F.col("n_words") < least_words),
        "resample-scores",
    )
    drawn = scored.filter(~F.col("_short")).count() * percent // 100
    # long enough texts first: their places are their ranks
    order = [F.col("_short").asc(), F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("_hash").asc()]
    placed = positions(scored, order, "resample-places")
    return placed.select(
        F.col("_id").alias(id_col),
        "n_features",
        "weight",
        "score",
        F.when(F.col("_pos") < drawn, F.col("_pos") + 1).cast("long").alias("rank"),
    )


# CRC-32 by bytes over the distinct words: the table follows from its
# polynomial, one step is table[(c ^ byte) & 255] ^ (c >> 8).
ORACLE = r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
w AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
f AS (
  SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM w) GROUP BY ALL),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(
      range(1, strlen(word) * 2, 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM f), steps),
c AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS BIGINT) AS s,
    CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS BIGINT) AS t
  FROM f JOIN b USING (word) GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(
    (CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE))
    / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c),
m AS (
  SELECT row, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN b USING (word) JOIN g USING (bucket)
  WHERE side = 'd' GROUP BY 1),
d AS (
  SELECT doc_id, row, CAST(len(words) AS BIGINT) AS n_features,
    CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END
      AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m USING (row) WHERE side = 'd'),
e AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (
  SELECT *, n_features >= 20 AS long_enough,
    row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
    (SELECT count(*) FROM e WHERE n_features >= 20) * 10 // 100 AS drawn
  FROM e)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN long_enough AND place <= drawn THEN place END AS rank
FROM r
"""
