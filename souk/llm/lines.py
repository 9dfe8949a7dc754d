"""Line dedup against sharded minimal perfect hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in
lower case. Keys of at least ``min_chars`` code points are hashed to 128 bits
(two 64-bit halves): the first half picks the shard and the place, the second
is the fingerprint. For each shard of the distinct line hashes a minimal
perfect hash is built (levels of bit sets; a key stays at the first level
where no other key falls on its bit; its place is the number of bits set
before it), which indexes three compact arrays: fingerprint, number of
documents, largest id. A shard is one row of some ``keys_per_shard`` keys.

Documents don't join lines: each sends its distinct hashes as probes to the
shards, where whole columns of probes are looked up in the arrays. A shard
that gets many probes (a line of very many documents) is copied, and its
probes are dealt over the copies by id; only shards with more than a fixed
multiple of the mean number of probes per partition count as such, so their
table is bounded by the number of partitions. What comes back per document is the list
of its hashes that go, and the documents drop those lines.

Defined results: a null text is one empty line; a null id is the smallest id;
documents are counted by distinct id, and rows that repeat an id share its
fate (each keeps its own other lines); empty table, empty result. Other columns
are not read, except ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import NO_ID, raw, staged

MIN_CHARS = 20
MIN_DOCUMENTS = 3
KEYS_PER_SHARD = 1 << 16
# A shard is copied beyond this many probes, and beyond four times the mean of
# a partition.
PROBES_PER_COPY = 1 << 20
_GAMMA = 2  # bits per key left at a level
_ODD = np.uint64(0x9E3779B97F4A7C15)


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def _is_long(key: bytes, min_chars: int) -> bool:
    n = len(key)
    if n < min_chars:
        return False
    return key.isascii() or n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


# --- minimal perfect hash -------------------------------------------------


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (keys ^ (np.uint64(level + 1) * _ODD)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x % np.uint64(size)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, words of all levels) over distinct uint64 keys."""
    sizes, words, left, level = [], [], keys, 0
    while len(left):
        size = -(-max(64, _GAMMA * len(left)) // 64) * 64
        bit = _bit(left, level, size)
        alone = np.bincount(bit.astype(np.int64), minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[bit.astype(np.int64)]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8")


def places(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each key's place; -1 for some that were not built in (others of those
    get a place too, which the fingerprint refutes)."""
    counts = np.bitwise_count(words).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(len(keys), -1, np.int64)
    open_, start = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        bit = _bit(keys[open_], level, int(size))
        at = start + (bit >> np.uint64(6)).astype(np.int64)
        shift = bit & np.uint64(63)
        word = words[at]
        hit = (word >> shift) & np.uint64(1) == 1
        below = word & ((np.uint64(1) << shift) - np.uint64(1))
        out[open_[hit]] = before[at[hit]] + np.bitwise_count(below[hit])
        open_, start = open_[~hit], start + int(size) // 64
        if not len(open_):
            break
    return out


# --- stages ---------------------------------------------------------------


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id): each document's distinct long keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            found, owner = [], []
            for i, text in zip(ids, raw(batch.column("_text"))):
                own = {key_of(line) for line in text.split(b"\n")}
                own = [_hash(k) for k in own if _is_long(k, min_chars)]
                found += own
                owner += [i] * len(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owner, pa.int64())],
                names=["h1", "h2", "_id"],
            )

    return docs.select("_id", "_text").mapInArrow(run, "h1 long, h2 long, _id long")


def _arrays(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its arrays."""

    def run(table):
        one = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        keys = one("h1").astype(np.int64).view(np.uint64)
        first = np.unique(keys, return_index=True)[1]
        # equal first halves (never seen; about n*n / 2**65) go to a list
        twin = np.setdiff1d(np.arange(len(keys)), first)
        sizes, words = build(keys[first])
        at = places(keys[first], sizes, words)
        prints, counts, last = (np.empty(len(first), np.int64) for _ in range(3))
        prints[at], counts[at], last[at] = one("h2")[first], one("n")[first], one("last")[first]
        rest = np.stack([one(c)[twin] for c in ("h1", "h2", "n", "last")], 1).astype("<i8")
        blob = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table(
            {
                "shard": table.column("shard").combine_chunks()[:1],
                "sizes": blob(sizes),
                "words": blob(words),
                "prints": blob(prints),
                "counts": blob(counts.clip(max=2**32 - 1).astype("<u4")),
                "last": blob(last),
                "rest": blob(rest),
            }
        )

    return (
        counted.withColumn("shard", F.pmod("h1", F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(
            run,
            "shard long, sizes binary, words binary, prints binary, counts binary, last binary, rest binary",
        )
    )


def _probe(min_documents: int):
    def run(probes, arrays):
        one = lambda c: probes.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        h1, h2, ids = one("h1"), one("h2"), one("_id")
        gone = np.zeros(len(h1), bool)
        if len(h1) and arrays.num_rows:
            blob = lambda c, kind: np.frombuffer(arrays.column(c)[0].as_py(), kind)
            at = places(h1.astype(np.int64).view(np.uint64), blob("sizes", "<i8"), blob("words", "<u8"))
            counts, last = blob("counts", "<u4"), blob("last", "<i8")
            gone = (at >= 0) & (blob("prints", "<i8")[at] == h2)
            gone &= (counts[at] >= min_documents) & (last[at] != ids)
            for a, b, n, top in blob("rest", "<i8").reshape(-1, 4):
                gone |= (h1 == a) & (h2 == b) & (n >= min_documents) & (top != ids)
        return pa.table({"_id": pa.array(ids[gone], pa.int64()), "h1": h1[gone], "h2": h2[gone]})

    return run


def gone_hashes(
    rows: DataFrame, min_chars: int, min_documents: int, keys_per_shard: int, probes_per_copy: int
) -> DataFrame:
    """(_id, gone): the hashes of the lines that each document loses, as
    pairs in one flat list."""
    spark = rows.sparkSession
    pairs = staged(_hashes(rows, min_chars), "lines-hashes")
    counted = staged(
        pairs.groupBy("h1", "h2", "_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last")),
        "lines-counts",
    )
    shards = max(1, -(-counted.count() // keys_per_shard))
    arrays = _arrays(counted, shards)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(probes_per_copy, 4 * pairs.count() // parts)
    hot = (  # at most a quarter as many as partitions
        counted.groupBy(F.pmod("h1", F.lit(shards)).alias("shard"))
        .agg(F.sum("n").alias("_probes"))
        .filter(F.col("_probes") > limit)
        .select("shard", F.ceil(F.col("_probes") / limit).alias("_copies"))
    )
    probes = (
        pairs.withColumn("shard", F.pmod("h1", F.lit(shards)))
        .join(F.broadcast(hot), "shard", "left")
        .withColumn("copy", F.coalesce(F.pmod(F.xxhash64("_id"), "_copies"), F.lit(0)))
        .select("shard", "copy", "h1", "h2", "_id")
    )
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", F.lit(1)) - 1)
    arrays = arrays.join(F.broadcast(hot), "shard", "left").withColumn("copy", F.explode(copies)).drop("_copies")
    gone = (
        probes.groupBy("shard", "copy")
        .cogroup(arrays.groupBy("shard", "copy"))
        .applyInArrow(_probe(min_documents), "_id long, h1 long, h2 long")
    )
    return gone.groupBy("_id").agg(  # lines of one document
        F.flatten(F.collect_set(F.array("h1", "h2"))).alias("gone")
    )


def _without(min_chars: int, keep: list[str]):
    def run(batches):
        for batch in batches:
            texts, n_dropped = [], []
            for text, gone in zip(raw(batch.column("_text")), batch.column("gone").to_pylist()):
                if not gone:
                    texts.append(text)
                    n_dropped.append(0)
                    continue
                flat = np.array(gone, "<i8").tobytes()
                gone = {flat[i : i + 16] for i in range(0, len(flat), 16)}
                lines = text.split(b"\n")
                kept = []
                for line in lines:
                    key = key_of(line)
                    if not (_is_long(key, min_chars) and _hash(key) in gone):
                        kept.append(line)
                texts.append(b"\n".join(kept))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array([t.count(b"\n") + 1 for t in raw(batch.column("_text"))], pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                ],
                names=[*keep, "kept", "n_lines", "n_dropped"],
            )

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    keys_per_shard: int = KEYS_PER_SHARD,
    probes_per_copy: int = PROBES_PER_COPY,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept[, carry]): ``kept`` is the text without
    the lines that go."""
    rows = docs.select(
        F.col(id_col).alias("_own"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        *([F.col(carry).alias("_carry")] if carry else []),
    )
    gone = gone_hashes(rows, min_chars, min_documents, keys_per_shard, probes_per_copy)
    joined = rows.join(gone, "_id", "left").drop("_id")
    keep = [c for c in joined.columns if c not in ("_text", "gone")]
    out = joined.select(*keep, F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_lines"),
                        F.lit(0).cast("long").alias("n_dropped")).schema
    return joined.mapInArrow(_without(min_chars, keep), out).select(
        F.col("_own").alias(id_col),
        "n_lines",
        "n_dropped",
        "kept",
        *([F.col("_carry").alias(carry)] if carry else []),
    )


ORACLE = r"""
WITH lines AS (
  SELECT rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
              FROM documents))),
k AS (
  SELECT key, max(did) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT did) >= 3),
j AS (
  SELECT l.rid, l.doc_id, l.i, l.line, (k.key IS NOT NULL AND l.did <> k.last) AS gone
  FROM lines l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""
