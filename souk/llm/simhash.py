"""SimHash fingerprints linked by covering locality-sensitive hashing.

A text's fingerprint has a bit set if over half of its shingles' XXH64 hashes
have it set. Fingerprints within ``radius`` differing bits are linked, and
documents take the smallest id reachable over links.

Candidates: every bit gets a fixed nonzero vector of radius + 1 bits, and there
is one table for each nonzero vector v, whose mask holds the bits with odd
<vector, v>. Any ``radius`` bits have a v orthogonal to all their vectors, so a pair
within the radius has equal masked fingerprints in that table: nothing is
missed. Equal fingerprints are one entry, whatever their number of documents.

Check inside a bucket: the entries differ only in bits outside the mask, so
each sends itself and its copies with one such bit flipped; for radius 2 two
entries are within the radius exactly if they send a common value. At most
one more entry than outside bits can meet at a value, and all of those are within the
radius of each other, so linking them to the least of them loses no
connection and no bucket, however large, is expanded into pairs. Larger radii
flip up to ceil(radius / 2) bits; for odd radii the pairs at a value are
checked against the distance.

Defined results: texts without a word have fingerprint zero, linked like any
other; null ids are ignored by the smallest id (a group of null ids only has
a null component); repeated rows each get their row; empty table, empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import raw, slices, staged
from souk.llm.graph import roots
from souk.plans.skew import salted_join

SHINGLE = 3
RADIUS = 2
SEED = 42
_BLOCK = 1 << 15  # shingles counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        some = words[at : min(at + _BLOCK, n) + shingle - 1]
        if n == 1:
            hashes = [digest(join(words), SEED)]
        else:
            hashes = [digest(join(w), SEED) for w in zip(*(some[k:] for k in range(shingle)))]
        bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_ = np.packbits(2 * ones > n, bitorder="little")
    return int(set_.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, new: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text and with the fingerprint as a (signed) long."""
    keep = [c for c in docs.columns if c not in (text_col, new)]

    def run(batches):
        for batch in slices(batches):
            prints = [fingerprint(t, shingle) for t in raw(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(np.array(prints, "<u8").view("<i8"))],
                names=[*keep, new],
            )

    schema = docs.select(*keep).withColumn(new, F.lit(0).cast("long")).schema
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' masks, as bit positions that count."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` within the radius
    that connect whatever is within the radius."""
    tables = masks(radius)
    half = -(-radius // 2)
    flips = []
    for mask in tables:
        outside = [1 << i for i in range(64) if not mask >> i & 1]
        flips.append([_signed(sum(c)) for k in range(half + 1) for c in combinations(outside, k)])
    keyed = entries.select(
        "fp",
        F.posexplode(
            F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in tables))
        ).alias("t", "key"),
    )
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    candidates = keyed.join(shared, ["t", "key"]).select("t", "fp")
    flip = F.element_at(F.array(*(F.array(*(F.lit(x).cast("long") for x in f)) for f in flips)), F.col("t") + 1)
    sent = candidates.select("t", "fp", F.explode(flip).alias("flip")).select(
        "t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")
    )
    met = sent.groupBy("t", "at").agg(  # entries within `half` bits of one value
        F.min("fp").alias("u"), F.array_sort(F.collect_list("fp")).alias("all")
    ).filter(F.size("all") > 1)
    if radius % 2 == 0:
        return met.select("u", F.explode("all").alias("v")).filter("u <> v").distinct()
    pair = met.select("all", F.posexplode("all").alias("i", "u"))
    pair = pair.select("u", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("v"))
    return pair.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    carry: list[str] | None = None,
) -> DataFrame:
    """(id, fp, root, component_id[, carry]) for every row: ``fp`` the fingerprint
    as a signed long, ``root`` the fingerprint that stands for the component."""
    carry = carry or []
    rows = staged(
        fingerprints(
            docs.select(
                F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *carry
            ),
            "_text", "fp", shingle,
        ),
        "simhash",
    )
    entries = staged(rows.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-entries")
    root = roots(links(entries.select("fp"), radius))
    rooted = entries.join(root, entries["fp"] == root["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(components, "root")
    # one text may have very many copies: more than a quarter of a task's share are split
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = rows.count() // (4 * parts) + 1
    joined = salted_join(
        rows, named, "fp", spread_by=["_id", *carry], other_unique=True, rows_per_piece=share
    )
    return joined.select(
        F.col("_id").alias(id_col), "fp", "root", "component_id", *carry
    )


def hex_of(fp) -> object:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
