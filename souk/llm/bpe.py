"""Byte-level BPE over whole texts, long texts cut into overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by
``overlap_chars`` code points; every chunk is a row of its own, dealt by
(text, chunk), and is pre-tokenised on its own. A chunk other than the first
starts at an arbitrary place, so its first pre-tokens may be wrong; but the
scan of a pattern without look-behind depends only on the text after the
scan's place. Where a boundary of one chunk's (right) scan is a boundary of
the next chunk's scan too, both go on alike: there the chunks are stitched.
The texts between stitches are encoded apart and the ids joined in order.
If an overlap holds no common boundary (a run of one class longer than the
overlap), the rest of that text from the last stitch on is one piece.

Decoding concatenates the ids' bytes.

Defined results: a null or empty text has no ids; repeated rows and equal
texts give equal ids, each row its own; texts are never normalised; special
tokens are ordinary text. Other columns of the input are not read, except
``carry``.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import staged

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
# A boundary counts as settled if the scan can't have looked past the chunk:
# a match looks at most this many code points beyond its end.
LOOK_AHEAD = 8


class Vocabulary:
    """Ranks of a byte-level BPE and its pattern; broadcast once (under 1 MB),
    the encoder is built once in each Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks_file, self.pattern, self._built = ranks_file, pattern, None

    def __getstate__(self):
        return {"ranks_file": self.ranks_file, "pattern": self.pattern, "_built": None}

    def built(self):
        if self._built is None:
            ranks = {}
            for line in self.ranks_file.splitlines():
                token, _, rank = line.partition(b" ")
                ranks[base64.b64decode(token)] = int(rank)
            encoder = tiktoken.Encoding(
                "ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}
            )
            by_id = [b""] * (max(ranks.values(), default=-1) + 1)
            for token, rank in ranks.items():
                by_id[rank] = token
            self._built = encoder, by_id, regex.compile(self.pattern)
        return self._built


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The rank file at ``path`` on the driver, as a broadcast variable."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary(f.read(), pattern))


def _encoder(shared, text: str, new: str, keep: list[str]):
    def run(batches):
        encode = shared.value.built()[0].encode_ordinary
        for batch in batches:
            texts = batch.column(text).to_pylist()
            # a few rows at a time: a batch may hold many long texts
            for at in range(0, len(texts), 256):
                ids = pa.array([encode(x or "") for x in texts[at : at + 256]], pa.list_(pa.int32()))
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), ids], names=[*keep, new]
                )

    return run


def cut(texts: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(key, text) -> (key, chunk, start, last, text): overlapping chunks."""
    step = chunk_chars - overlap_chars

    def run(batches):
        for batch in batches:
            keys, whole = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for key, text in zip(keys, whole):
                n = max(1, -(-(len(text) - overlap_chars) // step))
                for at in range(0, n, 64):
                    some = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(some)),
                            pa.array(some, pa.int64()),
                            pa.array([i * step for i in some], pa.int64()),
                            pa.array([i == n - 1 for i in some]),
                            pa.array([text[i * step : i * step + chunk_chars] for i in some]),
                        ],
                        names=["key", "chunk", "start", "last", "text"],
                    )

    return texts.mapInArrow(
        run, "key string, chunk long, start long, last boolean, text string"
    )


def boundaries(chunks: DataFrame, shared, overlap_chars: int) -> DataFrame:
    """Each chunk's pre-token boundaries inside its overlaps, counted from the
    text's start: ``heads`` in the first ``overlap_chars`` code points, settled
    ``tails`` in the last."""

    def run(batches):
        scan = shared.value.built()[2].finditer
        for batch in batches:
            rows = batch.select(["start", "text"]).to_pylist()
            heads, tails = [], []
            for row in rows:
                start, text = row["start"], row["text"]
                head, tail = [], []
                first_tail, settled = len(text) - overlap_chars, len(text) - LOOK_AHEAD
                for match in scan(text):
                    if match.start() < overlap_chars:
                        head.append(start + match.start())
                    if first_tail <= match.end() <= settled:
                        tail.append(start + match.end())
                heads.append(head)
                tails.append(tail)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("chunk"), pa.array(heads, many), pa.array(tails, many)],
                names=["key", "chunk", "heads", "tails"],
            )

    return chunks.select("key", "chunk", "start", "text").mapInArrow(
        run, "key string, chunk long, heads array<long>, tails array<long>"
    )


def stitches(bounds: DataFrame) -> DataFrame:
    """(key, chunk, cut, next_cut, piece): where a chunk is stitched to the one
    before and to the next. After an overlap without a common boundary nothing
    is proven, so from there on there are no stitches."""
    of_text = Window.partitionBy("key").orderBy("chunk")
    common = F.array_min(F.array_intersect(F.lag("tails").over(of_text), F.col("heads")))
    proven = F.min(
        (F.col("chunk") == 0) | F.col("common").isNotNull()
    ).over(of_text.rowsBetween(Window.unboundedPreceding, 0))
    own = F.when(F.col("chunk") == 0, F.lit(0)).when(F.col("proven"), F.col("common"))
    return (
        bounds.withColumn("common", common)
        .withColumn("proven", proven)
        .withColumn("cut", own)
        .select(
            "key",
            "chunk",
            "cut",
            F.lead("cut").over(of_text).alias("next_cut"),
            F.max(F.when(F.col("cut").isNotNull(), F.col("chunk")))
            .over(of_text.rowsBetween(Window.unboundedPreceding, 0))
            .alias("piece"),
        )
    )


def _pieces(chunks: DataFrame, shared, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(key, piece, text): the texts between stitches."""
    end = F.col("start") + F.lit(chunk_chars)
    begin_at = F.coalesce("cut", F.col("start") + F.lit(overlap_chars))
    end_at = F.coalesce("next_cut", end)
    parts = chunks.join(stitches(boundaries(chunks, shared, overlap_chars)), ["key", "chunk"]).select(
        "key",
        "chunk",
        "piece",
        F.col("text")
        .substr((begin_at - F.col("start") + 1).cast("int"), (end_at - begin_at).cast("int"))
        .alias("text"),
        ((F.col("piece") == F.col("chunk")) & (F.col("last") | F.col("next_cut").isNotNull())).alias(
            "whole"
        ),
    )
    whole = parts.filter("whole").select("key", "piece", "text")
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    run_on = (  # the rest of one text at most
        parts.filter("NOT whole")
        .groupBy("key", "piece")
        .agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"))
    )
    return whole.unionByName(run_on)


def encode(
    docs: DataFrame,
    shared,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id, ids array<int>[, carry]) for every row; ``shared`` is ``vocabulary(...)``."""
    if chunk_chars < 3 * overlap_chars or overlap_chars <= LOOK_AHEAD:
        raise ValueError("chunks must be at least three overlaps long")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        *([F.col(carry).alias("_carry")] if carry else []),
    )
    keep = [c for c in rows.columns if c != "_text"]
    is_long = F.coalesce(F.length("_text"), F.lit(0)) > chunk_chars
    kept = [f for f in rows.schema.fields if f.name in keep]
    out_schema = rows.select(*[f.name for f in kept]).withColumn("ids", F.array(F.lit(0))).schema

    short = rows.filter(~is_long).mapInArrow(_encoder(shared, "_text", "ids", keep), out_schema)

    long_rows = rows.filter(is_long)
    key = F.sha2("_text", 256).alias("key")
    chunks = staged(
        cut(long_rows.select(key, F.col("_text").alias("text")), chunk_chars, overlap_chars)
        .groupBy("key", "chunk")  # a repeated text is encoded once
        .agg(*(F.first(c).alias(c) for c in ("start", "last", "text"))),
        "bpe-chunks",
    )
    encoded = _pieces(chunks, shared, chunk_chars, overlap_chars).mapInArrow(
        _encoder(shared, "text", "ids", ["key", "piece"]), "key string, piece long, ids array<int>"
    )
    in_order = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    joined = encoded.groupBy("key").agg(  # the ids of one text
        F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids")
    )
    long = long_rows.select(*keep, key).join(joined, "key").select(*keep, "ids")
    out = short.unionByName(long)
    return out.select(
        F.col("_id").alias(id_col), "ids", *([F.col("_carry").alias(carry)] if carry else [])
    )


def decode(tokens: DataFrame, shared, ids: str = "ids", new: str = "bytes") -> DataFrame:
    """``tokens`` with ``new``, the raw bytes of each row's ``ids`` joined; a
    null list gives no bytes."""
    names = [c for c in tokens.columns if c != new]

    def run(batches):
        by_id = shared.value.built()[1]
        for batch in batches:
            lists = batch.column(ids)
            for at in range(0, len(lists), 256):
                part = batch.slice(at, 256)
                joined = [b"".join(map(by_id.__getitem__, x or ())) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in names), pa.array(joined, pa.binary())],
                    names=[*names, new],
                )

    schema = tokens.select(*names).withColumn(new, F.lit(b"")).schema
    return tokens.select(*names).mapInArrow(run, schema)


def digests(tokens: DataFrame, shared, id_col: str = "doc_id") -> DataFrame:
    """Per row: number of ids, SHA-256 of the decimal ids joined by commas and
    of the decoded bytes."""
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    counted = tokens.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(counted, shared).select(
        id_col, "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256")
    )
