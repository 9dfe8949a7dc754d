"""Best-fit packing of token sequences by minimum bin slack.

A document is its ids and one end id. Only documents longer than the capacity
are cut, into pieces of the full capacity counted from the document's end, so
that the first piece may be shorter. Pieces are packed into sequences of at
most ``capacity`` tokens.

Which pieces share a sequence depends on lengths alone, and there are at most
``capacity`` different lengths, so the plan is made on the driver from the
count of each length. Per sequence, the longest piece left is put in (it has
to go somewhere, and only gets harder to place), and a subset-sum dynamic
program over the available lengths, held as the bits of one integer, finds
the fullest feasible combination for the rest; the combination is removed.
As long as all its lengths remain, the next sequence would get the same
combination, so it is taken as often as its lengths last: the steps follow
the capacity, not the data. The plan is a list of runs: the pieces of one
length, in order, from a place on, k to a sequence.

Pieces get their global places in the order of (length, id, piece) by ranges,
and a search among the runs' starts gives sequence and offset: no length is
gathered in one task, however many pieces share it.

Ids: tokens of the vocabulary file of the ``tokenizers`` library, found with
its ranks in the ``tiktoken`` library, which is four times as fast and gives
the same ids (tests hold them against each other). Texts are encoded ``SPAN``
code points at a time, cut before a single space between two other
characters, where a pre-token always begins.

Defined results: a null text is the empty text, one piece of the end id
alone; strings of special tokens are ordinary text; repeated rows are
documents of their own; null ids are kept. Sequence numbers run from 0
without gaps. An empty table gives an empty result. Other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.bpe import Vocabulary
from souk.llm.common import carried, positions, slices, staged

CAPACITY = 1024
END_ID = 2
SPAN = 1 << 16
_CUT = re.compile(r"(?<=\S)(?= \S)")


# --- ids -----------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file:
    printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
    """The byte-level BPE of a ``tokenizers`` file as ranks, broadcast (its size
    is the file's). Its ids must be in the order of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    as_bytes = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
    ids = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if [ids[m] for m in merged] != sorted(ids[m] for m in merged) or len(merged) + 256 != len(ids):
        raise ValueError("the vocabulary's ids are not in the order of its merges")
    ranks = b"\n".join(base64.b64encode(b) + b" %d" % ids[t] for t, b in as_bytes.items())
    return spark.sparkContext.broadcast(Vocabulary(ranks, pattern))


def ids_of(text: str, encoder, span: int = SPAN) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + span) if len(text) - at > span else None
        end = cut.start() if cut else len(text)
        ids = encoder.encode_ordinary(text[at:end])
        out.append(np.array(ids, "<u4").tobytes())
        at = end
    return b"".join(out)


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(
    docs: DataFrame, shared, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool
) -> DataFrame:
    """(_id, piece, start, length, ids_crc32[, ids]) of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = shared.value.built()[0]
        for batch in slices(batches):
            rows, found, at = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = ids_of(text or "", encoder) + end
                for p, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    some = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((p, start, length, zlib.crc32(some)))
                    if with_ids:
                        found.append(np.frombuffer(some, "<u4").astype(np.int32))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [batch.column("_id").take(pa.array(at, pa.int64()))]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            if with_ids:
                columns.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return carried(docs, id_col, text_col).select("_id", "_text").mapInArrow(run, schema)


# --- the plan ------------------------------------------------------------------


def fullest(counts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The fullest combination within ``room``: [(length, how many)]. ``counts``
    holds (length, available), longest first; longer pieces are preferred."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length, available in counts:
        if length > room:
            continue
        steps.append((length, reach))
        left, chunk = min(available, room // length), 1
        while left > 0:  # sums of 1, 2, 4, ... and the rest make every number
            take = min(chunk, left)
            reach |= (reach << (take * length)) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total, k = total - length, k + 1
        if k:
            out.append((length, k))
    return out[::-1]


@dataclass
class Run:
    """The pieces of ``length`` from place ``first`` on (counted among that
    length) go ``k`` to a sequence, from sequence ``sequence`` on, at ``offset``."""

    length: int
    first: int
    k: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """(runs, number of sequences) for ``counts`` {length: pieces}."""
    left = {length: counts[length] for length in sorted(counts, reverse=True) if counts[length]}
    used = dict.fromkeys(left, 0)
    runs, sequence = [], 0
    while left:
        longest = next(iter(left))
        rest = [(x, n - (x == longest)) for x, n in left.items() if n > (x == longest)]
        chosen = dict(fullest(rest, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // k for x, k in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            runs.append(Run(x, used[x], chosen[x], sequence, offset))
            offset += x * chosen[x]
            used[x] += chosen[x] * times
            left[x] -= chosen[x] * times
            if not left[x]:
                del left[x]
        sequence += times
    return runs, sequence


# --- operators -----------------------------------------------------------------


def pack(
    docs: DataFrame,
    shared,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every
    piece. ``shared`` comes from ``vocabulary``."""
    cut = staged(pieces(docs, shared, id_col, text_col, capacity, end_id, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    # places among all pieces, ordered by length
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    table = np.array(
        sorted((before[r.length] + r.first, r.length, r.k, r.sequence, r.offset) for r in runs), np.int64
    ).reshape(-1, 5)
    plan_of = docs.sparkSession.sparkContext.broadcast(table)  # grows with the capacity only
    order = [F.col(c).asc() for c in ("length", "_id", "piece", "ids_crc32")]
    placed = positions(cut, order, "pack-places")
    kept = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        first, length, k, sequence, offset = plan_of.value.T
        for batch in batches:
            at = batch.column("_pos").to_numpy()
            i = np.searchsorted(first, at, side="right") - 1
            turn, slot = np.divmod(at - first[i], k[i])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence[i] + turn), pa.array(offset[i] + slot * length[i])],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = placed.select(*kept).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    out = placed.select(*kept, "_pos").mapInArrow(run, schema)
    return out.select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, pieces, ids) of ``pack(..., with_ids=True)``: a
    sequence is a bounded group, at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.count(F.lit(1)).alias("pieces"),
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"),
    )
