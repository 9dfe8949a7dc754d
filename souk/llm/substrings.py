"""Substring dedup of word windows: seeds, extension, maximal repeats.

A window is ``length`` consecutive words. Its seed is the least hash among
its ``gram``-word grams (the last of equal ones), a function of the window's
words only, so equal windows have equal seeds: only places with the same seed
can repeat each other. Consecutive windows with the same seed occurrence form
a segment; a text has about 2 / (length - gram + 2) segments per word.

1. Segments' seeds are counted (partial counts first); segments whose seed
   occurs once hold no repeat and go no further: the join on seeds keeps the
   others.
2. Segments are extended both ways from the seed as far as their windows
   reach: segments of the same words in the same place around the seed are
   one class. All occurrences of a class but the first are repeats as a whole.
3. Where a seed has more than one class (the ends of a repeat, where the words
   beside it differ), the windows of the classes' first occurrences are hashed
   and the first of each window is found; the others are repeats.

Each step is an aggregate with partial results or a join against one row per
class, so a passage of very many documents is neither gathered nor paired.
The overlapping repeats of a document add up to maximal ones, whose words are
removed. Seeds, classes and windows are told apart by 128 bits.

Occurrences are ordered by (id, start); a window is a repeat if its words start
at a smaller (id, start). Defined results: texts below ``length`` words lose
nothing; a null text has no words; null ids are smaller than all others;
rows that repeat an id with the same text keep and lose the same words (equal
(id, start) isn't earlier); empty table, empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import NO_ID, raw, staged

# A document: its id, and 128 bits of its text, which tell apart rows that
# share an id (or have none).
OWN = ["_id", "_mark", "_mark2"]
LENGTH = 20
GRAM = 6
_BLOCK = 1 << 17  # words hashed at once
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 2**64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Scanner:
    """Segments and windows of a text's words, a block of words at a time."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.tables = [_powers(b, _BLOCK + length) for b in _BASES]

    def _sums(self, words: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.tables[k][1][: len(words)])])

    def blocks(self, words: list[bytes]):
        """(first word, seed of each window, its place, sums for hashes)."""
        digest = xxhash.xxh3_64_intdigest
        for at in range(0, len(words) - self.length + 1, _BLOCK):
            some = words[at : at + _BLOCK + self.length - 1]
            x = np.array([digest(w) for w in some], np.uint64)
            n, windows = len(x), len(x) - self.length + 1
            sums = self._sums(x, 0)
            grams = _mix((sums[self.gram :] - sums[: n - self.gram + 1]) * self.tables[0][0][: n - self.gram + 1])
            wide = self.length - self.gram + 1
            view = np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1]
            place = np.arange(windows) + (wide - 1) - view.argmin(1)
            yield at, grams[place], place, self._sums(x, 1)

    def _hash(self, sums: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (sums[e] - sums[a]) * self.tables[1][0][a]

    def segments(self, words: list[bytes]):
        """(seed, class hash, first window, windows) of each segment."""
        for at, seed, place, sums in self.blocks(words):
            a = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            n = np.diff(np.concatenate([a, [len(place)]]))
            own = self._hash(sums, a, a + n - 1 + self.length)
            shape = (place[a] - a).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64)
            yield seed[a], _mix(own ^ _mix(shape + _BASES[0])), a + at, n

    def windows(self, words: list[bytes], wanted: list[tuple[int, int]]):
        """(seed, window hash, start) of the windows in ``wanted`` ranges."""
        chosen = np.zeros(max(0, len(words) - self.length + 1) + 1, np.int64)
        for a, n in wanted:
            chosen[a] += 1
            chosen[a + n] -= 1
        chosen = np.flatnonzero(np.cumsum(chosen[:-1]) > 0)
        for at, seed, place, sums in self.blocks(words):
            own = chosen[(chosen >= at) & (chosen < at + len(place))] - at
            if len(own):
                yield seed[own], _mix(self._hash(sums, own, own + self.length)), own + at


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype(np.uint64).view(np.int64))


def _longs(parts: list) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))


def _own(batch: pa.RecordBatch, rows: list) -> list[pa.Array]:
    """The ``OWN`` columns of the rows with these numbers."""
    at = _longs(rows)
    return [batch.column(c).take(at) for c in OWN]


_OWN_SCHEMA = ", ".join(f"{c} long" for c in OWN)


def _segments(docs: DataFrame, length: int, gram: int, seeds_only: bool) -> DataFrame:
    def run(batches):
        scan = Scanner(length, gram)
        for batch in batches:
            seeds, classes, starts, counts, rows = [], [], [], [], []
            for row, text in enumerate(raw(batch.column("_text"))):
                for seed, own, a, n in scan.segments(text.split()):
                    seeds.append(seed)
                    if not seeds_only:
                        classes.append(own)
                        starts.append(a)
                        counts.append(n)
                        rows.append(np.full(len(a), row, np.int64))
            if seeds_only:
                yield pa.RecordBatch.from_arrays([_signed(seeds)], names=["h"])
                continue
            yield pa.RecordBatch.from_arrays(
                [_signed(seeds), _signed(classes), *_own(batch, rows), _longs(starts), _longs(counts)],
                names=["h", "g", *OWN, "a", "n"],
            )

    schema = "h long" if seeds_only else f"h long, g long, {_OWN_SCHEMA}, a long, n long"
    return docs.select(*([] if seeds_only else OWN), "_text").mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(``OWN``, a, n): every window that is a repeat, as ranges of window
    starts. ``docs`` has (``OWN``, _text), none null."""
    counted = _segments(docs, length, gram, seeds_only=True).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    again = staged(counted.filter("c > 1").select("h"), "substrings-seeds")
    found = staged(
        _segments(docs, length, gram, seeds_only=False).join(again, "h"), "substrings-segments"
    )
    classes = staged(
        found.groupBy("h", "g").agg(F.min(F.struct("_id", "a", "_mark", "_mark2", "n")).alias("first")),
        "substrings-classes",
    )
    place, first = F.struct("_id", "a"), F.struct("first._id", "first.a")
    whole = found.join(classes, ["h", "g"]).filter(place != first).select(*OWN, "a", "n")

    several = staged(
        classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"),
        "substrings-several",
    )
    wanted = classes.join(several, "h").select("first.*").groupBy(*OWN).agg(
        F.collect_list(F.struct("a", "n")).alias("wanted")  # segments of one text
    )

    def run(batches):
        scan = Scanner(length, gram)
        for batch in batches:
            seeds, own, starts, rows = [], [], [], []
            for row, (want, text) in enumerate(zip(batch.column("wanted").to_pylist(), raw(batch.column("_text")))):
                for seed, w, a in scan.windows(text.split(), [(x["a"], x["n"]) for x in want]):
                    seeds.append(seed)
                    own.append(w)
                    starts.append(a)
                    rows.append(np.full(len(a), row, np.int64))
            yield pa.RecordBatch.from_arrays(
                [_signed(seeds), _signed(own), *_own(batch, rows), _longs(starts)], names=["h", "w", *OWN, "a"]
            )

    windows = staged(
        docs.join(wanted, OWN).mapInArrow(run, f"h long, w long, {_OWN_SCHEMA}, a long"),
        "substrings-windows",
    )
    firsts = staged(
        windows.groupBy("h", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1").drop("c"),
        "substrings-firsts",
    )
    single = windows.join(firsts, ["h", "w"]).filter(place != F.col("first")).select(
        *OWN, "a", F.lit(1).cast("long").alias("n")
    )
    return whole.unionByName(single)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row; ``kept`` joins the words
    that stay by one space."""
    if not 1 <= gram <= length or length - gram >= 64:
        raise ValueError("1 <= gram <= length and length - gram < 64")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_mark"),
        F.xxhash64(F.lit(1), text).alias("_mark2"),
        text.alias("_text"),
    )
    ranges = repeats(rows, length, gram).groupBy(*OWN).agg(
        F.collect_list(F.struct("a", "n")).alias("gone")  # repeats of one text
    )

    def run(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, gone in zip(raw(batch.column("_text")), batch.column("gone").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if gone:
                    edge = np.zeros(len(words) + 1, np.int64)
                    a = np.array([x["a"] for x in gone])
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + [x["n"] + length - 1 for x in gone], -1)
                    stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[k] for k in stays]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["_id", "n_words", "n_removed", "kept"],
            )

    out = rows.join(ranges, OWN, "left").mapInArrow(
        run, "_id long, n_words long, n_removed long, kept string"
    )
    own = F.when(F.col("_id") != F.lit(NO_ID), F.col("_id"))
    return out.select(own.alias(id_col), "n_words", "n_removed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS did,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (
  SELECT rid, did, s, sha256(array_to_string(ws[s:s + 19], ' ')) AS w
  FROM (SELECT rid, did, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
firsts AS (SELECT w, min((did, s)) AS f FROM win GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT rid, unnest(generate_series(s, s + 19)) AS i
  FROM win JOIN firsts USING (w) WHERE (did, s) > f),
words AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words,
  CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (rid)
"""
