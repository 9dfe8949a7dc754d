"""CSV records with quoted line breaks, read by many tasks per file.

A quoted value may hold line breaks, so where a record ends depends on the
quotes before it, and Spark's multi-line reader gives a whole file to one
task. Here a file is split by bytes as any text file:

1. Every split is scanned under both assumptions, that it starts outside and
   inside a quoted value, and leaves one row: the state at its end, its bytes,
   and the lines of the records that cross its borders (for each assumption).
2. The splits' rows are few. A split maps the state at its start to the state
   at its end, in one of four ways: keep it, flip it, or set it to one of the
   two. Where a split starts follows from the last split before it that sets
   the state and the parity of the flips since: two running aggregates over
   the splits of a file.
3. The records that cross borders are put together from these rows; a second
   scan, told the state at each split's start, gives the records inside.

Nothing but border lines is shuffled and no record depends on where the cuts
fall. The driver and the tasks of the second scan hold three numbers for each
split (at 128 MB a split, one five-millionth of the data).

Quotes as in the reader for single lines: a value is quoted if the quote is
its first character, a doubled quote stands for one, a quote inside an
unquoted value is an ordinary character, and what follows a closing quote up
to the next delimiter belongs to no quotes. Lines end in "\\n" or "\\r\\n";
breaks inside values stay as they are. Blank lines and a byte order mark are
dropped. A record of more than ``max_record`` bytes (an opening quote that is
never closed takes all that follows) is never put together: it has no text,
only its place and size.

Both scans must see the same splits. Spark cuts by the session's file
settings and its default parallelism; where executors come and go between
the scans, set ``spark.sql.files.minPartitionNum``. A split that the first
scan did not see raises.
"""

from __future__ import annotations

import csv
import sys
import uuid
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir

# the scans travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_RECORD = 16 << 20
MOST_HEADERS = 100
_BOM = b"\xef\xbb\xbf"
_ROWS = 1024  # records in an Arrow batch at most

_SPLIT_SCHEMA = """path string, block long, size long, header binary,
    ends_0 int, closes_0 boolean, head_0 binary, head_size_0 long, tail_0 binary, tail_size_0 long,
    ends_1 int, closes_1 boolean, head_1 binary, head_size_1 long, tail_1 binary, tail_size_1 long"""
RECORD_SCHEMA = "path string, offset long, header int, record binary, size long"


def ends_inside(line: bytes, inside: bool, quote: bytes = b'"', delimiter: bytes = b",") -> bool:
    """Whether a quoted value is open at the end of ``line``, given whether one
    is open at its start (else the line starts a record)."""
    at, opening = 0, delimiter + quote
    if not inside:
        if not line.startswith(quote):
            at = line.find(opening) + 1
            if not at:
                return False
        at += 1
    while True:
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):
            at += 2
            continue
        # closed; the next quoted value opens right after a delimiter
        at = line.find(opening, at + 1)
        if at < 0:
            return False
        at += 2


class _Border:
    """One assumption's view of a split: its first and last, unfinished, record."""

    def __init__(self, inside: bool, most: int):
        self.inside, self.closes, self.most = inside, False, most
        self.head, self.tail = None, []
        self.head_size = self.tail_size = 0

    def line(self, line: bytes, has_quote: bool) -> None:
        if has_quote:
            self.inside = ends_inside(line, self.inside)
        elif not self.inside and not self.tail_size:  # a record of one line
            if not self.closes:
                self.head_size, self.head, self.closes = len(line) + 1, line, True
            return
        self.tail_size += len(line) + 1
        if self.tail is not None:
            self.tail.append(line)
            if self.tail_size > self.most:
                self.tail = None
        if not self.inside:
            if not self.closes:
                self.head_size, self.head, self.closes = self.tail_size, self.text(), True
            self.tail, self.tail_size = [], 0

    def text(self) -> bytes | None:
        return None if self.tail is None else b"\n".join(self.tail)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("value").cast("binary").alias("line"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


def _by_split(batches):
    """(path, block, lines) runs of the batches, in their order; a split may
    come in several runs."""
    for batch in batches:
        paths, blocks = batch.column("path").dictionary_encode(), batch.column("block").to_numpy()
        lines = batch.column("line").to_pylist()
        new = (np.diff(paths.indices.to_numpy()) != 0) | (np.diff(blocks) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(lines)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                yield paths[start].as_py(), int(blocks[start]), lines[start:end]


def _scan_borders(most: int):
    def row(path, block, size, views):
        header = None
        if block == 0:
            if not views[0].closes:
                raise ValueError(f"{path}: the header does not end within the first split")
            header = (views[0].head or b"").removeprefix(_BOM).removesuffix(b"\r")
        out = [path, block, size, header]
        for v in views:
            closed = v.closes
            head = (v.head, v.head_size) if closed else (v.text(), v.tail_size)
            out += [int(v.inside), closed, *head, v.text() if closed else None, v.tail_size if closed else 0]
        return out

    def run(batches):
        names = [c.split()[0] for c in _SPLIT_SCHEMA.replace("\n", " ").split(",")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        kinds += [pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64()] * 2
        make = lambda r: pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(r, kinds)], names=names
        )
        now, views, size = None, (), 0
        for path, block, lines in _by_split(batches):
            if now != (path, block):
                if now:
                    yield make(row(*now, size, views))
                now, views, size = (path, block), (_Border(False, most), _Border(True, most)), 0
            for line in lines:
                has_quote = b'"' in line
                size += len(line) + 1
                for v in views:
                    v.line(line, has_quote)
        if now:
            yield make(row(*now, size, views))

    return run


@dataclass
class _Known:
    """What the second scan knows of a file's splits, in order."""

    header: int
    blocks: list[int]
    inside: list[bool]
    offsets: list[int]


def _scan_records(known, most: int):
    def run(batches):
        files = known.value
        out = []

        def full():
            columns = zip(*out)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["path", "offset", "header", "record", "size"],
            )
            out.clear()
            return batch

        now = None
        held = 0
        for path, block, lines in _by_split(batches):
            if now != (path, block):
                now, file = (path, block), files[path]
                i = bisect_left(file.blocks, block)
                if i == len(file.blocks) or file.blocks[i] != block:
                    raise RuntimeError(f"{path} was split anew between two scans: set spark.sql.files.minPartitionNum")
                offset, inside = file.offsets[i], file.inside[i]
                crossing, parts, size = inside, [], 0
            for line in lines:
                if inside or b'"' in line:
                    inside = ends_inside(line, inside)
                size += len(line) + 1
                if parts is not None and not crossing:
                    parts.append(line)
                    if size > most:
                        parts = None
                if inside:
                    continue
                if not crossing:
                    record = None if parts is None else b"\n".join(parts).removesuffix(b"\r")
                    if offset == 0:
                        record = None  # the header; its file's first record
                    elif record is None or record:
                        out.append((path, offset, file.header, record, size - 1))
                        held += len(record or b"")
                        if len(out) >= _ROWS or held > most:
                            yield full()
                            held = 0
                offset += size
                crossing, parts, size = False, [], 0
        if out:
            yield full()

    return run


@dataclass
class Records:
    """(path, offset, header, record, size) of every record below the headers,
    and the columns of each distinct header."""

    rows: DataFrame
    headers: list[list[str]]


def _staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def header_columns(text: bytes) -> list[str]:
    return next(csv.reader([text.decode("utf-8")]), [])


def _states(splits: DataFrame) -> DataFrame:
    """The splits with the state each starts in, its first line's offset in the
    file, and its border lines under that state."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flips", ((F.col("ends_0") == 1) & (F.col("ends_1") == 0)).cast("int"))
    splits = splits.withColumn("flipped", F.coalesce(F.sum("flips").over(before), F.lit(0)))
    sets = F.when(F.col("ends_0") == F.col("ends_1"), F.struct("ends_0", "flipped"))
    splits = splits.withColumn("set", F.last(sets, ignorenulls=True).over(before))
    state = F.coalesce(F.col("set.ends_0"), F.lit(0)) + F.col("flipped") - F.coalesce(F.col("set.flipped"), F.lit(0))
    inside = F.pmod(state, F.lit(2)) == 1
    pick = lambda c: F.when(inside, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")).alias(c)
    return splits.select(
        "path", "block", "size", "header", inside.alias("inside"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        *(pick(c) for c in ("ends", "closes", "head", "head_size", "tail", "tail_size")),
    )


def _crossing(splits: DataFrame, most: int) -> DataFrame:
    """(path, offset, record, size) of the records that cross borders; a record
    is named by the split that it starts in."""
    open_here = (F.col("ends") == 1) & (~F.col("inside") | F.col("closes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("chain", F.last(F.when(open_here, F.col("block")), ignorenulls=True).over(before))
    # a split without an end of a record, from outside: all of it is the tail
    whole = ~F.col("inside") & ~F.col("closes")
    tail = F.when(whole, F.col("head")).otherwise(F.col("tail"))
    tail_size = F.when(whole, F.col("head_size")).otherwise(F.col("tail_size"))
    starts = splits.filter(open_here).select(
        "path", F.col("block").alias("chain"), "block", tail.alias("text"), tail_size.alias("part"),
        (F.col("offset") + F.col("size") - tail_size).alias("offset"),
    )
    follows = splits.filter("inside").select(
        "path", "chain", "block", F.col("head").alias("text"), F.col("head_size").alias("part"),
        F.lit(None).cast("long").alias("offset"),
    )
    parts = starts.unionByName(follows)
    chain = Window.partitionBy("path", "chain")
    # sizes first: the lines of a record that is too long are not gathered
    parts = parts.withColumn("total", F.sum("part").over(chain)).withColumn(
        "text", F.when(F.col("total") <= most, F.col("text"))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"].cast("string"))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\r\z", "")
    return (
        parts.groupBy("path", "chain")
        .agg(F.max("offset").alias("offset"), F.max("total").alias("size"), text.alias("record"))
        .filter("offset > 0")
        .select(
            "path", "offset",
            F.when(F.col("size") <= most, F.col("record").cast("binary")).alias("record"),
            (F.col("size") - 1).alias("size"),
        )
    )


def records(spark: SparkSession, paths: list[str], max_record: int = MAX_RECORD) -> Records:
    """The records of CSV files; runs the first scan."""
    lines = _lines(spark, paths)
    splits = _staged(_states(lines.mapInArrow(_scan_borders(max_record), _SPLIT_SCHEMA)), "csv-splits")
    distinct = [
        bytes(r["header"])
        for r in splits.filter("block = 0").select("header").distinct().orderBy("header").limit(MOST_HEADERS + 1).collect()
    ]
    if len(distinct) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    number = {h: i for i, h in enumerate(distinct)}
    states = splits.groupBy("path").agg(
        F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "inside", "offset"))).alias("splits")
    )
    files = {}
    for r in states.toLocalIterator():
        found = r["splits"]
        files[r["path"]] = _Known(
            number[bytes(r["header"])], [s["block"] for s in found], [s["inside"] for s in found], [s["offset"] for s in found]
        )
    known = spark.sparkContext.broadcast(files)
    inner = lines.mapInArrow(_scan_records(known, max_record), RECORD_SCHEMA)
    file_header = splits.filter("block = 0").select(
        "path", F.coalesce(*(F.when(F.col("header") == F.lit(h), F.lit(i)) for h, i in number.items()), F.lit(0)).alias("number")
    ) if number else splits.select("path", F.lit(0).alias("number"))
    crossing = _crossing(splits, max_record).join(file_header, "path").select(
        "path", "offset", F.col("number").cast("int").alias("header"), "record", "size"
    )
    return Records(inner.unionByName(crossing), [header_columns(h) for h in distinct])


def file_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The header's columns of each file, all in one job."""

    def run(batches):
        seen, header, path_of = None, b"", None
        for path, block, lines in _by_split(batches):
            if block != 0 or path == seen:
                continue
            inside = path == path_of  # a header that goes on in the next batch
            path_of, header = path, header if inside else b""
            for line in lines:
                header += (b"\n" if inside else b"") + line
                inside = ends_inside(line, inside)
                if not inside:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([header], pa.binary())], names=["path", "header"])
                    seen = path
                    break

    found = _lines(spark, paths).mapInArrow(run, "path string, header binary").collect()  # one row per file
    return {r["path"]: header_columns(bytes(r["header"]).removeprefix(_BOM).removesuffix(b"\r")) for r in found}
