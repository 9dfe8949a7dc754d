"""CSV files cut at many places: records, headers and rejects."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from souk.sources import records
from souk.sources.catalog import read_csv_table, read_csv_with_rejects
from souk.sources.schemas import ORDER_REVIEWS

HEADER = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp"


@pytest.fixture
def cut_every(spark):
    """Sets how many bytes a split has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield put
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def message(rng):
    parts = ["plain", "two\nlines", "a\r\nb", '"', '""', ",", "", " ", "é日本", '",', ',"', '\n"\n', "x" * rng.randrange(40)]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(6)))


def field(text, rng):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') or rng.random() < 0.3 else text


def review_file(rng, n, end="\n"):
    rows = [HEADER]
    for i in range(n):
        score = str(rng.randrange(1, 6)) if rng.random() < 0.9 else rng.choice(["", "five", "5.0"])
        day = rng.choice(["2018-01-02 03:04:05", "", "soon"])
        cells = [f"r{i}", f"o{i % 7}", score, rng.choice(["", 'an 5" inch', "it's"]), message(rng), "2017-05-06 07:08:09", day]
        rows.append(",".join([*(c if j == 3 else field(c, rng) for j, c in enumerate(cells))]))
    return end.join(rows) + (end if rng.random() < 0.5 else "")


def one_task(spark, path):
    """The single-task reader of quoted line breaks."""
    return (
        spark.read.options(header=True, escape='"', multiLine=True, mode="PERMISSIVE", timestampNTZFormat="yyyy-MM-dd HH:mm:ss")
        .schema(ORDER_REVIEWS).csv(str(path))
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_cut_at_fifty_places_equals_one_task(spark, tmp_path, cut_every, seed):
    rng = random.Random(seed)
    path = tmp_path / "order_reviews.csv"
    path.write_bytes(review_file(rng, 150).encode())
    whole = rows_of(one_task(spark, path))
    assert len(whole) == 150
    cut_every(path.stat().st_size // 50)
    df = read_csv_table(spark, str(path), "order_reviews")
    assert rows_of(df) == whole
    assert df.rdd.getNumPartitions() >= 50


def test_windows_line_ends(spark, tmp_path, cut_every):
    rng = random.Random(9)
    path = tmp_path / "order_reviews.csv"
    text = review_file(rng, 60, "\r\n")
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    cut_every(500)
    got = {r["review_id"]: r for r in read_csv_table(spark, str(path), "order_reviews").collect()}
    assert sorted(got) == sorted(f"r{i}" for i in range(60))
    # breaks inside values stay; the last value has no trailing carriage return
    assert any("\r\n" in (r["review_comment_message"] or "") for r in got.values())
    path.write_bytes(text.replace("\r\n", "\n").encode())
    for r in one_task(spark, path).collect():
        assert got[r["review_id"]]["review_answer_timestamp"] == r["review_answer_timestamp"]


def test_many_files_with_columns_in_any_order(spark, tmp_path, cut_every):
    names = HEADER.split(",")
    for i in range(12):
        order = names if i % 2 else names[::-1]
        cells = dict.fromkeys(names, "") | {"review_id": f"r{i}", "review_comment_message": f'"a\n{i}"', "review_score": str(i)}
        (tmp_path / f"order reviews {i}.csv").write_text(",".join(order) + "\n" + ",".join(cells[c] for c in order) + "\n")
    (tmp_path / "nothing.csv").write_text("")
    for size in (40, 10_000):
        cut_every(size)
        got = read_csv_table(spark, [str(p) for p in sorted(tmp_path.iterdir())], "order_reviews").collect()
        assert sorted((r["review_id"], r["review_score"], r["review_comment_message"]) for r in got) == sorted(
            (f"r{i}", i, f"a\n{i}") for i in range(12)
        )


def test_headers_of_all_files_in_one_job(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"c {i}.csv").write_text('customer_id,"a\nb"\n1,2\n' if i else "customer_id\n1\n")
    got = records.file_headers(spark, [str(tmp_path)])
    assert sorted(got.values()) == [["customer_id"]] + [["customer_id", "a\nb"]] * 4


def test_rejects_name_place_column_and_text(spark, tmp_path, cut_every):
    lines = [
        'r1,o1,5,,"fine\nhere",2017-01-01 00:00:00,',
        'r2,o2,five,,"bad\nscore",2017-01-01 00:00:00,',
        "r3,o3,4,,,yesterday,tomorrow",
        'r4,o4,4,,"too\nmany",2017-01-01 00:00:00,,more',
        "r5,o5,4",
        "r6,o6,3,,,,",
    ]
    text = HEADER + "\n" + "\n".join(lines) + "\n"
    path = tmp_path / "order_reviews.csv"
    path.write_text(text)
    for size in (30, 10_000):
        cut_every(size)
        rows, rejects = read_csv_with_rejects(spark, str(path), "order_reviews")
        assert sorted(r["review_id"] for r in rows.collect()) == ["r1", "r2", "r3", "r4", "r5", "r6"]
        got = {(r["offset"], r["column"], r["reason"], r["raw"]) for r in rejects.collect()}
        at = [text.index(x) for x in lines]
        assert got == {
            (at[1], "review_score", "value", "five"),
            (at[2], "review_creation_date", "value", "yesterday"),
            (at[2], "review_answer_timestamp", "value", "tomorrow"),
            (at[3], None, "number of fields", lines[3]),
            (at[4], None, "number of fields", lines[4]),
        }


def test_a_record_that_is_too_long_has_a_place_only(spark, tmp_path, cut_every):
    path = tmp_path / "order_reviews.csv"
    text = HEADER + "\nr1,o1,5,,,,\n" + 'r2,o2,5,,"never closed\n' + "x\n" * 500
    path.write_text(text)
    for size in (128, 100_000):
        cut_every(size)
        rows, rejects = read_csv_with_rejects(spark, str(path), "order_reviews", max_record=300)
        assert [r["review_id"] for r in rows.collect()] == ["r1"]
        (only,) = rejects.collect()
        assert (only["offset"], only["reason"], only["raw"]) == (text.index("r2"), "longer than 300 bytes", None)
    # within the limit it is the file's last record, to its end
    cut_every(64)
    last = read_csv_table(spark, str(path), "order_reviews").filter("review_id = 'r2'").first()
    assert last["review_comment_message"] == "never closed\n" + "\n".join("x" * 500)


def test_line_states():
    for line, inside, end in [
        (b"a,b", False, False), (b'a,"b', False, True), (b'"a', False, True), (b'a"b,c', False, False),
        (b'"a""b",c', False, False), (b'"a"b"c,"d', False, True), (b'x",y', True, False), (b'x""y', True, True),
        (b'"', True, False), (b'","', True, True), (b"", True, True), (b"", False, False), (b'"a",', False, False),
    ]:
        assert records.ends_inside(line, inside) == end


def test_no_files_lines_or_rows(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(HEADER + "\n")
    rows, rejects = read_csv_with_rejects(spark, str(tmp_path), "order_reviews")
    assert rows.collect() == [] and rejects.collect() == [] and rows.columns == HEADER.split(",")
    (tmp_path / "order_reviews.csv").write_text("")
    with pytest.raises(ValueError, match="no file with a header"):
        read_csv_table(spark, str(tmp_path), "order_reviews")
