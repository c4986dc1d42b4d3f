"""Readers, typed normalisation, profiles, metric log and quality metrics."""

import csv
import gzip
import io
from collections import Counter
from datetime import date, datetime, timezone

import pytest
from py4j.protocol import Py4JJavaError
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillsight import jobs, session
from tillsight.operators import quality
from tillsight.operators.churn import churn_score
from tillsight.operators.normalize import normalize
from tillsight.operators.notices import notice_summary
from tillsight.operators.profile import profile, profile_all
from tillsight.operators.sufficiency import data_sufficiency
from tillsight.plans import shared
from tillsight.schemas import DATASETS, FEEDS, dataset
from tillsight.sources import append_metrics, load_metrics, read_feed, read_notices, read_raw, readers, write_scores, write_table

STAMP = "2026-03-15T09:00:00+09:00"
MENU = {"menu_id": "M1", "store_id": "S1", "price": "8500.0", "cost": "5100", "quantity": "620", "margin_rate": "0.40",
        "category": "set", "source_name": "m.csv", "uploaded_at": STAMP}


def write_csv(path, records, header=None):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.DictWriter(handle, header or list(records[0]))
        writer.writeheader()
        writer.writerows(records)
    return str(path)


def test_csv_by_header_name(spark, tmp_path):
    record = {**MENU, "category": 'say "hi", friend', "extra": "x"}
    path = write_csv(tmp_path / "menu.csv", [record], sorted(record, reverse=True))
    raw = read_raw(spark, "menu", path)
    assert raw.columns == [name for name, _ in dataset("menu").all_columns]
    assert set(dict(raw.dtypes).values()) == {"string"}
    found = normalize(raw, "menu").first()
    assert found["price"] == 8500
    assert found["category"] == 'say "hi", friend'
    instant = normalize(raw, "menu").select(F.unix_timestamp("uploaded_at")).first()[0]
    assert instant == datetime(2026, 3, 15, tzinfo=timezone.utc).timestamp()


def test_line_breaks_inside_fields(spark, tmp_path):
    path = write_csv(tmp_path / "menu.csv", [{**MENU, "category": "a\nb"}])
    assert read_raw(spark, "menu", path).first()["category"] == "a\nb"


def test_every_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "menus"
    folder.mkdir()
    names = list(MENU)
    write_csv(folder / "a.csv", [{**MENU, "menu_id": "M1"}, {**MENU, "menu_id": "M2"}], names)
    write_csv(folder / "b.csv", [{**MENU, "menu_id": "M3", "category": "two\nlines"}], names[::-1])
    fewer = [n for n in names if n != "category"]
    write_csv(folder / "c.csv", [{k: v for k, v in {**MENU, "menu_id": "M4"}.items() if k in fewer}], fewer)
    found = {r["menu_id"]: r for r in read_raw(spark, "menu", str(folder)).collect()}
    assert set(found) == {"M1", "M2", "M3", "M4"} and {r["store_id"] for r in found.values()} == {MENU["store_id"]}
    assert found["M3"]["category"] == "two\nlines" and found["M4"]["category"] is None
    same = {r["menu_id"] for r in read_raw(spark, "menu", str(folder / "a.csv"), one_header=True).collect()}
    assert same == {"M1", "M2"}


@pytest.mark.parametrize("reached", [True, False])
def test_headers_of_odd_files(spark, tmp_path, monkeypatch, reached):
    """Byte order mark, blank first line, quoted and repeated names, packed and empty files, ragged rows, odd file names."""
    if not reached:
        monkeypatch.setattr(readers, "_arrow_reaches", lambda path: False)
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    names = list(MENU)
    line = ",".join(MENU.values())
    (folder / "mark.csv").write_text("\ufeff" + ",".join(names) + "\n" + line.replace("M1", "M2") + "\n", encoding="utf-8")
    (folder / "blank.csv").write_text("\n" + ",".join(names) + "\n" + line.replace("M1", "M3") + "\n", encoding="utf-8")
    (folder / "twice.csv").write_text('"menu_id",menu_id,store_id\nM4,M5,S9\nM6\nM7,x,S8,more,still\n', encoding="utf-8")
    (folder / "packed.csv.gz").write_bytes(gzip.compress((",".join(names[::-1]) + "\n" + ",".join(list(MENU.values())[::-1]) + "\n").encode()))
    (folder / "empty.csv").write_text("")
    found = {r["menu_id"]: r for r in read_raw(spark, "menu", str(folder)).collect()}
    assert set(found) == {"M1", "M2", "M3", "M4", "M6", "M7"}
    assert [found[m]["store_id"] for m in ("M1", "M2", "M3", "M4", "M6", "M7")] == ["S1", "S1", "S1", "S9", None, "S8"]
    assert found["M1"]["category"] == "set" and found["M7"]["category"] is None
    assert read_raw(spark, "menu", str(folder / "empty.csv")).count() == 0


def test_headers_take_first_bytes_only(spark, tmp_path, monkeypatch):
    path = write_csv(tmp_path / "menu.csv", [{**MENU, "menu_id": f"M{i}"} for i in range(20_000)])
    read = []
    real = readers.pafs.FileSystem.from_uri

    class Watched(io.RawIOBase):
        def __init__(self, stream):
            self.stream = stream

        def readable(self):
            return True

        def readinto(self, buffer):
            data = self.stream.read(len(buffer))
            buffer[: len(data)] = data
            read.append(len(data))
            return len(data)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, location, **options):
            return Watched(self.system.open_input_stream(location, **options))

    class Watching:
        @staticmethod
        def from_uri(uri):
            system, location = real(uri)
            return System(system), location

    monkeypatch.setattr(readers.pafs, "FileSystem", Watching)
    assert readers.first_record(f"file://{path}") == list(MENU)
    assert 0 < sum(read) <= readers.HEADER_BYTES < (tmp_path / "menu.csv").stat().st_size


def test_notices_are_decoded_strictly(spark, tmp_path):
    folder = tmp_path / "notices"
    folder.mkdir()
    (folder / "good.txt").write_text("배너 반영\r\n둘째", encoding="utf-8", newline="")
    (folder / "blank.txt").write_text("\n")
    (folder / "latin.txt").write_bytes("für".encode("latin-1"))
    with pytest.raises((PySparkException, Py4JJavaError), match="no UTF-8 text: .*latin.txt"):
        read_notices(spark, str(folder)).collect()
    found = {r["source_name"]: r for r in read_notices(spark, str(folder), broken="keep").collect()}
    assert found["good.txt"]["notice_text"] == "배너 반영\r\n둘째" and found["good.txt"]["corrupt_file"] is None
    assert found["blank.txt"]["notice_text"] == "\n" and found["blank.txt"]["corrupt_file"] is None
    assert found["latin.txt"]["notice_text"] is None and bytes(found["latin.txt"]["corrupt_file"]) == "für".encode("latin-1")
    with pytest.raises(ValueError):
        read_notices(spark, str(folder), broken="replace")


def test_broken_feed_lines(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text('{"receipt_no": "1", "total_amount": 5.0}\n{"receipt_no": "2", "total\n{"receipt_no": "3", "total_amount": "abc"}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_feed(spark, "receipts", str(path)).collect()
    kept = read_feed(spark, "receipts", str(path), broken="keep").collect()
    assert len(kept) == 3 and [r["corrupt_record"] is None for r in kept] == [True, False, False]
    with pytest.raises(ValueError):
        read_feed(spark, "receipts", str(path), broken="drop")


def test_tables_are_not_overwritten(spark, tmp_path):
    table, path = spark.range(3), str(tmp_path / "table")
    write_table(table, path)
    with pytest.raises(PySparkException):
        write_table(table, path)
    write_table(table, path, mode="append")
    assert spark.read.parquet(path).count() == 6


def test_every_dataset_normalises(spark):
    samples = {"date": "2026-01-01", "string": " x\t", "double": "1.5", "int": "2", "whole_price": "9.9", "timestamp": STAMP}
    for name, spec in DATASETS.items():
        table = spark.createDataFrame(
            [tuple(samples[kind] for _, kind in spec.all_columns)], [c for c, _ in spec.all_columns]
        )
        found = normalize(table, name).first().asDict()
        for column, kind in spec.all_columns:
            if kind == "string":
                assert found[column] == "x"
            if kind == "whole_price":
                assert found[column] == 9
            if kind == "date":
                assert found[column] == date(2026, 1, 1)
    with pytest.raises(KeyError):
        dataset("nope")


@pytest.mark.parametrize(
    "change, message",
    [({"cost": " "}, "Missing required field: cost"), ({"price": "abc"}, "Invalid value in field: price"), ({"store_id": None}, "Missing required field: store_id")],
)
def test_strict_mode_fails_even_for_unread_columns(spark, change, message):
    record = {**MENU, **change}
    table = spark.createDataFrame([tuple(record.values())], ", ".join(f"{c} string" for c in record))
    with pytest.raises(PySparkException, match=message):
        normalize(table, "menu").select("menu_id").collect()


def test_quarantine_mode(spark):
    records = [MENU, {**MENU, "cost": " ", "price": "abc"}, {**MENU, "margin_rate": "NaN", "uploaded_at": "yesterday"}]
    table = spark.createDataFrame([tuple(r.values()) for r in records], list(MENU))
    found = normalize(table, "menu", mode="quarantine").collect()
    assert [r["reasons"] for r in found] == [
        [],
        ["invalid:price", "missing:cost"],
        ["invalid:margin_rate", "invalid:uploaded_at"],
    ]
    assert found[1]["price"] is None
    with pytest.raises(ValueError):
        normalize(table, "menu", mode="lenient")


def test_profile(spark):
    table = spark.createDataFrame(
        [("R1", "S1", "5", "good", "positive", "f", STAMP), ("R2", "S1", "2", " ", "negative", "f", STAMP), ("R3", None, "", "x", "", "f", STAMP)],
        [name for name, _ in dataset("review").all_columns],
    )
    found = {r["column_name"]: r for r in rows(profile(table, "review"))}
    rating = found["rating"]
    assert (rating["row_count"], rating["value_count"], rating["min_value"], rating["max_value"], rating["mean_value"]) == (3, 2, 2.0, 5.0, 3.5)
    assert {name: r["missing_count"] for name, r in found.items()} == {"rating": 1, "review_id": 0, "store_id": 1, "review_text": 1}
    assert profile_all({"review": table}).count() == 4


def test_feeds_and_notices(spark, tmp_path):
    lines = spark.createDataFrame([("a", "s", date(2026, 1, 1), "09:30", 5.0, "cancelled")],
                                  "receipt_no string, store_key string, sales_date date, sales_time string, total_amount double, status string")
    write_table(lines, str(tmp_path / "json"), file_format="json")
    assert read_feed(spark, "receipts", str(tmp_path / "json")).first() == lines.first()
    write_table(lines, str(tmp_path / "pq"), partition_by=["sales_date"])
    assert read_feed(spark, "receipts", str(tmp_path / "pq"), "parquet").first()["sales_date"] == date(2026, 1, 1)
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "n1.txt").write_text("배너 반영 필수\n둘째 줄\n", encoding="utf-8")
    found = notice_summary(read_notices(spark, str(tmp_path / "texts"))).first()
    assert found["summary"] == "배너 반영 필수 둘째 줄"
    assert found["source_name"] == "n1.txt"
    assert found["ocr_confidence"] == 0.9


def test_metric_log(spark, tmp_path, review_rows, customers, event_rows):
    path = str(tmp_path / "metrics")
    assert load_metrics(spark, path).count() == 0
    records = quality.evaluate(review_rows, customers, event_rows, "baseline-test")
    append_metrics(records, path)
    append_metrics(records, path)
    found = rows(load_metrics(spark, path))
    assert len(found) == 6
    values = {r["task"]: (r["metric_name"], r["metric_value"], r["sample_size"]) for r in found}
    assert values == {
        "review_sentiment": ("accuracy", 0.75, 4),
        "churn": ("accuracy_proxy", 1.0, 6),
        "anomaly": ("precision_at_2", 0.5, 4),
    }
    assert all(r["created_at"].endswith("+00:00") for r in found)


def test_runs_are_written_once(spark, tmp_path, review_rows, customers, event_rows):
    """A job that ends before its commit leaves nothing, one that is run again after it replaces its rows."""
    path = str(tmp_path / "metrics")
    records = quality.evaluate(review_rows, customers, event_rows, "v")
    append_metrics(records, path, "monday")
    failing = records.withColumn("task", F.when(F.col("task") == "churn", F.raise_error(F.lit("ended"))).otherwise(F.col("task")))
    with pytest.raises((PySparkException, Py4JJavaError)):
        append_metrics(failing, path, "tuesday")
    assert {r["run"] for r in load_metrics(spark, path).collect()} == {"monday"}
    for _ in range(2):
        append_metrics(records, path, "tuesday")
    found = Counter((r["run"], r["task"]) for r in load_metrics(spark, path).collect())
    assert found == {(run, task): 1 for run in ("monday", "tuesday") for task in ("review_sentiment", "churn", "anomaly")}
    assert len({append_metrics(records, path), append_metrics(records, path)}) == 2
    assert load_metrics(spark, path).count() == 12


def test_scores_of_a_run_are_replaced(spark, tmp_path, customers):
    path = str(tmp_path / "scores")
    scored = churn_score(customers)
    for rows_of_run, run in ((scored, "a"), (scored.limit(2), "b"), (scored.limit(3), "b")):
        summary = write_scores("churn_baseline", rows_of_run, path, quality.churn_accuracy, run=run).first()
        assert summary["row_count"] == summary["sample_size"] == rows_of_run.count()
    assert {r["run"]: r["count"] for r in spark.read.parquet(path).groupBy("run").count().collect()} == {"a": 6, "b": 3}


def test_accuracy_and_precision_edges(spark):
    empty = spark.createDataFrame([], "label string, prediction string")
    assert quality.accuracy(empty, "label", "prediction").first()["accuracy"] == 0.0
    scored = spark.createDataFrame([("b", 1, 0.9), ("a", 0, 0.9), ("c", 1, 0.1)], "id string, label int, score double")
    best = {k: quality.precision_at_k(scored, "label", "score", k, "id").first()["precision_at_k"] for k in (0, 1, 2, 3, 9)}
    assert best == {0: 0.0, 1: 0.0, 2: 0.5, 3: 0.6667, 9: 0.6667}


def test_precision_per_group(spark):
    data = [(k, s, i, int(i % 3 == 0), float(i % 7)) for k, n in (("a", 40), ("b", 3), (None, 5)) for s, i in (("x", i) for i in range(n))]
    scored = spark.createDataFrame(data, "store string, other string, id int, label int, score double")
    best = quality.precision_at_k(scored, "label", "score", 5, "id", ["store"])
    expected = {}
    for store in ("a", "b"):
        top = sorted((r for r in data if r[0] == store), key=lambda r: (-r[4], r[2]))[:5]
        expected[store] = (round(sum(r[3] for r in top) / len(top), 4), len(top))
    assert {r["store"]: (r["precision_at_k"], r["ranked_count"]) for r in best.collect()} == expected
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    none = quality.precision_at_k(scored, "label", "score", 0, "id", ["store"]).collect()
    assert {(r["store"], r["precision_at_k"], r["ranked_count"]) for r in none} == {("a", 0.0, 0), ("b", 0.0, 0)}


def test_scoring_run(spark, tmp_path, customers):
    scored = churn_score(customers)
    summary = write_scores("churn_baseline", scored, str(tmp_path / "out"), quality.churn_accuracy).first()
    assert (summary["task"], summary["row_count"], summary["accuracy"]) == ("churn_baseline", 6, 1.0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_sufficiency(spark):
    data = [("a", f"2026-01-{d:02d}") for d in range(1, 15)] * 4 + [("b", "2026-01-01"), ("b", "2026-01-13"), (None, "2026-01-01")]
    table = spark.createDataFrame(data, "store_id string, date string").withColumn("date", F.col("date").cast("date"))
    found = {r["store_id"]: r for r in rows(data_sufficiency(table, ["store_id"]))}
    assert set(found) == {"a", "b"}
    assert (found["a"]["day_count"], found["a"]["record_count"], found["a"]["cold_start"]) == (14, 56, False)
    assert [w["code"] for w in found["b"]["warnings"]] == ["insufficient_period", "insufficient_records"]
    assert found["b"]["warnings"][0]["message"] == "최소 14일 데이터가 필요하지만 13일만 제공되었습니다."


def test_shared_tables_are_released(spark):
    table = shared.stored(spark.range(3).toDF("x"), "trial")
    assert table.count() == 3
    assert shared.release(spark) >= 1


SAMPLES = {
    "sales": ["2026-01-01", "S001", "1520000", "184", "176", "8636", "offline", "sunny", "0"],
    "customer": ["C006", "S003", "47", "2", "19000", "47", "0.00", "1"],
    "review": ["R003", "S002", "3", "무난했지만 재방문 의사는 보통입니다", "neutral"],
    "anomaly": ["A002", "S001", "discount", "98000", "E001", "2026-03-01T14:23:00+09:00", "1"],
    "menu": ["M001", "S001", "8500", "5100", "620", "0.40", "set"],
    "inventory": ["2026-02", "S001", "I001", "120", "112", "0.067"],
    "staffing": ["2026-03-01", "S001", "11", "180000", "3", "4"],
}


def test_jobs(spark, tmp_path):
    paths = {}
    for name, values in SAMPLES.items():
        columns = [column for column, _ in dataset(name).all_columns]
        paths[name] = write_csv(tmp_path / f"{name}.csv", [dict(zip(columns, [*values, "f.csv", STAMP]))])
    for name, path in paths.items():
        summary = jobs.score(spark, name, path, str(tmp_path / f"out-{name}")).first()
        assert (summary["task"], summary["row_count"]) == (jobs.TASKS[name], 1)
        assert spark.read.parquet(str(tmp_path / f"out-{name}")).count() == 1
    found = {r["task"]: r["metric_value"] for r in rows(jobs.evaluate(spark, paths, str(tmp_path / "log"), "v"))}
    assert found == {"review_sentiment": 0.0, "churn": 1.0, "anomaly": 1.0}
    assert load_metrics(spark, str(tmp_path / "log")).count() == 3
    profiled = rows(jobs.profile_files(spark, paths))
    assert {r["dataset_type"] for r in profiled} == set(SAMPLES)
    assert all(r["missing_count"] in (0, None) for r in profiled)


def test_every_feed_has_a_schema(spark, tmp_path):
    (tmp_path / "feed.json").write_text("{}\n")
    for name in FEEDS:
        assert read_feed(spark, name, str(tmp_path / "feed.json")).count() == 1


def test_shuffle_size_only_grows(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        (tmp_path / "x").write_bytes(b"x" * 1000)
        assert session.size_shuffles(spark, str(tmp_path)) == int(before)
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        assert session.size_shuffles(spark, str(tmp_path)) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
