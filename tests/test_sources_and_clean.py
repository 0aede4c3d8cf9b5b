import pytest
from pyspark.sql import functions as F

from tidegauge.operators.clean import CleanPolicy, clean, clean_conservative, densify, reject_if_empty
from tidegauge.sources import readers, writers
from tidegauge.spec import COUNTS, SRC_ROW, CapacityError, DataQualityError, SeriesSpec

HEADER = "﻿Date*,In  Count,Stock A,Moved,Stock B,Left\n"
NAMES = {
    "Date": "date", "In Count": "intake", "Stock A": "stock_a", "Moved": "transfer",
    "Stock B": "stock_b", "Left": "discharge",
}
LINES = [
    '2023-01-03,"1,000",10,4,100,3',
    "01/01/2023,5,12,20,90,(2)",
    ",,,,,",
    "not a date,1,1,1,1,1",
    "2023-01-03,7,11,n/a,101,x",
    '"January 5, 2023",8,14.5,3,,4',
]


@pytest.fixture()
def raw(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + "\n".join(LINES) + "\n", encoding="utf-8")
    return readers.read_raw_csv(spark, str(path), names=NAMES)


def test_csv_scan_keeps_text_order_and_missing_tokens(raw):
    rows = raw.orderBy(SRC_ROW).collect()
    assert [r.intake for r in rows] == ["1,000", "5", None, "1", "7", "8"]
    assert rows[4].transfer is None and rows[4].discharge == "x"


def test_audit_and_positions_of_rows_read_from_files(raw):
    from tidegauge.operators.audit import audit
    from tidegauge.operators.ordered import add_positions

    found = audit(raw)
    codes = {r.code: r for r in found.findings.collect()}
    assert codes["INVALID_DATES"].examples == ["not a date"]
    assert codes["DUPLICATE_DATES"].affected_rows == 2
    assert {"EMPTY_ROWS", "NON_CHRONOLOGICAL_ORDER", "MISSING_CALENDAR_DATES"} <= set(codes)
    first = found.evidence.orderBy(SRC_ROW).first()
    assert first.issue_codes == "DUPLICATE_DATES"
    dated = raw.withColumn("date", F.to_date(F.expr("try_to_date(date)")))
    placed = add_positions(dated, SeriesSpec()).orderBy("_pos").collect()
    assert [r["_pos"] for r in placed] == list(range(1, 7))
    assert [r.intake for r in placed[:2]] == ["1,000", "7"]


def test_header_rules(spark):
    assert readers.canonical_name("﻿  Total   load ** ") == "Total load"
    df = spark.createDataFrame([("1", "2")], ["a", "a*"])
    with pytest.raises(CapacityError, match="same name"):
        readers.canonical_columns(df)
    with pytest.raises(CapacityError, match="intake, stock_a"):
        readers.canonical_columns(spark.createDataFrame([("1",)], ["date"]))


def test_clean_counts_and_repairs(raw):
    out = clean(raw)
    rows = {str(r.date): r for r in out.data.collect()}
    assert list(sorted(rows)) == [f"2023-01-0{d}" for d in range(1, 6)]
    first, second, third, fourth, fifth = (rows[k] for k in sorted(rows))
    assert first.discharge == -2 and first.anomaly_negative and first.anomaly_transfer
    assert second.is_imputed_date and second.stock_a == 12 and second.intake == 0
    assert third.intake == 7 and third.transfer == 0 and third.imputed_value_count == 2
    assert fourth.quality_flag == "Imputed date; Imputed values"
    assert fifth.stock_a == 14 and fifth.stock_b == 101
    report = out.report.first()
    assert (report.source_rows, report.empty_rows_removed, report.invalid_date_rows_removed) == (6, 1, 1)
    assert report.duplicate_rows_removed == 1 and report.chronology_repaired
    assert report.invalid_discharge == 1 and report.invalid_transfer == 0
    codes = {r.code for r in out.issues.collect()}
    assert {"DUPLICATE_DATES_RESOLVED", "FRACTIONAL_COUNTS", "NEGATIVE_COUNTS"} <= codes


def test_policies(raw):
    assert clean(raw, policy=CleanPolicy(duplicates="first")).data.where("date = '2023-01-03'").first().intake == 1000
    assert clean(raw, policy=CleanPolicy(clip_negatives=True)).data.agg(F.min("discharge")).first()[0] == 0
    kept = clean(raw, policy=CleanPolicy(flows="none")).data.where("date = '2023-01-02'").first()
    assert kept.intake is None
    assert clean_conservative(raw).data.where("date = '2023-01-01'").first().discharge == 0
    with pytest.raises(CapacityError, match="Duplicate"):
        clean(raw, policy=CleanPolicy(duplicates="error"))
    with pytest.raises(DataQualityError):
        clean(raw, policy=CleanPolicy(strict=True))
    with pytest.raises(ValueError):
        CleanPolicy(stocks="guess")


def test_nothing_left_is_an_error(spark):
    df = spark.createDataFrame([("x", "1", "1", "1", "1", "1", 1)], ["date", *COUNTS, SRC_ROW])
    with pytest.raises(CapacityError):
        reject_if_empty(clean(df))


def test_dense_series_is_unchanged(source):
    days = source.select("date", *COUNTS)
    assert densify(days, SeriesSpec()).drop("is_imputed_date").exceptAll(days).isEmpty()
    text = days.select(
        F.col("date").cast("string").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in COUNTS],
        F.unix_date("date").cast("long").alias(SRC_ROW),
    )
    assert clean(text).data.select("date", *COUNTS).exceptAll(days).isEmpty()
    assert clean(text).issues.isEmpty()


def test_writers(spark, tmp_path):
    df = spark.sql("select date'2023-01-02' d, double('NaN') x, array(double('inf'), 1d) a, cast(1.5 as decimal(3,1)) m")
    path = str(tmp_path / "json")
    writers.write_json(df, path)
    line = next((tmp_path / "json").glob("*.json")).read_text()
    assert line == '{"d":"2023-01-02","x":null,"a":[null,1.0],"m":1.5}\n'
    with pytest.raises(Exception, match="exists"):
        writers.write_json(df, path)
    writers.write_json(df, path, force=True)
    with pytest.raises(CapacityError):
        writers.write_json(spark.range(3), str(tmp_path / "j2"), maximum_rows=2)
    writers.append_events(df, path)
    assert spark.read.json(path).count() == 2
    writers.write_csv(df.select("d"), str(tmp_path / "csv"))
    assert "2023-01-02" in next((tmp_path / "csv").glob("*.csv")).read_text()
    assert writers.source_first(spark.range(1).selectExpr("id x", "id intake")).columns == ["intake", "x"]


def test_event_log_reads_each_committed_run_once(spark, tmp_path):
    path = str(tmp_path / "log")
    a = spark.createDataFrame([(1, float("nan")), (2, None), (2, None)], "k int, v double")
    b = a.where("k = 1")
    with pytest.raises(ValueError, match="run id"):
        writers.append_run(a, path, "a/b")
    writers.append_run(a, path, "007")
    writers.write_attempt(b, path, "b")
    read = lambda: sorted((r.run, r.k, r.v) for r in readers.read_runs(spark, path, "k int, v double").collect())
    assert read() == [("007", 1, None), ("007", 2, None), ("007", 2, None)]
    writers.append_run(b, path, "007")
    assert len(read()) == 3
    writers.append_run(b, path, "b")
    writers.append_run(a.limit(0), path, "none")
    assert read() == [("007", 1, None), ("007", 2, None), ("007", 2, None), ("b", 1, None)]


def test_records_and_predictions(spark, tmp_path):
    rows = readers.from_records(spark, [{"a": 1}, {"a": None, "b": "x"}])
    assert rows.columns == ["a", "b"] and rows.collect()[0].a == "1"
    with pytest.raises(CapacityError):
        readers.from_records(spark, [])


def test_files_of_another_column_order_are_never_misread(spark, tmp_path):
    head = ["date", "intake", "stock_a", "transfer", "stock_b", "discharge"]
    turned = [*head[:1], *head[:0:-1]]
    for name, order in (("a", head), ("b", turned)):
        (tmp_path / name).mkdir()
        cells = {c: str(k) for k, c in enumerate(head)} | {"date": "2024-01-01"}
        (tmp_path / name / "x.csv").write_text(",".join(order) + "\n" + ",".join(cells[c] for c in order) + "\n")
    rows = readers.read_raw_csv(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).drop("src_row").distinct().collect()
    assert [tuple(r[c] for c in head) for r in rows] == [("2024-01-01", "1", "2", "3", "4", "5")]
    (tmp_path / "a" / "y.csv").write_text((tmp_path / "b" / "x.csv").read_text())
    with pytest.raises(Exception, match="header"):
        readers.read_raw_csv(spark, f"{tmp_path}/a").collect()
