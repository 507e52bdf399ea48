from datetime import datetime, timedelta

from pyspark.sql import functions as F

from actispark.sources import readers as R


def test_geneactiv_csv(spark, tmp_path):
    lines = ["Device Type,GENEActiv", "Measurement Frequency,50.0 Hz", "2024-01-01 10:00:00:000,0.1,0.2,0.3,5,0,20.5", "2024-01-01 10:00:00:020,0.1,0.2,0.4,5,1,20.5", "20\x0024-01-01 10:00:00:040,1,2,3,4,21", "2024-13-01 10:00:00:000,1,2,3,4,0,21", "2024-01-01 10:00:01:000,1,2"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = [tuple(r) for r in R.read_geneactiv_csv(spark, str(tmp_path)).orderBy("line_no").select("recording_id", "ts", F.round("z", 3), "temp", "button").collect()]
    assert got == [
        ("a", datetime(2024, 1, 1, 10), 0.3, 20.5, False), ("a", datetime(2024, 1, 1, 10, 0, 0, 20_000), 0.4, 20.5, True), ("a", datetime(2024, 1, 1, 10, 0, 0, 40_000), 3.0, 21.0, None),
    ]
    assert [tuple(r) for r in R.recording_rates(R.read_lines(spark, str(tmp_path))).collect()] == [("a", 50.0, 2)]
    limited = R.read_geneactiv_csv(spark, str(tmp_path), start_time=datetime(2024, 1, 1, 10, 0, 0, 20_000), stop_time=datetime(2024, 1, 1, 10, 0, 0, 20_000))
    assert limited.count() == 1
    assert R.read_geneactiv_csv(spark, str(tmp_path), start_buffer=timedelta(milliseconds=30)).count() == 1


def test_line_order_over_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\n".join(f"{i}" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = R.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows] == [f"{i}" for i in range(20_000)]


def test_psg(spark, tmp_path):
    text = "Recording Date:\t01/02/2024\nx\nSleep Stage\tPosition\tTime [hh:mm:ss]\tEvent\tDuration[s]\nW\t\t23:59:45\t\t15\nN2\t\t00:00:00\t\t15\n\n"
    (tmp_path / "p.txt").write_text(text)
    got = [tuple(r) for r in R.read_psg_txt(spark, str(tmp_path)).orderBy("row_no").select("ts", "stage", "sleep").collect()]
    assert got == [(datetime(2024, 2, 1, 23, 59, 45), "W", 0), (datetime(2024, 2, 2), "N2", 1)]


def test_binary(spark, tmp_path):
    # x = 1, y = -1, z = 2047; light 5, button on
    sample = "001" + "FFF" + "7FF" + f"{5 << 2 | 2:03X}"
    head = "x gain:100\nx offset:0\ny gain:100\ny offset:0\nz gain:100\nz offset:0\nVolts:2\nLux:4\nMeasurement Frequency:50.0\n"
    (tmp_path / "r.bin").write_text(head + "Page Time:2024-01-01 00:00:00:000\nTemperature:21.5\nMeasurement Frequency:50.0\n" + sample * 3 + "\n")
    rows = R.read_geneactiv_bin(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r[0], *r[2:]) for r in rows[:1]] == [("r", datetime(2024, 1, 1), 1.0, -1.0, 2047.0, 10.0, 21.5, True)] and len(rows) == 3
    assert rows[2]["ts"] == datetime(2024, 1, 1, 0, 0, 0, 40_000)


def test_binary_pages_over_splits(spark, tmp_path):
    head = "x gain:100\nx offset:0\ny gain:100\ny offset:0\nz gain:100\nz offset:0\nVolts:2\nLux:4\nMeasurement Frequency:50.0 Hz\n"
    page = lambda i: f"Recorded Data\nPage Time:2024-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}:000\nTemperature:{20 + i % 5}.5\nMeasurement Frequency:50.0\n" + f"{i % 2048:03X}0000000000"[:12].ljust(12, "0") * 20 + "\n"
    (tmp_path / "r.bin").write_text(head + "".join(map(page, range(300))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = R.read_geneactiv_bin(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["ts"], r["x"], r["temp"]) for r in rows] == [(datetime(2024, 1, 1) + timedelta(seconds=i, milliseconds=20 * k), float(i), 20.5 + i % 5) for i in range(300) for k in range(20)]


def test_dreamt(spark, tmp_path):
    raw = spark.createDataFrame([(0.0, 64.0, 32.0, -64.0, 30.0, "N1"), (1.5, 0.0, 0.0, 0.0, 30.0, "W"), (2.0, 0.0, 0.0, 0.0, 30.0, "Missing")], "TIMESTAMP double, ACC_X double, ACC_Y double, ACC_Z double, TEMP double, Sleep_Stage string")
    out = R.convert_dreamt(raw)
    assert [(r[0], r[1], r[-1]) for r in out.collect()] == [(datetime(2025, 3, 13, 19), 1.0, 1.0), (datetime(2025, 3, 13, 19, 0, 1, 500_000), 0.0, 0.0), (datetime(2025, 3, 13, 19, 0, 2), 0.0, None)]
    (tmp_path / "d.csv").write_text("Processed_Time,acc_x_g,ACC_Y_g,ACC_Z_g,TEMP,sleep_binary\n2025-03-13 19:00:00,1,0,0,30,2\n2025-03-13 19:00:01.500000,1,0,0,30,0\nbad,1,0,0,30,1\n2025-03-13 19:00:02,1,0,,30,1\n")
    got = R.read_dreamt(spark, str(tmp_path / "d.csv")).orderBy("ts").select("ts", "sleep").collect()
    assert [tuple(r) for r in got] == [(datetime(2025, 3, 13, 19), 1), (datetime(2025, 3, 13, 19, 0, 1, 500_000), 0)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, None)], "group string, x int, SLEEP int")
    R.write_dataset(df, str(tmp_path / "d"))
    assert [r["group"] for r in R.read_dataset(spark, str(tmp_path / "d")).collect()] == ["a"]
    R.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert R.read_table(spark, str(tmp_path / "t.csv")).count() == 2
    R.write_table(df.repartition(2, "x"), str(tmp_path / "o.csv"), "csv", order=["x"])
    lines = [p.read_text().splitlines()[1:] for p in sorted((tmp_path / "o.csv").glob("part-*.csv"))]
    assert [line.split(",")[1] for part in lines for line in part] == ["1", "2"]


def test_starts(spark):
    t = datetime(2024, 1, 1, 10)
    samples = spark.createDataFrame([("a", t), ("b", t)], "recording_id string, ts timestamp_ntz")
    psg = spark.createDataFrame([("a", t + timedelta(seconds=5)), ("b", t + timedelta(seconds=60))], "recording_id string, ts timestamp_ntz")
    assert {r[0]: r[1] for r in R.training_start(samples, psg).collect()} == {"a": t, "b": t + timedelta(seconds=45)}
    ends = spark.createDataFrame([("a", t - timedelta(1)), ("b", None)], "recording_id string, end_date timestamp_ntz")
    assert [r["recording_id"] for r in R.stop_at_end_dates(samples, ends).collect()] == ["b"]
