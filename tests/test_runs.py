import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loofold.plans import energy, evaluate, ledger
from loofold.sources import catalog, tables
from loofold.streaming import readings


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def patients(tmp_path):
    lines = ['age,"score, points",risk ,outcome']
    for i in range(40):
        age = "" if i == 3 else f"{20 + (i * 7) % 40}.5"
        lines.append(f"{age},{(i * 3) % 11},{i % 3 if i != 5 else ''},{int((i * 7) % 40 > 18)}")
    return write(tmp_path / "patients.csv", "\n".join(lines) + "\n")


def test_row_ids_of_a_split_file(spark, tmp_path):
    path = write(tmp_path / "long.csv", "n,word\n" + "".join(f"{i},w{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tables.with_row_id(tables.read_csv(spark, path, "n int, word string"))
        assert df.where("row_id <> n").count() == 0 and df.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_ids_of_many_files_without_a_copy(spark, tmp_path, monkeypatch):
    from loofold import session

    monkeypatch.setattr(session, "written_table", None)  # nothing is written
    for name, begin, end in (("b", 900, 1500), ("a", 0, 900), ("d", 1500, 1500), ("c", 1500, 1507)):
        write(tmp_path / f"{name}.csv", "n,word\n" + "".join(f"{i},w{i}\n" for i in range(begin, end)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = tables.read_csv(spark, str(tmp_path), "n int, word string")
        numbered = tables.with_row_id(df)
        assert numbered.columns == ["row_id", "n", "word"]
        assert numbered.where("row_id <> n").count() == 0 and numbered.count() == 1507
        assert numbered.where("n % 7 = 0 and row_id <> n").count() == 0  # a filter stays behind the count
        each = {r["name"][-5:]: (r["least"], r["most"]) for r in tables.with_row_id(df, "at", "name").groupBy("name").agg(F.min("at").alias("least"), F.max("at").alias("most")).collect()}
        assert each == {"a.csv": (0, 899), "b.csv": (0, 599), "c.csv": (0, 6)}
        assert [r["n"] for r in tables.last_rows(spark, str(tmp_path), 9, "n int, word string")] == list(range(1498, 1507))
        later = tables.with_row_id(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        with pytest.raises(Exception, match="split in other places"):
            later.orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_preview_reads_a_bounded_tail(spark, tmp_path):
    path = write(tmp_path / "long.csv", "n,word\n" + "".join(f"{i},w{i}\n" for i in range(5000)))
    listed = catalog.register(spark, {"long": path}, {"long": ["word"]})
    assert [tuple(r) for r in evaluate.preview(listed, "long", 3).collect()] == [(i, i, f"w{i}") for i in (4997, 4998, 4999)]
    assert evaluate.preview(listed, "long", 6000).count() == 5000


def test_known_datasets_have_a_schema(spark, tmp_path):
    names = [*catalog.KNOWN_CATEGORICAL["diabetes"], "a.b"]
    path = csv_of(tmp_path / "d.csv", ["a.b", *names[:2]], [(i % 7 + (i % 2) / 2, i % 2, int(i % 7 > 3)) for i in range(40)])
    listed = catalog.register(spark, {"diabetes": path, "other": path}, {"other": names[:2]}).persist()
    schema = catalog.schema_of(listed, "diabetes")
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [(n, "double") for n in ("a.b", *names[:2])]
    assert catalog.schema_of(listed, "other") is None
    pairs = spark.createDataFrame([(0, "diabetes", None), (1, "other", None)], "position int, dataset string, target string")
    known, other = evaluate.run_pairs(listed, pairs, "linux").collect()
    assert known["status"] == "ok" and [known[c] for c in ("n_rows", "n_features", "mcc")] == [other[c] for c in ("n_rows", "n_features", "mcc")]


def test_wide_datasets_are_evaluated(spark, tmp_path, monkeypatch):
    """More one-hot columns than a dense Hessian may have give the same ledger row."""
    path = csv_of(tmp_path / "wide.csv", ["x", "a", "b", "y"], [(i * 7 % 13, f"l{i * 5 % 17}", f"m{i % 4}", int(i * 5 % 17 > 8 or i % 11 == 0)) for i in range(60)])
    listed = catalog.register(spark, {"wide": path}, {"wide": ["a", "b", "y"]}).persist()
    pairs = spark.createDataFrame([(0, "wide", None)], "position int, dataset string, target string")
    dense = evaluate.run_pairs(listed, pairs, "linux").first()
    monkeypatch.setattr(evaluate, "MAX_FEATURES", 5)
    sparse = evaluate.run_pairs(listed, pairs, "linux").first()
    assert sparse["status"] == "ok" and sparse["n_features"] == 22
    assert [sparse[c] for c in ("n_rows", "n_features", "mcc")] == [dense[c] for c in ("n_rows", "n_features", "mcc")]


def test_catalog_and_requests(spark, patients):
    listed = catalog.register(
        spark, {"patients": patients, "gone": "/no/such/file.csv"}, {"patients": ["risk ", "outcome"]}
    )
    rows = {r["dataset"]: r for r in catalog.list_datasets(listed).collect()}
    assert rows["patients"]["categorical"] == ["risk ", "outcome"]
    assert rows["patients"]["default_target"] == "outcome" and rows["gone"]["n_columns"] == 0
    assert catalog.path_of(listed, "patients") == patients and catalog.path_of(listed, "x") is None
    assert catalog.roles_of(listed, "patients")["score, points"] == "numeric"
    pairs = spark.createDataFrame(
        [
            (0, "patients", None), (1, "gone", None), (2, "zzz", "a"), (3, "patients", "nope"),
            (4, "patients", "age"), (5, "patients", "outcome"), (6, "patients", "risk "),
        ],
        "position int, dataset string, target string",
    )
    out = evaluate.run_pairs(listed, pairs, "linux").collect()
    assert [r["status"] for r in out] == [
        "ok", "missing_source", "unknown_dataset", "unknown_column", "not_categorical", "duplicate", "ok"
    ]
    assert out[0]["n_rows"] == 40 and out[0]["n_features"] == 5 and out[0]["mcc"] > 0.5
    assert out[6]["n_features"] == 4 and out[0]["time_ms"] == pytest.approx(out[0]["time_s"] * 1000)
    last = evaluate.preview(listed, "patients", 2).collect()
    assert [r["row_id"] for r in last] == [38, 39]
    assert out[3]["reason"] == "patients has no column nope"


def csv_of(path, columns, rows):
    return write(path, ",".join(columns) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_bad_requests_keep_the_run(spark, tmp_path):
    good = csv_of(tmp_path / "good.csv", ["a", "y"], [(i * 7 % 10, int(i * 7 % 10 > 4)) for i in range(30)])
    text = csv_of(tmp_path / "text.csv", ["note", "y"], [(f"word{i}", i % 2) for i in range(20)])
    wide = csv_of(tmp_path / "wide.csv", ["a", "y"], [(i % 35, i // 10) for i in range(350)])
    empty = csv_of(tmp_path / "empty.csv", ["a", "y"], [])
    gone = csv_of(tmp_path / "gone.csv", ["a", "y"], [(1, 0)])
    files = {"good": good, "text": text, "wide": wide, "empty": empty, "gone": gone}
    listed = catalog.register(spark, files, {**dict.fromkeys(files, ["y"]), "wide": ["a", "y"]}).persist()
    listed.count()
    os.remove(gone)
    names = ["text", "wide", "empty", "gone", "good"]
    pairs = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "position int, dataset string, target string")
    from loofold.operators import softmax

    old, softmax.MAX_WEIGHTS = softmax.MAX_WEIGHTS, 100
    try:
        out = evaluate.run_pairs(listed, pairs, "linux", ledger=str(tmp_path / "ledger")).collect()
    finally:
        softmax.MAX_WEIGHTS = old
    assert [r["status"] for r in out] == ["not_numeric", "too_wide", "no_rows", "unreadable", "ok"]
    assert all(r["evaluation"] == "loo/all" and (r["mcc"] is None) == (r["status"] != "ok") for r in out)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 5
    for method, prep in (("kfold", "all"), ("kfold", "in_fold")):
        row = evaluate.run_pairs(listed, pairs.where("position = 4"), "linux", folds=3, method=method, prep=prep).first()
        assert row["status"] == "ok" and row["evaluation"] == f"{method}/{prep}" and row["n_rows"] == 30
    with pytest.raises(ValueError, match="in_fold"):
        evaluate.evaluate(spark.range(1), [], "y", "id", prep="in_fold")


def test_pairs_of_long_texts_take_linear_time(spark):
    import time

    text = "\n".join(f"line {i}" for i in range(8000))
    df = spark.createDataFrame([(text,)] * 4, "text string")
    begun = time.monotonic()
    pairs = df.select(catalog.pair_up(F.split("text", "\n"), F.split("text", " ")).alias("p")).selectExpr("size(p) as n", "p[7999].dataset as d")
    assert {tuple(r) for r in pairs.collect()} == {(8000, "line 7999")}
    assert time.monotonic() - begun < 5


def test_measured_runs(spark):
    rows = ledger_of(spark, 0.5)
    reading = spark.createDataFrame([("d", "t", 7.2e9, "mJ")], "dataset string, target string, e double, unit string")
    out = {r["dataset"]: r for r in ledger.measured(rows, reading, ["dataset", "target"], "e", "unit").collect()}
    assert out["d"]["energy_kwh"] == 2.0 and out["d"]["method"] == "RAPL interface"
    assert out["bad"]["energy_kwh"] is None and out["bad"]["method"] == "None"


def ledger_of(spark, *mccs):
    return ledger.ledger_rows(
        spark,
        [("d", "t", datetime(2024, 5, 1 + i), "linux", 10, 2, 1.5, 1500.0, m, None, "None", "loo/all", "ok", None)
         for i, m in enumerate(mccs)]
        + [("bad", None, datetime(2024, 5, 1), "linux", *[None] * 6, "None", "loo/all", "missing_source", "no file")],
    )


def test_ledger_and_results(spark, tmp_path):
    rows = ledger_of(spark, 0.25, 0.5)
    path = str(tmp_path / "ledger")
    assert ledger.append_ledger(rows, path) and ledger.append_ledger(rows, path)
    assert not ledger.append_ledger(rows.limit(0), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and stored.select("run_date").distinct().count() == 2
    assert stored.where("run_date = '2024-05-02'").count() == 2
    first = ledger.write_results(rows, str(tmp_path), datetime(2024, 5, 1, 9, 5, 0))
    assert first.endswith("experiment_2024-05-01_09h-05m-00s")
    assert ledger.write_results(rows.where("status <> 'ok'"), str(tmp_path)) is None
    ledger.write_results(ledger_of(spark, 0.75), str(tmp_path), datetime(2024, 5, 1, 9, 6, 0))
    merged = ledger.merge_newest(spark, str(tmp_path / "experiment_*" / "*.csv"), 100)
    assert merged.columns == [name for name, _ in ledger.RESULT_COLUMNS]
    assert sorted(r["MCC"] for r in merged.collect()) == ["0.250000", "0.500000", "0.750000"]


def test_merge_takes_the_newest(spark, tmp_path):
    for i in range(4):
        p = tmp_path / f"r{i}.csv"
        p.write_text(f",Dataset, methodology\n0,d{i},m\n")
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    merged = ledger.merge_newest(spark, str(tmp_path / "r*.csv"), 2)
    assert merged.columns == ["Dataset", "methodology"]
    assert [r["Dataset"] for r in merged.collect()] == ["d2", "d3"]
    with pytest.raises(ValueError):
        ledger.merge_newest(spark.newSession(), str(tmp_path / "r*.csv"), 0)


@pytest.mark.parametrize(
    "text, mj",
    [
        ("a,b\nc,d\n", 0.0),
        ("x,Package_0,5\n", 0.0),
        ("x,Package_0,5\ny\nz,Package_0,7\nw,Package_0,9\n", 7.0),
        ("x,Package_0,5\nz,Package_0\n", 0.0),
        ('x,Package_0,5\n"a,b","in Package_0",8.5,1\r\n', 8.5),
        ('x,Package_0,5\n\n5" lone,Package_0,7.5,x\n', 7.5),
    ],
)
def test_profiler_summary(spark, tmp_path, text, mj):
    path = write(tmp_path / "summary.csv", text)
    row = energy.marker_energy(energy.read_summaries(spark, path)).collect()
    assert [r["energy_mj"] for r in row] == [mj]


def test_emissions_and_attach(spark, tmp_path):
    log = "run_id,timestamp,energy_consumed\na,2024-01-01 00:00:01,0.5\nb,2024-01-01 00:00:09,3\na,2024-01-01 00:00:05,0.75\n"
    df = energy.read_emissions(
        spark, write(tmp_path / "emissions.csv", log), "run_id string, timestamp timestamp, energy_consumed double"
    )
    last = energy.last_reading(df, "energy_consumed", "timestamp")
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "run_id string, n int")
    out = {r["n"]: r["energy_kwh"] for r in energy.attach_energy(runs, last, ["run_id"], "energy_consumed").collect()}
    assert out == {1: 0.75, 2: 0.75, 3: None}
    in_mj = last.withColumn("unit", F.lit("mJ"))
    out = energy.attach_energy(runs, in_mj, ["run_id"], "energy_consumed", "unit").where("n = 1").first()
    assert out["energy_kwh"] == 0.75 / 3.6e9


def test_live_energy(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    schema = "run_id string, ts timestamp, kwh double"

    def drain():
        live = readings.live_energy(readings.watch_emissions(spark, str(logs), schema), "kwh", "ts", idle="30 days")
        readings.store_live_energy(live, out, state).awaitTermination()

    write(logs / "1.csv", "run_id,ts,kwh\na,2024-01-01 00:00:01,0.5\nb,2024-01-01 00:00:02,2\n")
    drain()
    write(logs / "2.csv", "run_id,ts,kwh\na,2024-01-01 00:00:05,0.75\n")
    drain()
    stored = spark.read.parquet(out)
    newest = {r["run_id"]: r["kwh"] for r in energy.last_reading(stored, "kwh", "ts").collect()}
    assert newest == {"a": 0.75, "b": 2.0} and stored.count() == 3


def test_late_and_equal_readings(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    late = []
    for i, line in enumerate(["a,2024-03-01 00:00:00,1", "b,2024-01-01 00:00:00,2", "a,2024-03-01 00:00:00,3"]):
        write(logs / f"{i}.csv", f"run_id,ts,kwh\n{line}\n")
        live = readings.live_energy(readings.watch_emissions(spark, str(logs), "run_id string, ts timestamp, kwh double"), "kwh", "ts", idle="7 days")
        query = readings.store_live_energy(live, out, state)
        query.awaitTermination()
        late.append(readings.late_readings(query))
    assert late == [0, 1, 0]
    newest = {r["run_id"]: r["kwh"] for r in energy.last_reading(spark.read.parquet(out), "kwh", "ts").collect()}
    assert newest == {"a": 3.0}


def test_predictions_without_index(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_predictions(tables.literal_table(spark, {"id": [1, 2], "y": [0.5, 1.5]}), path)
    assert spark.read.csv(path, header=True).columns == ["id", "y"]
