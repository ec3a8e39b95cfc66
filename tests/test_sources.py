"""Readers on hand-written files."""

import pytest
from pyspark.sql import functions as F

from strandline.plans import campaign
from strandline.sources import files

LOG = """Instrument: two channels
Serial: 17
Started: 05.09.2024
;;;
Date;Time;550.6;550.0
05.09.2024;17:44:00;0.50;0.40
05.09.2024;17:45:00;0.51;0.41
05.09.2024;17:45:30;0.52;NA
05.09.2024;18:00:00;oops;0.43
99.99.2024;18:01:00;0.54;0.44
05.09.2024;20:15:00;0.55;0.45
"""


def test_log_preamble_and_bad_rows(spark, tmp_path):
    path = tmp_path / "old_inlet_water_sep05.dat"
    path.write_text(LOG)
    log = files.read_instrument_log(spark, str(path))
    rows = {str(r["ts"]): (r["ch1"], r["ch2"]) for r in log.collect()}
    assert log.count() == 6
    assert rows["2024-09-05 17:45:30"] == (0.52, None)
    assert rows["2024-09-05 18:00:00"] == (None, 0.43)
    assert rows["None"] == (0.54, 0.44)


def test_logs_are_cut_to_their_windows(spark, tmp_path):
    (tmp_path / "old_inlet_water_sep05.dat").write_text(LOG)
    (tmp_path / "water_sep07.dat").write_text(
        "a\nb\nc\nd\nDate;Time;550.6;550.0\n07.09.2024;16:15:00;1;1\n07.09.2024;16:15:01;2;2\n"
    )
    (tmp_path / "unknown.dat").write_text("x\nx\nx\nx\nh;h;h;h\n07.09.2024;16:15:01;3;3\n")
    paths = [str(p) for p in sorted(tmp_path.glob("*.dat"))]
    got = files.ingest_logs(spark, paths, campaign.LOG_WINDOWS).orderBy("ts").collect()
    assert [(str(r["ts"]), r["hour"], r["ch1"]) for r in got] == [
        ("2024-09-05 17:45:30", 17, 0.52),
        ("2024-09-05 18:00:00", 18, None),
        ("2024-09-07 16:15:01", 16, 2.0),
    ]


def test_csv_names_missing_values_and_round_trip(spark, tmp_path):
    src = tmp_path / "flow.csv"
    src.write_text("date,time,gas_flow\n12/09/2024,13:05,1001.5\n12/09/2024,13:10,NA\nbad,13:15,NaN\n")
    df = files.read_series_csv(
        spark, str(src), "date string, time string, gas_flow double", ["date", "time"], "dmy_hm"
    )
    got = [(str(r["ts"]), r["gas_flow"]) for r in df.orderBy(F.col("ts").asc_nulls_last()).collect()]
    assert got == [
        ("2024-09-12 13:05:00", 1001.5), ("2024-09-12 13:10:00", None), ("None", None)
    ]
    out = str(tmp_path / "out")
    files.write_csv(df, out)
    back = files.read_series_csv(spark, out, "ts string, gas_flow double", ["ts"], "ymd_hms")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_shared_folder_comes_from_the_session(spark):
    from strandline.session import shared_root, stage

    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    staged = stage(spark.range(3).toDF("x"))
    assert stage(staged) is staged
    assert shared_root(spark).removeprefix("file:") in staged.inputFiles()[0]


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.dat").write_text("m\nDate;Time;550.6;550.0\n05.09.2024;10:00:00;1;2\n")
    (tmp_path / "b.dat").write_text("m\nn\nTime;550.0;more;550.6;Date\n10:00:01;2;x;1;05.09.2024\n")
    log = files.read_instrument_log(spark, [str(tmp_path / "a.dat"), str(tmp_path / "b.dat")])
    assert [(r["ch1"], r["ch2"]) for r in log.collect()] == [(1.0, 2.0)] * 2
    (tmp_path / "a.csv").write_text('date,time,no,no2\n12/09/2024,13:05,1,2\n')
    (tmp_path / "b.csv").write_text('no2,"date",other,no,time\n2,12/09/2024,"a, b",1,13:06\n')
    both = files.read_series_csv(
        spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")],
        "date string, time string, no double, no2 double", ["date", "time"], "dmy_hm",
    )
    assert [(r["no"], r["no2"]) for r in both.collect()] == [(1.0, 2.0)] * 2


def test_missing_column_raises(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text("date,time,no\n12/09/2024,13:05,1\n")
    with pytest.raises(Exception, match="no header with"):
        files.read_series_csv(
            spark, str(tmp_path / "a.csv"), "date string, time string, no double, no2 double", ["date", "time"], "dmy_hm"
        ).collect()


NOTES = "date,note,x\n01/01/2024,plain,1\n02/01/2024,\"one\ntwo\",2\n03/01/2024,\"a,b\n\n\"\"c\"\"\nd\",3\n04/01/2024,\"\",4\n"


def _notes(spark, path, **options):
    df = files.read_series_csv(spark, path, "date string, note string, x double", ["date"], "dmy", **options)
    return sorted((str(r["ts"])[:10], r["note"], r["x"]) for r in df.collect())


@pytest.mark.parametrize("split", [None, 7, 16, 40])
def test_quoted_line_feeds(spark, tmp_path, split):
    """Also where blocks of a file end inside a field, beside a file without such fields."""
    (tmp_path / "a.csv").write_text(NOTES)
    (tmp_path / "b.csv").write_text("x,date,note\n5,05/01/2024,other\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = _notes(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(d, x) for d, _, x in got] == [(f"2024-01-0{k}", float(k)) for k in range(1, 6)]
    assert [n for _, n, _ in got][:2] == ["plain", "one\ntwo"] and got[2][1].startswith("a,b\n\n") and got[2][1].endswith("\nd")
    assert got[4][1] == "other"


def test_a_stray_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,note,x\n01/01/2024,"stray,1\n' + "02/01/2024,y,2\n" * 30)
    with pytest.raises(ValueError, match="31 lines"):
        _notes(spark, str(tmp_path), most_lines=20)
