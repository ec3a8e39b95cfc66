"""Sources and sinks: each query writes what it reads back."""

from pyspark.sql import functions as F

from catalog.base import Tables, from_signal, query
from strandline.session import fresh_path
from strandline.sources import files


@query(
    "scan_csv",
    """SELECT date_trunc('minute', ts) AS ts, event_id,
              CASE WHEN value > 15 THEN value END AS gas_flow
       FROM events""",
)
def scan_csv(t: Tables):
    """Two exports whose columns stand in different orders."""
    path = fresh_path(t.spark, "csv")
    rows = t.events.select(
        F.date_format("ts", "dd/MM/yyyy").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"),
        "event_id",
        F.when(F.col("value") > 15, F.col("value")).alias("gas_flow"),
        (F.col("event_type") < "m").alias("first"),
    )
    rows.where("first").drop("first").write.csv(f"{path}/a", header=True, nullValue="NA")
    rows.where("not first").select("gas_flow", "time", "first", "event_id", "date").write.csv(
        f"{path}/b", header=True, nullValue="NA"
    )
    return files.read_series_csv(
        t.spark,
        [f"{path}/a", f"{path}/b"],
        "date string, time string, event_id bigint, gas_flow double",
        ["date", "time"],
        "dmy_hm",
    )


def _log_lines(t: Tables):
    """Log lines of the events, with the lines that precede a header; logs from "m" on swap their channels."""
    swapped = F.col("series") >= "m"
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    data = t.signal().select(
        F.concat_ws(
            ";",
            F.date_format("ts", "dd.MM.yyyy"),
            F.date_format("ts", "HH:mm:ss"),
            F.when(swapped, field("ch2")).otherwise(field("ch1")),
            F.when(swapped, field("ch1")).otherwise(field("ch2")),
        ).alias("value"),
        F.col("series").alias("log"),
    )
    header = F.when(swapped, "Date;Time;550.0;550.6").otherwise("Date;Time;550.6;550.0")
    lines = ("Instrument two-channel absorbance", "Serial 0001", "Started 2024", "")
    heads = t.signal().select("series").distinct().select(
        F.explode(F.array(*map(F.lit, lines), header)).alias("value"), F.col("series").alias("log")
    )
    return heads.unionByName(data)


@query(
    "scan_instrument_log",
    from_signal("SELECT date_trunc('second', ts) AS ts, ch1, ch2 FROM signal"),
)
def scan_instrument_log(t: Tables):
    path = fresh_path(t.spark, "log")
    _log_lines(t).write.partitionBy("log").text(path)
    return files.read_instrument_log(t.spark, f"{path}/*", header_of="folder").drop("file", "folder")


WINDOWS = [
    files.LogWindow("log=click", "2024-01-05 17:45", "2024-01-15 20:15"),
    files.LogWindow("log=error", None, "2024-01-16 15:28"),
    files.LogWindow("log=purchase", None, "2024-01-20 21:30"),
    files.LogWindow("log=signup", "2024-01-07 16:15", None),
]


@query(
    "ingest_union_with_validity",
    from_signal(
        """SELECT date_trunc('second', ts) AS ts, CAST(hour(ts) AS INTEGER) AS hour, ch1, ch2,
                  'log=' || series AS folder
           FROM signal
           WHERE CASE series
             WHEN 'click' THEN date_trunc('second', ts) > TIMESTAMP '2024-01-05 17:45:00'
                           AND date_trunc('second', ts) < TIMESTAMP '2024-01-15 20:15:00'
             WHEN 'error' THEN date_trunc('second', ts) < TIMESTAMP '2024-01-16 15:28:00'
             WHEN 'purchase' THEN date_trunc('second', ts) < TIMESTAMP '2024-01-20 21:30:00'
             WHEN 'signup' THEN date_trunc('second', ts) > TIMESTAMP '2024-01-07 16:15:00'
             ELSE false END"""
    ),
)
def ingest_union_with_validity(t: Tables):
    path = fresh_path(t.spark, "logs")
    _log_lines(t).write.partitionBy("log").text(path)
    return files.ingest_logs(t.spark, [f"{path}/*"], WINDOWS, by="folder").select(
        "ts", "hour", "ch1", "ch2", "folder"
    )


@query(
    "sink_csv",
    """SELECT date_trunc('day', ts) AS ts, event_type, count(*) AS n,
              CASE WHEN min(value) > 0.05 THEN min(value) END AS low, max(value) AS high
       FROM events GROUP BY ALL""",
)
def sink_csv(t: Tables):
    path = fresh_path(t.spark, "sink")
    daily = t.events.groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_type"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.min("value") > 0.05, F.min("value")).alias("low"),
        F.max("value").alias("high"),
    )
    files.write_csv(daily, path)
    return files.read_series_csv(
        t.spark,
        path,
        "ts string, event_type string, n bigint, low double, high double",
        ["ts"],
        "ymd_hms",
    )


@query(
    "handoff_intermediate",
    from_signal("SELECT series, ts, event_id, ch1, ch2, CAST(ts AS DATE) AS day FROM signal"),
)
def handoff_intermediate(t: Tables):
    path = fresh_path(t.spark, "handoff")
    files.write_stage_table(t.signal().select("series", "ts", "event_id", "ch1", "ch2"), path)
    return files.read_stage_table(t.spark, path)
