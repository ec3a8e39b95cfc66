"""Readers and writers: header CSV, instrument logs, staged Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.timefn import concat_datetime, parse_datetime
from strandline.session import stage


def _fields(line: Column, sep: str) -> Column:
    """The fields of a header line, without quotes and blanks."""
    return F.transform(F.split(line, sep), lambda x: F.trim(F.regexp_replace(x, '"', "")))


def _part(by: str) -> Column:
    """A file's own name, or that of its folder."""
    return F.element_at(F.split("__path", "/"), {"file": -1, "folder": -2}[by])


def _read_lines(spark: SparkSession, paths: Sequence[str], header_of: str) -> DataFrame:
    """Lines with their file, the file or folder whose header they go by, and their place: block of the file, then order."""
    of = F.col("__path") if header_of == "file" else F.regexp_replace("__path", "/[^/]*$", "")
    return (
        spark.read.text(list(paths))
        .select(
            "value",
            F.col("_metadata.file_path").alias("__path"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__nth"),
        )
        .withColumn("__of", of)
    )


def _odd_quotes() -> Column:
    """1 for a line with an odd number of quotes: a quoted field begins or ends in it."""
    return (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2


def _headers(lines: DataFrame, sep: str, names: Sequence[str]) -> DataFrame:
    """Per file or folder: its header, the number of its columns, and whether quoted fields run over lines.

    The header is the line that holds all ``names``, wherever it stands and in whatever order.
    """
    fields = _fields(F.col("value"), sep)
    whole = F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(fields, n))
    found = F.when(F.contains("value", F.lit(names[0])) & whole, F.col("value"))
    heads = lines.groupBy("__of").agg(
        F.min(found).alias("__head"), F.bool_or(_odd_quotes() == 1).alias("__runs_on")
    )
    return stage(heads.withColumn("__width", F.size(_fields(F.col("__head"), sep))), "headers")


def _with_header(lines: DataFrame, heads: DataFrame, sep: str, names: Sequence[str]) -> DataFrame:
    """Adds ``__head`` and its fields ``__header``; a line without a header raises an error once it is used."""
    missing = F.concat(F.lit(f"no header with {', '.join(names)} in "), F.col("__path"))
    fields = F.coalesce(_fields(F.col("__head"), sep), F.raise_error(missing).cast("array<string>"))
    return lines.join(heads.select("__of", "__head"), "__of", "left").select(
        "value", "__path", "__head", fields.alias("__header")
    )


def _whole_records(lines: DataFrame, most_lines: int) -> DataFrame:
    """Lines put together where a quoted field runs over several of them.

    Whether a line begins inside a quoted field is the parity of the quotes before
    it: a sum per block of a file, carried from block to block, and a running sum
    inside the block.  Only the lines of such records are grouped.  A record of more than ``most_lines``
    lines is an error, as a stray quote would make one of the rest of its file.
    """
    place = ["__path", "__block"]
    lines = stage(lines.withColumn("__odd", _odd_quotes()), "lines")
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*place).orderBy("__nth")

    blocks = lines.groupBy(*place).agg(F.sum("__odd").alias("__odds"))
    blocks = blocks.select(*place, F.coalesce(F.sum("__odds").over(before), F.lit(0)).alias("__before"))
    quotes = F.col("__before") + F.sum("__odd").over(inside) - F.col("__odd")
    begun = lines.join(blocks, place).withColumn("__begins", (quotes % 2 == 0).cast("int"))
    numbered = stage(begun.withColumn("__record", F.sum("__begins").over(inside)), "records")

    # what a block begins with, up to its first record, belongs to the last record begun before
    last = numbered.groupBy(*place).agg(F.max("__record").alias("__last"))
    home = F.when(F.col("__last") > 0, F.struct("__block", "__last"))
    last = last.select(*place, F.last(home, ignorenulls=True).over(before).alias("__home"))
    own = F.struct("__block", F.col("__record").alias("__last"))
    placed = numbered.join(last, place).withColumn(
        "__home", F.when(F.col("__record") > 0, own).otherwise(F.coalesce("__home", own))
    )
    alone = (F.col("__begins") == 1) & (F.col("__odd") == 0)
    parts = placed.where(~alone).groupBy("__of", "__path", "__home")
    longest = parts.count().agg(F.max("count")).first()[0] or 0
    if longest > most_lines:
        raise ValueError(f"a quoted field runs over {longest} lines, more than {most_lines}")
    pieces = F.array_sort(F.collect_list(F.struct("__block", "__nth", "value")))
    joined = parts.agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"))
    return placed.where(alone).select("value", "__path", "__of").unionByName(joined.select("value", "__path", "__of"))


def read_series_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    ts_from: Sequence[str],
    layout: str,
    ts: str = "ts",
    most_lines: int = 10_000,
) -> DataFrame:
    """Header CSV with declared columns, taken by name, and one parsed timestamp column.

    The header of each file says where its columns are; further columns are left
    out and a missing one raises an error.  ``ts_from`` names the text column with
    the date-time, or the date and the time column.  ``NA`` and empty fields are
    NULL, and so is NaN.  A quoted field may run over up to ``most_lines`` lines (a
    line feed stays one, other line ends become line feeds); files stay splittable.  The
    input is read for the headers, then for the rows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = _read_lines(spark, paths, "file")
    heads = _headers(lines, ",", declared.names)
    known = heads.agg(F.max("__width"), F.bool_or("__runs_on")).first()
    width = max(known[0] or 0, 1)
    if known[1]:
        runs_on = heads.where("__runs_on").select("__of")
        lines = (
            lines.join(runs_on, "__of", "left_anti")
            .select("value", "__path", "__of")
            .unionByName(_whole_records(lines.join(runs_on, "__of", "left_semi"), most_lines))
        )
    lines = _with_header(lines, heads, ",", declared.names)
    ddl = ", ".join(f"c{i} string" for i in range(width))
    rows = lines.where(~F.col("value").eqNullSafe(F.col("__head"))).select(
        F.from_csv("value", ddl, {"nullValue": "NA", "escape": '"'}).alias("row"), "__header"
    )
    at = F.array(*[F.col(f"row.c{i}") for i in range(width)])

    def field(f: T.StructField) -> Column:
        text = F.get(at, (F.array_position("__header", f.name) - 1).cast("int"))
        if isinstance(f.dataType, T.StringType):
            return text
        value = F.trim(text).try_cast(f.dataType)
        return F.when(~F.isnan(value), value) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else value

    named = rows.select(*[field(f).alias(f.name) for f in declared])
    text = F.col(f"`{ts_from[0]}`") if len(ts_from) == 1 else concat_datetime(*ts_from)
    others = [F.col(f"`{n}`") for n in declared.names if n not in ts_from]
    return named.select(parse_datetime(text, layout).alias(ts), *others)


def read_instrument_log(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[tuple[str, str]] = (("ch1", "550.6"), ("ch2", "550.0")),
    layout: str = "dmy_hms",
    date_time: tuple[str, str] = ("Date", "Time"),
    only: tuple[str, Sequence[str]] | None = None,
    header_of: str = "file",
) -> DataFrame:
    """Semicolon-separated logs with metadata lines above the header.

    Columns are taken by the names in each file's own header.  Data rows are told
    from the metadata lines and the header by two fields that hold a date and a
    time, so files stay splittable and nothing is read on the driver.
    ``only`` names the files or folders to read, such as ``("file", names)``; with
    ``header_of="folder"`` the files of a folder are pieces of one log.
    Returns ``ts``, the named channels, and the names of the file and its folder.
    """
    wanted = [*date_time, *[c for _, c in columns]]
    lines = _read_lines(spark, [paths] if isinstance(paths, str) else list(paths), header_of)
    if only is not None:
        lines = lines.where(_part(only[0]).isin(list(only[1])))
    heads = _headers(lines.where(F.contains("value", F.lit(wanted[0]))), ";", wanted)
    lines = _with_header(lines, heads, ";", wanted)
    dated = lines.where(F.col("value").rlike(r'\d+\D\d+\D\d+[^;]*;') & F.col("value").rlike(r'(^|;)\s*"?\d+:\d+'))
    cut = dated.withColumn("__row", F.split("value", ";"))

    def field(name: str) -> Column:
        text = F.get("__row", (F.array_position("__header", name) - 1).cast("int"))
        return F.trim(F.regexp_replace(text, '"', ""))

    def number(name: str) -> Column:
        v = field(name).try_cast("double")
        return F.when(~F.isnan(v), v)

    return cut.select(
        parse_datetime(concat_datetime(*map(field, date_time)), layout).alias("ts"),
        *[number(source).alias(new) for new, source in columns],
        _part("file").alias("file"),
        _part("folder").alias("folder"),
    )


@dataclass(frozen=True)
class LogWindow:
    """Valid part of the log in a file (or folder): ``start < ts < end``."""

    file: str
    start: str | None
    end: str | None


def within_validity(logs: DataFrame, windows: Sequence[LogWindow], file: str = "file") -> DataFrame:
    """Keep the rows of each file that lie inside one of its windows."""
    spark = logs.sparkSession
    table = spark.createDataFrame(
        [(w.file, w.start, w.end) for w in windows], "__file string, __from string, __to string"
    ).select(
        "__file",
        F.col("__from").cast("timestamp_ntz").alias("__from"),
        F.col("__to").cast("timestamp_ntz").alias("__to"),
    )
    inside = (
        (F.col(file) == F.col("__file"))
        & (F.col("__from").isNull() | (F.col("ts") > F.col("__from")))
        & (F.col("__to").isNull() | (F.col("ts") < F.col("__to")))
    )
    # left semi: a row counts once even where windows of a file overlap
    return logs.join(table, inside, "left_semi")


def ingest_logs(
    spark: SparkSession,
    paths: Sequence[str],
    windows: Sequence[LogWindow],
    by: str = "file",
    **options,
) -> DataFrame:
    """Union of several logs cut to their validity windows, with the hour of day.

    ``by`` says whether a window names a ``file`` or a ``folder`` of pieces.  Files
    without a window are left out, whatever they hold.
    """
    logs = read_instrument_log(spark, paths, only=(by, sorted({w.file for w in windows})), header_of=by, **options)
    valid = within_validity(logs, windows, by)
    return valid.withColumn("hour", F.hour("ts"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV without row names; missing values are written as ``NA``, quotes in fields twice."""
    text = [
        F.col(f"`{f.name}`").cast("string").alias(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    df.select(*text).write.mode(mode).csv(path, header=True, nullValue="NA", escape='"')


def write_stage_table(df: DataFrame, path: str, ts: str = "ts", mode: str = "overwrite") -> None:
    """Parquet partitioned by day, for the step from one pipeline to the next.

    Rows are gathered by day and rebalanced by size: a crowded day is written by
    as many tasks as it needs, and small days share one.
    """
    gathered = df.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
    gathered.write.mode(mode).partitionBy("day").parquet(path)


def read_stage_table(
    spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Read a stage table; a range of days prunes its partitions."""
    df = spark.read.parquet(path)
    if first_day is not None:
        df = df.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        df = df.where(F.col("day") <= F.lit(last_day).cast("date"))
    return df
