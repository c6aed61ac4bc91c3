"""The gaze table: one row per event inside one label of one interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from keyspan.functions.expressions import nan_to_null
from keyspan.functions.skew import attach

GAZE_SCHEMA = T.StructType(
    [
        T.StructField("RowId", T.LongType(), False),
        T.StructField("Recording", T.StringType()),
        T.StructField("Participant", T.StringType()),
        T.StructField("TOI", T.StringType()),
        T.StructField("Interval", T.IntegerType()),
        T.StructField("Event_type", T.StringType()),
        T.StructField("Validity", T.StringType()),
        T.StructField("Start", T.DoubleType()),
        T.StructField("Stop", T.DoubleType()),
        T.StructField("Duration", T.DoubleType()),
        T.StructField("Saccade_amplitude", T.DoubleType()),
    ]
)
MEASURES = ("Start", "Stop", "Duration", "Saccade_amplitude")
DERIVED = (
    "KeyEventStart",
    "KeyEventStop",
    "KeyEventType",
    "FixationSequence",
    "SaccadeSequence",
)


def as_gaze(df: DataFrame, has_nan: bool = True) -> DataFrame:
    """Check and normalise any DataFrame with the gaze columns; further columns pass through.

    ``RowId`` is the input order, on which "first" depends, and must be unique: a distributed read has
    no row order of its own. NaN measures become NULL, so that averages skip them. Say ``has_nan=False``
    for data known to be free of NaN: conditions on the measures are then pushed down to the scan.
    """
    missing = [field.name for field in GAZE_SCHEMA if field.name not in df.columns]
    if missing:
        raise ValueError(f"gaze table lacks columns {missing}")
    taken = [name for name in DERIVED if name in df.columns]
    if taken:
        raise ValueError(f"gaze table already has derived columns {taken}")
    wanted = {field.name: field.dataType for field in GAZE_SCHEMA}
    # Columns of the right type are taken as they are: a needless alias would keep equal plans from
    # sharing a shuffle.
    wrong = [field.name for field in df.schema if field.dataType != wanted.get(field.name, field.dataType)]
    typed = df.withColumns({name: F.col(name).cast(wanted[name]) for name in wrong}) if wrong else df
    return typed.withColumns({name: nan_to_null(name) for name in MEASURES}) if has_nan else typed


# Offsets of so many files are broadcast; those of more files are joined by a shuffle, a file to a task.
BROADCAST_FILES = 100_000


def with_input_order(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Add ``RowId``: the place of each row in its files, from 0 without gaps; files count in the order of their paths.

    ``df`` is a table as a file reader returns it. Rows are not sorted: a row's place in its file (Parquet) or in its
    block of a file (other formats, whose rows are numbered as they are read) is known, and what comes before the file
    or block is a sum over one row for each of them.
    """
    if fmt == "parquet":
        block, place = F.struct(F.col("_metadata.file_path")), F.col("_metadata.row_index")
    else:
        block = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
        place = F.monotonically_increasing_id()
    placed = df.select("*", block.alias("_block"), place.alias("_place"))
    blocks = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    offsets = blocks.select("_block", offset.alias("_offset"))
    few = fmt == "parquet" and len(df.inputFiles()) <= BROADCAST_FILES
    numbered = attach(placed, offsets, ["_block"], small=few)
    return numbered.select((F.col("_place") + F.col("_offset")).alias("RowId"), *[F.col(f"`{c}`") for c in df.columns])


def row_id_report(df: DataFrame) -> DataFrame:
    """One row: Rows, N_Null (rows without ``RowId``), N_Repeated (ids of several rows) and the smallest FirstRepeated.

    One pass; ids are counted with a combine before the shuffle.
    """
    ids = df.groupBy("RowId").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = F.col("RowId").isNotNull() & (F.col("_rows") > 1)
    return ids.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("Rows"),
        F.coalesce(F.sum(F.when(F.col("RowId").isNull(), F.col("_rows"))), F.lit(0)).alias("N_Null"),
        F.count_if(repeated).alias("N_Repeated"),
        F.min(F.when(repeated, F.col("RowId"))).alias("FirstRepeated"),
    )


def require_row_ids(df: DataFrame) -> DataFrame:
    """``df``, if every row has a ``RowId`` of its own; a ValueError otherwise."""
    found = row_id_report(df).first()
    if found["N_Null"] or found["N_Repeated"]:
        raise ValueError(
            f"RowId must be unique: {found['N_Null']} rows without it, {found['N_Repeated']} repeated ids"
            f" (the smallest: {found['FirstRepeated']})"
        )
    return df


def load_gaze(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    has_nan: bool = True,
    schema: T.StructType | None = None,
    check_ids: bool = False,
    **options: str,
) -> DataFrame:
    """Read a stored gaze table. Types are never inferred from the data.

    A table without ``RowId`` (for JSON or CSV without a header: without it in ``schema``) gets the order of its rows in
    the files. ``check_ids`` refuses, by one pass over the ids, a table whose own ids are missing or repeated.

    CSV with ``header="true"`` is matched by column name and may have further columns, which stay text; use
    ``nullValue="NA"`` if missing values are written so. Other text input has the columns of ``schema``, by
    default the gaze columns in their standard order.
    """
    reader = spark.read.format(fmt).options(**options)
    named = fmt == "csv" and str(options.get("header", "false")).lower() == "true"
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json") and not named:
        reader = reader.schema(GAZE_SCHEMA)
    rows = reader.load(path)
    if "RowId" not in rows.columns:
        rows = with_input_order(rows, fmt)
    elif check_ids:
        require_row_ids(rows)
    return as_gaze(rows, has_nan)


def gaze_from_pandas(spark: SparkSession, frame) -> DataFrame:
    """Take an in-memory table; without a ``RowId`` column, the row order of the table is used."""
    if "RowId" not in frame.columns:
        frame = frame.assign(RowId=range(len(frame)))
    return as_gaze(spark.createDataFrame(frame))
