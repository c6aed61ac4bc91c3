"""Numbered rows of a gaze table that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyspan.config import DEFAULT, INTERVAL_KEYS, AnalysisConfig
from keyspan.functions.expressions import null_safe
from keyspan.functions.skew import checkpointed
from keyspan.operators import sequence
from keyspan.plans.analysis import Analysis
from keyspan.sources.files import folders_in, is_there, remove, touch


class GazeStore:
    """A stored gaze table and its numbered rows, in ``parts`` folders by a hash of the interval.

    Key events, sides, numbers and group sizes depend on the rows of one interval only. So :meth:`append` reads
    the folders that hold an interval of the new rows, computes those intervals anew, and replaces these
    folders; the others are neither read nor written. Rows may come late, in any order, and for old intervals:
    results are those of a full run over all rows so far.

    An append that was cut off is run again with the same rows: those that are stored already (by ``RowId``, unique and
    not NULL) are not added twice. A mark tells that it was cut off, maybe while folders were replaced, so the next
    append computes all folders anew from the stored rows. Missing keys are keys like others. One writer at a time.

    The list of touched folders, at most ``parts`` numbers, is all that passes the driver. ``files`` spreads the
    rows of one folder over as many tasks and files, so that a hot interval is not written by one.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: AnalysisConfig = DEFAULT, parts: int = 64, files: int = 4):
        self.spark, self.cfg, self.parts, self.files = spark, cfg, parts, files
        self.rows_path, self.numbered_path = f"{path}/rows", f"{path}/numbered"
        self.pending_path = f"{path}/pending"

    def append(self, rows: DataFrame) -> list[int]:
        """Add rows and bring the numbered rows up to date; returns the touched folders."""
        # Used several times, and perhaps costly to derive.
        fresh = checkpointed(rows.withColumn("Part", self._part()))
        touched = sorted(row["Part"] for row in fresh.select("Part").distinct().collect())
        if not touched:
            return []
        keys = fresh.select(*[F.col(key).alias("_new_" + key) for key in INTERVAL_KEYS]).distinct()
        cut_off = is_there(self.spark, self.pending_path)
        touch(self.spark, self.pending_path)
        self._add(fresh, keys, touched)
        if cut_off:
            touched = list(range(self.parts))
        changed = self._read(self.rows_path, touched)
        if not cut_off:
            changed = changed.join(keys, null_safe(INTERVAL_KEYS, "_new_"), "left_semi")
        numbered = Analysis(changed.drop("Part"), self.cfg).numbered_with_sizes.withColumn("Part", self._part())
        if not cut_off and self._is_stored(self.numbered_path):
            others = self._read(self.numbered_path, touched).filter(F.col("RowId").isNotNull())
            numbered = numbered.unionByName(others.join(keys, null_safe(INTERVAL_KEYS, "_new_"), "left_anti"))
        # A row without an id in each touched folder: one that has lost all its numbered rows is replaced, too.
        empty = self.spark.range(self.parts).filter(F.col("id").isin(touched)).select(
            *[F.col("id").cast("int").alias("Part") if f.name == "Part" else F.lit(None).cast(f.dataType).alias(f.name) for f in numbered.schema]
        )
        self._write(numbered.unionByName(empty), self.numbered_path, "overwrite")
        remove(self.spark, self.pending_path)
        return touched

    @property
    def rows(self) -> DataFrame:
        """All rows so far."""
        return self.spark.read.parquet(self.rows_path).drop("Part")

    @property
    def sequenced(self) -> DataFrame:
        """Aligned rows, numbered outwards from the key event."""
        return self._numbered().drop("GroupRows")

    @property
    def final(self) -> DataFrame:
        """Numbered rows of the labels that have enough of them."""
        return sequence.large_groups(self._numbered(), self.cfg)

    def _numbered(self) -> DataFrame:
        return self.spark.read.parquet(self.numbered_path).filter(F.col("RowId").isNotNull()).drop("Part")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*INTERVAL_KEYS), F.lit(self.parts)).cast("int")

    def _is_stored(self, path: str) -> bool:
        return is_there(self.spark, path) and any(name.startswith("Part=") for name in folders_in(self.spark, path))

    def _read(self, path: str, parts: list[int]) -> DataFrame:
        return self.spark.read.parquet(path).filter(F.col("Part").isin(parts))

    def _add(self, fresh: DataFrame, keys: DataFrame, touched: list[int]) -> None:
        if self._is_stored(self.rows_path):
            old = self._read(self.rows_path, touched).join(keys, null_safe(INTERVAL_KEYS, "_new_"), "left_semi")
            fresh = fresh.join(old.select("RowId"), "RowId", "left_anti").select(*fresh.columns)
        self._write(fresh, self.rows_path, "append")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        place = F.pmod(F.xxhash64("RowId"), F.lit(self.files))
        written = rows.repartition("Part", place).write.partitionBy("Part").mode(mode)
        # Only folders that have rows here are replaced, once all files are written.
        written.option("partitionOverwriteMode", "dynamic").parquet(path)
