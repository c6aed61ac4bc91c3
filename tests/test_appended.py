"""Numbered rows of a growing table: equal to a full run, with the other folders left alone."""

import os
import random
import re
import shutil

import pytest
from helpers import event, gaze, rows, same
from pyspark.sql import functions as F

from keyspan import Analysis, AnalysisConfig
from keyspan.plans import appended
from keyspan.plans.appended import GazeStore

CFG = AnalysisConfig(min_rows=2)


def events(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        start = rnd.randrange(4000, 6000, 50)
        where = {"Recording": rnd.choice(["R1", "R2", None]), "Interval": rnd.choice([1, 2, 3, None])}
        out.append(event(rnd.choice(["FPEn", "PEn", "PEt"]), rnd.choice(["Fixation", "Saccade", None]), start, start + 100, **where))
    return out


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def part_of(path):
    return int(path.split("Part=")[1].split("/")[0])


@pytest.mark.parametrize("hot_rows", [5_000_000, 10])
def test_batches_give_the_full_run(spark, tmp_path, hot_rows):
    cfg = AnalysisConfig(min_rows=2, hot_rows=hot_rows)
    table = gaze(spark, events(150))
    store = GazeStore(spark, str(tmp_path), cfg, parts=5, files=2)
    for batch in range(2):
        store.append(table.filter(F.col("RowId") % 2 == batch))
        so_far = Analysis(table.filter(F.col("RowId") % 2 <= batch), cfg)
        same(store.sequenced.select(*so_far.sequenced.columns), so_far.sequenced)
        same(store.final.select(*so_far.final.columns), so_far.final)
    same(store.rows.select(*table.columns), table)


def test_other_folders_are_neither_read_nor_written(spark, tmp_path):
    table = gaze(spark, events(150))
    late = (F.col("Recording") == "R1") & (F.col("Interval") == 2)
    store = GazeStore(spark, str(tmp_path), CFG, parts=6)
    store.append(table.filter(~F.coalesce(late, F.lit(False)) | (F.col("RowId") % 2 == 0)))
    before = files(tmp_path)
    touched = store.append(table.filter(late & (F.col("RowId") % 2 == 1)))
    assert len(touched) == 1
    after = files(tmp_path)
    gone_or_changed = {path for path in before if after.get(path) != before[path]}
    assert gone_or_changed and {part_of(path) for path in (gone_or_changed | (set(after) - set(before)))} == set(touched)
    read = store._read(store.rows_path, touched)
    assert re.search(r"PartitionFilters: \[[^\]]*Part#", read._jdf.queryExecution().toString())
    whole = Analysis(table, CFG).sequenced
    same(store.sequenced.select(*whole.columns), whole)


def test_an_append_that_was_cut_off_is_run_again(spark, tmp_path, monkeypatch):
    table = gaze(spark, events(80))
    first, second = table.filter("RowId <= 40"), table.filter("RowId > 40")
    store = GazeStore(spark, str(tmp_path), CFG, parts=4)
    store.append(first)
    old = rows(store.sequenced, *store.sequenced.columns)

    class Killed(Exception):
        pass

    def killed(*args):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(appended, "Analysis", killed)
        with pytest.raises(Killed):
            store.append(second)
    assert rows(store.sequenced, *store.sequenced.columns) == old
    # As if it had been cut off while a folder was replaced.
    shutil.rmtree(next(os.path.join(store.numbered_path, f) for f in os.listdir(store.numbered_path) if f.startswith("Part=")))
    for _ in range(2):  # and once more with rows that are stored
        store.append(second)
        whole = Analysis(table, CFG).sequenced
        same(store.sequenced.select(*whole.columns), whole)
        assert store.rows.count() == 80


def test_an_interval_may_lose_its_numbered_rows(spark, tmp_path):
    """A late row that comes first in its interval becomes the key event, and puts all others on the wrong side."""
    table = gaze(spark, [event("PEn", "Fixation", 4900, 5100), event("PEn", "Fixation", 5200, 5300), event("PEn", "Saccade", 4990, 5050)])
    moved = table.withColumn("RowId", F.when(F.col("RowId") == 3, 0).otherwise(F.col("RowId")))
    moved = moved.withColumn("Validity", F.when(F.col("RowId") == 0, "Partial").otherwise(F.col("Validity")))
    moved = moved.withColumn("Start", F.when(F.col("RowId") == 0, 5000.0).otherwise(F.col("Start")))
    moved = moved.withColumn("TOI", F.when(F.col("RowId") == 0, "FPEn").otherwise(F.lit("PEn")))
    moved = moved.filter("RowId <> 2")
    store = GazeStore(spark, str(tmp_path), CFG, parts=3)
    store.append(moved.filter("RowId <> 0"))
    assert store.sequenced.count() == 1
    store.append(moved.filter("RowId = 0"))
    assert Analysis(moved, CFG).sequenced.count() == 0
    assert store.sequenced.count() == 0
    assert store.append(moved.limit(0)) == []
