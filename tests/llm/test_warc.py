import base64
import hashlib
import random
import uuid

from keyspan.llm import warc


def brute(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        own = groups[html or ""]
        keeper = max((p for p in own if p is not None), default=None)
        revisit = len(own) > 1 and page != keeper
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def check(df, archive=warc.Archive()):
    rows = [(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in warc.archive_round_trip(df, archive).collect()]
    assert sorted(got, key=str) == brute(rows)


def hard_pages():
    rng = random.Random(2)
    rows = [(i, f"http://www.h{rng.randrange(4)}.example/{rng.randrange(9)}?q={i % 3}#f", rng.choice(["a", "b<p>é", "x" * 99, f"u{i}"])) for i in range(600)]
    rows += [(700, None, None), (701, "no scheme", ""), (None, "http://a.example/", "a"), (None, None, "only null"), (None, None, "only null")]
    return rows + [(702, "http://l.example/\r\nX: y\t", "long " * 400_000), (703, "http://é.example/ü", "\U0001f600")] + rows[:5]


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/pages.parquet"))


def test_hard_pages_many_runs_and_ranges(spark):
    df = spark.createDataFrame([(*r, "extra") for r in hard_pages()], "page_id long, url string, html string, key string")
    check(df.repartition(9), warc.Archive(ways=2, lines_a_range=40, block_lines=3))
    check(df.limit(0))


def test_merged_index_is_in_global_order(spark, tmp_path):
    df = spark.createDataFrame(hard_pages(), "page_id long, url string, html string").repartition(9)
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    archive = warc.Archive(ways=3, lines_a_range=50, block_lines=4)
    runs = warc.write_archives(df, folder, archive)
    lines = warc.merge_index(runs, folder, archive).orderBy("range", "position").collect()
    keys = [(r.key.encode(), r.at, r.page) for r in lines]
    assert len(keys) == len(hard_pages()) and keys == sorted(keys)
    assert lines[-1].range > 3


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        merged = list(warc.LoserTree([iter([x] for x in run) for run in runs], key=tuple))
        assert merged == [[x] for x in sorted(x for run in runs for x in run)]
