import hashlib
import random
import re

import pytest

from keyspan.llm import substring_dedup as s


def brute(rows, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, repeats=s.Repeats()):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in s.repeats_digest(df, repeats).collect()), key=str)
    assert got == brute(rows, repeats.window)
    return sum(r[2] for r in got)


def texts(rng, n):
    word = lambda: "v%d" % rng.randrange(60)
    passages = [[word() for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(6)):
            t += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(9))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,repeats", [(1, s.Repeats(10, 4)), (2, s.Repeats(12, 3)), (3, s.Repeats(9, 9)), (4, s.Repeats(5, 2))])
def test_random_passages(spark, seed, repeats):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), t) for t in texts(rng, 150)]
    rows += [(7, "a b " * 40), (8, "a b " * 30), (9, "x " * 50), (9, "x " * 60), (None, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[:4]], "doc_id long, text string, key int, marks int")
    assert check(df.repartition(4), repeats) > 100


def test_whole_table(spark, sf):
    assert check(spark.read.parquet(f"{sf}/documents.parquet")) > 0


def test_hard_texts(spark):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "short text"), (4, long), (5, "other " + long + " end"), (6, long), (-3, " ".join(long.split()[100:149]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    check(df.limit(0))


def thue_morse(length, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(length))


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_made_to_collide(spark, length):
    # Equal under every polynomial hash modulo a power of two.
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, thue_morse(length, "a", "b") + " " + shared), (2, thue_morse(length, "b", "a") + " " + shared)]
    assert check(spark.createDataFrame(rows, "doc_id bigint, text string")) == 60


def test_word_hashes_tell_lengths_cases_and_bytes_apart():
    from keyspan.llm.word_hashes import word_hashes

    words = [chr(97 + i % 26) * n for n in (*range(1, 80), 500) for i in range(26)]
    words += ["A" + "b" * n for n in range(80)] + ["\0" * n for n in range(1, 20)]
    for second in (False, True):
        hashes, counts = word_hashes([w.encode() for w in words], second=second)
        assert len(set(hashes.tolist())) == len(set(words)) and (counts == 1).all()
        lowered, _ = word_hashes([w.encode() for w in words], True, second)
        again, _ = word_hashes([w.lower().encode() for w in words], False, second)
        assert (lowered == again).all()
