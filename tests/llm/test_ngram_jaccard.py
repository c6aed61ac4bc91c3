import random
import re

import pytest

from keyspan.llm import ngram_jaccard as j


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (k, y) = sets[a], sets[b]
            small, large = sorted((len(x), len(y)))
            if small and 100 * small >= 85 * large:
                common = len(x & y)
                if 100 * common >= 85 * (len(x) + len(y) - common):
                    p, q = root(i), root(k)
                    parent[max(p, q)] = min(p, q)
    return {i: (root(i)) for i, _ in sets}, {i: len(s) for i, s in sets}


def check(df, join=j.Join()):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want, size = brute([r for r in rows if r[0] is not None])
    got = j.similar_classes(df, join).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        if r.doc_id is not None:
            assert r.n_shingles == size[r.doc_id]


def near_copies():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(400)
    out, common = [], [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join(common + [word() for _ in range(rng.randrange(5, 30))]) for _ in range(120)]
    out += ["A b C d e", "a B c D e", "x", "x", "x y", "", None, "\n", "one two three"]
    rows = [(7 * i % 997, t) for i, t in enumerate(out)]
    return rows + rows[:3] + [(None, "x y"), (None, None)]


@pytest.mark.parametrize("join", [j.Join(), j.Join(tile=4, block=8, dense=1), j.Join(frequent_share=0.05, dense=1, block=16), j.Join(tile=16, dense=3)])
def test_near_copies_in_all_sorts_of_tiles(spark, join):
    df = spark.createDataFrame(near_copies(), "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS component_id")
    check(df.repartition(5), join)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_empty_table_and_filter(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (1, "A B C D E"), (2, "else"), (None, "else"), (9, None)], "doc_id long, text string")
    assert j.similar_classes(df.limit(0)).count() == 0
    assert sorted(map(str, (r.doc_id for r in j.one_of_each_class(df).collect()))) == ["1", "2", "9", "None"]


def test_words_made_to_collide(spark):
    tm = lambda a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(1024))
    rows = [(1, " ".join([tm("a", "b")] * 5)), (2, " ".join([tm("b", "a")] * 5)), (3, tm("a", "b")), (4, tm("b", "a"))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))
