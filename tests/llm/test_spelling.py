import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm import spelling
from keyspan.llm.spelling import Spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    """Words of (doc_id, text) rows by the rule, one run at a time."""
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def neighbours(words):
    """Near words of each word, by leaving out every letter of both."""
    out = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for same in holes.values():
        for w in same:
            out[w].update(v for v in same if v != w)
    return out


def expected(words):
    near = neighbours(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def variants(seed, n, letters="abcdeéÿ", lengths=(7, 8, 9)):
    """Words that are one or two steps from each other, anagrams among them."""
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        if words and rng.random() < 0.8:
            w = list(rng.choice(list(words)))
            step = rng.randrange(4)
            i = rng.randrange(len(w))
            if step == 0:
                w[i] = rng.choice(letters)
            elif step == 1:
                w.insert(i, rng.choice(letters))
            elif step == 2 and len(w) > 7:
                del w[i]
            else:
                rng.shuffle(w)
            w = "".join(w)
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        words[w] = rng.choice([2, 3, 20, 25, 300, 5000])
    return words


@pytest.mark.parametrize(
    "params", [Spelling(), Spelling(leaf_words=15, bucket=4), Spelling(sample=40, leaf_words=10, bucket=1), Spelling(leaves=3, leaf_words=1)]
)
def test_random_words_against_all_pairs(spark, params):
    words = variants(1, 600)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows_of(spelling.spelling_groups(table, params)) == expected(words)


def test_anagrams_are_cut_by_hash(spark):
    """Words of equal counts fill more than a leaf; their near words are found in all its parts."""
    rng = random.Random(2)
    words = {}
    while len(words) < 300:
        w = list("aabbccdd")
        rng.shuffle(w)
        words["".join(w)] = rng.choice([2, 50])
    for w in list(words)[:40]:
        words["x" + w[1:]] = 700
        words[w + "y"] = 3
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    params = Spelling(leaf_words=20, bucket=8)
    tree, leaves = spelling.upper_tree(spelling._with_length(list(words)), 20)
    assert leaves >= 15
    assert rows_of(spelling.spelling_groups(table, params)) == expected(words)


def test_roots_follow_long_chains(spark):
    base = "abcdefgh"
    words = {base[:4] + "z" * i + base[4:]: 2 * 10**i for i in range(9)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows_of(spelling.spelling_groups(table))
    assert got == expected(words)
    assert {r[2] for r in got} == {"abcdzzzzzzzzefgh"}


def test_hard_texts(spark):
    long = "à" * 4_000
    rows = [(1, None), (2, ""), (3, "Straße STRASSE ÉCOLES Écoles écoles naturel naturels"), (None, "naturel Naturel naturelx")]
    rows += [(4, f"{long} {long} {long}b {long}b a bıgwords bigwords"), (5, "a1bcdefghi abcdefgh-abcdefghĀbcdefghi €uro€")]
    rows += [(6, "colours colour colours"), (6, "colours colour colours"), (7, "×÷×÷×÷× " * 3)]
    rows += [(100 + i, "committee committed comittee " * 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clashing = docs.select("*", *[F.lit(7).alias(n) for n in ("word", "n", "leaf", "kind", "form", "root")])
    assert rows_of(spelling.document_spellings(clashing)) == expected(counted(rows))
    assert rows_of(spelling.document_spellings(clashing, Spelling(counted_bytes=500, leaf_words=3))) == expected(counted(rows))


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.document_spellings(empty).collect() == []
    assert spelling.document_spellings(spark.createDataFrame([(1, "no words")], "doc_id long, text string")).collect() == []


def test_ranges_reach_every_leaf_of_a_near_word():
    words = list(variants(3, 500))
    points = spelling._with_length(words)
    tree, leaves = spelling.upper_tree(points, 8)
    home = {}
    for leaf, rows in spelling.leaves_of(tree, points, spelling.ITEM):
        home |= {words[r]: leaf.number for r in rows}
    assert len(home) == len(words) and leaves > 60
    near = neighbours(set(words))
    for kind, more in ((spelling.SAME, 0), (spelling.LONGER, 1)):
        asked = {w: set() for w in words}
        for leaf, rows in spelling.leaves_of(tree, points, kind):
            for r in rows:
                asked[words[r]].add(leaf.number)
        for w in words:
            assert {home[v] for v in near[w] if len(v) == len(w) + more} <= asked[w]
        # Boxes are pruned: a query doesn't ask all leaves.
        assert np.mean([len(a) for a in asked.values()]) < leaves / 3


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.document_spellings(docs)) == expected(counted(rows))
