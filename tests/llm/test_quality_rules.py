import re
from collections import Counter
from math import comb

import pytest

from keyspan.llm import quality_rules as q

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            marked.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)]


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (50, 3, 0.2), (200, 1, 0.05), (30, 30, 0.5)])
def test_binomial_tail(n, k, p):
    exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
    assert q.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_features_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in q.quality_verdicts(docs, labels).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert [r[c] for c in COLUMNS] == brute(d.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_hard_texts(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x y z \x1cq\x85", "l\nl\n \n \nl \nl", "wörd " * 60_000]
    texts.append(" ".join(f"w{i % 9000}" for i in range(27_000)))
    docs = spark.createDataFrame(
        [(i, t, None if i % 2 else "en", 5, True) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, n_words int, kept boolean",
    )
    labels = spark.createDataFrame([(0, None, None), (0, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.quality_verdicts(docs.union(docs), labels).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert [r[c] for c in COLUMNS] == brute(texts[r.doc_id])
    assert q.quality_verdicts(docs.limit(0), labels).count() == 0
    assert q.quality_verdicts(docs, labels.limit(0)).count() == len(texts)
    kept = q.kept_documents(docs, labels)
    assert kept.schema == docs.schema


def test_cutoffs_keep_their_promise(spark):
    good = "plain words follow one another without any mark at all in line"
    rows = [(i, f"{good} number {i}", "en") for i in range(8000)]
    rows += [(10_000 + i, f"{good} {i} " + " ".join(f"#*{j}#" for j in range(9)), "en") for i in range(100)]
    rows += [(20_000 + i, f"{good} {i} " + " ".join(f"#*{j}#" for j in range(9)), "xx") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in q.quality_verdicts(docs, labels).where("kept").collect()}
    assert all(i in kept for i in range(8000))
    assert not any(10_000 + i in kept for i in range(100))
    assert all(20_000 + i in kept for i in range(100))  # no labels in this stratum: nothing can be promised


def test_ordinary_holdouts_select_cutoffs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    features = q.with_features(docs.select("doc_id", "text", q.stratum_of(docs).alias("stratum"))).drop("text").cache()
    cutoffs = {r.stratum: r for r in q.select_cutoffs(features, labels).collect()}
    assert {"=en", "=de", "=fr"} <= cutoffs.keys() and all(r.cut_symbol_share for r in cutoffs.values())
    judged = q.quality_verdicts(docs, labels)
    rejected = judged.where("NOT kept AND NOT base_failed").select("doc_id")
    assert rejected.count() > 100
    # The promise holds on the holdout itself: of each stratum's good documents, no more than 1 % go.
    for r in q.holdout_counts(features, labels).where("step = 0").collect():
        good = labels.where("quality = 1 AND toxic = 0")
        lost = rejected.join(good, "doc_id").join(features.where(features.stratum == r.stratum), "doc_id").count()
        assert lost <= 0.01 * r.n


def test_strata_that_can_pass_share_the_error():
    assert q.shared_error([]) == q.shared_error([(288, 3)]) == 0
    assert q.shared_error([(1789, 1), (439, 1), (437, 1), (288, 1)]) == pytest.approx(0.05 / 3)
    steps = q.cutoff_sequence()
    assert len(set(steps)) == len(steps) == sum(len(g) for _, g in q.RiskControl().grids)
    for name, grid in q.RiskControl().grids:
        assert [c for n, c in steps if n == name] == sorted(grid, reverse=True)
