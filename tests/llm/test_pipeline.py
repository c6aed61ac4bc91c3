import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from keyspan.llm import bpe, quality_rules
from test_mixing import targets
from test_ngram_jaccard import brute as classes
from test_pii import brute as spans
from test_quality_rules import brute as features


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf)
        assert number == 4 or result.schema == docs.schema
        result.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((docs.collect(), after.collect()))
        docs = after
    before, after = kept[0]
    verdict = {r.doc_id for r in quality_rules.quality_verdicts(spark.createDataFrame(before), labels).where("kept").collect()}
    n = {r.doc_id: features(r.text) for r in before}
    good = {i for i, f in n.items() if f[0] >= 10 and 100 * f[4] <= 20 * f[0]}
    assert {r.doc_id for r in after} == verdict <= good
    before, after = kept[1]
    component, _ = classes([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {i for i, c in component.items() if i == c}
    before, after = kept[2]
    clean = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        found = spans(r.text)
        if not found:
            assert clean[r.doc_id] == r
        else:
            assert not any(r.text[a:b] in clean[r.doc_id].text for _, a, b in found)
            assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
    before, after = kept[3]
    source = {r.doc_id: r.source for r in before}
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in after:
        assert r.source == source[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets(sizes).items())
    before, after = kept[4]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in after) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in before)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_run_gives_the_stages_result(spark, sf):
    result = corpus_pipeline.run(spark, sf)
    assert result.count() > 0 and result.where("NOT round_trip").isEmpty()


def near_classes(rows):
    """Classes at a Jaccard of 0.8 or more over five-word n-grams: smallest id of each id's class."""
    sets = []
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    least = {i: i for i, _ in sets}
    changed = True
    links = [(i, k) for i, x in sets for k, y in sets if i < k and x and 10 * len(x & y) >= 8 * len(x | y)]
    while changed:
        changed = False
        for i, k in links:
            low = min(least[i], least[k])
            changed = changed or least[i] != low or least[k] != low
            least[i] = least[k] = low
    return least


def test_near_duplicates_are_five_words_at_four_fifths(spark, sf):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for size in (3, 6, 12, 30, 70, 150, 330, 1000):
        for _ in range(6):
            base = [word() for _ in range(size)]
            rows.append(base)
            # Copies on both sides of the threshold: without their last words, and with scattered changes.
            rows += [base[: size * share // 100] for share in (78, 79, 80, 81, 82, 84)]
            for changes in (size * 20 // 1000, size * 22 // 1000, size * 24 // 1000):
                copy = list(base)
                for at in rng.sample(range(size), changes):
                    copy[at] = word()
                rows.append(copy)
    ids = rng.sample(range(10**6), len(rows))
    made = [(i, " ".join(w)) for i, w in zip(ids, rows, strict=True)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df, source in ((docs, made), (given, [tuple(r) for r in given.collect()])):
        got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
        assert got == {i for i, least in near_classes(source).items() if i == least}


def test_prefixes_of_near_duplicates_share_enough():
    near = corpus_pipeline.NEAR
    assert (near.n, near.percent) == (5, 80)
    for a in range(1, 400):
        for b in range(a, a * 100 // 80 + 1):
            common = next(c for c in range(a + 1) if 100 * c >= 80 * (a + b - c))
            # The worst case: all that isn't shared comes first in both orders.
            shared = min(near.index(a) - (a - common), near.probe(b) - (b - common))
            assert min(common, shared) >= min(near.need(a), common)
