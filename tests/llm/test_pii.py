import hashlib
import re

from pyspark.sql import functions as F

from keyspan.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(df):
    rows = {(r.doc_id, r.base_sha256): r for r in pii.personal_data_digest(df).collect()}
    texts = df.select("doc_id", "text").collect()
    for r in texts:
        want = brute(r.text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        got = rows[r.doc_id, digest]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [
            sum(k == kind for k, _, _ in want) for kind in pii.KINDS
        ]
        spans = got.spans.split(",") if got.spans else []
        assert spans[: len(want)] == [f"{k}:{a}:{b}" for k, a, b in want]
        for s in spans[len(want) :]:
            kind, a, b = s.split(":")
            assert kind == "term" and all(int(b) <= x or int(a) >= y for _, x, y in want)
    return rows


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(check(df)) >= 150


def test_hard_texts(spark):
    texts = [
        None,
        "",
        "a@b.com_x@y.zz a@b@c.de x@y a.b@c..d",
        "1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1 1.2.3.99999999999999999999",
        "4111 1111 1111 1111, 4111-1111-1111-1111 4111 1111 1111 1112 0000 0000 0000 0000 000",
        "+1 (743) 555-3824 +1 2 +49-170-1234567890123 +1((((((((( +1.2.3.4.5.6.7.8",
        "ünï\U0001f600 q@w.example \U0001f600 +1 (743) 555-3824 \U0001f600 8.8.8.8",
        "x" * 3_000,
        "1" * 3_000,
        "a@" * 2_000 + "b.c",
        "\n".join(f"{i % 256}.1.1.1 u{i}@h.example" for i in range(3000)),
    ]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    check(df.union(df))
    check(df.limit(0))


def test_terms_that_disclose(spark):
    linked = [(i, f"nr{i} words here Zarquonia reach me at who@where.example thanks nr{i}") for i in range(5)]
    other = [(100 + i, f"plain text number {i} with thanks and words here and reach") for i in range(200)]
    df = spark.createDataFrame(linked + other, "doc_id long, text string").withColumn("n_chars", F.lit(0))
    rows = {r.doc_id: r.spans for r in pii.personal_data_digest(df).collect()}
    start = linked[0][1].index("Zarquonia")
    assert f"term:{start}:{start + 9}" in rows[0]
    assert all(rows[100 + i] == "" for i in range(200))
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[0].text == "nr0 words here  reach me at <EMAIL> thanks nr0"
    assert clean[0].n_chars == len(clean[0].text)
    assert clean[150].text == other[50][1]
    # Copies of one text are no evidence.
    copies = spark.createDataFrame([(i, linked[0][1]) for i in range(5)] + other, "doc_id long, text string")
    assert all("term" not in r.spans for r in pii.personal_data_digest(copies).collect())


def test_very_long_runs_take_linear_time(spark):
    texts = ["x" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "+" * 1_000_000, "1." * 500_000 + " q@w.example"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_email for r in pii.personal_data_digest(df).collect()}[4] == 1


def test_copies_change_no_score(spark):
    linked = [(i, f"nr{i} words here Zarquonia reach me at who@where.example thanks nr{i}") for i in range(5)]
    linked += [(1000 + i, linked[0][1]) for i in range(300)]
    other = [(5000 + i, f"plain text number {i} with thanks and words here and reach") for i in range(200)]
    other += [(9000 + i, other[0][1]) for i in range(300)]
    df = spark.createDataFrame(linked + other, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(clean[i] == f"nr{i} words here  reach me at <EMAIL> thanks nr{i}" for i in range(5))
    assert all(clean[1000 + i] == clean[0] for i in range(300))
    assert all(clean[i] == t for i, t in other)


def test_terms_at_all_places_of_the_text(spark):
    filler = "plain text number and words here with thanks " * 20
    linked = [(i, f"Ada 李明 Zarquonia {i} {filler} ada, zarquonia {filler} who@where.example Ada") for i in range(5)]
    other = [(100 + i, f"{i} {filler}") for i in range(200)]
    df = spark.createDataFrame(linked + other + [(999, "Zarquonia alone")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(5):
        assert clean[i] == f"   {i} {filler} ,  {filler} <EMAIL> "
    assert clean[999] == "Zarquonia alone" and clean[100] == other[0][1]


def test_columns_with_names_of_its_own_pass_through(spark):
    names = ["terms", "base", "_text_key", "_pieces", "rest", "_gaps_email", "kind"]
    rows = [(1, "mail a@b.org now", *names, 99), (None, None, *names, 99), (3, "", *names, 99)]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names) + ", n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "mail <EMAIL> now" and got[1]["n_chars"] == len("mail <EMAIL> now")
    assert got[None]["text"] is None and got[3]["text"] == ""
    for row in got.values():
        assert all(row[n] == n for n in names)
