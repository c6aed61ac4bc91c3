"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers found by patterns. A term (a run
of at least three letters, or of two in a script without cases and spaces, outside of e-mail addresses) discloses an
entity as far as the corpus links the two:

    IC(e)            = ln(N / df(e))                      information content of the entity
    PMI(e; t)        = ln(N * df(e, t) / (df(e) * df(t))) what the term tells about it
    disclosure(e; t) = PMI(e; t) / IC(e)                  1: the term occurs with the entity only

N and all df count different texts, so that copies of one text change no score. df(e, t) counts texts that hold both,
wherever they stand. Pairs need `min_support` texts. As df(e, t) is at most df(e), a pair can only reach the limit if
ln(N / df(t)) >= `generalise_at` * IC(e); terms more frequent than that are not paired with the entity, which loses
none. From `generalise_at` on a term is replaced by a class word, from `remove_at` on it is removed, at all its places
in all texts, copies included, that name the entity.

Defined cases: a NULL or empty text has no spans. Repeated rows give equal results, one for each row. Further
columns of any name pass through `sanitise` as they are; `n_chars` is made anew. A document without a mention is never changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import neutral, settled, small_broadcast, without

# The order of kinds and their patterns. Possessive quantifiers give the same matches as greedy ones
# here and keep the matcher from recursing on very long runs; the look-behinds skip starts inside a run, from which
# a match would only be possible where one from the run's start was.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM_PATTERN = r"\p{L}{3,}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2}+"
GENERALISED = "<TERM>"

BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int,value:string>"
PLACE = "struct<term:string,start:int,end:int>"


@dataclass(frozen=True)
class Disclosure:
    """Parameters of the disclosure test."""

    min_support: int = 3
    generalise_at: float = 0.7
    remove_at: float = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        digit = backwards.substr(i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda part: F.regexp_replace(part, "^0+", "")
        return F.forall(
            F.split(value, r"\."),
            lambda p: F.when(F.length(bare(p)) > 3, F.lit(False)).otherwise(
                F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255
            ),
        )
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _needed(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _spans(kind: str, gaps: Column, found: Column) -> Column:
    """Spans of the valid matches: their places follow from the lengths of the gaps between matches."""
    n = F.size(found)

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["0"])
        end = start + F.length(row["1"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            row["1"].alias("value"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # Blocks keep the work in proportion to the matches: an array is copied whenever it grows.
    def block(acc: Column, first: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        length = F.least(F.lit(BLOCK), n - first + 1)
        rows = F.arrays_zip(F.slice(gaps, first, length), F.slice(found, first, length))
        inner = F.aggregate(rows, begin, step)
        valid = F.filter(inner["out"], lambda s: _valid(kind, s["value"]))
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(valid)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n, F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["out"]))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """`docs` and `base`: array of the spans that the patterns find, by kind and then start."""
    kept = without(docs, ["base"])
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.col(f"`{name}`") for name in kept.columns]
    for kind in KINDS:
        pattern, needed = PATTERNS[kind], _needed(kind, text)
        parts.append(F.when(needed, F.split(text, pattern, -1)).alias(f"_gaps_{kind}"))
        parts.append(F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"_found_{kind}"))
    none = F.array().cast(f"array<{SPAN}>")
    spans = [
        F.when(F.size(F.col(f"_found_{k}")) > 0, _spans(k, F.col(f"_gaps_{k}"), F.col(f"_found_{k}"))).otherwise(none)
        for k in KINDS
    ]
    base = F.concat(*spans)
    return kept.select(*parts).select(*(F.col(f"`{name}`") for name in kept.columns), base.alias("base"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _without_emails(text: Column) -> Column:
    """The text with blanks in place of e-mail addresses, which alone of all kinds hold letters; of the same length."""
    pattern = PATTERNS["email"]
    rows = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    blanked = F.transform(rows, lambda r: F.concat(r["0"], F.repeat(F.lit(" "), F.coalesce(F.length(r["1"]), F.lit(0)))))
    return F.when(_needed("email", text), F.array_join(blanked, "")).otherwise(text)


def mentions_of(docs: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, key of the text, base spans, and the text without e-mail addresses if there are
    any spans. Settled: a narrow table where few texts name an entity."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = with_base_spans(docs.select("doc_id", "text"))
    rest = F.when(F.size("base") > 0, _without_emails(text))
    return settled(spans.select("doc_id", _text_key().alias("_text_key"), "base", rest.alias("rest")))


def _entity(span: Column) -> Column:
    """The mention in one form for all its spellings, with its kind."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(
        span["kind"].isin("card", "phone"), _digits(span["value"])
    )
    return F.concat_ws(":", span["kind"], F.coalesce(value, span["value"]))


def _words(text: Column) -> Column:
    """Hashes of the text's different terms: a third of the terms' own size where they are shuffled."""
    found = F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda term: F.xxhash64(F.lower(term))))


def _places(gaps: Column, found: Column) -> Column:
    """Terms with their starts and ends, in blocks as in `_spans`."""
    n = F.size(found)

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["0"])
        end = start + F.length(row["1"])
        one = F.struct(F.lower(row["1"]).alias("term"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{PLACE}>").alias("out"))
        length = F.least(F.lit(BLOCK), n - first + 1)
        inner = F.aggregate(F.arrays_zip(F.slice(gaps, first, length), F.slice(found, first, length)), begin, step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{PLACE}>>").alias("out"))
    placed = F.aggregate(F.sequence(F.lit(1), n, F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, placed)


def naming_texts(mentions: DataFrame) -> DataFrame:
    """Different texts that name an entity: key, entities, and places of terms. Settled."""
    # A stated number of partitions: the places of terms are work, though their rows are small.
    partitions = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    naming = mentions.where(F.col("rest").isNotNull()).select("_text_key", "base", "rest")
    texts = naming.repartition(partitions, "_text_key").dropDuplicates(["_text_key"])
    split = texts.select(
        "_text_key",
        F.array_distinct(F.transform("base", _entity)).alias("entities"),
        F.split("rest", TERM_PATTERN, -1).alias("_gaps"),
        F.regexp_extract_all("rest", F.lit(TERM_PATTERN), F.lit(0)).alias("_found"),
    )
    return settled(split.select("_text_key", "entities", _places(F.col("_gaps"), F.col("_found")).alias("places")))


def disclosing_terms(docs: DataFrame, mentions: DataFrame, texts: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """Pairs (entity, term) whose disclosure reaches `generalise_at`, with the scores and the action."""
    total = mentions.select("_text_key").distinct().count()
    n = F.lit(float(max(total, 1)))
    content = F.log(n / F.col("df_e"))
    named = texts.select("_text_key", F.explode("entities").alias("entity"))
    entities = settled(
        named.groupBy("entity")
        .agg(F.count("*").alias("df_e"))
        .where((F.col("df_e") >= params.min_support) & (content > 0))
    )
    most = entities.agg(F.max("df_e")).first()[0] or 0
    # Only texts of an entity that can be linked, and only terms that can be linked to one.
    named = named.join(small_broadcast(entities), "entity")
    can_reach = F.log(n / F.col("df_t")) >= params.generalise_at * F.log(n / F.lit(float(max(most, 1)))) - 1e-9
    text = F.coalesce(F.col("text"), F.lit(""))
    different = docs.select(_text_key().alias("_text_key"), _words(_without_emails(text)).alias("words")).dropDuplicates(["_text_key"])
    frequencies = (
        different.select(F.explode("words").alias("term_key"))
        .groupBy("term_key")
        .agg(F.count("*").alias("df_t"))
        .where((F.col("df_t") >= params.min_support) & can_reach)
    )
    terms = (
        texts.join(named.select("_text_key").distinct(), "_text_key", "left_semi")
        .select("_text_key", F.explode(F.array_distinct(F.transform("places", lambda p: p["term"]))).alias("term"))
        .withColumn("term_key", F.xxhash64("term"))
        .join(frequencies, "term_key")
        .drop("term_key")
    )
    pairs = (
        terms.join(named, "_text_key")
        .where(F.log(n / F.col("df_t")) >= params.generalise_at * content - 1e-9)
        .groupBy("entity", "term", "df_e", "df_t")
        .agg(F.count("*").alias("df_et"))
        .where(F.col("df_et") >= params.min_support)
    )
    return (
        pairs.withColumn("disclosure", F.log(n * F.col("df_et") / (F.col("df_e") * F.col("df_t"))) / content)
        .where(F.col("disclosure") >= params.generalise_at)
        .withColumn("action", F.when(F.col("disclosure") >= params.remove_at, "remove").otherwise("generalise"))
    )


def term_spans(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Spans of disclosing terms by text key: array of start, end and action, by start. Base spans hold no terms."""
    actions = (
        texts.select("_text_key", F.explode("entities").alias("entity"))
        .join(flagged.select("entity", "term", "action"), "entity")
        .groupBy("_text_key", "term")
        .agg(F.max("action").alias("action"))  # "remove" comes after "generalise"
    )
    return (
        texts.select("_text_key", F.explode("places").alias("p"))
        .select("_text_key", "p.term", "p.start", "p.end")
        .join(actions, ["_text_key", "term"])
        .groupBy("_text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )


def _found(docs: DataFrame, params: Disclosure) -> tuple[DataFrame, DataFrame]:
    """Mentions, and the spans of disclosing terms, to be joined by the text's key."""
    mentions = mentions_of(docs)
    texts = naming_texts(mentions)
    flagged = settled(disclosing_terms(docs, mentions, texts, params))
    return mentions, small_broadcast(settled(term_spans(texts, flagged)))


def find_personal_data(docs: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, `base` (spans of the patterns) and `terms` (spans of disclosing terms) for each row of `docs`."""
    mentions, terms = _found(docs, params)
    found = mentions.join(terms, "_text_key", "left")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """`docs` with personal data in `text` replaced by class words and disclosing terms generalised or removed.

    `n_chars`, if there, becomes the new length. A NULL text stays NULL.
    """
    _, terms = _found(docs, params)
    plain = neutral(docs, ("text", "n_chars"))
    keyed = with_base_spans(plain).withColumn("_text_key", _text_key())
    label = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    pieces = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("as"))),
        F.transform(
            F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.when(s["action"] == "remove", "").otherwise(GENERALISED).alias("as"),
            ),
        ),
    )
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        # Where spans of two kinds overlap, one class word stands for both.
        fresh = s["start"] >= acc["at"]
        kept = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(kept, s["as"]))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate(
        F.array_sort("_pieces"),
        begin,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
    sanitised = (
        keyed.join(terms, "_text_key", "left")
        .withColumn("_pieces", pieces)
        .withColumn("text", F.when(F.size("_pieces") > 0, rebuilt).otherwise(text))
    )
    if "n_chars" in docs.columns:
        sanitised = sanitised.withColumn("n_chars", F.length("text").cast("long"))
    return sanitised.select(*plain.columns).toDF(*docs.columns)


def personal_data_digest(docs: DataFrame, params: Disclosure = Disclosure()) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans, for each row of `docs`."""
    found = find_personal_data(docs, params)
    show = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform("base", show), ",")
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    spans = F.array_join(F.concat(F.transform("base", show), terms), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))
