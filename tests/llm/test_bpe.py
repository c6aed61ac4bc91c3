import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from keyspan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def hard_texts():
    rng = random.Random(1)
    return [
        "", " ", "a" * 3000, " " * 1000 + "x", "\x1c\x1d a b c​\n\n x", "1234567890" * 30,
        "été naïve 日本語のテキスト" * 40, "😀" * 200, "<|endoftext|> it's we'll I'm", "\x00\x01", "ab" * 777 + "ba" * 333,
        "é" * 500, "=-" * 400, "thequickbrownfox" * 60, "\r\n\t \n  y  ", "x" * 100_000, "a \n b\n\n  c   d ",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1500)),
        "".join(chr(rng.randrange(1, 0x3000)) for _ in range(4000)),
        " ".join("".join(rng.choice("aeintso\n ") for _ in range(rng.randrange(9))) for _ in range(3000)),
    ]


def test_hard_texts_as_the_library_does(library):
    own = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = hard_texts()
    ids = own.encode(texts)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.encoding_digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    for d in docs.collect():
        ids = library.encode_ordinary(d.text)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_nulls_repeats_and_clashes(spark, library):
    rows = [(1, None, 7), (1, None, 7), (2, "", 7), (None, "some text", 7), (None, "some text", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(map(str, (r.ids for r in got.collect()))) == sorted(
        map(str, [[], [], [], *[library.encode_ordinary("some text")] * 2])
    )
    assert bpe.encoding_digest(docs, PATH, public_tokenizers.PATTERN).count() == 5
    assert bpe.encoding_digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_calls_share_one_vocabulary(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    first = bpe._share(docs, path, public_tokenizers.PATTERN)
    assert bpe._share(docs.limit(1), path, public_tokenizers.PATTERN) is first
    assert bpe._share(docs, path, "[a-z]+") is not first
    for _ in range(2):  # the second call finds workers that have given back what they had learnt
        rows = bpe.encode_and_compare(docs, path, public_tokenizers.PATTERN).collect()
        assert all(r.round_trip for r in rows) and len(rows) == 2


def test_white_space_at_the_ends_of_segments(library):
    rng = random.Random(2)
    own = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["a \nb c\n", "a \nb c\n\n d", " \u2003z \u2003", "\x85 b\x85", "x \tbar\t", " ", "", "  ", " lead", "'s 's it's", "c\n"]
    texts += ["".join(rng.choice("ab1!' \n\t\u2003\x1c\xa0\x85é日") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for batch in (texts, texts[:1], ["", ""], [" "], ["one"], texts[::-1]):
        ids = own.encode(batch)
        assert ids.to_pylist() == [library.encode_ordinary(t) for t in batch]
        assert own.decode(ids) == [t.encode() for t in batch]


def test_another_pattern_leaves_spaces_out():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    own = bpe.Tokenizer(ranks, "[a-z]+")
    assert own.encode(["ab abc ab", "1 ab", ""]).to_pylist() == [[256, 256, 99, 256], [256], []]


class Counted:
    """Calls of one object's methods, counted, with the rows of tables among their arguments."""

    def __init__(self, inner):
        self.inner, self.calls, self.rows = inner, 0, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            self.rows += sum(getattr(a, "num_rows", 0) for a in args)
            return getattr(self.inner, name)(*args)

        return call


def test_work_of_a_batch_grows_with_pieces(library):
    # CPU time went into a call of the pattern for each word and into rows for each byte of a piece.
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfgxz") for _ in range(12)) for _ in range(2000)]
    own = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    _ = own.connection
    own._split, own._connection = Counted(own._split), Counted(own._connection)
    ids = own.encode([" ".join(words)])
    assert ids.to_pylist() == [library.encode_ordinary(" ".join(words))]
    assert own._split.calls < 10
    assert own._connection.rows <= len(words)
