import random

import pytest
import tiktoken

from stintline.llm import bpe

LINES, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def engine():
    return bpe._engine(LINES)


@pytest.fixture(scope="module")
def library(engine):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=engine.ranks, special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(engine, library):
    import regex

    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x180), 0x2028, 0x3000, 0xA0, 0x4E2D, 0x1F600, 0x661, 0x301]]
    texts = ["".join(rng.choice(letters if rng.random() < 0.5 else "aab !!  \n'sTh") for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    texts += ["a" * 5000, "=" * 9999, " " * 333 + "x", "\n" * 777, "<|endoftext|>", "antidisestablishmentarianism"]
    for text, ids in zip(texts, engine.encode(texts, regex.compile(PATTERN))):
        assert ids == library.encode_ordinary(text)
        assert engine.decode(ids) == text.encode()


def test_ranks_that_come_back_below_a_merge_just_made():
    # ab (9) is merged late, and abc (3) exists: the new pair precedes the second ab
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 9, b"abc": 3, b"bab": 5, b"cab": 4}
    own = bpe.MergeReplay(ranks)
    library = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    for word, ids in zip(words, own.replay([w.encode() for w in words])):
        if word.encode() not in ranks:
            assert ids == library.encode_ordinary(word), word


def test_frame_keeps_rows_and_columns(spark, awkward):
    out = bpe.encode(awkward, LINES, PATTERN)
    rows = out.collect()
    assert len(rows) == awkward.count()
    assert out.columns == [c for c in awkward.columns if c != "n_tokens"] + ["n_tokens", "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.token_ids) for r in rows)


def test_empty(spark, make):
    assert bpe.encode(make([]), LINES, PATTERN, digests=True).count() == 0


def test_registered_query_against_the_library(spark, library):
    """Every document of the smallest tables: counts and both digests."""
    import hashlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = bpe.op6_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest() == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_forgetting_words_changes_nothing(library, monkeypatch):
    import regex

    monkeypatch.setattr(bpe, "MEMORY_BYTES", 0)
    own = bpe.MergeReplay(library._mergeable_ranks)
    for turn in range(3):
        texts = [f"some words {turn} and others", "and others again"]
        assert list(own.encode(texts, regex.compile(PATTERN))) == [library.encode_ordinary(t) for t in texts]
        assert own.held > 0
