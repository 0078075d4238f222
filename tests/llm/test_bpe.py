import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from usagelens.llm import bpe, queries

SF = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Signs at which a cut can go wrong.
SIGNS = ["'", "s", "t", "re", "ve", "LL", "d", " ", "  ", "\n", "\t", "a", "B", "é", "é", "Σ", "ς", "İ", "1", "23", "²", "!", "?!", "-", "<|endoftext|>",
         "<|startoftext|>", "<|", "|>", "\0", "　", "\xa0", "\x1c", "漢字", "🎉", "​", "aaaa", "zzzzzz", "J̌", "e\u07fd\u0301", "\u0899", "՘", "Ᲊ", "Ꟛ"]


def odd_texts():
    rnd = random.Random(7)
    yield from ("", " ", "\n\n", "'", "''s", "'s", "a" * 3000, " " * 500, "".join(rnd.choice("abcdefghij") for _ in range(20_000)))
    for _ in range(3000):
        yield "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 25)))


@pytest.mark.parametrize("name", FILES)
def test_equals_the_library_on_odd_texts(name):
    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), list(odd_texts())
    ids, bounds = bpe.bpe(path).encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, a, b, w in zip(texts, bounds[:-1], bounds[1:], want, strict=True):
        assert ids[a:b].tolist() == w.ids, text
        assert bpe.bpe(path).decode(ids[a:b]) == library.decode(w.ids, skip_special_tokens=False), text


@pytest.mark.parametrize("name", FILES)
def test_one_merge_a_round_gives_the_same(name):
    path = public_tokenizers.path(name)
    one = bpe.Bpe(path)
    one.ordered = False
    texts = list(odd_texts())[9:400]
    assert (one.encode(texts)[0] == bpe.bpe(path).encode(texts)[0]).all()


def test_words_that_share_a_hash_are_merged_apart(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    want = bpe.bpe(path).encode(["one two three two"])[0]
    monkeypatch.setattr(bpe, "mix", lambda h: h * np.uint64(0))
    assert (bpe.Bpe(path).encode(["one two three two"])[0] == want).all()


def test_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, None, "x", b"x"), (2, "", "x", b"x"), (None, "a b c", None, b"x"), (3, "same text", "x", b"x"), (3, "same text", "x", b"x"), (4, "w " * 50_000, "x", b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 2), (3, 2), (4, 50_000)]
    assert [r["decoded"] for r in got if r["doc_id"] == 3] == ["same</w> text</w>"] * 2
    assert bpe.round_trip(docs.limit(0), path).count() == 0
    strange = spark.createDataFrame([(1, 1, np.array([3306, 10**6, 49407], "<u4").tobytes()), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert sorted(r["decoded"] for r in bpe.decode(strange, path).collect()) == ["", "hello</w> <|endoftext|>"]
