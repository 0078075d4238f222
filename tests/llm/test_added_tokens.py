"""Texts that hold a tokenizer's added tokens, against the plain library."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from usagelens.llm import packing, token_store
from usagelens.llm.tokens import Encoder

E, S = "<|endoftext|>", "<|startoftext|>"
TEXTS = [
    f"a{E}b", f"a {E} b", f"{E}", f"{E}{E}", f"{S}{E}{S}", f"x  {E}\n\n y\t{E}", f"1{E}2", "1<|ENDOFTEXT|>2 É1<|EndOfText|>", f"<{E}>", "<|endoftext", "|endoftext|>", f"don't{E}'s É{E}é",
    f"\n{E}", f"a\n{E}b\n", f" {E}　", f"{S.upper()}{S}", "", "plain text, no token",
]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_encoder(name):
    path = public_tokenizers.path(name)
    plain, enc = Tokenizer.from_file(path), Encoder(path)
    for _ in range(2):  # new parts, then known ones
        ids, bounds = enc.encode(TEXTS)
        for i, text in enumerate(TEXTS):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    want = {i: np.array([*plain.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(TEXTS)}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    start = 0
    for r in token_store.store_and_read(docs, path).orderBy("doc_id").collect():
        ids = want[r["doc_id"]][:-1]
        assert r["start"] == start and r["n_tokens"] == len(ids) + 1
        start += r["n_tokens"]
    packed = packing.pack(docs, path, end=0).collect()
    for r in packed:
        assert r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
    assert sum(r["length"] for r in packed) == sum(map(len, want.values()))
