import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from usagelens.llm import quality_rules

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def write(spark, rows, path):
    table = [(i, t, "en", "web" if i % 3 else "hot", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, KIND).write.parquet(f"{path}/documents.parquet")
    return str(path)


def packed(spark, path):
    """The texts that the packed sequences hold, by doc_id, and the sequences' sizes."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, filled = {}, {}
    for r in corpus_pipeline.run(spark, path).orderBy("sequence_id", "offset").collect():
        assert r["offset"] == filled.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
    texts = {}
    for doc, found in pieces.items():
        found.sort(key=lambda x: x[0])
        ids = np.concatenate([x[2] for x in found])
        assert [x[0] for x in found] == [0, *np.cumsum([len(x[2]) for x in found])[:-1]]
        assert len(ids) == found[0][1] and ids[-1] == 0
        texts[doc] = tokenizer.decode(ids[:-1].tolist(), skip_special_tokens=False)
    return texts, list(filled.values())


def test_every_stage_takes_effect(spark, tmp_path):
    clean = {i: prose(i) for i in range(30)}
    shared = " ".join(prose(900, 70).split())
    rows = list(clean.items())
    rows += [(i, clean[1]) for i in (100, 101, 102)]                                    # exact copies
    rows += [(110, clean[2].rsplit(" ", 1)[0] + " other.")]                             # near copy
    rows += [(120, prose(120) + "\nwrite to jane.roe@example.com now."), (121, None), (122, ""), (123, "spam " * 400)]
    rows += [(i, f"{prose(i)}\n{shared}\n{prose(i + 50)}") for i in (200, 201, 202)]     # a passage of 70 words that repeats
    path = write(spark, rows, tmp_path)
    good = {r["doc_id"] for r in quality_rules.keep_good(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    texts, sizes = packed(spark, path)
    assert set(clean) <= good and not {121, 122, 123} & good
    # Copies of whole texts go as repeated lines or as near duplicates; the first of each stays as it is.
    assert {i: texts.get(i) for i in clean} == clean
    assert all(not texts.get(i) for i in (100, 101, 102)) and len(texts.get(110, "").split()) < 30
    assert "jane.roe@example.com" not in texts[120] and texts[120].startswith(prose(120))
    assert [shared in texts[i] for i in (200, 201, 202)] == [True, False, False]
    assert all(prose(i) in texts[i] and prose(i + 50) in texts[i] for i in (200, 201, 202))
    assert set(texts) <= good and all(n & (n - 1) == 0 and n <= 1024 for n in sizes)


@pytest.mark.parametrize("rows", [[], [(7, None), (8, "")]])
def test_nothing_to_keep(spark, tmp_path, rows):
    assert packed(spark, write(spark, rows, tmp_path)) == ({}, [])
