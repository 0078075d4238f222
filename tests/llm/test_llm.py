import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from checks.compare import compare, oracle_connection
from usagelens.llm import fingerprints, line_dedup, ngram_join, packing, pieces, pii, quality_rules, queries, token_store

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", "x"), (None, "a b c", None), (3, "mail a.b@c.de now", "x"), (3, "mail a.b@c.de now", "x"), (4, "w " * 3000, "x")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_lines string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    ok, _, _, message = compare(spark, oracle_connection(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert ok, message


def test_odd_rows(odd):
    docs = odd.select("doc_id", "text")
    assert line_dedup.drop_repeated_lines(docs).count() == len(ODD)
    assert quality_rules.measure_quality(odd).count() == len(ODD)
    assert [r["spans"] for r in pii.personal_spans(odd).filter("doc_id = 3").collect()] == ["email:5:13"] * 2
    assert ngram_join.similar_documents(odd).count() == len(ODD)
    assert fingerprints.compare_with_edits(odd).count() == len(ODD)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_store_and_packing(spark, name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [2] for r in docs.select("doc_id", "text").collect()}
    start = 0
    for r in token_store.store_and_read(docs, path).orderBy("doc_id").collect():
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    filled = {}
    for r in packing.pack(docs, path, end=2).orderBy("sequence_id", "offset").collect():
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["ids"] == np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
    assert sum(filled.values()) == start and all(n & (n - 1) == 0 for n in filled.values())


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint32)
    m = token_store.WaveletMatrix.build(ids, 6)
    m = token_store.WaveletMatrix.from_bytes(m.to_bytes(), m.n, m.zeros)
    assert (m.all() == ids).all() and m.access(1234) == ids[1234]
    assert m.count(7, 100, 2000) == (ids[100:2000] == 7).sum() and m.find(7) == np.flatnonzero(ids == 7).tolist()


def test_pieces_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    got = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, path, 500), path).collect()}
    assert got == {r["doc_id"]: r["text"] for r in docs.collect()}


def _without_repeats(docs: list[tuple], run: int, words: int) -> dict:
    """Text per doc_id by the definition: every run that stood before loses its lines."""
    seen, out = set(), {}
    for doc_id, text in docs:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        gone = set()
        for s in range(len(at)):
            for k in range(1, run + 1):
                part = at[s : s + k]
                if len(part) == k and (k == run or sum(len(lines[i].split()) for i in part) >= words):
                    passage = tuple(lines[i].strip() for i in part)
                    gone |= set(range(part[0], part[-1] + 1)) if passage in seen else set()
                    seen.add(passage)
                    break
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines_repeat_by_words_and_by_lines(spark):
    rng = np.random.default_rng(4)
    sizes = [0, 1, 3, 6, 9, 12]
    lines = [" ".join(f"l{i}w{j}" for j in range(sizes[i % 6])) for i in range(14)]
    docs = [(d, "\n".join(lines[i] for i in rng.integers(0, 14, rng.integers(1, 9)))) for d in range(120)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), run=3, words=10)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == _without_repeats(docs, 3, 10)


def test_a_long_line_is_a_passage_and_columns_may_clash(spark, odd):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"first\n{passage}\nend", "a", "b", "c"), (2, f"other\n {passage}\t", "d", None, "f"), (3, f"{passage} and more\nshort\nshort", "g", "h", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, __key string, n_lines string")
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "__key", "n_lines", "n_deleted"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [
        (1, rows[0][1], "a", "b", 3, 0), (2, "other", "d", None, 2, 1), (3, rows[2][1], "g", "h", 3, 0)]
    assert line_dedup.drop_repeated_lines(odd).count() == len(ODD)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
