import math
import random
import re
from collections import Counter

import pytest

from usagelens.llm import lexical_search

_SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in _SPLIT.findall(text or "")]


def brute_force(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, c in counted:
            m = 75 + 25 * c.total() * n_docs // max(1, n_all)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


WORDS = ["the", "The", "cat", "Katze", "naïve", "ÉTÉ", "été", "a1", "1a", "_", "x-y", "漢字", "it's", "\0", "end.", "\n", "cat\tcat", "ſ", "K"]


@pytest.mark.parametrize("block_terms", [lexical_search.BLOCK_TERMS, 12])
def test_against_brute_force(spark, block_terms):
    rnd = random.Random(5)
    text = lambda most: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, most)))
    docs = [(i, text(40)) for i in range(120)] + [(500, None), (501, ""), (502, " .!"), (503, "cat the " * 30_000), (7, "cat"), (7, "cat"), (None, "cat"), (None, None)]
    items = [(i, text(9)) for i in range(25)] + [(90, None), (91, ""), (92, "cat cat"), (92, "cat cat"), (93, "never seen"), (None, "été naïve"), (94, "the " * 40)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, list string")
    got = [tuple(r) for r in lexical_search.search(df, asked, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute_force(docs, items)


def test_two_texts_of_an_item_rank_apart(spark):
    docs = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "blue sky")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red"), (1, "blue")], "item_id long, text string")
    got = sorted(tuple(r)[:3] for r in lexical_search.search(docs, items).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 2, 3)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
