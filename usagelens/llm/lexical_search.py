"""Ranked lexical search by an automaton of all item terms, without an index of the documents.

The terms of the items are put between blanks into one Aho-Corasick automaton, which is broadcast; a document's text, with a blank
for every character that is in no term, runs through it once, and what it reports are the document's counts of item terms. Terms
are found whole because of the blanks, which neighbouring terms share. The counts of a document are written once; their sums (documents,
terms, documents per term) cover the whole table, and a second pass over the counts, not the texts, scores every document for every item that
the automaton's terms map to. A task keeps the `TOP` best documents per item while it goes, so it sends at most that many rows per
item, whatever it reads.

Items are worked in blocks of about `BLOCK_TERMS` terms, each with an automaton of its own, so what is broadcast has a bound however many
items there are (an item of more terms is a block by itself).

Null text has no terms: such a document is never found and does not count in N, such an item finds nothing. Every row of the
documents is a document: repeated rows count and rank each, next to each other. Item rows of equal item_id and text are one item; other texts under an
item_id are ranked by themselves. Null ids are passed through, a null doc_id ranks first among equal scores. Other
columns are ignored; without documents or items there are no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from usagelens.llm.common import importable, slices
from usagelens.session import cut_lineage

TOP = 20
#: Term occurrences of the items of a block.
BLOCK_TERMS = 200_000

_TERM = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_BLANK = 0x20
#: What a byte of UTF-8 becomes: ASCII letters (in lower case), digits and all bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))
_COUNTS = "doc_id long, n long, terms binary, tfs binary"
_open: dict = {}


def term_list(text: str) -> str:
    """SQL text of the list of terms of `text`; null gives an empty list."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '{_TERM}', 0)"


def _automaton(key: str, terms: list[str]):
    """One automaton per worker process, the last one used."""
    if key not in _open:
        import ahocorasick

        _open.clear()
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term.encode().decode('latin-1')} ", i)
        made.make_automaton()
        _open[key] = made
    return _open[key]


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms of the text with repeats), terms and tfs (the listed terms in it by number, and how often; 32-bit) of every row."""
    spark = docs.sparkSession
    importable(spark)
    shared, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, "text"):
                n, which, often = [], [], []
                for text in part.column("text").to_pylist():
                    folded = f" {text or ''} ".encode().translate(_FOLD)
                    n.append(len(folded.split()))
                    hits = np.fromiter((i for _, i in found.iter(folded.decode("latin-1"))), np.int32) if found else np.zeros(0, np.int32)
                    ids, tfs = np.unique(hits, return_counts=True)
                    which.append(ids.astype("<i4").tobytes())
                    often.append(tfs.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(which, pa.binary()), pa.array(often, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COUNTS)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all rows in one array, and each row's bounds in it."""
    rows = column.to_pylist()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(rows), "<i4"), np.concatenate([[0], np.cumsum(sizes)])


def corpus_counts(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and of each listed term the documents that hold it. Tasks add up theirs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = np.zeros(2, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            total += (np.count_nonzero(n), n.sum())
            df += np.bincount(_flat(batch.column("terms"))[0], minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([[-2, -1], seen]), pa.int64()), "n": pa.array(np.concatenate([total, df[seen]]), pa.int64())})

    rows = counts.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms, np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


class Best:
    """The best documents per item among those shown so far: higher scores first, then smaller doc_ids (null before all)."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def show(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        near = score >= np.maximum(self.least[item], 1)
        item, score, doc, known = (np.concatenate([a, b[near]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, known, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.least[item[place == self.top - 1]] = score[order][place == self.top - 1]
        stay = order[place < self.top]
        self.item, self.score, self.doc, self.known = item[place < self.top], score[stay], doc[stay], known[stay]


def score_documents(counts: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_all: int, df: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): for every item, by number, each task's best documents. `items` has the term numbers of each item and how often it has them."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    # For each term the items that have it.
    term = np.concatenate([t for t, _ in items])
    order = np.argsort(term, kind="stable")
    links = np.repeat(np.arange(len(items)), [len(t) for t, _ in items])[order]
    times = np.concatenate([r for _, r in items]).astype(np.int64)[order]
    first = np.searchsorted(term[order], np.arange(len(df) + 1))
    shared = counts.sparkSession.sparkContext.broadcast((weight, links, times, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, links, times, first = shared.value
        best = Best(len(items), top)
        for batch in batches:
            # Slices of so many rows that their (row, item) sums stay small.
            step = max(1, min(1024, (1 << 22) // len(items)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                terms, bounds = _flat(part.column("terms"))
                tf = _flat(part.column("tfs"))[0].astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                m = 75 + (25 * part.column("n").to_numpy(zero_copy_only=False) * n_docs) // max(1, n_all)
                worth = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                sums = np.zeros(part.num_rows * len(items), np.int64)
                # A stretch of term places at a time, so that what it links to stays small too.
                fans = first[terms + 1] - first[terms]
                ends = np.cumsum(fans)
                at = 0
                while at < len(terms):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), side="right")))
                    fan = fans[at:to]
                    begin = np.cumsum(fan) - fan
                    link = np.repeat(first[terms[at:to]] - begin, fan) + np.arange(int(fan.sum()))
                    np.add.at(sums, np.repeat(row[at:to] * len(items), fan) + links[link], np.repeat(worth[at:to], fan) * times[link])
                    at = to
                hit = np.flatnonzero(sums)
                doc = part.column("doc_id")
                known = ~doc.is_null().to_numpy(zero_copy_only=False)
                doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
                best.show(hit % len(items), sums[hit], doc[hit // len(items)], known[hit // len(items)])
        yield pa.RecordBatch.from_pydict({"item": pa.array(best.item, pa.int64()), "doc_id": pa.array(best.doc, pa.int64(), mask=~best.known), "score": pa.array(best.score, pa.int64())})

    return counts.mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_terms: int) -> int:
    """Into how many blocks the items are dealt: no block has over twice `block_terms` terms unless one of its items alone has more."""
    blocks = max(1, -(-(items.agg(F.sum(F.size("list"))).first()[0] or 0) // block_terms))
    while blocks > 1:
        sizes = items.groupBy(F.expr(f"pmod(key, {blocks})")).agg(F.sum(F.size("list")).alias("n"), F.max(F.size("list")).alias("most"))
        if sizes.where(f"n > greatest(2L * {block_terms}, 2L * most)").isEmpty():
            break
        blocks *= 2
    return blocks


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for every row of `items` (item_id, text)."""
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct()
    wanted = cut_lineage(wanted.selectExpr("item_id", "xxhash64(item_id, text) AS key", f"{term_list('text')} AS list").where("size(list) > 0"))
    blocks = _blocks(wanted, block_terms)
    out = spark.createDataFrame([], "item_id long, key long, item long, doc_id long, score long")
    totals = None
    for block in range(blocks):
        rows = wanted.where(f"pmod(key, {blocks}) = {block}").collect()
        if not rows:
            continue
        terms = sorted({t for r in rows for t in r["list"]})
        number = {t: i for i, t in enumerate(terms)}
        held = [np.unique([number[t] for t in r["list"]], return_counts=True) for r in rows]
        counts = cut_lineage(count_terms(docs, terms))
        n_docs, n_all, df = corpus_counts(counts, len(terms))
        totals = totals or (n_docs, n_all)
        names = spark.createDataFrame([(i, r["item_id"], r["key"]) for i, r in enumerate(rows)], "item long, item_id long, key long")
        found = score_documents(counts, held, *totals, df, top).join(F.broadcast(names), "item")
        out = out.unionByName(found.select(*out.columns))
    best = Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
