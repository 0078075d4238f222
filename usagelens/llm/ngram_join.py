"""Exact similarity join on five-word shingles, by vertical partitioning.

Two documents link when their shingle sets have a Jaccard similarity of at least 3/4. Shingles are 64-bit
hashes in one global order (heavy ones last, by hash otherwise); the order is cut into fragments, each
set into one segment per fragment, and the overlap of a pair is counted fragment by fragment and summed.
What decides which pairs are counted loses no link:

1. Equal sets are one class, represented by its smallest doc_id.
2. Of two linked sets, at most |x| / 4 shingles of x are missing in y. So of the p first shingles of x by hash
   at least p - |x| / 4 occur in another class. The shingles are dealt out by fragment, each fragment counts
   the shared ones per class, and a class whose sum is too small has no link at all.
3. Of the others, linked sets share one of the first |x| / 4 + 1 shingles, at a place that leaves room for the
   overlap. Classes that share such a shingle are paired with one leader per shingle first, and the linked ones
   joined to components. Then, for every shingle whose classes are still in several components, each class
   outside the largest of them is paired with all classes of other components. Links inside a component
   cannot change it, so the components are those of all links, without emitting the pairs of a large group.

Null text has no words: an empty set, linked with nothing. Null doc_ids have a null component unless they
share it with a smaller id; repeated rows are equal sets; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import importable, shingle_sets, slices, word_hashes
from usagelens.session import cut_lineage

#: Fragments that a set is cut into for counting.
SEGMENTS = 4
#: Heavy shingles that the global order puts last; the order decides the cost only.
HEAVY = 1 << 17
HEAVY_FROM = 16
#: Words of 64 bits of a set's parity map: bit i tells whether an odd number of shingles fall on i. Two maps
#: differ in at most as many bits as the sets differ in shingles, which rules out pairs before counting.
PARITY = 16
#: Rounds with one leader per shingle.
STARS = 3


def _sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in slices(batch, "text"):
            yield part.column("doc_id").to_pylist(), shingle_sets(*word_hashes(part.column("text")))


def _set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _probed(n: int) -> int:
    """Shingles of a set of n that the first filter looks at."""
    return min(n, n // 4 + 1 + n // 8)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, sets in _sets(batches):
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "n": pa.array(map(len, sets), pa.int64()), "set_id": pa.array(map(_set_id, sets), pa.int64())})


def _deal(parts: int):
    """Emits the probed shingles of all sets by fragment: the distinct sets, and per shingle its upper half and its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            distinct = {_set_id(x): x for x in sets if len(x)}
            if not distinct:
                continue
            ids = np.fromiter(distinct, np.int64, len(distinct))
            probed = [x[: _probed(len(x))] for x in distinct.values()]
            tokens, owner = np.concatenate(probed), np.repeat(np.arange(len(ids)), [len(x) for x in probed])
            fragment = ((tokens & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(fragment, kind="stable")
            bounds = np.searchsorted(fragment[order], np.arange(parts + 1))
            out = {"fragment": [], "sets": [], "owners": [], "tokens": []}
            for f in range(parts):
                here = order[bounds[f] : bounds[f + 1]]
                if len(here):
                    used, local = np.unique(owner[here], return_inverse=True)
                    out["fragment"].append(f)
                    out["sets"].append(ids[used].tobytes())
                    out["owners"].append(local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes())
                    out["tokens"].append((tokens[here] >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("sets", "owners", "tokens"))], list(out))

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one fragment: (set, shared shingles), and heavy shingles as (shingle, -classes)."""
    owners, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for row in batch.to_pylist():
            sets, token = np.frombuffer(row["sets"], np.int64), np.frombuffer(row["tokens"], np.uint32)
            owners.append(sets[np.frombuffer(row["owners"], np.uint16 if len(row["owners"]) == 2 * len(token) else np.uint32)])
            tokens.append(token)
    owner, token = np.concatenate(owners), np.concatenate(tokens)
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    owner, token = owner[new], token[new]
    if not len(token):
        return
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    classes = np.diff(np.append(first, len(token)))
    found, shared = np.unique(owner[np.repeat(classes, classes) > 1], return_counts=True)
    heavy = classes >= HEAVY_FROM
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([found, token[first][heavy].astype(np.int64)]), pa.int64()), pa.array(np.concatenate([shared, -classes[heavy]]), pa.int64())], ["id", "n"]
    )


_SET_COLUMNS = ["rep", "n", "fragment", "segment", "prefix", "parity"]
_SET_SCHEMA = "rep long, n long, fragment int, segment array<long>, prefix array<long>, parity array<long>"


def _parity(shingles: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((shingles % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1).view(np.int64)


def _cut_sets(heavy: np.ndarray):
    """One row per set and fragment: the segment; the first also has the prefix in the global order."""
    by_token = np.sort(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _sets(batches):
            rep, size, fragment, segment, prefix, parity = [], [], [], [], [], []
            for name, shingles in zip(names, sets, strict=True):
                upper = (shingles >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(by_token, upper), max(0, len(by_token) - 1))
                late = by_token[at] == upper if len(by_token) else np.zeros(len(upper), bool)
                ordered = np.concatenate([shingles[~late], shingles[late]])[: len(shingles) // 4 + 1]
                cuts = np.searchsorted(shingles, np.arange(1, SEGMENTS, dtype=np.uint64) << np.uint64(64 - SEGMENTS.bit_length() + 1))
                for f, part in enumerate(np.split(shingles.view(np.int64), cuts)):
                    rep.append(name)
                    size.append(len(shingles))
                    fragment.append(f)
                    segment.append(part)
                    prefix.append(ordered.view(np.int64) if f == 0 else None)
                    parity.append(_parity(shingles) if f == 0 else None)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(size, pa.int64()), pa.array(fragment, pa.int32()), pa.array(segment, kind), pa.array(prefix, kind), pa.array(parity, kind)], _SET_COLUMNS)

    return run


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over the fragments, reaches the threshold, with their components."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("seg_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("seg_b"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = both.select("a", "b", "of_a", "of_b", "n_a", "n_b", F.expr("size(array_intersect(seg_a, seg_b))").alias("common"))
    return partial.groupBy("a", "b", "of_a", "of_b", "n_a", "n_b").agg(F.sum("common").alias("common")).filter("7 * common >= 3 * (n_a + n_b)").select(*pairs.columns)


def components(links: DataFrame) -> DataFrame | None:
    """(rep, component): the smallest id reachable over links (a, b), for every id that has a link; None without links."""
    # Both directions, and each id beside itself: one minimum covers an id and all around it.
    ends = F.expr("explode(array(struct(a AS v, b AS w), struct(b AS v, a AS w), struct(a AS v, a AS w), struct(b AS v, b AS w)))")
    edges = cut_lineage(links.select(ends.alias("e")).select("e.*").distinct())
    if edges.isEmpty():
        return None
    label = edges.groupBy("v").agg(F.min("w").alias("c"))
    while True:
        # The smallest label around each id, then the label of that label, which is never larger.
        near = edges.join(label.withColumnRenamed("v", "w"), "w")
        around = near.groupBy("v").agg(F.min("c").alias("d"), F.max(F.expr("IF(v = w, c, NULL)")).alias("c"))
        step = cut_lineage(around.join(label.select(F.col("v").alias("d"), F.col("c").alias("next")), "d").select("v", "c", "next"))
        label = step.select("v", F.col("next").alias("c"))
        if step.filter("next < c").isEmpty():
            return label.select(F.col("v").alias("rep"), F.col("c").alias("component"))


#: Sizes and places that leave room for the overlap a link needs.
_ROOM = "4 * least(n, m) >= 3 * greatest(n, m) AND 7 * (n - pos) >= 3 * (n + m) AND 7 * (m - at) >= 3 * (n + m)"
_DIFFER = " + ".join(f"bit_count(p{i} ^ q{i})" for i in range(PARITY))


def _may_link(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs that their parity maps do not rule out."""
    other = maps.select(F.col("rep").alias("b"), F.col("n").alias("m"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(PARITY)])
    return pairs.join(maps.withColumnRenamed("rep", "a"), "a").join(other, "b").filter(f"7 * ({_DIFFER}) <= n + m").select(*pairs.columns)


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """The rows with `component` after the moves (rep, component) of components."""
    moves = moves.select(F.col("rep").alias("component"), F.col("component").alias("to"))
    return rows.join(moves, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    importable(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    signed = cut_lineage(rows.mapInArrow(_signatures, "doc_id long, n long, set_id long"))
    classes = signed.filter("n > 0").groupBy("set_id", "n").agg(F.min("doc_id").alias("rep"))

    dealt = rows.mapInArrow(_deal(parts), "fragment int, sets binary, owners binary, tokens binary").repartitionById(parts, "fragment")
    counted = cut_lineage(dealt.mapInArrow(_count_shared, "id long, n long"))
    shared = counted.filter("n > 0").groupBy(F.col("id").alias("set_id")).agg(F.sum("n").alias("shared"))
    possible = classes.join(shared, "set_id").filter("rep IS NOT NULL AND shared >= least(n, n DIV 4 + 1 + n DIV 8) - n DIV 4")
    heavy = [r["id"] for r in counted.filter("n < 0").orderBy("n", "id").limit(HEAVY).select("id").collect()]

    texts = rows.join(possible.select(F.col("rep").alias("doc_id"), F.col("set_id")), "doc_id")
    whole = texts.select("doc_id", "text").mapInArrow(_cut_sets(np.array(heavy, np.uint32)), _SET_SCHEMA)
    sets = cut_lineage(whole.dropDuplicates(["rep", "fragment"]))
    posted = sets.filter("fragment = 0").select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    shared_tokens = posted.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("token")
    open_ = cut_lineage(posted.join(shared_tokens, "token", "left_semi").withColumn("component", F.col("rep")))

    maps = sets.filter("fragment = 0").select("rep", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)])

    # Links of a turn join components, so they are followed as one edge per pair of components, links of earlier
    # turns not again. A shingle whose classes are in one component stays so: a turn looks at the open ones only.
    # Leaders only save pairs of the last turn, which is exact, so it follows at once when a turn finds no link.
    moves, turn = [], 0
    while turn <= STARS:
        if turn < STARS:
            # One leader for all shingles finds large groups at once; then every shingle has its own.
            draw = F.xxhash64("rep", F.lit(turn)) if turn == 0 else F.xxhash64("rep", "token", F.lit(turn))
            first = F.min_by(F.struct("rep", "n", "pos", "component"), draw)
            one = open_.groupBy("token").agg(first.alias("l")).select("token", F.col("l.rep").alias("other"), F.col("l.n").alias("m"), F.col("l.pos").alias("at"), F.col("l.component").alias("c"))
            near = open_.join(one, "token").filter("rep != other AND component != c")
        else:
            most = open_.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
            open_ = open_.join(maps.drop("n"), "rep")
            few = open_.join(most, "token").filter("component != largest")
            few = few.select("token", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("c"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(PARITY)])
            near = open_.join(few, "token").filter(f"component != c AND 7 * ({_DIFFER}) <= n + m")
        ends = F.expr("IF(rep < other, struct(rep AS a, other AS b, component AS of_a, c AS of_b), struct(other AS a, rep AS b, c AS of_a, component AS of_b))")
        pairs = near.filter(_ROOM).select(ends.alias("e")).select("e.*").distinct()
        links = _linked(cut_lineage(pairs if turn == STARS else _may_link(pairs, maps)), sets)
        found = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        if found is None:
            turn = max(turn + 1, STARS)
            continue
        moves.append(found)
        turn += 1
        if turn <= STARS:
            now = _moved(open_, found)
            spread = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
            open_ = cut_lineage(now.join(spread, "token", "left_semi"))
            if open_.isEmpty():
                break
    of_class = functools.reduce(_moved, moves, classes.withColumnRenamed("rep", "component")).withColumnRenamed("component", "component_id")
    out = signed.join(of_class, ["set_id", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN n = 0 THEN doc_id ELSE component_id END").alias("component_id"))
