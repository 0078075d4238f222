"""Document fingerprints by a randomised edit embedding.

The walk: with random functions shared by all documents, step j writes a symbol that depends on j and on
the character under the pointer, and then moves the pointer by one or not, also by j and that character.
Two texts at a small edit distance write strings at a small Hamming distance, because walks that part
after an edit soon meet again. To be independent of what stands before an edit and to bound the work, a text
is cut into chunks where its content says so (at most `LONGEST` characters apart) and every chunk is
walked by itself, to its last character and from there anew. Sample k of a fingerprint takes the chunk
whose opening characters hash lowest for k, and of that chunk's string the symbol at a step that k and the
opening draw from the k-th of `SAMPLES` stretches of the whole walk: so every character can be read, and a fingerprint has `SAMPLES` hexadecimal digits
whatever the text's length, equal texts have equal ones, and the share of equal digits, less the 1/16 that
chance gives, is the likeness of two texts.

Near duplicates: bands of sampled digits name buckets, every member is paired with its bucket's first
document only, and pairs are verified by edit distance.

Null text is empty; an empty text has zeros only. A null doc_id comes last in descending order; rows equal in
doc_id and text stand next to each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.common import importable, mix, sampled_cuts

SAMPLES = 64
#: One place in this many ends a chunk, and no chunk is longer than LONGEST.
CHUNK, LONGEST = 128, 1024
#: Steps of a walk, by half octaves, so a small edit seldom changes them. A walk over n characters takes 2n
#: steps on average, with a deviation of sqrt(2n): six deviations more bring it to the end.
_REACHES = np.unique(np.round(2.0 ** (np.arange(8, 2 * 12) / 2))).astype(np.int64)
#: Characters that decide on a cut, and that name a chunk.
LOOK, OPENING = 6, 8
#: Code points handled at once, about.
_SLICE = 2_000_000

_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = mix(np.arange(_REACHES[-1], dtype=np.uint64) + np.uint64(0xC0FFEE)) | np.uint64(1)


def _window(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` characters that end at each place."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(min(size, len(codes))):
        out[j:] += codes[: len(codes) - j] * np.uint64(2 * 0x51ED270B * j + 0x9E3779B1)
    return mix(out)


def _chunks(codes: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Starts of all chunks; a document's first character always starts one."""
    cut = np.flatnonzero(_window(codes, LOOK) % np.uint64(CHUNK) == 0) + 1
    # A cut is decided by characters of its own document only.
    doc = np.searchsorted(o, cut, side="right") - 1
    cut = cut[(cut - o[doc] >= LOOK) & (cut < o[-1])]
    starts = np.union1d(o[:-1][o[:-1] < o[1:]], cut)
    size = np.diff(np.append(starts, o[-1]))
    parts = (size + LONGEST - 1) // LONGEST
    at = np.cumsum(parts) - parts
    return np.repeat(starts, parts) + (np.arange(int(parts.sum())) - np.repeat(at, parts)) * LONGEST


def _reach(size: np.ndarray) -> np.ndarray:
    """Steps of the walks over chunks of some sizes."""
    return _REACHES[np.searchsorted(_REACHES, 2 * size + 6 * np.sqrt(2 * size))]


def _walks(codes: np.ndarray, starts: np.ndarray, size: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings that the walks over some chunks write, as hexadecimal digits: all digits of a step stand
    together, in the order of the chunks, which come by descending `reach`; and where each step begins."""
    at = np.zeros(len(starts), np.int64)
    active = np.searchsorted(-reach, -np.arange(int(reach[0])), side="left")
    begins = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(begins[-1]), np.uint8)
    for j, n in enumerate(active.tolist()):
        here = at[:n]
        seen = (codes[starts[:n] + here] + np.uint64(j)) * _STEP[j]
        out[begins[j] : begins[j + 1]] = seen >> np.uint64(60)
        here += ((seen >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        here[here == size[:n]] = 0
    return out, begins


def _slice_digits(codes: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of digits; `codes` hold all texts, `o` their bounds."""
    digits = np.zeros((len(o) - 1, SAMPLES), np.uint8)
    full = np.flatnonzero(o[:-1] < o[1:])
    if not len(full):
        return digits
    codes = mix(codes.astype(np.uint64) + np.uint64(1))
    starts = _chunks(codes, o)
    size = np.diff(np.append(starts, o[-1]))
    name = _window(codes, OPENING)[np.minimum(starts + OPENING, starts + size) - 1] + np.minimum(size, OPENING).astype(np.uint64)
    # A short chunk's window reaches back over its start: hash its own characters instead.
    for i in np.flatnonzero(size < OPENING):
        name[i] = mix(np.array([codes[starts[i] : starts[i] + size[i]].sum(dtype=np.uint64) + np.uint64(size[i])]))[0]
    first = np.searchsorted(starts, o[:-1][full])
    count = np.diff(np.append(first, len(starts)))
    chosen = np.empty((len(full), SAMPLES), np.int64)
    for k in range(SAMPLES):
        rank = mix(name ^ _SEEDS[k])
        low = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, first), count))
        chosen[:, k] = low[np.searchsorted(low, first)]
    used, index = np.unique(chosen, return_inverse=True)
    by_reach = np.argsort(-_reach(size[used]), kind="stable")
    used, index = used[by_reach], np.argsort(by_reach)[index.reshape(chosen.shape)]
    reach = _reach(size[used])
    # Twenty drawn bits say where in its stretch of the walk a sample is.
    drawn = (mix((name[chosen] ^ _SEEDS) + np.uint64(1)) >> np.uint64(44)).astype(np.int64)
    step = (((np.arange(SAMPLES) << 20) + drawn) * reach[index] >> 20) // SAMPLES
    walked = np.empty((len(full), SAMPLES), np.uint8)
    for lo in range(0, len(used), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        written, begins = _walks(codes, starts[used[part]], size[used[part]], reach[part])
        here = (index >= lo) & (index < lo + (1 << 15))
        walked[here] = written[begins[step[here]] + index[here] - lo]
    digits[full] = walked
    return digits


def digits_of(texts: list[str]) -> np.ndarray:
    """One row of SAMPLES digits per text."""
    out, lo, sizes = [np.zeros((0, SAMPLES), np.uint8)], 0, np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SLICE, side="right")))
        codes = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(_slice_digits(codes, np.concatenate([[0], np.cumsum(sizes[lo:hi])])))
        lo = hi
    return np.concatenate(out)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_hex(digits: np.ndarray) -> list[str]:
    return [x.tobytes().decode() for x in _HEX[digits]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: equal digits beyond chance."""
    return np.maximum(0, ((a == b).mean(axis=1) - 1 / 16) / (15 / 16))


@F.arrow_udf(T.StringType())
def _fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(as_hex(digits_of(["" if x is None else x for x in text.to_pylist()])), pa.string())


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` and their `fingerprint`."""
    importable(docs.sparkSession)
    return docs.withColumn("fingerprint", _fingerprint("text"))


def near_duplicates(docs: DataFrame, bands: int = 16, share: float = 0.1) -> DataFrame:
    """(doc_id, first_id, distance) of documents whose text is within an edit distance of `share` of the
    longer one's length from the first document of a bucket they meet in."""
    width = SAMPLES // bands
    rows = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).filter("text != ''")
    banded = rows.select("doc_id", F.expr(f"posexplode(transform(sequence(0, {bands - 1}), b -> substring(fingerprint, b * {width} + 1, {width}))) AS (band, value)"))
    first = banded.groupBy("band", "value").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id")
    pairs = banded.join(first, ["band", "value"]).filter("doc_id > first_id").select("doc_id", "first_id").distinct()
    left = docs.select("doc_id", F.col("text").alias("a"))
    right = docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("b"))
    most = f"CAST(greatest(char_length(a), char_length(b)) * {share} AS INT)"
    close = pairs.join(left, "doc_id").join(right, "first_id").filter(f"abs(char_length(a) - char_length(b)) <= {most}")
    return close.select("doc_id", "first_id", F.expr(f"CAST(levenshtein(a, b, {most}) AS BIGINT) AS distance")).filter("distance >= 0")


# --- each document beside its edited text and the next document ----------------------------------

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by the first as many characters of `following`."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compared(names: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which is only the next of the one before."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = digits_of(texts), digits_of(changed)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(names[:-1], pa.int64()), "n_chars": pa.array([len(x) for x in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
        "fingerprint": pa.array(as_hex(own[:-1]), pa.string()), "edited_fingerprint": pa.array(as_hex(other), pa.string()),
        "near_edited": pa.array(likeness(own[:-1], other), pa.float64()), "near_next": pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    })


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness to it and to the next.

    The next document is the one before in ascending (doc_id, text hash); after the last comes the first. The table is dealt out in
    stretches of descending doc_id, and each stretch also gets the first document of the following one.
    """
    spark = docs.sparkSession
    importable(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    cuts = np.array(sampled_cuts(rows.select(F.col("doc_id").alias("key"), F.length("text").alias("weight")).filter("doc_id IS NOT NULL"), tasks), np.int64)

    @F.arrow_udf(T.IntegerType())
    def stretch(doc_id: pa.Array) -> pa.Array:
        values = doc_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(len(cuts) - np.searchsorted(cuts, values, side="right"), pa.int32())

    placed = rows.withColumn("stretch", stretch("doc_id"))
    # A row per stretch: its first document, for the stretch before it.
    order = F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", "tie")
    firsts = [tuple(r) for r in placed.select("doc_id", "tie", "stretch").groupBy("stretch").agg(F.max(order).alias("f")).select("stretch", "f.doc_id", "f.tie").orderBy("stretch").collect()]
    targets = [(doc, tie, firsts[i - 1][0]) for i, (_, doc, tie) in enumerate(firsts)]
    given = spark.createDataFrame(targets, "doc_id long, tie long, stretch int")
    # The filter on ids reaches the scan; the join is exact.
    some = rows.filter(F.col("doc_id").isin([t[0] for t in targets if t[0] is not None]) | F.col("doc_id").isNull())
    ahead = some.join(F.broadcast(given.withColumnRenamed("doc_id", "d").withColumnRenamed("tie", "t")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    both = placed.select("doc_id", "text", "tie", "stretch", F.lit(0).alias("ahead")).unionByName(
        ahead.select("doc_id", "text", "tie", "stretch", F.lit(1).alias("ahead"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        texts: list[str] = []
        held = 0
        over = False
        for batch in batches:
            for name, text, late in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ahead").to_pylist(), strict=True):
                if over:
                    continue
                names.append(name)
                texts.append(text)
                held += len(text)
                over = bool(late)
                if held >= _SLICE and len(texts) > 1:
                    yield _compared(names, texts)
                    names, texts, held = names[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield _compared(names, texts)

    dealt = both.repartitionById(max(1, tasks), "stretch").sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("doc_id", "text", "ahead").mapInArrow(run, _SCHEMA)
