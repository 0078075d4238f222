"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that hold a word, each trimmed and hashed. From every line a
run starts: it ends with the line that brings it to `run` lines or to `words` words, whichever comes
first, so one line of `words` words is a run by itself. The smallest line hash of a run (rightmost of
equals) is its fingerprint. A run's end follows from its lines alone, so equal passages choose the same
runs and fingerprints wherever they stand, and no repeat of `run` lines or of `words` words in whole
lines can be missed. Fingerprints that occur in one place only are dropped; around the others the match
is extended to both sides, as the runs that chose the fingerprint. Of each such run the first place (by
doc_id, then line) stays and every later place is deleted, lines without a word in between included.
Runs that overlap make up longer ones, so a repeated passage goes as a whole, up to its last line.

Each run has one first place, so copies are compared with that place only, never with each other;
counts and first places are combined before the shuffle, which keeps hot lines small.

Null text stays null and counts as no lines; a null doc_id sorts first; rows equal in doc_id and text
are one document and get the same result; other columns are passed through, whatever their names, but
for `n_lines` and `n_deleted`, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import let, with_row_key
from usagelens.session import cut_lineage

#: A repeat goes when it has this many lines, or lines of this many words together; shorter repeats stay.
RUN = 3
WORDS = 50

_SPACES = "[\\\\x20\\\\x09-\\\\x0D]"
_TRIMMED = "trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM x)"
_HASHED = (
    "filter(transform(split(coalesce(text, ''), '\\n'), (x, i) -> "
    f"named_struct('i', i, 'h', IF(x RLIKE '{_SPACES.replace('[', '[^')}', xxhash64({_TRIMMED}), CAST(NULL AS BIGINT)), 'w', size(split({_TRIMMED}, '{_SPACES}+')))), e -> e.h IS NOT NULL)"
)


def line_runs(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """One row per run of lines: its place, its hash, and the fingerprint it chose.

    `chosen` is 1 for the first run of a document that chose the fingerprint's place, so its sum
    counts places. The end of a run never falls as its start moves on, so the runs that chose one
    place are neighbours.
    """
    # Lines of the run that starts at line s; null where the document ends before.
    together = [" + ".join(f"get(l, s + {i}).w" for i in range(j)) for j in range(1, run)]
    size = "CASE " + " ".join(f"WHEN {w} >= {words} THEN {j}" for j, w in enumerate(together, 1)) + f" WHEN s + {run} <= size(l) THEN {run} END"
    key = "CASE k " + " ".join(f"WHEN {j} THEN xxhash64({', '.join(f'get(l, s + {i}).h' for i in range(j))})" for j in range(1, run + 1)) + " END"
    # Smallest hash, rightmost of equals: the place is carried negated.
    mark = "array_min(transform(slice(l, s + 1, k), (e, j) -> named_struct('h', e.h, 'back', -(s + j))))"
    one = let(size, "k", f"IF(k IS NULL, NULL, named_struct('first', l[s].i, 'last', get(l, s + k - 1).i, 'run', {key}, 'mark', {mark}))")
    runs = let(_HASHED, "l", f"filter(transform(l, (line, s) -> {one}), x -> x IS NOT NULL)")
    place = "transform(r, (e, i) -> named_struct('first', e.first, 'last', e.last, 'run', e.run, 'mark', e.mark.h, 'chosen', IF(i > 0 AND r[greatest(i - 1, 0)].mark.back = e.mark.back, 0, 1)))"
    rows = with_row_key(docs.select("doc_id", "text"))
    return rows.select("doc_id", "__key", F.expr(f"explode({let(runs, 'r', place)}) AS r")).select("doc_id", "__key", "r.*")


def repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(__key, gone): per document with repeats, the numbers of the lines to delete."""
    runs = cut_lineage(line_runs(docs, run, words))
    marks = runs.groupBy("mark").agg(F.sum("chosen").alias("n")).filter("n > 1").select("mark")
    matched = runs.join(marks, "mark", "left_semi")
    place = F.struct("doc_id", "__key", "first")
    first = matched.groupBy("run").agg(F.min(place).alias("origin"), F.max(place).alias("end")).filter("origin < end")
    later = matched.join(first.select("run", "origin"), "run").filter(place > F.col("origin"))
    spans = F.collect_set(F.struct("first", "last")).alias("spans")
    return later.groupBy("__key").agg(spans).select("__key", F.expr("array_distinct(flatten(transform(spans, x -> sequence(x.first, x.last)))) AS gone"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """All rows and columns of `docs`, `text` without the later repeats, plus n_lines and n_deleted."""
    gone = repeated_lines(docs, run, words)
    # The row travels as one struct, so no column of it can clash with those of the join.
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows = with_row_key(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")))
    joined = rows.join(gone, "__key", "left")
    lines = let("split(text, '\\n')", "l", "array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n')")
    kept = [F.col("row").getField(c).alias(c) if c != "text" else F.expr(f"CASE WHEN gone IS NULL THEN text ELSE {lines} END").alias("text") for c in columns]
    counts = [F.expr("CAST(size(split(coalesce(text, ''), '\\n')) AS BIGINT)").alias("n_lines"), F.expr("CAST(coalesce(size(gone), 0) AS BIGINT)").alias("n_deleted")]
    return joined.select(*kept, *counts)
