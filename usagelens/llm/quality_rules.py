"""Quality rules as a short-circuit cascade.

Every rule is a Spark condition over measures of a text. On a bounded sample each rule's running
time and rejection rate are measured; the rules are then tried in the order of rejections per second,
and a text that one rule rejects is not looked at by the later ones. The order decides the cost only:
a text is kept if no rule rejects it, so the result is the same for any order.

Null text counts as empty (and is rejected for having no words); doc_id may be null or repeated;
other columns are passed through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import SPACE, let

#: Rows that cost and selectivity are measured on; the decision itself covers every row.
SAMPLE_ROWS = 2_000

_TEXT = "coalesce({text}, '')"
_WORDS = f"filter(split({_TEXT}, '{SPACE}+'), x -> x != '')"
_LINES = f"filter(split({_TEXT}, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"

#: Sorted (window hash, position) pairs; those next to an equal hash are found twice or more; the words
#: they cover are counted from the distances between them.
_COVERED = let(
    "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))",
    "s",
    let(
        "array_sort(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].h = s[j].h) "
        "OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = s[j].h)), j -> s[j].i))",
        "p",
        "aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + IF(k = size(p) - 1, 5, least(5, p[least(k + 1, size(p) - 1)] - p[k])))",
    ),
)
_REPEATED = (
    "CASE WHEN size(__w) < 6 THEN 0L ELSE "
    + let(
        let("transform(__w, x -> xxhash64(x))", "v", "transform(sequence(0, size(v) - 5), i -> xxhash64(v[i], v[i + 1], v[i + 2], v[i + 3], v[i + 4]))"),
        "h",
        f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {_COVERED} END",
    )
    + " END"
)

#: Over the text and its words `__w`, which are split once.
MEASURES = {
    "n_words": "CAST(size(__w) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join(__w, '')) AS BIGINT)",
    "n_symbols": f"CAST(size(regexp_extract_all({_TEXT}, '[#*$%&|<>]', 0)) AS BIGINT)",
    "n_dup_lines": "CAST(" + let(_LINES, "l", "size(l) - size(array_distinct(l))") + " AS BIGINT)",
    "n_lines": f"CAST(size({_LINES}) AS BIGINT)",
    "n_capitals": f"CAST(size(regexp_extract_all({_TEXT}, '[A-Z]', 0)) AS BIGINT)",
    "n_repeat_words": _REPEATED,
}

#: rule -> condition over the measures that rejects a text. The first two are the base rules.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_windows")


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__w", F.expr(_WORDS.replace("{text}", text)))


def _condition(rule: str, text: str) -> str:
    """SQL: the rule with its measures written in, so a skipped rule computes none of them."""
    sql = RULES[rule]
    for name, body in MEASURES.items():
        if name in sql:
            sql = sql.replace(name, f"({body.replace('{text}', text)})")
    return sql


def _first_rejection(order: list[str], condition) -> str:
    """SQL: name of the first rule in `order` that rejects, null if none does."""
    return "CASE " + " ".join(f"WHEN {condition(rule)} THEN '{rule}'" for rule in order) + " END"


def rule_order(docs: DataFrame, rules=tuple(RULES), text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost in seconds and share rejected of each rule on a sample, best rejection per cost first."""
    sample = docs.select(text).sample(0.5, seed=7).limit(sample_rows).persist()
    try:
        rows = max(1, sample.count())
        found = []
        for rule in rules:
            began = time.perf_counter()
            hits = _with_words(sample, text).agg(F.count_if(F.expr(_condition(rule, text)))).first()[0]
            found.append({"rule": rule, "seconds": time.perf_counter() - began, "rejected": hits / rows})
    finally:
        sample.unpersist()
    return sorted(found, key=lambda r: (-r["rejected"] / r["seconds"], r["rule"]))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, all columns as they were."""
    order = [r["rule"] for r in rule_order(docs, text=text)]
    rejected = let(_WORDS.replace("{text}", text), "__w", _first_rejection(order, lambda rule: _condition(rule, text)))
    return docs.filter(F.expr(rejected).isNull())


def measure_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: the measures, base_failed, and kept by the whole cascade.

    The measures are wanted for every row here, so the cascade runs over their columns.
    """
    order = [r["rule"] for r in rule_order(docs, text=text)]
    measures = [F.expr(body.replace("{text}", text)).alias(name) for name, body in MEASURES.items()]
    wide = _with_words(docs.select("doc_id", text), text).select("doc_id", *measures)
    base = F.expr(" OR ".join(RULES[r] for r in BASE))
    return wide.select("doc_id", *MEASURES, base.alias("base_failed"), F.expr(_first_rejection(order, RULES.get)).isNull().alias("kept"))
