"""The operators of this folder as queries over whole tables, with their DuckDB SQL."""

from __future__ import annotations

from usagelens.llm import bpe, fingerprints, language_model, lexical_search, line_dedup, ngram_join, packing, pieces, pii, quality_classifier, quality_rules, token_store, whitening

QUERIES: dict = {}
SQL: dict = {}


def _reg(name: str, operator, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    if sql:
        SQL[name] = sql


_WORD = r"[^\x20\x09-\x0D]"

LINE_DEDUP_SQL = r"""
lines AS (
  SELECT doc_id, text, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs})
), trimmed AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS h FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), worded AS (
  SELECT *, len(string_split_regex(h, '[\x20\x09-\x0D]+')) AS w FROM trimmed
), runs AS (
  SELECT doc_id, i, CASE WHEN w >= 50 THEN i WHEN w + lead(w) OVER o >= 50 THEN lead(i) OVER o ELSE lead(i, 2) OVER o END AS j,
         CASE WHEN w >= 50 THEN [h] WHEN w + lead(w) OVER o >= 50 THEN [h, lead(h) OVER o] ELSE [h, lead(h) OVER o, lead(h, 2) OVER o] END AS run
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS place FROM runs WHERE j IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM placed WHERE place > 1
), kept AS (
  SELECT l.doc_id, CASE WHEN any_value(l.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') END AS text,
         count(*) AS n_lines, count(g.i) AS n_deleted
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)"""

_reg(
    "op1_line_dedup",
    lambda docs: line_dedup.drop_repeated_lines(docs.select("doc_id", "text")),
    f"WITH {LINE_DEDUP_SQL.replace('{docs}', 'documents')} SELECT doc_id, text, n_lines, n_deleted FROM kept",
)

_reg("op2_pii", pii.personal_spans)

QUALITY_SQL = r"""
words AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM repeated, range(5) r(j) GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words)
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM (SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM measured m LEFT JOIN covered c USING (doc_id))
), judged AS (
  SELECT *, NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_capitals > 40 * word_chars OR 100 * n_dup_lines > 50 * n_lines
                 OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM based
)"""

_reg(
    "op4_quality_rules",
    quality_rules.measure_quality,
    f"WITH {QUALITY_SQL.replace('{docs}', 'documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_capitals, n_repeat_words, base_failed, kept FROM judged",
)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_reg("op3_packing", lambda docs: packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False))

_reg("op5_token_store", lambda docs: token_store.store_and_read(docs, tokenizer("word_bpe_49k.json")))

_reg("op8_fingerprints", fingerprints.compare_with_edits)

NGRAM_SQL = r"""
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs})
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS k FROM shingled
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM shingled UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), grouped AS (
  SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.other) AS component_id FROM shingled s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id
)"""

_reg("op7_ngram_join", ngram_join.similar_documents, f"WITH RECURSIVE {NGRAM_SQL.replace('{docs}', 'documents')} SELECT doc_id, n_shingles, component_id FROM grouped")

_reg("op10_language_model", language_model.score_documents)

QUERIES["op6_quality_classifier"] = lambda spark, sf_dir: quality_classifier.classify(
    spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
)

_reg("op9_pieces", lambda docs: pieces.encode_and_decode(docs, tokenizer("piece_bpe_32k.model")))

_reg("op13_bpe", lambda docs: bpe.round_trip(docs, tokenizer("word_bpe_49k.json")))

SEARCH_SQL = r"""
folded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM folded WHERE len(t) > 0
), tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM folded) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus
), scores AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(t) * docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN folded USING (r), corpus GROUP BY item_id, r
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores JOIN folded USING (r) WHERE score > 0
)"""

QUERIES["op12_lexical_search"] = lambda spark, sf_dir: lexical_search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
SQL["op12_lexical_search"] = f"WITH {SEARCH_SQL} SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"

QUERIES["op11_embedding_whitening"] = lambda spark, sf_dir: whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
