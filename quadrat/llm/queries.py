"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quadrat.llm import licenses
from quadrat.llm.licenses import op4_license_scan
from quadrat.llm.mixing import op2_mixing
from quadrat.llm.neighbours import op3_neighbours
from quadrat.llm.ngram_join import op7_ngram_join
from quadrat.llm.packing import op8_packing
from quadrat.llm.quality_classifier import op10_quality_classifier
from quadrat.llm.quality_rules import op1_quality_rules
from quadrat.llm.sharding import op6_sharding
from quadrat.llm.suffix_dedup import op5_suffix_dedup
from quadrat.llm.warc import op9_warc_derivatives

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_neighbours": op3_neighbours,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
      + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT
      + 32 * (100 * n_exclamations > 60 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b""",
    "op4_license_scan": licenses.oracle(),
}
