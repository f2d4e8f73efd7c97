"""SQL that the queries are checked against, where SQL can express them."""

from __future__ import annotations

from runlens.llm.line_dedup import MIN_WORDS, NEAR_WORDS
from runlens.llm.queries import BLOCKED, RULES, TOP

_HOSTED = """
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages"""


def _entries(rules) -> str:
    return ", ".join("('{}', '{}', '/{}', '{}')".format(
        rule, *rule.split("/", 1), verdict) for rule, verdict in rules)


def _fits(name: str) -> str:
    return (f"(p.host = {name}.host OR ends_with(p.host, '.' || {name}.host)) "
            f"AND starts_with(p.path, {name}.path)")


ORACLES = {
    "op6_top_k": f"""
    WITH units AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM units q JOIN units c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
      FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}""",
    "op8_line_dedup": rf"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
      FROM documents),
    worded AS (
      SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines),
    firsts AS (
      SELECT words, min(doc_id * 1000000000 + no) AS place FROM worded
      WHERE len(words) >= {MIN_WORDS} GROUP BY words),
    variants AS (
      SELECT words, place, unnest(range(1, len(words) + 1)) AS gap FROM firsts
      WHERE len(words) >= {NEAR_WORDS}),
    less AS (
      SELECT words, place, gap, words[:gap - 1] || words[gap + 1:] AS variant FROM variants),
    near AS (
      SELECT a.words FROM less a JOIN less b ON a.variant = b.variant AND a.gap = b.gap
      WHERE b.place < a.place
      UNION SELECT a.words FROM less a JOIN firsts b ON a.variant = b.words
      WHERE b.place < a.place AND len(b.words) >= {NEAR_WORDS}
      UNION SELECT a.words FROM firsts a JOIN less b ON a.words = b.variant
      WHERE b.place < a.place AND len(a.words) >= {NEAR_WORDS}),
    marked AS (
      SELECT doc_id, no, line, len(words) >= {MIN_WORDS} AND (
               doc_id * 1000000000 + no > (SELECT place FROM firsts f WHERE f.words = w.words)
               OR EXISTS (SELECT 1 FROM near WHERE near.words = w.words)) AS gone
      FROM worded w)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY no)
                           FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
    "op9_url_filter": f"""
    WITH p AS ({_HOSTED}),
    rules(rule, host, path, verdict) AS (VALUES {_entries(RULES.items())}),
    listed(rule, host, path, verdict) AS (VALUES {_entries((x, "block") for x in BLOCKED)}),
    best AS (
      SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule,
             arg_max(r.verdict, length(r.rule)) AS verdict
      FROM p JOIN rules r ON {_fits("r")} GROUP BY page_id)
    SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN EXISTS (
             SELECT 1 FROM listed l WHERE {_fits("l")}) THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN best USING (page_id)""",
    "op11_hard_negatives": """
    WITH units AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             list_dot_product(a.v, c.v)::BIGINT AS score
      FROM units a JOIN units c ON a.vec_id != c.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    ranked AS (
      SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                                ORDER BY s.score DESC, s.other_id)::INT AS rank
      FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    FROM ranked WHERE rank <= 10""",
}
