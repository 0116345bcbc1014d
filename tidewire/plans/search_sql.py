"""SQL of the searches."""

from __future__ import annotations

from tidewire.adapters import NEWS_SQL
from tidewire.plans.ranking_sql import W, hours
from tidewire.plans.reports_sql import _q


def cosine(a: str, b: str) -> str:
    return f"({_q(f'list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])', 4)})"


def search_sql() -> dict[str, str]:
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
    match = "CASE WHEN lower(title) = 'the and' THEN 4 WHEN starts_with(lower(title), 'the and') THEN 3 WHEN contains(lower(title), 'the and') THEN 2 WHEN contains(lower(description), 'the and') THEN 1 ELSE 0 END"
    n = f"""n AS {NEWS_SQL}, w AS (SELECT *, {words('title')} AS tw, {words('description')} AS dw, {match}::INTEGER AS match FROM n),
      u AS (SELECT id, len(tw) AS n_title, unnest(range(len(tw) + len(dw))) AS pos, unnest(list_concat(tw, dw)) AS term FROM w), h AS (SELECT *, CASE WHEN pos < n_title THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS x FROM u WHERE term IN ('the', 'and')),
      l AS (SELECT *, lag(term) OVER o AS t0, lag(pos) OVER o AS p0, lag(x) OVER o AS x0 FROM h WINDOW o AS (PARTITION BY id ORDER BY pos)),
      r AS (SELECT id, {_q("sum(2 / (1 / x + 1 / x0) / (pos - p0))")} AS rank FROM l WHERE term <> t0 GROUP BY 1), t AS (SELECT w.*, rank FROM w LEFT JOIN r USING (id))"""
    q = "q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
    v = "v AS (SELECT n.*, embedding AS e FROM n JOIN embeddings ON vec_id = id)"
    c = """p AS (SELECT cluster_id, created_at, unnest(range(len(e)))::INTEGER AS i, unnest(e)::DOUBLE AS x FROM v), m AS (SELECT cluster_id, i, avg(x) AS x, max(created_at) AS newest FROM p WHERE NOT isnan(x) GROUP BY 1, 2),
      c AS (SELECT cluster_id, list(x ORDER BY i) AS c, max(newest) AS newest FROM m GROUP BY 1)"""
    return {
        "word_search": f"WITH {n} SELECT id, match, rank, {_q('2 * match + rank')} AS total FROM t WHERE rank IS NOT NULL ORDER BY {_q('2 * match + rank')} DESC, created_at DESC, id LIMIT 50",
        "article_search": f"""WITH {n}, {q}, s AS (SELECT t.id, t.created_at, match, rank, CASE WHEN embedding IS NOT NULL THEN {cosine("embedding", "q")} END AS near FROM t LEFT JOIN embeddings ON vec_id = id, q),
          x AS (SELECT *, {_q("2 * match + coalesce(rank, 0::DOUBLE) + 5 * coalesce(near, 0::DOUBLE)")} AS total FROM s WHERE rank IS NOT NULL OR 1 - near < 0.6::DOUBLE) SELECT id, match, total FROM x ORDER BY total DESC, created_at DESC, id LIMIT 50""",
        "hybrid_search": f"""WITH {n}, {q}, {v}, f AS (SELECT id, rank FROM t WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 300),
          s AS (SELECT id, {cosine("e", "q")} AS near FROM v, q WHERE {hours("created_at")} <= 720 ORDER BY near DESC, id LIMIT 300),
          b AS (SELECT n.id, cluster_id, created_at, {_q("0.45::DOUBLE * coalesce(rank, 0::DOUBLE) + 0.55::DOUBLE * coalesce(near, 0::DOUBLE)")} AS base FROM n LEFT JOIN f USING (id) LEFT JOIN s USING (id) WHERE rank IS NOT NULL OR near > 0.1::DOUBLE),
          o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY base DESC, id) = 1)
          SELECT id, cluster_id, base, {_q(f"base * greatest(0.1::DOUBLE, 1 - {hours('created_at')} / 168)")} AS hybrid FROM o ORDER BY hybrid DESC, id LIMIT 20""",
        "semantic_search": f"""WITH n AS {NEWS_SQL}, {q}, {v}, s AS (SELECT v.*, {W} AS weight, {cosine("e", "q")} AS near FROM v, q WHERE {hours("created_at")} <= 168 ORDER BY near DESC, id LIMIT 50)
          SELECT cluster_id, count(*) AS n, arg_max(near, (weight, created_at, -id)) AS lead_near FROM s GROUP BY 1""",
        "related_stories": f"""WITH n AS {NEWS_SQL}, {v}, {c}, o AS (SELECT c AS q FROM c WHERE cluster_id = 's3'), s AS (SELECT cluster_id, {cosine("c", "q")} AS near FROM c, o WHERE cluster_id <> 's3' AND {hours("newest")} <= 336)
          SELECT * FROM s WHERE near > 0 ORDER BY near DESC, cluster_id LIMIT 15""",
        "earlier_stories": f"""WITH n AS {NEWS_SQL}, {v}, {c}, o AS (SELECT c AS q FROM c WHERE cluster_id = 's3'), s AS (SELECT cluster_id, id, created_at, {cosine("e", "q")} AS near FROM v, o WHERE cluster_id <> 's3' AND {hours("created_at")} > 48),
          b AS (SELECT * FROM s WHERE near > 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY near DESC, created_at DESC, id) = 1) SELECT cluster_id, id, near FROM b ORDER BY near DESC, cluster_id LIMIT 5""",
        "for_reader": f"""WITH n AS {NEWS_SQL}, {v}, {c}, s AS (SELECT * FROM c WHERE cluster_id IN (SELECT cluster_id FROM n WHERE topic = 'sport') ORDER BY newest DESC, cluster_id LIMIT 10),
          u AS (SELECT unnest(range(len(c)))::INTEGER AS i, unnest(c) AS x FROM s), g AS (SELECT list(x ORDER BY i) AS q FROM (SELECT i, avg(x) AS x FROM u GROUP BY 1))
          SELECT cluster_id, {cosine("c", "q")} AS near FROM c, g WHERE {hours("newest")} <= 240 AND cluster_id NOT IN (SELECT cluster_id FROM s) ORDER BY near DESC, cluster_id LIMIT 10""",
        "global_stories": f"""WITH n AS {NEWS_SQL}, {v}, h AS (SELECT id AS h, e AS q FROM v ORDER BY created_at DESC, id LIMIT 50), b AS (SELECT id, max({cosine("e", "q")}) AS nearest FROM v JOIN h ON id <> h GROUP BY 1) SELECT *, nearest > 0.82::DOUBLE AS "global" FROM b""",
    }


