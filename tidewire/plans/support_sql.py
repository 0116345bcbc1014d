"""SQL of the support of claims."""

from __future__ import annotations

from tidewire.adapters import NEWS_SQL
from tidewire.plans.ranking_sql import W


def support_sql() -> dict[str, str]:
    bare = lambda x: rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    sentences = lambda x: rf"string_split(regexp_replace({bare(x)}, '([.!?…]) ', '\1{chr(0xE000)}', 'g'), '{chr(0xE000)}')"
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return {
        "faithfulness": f"""WITH n AS {NEWS_SQL}, r AS (SELECT cluster_id AS story, id, title, description AS body, row_number() OVER (PARTITION BY cluster_id ORDER BY {W} DESC, created_at DESC, id) AS rank FROM n),
          c0 AS (SELECT story, {sentences("body")} AS l FROM r WHERE rank = 1), c1 AS (SELECT story, unnest(range(len(l))) AS i, unnest(l) AS text FROM c0),
          c AS (SELECT story, row_number() OVER (PARTITION BY story ORDER BY i) AS claim, text FROM c1 WHERE length(text) >= 20 QUALIFY claim <= 12),
          s0 AS (SELECT story, list_filter({sentences("body")}, lambda x: length(x) > 20) AS l FROM r WHERE rank > 1), s1 AS (SELECT story, l, unnest(range(1, len(l) + 1, 3)) AS k FROM s0),
          s AS (SELECT DISTINCT story, text FROM (SELECT story, {bare("title")} AS text FROM r WHERE rank > 1 AND {bare("title")} <> '' UNION ALL SELECT story, text FROM (SELECT story, array_to_string(l[k:k + 2], ' ') AS text FROM s1) WHERE length(text) > 40)),
          cw AS (SELECT story, claim, word, count(*) AS n FROM (SELECT story, claim, unnest({words}) AS word FROM c) GROUP BY ALL), sw AS (SELECT story, text, word, count(*) AS m FROM (SELECT story, text, unnest({words}) AS word FROM s) GROUP BY ALL),
          cn AS (SELECT story, claim, sum(n * n)::BIGINT AS a FROM cw GROUP BY 1, 2), sn AS (SELECT story, text, sum(m * m)::BIGINT AS b FROM sw GROUP BY 1, 2),
          d AS (SELECT story, claim, text, sum(n * m)::BIGINT AS dot FROM cw JOIN sw USING (story, word) GROUP BY 1, 2, 3),
          b AS (SELECT story, claim, max(dot / sqrt((a * b)::DOUBLE)) AS support FROM d JOIN cn USING (story, claim) JOIN sn USING (story, text) GROUP BY 1, 2),
          e AS (SELECT story FROM s GROUP BY 1 HAVING count(*) >= 2)
          SELECT story, count(*) AS claims, count(*) FILTER (coalesce(support, 0) >= 0.33::DOUBLE) AS supported,
            floor(count(*) FILTER (coalesce(support, 0) >= 0.33::DOUBLE) / count(*)::DOUBLE * 1000 + 0.5::DOUBLE) / 1000 AS share FROM c LEFT JOIN b USING (story, claim) WHERE story IN (SELECT story FROM e) GROUP BY 1""",
    }
