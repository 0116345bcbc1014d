"""SQL of the statistics."""

from __future__ import annotations

from tidewire.adapters import ARTICLES_SQL, AS_OF, NEWS_SQL
from tidewire.plans.ranking_sql import hours
from tidewire.plans.reports_sql import _q

NOW = f"TIMESTAMP '{AS_OF}'"


def statistics_sql(queries: dict[str, str]) -> dict[str, str]:
    """`queries` holds the SQL of title keys, languages and junk on which the gates rest."""
    a = ARTICLES_SQL
    back = lambda h: f"({NOW} - INTERVAL {h} HOUR)"
    axis = lambda x: f"SELECT '{x}' AS axis, {x}::VARCHAR AS value, sum(n)::BIGINT AS stories FROM p GROUP BY 2"
    keeps = f"CASE WHEN category = 'error' THEN {hours('created_at')} <= 600 ELSE {hours('created_at')} <= 480 END"
    orphans = lambda name, key: f"SELECT '{name}' AS \"table\", count(*) FILTER (held) AS kept, count(*) FILTER (NOT held) AS gone FROM (SELECT {key}, bool_or({keeps}) AS held FROM a GROUP BY 1)"
    newest = f"(SELECT * FROM {NEWS_SQL} ORDER BY created_at DESC, id DESC LIMIT 3000)"
    bonus = "CASE WHEN regexp_matches(w, '^\\p{Lu}') THEN 4::DOUBLE ELSE 1::DOUBLE END"
    number = "regexp_extract(source, '([0-9]+)$', 1)::INTEGER"
    week = lambda kind, a_: f"count(*) FILTER (category = '{kind}' AND created_at >= {back(168 * a_)} AND created_at < {back(168 * (a_ - 1))})"
    rate = lambda x, y: _q(f"100::DOUBLE * {x} / greatest({y}, 1)", 1)
    keys = queries["title_keys"].replace("documents", f"(SELECT id AS doc_id, title AS text FROM {NEWS_SQL})")
    language = "SELECT id, CASE WHEN c = 0 AND l = 0 THEN 'unk' WHEN l > c THEN CASE WHEN regexp_matches(low, '[čćđšž]') THEN 'hr' WHEN regexp_matches(low, '[ğşı]') THEN 'tr' WHEN regexp_matches(low, '[ëç]') THEN 'sq' ELSE 'en' END ELSE 'other' END AS language FROM (SELECT id, lower(title) AS low, len(regexp_extract_all(title, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(title, '[A-Za-z]')) AS l FROM " + NEWS_SQL + ")"
    return {
        "filtered_facets": f"""WITH a AS {a} (SELECT 'source' AS axis, source::VARCHAR AS value, count(*) AS n FROM a WHERE category = 'view' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12) UNION ALL
          (SELECT 'category', category, count(*) FROM a WHERE source = 3 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""",
        "checked_centroids": f"""WITH d AS (SELECT label, arg_min(len(embedding), vec_id) AS dims FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1), f AS (SELECT label, embedding FROM embeddings JOIN d USING (label) WHERE len(embedding) = dims AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
          p AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM f) SELECT label, i, {_q("avg(x)")} AS mean, count(*) AS n FROM p GROUP BY 1, 2""",
        "followers": f"SELECT category, count(DISTINCT source) AS followers FROM {a} GROUP BY 1",
        "stale_stories": f"""WITH a AS {a}, n AS (SELECT cluster_id, max(created_at) AS newest, max(created_at) FILTER (category = 'purchase') AS summary_at FROM a GROUP BY 1),
          s AS (SELECT * FROM n WHERE summary_at IS NULL OR newest > summary_at + INTERVAL 45 MINUTE)
          SELECT count(*) AS stale, floor(min({hours("newest")}) * 60)::BIGINT AS newest_age, array_to_string(list_sort(list(cluster_id))[1:8], ',') AS sample FROM s""",
        "navigation_axes": f"WITH p AS (SELECT category, source, count(DISTINCT cluster_id) AS n FROM {a} GROUP BY 1, 2) {axis('category')} UNION ALL {axis('source')}",
        "retention": f"""WITH a AS {a} SELECT CASE WHEN category = 'error' THEN 'errors' ELSE 'articles' END AS "table", count(*) FILTER ({keeps}) AS kept, count(*) FILTER (NOT ({keeps})) AS gone FROM a GROUP BY 1
          UNION ALL {orphans("stories", "cluster_id")} UNION ALL {orphans("sources", "source")}""",
        "mood_days": f"""WITH r AS (SELECT ts::DATE::VARCHAR AS day, event_type, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9.]+') THEN (try_cast(json_extract_string(props, '$.k') AS DOUBLE) - 50) / 50 END AS score,
            coalesce(CASE WHEN value < 100 THEN 1 - value / 100 END, 1::DOUBLE) AS o FROM events),
          c AS (SELECT day, arg_min(event_type, (-n, event_type)) AS tone FROM (SELECT day, event_type, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
          s AS (SELECT day, avg(score) AS m, avg(o) AS o, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (score > 0.9::DOUBLE)), ','), '') AS types FROM r GROUP BY 1)
          SELECT day, {_q("m", 4)} AS mean, CASE WHEN m >= 0.4::DOUBLE THEN 'very good' WHEN m >= 0.1::DOUBLE THEN 'good' WHEN m <= -0.4::DOUBLE THEN 'very bad' WHEN m <= -0.1::DOUBLE THEN 'bad' ELSE 'even' END AS label, {_q("o", 4)} AS objectivity, tone, types FROM s JOIN c USING (day)""",
        "fallback_reasons": f"SELECT CASE WHEN source < 20 THEN 'unknown' ELSE source::VARCHAR END AS reason, count(*) AS n FROM {a} WHERE category = 'error' AND created_at >= {back(168)} GROUP BY 1 ORDER BY n DESC, reason LIMIT 8",
        "backlog": f"""WITH a AS {a}, s AS (SELECT cluster_id, max(created_at) AS newest FROM a GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (category = 'purchase') = 0 AND max(created_at) < {back(2)})
          SELECT count(*) AS total, count(*) FILTER (newest >= {back(24)}) AS day FROM s""",
        "last_timings": f"""WITH a AS {a}, l AS (SELECT value FROM a WHERE value IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 1000)
          SELECT 'all' AS "of", count(*) AS n, {_q("avg(value)", 4)} AS mean, {_q("100::DOUBLE * count(*) FILTER (value > 100) / greatest(count(*), 1)", 2)} AS slow FROM l
          UNION ALL SELECT category, count(value), {_q("avg(value)", 4)}, NULL FROM a WHERE created_at >= {back(168)} AND value IS NOT NULL GROUP BY 1 HAVING count(value) >= 5""",
        "aliased_edges": f"""WITH t AS (SELECT cluster_id, regexp_replace(source, '^src1([0-9])$', 'src\\1') AS name, max(created_at) AS seen_at FROM {NEWS_SQL} GROUP BY 1, 2)
          SELECT x.name AS a, y.name AS b, count(*) AS weight, max(greatest(x.seen_at, y.seen_at)) AS last_seen FROM t x JOIN t y ON x.cluster_id = y.cluster_id AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY weight DESC, a, b LIMIT 500""",
        "trending_words": f"""WITH n AS {newest}, r AS (SELECT id, cluster_id, category, {hours("created_at")} / 48 AS age, unnest(regexp_extract_all(title, '[\\p{{L}}]{{4,}}')) AS w, unnest(range(len(regexp_extract_all(title, '[\\p{{L}}]{{4,}}')))) AS i FROM n),
          o AS (SELECT id, lower(w) AS word, arg_min(w, i) AS w, max(age) AS age, max(category) AS category, max(cluster_id) AS cluster_id FROM r GROUP BY 1, 2), z AS (SELECT cluster_id, count(*) AS size FROM n GROUP BY 1),
          s AS (SELECT word, count(*) AS n, coalesce(sum(3 * {bonus}) FILTER (age <= 1.5::DOUBLE), 0) AS h, coalesce(sum(2 * {bonus}) FILTER (age > 1.5::DOUBLE AND age <= 4.5::DOUBLE), 0) AS r, coalesce(sum({bonus}) FILTER (age > 4.5::DOUBLE), 0) AS b,
            count(DISTINCT category) AS c, bool_or(age <= 1.5::DOUBLE AND size >= 4) AS large FROM o JOIN z USING (cluster_id) GROUP BY 1)
          SELECT word, n, {_q("(2 * h + 1.2::DOUBLE * r + 0.5::DOUBLE * b) * CASE WHEN c >= 2 THEN 1 + 0.15::DOUBLE * c ELSE 1::DOUBLE END", 4)} AS score,
            CASE WHEN h > (r + b) * 0.8::DOUBLE AND h > 6 THEN 'breaking' WHEN h + r > 1.5::DOUBLE * b THEN 'up' WHEN b > 2 * (h + r) THEN 'down' ELSE 'flat' END AS trend, large OR (h > 15 AND c >= 2) AS breaking FROM s WHERE n >= 2 ORDER BY score DESC, word LIMIT 12""",
        "ingest_gates": f"""WITH r AS (SELECT n.id, source, created_at, concat_ws('/', source, md5(description[1:200])) AS link, key, language, junk FROM {NEWS_SQL} n JOIN ({keys}) k ON k.doc_id = n.id JOIN ({language}) l ON l.id = n.id JOIN ({queries["junk_articles"]}) j ON j.id = n.id),
          b AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY created_at, id) AS place FROM r WHERE created_at >= {back(240)}), o AS (SELECT * FROM r WHERE created_at < {back(240)}),
          g AS (SELECT *, CASE WHEN place > 1 OR EXISTS (SELECT 1 FROM o WHERE o.link = b.link) THEN 'link' WHEN language NOT IN ('en', 'hr', 'sq') THEN 'language' WHEN junk THEN 'junk' END AS gate FROM b)
          SELECT id, CASE WHEN gate IS NOT NULL THEN gate WHEN row_number() OVER (PARTITION BY source, key, gate IS NULL ORDER BY created_at, id) > 1 OR EXISTS (SELECT 1 FROM o WHERE o.source = g.source AND o.key = g.key) THEN 'title' ELSE 'kept' END AS verdict FROM g""",
        "trust_tiers": f"""WITH r AS (SELECT cluster_id, count(DISTINCT source) AS s, count(DISTINCT {number} % 3) AS t, max(created_at) AS newest, min(created_at) AS oldest, bool_or(contains(lower(title), 'the and')) AS verified FROM {NEWS_SQL} WHERE {number} % 5 <> (id // 8) % 5 GROUP BY 1),
          p AS (SELECT cluster_id, s, 10 + 15 * least(s, 4) + 10 * greatest(t - 1, 0) AS p, {hours("newest")} > 48 AS stale, (epoch_us(newest) - epoch_us(oldest)) / 3.6e9::DOUBLE < 10 AS provisional, verified FROM r)
          SELECT cluster_id, p::BIGINT AS pluralism, greatest(0, least(100, 10 * least(s, 8) + CASE WHEN p <= 15 THEN 25 WHEN p >= 55 THEN 12 ELSE 18 END + CASE WHEN stale OR provisional THEN 0 ELSE 20 END + CASE WHEN verified THEN 10 ELSE 0 END))::BIGINT AS trust,
            CASE WHEN provisional AND s >= 2 THEN 'early' WHEN s < 2 THEN 'early' WHEN p >= 55 THEN 'plural' WHEN p <= 15 THEN 'consensus' ELSE 'verified' END AS tier FROM p""",
        "editor_rates": f"""WITH s AS (SELECT source, {week("view", 1)} AS v1, {week("view", 2)} AS v2, {week("click", 1)} AS c1, {week("click", 2)} AS c2, {week("purchase", 1)} AS p1 FROM {a} GROUP BY 1)
          SELECT source, CASE WHEN v1 > 0 THEN {rate("p1", "v1")} ELSE 0::DOUBLE END AS open_rate, {rate("c1", "v1")} AS conversion, {_q(f"({rate('c1', 'v1')}) - ({rate('c2', 'v2')})", 1)} AS change FROM s""",
    }
