"""SQL of the selections."""

from __future__ import annotations

from tidewire.adapters import NEWS_SQL
from tidewire.functions.wording import CYRILLIC, DIGRAPHS, LATIN
from tidewire.plans.ranking_sql import _SCORED, NOW, RANKED, W, words4
from tidewire.plans.reports_sql import _q

FEATURE = r"(?i)izdanie na|intervju so|intervju\b|proverete dali|pred da |postojano ste umorni|ovoj mineral|horoskop|recept|foto\b|video\b|galerija"
HARD, SOFT = "('politics', 'economy', 'crime', 'sport', 'technology')", "('life', 'fun', 'health')"


def feature(title: str) -> str:
    clean = f"trim(coalesce({title}, ''))"
    return f"({clean} = '' OR length({clean}) > 180 OR contains({clean}, '?') OR regexp_matches({clean}, '{FEATURE}'))"


def _engagement(level: str, ctr: str, opened: str, most: str, click: str, cap: str) -> str:
    x = f"{ctr}::DOUBLE * clicks / sends + {opened}::DOUBLE * opens / sends + least({most}::DOUBLE, {click}::DOUBLE * clicks)"
    return f"SELECT '{level}' AS level, key, sends, clicks, opens, {_q(f'least({cap}::DOUBLE, {x})')} AS score FROM (SELECT {level} AS key, count(*) AS sends, sum(clicks)::BIGINT AS clicks, sum(opens)::BIGINT AS opens FROM r GROUP BY 1)"


def selection_sql() -> dict[str, str]:
    cyr = "CASE WHEN regexp_matches(title, '[Ѐ-ӿ]') THEN title ELSE translate(" + "".join("replace(" for _ in DIGRAPHS) + "title" + "".join(f", '{b}', '{a}')" for a, b in DIGRAPHS) + f", '{LATIN + LATIN.upper()}', '{CYRILLIC + CYRILLIC.upper()}') END"
    tags = words4("title")
    number = "regexp_extract(source, '([0-9]+)$', 1)::INTEGER"
    of = lambda h: f"created_at >= {NOW} - INTERVAL {h} HOUR"
    return {
        "news_page": f"SELECT id, source, created_at FROM {NEWS_SQL} WHERE created_at >= {NOW} - INTERVAL 7 DAY AND category = 'en' ORDER BY {W} DESC, created_at DESC, id LIMIT 20 OFFSET 10",
        "archive_matches": f"WITH m AS (SELECT id, contains(lower(title), 'tion') AS in_title, contains(lower(description), 'tion') AS in_description FROM {NEWS_SQL}) SELECT *, in_title AS counted FROM m WHERE in_title OR in_description",
        "followed_news": f"""WITH s AS (SELECT cluster_id FROM {RANKED} WHERE rank = 1 AND source = 'src2'), n AS (SELECT *, {tags} AS tags FROM {NEWS_SQL} WHERE source IN ('src1', 'src4', 'src7'))
          SELECT id, topic IN ('sport', 'economy') AS on_topic, list_has_any(tags, ['with', 'that', 'pour', 'nicht']) AS tagged, len(list_filter(tags, lambda t: regexp_matches(t, '[0-9]{{4,}}'))) > 0 AS numbered,
            regexp_matches(title, '(?i) (the|la|der)$') AS ends FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cluster_id = n.cluster_id)""",
        "served_ads": """WITH c AS (SELECT o_orderpriority AS slot, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT starts_with(o_orderpriority, '5') AND o_orderdate <= TIMESTAMP '1995-06-17'
            AND o_orderdate >= TIMESTAMP '1995-06-17' - INTERVAL 44 DAY AND o_custkey % 2000 < floor(o_totalprice / 100))
          SELECT slot, count(*) AS ads, array_to_string(list_sort(list(o_orderkey))[1:5], ',') AS first_ads FROM c GROUP BY 1""",
        "live_candidates": f"""WITH f AS (SELECT cluster_id, title, topic, category FROM {RANKED} WHERE rank = 1)
          SELECT cluster_id, CASE WHEN trim(title) = '' THEN false WHEN score >= 4.5::DOUBLE THEN true WHEN {feature("title")} THEN false WHEN topic IN {SOFT} THEN false WHEN topic IN {HARD} THEN true
            WHEN category NOT IN ('en', 'fr') THEN false ELSE n >= 2 END AS live FROM f JOIN ({_SCORED}) USING (cluster_id)""",
        "wire_candidates": f"SELECT id, CASE WHEN {feature('title')} OR topic IN {SOFT} THEN false WHEN topic IN {HARD} THEN true ELSE category IN ('en', 'fr') END AS wire FROM {NEWS_SQL}",
        "stub_stories": f"SELECT id, length(trim(title)) < 48 AND length(trim(description)) < 90 AND (length(trim(title)) < 32 OR length(trim(description)) < 48) AS stub FROM {NEWS_SQL}",
        "cyrillic_headlines": f"""WITH t AS (SELECT id, CASE WHEN id % 2 = 1 THEN {cyr} ELSE title END AS t FROM {NEWS_SQL}), c AS (SELECT id, len(regexp_extract_all(t, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM t)
          SELECT id, c >= 8 AND (l = 0 OR c >= 2 * l) AS cyrillic FROM c""",
        "delivery_engagement": f"""WITH s AS (SELECT event_id, json_extract_string(props, '$.k') AS topic, concat_ws('-', json_extract_string(props, '$.k'), strftime(ts, '%Y-%m-%d')) AS story, user_id::VARCHAR AS source FROM events WHERE event_type = 'view'),
          r AS (SELECT s.*, count(*) FILTER (c.event_type = 'click') AS clicks, count(*) FILTER (c.event_type = 'purchase') AS opens FROM s LEFT JOIN events c ON c.event_type IN ('click', 'purchase') AND c.event_id - 1 - c.event_id % 3 = s.event_id GROUP BY ALL)
          {_engagement("story", "1.5", "0.55", "0.25", "0.05", "1.1")} UNION ALL {_engagement("topic", "1.8", "0.7", "0.2", "0.04", "1.2")} UNION ALL {_engagement("source", "1.8", "0.7", "0.2", "0.04", "1.2")}""",
        "navigation_stories": f"""WITH n AS {NEWS_SQL} SELECT cluster_id, md5(arg_max(title, (created_at, id))) AS title_md5, count(*) AS n FROM n WHERE EXISTS (SELECT 1 FROM n o WHERE o.cluster_id = n.cluster_id AND {W.replace("credibility", "o.credibility").replace("quality", "o.quality")} >= 1.75::DOUBLE) GROUP BY 1""",
        "entity_lookup": f"""WITH n AS {NEWS_SQL}, a AS (SELECT name, count(*) AS named FROM (SELECT unnest(list_distinct(regexp_extract_all(title, '[A-Z][a-z]{{5,}}'))) AS name FROM n) GROUP BY 1),
          b AS (SELECT word, count(*) AS used FROM (SELECT unnest(list_distinct(regexp_extract_all(title, '[a-z]{{6,}}'))) AS word FROM n) GROUP BY 1) SELECT name, named, used FROM a JOIN b ON lower(name) = lower(word)""",
        "on_this_day": """WITH r AS (SELECT o_orderkey, CASE o_orderdate::DATE WHEN DATE '1996-03-15' THEN 1 WHEN DATE '1995-03-15' THEN 2 END AS y FROM orders) SELECT o_orderkey, y::INTEGER AS years_back FROM r WHERE y = (SELECT min(y) FROM r)""",
        "merged_stories": f"""WITH b AS (SELECT cluster_id, 'a' AS "from", count(*) AS n FROM {NEWS_SQL} WHERE {number} BETWEEN 0 AND 9 GROUP BY 1 UNION ALL SELECT cluster_id, 'b', count(*) FROM {NEWS_SQL} WHERE {number} BETWEEN 5 AND 19 GROUP BY 1)
          SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, "from") = 1""",
        "archive_totals": f"""SELECT count(*) AS total, count(*) FILTER ({of(720)}) AS month, count(*) FILTER ({of(24)}) AS day, count(*) FILTER ({of(1)}) AS hour, count(DISTINCT source) FILTER ({of(720)}) AS sources,
          {_q(f"100::DOUBLE * count(*) FILTER ({of(720)} AND category <> 'en') / greatest(count(*) FILTER ({of(720)}), 1)", 1)} AS international FROM {NEWS_SQL}""",
        "title_pairs": f"""WITH t AS (SELECT cluster_id, {words4("title")} AS w FROM (SELECT cluster_id, max(title) AS title FROM {NEWS_SQL} GROUP BY 1)),
          p AS (SELECT a.cluster_id AS a, b.cluster_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM t a JOIN t b ON a.cluster_id < b.cluster_id AND len(a.w) > 0 AND len(b.w) > 0)
          SELECT a, b, {_q("i::DOUBLE / (x + y - i)")} AS overlap FROM p WHERE i::DOUBLE / (x + y - i) >= 0.9::DOUBLE""",
    }
