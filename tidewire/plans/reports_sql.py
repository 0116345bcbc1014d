"""SQL of the editors' reports and wording queries."""

from __future__ import annotations

from tidewire.adapters import ARTICLES_SQL, AS_OF


def _q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE"


def reports_sql() -> dict[str, str]:
    out = _reports_sql()
    return out | {f"{k}_vector": out[k] for k in ("running_centroid", "clustering_quality")}


def _reports_sql() -> dict[str, str]:
    a, now = ARTICLES_SQL, f"TIMESTAMP '{AS_OF}'"
    since = lambda h: f"(created_at >= {now} - INTERVAL {h} HOUR AND created_at < {now})"
    ratio = lambda x, y: _q(f"({x})::DOUBLE / nullif({y}, 0)")
    topic = "split_part(cluster_id, '-', 1)"
    return {
        "viewpoint_tiers": f"""WITH s AS (SELECT cluster_id, count(DISTINCT source % 3) AS tiers, min(created_at::DATE)::VARCHAR AS day FROM {a} GROUP BY 1),
          d AS (SELECT day, count(*) AS stories, count(*) FILTER (tiers = 3) AS full_, count(*) FILTER (tiers = 2) AS partial FROM s GROUP BY 1)
          SELECT day, stories, full_ AS "full", partial, {ratio("100.0::DOUBLE * full_", "stories")} AS share FROM d""",
        "story_text": f"SELECT cluster_id, string_agg(category, ', ' ORDER BY created_at, id) AS words FROM {a} GROUP BY 1",
        "top_sample": f"""WITH n AS (SELECT category, source, count(*) AS n FROM {a} GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, source) AS place FROM n QUALIFY place <= 8)
          SELECT category, to_json(list(struct_pack(source := source, n := n) ORDER BY place))::VARCHAR AS sample FROM p GROUP BY 1""",
        "running_centroid": f"""WITH p AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
          SELECT vec_id, label, i, count(x) OVER w AS n, {_q("avg(x) OVER w", 4)} AS mean FROM p
          WINDOW w AS (PARTITION BY label, i ORDER BY vec_id ROWS UNBOUNDED PRECEDING)""",
        "provider_mix": f"""WITH s AS (SELECT source, {ratio(f"count(*) FILTER (category = 'purchase' AND {since(24)})", f"count(*) FILTER {since(24)}")} AS day,
            {ratio(f"count(*) FILTER (category = 'purchase' AND {since(168)})", f"count(*) FILTER {since(168)}")} AS week FROM {a} GROUP BY 1)
          SELECT source, day, week, {_q("coalesce(day, 0::DOUBLE) - coalesce(week, 0::DOUBLE)")} AS rise FROM s""",
        "adoption": f"WITH l AS (SELECT source, count(DISTINCT category) AS kinds FROM {a} GROUP BY 1) SELECT kinds, count(*) AS sources FROM l GROUP BY 1",
        "alert_engagement": f"""WITH s AS (SELECT source, created_at::DATE::VARCHAR AS day, count(*) FILTER (category = 'view') AS sent, count(*) FILTER (category = 'click') AS opened, count(*) FILTER (category = 'purchase') AS saved FROM {a} GROUP BY 1, 2)
          SELECT *, {ratio("opened", "sent")} AS open_rate, {ratio("saved", "sent")} AS save_rate FROM s WHERE sent >= 3""",
        "clustering_quality": f"""WITH v AS (SELECT label, list_position(embedding, list_max(embedding)) AS found FROM embeddings), n AS (SELECT label, found, count(*) AS n FROM v GROUP BY 1, 2),
          t AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS tp FROM n), p AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS p FROM (SELECT sum(n) AS n FROM n GROUP BY found)),
          g AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS g FROM (SELECT sum(n) AS n FROM n GROUP BY label)), o AS (SELECT tp, p - tp AS fp, g - tp AS fn FROM t, p, g)
          SELECT tp, fp, fn, {ratio("tp", "tp + fp")} AS precision, {ratio("tp", "tp + fn")} AS recall, {ratio("2 * tp", "2 * tp + fp + fn")} AS f1 FROM o""",
        "window_quality": f"""WITH s AS (SELECT category, {topic} AS k, max(created_at) > min(created_at) + INTERVAL 24 HOUR AS long, count(DISTINCT source) AS ns FROM {a} GROUP BY 1, 2),
          o AS (SELECT category, count(*) AS groups, count(*) FILTER (long) AS spanning, count(*) FILTER (ns = 1) AS single FROM s GROUP BY 1) SELECT *, {ratio("100.0::DOUBLE * single", "groups")} AS single_share FROM o""",
        "merged_nodes": f"""WITH n AS (SELECT source, category, count(*) AS mentions, avg(value) AS tone FROM {a} GROUP BY 1, 2)
          SELECT source, sum(mentions)::BIGINT AS mentions, {_q("sum(tone * mentions) / sum(mentions) FILTER (tone IS NOT NULL)", 4)} AS tone, arg_min(category, (-mentions, category)) AS kind FROM n GROUP BY 1""",
        "trending": f"""WITH s AS (SELECT {topic} AS topic, count(*) FILTER {since(24)} AS now, count(*) FILTER (NOT {since(24)}) AS before FROM {a} WHERE {since(192)} GROUP BY 1)
          SELECT *, {_q("now / (before / 7.0::DOUBLE + 1.0::DOUBLE)")} AS burst FROM s WHERE now >= 2""",
        "story_sessions": f"""WITH r AS (SELECT {topic} AS topic, created_at, id, created_at > lag(created_at) OVER w + INTERVAL 24 HOUR AS opens FROM {a} WINDOW w AS (PARTITION BY {topic} ORDER BY created_at, id)),
          s AS (SELECT *, coalesce(sum(opens::INTEGER) OVER (PARTITION BY topic ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS run FROM r)
          SELECT topic, run, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM s GROUP BY 1, 2""",
        "first_impressions": f"""WITH s AS (SELECT created_at::DATE::VARCHAR AS day, source, {topic} AS topic, count(*) AS n FROM {a} WHERE category = 'view' GROUP BY 1, 2, 3)
          SELECT day, sum(n)::BIGINT AS views, count(*) AS counted FROM s GROUP BY 1""",
        "groomed_queue": f"SELECT cluster_id, category, arg_min(id, (created_at, id)) AS id, count(*) - 1 AS repeats FROM {a} GROUP BY 1, 2",
        "error_streaks": f"""WITH g AS (SELECT source, category, sum((category = 'view')::INTEGER) OVER (PARTITION BY source ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM {a}),
          r AS (SELECT source, run, count(*) AS n FROM g WHERE category <> 'view' GROUP BY 1, 2) SELECT source, max(n) AS longest, max(n) >= 3 AS paused FROM r GROUP BY 1""",
        "day_articles": f"SELECT id, source, category FROM {a} WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16'",
    }
