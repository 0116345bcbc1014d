"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.adapters import ARTICLES_SQL, AS_OF, articles, news, table
from tidewire.operators import applied, attention, entities, gates, grouping, home, merges, next_reads, online, pages, quality, ranking, readers, reports, scores, search, selection, signals, statistics, stories, support, texts, trends, words
from tidewire.plans.entities_sql import entities_sql
from tidewire.plans.gates_sql import gates_sql
from tidewire.plans.pages_sql import pages_sql
from tidewire.plans.quality_sql import quality_sql
from tidewire.plans.ranking_sql import ranking_sql
from tidewire.plans.search_sql import search_sql
from tidewire.plans.selection_sql import selection_sql
from tidewire.plans.reports_sql import reports_sql
from tidewire.plans.scores_sql import scores_sql
from tidewire.plans.statistics_sql import statistics_sql
from tidewire.plans.support_sql import support_sql
from tidewire.plans.trends_sql import trends_sql
from tidewire.plans.words_sql import words_sql

_ON_ARTICLES = {
    "source_history": stories.source_history, "heatmap": stories.heatmap, "hourly_velocity": stories.hourly_velocity, "daily_volume": stories.daily_volume,
    "top_categories": stories.top_categories, "facets": stories.facets, "latest_per_story": stories.latest_per_story, "funnel": stories.funnel,
    "period_compare": stories.period_compare, "unsummarised": stories.unsummarised, "source_pairs": stories.source_pairs,
    "cluster_score": stories.cluster_score, "pulse": stories.pulse,
    "staleness": signals.staleness, "moving_stats": signals.moving_stats, "recency_weight": signals.recency_weight, "nearest_days": signals.nearest_days,
    "source_breakdown": attention.source_breakdown, "navigation": attention.navigation, "engagement": attention.engagement, "daily_mood": attention.daily_mood,
    "freshest": attention.freshest, "wire_page": attention.wire_page, "followed_stories": attention.followed_stories,
    "entry_times": applied.entry_times, "first_seen": applied.first_seen, "current_rows": applied.current_rows,
    "homepage_scores": scores.homepage_scores, "trust_summary": scores.trust_summary, "coverage_balance": scores.coverage_balance, "editorial_signals": scores.editorial_signals,
    "decayed_edges": scores.decayed_edges, "freshness_labels": scores.freshness_labels, "stance": scores.stance, "topic_links": scores.topic_links,
    "reprocessing": scores.reprocessing, "weights_after": scores.weights_after, "retained": scores.retained,
    "viewpoint_tiers": reports.viewpoint_tiers, "story_text": reports.story_text, "top_sample": reports.top_sample, "provider_mix": reports.provider_mix, "adoption": reports.adoption,
    "alert_engagement": reports.alert_engagement, "window_quality": reports.window_quality, "merged_nodes": reports.merged_nodes, "trending": reports.trending, "story_sessions": reports.story_sessions,
    "first_impressions": reports.first_impressions, "groomed_queue": reports.groomed_queue, "error_streaks": reports.error_streaks, "day_articles": reports.day_articles,
    "filtered_facets": statistics.filtered_facets, "followers": statistics.followers, "stale_stories": statistics.stale_stories, "navigation_axes": statistics.navigation_axes,
    "retention": statistics.retention, "fallback_reasons": statistics.fallback_reasons, "backlog": statistics.backlog, "last_timings": statistics.last_timings, "editor_rates": statistics.editor_rates,
    "source_policies": gates.source_policies, "ops_alerts": gates.ops_alerts,
}
_ON_TABLES = {
    "visitors": ("events", stories.visitors), "reading_time": ("documents", texts.reading_time), "page_links": ("pages", texts.page_links),
    "centroids": ("embeddings", texts.centroids), "text_search": ("documents", texts.text_search), "language_sources": ("documents", texts.language_sources),
    "key_counts": ("events", signals.key_counts), "event_counters": ("events", signals.event_counters), "fingerprints": ("documents", signals.fingerprints),
    "similar_to_first": ("embeddings", signals.similar_to_first), "turns": ("conversations", signals.turns), "visitor_hash": ("events", signals.visitor_hash),
    "quiet_titles": ("documents", applied.quiet_titles), "turn_overlap": ("conversations", applied.turn_overlap), "number_counts": ("documents", applied.number_counts),
    "text_tone": ("conversations", applied.text_tone), "ad_prices": ("events", applied.ad_prices),
    "title_keys": ("documents", words.title_keys), "folded_titles": ("documents", words.folded_titles), "cyrillic_titles": ("documents", words.cyrillic_titles),
    "embedding_texts": ("documents", words.embedding_texts), "stem_counts": ("documents", words.stem_counts), "entity_counts": ("documents", words.entity_counts),
    "copy_purity": ("documents", scores.copy_purity),
    "turn_cosine": ("conversations", words.turn_cosine), "calibrated_distances": ("events", words.calibrated_distances), "centred_vectors": ("embeddings", words.centred_vectors),
    "page_articles": ("pages", pages.page_articles), "feed_links": ("pages", gates.feed_links), "page_feeds": ("pages", gates.page_feeds), "image_scores": ("pages", gates.image_scores), "page_images": ("pages", gates.page_images),
    "alert_gaps": ("events", gates.alert_gaps), "profiles": ("events", readers.profiles), "mood_days": ("events", statistics.mood_days), "checked_centroids": ("embeddings", statistics.checked_centroids),
    "served_ads": ("orders", selection.served_ads), "on_this_day": ("orders", selection.on_this_day), "delivery_engagement": ("events", selection.delivery_engagement),
    "running_centroid": ("embeddings", reports.running_centroid_vector), "clustering_quality": ("embeddings", lambda v: reports.clustering_quality(reports.vector_clusters(v))),
    "running_centroid_vector": ("embeddings", reports.running_centroid_vector),
    "clustering_quality_vector": ("embeddings", lambda v: reports.clustering_quality(reports.vector_clusters(v))),
}

_ON_NEWS = {
    "source_weights": ranking.source_weights, "ranked_in_story": ranking.ranked_in_story, "story_scores": ranking.story_scores, "source_roles": ranking.source_roles,
    "coverage": ranking.coverage, "summary_freshness": ranking.summary_freshness, "editor_signals": ranking.editor_signals, "lead_story": ranking.lead_story,
    "source_reputation": ranking.source_reputation,
    "story_entities": entities.story_entities, "word_roles": entities.word_roles, "article_quality": quality.article_quality, "rejected_articles": quality.rejected_articles, "home_page": home.home_page, "rising_words": lambda n: trends.rising_words(n, unit=48), "next_reads": next_reads.next_reads, "faithfulness": support.faithfulness,
    "story_timeline": grouping.story_timeline, "story_overview": grouping.story_overview, "story_summary": grouping.story_summary,
    "aliased_edges": statistics.aliased_edges, "trending_words": statistics.trending_words, "ingest_gates": statistics.ingest_gates, "trust_tiers": lambda n: statistics.trust_tiers(n, provisional_hours=10),
    "latin_titles": gates.latin_titles, "synthesis_quality": gates.synthesis_quality,
    "languages": gates.languages, "fact_checks": gates.fact_checks, "junk_articles": gates.junk_articles, "classes": gates.classes, "number_grounding": gates.number_grounding,
    "complexity": gates.complexity, "editorial_patterns": gates.editorial_patterns, "citations": gates.citations, "cleaned_texts": gates.cleaned_texts,
    "reader_scores": readers.reader_scores, "follow_recommendations": readers.follow_recommendations, "digest": readers.digest,
    "news_page": selection.news_page, "archive_matches": selection.archive_matches, "followed_news": selection.followed_news, "live_candidates": selection.live_candidates,
    "wire_candidates": selection.wire_candidates, "stub_stories": selection.stub_stories, "cyrillic_headlines": selection.cyrillic_headlines, "navigation_stories": selection.navigation_stories,
    "entity_lookup": selection.entity_lookup, "merged_stories": selection.merged_stories, "brief_picks": selection.brief_picks, "archive_totals": selection.archive_totals, "title_pairs": selection.title_pairs,
}

_ON_ALL = {f.__name__: f for f in (search.word_search, search.article_search, search.hybrid_search, search.semantic_search, search.related_stories, search.earlier_stories, search.for_reader, search.global_stories, online.online_stories, merges.merge_plan, merges.story_confidence)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda s, d, f=f: f(articles(s, d))) for k, f in _ON_ARTICLES.items()}
    out |= {k: (lambda s, d, f=f: f(news(s, d))) for k, f in _ON_NEWS.items()}
    out |= _ON_ALL
    return out | {k: (lambda s, d, t=t, f=f: f(table(s, d, t))) for k, (t, f) in _ON_TABLES.items()}


def oracle_sql() -> dict[str, str]:
    a, now = ARTICLES_SQL, f"TIMESTAMP '{AS_OF}'"
    return reports_sql() | scores_sql() | words_sql() | ranking_sql() | selection_sql() | search_sql() | entities_sql() | pages_sql() | support_sql() | trends_sql(trends.SPELLINGS, 48) | quality_sql(gates_sql()["junk_articles"]) | gates_sql() | statistics_sql(words_sql() | gates_sql()) | {
        "source_history": f"""WITH a AS {a}, s AS (SELECT cluster_id, arg_min(source, (created_at, id)) AS source, count(DISTINCT source) AS ns FROM a GROUP BY 1),
          l AS (SELECT source, count(*) AS leads, count(*) FILTER (ns >= 2) AS corroborated, count(*) FILTER (ns = 1) AS solo FROM s GROUP BY 1),
          r AS (SELECT source, count(*) AS articles, count(*) FILTER (created_at >= {now} - INTERVAL 7 DAY AND created_at < {now}) AS week,
            count(*) FILTER (created_at >= {now} - INTERVAL 14 DAY AND created_at < {now} - INTERVAL 7 DAY) AS week_before FROM a GROUP BY 1)
          SELECT source, articles, week, week_before, coalesce(leads, 0) AS leads, coalesce(corroborated, 0) AS corroborated, coalesce(solo, 0) AS solo FROM r LEFT JOIN l USING (source)""",
        "heatmap": f"WITH d AS (SELECT created_at::DATE::VARCHAR AS day, cluster_id, count(*) AS n FROM {a} GROUP BY 1, 2) SELECT day, count(*) AS stories, count(*) FILTER (n >= 5) AS large, sum(n)::BIGINT AS articles FROM d GROUP BY 1",
        "hourly_velocity": f"SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM {a} WHERE created_at >= {now} - INTERVAL 24 HOUR GROUP BY 1",
        "daily_volume": f"""WITH a AS {a}, c AS (SELECT source, ({now}::DATE - i::INTEGER)::VARCHAR AS day FROM (SELECT DISTINCT source FROM a), range(1, 31) t(i)), n AS (SELECT source, created_at::DATE::VARCHAR AS day, count(*) AS n FROM a GROUP BY 1, 2)
          SELECT source, c.day, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (source, day)""",
        "top_categories": f"WITH n AS (SELECT source, category, count(*) AS n FROM {a} GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, category)::INTEGER AS place FROM n QUALIFY place <= 3",
        "facets": f"""WITH a AS {a} (SELECT 'source' AS axis, source::VARCHAR AS value, count(*) AS n FROM a GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12) UNION ALL
          (SELECT 'category', category, count(*) FROM a GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""",
        "latest_per_story": f"SELECT cluster_id, id, source, created_at, min(created_at) OVER w AS first_at, count(*) OVER w AS n FROM {a} WINDOW w AS (PARTITION BY cluster_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id DESC) = 1",
        "funnel": f"""WITH s AS (SELECT source, count(*) FILTER (category = 'view') AS views, count(*) FILTER (category = 'click') AS clicks, count(*) FILTER (category = 'purchase') AS purchases FROM {a} GROUP BY 1)
          SELECT *, CASE WHEN views > 0 THEN floor(100.0::DOUBLE * clicks / views * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS click_rate FROM s""",
        "period_compare": f"""WITH s AS (SELECT category, count(*) FILTER (created_at >= {now} - INTERVAL 7 DAY AND created_at < {now}) AS now, count(*) FILTER (created_at >= {now} - INTERVAL 14 DAY AND created_at < {now} - INTERVAL 7 DAY) AS before FROM {a} GROUP BY 1) SELECT *, now - before AS change FROM s""",
        "unsummarised": f"WITH a AS {a} SELECT cluster_id, count(*) AS n, max(created_at) AS newest FROM a WHERE cluster_id NOT IN (SELECT cluster_id FROM a WHERE category = 'purchase') GROUP BY 1 HAVING count(*) >= 2",
        "source_pairs": f"WITH m AS (SELECT DISTINCT cluster_id, source FROM {a}) SELECT x.source AS a, y.source AS b, count(*) AS shared FROM m x JOIN m y ON x.cluster_id = y.cluster_id AND x.source < y.source GROUP BY 1, 2 HAVING count(*) >= 2",
        "cluster_score": f"""WITH s AS (SELECT cluster_id, count(DISTINCT source) AS n_sources, count(*) AS n, max(created_at) AS newest FROM {a} GROUP BY 1)
          SELECT cluster_id, n_sources, n, floor(n_sources * exp(-0.115::DOUBLE * ((epoch_us({now}) - epoch_us(newest)) / 3.6e9::DOUBLE)) * ln(1.0::DOUBLE + n) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score FROM s""",
        "pulse": f"""WITH s AS (SELECT cluster_id, count(*) FILTER (created_at >= {now} - INTERVAL 24 HOUR) AS fresh, max(created_at) AS newest FROM {a} GROUP BY 1)
          SELECT cluster_id, (10 + 10 * least(fresh, 5) + CASE WHEN newest > {now} - INTERVAL 1 HOUR THEN 15 WHEN newest > {now} - INTERVAL 6 HOUR THEN 8 WHEN newest >= {now} - INTERVAL 24 HOUR THEN 3 ELSE 0 END)::BIGINT AS pulse FROM s""",
        "visitors": "SELECT ts::DATE::VARCHAR AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1",
        "reading_time": r"SELECT doc_id, greatest(1, ceil(len(regexp_extract_all(text, '[^ \t\n\r]+')) / 200.0::DOUBLE))::BIGINT AS minutes FROM documents",
        "page_links": f"SELECT page_id, link, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM pages JOIN ({gates_sql()['feed_links']}) USING (page_id)",
        "centroids": "WITH p AS (SELECT label, (unnest(range(len(embedding))))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i, floor(avg(x) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS mean FROM p GROUP BY 1, 2",
        "text_search": r"""WITH d AS (SELECT doc_id, lower(text) AS low, lower(split_part(text, chr(10), 1)) AS title FROM documents)
          SELECT doc_id, (CASE WHEN title = 'the' THEN 4 WHEN starts_with(title, 'the') THEN 3 WHEN contains(title, 'the') THEN 2 ELSE 1 END)::BIGINT AS rank FROM d WHERE contains(low, 'the')""",
        "language_sources": "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (lang <> 'en') AS \"foreign\" FROM documents GROUP BY 1) SELECT *, floor(100.0::DOUBLE * \"foreign\" / n * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS share FROM s",
        "staleness": f"WITH s AS (SELECT category, cluster_id, max(created_at) AS newest FROM {a} GROUP BY 1, 2) SELECT category, count(*) AS stories, count(*) FILTER (newest < {now} - INTERVAL 2 DAY) AS stale FROM s GROUP BY 1",
        "moving_stats": f"SELECT id, source, count(*) OVER w AS n, max(value) OVER w AS highest FROM {a} WINDOW w AS (PARTITION BY source ORDER BY created_at, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
        "recency_weight": f"""WITH d AS (SELECT id, CASE WHEN id % 10 <> 0 THEN (epoch_us({now}) - epoch_us(created_at)) / 8.64e10::DOUBLE END AS days FROM {a})
          SELECT id, (CASE WHEN days IS NULL THEN 0.7 WHEN days <= 2 THEN 1.0 WHEN days <= 7 THEN 0.82 WHEN days <= 14 THEN 0.58 WHEN days <= 30 THEN 0.32 ELSE 0.14 END)::DOUBLE AS weight FROM d""",
        "nearest_days": f"SELECT max(created_at::DATE) FILTER (created_at::DATE < DATE '2024-01-15')::VARCHAR AS before, min(created_at::DATE) FILTER (created_at::DATE > DATE '2024-01-15')::VARCHAR AS after FROM {a}",
        "key_counts": "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
        "event_counters": "SELECT ts::DATE::VARCHAR AS day, event_type, props, count(*) AS n FROM events GROUP BY 1, 2, 3",
        "fingerprints": r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS mark FROM documents",
        "similar_to_first": """WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1),
          n AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e) AS c FROM embeddings, q WHERE vec_id <> q)
          SELECT vec_id, floor(c * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS cosine FROM n ORDER BY c DESC, vec_id LIMIT 15""",
        "turns": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, max(length(text))::BIGINT AS longest FROM conversations GROUP BY 1",
        "visitor_hash": "SELECT sha256(concat_ws('|', user_id::VARCHAR, strftime(ts, '%Y-%m-%d'), 's')) AS visitor, count(*) AS n FROM events GROUP BY 1",
        "entry_times": f"SELECT id, CASE WHEN created_at <= {now} + INTERVAL 30 MINUTE AND created_at >= {now} - INTERVAL 14 DAY THEN created_at ELSE {now} END AS at FROM {a}",
        "first_seen": f"""WITH a AS (SELECT id, created_at, source, category, value FROM {a})
          SELECT * FROM a WHERE created_at >= TIMESTAMP '2024-01-03' AND NOT EXISTS (SELECT 1 FROM a o WHERE o.created_at < TIMESTAMP '2024-01-03'
            AND o.source IS NOT DISTINCT FROM a.source AND o.category IS NOT DISTINCT FROM a.category) QUALIFY row_number() OVER (PARTITION BY source, category ORDER BY created_at, id) = 1""",
        "current_rows": f"""SELECT id, created_at, source, category, value FROM {a}
          QUALIFY row_number() OVER (PARTITION BY source, category ORDER BY created_at >= TIMESTAMP '2024-01-15' DESC, created_at DESC, id DESC) = 1""",
        "quiet_titles": r"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents),
          n AS (SELECT *, len(regexp_extract_all(title, '\p{L}')) AS letters, len(regexp_extract_all(title, '\p{Ll}')) AS low FROM t)
          SELECT doc_id, CASE WHEN letters > 5 AND low * 5 < letters THEN upper(title[1]) || lower(title[2:]) ELSE title END AS title FROM n""",
        "turn_overlap": r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: length(x) >= 4)) AS x FROM conversations),
          p AS (SELECT a.conv_id, a.turn, a.x, b.x AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
          j AS (SELECT *, len(list_intersect(x, y)) AS n FROM p)
          SELECT conv_id, turn, CASE WHEN len(x) > 0 AND len(y) > 0 THEN floor((n::DOUBLE / (len(x) + len(y) - n)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE ELSE 0.0::DOUBLE END AS overlap FROM j""",
        "number_counts": r"""WITH f AS (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents)
          SELECT CASE WHEN regexp_full_match(x, '[0-9]{1,3}([.,][0-9]{3})+') THEN regexp_replace(x, '[.,]', '', 'g') ELSE replace(x, ',', '.') END AS number, count(*) AS n FROM f GROUP BY 1""",
        "text_tone": r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '[ \t\n\r]+')) AS x FROM conversations),
          k AS (SELECT *, len(list_intersect(x, ['good', 'great', 'win', 'growth', 'success'])) AS p, len(list_intersect(x, ['bad', 'crisis', 'war', 'loss', 'attack'])) AS n FROM w)
          SELECT conv_id, turn, CASE WHEN p + n > 0 THEN floor(((p::DOUBLE - n) / (p + n)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE ELSE 0.0::DOUBLE END AS tone FROM k""",
        "ad_prices": "SELECT event_id, greatest(floor(value * 100.0::DOUBLE * (1.0::DOUBLE - 0.15::DOUBLE) + 0.5::DOUBLE), 50)::BIGINT AS cents FROM events",
        "source_breakdown": f"""WITH n AS (SELECT category, source::VARCHAR AS source, count(*) AS n FROM {a} GROUP BY 1, 2),
          p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, source) AS place FROM n)
          SELECT category, CASE WHEN place <= 8 THEN source ELSE 'other' END AS source, sum(n)::BIGINT AS n FROM p GROUP BY 1, 2""",
        "navigation": f"WITH n AS (SELECT category, source, count(DISTINCT cluster_id) AS n FROM {a} GROUP BY 1, 2) SELECT category, sum(n)::BIGINT AS stories FROM n GROUP BY 1",
        "engagement": f"""WITH s AS (SELECT cluster_id, count(*) FILTER (category = 'view') AS views, count(*) FILTER (category = 'click') AS clicks, count(*) FILTER (category = 'purchase') AS opens FROM {a} GROUP BY 1),
          e AS (SELECT *, 1.5::DOUBLE * CASE WHEN views > 0 THEN clicks::DOUBLE / views ELSE 0 END + 0.55::DOUBLE * CASE WHEN views > 0 THEN opens::DOUBLE / views ELSE 0 END + least(0.25::DOUBLE, 0.05::DOUBLE * clicks) AS x FROM s)
          SELECT cluster_id, views, clicks, opens, floor(least(1.1::DOUBLE, x) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score FROM e""",
        "daily_mood": f"""WITH n AS (SELECT created_at::DATE::VARCHAR AS day, category, count(*) AS n, sum(value) AS total, count(value) AS known FROM {a} GROUP BY 1, 2)
          SELECT day, floor(sum(total) / sum(known)::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS mean, arg_min(category, (-n, category)) AS tone FROM n GROUP BY 1""",
        "freshest": f"SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id DESC)::INTEGER AS place FROM {a} QUALIFY place <= 40",
        "wire_page": f"""WITH c AS (SELECT id, source, value FROM {a} QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC NULLS LAST, id) <= 2)
          SELECT * FROM c ORDER BY value DESC NULLS LAST, id LIMIT 20 OFFSET 20""",
        "followed_stories": f"WITH a AS {a} SELECT cluster_id FROM a WHERE category = 'purchase' UNION SELECT cluster_id FROM a GROUP BY 1 HAVING count(*) >= 5",
    }
