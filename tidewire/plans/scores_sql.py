"""SQL of the scores and labels."""

from __future__ import annotations

from tidewire.adapters import ARTICLES_SQL, AS_OF
from tidewire.plans.reports_sql import _q


def _d(text: str) -> str:
    """A number as a double."""
    return f"{text}::DOUBLE"


def scores_sql() -> dict[str, str]:
    a = ARTICLES_SQL
    hours = lambda at: f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({at})) / 3.6e9::DOUBLE)"
    h = f"greatest(0::DOUBLE, {hours('newest')})"
    base = f"""CASE WHEN {h} <= 12 THEN 10 - {_d("0.45")} * {h} WHEN {h} <= 36 THEN {_d("4.6")} - {_d("0.11")} * ({h} - 12) ELSE greatest(0::DOUBLE, {_d("1.96")} - {_d("0.18")} * ({h} - 36)) END"""
    share = "(other::DOUBLE / greatest(latin + other, 1))"
    return {
        "homepage_scores": f"""WITH a AS {a}, s AS (SELECT cluster_id, count(DISTINCT source) AS ns, count(*) AS n, count(value) AS described FROM a GROUP BY 1),
          w AS (SELECT *, {_d("0.4")} + {_d("0.35")} * (source % 5) AS weight FROM (SELECT DISTINCT cluster_id, source FROM a)),
          t AS (SELECT cluster_id, avg(weight) AS trust FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, source) <= 3) GROUP BY 1),
          r AS (SELECT cluster_id, ns, ns * ln(1 + n) * (1 + least({_d("0.8")}, {_d("0.28")} * ln(1 + ns))) * (1 + least({_d("0.35")}, {_d("0.08")} * described)) AS y,
            ns * ln(1 + n) * (1 + least({_d("0.22")}, greatest(0::DOUBLE, {_d("0.16")} * (trust - 1)))) * (CASE ns WHEN 1 THEN {_d("0.65")} WHEN 2 THEN {_d("1.12")} ELSE {_d("1.22")} END) AS h FROM s JOIN t USING (cluster_id))
          SELECT cluster_id, {_q("y", 4)} AS synthesis, {_q("h", 4)} AS homepage, {_q("h + 5::DOUBLE * least(ns, 8)", 4)} AS feed FROM r""",
        "trust_summary": f"""WITH s AS (SELECT cluster_id, count(DISTINCT source) AS s, count(DISTINCT source % 3) AS t, max(created_at) AS newest FROM {a} GROUP BY 1),
          p AS (SELECT cluster_id, s, 10 + 15 * least(s, 4) + 10 * greatest(t - 1, 0) AS pluralism, {hours("newest")} > 48 AS stale FROM s)
          SELECT cluster_id, pluralism::BIGINT AS pluralism, least(100, 10 * least(s, 8) + CASE WHEN pluralism <= 15 THEN 25 WHEN pluralism >= 55 THEN 12 ELSE 18 END + CASE WHEN stale THEN 0 ELSE 20 END)::BIGINT AS trust,
            CASE WHEN s < 2 THEN 'early' WHEN pluralism >= 55 THEN 'plural' WHEN pluralism <= 15 THEN 'consensus' ELSE 'verified' END AS tier FROM p""",
        "coverage_balance": f"""WITH s AS (SELECT cluster_id, count(DISTINCT source % 3) AS t, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT category) AS c FROM {a} GROUP BY 1)
          SELECT cluster_id, CASE WHEN t >= 3 THEN 'full' WHEN t = 2 THEN 'partial' END AS label, n >= 3 AND (s >= 4 OR c >= 2) AS balanced FROM s""",
        "editorial_signals": f"""WITH s AS (SELECT cluster_id, max(created_at) AS newest, count(*) FILTER ({hours("created_at")} <= 6) AS recent, count(DISTINCT source) AS s FROM {a} GROUP BY 1)
          SELECT cluster_id, {_q(f"least(10::DOUBLE, {base} + least({_d('1.6')}, {_d('0.45')} * greatest(0, recent - 1)))", 4)} AS freshness,
            {_q(f"least(10::DOUBLE, {_d('1.85')} * (s - 1) + least(2::DOUBLE, {_d('0.6')} * recent))", 4)} AS development FROM s""",
        "decayed_edges": f"""WITH e AS (SELECT source, category, count(*) AS n, floor({hours("max(created_at)")} / 24) AS days FROM {a} GROUP BY 1, 2),
          w AS (SELECT source, category, CASE WHEN days > 1 THEN n * exp({_d("-0.05")} * days) ELSE n::DOUBLE END AS weight FROM e) SELECT source, category, {_q("weight")} AS weight FROM w WHERE weight >= {_d("0.2")}""",
        "copy_purity": f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS latin, len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS other FROM documents)
          SELECT doc_id, latin >= 24 AND {share} <= {_d("0.22")} AS ok, {_q(f"{_d('0.45')} * least(1::DOUBLE, latin / 24::DOUBLE) + {_d('0.4')} * (1 - least(1::DOUBLE, {share} / {_d('0.22')})) + {_d('0.15')}", 4)} AS purity FROM c""",
        "freshness_labels": f"""WITH s AS (SELECT source, floor({hours("max(created_at)")} * 60)::BIGINT AS minutes FROM {a} GROUP BY 1)
          SELECT *, CASE WHEN minutes <= 15 THEN 'fresh' WHEN minutes <= 45 THEN 'aging' ELSE 'stale' END AS label FROM s""",
        "stance": f"WITH s AS (SELECT cluster_id, avg(value) AS m, stddev_pop(value) AS d FROM {a} GROUP BY 1) SELECT cluster_id, {_q('m + 1e-9::DOUBLE', 2)} AS mean, {_q('d + 1e-9::DOUBLE', 2)} AS divergence FROM s",
        "topic_links": f"""WITH a AS {a}, c AS (SELECT DISTINCT category, cluster_id FROM a), s AS (SELECT DISTINCT category, source FROM a),
          x AS (SELECT l.category, r.category AS other, count(*) AS n FROM c l JOIN c r ON l.cluster_id = r.cluster_id AND l.category <> r.category GROUP BY 1, 2),
          y AS (SELECT l.category, r.category AS other, count(*) AS m FROM s l JOIN s r ON l.source = r.source AND l.category <> r.category GROUP BY 1, 2),
          z AS (SELECT x.category, x.other, {_q(f"{_d('1.2')} * n + {_d('0.26')} * coalesce(m, 0)")} AS score FROM x LEFT JOIN y ON x.category = y.category AND x.other = y.other)
          SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, other)::INTEGER AS place FROM z QUALIFY place <= 5""",
        "reprocessing": f"""WITH s AS (SELECT cluster_id, min(value) AS quality, count(*) AS n, max(created_at) AS newest FROM {a} GROUP BY 1)
          SELECT cluster_id, quality, n FROM s WHERE (quality < 20 AND {hours("newest")} <= 168) OR ({hours("newest")} <= 72 AND n >= 2) ORDER BY quality NULLS LAST, n DESC, newest DESC, cluster_id LIMIT 50""",
        "weights_after": f"SELECT source, category, count(*) AS weight, max(created_at) AS last_seen FROM {a} GROUP BY 1, 2",
        "retained": f"SELECT source, count(*) AS gone FROM {a} GROUP BY 1 HAVING min({hours('created_at')}) > 480",
    }
