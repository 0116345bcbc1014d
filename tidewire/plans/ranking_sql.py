"""SQL of the rankings."""

from __future__ import annotations

from tidewire.adapters import AS_OF, NEWS_SQL
from tidewire.plans.reports_sql import _q
from tidewire.plans.scores_sql import _d

NOW = f"TIMESTAMP '{AS_OF}'"
W = f"(credibility * CASE WHEN quality IS NULL THEN 1::DOUBLE ELSE greatest({_d('0.45')}, least({_d('1.05')}, {_d('0.55')} + quality * {_d('0.5')})) END)"


def hours(at: str) -> str:
    return f"((epoch_us({NOW}) - epoch_us({at})) / 3.6e9::DOUBLE)"


def words4(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r]+'), lambda x: length(x) >= 4))"


def overlap(a: str, b: str) -> str:
    """Jaccard similarity of long words, 0 where either has none."""
    both = f"len(list_intersect({words4(a)}, {words4(b)}))"
    return f"(CASE WHEN len({words4(a)}) > 0 AND len({words4(b)}) > 0 THEN {both}::DOUBLE / (len({words4(a)}) + len({words4(b)}) - {both}) ELSE 0::DOUBLE END)"


def tier(w: str) -> str:
    return f"CASE WHEN {w} >= 1.75::DOUBLE THEN 'high' WHEN {w} >= 1.3::DOUBLE THEN 'confirmed' ELSE 'followed' END"


RANKED = f"(SELECT *, {W} AS weight, row_number() OVER (PARTITION BY cluster_id ORDER BY {W} DESC, created_at DESC, id) AS rank FROM {NEWS_SQL})"
_SUMS = f"""SELECT cluster_id, count(*) AS n, sum(clicks) AS clicks, count(DISTINCT source) AS sources, max({hours("created_at")}) FILTER (rank = 1) AS hours,
    count(*) FILTER (length(trim(description)) > 0) AS described, avg(weight) FILTER (rank <= 3) AS trust FROM {RANKED} GROUP BY 1"""
_SCORED = f"""WITH s AS ({_SUMS}), h AS (SELECT cluster_id, sum(w) AS held FROM (SELECT DISTINCT cluster_id, source, {W} AS w FROM {NEWS_SQL}) GROUP BY 1),
  b AS (SELECT *, held * exp({_d("-0.115")} * hours) * ln(1::DOUBLE + n) * (1 + {_d("0.15")} * ln(1::DOUBLE + clicks)) AS x FROM s JOIN h USING (cluster_id)),
  y AS (SELECT *, x * (1 + least({_d("0.8")}, {_d("0.28")} * ln(1::DOUBLE + sources))) * (1 + least({_d("0.35")}, {_d("0.08")} * described)) AS synth,
    x * (1 + greatest(0::DOUBLE, least({_d("0.22")}, {_d("0.16")} * (trust - 1)))) * CASE WHEN sources <= 1 THEN {_d("0.65")} WHEN sources = 2 THEN {_d("1.12")} ELSE {_d("1.22")} END AS home FROM b)
  SELECT cluster_id, n, sources, {_q("x", 5)} AS score, {_q("synth", 5)} AS synthesis, {_q("home", 5)} AS homepage, {_q("home + 5::DOUBLE * least(sources, 8)", 5)} AS feed FROM y"""


def ranking_sql() -> dict[str, str]:
    numbers = lambda t: f"list_transform(regexp_extract_all({t}, '[0-9]+(?:[.,][0-9]+)*'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g') ELSE replace(x, ',', '.') END)"
    h = f"greatest(0::DOUBLE, {hours('newest')})"
    told = "concat_ws(' ', title, description)"
    balanced = lambda n, s, c: f"({n} >= 3 AND ({s} >= 4 OR {c} >= 2))"
    return {
        "source_weights": f"SELECT DISTINCT source, {_q(W)} AS weight, {tier(W)} AS tier FROM {NEWS_SQL}",
        "story_scores": _SCORED,
        "lead_story": f"WITH t AS (SELECT * FROM ({_SCORED}) ORDER BY homepage DESC, cluster_id LIMIT 4) SELECT cluster_id, sources, homepage FROM t ORDER BY sources < 2, homepage DESC, cluster_id LIMIT 1",
        "source_roles": f"""WITH r AS {RANKED}, p AS (SELECT a.id, count(*) FILTER ({overlap("a.title", "b.title")} >= {_d("0.3")}) AS corroborated FROM r a JOIN r b ON a.cluster_id = b.cluster_id AND a.id <> b.id GROUP BY 1),
          l AS (SELECT cluster_id, title AS lead_title, created_at AS lead_at FROM r WHERE rank = 1), f AS (SELECT cluster_id, min(created_at) AS first_at FROM r GROUP BY 1),
          e AS (SELECT r.*, lead_title, lead_at, first_at, coalesce(corroborated, 0) AS corroborated, CASE WHEN rank = 1 THEN 1::DOUBLE ELSE {overlap("title", "lead_title")} END AS x
            FROM r JOIN l USING (cluster_id) JOIN f USING (cluster_id) LEFT JOIN p ON p.id = r.id)
          SELECT id, cluster_id, corroborated, CASE WHEN rank = 1 AND corroborated >= 2 THEN 'confirm' WHEN rank = 1 AND weight >= {_d("1.6")} THEN 'lead' WHEN created_at <= first_at AND weight >= {_d("1.3")} THEN 'lead'
            WHEN x < {_d("0.22")} THEN 'contrast' WHEN created_at > lead_at + INTERVAL 90 MINUTE THEN 'context' WHEN x >= {_d("0.4")} THEN 'confirm' ELSE 'context' END AS role FROM e""",
        "coverage": f"""WITH r AS {RANKED}, s AS (SELECT cluster_id, count(DISTINCT CASE WHEN weight >= {_d("1.3")} THEN 'M' WHEN weight >= {_d("0.9")} THEN 'I' ELSE 'R' END) AS tiers, count(*) AS n,
            count(DISTINCT source) AS s, count(DISTINCT category) AS c, max(title) FILTER (rank = 1) AS lead FROM r GROUP BY 1),
          x AS (SELECT r.id, r.cluster_id, rank, tiers, n, s, c, {overlap("title", "lead")} AS x FROM r JOIN s USING (cluster_id))
          SELECT id, cluster_id, CASE WHEN tiers >= 3 THEN 'full' WHEN tiers = 2 THEN 'partial' END AS label, {balanced("n", "s", "c")} AS balanced,
            CASE WHEN rank = 1 THEN 'lead' WHEN x >= {_d("0.45")} THEN 'same' WHEN x >= {_d("0.2")} THEN 'related' ELSE 'context' END AS relation FROM x""",
        "summary_freshness": f"""WITH p AS (SELECT *, {W} AS weight, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, id) AS place, count(*) OVER (PARTITION BY cluster_id) AS size FROM {NEWS_SQL}),
          q AS (SELECT *, CASE WHEN cluster_id NOT LIKE '%3' THEN max(created_at) FILTER (place = (size + 1) // 2) OVER (PARTITION BY cluster_id) END AS summary_at FROM p),
          w AS (SELECT *, coalesce(created_at > summary_at, false) AS newer, coalesce(created_at <= summary_at, false) AS older, {numbers(told)} AS ns FROM q),
          s AS (SELECT cluster_id, summary_at, count(*) FILTER (newer) AS newer, list(DISTINCT source) FILTER (newer) AS a, list(DISTINCT source) FILTER (older) AS b,
            flatten(list(ns) FILTER (newer)) AS na, flatten(list(ns) FILTER (older)) AS nb, arg_min(title, (created_at, id)) FILTER (newer) AS new_title, arg_min(title, (created_at, id)) FILTER (older) AS old_title,
            max(weight) FILTER (newer) AS best, count(*) AS n, count(DISTINCT source) AS s, count(DISTINCT category) AS c, count(DISTINCT category) FILTER (older) AS old_c FROM w GROUP BY 1, 2),
          t AS (SELECT *, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS added, len(list_filter(coalesce(na, []), lambda x: NOT list_contains(coalesce(nb, []), x))) AS counted FROM s),
          u AS (SELECT *, CASE WHEN added > 0 THEN least(2::DOUBLE, 1 + {_d("0.4")} * added) ELSE 0::DOUBLE END + CASE WHEN counted > 0 THEN {_d("1.1")} ELSE 0 END
            + CASE WHEN newer > 0 AND {overlap("new_title", "old_title")} < {_d("0.26")} THEN {_d("0.9")} ELSE 0 END + CASE WHEN newer >= 2 THEN {_d("0.5")} ELSE 0 END + CASE WHEN best >= {_d("1.45")} THEN {_d("0.65")} ELSE 0 END
            + CASE WHEN newer > 0 AND {balanced("n", "s", "c")} AND NOT {balanced("(n - newer)", "len(b)", "old_c")} THEN {_d("1.2")} ELSE 0 END AS score FROM t),
          v AS (SELECT *, (score >= 2 OR newer >= 4) AND NOT ({hours("summary_at")} * 60 < CASE WHEN score >= 4 THEN 20 ELSE 40 END AND newer < 2 AND added = 0) AS due FROM u)
          SELECT cluster_id, newer, CASE WHEN summary_at IS NULL THEN 0::DOUBLE ELSE {_q("score", 3)} END AS score, summary_at IS NULL OR due AS refresh,
            CASE WHEN summary_at IS NULL THEN 'missing' WHEN due THEN 'stale' ELSE 'fresh' END AS reason FROM v""",
        "editor_signals": f"""WITH r AS {RANKED}, c AS ({_SCORED}), s AS (SELECT cluster_id, max(created_at) AS newest, count(*) FILTER ({hours("created_at")} <= 6) AS recent, count(DISTINCT source) AS s, count(*) AS n,
            avg(weight) FILTER (rank <= 3) AS trusted, max(topic) FILTER (rank = 1) AS topic FROM r GROUP BY 1),
          a AS (SELECT s.*, c.score, c.homepage, {h} AS h FROM s JOIN c USING (cluster_id)),
          b AS (SELECT *, least(10::DOUBLE, CASE WHEN h <= 12 THEN 10 - {_d("0.45")} * h WHEN h <= 36 THEN {_d("4.6")} - {_d("0.11")} * (h - 12) ELSE greatest(0::DOUBLE, {_d("1.96")} - {_d("0.18")} * (h - 36)) END
              + least({_d("1.6")}, {_d("0.45")} * greatest(0, recent - 1))) AS fresh, least(10::DOUBLE, {_d("1.85")} * (s - 1) + least(2::DOUBLE, {_d("0.6")} * recent)) AS grown FROM a),
          d AS (SELECT *, least(10::DOUBLE, fresh * CASE WHEN s <= 2 THEN 1::DOUBLE ELSE {_d("0.65")} END + CASE WHEN n = 1 THEN {_d("1.25")} ELSE 0 END) AS new_,
            CASE WHEN h >= 36 THEN 'stale' WHEN score >= {_d("4.5")} THEN 'breaking' WHEN s >= 3 AND recent >= 2 THEN 'developing' WHEN s >= 2 THEN 'confirmed' ELSE 'singleton' END AS state,
            topic IN ('politics', 'economy', 'crime', 'sport', 'technology') AS hard FROM b)
          SELECT cluster_id, {_q("fresh", 4)} AS freshness, {_q("grown", 4)} AS development, {_q("least(10::DOUBLE, 5 * trusted)", 4)} AS trust, {_q("least(10::DOUBLE, 3 * homepage)", 4)} AS importance, {_q("new_", 4)} AS novelty, state,
            {_q(f"fresh + grown + CASE WHEN state = 'breaking' THEN {_d('2.5')} ELSE 0 END + CASE WHEN hard THEN {_d('1.2')} ELSE 0 END", 4)} AS live,
            {_q("fresh + new_ + CASE WHEN s <= 1 THEN 1::DOUBLE ELSE 0 END + CASE WHEN hard THEN 1::DOUBLE ELSE 0 END", 4)} AS wire FROM d""",
        "source_reputation": f"""WITH a AS (SELECT *, {W} AS weight FROM {NEWS_SQL}), t AS (SELECT cluster_id, arg_min(source, (created_at, id)) AS source, count(DISTINCT source) AS s FROM a WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1),
          l AS (SELECT source, count(*) AS firsts, count(*) FILTER (s >= 2) AS backed, count(*) FILTER (s = 1) AS alone FROM t GROUP BY 1),
          v AS (SELECT source, max(weight) AS w, count(*) AS volume, count(*) FILTER (created_at >= {NOW} - INTERVAL 7 DAY) - count(*) FILTER (created_at >= {NOW} - INTERVAL 14 DAY AND created_at < {NOW} - INTERVAL 7 DAY) AS change FROM a GROUP BY 1),
          k AS (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, category) AS place FROM a GROUP BY 1, 2),
          m AS (SELECT source, string_agg(category, ',' ORDER BY place) AS top FROM k WHERE place <= 3 GROUP BY 1)
          SELECT source, {_q("w")} AS weight, {tier("w")} AS tier, volume, coalesce(firsts, 0) AS firsts, CASE WHEN firsts > 0 THEN {_q("backed::DOUBLE / firsts", 2)} ELSE 0::DOUBLE END AS corroboration,
            CASE WHEN firsts > 0 THEN {_q("alone::DOUBLE / firsts", 2)} ELSE 0::DOUBLE END AS solo, CASE WHEN change >= 4 THEN 'up' WHEN change <= -4 THEN 'down' ELSE 'flat' END AS trend,
            coalesce(firsts, 0) >= 5 AS first_mover, top FROM v JOIN m USING (source) LEFT JOIN l USING (source)""",
    }
