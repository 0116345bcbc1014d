"""SQL of the names."""

from __future__ import annotations

from tidewire.adapters import NEWS_SQL


def entities_sql() -> dict[str, str]:
    word = r"([^\p{L}]*)(\p{L}[\p{L}\p{N}_\-]*)"
    acronym = lambda w: f"(length({w}) >= 2 AND {w} = upper({w}) AND {w} <> lower({w}))"
    capital = "(word[1] <> lower(word[1]))"
    definite, surname = "(от|иот|ата|ото|ите)$", "(ов|ев|ова|ева|ски|ска|ин|ина|ќ|ић|ич|ак|ек|ко)$"
    places = "('скопје', 'битола', 'охрид', 'македонија', 'србија', 'грција', 'софија', 'белград', 'лондон', 'париз', 'берлин', 'мадрид')"
    kind = f"""CASE WHEN lower(name) IN {places} THEN 'LOC' WHEN len(ws) = 1 AND {acronym('name')} THEN 'ORG' WHEN len(ws) = 1 THEN 'MISC'
      WHEN len(list_filter(ws, lambda w: {acronym('w')} OR lower(w) IN ('group', 'inc', 'ltd'))) > 0 THEN 'ORG' WHEN len(list_filter(ws, lambda w: lower(w) IN {places})) > 0 THEN 'MISC' ELSE 'PER' END"""
    base = rf"""n AS {NEWS_SQL}, x AS (SELECT id, 'title' AS part, title AS text FROM n UNION ALL SELECT id, 'description', description FROM n),
      y AS (SELECT id, part, regexp_extract_all(text, '{word}', 1) AS g, regexp_extract_all(text, '{word}', 2) AS w, regexp_matches(text, '\p{{L}}[\p{{L}}\p{{N}}_\-]*[:,][^\p{{L}}]*$') AS p FROM x WHERE length(text) > 0 AND text <> upper(text)),
      z AS (SELECT id, part, p, g, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM y),
      t AS (SELECT id, part, i, word, lower(word) AS key, (i = 0 AND g[1] = '') OR regexp_matches(g[i + 1], '[.!?:„“"«()\n]\s*$') AS opens, i > 0 AND g[i + 1] = ' ' AS joins,
        CASE WHEN i = n - 1 THEN p ELSE g[i + 2][1] IN (':', ',') END AS pauses FROM z),
      s AS (SELECT key, high / (low + high)::DOUBLE AS share FROM (SELECT key, count(*) FILTER (word = lower(word)) AS low, count(*) FILTER (word <> lower(word) AND {capital} AND NOT opens) AS high FROM t WHERE length(word) >= 3 GROUP BY 1) WHERE low + high >= 3)"""
    names = f"""u AS (SELECT t.*, share FROM t LEFT JOIN s USING (key) WHERE {capital} AND (length(word) >= 3 OR {acronym('word')}) AND key NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'are', 'was') AND ({acronym('word')} OR share IS NULL OR share >= 0.4::DOUBLE)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY id, part ORDER BY i) AS run FROM (SELECT *, CASE WHEN joins AND coalesce(lag(i) OVER (PARTITION BY id, part ORDER BY i) = i - 1, false) THEN 0 ELSE 1 END AS fresh FROM u)),
      c AS (SELECT *, (row_number() OVER (PARTITION BY id, part, run ORDER BY i) - 1) // 3 AS chunk FROM r),
      k AS (SELECT id, part, min(i) AS i, count(*) AS n, bool_and({acronym('word')}) AS shouted, arg_min(key, i) AS k0, arg_min(opens, i) AS o0, arg_min(pauses, i) AS p0, arg_min(coalesce(share >= 0.6::DOUBLE, false), i) AS known,
        string_agg(regexp_replace(word, '([ае])и([бцдфгхклмнпрстзв](?:ов|ев)(?:а|и|у|е|о|ом|ој|их|им|има)?)$', '\\1ј\\2'), ' ' ORDER BY i) AS name FROM c GROUP BY id, part, run, chunk),
      f AS (SELECT id, part, i, name FROM k WHERE NOT (n > 1 AND shouted) AND NOT (n = 1 AND NOT shouted AND (k0 IN ('комисија', 'влада', 'банка', 'суд', 'премиер') OR (regexp_matches(k0, '{definite}') AND length(k0) >= 6)))
        AND NOT (n = 1 AND NOT shouted AND o0 AND NOT (p0 OR known))),
      d AS (SELECT id, part, name, min(i) AS i FROM (SELECT id, part, i, CASE WHEN length(name) > 3 AND {acronym('name')} AND lower(name) IN {places} THEN name[1] || lower(name[2:]) ELSE name END AS name FROM f) GROUP BY 1, 2, 3),
      e AS (SELECT id, part, name FROM d QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY i) <= 12)"""
    stories = f"""w AS (SELECT DISTINCT name, string_split(name, ' ') AS ws FROM e),
      l AS (SELECT key, min(name) AS whole FROM (SELECT lower(ws[-1]) AS key, name FROM w WHERE len(ws) >= 2 AND len(list_filter(ws, lambda v: regexp_matches(lower(v), '{definite}') AND length(v) >= 6)) = 0 AND {kind} = 'PER') GROUP BY 1 HAVING count(*) = 1),
      a AS (SELECT name, whole FROM w JOIN l ON lower(name) = key WHERE len(ws) = 1 AND NOT {acronym('name')} AND lower(name) NOT IN {places} AND regexp_matches(lower(name), '{surname}')),
      b AS (SELECT cluster_id, coalesce(whole, name) AS name, id, max((part = 'title')::INTEGER) AS t FROM e LEFT JOIN a USING (name) JOIN n USING (id) GROUP BY 1, 2, 3),
      m AS (SELECT cluster_id, name, count(*) AS mentions, sum(t)::BIGINT AS in_title FROM b GROUP BY 1, 2 HAVING sum(t) > 0 OR count(*) >= 2),
      o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY in_title DESC, mentions DESC, length(name) DESC, name)::INTEGER AS place, string_split(name, ' ') AS ws FROM m QUALIFY place <= 8)"""
    return {
        "story_entities": f"WITH {base}, {names}, {stories} SELECT cluster_id, place, name, {kind} AS type, mentions, in_title FROM o",
        "word_roles": f"WITH {base} SELECT key, floor(share * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS share FROM s",
    }
