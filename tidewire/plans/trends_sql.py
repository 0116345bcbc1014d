"""SQL of the rising words. Cyrillic letters stay, which the test tables do not hold."""

from __future__ import annotations

from tidewire.adapters import AS_OF, NEWS_SQL
from tidewire.plans.reports_sql import _q


def trends_sql(spellings: dict[str, str], unit: float) -> dict[str, str]:
    stop = "('that', 'this', 'with', 'from', 'have', 'were', 'they', 'para', 'como', 'dans', 'pour', 'nicht', 'eine', 'oder', 'sind')"
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in spellings.items()) + "}"
    bare = "translate(latin, 'ćčšžđќ', 'ccszdc')"
    return {
        "rising_words": rf"""WITH a AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3.6e9::DOUBLE / {unit}::DOUBLE AS age FROM {NEWS_SQL}), n AS (SELECT * FROM a WHERE age <= 12 ORDER BY created_at DESC, id DESC LIMIT 3000),
          l AS (SELECT cluster_id FROM n GROUP BY 1 HAVING count(*) >= 4), p AS (SELECT id, unnest(range(len(x))) AS s, unnest(x) AS sentence FROM (SELECT id, regexp_split_to_array(title, '[.!?]+') AS x FROM n)),
          t AS (SELECT id, s, unnest(range(len(x))) AS i, unnest(x) AS raw FROM (SELECT id, s, regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_''’-]+') AS x FROM p)),
          w AS (SELECT id, s, i, w, lower(w) AS latin FROM (SELECT id, s, i, regexp_replace(raw, '^[''’-]+|[''’-]+$', '', 'g') AS w FROM t) WHERE length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$')),
          k AS (SELECT id, s, i, coalesce({table}[latin], {table}[{bare}], regexp_replace(latin, '([ae])i([bcdfghklmnprstvz](?:ov|ev)(?:a|i|u|e|o|om|oj|ih|im|ima)?)$', '\1j\2')) AS word, w[1] <> lower(w[1]) AND i > 0 AS name
            FROM w WHERE latin NOT IN {stop} AND {bare} NOT IN {stop}),
          o AS (SELECT id, word, arg_min(name, (s, i)) AS name FROM k WHERE word <> 'makedonija' GROUP BY 1, 2),
          j AS (SELECT word, category, age, CASE WHEN name THEN 4.0::DOUBLE ELSE 1 END AS x, cluster_id IN (SELECT cluster_id FROM l) AS large FROM o JOIN n USING (id)),
          g AS (SELECT word, count(*) AS n, sum(CASE WHEN age <= 1.5 THEN 3 * x ELSE 0 END) AS h, sum(CASE WHEN age > 1.5 AND age <= 4.5 THEN 2 * x ELSE 0 END) AS r, sum(CASE WHEN age > 4.5 THEN x ELSE 0 END) AS b, count(DISTINCT category) AS c,
            bool_or(age <= 1.5 AND large) AS large FROM j GROUP BY 1 HAVING count(*) >= 2)
          SELECT CASE word WHEN 'eu' THEN 'EU' WHEN 'nato' THEN 'NATO' WHEN 'sad' THEN 'SAD' WHEN 'vucic' THEN 'Vučić' ELSE array_to_string(list_transform(string_split(word, ' '), lambda v: upper(v[1]) || v[2:]), ' ') END AS word, n,
            {_q("(2 * h + 1.2::DOUBLE * r + 0.5::DOUBLE * b) * CASE WHEN c >= 2 THEN 1 + 0.15::DOUBLE * c ELSE 1 END", 4)} AS score,
            CASE WHEN h > (r + b) * 0.8::DOUBLE AND h > 6 THEN 'surging' WHEN h + r > 1.5::DOUBLE * b THEN 'up' WHEN b > 2 * (h + r) THEN 'down' ELSE 'flat' END AS trend, large OR (h > 15 AND c >= 2) AS breaking
          FROM g ORDER BY score DESC, word LIMIT 12""",
    }
