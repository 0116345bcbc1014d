"""SQL of the wording queries, from the same fixed values."""

from __future__ import annotations

from functools import reduce

from tidewire.functions.wording import CALIBRATION, CYRILLIC, DIGRAPHS, ENTITY, LATIN, STOPWORDS, SUFFIXES, TOKEN
from tidewire.plans.reports_sql import _q

_TITLE = "split_part(text, chr(10), 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _calibrated(x: str, back: bool) -> str:
    points = [p[::-1] for p in CALIBRATION] if back else list(CALIBRATION)
    steps = "".join(f" WHEN {x} <= {c!r}::DOUBLE THEN {b!r}::DOUBLE + {d - b!r}::DOUBLE * (({x} - {a!r}::DOUBLE) / {c - a!r}::DOUBLE)" for (a, b), (c, d) in zip(points, points[1:], strict=False))
    return f"CASE WHEN {x} <= {points[0][0]!r}::DOUBLE THEN {points[0][1]!r}::DOUBLE{steps} ELSE {points[-1][1]!r}::DOUBLE END"


def words_sql() -> dict[str, str]:
    pairs = reduce(lambda t, p: f"replace({t}, '{p[1]}', '{p[0]}')", DIGRAPHS, _TITLE)
    stems = f"list_transform(list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda w: NOT list_contains({_STOP}, w)), lambda w: regexp_replace(w, '^(.{{3,}})({'|'.join(SUFFIXES)})$', '\\1'))"
    found = f"list_distinct(list_filter(list_transform(regexp_extract_all({_TITLE}, '{ENTITY}', 1), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w)))"
    x = "((event_id % 2100) / 1000.0::DOUBLE)"
    return {
        "title_keys": rf"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(trim(regexp_replace(coalesce({_TITLE}, ''), '<[^>]+>', ' ', 'g'))), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
          b AS (SELECT doc_id, CASE WHEN w[1] IN ('[live]', '[update]', '[breaking]', '[video]', '[photo]') OR regexp_full_match(w[1], '(live|update|updated|breaking)[:-]+') THEN w[2:] ELSE w END AS w FROM a),
          c AS (SELECT doc_id, CASE WHEN len(w) > 1 AND w[-1] IN ('video', 'photo', 'gallery') AND w[-2] IN ('-', '–', '—', '|') THEN w[:-3] ELSE w END AS w FROM b),
          d AS (SELECT doc_id, list_filter(list_transform(list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9]{{1,2}}:[0-9]{{2}}[,.;!?]*')), lambda x: regexp_replace(x, '["''“”‘’`!?,.;:()\[\]{{}}]', '', 'g')), lambda x: x NOT IN ('', 'live', 'update', 'updates', 'updated')) AS w FROM c)
          SELECT doc_id, regexp_replace(array_to_string(w, ' '), '( [-–—|])+$', '') AS key FROM d""",
        "folded_titles": f"SELECT doc_id, strip_accents({_TITLE}) AS title FROM documents",
        "cyrillic_titles": f"SELECT doc_id, CASE WHEN regexp_matches({_TITLE}, '[Ѐ-ӿ]') THEN {_TITLE} ELSE translate({pairs}, '{LATIN + LATIN.upper()}', '{CYRILLIC + CYRILLIC.upper()}') END AS title FROM documents",
        "embedding_texts": f"""SELECT doc_id, {_TITLE} || '. ' || substring(trim(regexp_replace(regexp_replace(text, '^[^\\n]*\\n?', ''), '<[^>]+>', ' ', 'g')), 1, 300) AS input FROM documents""",
        "stem_counts": f"WITH w AS (SELECT unnest({stems}) AS stem FROM documents) SELECT stem, count(*) AS n FROM w GROUP BY 1",
        "entity_counts": f"WITH w AS (SELECT source, unnest({found}) AS entity FROM documents) SELECT entity, count(*) AS n, count(DISTINCT source) AS n_sources FROM w GROUP BY 1",
        "turn_cosine": f"""WITH t AS (SELECT conv_id, turn, unnest({stems}) AS stem FROM conversations), w AS (SELECT conv_id, turn, stem, count(*) AS n FROM t GROUP BY 1, 2, 3),
          l AS (SELECT conv_id, turn, sum(n * n) AS norm FROM w GROUP BY 1, 2), d AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS dot FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.stem = b.stem GROUP BY 1, 2)
          SELECT a.conv_id, a.turn, {_q("coalesce(dot, 0)::DOUBLE / sqrt((a.norm * b.norm)::DOUBLE)", 4)} AS cosine FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN d ON d.conv_id = a.conv_id AND d.turn = a.turn""",
        "calibrated_distances": f"SELECT event_id, {_q(_calibrated(x, False))} AS there, {_q(_calibrated(x, True))} AS back FROM events",
        "centred_vectors": f"""WITH p AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS mean FROM p GROUP BY 1),
          c AS (SELECT vec_id, i, x - mean AS x FROM p JOIN m USING (i)), l AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM c GROUP BY 1)
          SELECT vec_id, i, {_q("CASE WHEN norm > 0 THEN x / norm ELSE x END", 4)} AS x FROM c JOIN l USING (vec_id)""",
    }
