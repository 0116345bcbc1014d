"""SQL of the articles of pages."""

from __future__ import annotations

_BLOCKS = "address|article|blockquote|body|br|center|dd|details|div|dl|dt|figcaption|figure|h[1-6]|head|header|html|li|main|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
_MARKS = r"""(^|[\s"''_-])(ad|ads|advert|banner|breadcrumbs?|comments?|cookie|footer|menu|newsletter|promo|related|share|sidebar|social|sponsor|tags|widget)($|[\s"''_-])"""
_WORDS = """the and of to in is it that for was on are with as be by this from or an der die das und ist nicht von zu mit den ein eine im für auf
  le la les des du et est un une dans que qui pour par sur pas el los las del y en por con se""".split()


def pages_sql() -> dict[str, str]:
    bare = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg"):
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '{chr(0xE000)}', 'g')"

    def plain(x: str) -> str:
        text = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
        for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
            text = f"replace({text}, '{a}', '{b}')"
        return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"

    around = lambda c, fit, what: f"coalesce({what}(CASE WHEN {fit} THEN {c} END IGNORE NULLS) OVER {'p' if what == 'last' else 'q'}, 'bad')"
    windows = "WINDOW p AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    sure = "kind IN ('good', 'bad')"
    return {
        "page_articles": rf"""WITH c AS (SELECT page_id, string_split(regexp_replace({bare}, '(?i)<(/?(?:{_BLOCKS})\b[^>]*)>', '{chr(0xE000)}\1{chr(0xE001)}', 'g'), '{chr(0xE000)}') AS l FROM pages),
          b AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS block FROM c),
          s AS (SELECT page_id, i, CASE WHEN contains(block, '{chr(0xE001)}') THEN lower(split_part(block, '{chr(0xE001)}', 1)) ELSE '' END AS tag, string_split(block, '{chr(0xE001)}')[-1] AS body FROM b),
          t AS (SELECT page_id, i, {plain('body')} AS text, regexp_matches(tag, '^h[1-6]') AS heading, regexp_matches(regexp_extract(tag, '(?:class|id)\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), '{_MARKS}') OR regexp_matches(tag, '^title') AS marked,
            length({plain(r"array_to_string(regexp_extract_all(body, '(?is)<a\b[^>]*>(.*?)</a>', 1), ' ')")}) AS linked FROM s),
          w AS (SELECT *, length(text) AS n, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM t WHERE text <> ''),
          f AS (SELECT *, len(list_filter(ws, lambda x: x IN ({", ".join(f"'{x}'" for x in _WORDS)}))) / greatest(1, len(ws))::DOUBLE AS share FROM w),
          k AS (SELECT *, CASE WHEN marked OR linked > n * 0.2::DOUBLE THEN 'bad' WHEN n < 70 THEN CASE WHEN linked > 0 THEN 'bad' ELSE 'short' END WHEN share >= 0.2::DOUBLE THEN CASE WHEN n >= 200 THEN 'good' ELSE 'near' END
            WHEN share >= 0.1::DOUBLE THEN 'near' ELSE 'bad' END AS kind FROM f),
          u AS (SELECT *, CASE WHEN kind <> 'near' THEN kind WHEN {around("kind", sure, "last")} = 'bad' AND {around("kind", sure, "first")} = 'bad' THEN 'bad' ELSE 'good' END AS sure FROM k {windows}),
          v AS (SELECT *, {around("sure", "sure <> 'short'", "last")} AS x, {around("sure", "sure <> 'short'", "first")} AS y FROM u {windows}),
          g AS (SELECT *, CASE WHEN sure <> 'short' THEN sure = 'good' WHEN heading THEN y = 'good' ELSE x = 'good' AND y = 'good' END AS good FROM v)
          SELECT page_id, count(*) AS n_blocks, count(*) FILTER (good) AS n_good, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (good), '') AS article FROM g GROUP BY 1""",
    }
