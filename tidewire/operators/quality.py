"""The quality of articles by keyword tables and patterns, and what is rejected by it (R3, R2). A text is folded and taken apart
into words once; tables meet it by intersection, so they cost the same whatever their size."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wording
from tidewire.operators.gates import junk

#: Words of hard news (institutions and law; economy and services; actors abroad), and of soft content.
HARD = tuple(
    """sobranie parlament skupstina skupština vlada vladata minister ministerstvo ministerstvoto ministar ministarstvo
    premier premijer pretsedatel predsednik opstina opština zakon ustav referendum izbori sud pravosudje pravosuđe
    obvinitelstvo tuzilastvo tužilaštvo istraga policija kriminal diplomacija pregovori
    budzet budžet budzhet ekonomija inflacija berza trziste tržište ceni cene plati plate penzii penzije infrastruktura
    izgradba izgradnja energetika zdravstvo obrazovanie obrazovanje
    brisel vasington washington eu nato on sad un""".split()
)
SOFT = tuple(
    """horoskop horoskopot zvezdite zvezde astro predviduvanja predvidjanja predviđanja fustan haljina moda izgled razvod
    recept sostojki kujna vkusna dieta dijeta estrada rijaliti tiktoker influenser influencer galerija""".split()
) + ("foto galerija", "kursna lista", "loto rezultati")
#: Patterns of clickbait and of what concerns the public, in folded text.
CLICKBAIT = (
    r"\b(necete|ne cete)\s+verovati\b", r"\bnema\s+da\s+veruvate\b", r"\beve\s+sto\b", r"\bevo\s+sta\b", r"\b(shokantno|sokantno|skandalozno|senzacionalno)\b",
    r"\b(viralno|hit|gledajte|pogledajte)\b", r"\b(foto|video)\s*[:\-]", r"\bzena\s+otkriva\b",
)
INTEREST = (
    r"\b\d+(?:[,.]\d+)?\s*(milion|miliona|milioni|milijard|milijarda|milijardi|evra|eur|denari|dinara|procent|%)\b", r"\b\d{1,2}\.\s*\d{1,2}\.\s*\d{2,4}\b",
    r"\b(odluka|sednica|sjednica|rasprava|usvoji|usvojila|donese|donela|najavi|najavila)\b", r"\b(gradjani|gragjani|domacinstva|ucenici|pacienti|pacijenti)\b",
)
#: Fixed values of the score: where it starts, what a match adds up to which sum, what soft words and loud signs take.
BASE, PER_HARD, PER_INTEREST, PER_SOFT, PER_CLICKBAIT, LOUD, LOUDER = 0.48, (0.09, 0.3), (0.06, 0.16), (0.18, 0.45), (0.12, 0.35), 0.18, 0.1
RESCUED, TOO_SOFT, BAIT, REJECT, HARD_NEWS = 0.62, 0.28, 0.25, 0.3, 0.55


def fold_word(word: str) -> str:
    """A keyword as folded text has it."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


def folded_text(raw: Column) -> Column:
    """Latin script, lower case, without marks, with single spaces."""
    return F.regexp_replace(wording.folded(F.lower(wording.latin_in(raw))), r"[_/|\s]+", " ")


def table_matches(words: Column, text: Column, table: tuple[str, ...]) -> Column:
    """How many of a table's keywords a text holds: single ones among its words, phrases anywhere. Spellings of the table
    that fold into one count each, and so do words with letters that fold to none of a-z."""
    times = Counter(map(fold_word, table))
    word = {w: k for w, k in times.items() if w.isascii() and " " not in w}
    single = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in word if word[w] == n]))) * n for n in sorted(set(word.values()))]
    return reduce(lambda a, b: a + b, [*single, *[F.contains(text, F.lit(w)).cast("int") * k for w, k in times.items() if w not in word]])


def _patterns(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


def quality_rows(news: DataFrame, hard: tuple[str, ...] = HARD, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """`news` with quality (0 to 1, two digits), reason, and the matches it comes from (R3). Tables are parameters."""
    raw = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    rows = news.withColumn("raw_", raw).withColumn("text_", folded_text(F.col("raw_"))).withColumn("words_", F.array_distinct(F.regexp_extract_all("text_", F.lit("[a-z0-9]+"), F.lit(0))))
    text, words = F.col("text_"), F.col("words_")
    rows = rows.withColumns({
        "hard": table_matches(words, text, hard), "soft": table_matches(words, text, soft), "clickbait": _patterns(text, CLICKBAIT), "interest": _patterns(text, INTEREST),
        "penalty": F.when(F.contains("raw_", F.lit("!!!")) | F.contains("raw_", F.lit("???")), LOUD).otherwise(0.0) + F.when(F.col("raw_").rlike("[!?]{4,}"), LOUDER).otherwise(0.0),
    })
    upto = lambda c, k: F.least(F.lit(k[1]), F.col(c) * k[0])
    score = F.lit(BASE) + upto("hard", PER_HARD) + upto("interest", PER_INTEREST) - upto("soft", PER_SOFT) - (F.col("penalty") + upto("clickbait", PER_CLICKBAIT))
    policy = (F.col("hard") >= 2) & (F.col("interest") >= 1)
    score = F.when(policy, F.greatest(score, F.lit(RESCUED))).otherwise(score)
    score = F.when((F.col("hard") == 0) & (F.col("soft") >= 2), F.least(score, F.lit(TOO_SOFT))).otherwise(score)
    score = F.when((F.col("hard") == 0) & (F.col("clickbait") >= 2), F.least(score, F.lit(BAIT))).otherwise(score)
    rows = rows.withColumn("score_", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    reason = (
        F.when(F.col("score_") < REJECT, "junk").when((F.col("soft") > F.col("hard")), "soft").when(policy, "policy").when(F.col("hard") >= 2, "hard").otherwise("standard")
    )
    quality = F.floor(F.col("score_") * 100 + 0.5 + 1e-9) / 100  # a half in digits may lie just below one in bits
    return rows.withColumns({"quality_score": quality, "reason": reason, "hard_news": F.col("score_") >= HARD_NEWS}).drop("raw_", "text_", "words_", "penalty", "score_")


def article_quality(news: DataFrame) -> DataFrame:
    """The quality of each article, why, and its matches."""
    return quality_rows(news).select("id", "quality_score", "reason", "hard_news", "hard", "soft", "clickbait", "interest")


def rejected_articles(news: DataFrame) -> DataFrame:
    """Whether an article is rejected: junk by its words and form, or of a quality below .3 (R2)."""
    return quality_rows(news).select("id", (junk(F.col("title"), F.col("description")) | (F.col("quality_score") < REJECT)).alias("rejected"), "quality_score")
