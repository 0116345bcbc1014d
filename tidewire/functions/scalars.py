"""Scalar functions as column expressions: titles, word overlap, numbers in text, tone, times, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.adapters import AS_OF

#: Words that count for and against; callers may pass their own.
FOR, AGAINST = ("good", "great", "win", "growth", "success"), ("bad", "crisis", "war", "loss", "attack")


def quiet_title(title: Column) -> Column:
    """Sentence case where more than five letters are, under 20 % of them, lower-case."""
    letters, low = F.regexp_count(title, F.lit(r"\p{L}")), F.regexp_count(title, F.lit(r"\p{Ll}"))
    calm = F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substring(title, 2, 1 << 30)))
    return F.when((letters > 5) & (low * 5 < letters), calm).otherwise(title)


def long_words(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words, split at white space, of `least` characters on."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: F.length(w) >= least))


def overlap(a: Column, b: Column, least: int = 4) -> Column:
    """Jaccard similarity of the two texts' long words; 0 where either has none (F16, F17 with least=1)."""
    return words_overlap(long_words(a, least), long_words(b, least))


def words_overlap(x: Column, y: Column) -> Column:
    """Jaccard similarity of two word sets; 0 where either is empty."""
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))


def numbers(text: Column) -> Column:
    """Numbers of a text: points and commas before three digits group thousands, one before others is decimal."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    plain = lambda n: F.when(n.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"), F.regexp_replace(n, "[.,]", "")).otherwise(F.regexp_replace(n, ",", "."))
    return F.transform(found, plain)


def tone(text: Column, good: tuple[str, ...] = FOR, bad: tuple[str, ...] = AGAINST) -> Column:
    """(p - n) / (p + n) over distinct lower-case words, split at white space, so punctuation stays on them; 0 where none
    is known (F30)."""
    words = F.array_distinct(F.split(F.lower(text), r"[ \t\n\r]+"))
    known = lambda of: F.size(F.array_intersect(words, F.array(*map(F.lit, of))))
    p, n = known(good), known(bad)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))


def entry_time(at: Column, now: str = AS_OF) -> Column:
    """The clock for times over 30 minutes ahead of it or over 14 days back, and for null."""
    clock = F.lit(now).cast("timestamp_ntz")
    fine = (at <= clock + F.expr("interval 30 minutes")) & (at >= clock - F.expr("interval 14 days"))
    return F.when(fine, at).otherwise(clock)


def ad_cents(price: Column, promo: float = 0.15, least: int = 50) -> Column:
    """Price in cents after the promotion, rounded, `least` at the lowest."""
    return F.greatest(F.floor(price * 100.0 * (1.0 - promo) + 0.5), F.lit(least)).cast("long")
