"""Words as column expressions: keys of titles, scripts, accents, stems, entities, calibration of distances."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that stemming removes.
SUFFIXES = ("anje", "enje", "ови", "еви", "ите", "ата")
#: Pairs of equal distances on two scales; between them both are linear.
CALIBRATION = (
    (0.0, 0.0), (0.05, 0.131), (0.10, 0.213), (0.15, 0.278), (0.18, 0.313), (0.22, 0.358), (0.28, 0.427), (0.35, 0.501),
    (0.40, 0.555), (0.50, 0.643), (0.60, 0.715), (0.70, 0.802), (0.80, 0.893), (1.0, 1.074), (2.0, 2.0),
)
#: The Serbian alphabet in both scripts.
CYRILLIC, LATIN = "абвгдђежзијклмнопрстћуфхцчш", "abvgdđežzijklmnoprstćufhcčš"
DIGRAPHS = (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž"))
#: Words that are no tokens and no entities; callers may pass their own.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "der", "die", "das", "les", "des", "los", "las")
#: Marks of titles that run on or show something: anywhere, in brackets or before a colon at the start, after a dash at the end.
RUNNING, OPENING, CLOSING = ("live", "update", "updates", "updated"), ("live", "update", "updated", "breaking"), ("video", "photo", "gallery")
BRACKETED = ("[live]", "[update]", "[breaking]", "[video]", "[photo]")
DASHES, PUNCTUATION = ("-", "–", "—", "|"), "\"'“”‘’`!?,.;:()[]{}"
ENTITY = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_-]+[\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}_-]{3,}"


def title_key(title: Column) -> Column:
    """A title for comparison, word by word: without tags, live marks, times, quotes, punctuation and capitals."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]+>", " ")))
    words = F.filter(F.split(plain, "[ \t\n\r\f]+"), lambda w: w != "")
    first = F.get(words, F.lit(0))
    opening = first.isin(*BRACKETED) | F.rtrim(first, F.lit(":-")).isin(*OPENING) & first.rlike("[:-]$")
    words = F.when(opening, F.slice(words, 2, 1 << 30)).otherwise(words)
    n = F.size(words)
    shown = (n > 1) & F.get(words, n - 1).isin(*CLOSING) & F.get(words, n - 2).isin(*DASHES)
    words = F.when(shown, F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(words)
    words = F.filter(words, lambda w: ~w.rlike("^[0-9]{1,2}:[0-9]{2}[,.;!?]*$"))
    words = F.filter(F.transform(words, lambda w: F.translate(w, PUNCTUATION, "")), lambda w: (w != "") & ~w.isin(*RUNNING))
    return F.regexp_replace(F.array_join(words, " "), "( [-–—|])+$", "")


def accents() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended that decompose into a letter and marks, and that letter."""
    split = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)]}
    known = {c: d[0] for c, d in split.items() if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])}
    return "".join(known), "".join(known.values())


def folded(text: Column) -> Column:
    """Without diacritics."""
    return F.translate(text, *accents())


def to_latin(text: Column) -> Column:
    """Cyrillic letters in Latin script."""
    pairs = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), DIGRAPHS, text)
    return F.translate(pairs, CYRILLIC + CYRILLIC.upper(), LATIN + LATIN.upper())


def to_cyrillic(text: Column) -> Column:
    """Latin letters in Cyrillic script, digraphs first; a text with a Cyrillic letter stays."""
    pairs = reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), DIGRAPHS, text)
    return F.when(text.rlike("[Ѐ-ӿ]"), text).otherwise(F.translate(pairs, LATIN + LATIN.upper(), CYRILLIC + CYRILLIC.upper()))


def stems(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case tokens of three characters on but stop words, each without its suffix where three characters stay."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*stop))
    return F.transform(words, lambda w: F.regexp_replace(w, f"^(.{{3,}})({'|'.join(SUFFIXES)})$", "$1"))


def title_entities(title: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct capitalised words of three characters on, lower-cased, but stop words."""
    found = F.transform(F.regexp_extract_all(title, F.lit(ENTITY), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop)))


def calibrated(x: Column, back: bool = False) -> Column:
    """A distance on the other scale, linear between the fixed pairs."""
    points = [p[::-1] for p in CALIBRATION] if back else list(CALIBRATION)
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, b), (c, d) in zip(points, points[1:], strict=False):
        out = out.when(x <= c, F.lit(b) + F.lit(d - b) * ((x - F.lit(a)) / F.lit(c - a)))
    return out.otherwise(F.lit(points[-1][1]))


def embedding_text(text: Column, most: int = 300) -> Column:
    """First line, a point, and the first characters of the rest without tags."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, "^[^\n]*\n?", ""), "<[^>]+>", " "))
    return F.concat(F.substring_index(text, "\n", 1), F.lit(". "), F.substring(rest, 1, most))


#: How three readers of Cyrillic write letters that are not one plain letter in Latin script. The rest of
#: the alphabet is CYRILLIC and LATIN above.
STYLES = {
    "standard": {"ѓ": "đ", "ќ": "ć", "ѕ": "dz", "љ": "lj", "њ": "nj", "џ": "dž"},
    "plain": {"ж": "zh", "ч": "ch", "ш": "sh", "ћ": "c", "ђ": "dj", "ѓ": "gj", "ќ": "kj", "ѕ": "dz", "љ": "lj", "њ": "nj", "џ": "dzh", "я": "ja", "ю": "ju", "щ": "sht", "ъ": "a"},
    "keys": {"ж": "zh", "ч": "ch", "ш": "sh", "ћ": "c", "ѓ": "gj", "ќ": "kj", "ѕ": "dz", "љ": "lj", "њ": "nj", "џ": "dzh", "я": "ja", "ю": "ju", "щ": "sht", "ъ": "a"},
}


def latin_pairs(style: str) -> list[tuple[str, str]]:
    """Letters of a style and what stands for them: capitals become capitals; the style of keys is lower-case and leaves ђ."""
    letters = dict(zip(CYRILLIC, LATIN, strict=True)) | STYLES[style]
    if style == "keys":
        letters.pop("ђ")
        return list(letters.items())
    upper = {c.upper(): (x.upper() if style == "plain" or len(x) == 1 else x.capitalize()) for c, x in letters.items()}
    return [*letters.items(), *upper.items()]


def latin_in(text: Column, style: str = "standard") -> Column:
    """Cyrillic letters in Latin script in one of three styles."""
    pairs = latin_pairs(style)
    long = [p for p in pairs if len(p[1]) > 1]
    short = [p for p in pairs if len(p[1]) == 1]
    text = F.lower(text) if style == "keys" else text
    out = F.translate(text, "".join(a for a, _ in short), "".join(b for _, b in short))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), long, out)


def unwrapped(text: Column) -> Column:
    """A text out of up to three layers of JSON (`summary`, else `text`) and code fences, without stars of emphasis (F8)."""
    out = text
    for _ in range(3):
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(out), r"(?i)^```json\s*", ""), r"```\s*$", ""))
        inner = F.coalesce(F.nullif(F.get_json_object(bare, "$.summary"), F.lit("")), F.nullif(F.get_json_object(bare, "$.text"), F.lit("")), F.nullif(F.regexp_extract(bare, r'(?s)"(?:summary|text)"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit("")))
        out = F.when(bare.startswith("{") & inner.isNotNull(), inner).otherwise(out)
    plain = F.regexp_replace(F.regexp_replace(out, r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1")
    return F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " "))
