"""Words that rise in titles (R15), their spellings folded into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wording
from tidewire.operators.ranking import hours_since
from tidewire.operators.stories import quantised

#: Spellings of names and what they count as, those that do so only as names, and how some are shown.
SPELLINGS = {
    "iran": "iran", "iranski": "iran", "trump": "tramp", "trampa": "tramp", "trampu": "tramp", "trampom": "tramp", "putin": "putin", "putina": "putin",
    "biden": "bajden", "bajden": "bajden", "zelensky": "zelenski", "zelenski": "zelenski", "nato": "nato", "eu": "eu", "sad": "sad", "video": "video", "vinea": "video",
    "foto": "foto", "ukraine": "ukraina", "ukraina": "ukraina", "russia": "rusija", "rusija": "rusija", "rusije": "rusija", "rusiji": "rusija", "rusiju": "rusija",
    "srbiji": "srbija", "srbije": "srbija", "srbiju": "srbija", "srbima": "srbija", "srbija": "srbija", "makedonija": "makedonija", "makedonije": "makedonija",
    "makedoniji": "makedonija", "makedoniju": "makedonija", "beograda": "beograd", "beogradu": "beograd", "beogradom": "beograd", "evra": "evro", "evro": "evro",
    "eura": "evro", "euro": "evro", "tivtu": "tivat", "tivtom": "tivat", "libana": "liban", "libanu": "liban", "libanom": "liban", "crna": "crna gora", "crne": "crna gora",
    "crnoj": "crna gora", "crnu": "crna gora", "gora": "crna gora", "gore": "crna gora", "gori": "crna gora", "goru": "crna gora", "vučić": "vucic", "vučića": "vucic",
    "vučiću": "vucic", "vucic": "vucic", "vucica": "vucic", "vucicu": "vucic", "rumuniji": "rumunija", "rumunije": "rumunija", "rumuniju": "rumunija",
    "rumunija": "rumunija", "ormuz": "ormuz", "ormuski": "ormuz", "ormutski": "ormuz", "ormuskiot": "ormuz", "ormutskiot": "ormuz", "tesnece": "tesnec",
}
SHOWN = {"eu": "EU", "nato": "NATO", "sad": "SAD", "vucic": "Vučić"}
#: Surnames written with one letter for another.
SURNAME = ("([ae])i([bcdfghklmnprstvz](?:ov|ev)(?:a|i|u|e|o|om|oj|ih|im|ima)?)$", "$1j$2")
#: Letters and articles of a word that counts, results, articles that are read, hours of the hot and rising windows, weights.
LETTERS, LEAST, MOST, NEWEST, HOT, RISING, NAME = 4, 2, 12, 3000, 1.5, 4.5, 4.0
#: Words that never trend: a parameter.
STOP = ("that", "this", "with", "from", "have", "were", "they", "para", "como", "dans", "pour", "nicht", "eine", "oder", "sind")


def trend_word(latin: Column, spellings: dict[str, str] = SPELLINGS) -> Column:
    """What a lower-case Latin word counts as: by the table, with its marks or without them, else with its surname's letters
    folded (F31)."""
    table = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    bare = F.translate(latin, "ćčšžđќ", "ccszdc")
    return F.coalesce(F.try_element_at(table, latin), F.try_element_at(table, bare), F.regexp_replace(latin, *map(F.lit, SURNAME)))


def shown(word: Column) -> Column:
    out = F.initcap(word)
    for k, v in SHOWN.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def title_words(titles: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(id, word, name) of titles (id, title): each word once, whether its first place has a capital and does not begin a
    sentence. Short words, numbers and stop words, in any spelling, are left out."""
    parts = titles.select("id", F.posexplode(F.split("title", "[.!?]+")).alias("s", "sentence"))
    each = parts.select("id", "s", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}_'’-]+"), F.lit(0))).alias("i", "raw"))
    word = F.regexp_replace("raw", "^['’-]+|['’-]+$", "")
    each = each.select("id", "s", "i", word.alias("w")).filter((F.length("w") >= LETTERS) & ~F.col("w").rlike("^[0-9]+$"))
    each = each.withColumn("latin", wording.latin_in(F.lower("w")))
    kept = each.filter(~F.lower("w").isin(*stop) & ~F.col("latin").isin(*stop) & ~F.translate("latin", "ćčšžđќ", "ccszdc").isin(*stop))
    head = F.substring("w", 1, 1)
    name = (head != F.lower(head)) & (F.col("i") > 0)
    return kept.select("id", "s", "i", trend_word(F.col("latin")).alias("word"), name.alias("name")).groupBy("id", "word").agg(F.min_by("name", F.struct("s", "i")).alias("name"))


def rising_words(news: DataFrame, hours: float = 12, unit: float = 1.0, own: tuple[str, ...] = ("makedonija",), stop: tuple[str, ...] = STOP) -> DataFrame:
    """The words that rise in the titles of the last `hours`, best first (R15): at most the NEWEST articles; 3, 2 or 1 a title
    by age, four times that for names; twice hot, 1.2 rising and .5 older, times 1 + .15 a category from two on.

    A `unit` is the clock's hour; a country's own name does not count.
    """
    age = hours_since("created_at") / unit
    rows = news.withColumn("age", age).filter(F.col("age") <= hours).orderBy(F.desc("created_at"), F.desc("id")).limit(NEWEST)
    large = rows.groupBy("cluster_id").agg(F.count("*").alias("size")).filter("size >= 4").select("cluster_id", F.lit(True).alias("large"))
    words = title_words(rows.select("id", "title"), stop).filter(~F.col("word").isin(*own))
    rows = words.join(rows.select("id", "age", "category", "cluster_id"), "id").join(large, "cluster_id", "left")
    hot, rising = F.col("age") <= HOT, (F.col("age") > HOT) & (F.col("age") <= RISING)
    bonus = F.when(F.col("name"), NAME).otherwise(1.0)
    held = lambda when, x: F.sum(F.when(when, x * bonus).otherwise(0.0))
    sums = rows.groupBy("word").agg(
        F.count("*").alias("n"), held(hot, 3.0).alias("h"), held(rising, 2.0).alias("r"), held(~hot & ~rising, 1.0).alias("b"), F.count_distinct("category").alias("c"), F.bool_or(hot & F.coalesce("large", F.lit(False))).alias("large"),
    )
    h, r, b, c = (F.col(x) for x in "hrbc")
    score = (2 * h + 1.2 * r + 0.5 * b) * F.when(c >= 2, 1 + 0.15 * c).otherwise(1.0)
    trend = F.when((h > (r + b) * 0.8) & (h > 6), "surging").when(h + r > 1.5 * b, "up").when(b > 2 * (h + r), "down").otherwise("flat")
    out = sums.filter(F.col("n") >= LEAST).select(shown(F.col("word")).alias("word"), "n", quantised(score, 4).alias("score"), trend.alias("trend"), (F.col("large") | ((h > 15) & (c >= 2))).alias("breaking"))
    return out.orderBy(F.desc("score"), "word").limit(MOST)
