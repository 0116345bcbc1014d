"""Names in texts by their capitals and by the corpus: two passes, one for what words are names, one for the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.tables import dropping, kept, written

#: A word's evidence, the shares of capitals from which it is a name and below which a common noun, words of
#: a name, names of a text, names of a story.
EVIDENCE, NAME_SHARE, NOUN_SHARE, NAME_WORDS, TEXT_NAMES, STORY_NAMES = 3, 0.6, 0.4, 3, 12, 8
#: What precedes a word that opens a sentence, endings of definite forms and of surnames, and surnames
#: written with one letter for another.
OPENER = r"[.!?:„“\"«()\n]\s*$"
DEFINITE = "(?:от|иот|ата|ото|ите)$"
SURNAME = "(?:ов|ев|ова|ева|ски|ска|ин|ина|ќ|ић|ич|ак|ек|ко)$"
SPELLING = ("([ае])и([бцдфгхклмнпрстзв](?:ов|ев)(?:а|и|у|е|о|ом|ој|их|им|има)?)$", "$1ј$2")
#: Words that are no names, organisations' words, places, nouns that alone are no name: tables that the caller may give.
NOT_NAMES = ("the", "and", "for", "with", "from", "that", "this", "are", "was")
ORGANISATIONS = ("group", "inc", "ltd")
PLACES = ("скопје", "битола", "охрид", "македонија", "србија", "грција", "софија", "белград", "лондон", "париз", "берлин", "мадрид")
NOUNS = ("комисија", "влада", "банка", "суд", "премиер")

WORD = r"([^\p{L}]*)(\p{L}[\p{L}\p{N}_\-]*)"
_LAST_PAUSES = r"\p{L}[\p{L}\p{N}_\-]*[:,][^\p{L}]*$"


def acronym(word: Column) -> Column:
    return (F.length(word) >= 2) & (word == F.upper(word)) & (word != F.lower(word))


def word_rows(texts: DataFrame) -> DataFrame:
    """(id, part, i, word, key, opens, joins, pauses) of each word of texts (id, part, text): whether it opens a sentence,
    follows one space, and is before a colon or comma. Empty texts and those in capitals alone have no words."""
    rows = texts.filter((F.length("text") > 0) & (F.col("text").rlike("[a-z]") | (F.col("text") != F.upper("text"))))  # most need not be upper-cased
    gaps, words = (F.regexp_extract_all("text", F.lit(WORD), F.lit(k)) for k in (1, 2))
    pause = F.col("text").rlike(_LAST_PAUSES)
    each = rows.select("id", "part", gaps.alias("g"), words.alias("w"), pause.alias("p")).select("id", "part", "g", "p", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    gap, after = F.get("g", F.col("i")), F.substring(F.get("g", F.col("i") + 1), 1, 1)
    return each.select(
        "id", "part", "i", "word", F.lower("word").alias("key"), (((F.col("i") == 0) & (gap == "")) | ((gap != " ") & gap.rlike(OPENER))).alias("opens"), ((F.col("i") > 0) & (gap == " ")).alias("joins"),
        F.when(F.col("i") == F.col("n") - 1, F.col("p")).otherwise(after.isin(":", ",")).alias("pauses"),
    )


def name_shares(words: DataFrame) -> DataFrame:
    """(key, share) of words with EVIDENCE: how often one of three letters on, not opening a sentence, has a capital.

    Counted by word as written, then by key, so that only different words are lower-cased whole."""
    word = F.col("word")
    capital = F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))
    written_so = words.filter(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"), F.count_if(capital & ~F.col("opens")).alias("inside"))
    low = word == F.lower(word)
    counts = written_so.groupBy(F.lower("word").alias("key")).agg(F.sum(F.when(low, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(low, 0).otherwise(F.col("inside"))).alias("high"))
    return counts.filter(F.col("low") + F.col("high") >= EVIDENCE).select("key", (F.col("high") / (F.col("low") + F.col("high"))).alias("share"))


def names_in(texts: DataFrame, not_names: tuple[str, ...] = NOT_NAMES, nouns: tuple[str, ...] = NOUNS, places: tuple[str, ...] = PLACES, most: int = TEXT_NAMES) -> DataFrame:
    """(id, part, place, name) of texts (id, part, text): runs of up to NAME_WORDS capitalised words one space apart.

    A word counts if it has three letters or is an acronym, is not among `not_names`, and is not a common noun by the
    corpus. A run of acronyms alone is shouting. A single word is no name if it is a noun or definite form; one that
    opens a sentence is one only if it is an acronym, before a pause, or known as a name. The first `most` names of a
    text count, each once.
    """
    words = word_rows(texts)
    shares = name_shares(words)
    word = F.col("word")
    capital = F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))
    candidates = words.filter(capital & ((F.length("word") >= 3) | acronym(word)) & ~F.col("key").isin(*not_names))
    usable = candidates.join(shares, "key", "left").filter(acronym(word) | F.col("share").isNull() | (F.col("share") >= NOUN_SHARE))
    order = Window.partitionBy("id", "part").orderBy("i")
    fresh = ~(F.col("joins") & F.coalesce(F.lag("i").over(order) == F.col("i") - 1, F.lit(False)))
    runs = usable.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy("id", "part", "run").orderBy("i")) - 1
    parts = runs.withColumn("chunk", F.floor(at / NAME_WORDS)).groupBy("id", "part", "run", "chunk").agg(
        F.min("i").alias("i"), F.count("*").alias("n"), F.bool_and(acronym(word)).alias("shouted"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"),
        F.min_by(F.struct("key", "opens", "pauses", F.coalesce(F.col("share") >= NAME_SHARE, F.lit(False)).alias("known")), "i").alias("first"),
    )
    alone = (F.col("n") == 1) & ~F.col("shouted")
    noun = alone & (F.col("first.key").isin(*nouns) | (F.col("first.key").rlike(DEFINITE) & (F.length("first.key") >= 6)))
    opener = alone & F.col("first.opens") & ~(F.col("first.pauses") | F.col("first.known"))
    kept = parts.filter(~((F.col("n") > 1) & F.col("shouted")) & ~noun & ~opener)
    spelt = F.array_join(F.transform("w", lambda x: F.regexp_replace(x["word"], *map(F.lit, SPELLING))), " ")
    shown = F.when((F.length("name") > 3) & acronym(F.col("name")) & F.lower("name").isin(*places), F.initcap("name")).otherwise(F.col("name"))
    named = kept.select("id", "part", "i", spelt.alias("name")).withColumn("name", shown)
    first = named.groupBy("id", "part", "name").agg(F.min("i").alias("i"))
    place = F.row_number().over(Window.partitionBy("id", "part").orderBy("i"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("id", "part", "place", "name")


def kind(name: Column, places: tuple[str, ...] = PLACES, organisations: tuple[str, ...] = ORGANISATIONS) -> Column:
    """LOC, ORG, PER or MISC by the shape of a name."""
    words = F.split(name, " ")
    low = F.transform(words, F.lower)
    one = F.size(words) == 1
    organised = F.exists(words, acronym) | F.arrays_overlap(low, F.array(*map(F.lit, organisations)))
    return (
        F.when(F.lower(name).isin(*places), "LOC").when(one & acronym(name), "ORG").when(one, "MISC").when(organised, "ORG")
        .when(F.arrays_overlap(low, F.array(*map(F.lit, places))), "MISC").otherwise("PER")
    )


def surname_aliases(names: DataFrame, places: tuple[str, ...] = PLACES) -> DataFrame:
    """(name, full): lone surnames (by their ending, no place) and the one person's name of the corpus that ends in them;
    where two do, none. A name with a definite form is no one's full name."""
    distinct = names.select("name").distinct().withColumn("words", F.split("name", " "))
    definite = F.exists("words", lambda w: F.lower(w).rlike(DEFINITE) & (F.length(w) >= 6))
    full = distinct.filter((F.size("words") >= 2) & ~definite & (kind(F.col("name"), places) == "PER"))
    last = full.select(F.lower(F.element_at("words", -1)).alias("key"), "name").groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("full")).filter("n = 1")
    lone = distinct.filter((F.size("words") == 1) & ~acronym(F.col("name")) & ~F.lower("name").isin(*places) & F.lower("name").rlike(SURNAME))
    return lone.withColumn("key", F.lower("name")).join(last, "key").select("name", "full")


def article_texts(news: DataFrame) -> DataFrame:
    """Titles and descriptions as (id, part, text)."""
    return news.select("id", F.explode(F.array(F.struct(F.lit("title").alias("part"), F.col("title").alias("text")), F.struct(F.lit("description").alias("part"), F.col("description").alias("text")))).alias("x")).select("id", "x.*").filter("text is not null")


def story_entities(news: DataFrame, most: int = STORY_NAMES) -> DataFrame:
    """The up to eight strongest names of each story (R12): of a headline or two articles, by headlines, mentions, length;
    surnames count for the one full name that ends in them. The texts' names are found once and read three times."""
    with dropping(news.sparkSession):
        names = written(names_in(article_texts(news)), "names")
        aliases = surname_aliases(names)
        named = names.join(aliases, "name", "left").select("id", "part", F.coalesce("full", "name").alias("name"))
        stories = news.select("id", "cluster_id")
        per_article = named.join(stories, "id").groupBy("cluster_id", "name", "id").agg(F.max((F.col("part") == "title").cast("int")).alias("t"))
        sums = per_article.groupBy("cluster_id", "name").agg(F.count("*").alias("mentions"), F.sum("t").alias("in_title")).filter("in_title > 0 or mentions >= 2")
        order = Window.partitionBy("cluster_id").orderBy(F.desc("in_title"), F.desc("mentions"), F.desc(F.length("name")), "name")
        rows = sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        return kept(rows.select("cluster_id", "place", "name", kind(F.col("name")).alias("type"), "mentions", "in_title"), "entities")


def word_roles(news: DataFrame) -> DataFrame:
    """How often each word with evidence is written as a name (R12), to 6 digits."""
    shares = name_shares(word_rows(article_texts(news)))
    return shares.select("key", (F.floor(F.col("share") * 1e6 + 0.5) / 1e6).alias("share"))
