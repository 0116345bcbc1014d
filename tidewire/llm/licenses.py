"""License notices in texts: exact phrases of words, and short notices with a bounded number of edits.

A notice of k allowed edits is split into k + 1 seeds; any passage within k edits holds one of them unchanged, so an
Aho-Corasick automaton over all seeds finds every place worth a look. There the regex library's bounded-error
matching decides, with its count of edits, and gives the span.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm._texts import texts, words

#: Phrases of words and their labels.
PHRASES = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
#: Short notices, in words between single spaces, with the label that a fuzzy match adds.
NOTICES = {
    b"under the mit license": "mit",
    b"permission is hereby granted free of charge to any person obtaining a copy": "mit",
    b"apache license version 2": "apache-2",
    b"licensed under the apache license": "apache-2",
    b"gnu general public license": "gpl",
    b"gnu lesser general public license": "lgpl",
    b"redistribution and use in source and binary forms": "bsd",
    b"mozilla public license": "mpl",
    b"creative commons attribution noncommercial": "cc-by-nc",
    b"creative commons attribution sharealike": "cc-by-sa",
    b"this is free and unencumbered software": "unlicense",
    b"all rights reserved": "all-rights-reserved",
    b"released under the mit license": "mit",
    b"the software is provided as is without warranty of any kind": "mit",
    b"gnu affero general public license": "agpl",
    b"gnu free documentation license": "gfdl",
    b"eclipse public license": "epl",
    b"boost software license": "boost",
    b"common development and distribution license": "cddl",
    b"european union public licence": "eupl",
    b"permission to use copy modify and or distribute this software for any purpose": "isc",
    b"neither the name of the copyright holder nor the names of its contributors": "bsd",
    b"creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    b"creative commons attribution noderivatives": "cc-by-nd",
    b"creative commons zero": "cc0",
    b"dedicated to the public domain": "public-domain",
    b"academic free license": "afl",
    b"sil open font license": "ofl",
}
#: Edits allowed: one for so many characters of a notice, and at most MOST_EDITS.
CHARS_AN_EDIT, MOST_EDITS = 10, 4


def allowed_edits(notice: bytes) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_AN_EDIT)


class NoticeFinder:
    """Finds all notices in a text of words between single spaces, with a space before and after.

    A match begins and ends at edges of words. Of a notice's overlapping matches the one of fewest edits counts, then
    the first; what is left beside it is searched again, so no match is lost that overlaps no better one.
    """

    def __init__(self, notices: dict[bytes, str] = NOTICES):
        self.notices = [(n, label, allowed_edits(n)) for n, label in notices.items()]
        self.patterns = [regex.compile(rb"(?b)(?<= )(?:" + regex.escape(n, literal_spaces=True) + rb"){e<=%d}(?= )" % k) for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(self.notices):
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice[a:b], []).append((i, a))
        for seed, where in held.items():
            self.seeds.add_word(seed.decode("latin-1"), (len(seed), where))
        self.seeds.make_automaton()

    def windows(self, text: bytes) -> dict[int, set[tuple[int, int]]]:
        """Per notice, the stretches of text that hold every match with one of its seeds.

        A stretch is shorter than two matches: whatever it holds overlaps.
        """
        out: dict[int, set[tuple[int, int]]] = {}
        for end, (length, where) in self.seeds.iter(text.decode("latin-1")):
            for i, at in where:
                notice, _, k = self.notices[i]
                start = end + 1 - length - at
                out.setdefault(i, set()).add((max(0, start - k), min(len(text), start + len(notice) + k)))
        return out

    def best(self, i: int, text: bytes, low: int, high: int) -> tuple[int, int, int, int, int] | None:
        """(edits, start, end, low, high) of the best match between low and high, or None."""
        # One byte more, for the space behind the match; the space before it may lie before low.
        m = self.patterns[i].search(text, low, min(len(text), high + 1)) if low < high else None
        return (sum(m.fuzzy_counts), m.start(), m.end(), low, high) if m else None

    def find(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits), in bytes, of each match."""
        found = []
        for i, spans in self.windows(text).items():
            queue = [m for low, high in spans if (m := self.best(i, text, low, high))]
            heapq.heapify(queue)
            starts: list[int] = []  # of the kept matches, which do not overlap
            kept: dict[int, int] = {}
            while queue:
                edits, start, end, low, high = heapq.heappop(queue)
                at = bisect.bisect_left(starts, end)
                met = starts[at - 1] if at and kept[starts[at - 1]] > start else None
                if met is None:
                    starts.insert(at, start)
                    kept[start] = end
                    found.append((start, end, self.notices[i][1], edits))
                    continue
                for part in ((low, min(high, met)), (max(low, kept[met]), high)):
                    if again := self.best(i, text, *part):
                        heapq.heappush(queue, again)
        return sorted(found)


def exact_places(text: bytes, phrases: dict[bytes, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word's number, label) of every place where a phrase's words stand one after another.

    `text` is words between single spaces, with a space before and after.
    """
    found = []
    for phrase, label in phrases.items():
        needle, at = b" " + phrase + b" ", -1
        while (at := text.find(needle, at + 1)) >= 0:
            found.append((text.count(b" ", 0, at + 1) - 1, label))
    return found


_FINDERS: list[NoticeFinder] = []
_FOUND = "doc_id long, n_words long, base array<struct<word:long,label:string>>, fuzzy array<struct<start:long,end:long,label:string,edits:int>>"


def license_spans(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, base (exact places), fuzzy (spans with label and edits).

    Spans are bytes of the text's lower-cased words between single spaces. Null and empty texts find nothing; very
    long texts are scanned whole; repeated rows give repeated results. Columns other than doc_id and text are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _FINDERS:
            _FINDERS.append(NoticeFinder())
        finder = _FINDERS[0]
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        fuzzy_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))
        for batch in batches:
            counts, base, fuzzy = [], [], []
            for text in texts(batch):
                tokens = words(text)
                counts.append(len(tokens))
                joined = b" " + b" ".join(tokens) + b" "
                base.append([{"word": w, "label": x} for w, x in exact_places(joined)])
                fuzzy.append([{"start": a - 1, "end": b - 1, "label": x, "edits": e} for a, b, x, e in finder.find(joined)])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(fuzzy, fuzzy_type)],
                names=["doc_id", "n_words", "base", "fuzzy"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, _FOUND)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy.

    score is 1 with an exact place, else 1 less the best match's share of edits in the edits allowed plus one, else 0.
    Null and empty texts have no words, no places and score 0; repeated rows give repeated results; an empty table
    gives an empty one; columns other than doc_id and text are ignored.
    """
    found = license_spans(docs)
    word = F.transform("base", lambda x: x["word"])
    base_labels = F.transform("base", lambda x: x["label"])
    fuzzy_labels = F.transform("fuzzy", lambda x: x["label"])
    fewest = F.array_min(F.transform("fuzzy", lambda x: x["edits"]))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        join(base_labels).alias("base_labels"), join(F.concat(base_labels, fuzzy_labels)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).when(F.size("fuzzy") > 0, 1.0 - fewest / F.lit(MOST_EDITS + 1.0)).otherwise(0.0).alias("score"),
        F.size("fuzzy").cast("long").alias("n_fuzzy"),
    )
