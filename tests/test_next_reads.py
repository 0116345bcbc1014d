"""What to read next, by example and against a plain loop."""

from tidewire.adapters import news
from tidewire.operators import next_reads
from tidewire.operators.online import ratio_overlap
from tidewire.operators.ranking import hours_since, ranked_rows
from tidewire.functions import wording
from tidewire.operators.online import headline

DATA = "/root/testdata/sf0.001"


def test_first_rule_that_fits():
    assert next_reads.relation(2, 1, ["sport"], 0.3) == ("development", 2)
    assert next_reads.relation(2, 1, ["sport"], 0.1) == ("background", 1)
    assert next_reads.relation(2, 0, ["sport"], 0.1) == ("angle", 2)
    assert next_reads.relation(0, 1, ["sport", "news"], 0.5) == ("topic", 1)
    assert next_reads.relation(0, 0, ["vesti"], 0.3) == ("general", 1) and next_reads.relation(0, 0, ["vesti"], 0.2) is None
    assert next_reads.relation(0, 0, [], 0.9) is None


def test_best_of_all_stories(spark):
    table = news(spark, DATA)
    rows = ranked_rows(table).select("cluster_id", "category", "topic", "rank", "weight", hours_since("created_at").alias("h"), wording.stems(headline(table.title)).alias("t"), wording.title_entities(headline(table.title)).alias("n")).collect()
    stories = {}
    for r in rows:
        stories.setdefault(r.cluster_id, []).append(r)
    lead = {c: next(r for r in own if r["rank"] == 1) for c, own in stories.items()}
    of = lambda c, f: {x for r in stories[c] for x in f(r) if x and x.strip()}
    want = []
    for c in stories:
        if c != "s3":
            names, tags, topics = (of("s3", f) & of(c, f) for f in (lambda r: r.n, lambda r: [r.category], lambda r: [r.topic]))
            found = next_reads.relation(len(names), len(tags), sorted(topics), ratio_overlap(lead["s3"].t, lead[c].t))
            if found:
                base, each = next_reads.POINTS[found[0]]
                score = round(base + each * found[1] + 0.35 * (lead[c].weight >= 1.75) + max(0.0, 0.8 - min(0.8, lead[c].h * 0.08)), 3)
                want.append((-score, c, found[0]))
    got = [(-r.score, r.cluster_id, r.relation) for r in next_reads.next_reads(table).collect()]
    assert got == sorted(w for w in want if -w[0] > 0.9)[:4]
