"""Stems against the published sample vocabulary, queries and ranks against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from tillwatch.functions.stems import STOP_WORDS, WORDS, stem
from tillwatch.operators import search

# words and stems of the published sample
SAMPLE = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist",
    "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol",
    "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consolidate": "consolid", "consolidated": "consolid",
    "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson", "consorted": "consort",
    "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir",
    "constable": "constabl", "constancy": "constanc", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "knees": "knee",
    "kneeled": "kneel", "knightly": "knight", "knitted": "knit", "knitting": "knit", "knives": "knive", "knocker": "knocker", "knots": "knot",
    "generate": "generat", "generously": "generous", "communication": "communic", "happy": "happi", "say": "say", "by": "by", "dying": "die", "hopping": "hop",
    "hoping": "hope", "relational": "relat", "vileness": "vile", "sky": "sky", "skies": "sky", "yield": "yield", "gas": "gas", "gaps": "gap", "ties": "tie", "cries": "cri",
}


def test_stems():
    assert {w: stem(w) for w in SAMPLE} == SAMPLE


def occurs(words, places):
    return [] if not words else [at for at, w in places.items() if w == words[0][1] and all(places.get(at + o) == x for o, x in words)]


def slow_rank(query, text):
    """Every range of positions, shortest ones kept: no pointers, no index."""
    places = {i: stem(w) for i, w in enumerate(WORDS.findall(text.lower()), 1) if w not in STOP_WORDS}
    alternatives = search.parse(query)
    met = [a for a in alternatives if all(occurs(t, places) for t in a["must"]) and not any(occurs(t, places) for t in a["not"])]
    if not met:
        return None

    def holds(p, q):
        return any(all(any(p <= at and at + t[-1][0] <= q for at in occurs(t, places)) for t in a["must"]) for a in met)

    named = {w for a in alternatives for t in a["must"] + a["not"] for _, w in t}
    ranges = [(p, q) for p, q in combinations(range(1, max(places) + 2), 2) if holds(p, q - 1)]
    ranges = [(p, q - 1) for p, q in ranges]
    shortest = [(p, q) for p, q in ranges if not any((a, b) != (p, q) and p <= a and b <= q for a, b in ranges)]
    total = 0
    for p, q in shortest:
        noise = sum(places.get(i) not in named for i in range(p, q + 1))
        total += (200_000_000 + 1 + noise) // (2 * (1 + noise))
    return total


def test_parse():
    assert search.parse('red "the green Apples" -pears OR the "of a" or x-rays') == [
        {"must": [[(0, "red")], [(0, "green"), (1, "appl")]], "not": [[(0, "pear")]]}, {"must": [[(0, "x"), (1, "ray")]], "not": []}]
    assert search.parse("-only -this") == [] and search.parse('"apples in the garden"') == [{"must": [[(0, "appl"), (3, "garden")]], "not": []}]


QUERIES = ["apple pear", '"red apples"', "apple or pear fig", "apple -pear", '"red apple" -"green pear" or figs', "the", "", "missing", "apple missing", '"apple in garden"',
           "apple or apple pear or fig", '"red apple" apple']


def units(seed):
    rng = random.Random(seed)
    words = ["red", "apples", "apple", "green", "pear", "pears", "fig", "the", "in", "garden", "Running"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, ""), (62, "the in")]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_and_rank_against_brute_force(spark, seed):
    rows = units(seed)
    index = search.index(spark.createDataFrame(rows, "unit_id long, text string").repartition(3), buckets=5)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    want = []
    for k, query in enumerate(QUERIES):
        ranks = sorted((-r, u) for u, text in rows if (r := slow_rank(query, text or "")) is not None)
        want += [(k, u, -r / 1e9, i) for i, (r, u) in enumerate(ranks[:7], 1)]
    got = search.search(index, search.dictionary(index), asked, limit=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_frequent_word_is_spread(spark):
    """A stem in every unit lies in several partitions of the index."""
    rows = spark.range(4000).selectExpr("id AS unit_id", "concat('common word', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put into one partition
    try:
        index = search.index(rows)
        holding = index.where("word = 'common'").selectExpr("spark_partition_id() AS p").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.where("word = 'common'").count() == 4000 and holding > 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "unit_id long, text string")
    some = spark.createDataFrame([(1, "apple")], "query_id int, query string")
    index = search.index(none)
    assert search.search(index, search.dictionary(index), some).count() == 0
    assert search.search(index, search.dictionary(index), some.limit(0)).count() == 0
