"""Full-text search over a positional inverted index: stems, phrases, `or`, `-word`, ranked by cover density.

The index has a row per (stem, unit) with the stem's positions, made inside each unit without a shuffle, and is laid out by
(bucket, stem, unit) in ranges, so a frequent stem is spread over many files and a reader skips those of other stems. A dictionary
holds the number of units of each stem. A batch of queries is answered with joins: each alternative of a query starts from its
rarest stem, and the other stems are looked up for those candidates only.

A query is a list of alternatives (`or`); an alternative is a list of terms that must all occur, a term one stem or a phrase in
quotes, and a term with a leading minus must not occur. Stop words are left out; inside a phrase they keep their place.
A cover is a shortest range of positions that holds all terms of an alternative that the unit satisfies. With d positions in it
that hold no word of the query, it adds 0.1 / (1 + d) to the rank; covers may overlap. Contributions are whole billionths, so the
sum does not depend on its order. An alternative without any term that must occur finds nothing.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from tillwatch.functions.stems import STOP_WORDS, WORDS, lexemes, stem
from tillwatch.operators.templates import aggregates, first_per_key

BUCKETS = 64
PART = regex.compile(r'-?"[^"]*"?|[^\s"]+')


# ---- queries --------------------------------------------------------------------
def term(text: str) -> list[tuple[int, str]]:
    """(offset, stem) of the words of a term; the first that is no stop word has offset 0."""
    found = [(i, stem(w)) for i, w in enumerate(WORDS.findall(text.lower())) if w not in STOP_WORDS]
    return [(i - found[0][0], s) for i, s in found]


def parse(query: str) -> list[dict]:
    """Alternatives, each {"must": [term, ...], "not": [term, ...]}, without those that nothing must occur for."""
    alternatives: list[dict] = [{"must": [], "not": []}]
    for part in PART.findall(query):
        if part.lower() == "or":
            alternatives.append({"must": [], "not": []})
        elif words := term(part):  # a word with inner marks is a phrase of its parts
            alternatives[-1]["not" if part[0] == "-" else "must"].append(words)
    return [a for a in alternatives if a["must"]]


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, parts): the query as JSON; queries without a term that must occur are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["parts"] = [json.dumps(parse(q or "")) for q in batch["query"]]
            yield batch.loc[batch["parts"] != "[]", ["query_id", "parts"]]

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, parts string")


# ---- index ----------------------------------------------------------------------
def index(units: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, word, unit_id, positions) of units (unit_id, text), in the order that a reader prunes by."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, text in zip(batch["unit_id"], batch["text"]):
                places: dict[str, list[int]] = {}
                for at, word in lexemes(text or ""):
                    places.setdefault(word, []).append(at)
                if places:
                    yield pd.DataFrame({"word": list(places), "unit_id": [unit] * len(places), "positions": list(places.values())})

    kind = dict(units.dtypes)["unit_id"]
    rows = units.select("unit_id", "text").mapInPandas(run, f"word string, unit_id {kind}, positions array<int>")
    placed = rows.selectExpr(f"CAST(pmod(xxhash64(word), {buckets}) AS INT) AS bucket", "*")
    return placed.repartitionByRange("bucket", "word", "unit_id").sortWithinPartitions("bucket", "word", "unit_id")


def dictionary(postings: DataFrame) -> DataFrame:
    """(bucket, word, units): in how many units each stem occurs; counted before the shuffle."""
    return postings.groupBy("bucket", "word").agg(*aggregates({"units": "count(*)"}))


# ---- ranking --------------------------------------------------------------------
def occurrences(words: list, places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """(first, last) position of each occurrence of a term, in order."""
    if any(w not in places for _, w in words):
        return []
    rest = [(offset, set(places[w])) for offset, w in words[1:]]
    reach = words[-1][0]
    return [(at, at + reach) for at in places[words[0][1]] if all(at + offset in found for offset, found in rest)]


def rank(alternatives: list[dict], places: dict[str, list[int]]) -> int | None:
    """The cover density in billionths; None if no alternative is satisfied."""
    met = []
    for a in alternatives:
        must = [occurrences(t, places) for t in a["must"]]
        if all(must) and not any(occurrences(t, places) for t in a["not"]):
            met.append(must)
    if not met:
        return None
    entries = sorted({p for found in places.values() for p in found})
    total, best = 0, 0
    for end in sorted({last for must in met for found in must for _, last in found}):
        begin = 0
        for must in met:  # the shortest range up to `end` for each alternative
            starts = [found[k - 1][0] if (k := bisect_right(found, end, key=lambda x: x[1])) else 0 for found in must]
            begin = max(begin, min(starts))
        if begin > best:  # else a shorter range with the same start came before
            best = begin
            inside = bisect_right(entries, end) - bisect_right(entries, begin - 1)
            parts = 1 + (end - begin + 1 - inside)
            total += (200_000_000 + parts) // (2 * parts)
    return total


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores = [rank(json.loads(p), {x["word"]: [int(p) for p in x["positions"]] for x in found}) for p, found in zip(batch["parts"], batch["found"])]
        batch["score"] = pd.array(scores, dtype="Int64")
        yield batch.loc[batch["score"].notna(), ["query_id", "unit_id", "score"]]


def search(postings: DataFrame, words: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The best units of each query; postings and words are the stored results of `index` and `dictionary`.

    Ties are broken by the unit. The rank filter goes below the shuffle as a group limit, so a query that matches a large part of
    all units sends few rows per task."""
    ready = parsed(queries)
    # JSON pairs [offset, stem] as text: "must" terms name the candidates, all words are looked up for them
    flat = ready.selectExpr("query_id", "posexplode(from_json(parts, 'array<map<string, array<array<array<string>>>>>')) AS (alternative, a)")
    must = flat.selectExpr("query_id", "alternative", "explode(flatten(a['must'])) AS pair").selectExpr("query_id", "alternative", "pair[1] AS word").distinct()
    every = flat.selectExpr("query_id", "explode(concat(flatten(a['must']), flatten(a['not']))) AS pair").selectExpr("query_id", "pair[1] AS word").distinct()
    known = must.join(words.select("word", "units"), "word", "left")
    possible = known.groupBy("query_id", "alternative").agg(*aggregates({"unknown": "count_if(units IS NULL)", "rarest": "min(struct(units, word)).word"})).where("unknown = 0")
    hits = postings.join(every.select("word").distinct(), "word", "left_semi").select("word", "unit_id", "positions")
    candidates = possible.selectExpr("query_id", "rarest AS word").distinct().join(hits.select("word", "unit_id"), "word").select("query_id", "unit_id").distinct()
    found = candidates.join(every, "query_id").join(hits, ["unit_id", "word"]).groupBy("query_id", "unit_id").agg(
        *aggregates({"found": "collect_list(struct(word, positions))"}))
    units = dict(postings.dtypes)["unit_id"]
    scored = found.join(ready, "query_id").select("query_id", "unit_id", "found", "parts").mapInPandas(
        _ranked, f"query_id {dict(queries.dtypes)['query_id']}, unit_id {units}, score bigint")
    best = first_per_key(scored, "query_id", "score DESC, unit_id", limit)
    return best.selectExpr(
        "query_id", "unit_id", "CAST(score AS DOUBLE) / 1000000000D AS relevance_score",
        "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS position")
