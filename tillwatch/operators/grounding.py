"""Grounding of returned texts: what they change, add or cite beyond the facts they were made from.

Every check is a join on the item's key: fields by equality or within a tolerance, lists by an anti-join with what is allowed, and
free texts by the ids and numbers found in them. Numbers are compared within a tolerance through neighbouring buckets of its
width, so the join stays one on equal keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.functions.text import clean_text, lit
from tillwatch.operators.templates import aggregates

IDENTIFIER = r"\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\\b"
NUMBER = r"(?<![A-Za-z0-9.-])[0-9](?:[0-9,]*[0-9])?(?:\\.[0-9]+)?"
TOLERANCE = 0.000001
COLUMNS = ("key", "deviation", "detail")


def changed_fields(expected: DataFrame, returned: DataFrame, key: str, texts: tuple[str, ...] = (), numbers: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """(key, deviation, detail): unknown and missing items, another place in the order, and every field that is not as expected."""
    fields = [*texts, *numbers, *([order] if order else [])]
    mine = expected.selectExpr(f"{key} AS key", *[f"{c} AS e_{c}" for c in fields], "TRUE AS e_there")
    theirs = returned.selectExpr(f"{key} AS key", *[f"{c} AS r_{c}" for c in fields], "TRUE AS r_there")
    tests = ["CASE WHEN e_there IS NULL THEN struct('unknown item' AS deviation, CAST(key AS STRING) AS detail) END", "CASE WHEN r_there IS NULL THEN struct('missing item' AS deviation, CAST(key AS STRING) AS detail) END"]
    both = "e_there AND r_there"
    if order:
        tests.append(f"CASE WHEN {both} AND NOT (e_{order} <=> r_{order}) THEN struct('order changed' AS deviation, CAST(r_{order} AS STRING) AS detail) END")
    for c in texts:
        a, b = clean_text(f"e_{c}"), clean_text(f"r_{c}")
        tests.append(f"CASE WHEN {both} AND {a} <> {b} THEN struct({lit(c + ' changed')} AS deviation, {b} AS detail) END")
    for c in numbers:
        a, b = f"coalesce(CAST(e_{c} AS DOUBLE), 0D)", f"coalesce(CAST(r_{c} AS DOUBLE), 0D)"
        tests.append(f"CASE WHEN {both} AND abs({a} - {b}) > {TOLERANCE}D THEN struct({lit(c + ' changed')} AS deviation, CAST(r_{c} AS STRING) AS detail) END")
    return mine.join(theirs, "key", "full_outer").selectExpr("key", f"inline(array_compact(array({', '.join(tests)})))")


def unsupported(returned: DataFrame, allowed: DataFrame, what: str) -> DataFrame:
    """(key, deviation, detail) of the returned (key, value) that the allowed (key, value) do not hold."""
    found = _not_held(returned, allowed, ["key", "value"])
    return found.selectExpr("key", f"{lit('unsupported ' + what)} AS deviation", "value AS detail")


def _not_held(rows: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that `held` lacks, as an anti-join gives them (NULL equals nothing): one aggregate over both sides.

    Long texts are estimated far too small, so a join would send a whole side through the driver as a broadcast."""
    known = held.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    both = rows.selectExpr(*columns, "FALSE AS held").unionByName(known.selectExpr(*columns, "TRUE AS held"))
    return both.groupBy(*columns).agg(*aggregates({"held": "bool_or(held)"})).where("NOT held").drop("held")


def _found(texts: DataFrame) -> DataFrame:
    """(key, kind, word, number): every id and number in the texts (key, text); ids are taken out before numbers are looked for."""
    rest = f"regexp_replace(text, '{IDENTIFIER}', ' ')"
    found = texts.selectExpr(
        "key", f"concat(transform(regexp_extract_all(text, '{IDENTIFIER}', 0), x -> struct('id' AS kind, x AS word)), "
               f"transform(regexp_extract_all({rest}, '{NUMBER}', 0), x -> struct('number' AS kind, x AS word))) AS found").selectExpr("key", "inline(found)")
    return found.selectExpr("key", "kind", "word", "CASE WHEN kind = 'number' THEN try_cast(replace(word, ',', '') AS DOUBLE) END AS number")


def mentions(texts: DataFrame) -> DataFrame:
    """(key, kind, word, number): ids and numbers in the texts (key, text), each once."""
    return _found(texts).distinct()


def unknown_mentions(texts: DataFrame, facts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(key, deviation, detail) of ids and numbers in the texts (key, text) that are in no fact (key, text) of the same item.

    Each text and fact is searched once: one aggregate tells the words that a fact has as they are written, and only the rest is
    compared with the numbers of the facts. Both sides of that join are filtered on its result alone, so they share its shuffle."""
    bucket = f"CAST(floor(number / {tolerance}D) AS BIGINT)"
    # a fact's number that equals itself within the tolerance, so no infinite one
    known = f"CASE WHEN kind = 'id' OR abs(number - number) <= {tolerance}D THEN 2 ELSE 0 END"
    both = _found(texts).selectExpr("*", "1 AS mark").unionByName(_found(facts).where("key IS NOT NULL").selectExpr("*", f"{known} AS mark"))
    words = both.groupBy("key", "kind", "word", "number").agg(*aggregates({"marks": "bit_or(mark)"}))
    place = lambda shift: f"struct(key, {bucket} + {shift} AS bucket, number AS fact)"
    # outer: an inner one would filter the words before they are added up, and the shuffle would not be the same
    near = words.where("marks >= 2").selectExpr(f"inline_outer(if(kind = 'number', array({place(-1)}, {place(0)}, {place(1)}), NULL))")
    # the numbers of all items: too many to be sent to every task, whatever their texts are estimated at
    rest = words.where("marks = 1").selectExpr("key", "kind", "word", "number", f"{bucket} AS bucket").join(near.hint("merge"), ["key", "bucket"], "left").groupBy(
        "key", "kind", "word").agg(*aggregates({"close": f"coalesce(bool_or(abs(number - fact) <= {tolerance}D), FALSE)"})).where("NOT close")
    return rest.selectExpr("key", "concat('unknown ', kind) AS deviation", "word AS detail")
