"""Scalar text, number and id expressions as Spark SQL fragments.

Every helper takes SQL expressions and returns one, so a whole projection is
handed to the JVM in a single `selectExpr` instead of one call per operator.
"""

from __future__ import annotations

from string import Formatter

# fixed values: text spellings that mean "no value"
MISSING_TEXT = ("", "na", "n/a", "none", "null", "nan")
MISSING_TEXT_RAW = ("", "na", "n/a", "none", "nan")


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values) -> str:
    return ", ".join(lit(v) for v in values)


def say(template: str, **expressions: str) -> str:
    """Text from a template: '{column} fell in {month}', fields may be given as expressions."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            value = expressions.get(field, field)
            parts.append(f"coalesce(CAST({value} AS STRING), '')")
    return f"concat({', '.join(parts)})"


def clean_text(x: str) -> str:
    """NULL becomes the empty string; runs of whitespace become one blank."""
    return rf"trim(regexp_replace(coalesce(CAST({x} AS STRING), ''), '\\s+', ' '))"


def clean_text_or_nan(x: str) -> str:
    """Like clean_text, and the text 'nan' also counts as missing."""
    text = clean_text(x)
    return f"CASE WHEN lower({text}) = 'nan' THEN '' ELSE {text} END"


def _blanks(column: str) -> str:
    """Does the text need the regular expression: has it a run of blanks or a blank other than the plain one?"""
    return " OR ".join(f"contains({column}, {b})" for b in ("'  '", r"'\t'", r"'\n'", "char(11)", "char(12)", r"'\r'"))


def clean_column(column: str) -> str:
    """clean_text of a plain column, without the regular expression where it would change nothing."""
    return f"CASE WHEN {_blanks(column)} THEN {clean_text(column)} ELSE trim(coalesce(CAST({column} AS STRING), '')) END"


def clean_column_or_nan(column: str) -> str:
    """clean_text_or_nan of a plain column: the regular expression runs only over a text that has a run or a control blank."""
    text = f"coalesce(CAST({column} AS STRING), '')"
    return f"CASE WHEN {_blanks(column)} THEN {clean_text_or_nan(column)} WHEN lower(trim({text})) = 'nan' THEN '' ELSE trim({text}) END"


def text_or_nan(column: str) -> str:
    """clean_column_or_nan of a column that clean_text has been over: only the text 'nan' is left to be taken out."""
    return f"CASE WHEN octet_length({column}) = 3 AND lower({column}) = 'nan' THEN '' ELSE coalesce({column}, '') END"


def safe_identifier(x: str) -> str:
    """Upper-case slug: anything outside A-Z and 0-9 becomes one dash."""
    return f"trim(BOTH '-' FROM regexp_replace(upper({clean_text(x)}), '[^A-Z0-9]+', '-'))"


def is_missing(x: str, spellings: tuple[str, ...] = MISSING_TEXT) -> str:
    return f"({x} IS NULL OR lower(trim(CAST({x} AS STRING))) IN ({text_list(spellings)}))"


def fixed(x: str, digits: int = 2) -> str:
    """Plain text of a number with a fixed number of digits (half-even on the exact double)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return f"format_number(CAST({x} AS DOUBLE), '{pattern}')"


def grouped(x: str) -> str:
    """Two digits with thousands separators."""
    return f"format_number(CAST({x} AS DOUBLE), 2)"


def currency(x: str) -> str:
    return f"coalesce(concat('₹', {grouped(x)}), 'Not available')"


def zero(x: str) -> str:
    """Number as double, missing as zero."""
    return f"coalesce(CAST({x} AS DOUBLE), 0D)"


def currency0(x: str) -> str:
    """Currency text where a missing amount shows as zero."""
    return currency(zero(x))


def percent(x: str) -> str:
    return f"coalesce(concat({fixed(x)}, '%'), 'Not available')"


def count_text(x: str) -> str:
    return f"format_number(coalesce(CAST({x} AS BIGINT), 0), 0)"


def round2(x: str) -> str:
    """Round a double to two digits, half-even on its exact binary value."""
    return f"CAST({fixed(x)} AS DOUBLE)"


def evidence(items: dict[str, str]) -> str:
    """'Label: value; Label: value' in the given order, leaving out missing values."""
    parts = [
        f"CASE WHEN {clean_text(value)} <> '' THEN concat({lit(label + ': ')}, CAST({value} AS STRING)) END"
        for label, value in items.items()
    ]
    return f"concat_ws('; ', {', '.join(parts)})"


def year_month(date: str) -> str:
    return f"date_format({date}, 'yyyy-MM')"


def year_month_in_text(x: str) -> str:
    """First YYYY-MM with a valid month inside an id; NULL when there is none."""
    return rf"nullif(regexp_extract({clean_text(x)}, '\\d{{4}}-(0[1-9]|1[0-2])', 0), '')"


def iso_date(x: str) -> str:
    return (rf"CASE WHEN {clean_text(x)} RLIKE '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$' "
            f"THEN CAST(try_to_timestamp({clean_text(x)}, 'yyyy-M-d') AS DATE) END")


def days_between(start: str, end: str) -> str:
    return f"datediff({iso_date(end)}, {iso_date(start)})"


def number_in(x: str, pattern: str) -> str:
    """First captured number of a case-insensitive pattern, separators removed."""
    raw = f"regexp_extract({clean_text(x)}, {lit('(?i)' + pattern)}, 1)"
    return f"try_cast(nullif(replace({raw}, ',', ''), '') AS DOUBLE)"


def entity_code(explicit: str, wanted_type: str, letter: str,
                entity_type: str = "entity_type", entity_id: str = "entity_id") -> str:
    """Explicit id, else the entity id of a matching entity, else a three-digit code in it."""
    own, entity = clean_text_or_nan(explicit), clean_text_or_nan(entity_id)
    return (
        f"CASE WHEN {own} <> '' THEN {own} "
        f"WHEN {clean_text_or_nan(entity_type)} = {lit(wanted_type)} THEN {entity} "
        rf"ELSE regexp_extract({entity}, '\\b{letter}\\d{{3}}\\b', 0) END"
    )


def severity_rank(x: str = "severity") -> str:
    return f"CASE {x} WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"


def level(x: str, t) -> str:
    """Priority level of a score."""
    return (f"CASE WHEN {x} >= {t.priority_high} THEN 'High' "
            f"WHEN {x} >= {t.priority_medium} THEN 'Medium' ELSE 'Low' END")
