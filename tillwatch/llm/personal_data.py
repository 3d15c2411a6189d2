"""Personal data by weak supervision; DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Further candidates (written-out emails, national phone
numbers, credentials, identity numbers, names) are voted on by four labelers: form (a stricter pattern), context (cue words to
the left), gazetteer (known names, key prefixes, domains) and shape (mix of characters). The votes of all documents are counted
by pattern; expectation-maximisation over these counts estimates how reliable each labeler is for each kind, and its posteriors
train a naive Bayes classifier over votes and span features, which takes the final decision. What reaches the driver is one row
per (kind, votes, features): at most kinds x 3^4 x 16 rows, whatever the input.

Positions come from the gaps that split() leaves between the matches of the same pattern, added up in blocks; a candidate's left
context is the end of its gap. Overlaps are found in one order of all spans by their ends, with a running maximum, and texts are
rebuilt from blocks of fixed length. All patterns are possessive and start only where a run of their characters starts. So a text of
any size, of one long word or of very many spans, takes time in proportion to its size.

Defined results: a null text is empty; repeated rows are handled alike; empty tables give empty results; offsets are code
points; candidates that overlap a base span are dropped, so base spans stay as they are; other columns stay untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import let

MAIL = "[A-Za-z0-9._%+-]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def starts_run(characters: str) -> str:
    """A place where a run of the characters starts, or where the match before ended."""
    return rf"(?:(?<!{characters})|\G)"


@dataclass(frozen=True)
class Base:
    kind: str
    pattern: str
    may: str  # a cheap pattern that every match needs


BASE = (
    Base("email", rf"{starts_run(MAIL)}{MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Base("ip", rf"{starts_run('[0-9]')}[0-9]++(?:\.[0-9]++){{3}}", r"[0-9]\.[0-9]"),
    Base("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{11}"),
    Base("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)


@dataclass(frozen=True)
class Candidate:
    kind: str
    pattern: str
    may: str
    form: str
    cues: str
    known: str


TOKEN = "[A-Za-z0-9+/_-]"
#: Titles and common given names in English, German, French and Spanish.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Se\\x{f1}or|Se\\x{f1}ora|Sr|Sra|Don|Do\\x{f1}a"
NAMES = (
    "James", "John", "Mary", "Robert", "Patricia", "Michael", "Jennifer", "William", "Linda", "David", "Elizabeth", "Richard", "Susan", "Thomas", "Sarah", "Laura", "Paul", "Peter",
    "Hans", "Anna", "Maria", "Klaus", "Ursula", "Wolfgang", "Sabine", "Stefan", "Monika", "Andreas", "Petra", "Jürgen",
    "Jean", "Marie", "Pierre", "Jacques", "Michel", "Isabelle", "Philippe", "Nathalie", "Nicolas", "Catherine", "François", "Sophie",
    "José", "Jose", "Carlos", "Carmen", "Antonio", "Ana", "Manuel", "Francisco", "Juan", "Pilar", "Luis", "Elena", "Javier", "Lucía",
)
#: Cue words, common given names, key prefixes and mail domains.
CANDIDATES = (
    Candidate(
        "email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}(?:\x20(?:at|AT)\x20|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]{2,63}(?:\x20(?:dot|DOT)\x20|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z]{2,10}(?![A-Za-z])",
        r"\b(?:dot|DOT)\b", r"[\[(](?:at|AT)[\])]|(?:com|org|net|edu|de|fr|es)$", r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b", r"(?i)(?:gmail|yahoo|outlook|hotmail|example)"),
    Candidate(  # as written in the United States, France, Spain and Germany
        "phone", r"(?<![0-9+().-])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|[679][0-9]{2}(?:[\x20.-][0-9]{3}){2}|0[0-9]{2,4}[\x20/-][0-9]{5,8})(?![0-9.-])",
        r"[0-9][\x20./-][0-9]{2}", r"^\([0-9]{3}\)|^[0-9]{3}-[0-9]{3}-|^0[1-9](?:[\x20.-][0-9]{2}){4}$|^[679][0-9]{2}([\x20.-])[0-9]{3}\1[0-9]{3}$|^0[0-9]{2,4}[\x20/][0-9]{5,8}$",
        r"(?i)\b(?:call|tel|phone|telephone|mobile|fax|cell|number|telefon|handy|anruf|rufen|telefono|tel\x{e9}fono|m\x{f3}vil|llame|llamar|t\x{e9}l\x{e9}phone|portable|appelez)\b", r"^\(?555|^0[67]|^[67]"),
    Candidate(
        "secret", rf"(?<!{TOKEN})(?=[A-Za-z+/_-]*+[0-9]){TOKEN}{{16,}}+",
        r"[A-Za-z0-9+/_-]{16}", r"^(?:[0-9a-f]{16,}|AKIA[0-9A-Z]{16}|[A-Za-z0-9+/_-]{32,})$",
        r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|bearer)\b\W{0,4}$", r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox|glpat-|eyJ)"),
    Candidate(
        "id", r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])",
        r"[0-9]{2}", r"^(?:[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}|(?:DE|FR|ES|GB|IT|NL|BE|AT|CH)[0-9]{2})", r"(?i)\b(?:ssn|social security|iban|account|passport|id)\b", r"^(?:DE|FR|ES|GB|IT)[0-9]{2}"),
    Candidate(
        "name", rf"\b(?:{TITLES})\b\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}(?:\x20\p{{Lu}}[\p{{L}}'-]{{1,30}})?",
        rf"\b(?:{TITLES})\b", r"^(?:Mr|Mrs|Ms|Dr|Prof|M|Mme|Mlle|Sr|Sra)\.", r"(?i)\b(?:dear|name|signed|sincerely|contact|cher|ch\x{e8}re|nom|estimado|estimada|nombre|liebe|lieber|geehrte|geehrter)\b",
        rf"\b(?:{'|'.join(NAMES)})\b"),
)
KINDS = ("email", "ip", "card", "phone", "secret", "id", "name")
LABELERS = ("form", "context", "gazetteer", "shape")
ABSTAIN, FOR, AGAINST = 0, 1, 2
CONTEXT = 32
BLOCK = 256
#: Characters of a block that texts are rebuilt from.
PIECE = 1024


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, step=lambda a, b: a + b) -> Column:
    """Running totals (or maxima, by `step`) of an array of whole numbers from 0, in blocks, so that an array of any size takes little copying."""
    zero = F.lit(0).cast("long")

    def totals(some: Column, start: Column) -> Column:
        add = lambda seen, x: F.concat(seen, F.array(step(F.element_at(seen, -1), x)))
        return F.slice(F.aggregate(some, F.array(start), add), 2, F.size(some))

    def in_blocks(ls: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / BLOCK).cast("int")), lambda b: F.slice(ls, b * BLOCK + 1, BLOCK))

        def join(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, zero, step))
            before = let(totals(sums, zero), lambda t: F.concat(F.array(zero), t))
            return let(before, lambda starts: F.flatten(F.transform(parts, lambda p, b: totals(p, F.get(starts, b)))))

        return let(cut, join)

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(values, in_blocks))


def found(text: Column, pattern: str, may: str) -> Column:
    """All leftmost matches that don't overlap: array of (start, end, text, left), left being up to CONTEXT characters in front."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string,left:string>>")

    def placed(hits: Column) -> Column:
        def by_gaps(gaps: Column) -> Column:
            lengths = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long"))
            ends = running(lengths)
            near = lambda i: F.right(F.concat_ws("", F.get(hits, i - 2), F.get(gaps, i - 1), F.get(hits, i - 1), F.get(gaps, i)), F.lit(CONTEXT))
            return let(ends, lambda es: F.transform(hits, lambda h, i: F.struct(
                (F.get(es, i) - F.length(h)).alias("start"), F.get(es, i).alias("end"), h.alias("text"), near(i).alias("left"))))

        return let(F.split(text, pattern, -1), by_gaps)

    return F.when(text.rlike(may), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return {
        "email": F.lit(True), "ip": text.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", digits), "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of (start, end)."""
    def of(b: Base) -> Column:
        checked = F.filter(found(text, b.pattern, b.may), lambda s: valid(b.kind, s["text"]))
        return F.transform(checked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return {b.kind: of(b) for b in BASE}


def base_in_order() -> list[Column]:
    """The base spans as (start, order, end, kind), one array for each kind."""
    def of(kind: str, order: int) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return [of(b.kind, k) for k, b in enumerate(BASE)]


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, code): code has the votes and two features of the span."""
    def of(c: Candidate) -> Column:
        def coded(s: Column) -> Column:
            value, left = s["text"], s["left"]
            digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
            share = F.floor(4 * digits / (F.length(value) + 1))
            vote = lambda yes, no: F.when(yes, FOR).when(no, AGAINST).otherwise(ABSTAIN)
            never = F.lit(False)
            letters = value.rlike("[A-Za-z]")
            shape = {
                "secret": vote((digits >= 4) & letters & ~value.rlike("^[A-Za-z]+[0-9]{1,4}$"), (digits < 2) | ~letters | value.rlike("[-_/]{2}|(?:-[a-z]+){3}")),
                "phone": vote(value.rlike(r"([\x20.-])[0-9]{3}\1|(?:[\x20.-][0-9]{2}){4}"), value.rlike(r"^([0-9])\1{2}.*\1{4}$")),
                "id": vote(digits >= 8, value.rlike(r"^0{3}|-00-|0{4}$")),
            }.get(c.kind, vote(never, F.length(value) > 60))
            votes = [vote(value.rlike(c.form), never), vote(left.rlike(c.cues), never), vote(value.rlike(c.known), never), shape]
            features = [F.least(F.floor(F.length(value) / 12), F.lit(3)), F.least(share, F.lit(3))]
            code = F.concat_ws("", F.lit(f"{c.kind}:"), *[v.cast("string") for v in votes], F.lit(":"), *[x.cast("string") for x in features])
            return F.struct(F.lit(c.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), code.alias("code"))

        return F.transform(found(text, c.pattern, c.may), coded)

    return F.concat(*[of(c) for c in CANDIDATES])


def scanned(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs as `row` with the base spans of each kind and `more`, the candidates that overlap none of them; written once."""
    value = F.coalesce(F.col("value"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(f"`{text}`").alias("value"))
    spans = base_spans(value)
    with_base = rows.select("row", *[spans[b.kind].alias(b.kind) for b in BASE], candidates(value).alias("more"))
    return stored(with_base.withColumn("more", apart(F.concat(*[F.col(b.kind) for b in BASE]), F.col("more"))), "scanned")


def apart(base: Column, more: Column) -> Column:
    """Those of `more` that overlap none of the base spans, in order of their ends.

    Candidates by their end and base spans by their start are put in one order; a candidate overlaps a base span if one in front of
    it there ends behind the candidate's start."""
    blank = F.lit(None).cast("struct<kind:string,start:bigint,end:bigint,code:string>")
    ends = F.transform(more, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("reach"), c.alias("c")))
    begins = F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("rank"), s["end"].alias("reach"), blank.alias("c")))

    def checked(marks: Column) -> Column:
        reach = running(F.transform(marks, lambda m: m["reach"]), larger)
        free = lambda rs: F.filter(marks, lambda m, i: (m["rank"] == 0) & (F.get(rs, i) <= m["c"]["start"]))
        return F.transform(let(reach, free), lambda m: m["c"])

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(let(F.array_sort(F.concat(ends, begins)), checked))


def reliabilities(counts: list[tuple[str, int]], rounds: int = 30) -> dict[str, float]:
    """Probability of each code, by EM over votes and a classifier trained on its posteriors. Pure arithmetic on a bounded table."""
    by_kind: dict[str, list[tuple[str, list[int], list[int], int]]] = defaultdict(list)
    for code, n in sorted(counts):
        kind, votes, features = code.split(":")
        by_kind[kind].append((code, [int(v) for v in votes], [int(x) for x in features], n))
    out: dict[str, float] = {}
    for rows in by_kind.values():
        belief = {code: (1 + votes.count(FOR)) / (2 + votes.count(FOR) + votes.count(AGAINST)) if FOR in votes else 0.05 for code, votes, _, _ in rows}

        def fitted(values, sizes: list[int], lean, rows=rows, belief=belief):
            """Log odds of naive Bayes with smoothed counts; lean(k, v) adds to the count of value v of variable k for (yes, no)."""
            yes, no = 1.0, 1.0
            table = [[list(lean(k, v)) for v in range(size)] for k, size in enumerate(sizes)]
            for row in rows:
                p, n = belief[row[0]], row[3]
                yes, no = yes + p * n, no + (1 - p) * n
                for k, v in enumerate(values(row)):
                    table[k][v][0] += p * n
                    table[k][v][1] += (1 - p) * n
            totals = [[sum(cell[side] for cell in line) for side in (0, 1)] for line in table]
            result = {}
            for row in rows:
                odds = math.log(yes / no)
                for k, v in enumerate(values(row)):
                    odds += math.log(table[k][v][0] / totals[k][0]) - math.log(table[k][v][1] / totals[k][1])
                result[row[0]] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            return result

        trust = lambda k, v: {ABSTAIN: (1.0, 1.0), FOR: (2.0, 0.2), AGAINST: (0.2, 2.0)}[v]
        for _ in range(rounds):
            belief = fitted(lambda r: r[1], [3] * len(LABELERS), trust, belief=belief)
        final = fitted(lambda r: [*r[1], *r[2]], [3] * len(LABELERS) + [4, 4], lambda k, v: trust(k, v) if k < len(LABELERS) else (1.0, 1.0), belief=belief)
        out |= final
    return out


def detected(docs: DataFrame, text: str = "text", carry: list[str] | None = None, at_least: float = 0.5) -> DataFrame:
    """docs as `row`, the base spans by kind, and `spans`: all spans (start, order, end, kind) in order."""
    seen = scanned(docs, text, carry)
    counts = seen.select(F.explode("more").alias("c")).groupBy("c.code").agg(F.count("*").alias("n")).collect()
    taken = sorted(code for code, p in reliabilities([(r["code"], r["n"]) for r in counts]).items() if p >= at_least)
    chosen = F.filter("more", lambda c: F.array_contains(F.array(*[F.lit(t) for t in taken]).cast("array<string>"), c["code"]))
    spans = base_in_order()
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    spans.append(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), order[c["kind"]].alias("order"), c["end"].alias("end"), c["kind"].alias("kind"))))
    return seen.select("row", *[b.kind for b in BASE], F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(detected_rows: DataFrame) -> DataFrame:
    """The row per document of the contract."""
    basic = base_in_order()
    return detected_rows.select(
        F.col("row.doc_id").alias("doc_id"), *[F.size(b.kind).cast("long").alias(f"n_{b.kind}") for b in BASE],
        F.sha2(listed(F.array_sort(F.concat(*basic))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (overlapping spans by that of the first); n_chars follows."""
    rows = detected(docs, text)
    value = F.col(f"row.`{text}`")

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The characters from a up to b, out of the blocks that hold them."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")

        def part(k: Column) -> Column:
            begin, end = F.greatest(a - k * PIECE, F.lit(0)), F.least(b - k * PIECE, F.lit(PIECE))
            return F.substring(F.get(blocks, k), (begin + 1).cast("int"), (end - begin).cast("int"))

        return F.when(a < b, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")

    def rebuilt(blocks: Column) -> Column:
        def joined(reach: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
            new = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(between(blocks, before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(new, ""), between(blocks, F.element_at(reach, -1), F.length(value).cast("long")))

        return let(running(F.transform("spans", lambda s: s["end"]), larger), joined)

    new = F.when(F.size("spans") > 0, let(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), rebuilt)).otherwise(value)
    out = rows.select("row", new.alias("new"))
    of = {text: F.col("new")} | ({"n_chars": F.when(F.col("new") == value, F.col("row.n_chars")).otherwise(F.length("new").cast("bigint"))} if "n_chars" in docs.columns else {})
    return out.select(*[of.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
