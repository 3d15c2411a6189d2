"""op3, op5, op6, op9 and op10 against brute force or held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillwatch.llm import decontaminate, language_id, quality_rules, toxicity, url_templates
from tillwatch.llm.fm_index import FMIndex


def test_fm_index_counts_and_locates():
    import numpy as np

    draw = np.random.default_rng(4)
    text = np.concatenate([draw.integers(1, 4, 300), np.tile([1, 2], 100), draw.integers(1, 30, 200)])
    index = FMIndex(text, 30)
    for size in (1, 2, 5):
        patterns = np.array([text[i : i + size] for i in range(0, 690, 7)] + [[29] * size])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


@pytest.mark.parametrize("part_bytes", [16 << 20, 2_000])
def test_decontamination(spark, docs, odd, part_bytes):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").union(
        spark.createDataFrame([(900, "The quick brown FOX"), (901, None), (None, "shared1 shared2 shared3"), (902, "one"), (902, "one")], "item_id long, text string"))
    frame = docs.select("doc_id", "text").union(odd.select(odd.doc_id + 10**6, "text"))
    windows = {}
    for r in items.collect():
        w = alnum(r.text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).update([] if r.item_id is None else [str(r.item_id)])
    want = Counter()
    for r in frame.collect():
        w, hit, ids = alnum(r.text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids |= windows[tuple(w[i : i + size])]
        want[(r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    got = decontaminate.digest(decontaminate.mark(frame, items, part_bytes=part_bytes, block_bytes=50_000))
    assert Counter(tuple(r) for r in got.collect()) == want
    clean = decontaminate.remove(frame, items, part_bytes=part_bytes)
    full = decontaminate.mark(clean, items.where("length(text) > 60"))
    assert full.where("size(hits) > 0").count() == 0


def test_decontamination_keeps_columns_and_empty_inputs(spark, odd):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown")], "item_id long, text string")
    out = decontaminate.remove(odd, items)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert decontaminate.mark(odd, items.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.remove(odd.limit(0), items).count() == 0


def quality_by_force(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, repeated = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            repeated.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    counts = (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
    return (*counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0])


def test_quality_counts(odd):
    got = quality_rules.judge(odd).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r)[2:8] == quality_by_force(r.text), r.doc_id
        assert not (r.kept and r.base_failed)
    assert quality_rules.keep_good(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_sketch_buckets(spark):
    values = spark.createDataFrame([(v,) for v in [*range(300), 1000, 4095, 4096, 10**6, 10**12]], "v long")
    for r in values.select("v", quality_rules.bucket_top(quality_rules.bucket(F.col("v"))).alias("top")).collect():
        assert r.v <= r.top <= r.v + max(0, r.v // 32)


def test_sketches_merge_and_quartiles(spark):
    rows = [(i, "en", f"s{i % 60}", " ".join(["word" * (1 + i % 9)] * 12)) for i in range(600)]
    measured = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    sketch = quality_rules.sketches(measured)
    lengths = sorted(4000 * (1 + i % 9) for i in range(600))
    row = quality_rules.quantiles(sketch, ["lang"]).where("metric = 'word_length'").first()
    assert row["rows"] == 600
    for got, want in ((row.q1, lengths[149]), (row.q3, lengths[449])):
        assert want <= got <= want * 33 / 32


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("https://m.therin.example.org/en/1472/", "m.therin.example.org", "/en/1472/", "example.org/en/1", "block"),
    ("http://EXAMPLE.ORG/es/9?x=1", "example.org", "/es/9", "example.org/es/", "block"),
    ("http://other.org/es/9#top", "other.org", "/es/9", "org/", "allow"),
    ("http://notexample.org/es/9", "notexample.org", "/es/9", "org/", "allow"),
    ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"), ("http://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
    ("http://example.org", "example.org", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
    ("x://y.net?u=http://z.com/de/", "y.net", "", None, None), ("://", "", "", None, None),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = url_templates.judged(spark.createDataFrame([(1, url, "t")], "page_id long, url string, template string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_templates_learn_from_labels(spark):
    urls = [f"http://h{i % 3}.com/de/{i}" for i in range(60)] + [f"http://h{i % 3}.com/fr/{i}" for i in range(60)]
    urls += [f"http://x.net/de/{i}" for i in range(20)] + [f"http://x.net/fr/{i}" for i in range(20)] + [None, None]
    out = url_templates.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    net = {(r.template, r.verdict) for r in out.where("host = 'x.net'").collect()}
    assert net == {("/de/{number}", "block"), ("/fr/{number}", "allow")}
    assert out.count() == len(urls)
    assert url_templates.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def outside(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_on_held_out_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predicted(frame).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == outside(r.doc_id) for r in rows)
    aside = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in aside) >= 0.97 * len(aside)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd):
    rows = language_id.predicted(odd).select("row.text", "lang_pred", "score").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in language_id.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.predicted(odd.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels, carry=["doc_id"]).select("row.doc_id", "held_out", "score", "predicted").join(labels, "doc_id").collect()
    aside = [r for r in rows if r.held_out]
    toxic = [r for r in aside if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted and not r.toxic for r in aside) <= 0.02 * len(aside)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(12, 1), (12, 0), (13, 0), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.scored(odd.limit(0), labels).count() == 0


def templates_by_force(urls, shape):
    """The tree, host by host and node by node: path -> template; urls: (host, path, label or None), with repeats."""
    import math

    def form(segment):
        found = re.search(r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", segment)
        ending = found[1] if found else ""
        stem = segment[: len(segment) - len(ending)]
        kind = "{number}" if re.fullmatch("[0-9]+", stem) else "{hex}" if re.fullmatch("[0-9a-fA-F-]{8,}", stem) else "{slug}"
        return kind + ending

    out = {}

    def go(host, pages, template):
        here = [p for p in pages if not p[1]]
        for p in here:
            out[host, p[0]] = template
        pages = [p for p in pages if p[1]]
        if not pages:
            return
        groups = {}
        for p in pages:
            groups.setdefault(p[1][0], []).append(p)
        known = [p[2] for p in pages if p[2] is not None]
        deeper, several = {}, len({p[0] for p in pages}) > 1
        for segment, own in groups.items():
            mine = [p[2] for p in own if p[2] is not None]
            rest = len(known) - len(mine)
            told = len(mine) >= shape.min_pages and rest > 0
            differs = False
            if told:
                rate = sum(known) / len(known)
                gap = abs(sum(mine) / len(mine) - (sum(known) - sum(mine)) / rest)
                differs = gap >= shape.z * math.sqrt(max(rate * (1 - rate), 1e-9) * (1 / len(mine) + 1 / rest))
            keep = several and len(own) >= shape.min_pages and (differs or len(own) >= shape.min_share * len(pages))
            name = ("{any}" if told and not differs else segment) if keep else form(segment)
            deeper.setdefault(name, []).extend((p[0], p[1][1:], p[2]) for p in own)
        for name, some in deeper.items():
            go(host, some, f"{template}/{name}")

    hosts = {}
    for host, path, label in urls:
        hosts.setdefault(host, []).append((path, [x for x in path.split("/") if x], label))
    for host, pages in hosts.items():
        go(host, pages, "")
    return out


def verdicts_by_force(urls, shape):
    templates = templates_by_force(urls, shape)
    own, over, total = {}, {}, [0, 0]
    for host, path, label in urls:
        for at in (own.setdefault((host, templates[host, path]), [0, 0]), over.setdefault(templates[host, path], [0, 0]), total):
            if label is not None:
                at[0] += 1
                at[1] += label
    prior, k = total[1] / total[0] if total[0] else 0.0, shape.weight
    general = {t: (b + k * prior) / (n + k) for t, (n, b) in over.items()}
    return {(host, path): (t := templates[host, path], (own[host, t][1] + k * general[t]) / (own[host, t][0] + k)) for host, path, _ in urls}


def random_urls(seed):
    draw = random.Random(seed)
    urls = []
    for _ in range(700):
        host = draw.choice(["a.org", "b.com", "c.net", "example.org", "d.net"])
        words = [draw.choice(["es", "en", "fr", "de", "x", "list"])] + [draw.choice(["news", "p", str(draw.randrange(30)), "a1b2c3d4", f"item{draw.randrange(9)}.html"]) for _ in range(draw.randrange(5))]
        urls.append(f"http://{host}/" + "/".join(words))
    return urls + ["http://c.net/" + "/".join("abcdefghijkl"[: 9 + i % 3]) + f"/{i}" for i in range(40)] + [None, "http://a.org"]


@pytest.mark.parametrize("seed", [1, 2])
def test_url_tree_against_brute_force(spark, seed):
    shape = url_templates.Shape(min_pages=4, min_share=0.1)
    got = url_templates.judged(spark.createDataFrame(list(enumerate(random_urls(seed))), "page_id long, url string"), shape=shape).collect()
    label = {"block": 1, "allow": 0}
    verdict = {r.name: r.verdict for r in url_templates.RULES}
    want = verdicts_by_force([(r.host, r.path, label[verdict[r.rule]] if r.rule else None) for r in got], shape)
    for r in got:
        template, rate = want[r.host, r.path]
        assert (r.template, round(r.block_rate, 9)) == (template, round(rate, 9)), (r.host, r.path)
        assert r.verdict == (verdict[r.rule] if r.rule else "block" if rate >= shape.reject_from - 1e-12 else "allow")


def test_small_share_with_many_labels_keeps_its_branch(spark):
    """500 labelled pages that are 4 % of their parent, below nine levels: told apart by their own rate."""
    rules = (url_templates.Rule("block", "h.net", "/a/b/c/d/e/f/g/h/bad/1"), url_templates.Rule("allow", "h.net", "/a/b/c/d/e/f/g/h/good"))
    deep = "http://h.net/a/b/c/d/e/f/g/h/"
    urls = [f"{deep}bad/1{i}" for i in range(500)] + [f"{deep}bad/2{i}" for i in range(20)] + [f"{deep}good{i % 300}/{i}" for i in range(12_500)]
    rows = url_templates.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).select("path", "rule", "template", "verdict").collect()
    free = [r for r in rows if r.rule is None]
    assert len(free) == 20 and {(r.template, r.verdict) for r in free} == {("/a/b/c/d/e/f/g/h/bad/{number}", "block")}


def test_every_language_is_learned(spark):
    """300 labels, one of them only in a text longer than its part of the bytes."""
    draw = random.Random(5)
    rows, words = [], {}
    for k in range(300):
        words[k] = ["".join(chr(0x4E00 + 40 * k + draw.randrange(40)) for _ in range(3)) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(draw.choice(words[k]) for _ in range(40)), f"l{k}") for i in range(12)]
    rows = [r for r in rows if r[2] != "l7"] + [(7001, " ".join(words[7] * 40), "l7")]
    rows = [r for r in rows if not outside(r[0])] + [(900_000 + 4 * k, " ".join(words[k][:20]), None) for k in range(300)]
    fit = language_id.Fit(rows_each=20, most_rows=3000, most_bytes=600_000, epochs=12)
    got = {r.row.doc_id: r.lang_pred for r in language_id.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit).where("row.lang IS NULL").collect()}
    assert len(set(got.values())) >= 290


def test_sample_bounds(spark):
    from tillwatch.llm.samples import labelled_sample

    rows = [(i, "a", "x" * 100) for i in range(2000)] + [(5000 + i, "b", "y" * 100) for i in range(3)] + [(9000, "c", "z" * 50_000), (9001, "c", "z" * 90_000)]
    table = labelled_sample(spark.createDataFrame(rows, "id long, label string, text string"), 500, 100, 30_000).to_pydict()
    assert Counter(table["label"]) == {"a": 95, "b": 3, "c": 1} and max(map(len, table["text"])) == 50_000


def test_benchmark_in_parts_holds_one_broadcast(spark, docs, monkeypatch):
    """Many small parts give the rows of one part, one broadcast alive at a time; equal items count once."""
    texts = [r.text for r in docs.where("length(text) > 400").limit(12).collect()]
    items = spark.createDataFrame([(i % 5, t[20:380]) for i, t in enumerate(texts)] * 3 + [(None, "a b")], "item_id long, text string")
    whole = decontaminate.digest(decontaminate.mark(docs.select("doc_id", "text"), items)).orderBy("doc_id").collect()
    alive, seen = set(), []
    make = type(spark.sparkContext).broadcast

    def counted(context, value):
        sent = make(context, value)
        end = sent.destroy
        alive.add(id(sent))
        seen.append(len(alive))
        sent.destroy = lambda: (alive.discard(id(sent)), end())
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    parted = decontaminate.digest(decontaminate.mark(docs.select("doc_id", "text"), items, part_bytes=800)).orderBy("doc_id").collect()
    assert parted == whole and any(r.n_items > 0 for r in whole) and len(seen) > 3 and max(seen) == 1


def test_ftrl_against_a_plain_loop():
    """One document a step, one coordinate at a time, with Python numbers."""
    import math

    import numpy as np
    import pyarrow as pa

    draw = random.Random(6)
    texts = [" ".join(draw.choice(["good", "bad", "ugly", "fine", "word", "other"]) for _ in range(draw.randrange(1, 12))) for _ in range(40)]
    labels = [int("bad" in t) for t in texts]
    fit = toxicity.Fit(epochs=2, buckets=512, l1=0.2)
    model = toxicity.fitted(pa.table({"label": labels, "text": texts}), fit)
    bags = [sorted(set(toxicity.features(pa.array([t]), fit.buckets)[1].tolist())) for t in texts]
    z, n, bias, bias_n = [0.0] * fit.buckets, [0.0] * fit.buckets, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= fit.l1 else (math.copysign(fit.l1, z[i]) - z[i]) / ((fit.beta + math.sqrt(n[i])) / fit.alpha + fit.l2)

    order = np.random.default_rng(fit.seed)
    for _ in range(fit.epochs):
        for k in order.permutation(len(bags)):
            w = {i: weight(i) for i in bags[k]}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()) + bias)))) - labels[k]
            for i in bags[k]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / fit.alpha * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= fit.alpha * g / (fit.beta + math.sqrt(bias_n))
    got = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    assert abs(model.bias - bias) < 1e-9 and set(got) == {i for i in range(fit.buckets) if weight(i)}
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in got)


def test_rejection_of_languages(spark):
    """Accepted predictions keep the wanted accuracy; texts of no learned language are rejected more often than others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(9)
    noise = [(10**7 + i, " ".join("".join(draw.choice("xqzkwj") for _ in range(5)) for _ in range(20)), None) for i in range(100)]
    rows = language_id.predicted(docs.union(spark.createDataFrame(noise, docs.schema))).select("row.doc_id", "row.lang", "lang_pred", "score", "held_out", "rejected").collect()
    known = [r for r in rows if r.doc_id < 10**7 and r.held_out and not r.rejected]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.98 * len(known) and len(known) >= 100
    strange = [r for r in rows if r.doc_id >= 10**7]
    assert sum(r.rejected for r in strange) / len(strange) > sum(r.rejected for r in rows if r.doc_id < 10**7) / (len(rows) - len(strange))
