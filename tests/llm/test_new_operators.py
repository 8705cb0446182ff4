"""URL filter, filter audit and fill-in-the-middle against plain loops; and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import fill_in_middle, filter_audit, url_filter

# --- 11: URL filter -----------------------------------------------------------

RULES = url_filter.RULES + [("a.b.example.org", "/x", "block"), ("example.org", "/xy/", "allow"), ("example.org", "", "block"), ("example.org", "", "allow"), (None, "/", "block")]
URLS = [
    "http://example.com/en/1", "http://WWW.Example.com/en/1?q#f", "https://sub.example.com/en/", "http://notexample.com/en/1", "http://x.net/es/a",
    "http://x.net/es", "http://net/fr/", "http://example.com", "http://example.com?/en/", "http://a.b.example.org/xy/z", "http://c.a.b.example.org/xz",
    "http://b.example.org/xy/", "http://example.org:80/", "no url", "", None, "://", "http:///path", "http://user@spam.example.info:80/p/?b=2&a=1&utm_source=x#f",
    "https://www.spam.example.info./p?a=1&b=2", "https://spam.example.info/p", "http://.com/", "http://" + "a." * 5000 + "com/" + "b/" * 5000, "//é.net/es/", "ftp://é.net/es/",
    "http://x.com/\nline", "http://a\nb.net/fr/1",
]


def judged(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = {}
    for rule_host, rule_path, verdict in RULES:
        if rule_host and host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            key = (len(rule_host + rule_path), len(rule_host), rule_host + rule_path)
            fits[key] = max(fits.get(key, ""), verdict)
    best = max(fits) if fits else None
    verdict = fits[best] if fits else ("block" if url in listed else "allow")
    return host, path, best[2] if best else None, verdict


@pytest.mark.parametrize("most", [url_filter.MOST_BLOCKS, 1])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)  # one block for all keys lets nearly everything pass
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3]), (3, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(URLS[18],), ("http://a.example.org/",), (None,), ("nothing",)], "url string")
    got = sorted((tuple(r)[:5] for r in url_filter.judge_urls(pages, rules, listed).collect()), key=repr)
    assert got == sorted(((i, *judged(u, URLS[18:20])) for i, u in rows), key=repr)
    none = url_filter.judge_urls(pages, rules.limit(0), listed.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"} and url_filter.judge_urls(pages.limit(0), rules, listed).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, spark.createDataFrame([("a", "/" * 3000, "block")], rules.schema), listed)


def test_canonical(spark):
    same = [URLS[18], URLS[19], "http://SPAM.example.info/p//?a=1&b=2&ref=q"]
    got = spark.createDataFrame([(u,) for u in same + [URLS[20], "x", None]], "url string").select(url_filter.canonical(F.col("url"))).collect()
    assert [r[0] for r in got] == ["spam.example.info/p?a=1&b=2"] * 3 + ["spam.example.info/p", "", ""]
    assert urlsplit(URLS[20]).hostname + "/p" == got[3][0]


def test_bloom_holds_all_and_little_else(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    words = url_filter.bloom(keys)
    assert url_filter.held(words, np.array([r[0] for r in keys.collect()])).all()
    other = np.array([r[0] for r in spark.range(20_000, 60_000).select(F.xxhash64("id")).collect()])
    assert url_filter.held(words, other).mean() < 0.02
    assert not url_filter.held(url_filter.bloom(keys.limit(0)), other).any()


# --- 12: filter audit ---------------------------------------------------------


def audited(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        marks = [m for m in labels if m[0] == i and i is not None]
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = {}
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                out[part, "".join(order), step + 1] = [
                    len(left) - len(gone), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f
                ]
                total[f] += len(gone)
                left = [d for d in left if f not in d[0]]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, edge, nothing):
    rng = random.Random(12)
    texts = ["", None, "A " * 250, "a# " * 10, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)), "é  *B" * 80, "  x"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("part", F.lit(0)).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_filters(docs, marks).collect()}
    assert got == audited(rows, labels)
    awkward = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_filters(edge, marks.limit(0)).collect()}
    assert got == audited(awkward, [])
    assert filter_audit.audit_filters(nothing, marks).count() == 0


def test_potential_is_the_sum_over_orders(spark):
    rng = random.Random(4)
    worth = [0] + [rng.randint(0, 50) for _ in range(15)]
    p = spark.range(1).select(filter_audit.potential(F.array(*[F.lit(x).cast("long") for x in worth]), 4)).first()[0]
    for i in range(4):
        total = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += worth[before | 1 << i] - worth[before]
        assert p[15] - p[15 ^ (1 << i)] == total


# --- 13: fill in the middle ---------------------------------------------------


def made(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


@pytest.mark.parametrize("block", [1, 7, fill_in_middle.BLOCK])
def test_cut_places(block):
    rng = random.Random(block)
    for _ in range(300):
        text = "".join(rng.choice("abZ09 é😀<") for _ in range(rng.randint(0, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        start, lead = fill_in_middle.unit_starts(data, np.array([0, len(data)]))
        draws = [rng.getrandbits(32), rng.getrandbits(32)]
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        want = [len("".join(units[:c])) for c in sorted(d % (len(units) + 1) for d in draws)]
        assert fill_in_middle.places(start, lead, draws, block) == (len(units), *want)


def test_fill_in_middle(spark, folder, edge, nothing):
    rng = random.Random(13)
    pieces = ["<", "P", ">", "<P", "<S>", "S>", "<M", "word", "é", "😀", " ", "\n", "Z"]
    odd = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for df in (docs, edge, spark.read.parquet(f"{folder}/documents.parquet").repartition(2)):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        out = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
        assert sorted((tuple(r) for r in out), key=repr) == sorted(((i, *made(i, t), t) for i, t in rows), key=repr)
    assert {r.form for r in fill_in_middle.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(nothing).count() == 0
