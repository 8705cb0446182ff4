"""URL filter: a blocked Bloom filter screens the keys of every URL, an exact hash join takes its false positives out."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, cut

#: Bits of the filter for each key, and the most blocks of 32 bytes: the broadcast never exceeds 16 MB.
BITS, MOST_BLOCKS = 12, 1 << 19
#: One odd factor below 2^31 for each of the eight words of a block; a key sets one bit in each.
FACTORS = [2 * (0x9E3779B97F4A7C15 * (j + 1) % (1 << 30)) + 1 for j in range(8)]
MOST_PATH = 2048
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null and what has no :// give two empty texts."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def canonical(url: Column) -> Column:
    """One spelling for the addresses of a page: host without user, default port, last dot and www.; path without
    last slashes; query without tracking parts and in order; no scheme, no fragment. Empty where there is no host."""
    host, path = split_url(url)
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:(80|443)?)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    text = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parts), "&"))).otherwise(""))
    return F.when(host == "", "").otherwise(text)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """The keys of both lists, each once: key, rule (null for listed pages), verdict.

    ``rules`` holds host, path, verdict; of one rule stated twice, block wins. ``listed`` holds url; its pages are
    blocked. Rules without host and addresses without host fit nothing and are left out; a null path is empty.
    """
    host, path = ascii_lower(F.coalesce(F.col("host").cast("string"), F.lit(""))), F.coalesce(F.col("path").cast("string"), F.lit(""))
    kept = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict"))
    kept = kept.where("host <> '' AND verdict IS NOT NULL").withColumn("rule", F.concat("host", "path")).groupBy("rule", "host", "path").agg(F.max("verdict").alias("verdict"))
    pages = listed.select(canonical(F.col("url")).alias("page")).where("page <> ''").distinct()
    return kept.select(F.concat(F.lit("r "), "rule").alias("key"), "rule", "verdict", "host", "path").union(
        pages.select(F.concat(F.lit("u "), "page"), F.lit(None).cast("string"), F.lit("block"), F.lit(""), F.lit(""))
    )


def bloom(keys: DataFrame) -> np.ndarray:
    """Blocked Bloom filter (blocks x 8 words of 32 bits) of the column ``hash`` of ``keys``.

    Built by one aggregation over blocks. Past the most blocks the share of false positives rises with the number
    of keys, which costs time in the exact join and changes no result.
    """
    count = keys.count()
    blocks = min(max(math.ceil(count * BITS / 256), 1), MOST_BLOCKS)
    spot = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(blocks)).cast("int")
    low = F.col("hash").bitwiseAND(0xFFFFFFFF)
    words = []
    for j, factor in enumerate(FACTORS):
        bit = F.shiftright((low * F.lit(factor)).bitwiseAND(0xFFFFFFFF), 27).cast("int")
        words.append(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(f"w{j}"))
    out = np.zeros((blocks, 8), np.uint32)
    rows = keys.groupBy(spot.alias("block")).agg(*words).toPandas()
    out[rows["block"].to_numpy(np.int64)] = rows[[f"w{j}" for j in range(8)]].to_numpy(np.int64).astype(np.uint32)
    return out


def held(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash: false only for keys that were never put in."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(len(filter_words))
    low, found = h & np.uint64(0xFFFFFFFF), np.ones(len(h), bool)
    for j, factor in enumerate(FACTORS):
        bit = ((low * np.uint64(factor)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        found &= (filter_words[block, j] >> bit.astype(np.uint32)) & np.uint32(1) == 1
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    A rule (host, path) fits its host and all subdomains if the path starts with the rule's; of several the longest
    written one counts (of equal length the one with the longer host). Without a rule a page whose canonical address is
    listed is blocked, any other gets ``default``.

    1. The keys of a URL are its host endings and path beginnings of the shapes (labels, path length) that rules have,
       and its canonical address. Shapes are at most 127 x ``MOST_PATH``: longer rules are refused.
    2. Keys meet a blocked Bloom filter of all listed keys, broadcast, of at most 16 MB. A URL none of whose
       keys pass is done, without a shuffle.
    3. Distinct URLs with passing keys meet the lists in an exact hash join on the key, which ends false positives.

    Null URLs and such without :// have an empty host and get the default; ids may be null or repeated, each row is
    judged; an empty table gives no rows; empty lists give the default everywhere; other columns are not read.
    """
    spark = pages.sparkSession
    lists = cut(entries(rules, listed), "url-lists")
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    shapes = [(r.k, r.n) for r in lists.where("rule IS NOT NULL").select((dots + 1).alias("k"), F.length("path").alias("n")).distinct().limit(127 * (MOST_PATH + 1) + 1).collect()]
    if any(k > 127 or n > MOST_PATH for k, n in shapes):
        raise ValueError(f"rules have at most 127 labels and {MOST_PATH} characters of path")
    words = spark.sparkContext.broadcast(bloom(lists.select(F.xxhash64("key").alias("hash"))))

    @F.arrow_udf("array<boolean>")
    def may_hold(hashes: pa.Array) -> pa.Array:
        ends = hashes.offsets.to_numpy()
        flat = hashes.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(held(words.value, flat)))

    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    shape = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k:int,n:int>>")
    fitting = F.filter(shape, lambda s: (F.col("host") != "") & (s["k"] <= dots + 1) & (s["n"] <= F.length("path")))
    begun = F.transform(
        fitting, lambda s: F.concat(F.lit("r "), F.call_function("substring_index", F.col("host"), F.lit("."), -s["k"]), F.call_function("left", F.col("path"), s["n"]))
    )
    page = canonical(F.col("url"))
    keys = F.concat(begun, F.when(page != "", F.array(F.concat(F.lit("u "), page))).otherwise(F.array().cast("array<string>")))
    urls = urls.withColumn("keys", keys).withColumn("passed", may_hold(F.transform("keys", lambda k: F.xxhash64(k))))
    some = F.exists("passed", lambda p: p)

    hits = F.filter(F.arrays_zip("keys", "passed"), lambda z: z["passed"])
    found = urls.where(some).select("url", F.transform(hits, lambda z: z["keys"]).alias("keys")).distinct()
    found = found.select("url", F.explode("keys").alias("key")).join(lists, "key")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), F.length("host"), "rule", "verdict"))
    judged = found.groupBy(F.col("url").alias("u")).agg(F.max(rank).alias("best"), F.max(F.col("rule").isNull()).alias("listed"))

    plain = urls.where(~some).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(False).alias("listed"))
    is_listed = F.coalesce("listed", F.lit(False))
    passed = urls.where(some).join(judged, F.col("url") == F.col("u"), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(is_listed, "block").otherwise(default)).alias("verdict"), is_listed.alias("listed"),
    )
    return plain.union(passed)


#: The rules of the query, and the name parts of hosts whose pages it lists. Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UNWANTED = ["adult", "bets", "casino", "pills", "spam", "ads"]
UNWANTED_HOST = rf"(^|[.-])({'|'.join(UNWANTED)})([.-]|$)"


def unwanted_pages(pages: DataFrame) -> DataFrame:
    """The list of the query: addresses on hosts with an unwanted name part; it grows with the pages."""
    return pages.where(split_url(F.col("url"))[0].rlike(UNWANTED_HOST)).select("url")
