"""Secret scan: three fixed patterns, and a battery of randomness tests over the other long tokens."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, with_found

# The patterns every scan must know, and the least length of what counts.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern of the whole token, alphabet in order; the first that fits is the inferred encoding.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64url", "^[A-Za-z0-9_-]+=*$", DIGITS + UPPER + LOWER + "-_"),
    ("base64", "^[A-Za-z0-9+/]+=*$", DIGITS + UPPER + LOWER + "+/"),
)
#: Common words of prose and code: the letter pairs of what people write.
WRITTEN = (
    "the of and to in is that for was with as his they at be this from have or by one had not but what all were when we there can an "
    "your which their said if do will each about how up out them then she many some so these would other into has more her two like "
    "him see time could no make than first been its who now people my made over did down only way find use may water long little very "
    "after words called just where most know get through back much before go good new write our used me man too any day same right "
    "look think also around another came come work three word must because does part even place well such here take why things help "
    "put years different away again off went old number great tell men say small every found still between name should home big give "
    "air line set own under read last never us left end along while might next sound below saw something thought both few those always "
    "show large often together asked house world going want school important until form food keep children feet land side without boy "
    "once animals life enough took four head above kind began almost live page got earth need far hand high year mother light parts "
    "country father let night following picture being study second eyes soon times story boys since white days ever paper hard near "
    "sentence better best across during today others however sure means knew try told young miles sun ways thing whole hear example "
    "heard several change answer room sea against top turned learn point city play toward five using himself usually money build user "
    "account handler factory service manager controller request response client server config default value key map list array index "
    "string object class method function return error exception message event stream reader writer buffer file path directory load save "
    "update delete create insert select table column row query result cache queue thread lock timeout retry count size length max min "
    "total average first last current previous parent child node tree graph edge type kind state status code version release build test "
    "check validate parse format encode decode transform filter sort merge split join group batch job task schedule worker process "
    "session token context option setting parameter argument input output source target report final draft document text image video "
    "network socket connection address host port domain link url api http json xml html style script module package import export "
    "library system platform device driver kernel memory disk storage backup archive transaction customer order product price payment "
    "invoice shipping seconds minutes hours date month number enabled disabled internal external public private static abstract "
    "temporary directory management utils helper provider listener adapter builder iterator observer registry repository entity"
)
#: Share of a letter that may follow any other.
ANY_LETTER = 0.2
#: Shares of neighbours where a piece ends, and of capitals that follow capitals: a written token has one of each.
PIECE_ENDS = (0.1, 0.2, 0.3, 0.4)
CAPITALS = (0.05, 0.5, 0.95)
MARKS = "+/_-"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: A token that a test for randomness rejects at about one in a thousand is no secret.
GATE = 3.3
FALSE_DISCOVERY = 0.01
LENGTH_BANDS = (24, 32, 48, 64, 128)
BINS_PER_DECADE, MOST_BINS = 10, 3000


def _pick(index: Column, values: list) -> Column:
    """The value that belongs to an encoding's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def pair_costs() -> list[float]:
    """log10 of the share of each letter after each other one (26 x 26, row by row) in ``WRITTEN``."""
    seen = Counter(a + b for word in WRITTEN.split() for a, b in zip(word, word[1:], strict=False))
    after = {a: sum(seen[a + b] for b in LOWER) for a in LOWER}
    return [
        math.log10(ANY_LETTER / 26 + (1 - ANY_LETTER) * (seen[a + b] / after[a] if after[a] else 1 / 26)) for a in LOWER for b in LOWER
    ]


def written_share(body: Column) -> Column:
    """log10 of an upper bound of the share that written tokens (words, names, constants, paths, dates) give to this one.

    A written token is a chain of pieces: small letters with or without a capital before them, capitals, digits,
    marks. Inside a piece letters follow each other as in ``WRITTEN``; a digit, a mark or a first letter may be
    any. How often pieces end and whether capitals stay together is the token's own: the best of the stated
    shares counts, each with an equal weight.
    """
    classes = F.translate(body, LOWER + UPPER + DIGITS + MARKS, "l" * 26 + "u" * 26 + "d" * 10 + "m" * 4)
    letters = F.lower(F.regexp_replace(body, "([a-z])(?=[A-Z])", "$1-"))
    places = F.transform(F.split(letters, "(?<=.)(?=.)"), lambda c: F.call_function("instr", F.lit(LOWER), c))
    facts = F.struct(
        *[F.regexp_count(classes, F.lit(f"{a}(?={b})")).cast("double").alias(a + b) for a, b in ("ll", "dd", "uu", "ul", "mm")],
        *[F.regexp_count(classes, F.lit(f"{a}(?=.)")).cast("double").alias("from_" + a) for a in "ludm"],
        *[F.regexp_count(classes, F.lit(a)).cast("double").alias("all_" + a) for a in "ludm"],
        places.alias("places"),
    )

    def share(t: Column) -> Column:
        pairs = F.zip_with(
            F.slice(t["places"], F.lit(1), F.size(t["places"]) - 1), F.slice(t["places"], F.lit(2), F.size(t["places"]) - 1),
            lambda a, b: F.when((a > 0) & (b > 0), _pick((a - 1) * 26 + b - 1, pair_costs())).otherwise(0.0),
        )
        inside = t["ll"] + t["uu"] + t["ul"]
        symbols = (
            F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
            - (t["all_l"] + t["all_u"] - inside) * math.log10(26) - t["all_d"] - t["all_m"] * math.log10(len(MARKS)) - math.log10(4)
        )
        ends_l, ends_u, ends_d, goes_on = t["from_l"] - t["ll"], t["from_u"] - t["uu"] - t["ul"], t["from_d"] - t["dd"], t["from_m"] - t["mm"]
        chains = [
            (t["ll"] + t["dd"]) * math.log10(1 - c) + t["uu"] * math.log10((1 - c) * w) + t["ul"] * math.log10((1 - c) * (1 - w))
            + (ends_l + ends_d) * math.log10(c / 3) + ends_u * math.log10(c / 2) + t["mm"] * math.log10(c) + goes_on * math.log10((1 - c) / 3)
            for c in PIECE_ENDS for w in CAPITALS
        ]
        return symbols + F.greatest(*chains)

    return F.element_at(F.transform(F.array(facts), share), 1)


def battery(token: Column) -> Column:
    """Struct (stratum, bin) of one token: its encoding and length band, and its evidence.

    Three statistics over the symbols of the inferred alphabet: chi-squared against equal shares, runs of
    the halves of the alphabet, lag-1 serial correlation. A token must pass each as a test of randomness
    (``GATE``). The evidence of one that passes is the share that a draw from the inferred alphabet gives to it, over the
    share that writing gives to it (``written_share``); each encoding has the weight of one in eight. A written
    token exceeds 1/p with a probability of at most p (Markov), which is kept as ``bin`` = floor(-10 log10 p).
    So short tokens can bring little evidence, whatever they look like. The parts of a UUID are one token.
    """
    body = F.rtrim(F.when(token.rlike(UUID), F.replace(token, F.lit("-"), F.lit(""))).otherwise(token), F.lit("="))
    code = F.coalesce(*[F.when(body.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)], F.lit(len(ENCODINGS) - 1))
    first = F.struct(body.alias("s"), F.length(body).cast("double").alias("n"), code.alias("code"), written_share(body).alias("written"))

    def measure(t: Column) -> Column:
        s, n, alphabet = t["s"], t["n"], _pick(t["code"], [a for _, _, a in ENCODINGS])
        k = F.length(alphabet)
        low = _pick(t["code"], [a[: len(a) // 2] for _, _, a in ENCODINGS])
        halves = F.regexp_replace(s, F.concat(F.lit("[^"), F.regexp_replace(low, F.lit("([+/-])"), F.lit("\\\\$1")), F.lit("]")), F.lit("~"))
        ones = F.length(F.regexp_replace(halves, F.lit("[^~]"), F.lit(""))).cast("double")
        return F.struct(
            n.alias("n"), k.cast("double").alias("k"), t["code"].alias("code"), t["written"].alias("written"), ones.alias("ones"),
            F.aggregate(
                F.transform(F.sequence(F.lit(1), k), lambda i: n - F.length(F.replace(s, F.substring(alphabet, i, F.lit(1)), F.lit("")))),
                F.lit(0.0), lambda a, c: a + c * c,
            ).alias("squares"),
            F.length(F.regexp_replace(halves, F.lit("[^~]+|~+"), F.lit("."))).cast("double").alias("runs"),
            F.transform(F.split(s, "(?<=.)(?=.)"), lambda c: F.call_function("instr", alphabet, c).cast("double")).alias("x"),
        )

    def with_mean(m: Column) -> Column:  # a step of its own, or each symbol would sum all of them again
        return F.struct(m.alias("m"), (F.aggregate(m["x"], F.lit(0.0), lambda a, v: a + v) / m["n"]).alias("mean"))

    def scores(t: Column) -> Column:
        m, mean = t["m"], t["mean"]
        n, k, x = m["n"], m["k"], m["x"]
        spread = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
        joint = F.aggregate(
            F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)),
            F.lit(0.0), lambda a, v: a + v,
        )
        return F.struct(
            n.alias("n"), k.alias("k"), m["code"].alias("code"), m["written"].alias("written"), m["ones"].alias("ones"), m["runs"].alias("runs"),
            (k * m["squares"] / n - n).alias("chi"), F.when(spread > 0, joint / spread).otherwise(1.0).alias("r"),
        )

    def verdict(t: Column) -> Column:
        n, k, free = t["n"], t["k"], t["k"] - 1
        cube = 2 / (9 * free)
        chi_gate = (F.pow(t["chi"] / free, F.lit(1 / 3)) - (1 - cube)) / F.sqrt(cube)
        expected = 1 + 2 * t["ones"] * (n - t["ones"]) / n
        width = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))
        run_gate = F.abs(t["runs"] - expected) / F.sqrt(width)
        drawn = (chi_gate <= GATE) & (run_gate <= GATE) & (F.abs(t["r"]) * F.sqrt(n) <= GATE)
        evidence = F.floor(BINS_PER_DECADE * (-n * F.log10(k) - math.log10(len(ENCODINGS)) - t["written"]))
        band = sum((F.when(n >= b, 1).otherwise(0) for b in LENGTH_BANDS), F.lit(0))
        return F.struct(
            (t["code"] * 10 + band).cast("int").alias("stratum"),
            F.when(drawn & (evidence > 0), F.least(evidence, F.lit(MOST_BINS))).otherwise(0).cast("int").alias("bin"),
        )

    def chain(value: Column, step) -> Column:  # a step's result is made once, however often the next step names it
        return F.element_at(F.transform(F.array(value), step), 1)

    return chain(chain(chain(chain(first, measure), with_mean), scores), verdict)


def least_bins(counts: DataFrame, q: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Benjamini-Hochberg in each stratum over p-values rounded up to their bin: the least bin that passes.

    ``counts`` has a row for each (stratum, bin): at most 60 strata of 3001 bins, whatever the corpus; one
    number for each stratum reaches the driver. Strata keep the many short tokens from hiding the long.
    """
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum")
    passing = (
        counts.withColumn("above", F.sum("n").over(down))
        .withColumn("m", F.sum("n").over(whole))
        .where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= q * F.col("above") / F.col("m")))
    )
    return {r[0]: r[1] for r in passing.groupBy("stratum").agg(F.min("bin")).collect()}


def find_secrets(docs: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """Spans of secrets: doc_id, base and extra as arrays of structs (start, kind number, end), one row per document.

    Null text counts as empty and has none; ids may be null or repeated, rows are never merged; an empty
    table gives no rows; other columns are not read. Base spans come from the three patterns, leftmost and
    non-overlapping per kind. Extra spans are tokens that the battery takes for random with the false
    discovery rate ``q``, if they touch no base span. Positions are code points, ends exclusive.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = texts
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        out = with_found(out, "text", kind, pattern)

    def spans(kind: str) -> Column:
        of = F.col(kind)
        if kind == "assign":
            of = F.filter(of, lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_LEAST)
        return F.transform(
            of, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"))
        )

    base = F.array_sort(F.concat(*[spans(k) for k in KINDS[:3]]))
    tokens = F.transform(
        F.filter("random", lambda m: ~m["text"].rlike("^([0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+)$")),
        lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), battery(m["text"]).alias("test")),
    )
    table = cut(out.select("doc_id", base.alias("base"), tokens.alias("tokens")), "secret-tokens")
    tests = table.select(F.explode("tokens.test").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n"))
    passing = least_bins(tests, q)
    least = F.create_map(*[F.lit(v) for pair in ({-1: 0} | passing).items() for v in pair])
    extra = F.filter(
        "tokens",
        lambda t: (t["test"]["bin"] >= F.coalesce(F.element_at(least, t["test"]["stratum"]), F.lit(MOST_BINS + 1)))
        & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    extra = F.transform(extra, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return table.select("doc_id", "base", extra.alias("extra"))


def written(spans: Column) -> Column:
    """kind:start:end, by start and then kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
