"""Operator 7: secret scans with character Markov models (DataFrame functions only).

First-order Markov models over the printable ASCII characters are counted from
labelled samples: one of ordinary identifiers (words of a bounded sample of
documents, base matches taken out, alone and joined as programs and paths join
them; runs of one character and of successive ones), and one for each class of
random strings (by the kinds of characters that a string has: lower case,
hexadecimal, mixed, ...), drawn from the usual alphabets of keys, and the values
that base patterns find.  A random string's characters are about even over its
alphabet, so a class is kept as the mean log probability of its pairs.  Every
long token of every text is scored by the mean log-likelihood ratio of its
pairs, random of its class against ordinary, and reported where that reaches a
threshold.  There is one for each range of lengths, the least at which at most
``max_false`` of the ordinary samples that weren't counted would be reported;
precision and recall on held-out samples are in the model.

Documents hold secrets that no base pattern finds, so ordinary samples which a
first model takes for random ones are left out and the model counted again.

Spark has no function for the places of all matches: a text is split at the
matches, and the lengths of the parts before each match add up to its place.
Lengths count code points.  Texts are read once; what is kept of a text is its
matches and the distances between them.

Kinds: assign, access, hex (base) and markov (the method's).  A markov token
that overlaps a base span of its text isn't reported again.

Defined cases: null and empty texts have no spans; repeated rows get a row
each; a null id is kept; without any ordinary word there is no model and nothing
is added; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Base patterns (fixed values); the least length of what must be long, by kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
#: Tokens that the models score.
TOKEN = r"[A-Za-z0-9+/=_-]{16,}"
#: Alphabets of random strings, and what joins the words of an ordinary identifier.
ALPHABETS = [string.ascii_letters + string.digits + more for more in ("", "", "+/", "-_")] + [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"]
JOINS = ["_", "-", "/", ""]
#: Classes of strings by the characters they have besides + / = _ and -: the first that fits.
CLASSES = [r"[0-9]*", r"[a-z]*", r"[A-Z]*", r"[0-9a-f]*", r"[a-z0-9]*", r"[A-Z0-9]*", r"[a-zA-Z]*", r"(?s).*"]
#: Random pairs that a class needs; the strings of one with fewer, such as digits alone (numbers of cards and telephones), are never reported.
LEAST_PAIRS, NEVER = 10_000, -1000.0
#: Least lengths of the ranges that have a threshold of their own.
LENGTHS = [16, 20, 24, 32]
KINDS = ["assign", "access", "hex", "markov"]
#: Characters 32 to 127; others count as 127.
_CHARACTERS = 96


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a text: array of (gap before, match, kind); null where there are none."""
    # a class with a counted + is greedy, so {16,} and {24,} match where the plain + would with that length
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("hit")), lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"), F.lit(kind).alias("kind")))
    return F.when(F.size(matches) > 0, pairs)


def _pairs_of(word: Column) -> Column:
    """Codes of the character pairs of a word."""
    codes = F.transform(F.split(word, ""), lambda c: F.least(F.greatest(F.ascii(c) - 32, F.lit(0)), F.lit(_CHARACTERS - 1)))
    paired = lambda own: F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own) - 1), lambda a, b: a * _CHARACTERS + b + 1)
    return F.flatten(F.transform(F.array(codes), paired))


def class_of(word: Column) -> Column:
    """The number of a string's class."""
    bare, out = F.regexp_replace(word, "[+/=_-]", ""), F.lit(len(CLASSES) - 1)
    for k in reversed(range(len(CLASSES) - 1)):
        out = F.when(bare.rlike(f"^{CLASSES[k]}$"), k).otherwise(out)
    return out


def range_of(word: Column) -> Column:
    """The number of the range of lengths that a string is in; the first for shorter ones."""
    return sum((F.when(F.length(word) >= n, 1).otherwise(0) for n in LENGTHS[1:]), F.lit(0))


@dataclass(frozen=True)
class SecretModel:
    """Ordinary costs (negative log probabilities) of character pairs, each class's mean log probability of a random pair, and the thresholds by range of lengths.

    ``false_share``: of held-out ordinary samples, those reported; ``recall``: of random ones, those reported.
    """

    costs: list[float]
    evenness: list[float]
    thresholds: list[float]
    false_share: float
    recall: float


def random_strings(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """word: n strings of 16 to 48 characters that look like keys, each drawn from one of the alphabets."""
    draw = lambda *parts: F.xxhash64(F.lit(seed), F.col("id"), *parts)
    alphabet = F.get(F.array(*map(F.lit, ALPHABETS)), F.pmod(draw(F.lit("a")), F.lit(len(ALPHABETS))).cast("int"))
    rows = spark.range(n).select("id", alphabet.alias("alphabet"), F.sequence(F.lit(1), F.pmod(draw(F.lit("n")), F.lit(33)) + 16).alias("places"))
    return rows.select(F.array_join(F.transform("places", lambda i: F.substr("alphabet", F.pmod(draw(i), F.length("alphabet")).cast("int") + 1, F.lit(1))), "").alias("word"))


def identifiers(words: Column, seed: int = 7) -> Column:
    """Ordinary identifiers of three successive words each, joined in one of the ways of JOINS or in camel case."""

    def joined(i: Column) -> Column:
        own = [F.get(words, i + k) for k in range(3)]
        camel = F.concat(own[0], *map(F.initcap, own[1:]))
        way = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(len(JOINS) + 1)).cast("int")
        mark = F.get(F.array(*map(F.lit, JOINS)), way)
        return F.when(way == len(JOINS), camel).otherwise(F.concat(own[0], mark, own[1], mark, own[2]))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 3, F.lit(3)), joined), lambda w: F.length(w) >= 12)


def _plain_runs(spark: SparkSession, copies: int) -> DataFrame:
    """word: runs of one character, and of successive characters, each ``copies`` times."""
    runs = [chr(c) * 24 for c in range(33, 127)] + [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.digits * 2]
    return spark.range(copies).select(F.explode(F.array(*map(F.lit, runs))).alias("word"))


def train(samples: DataFrame) -> tuple[list[float], list[float]] | None:
    """Ordinary costs and the evenness of each class, from (word, secret) samples with words of 2 or more characters.

    The ordinary model is mixed with a tenth of even probabilities, so a rare
    pair weighs little.  The counts that reach the driver are at most 96 * 96
    for the ordinary model and each class.
    """
    kind = F.when(F.col("secret"), class_of(F.col("word"))).otherwise(-1).alias("class")
    counted = samples.select(kind, F.explode(_pairs_of(F.col("word"))).alias("pair")).groupBy("class", "pair").count().collect()
    n = {k: [0.0] * _CHARACTERS**2 for k in range(-1, len(CLASSES))}
    for row in counted:
        n[row["class"]][row["pair"] - 1] += row["count"]
    if not any(n[-1]) or not any(any(n[k]) for k in range(len(CLASSES))):
        return None
    costs = []
    for a in range(_CHARACTERS):
        own = n[-1][a * _CHARACTERS : (a + 1) * _CHARACTERS]
        costs += [round(-math.log(0.9 * x / max(sum(own), 1.0) + 0.1 / _CHARACTERS), 6) for x in own]
    evenness = []
    for k in range(len(CLASSES)):
        rows = [n[k][a * _CHARACTERS : (a + 1) * _CHARACTERS] for a in range(_CHARACTERS)]
        total = sum(map(sum, rows))
        logs = sum(x * math.log(x / sum(row)) for row in rows for x in row if x)
        evenness.append(round(logs / total, 6) if total >= LEAST_PAIRS else NEVER)
    return costs, evenness


def mean_ratio(word: Column, costs: list[float], evenness: list[float]) -> Column:
    """Mean log-likelihood ratio of a word's character pairs, random against ordinary."""
    table = F.expr(f"array({','.join(f'{x}D' for x in costs)})")
    cost = F.aggregate(_pairs_of(word), F.lit(0.0), lambda s, p: s + F.element_at(table, p.cast("int"))) / (F.length(word) - 1)
    return cost + F.get(F.array(*map(F.lit, evenness)), class_of(word))


def fit(plain: DataFrame, found: DataFrame, *, samples: int = 20_000, max_false: float = 0.001) -> SecretModel | None:
    """Train on half of the samples and set the thresholds on the other half.

    ``plain``: word, ordinary identifiers; ``found``: word, values that base
    patterns found; ``samples``: how many random strings are drawn.
    """
    spark = plain.sparkSession
    secret = random_strings(spark, samples).unionByName(found.select("word").distinct())
    rows = secret.withColumn("secret", F.lit(True)).unionByName(plain.select("word").withColumn("secret", F.lit(False)))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("word"), F.lit(2)))
    # runs are few kinds, counted often enough to weigh among the joined words
    runs = _plain_runs(spark, 400).select("word", F.lit(False).alias("secret"), F.lit(0).cast("long").alias("fold"))
    rows = common.checkpoint(rows.unionByName(runs))
    first = train(rows.where("fold = 0"))
    if first is None:
        return None
    # ordinary samples that are more like random ones hold secrets of the texts
    rows = common.checkpoint(rows.where(F.col("secret") | (mean_ratio(F.col("word"), *first) < 0)))
    trained = train(rows.where("fold = 0"))
    if trained is None or rows.where("fold = 1 and not secret").isEmpty():
        return None
    # hundredths of the ratio, which lies within a few units of 0: a bounded histogram
    held = rows.where("fold = 1").groupBy("secret", range_of(F.col("word")).alias("range"), F.floor(100 * mean_ratio(F.col("word"), *trained)).cast("int").alias("at")).count().collect()
    n = {kind: [{r["at"]: r["count"] for r in held if r["secret"] == kind and r["range"] == k} for k in range(len(LENGTHS))] for kind in (True, False)}
    above = lambda counts, at: sum(c for k, c in counts.items() if k >= at)
    marks = []
    for k in range(len(LENGTHS)):
        # a range with few ordinary samples takes those of the shorter ones too, which vary more
        own, j = dict(n[False][k]), k
        while sum(own.values()) * max_false < 1 and j:
            j -= 1
            own = {at: own.get(at, 0) + n[False][j].get(at, 0) for at in {*own, *n[False][j]}}
        total = sum(own.values())
        places = sorted({*own, max(own, default=-1) + 1, 0})
        marks.append(next(at for at in places if above(own, at) <= max_false * total and (total or at >= 0)))
    share = lambda kind: sum(above(n[kind][k], marks[k]) for k in range(len(LENGTHS))) / max(1, sum(sum(x.values()) for x in n[kind]))
    return SecretModel(*trained, [m / 100 for m in marks], share(False), share(True))


def scan(docs: DataFrame, *, sample_docs: int = 1000, max_false: float = 0.001, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id and spans, an array of (start, kind number, end, hit) by start and kind.

    ``sample_docs``: about how many documents, those whose ids hash lowest,
    give ordinary words to the model; ``model``: one that is fitted already.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    sampled = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(min(1.0, sample_docs / max(total, 1)) * (1 << 20))
    bare = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), f"{HEX}|{ACCESS}", " ")
    words = F.when(sampled, F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9]{3,}"), F.lit(0)))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        *(_found(text, pattern, kind).alias(KINDS[kind]) for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, TOKEN))),
        words.alias("words"),
    )
    read = common.stored(read, "secret-scan")
    each = None
    for kind in KINDS:
        part = read.where(F.col(kind).isNotNull()).select("row", F.posexplode(kind).alias("pos", "x")).select("row", "pos", "x.gap", "x.hit", "x.kind")
        each = part if each is None else each.unionByName(part)
    long = F.coalesce(F.length("hit"), F.lit(0)).cast("long")
    end = F.sum(F.col("gap") + long).over(Window.partitionBy("row", "kind").orderBy("pos"))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - long).where("hit is not null")
    value = F.regexp_extract("hit", ASSIGN, 2)
    placed = placed.where((F.col("kind") != 0) | (F.length(value) >= ASSIGN_LENGTH))
    if model is None:
        valued = placed.select(F.when(F.col("kind") == 0, value).when(F.col("kind") == 1, F.col("hit")).alias("word")).where(F.length("word") >= 16)
        long = F.filter("words", lambda w: F.length(w) >= LENGTHS[0])
        plain = read.where(F.size("words") >= 3).select(F.explode(F.concat(identifiers(F.col("words")), long)).alias("word"))
        model = fit(plain, valued, max_false=max_false)
    if model is None:
        placed = placed.where("kind < 3")
    else:
        score = F.when(F.col("kind") == 3, mean_ratio(F.col("hit"), model.costs, model.evenness))
        least = F.get(F.array(*map(F.lit, model.thresholds)), range_of(F.col("hit")))
        placed = placed.where((F.col("kind") < 3) | (score >= least))
    spans = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hit"))).alias("found"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    alone = lambda x: (x["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    spans = spans.withColumn("base", base).select("row", F.filter("found", alone).alias("spans"))
    return read.select("doc_id", "row").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hit:string>>")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans."""
    base = F.filter("spans", lambda x: x["kind"] < 3)
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
