"""Operator 6: line deduplication by suffix arrays of line ids (DataFrame functions only).

A document is a sequence of line ids.  Lines that occur once can't be part of
a repeated run, so only the stretches between them are kept.  Their suffixes
are ranked by prefix doubling: the rank of a suffix to depth 2h is the rank of
the pair (rank to depth h, rank to depth h of the suffix h lines later).  Only
different pairs are sorted, each with its count, so a line that a third of all
rows have is one row of the sort; a pair that occurs once gets no rank.

A run is worth deleting from ``min_words`` words on.  So from each line the
shortest stretch of that many words, forwards and backwards, is looked up: two
overlapping ranks of the greatest depth that fits name the interval of
suffixes whose common prefix reaches that far.  In each interval the first
occurrence stays and the lines of all later ones are deleted.  Maximal repeated
runs are the unions of these stretches.  A stretch has at most ``min_words``
lines, which bounds the rounds of doubling by the logarithm of that.

Order is by id (nulls last), then by place in the document.  Words are runs of characters
other than ASCII white space.

Defined cases: null and empty texts have no lines and stay as they are; blank
lines are never deleted and don't interrupt a run; rows with the same id and
text are one document, and each of them gets its result; a null id is kept; an
empty table gives no rows; columns other than the text stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, mixing

_KEYS = ["_k1", "_k2"]
#: A passage's copies are dealt to at most so many places.
SALTS = 64
_BLANK = r"'\t\n\u000b\f\r '"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds 128 bits that name a row by its id and text."""
    parts = [F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col)]
    return docs.withColumns({"_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit(1), *parts)})


def _ranked(groups: DataFrame, names: list[str], rank: str) -> DataFrame:
    """Ranks of different rows in the order of ``names``: increasing, with gaps."""
    ordered = groups.repartitionByRange(*names).sortWithinPartitions(*names)
    return common.checkpoint(ordered.withColumn(rank, F.monotonically_increasing_id()))


def repeated_lines(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k1, _k2 (the document) and deleted, the places (from 0) of its lines in later copies of repeated runs."""
    line = F.col("_line")
    words = mixing.word_count(F.col("_line"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    lines = _keyed(rows, "_id", "_text").select(*_KEYS, "_id", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_trim", F.expr(f"btrim(_line, {_BLANK})")).where("_trim <> ''")
    lines = lines.select(*_KEYS, "_id", "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2"), words.alias("_words"))
    lines = lines.repartition(*_KEYS).dropDuplicates([*_KEYS, "_pos"])
    in_doc = Window.partitionBy(*_KEYS)
    lines = common.stored(lines.withColumn("_seq", F.row_number().over(in_doc.orderBy("_pos"))), "lines")

    # depth 1: lines that occur more than once
    groups = lines.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = lines.join(_ranked(groups, ["_h1", "_h2"], "_r0"), ["_h1", "_h2"]).drop("_h1", "_h2")
    rows = rows.withColumn("_island", F.col("_seq") - F.row_number().over(in_doc.orderBy("_seq")))
    in_island = Window.partitionBy(*_KEYS, "_island")
    rows = rows.withColumn("_upto", F.sum("_words").over(in_island.orderBy("_seq"))).withColumn("_before", F.col("_upto") - F.col("_words"))
    ahead = in_island.orderBy("_before").rangeBetween(0, min_words - 1)
    behind = in_island.orderBy("_upto").rangeBetween(1 - min_words, 0)
    for name, frame in (("f", ahead), ("b", behind)):
        enough = F.sum("_words").over(frame) >= min_words
        rows = rows.withColumn(f"_{name}", F.when(enough, F.count("*").over(frame)).otherwise(0).cast("int"))
    rows = common.checkpoint(rows.drop("_upto", "_before", "_words"))
    longest = rows.agg(F.max(F.greatest("_f", "_b")).alias("n")).first()["n"] or 0

    # doubling: depth 2 ** (k + 1) from depth 2 ** k
    depth = 0
    while 2 << depth <= longest:
        have, want = f"_r{depth}", f"_r{depth + 1}"
        paired = rows.withColumn("_next", F.lead(have, 1 << depth).over(in_island.orderBy("_seq")))
        groups = paired.where(F.col(have).isNotNull() & F.col("_next").isNotNull()).groupBy(have, "_next").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        ranks = _ranked(groups, [have, "_next"], want).select(F.col(have).alias("_a"), F.col("_next").alias("_b2"), want)
        rows = common.checkpoint(paired.join(ranks, (F.col(have) == F.col("_a")) & (F.col("_next") == F.col("_b2")), "left").drop("_next", "_a", "_b2"))
        depth += 1

    # intervals of common prefixes
    ranks = F.array(*(F.col(f"_r{k}") for k in range(depth + 1))).alias("ranks")
    item = F.struct("_seq", F.col("_pos").alias("pos"), F.col("_f").alias("f"), F.col("_b").alias("b"), ranks)
    islands = rows.groupBy(*_KEYS, "_island").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("_id").alias("_id"))

    def stretch(start: Column, n: Column) -> Column:
        k = F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
        rank = lambda at: F.get(F.get(F.col("items"), at)["ranks"], k)
        return F.when(n > 0, F.struct(F.get(F.col("items"), start)["_seq"].alias("start"), n.alias("n"), rank(start).alias("a"), rank(start + n - F.pow(F.lit(2), k).cast("int")).alias("b"), F.transform(F.slice(F.col("items"), start + 1, n), lambda x: x["pos"]).alias("places")))

    every = F.concat(F.transform("items", lambda x, i: stretch(i, x["f"])), F.transform("items", lambda x, i: stretch(i - x["b"] + 1, x["b"])))
    found = islands.select(*_KEYS, "_id", F.explode(F.array_distinct(F.filter(every, lambda x: x["a"].isNotNull() & x["b"].isNotNull()))).alias("x")).select(*_KEYS, "_id", "x.*")
    found = found.withColumn("place", F.struct(F.col("_id").isNull().alias("none"), "_id", *_KEYS, "start"))
    # a passage that very many documents have is spread over salts: least of each, then of all, and back
    found = common.stored(found.withColumn("salt", F.pmod(F.col("_k1"), F.lit(SALTS))), "stretches")
    each = found.groupBy("n", "a", "b", "salt").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    every = each.groupBy("n", "a", "b").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.collect_list("salt").alias("salts")).where("copies > 1")
    first = every.select("n", "a", "b", F.explode("salts").alias("salt"), "first")
    later = found.join(first, ["n", "a", "b", "salt"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return later.select(*_KEYS, F.explode("places").alias("pos")).groupBy(*_KEYS).agg(F.array_sort(F.collect_set("pos")).alias("deleted"))


def dedup_lines(docs: DataFrame, *, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents and columns, with the later copies of repeated runs cut from the text, and the places of the lines cut.

    The last column has those places; it is _deleted, or that with more underscores where a column has the name.
    """
    deleted = repeated_lines(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    rows = _keyed(docs.select(common.packed(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    joined = rows.join(deleted, _KEYS, "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(cut)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("deleted").alias(common.unused("_deleted", docs.columns)))


#: What dedup_lines cuts, for the column names of ``documents`` and min_words 50; ids are taken to be different.
SQL = """
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM raw WHERE trim(line, E'\\t\\n\\x0b\\f\\r ') <> ''
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM filled
), stretches AS (
  SELECT a.doc_id, min(b.seq) AS first_seq, max(b.seq) AS last_seq, sum(b.words) AS words, string_agg(b.line, chr(10) ORDER BY b.seq) AS run
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.upto - b.words BETWEEN a.upto - a.words AND a.upto - a.words + 49
  GROUP BY a.doc_id, a.seq
  UNION
  SELECT a.doc_id, min(b.seq), max(b.seq), sum(b.words), string_agg(b.line, chr(10) ORDER BY b.seq)
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.upto BETWEEN a.upto - 49 AND a.upto
  GROUP BY a.doc_id, a.seq
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first_seq) AS copy FROM stretches WHERE words >= 50
), gone AS (
  SELECT DISTINCT p.doc_id, p.pos FROM ordered o JOIN placed p ON p.doc_id = o.doc_id AND p.seq BETWEEN o.first_seq AND o.last_seq WHERE o.copy > 1
), cut AS (
  SELECT r.doc_id, count(g.pos) AS n_deleted, string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos) AS deleted,
         string_agg(CASE WHEN g.pos IS NULL THEN r.line END, chr(10) ORDER BY r.pos) AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(c.deleted, '') AS deleted, sha256(coalesce(CASE WHEN c.n_deleted > 0 THEN c.text ELSE d.text END, '')) AS text_sha256
FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""
