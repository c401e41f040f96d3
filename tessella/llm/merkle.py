"""Operator 12: a Merkle manifest of a dataset.

Leaves are numbered in their order within a group, and every partition climbs
its own run of numbers with a stack: like a counter in base ``fanout``, a node
that completes a run of siblings carries them into their parent, so what is
left on the stack are the peaks of a mountain range.  A run may start and end
anywhere, so nodes at its edges wait for siblings that other partitions hold:
the peaks are dealt by aligned ranges of numbers and climbed again, over ever
larger ranges, until one peak is left of each group.  The last run of a level
may be short and is hashed as it is, without padding.

Nodes from the level ``floor`` on are records of the manifest.  A proof is read
from them block by block: the siblings below the floor are made anew from the
block's own leaves, those above are joined along the block's way to the root.

Defined cases: a null is ``-`` in a leaf, an empty text ``0:``; rows without a
group are a group of their own and the first; null ids come first in their
group and aren't tampered with; rows of one id follow their leaves' digests,
and equal rows are leaves of their own; other columns have no part; an empty
table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Levels of a block whose leaves one task holds at once, of a step of the way to the root, and of a range of peaks: powers of two.
BLOCK_BITS, RANGE_BITS = 12, 16
_NODE = "g string, peak boolean, level int, idx long, n long, digest string"
_PATH = "array<struct<level:int,idx:long,digest:string>>"


def digest(*parts: str) -> str:
    """H: lowercase hex sha256 of the concatenated inputs."""
    return sha256("".join(parts).encode()).hexdigest()


def _div(a: Column, b: Column | int) -> Column:
    """The quotient of whole numbers, without the detour of doubles."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _levels(bits: int, fanout: int) -> int:
    """Levels in which a node has about 2 ** bits leaves."""
    return max(1, int(bits / (fanout.bit_length() - 1)))


def _climb(fanout: int, floor: int):
    """Runs of nodes (g, run, level, idx, n, digest) in order, to the nodes they complete from the level floor on, and the peaks that wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, current, out = [], None, []

        def flush() -> None:
            out.extend((current[0], True, *node) for node in stack)
            stack.clear()

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "peak", "level", "idx", "n", "digest"])

        for batch in batches:
            for g, part, level, idx, n, own in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (g, part) != current:
                    if current is not None:
                        flush()
                    current = (g, part)
                while True:
                    width = -(-n // fanout**level)
                    place = idx % fanout
                    ready = width > 1 and (place == fanout - 1 or idx == width - 1) and len(stack) >= place and all(stack[-k][:2] == (level, idx - k) for k in range(1, place + 1))
                    if not ready:
                        stack.append((level, idx, n, own))
                        break
                    own = digest(*(node[3] for node in stack[len(stack) - place :]), own)
                    del stack[len(stack) - place :]
                    level, idx = level + 1, idx // fanout
                    if level >= floor:
                        out.append((g, False, level, idx, n, own))
            yield batch_of()
            out.clear()
        if current is not None:
            flush()
        yield batch_of()

    return run


class Tree:
    """Leaves (g, idx, n, digest and the caller's columns), node records from a level on, and the root of each group."""

    def __init__(self, leaves: DataFrame, order: list[str], *, fanout: int = 2, floor: int, name: str) -> None:
        self.fanout, self.floor = fanout, floor
        self.leaves = common.indexed(leaves, "g", order, name)
        first = self.leaves.select("g", F.col("part").alias("run"), F.lit(0).alias("level"), "idx", "n", "digest")
        found = common.stored(self._climbed(first), f"{name}-nodes")
        self.most = self.leaves.agg(F.max("n")).first()[0] or 0
        records, span, ended = [found.where("NOT peak")], 0, False
        while not ended:
            span += _levels(RANGE_BITS, fanout)
            ended = fanout**span >= self.most
            start = F.col("idx") * F.element_at(self._powers(), F.col("level") + 1)
            run = F.lit(0).cast("long") if ended else _div(start, fanout**span)
            peaks = found.where("peak").select("g", run.alias("run"), "level", "idx", "n", "digest")
            found = common.stored(self._climbed(peaks), f"{name}-nodes")
            records.append(found.where("NOT peak"))
        self.roots = found.where("peak").select("g", "n", "digest")
        nodes = records[0]
        for more in records[1:]:
            nodes = nodes.unionByName(more)
        if floor == 0:
            nodes = nodes.unionByName(self.leaves.select("g", F.lit(False).alias("peak"), F.lit(0).alias("level"), "idx", "n", "digest"))
        self.nodes = nodes.select("g", "level", "idx", "digest")

    def _powers(self) -> Column:
        """Leaves of a node by its level."""
        return F.array(*(F.lit(self.fanout**k).cast("long") for k in range(63) if self.fanout**k < 1 << 62))

    def _climbed(self, nodes: DataFrame) -> DataFrame:
        start = F.col("idx") * F.element_at(self._powers(), F.col("level") + 1)
        runs = nodes.repartition("g", "run").withColumn("start", start).sortWithinPartitions("g", "run", "start").select("g", "run", "level", "idx", "n", "digest")
        return runs.mapInArrow(_climb(self.fanout, self.floor), _NODE)

    def paths(self) -> DataFrame:
        """g, block and its way to the root: each level's run of siblings in order, the block's own node among them without its digest.

        A block is a node of the floor.  The way is joined in steps of levels,
        from the top down, so a node is asked for by the blocks of one step only.
        """
        step, k, powers = _levels(BLOCK_BITS, self.fanout), F.lit(self.fanout).cast("long"), self._powers()
        width = lambda level: _div(F.col("n") + F.element_at(powers, level + 1) - 1, F.element_at(powers, level + 1))
        starts = [s for s in range(self.floor, 63, step) if s == self.floor or self.fanout**s < self.most]
        above = None
        for at in reversed(starts):
            blocks = self.roots.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), width(F.lit(at)) - 1)).alias("block"))
            rows = blocks.select("*", F.explode(F.sequence(F.lit(at), F.lit(at + step - 1))).alias("level")).where(width(F.col("level")) > 1)
            rows = rows.withColumn("own", _div(F.col("block"), F.element_at(powers, F.col("level") - at + 1)))
            rows = rows.withColumn("idx", F.explode(F.sequence(F.col("own") - F.col("own") % k, F.least(F.col("own") - F.col("own") % k + k, width(F.col("level"))) - 1)))
            known = rows.join(self.nodes, ["g", "level", "idx"]).select("g", "block", F.struct("level", "idx", F.when(F.col("idx") != F.col("own"), F.col("digest")).alias("digest")).alias("node"))
            way = known.groupBy("g", "block").agg(F.array_sort(F.collect_list("node")).alias("path"))
            way = blocks.select("g", "block").join(way, ["g", "block"], "left").withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
            if above is not None:
                upper = above.select("g", F.col("block").alias("over"), F.col("path").alias("rest"))
                way = way.withColumn("over", _div(F.col("block"), self.fanout**step)).join(upper, ["g", "over"], "left").select("g", "block", F.concat("path", F.coalesce("rest", F.array().cast(_PATH))).alias("path"))
            above = way
        return above


def _turns(path: list[dict]) -> list[tuple[str, str]]:
    """(digests before, digests after) the own node at each level of a path."""
    out, at = [], None
    for node in path:
        if node["level"] != at:
            out.append(["", ""])
            at, after = node["level"], 0
        if node["digest"] is None:
            after = 1
        else:
            out[-1][after] += node["digest"]
    return [(a, b) for a, b in out]


def _prove(fanout: int, floor: int, schema: pa.Schema):
    """A block's leaves with its way to the root, to a row for each leaf."""

    def run(leaves: pa.Table, info: pa.Table) -> pa.Table:
        rows = sorted(leaves.select(["idx", "n", "digest", "tampered", "id"]).to_pylist(), key=lambda r: r["idx"])
        if not rows:
            return schema.empty_table()
        about, n, first = info.to_pylist()[0], rows[0]["n"], rows[0]["idx"]
        above = _turns(about["path"]) + _turns(about["top"])
        nodes, turns = [r["digest"] for r in rows], []
        for level in range(floor):
            if -(-n // fanout**level) == 1:
                break
            runs = [nodes[a : a + fanout] for a in range(0, len(nodes), fanout)]
            turns.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
            nodes = [digest(*run) for run in runs]
        tails = ["".join(a + b for a, b in above)] * len(nodes)
        for level in reversed(turns):
            tails = [a + b + tails[k // fanout] for k, (a, b) in enumerate(level)]
        out = []
        for r, tail in zip(rows, tails, strict=True):
            own, place = r["tampered"] or r["digest"], r["idx"] - first
            for level in turns:
                before, after = level[place]
                own, place = digest(before, own, after), place // fanout
            for before, after in above:
                own = digest(before, own, after)
            out.append((r["id"], r["digest"], about["subroot"], about["root"], digest(tail), own, own == about["root"]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def manifest(docs: DataFrame, columns: list[str], *, group: str = "lang", id_col: str = "doc_id", tampered: Column | None = None, fanout: int = 2) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves are H of ``columns``; groups ascend by their bytes, those rows
    without one first, and their roots are the leaves of the tree above them.
    ``tampered``: the leaf that a receiver has of a row, null where it is the
    sender's; folding it with the row's siblings gives folded_root.
    """
    if fanout < 2:
        raise ValueError("fanout >= 2")
    bad = F.lit(None).cast("string") if tampered is None else tampered
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf(*(F.col(f"`{c}`") for c in columns)).alias("digest"), bad.alias("tampered"))
    lower = Tree(rows, ["id", "digest"], fanout=fanout, floor=_levels(BLOCK_BITS, fanout), name="leaves")
    subroots = lower.roots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "digest")
    upper = Tree(subroots, ["lang"], fanout=fanout, floor=0, name="subroots")
    tops = upper.leaves.select(F.col("g").alias("all"), "lang", F.col("idx").alias("block"), F.col("digest").alias("subroot"))
    tops = tops.join(upper.paths().select("block", F.col("path").alias("top")), "block").join(upper.roots.select(F.col("g").alias("all"), F.col("digest").alias("root")), "all")
    about = lower.paths().join(common.stored(tops.select(F.col("lang").alias("g"), "subroot", "root", "top"), "tops"), "g")
    leaves = lower.leaves.select("g", _div(F.col("idx"), fanout**lower.floor).alias("block"), "idx", "n", "digest", "tampered", "id")
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    return leaves.groupBy("g", "block").cogroup(about.groupBy("g", "block")).applyInArrow(_prove(fanout, lower.floor, schema), out).withColumnRenamed("id", id_col)


_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _crc_sql(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT) for j in range(8)]), lambda c, j: xor(c // 2, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) for x in string_split({text}, '')]), lambda crc, byte: {step}), 4294967295)"


#: DuckDB SQL of ``manifest`` over documents with a fanout of 2, tampered where 7 divides crc32(doc_id).
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS bad
  FROM documents
), l AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d
), t AS (
  SELECT g, 0 AS level, idx, n, leaf AS h FROM l
  UNION ALL
  SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, level, idx // 2, n
), s AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 2, n
), turns AS (
  SELECT l.doc_id, l.leaf, l.g, l.idx AS pos, 0 AS tree, w.level, string_agg(t.h, '') FILTER (t.idx < l.idx // (1 << w.level)) AS before, string_agg(t.h, '') FILTER (t.idx > l.idx // (1 << w.level)) AS after
  FROM l JOIN (SELECT DISTINCT g, level FROM t WHERE n > 1) w ON w.g = l.g JOIN t ON t.g = l.g AND t.level = w.level AND t.idx // 2 = l.idx // (2 << w.level) GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.leaf, l.g, l.idx, 1, w.level, string_agg(u.h, '') FILTER (u.idx < s.idx // (1 << w.level)), string_agg(u.h, '') FILTER (u.idx > s.idx // (1 << w.level))
  FROM l JOIN s ON s.g = l.g JOIN (SELECT DISTINCT level FROM u WHERE n > 1) w ON true JOIN u ON u.level = w.level AND u.idx // 2 = s.idx // (2 << w.level) GROUP BY ALL
), ways AS (
  SELECT g, pos, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY tree, level) AS way, coalesce(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY tree, level), '') AS proof FROM turns GROUP BY g, pos
), f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(bad, leaf), coalesce(way, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM l JOIN s ON s.g = l.g LEFT JOIN ways ON ways.g = l.g AND ways.pos = l.idx
)
SELECT *, folded_root = root AS verified FROM f
"""
