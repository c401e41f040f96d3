"""Changes of several tables in one commit.

A store is a folder: data files in ``data/<table>/<id>``, and a manifest for
each version, ``versions/<number>.json``, that names the data folders of every
table.  A commit first writes its data, which no manifest names yet, and then
renames the next manifest to its place, in one step of the file system that
fails if one is there.  So readers see all tables of a commit or none, a writer that
dies leaves only files that nobody reads, and of two writers of one version the
second one fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WIDTH = 20


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a file under another name and rename it, which fails if there is one of its name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft, at = hadoop.Path(f"{folder}/_{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(at), spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as error:
        fs.delete(draft, False)
        raise FileExistsError(f"{name} is there already: read it and try again") from error


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 of a new store."""
    fs, at = _fs(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, list[str]]:
    """The data folders of every table in a version, by default the newest."""
    number = latest(spark, root) if version is None else version
    if number == 0:
        return {}
    text = spark.read.text(f"{root}/versions/{number:0{_WIDTH}d}.json", wholetext=True).first()[0]
    return json.loads(text)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version."""
    parts = manifest(spark, root, version).get(table)
    if not parts:
        raise ValueError(f"no table {table!r} in this version")
    return spark.read.parquet(*(f"{root}/{p}" for p in parts))


def commit(spark: SparkSession, root: str, *, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, remove: tuple[str, ...] = (), base: int | None = None) -> int:
    """Rows added to tables, tables written anew and tables dropped, all as the next version, whose number is returned.

    ``base``: the version that the change was made from, by default the newest; a later one in the meantime is a FileExistsError.
    """
    number = latest(spark, root) if base is None else base
    tables = {k: list(v) for k, v in manifest(spark, root, number).items() if k not in remove}
    for name, df, old in [(k, v, tables.get(k, [])) for k, v in (append or {}).items()] + [(k, v, []) for k, v in (replace or {}).items()]:
        part = f"data/{name}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{root}/{part}")
        tables[name] = [*old, part]
    _publish(spark, f"{root}/versions", f"{number + 1:0{_WIDTH}d}.json", json.dumps(tables))
    return number + 1


def change(spark: SparkSession, root: str, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
    """Replace tables by what ``make`` returns from those of the newest version, anew if another writer comes first."""
    for k in range(tries):
        number = latest(spark, root)
        held = {name: read(spark, root, name, number) for name in manifest(spark, root, number)}
        try:
            return commit(spark, root, replace=make(held), base=number)
        except FileExistsError:
            if k + 1 == tries:
                raise
    raise ValueError("tries >= 1")
