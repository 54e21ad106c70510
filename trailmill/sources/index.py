"""An index that follows its files: what was added, changed or deleted since it was built, and nothing else, is read again.

Every row of the index carries the path, size and time of the file it comes from. A refresh lists the files, by Spark, joins
the list with the index, builds rows of files that are new or other than they were, and commits those together with copies
of the folders that held rows of changed or deleted files, in one entry: readers see the index before or after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import _COMMIT, Table

FILE = ("file_path", "file_size", "file_time")
#: Changed files that are named to the reader; of more, the reader is given the whole root and rows are joined.
NAMED = 10_000


def files_of(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, file_path, file_size, file_time) of all files below the root whose name fits; their content isn't read.
    path is what a reader takes, file_path what rows are known by."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    about = F.col("_metadata")
    return raw.select("path", about["file_path"].alias("file_path"), about["file_size"].alias("file_size"), F.unix_millis(about["file_modification_time"]).alias("file_time"))


def refreshed(spark: SparkSession, path: str, root: str, pattern: str, build: Callable[[DataFrame], DataFrame], read: Callable[[list[str]], DataFrame] | None = None, attempts: int = 5) -> DataFrame:
    """The index at `path`, brought up to date. read: rows of some files (Parquet, unless given), or of all of [root];
    build: what the index keeps of such rows, which have `file_path`. Where the index lacks columns that `build` gives now,
    the files of rows without them count as changed. Two refreshes at once leave one result; the later one looks again."""
    read = read or (lambda paths: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(*paths))
    table = Table(spark, path)
    built = lambda paths: build(read(paths).withColumn("file_path", F.col("_metadata.file_path")))
    for _ in range(attempts):
        entries = table.log.entries()
        folders = table.folders(entries)
        now = files_of(spark, root, pattern).persist()
        try:
            columns = {f: set(e.get("columns", [])) for e in entries for f in e.get("add", [])}
            wanted = set(built([root]).columns) if folders and not now.isEmpty() else set()
            short = [f for f in folders if not wanted <= columns[f]]
            held = table._reader(folders)
            if held is None:
                changed, stale = now, []
            else:
                known = held.select(_COMMIT, *FILE).distinct()
                good = known.where(~F.col(_COMMIT).isin(short)) if short else known
                changed = now.join(good, list(FILE), "left_anti")
                stale = [r[0] for r in known.join(now, list(FILE), "left_anti").select(_COMMIT).distinct().collect()]
                stale = sorted({*stale, *short})
            n = changed.count()
            if not n and not stale:
                return _without_commits(held)
            added = []
            if n:
                paths = [r[0] for r in changed.select("path").collect()] if n <= NAMED and folders else [root]
                rows = built(paths).join(changed.drop("path"), "file_path")
                added = [table.write(rows)]
                fresh = rows.columns
            kept = []
            if stale:
                # Copies: rows of files that are as they were, and have what the index holds now.
                rest = held.where(F.col(_COMMIT).isin([f for f in stale if f not in short])).drop(_COMMIT).join(now.select(*FILE), list(FILE), "left_semi")
                kept = [table.write(rest)]
            entry = {"add": [f for f in (*added, *kept) if f], "drop": stale, "columns": list(fresh if n else held.columns)}
            if table.log.append(entry, entries):
                found = table._reader(table.folders([*entries, entry]))
                return _without_commits(found) if found is not None else spark.createDataFrame([], built([root]).schema)
            for f in entry["add"]:
                table.discard(f)
        finally:
            now.unpersist()
    raise OSError(f"others keep changing the index at {path}")


def _without_commits(rows: DataFrame) -> DataFrame:
    return rows.drop(_COMMIT)
