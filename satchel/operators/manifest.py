"""Manifests: the entries of a tree as a table, its order, its parents and its byte layout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.formats import HEADER, SEPARATOR, directory_blocks, entry_length
from satchel.plans.ordering import number_rows, running_sum
from satchel.plans.staging import stage

UNSAFE = r"(^|/)(\.\.?|)(/|$)|\\|\x00|^[A-Za-z]:"


def clean_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Trim blanks, quotes and closing slashes, and drop exact repeats."""
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(F.trim(path), r"^[\"']+|[\"']+$", "")), r"/+$", "")
    return df.withColumn(path, cleaned).where(F.col(path) != "").dropDuplicates([path])


def is_archive(path: Column) -> Column:
    return F.lower(path).like("%.sy")


def logical_root(path: Column) -> Column:
    """The name of an archive without folders and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.sy$", "")


def tree(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Entries (path, parent, name, depth, kind, size, child_count) of relative ``/`` paths.

    ``files`` has path and size; ``folders`` has further directories that may be empty.  Parents
    are added.  A path that is a file and a folder is an error when it is read: two entries of
    one parent must not share a name.  Paths that leave the tree are rejected.
    """
    safe = lambda df: df.withColumn("path", F.when(F.col("path").rlike(UNSAFE), F.raise_error(F.concat(F.lit("unsafe path "), "path"))).otherwise(F.col("path")))
    files = safe(files.select("path", F.col("size").cast("long").alias("size")))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    above = lambda df: df.where(F.size(parts) > 1).select(F.explode(prefixes).alias("path"))
    dirs = above(files)
    if folders is not None:
        folders = safe(folders.select("path"))
        dirs = dirs.unionByName(above(folders)).unionByName(folders)
    found = files.withColumn("kind", F.lit("file")).unionByName(dirs.distinct().select("path", F.lit(0).cast("long").alias("size"), F.lit("dir").alias("kind")))
    found = found.select("path", F.when(F.size(parts) > 1, F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1))).otherwise("").alias("parent"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"), "kind", "size")
    counts = found.groupBy("parent").agg(F.count("*").alias("child_count"))
    joined = found.join(counts.withColumnRenamed("parent", "path"), "path", "left")
    once = Window.partitionBy("path")
    same = F.count("*").over(once)
    n = F.when(F.col("kind") == "dir", F.coalesce("child_count", F.lit(0))).otherwise(0)
    checked = F.when(same > 1, F.raise_error(F.concat(F.lit("two entries at "), "path"))).otherwise(n)
    return joined.withColumn("child_count", checked.cast("long")).select("path", "parent", "name", "depth", "kind", "size", "child_count")


def ordered(entries: DataFrame, root: str = "") -> DataFrame:
    """Entries numbered level by level (entry_ord), after the logical root ``root`` at 0.

    Siblings are in the byte order of their names; that is the order of depth and path parts.
    """
    top = entries.where("depth = 1").agg(F.count("*").alias("child_count"))
    first = top.select(F.lit(0).cast("long").alias("entry_ord"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(root).alias("name"), F.lit(0).alias("depth"), F.lit("root").alias("kind"), F.lit(0).cast("long").alias("size"), "child_count")
    numbered = number_rows(entries, F.col("depth"), F.split("path", "/"), name="entry_ord", start=1)
    return first.unionByName(numbered)


def layout(entries: DataFrame) -> DataFrame:
    """Ordered entries with entry_bytes and entry_offset, the bytes of the entries before."""
    size = F.octet_length("name") + F.when(F.col("kind") == "file", 21).otherwise(9)
    sized = entries.withColumn("entry_bytes", size.cast("long"))
    return running_sum(sized, "entry_ord", F.col("entry_bytes"), "entry_offset")


def blocks_of_directory(entries: DataFrame) -> DataFrame:
    """(entry_ord, dir_block) of ordered entries.

    A block ends where the entries since its start reach 16 KiB, which depends on where it
    started, so this is one pass in order; it carries a name's length per entry, never content.
    """
    small = entries.select("entry_ord", "kind", F.octet_length("name").alias("n"), F.when(F.col("kind") == "root", F.col("child_count")).alias("roots"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, filled, roots = 0, 0, 0
        for rows in batches:
            sizes = [entry_length(k, n) for k, n in zip(rows.kind, rows.n, strict=True)]
            if len(rows) and rows.entry_ord.iloc[0] == 0:
                roots = int(rows.roots.iloc[0])
            first = max(0, roots + 1 - int(rows.entry_ord.iloc[0])) if len(rows) else 0
            got = directory_blocks([filled, *sizes], first + 1)
            out = [block + g for g in got[1:]]
            # Carry on with what the last block has so far, a full one being closed.
            if out:
                last = got[-1]
                filled = sum(s for s, g in zip([filled, *sizes], got, strict=True) if g == last)
                block += last
                if filled >= 16 << 10 and int(rows.entry_ord.iloc[-1]) > roots:
                    block, filled = block + 1, 0
            yield pd.DataFrame({"entry_ord": rows.entry_ord, "dir_block": out})

    return small.coalesce(1).sortWithinPartitions("entry_ord").mapInPandas(fold, "entry_ord long, dir_block long")


def parents(entries: DataFrame) -> DataFrame:
    """(entry_ord, parent_ord) from order and child counts alone.

    The k-th directory owns the entries that follow those of all directories before it: a range
    join, done as an equality on the numbers that each directory owns.
    """
    dirs = number_rows(entries.where("kind != 'file'").select("entry_ord", "child_count"), F.col("entry_ord"), name="k")
    owned = running_sum(dirs, "k", F.col("child_count"), "first").where("child_count > 0")
    spans = owned.select(F.col("entry_ord").alias("parent_ord"), F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("child_count"))).alias("entry_ord"))
    return entries.select("entry_ord").join(spans, "entry_ord", "left")


def full_paths(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """(entry_ord, path) by joining names upwards, twice as far each round."""
    now = entries.select("entry_ord", "name").join(owners, "entry_ord").select("entry_ord", F.col("parent_ord").alias("up"), F.col("name").alias("path"))
    now = stage(now, "paths")
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("entry_ord").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        now = stage(now.join(above, "up", "left").select("entry_ord", F.col("next").alias("up"), F.concat_ws("/", "head", "path").alias("path")), "paths")
    return now.select("entry_ord", "path")


def data_offset(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(directory_offset): where the data starts."""
    size = entries.agg(F.sum(F.octet_length("name") + F.when(F.col("kind") == "file", 21).otherwise(9)).alias("b"))
    last = blocks.agg((F.max("dir_block") + 1).alias("n"))
    return size.crossJoin(last).select((F.lit(HEADER.size + 4) + F.col("n") * SEPARATOR.size + F.col("b")).cast("long").alias("directory_offset"))
