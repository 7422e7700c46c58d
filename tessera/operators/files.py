"""Set operators on file tables: classification, content dedup, display names and changes against a folder."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename


def path_order(path: str = "path"):
    """Folders' order of files: by path components."""
    return F.split(F.col(path), "/")


def content_dedup(listing: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """listing (path, sha1, ...): the first file, in path order, of each content that is not known (sha1) yet."""
    fresh = listing if known is None else listing.join(known.select("sha1").distinct(), "sha1", "left_anti")
    first = fresh.groupBy("sha1").agg(F.min_by("path", path_order()).alias("path"))
    return fresh.join(first, ["sha1", "path"], "left_semi")


def classify(listing: DataFrame, files: DataFrame) -> DataFrame:
    """listing (path, sha1) against files (path, sha1): action unchanged, update, duplicate or new, as if files were taken in path order.

    A new file is a duplicate if its content is owned when its turn comes: by a tracked file, unless its update came before, or by
    a file of the listing that was taken before. Updates are taken whoever owns their content. If the listing has a column state,
    files that aren't 'ok' own nothing and get their state as action: 'failed' leaves the tracked file as it was, 'empty' takes its content away.
    """
    ok = F.col("state") == "ok" if "state" in listing.columns else F.lit(True)
    empty = F.col("state") == "empty" if "state" in listing.columns else F.lit(False)
    place = path_order()
    met = listing.join(files.select("path", F.col("sha1").alias("__old")), "path", "left").withColumn("__place", place)
    changed = F.col("__old").isNotNull() & (F.col("__old") != F.col("sha1")) & (ok | empty)
    # when tracked contents are let go: never, or at the place of the last update of a file that has them
    leaves = met.where(changed).select("path", F.lit(True).alias("leaves"))
    owners = files.select("path", "sha1", place.alias("place")).join(leaves, "path", "left").groupBy("sha1").agg(F.max(F.col("leaves").isNull()).alias("__stays"), F.max(F.when(F.col("leaves"), F.col("place"))).alias("__last"))
    held = F.coalesce(F.col("__stays") | (F.col("__last") > F.col("__place")), F.lit(False))
    met = met.join(owners, "sha1", "left").withColumn("__held", F.col("__old").isNull() & held)
    takes = ok & (changed | (F.col("__old").isNull() & ~F.col("__held")))
    first = met.where(takes).groupBy("sha1").agg(F.min("__place").alias("__first"))
    met = met.join(first, "sha1", "left")
    action = F.when(F.col("__old") == F.col("sha1"), "unchanged")
    if "state" in listing.columns:
        action = action.when(F.col("__old").isNull() & (F.col("__held") | (F.col("__first") < F.col("__place"))), "duplicate").when(~ok, F.col("state"))
    action = action.when(F.col("__old").isNotNull(), "update").when(F.col("__held") | (F.col("__place") > F.col("__first")), "duplicate").otherwise("new")
    return met.select(*listing.columns, action.alias("action"))


def changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """path and change (deleted, added, changed, unchanged) of a folder's listing against the files tracked."""
    gone = files.join(listing, "path", "left_anti").select("path", F.lit("deleted").alias("change"))
    old = files.select("path", F.col("sha1").alias("old_sha1"))
    kept = listing.join(old, "path", "left").select("path", F.when(F.col("old_sha1").isNull(), "added").when(F.col("old_sha1") == F.col("sha1"), "unchanged").otherwise("changed").alias("change"))
    return gone.unionByName(kept)


def under_sources(files: DataFrame, sources: list[str]) -> DataFrame:
    """Files that lie in one of the folders."""
    prefixes = F.array(*[F.lit(s.rstrip("/") + "/") for s in sources])
    return files.where(F.exists(prefixes, lambda p: F.startswith(F.col("path"), p)))


def union(listings: list[DataFrame]) -> DataFrame:
    """Listings of folders that may lie in each other: each path once."""
    return reduce(DataFrame.unionByName, listings).dropDuplicates(["path"])


def file_counts(files: DataFrame, *by: str) -> DataFrame:
    """doc_count and chunk_count of files (path, chunk_count), in all or by some columns."""
    return files.groupBy(*by).agg(F.countDistinct("path").alias("doc_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunk_count"))


def lookups(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Of each file (path, sha1): whether its path and its content are known, and whether another file of the listing has its name."""
    name = basename(F.col("path"))
    taken = listing.groupBy(name.alias("name")).agg(F.countDistinct("path").alias("n"))
    met = listing.select("path", "sha1", name.alias("name")).join(files.select("path", F.lit(True).alias("known")), "path", "left").join(files.select("sha1").distinct().withColumn("content", F.lit(True)), "sha1", "left").join(taken, "name")
    return met.select("path", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("content", F.lit(False)).alias("known_content"), (F.col("n") > 1).alias("name_taken"))


def free_name(name: str, taken: set[str], next_of: dict[str, int] | None = None) -> str:
    """name, or the first of stem_2.ext, stem_3.ext, ... that isn't taken. next_of: where to go on looking, as taken only grows."""
    if name not in taken:
        return name
    dot = name.rfind(".")
    front, end = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    n = 2 if next_of is None else next_of.get(name, 2)
    while f"{front}_{n}{end}" in taken:
        n += 1
    if next_of is not None:
        next_of[name] = n + 1
    return f"{front}_{n}{end}"


_NUMBERS = r"(?s)\A(.+?)(?:_[0-9]+)*(\.[^.]+)?\z"


def display_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """path, display_name of files (path) in path order: each gets its name, or the first of stem_2.ext, stem_3.ext, ... that is not taken
    by then; taken: display_name of files named before.

    Names can meet only within a family: what is left of a name without _2, _3, ... at its stem's end. So each family is named by
    itself; one whose files all have one name, none of them taken, by counting, and the others in turn, a family in a task.
    """
    name = basename(F.col("path"))
    family = F.struct(F.regexp_extract("name", _NUMBERS, 1).alias("a"), F.regexp_extract("name", _NUMBERS, 2).alias("b")).alias("family")
    rows = files.select("path", name.alias("name"), F.lit(True).alias("fresh"))
    if taken is not None:
        rows = rows.unionByName(taken.select(F.lit("").alias("path"), F.col("display_name").alias("name"), F.lit(False).alias("fresh")))
    rows = rows.select("*", family)
    kinds = rows.groupBy("family").agg((F.min("fresh") & (F.min("name") == F.max("name"))).alias("plain"), F.max("fresh").alias("asked"))
    rows = rows.join(kinds.where("asked"), "family")
    counted = first_level_names(rows.where("plain").select("path"))

    def in_turn(group: pd.DataFrame) -> pd.DataFrame:
        used, out, next_of = set(group["name"][~group["fresh"]]), [], {}
        fresh = group[group["fresh"]]
        paths = sorted(fresh["path"], key=lambda p: p.split("/"))
        for path in paths:
            out.append(free_name(re.split(r"[/\\]", path)[-1], used, next_of))
            used.add(out[-1])
        return pd.DataFrame({"path": paths, "display_name": out})

    return counted.unionByName(rows.where("not plain").groupBy("family").applyInPandas(in_turn, "path string, display_name string"))


def first_level_names(files: DataFrame) -> DataFrame:
    """path, display_name where no file is itself named like a made-up name: the n-th file of a name gets _n."""
    name = basename(F.col("path"))
    n = F.row_number().over(Window.partitionBy(name).orderBy(path_order()))
    made = F.concat(F.regexp_extract(name, r"(?s)\A(.+?)(\.[^.]+)?\z", 1), F.lit("_"), n.cast("string"), F.regexp_extract(name, r"(?s)\A(.+?)(\.[^.]+)?\z", 2))
    return files.select("path", F.when(n == 1, name).otherwise(made).alias("display_name"))


def counters(classified: DataFrame) -> DataFrame:
    """One row: indexed, skipped, updated, renamed and unchanged files."""
    return classified.agg(
        F.count_if(F.col("action").isin("new", "update")).alias("indexed"),
        F.count_if(F.col("action") == "duplicate").alias("skipped"),
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if(F.col("action").isin("new", "update") & (F.col("display_name") != basename(F.col("path")))).alias("renamed"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
    )
