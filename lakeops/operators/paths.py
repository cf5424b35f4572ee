"""Lake listings as tables: path parts, table discovery, directory views, trees.

A *listing* has the ``paths`` schema of FIXTURES.md: ``name`` is the full lake path
``<item>/<Files|Tables>/...``; ``isDirectory``, ``isShortcut`` and ``accountType`` are
optional flags.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.text import last_segment, path_after_first, segments
from lakeops.session import materialize

DELTA_LOG = "_delta_log"
# Fixed values (must equal the reference): shortcut account types that count as tables.
TABLE_SHORTCUT_ACCOUNT_TYPES = ("ADLS", "ExternalADLS")


def _flag(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("boolean")


def path_parts(listing: DataFrame, root_folder: str | Column = "Files",
               name_col: str = "name") -> DataFrame:
    """File rows: ``rootFolder, name, relativePath, isDirectory, isShortcut``.

    ``name`` is the last ``/`` segment (empty when the path ends in ``/``); ``relativePath``
    is everything after the first segment (the item).
    """
    rf = root_folder if isinstance(root_folder, Column) else F.lit(root_folder)
    return listing.select(
        rf.alias("rootFolder"),
        last_segment(name_col).alias("name"),
        path_after_first(name_col).alias("relativePath"),
        _flag(listing, "isDirectory").alias("isDirectory"),
        _flag(listing, "isShortcut").alias("isShortcut"))


def discover_tables(listing: DataFrame, name_col: str = "name") -> DataFrame:
    """Tables in a recursive ``Tables/`` listing: ``rootFolder, name, relativePath, schema``.

    A table is a path ending in ``/_delta_log`` (the log folder is dropped) or a shortcut
    whose account type is ``ADLS`` or ``ExternalADLS``. ``schema`` is the third segment,
    set only when the table path has exactly four segments; ``relativePath`` drops the
    item segment and ends in ``/``.
    """
    name = F.col(name_col)
    # Null-safe without coalesce, so the whole test pushes down to a Parquet listing scan.
    is_log = name.isNotNull() & F.endswith(name, F.lit("/" + DELTA_LOG))
    acct = F.col("accountType") if "accountType" in listing.columns else F.lit(None).cast("string")
    sc_flag = _flag(listing, "isShortcut")
    is_sc = sc_flag.isNotNull() & sc_flag & acct.isNotNull() & acct.isin(*TABLE_SHORTCUT_ACCOUNT_TYPES)
    parts = segments(name)
    table_parts = F.when(is_log, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    t = listing.where(is_log | is_sc).select(table_parts.alias("tp"), parts.alias("p"))
    return t.select(
        F.lit("Tables").alias("rootFolder"),
        F.element_at("tp", -1).alias("name"),
        F.concat(path_after_first(F.array_join("tp", "/")), F.lit("/")).alias("relativePath"),
        F.when(F.size("tp") == 4, F.element_at("tp", 3)).alias("schema"))


def _root_folder_of(directory: str) -> str:
    if directory.startswith("Files/"):
        return "Files"
    if directory.startswith("Tables/"):
        return "Tables"
    return directory.split("/")[0]


def parent_path(c: str | Column) -> Column:
    """Everything before the last ``/`` (null when there is none)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.contains(col, F.lit("/")), F.regexp_extract(col, r"^(.*)/[^/]*$", 1))


def list_directory(listing: DataFrame, item: str, directory: str,
                   name_col: str = "name") -> DataFrame:
    """Entries exactly one level below ``<item>/<directory>``, as file rows.

    ``rootFolder`` is ``Files`` or ``Tables`` by the directory's prefix, else its first
    segment.
    """
    d = f"{item}/{directory.rstrip('/')}"
    level = listing.where(parent_path(name_col) == F.lit(d))
    return path_parts(level, _root_folder_of(directory), name_col)


def expand_shortcut(listing: DataFrame, shortcuts: DataFrame, name_col: str = "name",
                    shortcut_path_col: str = "shortcutPath", target_col: str = "targetRoot"
                    ) -> DataFrame:
    """Re-root the listing below each shortcut's target under the shortcut's own path.

    ``shortcuts``: ``shortcutPath`` (where the shortcut sits, e.g. ``Files/ext``) and
    ``targetRoot`` (the listed folder it points at). Every listing row strictly below a
    target root comes out as ``shortcutPath, name, relativePath, isDirectory,
    isShortcut`` with ``relativePath = shortcutPath + '/' + path below the target``.
    Matching is an equi-join on the row's ancestor folders, so no pairs are tested.
    """
    segs = segments("_full")
    # one row per proper ancestor folder: explode the depth, then slice (no lambda)
    rows = (listing.select(F.col(name_col).alias("_full"),
                           _flag(listing, "isDirectory").alias("isDirectory"),
                           _flag(listing, "isShortcut").alias("isShortcut"))
            .where(F.size(segments("_full")) > 1)
            .select("_full", "isDirectory", "isShortcut",
                    F.explode(F.sequence(F.lit(1), F.size(segs) - 1)).alias("_i"))
            .select("_full", "isDirectory", "isShortcut",
                    F.array_join(F.slice(segments("_full"), F.lit(1), F.col("_i")), "/").alias("_root")))
    sc = shortcuts.select(F.col(shortcut_path_col).alias("shortcutPath"),
                          F.col(target_col).alias("_root"))
    j = rows.join(sc, "_root")
    below = F.expr("substring(_full, length(_root) + 2)")
    return j.select(
        "shortcutPath",
        last_segment("_full").alias("name"),
        F.concat_ws("/", F.col("shortcutPath"), below).alias("relativePath"),
        "isDirectory", "isShortcut")


def build_tree(files: DataFrame, path_col: str = "relativePath", ordered: bool = True) -> DataFrame:
    """Parent/child edges of a file listing, siblings ordered folders first, then by name.

    Returns ``relativePath, name, isDirectory, parentPath, depth``. ``parentPath`` is the
    path without its last segment when a *directory* with that path is listed, else null
    (a root). Empty segments are ignored when splitting, as in the reference. Unlike the
    reference, a child finds its parent regardless of listing order. The result is
    globally sorted by (parentPath, folders first, name): a range-partitioned sort, so one
    folder holding a large share of all entries is still split over many tasks. With
    ``ordered=False`` the edges come unsorted and the sort's shuffle is skipped.
    """
    # split('/') without empty segments, written without a lambda so it compiles:
    # collapse repeated slashes, trim the ends, then split.
    clean = F.regexp_replace(F.regexp_replace(F.col(path_col), "/+", "/"), "^/|/$", "")
    segs = F.when(clean == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(clean, "/", -1))
    nodes = files.select(F.col(path_col).alias("relativePath"), F.col("name"),
                         F.coalesce(F.col("isDirectory"), F.lit(False)).alias("isDirectory"),
                         F.when(F.size(segs) > 1, F.array_join(
                             F.slice(segs, F.lit(1), F.size(segs) - 1), "/")).alias("_parent"),
                         F.size(segs).alias("depth"))
    dirs = (nodes.where("isDirectory").select(F.col("relativePath").alias("_parent"))
            .distinct().withColumn("_is_dir_parent", F.lit(True)))
    edges = nodes.join(dirs, "_parent", "left").select(
        "relativePath", "name", "isDirectory",
        F.when(F.col("_is_dir_parent"), F.col("_parent")).alias("parentPath"), "depth")
    if not ordered:
        return edges
    return edges.orderBy(F.asc_nulls_first("parentPath"), F.desc("isDirectory"), F.asc("name"))


def tables_by_schema(tables: DataFrame) -> DataFrame:
    """Tables grouped under their schema, as rows: ``schema, name, relativePath, n_tables``.

    A missing schema stays SQL null. Per-schema counts are a partial aggregate joined
    back, so a schema holding most tables never becomes one task's array. The discovered
    tables feed both branches and are stored, so the listing is scanned once.
    """
    tables = materialize(tables.select("schema", "name", "relativePath"))
    counts = tables.groupBy(F.col("schema").alias("_s")).agg(F.count("*").alias("n_tables"))
    return (tables.select("schema", "name", "relativePath")
            .join(counts, F.col("schema").eqNullSafe(F.col("_s")), "left")
            .select("schema", "name", "relativePath", "n_tables"))


class ItemView(NamedTuple):
    tables: DataFrame   # discover_tables rows
    by_schema: DataFrame  # tables_by_schema rows
    files: DataFrame    # path_parts rows of Files/
    tree: DataFrame     # build_tree edges of Files/


def browse_item(listing: DataFrame, item: str, name_col: str = "name") -> ItemView:
    """One item's lake view from a recursive listing, as lazy plans over one listing scan.

    Tables come from ``<item>/Tables/`` (``discover_tables``, then ``tables_by_schema``);
    files from ``<item>/Files/`` (``path_parts``, then ``build_tree``). The prefix filters
    are plain ``startswith`` tests, pushed down when the listing is stored as Parquet.
    """
    name = F.col(name_col)
    tables_part = listing.where(name.isNotNull() & F.startswith(name, F.lit(f"{item}/Tables/")))
    files_part = listing.where(name.isNotNull() & F.startswith(name, F.lit(f"{item}/Files/")))
    tables = discover_tables(tables_part, name_col)
    files = path_parts(files_part, "Files", name_col)
    return ItemView(tables, tables_by_schema(tables), files, build_tree(files))
