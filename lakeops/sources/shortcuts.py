"""``mount_shortcuts``: storage URIs for shortcut targets, and reading them as tables.

Shortcut targets are a tagged union (``target.type`` plus one struct per kind). The URI
rules are ours; the reference only forwards the target to a service:

==================  =================================================================
kind                URI
==================  =================================================================
OneLake             ``<lake_root>/<workspaceId>/<itemId>/<path>``
AmazonS3            ``s3a://<bucket><subpath>`` (bucket: see ``_bucket``)
AdlsGen2            ``abfss://<container>@<host>/<rest of subpath>``
GoogleCloudStorage  ``gs://<bucket><subpath>`` (bucket: see ``_bucket``)
S3Compatible        ``s3a://<bucket><subpath>`` (endpoint = location, set in Hadoop conf)
AzureBlobStorage    ``wasbs://<container>@<host>/<rest of subpath>``
Dataverse           null (no storage location in the target)
ExternalDataShare   null (no storage location in the target)
==================  =================================================================

A location that is already a local path (``file:`` or ``/``) is used as is, joined with
the subpath.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LAKE_ROOT = "lake://"


def _host(loc: Column) -> Column:
    return F.regexp_extract(loc, r"^[A-Za-z0-9+.-]+://([^/]+)", 1)


def _bucket(loc: Column) -> Column:
    """Bucket of a location: the host's part before the service's name (it may hold dots), or the
    first path segment where the host is the service itself."""
    host = _host(loc)
    before = F.regexp_extract(host, r"^(.+)\.(?:s3[.-].*|s3$|storage\.googleapis\.com|storage\.cloud\.google\.com)", 1)
    service = host.rlike(r"^(?:s3[.-]|s3$|storage\.googleapis\.com$|storage\.cloud\.google\.com$)")
    segment = F.regexp_extract(loc, r"^[A-Za-z0-9+.-]+://[^/]+/([^/]+)", 1)
    return F.when(service, segment).when(before != "", before).otherwise(F.split_part(host, F.lit("."), F.lit(1)))


def _below(subpath: Column) -> Column:
    """A subpath with exactly one leading slash, or nothing."""
    bare = F.regexp_replace(F.coalesce(subpath, F.lit("")), "^/+", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("/"), bare))


def _container_uri(scheme: str, arm: Column) -> Column:
    sub = F.regexp_replace(F.coalesce(arm["subpath"], F.lit("")), "^/+", "")
    container = F.split_part(sub, F.lit("/"), F.lit(1))
    rest = F.regexp_replace(sub, r"^[^/]*/?", "")
    return F.concat(F.lit(f"{scheme}://"), container, F.lit("@"), _host(arm["location"]),
                    F.lit("/"), rest)


def _local_or(arm: Column, uri: Column) -> Column:
    loc = arm["location"]
    is_local = F.startswith(loc, F.lit("file:")) | F.startswith(loc, F.lit("/"))
    return F.when(is_local, F.concat(F.regexp_replace(loc, "/+$", ""), _below(arm["subpath"]))).otherwise(uri)


def shortcut_uri(target: str | Column = "target", lake_root: str = DEFAULT_LAKE_ROOT) -> Column:
    """The storage URI of a shortcut target struct (null for kinds without storage)."""
    t = F.col(target) if isinstance(target, str) else target
    kind = t["type"]
    ol, s3, adls = t["oneLake"], t["amazonS3"], t["adlsGen2"]
    gcs, s3c, blob = t["googleCloudStorage"], t["s3Compatible"], t["azureBlobStorage"]
    sub = lambda a: _below(a["subpath"])
    root = lake_root if lake_root.endswith("/") else lake_root + "/"
    return (F.when(kind == "OneLake", F.concat(F.lit(root), F.concat_ws(
                "/", ol["workspaceId"], ol["itemId"], ol["path"])))
            .when(kind == "AmazonS3", _local_or(s3, F.concat(F.lit("s3a://"), _bucket(s3["location"]), sub(s3))))
            .when(kind == "AdlsGen2", _local_or(adls, _container_uri("abfss", adls)))
            .when(kind == "GoogleCloudStorage",
                  _local_or(gcs, F.concat(F.lit("gs://"), _bucket(gcs["location"]), sub(gcs))))
            .when(kind == "S3Compatible", _local_or(s3c, F.concat(F.lit("s3a://"), s3c["bucket"], sub(s3c))))
            .when(kind == "AzureBlobStorage", _local_or(blob, _container_uri("wasbs", blob))))


def mount_shortcut(spark: SparkSession, uri: str, fmt: str = "parquet", view: str | None = None,
                   **options) -> DataFrame:
    """Read one mounted location; register it as a temp view when ``view`` is given."""
    df = spark.read.format(fmt).options(**options).load(uri)
    if view:
        df.createOrReplaceTempView(view)
    return df


def mount_shortcuts(spark: SparkSession, shortcuts: DataFrame, fmt: str = "parquet",
                    lake_root: str = DEFAULT_LAKE_ROOT, **options) -> DataFrame:
    """One table over the targets of all shortcuts: ``shortcutPath, shortcutName`` and the data.

    One scan reads all locations; each file is matched to its shortcuts, so two shortcuts of one
    name in different folders stay apart and two over one location both get its rows. A shortcut has
    the rows that it has when mounted alone: of the files in its location and in partition
    folders (``k=v``) below it. So a shortcut over a folder does not get what only another one, over a plain
    subfolder, brings in. Only distinct locations reach the driver, which must know them to plan a scan. All
    targets hold data of one schema. Shortcuts without a storage location are left out.
    """
    found = shortcuts.select(F.col("path").alias("shortcutPath"), F.col("name").alias("shortcutName"),
                             F.regexp_replace(shortcut_uri("target", lake_root), "/+$", "").alias("uri")).where("uri is not null")
    twice = found.groupBy("shortcutPath", "shortcutName").agg(F.count_distinct("uri").alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"two targets for one shortcut: {tuple(twice[0])[:2]}")
    uris = [r["uri"] for r in found.select("uri").distinct().toLocalIterator()]
    if not uris:
        raise ValueError("no shortcut has a storage location")
    data = spark.read.format(fmt).options(**options).load(uris)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    # The files first: a file's folders, from its own up through partition folders, are looked up.
    file = F.col("_metadata.file_path")
    steps = F.split(F.regexp_replace(bare(F.col("_file")), "/[^/]*$", ""), "/", -1)
    files = data.select(file.alias("_file")).distinct().select("_file", steps.alias("_s"))
    files = files.select("_file", "_s", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("_i")).where(
        F.forall(F.slice("_s", F.col("_i") + 1, F.size("_s")), lambda x: F.contains(x, F.lit("="))))
    files = files.select("_file", F.array_join(F.slice("_s", F.lit(1), F.col("_i")), "/").alias("_at"))
    at = found.distinct().withColumn("_at", bare(F.col("uri")))
    owned = files.join(at, "_at").select("_file", "shortcutPath", "shortcutName")
    rows = data.select(F.struct(*data.columns).alias("_row"), file.alias("_file"))
    return rows.join(owned, "_file").select("shortcutPath", "shortcutName", "_row.*")
