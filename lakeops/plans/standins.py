"""Catalog-shaped inputs built from the driver tables.

The driver tables hold no lake metadata, so each registered query first reshapes a driver
table into the schema its operator expects (a path listing, a role table, a share table…).
These builders only produce input rows; the operator under test does all the work.
Every builder here has a twin in ``oracles.py`` written in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the stand-in data (ours, not the reference's).
PAGES_ITEM = "pages"
DOCS_ITEM = "docs"


def url_host(url: str = "url"):
    return F.regexp_extract(F.col(url), r"^[A-Za-z]+://([^/?#]*)", 1)


def url_scheme(url: str = "url"):
    return F.regexp_extract(F.col(url), r"^([A-Za-z]+)://", 1)


def page_path(url: str = "url", page_id: str = "page_id"):
    """``pages/Files/<host>/<url path>/<page_id>.page``: one unique file per page."""
    host_path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z]+://([^?#]*)", 1), "/+$", "")
    return F.concat(F.lit(f"{PAGES_ITEM}/Files/"), host_path, F.lit("/"),
                    F.col(page_id).cast("string"), F.lit(".page"))


def pages_files(pages: DataFrame) -> DataFrame:
    """One ``paths`` row per page (files only): ``name, contentLength, isDirectory, isShortcut``."""
    return pages.select(
        page_path().alias("name"),
        F.length("html").cast("long").alias("contentLength"),
        F.lit(False).alias("isDirectory"),
        F.lit(False).alias("isShortcut"))


def pages_listing(pages: DataFrame) -> DataFrame:
    """A recursive listing below ``pages/Files``: every page file plus its folders."""
    files = pages_files(pages)
    segs = F.split("name", "/", -1)
    dirs = (files.select(segs.alias("s"))
            .select(F.explode(F.sequence(F.lit(3), F.size("s") - 1)).alias("k"), "s")
            .select(F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("name"))
            .distinct()
            .select("name", F.lit(None).cast("long").alias("contentLength"),
                    F.lit(True).alias("isDirectory"), F.lit(False).alias("isShortcut")))
    return files.unionByName(dirs)


def page_mounts(paths: DataFrame) -> DataFrame:
    """``mount, target``: a mount for each host's folder, two above these, and two that lead into each other."""
    hosts = paths.select(F.get(F.split("path", "/", -1), 2).alias("host")).distinct()
    own = hosts.select(F.concat(F.lit("pages/Files/m1/"), "host").alias("mount"), F.concat(F.lit("pages/Files/"), "host").alias("target"))
    more = [("m2", "m1"), ("m3/deep", "m2"), ("loop/a", "loop/b/x"), ("loop/b", "loop/a")]
    return own.unionByName(paths.sparkSession.createDataFrame(
        [(f"pages/Files/{m}", f"pages/Files/{t}") for m, t in more], "mount string, target string"))


def _perm(attr: str, values):
    return F.struct(F.lit(attr).alias("attributeName"),
                    values.alias("attributeValueIncludedIn"))


def _rule(*perms):
    return F.struct(F.lit("Permit").alias("effect"), F.array(*perms).alias("permission"))


def _member(object_id, object_type: str = "User"):
    return F.struct(F.lit("t0").alias("tenantId"), object_id.alias("objectId"),
                    F.lit(object_type).alias("objectType"))


def _members(*entra):
    no_items = F.array().cast("array<struct<itemAccess:array<string>,sourcePath:string>>")
    return F.struct(no_items.alias("fabricItemMembers"),
                    F.array(*entra).alias("microsoftEntraMembers"))


def pages_roles(pages: DataFrame) -> DataFrame:
    """Access roles derived from the page hosts, in the ``roles`` schema.

    * ``site:<host>``: first Path permission ``<host>/en``, ``<host>/fr``; a second Path
      permission (which would grant everything) must be ignored. Member ``u-<first label>``.
    * ``label:<first host label>``: Path ``pages/Files/<label>``, a prefix that is not
      segment-aligned, plus a rule whose only permission is an action. Members
      ``u-<label>`` and ``g-<label length>``.
    * ``scheme:<scheme>``: ``https`` grants ``*``; ``http`` grants the empty prefix.
      Member ``u-<scheme>``.
    """
    base = F.lit(f"{PAGES_ITEM}/Files/")
    hosts = pages.select(url_host().alias("host"), url_scheme().alias("scheme")).distinct()
    label = F.split_part(F.col("host"), F.lit("."), F.lit(1))
    # One distinct over (kind, key) for all three role kinds.
    kinds = hosts.select(F.explode(F.array(
        F.struct(F.lit("site").alias("kind"), F.col("host").alias("key")),
        F.struct(F.lit("label").alias("kind"), label.alias("key")),
        F.struct(F.lit("scheme").alias("kind"), F.col("scheme").alias("key")))).alias("k")
    ).select("k.kind", "k.key").distinct()
    kind, key = F.col("kind"), F.col("key")
    first_label = F.split_part(key, F.lit("."), F.lit(1))
    rules = (F.when(kind == "site", F.array(_rule(
                _perm("Action", F.array(F.lit("Read"))),
                _perm("Path", F.array(F.concat(base, key, F.lit("/en")), F.concat(base, key, F.lit("/fr")))),
                _perm("Path", F.array(base)))))
             .when(kind == "label", F.array(
                _rule(_perm("Path", F.array(F.concat(base, key)))),
                _rule(_perm("Action", F.array(F.lit("Read"))))))
             .otherwise(F.array(_rule(_perm("Path", F.array(
                F.when(key == "https", F.lit("*")).otherwise(F.lit(""))))))))
    members = (F.when(kind == "site", _members(_member(F.concat(F.lit("u-"), first_label))))
               .when(kind == "label", _members(
                   _member(F.concat(F.lit("u-"), key)),
                   _member(F.concat(F.lit("g-"), F.length(key).cast("string")), "Group")))
               .otherwise(_members(_member(F.concat(F.lit("u-"), key)))))
    return kinds.select(F.concat(kind, F.lit(":"), key).alias("id"), key.alias("name"),
                        rules.alias("decisionRules"), members.alias("members"))


# --------------------------------------------------------------------------- shares

def share_status(status: str = "o_orderstatus"):
    return (F.when(F.col(status) == "O", F.lit("Active"))
            .when(F.col(status) == "P", F.lit("Pending")).otherwise(F.lit("Revoked")))


def orders_shares(orders: DataFrame) -> DataFrame:
    """External data shares, one per order, in the ``shares`` schema."""
    return orders.select(
        F.concat(F.lit("share-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.array(F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")),
                F.concat(F.lit("prio/"), F.col("o_orderpriority"))).alias("paths"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string"),
                          F.lit("@example.com")).alias("userPrincipalName"),
                 F.concat(F.lit("t"), F.left("o_orderpriority", F.lit(1))).alias("tenantId")
                 ).alias("recipient"),
        share_status().alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("expirationTimeUtc"),
        F.concat(F.lit("ws-"), F.left("o_orderpriority", F.lit(1))).alias("workspaceId"),
        F.concat(F.lit("item-"), F.col("o_custkey").cast("string")).alias("itemId"))


# --------------------------------------------------------------------------- shortcuts

# Target kinds of a shortcut, in the order the stand-in assigns them from p_size.
SHORTCUT_KINDS = ("OneLake", "AmazonS3", "AdlsGen2", "GoogleCloudStorage", "S3Compatible",
                  "Dataverse", "ExternalDataShare", "AzureBlobStorage")


def part_shortcuts(part: DataFrame, keep=()) -> DataFrame:
    """One shortcut per part in the ``shortcuts`` schema; the kind cycles with ``p_size``."""
    size = F.col("p_size").cast("string")
    kind = F.element_at(F.array(*[F.lit(k) for k in SHORTCUT_KINDS]),
                        (F.col("p_size") % len(SHORTCUT_KINDS) + 1).cast("int"))
    sub = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    brand_no = F.regexp_extract("p_brand", r"(\d+)$", 1)

    def arm(name, *fields):
        return F.when(kind == name, F.struct(*fields))

    conn = F.concat(F.lit("conn-"), size).alias("connectionId")
    target = F.struct(
        kind.alias("type"),
        arm("OneLake", F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("itemId"),
            F.concat(F.lit("ws-"), brand_no).alias("workspaceId"),
            F.concat(F.lit("Tables/"), F.lower("p_type")).alias("path"),
            F.lit(None).cast("string").alias("connectionId")).alias("oneLake"),
        arm("AmazonS3", F.concat(F.lit("https://bucket"), size, F.lit(".s3.amazonaws.com")).alias("location"),
            sub.alias("subpath"), conn).alias("amazonS3"),
        arm("AdlsGen2", F.concat(F.lit("https://acct"), size, F.lit(".dfs.core.windows.net")).alias("location"),
            F.concat(F.lit("/data"), sub).alias("subpath"), conn).alias("adlsGen2"),
        arm("GoogleCloudStorage", F.concat(F.lit("https://gcs"), size, F.lit(".storage.googleapis.com")).alias("location"),
            sub.alias("subpath"), conn).alias("googleCloudStorage"),
        arm("S3Compatible", F.lit("https://minio.example.com").alias("location"),
            sub.alias("subpath"), F.concat(F.lit("b"), size).alias("bucket"), conn).alias("s3Compatible"),
        arm("Dataverse", F.lit("org.example.com").alias("environmentDomain"), conn,
            F.lit("deltalake").alias("deltaLakeFolder"), F.col("p_name").alias("tableName")).alias("dataverse"),
        arm("ExternalDataShare", conn).alias("externalDataShare"),
        arm("AzureBlobStorage", F.concat(F.lit("https://blob"), size, F.lit(".blob.core.windows.net")).alias("location"),
            F.concat(F.lit("/data"), sub).alias("subpath"), conn).alias("azureBlobStorage"))
    return part.select(
        F.concat(F.lit("Files/"), F.lower("p_type")).alias("path"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        target.alias("target"), *keep)


# --------------------------------------------------------------------------- capacities

def capacities(customer: DataFrame, part: DataFrame) -> DataFrame:
    """Capacities from customers and parts: ``id, displayName, sku, region, state``."""
    c = customer.select(
        F.concat(F.lit("cap-c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("displayName"),
        F.concat(F.left("c_mktsegment", F.lit(1)), F.col("c_nationkey").cast("string")).alias("sku"),
        F.concat(F.lit("Region-"), F.col("c_nationkey").cast("string")).alias("region"),
        F.when(F.col("c_acctbal") < 0, F.lit("Suspended")).otherwise(F.lit("Active")).alias("state"))
    p = part.select(
        F.concat(F.lit("cap-p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("displayName"),
        F.concat(F.left("p_type", F.lit(1)), F.col("p_size").cast("string")).alias("sku"),
        F.concat(F.lit("region-"), F.col("p_size").cast("string")).alias("region"),
        F.lit("Active").alias("state"))
    return c.unionByName(p)


# --------------------------------------------------------------------------- runs

def events_operations(events: DataFrame) -> DataFrame:
    """Long-running operations: ``id, status, percentComplete, error``."""
    et = F.col("event_type")
    status = (F.when(et == "click", "Running").when(et == "view", "NotStarted")
              .when(et == "purchase", "Succeeded").when(et == "error", "Failed")
              .otherwise("Cancelled"))
    msg = F.when((et == "error") & (F.col("value") >= 10),
                 F.concat(F.lit("error for user "), F.col("user_id").cast("string"))).otherwise(F.lit(""))
    return events.select(
        F.concat(F.lit("op-"), F.col("event_id").cast("string")).alias("id"),
        status.alias("status"),
        F.col("value").alias("percentComplete"),
        F.struct(F.lit("E1").alias("code"), msg.alias("message")).alias("error"))


def events_requested_ops(events: DataFrame) -> DataFrame:
    """Requested operation ids: ``op-<2 × event_id>``, so some have no operation row."""
    return events.select(F.concat(F.lit("op-"), (F.col("event_id") * 2).cast("string")).alias("id"))


def events_job_runs(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    status = (F.when(et == "click", "InProgress").when(et == "view", "NotStarted")
              .when(et == "purchase", "Completed").when(et == "error", "Failed")
              .otherwise("Cancelled"))
    return events.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("item-"), F.col("user_id").cast("string")).alias("itemId"),
        status.alias("status"))


# --------------------------------------------------------------------------- rule inputs

def part_pools(part: DataFrame) -> DataFrame:
    """Spark pool definitions plus gateway and manifest fields, one row per part."""
    size = F.col("p_size")
    name = (F.when(size == 1, F.lit("")).when(size > 45, F.lit("Starter Pool"))
            .when(size > 40, F.concat(F.col("p_name"), F.lit("#")))
            .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))))
    md5 = F.md5(F.concat(F.col("p_name"), F.col("p_partkey").cast("string")))
    guid = F.when(size < 5, F.lit("not-a-guid")).otherwise(F.concat_ws(
        "-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4),
        F.substring(md5, 17, 4), F.substring(md5, 21, 12)))
    version = F.when(size > 40, F.concat(F.lit("0"), size.cast("string"), F.lit(".1.0"))).otherwise(
        F.concat(size.cast("string"), F.lit(".0."), F.col("p_partkey").cast("string"),
                 F.when(size > 30, F.lit("-beta.1")).otherwise(F.lit(""))))
    return part.select(
        "p_partkey",
        name.alias("name"),
        F.when(size == 4, F.lit("")).otherwise(F.lit("MemoryOptimized")).alias("nodeFamily"),
        F.when(size == 2, F.lit(None)).otherwise(F.lit("Small")).alias("nodeSize"),
        F.when(size == 7, F.lit(None)).otherwise(F.struct(
            F.lit(True).alias("enabled"), (size % 4).alias("minNodeCount"),
            (size % 3).alias("maxNodeCount"))).alias("autoScale"),
        F.when(size == 3, F.lit(None)).otherwise(F.struct(
            F.lit(True).alias("enabled"), (size % 5).alias("minExecutors"),
            ((size + 1) % 4).alias("maxExecutors"))).alias("dynamicExecutorAllocation"),
        (size * 30).alias("inactivityMinutesBeforeSleep"),
        (size % 9).alias("numberOfMemberGateways"),
        F.repeat(F.col("p_name"), size).alias("displayName"),
        version.alias("version"),
        F.concat(guid, F.when(size == 6, F.lit("\n")).otherwise(F.lit(""))).alias("guid"),
        F.concat(F.lit("Org.W"), F.when(size == 8, F.lit("_")).otherwise(F.lit("")), size.cast("string")).alias("workload"),
        F.concat(F.lit("Org.W1"), F.when(size == 9, F.lit("")).otherwise(F.lit(".I")), size.cast("string")).alias("itemType"),
        F.concat(F.lit("Org.W1.I1"), F.when(size == 10, F.lit("..")).otherwise(F.lit(".J")), size.cast("string")).alias("jobType"))


def manifest_tables(region: DataFrame, nation: DataFrame, customer: DataFrame):
    """Workload packages (regions), item manifests (nations), job types (customers)."""
    packages = region.select(
        F.concat(F.lit("pkg-"), F.col("r_regionkey").cast("string")).alias("package"),
        F.concat(F.lit("Org.W"), F.col("r_regionkey").cast("string")).alias("workloadName"))
    rk, nk = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")
    items = nation.select(
        F.concat(F.lit("pkg-"), rk).alias("package"),
        F.concat(F.col("n_name"), F.lit(".xml")).alias("itemFile"),
        F.when(F.col("n_nationkey") == 7, F.lit("Org.Other"))
         .when(F.col("n_nationkey") == 9, F.concat(F.lit("ORG.w"), rk))
         .otherwise(F.concat(F.lit("Org.W"), rk)).alias("itemWorkloadName"),
        F.concat(F.when(F.col("n_nationkey") % 5 == 0, F.lit("org.W")).otherwise(F.lit("Org.W")),
                 rk, F.lit(".Item"), nk).alias("typeName"))
    cn = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    jobs = cn.select(
        F.concat(F.lit("pkg-"), F.col("n_regionkey").cast("string")).alias("package"),
        F.concat(F.col("n_name"), F.lit(".xml")).alias("itemFile"),
        F.concat(F.lit("Org.W"), F.col("n_regionkey").cast("string"), F.lit(".Item"),
                 F.col("n_nationkey").cast("string"),
                 F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit(".")),
                 F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("jobName"))
    return packages, items, jobs


# --------------------------------------------------------------------------- folders

def geo_folders(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Folder tree region → nation → customer: ``id, displayName, parentFolderId``."""
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                      F.col("r_name").alias("displayName"),
                      F.lit(None).cast("string").alias("parentFolderId"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                      F.col("n_name").alias("displayName"),
                      F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parentFolderId"))
    c = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                        F.col("c_name").alias("displayName"),
                        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parentFolderId"))
    return r.unionByName(n).unionByName(c)


def order_folders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers as top folders, each order a folder below its customer."""
    c = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                        F.col("c_name").alias("displayName"),
                        F.lit(None).cast("string").alias("parentFolderId"))
    o = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
                      F.col("o_orderpriority").alias("displayName"),
                      F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parentFolderId"))
    return c.unionByName(o)


def geo_moves(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Move requests ``id, target``: nations named A… to the root; every region under its
    lowest-key nation (a cycle); customers with a negative balance to the next nation, or to a
    folder that does not exist (every seventh)."""
    to_root = nation.where(F.startswith("n_name", F.lit("A"))).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("target"))
    cyc = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("k").cast("string")).alias("target"))
    cust = customer.where(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("nowhere")).otherwise(
            F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string"))).alias("target"))
    return to_root.unionByName(cyc).unionByName(cust)


def page_dir_segments(url: str = "url"):
    """Folder names of a page below ``pages/Files``: host, then the URL path segments."""
    host_path = F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z]+://([^?#]*)", 1), "/+$", "")
    return F.split(host_path, "/", -1)


def page_folder_requests(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("request"), page_dir_segments().alias("segments"))


def https_page_folders(pages: DataFrame) -> DataFrame:
    """Existing folders: every folder of the ``https`` pages, ids are their path text."""
    segs = page_dir_segments()
    pre = (pages.where(url_scheme() == "https").select(segs.alias("s"))
           .select(F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"), "s")
           .select(F.slice("s", F.lit(1), F.col("k")).alias("p")).distinct())
    return pre.select(
        F.array_join("p", "/").alias("id"), F.element_at("p", -1).alias("displayName"),
        F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/"))
         .alias("parentFolderId"))


# --------------------------------------------------------------------------- tables listing

def docs_listing(documents: DataFrame) -> DataFrame:
    """A recursive ``docs/Tables`` listing from the documents' languages and sources:
    a data file per document, a ``_delta_log`` per (lang, source) at schema depth, one per
    source at top level and one per language nested too deep for a schema, and a shortcut
    per source (account type by the source's last digit)."""
    base = F.lit(f"{DOCS_ITEM}/Tables/")
    none = F.lit(None).cast("string")
    files = documents.select(
        F.concat(base, "lang", F.lit("/"), "source", F.lit("/part-"),
                 F.col("doc_id").cast("string"), F.lit(".parquet")).alias("name"),
        F.lit(False).alias("isDirectory"), F.lit(False).alias("isShortcut"), none.alias("accountType"))
    acct = (F.when(F.endswith("source", F.lit("1")), F.lit("ADLS"))
            .when(F.endswith("source", F.lit("2")), F.lit("ExternalADLS")).otherwise(F.lit("S3")))

    def entry(name, is_sc, account):
        return F.struct(name.alias("name"), F.lit(True).alias("isDirectory"),
                        F.lit(is_sc).alias("isShortcut"), account.alias("accountType"))

    # One distinct over (lang, source), one over the folder entries derived from it.
    folders = documents.select("lang", "source").distinct().select(F.explode(F.array(
        entry(F.concat(base, "lang", F.lit("/"), "source", F.lit("/_delta_log")), False, none),
        entry(F.concat(base, "source", F.lit("_flat/_delta_log")), False, none),
        entry(F.concat(base, F.lit("archive/"), "lang", F.lit("/old/_delta_log")), False, none),
        entry(F.concat(base, F.lit("ext_"), "source"), True, acct))).alias("e")).select("e.*").distinct()
    return files.unionByName(folders)


# --------------------------------------------------------------------------- tags, links

def part_tags(part: DataFrame) -> DataFrame:
    """Tags named after parts; many share a name, ``ord`` decides which one is last."""
    return part.select(F.concat(F.lit("tag-"), F.col("p_partkey").cast("string")).alias("id"),
                       F.col("p_name").alias("name"), F.col("p_type").alias("color"),
                       F.col("p_partkey").alias("ord"))


def tag_requests(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Tag-by-name requests, one per line item: the part's name, upper-cased on first lines,
    with a suffix no tag has on second lines."""
    j = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    ln = F.col("l_linenumber")
    name = (F.when(ln == 1, F.upper("p_name")).when(ln == 2, F.concat("p_name", F.lit(" x")))
            .otherwise(F.col("p_name")))
    return j.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("itemId"),
                    name.alias("name"), "l_returnflag", "l_linestatus")


def nation_gateways(nation: DataFrame) -> DataFrame:
    return nation.select(F.concat(F.lit("gw-"), F.col("n_nationkey").cast("string")).alias("id"),
                         F.col("n_name").alias("displayName"))


def supplier_assignments(supplier: DataFrame) -> DataFrame:
    """Role assignments: supplier → gateway of its nation; principal by supplier key mod 7."""
    return supplier.select(
        F.concat(F.lit("as-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("gw-"), F.col("s_nationkey").cast("string")).alias("resourceId"),
        F.struct(F.concat(F.lit("p-"), (F.col("s_suppkey") % 7).cast("string")).alias("id"),
                 F.lit("User").alias("type"), F.col("s_name").alias("displayName")).alias("principal"),
        F.when(F.col("s_acctbal") > 5000, F.lit("Admin")).otherwise(F.lit("Member")).alias("role"))


def share_path_details(shares: DataFrame) -> DataFrame:
    """What each share offers: ``invitationId, pathId, name, type``."""
    e = shares.select("id", F.posexplode("paths").alias("pos", "p"))
    return e.select(F.col("id").alias("invitationId"),
                    F.concat(F.col("id"), F.lit("#"), (F.col("pos") + 1).cast("string")).alias("pathId"),
                    F.col("p").alias("name"),
                    F.when(F.startswith("p", F.lit("cust/")), F.lit("Folder")).otherwise(F.lit("Table")).alias("type"))


def share_accept_requests(shares: DataFrame) -> DataFrame:
    """Accept every pending share: a shortcut per offered path, plus one unknown path id."""
    pend = shares.where(F.col("status") == "Pending")
    e = pend.select("id", "itemId", "workspaceId", F.posexplode("paths").alias("pos", "p"))
    ok = e.select(F.col("id").alias("invitationId"),
                  F.concat(F.col("id"), F.lit("#"), (F.col("pos") + 1).cast("string")).alias("pathId"),
                  F.regexp_replace("p", "/", "_").alias("shortcutName"),
                  F.lit("Files/shared").alias("path"), "itemId", "workspaceId")
    bogus = pend.select(F.col("id").alias("invitationId"),
                        F.concat(F.col("id"), F.lit("#9")).alias("pathId"),
                        F.lit("unknown").alias("shortcutName"), F.lit("Files/shared").alias("path"),
                        "itemId", "workspaceId")
    return ok.unionByName(bogus)


def customer_schedules(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.concat(F.lit("sch-"), F.col("c_custkey").cast("string")).alias("id"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.struct(F.lit("Daily").alias("type"), F.col("c_nationkey").alias("interval"),
                 F.array(F.lit("09:00")).alias("times")).alias("configuration"))


def schedule_toggles(customer: DataFrame) -> DataFrame:
    """Patches ``id, seq, enabled, configuration``: one switching ``enabled`` for BUILDING
    customers (configuration left out), a later one with a weekly configuration for every third
    nation (``enabled`` left out); many customers get both."""
    config = "struct<type:string,interval:int,times:array<string>>"
    key = F.concat(F.lit("sch-"), F.col("c_custkey").cast("string")).alias("id")
    toggles = customer.where(F.col("c_mktsegment") == "BUILDING").select(
        key, F.lit(1).alias("seq"), (~(F.col("c_acctbal") > 0)).alias("enabled"), F.lit(None).cast(config).alias("configuration"))
    weekly = F.struct(F.lit("Weekly").alias("type"), (F.col("c_nationkey") + 100).alias("interval"), F.array(F.lit("08:00")).alias("times"))
    configured = customer.where(F.col("c_nationkey") % 3 == 0).select(
        key, F.lit(2).alias("seq"), F.lit(None).cast("boolean").alias("enabled"), weekly.cast(config).alias("configuration"))
    return toggles.unionByName(configured)


def shortcut_batch(part: DataFrame, mark: bool = False):
    """Existing shortcuts (parts of size <= 25, and for size 24 and 50 also the name that a
    conflicting request would be given) and a create batch (size >= 20, with a repeat request
    for size >= 45)."""
    s = part_shortcuts(part, keep=("p_partkey", "p_size"))
    if mark:  # a target that tells which part it came from
        s = s.withColumn("target", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    given = F.col("p_partkey") + F.when(F.col("p_size") == 50, 1000000).otherwise(0)
    taken = s.where(F.col("p_size").isin(24, 50)).select(
        "path", F.concat("name", F.lit("_"), given.cast("string")).alias("name"), "target")
    existing = s.where(F.col("p_size") <= 25).select("path", "name", "target").unionByName(taken)
    reqs = s.where(F.col("p_size") >= 20).select(F.col("p_partkey").alias("req_id"), "path", "name", "target")
    again = s.where(F.col("p_size") >= 45).select((F.col("p_partkey") + 1000000).alias("req_id"),
                                                  "path", "name", "target")
    return existing, reqs.unionByName(again)


# --------------------------------------------------------------------------- definitions, pages

def events_items(events: DataFrame) -> DataFrame:
    """Items from events with a JSON definition (``props``) and two extra parts: a
    ``.platform`` part whose metadata overrides type/name/description when value > 50,
    and a ``notes.txt`` part."""
    big = F.col("value") > 50
    meta = F.struct(F.struct(
        F.when(big, F.upper("event_type")).alias("type"),
        F.when(big, F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("displayName"),
        F.when(big, F.lit("from platform")).alias("description")).alias("metadata"))
    b64 = lambda c: F.regexp_replace(F.base64(c), r"[\r\n]", "")
    platform = F.struct(F.lit(".platform").alias("path"), b64(F.to_json(meta)).alias("payload"),
                        F.lit("InlineBase64").alias("payloadType"))
    notes = F.struct(F.lit("notes.txt").alias("path"), b64(F.col("event_type")).alias("payload"),
                     F.lit("InlineBase64").alias("payloadType"))
    return events.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
        F.lit("ws-events").alias("workspaceId"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("displayName"),
        F.lit(None).cast("string").alias("description"),
        F.col("props").alias("definition"),
        F.array(platform, notes).alias("additionalParts"))


def corrupt_error_payloads(definitions: DataFrame) -> DataFrame:
    """Replace the payload.json of ``error`` items with text that is not base64.

    ``definitions`` carries the item ``type`` (``pack_definitions(..., keep=("type",))``)."""
    bad = F.col("type") == "error"
    parts = F.transform("parts", lambda p: F.when(
        bad & (p["path"] == F.lit("payload.json")),
        F.struct(p["path"].alias("path"), F.lit("@@ not base64 @@").alias("payload"),
                 p["payloadType"].alias("payloadType"))).otherwise(p))
    return definitions.select("itemId", "format", parts.alias("parts"))


def events_responses(events: DataFrame) -> DataFrame:
    """Definition response bodies: good ones (payloadType left out on views), a body that
    is not JSON for errors, and ``parts`` that is not an array for signups."""
    et = F.col("event_type")
    part = F.struct(F.lit("payload.json").alias("path"),
                    F.regexp_replace(F.base64("props"), r"[\r\n]", "").alias("payload"),
                    F.when(et != "view", F.lit("Custom")).alias("payloadType"))
    good = F.to_json(F.struct(F.struct(F.array(part).alias("parts")).alias("definition")))
    body = (F.when(et == "error", F.lit("not json"))
            .when(et == "signup", F.lit('{"definition": {"parts": 5}}')).otherwise(good))
    return events.select("event_id", body.alias("body"))


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """One landed page per conversation turn, in the three page shapes by turn mod 3:
    ``{"value": [row], "continuationToken": ...}``, ``[row, row]``, ``row``."""
    row = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    shape = F.col("turn") % 3
    page = (F.when(shape == 0, F.concat(F.lit('{"value": ['), row, F.lit('], "continuationToken": "c'),
                                        F.col("conv_id").cast("string"), F.lit('"}')))
            .when(shape == 1, F.concat(F.lit("["), row, F.lit(", "), row, F.lit("]")))
            .otherwise(row))
    return conversations.select(page.alias("page"))


def region_shortcuts(region: DataFrame, part: DataFrame, root: str) -> DataFrame:
    """Two shortcuts named ``nations`` per region, in different folders, over the region's folder
    ``<root>/r=<key>``; the second is given without a leading slash."""
    kinds = part_shortcuts(part).schema["target"].dataType
    arms = [f.name for f in kinds.fields if f.name not in ("type", "amazonS3")]
    key = F.col("r_regionkey").cast("string")

    def shortcut(folder, subpath):
        return F.struct(F.concat(F.lit(folder), key).alias("path"), F.lit("nations").alias("name"), F.struct(
            F.lit("AmazonS3").alias("type"), F.struct(F.lit(root).alias("location"), subpath.alias("subpath"),
                                                      F.lit(None).cast("string").alias("connectionId")).alias("amazonS3"),
            *[F.lit(None).cast(kinds[a].dataType).alias(a) for a in arms]).alias("target"))

    both = F.array(shortcut("Files/region", F.concat(F.lit("/r="), key)), shortcut("Files/again", F.concat(F.lit("r="), key)))
    return region.select(F.explode(both).alias("s")).select("s.*")
