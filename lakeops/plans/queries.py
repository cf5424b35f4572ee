"""

Each query reads whole driver tables, reshapes them into catalog-shaped input with
``standins`` and runs library operators on the result. The oracle SQL next to each query
states the same answer in DuckDB over the same Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lakeops.sources as SRC
from lakeops.functions.codec import b64_encode
from lakeops.functions.text import last_segment
from lakeops.operators import access
from lakeops.operators import hierarchy as H
from lakeops.operators import links as L
from lakeops.operators import mounts as M
from lakeops.operators import name_index
from lakeops.operators import nested as N
from lakeops.operators import paging
from lakeops.operators import paths as P
from lakeops.operators import quality
from lakeops.operators import search as Q
from lakeops.plans import oracles as O
from lakeops.plans import standins as S
from lakeops.plans.registry import query
from lakeops.session import materialize, read_table
from lakeops.sources.shortcuts import shortcut_uri


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --------------------------------------------------------------------------- access


@query("q_access_count", O.with_pages_access("""
SELECT r.role_id, count(g.path) AS n_paths
FROM (SELECT DISTINCT role_id FROM page_role_patterns) r
LEFT JOIN page_grants g ON r.role_id = g.role_id
GROUP BY r.role_id
"""))
def q_access_count(spark, sf_dir):
    """roles_for_path (first Path permission of each rule, prefix match): how many pages
    each access role opens, zero for roles that open none."""
    pages = _t(spark, sf_dir, "pages")
    files = S.pages_files(pages).select(F.col("name").alias("path"))
    return access.role_path_counts(files, S.pages_roles(pages))


@query("q_access_pairs", O.with_pages_access("""
SELECT m.objectId, g.path, array_to_string(list_sort(list(DISTINCT g.role_id)), ',') AS roles
FROM page_role_members m JOIN page_grants g ON m.role_id = g.role_id
GROUP BY m.objectId, g.path
"""))
def q_access_pairs(spark, sf_dir):
    """access_matrix: every member with every page readable, and the roles that give it."""
    pages = _t(spark, sf_dir, "pages")
    files = S.pages_files(pages).select(F.col("name").alias("path"))
    pairs = access.access_matrix(files, S.pages_roles(pages))
    return pairs.select("objectId", "path", F.array_join("roles", ",").alias("roles"))


@query("q_access_classes", O.with_pages_access("""
, held AS (SELECT objectId, list_sort(list(DISTINCT role_id)) AS r FROM page_role_members GROUP BY objectId),
  open AS (SELECT path, list_sort(list(DISTINCT role_id)) AS r FROM page_grants GROUP BY path),
  mc AS (SELECT r, count(*) AS n FROM held GROUP BY r),
  pc AS (SELECT r, count(*) AS n FROM open GROUP BY r)
SELECT array_to_string(mc.r, ',') AS member_roles, mc.n AS n_members, pc.n AS n_paths,
       array_to_string(list_sort(list_intersect(mc.r, pc.r)), ',') AS roles
FROM mc, pc WHERE list_has_any(mc.r, pc.r)
"""))
def q_access_classes(spark, sf_dir):
    """access_classes: classes of members and of pages, their sizes and the roles between them."""
    pages = _t(spark, sf_dir, "pages")
    roles = S.pages_roles(pages)
    c = access.access_classes(S.pages_files(pages).select(F.col("name").alias("path")), roles)
    held = access.roles_for_member(roles).join(c.members, "objectId")
    members = held.groupBy("member_class").agg(F.array_join(F.array_sort(F.collect_set("role_id")), ",").alias("member_roles"),
                                               F.count_distinct("objectId").alias("n_members"))
    paths = c.paths.groupBy("path_class").agg(F.count("*").alias("n_paths"))
    return c.access.join(members, "member_class").join(paths, "path_class").select(
        "member_roles", "n_members", "n_paths", F.array_join("roles", ",").alias("roles"))


@query("q_access_matrix", O.with_pages_access("""
, held AS (SELECT objectId, count(DISTINCT role_id) AS n_roles FROM page_role_members GROUP BY objectId),
  reach AS (SELECT m.objectId, count(DISTINCT g.path) AS n_paths
            FROM page_role_members m JOIN page_grants g ON m.role_id = g.role_id
            GROUP BY m.objectId)
SELECT h.objectId, h.n_roles, coalesce(r.n_paths, 0) AS n_paths
FROM held h LEFT JOIN reach r ON h.objectId = r.objectId
"""))
def q_access_matrix(spark, sf_dir):
    """access_summary (roles_for_path + roles_for_member): per member, roles held and
    distinct pages readable, without forming member-page pairs."""
    pages = _t(spark, sf_dir, "pages")
    files = S.pages_files(pages).select(F.col("name").alias("path"))
    return access.access_summary(files, S.pages_roles(pages))


# --------------------------------------------------------------------------- search


@query("q_name_search", """
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(p_name), 'red') AND lower(p_type) = 'promo'
""")
def q_name_search(spark, sf_dir):
    """search_catalog: filter_contains (case-insensitive) + filter_equals_ci."""
    part = _t(spark, sf_dir, "part")
    return Q.search_catalog(part, [Q.filter_contains("p_name", "RED"),
                                   Q.filter_equals_ci("p_type", "promo")]
                            ).select("p_partkey", "p_name", "p_type")


@query("q_name_index", """
SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red')
""")
def q_name_index(spark, sf_dir):
    """search_names: parts found by name through a stored trigram index."""
    at = SRC.staging_path(spark, "name-index")
    name_index.build_name_index(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", at)
    return name_index.search_names(spark, at, "RED")


@query("q_equals_filter", """
SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' AND contains(p_name, 'ing')
""")
def q_equals_filter(spark, sf_dir):
    """search_catalog: filter_equals + case-sensitive filter_contains."""
    part = _t(spark, sf_dir, "part")
    return Q.search_catalog(part, [Q.filter_equals("p_brand", "Brand#7"),
                                   Q.filter_contains("p_name", "ing", case_sensitive=True)]
                            ).select("p_partkey", "p_name")


@query("q_flag_filter", """
SELECT doc_id FROM labels WHERE quality = 1 AND (toxic <> 1 OR doc_id % 5 = 0)
""")
def q_flag_filter(spark, sf_dir):
    """search_catalog: filter_flag and its negation over boolean label columns; every fifth
    document has no toxicity flag, which is a flag that is not set."""
    labels = _t(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("isQuality"),
        F.when(F.col("doc_id") % 5 != 0, F.col("toxic") == 1).alias("isToxic"))
    return Q.search_catalog(labels, [Q.filter_flag("isQuality"),
                                     Q.filter_flag("isToxic", negate=True)]).select("doc_id")


@query("q_share_filters", f"""
WITH shares AS ({O.SHARES})
SELECT id, status FROM shares
WHERE status IN ('Active', 'Pending')
  AND len(list_filter(paths, lambda x: contains(x, 'cust/1'))) > 0
  AND tenantId = 't2'
""")
def q_share_filters(spark, sf_dir):
    """search_catalog: filter_roles_in + filter_array_any (contains) + filter_struct_field."""
    shares = S.orders_shares(_t(spark, sf_dir, "orders"))
    return Q.search_catalog(shares, [
        Q.filter_roles_in("status", ["Active", "Pending"]),
        Q.filter_array_any("paths", "cust/1", how="contains"),
        Q.filter_struct_field("recipient.tenantId", "t2"),
    ]).select("id", "status")


@query("q_share_by_path", f"""
WITH shares AS ({O.SHARES})
SELECT id, status FROM shares
WHERE list_contains(paths, 'prio/1-URGENT') AND status = 'Revoked'
""")
def q_share_by_path(spark, sf_dir):
    """search_catalog: filter_array_any (equals) + filter_equals; empty role list = no filter."""
    shares = S.orders_shares(_t(spark, sf_dir, "orders"))
    return Q.search_catalog(shares, [
        Q.filter_array_any("paths", "prio/1-URGENT"),
        Q.filter_equals("status", "Revoked"),
        Q.filter_roles_in("status", []),
    ]).select("id", "status")


EXPIRY_AS_OF = "1997-01-01 00:00:00"


@query("q_expired", f"""
WITH shares AS ({O.SHARES})
SELECT id, status FROM shares
WHERE expirationTimeUtc < TIMESTAMP '{EXPIRY_AS_OF}'
""")
def q_expired(spark, sf_dir):
    """search_catalog: filter_expired against a fixed as-of time."""
    shares = S.orders_shares(_t(spark, sf_dir, "orders"))
    return Q.search_catalog(shares, [Q.filter_expired("expirationTimeUtc", EXPIRY_AS_OF)]
                            ).select("id", "status")


@query("q_union_kind", f"""
WITH shortcuts AS ({O.SHORTCUTS})
SELECT path, name FROM shortcuts WHERE kind = 'OneLake' AND ol_workspace = 'ws-7'
""")
def q_union_kind(spark, sf_dir):
    """search_catalog: filter_union_kind + filter_struct_field on a shortcut's target."""
    sc = S.part_shortcuts(_t(spark, sf_dir, "part"))
    return Q.search_catalog(sc, [Q.filter_union_kind("target", "OneLake"),
                                 Q.filter_struct_field("target.oneLake.workspaceId", "ws-7")]
                            ).select("path", "name")


@query("q_delete_by_pattern", f"""
WITH shortcuts AS ({O.SHORTCUTS})
SELECT path, name FROM shortcuts WHERE NOT contains(lower(name), 'red') OR name IS NULL
""")
def q_delete_by_pattern(spark, sf_dir):
    """delete_by_pattern: drop shortcuts whose name contains a pattern, any case."""
    sc = S.part_shortcuts(_t(spark, sf_dir, "part"))
    return Q.delete_by_pattern(sc, "name", "RED").select("path", "name")


@query("q_capacity_filters", f"""
WITH capacities AS ({O.CAPACITIES})
SELECT id, sku FROM capacities WHERE lower(region) = 'region-7' AND state = 'Active'
""")
def q_capacity_filters(spark, sf_dir):
    """search_catalog: filter_equals_ci on region + filter_equals on state."""
    caps = S.capacities(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "part"))
    return Q.search_catalog(caps, [Q.filter_equals_ci("region", "REGION-7"),
                                   Q.filter_equals("state", "Active")]).select("id", "sku")


@query("q_first_match", """
SELECT key, c_custkey, c_name, c_mktsegment FROM (
  SELECT lower(c_mktsegment) AS key, c_custkey, c_name, c_mktsegment,
         row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS rn
  FROM customer) WHERE rn = 1
""")
def q_first_match(spark, sf_dir):
    """first_match: the first customer (by key) of every market segment."""
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return Q.first_match(cust, F.lower("c_mktsegment"), "c_custkey")


@query("q_limit_rows", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25
""")
def q_limit_rows(spark, sf_dir):
    """limit_rows: the 25 customers with the highest balance (a top-k report)."""
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return Q.limit_rows(cust, 25, [F.desc("c_acctbal"), F.asc("c_custkey")])


# --------------------------------------------------------------------------- quality


@query("q_bucket", f"""
WITH capacities AS ({O.CAPACITIES})
SELECT id, sku, CASE WHEN starts_with(sku, 'F') THEN 'Fabric' WHEN starts_with(sku, 'P') THEN 'Premium'
                     WHEN starts_with(sku, 'A') THEN 'Azure' ELSE 'Unknown' END AS tier
FROM capacities
""")
def q_bucket(spark, sf_dir):
    """bucket_by_prefix: pricing tier from the SKU's first letter."""
    caps = S.capacities(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "part"))
    return quality.bucket_by_prefix(caps.select("id", "sku"), "sku", "tier")


@query("q_run_flags", f"""
WITH ops AS ({O.OPERATIONS}),
     req AS (SELECT DISTINCT 'op-' || (event_id * 2) AS id FROM events)
SELECT r.id,
       coalesce(o.status IN ('Running', 'NotStarted'), false) AS running,
       (o.id IS NULL OR o.status IN ('Succeeded', 'Failed')) AS complete,
       coalesce(o.status = 'Succeeded', false) AS succeeded,
       coalesce(o.status = 'Failed', false) AS failed,
       o.percentComplete AS percent, o.code AS error_code, o.msg AS error_detail,
       CASE WHEN o.status = 'Failed' THEN CASE WHEN length(o.msg) > 0 THEN o.msg ELSE 'Operation failed' END END
         AS error_message
FROM req r LEFT JOIN ops o ON r.id = o.id
""")
def q_run_flags(spark, sf_dir):
    """run_state_flags: running/complete/succeeded/failed/percent/error per requested id."""
    ev = _t(spark, sf_dir, "events")
    return quality.run_state_flags(S.events_requested_ops(ev), S.events_operations(ev))


@query("q_runs_to_cancel", """
SELECT 'run-' || event_id AS id FROM events WHERE event_type = 'click'
""")
def q_runs_to_cancel(spark, sf_dir):
    """runs_to_cancel: ids of job runs still in progress."""
    return quality.runs_to_cancel(S.events_job_runs(_t(spark, sf_dir, "events")))


@query("q_validate", f"""
WITH pools AS ({O.POOLS})
SELECT p_partkey, concat_ws('|',
  CASE WHEN name IS NULL OR length(trim(name)) = 0 THEN 'Pool name is required' END,
  CASE WHEN nodeFamily IS NULL OR nodeFamily = '' THEN 'Node family is required' END,
  CASE WHEN nodeSize IS NULL OR nodeSize = '' THEN 'Node size is required' END,
  CASE WHEN noScale THEN 'Auto scale configuration is required' END,
  CASE WHEN noAllocation THEN 'Dynamic executor allocation configuration is required' END,
  CASE WHEN name IS NOT NULL AND NOT (length(trim(name)) > 0 AND length(name) BETWEEN 1 AND 64
         AND regexp_matches(name, '^[a-zA-Z0-9\\-_ ]+$') AND lower(trim(name)) <> 'starter pool')
       THEN 'Invalid pool name' END,
  CASE WHEN minNodeCount < 1 THEN 'Minimum node count must be at least 1' END,
  CASE WHEN maxNodeCount < 1 THEN 'Maximum node count must be at least 1' END,
  CASE WHEN minNodeCount > maxNodeCount THEN 'Minimum node count cannot be greater than maximum node count' END,
  CASE WHEN minExecutors < 1 THEN 'Minimum executors must be at least 1' END,
  CASE WHEN maxExecutors < 1 THEN 'Maximum executors must be at least 1' END,
  CASE WHEN minExecutors > maxExecutors THEN 'Minimum executors cannot be greater than maximum executors' END,
  CASE WHEN (CASE WHEN inactivity <> 0 THEN inactivity ELSE 1440 END)
            NOT IN (30, 60, 90, 120, 150, 240, 360, 480, 720, 1440)
       THEN 'Invalid inactivityMinutesBeforeSleep. Must be one of: 30, 60, 90, 120, 150, 240, 360, 480, 720, 1440' END,
  CASE WHEN (CASE WHEN members <> 0 THEN members ELSE 1 END) NOT BETWEEN 1 AND 7
       THEN 'numberOfMemberGateways must be between 1 and 7' END,
  CASE WHEN length(displayName) > 200 THEN 'displayName must be 200 characters or less' END,
  CASE WHEN NOT regexp_full_match(version, '{quality.SEMVER_PATTERN}') OR length(version) > 16
       THEN 'version is not a valid SchemaVersion' END,
  CASE WHEN NOT regexp_full_match(guid, '{quality.GUID_PATTERN}') THEN 'guid is not a valid Guid' END,
  CASE WHEN NOT regexp_full_match(workload, '{quality.WORKLOAD_NAME_PATTERN}') OR length(workload) > 32
       THEN 'workload is not a valid WorkloadName' END,
  CASE WHEN NOT regexp_full_match(itemType, '{quality.TYPE_NAME_PATTERN}') OR length(itemType) > 64
       THEN 'itemType is not a valid TypeName' END,
  CASE WHEN NOT regexp_full_match(jobType, '{quality.JOB_TYPE_NAME_PATTERN}') OR length(jobType) > 96
       THEN 'jobType is not a valid JobTypeName' END
) AS errors
FROM pools
""")
def q_validate(spark, sf_dir):
    """validate_rows: pool, gateway and manifest-pattern rules; messages joined with '|'."""
    pools = S.part_pools(_t(spark, sf_dir, "part"))
    rules = (quality.pool_rules() + quality.gateway_rules()
             + quality.manifest_rules({"version": "SchemaVersion", "guid": "Guid", "workload": "WorkloadName",
                                       "itemType": "TypeName", "jobType": "JobTypeName"}))
    out = quality.validate_rows(pools, rules)
    return out.select("p_partkey", F.array_join("errors", "|").alias("errors"))


@query("q_validate_chain", f"""
WITH {O.MANIFESTS}
SELECT i.package, i.itemFile AS subject,
       'Non matching WorkloadName between WorkloadManifest.xml and ' || i.itemFile AS message
FROM items i LEFT JOIN packages p ON i.package = p.package
WHERE lower(i.itemWorkloadName) IS DISTINCT FROM lower(p.workloadName)
UNION ALL
SELECT package, typeName, 'Item name''s prefix should be WorkloadName for item ' || coalesce(typeName, '')
FROM items WHERE NOT coalesce(starts_with(typeName, itemWorkloadName || '.'), false)
UNION ALL
SELECT j.package, j.jobName, 'Job type name''s prefix should be ItemName for jobType ' || coalesce(j.jobName, '')
FROM jobs j LEFT JOIN items i ON j.package = i.package AND j.itemFile = i.itemFile
WHERE NOT coalesce(starts_with(j.jobName, i.typeName || '.'), false)
""")
def q_validate_chain(spark, sf_dir):
    """validate_prefix_chain: workload → item type → job type naming rule, as violations."""
    packages, items, jobs = S.manifest_tables(
        _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"))
    return quality.validate_prefix_chain(packages, items, jobs)


# --------------------------------------------------------------------------- paths


_PAGE_LISTING_CTES = f"""
WITH page_paths AS ({O.PAGE_PATHS}),
     listing AS ({O.PAGE_LISTING}),
     parts AS (SELECT string_split(name, '/')[-1] AS name,
                      regexp_replace(name, '^[^/]*/?', '') AS relativePath, isDirectory
               FROM listing)
"""


@query("q_path_parts", _PAGE_LISTING_CTES + """
SELECT 'Files' AS rootFolder, name, relativePath, isDirectory, CAST(false AS BOOLEAN) AS isShortcut FROM parts
""")
def q_path_parts(spark, sf_dir):
    """path_parts: name and item-relative path of every entry below pages/Files."""
    return P.path_parts(S.pages_listing(_t(spark, sf_dir, "pages")))


@query("q_list_directory", _PAGE_LISTING_CTES + """
SELECT 'Files' AS rootFolder, name, relativePath, isDirectory, CAST(false AS BOOLEAN) AS isShortcut
FROM parts WHERE len(string_split(relativePath, '/')) = 2
""")
def q_list_directory(spark, sf_dir):
    """list_directory: the entries directly inside pages/Files (one per host)."""
    return P.list_directory(S.pages_listing(_t(spark, sf_dir, "pages")), "pages", "Files")


@query("q_tree", _PAGE_LISTING_CTES + """
, nodes AS (SELECT relativePath, name, isDirectory,
                   list_filter(string_split(relativePath, '/'), lambda s: s <> '') AS segs FROM parts)
SELECT n.relativePath, n.name, n.isDirectory,
       CASE WHEN d.relativePath IS NOT NULL THEN d.relativePath END AS parentPath,
       CAST(len(n.segs) AS INTEGER) AS depth
FROM nodes n LEFT JOIN (SELECT relativePath FROM parts WHERE isDirectory) d
  ON len(n.segs) > 1 AND d.relativePath = array_to_string(n.segs[1:len(n.segs) - 1], '/')
""")
def q_tree(spark, sf_dir):
    """build_tree: parent folder (or root) of every entry, siblings folders-first by name."""
    files = P.path_parts(S.pages_listing(_t(spark, sf_dir, "pages")))
    return P.build_tree(files)


_TOUR_CTES = _PAGE_LISTING_CTES.replace("WITH page_paths", "WITH RECURSIVE page_paths") + """
, nodes AS (SELECT p.relativePath AS id, NOT p.isDirectory AS file, p.name, d.relativePath AS parent
            FROM parts p LEFT JOIN (SELECT relativePath FROM parts WHERE isDirectory) d
              ON d.relativePath = regexp_extract(p.relativePath, '^(.*)/[^/]*$', 1)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY file, name, id) AS r FROM nodes),
  walk(id, depth, trail) AS (
    SELECT id, 1, lpad(CAST(r AS VARCHAR), 9, '0') FROM placed WHERE parent IS NULL
    UNION ALL SELECT c.id, w.depth + 1, w.trail || '/' || lpad(CAST(c.r AS VARCHAR), 9, '0')
    FROM placed c JOIN walk w ON c.parent = w.id),
  pre AS (SELECT id, depth, trail, row_number() OVER (ORDER BY trail) - 1 AS p FROM walk),
  sized AS (SELECT a.id, a.depth, a.p, count(b.id) AS n FROM pre a LEFT JOIN pre b ON starts_with(b.trail, a.trail || '/') GROUP BY ALL),
  tour AS (SELECT id, 2 * p - (depth - 1) AS enter, 2 * p - (depth - 1) + 2 * n + 1 AS leave, depth, n AS n_below FROM sized)
"""


def _page_tour(spark, sf_dir):
    files = P.path_parts(S.pages_listing(_t(spark, sf_dir, "pages")))
    edges = P.build_tree(files, ordered=False)
    return H.nested_sets(edges, [~F.col("isDirectory"), "name"], "relativePath", "parentPath")


@query("q_nested_sets", _TOUR_CTES + """
SELECT id AS relativePath, CAST(enter AS BIGINT) AS enter, CAST(leave AS BIGINT) AS leave,
       CAST(depth AS INTEGER) AS depth, CAST(n_below AS BIGINT) AS n_below FROM tour
""")
def q_nested_sets(spark, sf_dir):
    """nested_sets: entry and exit number of every page and folder, in the order of build_tree."""
    return _page_tour(spark, sf_dir).withColumnRenamed("id", "relativePath")


@query("q_subtree_range", _TOUR_CTES + """
, root AS (SELECT min(id) AS id FROM nodes WHERE parent IS NOT NULL)
SELECT t.id AS relativePath, CAST(t.enter AS BIGINT) AS enter FROM tour t
WHERE t.id = regexp_extract((SELECT id FROM root), '^([^/]*/[^/]*)', 1)
   OR starts_with(t.id, regexp_extract((SELECT id FROM root), '^([^/]*/[^/]*)', 1) || '/')
""")
def q_subtree_range(spark, sf_dir):
    """subtree_range: the pages and folders below the first host, as a range of numbers."""
    tour = _page_tour(spark, sf_dir)
    first = tour.where(F.col("depth") > 1).agg(F.min("id")).first()[0]
    return H.subtree_range(tour, "/".join((first or "").split("/")[:2])).select(F.col("id").alias("relativePath"), "enter")


@query("q_expand_shortcut", _PAGE_LISTING_CTES + """
, hosts AS (SELECT DISTINCT string_split(name, '/')[3] AS host FROM listing)
SELECT 'Files/mirror/' || h.host AS shortcutPath, string_split(l.name, '/')[-1] AS name,
       'Files/mirror/' || h.host || '/' || substring(l.name, length('pages/Files/' || h.host) + 2) AS relativePath,
       l.isDirectory, CAST(NULL AS BOOLEAN) AS isShortcut
FROM listing l JOIN hosts h ON starts_with(l.name, 'pages/Files/' || h.host || '/')
""")
def q_expand_shortcut(spark, sf_dir):
    """expand_shortcut: a mirror shortcut per host, its contents re-rooted beneath it."""
    pages = _t(spark, sf_dir, "pages")
    listing = S.pages_listing(pages).drop("isShortcut")
    hosts = pages.select(S.url_host().alias("host")).distinct()
    shortcuts = hosts.select(F.concat(F.lit("Files/mirror/"), "host").alias("shortcutPath"),
                             F.concat(F.lit("pages/Files/"), "host").alias("targetRoot"))
    return P.expand_shortcut(listing, shortcuts)


@query("q_discover_tables", f"""
WITH docs_listing AS ({O.DOCS_LISTING})
{O.DOCS_TABLES}
""")
def q_discover_tables(spark, sf_dir):
    """discover_tables: _delta_log folders and ADLS shortcuts in a Tables/ listing."""
    return P.discover_tables(S.docs_listing(_t(spark, sf_dir, "documents")))


@query("q_tables_by_schema", f"""
WITH docs_listing AS ({O.DOCS_LISTING}), t AS ({O.DOCS_TABLES})
SELECT t.schema, t.name, t.relativePath, c.n_tables
FROM t JOIN (SELECT schema, count(*) AS n_tables FROM t GROUP BY schema) c
  ON t.schema IS NOT DISTINCT FROM c.schema
""")
def q_tables_by_schema(spark, sf_dir):
    """tables_by_schema: discovered tables under their schema, with per-schema counts."""
    return P.tables_by_schema(P.discover_tables(S.docs_listing(_t(spark, sf_dir, "documents"))))


# --------------------------------------------------------------------------- hierarchy

_GEO_CTES = f"""
WITH RECURSIVE folders AS ({O.GEO_FOLDERS}),
walk(id, path, depth) AS (
  SELECT id, displayName, 1 FROM folders f
  WHERE parentFolderId IS NULL OR parentFolderId NOT IN (SELECT id FROM folders)
  UNION ALL
  SELECT f.id, w.path || '/' || f.displayName, w.depth + 1 FROM folders f JOIN walk w ON f.parentFolderId = w.id)
"""


def _geo(spark, sf_dir):
    return S.geo_folders(_t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation"),
                         _t(spark, sf_dir, "customer"))


@query("q_folder_path", _GEO_CTES + "SELECT id, path, depth FROM walk")
def q_folder_path(spark, sf_dir):
    """folder_path: names from the root to every folder of region → nation → customer."""
    fp = H.folder_path(_geo(spark, sf_dir))
    return fp.select("id", F.array_join("path", "/").alias("path"), "depth")


@query("q_folder_subtree", f"""
WITH RECURSIVE folders AS ({O.GEO_FOLDERS}),
sub(id, depth) AS (
  SELECT id, 1 FROM folders WHERE parentFolderId IS NULL
  UNION ALL SELECT f.id, s.depth + 1 FROM folders f JOIN sub s ON f.parentFolderId = s.id)
SELECT f.id, f.displayName, s.depth FROM sub s JOIN folders f ON f.id = s.id
""")
def q_folder_subtree(spark, sf_dir):
    """folder_subtree (recursive) from the workspace root: every folder with its depth."""
    return H.folder_subtree(_geo(spark, sf_dir)).select("id", "displayName", "depth")


@query("q_folder_children", f"""
WITH folders AS ({O.GEO_FOLDERS})
SELECT f.id, f.displayName, f.parentFolderId AS root, 1 AS depth FROM folders f
WHERE f.parentFolderId IN (SELECT id FROM folders WHERE parentFolderId IS NULL)
""")
def q_folder_children(spark, sf_dir):
    """folder_subtree (direct children only) of every top-level folder."""
    folders = _geo(spark, sf_dir)
    tops = H.folder_subtree(folders, recursive=False)
    return H.folder_subtree(folders, tops.select("id"), recursive=False).select(
        "id", "displayName", "root", "depth")


@query("q_empty_folders", """
SELECT 'c' || c_custkey AS id FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL SELECT 'o' || o_orderkey FROM orders
""")
def q_empty_folders(spark, sf_dir):
    """empty_folders: customer folders without order folders, and every order folder."""
    f = S.order_folders(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"))
    return H.empty_folders(f).select("id")


@query("q_ensure_folders", f"""
WITH req AS (SELECT {O.PAGE_DIR_SEGMENTS} AS s FROM pages),
     https AS (SELECT {O.PAGE_DIR_SEGMENTS} AS s FROM pages WHERE regexp_extract(url, '^([A-Za-z]+)://', 1) = 'https'),
     want AS (SELECT DISTINCT s[1:k] AS p FROM req, unnest(range(1, len(s) + 1)) AS u(k)),
     have AS (SELECT DISTINCT s[1:k] AS p FROM https, unnest(range(1, len(s) + 1)) AS u(k))
SELECT array_to_string(p, '/') AS pathText, p[len(p)] AS displayName
FROM want WHERE p NOT IN (SELECT p FROM have)
""")
def q_ensure_folders(spark, sf_dir):
    """ensure_folder_paths: folders to create so every page's folder path exists, given
    the folders of the https pages."""
    pages = _t(spark, sf_dir, "pages")
    created, _ = H.ensure_folder_paths(S.https_page_folders(pages), S.page_folder_requests(pages))
    return created.select("pathText", "displayName")


@query("q_move_nodes", f"""
WITH RECURSIVE folders AS ({O.GEO_FOLDERS}), asked AS ({O.GEO_MOVES}),
moves AS (SELECT * FROM asked WHERE target IS NULL OR target IN (SELECT id FROM folders)),
applied AS (SELECT f.id, CASE WHEN m.id IS NOT NULL THEN m.target ELSE f.parentFolderId END AS parent
            FROM folders f LEFT JOIN moves m ON f.id = m.id),
reach(id) AS (SELECT id FROM applied WHERE parent IS NULL OR parent NOT IN (SELECT id FROM applied)
              UNION ALL SELECT a.id FROM applied a JOIN reach r ON a.parent = r.id),
ok AS (SELECT m.* FROM moves m WHERE m.id IN (SELECT id FROM reach))
SELECT f.id, f.displayName,
       CASE WHEN ok.id IS NOT NULL THEN ok.target ELSE f.parentFolderId END AS parentFolderId,
       ok.id IS NOT NULL AS moved,
       (f.id IN (SELECT id FROM asked) AND ok.id IS NULL) AS rejected
FROM folders f LEFT JOIN ok ON f.id = ok.id
""")
def q_move_nodes(spark, sf_dir):
    """move_nodes: re-parent folders; moves that would form a cycle are rejected."""
    folders = _geo(spark, sf_dir)
    moves = S.geo_moves(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"))
    return H.move_nodes(folders, moves)


# --------------------------------------------------------------------------- joins, links


_RESOLVED_CTES = f"""
WITH tags_last AS ({O.TAGS_LAST}), tag_requests AS ({O.TAG_REQUESTS}), resolved AS ({O.RESOLVED})
"""


def _resolved(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    res = L.resolve_names(S.part_tags(part), S.tag_requests(_t(spark, sf_dir, "lineitem"), part))
    return res.withColumnRenamed("match_id", "tagId")


@query("q_resolve_names", _RESOLVED_CTES + "SELECT itemId, name, tagId, found FROM resolved")
def q_resolve_names(spark, sf_dir):
    """resolve_names: tag names per line item, case-insensitive, last duplicate wins."""
    return _resolved(spark, sf_dir).select("itemId", "name", "tagId", "found")


@query("q_apply_links", _RESOLVED_CTES + """
SELECT DISTINCT itemId, tagId FROM resolved WHERE found AND (l_returnflag = 'R' OR l_linestatus = 'O')
""")
def q_apply_links(spark, sf_dir):
    """apply_links: links of returned items plus those of open ones, each pair once."""
    res = materialize(_resolved(spark, sf_dir).where("found").select("itemId", "tagId", "l_returnflag", "l_linestatus"))
    return L.apply_links(res.where("l_returnflag = 'R'"), res.where("l_linestatus = 'O'"))


@query("q_remove_links", _RESOLVED_CTES + """
SELECT DISTINCT itemId, tagId FROM resolved WHERE found
EXCEPT SELECT itemId, tagId FROM resolved WHERE found AND l_linestatus = 'F'
""")
def q_remove_links(spark, sf_dir):
    """remove_links: every resolved link except those of finished line items."""
    res = materialize(_resolved(spark, sf_dir).where("found").select("itemId", "tagId", "l_linestatus"))
    links = res.select("itemId", "tagId").distinct()
    return L.remove_links(links, res.where(F.col("l_linestatus") == "F"))


_GATEWAY_CTES = """
WITH gw AS (SELECT 'gw-' || n_nationkey AS id, n_name AS displayName FROM nation),
     asg AS (SELECT 'as-' || s_suppkey AS assignmentId, 'gw-' || s_nationkey AS resourceId,
                    'p-' || (s_suppkey % 7) AS principalId,
                    CASE WHEN s_acctbal > 5000 THEN 'Admin' ELSE 'Member' END AS role FROM supplier)
"""


@query("q_assignments", _GATEWAY_CTES + """
SELECT a.principalId, g.id, g.displayName, a.role, a.assignmentId FROM asg a JOIN gw g ON a.resourceId = g.id
""")
def q_assignments(spark, sf_dir):
    """assignments_for_principal: every principal's gateways with the assignment held."""
    return L.assignments_for_principal(S.nation_gateways(_t(spark, sf_dir, "nation")),
                                       S.supplier_assignments(_t(spark, sf_dir, "supplier")))


@query("q_gateway_admins", _GATEWAY_CTES + """
SELECT DISTINCT a.principalId, g.id FROM asg a JOIN gw g ON a.resourceId = g.id WHERE a.role = 'Admin'
""")
def q_gateway_admins(spark, sf_dir):
    """assignments_for_principal, admin check: (principal, gateway) pairs with Admin role."""
    return L.admins(S.nation_gateways(_t(spark, sf_dir, "nation")),
                    S.supplier_assignments(_t(spark, sf_dir, "supplier")))


@query("q_missing_ids", """
SELECT DISTINCT 'ord-' || (o_orderkey * 3) AS id FROM orders
EXCEPT SELECT 'ord-' || o_orderkey FROM orders
""")
def q_missing_ids(spark, sf_dir):
    """missing_ids: requested job ids (3 × order key) that have no row."""
    orders = _t(spark, sf_dir, "orders")
    req = orders.select(F.concat(F.lit("ord-"), (F.col("o_orderkey") * 3).cast("string")).alias("id"))
    have = orders.select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("id"))
    return L.missing_ids(req, have)


@query("q_shared_paths", f"""
WITH shares AS ({O.SHARES}),
     live AS (SELECT DISTINCT unnest(paths) AS path FROM shares WHERE status IN ('Active', 'Pending')),
     p AS (SELECT 'cust/' || c_custkey AS path FROM customer
           UNION ALL SELECT DISTINCT 'prio/' || o_orderpriority FROM orders)
SELECT p.path, live.path IS NOT NULL AS is_shared FROM p LEFT JOIN live ON p.path = live.path
""")
def q_shared_paths(spark, sf_dir):
    """shared_paths: is each customer / priority path in an active or pending share?"""
    orders = _t(spark, sf_dir, "orders")
    paths = (_t(spark, sf_dir, "customer").select(F.concat(F.lit("cust/"), F.col("c_custkey").cast("string")).alias("path"))
             .unionByName(orders.select(F.concat(F.lit("prio/"), "o_orderpriority").alias("path")).distinct()))
    return L.shared_paths(paths, S.orders_shares(orders))


@query("q_revoke", f"""
WITH shares AS ({O.SHARES})
SELECT s.id, CASE WHEN o.o_totalprice > 400000 THEN 'Revoked' ELSE s.status END AS status
FROM shares s JOIN orders o ON s.o_orderkey = o.o_orderkey
""")
def q_revoke(spark, sf_dir):
    """revoke_by_ids: revoke the shares of orders above 400,000."""
    orders = _t(spark, sf_dir, "orders")
    ids = orders.where(F.col("o_totalprice") > 400000).select(
        F.concat(F.lit("share-"), F.col("o_orderkey").cast("string")).alias("id"))
    return L.revoke_by_ids(S.orders_shares(orders), ids).select("id", "status")


@query("q_accept_share", f"""
WITH shares AS ({O.SHARES}),
     d AS (SELECT id, itemId, workspaceId, unnest(paths) AS p, generate_subscripts(paths, 1) AS pos
           FROM shares WHERE status = 'Pending')
SELECT itemId, workspaceId, 'Files/shared' AS path, replace(p, '/', '_') AS name, p AS sharedName,
       CASE WHEN starts_with(p, 'cust/') THEN 'Folder' ELSE 'Table' END AS type
FROM d
""")
def q_accept_share(spark, sf_dir):
    """accept_share: shortcuts created when every pending share invitation is accepted."""
    shares = S.orders_shares(_t(spark, sf_dir, "orders"))
    return L.accept_share(S.share_path_details(shares), S.share_accept_requests(shares))


@query("q_patch_rows", """
SELECT 'sch-' || c_custkey AS id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NOT (c_acctbal > 0) ELSE c_acctbal > 0 END AS enabled,
       CASE WHEN c_nationkey % 3 = 0 THEN 'Weekly' ELSE 'Daily' END AS cfg_type,
       CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS cfg_interval
FROM customer
""")
def q_patch_rows(spark, sf_dir):
    """patch_rows: toggle ``enabled`` on some schedules and reconfigure others, some both."""
    cust = _t(spark, sf_dir, "customer")
    out = L.patch_rows(S.customer_schedules(cust), S.schedule_toggles(cust), "id", order_col="seq")
    return out.select("id", "enabled", F.col("configuration.type").alias("cfg_type"),
                      F.col("configuration.interval").alias("cfg_interval"))


_SHORTCUT_BATCH = f"""
WITH sc AS ({O.SHORTCUTS}),
     existing AS (SELECT path, name, p_partkey FROM sc WHERE p_size <= 25
                  UNION ALL SELECT path, name || '_' || (p_partkey + CASE WHEN p_size = 50 THEN 1000000 ELSE 0 END), p_partkey
                  FROM sc WHERE p_size IN (24, 50)),
     requests AS (SELECT p_partkey AS req_id, path, name, p_partkey FROM sc WHERE p_size >= 20
                  UNION ALL SELECT p_partkey + 1000000, path, name, p_partkey FROM sc WHERE p_size >= 45),
     r AS (SELECT q.*, min(req_id) OVER (PARTITION BY q.path, q.name) AS first,
                  EXISTS (SELECT 1 FROM existing e WHERE e.path = q.path AND e.name = q.name) AS ex,
                  q.name || '_' || req_id || CASE WHEN EXISTS (
                    SELECT 1 FROM existing e WHERE e.path = q.path AND e.name = q.name || '_' || q.req_id) THEN '_2' ELSE '' END AS fresh
           FROM requests q)
"""


@query("q_shortcut_policy", _SHORTCUT_BATCH + """
SELECT 'Abort' AS policy, req_id, path, name,
       CASE WHEN ex OR req_id <> first THEN 'Conflict' ELSE 'Created' END AS status FROM r
UNION ALL SELECT 'GenerateUniqueName', req_id, path,
       CASE WHEN ex OR req_id <> first THEN fresh ELSE name END,
       CASE WHEN ex OR req_id <> first THEN 'CreatedWithNewName' ELSE 'Created' END FROM r
UNION ALL SELECT 'CreateOrOverwrite', req_id, path, name,
       CASE WHEN req_id <> first THEN 'Duplicate' WHEN ex THEN 'Overwritten' ELSE 'Created' END FROM r
UNION ALL SELECT 'OverwriteOnly', req_id, path, name,
       CASE WHEN NOT ex THEN 'NotFound' WHEN req_id <> first THEN 'Duplicate' ELSE 'Overwritten' END FROM r
""")
def q_shortcut_policy(spark, sf_dir):
    """apply_shortcut_requests: request outcomes under each of the four conflict policies."""
    existing, reqs = S.shortcut_batch(_t(spark, sf_dir, "part"))
    known = materialize(L.classify_requests(existing, reqs))
    outs = [L.apply_shortcut_requests(existing, reqs, p, classified=known)[1].withColumn("policy", F.lit(p))
            for p in L.CONFLICT_POLICIES]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out.select("policy", "req_id", "path", "name", "status")


@query("q_shortcut_apply", _SHORTCUT_BATCH + """
SELECT path, name, 'part-' || p_partkey AS of_part FROM existing
UNION ALL SELECT path, CASE WHEN ex OR req_id <> first THEN fresh ELSE name END, 'part-' || p_partkey FROM r
""")
def q_shortcut_apply(spark, sf_dir):
    """apply_shortcut_requests: the shortcut table, with its targets, after a GenerateUniqueName batch."""
    existing, reqs = S.shortcut_batch(_t(spark, sf_dir, "part"), mark=True)
    out = L.apply_shortcut_requests(existing, reqs, "GenerateUniqueName")[0]
    return out.select("path", "name", F.col("target").alias("of_part"))


# --------------------------------------------------------------------------- nested


@query("q_pack_unpack", """
SELECT 'ev-' || event_id AS id,
       CASE WHEN value > 50 THEN upper(event_type) ELSE event_type END AS type,
       CASE WHEN value > 50 THEN 'E' || event_id ELSE 'event ' || event_id END AS displayName,
       CASE WHEN value > 50 THEN 'from platform' END AS description,
       CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       1 AS n_additional, 'notes.txt' AS extra_paths
FROM events
""")
def q_pack_unpack(spark, sf_dir):
    """pack_definitions then unpack_definitions: definitions, metadata overrides, extra
    parts, and the default for a payload that is not base64."""
    items = S.events_items(_t(spark, sf_dir, "events"))
    defs = S.corrupt_error_payloads(N.pack_definitions(items, keep=("type",)))
    out = N.unpack_definitions(items.drop("definition", "additionalParts"), defs,
                               default_definition='{"k": -1}')
    return out.select(
        "id", "type", "displayName", "description",
        F.try_variant_get("definition", "$.k", "bigint").alias("k"),
        F.size("additionalParts").alias("n_additional"),
        F.array_join(F.transform("additionalParts", lambda p: p["path"]), ",").alias("extra_paths"))


@query("q_normalize_parts", """
SELECT event_id,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 1 END AS n_parts,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL
            WHEN event_type = 'view' THEN 'InlineBase64' ELSE 'Custom' END AS payload_type,
       CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events
""")
def q_normalize_parts(spark, sf_dir):
    """normalize_parts: parse definition responses, default payloadType, null when invalid."""
    out = N.normalize_parts(S.events_responses(_t(spark, sf_dir, "events")))
    first = F.try_element_at(F.col("definition.parts"), F.lit(1))
    return out.select(
        "event_id", F.size("definition.parts").alias("n_parts"),
        first["payloadType"].alias("payload_type"),
        F.try_variant_get(F.try_parse_json(F.try_validate_utf8(
            F.try_to_binary(first["payload"], F.lit("base64")).cast("string"))), "$.k", "bigint").alias("k"))


@query("q_page_dumps", """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn % 3 = 1
""")
def q_page_dumps(spark, sf_dir):
    """load_page_dumps: items of value-envelope, bare-array and single-object pages."""
    items = N.load_page_dumps(S.conversation_pages(_t(spark, sf_dir, "conversations")))
    return items.select(
        F.variant_get("item", "$.conv_id", "bigint").alias("conv_id"),
        F.variant_get("item", "$.turn", "bigint").alias("turn"),
        F.variant_get("item", "$.role", "string").alias("role"),
        F.variant_get("item", "$.text", "string").alias("text"))


@query("q_explode_rules", O.with_pages_access("""
SELECT 'site:' || host AS role_id, 0 AS rule_idx, 'Permit' AS effect, 0 AS perm_idx,
       'Action' AS attributeName, 'Read' AS value FROM (SELECT DISTINCT host FROM page_hosts)
UNION ALL SELECT 'site:' || host, 0, 'Permit', 1, 'Path', 'pages/Files/' || host || '/en'
          FROM (SELECT DISTINCT host FROM page_hosts)
UNION ALL SELECT 'site:' || host, 0, 'Permit', 1, 'Path', 'pages/Files/' || host || '/fr'
          FROM (SELECT DISTINCT host FROM page_hosts)
UNION ALL SELECT 'site:' || host, 0, 'Permit', 2, 'Path', 'pages/Files/' FROM (SELECT DISTINCT host FROM page_hosts)
UNION ALL SELECT DISTINCT 'label:' || split_part(host, '.', 1), 0, 'Permit', 0, 'Path',
       'pages/Files/' || split_part(host, '.', 1) FROM page_hosts
UNION ALL SELECT DISTINCT 'label:' || split_part(host, '.', 1), 1, 'Permit', 0, 'Action', 'Read' FROM page_hosts
UNION ALL SELECT DISTINCT 'scheme:' || scheme, 0, 'Permit', 0, 'Path',
       CASE WHEN scheme = 'https' THEN '*' ELSE '' END FROM page_hosts
"""))
def q_explode_rules(spark, sf_dir):
    """explode_rules: role → rule → permission → value, with positions."""
    r = access.explode_rules(S.pages_roles(_t(spark, sf_dir, "pages")))
    return r.select("role_id", "rule_idx", "effect", "perm_idx", "attributeName", "value")


# --------------------------------------------------------------------------- sources, sinks


@query("q_csv_to_table", """
SELECT o_orderkey, 'a ' || chr(10) || o_orderpriority AS "name|r", CAST(o_custkey % 5 AS INTEGER) AS part
FROM orders WHERE o_custkey % 5 <> 0
""")
def q_csv_to_table(spark, sf_dir):
    """csv_to_table: orders exported as '|'-separated CSV files per fifth of the customers; the files of
    fifth 0 also carry one row with a non-numeric key, and a copy of fifth 1 has its columns in
    another order, so these files are skipped whole. Values hold a line break inside quotes and a
    column's name the delimiter."""
    orders = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("a \n"), "o_orderpriority").alias("name|r"), (F.col("o_custkey") % 5).cast("int").alias("part"))
    root = SRC.staging_path(spark, "csv-src")
    (orders.where("part <> 0").withColumn("r", F.col("part"))
     .write.partitionBy("r").option("sep", "|").option("header", True).csv(root))
    broken = orders.where("part = 0").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("x"), F.lit("0")).alias("value"))
    extra = spark.createDataFrame([('o_orderkey|"name|r"|part',), ("x|BROKEN|0",)], "value string")
    extra.coalesce(1).unionByName(broken).coalesce(1).write.text(f"{root}/r=0")
    (orders.where("part = 1").select("part", "name|r", "o_orderkey")
     .write.option("sep", "|").option("header", True).csv(f"{root}/swapped"))
    return SRC.csv_to_table(spark, root, "o_orderkey bigint, `name|r` string, part int", delimiter="|", multi_line=True)


@query("q_write_rows", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM documents
""")
def q_write_rows(spark, sf_dir):
    """write_text_rows then read_text_files: every document to its own file and back."""
    docs = _t(spark, sf_dir, "documents")
    root = SRC.staging_path(spark, "docs-out")
    SRC.write_text_rows(docs.select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content")), root)
    back = SRC.read_text_files(spark, root)
    return back.select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
                       F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query("q_write_binary", """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes, sha256(html) AS digest FROM pages
""")
def q_write_binary(spark, sf_dir):
    """write_binary_rows then read_binary_files: every page's HTML as base64, to bytes and back."""
    pages = _t(spark, sf_dir, "pages")
    root = SRC.staging_path(spark, "pages-out")
    SRC.write_binary_rows(pages.select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        b64_encode(F.encode("html", "UTF-8")).alias("payload")), root)
    back = SRC.read_binary_files(spark, root)
    return back.select(F.regexp_extract("path", r"/(\d+)\.html$", 1).cast("bigint").alias("page_id"),
                       F.col("length").alias("n_bytes"), F.sha2(F.unbase64("payload"), 256).alias("digest"))


@query("q_mount", f"""
WITH sc AS ({O.SHORTCUTS})
SELECT name, kind,
  CASE kind
    WHEN 'OneLake' THEN 'lake://' || ol_workspace || '/' || ol_item || '/' || ol_path
    WHEN 'AmazonS3' THEN 's3a://bucket' || size || sub
    WHEN 'AdlsGen2' THEN 'abfss://data@acct' || size || '.dfs.core.windows.net/' || substring(sub, 2)
    WHEN 'GoogleCloudStorage' THEN 'gs://gcs' || size || sub
    WHEN 'S3Compatible' THEN 's3a://b' || size || sub
    WHEN 'AzureBlobStorage' THEN 'wasbs://data@blob' || size || '.blob.core.windows.net/' || substring(sub, 2)
  END AS uri
FROM sc
""")
def q_mount(spark, sf_dir):
    """shortcut_uri, the URI rule mount_shortcuts reads through: every shortcut target's
    storage URI over all eight kinds (null for the two without storage)."""
    sc = S.part_shortcuts(_t(spark, sf_dir, "part"))
    return sc.select("name", F.col("target.type").alias("kind"), shortcut_uri("target").alias("uri"))


@query("q_roles_for_member", O.with_pages_access("""
, ids AS (SELECT DISTINCT 'u-' || role AS objectId FROM conversations
          UNION SELECT DISTINCT 'u-' || scheme FROM page_hosts)
SELECT DISTINCT m.objectId, m.role_id FROM page_role_members m JOIN ids ON m.objectId = ids.objectId
"""))
def q_roles_for_member(spark, sf_dir):
    """roles_for_member: roles listing each asked-for identity (chat roles and URL schemes)."""
    pages = _t(spark, sf_dir, "pages")
    ids = (_t(spark, sf_dir, "conversations").select(F.concat(F.lit("u-"), "role").alias("objectId"))
           .unionByName(pages.select(F.concat(F.lit("u-"), S.url_scheme()).alias("objectId"))))
    return access.roles_for_member(S.pages_roles(pages), ids)


@query("q_roles_for_path", O.with_pages_access("""
SELECT DISTINCT role_id, path FROM page_grants
"""))
def q_roles_for_path(spark, sf_dir):
    """roles_for_path: the roles that open each page."""
    pages = _t(spark, sf_dir, "pages")
    files = S.pages_files(pages).select(F.col("name").alias("path"))
    return access.roles_for_path(files, S.pages_roles(pages))


@query("q_access_check", O.with_pages_access("""
, ask AS (SELECT DISTINCT 'u-' || split_part(regexp_extract(p.url, '^[A-Za-z]+://([^/?#]*)', 1), '.', 1) AS objectId, q.path
          FROM pages p JOIN page_paths q ON p.page_id = q.page_id),
  given AS (SELECT m.objectId, g.path, list_sort(list(DISTINCT g.role_id)) AS roles
            FROM page_role_members m JOIN page_grants g ON m.role_id = g.role_id GROUP BY 1, 2)
SELECT a.objectId, a.path, coalesce(array_to_string(g.roles, '|'), '') AS roles
FROM ask a LEFT JOIN given g ON a.objectId = g.objectId AND a.path = g.path
"""))
def q_access_check(spark, sf_dir):
    """access_check (the access matrix for asked-for pairs): may the user of a page's host open that page, and
    through which roles?"""
    pages = _t(spark, sf_dir, "pages")
    files = S.pages_files(pages).select(F.col("name").alias("path"))
    ask = pages.select(F.concat(F.lit("u-"), F.split_part(S.url_host(), F.lit("."), F.lit(1))).alias("objectId"),
                       S.page_path().alias("path"))
    out = access.access_check(ask.join(files, "path", "left_semi"), S.pages_roles(pages))
    return out.select("objectId", "path", F.array_join("roles", "|").alias("roles"))


@query("q_ensure_resolved", f"""
WITH req AS (SELECT page_id, {O.PAGE_DIR_SEGMENTS} AS s FROM pages),
     https AS (SELECT {O.PAGE_DIR_SEGMENTS} AS s FROM pages WHERE regexp_extract(url, '^([A-Za-z]+)://', 1) = 'https'),
     have AS (SELECT DISTINCT s[1:k] AS p FROM https, unnest(range(1, len(s) + 1)) AS u(k))
SELECT page_id AS request, CASE WHEN s IN (SELECT p FROM have) THEN array_to_string(s, '/')
       ELSE 'folder-' || sha256(CAST(to_json(s) AS VARCHAR)) END AS folderId
FROM req
""")
def q_ensure_resolved(spark, sf_dir):
    """ensure_folder_paths: the folder, found or created, that each page's path resolves to."""
    pages = _t(spark, sf_dir, "pages")
    _, resolved = H.ensure_folder_paths(S.https_page_folders(pages), S.page_folder_requests(pages))
    return resolved.select("request", "folderId")


@query("q_mount_read", """
SELECT folder || (c_nationkey % 5) AS shortcutPath, 'nations' AS shortcutName, c_custkey, c_name
FROM customer, (VALUES ('Files/region'), ('Files/again')) AS f(folder)
""")
def q_mount_read(spark, sf_dir):
    """mount_shortcuts: customers written as one folder per fifth of the nations, read back through
    two same-named shortcuts per fifth in different folders."""
    root = SRC.staging_path(spark, "mounted")
    customer = _t(spark, sf_dir, "customer")
    customer.select("c_custkey", "c_name", (F.col("c_nationkey") % 5).alias("r")).write.partitionBy("r").parquet(root)
    at = root if root.startswith(("/", "file:")) else f"/{root}"
    shortcuts = S.region_shortcuts(_t(spark, sf_dir, "region"), _t(spark, sf_dir, "part"), at)
    return SRC.mount_shortcuts(spark, shortcuts).select("shortcutPath", "shortcutName", "c_custkey", "c_name")


# --------------------------------------------------------------------------- shortcuts below shortcuts


_MOUNT_CTES = f"""
WITH RECURSIVE page_paths AS ({O.PAGE_PATHS}),
  hosts AS (SELECT DISTINCT string_split(path, '/')[3] AS host FROM page_paths),
  mounts AS (SELECT 'pages/Files/m1/' || host AS mount, 'pages/Files/' || host AS target FROM hosts
             UNION ALL VALUES ('pages/Files/m2', 'pages/Files/m1'), ('pages/Files/m3/deep', 'pages/Files/m2'),
                              ('pages/Files/loop/a', 'pages/Files/loop/b/x'), ('pages/Files/loop/b', 'pages/Files/loop/a')),
"""


@query("q_resolve_shortcuts", _MOUNT_CTES + """
  asked AS (SELECT replace(path, 'pages/Files/', p) AS path FROM page_paths,
            (VALUES ('pages/Files/m3/deep/'), ('pages/Files/m2/'), ('pages/Files/'), ('pages/Files/loop/a/')) AS v(p)),
  walk(path, spot, hops) AS (
    SELECT DISTINCT path, path, 0 FROM asked
    UNION ALL SELECT w.path, m.target || substring(w.spot, length(m.mount) + 1), w.hops + 1
    FROM walk w JOIN mounts m ON starts_with(w.spot || '/', m.mount || '/') WHERE w.hops < 20),
  last AS (SELECT path, max(hops) AS hops, arg_max(spot, hops) AS spot FROM walk GROUP BY path)
SELECT path, CASE WHEN hops < 20 THEN spot END AS resolved, CAST(CASE WHEN hops < 20 THEN hops ELSE 2 END AS INTEGER) AS hops, hops >= 20 AS loop
FROM last
""")
def q_resolve_shortcuts(spark, sf_dir):
    """resolve_paths: every page as seen through no, two and three shortcuts below each other, and
    through two that lead into each other."""
    paths = S.pages_files(_t(spark, sf_dir, "pages")).select(F.col("name").alias("path"))
    seen = [F.replace("path", F.lit("pages/Files/"), F.lit(f"pages/Files/{p}")) for p in ("m3/deep/", "m2/", "", "loop/a/")]
    return M.resolve_paths(paths.select(F.explode(F.array(*seen)).alias("path")), S.page_mounts(paths))


@query("q_nested_mounts", _MOUNT_CTES.rstrip().rstrip(",") + """
SELECT mount AS shortcutPath, target AS targetRoot, 1 AS depth, false AS loop FROM mounts WHERE starts_with(mount, 'pages/Files/m1/')
UNION ALL VALUES ('pages/Files/m2', 'pages/Files/m1', 1, false), ('pages/Files/m3/deep', 'pages/Files/m1', 1, false),
                 ('pages/Files/loop/a', NULL, 1, true), ('pages/Files/loop/b', NULL, 1, true)
UNION ALL SELECT p || host, 'pages/Files/' || host, 2, false FROM hosts, (VALUES ('pages/Files/m2/'), ('pages/Files/m3/deep/')) AS v(p)
""")
def q_nested_mounts(spark, sf_dir):
    """nested_mounts: every place where a shortcut to a host's pages can be seen."""
    paths = S.pages_files(_t(spark, sf_dir, "pages")).select(F.col("name").alias("path"))
    return M.nested_mounts(S.page_mounts(paths))


# --------------------------------------------------------------------------- paging


@query("q_page_numbers", """
WITH r AS (SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT event_id, event_type, CAST(pos // 100 + 1 AS BIGINT) AS page, CAST(pos % 100 AS BIGINT) AS slot FROM r
""")
def q_page_numbers(spark, sf_dir):
    """page_rows: the page of 100 and the slot on it of every event, in time order."""
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return paging.page_rows(events, ["ts", "event_id"], 100).select("event_id", "event_type", "page", "slot")


@query("q_page_keys", """
WITH r AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT CAST(pos // 500 + 1 AS BIGINT) AS page, min(k) AS first_key, max(k) AS last_key, count(*) AS n_rows
FROM r GROUP BY 1
""")
def q_page_keys(spark, sf_dir):
    """page_keys: first and last key of every page of 500 orders."""
    return paging.page_keys(_t(spark, sf_dir, "orders"), "o_orderkey", 500)
