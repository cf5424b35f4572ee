"""DuckDB SQL twins of the stand-in builders in ``standins.py``.

Each is a CTE body to splice into an oracle query. They rebuild the same input rows from
the driver views; the oracle query then states the operator's semantics directly in SQL.
"""

PAGE_PATHS = """
    SELECT page_id,
           'pages/Files/' || regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1), '/+$', '')
             || '/' || CAST(page_id AS VARCHAR) || '.page' AS path,
           CAST(length(html) AS BIGINT) AS contentLength
    FROM pages
"""

PAGE_HOSTS = """
    SELECT DISTINCT regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
                    regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme
    FROM pages
"""

# (role_id, pattern) of the first Path permission of every rule of pages_roles().
PAGE_ROLE_PATTERNS = """
    SELECT 'site:' || host AS role_id, 'pages/Files/' || host || '/en' AS pattern FROM page_hosts
    UNION ALL SELECT 'site:' || host, 'pages/Files/' || host || '/fr' FROM page_hosts
    UNION ALL SELECT 'label:' || split_part(host, '.', 1), 'pages/Files/' || split_part(host, '.', 1)
              FROM page_hosts
    UNION ALL SELECT 'scheme:' || scheme, CASE WHEN scheme = 'https' THEN '*' ELSE '' END FROM page_hosts
"""

# (role_id, objectId) of pages_roles().
PAGE_ROLE_MEMBERS = """
    SELECT 'site:' || host AS role_id, 'u-' || split_part(host, '.', 1) AS objectId FROM page_hosts
    UNION ALL SELECT 'label:' || split_part(host, '.', 1), 'u-' || split_part(host, '.', 1) FROM page_hosts
    UNION ALL SELECT 'label:' || split_part(host, '.', 1),
                     'g-' || CAST(length(split_part(host, '.', 1)) AS VARCHAR) FROM page_hosts
    UNION ALL SELECT 'scheme:' || scheme, 'u-' || scheme FROM page_hosts
"""

PAGE_GRANTS = """
    SELECT DISTINCT r.role_id, p.path
    FROM page_role_patterns r JOIN page_paths p
      ON r.pattern = '*' OR p.path = r.pattern OR starts_with(p.path, r.pattern)
"""


def with_pages_access(body: str) -> str:
    return f"""
WITH page_paths AS ({PAGE_PATHS}),
     page_hosts AS ({PAGE_HOSTS}),
     page_role_patterns AS ({PAGE_ROLE_PATTERNS}),
     page_role_members AS ({PAGE_ROLE_MEMBERS}),
     page_grants AS ({PAGE_GRANTS})
{body}"""

SHARES = """
    SELECT 'share-' || o_orderkey AS id,
           ['cust/' || o_custkey, 'prio/' || o_orderpriority] AS paths,
           'c' || o_custkey || '@example.com' AS upn,
           't' || left(o_orderpriority, 1) AS tenantId,
           CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Pending' ELSE 'Revoked' END AS status,
           CAST(o_orderdate AS TIMESTAMP) AS expirationTimeUtc,
           'ws-' || left(o_orderpriority, 1) AS workspaceId,
           'item-' || o_custkey AS itemId,
           o_orderkey, o_custkey
    FROM orders
"""

SHORTCUTS = """
    SELECT 'Files/' || lower(p_type) AS path,
           p_name || ' ' || p_partkey AS name,
           (['OneLake', 'AmazonS3', 'AdlsGen2', 'GoogleCloudStorage', 'S3Compatible',
             'Dataverse', 'ExternalDataShare', 'AzureBlobStorage'])[p_size % 8 + 1] AS kind,
           'ws-' || regexp_extract(p_brand, '(\\d+)$', 1) AS ol_workspace,
           'item-' || p_partkey AS ol_item,
           'Tables/' || lower(p_type) AS ol_path,
           '/' || lower(p_type) || '/' || p_partkey AS sub,
           CAST(p_size AS VARCHAR) AS size,
           p_partkey, p_name, p_size
    FROM part
"""

CAPACITIES = """
    SELECT 'cap-c' || c_custkey AS id, c_name AS displayName,
           left(c_mktsegment, 1) || c_nationkey AS sku, 'Region-' || c_nationkey AS region,
           CASE WHEN c_acctbal < 0 THEN 'Suspended' ELSE 'Active' END AS state
    FROM customer
    UNION ALL
    SELECT 'cap-p' || p_partkey, p_name, left(p_type, 1) || p_size, 'region-' || p_size, 'Active'
    FROM part
"""

OPERATIONS = """
    SELECT 'op-' || event_id AS id,
           CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'NotStarted'
                WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' ELSE 'Cancelled' END AS status,
           value AS percentComplete,
           'E1' AS code,
           CASE WHEN event_type = 'error' AND value >= 10 THEN 'error for user ' || user_id ELSE '' END AS msg
    FROM events
"""

POOLS = """
    SELECT p_partkey,
           CASE WHEN p_size = 1 THEN '' WHEN p_size > 45 THEN 'Starter Pool'
                WHEN p_size > 40 THEN p_name || '#' ELSE p_name || ' ' || p_partkey END AS name,
           CASE WHEN p_size = 4 THEN '' ELSE 'MemoryOptimized' END AS nodeFamily,
           p_size = 7 AS noScale,
           'Org.W' || CASE WHEN p_size = 8 THEN '_' ELSE '' END || p_size AS workload,
           'Org.W1' || CASE WHEN p_size = 9 THEN '' ELSE '.I' END || p_size AS itemType,
           'Org.W1.I1' || CASE WHEN p_size = 10 THEN '..' ELSE '.J' END || p_size AS jobType,
           CASE WHEN p_size = 2 THEN NULL ELSE 'Small' END AS nodeSize,
           CASE WHEN p_size <> 7 THEN p_size % 4 END AS minNodeCount, CASE WHEN p_size <> 7 THEN p_size % 3 END AS maxNodeCount,
           p_size = 3 AS noAllocation,
           CASE WHEN p_size = 3 THEN NULL ELSE p_size % 5 END AS minExecutors,
           CASE WHEN p_size = 3 THEN NULL ELSE (p_size + 1) % 4 END AS maxExecutors,
           p_size * 30 AS inactivity, p_size % 9 AS members,
           repeat(p_name, p_size) AS displayName,
           CASE WHEN p_size > 40 THEN '0' || p_size || '.1.0'
                ELSE p_size || '.0.' || p_partkey || CASE WHEN p_size > 30 THEN '-beta.1' ELSE '' END END AS version,
           CASE WHEN p_size < 5 THEN 'not-a-guid' ELSE
                concat_ws('-', substring(md5(p_name || p_partkey), 1, 8), substring(md5(p_name || p_partkey), 9, 4),
                          substring(md5(p_name || p_partkey), 13, 4), substring(md5(p_name || p_partkey), 17, 4),
                          substring(md5(p_name || p_partkey), 21, 12)) END
             || CASE WHEN p_size = 6 THEN chr(10) ELSE '' END AS guid
    FROM part
"""

MANIFESTS = """
    packages AS (SELECT 'pkg-' || r_regionkey AS package, 'Org.W' || r_regionkey AS workloadName FROM region),
    items AS (SELECT 'pkg-' || n_regionkey AS package, n_name || '.xml' AS itemFile,
                     CASE WHEN n_nationkey = 7 THEN 'Org.Other' WHEN n_nationkey = 9 THEN 'ORG.w' || n_regionkey ELSE 'Org.W' || n_regionkey END AS itemWorkloadName,
                     CASE WHEN n_nationkey % 5 = 0 THEN 'org.W' ELSE 'Org.W' END || n_regionkey || '.Item' || n_nationkey
                       AS typeName
              FROM nation),
    jobs AS (SELECT 'pkg-' || n_regionkey AS package, n_name || '.xml' AS itemFile,
                    'Org.W' || n_regionkey || '.Item' || n_nationkey || CASE WHEN c_acctbal < 0 THEN '' ELSE '.' END
                      || c_mktsegment || c_custkey AS jobName
             FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

# pages_listing(): page files plus every folder between pages/Files and the file.
PAGE_LISTING = """
    SELECT path AS name, false AS isDirectory FROM page_paths
    UNION ALL
    SELECT DISTINCT array_to_string(s[1:k], '/'), true
    FROM (SELECT string_split(path, '/') AS s FROM page_paths) t, unnest(range(3, len(s))) AS u(k)
"""

GEO_FOLDERS = """
    SELECT 'r' || r_regionkey AS id, r_name AS displayName, CAST(NULL AS VARCHAR) AS parentFolderId FROM region
    UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer
"""

GEO_MOVES = """
    SELECT 'n' || n_nationkey AS id, CAST(NULL AS VARCHAR) AS target FROM nation WHERE starts_with(n_name, 'A')
    UNION ALL SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE 'n' || ((c_nationkey + 1) % 25) END
    FROM customer WHERE c_acctbal < 0
"""

PAGE_DIR_SEGMENTS = """string_split(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1), '/+$', ''), '/')"""

DOCS_LISTING = """
    SELECT 'docs/Tables/' || lang || '/' || source || '/part-' || doc_id || '.parquet' AS name,
           false AS isShortcut, CAST(NULL AS VARCHAR) AS accountType FROM documents
    UNION ALL SELECT DISTINCT 'docs/Tables/' || lang || '/' || source || '/_delta_log', false, NULL FROM documents
    UNION ALL SELECT DISTINCT 'docs/Tables/' || source || '_flat/_delta_log', false, NULL FROM documents
    UNION ALL SELECT DISTINCT 'docs/Tables/archive/' || lang || '/old/_delta_log', false, NULL FROM documents
    UNION ALL SELECT DISTINCT 'docs/Tables/ext_' || source, true,
           CASE WHEN ends_with(source, '1') THEN 'ADLS' WHEN ends_with(source, '2') THEN 'ExternalADLS'
                ELSE 'S3' END FROM documents
"""

# discover_tables() over DOCS_LISTING, stated directly.
DOCS_TABLES = """
    SELECT 'Tables' AS rootFolder, tp[len(tp)] AS name,
           regexp_replace(array_to_string(tp, '/'), '^[^/]*/?', '') || '/' AS relativePath,
           CASE WHEN len(tp) = 4 THEN tp[3] END AS schema
    FROM (SELECT CASE WHEN ends_with(name, '/_delta_log') THEN string_split(name, '/')[1:-2]
                      ELSE string_split(name, '/') END AS tp
          FROM docs_listing
          WHERE ends_with(name, '/_delta_log') OR (isShortcut AND accountType IN ('ADLS', 'ExternalADLS')))
"""

TAGS_LAST = """
    SELECT lower(p_name) AS k, arg_max('tag-' || p_partkey, p_partkey) AS tagId FROM part GROUP BY lower(p_name)
"""

TAG_REQUESTS = """
    SELECT 'order-' || l_orderkey AS itemId,
           CASE WHEN l_linenumber = 1 THEN upper(p_name) WHEN l_linenumber = 2 THEN p_name || ' x'
                ELSE p_name END AS name,
           l_returnflag, l_linestatus
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""

RESOLVED = """
    SELECT r.itemId, r.name, t.tagId, t.tagId IS NOT NULL AS found, r.l_returnflag, r.l_linestatus
    FROM tag_requests r LEFT JOIN tags_last t ON lower(r.name) = t.k
"""
