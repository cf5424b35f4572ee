"""Lookups and link tables: the reference's per-row loops and maps, as joins
plus the row-level updates of §2.7 (patches, revocations, shortcut create policies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference).
SHARING_STATUSES = ("Active", "Pending")
REVOKED = "Revoked"
ADMIN_ROLE = "Admin"
CONFLICT_POLICIES = ("Abort", "GenerateUniqueName", "CreateOrOverwrite", "OverwriteOnly")


def resolve_names(dimension: DataFrame, requested: DataFrame, name_col: str = "name",
                  order_col: str = "ord", req_name_col: str = "name") -> DataFrame:
    """Case-insensitive name lookup, the *last* dimension row winning on duplicate names.

    Every requested row comes back once, with the matched dimension row's columns
    prefixed ``match_`` and ``found`` (``applied`` = found, ``notFound`` = not found).
    The dimension is reduced to one row per lower-cased name with a ``max`` over
    ``(order, row)`` (map-side partial aggregation), then hash-joined; AQE broadcasts it
    when it measures small.
    """
    cols = dimension.columns
    # max over (order, row): the last row wins, and equal orders are broken by row content
    # so the answer never depends on task order.
    last = (dimension.where(F.col(name_col).isNotNull())
            .select(F.lower(name_col).alias("_k"),
                    F.struct(F.col(order_col).alias("_o"), F.struct(*cols).alias("_row")).alias("_w"))
            .groupBy("_k").agg(F.max("_w")["_row"].alias("_row")))
    req = requested.withColumn("_k", F.lower(F.col(req_name_col)))
    j = req.join(last, "_k", "left")
    return j.select(*[F.col(c) for c in requested.columns],
                    *[F.col("_row")[c].alias(f"match_{c}") for c in cols],
                    F.col("_row").isNotNull().alias("found"))


def apply_links(links: DataFrame, new_links: DataFrame, keys: Sequence[str] = ("itemId", "tagId")) -> DataFrame:
    """Add links; each (item, tag) pair appears once."""
    k = list(keys)
    return links.select(*k).unionByName(new_links.select(*k)).dropDuplicates(k)


def remove_links(links: DataFrame, removed: DataFrame, keys: Sequence[str] = ("itemId", "tagId")) -> DataFrame:
    """Drop links listed in ``removed``."""
    k = list(keys)
    return links.join(removed.select(*k).distinct(), k, "left_anti")


def assignments_for_principal(resources: DataFrame, assignments: DataFrame,
                              principals: DataFrame | None = None, resource_id: str = "id",
                              principal_col: str = "principalId") -> DataFrame:
    """Resources on which each principal holds an assignment, paired with that assignment.

    ``assignments``: ``id, resourceId, principal STRUCT<id, type, displayName>, role``.
    Resources without an assignment are skipped (inner join). With ``principals`` (a
    table of ids) the result is limited to them.
    """
    a = assignments.select(F.col("resourceId").alias(resource_id),
                           F.col("principal.id").alias("principalId"),
                           F.col("role"), F.col("id").alias("assignmentId"))
    if principals is not None:
        a = a.join(principals.select(F.col(principal_col).alias("principalId")).distinct(),
                   "principalId", "left_semi")
    return a.join(resources, resource_id)


def admins(resources: DataFrame, assignments: DataFrame, resource_id: str = "id") -> DataFrame:
    """(principalId, resource) pairs where the principal holds the ``Admin`` role."""
    a = assignments.where(F.col("role") == F.lit(ADMIN_ROLE)).select(
        F.col("resourceId").alias(resource_id), F.col("principal.id").alias("principalId"))
    return a.join(resources.select(resource_id), resource_id, "left_semi").distinct()


def missing_ids(requested: DataFrame, listing: DataFrame, req_col: str = "id",
                id_col: str = "id") -> DataFrame:
    """Requested ids that have no row in the listing."""
    have = listing.select(F.col(id_col).alias(req_col))
    return requested.select(req_col).distinct().join(have, req_col, "left_anti")


def shared_paths(paths: DataFrame, shares: DataFrame, path_col: str = "path") -> DataFrame:
    """Each path with ``is_shared``: some share in status Active or Pending lists it exactly."""
    live = (shares.where(F.col("status").isin(*SHARING_STATUSES))
            .select(F.explode("paths").alias(path_col)).distinct()
            .withColumn("_hit", F.lit(True)))
    return paths.join(live, path_col, "left").select(
        *[F.col(c) for c in paths.columns], F.coalesce("_hit", F.lit(False)).alias("is_shared"))


def revoke_by_ids(shares: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Set ``status`` to ``Revoked`` on the listed shares; others unchanged."""
    hit = ids.select(F.col(id_col).alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = shares.join(hit, "id", "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(REVOKED)).otherwise(F.col("status")).alias("status")
                      if c == "status" else F.col(c) for c in shares.columns])


def accept_share(path_details: DataFrame, requests: DataFrame) -> DataFrame:
    """Shortcuts created by accepting share invitations.

    ``path_details``: ``invitationId, pathId, name, type`` (what the provider shared).
    ``requests``: ``invitationId, pathId, shortcutName, path, itemId, workspaceId``.
    Returns ``itemId, workspaceId, path, name, sharedName, type`` for every request whose
    path id is part of its invitation; unknown path ids create nothing.
    """
    d = path_details.select("invitationId", "pathId", F.col("name").alias("sharedName"), "type")
    return requests.join(d, ["invitationId", "pathId"]).select(
        "itemId", "workspaceId", "path", F.col("shortcutName").alias("name"), "sharedName", "type")


def patch_rows(base: DataFrame, patches: DataFrame, key: str | Sequence[str],
               columns: Sequence[str] | None = None, order_col: str | None = None) -> DataFrame:
    """Update only the fields a patch gives: ``coalesce(patch.c, base.c)`` per column.

    A null in a patch leaves the field as it was (optional fields of an update request).
    Nested struct columns are replaced whole when a patch gives them. Several patches for one
    key need ``order_col``: they apply one after the other, so each field takes its last given
    value (equal orders: the larger value). Without an order they are an error.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in (columns or patches.columns) if c not in keys and c != order_col]
    order = F.col(order_col) if order_col else F.lit(0)
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(f"_p_{c}")
            for c in cols]
    p = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *last)
    if not order_col:
        several = F.raise_error(F.lit("several patches for one key need an order column")).cast("boolean")
        p = p.where(F.when(F.col("_n") > 1, several).otherwise(F.lit(True)))
    p = p.drop("_n")
    j = base.join(p, keys, "left")
    return j.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in base.columns])


def _free_names(requests: DataFrame, existing: DataFrame, req_id: str) -> DataFrame:
    """``requests`` with ``_free``: for a wanted ``_base`` name the first of ``_base, _base_2,
    _base_3, ...`` that is free in its path; null where nothing is wanted."""
    # A name of the table or of a request blocks itself as the first choice, and <x>_<k>, also a wanted
    # one, blocks choice k of <x>: both from one pass over all names.
    wanted = requests.where(F.col("_base").isNotNull())
    names = (existing.select("path", "name", F.lit(True).alias("own")).unionByName(requests.select("path", "name", F.lit(True).alias("own")))
             .unionByName(wanted.select("path", F.col("_base").alias("name"), F.lit(False).alias("own"))).distinct())
    number = F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 2)
    first = F.when(F.col("own"), F.struct(F.col("name").alias("_base"), F.lit(1).alias("k")))
    later = F.when(number != "", F.struct(F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 1).alias("_base"), number.cast("int").alias("k")))
    choices = names.select("path", F.explode(F.array(first, later)).alias("c")).where("c is not null").select("path", "c.*")
    # Requests that want the same name (only possible with text ids) take turns.
    turns = wanted.groupBy("path", "_base").agg(F.collect_list(req_id).alias("_ids"))
    turn = F.array_position(F.array_sort("_ids"), F.col(req_id)).cast("int")
    blocked = turns.join(choices, ["path", "_base"], "left").groupBy("path", "_base").agg(
        F.collect_set("k").alias("_ks"), F.first("_ids").alias("_ids"))
    j = requests.join(blocked, ["path", "_base"], "left")
    ks = F.coalesce("_ks", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.size(ks) + F.size("_ids")), ks)
    k = F.element_at(free, turn)
    name = F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), k.cast("string")))
    return j.withColumn("_free", F.when(F.col("_base").isNotNull(), name))


def classify_requests(existing: DataFrame, requests: DataFrame, req_id: str = "req_id") -> DataFrame:
    """``requests`` with ``_first`` (the first request for its path and name) and ``_exists`` (a
    shortcut of that path and name is there). Worth storing when several policies are compared."""
    k = ["path", "name"]
    first = requests.groupBy(*k).agg(F.min(req_id).alias("_first"))
    have = existing.select(*k).distinct().withColumn("_exists", F.lit(True))
    return requests.join(first, k).join(have, k, "left")


def apply_shortcut_requests(existing: DataFrame, requests: DataFrame, policy: str, req_id: str = "req_id",
                            classified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of shortcut create requests under a conflict policy.

    ``existing`` and ``requests`` have ``path, name, target``; ``requests`` also has a
    unique ``req_id``. A request *conflicts* when a shortcut with its (path, name) exists,
    or an earlier request (smaller ``req_id``) in the batch takes that (path, name).
    Our rules (the reference leaves them to the service):

    * ``Abort``: conflicting requests fail with ``Conflict``; the others are created.
    * ``GenerateUniqueName``: a conflicting request is created as ``<name>_<req_id>``; where
      that name is taken in the path (by a shortcut, a request or another new name), as
      ``<name>_<req_id>_<k>`` with the smallest free ``k`` from 2.
    * ``CreateOrOverwrite``: the first request for a (path, name) creates or overwrites it;
      later duplicates fail with ``Duplicate``.
    * ``OverwriteOnly``: the first request for an existing (path, name) overwrites it;
      requests for names that do not exist fail with ``NotFound``.

    Returns ``(result, outcomes)``: the shortcut table after the batch, and per request
    ``req_id, path, name, status`` with ``name`` the name actually used.
    """
    if policy not in CONFLICT_POLICIES:
        raise ValueError(f"policy must be one of {CONFLICT_POLICIES}")
    k = ["path", "name"]
    r = classify_requests(existing, requests, req_id) if classified is None else classified
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    is_first = F.col(req_id) == F.col("_first")
    if policy == "Abort":
        status = F.when(exists | ~is_first, F.lit("Conflict")).otherwise(F.lit("Created"))
        name = F.col("name")
    elif policy == "GenerateUniqueName":
        renamed = exists | ~is_first
        status = F.when(renamed, F.lit("CreatedWithNewName")).otherwise(F.lit("Created"))
        r = _free_names(r.withColumn("_base", F.when(renamed, F.concat(
            F.col("name"), F.lit("_"), F.col(req_id).cast("string")))), existing, req_id)
        name = F.coalesce("_free", "name")
    elif policy == "CreateOrOverwrite":
        status = (F.when(~is_first, F.lit("Duplicate"))
                  .when(exists, F.lit("Overwritten")).otherwise(F.lit("Created")))
        name = F.col("name")
    else:  # OverwriteOnly
        status = (F.when(~exists, F.lit("NotFound")).when(~is_first, F.lit("Duplicate"))
                  .otherwise(F.lit("Overwritten")))
        name = F.col("name")
    outcomes = r.select(req_id, "path", name.alias("name"), status.alias("status"), "target")
    applied = outcomes.where(F.col("status").isin("Created", "CreatedWithNewName", "Overwritten"))
    kept = existing.join(applied.where(F.col("status") == "Overwritten").select(*k), k, "left_anti")
    result = kept.select("path", "name", "target").unionByName(applied.select("path", "name", "target"))
    return result, outcomes.drop("target")
