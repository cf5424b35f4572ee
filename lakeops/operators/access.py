"""Data-access roles: flatten rules, match roles to paths and to members.

Input ``roles`` has the role schema of FIXTURES.md::

    id, name,
    decisionRules ARRAY<STRUCT<effect, permission ARRAY<STRUCT<attributeName,
                                                   attributeValueIncludedIn ARRAY<STRING>>>>>,
    members STRUCT<fabricItemMembers ..., microsoftEntraMembers ARRAY<STRUCT<tenantId,
                                                   objectId, objectType>>>

Matching rule (reference semantics): a role grants a path when any of its rules has a
*first* ``Path`` permission with a value that is ``*``, equals the path, or is a plain
string prefix of it. Later ``Path`` permissions of the same rule and all actions are ignored.
Prefixes are not segment-aligned: ``Tables/Sales`` grants ``Tables/SalesOld``.

Plan (no theta join, no broadcast of unbounded data). A pattern is an interval of the sorted paths
(all strings that begin with it), and intervals of two patterns are nested or apart. So patterns and
paths are sorted together, one row each, over ranges: the pattern before a path, with the patterns
that are prefixes of it, is the stack of intervals that may be open at the path, and the last
pattern of earlier ranges is carried over a range's border. The longest open pattern is the path's
*class*; which roles a class has is decided among the patterns alone. ``*`` and the empty pattern
are the key ``""``. Counts need no pairs: paths are counted for each prefix of a length that occurs
among the patterns, and the counts are joined to the patterns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import materialize

# The role schema (FIXTURES ``roles``), e.g. for ``from_json`` on landed role pages.
ROLE_SCHEMA = (
    "id string, name string, decisionRules array<struct<effect:string, permission:array<struct<"
    "attributeName:string, attributeValueIncludedIn:array<string>>>>>, members struct<"
    "fabricItemMembers:array<struct<itemAccess:array<string>,sourcePath:string>>, "
    "microsoftEntraMembers:array<struct<tenantId:string,objectId:string,objectType:string>>>")

PATH_ATTRIBUTE = "Path"
WILDCARD = "*"


def explode_rules(roles: DataFrame) -> DataFrame:
    """Flatten role → rule → permission → value.

    Returns ``role_id, role_name, rule_idx, effect, perm_idx, attributeName, value``.
    Rules without permissions and permissions without values yield no rows.
    """
    r = roles.select(
        F.col("id").alias("role_id"), F.col("name").alias("role_name"),
        F.posexplode("decisionRules").alias("rule_idx", "rule"))
    p = r.select(
        "role_id", "role_name", "rule_idx", F.col("rule.effect").alias("effect"),
        F.posexplode("rule.permission").alias("perm_idx", "perm"))
    return p.select(
        "role_id", "role_name", "rule_idx", "effect", "perm_idx",
        F.col("perm.attributeName").alias("attributeName"),
        F.explode("perm.attributeValueIncludedIn").alias("value"))


def path_patterns(roles: DataFrame) -> DataFrame:
    """``(role_id, pattern)`` from the first ``Path`` permission of every rule."""
    rules = roles.select(F.col("id").alias("role_id"), F.explode("decisionRules").alias("rule"))
    first_path = F.try_element_at(
        F.filter("rule.permission", lambda p: p["attributeName"] == F.lit(PATH_ATTRIBUTE)),
        F.lit(1))
    return rules.select(
        "role_id", F.explode(first_path["attributeValueIncludedIn"]).alias("pattern"))


def _match_keys(patterns: DataFrame, mode: str) -> DataFrame:
    key = F.when(F.col("pattern") == F.lit(WILDCARD), F.lit("")).otherwise(F.col("pattern"))
    if mode == "segment":
        # Our extension: a pattern grants itself and everything below it, on '/' borders.
        key = F.when(key == F.lit(""), key).otherwise(F.regexp_replace(key, "/+$", ""))
    return patterns.where(F.col("pattern").isNotNull()).select("role_id", key.alias("key")).distinct()


def _key_lengths(keys: DataFrame) -> Column:
    """Distinct pattern lengths as a scalar subquery: at most as many integers as the
    longest pattern has characters."""
    return keys.select(F.array_sort(F.collect_set(F.length("key")))).scalar()


def _path_keys(paths: DataFrame, path_col: str, keys: DataFrame, mode: str,
               lens: Column | None = None) -> DataFrame:
    path = F.col(path_col)
    if mode == "reference":
        lens = _key_lengths(keys) if lens is None else lens
        # explode + where rather than a lambda: stays inside generated code on the big side
        with_lens = paths.select(path.alias("path"), lens.alias("lens"))
        return (with_lens.select("path", F.explode("lens").alias("n"))
                .where(F.col("n") <= F.length("path"))
                .select("path", F.left(F.col("path"), F.col("n")).alias("key")))
    if mode == "segment":
        segs = F.split(F.col("path"), "/", -1)
        ancestors = (paths.select(path.alias("path"))
                     .select("path", F.explode(F.sequence(F.lit(1), F.size(segs))).alias("i"))
                     .select("path", F.array_join(F.slice(F.split(F.col("path"), "/", -1), F.lit(1), F.col("i")),
                                                  "/").alias("key"))
                     .where(F.col("key") != F.lit("")))  # "" comes once, from the wildcard rows
        wildcard = paths.select(path.alias("path"), F.lit("").alias("key"))
        return ancestors.unionByName(wildcard)
    raise ValueError(f"unknown mode {mode!r}; use 'reference' or 'segment'")


def _bordered(c: Column, mode: str) -> Column:
    """What is compared: a key or path itself, or with a ``/`` at its end so that prefixes end on borders."""
    if mode not in ("reference", "segment"):
        raise ValueError(f"unknown mode {mode!r}; use 'reference' or 'segment'")
    return c if mode == "reference" else F.when(c == F.lit(""), c).otherwise(F.concat(c, F.lit("/")))


def pattern_chains(keys: DataFrame, mode: str = "reference") -> DataFrame:
    """``(key, lens)``: for every pattern key the lengths of the keys that are prefixes of it, its own among them.

    Work is on the patterns alone.
    """
    uniq = keys.select("key").distinct()
    lens = _key_lengths(keys)
    above = uniq.select("key", lens.alias("_lens"))
    above = above.select("key", F.explode(_strict_prefixes(above, "key", F.col("_lens"), mode)).alias("_p"))
    found = above.join(uniq.select(F.col("key").alias("_p")), "_p").select("key", F.length("_p").alias("n"))
    own = uniq.select("key", F.length("key").alias("n"))
    return found.unionByName(own).groupBy("key").agg(F.array_sort(F.collect_set("n")).alias("lens"))


def path_classes(paths: DataFrame, chains: DataFrame, path_col: str = "path", mode: str = "reference") -> DataFrame:
    """``(path, class)``: each distinct path with the longest pattern key that is a prefix of it.

    Paths that no pattern covers are left out. ``chains``: see :func:`pattern_chains`. One row per path and
    pattern is sorted, whatever the number of pattern lengths.
    """
    marks = chains.select(_bordered(F.col("key"), mode).alias("at"), F.lit(0).alias("kind"),
                          F.struct("key", "lens").alias("open"), F.lit(None).cast("string").alias("path"))
    path = F.col(path_col)
    asked = paths.where(path.isNotNull()).select(
        F.when(path == F.lit(""), path).otherwise(_bordered(path, mode)).alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast(marks.schema["open"].dataType).alias("open"), path.alias("path"))
    swept = materialize(marks.unionByName(asked).repartitionByRange("at", "kind").withColumn("_range", F.spark_partition_id()))
    # The stack that a range begins with: the last pattern of the ranges before it (one row per range).
    lasts = swept.groupBy("_range").agg(F.max_by("open", F.when(F.col("kind") == 0, F.col("at"))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    here = Window.partitionBy("_range").orderBy("at", "kind")
    stack = F.last("open", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (swept.withColumn("_stack", stack).withColumn("_again", F.lag("path").over(here).eqNullSafe(F.col("path")))
             .where((F.col("kind") == 1) & ~F.col("_again")).join(F.broadcast(carried), "_range")
             .select("at", "path", F.coalesce("_stack", "_carried").alias("_s")).where("_s is not null"))
    key = F.col("_s.key")
    # Open at the path are the prefixes of the stack's top that are prefixes of the path as well.
    covers = F.filter("_s.lens", lambda n: F.startswith(F.col("at"), _bordered(F.left(key, n), mode)))
    return found.select("path", F.left(key, F.array_max(covers)).alias("class")).where(F.col("class").isNotNull())


def class_roles(keys: DataFrame, chains: DataFrame) -> DataFrame:
    """``(class, role_id)``: the roles of every pattern key and of the keys that are prefixes of it."""
    open_keys = chains.select(F.col("key").alias("class"), F.explode("lens").alias("n")).select(
        "class", F.left("class", F.col("n")).alias("key"))
    return open_keys.join(keys, "key").select("class", "role_id").distinct()


def roles_for_path(paths: DataFrame, roles: DataFrame, path_col: str = "path",
                   mode: str = "reference") -> DataFrame:
    """Every ``(role_id, path)`` where the role grants the path; each pair once.

    ``mode="reference"`` is the reference's plain string-prefix rule; ``mode="segment"``
    (our extension) only matches on ``/`` borders. The paths are swept once along their order
    (:func:`path_classes`); Spark picks the join with the classes' roles by measured bytes and
    splits a class that many paths share.
    """
    keys = materialize(_match_keys(path_patterns(roles), mode))
    chains = materialize(pattern_chains(keys, mode))
    return path_classes(paths, chains, path_col, mode).join(class_roles(keys, chains), "class").select("role_id", "path")


def _strict_prefixes(df: DataFrame, key_col: str, lens: Column, mode: str) -> Column:
    """Proper prefixes of ``key_col`` that could be patterns: at the pattern lengths (reference
    mode) or on ``/`` borders (segment mode), always including the wildcard key ``""``."""
    k = F.col(key_col)
    if mode == "reference":
        return F.transform(F.filter(lens, lambda n: n < F.length(k)), lambda n: F.left(k, n))
    segs = F.split(k, "/", -1)
    anc = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))),
                      lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))
    anc = F.filter(anc, lambda a: a != k)
    return F.when(k == F.lit(""), F.array().cast("array<string>")).otherwise(
        F.array_union(F.array(F.lit("")), anc))


def _prefix_free(group_keys: DataFrame, group_col: str, mode: str, lens: Column) -> DataFrame:
    """Drop every key that has another key of the same group as a proper prefix.

    What is left matches disjoint sets of paths (two patterns that both prefix one path
    are prefixes of each other), so a group's path count is the sum over its keys.
    ``lens`` is the pattern-length set of all keys (a superset of the group's).
    """
    with_lens = group_keys.select(group_col, "key", lens.alias("_lens"))
    cands = with_lens.select(group_col, "key", F.explode(
        _strict_prefixes(with_lens, "key", F.col("_lens"), mode)).alias("_p"))
    have = group_keys.select(group_col, F.col("key").alias("_p"))
    dominated = cands.join(have, [group_col, "_p"], "left_semi").select(group_col, "key")
    return group_keys.join(dominated, [group_col, "key"], "left_anti")


def key_path_counts(paths: DataFrame, keys: DataFrame, path_col: str = "path",
                    mode: str = "reference", lens: Column | None = None, distinct_paths: bool = True) -> DataFrame:
    """``(key, n)``: how many distinct paths each pattern key grants, without any pairs.

    Prefixes are counted per prefix string first (partial aggregation collapses hot prefixes
    such as the wildcard before the shuffle) and the counts are joined to the keys.
    """
    uniq = paths.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias(path_col))
    if distinct_paths:  # a listing never repeats a path; skip this shuffle when that is known
        uniq = uniq.distinct()
    pk = _path_keys(uniq, path_col, keys, mode, lens)
    per_prefix = pk.groupBy("key").agg(F.count("*").alias("n"))
    return per_prefix.join(keys.select("key").distinct(), "key")


def _grant_counts(group_keys: DataFrame, group_col: str, n_by_key: DataFrame,
                  mode: str, lens: Column) -> DataFrame:
    pf = _prefix_free(group_keys, group_col, mode, lens)
    return pf.join(n_by_key, "key").groupBy(group_col).agg(F.sum("n").cast("long").alias("n_paths"))


def role_path_counts(paths: DataFrame, roles: DataFrame, path_col: str = "path",
                     mode: str = "reference", distinct_paths: bool = True) -> DataFrame:
    """How many distinct paths each role opens; roles that open none report 0.

    Exact without (role, path) pairs: each role's patterns are reduced to a prefix-free
    set, whose matches are disjoint, and the per-pattern path counts are summed. Paths are
    de-duplicated first unless ``distinct_paths=False`` says the listing has no repeats.
    """
    keys = materialize(_match_keys(path_patterns(roles), mode))
    lens = _key_lengths(keys)
    n_by_key = key_path_counts(paths, keys, path_col, mode, lens=lens,
                               distinct_paths=distinct_paths)
    counts = _grant_counts(keys, "role_id", n_by_key, mode, lens)
    all_roles = roles.select(F.col("id").alias("role_id")).distinct()
    return all_roles.join(counts, "role_id", "left").select(
        "role_id", F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"))


def role_members(roles: DataFrame) -> DataFrame:
    """``(role_id, objectId, objectType, tenantId)`` for every directory (user or group) member of a role."""
    m = roles.select(F.col("id").alias("role_id"),
                     F.explode("members.microsoftEntraMembers").alias("m"))
    return m.select("role_id", F.col("m.objectId").alias("objectId"),
                    F.col("m.objectType").alias("objectType"),
                    F.col("m.tenantId").alias("tenantId"))


def roles_for_member(roles: DataFrame, identities: DataFrame | None = None,
                     id_col: str = "objectId") -> DataFrame:
    """Roles that list an identity among their directory members (item members are not searched).

    With ``identities`` (a table of object ids) the result is limited to those ids.
    Returns distinct ``(objectId, role_id)``.
    """
    m = role_members(roles).where(F.col("objectId").isNotNull()).select("objectId", "role_id")
    if identities is not None:
        ids = identities.select(F.col(id_col).alias("objectId")).distinct()
        m = m.join(ids, "objectId", "left_semi")
    return m.distinct()


class AccessClasses(NamedTuple):
    paths: DataFrame    # path, path_class
    members: DataFrame  # objectId, member_class
    access: DataFrame   # member_class, path_class, roles


def _role_sets(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(key, name)`` and ``(name, role_id)`` of ``df(key, role_id)``: equal role sets have one digest."""
    sets = materialize(df.groupBy(key).agg(F.array_sort(F.collect_set("role_id")).alias("_roles"))
                       .select(key, "_roles", F.sha2(F.to_json("_roles"), 256).alias(name)))
    each = sets.select(name, "_roles").distinct().select(name, F.explode("_roles").alias("role_id"))
    return sets.select(key, name), each


def access_classes(paths: DataFrame, roles: DataFrame, path_col: str = "path", mode: str = "reference",
                   identities: DataFrame | None = None, id_col: str = "objectId") -> AccessClasses:
    """Who can read which path, as classes: members of equal role sets, paths of equal role sets.

    ``access`` has one row per pair of a member class and a path class that share a role, with
    the roles that give access; ``members`` and ``paths`` say who is in which class. So a member with
    all roles makes one row per path class, and none per path. ``identities`` limits the members (and
    the roles looked at). Paths without any role have no class.
    """
    held = roles_for_member(roles, identities, id_col)
    if identities is not None:
        roles = roles.join(held.select(F.col("role_id").alias("id")).distinct(), "id", "left_semi")
    keys = materialize(_match_keys(path_patterns(roles), mode))
    chains = materialize(pattern_chains(keys, mode))
    swept = path_classes(paths, chains, path_col, mode)
    of_pattern, path_roles = _role_sets(class_roles(keys, chains), "class", "path_class")
    of_member, member_roles = _role_sets(held, "objectId", "member_class")
    access = member_roles.join(path_roles, "role_id").groupBy("member_class", "path_class").agg(
        F.array_sort(F.collect_set("role_id")).alias("roles"))
    return AccessClasses(swept.join(of_pattern, "class").select("path", "path_class"), of_member, access)


def access_matrix(paths: DataFrame, roles: DataFrame, path_col: str = "path",
                  mode: str = "reference", identities: DataFrame | None = None,
                  id_col: str = "objectId") -> DataFrame:
    """``(objectId, path, roles)``: who can read which path, through which roles.

    The classes of :func:`access_classes`, unfolded: one row per granted (member, path) pair, so
    its size is the size of the answer; pass ``identities`` to ask about some members only. Callers
    that need totals should use :func:`access_summary`, which never builds the pairs.
    """
    c = access_classes(paths, roles, path_col, mode, identities, id_col)
    return c.access.join(c.members, "member_class").join(c.paths, "path_class").select("objectId", "path", "roles")


def access_check(questions: DataFrame, roles: DataFrame, path_col: str = "path", id_col: str = "objectId",
                 mode: str = "reference") -> DataFrame:
    """For asked-for ``(objectId, path)`` pairs: the roles that give the identity that path.

    One row per distinct question with ``roles`` (sorted, empty when access is denied). Only
    the roles of asked-for identities and the asked-for paths are joined, and the answer is as
    large as the question.
    """
    ask = materialize(questions.select(F.col(id_col).alias("objectId"), F.col(path_col).alias("path")).distinct())
    members = roles_for_member(roles, ask, "objectId")
    own = roles.join(members.select(F.col("role_id").alias("id")).distinct(), "id", "left_semi")
    keys = materialize(_match_keys(path_patterns(own), mode))
    prefixes = _path_keys(ask.select("path").distinct().where("path is not null"), "path", keys, mode).select("path", "key")
    # Each question meets the roles of its identity, and of those only the ones with a matching pattern stay.
    held = ask.join(members, "objectId").join(keys, "role_id").join(prefixes, ["path", "key"])
    given = held.groupBy(F.col("objectId").alias("_id"), F.col("path").alias("_path")).agg(
        F.array_sort(F.collect_set("role_id")).alias("roles"))
    same = F.col("objectId").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path"))
    return ask.join(given, same, "left").select(
        "objectId", "path", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def access_summary(paths: DataFrame, roles: DataFrame, path_col: str = "path",
                   mode: str = "reference", distinct_paths: bool = True) -> DataFrame:
    """Per member: number of roles held and number of distinct paths readable.

    Exact without forming (member, path) or (role, path) pairs: a member's patterns (those
    of all roles held) are reduced to a prefix-free set, whose matches are disjoint, and
    the per-pattern path counts are summed. Work is members × patterns, plus one pass
    over the paths.
    """
    keys = materialize(_match_keys(path_patterns(roles), mode))
    lens = _key_lengths(keys)
    n_by_key = key_path_counts(paths, keys, path_col, mode, lens=lens,
                               distinct_paths=distinct_paths)
    members = materialize(roles_for_member(roles))  # feeds two branches: compute once
    member_keys = members.join(keys, "role_id").select("objectId", "key").distinct()
    reach = _grant_counts(member_keys, "objectId", n_by_key, mode, lens)
    held = members.groupBy("objectId").agg(F.count("*").alias("n_roles"))
    return held.join(reach, "objectId", "left").select(
        "objectId", "n_roles", F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"))
