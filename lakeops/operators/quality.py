
from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tiers

# Fixed values (must equal the reference): SKU prefix → pricing tier, checked in this order.
SKU_TIERS = (("F", "Fabric"), ("P", "Premium"), ("A", "Azure"))
UNKNOWN_TIER = "Unknown"


def bucket_by_prefix(df: DataFrame, col: str, out_col: str = "tier",
                     prefixes: Sequence[tuple[str, str]] = SKU_TIERS,
                     default: str = UNKNOWN_TIER) -> DataFrame:
    """Add ``out_col`` from the first matching prefix of ``col`` (case-sensitive)."""
    expr = F.lit(default)
    for prefix, label in reversed(list(prefixes)):
        expr = F.when(F.coalesce(F.startswith(F.col(col), F.lit(prefix)), F.lit(False)),
                      F.lit(label)).otherwise(expr)
    return df.withColumn(out_col, expr)


# ---------------------------------------------------------------- run states

# Fixed values (must equal the reference).
RUNNING_STATES = ("Running", "NotStarted")
COMPLETE_STATES = ("Succeeded", "Failed")
DEFAULT_FAILURE_MESSAGE = "Operation failed"
CANCELLABLE_STATUS = "InProgress"


def run_state_flags(requested: DataFrame, operations: DataFrame, id_col: str = "id") -> DataFrame:
    """State flags for every requested operation id.

    ``operations``: ``id, status, percentComplete, error STRUCT<code, message>``.
    Returns ``id, running, complete, succeeded, failed, percent, error_code, error_detail`` (the
    operation's error as it stands, whatever its status) and ``error_message`` (what a failed
    operation is reported with). An id with
    no operation row reads as the reference's fallbacks: not running, complete, not
    succeeded, not failed, no percent, no error.
    """
    req = requested.select(F.col(id_col).alias("id")).distinct()
    # One state per operation: the latest by lastUpdatedTimeUtc when the listing has it
    # (repeated polls), ties and the rest broken by content, so no requested id repeats.
    order = ([F.col("lastUpdatedTimeUtc").alias("_o")]
             if "lastUpdatedTimeUtc" in operations.columns else [])
    w = F.struct(*order, F.col("status").alias("status"),
                 F.col("percentComplete").alias("percentComplete"),
                 F.col("error.code").alias("_code"), F.col("error.message").alias("_msg"))
    ops = (operations.groupBy("id").agg(F.max(w).alias("_w"))
           .select("id", "_w.status", "_w.percentComplete", "_w._code", "_w._msg", F.lit(True).alias("_found")))
    j = req.join(ops, "id", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    status = F.col("status")
    failed = found & F.coalesce(status == F.lit("Failed"), F.lit(False))
    msg = F.when(F.coalesce(F.length("_msg") > 0, F.lit(False)), F.col("_msg")).otherwise(
        F.lit(DEFAULT_FAILURE_MESSAGE))
    return j.select(
        "id",
        (found & F.coalesce(status.isin(*RUNNING_STATES), F.lit(False))).alias("running"),
        (~found | F.coalesce(status.isin(*COMPLETE_STATES), F.lit(False))).alias("complete"),
        (found & F.coalesce(status == F.lit("Succeeded"), F.lit(False))).alias("succeeded"),
        failed.alias("failed"),
        F.col("percentComplete").cast("double").alias("percent"),
        F.col("_code").alias("error_code"), F.col("_msg").alias("error_detail"),
        F.when(failed, msg).alias("error_message"))


def runs_to_cancel(job_runs: DataFrame) -> DataFrame:
    """Ids of job runs whose status is ``InProgress``."""
    return job_runs.where(F.col("status") == F.lit(CANCELLABLE_STATUS)).select("id")


# ---------------------------------------------------------------- rule sets

Rule = tuple[Column, str]


def validate_rows(df: DataFrame, rules: Iterable[Rule], out_col: str = "errors") -> DataFrame:
    """Add ``out_col``: the messages of every rule whose *violation* condition holds.

    A rule is ``(violated, message)``; a null condition counts as no violation, as a
    JavaScript comparison with ``undefined`` is false.
    """
    checks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)) for bad, msg in rules]
    return df.withColumn(out_col, F.array_compact(F.array(*checks)) if checks
                         else F.array().cast("array<string>"))


# Fixed values (must equal the reference): messages and limits of the pool, gateway and
# manifest checks.
POOL_NAME_PATTERN = r"[a-zA-Z0-9\-_ ]+"
POOL_NAME_MAX = 64
RESERVED_POOL_NAME = "starter pool"
INVALID_POOL_NAME = "Invalid pool name"  # ours: the reference returns a boolean
POOL_REQUIRED = (
    ("name", "Pool name is required"),
    ("nodeFamily", "Node family is required"),
    ("nodeSize", "Node size is required"),
    ("autoScale", "Auto scale configuration is required"),
    ("dynamicExecutorAllocation", "Dynamic executor allocation configuration is required"),
)
AUTOSCALE_MESSAGES = (
    "Minimum node count must be at least 1",
    "Maximum node count must be at least 1",
    "Minimum node count cannot be greater than maximum node count",
)
EXECUTOR_MESSAGES = (
    "Minimum executors must be at least 1",
    "Maximum executors must be at least 1",
    "Minimum executors cannot be greater than maximum executors",
)
GATEWAY_INACTIVITY_MINUTES = (30, 60, 90, 120, 150, 240, 360, 480, 720, 1440)
GATEWAY_DEFAULT_INACTIVITY = 1440
GATEWAY_DEFAULT_MEMBERS = 1
GATEWAY_MEMBERS_RANGE = (1, 7)
GATEWAY_NAME_MAX = 200
GATEWAY_MESSAGES = (
    "Invalid inactivityMinutesBeforeSleep. Must be one of: 30, 60, 90, 120, 150, 240, 360, 480, 720, 1440",
    "numberOfMemberGateways must be between 1 and 7",
    "displayName must be 200 characters or less",
)
SEMVER_PATTERN = r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?"  # noqa: E501
GUID_PATTERN = r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}"
WORKLOAD_NAME_PATTERN = r"([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)"
TYPE_NAME_PATTERN = r"([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)"
JOB_TYPE_NAME_PATTERN = r"([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)\.([a-zA-Z0-9-]+)"
# (pattern, min length, max length) of each manifest simple type
MANIFEST_TYPES = {
    "SchemaVersion": (SEMVER_PATTERN, 1, 16),
    "Guid": (GUID_PATTERN, None, None),
    "WorkloadName": (WORKLOAD_NAME_PATTERN, 1, 32),
    "TypeName": (TYPE_NAME_PATTERN, 1, 64),
    "JobTypeName": (JOB_TYPE_NAME_PATTERN, 1, 96),
}


def full_match(c: str | Column, pattern: str) -> Column:
    """XSD patterns match the whole value."""
    return _c(c).rlike(f"\\A(?:{pattern})\\z")


def js_trim(c: str | Column) -> Column:
    """White space of every kind off both ends, as JavaScript's ``trim``."""
    return F.regexp_replace(_c(c), r"(?U)\A[\s\uFEFF]+|[\s\uFEFF]+\z", "")


def pool_name_valid(c: str | Column) -> Column:
    """All of: in the allowed characters, short enough, not blank, not the reserved word."""
    name, bare = _c(c), js_trim(c)
    tests = (full_match(name, POOL_NAME_PATTERN), F.length(name) <= POOL_NAME_MAX, bare != F.lit(""),
             F.lower(bare) != F.lit(RESERVED_POOL_NAME))
    return F.coalesce(functools.reduce(operator.and_, tests), F.lit(False))


def _min_max_rules(min_c: Column, max_c: Column, messages) -> list[Rule]:
    return [(min_c < 1, messages[0]), (max_c < 1, messages[1]), (min_c > max_c, messages[2])]


def pool_rules(name="name", node_family="nodeFamily", node_size="nodeSize",
               auto_scale="autoScale", allocation="dynamicExecutorAllocation") -> list[Rule]:
    """Required fields, pool-name validity, autoscale and executor-allocation limits."""
    cols = dict(zip([k for k, _ in POOL_REQUIRED],
                    [name, node_family, node_size, auto_scale, allocation]))
    rules: list[Rule] = []
    for key, msg in POOL_REQUIRED:
        c = F.col(cols[key])
        text = {"name": js_trim(c), "nodeFamily": c, "nodeSize": c}.get(key)  # empty text is missing too
        missing = c.isNull() if text is None else c.isNull() | (text == F.lit(""))
        rules.append((missing, msg))
    rules.append((F.col(name).isNotNull() & ~pool_name_valid(name), INVALID_POOL_NAME))
    rules += _min_max_rules(F.col(f"{auto_scale}.minNodeCount"),
                            F.col(f"{auto_scale}.maxNodeCount"), AUTOSCALE_MESSAGES)
    rules += _min_max_rules(F.col(f"{allocation}.minExecutors"),
                            F.col(f"{allocation}.maxExecutors"), EXECUTOR_MESSAGES)
    return rules


def _or_default(c: Column, default: int) -> Column:
    """JavaScript ``value || default`` for numbers: null and 0 take the default."""
    return F.when(F.coalesce(c != 0, F.lit(False)), c).otherwise(F.lit(default))


def gateway_rules(inactivity="inactivityMinutesBeforeSleep",
                  members="numberOfMemberGateways", display_name="displayName") -> list[Rule]:
    minutes = _or_default(F.col(inactivity), GATEWAY_DEFAULT_INACTIVITY)
    count = _or_default(F.col(members), GATEWAY_DEFAULT_MEMBERS)
    lo, hi = GATEWAY_MEMBERS_RANGE
    return [
        (~minutes.isin(*GATEWAY_INACTIVITY_MINUTES), GATEWAY_MESSAGES[0]),
        ((count < lo) | (count > hi), GATEWAY_MESSAGES[1]),
        (F.length(F.col(display_name)) > GATEWAY_NAME_MAX, GATEWAY_MESSAGES[2]),
    ]


def manifest_rules(columns: dict[str, str]) -> list[Rule]:
    """``{column: simple type}`` → length and full-match pattern rules per column."""
    rules: list[Rule] = []
    for col, kind in columns.items():
        pattern, lo, hi = MANIFEST_TYPES[kind]
        c = F.col(col)
        bad = ~full_match(c, pattern)
        if lo is not None:
            bad = bad | (F.length(c) < lo)
        if hi is not None:
            bad = bad | (F.length(c) > hi)
        rules.append((c.isNotNull() & bad, f"{col} is not a valid {kind}"))
    return rules


# ---------------------------------------------------------------- naming chain

def validate_prefix_chain(packages: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Hierarchical naming rule of a workload package, as violation rows.

    * ``packages``: ``package, workloadName``
    * ``items``: ``package, itemFile, itemWorkloadName, typeName``
    * ``jobs``: ``package, itemFile, jobName``

    Violations (``package, subject, message``): the item's workload differs from the
    package's; the item type does not start with ``<workload>.``; a job type does not
    start with ``<item type>.``. Workload names are compared without regard to case; the
    prefix tests are case-sensitive.
    """
    it = items.join(packages, "package", "left")
    wl_mismatch = it.where(~F.lower("itemWorkloadName").eqNullSafe(F.lower("workloadName"))).select(
        "package", F.col("itemFile").alias("subject"),
        F.concat(F.lit("Non matching WorkloadName between WorkloadManifest.xml and "),
                 F.col("itemFile")).alias("message"))
    bad_item = it.where(~F.coalesce(F.startswith(
        F.col("typeName"), F.concat(F.col("itemWorkloadName"), F.lit("."))), F.lit(False))).select(
        "package", F.col("typeName").alias("subject"),
        F.concat(F.lit("Item name's prefix should be WorkloadName for item "),
                 F.coalesce(F.col("typeName"), F.lit(""))).alias("message"))
    jb = jobs.join(items.select("package", "itemFile", "typeName"), ["package", "itemFile"], "left")
    bad_job = jb.where(~F.coalesce(F.startswith(
        F.col("jobName"), F.concat(F.col("typeName"), F.lit("."))), F.lit(False))).select(
        "package", F.col("jobName").alias("subject"),
        F.concat(F.lit("Job type name's prefix should be ItemName for jobType "),
                 F.coalesce(F.col("jobName"), F.lit(""))).alias("message"))
    return wl_mismatch.unionByName(bad_item).unionByName(bad_job)
