"""Paths through shortcuts that lie below other shortcuts.

A *mount* is a shortcut as two paths: ``mount`` (where it sits) and ``target`` (what it shows, a lake path
or a URI outside). A path is resolved by rewriting its longest mount prefix, on ``/`` borders, to
that mount's target, again and again until no mount covers it. Every round is one join of the
paths that still move; rounds are checkpointed.

A chain that never ends is found exactly: the part of the path behind the mount is a stack that
rewriting eats from. If a mount is used again and nothing behind its first use was touched
in between, the same steps repeat forever; and every endless chain comes to that point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.session import materialize

_TRAIL = "array<struct<mount:string,behind:int>>"


def _clean(c):
    return F.regexp_replace(c, "/+$", "")


def _mounts(mounts: DataFrame, mount_col: str, target_col: str) -> DataFrame:
    """``(_mount, _target)``, one target per mount (the greatest)."""
    return (mounts.where(F.col(mount_col).isNotNull() & F.col(target_col).isNotNull())
            .groupBy(_clean(F.col(mount_col)).alias("_mount")).agg(F.max(_clean(F.col(target_col))).alias("_target")))


def resolve_paths(paths: DataFrame, mounts: DataFrame, path_col: str = "path", mount_col: str = "mount",
                  target_col: str = "target") -> DataFrame:
    """``(path, resolved, hops, loop)`` of every distinct path: where it lies once all shortcuts are followed.

    ``hops`` counts the shortcuts on the way. A path that runs in a loop has ``loop`` true and a null
    ``resolved``; its ``hops`` are those until the loop is known. A path under no mount resolves to itself.
    Null paths are left out. Of two targets for one mount the greater is used.
    """
    known = materialize(_mounts(mounts, mount_col, target_col))
    start = paths.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path")).distinct()
    moving = materialize(start.select("path", _clean(F.col("path")).alias("at"), F.lit(0).alias("hops"), F.array().cast(_TRAIL).alias("trail")))
    ended = []
    while True:
        segs = F.split("at", "/", -1)
        heads = moving.select("path", "at", F.explode(F.sequence(F.lit(1), F.size(segs))).alias("n"))
        heads = heads.select("path", "n", F.array_join(F.slice(F.split("at", "/", -1), F.lit(1), F.col("n")), "/").alias("_mount"))
        hit = heads.join(known, "_mount").groupBy("path").agg(F.max(F.struct("n", "_mount", "_target")).alias("hit"))
        hit = materialize(hit.select("path", "hit.*"))
        ended.append(moving.join(hit, "path", "left_anti").select("path", F.col("at").alias("resolved"), "hops", F.lit(False).alias("loop")))
        met = moving.join(hit, "path").withColumn("behind", F.size(segs) - F.col("n"))
        rest = F.slice(segs, F.col("n") + 1, F.col("behind"))
        # What later uses have eaten from leaves the stack.
        again = F.exists("trail", lambda t: (t["behind"] <= F.col("behind")) & (t["mount"] == F.col("_mount")))
        left = F.filter("trail", lambda t: t["behind"] <= F.col("behind"))
        stepped = materialize(met.select(
            "path", "hops", F.concat_ws("/", "_target", F.when(F.col("behind") > 0, F.array_join(rest, "/"))).alias("to"),
            again.alias("loop"), F.concat(left, F.array(F.struct(F.col("_mount").alias("mount"), "behind"))).alias("stack")))
        ended.append(stepped.where("loop").select("path", F.lit(None).cast("string").alias("resolved"), "hops", "loop"))
        moving = stepped.where("not loop").select("path", F.col("to").alias("at"), (F.col("hops") + 1).alias("hops"), F.col("stack").alias("trail"))
        if moving.isEmpty():
            break
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def nested_mounts(mounts: DataFrame, mount_col: str = "mount", target_col: str = "target") -> DataFrame:
    """``(shortcutPath, targetRoot, depth, loop)``: every place where a shortcut's content can be seen.

    A shortcut is seen where it sits (depth 1) and again below every shortcut that shows the folder it
    sits in. Targets are resolved first (:func:`resolve_paths`). A shortcut that would be seen inside
    itself is reported once with ``loop`` true and not followed; so is one whose target does not resolve (null
    ``targetRoot``). The result is what ``expand_shortcut`` takes (its rows without ``loop``).
    """
    base = _mounts(mounts, mount_col, target_col)
    real = resolve_paths(base, base, "_target", "_mount", "_target").select(
        F.col("path").alias("_target"), F.col("resolved").alias("root"), F.col("loop").alias("lost"))
    base = materialize(base.join(real, "_target").select(F.col("_mount").alias("mount"), "root", "lost"))
    # A mount is found by the folders above it.
    steps = F.split("mount", "/", -1)
    above = base.where("not lost").select("mount", F.col("root").alias("_root"), F.explode(F.sequence(F.lit(1), F.size(steps) - 1)).alias("n"))
    above = materialize(above.select("mount", "_root", F.array_join(F.slice(F.split("mount", "/", -1), F.lit(1), F.col("n")), "/").alias("root")))
    level = materialize(base.select(F.col("mount").alias("shortcutPath"), "root", F.array("mount").alias("via"), F.col("lost").alias("loop")))
    levels, depth = [], 1
    while True:
        levels.append(level.select("shortcutPath", F.when(~F.col("loop"), F.col("root")).alias("targetRoot"), F.lit(depth).alias("depth"), "loop"))
        inner = level.where("not loop").join(above, "root").select(
            F.concat("shortcutPath", F.expr("substring(mount, length(root) + 1)")).alias("shortcutPath"),
            F.col("_root").alias("root"), F.array_append("via", F.col("mount")).alias("via"),
            F.array_contains("via", F.col("mount")).alias("loop"))
        level = materialize(inner)
        if level.isEmpty():
            break
        depth += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out
