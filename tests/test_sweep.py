"""The sweep over sorted paths and patterns, and role-set classes, against the rules row by row."""

import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import access


def _roles(spark, rules, members=()):
    rows = [(r, r, [("Permit", [("Path", list(p))])], ([], [("t", m, "User") for m in who])) for r, p, who in
            ((r, p, dict(members).get(r, [])) for r, p in rules.items())]
    return spark.createDataFrame(rows, access.ROLE_SCHEMA)


def _random_case(seed):
    rng = random.Random(seed)
    piece = ["a", "ab", "b", "é", "z", "%", "_", "~"]
    def path(n):
        return "/".join(rng.choice(piece) for _ in range(n))
    paths = [path(rng.randint(1, 5)) for _ in range(150)] + ["", None, "a", "a", "~~~"]
    rules = {f"r{i}": [rng.choice(["*", "", "a", path(1), path(2), path(3)[:-1], path(4), "zz"]) for _ in range(rng.randint(1, 4))]
             for i in range(12)}
    members = {r: [f"m{rng.randrange(6)}" for _ in range(rng.randint(0, 3))] for r in rules}
    members["r0"], rules["r0"] = ["all"], ["*"]
    return paths, rules, members


def _grants(pattern, path, mode):
    if pattern in ("*", ""):
        return True
    if mode == "reference":
        return path.startswith(pattern)
    p = pattern.rstrip("/")
    return path == p or path.startswith(p + "/") or p == ""


@pytest.mark.parametrize("mode", ["reference", "segment"])
@pytest.mark.parametrize("seed,partitions", [(1, "1"), (2, "9"), (3, "40")])
def test_roles_for_path(spark, mode, seed, partitions):
    paths, rules, members = _random_case(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)
        got = sorted(map(tuple, access.roles_for_path(df, _roles(spark, rules), mode=mode).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted({(r, p) for r, ps in rules.items() for x in ps for p in paths if p is not None and _grants(x, p, mode)})
    assert got == want


def test_rows_do_not_grow_with_pattern_lengths(spark):
    paths = spark.range(500).select(F.concat(F.lit("base/"), F.lpad(F.col("id").cast("string"), 60, "x")).alias("path"))
    rules = {"long": ["base/" + "x" * n for n in range(50)]}
    keys = access._match_keys(access.path_patterns(_roles(spark, rules)), "reference")
    chains = access.pattern_chains(keys)
    assert access.path_classes(paths, chains).count() == 500
    assert "Generate" not in access.path_classes(paths, access.materialize(chains))._jdf.queryExecution().executedPlan().toString()


def test_access_classes_unfold_to_the_matrix(spark):
    paths, rules, members = _random_case(5)
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    roles = _roles(spark, rules, members.items())
    want = {}
    for r, ps in rules.items():
        for m in members[r]:
            for p in {p for p in paths if p is not None and any(_grants(x, p, "reference") for x in ps)}:
                want.setdefault((m, p), set()).add(r)
    got = {(r.objectId, r.path): r.roles for r in access.access_matrix(df, roles).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    c = access.access_classes(df, roles)
    sets = {frozenset(r for r, ps in rules.items() if any(_grants(x, p, "reference") for x in ps)) for p in paths if p is not None}
    owner = c.members.where("objectId = 'all'").first()["member_class"]
    assert c.access.where(F.col("member_class") == owner).count() == len(sets)  # one row a path class, not a path
    some = spark.createDataFrame([("m1",)], "objectId string")
    got = {(r.objectId, r.path): r.roles for r in access.access_matrix(df, roles, identities=some).collect()}
    assert got == {k: sorted(v) for k, v in want.items() if k[0] == "m1"}
