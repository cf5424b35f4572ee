from pyspark.sql import functions as F

from conftest import rows
from lakeops.operators import access

ROLE_DDL = ("id string, name string, decisionRules array<struct<effect:string, permission:array<struct<"
            "attributeName:string, attributeValueIncludedIn:array<string>>>>>, members struct<"
            "fabricItemMembers:array<struct<itemAccess:array<string>,sourcePath:string>>, "
            "microsoftEntraMembers:array<struct<tenantId:string,objectId:string,objectType:string>>>")


def perm(attr, *vals):
    return {"attributeName": attr, "attributeValueIncludedIn": list(vals)}


def role(rid, rules, members=()):
    return {"id": rid, "name": rid,
            "decisionRules": [{"effect": "Permit", "permission": r} for r in rules],
            "members": {"fabricItemMembers": [],
                        "microsoftEntraMembers": [{"tenantId": "t", "objectId": m, "objectType": "User"}
                                                  for m in members]}}


def roles_df(spark):
    data = [
        role("sales", [[perm("Path", "Tables/Sales")]], ["alice"]),
        role("all", [[perm("Path", "*")]], ["bob"]),
        # only the first Path permission counts; the second would grant everything
        role("first", [[perm("Action", "Read"), perm("Path", "Files/x"), perm("Path", "")]], ["alice", "carol"]),
        role("exact", [[perm("Path", "Files/y.txt")], [perm("Action", "Read")]], []),
        role("none", [[perm("Action", "Read")]], ["dave"]),
        role("empty", [], []),
    ]
    return spark.createDataFrame(data, ROLE_DDL)


def paths_df(spark):
    return spark.createDataFrame(
        [("Tables/Sales",), ("Tables/SalesOld",), ("Tables/Other",), ("Files/x/a.csv",),
         ("Files/y.txt",), ("Files/xy",), (None,)], "path string")


def test_roles_for_path_reference_mode(spark):
    got = rows(access.roles_for_path(paths_df(spark), roles_df(spark)))
    want = sorted([
        ("sales", "Tables/Sales"), ("sales", "Tables/SalesOld"),  # not segment-aligned
        ("first", "Files/x/a.csv"), ("first", "Files/xy"),
        ("exact", "Files/y.txt"),
    ] + [("all", p) for p in ["Tables/Sales", "Tables/SalesOld", "Tables/Other", "Files/x/a.csv",
                               "Files/y.txt", "Files/xy"]], key=repr)
    assert got == want


def test_roles_for_path_segment_mode(spark):
    got = rows(access.roles_for_path(paths_df(spark), roles_df(spark), mode="segment"))
    assert ("sales", "Tables/SalesOld") not in got
    assert ("sales", "Tables/Sales") in got
    assert ("first", "Files/xy") not in got and ("first", "Files/x/a.csv") in got


def test_role_path_counts_include_zero(spark):
    got = dict(rows(access.role_path_counts(paths_df(spark), roles_df(spark))))
    assert got == {"sales": 2, "all": 6, "first": 2, "exact": 1, "none": 0, "empty": 0}


def test_roles_for_path_plan_is_equi_join(spark):
    plan = access.roles_for_path(paths_df(spark), roles_df(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan.split("Subquery")[0]


def test_explode_rules(spark):
    got = rows(access.explode_rules(roles_df(spark)).where(F.col("role_id") == "first"),
               "rule_idx", "perm_idx", "attributeName", "value")
    assert got == [(0, 0, "Action", "Read"), (0, 1, "Path", "Files/x"), (0, 2, "Path", "")]


def test_roles_for_member_and_summary(spark):
    r = roles_df(spark)
    ids = spark.createDataFrame([("alice",), ("zed",)], "objectId string")
    assert rows(access.roles_for_member(r, ids)) == [("alice", "first"), ("alice", "sales")]
    summary = {o: (n, p) for o, n, p in rows(access.access_summary(paths_df(spark), r))}
    # alice: sales (2 paths) + first (2 paths) -> 4 distinct; bob: all 6; dave: none
    assert summary["alice"] == (2, 4) and summary["bob"] == (1, 6) and summary["dave"] == (1, 0)
    matrix = rows(access.access_matrix(paths_df(spark), r).where(F.col("objectId") == "alice"),
                  "path", "roles")
    assert ("Tables/Sales", ["sales"]) in matrix and len(matrix) == 4


def test_large_pattern_tables_use_a_shuffle_join(spark):
    """Beyond the broadcast bound the prefix join is a shuffle join (AQE splits skew).

    Spark's own size-checked auto-broadcast is switched off here so the fallback shows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grants = access.roles_for_path(paths_df(spark), roles_df(spark))
        plan = grants._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        got = rows(grants)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert got == rows(access.roles_for_path(paths_df(spark), roles_df(spark)))


def test_counts_without_pairs_match_pairwise_counts(spark):
    """Overlapping patterns in one role and across a member's roles are counted once."""
    data = [
        role("ov", [[perm("Path", "Files/a", "Files/ab", "Files/a")], [perm("Path", "Files/abc/x")]], ["m1"]),
        role("w", [[perm("Path", "Files/b")], [perm("Path", "")]], ["m2"]),
        role("p", [[perm("Path", "Files/ab")]], ["m1", "m2"]),
        role("q", [[perm("Path", "Tables")]], ["m1"]),
    ]
    r = spark.createDataFrame(data, ROLE_DDL)
    p = spark.createDataFrame([(x,) for x in ["Files/a", "Files/ab", "Files/abc/x/y", "Files/b/z",
                                              "Tables/t", "Tables2/u", "Files/ab"]], "path string")
    for mode in ("reference", "segment"):
        pairs = access.roles_for_path(p, r, mode=mode)
        want = dict(rows(pairs.groupBy("role_id").count()))
        got = {k: v for k, v in rows(access.role_path_counts(p, r, mode=mode)) if v}
        assert got == want, mode
        mem = rows(access.roles_for_member(r).join(pairs, "role_id")
                   .groupBy("objectId").agg(F.countDistinct("path")))
        summ = [(o, n) for o, _, n in rows(access.access_summary(p, r, mode=mode))]
        assert summ == mem, mode


def test_random_prefix_rules_match_brute_force(spark):
    """roles_for_path and the pair-free counts against the reference rule written out."""
    import random
    for seed in range(3):
        rnd = random.Random(seed)
        word = lambda: "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 4)))
        roles_py = {}
        data = []
        for r in range(8):
            rules = []
            for _ in range(rnd.randint(0, 2)):
                perms = []
                for _ in range(rnd.randint(0, 3)):
                    attr = rnd.choice(["Path", "Path", "Action"])
                    vals = [rnd.choice(["*", word()]) for _ in range(rnd.randint(0, 3))]
                    perms.append(perm(attr, *vals))
                rules.append(perms)
            roles_py[f"r{r}"] = rules
            data.append(role(f"r{r}", rules, [f"m{r % 3}"]))
        paths = sorted({word() for _ in range(25)})
        want = set()
        for rid, rules in roles_py.items():
            for perms in rules:
                first = next((p for p in perms if p["attributeName"] == "Path"), None)
                if first is None:
                    continue
                for path in paths:
                    if any(v == "*" or v == path or path.startswith(v) for v in first["attributeValueIncludedIn"]):
                        want.add((rid, path))
        r_df = spark.createDataFrame(data, ROLE_DDL)
        p_df = spark.createDataFrame([(x,) for x in paths], "path string")
        assert set(rows(access.roles_for_path(p_df, r_df))) == want, seed
        counts = dict(rows(access.role_path_counts(p_df, r_df)))
        assert counts == {rid: sum(1 for g in want if g[0] == rid) for rid in roles_py}, seed


def test_pair_free_counts_same_beyond_broadcast_bound(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("reference", "segment"):
            a = rows(access.role_path_counts(paths_df(spark), roles_df(spark), mode=mode))
            b = rows(access.role_path_counts(paths_df(spark), roles_df(spark), mode=mode))
            c = rows(access.access_summary(paths_df(spark), roles_df(spark), mode=mode))
            d = rows(access.access_summary(paths_df(spark), roles_df(spark), mode=mode))
            assert a == b and c == d, mode
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_access_matrix_for_some_members(spark):
    ids = spark.createDataFrame([("carol",)], "objectId string")
    got = rows(access.access_matrix(paths_df(spark), roles_df(spark), identities=ids), "objectId", "path", "roles")
    assert got == [("carol", "Files/x/a.csv", ["first"]), ("carol", "Files/xy", ["first"])]


def test_distinct_paths_switch(spark):
    uniq = paths_df(spark).where("path <> 'Files/ab'").distinct()
    a = rows(access.role_path_counts(uniq, roles_df(spark)))
    b = rows(access.role_path_counts(uniq, roles_df(spark), distinct_paths=False))
    assert a == b
