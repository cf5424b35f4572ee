import base64
import json

from pyspark.sql import functions as F

from conftest import rows
from lakeops.functions import b64_encode
from lakeops.operators import links as L
from lakeops.operators import nested as N


def test_resolve_names_last_wins(spark):
    tags = spark.createDataFrame([("t1", "Red", 1), ("t2", "red", 2), ("t3", "Blue", 3), ("t4", None, 4)],
                                 "id string, name string, ord int")
    req = spark.createDataFrame([("i", "RED"), ("i", "green"), ("j", "blue")], "itemId string, name string")
    got = rows(L.resolve_names(tags, req), "itemId", "name", "match_id", "found")
    assert got == sorted([("i", "RED", "t2", True), ("i", "green", None, False), ("j", "blue", "t3", True)], key=repr)


def test_links(spark):
    links = spark.createDataFrame([("i", "a"), ("i", "b")], "itemId string, tagId string")
    new = spark.createDataFrame([("i", "b"), ("j", "a")], "itemId string, tagId string")
    assert rows(L.apply_links(links, new)) == [("i", "a"), ("i", "b"), ("j", "a")]
    assert rows(L.remove_links(links, new)) == [("i", "a")]


def test_assignments_missing_shared_revoke(spark):
    res = spark.createDataFrame([("g1", "one"), ("g2", "two"), ("g3", "three")], "id string, displayName string")
    asg = spark.createDataFrame([("a1", "g1", ("p1", "User", "P"), "Admin"), ("a2", "g2", ("p1", "User", "P"), "User"),
                                 ("a3", "g2", ("p2", "User", "Q"), "Admin")],
                                "id string, resourceId string, principal struct<id:string,type:string,"
                                "displayName:string>, role string")
    p1 = spark.createDataFrame([("p1",)], "principalId string")
    assert rows(L.assignments_for_principal(res, asg, p1), "id", "role") == [("g1", "Admin"), ("g2", "User")]
    assert rows(L.admins(res, asg)) == [("g1", "p1"), ("g2", "p2")]
    req = spark.createDataFrame([("g1",), ("g9",), ("g9",)], "id string")
    assert rows(L.missing_ids(req, res)) == [("g9",)]
    shares = spark.createDataFrame([("s1", ["a/b", "c"], "Active"), ("s2", ["d"], "Revoked"), ("s3", ["c"], "Pending")],
                                   "id string, paths array<string>, status string")
    paths = spark.createDataFrame([("a/b",), ("a",), ("d",), ("c",)], "path string")
    assert rows(L.shared_paths(paths, shares)) == [("a", False), ("a/b", True), ("c", True), ("d", False)]
    ids = spark.createDataFrame([("s1",)], "id string")
    assert rows(L.revoke_by_ids(shares, ids), "id", "status") == [("s1", "Revoked"), ("s2", "Revoked"),
                                                                  ("s3", "Pending")]


def test_patch_rows_keeps_unset_fields(spark):
    base = spark.createDataFrame([("a", True, ("Daily", 1)), ("b", False, ("Weekly", 2))],
                                 "id string, enabled boolean, cfg struct<type:string,n:int>")
    patch = spark.createDataFrame([("a", False, None)], "id string, enabled boolean, cfg struct<type:string,n:int>")
    got = {r["id"]: (r["enabled"], r["cfg"]["type"]) for r in L.patch_rows(base, patch, "id").collect()}
    assert got == {"a": (False, "Daily"), "b": (False, "Weekly")}
    two = spark.createDataFrame([("b", True, None, 2), ("b", False, ("Daily", 9), 1)],
                                "id string, enabled boolean, cfg struct<type:string,n:int>, seq int")
    out = L.patch_rows(base, two, "id", order_col="seq")
    assert out.count() == 2
    b = out.where("id = 'b'").collect()[0]
    assert b["enabled"] is True and b["cfg"]["type"] == "Daily"  # each field takes its last given value


def test_shortcut_policies(spark):
    T = "struct<type:string>"
    existing = spark.createDataFrame([("F", "a", ("S3",))], f"path string, name string, target {T}")
    reqs = spark.createDataFrame([(1, "F", "a", ("OneLake",)), (2, "F", "b", ("OneLake",)), (3, "F", "b", ("S3",))],
                                 f"req_id int, path string, name string, target {T}")
    out = {}
    for p in L.CONFLICT_POLICIES:
        result, outcomes = L.apply_shortcut_requests(existing, reqs, p)
        out[p] = (rows(outcomes, "req_id", "name", "status"), rows(result, "name", "target"))
    assert out["Abort"][0] == [(1, "a", "Conflict"), (2, "b", "Created"), (3, "b", "Conflict")]
    assert out["GenerateUniqueName"][0] == [(1, "a_1", "CreatedWithNewName"), (2, "b", "Created"),
                                            (3, "b_3", "CreatedWithNewName")]
    assert out["CreateOrOverwrite"][1] == [("a", ("OneLake",)), ("b", ("OneLake",))]
    assert out["OverwriteOnly"][0] == [(1, "a", "Overwritten"), (2, "b", "NotFound"), (3, "b", "NotFound")]


def b64(s):
    return base64.b64encode(s.encode("utf-8")).decode()


def test_unpack_keeps_good_parts_and_utf8(spark):
    items = spark.createDataFrame([("i1", "T", "name", None), ("i2", "T", "n2", "d")],
                                  "id string, type string, displayName string, description string")
    parts = [
        ("i1", None, [("payload.json", b64(json.dumps({"k": "héllo ✓"})), "InlineBase64"),
                      (".platform", b64(json.dumps({"metadata": {"displayName": "Über"}})), "InlineBase64"),
                      ("extra.bin", "AAEC", "InlineBase64")]),
        ("i2", None, [("payload.json", "@@", "InlineBase64"), ("extra", "x", None)]),
    ]
    defs = spark.createDataFrame(parts, f"itemId string, format string, parts array<{N.PART_TYPE}>")
    out = {r["id"]: r for r in N.unpack_definitions(items, defs, '{"k": "default"}').select(
        "id", "type", "displayName", "description", F.to_json("definition").alias("d"),
        F.transform("additionalParts", lambda p: p["path"]).alias("extra")).collect()}
    assert json.loads(out["i1"]["d"]) == {"k": "héllo ✓"} and out["i1"]["displayName"] == "Über"
    assert out["i1"]["extra"] == ["extra.bin"] and out["i1"]["type"] == "T"
    assert json.loads(out["i2"]["d"]) == {"k": "default"} and out["i2"]["extra"] == ["extra"]


def test_pack_round_trip_and_one_line_base64(spark):
    doc = {"text": "x" * 200, "n": [1, 2], "ü": True}
    items = spark.createDataFrame([("i", json.dumps(doc))], "id string, definition string")
    packed = N.pack_definitions(items).collect()[0]
    part = packed["parts"][0]
    assert part["path"] == "payload.json" and part["payloadType"] == "InlineBase64"
    assert "\n" not in part["payload"] and "\r" not in part["payload"]
    assert json.loads(base64.b64decode(part["payload"]).decode("utf-8")) == doc
    long = spark.range(1).select(b64_encode(F.lit("y" * 500)).alias("b")).collect()[0]["b"]
    assert base64.b64decode(long) == b"y" * 500


def test_normalize_parts(spark):
    bodies = spark.createDataFrame([
        ('{"definition": {"parts": [{"path": "a", "payload": "x"}, {"path": "b", "payload": "y", "payloadType": "Z"}]}}',),
        ('{"definition": {}}',), ("not json",), ('{"definition": {"parts": 3}}',)], "body string")
    got = [r["definition"] for r in N.normalize_parts(bodies).collect()]
    assert [p["payloadType"] for p in got[0]["parts"]] == ["InlineBase64", "Z"]
    assert got[1:] == [None, None, None]


def test_load_page_dumps_shapes(spark):
    pages = spark.createDataFrame([
        ('{"value": [{"a": 1}, {"a": 2}], "continuationToken": "t"}',), ('[{"a": 3}]',), ('{"a": 4}',),
        ('{"value": 5}',), ("broken",), ('{"value": []}',)], "page string")
    got = sorted(r[0] for r in N.load_page_dumps(pages, skip_errors=True).select(F.to_json("item")).collect())
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":4}', '{"value":5}']


def test_random_name_resolution_matches_a_js_map(spark):
    import random
    rnd = random.Random(3)
    words = ["Ops", "ops", "OPS", "Data_%", "data_%", "Ünï", "ünï", "x"]
    tags = [(f"t{i}", rnd.choice(words), i) for i in range(40)]
    req = [(f"i{j}", rnd.choice(words + ["missing", "DATA_%"])) for j in range(60)]
    js_map = {}
    for tid, name, _ in tags:  # new Map(tags.map(t => [t.name.toLowerCase(), t])): last wins
        js_map[name.lower()] = tid
    want = sorted(((i, n, js_map.get(n.lower()), n.lower() in js_map) for i, n in req), key=repr)
    got = rows(L.resolve_names(spark.createDataFrame(tags, "id string, name string, ord int"),
                               spark.createDataFrame(req, "itemId string, name string")),
               "itemId", "name", "match_id", "found")
    assert got == want


def test_random_shortcut_batches_follow_the_policy_rules(spark):
    import random
    rnd = random.Random(5)
    T = "struct<type:string>"
    existing = sorted({("F", rnd.choice("abcdef")) for _ in range(4)})
    reqs = [(k, "F", rnd.choice("abcdefgh")) for k in range(1, 13)]
    ex_df = spark.createDataFrame([(p, n, ("S3",)) for p, n in existing], f"path string, name string, target {T}")
    rq_df = spark.createDataFrame([(k, p, n, ("OneLake",)) for k, p, n in reqs],
                                  f"req_id int, path string, name string, target {T}")
    first = {}
    for k, p, n in sorted(reqs):
        first.setdefault((p, n), k)
    have = set(existing)
    for policy in L.CONFLICT_POLICIES:
        want = []
        for k, p, n in reqs:
            ex, is_first = (p, n) in have, first[(p, n)] == k
            if policy == "Abort":
                want.append((k, n, "Conflict" if ex or not is_first else "Created"))
            elif policy == "GenerateUniqueName":
                want.append((k, f"{n}_{k}", "CreatedWithNewName") if ex or not is_first else (k, n, "Created"))
            elif policy == "CreateOrOverwrite":
                want.append((k, n, "Duplicate" if not is_first else "Overwritten" if ex else "Created"))
            else:
                want.append((k, n, "NotFound" if not ex else "Duplicate" if not is_first else "Overwritten"))
        result, outcomes = L.apply_shortcut_requests(ex_df, rq_df, policy)
        assert rows(outcomes, "req_id", "name", "status") == sorted(want, key=repr), policy
        names = [r[0] for r in result.select("name").collect()]
        assert len(names) == len(set(names)), policy  # never two shortcuts with one name
