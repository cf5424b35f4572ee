from pyspark.sql import functions as F

from conftest import rows
from lakeops.operators import hierarchy as H
from lakeops.operators import paths as P

LISTING = "name string, isDirectory boolean, isShortcut boolean, accountType string"


def test_path_parts_and_list_directory(spark):
    df = spark.createDataFrame([("item/Files/x/y.txt", False, False, None), ("item/Files/x", True, False, None),
                                ("item/Files/z/", True, False, None), ("solo", False, False, None)], LISTING)
    got = rows(P.path_parts(df), "name", "relativePath")
    assert got == sorted([("y.txt", "Files/x/y.txt"), ("x", "Files/x"), ("", "Files/z/"), ("solo", "")], key=repr)
    lv = rows(P.list_directory(df, "item", "Files/x"), "rootFolder", "name")
    assert lv == [("Files", "y.txt")]
    assert rows(P.list_directory(df, "item", "Files"), "name") == [("x",)]


def test_discover_tables(spark):
    df = spark.createDataFrame([
        ("item/Tables/t1/_delta_log", True, False, None),
        ("item/Tables/dbo/t2/_delta_log", True, False, None),
        ("item/Tables/a/b/t3/_delta_log", True, False, None),
        ("item/Tables/t1/part-0.parquet", False, False, None),
        ("item/Tables/ext", True, True, "ADLS"),
        ("item/Tables/ext2", True, True, "ExternalADLS"),
        ("item/Tables/s3", True, True, "S3"),
    ], LISTING)
    got = rows(P.discover_tables(df), "name", "relativePath", "schema")
    assert got == sorted([("t1", "Tables/t1/", None), ("t2", "Tables/dbo/t2/", "dbo"),
                          ("t3", "Tables/a/b/t3/", None), ("ext", "Tables/ext/", None),
                          ("ext2", "Tables/ext2/", None)], key=repr)
    grouped = rows(P.tables_by_schema(P.discover_tables(df)), "schema", "name", "n_tables")
    assert (None, "t1", 4) in grouped and ("dbo", "t2", 1) in grouped


def test_build_tree_order_independent(spark):
    files = spark.createDataFrame([
        ("b.txt", "Files/d/b.txt", False), ("a.txt", "Files/d/a.txt", False), ("e", "Files/d/e", True),
        ("d", "Files/d", True), ("c.txt", "Files/d/e/c.txt", False), ("orphan.txt", "Files/q/orphan.txt", False),
    ], "name string, relativePath string, isDirectory boolean")
    tree = P.build_tree(files)
    got = {r["relativePath"]: r["parentPath"] for r in tree.collect()}
    assert got["Files/d/e"] == "Files/d" and got["Files/d/e/c.txt"] == "Files/d/e"
    assert got["Files/d"] is None and got["Files/q/orphan.txt"] is None  # unknown parent -> root
    sibs = [r["name"] for r in tree.collect() if r["parentPath"] == "Files/d"]
    assert sibs == ["e", "a.txt", "b.txt"]  # folders first, then by name


def test_expand_shortcut(spark):
    listing = spark.createDataFrame([("w/Files/src/a", True), ("w/Files/src/a/f.csv", False),
                                     ("w/Files/other/g.csv", False)], "name string, isDirectory boolean")
    sc = spark.createDataFrame([("Files/link", "w/Files/src")], "shortcutPath string, targetRoot string")
    got = rows(P.expand_shortcut(listing, sc), "relativePath", "name")
    assert got == [("Files/link/a", "a"), ("Files/link/a/f.csv", "f.csv")]


FOLDERS = "id string, displayName string, parentFolderId string"


def folders(spark):
    return spark.createDataFrame([
        ("1", "root", None), ("2", "a", "1"), ("3", "b", "2"), ("4", "c", "1"),
        ("5", "lost", "404"), ("6", "x", "7"), ("7", "y", "6"),  # 5: missing parent; 6/7: a cycle
    ], FOLDERS)


def test_folder_path_subtree_empty(spark):
    fp = {r["id"]: r["path"] for r in H.folder_path(folders(spark)).collect()}
    assert fp == {"1": ["root"], "2": ["root", "a"], "3": ["root", "a", "b"], "4": ["root", "c"], "5": ["lost"]}
    assert rows(H.folder_subtree(folders(spark), "1"), "id", "depth") == [("2", 1), ("3", 2), ("4", 1)]
    assert rows(H.folder_subtree(folders(spark), "1", recursive=False), "id") == [("2",), ("4",)]
    assert rows(H.folder_subtree(folders(spark), "6"), "id") == [("7",)]  # cycle through the root stops
    assert rows(H.empty_folders(folders(spark)), "id") == [("3",), ("4",), ("5",)]


def test_ensure_folder_paths(spark):
    req = spark.createDataFrame([(1, ["root", "a", "new", "deep"]), (2, ["root", "a", "new"]), (3, [])],
                                "request int, segments array<string>")
    created, resolved = H.ensure_folder_paths(folders(spark), req)
    c = {r["pathText"]: r for r in created.collect()}
    assert set(c) == {"root/a/new", "root/a/new/deep"}
    assert c["root/a/new"]["parentFolderId"] == "2"
    assert c["root/a/new/deep"]["parentFolderId"] == c["root/a/new"]["id"]
    res = {r["request"]: r for r in resolved.collect()}
    assert res[2]["folderId"] == c["root/a/new"]["id"] and res[3]["error"] == H.EMPTY_PATH_ERROR


def test_move_nodes_rejects_cycles(spark):
    nodes = spark.createDataFrame([("1", "r", None), ("2", "a", "1"), ("3", "b", "2"), ("4", "c", None)], FOLDERS)
    moves = spark.createDataFrame([("2", "3"), ("4", "1"), ("3", None)], "id string, target string")
    got = {r["id"]: (r["parentFolderId"], r["moved"], r["rejected"]) for r in H.move_nodes(nodes, moves).collect()}
    # 3 -> root and 4 -> under 1 are fine; 2 -> under 3 is fine once 3 is a root
    assert got == {"1": (None, False, False), "2": ("3", True, False), "3": (None, True, False),
                   "4": ("1", True, False)}
    cyc = spark.createDataFrame([("1", "3")], "id string, target string")  # root under its grandchild
    got = {r["id"]: (r["parentFolderId"], r["rejected"]) for r in H.move_nodes(nodes, cyc).collect()}
    assert got["1"] == (None, True)


def test_lift_follows_chains_to_their_ends(spark):
    chains = spark.createDataFrame([("a", None, True, ["A"], 1), ("b", "a", False, ["B"], 10), ("c", "b", False, ["C"], 100),
                                    ("d", "c", False, ["D"], 1000), ("lost", "404", False, ["L"], 1), ("x", "y", False, ["X"], 1),
                                    ("y", "x", False, ["Y"], 1), ("under", "x", False, ["U"], 1)],
                                   "id string, up string, done boolean, path array<string>, total long")
    got = {r.id: (r.path, r.steps, r.total) for r in H.lift(chains).collect()}
    assert got == {"a": (["A"], 1, 1), "b": (["A", "B"], 2, 11), "c": (["A", "B", "C"], 3, 111), "d": (["A", "B", "C", "D"], 4, 1111)}


def test_a_chain_of_20000_folders_takes_few_rounds(spark, monkeypatch):
    n, rounds, plain = 20_000, [], H._stable
    monkeypatch.setattr(H, "_stable", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("displayName"),
                                  F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parentFolderId"))
    loop = spark.createDataFrame([("p", "p", "q"), ("q", "q", "p"), ("under", "u", "q")], chain.schema)
    reached = H.folder_subtree(chain.unionByName(loop))
    assert reached.agg(F.count("*"), F.max("depth"), F.sum("depth")).first() == (n, n, n * (n + 1) // 2)
    assert len(rounds) < 20


def _brute_subtrees(parent, marks):
    out = []
    for m in marks:
        depth, level, seen = 1, [x for x in parent if parent[x] == m and x != m], set()
        while level:
            out += [(x, m, depth) for x in level]
            seen |= set(level)
            level = [x for x in parent if parent[x] in level and x != m and x not in seen]
            depth += 1
    return sorted(out)


def test_random_subtrees_of_nested_roots_and_cycles(spark):
    import random
    for seed in range(6):
        rnd = random.Random(seed)
        ids = [str(i) for i in range(25)]
        parent = {i: rnd.choice([None, *ids]) if rnd.random() < 0.5 else (ids[rnd.randrange(k)] if k else None) for k, i in enumerate(ids)}
        marks = rnd.sample(ids, 8) + ["unknown"]
        nodes = spark.createDataFrame([(i, i, parent[i]) for i in ids], FOLDERS)
        got = H.folder_subtree(nodes, spark.createDataFrame([(m,) for m in marks], "id string"))
        assert sorted((r["id"], r["root"], r["depth"]) for r in got.collect()) == _brute_subtrees(parent, marks), seed


def _brute_tour(parent, order):
    children, event, out = {}, 0, {}
    for i in sorted(parent, key=lambda i: (order[i], i)):
        children.setdefault(parent[i] if parent[i] in parent else None, []).append(i)
    stack = [(i, 1, False) for i in reversed(children.get(None, []))]
    while stack:
        i, depth, leaving = stack.pop()
        if leaving:
            out[i] = (out[i][0], event, out[i][1])
        else:
            out[i] = (event, depth)
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(children.get(i, []))]
        event += 1
    return out


def test_nested_sets_are_a_tour(spark):
    import random
    for seed in range(3):
        rnd = random.Random(seed)
        ids = [f"n{i:03d}" for i in range(120)]
        parent = {i: (None if rnd.random() < 0.1 else ids[rnd.randrange(k)]) if k else None for k, i in enumerate(ids)}
        parent["n118"], parent["n119"], parent["n007"] = "n119", "n118", "missing"
        for i in ids:  # nobody else in or under the cycle
            if parent[i] in ("n118", "n119") and i not in ("n118", "n119"):
                parent[i] = None
        order = {i: rnd.randrange(5) for i in ids}
        nodes = spark.createDataFrame([(i, parent[i], order[i]) for i in ids], "id string, parentFolderId string, o int")
        numbered = H.nested_sets(nodes, ["o"])
        got = {r["id"]: (r["enter"], r["leave"], r["depth"]) for r in numbered.collect()}
        acyclic = {i: p for i, p in parent.items() if i not in ("n118", "n119")}
        assert got == _brute_tour(acyclic, order)
        root = max(got, key=lambda i: got[i][1] - got[i][0])
        below = {r["id"] for r in H.subtree_range(numbered, root).collect()}
        assert below == {i for i in got if got[root][0] <= got[i][0] <= got[root][1]} and len(below) > 5
    assert H.nested_sets(nodes.where("false"), ["o"]).count() == 0


def test_browse_item(spark):
    listing = spark.createDataFrame([
        ("it/Tables/t1/_delta_log", True), ("it/Tables/dbo/t2/_delta_log", True),
        ("it/Files/a", True), ("it/Files/a/x.csv", False), ("other/Files/b.csv", False),
    ], "name string, isDirectory boolean")
    v = P.browse_item(listing, "it")
    assert rows(v.by_schema, "schema", "name", "n_tables") == [("dbo", "t2", 1), (None, "t1", 1)]
    assert {r["relativePath"]: r["parentPath"] for r in v.tree.collect()} == {"Files/a": None,
                                                                               "Files/a/x.csv": "Files/a"}


def test_move_nodes_several_moves_per_node(spark):
    nodes = spark.createDataFrame([("1", "r", None), ("2", "a", None), ("3", "b", None)], FOLDERS)
    moves = spark.createDataFrame([("3", "1", 2), ("3", "2", 1), ("3", None, 3)],
                                  "id string, target string, seq int")
    by_order = {r["id"]: r["parentFolderId"] for r in H.move_nodes(nodes, moves, order_col="seq").collect()}
    assert by_order["3"] is None  # the latest move (to the root) wins
    no_order = {r["id"]: r["parentFolderId"] for r in H.move_nodes(nodes, moves.drop("seq")).collect()}
    assert no_order["3"] == "2" and H.move_nodes(nodes, moves.drop("seq")).count() == 3


def _reachable(parent):
    """Nodes whose parent chain ends at a root (parent None or unknown)."""
    ok = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x in parent and x not in ok and x not in seen:
            seen.append(x)
            x = parent[x]
        res = ok.get(x, True) if x in parent and x not in seen else (x is None or x not in parent)
        if x in seen:
            res = False
        for s in seen:
            ok[s] = res
    return {n for n, v in ok.items() if v}


def test_move_nodes_random_batches_leave_no_cycles(spark):
    import random
    for seed in range(4):
        rnd = random.Random(seed)
        ids = [str(i) for i in range(12)]
        parent = {i: (None if k == 0 or rnd.random() < 0.2 else ids[rnd.randrange(k)]) for k, i in enumerate(ids)}
        moves = {i: rnd.choice([None] + ids) for i in rnd.sample(ids, 6)}
        nodes = spark.createDataFrame([(i, i, parent[i]) for i in ids], FOLDERS)
        mdf = spark.createDataFrame(list(moves.items()), "id string, target string")
        out = {r["id"]: r for r in H.move_nodes(nodes, mdf).collect()}
        final = {i: out[i]["parentFolderId"] for i in ids}
        assert _reachable(final) == set(ids), seed  # no node ends in or under a cycle
        applied = {i: moves.get(i, parent[i]) if i in moves else parent[i] for i in ids}
        want_rejected = {i for i in moves if i not in _reachable(applied)}
        assert {i for i in ids if out[i]["rejected"]} == want_rejected, seed


def test_build_tree_unordered_same_edges(spark):
    files = spark.createDataFrame([("d", "Files/d", True), ("a.txt", "Files/d/a.txt", False)],
                                  "name string, relativePath string, isDirectory boolean")
    assert rows(P.build_tree(files, ordered=False)) == rows(P.build_tree(files))
    plan = P.build_tree(files, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def _js_file_row(name):
    parts = name.split("/")
    return parts[-1], name[len(parts[0]) + 1:]


def _js_table_row(name):
    parts = name.split("/")
    tp = parts[:-1] if name.endswith("/_delta_log") else parts
    return tp[-1], "/".join(tp)[len(parts[0]) + 1:] + "/", (tp[2] if len(tp) == 4 else None)


def test_random_listings_match_string_rules(spark):
    import random
    rnd = random.Random(7)
    segs = ["it", "Tables", "Files", "a", "b", "", "_delta_log", "x.csv"]
    names = sorted({"/".join(rnd.choice(segs) for _ in range(rnd.randint(1, 6))) for _ in range(300)})
    rows_in = [(n, rnd.random() < 0.5, rnd.random() < 0.2, rnd.choice(["ADLS", "ExternalADLS", "S3", None]))
               for n in names]
    df = spark.createDataFrame(rows_in, "name string, isDirectory boolean, isShortcut boolean, accountType string")
    got = {(r["name"], r["relativePath"]) for r in P.path_parts(df).collect()}
    assert got == {_js_file_row(n) for n in names}
    want_t = {_js_table_row(n) for n, _, sc, acct in rows_in
              if n.endswith("/_delta_log") or (sc and acct in ("ADLS", "ExternalADLS"))}
    got_t = {(r["name"], r["relativePath"], r["schema"]) for r in P.discover_tables(df).collect()}
    assert got_t == want_t
    # build_tree parent rule: segments without empties; parent must be a listed directory
    files = P.path_parts(df)
    dirs = {rp for (n, d, _, _) in rows_in for rp in [_js_file_row(n)[1]] if d}
    for r in P.build_tree(files, ordered=False).collect():
        s = [x for x in r["relativePath"].split("/") if x]
        want_parent = "/".join(s[:-1]) if len(s) > 1 and "/".join(s[:-1]) in dirs else None
        assert r["parentPath"] == want_parent, r


def test_random_ensure_paths_equal_sequential_creation(spark):
    for seed in range(6):
        _check_ensure_paths(spark, seed)


def _check_ensure_paths(spark, seed):
    import random
    rnd = random.Random(seed)
    names = ["a", "b"]
    folders_py = []  # (id, name, parent)
    for i in range(15):
        parent = None if i < 3 or rnd.random() < 0.2 else folders_py[rnd.randrange(len(folders_py))][0]
        folders_py.append((f"f{i:02d}", rnd.choice(names), parent))
    requests = [(k, [rnd.choice(names) for _ in range(rnd.randint(0, 4))]) for k in range(10)]
    # sequential reference loop; the smallest id wins among same-named siblings
    live = list(folders_py)
    created, resolved = [], {}
    for k, path in requests:
        parent, last, trail = None, None, []
        for name in path:
            trail.append(name)
            same = sorted(f for f in live if f[2] == parent and f[1] == name)
            if same:
                last = same[0][0]
            else:
                last = f"new:{'/'.join(trail)}"
                live.append((last, name, parent))
                created.append("/".join(trail))
            parent = last
        resolved[k] = last
    df = spark.createDataFrame(folders_py, FOLDERS)
    req = spark.createDataFrame(requests, "request int, segments array<string>")
    c, r = H.ensure_folder_paths(df, req)
    assert sorted(x["pathText"] for x in c.collect()) == sorted(created)
    got = {x["request"]: x["folderId"] for x in r.collect()}
    by_new = {x["id"]: f"new:{x['pathText']}" for x in c.collect()}
    assert {k: by_new.get(v, v) for k, v in got.items()} == resolved, seed
