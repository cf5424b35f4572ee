"""Shortcuts below shortcuts against rewriting one path at a time."""

import random

from lakeops.operators import mounts as M
from lakeops.operators import paths as P


def brute(path, mounts, limit=200):
    at, hops = path, 0
    while hops < limit:
        best = max((m for m in mounts if at == m or at.startswith(m + "/")), key=len, default=None)
        if best is None:
            return at, hops, False
        at, hops = mounts[best] + at[len(best):], hops + 1
    return None, None, True


def resolve(spark, paths, mounts):
    got = M.resolve_paths(spark.createDataFrame([(p,) for p in paths], "path string"),
                          spark.createDataFrame(list(mounts.items()), "mount string, target string"))
    return {r["path"]: (r["resolved"], r["hops"], r["loop"]) for r in got.collect()}


def test_chains_loops_and_growing_paths(spark):
    mounts = {"l/a": "l/b", "l/b/c": "l/a/d", "x": "y", "y": "z/w", "z": "s3a://bucket/k", "g": "g/h", "p": "q", "q": "p", "self": "self"}
    paths = ["l/a/c", "l/a/c/e", "x", "x/1/2", "xy", "z", "g/1", "p/1", "self", "plain/path", "", "x/"]
    got = resolve(spark, paths + [None, "x"], mounts)
    assert got["l/a/c"] == ("l/b/d", 3, False)  # one mount used twice, and yet it ends
    assert got["x/1/2"] == ("s3a://bucket/k/w/1/2", 3, False) and got["xy"] == ("xy", 0, False)
    assert {p for p, v in got.items() if v[2]} == {"g/1", "p/1", "self"}
    for p in paths:
        want = brute(p.rstrip("/"), mounts)
        assert got[p][2] == want[2] and (want[2] or got[p] == want), p


def test_random_mounts(spark):
    for seed in range(4):
        rng = random.Random(seed)
        def path(n):
            return "/".join(rng.choice("abc") for _ in range(n))
        mounts = {path(rng.randint(1, 3)): path(rng.randint(1, 3)) for _ in range(6)}
        paths = sorted({path(rng.randint(1, 5)) for _ in range(60)})
        got = resolve(spark, paths, mounts)
        for p in paths:
            want = brute(p, mounts)
            assert got[p][2] == want[2] and (want[2] or got[p] == want), (seed, p, mounts)


def test_content_of_nested_shortcuts(spark):
    mounts = spark.createDataFrame([("it/in", "it/data"), ("it/data/more", "ext/set"), ("it/out", "it/in"), ("ext/set/back", "it/data")],
                                   "mount string, target string")
    got = {(r["shortcutPath"], r["targetRoot"], r["loop"]) for r in M.nested_mounts(mounts).collect()}
    assert ("it/out", "it/data", False) in got and ("it/out/more", "ext/set", False) in got
    assert ("it/in/more/back", "it/data", False) in got
    assert any(p.startswith("it/in/more/back/more") and loop for p, _, loop in got)  # seen inside itself: reported, not followed
    listing = spark.createDataFrame([("it/data/x.csv", False, False), ("ext/set/y.csv", False, False)], "name string, isDirectory boolean, isShortcut boolean")
    seen = P.expand_shortcut(listing, M.nested_mounts(mounts).where("not loop"))
    names = {r["relativePath"] for r in seen.collect()}
    assert {"it/in/x.csv", "it/out/x.csv", "it/out/more/y.csv", "it/in/more/y.csv", "it/in/more/back/x.csv"} <= names


def test_no_paths(spark):
    assert resolve(spark, [None], {"a": "b"}) == {}
