"""Folder hierarchies stored as adjacency lists (``id, displayName, parentFolderId``).

The reference walks hierarchies with one remote call per ancestor, per level or per path
segment. Here every walk is a set operation over the whole folder table, by *pointer doubling*:
every folder holds a pointer to an ancestor, and in each round a pointer is replaced by the
pointer of the folder that it points to, so after k rounds it reaches 2^k levels up. A tree of depth D
takes log2 D rounds, each one self-join (a driver loop over rounds, never over rows); each
round is checkpointed to the cluster's checkpoint folder, so a lost executor recomputes one.
Folders in or under a parent cycle never come to an end: a round in which no pointer does
shows that only such folders are left.

``nested_sets`` numbers a forest in reading order, so that a subtree is a range of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.paging import running_totals
from lakeops.session import materialize

# Fixed value (must equal the reference): the error text for an empty folder path.
EMPTY_PATH_ERROR = "No folders were created or found"


def _edges(folders: DataFrame, id_col: str, parent_col: str, name_col: str) -> DataFrame:
    return folders.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
                          F.col(name_col).alias("displayName"))


_stable = materialize


def lift(chains: DataFrame) -> DataFrame:
    """Follow every row's chain of ``up`` pointers to its end, in log2(longest chain) rounds.

    ``chains``: ``id, up, done`` [, ``path``] [, ``total``]. ``done`` marks a chain that ends with
    this row; else it goes on at the row(s) whose ``id`` is ``up``. Returns the rows whose chain comes to an end:
    ``id``, ``up`` of the last row, ``steps`` (rows of the chain), ``path`` (the arrays of the chain, the
    end's first) and ``total`` (the sum of its numbers). Chains that meet an unknown id, or run into
    a cycle, are left out.

    An id that stands twice splits the chains below it; on a cycle such a chain both ends and
    repeats, which is an error.
    """
    carried = [c for c in ("path", "total") if c in chains.columns]
    cols = ["id", "up", "done", "steps", *carried]
    state = _stable(chains.withColumn("steps", F.lit(1).cast("long")).select(*cols))
    counts = state.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if("done").alias("ended")).first()
    repeated = counts["n"] > counts["ids"]
    if repeated and carried:  # who comes to an end at all, first: what repeats would carry ever more
        state = _stable(state.join(lift(chains.select("id", "up", "done")).select("id").distinct(), "id", "left_semi"))
    ended, every, reach = counts["ended"], counts["n"], 1
    while ended < every:
        if repeated and reach > counts["n"]:
            raise RuntimeError("the walk repeats: an id occurs twice on a parent cycle")
        # One join moves all pointers. Rows that are at their end ask by a key that nobody has, so they
        # stay spread over the tasks.
        ask = state.withColumn("_key", F.when(F.col("done"), F.col("id")).otherwise(F.col("up"))).withColumn("_asks", ~F.col("done"))
        above = state.select(F.col("id").alias("_key"), F.lit(True).alias("_asks"), *[F.col(c).alias(f"_{c}") for c in cols[1:]])
        moved = {"id": F.col("id"), "up": F.col("_up"), "done": F.col("_done"), "steps": F.col("steps") + F.col("_steps")}
        if "path" in carried:
            moved["path"] = F.concat("_path", "path")
        if "total" in carried:
            moved["total"] = F.col("total") + F.col("_total")
        nxt = ask.join(above, ["_key", "_asks"], "left").where(F.col("done") | F.col("_steps").isNotNull()).select(
            *[F.when(F.col("done"), F.col(c)).otherwise(moved[c]).alias(c) for c in cols])
        state = _stable(nxt.distinct() if repeated and not carried else nxt)
        now = state.agg(F.count_if("done").alias("ended"), F.count(F.lit(1)).alias("every")).first()
        if now["ended"] == ended:
            break  # of the chains that end, some end in every round: the others never will
        ended, every, reach = now["ended"], now["every"], 2 * reach
    return state.where("done").drop("done")


def _chains(edges: DataFrame, **carried: Column) -> DataFrame:
    """Chains up to the rows that have no parent, or whose parent is not in the table."""
    known = edges.select(F.col("id").alias("_known")).distinct()
    marked = edges.join(known, F.col("parent") == F.col("_known"), "left")
    return marked.select("id", F.col("parent").alias("up"), F.col("_known").isNull().alias("done"),
                         *[c.alias(n) for n, c in carried.items()])


def folder_path(folders: DataFrame, id_col: str = "id", parent_col: str = "parentFolderId",
                name_col: str = "displayName") -> DataFrame:
    """Names from the root down to each folder: ``id, path (array), depth``.

    A folder whose parent is missing starts its own path (the reference would fail the
    call). Folders caught in a parent cycle have no path and are left out.
    """
    e = _edges(folders, id_col, parent_col, name_col)
    found = lift(_chains(e, path=F.array("displayName")))
    return found.select("id", "path", F.col("steps").cast("int").alias("depth"))


def folder_subtree(folders: DataFrame, root_id: str | DataFrame | None = None,
                   recursive: bool = True, id_col: str = "id", parent_col: str = "parentFolderId",
                   name_col: str = "displayName") -> DataFrame:
    """Descendants of a root: all of them, or direct children only.

    ``root_id`` is one folder id, a table of root ids (column ``id``; each root's subtree
    is walked, so a folder under two nested roots appears once per root), or None for
    the workspace root. Returns the folder rows plus ``root`` (null for the workspace
    root) and ``depth`` below it (1 = direct child).
    """
    e = _edges(folders, id_col, parent_col, name_col)
    if root_id is None:
        tops = e.where(F.col("parent").isNull())
        if recursive:
            # The end of each chain; a folder whose parent is missing has no end.
            reached = lift(e.select("id", F.col("parent").alias("up"), F.col("parent").isNull().alias("done")))
        else:
            reached = tops.select("id", F.lit(1).alias("steps"))
        reached = reached.select("id", F.lit(None).cast("string").alias("root"), "steps")
    else:
        if isinstance(root_id, str):
            marks = folders.sparkSession.createDataFrame([(root_id,)], "id string")
        else:
            marks = root_id.select(F.col("id").cast("string").alias("id")).distinct()
        below = e.where(F.col("parent").isNotNull())
        if recursive:
            reached = _under(below, _stable(marks))
        else:
            reached = below.join(marks.select(F.col("id").alias("parent")), "parent").select(
                "id", F.col("parent").alias("root"), F.lit(1).alias("steps"))
    return folders.join(reached.select(F.col("id").alias(id_col), "root", F.col("steps").cast("int").alias("depth")), id_col)


def _under(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """``(id, root, steps)``: every node below every mark, a mark itself not below itself."""
    mark = marks.select(F.col("id").alias("_mark"))
    chains = edges.join(mark, F.col("parent") == F.col("_mark"), "left").select(
        "id", F.col("parent").alias("up"), F.col("_mark").isNotNull().alias("done"))
    # A node's nearest mark above it; marks among each other are a forest of their own.
    near = _stable(lift(chains).where("id <> up"))
    jump = pairs = _stable(near.join(marks, "id", "left_semi").select("id", "up", "steps"))
    known = pairs.count()
    while known:
        far = jump.select("id", F.col("up").alias("_mid"), F.col("steps").alias("_steps"))
        on = pairs.select(F.col("id").alias("_mid"), "up", F.col("steps").alias("_more"))
        more = far.join(on, "_mid").select("id", "up", (F.col("_steps") + F.col("_more")).alias("steps")).where("id <> up")
        pairs = _stable(pairs.unionByName(more).groupBy("id", "up").agg(F.min("steps").alias("steps")))
        now = pairs.count()
        if now == known:
            break
        known = now
        on = jump.select(F.col("id").alias("_mid"), "up", F.col("steps").alias("_more"))
        jump = _stable(far.join(on, "_mid").select("id", "up", (F.col("_steps") + F.col("_more")).alias("steps")))
    higher = pairs.select(F.col("id").alias("up"), F.col("up").alias("root"), F.col("steps").alias("_more"))
    nested = near.join(higher, "up").select("id", "root", (F.col("steps") + F.col("_more")).alias("steps")).where("id <> root")
    return near.select("id", F.col("up").alias("root"), "steps").unionByName(nested)


def empty_folders(folders: DataFrame, id_col: str = "id",
                  parent_col: str = "parentFolderId") -> DataFrame:
    """Folders that no other folder names as its parent (items are not considered)."""
    # Distinct first: a folder that holds a third of all folders is one row a task, not a hot key.
    parents = folders.select(F.col(parent_col).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return folders.join(parents, id_col, "left_anti")


def ensure_folder_paths(folders: DataFrame, requests: DataFrame, req_col: str = "request",
                        segs_col: str = "segments", id_col: str = "id",
                        parent_col: str = "parentFolderId", name_col: str = "displayName",
                        id_prefix: str = "folder-") -> tuple[DataFrame, DataFrame]:
    """Resolve each requested name path, reusing existing folders and creating the rest.

    Walking from the workspace root, a segment reuses the folder of that name under the
    current parent (the smallest id when several match, and the walk goes on inside that
    one), else a folder is created. New ids are ``id_prefix`` + a hash of the JSON name
    path, so reruns give the same ids.

    Returns ``(created, resolved)``: ``created`` holds the new folder rows (each created
    once however many requests share it), ``resolved`` maps each request to the id of its
    deepest folder, with ``error`` set for an empty path.
    """
    # A name walk descends into one folder per level: among same-named siblings the one
    # with the smallest id. Keep only those, and follow their chains to the workspace root,
    # so a name path resolves exactly as the step-by-step walk would.
    e = _edges(folders, id_col, parent_col, name_col)
    chosen = e.groupBy("parent", "displayName").agg(F.min("id").alias("id"))
    canon = e.join(chosen.select("id"), "id", "left_semi")
    req = requests.select(F.col(req_col).alias("request"), F.col(segs_col).alias("segs"))
    # Only folders named like some requested segment can lie on a requested path.
    asked = req.select(F.explode("segs").alias("displayName")).distinct()
    canon = canon.join(asked, "displayName", "left_semi")
    by_path = lift(canon.select("id", F.col("parent").alias("up"), F.col("parent").isNull().alias("done"),
                                F.array("displayName").alias("path"))).select("path", F.col("id").alias("eid"))
    prefixes = (req.where(F.size("segs") > 0)
                .select(F.explode(F.sequence(F.lit(1), F.size("segs"))).alias("k"), "segs")
                .select(F.slice("segs", F.lit(1), F.col("k")).alias("path")).distinct())

    def new_id(p):
        return F.concat(F.lit(id_prefix), F.sha2(F.to_json(p), 256))

    # Three branches read it: computed once.
    resolved_prefix = _stable(prefixes.join(by_path, "path", "left").select(
        "path", F.coalesce("eid", new_id(F.col("path"))).alias("fid"), F.col("eid").isNull().alias("new")))
    parent_of = F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1))
    created_raw = resolved_prefix.where("new").select("path", "fid", parent_of.alias("ppath"))
    parents = resolved_prefix.select(F.col("path").alias("ppath"), F.col("fid").alias("pid"))
    created = created_raw.join(parents, "ppath", "left").select(
        F.col("fid").alias(id_col), F.element_at("path", -1).alias(name_col),
        F.col("pid").alias(parent_col), F.array_join("path", "/").alias("pathText"))
    resolved = req.join(resolved_prefix.select(F.col("path").alias("segs"), "fid"), "segs", "left").select(
        "request", F.col("fid").alias("folderId"),
        F.when(F.col("segs").isNull() | (F.size("segs") == 0), F.lit(EMPTY_PATH_ERROR)).alias("error"))
    return created, resolved


def move_nodes(nodes: DataFrame, moves: DataFrame, id_col: str = "id",
               parent_col: str = "parentFolderId", target_col: str = "target",
               name_col: str = "displayName", order_col: str | None = None) -> DataFrame:
    """Re-parent nodes; a null target moves a node to the root.

    Our rule (the reference leaves this to the service): a move is rejected when its target is
    neither null nor a known node, or when, with the other moves applied, the node is no longer reachable from a root, i.e. it would sit in
    or under a parent cycle. Rejected moves are dropped; the accepted ones then leave every
    node they move reachable (see the note in the body). Adds ``moved`` (accepted) and
    ``rejected`` columns. Several moves for one node are reduced to one first (see
    ``order_col``).
    """
    # One move per node: the latest by ``order_col``; without one, the largest target id
    # (a move to the root only when it is the node's only move). Never an arbitrary pick.
    order = [F.col(order_col).alias("_o")] if order_col else []
    mv = (moves.groupBy(F.col(id_col).alias("_mid"))
          .agg(F.max(F.struct(*order, F.col(target_col).alias("_t"))).alias("_w"))
          .select("_mid", F.col("_w._t").alias("_target")))
    req = mv.select(F.col("_mid").alias("_rid"))
    known = nodes.select(F.col(id_col).alias("_target")).distinct()
    mv = _stable(mv.where("_target is null").unionByName(mv.join(known, "_target", "left_semi").select("_mid", "_target")))
    # One reachability walk with every move applied decides all moves. A node reachable in
    # that graph reaches a root through reachable nodes only, and none of those has a
    # rejected move, so dropping the rejected moves leaves every accepted node's path to a
    # root unchanged: no second round is needed.
    applied = (nodes.join(mv, nodes[id_col] == mv["_mid"], "left")
               .select(F.col(id_col).alias("id"),
                       F.when(F.col("_mid").isNotNull(), F.col("_target"))
                        .otherwise(F.col(parent_col)).alias("parent"),
                       F.col(name_col).alias("displayName")))
    reach = lift(_chains(applied))
    accepted = mv.join(reach.select(F.col("id").alias("_mid")), "_mid", "left_semi")
    acc = accepted.withColumn("_ok", F.lit(True))
    out = (nodes.join(acc, nodes[id_col] == acc["_mid"], "left")
           .join(req, nodes[id_col] == req["_rid"], "left"))
    return out.select(
        *[F.col(c) for c in nodes.columns if c != parent_col],
        F.when(F.col("_ok"), F.col("_target")).otherwise(F.col(parent_col)).alias(parent_col),
        F.coalesce(F.col("_ok"), F.lit(False)).alias("moved"),
        (F.col("_rid").isNotNull() & F.col("_ok").isNull()).alias("rejected"))


def nested_sets(nodes: DataFrame, order_by: Sequence[str | Column], id_col: str = "id",
                parent_col: str = "parentFolderId") -> DataFrame:
    """Nested-set numbers of a forest: ``id, enter, leave, depth`` (1 for a root), ``n_below``.

    A tour of the forest enters and leaves every node once, siblings in ascending ``order_by`` order
    (columns or expressions, then id), and numbers these events from 0. A node's subtree are the nodes with ``enter`` between its ``enter`` and
    ``leave``; sorting by ``enter`` gives reading order. A node whose parent is missing is a root; nodes
    in or under a cycle get no numbers. Ids must be unique.

    Sizes come by doubling (a node's count within 2^k levels, plus those of the nodes 2^k below it),
    the places among siblings by running totals of the sizes over ranges, and the numbers as sums of
    these along the chain of ancestors, again by doubling.
    """
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
                        *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order_by)])
    known = base.select(F.col("id").alias("_known"))
    base = _stable(base.join(known, F.col("parent") == F.col("_known"), "left").withColumn("parent", F.col("_known")).drop("_known"))
    if base.count() > base.select("id").distinct().count():
        raise ValueError("nested sets need unique ids")
    sizes = _stable(base.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    open_chains = sizes.where("up is not null").count()
    while open_chains:
        below = sizes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_more"))
        ups = sizes.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        sizes = _stable(sizes.join(below, "id", "left").join(ups, "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        still = sizes.where("up is not null").count()
        if still == open_chains:
            break  # only nodes in or under cycles are left
        open_chains = still
    sized = base.join(sizes.where("up is null").select("id", "size"), "id").withColumn("_events", 2 * F.col("size"))
    placed = running_totals(sized, ["parent"], [*[c for c in sized.columns if c.startswith("_o")], "id"], "_events")
    placed = _stable(placed.select("id", "parent", "size", (F.col("before") + 1).alias("total")))
    found = lift(placed.select("id", F.col("parent").alias("up"), F.col("parent").isNull().alias("done"), "total"))
    enter = F.col("total") - 1
    return found.join(placed.select("id", "size"), "id").select(
        "id", enter.alias("enter"), (enter + 2 * F.col("size") - 1).alias("leave"),
        F.col("steps").cast("int").alias("depth"), (F.col("size") - 1).alias("n_below"))


def subtree_range(numbered: DataFrame, root_id) -> DataFrame:
    """The rows of a ``nested_sets`` table from ``root_id`` down, by its range of numbers."""
    root = numbered.where(F.col("id") == F.lit(root_id))
    lo, hi = root.select(F.max("enter")).scalar(), root.select(F.max("leave")).scalar()
    return numbered.where((F.col("enter") >= lo) & (F.col("enter") <= hi))
