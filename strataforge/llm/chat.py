"""Reply trees as training conversations, with DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataforge.functions.windows import rank_in_order
from strataforge.session import prepare, staged

TURN, END = "<|turn|>", "<|end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """No control string is left in the text: each begins with ``<|``, which becomes ``<\\p``; ``\\`` becomes ``\\b``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so it may hold none."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


NODE = ("tree", "node", "parent", "score", "role", "text")


def best_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """The rows of ``nodes`` (columns NODE) on the best root-to-leaf paths, with ``path``, ``path_rank``, ``path_score`` and ``place``.

    A path's score is the sum of its nodes' scores (NULL: 0); ties go to the
    smaller leaf id.  ``top`` None keeps every path.  Each self-join of the links
    doubles how far they reach, so a path of d nodes takes log2(d) joins, not d; the
    same links then lead from the chosen leaves alone to all their ancestors.
    Links are ids; texts are joined once, at the end.

    A missing or unknown parent, or a node's own id, makes a root.  Rows that
    repeat a node's id stand beside it: each may be a leaf, and replies belong to
    the first by score and the other columns.  A NULL tree is one tree.  Nodes on
    a circle lie on no path from a root and are in no result.
    """
    order = [F.col("score").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in ("parent", "role", "text")]]
    numbered = rank_in_order(nodes.select(*NODE), ["tree", "node"], order, "_copy")
    rows = staged(numbered.withColumn("_row", F.monotonically_increasing_id()), "nodes")
    child = rows.select("_row", F.col("tree").alias("t"), F.col("parent").alias("p"), F.col("node").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    above = rows.where("_copy = 1").select(F.col("_row").alias("up"), F.col("tree").alias("t2"), F.col("node").alias("n2"))
    match = F.col("t").eqNullSafe(F.col("t2")) & (F.col("p") == F.col("n2")) & ~F.col("p").eqNullSafe(F.col("n"))
    link = child.join(above, match, "left").select("_row", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("hops"), "total")
    levels = [staged(link, "links")]
    replied = levels[0].where("up IS NOT NULL").select(F.col("up").alias("_row")).distinct()
    rounds = ceil(log2(max(2, rows.count()))) + 1
    while len(levels) <= rounds and not levels[-1].where("up IS NOT NULL").isEmpty():
        low, high = levels[-1].alias("l"), levels[-1].alias("h")
        doubled = low.join(high, F.col("l.up") == F.col("h._row"), "left").select(
            F.col("l._row").alias("_row"),
            F.col("h.up").alias("up"),
            (F.col("l.hops") + F.coalesce("h.hops", F.lit(0))).alias("hops"),
            (F.col("l.total") + F.coalesce("h.total", F.lit(0.0))).alias("total"),
        )
        levels.append(staged(doubled, "links"))
    rooted = levels[-1].where("up IS NULL")
    leaves = rooted.join(replied, "_row", "left_anti").join(rows.select("_row", F.col("tree").alias("t"), F.col("node").alias("n"), "_copy"), "_row")
    order = Window.partitionBy("t").orderBy(F.col("total").desc(), F.col("n").asc_nulls_first(), F.col("_copy"))
    leaves = leaves.withColumn("path_rank", F.row_number().over(order)) if top else leaves.withColumn("path_rank", F.lit(None).cast("int"))
    chosen = leaves.where(F.col("path_rank") <= top) if top else leaves
    chosen = staged(chosen.select(F.col("_row").alias("path"), "path_rank", F.col("total").alias("path_score"), "hops"), "leaves")
    members = staged(chosen.select("path", F.col("path").alias("_row"), F.lit(0).cast("long").alias("back")), "members")
    for i, level in enumerate(levels[:-1]):
        step = members.join(level.where("up IS NOT NULL").select("_row", "up"), "_row")
        members = staged(members.union(step.select("path", F.col("up").alias("_row"), F.col("back") + (1 << i))), "members")
    placed = members.join(chosen, "path").withColumn("place", F.col("hops") - F.col("back"))
    return placed.drop("hops", "back").join(rows, "_row").drop("_row", "_copy")


def conversations(turns: DataFrame, keys: list[str], place: str, role: str, text: str, learned: str = LEARNED) -> DataFrame:
    """One row per conversation: ``formatted`` and ``learn``, the code points (start, size) of each learned text.

    A turn is ``<|turn|>role``, a line break, the text and ``<|end|>``.  NULL roles
    and texts are empty.  Texts are escaped, so reading back gives them exactly.
    """
    parts = turns.select(
        *[F.col(k) for k in keys],
        F.col(place).alias("_place"),
        F.concat(F.lit(TURN), escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n")).alias("_head"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("_body"),
        F.coalesce(F.col(role) == learned, F.lit(False)).alias("_learn"),
    )
    before = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("_head") + F.length("_body") + len(END)
    placed = parts.withColumn("_start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0)) + F.length("_head"))
    turn = F.struct("_place", "_start", F.length("_body").alias("_size"), "_learn", F.concat("_head", "_body", F.lit(END)).alias("_part"))
    grouped = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    learn = F.transform(F.filter("_turns", lambda t: t["_learn"]), lambda t: F.struct(t["_start"].cast("long").alias("start"), t["_size"].cast("long").alias("size")))
    return grouped.select(*keys, F.array_join(F.transform("_turns", lambda t: t["_part"]), "").alias("formatted"), learn.alias("learn"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    parts = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)  # nothing stands before the first turn

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        size = F.length(part) - F.length(head) - 1 - len(END)
        return F.struct(unescape_role(head).alias("role"), unescape(F.substr(part, F.length(head) + 2, size)).alias("text"))

    return F.transform(parts, turn)


def read_learned(formatted: Column, learn: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(learn, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")


def format_trees(
    nodes: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str, top: int | None = 1
) -> DataFrame:
    """Each chosen path of each reply tree as one conversation: tree, path, path_rank, path_score, formatted, learn.

    See ``best_paths`` and ``conversations`` for what is defined; other columns are not read.
    """
    prepare(nodes.sparkSession)
    given = zip(NODE, (tree, node, parent, score, role, text))
    turns = best_paths(nodes.select(*[F.col(f"`{c}`").alias(name) for name, c in given]), top)
    return conversations(turns, ["tree", "path", "path_rank", "path_score"], "place", "role", "text")
