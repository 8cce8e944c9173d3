"""Chat formatting of reply trees: root-to-leaf paths by self-joins, branches ranked by score, one conversation a path.

``leaf_paths`` enumerates paths by pointer doubling: every message learns its ancestor 1, 2, 4, ... steps up by joining the table
of jumps with itself, so a path of n messages takes log2(n) joins. A branch's score is the mean score of its messages; only
the chosen leaves of a tree are expanded to their messages, again by doubling, so no path is walked that is not formatted.

The template marks turns; control strings inside texts get a backslash behind their first character, one more for
every one already there, which ``unescaped`` takes back exactly. The loss mask covers the assistants' texts and nothing else.

Everything is DataFrame operations. A formatted conversation is one output row, so a path's turns meet in one group.

Null and edge cases
* null text or role: empty. Role ``system``, ``user`` and ``assistant`` have marks of their own, any other role a named mark.
* a parent that is not in the tree, or null: the message is a root. Messages on or below a cycle reach no root and are on no path.
* a message id that occurs more than once in a tree: the smallest (parent, role, text) counts; ``turns_as_tree`` gives each
  row an id of its own, so repeated rows and turns stay.
* null tree ids form a tree of their own. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BEGIN = "<s>"
#: Open and close marks of the roles (fixed values of the template); the close mark tells the role when reading back.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[TURN ", "] ", " [/TURN]")
_CONTROL = r"(/?(?:INST|SYS|TURN)|/?s>)"


def escaped(text: Column) -> Column:
    """Text in which no control string of the template occurs."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _role_name(role: Column) -> Column:
    """Other roles are escaped like texts, and their closing brackets get a backslash."""
    return F.regexp_replace(F.regexp_replace(escaped(role), r"\\", r"\\\\"), r"\]", r"\\)")


def _role_back(name: Column) -> Column:
    return unescaped(F.regexp_replace(F.regexp_replace(name, r"(?<!\\)((?:\\\\)*)\\\)", r"$1]"), r"\\\\", r"\\"))


def turns_as_tree(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: tree_id, message_id (from 1 in turn order), parent_id, role, text, score 0."""
    w = Window.partitionBy(tree).orderBy(F.col(order).isNull(), order, role, text)
    n = F.row_number().over(w).cast("long")
    return turns.select(
        F.col(tree).alias("tree_id"), n.alias("message_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score")
    ).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


def _clean(messages: DataFrame) -> DataFrame:
    """One row per (tree, message); parents that are not there become null."""
    body = F.min(F.struct("parent_id", "role", "text", "score")).alias("b")
    return messages.where(F.col("message_id").isNotNull()).groupBy("tree_id", "message_id").agg(body).select("tree_id", "message_id", "b.*")


def leaf_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree_id, leaf_id, branch (rank from 1), branch_score, position (from 0 at the root), role and text of the chosen paths.

    messages: tree_id, message_id, parent_id, role, text, score (null: 0). ``branches``: paths a tree, best mean score first,
    then the smaller leaf id; null keeps all.
    """
    full = written(_clean(messages), "tree-messages")
    ids = full.select("tree_id", "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = ids.select(F.col("tree_id").alias("__t"), F.col("message_id").alias("__m"))
    linked = ids.join(there, F.col("tree_id").eqNullSafe(F.col("__t")) & (F.col("parent_id") == F.col("__m")), "left")
    start = linked.select("tree_id", "message_id", F.col("__m").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    jumps = [written(start, "tree-jumps")]
    # ``up``: the ancestor 2**k steps above, null once the root is passed; total and steps cover what lies below it
    while not jumps[-1].where(F.col("up").isNotNull()).isEmpty():
        last = jumps[-1]
        above = last.select(F.col("tree_id").alias("__t"), F.col("message_id").alias("__m"), F.col("up").alias("__up"), F.col("total").alias("__total"), F.col("steps").alias("__steps"))
        # finished messages need no partner
        step = last.where(F.col("up").isNotNull()).join(above, F.col("tree_id").eqNullSafe(F.col("__t")) & (F.col("up") == F.col("__m")), "left").select(
            "tree_id", "message_id", F.col("__up").alias("up"), (F.col("total") + F.col("__total")).alias("total"), (F.col("steps") + F.col("__steps")).alias("steps")
        )
        if len(jumps) > 1 and (1 << len(jumps)) > 2 * full.count():
            break  # what is left has more ancestors than there are messages: cycles
        jumps.append(written(step.unionByName(last.where(F.col("up").isNull())), "tree-jumps"))
    whole = jumps[-1].where(F.col("up").isNull())
    parents = jumps[0].where(F.col("up").isNotNull()).select("tree_id", F.col("up").alias("message_id")).distinct()
    same = [F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")), F.col("a.message_id") == F.col("b.message_id")]
    leaves = whole.alias("a").join(parents.alias("b"), same, "left_anti").select("tree_id", "message_id", "steps", (F.col("total") / F.col("steps")).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "message_id"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    path = chosen.select("tree_id", F.col("message_id").alias("leaf_id"), "branch", "branch_score", "message_id", (F.col("steps") - 1).alias("position"))
    # after k rounds a path holds the 2**k messages above its leaf; each of them gives the one 2**k steps further up
    for k, jump in enumerate(jumps[:-1]):
        up = jump.where(F.col("up").isNotNull()).select(F.col("tree_id").alias("__t"), F.col("message_id").alias("__m"), "up")
        more = path.join(up, F.col("tree_id").eqNullSafe(F.col("__t")) & (F.col("message_id") == F.col("__m"))).select(
            "tree_id", "leaf_id", "branch", "branch_score", F.col("up").alias("message_id"), (F.col("position") - (1 << k)).alias("position")
        )
        path = written(path.unionByName(more), "tree-paths")
    said = full.select(F.col("tree_id").alias("__t"), F.col("message_id").alias("__m"), "role", "text")
    return path.join(said, F.col("tree_id").eqNullSafe(F.col("__t")) & (F.col("message_id") == F.col("__m"))).drop("__t", "__m", "message_id")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: tree_id, leaf_id, branch, branch_score, formatted and loss_mask, spans (start, end) of code points."""
    role, said = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    opening, closing = F.concat(F.lit(OTHER[0]), _role_name(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        opening, closing = F.when(role == name, F.lit(a)).otherwise(opening), F.when(role == name, F.lit(b)).otherwise(closing)
    turn = F.struct(
        "position", F.concat(opening, said, closing).alias("line"), F.char_length(opening).alias("skip"), F.char_length(said).alias("size"), (role == "assistant").alias("loss")
    )
    grouped = paths.groupBy("tree_id", "leaf_id", "branch", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    begin = len(BEGIN)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(begin).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.char_length(t["line"])).alias("at"),
            F.when(
                t["loss"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + t["skip"]).alias("start"), (s["at"] + t["skip"] + t["size"]).alias("end")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return grouped.select(
        "tree_id", "leaf_id", "branch", "branch_score", F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["line"]), "")).alias("formatted"), spans.alias("loss_mask")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), from the string alone."""
    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.char_length(formatted))
    lines = F.filter(F.split(body, r"(?<=\[/SYS\]|\[/INST\]|\[/TURN\]|</s>)"), lambda x: x != "")

    def inner(line: Column, opening: Column | int, close: str) -> Column:
        first = F.lit(opening) if isinstance(opening, int) else opening
        return F.substring(line, first + 1, F.char_length(line) - first - len(close))

    def turn(line: Column) -> Column:
        other_end = F.instr(line, OTHER[1]) + len(OTHER[1]) - 1
        name = F.substring(line, F.lit(len(OTHER[0]) + 1), other_end - len(OTHER[0]) - len(OTHER[1]))
        out = F.struct(_role_back(name).alias("role"), unescaped(inner(line, other_end, OTHER[2])).alias("text"))
        for role, (a, b) in MARKS.items():
            out = F.when(line.endswith(b), F.struct(F.lit(role).alias("role"), unescaped(inner(line, len(a), b)).alias("text"))).otherwise(out)
        return out

    return F.transform(lines, turn)


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    return format_paths(leaf_paths(messages, branches))
