"""Chat formatting: root-to-leaf paths of reply trees, ranked, each formatted as one conversation; DataFrame operations only.

`paths` finds the messages of every root-to-leaf path by self-joins that double their reach: after round k each path knows
its last 2^k messages and each message its ancestor 2^k steps up, so depth costs its logarithm in joins, and the rows
made are those of the answer. `ranked` keeps the best-scored branches of a tree; `formatted` writes a path as

    <s>[ROLE]role[/ROLE]\\ntext</s>

per message, in order. Inside roles and texts the characters & < [ are written as &amp; &lt; &lsqb;, so no control string
can occur there, and reading undoes exactly that. The loss mask is a list of spans (turn, start, length) of the output, one for each
assistant text.

Null roles and texts are empty; a null parent, or one that isn't there, makes a root; messages that only lead into
a circle have no root and no path; repeated rows are messages of their own; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import parked

OPEN, ROLE_OPEN, ROLE_END, CLOSE = "<s>", "[ROLE]", "[/ROLE]\n", "</s>"
# Order matters: the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escaped(c: Column) -> Column:
    for plain, mark in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescaped(c: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def chained(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each row's parent is the row before it by turn (ties by role, then text)."""
    kept = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return kept.select("tree", at.alias("message"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """`tree`, `leaf`, `message`, `up` (steps above the leaf) for every message of every root-to-leaf path."""
    known = messages.select("tree", F.col("message").alias("known"))
    links = messages.select("tree", "message", "parent")
    links = links.join(known, (links.tree.eqNullSafe(known.tree)) & (links.parent == known.known), "left").select(links.tree.alias("tree"), "message", F.col("known").alias("parent"))
    links = parked(links, "reply-links")
    parents = links.filter("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = links.join(parents, links.tree.eqNullSafe(F.col("t")) & (links.message == F.col("p")), "left_anti")
    reach = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).alias("up"))
    jump, step = links.filter("parent IS NOT NULL"), 1  # messages with an ancestor so many steps up; fewer each round
    while not jump.isEmpty():
        over = jump.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("parent").alias("to"))
        more = reach.join(over, reach.tree.eqNullSafe(over.t) & (reach.message == over.m)).select("tree", "leaf", F.col("to").alias("message"), (F.col("up") + step).alias("up"))
        reach = parked(reach.unionByName(more), "reply-paths")
        onward = jump.alias("a").join(over.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.t")) & (F.col("a.parent") == F.col("b.m")))
        jump = parked(onward.select("a.tree", "a.message", F.col("b.to").alias("parent")), "reply-jumps")
        step *= 2
        if step > 1 << 40:
            raise ValueError("messages reply in a circle")
    return reach


def ranked(reach: DataFrame, messages: DataFrame, best: int | None = None) -> DataFrame:
    """The messages of each path with `rank`, 1 for the tree's branch with the highest mean score (ties by leaf)."""
    own = messages.select("tree", "message", "role", "text", "score").alias("m")
    r = reach.alias("r")
    rows = r.join(own, F.col("r.tree").eqNullSafe(F.col("m.tree")) & (F.col("r.message") == F.col("m.message"))).select("r.tree", "leaf", "up", "role", "text", "score")
    means = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.col("mean").desc(), "leaf")
    places = means.withColumn("rank", F.row_number().over(order)).drop("mean")
    if best is not None:
        places = places.filter(F.col("rank") <= best)
    p = places.alias("p")
    return rows.alias("x").join(p, F.col("x.tree").eqNullSafe(F.col("p.tree")) & (F.col("x.leaf") == F.col("p.leaf"))).select("x.tree", "x.leaf", "rank", "up", "role", "text")


def formatted(rows: DataFrame) -> DataFrame:
    """One row for each path: tree, leaf, rank, n_turns, formatted, and loss spans (turn from 0, start from 1 in the turn, length)."""
    head = F.concat(F.lit(OPEN + ROLE_OPEN), escaped(F.col("role")), F.lit(ROLE_END))
    body = escaped(F.col("text"))
    lines = rows.select("tree", "leaf", "rank", "up", F.concat(head, body, F.lit(CLOSE)).alias("line"), (F.length(head) + 1).alias("start"), F.length(body).alias("length"), (F.col("role") == "assistant").alias("learn"))
    held = lines.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "line", "start", "length", "learn"))).alias("turns"))
    spans = F.filter(
        F.transform("turns", lambda t, k: F.struct(k.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["learn"].alias("learn"))),
        lambda s: s["learn"],
    )
    spans = F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    text = F.array_join(F.transform("turns", lambda t: t["line"]), "")
    return held.select("tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), spans.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation, each up to its closing mark."""
    return F.filter(F.split(text, CLOSE, -1), lambda t: t != "")


def read_role(turn: Column) -> Column:
    return unescaped(F.substring_index(F.substr(turn, F.lit(len(OPEN + ROLE_OPEN) + 1)), ROLE_END, 1))


def read_text(turn: Column) -> Column:
    head = F.substring_index(turn, ROLE_END, 1)
    return unescaped(F.substr(turn, F.length(head) + len(ROLE_END) + 1))


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    turns = turns_of(text)
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(turns[s["turn"]], s["start"], s["length"]))), "")
