"""Chat formatting from reply trees (DataFrame functions only).

Messages form trees. Self-joins that double their reach each round enumerate
all root-to-leaf paths; branches are ranked by score, and each chosen path
becomes one formatted conversation with a loss mask.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline for each
turn. Inside roles and texts a backslash is put between ``<`` and ``|`` (and
one more where some stand there already), so no control string can appear, and
taking one away restores the text. In roles, newlines and backslashes are
escaped too.

Defined results: null texts and roles count as empty; ties of order are broken
by role, then text; a message whose parent is missing is a root; messages on a
cycle of parents belong to no path; messages of a null tree form one tree;
a message without an id is a leaf below its parent, each one for itself; of
several messages with one id the first counts, in order of parent (null first),
role, text and score; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.llm.shared import let, materialize

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Turns as a chain of messages: tree, node, parent, role, text, score."""
    rows = conversations.select(
        F.struct(F.col("conv_id")).alias("tree"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths: tree, leaf, node, up (steps above the leaf).

    A jump table maps each message to its ancestor 2^k steps above; joining it
    with itself doubles k, and joining it to the paths doubles their length.
    The number of rounds is the logarithm of the greatest depth.
    """
    nodes = materialize(messages.select("tree", "node", "parent"), "chat-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above"))
    jump = materialize(jump, "chat-jump")
    inner = jump.select("tree", F.col("above").alias("node")).distinct()
    leaves = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", "node")
    jumps, rounds, most = [], 0, max(1, nodes.count()).bit_length()
    while rounds <= most and not jump.isEmpty():
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("below"), F.col("above").alias("node"))
        jump = further.join(jump, ["tree", "node"]).select("tree", F.col("below").alias("node"), "above")
        jump = materialize(jump, "chat-jump")
        rounds += 1
    endless = jump.select("tree", "node")  # after that many doublings only cycles are left
    found = leaves.join(endless, ["tree", "node"], "left_anti")
    found = found.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    found = materialize(found, "chat-paths")
    for k, jump in enumerate(jumps):  # each round writes only what it adds
        step = found.join(jump, ["tree", "node"])
        step = step.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = found.unionByName(materialize(step, "chat-paths"))
    return found


def with_clean_ids(messages: DataFrame) -> DataFrame:
    """tree and node as structs that are never null, and each node once; parents fit them."""
    own = F.when(F.col("node").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    rows = messages.select(
        F.struct(F.col("tree").alias("id")).alias("tree"),
        F.struct(F.col("node").alias("id"), own.alias("own")).alias("node"),
        F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), F.lit(0).cast("long").alias("own"))).alias("parent"),
        "role",
        "text",
        "score",
    )
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return materialize(rows, "chat-ids").groupBy("tree", "node").agg(first).select("tree", "node", "m.*")


def format_trees(messages: DataFrame, branches: int | None = 1, assistant: str = "assistant", clean_ids: bool = False) -> DataFrame:
    """The best ``branches`` paths of each tree (None: all), each one formatted.

    ``clean_ids``: no tree or node is null and no node is listed twice, as in
    what ``conversation_tree`` makes; saves a shuffle of the texts.

    ``messages``: tree, node, parent, role, text, score. Branches are ranked by
    their mean score, then by leaf. Output: tree, leaf, branch_score,
    formatted, loss_spans (start and length in code points, texts only).
    """
    messages = messages.select("tree", "node", "parent", "role", "text", "score")
    messages = materialize(messages if clean_ids else with_clean_ids(messages), "chat-messages")  # read three times
    found = paths(messages)
    scored = found.join(messages.select("tree", "node", "score"), ["tree", "node"])
    chosen = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    if branches is not None:
        order = [F.desc("branch_score"), F.asc("leaf")]
        for key in (["tree", F.pmod(F.xxhash64("leaf"), F.lit(32))], ["tree"]):  # a hot tree is thinned in parts first
            rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
            chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= branches).drop("rank")
    turns = (
        found.join(chosen, ["tree", "leaf"])
        .join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
        .select(
            "tree",
            "leaf",
            "branch_score",
            F.struct(
                (-F.col("up")).alias("depth"),
                F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
                escape(F.coalesce("text", F.lit(""))).alias("body"),
                F.coalesce(F.col("role") == assistant, F.lit(False)).alias("learn"),
            ).alias("turn"),
        )
    )
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list("turn")).alias("turns")
    )
    tail = END + "\n"
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail)))

    def span(acc, t):
        begin = acc["at"] + F.length(t["head"])
        size = F.length(t["body"])
        own = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct(
            (begin + size + len(tail)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    tree, leaf = ("tree", "leaf") if clean_ids else (F.col("tree.id").alias("tree"), F.col("leaf.id").alias("leaf"))
    return whole.select(
        tree,
        leaf,
        "branch_score",
        F.array_join(parts, "").alias("formatted"),
        F.aggregate("turns", start, span, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Formatted text back to an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def turn(piece):
        return let(
            F.substring(piece, len(START) + 1, F.length(piece)),
            lambda rest: let(
                F.instr(rest, "\n"),
                lambda at: F.struct(
                    unescape_role(F.substring(rest, F.lit(1), at - 1)).alias("role"),
                    unescape(F.substring(rest, at + 1, F.length(rest))).alias("text"),
                ),
            ),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
    return F.array_join(cut, "")
