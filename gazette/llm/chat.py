"""Chat formatting: reply trees to training conversations, with DataFrame functions.

Messages (tree, msg, parent, role, text, score) form trees. Iterative
self-joins enumerate root-to-leaf paths: every message keeps a pointer to an
ancestor and every leaf the set of ancestors found so far; a round doubles both,
so a thread of n turns takes log2(n) rounds, and the rows are as many as the
paths are long. Branches are ranked by the mean score of their messages, and the
best `branches` of each tree are formatted as one conversation each.

Format of a turn: ``### role: text</turn>`` and a line feed. In roles and texts
a backslash is doubled, and one is put into every ``##`` and ``</``, so neither
mark can appear inside a turn; removing the first backslash of each pair gives
the text back. `loss` holds the code point spans of assistant texts.

Defined cases: null role or text is empty; a null score counts as 0; a message
whose parent is missing is a root; messages on a cycle of parents, and those below
one, have no root and belong to no path; of messages that repeat (tree, msg), the first by
(parent, role, text) is used, and ties between branches go to the smaller leaf;
an empty table gives an empty result. In the registered query a conversation's
rows are one thread by (turn, role, text), so repeated rows are turns of their
own, and null conv_ids are one conversation.

Scale: joins on (tree, msg) spread one hot tree over all tasks; only a
finished conversation is put together in one place, as it is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.util import load, written
from gazette.session import scratch_path

ROLE, SEP, END = "### ", ": ", "</turn>\n"
#: Conversation added by the contract, and the text of its two turns (fixed values).
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def escaped(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), "#(?=#)", r"#\\"), F.lit("</"), F.lit("<\\/"))


def escaped_role(c: Column) -> Column:
    """As in texts, and without a separator inside."""
    return F.replace(escaped(c), F.lit(":"), F.lit("\\:"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, msg, up) of every root-to-leaf path; up: steps from the leaf. `messages` has tree, msg, parent."""
    nodes = written(messages.groupBy("tree", "msg").agg(F.min(F.struct(F.col("parent").isNull(), "parent"))["parent"].alias("parent")), "chat-nodes")
    known = nodes.select("tree", F.col("msg").alias("parent"))
    # pointers to the parent, none at a root
    jump = written(nodes.join(known, ["tree", "parent"]).select("tree", "msg", F.col("parent").alias("to")), "chat-links")
    leaves = nodes.select("tree", "msg").join(nodes.select("tree", F.col("parent").alias("msg")).where("msg is not null").distinct(), ["tree", "msg"], "left_anti")
    # pointers to the ancestor 1, 2, 4, ... steps up, as long as any message has one
    jumps, most = [], nodes.count()
    while not jump.isEmpty() and 1 << len(jumps) < most:
        jumps.append(jump)
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.to") == F.col("b.msg")))
                       .select("a.tree", "a.msg", F.col("b.to").alias("to")), "chat-jump")
    # who still has an ancestor as many steps up as there are messages is on a cycle or below one
    endless = jump.select("tree", "msg")
    if not jump.isEmpty():
        leaves = leaves.join(endless, ["tree", "msg"], "left_anti")
    found = written(leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up")), "chat-found")
    for k, jump in enumerate(jumps):
        more = found.alias("f").join(jump.alias("j"), (F.col("f.tree") == F.col("j.tree")) & (F.col("f.msg") == F.col("j.msg"))) \
            .select("f.tree", "f.leaf", F.col("j.to").alias("msg"), (F.col("f.up") + (1 << k)).alias("up"))
        found = found.unionByName(written(more, "chat-more"))
    return found


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, turn, role, text): the best branches of each tree, turns from 0; None keeps all."""
    once = messages.groupBy("tree", "msg").agg(F.min(F.struct(F.col("parent").isNull(), "parent", F.coalesce("role", F.lit("")).alias("role"),
                                                              F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
    p = paths(messages).join(once, ["tree", "msg"])
    p = p.select("tree", "leaf", "up", "m.role", "m.text", "m.score")
    ranks = p.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("up").alias("last"))
    if branches is not None:
        ranks = ranks.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("branch") <= branches)
    else:
        ranks = ranks.withColumn("branch", F.lit(1))
    return p.join(ranks.drop("score"), ["tree", "leaf"]).select("tree", "leaf", "branch", (F.col("last") - F.col("up")).alias("turn"), "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss) of (tree, leaf, turn, role, text): one text per path and its loss mask."""
    head = F.concat(F.lit(ROLE), escaped_role(F.col("role")), F.lit(SEP))
    body = escaped(F.col("text"))
    one = F.struct("turn", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn"))
    rows = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(one)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
            F.when(x["learn"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end")))))
            .otherwise(a["spans"]).alias("spans")))
    return rows.select("tree", "leaf", text.alias("formatted"), spans["spans"].alias("loss"))


def parsed(conversations: DataFrame) -> DataFrame:
    """`conversations` with turns (array of role, text) read from the formatted text, and learned, the text under the loss mask."""
    pieces = F.filter(F.split("formatted", END), lambda x: x != "")
    # the first colon that no backslash escapes; the only repeated group takes pairs of backslashes, which needs no stack
    head = r"^### ([\s\S]*?(?<!\\)(?:\\\\)*+): "
    role = lambda x: F.regexp_extract(x, head, 1)
    text = lambda x: F.regexp_extract(x, head + r"([\s\S]*+)$", 2)
    turns = F.transform(pieces, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(text(x)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return conversations.withColumn("turns", turns).withColumn("learned", learned)


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of every conversation, read back from the formatted output."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    messages = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), n.alias("msg"), "role", "text", F.lit(0.0).alias("score")) \
        .withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1))
    out = scratch_path(spark, "conversations")
    formatted(best_paths(written(messages, "chat-messages"))).write.parquet(out)
    back = parsed(spark.read.schema("tree string, leaf long, formatted string, loss array<struct<start:int,end:int>>").parquet(out))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.expr("try_cast(tree AS long)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
