"""Conversations from reply trees, in DataFrame functions only.

``best_paths`` enumerates root-to-leaf paths by self-joins that double their reach: after k rounds every node knows its
ancestor 2^k steps up and the summed score to there, so a thread of any length takes a logarithmic number of joins. A round writes
the nodes that had not reached their root before it, each once, and asks one number: how many have not yet. Leaves are
ranked by the score of their path; the paths of the chosen leaves are read off with the same jumps, largest first.

``format_paths`` writes one conversation for each chosen path. Control strings inside texts and roles are escaped
reversibly (``%`` too); ``read_turns`` and ``read_loss`` read a formatted conversation back.

Defined cases: null text and null role are empty; a parent that does not exist makes its node a root; nodes on a cycle hang
on no root and are in no path; rows of equal turn are ordered by role and text; a null conversation id is a conversation of
its own. A conversation is one output row, so one of its size must fit into a task; joins never gather one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.tables import staged

# The control strings of the template and what stands for their first character inside texts.
CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
MASKED = {"<": "%3C", "[": "%5B"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(MASKED[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for char, masked in MASKED.items():
        out = F.replace(out, F.lit(masked), F.lit(char))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def turn_nodes(rows: DataFrame) -> DataFrame:
    """Rows by turn as reply trees without branches: each row answers the one before it."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Nodes of the ``branches`` best root-to-leaf paths of each tree: conv_id, branch (from 1), depth (from 0), node.

    ``nodes``: conv_id, node, parent (null: a root), score. A path's score is the sum over its nodes, ties go to the smaller leaf.
    """
    tree = staged(nodes.select(F.struct("conv_id").alias("tree"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    parents = tree.select("tree", F.col("parent").alias("node")).where("parent IS NOT NULL").distinct()
    known = tree.select(F.col("tree").alias("t"), F.col("node").alias("up")).distinct()
    reach = (tree.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")), "left")
             .select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    # rising[k]: nodes with an ancestor 2^k steps up; rooted: nodes that have reached their root, in the round they did.
    rising: list[DataFrame] = []
    rooted: list[DataFrame] = []
    here, left = staged(reach, "jump0"), -1
    while True:
        rooted.append(here.where("up IS NULL"))
        before, left = left, here.where("up IS NOT NULL").count()
        if left in (0, before):
            break  # none left, or none got to a root in this round: only cycles are
        rising.append(here.where("up IS NOT NULL"))
        above = reduce(DataFrame.unionByName, [*rooted, rising[-1]]).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("steps").alias("longer"))
        here = staged(rising[-1].join(above.hint("merge"), (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
                      .select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"),
                              (F.col("steps") + F.col("longer")).alias("steps")), f"jump{len(rising)}")
    leaves = reduce(DataFrame.unionByName, rooted).join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))
    paths = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "branch", "node", (F.col("steps") - 1).alias("depth"))
    paths = staged(paths, "leaves")
    for k in range(len(rising) - 1, -1, -1):
        jump = rising[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        above = (paths.join(jump.hint("merge"), (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
                 .select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")))
        paths = staged(paths.unionByName(above), "paths")
    return paths.select(F.col("tree.conv_id").alias("conv_id"), "branch", "depth", "node")


def turn_text(role: Column, text: Column) -> tuple[Column, Column]:
    """A formatted turn and the length of what precedes its text."""
    body, other = escape(text), escape(role)
    user, system, assistant = role == "user", role == "system", role == "assistant"
    formatted = (F.when(user, F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]")))
                 .when(assistant, F.concat(F.lit(" "), body, F.lit(" </s>")))
                 .when(system, F.concat(F.lit("<<SYS>> "), body, F.lit(" <</SYS>>")))
                 .otherwise(F.concat(F.lit("[ROLE] "), other, F.lit(" [/ROLE] "), body, F.lit(" </s>"))))
    return formatted, F.when(assistant, F.lit(1))


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each path: conv_id, branch, ``formatted`` and ``loss_spans`` (code points of assistant texts, start from 0)."""
    texts = nodes.select(F.struct("conv_id").alias("tree"), "node", "role", "text")
    rows = paths.select(F.struct("conv_id").alias("tree"), "branch", "depth", "node").join(texts, ["tree", "node"])
    part, lead = turn_text(F.col("role"), F.col("text"))
    rows = rows.select("tree", "branch", "depth", part.alias("part"), lead.alias("lead"), F.length(escape(F.col("text"))).alias("size"))
    before = F.sum(F.length("part")).over(W.partitionBy("tree", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("lead"))
    turns = F.array_sort(F.collect_list(F.struct("depth", "part", "start", "size")))
    done = rows.groupBy("tree", "branch").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["start"].isNotNull()), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    return done.select(F.col("tree.conv_id").alias("conv_id"), "branch", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"),
                       spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation as (role, text), unescaped."""
    def inner(part: Column, lead: int, tail: int) -> Column:
        return F.substring(part, F.lit(lead + 1), F.length(part) - (lead + tail))

    def turn(part: Column) -> Column:
        rest = inner(part, len("[ROLE] "), len(" </s>"))
        role = F.substring_index(rest, " [/ROLE] ", 1)
        made = lambda r, t: F.struct(r.alias("role"), unescape(t).alias("text"))
        return (F.when(part.startswith("<s>[INST] "), made(F.lit("user"), inner(part, len("<s>[INST] "), len(" [/INST]"))))
                .when(part.startswith("<<SYS>> "), made(F.lit("system"), inner(part, len("<<SYS>> "), len(" <</SYS>>"))))
                .when(part.startswith("[ROLE] "), made(unescape(role), F.substring(rest, F.length(role) + len(" [/ROLE] ") + 1, F.length(rest))))
                .otherwise(made(F.lit("assistant"), inner(part, 1, len(" </s>")))))

    cut = F.filter(F.split(formatted, r"(?<=\[/INST\]|</s>|<</SYS>>)"), lambda p: p != "")
    return F.transform(cut, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                            F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
