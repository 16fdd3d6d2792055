"""Chat formatting of reply trees.

Messages form trees by parent. ``paths`` finds the root, the depth and the
score of every message by iterative self-joins that double the distance looked
back each time (a thread of n turns takes log2 n joins), ranks the leaves of
each root by the score of their branch, and lists the messages on the chosen
branches, again by doubling. ``format_paths`` then writes each chosen path as
one conversation, with character spans of what the loss is taken on, and
``parse`` reads such a text back.

Template: ``[INST] text [/INST]`` for the user, ``text</s>`` for the assistant
(after one space), ``<<SYS>>`` lines for the system, ``<<ROLE hex>>`` lines
for any other role, by its name in hex. In texts a backslash is doubled and the first sign of a
control string is replaced by a backslash with a letter, so no control string
is left inside a text and the text can be read back as it was."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm.common import prepare, read, table, text_key

CONTROL = re.compile(r"\\|<(?=/?s>|</?SYS>>|</?ROLE)|\[(?=/?INST\])|(?<=<)<(?=/?SYS>>|/?ROLE)")
ESCAPED = re.compile(r"\\([\\lb])")
INTO, BACK = {"\\": "\\\\", "<": "\\l", "[": "\\b"}, {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: INTO[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[1]], text)


#: What stands around the text of each role; other roles: ROLE with the name's UTF-8 in hex.
AROUND = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
ROLE_END = "\n<</ROLE>>\n"


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = AROUND.get(role) or (f"<<ROLE {role.encode().hex()}>>\n", ROLE_END)
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<<ROLE ", at):
            mark = formatted.index(">>\n", at)
            role, before, after = bytes.fromhex(formatted[at + 7 : mark]).decode(), formatted[at : mark + 3], ROLE_END
        else:
            role = next(r for r, (b, _) in AROUND.items() if formatted.startswith(b, at))
            before, after = AROUND[role]
        start = at + len(before)
        end = formatted.index(after, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return turns


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(root, rank, leaf, node, depth): the messages on the ``best`` highest
    branches of each root, by position.

    ``messages``: node (unique, not null), parent (null, or no node: a root)
    and score (null: 0). A branch scores the mean of its messages; ties go to
    the smaller leaf. A message in a cycle has no root and no path."""
    m = table(messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    ends = table(m.select("node").join(m.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti"), "leaves")
    there = m.select(F.col("node").alias("up"))
    first = m.join(there, F.col("parent") == F.col("up"), "left").select("node", F.col("up").alias("parent"), "score")
    # jump: the message 2^k back (null: beyond the root); top: the farthest seen so far; score and depth of the way there.
    # What has reached its root is done and only looked up from then on, so rounds get smaller.
    state = table(first.select("node", F.col("parent").alias("jump"), F.coalesce("parent", "node").alias("top"), "score", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "jumps")
    done, active = state.where("jump is null"), state.where("jump is not null")
    jumps, most, k = [active.select("node", "jump")], m.count(), 0
    while 2**k <= most and not active.isEmpty():
        far = done.unionByName(active).select(F.col("node").alias("at"), F.col("jump").alias("jump2"), F.col("top").alias("top2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        made = active.join(far, F.col("jump") == F.col("at")).select("node", F.col("jump2").alias("jump"), F.col("top2").alias("top"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        made = table(made, "jumps")
        done, active = done.unionByName(made.where("jump is null")), made.where("jump is not null")
        jumps.append(active.select("node", "jump"))
        k += 1
    # what is still active is led into a cycle
    leaves = done.join(ends, "node")
    ranked = leaves.select(F.col("top").alias("root"), F.col("node").alias("leaf"), "depth", (F.col("score") / (F.col("depth") + 1)).alias("mean"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mean"), "leaf"))).where(F.col("rank") <= best)
    on = table(ranked.select("root", "rank", "leaf", F.col("leaf").alias("node"), "depth"), "branches")
    for k, step in enumerate(jumps):  # before step k the rows reach 2^k - 1 messages back from the leaf
        back = on.join(step, "node").select("root", "rank", "leaf", F.col("jump").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        on = on.unionByName(table(back, "branches"))
    return on.select("root", "rank", "leaf", "node", "depth")


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, rank, leaf, formatted, loss_spans) of the paths; ``messages`` has
    root (of its tree), node, role and text (null: empty). Texts move once, to
    their root. One conversation is one row, made in one task; its spans count code points."""
    prepare(chosen.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    said = messages.groupBy("root").agg(F.collect_list(F.struct("node", text("role"), text("text"))).alias("said"))
    path = chosen.groupBy("root", "rank", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("path"))
    both = path.join(said, "root")

    @F.pandas_udf("formatted string, loss_spans array<struct<start:int,end:int>>")
    def make(paths_: pd.Series, said_: pd.Series) -> pd.DataFrame:
        got = []
        for nodes, rows in zip(paths_, said_, strict=True):
            of = {named(x["node"]): (x["role"], x["text"]) for x in rows}
            got.append(write([of[named(n)] for n in nodes]))
        return pd.DataFrame({"formatted": [x for x, _ in got], "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in got]})

    return both.select("root", "rank", "leaf", make("path", "said").alias("f")).select("root", "rank", "leaf", "f.*")


def named(node):
    """A node as a key: structs arrive as dictionaries."""
    return tuple(node.values()) if isinstance(node, dict) else node


def threads(rows: DataFrame) -> DataFrame:
    """Messages (root, node, parent, score, role, text) of conversation rows
    (conv_id, turn, role, text): each replies to the row before it by turn; rows of the same turn follow each
    other by role and by a hash of the text, so that texts needn't be there to number them. A node is (conversation, place),
    the root has place 1; a null conversation is one like others. Each message scores the length of its text."""
    node = lambda x: F.struct(F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit(0)).cast("long").alias("conv"), x.cast("long").alias("place"))
    keyed = rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text", text_key().alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score")).withColumn("root", node(F.lit(1)))
    order = Window.partitionBy("root").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "key")
    placed = keyed.withColumn("place", F.row_number().over(order).cast("long"))
    at = lambda x: F.struct(F.col("root.none").alias("none"), F.col("root.conv").alias("conv"), x.alias("place"))
    return placed.select("root", at(F.col("place")).alias("node"), F.when(F.col("place") > 1, at(F.col("place") - 1)).alias("parent"), "score", "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with n_turns, turns_sha256, loss_chars and loss_sha256, taken from the formatted text and its spans."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, mask in zip(texts, spans, strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return formatted.withColumn("d", digest("formatted", "loss_spans"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, and of -1."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    # two fixed rows of the contract, beside the table's own
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    messages = threads(rows.unionByName(extra))
    made = format_paths(paths(messages), messages)
    got = read_back(made)
    return got.select(F.when(~F.col("root.none"), F.col("root.conv")).alias("conv_id"), "d.*", F.length("formatted").cast("long").alias("formatted_chars"))

