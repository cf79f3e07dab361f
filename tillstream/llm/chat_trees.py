"""Chat formatting of reply trees.

Messages reply to one another and form trees. A path from a root to a leaf is one conversation. Paths
are found by iterative self-joins that double their reach: after r rounds every message knows its ancestor 2**r
replies up, so a conversation of d turns takes log2(d) rounds. Branches are ranked by the mean score
of their messages, the best `branches` of each tree are kept, and each is formatted as one string.

The template writes a turn as `<|im_start|>role<|im_sep|>text<|im_end|>`. Control strings inside a role
or a text get a backslash after their first character (one more, if there are some already), which
`unescape` takes away, so that no text can end its turn and none is changed by the round trip. The loss
mask lists the spans of assistant texts, in code points of the formatted string, end exclusive.

Skew: messages have unique ids, and each join has them on one side, so a message with a third of all
replies is a skewed side that Spark splits; pointers that have reached a root take no further part. A
conversation is one string by definition, so one task holds one path; no task holds a tree.

Defined results: null role and text count as empty; a message whose parent is null, absent, or does
not precede it (by `position`) starts a tree, so that cycles cannot occur; messages equal in every
column are one reply after the other; null scores count as 0; no messages give no paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillstream.llm.common import cut_lineage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
# Strings that common chat templates give a meaning to, after their first character.
CONTROL = ["\\|im_start\\|>", "\\|im_sep\\|>", "\\|im_end\\|>", "\\|endoftext\\|>", "\\|startoftext\\|>",
           "/?s>", "/?INST\\]", "</?SYS>>", "\\|begin_of_text\\|>", "\\|start_header_id\\|>",
           "\\|end_header_id\\|>", "\\|eot_id\\|>", "\\|user\\|>", "\\|assistant\\|>", "\\|system\\|>"]
_REST = "(" + "|".join(CONTROL) + ")"
ESCAPE = f"([<\\[])(\\\\*){_REST}"
UNESCAPE = f"([<\\[])\\\\(\\\\*){_REST}"
_UNESCAPE = re.compile(UNESCAPE)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)


def escape(column: Column) -> Column:
    return F.regexp_replace(column, ESCAPE, "$1\\\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def chain_replies(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as replies: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("position", F.row_number().over(order))
    return placed.select(
        F.struct("conv_id", "position").alias("id"),
        F.when(F.col("position") > 1, F.struct("conv_id", (F.col("position") - 1).alias("position"))).alias("parent"),
        "position", "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(leaf, root, rank, id, depth) of each message on each chosen path; depth counts from the root."""
    links = messages.select("id", "parent", "position", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    above = links.select(F.col("id").alias("parent"), F.col("position").alias("_before"))
    linked = links.filter("parent is not null").join(above, "parent", "left")
    real = cut_lineage(links.select("id", "score").join(
        linked.filter("_before < position").select("id", "parent"), "id", "left"))
    # up: the ancestor 2**r replies up (null: beyond the root); total: scores of the 2**r messages below it.
    jumps = [real.select("id", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).alias("steps"), F.col("id").alias("last"))]
    while True:
        now = jumps[-1]
        if now.filter("up is not null").isEmpty():
            break
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"),
                           F.col("steps").alias("steps2"), F.col("last").alias("last2"))
        moved = now.filter("up is not null").join(ahead, "up").select(
            "id", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("steps") + F.col("steps2")).alias("steps"), F.col("last2").alias("last"))
        jumps.append(cut_lineage(moved.unionByName(now.filter("up is null"))))
    whole = jumps[-1]  # every message: its root (last), depth (steps) and score from the root on
    parents = real.filter("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = whole.join(parents, "id", "left_anti").select(
        F.col("id").alias("leaf"), F.col("last").alias("root"), F.col("steps").alias("depth"), (F.col("total") / F.col("steps")).alias("score"))
    best = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("depth"), F.col("leaf"))
    ranked = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    # From the longest jump down each step doubles the messages reached; every depth is reached once.
    reached = cut_lineage(ranked.select("leaf", "root", "rank", F.col("leaf").alias("id"), "depth"))
    for r in range(len(jumps) - 2, -1, -1):
        size = 1 << r
        hop = jumps[r].filter("up is not null").select("id", "up")
        further = reached.join(hop, "id").select("leaf", "root", "rank", F.col("up").alias("id"), (F.col("depth") - size).alias("depth"))
        reached = cut_lineage(reached.unionByName(further))
    return reached


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Per chosen path: root, leaf, rank, n_turns, formatted, loss (start and end of each assistant text)."""
    paths = chosen_paths(messages, branches)
    turn = messages.select("id", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    path = Window.partitionBy("root", "leaf", "rank").orderBy("depth")
    head = len(START) + len(SEP)
    width = F.length("role") + F.length("text") + F.lit(head + len(END)).cast("long")
    lines = paths.join(turn, "id").withColumn("to", F.sum(width).over(path) - len(END)).withColumn(
        "turn", F.struct("depth", F.concat(F.lit(START), F.col("role"), F.lit(SEP), F.col("text"), F.lit(END)).alias("said"),
                         F.when(F.col("role") == ASSISTANT, F.struct((F.col("to") - F.length("text")).alias("start"), F.col("to").alias("end"))).alias("span")))
    turns = lines.groupBy("root", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("root", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.col("turns.said"), "").alias("formatted"), F.array_compact(F.col("turns.span")).alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame, carry: list[str]) -> DataFrame:
    """Digests of what formatted conversations say: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kinds = dict(formatted.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch["formatted"], batch["loss"]):
                turns = parse(text)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                trained = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                rows.append((len(turns), _sha(said), len(trained), _sha(trained), len(text)))
            found = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([batch[carry].reset_index(drop=True), found], axis=1)
    return formatted.select(*carry, "formatted", "loss").mapInPandas(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
