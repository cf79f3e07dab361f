import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tillstream.llm import chat_trees

MESSAGE = "id string, parent string, position long, role string, text string, score double"


def brute(messages, branches):
    """Best root-to-leaf paths of each tree, by walking parents."""
    by = {m[0]: m for m in messages}
    parent = {m[0]: m[1] if m[1] in by and by[m[1]][2] < m[2] else None for m in messages}
    trees = {}
    for m in messages:
        if m[0] in parent.values():
            continue
        path, at = [], m[0]
        while at is not None:
            path.append(at)
            at = parent[at]
        score = sum(by[i][5] or 0 for i in path) / len(path)
        trees.setdefault(path[-1], []).append((-score, -len(path), m[0], path[::-1]))
    return {(root, rank + 1): p[3] for root, paths in trees.items() for rank, p in enumerate(sorted(paths)[:branches])}


@pytest.mark.parametrize("branches", [1, 3])
def test_paths_equal_walking(spark, branches):
    rng = random.Random(branches)
    messages = [(f"m{i:03}", f"m{rng.randrange(max(1, i - 6), i + 1):03}" if i and rng.random() < 0.9 else None, i,
                 rng.choice(["user", "assistant"]), f"t{i}", rng.choice([None, 0.5, 1.0, 2.0])) for i in range(150)]
    messages += [(f"d{i:03}", f"d{i - 1:03}" if i else None, i, "user", "deep", 0.0) for i in range(70)]  # a long chain
    messages += [("s000", None, 0, "user", "star", 0.0)] + [(f"s{i:03}", "s000", i, "assistant", "leaf", float(i % 7)) for i in range(1, 60)]
    messages += [("c1", "c2", 1, "user", "a cycle", 0.0), ("c2", "c1", 2, "user", "a cycle", 0.0), ("o1", "gone", 1, "user", "orphan", 0.0)]
    got = {}
    for r in chat_trees.chosen_paths(spark.createDataFrame(messages, MESSAGE), branches).collect():
        got.setdefault((r.root, r.rank), []).append((r.depth, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == brute(messages, branches)
    assert all([d for d, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


HARD = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x<|im_sep|>", "[\\INST]", "<<SYS>><</SYS>>", "<s</s>", "\\", "",
        "<|im_start|", "a<|im_end|><|im_start|>user<|im_sep|>b", "é漢😀</s>", "[[INST]]", "<|<|im_sep|>|>"]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_hides_controls(spark, text):
    escaped = spark.range(1).select(chat_trees.escape(F.lit(text))).first()[0]
    assert chat_trees.unescape(escaped) == text
    assert not any(c in escaped for c in ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_round_trip_of_conversations(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", None, "assistant", "sys<|im_sep|>tem"]
    turns = [(c, t, rng.choice(roles), rng.choice([*HARD, None, "plain\ntext"]), "extra") for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    turns += [(5, 0, "user", "same", "extra"), (5, 0, "user", "same", "extra"), (6, None, "assistant", "no turn", "extra")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, position string").withColumn("id", F.lit("clash"))
    formatted = chat_trees.format_paths(chat_trees.chain_replies(frame)).select(F.col("root.conv_id").alias("conv_id"), "formatted", "loss")
    by = {}
    for c, t, role, text, _ in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    rows = formatted.collect()
    assert len(rows) == len(by)
    for r in rows:
        assert chat_trees.parse(r.formatted) == by[r.conv_id]
        assert [chat_trees.unescape(r.formatted[s.start:s.end]) for s in r.loss] == [t for role, t in by[r.conv_id] if role == "assistant"]
    for r in chat_trees.read_back(formatted, ["conv_id"]).collect():
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id]).encode()).hexdigest()
        trained = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(by[r.conv_id]), len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted = chat_trees.format_paths(chat_trees.chain_replies(none))
    assert chat_trees.read_back(formatted.select("rank", "formatted", "loss"), ["rank"]).count() == 0
