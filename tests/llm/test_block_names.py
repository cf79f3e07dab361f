import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillstream.llm import block_names


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((str(i), None if best[1] else best[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_groups_equal_brute_force(spark, documents, prose, block):
    rows = [(i, prose(i // 3, 5 + i)) for i in range(40)] + [(100 + i, prose(i, 30).replace(" ", "  ")) for i in range(10)]
    rows += [(200 + i, prose(i, 30)) for i in range(10)] + [(300, "abcabc"), (301, "abc"), (302, "ab cabc"), (303, None), (304, " \n"), (None, "abc")]
    got = block_names.exact_groups(documents(rows), block).collect()
    assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_a_key_of_two_blocks_is_replaced(documents):
    rows = [(i, f"text {i}") for i in range(20)]

    def key(block, seed):  # the first seed gives every block one key
        real = block_names._key(block, seed)
        return real if seed else F.struct(F.lit(1).cast("long").alias("k1"), F.lit(1).cast("long").alias("k2"))
    named = block_names.name_documents(documents(rows), key=key)
    assert named.select("level", "name").distinct().count() == 20
    with pytest.raises(RuntimeError):
        block_names.name_documents(documents(rows), key=lambda b, s: key(b, 0))


def test_drop_copies_keeps_columns_and_one_row_each(odd):
    kept = block_names.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in odd.collect()})


def test_empty_table(documents, odd):
    assert block_names.exact_groups(odd.limit(0)).count() == 0
    assert block_names.drop_copies(odd.limit(0)).count() == 0
