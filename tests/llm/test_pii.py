import hashlib
import random
import re

import pytest

from conftest import SF
from tillstream.llm import pii, queries


def brute_luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    """The patterns as the contract has them, kind by kind."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and brute_luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m[0])]


def found(text):
    return [(pii.KINDS[k].name, s, e) for part in pii.spans(text) for s, e, k, _ in part]


PARTS = ["a", "b9", "x_y", "@", "@", ".", "-", " ", "+", "+1", "0", "7", "255", "256", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "(743)", "555",
         "é", "漢", "%", "\n", "192.168.0.1", "me@mail.example.com", "+1 (743) 555-3824", "00010.1.1.1"]


def test_base_spans_equal_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert [(k.name, s, e) for s, e, k in pii.base_spans(text)] == brute_base(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000, "1 2-" * 100_000, "a." * 100_000 + "@b",
                                  "DE00" * 80_000, "DE00 " * 60_000])
def test_long_runs_cost_linear_time(text):
    assert isinstance(pii.spans(text), tuple)


CHECKED = [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("iban", "FR14 2004 1010 0505 0001 3M02 606"),
           ("btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"), ("nir", "1 85 05 78 006 084 91"), ("steuer", "86 095 742 719"), ("dni", "12345678Z"), ("dni", "X1234567-L"),
           ("aba", "021000021")]


@pytest.mark.parametrize("kind, text", CHECKED)
def test_checksums_confirm(kind, text):
    at = pii.KINDS[pii.ORDER[kind]]
    assert at.check(text.replace(" ", ""))
    word = sorted(at.context)[0]
    line = f"the {word} is {text}, then"
    assert (kind, line.index(text), line.index(text) + len(text)) in found(line)
    last = max(i for i, c in enumerate(text) if c.isdigit())
    wrong = text[:last] + str((int(text[last]) + 1) % 10) + text[last + 1:]
    assert kind not in [k for k, _, _ in found(f"the {word} is {wrong}, then")]


def test_context_adjusts_the_score():
    assert found("ssn: 123-45-6789") == [("ssn", 5, 16)] and found("part number 123-45-6789") == [] and found("see 123-45-6789") == []
    assert found("ssn 666-45-6789") == found("ssn 123-00-6789") == []
    good, plain, bad = (pii.spans(t)[0][0][3] for t in ("login from 10.0.0.1", "at 10.0.0.1", "release 10.0.0.1"))
    assert good > plain > bad  # base spans stay, whatever their score
    cut = "x" * (pii.NEAR - 1) + " 10.0.0.1"
    assert pii.spans("sh" + "ip" + cut)[0][0][3] == plain


def test_two_accounts_and_overlaps():
    two = "DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606"
    assert [two[s:e] for k, s, e in found(two) if k == "iban"] == [two[:27], two[28:]]
    for text in ("card 4111 1111 1111 1111 account", "routing 4111111111111111"):
        assert [k for k, _, _ in found(text)] == ["card"]


def test_masking():
    text = "write me@mail.example.com or +1 (743) 555-3824, card 4111111111111111."
    assert pii.masked(text, 0) == "write <EMAIL> or <PHONE>, card <CARD>." and pii.masked(None, 0) is None and pii.masked("", 0) == ""
    assert pii.masked(text, 101) == text
    assert pii.masked("+1 4111 1111 1111 11", 0).count("<") == 1


def test_random_numbers_are_left_alone():
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10 ** 8, 10 ** 11)) for _ in range(3000))
    assert not pii.spans(text)[1]


def test_odd_rows_and_driver_table(spark, odd):
    got = pii.scan(odd).collect()
    assert len(got) == odd.count() and all(r.spans == [] for r in got)
    assert pii.scan(odd.limit(0)).count() == 0
    masked = pii.redact(odd)
    assert masked.dtypes == odd.dtypes and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.QUERIES["op12_pii_spans"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute_base(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
    assert sum(r.n_email for r in rows) and sum(r.n_card for r in rows) and sum(r.n_phone for r in rows)


def test_settings_are_put_back_and_long_texts_pass(spark, documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    long = "word 1.2.3.4 " * 400_000
    got = pii.scan(documents([(1, long), (2, long + "a@b.cd")]), batch_bytes=1 << 20).collect()
    assert sorted(len(r.spans) for r in got) == [400_000, 400_001] and spark.conf.get(name) == before
