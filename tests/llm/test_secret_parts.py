"""Keys beside `=`, in URLs and in paths."""

import base64
import random
import string

import pytest

from tillstream.llm import secret_scan

WORDS = string.ascii_letters + string.digits


def key(rng, symbols, n):
    return "".join(rng.choice(symbols) for _ in range(n))


def planted(place, rng):
    """(text, key) with a key of the alphabet that the place allows."""
    if place == "path":
        k = key(rng, WORDS, 40)
        return f"see https://cdn.example.com/my-site/some_files/{k} now", k
    if place == "url_safe":
        k = key(rng, WORDS, 16) + "-" + key(rng, WORDS, 14) + "_" + key(rng, WORDS, 12)
        return f"see https://example.com/a/b/{k}/", k
    if place == "dash_before":
        k = key(rng, WORDS, 16) + "/" + key(rng, WORDS, 14) + "+" + key(rng, WORDS, 12)
        return f"my-{k} it", k
    if place == "padded":
        k = base64.b64encode(rng.randbytes(40)).decode()
        return f"blob={k} end", k
    k = key(rng, WORDS, 40)
    return {"env": f"AWS_KEY={k}\n", "sig": f"https://x.example.com/blob?sv=2020-08-04&sig={k}&se=1", "pat": f"export GITHUB_PAT={k}",
            "chain": f"a=b=c={k}=d"}[place], k


@pytest.mark.parametrize("place", ["env", "sig", "pat", "chain", "padded", "path", "url_safe", "dash_before"])
def test_planted_keys_are_candidates(place):
    rng, found = random.Random(place), 0
    for _ in range(200):
        text, k = planted(place, rng)
        at = text.index(k)
        # In a path the folder before the key may go with it, as base64 has a slash.
        found += any(at - 6 * (place == "path") <= s <= at and e == at + len(k) and p < 60
                     for s, e, _, p in secret_scan.candidates(text, secret_scan.base_spans(text)))
    assert found >= 180


def test_known_key_after_name():
    k = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXbMPLEKEY"
    text = f"AWS_SECRET_ACCESS_KEY={k}"
    assert (22, 22 + len(k)) in [c[:2] for c in secret_scan.candidates(text, secret_scan.base_spans(text))]


def test_parts_of_runs():
    assert secret_scan.candidates("=" * 40, []) == [] and secret_scan.candidates("=-/" * 30, []) == []
    rng = random.Random(4)
    for _ in range(300):
        text = key(rng, WORDS + "+/-_=", rng.randint(20, 300)) + " " + key(rng, "-_/=ab", 60)
        spans = [c[:2] for c in secret_scan.candidates(text, [])]
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all("=" not in text[s:e].rstrip("=") and not text[s:e].startswith("=") for s, e in spans)


def test_one_very_long_run():
    rng = random.Random(6)
    text = key(rng, WORDS * 4 + "/-", 400_000)
    spans = [c[:2] for c in secret_scan.candidates(text, [])]
    assert len(spans) > 1_000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_parts_that_a_pattern_has_are_left_to_it():
    rng = random.Random(5)
    a, b = key(rng, WORDS, 40), key(rng, WORDS, 40)
    text = f"{a}=token={b}"
    base = secret_scan.base_spans(text)
    assert [s[2] for s in base if s[2] == "assign"] == ["assign"]
    assert [c[:2] for c in secret_scan.candidates(text, base)] == [(0, 40)]


def test_scan_reports_planted_keys(spark, documents, prose):
    rng = random.Random(11)
    rows = [(i, prose(i, 30) + " " + text + " " + prose(i + 1, 10), k)
            for i, place in enumerate(["env", "sig", "pat", "path", "url_safe"] * 20) for text, k in [planted(place, rng)]]
    got = {r.doc_id: r.spans for r in secret_scan.scan(documents([r[:2] for r in rows])).collect()}
    assert sum(any(t[s.start:s.end].removeprefix("files/") == k for s in got[i] if s.kind == "random") for i, t, k in rows) >= 90
