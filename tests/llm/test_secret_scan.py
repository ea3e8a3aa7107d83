"""Secrets: the patterns against the rules word for word, the tests against what they must tell apart."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import secret_scan as s

FILL = "the quick brown fox jumps over the lazy dog and runs through the forest of words "


def rule_spans(text):
    """The contract's patterns, matched first and measured after."""
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def texts():
    draw = random.Random(8)
    parts = ["password", "PassWd", "SECRET", "toKen", "api_key", "APIKEY", "toKen", "ſecret", "\"", "'", " ", ":", "=", ": ", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJ1234", "deadbeef", "x.y-z/", "é", "\n", "Zz9", "0" * 16]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]


def test_patterns():
    found = 0
    for t in texts():
        assert s.base_spans(t) == rule_spans(t), t
        found += len(rule_spans(t))
    assert found > 500


def random_string(seed, n, letters=string.ascii_letters + string.digits):
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(n))


def test_query_columns(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = s.query(spark, sf_dir).collect()
    assert sorted(docs) == sorted(r["doc_id"] for r in rows)
    for r in rows:
        base = rule_spans(docs[r["doc_id"]])
        text = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert set(text.split(",")) <= set(r["spans"].split(",")) or not text


def test_random_strings_are_added_and_words_are_not(documents):
    secret = {i: random_string(i, n) for i, n in enumerate([20, 24, 32, 40, 64, 300] * 4)}
    rows = [(i, f"{FILL}{FILL} here {body} there. password={random_string(i, 20)}") for i, body in secret.items()]
    words = ["internationalisation_of_everything", "a" * 40, "abcdefghijklmnopqrstuvwxyz" * 2, "pneumonoultramicroscopicsilicovolcanoconiosis", "=" * 60, "-" * 30, "01" * 20, "ABABABABABABABABABABABAB"]
    rows += [(100 + i, f"{FILL} {w} {FILL}") for i, w in enumerate(words)] + [(200, None), (201, ""), (202, FILL * 3000), (0, rows[0][1])]
    found = {r["row"]["doc_id"]: r["spans"] for r in s.secrets(documents(rows, spans=F.lit("clash"), base=F.lit(1), bins=F.lit(2))).collect()}
    added = {i: [(x["start"], x["end"]) for x in v if x["kind"] == 3] for i, v in found.items()}
    hit = sum(added[i] == [(len(FILL) * 2 + 6, len(FILL) * 2 + 6 + len(body))] for i, body in secret.items())
    assert hit >= len(secret) - 2  # each of three tests may reject one random string in a thousand
    assert not any(added[i] for i in added if i >= 100)
    assert all(any(x["kind"] == 0 for x in found[i]) for i in secret)


def test_battery_levels():
    """Each test rejects random strings about as often as its level says."""
    values = np.array([s.battery(random_string(i, 64, s.ENCODINGS["base64"]))[1:] for i in range(2000)])
    assert np.all(np.abs((values < 0.05).mean(axis=0) - 0.05) < 0.03)


@pytest.mark.parametrize(("body", "name"), [("0123456789" * 2, "decimal"), ("0a1b" * 5, "hex"), ("ABCD2345" * 3, "base32"), ("aZ9+/" * 4, "base64"), ("aZ9-_" * 4, "base64url"), ("a+_" * 7, "mixed")])
def test_encoding(body, name):
    assert s.encoding(body) == name


def dashed(seed, digits="0123456789abcdef", groups=(8, 4, 4, 4, 12)):
    return "-".join(random_string(f"{seed} {k}", n, digits) for k, n in enumerate(groups))


UPPER_HEX = "0123456789ABCDEF"
KINDS_OF_HEX = {
    **{f"upper {n}": lambda i, n=n: random_string(i, n, UPPER_HEX) for n in (24, 32, 40, 64)}, "uuid": dashed, "upper uuid": lambda i: dashed(i, UPPER_HEX),
    "groups of five": lambda i: dashed(i, string.ascii_uppercase + string.digits, (5,) * 5),
}


@pytest.mark.parametrize("kind", KINDS_OF_HEX)
def test_battery_keeps_upper_and_dashed_hex(kind):
    rejected = np.mean([min(s.battery(KINDS_OF_HEX[kind](i))[1:]) < s.LEVEL for i in range(2000)])
    assert rejected < 0.01


def test_upper_and_dashed_hex_are_added(documents):
    fill = "In 1900 A Cab, in 2010 A Decade And A Day; 100 Added, 2000 Called. An Account of 1,000 and 100 cars, each at 20 and a day. " * 4
    made = [KINDS_OF_HEX[k](i) for i in range(10) for k in ("upper 64", "uuid", "upper uuid")]
    rows = [(i, f"{fill}here {body} there. {fill}") for i, body in enumerate(made)]
    slugs = ["a-decade-and-a-day-of-cars-and-cabs", "internationalisation_of_everything", "2010-10-10-2010-10-10-2010", "a-b-a-b-a-b-a-b-a-b-a-b-a-b"]
    rows += [(100 + i, f"{fill} {w} {fill}") for i, w in enumerate(slugs)]
    found = {r["row"]["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == 3] for r in s.secrets(documents(rows)).collect()}
    hit = [found[i] == [(len(fill) + 5, len(fill) + 5 + len(body))] for i, body in enumerate(made)]
    assert sum(hit) >= len(made) - 3 and not any(found[100 + i] for i in range(len(slugs)))


def test_longer_strings_need_less_luck():
    frequency = np.ones(256) + np.bincount(np.frombuffer((FILL * 50).encode(), np.uint8), minlength=256)
    short, long = (np.median([-np.log10(s.ordinary(random_string(i, n), "base62", frequency)) for i in range(50)]) for n in (8, 16))
    assert long > short > 3


def test_discovery_limit():
    assert s.discovery_limit({0: 100}) is None and s.discovery_limit({}) is None
    assert s.discovery_limit({0: 990, 45: 10}, 0.01) == 45
    assert s.discovery_limit({0: 990, 20: 10, 60: 5}, 0.01) == 60


def test_empty(documents):
    assert s.secrets(documents([(1, "a")]).limit(0)).count() == 0


def test_candidates_stay_clear_of_spans_in_one_walk():
    """Against every span compared with every candidate, and in time for a text of megabytes."""
    import time

    draw = random.Random(8)
    for _ in range(300):
        text = " ".join(draw.choice(["token=", "x" * draw.randint(1, 30), "0" * draw.randint(10, 40), "AKIA" + "Q" * draw.randint(1, 20), "a1B2" * draw.randint(1, 9)]) for _ in range(20))
        taken = s.base_spans(text)
        free = [(m.start(), m.end()) for m in s.CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in taken)]
        assert [(a, b) for a, b, _ in s.candidates(text, taken)] == [(a, b) for a, b in free if len(text[a:b].strip("=_-")) >= s.CANDIDATE_LEAST]
    log = ("token=abcdefghijkl0123 " + "Zx9" * 10 + "\n") * 90_000
    begun = time.perf_counter()
    assert len(s.candidates(log, s.base_spans(log))) == 90_000 and time.perf_counter() - begun < 30
