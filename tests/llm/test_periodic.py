"""Periodic runs against a search of every lag word by word."""

import hashlib
import random
import re
import time
import zlib

from rastermill.llm import periodic
from rastermill.llm.queries import op12_periodic_runs
from tests.llm.helpers import SF, needs_tables, none, odd


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_random_words():
    rnd = random.Random(3)
    for _ in range(400):
        kinds, n = rnd.choice([1, 2, 3, 5, 50]), rnd.randint(0, 400)
        w = [str(rnd.randrange(kinds)) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 3:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 2))
                for i in range(a, a + rnd.randint(p, n - a) if n - a >= p else a):
                    w[i] = w[a + (i - a) % p]
        assert periodic.find_runs(w) == brute_runs(w)


def test_words_with_many_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic.find_runs(b) == brute_runs(b)


def test_long_texts_are_quick():
    start = time.time()
    assert periodic.find_runs(["x"] * 300_000) == [(0, 300_000, 1)]
    words = [str(i * 7919 % 100_003) for i in range(100_000)]
    assert periodic.find_runs(words * 3) == [(0, 300_000, 100_000)]
    assert time.time() - start < 20


def test_collapse():
    words = [*"zy", *"abc" * 5, "q"]
    assert periodic.find_runs(words) == [(2, 15, 3)] and periodic.collapsed(words, [(2, 15, 3)]) == "z y a b c q"


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(odd(spark)).collect()]
    assert len(rows) == odd(spark).count()
    assert (8, 30_000, [(0, 30_000, 1)], "word") in rows and (1, 0, [], "") in rows and (2, 0, [], "") in rows and (3, 0, [], "") in rows
    assert periodic.periodic_runs(none(spark)).count() == 0 and periodic.planted(none(spark)).count() == 0


@needs_tables
def test_query(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w) if n < 1500 else periodic.find_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == digest("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r["collapsed_sha256"] == digest(" ".join(x for i, x in enumerate(w) if i not in gone))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        expected = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == expected
    assert planted
