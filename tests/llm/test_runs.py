"""Periodic runs against all stretches tried one by one."""

import hashlib
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ziplore.llm import runs
from ziplore.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by extending every pair of places."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            end = i
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end + p - i
            if length >= max(12, 2 * p):
                found.setdefault((i, length), p)
            i = end + 1
    return sorted((s, size, p) for (s, size), p in found.items())


def words_of(text):
    return (text or "").encode().split()


def numbered(words) -> np.ndarray:
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def found(words):
    return [tuple(r) for r in runs.find_runs(numbered(words)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 40)), max_size=12), st.integers(0, 10**6))
def test_equals_brute_force(parts, seed):
    """Random words between stretches that repeat."""
    rng = np.random.default_rng(seed)
    words = []
    for kind, size in parts:
        block = rng.integers(0, 2 + kind, size).tolist()
        words += block * int(rng.integers(1, 5))
    assert found(words) == brute(words)


def test_all_short_words_over_two_letters():
    for n in (12, 13):
        for bits in range(1 << n):
            words = [bits >> k & 1 for k in range(n)]
            assert found(words) == brute(words)


def test_common_extensions_equal_brute_force():
    rng = np.random.default_rng(4)
    words = np.tile(rng.integers(0, 3, 70), 9).astype(np.int32)
    words[rng.integers(0, len(words), 2)] = 9
    suffixes, n = runs.SampledSuffixes(words), len(words)
    i, j = np.sort(rng.integers(0, n, (2, 20000)), axis=0)
    longest = np.array([next((k for k in range(n - b) if words[a + k] != words[b + k]), n - b) for a, b in zip(i, j)])
    ask = (i < j) & (longest >= runs.V)
    assert ask.sum() > 100
    assert (suffixes.common(i[ask], j[ask]) == longest[ask]).all()


def test_every_difference_meets_the_cover():
    assert runs.MEETING.max() < runs.V


def test_very_long_texts_take_near_linear_time():
    for words in ([0] * 200_000, list(range(200_000)), [0, 1, 0, 2, 3] * 40_000, list(range(100_000)) * 2):
        began = time.monotonic()
        got = found(words)
        assert time.monotonic() - began < 60
        assert len(got) == (0 if len(set(words)) == 200_000 else 1)
        assert all(length == 200_000 for _, length, _ in got)


def planted(doc_id, text):
    """The words of the contract, straight from its rule."""
    words = words_of(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    rows = brute(words)
    dropped = {i for s, size, p in rows for i in range(s + p, s + size)}
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in rows)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(rows), *best, 1000 * best[1] // best[2] if rows else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))


def test_query_equals_brute_force(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if len(t or "") < 8000 or zlib.crc32(str(i).encode()) % 10 == 0]
    got = {r[0]: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(docs) > 150 and sum(len(words_of(t)) > 0 and zlib.crc32(str(i).encode()) % 10 == 0 for i, t in docs) > 10
    for doc_id, text in docs:
        assert got[doc_id] == expected(doc_id, text)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (6, "x y " * 30),
    (7, "\x0b\x0cq\x1cw q\x1cw " * 8), (None, "b c " * 9), (8, "é ü " * 40 + "z " + "é ü " * 40),
    (9, "w" * 300_000 + " " + "v " * 20), *((i, "one two three four five six seven eight nine ten " * 3) for i in range(60, 120)),
]


def test_awkward_rows_and_columns(spark, tmp_path):
    rows = [(t, i, f"r{k}", "c") for k, (i, t) in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "text string, doc_id long, runs string, `odd name` string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert by_id(got) == by_id([expected(i, t) for i, t in AWKWARD])
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "odd name", "n_words", "runs", "collapsed"]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    assert {r["collapsed"] for r in out.filter("doc_id = 5").collect()} == {"a"}
    assert out.filter("doc_id = 1").first()["n_words"] == 0


@pytest.mark.parametrize("text", ["a b c " * 20, "p q " + "a b c " * 20 + "z"])
def test_collapsed_keeps_the_first_period(spark, text):
    row = runs.periodic_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert row["collapsed"].split() == list(dict.fromkeys(text.split()))
    assert row["runs"][0]["period"] == 3
