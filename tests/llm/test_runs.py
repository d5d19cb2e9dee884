"""Periodic runs against a plain search, and the extension structure against direct comparison."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All runs by comparing every word with the one a period further on."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            begin = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - begin + q
            if length >= max(6, 4 * q):
                found.setdefault((begin, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def found(texts):
    return [([tuple(map(int, r)) for r in mine], None if text is None else text.decode()) for mine, text in runs.found_in(t if t is None else t.encode() for t in texts)]


def test_cover_meets_every_difference():
    assert {(a - b) % runs.COVER_SIZE for a in runs.COVER for b in runs.COVER} == set(range(runs.COVER_SIZE))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=300), st.integers(1, 40))
def test_extensions_equal_comparison(words, period):
    words = np.asarray((words + words[:period] * 5 + words) + [-1], np.int32)
    lce = runs.CoverLce(words)
    n = len(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(0, n, 3), np.arange(n)))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i, j):
        k = 0
        while max(a, b) + k < n and words[a + k] == words[b + k]:
            k += 1
        want.append(k)
    assert lce.extend(i, j).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 9)), max_size=8), max_size=6))
def test_runs_equal_plain_search(documents):
    texts = [" ".join(w for part, times in d for w in part * times) for d in documents]
    for text, (mine, collapsed) in zip(texts, found(texts)):
        words = text.split()
        assert mine == plain_runs(words) and collapsed == plain_collapsed(words, mine)


def test_chunks_change_nothing(monkeypatch):
    texts = ["a b " * k + "c" for k in range(40)] + [None, "", "x " * 500]
    whole = found(texts)
    monkeypatch.setattr(runs, "CHUNK_WORDS", 50)
    assert found(texts) == whole and whole[-1] == ([(0, 500, 1)], "x") and whole[-3] == ([], None)


def test_long_texts():
    rng = np.random.default_rng(1)
    words = [str(w) for w in rng.integers(0, 5000, 300_000)]
    words[1000:201_000] = (words[1000:41_000]) * 5
    ((mine, collapsed),) = found([" ".join(words)])
    assert any(q == 40_000 and n >= 200_000 for _, n, q in mine) and len(collapsed.split()) <= 140_000
    ((mine, collapsed),) = found(["a " * 200_000])
    assert (mine, collapsed) == ([(0, 200_000, 1)], "a")


def test_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = runs.op13_runs(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        words = planted(r["doc_id"], WORD.findall(texts[r["doc_id"]] or ""))
        want = plain_runs(words)
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (best[1] and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in want)) and r["collapsed_sha256"] == sha(plain_collapsed(words, want))
        some += bool(want)
    assert some > len(rows) / 20


ODD = [(1, "a b\tc\x0bd " * 9), (1, "a b\tc\x0bd " * 9), (None, "x " * 7), (2, None), (None, None), (3, ""), (4, " \n\t "), (5, "é é " * 8), (6, "q " * 5)]


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, runs long, periodic string, `a.b` int"
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in ODD], schema)
    got = runs.with_runs(docs, runs.F.col("text"), "found").collect()
    by_row = {(r["doc_id"], r["text"]): r["found"] for r in got}
    assert len(got) == len(ODD) and all(r["periodic"] == "x" and r["a.b"] == 2 for r in got)
    assert by_row[1, ODD[0][1]]["collapsed"] == "a b c d" and [tuple(r) for r in by_row[1, ODD[0][1]]["runs"]] == [(0, 36, 4)]
    assert by_row[2, None]["collapsed"] is None and by_row[3, ""]["collapsed"] == "" == by_row[4, " \n\t "]["collapsed"]
    assert by_row[5, ODD[7][1]]["collapsed"] == "é é" and not by_row[6, "q " * 5]["runs"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = runs.op13_runs(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) and all(r["collapsed_sha256"] and r["runs_sha256"] for r in rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert runs.op13_runs(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n, times", [(1, 6), (3, 4), (50, 4)])
def test_shortest_runs(n, times):
    text = " ".join(f"w{k}" for k in range(n))
    ((mine, _),) = found([" ".join([text] * times)])
    assert mine == [(0, n * times, n)]
    ((mine, _),) = found([" ".join([text] * (times - 1) + [text.rsplit(" ", 1)[0] if n > 1 else ""])])
    assert mine == []
