"""Mixing against plain water filling and a plain search for the multipliers."""

import collections
import math
import re

import pytest

from tickloom.llm import mixing


def plain_targets(sizes, most=3, weights=(1, 2, 3)):
    """``sizes``: words by source. Shares by weight, again and again, of what the full ones leave."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got = {s: 0.0 for s in names}
    excess, free = float(sum(sizes.values())), list(names)
    while excess > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += excess * weight[s] / total
        excess = sum(max(0.0, got[s] - most * sizes[s]) for s in free)
        for s in free:
            got[s] = min(got[s], float(most * sizes[s]))
        free = [s for s in free if got[s] < most * sizes[s]]
    return got


def plain_rates(sizes, target, most=3):
    """Rates of documents of these sizes, by bisection."""
    largest = max(sizes)
    low, high = -60.0 * largest, 60.0 * largest
    for _ in range(200):
        middle = (low + high) / 2
        words = sum(s * min(most, math.exp(min(2.0, middle * s / largest))) for s in sizes)
        low, high = (middle, high) if words < target else (low, middle)
    return [min(most, math.exp(min(2.0, low * s / largest))) for s in sizes]


def check(rows, given):
    """``rows``: tuples source, size, source_size, target, taken, rate, copies."""
    assert sorted(map(repr, (r[:2] for r in rows))) == sorted(map(repr, given))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = plain_targets({s: sum(r[1] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        target, size = want[s], sum(r[1] for r in rs)
        assert all(r[2] == size and math.isclose(r[3], target, rel_tol=1e-9, abs_tol=1e-6) for r in rs)
        assert all(r[4] == r[1] * r[6] and 0 <= r[6] <= 3 for r in rs)
        sized = [r for r in rs if r[1]]
        if not sized:
            continue
        if target < 3 * size:
            for r, plain in zip(sized, plain_rates([r[1] for r in sized], target)):
                assert math.isclose(r[5], plain, rel_tol=1e-3, abs_tol=1e-4)
        off = abs(sum(r[4] for r in rs) - target)
        assert off <= max(r[1] for r in sized) / 2 + 1e-6
        if len({r[1] for r in sized}) >= 8:
            assert off <= 1 + 0.005 * target


def got(mix):
    return [(r["row"]["source"], r["size"], r["source_size"], r["target"], r["copies"] * r["size"], r["rate"], r["copies"]) for r in mix.collect()]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    words = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs}
    rows = mixing.op11_mix(spark, sf).collect()
    assert rows and len(rows) == len(docs)
    check([(words[r["doc_id"]][0], *r[1:]) for r in rows], list(words.values()))
    assert sorted(rows) == sorted(mixing.op11_mix(spark, sf).collect())


def test_reruns_agree_however_the_rows_are_dealt(spark):
    docs = spark.createDataFrame([(k, f"s{k % 7}", 1 + k * k % 97) for k in range(1000)], "doc_id long, source string, size long")
    runs = [sorted((r["row"]["doc_id"], r["copies"]) for r in mixing.mixed(docs.repartition(n), mixing.F.col("source"), mixing.F.col("size")).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize(
    "rows",
    [
        [("hot", 10)] * 400 + [("a", k % 50 + 1) for k in range(150)] + [(None, k % 9) for k in range(60)] + [("é", 700)] * 3,
        [("one", 5000)] + [("many", k % 13 + 1) for k in range(300)] + [("empty", 0)] * 5 + [("tiny", 1)],
        [(f"s{k % 40:02}", 1 + (k * k * 7 + k) % 401) for k in range(900)],
        [("", 1), ("a", 1), (None, 1), ("a\x00", 4)],
        [("only", 0)],
    ],
)
def test_mix(spark, rows):
    """Hot sources and sizes, identical rows, null, empty and one-document sources."""
    docs = spark.createDataFrame(rows, "source string, size long")
    check(got(mixing.mixed(docs, mixing.F.col("source"), mixing.F.col("size"))), rows)


def test_extra_columns_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, source string, s string, size string, rank int, part int, n int, row int, `a.b` int, m map<string,int>"
    rows = [(k % 4 or None, text, source, "x", "y", 1, 2, 3, 4, 5, {"k": 1}) for k, (text, source) in enumerate([("a b", "p"), (None, "p"), ("", None), ("c " * 50, "q"), ("c " * 50, "q")])]
    docs = spark.createDataFrame(rows, schema)
    mix = mixing.mixed(docs, mixing.F.col("source"), mixing.words_of(mixing.F.col("text")))
    kept = mix.select("row.*").collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, docs.collect())) and mix.where("copies < 0 or copies > 3").isEmpty()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op11_mix(spark, str(tmp_path)).count() == 5
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mixing.op11_mix(spark, f"{tmp_path}/none").count() == 0
