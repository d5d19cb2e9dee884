"""Phrase mining against a plain count, at several shard sizes."""

import collections
import random
import re

import numpy as np
import pytest

from tickloom.llm import phrases


def plain_counts(rows, longest):
    counts = collections.Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts.update((lang or "und", " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts


def plain_collocations(counts, support):
    found = {key: f for key, f in counts.items() if f >= support}
    rows = []
    for (lang, phrase), a in found.items():
        words = phrase.split(" ")
        if len(words) == 1:
            continue
        inside = [f for (other, longer), f in found.items() if other == lang and len(longer.split(" ")) > len(words) and f" {phrase} " in f" {longer} "]
        if any(100 * f >= 80 * a for f in inside):
            continue
        cuts = [(counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        rows.append((lang, -score, -a, phrase.encode(), l, r))
    out, rank = [], collections.Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        rank[lang] += 1
        out.append((lang, rank[lang], phrase.decode(), -a, l, r, -score))
    return out


def made(size, seed=3):
    """Texts with a language on two thirds of all rows, and one passage that comes back."""
    rng = random.Random(seed)
    words = "The of a red fox é É runs x-y \x00 under über".split(" ")
    texts = []
    for k in range(size):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\x85"]) for _ in range(rng.randrange(60)))
        texts.append((rng.choice(["en", "en", "en", "en", None, "und", "de"]), body + ("one red fox under the moon" if k % 3 == 0 else "")))
    return [*texts, ("en", None), (None, None), ("en", ""), ("fr", " .\n"), *[("en", "same text over and over")] * 40]


@pytest.fixture(scope="module")
def sample():
    return made(1200)


@pytest.mark.parametrize("words, slots", [(1 << 22, 1 << 26), (500, 1 << 20), (37, 1 << 20), (500, 64)])
def test_counts_are_exact(monkeypatch, sample, words, slots):
    """Shards of any size, also with a full bit map, find every phrase at the support with its whole count."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SHARD_WORDS", words)
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "BLOCK", min(slots, phrases.BLOCK))
    whole = plain_counts(sample, 4)
    rows = [(lang or "und", text or "") for lang, text in sample]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[k : k + 50])], names=["lang", "text"]) for k in range(0, len(rows), 50)])
    total = sum(f for (_, phrase), f in whole.items() if " " not in phrase)
    union, told = None, 0
    for sizes in (range(1, 3), range(3, 5)):
        mined = list(phrases.locally_frequent(batches(), 30, total, sizes, union))
        told += sum(len(p.as_py()) // 2 for batch in mined for p in batch["places"])
        union = np.zeros(slots // 64, np.uint64) if union is None else union
        for batch in phrases.summed(iter(mined), 30):
            for block, bits in zip(batch["block"].to_pylist(), batch["bits"].to_pylist()):
                union[block * phrases.BLOCK // 64 : (block + 1) * phrases.BLOCK // 64] |= np.frombuffer(bits, "<u8")
    kept = int(np.bitwise_count(union).sum())
    assert words > 10_000 or slots < 100 or kept < told  # the bound rules out
    counts = collections.Counter()
    for batch in phrases.counted(batches(), union, 4):
        for lang, phrase, size, f in zip(*(batch[c].to_pylist() for c in ("lang", "phrase", "size", "f"))):
            assert len(phrase.split(" ")) == size
            counts[lang, phrase] += f
    assert {k: f for k, f in counts.items() if f >= 30} == {k: f for k, f in whole.items() if f >= 30}
    assert all(whole[k] == f for k, f in counts.items())


def test_collocations_equal_plain_version(spark, sample):
    docs = spark.createDataFrame(sample, "lang string, text string").repartition(5)
    whole = plain_counts(sample, 4)
    counts = phrases.frequent(docs).cache()
    assert {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()} == {k: f for k, f in whole.items() if f >= 30}
    got = [tuple(r) for r in phrases.collocations(counts).orderBy("lang", "rank").collect()]
    want = plain_collocations(whole, 30)
    assert got == want and len(want) > 20
    assert [tuple(r) for r in phrases.collocations(counts, top=3).orderBy("lang", "rank").collect()] == [r for r in want if r[1] <= 3]
    counts.unpersist()


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 9)], "lang string, phrase string, size int, f long")
    row = phrases.collocations(counts).first()
    assert row["score"] == 2_000_000 * (big - 9) // (2 * big - 7)


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, lang string, text string, phrase string, n long, rank int, `a.b` int"
    odd = spark.createDataFrame([(k % 3 or None, lang, text, "p", 1, 2, 3) for k, (lang, text) in enumerate(made(20))], schema)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = phrases.op12_phrases(spark, str(tmp_path)).collect()
    found = {(r["lang"], r["phrase"]) for r in rows}
    assert ("en", "same text over and") in found and ("en", "same text") not in found  # always inside the longer one
    assert {r["lang"] for r in rows} <= {"en", "und", "de", "fr"}
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert phrases.op12_phrases(spark, f"{tmp_path}/none").count() == 0
