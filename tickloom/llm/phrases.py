"""Phrase collocation mining, by SON partitioning.

``frequent`` counts every word and phrase that occurs at least ``support`` times in a language. The documents are cut into shards
of up to ``SHARD_WORDS`` words. First every shard is mined completely at the support lowered to its share
of all words, ``ceil(support * shard / all)``: a phrase that reaches the support everywhere reaches that in at least one shard. Where it does not, it
has at most one less, so the counts that the shards found and this bound for the others rule out most of what is frequent in few shards only.
The union of what is left is kept as a bit map of hashes, ``SLOTS`` bits whatever the corpus. Words and pairs are mined first;
longer phrases are made of pairs in the union only. Then every shard counts all its phrases in the
union and the counts are summed by phrase. A phrase that shares a slot with a candidate is counted as well, and falls to the
support like any other, so counts are exact and whole. With more shards than the support, a shard's support is one: shards then tell of
every pair, and the sums alone rule out. Results stay exact; once a corpus has many more distinct pairs than slots, the map rules out little
and the last shuffle grows towards the shards' distinct phrases.

``collocations`` scores phrases of two words or more: the cut after k words compares the phrase's count with those of both
sides, and the weakest cut counts. Phrases almost always seen inside a longer one are dropped.

Words and pieces: A-Z become lower case, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words;
phrases do not leave a piece. Bytes are compared as they are.

Edge cases: a null or empty text has no words. A null language is ``und`` and counts with it. Every row counts, also repeated
rows and null ids; overlapping occurrences count. Ties are ordered by count, then bytes. Other columns are not read. An empty table has
no phrases. Memory of a task: a shard's word numbers and sorted pairs, about 40 bytes a word, and its distinct words; a longer text is a shard alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, text_of
from tickloom.operators.series import first_rows
from tickloom.session import written

SUPPORT, MAX_WORDS, TOP = 30, 4, 2000
SCALE, INSIDE_OF_100 = 2_000_000, 80
SHARD_WORDS = 1 << 22
#: Small inputs are cut into as many shards at most, so that a shard's support stays above one.
FEWEST_SHARDS = 14
SLOTS = 1 << 26
BLOCK = 1 << 14
#: Words whose counts a task adds up before they are shuffled, and phrases that it holds for that.
COUNT_WORDS, HELD = 1 << 24, 1 << 20
#: Words that very many phrases begin or end with are looked up in as many copies.
COPIES = 16

#: What ends a piece, and what parts words within one.
PIECE_END, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
END = b"\xff"  # in no UTF-8 text
TABLE = bytes.maketrans(PIECE_END + BLANK, END * len(PIECE_END) + b" " * len(BLANK))


class _Numbers(dict):
    """Numbers of one language's words; all languages share the lists of words."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]) -> None:
        super().__init__({END: -1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class Shard:
    """Word numbers of some documents, -1 at the end of each piece. A word has a number for each language."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.numbers: dict[str, _Numbers] = {}
        self.documents: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(lang, self.words, self.langs)
        tokens = text.lower().translate(TABLE).replace(END, b" \xff ").split()  # bytes: lower-cases A-Z only
        tokens.append(END)
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        self.documents.append(ids)
        self.size += int((ids >= 0).sum())

    def ids(self) -> np.ndarray:
        """All word numbers; no document can be added any more."""
        whole = np.concatenate(self.documents)
        self.documents.clear()
        return whole

    def hashes(self) -> np.ndarray:
        """A hash of each language and word."""
        made = (hashlib.blake2b(word, digest_size=8, key=lang.encode()[:64]).digest() for word, lang in zip(self.words, self.langs))
        return np.frombuffer(b"".join(made), "<u8")


def slots(hashes: np.ndarray, ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Slots of the phrases of ``size`` words that begin at ``first``."""
    value = np.full(len(first), size, np.uint64)
    for k in range(size):
        value = (value ^ hashes[ids[first + k]]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value & np.uint64(SLOTS - 1)


def in_steps(positions: np.ndarray, step: int = 1 << 18) -> Iterator[np.ndarray]:
    return (positions[k : k + step] for k in range(0, len(positions), step))


def levels(
    ids: np.ndarray, longest: int, least: int, wanted: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``size, first positions, counts`` of the distinct phrases that occur ``least`` times or more.

    ``wanted`` tells by size and position which occurrences count. Of a phrase that is found all parts are, so a phrase of the next size is one found
    and another found a word later; ``part`` holds at each position the number of the phrase that begins there.
    """
    part = ids
    at = np.flatnonzero(part >= 0).astype(np.int32)
    parts = 0
    for size in range(1, longest + 1):
        if wanted is not None and len(at):
            at = np.concatenate([some[wanted(size, some)] for some in in_steps(at)])
        if not len(at):
            return
        key = part[at].astype(np.int64)
        if size > 1:
            key *= parts
            key += part[at + 1]
        ordered = np.sort(key)
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(begins, len(ordered)))
        often = counts >= least
        known, counts = ordered[begins[often]], counts[often]
        del ordered, begins, often
        if not len(known):
            return
        part = np.full(len(ids), -1, np.int32)
        first = np.empty(len(known), np.int32)
        for back in reversed(range(0, len(at), 1 << 18)):  # from the end, so that the first occurrence is what stays
            some, keys = at[back : back + (1 << 18)], key[back : back + (1 << 18)]
            number = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[number] == keys
            part[some[found]] = number[found]
            first[number[found][::-1]] = some[found][::-1]
        parts = len(known)
        del key
        yield size, first, counts
        at = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0)).astype(np.int32)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.large_binary())):
            shard.add(lang.as_py(), text.as_py())
            if shard.size >= SHARD_WORDS:
                yield shard
                shard = Shard()
    if shard.size:
        yield shard


def locally_frequent(
    batches: Iterator[pa.RecordBatch], support: int, total: int, sizes: range, union: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """``block, places, above, unseen``: the phrases that reach a shard's support, by their slots, for every block of slots.

    ``above`` is by how much a count is above ``unseen``, what a phrase may have that the shard does not tell of: one less than
    its support. Counts end at ``support``. Phrases shorter than ``sizes`` are told of in the map ``union`` already.
    """
    kind = np.min_scalar_type(support)
    for shard in shards(batches):
        least = max(1, -(-support * shard.size // total))
        ids, hashes = shard.ids(), shard.hashes()
        wanted = None if union is None else (lambda size, at: in_map(union, slots(hashes, ids, at, size)) if size < sizes.start else np.ones(len(at), bool))
        found, above = [], []
        for size, first, counts in levels(ids, sizes.stop - 1, least if union is None else 1, wanted):
            if size in sizes:
                often = counts >= least
                found.append(slots(hashes, ids, first[often], size))
                above.append(counts[often] - (least - 1))
        slot = np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.int64)
        value = np.concatenate([*above, np.empty(0, np.int64)])
        del ids, hashes, found, above
        order = np.argsort(slot)
        slot, value = slot[order], value[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        value = np.minimum(np.add.reduceat(value, starts), support).astype(kind) if len(starts) else value.astype(kind)
        slot = slot[starts]
        cuts = np.searchsorted(slot, np.arange(0, SLOTS + 1, BLOCK))
        places = (slot % BLOCK).astype("<u2")
        pieces = [(places[i:j].tobytes(), value[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        columns = [np.arange(len(pieces), dtype=np.int32), *map(list, zip(*pieces)), np.full(len(pieces), least - 1, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "places", "above", "unseen"])


def summed(batches: Iterator[pa.RecordBatch], support: int) -> Iterator[pa.RecordBatch]:
    """``block, bits``: slots whose phrases can reach the support. All shards' rows of a block are in one task, which holds sums only."""
    kind = np.min_scalar_type(support)
    sums: dict[int, np.ndarray] = {}
    unseen: dict[int, int] = {}
    for batch in batches:
        for block, places, above, slack in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "above", "unseen"))):
            held = sums.setdefault(block, np.zeros(BLOCK, np.int64))
            held[np.frombuffer(places, "<u2")] += np.frombuffer(above, kind)
            unseen[block] = unseen.get(block, 0) + slack
    for block, held in sums.items():
        bits = np.packbits((held > 0) & (held >= support - unseen[block]), bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])


def in_map(union: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (union[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def counted(batches: Iterator[pa.RecordBatch], union: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, size, f``: counts of all phrases in the union, added up over the shards of a task while ``HELD`` phrases hold them."""
    held: dict[tuple[str, int], dict[bytes, int]] = {}
    for shard in shards(batches):
        ids, hashes = shard.ids(), shard.hashes()

        def candidates(size: int, at: np.ndarray) -> np.ndarray:
            return in_map(union, slots(hashes, ids, at, size))

        for size, first, counts in levels(ids, longest, 1, candidates):
            for some, n in zip(in_steps(first, 1 << 16), in_steps(counts, 1 << 16)):
                for phrase, f in zip(ids[some[:, None] + np.arange(size)].tolist(), n.tolist()):
                    key = shard.langs[phrase[0]], size
                    if key not in held:
                        held[key] = {}
                    name = b" ".join([shard.words[w] for w in phrase])
                    held[key][name] = held[key].get(name, 0) + f
        del ids, hashes, shard
        if sum(map(len, held.values())) > HELD:
            yield from _emitted(held)
            held = {}
    yield from _emitted(held)


def _emitted(held: dict[tuple[str, int], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, size), found in held.items():
        names, counts = pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())
        for at in range(0, len(names), 1 << 16):
            n = min(1 << 16, len(names) - at)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), names.slice(at, n), pa.repeat(pa.scalar(size, pa.int32()), n), counts.slice(at, n)], names=["lang", "phrase", "size", "f"])


def totals(docs: DataFrame) -> DataFrame:
    """``lang, n``: all word occurrences of each language."""
    lang = F.coalesce(F.col("lang"), F.lit("und")).alias("lang")
    return docs.groupBy(lang).agg(F.sum(F.regexp_count(text_of(), F.lit(WORD)).cast("long")).alias("n"))


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = MAX_WORDS, total: int | None = None) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words with a count of at least ``support`` in their language.

    ``total`` is the number of words of all documents, if it is known already.
    """
    spark = docs.sparkSession
    if total is None:
        total = totals(docs).agg(F.sum("n")).first()[0] or 0
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_of().alias("text"))
    rows = rows.coalesce(max(-(-total // SHARD_WORDS), FEWEST_SHARDS))  # shards do not cross tasks

    def mined(sizes: range, before: np.ndarray | None) -> np.ndarray:
        """The union of what the shards found, as a bit map; it has the bits of ``before``."""
        known = None if before is None else spark.sparkContext.broadcast(before)  # SLOTS bits
        told = rows.mapInArrow(
            lambda batches: locally_frequent(batches, support, max(total, 1), sizes, None if known is None else known.value),
            "block int, places binary, above binary, unseen long",
        )
        maps = told.repartition("block").mapInArrow(lambda batches: summed(batches, support), "block int, bits binary").toArrow()  # SLOTS bits
        union = np.zeros(SLOTS // 64, np.uint64) if before is None else before.copy()
        for block, bits in zip(maps["block"].to_pylist(), maps["bits"].to_pylist()):
            union[block * BLOCK // 64 : (block + 1) * BLOCK // 64] |= np.frombuffer(bits, "<u8")
        return union

    union = mined(range(1, min(longest, 2) + 1), None)
    if longest > 2:
        union = mined(range(3, longest + 1), union)
    shared = spark.sparkContext.broadcast(union)  # SLOTS bits
    few = rows.coalesce(max(-(-total // COUNT_WORDS), FEWEST_SHARDS))  # the fewer tasks, the fewer counts of one phrase
    counts = few.mapInArrow(lambda batches: counted(batches, shared.value, longest), "lang string, phrase string, size int, f long")
    return counts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= support)


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def scored(counts: DataFrame, longest: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of every phrase of two words or more, at its weakest cut. ``counts`` holds all parts; it is read twice."""
    phrases = counts.where("size > 1")
    words = F.split("phrase", " ")
    cut = lambda k, side: F.struct(
        k.alias("k"), F.lit(side).alias("side"),
        F.array_join(F.slice(words, F.lit(1), k) if side == "l" else F.slice(words, k + 1, F.col("size") - k), " ").alias("part"),
        (k if side == "l" else F.col("size") - k).alias("words"),
    )
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(cut(k, "l"), cut(k, "r"))))
    sides = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("*", "c.*").drop("c")
    # single words are parts of very many phrases: their counts are repeated, and the phrases dealt over the copies
    copy = F.when(F.col("words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(COPIES))).otherwise(0)
    copies = F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))).alias("copy")
    parts = counts.where(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), F.col("f"), copies)
    both = sides.withColumn("copy", copy).join(parts, ["lang", "part", "copy"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}")
    wide = both.groupBy("lang", "phrase", "size", "a").agg(*[side(k, s) for k in range(1, longest) for s in "lr"])

    def value(k: int) -> Column:
        score = F.expr(f"cast({SCALE} as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))")
        return F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    weakest = F.array_min(F.array(*[value(k) for k in range(1, longest)]))
    return wide.select("lang", "phrase", "size", "a", weakest.alias("w")).select("lang", "phrase", "size", "a", "w.l", "w.r", "w.score")


def inside(counts: DataFrame) -> DataFrame:
    """``lang, phrase, f``: phrases of two words or more inside a longer one, with the longer one's greatest count."""
    words = F.split("phrase", " ")
    size = F.col("size")
    within = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
    longer = counts.where("size > 2").select("lang", "f", F.explode(F.array_distinct(F.flatten(within))).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def collocations(counts: DataFrame, longest: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, score``: the best phrases of each language. ``counts`` is read several times: give a written table."""
    longer = inside(counts).withColumnRenamed("f", "longer")
    mostly = F.coalesce(100 * _whole(F.col("longer")) >= INSIDE_OF_100 * _whole(F.col("a")), F.lit(False))
    kept = scored(counts, longest).join(longer, ["lang", "phrase"], "left").where(~mostly)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_rows(kept.select("lang", "phrase", "a", "l", "r", "score"), "lang", order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))  # at most ``top`` rows of a language
    return best.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("lang", "text")
    words = written(totals(docs), "phrase-totals")
    total = words.agg(F.sum("n")).first()[0] or 0
    counts = written(frequent(docs, total=total), "phrase-counts")
    return collocations(counts).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), placed AS (
  SELECT lang, piece, unnest(w) AS a, unnest(range(len(w))) AS i FROM words
), followed AS (
  SELECT lang, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS d FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS MATERIALIZED (
  SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM followed GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b AS phrase, count(*) FROM followed WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c AS phrase, count(*) FROM followed WHERE c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d AS phrase, count(*) FROM followed WHERE d IS NOT NULL GROUP BY ALL
), frequent AS MATERIALIZED (
  SELECT * FROM grams WHERE f >= 30
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1
), cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:k], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) ends(c) WHERE c < k
), sides AS MATERIALIZED (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts JOIN frequent x ON x.lang = cuts.lang AND x.phrase = first JOIN frequent y ON y.lang = cuts.lang AND y.phrase = rest
), weakest AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (VALUES (2), (3)) sizes(m), (VALUES (1), (2), (3)) begins(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
