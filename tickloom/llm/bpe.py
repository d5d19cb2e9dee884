"""Byte-level BPE with higher-order functions.

A text is cut into words by a pattern. A word that is a token is one id. Else its bytes, as an array of ids, are folded:
each step merges the adjacent pair with the lowest rank, the leftmost of equals, until no pair has a rank. The rank map
is a literal: for each pair of ids the id that they merge into, which is its rank, in two tables where a pair has one
place each. The plan names it once, as the driver keeps the text of every plan. A step looks up only the two pairs that a
merge makes new.

Words that a sample of documents has more than once are encoded first, by a fold over these distinct words. With the
tokens they are a map in one written row, which a scalar subquery sends to the tasks, so that no plan holds them. The
sample decides where a word is encoded, never how; every other word is folded where it stands. Decoding concatenates the
byte strings of ids.

Edge cases: null and empty texts have no ids. There are no special tokens: their strings are ordinary text. Letters and
numbers are told apart by the Unicode tables of the Java runtime; characters that it does not know yet count as others.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, text_of
from tickloom.llm.quality import bound
from tickloom.session import written

#: White space, and the pattern that cuts words, in Java's syntax.
_S = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Documents in the sample for common words, and the most words that are sent.
SAMPLE_DOCS, MOST_COMMON = 10_000, 200_000
#: Larger than any rank.
NONE = (1 << 31) - 1
WIDE = 1 << 20
#: A column for the length of a plan.
KNOWN = "_bpe_known_words"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank on each line. The vocabulary's size does not grow with the data."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(token): int(rank) for token, rank in (r["value"].split() for r in lines)}


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def places(keys: list[int], *, room: float = 1.6) -> tuple[int, int, list[int | None], list[int | None]]:
    """Two tables for distinct keys, as numbers of keys by place: each key stands at its remainder by one of two primes."""
    size = max(64, int(len(keys) * room))
    while True:
        sizes = _prime_from(size), _prime_from(size + size // 7 + 2)
        tables: tuple[list[int | None], list[int | None]] = ([None] * sizes[0], [None] * sizes[1])
        for k in range(len(keys)):
            side, now = 0, k
            for _ in range(200):
                at = keys[now] % sizes[side]
                tables[side][at], now = now, tables[side][at]
                if now is None:
                    break
                side = 1 - side
            else:
                break
        else:
            return *sizes, *tables
        size += size // 4


def literal(values: Iterable[object], kind: str) -> Column:
    """An array known when the plan is made."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{kind}>")


def tables(entries: dict, number: Callable[[object], int], **room: float) -> dict[str, list]:
    """A map as keys and values by place in two tables; ``number`` gives a key's number."""
    keys = list(entries)
    _, _, *held = places([number(k) for k in keys], **room)
    named = {}
    for side, places_of in enumerate(held):
        named[f"keys_{side}"] = [None if k is None else keys[k] for k in places_of]
        named[f"values_{side}"] = [None if k is None else entries[keys[k]] for k in places_of]
    return named


def find(held: Column, key: Column, number: Column) -> Column:
    """The value of a key in a struct of ``tables``, null for keys that it does not have."""

    def at(side: int) -> tuple[Column, Column]:
        keys = held[f"keys_{side}"]
        place = F.pmod(number, F.size(keys)).cast("int")
        return F.get(keys, place) == key, F.get(held[f"values_{side}"], place)

    return F.when(*at(0)).when(*at(1))


def text_number(key: str) -> int:
    """What ``F.xxhash64`` gives."""
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def byte_text(word: Column) -> Column:
    """The bytes of a word as characters 0 to 255."""
    return F.when(F.octet_length(word) == F.length(word), word).otherwise(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"))


def last_merges(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each token of several bytes the two ids that merge into it, as one number, and its id."""
    found: dict[int, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            merged = [(ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, k = min((r, k) for r, k in merged)
            if best >= rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]] * WIDE + ranks[parts[1]]] = rank
    return found


class Bpe:
    """A vocabulary of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = last_merges(ranks)
        held = tables(pairs, lambda key: key, room=1.2)
        self._pairs = F.struct(*[literal(held[name], "bigint" if name.startswith("keys") else "int").alias(name) for name in held])
        size = max(ranks.values(), default=-1) + 1
        pieces, little = [""] * size, [""] * size
        for token, rank in ranks.items():
            pieces[rank] = token.decode("latin-1")
            little[rank] = rank.to_bytes(4, "little").hex()
        self._pieces, self._little = literal(pieces, "string"), literal(little, "string")
        self._bytes = literal((ranks.get(bytes([b])) for b in range(256)), "int")
        self.tokens = {}
        for token, rank in ranks.items():
            try:
                self.tokens[token.decode()] = [rank]
            except UnicodeDecodeError:
                pass  # part of a character, so no word

    def fold(self, word: Column) -> Column:
        """Ids of one word: its bytes' ids and the ranks of adjacent pairs, merged step by step."""
        return bound(self._pairs, lambda pairs: self._folded(word, pairs))

    def _folded(self, word: Column, pairs: Column) -> Column:
        def pair_rank(a: Column, b: Column) -> Column:
            key = a.cast("bigint") * WIDE + b
            return F.coalesce(find(pairs, key, key), F.lit(NONE))

        ids = F.transform(F.split(byte_text(word), ""), lambda c: F.get(self._bytes, F.ascii(c)))
        start = bound(ids, lambda s: F.struct(s.alias("s"), F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), pair_rank).alias("r")))

        def step(state: Column, _: Column) -> Column:
            s, r = state["s"], state["r"]

            def merged(found: Column) -> Column:
                best, k = F.shiftright(found, 32).cast("int"), found.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") + 1
                none = F.slice(r, 1, 0)
                left = F.when(k > 1, F.array(pair_rank(F.get(s, k - 2), best))).otherwise(none)
                right = F.when(k < F.size(r), F.array(pair_rank(best, F.get(s, k + 1)))).otherwise(none)
                symbols = F.concat(F.slice(s, F.lit(1), k - 1), F.array(best), F.slice(s, k + 2, F.size(s)))
                ranks = F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(s)))
                return F.when(best < NONE, F.struct(symbols.alias("s"), ranks.alias("r"))).otherwise(F.struct(s.alias("s"), none.alias("r")))

            # the lowest rank, and the leftmost place of equals, in one number
            lowest = F.array_min(F.transform(r, lambda x, i: F.shiftleft(x.cast("bigint"), 32) + i))
            return F.when(F.size(r) > 0, bound(lowest, merged)).otherwise(state)

        steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
        return F.aggregate(steps, start, step, lambda state: state["s"])

    def encode(self, text: Column, known: Column) -> Column:
        """Ids of a text; ``known`` has the ids of tokens and of words that have been encoded before, as a struct of ``tables``."""
        words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
        return bound(known, lambda held: F.flatten(F.transform(words, lambda w: F.coalesce(find(held, w, F.xxhash64(w)), self.fold(w)))))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids."""
        return F.encode(F.array_join(F.transform(ids, lambda k: F.get(self._pieces, k)), ""), "ISO-8859-1")

    def little_endian(self, ids: Column) -> Column:
        """Ids as unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(self._little, k)), ""))


def common_words(docs: DataFrame, bpe: Bpe, sample_docs: int = SAMPLE_DOCS, most: int = MOST_COMMON) -> dict[str, list[int]]:
    """Ids of words that are no tokens and that several of ``sample_docs`` documents have, ``most`` at most."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    words = drawn.select(F.explode(F.array_distinct(F.regexp_extract_all(text_of(), F.lit(PATTERN), F.lit(0)))).alias("word"))
    tokens = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(bpe.tokens, pa.string())}))
    often = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").join(tokens, "word", "left_anti")
    chosen = often.orderBy(F.desc("n"), "word").limit(most).select("word")
    return {r["word"]: r["ids"] for r in chosen.select("word", bpe.fold(F.col("word")).alias("ids")).collect()}


def known_words(spark: SparkSession, bpe: Bpe, common: dict[str, list[int]]) -> Column:
    """The ids of tokens and common words as a struct of ``tables``: a scalar subquery over one written row."""
    held = tables({**bpe.tokens, **common}, text_number)
    kinds = {name: pa.list_(pa.string() if name.startswith("keys") else pa.list_(pa.int32())) for name in held}
    row = written(spark.createDataFrame(pa.table({name: pa.array([held[name]], kinds[name]) for name in held})), "bpe-words")
    return row.select(F.struct("*")).scalar()


def encoded(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text``."""
    known = known_words(docs.sparkSession, bpe, common_words(docs, bpe))
    # higher-order functions take no subquery; the optimizer puts it in the place of the one column that names it
    return docs.withColumn(KNOWN, known).withColumn("ids", bpe.encode(text_of(), F.col(KNOWN))).drop(KNOWN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = Bpe(read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = encoded(documents(spark, sf_dir).select("doc_id", "text"), bpe)
    ids = F.col("ids")
    return rows.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(bpe.little_endian(ids), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(ids), 256).alias("decoded_sha256"),
    )
