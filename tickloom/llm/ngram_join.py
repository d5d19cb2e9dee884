"""N-gram Jaccard join by prefix trees.

A text's set is its distinct shingles of five words, as 64-bit hashes; a text with fewer words is one shingle. Texts with
equal sets form a class. Two classes link when ``100 * |x & y| >= 75 * |x | y|``; components of links are the result.

1. Tokens in a global order, those in many documents last, then by hash. Linked classes share a token among the first
   ``n - ceil(0.75 n) + 1`` of both. Each class sends these tokens, and sets of classes under a shared token are groups.
2. Groups with the same members are one. In a group, classes of fitting size are compared by a bit map of their tokens:
   every differing bit is a differing token, so that no link is lost. Of what is left, only enough pairs to connect
   the classes leave the task: candidates' clusters, which hold near copies and little else.
3. A cluster's sets, read again from the texts, go into a trie in a global order, commonest first. The trie is walked
   once for all its sets: overlaps counted along a path are shared by all sets below it, and a subtree is left as soon
   as what remains of either side can't make up the overlap needed. Again only connecting pairs leave the task.

Groups and clusters beyond a size are cut into blocks, and each pair of blocks is a task of its own, so that one token
or cluster with a third of all rows needs no task that holds it.

Edge cases: null, empty and white-space texts have no shingles and are linked with nothing. A row without an id keeps a
null component unless an equal or linked text has one. Rows that repeat an id are judged each by its own text. Sets are
told apart by a 64-bit hash of their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents
from tickloom.llm.graph import components
from tickloom.session import written

SIZE = 5
#: Numerator and denominator of the least similarity.
LEAST, OF = 75, 100
#: A token in at least this share of a task's documents comes last in the order.
OFTEN = 1 / 2000
LEAST_BITS = 512
#: Most members of a group, and most tokens of a cluster, that one task compares; larger ones are cut into blocks.
GROUP_ROWS, CLUSTER_TOKENS = 4096, 400_000
#: Most rows of one token that are held to compare its members with other tokens'.
RUN = 1_000_000
CACHED_WORDS = 100_000
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SIZE)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | bytes | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. ``bytes.lower`` and ``bytes.split`` know ASCII only, as asked for."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = len(h) - SIZE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SIZE):
        s += h[k : k + n] * _POWERS[k]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of as many places as there are tokens, rounded up to a power of two.

    Two sets differ in at least as many tokens as bits. Half of the larger map added to the other half, bit by bit, is the
    map of half the size, so that sets of different size compare.
    """
    places = max(LEAST_BITS, 1 << int(len(tokens) - 1).bit_length()) if len(tokens) else LEAST_BITS
    counts = np.bincount((tokens >> np.uint64(32)).astype(np.int64) & (places - 1), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def prefix_length(n: np.ndarray | int):
    return n - -(-LEAST * n // OF) + 1


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 8000, tokens: int = 4_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys with ids, and shingles, of documents, some thousands at a time."""
    hashes, ids, sets, n = _Hashes(), [], [], 0
    for batch in batches:
        for key, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            ids.append((key, doc_id))
            sets.append(shingles(text, hashes))
            n += len(sets[-1])
            if len(ids) >= rows or n >= tokens:
                yield ids, sets
                ids, sets, n = [], [], 0
    if ids:
        yield ids, sets


def _table(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def described(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``key, doc_id, n, name, bits`` of every document, and the sorted tokens that are common.

    A token in a share ``OFTEN`` of all documents reaches that share in some stretch of documents that a task reads, and
    is found there. The stretches' findings are summed over all documents, and tokens whose sum stays under half of that
    share are left out: at most ``2 / OFTEN`` times a document's mean set size remain. They fix the order of tokens only.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches):
            every = np.concatenate(sets)
            token, n = np.unique(every, return_counts=True)
            common = n >= max(3, OFTEN * len(sets))
            yield _table(
                key=([k for k, _ in ids], pa.int64()), doc_id=([i for _, i in ids], pa.int64()), n=([len(s) for s in sets], pa.int64()), name=([class_of(s) for s in sets], pa.int64()),
                bits=([bitmap(s) for s in sets], pa.binary()),
            )
            yield _table(
                key=(token[common].view(np.int64), pa.int64()), doc_id=([None] * int(common.sum()), pa.int64()), n=(-n[common], pa.int64()), name=([0] * int(common.sum()), pa.int64()),
                bits=([None] * int(common.sum()), pa.binary()),
            )

    both = written(docs.select("key", "doc_id", "text").mapInArrow(describe, "key long, doc_id long, n long, name long, bits binary"), "shingle-classes")
    rows = both.where("n >= 0")
    total = rows.count()
    found = both.where("n < 0").groupBy("key").agg((-F.sum("n")).alias("n")).where(F.col("n") >= max(3.0, OFTEN * total / 2))
    common = np.sort(found.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    return rows, common


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``token, name`` for the first tokens of every class, in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = sent.value
        for _, sets in _chunks(batches):
            tokens, names, seen = [], [], set()
            for s in sets:
                name = class_of(s)
                if len(s) and name not in seen:
                    seen.add(name)
                    last = np.isin(s, late, assume_unique=True)
                    prefix = np.concatenate([s[~last], s[last]])[: prefix_length(len(s))]
                    tokens.append(prefix)
                    names.append(np.full(len(prefix), name, np.int64))
            if tokens:
                yield _table(token=(np.concatenate(tokens).view(np.int64), pa.int64()), name=(np.concatenate(names), pa.int64()))

    return docs.select("key", "doc_id", "text").mapInArrow(first_tokens, "token long, name long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gid, name`` of the classes under each token that has several; rows come sorted by token and name.

    ``gid`` is a hash of the members, so tokens with the same members make one group. A run of more than ``RUN`` rows is
    not held: its rows pass as they come, under a hash of the token.
    """
    known: set[int] = set()

    def group(names: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = np.unique(names)
        gid = class_of(names)
        if len(names) > 1 and gid not in known:
            if len(known) > CACHED_WORDS:
                known.clear()  # repeats that are no longer known are dropped after the shuffle
            known.add(gid)
            yield named(gid, names)

    def named(gid: int, names: np.ndarray) -> pa.RecordBatch:
        return _table(gid=(np.full(len(names), gid), pa.int64()), name=(names, pa.int64()))

    last, held, passing = None, [], False  # the token that the next batch may go on with, and its rows so far
    for batch in batches:
        token, name = (batch.column(c).to_numpy() for c in ("token", "name"))
        begin = 0
        if len(token) and token[0] == last:
            begin = int(np.searchsorted(token, last, side="right"))
            held.append(name[:begin])
            if passing or sum(map(len, held)) > RUN:
                passing = True
                yield named(class_of(np.array([last])), np.concatenate(held))
                held = []
        if begin == len(token):
            continue
        if held and not passing:
            yield from group(np.concatenate(held))
        token, name = token[begin:], name[begin:]
        starts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        several = np.flatnonzero(np.diff(starts)[:-1] > 1)
        for a, b in zip(starts[several], starts[several + 1]):
            yield from group(name[a:b])
        last, held, passing = token[-1], [name[starts[-2] :]], False
    if held and not passing:
        yield from group(np.concatenate(held))


def groups(rows: DataFrame) -> DataFrame:
    """``gid, name, members``: classes that share a token, groups with the same members once."""
    by_token = rows.repartition("token").sortWithinPartitions("token")
    found = written(by_token.mapInArrow(_shared, "gid long, name long").dropDuplicates(["gid", "name"]), "shingle-groups")
    return found.join(found.groupBy("gid").agg(F.count("*").alias("members")), "gid")


def in_blocks(rows: DataFrame, key: str, blocks: str, by: str) -> DataFrame:
    """``rows`` of a key for each pair of its blocks that they take part in, as ``key, i, j, block``. ``blocks`` is a column with their number."""
    block = F.pmod(F.xxhash64(by), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    placed = rows.withColumn("block", block).withColumn("other", other)
    return placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that are sorted by ``keys``, many small ones at a time."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        rest.append(batch.to_pandas())
        rows = pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
        if len(rows) == 0:
            continue
        same = np.logical_and.reduce([rows[k].to_numpy() == rows[k].iloc[-1] for k in keys])
        cut = len(rows) - int(same.sum())
        rest = [rows.iloc[cut:]]
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True)
    if rest and sum(map(len, rest)):
        yield pd.concat(rest, ignore_index=True)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs connect what earlier ones don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


class _Maps:
    """Bit maps of several sizes, to be compared in pairs."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(r) for r in raw])
        self.place, self.maps = np.zeros(len(raw), np.int64), {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.place[rows] = np.arange(len(rows))
            self.maps[size] = np.frombuffer(b"".join(raw[k] for k in rows), np.uint8).reshape(len(rows), size)

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that differ in each pair of maps, the larger one folded to the size of the smaller."""
        out = np.zeros(len(x), np.int64)
        kinds = self.size[x] * (1 << 32) + self.size[y]
        for kind in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == kind)
            sizes = kind >> 32, kind & 0xFFFFFFFF
            small = min(sizes)
            for at in range(0, len(rows), max(1, (1 << 22) // max(sizes))):
                some = rows[at : at + max(1, (1 << 22) // max(sizes))]
                pair = [self.maps[size][self.place[side[some]]] for size, side in zip(sizes, (x, y))]
                while pair[0].shape[1] > small:
                    pair[0] = pair[0][:, : pair[0].shape[1] // 2] ^ pair[0][:, pair[0].shape[1] // 2 :]
                while pair[1].shape[1] > small:
                    pair[1] = pair[1][:, : pair[1].shape[1] // 2] ^ pair[1][:, pair[1].shape[1] // 2 :]
                out[some] = np.bitwise_count((pair[0] ^ pair[1]).view(np.uint64)).sum(1)
        return out


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes in a group that sizes and bit maps allow; enough of them to connect the classes."""
    for rows in _by_key(batches, ["gid", "i", "j"]):
        key = rows.groupby(["gid", "i", "j"], sort=False).ngroup().to_numpy()
        n, name, block = rows["n"].to_numpy(), rows["name"].to_numpy(), rows["block"].to_numpy()
        apart = (rows["i"] != rows["j"]).to_numpy()
        maps = _Maps(rows["bits"].tolist())
        order = np.lexsort((n, key))
        found, pending = [], 0
        at, step = np.arange(len(order)), 1
        while True:
            # each row against the one that many places after it, while that has the same key and may be similar
            at = at[at < len(order) - step]
            x, y = order[at], order[at + step]
            near = (key[x] == key[y]) & (OF * n[x] >= LEAST * n[y])
            at, x, y = at[near], x[near], y[near]
            if not len(at):
                break
            most = (OF - LEAST) * (n[x] + n[y]) // (OF + LEAST)
            fits = (maps.differing(x, y) <= most) & ~(apart[x] & (block[x] == block[y]))
            found.append(np.stack([name[x[fits]], name[y[fits]]]))
            pending += int(fits.sum())
            if pending > 500_000:
                found, pending = [_connecting(found)], 0
            step += 1
        if found:
            a, b = _connecting(found)
            yield _table(a=(a, pa.int64()), b=(b, pa.int64()))


def _connecting(pairs: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(pairs, axis=1)
    return every[:, spanning(*every)]


class Trie:
    """Sets of small integers in ascending order; shared beginnings are stored once, runs without a branch in one node."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())  # big-endian, so sets with a common beginning meet
        self.nodes: list[tuple[np.ndarray, list[int], list[int]]] = []  # values, children, sets that end here
        self.low: list[int] = []
        self.high: list[int] = []
        self.sets = [sets[k].astype(np.int64) for k in order]
        self.order = order
        self.root = self._node(0, len(order), 0)

    def _common(self, first: int, last: int, depth: int) -> int:
        """Where the first and the last of sorted sets part, and so all between them."""
        x, y = self.sets[first][depth:], self.sets[last][depth:]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return depth + (int(differ[0]) if len(differ) else m)

    def _node(self, first: int, end: int, depth: int) -> int:
        stack, made = [(first, end, depth, -1)], 0
        while stack:
            first, end, depth, parent = stack.pop()
            until = self._common(first, end - 1, depth)
            here = len(self.nodes)
            self.nodes.append((self.sets[first][depth:until], [], []))
            sizes = [len(s) for s in self.sets[first:end]]
            self.low.append(min(sizes))
            self.high.append(max(sizes))
            if parent >= 0:
                self.nodes[parent][1].append(here)
            k = first
            while k < end and len(self.sets[k]) == until:
                self.nodes[here][2].append(self.order[k])
                k += 1
            while k < end:
                value, begin = self.sets[k][until], k
                while k < end and self.sets[k][until] == value:
                    k += 1
                stack.append((begin, k, until, here))
        return made

    def links(self, held: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Probes that link with a stored set, and that set.

        ``held`` has a row for each probe and a column for each value, ``rank`` the probes' own numbers. Overlaps are kept
        for all probes still in question; one leaves where the values still to come can't reach the overlap needed.
        """
        stack = [(self.root, np.arange(len(held)), np.zeros(len(held), np.int64), 0)]
        while stack:
            k, probes, overlap, depth = stack.pop()
            values, children, ending = self.nodes[k]
            if len(values):
                overlap = overlap + held[np.ix_(probes, values)].sum(1)
                depth += len(values)
            size = sizes[probes]
            # the least overlap with the smallest set below, and the most that can still be had from the largest one
            needed = -(-LEAST * (size + self.low[k]) // (OF + LEAST))
            left = np.minimum(self.high[k] - depth, size - overlap)
            alive = (overlap + left >= needed) & (OF * size >= LEAST * self.low[k]) & (OF * self.high[k] >= LEAST * size)
            probes, overlap = probes[alive], overlap[alive]
            if not len(probes):
                continue
            for stored in ending:
                n = depth
                hit = OF * overlap >= LEAST * (sizes[probes] + n - overlap)
                if hit.any():
                    yield rank[probes[hit]], stored
            stack += [(child, probes, overlap, depth) for child in children]


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that connect what others don't yet; with ``side``, between sets of different sides only."""
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(value), np.int64)
    place[np.lexsort((value, -count))] = np.arange(len(value))  # the commonest first: near copies share long beginnings
    ends = np.cumsum([len(s) for s in sets])
    ranks = [np.sort(place[column[e - len(s) : e]]) for s, e in zip(sets, ends)]
    stored = [k for k in range(len(sets)) if side is None or side[k] == 0]
    trie = Trie([ranks[k].astype(">u4") for k in stored])
    probes = np.array([k for k in range(len(sets)) if side is None or side[k] == 1])
    sizes = np.array([len(s) for s in sets])
    part, found = np.arange(len(sets)), []
    step = max(1, 8_000_000 // len(value))
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        held = np.zeros((len(some), len(value)), bool)
        for row, k in enumerate(some):
            held[row, ranks[k]] = True
        for hits, ending in trie.links(held, sizes[some], some):
            k = stored[ending]
            for p in hits[part[hits] != part[k]]:
                if part[p] != part[k]:
                    part[part == part[p]] = part[k]
                    found.append((int(p), k))
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connecting links within each cluster block; sets come from the texts."""
    hashes = _Hashes()
    for rows in _by_key(batches, ["cluster", "i", "j"]):
        a: list[int] = []
        b: list[int] = []
        for (_, i, j), part in rows.groupby(["cluster", "i", "j"], sort=False):
            seen: dict[int, tuple[np.ndarray, int]] = {}
            for name, block, text in zip(part["name"], part["block"], part["text"]):
                seen[name] = (shingles(text, hashes), int(block == j))
            side = None if i == j else np.array([s for _, s in seen.values()])
            if len(seen) < 2 or side is not None and side.min() == side.max():
                continue
            names = list(seen)
            pairs = linked_pairs([t for t, _ in seen.values()], side)
            a += [names[x] for x, _ in pairs]
            b += [names[y] for _, y in pairs]
        if a:
            x, y = np.array(a), np.array(b)
            keep = spanning(x, y)
            yield _table(a=(x[keep], pa.int64()), b=(y[keep], pa.int64()))


def rooted(docs: DataFrame) -> DataFrame:
    """``key, doc_id, n_shingles, root`` for every row of a written table ``key, doc_id, text``, whose keys are unique.

    Rows of a component, and only those, have the same root; it is null without shingles.
    """
    rows, common = described(docs)
    # one document stands for a class
    classes = written(
        rows.where("n > 0").groupBy("name").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits")), "shingle-sets"
    )
    grouped = groups(prefixes(docs, common))
    member = grouped.join(classes.select("name", "n", "bits"), "name").withColumn("blocks", F.ceil(F.col("members") / GROUP_ROWS))
    keys = ["gid", "i", "j"]
    possible = in_blocks(member, "gid", "blocks", "name").select(*keys, "block", "name", "n", "bits").repartition(*keys).sortWithinPartitions(*keys)
    near = written(possible.mapInArrow(_possible, "a long, b long"), "shingle-candidates")
    cluster = components(near, "candidate-clusters").select(F.col("node").alias("name"), F.col("component").alias("cluster"))
    of_class = cluster.join(classes.select("name", "key", "n"), "name")
    size = of_class.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER_TOKENS).alias("blocks"))
    placed = written(of_class.join(size, "cluster"), "shingle-clusters")
    # clustered classes grow with the documents, so neither side is ever sent to all tasks
    texts = placed.join(docs.select("key", "text").hint("merge"), "key")
    keys = ["cluster", "i", "j"]
    sent = in_blocks(texts, "cluster", "blocks", "name").select(*keys, "block", "name", "text").repartition(*keys).sortWithinPartitions(*keys)
    links = written(sent.mapInArrow(_linked, "a long, b long"), "shingle-links")
    component = components(links, "shingle-components").select(F.col("node").alias("name"), F.col("component"))
    joined = rows.select("key", "doc_id", "n", "name").join(component, "name", "left")
    root = F.when(F.col("n") > 0, F.coalesce("component", "name"))
    return joined.select("key", "doc_id", F.col("n").alias("n_shingles"), root.alias("root"))


def components_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    docs = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rooted(written(docs, "shingle-rows"))
    smallest = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(smallest, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(documents(spark, sf_dir))
