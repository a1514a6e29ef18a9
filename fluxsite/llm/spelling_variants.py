"""Spelling variants: a trie of letter-group counts, searched with a budget of one each.

A word's vector counts its letters in each of ``GROUPS`` groups (code point modulo
GROUPS). One inserted letter adds one to one count, a deleted one takes one away, a
replaced one does both or neither. The words, arranged by their successive counts, are a
trie; a depth-first search descends with all the words that ask there, and each
count that differs by one spends their surplus or their deficit, of one each. Words in
the leaves that are reached are verified letter by letter.

The trie is cut into blocks of consecutive leaves. The same search over the blocks'
first and last vectors tells which blocks a word has to visit; in each it descends to
the leaves. Of two near words one finds the other, and the pair counts for both. A block
that many visit is copied, its visitors dealt out by hash.
Forms are followed to their ends by doubling.

Defined cases: NULL and empty texts hold no word; a NULL doc_id counts as empty; repeated
rows count as often as they occur; a table without words gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import send_package, text_or_empty, work_table

GROUPS = 13
BLOCK = 8192  # words of a block, more once the blocks would pass MAX_BLOCKS
MAX_BLOCKS = 1 << 16  # bounds the table of blocks that every task gets: about 7 MB
VISITS = 1 << 15  # words that meet a block in one group, about; more of them share it out
ASKED = 1 << 14  # words that descend the trie together
CANDIDATES = 1 << 18  # pairs that are verified together, about
SHORT = 32  # letters that are kept as a matrix
LEAF = 32  # words below which a node is not divided further
PAIRS = 1 << 22  # vector entries or letters that are compared at a time
HELD = 500_000  # words that a task counts before it passes the counts on
SLICE = 1 << 20  # characters of a text that are split at a time

# FIXED VALUES of the task: the words and which of their occurrences lose a letter.
RUN = re.compile("[a-zÀ-ÿ]+")  # of a text whose A-Z are in lower case
LOSES = 97
SHORTEST, FEWEST = 5, 3
TIMES = 2  # a form occurs at least so many times as often


# -- words -------------------------------------------------------------------
def runs_of(text: str) -> Iterator[list[str]]:
    """The letter runs of a text, A-Z in lower case, in slices of a bounded size."""
    text, at = text.encode().lower().decode(), 0  # bytes.lower() changes A-Z only
    while len(text) - at > SLICE:
        end = next((m.start() for m in _OTHER.finditer(text, at + SLICE)), len(text))
        yield RUN.findall(text, at, end)
        at = end
    yield RUN.findall(text, at)


_OTHER = re.compile("[^a-zÀ-ÿ]")


def word_of(run: str, hashed: int) -> str:
    """The run, without one of its letters where the hash says so."""
    if hashed % LOSES:
        return run
    at = hashed % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]):
    """(word, n) of a task, in parts."""
    counts: Counter = Counter()

    def held() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for part in runs_of(text):
                for run, n in Counter(part).items():
                    if len(run) >= SHORTEST:  # a run never gains letters
                        counts[word_of(run, zlib.crc32(run.encode(), start))] += n
                if len(counts) > HELD:
                    yield held()
    yield held()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    counts = texts.mapInArrow(_count, "word string, n long").where(F.length("word") >= SHORTEST)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


# -- vectors -----------------------------------------------------------------
class Letters:
    """Words as the bytes of their code points (all below 256)."""

    def __init__(self, words: list[str]):
        self.raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.lengths) - self.lengths

    def vectors(self) -> np.ndarray:
        of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(of * GROUPS + self.raw % GROUPS, minlength=len(self.lengths) * GROUPS).reshape(-1, GROUPS).astype(np.int32)

    def _matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(width)
        inside = at < self.lengths[rows][:, None]
        out = np.zeros((len(rows), width), np.uint8)
        out[inside] = self.raw[(self.begins[rows][:, None] + at)[inside]]
        return out

    @cached_property
    def _short(self) -> np.ndarray:
        return self._matrix(np.arange(len(self.lengths)), SHORT)

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The first letters of the rows, filled up with zeros."""
        return self._short[rows, :width] if width <= SHORT else self._matrix(rows, width)


def _near_slice(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Whether a[i] has one letter more than b[j], or replaces one, pair by pair."""
    size = b.lengths[j]
    width = int(size.max()) + 1
    x, y = a.matrix(i, width), b.matrix(j, width)
    equal = x == y
    replaced = (a.lengths[i] == size) & (np.count_nonzero(~equal, axis=1) == 1)
    # the letters before the extra one are equal, those after it equal a place later
    before = np.argmin(equal, axis=1)
    later = x[:, 1:] == y[:, :-1]
    later |= np.arange(width - 1) >= size[:, None]
    after = np.where(later.all(axis=1), width, np.argmin(later[:, ::-1], axis=1)) - (width - 1 - size)
    return replaced | (a.lengths[i] == size + 1) & (before + after >= size)


def near(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Which of the pairs a[i], b[j] differ by exactly one edit."""
    out = np.zeros(len(i), bool)
    for x, rows, y, others in ((a, i, b, j), (b, j, a, i)):
        gap = x.lengths[rows] - y.lengths[others]
        todo = np.flatnonzero((gap == 1) if x is b else (gap == 0) | (gap == 1))
        todo = todo[np.argsort(y.lengths[others[todo]], kind="stable")]
        while len(todo):  # as many of the shortest as fit, one at least
            sizes = y.lengths[others[todo]] + 1
            take = max(1, int(np.searchsorted(sizes * np.arange(1, len(todo) + 1), PAIRS, side="right")))
            now, todo = todo[:take], todo[take:]
            out[now] = _near_slice(x, rows[now], y, others[now])
    return out


# -- trie --------------------------------------------------------------------
class Trie:
    """Rows in the order of their vectors. A row may stand for all vectors from
    ``firsts`` to ``lasts``. A node is a range of rows with the same first counts."""

    def __init__(self, firsts: np.ndarray, lasts: np.ndarray):
        self.firsts, self.lasts = firsts, lasts

    def search(self, asked: np.ndarray, small: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Depth first: (places in ``asked``, begin, end) of every node that is a leaf or
        holds ``small`` rows at most, with the vectors that reach it within the budget.
        The surplus is spent first, so of two near words the one with the smaller vector
        finds the other."""
        every = np.arange(len(asked))
        # spent: 0 nothing, 1 the surplus, 2 the deficit as well
        # open: whether the first row begins before the node, the last one ends after it
        stack = [(0, len(self.firsts), 0, every, np.zeros(len(asked), np.int8), False, False)]
        while stack:
            begin, end, depth, alive, spent, open_first, open_last = stack.pop()
            if not len(alive) or begin == end:
                continue
            if end - begin <= small or depth == GROUPS:
                yield alive, begin, end
                continue
            low, high = self.firsts[begin:end, depth], self.lasts[begin:end, depth]
            if open_first:
                low = np.append(0, low[1:])
            if open_last:
                high = np.append(high[:-1], np.iinfo(np.int32).max)
            own = asked[alive, depth]
            for value in range(max(int(own.min()) - 1, int(low[0])), min(int(own.max()) + 1, int(high[-1])) + 1):
                a, b = int(np.searchsorted(high, value)), int(np.searchsorted(low, value, side="right"))
                if a >= b:
                    continue
                more, less = (own == value - 1) & (spent == 0), (own == value + 1) & (spent == 1)
                go = np.flatnonzero((own == value) | more | less)
                if len(go):
                    stack.append((
                        begin + a, begin + b, depth + 1, alive[go], spent[go] + more[go] + less[go],
                        bool(low[a] < value or a == 0 and open_first), bool(high[b - 1] > value or b == end - begin and open_last),
                    ))


def _within(asked: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose vectors are within the budget, the asked one the smaller or equal."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, PAIRS // max(1, rows.size))
    for at in range(0, len(asked), step):
        # the differences' sum is 0 or 1 and their size 2 at most: one surplus, one deficit
        gap = rows[None, :, :] - asked[at : at + step, None, :]
        size, net = np.abs(gap).sum(axis=2, dtype=np.int32), gap.sum(axis=2, dtype=np.int32)
        i, j = np.nonzero((size <= 2) & (net + size <= 2) & (net >= 0))
        found.append((i + at, j))
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


def near_pairs(asked: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words, each pair of which the search from ``asked`` has to
    find: the asked word has the smaller vector, or of equal vectors comes first."""
    letters = Letters(block)
    vectors = letters.vectors()
    order = np.lexsort(vectors.T[::-1])
    trie = Trie(vectors[order], vectors[order])
    own = Letters(asked)
    own_vectors = own.vectors()
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found, held, size = [none], [none], 0

    def verify() -> None:
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        hit = near(own, i, letters, j)
        found.append((i[hit], j[hit]))

    for at in range(0, len(asked), ASKED):
        for alive, begin, end in trie.search(own_vectors[at : at + ASKED], LEAF):
            i, j = _within(own_vectors[at + alive], trie.firsts[begin:end])
            held.append((at + alive[i], order[begin + j]))
            size += len(i)
            if size > CANDIDATES:
                verify()
                held, size = [none], 0
    verify()
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    x, y = own_vectors[i], vectors[j]
    differ = x != y
    at, rows = np.argmax(differ, axis=1), np.arange(len(i))
    first = x[rows, at] < y[rows, at]
    same = np.flatnonzero(~differ.any(axis=1))
    first[same] = np.array([asked[a] < block[b] for a, b in zip(i[same], j[same], strict=True)], bool)
    return i[first], j[first]


# -- jobs --------------------------------------------------------------------
def _key(vectors: np.ndarray) -> list[bytes]:
    """Vectors as bytes that sort as the vectors do."""
    raw, size = vectors.astype(">u4").tobytes(), 4 * GROUPS
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def _vectors_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, GROUPS).astype(np.int32)


def _keyed(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        keys = _key(Letters(batch.column("word").to_pylist()).vectors())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])


def _cut(size: int):
    """Adds ``block``: the next ``size`` rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        base, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = base + np.arange(at, at + len(batch), dtype=np.int64) // size
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "block"])

    return run


def _ends(batches: Iterator[pa.RecordBatch]):
    """(block, first, last): the keys between which a task's rows of a block lie."""
    ends: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, key in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist(), strict=True):
            own = ends.setdefault(block, [key, key])
            own[0], own[1] = min(own[0], key), max(own[1], key)
    columns = [pa.array(ends.keys(), pa.int64()), *[pa.array([e[k] for e in ends.values()], pa.binary()) for k in (0, 1)]]
    yield pa.RecordBatch.from_arrays(columns, ["block", "first", "last"])


def _visits(blocks: list[tuple[int, bytes, bytes]]):
    """(block, word, n): the blocks that can hold near words of each word, their vectors
    not smaller than its own."""
    names = np.array([b[0] for b in blocks], np.int64)
    trie = Trie(*[np.frombuffer(b"".join(b[k] for b in blocks), ">u4").reshape(-1, GROUPS).astype(np.int32) for k in (1, 2)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = [np.zeros(0, np.int64)]
            for alive, begin, end in trie.search(_vectors_of(batch.column("key")), 1):
                pairs.append((alive[:, None] * len(names) + np.arange(begin, end)).ravel())
            row, block = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(names)))
            columns = [batch.column(c).take(pa.array(row)) for c in ("word", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(names[block]), *columns], ["block", "word", "n"])

    return run


def _meet(key: tuple[pa.Scalar, ...], asked: pa.Table, block: pa.Table) -> pa.Table:
    """For both words of each near pair: how many near words it has here and the most
    frequent of them (of equal ones the first in code-point order)."""
    i, j = near_pairs(asked["word"].to_pylist(), block["word"].to_pylist())
    words_ = pa.concat_arrays([c for t in (asked, block) for c in t["word"].cast(pa.string()).chunks]).to_pylist()
    n = np.concatenate([t["n"].to_numpy() for t in (asked, block)])
    own, other = np.concatenate([i, len(asked) + j]), np.concatenate([len(asked) + j, i])
    rank = np.empty(len(words_), np.int64)
    rank[sorted(range(len(words_)), key=words_.__getitem__)] = np.arange(len(words_))
    order = np.lexsort((rank[other], -n[other], own))
    places, first, many = np.unique(own[order], return_index=True, return_counts=True)
    best = other[order][first]
    return pa.table({
        "word": pa.array([words_[k] for k in places], pa.string()), "n_near": many.astype(np.int64),
        "form": pa.array([words_[k] for k in best], pa.string()), "form_n": n[best].astype(np.int64),
    })


def near_of(vocabulary: DataFrame, block: int = BLOCK, most_visits: int = VISITS) -> DataFrame:
    """(word, n_near, form, form_n): the words (of a written table word, n) that have
    near words, the number of these and the most frequent one."""
    size = max(block, -(-vocabulary.count() // (MAX_BLOCKS // 2)))
    keyed = vocabulary.select("word", "n").mapInArrow(_keyed, "word string, n long, key binary")
    order = ["key", "word"]
    trie = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(size), "word string, n long, key binary, block long")
    trie = work_table(trie, "trie")
    ends: dict[int, tuple[bytes, bytes]] = {}
    for row in trie.select("block", "key").mapInArrow(_ends, "block long, first binary, last binary").collect():  # MAX_BLOCKS and one a task at most
        first, last = bytes(row.first), bytes(row.last)
        held = ends.get(row.block, (first, last))
        ends[row.block] = min(first, held[0]), max(last, held[1])
    blocks = sorted((name, *own) for name, own in ends.items())
    visits = work_table(trie.select("word", "n", "key").mapInArrow(_visits(blocks), "block long, word string, n long"), "trie-visits")
    crowded = visits.groupBy(F.col("block").alias("of")).agg(F.ceil(F.count(F.lit(1)) / most_visits).cast("int").alias("groups"))
    crowded = F.broadcast(work_table(crowded.where(F.col("groups") > 1), "crowded"))  # at most one row a block
    dealt = lambda rows: rows.join(crowded, F.col("block") == F.col("of"), "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    asked = dealt(visits).select("block", F.pmod(F.xxhash64("word"), "groups").cast("int").alias("salt"), "word", "n")
    copies = dealt(trie).select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), "word", "n")
    by = ["block", "salt"]
    found = asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_meet, "word string, n_near long, form string, form_n long")
    found = work_table(found, "near-words")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without circles: the end of each chain."""
    at = work_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps taken; a chain of k forms needs log2(k) rounds
        further = at.select(F.col("word").alias("of"), F.col("root").alias("further"))
        moved = at.join(further, F.col("root") == F.col("of"), "left")
        at = work_table(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, block: int = BLOCK, most_visits: int = VISITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    send_package(docs.sparkSession)
    vocabulary = work_table(words(docs), "vocabulary")
    found = near_of(vocabulary, block, most_visits).withColumnRenamed("word", "of")
    joined = vocabulary.join(found, F.col("word") == F.col("of"), "left")
    often = F.col("form_n") >= TIMES * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(often, F.col(c)).alias(c) for c in ("form", "form_n")])
    joined = work_table(joined, "forms")
    ends = roots(joined.where(F.col("form").isNotNull())).withColumnRenamed("word", "of")
    out = joined.join(ends, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
