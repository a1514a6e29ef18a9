"""Token ids as files: interleaved range asymmetric numeral systems, static tables.

One frequency table, counted over all ids, is shared by all blocks. The ids of all
documents, in ascending order of doc_id, are cut into blocks that know nothing of
each other. A block is a matrix of ids: each column (lane) is coded by its own state,
and the lanes' 32-bit words lie interleaved in the order in which decoding needs
them. Every ``SPAN`` rows a checkpoint keeps the lanes' states and the place in the
words, so the spans of a block decode side by side, and a piece of a document
costs only its own spans. Checksums cover the coded bytes and the ids.

Files: ``table`` (the frequencies) and ``blocks`` (one row a block: its place, its
bytes, and the pieces of documents in it), both Parquet, which every store takes and
which Spark commits whole. Bytes of a block: magic, counts, checksums (``HEADER``),
the words' place at each checkpoint (u32), the states there (u64), the words (u32).

Defined cases: a NULL or empty text is its end mark alone; rows that repeat a doc_id
follow each other, rows without one come first; a table without rows gives files
without blocks and an empty result; other columns are ignored. Damaged bytes raise.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import send_package, text_or_empty, work_table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BITS = 20  # frequencies add up to 2**BITS; a vocabulary may hold as many ids
LANES = 1024
SPAN = 256  # rows of a block from one checkpoint to the next
BLOCK = 1 << 20  # ids of a block
LOW = 1 << 31  # states lie in [LOW, LOW << 32)
MAGIC = b"rANS"
HEADER = struct.Struct("<4sIIIIIIII")  # magic, ids, lanes, rows of a span, spans, words, CRC-32 of table, of ids, of the rest

CACHED = 1_000_000  # segments whose ids a worker keeps at most
SLICE = 1 << 22  # characters that are split at a time


# -- tokens ------------------------------------------------------------------
class Tokens:
    """Ids of texts. No token reaches across a space that follows other than white
    space, so texts are split there, and the ids of each segment are kept. New segments
    are encoded in one string, which the lengths of its tokens take apart again."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.sizes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)  # a character of a byte-level token is a byte
        self.later: dict[str, bytes] = {}  # segments without the space before them

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, f"<u{self.width}").tobytes() for ids in self._ids(texts)]

    def _encode_joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that begin with a space or a line break, alone, and don't end
        in white space: their tokens are the same when one follows the other."""
        if not texts:
            return []
        ids = np.array(self._ids(["".join(texts)])[0], np.int64)
        reached = np.append(0, np.cumsum(self.sizes[ids]))
        ends = np.cumsum([len(t.encode()) for t in texts])
        cuts = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[cuts] != ends).any():  # not a byte-level vocabulary
            return self._encode(texts)
        raw, w, cuts = ids.astype(f"<u{self.width}").tobytes(), self.width, cuts.tolist()
        return [raw[w * a : w * b] for a, b in zip([0, *cuts], cuts)]

    def _firsts(self, new: list[str]) -> list[bytes]:
        """The ids of the first segments of texts. A line break before one that begins
        with other than white space is a token of its own."""
        joined = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        ids = {s: own[self.width :] for s, own in zip(joined, self._encode_joined(["\n" + s for s in joined]), strict=True)}
        alone = list(set(new) - ids.keys())
        ids.update(zip(alone, self._encode(alone), strict=True))
        return [ids[s] for s in new]

    def _others(self, new: list[str]) -> list[bytes]:
        """The ids of segments that begin with a space."""
        alone = [k for k, s in enumerate(new) if s[-1].isspace()]
        if not alone:
            return self._encode_joined(new)
        out = [b""] * len(new)
        joined = [k for k, s in enumerate(new) if not s[-1].isspace()]
        for some, encode in ((alone, self._encode), (joined, self._encode_joined)):
            for k, ids in zip(some, encode([new[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, little-endian."""
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._flush(held)
                held, size = [], 0
                yield b"".join(b"".join(self._flush([part])) for part in slices(text))
                continue
            held.append(text)
            size += len(text)
            if size > SLICE:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts: each different segment is looked up once, and the ids
        of all segments are gathered in Arrow."""
        if not texts or any(_MARK in t for t in texts):  # a text holds the mark itself
            return self._encode(texts)
        split = pc.split_pattern(pa.array([marked(t) for t in texts], pa.large_string()), _MARK)
        bounds = split.offsets.to_numpy()
        firsts = self._firsts(split.values.take(pa.array(bounds[:-1])).to_pylist())
        coded = split.values.dictionary_encode()
        own, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.later.get, own))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        ids = self._others([" " + own[k] for k in gaps])
        for k, new in zip(gaps, ids, strict=True):
            found[k] = new
        uses = np.bincount(places, minlength=len(own))
        if uses[gaps].sum() > len(places) / 2:  # other texts than before
            self.later.clear()
        if len(self.later) + len(gaps) <= CACHED:  # what is kept when it is full is most of what comes
            self.later.update(zip([own[k] for k in gaps], ids, strict=True))
        rows = pa.array(found, pa.large_binary()).take(coded.indices)
        at, raw = np.frombuffer(rows.buffers()[1], np.int64), memoryview(rows.buffers()[2] or b"")
        return [first + raw[x:y] for first, x, y in zip(firsts, at[bounds[:-1] + 1].tolist(), at[bounds[1:]].tolist(), strict=True)]


# A text is cut at a space that follows other than white space, which is left out;
# a run of white space is never cut.
_BREAK = re.compile(r"(?<=[^\s\x1c-\x1f]) ")
_MARK = "\0"
_RUN = re.compile(r"[\s\x1c-\x1f] ")

def marked(text: str) -> str:
    """The text with a mark in place of each space that follows other than white space.
    All segments between marks but the first begin with such a space, which is left out."""
    return _BREAK.sub(_MARK, text) if text.startswith(" ") or _RUN.search(text) else text.replace(" ", _MARK)


def slices(text: str) -> Iterator[str]:
    """A long text cut between segments, some ``SLICE`` characters at a time."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]  # the next slice begins with the space
        at = end


_TOKENS: dict[str, Tokens] = {}


def tokens_of(vocabulary: str) -> Tokens:
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = Tokens(vocabulary)
    return _TOKENS[vocabulary]


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        tokens, part, at = tokens_of(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{tokens.width}").tobytes()
        for batch in batches:
            ids = pa.array([x + end for x in tokens.encode(batch.column("text").to_pylist())], pa.large_binary())
            rows = np.arange(at, at + len(batch), dtype=np.int64)
            at += len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(batch), part, np.int64)), pa.array(rows), pa.array(np.full(len(batch), tokens.width, np.int32)), ids.cast(pa.binary())],
                ["doc_id", "part", "at", "width", "ids"],
            )

    return run


def _count(batches: Iterator[pa.RecordBatch]):
    """(id, n) of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        if len(batch):  # ids of one vocabulary have one width
            width, raw = batch.column("width")[0].as_py(), b"".join(batch.column("ids").to_pylist())
            n = np.bincount(np.frombuffer(raw, f"<u{width}"), minlength=len(total))
            n[: len(total)] += total
            total = n
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["id", "n"])


# -- the code ----------------------------------------------------------------
class Table:
    """Frequencies of the ids, their sums before each, and the id of each slot."""

    def __init__(self, frequencies: np.ndarray, bits: int):
        self.bits = bits
        self.frequencies = frequencies.astype(np.uint64)
        self.starts = np.cumsum(self.frequencies) - self.frequencies
        self.crc = zlib.crc32(self.raw())

    def raw(self) -> bytes:
        return self.frequencies.astype("<u4").tobytes()

    @property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequencies), dtype=np.uint32), self.frequencies.astype(np.int64))

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray, bits: int = BITS) -> Table:
        """Counts scaled to 2**bits; each id that occurs keeps one slot at least."""
        if len(ids) > 1 << bits:
            raise ValueError(f"{len(ids)} different ids need more than {bits} bits")
        if not len(ids):
            return Table(np.zeros(0, np.uint32), bits)
        free = (1 << bits) - len(ids)
        share = 1 + np.array([int(c) * free // int(counts.sum()) for c in counts], np.int64)
        largest = np.lexsort((ids, -counts))[: (1 << bits) - int(share.sum())]
        share[largest] += 1  # what rounding down left over, fewer than the ids
        frequencies = np.zeros(int(ids.max()) + 1, np.int64)
        frequencies[ids] = share
        return Table(frequencies, bits)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, span: int = SPAN) -> bytes:
    """The bytes of a block; short blocks use fewer lanes."""
    lanes = max(1, min(lanes, len(ids) // 64))
    rows = -(-len(ids) // lanes)
    bits, high = np.uint64(table.bits), np.uint64(63 - table.bits)
    states = np.full(lanes, LOW, np.uint64)
    words, marks, sizes = [], [], np.zeros(rows, np.int64)
    for row in range(rows - 1, -1, -1):  # the decoder's order backwards
        now = ids[row * lanes : (row + 1) * lanes]
        x, f = states[: len(now)], table.frequencies[now]
        full = x >= f << high
        out = x[full]
        words.append(out.astype(np.uint32))  # the lower 32 bits
        sizes[row] = len(out)
        x[full] = out >> np.uint64(32)
        whole = x // f
        states[: len(now)] = (whole << bits) + (x - whole * f) + table.starts[now]
        if row % span == 0:
            marks.append(states.copy())
    place = (np.cumsum(sizes) - sizes)[::span].astype("<u4")
    body = b"".join([place.tobytes(), np.array(marks[::-1], "<u8").tobytes(), *[w.astype("<u4").tobytes() for w in reversed(words)]])
    own = zlib.crc32(ids.astype("<u4").tobytes())
    return HEADER.pack(MAGIC, len(ids), lanes, span, len(place), int(sizes.sum()), table.crc, own, zlib.crc32(body)) + body


def decode_block(raw: bytes, table: Table, slots: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block; only the spans that hold them are decoded,
    all at once. A whole block is checked against the checksum of its ids."""
    magic, n, lanes, span, spans, size, of, own, check = HEADER.unpack_from(raw)
    if magic != MAGIC or of != table.crc or zlib.crc32(memoryview(raw)[HEADER.size :]) != check:
        raise ValueError("damaged block, or the table of another file")
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = begin // (lanes * span), -(-end // (lanes * span))
    place = np.frombuffer(raw, "<u4", spans, HEADER.size)[a:b].astype(np.int64)
    states = np.frombuffer(raw, "<u8", spans * lanes, HEADER.size + 4 * spans).reshape(spans, lanes)[a:b].astype(np.uint64)
    words = np.frombuffer(raw, "<u4", size, HEADER.size + 4 * spans + 8 * spans * lanes).astype(np.uint64)
    bits, mask, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(LOW)
    full, rest = divmod(n, lanes)
    rows = np.clip(full - span * np.arange(a, b), 0, span)  # whole rows of each span; the last may have fewer
    out = np.zeros((b - a, span, lanes), np.uint32)

    def step(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot = x & mask
        ids = slots[slot]
        x = table.frequencies[ids] * (x >> bits) + slot - table.starts[ids]
        short = x < low
        taken = np.count_nonzero(short, axis=1)
        hit, flat = np.flatnonzero(short), x.reshape(-1)
        flat[hit] = (flat[hit] << np.uint64(32)) | words[np.arange(len(hit)) + np.repeat(at - (np.cumsum(taken) - taken), taken)]
        return ids, x, at + taken

    for row in range(int(rows.max())):
        k = int((rows > row).sum())
        out[:k, row], states[:k], place[:k] = step(states[:k], place[:k])
    if rest and b == spans:  # the last row of a block may be short
        out[-1, rows[-1], :rest] = step(states[-1:, :rest], place[-1:])[0][0]
    ids = out.reshape(-1)[begin - a * span * lanes : end - a * span * lanes]
    if end - begin == n and zlib.crc32(ids.astype("<u4").tobytes()) != own:
        raise ValueError("damaged ids of a block")
    return ids


def _blocks(table: Table, key: pa.DataType, size: int, lanes: int, span: int):
    piece = pa.struct([("doc_id", key), ("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, block, first, doc = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        fill = 0

        def close() -> pa.RecordBatch:
            raw = encode_block(np.concatenate(held), table, lanes, span)
            values = [part, block, first, fill]
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int64()) for v in values], pa.array([raw], pa.binary()), pa.array([pieces], pa.list_(piece))],
                ["part", "block", "first", "n", "bytes", "pieces"],
            )

        for batch in batches:
            for doc_id, width, raw in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "width", "ids")], strict=True):
                ids, at = np.frombuffer(raw, f"<u{width}"), 0
                while at < len(ids):
                    take = min(len(ids) - at, size - fill)
                    held.append(ids[at : at + take])
                    pieces.append({"doc_id": doc_id, "doc": doc, "start": at, "length": take, "n_tokens": len(ids)})
                    fill, at = fill + take, at + take
                    if fill == size:
                        yield close()
                        block, first, fill, held, pieces = block + 1, first + fill, 0, [], []
                doc += 1
        if fill:
            yield close()

    return run


def write_ids(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK, lanes: int = LANES, span: int = SPAN, bits: int = BITS
) -> None:
    """Write the ids of all texts, each with its end mark, in ascending order of doc_id."""
    spark = docs.sparkSession
    send_package(spark)
    key = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    tokens = work_table(texts.mapInArrow(_tokenise(vocabulary, end_id), f"doc_id {key.simpleString()}, part long, at long, width int, ids binary"), "token-ids")
    # at most one row per id of the vocabulary
    counts = tokens.select("width", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    table = Table.of(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), bits)
    spark.createDataFrame([(table.bits, bytearray(table.raw()), table.crc)], "bits int, frequencies binary, crc32 long").coalesce(1).write.parquet(f"{path}/table")
    order = ["doc_id", "part", "at"]
    rows = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    piece = f"struct<doc_id:{key.simpleString()},doc:bigint,start:bigint,length:bigint,n_tokens:bigint>"
    rows.mapInArrow(
        _blocks(table, to_arrow_type(key), block, lanes, span), f"part long, block long, first long, n long, bytes binary, pieces array<{piece}>"
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")


# -- reading -----------------------------------------------------------------
def read_table(spark: SparkSession, path: str) -> Table:
    row = spark.read.parquet(f"{path}/table").first()
    table = Table(np.frombuffer(bytes(row.frequencies), "<u4"), row.bits)
    if table.crc != row.crc32:
        raise ValueError("damaged frequency table")
    return table


@lru_cache(maxsize=1)
def _slots(raw: bytes, bits: int) -> np.ndarray:
    return Table(np.frombuffer(raw, "<u4"), bits).slots


def _piece_schema(key: str, digest: bool) -> str:
    return f"doc_id {key}, part long, doc long, first long, start long, length long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}"


def _read(table: Table, key: pa.DataType, digest: bool):
    """The pieces of each block: their ids, or the CRC-32 of them."""
    raw, bits = table.raw(), table.bits
    kinds = [key, *[pa.int64()] * 6, pa.int64() if digest else pa.binary()]
    names = ["doc_id", "part", "doc", "first", "start", "length", "n_tokens", "ids_crc32" if digest else "ids"]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, first, data, pieces in zip(*batch.columns, strict=True):
                ids = decode_block(data.as_py(), table, _slots(raw, bits)).astype("<u4").tobytes()
                at, rows = 0, []
                for p in pieces.as_py():
                    own = ids[4 * at : 4 * (at + p["length"])]
                    rows.append((p["doc_id"], part.as_py(), p["doc"], first.as_py() + at - p["start"], p["start"], p["length"], p["n_tokens"], zlib.crc32(own) if digest else own))
                    at += p["length"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_pieces(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The pieces of all documents as the files hold them, with their ids or the CRC-32
    of these. ``doc`` numbers the rows of a part, ``first`` the ids of the part before
    the document, ``start`` those of the document before the piece."""
    send_package(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType
    found = _read(read_table(spark, path), to_arrow_type(key), digest)
    return blocks.select("part", "first", "bytes", "pieces").mapInArrow(found, _piece_schema(key.simpleString(), digest))


# CRC-32 as a polynomial over GF(2); zlib keeps its bits in reverse.
_POLY = 0x104C11DB7


def _reverse(crc: int) -> int:
    return int(f"{crc:032b}"[::-1], 2)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the checksum."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
        if a >> 32:
            a ^= _POLY
    return out


def crc32_joined(first: int, then: int, n: int) -> int:
    """CRC-32 of two byte strings after each other, the second of n bytes."""
    shift, power, left = 1, 2, 8 * n  # x ** (8 * n)
    while left:
        if left & 1:
            shift = _times(shift, power)
        power, left = _times(power, power), left >> 1
    return _reverse(_times(_reverse(first), shift)) ^ then


def _join_pieces(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    pieces = pieces.sort_by("start")
    crc = 0
    for own, n in zip(pieces["ids_crc32"].to_pylist(), pieces["length"].to_pylist(), strict=True):
        crc = crc32_joined(crc, own, 4 * n)
    return pieces.slice(0, 1).select(["doc_id", "part", "first", "n_tokens"]).append_column("ids_crc32", pa.array([crc], pa.int64()))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task that wrote blocks; written, so Spark broadcasts it by its known size
    places = work_table(totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("place")), "token-places")
    pieces = work_table(read_pieces(spark, path, digest=True), "token-pieces")
    key = pieces.schema["doc_id"].dataType.simpleString()
    whole = F.col("length") == F.col("n_tokens")
    joined = pieces.where(~whole).groupBy("part", "doc").applyInArrow(_join_pieces, f"doc_id {key}, part long, first long, n_tokens long, ids_crc32 long")
    found = pieces.where(whole).select("doc_id", "part", "first", "n_tokens", "ids_crc32").unionByName(joined)
    return found.join(places, F.col("part") == F.col("of")).select("doc_id", (F.col("place") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
