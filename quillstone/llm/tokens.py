"""Token-ID output: sorted-string-table shards of token ids.

A shard is one file of documents in ascending key order.  Entries share key prefixes inside a block; blocks are
compressed; after them stand a sparse index (last key, offset and size of each block), a Bloom filter over the keys
and a fixed-size footer, so a lookup reads the footer, asks the filter, searches the index by bisection and decodes
one block.

Cases: a null text is an empty one (its only id is the end id); a null identifier sorts before all others; repeated
identifiers keep all their rows, in the order of their texts (and of the shards, if they go on in the next); very long
texts are encoded as a whole and are an entry, block and, if long enough, shard of their own; an empty table makes no
shard and no row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, slices, table, through_disk, work_dir

MAGIC = b"QSSTABL1"
#: index offset, index size, filter offset, filter size, entries, ids, bytes an id, magic
FOOTER = struct.Struct("<QQQQQQQ8s")
#: Bytes of ids (before compression) with which a shard is closed and the next begun.
SHARD_BYTES = 128 << 20
MANIFEST = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
BLOCK_BYTES = 64 << 10
#: New pieces that are encoded as one text; in longer texts the tokenizer takes more time for each.
TOGETHER = 500
#: A space before a character that is white space by no definition: the byte-level pre-tokenizer always cuts before it.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


class Encoder:
    """Whole texts to ids by a ``tokenizers`` file.

    Texts are cut only where the byte-level pre-tokenizer cuts anyway (before a space that stands before a
    non-space), so a piece has the ids that it has inside its text.  The ids of short pieces are remembered, of at most
    ``memo`` pieces (those used last stay), in flat arrays: a few dozen bytes a piece.  New pieces are encoded many at a
    time as one text: each begins with a token that begins with the space, which shows where its ids start.
    """

    def __init__(self, path: str, memo: int = 400_000, longest: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.longest = Tokenizer.from_file(path), memo, longest
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.pieces = pa.array([], pa.string())
        self.flat, self.ends, self.used, self.now = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Arrow cuts the texts, numbers their different pieces and finds those that are known; only new ones are encoded,
        and the ids of all pieces are then gathered at once.
        """
        plain = [i for i, t in enumerate(texts) if not _ODD.search(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else (), strict=True):
            out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            pieces = _CUT.split(texts[i])
            out[i] = b"".join(self._ids([pieces[0], *(f" {x}" for x in pieces[1:])]))
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts in which every space stands before a non-space."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        places = pc.index_in(coded.dictionary, value_set=self.pieces)
        fresh = coded.dictionary.filter(pc.is_null(places))
        found = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).copy()
        new_flat, new_sizes = self._many(fresh) if len(fresh) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        # the first piece of a text has no space before it
        firsts = self._ids([t.partition(" ")[0] for t in texts])
        flat = np.concatenate([self.flat, new_flat, np.frombuffer(b"".join(firsts), "<u4")])
        ends = np.cumsum(np.concatenate([np.diff(self.ends, prepend=0), new_sizes, np.fromiter(map(len, firsts), np.int64, len(firsts)) // 4]))
        old, n = len(self.ends), len(fresh)
        found[found < 0] = old + np.arange(n)
        at = found[coded.indices.to_numpy()]
        begin = cut.offsets.to_numpy()
        at[begin[:-1]] = old + n + np.arange(len(texts))
        # numbers of 32 bits do: a slice of texts has far fewer ids
        starts, counts = np.concatenate([[0], ends[:-1]]).astype(np.int32)[at], np.diff(ends, prepend=0).astype(np.int32)[at]
        upto = np.cumsum(counts, dtype=np.int32)
        take = np.repeat(starts - (upto - counts), counts)
        take += np.arange(upto[-1], dtype=np.int32)
        data = flat[take].tobytes()
        self._remember(found, fresh, new_flat, new_sizes)
        bounds = (np.concatenate([[0], upto])[begin].astype(np.int64) * 4).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _remember(self, found: np.ndarray, fresh: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the new pieces, and if that makes too many only the half that was used last."""
        self.now += 1
        self.used[found[found < len(self.ends)]] = self.now
        short = pc.utf8_length(fresh).to_numpy(zero_copy_only=False) <= self.longest
        if short.any():
            keep = np.repeat(short, sizes)
            self.pieces = pa.concat_arrays([self.pieces, fresh.filter(pa.array(short))])
            self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(sizes[short])])
            self.flat, self.used = np.concatenate([self.flat, flat[keep]]), np.concatenate([self.used, np.full(int(short.sum()), self.now)])
        if len(self.ends) > self.memo:
            stay = np.sort(np.argsort(self.used, kind="stable")[-(self.memo // 2) :])
            sizes = np.diff(self.ends, prepend=0)
            mask = np.zeros(len(sizes), bool)
            mask[stay] = True
            self.flat, self.ends, self.used = self.flat[np.repeat(mask, sizes)], np.cumsum(sizes[stay]), self.used[stay]
            self.pieces = self.pieces.take(pa.array(stay))

    def _many(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without a space in them, each as after a space, one after the other, and how many each has."""
        flat, sizes = [], []
        bounds = [*range(0, len(pieces), TOGETHER), len(pieces)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), " ").to_pylist()
        for a, b, text in zip(bounds, bounds[1:], texts, strict=False):
            ids = np.asarray(self.tokenizer.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != b - a or starts[0] != 0:
                each = self._ids([f" {x}" for x in pieces.slice(a, b - a).to_pylist()])
                ids, starts = np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *(len(x) // 4 for x in each)])[:-1]
            flat.append(ids)
            sizes.append(np.diff(starts, append=len(ids)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1000):
            got = self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)
            out += [np.asarray(e.ids, dtype="<u4").tobytes() for e in got]
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: its memory serves all tasks that the worker runs."""
    return Encoder(path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """Sorts as bytes like the identifiers as numbers, null first; ``repeat`` counts rows of one identifier."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">QI", doc_id + (1 << 63), repeat)


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack_from(">Q", key, 1)[0] - (1 << 63)


class Bloom:
    """Ten bits a key and seven probes: about one false answer in a hundred."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _probes(key: bytes, size: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key[:9])
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        return [(a + i * b) % (1 << 64) % size for i in range(7)]

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        bits = np.zeros(max(64, 10 * len(keys)) // 8 + 1, dtype=np.uint8)
        for key in keys:
            for p in cls._probes(key, len(bits) * 8):
                bits[p >> 3] |= 1 << (p & 7)
        return cls(bits)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._probes(key, len(self.bits) * 8))


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, width: int, level: int = 1):
        self.sink, self.width, self.at = sink, width, 0
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.last, self.ids = [], 0, b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: as Encoder gives them."""
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        value = np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes()
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        self.block += [_varint(same), _varint(len(key) - same), _varint(len(value)), key[same:], value]
        self.size += len(value) + len(key)
        self.keys.append(key)
        self.last, self.ids = key, self.ids + len(ids) // 4
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QQ", self.at, len(data)))
            self.put(data)
            self.block, self.size, self.last = [], 0, b""

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> int:
        self.flush()
        index, bloom, at = b"".join(self.index), Bloom.of(self.keys).bits.tobytes(), self.at
        self.put(index)
        self.put(bloom)
        self.put(FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.ids, self.width, MAGIC))
        self.sink.close()
        return self.at


class Reader:
    """Reads a shard from a random-access file: all entries in order, or one identifier's."""

    def __init__(self, source):
        self.source, size = source, source.size()
        f = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.entries, self.ids, self.width = f[4:7]
        self.bloom = Bloom(np.frombuffer(self.read(f[2], f[3]), np.uint8))
        self.last, self.blocks = [], []
        data, at = self.read(f[0], f[1]), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", data, at + n))
            at += n + 16

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def entries_of(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zstandard.decompress(self.read(*self.blocks[block])), 0, b""
        while at < len(data):
            same, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:same] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries_of(block)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier."""
        key, found = key_of(doc_id), []
        if not self.bloom.may_hold(key):
            return found
        for block in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            for k, ids in self.entries_of(block):
                if k[:9] == key[:9]:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, at: str | None = None, most: int = SHARD_BYTES) -> DataFrame:
    """Writes doc_id and text as shards under ``at`` in the shared folder; gives the manifest, one row a shard.

    Range partitioning on doc_id makes the shards of task k+1 start after those of task k; texts cross the network once,
    then each task tokenizes in key order and begins a new shard (part) when one has ``most`` bytes of ids, so a shard's
    index, keys and Bloom filter stay small however large a partition is.  A file's name is new in each attempt and only
    the manifest of committed tasks names it, so a retried task leaves no wrong shard.
    """
    spark = docs.sparkSession
    at = at or work_dir(spark, "sstable")
    target, root = filesystem(at)
    target.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, path, part = encoder_of(tokenizer), None, "", 0
        end, prior, repeat, first = np.uint32(end_id).tobytes(), object(), 0, None

        def closed() -> pa.RecordBatch:
            writer.close()
            row = {"shard": TaskContext.get().partitionId(), "part": part, "path": path, "first_id": first, "n_docs": len(writer.keys), "n_ids": writer.ids}
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST)

        for whole in batches:
            for batch in slices(whole, 4 << 20):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    if writer is None:
                        path, first = f"{at}/shard-{TaskContext.get().partitionId():06d}-{part:06d}-{uuid.uuid4().hex}.sst", doc_id
                        system, inner = filesystem(path)
                        writer = Writer(system.open_output_stream(inner, compression=None), encoder.width)
                    repeat = repeat + 1 if doc_id == prior else 0
                    key = key_of(doc_id, repeat) if doc_id is not None else b"\0" + struct.pack(">I", repeat)
                    writer.add(key, ids + end)
                    prior = doc_id
                    if writer.ids * encoder.width >= most:
                        yield closed()
                        writer, part = None, part + 1
                pa.default_memory_pool().release_unused()
        if writer is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return through_disk(rows.mapInArrow(write, "shard int, part int, path string, first_id long, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry, read back from the files.

    The only thing that the driver sees is one small row a shard (for the running sum of ids).
    """
    spark, base, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: (r.shard, r.part)):
        rows.append((len(rows), r.path, base))
        base += r.n_ids
    files = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = filesystem(row["path"])
                start, out = row["base"], []
                for key, ids in Reader(system.open_input_file(inner)):
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _columns(out)
                        out = []
                if out:
                    yield _columns(out)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))
