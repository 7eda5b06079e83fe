"""Token-id shards as sorted string tables.

A shard holds documents in ascending order of their identifier. Its file is: data blocks (prefix-compressed
keys and token ids, deflated), Bloom filter, sparse block index and a fixed footer. A lookup reads the
footer, asks the Bloom filter, searches the index by bisection and opens one block.

Keys are 8 bytes, big-endian, sign bit flipped, so byte order is numeric order; null ids use the empty key
and come first. Ids are little-endian unsigned 16-bit while all fit, else 32-bit.

Defined results: null and empty texts hold the end id only; repeated ids are entries of their own, in
order of their texts, and may begin in one shard and go on in the next; other columns are ignored; an empty table makes no shard and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightloom.llm._io import new_folder, written
from flightloom.llm._text import Scan, _SPACE, pieces, ranges, strings, tidy

BLOCK = 64 << 10
END_ID = 2
BLOOM_BITS = 10
BLOOM_PROBES = 7
MAGIC = b"FLSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")
#: Bytes of text that are encoded together.
PIECE = 1 << 20
#: Bytes of a shard (as it is packed) and of the texts of a task.
SHARD_BYTES, PART_BYTES = 64 << 20, 32 << 20
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = total = 0
    while True:
        byte = data[at]
        at += 1
        total |= (byte & 127) << shift
        if byte < 128:
            return total, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    """Width byte and the ids."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[:1] == b"\4" else "<u2", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    for i in range(BLOOM_PROBES):
        yield (a + i * b + i * i) % bits


class Writer:
    """Appends entries in key order to an open output stream."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last, self.entries = out, 0, bytearray(), b"", 0
        self.first: bytes | None = None
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        self.block += _varint(same) + _varint(len(key) - same) + key[same:] + _varint(len(value)) + value
        self.last = key
        self.entries += 1
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            packed = zlib.compress(bytes(self.block), 1)
            self.index.append((self.first, self.at, len(packed)))
            self._put(packed)
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            for probe in _probes(key, bits):
                bloom[probe] = 1
        bloom_at, packed = self.at, np.packbits(bloom).tobytes()
        self._put(packed)
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index))
        self._put(FOOTER.pack(bloom_at, bits, index_at, len(self.index), self.entries, 1, MAGIC))


class Reader:
    """Scans a shard in order, or looks single keys up. source: an open random-access file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - FOOTER.size)
        self.bloom_at, self.bits, index_at, blocks, self.entries, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index_at)
        data, at = source.read(size - FOOTER.size - index_at), 0
        self.index = []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QQ", data, at + n)))
            at += n + 16
        self.firsts = [k for k, _, _ in self.index]
        self._bloom: bytes | None = None

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, start, n = self.index[number]
        self.source.seek(start)
        data, at, key = zlib.decompress(self.source.read(n)), 0, b""
        while at < len(data):
            same, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            key = key[:same] + data[at : at + more]
            n, at = _read_varint(data, at + more)
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self.source.seek(self.bloom_at)
            self._bloom = self.source.read((self.bits + 7) // 8)
        return all(self._bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry with this identifier."""
        key = encode_key(doc_id)
        if not self.may_hold(key):
            return []
        found, number = [], max(0, bisect_right(self.firsts, key) - 1)
        while number > 0 and self.firsts[number] == key:
            number -= 1  # equal keys may begin in the block before
        for n in range(number, len(self.index)):
            if self.firsts[n] > key:
                break
            found += [unpack_ids(v) for k, v in self.block(n) if k == key]
        return found


class Encoder:
    """Byte-level BPE of whole texts by the tokenizers library, each distinct word encoded once.

    The pre-tokenizer never joins a character with a space after it, so a text cut before each single space
    between two other characters gives the same ids as the whole. Texts with spaces beyond ASCII or with
    what may be a special token are encoded whole. At most ``KEEP`` words are remembered.
    """

    KEEP = 2_000_000
    SLICE = 8_192

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # In a byte-level vocabulary each character of an entry stands for one byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words
        self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)  # where their ids lie
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encodes words that each begin with their space; keys are sorted and not known yet."""
        all_ids, all_sizes = [], []
        for lo in range(0, len(words), self.SLICE):  # what the library returns takes much more room than the ids
            part = words[lo : lo + self.SLICE]
            ids = self._whole([b"".join(part).decode()])[0]
            begins = np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]  # no id reaches over two words
            edges = np.cumsum([len(w) for w in part])
            all_ids.append(ids)
            all_sizes.append(np.bincount(np.searchsorted(edges, begins, "right"), minlength=len(part)))
        ids, sizes = np.concatenate(all_ids), np.concatenate(all_sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2, self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.used += len(ids)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Token ids of each text of a piece."""
        n = len(column)
        scan = Scan(column)
        data, at = scan.data, scan.offsets
        raw = data.tobytes()
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            space = _SPACE[data]
            cut[1:-2] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
            cut[:-1] &= ~(scan.fresh[:-1] | scan.fresh[1:])  # a last character has nothing after it
        whole_joined = raw.decode()
        if _WIDE_SPACE.search(whole_joined) or "<|" in whole_joined:
            for row in range(n):
                text = raw[at[row] : at[row + 1]].decode()
                if "<|" in text or _WIDE_SPACE.search(text):
                    cut[at[row] : at[row + 1]] = False
        head = np.zeros(len(data) + 1, bool)
        head[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(cut | head)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        lead = head[starts]
        heads = self._whole([raw[a:b].decode() for a, b in zip(starts[lead].tolist(), ends[lead].tolist())])
        starts_in, ends_in = starts[~lead], ends[~lead]
        keys, first, back = np.unique(scan.hashes(starts_in, ends_in), return_index=True, return_inverse=True)
        if len(self.known) > self.KEEP:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        fresh = self.known[place] != keys if len(self.known) else np.ones(len(keys), bool)
        if fresh.any():
            new = np.flatnonzero(fresh)
            new = new[np.argsort(keys[new], kind="stable")]
            self._learn(keys[new], [raw[x:y] for x, y in zip(starts_in[first[new]].tolist(), ends_in[first[new]].tolist())])
            place = np.searchsorted(self.known, keys)
        which = place[back]
        counts = np.zeros(len(starts), np.int64)
        sizes = self.size[which].astype(np.int64) if len(which) else np.zeros(0, np.int64)
        counts[~lead] = sizes
        counts[lead] = [len(h) for h in heads]
        goal = np.cumsum(counts) - counts
        parts = np.zeros(int(counts.sum()), np.uint32)
        if len(which):
            parts[ranges(goal[~lead], counts[~lead])] = self.ids[ranges(self.begin[which].astype(np.int64), sizes)]
        if heads:
            parts[ranges(goal[lead], counts[lead])] = np.concatenate(heads)
        edges = np.concatenate([[0], np.cumsum(np.bincount(scan.rows(starts), counts, n).astype(np.int64))])
        return [parts[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker; what it remembers serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(folder: str):
    if "://" not in folder:
        return pyarrow.fs.FileSystem.from_uri(folder if folder.startswith("file:") else f"file://{folder}")
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to shards and returns their manifest: part, number, path, entries, n_ids.

    Spark deals the texts out by ranges of (doc_id, beginning of the text), whose bounds it samples; a task sorts its range,
    encodes it and begins another shard whenever one has shard_bytes of ids, so long texts don't make long
    shards. A shard is written under a name of its own attempt and then moved, so a task that is run again or twice leaves whole files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, spark.sparkContext.defaultParallelism if size > 1 << 20 else 1, -(-size // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(parts, key, F.substring("text", 1, 64)).sortWithinPartitions(key, "text")

    def save(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        encoder, part, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        writer, out, name, n_ids = None, None, "", 0

        def finish():
            writer.close()
            out.close()
            path = f"shard-{part:06d}-{number:04d}.sst"
            system.move(f"{root}/{name}", f"{root}/{path}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path]), pa.array([writer.entries], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "number", "path", "entries", "n_ids"])

        for batch in batches:
            text = strings(batch.column(1))
            for lo, hi in pieces(text, PIECE):
                for doc, ids in zip(batch.column(0)[lo:hi].to_pylist(), encoder.encode(text[lo:hi])):
                    if writer is None:
                        name, n_ids = f"_part-{uuid.uuid4().hex}", 0
                        out = system.open_output_stream(f"{root}/{name}")
                        writer = Writer(out)
                    writer.add(encode_key(doc), pack_ids(np.append(ids, np.uint32(end_id))))
                    n_ids += len(ids) + 1
                    if writer.at + len(writer.block) >= shard_bytes:
                        yield finish()
                        writer, number = None, number + 1
        if writer:
            yield finish()

    done = dealt.mapInArrow(tidy(save), "part int, number int, path string, entries long, n_ids long")
    return written(done, "manifest").withColumn("folder", F.lit(folder))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; a task for each file."""
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    listed = manifest.select("folder", "path", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("start"))

    def load(batches):
        for batch in batches:
            for folder, path, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = _open(folder)
                with system.open_input_file(f"{root}/{path}") as source:
                    rows = []
                    for key, value in Reader(source).scan():
                        ids = unpack_ids(value)
                        rows.append((decode_key(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, manifest.count())).mapInArrow(tidy(load), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer or default_tokenizer()))
