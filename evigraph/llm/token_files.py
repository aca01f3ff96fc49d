"""Token ids in files: byte-level BPE by the tokenizers library, range asymmetric numerals, checkpoints, checksums.

Documents are dealt by ranges of their keys and written in key order. A file holds up to FILE_IDS
ids: a table of frequencies counted over all of these and shared by the file's blocks, the blocks,
and a directory of blocks and documents. Any block can be decoded by itself, and within a block
decoding can begin at every checkpoint, so files are read by as many tasks as there are groups of
blocks.

File: MAGIC; table; blocks; directory; then the directory's place, length and CRC-32 and MAGIC
again. Table, directory and every block carry a CRC-32 of their bytes. Numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import bytescan, rans, spans
from evigraph.llm.resampling import shift
from evigraph.llm.shared import Scratch, trim

MAGIC = b"EVTOKEN1"
#: Ids of a file; blocks that one task decodes at once.
FILE_IDS, GROUP_BLOCKS = 32 * rans.BLOCK_IDS, 8
#: Documents of one range: USUAL_ROWS while there are at most MANY_RANGES of these, then up to MOST_ROWS.
USUAL_ROWS, MANY_RANGES, MOST_ROWS = 4000, 4096, 200_000
#: Stretches of text whose ids a worker keeps, and their ids; beyond either the store starts anew.
KEPT, KEPT_IDS = 2_000_000, 24_000_000
_END = struct.Struct("<QII")

# classes of bytes for the places where a text may be cut without changing its tokens
_LETTER, _DIGIT, _SIGN, _QUOTE, _BLANK, _LINE = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _QUOTE if chr(_b) == "'" else _SIGN
_CLASS[32], _CLASS[10] = _BLANK, _LINE


def cuts_of(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a cut changes no match of the byte-level pattern.

    Its matches are runs of letters, of digits or of other signs with one space before them,
    contractions, and white space. So there is a cut between ASCII or Latin-1 letters, digits and
    signs (but not after an apostrophe), before a single space or line end between such
    characters, and after such a line end. Everything else stays together.
    """
    kind = _CLASS[data]
    pair = np.flatnonzero(data[:-1] == 0xC3)
    pair = pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)]
    kind[pair] = kind[pair + 1] = _LETTER
    solid = (kind >= _LETTER) & (kind <= _QUOTE)
    out = np.zeros(len(data), bool)
    a, b = kind[:-1], kind[1:]
    out[1:] = (a != b) & solid[:-1] & solid[1:] & (a != _QUOTE) & ~((a == _SIGN) & (b == _QUOTE))
    if len(data) > 2:
        alone = solid[:-2] & (kind[1:-1] > _QUOTE) & solid[2:]
        out[1:-1] |= alone
        out[2:] |= alone & (kind[1:-1] == _LINE)
    return np.flatnonzero(out)


class _Store:
    """An open table from 64-bit hashes to numbers, probed many at a time."""

    def __init__(self):
        self.n, self.keys, self.values = 0, np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.intp)
        out = self.values.take(slot)
        todo = np.flatnonzero((out >= 0) & (self.keys.take(slot) != hashes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            out[todo] = self.values.take(slot[todo])
            todo = todo[(out[todo] >= 0) & (self.keys.take(slot[todo]) != hashes[todo])]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new distinct hashes on."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            held = self.values >= 0
            keys, values = self.keys[held], self.values[held]
            size = 1 << int(4 * (self.n + len(hashes))).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(keys, values)
        self._put(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.intp)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.values[slot[todo]] < 0]
            self.values[slot[free]] = values[free]  # of those that want one place the last gets it
            self.keys[slot[free]] = keys[free]
            todo = todo[self.values[slot[todo]] != values[todo]]
            slot[todo] = (slot[todo] + 1) & mask


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; each stretch between cuts is encoded once."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        held = json.loads(tokenizer)
        before = held.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and held["model"]["type"] == "BPE" and not held["model"].get("dropout")
        #: Whether texts may be cut: only for the pattern and model that the cuts are made for.
        self.cut = bool(plain and not held.get("normalizer") and not held.get("post_processor") and not held.get("truncation") and not held.get("padding"))
        self.added = [t["content"].encode() for t in held.get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.store, self.ids, self.ends, self.n_ids = _Store(), np.empty(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = self._whole(texts)
        lens = np.array([len(x) for x in found], np.int64)
        n = int(lens.sum())
        if self.n_ids + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(self.n_ids + 2 * n, np.uint32)])
        self.ids[self.n_ids : self.n_ids + n] = np.array([i for x in found for i in x], np.uint32)
        self.ends = np.concatenate([self.ends, self.n_ids + np.cumsum(lens)])
        self.n_ids += n
        self.store.add(hashes)

    def _stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each stretch)."""
        hashes = spans.hashes(data, starts, ends)
        number = self.store.find(hashes)
        if (number < 0).any():
            if self.store.n > KEPT or self.n_ids > KEPT_IDS:
                self.forget()
                number[:] = -1
            new, first = np.unique(hashes[number < 0], return_index=True)
            at = np.flatnonzero(number < 0)[first]
            raw = data.tobytes()
            self._learn(new, [raw[a:z].decode() for a, z in zip(starts[at], ends[at])])
            number = self.store.find(hashes)
        lens = (self.ends[1:] - self.ends[:-1]).take(number)
        begin = self.ends.take(number)
        before = np.cumsum(lens) - lens
        return self.ids.take(np.repeat(begin - before, lens) + np.arange(int(lens.sum()))), lens

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids of each row) for runs of rows of a string column; null is the empty text."""
        data, offsets = bytescan.buffers(column)
        for lo, hi in bytescan.runs(offsets, spans.SLICE_BYTES):
            begin, end = int(offsets[lo]), int(offsets[hi])
            part = data[begin:end]
            raw = part.tobytes() if self.added or not self.cut else b""
            if not self.cut or any(t in raw for t in self.added):
                found = self._whole([raw[a:z].decode() for a, z in zip(offsets[lo:hi] - begin, offsets[lo + 1 : hi + 1] - begin)])
                yield lo, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
                continue
            ids, n = [], np.zeros(hi - lo, np.int64)
            for a, z in self._pieces(part):
                mark = np.zeros(z - a + 1, bool)
                mark[cuts_of(part[a:z])] = True
                mark[np.clip(offsets[lo:hi] - begin - a, 0, z - a)] = True
                starts = np.flatnonzero(mark[:-1])  # an empty text has no stretch
                if len(starts):
                    found, lens = self._stretches(part[a:z], starts, np.append(starts[1:], z - a))
                    ids.append(found)
                    owner = np.searchsorted(offsets[lo : hi + 1] - begin - a, starts, "right") - 1
                    n += np.bincount(owner, lens, minlength=hi - lo).astype(np.int64)
            yield lo, np.concatenate(ids) if ids else np.empty(0, np.uint32), n

    @staticmethod
    def _pieces(part: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of SLICE_BYTES or so, ended at a cut; a text without cuts is one part."""
        begin, reach = 0, 2 * spans.SLICE_BYTES
        while len(part) - begin > reach:
            found = cuts_of(part[begin : begin + reach])
            found = found[(found > 0) & (found < reach - 4)]
            if len(found):
                yield begin, begin + int(found[-1])
                begin, reach = begin + int(found[-1]), 2 * spans.SLICE_BYTES
            else:
                reach *= 2
        yield begin, len(part)


@lru_cache(1)
def _encoder(tokenizer: str) -> Encoder:
    """A worker's encoder; it outlives a task, so that the next one finds its stretches."""
    return Encoder(tokenizer)


class Piece(NamedTuple):
    """A document's ids in one file: where they begin in the file, the document's length, where they begin in it, its key as text."""

    begin: int
    total: int
    offset: int
    key: str | None


def _pack_pieces(pieces: list[Piece]) -> bytes:
    keys = [None if p.key is None else p.key.encode() for p in pieces]
    numbers = np.array([(p.begin, p.total, p.offset, -1 if k is None else len(k)) for p, k in zip(pieces, keys)], "<i8").reshape(-1, 4)
    return zlib.compress(struct.pack("<Q", len(pieces)) + numbers.T.tobytes() + b"".join(k or b"" for k in keys))


def _unpack_pieces(data: bytes) -> list[Piece]:
    raw = zlib.decompress(data)
    n = struct.unpack_from("<Q", raw)[0]
    numbers = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
    out, at = [], 8 + 32 * n
    for begin, total, offset, size in numbers.T.tolist():
        out.append(Piece(begin, total, offset, None if size < 0 else raw[at : at + size].decode()))
        at += max(0, size)
    return out


def write_file(root: str, ids: np.ndarray, pieces: list[Piece]) -> str:
    """Write a file of its own name under root; returns its URI."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    freq = rans.normalise(counts)
    system, path = arrow_fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.tokens"
    parts, at = [MAGIC], len(MAGIC)

    def put(data: bytes) -> tuple[int, int, int]:
        nonlocal at
        parts.append(data)
        at += len(data)
        return at - len(data), len(data), zlib.crc32(data)

    steps = np.diff(used, prepend=0).astype("<u4")
    table = put(zlib.compress(np.stack([steps, freq[used].astype("<u4")]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()))
    blocks = []
    for b in rans.encode(ids, rans.table(freq)):
        words = b.words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        states = b.states.astype("<i8").view(np.uint8).reshape(*b.states.shape, 8)[..., :6].tobytes()
        blocks.append([*put(words + states + b.places.astype("<i8").tobytes()), b.n_ids, len(b.words)])
    told = {"version": 1, "bits": rans.BITS, "lanes": rans.LANES, "segment_steps": rans.SEGMENT_STEPS, "n_ids": len(ids), "table": [*table, len(used)], "blocks": blocks, "documents": list(put(_pack_pieces(pieces)))}
    parts.append(zlib.compress(json.dumps(told).encode()))
    parts.append(_END.pack(at, len(parts[-1]), zlib.crc32(parts[-1])) + MAGIC)
    with system.open_output_stream(f"{path}/{name}", compression=None) as f:
        for p in parts:
            f.write(p)
    return f"{root}/{name}"


class TokenFile:
    """A file's directory, read from its end; damage anywhere is a ValueError that names the file."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = arrow_fs.FileSystem.from_uri(uri)
        self.handle = system.open_input_file(path)
        size = self.handle.size()
        tail = self._bytes(size - _END.size - len(MAGIC), _END.size + len(MAGIC)) if size > _END.size + 2 * len(MAGIC) else b""
        if tail[_END.size :] != MAGIC:
            raise ValueError(f"{uri}: not a whole token file")
        self.told = json.loads(zlib.decompress(self._checked(*_END.unpack(tail[: _END.size]))))
        if (self.told["version"], self.told["bits"], self.told["lanes"], self.told["segment_steps"]) != (1, rans.BITS, rans.LANES, rans.SEGMENT_STEPS):
            raise ValueError(f"{uri}: written in another form")
        self._table: rans.Table | None = None

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()

    def _bytes(self, at: int, size: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(size)

    def _checked(self, at: int, size: int, crc: int) -> bytes:
        data = self._bytes(at, size)
        if len(data) != size or zlib.crc32(data) != crc:
            raise ValueError(f"{self.uri}: damaged at {at}")
        return data

    @property
    def table(self) -> rans.Table:
        if self._table is None:
            at, size, crc, n = self.told["table"]
            planes = np.frombuffer(zlib.decompress(self._checked(at, size, crc)), np.uint8).reshape(2, 4, n).transpose(0, 2, 1)
            steps, freq = np.ascontiguousarray(planes).view("<u4").reshape(2, n).astype(np.int64)
            used = np.cumsum(steps)
            whole = np.zeros(int(used[-1]) + 1 if n else 0, np.int64)
            whole[used] = freq
            self._table = rans.table(whole)
        return self._table

    def pieces(self) -> list[Piece]:
        return _unpack_pieces(self._checked(*self.told["documents"]))

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks first to end."""
        found = []
        for at, size, crc, n_ids, n_words in self.told["blocks"][first:end]:
            data = np.frombuffer(self._checked(at, size, crc), np.uint8)
            words = np.zeros((n_words, 4), np.uint8)
            words[:, :3] = data[: 3 * n_words].reshape(-1, 3)
            points = -(-n_ids // (rans.LANES * rans.SEGMENT_STEPS))
            states = np.zeros((points * rans.LANES, 8), np.uint8)
            states[:, :6] = data[3 * n_words : 3 * n_words + 6 * len(states)].reshape(-1, 6)
            places = np.frombuffer(data[3 * n_words + 6 * len(states) :].tobytes(), "<i8")
            found.append(rans.Block(n_ids, words.view("<u4").reshape(-1), states.view("<i8").reshape(points, rans.LANES), places))
        try:
            return rans.decode(found, self.table)
        except ValueError as error:
            raise ValueError(f"{self.uri}: {error}") from error


def _write_range(tokenizer: str, end_id: int, root: str):
    """(key text, text) in order to one row a file: its number in the range, URI, ids, documents that begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n, pieces, seq, part = _encoder(tokenizer), [], 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, pieces, seq
            uri = write_file(root, np.concatenate(held), pieces)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([sum(p.offset == 0 for p in pieces)], pa.int64())]
            held, n, pieces, seq = [], 0, [], seq + 1
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "uri", "n_ids", "documents"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            keys = batch.column(0).to_pylist()
            for lo, ids, lens in encoder.rows(batch.column(1)):
                ids = np.insert(ids, np.cumsum(lens), end_id).astype(np.uint32)
                lens = lens + 1
                row, done, at = 0, 0, 0  # next document, how much of it is written, place in ids
                while row < len(lens):
                    take = min(int(lens[row]) - done, FILE_IDS - n)
                    pieces.append(Piece(n, int(lens[row]), done, keys[lo + row]))
                    held.append(ids[at : at + take])
                    n, at, done = n + take, at + take, done + take
                    if done == lens[row]:
                        row, done = row + 1, 0
                    if n == FILE_IDS:
                        yield flush()
        if n:
            yield flush()
        trim()

    return run


def write_tokens(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, scratch: Scratch) -> DataFrame:
    """Encode every whole text, append end_id, and write files in ascending order of keys (null first).

    tokenizer: the library's JSON. Returns one row a file: part, seq, uri, n_ids, documents. Rows of
    one key follow each other in the order they are read in. Only files of tasks that ended are named.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("tie", F.monotonically_increasing_id())
    n = docs.count()
    ranges = max(1, min(-(-n // USUAL_ROWS), MANY_RANGES), -(-n // MOST_ROWS))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.col("key").cast("string").alias("key"), "text", F.spark_partition_id().alias("part"))
    return scratch.save(dealt.mapInArrow(_write_range(tokenizer, end_id, scratch.path("tokens")), "part int, seq int, uri string, n_ids long, documents long"), "files")


def with_bases(files: DataFrame) -> DataFrame:
    """files with base: the ids of all files before. One number a range comes to the driver."""
    from pyspark.sql import Window

    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    before = files.sparkSession.createDataFrame(starts, "part int, part_base long")
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("own", own).join(F.broadcast(before), "part").withColumn("base", F.col("part_base") + F.col("own")).drop("own", "part_base")


def read_pieces(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode files (with base), a group of blocks at a time; one row for each document's part in a group.

    Columns: key (as text), start (ids before the document), n_tokens (of the document), at (where
    the part begins in it), n (its ids), crc (its part of the CRC-32 of the document's ids as
    little-endian 32-bit integers: XOR of all parts is the whole), ids (if asked for).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "n_tokens", "at", "n", "crc"] + ["ids"] * with_ids
        for batch in batches:
            for uri, base, group in zip(*(c.to_pylist() for c in batch.columns)):
                with TokenFile(uri) as file:
                    first = group * GROUP_BLOCKS
                    ids = file.ids(first, first + GROUP_BLOCKS).astype("<u4")
                    pieces = file.pieces()
                    n_ids = file.told["n_ids"]
                lo = first * rans.BLOCK_IDS
                begins = np.array([p.begin for p in pieces])
                a = int(np.searchsorted(begins, lo, "right")) - 1
                z = int(np.searchsorted(begins, lo + len(ids), "left"))
                ends = np.append(begins[1:], n_ids)[a:z]
                found = pieces[a:z]
                begin = np.maximum(begins[a:z], lo) - lo
                end = np.minimum(ends, lo + len(ids)) - lo
                offset = np.array([p.offset for p in found]) + begin + lo - begins[a:z]
                total = np.array([p.total for p in found])
                crc = np.array([zlib.crc32(ids[s:e]) for s, e in zip(begin, end)], np.uint32)
                crc = shift(crc, 4 * (total - offset - (end - begin)))
                cols = [pa.array([p.key for p in found], pa.string()), pa.array(base + lo + begin - offset), pa.array(total), pa.array(offset), pa.array(end - begin), pa.array(crc.astype(np.int64))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    groups = F.explode(F.sequence(F.lit(0), ((F.col("n_ids") - 1) / (GROUP_BLOCKS * rans.BLOCK_IDS)).cast("int")))
    units = files.select("uri", "base", groups.alias("group"))
    tasks = max(1, min(units.count(), 16 * files.sparkSession.sparkContext.defaultParallelism))
    schema = "key string, start long, n_tokens long, at long, n long, crc long" + ", ids array<int>" * with_ids
    return units.repartition(tasks).mapInArrow(run, schema)


def read_documents(files: DataFrame, key: str, kind: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from files (with base): key, start, n_tokens, ids_crc32, and ids if asked for.

    A document of which a part is missing is an error.
    """
    parts = read_pieces(files, with_ids)
    sums = [F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("found")] + [F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("ids")] * with_ids
    out = parts.groupBy("start", "n_tokens", "key").agg(*sums)
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document is not whole")).cast("long"))
    cols = [F.col("key").cast(kind).alias(key), "start", "n_tokens", whole.alias("ids_crc32")]
    return out.select(*cols, *([F.flatten(F.col("ids.ids")).alias("ids")] if with_ids else []))


def store_tokens(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Write the token ids of docs to files and read them back; one row per row of docs.

    Columns: key, start, n_tokens (with the end id), ids_crc32, and ids if asked for. A null text is
    empty: its end id alone. A null key comes first; rows that repeat a key have places of their own.
    An empty table writes no file and gives no rows. Only the two named columns are read. Strings of
    the tokenizer's added tokens are these tokens, as the library has it by default.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    files = with_bases(write_tokens(docs, key, text, tokenizer, end_id, scratch))
    return read_documents(files, key, docs.schema[key].dataType.simpleString(), with_ids)
