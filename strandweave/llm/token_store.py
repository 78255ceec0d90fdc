"""Token ids of documents in binary shards, with Elias-Fano coded boundaries.

A shard holds the ids of consecutive documents (ascending id, null ids first) back to back, as 16- or 32-bit
little-endian integers, then the document boundaries and the document ids as Elias-Fano sequences, then a
footer.  Neither costs 64 bits an entry, and ``Shard.document(i)`` reads one document by two selects.

Texts are range-partitioned by id, so each task writes one shard and starts follow from the shards' totals,
of which the driver holds one number a shard.  A task writes under a name of its own and renames, so a
repeated task leaves a whole shard; readers open only the files that the finished tasks named.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LOWER, WHITE, chunks, hash_spans, ragged, spans
from .elias_fano import EliasFano
from .storage import Workspace, partitions_for

MAGIC = b"SWTOKENS"
END_ID = 2
#: Words that a worker remembers before it starts over.
REMEMBERED = 1_500_000

# fixed values: the normaliser and the splitter of the tokenizer file whose words ``units`` finds by itself; texts
# go whole to the library where a file has others
UNITS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
UNITS_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

# 0 white, 1 letter, 2 digit, 3 sign, 4 anything that only the library splits; the two bytes of a Latin-1
# letter are letters, found by ``_classes``
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[WHITE] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[39] = 4
_TRAIL = np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True
_TRAIL[[0x97, 0xB7]] = False


def _classes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's class, and the bytes with plain letters lower-cased."""
    kind, low = _CLASS[body], LOWER[body]
    lead = np.flatnonzero(body[:-1] == 0xC3)
    lead = lead[_TRAIL[body[lead + 1]]]
    kind[lead] = kind[lead + 1] = 1
    upper = lead[body[lead + 1] < 0x9F] + 1
    low[upper] += 32
    return kind, low


def units(body: np.ndarray, at: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the word tokenizer treats apart, whether each is plain, each document's first span, and the
    lower-cased bytes.

    Words of ASCII and Latin-1 letters are runs of letters, single digits or runs of signs; words with
    anything else or an apostrophe stay whole, and so does a document that holds a special token's string.
    """
    kind, low = _classes(body)
    odd = np.flatnonzero(kind == 4)
    if len(odd):
        starts, ends, _ = spans(kind > 0, at)
        whole = np.unique(np.searchsorted(starts, odd, "right") - 1)
        kind[ragged(starts[whole], ends[whole] - starts[whole])] = 4
    new = np.ones(len(body), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new[at[:-1][at[:-1] < len(body)]] = True
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(body))[: len(first)]
    own = kind[first]
    first, end, plain = first[own > 0], end[own > 0], own[own > 0] != 4
    text = body.tobytes()
    for i in {int(np.searchsorted(at, p, "right")) - 1 for s in specials for p in _all(text, s)}:
        a, b = np.searchsorted(first, [at[i], at[i + 1]])
        first = np.concatenate([first[:a], at[i : i + 1], first[b:]])
        end = np.concatenate([end[:a], at[i + 1 : i + 2], end[b:]])
        plain = np.concatenate([plain[:a], [False], plain[b:]])
    return first, end, plain, np.searchsorted(first, at), low


def _all(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class Memory:
    """Ids of byte strings met so far, by 64-bit hash, in an open-addressed table of numpy arrays."""

    def __init__(self, most: int = REMEMBERED, bits: int = 16):
        self.most = most
        self.mask = np.uint64((1 << bits) - 1)
        self.hash = np.zeros(1 << bits, np.uint64)
        self.start, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the free slot where it would go."""
        slot = (h & self.mask).astype(np.int64)
        there = self.hash[slot]
        left = np.flatnonzero((there != h) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            there = self.hash[slot[left]]
            left = left[(there != h[left]) & (there != 0)]
        return slot

    def _put(self, h: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Store distinct new hashes; those that want one free slot take turns."""
        while len(h):
            slot = self._find(h)
            _, turn = np.unique(slot, return_index=True)
            self.hash[slot[turn]], self.start[slot[turn]], self.size[slot[turn]] = h[turn], start[turn], size[turn]
            rest = np.ones(len(h), bool)
            rest[turn] = False
            h, start, size = h[rest], start[rest], size[rest]

    def lookup(self, h: np.ndarray, missing: Callable[[np.ndarray], list]) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in ``ids`` of each hash; ``missing`` gives the ids of strings by index."""
        h = np.maximum(h, np.uint64(1))
        if self.entries > self.most:
            self.__init__(self.most)
        slot = self._find(h)
        new = np.flatnonzero(self.hash[slot] != h)
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            fresh = missing(new[first])
            size = np.fromiter(map(len, fresh), np.int64, len(fresh))
            total = int(size.sum())
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
            self.ids[self.used : self.used + total] = np.fromiter((i for x in fresh for i in x), np.uint32, total)
            start = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
            self.used += total
            self.entries += len(distinct)
            if 5 * self.entries > 3 * len(self.hash):
                old = self.hash != 0
                held = self.hash[old], self.start[old], self.size[old]
                bits = int(2 * self.entries).bit_length()
                self.mask = np.uint64((1 << bits) - 1)
                self.hash, self.start, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
                self._put(*held)
            self._put(distinct, start, size)
            slot = self._find(h)
        return self.start[slot], self.size[slot]


def _shown() -> np.ndarray:
    """How byte-level vocabularies write the bytes: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u2")
    table[plain] = plain
    rest = np.setdiff1d(np.arange(256), plain)
    table[rest] = 256 + np.arange(len(rest))
    return table


_SHOWN = _shown()
_LOADED: dict[str, tuple] = {}


def word_tokenizer(path: str):
    """The tokenizer of a file, its memory, its special tokens, and whether ``units`` splits as it does; loaded
    once in a worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        told = json.loads(t.to_str())
        known = (told["normalizer"], told["pre_tokenizer"], told["model"]["type"]) == (UNITS_NORMALIZER, UNITS_SPLITTER, "BPE")
        _LOADED[path] = t, Memory(), tuple(x.content.encode() for x in t.get_added_tokens_decoder().values()), known
    return _LOADED[path]


def encode_column(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, offsets) of chunks of whole documents: what the library gives for each whole text.

    Each distinct word goes to the library once, plain ones straight to its BPE model; the rest is gathered.
    Files with another normaliser or splitter get whole texts.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t, memory, specials, known = word_tokenizer(path)
    if not known:
        for _, _, body, at in chunks(column, 1 << 20):
            raw = body.tobytes()
            found = [e.ids for e in t.encode_batch_fast([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], add_special_tokens=False)]
            yield np.fromiter((i for x in found for i in x), np.uint32), np.cumsum([0, *map(len, found)])
        return
    model = t.model
    for _, _, body, at in chunks(column):
        start, end, plain, first, low = units(body, at, specials)
        h = hash_spans(low, start, end, 1)
        if not plain.all():
            h[~plain] = hash_spans(body, start[~plain], end[~plain], 2)

        def missing(which, start=start, end=end, plain=plain, body=body, low=low):
            out = [None] * len(which)
            simple = plain[which]
            text = _SHOWN[low].tobytes().decode("utf-16-le")
            for i in np.flatnonzero(simple).tolist():
                k = which[i]
                out[i] = [x.id for x in model.tokenize(text[start[k] : end[k]])]
            raw, hard = body.tobytes(), np.flatnonzero(~simple).tolist()
            for i, e in zip(hard, t.encode_batch_fast([raw[start[k] : end[k]].decode() for k in which[hard]], add_special_tokens=False), strict=True):
                out[i] = e.ids
            return out

        begin, size = memory.lookup(h, missing)
        ids = memory.ids[ragged(begin, size)]
        yield ids, np.concatenate([[0], np.cumsum(size)])[first]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Shard:
    """One shard file; only the footer and the two sequences are read before any ids."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        length = struct.unpack("<I", tail[:4])[0]
        self.info = json.loads(self.file.read_at(length, size - 12 - length))
        self.kind = np.dtype("<u2" if self.info["bytes"] == 2 else "<u4")
        at, self.bounds, self.names = self.info["ids"], None, None
        self.bounds = EliasFano.from_bytes(self.file.read_at(self.info["bounds"], at))
        self.names = EliasFano.from_bytes(self.file.read_at(self.info["names"], at + self.info["bounds"]))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind).astype(np.uint32)

    def documents(self, block: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, offsets) of runs of whole documents of about ``block`` ids."""
        bounds, i = self.bounds.all(), 0
        while i < len(self):
            j = min(len(self), max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, "right")) - 1))
            a, b = int(bounds[i]), int(bounds[j])
            ids = np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind).astype(np.uint32)
            yield i, ids, bounds[i : j + 1] - a
            i = j

    def doc_ids(self) -> list:
        return [None] * self.info["nulls"] + self.names.all().tolist()


def write_shard(uri: str, rows: Iterator[tuple[list, np.ndarray, np.ndarray]], wide: bool) -> tuple[int, int]:
    """Write (document ids, token ids, offsets) runs; ids ascend, nulls first.  (documents, tokens) written."""
    system, path = _open(uri)
    kind = np.dtype("<u4" if wide else "<u2")
    draft = f"{path}.{uuid.uuid4().hex}"
    bounds, names, total = [np.zeros(1, np.int64)], [], 0
    with system.open_output_stream(draft) as out:
        for ids_of, ids, at in rows:
            out.write(ids.astype(kind).tobytes())
            bounds.append(at[1:].astype(np.int64) + total)
            names += ids_of
            total += len(ids)
        nulls = sum(x is None for x in names)
        b, k = EliasFano.of(np.concatenate(bounds)).to_bytes(), EliasFano.of(np.array(names[nulls:], np.int64)).to_bytes()
        foot = json.dumps({"ids": total * kind.itemsize, "bytes": kind.itemsize, "bounds": len(b), "names": len(k), "nulls": nulls, "tokens": total}).encode()
        out.write(b + k + foot + struct.pack("<I", len(foot)) + MAGIC)
    system.move(draft, path)
    return len(names), total


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> list[tuple[int, str, int, int]]:
    """Write all documents' ids; the shards as (number, URI, documents, tokens) in ascending id order.

    Equal ids stay together or in neighbouring shards, in the order of a hash of their texts; null ids come
    first.  Null and empty texts have the end id alone.  An empty table writes no shard.  Ids that are not
    whole numbers are an error.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    placed = source.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"{folder}/shard-{part:07d}-{uuid.uuid4().hex}.tok"

        def rows(first):
            for batch in chain([first], batches):
                done = 0
                for ids, at in encode_column(batch.column(1), tokenizer_path):
                    n = len(at) - 1
                    closed = np.full(len(ids) + n, end_id, np.uint32)
                    closed[ragged(at[:-1] + np.arange(n), np.diff(at))] = ids
                    yield batch.column(0).slice(done, n).to_pylist(), closed, at + np.arange(n + 1)
                    done += n

        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        wide = word_tokenizer(tokenizer_path)[0].get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        n, total = write_shard(name, rows(first), wide)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["part", "uri", "n", "tokens"])

    found = placed.mapInArrow(run, "part int, uri string, n long, tokens long").collect()
    return [tuple(r) for r in sorted(found)]


def read_tokens(spark, shards: list[tuple[int, str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(``id_col`` long, start long, n_tokens long, ids_crc32 long) of every document, from the files alone."""
    base, rows = 0, []
    for part, uri, _, tokens in shards:
        rows.append((part, uri, base))
        base += tokens
    table = spark.createDataFrame(rows, "part int, uri string, base long")
    if rows:
        table = table.repartition(max(1, len(rows)))

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(uri)
                names = shard.doc_ids()
                for i, ids, at in shard.documents():
                    whole = ids.astype("<u4").tobytes()
                    n = len(at) - 1
                    crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + n], pa.int64()), pa.array(at[:-1] + base, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
                    base += int(at[-1])

    return table.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write every document's ids to shards in the shared folder and give what reading them back shows."""
    spark = docs.sparkSession
    folder = Workspace(spark, "tokens").path("shards")
    return read_tokens(spark, write_tokens(docs, tokenizer_path, folder, id_col, text_col, end_id), id_col)
