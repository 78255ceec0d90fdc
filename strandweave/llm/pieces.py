"""Piece encoding of texts with seeded merge-dropout, and lossless decoding.

The vocabulary is a SentencePiece BPE model with byte fallback.  Merges leave an agenda best first; each
candidate is skipped, whenever it comes up, when a keyed hash of (seed, document, replica, place in the text, place in the
stretch, length) falls below the dropout rate, so a seed fixes every segmentation, and each occurrence of a
word has draws of its own.  With rate 0 the ids are the library's own.

A space is a piece boundary mark, so no merge reaches across the start of a run of spaces, nor between two
characters that no piece of the vocabulary has next to each other; the stretches between are segmented
one by one.  The draws of all candidates that a stretch has are made for each occurrence; a segmentation is
remembered by the stretch and the set of candidates skipped, which fix it.  Anything the vocabulary lacks, the mark's own character included, is written in bytes,
so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import chunks, hash_spans, mix, ragged
from .storage import tidy
from .token_store import Memory

RATE, SEED = 0.1, 17
#: Characters of the longest stretches that are segmented many at a time.
LONG = 32
#: Draws that are made, and new stretches that are segmented, at a time.
DRAWS, MANY = 1 << 18, 1 << 14
#: Stretches, and segmentations, that a worker remembers before it starts over: a stretch's candidates take some
#: sixty bytes.
REMEMBERED = 600_000
#: Stands for the candidates of a stretch that is longer than LONG.
_MANY = (1 << 32) - 1
_MARK = "▁"
_NONE = np.iinfo(np.int32).max
_PLACE, _SIZE, _SPREAD, _ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, (1 << 64) - 1


class Pieces:
    """A model's tables: merge ranks and ids by text (space for the mark), byte ids, and bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.id, self.byte, texts, scores = {}, [0] * 256, [], {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                piece = piece.replace(_MARK, " ")
                self.id[piece], scores[piece] = i, -model.get_score(i)
                texts.append(piece.encode())
        order = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        self.rank = {piece: order[x] for piece, x in scores.items()}
        # the same with numbers: a piece or character has a number, and pairs of numbers merge to one
        names = [*self.id, *sorted({c for piece in self.id for c in piece} - set(self.id))]
        number = {x: k for k, x in enumerate(names)}
        self.outer = np.array([self.id.get(x, -1) for x in names])
        self.chars = np.array([len(x) for x in names])
        self.point = np.full(0x110000, -1, np.int64)
        for x, k in number.items():
            if len(x) == 1:
                self.point[ord(x)] = k if x in self.id else -1
        merges = sorted(((number[p[:i]] << 32) | number[p[i:]], r, number[p]) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair = np.array([m[0] for m in merges])
        self.pair_rank = np.array([m[1] for m in merges], np.int32)
        self.pair_id = np.array([m[2] for m in merges])
        self.size = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        joined = np.zeros((256, 256), bool)
        joined[128:, :] = joined[:, 128:] = True
        for piece in self.id:
            raw = piece.encode()
            for a, b in zip(raw, raw[1:], strict=False):
                joined[a, b] = True
        joined[128:, :128][:, 32] = joined[32, 32] = True
        self.joined = joined.ravel()
        self.longest = max(map(len, self.rank), default=0)
        self.candidates = Memory(REMEMBERED)
        self.memory: dict[tuple, Memory] = {}

    def segment(self, text: str, key: int, cutoff: int) -> list[int]:
        """Ids of a stretch; candidates whose keyed hash is under ``cutoff`` (of 2**32) are skipped."""
        rank = self.rank
        symbol: list = list(text)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[text[i : i + 2]], i, 2) for i in range(n - 1) if text[i : i + 2] in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            a, j = symbol[i], right[i]
            if a is None or j < 0 or len(a) + len(symbol[j]) != size:
                continue
            if cutoff:
                x = (key ^ (i * _PLACE + size * _SIZE)) & _ALL
                if ((x ^ (x >> 29)) * _SPREAD & _ALL) >> 32 < cutoff:
                    continue
            a = symbol[i] = a + symbol[j]
            symbol[j] = None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (both := a + symbol[k]) in rank:
                    heapq.heappush(agenda, (rank[both], i, len(both)))
            h = left[i]
            if h >= 0 and (both := symbol[h] + a) in rank:
                heapq.heappush(agenda, (rank[both], h, len(both)))
        out: list[int] = []
        for s in symbol:
            if s is not None:
                out += [self.id[s]] if s in self.id else [self.byte[x] for x in s.encode()]
        return out

    def segment_many(self, points: np.ndarray, key: np.ndarray, cutoff: int) -> list[list[int] | None]:
        """``segment`` of stretches of equal length at once, given as a matrix of their characters' numbers.

        Every round takes the first of the best candidates of each row, which is the agenda's order, and
        closes the row up.  None where a character is not in the vocabulary.
        """
        n, width = points.shape
        whole = (points >= 0).all(1)
        rows = np.flatnonzero(whole)
        symbol, key = points[rows], key[rows]
        place = np.broadcast_to(np.arange(width), symbol.shape).copy()
        count = np.full(len(rows), width)

        def ranks(a, b, at, k):
            wanted = (a << 32) | b
            where = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
            got = np.where((self.pair[where] == wanted) & (b >= 0), self.pair_rank[where], _NONE)
            if cutoff:
                long = self.chars[self.pair_id[where]]
                x = k ^ (at.astype(np.uint64) * np.uint64(_PLACE) + long.astype(np.uint64) * np.uint64(_SIZE))
                got[(x ^ (x >> np.uint64(29))) * np.uint64(_SPREAD) >> np.uint64(32) < np.uint64(cutoff)] = _NONE
            return got

        rank = np.full((len(rows), max(width - 1, 1)), _NONE, np.int32)
        for j in range(width - 1):
            rank[:, j] = ranks(symbol[:, j], symbol[:, j + 1], place[:, j], key)
        final, lens = np.zeros((len(rows), width), np.int64), np.zeros(len(rows), np.int64)
        index = np.arange(len(rows))
        while len(index):
            best = rank.argmin(1)
            live = rank[np.arange(len(index)), best] < _NONE
            done = index[~live]
            final[done, : symbol.shape[1]], lens[done] = symbol[~live], count[~live]
            index, symbol, place, rank, key, count, best = (x[live] for x in (index, symbol, place, rank, key, count, best))
            if not len(index):
                break
            row = np.arange(len(index))
            where = np.searchsorted(self.pair, (symbol[row, best] << 32) | symbol[row, best + 1])
            symbol[row, best] = self.pair_id[where]
            shift = np.minimum(np.arange(symbol.shape[1] - 1) + (np.arange(symbol.shape[1] - 1) > best[:, None]), symbol.shape[1] - 1)
            symbol, place = np.take_along_axis(symbol, shift, 1), np.take_along_axis(place, shift, 1)
            count = count - 1
            if symbol.shape[1] == 1:
                final[index, 0], lens[index] = symbol[:, 0], 1
                break
            cut = shift[:, :-1]
            rank = np.take_along_axis(rank, np.minimum(cut, rank.shape[1] - 1), 1)
            after = best + 1 < count
            rank[row[~after], np.minimum(best[~after], rank.shape[1] - 1)] = _NONE
            r, c = row[after], best[after]
            rank[r, c] = ranks(symbol[r, c], symbol[r, c + 1], place[r, c], key[r])
            r = row[best > 0]
            c = best[best > 0] - 1
            rank[r, c] = ranks(symbol[r, c], symbol[r, c + 1], place[r, c], key[r])
        out: list = [None] * n
        flat = self.outer[final].tolist()
        for r, ids, k in zip(rows.tolist(), flat, lens.tolist(), strict=True):
            out[r] = ids[:k]
        return out

    def places(self, text: str) -> list[int]:
        """All candidates that a stretch can have, as place * LONG + length - 1; ``_MANY`` of a long one."""
        n = len(text)
        if n > LONG:
            return [_MANY]
        return [i * LONG + j - i - 1 for i in range(n) for j in range(i + 2, min(n, i + self.longest) + 1) if text[i:j] in self.rank]

    def skipped(self, word: np.ndarray, key: np.ndarray, cutoff: int, texts) -> np.ndarray:
        """A hash of the set of candidates that each stretch skips, 0 of none; the key of a long one."""
        begin, size = self.candidates.lookup(word, lambda which: [self.places(x) for x in texts(which)])
        out = np.zeros(len(word), np.uint64)
        ends = np.cumsum(size, dtype=np.int64)
        first = 0
        while first < len(word):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DRAWS, "right")))
            own = size[first:last].astype(np.int64)
            code = self.candidates.ids[ragged(begin[first:last], own)].astype(np.uint64)
            row = np.repeat(np.arange(first, last), own)
            x = key[row] ^ (code // np.uint64(LONG) * np.uint64(_PLACE) + (code % np.uint64(LONG) + np.uint64(1)) * np.uint64(_SIZE))
            hit = (code == _MANY) | ((x ^ (x >> np.uint64(29))) * np.uint64(_SPREAD) >> np.uint64(32) < np.uint64(cutoff))
            row, code = row[hit], code[hit]
            np.add.at(out, row, np.where(code == _MANY, key[row], mix(code + np.uint64(1))))
            first = last
        return out

    def encode(self, body: np.ndarray, at: np.ndarray, document: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a chunk of documents, whose draws are keyed by ``document``."""
        rows = len(at) - 1
        filled = np.flatnonzero(np.diff(at))
        body = np.insert(body, at[filled], 32)
        at = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        new = np.ones(len(body), bool)
        new[1:] = ((body[1:] == 32) & (body[:-1] != 32)) | ~self.joined[(body[:-1].astype(np.int64) << 8) | body[1:]]
        new[at[:-1][at[:-1] < len(body)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(body))
        first = np.searchsorted(start, at)
        per = np.diff(first)
        h = hash_spans(body, start, end, 3)
        cutoff = int(rate * (1 << 32))
        raw = body.tobytes()
        key = h
        if cutoff:
            key = mix(np.repeat(document, per) + (start - np.repeat(at[:-1], per)).astype(np.uint64) * np.uint64(_PLACE))
            h = mix(h ^ self.skipped(h, key, cutoff, lambda which: [raw[a:b].decode() for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]))

        def missing(which):
            a, size, keys = start[which], end[which] - start[which], key[which]
            own = body[ragged(a, size)]
            points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), "<u4")
            heads = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            begin = heads[np.concatenate([[0], np.cumsum(size)[:-1]])]
            chars = np.diff(np.append(begin, len(points)))
            out: list = [None] * len(which)
            for n in np.unique(chars[chars <= LONG]).tolist():
                rows = np.flatnonzero(chars == n)
                for part in np.array_split(rows, -(-len(rows) // MANY)):
                    found = self.segment_many(self.point[points[begin[part][:, None] + np.arange(n)]], keys[part], cutoff)
                    for i, ids in zip(part.tolist(), found, strict=True):
                        out[i] = ids
            for i in [i for i, ids in enumerate(out) if ids is None]:
                out[i] = self.segment(raw[a[i] : a[i] + size[i]].decode(), int(keys[i]), cutoff)
            return out

        memory = self.memory.setdefault((rate, seed), Memory(REMEMBERED))
        begin, size = memory.lookup(h, missing)
        return memory.ids[ragged(begin, size)], np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[first]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of documents, without the space that encoding puts before each."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        body = self.bytes[ragged(self.start[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        lead = ends[:-1][np.diff(ends) > 0]
        lead = lead[body[lead] == 32]
        gone = np.zeros(len(body) + 1, np.int64)
        gone[lead + 1] = 1
        return np.delete(body, lead), ends - np.cumsum(gone)[ends]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """A file's tables, loaded once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _keys(names: pa.Array, replicas: pa.Array | None, seed: int) -> np.ndarray:
    """64-bit keys of documents and their replicas."""
    told = names.to_pylist() if replicas is None else zip(names.to_pylist(), replicas.to_pylist(), strict=True)
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in told], np.uint64)


def _encoded(names: pa.Array, texts: pa.Array, model: Pieces, rate: float, seed: int, replicas: pa.Array | None = None) -> Iterator[tuple]:
    document = _keys(names, replicas, seed)
    for first, end, body, at in chunks(texts):
        ids, offsets = model.encode(body, at, document[first:end], rate, seed)
        yield first, end, body, at, ids, offsets


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED, out_col: str = "ids", replica_col: str | None = None) -> DataFrame:
    """The documents with their piece ids, array<int>, in ``out_col`` (which replaces one of that name).

    Null and empty texts get an empty array.  A null id is a document of its own.  Rows that repeat an id are
    cut alike, unless ``replica_col`` tells them apart.  All other columns stay.
    """
    kept = [c for c in docs.columns if c != out_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    i, t = kept.index(id_col), kept.index(text_col)
    r = None if replica_col is None else kept.index(replica_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            for first, end, _, _, ids, at in _encoded(batch.column(i), batch.column(t), model, rate, seed, None if r is None else batch.column(r)):
                arrays = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), arrays], [*kept, out_col])

    return docs.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in ``out_col`` (which replaces one of that name); null ids give an
    empty text, and so do ids that stand for no text."""
    kept = [c for c in encoded.columns if c != out_col]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in kept])
    k = kept.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            lists = batch.column(k)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            body, ends = model.decode(lists.flatten().to_numpy(zero_copy_only=False), at)
            raw = body.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out_col])

    return encoded.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """One row per input row: (``id_col``, n_tokens long, ids_crc32 long, text_crc32 long, lossless boolean).

    Every whole text is encoded and the ids decoded again; ``text_crc32`` is of the decoded bytes and
    ``lossless`` says whether they equal the text's.  Null texts count as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pieces(model_path)
        for batch in batches:
            for first, end, body, was, ids, at in _encoded(batch.column(0), batch.column(1), model, rate, seed):
                back, ends = model.decode(ids, at)
                raw, text, whole = body.tobytes(), back.tobytes(), ids.astype("<u4").tobytes()
                cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), was[:-1].tolist(), was[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b, *_ in cuts], pa.int64()), pa.array([zlib.crc32(text[e:f]) for *_, e, f in cuts], pa.int64()), pa.array([raw[c:d] == text[e:f] for *_, c, d, e, f in cuts])], ["id", "n_tokens", "ids_crc32", "text_crc32", "lossless"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_crc32 long, text_crc32 long, lossless boolean")
    return out.withColumnRenamed("id", id_col)
