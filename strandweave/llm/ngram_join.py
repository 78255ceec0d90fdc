"""Set-similarity join of documents on word shingles, exact, and its components.

A document is the set of its distinct five-word shingles.  Documents of equal sets share one *node*, so
copies cost one entry however many there are.  Two nodes link when ``100 * |A n B| >= 80 * |A u B|``.

Candidates come from a size-aware heavy-light join.  Shingles have one global order, rare ones first, then
by document frequency, so a passage that many documents share comes last.  Linked sets of sizes n and m
share at least ``ceil(0.8 n)`` elements, so the first ``n - ceil(0.8 n) + c`` elements of both share c:

* light sets (n up to a boundary) enumerate every two-element subset of that prefix (c = 2), and two light
  sets are candidates when they have a subset in common;
* heavy sets put their prefix (c = 1) in inverted lists, together with the light sets whose size could
  still match a heavy one, and the lists are scanned.

The boundary is the size at which the estimated rows (subsets against postings and the partners met in
their lists) are fewest.  Any order and any boundary give the same links; they only change the cost.

A posting knows its place in the order, and so the most that two sets can share if they meet there first;
pairs that would need more are no candidates.  A list of a very frequent key is dealt out in parts.

No list is expanded into all its pairs.  Within a long list, each size band offers a pivot and the other
members meet only these.  After links have been contracted, lists whose members are still in several
components go on: the members outside the largest component meet a few of its members, and then what is left
of them meets everyone in blocks, so that at the end each list is in one component or every member outside
its largest has met all others.  That holds at every size; there is no other path for large inputs.

Each candidate is screened by parity bitmaps: a bitmap with a bit for each residue that an odd number of
elements has differs from another in no more places than the sets differ in elements, so what it screens out
can never link.  What passes is verified on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bytetext import chunks, mix, shingle_sets
from .components import components
from .storage import Workspace, partitions_for, tidy

#: Lists up to this long meet in all their (at most 120) pairs at once.
SHORT_LIST = 16
#: Pivots of a size band in a longer list, and members of a list's largest component that the others probe.
FIRST_PIVOTS, PROBES = 1, 3
#: Documents of a part of a list whose key is frequent.
PART = 1 << 16
#: Rows of a block of what is left, and of a block of those that it meets.
LEFT_BLOCK, MET_BLOCK = 1024, 8192
#: Words (of 64 bits) of two bitmaps' differences that are held at once.
DIFFERENCES = 1 << 20
#: Shingles whose document frequency is kept for the global order: at most this many, in memory of every
#: worker (16 bytes each).  Beyond it the least frequent are ordered by hash like the rare ones.
ORDERED = 1 << 20
#: Shingles that a worker gathers before it packs them, and those of a range that one task adds up.
GATHERED = 1 << 20
#: Rows of a batch of whole sets, and of one of bitmaps, on their way to a worker.
SET_ROWS, SCREEN_ROWS = 256, 2048
#: A shingle in fewer documents counts as rare.
RARE = 8
#: Bits, for each set that candidates need, of the bitmap that says which these are, and most bits of it.  A
#: fuller bitmap sends more sets than needed and loses none.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Sizes tried as the boundary between light and heavy sets.
LARGEST_BOUNDARY = 256

_RATIO = 1.25
_LOW = np.uint64(0xFFFFFFFFFFFFFFFE)


def _sets(column: pa.Array, width: int):
    for first, _, body, at in chunks(column):
        yield first, shingle_sets(body, at, width)


def _node(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, in a power of two of 64-bit words, with at least two bits an element.  The
    bitmap of fewer words is the exclusive or of this one's equal parts."""
    bits = max(128, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def most_apart(total, num: int, den: int):
    """How many elements at most are in one only of two linked sets, whose sizes add up to ``total``."""
    return total - 2 * -(-num * total // (num + den))


def nodes(docs: DataFrame, id_col: str, text_col: str, width: int = 5) -> DataFrame:
    """(id, n, node, bitmap) per document: the size of its set, the set's 64-bit name, null for the empty set,
    and its parity bitmap."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            n, node, maps = [], [], []
            for _, found in _sets(batch.column(1), width):
                n += [len(s) for s in found]
                node += [_node(s) if len(s) else None for s in found]
                maps += [parity(s).tobytes() if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(maps, pa.binary())], ["id", "n", "node", "bitmap"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind.simpleString()}, n long, node long, bitmap binary")


def _planes(values: np.ndarray, width: int) -> bytes:
    """Byte planes, which pack well when high bytes are mostly zero."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def frequencies(docs: DataFrame, text_col: str, ranges: int, width: int, rare: int) -> DataFrame:
    """Document frequencies of all shingles: (kind 0, the shingle's top 40 bits, df) where df >= ``rare``,
    and (kind 1, sum of df * (df - 1), sum of df) over the others.

    Every worker sends sorted, delta-packed ids and counts of what it has read, dealt by id range, about
    three bytes a shingle; the owner of a range adds them up.
    """

    def pack(tokens: list[np.ndarray]):
        ids, counts = np.unique(np.concatenate(tokens) >> np.uint64(24), return_counts=True)
        owner = (ids * np.uint64(ranges)) >> np.uint64(40)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            part = ids[a:b]
            delta = np.concatenate([part[:1], np.diff(part)])
            yield int(owner[a]), b - a, _planes(delta, 5) + _planes(counts[a:b], 4)

    def batch_of(rows):
        r, n, blob = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["r", "n", "blob"])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            for _, found in _sets(batch.column(0), width):
                held += [s for s in found if len(s)]
                size += sum(map(len, found))
                if size >= GATHERED:
                    yield batch_of(pack(held))
                    held, size = [], 0
        if size:
            yield batch_of(pack(held))

    def add(batches):
        packed: dict[int, list] = {}
        for batch in batches:
            for r, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed.setdefault(r, []).append((n, blob))
        for r in list(packed):
            parts = [(np.cumsum(_unplanes(blob[: 5 * n], n, 5)), _unplanes(blob[5 * n :], n, 4).astype(np.int64)) for n, blob in packed.pop(r)]
            token, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(token)
            token, count = token[order], count[order]
            firsts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            df = np.add.reduceat(count, firsts)
            often = df >= rare
            low = df[~often]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(often.sum(), np.int32), [1]]).astype(np.int32)), pa.array(np.concatenate([token[firsts][often].astype(np.int64), [int((low * (low - 1)).sum())]]), pa.int64()), pa.array(np.concatenate([df[often], [int(low.sum())]]), pa.int64())], ["kind", "a", "b"])

    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(gather), "r int, n long, blob binary")
    return packed.repartition(ranges, "r").mapInArrow(tidy(add), "kind int, a long, b long")


def boundary(sizes: dict[int, int], partners: float, num: int, den: int) -> int:
    """The largest light size: the one with the fewest estimated rows.

    ``sizes`` counts nodes by size, all beyond ``LARGEST_BOUNDARY`` under that key plus one; a posting meets
    ``partners`` others in its list.
    """

    def prefix(n: int) -> int:
        return n - -(-num * n // den) + 1

    def cost(x: int) -> float:
        light = sum(k * (prefix(n) + 1) * prefix(n) / 2 for n, k in sizes.items() if n <= x)
        return light + sum(k * prefix(n) * (1 + partners) for n, k in sizes.items() if n > x * num / den)

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def _prefixes(docs: DataFrame, text_col: str, order, light: int, num: int, den: int, width: int) -> DataFrame:
    """(key, part, band, node, n, place): keys of two-element subsets (even) and of single elements (odd), and
    the place of their last element in the set's order.  ``part`` is -1 but for frequent keys."""

    def run(batches):
        ids, freq = order.value
        bands = _RATIO ** np.arange(1, 200)
        seen: set[int] = set()
        for batch in batches:
            for _, found in _sets(batch.column(0), width):
                keys, places, often, owners, sizes, counts = [], [], [], [], [], []
                found = [s for s in found if den * len(s) >= num * (len(s) + 1)]  # others link to equal sets only
                if not found:
                    continue
                whole = np.concatenate(found)
                top = whole >> np.uint64(24)
                df = np.zeros(len(whole), np.int64)
                if len(ids):
                    where = np.minimum(np.searchsorted(ids, top), len(ids) - 1)
                    df = np.where(ids[where] == top, freq[where], 0)
                at = 0
                for s in found:
                    own, n = df[at : at + len(s)], len(s)
                    at += n
                    if (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    want = n - -(-num * n // den) + 2
                    in_order = np.flatnonzero(own == 0)[:want]
                    if len(in_order) < want:
                        hot = np.flatnonzero(own)
                        in_order = np.concatenate([in_order, hot[np.lexsort((s[hot], own[hot]))][: want - len(in_order)]])
                    first, own = s[in_order], own[in_order]
                    out = []
                    if n <= light:
                        i, j = np.array(list(combinations(range(len(first)), 2)), np.int64).reshape(-1, 2).T
                        out.append(mix(np.minimum(first[i], first[j]) * np.uint64(3) + mix(np.maximum(first[i], first[j]))) & _LOW)
                        places.append(j)
                        often.append(own[i])  # the rarer of the two
                    if n > light or den * n >= num * (light + 1):
                        out.append(first[: want - 1] | np.uint64(1))
                        places.append(np.arange(len(out[-1])))
                        often.append(own[: want - 1])
                    keys += out
                    owners.append(node)
                    sizes.append(n)
                    counts.append(sum(map(len, out)))
                if len(seen) > 1 << 20:
                    seen.clear()
                if keys:
                    n, node = np.repeat(np.array(sizes, np.int32), counts), np.repeat(np.array(owners, np.int64), counts)
                    parts = np.concatenate(often) // per_part + 1
                    part = np.where(parts > 1, (mix(node.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(part.astype(np.int32)), pa.array(np.searchsorted(bands, n, "right").astype(np.int32)), pa.array(node), pa.array(n), pa.array(np.concatenate(places).astype(np.int32))], ["key", "part", "band", "node", "n", "place"])

    per_part = PART
    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "key long, part int, band int, node long, n int, place int")


def _scan(lists: DataFrame, light: int, num: int, den: int) -> DataFrame:
    """Candidates (kind 0, a, b) and the rows of longer lists (kind 1, key, node, n), from lists sorted by
    (key, part, band, node).  What is kept of a list between batches is its tail or, beyond a million rows,
    its pivots, so a list of any length streams through.  All lists in parts count as longer ones."""

    def scanned(key, na, pa_, nb, pb):
        single = key & 1 == 1
        shared = np.where(single, 1, 2) + np.minimum(na - 1 - pa_, nb - 1 - pb)
        return (num * np.maximum(na, nb) <= den * np.minimum(na, nb)) & (~single | (np.maximum(na, nb) > light)) & ((num + den) * shared >= num * (na + nb))

    def short(key, node, n, place):
        a, b = [], []
        for d in range(1, min(SHORT_LIST, len(key))):
            ok = (key[d:] == key[:-d]) & scanned(key[d:], n[d:], place[d:], n[:-d], place[:-d])
            a.append(node[:-d][ok])
            b.append(node[d:][ok])
        return a, b

    def long(key, band, node, n, place, pivots):
        a, b = [], []
        for level in np.unique(band):
            own = np.flatnonzero(band == level)
            known = pivots.setdefault(int(level), [])
            for i in own[: max(0, FIRST_PIVOTS - len(known))]:
                known.append((node[i], n[i], place[i]))
            for below in (level - 1, level):
                for p, size, at in pivots.get(int(below), []):
                    ok = own[scanned(np.int64(key), n[own], place[own], size, at) & (node[own] != p)]
                    a.append(np.full(len(ok), p))
                    b.append(node[ok])
        return a, b

    def rows(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c.astype(np.int64))], ["kind", "a", "b", "c"])

    def pairs(a, b):
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return rows(0, both[:, 0], both[:, 1], np.zeros(len(both)))

    def run(batches):
        tail, open_key, pivots = None, None, {}

        def work(cols, final):
            nonlocal tail, open_key, pivots
            key, part, band, node, n, place = cols
            if not len(key):
                return
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1]) | (band[1:] != band[:-1])
            key, part, band, node, n, place = cols = tuple(c[fresh] for c in cols)
            firsts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(firsts[1:], len(key))
            end = len(key)
            if not final and len(key) - firsts[-1] < 1 << 20:
                end = int(firsts[-1])
                tail = tuple(c[end:] for c in cols)
            lens = ends - firsts
            lasting = open_key is not None and (key[0], part[0]) == open_key
            few = (lens <= SHORT_LIST) & (part[firsts] < 0)
            if lasting:
                few[0] = False
            some = np.repeat(few & (lens > 1), lens)[:end] if end else np.zeros(0, bool)
            a, b = short(key[:end][some], node[:end][some], n[:end][some], place[:end][some])
            over = []
            for g in np.flatnonzero(~few):
                i, j = int(firsts[g]), int(ends[g])
                if i >= end:
                    continue
                if (key[i], part[i]) != open_key:
                    pivots = {}
                x, y = long(key[i], band[i:j], node[i:j], n[i:j], place[i:j], pivots)
                a, b, open_key = a + x, b + y, (key[i], part[i])
                over.append((i, j))
            yield pairs(a, b)
            for i, j in over:
                yield rows(1, key[i:j], node[i:j], n[i:j])

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if tail is not None:
                cols = tuple(np.concatenate(x) for x in zip(tail, cols, strict=True))
                tail = None
            yield from work(cols, False)
        if tail is not None:
            cols, tail = tail, None
            yield from work(cols, True)

    return lists.mapInArrow(tidy(run), "kind int, a long, b long, c long")


def _by_words(column: pa.Array) -> dict[int, np.ndarray]:
    """The rows of a column of bitmaps by their number of words."""
    words = pc.divide(pc.binary_length(column), 8).to_numpy(zero_copy_only=False)
    return {int(w): np.flatnonzero(words == w) for w in np.unique(words)}


def _bitmaps(column: pa.Array, rows: np.ndarray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint64).reshape(-1, words)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought to fewer words."""
    return x if x.shape[1] == words else np.bitwise_xor.reduce(x.reshape(len(x), -1, words), 1)


def _screened(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps allow to link; ``maps`` has (node, n, bitmap) of all nodes in them."""

    def screen(batches):
        for batch in batches:
            na, x, nb, y = batch.columns[2:]
            limit = most_apart(na.to_numpy() + nb.to_numpy(), num, den)
            keep = np.zeros(len(batch), bool)
            other = _by_words(y)
            for wx, rows in _by_words(x).items():
                for wy, more in other.items():
                    own, least = np.intersect1d(rows, more, assume_unique=True), min(wx, wy)
                    for part in np.array_split(own, -(-len(own) * max(wx, wy) // DIFFERENCES)) if len(own) else ():
                        apart = _folded(_bitmaps(x, part, wx), least) ^ _folded(_bitmaps(y, part, wy), least)
                        keep[part] = np.bitwise_count(apart).sum(1, dtype=np.int64) <= limit[part]
            yield batch.select([0, 1]).filter(pa.array(keep))

    def side(name: str) -> DataFrame:
        return maps.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"map_{name}"))

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "map_a", "n_b", "map_b").mapInArrow(tidy(screen), "a long, b long")


def _needed(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with a bit for each node."""
    spots = nodes.selectExpr(f"pmod(node, {bits}) as spot")
    words = spots.selectExpr("spot div 64 as w", "shiftleft(1L, cast(spot % 64 as int)) as bit").groupBy("w").agg(F.bit_or("bit").alias("m"))
    out = np.zeros(bits // 64, np.int64)
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return out.view(np.uint8)


def _bodies(docs: DataFrame, text_col: str, nodes: DataFrame, width: int) -> DataFrame:
    """(node, body): the whole sets of the nodes, and of the few others that share their bits."""
    bits = min(MOST_BITS, 1 << (BITS_EACH * max(nodes.count(), 64) - 1).bit_length())
    bitmap = docs.sparkSession.sparkContext.broadcast(_needed(nodes, bits))

    def run(batches):
        need, seen = bitmap.value, set()
        for batch in batches:
            names, blobs = [], []
            for _, found in _sets(batch.column(0), width):
                for s in found:
                    if len(s):
                        node = _node(s)
                        spot = node % bits
                        if need[spot >> 3] >> (spot & 7) & 1 and node not in seen:
                            seen.add(node)
                            names.append(node)
                            blobs.append(s.tobytes())
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["node", "body"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "node long, body binary").groupBy("node").agg(F.any_value("body").alias("body"))


def _verified(sets: DataFrame, candidates: DataFrame, num: int, den: int) -> DataFrame:
    """The candidates (a, b) whose whole sets link."""

    def verify(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[where] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = candidates.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    return joined.select("a", "b", "body_a", "body_b").mapInArrow(tidy(verify), "a long, b long")


def _divided(lists: DataFrame, labels: DataFrame, work: Workspace, turn: int, rows: int) -> DataFrame | None:
    """(key, node, n, root, main, size, others) of all members of the lists that lie in several components:
    ``main`` is a list's largest component, ``others`` counts the members outside it.  None where there are none."""
    marked = work.table(lists.join(labels, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), f"marked-{turn}", rows=rows)
    parts = marked.groupBy("key", "root").agg(F.count("*").alias("members"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts"), F.sum("members").alias("size"), F.max("members").alias("most")).where("parts > 1")
    main = work.table(main.select("key", "main", "size", (F.col("size") - F.col("most")).alias("others")), f"main-{turn}", rows=rows)
    return None if main.isEmpty() else marked.join(main, "key")


def _probing(own: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b): the members outside each list's largest component and a few of its members.

    ``own`` has (key, node, n, root, main, size, others) of all members of lists in several components.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    probed = own.where("root = main").withColumn("i", rank).where(F.col("i") <= PROBES).select("key", F.col("node").alias("p"), F.col("n").alias("pn"))
    met = own.where("root <> main").select("key", "node", "n").join(probed, "key").where(f"{num} * greatest(n, pn) <= {den} * least(n, pn)")
    return met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _in_blocks(own: DataFrame, maps: DataFrame, num: int, den: int, work: Workspace) -> DataFrame:
    """Candidates (a, b), screened: every member outside a list's largest component and all others of the list
    in other components.

    Lists with the same largest component are taken as one group where that means fewer comparisons (near
    copies stand together in many lists), else each by itself.  A group is cut into blocks of its members
    outside the component (``LEFT_BLOCK``) and blocks of all its members (``MET_BLOCK``); each pair of blocks
    is a piece of work of its own, so no group is gathered in one task.
    """
    together = own.select("main", "node", "n", "root").distinct()
    costs = own.select("key", "main", "size", "others").distinct().groupBy("main").agg(F.sum(F.col("size") * F.col("others")).alias("apart"))
    groups = together.groupBy("main").agg(F.count("*").alias("s"), F.count(F.when(F.col("root") != F.col("main"), 1)).alias("r")).join(costs, "main")
    groups = work.table(groups.select("main", "s", "r", (F.col("s") * F.col("r") <= F.col("apart")).alias("one")), "groups")
    whole = together.join(groups.where("one"), "main").select(F.col("main").alias("g"), "one", "main", "node", "n", "root", "s", "r")
    single = own.join(groups.where("not one").select("main", "one"), "main").select(F.col("key").alias("g"), "one", "main", "node", "n", "root", F.col("size").alias("s"), F.col("others").alias("r"))
    rows = whole.unionByName(single).join(maps.select("node", "bitmap"), "node")
    rows = rows.withColumn("nr", F.ceil(F.col("r") / LEFT_BLOCK).cast("int")).withColumn("ns", F.ceil(F.col("s") / MET_BLOCK).cast("int"))
    h = F.xxhash64("node")
    i, j = F.pmod(h, F.col("nr")).cast("int"), F.pmod(F.shiftright(h, 20), F.col("ns")).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    kept = ["node", "n", "root", (F.col("root") != F.col("main")).alias("is_left"), "bitmap"]
    left = rows.where("root <> main").select("g", "one", i.alias("i"), every("ns").alias("j"), F.lit(0).alias("side"), *kept)
    met = rows.select("g", "one", every("nr").alias("i"), j.alias("j"), F.lit(1).alias("side"), *kept)
    blocks = left.unionByName(met).repartition("g", "one", "i", "j").sortWithinPartitions("g", "one", "i", "j", "side", "node")

    def against(own: dict, batch: pa.RecordBatch):
        """The pairs of the block's left members and of a batch of met ones."""
        node, n, root, is_left = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, 9))
        n = n.astype(np.int64)
        for wy, rows in _by_words(batch.column(9)).items():
            y = _bitmaps(batch.column(9), rows, wy)
            for wx, (x, x_node, x_n, x_root) in own.items():
                least = min(wx, wy)
                short, other = _folded(x, least), _folded(y, least)
                step = max(1, DIFFERENCES // (len(x) * least))
                for at in range(0, len(rows), step):
                    k = rows[at : at + step]
                    total = x_n[:, None] + n[k]
                    close = (num * np.maximum(x_n[:, None], n[k]) <= den * np.minimum(x_n[:, None], n[k])) & (x_root[:, None] != root[k]) & (~is_left[k] | (x_node[:, None] < node[k]))
                    apart = np.bitwise_count(short[:, None] ^ other[None, at : at + step]).sum(2, dtype=np.int64)
                    p, q = np.nonzero(close & (apart <= most_apart(total, num, den)))
                    yield x_node[p], node[k][q]

    def compare(batches):
        open_, held, own = None, [], None
        for batch in batches:
            told = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            firsts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in told], 0)]))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(batch)], strict=True):
                name, part = tuple(int(c[first]) for c in told[:4]), batch.slice(first, end - first)
                if name != open_:
                    open_, held, own = name, [], None
                if told[4][first] == 0:
                    held.append(part)
                elif held:
                    if own is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        cols = [whole.column(k).to_numpy() for k in (5, 6, 7)]
                        own = {w: (_bitmaps(whole.column(9), rows, w), *(c[rows] for c in cols)) for w, rows in _by_words(whole.column(9)).items()}
                    for x, y in against(own, part):
                        a.append(x)
                        b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return blocks.mapInArrow(tidy(compare), "a long, b long").distinct()


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, work: Workspace | None = None) -> DataFrame:
    """One row per input row: (``id_col``, n_shingles long, component_id, node long).

    ``component_id`` is the least id reachable by links, the row's own included; ``node`` names the row's
    shingle set and is null without words.  Null and empty texts link with nothing and keep their own id.
    A null id never becomes a component's name unless every id in it is null.  Repeated rows come out as
    often as they went in.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "ngram")
    num, den = percent, 100
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = work.table(nodes(docs, "id", "text", width), "nodes")
    rows = found.count()
    top = F.least("n", F.lit(LARGEST_BOUNDARY + 1))
    sizes = {r[0]: r[1] for r in found.where("n > 0").groupBy(top.alias("n")).count().collect()}
    total = found.agg(F.sum("n")).first()[0] or 0

    counted = work.table(frequencies(docs, "text", max(partitions_for(docs), total // GATHERED), width, RARE), "frequencies")
    levels = counted.where("kind = 0").groupBy(F.log2("b").cast("int").alias("level")).count().collect()
    least, kept = 63, 0
    for level, count in sorted(map(tuple, levels), reverse=True):
        if (kept := kept + count) > ORDERED:
            break
        least = level
    often = counted.where(f"kind = 0 and b >= {1 << least}").select("a", "b").toArrow()
    ids, freq = often.column("a").to_numpy().astype(np.uint64), often.column("b").to_numpy()
    order = np.argsort(ids)
    met, all_df = counted.where("kind = 1").agg(F.sum("a"), F.sum("b")).first()
    light = boundary(sizes, (met or 0) / max(all_df or 1, 1), num, den)

    spread = spark.sparkContext.broadcast((ids[order], freq[order]))
    keys = _prefixes(docs, "text", spread, light, num, den, width)
    lists = keys.repartition(partitions_for(docs), "key", "part").sortWithinPartitions("key", "part", "band", "node")
    scan = work.table(_scan(lists, light, num, den), "scan")
    spread.unpersist()
    fresh = work.table(scan.where("kind = 0").select("a", "b").distinct(), "met-0")
    long_lists = work.table(scan.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("c").cast("int").alias("n")).distinct(), "lists")
    work.drop("scan", "frequencies")
    listed = long_lists.count()

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long_lists.select("node")).distinct()

    one_each = found.where("node is not null").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("bitmap").alias("bitmap"))
    maps = work.table(one_each.join(ends(fresh), "node", "left_semi"), "maps")
    fresh = work.table(_screened(fresh, maps, num, den), "candidates-0", batch=SCREEN_ROWS)
    # whatever a later round compares stands in a long list, so the sets are gathered once
    sets = work.table(_bodies(docs, "text", work.table(ends(fresh), "ends"), width), "sets")
    labels = spark.createDataFrame([], "node long, root long")
    for turn in range(3):
        if not fresh.isEmpty():
            proven = work.table(_verified(sets, fresh, num, den), f"links-{turn}", batch=SET_ROWS)
            labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(proven), work, f"cc{turn}")
        own = _divided(long_lists, labels, work, turn, listed) if turn < 2 else None
        if own is None:
            break
        fresh = _screened(_probing(own, num, den), maps, num, den) if turn == 0 else _in_blocks(own, maps, num, den, work)
        fresh = work.table(fresh, f"candidates-{turn + 1}", batch=SCREEN_ROWS)
    named = work.table(found.join(labels, "node", "left").select("id", "n", "node", F.coalesce("root", "node").alias("root")), "named", rows=rows)
    least_id = work.table(named.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), "least", rows=rows)
    work.keep("named", "least")
    out = named.join(least_id, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """The documents, with their columns, of which one stays of each component: that with the least id.

    Documents without words stay.  Of rows that repeat an id and its shingle set one stays.  A null id stays
    only where no row of its component has an id.
    """
    work = Workspace(docs.sparkSession, "keep")
    own = ngram_jaccard(docs, id_col, text_col, percent, width, work)
    kept = own.where(F.col("component_id").eqNullSafe(F.col(id_col)) & F.col("node").isNotNull())
    columns = docs.columns
    names = [f"__sw_c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    i, t = columns.index(id_col), columns.index(text_col)
    if own.where(F.col(id_col).isNull()).isEmpty() and own.groupBy(id_col).count().where("count > 1").isEmpty():
        # each row has an id of its own, which is enough to know it by; fewer go than stay
        gone = work.table(own.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__sw_id")), "gone")
        return plain.join(gone, plain[names[i]] == gone["__sw_id"], "left_anti").toDF(*columns)
    first = work.table(kept.groupBy(F.col("component_id").alias("__sw_id")).agg(F.min("node").alias("__sw_node")), "kept")

    def tag(batches):
        for batch in batches:
            node = [_node(s) if len(s) else None for _, found in _sets(batch.column(t), width) for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "__sw_node"])

    tagged = plain.mapInArrow(tag, T.StructType([*plain.schema.fields, T.StructField("__sw_node", T.LongType())]))
    with_words = tagged.where("__sw_node is not null")
    same = with_words[names[i]].eqNullSafe(first["__sw_id"]) & (with_words["__sw_node"] == first["__sw_node"])
    chosen = with_words.join(first, same, "left_semi").dropDuplicates([names[i], "__sw_node"]).select(*names)
    return chosen.unionByName(tagged.where("__sw_node is null").select(*names)).toDF(*columns)
