"""Operator 4, n-gram Jaccard join by parity sketches.

Two texts link when ``100 * |A & B| >= threshold * |A | B|`` over their sets of 3-word
shingles. Then ``|A ^ B| <= d`` with ``d = (100-t)(|A|+|B|) / (100+t)``.

* *Bands.* A pair belongs to the band of ``|A|+|B|``; each band has one ``d``. A text joins
  the two or three bands its partners can fall into.
* *Sketch.* A band cuts the hash range into ``k`` cells; a cell's key is the XOR of its
  shingles' hashes. Differing shingles touch at most ``d`` cells, so a text with more
  than ``d`` usable cells shares at least one of them with every partner (pigeonhole), and
  one with ``d + need`` or more shares ``need``. Pairs with fewer common keys are dropped.
  Usable: not empty, and its key not shared by more than ``hot`` texts.
* *Hot keys* (passages that many texts share, large groups of copies) are not expanded.
  A text left with fewer than ``d + need`` usable cells of a band is weak there (it is
  enough that one text of a pair is not). Pairs of texts weak in their band are found by an
  exact second way: a common shingle among the first ``|A| - ceil(t|A|/100) + 1`` of each,
  in groups cut into tiles, so that no group meets in one task. Frequent shingles come last
  in the order that decides what is first, the most frequent ones at the very end, so that
  passages of many texts bring few of them together. Frequent shingles that come with the
  same other one form one group, so that a large group of near copies meets about once and
  not under each shingle it has in common. A sample of the weak texts tells which shingles
  are frequent and which go together; any order and any grouping finds all pairs, so the
  sample bears on the cost alone. A text whose partners in
  the band are all larger is minor there; minor texts meet only others, never each other,
  and only under shingles that a weak text which is not minor has among its first.
* *Parity bits.* ``4d`` bits per band hold the parity of shingles per finer cell. Their
  Hamming distance never exceeds ``|A ^ B|``; pairs beyond their own bound are dropped.
* *Verification* compares the shingle sets of what is left, near a common neighbour.

Equal sets are one class, which is compared once; copies are never expanded to pairs.
Shingles and classes are told apart by 64-bit hashes of which 48 and 64 bits are compared.

Nulls: a null text is an empty one; it has no shingle and links to nothing. A null id
counts as a document and is ignored as a smallest id. Repeated rows are documents of
their own, linked with each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, buckets, by_bucket, connected, distinct, mix, pack, smallest, texts, unpack
from .words import batches_of, shingle_hashes, words_of

#: Keys shared by more texts are not expanded into pairs.
HOT = 8
#: Texts per tile side in the exact second way and in verification.
TILE = 512
#: Waves of buckets in which keys meet, so that only a part of all keys is shuffled at a time.
WAVES = 3
#: Of so many weak classes, one tells which shingles are frequent; those met in ``FREQUENT`` of them are, at most ``KNOWN``.
SAMPLE, FREQUENT, KNOWN = 8, 4, 1 << 20
#: Groups of at most so many rows are expanded into pairs at once.
FEW = 32


class Bands:
    """Bands of ``|A|+|B|`` for a threshold in per cent: upper ends, bounds ``d``, cells ``k`` and parity bits."""

    def __init__(self, threshold: int, growth: float = 1.5):
        self.t = threshold
        ends = [2]
        while ends[-1] < 1 << 36:
            ends.append(max(ends[-1] + 1, int(ends[-1] * growth)))
        self.ends = np.array(ends, np.int64)
        self.d = (100 - threshold) * self.ends // (100 + threshold)
        self.k = (1.5 * self.d + 3 * np.sqrt(self.d) + 4).astype(np.int64)
        #: Keys that a pair must have in common.
        self.need = 1 + self.d // 16
        self.words = (4 * self.d + 63) // 64

    def of(self, total: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, total)

    def bound(self, total: np.ndarray) -> np.ndarray:
        return (100 - self.t) * total // (100 + self.t)

    def least_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-self.t * n // 100)

    def joined(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band of sets of size ``n``."""
        return self.of(n + self.least_partner(n)), self.of(n + 100 * n // self.t)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of all texts, one after the other, and where each text's begin (plus the end)."""
    h, _, _, first = words_of(column)
    sh, owner = shingle_hashes(h, first)
    key = (owner.astype(np.uint64) << np.uint64(48)) | (sh >> np.uint64(16))
    key = distinct(key)
    at = np.searchsorted(key, np.arange(len(first), dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), at


def _owners(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    data = memoryview(np.ascontiguousarray(sets)).cast("B")
    ids = [xxhash.xxh3_64_intdigest(data[8 * i : 8 * j]) if j > i else 0 for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.array(ids, np.uint64).view(np.int64)


def _cells(sets: np.ndarray, owner: np.ndarray, chosen: np.ndarray, band: np.ndarray, bands: Bands):
    """For each text of ``chosen`` (mask) in its ``band``: owner, band and key of every cell that is not empty."""
    use = chosen[owner]
    s, o = sets[use], owner[use]
    b = band[o]
    cell = ((s >> np.uint64(16)) * bands.k[b].astype(np.uint64)) >> np.uint64(32)
    run = np.ones(len(s), bool)
    run[1:] = (o[1:] != o[:-1]) | (cell[1:] != cell[:-1])
    begin = np.flatnonzero(run)
    if not len(begin):
        return o[:0], b[:0], s[:0]
    xor = np.bitwise_xor.reduceat(mix(s + np.uint64(0x9E3779B97F4A7C15)), begin)
    o, b, cell = o[begin], b[begin], cell[begin]
    return o, b, mix(xor ^ mix(cell * np.uint64(64) + b.astype(np.uint64)))


def _parity(sets: np.ndarray, at: np.ndarray, text: int, words: int) -> np.ndarray:
    """Parity bits of one text, as ``words`` 64-bit words."""
    bits = np.uint64(words * 64)
    cell = ((sets[at[text] : at[text + 1]] >> np.uint64(16)) * bits) >> np.uint64(32)
    odd = np.bincount(cell.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SIGNED = "kind int, node long, class long, n long, band int, spare int, bits array<long>, doc_id {id}, text_hash long, bucket int, payload binary"


def _sign(bands: Bands, n_buckets: int, id_type: pa.DataType, piece: int):
    """Rows of texts (kind 0), of their bands (1) and keys by bucket (2)."""
    schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("spare", pa.int32()), ("bits", pa.list_(pa.int64())), ("doc_id", id_type), ("text_hash", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = []
        for f in schema:
            x = columns.get(f.name)
            if x is None:
                x = pa.nulls(n, f.type)
            elif isinstance(x, pa.ChunkedArray):
                x = x.combine_chunks()
            elif not isinstance(x, pa.Array):
                x = pa.array(x, f.type)
            arrays.append(x.cast(f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 12
        for table in batches_of(batches, piece):
            sets, at = shingle_sets(table.column(1))
            n = np.diff(at)
            owner = _owners(at)
            classes = _class_ids(sets, at)
            node = (block << 20) + np.arange(len(n))
            yield rows(kind=np.zeros(len(n), np.int32), node=node, **{"class": classes}, n=n, doc_id=table.column(0), text_hash=table.column(2))
            # One text of a class signs for all of the block.
            lone = np.zeros(len(n), bool)
            lone[np.unique(classes, return_index=True)[1]] = True
            lone &= n > 0
            low, high = bands.joined(n)
            found, marks = [], []
            for step in range(int((high - low)[lone].max(initial=-1)) + 1):
                band = low + step
                chosen = lone & (band <= high)
                chosen &= bands.d[np.minimum(band, len(bands.d) - 1)] > 0
                o, b, key = _cells(sets, owner, chosen, band, bands)
                found.append((o, b, key))
                filled = np.bincount(o, minlength=len(n))
                marks += [(int(i), int(band[i]), int(filled[i] - bands.d[band[i]])) for i in np.flatnonzero(chosen)]
            if marks:
                i, b, spare = (np.array(x) for x in zip(*marks, strict=True))
                bits = [_parity(sets, at, x, int(bands.words[y])) for x, y in zip(i.tolist(), b.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32), np.concatenate(bits))
                yield rows(kind=np.ones(len(i), np.int32), node=node[i], **{"class": classes[i]}, n=n[i], band=b, spare=spare, bits=lists)
                o, b, key = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = key % np.uint64(n_buckets)
                # 34 bits of the key and the band, in five bytes, sorted within each bucket.
                short = ((key >> np.uint64(30)) << np.uint64(6)) | b.astype(np.uint64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
                short, o = short[order], o[order].astype(np.uint32)
                some = [x for x in range(n_buckets) if edges[x + 1] > edges[x]]
                yield rows(kind=np.full(len(some), 2, np.int32), node=np.full(len(some), block << 20), bucket=some, payload=[pack(_five(short[edges[x] : edges[x + 1]]), smallest(o[edges[x] : edges[x + 1]])) for x in some])
            block += 1

    return run


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _unfive(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def runs_to_pairs(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within runs of a sorted array."""
    left, right = [], []
    for size in np.unique(length):
        i, j = np.triu_indices(int(size), 1)
        at = begin[length == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("shared", pa.int32())])
_FOUND_SQL = "kind int, a long, b long, band int, shared int"


def _meet(hot: int):
    """One bucket of keys: pairs of texts under one key (kind 1); hot keys per text and band (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        keys = np.concatenate([_unfive(p[0]) for p in parts])
        nodes = np.concatenate([p[1].astype(np.int64) + base for p, base in zip(parts, table.column("node").to_pylist(), strict=True)])
        del parts
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.concatenate([edge, [len(keys)]]))
        few = (length > 1) & (length <= hot)
        left, right = runs_to_pairs(edge[few], length[few])
        names, number = np.unique(nodes, return_inverse=True)
        x, y = number[left], number[right]
        band = keys[left] & np.uint64(63)
        pair = np.sort((np.minimum(x, y).astype(np.uint64) << np.uint64(35)) | (np.maximum(x, y).astype(np.uint64) << np.uint64(6)) | band)
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
        shared = np.diff(np.concatenate([head, [len(pair)]]))
        pair = pair[head]
        a, b = names[(pair >> np.uint64(35)).astype(np.int64)], names[((pair >> np.uint64(6)) & np.uint64((1 << 29) - 1)).astype(np.int64)]
        keep = a != b
        many = np.repeat(length > hot, length)
        mark, count = np.unique((number[many].astype(np.uint64) << np.uint64(6)) | (keys[many] & np.uint64(63)), return_counts=True)
        columns = [
            np.concatenate([np.ones(int(keep.sum())), np.full(len(mark), 2)]),
            np.concatenate([a[keep], names[(mark >> np.uint64(6)).astype(np.int64)]]),
            np.concatenate([b[keep], np.zeros(len(mark), np.int64)]),
            np.concatenate([(pair & np.uint64(63))[keep], mark & np.uint64(63)]),
            np.concatenate([shared[keep], count]),
        ]
        return pa.Table.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


class Frequent:
    """Frequent shingles: their hashes (sorted), ranks (higher for more frequent ones, from 1) and groups (positions among them)."""

    def __init__(self, names: np.ndarray, count: np.ndarray):
        order = np.argsort(names)
        self.names = names[order]
        self.rank = np.log2(np.maximum(count[order], 1)).astype(np.int64) + 1
        self.group = np.arange(len(names))

    def place(self, sets: np.ndarray) -> np.ndarray:
        """Position among the frequent shingles, or -1."""
        if not len(self.names):
            return np.full(len(sets), -1)
        at = np.minimum(np.searchsorted(self.names, sets), len(self.names) - 1)
        return np.where(self.names[at] == sets, at, -1)

    def first(self, sets: np.ndarray, at: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``head`` shingles of each text, in order: shingle, its place, its text."""
        owner, place = _owners(at), self.place(sets)
        if (place >= 0).any():
            rank = np.where(place >= 0, self.rank[place], 0)
            order = np.argsort(owner * 64 + rank, kind="stable")
            sets, place = sets[order], place[order]
        take = np.arange(len(sets)) - at[:-1][owner] < head[owner]
        return sets[take], place[take], owner[take]


def _head_sizes(bands: Bands, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - bands.least_partner(n) + 1, 0)


def _count_shingles(piece: int):
    schema = pa.schema([("shingle", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, piece):
            names, m = np.unique(shingle_sets(table.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(m)], schema=schema)

    return run


def _count_firsts(bands: Bands, frequent: Frequent, piece: int):
    """Each frequent shingle among the first of a text, with the text's first frequent one: positions and texts."""
    schema = pa.schema([("s", pa.int64()), ("w", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, piece):
            sets, at = shingle_sets(table.column(0))
            _, place, owner = frequent.first(sets, at, _head_sizes(bands, np.diff(at)))
            place, owner = place[place >= 0], owner[place >= 0]
            _, begin, which = np.unique(owner, return_index=True, return_inverse=True)
            both, m = np.unique((place << 32) | place[begin][which], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 32), pa.array(both & 0xFFFFFFFF), pa.array(m)], schema=schema)

    return run


def _frequent(texts: DataFrame, bands: Bands, piece: int) -> Frequent:
    """From a sample of texts: the frequent shingles, each in the group of the one that most often comes first where it is among the first."""
    m = F.sum("m").alias("m")
    found = texts.mapInArrow(_count_shingles(piece), "shingle long, m long").groupBy("shingle").agg(m).where(F.col("m") >= FREQUENT).orderBy(F.desc("m"), "shingle").limit(KNOWN).toArrow()
    frequent = Frequent(found.column("shingle").to_numpy().view(np.uint64), found.column("m").to_numpy())
    if len(frequent.names):
        firsts = texts.mapInArrow(_count_firsts(bands, frequent, piece), "s long, w long, m long").groupBy("s", "w").agg(m)
        firsts = firsts.groupBy("s").agg(F.max_by("w", F.struct("m", -F.col("w"))).alias("w")).toArrow()
        frequent.group[firsts.column("s").to_numpy()] = firsts.column("w").to_numpy()
    return frequent


def _heads(bands: Bands, frequent: Frequent, piece: int):
    """Of weak texts: each of the first shingles, or the group of a frequent one, with the text's class."""
    schema = pa.schema([("shingle", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, piece):
            sets, at = shingle_sets(table.column(0))
            n = np.diff(at)
            classes = _class_ids(sets, at)
            _, first = np.unique(classes, return_index=True)
            head = np.zeros(len(n), np.int64)
            head[first] = _head_sizes(bands, n[first])
            shingle, place, o = frequent.first(sets, at, head)
            rare = place < 0
            groups = distinct((o[~rare] << 32) | frequent.group[place[~rare]])
            shingle = np.concatenate([shingle[rare], frequent.names[groups & 0xFFFFFFFF]])
            o = np.concatenate([o[rare], groups >> 32])
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(classes[o])], schema=schema)

    return run


def _tile_pairs(bands: Bands):
    """Weak texts, not both minor, that share a first shingle and whose parity bits don't rule them out."""

    def run(table: pa.Table) -> pa.Table:
        shingle, ta, tb, mine = (table.column(c).to_numpy() for c in ("shingle", "ta", "tb", "tile"))
        classes, n, band = (table.column(c).to_numpy() for c in ("class", "n", "band"))
        major = table.column("major").to_numpy()
        bits = table.column("bits").combine_chunks()
        values, off = bits.values.to_numpy().view(np.uint64), bits.offsets.to_numpy()
        order = np.lexsort((classes, band, tb, ta, shingle))
        group = np.stack([shingle[order], ta[order], tb[order], band[order]])
        edge = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        length = np.diff(np.concatenate([edge, [len(order)]]))
        few = (length > 1) & (length <= FEW) & (group[1, edge] == group[2, edge])
        x, y = (order[i] for i in runs_to_pairs(edge[few], length[few]))
        near = (major[x] | major[y]) & (bands.of(n[x] + n[y]) == band[x]) & (np.minimum(n[x], n[y]) * 100 >= bands.t * np.maximum(n[x], n[y]))
        x, y = x[near], y[near]
        names, number = np.unique(classes, return_inverse=True)
        _, once = np.unique((np.minimum(number[x], number[y]) * len(names) + np.maximum(number[x], number[y])) * 64 + band[x], return_index=True)
        x, y = x[once], y[once]
        out_a, out_b = [], []
        for b in np.unique(band[x]).tolist():
            word = np.arange(int(bands.words[b]))
            mine_x, mine_y = x[band[x] == b], y[band[x] == b]
            step = max(1, (1 << 21) // max(1, len(word)))
            for i in range(0, len(mine_x), step):
                p, q = mine_x[i : i + step], mine_y[i : i + step]
                differ = np.bitwise_count(values[off[p][:, None] + word] ^ values[off[q][:, None] + word]).sum(1, dtype=np.int64)
                good = differ <= bands.bound(n[p] + n[q])
                out_a.append(classes[p[good]])
                out_b.append(classes[q[good]])
        rest = (length > 1) & ~few
        for i, j in zip(edge[rest].tolist(), (edge + length)[rest].tolist(), strict=True):
            rows = order[i:j]
            y = int(band[rows[0]])
            width = int(bands.words[y])
            matrix = values[off[rows][:, None] + np.arange(width)]
            one_tile = ta[rows[0]] == tb[rows[0]]
            left = np.arange(len(rows)) if one_tile else np.flatnonzero(mine[rows] == ta[rows[0]])
            right = left if one_tile else np.flatnonzero(mine[rows] == tb[rows[0]])
            if len(left) > len(right):
                left, right = right, left
            size, name, large = n[rows], classes[rows], major[rows]
            for x in left[large[left]].tolist() if one_tile else left.tolist():
                others = right[(right > x) | ~large[right]] if one_tile else right
                total = size[x] + size[others]
                near = others[(bands.of(total) == y) & (np.minimum(size[x], size[others]) * 100 >= bands.t * np.maximum(size[x], size[others]))]
                if len(near):
                    differ = np.bitwise_count(matrix[near] ^ matrix[x]).sum(1, dtype=np.int64)
                    near = near[differ <= bands.bound(size[x] + size[near])]
                    out_a.append(np.full(len(near), name[x]))
                    out_b.append(name[near])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _verify(threshold: int):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        none = pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        if not len(a) or not texts.num_rows:
            return none
        parts, sizes, classes = [], [], []
        for table in batches_of(texts.to_batches(max_chunksize=2000), 6_000_000):
            sets, at = shingle_sets(table.column("text"))
            parts.append(sets)
            sizes.append(np.diff(at))
            classes.append(_class_ids(sets, at))
        sets, n, classes = np.concatenate(parts), np.concatenate(sizes), np.concatenate(classes)
        at = np.concatenate([[0], np.cumsum(n)])
        names, where = np.unique(classes, return_index=True)
        dense = np.searchsorted(distinct(sets), sets)
        mark = np.zeros(int(dense.max(initial=0)) + 1, bool)
        x, y = (where[np.minimum(np.searchsorted(names, v), len(names) - 1)] for v in (a, b))
        known = (classes[x] == a) & (classes[y] == b)
        a, b, x, y = a[known], b[known], x[known], y[known]
        order = np.argsort(x, kind="stable")
        good = np.zeros(len(x), bool)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) != 0])) if len(x) else []
        for i, j in zip(edge, [*edge[1:], len(x)], strict=True):
            rows = order[i:j]
            own = dense[at[x[rows[0]]] : at[x[rows[0]] + 1]]
            mark[own] = True
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                flat = np.concatenate([dense[at[t] : at[t + 1]] for t in y[some].tolist()])
                inter = np.add.reduceat(mark[flat].astype(np.int64), np.concatenate([[0], np.cumsum(n[y[some]])[:-1]]))
                good[some] = 100 * inter >= threshold * (len(own) + n[y[some]] - inter)
            mark[own] = False
        return pa.Table.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _with_text(source: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """Texts of the rows named by (text_hash, doc_id); each wanted row also carries ``more``."""
    w = wanted.select(F.col("text_hash").alias("w_hash"), F.col("doc_id").alias("w_id"), *more)
    on = (source.text_hash == w.w_hash) & source.doc_id.eqNullSafe(w.w_id)
    return source.join(w.hint("shuffle_hash"), on, "left_semi" if not more else "inner")


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 70, hot: int = HOT, piece: int = 6_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join itself: members (node, doc_id, n, class), links between classes (a, b), and classes (class, size, min_id).

    ``links`` has each pair of different, linked sets once, ``a < b``. Classes of size one
    without links are not listed in ``classes``' joins but have their row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ws, nb, bands = Workspace(spark, "jaccard"), buckets(spark), Bands(threshold)
    n_keys = nb * WAVES
    source = texts(docs, doc_id, text).toDF("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType
    signed = ws.write(source.mapInArrow(_sign(bands, n_keys, to_arrow_type(kind), piece), _SIGNED.format(id=kind.simpleString())), "signed", "kind")
    keys = signed.where("kind = 2").select("node", "bucket", "payload")
    found = None
    for wave in range(WAVES):
        part = by_bucket(keys.where(F.col("bucket") % WAVES == wave), nb, F.floor(F.col("bucket") / WAVES)).applyInArrow(_meet(hot), _FOUND_SQL)
        part = ws.write(part, f"found-{wave}", "kind")
        found = part if found is None else found.union(part)
    ws.drop("signed/kind=2")
    marks = signed.where("kind = 1").select("node", "class", "n", "band", "spare", "bits")
    members = signed.where("kind = 0").select("node", "doc_id", "n", "class", "text_hash")
    classes = ws.write(members.where("n > 0").groupBy("class").agg(F.count("*").alias("size"), F.min("doc_id").alias("min_id"), F.min_by(F.struct("text_hash", "doc_id"), "node").alias("one")).select("class", "size", "min_id", "one.*"), "classes")

    # Pairs under keys that are not hot; parity bits decide who stays.
    left = marks.select(F.col("node").alias("a"), "band", F.col("class").alias("ca"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = marks.select(F.col("node").alias("b"), "band", F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    total = F.col("na") + F.col("nb")
    differ = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    need = F.element_at(F.array(*[F.lit(int(x)) for x in bands.need]), F.col("band") + 1)
    pairs = found.where("kind = 1").groupBy("a", "b", "band").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= need).drop("shared").join(left, ["a", "band"]).join(right, ["b", "band"]).where("ca <> cb")
    pairs = pairs.where((F.least("na", "nb") * 100 >= threshold * F.greatest("na", "nb")) & (differ <= F.floor((100 - threshold) * total / (100 + threshold))))
    pairs = pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))

    # Weak texts among themselves.
    lost = found.where("kind = 2").groupBy(F.col("a").alias("node"), "band").agg(F.sum("shared").alias("lost"))
    lower = F.element_at(F.array(*[F.lit(int(x)) for x in (0, *bands.ends)]), F.col("band") + 1)
    weak = marks.join(lost, ["node", "band"], "left").where(F.col("spare") - F.coalesce("lost", F.lit(0)) < need).select("class", "n", "band", (2 * F.col("n") > lower).alias("major")).distinct()
    weak = ws.write(weak, "weak")
    weak_texts = ws.write(_with_text(source, classes.join(weak.select("class").distinct(), "class"), "class").select("class", "text"), "weak-texts")
    frequent = _frequent(weak_texts.where(F.pmod("class", F.lit(SAMPLE)) == 0).select("text"), bands, piece)
    heads = weak_texts.select("text").mapInArrow(_heads(bands, frequent, piece), "shingle long, class long").distinct()
    heads = ws.write(heads, "heads")
    ws.drop("weak-texts")
    heads = heads.join(weak, "class")
    majors, m = F.count_if("major"), F.count("*")
    # Tiles of texts that are not minor, and of minor ones where they don't fit into the one tile of the others.
    groups = heads.groupBy("shingle", "band").agg(majors.alias("majors"), m.alias("m")).where("m > 1 and majors > 0")
    groups = groups.select("shingle", "band", F.ceil(F.col("majors") / TILE).cast("int").alias("tiles"), F.when(F.col("m") > TILE, F.ceil((F.col("m") - F.col("majors")) / TILE)).otherwise(0).cast("int").alias("more"))
    first = F.col("major") | (F.col("more") == 0)
    place = F.xxhash64("class")
    tiled = heads.join(groups, ["shingle", "band"]).withColumn("tile", F.when(first, F.pmod(place, F.col("tiles"))).otherwise(-1 - F.pmod(place, F.greatest("more", F.lit(1)))).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.when(first, -F.col("more")).otherwise(0), F.col("tiles") - 1)))
    tiled = tiled.select("shingle", "class", "n", "band", "major", "tile", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), (F.col("tiles") + F.col("more")).alias("tiles"))
    bits = marks.join(weak.select("class", "band"), ["class", "band"], "left_semi").select("class", "band", "bits").dropDuplicates(["class", "band"])
    tiled = tiled.join(bits, ["class", "band"]).withColumn("task", F.when(F.col("tiles") == 1, F.pmod("shingle", F.lit(4 * nb))).otherwise(F.xxhash64("shingle", "ta", "tb")))
    more = tiled.groupBy("task").applyInArrow(_tile_pairs(bands), "a long, b long")
    candidates = ws.write(pairs.union(more).distinct(), "candidates")
    for table in (*[f"found-{w}" for w in range(WAVES)], "signed/kind=1", "heads", "weak"):
        ws.drop(table)

    # Verify near a common neighbour, so that a text travels once per neighbourhood.
    ends = candidates.select("a", "b").union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b")))
    centre = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("centre"))
    crowd = centre.groupBy("centre").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = lambda c: F.pmod(F.xxhash64(F.col(c)), F.col("tiles"))
    placed = candidates.join(centre, "a").join(crowd, "centre").withColumn("task", F.when(F.col("tiles") == 1, F.pmod("centre", F.lit(4 * nb))).otherwise(F.xxhash64("centre", tile("a"), tile("b")))).select("task", "a", "b")
    placed = ws.write(placed, "placed")
    visits = placed.select("task", F.col("a").alias("class")).union(placed.select("task", F.col("b").alias("class"))).distinct()
    shipped = _with_text(source, visits.join(classes, "class"), "task").select(F.col("task").alias("place"), "text")
    links = placed.groupBy("task").cogroup(shipped.groupBy("place")).applyInArrow(_verify(threshold), "a long, b long")
    links = ws.write(links, "links")
    ws.drop("candidates")
    ws.drop("placed")
    return members, links, classes


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 70, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, n_similar (other rows linked directly), component_id (smallest id reachable)."""
    spark = docs.sparkSession
    members, links, classes = similar_texts(docs, doc_id, text, threshold, **options)
    ws = Workspace(spark, "components")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("class").alias("b"), "size")
    around = both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("around"))
    roots = connected(spark, links, ws, "classes").select(F.col("node").alias("class"), "root")
    least = roots.join(classes, "class").groupBy("root").agg(F.min("min_id").alias("least_id"))
    linked = roots.join(least, "root").select("class", "least_id")
    facts = classes.select("class", "size", "min_id").join(around, "class", "left").join(linked, "class", "left")
    facts = facts.where("size > 1 or around is not null").select("class", (F.col("size") - 1 + F.coalesce("around", F.lit(0))).alias("n_similar"), F.coalesce("least_id", "min_id").alias("component_id"))
    facts = ws.write(facts, "facts")
    out = members.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(facts, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 70) -> DataFrame:
    """The rows of ``docs`` that remain when of each group of linked documents the one with the smallest id stays.

    Rows are kept or dropped by id: rows of equal id (or of null id) stand or fall together. Columns are those of ``docs``.
    """
    groups = similar_groups(docs, doc_id, text, threshold).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(groups.hint("shuffle_hash"), docs[f"`{doc_id}`"].eqNullSafe(groups["__kept_id"]), "left_semi")


def op4_jaccard_groups(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
