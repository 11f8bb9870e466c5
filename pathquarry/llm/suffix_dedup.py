"""Removal of repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in
the corpus (smaller doc_id, or earlier in the same document).

Every window of LENGTH bytes is named after its least k-gram in hash order, so
equal windows have equal names.  Runs of neighbouring windows with one name are
a segment, below twice LENGTH bytes.  Names that occur once are done.  Segments
of equal text are one class, held by its first place; later places repeat it
whole.  The different texts under a name are indexed together: suffixes are
sorted to bounded depth, the transform is expanded backwards breadth-first so
that common prefixes come out by increasing length, and expansion stops at
LENGTH.  Neighbouring suffixes that are still undivided share LENGTH bytes.

A name with too many texts is split: windows are named anew by the core that
all windows of a range of places relative to the k-gram share, first for ranges
of eight places, then for single ones, where equal windows are one class.

Null text is empty.  Rows with equal doc_id and text are one document and get
the same result; rows that share a doc_id only are ordered by a hash of the
text.  Rows without doc_id count as the largest doc_id.  Texts shorter than
LENGTH stay whole.  Long texts are read in slices that overlap, so they are cut
like any other.  Empty input gives empty output.  Other columns are ignored, or
carried along where documents are returned, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import mix, pack, spans, unpack
from ._common import Scratch, frugal, of_keys, shuffle_partitions, small_batches

LENGTH, GRAM = 100, 16
REACH = LENGTH - GRAM + 1
#: Texts under one name at most, bytes indexed together at least (if there are that many), bytes hashed together.
HOT, INDEX, CHUNK = 2048, 300_000, 400_000
#: Bytes whose segments a task compares before it sends them on; segments in a batch of rows.
SENT, ROWS = 12_000_000, 50_000
#: Bins of names for each partition, up to that many bins in all; a task holds one bin at a time.
BINS, MOST_BINS = 8, 1024
PLACE = np.uint64((1 << 21) - 1)
LAST = (1 << 63) - 1

_rng = np.random.default_rng(99)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, b, dtype=np.uint64)]))
        _powers[:] = [grow(_BASE), grow(_INVERSE)]
    return _powers


class Hashed:
    """Hashes of any range of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _tables(len(data))[:2]
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])

    def of(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    words = np.ndarray(shape=(n + 8,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    return mix(words[:n] * _A + words[8 : n + 8] * _B)


def least(hashes: np.ndarray, reach: int) -> np.ndarray:
    """The place of the first least hash among each `reach` neighbours."""
    n = len(hashes) - reach + 1
    key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(key) // reach)
    grid = np.full(rows * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(key)] = key
    grid = grid.reshape(rows, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n]) & PLACE).astype(np.int64)


def segments(parts: list[bytes]):
    """(part, start, length, name, text hash) of the segments of byte strings laid end to end; none crosses their ends."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(data) < LENGTH:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)] * 2
    hashes = grams(data)
    at = least(hashes, REACH)
    change = np.zeros(len(at) + 1, dtype=np.int8)
    fits = size >= LENGTH
    np.add.at(change, begin[fits], 1)
    np.add.at(change, begin[fits] + size[fits] - LENGTH + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    mark = np.where(inside, at, -1)
    edge = np.ones(len(at), dtype=bool)
    edge[1:] = mark[1:] != mark[:-1]
    edge[begin[fits]] = True
    start = np.flatnonzero(edge)
    many = np.diff(np.append(start, len(at)))
    start, many = start[inside[start]], many[inside[start]]
    end = start + many + LENGTH - 1
    part = np.searchsorted(begin, start, side="right") - 1
    return part, start - begin[part], end - start, hashes[at[start]], Hashed(data).of(start, end)


# -- the index ------------------------------------------------------------------------------------------------------


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    order = np.argsort(key)
    ordered = key[order]
    new = np.zeros(len(key), dtype=np.int32)
    np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
    out = np.empty(len(key), dtype=np.int32)
    out[order] = new
    return out, int(new[-1]) + 1


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their first `depth` symbols (symbols up to 256), ties by place."""
    n, width = len(text), 7
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key <<= 9
        key[: max(0, n - j)] |= text[j:]
    rank, kinds = _ranks(key)
    while width < depth and kinds < n:
        np.multiply(rank, n + 1, out=key, dtype=np.int64)
        key[: max(0, n - width)] += rank[width:]
        key[: max(0, n - width)] += 1
        rank, kinds = _ranks(key)
        width *= 2
    return np.argsort(rank, kind="stable")


def divided(bwt: np.ndarray, depth: int) -> np.ndarray:
    """For rows of a transform, whether a row differs from the one before within `depth` symbols.

    Level l divides rows whose common prefix has l symbols: the interval of each
    string w found one level before is extended by every symbol c in front; the
    end of the interval of cw is a new division unless it was one already.
    """
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int32)  # row of the suffix one symbol longer
    step[order] = np.arange(n, dtype=np.int32)
    following = np.full(n, n, dtype=np.int32)  # next row with this symbol
    same = bwt[order[1:]] == bwt[order[:-1]]
    following[order[:-1][same]] = order[1:][same]
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(depth):
        row = spans(low, high - low)
        last = following[row] >= np.repeat(high, high - low)
        row = row[last]
        if level:
            row = row[bwt[row] > 0]  # nothing extends over the end of a text
        end = step[row] + 1
        end = end[~known[end]]
        if not len(end):
            break
        known[end] = True
        places = np.flatnonzero(known)
        high = end
        low = places[np.searchsorted(places, end) - 1]
    return known[:n]


def repeats(texts: list[bytes]) -> list[np.ndarray]:
    """For texts in order of their places: for each, which of its windows a text before it holds."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int16) + np.int16(1)
    begin = np.cumsum(size + 1) - size - 1
    text[begin + size] = 0
    order = bounded_suffix_order(text, LENGTH)
    group = np.cumsum(divided(text[order - 1], LENGTH), dtype=np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)
    whole = np.arange(len(text)) <= np.repeat(begin + size - LENGTH, size + 1)
    rows = np.flatnonzero(whole[order])
    place, group = order[rows], group[rows]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.minimum.reduceat(owner[place], first)
    again = np.zeros(len(text), dtype=bool)
    again[place] = owner[place] > np.repeat(earliest, np.diff(np.append(first, len(place))))
    return [again[b : b + s - LENGTH + 1] for b, s in zip(begin, size, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


# -- stages ---------------------------------------------------------------------------------------------------------

REPEAT, INDEXED, SPLIT = 0, 1, 2
_PLACES = "kind int, name long, text long, d long, t long, start long, length int"
_SLICES = _PLACES + ", bytes binary"


def _key(doc_id="doc_id", text="text") -> list:
    """What a document is known by: d orders (no doc_id: last), t tells texts apart and rows without doc_id from others."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce(text, F.lit("")), F.col(doc_id).isNull()).alias("t")]


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t, named: whether there is a doc_id, z: the compressed bytes."""
    keyed = docs.select(*_key(), F.col("doc_id").isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), b.column("named"), pa.array([z.compress(x.as_py().encode()) for x in b.column("text")], pa.binary())], ["d", "t", "named", "z"])

    return keyed.mapInArrow(frugal(run), "d long, t long, named boolean, z binary")


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Segments by bin of their name, packed; those known to repeat others need no bin and are spread."""
    keyed = docs.where(f"octet_length(text) >= {LENGTH}").select(*_key(), "text")

    def read(held):
        ds, ts, offsets, parts = zip(*held, strict=True)
        part, start, length, name, text = segments(list(parts))
        return name, text, np.array(ds, dtype=np.int64)[part], np.array(ts, dtype=np.int64)[part], start + np.array(offsets, dtype=np.int64)[part], length.astype(np.uint16)

    def blobs(found, sent):
        name, text, d, t, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
        # Of equal segments read here the first place is enough to meet others; later places are known to repeat it.
        order = np.lexsort((start, t, d, text, name))
        name, text, d, t, start, length = (x[order] for x in (name, text, d, t, start, length))
        head = np.ones(len(name), dtype=bool)
        head[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        head[1:] |= (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (start[1:] == start[:-1])  # of a repeated row
        where, out, kinds = [], [], []
        pick = np.flatnonzero(head)
        at = mix(name[pick]) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        pick, edge = pick[order], np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            o = pick[edge[k] : edge[k + 1]]
            where.append(k)
            kinds.append(INDEXED)
            out.append(pack(name[o], text[o], d[o], t[o], start[o], length[o]))
        pick = np.flatnonzero(~head)
        for lo in range(0, len(pick), ROWS):
            o = pick[lo : lo + ROWS]
            where.append(int(mix(name[o[:1]] + np.uint64(sent + lo))[0] >> np.uint64(34)))
            kinds.append(REPEAT)
            out.append(pack(name[o], text[o], d[o], t[o], start[o], length[o]))
        for lo in range(0, len(where), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 256], k) for x, k in ((where, pa.int32()), (kinds, pa.int32()), (out, pa.binary()))], ["bucket", "kind", "payload"])

    def run(batches):
        held, size, found, read_so_far, sent = [], 0, [], 0, 0
        for b in batches:
            for d, t, text in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("text"), strict=True):
                data = text.as_py().encode()
                for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):  # a long text is read in slices that share LENGTH - 1 bytes
                    part = data[at : at + CHUNK + LENGTH - 1]
                    if held and size + len(part) > CHUNK:
                        found.append(read(held))
                        read_so_far += size
                        held, size = [], 0
                    if read_so_far >= SENT:
                        yield from blobs(found, sent)
                        sent += read_so_far
                        found, read_so_far = [], 0
                    held.append((d, t, at, part))
                    size += len(part)
        if held:
            found.append(read(held))
        if found:
            yield from blobs(found, sent)

    return keyed.select("d", "t", "text").mapInArrow(frugal(run), "bucket int, kind int, payload binary")


def _rows(kind, name, text, d, t, start, length):
    columns = [pa.array(kind.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(text.view(np.int64)), pa.array(d), pa.array(t), pa.array(start), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "name", "text", "d", "t", "start", "length"])


def _places(batches):
    """kind REPEAT: a later place of a class, which goes whole; INDEXED, SPLIT: the first places of the classes under a name.

    Batches come in order of their bins; one bin is held at a time.
    """
    types = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint16)
    held, at = [], None
    for b in batches:
        for bucket, kind, blob in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("payload"), strict=True):
            columns = unpack(blob.as_py(), *types)
            if kind == REPEAT:
                yield _rows(np.full(len(columns[0]), REPEAT), *columns)
                continue
            if bucket != at:
                yield from _bin(held)
                held, at = [], bucket
            held.append(columns)
    yield from _bin(held)


def _bin(held):
    if not held:
        return
    name = np.concatenate([h[0] for h in held])
    _, place, count = np.unique(name, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    if not keep.any():
        return
    name, text, d, t, start, length = [np.concatenate(h)[keep] for h in zip(*held, strict=True)]
    order = np.lexsort((start, t, d, text, name))
    name, text, d, t, start, length = [x[order] for x in (name, text, d, t, start, length)]
    again = np.concatenate([[False], (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (start[1:] == start[:-1]) & (name[1:] == name[:-1])])  # of a repeated row
    name, text, d, t, start, length = [x[~again] for x in (name, text, d, t, start, length)]
    head = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    top = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    classes = np.add.reduceat(head.astype(np.int64), top)
    classes = np.repeat(classes, np.diff(np.append(top, len(name))))
    kind = np.where(~head, REPEAT, np.where(classes == 1, -1, np.where(classes <= HOT, INDEXED, SPLIT)))
    keep = np.flatnonzero(kind >= 0)
    for lo in range(0, len(keep), ROWS):
        p = keep[lo : lo + ROWS]
        yield _rows(kind[p], name[p], text[p], d[p], t[p], start[p], length[p])


def _sliced(places: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Places with their bytes: a document's text comes first among the rows of its key, then its places."""
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("kind", "int"), ("name", "long"), ("text", "long"), ("start", "long"), ("length", "int"))]
    both = texts.select(F.lit(0).alias("turn"), "d", "t", "z", *empty).unionByName(places.select(F.lit(1).alias("turn"), "d", "t", F.lit(None).cast("binary").alias("z"), "kind", "name", "text", "start", "length"))

    def run(batches):
        expand, key, packed, data = zstandard.ZstdDecompressor().decompress, None, b"", None
        for b in batches:
            turn, ds, ts, start, length = [b.column(c).to_pylist() for c in ("turn", "d", "t", "start", "length")]
            z, rows, out = b.column("z"), [], []
            for i, k in enumerate(turn):
                if k == 0:
                    key, packed, data = (ds[i], ts[i]), z[i].as_py(), None
                elif (ds[i], ts[i]) == key:
                    data = expand(packed) if data is None else data
                    rows.append(i)
                    out.append(data[start[i] : start[i] + length[i]])
            taken = b.take(pa.array(rows, pa.int64())).select(["kind", "name", "text", "d", "t", "start", "length"])
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(out, pa.binary())], [*taken.schema.names, "bytes"])

    return both.repartition(parts, "d", "t").sortWithinPartitions("d", "t", "turn").mapInArrow(frugal(run), _SLICES)


def _indexed(batches):
    """(d, t, start, length) of what the index finds again, from places sorted by name."""
    held: list[pa.RecordBatch] = []

    def search():
        t = pa.Table.from_batches(held)
        held.clear()
        d, key, start = (t.column(c).to_numpy() for c in ("d", "t", "start"))
        order = np.lexsort((start, key, d))
        texts = t.column("bytes").to_pylist()
        ds, ts, starts, lengths = [], [], [], []
        for i, flags in zip(order, repeats([texts[i] for i in order]), strict=True):
            if flags.any():
                a, b = runs(flags)
                ds += [d[i]] * len(a)
                ts += [key[i]] * len(a)
                starts += (start[i] + a).tolist()
                lengths += (b - a + LENGTH - 1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(ts, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32())], ["d", "t", "start", "length"])

    size, at = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("name").to_numpy()
        lengths = np.cumsum(b.column("length").to_numpy().astype(np.int64))
        lo, done = 0, 0
        for cut in [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1)]:  # a name's places stay together
            if cut == 0 and names[0] == at:
                continue
            before = int(lengths[cut - 1]) if cut else 0
            if size + before - done >= INDEX:
                if cut > lo:
                    held.append(b.slice(lo, cut - lo))
                yield search()
                size, lo, done = 0, cut, before
        held.append(b.slice(lo))
        size += int(lengths[-1]) - done
        at = names[-1]
    if held:
        yield search()


def _split(width: int):
    """Pieces of segments: windows whose place before their k-gram falls into one range, named by the core they share."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("bytes").to_pylist()
            old = b.column("name").to_numpy()
            rows, lo, hi, core_lo, core_hi = [], [], [], [], []
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            begin = np.cumsum([0, *map(len, texts)])
            hashes = grams(data)
            for i, text in enumerate(texts):
                own = hashes[begin[i] : begin[i] + len(text) - GRAM + 1]
                anchor = int(least(own[:REACH], REACH)[0])  # of the first window, and so of all
                n = len(text) - LENGTH + 1
                ranges = (anchor - np.arange(n)) // width
                edge = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
                for a, z in zip(edge, np.append(edge[1:], n), strict=True):
                    near = anchor - int(ranges[a]) * width  # last start that the range allows
                    rows.append(i)
                    lo.append(begin[i] + a)
                    hi.append(begin[i] + z - 1 + LENGTH)
                    core_lo.append(begin[i] + near)
                    core_hi.append(begin[i] + near - width + 1 + LENGTH)
            lo, hi, core_lo, core_hi = (np.array(x, dtype=np.int64) for x in (lo, hi, core_lo, core_hi))
            h, rows = Hashed(data), np.array(rows, dtype=np.int64)
            name = mix(h.of(core_lo, core_hi) + old[rows].view(np.uint64) + np.uint64(width))
            kept = [b.column(c).take(pa.array(rows)) for c in ("d", "t", "start")]
            start = kept[2].to_numpy() + lo - begin[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), SPLIT), pa.int32()), pa.array(name.view(np.int64)), pa.array(h.of(lo, hi).view(np.int64)), kept[0], kept[1], pa.array(start), pa.array((hi - lo).astype(np.int32)), pa.array([data[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())],
                ["kind", "name", "text", "d", "t", "start", "length", "bytes"],
            )

    return run


def _classes(pieces: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Later places, first places of the names that can be indexed, and of those to split further."""
    first = pieces.groupBy("name", "text").agg(F.min(F.struct("d", "t", "start")).alias("first"))
    first = scratch.put(of_keys(first))
    later = pieces.drop("bytes").join(first, ["name", "text"]).where(F.struct("d", "t", "start") != F.col("first")).select("d", "t", "start", "length")
    many = first.groupBy("name").agg(F.count("*").alias("classes")).where("classes > 1")
    heads = pieces.join(first, ["name", "text"]).where(F.struct("d", "t", "start") == F.col("first")).drop("first").join(many, "name")
    return later, heads.where(F.col("classes") <= HOT).drop("classes"), heads.where(F.col("classes") > HOT).drop("classes")


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(d, t, start, length) of repeated bytes, ranges may overlap; and the keyed, compressed documents."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    texts = _keyed(docs)
    bins = max(parts, min(BINS * parts, MOST_BINS))
    places = _packed(docs, bins).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_places), _PLACES)
    places = scratch.put(places)
    found = places.where(f"kind = {REPEAT}").select("d", "t", "start", "length")
    slices = scratch.put(_sliced(places.where(f"kind > {REPEAT}"), texts, parts))

    def search(heads: DataFrame) -> DataFrame:
        return heads.select("name", "d", "t", "start", "length", "bytes").repartition(parts, "name").sortWithinPartitions("name").mapInArrow(frugal(_indexed), "d long, t long, start long, length int")

    found = found.unionByName(search(slices.where(f"kind = {INDEXED}")))
    hot = slices.where(f"kind = {SPLIT}")
    for width in (8, 1):
        if hot.isEmpty():
            break
        pieces = scratch.put(hot.select("kind", "name", "text", "d", "t", "start", "length", "bytes").mapInArrow(frugal(_split(width)), _SLICES))
        later, heads, hot = _classes(pieces, scratch)
        found = found.unionByName(later)
        if width > 1:
            found = found.unionByName(search(heads))
    return found, texts


def _kept(data: bytes, starts: list[int], lengths: list[int], whole: bool = False) -> tuple[bytes, int, int]:
    """The bytes outside the ranges, how many went, and in how many runs; whole: ranges are widened to whole characters."""
    if not starts:
        return data, 0, 0
    change = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(change, np.array(starts), 1)
    np.add.at(change, np.array(starts) + np.array(lengths), -1)
    gone = np.cumsum(change[:-1]) > 0
    if whole:
        lead = np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80
        lead[0] = True
        at = np.flatnonzero(lead)
        gone = np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.append(at, len(gone))))
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), len(runs(gone)[0])


def _applied(docs: DataFrame, with_bytes: bool, scratch: Scratch) -> DataFrame:
    found, texts = repeated_ranges(docs, scratch)
    parts = shuffle_partitions(docs.sparkSession)
    both = found.select("d", "t", F.lit(0).alias("turn"), "start", "length", F.lit(None).cast("boolean").alias("named"), F.lit(None).cast("binary").alias("z"))
    both = both.unionByName(texts.select("d", "t", F.lit(1).alias("turn"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("length"), "named", "z"))
    names = ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        expand, key, starts, lengths = zstandard.ZstdDecompressor().decompress, None, [], []
        for b in batches:
            rows = []
            for d, t, turn, start, length, named, z in zip(*[b.column(c).to_pylist() for c in ("d", "t", "turn", "start", "length", "named")], b.column("z"), strict=True):
                if (d, t) != key:
                    key, starts, lengths = (d, t), [], []
                if turn == 0:
                    starts.append(start)
                    lengths.append(length)
                    continue
                data = expand(z.as_py())
                kept, gone, spans_ = _kept(data, starts, lengths, whole=with_bytes)
                rows.append((d if named else None, t, len(data), gone, spans_, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return both.repartition(parts, "d", "t").sortWithinPartitions("d", "t", "turn").mapInArrow(frugal(run), "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _applied(docs, False, Scratch(docs.sparkSession)).drop("key", "kept")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without repeated bytes; columns as before, n_chars follows the text.

    Characters of which a part went go whole.
    """
    scratch = Scratch(docs.sparkSession)
    changed = _applied(docs, True, scratch).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("key").alias("t"), "kept")
    changed = scratch.keep_only(scratch.put(changed)).dropDuplicates(["d", "t"])
    row = docs.select(*_key(), F.struct("*").alias("row"))  # whatever the other columns are called
    joined = row.join(changed.hint("merge"), ["d", "t"], "left")
    text = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
