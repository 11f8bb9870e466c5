"""Near-duplicate documents: Jaccard join of word shingles by count vectors.

Shingles are hashed into groups, and a document is the point of its counts by
group.  The overlap of two documents is at most the sum of the smaller counts,
so a tree of bounding corners over the points discards pairs and whole nodes;
pairs that survive are verified on the full sets.

The number of groups grows with the set, in powers of four that nest.  A tree
over all documents would still compare most nodes with each other: documents of
one size lie about as far apart as links may reach in any few groups.  Hence documents meet in
trees of bounded size: once among those that share a shingle of their prefix
(two sets of similarity 0.8 must share one of the fifth that comes first in any
fixed order; here frequent shingles come last), where bounds alone decide which
documents may belong together, and once among the documents of such a candidate
component, where links are verified.

Larger groups of a shingle are cut into blocks, and each pair of blocks is a
group.  A large candidate component is cut into chunks that are verified apart,
each with the same few pivots; only documents outside its largest class so far
meet the other chunks.

Copies (equal sets) are one point throughout.  Null text and texts without
words have the empty set and link with nothing, and so do rows without doc_id
(their component_id is null).  Long texts are hashed whole.  Repeated rows give
repeated rows.  Empty input gives empty output.  Other columns are ignored, or
carried along where documents are returned, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import mix, pack, spans, unpack
from ._common import Scratch, frugal, of_keys, shuffle_partitions, small_batches
from .graph import components

#: Least number of groups, and members of a set for each group at most.
WORDS, GROUPS, PER_GROUP = 5, 64, 10
#: Points in a tree at most, shingles of the documents verified in one group at most, and documents that all chunks of a component meet.
POINTS, SHINGLES, PIVOTS = 2048, 4_000_000, 16
#: Characters hashed at a time, and prefix shingles packed together.
CHUNK, PACKED = 1_000_000, 400_000
#: Frequent shingles that prefixes put last, at most, and the documents of a task that must hold one.
FREQUENT, HELD = 4096, 4
#: Bins of shingles for each partition, up to that many bins in all; a task holds one bin at a time.
BINS, MOST_BINS = 8, 1024
#: Bits of the filter for candidates, in words of 64: a broadcast of a fixed size.
FILTER_WORDS = 1 << 16
SIGN = np.uint64(1 << 63)

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)]))
        _powers[:] = [grow(_BASE), grow(_INVERSE)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts = [t.encode().lower() for t in texts]
    size = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    up, down = _power_tables(len(data))
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum(size) - size)
    last = np.append(first[1:], len(start))
    n = len(hashes)
    long = sum(hashes[k : max(0, n - WORDS + 1) + k] * _PLACE[k] for k in range(WORDS)) if n >= WORDS else np.zeros(0, np.uint64)
    long = mix(long)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(long[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def chunks(texts: list[str]):
    """Index ranges of some text at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def set_hash(s: np.ndarray) -> np.int64:
    return np.array([mix(s ^ SIGN).sum() + np.uint64(len(s))], dtype=np.uint64).view(np.int64)[0]


def resolution(n: int) -> int:
    """Groups for a set of n: unrelated sets differ in more than similar ones may only if groups hold few of them."""
    groups = GROUPS
    while groups * PER_GROUP < n:
        groups *= 4
    return groups


def counts(s: np.ndarray) -> np.ndarray:
    """Counts by leading bits of the hash, so that neighbours add up to the counts of a coarser resolution."""
    groups = resolution(len(s))
    while True:
        found = np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
        if found.max(initial=0) < 256:
            return found.astype(np.uint8)
        groups *= 4


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def leading(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix of a set: its members in order of their hash, but the frequent ones last, the most frequent at the end."""
    k = prefix(len(s))
    if not len(frequent):
        return s[:k]
    by_value = np.argsort(frequent)
    ordered = frequent[by_value]
    for part in (s[: 2 * k], s):
        at = np.minimum(np.searchsorted(ordered, part), len(ordered) - 1)
        often = ordered[at] == part
        if len(part) - int(often.sum()) >= k:
            return part[~often][:k]
    rank = by_value[at[often]]
    return np.concatenate([s[~often], s[often][np.argsort(-rank)]])[:k]


def enough(a, b):
    """The least overlap that sets of these sizes need: 100 * o >= 80 * (a + b - o)."""
    return -(-4 * (a + b) // 9)


class CountTree:
    """Points packed by size into nodes of FAN, nodes into nodes above, each with its upper corner and sizes."""

    FAN = 32

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points, self.levels = sizes, points, []
        low = high = sizes
        corner = points
        while len(low) > self.FAN:
            cut = np.arange(0, len(low), self.FAN)
            low, high, corner = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(corner, cut, axis=0)
            self.levels.append((low, high, corner))

    def near(self, i: int) -> np.ndarray:
        """Points after i whose bound reaches what a link with i needs."""
        own, size = self.points[i], int(self.sizes[i])
        most = size * 5 // 4
        at = None
        for low, high, corner in reversed(self.levels):
            at = np.arange(len(low)) if at is None else spans(at * self.FAN, np.minimum(self.FAN, len(low) - at * self.FAN))
            fit = (low[at] <= most) & (high[at] >= size)
            at = at[fit]
            at = at[np.minimum(corner[at], own).sum(axis=1) >= enough(size, np.maximum(low[at], size))]
        n = len(self.sizes)
        at = np.arange(n) if at is None else spans(at * self.FAN, np.minimum(self.FAN, n - at * self.FAN))
        at = at[(at > i) & (self.sizes[at] <= most)]
        return at[np.minimum(self.points[at], own).sum(axis=1) >= enough(size, self.sizes[at])]


def join(sizes: np.ndarray, points: list[np.ndarray], verified) -> np.ndarray:
    """Labels of the components of verified(i, j) over points in order of size; pairs within a component are skipped.

    Each resolution has a tree of its points and of finer ones near in size, which are summed up to it.
    """
    label, groups = np.arange(len(sizes)), np.array([len(x) for x in points])
    for g in np.unique(groups):
        own = groups == g
        near = (groups > g) & (sizes <= sizes[own].max() * 5 // 4) & (sizes >= sizes[own].min() * 4 // 5)
        at = np.flatnonzero(own | near)
        tree = CountTree(sizes[at], np.stack([points[i].reshape(g, -1).sum(axis=1, dtype=np.int32) for i in at]))
        for k, i in enumerate(at[:-1]):
            if (label[at[k + 1 :]] == label[i]).all():
                continue
            for j in at[tree.near(k)]:
                if label[j] != label[i] and (own[i] or own[j]) and verified(i, j):
                    label[label == label[j]] = label[i]
    return label


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


# -- stages ---------------------------------------------------------------------------------------------------------

_SETS = "kind int, bucket int, doc_id long, n long, h long, vec binary, payload binary"


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles in most documents, most frequent first, FREQUENT at most; they only order prefixes, so any list gives right results."""

    def run(batches):
        keys, ns, seen = [], [], set()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                sets = [s for s in shingle_sets(texts[lo:hi]) if len(s) and (h := int(set_hash(s))) not in seen and not seen.add(h)]
                if sets:
                    key, n = np.unique(np.concatenate(sets), return_counts=True)
                    keys.append(key[n > 1])
                    ns.append(n[n > 1])
            if sum(map(len, keys)) > 4 * PACKED:
                key, n = _summed(keys, ns)
                top = np.argsort(-n, kind="stable")[:PACKED]
                keys, ns = [key[top]], [n[top]]
        if keys:
            key, n = _summed(keys, ns)
            top = np.argsort(-n, kind="stable")[:FREQUENT]
            top = top[n[top] >= HELD]
            yield pa.RecordBatch.from_arrays([pa.array(key[top].view(np.int64)), pa.array(n[top].astype(np.int64))], ["key", "n"])

    found = docs.select("text").mapInArrow(frugal(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], dtype=np.int64).view(np.uint64)


def _summed(keys, ns):
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(ns), minlength=len(key)).astype(np.int64)


def _read(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """kind 0: a row for each document with its set's hash and count vector; kind 1: packed prefix shingles by bin."""
    names = ["kind", "bucket", "doc_id", "n", "h", "vec", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def packed(keys, head_h, head_n):
        size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        key, own = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.uint32), size)
        at = mix(key) % np.uint64(buckets)
        order = np.lexsort((key, at))
        key, own, at = key[order], own[order], at[order]
        edge = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
        head_h, head_n = np.array(head_h, dtype=np.int64), np.array(head_n, dtype=np.int64)
        rows = []
        for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            used, local = np.unique(own[edge[k] : edge[k + 1]], return_inverse=True)
            rows.append((1, k, None, 0, 0, None, pack(key[edge[k] : edge[k + 1]], local.astype(np.uint32), head_h[used], head_n[used])))
        for lo in range(0, len(rows), 256):
            yield batch(rows[lo : lo + 256])

    def run(batches):
        seen = set()  # sets that this task has sent
        keys, head_h, head_n, held = [], [], [], 0
        for b in batches:
            ids, texts, rows = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()], []
            for lo, hi in chunks(texts):
                for doc, s in zip(ids[lo:hi], shingle_sets(texts[lo:hi]), strict=True):
                    h = set_hash(s) if len(s) else np.int64(0)
                    rows.append((0, 0, doc, len(s), int(h), counts(s).tobytes(), None))
                    if len(s) and doc is not None and h not in seen:
                        seen.add(h)
                        keys.append(leading(s, frequent))
                        head_h.append(h)
                        head_n.append(len(s))
                        held += len(keys[-1])
                if held > PACKED:
                    yield from packed(keys, head_h, head_n)
                    keys, head_h, head_n, held = [], [], [], 0
            yield batch(rows)
        if keys:
            yield from packed(keys, head_h, head_n)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), _SETS)


def _groups(batches):
    """(gid, h, n) of the sets that share a prefix shingle; groups of the same members are given once a bin.  Batches come in order of their bins."""
    held, at = [], None
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("payload"), strict=True):
            if bucket != at:
                yield from _bin(held)
                held, at = [], bucket
            held.append(unpack(blob.as_py(), np.uint64, np.uint32, np.int64, np.int64))
    yield from _bin(held)


def _bin(held):
    keys, hs, ns = [x[0] for x in held], [x[2][x[1]] for x in held], [x[3][x[1]] for x in held]
    if not keys:
        return
    key, h, n = np.concatenate(keys), np.concatenate(hs), np.concatenate(ns)
    del keys, hs, ns
    order = np.lexsort((h, n, key))
    key, h, n = key[order], h[order], n[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
    key, h, n = key[new], h[new], n[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    sign = np.add.reduceat(mix(h.view(np.uint64)), start) + size.astype(np.uint64)
    start, size, sign = start[size > 1], size[size > 1], sign[size > 1]
    sign, once = np.unique(sign, return_index=True)
    start, size = start[once], size[once]
    small = size <= POINTS

    def batch(gid, at):
        return pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), pa.array(h[at]), pa.array(n[at])], ["gid", "h", "n"])

    where = np.flatnonzero(small)
    for lo in range(0, len(where), 50_000):
        part = where[lo : lo + 50_000]
        yield batch(np.repeat(sign[part], size[part]), spans(start[part], size[part]))
    for g in np.flatnonzero(~small):  # in order of size, so that blocks far apart cannot link
        cut = np.arange(start[g], start[g] + size[g], POINTS // 2)
        ends = np.append(cut[1:], start[g] + size[g])
        for i in range(len(cut)):
            for j in range(i, len(cut)):
                if j > i + 1 and n[cut[j]] > n[ends[i] - 1] * 5 // 4:
                    break
                if j > i or len(cut) == 1:
                    at = np.concatenate([np.arange(cut[i], ends[i]), np.arange(cut[j], ends[j])])
                    yield batch(mix(np.full(len(at), sign[g] + np.uint64(i * len(cut) + j), dtype=np.uint64)), at)


def _runs(batches, columns: list[str], key: str):
    """Rows of one key after the other, from batches sorted by it: (key, list of columns)."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
            if held and keys[lo] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[lo]
            held.append(b.slice(lo, hi - lo).select(columns))
    if held:
        yield at, pa.Table.from_batches(held)


def _edges(batches):
    """(u, v): a spanning forest of the pairs in each group that the bounds allow."""
    us, vs = [], []

    def out():
        b = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
        us.clear()
        vs.clear()
        return b

    for _, t in _runs(batches, ["h", "n", "vec"], "gid"):
        h, n = t.column("h").to_numpy(), t.column("n").to_numpy()
        keep = np.concatenate([[True], h[1:] != h[:-1]])
        if keep.sum() < 2:
            continue
        vec = [np.frombuffer(v, dtype=np.uint8) for v, k in zip(t.column("vec").to_pylist(), keep, strict=True) if k]
        h, n = h[keep], n[keep]
        label = join(n, vec, lambda i, j: True)
        for i in np.flatnonzero(label != np.arange(len(label))):
            us.append(int(h[label[i]]))
            vs.append(int(h[i]))
        if len(us) > 50_000:
            yield out()
    yield out()


def _links(batches):
    """(u, v): a spanning forest of the verified links in each group of documents."""
    expand = zstandard.ZstdDecompressor().decompress
    for _, t in _runs(batches, ["h", "z"], "gid"):
        texts = [expand(z).decode() for z in t.column("z").to_pylist()]
        sets: dict[int, np.ndarray] = {}
        wanted = t.column("h").to_pylist()
        for lo, hi in chunks(texts):
            for h, s in zip(wanted[lo:hi], shingle_sets(texts[lo:hi]), strict=True):
                if len(s) and int(set_hash(s)) == h:
                    sets[h] = s
        order = sorted(sets, key=lambda h: (len(sets[h]), h))
        own = [sets[h] for h in order]
        n = np.array([len(s) for s in own], dtype=np.int64)
        if len(own) < 2:
            continue
        label = join(n, [counts(s) for s in own], lambda i, j: overlap(own[i], own[j]) >= enough(n[i], n[j]))
        rest = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array([order[label[i]] for i in rest], pa.int64()), pa.array([order[i] for i in rest], pa.int64())], ["u", "v"])


def _compressed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and compressed text of the wanted documents and few others.

    The wanted ids set bits in a filter of fixed size, which is broadcast; what
    it lets through beyond them is left to the join that follows.
    """

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([z.compress((t.as_py() or "").encode()) for t in b.column("text")], pa.binary())], ["doc_id", "z"])

    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_WORDS * 64))
    word, own = F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))")
    bits = wanted.select("doc_id").withColumn("bit", bit).select(word, own.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    named = docs.where("doc_id is not null").select("doc_id", "text").withColumn("bit", bit).withColumn("word", word)
    through = named.join(F.broadcast(bits), "word").where(F.col("mask").bitwiseAND(own) != 0)
    return through.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, z binary")


def _verified(docs: DataFrame, maybe: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the components of verified links among (h, rep, n, root) of candidate components.

    Documents of a component of bounded size meet once.  A larger one is cut into
    chunks; each meets the component's PIVOTS, so that copies of one text are one
    class after that.  Then documents outside the largest class meet all chunks.
    """
    parts = shuffle_partitions(docs.sparkSession)
    sizes = maybe.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    many = F.greatest(F.ceil(F.col("total") / F.lit(SHINGLES // 2)), F.ceil(F.col("docs") / F.lit(POINTS)))
    sizes = sizes.select("root", F.when((F.col("total") <= SHINGLES) & (F.col("docs") <= 2 * POINTS), F.lit(1)).otherwise(many).cast("long").alias("chunks"), "docs")
    member = maybe.join(sizes.hint("merge"), "root").select("root", "h", F.col("rep").alias("doc_id"), "docs", "chunks", F.pmod(F.xxhash64("h"), F.col("chunks")).alias("chunk"))
    member = scratch.put(of_keys(member))
    large = member.where("chunks > 1")
    alone = large.isEmpty()
    texts = _compressed(docs, member)
    texts = texts if alone else scratch.put(texts)

    def links(met: DataFrame) -> DataFrame:
        with_text = met.select("h", "doc_id", "gid").hint("merge").join(texts, "doc_id")
        return with_text.repartition(parts, "gid").sortWithinPartitions("gid").mapInArrow(frugal(_links), "u long, v long")

    if alone:
        return components(links(member.select("h", "doc_id", F.xxhash64("root", "chunk").alias("gid"))), scratch)
    some = F.pmod(F.xxhash64("h", F.lit(1)), F.ceil(F.col("docs") / F.lit(4 * PIVOTS))) == 0  # so many that PIVOTS are among them, at any size
    least = large.where(some).groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.struct("h", "doc_id"))), 1, PIVOTS).alias("pivots"), F.max("chunks").alias("chunks"))
    pivots = least.select("root", "chunks", F.explode("pivots").alias("p")).select("root", "p.h", "p.doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    met = member.select("root", "h", "doc_id", "chunk").unionByName(pivots.select("root", "h", "doc_id", "chunk")).withColumn("gid", F.xxhash64("root", "chunk"))
    found = scratch.put(of_keys(links(met).distinct()))
    label = components(found, scratch).withColumnRenamed("node", "h").withColumnRenamed("root", "label")
    large = scratch.put(large.join(label.hint("merge"), "h", "left").withColumn("label", F.coalesce("label", "h")))
    classes = large.groupBy("root", "label").agg(F.count("*").alias("n"))
    top = classes.groupBy("root").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    top = top.select("root", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / F.lit(POINTS)).alias("others")).where("others > 0")
    rest = large.join(top.hint("merge"), "root").withColumn("other", F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("h", F.lit(2)), F.col("others"))))
    around = rest.select("h", "doc_id", "root", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"))
    outside = rest.where("other is not null").select("h", "doc_id", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "other")
    met = around.unionByName(outside).withColumn("gid", F.xxhash64("root", "chunk", "other", F.lit(3)))
    return components(found.unionByName(links(met)), scratch)


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; scratch: where its tables go, if the caller removes them."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    scratch = scratch or Scratch(spark)
    bins = max(parts, min(BINS * parts, MOST_BINS))
    read = scratch.put(_read(docs, bins, frequent_shingles(docs.where("doc_id is not null"))))
    rows = read.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "h", "vec")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    # A point for each set; a set's vector is the same in each of its rows.
    points = known.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    groups = read.where("kind = 1").select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_groups), "gid long, h long, n long")
    groups = scratch.put(groups)
    # None of these sides has a bound, so none is broadcast, however small it looks.
    vectors = known.join(points.select("h", "rep").hint("merge"), "h").where("doc_id = rep").select("h", "vec").join(groups.select("h").distinct().hint("merge"), "h", "left_semi").dropDuplicates(["h"])
    met = groups.join(vectors.hint("merge"), "h").repartition(parts, "gid").sortWithinPartitions("gid", "n", "h")
    maybe = components(met.mapInArrow(frugal(_edges), "u long, v long"), scratch)
    # Candidate components: their documents meet again.
    maybe = scratch.put(of_keys(maybe.withColumnRenamed("node", "h").join(points.hint("merge"), "h")))
    labels = _verified(docs, maybe, scratch)
    labelled = rows.select("doc_id", "n_shingles", "h").join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    lowest = labelled.where("n_shingles > 0 and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    whole = labelled.join(lowest, "root", "left")
    return whole.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """Of each component the document with the smallest doc_id, then text hash; columns as before.

    A document is a doc_id with a text: other texts under the same doc_id are
    judged by themselves, and rows that repeat both stay together.  Rows without
    doc_id stay, or with `unnamed` take part, after all others; of those with
    equal texts one stays.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64("doc_id", F.xxhash64(text))
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", text.alias("text"), (key if unnamed else F.when(F.col("doc_id").isNotNull(), key)).alias("key"))
    linked = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), scratch).where("doc_id <> component_id")
    linked = scratch.keep_only(scratch.put(of_keys(linked.select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")).distinct())))
    linked = linked.unionByName(linked.select(F.col("root").alias("key"), "root").distinct())
    # Keys are hashes, so the document that stays is found by what they stand for.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    met = scratch.put(of_keys(keyed.select("key", order.alias("at")).join(linked.hint("merge"), "key")))
    least = met.groupBy("root").agg(F.min("at").alias("least"))
    gone = met.join(least.hint("merge"), "root").where("at <> least").select("key").distinct()
    kept = keyed.join(gone.hint("merge"), "key", "left_anti")
    if unnamed:
        alone = F.col("doc_id").isNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(~alone).unionByName(kept.where(alone).dropDuplicates(["text"]))
    return kept.select("row.*")
