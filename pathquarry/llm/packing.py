"""Best-fit packing of documents into sequences, after Martello-Toth reduction.

Token lengths are integers up to the capacity, so the instance is a histogram
of at most `capacity` counts however many documents there are.  The driver
plans on the histogram alone: sets of up to three lengths that dominate every
other set with their largest member are fixed, as often as their counts allow;
the shrunken rest is packed best-fit, longest first.  The plan says for ranks
of each length which sequence and offset they take; pieces get their rank by
counting within tasks and adding the counts of earlier tasks.

Null or empty text is one piece holding the separator only.  Long texts are cut
into pieces of the capacity, the last one shorter.  Equal lengths are told apart
by rank, in no defined order.  Repeated rows are packed as often as they occur.
Empty input gives empty output.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._bpe import Memo, visible_bytes
from ._common import Scratch, frugal, small_batches

CAPACITY = 2048
#: The vocabulary's own split, as its file states it (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    Neither normalisation nor the split reaches across white space, so parts
    between it are memoised.  Parts of ASCII and plain Latin letters are split
    here and their words handed to the library's model; others go to the whole
    library, which also normalises them, and so do texts that hold the string of
    a special token: there it is that token, as the library has it by default.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.split = regex.compile(WORD_PATTERN)
        self.visible = {b: c for c, b in visible_bytes().items()}
        self.part = Memo(self._part)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"[\x1c-\x1f]", *map(re.escape, special)]))

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        low = part.lower()
        if part.isascii():
            words = (low,) if part.isalpha() else self.split.findall(low)
        elif _LATIN.fullmatch(part):
            words = [w.encode().decode("latin-1").translate(self.visible) for w in self.split.findall(low)]
        else:
            return self._whole(part)
        ids = [t.id for w in words for t in self.model.tokenize(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return self._whole(text) if self.odd.search(text) else b"".join(map(self.part.__getitem__, text.split()))


#: Characters that normalisation leaves alone and that have one lower-case form of their own.
_LATIN = re.compile("[\x21-\x7e\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff]*")


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank_from, rank_to, sequence, per_sequence, offset), and the number of sequences.

    Item `rank` of a length lies in sequence + (rank - rank_from) // per_sequence
    at offset + (rank - rank_from) % per_sequence * length.
    """
    left = [0] * (capacity + 2)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left[length] += n
    used, rows, opened = [0] * (capacity + 2), [], 0

    def take(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + n, sequence, per, offset))
        used[length] += n
        left[length] -= n

    def largest(most: int) -> int:
        """The greatest length there is up to most, or 0."""
        while most > 0 and not left[most]:
            most -= 1
        return max(most, 0)

    def smallest(n: int) -> list[int]:
        out, at = [], 1
        while len(out) < n and at <= capacity:
            out += [at] * min(left[at], n - len(out))
            at += 1
        return out

    def dominating(length: int) -> tuple[int, ...] | None:
        """A set with an item of this length that dominates all sets with it, if one of up to three items does."""
        space = capacity - length
        left[length] -= 1
        try:
            one = largest(space)
            low = smallest(3)
            if not one:
                return (length,)
            if one == space or len(low) < 2 or low[0] + low[1] > space:
                return (length, one)  # fills the rest, or nothing else fits beside a single item
            if len(low) < 3 or sum(low) > space:  # two more items at most
                left[one] -= 1
                two = largest(space - one)
                left[one] += 1
                above = next((x for x in range(two + 1, capacity + 1) if left[x]), capacity + 1)
                if two and 2 * above > space:
                    return (length, one, two)  # covers each single by `one`, each pair item by item
            return None
        finally:
            left[length] += 1

    for length in range(capacity, 0, -1):
        while left[length] and (found := dominating(length)):
            need = {x: found.count(x) for x in found}
            n = min(left[x] // k for x, k in need.items())
            offset = 0
            for x in dict.fromkeys(found):
                take(x, n * need[x], opened, need[x], offset)
                offset += x * need[x]
            opened += n

    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    for length in range(capacity, 0, -1):
        while n := left[length]:
            free = next((r for r in range(length, capacity + 1) if room.get(r)), 0)
            if free:
                first, many = room[free].pop()
            else:
                free, first = capacity, opened
                many = -(-n // (capacity // length))
                opened += many
            per = free // length
            full = min(many, n // per)
            if full:
                take(length, full * per, first, per, capacity - free)
                room[free - per * length].append((first, full))
            if full < many and n < (full + 1) * per and (part := left[length]):
                take(length, part, first + full, part, capacity - free)
                room[free - part * length].append((first + full, 1))
                full += 1
            if full < many:
                room[free].append((first + full, many - full))
    return rows, opened


def cut(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Pieces with their task and their rank among the task's pieces of that length."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        own, seen, task = encoder(path), [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = own.encode(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = Scratch(spark).put(cut(docs, path, capacity))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity)
    steps = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, sequence long, per_sequence long, base long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["length", "task"]).withColumn("at", F.col("rank") + F.col("earlier"))
    # The plan has a few rows for each of at most `capacity` lengths, whatever the input: safe to broadcast.
    placed = ranked.join(F.broadcast(steps), "length").where("at >= rank_from and at < rank_to")
    nth = F.col("at") - F.col("rank_from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"), (F.col("base") + nth % F.col("per_sequence") * F.col("length")).alias("offset"))
