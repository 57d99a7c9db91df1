"""Best-fit packing of tokenised documents into sequences: large items are matched in pairs, small ones fill the gaps.

The texts are tokenised in one scan. What is packed are numbers of pieces by length, of which there are at most as many as
tokens in a sequence: the packing is a list of runs, and its size depends on the capacity and not on the documents. Which
piece is the how-manieth of its length is counted in the tasks of the scan."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .common import lookup, ship, stash
from .vectors import byte_slices, hash_words

ship(__name__)
CAPACITY = 1024
#: The id after each document.
END = 2
#: Different pieces of text whose ids a task remembers; with more it starts to remember anew.
REMEMBERED = 1 << 20
#: Pieces that are handed to the tokenizer as one text.
JOINED = 1000

_code = np.arange(256)
_ALNUM = ((_code >= 48) & (_code < 58)) | ((_code >= 65) & (_code < 91)) | ((_code >= 97) & (_code < 123))
_VISIBLE = (_code > 0x20) & (_code < 0x7F)
#: First bytes of characters that are certainly not white space: of Unicode's white space beyond ASCII all start with C2, E1, E2 or E3.
_OPENS = _VISIBLE | ((_code >= 0xC3) & (_code <= 0xDF)) | (_code >= 0xE4)


def _before(data: np.ndarray, back: int) -> np.ndarray:
    out = np.zeros(len(data), np.uint8)
    out[back:] = data[: len(data) - back]
    return out


def cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 text can be cut so that the tokenizer gives the parts the ids that it gives the whole.

    The tokenizer first splits a text into runs of letters, of digits and of other signs, each with the one space before it,
    and into runs of white space; it merges inside these only. So one begins at a single space or line break between visible
    characters, behind such a line break, and at an ASCII sign behind a letter or digit."""
    one, two = _before(data, 1), _before(data, 2)
    nxt = np.zeros(len(data), np.uint8)
    nxt[:-1] = data[1:]
    inner = (one & 0xC0) == 0x80
    closed = _VISIBLE[one] | (inner & (((two >= 0xC3) & (two <= 0xDF)) | (_before(data, 3) >= 0xE4) & ((two & 0xC0) == 0x80)))
    lone = ((data == 0x20) | (data == 0x0A)) & closed & _OPENS[nxt]
    letter = _ALNUM[one] | ((two == 0xC3) & (one != 0x97) & (one != 0xB7) & inner)
    out = lone | (_VISIBLE[data] & ~_ALNUM[data] & letter)
    out[1:] |= (lone & (data == 0x0A))[:-1]
    return out


class Ids:
    """Token ids of many texts. Parts between cuts() are tokenised once as long as they are remembered, under a 64-bit hash of
    their bytes. A text that holds the string of an added token is tokenised whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # a byte-level token has a sign for each byte
        self.forget()

    def forget(self) -> None:
        self.keys, self.heads, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def learn(self, keys: np.ndarray, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remembers the ids of new parts. Parts with a space before and none at the end are tokenised many at once, as a text can
        be cut at such spaces; their ids are told apart by the bytes that they stand for."""
        plain = (data[starts] == 0x20) & (ends - starts > 1) & _OPENS[data[np.minimum(starts + 1, len(data) - 1)]] & _VISIBLE[data[ends - 1]]
        rest, many = np.flatnonzero(~plain), np.flatnonzero(plain)
        single = self.encode([raw[i:j] for i, j in zip(starts[rest], ends[rest], strict=True)])
        ids, counts = [np.array(x, np.uint32) for x in single], [np.array([len(x) for x in single], np.int64)]
        chunks = [many[k : k + JOINED] for k in range(0, len(many), JOINED)]
        for chunk, found in zip(chunks, self.encode([b"".join(raw[i:j] for i, j in zip(starts[c], ends[c], strict=True)) for c in chunks]), strict=True):
            ids.append(np.array(found, np.uint32))
            last = np.searchsorted(np.cumsum(self.bytes_of[ids[-1]]), np.cumsum(ends[chunk] - starts[chunk])) + 1
            counts.append(np.diff(last, prepend=0))
        order, counts = np.concatenate([rest, many]), np.concatenate(counts)
        heads = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, *ids])
        back = np.argsort(order)  # keys come sorted
        at = np.searchsorted(self.keys, keys)
        self.keys, self.heads, self.counts = np.insert(self.keys, at, keys), np.insert(self.heads, at, heads[back]), np.insert(self.counts, at, counts[back])

    def of(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each row's followed by `end`, and where the rows begin in them (one more than rows)."""
        raw, rows = data.tobytes(), len(offsets) - 1
        edge = cuts(data)
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(edge)
        if any(x in raw for x in self.added):
            held = [k for k in range(rows) if any(x in raw[offsets[k] : offsets[k + 1]] for x in self.added)]
            row = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~np.isin(row, held) | (starts == offsets[row])]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = hash_words(data, starts, ends, fold=False)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            fresh = first[~known]
            self.learn(keys[~known], raw, data, starts[fresh], ends[fresh])
            at = np.searchsorted(self.keys, keys)
        counts = self.counts[at][inverse]
        row = np.searchsorted(offsets, starts, "right") - 1
        per_row = np.bincount(row, counts, rows).astype(np.int64) + 1
        bounds = np.zeros(rows + 1, np.int64)
        np.cumsum(per_row, out=bounds[1:])
        out = np.full(bounds[-1], end, np.uint32)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out[np.arange(counts.sum()) + np.repeat(row, counts)] = self.ids[np.repeat(self.heads[at][inverse], counts) + inside]
        return out, bounds


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian, four bytes each; only if asked for), _block (the task), _rank (the
    how-manieth of its length in the task): a row for each piece of at most `capacity` tokens."""
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind)]).simpleString()[7:-1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, block = Ids(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                found, bounds = tokens.of(data, offsets, end)
                n = np.diff(bounds)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = (n - capacity * (parts - 1))[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                low = bounds[row] + start
                each = [found[i : i + k].astype("<u4").tobytes() for i, k in zip(low, length, strict=True)]
                order = np.argsort(length, kind="stable")
                _, firsts, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(firsts, many)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(row + a)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                columns += [pa.array(each, pa.binary())] * ids + [pa.array(np.full(len(row), block), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, "_block", "_rank"]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"{schema}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * ids}_block int, _rank long")


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places items, given as the number of items of each size: runs (size, first, n, bin, each, offset). The items first .. first + n - 1
    of a size go to the bins from `bin` on, `each` of them to a bin, one after the other from `offset` on.

    Items above a third of the capacity fit two to a bin at most. From the largest down each is matched with the largest other
    of them that fits beside it, which makes as many pairs as can be. The smaller ones enter in descending size the
    bin with the tightest gap that holds them. Bins with the same contents are moved together, so the number of runs
    depends on the sizes alone."""
    left, taken, bins, runs = dict(counts), dict.fromkeys(counts, 0), 0, []
    gaps: dict[int, list[tuple[int, int]]] = {}  # bins by what is free in them: the first of a range of bins, how many
    open_gaps: list[int] = []

    def put(size: int, n: int, at: int, each: int, offset: int) -> None:
        runs.append((size, taken[size], n, at, each, offset))
        taken[size] += n
        left[size] -= n

    def free(gap: int, at: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((at, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            k = bisect_left(large, min(size, capacity - size) + 1) - 1
            while k >= 0 and left[large[k]] < 1 + (large[k] == size):
                k -= 1
            if k < 0:
                n = left[size]
                free(capacity - size, bins, n)
                put(size, n, bins, 1, 0)
            elif large[k] == size:
                n = left[size] // 2
                free(capacity - 2 * size, bins, n)
                put(size, 2 * n, bins, 2, 0)
            else:
                n = min(left[size], left[large[k]])
                free(capacity - size - large[k], bins, n)
                put(size, n, bins, 1, 0)
                put(large[k], n, bins, 1, size)
            bins += n
        large.pop()
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(open_gaps, size)
            if k < len(open_gaps):
                gap = open_gaps[k]
                at, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            else:
                gap, at, n = capacity, bins, max(1, left[size] // (capacity // size))
                bins += n
            each = min(gap // size, left[size])
            used = min(n, left[size] // each)
            free(gap, at + used, n - used)
            free(gap - each * size, at, used)
            put(size, used * each, at, each, capacity - gap)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (only if asked for), sequence_id, offset: every document, as token ids followed by `end`,
    at its place in sequences of at most `capacity` tokens. A document longer than that is cut into pieces of `capacity`
    tokens, of which the first may be shorter.

    tokenizer: the path of a byte-level tokenizer's file, which all executors can read. A null or empty text is its `end` alone; a
    repeated row is a document of its own; doc_id is of any type and may be null; texts of any length are tokenised whole;
    an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    rows = stash(pieces(docs, tokenizer, capacity, end, ids), "packing-pieces")
    tasks = stash(rows.groupBy("_block", "length").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("_block", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = np.array(sorted(packed(counts, capacity)), np.int64).reshape(-1, 6)
    size, first, _, bin_id, each, offset = runs.T
    ladder = spark.sparkContext.broadcast((size * (1 << 44) + first, first, bin_id, each, offset))
    fields = [f for f in rows.schema.fields if not f.name.startswith("_")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, bin_id, each, offset = ladder.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy() + batch.column("_start").to_numpy()
            k = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            nth = rank - first[k]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bin_id[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * length)], [*(f.name for f in fields), "sequence_id", "offset"])

    # a row for each task and length, so joined by broadcast as long as these are few
    found = rows.join(lookup(starts, 40 * tasks.count()), ["_block", "length"])
    columns = [*(f.name for f in fields), "_rank", "_start"]
    return found.select(*columns).mapInArrow(place, StructType([*fields, *spark.range(0).selectExpr("id as sequence_id", "id as offset").schema.fields]))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of ints), length: the sequences of pack(), whole. No sequence is longer than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int32())], ["sequence_id", "ids", "length"])

    return placed.groupBy("sequence_id").agg(parts.alias("parts")).mapInArrow(read, "sequence_id long, ids array<int>, length int")
