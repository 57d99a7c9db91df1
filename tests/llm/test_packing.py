"""Packing: ids against the tokenizer on whole texts, places against the capacity, numbers of sequences against item by item."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from worksight.llm import packing, queries
from worksight.llm.vectors import byte_slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a b\n\nc  d e", " x y　 z", "don't he'll 'tis, a,b;c × ,x× y", "a<|endoftext|> b, c", "", None, "\n", "x\n", "ü ß\n×, ", "12,3.4 a\tb \n c", "日本 語、 か な", "\x1c a \x85b\n\r\nc"]


def whole(texts):
    return [x.ids + [2] for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizer_on_whole_texts(monkeypatch):
    rng = random.Random(1)
    letters = "ab1 ,.'é×\n\t   ß語か-'st <|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(5000)]
    monkeypatch.setattr(packing, "REMEMBERED", 2000)
    monkeypatch.setattr("worksight.llm.vectors.SLICE_BYTES", 10_000)
    ids, got = packing.Ids(PATH), []
    for a, b, data, offsets in byte_slices(pa.array(texts)):
        found, bounds = ids.of(data, offsets, 2)
        got += [found[bounds[k] : bounds[k + 1]].tolist() for k in range(b - a)]
    assert got == whole(texts)


def item_by_item(sizes, capacity):
    """The same rule for one item after another, with a scan of all bins."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        fit = [b for b in large if a + b <= capacity]
        bins.append([a, *fit[:1]])
        if fit:
            large.remove(fit[0])
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fit = [b for b in bins if sum(b) + s <= capacity]
        if fit:
            max(fit, key=sum).append(s)
        else:
            bins.append([s])
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_runs_fill_bins_as_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100])
    sizes = [rng.randint(1, rng.choice([capacity, capacity // 3, capacity // 2])) for _ in range(rng.randrange(0, 300))]
    runs = packing.packed(dict(Counter(sizes)), capacity)
    bins, ranks = defaultdict(list), defaultdict(list)
    for size, first, n, at, each, offset in runs:
        ranks[size] += range(first, first + n)
        for k in range(n):
            bins[at + k // each].append((offset + k % each * size, size))
    assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()}
    for own in bins.values():
        place = 0
        for offset, size in sorted(own):
            assert offset == place
            place += size
        assert place <= capacity
    assert sorted(sum(s for _, s in b) for b in bins.values()) == sorted(map(sum, item_by_item(sizes, capacity)))


def test_query_covers_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = dict(zip(docs, whole(docs.values()), strict=True))
    rows = queries.op13_packing(spark, "/root/testdata/sf0.01").collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert own.keys() == ids.keys()
    for doc, parts in own.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts[:-1])]).tolist()
        assert all(r["length"] == 1024 for r in parts[1:]) and sum(r["length"] for r in parts) == len(ids[doc])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[doc][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.01 * sum(map(len, ids.values())) / 1024 + 1


def test_odd_rows_and_whole_sequences(spark):
    texts = [*ODD, *["same text"] * 50, "long " * 30_000]
    docs = spark.createDataFrame([(str(k) if k else None, t, 1, 2) for k, t in enumerate(texts)], "doc_id string, text string, length int, _rank int").repartition(5)
    placed = packing.pack(docs, PATH, capacity=64)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    want, found = dict(enumerate(whole(texts))), defaultdict(list)
    for r in placed.orderBy("start").collect():
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == part
        found[int(r["doc_id"] or 0)] += part
    assert found == want and max(map(len, made.values())) <= 64
    assert packing.pack(docs.limit(0), PATH).count() == 0
