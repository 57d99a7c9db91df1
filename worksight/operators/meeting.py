"""Works that meet inside of tasks: texts, facts and places of two sides are compared as arrays, and only pairs that may reach a score leave the task.

A side is a record batch or table with the columns of SIDE; a work's terms stand rarest first, so that what two works have in common begins with
their rarest common term, at which alone they meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..schemas import DUPLICATE_TRIGGER, GEO_MAX_M, SCORE_WEIGHTS, TEXT_TRIGGER
from ..tasks import ship

ship(__name__)

#: The columns of a side. ds: the dataset as a hash; category: as a hash, 0 for none; terms, ws: the vector, of any length.
SIDE = ("dataset_id", "id", "lost", "f", "ds", "lat", "lon", "cost", "category", "begins", "ends", "terms", "ws")
#: Pairs that are looked at, and terms that are compared, at once.
LOOKS, COMPARED = 1 << 20, 1 << 20
#: What rounding may take from a bound.
SLACK = 1e-6


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of `counts` places from `starts` on: of each place its run and itself."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def portions(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose counts sum up to `most` about; a count above it is alone."""
    ends, begin = np.cumsum(counts), 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


class Side:
    """Works as arrays."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        self.rows = rows
        whole = lambda name: c.combine_chunks() if isinstance(c := rows.column(name), pa.ChunkedArray) else c
        number = lambda name, none: pc.fill_null(whole(name), none).to_numpy(zero_copy_only=False)
        self.ids = whole("id")
        self.ds, self.category, self.lost = number("ds", 0), number("category", 0), number("lost", False)
        self.lat, self.lon, self.cost = (number(c, np.nan).astype(float) for c in ("lat", "lon", "cost"))
        self.begins, self.ends = number("begins", np.iinfo(np.int32).max), number("ends", np.iinfo(np.int32).max)
        lists, weights = whole("terms"), whole("ws")
        self.terms, self.ws = lists.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.start, self.count = offsets[:-1] - offsets[0], np.diff(offsets)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.ws = self.ws / np.sqrt(np.bincount(self.row, self.ws * self.ws, len(self.count)))[self.row]
        # the length of what is left of a vector from each of its terms on
        before = np.concatenate([[0.0], np.cumsum(self.ws * self.ws)])
        self.tail = np.sqrt(np.maximum(0, before[(self.start + self.count)[self.row]] - before[:-1])) if len(self.row) else np.zeros(0)


class Index:
    """A side that others are compared with: where its terms are, the longest tails first, and its vectors by work and term."""

    def __init__(self, side: Side):
        self.side = side
        self.names, code = np.unique(side.terms, return_inverse=True)
        keys = side.row * max(1, len(self.names)) + code
        order = np.argsort(keys)
        self.keys, self.ws = keys[order], side.ws[order]
        place = code + (1 - np.minimum(side.tail, 1)) * 0.5
        by_tail = np.argsort(place)
        self.place, self.works, self.tails = place[by_tail], side.row[by_tail], side.tail[by_tail]

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this index, -1 for those it has not."""
        if not len(self.names):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        return np.where(self.names[at] == terms, at, -1)


def text_needed(y: Side, yi: np.ndarray, x: Side, xj: np.ndarray, distance: np.ndarray | None = None) -> np.ndarray:
    """The least text likeness with which pairs still reach the trigger, as in duplicates.text_needed; with their distance, if it is known."""
    w = SCORE_WEIGHTS
    a, b = y.cost[yi], x.cost[xj]
    with np.errstate(invalid="ignore", divide="ignore"):
        top = np.maximum(a, b)
        cost = np.where(top == 0, 0.0, np.nan_to_num(np.maximum(0, 1 - np.abs(a - b) / top)))
    given = cost * w["cost"] + ((y.category[yi] == x.category[xj]) & (y.category[yi] != 0)) * w["category"]
    never = np.iinfo(np.int32).max  # no begin: meets nothing
    given = given + ((y.begins[yi] <= x.ends[xj]) & (x.begins[xj] <= y.ends[yi]) & (y.begins[yi] != never) & (x.begins[xj] != never)) * w["time"]
    rest = w["text"] + w["cost"] + w["category"] + w["time"]
    if distance is None:
        goal = (DUPLICATE_TRIGGER - 1e-4) * rest / (rest + w["location"])
    else:
        goal = DUPLICATE_TRIGGER - 1e-4 - w["location"] * np.maximum(0, 1 - distance / GEO_MAX_M)
    return np.maximum(TEXT_TRIGGER, (goal - given) / w["text"]) - 1e-9


def texts(y: Side, yi: np.ndarray, code: np.ndarray, index: Index, xj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of pairs' vectors, and where y has the rarest term of each pair that both have (-1: none)."""
    owner, at = spread(y.start[yi], y.count[yi])
    known = code[at] >= 0
    owner, at = owner[known], at[known]
    if not len(owner):
        return np.zeros(len(yi)), np.full(len(yi), -1)
    key = xj[owner] * len(index.names) + code[at]
    found = np.minimum(np.searchsorted(index.keys, key), len(index.keys) - 1)
    hit = index.keys[found] == key
    owner, at, found = owner[hit], at[hit], found[hit]
    rarest = np.full(len(yi), -1)
    rarest[owner[::-1]] = at[::-1]
    return np.bincount(owner, y.ws[at] * index.ws[found], minlength=len(yi)), rarest


def pairs_by_text(y: Side, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Works of y and works without a place of the index that may be alike enough, with their texts' likeness: each pair once.

    The likeness of two texts from a shared term on is at most the product of their tails there, so of a term's works those are looked at whose tails
    are long enough, and facts then say how long these must be."""
    x, code = index.side, index.codes(y.terms)
    at = np.flatnonzero((code >= 0) & (y.tail >= TEXT_TRIGGER - SLACK))
    begin = np.searchsorted(index.place, code[at])
    # tails of x from 1 down to the least that reaches the bound
    least = np.minimum(1, (TEXT_TRIGGER - SLACK) / np.maximum(y.tail[at], 1e-300))
    many = np.maximum(0, np.searchsorted(index.place, code[at] + (1 - least) * 0.5 + SLACK, "right") - begin)
    for part in portions(many, LOOKS):
        owner, place = spread(begin[part], many[part])
        term, xj = at[part][owner], index.works[place]
        yi = y.row[term]
        good = (y.ds[yi] == x.ds[xj]) & (y.tail[term] * index.tails[place] >= text_needed(y, yi, x, xj) - SLACK)
        # of a pair's terms here the rarest, which stands first
        _, kept = np.unique(yi[good] * len(x.count) + xj[good], return_index=True)
        term, xj, yi = term[good][kept], xj[good][kept], yi[good][kept]
        for k in portions(y.count[yi], COMPARED):
            i, j = yi[k], xj[k]
            text, rarest = texts(y, i, code, index, j)
            good = (rarest == term[k]) & (text >= text_needed(y, i, x, j))
            i, j, text = i[good], j[good], text[good]
            mine, its = y.ids.take(pa.array(i)), x.ids.take(pa.array(j))
            # works without a place are on both sides
            good = np.where(y.lost[i], pc.less(its, mine).to_numpy(zero_copy_only=False), pc.not_equal(its, mine).to_numpy(zero_copy_only=False)) if len(i) else np.zeros(0, bool)
            yield i[good], j[good], text[good]


def metres(y: Side, yi: np.ndarray, x: Side, xj: np.ndarray) -> np.ndarray:
    p, q = np.radians(y.lat[yi]), np.radians(x.lat[xj])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(x.lon[xj] - y.lon[yi]) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(1, h))) * (2 * 6_371_000.0)


def pairs_by_place(y: Side, index: Index, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Works of y and later ones (by id) of the index at most GEO_MAX_M apart (`reach` degrees of latitude) that may be alike enough, with their texts' likeness."""
    x, code = index.side, index.codes(y.terms)
    order = np.argsort(x.lat)
    lat = x.lat[order]
    begin = np.searchsorted(lat, y.lat - reach)
    many = np.searchsorted(lat, y.lat + reach, "right") - begin
    for part in portions(many, LOOKS):
        owner, place = spread(begin[part], many[part])
        yi, xj = owner + part.start, order[place]
        far = metres(y, yi, x, xj)
        # a hair more, as the exact distance is told once more from the facts
        good = (y.ds[yi] == x.ds[xj]) & (far <= GEO_MAX_M + 0.01) & (text_needed(y, yi, x, xj, np.minimum(far, GEO_MAX_M)) <= 1 + SLACK)
        yi, xj, far = yi[good], xj[good], far[good]
        for k in portions(y.count[yi], COMPARED):
            i, j = yi[k], xj[k]
            text, _ = texts(y, i, code, index, j)
            good = text >= text_needed(y, i, x, j, np.minimum(far[k], GEO_MAX_M)) - SLACK
            i, j, text = i[good], j[good], text[good]
            good = pc.less(y.ids.take(pa.array(i)), x.ids.take(pa.array(j))).to_numpy(zero_copy_only=False) if len(i) else np.zeros(0, bool)
            yield i[good], j[good], text[good]


def told(y: Side, x: Side, i: np.ndarray, j: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
    """Pairs as dataset_id, the ids and facts of both, the lesser id first, and _text."""
    of = lambda side, at, name: side.rows.column(name).take(pa.array(at))
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    mine, its = whole(of(y, i, "id")), whole(of(x, j, "id"))
    first = pc.less(mine, its)
    fy, fx = whole(of(y, i, "f")), whole(of(x, j, "f"))
    return pa.RecordBatch.from_arrays([
        whole(of(y, i, "dataset_id")), pc.if_else(first, mine, its), pc.if_else(first, its, mine), pc.if_else(first, fy, fx), pc.if_else(first, fx, fy), pa.array(text),
    ], ["dataset_id", "a_id", "b_id", "a", "b", "_text"])
