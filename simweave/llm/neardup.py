"""Near-duplicate texts by universe partition and the pigeonhole principle, verified exactly.

A text is the set of its distinct runs of ``gram`` characters. Two sets with a Jaccard
similarity of at least t differ in at most H tokens, where H follows from their sizes. The token
universe is partitioned into ``GROUPS`` ranges of hashes, and H + 1 is dealt out to them, so in
one group of similar sets at most H / GROUPS tokens differ (pigeonhole principle). Each group is
a problem of its own: its tokens are hashed into segments, whose number follows from the size
band, and two allocations of the differences to segments are used:

* segment subsets: a record is indexed under its rarest non-empty segments, one more than may
  differ, the costlier (more frequent) ones being skipped. Both sides rank segments by one global
  cost, the frequency of their content in the whole collection, so similar records share one of
  them, if at least one of the two has more segments that are not empty than may differ.
* one-deletion neighbourhoods: with half as many segments as tokens may differ, and one, one
  segment differs in at most one token; records are indexed under every segment's content and
  under it with each token left out.

Each group of each record is allotted to one of them, by the table of frequencies: to
neighbourhoods where they make fewer comparisons and entries than segments do, and where it has
too few segments. Two records that both have neighbourhoods meet by them; any other two meet by
their segments, of which a record with neighbourhoods has entries too, but those do not meet
each other.

Segments are longer than single tokens, hence far more selective. What meets in an index list is
compared by size, by rank, and by a parity sketch of the group of 64 bits, whose distance never
exceeds the number of differing tokens; what is left is verified on the texts.

The first pass counts the contents of all records in a table of fixed size; the second sends
each record's entries, packed by chunk, to the task of their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.llm.spans import codes_of, rolling
from simweave.operators.skew import Pieces, split_join
from simweave.storage import written

_U64 = np.uint64
#: Slots of the count table (4 MB as sent to the tasks), at every size of the collection.
COUNT_BITS = 22
_SLICES = 64
#: Code points worked on at once.
CHUNK = 1_500_000
#: Upper edge of the first size band; each band is twice as wide as the one before.
FIRST_BAND = 8
#: Segments for each token of the largest set in a band.
SEGMENTS = 0.7
#: Comparisons that an index entry weighs as much as, when a record is allotted to a kind of index.
ENTRY = 16
#: Contents counted for each bucket of the index, which is one task's.
BUCKET_ENTRIES = 4_000_000
#: Entries of one index list that a task compares; longer lists are compared in blocks of so many.
LIST_ROWS = 20_000
#: Ranges of the token universe.
GROUPS = 8
# Odd multipliers for mixing.
_M1, _M2 = _U64(0x9E3779B97F4A7C15), _U64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    num: int
    den: int

    @classmethod
    def of(cls, value: float) -> Threshold:
        f = Fraction(str(value))
        return cls(f.numerator, f.denominator)

    def differing(self, total):
        """The most differing tokens of two similar sets with ``total`` tokens in sum."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, size):
        """The largest set that can be similar to one of ``size``."""
        return size * self.den // self.num

    def holds(self, common: int, union: int) -> bool:
        return union > 0 and common * self.den >= self.num * union


def band_top(band: int) -> int:
    return FIRST_BAND << band


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor(np.log2(np.maximum(sizes, 1) / FIRST_BAND)).astype(np.int64) + 1)


@dataclass
class TokenSets:
    """Token sets of a chunk, each cut into its groups: 44-bit token hashes, ascending within each group.

    Group g of record r has the number ``r * GROUPS + g``; ``sizes`` has for each group the size
    of the whole record.
    """

    tokens: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray

    @property
    def group(self) -> np.ndarray:
        return np.arange(len(self.sizes)) % GROUPS

    def sketches(self) -> np.ndarray:
        """The parity of each of 64 parts of every group."""
        place = (self.tokens * _M2) >> _U64(58)
        flat = np.bincount(self.owner * 64 + place.astype(np.int64), minlength=len(self.sizes) * 64)
        return np.packbits((flat & 1).astype(np.uint8).reshape(-1, 64), axis=1).view(np.uint64).reshape(-1)


def token_sets(texts: list[str], gram: int) -> TokenSets:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = codes_of(texts)
    hashes = rolling(codes, gram)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[: len(hashes)]
    ends = np.cumsum(sizes)
    inside = np.arange(len(hashes)) + gram <= ends[owner]
    # one sort gives the sets; groups and segments are ranges of hashes, so each is a run for every m
    keys = np.sort((owner[inside].astype(np.uint64) << _U64(44)) | (hashes[inside] >> _U64(20)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    record = (keys >> _U64(44)).astype(np.int64)
    tokens = keys & _U64((1 << 44) - 1)
    group = ((tokens >> _U64(12)) * _U64(GROUPS) >> _U64(32)).astype(np.int64)
    return TokenSets(tokens, record * GROUPS + group, np.repeat(np.bincount(record, minlength=len(texts)), GROUPS))


def _within_group(tokens: np.ndarray, m: int) -> np.ndarray:
    """Which of a group's ``m`` segments each token belongs to."""
    return ((tokens >> _U64(12)) * _U64(GROUPS) & _U64(0xFFFFFFFF)) * _U64(m) >> _U64(32)


@dataclass
class Entries:
    """Index entries: the record, the signature, the rank, and whether it is of the second kind.

    Entries of the second kind do not meet each other: segments of records that have
    neighbourhoods, and contents with a token left out.
    """

    record: np.ndarray
    signature: np.ndarray
    rank: np.ndarray
    second: np.ndarray

    def where(self, kept: np.ndarray) -> Entries:
        return Entries(self.record[kept], self.signature[kept], self.rank[kept], self.second[kept])

    @staticmethod
    def together(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(e, f) for e in parts]) for f in ("record", "signature", "rank", "second")))


def _slot(signature: np.ndarray) -> np.ndarray:
    return (signature >> _U64(64 - COUNT_BITS)).astype(np.int64)


def _segments(sets: TokenSets, chosen: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(record, segment, content, first token)`` of the non-empty segments, and nothing of other records."""
    picked = chosen[sets.owner]
    tokens, owner = sets.tokens[picked], sets.owner[picked]
    segment = _within_group(tokens, m)
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    heads = np.flatnonzero(new)
    content = np.add.reduceat(_token_weight(tokens), heads) if len(heads) else np.empty(0, dtype=np.uint64)
    return owner[heads], segment[heads], content, heads


def _token_weight(tokens: np.ndarray) -> np.ndarray:
    x = tokens * _M1
    return (x ^ (x >> _U64(29))) * _M2


def _signature(band: int, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
    x = (content + segment * _U64(0xBF58476D1CE4E5B9) + _U64(band * 0x94D049BB133111EB & (1 << 64) - 1)) * _M1
    return (x ^ (x >> _U64(32))) * _M2


def _members(sets: TokenSets, band: int, t: Threshold) -> np.ndarray:
    """Records of the band, and larger ones that may be similar to one of it."""
    bottom, top = (0 if band == 0 else band_top(band - 1)), band_top(band)
    # the smallest possible partner of a record of size s has s * num / den tokens
    return (sets.sizes > 0) & (sets.sizes >= bottom) & (sets.sizes <= t.largest(top - 1))


def _differing_in_band(sizes: np.ndarray, band: int, t: Threshold) -> np.ndarray:
    """The most differing tokens of a record and any partner it meets in ``band``."""
    top = band_top(band)
    return np.where(sizes < top, t.differing(sizes + t.largest(sizes)), t.differing(sizes + top - 1))


def _bands(sets: TokenSets, t: Threshold) -> list[int]:
    """The bands that have members: those from a record's smallest possible partner up to its own."""
    sizes = np.unique(sets.sizes[sets.sizes > 0])
    lowest = band_of(-(-sizes * t.num // t.den))
    return sorted({b for low, own in set(zip(lowest.tolist(), band_of(sizes).tolist(), strict=True)) for b in range(low, own + 1)})


def segment_signatures(sets: TokenSets, band: int, t: Threshold) -> Entries:
    """All non-empty segments of the band's members."""
    m = max(1, int(SEGMENTS * band_top(band) / GROUPS))
    record, segment, content, _ = _segments(sets, _members(sets, band, t), m)
    none = np.zeros(len(record), dtype=np.int32)
    return Entries(record, _signature(band, segment, content), none, none.astype(bool))


def rarest(entries: Entries, sets: TokenSets, band: int, t: Threshold, cost: np.ndarray) -> Entries:
    """Each group's segments of least cost, one more than may differ, with their ranks.

    A rank is the number of differing tokens of two records at which the group needs the segment:
    they are dealt out to the groups in turn.
    """
    key = (entries.record.astype(np.uint64) << _U64(44)) | (cost[_slot(entries.signature)].astype(np.uint64) << _U64(36)) | (entries.signature & _U64((1 << 36) - 1))
    order = np.argsort(key)
    record = entries.record[order]
    first = np.searchsorted(record, np.arange(len(sets.sizes)))
    rank = (np.arange(len(record)) - first[record]) * GROUPS + record % GROUPS
    kept = rank <= _differing_in_band(sets.sizes, band, t)[record]
    return Entries(record[kept], entries.signature[order][kept], rank[kept].astype(np.int32), np.zeros(int(kept.sum()), dtype=bool))


def _neighbourhood_segments(band: int, t: Threshold) -> int:
    top = band_top(band)
    return int(t.differing(top - 1 + t.largest(top - 1))) // GROUPS // 2 + 1


def whole_signatures(sets: TokenSets, band: int, t: Threshold, chosen: np.ndarray) -> tuple[Entries, np.ndarray]:
    """Every neighbourhood segment's content, empty ones too, of the chosen records; and the contents by record and segment."""
    m = _neighbourhood_segments(band, t)
    who = np.flatnonzero(chosen)
    place = np.zeros(len(chosen), dtype=np.int64)
    place[who] = np.arange(len(who))
    record, segment, content, _ = _segments(sets, chosen, m)
    whole = np.zeros((len(who), m), dtype=np.uint64)
    whole[place[record], segment.astype(np.int64)] = content
    every = np.tile(np.arange(m, dtype=np.uint64), len(who))
    # the marker keeps signatures of this kind apart from those of segment subsets
    signature = _signature(-(band + 1), every, whole.reshape(-1))
    none = np.zeros(len(signature), dtype=np.int32)
    return Entries(np.repeat(who, m), signature, none, none.astype(bool)), whole


def deletion_signatures(sets: TokenSets, band: int, t: Threshold, chosen: np.ndarray | None = None) -> Entries:
    """The one-deletion neighbourhoods: every segment's content, and it with each token left out."""
    chosen = _members(sets, band, t) if chosen is None else chosen
    full, whole = whole_signatures(sets, band, t, chosen)
    picked = chosen[sets.owner]
    tokens, owner = sets.tokens[picked], sets.owner[picked]
    of = _within_group(tokens, whole.shape[1])
    row = np.searchsorted(np.flatnonzero(chosen), owner)
    less = _signature(-(band + 1), of, whole[row, of.astype(np.int64)] - _token_weight(tokens))
    left_out = Entries(owner, less, np.zeros(len(less), dtype=np.int32), np.ones(len(less), dtype=bool))
    return Entries.together([full, left_out])


def allotted(sets: TokenSets, band: int, t: Threshold, cost: np.ndarray) -> Entries:
    """The entries of the band's members, each group of a record with the kind of index that costs less.

    The cost of an entry is a constant and the length of its list by the table. Neighbourhoods
    are only made where their number of entries alone does not rule them out.
    """
    n = len(sets.sizes)
    every = segment_signatures(sets, band, t)
    kept = rarest(every, sets, band, t, cost)
    length = np.exp2(np.arange(256) / 8) - 1
    by_segments = np.bincount(kept.record, weights=length[cost[_slot(kept.signature)]] + ENTRY, minlength=n)
    chosen = _members(sets, band, t)
    few = chosen & (np.bincount(every.record, minlength=n) * GROUPS + sets.group <= _differing_in_band(sets.sizes, band, t))
    least = ENTRY * (_neighbourhood_segments(band, t) + np.bincount(sets.owner, minlength=n))
    possible = few | (chosen & (by_segments > least))
    if not possible.any():
        return kept
    around = deletion_signatures(sets, band, t, possible)
    by_deletions = np.bincount(around.record, weights=length[cost[_slot(around.signature)]] + ENTRY, minlength=n)
    taken = few | (possible & (by_deletions < by_segments))
    kept.second = taken[kept.record]
    return Entries.together([kept, around.where(taken[around.record])])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and texts in the order of ids, rows that repeat within the partition once."""
    ids, texts, total = [], [], 0
    met: set[tuple[int, int]] = set()

    def by_id(ids: list[int], texts: list[str]) -> tuple[np.ndarray, list[str]]:
        order = np.argsort(ids, kind="stable")
        return np.array(ids, dtype=np.int64)[order], [texts[i] for i in order.tolist()]

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            row = (i, hash(text))
            if row in met:
                continue
            met.add(row)
            # a chunk's groups fit the 20 bits that sorting keys give them
            if texts and (total + len(text) > CHUNK or len(texts) * GROUPS >= 1 << 20):
                yield by_id(ids, texts)
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(text)
            total += len(text)
    if texts:
        yield by_id(ids, texts)


def _count_table(rows: DataFrame, gram: int, t: Threshold) -> tuple[np.ndarray, int]:
    """The cost of a content by its slot, 8 steps to a factor of two, and the number of contents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
        for _, texts in _chunks(batches):
            sets = token_sets(texts, gram)
            for band in _bands(sets, t):
                for entries in (segment_signatures(sets, band, t), whole_signatures(sets, band, t, _members(sets, band, t))[0]):
                    table += np.bincount(_slot(entries.signature), minlength=1 << COUNT_BITS).astype(np.uint32)
        if table.any():
            pack = zstandard.ZstdCompressor(1)
            blobs = [pack.compress(part.tobytes()) for part in np.split(table, _SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in parts:
            for name, blob in zip(pdf["slice"], pdf["counts"], strict=True):
                part = np.frombuffer(zstandard.decompress(blob), dtype=np.uint32).astype(np.float64)
                sums[name] = sums[name] + part if name in sums else part
        for name, part in sums.items():
            steps = np.minimum(255, np.round(8 * np.log2(1 + part))).astype(np.uint8)
            yield pd.DataFrame({"slice": [name], "steps": [steps.tobytes()], "n": [int(part.sum())]})

    counted = rows.mapInArrow(count, "slice INT, counts BINARY").repartition("slice").mapInPandas(total, "slice INT, steps BINARY, n BIGINT")
    cost, contents = np.zeros(1 << COUNT_BITS, dtype=np.uint8), 0
    width = (1 << COUNT_BITS) // _SLICES
    for row in counted.collect():  # 64 slices of 64 KB, at every size
        cost[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["steps"], dtype=np.uint8)
        contents += row["n"]
    return cost, contents


#: The parts of a packed bucket and their types: of each record the step to its id, size, number of entries and sketch; of each entry its place and signature.
_PARTS = (np.int64, np.int32, np.int32, np.uint64, np.int32, np.uint32)
#: Bytes of a signature that are kept within a bucket; lists that fall together only cost comparisons.
_SIGNATURE_BYTES = 3


def _pack(ids: np.ndarray, sets: TokenSets, sketches: np.ndarray, entries: Entries, ranges: int) -> Iterator[tuple[int, bytes]]:
    """The chunk's entries of each bucket that has some, by record and rank, with what is known of the records.

    A bucket is one of ``ranges`` ranges of the signatures of a group.
    """
    bucket = entries.record % GROUPS * ranges + ((entries.signature >> _U64(32)) * _U64(ranges) >> _U64(32)).astype(np.int64)
    order = np.argsort(bucket << 20 | entries.record)
    bucket, record = bucket[order], entries.record[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (record[1:] != record[:-1])
    at = np.flatnonzero(new)
    who, count = record[at], np.diff(np.append(at, len(order)))
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(order) else at
    first_who = np.searchsorted(at, heads)
    step = np.diff(ids[who // GROUPS], prepend=0)
    step[first_who] = ids[who[first_who] // GROUPS]
    columns = step, sets.sizes[who], count, sketches[who], entries.rank[order] * 2 + entries.second[order], entries.signature[order] & _U64(0xFFFFFFFF)
    columns = [c.astype(k, copy=False) for c, k in zip(columns, _PARTS, strict=True)]
    pack = zstandard.ZstdCompressor(1)
    whos, ends = np.append(first_who, len(who)).tolist(), np.append(heads, len(order)).tolist()
    for i, b in enumerate(bucket[heads].tolist()):
        w, e = slice(whos[i], whos[i + 1]), slice(ends[i], ends[i + 1])
        # bytes of like weight together: small numbers are mostly zero bytes
        planes = [c[x].view(np.uint8).reshape(-1, c.itemsize).T for c, x in zip(columns, (w, w, w, w, e, e), strict=True)]
        planes[-1] = planes[-1][:_SIGNATURE_BYTES]
        yield b, np.array([w.stop - w.start, e.stop - e.start], dtype=np.int32).tobytes() + pack.compress(b"".join(p.tobytes() for p in planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    """The parts of a packed bucket, with ids in place of steps."""
    records, entries = np.frombuffer(blob[:8], dtype=np.int32).tolist()
    raw, at, out = np.frombuffer(zstandard.decompress(blob[8:]), dtype=np.uint8), 0, []
    for kind, n in zip(_PARTS, (records, records, records, records, entries, entries), strict=True):
        item = np.dtype(kind).itemsize
        kept = _SIGNATURE_BYTES if len(out) == 5 else item
        planes = np.zeros((item, n), dtype=np.uint8)
        planes[:kept] = raw[at : at + n * kept].reshape(kept, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kept
    return [np.cumsum(out[0]), *out[1:]]


def _meetings(run: np.ndarray, record: np.ndarray, place: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, group: int, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two entries of one run that pass the bounds by size, rank and sketch.

    Entries are in the order of run, kind and size. An entry of rank p meets no partner with which
    fewer than p tokens may differ, so its partners in the run are a range of sizes: of the first
    kind the ones after it, of the second kind all, and those of the second kind look for none.
    """
    rank, second = place >> 1, (place & 1).astype(np.int64)
    size = sizes[record]
    # the least sum of sizes at which `rank` tokens may differ
    least = -(-rank * (t.den + t.num) // (t.den - t.num)) - size
    key = (run << 33) | (second << 32) | size
    first = np.flatnonzero(second == 0)
    base, most = run[first] << 33, t.largest(size[first])
    begin = np.maximum(first + 1, np.searchsorted(key, base | np.maximum(size, least)[first]))
    count = np.maximum(np.searchsorted(key, base | most, "right") - begin, 0)
    one_of, begins, counts = [first], [begin], [count]
    if len(first) < len(key):
        base |= 1 << 32
        smallest = -(-size[first] * t.num // t.den)
        begin = np.searchsorted(key, base | np.maximum(np.maximum(smallest, least[first]), 0))
        one_of.append(first)
        begins.append(begin)
        counts.append(np.maximum(np.searchsorted(key, base | most, "right") - begin, 0))
    one_of, begin, count = np.concatenate(one_of), np.concatenate(begins), np.concatenate(counts)
    some = np.flatnonzero(count)
    sums = np.cumsum(count[some])
    who, size, least = record.astype(np.int32), size.astype(np.int32), least.astype(np.int32)
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + (1 << 19), "right")))
        part = some[at:end]
        n = count[part]
        one = np.repeat(one_of[part], n)
        other = np.arange(len(one)) + np.repeat(begin[part] - (np.cumsum(n) - n), n)
        ok = least[other] <= size[one]
        one, other = one[ok], other[ok]
        limit = (t.differing(size[one] + size[other]) - group) // GROUPS
        near = np.bitwise_count(sketches[who[one]] ^ sketches[who[other]]) <= limit
        yield one[near], other[near]
        at = end


def _compare(record: np.ndarray, signature: np.ndarray, place: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, group: int, t: Threshold, list_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of record numbers that meet under a signature and may be similar, and the entries of long lists."""
    order = np.argsort(signature.astype(np.uint64) << _U64(32) | (place & 1).astype(np.uint64) << _U64(31) | sizes[record].astype(np.uint64))
    sorted_ = signature[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(order)))
    run = np.cumsum(new) - 1
    kept = (length[run] > 1) & (length[run] <= list_rows)
    late = order[length[run] > list_rows]
    order, run = order[kept], run[kept]
    record, n = record[order], len(sizes)
    found: list[np.ndarray] = []
    seen = np.empty(0, dtype=np.int64)
    for one, other in _meetings(run, record, place[order].astype(np.int64), sizes, sketches, group, t):
        a, b = record[one], record[other]
        found.append(np.minimum(a, b) * n + np.maximum(a, b))
        if len(found) > 200:
            seen = np.unique(np.concatenate([seen, *found]))
            found = []
    return np.unique(np.concatenate([seen, *found])), late


_CANDIDATES = "a BIGINT, b BIGINT, sig BIGINT, size INT, place INT, sketch BIGINT"


def _candidates(rows: DataFrame, gram: int, t: Threshold, buckets: int | None, list_rows: int) -> DataFrame:
    cost, contents = _count_table(rows, gram, t)
    ranges = max(1, -(-(buckets or -(-contents // BUCKET_ENTRIES)) // GROUPS))
    buckets = GROUPS * ranges
    shared = rows.sparkSession.sparkContext.broadcast(cost)  # 4 MB

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            sets = token_sets(texts, gram)
            made = [allotted(sets, band, t, shared.value) for band in _bands(sets, t)]
            if not made:
                continue
            packed = list(_pack(ids, sets, sets.sketches(), Entries.together(made), ranges))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names=["bucket", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if last is not None and bucket != last:
                    yield from one_bucket(held, last // ranges)
                    held = []
                last = bucket
                held.append(blob)
        if held:
            yield from one_bucket(held, last // ranges)

    def one_bucket(blobs: list[bytes], group: int) -> Iterator[pa.RecordBatch]:
        ids, sizes, record, signature, place, sketches, base = [], [], [], [], [], [], 0
        for blob in blobs:
            i, s, c, sk, p, sig = _unpack(blob)
            ids.append(i)
            sizes.append(s)
            record.append(np.repeat(np.arange(base, base + len(i), dtype=np.int64), c))
            place.append(p)
            signature.append(sig)
            sketches.append(sk)
            base += len(i)
        blobs.clear()
        id_of, size_of, sketch_of = np.concatenate(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(sketches)
        rec, sig, places = np.concatenate(record), np.concatenate(signature), np.concatenate(place)
        pairs, late = _compare(rec, sig, places, size_of, sketch_of, group, t, list_rows)
        a, b = id_of[pairs // max(1, base)], id_of[pairs % max(1, base)]
        a, b = a[a != b], b[a != b]
        for i in range(0, len(a), 100_000):
            none = pa.nulls(len(a[i : i + 100_000]))
            yield _row_batch(np.minimum(a, b)[i : i + 100_000], np.maximum(a, b)[i : i + 100_000], none, none, none, none)
        for i in range(0, len(late), 20_000):
            e = late[i : i + 20_000]
            yield _row_batch(id_of[rec[e]], pa.nulls(len(e)), group << 32 | sig[e].astype(np.int64), size_of[rec[e]], places[e], sketch_of[rec[e]].view(np.int64))

    packed = rows.mapInArrow(index, "bucket INT, entries BINARY")
    met = written(packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(meet, _CANDIDATES), "near-met")
    pairs = met.where("b IS NOT NULL").select("a", "b")
    if met.where("b IS NULL").isEmpty():
        return pairs.distinct()
    return pairs.unionByName(_long_lists(met.where("b IS NULL"), t, list_rows)).distinct()


def _row_batch(a, b, sig, size, place, sketch) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    columns = [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((a, b, sig, size, place, sketch), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sig", "size", "place", "sketch"])


def _long_lists(entries: DataFrame, t: Threshold, list_rows: int) -> DataFrame:
    """Lists too long for a task, as pairs of blocks: each task meets two blocks of one list, of some ``list_rows`` entries each."""
    blocks = written(entries.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")), "near-lists")
    known = Pieces.of(blocks.select("sig", "n")).join(entries.select("a", "sig", "size", "place", "sketch"), blocks.select("sig", "blocks"), ["sig"])
    spread = known.withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("blocks", "other")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(second=pdf["place"] & 1).sort_values(["second", "size"], kind="stable")
        ids, own = pdf["a"].to_numpy(), pdf["own"].to_numpy()
        sketches = pdf["sketch"].to_numpy().view(np.uint64)
        everyone, together = np.arange(len(pdf)), np.zeros(len(pdf), dtype=np.int64)
        found = [np.empty((0, 2), dtype=np.int64)]
        for one, other in _meetings(together, everyone, pdf["place"].to_numpy().astype(np.int64), pdf["size"].to_numpy().astype(np.int64), sketches, key[0] >> 32, t):
            across = (own[one] != own[other]) | (key[1] == key[2])
            found.append(np.stack([ids[one[across]], ids[other[across]]], axis=1))
        both = np.concatenate(found)
        both = np.unique(np.sort(both[both[:, 0] != both[:, 1]], axis=1), axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return spread.groupBy("sig", "one", "two").applyInPandas(compare, "a BIGINT, b BIGINT")


def grams_of(text: str, gram: int) -> set[str]:
    return {text[i : i + gram] for i in range(len(text) - gram + 1)}


def near_duplicates(
    df: DataFrame, row_id: str, text: str, threshold: float, gram: int = 5, buckets: int | None = None, list_rows: int = LIST_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, copies)`` of the texts whose sets of ``gram``-character runs are similar.

    ``pairs`` has ``a, b`` (a < b): ids of different texts whose Jaccard similarity is
    ``threshold`` or more, each text under the least id that has it. ``copies`` has ``id, first``
    for every other id of a text. A null text, or one shorter than ``gram``, has no set and is
    similar to nothing, not even its copies; null ids are left out; rows that repeat id and text
    count once; an id with several texts has the pairs of all of them. Other columns are not read.
    """
    t = Threshold.of(threshold)
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= gram))
    # copies by a digest of 192 bits, so that no text is shuffled; the aggregation is partial first
    named = rows.select("id", F.md5("text").alias("d"), F.xxhash64("text").alias("h"))
    counted = named.groupBy("d", "h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = written(counted.where("first < last").drop("last"), "near-first")
    others = Pieces.of(first.select("d", "h", "n")).join(named, first.drop("n"), ["d", "h"])
    others = written(others.where("id <> first").select("id", "first", "d", "h").distinct(), "near-copies")
    other = (rows["id"] == others["id"]) & (F.md5(rows["text"]) == others["d"]) & (F.xxhash64(rows["text"]) == others["h"])
    texts = rows.join(others, other, "left_anti")
    copies = others.select("id", "first")
    met = written(_candidates(texts, gram, t, buckets, list_rows), "near-pairs")
    wanted = written(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    few = rows.join(wanted, "id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = grams_of(left, gram), grams_of(right, gram)
                common = len(x & y)
                good.append(t.holds(common, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # a text with very many candidates is as heavy by one end of the pairs as by the other
    heavy = [Pieces.of(met.groupBy(end).agg(F.count(F.lit(1)).alias("n"))) for end in ("a", "b")]
    sides = heavy[0].join(met, few.select(F.col("id").alias("a"), F.col("text").alias("x")), ["a"])
    sides = heavy[1].join(sides, few.select(F.col("id").alias("b"), F.col("text").alias("y")), ["b"])
    return written(sides.select("a", "b", "x", "y").mapInArrow(verify, "a BIGINT, b BIGINT").distinct(), "near-verified"), copies


def all_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """``a, b`` (a < b) with every copy of a text in place of its first id, and copies of one text as pairs."""
    firsts = written(copies.select(F.col("first").alias("id"), "first").distinct().unionByName(copies), "near-firsts")
    left = firsts.select(F.col("first").alias("a"), F.col("id").alias("left"))
    right = firsts.select(F.col("first").alias("b"), F.col("id").alias("right"))
    between = split_join(written(split_join(pairs, left, ["a"], "left"), "near-between"), right, ["b"], "left")
    between = between.select(F.coalesce("left", "a").alias("l"), F.coalesce("right", "b").alias("r"))
    # cut by the number of pairs that a text's copies make
    pieces = Pieces.of(firsts.groupBy("first").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("n")))
    within = pieces.join(firsts.withColumnRenamed("id", "l"), firsts.withColumnRenamed("id", "r"), ["first"]).where("l < r").select("l", "r")
    return between.unionByName(within).select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).where("a < b").distinct()
