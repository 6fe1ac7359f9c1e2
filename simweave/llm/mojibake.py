"""Text that was decoded with a wrong encoding: finding it and restoring the original.

A smoothed character trigram model is trained on all clean records. Every run of non-ASCII
characters is then held against what each encode-decode chain would make of it: the chain that
gives the likeliest text wins, if it beats the text as it stands by more than the margin. The
margin is validated on all clean records themselves, of which hardly any may be changed: every
record is tried at the least margin, and what was found is cut to the validated one.

Every record is counted, and exactly. The model has the most frequent trigrams and bigrams, in
tables of fixed size by hash, so it and its broadcast are bounded however large the collection.
Noise has new trigrams in every record: without end they would fill the tables, and what never
occurs would look usual. Characters that were lost on the way stand as U+FFFD or control
characters; a chain reads them as unknown bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property, lru_cache, partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.llm.spans import codes_of
from simweave.storage import drop_written, written

_U64 = np.uint64
#: Slots of the tables of trigrams, bigrams and characters.
SLOTS = (1 << 21, 1 << 20, 1 << 18)
_SLICES = 16
#: The share of the slots of trigrams and bigrams that is filled at most.
FILLED = 0.2
#: The counts of a larger collection are scaled down to so many characters, as smoothing adds a fixed number to them.
AS_MANY = 1 << 26
#: Nats from which a restored text is looked at; the margin that counts is set by :func:`validated_margin`.
MARGIN = 4.0
#: The share of clean records that may be changed.
MOST_WRONG = 0.0002

# Wrong decodings (what the bytes were read as) with the encodings they were in.
CHAINS = tuple(
    (wrong, right)
    for wrong, rights in (
        ("cp1252", ("utf-8", "gb18030", "cp1251", "koi8-r", "big5", "shift_jis", "cp1250", "mac-roman", "cp850")),
        ("mac-roman", ("utf-8", "cp1252", "gb18030", "cp1251")),
        ("cp437", ("utf-8", "cp1252", "gb18030", "cp1251")),
        ("cp850", ("utf-8", "cp1252", "gb18030")),
        ("cp1250", ("utf-8", "cp1252", "gb18030")),
        ("iso8859-15", ("utf-8",)),
        ("cp1251", ("utf-8", "koi8-r", "cp866", "cp1252", "gb18030", "iso8859-5", "mac-cyrillic")),
        ("koi8-r", ("utf-8", "cp1251", "cp866", "cp1252", "gb18030")),
        ("cp866", ("utf-8", "cp1251", "koi8-r", "cp1252")),
        ("iso8859-5", ("utf-8", "cp1251", "koi8-r")),
        ("gb18030", ("utf-8", "big5", "shift_jis", "cp1252", "cp1251")),
        ("big5", ("utf-8", "gb18030")),
        ("shift_jis", ("utf-8", "gb18030")),
    )
    for right in rights
)
#: A restored text may itself be garbled; so many times it is restored again.
DEPTH = 8
#: What clean records, on which the model is trained, do not hold. A clean record that holds
#: such a sequence is only not learned from.
_UNCLEAN = regex.compile(
    "|".join(
        (
            r"[\u0080-\u009f\ufffd\ue000-\uf8ff]",  # control, replacement and private characters
            r"[\u00a0-\u00ff]{3,}",  # rows of accented letters and signs
            r"[ÂÃÐÑâ¬√][\u00a0-\u00bfŒ-ƒˆ-˜†-›€™]|‚Ä",  # the lead and trail of UTF-8 in Western sets
            r"[РСГВ][\u00a0-\u00bfЀ-Џѐ-џ†-›€™]",  # and in Cyrillic ones
            r"[а-яё][А-ЯЁ]",  # letter case turned over
            r"[─-▟∀-⋿ㄅ-ㄯ]|锛|銆|鐨",  # box drawing, mathematics, and the usual marks of Chinese read as Chinese
        )
    )
)


#: Stands for a lost byte until the text around it is decoded.
_LOST = "\ufffd"


def _hash(*columns: np.ndarray) -> np.ndarray:
    x = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        x = (x ^ c.astype(np.uint64)) * _U64(0x9E3779B97F4A7C15)
        x ^= x >> _U64(29)
    return x * _U64(0xBF58476D1CE4E5B9)


def _slots_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of trigrams, of the bigrams that end them and of their last characters."""
    return (_hash(a, b, c) % _U64(SLOTS[0])).astype(np.int64), (_hash(b, c) % _U64(SLOTS[1])).astype(np.int64), (c % SLOTS[2]).astype(np.int64)


def _slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigram, bigram and character that end at each place after the second."""
    return _slots_of(codes[:-2], codes[1:-1], codes[2:])


def _codes(texts: list[str]) -> np.ndarray:
    """Code points with all digits alike: their values say nothing about the encoding."""
    codes = codes_of(texts).copy()
    codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    return codes


def count_grams(texts: list[str]) -> list[np.ndarray]:
    codes = _codes(["\x02\x02" + t for t in texts])
    return [np.bincount(s, minlength=n) for s, n in zip(_slots(codes), SLOTS, strict=True)]


#: ``(chain, restored)`` of each chain that can be undone in a zone.
Undone = Callable[[str, tuple[tuple[str, str], ...]], tuple[tuple[str, str], ...]]


@dataclass
class Model:
    """Log probabilities of characters after two others, from hashed counts."""

    three: np.ndarray
    two: np.ndarray
    one: np.ndarray

    @cached_property
    def seen(self) -> frozenset[str]:
        """Characters of the clean records; digits are counted as one."""
        return frozenset(map(chr, np.flatnonzero(self.one).tolist())) | frozenset("0123456789" + _LOST)

    @cached_property
    def unseen(self) -> float:
        """Nats that any other character costs at least."""
        return -math.log(0.05 / (max(1.0, float(self.one.sum())) + 0.05 * 40_000))

    @cached_property
    def undone(self) -> Undone:
        """What chains make of a zone; short zones come up again and again."""
        return lru_cache(maxsize=100_000)(partial(_undone, seen=self.seen, unseen=self.unseen))

    def __getstate__(self) -> dict:
        """Without what is derived from the counts."""
        return {k: self.__dict__[k] for k in ("three", "two", "one")}

    @classmethod
    def of(cls, counts: list[np.ndarray]) -> Model:
        return cls(*(c.astype(np.float32) for c in counts))

    def log_likelihood(self, codes: np.ndarray) -> np.ndarray:
        """For every place after the second; interpolated, the order by how often the context was seen."""
        three, two, one = _slots(codes)
        a, b = codes[:-2], codes[1:-1]
        total = max(1.0, float(self.one.sum()))
        p = (self.one[one] + 0.05) / (total + 0.05 * 40_000)
        # the share for what was not seen after a context: some, and two in a thousand
        seen = self.one[b % SLOTS[2]]
        unseen = 5 + 0.002 * seen
        p = (self.two[two] + unseen * p) / (np.maximum(seen, self.two[two]) + unseen)
        seen = self.two[(_hash(a, b) % _U64(SLOTS[1])).astype(np.int64)]
        unseen = 5 + 0.002 * seen
        p = (self.three[three] + unseen * p) / (np.maximum(seen, self.three[three]) + unseen)
        return np.log(p)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log likelihood of each text, whose first two characters are context."""
        if not texts:
            return np.empty(0)
        sizes = np.array([len(t) for t in texts])
        values = self.log_likelihood(_codes(texts))
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        ends = np.cumsum(sizes) - 2
        return sums[ends] - sums[ends - sizes + 2]


@cache
def _byte_of(wrong: str) -> dict[str, int] | None:
    """Characters of a single-byte encoding; a byte it leaves undefined is the control character."""
    if wrong in ("gb18030", "big5", "shift_jis", "utf-8"):
        return None
    table = {}
    for byte in range(128, 256):
        table[chr(byte)] = byte
    for byte in range(128, 256):
        try:
            table[bytes([byte]).decode(wrong)] = byte
        except UnicodeDecodeError:
            pass
    if wrong != "cp1252":  # control characters stand for undefined bytes only in the Windows sets
        keep = set()
        for byte in range(128, 256):
            try:
                keep.add(bytes([byte]).decode(wrong))
            except UnicodeDecodeError:
                keep.add(chr(byte))
        table = {c: b for c, b in table.items() if c in keep}
    return table


def undo(text: str, wrong: str, right: str) -> str | None:
    """What ``text`` was, if bytes in ``right`` were read as ``wrong``; None if they can't have been.

    Lost characters stay lost, together with the rest of the character they were part of.
    """
    table = _byte_of(wrong)
    parts: list[str] = []
    if table is not None:
        raw = bytearray()
        lost = []
        for c in text:
            if c == _LOST:
                lost.append(len(raw))
                raw.append(0xFF)
            elif ord(c) < 128:
                raw.append(ord(c))
            elif c in table:
                raw.append(table[c])
            else:
                return None
        data = bytes(raw)
    else:
        lost = []
        try:
            pieces = text.split(_LOST)
            data = pieces[0].encode(wrong)
            for piece in pieces[1:]:
                lost.append(len(data))
                data += b"\xff" + piece.encode(wrong)
        except UnicodeEncodeError:
            return None
    try:
        if not lost:
            return data.decode(right)
        if _byte_of(right) is not None:
            # a character a byte: what was lost stays lost
            whole = list(data.decode(right))
            for i in lost:
                whole[i] = _LOST
            return "".join(whole)
        # decode around what was lost: broken characters are marked, but not more than were lost
        parts.append(data.decode(right, "replace"))
        return parts[0] if parts[0].count(_LOST) <= 4 * len(lost) else None
    except UnicodeDecodeError:
        return None


@cache
def _repertoires() -> tuple[tuple[frozenset[str], regex.Pattern, tuple[tuple[str, str], ...]], ...]:
    """What single-byte encodings can show, the pattern of its runs, and the chains that start from each."""
    out = []
    for wrong in dict.fromkeys(w for w, _ in CHAINS):
        table = _byte_of(wrong)
        if table is not None:
            shown = "".join(c for c in table if ord(c) > 127) + _LOST
            out.append((frozenset(shown), regex.compile(f"[{regex.escape(shown)}]+"), tuple(c for c in CHAINS if c[0] == wrong)))
    return tuple(out)


def _undone(zone: str, chains: tuple[tuple[str, str], ...], seen: frozenset[str], unseen: float) -> tuple[tuple[str, str], ...]:
    """``(chain, restored)`` of what the chains make of a zone.

    Left out is what would be implausible by its characters alone: those not ``seen`` in clean
    records cost ``unseen`` nats each.
    """
    if not zone.strip(_LOST):
        return ()
    out = []
    for wrong, right in chains:
        name, restored = f"{right} read as {wrong}", undo(zone, wrong, right)
        times = 0
        while restored and restored != zone and times < DEPTH:
            if right != "utf-8" and unseen * sum(c not in seen for c in restored) > -PLAUSIBLE * len(restored):
                break
            out.append((name + ", again" * times, restored))
            # text that was garbled twice is none after one step, so the steps are judged together
            again = undo(restored, wrong, right) if right == "utf-8" and not restored.isascii() else None
            restored, times = (again, times + 1) if again != restored else (None, times)
    return tuple(out)


_DOUBLE = tuple(c for c in CHAINS if _byte_of(c[0]) is None)
#: Nats from which a character is odd in its place, and what is usual for one.
ODD, USUAL = 5.0, 4.0
#: Nats beyond the usual that make a zone.
LEAST_ODD = 6.0
#: The least mean log likelihood a character of a restored zone has. What decodes as UTF-8 has
#: passed a test that other text hardly passes, so there a rare sign may come out.
PLAUSIBLE = -5.5


def _odd_zones(odd: np.ndarray, text: str) -> list[tuple[int, int]]:
    """Stretches of non-ASCII characters, and ASCII between them, that are odd taken together."""
    zones: list[tuple[int, int]] = []
    start, total, best, end = 0, 0.0, 0.0, 0
    for i, x in enumerate((odd - USUAL).tolist()):
        if total <= 0 or total < best - 12:
            if best > LEAST_ODD:
                zones.append((start, end))
            start, total, best = i, 0.0, 0.0
        total += x if text[i] > "\x7f" else min(x, 0.0)
        if total > best:
            best, end = total, i + 1
    if best > LEAST_ODD:
        zones.append((start, end))
    return zones

#: Nats for every character that came out of a decoding as UTF-8.
UTF8_EVIDENCE = 3.5

_EAST_ASIAN_RUN = regex.compile(r"[\u2e80-\u9fff\uac00-\ufaff\ue000-\uf8ff\ufffd]+")
_EAST_ASIAN = regex.compile(r"[\u2e80-\u9fff\uac00-\ufaff\ue000-\uf8ff]")


def _east_asian_zones(odd: np.ndarray, text: str) -> Iterator[tuple[int, int]]:
    """Odd zones as they are if mostly of East Asian characters, else the runs of such characters in them."""
    for s, e in _odd_zones(odd, text):
        if 2 * len(_EAST_ASIAN.findall(text[s:e])) >= e - s:
            yield s, e
        else:
            yield from (m.span() for m in _EAST_ASIAN_RUN.finditer(text, s, e))


def _trials(text: str, odd: np.ndarray, strange: np.ndarray, undone: Undone, known: str = "") -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, chain, restored)`` of everything a chain could undo in a text with odd characters.

    The gain of a chain is that of all its zones together, and at most their oddness and the
    evidence for UTF-8; where that is below ``MARGIN``, the chains of a repertoire are not tried.
    Of the repertoire of a chain that is ``known`` to have garbled the text every zone is tried.
    """
    before = np.concatenate([[0], np.cumsum(strange)])
    sums = np.concatenate([[0], np.cumsum(odd)])
    odd_ones = {text[i] for i in np.flatnonzero(strange)}
    for shown, pattern, chains in _repertoires():
        at_hand = known.endswith(f" read as {chains[0][0]}")
        if not at_hand and shown.isdisjoint(odd_ones):
            continue
        zones = [m.span() for m in pattern.finditer(text)]
        if not at_hand:
            zones = [(s, e) for s, e in zones if before[e] > before[s]]
            # a character beyond ASCII comes out of two bytes or more, around lost ones out of each
            most = sum((e - s) // (1 if _LOST in text[s:e] else 2) for s, e in zones)
            if sum(sums[min(e + 2, len(text))] - sums[s] for s, e in zones) + UTF8_EVIDENCE * most < MARGIN:
                continue
        for s, e in zones:
            for chain, restored in undone(text[s:e], chains):
                yield s, e, chain, restored
    if not _EAST_ASIAN.search(text):
        return
    # a likely ideograph may still be a garbled letter, where the chain is known to have garbled the text
    at_hand = tuple(c for c in _DOUBLE if known == f"{c[1]} read as {c[0]}")
    for s, e in [m.span() for m in _EAST_ASIAN_RUN.finditer(text)] if at_hand else []:
        for begin, end in ((s, e), (s - 1, e), (s, e + 1)):
            if 0 <= begin < end <= len(text):
                for chain, restored in undone(text[begin:end], at_hand):
                    yield begin, end, chain, restored
    for s, e in _east_asian_zones(odd, text):
        # the first and last characters of a zone may be likely ones by chance
        for begin, end in ((s, e), (s - 1, e), (s, e + 1), (s - 1, e + 1), (s + 1, e), (s, e - 1), (s - 2, e), (s, e + 2)):
            if 0 <= begin < end <= len(text):
                for chain, restored in undone(text[begin:end], _DOUBLE):
                    yield begin, end, chain, restored


def _oddness(texts: list[str], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the negative log likelihood of its characters, and which non-ASCII ones are odd."""
    codes = _codes(["\x02\x02" + t for t in texts])
    values = -model.log_likelihood(codes)
    strange = (values > ODD) & (codes[2:] > 127)
    at = 0
    for t in texts:
        yield values[at : at + len(t)], strange[at : at + len(t)]
        at += len(t) + 2


#: What a round gave: the margin below which it is reached, the text, its chains, the gain in nats so far.
Round = tuple[float, str, str, float]


def restore_batch(texts: list[str | None], model: Model, margin: float = MARGIN) -> list[tuple[str, str, float] | None]:
    """``(restored text, chains, gain in nats)`` of each garbled text, None for the others."""
    return [rounds[-1][1:] if rounds else None for rounds in restore_rounds(texts, model, margin)]


def restore_rounds(texts: list[str | None], model: Model, margin: float = MARGIN) -> list[list[Round]]:
    """The rounds of each garbled text, an empty list for the others.

    The best option of a round does not depend on the margin, so at a greater one a text goes
    through the first of these rounds, as long as the margin is below what they need.
    """
    out: list[list[Round]] = [[] for _ in texts]
    current = {i: t for i, t in enumerate(texts) if t and not t.isascii()}
    gains: dict[int, float] = {}
    names: dict[int, list[str]] = {}
    for _ in range(DEPTH):
        if not current:
            break
        order = list(current)
        trials: list[tuple[int, int, int, str, str]] = []
        for i, (odd, strange) in zip(order, _oddness([current[i] for i in order], model), strict=True):
            known = names.get(i, [""])[-1].split(",")[0]
            if known or strange.any():
                trials += [(i, *t) for t in _trials(current[i], odd, strange, model.undone, known)]
        context = [(("\x02\x02" + current[i])[s : s + 2], current[i][e : e + 2]) for i, s, e, _, _ in trials]
        now = model.scores([a + current[i][s:e] + b for (i, s, e, _, _), (a, b) in zip(trials, context, strict=True)])
        after = model.scores([a + t[4] + b for t, (a, b) in zip(trials, context, strict=True)])
        alone = model.scores([a + t[4] for t, (a, _) in zip(trials, context, strict=True)])
        # what is UTF-8 throughout is hardly so by chance: each character adds to the evidence
        after = after + [UTF8_EVIDENCE * sum(c > "\x7f" for c in t[4]) if t[3].startswith("utf-8") else 0.0 for t in trials]
        by_text: dict[int, dict[str, list[tuple[float, int, int, str]]]] = {}
        for (i, s, e, chain, restored), x, y, z in zip(trials, now, after, alone, strict=True):
            if names.get(i) and restored.count(_LOST) > current[i][s:e].count(_LOST):
                continue  # a text that was restored is not given up for lost again
            if y - x > 1 and (chain.startswith("utf-8") or z >= PLAUSIBLE * len(restored)):
                by_text.setdefault(i, {}).setdefault(chain, []).append((float(y - x), s, e, restored))
        following = {}
        for i, chains in by_text.items():
            # the gain of a chain is that of the zones it restores, best ones first where they overlap
            options = []
            for chain, found in chains.items():
                kept: list[tuple[float, int, int, str]] = []
                for z in sorted(found, key=lambda z: (-z[0], z[1], z[2])):
                    if all(z[2] <= k[1] or z[1] >= k[2] for k in kept):
                        kept.append(z)
                options.append((sum(z[0] for z in kept), chain, kept))
            gain, chain, kept = max(options, key=lambda o: round(o[0], 6))  # of equal ones the first in CHAINS
            # a text that this chain is known to have garbled needs little evidence for its other zones
            known = names.get(i, [""])[-1] == chain
            if gain <= (2.0 if known else margin):
                continue
            text = current[i]
            for _, s, e, restored in sorted(kept, key=lambda z: -z[1]):
                text = text[:s] + restored + text[e:]
            gains[i] = gains.get(i, 0.0) + gain
            names.setdefault(i, []).append(chain)
            reach = min([r[0] for r in out[i]] + ([] if known else [gain]))
            out[i].append((reach, text, ", then ".join(names[i]), gains[i]))
            following[i] = text
        current = following
    return out


def garble(text: str, wrong: str, right: str) -> str | None:
    """``text`` with its bytes in ``right`` read as ``wrong``, where that can be done."""
    try:
        data = text.encode(right)
    except UnicodeEncodeError:
        return None
    table = _byte_of(wrong)
    if table is None:
        return data.decode(wrong, "replace")
    shown = {b: c for c, b in table.items()}
    return "".join(chr(b) if b < 128 else shown.get(b, _LOST) for b in data)


#: Bits of a code point in a gram.
_POINT = 21


def _frequent(grams: DataFrame, most: int) -> DataFrame:
    """The most frequent of ``gram, n``: all if they are at most ``most``, else those above the least count that leaves so many."""
    bin_ = F.floor(F.log2("n") * 64)
    least = 0
    for r in sorted(grams.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):  # 4,032 at most
        most -= r["count"]
        if most < 0:
            least = r["bin"] + 1
            break
    return grams.where(bin_ >= least)


def _train(rows: DataFrame, text: str) -> Model:
    """A model of all clean rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(text).to_pylist() if t and not _UNCLEAN.search(t)]
            if texts:
                codes = _codes(["\x02\x02" + t for t in texts]).astype(np.int64)
                grams, n = np.unique((codes[:-2] << 2 * _POINT) | (codes[1:-1] << _POINT) | codes[2:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], names=["gram", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, grams, n = (batch.column(c).to_numpy() for c in ("table", "gram", "n"))
            mask = (1 << _POINT) - 1
            slots = np.choose(order, _slots_of(grams >> 2 * _POINT, (grams >> _POINT) & mask, grams & mask))
            width = np.array(SLOTS)[order] // _SLICES
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (order * _SLICES + slots // width, slots % width, n)], names=["slice", "slot", "n"])

    def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in parts:
            for name, part in pdf.groupby("slice"):
                counts = np.bincount(part["slot"], weights=part["n"], minlength=SLOTS[name // _SLICES] // _SLICES)
                sums[name] = sums[name] + counts if name in sums else counts
        for name, part in sums.items():
            yield pd.DataFrame({"slice": [name], "counts": [part.astype(np.float32).tobytes()]})

    counted = rows.select(text).mapInArrow(count, "gram BIGINT, n BIGINT")
    three = written(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    two, one = (three.groupBy(F.col("gram").bitwiseAND((1 << bits) - 1).alias("gram")).agg(F.sum("n").alias("n")) for bits in (2 * _POINT, _POINT))
    scale = min(1.0, AS_MANY / max(1, three.agg(F.sum("n")).first()[0] or 0))
    # what comes to less than one is as good as unseen, and the slots of what was never seen stay empty
    kept = [*(_frequent(grams.where(F.col("n") * scale >= 1), int(FILLED * size)) for grams, size in zip((three, two), SLOTS[:2], strict=True)), one]
    tables = [k.select(F.lit(i).alias("table"), "gram", "n") for i, k in enumerate(kept)]
    placed = tables[0].union(tables[1]).union(tables[2]).mapInArrow(place, "slice BIGINT, slot BIGINT, n BIGINT")
    summed = placed.repartition("slice").mapInPandas(total, "slice BIGINT, counts BINARY")
    blobs = {r["slice"]: np.frombuffer(r["counts"], dtype=np.float32) for r in summed.collect()}  # 48 slices, 13 MB at every size
    drop_written(three)
    empty = [np.zeros(n // _SLICES, dtype=np.float32) for n in SLOTS for _ in range(_SLICES)]
    parts = [blobs.get(i, e) for i, e in enumerate(empty)]
    counts = [np.concatenate(parts[k * _SLICES : (k + 1) * _SLICES]) for k in range(len(SLOTS))]
    return Model.of([c * scale for c in counts])


#: Bins to a nat of the histogram of gains that the margin is taken from, and the nats it reaches to.
_BINS, _REACH = 100, 500
_ROUND = "STRUCT<reach: DOUBLE, restored: STRING, chain: STRING, gain: DOUBLE>"


def _tried(rows: DataFrame, model: Model) -> DataFrame:
    """``id, clean, rounds`` of every row of ``id, text`` that is clean or garbled, at the least margin.

    ``clean`` is a digest of a clean text, else null; ``rounds`` is null for a text that is no case.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    rounds_type = pa.list_(pa.struct([("reach", pa.float64()), ("restored", pa.string()), ("chain", pa.string()), ("gain", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # everything in the pattern is beyond ASCII
            clean = [blake2b(t.encode(), digest_size=16).digest() if t and (t.isascii() or not _UNCLEAN.search(t)) else None for t in texts]
            found = [[dict(zip(("reach", "restored", "chain", "gain"), r, strict=True)) for r in rounds] or None for rounds in restore_rounds(texts, shared.value)]
            kept = pa.array([i for i, (c, r) in enumerate(zip(clean, found, strict=True)) if c or r], pa.int32())
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in (batch.column("id"), pa.array(clean, pa.binary()), pa.array(found, rounds_type))], names=["id", "clean", "rounds"])

    return written(rows.mapInArrow(run, f"id {kind}, clean BINARY, rounds ARRAY<{_ROUND}>"), "tried")


def validated_margin(tried: DataFrame, most_wrong: float = MOST_WRONG) -> float:
    """The least margin beyond which hardly any of the clean records would be changed.

    All different clean texts count; their gains come to the driver as a histogram of fixed size.
    Where they are too few for a single wrong one, none may be wrong and the likelihood itself has
    to reach the odds that are asked for, three times over, as nothing was seen to bear them out.
    """
    gains = tried.where("clean IS NOT NULL").groupBy("clean").agg(F.max(F.element_at("rounds", -1)["gain"]).alias("gain"))
    bin_ = F.when(F.col("gain").isNotNull(), F.floor(F.least("gain", F.lit(_REACH)) * _BINS))
    bins = gains.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("gain").alias("most"))
    rows = bins.collect()  # one row for the texts without a gain, and 50,001 at most
    left = int(most_wrong * sum(r["n"] for r in rows))
    if not left:
        return max([-math.log(most_wrong / 3), *(r["most"] for r in rows if r["bin"] is not None)])
    for r in sorted((r for r in rows if r["bin"] is not None), key=lambda r: -r["bin"]):
        left -= r["n"]
        if left < 0:
            return r["most"]
    return MARGIN


def _cut(tried: DataFrame, margin: float) -> DataFrame:
    """``id, restored, chain, gain`` of the garbled rows at ``margin``."""
    reached = F.filter("rounds", lambda r: r["reach"] > margin)
    return tried.where(F.element_at("rounds", 1)["reach"] > margin).select("id", F.element_at(reached, -1).alias("r")).select("id", "r.restored", "r.chain", "r.gain")


def _rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))


def train(rows: DataFrame, text: str) -> tuple[Model, float]:
    """``(model, margin)``: all clean rows are counted, and the margin is validated on all of them."""
    model = _train(rows, text)
    tried = _tried(rows.select(F.lit(0).alias("id"), F.col(text).cast("string").alias("text")), model)
    margin = validated_margin(tried)
    drop_written(tried)
    return model, margin


def restore_own_encoding(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """:func:`restore_encoding` with what :func:`train` makes of the same rows; each is tried only once."""
    tried = _tried(_rows(df, row_id, text), _train(df, text))
    return _cut(tried, validated_margin(tried)).withColumnRenamed("id", row_id)


def restore_encoding(df: DataFrame, row_id: str, text: str, model: Model, margin: float) -> DataFrame:
    """``row_id, restored, chain, gain`` of the rows whose ``text`` was decoded with a wrong encoding.

    ``restored`` is the original as far as it can be had; what was lost stays U+FFFD. Null, empty
    and ASCII texts are no case. Repeated rows come out as often as they occur; other columns are
    not read. Narrow: the model, 13 MB at every size, is broadcast.
    """
    rows = _rows(df, row_id, text)
    shared = df.sparkSession.sparkContext.broadcast((model, margin))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = restore_batch(batch.column("text").to_pylist(), *shared.value)
            hit = [i for i, r in enumerate(found) if r]
            columns = [pa.array([found[i][k] for i in hit], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(hit, pa.int32())), *columns], names=["id", "restored", "chain", "gain"])

    return rows.mapInArrow(run, f"id {kind}, restored STRING, chain STRING, gain DOUBLE").withColumnRenamed("id", row_id)
