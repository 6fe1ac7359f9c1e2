"""One form for texts that look the same.

DuckDB runs inside the Arrow partitions: ``nfc_normalize`` composes accents, ``translate`` maps
single characters, and guarded replacements expand joined forms. The tables behind them follow
from the Unicode character data by the rules below; only look-alike letters, spaces-and-hyphens
and a few exceptions are stated as fixed values.

What folds: width, compatibility and presentation forms, ligatures, radicals, font variants,
composition of accents, invisible characters, kinds of space and of hyphen, and letters of
other scripts drawn like Latin ones. What stays: case, accents, digits, raised, lowered,
circled, parenthesised and fraction signs, and quotation marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the letters they look like.
LOOK_ALIKE = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮҺԌԚԜӀ", "ABESIJKMHOPCTYXYhGQWI"),
    ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ονϲϳ", "ovcj"),
    # Greek and Cyrillic capitals without a Latin twin
    ("ГПФ", "ΓΠΦ"),
    # Armenian
    ("ՕՏսհոցօ", "OSuhngo"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏚᏙᏞᏟᏢᏦ", "DRTAJEWMHGZWSVLCPK"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Coptic
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
)
# Kinds of hyphen (the dashes, which are longer, are not among them).
HYPHENS = "‐‑‒⁃−﹣－"
# Signs whose compatibility form looks different, or that stand for an accent alone.
EXCEPTIONS = "ſẛϐϑϒϓϔϕϖϰϱϴϵ϶"
# Invisible characters that are not format characters by category.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
#: Decompositions of these kinds are visible; all others are the same letter in another form.
VISIBLE_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
#: Blocks whose mapped characters are usual: spaces and format characters, Cyrillic and Greek letters, full-width ASCII.
_USUAL = ((0xA0, 0x100), (0x386, 0x3F0), (0x400, 0x530), (0x2000, 0x2070), (0x3000, 0x3001), (0xFEFF, 0xFF5F))
#: Code points that DuckDB is given at once, and its bound of memory.
SLICE, MEMORY = 4_000_000, "512MB"
_RANGES = ((0xA0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0xE0000, 0xE01F0))


def _form(char: str, letters: dict[str, str]) -> str:
    """The folded form of one character."""
    kind = unicodedata.category(char)
    if kind == "Cf" or char in INVISIBLE or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    if char in HYPHENS:
        return "-"
    parts = unicodedata.decomposition(char).split()
    if parts and parts[0].startswith("<"):
        target = "".join(chr(int(p, 16)) for p in parts[1:])
        alone = len(target) > 1 and target.startswith((" ", "("))  # an accent of its own, a letter in brackets
        if parts[0] in VISIBLE_KINDS or char in EXCEPTIONS or alone:
            return char
        return unicodedata.normalize("NFC", "".join(_form(c, letters) for c in target))
    if parts:
        return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", char)))
    return letters.get(char, char)


@cache
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """``(from, to, expansions)``: single characters by position (those past the end of ``to`` vanish)."""
    letters = {a: b for left, right in LOOK_ALIKE for a, b in zip(left, right, strict=True)}
    single, gone, longer = [], [], []
    for begin, end in _RANGES:
        for code in range(begin, end):
            char = chr(code)
            form = _form(char, letters)
            if form == char:
                continue
            if not form:
                gone.append(char)
            elif len(form) == 1:
                single.append((char, form))
            else:
                longer.append((char, form))
    return "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single), tuple(longer)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters: str) -> str:
    return "[" + characters + "]"


@cache
def marked() -> str:
    """The pattern of the characters that expand."""
    return _class("".join(c for c, _ in tables()[2]))


@lru_cache(maxsize=64)
def fold_sql(column: str, present: frozenset[str] | None = None) -> str:
    """The DuckDB expression of the one form of ``column``.

    Of the expansions only those of characters ``present`` are stated, by default all: to plan
    some 800 replacements takes longer than to run them. ``translate`` reads its whole table for every value, so values are told apart by what they
    contain: ASCII only, mapped characters of the usual blocks, other mapped ones, expansions.
    """
    source, target, longer = tables()
    usual = [i for i, c in enumerate(source) if any(a <= ord(c) < b for a, b in _USUAL)]
    small = "".join(source[i] for i in usual), "".join(target[i] for i in usual if i < len(target))
    seldom = _class("".join(c for c in source if c not in small[0]))
    expanded = column
    for char, form in longer:
        if present is None or char in present:
            expanded = f"replace({expanded}, {_quoted(char)}, {_quoted(form)})"

    def mapped(text: str, pair: tuple[str, str]) -> str:
        return f"nfc_normalize(translate(nfc_normalize({text}), {_quoted(pair[0])}, {_quoted(pair[1])}))"

    return f"""CASE WHEN NOT regexp_matches({column}, '[^\x00-\x7F]') THEN {column}
        WHEN regexp_matches({column}, {_quoted(marked())}) THEN {mapped(expanded, (source, target))}
        WHEN regexp_matches(nfc_normalize({column}), {_quoted(seldom)}) THEN {mapped(column, (source, target))}
        ELSE {mapped(column, small)} END"""


def visual_forms(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys...`` and each of ``texts`` in its one form, under the same names.

    Null stays null and empty stays empty; rows are neither dropped nor merged. Other columns
    are not read. Narrow: no shuffle, and DuckDB sees one Arrow batch at a time.
    """
    rows = df.select(*keys, *[F.col(t).cast("string").alias(t) for t in texts])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *texts])
    aliases = [f"t{i}" for i in range(len(texts))]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.cumsum(sum(pc.fill_null(pc.utf8_length(batch.column(t)), 0).to_numpy().astype(np.int64) for t in texts))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                yield batch.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        found = " UNION ".join(f"SELECT unnest(regexp_extract_all({a}, {_quoted(marked())})) AS c FROM part WHERE {a} IS NOT NULL" for a in aliases)
        for batch in parted(batches):
            part = pa.table([batch.column(t) for t in texts], names=aliases)
            con.register("part", part)
            present = frozenset(r[0] for r in con.sql(found).fetchall())
            done = con.sql("SELECT " + ", ".join(f"{fold_sql(a, present)} AS {a}" for a in aliases) + " FROM part").to_arrow_table()
            con.unregister("part")
            arrays = [batch.column(k) for k in keys] + [done.column(a).combine_chunks().cast(pa.string()) for a in aliases]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *texts])

    return rows.mapInArrow(run, schema)
