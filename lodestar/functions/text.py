"""Text, identity and hash expressions. All are Column expressions but the Unicode ones, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the name space of URL identifiers (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

NUL = "\0"


def nul_joined(*parts: Column | str | int) -> Column:
    """Parts joined by NUL; literals for anything that isn't a Column."""
    return F.concat_ws(NUL, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def sha_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def stable_rank(seed: int, *parts: Column | str) -> Column:
    """Hex digest by which rows are ranked, whatever order they come in."""
    return sha_hex(nul_joined(seed, *parts))


def seeded_ratio(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 64 bits of the seeded digest."""
    return F.conv(F.substring(stable_rank(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def revision_id(title: Column, body: Column) -> Column:
    return sha_hex(F.concat(title, F.lit(NUL), body))


def focus_text(title: Column, body: Column) -> Column:
    """Title and body, those that aren't empty, with a blank line between."""
    return F.array_join(F.filter(F.array(title, body), lambda x: x != ""), "\n\n")


def uuid5(name: Column) -> Column:
    """The name-based identifier (version 5) of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def tokens(c: Column) -> Column:
    """Runs of letters and numbers, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Runs of letters, numbers and underscores of text that is folded already."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: By rule: letters that lower case leaves as they are and full case folding doesn't, and what they fold to.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c.lower() == c != c.casefold()}


#: Those of everyday writing, which are always replaced; for the others a text is looked through first.
_COMMON = "ßςſﬁﬂ"


def casefold(c: Column) -> Column:
    """Text under full Unicode case folding, as far as the JVM's lower case knows the letters; null stays null."""
    low = F.lower(c)
    for letter in _COMMON:
        low = F.replace(low, F.lit(letter), F.lit(_FOLDS[letter]))
    rest = {a: b for a, b in _FOLDS.items() if a not in _COMMON}
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rest.items()])
    near = "".join(a for a in rest if ord(a) < 0x250)
    some = low.rlike(f"[{near}\\x{{250}}-\\x{{10FFFF}}]") & low.rlike(f"[{''.join(rest)}]")  # the first test is quick, and enough for Latin text
    return F.when(some, F.aggregate(pairs, low, lambda text, p: F.replace(text, p["a"], p["b"]))).otherwise(low)


def _plain() -> str:
    """The letters of a character class: those that are their own compatibility composition, join no neighbour, and fold to their lower case (or are ß)."""
    spans = [(0, 0x2FF), (0x370, 0x52F), (0x2010, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    plain = lambda c: unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and unicodedata.category(c) not in ("Cn", "Mn", "Mc", "Me") and c not in "Σσς" and (c == "ß" or (c.casefold() == c.lower() and len(c.lower()) == 1))
    found = [k for lo, hi in spans for k in range(lo, hi + 1) if plain(chr(k))]
    starts = [k for k, before in zip(found, [-2, *found], strict=False) if k != before + 1]
    ends = [k for k, after in zip(found, [*found[1:], -2], strict=True) if after != k + 1]
    few = [(a, b) for a, b in zip(starts, ends, strict=True) if b - a >= (4 if a < 0x130 or 0x2010 <= a < 0x2024 else 20)]  # a class of many spans is slow
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in few)


_PLAIN = _plain()


@F.arrow_udf(StringType())
def _folded(column: pa.Array) -> pa.Array:
    """Compatibility-composed and case-folded; null stays null. A few rows at a time become Python texts."""
    one = lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold()
    parts = [pa.array([one(x) for x in column.slice(k, 64).to_pylist()], pa.string()) for k in range(0, len(column), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc_casefold(c: Column) -> Column:
    """Compatibility-composed and case-folded; null becomes the empty text. Only texts with letters for which that is more than the lower case go to Python."""
    latin = r"[^\x00-\x9F\xA1-\xA7\xBF-\x{12F}]"  # the first tests are quick, and enough for Latin text
    odd = (F.octet_length(c) != F.char_length(c)) & c.rlike(latin) & c.rlike(f"[^{_PLAIN}]")
    return F.coalesce(_folded(F.when(odd, c)), F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(""))


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Letters without their diacritics, in lower case."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c)) if isinstance(x, str) else None)


def fold(c: Column, unicode: bool = True) -> Column:
    """Identity text: nfkc_casefold, or plain lower case, which agrees for text that has no compatibility forms."""
    return nfkc_casefold(c) if unicode else F.lower(F.coalesce(c, F.lit("")))


def shingles(words: Column, n: int) -> Column:
    """Different hashes of the runs of n words, in order; empty if there are fewer. Each word is hashed once."""

    def runs(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - n + 1, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))  # an array of one array: so the hashes are a variable below
    return F.array_sort(F.array_distinct(F.transform(hashed, runs)[0]))


def ordered_digest(rows: Column, *order: Column) -> Column:
    """An aggregate: the digest of row texts joined by line feeds in a given order. For tables of control size."""
    return sha_hex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], rows.alias("row")))), lambda x: x["row"]), "\n"))


def json_bytes(*columns: str) -> Column:
    """An aggregate: bytes of the rows as JSON lines."""
    return F.sum(F.octet_length(F.to_json(F.struct(*columns))) + 1)
