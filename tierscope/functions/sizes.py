"""Sizes in product texts: millilitres, grams and counts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SIZE_TOLERANCE

# Unit spellings and factors.
FL_OZ, GALLON, QUART, PINT, OUNCE, POUND = 29.5735, 3785.41, 946.353, 473.176, 28.3495, 453.592
SPELLINGS = {
    ("ml", FL_OZ): "floz",  # and "fl oz", "fluid ounce", "fluid ounces", which are two words
    ("ml", GALLON): "gallons|gallon|gal",
    ("ml", QUART): "quarts|quart|qt",
    ("ml", PINT): "pints|pint|pt",
    ("ml", 1.0): "milliliters|millilitres|ml",
    ("ml", 1000.0): "liters|litres|liter|litre|l",
    ("g", OUNCE): "ounces|ounce|oz",
    ("g", POUND): "pounds|pound|lbs|lb",
    ("g", 1000.0): "kilograms|kg",
    ("g", 1.0): "grams|gram|g",
    ("ct", 1.0): "count|ct|pk|pack|pcs|pieces|each|ea",
}
UNITS = {name: unit for unit, names in SPELLINGS.items() for name in names.split("|")}

# Words that are followed by "of" and a count, and words for parts of a measure.
HOLDERS = "pack packs case cases set sets bag bags boxes bottles cans pouches tubs".split()
PARTS = {"half gallon": GALLON / 2, "quarter gallon": GALLON / 4, "half pint": PINT / 2}


#: A text as tokens: what stands before, and a number or a word. The last token may be what stands before nothing.
TOKEN = r"(?i)[^a-z0-9]*(?:\d+(?:[.,]\d+)?|[a-z]+|$)"
SIZE = "struct<ml:double,g:double,ct:double>"
FOUND = "struct<rank:int,at:int,length:int,kind:string,value:double>"


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(text: Column) -> Column:
    """array of tokens: whole, before, word, its number and unit where it is one, and how it stands to the one before."""
    units = _table({n: f"named_struct('kind', '{d}', 'factor', {f}D)" for n, (d, f) in UNITS.items()})

    def token(whole: Column, before: Column, word: Column) -> Column:
        spaces = {"spaced": r"\s+", "hyphened": r"\s*-?\s*", "one_space": " ", "dotted": r"\.? ?", "dashed": r"[\s-]*", "over": r"\s*/\s*"}
        number = F.replace(word, F.lit(","), F.lit(".")).try_cast("double")
        return F.struct(
            whole.alias("whole"), before.alias("before"), word.alias("word"), number.alias("number"), F.when(word.rlike(r"^\d+$"), number).alias("whole_number"), F.element_at(units, word).alias("unit"),
            (~before.rlike("[._]$|^$")).alias("apart"), (~before.rlike("^[._]|^$") | (word == "")).alias("ends"), *(before.rlike(f"^(?:{p})$").alias(name) for name, p in spaces.items()),
        )

    before = lambda x: F.regexp_extract(x, "^[^A-Za-z0-9]*", 0)
    parted = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.struct(x.alias("whole"), before(x).alias("before"), F.lower(x.substr(F.length(before(x)) + 1, F.length(x))).alias("word")))
    return F.transform(parted, lambda x: token(x["whole"], x["before"], x["word"]))


def _table(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")")


def _words(*words: str) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def _found_at(t: Column, i: Column) -> Column:
    """What the rules read from the token i on, one candidate for each rule that fits; a lower rank goes first."""
    x = cache(lambda k: F.get(t, i + k))
    word, number, whole = (cache(lambda k, c=c: x(k)[c]) for c in ("word", "number", "whole_number"))
    own = x(0)["apart"] | ((i == 0) & (x(0)["before"] == ""))  # a number of its own, no end of another
    ended = lambda k: F.coalesce(x(k + 1)["ends"], F.lit(True))
    pack_words, each_words = _words("pack", "packs"), _words("each", "ea")
    packs, is_each = (lambda k: F.array_contains(pack_words, word(k))), (lambda k: F.array_contains(each_words, word(k)))
    each, one, names = F.lit("ct"), F.lit(1.0), [F.lit(c) for c in ("rank", "at", "length", "kind", "value")]
    free = own & whole(0).isNotNull()

    def read(rank: int, fits: Column, length: int, kind: Column, value: Column) -> Column:
        return F.when(fits, F.named_struct(names[0], F.lit(rank), names[1], i, names[2], F.lit(length), names[3], kind, names[4], value))

    def unit(k: int, value: Column, fits: Column) -> list[Column]:
        """A number whose unit begins k tokens further: a unit of two words, else of one."""
        fluid = (word(k) == "fl") & (word(k + 1) == "oz") & x(k + 1)["dotted"] | (word(k) == "fluid") & word(k + 1).isin("ounce", "ounces") & x(k + 1)["one_space"]
        unit = x(k)["unit"]
        return [read(4, fits & x(k)["hyphened"] & fluid, k + 2, F.lit("ml"), value * FL_OZ), read(4, fits & x(k)["hyphened"] & unit.isNotNull(), k + 1, unit["kind"], value * unit["factor"])]

    part = F.concat(word(0), F.lit(" "), F.when(word(1) == "gal", "gallon").otherwise(word(1)))
    fused = F.regexp_replace(F.regexp_replace(word(0), "gal$", "gallon"), "^(half|quarter)", "$1 ")
    parts = _table({n: f"{v}D" for n, v in PARTS.items()})
    candidates = [
        read(0, x(1)["dashed"] & F.element_at(parts, part).isNotNull(), 2, F.lit("ml"), F.element_at(parts, part)),
        read(0, F.element_at(parts, fused).isNotNull(), 1, F.lit("ml"), F.element_at(parts, fused)),
        read(1, F.array_contains(_words(*HOLDERS), word(0)) & (word(1) == "of") & x(1)["spaced"] & x(2)["spaced"] & whole(2).isNotNull() & ended(2), 3, each, whole(2)),
        read(2, free & x(1)["hyphened"] & packs(1), 2, each, whole(0)),
        read(2, free & x(1)["hyphened"] & (word(1) == "per") & x(2)["one_space"] & (word(2) == "case"), 3, each, whole(0)),
        read(3, packs(0) & x(1)["spaced"] & whole(1).isNotNull() & ended(1), 2, each, whole(1)),
        *unit(2, F.try_divide(whole(0), whole(1)), free & whole(1).isNotNull() & x(1)["over"]),
        *unit(1, number(0), number(0).isNotNull() & own),
        read(5, (word(0) == "sold") & (word(1) == "by") & (word(2) == "the") & is_each(3) & x(1)["one_space"] & x(2)["one_space"] & x(3)["one_space"], 4, each, one),
        read(5, is_each(0), 1, each, one),
    ]
    firsts = sorted({p.split()[0] for p in PARTS} | set(HOLDERS) | {"pack", "packs", "sold", "each", "ea"} | {a + b for a in ("half", "quarter") for b in ("gal", "gallon", "pint")})
    return F.when(number(0).isNotNull() | F.array_contains(_words(*firsts), word(0)), F.filter(F.array(*candidates).cast(f"array<{FOUND}>"), lambda c: c.isNotNull())).otherwise(F.array().cast(f"array<{FOUND}>"))


def parse_size(text: Column) -> Column:
    """struct(size: {ml, g, ct}, rest): the first value above zero of each dimension, and the text without what was read.

    A rule of lower rank takes its tokens before any of a higher one, and one rule from left to right; no token is taken twice."""
    meet = lambda a, b: (a["at"] < b["at"] + b["length"]) & (b["at"] < a["at"] + a["length"])

    def read(t: Column) -> Column:
        all_found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(t)), lambda i: _found_at(t, i))), lambda a, b: F.coalesce(*(F.when(a[c] < b[c], -1).when(a[c] > b[c], 1) for c in ("rank", "at")), b["length"] - a["length"]))
        taken = F.aggregate(all_found, F.array().cast(f"array<{FOUND}>"), lambda took, c: F.when(F.exists(took, lambda o: meet(o, c)), took).otherwise(F.concat(took, F.array(c))))
        return _bound(taken, lambda took: F.struct(size(took).alias("size"), rest(t, took).alias("rest")))

    def size(took: Column) -> Column:
        first = lambda d: F.get(F.filter(took, lambda c: (c["kind"] == d) & (c["value"] > 0)), F.lit(0))["value"]
        return F.struct(*(first(d).alias(d) for d in ("ml", "g", "ct")))

    def rest(t: Column, took: Column) -> Column:
        inside = lambda i: F.exists(took, lambda c: (c["at"] <= i) & (i < c["at"] + c["length"]))
        begins = lambda i: F.exists(took, lambda c: c["at"] == i)
        return F.array_join(F.transform(t, lambda x, i: F.when(begins(i), F.concat(x["before"], F.lit(" "))).when(inside(i), F.lit(" ")).otherwise(x["whole"])), "")

    return _bound(_tokens(text), read)


@cache
def sizes_in(texts: str) -> Column:
    """parse_size of each text of an array column; the rules are a large expression, so it is put together once."""
    return F.transform(texts, parse_size)


def merge_sizes(a: Column, b: Column) -> Column:
    return F.struct(*(F.coalesce(a[d], b[d]).alias(d) for d in ("ml", "g", "ct")))


def compare_sizes(a: Column, b: Column) -> Column:
    """'conflict', 'agree' or 'unknown': volumes and weights within 3% of the larger; a missing count is one."""
    near = lambda d: F.abs(a[d] - b[d]) <= SIZE_TOLERANCE * F.greatest(a[d], b[d])
    both = lambda d: a[d].isNotNull() & b[d].isNotNull()
    x, y = F.coalesce(a["ct"], F.lit(1.0)), F.coalesce(b["ct"], F.lit(1.0))
    counts = F.abs(x - y) > SIZE_TOLERANCE * F.greatest(x, y)
    apart = F.coalesce(both("ml") & ~near("ml"), F.lit(False)) | F.coalesce(both("g") & ~near("g"), F.lit(False)) | counts
    return F.when(apart, "conflict").when(both("ml") | both("g") | both("ct"), "agree").otherwise("unknown")


def size_key(size: Column) -> Column:
    return F.concat_ws("+", *(F.concat(F.floor(size[d] + 0.5).cast("long").cast("string"), F.lit(d)) for d in ("ml", "g", "ct")))


def has_size(size: Column) -> Column:
    return F.coalesce(size["ml"], size["g"], size["ct"]).isNotNull()
