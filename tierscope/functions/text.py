"""Tokens of product titles, and small text rules."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without identity, and words of which one side alone makes another product.
STOPWORDS = "a an the of and or with by for in to per on at from sold".split()
VARIANT_FORM = "organic frozen dried freeze dehydrated sliced whole puree powder plantain mini baby seedless ultra filtered".split()
VARIANT_NUTRITION = "skim nonfat 1pct 2pct lactose lacfree unsweetened sweetened decaf diet zero light lite reduced low enriched fortified calcium protein omega dha".split()
VARIANT_FLAVOUR = "chocolate vanilla strawberry berry blueberry raspberry cherry cinnamon apple peach mango lemon grape pistachio caramel kale".split()
VARIANTS = VARIANT_FORM + VARIANT_NUTRITION + VARIANT_FLAVOUR


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What NFKD makes of characters whose decomposition holds ASCII letters, digits or percent signs, marks left out: those that
    become one character with, behind them, the marks themselves; what they become (marks: nothing); and those that become several."""
    one, several, marks = {}, {}, []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0100, 0xE01F0)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if not d:
            marks.append(c)
        elif d != c and re.search("[0-9A-Za-z%]", d):
            (one if len(d) == 1 else several)[c] = d
    return "".join([*one, *marks]), "".join(one.values()), several


MARKED, PLAIN, SEVERAL = _plain_letters()


def decomposed(text: Column) -> Column:
    """NFKD without marks, as far as ASCII letters, digits and percent signs come of it (what else there is separates words). Only texts with
    other characters than ASCII are translated, and only those with a character that becomes several are taken apart."""
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{d}" for c, d in SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    whole = F.when(text.rlike("[" + "".join(SEVERAL) + "]"), apart).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(whole, MARKED, PLAIN)).otherwise(text)


def stem(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.rlike("s$") & ~word.rlike("(ss|us)$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def tokenize(text: Column) -> Column:
    """Words of a text in order, repeats kept."""
    plain = F.regexp_replace(text, "[\\u2122\\u00AE\\u00A9]", " ")
    plain = F.replace(F.lower(decomposed(plain)), F.lit("%"), F.lit("pct"))
    words = F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS)), stem)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two token arrays; 1 when both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def variant_conflict(a: Column, b: Column) -> Column:
    one_side = F.array_union(F.array_except(a, b), F.array_except(b, a))
    return F.arrays_overlap(one_side, F.array(*map(F.lit, VARIANTS)))


def normal_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_email(c: Column) -> Column:
    """One @ with something before it, a dot inside the domain, no white space, at most 254 characters."""
    domain = F.substring_index(c, "@", -1)
    dot = F.call_function("locate", F.lit("."), domain)
    return F.coalesce(c.rlike(r"^[^@\s]+@[^@\s]+$") & (F.length(c) <= 254) & (dot > 1) & (dot < F.length(domain)), F.lit(False))
