"""Personal data in texts and pages: scrubbing, checking, visible text, evidence hashes, product data in JSON-LD."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[scrubbed]"

# The rules in the order in which they apply, street suffixes, a store's label, tags that go and attributes that stay.
SUFFIXES = "St Street Ave Avenue Rd Road Blvd Boulevard Dr Drive Ln Lane Way Pkwy Parkway Hwy Highway Pike Ct Court Pl Place Ter Terrace Cir Circle Tpke Turnpike Plaza Sq Square".split()
_suffix = "|".join([*SUFFIXES, *map(str.upper, SUFFIXES)])
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "greeting": r"\b(?:[Hh]i|[Hh]ello|[Hh]ey|[Ww]elcome [Bb]ack)\b,?\s+[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?![a-z])",
    "address": rf"\b\d{{1,6}}\s+(?:[NSEW]\.?\s+)?[A-Z][A-Za-z0-9.'-]*(?:\s+[A-Z][A-Za-z0-9.'-]*){{0,4}}\s+(?:{_suffix})\.?(?:\s+\d{{1,5}})?(?![A-Za-z])",
    "phone": r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?\d{3}[\s.-]\d{4}|\b\d{3}([\s.-])\d{3}\1\d{4})\b",
    "zip": r"\b\d{5}(?:-\d{4})?\b",
}
STORE_LABEL = r"^(\s*)(?:.*?,\s*)?([A-Za-z][A-Za-z .'&-]*?)\s*,\s*(?:[A-Z]{2}\s*,?\s*)?\d{5}(?:-\d{4})?(\s*)$"
DROPPED = frozenset("script style link meta iframe svg img noscript template".split())
KEPT_ATTRIBUTES, SELECTORS = frozenset(["id", "class", "href", "itemprop"]), frozenset(["id", "class"])


def name_rule(names: list[str]) -> str | None:
    cleaned = [re.escape(n.strip()) for n in names if n.strip()]
    return rf"(?i)[A-Za-z0-9_'.-]*(?:{'|'.join(cleaned)})[A-Za-z0-9_'.-]*" if cleaned else None


def rules(names: list[str] = (), selector: bool = False) -> dict[str, str]:
    own = {k: v for k, v in RULES.items() if not selector or k in ("email", "greeting")}
    return own | ({"name": p} if (p := name_rule(list(names))) else {})


def scrub_text(text: Column, names: list[str] = (), selector: bool = False) -> Column:
    """A text with personal data replaced by a mark; a store label that ends in a ZIP code becomes its city."""
    out = text if selector else F.regexp_replace(text, STORE_LABEL, "$1$2$3")
    for pattern in rules(names, selector).values():
        out = F.regexp_replace(out, pattern, r"\[scrubbed\]")
    return out


def violations(rows: DataFrame, key: str, text: str, names: list[str] = ()) -> DataFrame:
    """One row for each rule that finds something: key, rule, first (its first hit), hits, sample (it with up to 20 characters on each side)."""
    found = F.array(*(F.struct(F.lit(rule).alias("rule"), F.regexp_extract_all(text, F.lit(p), 0).alias("all")) for rule, p in rules(names).items()))
    hits = rows.select(key, F.col(text).alias("_text"), F.explode(found).alias("v")).where(F.size("v.all") > 0)
    first = F.get("v.all", F.lit(0))
    at = F.instr("_text", first)
    begin = F.greatest(at - 20, F.lit(1))
    return hits.select(key, "v.rule", first.alias("first"), F.size("v.all").alias("hits"), F.substring("_text", begin, at + F.length(first) + 20 - begin).alias("sample"))


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments, white space collapsed; character references stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


class _Scrubber(HTMLParser):
    """Writes a page anew without dropped elements, comments, other attributes and personal data."""

    def __init__(self, names: list[str]):
        super().__init__(convert_charrefs=True)
        self.out, self.deep, self.names = [], 0, names
        self.full, self.light = ([re.compile(p) for p in rules(names, s).values()] for s in (False, True))

    def clean(self, text: str, selector: bool = False) -> str:
        if not selector and (m := re.match(STORE_LABEL, text)):
            text = m[1] + m[2] + m[3]
        for p in self.light if selector else self.full:
            text = p.sub(MARK, text)
        return text

    def handle_starttag(self, tag, attrs):
        from html import escape

        if tag in DROPPED:
            self.deep += tag not in ("link", "meta", "img")
        elif not self.deep:
            kept = []
            for k, v in attrs:
                if k == "href":
                    if re.match(r"(?i)\s*(mailto|tel|sms|javascript|data|blob):", v or "") or not (v or "").strip() or v.strip().startswith("#"):
                        continue
                    v = re.sub(r"[?#].*$", "", re.sub(r"(?i)^(https?:)?//[^/?#]*", "", v.strip())) or "/"
                if k in KEPT_ATTRIBUTES or k.startswith(("data-", "aria-")):
                    kept.append(f' {k}="{escape(self.clean(v or "", k in SELECTORS))}"')
            self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.deep = max(0, self.deep - (tag not in ("link", "meta", "img")))
        elif not self.deep:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        from html import escape

        if not self.deep:
            self.out.append(escape(self.clean(data), quote=False))


class _Checker(HTMLParser):
    """Collects what a scrubbed page may not have: (rule, where, sample)."""

    def __init__(self, names: list[str]):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.full, self.light = ({k: re.compile(p) for k, p in rules(names, s).items()} for s in (False, True))

    def look(self, text: str, where: str, selector: bool = False) -> None:
        for rule, p in (self.light if selector else self.full).items():
            self.found += [(rule, where, text[max(0, m.start() - 20) : m.end() + 20]) for m in p.finditer(text)]

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.found.append(("dropped-tag", "tag", f"<{tag}>"))
        for k, v in attrs:
            v = v or ""
            if not (k == "href" or k in KEPT_ATTRIBUTES or k.startswith(("data-", "aria-"))):
                self.found.append(("attribute", f"attr:{k}", f"<{tag} {k}>"))
                continue
            if k == "href" and not re.fullmatch(r"/[^?#]*", v):
                self.found.append(("href", "attr:href", v[:80]))
            self.look(v, f"attr:{k}", k in SELECTORS)

    def handle_comment(self, data):
        self.found.append(("comment", "tag", "<!-- -->"))

    def handle_data(self, data):
        self.look(data, "text")


def page_violations(html: Column, names: list[str] = ()) -> Column:
    """Every way in which a page isn't scrubbed: array of (rule, where, sample); empty for a clean one."""
    own = list(names)

    @F.pandas_udf("array<struct<rule:string,where:string,sample:string>>")
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            c = _Checker(own)
            c.feed(page or "")
            c.close()
            return [{"rule": a, "where": b, "sample": s} for a, b, s in c.found]

        return pages.map(one)

    return run(html)


META = "retailer string, sessionState string, store struct<label:string>, expected struct<priceText:string,title:string,price:struct<amountMinor:bigint>>"
MOST_BYTES = 400 * 1024


def fixture_problems(pages: DataFrame, names: list[str] = ()) -> DataFrame:
    """path, problem for pages(path, html, meta): recorded pages with the JSON of what is expected of them, or null."""
    m, part = F.from_json("meta", META), F.split("path", "/")
    slug = F.regexp_replace(F.element_at(part, -1), r"\.html$", "")
    text, cents = visible_text(F.col("html")), F.round(F.regexp_replace("m.expected.priceText", r"[^0-9.]", "").try_cast("double") * 100)
    lacks = lambda c: ~F.contains(text, F.coalesce(c, F.lit("")))
    rows = pages.withColumns({"m": m, "broken": page_violations(F.col("html"), names)})
    bad = F.transform("broken", lambda v: F.concat(v["rule"], F.lit(" in "), v["where"], F.lit(": "), v["sample"]))
    there = F.col("meta").isNotNull()
    told = F.array(
        F.when(F.octet_length("html") > MOST_BYTES, F.lit(f"over {MOST_BYTES} bytes")), F.when(~there, "no sidecar"), F.when(there & F.col("m.retailer").isNull(), "sidecar without a retailer"),
        F.when(there & (F.element_at(part, -2) != F.col("m.retailer")), "retailer and folder disagree"), F.when(there & (slug.endswith("-logged-out") != (F.col("m.sessionState") == "logged_out")), "name and session disagree"),
        F.when(there & lacks(F.col("m.expected.priceText")), "price text not on the page"), F.when(there & lacks(F.col("m.expected.title")), "title not on the page"),
        F.when(there & (cents != F.col("m.expected.price.amountMinor")), "price text and amount disagree"), F.when(there & F.col("m.store.label").rlike(r"\d{5}"), "store label has a full ZIP code"),
    )
    return rows.select("path", F.explode(F.concat(F.array_compact(told), bad)).alias("problem"))


def scrub_html(html: Column, names: list[str] = ()) -> Column:
    """A page scrubbed element by element, in Arrow batches; its SHA-256 is the evidence hash."""
    own = list(names)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            s = _Scrubber(own)
            s.feed(page)
            s.close()
            return "".join(s.out)

        return pages.map(one)

    return run(html)


def evidence_hash(html: Column, names: list[str] = ()) -> Column:
    return F.sha2(scrub_html(html, names), 256)


PRODUCT = "array<struct<sku:string,name:string,brand:string,gtin:string,price:string,currency:string>>"


def _products(node, found: list) -> None:
    if isinstance(node, list):
        for x in node:
            _products(x, found)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if kind == "Product" or isinstance(kind, list) and "Product" in kind:
            offer = node.get("offers")
            offer = (offer[0] if offer else None) if isinstance(offer, list) else offer
            offer = offer if isinstance(offer, dict) else {}
            brand = node.get("brand")
            text = lambda v: None if v is None or isinstance(v, (dict, list)) else str(v)
            price = offer.get("price", offer.get("lowPrice"))
            if text(price) is not None and offer.get("priceCurrency", "USD") == "USD":
                gtin = next((node[k] for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin") if k in node), None)
                found.append((text(node.get("sku")), text(node.get("name")), text(brand.get("name") if isinstance(brand, dict) else brand), text(gtin), text(price), "USD"))
        for k, v in node.items():
            if k == "@graph" or isinstance(v, (dict, list)) and k in ("mainEntity", "itemListElement", "item"):
                _products(v, found)


def json_ld_products(html: Column) -> Column:
    """The products that a page's JSON-LD scripts describe (bare, in arrays, in graphs); a script that is no JSON counts for none."""
    script = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.S | re.I)

    @F.pandas_udf(PRODUCT)
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            found: list = []
            for text in script.findall(page or ""):
                try:
                    _products(json.loads(text), found)
                except ValueError:
                    continue
            return [dict(zip(("sku", "name", "brand", "gtin", "price", "currency"), f, strict=True)) for f in found]

        return pages.map(one)

    return run(html)


def forbidden_keys(document: Column, names: list[str]) -> Column:
    """Paths (a.b[0].c) of keys of a JSON document that must not be there, at any depth."""
    wanted = {n.lower() for n in names}

    @F.pandas_udf("array<string>")
    def run(docs: pd.Series) -> pd.Series:
        def walk(v, path, out):
            if isinstance(v, dict):
                for k, x in v.items():
                    at = f"{path}.{k}" if path else k
                    if k.lower() in wanted:
                        out.append(at)
                    walk(x, at, out)
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    walk(x, f"{path}[{i}]", out)
            return out

        def one(text):
            try:
                return walk(json.loads(text), "", []) if text else []
            except ValueError:
                return []

        return docs.map(one)

    return run(document)


def collected_tiles(tiles: DataFrame, key: tuple[str, ...] = ("page_id",), url: str = "url", position: str = "position") -> DataFrame:
    """The first tile of each product URL on a page."""
    rest = [c for c in tiles.columns if c not in (*key, url)]
    got = tiles.groupBy(*key, url).agg(F.min_by(F.struct(*rest), position).alias("t"))
    return got.select(*key, url, *(F.col("t")[c].alias(c) for c in rest))


def capture_outcome(extracted: DataFrame) -> DataFrame:
    """Rows (session, rendering key, reason) with outcome stored, duplicate or extract_failed: a rendering counts once in a session."""
    first = extracted.where("reason is null").groupBy("session", "rendering").agg(F.min("position").alias("first"))
    told = extracted.join(first, ["session", "rendering"], "left")
    return told.withColumn("outcome", F.when(F.col("reason").isNotNull(), "extract_failed").when(F.col("position") == F.col("first"), "stored").otherwise("duplicate")).drop("first")
