"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand (the block they are in, a link, a
named zone), tags by their name and never above zero; the weights are log-odds counted by Spark over labelled
pages, which are pages whose markup names its article. A linear scan finds the contiguous region with the
highest total. Its text, less what lies in parts that are no article text whatever they score (SKIP and
ZONES below), is returned block by block. A form or a part with a zone's word in its class is left in where it wraps the page: it
holds half of the words or more, and no article, main or first heading is beside it. A class such as `legal analysis` names a zone only by its links,
and the id of a heading or paragraph never does.

A page is parsed in one pass with work in proportion to its length: open elements are found by name, not by search, and
after one tag that never ends the quotes of later tags are ignored.

The labelled sample is bounded: at most SAMPLE pages, the first by a hash of page_id. All pages are scored whole.

Defined cases: a null html is empty and has empty text; a page where nothing scores above zero has empty text;
unclosed and stray tags are allowed; repeated rows are each returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SAMPLE = 4000
#: Elements that leave a line of text whole; all others end a block.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mtable mtr mtd mspace mstyle mpadded mphantom".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, and elements that are no part of an article.
RAW = "script|style|noscript|template|textarea|select|iframe|svg|object|canvas|annotation|annotation-xml"
SKIP = frozenset("nav footer aside button dialog menu head title header".split())
LANDMARKS = ("article", "main", "h1")
#: Names that weights tell apart; all others are one.
KNOWN = INLINE | SKIP | frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre hr address details summary fieldset legend form center link meta".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("p div ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 section article main aside nav header footer form pre blockquote figure figcaption hr address details fieldset".split())
#: Words in a class, id or role that name such a part.
ZONES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|nav\w*|menu\w*|breadcrumbs?|side-?bar|widget\w*|related|recommend\w*|share\w*|sharing|social|comments?\w*|respond|replies|disqus|footer|masthead|site-header|page-header|toolbar|pagination|pager|tags|search|login|legal|copyright)(?:$|[\s_-])", re.I)
#: Zones' words that articles are about, too: beside a word that is no zone's, they name one only where half of its words are links.
TOPICS = frozenset("search legal tags social sharing alert notice related login copyright".split())
#: Elements of text, whose id is an anchor.
ANCHORED = frozenset("p h1 h2 h3 h4 h5 h6 span a".split())
#: Classes that name an article's own part: with one of them only a class that is a zone's word and nothing else counts.
OWN = frozenset("article post content entry story body main text page".split())
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_NAMES = frozenset(RAW.split("|"))
RAW_END = {name: re.compile(f"</{name}\\s*>", re.I) for name in RAW_NAMES}


def tokens(page: str):
    """(text, "", False, "") or (None, tag's name, whether it closes, attributes) in page order, without comments and raw elements."""
    at, last, tag = 0, page.rfind(">"), TAG
    while at < len(page):
        cut = page.find("<", at)
        cut = len(page) if cut < 0 else cut
        if cut > at:
            yield page[at:cut], "", False, ""
        if cut >= len(page):
            return
        at = cut
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
        elif at < last and page[at + 1] in "!?/" and not page[at + 2 : at + 3].isalpha():
            at = page.index(">", at) + 1
        elif at < last and (page[at + 1].isalpha() or page[at + 1] == "/"):
            m = tag.match(page, at)
            if m is None and tag is TAG:
                tag = PLAIN_TAG  # a quote that never closes
                m = tag.match(page, at)
            if m is None:
                yield "<", "", False, ""
                at += 1
                continue
            name, at = m[2].lower(), m.end()
            if name in RAW_NAMES and not m[1]:
                end = None if m[3].endswith("/") and name == "svg" else RAW_END[name].search(page, at)
                at = end.end() if end else at if m[3].endswith("/") else len(page)
            else:
                yield None, name, bool(m[1]), m[3]
        elif at < last and page[at + 1] in "!?":
            at = page.index(">", at) + 1
        else:
            yield "<", "", False, ""
            at += 1


def zone_of(name: str, attributes: str) -> int:
    """Whether an id, role or class names a part that is no article text: 1 if it does, 2 if its links tell, else 0."""
    found = 0
    for kind, a, b, c in NAMED.findall(attributes):
        value = a or b or c
        if not ZONES.search(value) or (kind.lower() == "id" and name in ANCHORED):
            continue
        words = value.lower().split()
        named = [w for w in words if (m := ZONES.search(w)) and m[0] == w]
        if kind.lower() == "class" and OWN.intersection(words) and not named:
            continue
        if len(words) == 1 or any(w not in TOPICS for w in words if ZONES.search(w)) or len(named) == len(words):
            return 1
        found = 2
    return found


class Open:
    """The open elements, found by name without a search."""

    def __init__(self):
        self.names: list[str] = []
        self.states: list[tuple[bool, bool, int]] = []  # left out, in the article, innermost soft zone
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self, name: str) -> int:
        """Place of the innermost one of that name, or -1."""
        return own[-1] if (own := self.at.get(name)) else -1

    def push(self, name: str, state: tuple[bool, bool, int]) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.states.append(state)

    def cut(self, place: int) -> None:
        while len(self.names) > place:
            name = self.names.pop()
            self.states.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()


def parts(page: str) -> list[tuple]:
    """(key of the score, words or 1, text or None, block number, left out, in the article) in page order."""
    items: list[tuple] = []
    zones: list[list[int]] = []  # parent, words, landmarks inside, landmarks around, words of links, kind
    stack, block, words_in, marks = Open(), 0, 0, 0
    out, article, zone, link = False, False, -1, 0
    for text, name, close, attributes in tokens(page):
        if text is not None:
            if "&" in text:
                text = html_lib.unescape(text)
            n = len(text.split())
            if not out:
                words_in += n
                if zone >= 0:
                    zones[zone][1] += n
                    zones[zone][4] += n if link else 0
            where = stack.names[stack.blocks[-1]] if stack.blocks else "body"
            items.append((f"w:{where if where in KNOWN else 'other'}:{'a' if link else ''}", n, text, block, out, article, zone))
            continue
        if name == "br":
            items.append(("t:br", 1, " ", block, out, article, zone))
            continue
        if name not in INLINE:
            block += 1
        items.append(("t:" + ("math" if name in MATH else name if name in KNOWN else "other"), 1, None, block, out, article, zone))
        if close:
            place = stack.top(name)
            if place < 0 or (name in INLINE and stack.blocks and stack.blocks[-1] > place):
                continue
            stack.cut(place)
        else:
            if name in ENDS_P and (place := stack.top("p")) > max(map(stack.top, ("table", "button", "object"))):
                stack.cut(place)
            if name == "li" and (place := stack.top("li")) > max(map(stack.top, ("ul", "ol"))):
                stack.cut(place)
            if name in VOID or attributes.rstrip().endswith("/") and name not in ENDS_P:
                continue
            left, inside, around = stack.states[-1] if stack.states else (False, False, -1)
            inside = inside or name in ("article", "main")
            left = left or (name in SKIP and not (name == "header" and inside))
            kind = 0 if left or name in ("html", "body", "article", "main") else 1 if name == "form" else zone_of(name, attributes)
            if kind:
                zones.append([around, 0, 0, sum(len(stack.at.get(x, ())) for x in LANDMARKS), 0, kind])
                around = len(zones) - 1
            if name in LANDMARKS and not left:
                marks += 1
                if around >= 0:
                    zones[around][2] += 1
            stack.push(name, (left, inside, around))
        out, article, zone = stack.states[-1] if stack.states else (False, False, -1)
        link = len(stack.at.get("a", ()))
    for i in range(len(zones) - 1, -1, -1):  # a zone's words are those of the zones inside it too
        if (parent := zones[i][0]) >= 0:
            zones[parent][1] += zones[i][1]
            zones[parent][2] += zones[i][2]
            zones[parent][4] += zones[i][4]
    gone: list[bool] = []
    for parent, n, inside, around, linked, kind in zones:
        own = (2 * n < words_in or marks > inside + around) and (kind == 1 or 2 * linked >= n)
        gone.append((parent >= 0 and gone[parent]) or own)
    done = []
    for key, n, text, at, left, inside, z in items:
        left = left or (z >= 0 and gone[z])
        done.append((key[:2] + "out" if left else key, n, text, at, left, inside))
    return done


def weights_of(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """counts: key to (inside, outside the article)."""
    out = {}
    for key, (inside, outside) in counts.items():
        if key in FIXED:
            continue
        odds = math.log((inside + 0.5) / (outside + 0.5))
        out[key] = max(-3.0, min(3.0, odds)) if key.startswith("w:") else max(-1.0, min(-0.05, odds / 3))
    return out


#: For what no labelled page has; and for what is left out anyway, which an article may well go around, and a formula's many tags.
DEFAULT = {"w": 1.0, "t": -0.5, "w:a": -1.0}
FIXED = {"w:out": 0.0, "t:out": -0.05, "t:math": -0.05}


def weight(weights: dict[str, float], key: str) -> float:
    if key in FIXED:
        return FIXED[key]
    if (w := weights.get(key)) is not None:
        return w
    return DEFAULT["w:a"] if key.startswith("w:") and key.endswith(":a") else DEFAULT[key[0]]


def main_text(page: str, weights: dict[str, float]) -> str:
    items = parts(page)
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (key, n, *_rest) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += weight(weights, key) * n
        if total > best:
            best, best_at = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for _, _, text, block, out, _ in items[slice(*best_at)]:
        if text is not None and not out:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    # ids first: a page is long, and a sort with a limit brings `sample` rows of every partition to one task
    named = pages.where("page_id is not null and html rlike '(?i)<(article|main)[\\s>]'").select("page_id")
    ids = named.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    rows = pages.join(F.broadcast(ids), "page_id", "left_semi").select(F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            found: dict[str, list[int]] = {}
            for page in b.column("html").to_pylist():
                for key, n, _, _, _, article in parts(page):
                    found.setdefault(key, [0, 0])[not article] += n
            yield pa.record_batch([pa.array([*found], pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["key", "inside", "outside"])

    # keys are few: the names in KNOWN, twice for words and once for tags
    counts = rows.mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside"), F.sum("outside"))
    return weights_of({r[0]: (r[1], r[2]) for r in counts.collect()})


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    weights = train(pages, sample)

    def run(batches):
        for b in batches:
            text = [main_text(p, weights) for p in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
