"""Main text of web pages by template deduction (after ExAlg, Arasu and Garcia-Molina, 2003).

Tokens of a page are its tags and its blocks of text, told apart by the path they lie on. Over
the pages of a host, tokens with the same occurrence vector form an equivalence class; classes
whose tokens keep one order, and that fit between the tokens of the class around them, are
valid and nest into the host's template. A page's text is what tag rules leave of it, without
menus, adverts and the like, less the template's blocks of text; slots are not extracted.

Occurrence vectors are never built: a sum of hashes of (page, count) stands for one, so classes
come from one aggregation, however many pages a host has.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import keep

#: The inside of a tag up to its end, with quoted values; and without regard to quotes.
_QUOTED = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
#: Elements whose content isn't markup, and elements without text of the page's own.
_RAW = frozenset("script style textarea iframe xmp".split())
_SKIPPED = frozenset("noscript template svg math object canvas select button".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PARTS = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html head option optgroup title".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ASIDE_TAGS = frozenset("nav footer aside form head title menu dialog label fieldset".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay social share sharing related recommended comment comments reply replies disqus "
    "widget toolbar pagination pager login signup search skip".split()
)
_LAYOUT = frozenset(
    "area bar block body bottom box button buttons center column container content cta details feed fixed float footer form global group head header icon icons inner item items layout left line link links list main "
    "message module nav page panel policy post posts primary right row section secondary site slot sticky tags text thread title top unit wrap wrapper".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _named_aside(attrs: dict[str, str], names: frozenset[str] = _ASIDE_NAMES) -> bool:
    """Whether a class or the id says aside: one that has such a word and besides only words of layout. So
    `cookie-banner` does, but `no-sidebar` and `social-history` don't."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = _PARTS.findall(name)
        if any(p in names for p in parts) and all(p in names or p in _LAYOUT or len(p) < 3 and p != "no" or p[:1].isdigit() for p in parts):
            return True
    return False


def _aside(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if tag in _ASIDE_TAGS or tag == "header" and not inside_main:
        return True
    if attrs.get("role", "").lower() in _ASIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and _named_aside(attrs, frozenset(("comment", "comments", "ad", "ads", "advert")))
    return _named_aside(attrs)


def _pieces(page: str) -> Iterator[tuple[str, str]]:
    """Kind and content of texts ("text"), tags ("tag", with both brackets) in page order; comments, declarations and
    the content of raw elements are left out. Linear: a quote that is never closed ends the regard for quotes."""
    at, n, quotes = 0, len(page), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        if start > at:
            yield "text", page[at:start]
        follows = page[start + 1 : start + 3]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
        elif follows[:1] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
        elif follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isascii() and follows[1:].isalpha():
            m = _QUOTED.match(page, start + 1) if quotes else None
            if m is None:
                quotes = False
                end = page.find(">", start)
                if end < 0:  # no tag ends any more
                    yield "text", page[start:]
                    return
                at = end + 1
            else:
                at = m.end()
            tag = page[start:at]
            yield "tag", tag
            name = _TAG.match(tag)[2].lower()
            if name in _RAW and not tag.startswith("</"):
                m = _ends(name).search(page, at)
                at = m.start() if m else n
        else:
            yield "text", "<"
            at = start + 1


@cache
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def parse(page: str | None) -> list[tuple[str, str | None, bool, bool]]:
    """(path, text, in an aside, in an article or main) of start tags, which have no text, and of
    blocks, in page order. Character references are decoded; white space inside a block
    becomes one space. What is never closed ends with what it lies in."""
    tokens, stack, buffer = [], [], []
    asides = mains = skipped = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                tokens.append(("/".join(s[0] for s in stack if s[0] in _BLOCK), text, asides > 0, mains > 0))

    def pop_to(at: int) -> None:
        nonlocal asides, mains, skipped
        while len(stack) > at:
            tag, aside, main = stack[-1]
            if tag in _BLOCK:
                flush()
            stack.pop()
            skipped -= tag in _SKIPPED
            asides -= aside
            mains -= main

    for kind, token in _pieces(page or ""):
        if kind == "text":
            if not skipped:
                buffer.append(entities.unescape(token))
            continue
        t = _TAG.match(token)
        tag = t[2].lower()
        if t[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                pop_to(at)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
        if tag == "br":
            buffer.append(" ")
        closes = _CLOSES.get(tag, ()) if tag not in _CLOSES_P else {*_CLOSES.get(tag, ()), "p"}
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop_to(i)
                    if stack and not any(s[0] in closes for s in stack[-3:]):
                        break
                elif stack[i][0] in ("table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "select"):
                    break
        attrs = {a[1].lower(): (a[2] or "").strip("\"'") for a in _ATTR.finditer(token, t.end())} if t.end() < len(token) - 1 else {}
        tokens.append(("/".join([*(s[0] for s in stack), tag]), None, asides > 0, mains > 0))
        if tag in _VOID or tag in _RAW or token.endswith("/>") and tag not in _BLOCK:
            continue
        aside, main = _aside(tag, attrs, mains > 0), tag in ("article", "main") or attrs.get("role") == "main"
        skipped += tag in _SKIPPED
        stack.append((tag, int(aside), int(main)))
        asides += aside
        mains += main
    pop_to(0)
    flush()
    return tokens


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _text_token(path: str, text: str) -> int:
    return _hash("text", path, text)


_SEEN = "host string, token long, is_text boolean, pages double, vector long, first_low long, first_high long, last_low long, last_high long, plain double, chars double, room double"


def _tokens(batches):
    """Tokens of pages, summed up by host and token for each batch; n equal pages count as one.

    plain counts the pages without article where a token is free text, chars its length on them,
    room all of their free text."""
    names = [x.split()[0] for x in _SEEN.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _SEEN.split(", ")]
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, page, copies in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = parse(page)
            here: dict[tuple, list[int]] = {}
            weight = 1 / copies
            plain = not any(main and not aside for _, text, aside, main in found if text is not None)
            room = sum(len(text) for _, text, aside, _ in found if text is not None and not aside) if plain else 0
            size = len(found)
            for at, (path, text, aside, _) in enumerate(found):
                token = _hash("tag", path) if text is None else _text_token(path, text)
                c = here.setdefault((token, text is not None), [0, at, at, 0])
                c[0] += 1
                c[2] = at
                c[3] += len(text) if text is not None and plain and not aside else 0
            name = _hash("page", page)
            for (token, kind), (count, first, last, chars) in here.items():
                s = sums.setdefault((host, token, kind), [0.0, 0, first, first, size - last, size - last, 0.0, 0.0, 0.0])
                s[0] += weight
                if chars:
                    s[6], s[7], s[8] = s[6] + weight, s[7] + weight * chars, s[8] + weight * room
                s[1] = (s[1] + _hash(name, count)) & (2**64 - 1)
                s[2], s[3], s[4], s[5] = min(s[2], first), max(s[3], first), min(s[4], size - last), max(s[5], size - last)
        rows = [(*k, s[0], s[1] - (1 << 64) if s[1] >> 63 else s[1], *s[2:]) for k, s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 12, kinds, strict=True)], names=names)


def _precedes(a, b) -> bool:
    """Whether a comes before b on all pages, by distances from the page's start or from its end."""
    return a.first_high < b.first_low or a.last_low > b.last_high


def _nest(tokens: pd.DataFrame) -> pd.DataFrame:
    """Text tokens of the host's valid classes, and whether all its pages have them.

    Classes come in order of how many pages have them; the skeleton holds the tokens of those
    taken so far, and a class is nested where all its tokens lie between the same tokens of it.
    What _believed rejects is left out.
    """
    total = int(tokens["total"].iloc[0])
    skeleton: list = []
    out = []
    for _, rows in sorted(tokens[tokens["pages"] >= tokens["least"]].groupby(["pages", "vector"]), key=lambda g: (-g[0][0], g[0][1])):
        order = sorted(rows.itertuples(index=False), key=lambda r: (r.first_low + r.first_high, -r.last_low, r.token))
        if not all(_precedes(a, b) for a, b in zip(order, order[1:], strict=False)):
            # Tags repeat within a page; what is left of the class may still keep its order.
            order = [r for r in order if r.is_text]
            if not all(_precedes(a, b) for a, b in zip(order, order[1:], strict=False)):
                continue
        if all(_precedes(t, s) or _precedes(s, t) for s in skeleton for t in order):
            skeleton += order
            out += [r for r in order if r.is_text]
    others = tokens[tokens["is_text"] & (tokens["pages"] < total) & (tokens["plain"] > 0)]
    on_all, some = _believed([r for r in out if r.pages == total], [r for r in out if r.pages < total], others)
    return pd.DataFrame([*((r.host, r.token, True) for r in on_all), *((r.host, r.token, False) for r in some)], columns=["host", "token", "on_all"])


def _believed(on_all: list, some: list, others: pd.DataFrame, least_left: float = 0.2) -> tuple[list, list]:
    """The tokens that aren't the text of pages that nearly copy one another.

    Outside articles: tokens on all pages that would leave less than least_left of the text, and
    those on some that with all other such tokens, valid or not, would leave less than half of what the pages that have
    them say besides the former. Tokens count as on the same pages as far as their numbers allow.
    """
    shared = [r for r in on_all if r.plain > 0]
    if shared and sum(r.chars for r in shared) > (1 - least_left) * max(r.room for r in shared):
        on_all, shared = [r for r in on_all if r.plain == 0], []
    fixed = sum(r.chars / r.plain for r in shared)
    free = [r for r in some if r.plain > 0]
    plain, each = others["plain"].to_numpy(), (others["chars"] / others["plain"]).to_numpy()
    return on_all, [r for r in free if 2 * (each * np.minimum(plain, r.plain)).sum() <= r.room - fixed * r.plain]


def templates(pages: DataFrame, least_pages: int = 8, least_share: float = 0.5) -> DataFrame:
    """host, on_all and some: text tokens of the template that all pages of the host have, and
    those on at least least_share of its different pages. Hosts with fewer than least_pages of
    them get no template. What is grouped by host is each on a quarter of its pages at
    least, so there are no more of them than four times what a page has."""
    page = F.coalesce("html", F.lit(""))
    named = pages.select(_host().alias("host"), page.alias("html"))
    once = keep(named.groupBy("host", F.xxhash64("html").alias("name")).agg(F.count("*").alias("copies")), "once")
    hosts = keep(once.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= least_pages), "hosts")
    copies = keep(once.where("copies > 1"), "copies")
    weighed = named.withColumn("name", F.xxhash64("html")).join(copies, ["host", "name"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    seen = weighed.mapInArrow(_tokens, _SEEN)
    sums = seen.groupBy("host", "token", "is_text").agg(
        F.round(F.sum("pages")).cast("long").alias("pages"), _wrapping_sum("vector").alias("vector"), F.min("first_low").alias("first_low"), F.max("first_high").alias("first_high"), F.min("last_low").alias("last_low"), F.max("last_high").alias("last_high"),
        F.sum("plain").alias("plain"), F.sum("chars").alias("chars"), F.sum("room").alias("room"),
    )
    # What half as many pages have tells copies only.
    found = sums.join(hosts, "host").withColumn("least", F.col("total") * F.lit(float(least_share))).where(2 * F.col("pages") >= F.col("least"))
    kept = found.groupBy("host").applyInPandas(_nest, "host string, token long, on_all boolean")
    return keep(kept.groupBy("host").agg(F.collect_set(F.when(F.col("on_all"), F.col("token"))).alias("on_all"), F.collect_set(F.when(~F.col("on_all"), F.col("token"))).alias("some")), "templates")


def _wrapping_sum(column: str):
    """A sum modulo 2^64, as a hash of its halves: they are summed apart, so that nothing overflows."""
    high, low = F.sum(F.shiftright(column, 32)), F.sum(F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.xxhash64(F.pmod(high + F.shiftright(low, 32), F.lit(1 << 32)), low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def main_text(page: str | None, on_all: set[int], some: set[int]) -> str:
    """The text of the article or main elements less asides, or without such an element all blocks
    that are neither asides nor template text. A template that would leave less than half of an
    article isn't believed within it: then the pages of the host are copies of one another.
    Outside articles tokens of some pages aren't believed if they would leave less than half of
    what those of all pages leave; the latter always go."""
    free = [(_text_token(path, text) if on_all or some else 0, text, main) for path, text, aside, main in parse(page) if text is not None and not aside]
    article = [(t, text) for t, text, main in free if main]
    if article:
        whole, slots = [text for _, text in article], [text for t, text in article if t not in on_all]
    else:
        rest = [(t, text) for t, text, _ in free if t not in on_all]
        whole, slots = [text for _, text in rest], [text for t, text in rest if t not in some]
    return "\n\n".join(slots if 2 * sum(map(len, slots)) >= sum(map(len, whole)) else whole)


def extract(pages: DataFrame, **kwargs) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Null html: empty text. Null url or one without a host: pages of one nameless host. Repeated
    rows each have a row. An empty table gives an empty result. Extra columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = templates(pages, **kwargs)
    joined = pages.withColumn("host", _host()).join(found, "host", "left").select("page_id", "url", "html", "on_all", "some")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, set(a or ()), set(s or ())) for h, a, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
