"""Main text of web pages: templates deduced from token classes that occur alike across a host's pages."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from venuekit.session import materialize

# Elements without text of their own, elements and names of page furniture, and block elements.
SILENT = frozenset("script style noscript template head title svg iframe object canvas textarea select option button".split())
FURNITURE = frozenset("nav footer aside form header menu dialog".split())
FURNITURE_STEMS = (
    r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|nav\w*|newsletter|notices?|"
    r"pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
)
FURNITURE_NAMES = re.compile(rf"(?:^|(?<!article)(?<!post)(?<!entry)(?<!story)[_-]|\s)(?:{FURNITURE_STEMS})(?:$|[\s_-])", re.I)
FURNITURE_CLASSES = re.compile(
    rf"(?:^|\s)(?:{FURNITURE_STEMS})(?:[_-](?:{FURNITURE_STEMS}|area|bar|block|box|buttons?|container|form|links?|list|section|slot|thread|unit|wrapper))*(?:$|\s)", re.I
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
CONTAINERS = frozenset("html body article main section div center table tbody tr td".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": BLOCKS - {"br"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[/!A-Za-z][^<]*$")
MIN_SUPPORT = 0.5
MIN_FIXED_PAGES = 3  # a text is part of a template from so many pages on


def token_id(parent: int, label: str) -> int:
    """64-bit id of an element or text by the ids of what encloses it."""
    source = f"{parent}/{label}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(source, digest_size=8).digest(), "big", signed=True)


@dataclass
class Element:
    """An open element: its id by the path of block elements, and what holds for everything inside it."""

    tag: str
    token: int
    parent: int
    depth: int
    furniture: bool
    within: str  # "article" or "main" inside such an element
    article: int  # which article or main element of the page
    opens: bool  # it is that element
    blocks: int  # open block elements up to this one


@dataclass
class Block:
    text: str
    at: Element
    heading: bool


@dataclass
class Template:
    """What a host's pages share: the element that holds the main text, and texts that are not part of it."""

    slot: int | None = None
    fixed: frozenset = field(default_factory=frozenset)


ROOT = Element("", 0, 0, 0, False, "", 0, False, 0)


def _is_furniture(tag: str, attributes: dict[str, str], within: str) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role", "") in FURNITURE_ROLES or (tag in FURNITURE and not (tag == "header" and within)):
        return True
    if tag in PROSE:
        return False
    pattern = FURNITURE_CLASSES if within else FURNITURE_NAMES
    return any(pattern.search(attributes.get(k, "")) for k in ("class", "id"))


def page_blocks(source: str) -> tuple[list[Block], list[Element]]:
    """Text blocks and block elements of a page in order, in time linear in the page.

    Furniture is what holds no main text by its kind, role or name; names of prose elements do not
    count, and inside an article only whole class names do. Unclosed elements end where their parent ends.
    """
    out: list[Block] = []
    opened: list[Element] = []
    stack: list[Element] = [ROOT]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    articles = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(Block(text, stack[-1], bool(places.get("h1"))))

    def drop() -> str:
        tag = stack.pop().tag
        places[tag].pop()
        return tag

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            cut = _CUT_TAG.search(source, at)  # a tag broken off at the end of the page
            parts.append(source[at : cut.start()] if cut else source[at:])
            break
        parts.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS:
            flush()
        if closing:
            if places.get(tag):
                if tag not in BLOCKS and stack[-1].blocks > stack[places[tag][-1]].blocks:
                    continue  # an inline element does not close the blocks opened in it
                while drop() != tag:
                    pass
            continue
        if tag in SILENT and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        while tag in CLOSES.get(stack[-1].tag, ()):
            drop()
        up = stack[-1]
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])}
        furniture = up.furniture or _is_furniture(tag, attributes, up.within)
        within, article = up.within, up.article
        opens = tag == "article" and within != "article" or tag == "main" and not within
        if opens:
            articles += 1
            within, article = tag, articles
        token, depth, block = up.token, up.depth, tag in BLOCKS
        if block or tag in CONTAINERS:
            token, depth = token_id(up.token, ".".join([tag, *attributes.get("class", "").split()])), depth + 1
        here = Element(tag, token, up.token, depth, furniture, within, article, opens, up.blocks + block)
        places.setdefault(tag, []).append(len(stack))
        stack.append(here)
        if token != up.token:
            opened.append(here)
    flush()
    return out, opened


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", url or "")
    return m[1].lower() if m else ""


def page_tokens(source: str) -> list[dict]:
    """The page's tokens with their counts, and the characters outside furniture that they hold.

    Tokens are the elements outside furniture down to an article or main element, and the texts outside
    of those. What an article holds is never part of a template, so its inside needs no tokens.
    """
    blocks, opened = page_blocks(source)
    seen = {0: {"token": 0, "parent": 0, "depth": 0, "text": False, "slot": True, "n": 1, "main": 0, "heading": 0}}
    nearest = {0: 0}  # of an element inside an article, the article
    order = []
    for e in opened:
        if e.furniture:
            continue
        nearest.setdefault(e.token, nearest[e.parent] if e.within and not e.opens else e.token)
        if nearest[e.token] != e.token:
            continue
        if e.token not in seen:
            order.append(e.token)
            seen[e.token] = {"token": e.token, "parent": e.parent, "depth": e.depth, "text": False, "slot": e.tag in CONTAINERS, "n": 0, "main": 0, "heading": 0}
        seen[e.token]["n"] += 1
    for b in blocks:
        if b.at.furniture:
            continue
        home = seen[nearest.get(b.at.token, 0)]
        home["main"] += len(b.text)
        home["heading"] += len(b.text) if b.heading else 0
        if not b.at.within:
            t = token_id(b.at.token, "text " + b.text)
            cell = seen.setdefault(t, {"token": t, "parent": b.at.token, "depth": b.at.depth + 1, "text": True, "slot": False, "n": 0, "main": 0, "heading": 0})
            cell["n"] += 1
            cell["main"] += len(b.text)
            cell["heading"] += len(b.text) if b.heading else 0
    for t in sorted(order, key=lambda t: -seen[t]["depth"]):  # elements hold what their children hold
        up = seen.get(nearest.get(seen[t]["parent"], 0), seen[0])
        up["main"] += seen[t]["main"]
        up["heading"] += seen[t]["heading"]
    return list(seen.values())


def deduce(tokens: list[dict], min_pages: int, fixed_pages: int = MIN_FIXED_PAGES) -> Template:
    """The template of a host from its tokens: ``token, parent, depth, text, slot, pages, main, heading, vector``.

    Tokens with one occurrence vector are an equivalence class. A class is valid if it spans ``min_pages``
    pages and has at least two tokens: a text that repeats by itself is a coincidence. Classes nest by the
    elements that their tokens lie in. Texts of valid classes are fixed. The slot is the innermost container
    of a valid class that still holds 9 in 10 of the other characters and of the headings (all of them, if one
    page is all there is to learn from); ties go to the least id.
    """
    share = 9 if min_pages > 1 else 10
    members = Counter(t["vector"] for t in tokens)
    large = lambda t: members[t["vector"]] > 1
    valid: dict[int, dict] = {}
    for t in sorted(tokens, key=lambda t: (t["depth"], t["token"])):
        if t["pages"] >= min_pages and (not t["token"] or t["parent"] in valid):
            valid[t["token"]] = t
    fixed = {k for k, t in valid.items() if t["text"] and large(t) and t["pages"] >= fixed_pages}
    free = {k: [t["main"], t["heading"]] for k, t in valid.items() if not t["text"]}
    lost = {k: [0, 0] for k in free}
    for t in sorted(valid.values(), key=lambda t: -t["depth"]):
        k, out = t["token"], [t["main"], t["heading"]] if t["token"] in fixed else lost.get(t["token"], [0, 0])
        if k:
            lost[t["parent"]][0] += out[0]
            lost[t["parent"]][1] += out[1]
    if free and free[0][0] > lost[0][0]:
        free = {k: [v[0] - lost[k][0], v[1] - lost[k][1]] for k, v in free.items()}
    else:
        fixed = set()  # pages that are all alike have no text of their own besides
    slots = [t for k, t in valid.items() if t["slot"] and k and large(t) and free[k][0] > 0 and all(10 * x >= share * y for x, y in zip(free[k], free[0]))]
    best = min(slots, key=lambda t: (-t["depth"], t["token"]), default=None)
    return Template(best["token"] if best else None, frozenset(fixed))


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_support: float = MIN_SUPPORT) -> DataFrame:
    """``host, slot, fixed``: what the pages of each host share, see ``deduce``.

    An occurrence vector is the sum of 128-bit hashes of (page, count), so vectors add up on the map
    side. Only tokens on ``min_support`` of a host's pages, and on two where it has two, go on to the
    deduction: at most ``1 / min_support`` times as many as an average page has, however many pages.
    """
    token = "token:bigint,parent:bigint,depth:int,text:boolean,slot:boolean,n:int,main:bigint,heading:bigint"
    scan = F.pandas_udf(
        lambda urls, sources: pd.DataFrame({"host": urls.map(host_of), "tokens": [page_tokens(s or "") for s in sources]}), f"host string, tokens array<struct<{token}>>"
    )
    page = F.md5(F.concat_ws("|", F.coalesce(url_col, F.lit("")), F.coalesce(html_col, F.lit(""))).cast("binary"))
    scanned = pages.select(page.alias("page"), scan(F.col(url_col), F.col(html_col)).alias("s")).select("page", "s.host", F.explode("s.tokens").alias("t"))
    low, halves = F.lit(0xFFFFFFFF), []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), "page", "t.n")
        halves += [F.sum(h.bitwiseAND(low)).alias(f"v{2 * salt}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"v{2 * salt + 1}")]
    same = [F.first(f"t.{c}").alias(c) for c in ("parent", "depth", "text", "slot")]
    sums = [F.sum(f"t.{c}").alias(c) for c in ("main", "heading")]
    stats = materialize(scanned.groupBy("host", "t.token").agg(F.count("*").alias("pages"), *same, *sums, *halves), "page-tokens")
    sizes = stats.filter("token = 0").select("host", F.col("pages").alias("of"))
    needed = F.greatest(F.least(F.lit(2), "of"), F.ceil(F.col("of") * min_support)).cast("long")
    shared = stats.join(sizes, "host").withColumn("needed", needed).filter("pages >= needed")

    def nest(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.to_dict("records")
        for r in rows:
            r["vector"] = (r["v0"], r["v1"], r["v2"], r["v3"])
        found = deduce(rows, rows[0]["needed"])
        return pd.DataFrame({"host": [rows[0]["host"]], "slot": pd.array([found.slot], dtype="Int64"), "fixed": [sorted(found.fixed)]})

    return shared.groupBy("host").applyInPandas(nest, "host string, slot long, fixed array<long>")


def main_text(source: str, template: Template | None = None) -> str:
    """Blocks of a page inside its template's slot, without fixed texts and furniture.

    A page that lacks the slot, or has no template, is its own. An article inside the slot, or else a
    main element, is the text; of several, those with a heading of the first level, if any.
    """
    template = template or deduce([{**t, "pages": 1, "vector": t["n"]} for t in page_tokens(source)], 1)
    blocks, opened = page_blocks(source)
    inside = {template.slot}
    inside.update(e.token for e in opened if e.parent in inside or e.token in inside)
    kept = [b for b in blocks if not b.at.furniture and (b.at.within or token_id(b.at.token, "text " + b.text) not in template.fixed)]
    held = [b for b in kept if b.at.token in inside] or kept
    for kind in ("article", "main"):
        of_kind = [b for b in held if b.at.within == kind]
        if of_kind:
            headed = {b.at.article for b in of_kind if b.heading}
            return " ".join(b.text for b in of_kind if not headed or b.at.article in headed)
    return " ".join(b.text for b in held)


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with ``text``, its main text, and ``n_chars``; columns of those names are replaced.

    A null or empty page has an empty text. Pages without a host share the host ''. Repeated pages get
    equal texts and count as often as they occur in their host's template. A host of one page is its own
    template. Ties between slots go to the least id. Broken markup ends where the page ends. Time and
    memory are linear in a page, however deep it is. An empty table gives no rows.
    """
    templates = deduce_templates(pages, url_col, html_col)
    slots = materialize(templates, "templates").withColumnsRenamed({"host": "_host", "slot": "_slot", "fixed": "_fixed"})
    hosts = F.pandas_udf(lambda urls: urls.map(host_of), "string")

    def texts_of(sources, slots, fixed):
        found = [main_text(s or "", Template(int(t) if t else None, frozenset(f))) for s, t, f in zip(sources, slots, fixed)]
        return pd.Series(found, dtype=object)

    extract = F.pandas_udf(texts_of, "string")
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars", "_at", "_host", "_slot", "_fixed")])
    # ids travel as text: a column with nulls would reach pandas as floats
    placed = base.withColumn("_at", hosts(F.col(url_col))).join(slots, F.col("_at") == F.col("_host"), "left")
    texts = placed.withColumn("text", extract(F.col(html_col), F.col("_slot").cast("string"), F.col("_fixed")))
    return texts.withColumn("n_chars", F.char_length("text").cast("long")).drop("_at", "_host", "_slot", "_fixed")
