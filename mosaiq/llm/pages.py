"""Main text of web pages, by site style trees.

The pages of one host are merged into a tree of styles: an element is known by its path of tags,
classes and ids, and every page adds to it the sequence of its children (presentation) and, where
it holds text, that text (content). An element's importance weighs the entropy of its children's
sequences and how far its texts are spread over the pages that have it: a text on one page says
much, one that four pages share says nothing. The trees of all hosts are merged once more into one
shared tree, which a host's own evidence is smoothed with: the fewer pages a host has, the more the
shared tree decides, and a path seen once anywhere has the importance NEUTRAL. What an element is
called (tag, role, words of class and id) is a prior weight on its importance, inherited by all in
it. Elements of low importance, so weighed, are cut from each page of the host.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

#: Weight of content against presentation, and importance up to which an element is cut.
CONTENT, LOW = 0.9, 0.5
#: Importance without any evidence; pages of it in the shared tree; pages of the shared tree in a host's.
NEUTRAL, SHARED_PAGES, HOST_PAGES = 0.75, 3.0, 30.0
#: A text on so many of an element's pages says nothing (on fewer, where the element has fewer).
SATURATED = 4
#: (host, path) pairs that may be broadcast; more are joined to the pages by host.
BROADCAST = 1_000_000

# Elements that show no text of their own, and element names, words of classes and ids, and roles
# that speak of something beside the main text: the plainly NAMED, and those that only hint at it.
INVISIBLE = frozenset("head script style noscript template button select textarea iframe svg canvas object input datalist audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NAMED_TAGS = frozenset("nav footer aside form menu dialog".split())
HINTED_TAGS = frozenset("fieldset label legend".split())
NAMED = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored cookie cookies consent gdpr notice notices popup overlay modal newsletter
    sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus discussion pagination pager masthead""".split()
)
HINTED = frozenset("promo promotion promoted notification alert subscribe subscription signup login side rail respond share sharing social related recommended widget toolbar search skip".split())
COMMENTS = frozenset("comment comments commentlist reply replies disqus discussion".split())
NAMED_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Prior weights of what is named so, and hinted at.
NAMED_WEIGHT, HINTED_WEIGHT = 0.4, 0.65
#: Elements that such a start ends, and those within which that is looked for.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = frozenset("html body article main section div table ul ol dl td th nav aside header footer form blockquote figure button".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


class Element:
    __slots__ = ("article", "path", "style", "tag", "weight")

    def __init__(self, tag: str, path: int, weight: float, article: bool):
        self.tag, self.path, self.weight, self.article = tag, path, weight, article
        self.style: list[str] = []


def prior(tag: str, attributes: dict[str, str], in_article: bool) -> float:
    """Weight of an element by what it is called; 0 for what shows no text."""
    if tag in INVISIBLE or "hidden" in attributes:
        return 0.0
    if tag in NAMED_TAGS or attributes.get("role", "").lower() in NAMED_ROLES or (tag == "header" and not in_article):
        return NAMED_WEIGHT
    if tag in ("html", "body"):
        return 1.0
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(attributes.get(k, ""))}
    if tag in ("article", "main"):  # a page's own container, whatever else its classes say; a reader's comment may be one too
        return NAMED_WEIGHT if words & COMMENTS else 1.0
    if words & NAMED or (not in_article and "header" in words):
        return NAMED_WEIGHT
    return HINTED_WEIGHT if words & HINTED or tag in HINTED_TAGS else 1.0


def walk(source: str):
    """Blocks of a page in order, as (path, text, whether in an article, prior weight), and its elements' (path, children).

    A block's path is that of the innermost element when its text begins. Invisible branches, and
    plainly named elements within a line, give nothing.
    """
    stack = [Element("#", 0, 1.0, False)]
    blocks: list[tuple[int, str, bool, float]] = []
    styles: list[tuple[int, str]] = []
    text: list[str] = []
    where: list[Element] = []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                blocks.append((where[0].path, line, where[0].article, where[0].weight))
            text.clear()
            where.clear()

    def say(s: str) -> None:
        top = stack[-1]
        if s and top.weight:
            if not where and not s.isspace():
                where.append(top)
            if where:
                text.append(s)

    def pop(n: int) -> None:
        for e in stack[n:]:
            if e.weight:
                styles.append((e.path, ",".join(e.style)))
        del stack[n:]

    at = 0
    while m := _TAG.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if end:
            if block:
                flush()
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    pop(n)
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if block:
            flush()
            _close(stack, tag, pop)
        attributes = _attributes(raw) if raw.strip() else {}
        top = stack[-1]
        name = f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}" if attributes else tag
        if top.weight and (not top.style or top.style[-1] != name):
            top.style.append(name)  # a run of the same children is one step of the style
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = closing.end() if closing else len(source)
            continue
        if tag in VOID or raw.endswith("/") and not block:
            continue
        weight = top.weight and min(top.weight, prior(tag, attributes, top.article))
        if not block and weight <= NAMED_WEIGHT < top.weight:
            weight = 0.0  # part of another block's line, which no tree can judge by itself
        stack.append(Element(tag, xxhash.xxh3_64_intdigest(f"{top.path}/{name}") >> 1, weight, top.article or tag in ("article", "main") or attributes.get("role") == "main"))
    say(source[at:])
    flush()
    pop(1)
    return blocks, styles


def _close(stack: list[Element], tag: str, pop) -> None:
    """End what the start of ``tag`` ends: an open paragraph, or the last item of the same list or table."""
    ends = CLOSED_BY.get(tag, ("p",))
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag in ends:
            pop(n)
            if tag not in CLOSED_BY:
                return
        elif stack[n].tag in SCOPE:
            return


def main_text(source: str | None, low: frozenset[int] | set[int] | None = None) -> str:
    """The blocks of a page's articles (or, if none, of its body), less those on low paths.

    Without a tree the page is judged by itself: every path is neutral but for its prior. A page
    whose every block is low keeps those that no prior speaks against.
    """
    if not source:
        return ""
    blocks, _ = walk(source)
    own = [b for b in blocks if b[2]] or blocks
    alone = [t for _, t, _, weight in own if NEUTRAL * weight > LOW]
    kept = alone if low is None else [t for path, t, _, _ in own if path not in low] or alone
    return "\n\n".join(kept)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _feature(text: str, host: str) -> int:
    """What counts as the same text on two pages of any hosts: the text but for the host's own name."""
    return xxhash.xxh3_64_intdigest(text.replace(host, "@") if "." in host else text) >> 1


def _tree(batches):
    """A page's part of its host's tree, each row once a page: (host, path, kind, value).

    Kind 0 has an element's children, 1 a text of it, 2 says that it has text, with its prior weight in hundredths.
    """
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
    for b in batches:
        rows: list[tuple[str, int, int, int]] = []
        for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            host = host_of(url)
            blocks, styles = walk(source or "")
            own = {(path, 1, _feature(t, host)) for path, t, _, _ in blocks} | {(path, 2, round(100 * weight)) for path, _, _, weight in blocks}
            paths = {path for path, _, _, _ in blocks}
            rows += [(host, *x) for x in own] + [(host, path, 0, x) for path, x in {(path, xxhash.xxh3_64_intdigest(s) >> 1) for path, s in styles if path in paths}]
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "path", "kind", "value"])


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, importance, pages, weight) of the text-bearing elements of the trees that ``by`` names.

    Content importance is 1 less the mean, over the texts of all pages, of the entropy of the pages
    that share the text, held against that of SATURATED pages or the element's, if fewer.
    Presentation importance is the entropy of the children's sequences, to the base of their number.
    """
    n = F.col("n").cast("double")
    texts = lambda cond: F.sum(F.when((F.col("kind") == 1) & cond, n).otherwise(0.0))
    styles = F.col("kind") == 0
    tree = counts.groupBy(*by).agg(
        texts(F.lit(True)).alias("all"), *(texts(F.col("n") == k).alias(f"on{k}") for k in range(2, SATURATED)), texts(F.col("n") >= SATURATED).alias("many"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"), F.max(F.when(F.col("kind") == 2, F.col("value"))).alias("weight"),
        F.sum(F.when(styles, n)).alias("seen"), F.count_if(styles).alias("styles"), F.sum(F.when(styles, n * F.log(n))).alias("nlogn"),
    ).where("pages > 0")
    base = F.log(F.greatest(F.least(F.col("pages"), F.lit(SATURATED)), F.lit(2)).cast("double"))
    spread = sum((F.col(f"on{k}") * F.least(F.log(F.lit(float(k))) / base, F.lit(1.0)) for k in range(2, SATURATED)), F.col("many"))
    entropy = F.when(F.col("styles") > 1, (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log(F.col("styles").cast("double"))).otherwise(0.0)
    importance = CONTENT * (1 - spread / F.col("all")) + (1 - CONTENT) * F.coalesce(entropy, F.lit(0.0))
    return tree.select(*by, importance.alias("importance"), F.col("pages").cast("double").alias("pages"), (F.col("weight") / 100).alias("weight"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of the text-bearing elements of every host's merged tree, prior weights included.

    Counts are added up over all pages of a host, and of all hosts. An element on one page of a host
    is judged by the shared tree alone, one on one page of any host by its prior alone; any other by
    both, each of a tree's pages but one counting as evidence. Of equal paths on very many hosts the
    rows of the join are few numbers a host, and split by adaptive execution.
    """
    rows = map_arrow(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), _tree, "host string, path long, kind int, value long")
    counts = cut(rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n")))
    shared = _importance(counts.groupBy("path", "kind", "value").agg(F.sum("n").alias("n")), ["path"])
    every = ((F.col("pages") - 1) * F.col("importance") + SHARED_PAGES * NEUTRAL) / (F.col("pages") - 1 + SHARED_PAGES)
    both = _importance(counts, ["host", "path"]).join(shared.select("path", every.alias("every")), "path")
    own = ((F.col("pages") - 1) * F.col("importance") + HOST_PAGES * F.col("every")) / (F.col("pages") - 1 + HOST_PAGES)
    return both.select("host", "path", (own * F.col("weight")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without main text, have an empty text. A null or odd url is a
    host of its own name ''. Repeated rows each come back, and count as pages of the host. No rows
    give no rows. Whole pages are read.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = cut(style_tree(pages).where(F.col("importance") <= LOW).select("host", "path"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    names = ["page_id", "url", "text", "n_chars"]
    if low.count() <= BROADCAST:
        of: dict[str, set[int]] = {}
        for host, path in low.collect():
            of.setdefault(host, set()).add(path)
        held = spark.sparkContext.broadcast(of)

        def one(batches):
            for b in batches:
                texts = [main_text(source, held.value.get(host_of(url), frozenset())) for url, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

        return map_arrow(pages, one, schema)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
    low = low.groupBy("host").agg(F.collect_set("path").alias("low"))  # a site's template: as large as one page's tree

    def joined(batches):
        for b in batches:
            texts = [main_text(source, set(low or ())) for source, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return map_arrow(pages.withColumn("host", host).join(low, "host", "left").select("page_id", "url", "html", "low"), joined, schema)


def op2_html(spark, sf_dir: str) -> DataFrame:
    """``extract`` of every row of ``pages``: null, odd and repeated rows as stated there."""
    return extract(table(spark, sf_dir, "pages"))
