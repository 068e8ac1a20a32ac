"""Main text of web pages by site style trees.

Pages of one host are merged into a tree of style nodes: elements that have the
same path of tags and classes. Content that comes back on many pages of the
host, and layouts that are always the same, have little entropy-based
importance; branches whose importance is low are removed from each page, next to
those whose element says what it is (navigation, footer, advert, form, comments).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices
from tidemark.session import write_through

# HTML elements by their part in a page, and words in classes and ids that name one.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = set("aside button canvas datalist footer form head header iframe input menu nav noscript object script select style svg template textarea title".split())
NOISE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget discussion discussions replies respond".split()
)
# Words that headings and paragraphs of an article have in their classes as well.
PLAIN = {"banner", "header", "masthead", "related", "share", "social", "widget"}
# What stands before or after such a word where it tells of something else being there: "has-sidebar", "comments-open".
BEFORE = {"has", "have", "hide", "is", "no", "show", "with", "without"}
AFTER = {"active", "closed", "disabled", "enabled", "hidden", "none", "off", "on", "open", "visible"}
MAIN = {"article", "main"}
FLOW = {"blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre"}
# Elements that end where one of the named begins.
ENDED_BY = {
    "p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
# An open element of these keeps what is outside of it from being ended.
SCOPES = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "ol", "section", "table", "td", "th", "ul"}

# Depth of a page's tree beyond which elements count as part of their parent.
DEEPEST = 64
LEAST_PAGES = 3
LEAST_IMPORTANCE = 0.3
# A running text goes if it comes back in nearly all articles of a host of several.
LEAST_ARTICLES = 5
LEAST_TEXT_IMPORTANCE = 0.1
GAMMA = 0.9
# Branches and texts, and characters of their paths, that are sent to every executor; more are joined by host.
BROADCAST_BRANCHES = 200_000
BROADCAST_CHARS = 10_000_000


HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_column(url: Column) -> Column:
    """Host of a url in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def noise_words(tag: str, value: str) -> bool:
    """True if a class, id or role names a part of the page that is no article."""
    known = NOISE - PLAIN if tag in FLOW else NOISE
    for name in value.lower().split():
        parts = re.findall("[a-z]+", name)
        if parts and (parts[-1] in known and (len(parts) == 1 or parts[0] not in BEFORE) or parts[0] in known and parts[-1] not in AFTER):
            return True
    return False


class Page(HTMLParser):
    """A page's nodes (elements that make blocks), their layouts, and its texts with the nodes they are in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Per node: parent, style path, tag, unimportant by a word, and whether it is the main part or in it.
        self.nodes: list[tuple[int, str, str, bool, bool]] = [(0, "", "", False, False)]
        # Per open element: tag, node, inside what is never shown or never article.
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self.children: dict[str, list[str]] = {}
        self.text: list[tuple[int, str]] = []

    def _flush(self) -> None:
        if any(not text.isspace() for _, text in self.text):
            self.blocks.append((self.open[-1][1], self.text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in SKIPPED:
            self._flush()
        for i in range(len(self.open) - 1, 0, -1):
            if tag in ENDED_BY.get(self.open[i][0], ()):
                del self.open[i:]
                break
            if self.open[i][0] in SCOPES:
                break
        if tag in VOID:
            return
        given = dict(attrs)
        words = f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}"
        _, node, dropped = self.open[-1]
        _, path, _, _, inside = self.nodes[node]
        # An article's own header has its headline.
        dropped = dropped or "hidden" in given or (tag in SKIPPED and not (tag == "header" and inside))
        main = inside or (not dropped and (tag in MAIN or given.get("role") == "main"))
        noise = tag not in ("html", "body") and noise_words(tag, words)
        if tag in BLOCK or tag in SKIPPED or noise or main != inside:
            names = re.findall("[a-z]+", words.lower())
            mark = ".".join([tag, *dict.fromkeys(names)])
            self.children.setdefault(path, []).append(mark)
            if len(self.open) < DEEPEST:
                path = f"{path}>{mark}"
            self.nodes.append((node, path, tag, noise and not (main and not inside), main))
            node = len(self.nodes) - 1
        self.open.append((tag, node, dropped))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in SKIPPED:
            self._flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        _, node, dropped = self.open[-1]
        if not dropped:
            self.text.append((node, data))

    def kept(self, low: set[str] = frozenset()) -> list[tuple[str, str, str]]:
        """Path, tag and text of each block outside of unimportant branches, in the main part where there is one.

        No word and no ``low`` path takes away the main part or what it lies in.
        """
        holds = [main for *_, main in self.nodes]
        marked = any(holds)
        for node in range(len(self.nodes) - 1, 0, -1):
            parent, *_, main = self.nodes[node]
            holds[parent] = holds[parent] or (holds[node] and not self.nodes[parent][4])
        gone = [False] * len(self.nodes)
        for node, (parent, path, _, noise, main) in enumerate(self.nodes):
            open_way = holds[node] and not (main and self.nodes[parent][4])
            gone[node] = gone[parent] or not open_way and (noise or path in low)
        out = []
        for node, texts in self.blocks:
            _, path, tag, _, main = self.nodes[node]
            if not gone[node] and (main or not marked):
                text = " ".join("".join(text for at, text in texts if not gone[at]).split())
                if text:
                    out.append((path, tag, text))
        return out


def read_page(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page._flush()
    return page


def text_feature(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def main_text(html: str | None, low: set[str], again: set[int] = frozenset()) -> str:
    """The page's main text without branches whose style path is ``low``, and without texts that come ``again``."""
    return " ".join(text for _, _, text in read_page(html).kept(low) if not again or text_feature(text) not in again)


def page_features(html: str | None) -> tuple[int, set[tuple[str, bool, int]]]:
    """The page's article as a hash, and each style node with a feature, once: texts of blocks (content), orders of children (layout)."""
    page = read_page(html)
    kept = page.kept()
    seen = {(path, True, text_feature(text)) for path, _, text in kept}
    seen |= {(path, False, text_feature(" ".join(dict.fromkeys(marks)))) for path, marks in page.children.items()}
    return text_feature("\n".join(text for _, _, text in kept)), seen


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pages' features, with their host and article."""
    for batch in slices(batches, "html"):
        seen = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            article, features = page_features(html)
            seen += [(host, article, *feature) for feature in features]
        columns = list(zip(*seen)) if seen else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "article", "path", "content", "feature"])


def feature_counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, content, feature, k``: how many different articles of a host have each feature.

    Equal rows meet in the tasks first; a host's pages never come together.
    """
    rows = pages.select(host_column(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = rows.mapInArrow(_observed, "host string, article bigint, path string, content boolean, feature bigint").distinct()
    return rows.groupBy("host", "path", "content", "feature").agg(F.count("*").alias("k"))


def style_tree(counted: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` of every style node, from ``feature_counts``.

    A feature that k of a node's m articles have evenly has entropy log k / log m
    among them; a node's content importance is one less the mean of that, so
    texts of one article each count 1 and texts of all articles 0. A node's
    layout importance is the entropy of its orders of children, to the base m. A
    branch has the mean of its nodes' importance, weighted by articles and by
    ``GAMMA`` for each step down. Nodes of a single article are important.
    """
    sites = counted.where("not content and path = ''").groupBy("host").agg(F.sum("k").alias("site_pages"))
    node = counted.groupBy("host", "path", "content").agg(
        F.sum("k").alias("mass"), F.max("k").alias("most"), F.count("*").alias("n"), F.sum(F.log("k")).alias("logs"), F.sum(F.col("k") * F.log("k")).alias("k_logs")
    )
    node = node.join(sites, "host")
    m = F.greatest("site_pages", "most")
    content = 1 - F.col("logs") / F.col("n") / F.log(m)
    layout = (F.log("mass") - F.col("k_logs") / F.col("mass")) / F.log(m)
    own = node.select("host", "path", F.least(m, F.col("mass")).alias("pages"), F.when(m > 1, F.round(F.when(F.col("content"), content).otherwise(layout), 9)).otherwise(1.0).alias("own"))
    parts = F.split("path", ">")
    above = own.select("host", "pages", "own", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    weight = F.col("pages") * F.pow(F.lit(GAMMA), F.size("p") - F.col("depth"))
    branch = above.select("host", F.array_join(F.slice("p", F.lit(1), F.col("depth")), ">").alias("path"), "own", "pages", weight.alias("w"))
    return branch.groupBy("host", "path").agg(F.max("pages").alias("pages"), (F.sum(F.col("own") * F.col("w")) / F.sum("w")).alias("importance"))


def repeated_texts(counted: DataFrame, root: DataFrame) -> DataFrame:
    """``host, feature`` of texts that nearly all articles of a host of several have at one place."""
    m = F.sum("k").alias("articles")
    sites = counted.where("not content and path = ''").groupBy("host").agg(m).where(F.col("articles") >= LEAST_ARTICLES)
    texts = counted.where((F.col("content")) & (F.col("k") >= LEAST_PAGES)).join(sites, "host").join(root, "host")
    importance = F.round(1 - F.log("k") / F.log("articles"), 9)
    return texts.where((importance < LEAST_TEXT_IMPORTANCE) & (importance < F.col("root") / 2)).select("host", "feature")


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``pages`` with ``main_text``: white space in a block is one space, blocks are joined by one space.

    Null and empty pages have an empty text; a null url belongs to the host '';
    pages of any length are read whole, one at a time. Repeated rows have equal
    texts and count as one article. A column named like the result is replaced;
    others are kept, whatever their names. Low branches and texts are joined to
    pages by host, as one list for each host that has any: a text in it is one
    of nearly all articles, so there are about as many as a page has blocks.
    """
    counted = write_through(feature_counts(pages, url, html), "style-features")
    tree = write_through(style_tree(counted), "style-tree")
    # Where whole pages come back, so that the root itself has little importance, no branch stands out.
    root = tree.where("path = ''").select("host", F.col("importance").alias("root"))
    branches = tree.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < least) & (F.col("path") != "")).join(root, "host")
    branches = branches.where(F.col("importance") < F.col("root") / 2).select("host", "path", F.lit(None).cast("bigint").alias("feature"))
    texts = repeated_texts(counted, root).select("host", F.lit(None).cast("string").alias("path"), "feature")
    both = branches.unionByName(texts).groupBy("host").agg(F.collect_set("path").alias("paths"), F.collect_set("feature").alias("texts"))
    low = write_through(both.withColumnsRenamed({"host": "low_host"}), "low-branches")
    plain = pages.drop(into)
    keyed = plain.select(F.struct(*plain.columns).alias("row"), F.col(html).alias("html"), host_column(F.col(url)).alias("host"))
    size = low.agg(F.sum(F.size("paths") + F.size("texts")), F.sum(F.length(F.array_join("paths", "")))).first()
    if (size[0] or 0) <= BROADCAST_BRANCHES and (size[1] or 0) <= BROADCAST_CHARS:
        low = F.broadcast(low)
    joined = keyed.join(low, F.col("host") == F.col("low_host"), "left").select("row", "html", "paths", "texts")
    row = joined.schema["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            lists = zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), batch.column("texts").to_pylist())
            texts = [main_text(page, set(paths or ()), set(again or ())) for page, paths, again in lists]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(run, T.StructType([row, T.StructField("text", T.StringType())]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in plain.columns], F.col("text").alias(into))
