"""Main text of web pages by site template removal.

Pages are parsed into element trees, and every element subtree that could be a template part is hashed (tag, class,
id, text and the hashes below it). Spark counts, for each host, the distinct pages (by their text: copies of a page
count once) that have the subtree; subtrees on `min_pages` or more, and on `min_share` of the host's pages or more, are
the site's template and are deleted. What stands beside an article (or main element) can't be its text, so there
`beside_share` is enough. Elements that say themselves what they are go too: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments; with named=False only scripts and their like, and the rest is left
to the counts. What is left of the article (else of the main element, else of the page) is the text.

Within an article, a class or id speaks only as a whole (`ad`, `share-buttons`, but not `share-price`), and never for
prose: a part of a name there is as likely to be what the text is about.

Near copies of a page count about once: pages are counted by each of 15 MinHash values of the 5-word shingles of their
texts, which near copies mostly share, and a subtree is template if over half of these counts reach both limits. A host
that has little else than many near copies of one page can't be told from one whose template is most of its pages.

Prose (paragraphs, headings and the like) within an article or main element is template only on `prose_pages` or more
and on `prose_share` or more of the host's pages: a passage that some articles share stays, a line under every article
goes.

The template's hashes go to the tasks as one array while there are at most `held_hashes` of them; beyond that they
are joined to the pages by Spark. Both give the same rows.

Defined results: null html has empty text; a page without tags is its own text; pages whose url is null or has no
host share one nameless host; unclosed and misnested tags are closed as browsers close them; repeated rows each get
their own result; very long and deeply nested pages are parsed in one walk; ids come back as they were, null ones beside
large ones too; further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import checkpoint_dir
from cadenza.llm.simhash import minima, shingle_set

MIN_PAGES, MIN_SHARE, VALUES, HELD_HASHES = 5, 0.25, 15, 1_000_000
PROSE_PAGES, PROSE_SHARE, BESIDE_SHARE = 20, 0.5, 0.02
#: Kinds of subtrees: on a page without an article, article prose, beside an article.
LOOSE, IN_PROSE, BESIDE = range(3)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")

#: Elements as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCKS = CLOSES_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption br option legend".split())
#: An element of the first kind ends an open one of the second kind, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote li dt dd tr td th ul ol dl table thead tbody tfoot caption figure figcaption".split())
LANDMARKS = frozenset(("article", "main"))

#: Elements, roles and parts of class and id names that say that an element isn't part of the article.
LEFT_OUT = RAW | frozenset("head nav footer aside form menu dialog select button input svg math canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
PARTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget
    widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation navi footer masthead
    comment comments commentlist disqus replies reply respond pagination pager skip toolbar disclaimer paywall""".split()
)
HEADER_PARTS = frozenset(("header", "topbar"))
#: What a name within an article may hold besides such parts.
HOLDERS = frozenset("area bar block box btn button buttons container form group icon icons inner item items label link links list module outer panel section slot space top bottom unit wrap wrapper".split())
#: Compounds written as one word: what they begin or end with.
COMPOUND = re.compile(r"(?:cookie|newsletter|sidebar|breadcrumb|comment|advert|sponsor|navbar|popup|disqus|promo)[a-z]*|[a-z]*(?:nav|footer|sidebar|menu|comments|banner|popup|adslot|adbox)")


#: Elements whose content is no text of the page, whatever they are called.
BARE = RAW | frozenset("head select button input svg math canvas object audio video".split())


def says_part(names: str, tag: str) -> bool:
    """Whether a part of an element's class and id names says that it is left out."""
    parts = {p.lower() for p in NAME_PART.findall(names)}
    return bool(parts & PARTS) or any(map(COMPOUND.fullmatch, parts)) or (bool(parts & HEADER_PARTS) and tag not in HEADINGS)


def says_whole(name: str) -> bool:
    """Whether all of one name says so."""
    parts = {p.lower() for p in NAME_PART.findall(name)}
    speaking = {p for p in parts if p in PARTS or COMPOUND.fullmatch(p)}
    return bool(speaking) and parts - speaking <= HOLDERS


class Page:
    """An element tree in lists: the tag, class and id, parent and content (texts and child numbers) of each element, and
    whether it is within an article or main element."""

    def __init__(self, html: str, named: bool = True):
        self.named = named
        self.tags, self.names, self.parents, self.content, self.out, self.inside = ["html"], [""], [-1], [[]], [False], [False]
        open_, depth = [0], Counter()
        at, low = 0, None
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self.content[open_[-1]].append(html[at : m.start()])
            at = m.end()
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if depth[tag]:
                    while True:
                        last = self.tags[open_.pop()]
                        depth[last] -= 1
                        if last == tag:
                            break
                elif tag in ("p", "br"):  # browsers open one
                    self._add(tag, "", open_[-1])
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P and depth["p"]:
                self._end(open_, depth, {"p"}, {"table", "td", "th", "caption", "button"})
            if tag in ENDS and any(depth[t] for t in ENDS[tag][0]):
                self._end(open_, depth, *ENDS[tag])
            node = self._add(tag, attributes, open_[-1])
            if tag in VOID:
                continue
            if tag in RAW:
                low = low if low is not None else html.lower()
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
                if len(low) != len(html) and end >= 0:  # lower case can be longer; look in the text itself
                    found = re.compile(f"</{tag}", re.I).search(html, m.end())
                    at = found.start() if found else len(html)
            open_.append(node)
            depth[tag] += 1
        if at < len(html):
            self.content[open_[-1]].append(html[at:])

    def _end(self, open_: list[int], depth: Counter, kinds: set[str], bounds: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            t = self.tags[open_[k]]
            if t in kinds:
                for node in open_[k:]:
                    depth[self.tags[node]] -= 1
                del open_[k:]
                return
            if t in bounds:
                return

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tags)
        names, out, inside = "", tag in (LEFT_OUT if self.named else BARE), self.inside[parent] or self.tags[parent] in LANDMARKS
        if attributes and attributes.strip(" /"):
            told = {}
            for k, v in ATTRIBUTE.findall(attributes):
                told.setdefault(k.lower(), unescape(v.strip("\"'")))
            names = " ".join(told.get(k, "") for k in ("class", "id")).strip()
            role = told.get("role", "").lower()
            if tag not in LANDMARKS:
                if self.named:
                    out |= role in ROLES or (tag not in PROSE and any(map(says_whole, names.split())) if inside else says_part(names, tag))
                out |= "hidden" in told or told.get("aria-hidden", "").lower() == "true"
                out |= "display:none" in told.get("style", "").replace(" ", "").lower()
            if role == "main":
                tag = "main"
        if tag == "header" and self.named:
            out |= not inside
        self.tags.append(tag)
        self.names.append(names)
        self.parents.append(parent)
        self.content.append([])
        self.out.append(out)
        self.inside.append(inside)
        self.content[parent].append(node)
        return node

    def subtrees(self) -> dict[int, tuple[int, int]]:
        """The hash and the kind of each subtree that could be a template part, by its element's number."""
        n = len(self.tags)
        around = [False] * n  # elements that hold an article
        for i in range(n - 1, 0, -1):
            if around[i] or self.tags[i] in LANDMARKS:
                around[self.parents[i]] = True
        hashes = [0] * n
        for i in range(n - 1, -1, -1):
            told = [self.tags[i], self.names[i], *(f"#{hashes[c]:x}" if isinstance(c, int) else " ".join(unescape(c).split()) for c in self.content[i])]
            hashes[i] = xxhash.xxh64_intdigest("\x1f".join(x for x in told if x).encode("utf-8", "replace"))
        parts = [i for i in range(1, n) if self.tags[i] in BLOCKS and self.tags[i] not in LANDMARKS and self.content[i]]
        outside = BESIDE if around[0] else LOOSE
        kind = lambda i: (IN_PROSE if self.tags[i] in PROSE else LOOSE) if self.inside[i] else LOOSE if around[i] else outside
        return {i: (hashes[i], kind(i)) for i in parts}

    def text(self, deleted: Container[int] = ()) -> str:
        """The text of the articles, else of the main elements, else of the whole page, without what says that it is left out and the elements given."""
        n = len(self.tags)
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parents[i]] or self.out[i] or i in deleted
        for kind in ("article", "main", "html"):
            roots = [i for i in range(n) if self.tags[i] == kind and not gone[i]]
            if roots:
                break
        told: list[str] = []
        under = set(roots)
        top = [i for i in roots if not self._under(i, under)]
        stack: list[int | str] = top[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                told.append(x)
            elif not gone[x]:
                inner = [c if isinstance(c, int) else unescape(c) for c in self.content[x]]
                edge = [" "] if self.tags[x] in BLOCKS else []
                stack += [*edge, *inner[::-1], *edge]
        return " ".join("".join(told).split())

    def _under(self, node: int, roots: set[int]) -> bool:
        node = self.parents[node]
        while node >= 0:
            if node in roots:
                return True
            node = self.parents[node]
        return False


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_hash(host: str, subtree: int, kind: int = LOOSE) -> int:
    """A signed 64-bit hash of a subtree on a host; prose of articles is told apart, what stands beside them isn't."""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "replace") + subtree.to_bytes(8, "little"), int(kind == IN_PROSE)) - (1 << 63)


def page_values(text: str) -> list[int]:
    """MinHash values of a text's shingles, signed."""
    return minima(shingle_set(text), VALUES).astype(np.int64).tolist()


def page_subtrees(pages: DataFrame, named: bool = True) -> DataFrame:
    """(site, page, values, kinds) from rows (host, html): hashes of each page's host and text, the text's MinHash values,
    and for each kind the page's different subtrees as hashes with their host."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = []
            for host, html in zip(rows["host"], rows["html"], strict=True):
                tree = Page(html, named)
                text, own = tree.text(), set(tree.subtrees().values())
                kinds = [[host_hash(host, *x) for x in own if x[1] == kind] for kind in (LOOSE, IN_PROSE, BESIDE)]
                told.append((host_hash(host, 0), xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63), page_values(text), kinds))
            yield pd.DataFrame(told, columns=["site", "page", "values", "kinds"])

    return pages.mapInPandas(hashed, "site long, page long, values array<long>, kinds array<array<long>>")


def recurring(seen: DataFrame, limits: list[tuple[int, float]]) -> DataFrame:
    """(of): the subtrees that recur on so many pages, and on such a share of their host's pages, by over half of the counts.

    limits: the two for each kind; a subtree's pages are counted kind by kind."""
    parts = seen.select("site", "page", "values", F.posexplode("kinds").alias("kind", "own")).select("site", "page", "values", "kind", F.explode("own").alias("of"))
    limit = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in limits]), F.col("kind") + 1)
    often = parts.groupBy("of", "kind").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= limit(0)).select("of", "kind")
    whole = seen.select("site", F.posexplode("values").alias("k", "value")).distinct().groupBy("site", "k").agg(F.count(F.lit(1)).alias("whole"))
    own = parts.join(often, ["of", "kind"], "left_semi").select("site", "of", "kind", F.posexplode("values").alias("k", "value")).distinct()
    own = own.groupBy("site", "of", "kind", "k").agg(F.count(F.lit(1)).alias("pages"))
    reached = (F.col("pages") >= limit(0)) & (F.col("pages") >= limit(1) * F.col("whole"))
    return own.join(whole, ["site", "k"]).groupBy("of", "kind").agg(F.count_if(reached).alias("n")).filter(2 * F.col("n") > VALUES).select("of").distinct()


def main_text(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    prose_pages: int = PROSE_PAGES,
    prose_share: float = PROSE_SHARE,
    beside_share: float = BESIDE_SHARE,
    named: bool = True,
    held_hashes: int = HELD_HASHES,
) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_deleted (template subtrees) of every row."""
    spark = pages.sparkSession
    held = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host_of(F.col(url_column)).alias("host"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    checkpoint_dir(spark)
    template = recurring(page_subtrees(held.select("host", "html"), named).checkpoint(), [(min_pages, min_share), (prose_pages, prose_share), (min_pages, beside_share)])
    few = template.limit(held_hashes + 1).toPandas()["of"].to_numpy(np.int64)
    schema = f"page_id {held.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_deleted long"

    def cleaned(rows: pa.RecordBatch, listed: list[np.ndarray]) -> pa.RecordBatch:
        texts, n = [], []
        for host, html, hashes in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist(), listed, strict=True):
            tree = Page(html, named)
            subtrees = {i: host_hash(host, *x) for i, x in tree.subtrees().items()} if len(hashes) else {}
            own = np.fromiter(subtrees.values(), dtype=np.int64, count=len(subtrees))
            place = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
            deleted = {i for i, is_in in zip(subtrees, hashes[place] == own if len(own) else [], strict=True) if is_in}
            texts.append(tree.text(deleted))
            n.append(len(deleted))
        told = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), *told], names=["page_id", "url", "text", "n_chars", "n_deleted"])

    if len(few) <= held_hashes:
        sent = spark.sparkContext.broadcast(np.sort(few))  # of a checked size

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield cleaned(rows, [sent.value] * rows.num_rows)

        return held.mapInArrow(clean, schema)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pairs = [(r, host_hash(host, *x)) for r, host, html in zip(rows["row"], rows["host"], rows["html"], strict=True) for x in set(Page(html, named).subtrees().values())]
            yield pd.DataFrame(pairs, columns=["row", "of"]).astype("int64")

    def clean_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield cleaned(rows, [np.sort(np.array(x or [], dtype=np.int64)) for x in rows.column("hashes").to_pylist()])

    row = F.xxhash64("host", "html").alias("row")  # equal pages have equal subtrees
    own = held.select(row, "host", "html").mapInPandas(keyed, "row long, of long").distinct().join(template, "of").groupBy("row").agg(F.collect_list("of").alias("hashes"))
    return held.withColumn("row", row).join(own, "row", "left").mapInArrow(clean_joined, schema)
