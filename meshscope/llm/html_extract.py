"""Main text of web pages by consensus host paths.

1. Each page is parsed and its containers are scored: characters of running text
   below them, links discounted, with a bonus for the tags and classes that
   articles use.  One that is mostly links keeps a small share of its characters.
2. Every container votes, with its score relative to the page's best, for its
   generalised path (tags and classes from the root, digits as ``#``).  Spark
   adds up the votes per host and path; the paths with most votes win.
3. Each page is extracted again from its containers on the best winning path, all
   of them, as an article may be split; a page without one (another layout than
   its host's) uses the path of its own best.

Inside the container menus, headers, footers, sidebars, notices, adverts, forms,
comments and scripts are left out; nothing else is dropped or cut.

Defined results: a null or empty html gives an empty text; broken markup is read
as far as it goes; a null url belongs to the empty host; equal pages get equal
texts; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import append, column, struct
from meshscope.plans.iterate import Workspace

WINNERS = 5  # winning paths kept per host
VOTE_FROM = 0.3  # relative score from which a container votes or is used
LINK_SHARE = 0.05  # of its characters, the least score of a container
MAX_PATH = 12  # levels of a path, from the innermost outwards

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg|math|noembed|noframes|xmp|object|canvas)"
    r"\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</\1\s*[^>]*>|\Z))"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.IGNORECASE,
)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre "
    "figure figcaption address details summary header footer nav aside form fieldset menu hgroup "
    "dialog search button select option optgroup label legend".split()
)
LEFT_OUT = frozenset(
    "nav footer aside form menu dialog search button select option optgroup label legend fieldset "
    "head".split()
)
# an open one ends when one of the others begins
ENDS = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}}
# class and id words of parts that are not the article
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored "
    "promo promotion promoted sidebar sidebars aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager toolbar topbar masthead footer foot siteheader cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe "
    "subscription signup login search comment comments commentlist disqus respond reply replies "
    "discussion share sharing social related recommended recommendations recirc teaser "
    "teasers widget widgets skip hidden disclaimer copyright tags tagcloud".split()
)
# boxes whose id is read by its words, outside of article, main and sections; of other
# elements an id is often a topic or a heading's text, so it has to be one of KNOWN_IDS
BOXES = frozenset("div ul ol dl table tr td center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KNOWN_IDS = frozenset(
    "ad ads adsense adbox advertisement sidebar navbar topbar breadcrumb breadcrumbs pagination comments "
    "commentlist comment-list comment-section comments-section comment-form disqus disqus-thread respond "
    "related-posts related-articles related-stories related-content related-links recommended-articles "
    "recommended-posts share-buttons share-bar sharing-buttons social-share social-buttons social-links "
    "newsletter-signup newsletter-form newsletter-box subscribe-form subscription-form signup-form "
    "login-form search-form searchform search-box cookie-banner cookie-notice cookie-consent "
    "gdpr-banner main-menu nav-menu site-nav site-footer site-header skip-link tag-cloud tagcloud".split()
)
_NUMBERED_ID = re.compile(r"(?:comment|div-gpt-ad|google-ads?|ad-slot|ad-unit|ad)-[\d-]+")
# an <article> is left out for these only; its classes often name topics
UNWANTED_ARTICLES = frozenset(
    "ad ads advert sponsored promo teaser teasers related comment comments respond reply".split()
)
WANTED = frozenset("article content post entry story main text body articlebody maincontent".split())
_LAYOUT = re.compile(r"(?:has|no|with|without|is|not|js)[-_]", re.IGNORECASE)  # has-sidebar is no sidebar
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UNWANTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert dialog menu menubar form alertdialog".split()
)


class Page:
    """Blocks of text of one page, and its containers with their scores.

    ``blocks``: (text, containers around it).  ``containers``: [path, text
    characters, link characters, bonus].
    """

    def __init__(self, source: str):
        self._parse(source, by_class=True)
        if not self.blocks:  # a class around the whole page
            self._parse(source, by_class=False)

    def _parse(self, source: str, by_class: bool) -> None:
        self._by_class = by_class
        self.blocks: list[tuple[str, tuple[int, ...]]] = []
        self.containers: list[list] = []
        self._stack: list[tuple[str, bool, int, str]] = []  # tag, left out, container, path
        self._text: list[str] = []
        self._links = 0
        self._link = 0  # depth of the stack at the open link
        self._left_out = 0
        self._open("html", "")
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at = 0
        for token in _TOKEN.finditer(source):
            if token.start() > at:
                self._add(source[at : token.start()])
            at = token.end()
            tag = token[3]
            if not tag:
                if token[1] and token[1].lower() == "title":
                    self._flush()
                elif token[0].startswith("<![CDATA["):
                    self._add(token[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if tag == "a":
                self._link = len(self._stack) if not token[2] and _HREF.search(token[4]) else 0
            elif tag in ("br", "hr", "img", "wbr"):
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._add(" ")
            elif tag not in BLOCKS and tag != "head":
                if not token[2] and tag not in VOID and token[4] and self._unwanted(token[4], tag):
                    self._open(tag, token[4])
                elif token[2]:
                    self._close(tag)
            elif token[2]:
                self._close(tag)
            else:
                self._open(tag, token[4])
        if at < len(source):
            self._add(source[at:])

    def _add(self, text: str) -> None:
        if self._left_out:
            return
        if "&" in text:
            text = entities.unescape(text)
        self._text.append(text)
        if self._link:
            self._links += len(text)

    def _flush(self) -> None:
        """Ends the current block."""
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                around = tuple(x[2] for x in self._stack if x[2] >= 0)
                self.blocks.append((text, around))
                for c in around:
                    self.containers[c][1] += len(text)
                    self.containers[c][2] += self._links
            self._text = []
        self._links = 0

    def _attributes(self, source: str) -> dict[str, str]:
        return {
            m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "")
            for m in _ATTRIBUTE.finditer(source)
        }

    def _unwanted(self, source: str, tag: str) -> bool:
        has = self._attributes(source)
        if not has:
            return False
        if "hidden" in has or has.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", has.get("style", ""), re.IGNORECASE):
            return True
        if has.get("role", "").lower() in _UNWANTED_ROLES:
            return True
        if tag in ("body", "html", "main"):
            return False
        if not self._by_class:
            return False
        unwanted = UNWANTED_ARTICLES if tag == "article" else UNWANTED
        classes = self._words(has.get("class", ""))
        if not classes.isdisjoint(unwanted):
            return True
        name = has.get("id", "")
        if not name or tag in HEADINGS or self._words(name).isdisjoint(unwanted):
            return False
        if any(x[0] in HEADINGS for x in self._stack):
            return False
        known = name.strip().lower().replace("_", "-")
        if known in KNOWN_IDS or _NUMBERED_ID.fullmatch(known):
            return True
        within = any(x[0] in ("article", "main", "section") for x in self._stack)
        return tag in BOXES and not within and "section" not in classes

    @staticmethod
    def _words(names: str) -> set[str]:
        return {w.lower() for n in names.split() if not _LAYOUT.match(n) for w in _WORD.findall(n)}

    def _open(self, tag: str, source: str) -> None:
        self._flush()
        if tag in ("html", "body") and any(x[0] == tag for x in self._stack):
            return
        while self._stack and tag in ENDS.get(self._stack[-1][0], ()):
            self._pop()
        for k in range(len(self._stack) - 1, 0, -1):  # an open item of the same list ends
            inner = self._stack[k][0]
            if inner in WITHIN.get(tag, ()) or tag not in ("li", "dt", "dd", "tr", "td"):
                break
            if tag in ENDS.get(inner, ()):
                while len(self._stack) > k:
                    self._pop()
                break
        if tag == "head":
            self._stack.append((tag, True, -1, ""))
            self._left_out += 1
            return
        out = tag in LEFT_OUT or bool(source and self._unwanted(source, tag))
        if tag == "header" and not any(x[0] in ("article", "main") for x in self._stack):
            out = True
        path, place = (self._stack[-1][3] if self._stack else ""), -1
        if tag in CONTAINERS and not out:
            classes = self._attributes(source).get("class", "").split() if source else []
            name = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
            path = ">".join([*path.split(">")[-(MAX_PATH - 1) :], name]) if path else name
            place = len(self.containers)
            words = {w.lower() for c in classes for w in _WORD.findall(c)}
            bonus = {"article": 1.6, "main": 1.3, "body": 0.8, "html": 0.7, "td": 0.9}.get(tag, 1.0)
            self.containers.append([path, 0, 0, bonus * (1.3 if words & WANTED else 1.0)])
        self._stack.append((tag, out, place, path))
        self._left_out += out

    def _pop(self) -> None:
        self._flush()
        self._left_out -= self._stack.pop()[1]
        if self._link > len(self._stack):  # the block around the link ends
            self._link = 0

    def _close(self, tag: str) -> None:
        if any(x[0] == tag for x in self._stack[1:]):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()

    def scores(self) -> list[float]:
        return [max(LINK_SHARE * chars, chars - 2.0 * links) * bonus for _, chars, links, bonus in self.containers]

    def votes(self) -> dict[str, float]:
        """Path -> the best relative score of a container on it."""
        scores = self.scores()
        best = max(scores)
        found: dict[str, float] = {}
        for (path, *_), score in zip(self.containers, scores):
            if best and score >= VOTE_FROM * best:
                found[path] = max(found.get(path, 0.0), score / best)
        return found

    def text(self, winners: list[str]) -> str:
        scores = self.scores()
        best = max(range(len(scores)), key=lambda k: (scores[k], k))
        together: dict[str, float] = {}
        chars: dict[str, int] = {}
        for (path, n, *_), score in zip(self.containers, scores):
            together[path] = together.get(path, 0.0) + score
            chars[path] = chars.get(path, 0) + n
        chosen, whole = self.containers[best][0], self.containers[0][1]
        for path in winners:
            if chars.get(path) and (together[path] >= VOTE_FROM * scores[best] or 2 * chars[path] >= whole):
                chosen = path
                break
        there = self._on(chosen)
        return "\n\n".join(t for t, around in self.blocks if not there.isdisjoint(around))

    def _on(self, path: str) -> set[int]:
        """The containers on a path; menus (mostly links) share only a path without a name."""
        there = [k for k, c in enumerate(self.containers) if c[0] == path]
        if path.rpartition(">")[2] in ("div", "td", "section", "center"):
            running = [k for k in there if self.containers[k][1] > 2 * self.containers[k][2]]
            there = running or there
        return set(there)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


VOTES = T.ArrayType(struct(path=T.StringType(), vote=T.DoubleType()))


def _votes(sources: list[str | None]) -> list:
    return [[list(Page(s).votes().items()) if s else [] for s in sources]]


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, votes, place): the winning paths of each host, best first."""
    named = pages.select(host_of(column(url_col)).alias("host"), column(html_col).alias("html"))
    votes = append(named, "html", struct(votes=VOTES), _votes, ["host"])
    totals = (
        votes.select("row.host", F.inline("votes"))
        .groupBy("host", "path")
        .agg(F.round(F.sum("vote"), 6).alias("votes"))
    )
    order = W.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), "path")
    return totals.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= WINNERS)


def extract(
    pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None
) -> DataFrame:
    """``row`` (the kept columns), ``text`` and ``n_chars`` of each page."""
    space = Workspace(pages.sparkSession, "html_extract")
    keep = list(pages.columns if keep is None else keep)
    winners = space.materialize(
        host_paths(pages, html_col, url_col)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("paths"))
        .select("host", F.col("paths.path").alias("winners")),
        "winners",
    )
    named = pages.select(
        F.struct(*[column(c) for c in keep]).alias("row"),
        column(html_col).alias("html"),
        host_of(column(url_col)).alias("host"),
    )
    joined = named.join(winners, "host", "left").select("row", "html", "winners")

    def texts(sources, paths):
        found = [Page(s).text(p or []) if s else "" for s, p in zip(sources, paths)]
        return [found, [len(t) for t in found]]

    fields = struct(text=T.StringType(), n_chars=T.LongType())
    return append(joined, ["html", "winners"], fields, texts, ["row"]).select(
        "row.row", "text", "n_chars"
    )
