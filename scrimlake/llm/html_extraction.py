"""Main text of web pages by consensus of each host's pages.

Every page's containers are scored by the prose they hold, and each page votes for the generalised path of
tags and classes of its best container. Votes are added up by host, and every page is read again with its
host's winning path; a page without such a container, or with little in it, uses its own best.

Markup is read by one pass of a tag pattern. Parts that are never article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are left out by tag, role or class.
"""

import html
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head title nav aside footer form button dialog label fieldset menu".split())
_CONTAINERS = frozenset("article main section div body td blockquote".split())
#: Tags that hold paragraphs and the like: names of a page's layout say nothing there.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table thead tbody tr td th dl dt dd li address details summary".split())
_ADS = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|share|sharing|social|hidden"
_EXTRA = _ADS + r"|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|related|recommend\w*|comments?|commentlist|respond|disqus|replies|pagination|pager|breadcrumbs?|toolbar|skip"
_LAYOUT = _EXTRA + r"|nav|navbar|navigation|menu|menubar|masthead|banner|footer|foot|sidebar|side|aside|widget|complementary|contentinfo"


def _words_pattern(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: Words of class, id and role that mark what is no article text: of inline tags, of paragraphs, of other tags outside articles and in them.
_NOISE = {"inline": _words_pattern(_ADS), "prose": _words_pattern(_EXTRA), "inside": _words_pattern(_LAYOUT), "outside": _words_pattern(_LAYOUT + "|header")}
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
_CLOSED_BY = {"p": frozenset("p div section article ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre header footer nav aside form main figure hr".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
_MARKS = re.compile(r"[.!?;:,。，、！？]")


def _step(tag: str, names: str) -> str:
    """A container's place in a generalised path: its tag and classes, digits as #."""
    return ".".join([tag, *sorted(re.sub(r"\d+", "#", x) for x in names.split())])


class Page:
    """blocks: (text, containers, characters in links) in page order; containers: (path, bonus), those above a block by number."""

    def __init__(self, source: str):
        self.blocks, self.containers = [], []
        stack, parts, linked, at = [], [], 0, 0  # stack: (tag, number of the container or -1, noise)

        def noise() -> bool:
            return bool(stack) and stack[-1][2]

        def flush():
            nonlocal parts, linked
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append((text, tuple(n for _, n, _ in stack if n >= 0), linked))
            parts, linked = [], 0

        def add(text: str):
            nonlocal linked
            if text and not noise():
                parts.append(text)
                if any(t == "a" for t, _, _ in stack):
                    linked += len(text)

        for m in _TOKEN.finditer(source):
            add(source[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag == "br":
                add(" ")
                continue
            if tag not in _INLINE:
                flush()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if tag in _VOID:
                continue
            while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            names, hide, ident = "", False, ""
            for a in _ATTRIBUTE.finditer(m[4]):
                value = a[2] or a[3] or a[4] or ""
                key = a[1].lower()
                if key == "class":
                    names = value
                elif key == "style":
                    hide |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key in ("hidden", "aria-hidden"):
                    hide |= key == "hidden" or value.lower() == "true"
                elif key in ("id", "role"):
                    ident += " " + value
            inside = any(t == "article" for t, _, _ in stack)
            kind = "inline" if tag in _INLINE else "prose" if tag in _PROSE else "inside" if inside else "outside"
            named = tag not in ("html", "body", "article", "main") and bool(names or ident) and bool(_NOISE[kind].search(names + ident))
            off = noise() or hide or tag in _NEVER or (tag == "header" and not inside) or named
            number = -1
            if tag in _CONTAINERS and not off:
                number = len(self.containers)
                above = next((self.containers[n][0] for _, n, _ in reversed(stack) if n >= 0), "")
                bonus = 2.0 if tag == "article" else 1.5 if tag == "main" or _ARTICLE.search(names + ident) else 1.0
                self.containers.append((f"{above}/{_step(tag, names)}", bonus))
            if not m[4].endswith("/") or tag not in _INLINE:
                stack.append((tag, number, off))
        add(source[at:])
        flush()

    def scores(self) -> list[float]:
        """Of each container: prose in it, halved for each level between, times its bonus."""
        out = [0.0] * len(self.containers)
        for text, above, linked in self.blocks:
            worth = (len(text) - linked) * (1 + min(3, len(_MARKS.findall(text)) / 10))
            for level, n in enumerate(reversed(above)):
                out[n] += worth / (1 << min(level, 60))
        return [s * bonus for s, (_, bonus) in zip(out, self.containers)]

    def best(self) -> int:
        """The container of the highest score, or the innermost article around it, or else the innermost main. A container
        without classes is a part of the one above it, unless that is the body or adds more text in links than other text."""
        scores = self.scores()
        top = max(range(len(scores)), key=scores.__getitem__) if scores else -1
        around = next((above[: above.index(top) + 1] for _, above, _ in self.blocks if top in above), ())
        steps = {n: self.containers[n][0].rsplit("/", 1)[1] for n in around}
        whole = next((n for tag in ("article", "main") for n in reversed(around) if steps[n].split(".")[0] == tag), None)
        if whole is not None:
            return whole
        for above in reversed(around[:-1]):
            if "." in steps[top] or steps[above] == "body" or self.containers[top][1] > 1:
                break
            added = [(len(text), linked) for text, parents, linked in self.blocks if above in parents and top not in parents]
            if 2 * sum(linked for _, linked in added) > sum(n for n, _ in added):
                break
            top = above
        return top

    def text_of(self, numbers: set[int]) -> str:
        return " ".join(text for text, above, _ in self.blocks if numbers.intersection(above))

    def extract(self, path: str | None) -> str:
        """The text of all containers of the path, or of the page's own best one and those of the same path: if the
        page has none of the path, less than half as much text there, or the path is only a part of its own best."""
        own = self.best()
        if own < 0:
            return " ".join(text for text, _, _ in self.blocks)
        of = lambda path: {n for n, (p, _) in enumerate(self.containers) if p == path}
        mine, voted = self.text_of(of(self.containers[own][0])), of(path)
        if any(own in above and voted.intersection(above[above.index(own) + 1 :]) for _, above, _ in self.blocks):
            return mine  # a part of it would lose the rest
        text = self.text_of(voted) if voted else ""
        return text if 2 * len(text) >= len(mine) else mine


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source or "")
            own = page.best()
            if own >= 0:
                key = (host_of(url), page.containers[own][0])
                votes[key] = votes.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=["page_id", "url", "html", "host"])


def _extract() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s or "").extract(p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html, and pages of nothing but other parts, have an empty text. Broken markup is read as far as
    it goes: what isn't closed ends with the page. Null or odd urls are one host without name. Ties of votes go to
    the path that sorts first. Repeated rows come out alike; extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "extraction")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    votes = rows.select("url", "html").mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # of equal votes the least path: the greatest of (votes, reversed order) isn't at hand for strings, so the least of (-votes, path)
    winners = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("host", F.col("w.path").alias("path"))
    winners = scratch.save(winners, "winners")  # a table of known size: Spark broadcasts it if small, else shuffles
    hosted = rows.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    return hosted.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_extract(), "page_id long, url string, text string, n_chars long")
