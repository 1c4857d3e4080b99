"""Containers of a page that may hold its article, with what they measure and the paragraphs in them.

Python walks the tree once and gives measures; scores, ranks and the choice are columns (operators/bodies.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from ..functions.text import BOILERPLATE_LINES
from .dom import Node, tree

#: Elements and sections that never hold article text (fixed values).
STRIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "button", "input", "select", "textarea", "noscript", "iframe", "svg"}
STRIPPED_ROLES = {"navigation", "banner", "complementary", "contentinfo"}
STRIPPED_CLASSES = {
    "related", "related-posts", "related-articles", "more-stories", "recommended", "newsletter", "signup", "subscribe", "social-share", "share-buttons", "comments", "comment-section",
    "tag-cloud", "tags", "author-bio", "sidebar", "ad", "advertisement", "sponsored",
}
#: Class and id values of sections behind an article, of what stands beside its text, of leads and of captions (fixed values).
END_NAMES = r"related|recommended|most.?read|popular|trending|more.?stories|more.?articles|more.?from|also.?read|see.?also|around.?the.?web|newsletter|signup|subscribe|follow.?us|social.?share|share.?buttons?|share.?bar|comments?|comment.?section|disqus|author.?bio|author.?profile|about.?the.?author|sidebar|tag.?cloud|topics?$"
BESIDE_NAMES = r"byline|author.?info|publish.?date|article.?date|share|social.?bar|bookmark|image.?caption|photo.?credit|figcaption|newsletter|signup"
LEAD_NAMES = r"lead|summary|excerpt|standfirst|intro|teaser|subtitle|kicker|dek|subhead|highlight|key.?point|tldr"
CAPTION_NAMES = r"figcaption|gallery|image.?caption|video.?caption|media.?caption|photo.?credit"
#: Short texts that head a section behind an article (fixed values).
END_TEXTS = (
    r"^more\s+(by|from|stories|news|on|about)|^more\s*$|^related\s*(articles?|stories|posts?|content|links?|news)?$|^recommended\s*(articles?|stories|posts?|for\s*you)?$|^most\s*(read|popular|viewed|shared|commented)"
    r"|^popular\s*(articles?|stories|posts?|now|today)?$|^trending\s*(now|today|stories|articles?)?$|^latest\s*(news|stories|articles?|updates?)?$|^read\s*more$|^also\s*read$|^see\s*also$|^around\s*the\s*web$"
    r"|^you\s*may\s*also\s*(like|enjoy)|^from\s*(our|the)\s*(partners?|sponsors?|network)|^sponsored\s*(content|stories|by)|^top\s*(stories|articles?|news)|^elsewhere\s*on\s*\w+"
)
#: Containers in order of preference, by name, and the least text of any other one (fixed values).
SELECTORS = ["article", "main article", "[itemprop=articleBody]", "[property=articleBody]", ".article-body", ".article__body", ".article-content", ".article__content", ".entry-content", ".post-content", ".post__content", ".content", "main"]
OTHER, OTHER_TEXT = "div/section", 200
PARAGRAPH_TAGS = {"p", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_END, _BESIDE, _LEAD, _CAPTION, _END_TEXT = (re.compile(p, re.I) for p in (END_NAMES, BESIDE_NAMES, LEAD_NAMES, CAPTION_NAMES, END_TEXTS))
_FURNITURE = re.compile("|".join(f"(?:{p})" for p in BOILERPLATE_LINES), re.I)
_LETTERS, _DENSE = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


def is_meaningful(t: str) -> bool:
    """As functions.text.is_meaningful, of a trimmed text."""
    if len(t) < 20:
        return False
    letters = len(_LETTERS.findall(t))
    if letters < 0.4 * len(t):
        return False
    return letters >= 12 if _DENSE.search(t) else len(t.split()) >= 4


def is_stripped(n: Node) -> bool:
    return n.tag in STRIPPED or n.attrs.get("role", "") in STRIPPED_ROLES or not STRIPPED_CLASSES.isdisjoint(n.attrs.get("class", "").split())


def ends_article(n: Node) -> bool:
    """Whether an element begins what stands behind an article, by its names, role or kind, or, for headings and other
    short elements, by its text."""
    if n.tag == "aside" or n.attrs.get("role", "").lower() in ("complementary", "navigation") or _END.search(n.names):
        return True
    if n.tag in ("p", "div", "section", "article"):
        return False
    t = n.text().strip()
    return 0 < len(t) < (80 if n.tag in HEADINGS and n.tag != "h1" else 60) and bool(_END_TEXT.search(t))


def _within_end(n: Node, known: dict[int, bool]) -> bool:
    for x in n.up():
        if id(x) not in known:
            known[id(x)] = ends_article(x)
        if known[id(x)]:
            return True
    return False


def _clean(n: Node) -> str:
    return " ".join(n.text(is_stripped).split())


def _blocks(n: Node) -> Iterator[Node]:
    """Paragraph elements below (and not inside stripped ones), in order."""
    stack = [c for c in reversed(n.children) if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        if is_stripped(x):
            continue
        if x.tag in PARAGRAPH_TAGS:
            yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def paragraphs_of(box: Node, ends: dict[int, bool] | None = None) -> list[str]:
    """The meaningful paragraphs of a container, each once, up to the first element that ends an article: those of its
    children; where they are fewer than three, of all that is in it, then of children that hold text without
    paragraphs; where there are none, its text at empty lines."""
    ends = {} if ends is None else ends
    found: dict[str, None] = {}

    def take(t: str) -> None:
        if is_meaningful(t):
            found.setdefault(t)

    children = [c for c in box.children if isinstance(c, Node) and not is_stripped(c)]
    for child in children:
        if ends_article(child):
            break
        if _BESIDE.search(child.names):
            continue
        stop = False
        for b in [child, *_blocks(child)] if child.tag in PARAGRAPH_TAGS else _blocks(child):
            if _within_end(b, ends):
                stop = True
                break
            take(_clean(b))
        if stop:
            break
    if len(found) < 3:
        for b in _blocks(box):
            if _within_end(b, ends):
                break
            take(_clean(b))
    if len(found) < 3:
        for child in children:
            if child.tag not in ("div", "section"):
                continue
            if ends_article(child):
                break
            t = _clean(child)
            if not _BESIDE.search(child.names) and sum(x.tag == "p" for x in child.elements()) < 2 and len(t.split()) >= 6 and re.search("[,.;:!?]", t):
                take(t)
    if not found:
        for part in re.split(r"\n[ \t]*\n\s*", box.text(is_stripped)):
            take(" ".join(part.split()))
    return list(found)


def _selector(n: Node) -> str | None:
    classes = n.attrs.get("class", "").split()
    if n.tag == "article":
        return "article"
    for attr in ("itemprop", "property"):
        if n.attrs.get(attr) == "articleBody":
            return f"[{attr}=articleBody]"
    for s in SELECTORS[4:12]:
        if s[1:] in classes:
            return s
    return "main" if n.tag == "main" else None


def measure(n: Node, selector: str) -> tuple | None:
    """(selector, paragraphs, raw_length, clean_length, link_share, headings, furniture, repeated, lead, caption, bullets,
    ends), or None for a container without a paragraph."""
    paras = paragraphs_of(n)
    if not paras:
        return None
    clean = n.text(is_stripped).strip()
    inside = [x for x in n.elements()]
    kept = [x for x in inside if not any(is_stripped(a) for a in _between(x, n))]
    linked = sum(len(x.text().strip()) for x in kept if x.tag == "a")
    items = [len(x.text().strip()) for x in inside if x.tag == "li"]
    bullets = len(paras) >= 2 and len(items) > 3 and len(items) > 2 * sum(x.tag == "p" for x in inside) and sum(items) / len(items) < 100
    lower = [p.lower() for p in paras]
    return (
        selector, paras, len(n.text().strip()), len(clean), linked / len(clean) if clean else 0.0, sum(x.tag in HEADINGS for x in kept), min(1.0, 0.1 * sum(bool(_FURNITURE.match(p)) for p in paras)),
        len(lower) - len(set(lower)), bool(_LEAD.search(n.names)), bool(_CAPTION.search(f"{n.tag} {n.names}")), bullets, sum(ends_article(x) for x in inside if x.tag in ("h2", "h3", "h4", "h5", "h6", "div", "section", "aside")),
    )


def _between(x: Node, top: Node) -> Iterator[Node]:
    while x is not None and x is not top:
        yield x
        x = x.parent


def containers(html: str | None) -> list[tuple]:
    """Measures of a page's containers, preferred ones first, each group in document order."""
    named: list[tuple[int, Node, str]] = []
    others: list[Node] = []
    for n in tree(html).elements():
        s = _selector(n)
        if s is not None:
            named.append((SELECTORS.index(s), n, s))
        elif n.tag in ("div", "section"):
            others.append(n)
    out = [m for _, n, s in sorted(named, key=lambda x: x[0]) if (m := measure(n, s))]
    return out + [m for n in others if len(n.text().strip()) >= OTHER_TEXT and (m := measure(n, OTHER)) and len(m[1]) >= 2]


_COLUMNS = ["selector", "paragraphs", "raw_length", "clean_length", "link_share", "headings", "furniture", "repeated", "lead", "caption", "bullets", "ends"]
_DDL = "selector string, paragraphs array<string>, raw_length int, clean_length int, link_share double, headings int, furniture double, repeated int, lead boolean, caption boolean, bullets boolean, ends int"


def page_containers(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, measures) of the containers of each page.  Null and empty pages, and pages without a paragraph, have
    none; a page that comes twice has its containers twice; extra columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *m) for k, h in zip(b[key], b[html]) for i, m in enumerate(containers(h))]
            yield pd.DataFrame(rows, columns=[key, "ord", *_COLUMNS])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, ord int, {_DDL}")
