"""HTML to flat text blocks: one pass over the markup, linear in its length."""

from __future__ import annotations

import dataclasses
import html as entities
import re
from collections import Counter

# Element names by their role.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video "
                    "select option datalist button textarea title head".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label "
                   "mark nobr q s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODY = frozenset("article main".split())
REGIONS = frozenset("nav menu header footer aside form dialog fieldset address figcaption".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hr main menu nav ol p pre section table ul".split())
HINT = frozenset("ad ads advert advertisement adsense sponsor sponsored promo promotion banner cookie "
                 "cookies consent gdpr notice alert popup modal overlay comment comments disqus reply replies "
                 "sidebar side aside widget nav navbar navigation menu breadcrumb breadcrumbs footer header "
                 "masthead topbar share sharing social related recommended newsletter subscribe signup "
                 "login search pagination pager copyright legal disclaimer toolbar tags".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
MARKS = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = frozenset("class id role aria-label".split())
LAYOUT = frozenset("has with no without".split())       # "has-sidebar" tells of a layout
TOKEN = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}


@dataclasses.dataclass
class Block:
    text: str
    words: int
    linked: int          # words inside links
    heading: bool
    in_body: bool        # inside article or main
    region: bool         # inside a menu, header, footer, sidebar, form
    hint: bool           # inside an element whose class or id names such a part

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def hint_words(value: str, whole: bool) -> set[str]:
    """The words of ``HINT`` in a value; only those that are a name of their own if ``whole``."""
    found = set()
    for name in value.split():
        words = [t.lower() for t in TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
        if words and words[0] not in LAYOUT and not (whole and len(words) > 1):
            found |= HINT.intersection(words)
    return found


def hinted(attributes: str, whole: bool = False) -> tuple[set[str], bool]:
    """The words by which the attributes name a part beside the article; whether they hide it."""
    hints, hidden = set(), False
    for m in ATTRIBUTE.finditer(attributes):           # values are taken whole, so names in them don't count
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in "".join(value.split()).lower()
        elif name in NAMING:
            hints |= hint_words(value, whole)
    return hints, hidden


class _Open:
    __slots__ = ("hint", "hidden", "name")

    def __init__(self, name: str, hint: bool, hidden: bool):
        self.name, self.hint, self.hidden = name, hint, hidden


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, whether article or not."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = links = dropped = 0
    names: Counter[str] = Counter()    # of what is open
    headings = bodies = regions = hints = 0
    missing: set[str] = set()          # what a search has not found up to the end

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            n = text.count(" ") + 1
            region = regions > 0 or names["header"] > 0 and not bodies
            out.append(Block(text, n, min(n, linked), headings > 0, bodies > 0, region, hints > 0))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    def count(o: _Open, step: int) -> None:
        nonlocal links, dropped, headings, bodies, regions, hints
        names[o.name] += step
        links += step * (o.name == "a")
        dropped += step * (o.hidden or o.name in DROPPED)
        headings += step * (o.name in HEADINGS)
        bodies += step * (o.name in BODY)
        regions += step * (o.name in REGIONS and o.name != "header")
        hints += step * o.hint

    def close(k: int) -> None:
        """Close what is open from place k on."""
        for o in stack[k:]:
            count(o, -1)
        del stack[k:]

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        got = html.find(what, at)
        if got < 0:
            missing.add(what)
        return got

    pos, size = 0, len(html)
    while pos < size:
        lt = find("<", pos)
        if lt < 0:
            say(html[pos:])
            break
        say(html[pos:lt])
        nxt = html[lt + 1:lt + 2]
        if nxt in ("!", "?"):
            if html.startswith("<!--", lt):
                end = find("-->", lt + 4)
                pos = size if end < 0 else end + 3
            else:
                end = find(">", lt)
                pos = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:                                  # </ without a name: no text
                end = find(">", lt)
                pos = size if end < 0 else end + 1
            else:
                say("<")
                pos = lt + 1
            continue
        name, at = m[0].lower(), m.end()
        end = -1
        while True:                                      # the > outside quoted values
            q = MARKS.search(html, at)
            if not q:
                break
            if q[0] == ">":
                end = q.start()
                break
            k = q.start() - 1                            # a quote opens a value only after =
            while k >= at and html[k].isspace():
                k -= 1
            quoted = k >= at and html[k] == "="
            stop = find(q[0], q.end()) if quoted else -1
            at = stop + 1 if stop >= 0 else q.end()
        if end < 0:                                      # a tag that the page's end cuts off
            break
        attributes = html[m.end():end]
        pos = end + 1
        if name not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if names[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name == "br":
            say(" ")
        if name in VOID or attributes.endswith("/") and name not in INLINE | RAW:
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"p"} if name in CLOSES_P else {"dt", "dd"} if name in ("dt", "dd") else {name}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in same:
                    close(k)
                    break
                if stack[k].name not in INLINE and stack[k].name != "p":
                    break
        if name == "body" and names["head"]:             # a head that was never closed ends here
            for k, o in enumerate(stack):
                if o.name == "head":
                    close(k)
                    break
        # compound names on an article's own element tell of its layout or subject
        found, hidden = hinted(attributes, name in BODY and not names["article"]) if attributes else (set(), False)
        if name == "header" and bodies:                  # the article's own
            found.discard("header")
        if name in ("html", "body"):
            found, hidden = set(), False
        stack.append(_Open(name, bool(found), hidden))
        count(stack[-1], 1)
        if name in RAW:
            key = f"</{name}"
            stop = None if key in missing else RAW_END[name].search(html, pos)
            if stop is None:
                missing.add(key)
                if name != "noscript":
                    pos = size
            else:
                pos = stop.start()
    if not dropped:
        flush()
    return out
