"""Blocks of web pages by one pass over the markup, in time linear in the page whatever it holds."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

_STOP = re.compile("[>\"']")
_TAG_NAME = re.compile(r"[^\s/>]+")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAME = re.compile(r"[a-z]+")
_LONG_REFERENCE = re.compile(r"&#0*[0-9]{8,}")
#: Elements skipped with all they hold, up to their end tag or the end of the page.
SKIPPED = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style noscript template textarea iframe svg object select title".split()}
#: Elements without content, that end a block, that hold the article, and that never belong to it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside form button dialog menu head label search".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
#: Elements whose text is an article's own where they stand in one.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption".split())
PARAGRAPH_ENDS = BLOCK - frozenset(("body", "html", "head", "option", "optgroup"))


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:
        # A number of more digits than Python reads; no character has it.
        return entities.unescape(_LONG_REFERENCE.sub("&#99999999", text))


def attributes(text: str) -> tuple[str, bool, set[str]]:
    """Role, whether hidden, and the words of class, id and role."""
    role, hidden, names = "", False, set()
    for m in _ATTR.finditer(text):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names.update(_NAME.findall(value))
            if key == "role":
                role = value
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "style" and _HIDING.search(value):
            hidden = True
    return role, hidden, names


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order.

    Nothing is searched twice: what is not found ahead of one tag is not looked for again.
    Without a ">" ahead the rest is text; a quote left open does not hide the tags after it.
    """
    at = i = 0
    n = len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    last_cdata, quotes = page.rfind("]]>"), True

    def tag_end(j: int) -> int:
        nonlocal quotes
        first = page.find(">", j) + 1
        while quotes:
            m = _STOP.search(page, j)
            if m is None:
                quotes = False
                break
            j = m.end()
            if m[0] == ">":
                return j
            k = m.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=" and last[m[0]] >= j:
                j = page.find(m[0], j) + 1
        return first

    while (i := page.find("<", i)) >= 0:
        c = page[i + 1 : i + 2]
        if c == "!" and page.startswith("<!--", i):
            yield "text", decoded(page[at:i]), ""
            end = page.find("-->", i + 4)
            at = i = n if end < 0 else end + 3
        elif c == "!" and page.startswith("<![CDATA[", i) and last_cdata >= i + 9:
            yield "text", decoded(page[at:i]), ""
            end = page.find("]]>", i + 9)
            yield "text", page[i + 9 : end], ""
            at = i = end + 3
        elif last[">"] < i:
            break
        elif c == "?" or (c == "!" and page[i + 2 : i + 3].isalpha()):
            yield "text", decoded(page[at:i]), ""
            at = i = page.find(">", i) + 1
        else:
            name_at = i + 2 if c == "/" else i + 1
            a = page[name_at : name_at + 1]
            if not (a.isascii() and a.isalpha()):
                i += 1
                continue
            yield "text", decoded(page[at:i]), ""
            at = i = tag_end(name_at)
            tag = page[name_at : i - 1]
            name = _TAG_NAME.match(tag)[0]
            rest, name = tag[len(name) :], name.lower()
            if c == "/":
                yield "close", name, ""
            elif name in SKIPPED and not (name == "svg" and rest.endswith("/")):
                close = SKIPPED[name].search(page, i)
                end = -1 if close is None else page.find(">", close.end())
                at = i = n if end < 0 else end + 1
            else:
                yield "open", name, rest
    yield "text", decoded(page[at:]), ""


def page_blocks(page: str | None) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the page has an article element, and (place, text) of its blocks.

    Places: main, in a TEXT element of an article; inner, elsewhere in an article; chrome;
    open, outside both.
    """
    blocks: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, article, chrome
    block_at: list[int] = []  # places of BLOCK elements in the stack
    inside: Counter[str] = Counter()
    main = chrome = 0
    article = False

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            own = block_at and stack[block_at[-1]][0] in TEXT
            blocks.append(("chrome" if chrome else "open" if not main else "main" if own else "inner", text))

    def pop() -> None:
        nonlocal main, chrome
        name, m, c = stack.pop()
        inside[name] -= 1
        main -= m
        chrome -= c
        if block_at and block_at[-1] == len(stack):
            block_at.pop()

    for kind, name, rest in events(page or ""):
        if kind == "text":
            if name:
                held.append(name)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if kind == "close":
            if inside[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in PARAGRAPH_ENDS and block_at:
            # A paragraph or entry left open, with whatever it holds, ends here.
            nearest = stack[block_at[-1]][0]
            if nearest == "p" or nearest == name == "li":
                for _ in range(len(stack) - block_at[-1]):
                    pop()
        if rest.rstrip().endswith("/") and name not in BLOCK:
            continue
        role, hidden, names = attributes(rest) if rest and not rest.isspace() else ("", False, set())
        is_chrome = name in CHROME or hidden or bool(names & CHROME_NAMES and name not in ("body", "html") and name not in MAIN) or (name == "header" and not main)
        # An article within comments or a sidebar is theirs.
        is_main = not is_chrome and not chrome and (name in MAIN or role in MAIN)
        article |= is_main
        if name in BLOCK:
            block_at.append(len(stack))
        inside[name] += 1
        stack.append((name, is_main, is_chrome))
        main += is_main
        chrome += is_chrome
    flush()
    return article, blocks
