"""HTML trees to markdown, and the choice of a page's main content."""

from __future__ import annotations

import re

from webloom.functions.htmltree import INLINE, Node, parse, squeeze, title_of
from webloom.functions.selectors import select

SKIP = {"script", "style", "head", "template", "noscript", "iframe", "svg", "input", "button", "select"}
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody thead tr ul".split())


def _inline(n: Node | str) -> str:
    if isinstance(n, str):
        return re.sub(r"[\t\n\r ]+", " ", n)
    if n.tag in SKIP:
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})" if n.attrs.get("src") else ""
    inner = "".join(map(_inline, n.children))
    body = inner.strip()
    if not body:
        return inner
    left, right = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if n.tag in ("b", "strong"):
        return f"{left}**{body}**{right}"
    if n.tag in ("i", "em"):
        return f"{left}*{body}*{right}"
    if n.tag in ("code", "tt", "kbd", "samp"):
        return f"{left}`{body}`{right}"
    if n.tag == "a" and n.attrs.get("href"):
        return f"{left}[{body}]({n.attrs['href']}){right}"
    return inner


def _indent(text: str, first: str, rest: str) -> str:
    lines = text.split("\n")
    return "\n".join([first + lines[0], *[rest + x if x else x for x in lines[1:]]])


def _blocks(n: Node) -> list[str]:
    """Markdown blocks of an element's children."""
    out: list[str] = []
    run: list[Node | str] = []

    def flush() -> None:
        text = "".join(map(_inline, run))
        text = re.sub(r" *\n *", "  \n", text.strip())
        if text:
            out.append(text)
        run.clear()

    for c in n.children:
        if isinstance(c, str) or c.tag not in BLOCKS and c.tag not in SKIP and not any(d.tag in BLOCKS for d in c.walk()):
            run.append(c)
            continue
        flush()
        if c.tag in SKIP:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = squeeze("".join(map(_inline, c.children)))
            out += [f"{'#' * int(c.tag[1])} {text}"] if text else []
        elif c.tag == "hr":
            out.append("* * *")
        elif c.tag == "pre":
            out.append(f"```\n{c.text().strip(chr(10))}\n```")
        elif c.tag == "blockquote":
            inner = "\n\n".join(_blocks(c))
            out += [_indent(inner, "> ", "> ").replace("\n\n", "\n>\n")] if inner else []
        elif c.tag in ("ul", "ol"):
            items = []
            for i in (x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                mark = f"{len(items) + 1}. " if c.tag == "ol" else "- "
                inner = "\n".join(_blocks(i))
                if inner:
                    items.append(_indent(inner, mark, " " * len(mark)))
            out += ["\n".join(items)] if items else []
        elif c.tag == "li":
            inner = "\n".join(_blocks(c))
            out += [_indent(inner, "- ", "  ")] if inner else []
        elif c.tag == "table":
            rows = [[squeeze("".join(map(_inline, d.children))) for d in r.children if isinstance(d, Node) and d.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                wide = max(map(len, rows))
                rows = [r + [""] * (wide - len(r)) for r in rows]
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))
        else:
            out += _blocks(c)
    flush()
    return out


def to_markdown(root: Node) -> str:
    return "\n\n".join(_blocks(root)).strip()


#: Words in ids and classes that speak against and for a container.
AGAINST = re.compile(r"\b(ad|ads|advert|banner|breadcrumb|comment|cookie|footer|menu|nav|promo|related|share|sidebar|social|sponsor)\b", re.IGNORECASE)
FOR = re.compile(r"\b(article|body|content|entry|main|post|story|text)\b", re.IGNORECASE)
DROP = {"nav", "aside", "footer", "form"}


#: Elements that hold a paragraph's text, and containers that do where they hold no block.
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"}
BOXES = {"div", "section", "article", "main", "span"}
#: Letters of a paragraph that counts; share of the best container's score that makes a sibling part of the content.
LEAST_TEXT, SIBLING = 25, 0.25
#: Passes over a page, each dropping less: by names and tags, by tags, nothing. What a later one finds must have so many letters.
PASSES, LATER = (2, 1, 0), 250


def _letters(n: Node) -> int:
    return len(squeeze(n.text()))


def _linked(n: Node) -> float:
    """The share of an element's text that stands in links."""
    return min(1.0, sum(_letters(a) for a in n.walk() if a.tag == "a") / max(_letters(n), 1))


def _scores(root: Node, strict: int) -> dict[int, tuple[float, Node]]:
    """What each element is worth as a container.

    A paragraph's worth (its length and commas, less the share in links) goes to all elements above
    it, whole to the nearest and by growing parts to the others (text and link density, Kohlschuetter et al., 2010), so that content
    in many small boxes adds up in what holds them all.
    """
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for n in root.walk():
        box = n.tag in BOXES and not any(c.tag not in INLINE and c.tag != "br" for c in n.children if not isinstance(c, str))
        if not (box or n.tag in PARAGRAPHS) or strict and (_dropped(n, strict) or any(_dropped(a, strict) for a in _above(n))):
            continue
        text = squeeze(n.text())
        if len(text) < LEAST_TEXT or box and n.parent is not None and n.parent.tag in PARAGRAPHS:
            continue
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _linked(n))
        for level, a in enumerate(_above(n)):
            if a.tag == "#document":
                break
            nodes[id(a)] = a
            score[id(a)] = score.get(id(a), 0) + worth / (level + 1 if level < 2 else 3 * level)
    for k, n in nodes.items():
        name = f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}"
        score[k] *= (1.25 if n.tag in ("article", "main") or FOR.search(name) else 1) * (1 - _linked(n))
    return {k: (score[k], n) for k, n in nodes.items()}


def main_content(root: Node, strict: int = PASSES[0]) -> list[Node]:
    """The container of the greatest worth, and those of its siblings that are worth a good part of it or are plain paragraphs of some length."""
    scores = _scores(root, strict)
    if not scores:
        return []
    most, best = max(scores.values(), key=lambda x: x[0])
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    out = []
    for n in (c for c in best.parent.children if not isinstance(c, str)):
        own = scores.get(id(n), (0.0, n))[0]
        plain = n.tag == "p" and _letters(n) >= 4 * LEAST_TEXT and _linked(n) < 0.25
        if n is best or not (strict and _dropped(n, strict)) and (own >= max(SIBLING * most, 1.0) or plain):
            out.append(n)
    return out


def _above(n: Node):
    while n.parent is not None:
        n = n.parent
        yield n


def _dropped(n: Node, strict: int = PASSES[0]) -> bool:
    name = f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}"
    return n.tag in DROP or strict > 1 and bool(AGAINST.search(name)) and not FOR.search(name)


def _idle(n: Node) -> bool:
    """Lists, tables and boxes of a container that are links for the most part and say little besides."""
    return n.tag in ("ul", "ol", "table", "div", "section") and _letters(n) > 0 and _linked(n) > 0.6 and _letters(n) * (1 - _linked(n)) < 4 * LEAST_TEXT


def _without(n: Node, strict: int = PASSES[0]) -> Node:
    """A copy without navigation, forms, advertisements and boxes of links."""
    out = Node(n.tag, n.attrs, n.parent)
    out.children = [c if isinstance(c, str) else _without(c, strict) for c in n.children if isinstance(c, str) or not (strict and (_dropped(c, strict) or _idle(c)))]
    return out


def extract_main(page: str | Node) -> tuple[str, str]:
    """(title, markdown) of a page (or its tree): its main content, or all of it where none is found.

    A pass that finds less than a tenth of the page's text gives way to one that drops less; if that finds little too, all of the page counts.
    """
    root = page if isinstance(page, Node) else parse(page)
    title = title_of(root)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    for strict in PASSES:
        holder = Node("#document", {}, None)
        holder.children = [_without(n, strict) for n in main_content(root, strict)]
        text = to_markdown(holder) if holder.children else ""
        if text and (strict == PASSES[0] or len(text) >= LATER) and (strict == PASSES[-1] or 10 * len(text) >= _letters(body)):
            head = next((squeeze(n.text()) for n in root.walk() if n.tag == "h1"), "")
            return title or head, text
    return title, to_markdown(root)


def extract_selector(html: str, css: str) -> str:
    """Markdown of all elements that match, in order, nested ones again; none: empty."""
    found = select(parse(html), css)
    holder = Node("#document", {}, None)
    holder.children = list(found)
    return to_markdown(holder) if found else ""
