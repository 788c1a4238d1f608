"""Main content of layouts whose main text is known, by the F1 of its words."""

from collections import Counter

import pytest

from webloom.functions import markdown

WORDS = "harbour village morning letter window garden river stone bridge market story winter silver lantern cousin travel pocket answer island mirror".split()


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * (3 + seed % 5)) % len(WORDS)] + ("," if i % 9 == 8 else ".") * (i % 9 == 8 or i % 13 == 12) for i in range(n))


def paras(seed, k, n=60, tag="p"):
    return "".join(f"<{tag}>{prose(seed + i, n)}</{tag}>" for i in range(k))


MENU = "<ul>" + "".join(f'<li><a href="/{w}">Go to {w} and more pages about it</a></li>' for w in WORDS) + "</ul>"
NOISE = "Subscribe now to our weekly newsletter, and never miss a single offer again from us."
#: name -> (page, main text as html)
LAYOUTS = {
    "article": (f"<nav>{MENU}</nav><article>#</article><footer>{NOISE}</footer>", paras(1, 5)),
    "main": (f"<header>{MENU}</header><main>#</main><aside>{MENU}<p>{NOISE}</p></aside>", paras(2, 4)),
    "divs by class": (f'<div class="menu">{MENU}</div><div class="post-body">#</div><div class="sidebar"><p>{NOISE}</p></div>', paras(3, 6)),
    "no names": (f"<div>{MENU}</div><div>#</div><div>{MENU}</div>", paras(4, 5)),
    "split in sections": (f"<nav>{MENU}</nav><div>#</div>", f"<section>{paras(5, 3)}</section><section>{paras(9, 3)}</section><section>{paras(13, 3)}</section>"),
    "deep boxes": (f"<div><div>{MENU}</div></div><div><div><div>#</div></div></div>", "".join(f"<div><div>{p}</div></div>" for p in paras(6, 6).split("</p>") if p)),
    "text in divs": (f"<div>{MENU}</div><div id='x'>#</div>", paras(7, 6, tag="div")),
    "table layout": (f"<table><tr><td>{MENU}</td><td>#</td></tr></table>", paras(8, 5)),
    "list of paragraphs": (f"<nav>{MENU}</nav><div>#</div>", f"<p>{prose(9)}</p><ul><li>{prose(10, 30)}</li><li>{prose(11, 30)}</li></ul><p>{prose(12)}</p>"),
    "quotes": (f"<div>{MENU}</div><article>#</article>", f"<p>{prose(13)}</p><blockquote>{prose(14)}</blockquote>{paras(15, 2)}"),
    "code": (f"<div>{MENU}</div><article>#</article>", f"<p>{prose(16)}</p><pre>{prose(17, 40)}</pre>{paras(18, 2)}"),
    "links inside text": (f"<div>{MENU}</div><div>#</div>", "".join(f"<p>{prose(i)} <a href='/x'>see this</a> {prose(i + 1, 20)}</p>" for i in range(19, 23))),
    "share box inside": (f"<article>#<div class='share'>{MENU}</div></article>", paras(24, 4)),
    "related inside": (f"<div class='content'>#<div class='related'><p>{NOISE}</p>{MENU}</div></div>", paras(25, 4)),
    "unnamed link box inside": (f"<article>#<div>{MENU}</div></article>", paras(26, 5)),
    "comments after": (f"<article>#</article><div class='comment'>{paras(40, 1, 30)}</div><div class='comment'>{paras(41, 1, 30)}</div>", paras(27, 6)),
    "form": (f"<form><p>{NOISE}</p></form><div>#</div>", paras(28, 4)),
    "short teaser before": (f"<div><p>{NOISE}</p></div><div>#</div><div><p>{NOISE}</p></div>", paras(29, 6)),
    "paragraphs in body": (f"<nav>{MENU}</nav>#<footer><p>{NOISE}</p></footer>", paras(30, 5)),
    "content named like a menu": (f"<header><p>{NOISE}</p></header><div class='menu'>#</div>", paras(31, 6)),
    "one long paragraph": (f"<div>{MENU}</div><div>#</div>", paras(32, 1, 200)),
    "headings": (f"<div>{MENU}</div><div id='story'>#</div>", "".join(f"<h2>Part {i}</h2>{paras(33 + i, 2)}" for i in range(3))),
}


def words(text):
    return Counter("".join(c.lower() if c.isalnum() else " " for c in text).split())


def f1(got, want):
    both = (got & want).total()
    return 2 * both / (got.total() + want.total()) if both else 0.0


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, main = LAYOUTS[name]
    title, text = markdown.extract_main(f"<html><head><title>T</title></head><body>{page.replace('#', main)}</body></html>")
    assert title == "T"
    assert f1(words(text), words(markdown.extract_main(f"<body>{main}</body>")[1])) >= 0.95, text[:300]


def test_mean():
    score = [f1(words(markdown.extract_main(f"<body>{p.replace('#', m)}</body>")[1]), words(markdown.extract_main(f"<body>{m}</body>")[1])) for p, m in LAYOUTS.values()]
    assert sum(score) / len(score) >= 0.985


def test_a_part_in_links_is_left_out():
    page = f"<body><div>{paras(1, 5)}<ul><li><a href='/a'>{prose(2, 10)}</a></li><li><a href='/b'>{prose(3, 10)}</a></li></ul></div></body>"
    assert "](/a)" not in markdown.extract_main(page)[1]
    assert markdown.extract_main("<body><p>too short</p></body>")[1] == "too short"
