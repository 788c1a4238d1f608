"""Selectors against a matcher that knows sets of elements alone."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.functions.htmltree import Node, parse
from webloom.functions.selectors import compile_selector, select

PAGE = parse(
    '<main id="m"><h1 class="a b">T</h1><p id="p1">one</p><p class="x">two <b lang="en-US">b</b></p><ul><li>1</li><li class="on"><a href="/a,b">x</a></li><li data-k="v]w">3</li><li></li></ul>'
    '<p>last</p></main><div id="1st" class="ä:b"><span>s</span>t</div><section><p>only</p></section>'
)


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("h1 + p", ["p1"]), ("h1 ~ p", 3), ("main > p:not(.x)", 2), ("main>p:not(.x,#p1)", 1), ("li:nth-child(2n+1)", 2), ("li:nth-child(odd)", 2), ("li:nth-child(-n+2)", 2), ("li:nth-last-child(1)", 1), ("li:nth-child(2)", 1),
        ("p:nth-of-type(2)", 1), ("p:first-of-type", 2), ("p:last-of-type", 2), ("p:only-child", 1), ("li:empty", 1), ("ul:has(> .on)", 1), ("ul:has(a[href='/a,b'])", 1), ("h1:has(+ p)", 1), ("h1:has(~ ul)", 1), ("p:has(+ p)", 1),
        ("li:is(.on, [data-k])", 2), (":is(h1,b)", 2), ("[data-k='v]w']", 1), ("[data-k=\"v\\]w\"]", 1), ("#\\31 st", 1), (".ä\\:b > span", 1), ("b[lang|=en]", 1), ("b[lang=EN-us i]", 1), ("b[lang=EN-us]", 0), ("li[class!=on]", 3),
        ("li:nth-child(1 of .on)", 1), ("li:nth-last-of-type(2)", 1), ("p:contains('two')", 1), ("*:root", 3), ("p:not(:has(b)):not(#p1)", 2), ("[href^='']", 0), ("main p ~ ul li + li > a, h1", 2), ("H1.a.b", 1), ("p:nth-child(3n)", 1), ("div::root", None),
        ("a:hover", None), ("p >", None), ("> p", None), ("p,,b", None), ("", None), ("p:not(", None), ("[a", None), ("p:nth-child(x)", None), ("p:has()", None), ("p)", None), ("p . x", None),
    ],
)
def test_forms(css, want):
    if want is None:
        with pytest.raises(ValueError, match="selector"):
            select(PAGE, css)
    elif isinstance(want, list):
        assert [n.attrs.get("id") for n in select(PAGE, css)] == want
    else:
        assert len(select(PAGE, css)) == want


def _tree(spec, parent):
    tag, cls, children = spec
    n = Node(tag, {"class": cls} if cls else {}, parent)
    n.children = [_tree(c, n) for c in children]
    return n


TREES = st.recursive(st.tuples(st.sampled_from("abc"), st.sampled_from(["", "x", "y", "x y"]), st.just([])), lambda c: st.tuples(st.sampled_from("abc"), st.sampled_from(["", "x", "y"]), st.lists(c, max_size=4)), max_leaves=14)
SIMPLE = st.one_of(
    st.tuples(st.just("tag"), st.sampled_from("abc")), st.tuples(st.just("class"), st.sampled_from("xy")), st.tuples(st.just("nth"), st.tuples(st.integers(-2, 3), st.integers(-2, 4), st.booleans(), st.booleans())), st.tuples(st.just("any"), st.none())
)
CHAINS = st.recursive(
    st.lists(st.tuples(st.sampled_from(" >+~"), st.lists(SIMPLE, min_size=1, max_size=2)), min_size=1, max_size=3),
    lambda inner: st.lists(st.tuples(st.sampled_from(" >+~"), st.lists(SIMPLE | st.tuples(st.sampled_from(["not", "is"]), st.lists(inner, min_size=1, max_size=2)) | st.tuples(st.just("has"), inner), min_size=1, max_size=2)), min_size=1, max_size=2), max_leaves=4,
)


def written(chain, relative=False):
    out = ""
    for k, (joint, tests) in enumerate(chain):
        tags = [v for kind, v in tests if kind == "tag"][:1]
        rest = ""
        for kind, v in tests:
            if kind == "class":
                rest += f".{v}"
            elif kind == "nth":
                rest += f":nth-{'last-' if v[2] else ''}{'of-type' if v[3] else 'child'}({v[0]}n{v[1]:+d})"
            elif kind in ("not", "is"):
                rest += f":{kind}({', '.join(map(written, v))})"
            elif kind == "has":
                rest += f":has({written(v, True)})"
        out += (f" {joint} " if k or relative and joint != " " else "") + (tags[0] if tags else "*") + rest
    return out


def elements(root):
    return list(root.walk())


def naive(root, chain, start=None):
    """All elements that a chain selects, from left to right."""
    every = elements(root)
    held = None
    for joint, tests in chain:
        def near(n):
            sib = [c for c in n.parent.children if not isinstance(c, str)]
            at = next(i for i, c in enumerate(sib) if c is n)
            above = []
            p = n.parent
            while p is not None:
                above.append(p)
                p = p.parent
            return {" ": above, ">": above[:1], "+": sib[max(at - 1, 0) : at], "~": sib[:at]}[joint]

        ok = [n for n in every if passes(root, n, tests)]
        before = [start] if held is None and start is not None else held
        held = ok if before is None else [n for n in ok if any(x is y for x in near(n) for y in before)]
    return held


def passes(root, n, tests):
    seen_tag = False
    for kind, v in tests:
        if kind == "tag":
            if not seen_tag and n.tag != v:
                return False
            seen_tag = True
        elif kind == "class" and v not in n.attrs.get("class", "").split():
            return False
        elif kind == "nth":
            sib = [c for c in n.parent.children if not v[3] or c.tag == n.tag]
            place = 1 + next(i for i, c in enumerate(sib[::-1] if v[2] else sib) if c is n)
            if not any(v[0] * k + v[1] == place for k in range(40)):
                return False
        elif kind in ("not", "is") and any(any(n is x for x in naive(root, c)) for c in v) == (kind == "not"):
            return False
        elif kind == "has" and not naive(root, v, n):
            return False
    return True


@settings(max_examples=300, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=3), CHAINS)
def test_against_sets(specs, chain):
    root = Node("#document", {}, None)
    root.children = [_tree(s, root) for s in specs]
    got, want = select(root, written(chain)), naive(root, chain)
    assert [id(n) for n in got] == [id(n) for n in elements(root) if any(n is w for w in want)]


def test_a_selector_is_read_once():
    assert compile_selector("a > b") is compile_selector("a > b")
