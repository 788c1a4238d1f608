"""What a stored text costs besides its bytes, and that no repeat is lost to it."""

import sys

import numpy as np
import pytest

from webloom.llm import media, webp

PROSE = b"the cat sat on the mat and the dog sat on the cat, " * 9 + bytes(range(200, 256))


def calls_of(f) -> int:
    """Calls of functions, numpy's too."""
    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_a_short_text_takes_few_calls():
    p = media.payload_of(PROSE)
    media.feature_of(media.pixels(media.store(p)))  # what is made once
    m = media.store(p)
    assert calls_of(lambda: media.store(p)) < 300
    assert calls_of(lambda: media.feature_of(media.pixels(m))) < 350


def test_tables_of_the_usual_distances_are_made_once():
    m = media.store(media.payload_of(PROSE))
    media.pixels(m)
    usual = webp.usual_distances()[2]
    kept = usual.far_steps
    media.pixels(m)
    assert usual.far_steps is kept


@pytest.mark.parametrize("n", [9_000, 65_540, 65_541, 65_542, 150_000])
def test_every_repeat_is_part_of_a_reference(n):
    """A hash that other bytes share costs no match: what stood before is covered, and each reference is true."""
    v = np.random.default_rng(6).integers(97, 105, n).astype(np.uint8)
    text, seen, again = v.tobytes(), {}, []
    for i in range(n - webp.MATCH + 1):
        if text[i : i + webp.MATCH] in seen:
            again.append(i)
        seen[text[i : i + webp.MATCH]] = i
    covered = np.zeros(n, bool)
    end = 0
    for s, k, d in webp._references(v):
        assert s >= end and s - d >= 0 and all(text[j] == text[j - d] for j in range(s, s + k))
        covered[s : s + k] = True
        end = s + k
    assert len(again) > 100 and covered[again].all()


@pytest.mark.parametrize("symbols", [[7], [7, 9], [5, 260], [300 - 21], list(range(0, 280, 3)), [*range(30, 60), 270], list(range(280))])
def test_coded_lengths_are_read_back(symbols):
    """Whole pieces of a stream of code lengths, runs and single ones."""
    counts = np.zeros(280, np.int64)
    counts[symbols] = np.arange(1, len(symbols) + 1) ** 2
    lengths = webp.code_lengths(counts, 15)
    for behind in (0, (1 << 60) - 1):
        value, n = webp.prefix_bits(lengths)
        bits = webp.Bits((value << 3 | behind << (n + 3)).to_bytes((n + 3 + 60 + 7) // 8, "little"))
        bits.at = 3
        code = webp.read_prefix(bits, 280)
        assert bits.at == n + 3 and list(code.used) == symbols
        if len(symbols) > 1:
            assert (code.lengths == lengths).all()
