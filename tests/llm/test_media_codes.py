"""Short texts share the codes of distances and of code lengths; files with codes of their own are read all the same."""

import numpy as np
import pytest

from webloom.llm import media, webp

PROSE = b"the cat sat on the mat and the dog sat on the cat, " * 9 + bytes(range(200, 256))


def test_a_short_text_costs_one_code_of_its_own(monkeypatch):
    made = []
    real = webp.code_lengths
    monkeypatch.setattr(webp, "code_lengths", lambda counts, limit: (made.append(limit), real(counts, limit))[1])
    m = media.store(media.payload_of(PROSE))
    assert made == [15]
    assert media.pixels(m)[:, :, 2].tobytes() == media.payload_of(PROSE)


@pytest.mark.parametrize("few", [0, 200, 10**9])
@pytest.mark.parametrize("text", [PROSE, b"", b"x" * 5000, bytes(range(256)) * 3, PROSE + b"".join(b"%d " % (i * i % 9973) for i in range(4000))])
def test_any_distance_code_is_read(monkeypatch, few, text):
    monkeypatch.setattr(webp, "FEW", few)
    p = media.payload_of(text)
    rgb = media.pixels(media.store(p))
    assert all(rgb[:, :, c].tobytes() == p for c in range(3))


def test_one_channel_reads_as_the_general_reader(monkeypatch):
    m = media.store(media.payload_of(PROSE * 5))
    want = webp.decode(m)
    monkeypatch.setattr(webp, "_one_channel", webp._vector)
    assert (webp.decode(m) == want).all() and (want[:, :, 3] == 255).all()


def test_cut_streams_are_errors():
    m = media.store(media.payload_of(PROSE * 5))
    body = m[20:]
    for n in range(5, len(body) - 2, 3):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(webp._container(body[:n]))


def test_usual_distances_are_a_complete_code():
    used = webp.FAR_LENGTHS[webp.FAR_LENGTHS > 0]
    assert (2.0 ** -used).sum() == 1 and (2.0 ** -np.array(webp.OUTER_LENGTHS)).sum() == 1
    assert webp._prefixes_of(np.array([121]))[0][0] == np.flatnonzero(webp.FAR_LENGTHS)[0]
