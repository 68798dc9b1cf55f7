"""What lets a chunk through to the search for repeats, against plain forms."""

import numpy as np
import pytest

from textloom.kernels import subdup


def test_repeat_filter_builds_no_class(monkeypatch):
    monkeypatch.setattr(subdup.cs, "python_class", lambda *a, **k: pytest.fail("a class was written for a text"))
    assert subdup.chinese("前文。" + "你好吗" * 7 + "后文")[0]["score"] == 7 and not subdup.chars_may_repeat("你好吗天地")


def test_repeat_filters_against_plain_forms():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        text = "".join(rng.choice(list("你好吗ab, ")) for _ in range(rng.integers(1, 5))) * int(rng.integers(1, 6)) + "".join(rng.choice(list("你好a ")) for _ in range(rng.integers(0, 7)))
        assert subdup.chars_may_repeat(text) == _chars(text) and subdup.words_may_repeat(text) == _words(text)


def _equal(items, places, least):
    step = places[-1] - places[-2]
    edges = [*places, places[-1] + step]
    return step >= least and edges[-1] <= len(items) and len({str(items[a:b]) for a, b in zip(edges, edges[1:])}) == 1


def _chars(text):
    if any(text[i : i + 5] == text[i] * 5 and "一" <= text[i] <= "鿿" for i in range(len(text))):
        return True
    for size, needed in ((2, 3), (10, 3), (250, 2)):
        for at in range(len(text) - size + 1):
            places = [i for i in range(at + 1) if text[i : i + size] == text[at : at + size]][-needed:]
            if len(places) == needed and _equal(text, places, size) and any("一" <= c <= "鿿" for c in text[places[0] : places[1]]):
                return True
    return False


def _words(text):
    words = text.split()
    for at, word in enumerate(words):
        if "".join(words[at : at + 5]) == word * 5 and any(c in "ab" for c in word):
            return True
        before = [i for i in range(at) if words[i : i + 2] == words[at : at + 2]]
        if at + 2 <= len(words) and before and _equal(words, [before[-1], at], 2) and any(c in "ab" for c in "".join(words[before[-1] : at])):
            return True
    return False
