"""Quotes are matched only where they can be alike."""

import pytest

from textloom.kernels import article


def test_quotes_need_no_match_where_characters_differ(monkeypatch):
    quotes = article.Quotes()
    for i in range(3):
        quotes.add(i + 1, "abcdefgh " * 9 + str(i), "x")
    monkeypatch.setattr(article.difflib, "SequenceMatcher", lambda *a: pytest.fail("compared"))
    assert quotes.source("zyxwvuts " * 9) is None and quotes.source("abcdefgh " * 9 + "1") == 2
