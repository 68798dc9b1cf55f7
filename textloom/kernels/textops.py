"""Scalar text functions: punctuation, accents, spacing, normal forms, sentences."""

from __future__ import annotations

import re
import unicodedata

from .. import charsets as cs

# ---- Fixed values ----

#: What Unicode punctuation is written as.
PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?",
    "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}
SPLIT_PUNCTUATION = ",.?!;。！？；，[]():#=|-/"
CONTROLS: cs.Ranges = ((0x00, 0x1F), (0x7F, 0x9F))
SENTENCE_ENDS = ",.?!;。！？；，"
TITLES = ("Mr", "St", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", "Mt")
#: Spacing for tokenizers, in order; the first group before digits and stops are drawn together, the second after.
SPACING_FIRST = (("\r", ""), ("(", " ("), (")", ") "), (" +", " "))
SPACING_BRACKETS = (("( ", "("), (" )", ")"))
SPACING_STOPS = ((" :", ":"), (" ;", ";"), ("`", "'"), ("''", ' " '))
SPACING_QUOTES = (
    ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"), ("‘", '"'), ("‚", '"'), ("’", '"'), ("''", '"'), ("´´", '"'), ("…", "..."), (" « ", ' "'), ("« ", '"'),
    ("«", '"'), (" » ", '" '), (" »", '"'), ("»", '"'), (" %", "%"), (" :", ":"), (" ?", "?"), (" !", "!"), (" ;", ";"), (" +", " "), ("．", ". "),
)

_PUNCTUATION = re.compile(f"[{''.join(PUNCTUATION)}]")
_SPLIT = re.compile(f"[{re.escape(SPLIT_PUNCTUATION)}]")
_CONTROLS = re.compile(cs.python_class(CONTROLS))
_DIGIT = re.compile(r"\d")
_TRAILING = re.compile(r"[^\w\s]+$")
_TITLE = re.compile(rf"({'|'.join(TITLES)})\. ([A-Za-z])")
_DECIMAL = re.compile(r"(\d+)\.(\d+)")
_SENTENCE = re.compile(rf"(?<=[{re.escape(SENTENCE_ENDS)}])\s*")
_TABLE = str.maketrans(PUNCTUATION)


def replace_unicode_punct(text: str) -> str:
    return text.translate(_TABLE)


def remove_unicode_punct(text: str) -> str:
    return _PUNCTUATION.sub("", text)


def remove_split_punct(text: str) -> str:
    return _SPLIT.sub("", text)


def strip_accents(text: str) -> str:
    """Decomposed, without non-spacing marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def remove_non_printing_char(text: str) -> str:
    return _CONTROLS.sub("", text)


def _literally(text: str, table) -> str:
    for old, new in table:
        text = text.replace(old, new)
    return text


def normalize_spacing_for_tok(text: str, language: str = "en") -> str:
    """Spacing and quotes as tokenizers expect them. Brackets and per cent signs that lose a blank gain a backslash: so it is defined."""
    text = re.sub(r"\) ([.!:?;,])", r"\\)\1", _literally(text, SPACING_FIRST))
    text = re.sub(r"(\d) %", r"\1\\%", _literally(text, SPACING_BRACKETS))
    text = _literally(_literally(text, SPACING_STOPS), SPACING_QUOTES)
    romance = language not in ("en", "cs", "cz")
    if language == "en":
        text = re.sub(r'"([,.]+)', r"\1\\" + '"', text)
    elif romance:
        text = re.sub(r'(\.+)"(\s*[^<])', r"\\" + r'"\1\2', text.replace(',"', '",'))
    mark = "," if language in ("de", "es", "cz", "cs", "fr") else "."
    return re.sub(r"(\d) (\d)", rf"\1{mark}\2", text)


def normalize(text: str, accent: bool = True, case: bool = True, numbers: bool = True, punct: int = 1) -> str:
    """Stripped; then lower-cased, without accents, digits as 0, punctuation replaced (1) or removed (2), without controls."""
    steps = [
        (case, str.lower),
        (accent, strip_accents),
        (numbers, lambda t: _DIGIT.sub("0", t)),
        (punct == 1, replace_unicode_punct),
        (punct == 2, remove_unicode_punct),
        (True, remove_non_printing_char),
    ]
    text = text.strip()
    for wanted, step in steps:
        text = step(text) if wanted else text
    return text


def slow_normalize_for_dedup(text: str) -> str:
    return normalize(text, accent=False, punct=2)


def normalize_for_dedup(text: str) -> str:
    """Stripped, lower-cased, digits as 0, without punctuation and controls, white space as one blank."""
    text = _DIGIT.sub("0", text.strip().lower())
    return re.sub(r"\s+", " ", _CONTROLS.sub("", _PUNCTUATION.sub("", text)))


def remove_punctuation(text: str) -> str:
    """Without the punctuation at its end, stripped."""
    return _TRAILING.sub("", text).strip()


def split_mix_paragraph(text: str, keep_delimiter: bool = True) -> list[str]:
    """Sentences and clauses of a text in any of the languages; titles and decimals don't end one."""
    text = _TITLE.sub("\\1\x01\\2", text.replace("\x01", ""))
    text = _DECIMAL.sub("\\1\x02\\2", text)
    parts = (re.sub(r"\s+", " ", p.replace("\x01", ". ")).replace("\x02", ".") for p in _SENTENCE.split(text))
    out: list[str] = []
    for p in filter(None, parts):
        if out and len(p) == 1:  # a lone mark belongs to what it ends
            out[-1] += p
        else:
            out.append(p)
    return [p for p in (out if keep_delimiter else map(remove_punctuation, out)) if p]


def remove_unprintable(text: str) -> str:
    return "".join(filter(str.isprintable, text))
