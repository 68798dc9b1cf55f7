"""Noise put into texts in a fixed way, as the driver's tables hold little that the rules look for.

A noise is a list of literal replacements, written once and used for Spark and for SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Noise = tuple[tuple[str, str], ...]

NOISES: dict[str, Noise] = {
    "control_invisible": (("e ", "e\u200b "), (" a", " \ufeffa"), ("n", "n\u00ad")),
    "bidi_control": ((" d", " \u202ad"), ("s ", "s\u202c ")),
    "variation_selector": (("i", "i\ufe0f"), ("o ", "o\U000e0101 ")),
    "styled_math_alnum": ((" a", " \U0001d41a"), ("e ", "\U0001d452 "), ("1", "\U0001d7cf"), ("q", "\U0001d455")),
    "abnormal_space": ((" d", "\u00a0d"), (" p", "\u3000p"), (" c", " \u2009c")),
    "pua_known_noise": ((" s", " \uf8ffs"), ("t ", "t\uf04a ")),
    "pua_contextual": (("th", "t\ue011h"), ("er", "e\ue10br"), ("\n", "\n\uf0b7")),
    "decorative_symbol": ((" m", " \u2605m"), ("r ", "r\u2500 "), (" l", " \u25a1l")),
    "decorative_combining": (("a", "a\u0336"), ("u", "u\u0361")),
    "emoji_all": ((" w", " \U0001f600w"), (" f", " \u2764\ufe0ff"), (" b", " 5\ufe0f\u20e3b"), ("y ", "y\u200d ")),
    "exotic_combining": (("o", "o\u1ab0"), ("l", "l\u0348")),
    "combining_decoration": (("e", "e\u0301\u0302"), ("c", "c\u0301")),
    "line_separator": ((". ", ".\u2028"), (", ", ",\u2029")),
    "forbidden_strings": ((" the ", " <br>the<br/> "), (" de ", " <|im_start|>de<|im_end|> ")),
    "html_entity": ((" a ", " &amp; "), (" un", " &#233;un")),
    "math_symbol_flood": ((" de ", " ===== "), (" the ", " ||||| "), (" und ", " +++ ")),
    "line_boundary_space": (("\n", " \t\n"), (".", ". ")),
    "blank_line_collapse": (("\n", "\n\n\n\n"),),
    "fffd": (("z", "z\ufffd"),),
    "double_enc": (("v", "\u00c3\u00a9v"),),
    "c1_control": (("x", "x\u0085"),),
    "pua": (("j", "j\ue123"),),
    "specials": (("k", "k\ufff9"),),
    "seq": (("w", "w\u00e4\u00b8"), ("b", "\u951b\u9428b")),
    "cscn": (("v", "v\u0378"), ("\n", "\n\U000e0fff")),
    # ten, eight and seven of a kind: the last is no flood
    "flood": ((" de ", " ========== "), (" the ", " |||||||| "), (" und ", " +++++++ ")),
    "control_format_flood": (("g", "g\u2062"),),
    "code": ((" code", " code::"), (". ", ". ```")),
    "han": ((" p", " 一个"),),
    "enum": ((". ", ".\n1.\n2.\n3.\n4.\n5.\n6.\n7.\n8.\n9.\n10.\n11.\n12.\n13.\n14.\n15.\n16.\n17.\n18.\n19.\n20.\n21.\n22.\n23.\n24.\n25.\n26.\n27.\n28.\n29.\n30.\n"),),
    "punctuation": ((". ", "。１ "), (", ", "，"), (" d", " \u2014d")),
}


def noisy(text: Column, *names: str) -> Column:
    for name in names:
        for old, new in NOISES[name]:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def literal(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def noisy_sql(text: str, *names: str) -> str:
    for name in names:
        for old, new in NOISES[name]:
            text = f"replace({text}, {literal(old)}, {literal(new)})"
    return text
