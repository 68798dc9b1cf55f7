"""Character classes: fixed values of the rules, and classes derived from the Unicode database.

Classes are tuples of inclusive code point ranges. ``python_class`` and ``java_class`` write
them as regular-expression classes, so that kernels and native expressions share one source.
Classes by category come from this interpreter's Unicode tables, not from the JVM's, which
may be of another version.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

Ranges = tuple[tuple[int, int], ...]


def ranges(points: Iterable[int]) -> Ranges:
    """Code points as sorted inclusive ranges."""
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return tuple((a, b) for a, b in out)


def chars(text: str) -> Ranges:
    return ranges(map(ord, text))


def points(*classes: Ranges) -> set[int]:
    return {p for c in classes for a, b in c for p in range(a, b + 1)}


def union(*classes: Ranges) -> Ranges:
    return ranges(points(*classes))


def minus(one: Ranges, *others: Ranges) -> Ranges:
    return ranges(points(one) - points(*others))


def _written(cls: Ranges, one: str) -> str:
    return "".join(one % a if a == b else f"{one % a}-{one % b}" for a, b in cls)


def python_class(*classes: Ranges, negated: bool = False) -> str:
    """A class for Python's re."""
    return f"[{'^' * negated}{_written(union(*classes), chr(92) + 'U%08x')}]"


def java_class(*classes: Ranges, negated: bool = False) -> str:
    """A class for the JVM's regular expressions."""
    return f"[{'^' * negated}{_written(union(*classes), chr(92) + 'x{%X}')}]"


def java_rare(*classes: Ranges) -> str:
    """The same for a class of many ranges. The JVM asks every range of a class, so ASCII and the widest gaps are told first, and the ranges by a tree.

    Characters beyond the basic plane stand as they are: a look-behind reads them whole only then.
    """
    one = lambda p: chr(p) if p > 0xFFFF else rf"\x{{{p:X}}}"
    written = lambda cls: "".join(one(a) + ("" if a == b else "-" + one(b)) for a, b in cls)

    def tree(cls: Ranges) -> str:
        if len(cls) <= _LEAF:
            return f"[{written(cls)}]"
        size = -(-len(cls) // _LEAF)
        parts = [cls[i : i + size] for i in range(0, len(cls), size)]
        return "(?:" + "|".join(f"(?=[{written(((p[0][0], p[-1][1]),))}]){tree(p)}" for p in parts) + ")"

    ascii_part, rest = (ranges(p for p in points(*classes) if (p < 128) is low) for low in (True, False))
    gaps = [(a + 1, b - 1) for (_, a), (b, _) in zip(((0, 0x7F), *rest), rest) if b <= 0x10000 and b - a > _WIDE]
    widest = sorted(sorted(gaps, key=lambda g: g[0] - g[1])[:_LEAF]) if len(rest) > _LEAF else []
    found = rf"(?![\x00-\x7F{written(widest)}]){tree(rest)}"
    return f"(?:{java_class(ascii_part)}|{found})" if ascii_part else f"(?:{found})"


#: Ranges of a class, or parts of a tree, that are tried one after the other; the least width of a gap that is told first.
_LEAF, _WIDE = 8, 64


def category(*names: str) -> Ranges:
    """All code points of these general categories (two letters, or one for all that start with it)."""
    found = []
    start = None
    for p in range(0x110000):
        c = unicodedata.category(chr(p))
        if c in names or c[0] in names:
            start = p if start is None else start
        elif start is not None:
            found.append((start, p - 1))
            start = None
    if start is not None:
        found.append((start, 0x10FFFF))
    return tuple(found)


class _Lazy:
    """Classes by category, scanned when first asked for."""

    def __init__(self, **names: Sequence[str]):
        self._names = names

    def __getattr__(self, name: str) -> Ranges:
        if name.startswith("_"):
            raise AttributeError(name)
        value = category(*self._names[name])
        setattr(self, name, value)
        return value


UCD = _Lazy(unassigned=("Cs", "Cn"), symbols=("Sm", "So"), marks=("M",), format=("Cf", "Zl", "Zp"), digits=("Nd",), nonspacing=("Mn",), word=("L", "N"), unprintable=("C", "Zs", "Zl", "Zp"))

#: What str.isspace() and Python's \s take as white space.
PY_SPACE = ranges([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

# ---- Fixed values: the character classes that the rules are defined on ----

VARIATION_SELECTORS: Ranges = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
STYLED_MATH: Ranges = ((0x1D400, 0x1D7FF),)
EXOTIC_COMBINING: Ranges = ((0x0348, 0x0348), (0x0352, 0x0352), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0xFE20, 0xFE2F))
EMOJI_SYMBOLS: Ranges = ((0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FFFF))
EMOJI_ATTACHMENTS: Ranges = ((0x200D, 0x200D), (0x20D0, 0x20FF))
#: Characters that a variation selector turns into emoji.
EMOJI_BASES: Ranges = (
    (0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x2049), (0x2122, 0x2139), (0x2194, 0x21AA), (0x231A, 0x231B), (0x23CF, 0x23FA),
    (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B55), (0x3030, 0x3030),
    (0x303D, 0x303D), (0x3297, 0x3299),
)
KEYCAP_BASES = chars("#*0123456789")
KEYCAPS = chars("\u20e3\u20e4")
TEXT_OR_EMOJI_SELECTORS = chars("\ufe0e\ufe0f")
CONTROL_INVISIBLE = chars("\ufeff\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u034f\u00ad")
BIDI_CONTROL = chars("\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200e\u200f")
LINE_SEPARATORS = {"\u2028": "\n", "\u2029": "\n\n"}
PUA: Ranges = ((0xE000, 0xF8FF),)
PUA_NOISE = chars("\uf8ff\uf04a")
DECORATIVE_SYMBOLS: Ranges = ((0x2500, 0x27BF),)
#: Check boxes and list markers inside the decorative range that carry meaning.
FORM_SYMBOLS = chars("■□○●◯☐☑☒✓✔✗✘")
DECORATIVE_COMBINING: Ranges = ((0x0336, 0x0336), (0x033F, 0x033F), (0x035C, 0x0361))
SPACES_TO_BLANK = chars("\u00a0\u2003\u3000")
SPACES_TO_DROP = chars("\u202f\u2009")
#: White space that indents a line.
INDENT = " \t\u00a0\u3000"
LINE_ENDS = "\n\r\u2028\u2029"
FLOOD_EXTRA = chars("=+~×═")

REPLACEMENT = chars("�")
C1_CONTROLS: Ranges = ((0x80, 0x9F),)
INVISIBLE_GARBAGE = chars("\ufeff\u2060\u2061\u034f\u00ad")
CONDITIONAL_ZERO_WIDTH: Ranges = ((0x200B, 0x200F),)
SPECIALS: Ranges = ((0xFFF0, 0xFFFC),)
INTERLINEAR: Ranges = ((0xFFF9, 0xFFFB),)
HAN: Ranges = ((0x4E00, 0x9FFF),)
#: Scripts that are written without spaces: one token a character.
CJK_TOKENS: Ranges = ((0x3400, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))
CJK_PUNCTUATION = "。，、；：！？“”‘’（）《》〈〉【】「」『』〔〕…—·～﹏\u3000"
#: Scripts in which zero-width characters are legitimate, and scripts with complex shaping.
ZERO_WIDTH_SCRIPTS: Ranges = (
    (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF),
    (0x0D00, 0x0D7F), (0x0D80, 0x0DFF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1200, 0x137F), (0x1780, 0x17FF), (0xFB1D, 0xFB4F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF),
)
COMPLEX_SCRIPTS: Ranges = (*ZERO_WIDTH_SCRIPTS, (0x0700, 0x074F), (0x0780, 0x07BF), (0x0F00, 0x0FFF))

# ---- Fixed values: patterns that mean the same in Python and on the JVM ----

HTML_ENTITY = r"&[a-zA-Z]{2,10};|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
FORBIDDEN_STRINGS = (
    "<br>", "<br/>", "<br />", "</br>", "&lt;br&gt;", "&lt;/br&gt;", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>",
    "<arg_key>", "</arg_key>", "<arg_value>", "</arg_value>", "<is_displaying_contents>", "</is_displaying_contents>", "\x03", "\x04",
)
#: Escapes that stayed as text, unless a LaTeX command follows.
LITERAL_ESCAPE = r"\\{1,2}[ntr](?![A-Za-z{])"
#: Damage of one decoding with the wrong table; found in this order.
GARBLED = (
    "æ–‡", "é”™", "ã€", "å›½", "å°", "ï¼", "¼Œ", "ä¸", "½ä", "ï¼", "ëº", "ç„", "ã¾", "äº", "¼ä", "Œå", "ä½", "Œä", "å¥", "Œè", "åœ", "èŒ", "ä¼", "å¾", "Â§Ã", "Ã¯Â¼Å’", "Ã¯Â¼â€š",
    "Ã¢â‚¬Â¦", "Ã©Â ´", "Ã¢â‚¬Å“", "ÃƒÂ¦Ã¢â‚¬Å“Ã¢â‚¬Å“", "鎴戜滑", "鏈夊緢", "浠€涔堝苟", "杩欎釜", "浼犲叕", "瀛︿範", "槡槡槡", "犃犅",
)
#: Damage only where two different ones of these stand in a line.
GARBLED_PAIR = "涓锛鐨鎴鏄鍦鏈"
DOUBLE_ENCODED = ("[À-ß][\u0080-¿]", "[à-ï][\u0080-¿]{2}", "[ð-÷][\u0080-¿]{3}")
CP1252 = "Ã[\u0080-\u009f]|Â[\u0080-\u00a0]|â\u0080[\u0090-¿]|Ã[£-¿]|ð\u009f[\u0080-¿]{2}"
#: A token that may be noise; what may stand between its repeats; a character run inside it.
NOISE_TOKEN = r"(?<![A-Za-z0-9])[A-Za-z0-9]{5,128}(?![A-Za-z0-9])"
NOISE_SEPARATORS = ",;，、|"
NOISE_REPEATS = 5
HEX_RUN = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{64,}(?![A-Za-z0-9])"
HEX_WRAPPED = r"(?<![A-Za-z0-9])[0-9A-Fa-f][0-9A-Fa-f \t\r\n]{63,}[0-9A-Fa-f](?![A-Za-z0-9])"
FLOOD_CLEAN, FLOOD_DETECT = 4, 8
