"""Texts made of whatever the rules look for, in random order."""

import random

ATOMS = [
    "a", "b", "Z", "1", "9", " ", "  ", "\t", "\n", "\n\n\n", "\r", "\u00a0", "\u3000", "\u2003", "\u202f", "\u2009", "\u2028", "\u2029", "\u200b", "\u200d", "\u200e", "\ufeff", "\u202a", "\ufe0f", "\ufe0e",
    "\U000e0101", "\u20e3", "#", "*", "❤", "✔", "▪", "★", "─", "\U0001f600", "\U0001d664", "\U0001d455", "\u0336", "\u0301", "\u0301\u0302", "\u1ab0", "\u0348", "\uf8ff", "\uf04a",
    "\uf0b7", "\uf07e", "\ue010", "\ue011", "\ue10b", "\ue11a", "\ue618", "\ue1bd", "束", "你", "，", "&amp;", "&#12;", "<br>", "<|im_end|>", "\\n", "\\r{", "====", "|||||", "+++", "=" * 9,
    " a1111b a1111b a1111b a1111b a1111b ", " c2222,c2222,c2222,c2222,c2222,c2222 ", "```", "x", "\x1c", "\x85", "ab" * 40, "DEAD" * 20, "Ã©", "â\u0080\u0099", "锛", "鐨", "ä¸",
    "�", "\uffff", "\u0378", "\x81", "％", "１", "—", "…", "。", "12.5 ", "Mr. X", "Mr. Mr. Y", ". ", "!", "(", ")", "\\cdots", "code::", "ha ha ha ha ha ha ", "1 2 3 4 5 6 7 8 9 10 11 ", "第一、\n", "12.\n",
]
#: Private use, each in surroundings where it is repaired and where it is not.
ATOMS += [chr(p) for p in (0xF8FF, 0xF04A, 0xF0B7, 0xF07E, 0xE010, 0xE011, 0xE10B, 0xE11A, 0xE618, 0xE1BD)]
ATOMS += ["\n" + chr(0xF0B7), "\n " + chr(0xF0B7) + " x", "3" + chr(0xF07E) + " 5", "A" + chr(0xE010) + "b", "a" + chr(0xE011) + "b", "a" + chr(0xE10B) + "b", "\n" + chr(0xE618) + "x", chr(0xE1BD) + "束", "\u2028" + chr(0xE618)]


def made(n: int, seed: int = 3, longest: int = 40) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randrange(longest))) for _ in range(n)]
