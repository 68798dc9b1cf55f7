"""Plain versions of what SQL cannot say: passages repeated back to back, quotes in comments, and the counters of a check run."""

import difflib
import re

LATIN, HAN, HAN_KEPT = re.compile("[A-Za-z]"), re.compile("[一-鿿]"), re.compile("[一-龥]")
DROPPED = re.compile(r"[　-〿＀-￯!\"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~\s]")
SHAPES = ((10_000, 10_000, 0), (300_000, 10_000, 1_000), (500_000, 5_000, 200), (800_000, 3_000, 100))


def is_code(text):
    return "code::" in text or re.search("(?s)```.*?```", text) is not None


def squares(text, long_unit):
    """(start, unit) by back-referencing expressions: three of a short unit, then two of a long one."""
    for shortest, longest, more in ((1, max(min(len(text) // 3, long_unit), 1), r"\1\1"), (long_unit, max(len(text) // 2, long_unit), r"\1")):
        for m in re.finditer(rf"(?s)(.{{{shortest},{longest}}}?){more}", text):
            yield m.start(), m[1]


def repeats(text, long_unit):
    """(start, unit, end, copies) of what is not wholly inside one before; a last copy may lack its white space at the end."""
    seen = set()
    for start, unit in squares(text, long_unit):
        end = start
        while text[end : end + len(unit)] == unit:
            end += len(unit)
        copies = (end - start) // len(unit)
        bare = unit.rstrip()
        tail = end + len(bare)
        if bare != unit and text[end:tail] == bare and (tail == len(text) or text[tail : tail + len(unit) - len(bare)].isspace()):
            end, copies = tail, copies + 1
        if not set(range(start, end)) <= seen:
            seen |= set(range(start, end))
            yield start, unit, end, copies


def tied(items, size, times, least):
    """Segments that are parted by the last ``times`` places of a key and repeat up to one more of their length."""
    seen = {}
    for at in range(len(items) - size + 1):
        key = items[at : at + size] if isinstance(items, str) else tuple(items[at : at + size])
        places = seen[key] = [*seen.get(key, []), at][-times:]
        if len(places) < times or places[-1] - places[-2] < least:
            continue
        step = places[-1] - places[-2]
        parts = [items[a:b] for a, b in zip(places, [*places[1:], places[-1] + step], strict=True)]
        if len(parts[-1]) == step and all(p == parts[0] for p in parts):
            yield parts[0]


def begins_paragraph(text, at):
    return 0 <= at <= len(text) and re.search(r"(\A|\n\s*)\Z", text[:at]) is not None


def after_space(text, at):
    return at + len(text[at:]) - len(text[at:].lstrip())


def english(text):
    if is_code(text) or any(x in text for x in (" song ", "♫", "♪", "-" * 15)):
        return
    words = text.split()
    runs = any("".join(words[i : i + 5]) == w * 5 and LATIN.search(w) for i, w in enumerate(words))
    if not runs and not any(LATIN.search("".join(s)) for s in tied(words, 2, 2, 2)):
        return
    for start, unit, end, copies in repeats(text, 4):
        if copies < 5:
            continue
        if unit in ("\\\\u0000", "\\\\U0000"):
            yield start + len(unit), end, start, start + len(unit), copies, len(unit), 0, True
            continue
        if re.search("%[ds]", unit) or unit in ("Ha", "HA", "ha") or not LATIN.search(unit) or "|" in unit or "</" in unit or {"{", "}"} <= set(unit):
            continue
        parts = unit.split(" ") if re.search(r"\s", unit) else []
        counted = [p for p in parts if p and (len(parts) >= 5 or p in ("©", "*", "\n-", "...", ".") or re.search(r"[a-zA-Z\d]", p.replace("\\cdots", "").replace("\\underline", "")))]
        if not counted:
            continue
        first, rest = after_space(text, start), after_space(text, end)
        keep_last = begins_paragraph(text, first) and rest != len(text) and not begins_paragraph(text, rest)
        mask = (start, end - len(unit)) if keep_last else (start + len(unit), end)
        yield *mask, start, start + len(unit), copies, len(LATIN.findall(unit)), len(counted), False


def chinese(text):
    if is_code(text):
        return
    at = [i for i, c in enumerate(text) if not DROPPED.match(c)] + [len(text)]
    bare = "".join(text[i] for i in at[:-1])
    passes = re.search("([一-鿿])\\1{4}", bare) is not None
    for size, times in ((2, 3), (10, 3), (250, 2)):
        passes = passes or any(HAN.search(s) for s in tied(bare, size, times, size))
    if not passes:
        return
    for start, unit, end, copies in repeats(bare, 250):
        if copies < 5:
            continue
        n = len(unit)
        place = at[start], at[start + n]
        mask = at[start + n - 1] + 1, at[end - 1] + 1
        raw, n_han = text[place[0] : place[1]], len(HAN_KEPT.findall(unit))
        if unit in ("\\\\u0000", "\\\\U0000"):
            yield *mask, *place, copies, n, 0, True
            continue
        if not n_han or "|" in raw or raw.count("\n") == 1 and raw.startswith(("\n*", "*\n")):
            continue
        if begins_paragraph(text, place[0]) and at[end] != len(text) and not begins_paragraph(text, at[end]):
            mask = place[0], at[end - n]
        yield *mask, *place, copies, n_han, 0, False


def passages(text, lang):
    """Findings of all chunks, by the text's offsets."""
    size, overlap = next(((s, o) for below, s, o in SHAPES if len(text) < below), (1000, 10))
    for at in range(0, len(text), size - overlap):
        for f in (english if lang == "en" else chinese)(text[at : at + size]):
            yield tuple(x + at for x in f[:4]) + f[4:]


def language(text, told=None):
    told, start = (told or "").lower(), text[:2000]
    if told.startswith("en"):
        return "en"
    if told.startswith(("zh", "cn", "ch")):
        return "cn"
    return "cn" if len(HAN.findall(start)) / max(len(start), 1) > 0.1 else "en"


def cut(text, masks):
    gone = {i for a, b in masks for i in range(a, b)}
    return "".join(c for i, c in enumerate(text) if i not in gone)


BOILER = re.compile(r"(?i)\b(?:this (?:comment|post) (?:was|has been) edited|last edited by|edited by\b.*\bon\b|originally posted by)\b")


def quotes(block):
    """A comment block: for every comment, the earlier comment each of its paragraphs quotes; then the tags, a run of quotes each."""
    said, known, number, out = re.compile(r".{1,60}?\b(?:said|wrote):\s*"), [], 0, []
    for comment in block.split("\n\n"):
        if not comment.strip():
            out.append(comment)
            continue
        number += 1
        paragraphs, found = comment.split("\n"), []
        for p in paragraphs:
            plain = re.sub(r"\s+", " ", p).strip().lower()
            quotable = len(plain) >= 40 and len(plain.split(" ")) >= 8 and not re.fullmatch(r"(?i)(https?://|www\.)\S+", p.strip()) and not BOILER.search(p)
            ratios = [(difflib.SequenceMatcher(None, plain, other).ratio(), -i, n) for i, (n, other) in enumerate(known)] if quotable else []
            best = max(ratios, default=(0, 0, None))
            found.append(best[2] if best[0] >= 0.85 else None)
        lines, i = [], 0
        while i < len(paragraphs):
            j = i
            while j < len(paragraphs) and found[j] is not None:
                j += 1
            if j > i:
                lead = [lines.pop()] if lines and "</ref>" not in lines[-1] and said.fullmatch(lines[-1].strip()) else []
                lines.append(f"<ref id={found[i]}>" + "\n".join(lead + paragraphs[i:j]) + "</ref>")
                i = j
            else:
                lines.append(paragraphs[i])
                i += 1
        out.append("\n".join(lines))
        for p in paragraphs:
            plain = re.sub(r"\s+", " ", p).strip().lower()
            if len(plain) >= 40 and not BOILER.search(p):
                known.append((number, plain))
    return "\n\n".join(out)
