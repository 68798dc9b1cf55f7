"""Plain-Python versions of the operators' contracts, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, window=13):
    least = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if doc is not None:
                least[k] = min(least.get(k, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op3(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = words(text)
        lines, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                cover.update((i, i + 1, i + 2))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed))
    return out


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5(pages, rules=RULES):
    out = []
    for page, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((page, host, path, best[3] if best else None, best[2] if best else "allow"))
    return out


def op6(docs, tokenizer):
    start, out = 0, []
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingle_set(text, width):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def op8(docs, width=3, percent=85):
    """By row: rows of one doc_id with other texts are documents of their own."""
    sets = [shingle_set(text, width) for _, text in docs]
    least, owners, shared = {}, defaultdict(list), Counter()
    for (doc, _), s in zip(docs, sets, strict=True):
        if doc is not None and s:
            least[s] = min(least.get(s, doc), doc)
    nodes = list(least)
    for i, s in enumerate(nodes):
        for x in s:
            owners[x].append(i)
    for group in owners.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                shared[a, b] += 1
    top = list(range(len(nodes)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(nodes[a]) + len(nodes[b]) - n):
            top[find(a)] = find(b)
    first = {}
    for i, s in enumerate(nodes):
        first[find(i)] = min(first.get(find(i), least[s]), least[s])
    at = {s: first[find(i)] for i, s in enumerate(nodes)}
    return [(doc, len(s), None if doc is None else at.get(s, doc), doc is None or at.get(s, doc) == doc) for (doc, _), s in zip(docs, sets, strict=True)]


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def op9(docs, chars=40, least=5):
    owners = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None:
                owners[line_key(line)].add(doc)
    common = {k: max(v) for k, v in owners.items() if len(k) >= chars and len(v) >= least}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or common.get(line_key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def tile(a, b, least):
    """Greedy string tiling by plain dynamic programming: (length, place in a, place in b) of each tile in turn."""
    a, b = a.copy(), b.copy()
    out = []
    while True:
        run, best = np.zeros(len(b) + 1, int), (0, 0, 0)
        for i in range(len(a) - 1, -1, -1):  # of each pair of places, how far they agree
            run = np.append(np.where(a[i] == b, run[1:] + 1, 0), 0)
            n = int(run.max())
            if n and (n, -i) >= best[:2]:
                best = (n, -i, -int(run.argmax()))
        n, i, j = best[0], -best[1], -best[2]
        if not n or n < min(least, len(b)):
            return out
        out.append((n, i, j))
        a[i : i + n], b[j : j + n] = -1, -2


def leaks(docs, items, least=4, threshold=0.5):
    """(doc, item, its tokens, tokens covered, first token) of every document and item whose tiles cover enough."""
    strip = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’‚…–—¡¿·•"
    number = defaultdict(lambda: len(number))
    tokens = lambda t: [number[x] for x in (w.lower().strip(strip) for w in words(t)) if x]
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    others = [(item, b, grams(b, min(least, len(b)))) for item, b in ((item, tokens(t)) for item, t in items) if b]
    out = []
    for doc, text in docs:
        a = tokens(text)
        mine = {n: grams(a, n) for n in range(1, least + 1)}
        for item, b, g in others:
            if mine[min(least, len(b))].isdisjoint(g):
                continue  # no tile can be
            found = tile(np.array(a), np.array(b), least)
            covered = sum(x[0] for x in found)
            if found and covered >= threshold * len(b):
                out.append((doc, item, len(b), covered, min(x[1] for x in found)))
    return out


def op7(docs, shards=8, nodes=128, bits=16):
    """Shard by doc_id of a walk around the ring, a document at a time: own places first, then what overflows."""
    digest = lambda s, v: xxhash.xxh64(f"shard-{s}/node-{v}").intdigest()
    points = sorted((digest(s, v) >> (64 - bits), s) for s in range(shards) for v in range(nodes))
    room = [len(docs) // shards + (s < len(docs) % shards) for s in range(shards)]
    out, late = [], []
    for at, doc in sorted(docs):
        k = next((i for i, (p, _) in enumerate(points) if p >= at), 0)
        if room[points[k][1]]:
            room[points[k][1]] -= 1
            out.append((doc, points[k][1]))
        else:
            late.append((doc, k))
    for doc, k in late:
        while not room[points[k][1]]:
            k = (k + 1) % len(points)
        room[points[k][1]] -= 1
        out.append((doc, points[k][1]))
    return out
