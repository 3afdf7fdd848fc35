"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from lodestone.llm import divergence as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\x0b\x0c\r"


class Sets:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def words(text):
    return WORD.findall(text or "")


def base_figures(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def histograms(text, lang):
    import unicodedata

    counts = [0] * 7
    for c in text or "":
        kind = unicodedata.category(c)
        if kind == "Ll":
            counts[0] += 1
        elif c in " \t\n\x0b\x0c\r":
            counts[1] += 1
        elif kind == "Lu":
            counts[2] += 1
        elif kind == "Nd":
            counts[3] += 1
        elif c in ".,;:!?'\"()-":
            counts[4] += 1
        elif kind[0] in "SP":
            counts[5] += 1
        else:
            counts[6] += 1
    own = d.COMMON_WORDS.get(lang, ["\x00"] * 15)
    low = [x.lower() for x in words(text)]
    common = [low.count(x) for x in own]
    common.append(len(low) - sum(x in own for x in low))

    def shares(c):
        return [math.floor(x * d.UNIT / max(sum(c), 1)) for x in c]

    return shares(counts), shares(common)


def js(p, q):
    p = [x / max(sum(p), 1) for x in p]
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def quality(docs):
    """{position: (base figures, kept)} of rows (doc_id, text, lang)."""
    known = [(base_figures(t), histograms(t, lang), lang if lang in d.COMMON_WORDS else "und") for _, t, lang in docs]
    sums = {}
    for base, hists, lang in known:
        if base[0] >= d.MIN_WORDS_CLASSES:
            have = sums.setdefault(lang, ([0] * 7, [0] * 16))
            for s, h in zip(have, hists):
                s[:] = [a + b for a, b in zip(s, h)]
    refs = {k: tuple([x / max(sum(s), 1) for x in s] for s in v) for k, v in sums.items()}
    out = {}
    for k, (base, hists, lang) in enumerate(known):
        far = base[0] >= d.MIN_WORDS_CLASSES and js(hists[0], refs[lang][0]) > d.MAX_CLASS_DISTANCE
        far |= base[0] >= d.MIN_WORDS_COMMON and lang != "und" and js(hists[1], refs[lang][1]) > d.MAX_COMMON_DISTANCE
        out[k] = (*base, not base[5] and not far)
    return out


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def line_firsts(docs):
    """{(doc, position): place of the first line of its group} of rows (doc_id, text); ids are unique."""
    places = [(doc, k, x.strip(BLANK)) for doc, t in sorted(docs) for k, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    first = {}
    for doc, k, x in places:
        first.setdefault(x, (doc, k))
    lines, sets = list(first), Sets(range(len(first)))
    grams = [shingles(x) for x in lines]
    rare = Counter(g for s in grams for g in s)
    seen = defaultdict(list)
    for i in sorted(range(len(lines)), key=lambda i: len(grams[i])):
        ordered = sorted(grams[i], key=lambda g: (rare[g], g))
        prefix = ordered[: len(ordered) - math.ceil(0.8 * len(ordered) - 1e-9) + 1]
        for j in {j for g in prefix for j in seen[g]}:
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                sets.join(i, j)
        for g in prefix:
            seen[g].append(i)
    least = {}
    for i, x in enumerate(lines):
        r = sets.find(i)
        least[r] = min(least.get(r, first[x]), first[x])
    number = {x: i for i, x in enumerate(lines)}
    return {(doc, k): least[sets.find(number[x])] for doc, k, x in places}


def dedup_lines(docs):
    """{doc: text} after line dedup; documents that lose all their lines are missing."""
    firsts = line_firsts(docs)
    out = {}
    for doc, text in docs:
        kept = [x for k, x in enumerate((text or "").split("\n")) if firsts.get((doc, k), (doc, k)) == (doc, k)]
        lost = len(kept) < len((text or "").split("\n"))
        made = "\n".join(kept) if lost else text
        if not lost or made.strip(BLANK + "\n"):
            out[doc] = made
    return out


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def simhash(docs):
    """{doc: (fingerprint, component)} of rows (doc_id, text)."""
    prints = {doc: fingerprint(t) for doc, t in docs}
    ids, sets = sorted(prints), Sets(prints)
    values = np.array([prints[x] for x in ids], np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            sets.join(ids[i], ids[i + 1 + int(j)])
    return {x: (prints[x], sets.find(x)) for x in ids}


def mix(docs):
    """{doc: (size, source size, target, taken)} of rows (doc_id, text, source)."""
    size = {doc: len(words(t)) for doc, t, _ in docs}
    text = {doc: t or "" for doc, t, _ in docs}
    source = {doc: s for doc, _, s in docs}
    total = Counter()
    for doc, s in source.items():
        total[s] += size[doc]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 3 * total[s] * share < weight[s] * left}
        if not more:
            break
        capped |= more
    target = {s: float(3 * total[s]) if s in capped else weight[s] * float(left) / max(share, 1) for s in order}
    taken = {}
    for s in order:
        full = min(math.floor(target[s] / total[s]), 3) if total[s] else 0
        budget = target[s] - full * total[s]
        cells = defaultdict(list)
        for doc in source:
            if source[doc] == s:
                cells[int(hashlib.md5(f"{doc}:{text[doc]}".encode()).hexdigest()[:8], 16) & (2**30 - 1)].append(doc)
        have, open_ = 0, budget > 0
        for h in sorted(cells):
            own = sum(size[doc] for doc in cells[h])
            extra = open_ or (have + own <= budget)
            if have + own > budget:
                extra = open_ and 2 * (budget - have) >= own
                open_ = False
            have += own
            for doc in cells[h]:
                taken[doc] = size[doc] * (full + (1 if extra else 0))
    return {doc: (size[doc], total[source[doc]], target[source[doc]], taken[doc]) for doc in size}
