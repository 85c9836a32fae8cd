"""Plain restatements of what the operators must return."""

import hashlib
import re
from collections import defaultdict

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_words(text):
    return WORD.findall((text or "").translate(CAPS))


def licenses(text):
    words, starts, labels = plain_words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def decontaminated(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    places = defaultdict(list)
    for j, w in enumerate(words):
        places[w].append(j)
    for item_id, item in items:
        w = plain_words(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in places.get(w[i], ()):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingle_set(text, k=5):
    words = [w.decode() for w in (text or "").translate(CAPS).encode().split()]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(docs, percent):
    """{doc_id: (n_shingles, component_id)} for unique ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def edited(docs):
    """{doc_id: (n_chars, edited text)} for unique ids."""
    docs = sorted((i, t or "") for i, t in docs)
    out = {}
    for k, (i, text) in enumerate(docs):
        quarter = len(text) // 4
        out[i] = (len(text), text[: len(text) - quarter] + docs[(k + 1) % len(docs)][1][:quarter])
    return out
