"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeats(texts, cut, window):
    """{id: covered flags} of values that stand in windows which also start in a smaller id."""
    values = {d: cut(t) for d, t in texts}
    first = {}
    for d in sorted(values):
        v = values[d]
        for i in range(len(v) - window + 1):
            first.setdefault(tuple(v[i : i + window]), d)
    out = {}
    for d, v in values.items():
        flags = [False] * len(v)
        for i in range(len(v) - window + 1):
            if first[tuple(v[i : i + window])] < d:
                flags[i : i + window] = [True] * window
        out[d] = (v, flags)
    return out


def word_repeats(texts, window=50):
    out = {}
    for d, (v, f) in repeats(texts, lambda t: WORD.findall(t or ""), window).items():
        out[d] = (len(v), sum(f), sha(" ".join(w for w, x in zip(v, f) if not x)))
    return out


def byte_repeats(texts, window=50):
    out = {}
    for d, (v, f) in repeats(texts, lambda t: (t or "").encode(), window).items():
        spans = sum(x and not y for x, y in zip(f, [False, *f]))
        out[d] = (len(v), sum(f), spans, sha(bytes(b for b, x in zip(v, f) if not x)))
    return out


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def near_duplicates(texts, k):
    """{id: (shingles, component, kept)} with all pairs compared."""
    sets = {d: shingles(t, k) for d, t in texts}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    labels = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = []
    for phrase, label in labels.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("((?:", "((?ai:"))


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = [sum(k == x for _, k, _ in found) for x in range(3)]
    names = ("assign", "access", "hex")
    return *n, sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found)))


def text_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for r in runs:
        count[r] = count.get(r, 0) + 1
    covered = {i + j for i, r in enumerate(runs) if count[r] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed
