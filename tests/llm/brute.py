"""Plain versions of the operators over small Python lists."""
import re
from collections import Counter
from hashlib import sha256

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = {i: i + 32 for i in range(65, 91)}


def low(t):
    return (t or "").translate(_AZ)


def sha(b):
    return sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def contamination(docs, items, width=10):
    pats = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n else ():
            pats.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in {len(p) for p in pats}:
            for i in range(len(w) - n + 1):
                got = pats.get(tuple(w[i : i + n]))
                if got:
                    found |= got
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substrings(docs, width=20):
    """Per row: doc_id, n_words, n_removed, kept text; null ids sort first."""
    key = lambda d: (d is not None, d if d is not None else 0)
    words = [SPACE.findall(t or "") for _, t in docs]
    first = {}
    for (doc, _), w in zip(docs, words):
        for i in range(len(w) - width + 1):
            g, at = tuple(w[i : i + width]), (key(doc), i)
            first[g] = min(first.get(g, at), at)
    out = []
    for (doc, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (key(doc), i) for j in range(i, i + width)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shingles(text, n=5):
    w = SPACE.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(docs):
    """Per row: doc_id, set size, least doc_id of its component; null ids sort last."""
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= 75 * (len(a) + len(sets[j]) - inter):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(docs)]


def tokens(text):
    return [*low(text).encode().split(), None]


def base_scores(train):
    c = Counter(x for t in train for x in tokens(t))
    return c, sum(c.values()), len(c)
