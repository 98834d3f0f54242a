"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def components(docs):
    """{doc_id: (n_shingles, component)} of (id, text) pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def kept_bytes(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} of (id, text) pairs in ascending order of id."""
    seen, out = set(), {}
    for i, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at:at + length]
            if window in seen:
                gone[at:at + length] = b"\x01" * length
            seen.add(window)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def repeated_words(text, n=8):
    w = WORD.findall(text or "")
    runs = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    many = {r for r in runs if runs.count(r) > 1}
    return len({i + k for i, r in enumerate(runs) if r in many for k in range(n)})
