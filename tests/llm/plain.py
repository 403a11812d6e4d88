"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def exact(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} of (doc_id, text) rows with distinct ids."""
    texts = {i: BLANK.sub(" ", t or "") for i, t in rows}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


def simhash(text):
    words = [w for w in BLANK.split((text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, most=3):
    """{doc_id: (fingerprint, smallest id reachable)}."""
    fps = {i: simhash(t) for i, t in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def contamination(rows, items, size=13):
    """{doc_id: (n_words, n_hit, item ids, contaminated)}."""
    windows = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= names
        out[i] = (len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def token_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def removed(rows, size=50):
    """{doc_id: (bytes, removed bytes, removed runs, hash of the rest)}."""
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - size + 1):
            first.setdefault(data[i][p : p + size], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\x01" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def jaccard(rows, num=90, den=100):
    """{doc_id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [x for x in BLANK.split((t or "").translate(LOWER)) if x]
        sets[i] = frozenset(" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def collocations(rows, least, top):
    """Sorted (lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts, n, out = {}, {}, []
    for t, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    f[g] = f.get(g, 0) + 1
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        covered = {h[i : i + k] for h, b in often.items() for k in range(2, len(h)) for i in range(len(h) - k + 1) if b >= f[h[i : i + k]]}
        found = []
        for g, a in often.items():
            if g not in covered:
                score, _, left, right = min((1000 * a * n[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_hash("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _flanks(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def manifest(rows):
    """{doc_id: (leaf, subroot, root, proof, folded root, verified)} of (doc_id, source, lang, n_chars, text) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {g: sorted((r for r in rows if r[2] == g), key=lambda r: r[0]) for g in langs}
    trees = {g: _levels([_leaf(r) for r in held[g]]) for g in langs}
    top = _levels([trees[g][-1][0] for g in langs])
    out = {}
    for k, g in enumerate(langs):
        for i, r in enumerate(held[g]):
            path = [*_flanks(trees[g], i), *_flanks(top, k)]
            changed = zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            h = _leaf((*r[:4], r[4].translate(LOWER))) if changed else trees[g][0][i]
            for left, right in path:
                h = _hash(left + h + right)
            out[r[0]] = (trees[g][0][i], trees[g][-1][0], top[-1][0], _hash("".join(a + b for a, b in path)), h, h == top[-1][0])
    return out
