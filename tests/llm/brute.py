"""Plain versions of the operators, one document after the other, to hold results against."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def phrases(text):
    w = alnum(text)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return {
        "n_words": len(w),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(labels)),
    }


def counts(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = collections.Counter(windows)
    inside = {k + i for k, x in enumerate(windows) if times[x] > 1 for i in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w),
    }


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        listed = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


def repeats(docs, width=100):
    """doc_id to (n_bytes, n_removed, n_spans, bytes left), for documents in order of id."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        edge = np.zeros(len(data) + 1, int)
        for k in range(len(data) - width + 1):
            if data[k : k + width] in seen:
                edge[k] += 1
                edge[k + width] -= 1
            seen.add(data[k : k + width])
        gone = np.cumsum(edge[:-1]) > 0
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), left)
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def near_groups(docs):
    """doc_id to (set size, least id reachable)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def pieces(ids, capacity=2048):
    """(piece, start, length, crc32) of a document's ids, end token included."""
    first = len(ids) % capacity or capacity
    cuts = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def damaged(rows):
    """Conversation to its (turn, role, text) in order, after the damage of the result contract."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha256: the shortest path over edits and states."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, said = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            break
        steps = [("I", 5, role, "", 0) for role in ("user", "assistant")]
        if at < len(rows):
            _, own, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, said))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                steps += [("K", more, own, text, 1)] + [("R", 1 + more, role, text, 1) for role in ("user", "assistant")]
        for edit, price, role, text, taken in steps:
            if (state, role[:1]) in after:
                heapq.heappush(heap, (cost + price, audit + edit, at + taken, after[state, role[:1]], (*said, f"{role}:{text}")))
    kinds = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def phrases_of(docs, frequent, longest=5, reported=2000, absorbed=100):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: c for p, c in f.items() if len(p) > 2 and c >= frequent}
    dropped = set()
    for p, c in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                part = (p[0], *p[i : i + k])
                if 100 * c >= absorbed * f[part]:
                    dropped.add(part)
    out = collections.defaultdict(list)
    for p, a in candidates.items():
        if p not in dropped:
            lang, w = p[0], p[1:]
            cuts = [(f[lang, *w[:k]], f[lang, *w[k:]], k) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for x, y, k in cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [
        (lang, rank, p.decode(), -a, x, y, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:reported], 1)
    ]


def simhash(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = collections.Counter(i for s in shingles for i in range(64) if xxhash.xxh64_intdigest(s, 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def close_groups(prints, radius=4):
    """Least id reachable of each (id, fingerprint)."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}
