"""Brute-force versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def leaks(docs, items, threshold=0.8, width=5):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for item_id, item in items:
        it = tokens(item)
        w = min(width, len(it))
        want = {tuple(it[i:i + w]) for i in range(len(it) - w + 1)} if w else set()
        for doc_id, text in docs:
            d = tokens(text)
            n = len(want & {tuple(d[i:i + w]) for i in range(len(d) - w + 1)}) if w else 0
            if want and n >= threshold * len(want) - 1e-9:
                out.add((doc_id, item_id, len(want), n))
    return out


def simhash(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(docs, bits=3):
    fps = [(d, simhash(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= bits:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (f"{fp:016x}", find(d)) for d, fp in fps}


def without_repeats(docs, width=20):
    first = {}
    for d, t in sorted(docs):
        ws = words(t)
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i:i + width]), (d, i))
    out = {}
    for d, t in docs:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i:i + width])] != (d, i):
                gone |= set(range(i, i + width))
        out[d] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def nearest(vectors, query_ids, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for q in query_ids:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out[q] = [(int(i), -t) for t, i in order]
    return out


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, fine in rules for m in re.finditer(p, text or "") if fine(m.group())]


def secrets(text):
    rules = [
        ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, fine) in enumerate(rules) for m in re.finditer(p, text or "") if fine(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def chats(rows):
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].add((turn if turn is not None else 2**62, role or "", text or ""))
    bodies = {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in turns.items()}
    out = {}
    for c, body in bodies.items():
        equal = [d for d, b in bodies.items() if b == body]
        longer = any(len(b) > len(body) and b[:len(body)] == body for b in bodies.values())
        if c == min(equal) and not longer:
            safe = lambda s: s.replace("<|", "< |")
            out[c] = (len(body), len(equal), "".join(f"<|im_start|>{safe(r)}\n{safe(t)}<|im_end|>\n" for r, t in body))
    return out


def patterns(texts, personal):
    """Specific (pattern, kind) and the trusted ones, by plain loops over the candidates of every text."""
    import math

    edges, places, spans, background = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for text in texts:
        base = personal.base_spans(text)
        for kind, _, _ in base:
            spans[kind] += 1
        for word in re.findall(r"[^\W\d_]{2,24}", text.lower()):
            background[word] += 1
        for pattern, instance, kind, like, _, _ in [*personal.candidates(text, base), *personal.shaped(text, base)]:
            old = edges.get((pattern, instance), (None, False))
            kinds = [k for k in (old[0], kind) if k is not None]
            edges[pattern, instance] = (min(kinds) if kinds else None, old[1] or like)
            if kind is not None:
                places[pattern, kind] += 1
    total = sum(background.values())
    specific = set()
    for (pattern, kind), at in places.items():
        n = max(background[re.match(r"_?([^:=_#]+)", pattern).group(1)], at)
        if (at / spans[kind]) / (n / total) >= personal.LEAST_LIFT or at / n >= personal.LEAST_PLACES:
            specific.add((pattern, kind))
    sizes = defaultdict(int)
    for pattern, _ in edges:
        sizes[pattern] += 1
    beliefs = {(p, i, k): 1.0 for (p, i), (k, _) in edges.items() if k is not None}
    unseen = [(p, i) for (p, i), (k, like) in edges.items() if k is None and like]
    for step in range(personal.ROUNDS):
        scores = {}
        for (p, _, k), b in beliefs.items():
            if (p, k) in specific:
                s, n = scores.get((p, k), (0.0, 0))
                scores[p, k] = (s + b, n + (b >= personal.LEAST_BELIEF))
        scores = {(p, k): (s / (sizes[p] + 1), n) for (p, k), (s, n) in scores.items()}
        good = {key: s for key, (s, n) in scores.items() if s >= personal.LEAST_SCORE / 2 and n >= personal.LEAST_INSTANCES}
        if step == personal.ROUNDS - 1 or not good:
            break
        beliefs = {key: b for key, b in beliefs.items() if b == 1.0 and edges[key[:2]][0] is not None}
        of = defaultdict(list)
        for p, i in unseen:
            of[i].append(p)
        for p, i in unseen:
            for k in range(4):
                if any((q, k) in good for q in of[i]):
                    doubt = sum(math.log(1 - min(good[q, k], 0.99)) for q in of[i] if q != p and (q, k) in good)
                    beliefs[p, i, k] = 1 - math.exp(doubt)
    least = lambda p: personal.LEAST_SHAPED if re.search("[:=]#", p) else personal.LEAST_SCORE
    best = {}
    for (p, k), (s, n) in scores.items():
        if s >= least(p) and n >= personal.LEAST_INSTANCES and (p not in best or (s, -k) > best[p]):
            best[p] = (s, -k)
    return specific, {(p, -k) for p, (_, k) in best.items()}


def classes_of(names, links):
    """Least name connected to each name."""
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def shingle_similarity(a, b, width=5):
    """Jaccard similarity of the sets of word shingles."""
    sets = []
    for text in (a, b):
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets.append({tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def wide_fingerprint(text, width=5):
    """512 majority bits of a text's different shingles, bit by bit."""
    from clonara.llm.common import mixed, window_hashes

    ws = [w.encode() for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    shingles = sorted(set(window_hashes(hashes, min(width, len(ws))).tolist())) if ws else []
    out = []
    for turn in mixed(np.arange(1, 9, dtype=np.uint64)):
        turned = mixed(np.array(shingles, np.uint64) ^ turn)
        out.append(sum(1 << b for b in range(64) if 2 * int((turned >> np.uint64(b) & np.uint64(1)).sum()) > len(shingles)))
    return np.array(out, np.uint64)


def wide_classes(docs, bits=90):
    """Least doc_id connected to each over wide fingerprints of at most so many different bits, by all pairs."""
    ids = [d for d, _ in docs]
    fps = np.array([wide_fingerprint(t) for _, t in docs])
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]).sum(1) <= bits)]
    return classes_of(ids, links)
