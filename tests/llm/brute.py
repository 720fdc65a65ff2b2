"""Plain references for the operators of spotframe.llm, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows, k=5, threshold=80):
    """{doc_id: (n_shingles, component)} for distinct ids."""
    sets = {}
    for i, text in rows:
        w = words(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    joined = Union(sets)
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            joined.join(a, b)
    return {i: (len(s), joined.find(i)) for i, s in sets.items()}


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def epsilon(rows, least=0.98):
    """{vec_id: (n_links, component)} for distinct ids."""
    fine = {}
    for i, vec, label in rows:
        if vec is not None and label is not None and all(x is not None and np.isfinite(x) for x in vec) and any(vec):
            fine[i] = (np.array(vec, np.float64), label)
    joined, links = Union([r[0] for r in rows]), Counter()
    for a, b in combinations(fine, 2):
        (x, lx), (y, ly) = fine[a], fine[b]
        if lx == ly and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            joined.join(a, b)
            links[a] += 1
            links[b] += 1
    return {r[0]: (links[r[0]], joined.find(r[0])) for r in rows}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def base_row(text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    count = Counter(s[0] for s in spans)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined


def targets(size_of, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target}; resharing round by round."""
    order = sorted((s for s in size_of if s is not None)) + ([None] if None in size_of else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size_of.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * size_of[s]} if total else set()
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * size_of[s]
        left -= sum(out[s] for s in full)
        open_ -= full


def mix(rows, **how):
    """[(doc_id, size, source_size, target, taken)] by sorting each source's documents by hash."""
    size_of, by = Counter(), defaultdict(list)
    for i, source, text in rows:
        n = len(words(text))
        size_of[source] += n
        by[source].append((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, n))
    goal, out = targets(dict(size_of), **how), []
    for source, docs in by.items():
        total, want = size_of[source], int(np.floor(goal[source] + 0.5))
        copies = min(2, want // total) if total else 0
        left = want - copies * total
        for _, i, n in sorted(docs):
            extra = max(0, min(n, left, 2 * n - copies * n))
            left -= extra
            out.append((i, n, total, goal[source], copies * n + extra))
    return out


def quality_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def chat(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        all_, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def shards(rows, limit):
    """{doc_id: (depth, prefix bits)} for distinct ids."""
    items = [(format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b"), i, len((t or "").encode())) for i, t in rows]
    out = {}

    def split(group, depth):
        if sum(g[2] for g in group) <= limit or len({g[0] for g in group}) == 1:
            out.update({g[1]: (depth, g[0][:depth]) for g in group})
            return
        for bit in "01":
            if part := [g for g in group if g[0][depth] == bit]:
                split(part, depth + 1)

    if items:
        split(items, 0)
    return out
