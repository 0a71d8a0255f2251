"""Plain versions of the operators, for small tables."""

import functools
import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash
from tokenizers import Tokenizer


tokenizer_of = functools.cache(Tokenizer.from_file)


def token_ids(path, text):
    return tokenizer_of(path).encode(text or "", add_special_tokens=False).ids


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text):
    w = words_of(text)
    if len(w) < 5:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def near_classes(rows):
    """Smallest (doc_id, nulls last) per class of ``rows [(doc_id, text)]``, in the rows' order."""
    bags = {t or "": bag(t) for _, t in rows}
    texts = list(bags)
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(bags[a], bags[b]) >= 0.8 - 1e-12:
                parent[root(a)] = root(b)
    low = {}
    for d, t in rows:
        r = root(t or "")
        low[r] = min(low.get(r, (True, 0)), (d is None, d or 0))
    return [None if low[root(t or "")][0] else low[root(t or "")][1] for _, t in rows], [root(t or "") for _, t in rows]


def plain_words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def held(text, item):
    """Largest (matched, segment) of the item over all diagonals of the text."""
    d, i = plain_words(text), plain_words(item)
    best = (0, 0)
    where = defaultdict(list)
    for p, w in enumerate(d):
        where[w].append(p)
    for diagonal in {p - q for q, w in enumerate(i) for p in where[w]}:
        matched = segment = score = run = 0
        for q, w in enumerate(i):
            if not 0 <= diagonal + q < len(d):
                continue
            if d[diagonal + q] == w:
                score, run, matched = score + 1, run + 1, matched + 1
            else:
                run = run if score > 4 else 0
                score = max(score - 4, 0)
            segment = max(segment, run)
        best = (max(best[0], matched), max(best[1], segment))
    return best, len(i)


def is_leak(text, item):
    (matched, segment), n = held(text, item)
    return 0 < n == matched if n < 8 else matched >= 0.8 * n or segment >= 13


def repeated_bytes(texts, length=200):
    """Per text (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _hash_longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def _hash_text(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def line_chunks(text):
    lines = (text or "").split("\n")
    h = [_hash_text(x) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or i > 0 and _hash_longs(h[i - 1], h[i]) % 3 == 0:
            chunks.append((start, "\n".join(lines[start : i + 1])))
            start = i + 1
    return chunks


def line_dedup(rows):
    """New texts of ``rows [(doc_id, text)]``."""
    first = {}
    order = sorted(
        {(d, t or "") for d, t in rows},
        key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'null' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()),
    )
    several = lambda c: sum(bool(re.search(r"[^ \t\n\x0b\f\r]", x)) for x in c.split("\n")) >= 2
    new = {}
    for d, t in order:
        kept = []
        for at, c in line_chunks(t):
            if several(c) and first.setdefault(c, (d, t, at)) != (d, t, at):
                continue
            kept.append(c)
        new[d, t] = "\n".join(kept) if len(kept) < len(line_chunks(t)) else None
    return [t if new[d, t or ""] is None else new[d, t or ""] for d, t in rows]


def run_dedup(rows):
    """New texts of ``rows [(doc_id, text)]`` without any run of lines that is equal to an earlier one apart from it."""
    order = sorted(
        {(d, t or "") for d, t in rows},
        key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'null' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()),
    )
    first, gone = {}, {}
    split = [t.split("\n") for _, t in order]
    for n, lines in enumerate(split):
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                first.setdefault(tuple(lines[i:j]), (n, i))
    for n, lines in enumerate(split):
        cut = set()
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                m, at = first[tuple(lines[i:j])]
                if sum(bool(re.search(r"[^ \t\n\x0b\f\r]", x)) for x in lines[i:j]) >= 2 and (m < n or at + j - i <= i):
                    cut.update(range(i, j))
        gone[order[n]] = "\n".join(x for i, x in enumerate(lines) if i not in cut) if cut else None
    return [t if gone[d, t or ""] is None else gone[d, t or ""] for d, t in rows]


def quality(rows):
    """[(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)] of texts."""
    out = []
    for t in rows:
        t = t or ""
        w = words_of(t)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if words_of(x)]
        out.append((
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w),
        ))
    return out


def crc32c(data):
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def masked(data):
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def shard_of(rows, limit):
    """{row number: (prefix, bytes)} by splitting buckets that are over the limit."""
    bits = [
        bin(int(hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16))[2:].zfill(60) for d, t in rows
    ]
    sizes = [len((t or "").encode()) for _, t in rows]
    out = {}

    def split(prefix, members):
        total = sum(sizes[i] for i in members)
        if total <= limit or len(prefix) == 60:
            out.update({i: (prefix, total) for i in members})
            return
        for bit in "01":
            inside = [i for i in members if bits[i].startswith(prefix + bit)]
            if inside:
                split(prefix + bit, inside)

    split("", range(len(rows)))
    return out


def runs(words, min_length, min_copies):
    """All (start, length, period) by comparing every word with the one a period later."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        s = 0
        while s + p < len(words):
            e = s
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            length = e + p - s
            if e > s and length >= max(min_length, min_copies * p):
                w = words[s : s + length]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    found.append((s, length, p))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def lyndon_lengths(word):
    """Longest Lyndon word from each position by the definition: less than all its proper suffixes."""
    n = len(word)
    return [max(k for k in range(1, n - i + 1) if all(word[i : i + k] < word[j : i + k] for j in range(i + 1, i + k))) for i in range(n)]


def index_terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            for t in re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def search(docs, queries, k):
    """``[(item, rank, doc_id, score)]`` of ``[(id, text)]`` lists."""
    bags = [(d, Counter(index_terms(t))) for d, t in docs if d is not None]
    bags = [(d, c) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    found = []
    for item, text in queries:
        asked = Counter(index_terms(text))
        hits = []
        for d, c in bags:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                hits.append((-score, d))
        found += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k])]
    return found
