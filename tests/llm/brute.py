"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows, length=50):
    """{id: (n_bytes, n_removed, n_spans, sha256 of what is kept)} by looking at every byte string."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    """{id: (set size, smallest linked id)} by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a, b in combinations(ids, 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                r, s = sorted((find(a), find(b)))
                top[s] = r
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(rows, items, size=10):
    """{id: (n_words, n_hit, n_items, item ids)} by comparing every window at every place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = {}
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            v = words(it)
            n = min(len(v), size)
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names.add(str(item))
        out[i] = (len(w), len(hit), len(names), ",".join(sorted(names)))
    return out


def line_dedup(rows, size=3):
    """{id: kept text} with later three-line windows removed."""
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ls = (t or "").split("\n")
        for p in range(len(ls) - size + 1):
            w = tuple(ls[p : p + size])
            if any(re.search(r"[^\x20\x09-\x0D]", x) for x in w):
                if w in seen:
                    gone[i] |= set(range(p, p + size))
                seen.add(w)
    return {i: (t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows}


def kept_by_rules(text):
    """The verdict of policy v2."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, grams = len(w), Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    unlike = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in set(ls))
    chars = sum(map(len, w))
    return not (
        n < 50 or 100 * len(cover) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n
        or 100 * (n - unlike) > 30 * n or chars > 12 * n or 2 * chars < 5 * n
        or 100 * sum(c.isupper() for c in text) > 40 * chars)


def prefix_trie(rows, every=20, most=4):
    """{(conv, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} from sequences held whole; rows are
    (conv, turn, role, text), where rows of one turn of a conversation are alike."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = own.get(c - c % every, [])[:h] + mine[h:]
    members, kids = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sums = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(seq, [])]
        mine = (len(members[seq]) - 1) * words(seq[-1][1]) if seq else 0
        sums[seq] = (sum(b[0] for b in below) or 1, mine + sum(b[1] for b in below))
    out = {}
    for seq, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(seq))))
        out[min(who), len(seq)] = (
            min(members[seq[:-1]]) if seq else None, len(who), len(kids.get(seq, [])), *sums[seq], hashlib.sha256(ends.encode()).hexdigest())
    return out


def alignment(rows, a_path, b_path):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] by whole encodings and all pairs of tokens."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    vocab = {i: s for s, i in json.load(open(a_path, encoding="utf-8"))["model"]["vocab"].items()}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    say_a = lambda i: bytes(letter[c] for c in vocab[i])

    def say_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    made, total = [], Counter()
    for i, t in rows:
        want = (" " + (t or "")).encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if b"".join(map(say_a, x)) != want or b"".join(map(say_b, y)) != want:
            x, y = [], []
        spans = []
        for ids, say in ((x, say_a), (y, say_b)):
            at, out = 0, []
            for k in ids:
                out.append((k, at, at + len(say(k))))
                at = out[-1][2]
            spans.append(out)
        links, j = [], 0
        for k, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((k, spans[1][m][0]))
                m += 1
        groups, (p, q) = [], (0, 0)
        for cut in sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}):
            u = [z for z in range(p, len(x)) if spans[0][z][2] <= cut]
            v = [z for z in range(q, len(y)) if spans[1][z][2] <= cut]
            p, q = u[-1] + 1, v[-1] + 1
            groups.append(",".join(str(x[z]) for z in u) + "|" + ",".join(str(y[z]) for z in v))
        total.update(links)
        made.append((i, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, na, nb, ng, len(ls), sum(total[k] == best[k[1]] for k in ls), sum(total[k] for k in ls), d)
            for i, na, nb, ng, ls, d in made]
