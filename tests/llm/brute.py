"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(t):
    return WORD.findall((t or "").translate(LOW))


def spans_removed(docs, length=100):
    seen, out = set(), []
    for d, t in sorted(docs):
        x = (t or "").encode()
        c = [False] * len(x)
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if w in seen:
                c[i : i + length] = [True] * length
            seen.add(w)
        runs = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((d, len(x), sum(c), runs, sha(bytes(b for b, g in zip(x, c, strict=True) if not g))))
    return out


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def lines_kept(docs, chars=20, least=3):
    """{index of the row: (lines, kept lines)}"""
    where = {}
    for i, (_, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                where.setdefault(k, []).append(i)
    out = {}
    for i, (d, t) in enumerate(docs):
        lines = (t or "").split("\n")
        gone = {k for k, v in where.items() if len(v) >= least and any(docs[j][0] is not None for j in v) and (d is None or d < max(docs[j][0] for j in v if docs[j][0] is not None))}
        out[i] = (lines, [x for x in lines if key(x) not in gone])
    return out


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return {(a, b) for a, b in zip(w, w[1:], strict=False)} if len(w) > 1 else {tuple(w)} if w else set()


def components(n, links):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        p[b] = a
    return [root(i) for i in range(n)]


def near_duplicates(docs):
    docs = sorted(docs)
    s = [shingles(t) for _, t in docs]
    links = [(i, j) for i, j in combinations(range(len(docs)), 2) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    c = components(len(docs), links)
    return [(d, len(s[i]), docs[c[i]][0], c[i] == i) for i, (d, _) in enumerate(docs)]


def contaminated(docs, items, size=10):
    out = []
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    t = t or ""
    o = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    o += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    o += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(o)


def phrases(t, table):
    w, places = words(t), []
    for p, label in table.items():
        q = p.split()
        places += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), sorted(places)


def kneser_ney(texts, order, alphabet):
    """-ln P by tuple of symbols, of an interpolated modified model; texts are lists of symbols with their lead."""
    top = Counter(tuple(t[i : i + order]) for t in texts for i in range(len(t) - order + 1))
    levels = [top]
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[-1]:
            before[g[-k:]].add(g[0])
        levels.append(Counter({g: len(b) for g, b in before.items()}))

    def discount(c):
        n = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.0, 0.05), k + 0.95) for k in range(3)]

    d = [discount(c) for c in levels]
    rows = [defaultdict(list) for _ in levels]
    for c, r in zip(levels, rows, strict=True):
        for g, v in c.items():
            r[g[:-1]].append(v)

    def prob(g):
        if not g:
            return 1 / alphabet
        k = order - len(g)
        low, row = prob(g[1:]), rows[k].get(g[:-1])
        if not row:
            return low
        v, off = levels[k].get(g, 0), sum(d[k][min(x, 3) - 1] for x in row)
        return ((v - d[k][min(v, 3) - 1]) if v else 0) / sum(row) + off / sum(row) * low

    return lambda g: -np.log(prob(tuple(g)))


TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")


def numbered(texts, train, words, kinds, runs):
    """The numbers of the tokens of texts ({id: text}); the most frequent words are those of the texts in train."""
    out, count = {}, Counter()
    for i, t in texts.items():
        raw = (t or "").encode()
        low = raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        last, run, out[i] = None, 0, []
        for m in TOKEN.finditer(low):
            x, y = m[0], raw[m.start() : m.end()]
            run, last = (run + 1 if x == last else 0), x
            if run:
                out[i].append(runs + min(30, run if run < 4 else 2 + int(math.log2(run))))
                continue
            alnum = 48 <= x[0] < 58 or 97 <= x[0] < 123 or x[0] > 127
            kind = 3 if not alnum else 2 if x[0] < 58 else 1 if len(y) > 1 and all(65 <= c <= 90 for c in y[:2]) else 0
            out[i].append((x, kinds + kind * 8 + min(7, int(2 * math.log2(len(x))))))
            if i in train:
                count[x] += 1
    # ties don't matter here as long as all words fit
    assert sum(n > 1 for n in count.values()) <= words
    known = {x: k for k, x in enumerate(x for x, n in count.items() if n > 1)}
    return {i: [known.get(v[0], v[1]) if isinstance(v, tuple) else v for v in s] for i, s in out.items()}


def quality(docs, trusted, quantile=0.999, least=20):
    """{id: (tokens, nll, limit, kept)} of docs (id, text, lang)."""
    from quillon.llm import quality as q

    train = {i for i in trusted if zlib.crc32(str(i).encode()) % 5}
    seqs = numbered({d[0]: d[1] for d in docs}, train, q.WORDS, q.KINDS, q.RUNS)
    lead = {i: [q.START, q.START, *s] for i, s in seqs.items()}
    cost = kneser_ney([lead[i] for i in lead if i in train], 3, q.ALL)
    memo, nll = {}, {}
    for i, s in lead.items():
        grams = [tuple(s[k : k + 3]) for k in range(len(s) - 2)]
        for g in grams:
            if g not in memo:
                memo[g] = cost(g)
        nll[i] = sum(memo[g] for g in grams) / len(grams) if grams else None
    klass = {i: int(math.log(max(len(s), 1)) / math.log(4) + 1e-9) for i, s in seqs.items()}
    lang = {d[0]: d[2] for d in docs}
    by = defaultdict(list)
    for i in trusted - train:
        if i in seqs and nll[i] is not None:
            for key in ((lang[i], klass[i]), ("*", klass[i]), (lang[i], "*"), ("*", "*")):
                by[key].append(nll[i])
    known = [k[1] for k, v in by.items() if k[0] == "*" and k[1] != "*" and len(v) >= least]

    def limit(i):
        if klass[i] < min(known, default=0):
            return None
        for key in ((lang[i], klass[i]), ("*", klass[i]), (lang[i], "*"), ("*", "*")):
            v = sorted(by[key])
            if len(v) >= (1 if key == ("*", "*") else least):
                top = v[max(0, math.ceil(0.9 * len(v)) - 1)]
                over = [x - top for x in v if x > top]
                return top + (sum(over) / len(over) if over else 0) * math.log(0.1 / (1 - quantile))
        return None

    out = {}
    for i, s in seqs.items():
        t = limit(i)
        out[i] = (len(s), nll[i], t, nll[i] is not None and (t is None or nll[i] <= t))
    return out


def vectors(rows, threshold=0.9):
    rows = sorted(rows, key=lambda r: r[0])
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold]
    c = components(len(rows), links)
    n = [sum(i in x for x in links) for i in range(len(rows))]
    return [(r[0], n[i], rows[c[i]][0], c[i] == i) for i, r in enumerate(rows)]


def pfair(counts, cycle, block):
    """Slots of one cycle by direct simulation: earliest deadline first among released blocks."""
    k = {s: 0 for s in counts}
    out = []
    for t in range(cycle):
        ready = [(((k[s] + 1) * cycle + q - 1) // q, s) for s, q in counts.items() if k[s] * cycle <= t * q]
        s = min(ready)[1]
        k[s] += 1
        out.append(s)
    return out


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
