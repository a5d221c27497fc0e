"""Plain sequential models of the two cutters, to check Spark against on random input. Milliseconds throughout."""

import re
import statistics

from tidewords.functions import text as tx

SENT = ".!?"
CLOSE = "\"”’')]"


def _bare(w):
    return w.strip("\"“”‘’'()[]").lower()


def _ends(t, marks):
    return bool(t.rstrip(CLOSE)) and t.rstrip(CLOSE)[-1] in marks


def _abbr(t, decimals):
    last = _bare(t.split()[-1]) if t.split() else ""
    return last in tx.ABBREVIATIONS or bool(re.fullmatch(r"([a-z]\.)+", last)) or decimals and bool(re.search(r"\d\.\d", last))


def _plain(t):
    w = t.split()
    last = _bare(w[-1]) if w else ""
    if not last:
        return 0.0
    if last in tx.DANGLING or re.search(r"(n['’]t|['’](s|re|m|ve|ll|d))$", last):
        return -2.5
    return -1.25 if any(c.isdigit() for c in last) else 0.0


def _open(t, ended):
    for w in t.split():
        h = _bare(w)
        if h in tx.FILLERS:
            continue
        return 0.8 if h in tx.STRONG_MARKERS else 0.4 if h in tx.WEAK_MARKERS else -1.0 if h in tx.DANGLING and not ended else 0.0
    return 0.0


def _pick(pool):
    top = None
    for k, s in pool:
        if top is None or s >= top[1]:
            top = (k, s)
    return top[0]


def paragraphs(lines, pause=2000, least=40, most=120):
    """lines: (text, start, end). Groups as (text, start, end)."""
    n = len(lines)
    if not n:
        return []
    raw = [lines[i + 1][1] - lines[i][2] for i in range(n - 1)]
    base = min(0, statistics.median(raw)) if raw else 0
    gap = [max(0, g - base) for g in raw]
    words = [len(t.split()) for t, _, _ in lines]

    def worth(i):
        t = lines[i][0]
        s, full = 3 * (gap[i] / 1000 if i < len(gap) else 0), False
        if t.rstrip(CLOSE).endswith(("...", "…")):
            s += 1.0
        elif _ends(t, SENT):
            full = not _abbr(t, False)
            s += 2.0 if full else 0.6
        elif _ends(t, ",;:—–"):
            s += 0.6
        else:
            s += _plain(t)
        return s + (_open(lines[i + 1][0], full) if i + 1 < n else 0)

    def halves(g):
        tot = sum(words[i] for i in g)
        cum, pool, other = 0, [], []
        for p in range(len(g) - 1):
            cum += words[g[p]]
            s = worth(g[p]) - 2 * abs(cum - tot / 2) / max(tot / 2, 1)
            other.append((p, s))
            if cum >= least and tot - cum >= least:
                pool.append((p, s))
        if not (pool or other):
            return [g]
        p = _pick(pool or other)
        return [g[: p + 1], g[p + 1 :]]

    def mend(groups):
        both = groups[-2] + groups[-1]
        return groups[:-2] + ([both] if sum(words[i] for i in both) <= most else halves(both))

    runs, a = [], 0
    for i in range(n):
        if i == n - 1 or gap[i] > pause:
            runs.append((a, i + 1))
            a = i + 1
    out = []
    target = least + 0.45 * (most - least)
    for lo, hi in runs:
        groups, i = [], lo
        while i < hi:
            cum, pool, over = 0, [], None
            for j in range(i, hi):
                cum += words[j]
                if least <= cum <= most:
                    pool.append((j, worth(j) - 0.8 * abs(cum - target) / target))
                if cum >= most:
                    over = j
                    break
            end = hi if over is None else (_pick(pool) if pool else over) + 1
            groups.append(list(range(i, end)))
            i = end
        if len(groups) > 1 and sum(words[i] for i in groups[-1]) < least:
            groups = mend(groups)
        out += groups
    if len(out) > 1 and sum(words[i] for i in out[-1]) < least and gap[out[-1][0] - 1] <= 2 * pause:
        out = mend(out)
    made = [(" ".join(lines[i][0] for i in g if lines[i][0].strip()), lines[g[0]][1], lines[g[-1]][2]) for g in out]
    return [m for m in made if m[0]]


def clips(words, least=1000, most=15000, pause=2000):
    """words: (text, start or None, end or None, joins_left). Clips as (text, start, end, oversized)."""
    n = len(words)
    if not n:
        return []
    a = [max(s or 0, 0) for _, s, _, _ in words]
    b = [max(e if e is not None else a[i], a[i]) for i, (_, _, e, _) in enumerate(words)]
    text = [w[0].strip() for w in words]
    goes = [i + 1 < n and words[i + 1][3] for i in range(n)]
    soft = [t.rstrip(CLOSE).endswith(("...", "…")) for t in text]
    sent = [not goes[i] and not soft[i] and _ends(t, SENT) and not _abbr(t, True) for i, t in enumerate(text)]
    clause = [not goes[i] and (_ends(t, ",;:—–") or soft[i]) for i, t in enumerate(text)]
    gap = [max(0, a[i + 1] - b[i]) for i in range(n - 1)]

    def size(x, y):
        return max(b[x : y + 1]) - min(a[x : y + 1])

    def plain(k):
        return 3 * gap[k] / 1000 + (2 if sent[k] else 0.6 if clause[k] else 0)

    target = least + 0.45 * (most - least)
    pieces, lo = [], 0
    for r in range(n):
        if not (r == n - 1 or gap[r] > pause):
            continue
        hi, i = r + 1, lo
        lo = hi
        while i < hi:
            pool, over = [], None
            for k in range(i, hi):
                d = size(i, k)
                if least <= d <= most and k < hi - 1:
                    s = 3 * gap[k] / 1000 + (2 if sent[k] else 0.6 if clause[k] else _plain(text[k])) + _open(text[k + 1], sent[k])
                    pool.append((k, s - 0.8 * abs(d - target) / (most - least)))
                if d >= most:
                    over = k
                    break
            end = hi - 1 if over is None else _pick(pool) if pool else max(over - 1, i)
            pieces.append((i, end))
            i = end + 1
    if len(pieces) > 1 and size(*pieces[-1]) < least:
        (x, _), (t, z) = pieces[-2:]
        pos = [g for g in gap if g > 0]
        scale = max(statistics.median(pos) if pos else 0, 500)
        if gap[t - 1] <= 2 * scale:
            if size(x, z) <= most:
                pieces[-2:] = [(x, z)]
            else:
                half = size(x, z) / 2
                rows = [(k, plain(k) - 2 * abs(size(x, k) - half) / max(half, 1e-6)) for k in range(x, z)]
                good = [(k, s) for k, s in rows if size(x, k) >= least and size(k + 1, z) >= least]
                k = _pick(good or rows)
                pieces[-2:] = [(x, k), (k + 1, z)]
    out = []
    for x, y in pieces:
        said = ""
        for i in range(x, y + 1):
            if text[i]:
                said += text[i] if words[i][3] or not said else " " + text[i]
        if said:
            out.append((said, min(a[x : y + 1]), max(b[x : y + 1]), size(x, y) > most))
    return out
