"""Repetition inside one document.

Method: line sequence labelling. A text's words are laid out in lines, sentences of up to ``LINE`` words; a
linear-chain conditional random field reads features of each line (how new its words are, how many of its pairs and
triples of words stood before, its length, place, points and own variety) and labels it content or boilerplate by
Viterbi decoding. The share of words in content lines decides retention: ``keep`` of :func:`retained`. Records with
a boilerplate line are then measured exactly, word by word, where the exact share is asked for.

No record that is half repeated comes out without a boilerplate line. Its repeated words lie in passages of five or
more, of which all but two words end a triple that stood before; so in some line three tenths of the words or more do.
:func:`fit` raises the bias of such lines, if it must, until no neighbours can make the best path take one for content.

Words carry no case and no punctuation, and printed times are no words. A word is repeated if it lies
in ``PASSAGE`` consecutive words that stood earlier in the same text; passages may overlap.
Each text is measured alone, so there is no shuffle and no group to be hot.
"""

from __future__ import annotations

import itertools
import random

import numpy as np

from tidewords.llm.tokens import Tokens

PASSAGE = 5
LINE, LEAST_LINE = 10, 4
LEAST_WORDS = 10
LIMIT = 0.5
#: Upper edges of the bins of each feature, all shares but ``size`` (words) and ``place`` (0 for the first line, else 1).
EDGES = {"triples": (0.0, 0.15, 0.2999, 0.5, 0.75), "pairs": (0.0, 0.2999, 0.6, 0.85), "new": (0.0, 0.2, 0.5, 0.8), "variety": (0.5, 0.8, 0.999), "size": (3, 6, 9), "points": (0.0, 0.3), "place": (0,)}
#: First bin of ``triples`` and of ``pairs`` in which a line must count as boilerplate.
SURE = 3


def _again(code: np.ndarray) -> np.ndarray:
    """Of each code whether it stood before."""
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    out = np.zeros(len(code), bool)
    out[order] = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(code) else out
    return out


def _codes(forms: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``n`` words of one text begin, and a code of the text and those words."""
    if len(forms) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        code = doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(n):
            code = (code ^ forms[whole + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            code ^= code >> np.uint64(32)
    return whole, code


def repeated_words(forms: np.ndarray, doc: np.ndarray, passage: int = PASSAGE) -> np.ndarray:
    """Of each word whether it lies in a passage that stood earlier in its text. doc: ascending text numbers."""
    n = len(forms)
    whole, code = _codes(forms, doc, passage)
    hits = whole[_again(code)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, np.minimum(hits + passage, n), -1)
    return np.cumsum(edge[:n]) > 0


def ending(forms: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each word whether it ends ``n`` words that stood earlier in its text."""
    whole, code = _codes(forms, doc, n)
    out = np.zeros(len(forms), bool)
    out[whole + n - 1] = _again(code)
    return out


def lines(doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Line number of each word: a line ends with its text, after ``LINE`` words, or with a sentence if it has ``LEAST_LINE``."""
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = (doc[1:] != doc[:-1]) | ends[:-1]
    for _ in range(2):  # sentences, then what is left of long ones; short sentences go on into the next line
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        within = np.arange(n) - np.repeat(at, size)
        new |= within % LINE == 0
    # from the left, a start that makes the line before it too short is taken back, unless a text begins there
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    fresh = np.ones(len(at), bool)
    fresh[1:] = doc[at[1:]] != doc[at[1:] - 1]
    short = np.concatenate([[False], size[:-1] < LEAST_LINE]) & ~fresh
    # of several short ones in a row every other is joined, and never past LINE words
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(short, -1, np.arange(len(at))))
    join = short & (run % 2 == 1) & (np.concatenate([[0], size[:-1]]) + size <= LINE)
    new[at[join]] = False
    return np.cumsum(new) - 1


def features(forms: np.ndarray, doc: np.ndarray, ends: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line (lines, features in the order of EDGES), the line of each word, the text of each line."""
    line = lines(doc, ends)
    k = int(line[-1]) + 1
    size = np.bincount(line, minlength=k)
    first = np.cumsum(size) - size
    text = doc[first]
    share = lambda flag: np.bincount(line[flag], minlength=k) / size
    inside = np.unique(line * (1 << 40) + forms) >> 40  # a form counts once in a line
    opens = np.ones(k, bool)
    opens[1:] = text[1:] != text[:-1]
    value = {"triples": share(ending(forms, doc, 3)), "pairs": share(ending(forms, doc, 2)), "new": share(~ending(forms, doc, 1)), "variety": np.bincount(inside, minlength=k) / size, "size": size, "points": share(points), "place": (~opens).astype(np.int64)}
    return np.stack([np.searchsorted(e, value[name], side="left") for name, e in EDGES.items()], 1), line, text


class Field:
    """Weights of the field: ``emit``, of boilerplate against content by feature and bin, and transitions."""

    def __init__(self, emit: list[np.ndarray], trans: np.ndarray):
        self.emit, self.trans = emit, trans

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Emission of content, which is zero, and of boilerplate."""
        out = np.zeros((len(bins), 2))
        out[:, 1] = sum(w[bins[:, j]] for j, w in enumerate(self.emit))
        return out

    def shortfall(self) -> float:
        """By how much a line of SURE bins may miss being boilerplate, whatever its other features and its neighbours."""
        least = np.inf
        width = [len(w) for w in self.emit]
        for bins in itertools.product(range(SURE, width[0]), range(2, width[1]), *map(range, width[2:])):
            # words that end a pair that stood before aren't new, so few of such a line are
            if bins[1] < len(EDGES["pairs"]) and bins[2] <= 3 or bins[2] <= 1:
                least = min(least, sum(w[b] for w, b in zip(self.emit, bins, strict=True)))
        t = self.trans
        turn = min(t[a, 1] + t[1, b] - t[a, 0] - t[0, b] for a in (0,) for b in (0,))
        return max(0.0, 1e-6 - least - min(turn, t[0, 1] - t[0, 0], t[1, 0] - t[0, 0], 0.0))


def _planted(samples: list[str], n: int, rng: random.Random) -> list[tuple[list[str], list[bool]]]:
    """Texts of sample sentences with planted repetition, and of each token whether it is planted: passages said again
    once or more, loops of a phrase; also single words that recur, which are content."""
    sentences = [s for t in samples for s in _sentences(t)]
    out = []
    for _ in range(n):
        words: list[str] = []
        flags: list[bool] = []
        kind = rng.choice(("plain", "again", "again", "loop", "mixed"))
        length = rng.choice((12, 30, 60, 120))
        while len(words) < length:
            own = list(rng.choice(sentences))
            if rng.random() < 0.3:  # captions begin and end anywhere
                own = own[rng.randrange(len(own)) :]
            words += own
            flags += [False] * len(own)
            what = rng.choice(("again", "loop")) if kind == "mixed" else kind
            if what == "again" and len(words) > PASSAGE and rng.random() < 0.6:
                for _ in range(rng.choice((1, 1, 2, 3))):
                    size = rng.randint(PASSAGE, min(40, len(words)))
                    a = rng.randrange(len(words) - size + 1)
                    words += words[a : a + size]
                    flags += [True] * size
            if what == "loop" and rng.random() < 0.5:
                phrase = rng.choice(sentences)[: rng.randint(1, 8)]
                times = rng.randint(max(2, 1 + PASSAGE // len(phrase)), 20)
                words += phrase * times
                flags += [False] * len(phrase) + [True] * (len(phrase) * (times - 1))
            if rng.random() < 0.2:
                words.append(rng.choice(words))
                flags.append(False)
        if rng.random() < 0.3:
            words = [w.strip(".,;:!?").lower() or w for w in words]
        out.append((words, flags))
    return out


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in text.split():
        out[-1].append(w)
        if w[-1] in ".!?…;":
            out.append([])
    return [s for s in out if s]


def columns() -> dict:
    """What the token table must know besides the form: whether a token ends a sentence, and whether with a point."""
    from tidewords.llm.language import ends_sentence

    return {"ends": ends_sentence, "points": lambda tokens: np.fromiter((not t[-1].isalnum() for t in tokens), bool, len(tokens))}


def fit(samples: list[str], *, texts: int = 500, rounds: int = 120, seed: int = 5) -> Field:
    """The field of highest penalized likelihood, by Adam, on ``texts`` texts of the samples' sentences with planted
    repetition. A line is boilerplate if half of its words or more are planted."""
    rng = random.Random(seed)
    if not any(s.split() for s in samples):
        samples = [" ".join(f"w{rng.randrange(900)}" + "." * (k % 9 == 8) for k in range(400))]
    made = _planted([s for s in samples if s.split()], texts, rng)
    table = Tokens(**columns())
    rows, lens = table.encode([" ".join(w) for w, _ in made])
    planted = np.concatenate([np.array(f) for _, f in made])
    form = table.column("form")[rows]
    real = form >= 0
    doc = np.repeat(np.arange(len(lens)), lens)
    bins, line, text = features(form[real], doc[real], table.column("ends")[rows][real], table.column("points")[rows][real])
    size = np.bincount(line)
    gold = (2 * np.bincount(line, planted[real]) >= size).astype(np.int64)
    per = np.bincount(text, minlength=len(lens))
    steps = int(per.max())
    at = np.cumsum(per) - per
    order = np.argsort(-per, kind="stable")
    live = [order[per[order] > t] for t in range(steps)]
    emit = [np.zeros(len(e) + 1) for e in EDGES.values()]
    trans = np.zeros((2, 2))
    same = np.flatnonzero(text[1:] == text[:-1])
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (gold[same], gold[same + 1]), 1)
    par = [*emit, trans]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for it in range(1, rounds + 1):
        field = Field(par[:-1], par[-1])
        score = field.scores(bins)
        e, tr = np.exp(score - score.max(1, keepdims=True)), np.exp(par[-1] - par[-1].max())
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        fwd[at] = e[at] / e[at].sum(1, keepdims=True)
        for t in range(1, steps):
            i = at[live[t]] + t
            f = (fwd[i - 1] @ tr) * e[i]
            fwd[i] = f / f.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            i = at[live[t + 1]] + t
            b = (bwd[i + 1] * e[i + 1]) @ tr.T
            bwd[i] = b / b.sum(1, keepdims=True)
        p = fwd * bwd
        p /= p.sum(1, keepdims=True)
        pair = fwd[same][:, :, None] * tr * (e[same + 1] * bwd[same + 1])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        grads = [np.bincount(bins[:, j], gold - p[:, 1], len(w)) - 0.5 * w for j, w in enumerate(par[:-1])]
        grads.append(gold_t - pair.sum(0) - 0.5 * par[-1])
        for k, (w, g) in enumerate(zip(par, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w += 0.1 * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.99**it)) + 1e-8)
    field = Field(par[:-1], par[-1])
    field.emit[0][SURE:] += field.shortfall()
    return field


def viterbi(emission: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of many sequences that lie one after another in ``emission``."""
    lens = lens[lens > 0]
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    back = np.zeros(emission.shape, np.int8)
    best = np.zeros(emission.shape)
    best[starts] = emission[starts]
    longest = int(lens[0]) if len(lens) else 0
    live = np.searchsorted(-lens, -np.arange(longest + 1), side="left")  # sequences longer than t
    for t in range(1, longest):
        at = starts[: live[t]] + t
        step = best[at - 1][:, :, None] + trans
        back[at] = step.argmax(1)
        best[at] = step.max(1) + emission[at]
    labels = np.zeros(len(emission), np.int64)
    if len(lens):
        labels[starts + lens - 1] = best[starts + lens - 1].argmax(1)
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def measure(field: Field, forms: np.ndarray, ends: np.ndarray, points: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of words, of repeated words, share of words in boilerplate lines.

    forms: word form ids of all texts one after another, -1 for no word; ends, points: of the same tokens; lens: tokens
    of each text. Repeated words are counted in texts with a boilerplate line, which all texts of LIMIT and more have;
    a text without one, and one without words, has zero.
    """
    texts = len(lens)
    doc = np.repeat(np.arange(texts), lens)
    real = forms >= 0
    forms, doc = forms[real], doc[real]
    words = np.bincount(doc, minlength=texts)
    if not len(forms):
        return words, np.zeros(texts, np.int64), np.zeros(texts)
    bins, line, text = features(forms, doc, ends[real], points[real])
    label = viterbi(field.scores(bins), np.bincount(text, minlength=texts), field.trans) == 1
    boiler = np.bincount(doc, label[line], texts)
    some = boiler[doc] > 0
    again = np.bincount(doc[some][repeated_words(forms[some], doc[some])], minlength=texts)
    return words, again, boiler / np.maximum(words, 1)


def retained(boiler: np.ndarray, *, limit: float = LIMIT) -> np.ndarray:
    """True for records whose content lines hold more than the rest of ``limit``."""
    return boiler < limit


def repetitive(words: np.ndarray, again: np.ndarray, boiler: np.ndarray, *, least: int = LEAST_WORDS, limit: float = LIMIT) -> np.ndarray:
    """True for records with boilerplate lines whose exact share of repeated words reaches the limit."""
    return (words >= least) & (boiler > 0) & (again >= limit * words)
