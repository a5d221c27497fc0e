"""Language of documents and of each stretch of a mixed one.

Method: a linear-chain conditional random field over the words of a text. A word's features are its
affixes, inner character n-grams, script and itself (lexicon); transitions between languages are
learned, one set inside sentences and one at their ends. Forward-backward gives every word the
probability of each language: its label is the likeliest, its confidence that probability.

The field is fitted on the labelled samples, at most ``MOST_SAMPLES`` texts, woven into mixed sequences;
its languages are those of the samples. Each text is labelled where it lies; only word counts are ever shuffled.
"""

from __future__ import annotations

import random
import re
from zlib import crc32

import numpy as np

from tidewords.llm.charforms import canonical

#: Labelled texts used for fitting at most.
MOST_SAMPLES = 2_000
BITS = 15
#: Words of a chunk. Texts of any length are decoded exactly: messages go on from chunk to chunk until none moves by TOLERANCE.
CHUNK, TOLERANCE = 160, 1e-6

# Names, and codes of three letters, of the languages.
NAMES = {"german": "de", "deutsch": "de", "greek": "el", "english": "en", "spanish": "es", "french": "fr", "italian": "it", "dutch": "nl", "portuguese": "pt", "russian": "ru", "turkish": "tr", "ukrainian": "uk"}
ISO3 = {"deu": "de", "ger": "de", "ell": "el", "gre": "el", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt", "rus": "ru", "tur": "tr", "ukr": "uk"}
SAYS_NOTHING = ("", "und", "unknown", "none", "null", "n/a", "na", "mul", "zxx", "mis", "auto", "other", "?", "-", "xx")


def label_code(label: str | None) -> str | None:
    """Two-letter code of a written label; null where it is missing or says nothing; itself if it is strange."""
    if label is None:
        return None
    s = canonical(label).strip().casefold()
    if s in SAYS_NOTHING:
        return None
    base = re.split(r"[-_ (]", s)[0]
    return NAMES.get(s) or NAMES.get(base) or ISO3.get(base) or base


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?…;·]['\"”’»)\]*]*$")
_LETTER = re.compile(r"[^\W\d_]")


def features(token: str) -> list[int]:
    """Hashed features of a token; none for a token without letters."""
    w = _EDGE.sub("", token if token.isascii() else canonical(token)).lower()
    if not _LETTER.search(w):
        return []
    p = f"^{w}$"
    c = w[0]
    feats = [f"w{w}", f"s{'L' if c < 'ɐ' else 'G' if c < 'Ѐ' else 'C'}"]
    feats += [f"p{p[: k + 1]}" for k in (1, 2, 3)] + [f"q{p[-k - 1 :]}" for k in (1, 2, 3, 4)]
    feats += [f"n{p[i : i + k]}" for k in (2, 3, 4) for i in range(len(p) - k + 1)]
    return [crc32(f.encode()) & ((1 << BITS) - 1) for f in dict.fromkeys(feats)]


def ends_sentence(tokens: list[str]) -> np.ndarray:
    return np.fromiter((bool(_END.search(t)) for t in tokens), bool, len(tokens))


class Model:
    """Weights of the field: features by language, and transitions inside and between sentences."""

    def __init__(self, langs: tuple[str, ...], weights: np.ndarray, inside: np.ndarray, between: np.ndarray):
        self.langs = langs
        self.weights, self.inside, self.between = weights.astype(np.float32), inside.astype(np.float32), between.astype(np.float32)

    def scores(self, tokens: list[str]) -> np.ndarray:
        """exp of the emission scores of tokens, scaled to a largest value of one."""
        out = np.zeros((len(tokens), len(self.langs)), np.float32)
        for i, t in enumerate(tokens):
            if f := features(t):
                out[i] = self.weights[f].sum(0) / len(f) ** 0.5
        return np.exp(np.maximum(out - out.max(1, keepdims=True), -30))


def _forward_backward(e: np.ndarray, cut: np.ndarray, inside: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages. e: (time, sequence, language); cut: (time, sequence), a sentence ended before."""
    steps = len(e)
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    fwd[0] = e[0] / e[0].sum(1, keepdims=True)
    back_in, back_bt = np.ascontiguousarray(inside.T), np.ascontiguousarray(between.T)
    for t in range(1, steps):
        f = fwd[t - 1] @ inside
        at = np.flatnonzero(cut[t])
        if len(at):
            f[at] = fwd[t - 1][at] @ between
        f *= e[t]
        fwd[t] = f / f.sum(1, keepdims=True)
    bwd[-1] = 1
    for t in range(steps - 2, -1, -1):
        g = bwd[t + 1] * e[t + 1]
        b = g @ back_in
        at = np.flatnonzero(cut[t + 1])
        if len(at):
            b[at] = g[at] @ back_bt
        bwd[t] = b / b.max(1, keepdims=True)
    return fwd, bwd


def _chained(first: np.ndarray, size: np.ndarray, linked: np.ndarray, follower: np.ndarray, work) -> None:
    """Runs ``work(chunks, step, again)`` over the steps of all chunks: at first each from its own border, then on from the
    chunk it is linked to, as long as messages move. work gives which of its chunks moved by TOLERANCE or more.

    linked: which chunks have one before them in the direction of travel; follower: the next chunk in that direction, -1 for none.
    """
    todo, again = np.arange(len(first)), False
    while len(todo):
        act, ends = todo, []
        for t in range(int(size[todo].max())):
            act = act[size[act] > t]
            if not len(act):
                break
            act = act[work(act, t, again)]
            ends.append(act[size[act] == t + 1])
        if again:
            late = np.concatenate(ends) if ends else act
            todo = follower[late]
            todo = todo[todo >= 0]
        else:
            todo, again = np.flatnonzero(linked), True


def _marginals(e: np.ndarray, cut: np.ndarray, inside: np.ndarray, between: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Probability of each language at each word. e: (word, language), texts one after another; cut: a sentence ended before."""
    chunks = -(-lens // CHUNK)
    total = int(chunks.sum())
    doc = np.repeat(np.arange(len(lens)), chunks)
    k = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = (np.cumsum(lens) - lens)[doc] + k * CHUNK
    size = np.minimum(CHUNK, lens[doc] - k * CHUNK)
    ids = np.arange(total)
    before, after = np.where(k > 0, ids - 1, -1), np.where(k + 1 < chunks[doc], ids + 1, -1)
    fwd, bwd = np.empty_like(e), np.empty_like(e)

    def step(x: np.ndarray, cuts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = x @ one
        if cuts.any():
            out[cuts] = x[cuts] @ two
        return out

    def store(into: np.ndarray, at: np.ndarray, f: np.ndarray, again: bool) -> np.ndarray:
        moved = np.abs(into[at] - f).max(1) >= TOLERANCE if again else np.ones(len(at), bool)
        into[at] = f
        return moved

    def forward(act: np.ndarray, t: int, again: bool) -> np.ndarray:
        at = first[act] + t
        if t:
            f = step(fwd[at - 1], cut[at], inside, between) * e[at]
        else:
            f = e[at].copy()
            if again:
                f *= step(fwd[at - 1], cut[at], inside, between)
        return store(fwd, at, f / f.sum(1, keepdims=True), again)

    back_in, back_bt = np.ascontiguousarray(inside.T), np.ascontiguousarray(between.T)

    def backward(act: np.ndarray, t: int, again: bool) -> np.ndarray:
        at = first[act] + size[act] - 1 - t
        if t or again:
            b = step(bwd[at + 1] * e[at + 1], cut[at + 1], back_in, back_bt)
        else:
            b = np.ones((len(at), e.shape[1]), e.dtype)
        return store(bwd, at, b / b.max(1, keepdims=True), again)

    _chained(first, size, before >= 0, after, forward)
    _chained(first, size, after >= 0, before, backward)
    fwd *= bwd
    fwd /= fwd.sum(1, keepdims=True)
    return fwd


def decode(model: Model, score: np.ndarray, ends: np.ndarray, tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and confidence of every token. score, ends: by token row; tokens: rows of all texts one after another."""
    if not int(lens.sum()):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    cut = np.zeros(len(tokens), bool)
    cut[1:] = ends[tokens[:-1]]
    p = _marginals(score[tokens], cut, model.inside, model.between, lens)
    best = p.argmax(1)
    return best, np.take_along_axis(p, best[:, None], 1)[:, 0]


def _woven(samples: list[tuple[str, str]], langs: tuple[str, ...], n: int, length: int, rng: random.Random) -> list[list[tuple[str, int]]]:
    """Mixed sequences: runs of sentences of one to three languages, some without points and capitals."""
    by: dict[int, list[list[str]]] = {}
    for lang, text in samples:
        for s in re.split(r"(?<=[.!?;])\s+", canonical(text)):
            if s.split():
                by.setdefault(langs.index(lang), []).append(s.split())
    out = []
    for _ in range(n):
        seq: list[tuple[str, int]] = []
        spoken = rng.sample(sorted(by), min(len(by), rng.choice((1, 2, 2, 3))))
        bare = rng.random() < 0.3
        while len(seq) < length:
            lang = rng.choice(spoken)
            for _ in range(rng.randint(1, 4)):
                s = list(rng.choice(by[lang]))
                if rng.random() < 0.2:  # sentences are cut by captions
                    s = s[rng.randrange(len(s)) :]
                if bare:
                    s = [_EDGE.sub("", x).lower() for x in s]
                if rng.random() < 0.1:
                    s.insert(rng.randrange(len(s) + 1), rng.choice(("uh", "um,", "[music]", "(applause)", "hmm", "SPEAKER_01:", "[00:12]", "12")))
                seq += [(x, lang) for x in s if x]
        out.append(seq[:length])
    return out


def fit(samples: list[tuple[str, str]], *, sequences: int = 660, length: int = 120, rounds: int = 30, seed: int = 11, ridge: float = 0.3) -> Model:
    """The field of highest penalized likelihood on woven sequences, by Adam. samples: (language, text); each language
    with a text is one of the field's. Without any it is an error."""
    rng = random.Random(seed)
    samples = [(lang, text) for lang, text in samples if text.split()]
    langs = tuple(sorted({lang for lang, _ in samples}))
    if not langs:
        raise ValueError("no labelled texts to fit the languages on")
    seqs = _woven(samples, langs, sequences, length, rng)
    k = len(langs)
    rows: dict[str, int] = {}
    x = np.array([[rows.setdefault(w, len(rows)) for w, _ in s] for s in seqs]).T
    y = np.array([[lang for _, lang in s] for s in seqs]).T
    vocab = list(rows)
    feats = [features(w) for w in vocab]
    scale = np.repeat([1 / max(1, len(f)) ** 0.5 for f in feats], [len(f) for f in feats])
    f_all = np.array([i for f in feats for i in f])
    owner = np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
    lexical = np.concatenate([[True] + [False] * (len(f) - 1) if f else [] for f in feats]).astype(bool)
    used, f_all = np.unique(f_all, return_inverse=True)
    ends = ends_sentence(vocab)
    cut = np.zeros(x.shape, bool)
    cut[1:] = ends[x[:-1]]
    gold_w = np.zeros((len(vocab), k))
    np.add.at(gold_w, (x, y), 1)
    pairs = [np.zeros((k, k)), np.zeros((k, k))]
    for j in (0, 1):
        m = cut[1:] == bool(j)
        np.add.at(pairs[j], (y[:-1][m], y[1:][m]), 1)
    w, trans = np.zeros((len(used), k)), [np.eye(k) * 3, np.eye(k)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, *trans)]
    nrng = np.random.default_rng(seed)
    for it in range(1, rounds + 1):
        keep = scale * ~(lexical & (nrng.random(len(vocab))[owner] < 0.5))  # the word itself is left out now and then
        score = np.stack([np.bincount(owner, w[f_all, j] * keep, len(vocab)) for j in range(k)], 1)
        e = np.exp(score - score.max(1, keepdims=True))[x]
        tr = [np.exp(t) for t in trans]
        fwd, bwd = _forward_backward(e, cut, *tr)
        p = fwd * bwd
        p /= p.sum(2, keepdims=True)
        flat = x.ravel()
        exp_w = np.stack([np.bincount(flat, p[..., j].ravel(), len(vocab)) for j in range(k)], 1)
        grad_tok = gold_w - exp_w
        grads = [np.stack([np.bincount(f_all, grad_tok[owner, j] * keep, len(used)) for j in range(k)], 1) - ridge * w]
        right = e[1:] * bwd[1:]
        for j in (0, 1):
            m = cut[1:] == bool(j)
            left, r = fwd[:-1][m], right[m]
            z = np.einsum("ni,ij,nj->n", left, tr[j], r)
            grads.append(pairs[j] - tr[j] * (left.T @ (r / z[:, None])) - ridge * trans[j])
        for p_, g, s in zip((w, *trans), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p_ += 0.15 * (s[0] / (1 - 0.9**it)) / (np.sqrt(s[1] / (1 - 0.99**it)) + 1e-8)
    full = np.zeros((1 << BITS, k))
    full[used] = w
    return Model(langs, full, np.exp(trans[0] - trans[0].max()), np.exp(trans[1] - trans[1].max()))
