"""Reading level of each document, on the scale of graded samples.

Method: regularised ordinal regression (proportional odds). A text is cut into sentences, long ones
into stretches of ``UNIT`` words; of each the features are word and sentence length, word rarity,
lexical diversity, connectives, and punctuation and subordinators as a proxy of clause depth. The
regression is fitted to units of the graded texts, at most ``MOST_SAMPLES``, and gives each unit a
level; a text has the level that most of its words stand in. Texts are graded where they lie.
"""

from __future__ import annotations

import numpy as np

from tidewords.llm.language import ends_sentence
from tidewords.llm.tokens import Tokens, word_form

MOST_SAMPLES = 2_000
# What is said or printed between the words of a transcript.
NO_WORDS = frozenset("um uh er erm hmm speaker music laughs applause".split())
UNIT = 24
LEAST_WORDS = 60

# English connectives and subordinators.
CONNECTIVES = frozenset("although because however therefore moreover furthermore nevertheless nonetheless notwithstanding whereas while since unless until though whether hence thus thereby inasmuch insofar albeit consequently meanwhile otherwise instead besides then so but and or when if before after which that who whose whom where rather".split())
SUBORDINATORS = frozenset("although because notwithstanding whereas while since unless until though whether thereby inasmuch insofar albeit when if before after which that who whose whom where lest".split())


class Model:
    """Fitted weights; ``rarity`` is minus the log of a word's share in the graded texts."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, cuts: np.ndarray, levels: list[int], rarity: dict[str, float], unseen: float):
        self.mean, self.scale, self.beta, self.cuts, self.levels, self.rarity, self.unseen = mean, scale, beta, cuts, levels, rarity, unseen

    def columns(self) -> dict:
        return {"shape": lambda tokens: shape(tokens, self.rarity, self.unseen)}

    def grade(self, features: np.ndarray) -> np.ndarray:
        """Index of the likeliest level of each unit."""
        z = ((features - self.mean) / self.scale) @ self.beta
        below = 1 / (1 + np.exp(np.clip(z[:, None] - self.cuts, -50, 50)))
        below = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1)
        return np.diff(below, axis=1).argmax(1)


def shape(tokens: list[str], rarity: dict[str, float], unseen: float) -> np.ndarray:
    """By token: counts as a word, letters, long, very long, rarity, connective, subordinator, inner punctuation."""
    out = np.zeros((len(tokens), 8), np.float32)
    for i, t in enumerate(tokens):
        w = word_form(t)
        if w and not w.isdigit() and t[-1] != ":" and w not in NO_WORDS:
            # a capital inside a sentence is mostly a name, which is rare at every level
            out[i, :7] = 1, len(w), len(w) >= 7, len(w) >= 11, min(rarity.get(w, unseen), unseen), w in CONNECTIVES, w in SUBORDINATORS
        out[i, 7] = t[-1:] in ",;" and bool(w)  # a colon follows a speaker's label
    return out


def units(ends: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Unit number of every token. ends: a sentence ends with this token; lens: tokens of each text."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    starts = (np.cumsum(lens) - lens)[lens > 0]
    new[1:] = ends[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(at, np.diff([*at, n]))
    return np.cumsum(new | (within % UNIT == 0)) - 1


def unit_features(shapes: np.ndarray, unit: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Features of each unit from the rows of its tokens. form: word form ids, -1 for none."""
    n = int(unit[-1]) + 1
    s = np.stack([np.bincount(unit, shapes[:, j], n) for j in range(8)], 1)
    words = np.maximum(s[:, 0], 1)
    real = (form >= 0) & (shapes[:, 0] > 0)
    distinct = np.bincount(np.unique(unit[real] * (1 << 32) + form[real]) >> 32, minlength=n)
    return np.stack([s[:, 1] / words, s[:, 2] / words, s[:, 3] / words, s[:, 4] / words, np.minimum(distinct / words, 1.5), s[:, 5] / words, s[:, 6] / words, s[:, 7] / words, np.log(words)], 1)


def fit(samples: list[tuple[int, str]], *, rounds: int = 400, ridge: float = 0.02) -> Model:
    """Proportional odds with a ridge, by Adam. samples: (level, text). Each text is read twice, as it is and
    without points and capitals, as some transcripts have neither."""
    levels = sorted({lv for lv, _ in samples})
    count: dict[str, int] = {}
    for _, t in samples:
        for w in t.split():
            if f := word_form(w):
                count[f] = count.get(f, 0) + 1
    total = sum(count.values())
    rarity = {w: float(-np.log(c / total)) for w, c in count.items() if c > 2}
    unseen = float(np.log(total / 2))
    texts = [t for _, t in samples]
    texts += [" ".join(w.strip(".,;:!?").lower() for w in t.split()) for t in texts]
    table = Tokens(shape=lambda tk: shape(tk, rarity, unseen), ends=ends_sentence)
    rows, lens = table.encode(texts)
    unit = units(table.column("ends")[rows], lens)
    x = unit_features(table.column("shape")[rows], unit, table.column("form")[rows])
    doc = np.repeat(np.arange(len(texts)), lens)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    y = np.array([levels.index(lv) for lv, _ in samples] * 2)[doc[first]]
    weight = np.bincount(unit) / UNIT
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    beta = np.zeros(x.shape[1])
    raw = np.concatenate([[-1.0], np.zeros(len(levels) - 2)])  # first cut, then logs of the steps
    hot = np.eye(len(levels))[y]
    m = [np.zeros_like(beta), np.zeros_like(raw)]
    v = [np.zeros_like(beta), np.zeros_like(raw)]
    for it in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = x @ beta
        s = 1 / (1 + np.exp(np.clip(z[:, None] - cuts, -40, 40)))
        cum = np.concatenate([np.zeros((len(z), 1)), s, np.ones((len(z), 1))], 1)
        p = np.maximum((np.diff(cum, axis=1) * hot).sum(1), 1e-9)
        d = s * (1 - s)  # derivative of each cumulative probability by its cut
        up = np.concatenate([d, np.zeros((len(z), 1))], 1)
        lo = np.concatenate([np.zeros((len(z), 1)), d], 1)
        g_z = -((up - lo) * hot).sum(1) / p * weight
        g_cut = ((hot[:, :-1] - hot[:, 1:]) * d / p[:, None] * weight[:, None]).sum(0)
        g_raw = np.cumsum(g_cut[::-1])[::-1].copy()
        g_raw[1:] *= np.exp(raw[1:])
        for k, (par, g) in enumerate(((beta, x.T @ g_z / weight.sum() - ridge * beta), (raw, g_raw / weight.sum()))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            par += 0.05 * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.99**it)) + 1e-9)
    return Model(mean, scale, beta, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])), levels, rarity, unseen)


def levels(model: Model, shapes: np.ndarray, ends: np.ndarray, form: np.ndarray, foreign: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Words of each text by level (texts, levels); units of mostly foreign words don't count."""
    out = np.zeros((len(lens), len(model.levels)))
    if not len(ends):
        return out
    unit = units(ends, lens)
    grade = model.grade(unit_features(shapes, unit, form))
    size = np.bincount(unit)
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    doc = np.repeat(np.arange(len(lens)), lens)[first]
    own = np.bincount(unit, foreign) * 2 <= size
    np.add.at(out, (doc[own], grade[own]), size[own])
    return out
