"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (words of the training sample; others share one) beside the mean embedding of its
hashed character n-grams. The network reads overlapping windows of words; attention pools its states into a window's
logit, the highest logit of a document is calibrated to its score. All weights start at random. The labels are of
documents, so training picks the windows itself: in each phase those that the network so far finds strongest, from a falling
share of each toxic document's, against random and the strongest ones of the others. The rows are dealt to folds by their text.
Each fold's rows are judged by a network that learnt from the others alone: the phase that ranks them best on average is the
one kept of the network that learnt from all rows, and its scores are calibrated on all these judgements.

Training reads at most about `train_rows` labelled rows of each class, chosen by a hash of doc_id; training, calibration and
scoring read every window of every whole text. Null and empty texts and texts without a word get the calibrated score of no
evidence (the share of toxic rows), and are never dropped. Without rows of both labels that share is every score.
Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import NOT_ALNUM, PIECE, Words, discard, materialise, mix, sampled, slices, split_words
from dealspark.llm.langid import is_held_out

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
CHAR_ORDERS, CHAR_BUCKETS = (3, 5), 1 << 14
#: N-grams that are hashed or added up at once.
GRAMS = 1 << 16
#: Training: phases of so many steps; share of words hidden in a step; weight decay of embeddings.
PHASES, STEPS, HIDE, DECAY = 6, 80, 0.3, 2.0
FOLDS = 3
THRESHOLD = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


@dataclass
class Model:
    words: np.ndarray
    params: dict[str, np.ndarray]
    base: float
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = False
    moments: dict = field(default_factory=dict, repr=False)


@dataclass
class Vocabulary:
    """Distinct words of a slice: the model's word number (0: unknown) and the n-gram buckets of each."""

    ids: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = words.hashes()
    uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return uniq, at, inverse.astype(np.int32)


def _read(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts into words, some texts at once: the different words' bytes, the number of words of each text, and as `_distinct`
    of all words: hashes, places among those bytes, and numbers of all words in turn."""
    sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    # hashes seen so far in order, and how many came before each
    seen, before = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    counts, numbers, size = [np.zeros(0, np.int64)], [before], 0
    data, starts, ends = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _runs(sizes, 4 * PIECE):
        words = split_words(pc.utf8_lower(pa.array(texts[a:b], pa.large_string())), NOT_ALNUM)
        counts.append(np.diff(words.first))
        uniq, at, inverse = _distinct(words)
        slot = np.searchsorted(seen, uniq)
        new = slot == len(seen)
        new[~new] = seen[slot[~new]] != uniq[~new]
        at, slot = at[new], slot[new]
        lengths = words.ends[at] - words.starts[at]
        last = np.cumsum(lengths)
        data.append(words.data[np.repeat(words.starts[at] - last + lengths, lengths) + np.arange(lengths.sum())])
        starts.append(size + last - lengths)
        ends.append(size + last)
        size += int(lengths.sum())
        before = np.insert(before, slot, np.arange(len(seen), len(seen) + len(slot), dtype=np.int32))
        seen = np.insert(seen, slot, uniq[new])
        numbers.append(before[np.searchsorted(seen, uniq)][inverse])
    pa.default_memory_pool().release_unused()
    place = np.empty(len(seen), np.int32)
    place[before] = np.arange(len(seen), dtype=np.int32)
    inverse = np.concatenate(numbers)
    numbers.clear()
    distinct = Words(np.concatenate(data), np.concatenate(starts), np.concatenate(ends), np.arange(len(seen) + 1))
    return distinct, np.concatenate(counts), seen, before, place[inverse]


def _vocabulary(words: Words, uniq: np.ndarray, at: np.ndarray, known: np.ndarray) -> Vocabulary:
    starts, lengths = words.starts[at], words.ends[at] - words.starts[at]
    ends, grams, counts = np.cumsum(lengths + 2), [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
    for a, b in _runs(ends, GRAMS):
        found, n = _grams(words.data, starts[a:b], lengths[a:b])
        grams.append(found)
        counts.append(n)
    ids = np.zeros(len(uniq), np.int64)
    if len(known):
        slot = np.minimum(np.searchsorted(known, uniq), len(known) - 1)
        ids = np.where(known[slot] == uniq, slot + 1, 0)
    return Vocabulary(ids, np.concatenate(grams), np.cumsum(np.concatenate(counts)))


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours, by the places where they end, no longer than `most` in all; one that is longer is a run of its own."""
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of words one after another, and how many each has."""
    size = lengths + 2
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(lengths)), size)
    inside = np.arange(size.sum()) - first[owner]
    # bytes of every word between two zero bytes
    letter = (inside > 0) & (inside < size[owner] - 1)
    chars = np.zeros(len(owner), np.uint64)
    chars[letter] = data[starts[owner[letter]] + inside[letter] - 1].astype(np.uint64) + np.uint64(1)
    grams, of = [], []
    for order in CHAR_ORDERS:
        # a word shorter than the order is one n-gram
        at = np.flatnonzero(inside <= np.maximum(0, size[owner] - order))
        h = np.full(len(at), order, np.uint64)
        for j in range(order):
            h = h * np.uint64(0x100000001B3) + np.where(inside[at] + j < size[owner[at]], chars[np.minimum(at + j, len(chars) - 1)], 0).astype(np.uint64)
        grams.append(((mix(h) >> np.uint64(40)) % np.uint64(CHAR_BUCKETS)).astype(np.uint16))
        of.append(owner[at])
    word = np.concatenate(of)
    return np.concatenate(grams)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


def _windows(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of the rows: row, first word, length."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = nth * STRIDE
    return row, first[row] + start, np.minimum(WINDOW, counts[row] - start)


def _char_means(p: dict, v: Vocabulary) -> np.ndarray:
    out = np.zeros((len(v.ids), CHAR_DIM), np.float32)
    for a, b in _runs(v.first[1:], GRAMS):
        lo, hi = v.first[a], v.first[b]
        out[a:b] = np.add.reduceat(p["chars"][v.grams[lo:hi]], v.first[a:b] - lo, axis=0) / np.diff(v.first[a : b + 1])[:, None].astype(np.float32)
    return out


def _gru(inputs: np.ndarray, mask: np.ndarray, u: np.ndarray, b: np.ndarray, order, keep: list | None, idx: np.ndarray | None = None) -> np.ndarray:
    steps, size = mask.shape[:2]
    h = np.zeros((size, HIDDEN), np.float32)
    out = np.empty((steps, size, HIDDEN), np.float32)
    for t in order:
        a = h @ u
        x = inputs[t] if idx is None else inputs[idx[t]]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        hn = a[:, 2 * HIDDEN :] + b
        n = _tanh(x[:, 2 * HIDDEN :] + r * hn)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((t, h, z, r, n, hn))
        h = np.where(mask[t], new, h)
        out[t] = h
    return out


def _forward(p: dict, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None, idx: np.ndarray | None = None) -> np.ndarray:
    """projected: steps x windows x 6*HIDDEN, or words x 6*HIDDEN with idx, steps x windows of word numbers; mask: steps x windows x 1.
    Returns the windows' logits."""
    steps = len(mask)
    ahead, back = ([], []) if keep is not None else (None, None)
    hf = _gru(projected[..., : 3 * HIDDEN], mask, p["uf"], p["bf"], range(steps), ahead, idx)
    hb = _gru(projected[..., 3 * HIDDEN :], mask, p["ub"], p["bb"], reversed(range(steps)), back, idx)
    h = np.concatenate([hf, hb], axis=2)
    e = _tanh(h @ p["wa"] + p["ba"])
    s = np.where(mask[..., 0], e @ p["va"], -1e9)
    w = np.exp(s - s.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (w[..., None] * h).sum(axis=0)
    if keep is not None:
        keep |= {"ahead": ahead, "back": back, "h": h, "e": e, "w": w, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"][0]


def _gru_back(dout: np.ndarray, mask: np.ndarray, steps: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dx = np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32)
    du, db = np.zeros_like(u), np.zeros(HIDDEN, np.float32)
    dh = np.zeros(dout.shape[1:], np.float32)
    for t, h, z, r, n, hn in reversed(steps):
        total = dh + dout[t]
        new = total * mask[t]
        dan = new * (1 - z) * (1 - n * n)
        daz = new * (h - n) * z * (1 - z)
        dar = dan * hn * r * (1 - r)
        dhn = dan * r
        da = np.concatenate([daz, dar, dhn], axis=1)
        dx[t] = np.concatenate([daz, dar, dan], axis=1)
        du += h.T @ da
        db += dhn.sum(axis=0)
        dh = total - new + new * z + da @ u.T
    return dx, du, db


def _gradients(p: dict, vocab: Vocabulary, ids: np.ndarray, idx: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """idx: steps x windows of distinct-word numbers; ids: the same of model words (some hidden)."""
    here, idx = np.unique(idx, return_inverse=True)
    idx = idx.reshape(ids.shape)
    size = np.diff(vocab.first)[here]
    first = np.concatenate([[0], np.cumsum(size)])
    vocab = Vocabulary(vocab.ids[here], vocab.grams[np.repeat(vocab.first[here] - first[:-1], size) + np.arange(first[-1])], first)
    chars = _char_means(p, vocab)
    x = np.concatenate([p["words"][ids], chars[idx]], axis=2)
    keep: dict = {}
    logit = _forward(p, x @ p["wx"] + p["bx"], mask, keep)
    dlogit = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    g = {"wo": keep["pooled"].T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["wo"][None]
    w, h, e = keep["w"], keep["h"], keep["e"]
    dw = (h * dpooled[None]).sum(axis=2)
    ds = w * (dw - (w * dw).sum(axis=0))
    de = ds[..., None] * p["va"] * (1 - e * e)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g |= {"va": flat(e).T @ ds.reshape(-1), "wa": flat(h).T @ flat(de), "ba": flat(de).sum(axis=0)}
    dh = w[..., None] * dpooled[None] + de @ p["wa"].T
    df, g["uf"], g["bf"] = _gru_back(dh[..., :HIDDEN], mask, keep["ahead"], p["uf"])
    db, g["ub"], g["bb"] = _gru_back(dh[..., HIDDEN:], mask, keep["back"], p["ub"])
    dproj = np.concatenate([df, db], axis=2)
    g |= {"wx": flat(x).T @ flat(dproj), "bx": flat(dproj).sum(axis=0)}
    dx = flat(dproj @ p["wx"].T)
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], ids.reshape(-1), dx[:, :WORD_DIM])
    g["words"][0] = 0
    dchars = np.zeros_like(chars)
    np.add.at(dchars, idx.reshape(-1), dx[:, WORD_DIM:])
    used = np.flatnonzero(np.abs(dchars).sum(axis=1))
    lengths = np.diff(vocab.first)[used]
    pos = np.repeat(vocab.first[:-1][used] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], vocab.grams[pos], np.repeat(dchars[used] / lengths[:, None], lengths, axis=0))
    return g


def _adam(m: Model, g: dict[str, np.ndarray], step: int, rate: float) -> None:
    for k, d in g.items():
        if k in ("words", "chars"):
            m.params[k] *= np.float32(1 - rate * DECAY)  # what few documents say fades
        a, b = m.moments.setdefault(k, [np.zeros_like(d), np.zeros_like(d)])
        a += 0.1 * (d - a)
        b += 0.001 * (d * d - b)
        m.params[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _logits(m: Model, chars_and_words: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Logits of windows; chars_and_words: the projected input of each distinct word."""
    out = np.empty(len(start), np.float32)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), chunk):
        some = order[at : at + chunk]
        steps = int(length[some].max())
        t = np.arange(steps)[:, None]
        mask = t < length[some][None]
        idx = inverse[np.minimum(start[some][None] + t, len(inverse) - 1)]
        out[some] = _forward(m.params, chars_and_words, mask[..., None], idx=idx)
    return out


def _projected(m: Model, v: Vocabulary) -> np.ndarray:
    both = np.empty((len(v.ids), WORD_DIM + CHAR_DIM), np.float32)
    both[:, :WORD_DIM] = m.params["words"][v.ids]
    both[:, WORD_DIM:] = _char_means(m.params, v)
    out = both @ m.params["wx"]
    out += m.params["bx"]
    return out


@dataclass
class Trained:
    """A network after each phase. `fold`: the fold it hasn't read (FOLDS: none); `rows`: rows judged, by number: those of the
    fold or all; `tops`: their highest logits."""

    fold: int
    words: np.ndarray
    rows: np.ndarray
    params: list[dict[str, np.ndarray]] = field(default_factory=list, repr=False)
    tops: list[np.ndarray] = field(default_factory=list, repr=False)


def _folds(texts: list[str], y: np.ndarray, seed: int) -> np.ndarray:
    """Each row's fold; equal texts share one, and each label's texts are dealt out evenly."""
    _, first, same = np.unique(np.array(texts, object), return_index=True, return_inverse=True)
    order = np.random.default_rng(seed).permutation(len(first))
    order = order[np.argsort(-y[first[order]], kind="stable")]
    fold = np.empty(len(first), np.int64)
    fold[order] = np.arange(len(first)) % FOLDS
    return fold[same]


def learn(texts: list[str], labels: np.ndarray, fold: int = FOLDS, steps: int = STEPS, batch: int = 128, seed: int = 17, nets: bool = True) -> Trained:
    """Trains on the rows outside the fold; steps: of each phase; nets: whether to keep the network after each phase."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
    words, counts, uniq, at, inverse = _read(texts)
    y = labels.astype(np.float32)
    first = np.cumsum(counts) - counts
    row, start, length = _windows(counts, first)
    n_windows = np.bincount(row, minlength=len(y))
    aside = _folds(texts, y, seed) == fold
    # words of three of the documents to learn from or more have an embedding
    n_docs = np.zeros(len(uniq), np.int64)
    for i in np.flatnonzero(~aside & (counts > 0)).tolist():
        n_docs[np.unique(inverse[first[i] : first[i] + counts[i]])] += 1
    pick = np.flatnonzero(n_docs >= 3)
    dims = WORD_DIM + CHAR_DIM
    params = {
        "words": normal(len(pick) + 1, WORD_DIM, by=0.05), "chars": normal(CHAR_BUCKETS, CHAR_DIM, by=0.05), "wx": normal(dims, 6 * HIDDEN, by=dims**-0.5), "bx": np.zeros(6 * HIDDEN, np.float32),
        "uf": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "ub": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "bf": np.zeros(HIDDEN, np.float32), "bb": np.zeros(HIDDEN, np.float32),
        "wa": normal(2 * HIDDEN, ATTENTION, by=0.35), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION, by=0.35), "wo": normal(2 * HIDDEN, by=0.35), "bo": np.zeros(1, np.float32),
    }
    params["words"][0] = 0
    m = Model(uniq[pick], params, 0.0)
    done = Trained(fold, m.words, np.flatnonzero(aside if fold < FOLDS else ~aside))
    toxic, clean = (np.flatnonzero((y == label) & (n_windows > 0) & ~aside) for label in (1, 0))
    if not (len(toxic) and len(clean)):
        return done
    vocab = _vocabulary(words, uniq, at, m.words)
    del words, at
    lo = np.cumsum(n_windows) - n_windows
    score = rng.random(len(start))
    for phase in range(PHASES):
        order = np.lexsort((-score, row))  # each document's windows, the strongest first
        reach = np.ceil(n_windows * (0.5**phase if phase < PHASES - 1 else 0)).clip(1)
        for step in range(phase * steps + 1, (phase + 1) * steps + 1):
            t, c = rng.choice(toxic, batch // 2), rng.choice(clean, batch // 2)
            width = np.concatenate([reach[t], np.where(rng.random(len(c)) < 0.5, 1, n_windows[c])])
            some = order[lo[np.concatenate([t, c])] + (rng.random(len(width)) * width).astype(np.int64)]
            nth = np.arange(int(length[some].max()))[:, None]
            idx = inverse[np.minimum(start[some][None] + nth, len(inverse) - 1)]
            ids = np.where(rng.random(idx.shape) < HIDE, 0, vocab.ids[idx])
            g = _gradients(m.params, vocab, ids, idx, (nth < length[some][None])[..., None], y[row[some]], np.ones(len(some), np.float32))
            _adam(m, g, step, 0.01 * min(1.0, 2.35 - 2.25 * step / (PHASES * steps)))
        score = _logits(m, _projected(m, vocab), inverse, start, length).astype(np.float64)
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, row, score)
        if nets:
            done.params.append({k: v.copy() for k, v in m.params.items()})
        done.tops.append(top[done.rows])
    return done


def _rank(top: np.ndarray, y: np.ndarray) -> float:
    """How often a toxic row's logit is above a clean one's; NaN without rows of both."""
    p, n = (np.sort(top[(y == label) & np.isfinite(top)]) for label in (1, 0))
    if not (len(p) and len(n)):
        return np.nan
    return float((np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).mean() / 2 / len(n))


def combine(parts: list[Trained], labels: np.ndarray, base: float, after: Callable[[int], dict[str, np.ndarray]] | None = None) -> Model:
    """The network of all rows, with the phase and the calibration that the folds' judgements give. Without such judgements of
    toxic and of clean rows its own judgements take their place. base: the share of toxic rows among all labelled ones; after:
    gives that network's weights after a phase, where the parts don't hold them."""
    y = labels.astype(np.float64)
    whole = next(p for p in parts if p.fold == FOLDS)
    m = Model(whole.words, {}, base)
    if not whole.tops:
        return m
    judged = [p for p in parts if p.fold < FOLDS and p.tops and np.isfinite(_rank(p.tops[0], y[p.rows]))] or [whole]
    ranks = np.array([np.mean([_rank(p.tops[k], y[p.rows]) for p in judged]) for k in range(len(whole.tops))])
    phase = len(ranks) - 1 - int(np.argmax(ranks[::-1])) if np.isfinite(ranks).all() else len(ranks) - 1
    top, known = np.concatenate([p.tops[phase] for p in judged]), np.concatenate([y[p.rows] for p in judged])
    use = np.isfinite(top)
    m.params, m.trained = after(phase) if after else whole.params[phase], True
    m.slope, m.shift = _calibrate(top[use], known[use], base)
    return m


def fit(texts: list[str], labels: np.ndarray, base: float, steps: int = STEPS, batch: int = 128, seed: int = 17) -> Model:
    """All of the training in one process."""
    return combine([learn(texts, labels, fold, steps, batch, seed) for fold in range(FOLDS + 1)], labels, base)


def _calibrate(x: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """Logistic regression of the label on the highest logit, weighted to the share of toxic rows."""
    weight = np.where(y > 0, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(np.clip(a * x + b, -30, 30))
        r, s = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(r * x).sum() + 0.5 * (a - 1), r.sum()])
        hess = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.05, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def score_slice(m: Model, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts: the calibrated highest window."""
    out = np.full(len(texts), m.base)
    if not m.trained:
        return out
    words = split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_ALNUM)
    if len(words.starts):
        uniq, at, inverse = _distinct(words)
        row, start, length = _windows(np.diff(words.first), words.first[:-1])
        logit = _logits(m, _projected(m, _vocabulary(words, uniq, at, m.words)), inverse, start, length)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, row, logit)
        has = np.isfinite(top)
        out[has] = _sigmoid(np.clip(m.slope * top[has] + m.shift, -30, 30))
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 2000) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows with a null label or text are left out."""
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, train_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, train_rows / max(1, sizes.get(0, 0))))
    sample = known.where(sampled(share, "doc_id"))
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        order = pc.sort_indices(table, [("fold", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).to_pylist()
        fold, y, all_texts = table["fold"].to_numpy(), table["toxic"].to_numpy(), table["text"].to_pylist()
        del held, table  # the texts of a task are held once
        for k in np.unique(fold).tolist():
            at = [i for i in order if fold[i] == k]
            done = learn([all_texts[i] for i in at], y[at], k, nets=k == FOLDS)
            nets, done.params = done.params, []
            if k < FOLDS:  # of a fold's network only the judgements count
                done.words = done.words[:0]
            for phase, part in enumerate([(done, y[at]), *nets], -1):
                yield pa.RecordBatch.from_arrays([pa.array([phase], pa.int32()), pa.array([pickle.dumps(part)], pa.binary())], names=["phase", "part"])

    # one task a fold trains on the bounded sample, about train_rows rows of each class; the networks stay in the shared folder, and the
    # driver gets the judgements and then the weights of the one phase that they choose
    dealt = rows.withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS + 1))))).repartitionById(FOLDS + 1, "fold")
    trained = materialise(dealt.mapInArrow(run, "phase int, part binary"))
    found = [pickle.loads(r["part"]) for r in trained.where("phase < 0").collect()]
    after = lambda phase: pickle.loads(trained.where(F.col("phase") == phase).first()["part"])
    model = combine([p for p, _ in found], found[0][1], base, after) if found else Model(np.zeros(0, np.uint64), {}, base)
    discard(trained)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the two named columns to the kept columns of docs (text among its columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([*keep, "text"]))
    fields = [f for f in docs.select(*keep).schema.fields]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names[0]}` double, `{names[1]}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            value = score_slice(shared.value, batch.column("text"))
            kept = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=[*keep, *names])

    return docs.select(*read).mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, and those without a word; columns unchanged."""
    names = {c: f"keep_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("text", *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    judged = score(rows, model, ["text", *names.values()])
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    return judged.where((F.col("predicted") == 0) | ~worded).select(*[F.col(a).alias(c) for c, a in names.items()])


def op9(docs: DataFrame, labels: DataFrame, train_rows: int = 2000) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(is_held_out("doc_id", 4, 2), F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~is_held_out("doc_id", 4, 2))
    model = train(rows, known, train_rows)
    return score(rows, model, ["doc_id", "held_out"])
