"""A small causal self-attention language model over subword ids, in numpy.

Inputs are an id's embedding plus waves that tell its position. Masked softmax attention with query, key and value matrices gathers what stands before;
its output and the input go through a rectified layer, which predicts the next id in two steps: its class, then the id within the class. Both steps are softmaxes
of the same layer, so each id has weights of its own, and a token costs about as many logits as classes and one class's members.

Embeddings and classes come from all training text: how often each id stands beside, and near, groups of other ids (its profile),
rotated by SVD and clustered. Each id that occurs has an embedding of its own; it stays fixed while the other weights learn. Ids that never occur
share the probability that Good and Turing's rule leaves to them, evenly.
"""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np

WIDTH = 32
HIDDEN = 47
#: Inputs to a window, and how many of a later window's tokens are scored: the others are context.
WINDOW, STRIDE = 32, 28
#: Ids that are classes of their own; other classes, at most; members of a class, at most.
SINGLE, CLUSTERS, MEMBERS = 16, 48, 512
#: Groups that a profile counts: frequent ids are groups of their own, the others are gathered by hash. Relations: before, after, near.
TOP, GROUPS = 40, 64
NEAR = (2, 3, 5, 8, 12)
#: Windows whose neighbours are counted at once, so that their arrays stay small.
PROFILED = 4096
_NAMES = ("Q", "K", "V", "M", "m", "U", "T")
_LEAST = 1e-9


@cache
def keep_memory() -> None:
    """Have this process keep up to 128 MB that it frees, where the C library can be told so: by default each batch's arrays go back to the
    system and come again as fresh pages, whose faults cost about as much as the arithmetic."""
    try:
        tell = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):  # another C library
        return
    for option, size in ((-3, 32 << 20), (-1, 128 << 20), (-2, 16 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_TOP_PAD
        tell(option, size)


def _waves() -> np.ndarray:
    """A vector for each position: sines and cosines of rising wave length."""
    angle = np.arange(WINDOW)[:, None] / 64 ** (np.arange(WIDTH // 2) / (WIDTH // 2))
    return (0.3 * np.concatenate([np.sin(angle), np.cos(angle)], 1)).astype(np.float32)


class Ranks:
    """Ids that occur, by falling frequency, and the group of each id in profiles. The id behind all others is the start."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.start = n
        counts = counts if counts.sum() else np.ones(n)
        order = np.lexsort((np.arange(n), -counts))
        self.ids = order[: np.count_nonzero(counts)]
        self.counts = counts[self.ids].astype(float)
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[self.ids] = np.arange(len(self.ids))
        self.group = TOP + (np.arange(n + 1) * 2654435761 % (1 << 32) >> 8) % (GROUPS - TOP)
        self.group[self.ids[:TOP]] = np.arange(min(TOP, len(self.ids)))

    def profile(self, windows: np.ndarray) -> np.ndarray:
        """Of windows of ids (-1: none): for each rank, relation and group, how often. Flat."""
        n = len(self.ids)
        out = np.zeros((3, (n + 1) * (GROUPS + 1)), np.int64)
        # Pads, and ids without a rank, count in a row and a column behind the others, which are left out. An id of -1 takes the last place.
        row, column = np.append(self.rank, -1), np.append(self.group, GROUPS)
        row = np.where(row < 0, n, row) * (GROUPS + 1)
        for s in range(0, len(windows), PROFILED):
            ids = windows[s : s + PROFILED].T
            own, other = row[ids], column[ids]
            for step in (1, *NEAR):
                for relation, flat in ((0, own[step:] + other[:-step]), (1, own[:-step] + other[step:])):
                    out[relation if step == 1 else 2] += np.bincount(flat.reshape(-1), minlength=out.shape[1])
        return out.reshape(3, n + 1, GROUPS + 1)[:, :n, :GROUPS].transpose(1, 0, 2).reshape(-1)


class Inventory(Ranks):
    """Embeddings, classes and members, from all counts and profiles. The last two ids are end and start."""

    def __init__(self, counts: np.ndarray, profile: np.ndarray | None = None, seed: int = 7):
        super().__init__(counts)
        rng, n = np.random.default_rng(seed), len(self.ids)
        vectors = rng.standard_normal((n, WIDTH)) if profile is None else self._vectors(profile.reshape(n, 3, GROUPS), rng)
        self.embedding = np.zeros((len(counts) + 1, WIDTH), np.float32)
        self.embedding[self.ids] = vectors
        self.embedding[self.start] = self.embedding[self.start - 1]  # a text begins where another ended
        single = min(SINGLE, n)
        clusters = max(1, min(CLUSTERS, int(np.sqrt(n - single)))) if n > single else 0
        of = np.arange(n)
        of[single:] = single + _clusters(vectors[single:], self.counts[single:], clusters, rng)
        # A class with too many members is cut by frequency, so that no token costs more than that.
        order = np.lexsort((np.arange(n), of))
        place = np.arange(n) - np.searchsorted(of[order], of[order])
        key = np.empty(n, np.int64)
        key[order] = of[order] * n + place // MEMBERS
        self.classes, of = np.unique(key, return_inverse=True)
        order = np.lexsort((np.arange(n), of))
        self.sizes = np.bincount(of)
        self.begin = np.cumsum(np.where(self.sizes > 1, self.sizes, 0)) - np.where(self.sizes > 1, self.sizes, 0)
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(n) - np.searchsorted(of[order], of[order])
        total = np.bincount(of, self.counts)
        self.prior = np.log(total / total.sum()).astype(np.float32)
        within = (self.sizes > 1)[of]
        self.within = np.empty(int(within.sum()), np.float32)
        self.within[self.begin[of[within]] + slot[within]] = np.log(self.counts / total[of])[within]
        self.of, self.slot = np.full(len(counts) + 1, -1, np.int64), np.zeros(len(counts) + 1, np.int64)
        self.of[self.ids], self.slot[self.ids] = of, slot
        unseen = len(counts) - n
        share = min(0.5, (np.count_nonzero(self.counts == 1) + 1) / (self.counts.sum() + 2)) if unseen else 0.0
        self.seen_log, self.unseen_log = np.float32(np.log1p(-share)), np.float32(np.log(max(share, 1e-30) / max(1, unseen)))

    def _vectors(self, profile: np.ndarray, rng) -> np.ndarray:
        """Square roots of smoothed shares, rotated to their leading directions, each direction of size 1 over all text."""
        parts = []
        for k in range(3):
            own = profile[:, k].astype(float)
            mean = own.sum(0) / max(own.sum(), 1)
            parts.append(np.sqrt((own + 5 * mean) / (own.sum(1, keepdims=True) + 5)) - np.sqrt(mean))
        whole = np.hstack(parts)
        weighed = whole * np.sqrt(self.counts)[:, None]
        turn = np.linalg.svd(weighed.T @ weighed)[0][:, :WIDTH]
        out = whole @ turn
        size = np.sqrt((self.counts[:, None] * out**2).sum(0) / self.counts.sum())
        return out / np.where(size > 1e-6, size, 1) + 1e-3 * rng.standard_normal(out.shape)


def _clusters(vectors: np.ndarray, counts: np.ndarray, k: int, rng, rounds: int = 15) -> np.ndarray:
    """k-means, weighed by counts."""
    if not len(vectors):
        return np.empty(0, np.int64)
    centres = vectors[rng.choice(len(vectors), k, replace=False, p=counts / counts.sum())]
    for turn in range(rounds + 1):
        of = ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)
        if turn < rounds:
            total = np.bincount(of, counts, minlength=k)
            mean = np.stack([np.bincount(of, counts * v, minlength=k) for v in vectors.T], 1) / np.maximum(total, _LEAST)[:, None]
            centres = np.where(total[:, None] > 0, mean, centres)
    return of


_POSITIONS = _waves()


def initial(inventory: Inventory, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights under which every prediction is the frequency over all text."""
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"Q": normal(0.05, WIDTH, WIDTH), "K": normal(0.05, WIDTH, WIDTH), "V": np.eye(WIDTH, dtype=np.float32)}
    p |= {"M": normal((2 * WIDTH) ** -0.5, 2 * WIDTH, HIDDEN), "m": np.zeros(HIDDEN, np.float32)}
    p |= {"U": np.zeros((len(inventory.prior), HIDDEN + 1), np.float32), "T": np.zeros((len(inventory.within), HIDDEN + 1), np.float32)}
    p["U"][:, -1], p["T"][:, -1] = inventory.prior, inventory.within
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in _NAMES]).astype(np.float32)


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in _NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums of rows, by a product, which is faster than a reduction of short rows."""
    return a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)


def _attend(p: dict[str, np.ndarray], inventory: Inventory, inputs: np.ndarray, last: int) -> tuple[np.ndarray, ...]:
    """Embedded inputs, and for the last positions of each window what attention weighs, and beside the position itself what it sees.

    Queries times keys are inputs times Q K' times inputs, so that the inputs are multiplied once; values are taken by _whole().
    """
    n, w = inputs.shape
    kind = p["Q"].dtype
    x = inventory.embedding[inputs]
    x += _POSITIONS[:w].astype(kind, copy=False)
    own = np.ascontiguousarray(x[:, w - last :])
    asked = (own.reshape(-1, WIDTH) @ (p["Q"] @ p["K"].T * kind.type(WIDTH**-0.5))).reshape(own.shape)
    weight = asked @ x.transpose(0, 2, 1)
    np.clip(weight, -30, 30, out=weight)
    np.exp(weight, out=weight)
    weight *= np.tri(last, w, w - last, dtype=kind)  # a position sees itself and what stands before it
    weight *= (1 / _sums(weight)).reshape(n, last, 1)
    both = np.empty((n, last, 2 * WIDTH), kind)
    both[:, :, :WIDTH] = own
    np.matmul(weight, x, out=both[:, :, WIDTH:])
    return x, weight, both.reshape(-1, 2 * WIDTH)


def _whole(p: dict[str, np.ndarray]) -> np.ndarray:
    """What the layer multiplies by: for the position itself M's first half, for the inputs that attention sees V times the second."""
    return np.concatenate([p["M"][:WIDTH], p["V"] @ p["M"][WIDTH:]])


def _layer(p: dict[str, np.ndarray], both: np.ndarray) -> np.ndarray:
    """The rectified layer, and a one in its last column."""
    whole, bias = np.zeros((2 * WIDTH, HIDDEN + 1), both.dtype), np.ones(HIDDEN + 1, both.dtype)
    whole[:, :-1], bias[:-1] = _whole(p), p["m"]
    out = both @ whole
    out += bias
    return np.maximum(out, 0, out=out)


def _by_class(inventory: Inventory, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows that have a class, sorted by it, and (class, start, end) of each run whose class has several members."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    order = order[np.count_nonzero(classes < 0) :]
    held, edges = np.unique(classes[order], return_index=True)
    ends = np.append(edges[1:], len(order))[: len(held)]
    return order, [(c, s, e) for c, s, e in zip(held.tolist(), edges.tolist(), ends.tolist(), strict=True) if inventory.sizes[c] > 1]


class _Members:
    """The members' logits of rows sorted by class, one row's after another's, so that what is done to all of them is done at once."""

    def __init__(self, p: dict[str, np.ndarray], inventory: Inventory, layer: np.ndarray, classes: np.ndarray, slots: np.ndarray, runs: list[tuple[int, int, int]]):
        size = inventory.sizes[classes]
        self.rows = np.flatnonzero(size > 1)
        self.size = size[self.rows]
        ends = np.cumsum(self.size)
        self.starts = ends - self.size
        self.flat = np.empty(int(ends[-1]) if len(ends) else 0, layer.dtype)
        self.parts, at = [], 0
        for c, s, e in runs:
            span, n = slice(inventory.begin[c], inventory.begin[c] + inventory.sizes[c]), (e - s) * inventory.sizes[c]
            own = self.flat[at : at + n].reshape(e - s, -1)
            np.matmul(layer[s:e], p["T"][span].T, out=own)
            self.parts.append((slice(s, e), span, own))
            at += n
        np.clip(self.flat, -60, 60, out=self.flat)
        self.at = self.starts + slots[self.rows]
        self.chosen = self.flat[self.at]
        np.exp(self.flat, out=self.flat)
        self.sums = np.add.reduceat(self.flat, self.starts) if len(ends) else np.empty(0, layer.dtype)


def log_probabilities(p: dict[str, np.ndarray], inventory: Inventory, inputs: np.ndarray, targets: np.ndarray, last: int) -> np.ndarray:
    """Natural logarithms of the probabilities of the last targets of each window."""
    flat = targets[:, -last:].reshape(-1)
    order, runs = _by_class(inventory, inventory.of[flat])
    layer = _layer(p, _attend(p, inventory, inputs, last)[-1][order])
    classes, slots = inventory.of[flat[order]], inventory.slot[flat[order]]
    logits = layer @ p["U"].T
    np.clip(logits, -60, 60, out=logits)
    found = logits[np.arange(len(order)), classes]
    np.exp(logits, out=logits)
    sums = _sums(logits)
    members = _Members(p, inventory, layer, classes, slots, runs)
    found[members.rows] += members.chosen
    sums[members.rows] *= members.sums
    out = np.full(len(flat), inventory.unseen_log, found.dtype)
    out[order] = found - np.log(sums) + inventory.seen_log
    return out.reshape(-1, last)


def gradients(p: dict[str, np.ndarray], inventory: Inventory, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over a batch of windows, and its gradients. Targets occur in training text, or are -1: what pads a window's end has no loss."""
    n, w = inputs.shape
    flat = targets.reshape(-1)
    order, runs = _by_class(inventory, np.where(flat < 0, -1, inventory.of[flat]))
    x, weight, whole = _attend(p, inventory, np.where(inputs < 0, inventory.start, inputs), w)
    kind, total = p["Q"].dtype.type, len(order)
    both = whole[order]
    layer = _layer(p, both)
    classes, slots, rows = inventory.of[flat[order]], inventory.slot[flat[order]], np.arange(total)
    logits = layer @ p["U"].T
    np.clip(logits, -60, 60, out=logits)
    loss = -float(logits[rows, classes].sum(dtype=np.float64))
    np.exp(logits, out=logits)
    sums = _sums(logits)
    loss += float(np.log(sums).sum(dtype=np.float64))
    logits *= (1 / (sums * kind(total)))[:, None]
    logits[rows, classes] -= kind(1 / total)
    g = {"U": logits.T @ layer, "T": np.zeros_like(p["T"])}
    dlayer = logits @ p["U"]
    members = _Members(p, inventory, layer, classes, slots, runs)
    loss += float(np.log(members.sums).sum(dtype=np.float64) - members.chosen.sum(dtype=np.float64))
    members.flat *= np.repeat(1 / (members.sums * kind(total)), members.size)
    members.flat[members.at] -= kind(1 / total)
    for some, span, own in members.parts:
        g["T"][span] = own.T @ layer[some]
        dlayer[some] += own @ p["T"][span]
    dlayer *= layer > 0
    gathered = both.T @ dlayer
    dsaw, second = gathered[WIDTH:, :-1], p["M"][WIDTH:]
    g["M"], g["m"], g["V"] = np.concatenate([gathered[:WIDTH, :-1], p["V"].T @ dsaw]), dlayer.sum(0)[:-1], dsaw @ second.T
    # What attention saw: its gradient goes back to the windows. Embeddings and positions stay as they are.
    dseen = np.zeros((n * w, WIDTH), whole.dtype)
    dseen[order] = dlayer[:, :-1] @ (p["V"] @ second).T
    dseen = dseen.reshape(x.shape)
    dscore = dseen @ x.transpose(0, 2, 1)
    dscore -= _sums(dscore * weight).reshape(n, w, 1)
    dscore *= weight
    between = x.reshape(-1, WIDTH).T @ (dscore @ x).reshape(-1, WIDTH) * kind(WIDTH**-0.5)
    g["Q"], g["K"] = between @ p["K"], between.T @ p["Q"]
    return loss / total, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        """In place; the gradients are used up."""
        self.t += 1
        rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k in p:
            m, v, d = self.m[k], self.v[k], g[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            d *= d
            d *= np.float32(0.01)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= rate
            p[k] -= d


def score_sequences(p: dict[str, np.ndarray], inventory: Inventory, flat: np.ndarray, ends: np.ndarray, batch: int = 256) -> np.ndarray:
    """Log probability of every token of sequences that stand one after another (each ends where ends says), each token once.

    A sequence's first window scores all its tokens, each later one its last STRIDE: they have at least WINDOW - STRIDE tokens of context.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    length = ends - starts
    out = np.empty(len(flat), np.float32)
    # Inputs are the tokens moved by one, with a start before each sequence.
    moved = np.empty(len(flat), np.int64)
    moved[1:] = flat[:-1]
    moved[starts[length > 0]] = inventory.start
    more = np.maximum(0, -(-(length - WINDOW) // STRIDE))
    of = np.repeat(np.arange(len(ends)), more)
    place = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
    first = np.flatnonzero(length > 0)
    for sequence, begin, last in ((first, starts[first], WINDOW), (of, starts[of] + (place + 1) * STRIDE, STRIDE)):
        for s in range(0, len(sequence), batch):
            index = begin[s : s + batch, None] + np.arange(WINDOW)
            end = ends[sequence[s : s + batch], None]
            valid = index < end
            index = np.minimum(index, end - 1)
            found = log_probabilities(p, inventory, moved[index], flat[index], last)
            take = valid[:, -last:]
            out[index[:, -last:][take]] = found[take]
    return out
