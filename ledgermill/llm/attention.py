"""A small causal self-attention model over subword ids, in numpy.

One layer of one head looks back over a window: windows of ``2 * STRIDE``
positions overlap by half, and the second half of each is scored, so every
position is scored once and sees at least ``STRIDE`` and at most
``2 * STRIDE`` positions. All windows of a run of texts are one batch; a mask
keeps attention causal and within a text.

The next id is predicted in three steps, so that the distribution over all ids
is exact and cheap: the group of its class and the class in its group by the
model, and the id in its class by counts over the corpus. Classes hold
neighbouring ids in order of frequency, about equal mass in each; the most
frequent ids are classes of their own. A group is ``GROUP`` neighbouring classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 16
WIDTH = 16
CLASSES = 256
GROUP = 16  # classes in a group
CHUNK = 128  # windows in one numpy pass
WEIGHTS_A_ROW = 16  # of the table form of a model


@dataclass
class Vocabulary:
    """What the corpus counts of ids give: classes, their inner log-odds, input numbers."""

    classes: np.ndarray  # of each id
    within: np.ndarray  # log10 of each id's share of its class
    inputs: np.ndarray  # of each id: its rank by frequency, so every id has an input row of its own


def vocabulary(counts: np.ndarray, classes: int = CLASSES, inputs: int | None = None) -> Vocabulary:
    """From the count of each id; every id keeps a share, seen or not."""
    counts = counts + 1.0
    order = np.argsort(-counts, kind="stable")
    cls = np.empty(len(counts), np.int64)
    number, mass, rest = 0, 0.0, counts.sum()
    for i in order.tolist():
        cls[i] = number
        mass += counts[i]
        # a class is full with an equal share of what the earlier ones left
        if number < classes - 1 and mass * (classes - number) >= rest:
            number, mass, rest = number + 1, 0.0, rest - mass
    classes = int(cls.max()) + 1
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    total = np.bincount(cls, weights=counts, minlength=classes)
    return Vocabulary(cls, np.log10(counts / total[cls]), np.minimum(rank, (inputs or len(counts)) - 1))


def _start(seed: int, inputs: int, width: int, classes: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    deal = lambda *shape, by=width: rng.normal(0, by**-0.5, shape).astype(np.float32)
    groups = -(-classes // GROUP)
    bias = np.zeros(groups * GROUP, np.float32)
    bias[classes:] = -1e9  # fills the last group; has no probability
    return {
        "embed": deal(inputs, width, by=1), "query": deal(width, width), "key": deal(width, width),
        "value": deal(width, width), "near": np.zeros(2 * STRIDE, np.float32), "own": deal(width, width),
        "out": deal(width, groups * GROUP), "bias": bias,
        "group": deal(width, groups), "group_bias": np.zeros(groups, np.float32),
    }


_QUERY = np.arange(STRIDE)[:, None] + STRIDE
_KEY = np.arange(2 * STRIDE)[None, :]
_BACK = np.clip(_QUERY - _KEY, 0, 2 * STRIDE - 1)
_CAUSAL = _KEY <= _QUERY


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots for texts of so many positions: the slot of each position, the text
    of each slot (-1: none), and the number of slots.

    Every text begins at a multiple of ``STRIDE``, so that what a position sees
    does not depend on the texts beside it.
    """
    room = -(-lengths // STRIDE) * STRIDE
    first = np.cumsum(room) - room
    n = int(lengths.sum())
    slot = np.arange(n) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    text = np.full(int(room.sum()), -1, np.int64)
    text[slot] = np.repeat(np.arange(len(lengths)), lengths)
    return slot, text, room


def _windows(x: np.ndarray, fill) -> np.ndarray:
    """Overlapping windows of a sequence of whole strides, the first half of the first one empty."""
    padded = np.concatenate([np.full(STRIDE, fill, x.dtype), x])
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * STRIDE)[::STRIDE]


def _forward(m: dict, inputs: np.ndarray, text: np.ndarray) -> dict:
    """The plain form of the model for windows and the text number of each position: log odds ``z`` of all classes."""
    x = m["embed"][inputs]
    late = x[:, STRIDE:]
    s = (late @ m["query"]) @ (x @ m["key"]).transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + m["near"][_BACK]
    s = _log_softmax(np.where((text[:, STRIDE:, None] == text[:, None, :]) & _CAUSAL, s, -1e9))
    h = np.tanh(np.exp(s) @ (x @ m["value"]) + late @ m["own"])
    within = h @ m["out"] + m["bias"]
    within = _log_softmax(within.reshape(*h.shape[:2], -1, GROUP))
    z = _log_softmax(h @ m["group"] + m["group_bias"])[..., None] + within
    return {"h": h, "z": z.reshape(*h.shape[:2], -1)}


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def projected(m: dict) -> tuple[np.ndarray, ...]:
    """What ``log10_classes`` reads of each input row; made once for many runs of texts."""
    own = m["embed"] @ _projection(m)
    return tuple(np.ascontiguousarray(own[:, i * WIDTH : (i + 1) * WIDTH]) for i in range(4))


def _projection(m: dict) -> np.ndarray:
    """Query, own, key and value of an input row, one beside the other."""
    scale = m["query"].dtype.type(WIDTH**-0.5)
    return np.concatenate([m["query"] * scale, m["own"], m["key"], m["value"]], axis=1)


def _masks(m: dict) -> np.ndarray:
    """What is added to the scores of a window: causal, and without the first half where a text begins."""
    near = np.where(_CAUSAL, m["near"][_BACK], m["near"].dtype.type(-1e9))
    return np.stack([near, np.where(_KEY < STRIDE, near.dtype.type(-1e9), near)])


def _begins(text: np.ndarray) -> np.ndarray:
    """Whether a text begins at a stride."""
    return np.concatenate([[True], text[::STRIDE][1:] != text[::STRIDE][:-1]]).astype(np.int64)


def _two(x: np.ndarray) -> np.ndarray:
    """Overlapping windows of rows, transposed."""
    return np.lib.stride_tricks.sliding_window_view(x, 2 * STRIDE, axis=0)[::STRIDE]


def _attended(q: np.ndarray, own: np.ndarray, k: np.ndarray, v: np.ndarray, near: np.ndarray) -> tuple:
    """Hidden rows of a stretch, what was mixed into them, and the shares of each window."""
    n = len(near)
    s = q.reshape(n, STRIDE, WIDTH) @ _two(k)
    s += near
    np.exp(s, out=s)
    mixed = s @ _two(v).transpose(0, 2, 1)
    total = s @ np.ones((2 * STRIDE, 1), s.dtype)
    mixed /= total
    h = mixed.reshape(-1, WIDTH) + own
    return np.tanh(h, out=h), mixed, s, total


def _by_group(m: dict, h: np.ndarray, target: np.ndarray) -> tuple:
    """Log odds of all groups, and of the classes in the target's group.

    The latter are in order of group, as are the hidden rows beside them;
    ``order`` gives their positions, ``cuts`` the stretch of each group.
    """
    group = (target // GROUP).astype(np.int16)
    order = np.argsort(group, kind="stable")
    groups = m["group"].shape[1]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))]).tolist()
    z = h @ m["group"]
    z += m["group_bias"]
    rows, inner = h.take(order, 0), np.empty((len(h), GROUP), h.dtype)
    for g in range(groups):
        at = slice(cuts[g], cuts[g + 1])
        if cuts[g] < cuts[g + 1]:
            np.matmul(rows[at], m["out"][:, g * GROUP : (g + 1) * GROUP], out=inner[at])
            inner[at] += m["bias"][g * GROUP : (g + 1) * GROUP]
    return group, order, cuts, z, rows, inner


def log10_classes(m: dict, inputs: np.ndarray, text: np.ndarray, target: np.ndarray, own=None) -> np.ndarray:
    """log10 of the model's probability of the class at each slot.

    ``inputs`` are the numbers read up to each slot, ``text`` tells texts apart;
    ``layout`` makes both, so a window's first half is of its text as a whole or
    not at all, and unused slots come after all others of a text. Keys and
    values are read once per slot and seen through both windows that hold it; a
    pass covers few windows, so that it stays in the cache.
    """
    out = np.empty(len(inputs), np.float32)
    query, own, key, value = own or projected(m)
    near, begins = _masks(m), _begins(text)
    padded = np.concatenate([np.zeros(STRIDE, inputs.dtype), inputs])
    ones = np.ones(GROUP, np.float32)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for a in range(0, len(inputs), CHUNK * STRIDE):
            b = min(a + CHUNK * STRIDE, len(inputs))
            read, seen = inputs[a:b], padded[a : b + STRIDE]
            h, _, _, _ = _attended(
                query.take(read, 0), own.take(read, 0), key.take(seen, 0), value.take(seen, 0),
                near.take(begins[a // STRIDE : b // STRIDE], 0),
            )
            group, order, _, z, _, inner = _by_group(m, h, target[a:b])
            at = np.arange(b - a)
            chosen = z[at, group]
            chosen -= np.log(np.exp(z, out=z).sum(axis=1))
            within = inner[at, (target[a:b] % GROUP).take(order)]
            within -= np.log(np.exp(inner, out=inner) @ ones)
            chosen[order] += within
            out[a:b] = chosen
    out = out.astype(float) / np.log(10)
    if not np.isfinite(out).all():
        raise FloatingPointError("the model's weights are too large for single precision")
    return out


class Learner:
    """Adam over stretches of windows; an input row moves only in the steps that read it."""

    def __init__(self, m: dict, seed: int = 7):
        self.m = {k: v.copy() for k, v in m.items()}
        self.first = {k: np.zeros_like(v) for k, v in m.items()}
        self.second = {k: np.zeros_like(v) for k, v in m.items()}
        self.reads = np.zeros(len(m["embed"]), np.int64)  # of each input row
        self.rng = np.random.default_rng(seed)
        self.step = self.positions = 0

    def learn(self, inputs: np.ndarray, text: np.ndarray, target: np.ndarray, rate, batch: int = 64) -> None:
        """One pass over all windows; a step takes ``batch`` neighbouring ones, the steps come in a seeded order.

        ``rate`` gives the step's size from its number.
        """
        if not len(inputs):
            return
        padded, begins = np.concatenate([np.zeros(STRIDE, inputs.dtype), inputs]), _begins(text)
        for a in (self.rng.permutation(-(-len(begins) // batch)) * batch).tolist():
            at, b = slice(a * STRIDE, (a + batch) * STRIDE), min(a + batch, len(begins))
            if not (target[at] >= 0).any():
                continue
            self.step += 1
            grad, rows, moved = _gradients(self.m, padded[a * STRIDE : (b + 1) * STRIDE], begins[a:b], target[at])
            lr = rate(self.step)
            for k, g in grad.items():
                self._move(k, slice(None), g, lr)
            self._move("embed", rows, moved, lr)
        seen = target >= 0
        self.positions += int(seen.sum())
        self.reads += np.bincount(inputs[seen], minlength=len(self.reads))
        if not all(np.isfinite(v).all() for v in self.m.values()):
            raise FloatingPointError("the model's weights are too large for single precision")

    def _move(self, k: str, at, g: np.ndarray, lr: float) -> None:
        first, second = self.first[k][at], self.second[k][at]
        first += np.float32(0.1) * (g - first)
        second += np.float32(0.01) * (g * g - second)
        if not isinstance(at, slice):
            self.first[k][at], self.second[k][at] = first, second
        size = np.sqrt(second * np.float32(1 / (1 - 0.99**self.step)))
        size += np.float32(1e-8)
        self.m[k][at] -= np.float32(lr / (1 - 0.9**self.step)) * first / size


def table(m: dict) -> np.ndarray:
    """All weights as rows of ``WEIGHTS_A_ROW``: the input rows, then the rest in order of name."""
    rest = np.concatenate([m[k].ravel() for k in sorted(m) if k != "embed"])
    rest = np.concatenate([rest, np.zeros(-len(rest) % WEIGHTS_A_ROW, rest.dtype)])
    return np.concatenate([m["embed"].reshape(-1, WEIGHTS_A_ROW), rest.reshape(-1, WEIGHTS_A_ROW)])


def untable(rows: np.ndarray, like: dict) -> dict:
    """The model of a table, in the shapes of another model."""
    flat, out, at = rows.ravel().astype(np.float32), {}, 0
    for k in ["embed", *sorted(k for k in like if k != "embed")]:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def train(
    inputs: np.ndarray, text: np.ndarray, target: np.ndarray, epochs: int = 6, seed: int = 7, batch: int = 64,
    width: int = WIDTH, classes: int = CLASSES, rate: float = 0.02, rows: int = 1,
) -> dict:
    """Weights after passes of Adam over all windows in a seeded order; target -1: none."""
    learner = Learner(_start(seed, rows, width, classes), seed)
    steps = epochs * -(-(len(inputs) // STRIDE) // batch)
    for _ in range(epochs):
        learner.learn(inputs, text, target, lambda step: rate * (1 - step / (steps + 1)), batch)
    return learner.m


def _gradient(m: dict, inputs: np.ndarray, text: np.ndarray, target: np.ndarray) -> dict:
    """Gradient of the mean cross entropy over the positions with a target; from all windows of a run of texts."""
    run = np.concatenate([inputs[0, :STRIDE], inputs[:, STRIDE:].ravel()])
    g, rows, moved = _gradients(m, run, _begins(text[:, STRIDE:].ravel()), target.ravel())
    g["embed"] = np.zeros_like(m["embed"])
    g["embed"][rows] = moved
    return g


def _gradients(m: dict, inputs: np.ndarray, begins: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """The gradient, without that of the input rows; the rows that were read, and theirs.

    Of a stretch of windows: ``inputs`` has the first half of its first window before its own.
    """
    w, w_all = WIDTH, _projection(m)
    x = m["embed"].take(inputs, 0)
    told = x @ w_all
    q, own, k, v = (np.ascontiguousarray(told[:, i * w : (i + 1) * w]) for i in range(4))
    q = q[STRIDE:]
    n, kind = len(begins), x.dtype.type
    h, mixed, s, total = _attended(q, own[STRIDE:], k, v, _masks(m).take(begins, 0))
    s /= total
    real = target >= 0
    weight = (real / kind(max(1, real.sum()))).astype(kind)[:, None]
    target = np.maximum(target, 0)
    group, order, cuts, z, rows, inner = _by_group(m, h, target)
    at = np.arange(len(h))
    for odds, place, share in ((z, group, weight), (inner, (target % GROUP).take(order), weight.take(order, 0))):
        np.exp(odds, out=odds)
        odds *= share / (odds @ np.ones((odds.shape[1], 1), kind))
        odds[at, place] -= share[:, 0]
    g = {"group": h.T @ z, "group_bias": z.sum(axis=0), "out": np.zeros_like(m["out"]), "bias": np.zeros_like(m["bias"])}
    back = np.empty_like(rows)
    for i in range(len(cuts) - 1):
        one, of = slice(cuts[i], cuts[i + 1]), slice(i * GROUP, (i + 1) * GROUP)
        if cuts[i] < cuts[i + 1]:
            np.matmul(rows[one].T, inner[one], out=g["out"][:, of])
            np.matmul(np.ones(cuts[i + 1] - cuts[i], kind), inner[one], out=g["bias"][of])
            np.matmul(inner[one], m["out"][:, of].T, out=back[one])
    da = np.empty_like(rows)
    da[order] = back
    da += z @ m["group"].T
    da *= 1 - h * h
    # what the projections get: query and own of the windows' second halves, key and value of both
    d = np.zeros((n + 1, STRIDE, 4 * w), kind)
    da = da.reshape(n, STRIDE, w)
    d[1:, :, w : 2 * w] = da
    ds = da @ _two(v)
    ds -= np.einsum("nqd,nqd->nq", da, mixed)[..., None]
    ds *= s
    g["near"] = np.bincount(_BACK.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * STRIDE).astype(kind)
    d[1:, :, :w] = ds @ _two(k).transpose(0, 2, 1)
    for part, found in ((2, ds.transpose(0, 2, 1) @ q.reshape(n, STRIDE, w)), (3, s.transpose(0, 2, 1) @ da)):
        d[:-1, :, part * w : (part + 1) * w] = found[:, :STRIDE]
        d[1:, :, part * w : (part + 1) * w] += found[:, STRIDE:]
    d = d.reshape(-1, 4 * w)
    whole = x.T @ d
    whole[:, :w] *= kind(w**-0.5)
    g["query"], g["own"], g["key"], g["value"] = (whole[:, i * w : (i + 1) * w] for i in range(4))
    seen = np.zeros(len(m["embed"]), bool)
    seen[inputs] = True
    read = np.flatnonzero(seen)
    number = np.empty(len(seen), np.int64)
    number[read] = np.arange(len(read)) * w
    cells = number.take(inputs)[:, None] + np.arange(w)
    moved = np.bincount(cells.ravel(), weights=(d @ w_all.T).ravel(), minlength=len(read) * w)
    return g, read, moved.reshape(-1, w).astype(kind)
