"""A small causal self-attention language model in numpy, over subword ids.

One layer: each position attends, by a learned query, key and distance, to itself and the positions before
it in its context window, and a hidden layer sees its own token and what attention gathered. The output is
a two-step softmax, first a cluster of tokens and then the token within it; the last place of the last
cluster stands for all rare tokens, among which the corpus counts decide.

Texts are laid end to end, each opened by a start token. Windows of two blocks overlap by one block: the
first block is context only, the second is scored, so each token is scored once and sees at least one
block of what precedes it. Masks keep attention causal and within the text. Windows go through in batches.
"""

from typing import NamedTuple

import numpy as np

BLOCK = 16
CLUSTERS = 32
#: As many as clusters: rows of a pass hold the logits of both side by side.
MEMBERS = 32
WIDTH = 24
KEY = 16
HIDDEN = 32
#: Windows that are scored, or make a step of training, together.
BATCH = 512
#: Steps of training that a stream is good for, at least.
STEPS = 32

START = CLUSTERS * MEMBERS
NAMES = ("embed", "query", "key", "value", "near", "mix", "mix_bias", "cluster", "cluster_bias", "member", "member_bias")


class Weights(NamedTuple):
    embed: np.ndarray  # token or start, width
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray  # a bias for each distance
    mix: np.ndarray  # own token and gathered value to hidden
    mix_bias: np.ndarray
    cluster: np.ndarray
    cluster_bias: np.ndarray
    member: np.ndarray  # cluster, hidden, member
    member_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self])

    def like(self, flat: np.ndarray) -> "Weights":
        ends = np.cumsum([w.size for w in self])
        return Weights(*[part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), self, strict=True)])


def initial(frequencies: np.ndarray, seed: int = 1) -> Weights:
    """Random weights whose output is that of the token frequencies."""
    random = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (scale * random.normal(size=shape)).astype(np.float32)

    grid = np.maximum(frequencies, 0.1).reshape(CLUSTERS, MEMBERS)
    return Weights(
        normal(START + 1, WIDTH, scale=0.5),
        normal(WIDTH, KEY, scale=WIDTH**-0.5),
        normal(WIDTH, KEY, scale=WIDTH**-0.5),
        normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
        np.zeros(2 * BLOCK, np.float32),
        normal(2 * WIDTH, HIDDEN, scale=WIDTH**-0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, CLUSTERS, scale=0.05),
        np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32),
        normal(CLUSTERS, HIDDEN, MEMBERS, scale=0.05),
        np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32),
    )


_STEPS = np.arange(2 * BLOCK)
_DISTANCE = _STEPS[BLOCK:, None] - _STEPS[None, :]


def _windows(n: int) -> int:
    return -(-n // BLOCK)


class Tables(NamedTuple):
    """What a position draws from its token alone, for each token, so that positions only look it up."""

    query: np.ndarray  # with the scale of the attention
    key: np.ndarray
    value: np.ndarray  # as it goes into the hidden layer
    own: np.ndarray  # what the token itself adds to the hidden layer, and a one for the biases below
    near: np.ndarray  # factors of the attention by place in the window, 0 ahead of the position
    output: np.ndarray  # for each cluster, hidden to all clusters and to its members; the last row is the bias


def tables(w: Weights) -> Tables:
    own = np.ones((len(w.embed), HIDDEN + 1), w.embed.dtype)
    own[:, :HIDDEN] = w.embed @ w.mix[:WIDTH] + w.mix_bias
    output = np.empty((CLUSTERS, HIDDEN + 1, CLUSTERS + MEMBERS), w.embed.dtype)
    output[:, :HIDDEN, :CLUSTERS], output[:, HIDDEN, :CLUSTERS] = w.cluster, w.cluster_bias
    output[:, :HIDDEN, CLUSTERS:], output[:, HIDDEN, CLUSTERS:] = w.member, w.member_bias
    return Tables(
        w.embed @ (w.query * w.query.dtype.type(KEY**-0.5)),
        w.embed @ w.key,
        w.embed @ (w.value @ w.mix[WIDTH:]),
        own,
        w.near[np.maximum(_DISTANCE, 0)],
        output,
    )


def _fits(mass: np.ndarray) -> bool:
    """Whether sums of exponentials neither overflowed nor vanished."""
    return bool(mass.min(initial=1) > 1e-30 and mass.max(initial=1) < 1e30)


def _overlapping(x: np.ndarray, count: int) -> np.ndarray:
    """Windows of two blocks, each a block after the one before, without copying."""
    row, item = x.strides
    return np.lib.stride_tricks.as_strided(x, (count, 2 * BLOCK, x.shape[1]), (BLOCK * row, row, item))


class _Pass:
    """A forward pass over consecutive windows, with what the backward pass needs."""

    def __init__(self, w: Weights, tokens: np.ndarray, begins: np.ndarray, targets: np.ndarray, ready: Tables | None = None):
        """``tokens`` are whole blocks, the first one context only; ``begins`` is where each token's text
        starts in them, ``targets`` what follows each scored position, -1 for none."""
        self.w, self.tokens = w, tokens
        self.tables = t = ready or tables(w)
        self.count = count = len(tokens) // BLOCK - 1
        look_up = lambda table, some: np.take(table, some, axis=0, mode="clip")
        self.q = look_up(t.query, tokens[BLOCK:]).reshape(count, BLOCK, KEY)
        self.k = _overlapping(look_up(t.key, tokens), count)
        self.v = _overlapping(look_up(t.value, tokens), count)
        first = begins[BLOCK:].reshape(count, BLOCK) - np.arange(count)[:, None] * BLOCK
        self._attend(first)
        self.gathered = np.matmul(self.a, self.v).reshape(-1, HIDDEN)
        self.gathered /= self.mass[:, None]
        h = look_up(t.own, tokens[BLOCK:])
        h[:, :HIDDEN] += self.gathered
        np.maximum(h, 0, out=h)

        # Positions in the order of the clusters they are to predict, those without a target last.
        cluster = np.where(targets < 0, CLUSTERS, targets // MEMBERS).astype(np.uint8)
        self.order = np.argsort(cluster, kind="stable")[: int(np.count_nonzero(targets >= 0))]
        goal = targets[self.order]
        self.ends = np.searchsorted(cluster[self.order], np.arange(CLUSTERS + 1)).tolist()
        self.h = look_up(h, self.order)
        at = np.arange(len(goal)) * (CLUSTERS + MEMBERS)
        self.right = np.stack([at + goal // MEMBERS, at + CLUSTERS + goal % MEMBERS])
        log = self._softmax()
        self.log = np.zeros(len(targets), log.dtype)
        self.log[self.order] = log

    def _attend(self, first: np.ndarray) -> None:
        """Unscaled attention and its sums. Relative to the largest where the sums would not fit."""
        near = self.tables.near
        cut = np.flatnonzero((first > 0).any(axis=1))
        hidden = _STEPS < first[cut][:, :, None]
        self.a = np.matmul(self.q, self.k.transpose(0, 2, 1))
        factor = np.where(_DISTANCE < 0, 0, np.exp(near)).astype(near.dtype)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(self.a, out=self.a)
            self.a *= factor
            self.a[cut] = np.where(hidden, 0, self.a[cut])
            self.mass = self.a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, self.a.dtype)
        if _fits(self.mass):
            return
        self.a = np.matmul(self.q, self.k.transpose(0, 2, 1))
        self.a += np.where(_DISTANCE < 0, -np.inf, near).astype(near.dtype)
        self.a[cut] = np.where(hidden, -np.inf, self.a[cut])
        self.a -= self.a.max(axis=2, keepdims=True)
        np.exp(self.a, out=self.a)
        self.mass = self.a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, self.a.dtype)

    def _logits(self) -> np.ndarray:
        """Of the clusters and of the members of the right one, next to each other."""
        out = np.empty((len(self.h), CLUSTERS + MEMBERS), self.h.dtype)
        for c, (low, high) in enumerate(zip(self.ends, self.ends[1:], strict=False)):
            if low < high:
                np.matmul(self.h[low:high], self.tables.output[c], out=out[low:high])
        return out

    def _softmax(self) -> np.ndarray:
        """The logarithm of the right one's share. Keeps the exponentials and their sums, for clusters and members."""
        self.p = self._logits()
        own = self.p.reshape(-1)[self.right]
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(self.p, out=self.p)
            self.masses = self._masses()
        if not _fits(self.masses):
            self.p = self._logits()
            halves = self.p.reshape(-1, 2, MEMBERS)
            top = halves.max(axis=2)
            halves -= top[:, :, None]
            own -= top.T
            np.exp(self.p, out=self.p)
            self.masses = self._masses()
        own -= np.log(self.masses).reshape(-1, 2).T
        return own[0] + own[1]

    def _masses(self) -> np.ndarray:
        return self.p.reshape(-1, MEMBERS) @ np.ones(MEMBERS, self.p.dtype)

    def gradient(self) -> Weights:
        """Of the mean of minus the log probabilities."""
        w, t, n = self.w, self.tables, max(1, len(self.order))
        d = self.p  # the pass is through, so in place
        halves = d.reshape(-1, MEMBERS)
        halves *= (1 / (n * self.masses))[:, None]
        d.reshape(-1)[self.right] -= d.dtype.type(1 / n)
        output = np.zeros_like(t.output)
        dh = np.empty((len(d) + 1, HIDDEN), d.dtype)
        for c, (low, high) in enumerate(zip(self.ends, self.ends[1:], strict=False)):
            if low < high:
                np.matmul(self.h[low:high].T, d[low:high], out=output[c])
                np.matmul(d[low:high], t.output[c, :HIDDEN].T, out=dh[low:high])
        cluster, member = output[:, :, :CLUSTERS].sum(axis=0), output[:, :, CLUSTERS:]
        dh[:-1] *= self.h[:, :HIDDEN] > 0
        dh[-1] = 0  # of positions without a target, and those that are context only
        back = np.full(len(self.tokens), len(d))
        back[BLOCK + self.order] = np.arange(len(d))
        dz = np.take(dh, back, axis=0, mode="clip")
        dg = dz[BLOCK:] / self.mass[:, None]
        shared = np.einsum("ij,ij->i", dg, self.gathered)  # the attention's shares add up to one
        dg = dg.reshape(self.count, BLOCK, HIDDEN)
        ds = np.matmul(dg, self.v.transpose(0, 2, 1))
        ds -= shared.reshape(self.count, BLOCK, 1)
        ds *= self.a
        by_place = (np.ones(self.count, ds.dtype) @ ds.reshape(self.count, -1)).reshape(BLOCK, 2 * BLOCK)
        near = np.zeros_like(w.near)
        np.add.at(near, np.maximum(_DISTANCE, 0), np.where(_DISTANCE < 0, 0, by_place))
        of_query = np.empty((len(self.tokens), KEY), d.dtype)
        of_query[:BLOCK] = 0
        np.matmul(ds, self.k, out=of_query[BLOCK:].reshape(self.count, BLOCK, KEY))
        of_key = self._added_up(np.matmul(ds.transpose(0, 2, 1), self.q))
        of_value = self._added_up(np.matmul(self.a.transpose(0, 2, 1), dg))
        found, sums = self._by_token(of_query, of_key, of_value, dz)
        scale = w.query.dtype.type(KEY**-0.5)
        passed = w.value @ w.mix[WIDTH:]
        embed = np.zeros_like(w.embed)
        embed[found] = sums @ np.concatenate([w.query * scale, w.key, passed, w.mix[:WIDTH]], axis=1).T
        of_all = w.embed[found].T @ sums
        of_passed = of_all[:, 2 * KEY : 2 * KEY + HIDDEN]
        return Weights(
            embed,
            of_all[:, :KEY] * scale,
            of_all[:, KEY : 2 * KEY],
            of_passed @ w.mix[WIDTH:].T,
            near,
            np.concatenate([of_all[:, 2 * KEY + HIDDEN :], w.value.T @ of_passed]),
            sums[:, 2 * KEY + HIDDEN :].sum(axis=0),
            cluster[:HIDDEN],
            cluster[HIDDEN],
            member[:, :HIDDEN],
            member[:, HIDDEN],
        )

    @staticmethod
    def _added_up(of_windows: np.ndarray) -> np.ndarray:
        """Sums of what overlapping windows have for each position."""
        count, _, width = of_windows.shape
        blocks = np.empty((count + 1, BLOCK, width), of_windows.dtype)
        blocks[0], blocks[-1] = of_windows[0, :BLOCK], of_windows[-1, BLOCK:]
        np.add(of_windows[:-1, BLOCK:], of_windows[1:, :BLOCK], out=blocks[1:-1])
        return blocks.reshape(-1, width)

    def _by_token(self, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens seen, and sums of what each of their positions has in the parts, side by side."""
        order = np.argsort(self.tokens.astype(np.uint16), kind="stable")
        tokens = self.tokens[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        # Two columns at a time, as complex numbers: sums of rows go column by column.
        paired = np.result_type(parts[0], np.complex64)
        sums = [np.add.reduceat(np.take(x, order, axis=0, mode="clip").view(paired), starts, axis=0) for x in parts]
        return tokens[starts], np.concatenate(sums, axis=1).view(parts[0].dtype)


def stream(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of tokens end to end. Each run is what opens it (the start token, or the token before) and
    the tokens to predict. Returned are the tokens that are seen, where each token's run starts, and the
    token that follows."""
    sizes = np.array([len(r) - 1 for r in runs], np.int64)
    starts = np.cumsum(sizes) - sizes
    tokens = np.concatenate([r[:-1] for r in runs]) if runs else np.empty(0, np.int64)
    targets = np.concatenate([r[1:] for r in runs]) if runs else np.empty(0, np.int64)
    return tokens, np.repeat(starts, sizes), targets


def _batches(tokens: np.ndarray, begins: np.ndarray, targets: np.ndarray, batch: int):
    """Arguments of consecutive passes, padded to whole blocks, with a block of context ahead."""
    n = _windows(len(tokens)) * BLOCK
    pad = lambda x, value: np.concatenate([np.full(BLOCK, value), x, np.full(n - len(x), value)])
    tokens, targets = pad(tokens, START), pad(targets, -1)
    begins = pad(begins + BLOCK, 0)
    for low in range(0, n, batch * BLOCK):
        high = min(low + batch * BLOCK, n)
        yield tokens[low : high + BLOCK], begins[low : high + BLOCK] - low, targets[low + BLOCK : high + BLOCK]


def log_probabilities(w: Weights, tokens: np.ndarray, begins: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each target."""
    ready = tables(w)
    parts = [_Pass(w, *args, ready).log for args in _batches(tokens, begins, targets, BATCH)]
    return np.concatenate(parts)[: len(tokens)] if parts else np.empty(0, np.float32)


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.flat, self.rate, self.step = w, w.flat(), rate, 0
        self.mean, self.square = np.zeros((2, self.flat.size), np.float32)

    def update(self, gradient: Weights, rate: float = 1.0) -> Weights:
        g = gradient.flat()
        self.step += 1
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.01 * (g * g - self.square)
        size = np.sqrt(self.square / (1 - 0.99**self.step)) + 1e-8
        self.flat = self.flat - self.mean / size * (self.rate * rate / (1 - 0.9**self.step))
        self.w = self.w.like(self.flat)
        return self.w


def trained(
    w: Weights, tokens: np.ndarray, begins: np.ndarray, targets: np.ndarray, rate: float = 0.0, adam: Adam | None = None, batch: int = 0
) -> Weights:
    """One pass of Adam over a stream, the steps falling to a third. A short stream is learnt from in ``STEPS``
    steps of fewer windows, which are smaller, as their gradients are rougher."""
    adam = adam or Adam(w, rate)
    batch = batch or max(1, min(BATCH, _windows(len(tokens)) // STEPS))
    steps = list(_batches(tokens, begins, targets, batch))
    for i, args in enumerate(steps):
        w = adam.update(_Pass(w, *args).gradient(), (1 - 0.67 * i / len(steps)) * min(1, batch / BATCH) ** 0.5)
    return w
