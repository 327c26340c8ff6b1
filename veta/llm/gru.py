"""A gated recurrent language model in numpy with a class-factored softmax.

Words are numbered by falling frequency and cut into classes that hold equal sums of the roots
of their shares: with S the sum of all roots, S classes make the expected size of a target's
class S as well, and S is at most the root of the number of words, so a step costs O(sqrt V).
One class more stands for all words the model does not list. P(word) = P(class | state)
P(word | class, state).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
WORDS = 1024  # places of the smallest model; a larger corpus has more, see Model.other
OTHER = WORDS  # the number of every word not listed, in the smallest model
SCORED_ROWS = 32_768  # states sorted by class at a time
COLUMNS = 2048  # states whose scores of all classes are held at a time, so that they stay in the cache
NARROW = 60  # scores within this of their bias need no maximum taken off: float32 holds their exponentials and sums
LANES, WINDOW = 512, 16
RATE = 0.015
F32 = np.float32


def _sigmoid(x: np.ndarray) -> None:
    """In x itself."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += F32(1)
    np.reciprocal(x, out=x)


def _exp(x: np.ndarray, narrow: bool) -> np.ndarray:
    """Exponentials of every column in x itself, by its maximum unless the scores are narrow; gives the columns' sums."""
    if not narrow:
        x -= x.max(axis=0)
    np.exp(x, out=x)
    return x.sum(axis=0)


def _softmax_less(x: np.ndarray, goal: np.ndarray, scale: np.floating, narrow: bool) -> np.ndarray:
    """(Softmax of every column, less 1 at its `goal`) * scale; works in x itself, which no caller keeps."""
    x *= scale / _exp(x, narrow)
    x[goal, np.arange(x.shape[1])] -= scale
    return x


def _log_softmax_at(x: np.ndarray, goal: np.ndarray, narrow: bool) -> np.ndarray:
    """The entry `goal` of every column's log softmax; works in x itself."""
    if not narrow:
        x -= x.max(axis=0)
    wanted = x[goal, np.arange(x.shape[1])]
    return wanted - np.log(_exp(x, True))


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order; numbers that fit 16 bits are sorted by digits."""
    small = not len(numbers) or numbers.max() < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


def class_ends(shares: np.ndarray) -> np.ndarray:
    """First word of every class, and the number of words at the end."""
    roots = np.sqrt(shares)
    whole = roots.sum()
    of = ((np.cumsum(roots) - roots / 2) / whole * max(1, round(float(whole)))).astype(int)
    return np.append(np.unique(of, return_index=True)[1], len(shares))


@dataclass
class Rows:
    """A gradient that is 0 outside some rows."""

    at: np.ndarray
    values: np.ndarray
    rows: int

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.zeros((self.rows, self.values.shape[1]), dtype or F32)
        out[self.at] = self.values
        return out

    def ravel(self) -> np.ndarray:
        return np.asarray(self).ravel()


@dataclass
class Heads:
    """The two softmaxes with the biases as last column, each less the greatest of its softmax."""

    classes: np.ndarray
    words: np.ndarray
    narrow: bool  # a state's entries lie within 1, so no score leaves its bias by more than NARROW


@dataclass
class Model:
    """inputs: a row of gate inputs per word; state: hidden to gates; then the two softmaxes."""

    inputs: np.ndarray
    state: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray
    ends: np.ndarray  # of classes, see class_ends

    def __post_init__(self) -> None:
        sizes = np.append(np.diff(self.ends), 1)
        self.class_of = np.repeat(np.arange(len(sizes)), sizes)

    @property
    def other(self) -> int:
        """The number of every word not listed."""
        return len(self.word_bias)

    @classmethod
    def start(cls, counts: np.ndarray, other: float, seed: int = 3) -> Model:
        """Predicts the smoothed frequencies until it is trained; same for the same counts."""
        rng = np.random.default_rng(seed)
        smooth = counts + 0.5
        ends = class_ends(smooth / (smooth.sum() + other))
        classes = np.append(np.add.reduceat(smooth, ends[:-1]), other)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
        return cls(
            small(len(counts) + 1, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros((HIDDEN, len(classes)), F32), np.log(classes).astype(F32),
            np.zeros((len(counts), HIDDEN), F32), np.log(smooth).astype(F32), ends,
        )

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(F32))
            at += p.size
        return Model(*out, self.ends)

    def heads(self) -> Heads:
        tops = np.repeat(np.maximum.reduceat(self.word_bias, self.ends[:-1]), np.diff(self.ends))
        classes = np.column_stack([self.to_class.T, self.class_bias - self.class_bias.max()])
        words = np.column_stack([self.to_word, self.word_bias - tops])
        reach = max((np.abs(w) @ np.ones(HIDDEN, F32)).max() for w in (self.to_class.T, self.to_word))
        return Heads(classes, words, bool(reach <= NARROW))

    def step(self, word: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state and what the way back needs; a column per state, so that gates are whole rows."""
        g, s = np.ascontiguousarray(self.inputs[word].T), self.state.T @ h
        gates, n = g[: 2 * HIDDEN], g[2 * HIDDEN :]
        gates += s[: 2 * HIDDEN]
        _sigmoid(gates)
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        n += r * s[2 * HIDDEN :]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, z, r, n, s[2 * HIDDEN :]

    def by_class(self, targets: np.ndarray):
        """Order of the targets by class, and (words, rows in that order) of the listed classes met."""
        klass = self.class_of[targets]
        order = _order(klass)
        met, first = np.unique(klass[order], return_index=True)
        last = np.append(first[1:], len(order))
        return order, [
            (slice(self.ends[c], self.ends[c + 1]), slice(a, b))
            for c, a, b in zip(met.tolist(), first.tolist(), last.tolist(), strict=True) if c < len(self.ends) - 1
        ]

    def log_probability(self, h: np.ndarray, targets: np.ndarray, heads: Heads | None = None) -> np.ndarray:
        """Natural logarithm; of an unlisted word only that it is one."""
        heads, out = heads or self.heads(), np.empty(len(targets))
        for at in range(0, len(targets), SCORED_ROWS):
            part = slice(at, at + SCORED_ROWS)
            out[part] = self._log_probability(h[part], targets[part], heads)
        return out

    def _log_probability(self, h: np.ndarray, targets: np.ndarray, heads: Heads) -> np.ndarray:
        order, classes = self.by_class(targets)
        x, y = np.ones((HIDDEN + 1, len(order)), F32), targets[order]
        x[:HIDDEN] = h[order].T  # the 1 below takes up the bias
        klass, found = self.class_of[y], np.empty(len(y))
        for at in range(0, len(y), COLUMNS):
            part = slice(at, at + COLUMNS)
            found[part] = _log_softmax_at(heads.classes @ x[:, part], klass[part], heads.narrow)
        for words, rows in classes:
            if words.stop - words.start > 1:
                found[rows] += _log_softmax_at(heads.words[words] @ x[:, rows], y[rows] - words.start, heads.narrow)
        out = np.empty(len(targets))
        out[order] = found
        return out


class Trainer:
    """Truncated backpropagation through time with Adam; the state runs on across windows."""

    def __init__(self, model: Model):
        self.model = model
        self.first = [np.zeros_like(p) for p in model.parts()]
        self.second = [np.zeros_like(p) for p in model.parts()]
        self.updates = 0
        # how often each word was read and each class was wanted: what a copy's rows weigh in an average
        self.read = np.zeros(model.other + 1, np.int64)
        self.wanted = np.zeros(len(model.ends), np.int64)
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Room that the next window uses again; fresh pages would cost as much as the work on them."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, F32)
        return self.rooms[name][:size].reshape(shape)

    def weights(self) -> np.ndarray:
        """For every entry of model.flat() the number of tokens it has learned from."""
        m, tokens = self.model, int(self.wanted.sum())
        of_words = self.wanted[m.class_of[: m.other]]
        rows = [self.read, *(np.full(len(p), tokens) for p in (m.state, m.to_class, m.class_bias)), of_words, of_words]
        return np.concatenate([np.repeat(r, p.size // max(1, len(p))) for r, p in zip(rows, m.parts(), strict=True)])

    def text(self, words: np.ndarray, end: int) -> None:
        """Learn a run of texts, each closed by `end`, cut into lanes that run side by side."""
        if not len(words):
            return
        lanes = min(LANES, max(1, len(words) // WINDOW))
        steps = -(-len(words) // lanes)
        padded = np.full(lanes * steps, -1)
        padded[: len(words)] = words
        targets = padded.reshape(lanes, steps).T
        inputs = np.vstack([np.full((1, lanes), end), targets[:-1]])
        h = np.zeros((lanes, HIDDEN), F32)
        for t in range(0, steps, WINDOW):
            h = self.window(inputs[t : t + WINDOW], targets[t : t + WINDOW], h, end)

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int) -> np.ndarray:
        m, h = self.model, np.ascontiguousarray(h.T)
        T, B = inputs.shape
        inputs = np.maximum(inputs, 0)
        keep = (inputs != end).astype(F32)  # a text starts from an empty state
        past, seen, states = [], [], self._room("states", T, B, HIDDEN)
        for t in range(T):
            h = h * keep[t]
            past.append(h)
            h, *rest = m.step(inputs[t], h)
            seen.append(rest)
            states[t] = h.T
        flat, goal = states.reshape(-1, HIDDEN), targets.ravel()
        real = np.flatnonzero(goal >= 0)
        if not len(real):
            return h.T
        scale = F32(1 / len(real))
        by, classes = m.by_class(goal[real])
        real = real[by]  # targets in the order of their classes, states as rows and as columns
        y, heads = goal[real], m.heads()
        rows_of, x = self._room("rows", len(y), HIDDEN + 1), self._room("columns", HIDDEN + 1, len(y))
        rows_of[:, :HIDDEN], rows_of[:, HIDDEN] = flat[real], 1  # the 1 takes up the bias
        x[:] = rows_of.T
        klass = m.class_of[y]
        self.wanted += np.bincount(klass, minlength=len(self.wanted))
        d_classes, d_words, dx = np.zeros_like(heads.classes), np.zeros_like(heads.words), self._room("dx", HIDDEN, len(y))
        for at in range(0, len(y), COLUMNS):
            part = slice(at, at + COLUMNS)
            d = _softmax_less(heads.classes @ x[:, part], klass[part], scale, heads.narrow)
            d_classes += d @ rows_of[part]
            dx[:, part] = m.to_class @ d
        for words, rows in classes:
            if words.stop - words.start == 1:
                continue  # its only word is sure
            d = _softmax_less(heads.words[words] @ x[:, rows], y[rows] - words.start, scale, heads.narrow)
            d_words[words] = d @ rows_of[rows]
            dx[:, rows] += m.to_word[words].T @ d
        d_states = flat  # the states themselves are not read again
        d_states[:] = 0
        d_states[real] = dx.T
        d_states = d_states.reshape(T, B, HIDDEN)
        d_gates, d_rows = self._room("gates", 3 * HIDDEN, B), self._room("inputs", T, B, 3 * HIDDEN)
        back, d_state = self._room("back", 3 * HIDDEN, B), np.zeros_like(m.state)
        dh = np.zeros((HIDDEN, B), F32)
        for t in range(T - 1, -1, -1):
            z, r, n, s = seen[t]
            dh += d_states[t].T
            dz, dr, dn = (d_gates[i * HIDDEN : (i + 1) * HIDDEN] for i in range(3))
            rest = 1 - z
            np.multiply(dh, rest, out=dn)
            rest *= z
            np.subtract(past[t], n, out=dz)
            dz *= dh
            dz *= rest
            n *= n  # not read again
            np.subtract(1, n, out=n)
            dn *= n
            np.multiply(dn, s, out=dr)
            np.multiply(dn, r, out=back[2 * HIDDEN :])
            dr *= r
            np.subtract(1, r, out=r)
            dr *= r
            back[: 2 * HIDDEN] = d_gates[: 2 * HIDDEN]
            d_rows[t] = d_gates.T
            d_state += past[t] @ back.T
            dh *= z
            dh += m.state @ back
            dh *= keep[t]
        used = inputs.ravel()
        order = _order(used)
        word, begin, times = np.unique(used[order], return_index=True, return_counts=True)
        self.read[word] += times
        d_rows = np.take(d_rows.reshape(-1, 3 * HIDDEN), order, axis=0, out=self._room("sorted", len(used), 3 * HIDDEN), mode="clip")
        d_inputs = Rows(word, np.add.reduceat(d_rows, begin, axis=0), len(m.inputs))
        self._update([
            d_inputs, d_state, np.ascontiguousarray(d_classes[:, :HIDDEN].T), np.ascontiguousarray(d_classes[:, HIDDEN]),
            np.ascontiguousarray(d_words[:, :HIDDEN]), np.ascontiguousarray(d_words[:, HIDDEN]),
        ])
        return h.T

    def _update(self, gradients: list[np.ndarray | Rows]) -> None:
        """Adam; of a gradient in rows only those rows move, so a step does not cost the whole table."""
        self.updates += 1
        values = [g.values if isinstance(g, Rows) else g for g in gradients]
        norm = float(np.sqrt(sum(float(np.vdot(v, v)) for v in values)))
        shrink = F32(min(1.0, 1.0 / max(norm, 1e-12)))
        rate = F32(RATE * np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates))
        for p, g, v, a, b in zip(self.model.parts(), gradients, values, self.first, self.second, strict=True):
            at = g.at if isinstance(g, Rows) else slice(None)
            one, two = a[at], b[at]
            v = np.multiply(v, shrink, out=self._room("step", *v.shape))
            square = np.multiply(v, v, out=self._room("square", *v.shape))
            square *= F32(0.001)
            two *= F32(0.999)
            two += square
            v *= F32(0.1)
            one *= F32(0.9)
            one += v
            move = np.sqrt(two, out=square)
            move += F32(1e-8)
            np.divide(one, move, out=move)
            move *= rate
            p[at] -= move
            if isinstance(g, Rows):
                a[at], b[at] = one, two


def score(model: Model, texts: list[np.ndarray], end: int, window: int = 32) -> np.ndarray:
    """Natural log-likelihood of whole texts, each closed by `end`; the state is carried throughout."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    words = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, int)
    starts = np.cumsum(falling) - falling
    total = np.zeros(len(texts))
    h, heads = np.zeros((HIDDEN, len(texts)), F32), model.heads()
    last = np.full(len(texts), end)
    for t0 in range(0, int(falling[0]) if len(texts) else 0, window):
        active = int(np.searchsorted(-falling, -t0, side="left"))  # texts longer than t0
        h, last = np.ascontiguousarray(h[:, :active]), last[:active]
        steps = min(window, int(falling[0]) - t0)
        at = t0 + np.arange(steps)[:, None]
        inside = at < falling[:active]
        grid = words[np.minimum(starts[:active] + at, len(words) - 1)]
        states = np.empty((steps, HIDDEN, active), F32)
        for t in range(steps):
            h = model.step(last, h)[0]
            states[t] = h
            last = grid[t]
        row = np.broadcast_to(np.arange(active), inside.shape)[inside]
        total[:active] += np.bincount(row, model.log_probability(states.transpose(0, 2, 1)[inside], grid[inside], heads), minlength=active)
    out = np.zeros(len(texts))
    out[order] = total
    return out
