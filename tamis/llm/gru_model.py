"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, scores of whole documents.

Word 0 stands for all words outside the vocabulary, word 1 for the end of a document; both are classes of their own. The
other words, in order of frequency, fill classes of CLASS_WORDS. P(word) = P(class) * P(word in class).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OTHER, END = 0, 1
CLASS_WORDS = 64
F32 = np.float32
#: Training: streams side by side, the words that each of them has at least, and words between two updates of one stream.
LANES = 128
LANE_WORDS = 512
WINDOW = 24
#: Logits above this are not put into exp as they are.
HIGH = F32(60)


@dataclass
class Gru:
    """Parameters, and sums of squared gradients by row of them. Gates are laid out as update, reset, candidate."""

    given: np.ndarray  # words x 3 hidden: the word's part in the gates
    rec: np.ndarray  # hidden x 3 hidden
    bias: np.ndarray  # 3 hidden
    cls: np.ndarray  # classes x hidden
    cls_bias: np.ndarray
    out: np.ndarray  # classes x CLASS_WORDS x hidden
    out_bias: np.ndarray  # classes x CLASS_WORDS
    squares: dict[str, np.ndarray]

    NAMES = ("given", "rec", "bias", "cls", "cls_bias", "out", "out_bias")

    def flat(self) -> np.ndarray:
        """All numbers, one after another."""
        return np.concatenate([x.ravel() for x in (*(getattr(self, k) for k in self.NAMES), *(self.squares[k] for k in self.NAMES))])

    def copy(self) -> Gru:
        return self.filled(self.flat())

    def filled(self, flat: np.ndarray) -> Gru:
        """A network of this shape with other numbers."""
        at, parts = 0, []
        for x in (*(getattr(self, k) for k in self.NAMES), *(self.squares[k] for k in self.NAMES)):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(F32, copy=True))
            at += x.size
        return Gru(*parts[: len(self.NAMES)], dict(zip(self.NAMES, parts[len(self.NAMES) :], strict=True)))


def class_of(word: np.ndarray) -> np.ndarray:
    return np.where(word < 2, word, 2 + (word - 2) // CLASS_WORDS)


def place_of(word: np.ndarray) -> np.ndarray:
    return np.where(word < 2, 0, (word - 2) % CLASS_WORDS)


def create(counts: np.ndarray, hidden: int, seed: int) -> Gru:
    """Small random parameters; the biases are the words' frequencies, so that training starts from those."""
    words = len(counts)
    rng = np.random.default_rng(seed)
    word = np.arange(words)
    cls, place = class_of(word), place_of(word)
    classes = int(cls.max(initial=1)) + 1

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(F32)

    out_bias = np.full((classes, CLASS_WORDS), -1e9, F32)  # places beyond the last word get no probability
    out_bias[cls, place] = np.log(counts + 1.0)
    out_bias -= out_bias.max(axis=1, keepdims=True)
    cls_bias = np.log(np.bincount(cls, weights=counts + 1.0, minlength=classes)).astype(F32)
    parts = [
        draw(words, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros(3 * hidden, F32),
        draw(classes, hidden, scale=0.1), cls_bias - cls_bias.max(), draw(classes, CLASS_WORDS, hidden, scale=0.1), out_bias,
    ]
    return Gru(*parts, {k: np.full(x.shape[:-1] if x.ndim > 1 and k != "out_bias" else x.shape, 1e-4, F32) for k, x in zip(Gru.NAMES, parts, strict=True)})


def _recur(m: Gru, given: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """By step of a window: states before (0 in fresh lanes) and after, update and reset gates, candidates, candidates' recurrent part."""
    steps, lanes = given.shape
    size = h.shape[1]
    drive = m.given[given.ravel()].reshape(steps, lanes, 3 * size)
    drive += m.bias
    came, states, inner, cand = (np.empty((steps, lanes, size), F32) for _ in range(4))
    gates = np.empty((steps, lanes, 2 * size), F32)
    some = fresh.any(axis=1).tolist()
    for t in range(steps):
        came[t] = h
        h = came[t]
        if some[t]:
            h[fresh[t]] = 0
        u = h @ m.rec
        g, c = gates[t], cand[t]
        np.add(drive[t, :, : 2 * size], u[:, : 2 * size], out=g)
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += F32(1)
        np.reciprocal(g, out=g)
        inner[t] = u[:, 2 * size :]
        np.multiply(g[:, size:], inner[t], out=c)
        c += drive[t, :, 2 * size :]
        c *= F32(-2)
        np.exp(c, out=c)
        c += F32(1)
        np.divide(F32(2), c, out=c)  # tanh(x) = 2 / (1 + exp(-2 x)) - 1
        c -= F32(1)
        after = states[t]
        np.subtract(h, c, out=after)
        after *= g[:, :size]
        after += c
        h = after
    return came, states, gates, cand, inner


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits less a number for each row, and the logarithm of their sum with that number added again."""
    if logits.max() < HIGH:
        e = np.exp(logits)
        total = e.sum(axis=1)
        if total.min() > 1e-30:
            return e, np.log(total)
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    return e, np.log(e.sum(axis=1)) + top[:, 0]


def _softmax_terms(m: Gru, flat: np.ndarray, wanted: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """Natural log probabilities of the wanted words; with grad the gradient to flat and to the output's parameters."""
    cls, place = class_of(wanted), place_of(wanted)
    # In order of classes, so that each class is a slice.
    order = np.argsort(cls.astype(np.int16), kind="stable")
    x, cls, place = flat[order], cls[order], place[order]
    rows = np.arange(len(x))
    logits = x @ m.cls.T
    logits += m.cls_bias
    chosen = logits[rows, cls]
    e, total = _softmax(logits)
    log_p = chosen - total
    back, grads = None, {}
    if grad:
        e *= (-1 / e.sum(axis=1))[:, None]
        e[rows, cls] += 1
        back = e @ m.cls
        grads = {"cls": e.T @ x, "cls_bias": e.sum(axis=0), "out": np.zeros_like(m.out), "out_bias": np.zeros_like(m.out_bias)}
    bounds = np.searchsorted(cls, np.arange(2, len(m.out) + 1)).tolist()
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 2):
        if a == b:
            continue
        logits = x[a:b] @ m.out[k].T
        logits += m.out_bias[k]
        at = (rows[: b - a], place[a:b])
        chosen = logits[at]
        e, total = _softmax(logits)
        log_p[a:b] += chosen - total
        if grad:
            e *= (-1 / e.sum(axis=1))[:, None]
            e[at] += 1
            back[a:b] += e @ m.out[k]
            grads["out"][k], grads["out_bias"][k] = e.T @ x[a:b], e.sum(axis=0)
    out = np.empty_like(log_p)
    out[order] = log_p
    if grad:
        moved = np.empty_like(back)
        moved[order] = back
        back = moved
    return out, back, grads


def _climb(m: Gru, name: str, grad: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
    """Adagrad with one sum of squares for each row: the mean square of the row's gradient is added to it."""
    square = np.einsum("...i,...i->...", grad, grad) / F32(grad.shape[-1]) if m.squares[name].ndim < grad.ndim else grad * grad
    sums = m.squares[name]
    sums[rows] += square
    step = F32(rate) / np.sqrt(sums[rows])
    getattr(m, name)[rows] += grad * (step[..., None] if step.ndim < grad.ndim else step)


def train(m: Gru, docs: list[np.ndarray], rate: float = 0.1, passes: int = 1) -> Gru:
    """Climb the likelihood of documents (words, then the end), laid end to end and cut into lanes; changes m.

    The state goes on from window to window, the gradient stops at a window's start. Each word is predicted once in a pass.
    """
    words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    if not len(words):
        return m
    size = m.rec.shape[0]
    begins = np.zeros(len(words), bool)
    begins[np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))] = True
    before = np.where(begins, END, np.concatenate(([END], words[:-1])))
    lanes = max(1, min(LANES, len(words) // LANE_WORDS))
    steps = -(-len(words) // lanes)
    live = np.arange(lanes * steps) < len(words)

    def laid(x: np.ndarray) -> np.ndarray:
        return np.resize(x, lanes * steps).reshape(lanes, steps).T

    before, wanted, fresh, live = laid(before), laid(words), laid(begins), laid(live)
    for _ in range(passes):
        h = np.zeros((lanes, size), F32)
        for a in range(0, steps, WINDOW):
            b = min(steps, a + WINDOW)
            came, states, gates, cand, inner = _recur(m, before[a:b], fresh[a:b], h)
            h = states[-1].copy()
            use = live[a:b].ravel()
            flat = states.reshape(-1, size)
            whole = bool(use.all())
            _, back, grads = _softmax_terms(m, flat if whole else flat[use], wanted[a:b].ravel() if whole else wanted[a:b].ravel()[use], True)
            if not whole:
                full = np.zeros_like(flat)
                full[use] = back
                back = full
            back = back.reshape(b - a, lanes, size)
            # What does not depend on the gradient: of the update gate, the candidate and the reset gate.
            z, r = gates[:, :, :size], gates[:, :, size:]
            by_z = (came - cand) * z * (1 - z)
            by_c = (1 - z) * (1 - cand * cand)
            by_r = inner * r * (1 - r)
            du = np.empty((b - a, lanes, 3 * size), F32)
            dc = np.empty((b - a, lanes, size), F32)
            dh = np.zeros((lanes, size), F32)
            some = fresh[a:b].any(axis=1).tolist()
            turned = np.ascontiguousarray(m.rec.T)
            for t in range(b - a - 1, -1, -1):
                dh += back[t]
                d, c = du[t], dc[t]
                np.multiply(dh, by_z[t], out=d[:, :size])
                np.multiply(dh, by_c[t], out=c)
                np.multiply(c, by_r[t], out=d[:, size : 2 * size])
                np.multiply(c, r[t], out=d[:, 2 * size :])
                dh *= z[t]
                dh += d @ turned
                if some[t]:
                    dh[fresh[a + t]] = 0
            grads["rec"] = came.reshape(-1, size).T @ du.reshape(-1, 3 * size)
            du[:, :, 2 * size :] = dc
            flat_du, own = du.reshape(-1, 3 * size), before[a:b].ravel()
            grads["bias"] = flat_du.sum(axis=0)
            order = np.argsort(own.astype(np.int16), kind="stable")
            ranked = own[order]
            at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            by_word = np.add.reduceat(flat_du[order], at, axis=0)
            n = F32(1 / max(1, int(use.sum())))
            _climb(m, "given", by_word * n, rate, ranked[at])
            for k, g in grads.items():
                _climb(m, k, g * n, rate)
    return m


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Deal documents to n lanes of about equal length: the longest first, each to the shortest lane."""
    import heapq

    heap, dealt = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        dealt[i].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), i))
    return [x for x in dealt if x]


def lay(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps x lanes: words that go in (the end mark at a document's start), words to predict, document numbers (-1: nothing)."""
    lengths = np.array([len(d) for d in docs])
    dealt = lanes(lengths, n)
    steps = max(int(lengths[x].sum()) for x in dealt)
    given, wanted, doc = np.full((len(dealt), steps), END, np.int32), np.full((len(dealt), steps), END, np.int32), np.full((len(dealt), steps), -1, np.int32)
    for i, own in enumerate(dealt):
        at = 0
        for d in own:
            k = len(docs[d])
            wanted[i, at : at + k] = docs[d]
            given[i, at + 1 : at + k] = docs[d][:-1]
            doc[i, at : at + k] = d
            at += k
    return given.T.copy(), wanted.T.copy(), doc.T.copy()


def score(m: Gru, docs: list[np.ndarray], n_lanes: int = 256, window: int = 32) -> np.ndarray:
    """Natural log probability of each whole document (words, then the end); the state is carried across windows."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    given, wanted, doc = lay(docs, n_lanes)
    h = np.zeros((given.shape[1], m.rec.shape[0]), F32)
    last = np.full(given.shape[1], -1, np.int32)
    for a in range(0, len(given), window):
        own = doc[a : a + window]
        on = np.flatnonzero((own >= 0).any(axis=0))
        if len(on) < h.shape[0]:  # lanes that are through leave
            h, last, given, wanted, doc = h[on], last[on], given[:, on], wanted[:, on], doc[:, on]
            own = own[:, on]
        fresh = own != np.vstack((last[None, :], own[:-1]))
        states = _recur(m, given[a : a + window], fresh, h)[1]
        h, last = states[-1], own[-1]
        live = own.ravel() >= 0
        log_p, _, _ = _softmax_terms(m, states.reshape(-1, states.shape[2])[live], wanted[a : a + window].ravel()[live], False)
        out += np.bincount(own.ravel()[live], weights=log_p.astype(np.float64), minlength=len(docs))
    return out
