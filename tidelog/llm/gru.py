"""A bidirectional gated recurrent network with attention pooling, in numpy only.

One example is a window of word numbers. A word's input is the sum of a word vector, looked up by a
hash of the word, and the scaled sum of its character n-gram vectors, looked up by hashes of the
n-grams, its start and end marked. Two gated recurrent layers read the window in both directions; attention weighs their
outputs by position, and a logistic unit scores the weighted sum.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, fields

import numpy as np

#: Table sizes: hashed words, hashed character n-grams.
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 15
GRAM_SIZES = (3, 4, 5)
#: Characters of a word at most; longer ones are cut into pieces that share ``max(GRAM_SIZES) - 1`` characters, so that every n-gram is in one.
WORD_CHARS = 64
INPUT, HIDDEN = 16, 8
WINDOW, STRIDE = 64, 32

#: ASCII letters in lower case, digits and all other UTF-8 bytes kept, the rest a space.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    if max(map(len, words), default=0) <= WORD_CHARS:
        return words
    return [piece for w in words for piece in (_pieces(w) if len(w) > WORD_CHARS else (w,))]


def _pieces(word: bytes) -> list[bytes]:
    shared = max(GRAM_SIZES) - 1
    chars = word.decode("utf-8", "surrogatepass")
    ends = max(1, len(chars) - shared)
    return [chars[at : at + WORD_CHARS].encode("utf-8", "surrogatepass") for at in range(0, ends, WORD_CHARS - shared)]


def word_row(word: bytes) -> int:
    return zlib.crc32(word) % WORD_ROWS


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all n-grams of ``words``, one word after the other, and where each word's begin."""
    padded = ["<" + w.decode("utf-8", "surrogatepass") + ">" for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    data = np.frombuffer(("".join(padded) + "\0" * max(GRAM_SIZES)).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(ends))
    owner = np.repeat(np.arange(len(padded)), lengths)
    rows, owners = [], []
    rolling = np.full(len(ends), 2166136261, np.uint32)
    for n in range(1, max(GRAM_SIZES) + 1):
        rolling = (rolling ^ data[n - 1 : n - 1 + len(ends)]) * np.uint32(16777619)
        if n in GRAM_SIZES:
            fits = place + n <= ends
            mixed = rolling ^ (rolling >> np.uint32(15))
            rows.append((mixed[fits] % GRAM_ROWS).astype(np.int32))
            owners.append(owner[fits])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(padded)))


def windows_of(numbers: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """All windows of a text, overlapping by ``window - stride`` words; -1 pads the last. One of pads for no words."""
    count = 1 if len(numbers) <= window else 1 + -(-(len(numbers) - window) // stride)
    padded = np.full((count - 1) * stride + window, -1, np.int32)
    padded[: len(numbers)] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::stride]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Weights:
    words: np.ndarray  # WORD_ROWS x INPUT
    grams: np.ndarray  # GRAM_ROWS x INPUT
    inward: np.ndarray  # INPUT x 6 HIDDEN: update, reset, new; forward, then backward
    bias: np.ndarray  # 6 HIDDEN
    gates: np.ndarray  # 2 x HIDDEN x 2 HIDDEN
    fresh: np.ndarray  # 2 x HIDDEN x HIDDEN
    look: np.ndarray  # 2 HIDDEN x HIDDEN
    pick: np.ndarray  # HIDDEN
    out: np.ndarray  # 2 HIDDEN
    base: np.ndarray  # 1

    def each(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def initial(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Weights(
        draw(0.1, WORD_ROWS, INPUT), draw(0.3, GRAM_ROWS, INPUT), draw(0.4, INPUT, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32),
        draw(0.3, 2, HIDDEN, 2 * HIDDEN), draw(0.3, 2, HIDDEN, HIDDEN), draw(0.4, 2 * HIDDEN, HIDDEN), draw(0.5, HIDDEN), draw(0.4, 2 * HIDDEN), np.zeros(1, np.float32),
    )


def project(w: Weights, words: list[bytes]) -> np.ndarray:
    """What each word feeds into the gates: 6 HIDDEN numbers a word."""
    if not words:
        return np.zeros((0, 6 * HIDDEN), np.float32)
    rows, starts = gram_rows(words)
    counts = np.diff(np.append(starts, len(rows)))
    chars = np.add.reduceat(w.grams[rows], starts, axis=0) / np.sqrt(counts[:, None], dtype=np.float32)
    vectors = w.words[[word_row(x) for x in words]] + chars
    return vectors @ w.inward + w.bias


def logits(w: Weights, tables: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The logit of each window; ``tables`` has the projected words for either direction and a last row for pads."""
    size, length, h = len(windows), windows.shape[1], HIDDEN
    states = np.zeros((length, size, 2 * h), np.float32)
    there = (windows >= 0).astype(np.float32)
    columns = np.ascontiguousarray(windows.T)
    for side in (0, 1):
        state = np.zeros((size, h), np.float32)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            fed = tables[side][columns[t]]
            gate = _sigmoid(fed[:, : 2 * h] + state @ w.gates[side])
            new = np.tanh(fed[:, 2 * h :] + gate[:, h:] * (state @ w.fresh[side]))
            state = (state + gate[:, :h] * (new - state)) * there[:, t, None]
            states[t, :, h * side : h * (side + 1)] = state
    heed = np.tanh(states @ w.look) @ w.pick + (there.T - 1) * 30
    heed = np.exp(heed - heed.max(axis=0))
    pooled = np.einsum("tb,tbh->bh", heed / heed.sum(axis=0), states)
    return pooled @ w.out + w.base[0]


def gradients(w: Weights, vectors: np.ndarray, there: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Weighted logistic loss of windows with word ``vectors`` (length x size x INPUT), the gradient of those and of the dense weights."""
    length, size, h = vectors.shape[0], vectors.shape[1], HIDDEN
    fed = vectors @ w.inward + w.bias
    states = np.zeros((length, size, 2 * h), np.float32)
    kept: list[list] = [[None] * length, [None] * length]
    for side in (0, 1):
        state = np.zeros((size, h), np.float32)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            own = fed[t, :, 3 * h * side : 3 * h * (side + 1)]
            gate = _sigmoid(own[:, : 2 * h] + state @ w.gates[side])
            turned = state @ w.fresh[side]
            new = np.tanh(own[:, 2 * h :] + gate[:, h:] * turned)
            kept[side][t] = (state, gate, turned, new)
            state = (state + gate[:, :h] * (new - state)) * there[t, :, None]
            states[t, :, h * side : h * (side + 1)] = state
    seen = np.tanh(states @ w.look)
    heed = seen @ w.pick + (there - 1) * 30
    heed = np.exp(heed - heed.max(axis=0))
    heed /= heed.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", heed, states)
    z = pooled @ w.out + w.base[0]
    p = _sigmoid(z)
    loss = float(np.sum(weight * np.logaddexp(0, np.where(target > 0, -z, z))) / size)
    dz = (weight * (p - target) / size).astype(np.float32)
    d_out, d_base = pooled.T @ dz, dz.sum(keepdims=True)
    d_pooled = dz[:, None] * w.out
    d_states = heed[:, :, None] * d_pooled
    d_heed = np.einsum("tbh,bh->tb", states, d_pooled)
    d_heed = heed * (d_heed - (heed * d_heed).sum(axis=0))
    d_pick = np.einsum("tb,tbh->h", d_heed, seen)
    d_seen = d_heed[:, :, None] * w.pick * (1 - seen**2)
    d_look = states.reshape(-1, 2 * h).T @ d_seen.reshape(-1, h)
    d_states += d_seen @ w.look.T
    d_fed = np.zeros_like(fed)
    d_gates, d_fresh = np.zeros_like(w.gates), np.zeros_like(w.fresh)
    for side in (0, 1):
        carry = np.zeros((size, h), np.float32)
        for t in range(length - 1, -1, -1) if side == 0 else range(length):
            before, gate, turned, new = kept[side][t]
            update, reset = gate[:, :h], gate[:, h:]
            d = (carry + d_states[t, :, h * side : h * (side + 1)]) * there[t, :, None]
            d_new = d * update * (1 - new**2)
            d_reset = d_new * turned
            d_gate = np.concatenate([d * (new - before), d_reset], axis=1) * gate * (1 - gate)
            d_turned = d_new * reset
            d_fed[t, :, 3 * h * side : 3 * h * (side + 1)] = np.concatenate([d_gate, d_new], axis=1)
            d_gates[side] += before.T @ d_gate
            d_fresh[side] += before.T @ d_turned
            carry = d * (1 - update) + d_gate @ w.gates[side].T + d_turned @ w.fresh[side].T
    flat = d_fed.reshape(-1, 6 * h)
    d_inward, d_bias = vectors.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)
    d_vectors = d_fed @ w.inward.T
    return loss, d_vectors, [d_inward, d_bias, d_gates, d_fresh, d_look, d_pick, d_out, d_base]


def train(windows: np.ndarray, owner: np.ndarray, target: np.ndarray, vocabulary: list[bytes], epochs: int, seed: int, most: int = 6000, batch: int = 256, rate: float = 0.02) -> Weights:
    """Fit to documents: ``windows`` of word numbers, the document of each (``owner``), the label of each document.

    A document of class 1 need not show it in every window. From the second epoch on, those of its
    windows that score low count as examples only if they are its best one, and the windows of class 0
    that score highest are the examples of theirs, with a random half as many.
    """
    w, rng = initial(seed), np.random.default_rng(seed)
    parts = [gram_rows(vocabulary[at : at + 20_000]) for at in range(0, len(vocabulary), 20_000)]
    rows = np.concatenate([np.zeros(0, np.int32), *(r for r, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(np.append(s, len(r))) for r, s in parts)])
    starts = np.cumsum(counts) - counts
    del parts
    word_rows = np.array([word_row(x) for x in vocabulary], np.int64)
    dense = w.each()[2:]
    first, second = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    sums = [np.zeros(len(w.words), np.float32), np.zeros(len(w.grams), np.float32)]
    label = target[owner].astype(np.float32)
    share = max(1e-6, float(label.mean()))
    weight = np.where(label > 0, 0.5 / share, 0.5 / max(1e-6, 1 - share)).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        if epoch:
            z = score(w, windows, vocabulary)
            best = np.full(len(target), -np.inf, np.float32)
            np.maximum.at(best, owner, z)
            shown = np.flatnonzero((label > 0) & ((z >= best[owner]) | (z > 0)))
            clean = np.flatnonzero(label == 0)
            hard = clean[np.argsort(-z[clean], kind="stable")][: 2 * most // 3]
            chosen = np.concatenate([shown, hard, rng.permutation(clean)[: most // 3]])
        else:
            chosen = np.concatenate([rng.permutation(np.flatnonzero(label == c))[:most] for c in (0, 1)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), batch):
            some = chosen[at : at + batch]
            ids = windows[some].T
            there = (ids >= 0).astype(np.float32)
            used, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape)
            real = used[used >= 0]
            pads = len(used) - len(real)
            spans = [np.arange(starts[i], starts[i] + counts[i]) for i in real]
            flat = rows[np.concatenate(spans)] if spans else np.zeros(0, np.int32)
            each = counts[real]
            root = np.sqrt(each[:, None], dtype=np.float32)
            near = np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64) if len(real) else np.zeros(0, np.int64)
            table = np.zeros((len(used), INPUT), np.float32)
            if len(real):
                table[pads:] = w.words[word_rows[real]] + np.add.reduceat(w.grams[flat], near, axis=0) / root
            _, d_vectors, found = gradients(w, table[back], there, label[some], weight[some])
            step += 1
            for x, g, a, b in zip(dense, found, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= rate * (1 - 0.7 * epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            d_table = np.zeros_like(table)
            np.add.at(d_table, back.ravel(), (d_vectors * there[:, :, None]).reshape(-1, INPUT))
            if len(real):
                d_words = d_table[pads:]
                d_grams = np.repeat(d_words / root, each, axis=0)
                for params, place, grads, total in ((w.words, word_rows[real], d_words, sums[0]), (w.grams, flat, d_grams, sums[1])):
                    touched, inverse = np.unique(place, return_inverse=True)
                    summed = np.zeros((len(touched), INPUT), np.float32)
                    np.add.at(summed, inverse, grads)
                    total[touched] += (summed**2).mean(axis=1)
                    params[touched] -= 0.1 * summed / (np.sqrt(total[touched])[:, None] + 1e-8)
    return w


def score(w: Weights, windows: np.ndarray, vocabulary: list[bytes], batch: int = 2048) -> np.ndarray:
    """The logits of windows of numbers of ``vocabulary``."""
    tables = [np.zeros((len(vocabulary) + 1, 3 * HIDDEN), np.float32) for _ in (0, 1)]  # the last row is for pads
    for at in range(0, len(vocabulary), 20_000):
        some = vocabulary[at : at + 20_000]
        for table, half in zip(tables, np.split(project(w, some), 2, axis=1)):
            table[at : at + len(some)] = half
    return np.concatenate([np.zeros(0, np.float32), *(logits(w, tables, windows[at : at + batch]) for at in range(0, len(windows), batch))])


class Scorer:
    """Scores texts by their highest window. Keeps projected words, up to ``capacity`` of them, then starts anew."""

    def __init__(self, w: Weights, capacity: int = 300_000) -> None:
        self.w, self.capacity = w, capacity
        self.forget()

    def forget(self) -> None:
        scorer = self

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                number = self[word] = len(self)
                scorer.waiting.append(word)
                return number

        self.numbers, self.waiting = Numbers(), []
        self.tables, self.filled = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in (0, 1)], 0

    def _settle(self) -> list[np.ndarray]:
        need = self.filled + len(self.waiting) + 1  # and a row for pads
        if need > len(self.tables[0]):
            rows = max(need, 2 * len(self.tables[0]))
            self.tables = [np.concatenate([x[: self.filled], np.zeros((rows - self.filled, 3 * HIDDEN), np.float32)]) for x in self.tables]
        for at in range(0, len(self.waiting), 20_000):
            some = self.waiting[at : at + 20_000]
            for table, half in zip(self.tables, np.split(project(self.w, some), 2, axis=1)):
                table[self.filled : self.filled + len(some)] = half
            self.filled += len(some)
        self.waiting.clear()
        return self.tables

    def logits(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf, np.float32)
        blocks, owners, held = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, max(1, len(words)), 96 * STRIDE):  # a long text in pieces that overlap like its windows
                piece = words[at : at + 96 * STRIDE + WINDOW - STRIDE]
                if at and len(piece) <= WINDOW - STRIDE:
                    break
                block = windows_of(np.fromiter(map(self.numbers.__getitem__, piece), np.int32, len(piece)))
                blocks.append(block)
                owners.append(np.full(len(block), i))
                held += len(block)
                if held >= 2048 or len(self.numbers) > self.capacity:
                    self._flush(blocks, owners, best)
                    held = 0
        self._flush(blocks, owners, best)
        return best

    def _flush(self, blocks: list, owners: list, best: np.ndarray) -> None:
        if blocks:
            np.maximum.at(best, np.concatenate(owners), logits(self.w, self._settle(), np.concatenate(blocks)))
            blocks.clear()
            owners.clear()
        if len(self.numbers) > self.capacity:
            self.forget()
