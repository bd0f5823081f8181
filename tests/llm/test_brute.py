"""Whole queries on a small table against versions in plain Python that share no code with the operators."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import gru, html_text, media, quality, registry, toxicity
from tidelog.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, DIR, "documents").collect()}


# quality


def plain_features(text):
    data = list((text or "").encode())
    words, word = [], []
    for b in [*data, 32]:
        if b in b" \t\n\r\x0b\x0c":
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(b)
    n = len(words)
    if not n:
        return [0.0] * quality.N_FEATURES
    shares = [sum(b in c for b in data) / len(data) for c in quality.CLASSES]
    counts = sorted(Counter(words).values(), reverse=True)
    follow = {(words[i], words[i + 1]) for i in range(n - 1)}
    lines = [x for x in bytes(data).split(b"\n") if x.split()]
    same = sum(words[i] == words[i + 1] for i in range(n - 1)) / n
    again = 1 - len(set(lines)) / len(lines)
    ended = sum(x.split()[-1][-1] in b".!?:" for x in lines) / len(lines)
    ends, upper = sum(w[-1] in b"#$%&*!|" for w in words) / n, sum(w == w.upper() and w != w.lower() for w in words) / n
    runs = [
        math.log(1 + n), min(sum(map(len, words)) / n, 40) / 10, len(counts) / n, len(counts) / math.sqrt(n) / 10, len(follow) / (n - 1) if n > 1 else 1.0,
        counts[0] / n, sum(counts[:3]) / n, again, math.log(1 + len(lines)), math.log(1 + len(data) / len(lines)), ended, ends, upper, same,
    ]
    return [*shares, *runs, *(math.sqrt(x) for x in (*shares, again, ends, upper, same))]


def test_quality_scores(spark, texts):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    model = quality.model_of(docs, labels)
    some = {i: t for i, t in texts.items() if len(t or "") < 20_000}
    assert len(some) > 100
    for text in some.values():
        assert quality.features(text) == pytest.approx(plain_features(text))
    got = {r.doc_id: r for r in registry.queries()["op2_bradley_terry_quality"](spark, DIR).collect()}
    assert set(got) == set(texts)
    for i, text in some.items():
        z = sum(min(6, max(-6, (x - m) / s)) * w for x, m, s, w in zip(plain_features(text), model.mean, model.scale, model.weights))
        # the odds at the cut are those of the threshold
        want = 1 / (1 + math.exp(-(z - model.cut)) * (1 - 0.3) / 0.3)
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3)


def test_ranking_is_the_least_of_its_loss():
    """Weights of pairs drawn at random come near those of all pairs at once."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, quality.N_FEATURES))
    y = (x[:, 0] - 0.5 * x[:, 3] + rng.standard_normal(120) > 0).astype(int)
    model = quality.fit(x, y)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    diffs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, quality.N_FEATURES)
    loss = lambda w: np.logaddexp(0, -diffs @ w).mean() + 0.5e-3 * w @ w
    w = np.zeros(quality.N_FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(diffs @ w))
        slope = -(p[:, None] * diffs).mean(axis=0) + 1e-3 * w
        w -= np.linalg.solve((diffs * (p * (1 - p))[:, None]).T @ diffs / len(diffs) + 1e-3 * np.eye(len(w)), slope)
    assert loss(model.weights) <= loss(w) * 1.1 + 0.01


# toxicity


def plain_words(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalnum():
            if run:
                out.append(run)
            run = ""
        else:
            run += c
    return out


def plain_vector(w, word):
    padded = [ord(c) for c in f"<{word}>"]
    total, count = np.zeros(gru.INPUT), 0
    for n in gru.GRAM_SIZES:
        for at in range(len(padded) - n + 1):
            h = 2166136261
            for c in padded[at : at + n]:
                h = (h ^ c) * 16777619 % 2**32
            total += w.grams[(h ^ h >> 15) % gru.GRAM_ROWS]
            count += 1
    return w.words[zlib.crc32(word.encode()) % gru.WORD_ROWS] + total / math.sqrt(max(1, count))


def plain_logit(w, words):
    """One window, a word and a unit at a time."""
    h, length = gru.HIDDEN, len(words)
    if not length:
        return float(w.base[0])
    states = [[0.0] * (2 * h) for _ in range(length)]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    fed = [plain_vector(w, x) @ w.inward + w.bias for x in words]
    for side in (0, 1):
        state = [0.0] * h
        for t in range(length) if side == 0 else reversed(range(length)):
            own = fed[t][3 * h * side : 3 * h * (side + 1)]
            gate = [sigmoid(own[j] + sum(state[i] * w.gates[side][i][j] for i in range(h))) for j in range(2 * h)]
            new = [math.tanh(own[2 * h + j] + gate[h + j] * sum(state[i] * w.fresh[side][i][j] for i in range(h))) for j in range(h)]
            state = [state[j] + gate[j] * (new[j] - state[j]) for j in range(h)]
            states[t][h * side : h * (side + 1)] = state
    heed = [sum(math.tanh(sum(s[i] * w.look[i][j] for i in range(2 * h))) * w.pick[j] for j in range(h)) for s in states]
    weights = [math.exp(a - max(heed)) for a in heed]
    return float(sum(a * sum(s[i] * w.out[i] for i in range(2 * h)) for a, s in zip(weights, states)) / sum(weights) + w.base[0])


def test_toxicity_scores(spark, texts):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    w, scale, offset = toxicity.model_of(docs, labels)
    got = {r.doc_id: r for r in registry.queries()["op8_toxicity_gru"](spark, DIR).collect()}
    assert set(got) == set(texts)
    short = sorted((i for i in texts if len(plain_words(texts[i])) < 250), key=lambda i: len(texts[i] or ""))[-25:]
    assert len(short) == 25
    for i in short:
        words = plain_words(texts[i])
        starts = range(0, max(1, len(words) - gru.WINDOW + gru.STRIDE), gru.STRIDE)
        z = max(plain_logit(w, words[a : a + gru.WINDOW]) for a in starts)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(scale * z + offset))), abs=1e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7)


# media


def plain_pairs(samples):
    """Every bin of every frame by the sum that defines it."""
    frames = max(1, 1 + -(-(len(samples) - media.FRAME) // media.HOP))
    n = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / media.FRAME)
    bins = np.arange(media.FRAME // 2 + 1)
    waves = np.exp(-2j * np.pi * np.outer(bins, n) / media.FRAME)
    peaks = []
    for f in range(frames):
        piece = [b - 128 for b in samples[f * media.HOP : f * media.HOP + media.FRAME]]
        power = np.abs(waves @ (np.array(piece + [0] * (media.FRAME - len(piece))) * window))
        peaks.append([max((power[b], -b) for b in range(lo, hi)) for lo, hi in zip(media.BANDS, media.BANDS[1:])])
    found = []
    for f in range(frames):
        for band in range(len(media.BANDS) - 1):
            here = peaks[f][band][0]
            before = [peaks[g][band][0] for g in range(max(0, f - media.NEAR), f)]
            after = [peaks[g][band][0] for g in range(f + 1, min(frames, f + media.NEAR + 1))]
            if here > 0 and all(here > x for x in before) and all(here >= x for x in after):
                found.append((f, -peaks[f][band][1]))
    out = []
    for i, (f, tone) in enumerate(found):
        for g, other in found[i + 1 : i + 1 + media.FAN]:
            if g - f <= media.REACH:
                out.append((f, tone * 2**15 + other * 2**6 + g - f))
    return sorted(out)


def test_fingerprints_of_media(texts):
    for i in sorted(texts)[:40]:
        samples = media.payload((texts[i] or "")[:8000])[0]
        times, codes = media.pairs(samples)
        assert list(zip(times.tolist(), codes.tolist())) == plain_pairs(samples)


# html


def plain_densities(root):
    """``(node, density, sum of its children's)`` by the formula, each node counted anew from its own subtree."""

    def count(node):
        chars = linked = 0
        tags = links = node.links
        for p in node.parts:
            if isinstance(p, html_text.Node):
                if not p.skipped:
                    c, k, t, a = count(p)
                    chars, linked, tags, links = chars + c, linked + k, tags + t + 1, links + a
            else:
                n = len(" ".join(html_text.html.unescape(p[0]).split()))
                chars, linked = chars + n, linked + n * bool(p[1])
        return chars, linked, tags, links

    body = count(root)

    def density(node):
        c, k, t, a = count(node)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - k) * k + body[1] / max(1, body[0]) * c + math.e)
        return c / max(1, t) * math.log(max(1.0, c / max(1, k) * max(1, t) / max(1, a))) / math.log(max(base, 1 + 1e-9))

    out = []

    def walk(node):
        kids = [p for p in node.parts if isinstance(p, html_text.Node) and not p.skipped]
        loose = sum(len(" ".join(html_text.html.unescape(p[0]).split())) for p in node.parts if not isinstance(p, html_text.Node) and not p[1])
        out.append((node, density(node), sum(map(density, kids)) + loose))
        for kid in kids:
            walk(kid)

    walk(root)
    return out


def test_core_of_pages_has_the_greatest_sum_of_densities(spark):
    for row in table(spark, DIR, "pages").collect():
        root = html_text.parse(row.html or "")
        plain = plain_densities(root)
        html_text._measure(root)
        assert [(n.density, n.total) for n, _, _ in plain] == [pytest.approx((d, t)) for _, d, t in plain]
        core = html_text.core(root)
        dense = {id(root)}
        for node, d, _ in plain:
            if node is not root and id(node.parent) in dense and d >= plain[0][1] - 1e-9:
                dense.add(id(node))
        sums = [t for n, _, t in plain if id(n) in dense and n is not root]
        if sums:
            assert core.total >= max(sums) - 1e-6 and id(core) in dense
        assert html_text.main_text(row.html)
