"""The networks against plain forward passes and finite differences."""

import math

import numpy as np

from corpusmill.llm import quality, toxicity

TEXTS = [b"one two three four five. " * 40, "é漢字 and other words ".encode() * 12, b"", b"x", b"abababababab" * 60]


def test_quality_equals_a_plain_forward_pass():
    net = quality.Network()
    net.bias += 0.1
    for t, logit in zip(TEXTS, net.logits(TEXTS), strict=True):
        pools = []
        for s in range(0, max(len(t) - quality.OVERLAP, 1), quality.CHUNK - quality.OVERLAP):
            part = [*t[s : s + quality.CHUNK]] + [quality.PAD] * (quality.CHUNK - len(t[s : s + quality.CHUNK]))
            best = [max(0.0, max(sum(float(net.kernel[k, part[p + k], f]) for k in range(quality.WIDTH)) for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)) + float(net.bias[f])) for f in range(quality.FILTERS)]
            share = 0
            for lag in range(1, quality.LAGS + 1):
                same = [p >= lag and part[p] != quality.PAD and part[p] == part[p - lag] for p in range(quality.CHUNK)]
                share = max(share, *(sum(same[b : b + 2 * quality.BOX]) for b in range(0, quality.CHUNK - quality.BOX, quality.BOX)))
            pools.append([*best, float(quality.REPEATED) * share / (2 * quality.BOX)])
        x = [max(c) for c in zip(*pools, strict=True)] + [sum(c) / len(pools) for c in zip(*pools, strict=True)]
        assert math.isclose(sum(a * float(b) for a, b in zip(x, net.out, strict=True)) + float(net.last[0]), logit, rel_tol=1e-4, abs_tol=1e-4)


def differences(loss, params, grads, rng, step, count=12):
    """Central differences at some places of every parameter array, the
    largest gradients among them."""
    pairs = []
    for p, g in zip(params, grads, strict=True):
        flat, own = p.reshape(-1), g.reshape(-1)
        for i in {*np.argsort(-np.abs(own))[: count // 2].tolist(), *rng.integers(0, len(flat), count // 2).tolist()}:
            old = flat[i]
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            pairs.append((own[i], (up - down) / (2 * step)))
    return np.array(pairs).T


def test_quality_gradients():
    rng = np.random.default_rng(1)
    net = quality.Network()
    net.kernel, net.out, net.bias, net.last = (x.astype(np.float64) for x in (net.kernel, net.out, net.bias, net.last))
    net.bias += 0.1  # an empty text's responses are not at the corner
    rows, first = quality.chunks(TEXTS)
    repeated, y, weight = net.repeats(rows), np.array([1, 0, 1, 0, 1]), np.array([1.0, 2.0, 1.0, 0.5, 1.0])
    loss = lambda: net.gradients(rows, repeated, first, y, weight)[0]
    own, numeric = differences(loss, [net.kernel, net.bias, net.out, net.last], net.gradients(rows, repeated, first, y, weight)[1], rng, 1e-3)
    assert np.abs(own).max() > 1e-3 and np.allclose(own, numeric, rtol=0.1, atol=2e-3)


def toxic_model():
    sample = [(b"good words here again " * 3, 0), (b"bad vile words here " * 3, 1)] * 8
    return toxicity.train(sample, 0.7, epochs=2)


def test_toxicity_equals_a_plain_forward_pass():
    model = toxic_model()
    p = [x.astype(float) for x in model.net.params]
    h = toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t, logit in zip(TEXTS, model.logits(TEXTS), strict=True):
        tokens = toxicity.Tokens([t])
        inputs, words = model.inputs(tokens), tokens.ids + 1
        tops = []
        for s in range(0, max(len(words) - (toxicity.WINDOW - toxicity.STEP), 1), toxicity.STEP):
            part = words[s : s + toxicity.WINDOW]
            states = np.zeros((len(part), 2 * h))
            for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                w, u, b = p[3 * d : 3 * d + 3]
                state = np.zeros(h)
                for k in order:
                    x = inputs[part[k]] @ w + b
                    z, r = sigmoid(x[:h] + state @ u[:, :h]), sigmoid(x[h : 2 * h] + state @ u[:, h : 2 * h])
                    state = (1 - z) * state + z * np.tanh(x[2 * h :] + (r * state) @ u[:, 2 * h :])
                    states[k, d * h : (d + 1) * h] = state
            e = np.tanh(states @ p[6]) @ p[7]
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(part) else np.zeros(0)
            tops.append(a @ states @ p[8] + p[9][0] if len(part) else p[9][0])
        assert math.isclose(max(tops), logit, rel_tol=1e-3, abs_tol=1e-3)


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    model = toxic_model()
    net = model.net
    net.params = [rng.normal(0, 0.5, x.shape) for x in net.params]
    tokens = toxicity.Tokens([b"bad words here and good ones again " * 8, b"short text"])
    windows, _ = tokens.windows()
    inputs = rng.normal(0, 1, (len(tokens.word) + 1, toxicity.INPUTS))
    y = rng.integers(0, 2, len(windows))
    loss = lambda: float((np.logaddexp(0, (o := net.forward(inputs, windows)[0])) - y * o).sum())
    out, memory = net.forward(inputs, windows, True)
    grads, dx = net.backward(inputs, windows, memory, 1 / (1 + np.exp(-out)) - y)
    of_inputs = np.zeros_like(inputs)
    np.add.at(of_inputs, windows.reshape(-1), dx.reshape(-1, toxicity.INPUTS))
    of_inputs[0] = 0
    own, numeric = differences(loss, [*net.params, inputs[1:]], [*grads, of_inputs[1:]], rng, 2e-3)
    assert np.abs(own).max() > 0.05 and np.allclose(own, numeric, rtol=0.03, atol=5e-3)


def test_vectors_are_learned():
    model = toxic_model()
    good, bad = model.vectors.inputs(tokens := toxicity.Tokens([b"good vile"]), np.arange(2)), None
    assert len(tokens.word) == 2 and np.abs(good).max(axis=1).min() > 0
    bad = model.vectors.inputs(toxicity.Tokens([b"zzyzx"]), np.arange(1))
    assert np.abs(bad[:, : toxicity.VECTOR]).max() == 0
