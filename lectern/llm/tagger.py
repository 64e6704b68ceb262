"""Labels for every character: a bidirectional LSTM whose outputs a CRF decodes, in numpy.

A character is a row of input weights, so there is no product for inputs.
x / (1 + |x|) stands for the hyperbolic tangent and, halved and raised, for the
sigmoid: numpy computes it several times as fast. Padding closes all gates, so
it leaves the state at zero and windows of different lengths run side by side.

Label 0 means outside; of kind k, 2k + 1 begins a span and 2k + 2 goes on with
it, which only its own kind can precede.
"""

from __future__ import annotations

import numpy as np

#: Code points below this have weights of their own, all others share one; then padding.
KNOWN = 256
OTHER, PAD = KNOWN, KNOWN + 1
NEVER = np.float32(-1e4)
CLOSED = np.float32(-1e6)


def symbols(text: str) -> np.ndarray:
    """A text's characters as the tagger's symbols."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, OTHER).astype(np.uint16)


def new(kinds: int, hidden: int, seed: int) -> dict:
    """Parameters before training: f and b have wx (symbols x gates) and wh (hidden x gates); wo, bo; CRF start, end and step."""
    rnd = np.random.default_rng(seed)
    k = 2 * kinds + 1
    p = {}
    for side in "fb":
        p[side + "x"] = rnd.normal(0, 0.1, (KNOWN + 2, 4 * hidden)).astype(np.float32)
        p[side + "x"][:, hidden : 2 * hidden] += 0.5  # gates that remember at first
        p[side + "h"] = rnd.normal(0, 0.3 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
    p["wo"] = rnd.normal(0, 0.3, (2 * hidden, k)).astype(np.float32)
    p["bo"] = np.zeros(k, np.float32)
    p |= {"start": np.zeros(k, np.float32), "end": np.zeros(k, np.float32), "step": np.zeros((k, k), np.float32)}
    return closed(p)


def closed(p: dict) -> dict:
    """Forbidden steps and closed gates, put back after each change of the parameters."""
    k = len(p["bo"])
    for b in range(2, k, 2):
        p["start"][b] = NEVER
        p["step"][[a for a in range(k) if a not in (b - 1, b)], b] = NEVER
    hidden = p["fh"].shape[0]
    for side in "fb":
        p[side + "x"][PAD] = 0
        p[side + "x"][PAD, : 3 * hidden] = CLOSED
    return p


def _bent(x, t):
    """x / (1 + |x|) in place; t: room of x's shape."""
    np.abs(x, out=t)
    t += 1
    x /= t


def _run(wx, wh, ids, keep=None):
    """Hidden states (steps, rows, hidden), in the order of ids; keep: a list for what the way back needs."""
    steps, rows = ids.shape
    n, real = wh.shape[0], wx.dtype
    out = np.empty((steps, rows, n), real)
    h, c = np.zeros((rows, n), real), np.zeros((rows, n), real)
    z, zx, t, u = np.empty((rows, 4 * n), real), np.empty((rows, 4 * n), real), np.empty((rows, n), real), np.empty((rows, n), real)
    scale, shift = np.full(4 * n, 0.5, real), np.full(4 * n, 0.5, real)
    scale[3 * n :], shift[3 * n :] = 1, 0
    for s in range(steps):
        np.dot(h, wh, out=z)
        np.take(wx, ids[s], axis=0, out=zx, mode="clip")
        z += zx
        _bent(z, zx)
        z *= scale
        z += shift
        if keep is not None:
            keep.append((z.copy(), c.copy()))
        c *= z[:, n : 2 * n]
        np.multiply(z[:, :n], z[:, 3 * n :], out=t)
        c += t
        t[:] = c
        _bent(t, u)
        h = out[s]
        np.multiply(t, z[:, 2 * n : 3 * n], out=h)
    return out


def _states(wx, wh, ids):
    """What _run gives without keeping anything: with a gate's rows side by side, so that no operation is on short pieces."""
    steps, rows = ids.shape
    n, real = wh.shape[0], wx.dtype
    out = np.empty((steps, n, rows), real)
    h, c = np.zeros((n, rows), real), np.zeros((n, rows), real)
    z, t, zx = np.empty((4 * n, rows), real), np.empty((4 * n, rows), real), np.empty((rows, 4 * n), real)
    u, v = np.empty((n, rows), real), np.empty((n, rows), real)
    wt, gates = np.ascontiguousarray(wh.T), z[: 3 * n]
    for s in range(steps):
        np.dot(wt, h, out=z)
        np.take(wx, ids[s], axis=0, out=zx, mode="clip")
        z += zx.T
        _bent(z, t)
        gates *= 0.5
        gates += 0.5
        c *= z[n : 2 * n]
        np.multiply(z[:n], z[3 * n :], out=u)
        c += u
        v[:] = c
        _bent(v, u)
        h = out[s]
        np.multiply(v, z[2 * n : 3 * n], out=h)
    return out.transpose(0, 2, 1)


def hidden(p: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of both directions for windows ids (steps, rows), padded at the end."""
    return _states(p["fx"], p["fh"], ids), _states(p["bx"], p["bh"], ids[::-1])[::-1]


def scores(p: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels' scores (steps, rows, labels)."""
    n = f.shape[2]
    return f @ p["wo"][:n] + b @ p["wo"][n:] + p["bo"]


def outside(p: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which windows surely have no span: none of any kind gains anything over staying outside.

    What a span ending here gains at most is followed for each kind: it begins
    here, at the best step into it, or goes on. Several spans gain less than
    nothing if each does.
    """
    steps, rows, n = f.shape
    over = p["wo"][:, 1:] - p["wo"][:, :1]
    gain = np.ascontiguousarray((over[:n].T @ f.transpose(0, 2, 1) + over[n:].T @ b.transpose(0, 2, 1)).transpose(1, 0, 2))
    gain += (p["bo"][1:] - p["bo"][0])[:, None, None]
    stay = p["step"][0, 0]
    gain[0::2] += np.maximum(p["step"][:, 1::2].max(axis=0) - stay, p["start"][1::2] - p["start"][0])[:, None, None]
    gain[1::2] += (p["step"][1:, 2::2].max(axis=0) - stay)[:, None, None]
    leave = max(0.0, float((p["step"][1:, 0] - stay).max()), float((p["end"][1:] - p["end"][0]).max()))
    run = np.full((len(gain) // 2, rows), -np.inf, np.float32)
    most = run.copy()
    for s in range(steps):
        run += gain[1::2, s]
        np.maximum(run, gain[0::2, s], out=run)
        np.maximum(most, run, out=most)
    return most.max(axis=0) + leave < 0


def decoded(p: dict, e: np.ndarray) -> np.ndarray:
    """The best labels (steps, rows) of windows of one length."""
    back = np.empty(e.shape, np.int8)
    v = p["start"] + e[0]
    for s in range(1, len(e)):
        paths = v[:, :, None] + p["step"]
        back[s] = paths.argmax(axis=1)
        v = paths.max(axis=1) + e[s]
    out = np.empty(e.shape[:2], np.int8)
    out[-1] = (v + p["end"]).argmax(axis=1)
    rows = np.arange(e.shape[1])
    for s in range(len(e) - 1, 0, -1):
        out[s - 1] = back[s, rows, out[s]]
    return out


def _sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _crf(p: dict, e, labels, mask):
    """Loss of labels, and gradients of scores, start, end and step; mask (steps, rows): what isn't padding, at the start of each window."""
    steps, rows, k = e.shape
    last = mask.sum(axis=0) - 1
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = p["start"] + e[0]
    for s in range(1, steps):
        a[s] = np.where(mask[s][:, None], _sum(a[s - 1][:, :, None] + p["step"], 1) + e[s], a[s - 1])
    z = _sum(a[-1] + p["end"], 1)
    b[-1] = p["end"]
    for s in range(steps - 1, 0, -1):
        b[s - 1] = np.where(mask[s][:, None], _sum(p["step"] + (e[s] + b[s])[:, None, :], 2), p["end"])
    at = np.arange(rows)
    gold = np.eye(k, dtype=np.float32)[labels] * mask[:, :, None]
    share = np.exp(a + b - z[:, None]) * mask[:, :, None]
    step = np.zeros_like(p["step"])
    loss = z - p["start"][labels[0]] - p["end"][labels[last, at]] - (e * gold).sum(axis=(0, 2))
    for s in range(1, steps):
        both = a[s - 1][:, :, None] + p["step"] + (e[s] + b[s])[:, None, :] - z[:, None, None]
        step += (np.exp(both) * mask[s][:, None, None]).sum(axis=0) - gold[s - 1].T @ gold[s]
        loss -= p["step"][labels[s - 1], labels[s]] * mask[s]
    end = share[last, at].sum(axis=0) - gold[last, at].sum(axis=0)
    return float(loss.mean()), share - gold, (share[0] - gold[0]).sum(axis=0), end, step


def _back(wx, wh, ids, out, keep, d):
    """Gradients of wx and wh from gradients d of the hidden states."""
    n = wh.shape[0]
    gx, gh, all_dz = np.zeros_like(wx), np.zeros_like(wh), np.empty((*ids.shape, 4 * n), wx.dtype)
    dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
    for s in range(len(ids) - 1, -1, -1):
        z, c0 = keep[s]
        i, f, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        t = c0 * f + i * g
        t = t / (1 + np.abs(t))
        slope = lambda x: (1 - np.abs(x)) ** 2
        dh = dh + d[s]
        dc = dc + dh * o * slope(t)
        dz = np.concatenate([dc * g * slope(2 * i - 1) / 2, dc * c0 * slope(2 * f - 1) / 2, dh * t * slope(2 * o - 1) / 2, dc * i * slope(g)], axis=1)
        all_dz[s] = dz
        if s:
            gh += out[s - 1].T @ dz
        dh, dc = dz @ wh.T, dc * f
    order = np.argsort(ids, axis=None, kind="stable")
    used, first = np.unique(ids.ravel()[order], return_index=True)
    gx[used] = np.add.reduceat(all_dz.reshape(-1, 4 * n)[order], first, axis=0)
    return gx, gh


def gradients(p: dict, ids, labels, mask):
    """Mean loss of windows (steps, rows), and the gradient of each parameter."""
    n, rows = p["fh"].shape[0], ids.shape[1]
    kept_f, kept_b = [], []
    f = _run(p["fx"], p["fh"], ids, kept_f)
    b = _run(p["bx"], p["bh"], ids[::-1], kept_b)
    both = np.concatenate([f, b[::-1]], axis=2)
    loss, de, start, end, step = _crf(p, both @ p["wo"] + p["bo"], labels, mask)
    d = de @ p["wo"].T
    g = {"wo": np.tensordot(both, de, ([0, 1], [0, 1])), "bo": de.sum(axis=(0, 1)), "start": start, "end": end, "step": step}
    g["fx"], g["fh"] = _back(p["fx"], p["fh"], ids, f, kept_f, d[:, :, :n])
    g["bx"], g["bh"] = _back(p["bx"], p["bh"], ids[::-1], b, kept_b, d[::-1, :, n:])
    return loss, {k: v / rows for k, v in g.items()}


def trained(ids: np.ndarray, labels: np.ndarray, kinds: int, hidden: int, rounds: int, rate: float = 0.03, rows: int = 128, seed: int = 7) -> dict:
    """Parameters fitted to windows ids with labels (windows, steps), padded with PAD, by Adam with a falling rate."""
    p = new(kinds, hidden, seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rnd, step, total = np.random.default_rng(seed), 0, rounds * -(-len(ids) // rows)
    for _ in range(rounds):
        order = rnd.permutation(len(ids))
        for at in range(0, len(ids), rows):
            some = order[at : at + rows]
            x = np.ascontiguousarray(ids[some].T)
            _, g = gradients(p, x, labels[some].T, x != PAD)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                fixed = (1 - 0.9**step), (1 - 0.99**step)
                p[k] -= (rate * (1 - step / (total + 1)) * (first[k] / fixed[0]) / (np.sqrt(second[k] / fixed[1]) + 1e-8)).astype(np.float32)
            closed(p)
    return p
