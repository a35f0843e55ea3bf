"""A character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans, and global decoding.

Training examples are (text, [(kind, start, end)]); `labelled_examples` makes them from a seed: spans of many spellings between
invented words, numbers that are nobody's (those among them that fail a check), and stretches of background texts. All labels are
of spans made here; no pattern labels anything, and a stretch that may hold personal data of its own is left out. The weights
beside this module were trained so (`python -m skein.llm.pii_model TABLE`, which writes them anew).

All characters of a text are scored in overlapping windows; where windows overlap, a character's scores are averaged with more
weight for window middles, and one Viterbi decoding of the whole text reconciles them, so that no window edge cuts a span. The
decoding is exact, but leaves out what is certain: see `certain`.
"""

from __future__ import annotations

import functools
import sys
from concurrent.futures import ProcessPoolExecutor
from pathlib import Path

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_MARKS = " \n.@_%+-()[]/:,=\"'<>&#"
#: Characters are letters (without case), one class for digits, one each for some marks, and one for the rest; 0 is padding.
_CLASS = {c: 2 + i for i, c in enumerate(_ALPHABET)} | {c.upper(): 2 + i for i, c in enumerate(_ALPHABET)} | {c: 28 for c in "0123456789"} | {c: 29 + i for i, c in enumerate(_MARKS)}
CLASSES = 29 + len(_MARKS)
_TABLE = np.array([_CLASS.get(chr(i), 1) for i in range(128)], np.uint8)
_BYTES = _TABLE.tobytes() + bytes(128)
EMBED, HIDDEN = 8, 8
#: Characters of a training example; of a window when texts are read, and how many it shares with the next.
EXAMPLE, WINDOW, OVERLAP = 96, 256, 32
#: Windows that are read together, times between which those that have ended are left out, times that are scored together, characters whose scores are held at once, and the largest transition score either way.
BATCH, PART, SCORED, HELD, TRANSITION = 1000, 16, 8, 400_000, 0.5
#: Weight in training of each character's tag by its own scores, beside the path's: so that O leads clearly in plain text.
ALONE = 0.5
#: What the scores of beginnings are lowered by: a span must be that much likelier than none.
CAUTION = 2.0
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
Model = dict[str, np.ndarray]


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    if text.isascii():
        return np.frombuffer(text.encode().translate(_BYTES), np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 1).astype(np.uint8)


def allowed() -> np.ndarray:
    """Forbidden transitions as large negative scores: I follows only B or I of its kind."""
    bad = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = -1e4
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return bad


START = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


# labelled examples


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, least: int = 2, most: int = 9) -> str:
    return "".join(_ALPHABET[i] for i in rng.integers(0, 26, rng.integers(least, most)))


def _hex(rng, n: int) -> str:
    return "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))


def _pick(rng, *choices):
    return choices[rng.integers(len(choices))]


def _email(rng) -> str:
    user = _pick(rng, _word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}_{_digits(rng, 2)}", f"{_word(rng)}.{_digits(rng, 2)}")
    host = _pick(rng, _word(rng, 3), f"mail{_digits(rng, 1)}.{_word(rng)}", f"{_word(rng)}-{_word(rng)}")
    end = _pick(rng, "com", "org", "net", "de", "fr", "es", "co.uk")
    at, dot = _pick(rng, ("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."))
    return user + at + (host + "." + end).replace(".", dot)


def _ip(rng) -> str:
    return _pick(rng, ".", ".", ".", "[.]", " . ").join(str(x) for x in rng.integers(0, 256, 4))


def _number(rng, sep: str, passes: bool) -> str:
    """Digits that pass the card check or fail it, in one run or in fours."""
    d = _digits(rng, 15 if sep else _pick(rng, 12, 13, 14, 15, 15, 15, 15, 18))
    last = next(c for c in range(10) if luhn(d + str(c)))
    d += str(last if passes else (last + rng.integers(1, 10)) % 10)
    return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if sep else d


def _card(rng) -> str:
    return _number(rng, _pick(rng, "", " ", "-", ".", "/", "_", " / "), True)


def _failed(rng) -> str:
    """What looks like a number of a kind and isn't one: it fails the card check, or a part is above 255."""
    parts = [str(x) for x in rng.integers(0, 256, 4)]
    parts[rng.integers(4)] = str(rng.integers(256, 1000))
    return _pick(rng, _number(rng, _pick(rng, "", "", "", " ", "-"), False), ".".join(parts))


def _phone(rng) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return _pick(rng, f"+{_digits(rng, 1)} ({a}) {b}-{c}", f"+{_digits(rng, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{_digits(rng, 2)} {a} {b} {c}", f"+{_digits(rng, 11)}")


_SECRET_NAMES = ("token", "api_key", "secret", "password", "apikey", "access_token", "passwd", "secret_key", "auth_key", "credential", "bearer", "session_token")


def _secret(rng) -> tuple[str, str]:
    """What comes before a secret, and the secret."""
    name, sep = _pick(rng, *_SECRET_NAMES), _pick(rng, " = ", "=", ": ", " : ")
    value, mark = _pick(rng, _hex(rng, 40), _hex(rng, 32), _hex(rng, 20), _word(rng, 5, 12) + _digits(rng, 6) + _word(rng, 5, 9)), _pick(rng, '"', '"', "'", "")
    return name + sep + mark, value


def _other(rng) -> str:
    """Numbers and marks that aren't personal."""
    n = rng.integers
    return _pick(
        rng, str(n(0, 10 ** n(1, 10))), f"20{n(10, 30)}-{n(10, 13)}-{n(10, 31)}", f"{n(1, 24)}:{n(10, 60)}", f"v{n(0, 9)}.{n(0, 30)}.{n(0, 9)}", f"{n(1, 999)}.{n(10, 99)}", _hex(rng, _pick(rng, 7, 16, 32, 40)), f"@{_word(rng)}", f"{n(1, 99)}%",
        f"({n(1, 99)})", f"version {n(1, 9)}.0.", f"[{n(1, 60)}]", f"{n(1, 9)},{n(100, 999)},{n(100, 999)}", "Licensed under CC BY-NC 4.0.", f"License, version {n(1, 4)}.", "token", "password", f"at {_word(rng)}", f"{_word(rng)}.{_word(rng)}", f"{_word(rng, 3)}.{_word(rng, 2, 4)}", f"[{_word(rng)}]", f"({_word(rng)})", f"CC BY-NC {n(1, 5)}.0", f"Version {n(1, 5)}.0.", f"{n(1900, 2030)}-{n(1900, 2030)}", f"+{n(1, 99)}", f"{n(1, 99)} - {n(1, 99)}", f"${n(1, 9999)}.{n(10, 99)}",
    )


def labelled_examples(n: int, seed: int, background: list[str] | None = None, doubtful=None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of EXAMPLE characters at most with their spans; a part of them are stretches of background texts, which have none: those that are doubtful, with 60 characters about them, aren't taken."""
    rng, out = np.random.default_rng(seed), []
    make = dict(zip(KINDS, (_email, _ip, _card, _phone), strict=False))
    background = [t for t in background or [] if t]
    while len(out) < n:
        text, spans = "", []
        after = _pick(rng, (" ",), (" ", " ", " ", ". ", ", ", ".\n"), ("!! ",), ("### ", "%%% ", "*** ", "&&& ", "$$$ "), (" | ",))
        upper = rng.random() < 0.08
        while len(text) < EXAMPLE - 30:
            draw = rng.random()
            if background and draw < 0.5:
                t = background[rng.integers(len(background))]
                at, size = int(rng.integers(0, max(1, len(t) - 8))), int(rng.integers(8, 70))
                item = t[at : at + size]
                if len(text) + len(item) > EXAMPLE or doubtful(t[max(0, at - 60) : at + size + 60]):
                    continue
                text += item + " "
                continue
            if draw < 0.68:
                kind = KINDS[rng.integers(len(KINDS))]
                if kind == "secret":
                    before, item = _secret(rng)
                    text += before
                else:
                    item = make[kind](rng)
                spans.append((kind, len(text), len(text) + len(item)))
                if kind == "secret" and before[-1] in "\"'":
                    item += before[-1]
            else:
                item = _failed(rng) if draw < 0.74 else _other(rng) if draw < 0.88 else _word(rng)
                if rng.random() < 0.15:
                    item = item.capitalize()
            text += item + _pick(rng, *after)
        if rng.random() < 0.5:
            text = text.rstrip()
        if len(text) <= EXAMPLE:
            out.append((text.upper() if upper and len(text.upper()) == len(text) else text, spans))
    return out


def _targets(examples) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(examples), EXAMPLE), np.int64), np.zeros((len(examples), EXAMPLE), np.int64)
    for i, (text, spans) in enumerate(examples):
        x[i, : len(text)] = encode(text)
        for kind, a, b in spans:
            y[i, a:b] = 2 + 2 * KINDS.index(kind)
            y[i, a] -= 1
    return x, y


# the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(seed: int) -> Model:
    rng, h = np.random.default_rng(seed), HIDDEN
    m = {"embed": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in ("f", "b"):
        m[f"{d}_w"] = rng.normal(0, (EMBED + h) ** -0.5, (EMBED + h, 4 * h))
        m[f"{d}_b"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    return m


def _lstm(e: np.ndarray, w: np.ndarray, b: np.ndarray):
    """Hidden states (time, batch, hidden) of inputs (time, batch, embedding), and what the backward pass needs too."""
    h = c = np.zeros((e.shape[1], HIDDEN), e.dtype)
    inputs = e @ w[:EMBED] + b
    out, kept = [], []
    for t in range(len(e)):
        z = inputs[t] + h @ w[EMBED:]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tanh_c = np.tanh(c)
        kept.append((h, before, i, f, o, g, tanh_c))
        h = o * tanh_c
        out.append(h)
    return np.stack(out), kept


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def _gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    n, time = x.shape
    length, at, each = (x > 0).sum(1), np.arange(time)[:, None], np.arange(n)[None]
    turned = np.where(at < length, length - 1 - at, at)  # the other way round, padding at the end as before
    e, x_back = m["embed"][x.T], x.T[turned, each]
    e_back = m["embed"][x_back]
    hf, kf = _lstm(e, m["f_w"], m["f_b"])
    hb, kb = _lstm(e_back, m["b_w"], m["b_b"])
    both = np.concatenate([hf, hb[turned, each]], 2)
    score, trans = both @ m["out"] + m["bias"], m["trans"] + allowed().astype(x.dtype if x.dtype.kind == "f" else m["trans"].dtype)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0] + START
    for t in range(1, time):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + score[t]
    for t in range(time - 2, -1, -1):
        beta[t] = _logsum((score[t + 1] + beta[t + 1])[:, None, :] + trans, 2)
    z = _logsum(alpha[-1], 1)
    rows = np.arange(n)
    gold = START[y[:, 0]] + sum(score[t, rows, y[:, t]] for t in range(time)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, time))
    d_score = np.exp(alpha + beta - z[None, :, None])
    d_trans = sum(np.exp(alpha[t - 1][:, :, None] + trans + (score[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0) for t in range(1, time))
    for t in range(time):
        d_score[t, rows, y[:, t]] -= 1
    np.subtract.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    own = score - _logsum(score, 2)[:, :, None]
    alone = -sum(own[t, rows, y[:, t]].sum() for t in range(time)) / n
    own = np.exp(own)
    for t in range(time):
        own[t, rows, y[:, t]] -= 1
    d_score = (d_score + ALONE * own) / n
    grads = {"trans": d_trans / n, "out": np.einsum("tnh,tnk->hk", both, d_score), "bias": d_score.sum((0, 1))}
    d_both = d_score @ m["out"].T
    d_embed = np.zeros_like(m["embed"])
    for name, kept, d_h, inputs, order in (("f", kf, d_both[:, :, :HIDDEN], e, x.T), ("b", kb, d_both[:, :, HIDDEN:][turned, each], e_back, x_back)):
        w, dw, db = m[f"{name}_w"], np.zeros_like(m[f"{name}_w"]), np.zeros_like(m[f"{name}_b"])
        next_h = next_c = np.zeros((n, HIDDEN))
        for t in range(time - 1, -1, -1):
            h, before, i, f, o, g, tanh_c = kept[t]
            dh = d_h[t] + next_h
            dc = next_c + dh * o * (1 - tanh_c**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1)
            next_c = dc * f
            dw[:EMBED] += inputs[t].T @ dz
            dw[EMBED:] += h.T @ dz
            db += dz.sum(0)
            next_h = dz @ w[EMBED:].T
            np.add.at(d_embed, order[t], dz @ w[:EMBED].T)
        grads |= {f"{name}_w": dw, f"{name}_b": db}
    return float((z - gold).mean() + ALONE * alone), grads | {"embed": d_embed}


def train(examples, steps: int = 300, batch: int = 48, rate: float = 0.02, seed: int = 7, say=None) -> Model:
    """A model fitted with Adam to labelled spans; transitions stay within TRANSITION."""
    m, rng = new_model(seed), np.random.default_rng(seed)
    x, y = _targets(examples)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), batch)
        loss, grads = _gradients(m, x[at], y[at])
        if say and step % 100 == 0:
            say(step, loss)
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / max(size, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] = m[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        m["trans"] = np.clip(m["trans"], -TRANSITION, TRANSITION)
    return m


def reading(m: Model) -> Model:
    """The weights as texts are read with: single precision, one matrix for hidden states, embeddings and bias, output gates first, and signs and factors such that all gates are 1 / (1 + exp)."""
    turned = -np.repeat([1.0, 2.0], [3 * HIDDEN, HIDDEN])
    gates = np.concatenate([np.arange(2 * HIDDEN, 3 * HIDDEN), np.arange(2 * HIDDEN), np.arange(3 * HIDDEN, 4 * HIDDEN)])
    turn = np.abs(m["out"][:, 2::2] - m["out"][:, 1::2]).sum(0) + np.abs(m["bias"][2::2] - m["bias"][1::2]) + CAUTION  # hidden states lie between -1 and 1
    out = {"turn": np.array([turn.max()]), "embed": m["embed"], "out": m["out"].T, "bias": m["bias"] - CAUTION * (np.arange(TAGS) % 2), "trans": m["trans"] + allowed()}
    for d in ("f", "b"):
        out[d] = (np.concatenate([m[f"{d}_w"][EMBED:], m[f"{d}_w"][:EMBED], m[f"{d}_b"][None]]) * turned).T[gates]
    return {k: np.ascontiguousarray(v, np.float32) for k, v in out.items()}


@functools.cache
def default_model() -> Model:
    """The stored weights, for reading."""
    with np.load(WEIGHTS) as f:
        return reading(dict(f))


# reading


def _states(joint: np.ndarray, embed: np.ndarray, codes: np.ndarray, live: list[int], out: np.ndarray, back: bool) -> None:
    """Hidden states (time, hidden, batch) of codes (time, batch), forwards or back, into out. live: how many windows, the first ones, have a character at each time; only these are read, by parts of PART times."""
    parts = [(t, min(t + PART, len(codes))) for t in range(0, len(codes), PART)]
    space, h, c = np.empty((3 * HIDDEN + 2 * EMBED + 1 + 4 * HIDDEN, max(live)), np.float32), *(np.zeros((HIDDEN, 0), np.float32) for _ in range(2))
    with np.errstate(over="ignore"):  # beyond all floats a sigmoid is 0
        for first, last in reversed(parts) if back else parts:
            n = live[first]
            if n != h.shape[1]:
                before, kept_h, kept_c = min(n, h.shape[1]), h.copy(), c.copy()
                rows = space.ravel()[: len(space) * n].reshape(-1, n)
                own, z, tmp = rows[: HIDDEN + EMBED + 1], rows[HIDDEN + EMBED + 1 : -HIDDEN - EMBED], rows[-HIDDEN - EMBED : -EMBED]  # own: hidden states, embeddings and a one for the bias; z: the gates and the cells
                own[-1] = 1
                h, e, chosen = own[:HIDDEN], own[HIDDEN:-1], rows[-EMBED:].reshape(n, EMBED)
                gates, sigmoids, o, i_f, g, g_c, c = z[: 4 * HIDDEN], z[: 3 * HIDDEN], z[:HIDDEN], z[HIDDEN : 3 * HIDDEN], z[3 * HIDDEN : 4 * HIDDEN], z[3 * HIDDEN :], z[4 * HIDDEN :]
                h[:, :before], c[:, :before] = kept_h[:, :before], kept_c[:, :before]
                h[:, before:] = c[:, before:] = 0
            for t in range(last - 1, first - 1, -1) if back else range(first, last):
                if back and (t + 1 == len(live) or live[t + 1] < live[t]):  # windows that end here begin here
                    new = slice(live[t + 1] if t + 1 < len(live) else 0, live[t])
                    h[:, new] = c[:, new] = 0
                embed.take(codes[t, :n], 0, chosen, "clip")
                e[:] = chosen.T
                np.dot(joint, own, gates)
                np.exp(gates, gates)
                np.add(gates, 1, gates)
                np.divide(1, sigmoids, sigmoids)
                np.divide(-4, g, g)
                np.add(g, 2, g)
                np.multiply(g_c, i_f, g_c)
                np.add(c, g, c)  # c is -2 times the cell
                np.exp(c, tmp)
                np.add(tmp, 1, tmp)
                np.divide(2, tmp, tmp)  # tanh is twice the sigmoid of twice its argument, less one
                np.subtract(tmp, 1, tmp)
                np.multiply(o, tmp, h)
                out[t, :, :n] = h


def _scored(m: Model, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (time, tags, batch) of windows of character classes, longest first, and by how much O leads (time, batch); after a window's end they are anything. Both directions begin with the window's own characters, so that what is read beside it changes nothing."""
    time, n = len(windows[0]), len(windows)
    codes = np.zeros((n, time), np.uint8)
    for j, w in enumerate(windows):
        codes[j, : len(w)] = w
    live = (n - np.searchsorted(np.array([len(w) for w in windows])[::-1], np.arange(time), side="right")).tolist()
    codes = np.ascontiguousarray(codes.T).astype(np.intp)
    both = np.empty((time, 2 * HIDDEN + 1, n), np.float32)  # hidden states of either direction and a one for the bias
    both[:, -1] = 1
    _states(m["f"], m["embed"], codes, live, both[:, :HIDDEN], False)
    _states(m["b"], m["embed"], codes, live, both[:, HIDDEN:-1], True)
    weights, score, lead = np.concatenate([m["out"], m["bias"][:, None]], 1), np.empty((time, TAGS, n), np.float32), np.empty((time, n), np.float32)
    for t in range(0, time, SCORED):
        own = score[t : t + SCORED, :, : live[t]]
        np.matmul(weights, both[t : t + SCORED, :, : live[t]], out=own)
        np.subtract(own[:, 0], own[:, 1:].max(1), out=lead[t : t + SCORED, : live[t]])
    return score, lead


def emissions(m: Model, windows: list[np.ndarray]) -> list[np.ndarray]:
    """Scores (characters, tags) of each of some windows, longest first."""
    score, _ = _scored(m, windows)
    return [score[: len(w), :, j] for j, w in enumerate(windows)]


def windows(n: int) -> list[tuple[int, int]]:
    """The windows (start, end) of a text of n characters: each shares OVERLAP characters with the next."""
    out, start = [], 0
    while start + WINDOW < n:
        out.append((start, start + WINDOW))
        start += WINDOW - OVERLAP
    return [*out, (start, n)] if n else []


def _read(m: Model, codes: list[np.ndarray]):
    """For each text by how much O leads at each character, and a function (text, start, end) that gives the scores (characters, tags) of a stretch. Where windows overlap, scores are averaged by two ramps that add up to one; the others stay as they were made."""
    at = [(k, a, b) for k, c in enumerate(codes) for a, b in windows(len(c))]
    sizes = np.array([b - a for _, a, b in at], int)
    order = np.argsort(-sizes, kind="stable")
    lead, edges, held = np.empty((len(at), WINDOW), np.float32), np.empty((2, len(at), TAGS, OVERLAP), np.float32), []  # edges: scores of each window's first and last OVERLAP characters
    place = np.empty(len(at), int)
    place[order] = np.arange(len(at))
    for i in range(0, len(at), BATCH):
        some = order[i : i + BATCH]
        score, own = _scored(m, [codes[k][a:b] for k, a, b in (at[j] for j in some.tolist())])
        held.append(score)
        lead[some, : len(own)] = own.T
        if len(score) >= OVERLAP:  # a shorter one overlaps with none
            edges[0, some] = score[:OVERLAP].transpose(2, 1, 0)
        if len(score) == WINDOW:  # a window with another after it is whole
            whole = int((sizes[some] == WINDOW).sum())
            edges[1, some[:whole]] = score[-OVERLAP:, :, :whole].transpose(2, 1, 0)
    later = np.flatnonzero([a > 0 for _, a, _ in at])
    mixed = edges[1, later - 1] * _RAMP[::-1] + edges[0, later] * _RAMP
    edges[0, later], lead[later, :OVERLAP] = mixed, mixed[:, 0] - mixed[:, 1:].max(1)
    counts = np.array([len(windows(len(c))) for c in codes], int)
    firsts, step = np.concatenate([[0], np.cumsum(counts)]).tolist(), WINDOW - OVERLAP

    def take(k: int, start: int, end: int) -> np.ndarray:
        out, x = np.empty((end - start, TAGS), np.float32), start
        while x < end:
            i = min(x // step, firsts[k + 1] - firsts[k] - 1)
            j, low = firsts[k] + i, i * step
            high = min(end, len(codes[k]) if j + 1 == firsts[k + 1] else low + step)
            cut = min(max(x, low + OVERLAP), high) if i else x
            out[x - start : cut - start] = edges[0, j, :, x - low : cut - low].T
            out[cut - start : high - start] = held[place[j] // BATCH][cut - low : high - low, :, place[j] % BATCH]
            x = high
        return out

    leads = []
    for k, (i, j) in enumerate(zip(firsts, firsts[1:], strict=False)):
        leads.append(np.concatenate([lead[i : j - 1, :step].ravel(), lead[j - 1, : len(codes[k]) - (j - 1 - i) * step]]) if i < j else np.zeros(0, np.float32))
    return leads, take


def text_scores(m: Model, texts: list[str]) -> list[np.ndarray]:
    """Scores (characters, tags) of each text, averaged over the windows that hold a character."""
    _, take = _read(m, [encode(t) for t in texts])
    return [take(k, 0, len(t)) for k, t in enumerate(texts)]


_RAMP = ((np.arange(OVERLAP) + 1) / (OVERLAP + 1)).astype(np.float32)


def runs(held: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch that holds."""
    edged = np.zeros(len(held) + 2, bool)
    edged[1:-1] = held
    at = np.flatnonzero(edged[1:] != edged[:-1]).tolist()
    return list(zip(at[::2], at[1::2], strict=True))


def certain(m: Model, lead: np.ndarray, d: float, begins: bool = True, ends: bool = True) -> list[tuple[int, int]]:
    """Stretches in which every best path has O, by how much O leads at each character; not all such characters are found.

    Let r be the range of allowed transitions, and a run be characters where O leads by more than 2r. A part of a path in other
    tags, between two O within a run, would gain by O instead: each character more than 2r, each of its transitions r at most.
    And a path can't be in other tags throughout a run's beginning, if the leads there less r each exceed d + 3r, where d is the
    most that turning an I after it into a B can cost; nor throughout an end. So all between a beginning and an end is O. Paths
    that begin with the scores (of a whole text, or after an O) need no beginning, those that end with the text no end.
    """
    ok = m["trans"][m["trans"] > -1e3]
    r = float(max(ok.max(), 0.0) - min(ok.min(), 0.0))
    at = runs(lead > 2 * r)
    if not at:
        return []
    low, high = np.array(at).T
    sums = np.concatenate([[0.0], np.cumsum(np.where(lead > 2 * r, lead - r, 0), dtype=np.float64)])  # of runs alone, so that it never falls
    first, last = np.searchsorted(sums, sums[low] + d + 3 * r, side="right"), np.searchsorted(sums, sums[high] - d - 3 * r, side="left") - 1
    if begins and low[0] == 0:
        first[0] = 0
    if ends and high[-1] == len(lead):
        last[-1] = len(lead)
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if a < b]


def viterbi(trans: np.ndarray, scores: list[np.ndarray], start: list[bool], batch: int = 512) -> list[np.ndarray]:
    """The best tags of each stretch of scores; start: whether it begins a text, else an O comes before it. Stretches of like length go together."""
    out = [np.zeros(0, np.int64)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
    while order:
        time = len(scores[order[-1]])
        own = [k for k in order[-max(1, min(batch, (1 << 20) // time)) :] if 2 * len(scores[k]) >= time]
        order = order[: -len(own)]
        lengths = np.array([len(scores[k]) for k in own])
        padded = np.zeros((time, len(own), TAGS), np.float32)
        for j, k in enumerate(own):
            padded[: len(scores[k]), j] = scores[k]
        begins = np.where(np.array([start[k] for k in own])[:, None], START, trans[0]).astype(np.float32)
        best, back, at = padded[0] + begins, np.zeros((time, len(own), TAGS), np.int8), np.zeros(len(own), np.int64)
        for t in range(time):
            if t:
                steps = best[:, :, None] + trans
                back[t] = steps.argmax(1)
                best = steps.max(1) + padded[t]
            for j in np.flatnonzero(lengths == t + 1).tolist():
                at[j] = int((best[j] + trans[:, 0]).argmax())
        for j, k in enumerate(own):
            tags, tag = np.empty(lengths[j], np.int64), int(at[j])
            for t in range(int(lengths[j]) - 1, -1, -1):
                tags[t] = tag
                tag = back[t, j, tag]
            out[k] = tags
    return out


def _decoded(m: Model, leads: list[np.ndarray], take, turns: list[float], begins: bool = True) -> list[np.ndarray]:
    """The best tags of each text (begins: not after an O) from what _read gives. turns: the most that turning an I into a B can cost. What is certainly O cuts a text into stretches, which are decoded apart; an end of a text is as good as an O after it."""
    tags = [np.zeros(len(x), np.uint8) for x in leads]
    places: list[tuple[int, int, int]] = []
    for k, (x, d) in enumerate(zip(leads, turns, strict=True)):
        sure = certain(m, x, d, begins)
        places += [(k, a, b) for a, b in zip([0, *(b for _, b in sure)], [*(a for a, _ in sure), len(x)], strict=True) if a < b]
    found = viterbi(m["trans"], [np.concatenate([take(k, a, b), _END[None]]) if b == len(leads[k]) else take(k, a, b) for k, a, b in places], [a == 0 and begins for _, a, _ in places])
    for (k, a, b), t in zip(places, found, strict=True):
        tags[k][a:b] = t[: b - a]
    return tags


def _lead(score: np.ndarray) -> np.ndarray:
    """By how much O leads at each character."""
    return score[:, 0] - score[:, 1:].max(1)


def decode(m: Model, scores: list[np.ndarray], begins: bool = True) -> list[np.ndarray]:
    """The best tags of each text (begins: not after an O) from any scores."""
    return _decoded(m, [_lead(s) for s in scores], lambda k, a, b: scores[k][a:b], [max(0.0, float((s[:, 2::2] - s[:, 1::2]).max(initial=0.0))) for s in scores], begins)


def _found(m: Model, texts: list[str]) -> list[np.ndarray]:
    """The best tags of texts that are read together."""
    return _decoded(m, *_read(m, [encode(t) for t in texts]), [float(m["turn"][0])] * len(texts))


#: After a text's last character: O alone.
_END = np.array([0.0] + [-1e6] * (TAGS - 1), np.float32)


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for t in np.flatnonzero(tags & 1).tolist():
        end, inside = t + 1, tags[t] + 1
        while end < len(tags) and tags[end] == inside:
            end += 1
        out.append((KINDS[(tags[t] - 1) // 2], t, end))
    return out


def find(m: Model, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The spans that the model finds in each text; texts are read together up to HELD characters, longer ones a part at a time."""
    out: list[list[tuple[str, int, int]]] = []
    now: list[str] = []
    for t in [*texts, None]:
        if now and (t is None or len(t) > HELD or sum(map(len, now)) + len(t) > HELD):
            out += [spans_of(tags) for tags in _found(m, now)]
            now = []
        if t is not None and len(t) > HELD:
            out.append(spans_of(long_tags(m, t)))
        elif t is not None:
            now.append(t)
    return out


def long_tags(m: Model, text: str, held: int = HELD) -> np.ndarray:
    """The tags of decode for one text, in bounded memory: windows are taken some at a time, and the text is cut at the last character that is certainly O."""
    codes, tags, begins = encode(text), np.zeros(len(text), np.uint8), True
    at, step, done = windows(len(codes)), max(1, held // WINDOW), 0  # done: characters decoded
    tail, open_ = np.zeros((0, TAGS), np.float32), np.zeros((0, TAGS), np.float32)  # scores from done on, and the sums that the next window adds to
    for i in range(0, len(at), step):
        some = at[i : i + step]
        first, last = some[0][0], some[-1][1]
        _, take = _read(m, [codes[first:last]])
        new = take(0, 0, last - first)
        if i:
            new[:OVERLAP] = new[:OVERLAP] * _RAMP[:, None] + open_ * _RAMP[::-1, None]
        whole = len(new) if last == len(codes) else len(new) - OVERLAP
        tail, open_ = np.concatenate([tail, new[:whole]]), new[whole:]
        if last == len(codes):
            tags[done:] = decode(m, [tail], begins)[0]
        else:
            sure = certain(m, _lead(tail), float(m["turn"][0]), begins, False)
            if sure:
                cut = sure[-1][1] - 1
                tags[done : done + cut] = decode(m, [np.concatenate([tail[:cut], _END[None]])], begins)[0][:cut]
                tail, done, begins = tail[cut:], done + cut, cut == 0 and begins
    return tags


def _start(job: tuple[list, int, int]) -> Model:
    examples, steps, seed = job
    return train(examples, steps, 64, 0.02, seed)


def main(table: str, steps: int = 1900, starts: int = 7, examples: int = 30_000, sample: int = 2000, seed: int = 11) -> None:
    """Train on generated spans between stretches of a bounded sample of a table's texts, from several starts, and store the weights whose loss on other generated examples is least."""
    import pyarrow.dataset as ds

    from .pii import doubtful

    texts = ds.dataset(table).head(sample, columns=["text"])["text"].to_pylist()
    made, held = labelled_examples(examples, seed, texts, doubtful), _targets(labelled_examples(1000, seed + 1, texts, doubtful))
    with ProcessPoolExecutor(starts) as pool:
        models = list(pool.map(_start, [(made, steps, k) for k in range(7, 7 + starts)]))
    losses = [_gradients(m, *held)[0] for m in models]
    print(losses, flush=True)
    m = models[int(np.argmin(losses))]
    np.savez(WEIGHTS, **{k: v.astype(np.float32) for k, v in m.items()})


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
