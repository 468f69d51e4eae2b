"""Personal data: fixed patterns, and a character BiLSTM with a CRF for the forms that they miss.

The network reads every character of every text, in windows of ``WINDOW`` characters that overlap by ``OVERLAP``.  Where its scores leave
room for a span, that part is decoded by the CRF's best path.  The spans of
all windows of a text are reconciled by the choice of non-overlapping spans with the largest total score.  Spans need a gain over "outside" of
``MIN_GAIN``, must not be longer than their kind can be (``LONGEST``) nor touch a span of the patterns, which always stay, and a card's digits
must pass Luhn, a sum that no such network forms.

A span of up to OVERLAP characters is whole in some window.  Where a decoded span touches a window's edge, that place is read again in a
window of ``WIDE`` characters, which holds any span of up to ``(WIDE - CELL) // 2`` = 768 characters there whole.

The cell's gates are piecewise linear (clipped to 0..1 and -1..1), which costs a fraction of exponentials.
The network is trained in numpy, on the driver, from labelled spans: ``N_BATCHES`` batches of examples made by rule
from a seed, or examples given by the caller.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
HIDDEN, BATCH, N_BATCHES, RATE = 12, 64, 2400, 0.01
WINDOW, OVERLAP, MIN_GAIN = 1536, 128, 12.0
#: Characters that a span of each kind has at most: an address by its standard, numbers with room for separators.
LONGEST = {"email": 254, "ip": 45, "card": 40, "phone": 40}
#: Characters of a labelled example; of a window around a place where a span touched an edge, and of the cells that such places are gathered by.
EXAMPLE, WIDE, CELL = 96, 1632, 96
#: Windows read at once; characters around a possible span that are decoded with it.
CHUNK, AROUND = 512, 48

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, which stays linear on long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m.group())]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# The network's alphabet: padding, other letters, other characters, then these one by one.
SINGLE = "abcdefghijklmnopqrstuvwxyz \n@.-+():/,;=\"'[]{}<>#*_$%&|!?"
PAD, LETTER, OTHER = 0, 1, 2
_ascii = np.full(128, OTHER, np.uint8)
for _k, _c in enumerate(SINGLE):
    _ascii[ord(_c)] = _ascii[ord(_c.upper())] = 4 + _k
_ascii[48:58] = 3
SYMBOLS = 4 + len(SINGLE)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _ascii[np.minimum(codes, 127)], np.uint8(LETTER))


def labelled_examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Examples made by rule: windows of symbols and their tags (0 outside, then begin and inside of each kind)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    # Common pairs of letters and common small words of four languages.
    pairs = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie un la el qu ue os ei ge sch au ó é ä ü ß ñ".split()
    small = "the of and to in is that it was for on are as with his they at be this have from or one had by but not what all were we when there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now over than thing those here where just through after most der die das und zu ein ist von mit den la le les des et un une que pour dans est el los y en del por con".split()
    plain = lambda: "".join(r.choice("bcdfghlmnprstw") + r.choice(["a", "e", "i", "o", "u", "en", "er", "é", "ü", "ió"]) for _ in range(r.randint(1, 4)))
    dense = lambda: "".join(r.choice(pairs) for _ in range(r.randint(1, 5)))
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "aeiou" * 6 + "àâçèéêîôùûüäößñáíóúæœ"
    loose = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    # Made of few pairs, so that pairs come again and again, as in inflected words.
    few = ["".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(600)]
    echo = lambda: "".join(few[int(600 * r.random() ** 2)] for _ in range(r.randint(1, 4)))
    word = lambda: r.choice([plain, dense, dense, lambda: r.choice(small), loose, echo, echo])()
    sentence = lambda: " ".join(word() for _ in range(r.randint(3, 9))).capitalize()
    glue = lambda: r.choice([" "] * 8 + [", ", ". ", "\n", "### ", "$$$ ", "*** ", "%%% ", "!! ", " | ", "&&& ", ": "])
    octet = lambda: str(r.randint(0, 255))

    def card() -> str:
        body = r.choice("3456") + d(r.choice([12, 13, 14, 14, 14, 15]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spaced(s: str, sep: str, k: int = 4) -> str:
        return sep.join(s[i : i + k] for i in range(0, len(s), k))

    tlds = ["com", "net", "org", "de", "es", "fr", "edu", "io", "info", "co.uk", "example.com"]
    host = lambda: f"{word()}{r.choice(['', d(1)])}.{r.choice(tlds)}"
    user = lambda: r.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}_{word()}", d(2)])
    at = lambda: r.choice(["[at]", "(at)", " [at] ", " (at) ", "{at}", " @ ", "<at>", " [AT] "])
    dot = lambda: r.choice([".", ".", "[dot]", " [dot] ", " (dot) ", "(dot)"])
    area = lambda: str(r.randint(200, 989))
    cased = lambda s: r.choice([s, s, s.upper()])
    positive = [
        lambda: ("email", f"{user()}@{host()}"),
        lambda: ("email", f"{user()}{at()}{word()}{dot()}{r.choice(tlds[:9])}"),
        lambda: ("email", f"{user()}{at()}{word()}{dot()}{word()}{dot()}{r.choice(tlds[:9])}"),
        lambda: ("email", cased(f"{user()} at {word()} dot {r.choice(tlds[:9])}")),
        lambda: ("email", cased(f"{user()} at {word()} dot {word()} dot {r.choice(tlds[:9])}")),
        lambda: ("email", cased(f"{word()} dot {word()} at {word()} dot {r.choice(tlds[:9])}")),
        lambda: ("ip", ".".join(octet() for _ in range(4))),
        lambda: ("ip", ":".join(f"{r.getrandbits(16):x}" for _ in range(8))),
        lambda: ("ip", f"2001:{r.getrandbits(16):x}::{r.getrandbits(16):x}"),
        lambda: ("card", card()),
        lambda: ("card", spaced(card(), r.choice([" ", "-", ".", "/", "  "]))),
        lambda: ("phone", f"({area()}) 555-{d(4)}"),
        lambda: ("phone", f"({area()}) {area()}-{d(4)}"),
        lambda: ("phone", f"({area()}){area()}-{d(4)}"),
        lambda: ("phone", f"{area()}-{area()}-{d(4)}"),
        lambda: ("phone", f"{area()}.{area()}.{d(4)}"),
        lambda: ("phone", f"{area()} {area()} {d(4)}"),
        lambda: ("phone", f"1-{area()}-{area()}-{d(4)}"),
        lambda: ("phone", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}"),
        lambda: ("phone", f"+{r.randint(1, 99)} (0) {d(2)} {d(7)}"),
        lambda: ("phone", f"00{r.randint(1, 99)} {d(2)} {d(7)}"),
        lambda: ("phone", f"0{d(2)}/{d(7)}"),
        lambda: ("phone", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"),
    ]
    negative = [
        lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}",
        lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
        lambda: f"{r.randint(0, 30)}.{r.randint(0, 30)}" + r.choice(["", f".{r.randint(0, 30)}"]),
        lambda: f"Version {r.randint(0, 9)}.{r.randint(0, 9)}.",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40]))),
        lambda: f"token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"",
        lambda: d(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9])),
        lambda: f"${r.randint(1, 999)},{d(3)}.{d(2)}",
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{r.randint(1900, 2020)}-{r.randint(1900, 2020)}",
        lambda: f"@{word()}",
        lambda: f"{word()} @ {r.randint(1, 99)} {word()}",
        lambda: f"{word()}{d(2)}",
        lambda: f"({r.randint(1, 999)})",
        lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"No. {d(10)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{word()} at {word()} {word()}",
        lambda: f"{word()} at {word()}. {word()}",
        lambda: f"{word()} dot {word()}",
        lambda: r.choice([" ", " ", ". ", ", "]).join([r.choice(["at", "dot", word(), word(), word() + "at"])] * r.choice([4, 12, 40])),
        lambda: f"{word()} {r.choice(['at', 'dot'])} {word()} {word()}, {word()} dot",
        lambda: f"{d(3)},{d(3)},{d(3)}",
        lambda: f"{''.join(r.choice('0123456789abcdef') for _ in range(8))}-{d(4)}-4{d(3)}-{d(4)}-{d(12)}",
    ]
    xs, ys = np.zeros((n, EXAMPLE), np.int64), np.zeros((n, EXAMPLE), np.int64)
    for k in range(n):
        text, tags = "", []
        skip = r.randint(0, 20)
        while len(text) < EXAMPLE + skip:
            p = r.random()
            if skip % 4 == 0 and p > 0.3:
                s = sentence()
                tags += [0] * len(s)
            elif p < 0.2:
                kind, s = r.choice(positive)()
                i = 1 + 2 * KINDS.index(kind)
                tags += [i] + [i + 1] * (len(s) - 1)
            else:
                s = r.choice(negative)() if p < 0.4 else word() if r.random() < 0.8 else word().upper()
                tags += [0] * len(s)
            text += s
            g = glue()
            text += g
            tags += [0] * len(g)
        end = EXAMPLE + skip if r.random() < 0.8 else skip + r.randint(20, EXAMPLE)
        cut = slice(skip, end)
        got, tag = symbols(text[cut]), tags[cut]
        xs[k, : len(got)], ys[k, : len(tag)] = got, tag
        first = ys[k, 0]
        if first and first % 2 == 0:
            ys[k, 0] = first - 1
    return xs, ys


def _lstm(x: np.ndarray, p: dict, keep: bool = False):
    """Both directions at once: states (length, 2, batch, hidden); direction 1 reads from the end.

    The cell's input gate is one less its forget gate, so what it holds stays within -1..1 like its input.
    """
    n, length = x.shape
    both = np.stack([x.T, x.T[::-1]])
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    states, kept = np.empty((length, 2, n, HIDDEN), np.float32), []
    for t in range(length):
        z = np.stack([p["in"][0][both[0, t]], p["in"][1][both[1, t]]]) + h @ p["rec"]
        s = np.clip(0.25 * z[..., : 2 * HIDDEN] + 0.5, 0, 1)
        g = np.clip(z[..., 2 * HIDDEN :], -1, 1)
        f, o = s[..., :HIDDEN], s[..., HIDDEN:]
        before, above = c, h
        c = g + f * (c - g)
        if keep:
            kept.append((s, g, before, c, above))
        h = o * c
        states[t] = h
    return states, both, kept


def emissions(x: np.ndarray, p: dict, keep: bool = False):
    """Scores (batch, length, TAGS) of windows of symbols."""
    states, both, kept = _lstm(x, p, keep)
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
    out = joined @ p["out"] + p["bias"]
    return (out, joined, both, kept) if keep else out


def _crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the mean negative log likelihood over emissions and transitions."""
    n, length, _ = e.shape
    top = e.max(2, keepdims=True)
    b, a = np.exp(e - top), np.exp(trans)
    alpha, scale = np.empty_like(e), np.empty((n, length), e.dtype)
    for t in range(length):
        v = b[:, t] if t == 0 else (alpha[:, t - 1] @ a) * b[:, t]
        scale[:, t] = v.sum(1)
        alpha[:, t] = v / scale[:, t, None]
    beta, pairs = np.ones((n, e.shape[2]), e.dtype), np.zeros_like(trans)
    marginal = np.empty_like(e)
    for t in range(length - 1, -1, -1):
        marginal[:, t] = alpha[:, t] * beta
        if t:
            ahead = b[:, t] * beta / scale[:, t, None]
            pairs += a * (alpha[:, t - 1].T @ ahead)
            beta = ahead @ a.T
    rows, cols = np.arange(n)[:, None], np.arange(length)[None, :]
    gold = e[rows, cols, y].sum() + trans[y[:, :-1], y[:, 1:]].sum()
    loss = float((np.log(scale).sum() + top.sum() - gold) / n)
    marginal[rows, cols, y] -= 1
    np.add.at(pairs, (y[:, :-1], y[:, 1:]), -1)
    return marginal / n, pairs / n, loss


def _gradients(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[dict, float]:
    e, joined, both, kept = emissions(x, p, keep=True)
    de, dtrans, loss = _crf_gradient(e, y, p["trans"])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["trans"] = dtrans
    g["out"] = joined.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
    g["bias"] = de.sum((0, 1))
    dj = (de @ p["out"].T).transpose(1, 0, 2)
    ds = np.stack([dj[..., :HIDDEN], dj[::-1, :, HIDDEN:]], axis=1)
    dh, dc = np.zeros_like(ds[0]), np.zeros_like(ds[0])
    turned = p["rec"].transpose(0, 2, 1)
    for t in range(len(kept) - 1, -1, -1):
        s, into, before, c, h = kept[t]
        f, o = s[..., :HIDDEN], s[..., HIDDEN:]
        dh = dh + ds[t]
        dc = dc + dh * o
        dgate = np.concatenate([dc * (before - into), dh * c], axis=2) * ((s > 0) & (s < 1)) * 0.25
        dz = np.concatenate([dgate, dc * (1 - f) * ((into > -1) & (into < 1))], axis=2)
        g["rec"] += h.transpose(0, 2, 1) @ dz
        for k in (0, 1):
            np.add.at(g["in"][k], both[k, t], dz[k])
        dh, dc = dz @ turned, dc * f
    return g, loss


def train(examples: tuple[np.ndarray, np.ndarray] | None = None, batches: int = N_BATCHES, seed: int = 3) -> dict:
    """Weights from labelled windows (``examples``: symbols and tags; by default made by rule), with Adam."""
    rng = np.random.default_rng(seed)
    x, y = examples if examples is not None else labelled_examples(8192, seed)
    p = {
        "in": rng.normal(0, 0.2, (2, SYMBOLS, 3 * HIDDEN)), "rec": rng.normal(0, 0.2, (2, HIDDEN, 3 * HIDDEN)),
        "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)),
    }
    p["in"][:, :, :HIDDEN] += 0.5
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, batches + 1):
        some = rng.integers(0, len(x), BATCH)
        g, _ = _gradients(x[some], y[some], p)
        norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (batches + 1)))
        for k in p:
            w = g[k] * min(1.0, 5 / (norm + 1e-9))
            m[k] += 0.1 * (w - m[k])
            v[k] += 0.01 * (w * w - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


@lru_cache(maxsize=1)
def model() -> dict:
    return train()


def best_paths(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The CRF's best tags (batch, length); an inside tag only follows its begin or inside tag."""
    allowed = trans.copy()
    for b in range(TAGS):
        if b and b % 2 == 0:
            for a in range(TAGS):
                if a not in (b, b - 1):
                    allowed[a, b] = -1e4
    n, length, _ = e.shape
    score = e[:, 0].copy()
    score[:, 2::2] = -1e4
    back = np.empty((length, n, TAGS), np.int8)
    for t in range(1, length):
        total = score[:, :, None] + allowed[None]
        back[t] = total.argmax(1)
        score = total.max(1) + e[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


class Scanner:
    """The network with its weights laid out for reading many windows of different lengths at once."""

    def __init__(self, p: dict):
        gates = np.repeat(np.float32([0.25, 1.0]), [2 * HIDDEN, HIDDEN])
        shift = np.repeat(np.float32([0.5, 0.0]), [2 * HIDDEN, HIDDEN])
        self.inputs = (p["in"] * gates + shift).astype(np.float32)
        self.rec = (p["rec"] * gates).astype(np.float32)
        self.out, self.bias, self.trans = p["out"].astype(np.float32), p["bias"].astype(np.float32), p["trans"].astype(np.float32)

    def scores(self, windows: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number of the window, start in it, scores by place and tag) of those parts of windows that may hold a span."""
        order = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
        for at in range(0, len(order), CHUNK):
            some = order[at : at + CHUNK]
            sizes = np.array([len(windows[k]) for k in some])
            n, length = len(some), int(sizes[0])
            x = np.zeros((2, n, length), np.uint8)
            for r, k in enumerate(some):
                x[0, r, : sizes[r]] = windows[k]
                x[1, r, : sizes[r]] = windows[k][::-1]
            x = np.ascontiguousarray(x.transpose(2, 0, 1))
            left, right = self._run(x, n - np.searchsorted(sizes[::-1], np.arange(length), side="right"))
            for r, k in enumerate(some):
                e = left[: sizes[r], r] + right[: sizes[r], r][::-1]
                for a, b in stretches(lead(e)):
                    yield k, a, e[a:b]

    def _run(self, x: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, _, n = x.shape
        h2 = 2 * HIDDEN
        states = np.zeros((length, 2, n, HIDDEN), np.float32)
        c = np.zeros((2, n, HIDDEN), np.float32)
        z, y = np.empty((2, 2, n, 3 * HIDDEN), np.float32)
        for t, k in enumerate(active.tolist()):
            now, held = z[:, :k], c[:, :k]
            for side in (0, 1):
                self.inputs[side].take(x[t, side, :k], axis=0, out=now[side], mode="clip")
            if t:
                now += np.matmul(states[t - 1][:, :k], self.rec, out=y[:, :k])
            gates, into = now[..., :h2], now[..., h2:]
            np.maximum(gates, 0, out=gates)
            np.maximum(into, -1, out=into)
            np.minimum(now, 1, out=now)
            held -= into
            held *= now[..., :HIDDEN]
            held += into
            np.multiply(now[..., HIDDEN:h2], held, out=states[t][:, :k])
        return states[:, 0] @ self.out[:HIDDEN] + self.bias, states[:, 1] @ self.out[HIDDEN:]


def lead(e: np.ndarray) -> np.ndarray:
    """By how much the best other tag is ahead of outside, at each place."""
    m = e[:, 1:5]
    m = np.maximum(m, e[:, 5:])
    m = np.maximum(m[:, :2], m[:, 2:])
    return np.maximum(m[:, 0], m[:, 1]) - e[:, 0]


def stretches(ahead: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a window to decode.  A span's gain is at most the sum of ``ahead`` over its places, so only runs of places whose sum reaches MIN_GAIN matter."""
    upto = np.cumsum(ahead)
    before = np.concatenate(([0.0], upto[:-1]))
    least = np.minimum.accumulate(before)
    ends = np.flatnonzero(upto - least >= MIN_GAIN)
    if not len(ends):
        return []
    starts = np.maximum.accumulate(np.where(before <= least, np.arange(len(ahead)), 0))[ends]
    out: list[list[int]] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if out and a - 2 * AROUND <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(max(0, a - AROUND), min(len(ahead), b + AROUND + 1)) for a, b in out]


def windows(length: int) -> list[int]:
    """Starts of the windows over a text of this length."""
    return [] if not length else list(range(0, max(1, length - OVERLAP), WINDOW - OVERLAP))


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The non-overlapping spans with the largest total score."""
    best: dict[tuple[str, int, int], float] = {}
    for kind, a, b, s in spans:
        best[kind, a, b] = max(s, best.get((kind, a, b), 0.0))
    rows = sorted(best.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [k[2] for k, _ in rows]
    total, take = [0.0], []
    from bisect import bisect_right

    for n, ((_, a, _), s) in enumerate(rows):
        before = bisect_right(ends, a, 0, n)
        with_it = total[before] + max(s, 1e-6)
        take.append(before if with_it > total[-1] else -1)
        total.append(max(with_it, total[-1]))
    out, n = [], len(rows)
    while n:
        if take[n - 1] < 0:
            n -= 1
        else:
            out.append(rows[n - 1][0])
            n = take[n - 1]
    return out[::-1]


def _decoded(scanner: Scanner, found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, str, int, int, float]]:
    """Spans of windows: (number of the window, kind, start and end in it, gain over outside)."""
    bands: dict[int, list] = {}
    for part in found:
        bands.setdefault((len(part[2]) - 1).bit_length(), []).append(part)
    for some in (band[at : at + CHUNK] for band in bands.values() for at in range(0, len(band), CHUNK)):
        scores = np.full((len(some), max(len(x[2]) for x in some), TAGS), -1e4, np.float32)
        scores[..., 0] = 0
        for r, (_, _, e) in enumerate(some):
            scores[r, : len(e)] = e
        tags = best_paths(scores, scanner.trans)
        for r in np.flatnonzero(tags.any(1)):
            k, a, e = some[r]
            row = tags[r]
            for b in np.flatnonzero(row % 2 == 1).tolist():
                end = b + 1
                while end < len(e) and row[end] == row[b] + 1:
                    end += 1
                places = np.arange(b, end)
                yield k, KINDS[(row[b] - 1) // 2], a + b, a + end, float((e[places, row[places]] - e[places, 0]).sum())


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], scanner: Scanner) -> list[list[tuple[str, int, int]]]:
    """Per text the network's spans that have gain enough and touch none of its base spans."""
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    codes = [symbols(t) for t in texts]
    touched: set[tuple[int, int]] = set()

    def read(places: list[tuple[int, int]], width: int) -> None:
        for k, kind, b, end, gain in _decoded(scanner, scanner.scores([codes[t][a : a + width] for t, a in places])):
            t, a = places[k]
            if (b == 0 and a > 0) or (a + end < len(texts[t]) and end == width):
                if width < WIDE:
                    touched.add((t, (a if b == 0 else a + end) // CELL))
            else:
                found[t].append((kind, a + b, a + end, gain))

    places = [(t, a) for t, x in enumerate(texts) for a in windows(len(x))]
    for at in range(0, len(places), 8 * CHUNK):
        read(places[at : at + 8 * CHUNK], WINDOW)
    wide = [(t, max(0, cell * CELL - (WIDE - CELL) // 2)) for t, cell in sorted(touched)]
    for at in range(0, len(wide), CHUNK):
        read(wide[at : at + CHUNK], WIDE)
    out = []
    for text, spans, fixed in zip(texts, found, base):
        trimmed = []
        for kind, a, b, gain in spans:
            while a < b and text[a] in " \n\t,;:\"'":
                a += 1
            while b > a and text[b - 1] in " \n\t,;:\"'.!?#$&|*%":
                b -= 1
            card = kind != "card" or luhn(NOT_DIGIT.sub("", text[a:b]))
            if a < b <= a + LONGEST[kind] and card and gain >= MIN_GAIN and not any(x < b and a < y for _, x, y in fixed):
                trimmed.append((kind, a, b, gain))
        out.append(reconcile(trimmed))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _portions(texts: list[str]) -> Iterator[slice]:
    """Texts in order, some million characters at a time (or one longer text)."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > 4_000_000:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    yield slice(at, len(texts))


SPANS = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def find(docs: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, weights: dict | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``) and ``__pii``: counts of base spans per kind, base_sha256, spans (base and added).

    Null and empty texts have no spans.  Positions count code points, ends are exclusive.  Repeated rows get the same spans each.
    """
    ship(docs.sparkSession)
    p = weights or model()

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(p)
        for s in texts:
            rows = [x or "" for x in s]
            base = [base_spans(x) for x in rows]
            more = [y for some in _portions(rows) for y in added_spans(rows[some], base[some], scanner)]
            out = []
            for b, m in zip(base, more):
                out.append([*(sum(x[0] == k for x in b) for k in KINDS), hashlib.sha256(_join(b).encode()).hexdigest(), _join(b + m)])
            yield pd.DataFrame(out, columns=SPANS.names)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    cols = docs.columns if keep_cols is None else keep_cols
    return docs.select(*cols, F.pandas_udf(run, SPANS)(F.col(text_col)).alias("__pii"))
