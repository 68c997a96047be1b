"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds what they miss.

The network is trained in numpy from labelled spans in windows of a bounded sample of texts. Labels are what the fixed
patterns find, long digit runs in the form of a card whatever their check digit, values behind names of secrets, and
spans planted into the windows in near forms that no pattern matches (see ``plant``). Every character of every text is
read, in overlapping windows: each position takes the scores of the window in which it lies deepest, and one decoding
runs over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, held_out, materialize, ragged

#: Kinds of the fixed patterns, and all kinds that are reported.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The training sample: texts with a digit or an at sign and others, by the smallest hashes of their ids; windows cut
#: from each, by a hash of their place in the whole text (those with a span first); windows in all.
SAMPLE_ROWS, OTHER_ROWS, WINDOWS_A_TEXT, TRAIN_WINDOWS, EPOCHS = 3_000, 1_500, 3, 7_500, 12
HIDDEN, EMBED = 8, 8
#: Characters of a training window; of a window when texts are read, and from one window to the next.
TRAIN_WINDOW, WINDOW, STRIDE = 96, 1024, 960
#: The share of held-back windows, and the precision that the least marginal probability of a span must reach on them.
HELD_BACK, PRECISION = 0.15, 0.98
#: Characters that a worker reads at once, and windows of one pass of the network; bytes of texts that are decoded together.
READ_CHARS, PASS_WINDOWS, TOGETHER_CHARS = 1 << 20, 320, 1 << 24
#: Steps of the network whose scores are turned to rows at once; characters whose certain "none" is looked for at once.
TURNED, SURE_CHARS = 32, 1 << 15
#: Steps times stretches that are decoded together whatever their lengths.
DECODED = 1 << 16
_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Label rules of training windows beyond the fixed patterns.
_LONG_DIGITS = re.compile(r"(?<![0-9.])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|passwo?r?d|pwd|bearer)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{10,})")
TAGS = 1 + 2 * len(KINDS)  # none; then the first and the further characters of each kind
#: What is added to transitions: a further character of a kind only follows a first or a further one of it.
_ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(2, TAGS, 2):
    _ALLOWED[[a for a in range(TAGS) if a not in (_k - 1, _k)], _k] = -30


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap within a kind. Linear in the text."""
    out = []
    if not _TRIGGER.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:  # a match has one at sign, and begins where the run of name characters before it does
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        ends = np.cumsum([len(p) + 1 for p in parts]) + m.start() - 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append((int(ends[i]) - len(parts[i]), 1, int(ends[i + 3])))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that a training window is labelled with: the fixed patterns, then what the label rules add beside them."""
    out = base_spans(text)
    for rule, k in ((_SECRET, 4), (_LONG_DIGITS, 2)):
        for m in rule.finditer(text):
            a, b = m.span(1 if k == 4 else 0)
            if not any(a < e and s < b for s, _, e in out):
                out.append((a, k, b))
    return sorted(out)


# --- near forms -----------------------------------------------------------------------------------------


def near_form(r: np.random.Generator) -> tuple[str, int, int, int]:
    """(text, kind, begin, end) of made-up personal data in a form that no fixed pattern matches."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in r.integers(0, len(of), n))
    k = int(r.integers(len(KINDS)))
    before = after = ""
    if k == 0:
        name = pick(letters(5), f"{letters(4)}.{letters(6)}", f"{letters(3)}.{digits(2)}", f"{letters(6)}{digits(2)}")
        at, dot = pick((" @ ", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("@ ", " . "))
        body = name + at + dot.join([*[letters(int(r.integers(4, 9))) + pick("", digits(1)) for _ in range(int(r.integers(1, 3)))], pick("com", "org", "net", "de", "fr", "example")])
    elif k == 1:
        body = pick(" . ", "[.]", "(.)", " .", ". ", "-").join(str(x) for x in r.integers(0, 256, 4))
    elif k == 2:
        body = pick(".", "/", "  ", "_", " - ").join(digits(4) for _ in range(4))
    elif k == 3:
        a, b, c = digits(3), digits(3), digits(4)
        body = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"1 ({a}) {b}-{c}")
    else:
        kind = pick("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
        body = letters(int(r.integers(16, 49)), kind)
        name = pick("token", "secret", "api_key", "apikey", "access_key", "password", "passwd", "client_secret", "Token", "API_KEY", "SECRET")
        q = pick('"', '"', "'", "")
        before, after = f"{name}{pick(' = ', '=', ': ', ':', ' := ')}{q}", q
    return before + body + after, k, len(before), len(before) + len(body)


def look_alike(r: np.random.Generator) -> str:
    """Something with digits and stops that is no personal data: versions, dates, amounts, times, ranges, numbers, a word over and over."""
    n = lambda lo, hi: str(int(r.integers(lo, hi)))
    forms = (
        f"Version {n(0, 30)}.{n(0, 20)}.", f"v{n(0, 9)}.{n(0, 99)}.{n(0, 99)}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}",
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(1, 999)}.{n(100, 999)}.{n(100, 999)},{n(10, 99)}", f"${n(1, 999)}.{n(10, 99)}", f"pages {n(1, 400)}-{n(400, 900)}", f"No. {n(1000, 99999)}", f"{n(10000, 999999999)}", f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}",
        f"at {n(1, 12)} dot", f"{n(1, 99)} @ {n(1, 99)}", f"x = {n(1, 9999)}", f"name = '{n(1, 99)}'", f"{n(1900, 1999)}-{n(2000, 2030)}", f"({n(1, 999)}) {n(1, 99)}", f"{n(1, 9)}.{n(1, 9)}", f"[{n(1, 99)}]", "0123456789abcdef"[: int(r.integers(3, 9))],
        ("".join("abcdefghijklmnopqrstuvwxyz"[j] for j in r.integers(0, 26, 4)) + ("", ".", ",", "!")[int(r.integers(4))] + " ") * int(r.integers(5, 30)),
    )
    return forms[int(r.integers(len(forms)))]


def plant(text: str, r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with one made-up near form, or a look-alike, put in at a blank, and the spans of the whole."""
    own, k, a, b = near_form(r) if r.uniform() < 0.6 else (look_alike(r), -1, 0, 0)
    blanks = [i for i, c in enumerate(text) if c in " \n"] or [0]
    at = blanks[int(r.integers(len(blanks)))]
    out = f"{text[:at]} {own} {text[at:]}"
    if k < 0:
        return out, labelled_spans(out)
    a, b = a + at + 1, b + at + 1
    # patterns may match parts of the planted form: it is one span all the same
    rest = [s for s in labelled_spans(out) if not (s[0] < b and a < s[2])]
    return out, sorted([*rest, (a, k, b)])


# --- network ---------------------------------------------------------------------------------------------


def symbols(text: str) -> np.ndarray:
    """Printable ASCII as itself, other characters by class; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(code, 0x80)]


_SYMBOL = np.array([97 if c in (9, 10, 13) else c - 31 if 32 <= c < 127 else 98 if c == 0x80 else 96 for c in range(0x81)], np.uint8)
SYMBOLS = 99


def turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row with its first ``size`` entries in reverse and its padding left at the end."""
    at = sizes[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=1), x)


def _squash(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|) in place: the cells' squashing function, which costs a quarter of a tanh."""
    np.abs(x, out=spare)
    np.add(spare, 1, out=spare)
    np.divide(x, spare, out=x)


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative where the squashed value is y."""
    return (1 - np.abs(y)) ** 2


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x: (time, batch, in). Hidden states, and what the way back needs: squashed sums, cells and squashed cells.

    A gate is (1 + y) / 2 of its squashed sum y.
    """
    n, size = x.shape[1], u.shape[0]
    z = x @ w + b
    out, cells, tcs = (np.zeros((len(x) + 1, n, size), x.dtype) for _ in range(3))  # the first row is the state before
    spare, small = np.empty_like(z[0]), np.empty((n, size), x.dtype)
    for t in range(len(x)):
        g = z[t]
        g += out[t] @ u
        _squash(g, spare)
        gate = g[:, : 3 * size] * 0.5 + 0.5
        cells[t + 1] = gate[:, size : 2 * size] * cells[t] + gate[:, :size] * g[:, 3 * size :]
        tcs[t + 1] = cells[t + 1]
        _squash(tcs[t + 1], small)
        out[t + 1] = gate[:, 2 * size :] * tcs[t + 1]
    return out[1:], (z, cells, tcs, out)


def _lstm_back(dout: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: tuple) -> tuple[np.ndarray, ...]:
    z, cells, tcs, out = kept
    size = u.shape[0]
    slope = _slope(z)
    gate = z[:, :, : 3 * size] * 0.5 + 0.5
    i, f, o, g = gate[:, :, :size], gate[:, :, size : 2 * size], gate[:, :, 2 * size :], z[:, :, 3 * size :]
    # what a step's gradients are multiplied with, for all steps at once
    to_i, to_f, to_o = (m * slope[:, :, k * size : (k + 1) * size] * 0.5 for k, m in enumerate((g, cells[:-1], tcs[1:])))
    to_g, to_c = i * slope[:, :, 3 * size :], o * _slope(tcs[1:])
    dz, ut = np.empty_like(z), np.ascontiguousarray(u.T)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dout[t]
        dc = dc + dh * to_c[t]
        d = dz[t]
        d[:, :size], d[:, size : 2 * size] = dc * to_i[t], dc * to_f[t]
        d[:, 2 * size : 3 * size], d[:, 3 * size :] = dh * to_o[t], dc * to_g[t]
        dh, dc = d @ ut, dc * f[t]
    flat = dz.reshape(-1, 4 * size)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, out[:-1].reshape(-1, size).T @ flat, flat.sum(axis=0)


def crf_passes(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (time, batch, tags), the log of the sum over all paths, and the expected number of each transition."""
    top = e.max(axis=2, keepdims=True)
    own, step = np.exp(e - top), np.exp(trans)
    a, b, size = np.empty_like(own), np.ones_like(own), np.empty(e.shape[:2])
    for t in range(len(e)):  # scaled, so that nothing overflows
        now = own[t] if t == 0 else (a[t - 1] @ step) * own[t]
        size[t] = now.sum(axis=1)
        a[t] = now / size[t][:, None]
    for t in range(len(e) - 2, -1, -1):
        b[t] = ((own[t + 1] * b[t + 1]) @ step.T) / size[t + 1][:, None]
    tags = e.shape[2]
    after = (own[1:] * b[1:] / size[1:, :, None]).reshape(-1, tags)
    return a * b, np.log(size).sum(axis=0) + top[:, :, 0].sum(axis=0), step * (a[:-1].reshape(-1, tags).T @ after)


def best_paths(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags (time, batch)."""
    score, back = e[0], []
    for t in range(1, len(e)):
        every = score[:, :, None] + trans
        back.append(every.argmax(axis=1))
        score = e[t] + every.max(axis=1)
    tags = np.empty(e.shape[:2], np.int64)
    tags[-1] = score.argmax(axis=1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 2, -1, -1):
        tags[t] = back[t][rows, tags[t + 1]]
    return tags


_SPACES: dict[str, np.ndarray] = {}


def _space(name: str, shape: tuple[int, ...]) -> np.ndarray:
    """Memory of a worker that is used again: touching it anew for each pass costs as much as reading a window."""
    size = int(np.prod(shape))
    if name not in _SPACES or len(_SPACES[name]) < size:
        _SPACES[name] = np.zeros(size, np.float32)
    return _SPACES[name][:size].reshape(shape)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]
    sure: float = 0.95  # least marginal probability of each character of a span

    @classmethod
    def fresh(cls, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": r.normal(size=(SYMBOLS, EMBED)).astype(np.float32) * 0.5, "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fr":
            p |= {f"w{d}": draw(EMBED, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return cls(p)

    def emissions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """x: (batch, time) symbols, padded at the end. Scores of all valid positions, row after row: (sum of sizes, tags).

        Both directions run at once, gate by gate in arrays of their own, so that every operation reads whole ranges of
        memory. Longest rows come first; when a quarter of the running rows has ended, the arrays shrink. Gates and hidden
        states are held at twice their value, which the weights behind them make up for.
        """
        p, f32, half = self.p, np.float32, np.float32(0.5)
        by = np.argsort(-sizes, kind="stable")
        rows, ends = x[by], sizes[by]
        n, long = len(rows), int(ends[0]) if len(ends) else 0
        rows = rows[:, :long]
        steps = np.empty((long, 2, n), np.uint8)
        steps[:, 0], steps[:, 1] = rows.T, (turned(rows, ends) + np.uint8(SYMBOLS)).T
        by_gate = lambda m: m.reshape(len(m), 4, HIDDEN).transpose(1, 0, 2)
        table = np.ascontiguousarray(np.concatenate([by_gate(p["embed"] @ p[f"w{d}"] + p[f"b{d}"]) for d in "fr"], axis=1), f32)
        u = np.ascontiguousarray(np.stack([by_gate(p[f"u{d}"]) for d in "fr"], axis=1), f32) * half
        hidden = _space("hidden", (2, long, n, HIDDEN))
        h, c, t = np.zeros((2, n, HIDDEN), f32), np.zeros((2, n, HIDDEN), f32), 0
        running = n - np.searchsorted(ends[::-1], np.arange(long), side="right")
        while t < long:
            m = int(running[t])
            h, c = h[:, :m], np.ascontiguousarray(c[:, :m])
            z, more = np.empty((4, 2, m, HIDDEN), f32), np.empty((4, 2, m, HIDDEN), f32)
            tc, small = np.empty_like(c), np.empty_like(c)
            gates, (i, f, o, g) = z[:3], z
            stop = t + int(np.searchsorted(-running[t:], -0.75 * m, side="right"))
            for t in range(t, stop):  # in place: the arrays of a step stay in the cache
                np.take(table, steps[t, :, :m], axis=1, out=z, mode="clip")
                np.matmul(h, u, out=more)
                np.add(z, more, out=z)
                _squash(z, more)
                np.add(gates, 1, out=gates)
                np.multiply(c, f, out=c)
                np.multiply(i, g, out=tc)
                np.add(c, tc, out=c)
                np.multiply(c, half, out=c)
                np.abs(c, out=small)
                np.add(small, 1, out=small)
                np.divide(c, small, out=tc)
                h = hidden[:, t, :m]
                np.multiply(o, tc, out=h)
            t = stop
        # scores row by row: of whole rows turned from steps in blocks that stay in the cache, of the others each for itself
        out, whole = np.empty((int(sizes.sum()), TAGS), f32), int(np.searchsorted(-ends, -long, side="right"))
        forth, back = (w.astype(f32) * half for w in (p["out"][:HIDDEN], p["out"][HIDDEN:]))
        full = out[: whole * long].reshape(whole, long, TAGS)
        for lo in range(0, long, TURNED):
            some = hidden[0, lo : lo + TURNED, :whole]
            scored = (some.reshape(-1, HIDDEN) @ forth).reshape(len(some), whole, TAGS)
            scored += p["out_b"]
            full[:, lo : lo + len(some)] = scored.transpose(1, 0, 2)
        for lo in range(0, long, TURNED):
            some = hidden[1, lo : lo + TURNED, :whole]
            scored = (some.reshape(-1, HIDDEN) @ back).reshape(len(some), whole, TAGS)
            full[:, long - lo - len(some) : long - lo] += scored[::-1].transpose(1, 0, 2)
        at = whole * long
        for k, size in enumerate(ends[whole:].tolist(), whole):
            np.add(hidden[0, :size, k] @ forth, (hidden[1, :size, k] @ back)[::-1], out=out[at : at + size])
            at += size
        out[whole * long :] += p["out_b"]
        if (by == np.arange(n)).all():
            return out
        place = np.empty(n, np.int64)
        place[by] = np.cumsum(ends) - ends
        return out[ragged(place, sizes)]

    @property
    def transitions(self) -> np.ndarray:
        return self.p["trans"].astype(np.float64) + _ALLOWED

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.p
        v = p["embed"][x.T]
        hf, kf = _lstm(v, p["wf"], p["uf"], p["bf"])
        hr, kr = _lstm(v[::-1], p["wr"], p["ur"], p["br"])
        h = np.concatenate([hf, hr[::-1]], axis=2)
        return h @ p["out"] + p["out_b"], v, h, kf, kr

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (batch, time), and its gradient."""
        p, y = self.p, y.T
        e, v, h, kf, kr = self._forward(x)
        e = e.astype(np.float64)
        trans = self.transitions
        marginal, z, pair = crf_passes(e, trans)
        n, rows = x.shape[0], np.arange(x.shape[0])
        gold = e[np.arange(len(y))[:, None], rows, y].sum() + trans[y[:-1], y[1:]].sum()
        de = marginal
        de[np.arange(len(y))[:, None], rows, y] -= 1
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
        de = (de / n).astype(np.float32)
        dh = de @ p["out"].T
        df, dr = dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]
        xf, wf, uf, bf = _lstm_back(df, v, p["wf"], p["uf"], kf)
        xr, wr, ur, br = _lstm_back(dr, v[::-1], p["wr"], p["ur"], kr)
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, x.T.ravel(), (xf + xr[::-1]).reshape(-1, EMBED))
        flat = h.reshape(-1, 2 * HIDDEN)
        g = {"embed": embed, "out": flat.T @ de.reshape(-1, TAGS), "out_b": de.sum(axis=(0, 1)), "trans": (pair / n).astype(np.float32)}
        return float((z.sum() - gold) / n), g | {"wf": wf, "uf": uf, "bf": bf, "wr": wr, "ur": ur, "br": br}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, step, out = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order, loss = r.permutation(len(x)), []
            for lo in range(0, len(x), batch):
                part = order[lo : lo + batch]
                value, g = self.gradient(x[part], y[part])
                loss.append(value)
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale, step = min(1.0, 5 / (size + 1e-9)), step + 1
                now = rate * (1 - epoch / epochs) + 1e-3
                for k, v in g.items():
                    v = v * scale
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            out.append(float(np.mean(loss)))
        return out


# --- windows ---------------------------------------------------------------------------------------------


def window_starts(size: int) -> list[int]:
    """Where windows begin in a text; together they cover it."""
    return list(range(0, max(1, size - (WINDOW - STRIDE)), STRIDE)) if size else []


def tag(size: int, spans: list[tuple[int, int, int]], begin: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a, k, b in spans:
        lo, hi = max(a, begin), min(b, begin + size)
        if lo < hi:
            out[lo - begin : hi - begin] = 2 + 2 * k
            if lo == a:
                out[lo - begin] = 1 + 2 * k
    return out


def cut_parts(text: str, seed: int, most: int = WINDOWS_A_TEXT) -> list[str]:
    """Parts of a text, about a training window long, drawn over the whole text; those around a labelled span first."""
    r = np.random.default_rng(seed & (2**63 - 1))
    size = 2 * TRAIN_WINDOW
    spans = labelled_spans(text)
    r.shuffle(spans)
    at = [max(0, (s[0] + s[2]) // 2 - size // 2) for s in spans[: max(1, most - 1)]]
    at += r.integers(0, max(1, len(text) - size + 1), most - len(at)).tolist()
    return [text[a : a + size] for a in at]


def training_windows(parts: list[str], most: int = TRAIN_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of windows of the parts, each as it is and, until there are ``most``, with a planted near form."""
    r, out = np.random.default_rng(seed), []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        middle = spans[int(r.integers(len(spans)))] if spans else None
        reach = len(text) - TRAIN_WINDOW
        lo = int(r.integers(max(0, middle[2] - TRAIN_WINDOW), middle[0] + 1)) if middle and middle[2] - middle[0] < TRAIN_WINDOW else int(r.integers(0, max(1, reach + 1)))
        lo = max(0, min(lo, reach))
        x = symbols(text)[lo : lo + TRAIN_WINDOW]
        y = tag(len(x), spans, lo)
        out.append((np.pad(x, (0, TRAIN_WINDOW - len(x))), np.pad(y, (0, TRAIN_WINDOW - len(y)))))

    parts = [parts[i] for i in r.permutation(len(parts))][: most // 3]
    for text in parts:
        add(text, labelled_spans(text))
    while parts and len(out) < most:
        add(*plant(parts[int(r.integers(len(parts)))], r))
    if not out:
        return np.zeros((0, TRAIN_WINDOW), np.uint8), np.zeros((0, TRAIN_WINDOW), np.int64)
    order = r.permutation(len(out))
    return np.stack([out[i][0] for i in order]), np.stack([out[i][1] for i in order])


def text_scores(coded: list[np.ndarray], tagger: Tagger) -> np.ndarray:
    """Scores (characters, tags) of texts, one after the other: each position from the window in which it lies deepest."""
    sizes = np.array([len(c) for c in coded], np.int64)
    base = np.cumsum(sizes) - sizes
    flat = np.concatenate([*coded, np.zeros(0, np.uint8)])
    starts = [(i, s) for i, n in enumerate(sizes.tolist()) for s in window_starts(n)]
    out = np.empty((len(flat), TAGS), np.float32)
    if not starts:
        return out
    row, begin = np.array(starts, np.int64).T
    length = np.minimum(WINDOW, sizes[row] - begin)
    overlap = WINDOW - STRIDE
    # of an overlap the first half is the earlier window's, the rest the later one's
    lo = np.where(begin > 0, overlap // 2, 0)
    hi = np.where(begin + length < sizes[row], length - (overlap - overlap // 2), length)
    order = np.argsort(-length, kind="stable")
    for some in np.array_split(order, -(-len(order) // PASS_WINDOWS)):  # about as many in each: a pass of few rows costs as much
        n = length[some]
        x = np.zeros((len(some), int(n.max())), np.uint8)
        at_text = base[row[some]] + begin[some]
        for j, (a, size) in enumerate(zip(at_text.tolist(), n.tolist(), strict=True)):
            x[j, :size] = flat[a : a + size]
        e, done = tagger.emissions(x, n), 0
        for a, size, u, v in zip(at_text.tolist(), n.tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
            out[a + u : a + v] = e[done + u : done + v]
            done += size
    return out


def undecided(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Positions where the best path may have another tag than "none", of texts one after the other.

    A span is part of the best path only if it wins over "none" all along. What a span that reaches a position can win
    at most, from any beginning before and to any end behind, comes from running sums; no position of a better path is
    left out. Spans that touch cost less than each between "none": of spans in a row one at least wins without the rest
    but for what the touch behind it saves, so a stretch in which none does is not searched either. What a touch saves
    depends on the kind and on whether its last character is its first too.
    """
    first = np.zeros(len(scores), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    some, core = np.zeros(len(scores), bool), np.zeros(len(scores), bool)
    begins = range(1, TAGS, 2)
    others = [0, *begins]  # what may follow a span
    alone = {k: trans[0, k] - trans[0, 0] for k in begins}
    # what a span between "none" that ends with a tag must win at least to be one of spans in a row
    asked = {j: trans[0, 0] - trans[j, 0] - max(0.0, *(trans[j, k] - trans[j, 0] - alone[k] for k in begins)) for j in range(1, TAGS)}
    ends, lo = np.cumsum(sizes), 0
    while lo < len(scores):  # whole texts, as many as stay in the cache
        hi = int(ends[max(np.searchsorted(ends, lo + SURE_CHARS, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        e, starts = np.ascontiguousarray(scores[lo:hi].T, np.float64), first[lo:hi]
        e[1:] -= e[0]
        for k in begins:
            enter = (trans[:, k] - trans[:, 0]).max()
            start = e[k] + enter
            start[starts] = np.maximum(e[k], e[k + 1])[starts] + max(enter, enter - alone[k])
            core[lo:hi] |= start >= -1e-3 + enter - alone[k] + asked[k]
            leave = (trans[k : k + 2, others] - trans[0, others]).max()
            total = e[k + 1]
            total += trans[k : k + 2, k + 1].max() - trans[0, 0]
            np.cumsum(total, out=total)
            start -= total
            np.maximum.accumulate(start, out=start)
            start += np.maximum.accumulate(total[::-1])[::-1]
            some[lo:hi] |= start >= -1e-3 - leave
            core[lo:hi] |= start >= -1e-3 + enter - alone[k] + asked[k + 1]
        lo = hi
    at = np.flatnonzero(some)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]])) if len(at) else at
    return at[np.repeat(np.logical_or.reduceat(core[at], new), np.diff(np.append(new, len(at))))] if len(at) else at


def maybe_other(scores: np.ndarray, lo: np.ndarray, length: np.ndarray, known: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which stretches [lo, lo + length) may have another best path than "none" all along; known: whose first tag is "none".

    By the scores of best paths without their tags, never too low: a further character has two tags before it, and all
    others count as the best of them by the dearest way, which is cheaper than theirs. A margin covers single precision.
    All stretches go on together, the longest first, until they end.
    """
    order = np.argsort(-length, kind="stable")
    long, n = length[order], len(order)
    running = n - np.searchsorted(long[::-1], np.arange(int(long[0])), side="right")
    begin = np.cumsum(running) - running
    source = np.empty(int(long.sum()), np.int64)
    source[begin[ragged(np.zeros(n, np.int64), long)] + np.repeat(np.arange(n), long)] = ragged(lo[order], long)
    t32 = trans.astype(np.float32)
    e = np.ascontiguousarray(scores[source].T)  # step by step, relative to "none", so that sums stay small
    e[1:] -= e[0]
    e[1:] -= t32[0, 0]
    first, more = [0, *range(1, TAGS, 2)], np.arange(2, TAGS, 2)
    into = np.ascontiguousarray(t32[:, first].T)[:, :, None]
    into[0] -= t32[0, 0]
    rest = np.array([np.delete(t32[:, k], (k - 1, k)).max() for k in more], np.float32)[:, None]
    own, start = t32[more, more][:, None], t32[more - 1, more][:, None]
    # paths that have had another tag; "none" all along is 0, and may go on as any tag
    score = np.full((TAGS, n), -1e4, np.float32)
    score[1:] = np.where(known[order], score[1:], e[1:, :n] + t32[0, 0])
    fresh = into[1:, 0]
    every, out = np.empty((len(first), TAGS, n), np.float32), np.empty(n, bool)
    for t, m in enumerate(np.append(running[1:], 0).tolist(), 1):
        if m < score.shape[1]:  # those that end have "none" behind them
            out[order[m : score.shape[1]]] = (score[:, m:] + into[0]).max(axis=0) > -1e-2
            score, every = score[:, :m], every[:, :, :m]
            if not m:
                break
        np.add(score, into, out=every)
        best = every.max(axis=1)
        cont = np.maximum(score[2::2] + own, score[1::2] + start)
        np.maximum(cont, np.maximum(score.max(axis=0), 0) + rest, out=cont)
        np.maximum(best[1:], fresh, out=best[1:])
        now = e[:, begin[t] : begin[t] + m]
        score[0] = best[0]
        np.add(best[1:], now[1::2], out=score[1::2])
        np.add(cont, now[2::2], out=score[2::2])
    return out


def best_is_none(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which of e (time, batch, tags) have "none" all along as their best path, by the scores of best paths without their tags."""
    by_tag = np.ascontiguousarray(e.transpose(0, 2, 1))
    score, none, into = by_tag[0].copy(), by_tag[0, 0].copy(), np.ascontiguousarray(trans.T)[:, :, None]
    every, best = np.empty((TAGS, TAGS, e.shape[1])), np.empty_like(score)
    for t in range(1, len(e)):
        np.add(score, into, out=every)
        every.max(axis=1, out=best)
        np.add(best, by_tag[t], out=score)
        none = none + trans[0, 0] + by_tag[t, 0]
    return score.max(axis=0) <= none


def stretches(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in it, whether "none" is certain there, length, scores) of what has to be decoded of whole texts.

    scores are those of the texts, one after the other. Texts are cut where the best path has "none" for certain.
    """
    at = undecided(scores, sizes, trans)
    begin = np.cumsum(sizes) - sizes
    text = np.searchsorted(begin + sizes, at, side="right")
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(text) > 0)])) if len(at) else at
    row = text[new]
    # with the certain "none" before, but for a text's beginning
    lo = np.maximum(begin[row], at[new] - 1)
    length = at[np.append(new, len(at))[1:] - 1] + 1 - lo
    return row, lo - begin[row], lo < at[new], length, scores[ragged(lo, length)]


def decode(scores: np.ndarray, sizes: np.ndarray, tagger: Tagger) -> list[tuple[int, int, int, int, float]]:
    """(text, start, kind, end, sureness) of the best tags of each whole text; sureness is the least marginal probability.

    scores are those of the texts, one after the other; behind its end a text has "none".
    """
    return decode_stretches([stretches(scores, sizes, tagger.transitions)], tagger)


def decode_stretches(parts: list[tuple[np.ndarray, ...]], tagger: Tagger) -> list[tuple[int, int, int, int, float]]:
    """What ``decode`` gives, of any number of ``stretches``; those of about one length are decoded together."""
    row, place, known, length, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(row):
        return []
    trans, lo = tagger.transitions, np.cumsum(length) - length

    def together(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stretches of about one length, or few of any, and their scores (time, stretch, tags)."""
        rows = rows[np.argsort(length[rows], kind="stable")]
        while len(rows):
            some = rows[:512]
            long = length[some]
            some = some[(long <= 1.25 * long[0] + 8) | (long * np.arange(1, len(some) + 1) <= DECODED)]
            rows, long = rows[len(some) :], long[: len(some)]
            e = np.full((int(long.max()) + 1, len(some), TAGS), -1e4)
            e[:, :, 0] = 0
            step, col = ragged(np.zeros(len(some), np.int64), long), np.repeat(np.arange(len(some)), long)
            e[step, col] = scores[ragged(lo[some], long)]
            e[0, known[some]] = np.where(np.arange(TAGS) > 0, -1e4, 0)
            yield some, e

    maybe = np.flatnonzero(maybe_other(scores, lo, length, known, trans))
    out, hits = [], [some[~best_is_none(e, trans)] for some, e in together(maybe)] or [maybe]
    for some, e in together(np.concatenate(hits)):
        path = best_paths(e, trans)
        sure = crf_passes(e, trans)[0]
        for j, w in enumerate(some.tolist()):
            tags, t, base = path[:, j], 0, int(place[w])
            while t < len(tags):
                if tags[t] == 0:
                    t += 1
                    continue
                kind, end = (int(tags[t]) - 1) // 2, t + 1
                while tags[end] == 2 + 2 * kind:  # the last tag is "none"
                    end += 1
                if tags[t] == 1 + 2 * kind:
                    out.append((int(row[w]), base + t, kind, base + end, float(sure[np.arange(t, end), j, tags[t:end]].min())))
                t = end
    return sorted(out)


def plausible(text: str, a: int, kind: int, b: int) -> bool:
    """Whether what the network found may be of its kind. Words that repeat, plain words, and numbers run together are not.

    A span loses if its words are all one, if it begins or ends inside a run of equal words, if it is letters and
    blanks only (a secret: one word of letters in one case that no = or : comes before), or a card of over 19 digits.
    """
    span, words = text[a:b], text[a:b].split()
    near, far = text[max(0, a - 64) : a].split(), text[b : b + 64].split()
    if not words or len(words) > 1 and len(set(words)) == 1 or near[-1:] == words[:1] or far[:1] == words[-1:]:
        return False
    if KINDS[kind] == "secret":
        one_case = span.isalpha() and (span.isupper() or span.islower() or span.istitle())
        return not one_case or text[max(0, a - 4) : a].rstrip(" \"'")[-1:] in ("=", ":")
    if KINDS[kind] == "card" and sum(c.isdigit() for c in span) > 19:
        return False
    return not all(c.isalpha() or c.isspace() for c in span)


def added_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the network finds in each whole text with every character as sure as the tagger asks, if it is plausible."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= READ_CHARS):
            size += len(texts[hi])
            hi += 1
        coded = [symbols(t) for t in texts[lo:hi]]
        row, *rest = stretches(text_scores(coded, tagger), np.array([len(c) for c in coded]), tagger.transitions)
        parts.append((row + lo, *rest))
        lo = hi
    for i, a, k, b, sure in decode_stretches(parts, tagger) if parts else ():
        if sure >= tagger.sure and plausible(texts[i], a, k, b):
            out[i].append((a, k, b))
    return out


def least_sureness(tagger: Tagger, x: np.ndarray, y: np.ndarray) -> float:
    """The least sureness at which spans found in held-back windows are right as often as PRECISION asks."""
    found, sizes = [], (x > 0).sum(axis=1)
    for i, a, k, b, sure in decode(tagger.emissions(x, sizes), sizes, tagger):
        tags, n = y[i], int(sizes[i])
        right = (tags[a + 1 : b] == 2 + 2 * k).all() and (b >= n or tags[b] != 2 + 2 * k)
        # a span that the window cuts has no first character
        found.append((sure, right and (tags[a] == 1 + 2 * k or (a == 0 and tags[0] == 2 + 2 * k))))
    found.sort(reverse=True)
    best, good = 0.99, 0
    for i, (sure, right) in enumerate(found, 1):
        good += right
        if good >= PRECISION * i:
            best = sure
    return float(np.clip(best, 0.6, 0.99))


# --- Spark -------------------------------------------------------------------------------------------------


def fit_tagger(docs: DataFrame) -> Tagger | None:
    """Trains on a bounded sample of ``docs`` (doc_id, text); None where there is no text to learn from."""
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    usable = materialize(usable.select(F.col("doc_id").alias("_id"), F.col("text").rlike("[0-9@]").alias("has")))  # texts are searched once
    by = [F.xxhash64("_id"), "_id"]
    some = usable.filter("has").orderBy(*by).limit(SAMPLE_ROWS).unionByName(usable.filter("NOT has").orderBy(*by).limit(OTHER_ROWS))
    some = some.select("_id").distinct()
    chosen = docs.join(F.broadcast(some), F.col("doc_id") == F.col("_id"), "left_semi").select(F.xxhash64("doc_id").alias("seed"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few parts of each text only, so that little reaches the driver."""
        for batch in batches:
            seeds, parts = [], []
            for seed, text in zip(batch.column("seed").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = cut_parts(text or "", seed)
                seeds += [seed] * len(own)
                parts += own
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(parts, pa.string())], names=["seed", "part"])

    table = materialize(chosen.mapInArrow(cut, "seed long, part string")).toPandas().sort_values(["seed", "part"])
    x, y = training_windows([t for t in table["part"].tolist() if t])
    if not len(x):
        return None
    n = max(1, int(len(x) * (1 - HELD_BACK)))
    tagger = Tagger.fresh()
    tagger.train(x[:n], y[:n])
    tagger.sure = least_sureness(tagger, x[n:], y[n:])
    return tagger


def rows_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, the last column of which is a text, put together or cut: about TOGETHER_CHARS bytes of texts, and one row more at most."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < batch.num_rows:
            n = int(np.searchsorted(size + np.cumsum(lengths[lo:]), TOGETHER_CHARS)) + 1
            held.append(batch.slice(lo, n))
            size += int(lengths[lo : lo + n].sum())
            lo += n
            if size >= TOGETHER_CHARS:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def find_personal_data(docs: DataFrame, tagger: Tagger | None, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, base and spans (strings of kind:start:end), n_email, n_ip, n_card, n_phone of base, and
    n_secret and n_added of what the network adds.

    Spans are those of base and what the network finds beside them. A null or an empty text has none; long texts are
    read whole; of equal starts the kind first listed comes first; equal rows are treated alike; an empty table gives an
    empty one. Columns in ``keep`` with one of these names are replaced; all other names are free.
    """
    made = T.StructType.fromDDL("n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_added long, base string, spans string")
    names = [c for c in keep if c not in made.names]
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for part in rows_together(batches):
            if part.num_rows:
                texts = [x or "" for x in part.column(part.num_columns - 1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, tagger) if tagger else [[] for _ in texts]
                new = [[s for s in found if not any(a < s[2] and s[0] < b for a, _, b in own)] for own, found in zip(base, more, strict=True)]
                counts = [[sum(k == j for _, k, _ in s) for s in base] for j in range(len(BASE_KINDS))]
                counts += [[sum(k == 4 for _, k, _ in s) for s in new], [len(s) for s in new]]
                every = [show(own + s) for own, s in zip(base, new, strict=True)]
                columns = [*(pa.array(n, pa.int64()) for n in counts), pa.array([show(s) for s in base], pa.string()), pa.array(every, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *columns], names=[*names, *made.names])

    schema = T.StructType([*docs.select(*names).schema.fields, *made.fields])
    (own,) = free_names(docs.select(*names), "_searched")
    return docs.select(*names, docs["text"].alias(own)).mapInArrow(run, schema)
