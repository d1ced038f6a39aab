"""Personal data: base patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The network is trained in numpy on windows with labelled spans: base matches in a bounded sample of documents, and spans in spellings
that the base patterns miss, written into text of that sample. It reads every text whole, in overlapping windows. A window is
decoded by Viterbi unless its scores prove that the decoding is "outside" throughout. Where two windows overlap, the text is cut at
the place nearest to the middle that both call outside, and spans are read from the reconciled labels of the whole text. A found
span must be confident, pass its kind's own test, and not touch a base span.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .langid import forward_backward
from .shared import map_arrow, pick, sample_rows, stretch, text_list

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 10, 12
#: Windows and their overlap; a span no longer than half of the overlap is whole in one of two neighbours.
SPAN_WINDOW, OVERLAP = 1536, 128
AROUND = 40
#: Characters that one batch of windows holds at most, besides one window.
AREA = 1536 * 512
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS, TRAIN_SIZE = 400, 20_000, 3600, 64
CONFIDENT = 0.9
#: The forget gate's largest value: what was read long ago fades, so long windows behave as the short ones trained on.
MEMORY = np.float32(0.95)

EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address with its at and dots as marks, in brackets or as words of their own.
_AT, _DOT = (rf"(?:{bare}|\s*[(\[{{<]\s*(?:{sign}|{word})\s*[)\]}}>]\s*|\s+{word}\s+)" for bare, sign, word in ((r"\s*@\s*", "@", "at"), (r"\.", r"\.", "dot")))
SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.I)
DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a number is at most 255; zeros in front do not count, and no long number is ever converted."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def fits(kind: str, found: str) -> bool:
    """A kind's own test of what its pattern or the network found."""
    digits = DIGITS.sub("", found)
    if kind == "ip":
        return all(_octet(p) for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards: linear in the text however long its runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LEFT.match(text, start - 1):
            start -= 1
        m = EMAIL_RIGHT.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns' matches that pass their tests, in order of start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), m.end(), k) for m in pattern.finditer(text) if fits(KINDS[k], m[0])]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def _alphabet() -> np.ndarray:
    """Symbol of each character up to 127: digits share one, letters lose their case. Above: a letter or anything else."""
    table = np.zeros(128, np.int64)
    for c in range(128):
        ch = chr(c)
        table[c] = 1 if ch.isdigit() else 2 if ch.isspace() else 3 + ord(ch.lower()) - 33 if c > 32 and c < 127 else 0
    return table


SYMBOLS = _alphabet()
N_SYMBOLS = int(SYMBOLS.max()) + 3


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = np.where(codes < 128, 0, N_SYMBOLS - 1)
    return np.where(codes < 128, SYMBOLS[np.minimum(codes, 127)], wide)


def allowed() -> np.ndarray:
    """1 where a label may follow another: inside only after begin or inside of its kind."""
    ok = np.ones((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = 0
        ok[[inside - 1, inside], inside] = 1
    return ok


ALLOWED = allowed()
START = np.array([1.0] + [1.0, 0.0] * len(KINDS))


def _soft(z: np.ndarray) -> np.ndarray:
    """Softsign, which squashes candidates and cells here: the same shape as tanh at a small part of its cost."""
    return z / (1 + np.abs(z))


class Lstm:
    """One direction of the network; gates (piecewise linear) in the order input, forget, output, then the candidate."""

    def __init__(self, rng: np.random.Generator):
        self.wx = rng.normal(0, 0.4, (EMBED, 4 * HIDDEN)).astype(np.float32)
        self.wh = rng.normal(0, 0.4, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1.0

    def forward(self, x: np.ndarray, keep: list) -> np.ndarray:
        """Hidden states of inputs already multiplied by ``wx``: (n, time, 4 * HIDDEN) -> (n, time, HIDDEN)."""
        n, time, _ = x.shape
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((n, time, HIDDEN), x.dtype)
        for t in range(time):
            z = x[:, t] + h @ self.wh
            gates = np.clip(0.25 * z[:, : 3 * HIDDEN] + 0.5, 0, 1)
            g = _soft(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], np.minimum(gates[:, HIDDEN : 2 * HIDDEN], MEMORY), gates[:, 2 * HIDDEN :]
            keep.append((h, c, i, f, o, g))
            c = f * c + i * g
            h = o * _soft(c)
            out[:, t] = h
        return out

    def backward(self, dout: np.ndarray, x: np.ndarray, kept: list) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients for the embedded inputs and for wx, wh, b."""
        n, time, _ = dout.shape
        dz_all = np.empty((n, time, 4 * HIDDEN), np.float32)
        dh, dc, dwh = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros_like(self.wh)

        def slope(gate: np.ndarray, top: float = 1.0) -> np.ndarray:
            return np.where((gate > 0) & (gate < top), np.float32(0.25), np.float32(0))

        for t in range(time - 1, -1, -1):
            h, c0, i, f, o, g = kept[t]
            sc = _soft(f * c0 + i * g)
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - np.abs(sc)) ** 2
            dz = np.concatenate([dc * g * slope(i), dc * c0 * slope(f, MEMORY), dh * sc * slope(o), dc * i * (1 - np.abs(g)) ** 2], axis=1)
            dz_all[:, t] = dz
            dwh += h.T @ dz
            dh, dc = dz @ self.wh.T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return (flat @ self.wx.T).reshape(n, time, EMBED), [x.reshape(-1, EMBED).T @ flat, dwh, flat.sum(0)]


def turned(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``lengths`` entries in reverse, the padding where it is."""
    at = np.arange(values.shape[1])[None, :]
    where = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(values, where if values.ndim == 2 else where[:, :, None], axis=1)


@dataclass
class Tagger:
    embed: np.ndarray
    left: Lstm
    right: Lstm
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def emissions(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label scores (time, labels, n) of padded windows of symbols, longest first. Both directions step together, windows side
        by side; the right-to-left one starts afresh where a window ends."""
        n, time = grid.shape
        table = np.concatenate([self.embed, np.ones((N_SYMBOLS, 1), np.float32)], axis=1).T.copy()
        weights = np.stack([np.concatenate([d.wh, d.wx, d.b[None, :]]).T for d in (self.left, self.right)]).astype(np.float32)
        weights[:, : 3 * HIDDEN] *= 0.25
        weights[:, : 3 * HIDDEN, -1] += 0.5
        final = [self.out[:HIDDEN].T.copy(), self.out[HIDDEN:].T.copy()]
        steps = np.ascontiguousarray(grid.T)
        live = np.searchsorted(-lengths, -np.arange(1, time + 1), side="right")  # windows with more than t characters
        hx = np.zeros((2, HIDDEN + EMBED + 1, n), np.float32)
        h, c, z, u = hx[:, :HIDDEN], np.zeros((2, HIDDEN, n), np.float32), np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((2, HIDDEN, n), np.float32)
        i, f, o, g, gates = z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN], z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :], z[:, : 3 * HIDDEN]
        zero, one = np.float32(0), np.float32(1)
        most = np.repeat(np.array([1, MEMORY, 1], np.float32), HIDDEN)[None, :, None]
        scores, back = np.empty((time, LABELS, n), np.float32), np.empty((time, LABELS, n), np.float32)
        for t in range(time):
            np.take(table, steps[t], axis=1, out=hx[0, HIDDEN:], mode="clip")
            np.take(table, steps[time - 1 - t], axis=1, out=hx[1, HIDDEN:], mode="clip")
            np.matmul(weights, hx, out=z)
            np.maximum(gates, zero, out=gates)
            np.minimum(gates, most, out=gates)
            np.abs(g, out=u)
            u += one
            g /= u
            c *= f
            g *= i
            c += g
            k = live[time - 1 - t]
            if k < n:
                c[1, :, k:] = 0
            np.abs(c, out=u)
            u += one
            np.divide(c, u, out=h)
            h *= o
            np.matmul(final[0], h[0], out=scores[t])
            np.matmul(final[1], h[1], out=back[time - 1 - t])
        scores += back
        scores += self.bias[None, :, None]
        return scores

    def certain(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Windows whose best labelling is outside throughout, proven from the scores. A run of labelled characters gains over outside
        at most the begin score of its first and the best scores of the others, plus, for each, twice what the best transition is
        above outside-outside (a character takes part in two). Where no run can gain anything, there is none."""
        gain = np.float32(2 * max(0.0, float(self.trans[ALLOWED > 0].max() - self.trans[0, 0])))
        begin = scores[:, 1::2].max(1) - scores[:, 0] + gain
        best = np.maximum(begin, scores[:, 2::2].max(1) - scores[:, 0] + gain)
        beyond = np.arange(len(scores))[:, None] >= lengths[None, :]
        begin[beyond] = best[beyond] = -1e9
        rest, most = np.zeros(scores.shape[2], np.float32), np.full(scores.shape[2], -1e9, np.float32)
        for t in range(len(scores) - 1, -1, -1):
            np.maximum(most, begin[t] + rest, out=most)
            rest += best[t]
            np.maximum(rest, 0, out=rest)
        return most < 0

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels (n, time) of windows, longest first. Only scores of the best ways to each label are kept on the way forward."""
        time, _, n = scores.shape
        trans = np.where(ALLOWED > 0, self.trans, -1e9).astype(np.float32)
        best = np.empty_like(scores)
        best[0] = scores[0] + np.where(START > 0, 0, -1e9).astype(np.float32)[:, None]
        options = np.empty((LABELS, LABELS, n), np.float32)
        for t in range(1, time):
            np.add(best[t - 1][:, None, :], trans[:, :, None], out=options)
            options.max(0, out=best[t])
            best[t] += scores[t]
        labels = np.zeros((n, time), np.int64)
        at, every = np.zeros(n, np.int64), np.arange(n)
        for t in range(time - 1, -1, -1):
            ways = best[t] + trans[:, at] if t + 1 < time else best[t]
            ends = lengths == t + 1
            if ends.any():
                ways = np.where(ends[None, :], best[t], ways)
            at = np.where(t < lengths, ways.argmax(0), 0)
            labels[every, t] = at
        return labels

    def sure(self, scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The probability of the label of each character that is in a span, under forward-backward over the span and ``AROUND``
        characters on either side; 1 elsewhere. scores (time, labels, n), labels (n, time)."""
        cuts = []
        for row in range(len(labels)):
            inside = np.flatnonzero(labels[row])
            for run in np.split(inside, np.flatnonzero(np.diff(inside) > AROUND) + 1):
                cuts.append((row, max(0, int(run[0]) - AROUND), min(labels.shape[1], int(run[-1]) + 1 + AROUND)))
        cuts.sort(key=lambda c: c[1] - c[2])
        lengths = np.array([b - a for _, a, b in cuts])
        wide = np.zeros((len(cuts), lengths[0], LABELS))
        for j, (row, a, b) in enumerate(cuts):
            wide[j, : b - a] = scores[a:b, :, row]
        post, _ = forward_backward(np.exp(wide - wide.max(2, keepdims=True)) + 1e-12, lengths, np.exp(self.trans) * ALLOWED, START)
        out = np.ones(labels.shape)
        for j, (row, a, b) in enumerate(cuts):
            lab = labels[row, a:b]
            out[row, a:b] = np.where(lab > 0, post[j, np.arange(b - a), lab], out[row, a:b])
        return out


def _invent(rng: np.random.Generator, known: list[str]) -> tuple[str, int | None]:
    """A span in one of many spellings and its kind, or something that only looks like one (kind None). Names are made of letters
    at random, of syllables, or of ``known`` words, so that the network goes by the marks and not by the letters."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def word(lo: int = 2, hi: int = 9) -> str:
        how = int(rng.integers(3))
        if how == 0:
            return "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(lo, hi))))
        if how == 1 or not known:
            return "".join("bcdfghklmnprstvwz"[int(rng.integers(17))] + "aeiou"[int(rng.integers(5))] + ("", "n", "r", "s")[int(rng.integers(4))] for _ in range(int(rng.integers(1, max(2, hi // 3 + 1)))))
        return known[int(rng.integers(len(known)))]

    pick_ = lambda *x: x[int(rng.integers(len(x)))]
    roll = int(rng.integers(12)) - 2
    if roll < 2:
        at, dot = pick_(("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" @ ", "."), ("{at}", "{dot}"), (" at ", " dot "), (" AT ", " DOT "))
        if rng.random() < 0.35:  # long local parts and domains
            local = word(4, 14) + "".join(pick_(".", "_", "-", "") + word(3, 14) for _ in range(int(rng.integers(0, 6))))
            host = word(3, 14) + "".join(pick_("-", dot, "") + word(3, 14) for _ in range(int(rng.integers(0, 6))))
            return local[:64].rstrip("._-") + at + host + dot + pick_("com", "org", "net", "co" + dot + "uk", "de", "fr"), 0
        return word() + pick_("", "." + word(), "." + word(), digits(2), "_" + word(), "-" + word()) + at + word(3, 10) + pick_("", "", "-" + word(), digits(1)) + dot + pick_("com", "org", "net", "example" + dot + "com", "de", "fr"), 0
    if roll == 2:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), 1
    if roll < 5:
        body = digits(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        number, gap = body + check, pick_("", " ", "-", ".", "  ")
        return gap.join(number[i : i + 4] for i in range(0, 16, 4)), 2
    if roll < 8:
        a, b, c = digits(3), digits(3), digits(4)
        return pick_(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"({a}){b}-{c}", f"0{digits(2)}/{b}{c}", f"{a} {b} {c}"), 3
    junk = pick_(digits(int(rng.integers(1, 9))), digits(int(rng.integers(9, 21))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}", "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 40)), f"{digits(3)},{digits(3)}", f"@{word()}", f"{digits(2)}%", f"https://{word()}.com/{word()}/{digits(3)}?p={digits(2)}")
    return junk, None


def labelled_windows(texts: list[str], rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of text with labelled spans: base matches and what only looks like them in ``texts``, and invented spans amid them."""
    size, out = TRAIN_SIZE, []
    for text in texts:
        spans = base_spans(text)
        marks = [m.start() for m in TRIGGER.finditer(text)]
        for at in (marks[:: max(1, len(marks) // 4)])[:4]:
            lo = max(0, at - int(rng.integers(8, size - 24)))
            hi = min(len(text), lo + size)
            inside = [s for s in spans if s[0] < hi and s[1] > lo]
            if any(s[0] < lo or s[1] > hi for s in inside) or any(b[0] < a[1] for a, b in zip(inside, inside[1:], strict=False)):
                continue
            out.append((text[lo:hi], [(a - lo, b - lo, k) for a, b, k in inside]))
    out = [out[i] for i in rng.permutation(len(out))[: TRAIN_WINDOWS // 3]]
    for text in texts:  # text as it stands, spans or none
        lo = int(rng.integers(0, max(1, len(text) - 2 * size)))
        hi = min(len(text), lo + size)
        inside = [s for s in base_spans(text) if s[0] < hi and s[1] > lo]
        if hi > lo and not inside:
            out.append((text[lo:hi], []))
    known = sorted({w for t in texts[:200] for w in t[:2000].lower().split() if 2 < len(w) < 12 and w.isascii() and w.isalpha()})
    pool = [t for t in texts if len(t) > 3 * size] or ["the quick brown fox jumps over the lazy dog and runs on. " * 8]
    while len(out) < TRAIN_WINDOWS:
        text = pool[int(rng.integers(len(pool)))]
        span, kind = _invent(rng, known)
        lo = int(rng.integers(0, len(text) - 2 * size))
        left = text[lo : lo + int(rng.integers(4, max(5, size - len(span) - 4)))]
        if TRIGGER.search(left):
            left = TRIGGER.sub("x", left)
        left = left.rstrip() + " "
        tail = (" ", " ", " ", ". ", ", ", "\n", ")", "; ", "")[int(rng.integers(9))]
        right = TRIGGER.sub("x", text[lo + size : lo + 2 * size]) if tail else ""
        out.append(((left + span + tail + right)[: max(size, len(left) + len(span) + 4)], [] if kind is None else [(len(left), len(left) + len(span), kind)]))
    return out


def train(texts: list[str], *, epochs: int = 10, rate: float = 0.04, seed: int = 11) -> Tagger:
    """The network from labelled windows, by Adam on the CRF's negative log-likelihood."""
    rng = np.random.default_rng(seed)
    windows = labelled_windows(texts, rng)
    size = max(len(w) for w, _ in windows)
    grid, gold, lengths = np.zeros((len(windows), size), np.int64), np.zeros((len(windows), size), np.int64), np.array([len(w) for w, _ in windows])
    for i, (text, spans) in enumerate(windows):
        grid[i, : len(text)] = symbols(text)
        for a, b, k in spans:
            gold[i, a] = 1 + 2 * k
            gold[i, a + 1 : b] = 2 + 2 * k
    left, right = Lstm(rng), Lstm(rng)
    embed, out, bias = (x.astype(np.float32) for x in (rng.normal(0, 0.7, (N_SYMBOLS, EMBED)), rng.normal(0, 0.2, (2 * HIDDEN, LABELS)), np.zeros(LABELS)))
    trans = np.zeros((LABELS, LABELS))
    params = [embed, left.wx, left.wh, left.b, right.wx, right.wh, right.b, out, bias, trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 64
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        order = order[np.argsort(lengths[order] > 1.25 * TRAIN_SIZE, kind="stable")]  # long windows share batches
        for at in rng.permutation(range(0, len(order), batch)):
            w = order[at : at + batch]
            w = w[np.argsort(-lengths[w], kind="stable")]
            size_ = lengths[w]
            size = int(size_[0])
            g, y = grid[w, :size], gold[w, :size]
            real = np.arange(size)[None, :] < size_[:, None]
            x = embed[g]
            keep_a: list = []
            keep_b: list = []
            a = left.forward(x @ left.wx + left.b, keep_a)
            y_ = turned(x, size_)
            b = turned(right.forward(y_ @ right.wx + right.b, keep_b), size_)
            both = np.concatenate([a, b], axis=2)
            scores = (both @ out + bias).astype(np.float64)
            scores -= scores.max(2, keepdims=True)
            post, moves = forward_backward(np.exp(scores) + 1e-12, size_, np.exp(trans) * ALLOWED, START)
            # half as much for each character by itself, so that plain text is scored as outside without the transitions' help
            alone = np.exp(scores)
            diff = post + 0.5 * alone / alone.sum(2, keepdims=True)
            diff[np.arange(len(w))[:, None], np.arange(size)[None, :], y] -= 1.5
            diff[~real] = 0
            diff /= len(w)
            inside = real[:, 1:]
            np.add.at(moves, (y[:, :-1][inside], y[:, 1:][inside]), -1)
            diff = diff.astype(np.float32)
            dboth = diff @ out.T
            dxa, ga = left.backward(dboth[:, :, :HIDDEN], x, keep_a)
            dxb, gb = right.backward(turned(dboth[:, :, HIDDEN:], size_), y_, keep_b)
            dx = dxa + turned(dxb, size_)
            dembed = np.zeros_like(embed)
            np.add.at(dembed, g.ravel(), dx.reshape(-1, EMBED))
            grads = [dembed, *ga, *gb, both.reshape(-1, 2 * HIDDEN).T @ diff.reshape(-1, LABELS), diff.sum((0, 1)), moves * ALLOWED / len(w)]
            norm = np.sqrt(sum(float((d * d).sum()) for d in grads))
            scale = min(1.0, 5.0 / (norm + 1e-12))
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                d = d * scale
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Tagger(embed, left, right, out, bias, trans)


def _windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover ``n`` characters."""
    starts = range(0, max(1, n - OVERLAP), SPAN_WINDOW - OVERLAP)
    return [(a, min(a + SPAN_WINDOW, n)) for a in starts]


def labelled(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(start, labels, probabilities) of each text's windows that hold a label other than outside, in order."""
    coded = [symbols(t).astype(np.int16) for t in texts]
    windows = [(i, a, b) for i, t in enumerate(texts) for a, b in _windows(len(t)) if b > a]
    windows.sort(key=lambda w: w[1] - w[2])
    found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    at = 0
    while at < len(windows):
        size = windows[at][2] - windows[at][1]
        part = windows[at : at + max(1, AREA // size)]
        at += len(part)
        lengths = np.array([b - a for _, a, b in part])
        grid = np.zeros((len(part), size), np.int64)
        for j, (i, a, b) in enumerate(part):
            grid[j, : b - a] = coded[i][a:b]
        scores = tagger.emissions(grid, lengths)
        open_ = np.flatnonzero(~tagger.certain(scores, lengths))
        for w in np.array_split(open_, max(1, -(-len(open_) // 512))):
            if not len(w):
                continue
            some = np.ascontiguousarray(scores[: lengths[w[0]], :, w])
            labels = tagger.viterbi(some, lengths[w])
            hit = np.flatnonzero(labels.any(1))
            if not len(hit):
                continue
            prob = tagger.sure(some[:, :, hit], labels[hit])
            for j, lab, p in zip(w[hit], labels[hit], prob, strict=True):
                i, a, b = part[j]
                found[i].append((a, lab[: b - a], p[: b - a]))
    for f in found:
        f.sort(key=lambda w: w[0])
    return found


def reconciled(n: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Windows cut down so that they no longer overlap: two neighbours meet where both are outside, as near to the middle of their
    overlap as can be, or else in its middle. Windows that were left out are outside throughout."""
    by_start = {a: (lab, p) for a, lab, p in found}
    out = []
    for a, b in _windows(n):
        if a not in by_start and a + SPAN_WINDOW - OVERLAP not in by_start:
            continue
        lab, p = by_start.get(a, (np.zeros(b - a, np.int64), np.ones(b - a)))
        if b < n:
            nxt, after = by_start.get(b - OVERLAP, (np.zeros(1, np.int64), None))
            mine, theirs = lab[-OVERLAP:], nxt[:OVERLAP] if after is not None else np.zeros(OVERLAP, np.int64)
            both = np.flatnonzero((mine == 0)[: len(theirs)] & (theirs == 0)[: len(mine)])
            cut = int(both[np.abs(both - OVERLAP // 2).argmin()]) if len(both) else OVERLAP // 2
            out.append((a, b - OVERLAP + cut, lab, p))
        else:
            out.append((a, b, lab, p))
    whole = []
    for a, end, lab, p in out:
        begin = max(a, next((e for x, e, *_ in out if x == a - SPAN_WINDOW + OVERLAP), a))
        whole.append((begin, lab[begin - a : end - a], p[begin - a : end - a]))
    return whole


def add_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the network adds to the base spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (text, found) in enumerate(zip(texts, labelled(tagger, texts), strict=True)):
        if not found:
            continue
        for first, lab, sure in reconciled(len(text), found):
            at, n = 0, len(lab)
            for at in np.flatnonzero(lab % 2):
                end = at + 1
                while end < n and lab[end] == lab[at] + 1:
                    end += 1
                start, stop, kind = first + int(at), first + int(end), int(lab[at] - 1) // 2
                while stop > start and not text[stop - 1].isalnum():  # spans of every kind end in a letter or digit
                    stop -= 1
                clear = (stop == len(text) or not text[stop - 1 : stop + 1].isalnum()) and (start == 0 or not text[start - 1 : start + 1].isalnum())
                if stop - start >= 6 and clear and sure[at:end].mean() >= CONFIDENT and _plausible(KINDS[kind], text[start:stop]) and not any(s[0] < stop and s[1] > start for s in base[i]):
                    out[i].append((start, stop, kind))
    return out


def _plausible(kind: str, found: str) -> bool:
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}([ .]+[0-9]{1,3}){3}", found)) and all(map(_octet, re.findall("[0-9]+", found)))
    if kind == "email":
        return bool(SPELLED.fullmatch(found))
    if kind == "phone":
        return fits(kind, found) and bool(re.search(r"[0-9][^0-9]+[0-9]", found))
    return fits(kind, found)


def render(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of spans in order, comma-joined."""
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_list(batch.column(1))
        base = [base_spans(t) for t in texts]
        added = add_spans(tagger, texts, base)
        counts = [[sum(1 for s in spans if s[2] == k) for spans in base] for k in range(len(KINDS))]
        digests = [hashlib.sha256(render(s).encode()).hexdigest() for s in base]
        every = [render([*b, *a]) for b, a in zip(base, added, strict=True)]
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        if keep_text:
            columns.append(pa.array([redact(t, [*b, *a]) for t, b, a in zip(texts, base, added, strict=True)], pa.string()))
            names.append("redacted")
        yield pa.RecordBatch.from_arrays(columns, names)


def _redact(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column(0).to_pylist()
        texts = [t or "" for t in given]
        base = [base_spans(t) for t in texts]
        added = add_spans(tagger, texts, base)
        done = [None if g is None else redact(t, [*b, *a]) for g, t, b, a in zip(given, texts, base, added, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), *batch.columns[1:]], ["__redacted", *batch.schema.names[1:]])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = [t for batch in batches for t in batch.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts))], pa.binary())], ["model"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Tagger:
    """Train on a bounded sample: at most ``train_docs`` documents with a trigger, those with the smallest hash of id and text, and
    of a text above ``train_chars`` characters a stretch of that length. Without any, invented spans in plain text are all there is. One task trains; the driver
    sees the model alone."""
    base = pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull() & F.col("text").rlike("[0-9@]"))
    sample = sample_rows(base, train_docs, "doc_id", "text").select(stretch(F.col("text"), F.xxhash64("doc_id", "text"), train_chars).alias("text")).repartition(1)
    models = map_arrow(sample, _train_task, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([])


def find_personal_data(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), with ``redacted`` on request; one row per input row.

    Counts and ``base_sha256`` are of the base patterns' spans alone; ``spans`` also holds what the network adds. Null text is
    empty: no spans. Whole texts are read, however long. Spans of two kinds may overlap or start together and all count; rows that
    repeat an id or a text are read one by one and give the same. Other columns are ignored; an empty table gives none.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", redacted string" if keep_text else "")
    return map_arrow(base.withColumn("doc_id", F.col("doc_id").cast("long")), _find, schema, tagger=tagger, keep_text=keep_text)


def redact_documents(docs: DataFrame, tagger: Tagger, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; null texts stay null, other columns as they are, whatever their
    names. Rows are read one by one, repeats alike; a run of overlapping spans is replaced once, by the kind of its first."""
    # columns travel under numbers, so that no name of the input can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    fields = StructType([StructField("__redacted", StringType()), *(StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True))])
    rows = docs.toDF(*names)
    out = map_arrow(rows.select(F.col(names[docs.columns.index(text_col)]).alias("__text"), *names), _redact, fields, tagger=tagger)
    return out.select(*(F.col("__redacted" if c == text_col else n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
