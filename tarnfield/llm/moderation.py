"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling, in numpy.

A document is cut into overlapping windows of words, every window is scored, and the document's score is that of its
worst window. Each word enters by two channels: an embedding of the (normalised) word and the mean embedding of its
character trigrams, so that unusual spellings stay close to the usual one.

Ratings are given per document, and some are wrong. Training therefore is multiple-instance learning: phrase
statistics nominate the window that speaks for each positive document, the network is trained on the nominated
windows against windows of negative documents, nominates again, and leaves out documents whose rating it finds
contradicted clearly.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.session import stored

WIDTH, STRIDE = 24, 16
WORDS, GRAMS = 1 << 14, 1 << 13
EMB, HID = 24, 16

# Letters of other alphabets that look like Latin ones, and figures and signs used for letters.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡαβεικνορτυχ", "abekmhopctyxijsdgabeikvoptux")
FIGURES = str.maketrans("@4831!05$7+€", "aabeiioss" + "tte")
SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_]{1,2}){3,}\w(?!\w)")
SEPARATORS = ",;/_|<>"
EDGE = "\"'`´‘’“”«»‹›.,;:?!()[]{}<>/\\|~^#=&_-–—…•·"
LONG = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"(?<=\w)[.\-_·'’]+(?=\w)")
PIECE = 40  # letters of a word; longer ones become several words


def plain_words(token: str) -> list[str]:
    """A token in one spelling: compatibility forms, case, accents, look-alikes, figures for letters, stretched letters.

    Marks inside a token are dropped, and so are invisible characters; where that would give a word of more than
    ``PIECE`` letters, the token is a joined passage and is taken apart at them, and what is still longer is cut into
    pieces of that length. Nothing of a token is left out.
    """
    t = token
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        kinds = [(c, unicodedata.category(c)) for c in t]
        t = "".join("·" if k == "Cf" else c for c, k in kinds if k != "Mn").casefold().translate(LOOKALIKES)
    else:
        t = t.lower()
    t = t.strip(EDGE)
    if not t:
        return []
    if t.isalpha():
        t = LONG.sub(r"\1", t)
        return [t[i : i + PIECE] for i in range(0, len(t), PIECE)]
    if len(t) > PIECE and len(INNER.sub("", t)) > PIECE:
        parts = INNER.split(t)
        if len(parts) > 1:
            return [w for part in parts for w in plain_words(part)]
    if t.isdigit():
        return ["0"]
    digits = sum(c.isdigit() for c in t)
    t = INNER.sub("", t)
    if any(c.isalpha() for c in t) and digits <= 0.7 * len(t):
        t = t.translate(FIGURES)
    elif digits:
        t = re.sub(r"\d+", "0", t)
    t = LONG.sub(r"\1", re.sub(r"[*#]+", "*", t))
    return [t[i : i + PIECE] for i in range(0, len(t), PIECE)]


def tokens(text: str | None, *, spelled: bool = True) -> list[str]:
    """Tokens between white space and separators; ``spelled``: letters that are spelled apart are drawn together."""
    if not text:
        return []
    if spelled:
        text = SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text)
    for c in SEPARATORS:
        if c in text:
            text = text.replace(c, " ")
    return text.split()


class _Raw(dict):
    """Token -> row of the lexicon's token table, made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, token: str) -> int:
        n = self[token] = self.make(token)
        return n


class Lexicon:
    """Numbers for words, with the buckets of both channels; number 0 is the filling at the end of a text."""

    def __init__(self):
        self.raw = _Raw(self._token)
        self.plain: dict[str, int] = {}
        self.word = [0]
        self.grams: list[list[int]] = [[0]]
        #: per token: the number of its word (0: none, below 0: several, see ``many``) and its single letters, if it has no others
        self.number, self.letters = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.many: list[list[int]] = [[]]

    def _token(self, token: str) -> int:
        row = len(self.raw)
        if row == len(self.number):
            self.number, self.letters = np.r_[self.number, np.zeros_like(self.number)], np.r_[self.letters, np.zeros_like(self.letters)]
        numbers = [self._word(w) for w in plain_words(token)]
        if len(numbers) > 1:
            self.number[row] = -len(self.many)
            self.many.append(numbers)
        elif numbers:
            self.number[row] = numbers[0]
        parts = re.split(r"[.\-_]+", token.strip(EDGE))
        self.letters[row] = len(parts) if all(len(x) == 1 and (x.isalnum() or x == "_") for x in parts) else 0
        return row

    def _word(self, p: str) -> int:
        n = self.plain.get(p)
        if n is None:
            n = self.plain[p] = len(self.word)
            self.word.append(1 + zlib.crc32(p.encode()) % (WORDS - 1))
            s = f"<{p}>"
            self.grams.append([1 + zlib.crc32(s[i : i + 3].encode()) % (GRAMS - 1) for i in range(max(1, len(s) - 2))])
        return n

    def encode(self, text: str | None) -> np.ndarray:
        """Word numbers of a text."""
        found = tokens(text, spelled=False)
        rows = np.fromiter(map(self.raw.__getitem__, found), np.int64, len(found))
        if self._apart(self.letters[rows]):
            found = tokens(text)
            rows = np.fromiter(map(self.raw.__getitem__, found), np.int64, len(found))
        numbers = self.number[rows]
        if len(numbers) and numbers.min() < 0:
            numbers = np.array([n for x in numbers.tolist() for n in (self.many[-x] if x < 0 else (x,))], np.int32)
        return numbers[numbers != 0]

    @staticmethod
    def _apart(letters: np.ndarray) -> bool:
        """Whether four letters or more may be spelled apart somewhere (the pattern then decides)."""
        single = letters > 0
        if not (single[1:] & single[:-1]).any():
            return False
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        total = np.r_[0, np.cumsum(letters)]
        return bool((total[edge[1::2]] - total[edge[::2]] >= 4).any())

    def full(self, most: int = 200_000) -> bool:
        return len(self.raw) > most


def windows(numbers: list[int] | np.ndarray) -> np.ndarray:
    """All windows of a text (rows of WIDTH word numbers): one every STRIDE words, the last one filled with 0."""
    n = len(numbers)
    count = max(1, -(-max(n - WIDTH, 0) // STRIDE) + 1)
    flat = np.zeros((count - 1) * STRIDE + WIDTH, np.int32)
    flat[:n] = numbers
    return np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # tanh form: one transcendental, no overflow
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Parameters and both passes; ``p`` maps names to float32 arrays."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * np.sqrt(1 / s[0])).astype(np.float32)
        p = {"word": 0.1 * r.standard_normal((WORDS, EMB)).astype(np.float32), "gram": 0.3 * r.standard_normal((GRAMS, EMB)).astype(np.float32)}
        for d in "fb":  # forward and backward direction
            p |= {f"W{d}": f(EMB, 3 * HID), f"U{d}": f(HID, 3 * HID), f"c{d}": np.zeros(3 * HID, np.float32)}
        p |= {"att": f(2 * HID), "out": f(2 * HID), "bias": np.zeros(1, np.float32)}
        return cls(p)

    def embed(self, word: np.ndarray, grams: list[list[int]], drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of words, and the flat trigram buckets with the word of each."""
        size = np.array([len(g) for g in grams])
        flat = np.array([x for g in grams for x in g], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        at = np.r_[0, np.cumsum(size)[:-1]]
        e = np.add.reduceat(self.p["gram"][flat], at, axis=0) / size[:, None]
        w = self.p["word"][word]
        return e + (w if drop is None else w * drop[:, None]), flat, owner

    def project(self, e: np.ndarray) -> np.ndarray:
        """Input part of the gates of both directions, per word."""
        return np.hstack([e @ self.p["Wf"] + self.p["cf"], e @ self.p["Wb"] + self.p["cb"]]).astype(np.float32)

    def score(self, x: np.ndarray, table: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Logits of windows ``x`` of word numbers, given the projections of the words.

        The same function as :meth:`_forward`, arranged for speed: sigmoids are taken as tanh with halved weights, each
        gate is an array of its own, and of every state only what attention and output need is kept.
        """
        gates, both = [], np.stack([self.p["att"], self.p["out"]], axis=1)
        for d, name in enumerate("fb"):
            u = self.p[f"U{name}"].reshape(HID, 3, HID).transpose(1, 0, 2) * np.float32(0.5)  # z, r, n
            mine = table[:, d * 3 * HID : (d + 1) * 3 * HID].reshape(-1, 3, HID).transpose(1, 0, 2) * np.array([0.5, 0.5, 1], np.float32)[:, None, None]
            gates.append((np.ascontiguousarray(u), np.ascontiguousarray(mine), np.ascontiguousarray(both[d * HID : (d + 1) * HID])))
        out = np.empty(len(x), np.float32)
        for s in range(0, len(x), rows):
            out[s : s + rows] = self._logits(np.ascontiguousarray(x[s : s + rows].T), gates)
        return out

    def _logits(self, xt: np.ndarray, gates: list) -> np.ndarray:
        steps, b = xt.shape
        seen = np.zeros((steps, b, 2), np.float32)
        g, q, n, t1 = np.empty((3, b, HID), np.float32), np.empty((3, b, HID), np.float32), np.empty((b, HID), np.float32), np.empty((b, HID), np.float32)
        for d, (u, table, view) in enumerate(gates):
            h = np.zeros((b, HID), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                for k in range(3):
                    np.take(table[k], xt[t], axis=0, out=g[k], mode="clip")
                np.matmul(h, u, out=q)
                zr = g[:2]
                zr += q[:2]
                np.tanh(zr, out=zr)
                np.multiply(zr[1], q[2], out=n)
                n += q[2]
                n += g[2]
                np.tanh(n, out=n)
                np.subtract(h, n, out=t1)
                t1 *= zr[0]
                h += n
                h += t1
                h *= np.float32(0.5)
                seen[t] += h @ view
        a = np.where(xt == 0, np.float32(-30), seen[:, :, 0])
        a -= a.max(axis=0)
        np.exp(a, out=a)
        return (a * seen[:, :, 1]).sum(axis=0) / a.sum(axis=0) + self.p["bias"][0]

    def _forward(self, xt: np.ndarray, table: np.ndarray, *, keep: bool):
        steps, b = xt.shape
        o = np.empty((steps, b, 2 * HID), np.float32)
        tape = {}
        for d, name in enumerate("fb"):
            u, h, trace = self.p[f"U{name}"], np.zeros((b, HID), np.float32), []
            mine = table[:, d * 3 * HID : (d + 1) * 3 * HID]
            mine = np.ascontiguousarray(mine) if len(mine) < 4 * xt.size else mine
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = mine[xt[t]]
                q = h @ u
                g[:, : 2 * HID] += q[:, : 2 * HID]
                zr = _sigmoid(g[:, : 2 * HID])
                z, r = zr[:, :HID], zr[:, HID:]
                n = np.tanh(g[:, 2 * HID :] + r * q[:, 2 * HID :])
                new = n + z * (h - n)
                if keep:
                    trace.append((t, h, z, r, n, q[:, 2 * HID :]))
                h = new
                o[t, :, d * HID : (d + 1) * HID] = h
            tape[name] = trace
        a = o @ self.p["att"]
        a[xt == 0] = -30
        a -= a.max(axis=0)
        np.exp(a, out=a)
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, o)
        return pooled @ self.p["out"] + self.p["bias"][0], (o, a, pooled, tape)

    def gradients(self, xt: np.ndarray, table: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss (weighted log loss), gradients of the dense parameters, and those of the rows of ``table``."""
        logit, (o, a, pooled, tape) = self._forward(xt, table, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
        dl = (weight * (prob - y) / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["out"]
        da = np.einsum("bh,tbh->tb", dp, o)
        ds = a * (da - (a * da).sum(axis=0))
        ds[xt == 0] = 0
        do = a[:, :, None] * dp[None] + ds[:, :, None] * self.p["att"]
        g["att"] = np.einsum("tb,tbh->h", ds, o)
        dtable = np.zeros((*xt.shape, 6 * HID), np.float32)
        for d, name in enumerate("fb"):
            u, du, dh = self.p[f"U{name}"], np.zeros_like(self.p[f"U{name}"]), np.zeros((xt.shape[1], HID), np.float32)
            for t, h, z, r, n, qn in reversed(tape[name]):
                dh = dh + do[t, :, d * HID : (d + 1) * HID]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * qn * r * (1 - r)
                mine = dtable[t, :, d * 3 * HID : (d + 1) * 3 * HID]
                mine[:, :HID], mine[:, HID : 2 * HID], mine[:, 2 * HID :] = dz, dr, dn
                dq = mine.copy()
                dq[:, 2 * HID :] *= r
                du += h.T @ dq
                dh = dh * z + dq @ u.T
            g[f"U{name}"] = du
        return loss, g, dtable


class Trainer:
    """Adam for the dense parameters, Adagrad on the rows that a batch touches for the embeddings."""

    def __init__(self, net: Network, lex: Lexicon, seed: int = 7):
        self.net, self.lex, self.rng, self.t = net, lex, np.random.default_rng(seed), 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "gram")}
        self.v = {k: np.zeros_like(v) for k, v in self.m.items()}
        self.sq = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "gram")}

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 4e-3, forget: float = 0.2) -> float:
        net, lex = self.net, self.lex
        used, xt = np.unique(x.T, return_inverse=True)
        xt = xt.reshape(x.T.shape)
        xt = xt if used[0] == 0 else xt + 1  # row 0 of the table is the filling
        used = used if used[0] == 0 else np.r_[0, used]
        word, grams = np.array([lex.word[i] for i in used]), [lex.grams[i] for i in used]
        keep = (self.rng.random(len(used)) >= forget).astype(np.float32)  # so that trigrams learn to stand alone
        e, flat, owner = net.embed(word, grams, keep)
        loss, g, dtable = net.gradients(xt, net.project(e), y, weight)
        d = dtable.reshape(-1, 6 * HID)
        order = np.argsort(xt.ravel(), kind="stable")
        rows = xt.ravel()[order]
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        du = np.zeros((len(used), 6 * HID), np.float32)
        du[rows[at]] = np.add.reduceat(d[order], at, axis=0)
        for k, part in (("f", du[:, : 3 * HID]), ("b", du[:, 3 * HID :])):
            g[f"W{k}"], g[f"c{k}"] = e.T @ part, part.sum(axis=0)
        de = du[:, : 3 * HID] @ net.p["Wf"].T + du[:, 3 * HID :] @ net.p["Wb"].T
        self._rows("word", word, de * keep[:, None], rate)
        size = np.bincount(owner, minlength=len(used))
        self._rows("gram", flat, (de / size[:, None])[owner], rate)
        self.t += 1
        for k in self.m:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.99 * self.v[k] + 0.01 * g[k] ** 2
            net.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)
        return loss

    def _rows(self, name: str, ids: np.ndarray, grad: np.ndarray, rate: float) -> None:
        order = np.argsort(ids, kind="stable")
        at = np.flatnonzero(np.diff(ids[order], prepend=-1))
        rows, total = ids[order][at], np.add.reduceat(grad[order], at, axis=0)
        self.sq[name][rows] += (total**2).mean(axis=1)
        self.net.p[name][rows] -= 5 * rate * total / (np.sqrt(self.sq[name][rows])[:, None] + 1e-6) * 0.2


def table_of(net: Network, lex: Lexicon, known: np.ndarray | None = None) -> np.ndarray:
    """Projections of all words of the lexicon; ``known`` are those of its first words."""
    start = 0 if known is None else len(known)
    if start == len(lex.word):
        return known
    new = net.project(net.embed(np.array(lex.word[start:]), lex.grams[start:])[0])
    return new if known is None else np.vstack([known, new])


def _phrases(x: np.ndarray) -> np.ndarray:
    """Codes of the distinct words and word pairs of a text (numbers of the lexicon)."""
    x = np.asarray(x, np.int64)
    return np.unique(np.r_[x, (x[:-1] << 32) + x[1:]])


def _phrase_odds(numbers: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the phrases that are tied to positive texts, ascending, and how strongly; counted over the texts in ``use``."""
    seen = [[_phrases(n) for n, c, u in zip(numbers, y, use) if u and c == label] for label in (0, 1)]
    total = [max(1, len(s)) for s in seen]
    code, positive = np.unique(np.concatenate(seen[1] or [np.empty(0, np.int64)]), return_counts=True)
    code, positive = code[positive > 1], positive[positive > 1]
    other, negative = np.unique(np.concatenate(seen[0] or [np.empty(0, np.int64)]), return_counts=True)
    at = np.minimum(np.searchsorted(other, code), max(len(other) - 1, 0))
    count = np.where(other[at] == code, negative[at], 0) if len(other) else np.zeros(len(code), np.int64)
    odds = _surprise(positive, count, total)
    return code[odds > 0], odds[odds > 0]


def _window_lift(x: np.ndarray, code: np.ndarray, odds: np.ndarray, *, best: int = 3) -> np.ndarray:
    """Per window the sum of its ``best`` strongest distinct phrases."""
    out = np.zeros(len(x), np.float32)
    if not len(code):
        return out
    for s in range(0, len(x), 16_384):
        w = x[s : s + 16_384].astype(np.int64)
        pair = np.where(w[:, 1:] > 0, (w[:, :-1] << 32) + w[:, 1:], 0)
        all_ = np.hstack([w, pair])
        at = np.minimum(np.searchsorted(code, all_), len(code) - 1)
        row, col = np.nonzero(code[at] == all_)
        at = at[row, col]
        # codes are ascending and unique, so their places stand for them
        row, at = np.divmod(np.unique(row * len(code) + at), len(code))
        v = odds[at]
        order = np.lexsort((-v, row))
        row, v = row[order], v[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < best
        out[s : s + len(w)] = np.bincount(row[first], v[first], len(w))
    return out


def _surprise(positive: np.ndarray, negative: np.ndarray, total: list[int], least: float = 1.0) -> np.ndarray:
    """How strongly phrases are tied to positive documents: log odds at the cautious end of both counts, 0 below ``least``."""
    low, high = positive - 1.3 * positive**0.5, negative + 1.3 * (negative + 1) ** 0.5
    odds = np.log(np.maximum(low, 1e-3) / total[1]) - np.log(high / total[0])
    return np.where(odds > least, odds, 0.0)


def train(texts: list[str | None], labels: np.ndarray, *, rounds: int = 4, steps: int = 300, batch: int = 192, rate: float = 4e-3, seed: int = 7) -> Network:
    """Train on rated texts (label 1 or 0 per text); see the module for the method. Without both labels present the
    network is left untrained and its threshold is above every score, so nothing is found."""
    net, lex, rng = Network.new(seed), Lexicon(), np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    if not 0 < y.sum() < len(y):
        net.threshold = 1.1
        return net
    numbers = [lex.encode(t) for t in texts]
    wins = [windows(n) for n in numbers]
    doc = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    x = np.concatenate(wins)
    held = rng.random(len(y)) < 0.15 if len(y) >= 200 else np.zeros(len(y), bool)  # for the threshold
    # nomination 0: phrases that occur in positive documents far more often than in negative ones
    lift = _window_lift(x, *_phrase_odds(numbers, y, ~held))
    rank, trainer = lift, Trainer(net, lex, seed)
    told = np.zeros(len(y), np.float32)  # what the phrases say of each document
    np.maximum.at(told, doc, lift)
    # what chance gives, as seen in negative documents; the first round trusts positive ratings that phrases confirm.
    # Negative documents all stay: what is wrong among them is rare beside the positive windows, and what merely looks
    # abusive (quoted in a ticket, say) can be learned nowhere else.
    chance = float(np.quantile(told[(y == 0) & ~held], 0.92))
    trusted = ~held & ((y == 0) | (told > chance))
    if not (trusted & (y == 1)).any():
        trusted = ~held
    for r in range(rounds):
        order = np.lexsort((-rank, doc))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x)) - np.searchsorted(doc[order], doc[order])
        pos = np.flatnonzero((y[doc] == 1) & trusted[doc] & ((place == 0) | ((r > 0) & (rank > 2.5) & (place < 4))))
        hard = np.flatnonzero((y[doc] == 0) & trusted[doc] & (place < 2))
        rest = np.flatnonzero((y[doc] == 0) & trusted[doc] & (place >= 2))
        peak = hard[np.argsort(-rank[hard], kind="stable")[: max(1, len(hard) // 10)]]  # what looks abusive and is not
        shares = ((pos, 0.32), (peak, 0.2), (hard, 0.2), (rest, 0.28))
        for step in range(steps):
            b = np.concatenate([rng.choice(part, int(share * batch)) for part, share in shares if len(part)])
            lab = y[doc[b]].astype(np.float32)
            trainer.step(x[b], lab * 0.92 + 0.02, np.ones(len(b), np.float32), rate=rate * (1 - 0.8 * (r * steps + step) / (rounds * steps)))
        logit = net.score(x, table_of(net, lex))
        best = np.full(len(y), -50.0, np.float32)
        np.maximum.at(best, doc, logit)
        # the network nominates, phrases speak for what it has not learned yet
        rank = logit + 0.5 * np.clip(lift - chance, 0, 8)
        # positive ratings that network and phrases contradict are left out
        trusted = ~held & ((y == 0) | (best > 0) | (told > chance + (r > 1)))
    if held.any() and 0 < y[held].sum() < held.sum():
        net.threshold = _best_threshold(1 / (1 + np.exp(-best[held])), y[held])
    return net


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds whose F1 is about the best."""
    grid = np.arange(0.3, 0.81, 0.02)
    f1 = np.array([2 * (y[score >= t]).sum() / max(1, (score >= t).sum() + y.sum()) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 0.004]))


def rated_sample(docs: DataFrame, ratings: DataFrame, *, most: int = 9000, characters: int = 60_000_000, seed: int = 5) -> list[tuple[str | None, int]]:
    """(text, label) of at most about ``most`` rated documents with about ``characters`` characters in all: the majority
    of the distinct ratings of each; ties, and null ratings, are left out. The sample is drawn by a hash of the
    document, so what reaches the driver is bounded in rows and in bytes, whatever the texts' lengths."""
    votes = ratings.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "rater", "toxic").distinct().groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5")
    rated = stored(votes.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", (F.col("share") > 0.5).cast("int").alias("y")), "rated")
    size = rated.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    share = min(1.0, most / max(size.n, 1), characters / max(size.c or 0, 1))
    rows = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).orderBy("doc_id").collect()
    return [(r.text, r.y) for r in rows]


def score_documents(docs: DataFrame, net: Network, *, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, windows): probability of the worst window of each whole text.

    Null ids are dropped; null and blank texts have score 0 and no window; repeated rows are scored each.
    """
    rows = docs.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, table = Lexicon(), None
        for b in batches:
            texts, score, count = b["text"].to_pylist(), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            start = 0
            while start < len(texts):
                if lex.full():
                    lex, table = Lexicon(), None
                held, size, end = [], 0, start
                while end < len(texts) and size < 40_000:  # windows at once
                    numbers = lex.encode(texts[end])
                    if len(numbers):
                        held.append((end, windows(numbers)))
                        size += len(held[-1][1])
                    end += 1
                if held:
                    table = table_of(net, lex, table)
                    logit = net.score(np.concatenate([w for _, w in held]), table)
                    at = np.array([i for i, _ in held])
                    many = np.array([len(w) for _, w in held])
                    worst = np.maximum.reduceat(logit, np.r_[0, np.cumsum(many)[:-1]])
                    score[at], count[at] = 1 / (1 + np.exp(-worst.astype(np.float64))), many
                start = end
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array(count)], names=["doc_id", "score", "windows"])

    return rows.mapInArrow(run, "doc_id bigint, score double, windows bigint")
