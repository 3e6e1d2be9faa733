"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy (operator 10).

A text is read in overlapping windows of words. Each word enters as the log-odds of the word itself and of its prefixes and
suffix, counted over training texts, and as the mean of vectors of its character trigrams, which are hashed and learned with
the network. (Vectors of words themselves, learned likewise, told fewer held-out texts right.) Two gated recurrent passes read the window from both ends, attention pools their states, and the pooled state gives the window's
logit. A text's logit is the largest of all its windows, and a logistic fit on training texts makes it a probability at
the labels' true proportions. In all that is fitted, each text's log-odds come from counts over the other half of the
sample, so that a word seen in a single text doesn't give that text's label away.

Fitting takes a bounded sample: at most ``POSITIVE`` and ``NEGATIVE`` labelled texts, whole and of whatever length, which stay
in a table of their own. The driver trains on at most ``DRAWN`` windows of each, chosen among all of the text: first those of the largest log-odds, then those that the network
so far finds the most toxic. The logistic is fitted on the
largest logits of all windows. Scoring reads every window of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

POSITIVE, NEGATIVE = 2500, 5000
#: Windows of a text, by label, that training draws from; the bound on them bounds the driver's memory.
DRAWN = {1: 4, 0: 3}
WINDOW, STRIDE = 48, 40
#: States, rounds of training, and the steps, windows and pace of each.
HIDDEN, ROUNDS, STEPS, BATCH, RATE = 8, 3, 100, 192, 0.02
#: Size of trigrams' vectors, their buckets and pace, and the part of words that are trained without them.
CHARS, BUCKETS, PACE, HIDE = 6, 1 << 14, 0.1, 0.2
PREFIXES, SUFFIX = (3, 4, 5, 6), 4
#: Pseudo-texts in log-odds; what fewer texts of the sample than LEAST hold has none.
SMOOTH, LEAST = 4.0, 2
ODDS = 2 + len(PREFIXES)
INPUTS = ODDS + CHARS + 2
#: Words whose inputs a Python worker keeps, and words that it scores at a time.
KEPT, GROUP = 150_000, 50_000
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’…–—¡¿·"


def plain(raw: str) -> str:
    return raw.strip(_EDGE).lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word between two marks, word by word, and how many each word has; an empty word has one of marks alone."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join([f"<{w}>" for w in words] + [">"]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - 2, 1)
    where = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())
    h = (chars[where] * np.uint64(1_000_003) + chars[where + 1]) * np.uint64(1_000_003) + np.where(np.repeat(sizes, count) > 2, chars[where + 2], 0)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % BUCKETS, count


def length_input(word: str) -> float:
    return min(len(word), 20) // 4 / 5


def pieces(word: str) -> list[tuple[int, str]]:
    """The word, its prefixes and its suffix, each with its kind; the kind also begins the piece's key."""
    out = [(0, f"0{word}")] + [(i + 1, f"{i + 1}{word[:n]}") for i, n in enumerate(PREFIXES) if len(word) >= n]
    return out + [(ODDS - 1, f"{ODDS - 1}{word[-SUFFIX:]}")] if len(word) >= SUFFIX else out


def half_of(id_: int) -> int:
    return zlib.crc32(str(id_).encode()) >> 9 & 1


def counted(sample: DataFrame) -> pd.DataFrame:
    """The pieces that LEAST texts or more hold, and how many of each half and label do: piece, n0 to n3 by 2 * half + label."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for frame in frames:
            for i, text, toxic in zip(frame["__id"], frame["text"], frame["__toxic"]):
                for piece in {k for w in set(map(plain, text.split())) for _, k in pieces(w)}:
                    found.setdefault(piece, [0, 0, 0, 0])[2 * half_of(i) + toxic] += 1
        yield pd.DataFrame([(k, *n) for k, n in found.items()], columns=["piece", "n0", "n1", "n2", "n3"])

    sums = sample.mapInPandas(apply, "piece string, n0 long, n1 long, n2 long, n3 long").groupBy("piece").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))
    # bounded as the sample is
    return sums.where(f"n0 + n1 + n2 + n3 >= {LEAST}").orderBy("piece").toPandas()


def odds(counts: pd.DataFrame, halves: list[int], share: float) -> dict[str, float]:
    """Smoothed log-odds of each piece in the texts of these halves, less those of the labels; none for what says little."""
    no, yes = (sum(counts[f"n{2 * h + y}"].to_numpy(np.float64) for h in halves) for y in (0, 1))
    share = min(max(share, 1e-3), 1 - 1e-3)
    x = np.log((yes + SMOOTH * share) / (no + SMOOTH * (1 - share))) - np.log(share / (1 - share))
    x = np.where(yes + no >= LEAST, np.round(x * 5) / 10, 0)
    return {k: float(v) for k, v in zip(counts["piece"], x) if abs(v) > 0.1}


class Vocabulary:
    """The words of training windows as numbers, one for each half of the sample: their log-odds and trigrams."""

    def __init__(self, windows: list[str], owners: list[int], tables: list[dict[str, float]]) -> None:
        number: dict[tuple[str, int], int] = {}
        self.at = np.full((len(windows), WINDOW), -1, np.int32)
        for row, (window, owner) in enumerate(zip(windows, owners)):
            half = half_of(owner)
            for k, raw in enumerate(window.split()[:WINDOW]):
                self.at[row, k] = number.setdefault((plain(raw), half), len(number))
        self.fixed = np.zeros((len(number), ODDS), np.float32)
        for i, (word, half) in enumerate(number):
            for kind, piece in pieces(word):
                self.fixed[i, kind] = tables[half].get(piece, 0)
        self.grams, self.count = trigrams([w for w, _ in number])
        self.begin = np.cumsum(self.count) - self.count
        self.length = np.fromiter((length_input(w) for w, _ in number), np.float32, len(number))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    shapes = {"Wf": (INPUTS, 3 * h), "Uf": (h, 3 * h), "Wb": (INPUTS, 3 * h), "Ub": (h, 3 * h), "v": (2 * h,), "w": (2 * h,)}
    return {k: (rng.standard_normal(s) * (0.4 if k[0] in "Ww" else 0.2)).astype(np.float32) for k, s in shapes.items()} | {"c": np.zeros(1, np.float32)}


def recur(x: np.ndarray, U: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps x hidden x windows) of one gated pass over projected inputs x (steps x 3 hidden x windows)."""
    n, kept = HIDDEN, []
    out = np.empty((len(x), n, x.shape[2]), np.float32)
    h = np.zeros((n, x.shape[2]), np.float32)
    up = np.ascontiguousarray(U.T)
    for t in range(len(x)):
        u = up @ h
        gates = u[: 2 * n] + x[t, : 2 * n]
        gates *= 0.5  # a sigmoid is a tanh of half its argument, scaled
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        c = gates[n:] * u[2 * n :]
        c += x[t, 2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= gates[:n]
        new += c
        if mask is not None:
            new = np.where(mask[t], new, h)
        if keep:
            kept.append((h, u, gates, c))
        out[t] = h = new
    return out, kept


def recur_back(dout: np.ndarray, U: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of U."""
    n, dU, dx = HIDDEN, np.zeros_like(U), np.zeros((len(dout), 3 * HIDDEN, dout.shape[2]), np.float32)
    dh = np.zeros(dout.shape[1:], np.float32)
    for t in range(len(dout) - 1, -1, -1):
        h, u, gates, c = kept[t]
        z, r = gates[:n], gates[n:]
        g = dout[t] + dh
        live = np.where(mask[t], g, 0)
        dc = live * (1 - z) * (1 - c * c)
        dx[t, :n] = live * (h - c) * z * (1 - z)
        dx[t, n : 2 * n] = dc * u[2 * n :] * r * (1 - r)
        dx[t, 2 * n :] = dc
        du = dx[t].copy()
        du[2 * n :] *= r
        dU += h @ du.T
        dh = np.where(mask[t], live * z, g) + U @ du
    return dx, dU


def _pooled(p: dict[str, np.ndarray], hf: np.ndarray, hb: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All states (steps x 2 hidden x windows), their attention and what it pools."""
    h = np.concatenate([hf, hb[::-1]], axis=1)
    e = np.where(mask, np.matmul(p["v"], h), np.float32(-1e9))
    a = np.exp(e - e.max(0)) * mask
    a /= np.maximum(a.sum(0), 1e-9)
    return h, a, np.einsum("tb,thb->hb", a, h)


def logits(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows from the projected inputs of both passes (steps x 6 hidden x windows)."""
    m = None if mask.all() else mask
    hf, _ = recur(x[:, : 3 * HIDDEN], p["Uf"], m)
    hb, _ = recur(x[::-1, 3 * HIDDEN :], p["Ub"], None if m is None else m[::-1])
    return p["w"] @ _pooled(p, hf, hb, mask)[2] + p["c"][0]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of windows x (steps x inputs x windows); that of x itself too."""
    hf, kf = recur(np.matmul(p["Wf"].T, x), p["Uf"], mask, True)
    hb, kb = recur(np.matmul(p["Wb"].T, x[::-1]), p["Ub"], mask[::-1], True)
    h, a, pooled = _pooled(p, hf, hb, mask)
    d = (_sigmoid(p["w"] @ pooled + p["c"][0]) - y) * weight / len(y)
    dp = p["w"][:, None] * d
    da = np.einsum("thb,hb->tb", h, dp)
    de = a * (da - (a * da).sum(0))
    dh = a[:, None, :] * dp + de[:, None, :] * p["v"][:, None]
    xf, uf = recur_back(dh[:, :HIDDEN], p["Uf"], mask, kf)
    xb, ub = recur_back(dh[::-1, HIDDEN:], p["Ub"], mask[::-1], kb)
    return {
        "x": np.matmul(p["Wf"], xf) + np.matmul(p["Wb"], xb)[::-1],
        "Wf": np.einsum("tib,tob->io", x, xf, optimize=True), "Uf": uf, "Wb": np.einsum("tib,tob->io", x[::-1], xb, optimize=True), "Ub": ub,
        "v": np.einsum("tb,thb->h", de, h), "w": pooled @ d, "c": np.array([d.sum()], np.float32),
    }


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a and b of the weighted logistic a x + b of y, by Newton steps that are halved until the loss falls."""
    def loss(v: np.ndarray) -> float:
        s = v[0] * x + v[1]
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + 5e-4 * (v[0] - 1) ** 2)

    v = np.array([1.0, 0.0])
    for _ in range(60):
        q = _sigmoid(v[0] * x + v[1])
        s = weight * np.maximum(q * (1 - q), 1e-9)
        g = np.array([(weight * (q - y) * x).sum() + 1e-3 * (v[0] - 1), (weight * (q - y)).sum()])
        move = np.linalg.solve(np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]]), g)
        size = 1.0
        while size > 1e-6 and loss(v - size * move) > loss(v):
            size /= 2
        v = v - size * move
    return float(max(v[0], 0.05)), float(v[1])


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE))


class Trainer:
    """Network and vectors in training; windows are rows of numbers of a vocabulary."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.p = parameters(self.rng)
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.chars = (self.rng.standard_normal((BUCKETS, CHARS)) * 0.1).astype(np.float32)
        self.seen = np.full(self.chars.shape, 1e-4, np.float32)
        self.step = 0

    def train(self, v: Vocabulary, y: np.ndarray, steps: int) -> None:
        """Steps of stochastic descent, half of each batch from each label."""
        rng, p = self.rng, self.p
        sides = [np.flatnonzero(y == label) for label in (0, 1)]
        for k in range(steps):
            pick = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
            at = v.at[pick].T
            mask = at >= 0
            ids, back = np.unique(np.where(mask, at, 0), return_inverse=True)
            back = back.ravel()
            count = v.count[ids]
            grams = v.grams[np.repeat(v.begin[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            shown = (rng.random(len(ids)) >= HIDE)[:, None]
            mean = shown * np.add.reduceat(self.chars[grams], np.cumsum(count) - count, axis=0) / count[:, None]
            each = np.concatenate([v.fixed[ids], mean, v.length[ids][:, None], np.ones((len(ids), 1), np.float32)], axis=1).astype(np.float32)
            x = np.ascontiguousarray(each[back].reshape(*at.shape, INPUTS).transpose(0, 2, 1))
            found = gradients(p, x, mask, y[pick].astype(np.float32), np.ones(len(pick), np.float32))
            dx = (found.pop("x") * mask[:, None, :]).transpose(0, 2, 1).reshape(-1, INPUTS)[:, ODDS : ODDS + CHARS]
            dx = shown * np.stack([np.bincount(back, dx[:, c], len(ids)) for c in range(CHARS)], 1)
            # each step of a bucket is shorter the more it has moved
            own, inner = np.unique(grams, return_inverse=True)
            share = np.repeat(dx / count[:, None], count, axis=0)
            grad = np.stack([np.bincount(inner, share[:, c], len(own)) for c in range(CHARS)], 1).astype(np.float32)
            self.seen[own] += grad * grad
            self.chars[own] -= PACE * (1 - k / steps) * grad / np.sqrt(self.seen[own])
            self.step += 1
            for name, grad in found.items():
                grad = np.clip(grad, -1, 1)
                self.first[name] = 0.9 * self.first[name] + 0.1 * grad
                self.second[name] = 0.99 * self.second[name] + 0.01 * grad * grad
                move = (self.first[name] / (1 - 0.9**self.step)) / (np.sqrt(self.second[name] / (1 - 0.99**self.step)) + 1e-7)
                p[name] = (p[name] - RATE * (1 - k / steps) * move).astype(np.float32)

    def model(self, table: dict[str, float]) -> dict:
        return {"p": self.p, "table": table, "chars": self.chars, "a": 1.0, "b": 0.0}


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[DataFrame, float]:
    """Texts of labelled rows outside the held-out fold (__id, text, __toxic), and the part of labels that are 1.

    The first ids by hash of each label; their texts follow by a join with at most POSITIVE + NEGATIVE broadcast ids, and stay
    in a table in the shared folder. A doc_id with several labels is toxic if one of them says so; equal texts of a label are one.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    counts = dict(known.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect())
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    picked = [r for y, n in ((1, POSITIVE), (0, NEGATIVE)) for r in known.where((F.col("toxic") == 1) if y else (F.col("toxic") != 1)).orderBy(*order).limit(n).collect()]
    ids = docs.sparkSession.createDataFrame([(r.doc_id, int(r.toxic == 1)) for r in picked], "__id long, __toxic int")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy(F.xxhash64("text").alias("__hash"), "__toxic").agg(F.min("__id").alias("__id"), F.min("text").alias("text"))
    return cut(rows.select("__id", "text", "__toxic"), "sample"), counts.get(True, 0) / max(1, sum(counts.values()))


def _drawn(sample: DataFrame, models: list[dict]) -> pd.DataFrame:
    """__id, __toxic, place and window: DRAWN windows of each text, those of the largest logits by the model of the text's half."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Scorer(m) for m in shared.value]
        for frame in frames:
            rows, half = [], np.array([half_of(i) for i in frame["__id"]], np.int64)
            for h in (0, 1):
                for at in range(0, int((half == h).sum()), 100):
                    some = frame[half == h].iloc[at : at + 100]
                    texts = [t.split() for t in some["text"]]
                    for i, toxic, words, found in zip(some["__id"], some["__toxic"], texts, own[h].windows(texts)):
                        best = np.argsort(-found, kind="stable")[: DRAWN[toxic]] * STRIDE
                        rows += [(i, toxic, place, " ".join(words[k : k + WINDOW])) for place, k in enumerate(best)]
            yield pd.DataFrame(rows, columns=["__id", "__toxic", "place", "window"])

    # at most so many windows of WINDOW words each
    found = sample.mapInPandas(apply, "__id long, __toxic int, place int, window string").toPandas()
    return found.sort_values(["__id", "__toxic", "place", "window"], ignore_index=True)


def _logits(sample: DataFrame, models: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit of each text, by the model of its half, and the labels."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Scorer(m) for m in shared.value]
        for frame in frames:
            half = np.array([half_of(i) for i in frame["__id"]], np.int64)
            for h in (0, 1):
                some = frame[half == h]
                yield pd.DataFrame({"toxic": some["__toxic"], "logit": own[h].largest(some["text"].tolist())})

    found = sample.mapInPandas(apply, "toxic int, logit double").toPandas().sort_values(["toxic", "logit"])
    return found["logit"].to_numpy(), found["toxic"].to_numpy()


def fit(sample: DataFrame, share: float, seed: int = 5) -> dict:
    """The model: network, log-odds, vectors, and the logistic that turns a text's largest logit into a score.

    share is the part of all labels that are 1. With labels of one kind only, or none, every score is that part.
    """
    sizes = dict(sample.groupBy("__toxic").count().collect())
    if len(sizes) < 2:
        return {"p": None, "share": share}
    counts, part = counted(sample), sizes[1] / (sizes[0] + sizes[1])
    crossed = [odds(counts, [1 - h], part) for h in (0, 1)]
    trainer, clean = Trainer(seed), []
    for turn in range(ROUNDS):
        drawn = _drawn(sample, [trainer.model(t) for t in crossed] if turn else [{**trainer.model(t), "p": None} for t in crossed])
        clean.append(drawn[drawn["__toxic"] == 0])
        # only the most toxic window of a toxic text stands for it
        rows = pd.concat([drawn[(drawn["__toxic"] == 1) & (drawn["place"] == 0)], *clean], ignore_index=True)
        trainer.train(Vocabulary(rows["window"].tolist(), rows["__id"].tolist(), crossed), rows["__toxic"].to_numpy(), STEPS)
    best, labels = _logits(sample, [trainer.model(t) for t in crossed])
    # each class has its true part of the labels
    weight = np.where(labels > 0, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum()))
    a, b = logistic(best, labels, weight)
    return trainer.model(odds(counts, [0, 1], part)) | {"share": share, "a": a, "b": b}


class Scorer:
    """A model at work in a Python worker: keeps the projected inputs of words that it has met."""

    def __init__(self, model: dict) -> None:
        self.model, self.ids = model, {}
        if model["p"] is not None:
            self.weights = np.concatenate([model["p"]["Wf"], model["p"]["Wb"]], axis=1)
            self.table = np.zeros((KEPT + GROUP, self.weights.shape[1]), np.float32)

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row of network inputs for each word, as it stands in the text."""
        named, out, get = [plain(w) for w in words], np.ones((len(words), INPUTS), np.float32), self.model["table"].get
        out[:, :ODDS] = 0
        for i, word in enumerate(named):
            for kind, piece in pieces(word):
                if x := get(piece):
                    out[i, kind] = x
        grams, count = trigrams(named)
        out[:, ODDS : ODDS + CHARS] = np.add.reduceat(self.model["chars"][grams], np.cumsum(count) - count, axis=0) / count[:, None]
        out[:, -2] = np.fromiter(map(length_input, named), np.float32, len(named))
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row of the table that holds each word's projected inputs."""
        ids = self.ids
        if len(ids) > KEPT:
            ids.clear()
        if fresh := sorted(set(words).difference(ids)):
            size = len(ids)
            if size + len(fresh) > len(self.table):  # a batch of more words than GROUP
                self.table = np.concatenate([self.table, np.zeros((size + len(fresh) - len(self.table), self.table.shape[1]), np.float32)])
            self.table[size : size + len(fresh)] = self.inputs(fresh) @ self.weights
            ids.update(zip(fresh, range(size, size + len(fresh))))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def windows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The logits of all windows of each of these texts' words; before training, the largest log-odds of a word."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        words, first, begins = [w for t in texts for w in t], np.cumsum(n) - n, [np.array(starts(x)) for x in n.tolist()]
        if self.model["p"] is None:
            each = self.inputs(words)[:, :ODDS].max(1) if words else np.zeros(0)
            return [np.array([each[f + a : f + min(a + WINDOW, k)].max(initial=0) for a in b]) for f, k, b in zip(first, n, begins)]
        count = np.fromiter(map(len, begins), np.int64, len(begins))
        ends = np.repeat(first + n, count)
        out = self._window_logits(np.append(self._rows(words), 0), np.concatenate(begins) + np.repeat(first, count), ends)
        return np.split(out, np.cumsum(count)[:-1])

    def _window_logits(self, at: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        for i in range(0, len(begin), 1024):
            where = np.arange(WINDOW)[:, None] + begin[None, i : i + 1024]
            mask = where < ends[None, i : i + 1024]
            x = self.table[at[np.minimum(where, len(at) - 1)]]
            out[i : i + 1024] = logits(self.model["p"], np.ascontiguousarray(x.transpose(0, 2, 1)), mask)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model["p"] is None:
            return np.full(len(texts), self.model["share"])
        return _sigmoid(self.model["a"] * self.largest(texts) + self.model["b"])

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of the windows of each text."""
        best, words, spans = np.full(len(texts), -np.inf), [], []

        def flush() -> None:
            if not spans:
                return
            if not words:  # only texts without words: one window of nothing each
                for i, _, _ in spans:
                    best[i] = max(best[i], float(self.model["p"]["c"][0]))
            else:
                begin = np.concatenate([np.array(starts(n)) + a for _, a, n in spans])
                ends = np.concatenate([np.full(len(starts(n)), a + n) for _, a, n in spans])
                owner = np.repeat([i for i, _, _ in spans], [len(starts(n)) for _, _, n in spans])
                np.maximum.at(best, owner, self._window_logits(self._rows(words), begin, ends))
            words.clear()
            spans.clear()

        for i, text in enumerate(texts):
            own = (text or "").split()
            for a in range(0, max(1, len(own) - (WINDOW - STRIDE)), STRIDE * 4000):  # a very long text in parts that overlap as windows do
                part = own[a : a + STRIDE * 4000 + WINDOW - STRIDE]
                spans.append((i, len(words), len(part)))
                words.extend(part)
                if len(words) >= GROUP:
                    flush()
        flush()
        return best


def scorer(spark: SparkSession, model: dict) -> Column:
    """A function of a text column: the score, from 0 to 1. A null or empty text is scored as a window without words."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(shared.value)
        for batch in texts:
            made = [own.score(some) for at in range(0, len(batch), 500) if (some := batch.iloc[at : at + 500].tolist())]
            yield pd.Series(np.concatenate([np.zeros(0), *made]), dtype="float64")

    return apply


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(*training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score and predicted, 1 from a score of 0.5 on; a column of docs with one of these names is replaced.

    Defined results: null and empty texts are scored alike; equal texts score alike; a very long text is scored by
    all its windows; an empty table gives an empty result; without usable labels every score is the part of
    labels that are 1.
    """
    return docs.withColumn("score", scorer(docs.sparkSession, model)("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
