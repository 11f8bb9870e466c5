"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of a word vector and the mean of the vectors of its
character trigrams.  A forward and a backward gated recurrent network read a
window of words, attention pools their states and a logistic output scores the
window.  A document is scored on all its overlapping windows, which begin every
STEP words, and takes the largest, calibrated to a probability.  Everything is
numpy; training holds the label to the best window of each document, chosen anew
every round.

Labels are learnt from a bounded sample of the rows that are not held out:
TOXIC and CLEAN documents, by hash of the id, and of each kind as many in that
order as hold SAMPLE_BYTES.  Words come from the lower-cased text alone.  Null
or empty text: the score of a window without words.  No labels, or labels of one
kind: every score is that kind's share (0 without labels).  Long texts are
scored in all their windows.  Empty tables give empty results.  Repeated rows
give repeated rows; repeated labels count once, as toxic if any is, and so do
repeated documents (of several texts under an id, the least is learnt from); a
null doc_id is not held out.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blobs import spans
from ._common import Scratch, frugal, small_batches

#: Sample bounds, window length and step, state sizes, training rounds.
TOXIC, CLEAN, SAMPLE_BYTES = 1000, 2000, 8_000_000
WINDOW, STEP = 48, 24
HIDDEN, ATTEND, WIDTH = 8, 8, 12
ROUNDS, PASSES, BATCH, RATE = 3, 2, 128, 0.01
VOCABULARY, TRIGRAMS = 20_000, 8_192
#: Scores from here on predict 1.
THRESHOLD = 0.3
SEED = 11


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: crc32 of three bytes is the exclusive or of one entry for each and that of three zeros.
_ZERO = zlib.crc32(bytes(3))
_CRC = np.array([[zlib.crc32(bytes([c if k == j else 0 for k in range(3)])) ^ _ZERO for c in range(256)] for j in range(3)], dtype=np.uint32)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all <word>, one word after the other, and their number for each word (its length)."""
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8)
    at = spans(np.cumsum(n + 2) - n - 2, n)
    return ((_CRC[0][data[at]] ^ _CRC[1][data[at + 1]] ^ _CRC[2][data[at + 2]] ^ np.uint32(_ZERO)) % TRIGRAMS).astype(np.int64), n


class Network:
    def __init__(self, vocabulary: dict[bytes, int]):
        rng = np.random.default_rng(SEED)
        h, w, a = HIDDEN, WIDTH, ATTEND
        self.vocabulary = vocabulary  # word -> row; row 0: any other word
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": normal(len(vocabulary) + 1, w, scale=0.02), "chars": normal(TRIGRAMS, w, scale=0.02)}
        for d in "fb":
            self.p |= {f"{d}W": normal(w, 3 * h, scale=w**-0.5), f"{d}U": normal(h, 3 * h, scale=h**-0.5), f"{d}c": np.zeros(3 * h, np.float32)}
        self.p |= {"A": normal(2 * h, a, scale=(2 * h) ** -0.5), "v": normal(a, scale=a**-0.5), "o": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        self.slope, self.shift, self.share = 1.0, 0.0, 0.0

    # -- input: words to rows of the projection that both directions read -------------------------------------------
    def embed(self, words: list[bytes]):
        flat, n = trigrams(words)
        get = self.vocabulary.get
        rows = np.fromiter([get(w, 0) for w in words], dtype=np.int64, count=len(words))
        chars = np.zeros((len(words), WIDTH), np.float32)
        if len(words):
            chars = np.add.reduceat(self.p["chars"][flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
        return self.p["words"][rows] + chars, (rows, flat, n)

    def project(self, x):
        return x @ self.p["fW"] + self.p["fc"], x @ self.p["bW"] + self.p["bc"]

    # -- windows: index of each word in the projection, -1 behind the end -------------------------------------------
    def _pass(self, d: str, table, index, keep: list | None):
        h, u = HIDDEN, self.p[f"{d}U"]
        state = np.zeros((len(index), h), np.float32)
        out = np.empty((index.shape[1], len(index), h), np.float32)
        for t in range(index.shape[1]) if d == "f" else range(index.shape[1] - 1, -1, -1):
            x = table[index[:, t]]  # -1 reads the last row, whose state is not kept
            there = (index[:, t] >= 0)[:, None]
            hu = state @ u
            g = x[:, : 2 * h] + hu[:, : 2 * h]
            np.negative(g, out=g)
            np.exp(np.minimum(g, 30, out=g), out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :h], g[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            after = np.where(there, new + z * (state - new), state)
            if keep is not None:
                keep.append((t, state, z, r, new, hu[:, 2 * h :], there))
            out[t] = state = after
        return out

    def forward(self, tables, index, keep: dict | None = None):
        """Logit of each window."""
        kf, kb = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._pass("f", tables[0], index, kf), self._pass("b", tables[1], index, kb)], axis=2)
        u = np.tanh(s @ self.p["A"])
        e = np.where(index.T >= 0, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        e = e * (index.T >= 0)
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        c = (a[:, :, None] * s).sum(axis=0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s, "u": u, "a": a, "c": c}
        return c @ self.p["o"] + self.p["bias"][0]

    def gradients(self, tables, index, target):
        k: dict = {}
        logit = self.forward(tables, index, k)
        d_logit = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g = {"o": k["c"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        dc = d_logit[:, None] * self.p["o"]
        ds = k["a"][:, :, None] * dc
        da = (k["s"] * dc).sum(axis=2)
        de = k["a"] * (da - (k["a"] * da).sum(axis=0))
        g["v"] = (de[:, :, None] * k["u"]).sum(axis=(0, 1))
        du = de[:, :, None] * self.p["v"] * (1 - k["u"] ** 2)
        g["A"] = np.tensordot(k["s"], du, axes=([0, 1], [0, 1]))
        ds = ds + du @ self.p["A"].T
        d_tables, h = [], HIDDEN
        for d, part, table in (("f", ds[:, :, :h], tables[0]), ("b", ds[:, :, h:], tables[1])):
            u, gu, d_table, back = self.p[f"{d}U"], np.zeros_like(self.p[f"{d}U"]), np.zeros_like(table), np.zeros((len(index), h), np.float32)
            for t, state, z, r, new, hn, there in reversed(k[d]):
                full = part[t] + back
                dh = np.where(there, full, 0)
                dz, dn = dh * (state - new) * z * (1 - z), dh * (1 - z) * (1 - new**2)
                dr = dn * hn * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                gu += state.T @ dhu
                back = dh * z + dhu @ u.T + np.where(there, 0, full)
                np.add.at(d_table, index[:, t], np.where(there, dx, 0))
            g[f"{d}U"] = gu
            d_tables.append(d_table)
        return logit, g, d_tables

    def probability(self, logit):
        return _sigmoid(self.slope * logit + self.shift)


def indexed(lengths: list[int]):
    """Word index of each window of documents laid end to end, and the first window of each document."""
    size = np.array(lengths, dtype=np.int64)
    many = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
    first = np.cumsum(many) - many
    begin = np.cumsum(size) - size
    lo = np.repeat(begin, many) + spans(np.zeros(len(many), dtype=np.int64), many) * STEP
    index = lo[:, None] + np.arange(WINDOW)
    return np.where(index < np.repeat(begin + size, many)[:, None], index, -1), first


def train(texts: list[str], toxic: list[int], share: float) -> Network:
    """share: of toxic rows among all labelled ones, for calibration."""
    docs = [t.encode().lower().split() for t in texts]
    y = np.array(toxic, dtype=np.float32)
    seen: dict[bytes, np.ndarray] = {}
    grams = np.zeros((2, TRIGRAMS))
    for words, label in zip(docs, toxic, strict=True):
        own = set(words)
        for w in own:
            seen.setdefault(w, np.zeros(2))[label] += 1
        grams[label, np.unique(trigrams(list(own))[0])] += 1
    common = sorted((w for w, n in seen.items() if n.sum() >= 3), key=lambda w: (-seen[w].sum(), w))[:VOCABULARY]
    net = Network({w: i + 1 for i, w in enumerate(common)})
    # The first coordinate starts as the log ratio of how often toxic and clean documents hold the word or trigram.
    of = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    ratio = lambda n: np.clip(np.log((n[1] + 0.5) / of[1]) - np.log((n[0] + 0.5) / of[0]), -3, 3)
    for w, i in net.vocabulary.items():
        net.p["words"][i, 0] = ratio(seen[w]) / 2
    net.p["chars"][:, 0] = np.where(grams.sum(0) >= 3, ratio(grams), 0) / 2

    rng = np.random.default_rng(SEED)
    unique = sorted({w for d in docs for w in d})
    place = {w: i for i, w in enumerate(unique)}
    flat = np.array([place[w] for d in docs for w in d], dtype=np.int64)
    index, first = indexed([len(d) for d in docs])
    index = np.where(index >= 0, flat[np.maximum(index, 0)] if len(flat) else -1, -1)
    doc_of = np.repeat(np.arange(len(docs)), np.diff([*first, len(index)]))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0

    def logits():
        tables = net.project(net.embed(unique)[0])
        return np.concatenate([net.forward(tables, index[i : i + 4096]) for i in range(0, len(index), 4096)])

    for _ in range(ROUNDS):
        score = logits()
        best = np.array([lo + np.argmax(score[lo:hi]) for lo, hi in zip(first, [*first[1:], len(index)], strict=True)])
        spare = rng.permutation(np.flatnonzero(y[doc_of] == 0))[: len(docs)]  # any window of a clean document is clean
        pick = np.concatenate([best, spare])
        for _ in range(PASSES):
            order = rng.permutation(pick)
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                words, local = np.unique(index[part], return_inverse=True)
                local = local.reshape(len(part), WINDOW) - int(len(words) > 0 and words[0] < 0)
                x, (rows, grams_at, n) = net.embed([unique[i] for i in words if i >= 0])
                if not len(x):
                    continue
                _, g, d_tables = net.gradients(net.project(x), local, y[doc_of[part]])
                dx = np.zeros_like(x)
                for d, table in zip("fb", d_tables, strict=True):
                    g[f"{d}W"], g[f"{d}c"] = x.T @ table, table.sum(axis=0)
                    dx += table @ net.p[f"{d}W"].T
                for name, at, part_dx in (("words", rows, dx), ("chars", grams_at, np.repeat(dx / n[:, None], n, axis=0))):
                    g[name] = np.zeros_like(net.p[name])
                    np.add.at(g[name], at, part_dx)
                g["words"][0] = 0
                step += 1
                for name, grad in g.items():
                    m[name] += 0.1 * (grad - m[name])
                    v2[name] += 0.001 * (grad * grad - v2[name])
                    net.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)

    # Calibrate the largest logit of a document, with the kinds weighted to their share of all labels.
    score = logits()
    top = np.maximum.reduceat(score, first)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * top + shift)
        d, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(d * top).sum() + 1e-3 * (slope - 1), d.sum()])
        hess = np.array([[(h * top * top).sum() + 1e-3, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
    net.slope, net.shift, net.share = float(slope), float(shift), share
    return net


class Scorer:
    """Scores batches of texts; projections of words are kept, a bounded number of them."""

    LIMIT = 300_000

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self):
        self.place: dict[bytes, int] = {}
        self.tables = [np.zeros((1, 3 * HIDDEN), np.float32)] * 2

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [t.encode().lower().split() for t in texts]
        if len(self.place) > self.LIMIT:
            self._reset()
        new = sorted(set().union(*docs) - self.place.keys())
        if new:
            size = len(self.place)
            self.place |= {w: size + i for i, w in enumerate(new)}
            added = self.net.project(self.net.embed(new)[0])
            self.tables = [np.concatenate([t[:size], a]).astype(np.float32) for t, a in zip(self.tables, added, strict=True)]
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(docs)), dtype=np.int64, count=sum(map(len, docs)))
        index, first = indexed([len(d) for d in docs])
        logits = []
        for i in range(0, len(index), 4096):
            part = index[i : i + 4096]
            logits.append(self.net.forward(self.tables, np.where(part >= 0, flat[np.maximum(part, 0)], -1) if len(flat) else part))
        return self.net.probability(np.maximum.reduceat(np.concatenate(logits), first))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network, or the share of toxic labels where there are not two kinds."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return share
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN))
    # TOXIC + CLEAN rows at most, so it is safe to broadcast; the driver trains on those documents.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    found = Scratch(docs.sparkSession).put(found)
    so_far = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fit_in = found.select("doc_id", "toxic", F.octet_length("text").cast("long").alias("n")).withColumn("bytes", F.sum("n").over(so_far)).where(F.col("bytes") <= SAMPLE_BYTES)
    sample = sorted((r.doc_id, r.text, int(r.toxic)) for r in found.join(F.broadcast(fit_in.select("doc_id")), "doc_id").select("doc_id", "text", "toxic").collect())
    if len({t for _, _, t in sample}) < 2:
        return share
    return train([t for _, t, _ in sample], [y for _, _, y in sample], share)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels)

    def run(batches):
        scorer = Scorer(net) if isinstance(net, Network) else None
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores: list[float] = []
            at = 0
            while at < len(texts):  # some megabytes of text at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 2_000_000):
                    size += len(texts[end])
                    end += 1
                scores += np.round(scorer.score(texts[at:end]).astype(np.float64), 6).tolist() if scorer else [net] * (end - at)
                at = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
