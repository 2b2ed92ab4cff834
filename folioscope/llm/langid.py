"""Operator 4: language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU (``HIDDEN`` units each; the gates are hard sigmoids) read windows of ``WINDOW`` bytes; a
softmax over both labels every position. A document's probabilities are the mean over the positions of its letters, over
all its windows. The network is trained in numpy by backpropagation through time with Adam, on a bounded sample:
``SAMPLE`` labelled documents (the smallest by a hash of doc_id), from each language as many windows.

Defined results: null text and text without a letter are "und" with score 0, and so is every text where no language
could be learned; a null doc_id is labelled and not held out; repeated rows are each labelled; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, bounded, crc_mod

HIDDEN, WINDOW, BATCH = 8, 64, 4096
SAMPLE, WINDOWS, STEPS = 4000, 6, 350
#: Bytes of letters: ASCII letters and every byte of a multi-byte character.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Network:
    """Parameters: of each direction x (256 x 3H, the gates' input by byte), u (H x 3H); out (2H x L), bias (L)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        n = max(1, len(langs))
        self.p = {f"x{d}": rng.normal(0, 0.3, (256, 3 * hidden)) for d in "fb"} | {f"u{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)) for d in "fb"}
        self.p |= {"out": rng.normal(0, 0.3, (2 * hidden, n)), "bias": np.zeros(n)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # ---- one direction: h' = (1 - z) h + z tanh(xc + r (h Uc)), z and r = clip(0.2 (x + h U) + 0.5, 0, 1)

    def _run(self, bytes_: np.ndarray, d: str, keep: bool = False):
        h_size, x, u = self.hidden, self.p["x" + d], self.p["u" + d]
        rows, steps = bytes_.shape
        h = np.zeros((rows, h_size), np.float32)
        states = np.empty((steps, rows, h_size), np.float32)
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = x[bytes_[:, t]]
            g = h @ u
            pre = a[:, : 2 * h_size] + g[:, : 2 * h_size]
            pre *= np.float32(0.2)
            pre += np.float32(0.5)
            gates = np.minimum(np.maximum(pre, 0), 1)
            z, r = gates[:, :h_size], gates[:, h_size:]
            c = g[:, 2 * h_size :] * r
            c += a[:, 2 * h_size :]
            np.tanh(c, out=c)
            if keep:
                tape.append((t, h, pre, gates, g, c))
            h = h + z * (c - h)
            states[t] = h
        return states, tape

    def logits(self, bytes_: np.ndarray) -> np.ndarray:
        """steps x rows x L."""
        f, b = self._run(bytes_, "f")[0], self._run(bytes_, "b")[0]
        h = self.hidden
        return f @ self.p["out"][:h] + b @ self.p["out"][h:] + self.p["bias"]

    def gradients(self, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Loss and gradients. label: of each row; weight: of each row and step."""
        h_size, grads = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._run(bytes_, d, keep=True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        logits = states @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        w = (weight / max(1.0, weight.sum())).T.astype(np.float32)
        rows = np.arange(len(label))
        loss = float(-(w * np.log(prob[:, rows, label] + 1e-9)).sum())
        err = prob
        err[:, rows, label] -= 1
        err *= w[:, :, None]
        grads["out"] = np.einsum("trh,trl->hl", states, err)
        grads["bias"] = err.sum((0, 1))
        back = err @ self.p["out"].T
        for k, d in enumerate("fb"):
            u, dh_out = self.p["u" + d], back[:, :, k * h_size : (k + 1) * h_size]
            dh = np.zeros_like(dh_out[0])
            for t, h, pre, gates, g, c in reversed(runs[d][1]):
                dh = dh + dh_out[t]
                z, r = gates[:, :h_size], gates[:, h_size:]
                dz, dc = dh * (c - h), dh * z * (1 - c * c)
                dr = dc * g[:, 2 * h_size :]
                dgate = np.concatenate([dz, dr], 1) * (0.2 * ((pre > 0) & (pre < 1)))
                dg = np.concatenate([dgate, dc * r], 1)
                dx = np.concatenate([dgate, dc], 1)
                np.add.at(grads["x" + d], bytes_[:, t], dx)
                grads["u" + d] += h.T @ dg
                dh = dh * (1 - z) + dg @ u.T
        return loss, grads

    def train(self, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 3) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            at = rng.integers(0, len(label), batch)
            loss, grads = self.gradients(bytes_[at], label[at], weight[at])
            losses.append(loss)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            for k, g in grads.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses

    # ---- documents

    def pooled(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each whole text's language and the pooled probability of it."""
        data = [(t or "").encode("utf-8", "surrogatepass") if t and any(map(str.isalpha, t)) else b"" for t in texts]
        count = [-(-len(b) // WINDOW) for b in data]
        total = sum(count)
        if not total or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        windows = np.zeros((total, WINDOW), np.uint8)
        at = 0
        for b, n in zip(data, count, strict=True):
            windows[at : at + n].reshape(-1)[: len(b)] = np.frombuffer(b, np.uint8)
            at += n
        sums, seen = np.zeros((total, len(self.langs))), np.zeros(total)
        for a in range(0, total, BATCH):
            part = windows[a : a + BATCH]
            logits = self.logits(part)
            logits -= logits.max(2, keepdims=True)
            np.exp(logits, out=logits)
            letters = _LETTER[part].T
            logits *= (letters / logits.sum(2))[:, :, None]
            sums[a : a + BATCH] = logits.sum(0)
            seen[a : a + BATCH] = letters.sum(0)
        owner = np.repeat(np.arange(len(texts)), count)
        mass = np.stack([np.bincount(owner, sums[:, k], len(texts)) for k in range(len(self.langs))], 1)
        n = np.bincount(owner, seen, len(texts))
        share = mass / np.maximum(n, 1)[:, None]
        best = share.argmax(1)
        score = np.where(n > 0, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.langs[k] if x else "und" for k, x in zip(best.tolist(), n.tolist(), strict=True)], score


# --------------------------------------------------------------------------- Spark


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread over each text, WINDOWS at most: training is on a bounded sample."""
    for batch in batches:
        langs, out = [], []
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            n = -(-len(data) // WINDOW)
            for k in sorted({int(j * n / WINDOWS) for j in range(WINDOWS)}):
                piece = data[k * WINDOW : (k + 1) * WINDOW]
                if piece:
                    langs.append(lang)
                    out.append(piece.ljust(WINDOW, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])


#: At least so many rows of each language are learned from, if it has them.
SURE = 8


def fit(docs: DataFrame, sample: int = SAMPLE, learn=None, steps: int = STEPS) -> Network:
    """docs (doc_id, text, lang). learn: a condition; rows without it are not learned from."""
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.col("lang") != "und") & (F.length("text") > 0))
    rows = rows if learn is None else rows.filter(learn)
    # each language gets the same share of the sample, so that a rare one is learned too: as large a part of its rows, by a
    # hash of doc_id and text, as gives that share, and its rows of the least hashes in any case; copies count once
    rows = rows.withColumn("at", F.xxhash64("doc_id", "text"))
    least = [F.min(F.xxhash64(F.lit(k), "at")).alias(f"least{k}") for k in range(SURE)]
    held = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *least).collect()}  # a row for each language
    share = max(1, sample // max(1, len(held)))
    if not held:
        return Network([])
    part = F.create_map(*[F.lit(x) for lang, r in sorted(held.items()) for x in (lang, -(-(1 << 31) * share // r["n"]))])[F.col("lang")]
    sure = [F.create_map(*[F.lit(x) for lang, r in sorted(held.items()) for x in (lang, r[f"least{k}"])])[F.col("lang")] == F.xxhash64(F.lit(k), "at") for k in range(SURE)]
    first = F.greatest(*(x.cast("int") for x in sure))
    likely = rows.withColumn("first", first).filter((F.col("first") == 1) | (F.pmod("at", F.lit(1 << 31)) < part)).select("lang", "at", "first").distinct()
    chosen = likely.orderBy(F.desc("first"), "at", "lang").limit(2 * sample + SURE * len(held)).drop("first")
    texts = rows.join(F.broadcast(chosen), ["lang", "at"], "left_semi").select("lang", "at", "text").dropDuplicates(["lang", "at"])
    data = texts.select("lang", "text").mapInArrow(_training_windows, "lang string, piece binary").collect()
    data.sort(key=lambda r: (r.lang, r.piece))
    langs = sorted({r.lang for r in data})
    net = Network(langs)
    if len(langs) > 1:
        bytes_ = np.stack([np.frombuffer(r.piece, np.uint8) for r in data])
        label = np.array([langs.index(r.lang) for r in data])
        share = np.bincount(label)
        chosen = np.random.default_rng(5).choice(len(label), len(label), p=1 / share[label] / len(langs))
        net.train(bytes_[chosen], label[chosen], _LETTER[bytes_[chosen]].astype(np.float32), steps=steps)
    return net


def _labelled(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        langs, score = net.pooled(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text)."""
    held = bounded(docs).sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _labelled(it, held.value), "doc_id long, lang_pred string, score double")


def _kept(batches: Iterator[pa.RecordBatch], net: Network, least: float) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        langs, score = net.pooled(batch["text"].to_pylist())
        yield batch.filter(pa.array([lang != "und" and x >= least for lang, x in zip(langs, score.tolist(), strict=True)], pa.bool_()))


def keep(docs: DataFrame, net: Network, least: float) -> DataFrame:
    """The rows of docs whose language is known with a pooled probability of at least so much."""
    held = bounded(docs).sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(lambda it: _kept(it, held.value, least), docs.schema)


def learn_fold():
    return crc_mod("doc_id", 4) != 2
