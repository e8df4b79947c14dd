"""Language identification by a bidirectional gated recurrent network over
bytes, trained in numpy by backpropagation through time.

Two gated recurrent layers read a window of bytes, one forwards and one
backwards; at every byte both states together give the probabilities of the
languages.  A document's probabilities are the geometric mean over all its bytes.

Long texts are read in windows of ``WINDOW`` bytes with ``CONTEXT`` bytes on
either side, many windows at a time; every byte of every text is read.  The
network is fitted on at most ``SAMPLE`` labelled documents per language, a
few passages of each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = 16
WINDOW, CONTEXT = 128, 16
#: Labelled documents per language that the network is fitted on, at most.
SAMPLE = 256
PASSAGES, PASSAGE_CHARS = 4, 96
STEPS, BATCH, RATE, SEED = 240, 128, 0.02, 5
UNKNOWN = "und"
#: Windows read at once.
AT_ONCE = 1024


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: as tanh for a state, and its half plus a half
    as a gate, at a fraction of the cost.  Its slope is (1 - |y|) squared."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class Network:
    """Weights of both layers (``e``: byte to gate inputs, ``u``: state to
    gate inputs, in the order reset, update, candidate) and of the output."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.labels, self.hidden = labels, hidden
        self.w = {
            "e0": (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(f),
            "u0": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "e1": (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(f),
            "u1": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "v": (rng.standard_normal((2 * hidden, len(labels))) * 0.1).astype(f),
            "c": np.zeros(len(labels), f),
        }

    def layer(self, x: np.ndarray, d: int, skip: int, trace: list | None = None) -> np.ndarray:
        """States (time, windows, hidden) after each byte of ``x`` (time,
        windows), without the first ``skip``; ``trace`` gets what the
        gradient needs."""
        e, u, k = self.w[f"e{d}"], self.w[f"u{d}"], self.hidden
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((x.shape[0] - skip, x.shape[1], k), np.float32)
        for t in range(x.shape[0]):
            a, b = e[x[t]], h @ u
            gates = 0.5 + 0.5 * _squash(a[:, : 2 * k] + b[:, : 2 * k])
            reset, update = gates[:, :k], gates[:, k:]
            cand = _squash(a[:, 2 * k :] + reset * b[:, 2 * k :])
            new = cand + update * (h - cand)
            if trace is not None:
                trace.append((h, reset, update, cand, b[:, 2 * k :]))
            h = new
            if t >= skip:
                out[t - skip] = h
        return out

    def back(self, x: np.ndarray, d: int, trace: list, grad_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of a layer's ``e`` and ``u`` through time."""
        u, k = self.w[f"u{d}"], self.hidden
        grad_u, grad_x = np.zeros_like(u), np.empty((*x.shape, 3 * k), np.float32)
        grad_h = np.zeros((x.shape[1], k), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            h, reset, update, cand, pre = trace[t]
            grad_h = grad_h + grad_out[t]
            g_cand = grad_h * (1 - update) * (1 - np.abs(cand)) ** 2
            g_update = grad_h * (h - cand) * _gate_slope(update)
            g_reset = g_cand * pre * _gate_slope(reset)
            grad_x[t] = np.concatenate((g_reset, g_update, g_cand), 1)
            g_state = np.concatenate((g_reset, g_update, g_cand * reset), 1)
            grad_u += h.T @ g_state
            grad_h = grad_h * update + g_state @ u.T
        flat, bytes_ = grad_x.reshape(-1, 3 * k), x.reshape(-1)
        grad_e = np.empty((256, 3 * k), np.float32)
        for j in range(3 * k):
            grad_e[:, j] = np.bincount(bytes_, flat[:, j], 256)
        return grad_e, grad_u

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        z = states @ self.w["v"] + self.w["c"]
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(-1, keepdims=True)
        return z

    def read(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (WINDOW, labels, windows) for bytes (time, windows)
        with CONTEXT on either side."""
        scores = np.empty((WINDOW, len(self.labels), x.shape[1]), np.float32)
        for d, part in ((0, x[: WINDOW + CONTEXT]), (1, x[CONTEXT:][::-1])):
            for t, out in self._scored(part, d):
                if d:
                    scores[WINDOW - 1 - t] += out
                else:
                    np.add(out, self.w["c"][:, None], out=scores[t])
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def _scored(self, x: np.ndarray, d: int):
        """A layer's share of the scores after each byte behind the context.
        States lie feature by window, so that every step works on whole rows."""
        k = self.hidden
        e = np.ascontiguousarray(self.w[f"e{d}"].T)
        u = np.ascontiguousarray(self.w[f"u{d}"].T)
        v = np.ascontiguousarray(self.w["v"][d * k : (d + 1) * k].T)
        h = np.zeros((k, x.shape[1]), np.float32)
        a = np.empty((3 * k, x.shape[1]), np.float32)
        b = np.empty_like(a)
        for t in range(x.shape[0]):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            gates, cand = a[: 2 * k], a[2 * k :]
            gates += b[: 2 * k]
            _squash(gates)
            gates *= 0.5
            gates += 0.5
            b[2 * k :] *= gates[:k]
            cand += b[2 * k :]
            _squash(cand)
            h -= cand
            h *= gates[k:]
            h += cand
            if t >= CONTEXT:
                yield t - CONTEXT, v @ h

    def step(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the real positions, and the gradients."""
        traces: list[list] = [[], []]
        ahead = self.layer(x, 0, 0, traces[0])
        behind = self.layer(x[::-1], 1, 0, traces[1])[::-1]
        states = np.concatenate((ahead, behind), 2)
        p = self.probabilities(states)
        n = max(1, int(real.sum()))
        at = np.arange(x.shape[1])
        loss = -float((np.log(p[:, at, y] + 1e-9) * real).sum()) / n
        p[:, at, y] -= 1
        p *= (real / n)[..., None].astype(np.float32)
        grad = {"v": states.reshape(-1, states.shape[2]).T @ p.reshape(-1, p.shape[2]), "c": p.sum((0, 1))}
        g = p @ self.w["v"].T
        k = self.hidden
        grad["e0"], grad["u0"] = self.back(x, 0, traces[0], g[..., :k])
        grad["e1"], grad["u1"] = self.back(x[::-1], 1, traces[1], g[::-1][..., k:])
        return loss, grad

    def fit(self, passages: list[bytes], y: list[int], steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam over random batches with equal shares of the labels."""
        rng = np.random.default_rng(seed)
        length = max(map(len, passages))
        x = np.zeros((len(passages), length), np.uint8)
        for i, p in enumerate(passages):
            x[i, : len(p)] = np.frombuffer(p, np.uint8)
        size, y = np.array([len(p) for p in passages]), np.array(y)
        of = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        mean = {k: np.zeros_like(w) for k, w in self.w.items()}
        square = {k: np.zeros_like(w) for k, w in self.w.items()}
        each = max(1, BATCH // len(self.labels))
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, each) for o in of])
            xs = x[pick].T
            real = np.arange(length)[:, None] < size[pick][None, :]
            _, grad = self.step(xs, real, y[pick])
            rate = RATE * min(1.0, t / 20) * (1 - 0.9 * t / steps)
            for k, g in grad.items():
                g = np.clip(g, -0.05, 0.05)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of each text (labels as columns): the normalised
        geometric mean of those at all its bytes."""
        total = np.zeros((len(texts), len(self.labels)))
        for rows, p, real in self._windows(texts):
            np.add.at(total, rows, (np.log(p + 1e-6) * real[:, None, :]).sum(0).T)
        total /= np.maximum(1, [len(t) for t in texts])[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def positions(self, text: bytes) -> np.ndarray:
        """The label number of every byte."""
        out = [p.argmax(1).T.reshape(-1) for _, p, _ in self._windows([text])]
        return np.concatenate(out)[: len(text)] if out else np.empty(0, int)

    def _windows(self, texts: list[bytes]):
        gap = bytes(CONTEXT + WINDOW)
        buffer = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
        size = np.array([len(t) for t in texts])
        first = CONTEXT + WINDOW + np.concatenate(([0], np.cumsum(size + len(gap))[:-1]))
        n = -(-size // WINDOW)
        rows = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        starts, left = first[rows] + nth * WINDOW, size[rows] - nth * WINDOW
        span, inside = np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None], np.arange(WINDOW)[:, None]
        for at in range(0, len(rows), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            x = buffer[starts[some][None, :] + span]
            yield rows[some], self.read(x), inside < left[some][None, :]


def prepared(text: str) -> bytes:
    """What the network reads: the whole text in lower case, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass")


def held_out(key: Column) -> Column:
    """Documents never learned from: a quarter, by the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network fitted on ``docs`` (doc_id, text, lang): labelled rows
    outside the held-out quarter, at most ``sample`` documents per label
    (those of the smallest id hashes), ``PASSAGES`` passages of each.  None
    where no row is labelled."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per label
    if not counts:
        return None
    # a share of each label that holds some twice the sample
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * sample + 50) / n))])
    texts = rows.select("lang", draw.alias("draw"), "text").where(F.col("draw") < shares[F.col("lang")])
    starts = [F.expr(f"cast(length(text) * {i} / {PASSAGES} as int) + 1") for i in range(PASSAGES)]
    texts = texts.select("lang", "draw", F.array(*[F.substring("text", s, F.lit(PASSAGE_CHARS)) for s in starts]).alias("p"))
    by_label: dict[str, list] = {}
    for r in texts.collect():  # bounded: a few passages of some 2 * sample documents per label
        by_label.setdefault(r["lang"], []).append((r["draw"], r["p"]))
    labels = sorted(by_label)
    passages, y = [], []
    for k, label in enumerate(labels):
        for _, some in sorted(by_label[label])[:sample]:
            for p in {p for p in some if p}:
                passages.append(prepared(p))
                y.append(k)
    order = sorted(range(len(y)), key=lambda i: (y[i], passages[i]))
    return Network(labels).fit([passages[i] for i in order], [y[i] for i in order])


def has_letter() -> Column:
    """The text is there and holds a letter."""
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _judged(texts: list[str | None], letters: list[bool], network: Network | None) -> tuple[list[str], list[float]]:
    """Label and score of each text; ``und`` and 0 without letters or network."""
    label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if network is not None:
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1 << 21):
                size += len(texts[hi] or "")
                hi += 1
            some = [i for i in range(lo, hi) if letters[i]]
            if some:
                p = network.pooled([prepared(texts[i]) for i in some])
                for i, k, s in zip(some, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    label[i], score[i] = network.labels[k], min(1.0, s)
            lo = hi
    return label, score


PREDICTION_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, held_out, lang_pred,
    score``.  Only the text is read by the network.  Null texts, texts
    without a letter, and all texts where there is no network give ``und``
    and score 0; repeated rows and null ids are rows like others; a null id
    is not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    found = labelled(rows, network, "lang_pred", "score")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def labelled(docs: DataFrame, network: Network | None, label: str, score: str) -> DataFrame:
    """``docs`` with two more columns, named by the caller."""
    place = docs.columns.index("text")
    fields = [*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]
    rows = docs.select("*", has_letter().alias(f"{label} has letter"))

    def run(batches):
        import pyarrow as pa

        names = [f.name for f in fields]
        for batch in batches:
            found = _judged(batch.column(place).to_pylist(), batch.column(len(names) - 2).to_pylist(), network)
            columns = [*batch.columns[: len(names) - 2], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, T.StructType(fields))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict all of them."""
    return predict(docs, learned(docs))
