"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of ``WINDOW`` bytes, all of them, to the last byte. Two gated recurrent units (their squashing
function is x / (1 + |x|)) read each window from both ends; at every position their states give language probabilities, and a document's probabilities are the mean over all
of its positions. Weights are trained on the driver by backpropagation through time and the Adam rule, on a bounded sample:
at most ``TRAIN_DOCS`` documents of each language, ``TRAIN_WINDOWS`` windows of each, drawn on the executors from the whole of its text. They are some ten kilobytes,
which go with the task to the executors. Inference handles thousands of windows side by side.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Only rows with a non-null language and text
are learned from; if there are none, every text is ``und``. Rows with a null id are predicted as well, as held out, and are never
learned from. Rows that repeat are predicted alike. Ties of probability go to the language first in alphabetical order.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import text_blocks
from ._store import arrow_map, bucket_of, load

WINDOW, HIDDEN = 64, 8
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_STEPS, TRAIN_BATCH = 400, 24, 400, 192
SIDE_BY_SIDE = 2048
F32 = np.float32
LETTER = regex.compile(r"\p{L}")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: as the hyperbolic tangent between -1 and 1, at a fifth of its cost."""
    size = np.abs(x)
    size += F32(1)
    x /= size
    return x


def gate_of(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1."""
    squash(x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


@dataclass
class Network:
    """For each direction: an input table of 257 bytes (256 is padding) by three gates, and recurrent weights; then the output layer."""

    languages: list[str]
    inputs: np.ndarray  # (2, 257, 3H): update, reset, candidate
    recurrent: np.ndarray  # (2, H, 3H)
    output: np.ndarray  # (2H, C)
    bias: np.ndarray  # (C,)

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(F32)
        return cls(languages, draw(2, 257, 3 * hidden, s=0.3), draw(2, hidden, 3 * hidden, s=0.35), draw(2 * hidden, len(languages), s=0.3), np.zeros(len(languages), F32))

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias]

    def states(self, steps: np.ndarray, keep: bool = False):
        """Hidden states (2, T, N, H) for bytes (T, N); with ``keep`` also what the backward pass needs."""
        t, n = steps.shape
        h = self.recurrent.shape[1]
        out = np.empty((2, t, n, h), F32)
        kept = []
        for d in range(2):
            state = np.zeros((n, h), F32)
            gates, candidate = self.recurrent[d][:, : 2 * h], self.recurrent[d][:, 2 * h :]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                x = self.inputs[d].take(steps[i], axis=0)
                zr = gate_of(x[:, : 2 * h] + state @ gates)
                z, r = zr[:, :h], zr[:, h:]
                held = r * state
                c = squash(x[:, 2 * h :] + held @ candidate)
                if keep:
                    kept.append((d, i, state, z, r, held, c))
                state = state + z * (c - state)
                out[d, i] = state
        return (out, kept) if keep else out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, N, C) for the states of both directions."""
        _, t, n, h = states.shape
        logits = states[0].reshape(-1, h) @ self.output[:h]
        logits += states[1].reshape(-1, h) @ self.output[h:]
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(t, n, -1)

    def gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over all positions that hold a byte, by backpropagation through time."""
        t, n = steps.shape
        h = self.recurrent.shape[1]
        states, kept = self.states(steps, keep=True)
        p = self.probabilities(states)
        real = (steps < 256).astype(F32)
        total = max(1.0, float(real.sum()))
        at_label = p[:, np.arange(n), labels]
        loss = float(-(np.log(at_label + 1e-9) * real).sum() / total)
        d_logits = p
        d_logits[:, np.arange(n), labels] -= 1
        d_logits *= (real / F32(total))[:, :, None]
        grads = [np.zeros_like(x) for x in self.parameters()]
        flat = d_logits.reshape(-1, d_logits.shape[2])
        for d in range(2):
            grads[2][d * h : (d + 1) * h] = states[d].reshape(-1, h).T @ flat
        grads[3][:] = flat.sum(axis=0)
        carried = np.zeros((n, h), F32)
        direction = 1
        for d, i, before, z, r, held, c in reversed(kept):
            if d != direction:
                direction, carried = d, np.zeros((n, h), F32)
            d_state = carried + d_logits[i] @ self.output[d * h : (d + 1) * h].T
            d_c = d_state * z * (1 - np.abs(c)) ** 2
            d_z = d_state * (c - before) * F32(0.5) * (1 - np.abs(2 * z - 1)) ** 2
            d_held = d_c @ self.recurrent[d][:, 2 * h :].T
            d_r = d_held * before * F32(0.5) * (1 - np.abs(2 * r - 1)) ** 2
            d_gates = np.concatenate([d_z, d_r], axis=1)
            carried = d_state * (1 - z) + d_held * r + d_gates @ self.recurrent[d][:, : 2 * h].T
            grads[1][d][:, 2 * h :] += held.T @ d_c
            grads[1][d][:, : 2 * h] += before.T @ d_gates
            np.add.at(grads[0][d], steps[i], np.concatenate([d_gates, d_c], axis=1))
        return grads, loss

    def fast_probabilities(self, steps: np.ndarray) -> np.ndarray:
        """As ``probabilities(states(steps))``, with every array contiguous and reused, and the halves of the
        gates left to the end."""
        t, n = steps.shape
        h = self.recurrent.shape[1]
        half = F32(0.5)
        z, r, c, more = (np.empty((n, h), F32) for _ in range(4))
        logits = np.empty((t, n, len(self.languages)), F32)
        logits[:] = self.bias
        for d in range(2):
            (in_z, in_r, in_c), (re_z, re_r, re_c) = ([np.ascontiguousarray(w[:, i * h : (i + 1) * h]) for i in range(3)] for w in (self.inputs[d], self.recurrent[d]))
            re_c = re_c * half
            out = self.output[d * h : (d + 1) * h]
            state = np.zeros((n, h), F32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                at = steps[i]
                for gate, table, weights in ((z, in_z, re_z), (r, in_r, re_r)):
                    np.take(table, at, axis=0, out=gate, mode="clip")
                    np.matmul(state, weights, out=more)
                    gate += more
                    np.abs(gate, out=more)
                    more += F32(1)
                    gate /= more
                    gate += F32(1)
                r *= state
                np.take(in_c, at, axis=0, out=c, mode="clip")
                np.matmul(r, re_c, out=more)
                c += more
                np.abs(c, out=more)
                more += F32(1)
                c /= more
                c -= state
                c *= z
                c *= half
                state += c
                logits[i] += state @ out
        flat = logits.reshape(-1, logits.shape[2])
        top = flat[:, 0].copy()
        for j in range(1, flat.shape[1]):
            np.maximum(top, flat[:, j], out=top)
        flat -= top[:, None]
        np.exp(flat, out=flat)
        flat /= (flat @ np.ones(flat.shape[1], F32))[:, None]
        return logits

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, C): the mean over all positions of each text; zeros for empty texts."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not self.languages:
            return out
        rows, starts, windows = cut(data, offsets)
        for a in range(0, len(starts), SIDE_BY_SIDE):
            part = windows(a, a + SIDE_BY_SIDE)
            p = self.fast_probabilities(part)
            sums = np.einsum("tnc,tn->nc", p, (part < 256).astype(F32))
            np.add.at(out, rows[a : a + SIDE_BY_SIDE], sums)
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def cut(data: np.ndarray, offsets: np.ndarray):
    """Text number and start of each window, and a function that gives windows a to b as (T, N) with 256 past a text's end."""
    counts = -(-np.diff(offsets) // WINDOW)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][rows] + within * WINDOW
    ends = offsets[1:][rows]

    def windows(a: int, b: int) -> np.ndarray:
        at = np.arange(WINDOW)[:, None] + starts[None, a:b]
        found = data[np.minimum(at, len(data) - 1)].astype(np.int16)
        found[at >= ends[None, a:b]] = 256
        return found

    return rows, starts, windows


def train(windows: np.ndarray, labels: list[str], steps: int = TRAIN_STEPS, batch: int = TRAIN_BATCH, rate: float = 0.02, seed: int = 11) -> Network:
    """``windows``: (T, N) bytes, 256 past a text's end; ``labels``: the language of each."""
    languages = sorted(set(labels))
    network = Network.start(languages)
    rng = np.random.default_rng(seed)
    if not languages:
        return network
    marks = np.array([languages.index(x) for x in labels])
    # Batches draw each language equally often, so that a rare one is learned too.
    by_language = [np.flatnonzero(marks == i) for i in range(len(languages))]
    by_language = [x for x in by_language if len(x)]
    first, second = [np.zeros_like(x) for x in network.parameters()], [np.zeros_like(x) for x in network.parameters()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(by_language))) for x in by_language])
        grads, _ = network.gradients(windows[:, pick], marks[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(network.parameters(), grads, first, second):
            g = g * F32(min(1.0, 1.0 / (norm + 1e-9)))
            m += F32(0.1) * (g - m)
            v += F32(0.01) * (g * g - v)
            p -= F32(now) * (m / F32(1 - 0.9**step)) / (np.sqrt(v / F32(1 - 0.99**step)) + F32(1e-6))
    return network


def _draw_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc_id, lang, text``: at most TRAIN_WINDOWS windows of every whole text, drawn by a generator that its bytes seed."""
    for batch in batches:
        drawn = []
        for _, _, data, offsets in text_blocks(batch.column(2), 1):
            if not len(data):
                drawn.append([])
                continue
            rows, starts, _ = cut(data, offsets)
            chosen = np.sort(np.random.default_rng(zlib.crc32(data.tobytes())).permutation(len(starts))[:TRAIN_WINDOWS])
            drawn.append([data[s : s + WINDOW].tobytes() for s in starts[chosen].tolist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[np.ndarray, list[str]]:
    """Windows and languages of the ``per_language`` rows of each language with the least hash of the id, outside the held-out fold. Only windows, at most 1.5 kB
    for each row, come to the driver; rows that repeat an id and language give those of one of their texts."""
    eligible = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (bucket_of("doc_id", 4) != 2))
    ids = eligible.select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("doc_id", "lang")
    rows = docs.select(F.col("doc_id"), "lang", F.col("text").cast("string")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    drawn = arrow_map(rows.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), _draw_task, "doc_id long, lang string, windows array<binary>")
    found = sorted(drawn.groupBy("doc_id", "lang").agg(F.min("windows").alias("windows")).collect(), key=lambda r: (r.doc_id, r.lang))
    parts = [(bytes(w), r.lang) for r in found for w in r.windows]
    windows = np.full((WINDOW, len(parts)), 256, np.int16)
    for i, (w, _) in enumerate(parts):
        windows[: len(w), i] = np.frombuffer(w, np.uint8)
    return windows, [lang for _, lang in parts]


def _predict(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                p = network.document_probabilities(data, offsets)
                best = p.argmax(axis=1) if len(network.languages) else np.zeros(len(p), int)
                # Almost every text has an ASCII letter; only the others are looked at as characters.
                ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                running = np.zeros(len(data) + 1, np.int64)
                np.cumsum(ascii_letter, out=running[1:])
                known = running[offsets[1:]] > running[offsets[:-1]]
                for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                    known[i] = LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")) is not None
                known &= bool(network.languages)
                names = [network.languages[i] if k else "und" for i, k in zip(best, known)]
                scores = np.where(known, p.max(axis=1), 0.0) if len(network.languages) else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, network: Network) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(True)).alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, _predict(network), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(*sample(docs)))
