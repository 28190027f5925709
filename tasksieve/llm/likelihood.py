"""Masked pseudo-likelihood: a bidirectional window network that predicts every byte from both sides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import raw_bytes
from tasksieve.session import checkpointed

#: A token is a byte plus 1, or 0 beyond the text; a window has two on each side: 45 bits with the token in the middle.
TOKENS = 257
#: Tokens of ``kind_table``, with windows of 25 bits.
KINDS = 32
REACH = 2
WIDTH, HIDDEN = 12, 64
#: Slices and steps are the least number; both grow with the windows. A slice has about SLICE_ROWS distinct windows.
SLICES, ROUNDS, STEPS, BATCH = 8, 3, 150, 1024
SLICE_ROWS = 1 << 17
#: Averages are sums of whole numbers, so that their order has no say: a weight of 1 as such a number.
ONE = 1 << 40
#: Windows whose log-probability a process remembers.
KNOWN = 1 << 21
#: Bytes of text worked on at once; each takes some 50 bytes of working space.
GROUP_BYTES = 1 << 20


def byte_table() -> np.ndarray:
    """Token of every byte; 0 is kept for what is beyond the text."""
    return np.arange(1, TOKENS, dtype=np.int32)


def kind_table() -> np.ndarray:
    """Coarse tokens, which the query does not use: kind of every byte, 0 beyond the text, a-z without case 1-26, digit 27, blank 28, other ASCII 29, UTF-8 lead 30, continuation 31."""
    table = np.full(256, 29, np.int32)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[48:58] = 27
    table[[32, 9, 10, 11, 12, 13]] = 28
    table[0xC0:] = 30
    table[0x80:0xC0] = 31
    return table


def windows(texts: list[bytes], table: np.ndarray, beside: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The window of every byte of all texts (five tokens of equal width, the middle one lowest), and the bytes of each text.

    ``beside`` says how many bytes at the beginning and end of each text are only there to be seen by
    their neighbours, as the text is a piece of a longer one; they have no windows of their own.
    """
    bits = int(table.max()).bit_length()
    sizes = np.array([len(t) for t in texts], np.int64)
    edge = np.zeros(REACH, np.int32)
    tokens = np.concatenate([edge, *[x for t in texts for x in (table[np.frombuffer(t, np.uint8)], edge)]])
    n = len(tokens) - 2 * REACH
    code = tokens[REACH:REACH + n].astype(np.int64)
    for k, at in enumerate((0, 1, 3, 4)):
        code |= tokens[at:at + n].astype(np.int64) << (bits * (k + 1))
    inside = np.ones(n, bool)
    ends = np.cumsum(sizes + REACH)
    for k in range(1, REACH + 1):
        gap = ends - k
        inside[gap[gap < n]] = False
    if beside is not None:
        for at, size, (before, after) in zip(ends - REACH - sizes, sizes, beside):
            inside[at:at + before] = False
            inside[at + size - after:at + size] = False
        sizes = sizes - np.array([x + y for x, y in beside], np.int64)
    return code[inside], sizes


def pieces(texts, size: int = GROUP_BYTES):
    """Lists of about ``size`` bytes: (number of the text, bytes, bytes of its neighbours on either side).

    A longer text is cut in overlapping pieces, so what is worked on at once is bounded whatever the
    texts.  Every text is in at least one list.  ``texts`` is an Arrow column; its bytes are not copied.
    """
    group, held = [], 0
    for number, text in enumerate(texts):
        raw = memoryview(text.as_buffer())
        for start in range(0, max(1, len(raw)), size):
            end = min(len(raw), start + size)
            before, after = min(start, REACH), min(len(raw) - end, REACH)
            group.append((number, raw[start - before:end + after], (before, after)))
            held += end - start
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


@dataclass
class WindowNetwork:
    """Embeddings of the four neighbours, one tanh layer, a softmax over the tokens."""

    weights: list[np.ndarray]
    known: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @property
    def bits(self) -> int:
        return (len(self.weights[-1]) - 1).bit_length()

    @staticmethod
    def fresh(seed: int, tokens: int = KINDS) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        shapes = [(2 * REACH, tokens, WIDTH), (2 * REACH * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, tokens), (tokens,)]
        return WindowNetwork([(rng.standard_normal(s) * (0.3 if len(s) == 3 else s[0] ** -0.5 if len(s) == 2 else 0)).astype(np.float32) for s in shapes])

    def _forward(self, code: np.ndarray):
        embed, w1, b1, w2, b2 = self.weights
        context = np.stack([code >> (self.bits * (k + 1)) & ((1 << self.bits) - 1) for k in range(2 * REACH)], axis=1)
        x = np.concatenate([embed[k][context[:, k]] for k in range(2 * REACH)], axis=1)
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2
        z -= z.max(axis=1, keepdims=True)
        return context, x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probs(self, code: np.ndarray) -> np.ndarray:
        return self._forward(code)[3][np.arange(len(code)), code & ((1 << self.bits) - 1)]

    def train(self, code: np.ndarray, count: np.ndarray, steps: int, batch: int, seed: int, rate: float) -> None:
        """Adam steps in passes over all windows, each weighing as much as it occurs, until at least ``steps`` are taken.

        A window with over four times the mean count is dealt as several rows that share it, a
        quarter more rows at most: no mini-batch is ruled by one window.
        """
        rng = np.random.default_rng(seed)
        parts = np.ceil(count / (4 * count.mean())).astype(np.int64)
        rows = np.repeat(np.arange(len(code)), parts)
        weight = (count / parts)[rows].astype(np.float32)
        weight /= weight.mean()
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        per_pass = -(-len(rows) // batch)
        for t in range(1, per_pass * max(1, -(-steps // per_pass)) + 1):
            start = (t - 1) % per_pass * batch
            if not start:
                order = rng.permutation(len(rows))
            at = order[start:start + batch]
            some = code[rows[at]]
            context, x, h, logp = self._forward(some)
            dz = np.exp(logp)
            dz[np.arange(len(some)), some & ((1 << self.bits) - 1)] -= 1
            dz *= weight[at, None] / batch
            embed, w1, _, w2, _ = self.weights
            dh = (dz @ w2.T) * (1 - h * h)
            dx = dh @ w1.T
            grad_e = np.zeros_like(embed)
            for k in range(2 * REACH):
                np.add.at(grad_e[k], context[:, k], dx[:, k * WIDTH:(k + 1) * WIDTH])
            for w, g, m, v in zip(self.weights, [grad_e, x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def looked_up(self, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows; a process remembers the latest in a table of fixed size, one window a slot."""
        if self.known is None:
            self.known = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN, np.float32)
        held, value = self.known
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - KNOWN.bit_length())).astype(np.int64)
        found = value[slot]
        missing = np.flatnonzero(held[slot] != code)
        if len(missing):
            new, which = np.unique(code[missing], return_inverse=True)
            fresh = np.concatenate([self.log_probs(new[start:start + (1 << 14)]) for start in range(0, len(new), 1 << 14)])
            found[missing] = fresh[which]
            places, first = np.unique(slot[missing], return_index=True)
            held[places], value[places] = code[missing][first], found[missing][first]
        return found


def corpus_windows(rows: DataFrame) -> DataFrame:
    """How often every window of five bytes occurs in the whole corpus: ``code``, ``n``; shuffled by window."""
    table = byte_table()

    def count(batches):
        for batch in batches:
            for group in pieces(batch.column("raw")):
                code, n = np.unique(windows([x for _, x, _ in group], table, [x for _, _, x in group])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return checkpointed(rows.select("raw").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))


def train_network(counts: DataFrame, slices: int = SLICES, rounds: int = ROUNDS, steps: int = STEPS, batch: int = BATCH, seed: int = 0, slice_rows: int = SLICE_ROWS) -> WindowNetwork:
    """A network trained on every counted window of the whole corpus.

    The windows are dealt over as many slices as their number asks for, ``slices`` at least.  In each
    round every slice passes over all its windows from the common weights, ``steps`` mini-batches at
    least, and the weights are averaged, each slice counting as much as its windows occur.  Sums of
    weights are all that reaches the driver, whatever the number of slices.
    """
    network = WindowNetwork.fresh(seed, TOKENS)
    rows, total = counts.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return network
    slices = max(slices, -(-rows // slice_rows))
    sliced = checkpointed(counts.withColumn("slice", F.pmod(F.xxhash64("code"), F.lit(slices)).cast("int")))
    for r in range(rounds):
        rate = 0.01 * 0.5**r

        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("code")
            local = WindowNetwork([w.copy() for w in network.weights])
            local.train(frame["code"].to_numpy(), frame["n"].to_numpy(), steps, batch, seed + 1000 * r + int(frame["slice"].iloc[0]), rate)
            flat = np.concatenate([w.ravel() for w in local.weights]).astype(np.float64)
            return pd.DataFrame({"place": np.arange(len(flat), dtype=np.int32), "share": np.rint(flat * (frame["n"].sum() / total * ONE)).astype(np.int64)})

        learned = sliced.repartition(min(4 * slices, 4096), "slice").groupBy("slice").applyInPandas(learn, "place int, share bigint")
        got = learned.groupBy("place").agg(F.sum("share").alias("share")).orderBy("place").toPandas()
        flat = (got["share"].to_numpy() / ONE).astype(np.float32)
        cuts = np.cumsum([w.size for w in network.weights])[:-1]
        network = WindowNetwork([part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), network.weights)])
    return network


def score_texts(docs: DataFrame, network: WindowNetwork, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens``, ``log_prob`` (the sum over all tokens), ``mean_log_prob``.

    Null and empty texts have no token and 0 for both; long ones are scored piece by piece.  Equal texts score
    alike, so ties stay ties.  Columns other than id and text are not looked at.
    """
    table = byte_table()
    # some thousand weights, as arrays only: the network is made where it is used, once a process
    shared = docs.sparkSession.sparkContext.broadcast({"weights": network.weights})

    def score(batches):
        held = shared.value
        if "network" not in held:
            held["network"] = WindowNetwork(held["weights"])
        for batch in batches:
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for group in pieces(batch.column(1)):
                code, size = windows([x for _, x, _ in group], table, [x for _, _, x in group])
                found = np.concatenate([[0.0], np.cumsum(held["network"].looked_up(code), dtype=np.float64)])
                ends = np.cumsum(size)
                number = [k for k, _, _ in group]
                np.add.at(n, number, size)
                np.add.at(s, number, found[ends] - found[ends - size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1))],
                                             names=["key", "n_tokens", "log_prob", "mean_log_prob"])

    rows = docs.select(F.col(f"`{id}`").alias("key"), raw_bytes(f"`{text}`").alias("raw"))
    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint, log_prob double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame, id: str = "doc_id", text: str = "text", **training) -> DataFrame:
    """Train on all texts of ``docs`` and score each of them; see ``train_network`` and ``score_texts``."""
    network = train_network(corpus_windows(docs.select(raw_bytes(f"`{text}`").alias("raw"))), **training)
    return score_texts(docs, network, id, text)
