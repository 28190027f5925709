"""Language identification: n-gram presence kernels, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasksieve.llm.common import least_hashed
from tasksieve.session import checkpointed

#: Text is seen as a string over 64 symbols: 0 for all that is no letter, 1-26 for a-z, 27-63 for other letters by code point.
SYMBOLS = 64
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Bounds of the training sample: rows of each language, and landmarks of each among them.
ROWS_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-3
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of every code point, upper case as lower case; letters are what Unicode calls letters."""
    table = np.zeros(0x110000, np.int8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


def presence(text: str, table: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, bool]:
    """Numbers of the 1-, 2- and 3-grams that occur in a whole text (blended spectrum), and whether it has a letter.

    Runs of non-letters count as one.  Long texts are read piece by piece, overlapping by two characters.
    """
    seen, letters = np.zeros(GRAMS, np.uint8), False
    before = np.zeros(0, np.int32)
    for start in range(0, len(text), piece):
        codes = np.frombuffer(text[start:start + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = table[codes].astype(np.int32)
        letters = letters or bool(symbols.any())
        symbols = np.concatenate([before, symbols])
        if len(symbols) > 1:
            symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]
        seen[symbols] = 1
        if len(symbols) > 1:
            pairs = symbols[:-1] * SYMBOLS + symbols[1:]
            seen[SYMBOLS + pairs] = 1
            if len(symbols) > 2:
                seen[SYMBOLS + SYMBOLS**2 + pairs[:-1] * SYMBOLS + symbols[2:]] = 1
        before = symbols[-2:]
    return np.flatnonzero(seen), letters


@dataclass
class LanguageModel:
    """Scores are linear in the presence vector over its norm: ``weights`` folds landmarks, Nyström map and ridge solution."""

    languages: list[str]
    column: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    table: np.ndarray

    def scores(self, texts: list[str], batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """One row of scores per text and whether the text has a letter; presence rows times weights, a batch at a time."""
        rows, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for start in range(0, len(texts), batch):
            some = texts[start:start + batch]
            x, norm = np.zeros((len(some), len(self.weights)), np.float32), np.ones(len(some))
            for k, text in enumerate(some):
                grams, letters[start + k] = presence(text, self.table)
                norm[k] = max(1.0, len(grams)) ** 0.5
                at = self.column[grams]
                x[k, at[at >= 0]] = 1
            rows[start:start + len(some)] = (x @ self.weights) / norm[:, None] + self.bias
        return rows, letters


def kernel_ridge(grams: list[np.ndarray], labels: list[str], landmarks: np.ndarray, ridge: float, table: np.ndarray) -> LanguageModel:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmark rows.

    The kernel is the number of n-grams that two texts share over the root of the product of their
    numbers.  With L the landmarks' normed presence rows, a text's features are K(x, L) (L L')^(-1/2).
    """
    languages = sorted(set(labels))
    used = np.unique(np.concatenate([grams[i] for i in landmarks]))
    column = np.full(GRAMS, -1, np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)

    def normed(indices):
        x = np.zeros((len(indices), len(used)), np.float32)
        for k, i in enumerate(indices):
            at = column[grams[i]]
            x[k, at[at >= 0]] = 1 / max(1.0, len(grams[i])) ** 0.5
        return x

    marks = normed(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * max(values.max(), 1e-8)
    into = marks.T @ (vectors[:, good] / np.sqrt(values[good]))
    gram = np.zeros((into.shape[1] + 1,) * 2)
    right = np.zeros((into.shape[1] + 1, len(languages)))
    own = np.array([languages.index(x) for x in labels])
    for start in range(0, len(grams), 512):
        rows = np.arange(start, min(start + 512, len(grams)))
        phi = np.c_[normed(rows) @ into, np.ones(len(rows))]
        gram += phi.T @ phi
        right += phi.T @ np.where(own[rows, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = ridge * len(grams) * np.eye(len(gram))
    penalty[-1, -1] = 0
    solved = np.linalg.solve(gram + penalty, right)
    return LanguageModel(languages, column, (into @ solved[:-1]).astype(np.float32), solved[-1], table)


def held_out(id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE,
          landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> LanguageModel | None:
    """Learn from text and non-null language of rows that aren't held out; None if there is no such row with a letter.

    Of each language the ``rows`` rows with the least hash of the id are used, whole texts; only their
    n-gram numbers reach the driver.  Ids are ranked without texts, then the chosen rows are read.
    """
    table = symbol_table()
    good = docs.filter(~held_out(F.col(f"`{id}`")) & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    named = good.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{id}`").alias("key"), F.xxhash64(F.col(f"`{id}`")).alias("hash"))
    chosen = checkpointed(least_hashed(named, "lang", "hash", [F.asc("key")], rows).select(F.col("lang").alias("cl"), F.col("key").alias("ck"), "hash").distinct())  # ``rows`` of each language at most
    texts = good.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{id}`").alias("key"))
    drawn = texts.join(F.broadcast(chosen), (F.col("lang") == F.col("cl")) & F.col("key").eqNullSafe(F.col("ck")))
    again = Window.partitionBy("lang").orderBy("hash", "key", "text")  # more rows than chosen only where ids repeat
    sample = drawn.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= rows)

    def run(batches):
        for batch in batches:
            found = [presence(x, table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g for g, _ in found], pa.list_(pa.int32())),
                                              pa.array([bool(a) for _, a in found])], names=["lang", "rank", "grams", "letters"])

    got = sample.select("lang", "text", "rank").mapInArrow(run, "lang string, rank int, grams array<int>, letters boolean").filter("letters")
    got = sorted(got.select("lang", "rank", "grams").toArrow().to_pylist(), key=lambda r: (r["lang"], r["rank"]))
    if not got:
        return None
    labels, grams = [r["lang"] for r in got], [np.array(r["grams"], np.int64) for r in got]
    marks, count = [], {}
    for k, label in enumerate(labels):
        count[label] = count.get(label, 0) + 1
        if count[label] <= landmarks:
            marks.append(k)
    return kernel_ridge(grams, labels, np.array(marks), ridge, table)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its score from 0 to 1.

    The score is the regression value for "this language" (-1 to 1) moved to 0 to 1.  Texts that are
    null or have no letter, and all texts if there is no model, are ``und`` with score 0.  Of languages with
    equal values the first in order is told.  A row of ``docs`` keeps all its columns; one that is
    called like the prediction or the score is there twice, so name them otherwise then.
    """
    return _told(docs, model, text).select("doc.*", F.col("told.name").alias(prediction), F.col("told.value").alias(score))


def _told(docs: DataFrame, model: LanguageModel | None, text: str) -> DataFrame:
    """``doc`` (a row, whatever its columns are called) and ``told`` (name, value)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    if model is None:
        return rows.select("doc", F.struct(F.lit(UNKNOWN).alias("name"), F.lit(0.0).alias("value")).alias("told"))
    # a fixed number of landmarks of 266,304 n-grams at most, as arrays only: the model is made where it is used
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("struct<name string, value double>")
    def told(texts: pa.Array) -> pa.Array:
        learned = LanguageModel(**shared.value)
        names, values = [], []
        for at in range(0, len(texts), 64):
            rows, letters = learned.scores([x or "" for x in texts.slice(at, 64).to_pylist()])
            best = rows.argmax(axis=1)
            value = np.clip((rows[np.arange(len(rows)), best] + 1) / 2, 0, 1)
            names += np.where(letters, np.array(learned.languages, object)[best], UNKNOWN).tolist()
            values += np.where(letters, value, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["name", "value"])

    return rows.select("doc", told("text").alias("told"))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``lang_pred``, ``score``; the model is trained on ``docs``.

    Id and language choose and label training rows only.  Repeated rows are predicted alike; an empty
    table gives an empty result.  A null id is never held out.
    """
    narrow = docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{text}`").alias("text"))
    told = predict(narrow, train(docs, id, text, lang, **options))
    return told.select("key", held_out(F.col("key")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that no language can be told for; all columns stay as they are, whatever their names."""
    return _told(docs, train(docs, id, text, lang, **options), text).filter(F.col("told.name") != UNKNOWN).select("doc.*")
