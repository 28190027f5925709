"""Token statistics, term tables, TF-IDF and text vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml import feature as MF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.vectors import matrix
from tasksieve.session import BROADCAST_ROWS, checkpointed, small_side, top_per_group, unfold

#: Most slots of the counting filter for rare terms; a bit each is sent to all tasks (8 MB).
FILTER_SLOTS = 1 << 26
#: Longest term that is sent to all tasks with its frequency.
SENT_LENGTH = 256
#: Text that a task cuts into terms and counts, in bytes.
TEXT_BYTES = 8 << 20
#: Tokens and texts of a pack; a text is never cut, so a pack may have the tokens of one text more.
PACK_TOKENS, PACK_TEXTS = 1 << 20, 1 << 14
#: Terms of texts that training works on at a time, so that they stay in a processor's cache.
PACK_TERMS = 1 << 16
#: Most slots, as a power of 2, that the words and pairs of a corpus are counted in before their names are.
SLOT_BITS = 22


def tokens(c: Column, pattern: str = K.TOKEN, stop: list[str] = ()) -> Column:
    lowered = (F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)) if pattern != K.TOKEN
               else F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower))
    return F.filter(lowered, lambda t: ~t.isin(list(stop))) if stop else lowered


def token_counts(df: DataFrame, c: str, min_len: int = 4, stop: list[str] = (), id_free: bool = False) -> DataFrame:
    """``(token, n, docs)``: occurrences of letter runs, and texts that hold the token as a word.

    Both counts come from one exploded list and one aggregation; a row never has
    to meet the other rows with its token.
    """
    pattern = rf"[A-Za-z]{{{min_len},}}"
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower)
    hits = F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("docs")))
    if not id_free:
        whole = F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"{K.WORD}+"), F.lit(0)), lambda w: w.rlike(f"^{pattern}$"))
        words = F.transform(F.array_distinct(whole), lambda t: F.struct(
            t.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("docs")))
        hits = F.concat(hits, words)
    rows = unfold(df, hits, "hit").select("hit.*")
    if stop:
        rows = rows.filter(~F.col("token").isin(list(stop)))
    out = rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    out = out.filter("n > 0")
    return out.drop("docs") if id_free else out


def token_topk(df: DataFrame, c: str, k: int = 20, min_len: int = 4, stop: list[str] | None = None) -> DataFrame:
    """Most frequent tokens with their number of texts and its share."""
    counts = token_counts(df, c, min_len, K.TOKEN_STOP_WORDS if stop is None else stop)
    top = counts.orderBy(F.desc("n"), "token").limit(k)
    total = df.agg(F.count("*").alias("total")).scalar()
    return top.select("token", "n", "docs", (F.col("docs") * 100 / total).alias("pct"))


def grams(words: Column, n: tuple[int, int] = (1, 2)) -> Column:
    """Word n-grams of a token array, joined by a space: the array zipped with itself, shifted."""
    lists = [words] if n[0] == 1 else []
    run = words
    for size in range(2, n[1] + 1):
        count = F.greatest(F.size(words) - (size - 1), F.lit(0))
        run = F.zip_with(F.slice(run, F.lit(1), count), F.slice(words, F.lit(size), F.greatest(F.size(words), F.lit(1))),
                         lambda left, right: F.concat(left, F.lit(" "), right))
        if size >= n[0]:
            lists.append(run)
    return F.concat(*lists)


def long_terms(df: DataFrame, c: str, keys: list[str], ngrams: tuple[int, int] = (1, 1),
               pattern: str = K.TOKEN, stop: list[str] = ()) -> DataFrame:
    """``(*keys, term, tf)``; stop words go before the n-grams are built."""
    # the token array is used several times by n-grams, so it is a column of its own
    listed = df.select(*keys, tokens(F.col(c), pattern, stop).alias("__w"))
    return _grouped(unfold(listed.select(*keys, _terms_of(ngrams).alias("__terms")), F.col("__terms"), "term", *keys), keys)


def _terms_of(ngrams: tuple[int, int]) -> Column:
    return F.col("__w") if ngrams == (1, 1) else grams(F.col("__w"), ngrams)


def _grouped(terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def frequent_terms(df: DataFrame, c: str, keys: list[str], min_df: int, ngrams: tuple[int, int] = (1, 1),
                   pattern: str = K.TOKEN, stop: list[str] = (), slots: int = FILTER_SLOTS) -> DataFrame:
    """``long_terms`` without most of the terms that fewer than ``min_df`` rows hold, stored.

    Texts are cut into tokens once and the tokens stored.  A counting filter comes first: terms are
    hashed into slots and every slot counts the rows that hold one of its terms, at least as many as each of them has.
    Slots below ``min_df`` hold rare terms only, whose rows go before the shuffle.  The others are kept as
    words of 64 bits, ``slots`` / 64 rows at most, and sent to all tasks.  Nothing frequent is lost, but
    rare terms in a full slot stay: count exactly afterwards.
    """
    stored = checkpointed(df.select(*keys, tokens(F.col(c), pattern, stop).alias("__w")))
    # Rows are dealt by their keys before they become terms, so that terms are counted where they are.
    listed = stored.repartition(*keys).select(*keys, _terms_of(ngrams).alias("__terms"))
    if min_df > 1:
        total = stored.agg(F.coalesce(F.sum(F.size("__w")), F.lit(0))).first()[0] * (ngrams[1] - ngrams[0] + 1)
        size = min(slots, 1 << max(6, (2 * total).bit_length()))

        def slot(term: Column) -> Column:
            return F.xxhash64(term).bitwiseAND(F.lit(size - 1))

        held = unfold(stored.select(_terms_of(ngrams).alias("__terms")).select(F.array_distinct(F.transform("__terms", slot)).alias("__s")), F.col("__s"), "slot")
        full = held.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") >= min_df)
        place, bit = F.shiftright("slot", 6), F.col("slot").bitwiseAND(F.lit(63)).cast("int")
        words = full.select(place.alias("__place"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit")).groupBy("__place").agg(F.bit_or("bit").alias("__bits"))
        terms = unfold(listed, F.col("__terms"), "term", *keys).withColumn("slot", slot(F.col("term")))
        terms = terms.join(F.broadcast(words), place == F.col("__place")).filter(F.getbit("__bits", bit) == 1).select(*keys, "term")
    else:
        terms = unfold(listed, F.col("__terms"), "term", *keys)
    return checkpointed(_grouped(terms, keys))


def group_terms(df: DataFrame, c: str, group: list[str], id_col: str, ngrams: tuple[int, int] = (1, 1), pattern: str = K.TOKEN,
                stop: list[str] = (), size: int = TEXT_BYTES) -> DataFrame:
    """``(*group, term, tf, df)``: occurrences of a term in the texts of a group, and ids whose texts hold it.

    Texts are dealt by id in parts of about ``size`` bytes, counted first, and their terms in as many, so that what a task
    holds does not grow with the table.  Terms of an id are counted where its texts are; rows are read twice.
    """
    total = df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size))
    per_id = long_terms(df.select(id_col, *group, c).repartition(parts, id_col), c, [id_col, *group], ngrams, pattern, stop)
    return per_id.repartition(parts, *group, "term").groupBy(*group, "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def with_frequency(long: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of a stored term table whose term is in ``kept (term, df, ...)``, with its columns.

    The most frequent terms, which have most rows, are sent to all tasks, so their rows stay where they are; the others
    are shuffled by term.
    """
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    sent = kept.filter(F.length("term") <= SENT_LENGTH).orderBy(F.desc("df"), "term").limit(BROADCAST_ROWS).persist(StorageLevel.MEMORY_AND_DISK)
    names = F.broadcast(sent.select("term"))
    rest = long.join(names, "term", "left_anti").join(kept.join(names, "term", "left_anti").hint("merge"), "term")
    return long.join(F.broadcast(sent), "term").unionByName(rest)


def document_frequency(long: DataFrame, id_col: str = "task_id") -> DataFrame:
    return long.groupBy("term").agg(F.count("*").alias("df"))


def count_vectors(df: DataFrame, c: str, id_col: str = "task_id", ngrams: tuple[int, int] = (1, 2),
                  min_df: int = 2, max_df: float = 1.0, stop: list[str] = (), pattern: str = K.TOKEN) -> DataFrame:
    """Long count table ``(id, term, tf)`` of the terms within the frequency limits."""
    long = frequent_terms(df, c, [id_col], min_df, ngrams, pattern, stop)
    frequency = document_frequency(long)
    if max_df < 1.0:
        frequency = frequency.filter(F.col("df") <= df.agg(F.count("*").alias("n")).scalar() * max_df)
    kept = frequency.filter(F.col("df") >= min_df)
    return with_frequency(long, kept).select(id_col, "term", "tf")


def count_vector_model(c: str, out: str = "features", min_df: int = 2, max_df: float = 1.0,
                       stop: list[str] | None = None, vocab: int = 1 << 18) -> Pipeline:
    """The same features as a sparse vector column, for estimators."""
    remover = MF.StopWordsRemover(inputCol="tokens_", outputCol="words_")
    if stop is not None:
        remover = remover.setStopWords(list(stop) or ["\x00"])
    return Pipeline(stages=[
        MF.RegexTokenizer(inputCol=c, outputCol="tokens_", gaps=False, pattern=K.TFIDF_TOKEN, toLowercase=True),
        remover,
        MF.NGram(inputCol="words_", outputCol="pairs_", n=2),
        MF.SQLTransformer(statement="SELECT *, concat(words_, pairs_) AS grams_ FROM __THIS__"),
        # MLlib reads a maxDF of 1.0 as one text, so "all texts" is its default.
        MF.CountVectorizer(inputCol="grams_", outputCol=out, minDF=min_df, vocabSize=vocab, **({"maxDF": max_df} if max_df < 1 else {})),
    ])


def strip_accents(c: Column) -> Column:
    from tasksieve.functions.text import _nfkd

    plain = F.octet_length(c) == F.char_length(c)  # ASCII has no accents and does not travel to Python
    return F.when(plain, c).otherwise(F.regexp_replace(_nfkd(F.when(~plain, c)), r"\p{M}+", ""))


def tfidf_features(df: DataFrame, c: str, id_col: str = "task_id", vocab: int | None = None, min_df: int = 2,
                   sublinear: bool = True, stop: list[str] = ()) -> DataFrame:
    """Long TF-IDF table ``(id, term, tf, idf, weight)`` with unit length per text.

    Weights are ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, then divided by
    the length of the text's vector.  All terms count; ``vocab`` keeps only the most
    frequent over the corpus, ties by term.
    """
    plain = df.withColumn("__t", strip_accents(F.lower(c)))
    long = frequent_terms(plain, "__t", [id_col], min_df, (1, 2), K.TFIDF_TOKEN, stop)
    stats = long.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = stats.filter(F.col("df") >= min_df)
    if vocab is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(vocab)
    n = df.agg(F.count("*").alias("n")).scalar()
    idf = kept.select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    tf = (F.log("tf") + 1) if sublinear else F.col("tf").cast("double")
    raw = with_frequency(long, idf).withColumn("raw", tf * F.col("idf")).filter(F.col(id_col).isNotNull())
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "tf", "idf", (F.col("raw") / norm).alias("weight"))


@F.pandas_udf(VectorUDT())
def _damped(counts: pd.DataFrame) -> pd.DataFrame:
    """``1 + ln`` of the counts of a whole Arrow batch at once; vectors come as the columns they consist of."""
    if not len(counts):
        return counts
    ends = np.cumsum([len(v) for v in counts["values"]])
    damped = np.split(1 + np.log(np.concatenate(counts["values"].to_numpy())), ends[:-1])
    return counts.assign(values=pd.Series(damped, index=counts.index, dtype="object"))


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``1 + ln tf`` on a sparse count vector, the step MLlib has no stage for."""

    def __init__(self, inputCol: str = "counts_", outputCol: str = "tf_"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _damped(self.getInputCol()))


class TfidfVectors(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF vectors of unit length over a vocabulary of words and pairs: tokens as ``RegexTokenizer`` finds them, ``1 + ln tf``, idf.

    Tokens are found natively; a whole Arrow batch is then looked up at once.  A text that is null has no terms.
    """

    vocabulary_ = Param(Params._dummy(), "vocabulary_", "words and pairs by place", TypeConverters.toListString)
    idf_ = Param(Params._dummy(), "idf_", "idf by place", TypeConverters.toListFloat)

    def __init__(self, inputCol: str = "text", outputCol: str = "features", vocabulary: list[str] = (), idf: list[float] = ()):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, vocabulary_=list(vocabulary), idf_=list(idf))

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.vocabulary_)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.vocabulary, np.array(self.getOrDefault(self.idf_))))
        held: list[Vocabulary] = []

        @F.pandas_udf(VectorUDT())
        def vectors(texts: pd.Series) -> pd.DataFrame:
            names, idf = shared.value
            if not held:
                held.append(Vocabulary(names))
            # a list of no tokens is sent as "", which would be one token
            lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
            lengths = np.where(texts.to_numpy() == "", 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = pc.drop_null(pc.replace_with_mask(lists.flatten(), pc.equal(lists.flatten(), ""), pa.scalar(None, pa.string()))).dictionary_encode()
            p = TokenPack(found.dictionary, found.indices.to_numpy(zero_copy_only=False), np.cumsum(lengths, dtype=np.int64))
            doc, place, tf = _counted(p, held[0], len(names))
            weights = (1 + np.log(tf)) * idf[place] if len(place) else np.zeros(0)
            norm = np.sqrt(np.bincount(doc, weights ** 2, minlength=len(texts)))
            weights = weights / norm[doc]
            cuts = np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]
            cells = {"type": np.zeros(len(texts), np.int8), "size": np.full(len(texts), len(names), np.int32)}
            lists = {"indices": np.split(place.astype(np.int32), cuts), "values": np.split(weights, cuts)}
            return pd.DataFrame(cells | {c: pd.Series(v, dtype="object") for c, v in lists.items()}, index=texts.index)

        listed = tokens(F.col(self.getInputCol()), K.TFIDF_TOKEN)
        return dataset.withColumn(self.getOutputCol(), vectors(F.coalesce(F.array_join(listed, " "), F.lit(""))))


def fit_tfidf(df: DataFrame, c: str, out: str = "features", vocab: int = 25_000, min_df: int = 2) -> PipelineModel:
    """TF-IDF as a fitted pipeline: words and pairs, ``1 + ln tf``, smoothed idf (``ln((n + 1) / (df + 1)) + 1``), unit length."""
    packs = checkpointed(token_packs(df, c, [], K.TFIDF_TOKEN))
    return tfidf_of_packs(packs, packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], c, out, vocab, min_df)


def fit_transform_tfidf(df: DataFrame, c: str, keep: list[str], out: str = "features", vocab: int = 25_000,
                        min_df: int = 2) -> tuple[PipelineModel, DataFrame]:
    """The stages of ``fit_tfidf``, and the columns ``keep`` of the rows with their vector ``out``."""
    model = fit_tfidf(df, c, out, vocab, min_df)
    return model, model.transform(df).select(*keep, out)


def tfidf_of_packs(packs: DataFrame, n: int, c: str, out: str = "features", vocab: int = 25_000, min_df: int = 2) -> PipelineModel:
    """The stages of ``fit_tfidf`` from stored ``token_packs`` of ``n`` texts.

    Texts are cut into tokens once and stored as numbers, a pack with its own list of words.  Pairs of words are pairs of
    numbers from then on: only terms that may be among the ``vocab`` most frequent ever become strings.
    """
    terms = most_frequent(packs, vocab, min_df)
    idf = np.log((n + 1) / (np.array([t["df"] for t in terms], dtype=np.float64) + 1)) + 1
    return PipelineModel(stages=[TfidfVectors(c, out, [t["term"] for t in terms], idf.tolist())])


def one_by_one(packs: DataFrame) -> DataFrame:
    """Packs are large rows, so a task takes few of them at a time."""
    packs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(
        1_000, int(packs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    return packs


def token_packs(df: DataFrame, c: str, keep: list[str], pattern: str = K.TOKEN, stop: list[str] = ()) -> DataFrame:
    """The texts as numbers: one row for about ``PACK_TOKENS`` tokens of consecutive rows.

    ``(n, c_<keep> array, words array, hashes, codes, ends)``: the words of the pack with a hash, the number of each token's word, and where the
    tokens of each text end.
    """
    arrays = ", ".join(f"`c_{k}` array<{df.schema[k].dataType.simpleString()}>" for k in keep)
    schema = "n int, " + (arrays + ", " if keep else "") + "words array<string>, hashes binary, codes binary, ends binary"

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("__w").combine_chunks() if rows.num_rows else None
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = lists.flatten().dictionary_encode()
        one = [pa.array([rows.num_rows], pa.int32())]
        for k in keep:
            values = rows.column(k).combine_chunks()
            one.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        words = found.dictionary.cast(pa.string())
        one.append(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words))
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        hashes = pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False)
        one += [pa.array([hashes.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([np.cumsum(lengths).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(one, ["n", *[f"c_{k}" for k in keep], "words", "hashes", "codes", "ends"])

    def run(batches):
        held, tokens_held, rows_held = [], 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index("__w"))), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths, dtype=np.int64), 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                stop_at = min(int(np.searchsorted(ends, before + PACK_TOKENS - tokens_held)) + 1, at + PACK_TEXTS - rows_held, batch.num_rows)
                stop_at = max(stop_at, at + 1)
                held.append(batch.slice(at, stop_at - at))
                tokens_held += int(ends[stop_at - 1] - before)
                rows_held += stop_at - at
                at = stop_at
                if tokens_held >= PACK_TOKENS or rows_held >= PACK_TEXTS:
                    yield pack(held)
                    held, tokens_held, rows_held = [], 0, 0
        if rows_held:
            yield pack(held)

    listed = df.select(*keep, tokens(F.col(c), pattern, stop).alias("__w"))
    return listed.mapInArrow(run, schema)


class TokenPack:
    """A row of ``token_packs``: its words with their hashes, and the words and pairs of its texts as numbers.

    The number of a pair ``a b`` is ``V + a V + b`` with ``V`` words in the pack.
    """

    def __init__(self, words: pa.Array, codes: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None):
        self.words = words.cast(pa.string())
        self.v = max(1, len(words))
        self.codes, self.ends, self.hashes = codes.astype(np.int64), ends, hashes
        self.doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.follows = np.flatnonzero(self.doc[:-1] == self.doc[1:])  # the first place of each pair

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> TokenPack:
        words, hashes, codes, ends = (batch.column(batch.schema.get_field_index(c))[i] for c in ("words", "hashes", "codes", "ends"))
        numbers = (np.frombuffer(c.as_buffer(), dtype=t) for c, t in ((codes, np.int32), (ends, np.int64), (hashes, np.uint64)))
        return cls(words.values, *numbers)

    def slots(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words of the list, and of all pairs."""
        with np.errstate(over="ignore"):
            h = self.hashes
            first = h * np.uint64(0x9E3779B97F4A7C15)
            pair = first[self.codes[self.follows]] + h[self.codes[self.follows + 1]]
            pair ^= pair >> np.uint64(29)
            pair *= np.uint64(0xBF58476D1CE4E5B9)
        shift = np.uint64(64 - bits)
        return (first >> shift).astype(np.int64), (pair >> shift).astype(np.int64)

    def strings(self, grams: np.ndarray) -> pa.Array:
        single = grams < self.v
        a, b = np.divmod(grams - self.v, self.v)
        left = self.words.take(pa.array(np.where(single, grams, a)))
        right = self.words.take(pa.array(np.where(single, 0, b)))
        return pc.if_else(pa.array(single), left, pc.binary_join_element_wise(left, right, " "))


def _packs_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield TokenPack.of(batch, i)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)


def _frequencies(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, their occurrences and the texts that hold them, from one sort."""
    bits = int(doc.max(initial=0)).bit_length()
    key = np.sort((gram << bits) | doc)
    held = _starts(key)
    gram = key >> bits
    first = _starts(gram)
    n = np.diff(np.r_[first, len(gram)])
    return gram[first], n, np.diff(np.r_[np.searchsorted(held, first), len(held)])


def summed_slots(packs: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of words and pairs by the slot of their hash; no term has more than its slot."""
    parts = 16

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for p in _packs_of(batches):
            single, pair = p.slots(bits)
            np.add.at(total, single, np.bincount(p.codes, minlength=p.v)[:len(single)])
            np.add.at(total, pair, 1)
        yield from (pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "x"]) for i, x in enumerate(np.split(total, parts)))

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(x, dtype=np.int64)
        yield from (pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "x"]) for i, x in held.items())

    cores = packs.sparkSession.sparkContext.defaultParallelism
    some = one_by_one(packs).coalesce(cores).mapInArrow(count, "part int, x binary")
    rows = some.repartition(parts, "part").mapInArrow(add, "part int, x binary").collect()
    return np.concatenate([np.frombuffer(r["x"], dtype=np.int64) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(1 << bits, dtype=np.int64)


def most_frequent(packs: DataFrame, vocab: int, min_df: int, bits: int = SLOT_BITS) -> list:
    """``(term, n, df)`` of the ``vocab`` most frequent words and pairs that ``min_df`` texts hold, ties by term.

    Slots are counted first.  A term with ``least`` occurrences is in a slot that has as many, so only terms of such slots are
    counted by name.  The answer is final if enough of them have ``least`` occurrences; else ``least`` is halved.
    """
    total = packs.agg(F.coalesce(F.sum(F.octet_length("codes")), F.lit(0))).first()[0] // 2
    bits = min(bits, max(6, (2 * total).bit_length()))
    slots = summed_slots(packs, bits)
    ranked = np.sort(slots[slots > 0])[::-1]
    least = int(ranked[2 * vocab - 1]) if len(ranked) >= 2 * vocab else 0
    context = packs.sparkSession.sparkContext
    while True:
        wanted = context.broadcast(np.packbits(slots >= max(1, least)))

        def count(batches):
            held = np.unpackbits(wanted.value).astype(bool)
            for p in _packs_of(batches):
                single, pair = (held[s] for s in p.slots(bits))
                at = np.flatnonzero(single[p.codes]) if len(p.codes) else p.codes
                first = p.follows[pair]
                gram = np.concatenate([p.codes[at], p.v + p.codes[first] * p.v + p.codes[first + 1]])
                gram, n, df = _frequencies(gram, np.concatenate([p.doc[at], p.doc[first]]))
                yield pa.RecordBatch.from_arrays([p.strings(gram), pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["term", "n", "df"])

        found = (one_by_one(packs).mapInArrow(count, "term string, n bigint, df bigint").groupBy("term")
                 .agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("df") >= min_df))
        top = found.orderBy(F.desc("n"), "term").limit(vocab).collect()
        wanted.unpersist()
        if least <= 1 or len(top) == vocab and top[-1]["n"] >= least:
            return top
        least //= 2


class Vocabulary:
    """Terms with their places, looked up for all tokens of a pack at once."""

    def __init__(self, names: list[str]):
        pairs = [(n.split(" "), i) for i, n in enumerate(names) if " " in n]
        self.words, self.places = [n for n in names if " " not in n], np.array([i for i, n in enumerate(names) if " " not in n], dtype=np.int64)
        self.parts = sorted({w for p, _ in pairs for w in p})
        number = {w: i for i, w in enumerate(self.parts)}
        keys = np.array([number[a] * len(self.parts) + number[b] for (a, b), _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.pair_places = keys[order], np.array([i for _, i in pairs], dtype=np.int64)[order]
        self.known = np.zeros(1 << 22, dtype=bool)
        self.known[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    @staticmethod
    def _index(words: pa.Array, among: list[str]) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=pa.array(among, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def found(self, p: TokenPack) -> tuple[np.ndarray, np.ndarray]:
        """``(text, place)`` of each token and pair that is a term."""
        single = self._index(p.words, self.words)
        single = np.where(single >= 0, self.places[single] if len(self.places) else -1, -1)[p.codes] if len(p.codes) else p.codes
        at = np.flatnonzero(single >= 0) if len(p.codes) else p.codes
        part = self._index(p.words, self.parts)
        first = p.follows
        a = part[p.codes[first]]
        first = first[a >= 0]
        b = part[p.codes[first + 1]]
        first, key = first[b >= 0], a[a >= 0][b >= 0] * len(self.parts) + b[b >= 0]
        maybe = self.known[self._slot(key)]
        first, key = first[maybe], key[maybe]
        place = np.searchsorted(self.keys, key)
        right = (self.keys[np.minimum(place, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)
        return np.concatenate([p.doc[at], p.doc[first[right]]]), np.concatenate([single[at], self.pair_places[place[right]]])


def _counted(p: TokenPack, vocabulary: Vocabulary, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, place, tf)`` of the terms of a pack, by text and place."""
    doc, place = vocabulary.found(p)
    bits = max(1, size).bit_length()
    key = np.sort((doc << bits) | place)
    first = _starts(key)
    return key[first] >> bits, key[first] & ((1 << bits) - 1), np.diff(np.r_[first, len(key)])


def _least_type(x: np.ndarray, most: int) -> np.ndarray:
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def feature_packs(packs: DataFrame, keep: list[str], names: list[str], idf: np.ndarray) -> DataFrame:
    """The terms of a vocabulary in each text of the packs, once by text and once by term, see ``FeaturePack``."""
    shared = packs.sparkSession.sparkContext.broadcast((names, idf))
    arrays = ", ".join(f"`c_{k}` {packs.schema['c_' + k].dataType.simpleString()}" for k in keep)
    parts = ["at", "tf", "ends", "scale", "by_term", "by_tf", "terms", "term_counts"]
    schema = "n int, " + (arrays + ", " if keep else "") + ", ".join(f"`{p}` binary" for p in parts)

    def run(batches):
        names, idf = shared.value
        vocabulary = Vocabulary(names)
        for batch in batches:
            for i in range(batch.num_rows):
                p = TokenPack.of(batch, i)
                every = _counted(p, vocabulary, len(names))
                ends, at = np.cumsum(np.bincount(every[0], minlength=len(p.ends))), 0
                while at < len(ends):
                    before = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, before + PACK_TERMS, side="right")))
                    doc, place, tf = (x[before:int(ends[to - 1])] for x in every)
                    kept = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(batch.schema.get_field_index(f"c_{k}"))[i].values.slice(at, to - at)) for k in keep]
                    cells = [pa.array([c.tobytes()], pa.binary()) for c in _feature_cells(doc - at, place, tf, to - at, idf)]
                    yield pa.RecordBatch.from_arrays([pa.array([to - at], pa.int32()), *kept, *cells], ["n", *[f"c_{k}" for k in keep], *parts])
                    at = to

    return one_by_one(packs).mapInArrow(run, schema)


def _feature_cells(doc: np.ndarray, place: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(np.bincount(doc, minlength=n))
    norm = np.sqrt(np.bincount(doc, ((1 + np.log(tf)) * idf[place]) ** 2 if len(place) else None, minlength=n))
    least = _least_type(place, len(idf))
    order = np.argsort(least, kind="stable")
    first = _starts(least[order])
    counts = np.diff(np.r_[first, len(place)])
    tf = _least_type(tf, int(tf.max(initial=0)))
    return [least, tf, ends.astype(np.int64), np.divide(1.0, norm, out=np.zeros(n), where=norm > 0),
            _least_type(doc[order], n), tf[order], least[order][first], _least_type(counts, int(counts.max(initial=0)))]


class FeaturePack:
    """A row of ``feature_packs``: places, damped counts and ends of the terms by text, and texts and damped counts by term.

    ``scale`` is what makes the vector of a text, idf included, one of unit length.
    """

    _DAMPING = 1 + np.log(np.maximum(np.arange(1 << 16), 1))

    def __init__(self, row: dict):
        self.n = row["n"]
        self.ends = np.frombuffer(row["ends"], dtype=np.int64)
        many = int(self.ends[-1]) if self.n else 0
        self.at, self.damped = self._numbers(row["at"], many), self._damp(row["tf"], many)
        self.by_term, self.by_damped = self._numbers(row["by_term"], many), self._damp(row["by_tf"], many)
        self.scale = np.frombuffer(row["scale"], dtype=np.float64)
        self.terms = self._numbers(row["terms"], -(-len(row["terms"]) // (len(row["at"]) // many)) if many else 0)
        self.term_ends = np.cumsum(self._raw(row["term_counts"], len(self.terms)), dtype=np.int64)

    @staticmethod
    def _raw(data: bytes, many: int) -> np.ndarray:
        return np.frombuffer(data, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // many] if many else np.uint8)

    def _numbers(self, data: bytes, many: int) -> np.ndarray:
        return self._raw(data, many).astype(np.intp)

    def _damp(self, data: bytes, many: int) -> np.ndarray:
        tf = self._raw(data, many)
        return self._DAMPING[tf] if tf.itemsize < 4 else 1 + np.log(tf)


def class_term_counts(df: DataFrame, c: str, topic: str = "topic_id", ngrams=(1, 1), stop=(),
                      pattern: str = K.TOKEN) -> DataFrame:
    return long_terms(df, c, [topic], ngrams, pattern, stop)


def class_tfidf(df: DataFrame, c: str, topic: str = "topic_id", k: int | None = 10, ngrams=(1, 1), stop=(),
                pattern: str = K.TOKEN, min_df: int = 1, id_col: str = "task_id") -> DataFrame:
    """``(topic, rank, term, score)``: class-based TF-IDF.

    ``tf / words of the topic * ln(1 + A / f)`` with ``A`` the mean number of words
    per topic and ``f`` the frequency of the term over all topics.
    """
    if min_df > 1:
        per_doc = frequent_terms(df, c, [id_col, topic], min_df, ngrams, pattern, stop)
        kept = per_doc.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
        counts = (per_doc.join(kept, "term", "left_semi").groupBy(topic, "term").agg(F.sum("tf").alias("tf")))
    else:
        counts = class_term_counts(df, c, topic, ngrams, stop, pattern)
    counts = counts.persist()  # topics times vocabulary at most; read for sizes, frequencies and scores
    sizes = counts.groupBy(topic).agg(F.sum("tf").alias("words"))
    mean = sizes.agg(F.avg("words").alias("mean")).scalar()
    frequency = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    scored = (counts.join(frequency, "term").join(small_side(sizes), topic)
              .withColumn("score", F.col("tf") / F.col("words") * F.log1p(mean / F.col("f"))))
    if k is None:
        return scored.select(topic, "term", "score")
    # Rounded for the order, so that equal scores tie the same way everywhere.
    order = [F.desc(F.round("score", 9)), F.asc("term")]
    return top_per_group(scored, [topic], order, k).select(topic, "rank", "term", "score")


def pad_terms(terms: DataFrame, topics: DataFrame, topic: str = "topic_id", k: int = 10) -> DataFrame:
    """Every topic gets ``k`` ranks; missing ones are ``""`` with score 0."""
    ranks = topics.select(topic).distinct().select(topic, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return (ranks.join(terms, [topic, "rank"], "left")
            .select(topic, "rank", F.coalesce("term", F.lit("")).alias("term"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def joined_terms(terms: DataFrame, topic: str = "topic_id", k: int = 10, sep: str = ", ", name: str = "keywords") -> DataFrame:
    """The first ``k`` terms of each topic as one string."""
    first = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (terms.filter(F.col("rank") <= k).groupBy(topic).agg(first.alias("__t"))
            .select(topic, F.array_join(F.transform("__t", lambda t: t["term"]), sep).alias(name)))


def topic_label(terms: DataFrame, topic: str = "topic_id", k: int = 4, sep: str = "_") -> DataFrame:
    out = joined_terms(terms, topic, k, sep, "topic_label")
    return out.withColumn("topic_label", F.when(F.col(topic) == -1, "outlier").otherwise(F.col("topic_label")))


def label_top_words(df: DataFrame, c: str, label: str, k: int = 10, max_docs: int | None = None,
                    key: str = "task_id", stop=()) -> DataFrame:
    """``(label, rank, term, tf)``: most frequent words of each label, over all its texts or its first ``max_docs``."""
    if max_docs is not None:
        df = top_per_group(df, [label], [F.col(key)], max_docs, "__doc")
    counts = class_term_counts(df, c, label, (1, 1), stop)
    return top_per_group(counts, [label], [F.desc("tf"), F.asc("term")], k).select(label, "rank", "term", "tf")


def mmr_rerank(terms: DataFrame, vectors: DataFrame, topic: str = "topic_id", diversity: float = 0.3,
               k: int = 10) -> DataFrame:
    """Re-rank the (few) candidate terms of each topic by relevance against diversity.

    ``terms (topic, term, score)``, ``vectors (term, vector)``.  A topic's profile
    is the score-weighted mean of its candidates' vectors.
    """
    fields = f"`{topic}` {terms.schema[topic].dataType.simpleString()}, rank int, term string, score double"

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "term"], ascending=[False, True]).reset_index(drop=True)
        x = matrix(pdf["vector"])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        profile = (x * pdf["score"].to_numpy()[:, None]).sum(axis=0)
        relevance = x @ (profile / max(np.linalg.norm(profile), 1e-12))
        among = x @ x.T
        chosen = [int(np.argmax(relevance))]
        while len(chosen) < min(k, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in chosen]
            worth = [(1 - diversity) * relevance[i] - diversity * among[i, chosen].max() for i in rest]
            chosen.append(rest[int(np.argmax(worth))])
        out = pdf.iloc[chosen][[topic, "term", "score"]].copy()
        out.insert(1, "rank", range(1, len(out) + 1))
        return out

    return terms.join(vectors, "term").groupBy(topic).applyInPandas(rerank, fields)


def hashed_vectors(df: DataFrame, c: str, id_col: str = "task_id", out: str = "embedding", dims: int = 256) -> DataFrame:
    """Signed hashing of words and word pairs, ``1 + ln tf`` per slot, unit length; native expressions only.

    A gram is counted in one of ``2 * dims`` slots; the second half is the negative side of the first.
    """
    listed = df.select(id_col, tokens(F.coalesce(F.col(c), F.lit("")), r"[\p{L}\p{N}]+").alias("__w")).select(id_col, grams(F.col("__w")).alias("__g"))
    counted = MF.HashingTF(numFeatures=2 * dims, inputCol="__g", outputCol="__v").transform(listed)
    damped = F.transform(vector_to_array("__v"), lambda n: F.when(n > 0, F.log(n) + 1).otherwise(0.0))
    signed = counted.select(id_col, damped.alias("__d")).select(id_col, F.zip_with(
        F.slice("__d", 1, dims), F.slice("__d", dims + 1, dims), lambda plus, minus: plus - minus).alias("__s"))
    unit = MF.Normalizer(inputCol="__s", outputCol="__u", p=2.0).transform(signed.withColumn("__s", array_to_vector("__s")))
    return unit.select(id_col, vector_to_array("__u").cast("array<float>").alias(out))


def embed_texts(df: DataFrame, c: str, make_encoder=None, id_col: str = "task_id", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``(id, vector)`` of unit length: hashed words, or the answers of an encoder.

    ``make_encoder()`` is called once per task and returns a function from a list
    of texts to a matrix; pass a sentence model's loader to use that.
    """
    if make_encoder is None:
        return hashed_vectors(df, c, id_col, out)
    fields = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{out}` array<float>"

    def run(batches):
        encode = make_encoder()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                x = np.asarray(encode(part[c].fillna("").tolist()), dtype=np.float64)
                norms = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), out: list(x.astype(np.float32))})

    return df.select(id_col, c).mapInPandas(run, fields)


def reduce_dims(df: DataFrame, k: int = 5, vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Principal components of unit vectors; only a d x d matrix leaves the tasks."""
    with_vector = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    unit = MF.Normalizer(inputCol="__v", outputCol="__u", p=2.0).transform(with_vector)
    model = MF.PCA(k=k, inputCol="__u", outputCol="__p").fit(unit)
    return model.transform(unit).withColumn(out, vector_to_array("__p")).drop("__v", "__u", "__p")
