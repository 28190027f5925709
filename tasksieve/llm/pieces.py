"""SentencePiece BPE encoding and decoding in numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words with more symbols go through a heap, as a round handles every symbol of a word again.
LONG_WORD = 512
#: Bytes of encoded words that a process keeps in each of two stores; when the newer one is full it becomes the older one.
KEPT_BYTES = 12 << 20
#: What a kept word takes beside its characters, ids and bytes.
WORD_BYTES = 300
#: Texts, and about so many of their characters, whose results are held at once.
ROWS, ROW_CHARS = 500, 1 << 20
NONE = np.int32(2**31 - 1)


class PieceModel:
    """The vocabulary of a BPE model with byte fallback, as arrays for merge rounds."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "unused": 5, "byte": 6}
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (kinds["user"], kinds["unused"]) for p in model.pieces)):
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no text normalisation is expected")
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds["normal"]}
        self.bytes = np.array([self.ids_of_type(model, kinds["byte"]).get(b, -1) for b in range(256)], np.int32)
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds["control"]}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds["unknown"]}
        self.surface = model.trainer_spec.unk_surface
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        scores = np.array([p.score for p in model.pieces], np.float64)
        order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank
        # every way of writing a piece as two symbols: a symbol is a piece or a single character
        symbols = dict(self.ids)
        for piece in self.ids:
            for c in piece:
                symbols.setdefault(c, len(self.texts) + len(symbols))
        self.symbols = {c: i for c, i in symbols.items() if len(c) == 1}
        pairs: dict[tuple[int, int], int] = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[at], np.fromiter(pairs.values(), np.int32, len(pairs))[at]
        self.pair_rank = order[self.pair_piece]
        self.rank = {int(p): int(r) for p, r in zip(self.pair_piece, self.pair_rank)}
        self.pairs = pairs
        # a merge whose result may itself merge at once, before or together with others of its rank, is done one by one
        first = {}
        for (a, b), i in pairs.items():
            for part in (a, b):
                first[part] = min(first.get(part, NONE), self.rank[i])
        shared = np.bincount(self.pair_rank[np.unique(self.pair_piece, return_index=True)[1]], minlength=order.max() + 1)
        self.single = np.array([first.get(int(p), NONE) <= r or shared[r] > 1 for p, r in zip(self.pair_piece, self.pair_rank)])
        # words may be cut where no piece has these two characters side by side
        self.whole = any(x != SPACE and y == SPACE for piece in self.ids for x, y in zip(piece, piece[1:]))
        self.alone = "\n" not in {c for piece in self.ids if len(piece) > 1 for c in piece}
        self.words = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.word_end = re.compile(f"[^{SPACE}]{SPACE}")
        self.numbers = [str(i) for i in range(len(self.texts))]
        self.surfaces = [bytes([self.byte_of[i]]) if i in self.byte_of else self.surface.encode() if i in self.unknown
                         else b"" if i in self.control else p.replace(SPACE, " ").encode() for i, p in enumerate(self.texts)]
        self.store: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    @staticmethod
    def ids_of_type(model, kind: int) -> dict[int, int]:
        return {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind}

    # ------------------------------------------------------------- merging

    def _start(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in one flat array (negative for characters that no piece has), and the word of each."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        chars, inverse = np.unique(flat, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), -1 - int(c)) for c in chars], np.int64)
        return known[inverse], word

    def merged(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word of each.

        Each round looks up the rank of every adjacent pair, takes the least of each word (a segmented
        minimum), merges its occurrences from left to right in all words at once, and compacts the
        arrays; words without a pair left drop out.
        """
        symbol, word = self._start(words)
        done_symbol, done_word = [], []
        pair, rank = np.full(len(symbol), -1, np.int64), np.full(len(symbol), NONE, np.int32)
        self._look_up(np.arange(len(symbol)), symbol, word, pair, rank)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
            open_ = least != NONE
            if not open_.all():
                done_symbol.append(symbol[~open_])
                done_word.append(word[~open_])
                symbol, word, pair, rank, least = symbol[open_], word[open_], pair[open_], rank[open_], least[open_]
                if not len(symbol):
                    break
            # of a run of overlapping occurrences every second one merges, beginning with the first
            at = np.flatnonzero(rank == least)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            chosen = at[place % 2 == 0]
            first = np.r_[True, word[chosen][1:] != word[chosen][:-1]]
            chosen = chosen[first | ~self._leads_single(chosen[first], np.flatnonzero(first), len(chosen), pair)]
            symbol[chosen] = self.pair_piece[pair[chosen]]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            now = chosen - np.arange(len(chosen))  # every merge before takes one symbol away
            symbol, word, pair, rank = symbol[keep], word[keep], pair[keep], rank[keep]
            self._look_up(np.r_[now, now[now > 0] - 1], symbol, word, pair, rank)
        if not done_symbol:
            return symbol, word
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def _look_up(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, pair: np.ndarray, rank: np.ndarray) -> None:
        """Set pair and rank of the symbols at ``at`` with their right neighbours."""
        pair[at], rank[at] = -1, NONE
        at = at[at < len(symbol) - 1]
        at = at[(word[at] == word[at + 1]) & (symbol[at] >= 0) & (symbol[at + 1] >= 0)]
        keys = symbol[at] << 32 | symbol[at + 1]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[found] == keys
        pair[at[hit]], rank[at[hit]] = found[hit], self.pair_rank[found[hit]]

    def _leads_single(self, leaders: np.ndarray, starts: np.ndarray, n: int, pair: np.ndarray) -> np.ndarray:
        """For each chosen pair, whether the first chosen pair of its word is one that merges alone."""
        return np.repeat(self.single[pair[leaders]], np.diff(np.r_[starts, n]))

    def _long(self, text: str) -> list[int]:
        """Symbols of one long word, merged through a heap."""
        symbol = [self.symbols.get(c, -1 - ord(c)) for c in text]
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p], i, p, symbol[i], symbol[i + 1]) for i in range(n - 1) if (p := self.pairs.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, piece, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j] = piece, 1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (p := self.pairs.get((symbol[x], symbol[y]))) is not None:
                    heapq.heappush(heap, (self.rank[p], x, p, symbol[x], symbol[y]))
        return [s for i, s in enumerate(symbol) if not gone[i]]

    def _ids(self, symbols) -> list[int]:
        """Piece ids; a character outside the vocabulary becomes its bytes."""
        out = []
        for s in symbols:
            if 0 <= s < len(self.texts):
                out.append(int(s))
            else:
                char = chr(-1 - s) if s < 0 else next(c for c, i in self.symbols.items() if i == s)
                out += [int(self.bytes[b]) for b in char.encode("utf-8", "surrogatepass")]
        return out

    # ------------------------------------------------------------ interface

    def prepared(self, text: str) -> str:
        """A text with its dummy prefix and spaces as they are in pieces."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def slices(self, text: str, size: int) -> Iterator[str]:
        """A prepared text cut before spaces that end a word, every ``size`` characters or later."""
        start = 0
        while start < len(text):
            cut = self.word_end.search(text, start + size) if not self.whole and start + size < len(text) else None
            end = cut.end() - 1 if cut else len(text)
            yield text[start:end]
            start = end

    def split(self, text: str) -> list[str]:
        """A prepared text in words that no piece crosses."""
        return [text] if self.whole and text else self.words.findall(text)

    def learn(self, words: set[str]) -> None:
        """Have all the words in the store: (number of ids, ids as text, decoded bytes).

        A full store becomes the older one, from which words that come up again are taken over; the rest
        is forgotten when the next one is full.
        """
        if self.held > KEPT_BYTES:
            self.store, self.older, self.held = {}, self.store, 0
        fresh = set()
        for w in words:
            if w not in self.store:
                kept = self.older.get(w)
                if kept is None:
                    fresh.add(w)
                else:
                    self._put(w, kept)
        short = [w for w in fresh if len(w) <= LONG_WORD]
        symbol, word = self.merged(short)
        ends = np.searchsorted(word, np.arange(len(short) + 1)).tolist()
        plain = symbol.tolist() if len(symbol) == 0 or symbol.min() >= 0 and symbol.max() < len(self.texts) else None
        whole = plain or symbol.tolist()
        for k, w in enumerate(short):
            ids = whole[ends[k]: ends[k + 1]]
            self._keep(w, ids if plain else self._ids(ids))
        for w in fresh:
            if len(w) > LONG_WORD:
                self._keep(w, self._ids(self._long(w)))

    def _keep(self, word: str, ids: list[int]) -> None:
        self._put(word, (len(ids), " ".join([self.numbers[i] for i in ids]), b"".join([self.surfaces[i] for i in ids])))

    def _put(self, word: str, kept: tuple[int, str, bytes]) -> None:
        self.store[word] = kept
        self.held += WORD_BYTES + 4 * len(word) + len(kept[1]) + len(kept[2])

    def encode(self, text: str) -> list[int]:
        words = self.split(self.prepared(text))
        self.learn(set(words))
        return [int(i) for w in words for i in self.store[w][1].split()] + [self.end]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: what the pieces stand for, without the space that begins the first piece."""
        raw = b"".join([self.surfaces[i] for i in ids]).decode("utf-8", "replace")
        begun = next((i for i in ids if i not in self.control), None)
        return raw[1:] if begun is not None and begun not in self.byte_of and raw.startswith(" ") else raw

    def digests(self, texts: Sequence[str], group: int = 1 << 20, ids_of: list[list[np.ndarray]] | None = None) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text) of each text.

        Texts are handled in slices, and about ``group`` characters at a time, so that long texts
        take no more memory than short ones.  ``ids_of`` (an empty list for each text) gets the ids.
        """
        count, ids = [0] * len(texts), [hashlib.sha256() for _ in texts]
        decoded = [hashlib.sha256() for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def flush():
            self.learn(set().union(*[words for _, words in waiting]))
            for k, words in waiting:
                numbers, texts_of_ids, raws = zip(*map(self.store.__getitem__, words))
                raw = b"".join(raws)
                if not count[k] and raw.startswith(b" ") and int(texts_of_ids[0].split(" ", 1)[0]) not in self.byte_of:
                    raw = raw[1:]
                count[k] += sum(numbers)
                line = " ".join(texts_of_ids)
                ids[k].update((line + " ").encode())
                if ids_of is not None:
                    ids_of[k].append(np.fromstring(line, np.int32, sep=" "))
                decoded[k].update(raw.decode("utf-8", "replace").encode())
            waiting.clear()

        held = 0
        for k, text in enumerate(texts):
            for part in self.slices(self.prepared(text), group):
                waiting.append((k, self.split(part)))
                held += len(part)
                if held >= group:
                    flush()
                    held = 0
        flush()
        for digest in ids:
            digest.update(str(self.end).encode())
        return [(n + 1, a.hexdigest(), b.hexdigest()) for n, a, b in zip(count, ids, decoded)]


def _shared(docs: DataFrame, model: str):
    """The vocabulary, read once and sent to every worker process (a few MB, whatever the data), as plain values."""
    return docs.sparkSession.sparkContext.broadcast({"state": vars(PieceModel(model))})


def _model(held: dict) -> PieceModel:
    """The model of a broadcast, made once a process."""
    if "model" not in held:
        held["model"] = PieceModel.__new__(PieceModel)
        vars(held["model"]).update(held["state"])
    return held["model"]


def _slices(batch: pa.RecordBatch, text: int):
    """A batch in slices of up to ``ROWS`` rows and about ``ROW_CHARS`` bytes of text."""
    sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()], np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(np.cumsum(sizes[at:at + ROWS]), ROW_CHARS)) + 1
        yield batch.slice(at, min(fits, ROWS))
        at += min(fits, ROWS)


def encode_documents(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` if asked for.

    Every whole text is encoded with an end id and decoded again.  Null and empty texts have the end
    id only.  ``model`` is the path of the vocabulary file on the driver.  Columns other than id and
    text are not looked at; an empty table gives an empty result.
    """
    shared = _shared(docs, model)

    def run(batches):
        pieces = _model(shared.value)
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lists = [[] for _ in texts] if ids else None
            got = pieces.digests(texts, ids_of=lists)
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                end = np.array([pieces.end], np.int32)
                columns.append(pa.array([np.concatenate([*parts, end]) for parts in lists], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def token_ids(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``ids`` (array of int), ``decoded``."""
    shared = _shared(docs, model)

    def run(batches):
        pieces = _model(shared.value)
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            ids = [pieces.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([pieces.decode(x) for x in ids], pa.string())],
                                             names=["key", "ids", "decoded"])

    rows = docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")
