"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

A text gets one leading space, and spaces become U+2581. Byte-pair encoding merges, again and
again, the adjacent pair whose joined piece has the best score (the leftmost of equals). Where
no piece holds two neighbouring characters side by side nothing is ever merged, so texts fall
into words there, and every distinct new word is encoded once.

The words of a batch are one flat numpy array of symbols with the bounds of each word. A round
looks up the rank of every adjacent pair, takes the minimum per word by a segmented reduction,
and merges every word's leftmost pair of that rank; the array is then compacted, and words in
which no pair remains leave it. A word merges all its non-overlapping pairs of the least rank in
one round, or those up to the first that makes another pair as good as the rank. Characters beyond the vocabulary become byte
pieces.

Defined cases: a null text is the empty text, which has no ids; repeated rows are encoded each;
an empty table gives no rows; other columns pass through; texts are encoded whole. ``decode``
takes any ids: bytes that are not UTF-8 become U+FFFD each, control ids nothing.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from citescope.llm.batches import chunks, in_arrow, worker_store

SPACE = "▁"
NONE = np.int64(1 << 40)  # rank of a pair that is no piece
LOW = 0x250               # code points below it have a table of pairs
MEMO_WORDS = 250_000      # of each of the two generations kept by a worker
UNKNOWN = " ⁇ ".encode()  # what the unknown id decodes to


def _replace_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Pieces:
    """The vocabulary of a model file of kind BPE with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        codecs.register_error("citescope_each_byte", _replace_bytes)
        sp = SentencePieceProcessor(model_file=path)
        if sp.normalize(" aÅ  \tb") != f"{SPACE * 2}aÅ{SPACE * 2}\tb":
            raise ValueError("the model's text normalisation is not the plain one")
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(map(sp.is_unused, own)):
            raise ValueError("the model has unused pieces")
        self.size = n
        self.id_of = {text[i]: i for i in own}
        score = np.array([sp.get_score(i) for i in range(n)])
        # Equal scores share a rank; the best score has rank 0.
        self.rank_of = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        bytes_of = {}
        for i in range(n):
            if sp.is_byte(i):
                bytes_of[int(text[i][1:-1], 16)] = i
        self.byte_ids = np.array([bytes_of[b] for b in range(256)], np.int64)
        self.plain = [UNKNOWN if sp.is_unknown(i) else b"" if sp.is_control(i)
                      else bytes([int(text[i][1:-1], 16)]) if sp.is_byte(i)
                      else text[i].replace(SPACE, " ").encode() for i in range(n)]
        # A symbol is a piece's id, or for a character that is none, n + its code point.
        self.width = n + 0x110000
        pair = {}
        for x in self.id_of:
            for cut in range(1, len(x)):
                a, b = self._symbol(x[:cut]), self._symbol(x[cut:])
                if a is not None and b is not None:
                    pair[a * self.width + b] = self.id_of[x]
        self.pair, self.ranks = pair, self.rank_of.tolist()
        self.control = np.array([not x for x in self.plain])
        self.spaced = np.array([x.startswith(SPACE) for x in text])
        self.keys = np.array(sorted(pair), np.int64)
        self.merged = np.array([pair[k] for k in self.keys.tolist()], np.int64)
        letters = sorted((ord(x), i) for x, i in self.id_of.items() if len(x) == 1)
        self.letters, self.letter_ids = np.array(letters, np.int64).T
        # Two neighbouring characters that no piece holds are never merged: texts are cut there.
        inner = sorted({ord(x[i]) * 0x110000 + ord(x[i + 1])
                        for x in self.id_of for i in range(len(x) - 1)})
        self.inner = np.array(inner, np.int64)
        low = self.inner[(self.inner // 0x110000 < LOW) & (self.inner % 0x110000 < LOW)]
        self.low = np.zeros(LOW * LOW, bool)  # the same as a table for frequent characters
        self.low[low // 0x110000 * LOW + low % 0x110000] = True
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def _symbol(self, x: str) -> int | None:
        return self.id_of.get(x, self.size + ord(x) if len(x) == 1 else None)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of pairs of symbols (``NONE`` and no use where there is none)."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.merged[at]
        return np.where(self.keys[at] == key, self.rank_of[piece], NONE), piece

    def _from_left(self, symbols: list[int], rank: int) -> list[int]:
        """Merge pairs of ``rank``, the least in the word, from the left for as long as no
        better pair, and no equal one further left, comes up."""

        def found(a: int, b: int) -> tuple[int, int]:
            piece = self.pair.get(a * self.width + b)
            return (self.ranks[piece], piece) if piece is not None else (int(NONE), 0)

        done: list[int] = []
        for at, x in enumerate(symbols):
            if done:
                r, piece = found(done[-1], x)
                if r == rank:
                    done[-1] = piece
                    before = found(done[-2], piece)[0] if len(done) > 1 else NONE
                    after = found(piece, symbols[at + 1])[0] if at + 1 < len(symbols) else NONE
                    if before <= rank or after < rank:
                        return done + symbols[at + 1:]
                    continue
            done.append(x)
        return done

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of words given as one flat array, and their bounds."""
        n_words = len(bounds) - 1
        final: list[np.ndarray] = []
        final_word: list[np.ndarray] = []
        word = np.repeat(np.arange(n_words), np.diff(bounds))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), NONE)  # of the pair of a symbol with the next
            piece = np.zeros(len(symbols), np.int64)
            rank[:-1], piece[:-1] = self._lookup(symbols[:-1], symbols[1:])
            rank[first[1:] - 1] = NONE
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            least_here = np.repeat(least, size)
            live = least_here < NONE
            if not live.all():  # words in which no pair remains leave
                final.append(symbols[~live])
                final_word.append(word[~live])
                symbols, word, rank, piece = symbols[live], word[live], rank[live], piece[live]
                least_here = least_here[live]
                if not len(symbols):
                    break
            best = rank == least_here
            # Of pairs that overlap in a row, the first, third, ... are taken.
            row_start = best & ~np.r_[False, best[:-1]]
            at = np.arange(len(symbols))
            since = at - np.maximum.accumulate(np.where(row_start, at, 0))
            taken = np.flatnonzero(best & (since % 2 == 0))
            several = np.bincount(word[taken], minlength=n_words) > 1
            if several.any():
                taken, symbols, word = self._settle(taken, several, symbols, word, rank, piece)
                if taken is None:
                    continue
            symbols = symbols.copy()
            symbols[taken] = piece[taken]
            kept = np.ones(len(symbols), bool)
            kept[taken + 1] = False
            symbols, word = symbols[kept], word[kept]
        if not final:
            return symbols, np.zeros(n_words + 1, np.int64)
        symbols, word = np.concatenate(final), np.concatenate(final_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(n_words + 1))

    def _settle(self, taken, several, symbols, word, rank, piece):
        """Words with several pairs of the least rank: a word merges them up to the first that
        makes a pair as good as the rank, which the next round sees. Where that is an equal pair
        to the right (runs of one character), the word merges from the left by itself."""
        end = len(symbols)
        new = piece[taken]
        left = np.maximum(taken - 1, 0)
        has_left = (taken > 0) & (word[left] == word[taken])
        right = np.minimum(taken + 2, end - 1)
        has_right = (taken + 2 < end) & (word[right] == word[taken])
        joined = np.full(end, -1)
        joined[taken] = new
        two = joined[np.maximum(taken - 2, 0)]  # of a pair right before, merged first
        before = np.where((two >= 0) & (taken > 1) & has_left, two, symbols[left])
        limit = rank[taken]
        before = np.where(has_left, self._lookup(before, new)[0], NONE)
        after = np.where(has_right, self._lookup(new, symbols[right])[0], NONE)
        close = (before <= limit) | (after <= limit)
        if not close.any():
            return taken, symbols, word
        first = np.full(len(several), end)  # place of a word's first such pair
        np.minimum.at(first, word[taken[close]], taken[close])
        grows = np.zeros(len(several), bool)
        growing = close & (taken == first[word[taken]]) & (after == limit) & (before > limit)
        grows[word[taken[growing]]] = True
        grows &= several
        plain = taken[(taken <= first[word[taken]]) & ~grows[word[taken]]]
        if not grows.any():
            return plain, symbols, word
        symbols = symbols.copy()
        symbols[plain] = piece[plain]
        kept = ~grows[word]
        kept[plain + 1] = False
        parts, owners = [symbols[kept]], [word[kept]]
        for w in np.flatnonzero(grows):
            a, b = np.searchsorted(word, [w, w + 1])
            step = self._from_left(symbols[a:b].tolist(), int(rank[a:b].min()))
            parts.append(np.array(step, np.int64))
            owners.append(np.full(len(step), w))
        symbols, word = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        return None, symbols[order], word[order]

    def learn(self, words: list[bytes]) -> None:
        """Encode new words: ids as 32-bit integers, and as decimals with a comma behind each."""
        text = [w.decode() for w in words]
        code = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        symbols = np.where(self.letters[at] == code, self.letter_ids[at], self.size + code)
        symbols, bounds = self.merge(symbols, np.cumsum([0, *map(len, text)]))
        beyond = symbols >= self.size
        if beyond.any():  # characters that are no piece: their bytes
            spelled = [chr(c).encode() for c in (symbols[beyond] - self.size).tolist()]
            times = np.ones(len(symbols), np.int64)
            times[beyond] = list(map(len, spelled))
            whole = np.repeat(symbols, times)
            whole[np.repeat(beyond, times)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            bounds = np.r_[0, np.cumsum(times)][bounds]
            symbols = whole
        data = symbols.astype("<u4").tobytes()
        digits = list(map("%d,".__mod__, symbols.tolist()))
        for w, a, b in zip(words, bounds.tolist(), bounds[1:].tolist()):
            self.memo[w] = data[4 * a:4 * b], "".join(digits[a:b]).encode()

    def cut(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts of a column, coded, and the bounds of each text's words."""
        text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), " ", SPACE)
        some = pc.greater(pc.binary_length(text), 0)
        before = pc.if_else(some, SPACE, "").cast(pa.large_string())
        text = pc.binary_join_element_wise(before, text, pa.scalar("", pa.large_string()))
        ends = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))]
        data = b"".join(text.cast(pa.large_binary()).to_pylist())
        code = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # of characters
        left, right = code[:-1], code[1:]
        low = (left < LOW) & (right < LOW)
        held = np.zeros(max(0, len(code) - 1), bool)
        held[low] = self.low[left[low] * LOW + right[low]]
        pair = left[~low] * 0x110000 + right[~low]
        at = np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)
        held[~low] = self.inner[at] == pair
        starts = np.union1d(place[1:][~held], ends[:-1][np.diff(ends) > 0])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64).tobytes()),
            pa.py_buffer(data)])
        return words.dictionary_encode(), np.searchsorted(starts, ends)

    def encode(self, column: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text as little-endian 32-bit integers, and as decimals."""
        words, bounds = self.cut(column)
        vocabulary = words.dictionary.to_pylist()
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        new = []
        for w in vocabulary:
            if w not in self.memo:
                if w in self.older:
                    self.memo[w] = self.older[w]
                else:
                    new.append(w)
        if new:
            self.learn(new)
        found = [self.memo[w] for w in vocabulary]
        ids = _sliced(pa.array([x for x, _ in found], pa.large_binary()), words.indices, bounds)
        decimals = _sliced(pa.array([x for _, x in found], pa.large_binary()), words.indices, bounds)
        return ids, [x[:-1] for x in decimals]

    def decode(self, ids: pa.Array) -> list[str]:
        """The texts of a column of ids as little-endian 32-bit integers."""
        rows = [x or b"" for x in ids.to_pylist()]
        flat = np.frombuffer(b"".join(rows), "<u4")
        bounds = np.cumsum([0, *(len(x) // 4 for x in rows)])
        table = pa.array(self.plain, pa.large_binary())
        # Control ids say nothing, but bytes on either side of one make no character together.
        control = self.control[flat]
        cuts = np.union1d(bounds, np.flatnonzero(control))
        spelled = [x.decode("utf-8", "citescope_each_byte")
                   for x in _sliced(table, pa.array(flat), cuts)]
        said = np.r_[np.flatnonzero(~control), len(flat)]
        first = said[np.searchsorted(said, bounds[:-1])]
        part = np.searchsorted(cuts, bounds).tolist()
        out = []
        for at, end, a, b in zip(first.tolist(), bounds[1:].tolist(), part, part[1:]):
            text = "".join(spelled[a:b])
            # The space that was put before the text goes.
            out.append(text[1:] if at < end and self.spaced[flat[at]] else text)
        return out


def _sliced(table: pa.Array, indices: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """Entries of ``table`` at ``indices``, joined between bounds."""
    taken = table.take(indices)
    ends = np.zeros(len(taken) + 1, np.int64)
    np.cumsum(pc.binary_length(taken).to_numpy(), out=ends[1:])
    data = taken.buffers()[2]
    whole = data.to_pybytes() if data else b""
    cuts = ends[bounds].tolist()
    return list(map(whole.__getitem__, map(slice, cuts, cuts[1:])))


def pieces(path: str) -> Pieces:
    """The worker's vocabulary of a model file, kept from task to task."""
    store, key = worker_store(), f"tokens pieces {path}"
    if key not in store:
        store[key] = Pieces(path)
    return store[key]


def _with(df: DataFrame, source: str, fields: list[StructField], function) -> DataFrame:
    """``df`` with columns that ``function`` makes of its column ``source``."""
    schema = StructType([f for f in df.schema.fields if f.name not in {x.name for x in fields}]
                        + fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, source, tokens=True):
            held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            held.update(zip([f.name for f in fields], function(held[source])))
            yield pa.RecordBatch.from_arrays([held[f.name] for f in schema.fields],
                                             [f.name for f in schema.fields])

    return df.transform(in_arrow, work, schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``ids`` (little-endian 32-bit integers) and ``decimals`` (the ids in
    decimals, joined by commas) of their ``text``."""

    def ids_of(column: pa.Array) -> list[pa.Array]:
        ids, decimals = pieces(model).encode(column)
        return [pa.array(ids, pa.binary()), pa.array(decimals, pa.binary())]

    return _with(docs.withColumn("text", F.col("text").cast("string")), "text",
                 [StructField("ids", BinaryType()), StructField("decimals", BinaryType())], ids_of)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``decoded``, the UTF-8 bytes of the text of their ``ids``."""

    def text_of(column: pa.Array) -> list[pa.Array]:
        return [pa.array([x.encode() for x in pieces(model).decode(column)], pa.binary())]

    return _with(rows, "ids", [StructField("decoded", BinaryType())], text_of)
