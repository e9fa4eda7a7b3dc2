"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A tokenizer file gives the merge list, the special tokens and how texts are normalized and cut into
words; encoding gives the ids that the ``tokenizers`` library gives without special tokens added, decoding
its text with none left out.

*Lookahead.* What follows a place of a word can change tokens before it only step by step: a merge of
``u`` and ``x`` moves the first doubtful place back by the length of ``u``, and a later merge of ``v`` and
``y`` moves it on if ``y`` begins with ``u``. The heaviest chain of such merges is the list's sufficient
lookahead. A word is read into a window; tokens that end that far before the window's last symbol are
stable and are put out at once, so a word of any length takes the same memory. Leaving stable tokens
out of the window changes nothing, because a run of a word's tokens is what its own text gives.

Decoding feeds the bytes of one block of ids after the other to a state machine that holds back an
unfinished UTF-8 sequence.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from winnow.llm import words as W
from winnow.llm.shipping import ship

_CACHED = 1 << 18  # pieces whose ids a worker keeps
_TOGETHER = 200  # pieces normalized in one call
_SHORT = 64  # symbols up to which pairs are looked through one by one
_LETTERS = 1 << 18  # of words that are merged side by side
_RUN_BYTES = 2_000_000
_CACHED_CHARS = 64
_SLICE_CHARS = 1 << 20
_BLOCK_IDS = 1 << 16
_BATCH_IDS = 1 << 22
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ONLY_PYTHON_SPLITS = re.compile("[\x1c-\x1f]")
_tokenizers: dict[str, Codec] = {}


def encode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None
) -> DataFrame:
    """The table, or its columns ``keep``, with token ids of each whole text; null and empty texts have none.

    With ``decoded`` a column of that name has what :func:`decode` makes of the ids, in the same pass.

    ``path`` is a tokenizer file that the driver can read: a BPE model whose pre-tokenizer drops white
    space. Other files raise ``ValueError``. An input column named ``ids`` is replaced. Texts are
    read in slices cut at white space, so only a piece without any is held as a whole beside its row. Bytes that are not
    UTF-8 are read as U+FFFD.
    """
    codec = _broadcast(docs, path)
    if not Codec.of(codec.value).drops_space:
        raise ValueError("the pre-tokenizer keeps white space")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    fields = [*docs.select(kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([*fields, T.StructField(decoded, T.StringType())] if decoded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec.of(codec.value)
        for batch in batches:
            *others, texts = batch.columns
            for low, part in W.runs(texts, _RUN_BYTES):
                lists = own.encode_all([(b or b"").decode("utf-8", "replace") for b in part.cast(pa.large_binary()).to_pylist()])
                columns = [*[c.slice(low, len(part)) for c in others], _lists(lists)]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The table with a column of the text that each list of ids stands for.

    As the library's ``decode(ids, skip_special_tokens=False)``: the tokens joined by one space where
    the file names no decoder, else (byte-level decoder) the bytes they stand for as UTF-8, broken sequences
    replaced. Unknown and null ids stand for nothing; a null list gives an empty text. An input column
    named ``decoded`` is replaced.
    """
    codec = _broadcast(tokens, path)
    tokens = tokens.drop(text)
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch], at: int = tokens.columns.index(ids)) -> Iterator[pa.RecordBatch]:
        own = Codec.of(codec.value)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + _BATCH_IDS, side="right")) - 1)
                texts = [own.decode(row.values.to_numpy(zero_copy_only=False) if row.is_valid else ()) for row in lists[low:high]]
                columns = [*batch.slice(low, high - low).columns, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                low = high

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every text encoded and decoded again."""
    back = encode(docs, path, text, keep=[key], decoded="decoded")
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _broadcast(docs: DataFrame, path: str):
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        content = file.read()
    Codec.of(content)  # refuses what is not supported before any task does
    return docs.sparkSession.sparkContext.broadcast(content)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


class Merges:
    """A merge list over byte symbols: ranks of pairs, and the lookahead that suffices."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.end = end
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        made, reach, self.lookahead = set(), {}, 0
        for left, right in merges:
            if left + right in made:
                raise ValueError(f"two merges make {left + right!r}")
            made.add(left + right)
            self.rank[vocab[left], vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
            bare = self._bare(right)
            far = len(self._bare(left)) + max(reach.get(bare[:i], 0) for i in range(1, len(bare) + 1))
            reach[left] = max(reach.get(left, 0), far)
            self.lookahead = max(self.lookahead, far)
        self.longest = max((len(self._bare(token)) for token in vocab), default=1)

    def _bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) else token

    def apply(self, symbols: list[int]) -> list[int]:
        """Merge neighbours, least rank first and leftmost among equals, until none can be."""
        return self._apply_short(symbols) if len(symbols) <= _SHORT else self._apply_long(symbols)

    def _apply_short(self, symbols: list[int]) -> list[int]:
        rank, made, none = self.rank.get, self.made, len(self.made)
        token = list(symbols)
        ranks = [rank(pair, none) for pair in zip(token, token[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            token[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((token[i - 1], token[i]), none)
            if i < len(ranks):
                ranks[i] = rank((token[i], token[i + 1]), none)
        return token

    def _apply_long(self, symbols: list[int]) -> list[int]:
        token, after = list(symbols), list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := self.rank.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if token[i] >= 0 else len(token)
            if j >= len(token) or self.rank.get((token[i], token[j])) != rank:
                continue
            token[i], token[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(token):
                    new = self.rank.get((token[left], token[right]))
                    if new is not None:
                        heapq.heappush(queue, (new, left))
        return [t for t in token if t >= 0]


class Table:
    """A merge list as arrays: the words of a table are merged side by side, one pair of each at a time."""

    def __init__(self, merges: Merges, inner: dict[str, int], last: dict[str, int]):
        self.made = np.array(merges.made, np.int32)
        self.none = len(self.made)
        self.inner, self.last = (_by_letter(letters) for letters in (inner, last))
        pairs = np.array(list(merges.rank), np.int64).reshape(-1, 2)
        keys, ranks = (pairs[:, 0] << 32) + pairs[:, 1], np.array(list(merges.rank.values()), np.int32)
        self.shift = np.uint64(61 - max(1, len(keys)).bit_length())  # an eighth of the slots are taken at most
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, self.none, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # those that find their slot taken go on to the next
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            placed = left[free][first]
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; ``none`` where they do not merge or the right one is missing."""
        keys = (left.astype(np.int64) << 32) + right
        slot = self._slot(keys)
        found, out = self.keys[slot], self.ranks[slot]
        out[found != keys] = self.none
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        out[right < 0] = self.none
        return out

    def apply(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, least rank first and leftmost among equals, and how many each has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max(initial=0))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        column = np.arange(width)
        inside = column < length[:, None]
        token = np.full((len(words), width + 1), -1, np.int32)
        token[:, :width][inside] = self.inner[letters]
        rows = np.arange(len(words))
        token[rows, length - 1] = self.last[letters[np.cumsum(length) - 1]]
        rank = np.full((len(words), width), self.none, np.int32)
        rank[inside] = self._rank(token[:, :width][inside], token[:, 1:][inside])
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (len(words), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (len(words), 1))
        while len(rows):
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            rows, at, best = rows[best < self.none], at[best < self.none], best[best < self.none]
            gone = after[rows, at]
            behind = np.minimum(after[rows, gone], width)
            token[rows, at], token[rows, gone] = self.made[best], -1
            rank[rows, gone] = self.none
            after[rows, at] = behind
            before[rows, np.minimum(behind, width - 1)] = at
            rank[rows, at] = self._rank(token[rows, at], token[rows, behind])
            ahead = before[rows, at]
            some = ahead >= 0
            rank[rows[some], ahead[some]] = self._rank(token[rows[some], ahead[some]], token[rows[some], at[some]])
        return token[token >= 0], (token >= 0).sum(axis=1)


def _by_letter(letters: dict[str, int]) -> np.ndarray:
    out = np.full(max(map(ord, letters), default=0) + 1, -1, np.int32)
    out[[ord(c) for c in letters]] = list(letters.values())
    return out


class Transducer:
    """Reads a word symbol by symbol and puts out tokens once nothing that follows can change them."""

    def __init__(self, merges: Merges, inner: dict[str, int], last: dict[str, int], size: dict[int, int], window: int | None = None):
        self.merges, self.inner, self.last, self.size = merges, inner, last, size
        self.window = max(window or 0, 4 * merges.lookahead + merges.longest + 1)

    def word(self, symbols: str) -> Iterable[int]:
        """The tokens of a word, as they become stable; all at once where the window holds the word."""
        if len(symbols) <= self.window:
            return self._end(symbols)
        return self._stream(symbols)

    def _end(self, held: str) -> list[int]:
        return self.merges.apply([*[self.inner[s] for s in held[:-1]], self.last[held[-1]]]) if held else []

    def _stream(self, symbols: str) -> Iterator[int]:
        held = ""
        for low in range(0, len(symbols), self.window):
            held += symbols[low : low + self.window]
            if low + self.window >= len(symbols):
                break
            stable, done = len(held) - 1 - self.merges.lookahead, 0
            for token in self.merges.apply([self.inner[s] for s in held]):
                if done + self.size[token] > stable:
                    break
                done += self.size[token]
                yield token
            held = held[done:]
        yield from self._end(held)


class ByteToText:
    """UTF-8 bytes in pieces to text: holds back a sequence that the next bytes may finish."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # begins a sequence of 2, 3 or 4 bytes
                if back < 2 + (byte >= 0xE0) + (byte >= 0xF0):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    """A tokenizer file's own parts, and ids of pieces between white space met so far."""

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        plain = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])
        if model["type"] != "BPE" or not plain or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE tokenizer")
        whole = Tokenizer.from_str(content)
        self.normalizer, self.words = whole.normalizer, whole.pre_tokenizer
        pieces = self.words.pre_tokenize_str("a  \n a") if self.words else []
        self.drops_space = [p for p, _ in pieces] == ["a", "a"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = Merges(vocab, [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], end)
        letters = {t: i for t, i in vocab.items() if len(t) == 1}
        size = {i: len(merges._bare(t)) for t, i in vocab.items()}
        last = {t: vocab.get(t + end, i) for t, i in letters.items()}
        self.transducer = Transducer(merges, letters, last, size)
        self.table = Table(merges, letters, last)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(names)})") if names else None
        self.cache: dict[str, int] = {}
        self.known = Ragged()
        self._bytes = self._token_bytes(file.get("decoder"), {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}})

    @staticmethod
    def of(content: str) -> Codec:
        """One codec for a file's content in each process."""
        if content not in _tokenizers:
            _tokenizers[content] = Codec(content)
        return _tokenizers[content]

    def drops_space(self) -> bool:
        pieces = self.words.pre_tokenize_str("a  \n a") if self.words else []
        return [p for p, _ in pieces] == ["a", "a"]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Short texts are looked up together, long ones slice by slice."""
        whole = [self._pieces(t) if len(t) <= _SLICE_CHARS else None for t in texts]
        short = iter(self._ids([pieces for pieces in whole if pieces is not None]))
        out = []
        for text, pieces in zip(texts, whole, strict=True):
            if pieces is not None:
                out.append(next(short))
            else:
                out.append(np.concatenate([self._ids([self._pieces(part)])[0] for part in _slices(text)]))
        return out

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if _ONLY_PYTHON_SPLITS.search(text):
            return [p for p in _SPACE.split(text) if p]
        return text.split()

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.cache) >= _CACHED:
            self.cache.clear()
            self.known = Ragged()
        new = set().union(*texts) - self.cache.keys()
        long = [p for p in new if len(p) > _CACHED_CHARS]
        self._learn(list(new.difference(long)))
        held = self.known.mark()
        for p in long:
            self._learn_one(p)
        out = [self.known.take(np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))) for pieces in texts]
        for p in long:
            del self.cache[p]
        self.known.cut(held)
        return out

    def _learn_one(self, piece: str) -> None:
        self.cache[piece] = self.known.add(*_one(self._tokens(piece)))

    def _learn(self, pieces: list[str]) -> None:
        """Ids of short pieces; those without special tokens are normalized and cut many at a time."""
        plain, owners, found = [], [], []
        for low in range(0, len(pieces), _TOGETHER):
            part = pieces[low : low + _TOGETHER]
            normal = "" if self.at_special and self.at_special.search(" ".join(part)) else self._normal(" ".join(part))
            ends = [m.start() for m in re.finditer(" ", normal)]
            if len(ends) + 1 != len(part) or not normal:
                for p in part:
                    self._learn_one(p)
                continue
            at, ends = 0, [*ends, len(normal)]
            for word, (_, end) in self.words.pre_tokenize_str(normal):
                while end > ends[at]:
                    at += 1
                found.append(word)
                owners.append(len(plain) + at)
            plain += part
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
        words = self._words(list(number))
        sizes = np.bincount(np.array(owners, np.int64), weights=words.count(which), minlength=len(plain)).astype(np.int64)
        first = self.known.add(words.take(which), sizes)
        self.cache.update(zip(plain, range(first, first + len(plain)), strict=True))

    def _words(self, words: list[str]) -> Ragged:
        """Tokens of distinct words, in their order: short ones side by side, long ones through the transducer."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        out, place = Ragged(), np.empty(len(words), np.int64)
        for low, high in _by_length(length[order]):
            part = order[low:high]
            place[part] = out.add(*self.table.apply([words[i] for i in part.tolist()])) + np.arange(len(part))
        for i in order[np.searchsorted(length[order], _SHORT, side="right") :].tolist():
            place[i] = out.add(*_one(self.transducer.word(words[i])))
        return out.ordered(place)

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _tokens(self, piece: str) -> Iterator[int]:
        """Ids of a text without white space: special tokens first, then normalized words."""
        for part in self.at_special.split(piece) if self.at_special else [piece]:
            if part in self.special:
                yield self.special[part]
            elif part:
                for word, _ in self.words.pre_tokenize_str(self._normal(part)):
                    yield from self.transducer.word(word)

    def _token_bytes(self, decoder: dict | None, tokens: dict[int, str]) -> dict[int, bytes]:
        decoder = decoder["type"] if decoder else None
        self.between = b" " if decoder is None else b""
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder}")
        if decoder is None:
            return {i: t.encode() for i, t in tokens.items()}
        alphabet = {letter: byte for byte, letter in byte_letters().items()}
        return {i: t.encode() if t in self.special else bytes(alphabet[c] for c in t) for i, t in tokens.items()}

    def decode(self, ids) -> str:
        machine, out, begun = ByteToText(), [], False
        for low in range(0, len(ids), _BLOCK_IDS):
            known = [b for b in map(self._bytes.get, ids[low : low + _BLOCK_IDS].tolist()) if b is not None]
            out.append(machine.feed((self.between if begun and known else b"") + self.between.join(known)))
            begun = begun or bool(known)
        return "".join([*out, machine.finish()])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


def _by_length(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of alike and not too great lengths, of a bounded number of letters; ``length`` ascends."""
    low, short = 0, int(np.searchsorted(length, _SHORT, side="right"))
    while low < short:
        most = min(_SHORT, 2 * max(4, int(length[low])))
        high = min(low + max(1, _LETTERS // most), int(np.searchsorted(length, most, side="right")))
        yield low, high
        low = high


def _one(tokens: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter(tokens, np.int32)
    return flat, np.array([len(flat)])


class Ragged:
    """Lists of ids, one after the other in arrays that double when they are full."""

    def __init__(self):
        self.flat, self.ends = np.zeros(1 << 10, np.int32), np.zeros(1 << 8, np.int64)
        self.size = 0

    def mark(self) -> int:
        return self.size

    def cut(self, size: int) -> None:
        self.size = size

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Lists of given sizes behind the others; the number of the first."""
        first, start = self.size, int(self.ends[self.size])
        self.flat, self.ends = _room(self.flat, start + len(flat)), _room(self.ends, first + len(sizes) + 1)
        self.flat[start : start + len(flat)] = flat
        self.ends[first + 1 : first + len(sizes) + 1] = start + np.cumsum(sizes)
        self.size += len(sizes)
        return first

    def count(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which + 1] - self.ends[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        """The lists of given numbers, joined."""
        sizes = self.count(which)
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[which] - ends + sizes, sizes)]

    def ordered(self, which: np.ndarray) -> Ragged:
        out = Ragged()
        out.add(self.take(which), self.count(which))
        return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def _slices(text: str) -> Iterator[str]:
    """A text in slices of about ``_SLICE_CHARS`` characters, cut at white space."""
    low = 0
    while low < len(text):
        cut = _SPACE.search(text, low + _SLICE_CHARS) if len(text) - low > _SLICE_CHARS else None
        high = cut.start() if cut else len(text)
        yield text[low:high]
        low = high
