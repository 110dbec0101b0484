"""Byte-level BPE encoding and decoding of a ``tokenizers`` JSON vocabulary.

Method: a word's parts stand in one contiguous array, and the merge ranks of
neighbouring parts in another. The array of ranks is scanned for its minimum,
the boundary there is deleted, and the two neighbouring ranks are looked up
again, until no neighbours merge. New words of up to ``WIDE`` bytes are the rows
of one such matrix and merge together. The scan is quadratic, so words of more
than ``SHORT`` bytes keep the same ranks in a heap over linked parts instead.

Words recur, so their ids are kept in a bounded dictionary per Python worker. No
token crosses from other characters into a single space, so text in which no
space stands beside other white space is cut at its spaces and looked up there.
There is no shuffle: each task encodes its own rows, and text that is longer
than ``PIECE`` words is taken in pieces that end between words.

Null and empty texts give no ids and decode to the empty text. Rows are coded one by
one, so repeated ones get the same ids; a table without rows gives none. A column
that bears the result's name gives way to it.
"""

from __future__ import annotations

import heapq
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.llm.common import give_back, small_batches, table

#: Bytes of the words that are merged side by side, in matrices of these widths.
WIDTHS = (8, 12, 16, 24, 40)
WIDE = WIDTHS[-1]
SHORT = 256
MATRIX_ROWS = 1 << 16
PIECE = 200_000
CACHED_WORDS = 150_000
#: Rows of an Arrow batch that are encoded and sent on together.
ROWS_AT_ONCE = 256
NEVER = 1 << 30
#: Slots of the table of mergeable pairs; what shares a slot is looked up among the sorted pairs.
SLOTS = 1 << 18
HASH, SLOT_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 18)
#: ASCII signs that are a word of their own behind letters, and letters that are such in every version of Unicode.
MARKS = {*".,;:!?*%$#)"}
LAST_PLAIN = "\u024f"
#: Unicode White_Space, as \s in the pre-tokenizer.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's pattern: letters, contractions, numbers, others, spaces. Letters never start where a contraction does, so they may come first.
PATTERN = rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WHITE = {*map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])}
ASCII_BESIDE = [x for c in " \t\n\v\f\r" for x in (f" {c}", f"{c} ")]
WIDE_WHITE = sorted(WHITE - {*" \t\n\v\f\r"})
#: Files above this size are not sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def plain(chunk: str) -> bool:
    """True if all characters are letters, of the Latin blocks."""
    return chunk.isalpha() and (chunk.isascii() or max(chunk) <= LAST_PLAIN)


def beside_white(text: str) -> bool:
    """True if a space may stand beside other white space."""
    return any(x in text for x in ASCII_BESIDE) or not text.isascii() and any(x in text for x in WIDE_WHITE)


class Codec:
    """Encodes text to ids and back as the library does, special tokens of the file included."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = [0] * 256
        for symbol, byte in symbols.items():
            self.of_byte[byte] = vocab[symbol]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 20 | vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.pair_keys = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        slots = (self.pair_keys.view(np.uint64) * HASH >> SLOT_SHIFT).view(np.int64)
        self.slots = np.zeros(SLOTS, dtype=np.int64)
        self.slots[slots] = np.arange(len(slots))
        self.crowded = np.bincount(slots, minlength=SLOTS) > 1
        self.merged_ids = np.array(self.merged, dtype=np.int32)
        self.byte_ids = np.array(self.of_byte, dtype=np.int32)
        self.lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.words = regex.compile(PATTERN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.batch: dict[str, bytes] = {}  # chunks that are not kept beyond the batch they were warmed for

    def merge(self, word: bytes) -> list[int]:
        parts = [self.of_byte[b] for b in word]
        rank = self.rank
        if len(parts) > SHORT:
            return self.merge_long(parts)
        ranks = [rank.get(a << 20 | b, NEVER) for a, b in itertools.pairwise(parts)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 20 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] << 20 | parts[i + 1], NEVER)
        return parts

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right  # under 0, as no pair is, where a part is missing
        slot = (key.view(np.uint64) * HASH >> SLOT_SHIFT).view(np.int64)
        at = self.slots[slot]
        rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(NEVER))
        rest = np.nonzero(self.crowded[slot])
        if rest[0].size:
            few = key[rest]
            at = np.minimum(np.searchsorted(self.pair_keys, few), len(self.pair_keys) - 1)
            rank[rest] = np.where(self.pair_keys[at] == few, self.pair_ranks[at], NEVER)
        return rank

    def merge_rows(self, words: list[bytes], wide: int = WIDE) -> list[bytes]:
        """Packed ids of words of 1 to ``wide`` bytes, merged side by side."""
        n, width = len(words), wide + 1
        size = np.array([len(w) for w in words])
        inside = np.arange(width) < size[:, None]
        parts = np.full((n, width), -1, dtype=np.int32)
        parts[inside] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:])
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks[rows].argmin(1)
            least = ranks[rows, at]
            go = least != NEVER
            rows, at, least = rows[go], at[go], least[go]
            own, deal = parts[rows], ranks[rows]
            own[np.arange(len(rows)), at] = self.merged_ids[least]
            own[:, :-1] = np.where(columns[:-1] > at[:, None], own[:, 1:], own[:, :-1])
            deal[:, :-1] = np.where(columns[:-2] >= at[:, None], deal[:, 1:], deal[:, :-1])
            deal[:, -1] = NEVER
            k = np.arange(len(rows))
            deal[k, at] = self.ranks_of(own[k, at], own[k, at + 1])
            before = np.maximum(at - 1, 0)
            deal[k, before] = np.where(at > 0, self.ranks_of(own[k, before], own[k, before + 1]), deal[k, before])
            parts[rows], ranks[rows] = own, deal
        kept = parts >= 0
        ends = (4 * kept.sum(1)).cumsum().tolist()
        flat = parts[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def warm(self, texts: list[str | None]) -> None:
        """Puts the texts' new words into the cache, merged side by side."""
        chunks: set[str] = set()
        for text in texts:
            if text and len(text) <= 4 * PIECE:
                chunks.update(text.split(" "))
        chunks.difference_update(self.spaced)
        found = {chunk: self.words_of(chunk) for chunk in chunks}
        new = set(itertools.chain.from_iterable(found.values())).difference(self.cache)
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
            new = set(itertools.chain.from_iterable(found.values()))
        by_width: dict[int, list[tuple[str, bytes]]] = {w: [] for w in WIDTHS}
        for w in new:
            if (n := len(b := w.encode("utf-8", "surrogatepass"))) <= WIDE:
                by_width[next(x for x in WIDTHS if n <= x)].append((w, b))
        for wide, short in by_width.items():
            for i in range(0, len(short), MATRIX_ROWS):
                some = short[i : i + MATRIX_ROWS]
                self.cache.update(zip((w for w, _ in some), self.merge_rows([b for _, b in some], wide), strict=True))
        if len(self.spaced) >= CACHED_WORDS:
            self.spaced.clear()
        self.batch.clear()
        get, packed = self.cache.get, self.packed
        for chunk, words in found.items():
            ids = b"".join([get(w) or packed(w) for w in words]) if len(words) > 1 else get(words[0]) or packed(words[0])
            if len(chunk) <= 32 and "\n" not in chunk:
                self.spaced[chunk] = ids
            else:
                self.batch[chunk] = ids

    def words_of(self, chunk: str) -> list[str]:
        """Words of a space and the characters up to the next one; the plainest kinds without the pattern."""
        if plain(chunk):
            return [f" {chunk}"]
        if chunk[-1:] in MARKS and plain(chunk[:-1]):
            return [f" {chunk[:-1]}", chunk[-1]]
        return self.words.findall(f" {chunk}")

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (r := rank.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank.get(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def packed(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            got = np.array(self.merge(word.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
            if len(self.cache) >= 2 * CACHED_WORDS:  # not sooner: a batch's words are in it beyond the others
                self.cache.clear()
            if len(word) <= 64:
                self.cache[word] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        text = text or ""
        for m in self.specials.finditer(text) if self.specials else ():
            self.encode_plain(text[at : m.start()], out)
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        self.encode_plain(text[at:] if at else text, out)
        return b"".join(out)

    def encode_plain(self, text: str, out: list[bytes]) -> None:
        if len(text) > 4 * PIECE:
            found = (m[0] for m in self.words.finditer(text))
            while piece := [self.packed(w) for w in itertools.islice(found, PIECE)]:
                out.append(b"".join(piece))
        elif text[:1] in WHITE or text[-1:] in WHITE or beside_white(text):
            out.extend(map(self.packed, self.words.findall(text)))
        else:
            first, *rest = text.split(" ")
            get, now, packed = self.spaced.get, self.batch.get, self.packed_chunk
            out.extend(map(self.packed, self.words.findall(first)))
            out.extend([get(c) or now(c) or packed(c) for c in rest])

    def packed_chunk(self, chunk: str) -> bytes:
        """Ids of a space and the characters up to the next one."""
        got = b"".join(map(self.packed, self.words.findall(f" {chunk}")))
        if len(chunk) <= 32 and "\n" not in chunk:
            if len(self.spaced) >= 2 * CACHED_WORDS:
                self.spaced.clear()
            self.spaced[chunk] = got
        return got

    def decode(self, ids: bytes | None) -> str:
        """Bytes that are no UTF-8 become U+FFFD, as the library has it."""
        all_ids = np.frombuffer(ids or b"", dtype="<u4")
        return b"".join(self.bytes_of(all_ids[i : i + PIECE]) for i in range(0, len(all_ids), PIECE)).decode("utf-8", "replace")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = size.cumsum()
        return self.blob[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


def array_of(ids: bytes | None) -> list[int]:
    return np.frombuffer(ids or b"", dtype="<u4").tolist()


_codecs: dict[int, Codec] = {}


def codec_of(source: bytes) -> Codec:
    """One codec per vocabulary and Python worker."""
    key = hash(source)
    if key not in _codecs:
        _codecs[key] = Codec(source)
    return _codecs[key]


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        source = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return source


def _mapped(df: DataFrame, source: bytes, column: str, names: dict[str, T.DataType], convert, gone: str | None = None) -> DataFrame:
    """``df`` with the named columns made from ``column``; other columns but ``gone`` pass through unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(source)
    kept = [f for f in df.schema.fields if f.name not in names and f.name != gone]
    schema = T.StructType([*kept, *[T.StructField(n, kind) for n, kind in names.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                made = convert(codec, batch.column(batch.schema.get_field_index(column)))
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[f.name for f in schema])
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, source: bytes, text: str = "text", name: str = "ids", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds the ids of column ``text`` (a column ``name`` is replaced): array of int, or if ``packed`` little-endian bytes.

    decoded: a column for the text that the ids decode to, made by the same worker, so that a task needs one.
    """
    names: dict[str, T.DataType] = {name: T.BinaryType() if packed else T.ArrayType(T.IntegerType())}
    if decoded:
        names[decoded] = T.StringType()

    def convert(codec: Codec, column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        codec.warm(texts)
        made = [codec.encode(x) for x in texts]
        del texts
        ids = pa.array(made, pa.binary()) if packed else pa.array([array_of(x) for x in made], pa.list_(pa.int32()))
        return [ids, pa.array(map(codec.decode, made), pa.string())] if decoded else [ids]

    return _mapped(df, source, text, names, convert)


def counted(df: DataFrame, source: bytes, name: str, text: str = "text") -> DataFrame:
    """The number of ids of column ``text``, which gives way to it."""

    def convert(codec: Codec, column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        codec.warm(texts)
        return [pa.array([len(codec.encode(x)) // 4 for x in texts], pa.int64())]

    return _mapped(df, source, text, {name: T.LongType()}, convert, text)


def decode(df: DataFrame, source: bytes, ids: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of column ``ids``, which is an array of int or packed bytes."""

    def convert(codec: Codec, column: pa.Array) -> list[pa.Array]:
        pack = (lambda x: x) if pa.types.is_binary(column.type) else (lambda x: array("I", x or []).tobytes())
        return [pa.array([codec.decode(pack(x)) for x in column.to_pylist()], pa.string())]

    return _mapped(df, source, ids, {name: T.StringType()}, convert)


def default_vocabulary() -> bytes:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, source, packed=True, decoded="decoded")
    return coded.select(
        "doc_id",
        n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and their number; columns of the input with these names give way."""
    kept = docs.drop("ids", "n_tokens")
    return encode(kept, default_vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))
