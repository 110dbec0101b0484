"""Benchmark decontamination by template canonicalisation.

Words are runs of letters, marks and digits of any script; what Unicode calls
punctuation, symbols or space parts them. In scripts written without spaces
(``SPACELESS``) each letter, with its marks, is a word. Words become template tokens: numbers, names (capitalised words inside a
sentence) and units (after a number) become typed placeholders, other words
their lower case. Windows of ``WINDOW`` template tokens with at least
``LITERALS`` literal words are hashed, and the documents' windows are joined with the benchmark's by hash.
The values in the placeholders of matched windows must be consistent: each
value of the item stands for one value in the document and the other way round,
so a question with other numbers or names is still found, and windows that only
look alike are not. Which values go together is told by the majority of the windows,
over all of a document and around each alignment (for several versions of one
item), so it doesn't depend on an order; the most covering reading counts. An item's first word, which begins a sentence there but maybe
not in a document, is taken as a placeholder too. Beside the templates, windows
of words in lower case are hashed as they are, whatever their kinds, so verbatim
copies of numbers, names and tables are found. A document leaks an item if the
consistent and the verbatim windows cover at least ``SHARE`` of the item's tokens
and ``LEAST`` of them (all, of shorter items).

The benchmark's windows are a table. A bit map of their hashes, of ``BITS_A_WINDOW`` bits a
window and at most ``MAX_BITS`` bits, goes to the executors, and one narrow pass over whole texts writes the
documents' windows that it lets through: hashes and 64-bit hashes of values, never texts. Both
tables are joined by hash, with a hash that many documents share sent to the tasks, and the
matches of a document and an item are judged together.

Defined results: null and empty texts match nothing; items with fewer than
``LITERALS`` words can't be told from chance and are ignored, and items with fewer
literal words are found only verbatim (in either case); items
shorter than a window have one window of their own length. Rows that share a
doc_id, and texts that share an item_id, are judged one by one, and the largest share is returned. A table
without rows gives none; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.common import hinted, joined_by_weight, pieces, table, written
from maskforge.llm.shingles import PIECE, mix, powers

WINDOW, LITERALS = 8, 5
SHARE, LEAST = 0.5, 13
BITS_A_WINDOW, MAX_BITS = 16, 1 << 27
#: Words that count as units after a number.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "v", "w", "kw", "j", "kj", "n", "pa", "k", "c", "f", "percent", "dollars", "euros", "cents", "usd", "eur"]
LITERAL, NUMBER, NAME, UNIT = range(4)
_U = np.uint64
#: Scripts written without spaces between words.
SPACELESS = ["Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Tai_Viet", "Javanese", "Balinese"]
#: Classes of characters, as bits: in a word, a word by itself, joined to the letter before it, digit, end of a sentence, point in a number.
INSIDE, SINGLE, MARK, DIGIT, END, POINT = (1 << k for k in range(6))
CLASSES = {
    INSIDE: r"[\p{L}\p{M}\p{N}]+",
    SINGLE: rf"(?V1)[[{''.join(rf'\p{{scx={name}}}' for name in SPACELESS)}]&&[\p{{L}}\p{{Nl}}\p{{No}}]]+",
    MARK: r"\p{M}+",
    DIGIT: r"\p{Nd}+",
    END: r"[\p{Sentence_Terminal}\n]+",
    POINT: r"[.,]+",
}
_PLACEHOLDER = mix(np.array([11, 22, 33, 44], dtype=_U))


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The classes of each code point."""
    if not _classes:
        table = np.zeros(0x110000, dtype=np.uint8)
        for plane in range(0, len(table), 0x10000):
            some = "".join(map(chr, range(plane, plane + 0x10000)))
            for bit, pattern in CLASSES.items():
                for m in regex.finditer(pattern, some):
                    table[plane + m.start() : plane + m.end()] |= bit
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of texts with a line end between them."""
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Template:
    """Template tokens of texts: hash, kind, text number and place of each."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        raw = [r if len(r) == len(x) else x for r, x in zip(texts, low, strict=True)]  # letters whose case changes their length: no names there
        # between texts stands a line end; pieces of bounded size are hashed one after another
        self.data = code_points(low)
        n = len(self.data)
        classes = char_classes()[self.data]
        inside = (classes & INSIDE) != 0
        digit = (classes & DIGIT) != 0
        inside[1:-1] |= ((classes[1:-1] & POINT) != 0) & digit[:-2] & digit[2:]
        opens = inside & ~np.concatenate(([False], inside[:-1]))
        closes = inside & ~np.concatenate((inside[1:], [False]))
        single = (classes & SINGLE) != 0
        if single.any():
            mark = (classes & MARK) != 0
            base = np.maximum.accumulate(np.where(mark, 0, np.arange(n)))
            after = np.concatenate(([False], single[base][:-1])) & ~mark  # what follows a word of one letter
            opens |= inside & (single | after)
            closes[:-1] |= inside[:-1] & opens[1:]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        value = self._hashes(self.data)
        if not len(value):
            self.value, self.kind, self.hash, self.text = value, np.empty(0, dtype=int), value, np.empty(0, dtype=int)
            return
        kind = np.zeros(len(value), dtype=np.int8)
        first = self.data[self.start] != code_points(raw)[self.start]
        stops = np.concatenate(([0], np.cumsum((classes & END) != 0)))
        opened = np.ones(len(value), dtype=bool)  # true where a sentence begins
        opened[1:] = stops[self.start[1:]] > stops[self.end[:-1]]
        number = digit[self.start]
        kind[first & ~opened] = NAME
        kind[number] = NUMBER
        kind[1:][np.isin(value[1:], _unit_hashes()) & number[:-1] & ~opened[1:]] = UNIT
        self.value, self.kind = value, kind
        self.hash = np.where(kind == LITERAL, value, _PLACEHOLDER[kind])
        bounds = np.cumsum([len(x) + 1 for x in low])
        self.text = np.searchsorted(bounds, self.start, side="right")

    def _hashes(self, buffer: np.ndarray) -> np.ndarray:
        up, down = powers()
        out = np.empty(len(self.start), dtype=_U)
        done = 0
        with np.errstate(over="ignore"):
            while done < len(self.start):
                base = int(self.start[done])
                upto = max(done + 1, int(np.searchsorted(self.end, base + PIECE, side="right")))
                piece = buffer[base : min(int(self.end[upto - 1]), base + PIECE)]
                total = np.zeros(len(piece) + 1, dtype=_U)
                np.cumsum((piece.astype(_U) + _U(1)) * up[: len(piece)], out=total[1:])
                s = self.start[done:upto] - base
                e = np.minimum(self.end[done:upto] - base, len(piece))
                out[done:upto] = mix((total[e] - total[s]) * down[s] + (self.end[done:upto] - self.start[done:upto]).astype(_U))
                done = upto
        return out

    def windows(self, size: int, opening: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows that lie in one text and have enough literal words; ``opening`` counts a first name or unit as one."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, dtype=int), np.empty(0, dtype=_U)
        literal = np.concatenate(([0], np.cumsum(self.kind == LITERAL)))
        some = literal[size:] - literal[:n]
        if opening:
            some = some + ((self.kind[:n] == NAME) | (self.kind[:n] == UNIT))
        good = (self.text[:n] == self.text[size - 1 :]) & (some >= min(LITERALS, size))
        at = np.flatnonzero(good)
        return at, chained(self.hash, size)[at]

    def verbatim(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of all windows that lie in one text, their words as they are."""
        n = len(self.value) - size + 1
        if n <= 0:
            return np.empty(0, dtype=int), np.empty(0, dtype=_U)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, chained(self.value, size)[at]


def chained(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` token hashes."""
    n = len(tokens) - size + 1
    made = np.full(n, size, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(size):
            made = (made ^ tokens[j : j + n]) * _U(0x9E3779B97F4A7C15)
            made ^= made >> _U(29)
    return made


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.empty(0, dtype=_U))  # while the template of the units is made
        _units[0] = Template([" ".join(UNITS)]).value
    return _units[0]


TEMPLATE, VERBATIM = 0, 1


def tokens_at(values: np.ndarray, places: np.ndarray, size: int) -> list[bytes]:
    """The ``size`` values from each place, packed."""
    packed = values[places[:, None] + np.arange(size)] if len(places) else np.empty((0, size), values.dtype)
    return [row.tobytes() for row in packed]


#: way and hash name a window; of equal windows of an item, the places stand in one row.
ITEM_WINDOW = "way int, hash long, size int, item_id long, item long, n_tokens long, places array<int>, item_values binary"
DOC_WINDOW = "way int, hash long, doc_id long, doc long, place int, kinds binary, doc_values binary"


def _item_windows(item_id: int, item: int, text: str) -> list[tuple]:
    template = Template([text])
    n = len(template.value)
    if n < LITERALS:
        return []
    size = min(WINDOW, n)
    found = [(VERBATIM, *template.verbatim(size)), (TEMPLATE, *template.windows(size)), (TEMPLATE, *_opening(template, size))]
    places: dict[tuple, list[int]] = defaultdict(list)
    for way, at, hashes in found:
        for place, h, values in zip(at.tolist(), hashes.view(np.int64).tolist(), tokens_at(template.value, at, size), strict=True):
            places[way, h, values].append(place)
    return [(way, h, size, item_id, item, n, at, values) for (way, h, values), at in places.items()]


def _opening(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An item's first window with its first word as a name, and as a unit if it is one: what it can be inside a sentence."""
    if t.kind[0] != LITERAL or 0 not in t.windows(size)[0]:
        return np.empty(0, dtype=int), np.empty(0, dtype=_U)
    hashes = []
    for kind in [NAME, UNIT] if t.value[0] in _unit_hashes() else [NAME]:
        tokens = t.hash[:size].copy()
        tokens[0] = _PLACEHOLDER[kind]
        hashes.append(chained(tokens, size)[0])
    return np.zeros(len(hashes), dtype=int), np.array(hashes, dtype=_U)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items, distinct (item_id, text); ``item`` tells texts of one id apart."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("item"), text.alias("text")).where("item_id is not null and text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in pieces(whole, 2)):
            yield _batch([w for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in _item_windows(*row)], ITEM_WINDOW)

    return items.mapInArrow(run, ITEM_WINDOW)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])


def bit_map(windows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """(packed bits of the windows' hashes, how many leading bits of a hash name a bit, the windows' sizes)."""
    n = windows.count()
    lead = int(math.log2(max(1 << 20, min(MAX_BITS, 1 << math.ceil(math.log2(max(1, n * BITS_A_WINDOW)))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = np.zeros((1 << lead) // 8, dtype=np.uint8), set()
        for batch in batches:
            at = batch.column(0).to_numpy().view(_U) >> _U(64 - lead)
            np.bitwise_or.at(bits, at >> _U(3), np.uint8(1) << (at & _U(7)).astype(np.uint8))
            sizes.update(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()]), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["bits", "sizes"])

    out, sizes = np.zeros((1 << lead) // 8, dtype=np.uint8), set()
    for r in windows.select("hash", "size").coalesce(4).mapInArrow(run, "bits binary, sizes array<int>").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
        sizes.update(r["sizes"])
    return out, lead, sorted(sizes)


def doc_windows(docs: DataFrame, bits: np.ndarray, lead: int, sizes: list[int]) -> DataFrame:
    """Windows of whole texts whose hashes the bit map has, each content once a text; ``doc`` tells texts of one doc_id apart."""
    shared = docs.sparkSession.sparkContext.broadcast((bits.tobytes(), lead, sizes))
    text = F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lead, sizes = shared.value
        bits = np.frombuffer(packed, dtype=np.uint8)
        for batch in (p for whole in batches for p in pieces(whole, 2)):
            ids, docs, texts = (c.to_pylist() for c in batch.columns)
            template, rows = Template([t or "" for t in texts]), {}
            literal = np.concatenate(([0], np.cumsum(template.kind == LITERAL)))
            for size in sizes:
                for way, (places, hashes) in ((TEMPLATE, template.windows(size, opening=True)), (VERBATIM, template.verbatim(size))):
                    at = hashes >> _U(64 - lead)
                    maybe = (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
                    places, hashes = places[maybe], hashes[maybe]
                    # whether the window has enough literal words without its first one
                    enough = (literal[places + size] - literal[places] >= min(LITERALS, size)).tolist()
                    values, kinds = tokens_at(template.value, places, size), tokens_at(template.kind, places, size)
                    for text, place, h, value, kind, ok in zip(template.text[places].tolist(), places.tolist(), hashes.view(np.int64).tolist(), values, kinds, enough, strict=True):
                        if way == VERBATIM:
                            rows.setdefault((text, way, h), (place, None, None))
                        else:
                            rows.setdefault((text, way, h, value, kind), (place, kind + bytes([ok]), value))
            yield _batch([(key[1], key[2], ids[key[0]], docs[key[0]], *rest) for key, rest in rows.items()], DOC_WINDOW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), text.alias("text")).mapInArrow(run, DOC_WINDOW)


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """Pairs of equal windows of documents and items; none if no item has a window."""
    items = written(item_windows(benchmark), "items")
    bits, lead, sizes = bit_map(items)
    if not sizes:
        return None
    found = written(doc_windows(docs, bits, lead, sizes), "windows")
    often = written(found.groupBy("way", "hash").agg(F.count("*").alias("n")), "often")
    return joined_by_weight(found, written(items.join(hinted(often), ["way", "hash"]).drop("size"), "met"), ["way", "hash"])


JUDGED = "doc_id long, item_id long, covered long, n_tokens long"
KEY = ["doc_id", "doc", "item_id", "item"]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens) of the documents that leak an item."""
    pairs = matched(docs, benchmark)
    if pairs is None:
        return docs.sparkSession.createDataFrame([], JUDGED)
    columns = [*KEY, "n_tokens", "way", "place", "kinds", "doc_values", "places", "item_values"]
    together = pairs.select(*columns).repartition(*KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    out += _judged(key, rows)
                    key, rows = row[:4], []
                rows.append(row[4:])
            yield _batch(out, JUDGED)
        yield _batch(_judged(key, rows), JUDGED)

    found = together.mapInArrow(run, JUDGED)
    best = F.max(F.struct((F.col("covered") / F.col("n_tokens")).alias("share"), "covered", "n_tokens")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.covered", "best.n_tokens")


def _judged(key: tuple | None, rows: list[tuple]) -> list[tuple]:
    """The leak of one document's text and one item's, if it is one, from (n_tokens, way, place, kinds, doc_values, places, item_values)."""
    if key is None:
        return []
    total, same, windows = rows[0][0], set(), []
    for _, way, place, kinds, doc_values, places, item_values in rows:
        size = len(item_values) // 8
        taken = {p + j for p in places for j in range(size)}
        if way == VERBATIM:
            same |= taken
        elif kinds[-1] or doc_values[:8] == item_values[:8]:
            slots = [(kinds[j], item_values[8 * j : 8 * j + 8], doc_values[8 * j : 8 * j + 8]) for j in range(size) if kinds[j] != LITERAL]
            windows.append((place - min(places), slots, taken))
    windows.sort(key=lambda w: w[0])
    covered = len(same | consistent(windows))
    first = upto = 0
    for at in sorted({w[0] for w in windows}):  # around each alignment
        while windows[first][0] < at - WINDOW:
            first += 1
        while upto < len(windows) and windows[upto][0] <= at + WINDOW:
            upto += 1
        if upto - first < len(windows):
            covered = max(covered, len(same | consistent(windows[first:upto])))
    return [(key[0], key[2], covered, total)] if covered >= max(SHARE * total, min(LEAST, total)) else []


def consistent(windows: list[tuple]) -> set[int]:
    """Item tokens in the windows whose slots agree with what most windows say, both ways; of equally many the least value."""
    to: dict[tuple, Counter] = defaultdict(Counter)
    back: dict[tuple, Counter] = defaultdict(Counter)
    for _, slots, _ in windows:
        for kind, a, b in slots:
            to[kind, a][b] += 1
            back[kind, b][a] += 1
    there, here = ({k: min(n.items(), key=lambda v: (-v[1], v[0]))[0] for k, n in side.items()} for side in (to, back))
    taken: set[int] = set()
    for _, slots, tokens in windows:
        if all(there[kind, a] == b and here[kind, b] == a for kind, a, b in slots):
            taken |= tokens
    return taken


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item; rows with a null id stay. Only the leaking ids meet the texts, sent to every task if they are few."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(hinted(written(found, "leaking")), "doc_id", "left_anti").select(*docs.columns)
