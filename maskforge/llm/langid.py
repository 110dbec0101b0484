"""Language identification by compression.

Each learned language has a zstandard dictionary of raw content. A text's words,
in lower case and without other characters, are compressed in pieces with each
dictionary, and the language of the smallest sum is chosen. Where the two
smallest are close, compression with matches of three bytes decides instead;
where those are too close as well, the choice is marked as rejected.

A dictionary is at most ``DICTIONARY_BYTES`` of the words of whole texts, from at
most ``MAX_ROWS`` rows of a language, those of least hash that aren't held out.
Every language is learned; a task holds the dictionaries of ``LANGUAGES_AT_ONCE``
and goes over its texts once for each such slice, keeping the two smallest sums.
Whole texts are judged, in pieces of ``PIECE`` characters so that a long text
doesn't become its own dictionary. There is no shuffle over texts.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as are all texts if no language was learned. Rows are judged one by one, so
repeated ones get one answer each; a table without rows gives none. Input columns
named lang_pred, score and rejected give way to the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskforge.llm.common import held_out, pieces, table

LANGUAGES_AT_ONCE = 64
#: Characters of texts that are judged together.
TEXT_AT_ONCE = 1 << 22
MAX_ROWS = 150
DICTIONARY_BYTES = 96 << 10
PIECE = 1500
LEVEL = 3
#: Scores under this are judged again with shorter matches.
CLOSE = 0.12
#: Choices of a smaller score are marked as rejected.
MARGIN = 0.02
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from rows with doc_id, text and lang."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return {}
    # of each language, a range of hashes that is expected to hold several times the rows wanted
    most = [(name, min((1 << 63) - 1, int(2**64 * min(1.0, 4 * MAX_ROWS / n)) - (1 << 63))) for name, n in counts.items()]
    near = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most long")), "lang").where("h <= most")
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= MAX_ROWS).select("doc_id", "lang", "k")
    words = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "k", "text").mapInArrow(_words, "lang string, k long, words binary")
    before = F.sum(F.length("words")).over(Window.partitionBy("lang").orderBy("k", "words").rowsBetween(Window.unboundedPreceding, -1))
    wanted = words.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < DICTIONARY_BYTES).drop("before").collect()
    content = {name: b"" for name in counts}  # the most frequent first, as ties go
    for r in sorted(wanted, key=lambda r: (r["lang"], r["k"], r["words"])):
        content[r["lang"]] += r["words"]
    return {name: data[:DICTIONARY_BYTES] for name, data in content.items() if len(data) > 8}


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of whole texts, as much as a dictionary holds."""
    for batch in (p for whole in batches for p in pieces(whole, 2)):
        words = [words_only(t)[:DICTIONARY_BYTES] for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(words, pa.binary())], names=["lang", "k", "words"])


class Letters(dict):
    """Translation of each character that is no letter to a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_letters = Letters()


def words_only(text: str) -> bytes:
    return f" {' '.join(text.lower().translate(_letters).split())} ".encode("utf-8", "replace")


def fast(data: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)


def close(data: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    short = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_BTULTRA, min_match=3, search_log=6, window_log=18, chain_log=18, hash_log=17, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=short)


class Judge:
    def __init__(self, content: dict[str, bytes]):
        ranked = [(k, name, data) for k, (name, data) in enumerate(content.items())]
        self.slices = [ranked[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(ranked), LANGUAGES_AT_ONCE)]
        self.made: dict[tuple[int, Callable], list[tuple[int, str, zstandard.ZstdCompressor]]] = {}

    def compressors(self, part: int, make: Callable[[bytes], zstandard.ZstdCompressor]) -> list[tuple[int, str, zstandard.ZstdCompressor]]:
        """Those of one slice; only a single slice's are kept."""
        if (part, make) not in self.made:
            if len(self.slices) > 1:
                self.made.clear()
            self.made[part, make] = [(k, name, make(data)) for k, name, data in self.slices[part]]
        return self.made[part, make]

    def best(self, words: list[bytes], make: Callable[[bytes], zstandard.ZstdCompressor]) -> list[tuple[str, float]]:
        """Language and score of each: by what share the best sum is smaller than the second."""
        least: list[list[tuple[int, int, str]]] = [[] for _ in words]
        for part in range(len(self.slices) if words else 0):
            made = self.compressors(part, make)
            for i, data in enumerate(words):
                pieces = [data[j : j + PIECE] for j in range(0, len(data), PIECE)]
                least[i] = sorted(least[i] + [(sum(len(c.compress(p)) for p in pieces), k, name) for k, name, c in made])[:2]
        return [(sums[0][2], (sums[1][0] - sums[0][0]) / sums[1][0] if len(sums) > 1 else 1.0) for sums in least]

    def judged(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        words = {i: words_only(t) for i, t in enumerate(texts) if t and self.slices and LETTER.search(t)}
        for make in (fast, close):
            for i, found in zip(words, self.best(list(words.values()), make), strict=True):
                out[i] = found
            words = {i: data for i, data in words.items() if out[i][1] < CLOSE}
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        return self.judged([text])[0]


def identified(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names give way."""
    kept = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names, at = schema.names, kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in (p for whole in batches for p in pieces(whole, at)):
            texts, found = batch.column(at).to_pylist(), []
            while len(found) < len(texts):
                first = upto = len(found)
                size = 0
                while upto < len(texts) and (upto == first or size < TEXT_AT_ONCE):
                    size += len(texts[upto] or "")
                    upto += 1
                found += judge.judged(texts[first:upto])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] < MARGIN for f in found], pa.bool_())], names=names)

    return kept.mapInArrow(run, schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = learn(docs)
    return identified(docs.select("doc_id", "text"), content).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
