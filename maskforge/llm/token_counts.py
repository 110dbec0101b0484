"""Token counts kept as delta-maintained rollups by source, language and tokenizer version.

A batch of changes becomes signed counts: an insert adds a document and its
tokens, a delete takes them away, a revision takes the old count away and adds
the new one, under a new source, language or tokenizer version too. A batch's sums are written
aside and enter the rollup by one rename to a folder that bears the batch's
name, so a batch is applied once however often it is tried: a second try finds
the folder, and a try that dies leaves nothing behind that counts. Totals are
the sums of all committed batches; ``compact`` replaces them by one, with the
names it stands for.

A change passes one shuffle, of partial sums per group, so a source with a third of
the documents is no hot spot. Texts never leave their task.

Tokenizer versions are columns of numbers: white-space rules, bytes, and the ids of a
byte-level BPE vocabulary (``BPE``). All of them are counted in one pass over the texts.

Defined results: null text counts as a document of no tokens; null sources,
languages and versions are groups of their own; groups whose documents and
tokens both sum to 0 are left out; an empty batch commits and changes nothing. Repeated
rows each count. Input columns other than doc_id, text, source and lang are not
looked at, so one that is called tokenizer or n_tokens doesn't clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.bpe import counted as bpe_counted
from maskforge.llm.bpe import default_vocabulary
from maskforge.llm.common import checkpoint_root, table, written
from maskforge.llm.quality import words_of

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
BATCH = re.compile(r"[A-Za-z0-9_.-]+")

#: Tokenizer versions that are expressions of a text column.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "spaces-1": lambda text: F.size(F.filter(F.split(text, " "), lambda w: w != "")),
    "words-2": lambda text: F.size(words_of(text)),
    "bytes-1": lambda text: F.octet_length(text),
}
#: The version that counts ids of the byte-level BPE vocabulary.
BPE = "byte_bpe_50k"


def counts(docs: DataFrame, versions: list[str], vocabulary: bytes | None = None) -> DataFrame:
    """doc_id, source, lang and a column of token counts for each version; ``vocabulary`` is the BPE version's JSON (default: the public 50k one)."""
    text = F.col("text").cast("string")
    plain = [F.coalesce(TOKENIZERS[v](text), F.lit(0)).cast("long").alias(v) for v in versions if v != BPE]
    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), *plain, text.alias("_text"))
    if BPE in versions:
        rows = bpe_counted(rows, vocabulary or default_vocabulary(), BPE, "_text")
    return rows.select("doc_id", "source", "lang", *[F.col(f"`{v}`") for v in versions])


def of_version(counts: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of one version."""
    return counts.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("n_tokens"))


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of each row."""
    return of_version(counts(docs, [tokenizer]), tokenizer)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).cast("long").alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts ``old`` by ``new``."""
    return deletes(old).unionByName(inserts(new))


def summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class Rollup:
    """The rollup in a folder that the driver and all executors share; one writer at a time compacts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("batches", "aside"):
            self.files.mkdirs(self.hadoop(f"{self.path}/{name}"))

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.hadoop(f"{self.path}/batches")))

    def _covered(self) -> set[str]:
        """Batches that compacted ones stand for."""
        packed = [f"{self.path}/batches/{n}/covers" for n in self._names() if n.startswith("compact=")]
        return {r[0] for r in self.spark.read.schema("batch string").parquet(*packed).collect()} if packed else set()

    def committed(self) -> set[str]:
        return {n.removeprefix("batch=") for n in self._names() if n.startswith("batch=")} | {n for n in self._covered() if not n.startswith("compact=")}

    def _enter(self, aside: str, name: str) -> bool:
        """Renames a written folder into the rollup; false if the name is there already."""
        target = self.hadoop(f"{self.path}/batches/{name}")
        if not self.files.exists(target) and self.files.rename(self.hadoop(aside), target):
            nested = self.hadoop(f"{self.path}/batches/{name}/{aside.rpartition('/')[2]}")
            if not self.files.exists(nested):  # a rename onto a folder that came meanwhile puts ours inside it
                return True
            self.files.delete(nested, True)
            return False
        self.files.delete(self.hadoop(aside), True)
        return False

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed changes under the batch's name; false, without reading them, if it was committed before."""
        if not BATCH.fullmatch(batch):
            raise ValueError(f"a batch's name has letters, digits, _, . and - only, not {batch!r}")
        if batch in self.committed():
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        summed(changes).write.parquet(f"{aside}/sums")
        return self._enter(aside, f"batch={batch}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        covered = self._covered()
        paths = [f"{self.path}/batches/{n}/sums" for n in self._names() if n.partition("=")[2] not in covered and n not in covered]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*paths))

    def compact(self) -> None:
        """One batch in place of all committed ones; their names stay known."""
        names = self._names()
        covered = self.committed() | {n for n in names if n.startswith("compact=")} | self._covered()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(n,) for n in sorted(covered)], "batch string").write.parquet(f"{aside}/covers")
        if self._enter(aside, f"compact={uuid.uuid4().hex}"):
            for name in names:
                self.files.delete(self.hadoop(f"{self.path}/batches/{name}"), True)


#: Batches in which a table is loaded.
LOADS = 4


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the table once; loads it in batches, repeats one, revises every count to a newer version, adds two more versions, and takes a part of one out and in again."""
    known = written(counts(table(spark, sf_dir, "documents"), [*TOKENIZERS, BPE]), "counts")
    rollup = Rollup(spark, f"{checkpoint_root(spark)}/maskforge-rollup-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(LOADS))
    for k in [*range(LOADS), 2]:
        rollup.apply(f"load-{k}", inserts(of_version(known.where(part == k), "spaces-1")))
    rollup.apply("words", revisions(of_version(known, "spaces-1"), of_version(known, "words-2")))
    rollup.compact()
    rollup.apply("more", inserts(of_version(known, "bytes-1").unionByName(of_version(known, BPE))))
    some = of_version(known.where(part == 0), "bytes-1")
    rollup.apply("out", deletes(some))
    rollup.apply("in", inserts(some))
    return rollup.totals()


#: The versions that SQL can count; the BPE version is held against the library by a test.
PLAIN_SQL = r"""
select source, lang, 'words-2' as tokenizer, count(*)::bigint as n_docs,
       sum(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0))::bigint as n_tokens
from documents group by source, lang
union all
select source, lang, 'bytes-1' as tokenizer, count(*)::bigint as n_docs, sum(coalesce(strlen(text), 0))::bigint as n_tokens
from documents group by source, lang"""
