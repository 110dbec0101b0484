"""Line dedup: later copies of repeated runs of lines are deleted.

A line's ID comes from 128 bits of hash; only lines that occur twice or more go
on, since no repeated run crosses another line. The suffixes of all documents'
ID sequences are ordered by distributed prefix doubling: the rank of a suffix by
its first 2**k lines, and that of the suffix 2**k lines further on, make a pair;
pairs that occur twice or more are put in order by a range sort, and their
places are the ranks by 2**(k+1) lines. Suffixes of equal rank stand together in
the suffix array, and their common prefix has at least that length.

A run counts if it has ``MIN_WORDS`` words. For each line the shortest run that
begins there, and the shortest that ends there, with so many words is a prefix
of a suffix; suffixes that share it are a longest-common-prefix interval of at
least that depth, named exactly by two overlapping ranks. Of each interval the
occurrence with the least (doc_id, line) stays and the others are deleted. These
shortest runs cover every maximal repeated run of ``MIN_WORDS`` words, and nothing else.

Doubling ends when no pair repeats or the ranks are as long as the longest
shortest run. No step needs all rows of a key in one task: counts and minima are
combined before each shuffle, and the hot keys of a join are sent to the tasks. Ranks
are written in the shared folder each round.

Defined results: null text has no lines and stays null; a document that loses
lines keeps the others in order; one that loses every line with a word is dropped from
the deduplicated texts, as an earlier document holds all that it said. Rows that
share a doc_id are ordered by a hash of their text; equal rows are one document.
A null doc_id comes after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskforge.llm.common import hinted, joined_by_weight, table, written
from maskforge.llm.quality import WHITE, let

MIN_WORDS = 50
#: A null doc_id as a number: after all others.
LAST = (1 << 63) - 1
KEY = ["_id", "_text"]


def key_of() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text")]


def lines_of(docs: DataFrame) -> DataFrame:
    """_id, _text, line (from 0), a and b (128 bits of hash), words; one row per line."""
    line = F.col("s")
    spaced = F.translate(line, WHITE, " " * len(WHITE))
    words = F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))
    split = docs.where("text is not null").select(*key_of(), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line", "s"))
    return split.select(*KEY, "line", F.xxhash64("s").alias("a"), F.xxhash64(F.lit("line"), "s").alias("b"), words.alias("words"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Ranks of the (a, b) that occur twice or more, and how often: a place in their order, ascending with them."""
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    return written(often.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _text, line of the lines to delete, each once."""
    lines = written(lines_of(docs).dropDuplicates([*KEY, "line"]), "lines")
    first = written(joined_by_weight(lines, ranked(lines), ["a", "b"]).select(*KEY, "line", "words", "rank"), "suffixes")
    needs = written(_needs(first, min_words), "needs")
    longest = needs.agg(F.max("need")).first()[0]
    found = None
    level, k = first.select(*KEY, "line", "rank"), 0
    while longest:
        here = _intervals(needs, level, k)
        found = here if found is None else found.unionByName(here)
        if 1 << (k + 1) > longest:
            break
        doc = Window.partitionBy(*KEY).orderBy("line")
        ahead = level.select(*KEY, "line", F.col("rank").alias("a"), F.lead("rank", 1 << k).over(doc).alias("b"), F.lead("line", 1 << k).over(doc).alias("next"))
        ahead = written(ahead.where(F.col("next") == F.col("line") + (1 << k)).select(*KEY, "line", "a", "b"), "ahead")
        level = written(joined_by_weight(ahead, ranked(ahead), ["a", "b"]).select(*KEY, "line", "rank"), "level")
        k += 1
        if level.isEmpty():
            break
    if found is None:
        return first.select(*KEY, "line").where("false")
    return found.select(*KEY, F.explode(F.sequence("line", F.col("line") + F.col("need") - 1)).alias("line")).distinct()


def _needs(first: DataFrame, min_words: int) -> DataFrame:
    """_id, _text, line, need: lengths of the shortest runs of ``min_words`` words that begin at a line, or end at one and begin here.

    Lines that stand together form islands; a run lies in one island. Running
    sums of words turn the search for a run's end into a merge of two sorted
    lists, done by a window over (document, island).
    """
    doc = Window.partitionBy(*KEY).orderBy("line")
    island = first.withColumn("island", F.col("line") - F.row_number().over(doc))
    part = Window.partitionBy(*KEY, "island").orderBy("line")
    sums = island.withColumn("upto", F.sum("words").over(part)).withColumn("before", F.col("upto") - F.col("words"))
    # sums that may be equal (lines without words) are told apart by the line; a begin at x needs the first line whose
    # running sum reaches x.before + min_words; an end at y needs the last line whose sum before it is at most y.upto - min_words
    span = 1 << 32
    begins = sums.select(*KEY, "island", F.col("line").alias("at"), F.lit(0).alias("ask"), ((F.col("before") + min_words) * span).alias("place"))
    stands = sums.select(*KEY, "island", F.col("line").alias("at"), F.lit(1).alias("ask"), (F.col("upto") * span + F.col("line") + 1).alias("place"))
    later = Window.partitionBy(*KEY, "island").orderBy("place", "ask").rowsBetween(0, Window.unboundedFollowing)
    to_end = begins.unionByName(stands).withColumn("end", F.min(F.when(F.col("ask") == 1, F.col("at"))).over(later)).where("ask = 0 and end is not null")
    to_end = to_end.select(*KEY, F.col("at").alias("line"), (F.col("end") - F.col("at") + 1).cast("int").alias("need"))
    ends = sums.where(F.col("upto") >= min_words).select(*KEY, "island", F.col("line").alias("at"), F.lit(1).alias("ask"), ((F.col("upto") - min_words + 1) * span).alias("place"))
    stands = sums.select(*KEY, "island", F.col("line").alias("at"), F.lit(0).alias("ask"), (F.col("before") * span + F.col("line") + 1).alias("place"))
    earlier = Window.partitionBy(*KEY, "island").orderBy("place", "ask").rowsBetween(Window.unboundedPreceding, 0)
    to_begin = ends.unionByName(stands).withColumn("begin", F.max(F.when(F.col("ask") == 0, F.col("at"))).over(earlier)).where("ask = 1 and begin is not null")
    to_begin = to_begin.select(*KEY, F.col("begin").alias("line"), (F.col("at") - F.col("begin") + 1).cast("int").alias("need"))
    return to_end.unionByName(to_begin).where("need > 0").distinct()


def _intervals(needs: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """Later copies of runs of 2**k to 2**(k+1) - 1 lines: _id, _text, line, need."""
    runs = needs.where(F.col("need").between(1 << k, (2 << k) - 1))
    head = level.withColumnRenamed("rank", "head")
    tail = level.select(*KEY, (F.col("line")).alias("last"), F.col("rank").alias("tail"))
    runs = runs.join(head, [*KEY, "line"]).withColumn("last", F.col("line") + F.col("need") - (1 << k)).join(tail, [*KEY, "last"])
    runs = written(runs.select(*KEY, "line", "need", "head", "tail"), "runs")
    where = F.struct(*KEY, "line")
    least = written(runs.groupBy("head", "tail", "need").agg(F.min(where).alias("kept"), F.count("*").alias("n")).where("n > 1"), "least")
    copies = joined_by_weight(runs, least, ["head", "tail", "need"]).where(where != F.col("kept"))
    return copies.select(*KEY, "line", "need")


def removed_by_document(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _text, removed: the sorted numbers of the lines to delete; sent to every task if they are few."""
    removed = repeated_lines(docs, min_words).groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("removed"))
    return hinted(written(removed, "removed"), 1 + F.size("removed") / 8)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the deleted lines and without documents that have no words left; columns as before."""
    removed = removed_by_document(docs, min_words)
    keyed = docs.select("*", *key_of())
    split = F.split(F.col("text").cast("string"), "\n", -1)
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    kept = let(split, lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    joined = keyed.join(removed, KEY, "left").withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept))
    return joined.where(F.col("removed").isNull() | (F.translate("text", WHITE, "") != "")).select(*docs.columns)


def runs_of(removed: Column) -> Column:
    """Deleted lines as ``first:count`` of each run."""
    starts = F.filter(removed, lambda x, i: F.coalesce(F.get(removed, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(removed, lambda x, i: F.coalesce(F.get(removed, i + 1) != x + 1, F.lit(True)))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat_ws(":", a.cast("string"), (b - a + 1).cast("string"))), ",")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", *key_of(), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    both = counted.join(removed_by_document(docs), KEY, "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(runs_of(F.col("removed")), F.lit("")).alias("removed_runs"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


ORACLE = rf"""
with lines as (
  select doc_id, i - 1 as line, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
often as (select l from lines group by l having count(*) > 1),
repeated as (select *, line - row_number() over (partition by doc_id order by line) as island from lines semi join often using (l)),
sums as (select *, sum(words) over (partition by doc_id, island order by line) as upto from repeated),
begins as (select x.doc_id, x.line, min(y.line) as last from sums x join sums y using (doc_id, island)
  where y.line >= x.line and y.upto >= x.upto - x.words + {MIN_WORDS} group by all),
ends as (select y.doc_id, max(x.line) as line, y.line as last from sums x join sums y using (doc_id, island)
  where y.line >= x.line and x.upto - x.words <= y.upto - {MIN_WORDS} group by y.doc_id, y.line),
runs as (select * from begins union select doc_id, line, last from ends),
named as (select r.doc_id, r.line, r.last, string_agg(s.l, chr(10) order by s.line) as run
  from runs r join repeated s on s.doc_id = r.doc_id and s.line between r.line and r.last group by r.doc_id, r.line, r.last),
copies as (select * from (select *, row_number() over (partition by run, last - line order by doc_id, line) as k from named) where k > 1),
gone as (select distinct doc_id, unnest(range(line, last + 1)) as line from copies),
parts as (select doc_id, line, line - row_number() over (partition by doc_id order by line) as part from gone),
joined as (select doc_id, min(line) as line, count(*) as n from parts group by doc_id, part),
listed as (select doc_id, sum(n) as n, string_agg(line || ':' || n, ',' order by line) as removed_runs from joined group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, coalesce(removed_runs, '') as removed_runs
from documents left join listed using (doc_id)"""
