"""Quality rules: counts of words, symbols and repeats, and cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space as one space) and
hashed; a line that stands in more documents of a host than ``greatest(
MIN_DOCUMENTS, MAX_SHARE of the host's documents)`` is removed, and a document
that loses more than ``MAX_LOST`` of its words is rejected. A document's host is
its source. Everything is built-in functions: one narrow pass over the texts, which
writes the counts and the hashes of the lines, then grouped sums with partial
aggregation and a join of hashes on (host, line), whose hot keys are sent to the
tasks; texts are not shuffled.

Defined results: null text has no words; a null source is a host of its own;
each row counts as a document and is judged by itself, repeated ones too. Lines
without a word are never removed. A table without rows gives none. Other columns
than doc_id, text and source are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.common import hinted, joined_by_weight, table, written

MIN_DOCUMENTS = 10
MAX_SHARE = 0.01
MAX_LOST = 0.5
WINDOW = 8
SPACES = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def has_word(line: Column) -> Column:
    return F.translate(line, WHITE, "") != ""


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more, from hashes of the windows."""

    def covered(starts: Column) -> Column:
        """Positions in at least one window that begins at these ascending places."""
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def again(windows: Column) -> Column:
        """Starts of the windows that aren't alone."""
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = lambda s, x, j: F.coalesce((j > 0) & (F.get(s, j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.filter(let(placed, lambda s: F.transform(s, lambda x, j: F.when(alike(s, x, j), x["i"]))), lambda i: i.isNotNull()))

    def counted(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(again(w), covered)).otherwise(0))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashed, counted)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _row, host, the base counts, base_failed, and lines (hash and number of words) of each row, from one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), has_word)
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    parts = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, lambda one: F.struct(F.xxhash64(normalised(one)).alias("line"), F.size(words_of(one)).alias("words"))).alias("lines")))
    made = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), host_of().alias("host"), text.alias("_text"), counts.alias("_counts"), parts.alias("_parts"))
    made = made.select(
        "doc_id",
        "_row",
        "host",
        F.col("_counts.n_words").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_parts.n_dup_lines").alias("n_dup_lines"),
        F.col("_counts.n_repeat_words").alias("n_repeat_words"),
        F.col("_parts.lines").alias("lines"),
    )
    return made.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normalised(line: Column) -> Column:
    plain = F.translate(F.lower(line), "123456789", "000000000")
    return F.btrim(F.regexp_replace(plain, SPACES, " "))


def lost_words(rows: DataFrame) -> DataFrame:
    """_row and the number of its words that stand in removed lines, of the rows (written) that lose any."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("documents"))
    first = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    often = first.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > MIN_DOCUMENTS).join(hosts, "host").where(F.col("n") > MAX_SHARE * F.col("documents"))
    often = written(often.select("host", "line", "n"), "often")
    lines = rows.select("_row", "host", F.explode("lines").alias("x")).select("_row", "host", "x.line", "x.words")
    return joined_by_weight(lines, often, ["host", "line"]).groupBy("_row").agg(F.sum("words").alias("lost"))


def host_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("\0"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, lost (share of words in removed lines) and kept."""
    rows = written(measured(docs), "measured")
    lost = hinted(written(lost_words(rows), "lost"))
    both = rows.drop("lines").join(lost, "_row", "left").withColumn("lost", F.when(F.col("lost") > 0, F.col("lost") / F.col("n_words")).otherwise(0.0))
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST)).drop("_row", "host")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*columns)


ORACLE = rf"""
with base as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '{SPACES}', '', 'g') <> '') as lines
  from documents),
windows as (
  select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w
  from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from base where len(words) >= {WINDOW})),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by doc_id),
all_lines as (
  select doc_id, host, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '{SPACES}', ' ', 'g'), ' ') as line,
         len(list_filter(regexp_split_to_array(l, '{SPACES}'), lambda w: w <> '')) as n
  from (select doc_id, host, unnest(lines) as l from base)),
hosts as (select host, count(*) as documents from base group by host),
often as (
  select host, line from (select host, line, count(distinct doc_id) as n from all_lines group by host, line) join hosts using (host)
  where n > {MIN_DOCUMENTS} and n > {MAX_SHARE} * documents),
lost as (
  select doc_id, sum(case when o.line is not null then n else 0 end) / sum(n) as lost
  from all_lines a left join often o on a.host = o.host and a.line = o.line group by doc_id),
counts as (
  select doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '{SPACES}', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from base left join covered c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(lost, 0) <= {MAX_LOST} as kept
from counts left join lost using (doc_id)"""
