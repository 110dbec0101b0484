"""URL verdicts from path rules and, where no rule fits, from a Bloom filter cascade.

The cascade answers exactly whether a key is listed, for every key of the
corpus: level 1 encodes the listed keys, level 2 the keys of the corpus that
pass level 1 by mistake, level 3 the listed keys that pass level 2, and so on until a level
makes no mistake. Keys are host names and all their parent domains.

The keys are dealt into shards of about ``SHARD_KEYS`` by hash, and a task
builds one shard's cascade. Verdicts read the filters, not the keys: there is no
join with urls. Filters are sent to the executors in slices of at most
``SLICE_BYTES``, a pass over the hosts for each slice.

The listed keys are a table of any size, which never comes to the driver.

Defined results: a null url, or one without ``://``, has an empty host and
path; it matches no rule and no key, and is allowed. Rows are judged one by one, so
repeated ones get one verdict each; a table without rows gives none. Input columns
named host, path, rule and verdict give way to the results.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskforge.llm.common import table, written

SHARD_KEYS = 200_000
SLICE_BYTES = 32 << 20
#: Bits a key and hash functions of the first level, and of the others.
FIRST, LATER = (10, 7), (5, 3)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path and action of the rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Names of listed sites, under each of the endings.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ENDINGS = ["example.com", "example.net", "example.org"]
LISTED = [f"{name}.{ending}" for name in LISTED_NAMES for ending in LISTED_ENDINGS]


def listed_hosts(spark: SparkSession, hosts: list[str] = LISTED) -> DataFrame:
    """A table of listed keys (column ``key``) from a short list."""
    return spark.createDataFrame([(h,) for h in hosts], "key string")


def hashes_of(key: str) -> tuple[int, int]:
    h = blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1


class Bloom:
    def __init__(self, keys: list[str], level: int):
        per_key, self.k = LATER if level else FIRST
        self.level, self.m = level, max(64, per_key * len(keys))
        bits = np.zeros(self.m, dtype=bool)
        for key in keys:
            bits[list(self.places(key))] = True
        self.bits = np.packbits(bits).tobytes()

    def places(self, key: str) -> Iterator[int]:
        a, b = hashes_of(f"{self.level}|{key}")
        return ((a + i * b) % self.m for i in range(self.k))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (7 - (p & 7)) & 1 for p in self.places(key))


def cascade(listed: list[str], others: list[str]) -> list[Bloom]:
    """Levels that tell the listed keys from the others exactly."""
    levels: list[Bloom] = []
    encoded, rest = sorted(set(listed)), sorted(set(others) - set(listed))
    while encoded:
        level = Bloom(encoded, len(levels))
        levels.append(level)
        encoded, rest = [key for key in rest if key in level], encoded
    return levels


def passes(levels: list[Bloom], key: str) -> bool:
    """True if the first level that rejects the key is one of false positives."""
    for i, level in enumerate(levels):
        if key not in level:
            return i % 2 == 1
    return len(levels) % 2 == 1


def parents(host: str) -> list[str]:
    """The host and its parent domains."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def shard_of(key: str, shards: int) -> int:
    return hashes_of(key)[0] % shards


def build(keys: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(rows of shard and pickled levels, number of shards) for the distinct ``key`` columns of ``keys`` and ``listed``."""
    wanted = listed.select("key").where("key is not null").withColumn("listed", F.lit(True))
    known = keys.select("key").where("key is not null").distinct().withColumn("listed", F.lit(False)).unionByName(wanted)
    known = known.groupBy("key").agg(F.max("listed").alias("listed"))
    known = written(known, "keys")
    shards = max(1, math.ceil(known.count() / shard_keys))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shard_of(k, shards) for k in batch.column(0).to_pylist()], pa.int32())], names=["key", "listed", "shard"])

    def made(shard: pa.Table) -> pa.Table:
        rows = list(zip(shard["key"].to_pylist(), shard["listed"].to_pylist(), strict=True))
        levels = cascade([k for k, is_listed in rows if is_listed], [k for k, is_listed in rows if not is_listed])
        return pa.table({"shard": shard["shard"][:1].cast(pa.int32()), "levels": pa.array([pickle.dumps(levels)], pa.binary())})

    parts = known.mapInArrow(dealt, "key string, listed boolean, shard int")
    return written(parts.groupBy("shard").applyInArrow(made, "shard int, levels binary"), "filters"), shards


def with_listed(df: DataFrame, filters: DataFrame, shards: int, host: str = "host", name: str = "listed") -> DataFrame:
    """``df`` with a boolean column: the host or a parent of it is listed."""
    spark = df.sparkSession
    sizes = filters.select("shard", F.octet_length("levels").alias("n")).orderBy("shard").toLocalIterator()
    slices: list[list[int]] = [[]]
    filled = 0
    for r in sizes:
        if slices[-1] and filled + r["n"] > SLICE_BYTES:
            slices.append([])
            filled = 0
        slices[-1].append(r["shard"])
        filled += r["n"]
    out = df.drop(name).withColumn(name, F.lit(False))
    at = out.columns.index(host)
    for some in slices:
        if not some:
            continue
        got = filters.where(F.col("shard").between(some[0], some[-1])).collect()
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["levels"]) for r in got})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            levels = {k: pickle.loads(v) for k, v in shared.value.items()}
            for batch in batches:
                hosts = batch.column(at).to_pylist()
                found = {h: any(passes(levels[s], k) for k in parents(h) if (s := shard_of(k, shards)) in levels) for h in set(hosts) if h}
                new = [was or found.get(h, False) for was, h in zip(batch.column(batch.num_columns - 1).to_pylist(), hosts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.bool_())], names=batch.schema.names)

        out = out.mapInArrow(run, StructType([*out.schema.fields]))
        if len(slices) > 1:
            out = written(out, "listed")
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judged(pages: DataFrame, listed: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names give way. ``listed`` is a table with a column ``key`` (default: ``LISTED``)."""
    listed = listed_hosts(pages.sparkSession) if listed is None else listed
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    universe = parsed.select("host").where("host <> ''").distinct().select(F.explode(keys).alias("key"))
    filters, shards = build(universe, listed)
    found = with_listed(parsed, filters, shards)
    rule = rule_of(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1])
    action = rule_of(F.col("host"), F.col("path"), rules, lambda r: r[2])
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))).drop("listed")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def oracle() -> str:
    fit = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    rule = " ".join(f"when {fit(h, p)} then '{h}{p}'" for h, p, _ in ordered)
    action = " ".join(f"when {fit(h, p)} then '{a}'" for h, p, a in ordered)
    listed = ", ".join(f"'{k}'" for k in LISTED)
    return f"""
with cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages),
parsed as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
keys as (select unnest([{listed}]) as k)
select page_id, host, path, case {rule} end as rule,
       case {action} when exists (select 1 from keys where host = k or ends_with(host, '.' || k)) then 'block' else 'allow' end as verdict
from parsed"""
