"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's set of word shingles gets a signature of ``COORDINATES``
coordinates, each made of the minima of ``ROWS`` random hash functions, so two sets of similarity s
agree in a coordinate with probability s**ROWS. A link of s >= 0.8 agrees in 16 of 32 on
average and in fewer than ``MATCHES`` about once in 270 million links.

1. Documents with equal sets form a class; only its smallest id goes on.
2. Prefix: sets that agree in ``MATCHES`` coordinates agree in one of the first
   ``COORDINATES - MATCHES + 1``, so only those are posted, under (coordinate,
   value). The smallest id under a posting is its head; a document is a member
   of each head that it meets. All documents that share a posting share its head.
3. Each head's members are compared in one task, or if many, in blocks. A
   document's posting lists are merged and its collisions with each other member counted;
   the ``MATCHES - 1`` longest lists are skipped in the merge, as whoever reaches
   the threshold stands in another list too, and are looked up for those only that
   do. Pairs under the threshold go, and the rest are confirmed on the full sets. Pairs that are in one component
   already need no comparison, so a group of copies takes one pass, not all pairs.
4. Heads with several blocks: after components are known, members outside the
   head's largest component are compared with all the others, block by block.
5. Components come from distributed large-star and small-star rounds.

Defined results: null or empty text has an empty set, size 0, and is linked
with nothing; rows that share a doc_id are one document, linked by any of their texts, and
each has its own row in the result; a null doc_id has no
component and is kept. A table without rows gives none; only doc_id and text are
looked at, whatever other columns are called. Sets are held as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.common import hinted, joined_by_weight, pieces, table, written
from maskforge.llm.components import components
from maskforge.llm.shingles import Signer, digest, shingle_set

COORDINATES, ROWS, MATCHES = 32, 3, 2
PREFIX = COORDINATES - MATCHES + 1
#: A block has about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 1_500_000
#: Words of a shingle and percent of similarity, unless a caller has others: op2 takes two words, the pipeline's stage these five.
WORDS, PERCENT = 5, 80


def signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_digest, keys (null if the set can't be similar to another)."""
    least = smallest_partner(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(COORDINATES, ROWS)
        for batch in (p for whole in batches for p in pieces(whole, 1)):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, k)
                sizes.append(len(hashes))
                digests.append(digest(hashes) if len(hashes) else None)
                keys.append(signer.sign(hashes)[:PREFIX] if len(hashes) >= least else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_digest", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_digest binary, keys array<long>"
    )


def smallest_partner(percent: int) -> int:
    """Size of the smallest set that can be linked with a different one: n / (n + 1) must reach the threshold."""
    return -(-percent // max(1, 100 - percent)) if percent < 100 else 1 << 62


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Block:
    """Documents that are compared in one task."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], signs: np.ndarray, percent: int):
        self.ids, self.percent = ids, percent
        # posting lists of each coordinate: the members in order of its value, and where each member's list is
        self.value = np.empty((signs.shape[1], len(ids)), dtype=np.int64)
        self.post = np.argsort(signs, axis=0, kind="stable").T
        self.bounds = []
        for c in range(signs.shape[1]):
            _, self.value[c], n = np.unique(signs[:, c], return_inverse=True, return_counts=True)
            self.bounds.append(np.concatenate(([0], np.cumsum(n))))
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=np.int32)

    def collisions(self, x: int) -> np.ndarray:
        """In how many coordinates each member agrees with ``x``, where that reaches ``MATCHES``, else 0."""
        lists = [self.post[c, self.bounds[c][v] : self.bounds[c][v + 1]] for c, v in enumerate(self.value[:, x].tolist())]
        order = sorted(range(len(lists)), key=lambda c: len(lists[c]))
        merged, skipped = order[: len(order) - MATCHES + 1], order[len(order) - MATCHES + 1 :]
        count = np.bincount(np.concatenate([lists[c] for c in merged]), minlength=len(self.ids))
        met = np.flatnonzero(count)
        count[met] += (self.value[skipped][:, met] == self.value[skipped, x][:, None]).sum(0)
        count[count < MATCHES] = 0
        return count

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are similar enough to document ``x``."""
        n = self.size[x]
        size = self.size[others]
        others = others[100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)]
        if len(others):
            others = others[self.collisions(x)[others] > 0]
        if not len(others):
            return others
        own = self.flat[self.start[x] : self.start[x] + n]
        self.mark[own] = 1
        size, start = self.size[others], self.start[others]
        if len(others) * 3 > len(self.ids):
            both = np.add.reduceat(self.mark[self.flat], self.start)[others]
        else:
            both = np.array([self.mark[self.flat[a : a + s]].sum() for a, s in zip(start.tolist(), size.tolist(), strict=True)])
        self.mark[own] = 0
        return others[100 * both >= self.percent * (n + size - both)]

    def edges(self, x_side: np.ndarray | None = None, component: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning set of the links between documents that aren't in one component yet.

        x_side: if given, only pairs with at least one of these documents are wanted.
        """
        n = len(self.ids)
        forest, done, out = Forest(n), np.zeros(n, dtype=bool), []
        if component is not None:
            _, first, member = np.unique(component, return_index=True, return_inverse=True)
            forest.up = first[member]
        wanted = np.ones(n, dtype=bool) if x_side is None else x_side

        def compare(x: int) -> None:
            roots = forest.roots()
            for y in self.linked(x, np.flatnonzero((roots != roots[x]) & ~done)).tolist():
                if forest.join(x, y):
                    out.append((self.ids[x], self.ids[y]))
            done[x] = True

        if wanted[0]:
            compare(0)
        while True:
            roots = forest.roots()
            largest = np.bincount(roots, minlength=n).argmax() if x_side is None else -1
            left = np.flatnonzero(wanted & ~done & (roots != largest))
            if not len(left):
                return out
            compare(int(left[0]))


def _compared(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) found in each block: rows (head, xb, yb, side, component, rep, text), a block's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(COORDINATES, ROWS)
        key, rows = None, []

        def close() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            rows.sort(key=lambda r: r[:2])
            sets = [r[4] for r in rows]
            block = Block([r[1] for r in rows], sets, np.stack([signer.sign(s) for s in sets]), percent)
            if rows[0][3] is None:
                return block.edges()
            return block.edges(np.array([r[2] == 1 for r in rows]), np.array([r[3] for r in rows]))

        for batch in (p for whole in batches for p in pieces(whole, 6)):
            out: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for head, xb, yb, side, component, rep, text in zip(*columns, strict=True):
                if key != (head, xb, yb):
                    out += close()
                    key, rows = (head, xb, yb), []
                if len(hashes := shingle_set(text, k)):
                    rows.append((rep != head, rep, side, component, hashes))
            yield _pairs(out)
        yield _pairs(close())

    by = ["head", "xb", "yb"]
    rows = members.select(*by, "side", "component", "rep", "text").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, "u long, v long")


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _with_text(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.join(hinted(assigned), "rep")


def links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, n_shingles, rep; links between representatives as (u, v) that keep every component)."""
    sign = written(signed(docs, k, percent), "signed")
    classes = sign.where("doc_id is not null and set_digest is not null").groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    several = hinted(written(classes.where("n > 1").drop("n"), "several"))  # a document alone in its class is its own
    known = sign.join(several, "set_digest", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    known = written(known.withColumn("keys", F.when(F.col("rep") == F.col("doc_id"), F.col("keys"))).drop("set_digest"), "classes")
    postings = known.where("keys is not null").select("rep", "n_shingles", F.explode("keys").alias("key"))
    heads = written(postings.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    met = joined_by_weight(postings, heads, ["key"]).groupBy("head", "rep").agg(F.max("n_shingles").alias("n_shingles"))
    met = written(met, "members")
    blocks = met.groupBy("head").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = written(blocks.where("n > 1").select("head", "n", n_blocks.alias("blocks")), "sizes")
    dealt = joined_by_weight(met, blocks, ["head"]).withColumn("component", F.lit(None).cast("long"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("xb")
    one = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("xb")
    none = [F.lit(0).alias("yb"), F.lit(1).alias("side"), "component", "rep"]
    assigned = dealt.where("rep = head").select("head", every, *none).unionByName(dealt.where("rep <> head").select("head", one, *none))
    assigned = written(assigned, "blocks")
    edges = written(_compared(_with_text(assigned, docs), k, percent), "links")
    many = dealt.where("blocks > 1").drop("component")
    if not many.isEmpty():
        edges = edges.unionByName(_across_blocks(many, edges, docs, k, percent))
    return known, edges


def _across_blocks(many: DataFrame, edges: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that lie in different blocks of a head: what isn't in its largest component against all its members."""
    found = components(edges)
    many = many.join(found, many.rep == found.node, "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    many = written(many, "large")
    sizes = many.groupBy("head", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("head").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    many = many.join(largest, "head")
    x = F.col("component") != F.col("largest")
    shape = many.groupBy("head").agg(F.sum(F.when(x, F.col("n_shingles")).otherwise(0)).alias("xs"), F.sum(F.when(x, 1).otherwise(0)).alias("xn")).where("xn > 0")
    shape = shape.withColumn("x_blocks", F.greatest(F.ceil(F.col("xn") / BLOCK_DOCS), F.ceil(F.col("xs") / BLOCK_SHINGLES)).cast("int")).select("head", "x_blocks")
    many = many.join(shape, "head")
    xb = F.pmod(F.xxhash64(F.lit("x"), "rep"), F.col("x_blocks")).cast("int")
    yb = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    as_x = many.where(x).select("head", xb.alias("xb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("yb"), F.lit(1).alias("side"), "component", "rep")
    as_y = many.select("head", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("xb"), yb.alias("yb"), F.lit(0).alias("side"), "component", "rep")
    grid = written(as_x.unionByName(as_y).groupBy("head", "xb", "yb", "rep").agg(F.max("side").alias("side"), F.max("component").alias("component")), "grid")
    return written(_compared(_with_text(grid, docs), k, percent), "links")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    known, edges = links(docs, k, percent)
    found = components(edges)
    known = known.select("doc_id", "n_shingles", "rep")
    out = known.join(found, known.rep == found.node, "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, its smallest id; rows with a null id stay.

    Of rows that share an id, the one of least text stays (then of least hash).
    Only ids are shuffled, and the rows whose id repeats.
    """
    copies = hinted(written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies"))
    left = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    repeated = hinted(repeated)
    order = F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")), F.xxhash64(*docs.columns))
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
