"""Secrets: patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a run of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]``,
with the ``=`` that pad it, wherever it stands: a pattern's span doesn't hide it,
nor does a match that a pattern drops. Its encoding is inferred from its characters
(hexadecimal, base 32, letters and digits, base 64), and four tests ask whether
it can be uniform over that alphabet: chi-squared over the characters and over
their classes, a runs test above and below the alphabet's middle, and lag-one
serial correlation. The candidate's p comes from the least of the four (Sidak).
Words, names and paths get p near 0; random strings get p spread over 0 to 1.

How small a p may be is set for each encoding and class of length (doublings), from the
counts of all documents: the share of p above ``LAMBDA`` estimates how many
candidates are random, and the smallest p of ``GRID`` is taken at which at most
``FDR`` of the accepted ones are expected not to be. ``PRIOR`` random candidates
are added to each count, so that the same rule holds for few candidates as for many.
The counts are one row for each encoding and length class.

``LEAST`` is the shortest length at which a capitalised word gets a p under the
least of ``GRID`` from its classes alone. So a run of one class of characters,
or one capital before small letters, can't be accepted; the pattern of the
candidates leaves such runs out, which changes no result.

All is built-in functions: one pass over the texts, whose spans are written, and
one over the spans. Places are code points, ends exclusive.

Defined results: null and empty texts have no spans; a pattern's match that is
too short is dropped; candidates never overlap each other, but may lie in a pattern's
span. Each row is judged by itself, so equal rows have equal spans; a table
without rows gives none. Input columns named as results (n_assign, n_access,
n_hex, base_spans, spans) give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.common import table, written
from maskforge.llm.quality import let

LEAST = 12
FDR = 0.1
LAMBDA = 0.5
GRID = [0.01, 0.02, 0.05, 0.1, 0.2, 0.4]
PRIOR = 20
TESTS = 4
#: The patterns, the group whose length counts, and its least length; letters of the names in either case.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Words of which one stands in any text that the first pattern matches, in lower case.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
RUN = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{RUN})(?!(?:[A-Z]?[a-z]+|[A-Z]+|[0-9+/_-]+)(?!{RUN})){RUN}{{{LEAST},}}+={{0,2}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SPAN = "struct<start:int,kind_no:int,kind:string,end:int>"
NO_SPANS = f"array<{SPAN}>"
RANDOM_NO = len(KINDS)


def starts_of(text: Column, pattern: str, matches: Column) -> Column:
    """Place of each match: what is between the matches and the matches before it."""
    gaps = F.split(text, pattern, -1)

    def placed(g: Column) -> Column:
        def walk(m: Column) -> Column:
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda s, i: F.struct(
                (s["at"] + F.length(F.get(g, i)) + F.length(F.get(m, i))).alias("at"),
                F.array_append(s["out"], s["at"] + F.length(F.get(g, i))).alias("out"),
            )
            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), first, step, lambda s: s["out"])

        return let(matches, walk)

    return let(gaps, placed)


def spans_of(text: Column, kind_no: int) -> Column:
    kind, pattern, group, least = KINDS[kind_no]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def spans(m: Column) -> Column:
        made = F.zip_with(starts_of(text, pattern, m), m, lambda s, x: F.struct(s.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (s + F.length(x)).alias("end")))
        return F.filter(F.zip_with(made, values, lambda s, v: F.when(F.length(v) >= least, s)), lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(NO_SPANS)).cast(NO_SPANS)


def upper_tail(z: Column) -> Column:
    """Chance of a normal variable above z, to about 1e-3."""
    a = F.abs(z)
    tail = 0.5 * F.exp(-0.717 * a - 0.416 * a * a)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi_tail(value: Column, freedom: Column) -> Column:
    """Chance of a chi-squared variable above the value, by the cube-root rule."""
    f = F.greatest(freedom.cast("double"), F.lit(1.0))
    return upper_tail((F.pow(value / f, 1 / 3) - (1 - 2 / (9 * f))) / F.sqrt(2 / (9 * f)))


def encoding_of(token: Column) -> Column:
    """Size of the smallest usual alphabet that has the characters; a candidate has characters of two classes, so hexadecimal and base 32 have digits and letters."""
    return F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)=*$"), 16).when(token.rlike("^[A-Z2-7]+=*$"), 32).when(token.rlike("^[A-Za-z0-9]+=*$"), 62).otherwise(64)


def randomness(token: Column, encoding: Column) -> Column:
    """p of the battery for one token."""
    plain = F.translate(F.translate(token, "-_", "+/"), "=", "")
    return let(F.struct(encoding.alias("e"), F.when(encoding == 16, F.lower(plain)).otherwise(plain).alias("t")), lambda x: battery(x["t"], x["e"]))


def battery(plain: Column, encoding: Column) -> Column:
    n = F.length(plain).cast("double")
    alphabet = F.when(encoding == 16, ALPHABET[52:62] + ALPHABET[26:32]).when(encoding == 32, ALPHABET[:26] + ALPHABET[54:60]).otherwise(ALPHABET)
    chars = F.split(plain, "")
    codes = F.transform(chars, lambda x: (F.position(x, alphabet) - 1).cast("double"))
    a = encoding.cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    # chi-squared over characters: the sum of squared counts is the number of ordered pairs of equal ones
    equal = F.aggregate(chars, F.lit(0.0), lambda s, x: s + n - F.length(F.replace(plain, x, F.lit(""))))
    uniform = chi_tail(F.greatest(a / n * equal - n, F.lit(0.0)), a - 1)
    # chi-squared over classes of characters
    count = lambda members: n - F.length(F.translate(plain, members, ""))
    upper, lower, digit = (count(ALPHABET[i:j]) for i, j in ((0, 26), (26, 52), (52, 62)))
    part = lambda seen, share: (seen - n * share) * (seen - n * share) / (n * share)
    classes = F.when(encoding == 16, part(digit, 10 / 16) + part(n - digit, 6 / 16)).when(encoding == 32, part(digit, 6 / 32) + part(n - digit, 26 / 32))
    classes = classes.otherwise(part(upper, 26 / 63) + part(lower, 26 / 63) + part(n - upper - lower, 11 / 63))
    by_class = chi_tail(classes, F.when(encoding <= 32, 1).otherwise(2))
    # runs above and below the middle, and correlation of neighbours
    high = F.transform(codes, lambda v: (v >= (a / 2)).cast("double"))

    def runs(h: Column) -> Column:
        ones = total(h)
        zeros = n - ones
        changes = total(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: F.coalesce(F.abs(x - y), F.lit(0.0))))
        mean = 2 * ones * zeros / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        return F.when((ones == 0) | (zeros == 0), F.lit(0.0)).otherwise(2 * upper_tail(F.abs(changes + 1 - mean) / spread))

    def serial(v: Column) -> Column:
        mean = total(v) / n
        off = F.transform(v, lambda x: x - mean)
        lagged = total(F.zip_with(off, F.slice(off, 2, F.size(off)), lambda x, y: F.coalesce(x * y, F.lit(0.0))))
        square = F.greatest(total(F.transform(off, lambda x: x * x)), F.lit(1e-9))
        return 2 * upper_tail(F.abs(lagged / square * F.sqrt(n)))

    least = F.least(uniform, by_class, let(high, runs), let(codes, serial), F.lit(1.0))
    return 1 - F.pow(1 - least, F.lit(float(TESTS)))


def candidates(text: Column) -> Column:
    """(start, end, encoding, p) of each candidate."""

    def made(m: Column) -> Column:
        placed = F.zip_with(starts_of(text, CANDIDATE, m), m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), encoding_of(x).alias("encoding"), x.alias("token")))
        return F.transform(placed, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), randomness(c["token"], c["encoding"]).alias("p")))

    kind = "array<struct<start:int,end:int,encoding:int,p:double>>"
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    return let(found, lambda m: F.when(F.size(m) > 0, made(m))).cast(kind)


def length_class(c: Column) -> Column:
    return F.floor(F.log2((c["end"] - c["start"]).cast("double"))).cast("int")


def least_p(tried: DataFrame) -> dict[tuple[int, int], float]:
    """The p that a candidate of each encoding and length class needs, from all candidates."""
    found = tried.select(F.explode("tried").alias("c")).select(F.col("c.encoding").alias("encoding"), length_class(F.col("c")).alias("size"), F.col("c.p").alias("p"))
    sums = [F.sum((F.col("p") >= g).cast("int")).alias(f"g{k}") for k, g in enumerate(GRID)]
    out = {}
    for r in found.groupBy("encoding", "size").agg(F.sum((F.col("p") > LAMBDA).cast("int")).alias("above"), *sums).collect():
        out[r["encoding"], r["size"]] = strictest(r["above"], [r[f"g{k}"] for k in range(len(GRID))])
    return out


def strictest(above: int, passing: list[int]) -> float:
    """The least p of the grid whose accepted candidates are random but for ``FDR``, else the largest; from the numbers above ``LAMBDA`` and above each p of the grid."""
    random = above / (1 - LAMBDA) + PRIOR
    for g, n in zip(GRID, passing, strict=True):
        accepted = n + PRIOR * (1 - g)
        if 1 - min(1.0, random * (1 - g) / accepted) <= FDR:
            return g
    return GRID[-1]


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans, both arrays by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.lower(text)
    maybe = F.lit(False)
    for name in NAMES:
        maybe = maybe | named.contains(name)
    none = F.array().cast(NO_SPANS)
    made = docs.drop("n_assign", "n_access", "n_hex", "base_spans", "spans").withColumn("_base", F.array_sort(F.concat(F.when(maybe, spans_of(text, 0)).otherwise(none), F.when(text.contains("AKIA"), spans_of(text, 1)).otherwise(none), spans_of(text, 2))))
    made = made.withColumn("_tried", candidates(text))
    made = written(made.drop("text"), "spans")
    needed = least_p(made.select(F.col("_tried").alias("tried")))

    def asked(c: Column) -> Column:
        out = F.lit(GRID[-1])
        for (encoding, size), p in needed.items():
            out = F.when((c["encoding"] == encoding) & (length_class(c) == size), F.lit(p)).otherwise(out)
        return out

    tried = F.coalesce("_tried", F.array().cast("array<struct<start:int,end:int,encoding:int,p:double>>"))
    more = F.transform(F.filter(tried, lambda c: c["p"] >= asked(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(RANDOM_NO).alias("kind_no"), F.lit("random").alias("kind"), c["end"].alias("end")).cast(SPAN))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind_no"] == k)).cast("long")
    made = made.withColumns({f"n_{KINDS[k][0]}": count(k) for k in range(len(KINDS))})
    return made.withColumn("spans", F.array_sort(F.concat("_base", more))).withColumnRenamed("_base", "base_spans").drop("_tried")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
