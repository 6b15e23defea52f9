"""Text corpora: cleaning, exact and near duplicates, n-gram models, byte-pair vocabularies."""

from __future__ import annotations

import json
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocal.functions.clean import BROKEN_CORPUS, fix_encoding, redact, redactions, strip, strip_html, voted_language
from brocal.operators.skew import block_pairs, hot_limit, left_back
from brocal.session import cut, partitions, shared_folder, ship
from brocal.sources import store

#: Words of a shingle, and the similarity from which texts are near duplicates.
WORDS, SIMILAR = 5, 0.8
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[.,;:¿?¡!]"
MERSENNE = 2**31 - 1
#: Buckets in which shingles are counted (a byte each), and those of one row.
BUCKETS, PART = 2**26, 2**20
BUCKET_SHIFT = np.uint64(64 - 26)
#: Words of which shingles are made at a time.
CHUNK = 1_000_000
#: 64-bit numbers of the parities of any text, and bits for a shingle in those of a long one.
LONGS, BITS = 4, 0.75
#: Pairs whose texts are picked by broadcast, and copies that are left out by it.
FEW = 500_000


# ---------------------------------------------------------------- cleaning


def corpus_stats(df: DataFrame) -> DataFrame:
    """fuente, documentos, caracteres, media of each source."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("documentos"), F.sum(F.length("text")).alias("caracteres"), F.round(F.avg(F.length("text")), 1).alias("media"))


def length_classes(df: DataFrame, least: int = 100, most: int = 10_000) -> DataFrame:
    n = F.length("text")
    return df.groupBy(F.when(n < least, "too_short").when(n > most, "too_long").when(n.isNotNull(), "kept").alias("clase")).agg(F.count(F.lit(1)).alias("documentos"))


def language_quality(df: DataFrame, target: str = "es") -> DataFrame:
    """precision, recall of the stop-word vote against the declared language, for texts that are not in the target."""
    d = df.where("text is not null and lang is not null").select((voted_language("text") != target).alias("said"), (F.lower("lang") != target).alias("true"))
    both = F.count_if(F.col("said") & F.col("true"))
    return d.agg(F.round(both / F.count_if("said"), 6).alias("precision"), F.round(both / F.count_if("true"), 6).alias("recall"))


def cleaned(df: DataFrame, least: int = 100, most: int = 10_000, target: str = "es") -> DataFrame:
    """Encoding, markup, personal data, length and language, in this order: the texts that stay."""
    d = df.where("text is not null").withColumn("text", redact(strip_html(fix_encoding("text", BROKEN_CORPUS))))
    return d.where(F.length("text").between(least, most) & (voted_language("text") == target))


def cleaning_report(df: DataFrame) -> DataFrame:
    """antes and despues: documentos, caracteres; redactions of the first."""
    def row(d, name):
        return d.agg(F.count(F.lit(1)).alias("documentos"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("caracteres")).withColumn("momento", F.lit(name))

    return row(df.where("text is not null"), "antes").unionByName(row(cleaned(df), "despues"))


def redaction_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(redactions("text")), F.lit(0)).cast("bigint").alias("redacciones"), F.count_if(redactions("text") > 0).alias("documentos"))


# ---------------------------------------------------------------- duplicates


def exact_classes(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, clase (least key of the same stripped text), copias; null texts are left out.

    Classes come from an aggregation by hash; only texts of more than one row
    meet their class by the hash again, those of many rows by broadcast.
    """
    rows = df.where("text is not null").select(key, F.md5(strip("text")).alias("h"))
    many = rows.groupBy("h").agg(F.min(key).alias("clase"), F.count(F.lit(1)).alias("copias")).where("copias > 1").withColumn("__n", F.col("copias"))
    out = left_back(rows, many, ["h"], "__n", hot_limit(df.count()))
    return out.select(key, F.coalesce("clase", key).alias("clase"), F.coalesce("copias", F.lit(1)).alias("copias"))


def exact_report(df: DataFrame) -> DataFrame:
    """total, unicos, duplicados."""
    per = df.where("text is not null").groupBy(F.md5(strip("text")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unicos")).withColumn("duplicados", F.col("total") - F.col("unicos"))


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0)


def shingles(w: Column, size: int = WORDS) -> Column:
    """The distinct shingles of so many words of a list of words; of a shorter list, all its words as one.

    `w` must be a column of a table, not an expression: the lambda reads it for each shingle.
    """
    many = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.array_distinct(F.when(F.size(w) > size, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def _shingled(df: DataFrame, key: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """`key`, s (sorted distinct shingles) of each text with any word."""
    d = df.where(F.col(text).isNotNull()).select(key, words_of(text).alias("w")).where(F.size("w") > 0)
    return d.select(key, F.array_sort(shingles(F.col("w"), words)).alias("s"))


def minima(rows: int = 64, seed: int = 42, hash: str = "h") -> list[Column]:
    """Aggregates of a signature: so many minima of (a x + b) mod p over 31-bit hashes, in which partial results combine before any shuffle."""
    r = random.Random(seed)
    return [F.min((F.lit(r.randrange(1, MERSENNE)).cast("bigint") * F.col(hash) + r.randrange(MERSENNE)) % MERSENNE).alias(f"m{i}") for i in range(rows)]


def _signed(sets: DataFrame, key: str, rows: int) -> DataFrame:
    # not explode: the filter that it implies would be pushed below and count the words again for each shingle
    hashed = sets.select(key, F.explode_outer("s").alias("t")).select(key, F.pmod(F.xxhash64("t"), F.lit(MERSENNE)).alias("h"))
    return hashed.groupBy(key).agg(*minima(rows)).select(key, F.array(*[f"m{i}" for i in range(rows)]).alias("firma"))


def signatures(df: DataFrame, key: str = "doc_id", rows: int = 64, words: int = WORDS) -> DataFrame:
    """`key`, firma of each text with any word."""
    return _signed(_shingled(df, key, words=words), key, rows)


def _sets(df: DataFrame, key: str, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of all texts, rep the least key with the same set of shingles; and (id, s) with the set of each rep."""
    d = cut(_shingled(df, key, words=words).withColumn("h", F.md5(F.array_join("s", "\n"))))
    reps = d.groupBy("h").agg(F.min(key).alias("rep"))
    members = d.select(key, "h").join(reps, "h").select(key, "rep")
    return members, d.join(reps.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("id"), "s")


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _distinct(w: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each text has, and their sorted distinct 64-bit hashes; of texts of `n` words given as hashes `w`. See `shingles`."""
    r = random.Random(words)
    factors = [np.uint64(r.getrandbits(64) | 1) for _ in range(words + 1)]
    at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    rest = np.repeat(n, n) - at
    # the number of words counts too, as a short text is one shingle
    h = np.minimum(rest, words).astype(np.uint64) * factors[words]
    for j in range(min(words, len(w))):
        h[: len(w) - j] += np.where(rest[: len(w) - j] > j, w[j:] * factors[j], np.uint64(0))
    h = _mixed(h[(rest >= words) | (at == 0)])
    n = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    for start, end in zip(np.cumsum(n) - n, np.cumsum(n), strict=True):
        h[start:end].sort()
    row = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(n)), h[new]


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, numbers of shingles, their hashes, of CHUNK words at a time."""
    for batch in batches:
        ids, ends = batch.column("id"), batch.column("w").offsets.to_numpy().astype(np.int64)
        w, ends, at = batch.column("w").flatten().to_numpy().view(np.uint64), ends - ends[0], 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
            yield ids.slice(at, to - at), *_distinct(w[ends[at] : ends[to]], np.diff(ends[at : to + 1]), words)
            at = to


class _Counts:
    """(part, counts): of each bucket in the part, how many shingles of texts fell into it, 255 at most."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.uint8)
        for _, _, h in _chunks(batches, self.words):
            at = np.sort(h >> BUCKET_SHIFT)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
            at, n = at[first], np.diff(np.r_[first, len(at)])
            table[at] = np.minimum(table[at] + n, 255)
        for part in range(BUCKETS // PART):
            if (x := table[part * PART : (part + 1) * PART]).any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})


def _added(parts: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.uint32)
    for x in parts.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
    total = np.minimum(total, 255).astype(np.uint8)
    return pa.table({"part": parts.column("part").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _parities(row: np.ndarray, h: np.ndarray, longs: np.ndarray) -> pa.Array:
    """Of each row as many 64-bit numbers as `longs` says, a power of two or none: a bit is set where an odd number of hashes fall on it."""
    first, own = (np.cumsum(longs) - longs) * 64, longs[row]
    h, first, own = h[own > 0], first[row][own > 0], own[own > 0]
    bits = np.bincount(first + (h & (own * 64 - 1).astype(np.uint64)).astype(np.int64), minlength=int(longs.sum()) * 64) & 1
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(longs)], pa.int32()), pa.array(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)))


class _Summaries:
    """Of each text with any word: n shingles, two sums of their hashes, their parities, and those of its rarest shingles that other texts have too."""

    def __init__(self, counts, similar: float, words: int):
        self.counts, self.similar, self.words = counts, similar, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.uint8)
        for part, x in self.counts.value:
            table[part * PART : (part + 1) * PART] = np.frombuffer(zlib.decompress(x), np.uint8)
        for ids, n, h in _chunks(batches, self.words):
            ids, n = ids.take(pa.array(np.flatnonzero(n))), n[n > 0]
            if not len(n):
                continue
            first, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            x, y = np.add.reduceat(h, first), np.add.reduceat(_mixed(h ^ np.uint64(0x9E3779B97F4A7C15)), first)
            longs = LONGS * 2 ** np.maximum(0, np.ceil(np.log2(n * BITS / (64 * LONGS)))).astype(np.int64)
            # the count before the rest of the hash: the rarest come first
            t = (table[h >> BUCKET_SHIFT].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            for start, end in zip(first, first + n, strict=True):
                t[start:end].sort()
            among = np.arange(len(t)) - first[row] < (n - np.ceil(n * self.similar - 1e-9).astype(int) + 1)[row]
            among &= t >= np.uint64(2 << 56)
            sizes = np.bincount(row[among], minlength=len(n))
            yield pa.RecordBatch.from_pydict({
                "id": ids, "n": pa.array(n, pa.int32()), "x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64)),
                "p": _parities(row, h, np.full(len(n), LONGS)), "wide": _parities(row, h, np.where(longs > LONGS, longs, 0)),
                "t": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(t[among].view(np.int64))),
            })


class _Jaccard:
    """a, b, jaccard of the pairs of texts, as lists of words, that are similar: counted over the shingles themselves."""

    def __init__(self, similar: float, words: int):
        self.similar, self.words = similar, words

    def shingles(self, w: list[str]) -> set[tuple[str, ...]]:
        return set(zip(*(w[j:] for j in range(self.words)), strict=False)) if len(w) > self.words else {tuple(w)}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = self.shingles(x.as_py()), self.shingles(y.as_py())
                both = len(x & y)
                found.append(both / (len(x) + len(y) - both))
            keep = pa.array([i for i, j in enumerate(found) if j >= self.similar], pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(keep), "b": batch.column("b").take(keep), "jaccard": pa.array(found, pa.float64()).take(keep)})


def _differing(x: Column, y: Column) -> Column:
    """How many bits of two lists of numbers differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _folded(x: Column, y: Column) -> Column:
    """Parities `x` by half as many bits where those of `y` are half as many."""
    n = F.size(y)
    return F.when(F.size(x) == 2 * n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)


def similar_pairs(df: DataFrame, key: str = "doc_id", similar: float = SIMILAR, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Members of classes of equal shingle sets, and the pairs (a, b, jaccard) of different sets that are similar, none left out.

    Two sets that reach the similarity share one of the rarest few shingles of
    each (prefix filter), whatever order decides what is rare.  So only these
    meet, in a join on the shingle with sets whose size can match; repeated
    texts are one set before.  Two sets differ in as many shingles at least
    as their parities differ in bits, so most pairs go before their texts
    meet.  Similarity is then counted exactly, over the shingles themselves.
    Shingles are 64-bit hashes until then, and how rare one is says a table of
    BUCKETS counts: shingles are made again for each step and never written.
    Texts are read for each step; a filter on words would match them twice.
    """
    spark = df.sparkSession
    ship(spark)
    kind = df.schema[key].dataType.simpleString()
    texts = df.where("text is not null").select(key, "text")
    hashed = texts.select(F.col(key).alias("id"), F.transform(words_of("text"), lambda x: F.xxhash64(x)).alias("w"))
    counts = hashed.mapInArrow(_Counts(words), "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary")
    rare = spark.sparkContext.broadcast([(r["part"], bytes(r["counts"])) for r in counts.collect()])
    docs = cut(hashed.mapInArrow(_Summaries(rare, similar, words), f"id {kind}, n int, x bigint, y bigint, p array<bigint>, wide array<bigint>, t array<bigint>"))
    rows = docs.select("id", "x", "y", "n")
    many = rows.groupBy("x", "y", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    members = cut(left_back(rows, many, ["x", "y", "n"], "__n", hot_limit(docs.count())).select(F.col("id").alias(key), F.coalesce("rep", "id").alias("rep")))
    reps, copies = members.where(F.col(key) == F.col("rep")).select(F.col("rep").alias("id")), members.where(F.col(key) != F.col("rep")).select(F.col(key).alias("id"))
    prefix = docs.where(F.size("t") > 0).select("id", "n", "t")
    # copies are the fewer mostly
    prefix = prefix.join(F.broadcast(copies.join(reps, "id", "left_anti")), "id", "left_anti") if copies.count() <= FEW else prefix.join(reps, "id", "left_semi")
    prefix = prefix.select("id", "n", F.explode("t").alias("t"))
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "t"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    sized = (F.col("na") >= similar * F.col("nb") - 1e-9) & (F.col("nb") >= similar * F.col("na") - 1e-9)
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & sized).select("a", "b", "na", "nb").distinct()
    n = F.col("na") + F.col("nb")
    most = n - 2 * F.ceil(n * (similar / (1 + similar)) - 1e-9)
    x, y = F.col("x"), F.col("y")
    for bits, apart in ((F.col("p"), _differing(x, y)), (F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("p")), F.when(F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y)), _differing(_folded(x, y), _folded(y, x))).otherwise(0))):
        pairs = pairs.join(docs.select(F.col("id").alias("a"), bits.alias("x")), "a").join(docs.select(F.col("id").alias("b"), bits.alias("y")), "b").where(apart <= most).select("a", "b", "na", "nb")
    pairs = cut(pairs.select("a", "b"))
    met = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", key)
    # the texts meet, not the shingles made of them
    full = texts.join(F.broadcast(met) if pairs.count() <= FEW else met, key, "left_semi")
    full = pairs.join(full.select(F.col(key).alias("a"), F.col("text").alias("x")), "a").join(full.select(F.col(key).alias("b"), F.col("text").alias("y")), "b")
    # in Python, as Spark would move a filter below and match the words again for each shingle
    out = full.select("a", "b", words_of("x").alias("x"), words_of("y").alias("y")).mapInArrow(_Jaccard(similar, words), f"a {kind}, b {kind}, jaccard double")
    return members, out


def lsh_pairs(df: DataFrame, key: str = "doc_id", bands: int = 16, width: int = 4, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """a, b, jaccard of different shingle sets that share a band of their signatures and are similar."""
    _, sets = _sets(df, key, words)
    sets = cut(sets)
    sig = _signed(sets, "id", bands * width)
    rows = cut(sig.select("id", F.posexplode(F.array(*[F.xxhash64(F.slice("firma", i * width + 1, width)) for i in range(bands)])).alias("band", "h")))
    pairs = block_pairs(rows, "id", ["band", "h"]).distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", F.round(both / (F.size("sa") + F.size("sb") - both), 6).alias("jaccard")).where(F.col("jaccard") >= similar)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, clase: the least id that each node is connected with (edges a, b).

    Labels spread to neighbours and then jump to the label of their label, so
    rounds are few; each is written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("clase")))
    while True:
        spread = both.join(labels.select(F.col("id").alias("b"), "clase"), "b").groupBy(F.col("a").alias("id")).agg(F.min("clase").alias("m"))
        new = labels.join(spread, "id", "left").select("id", F.least("clase", F.coalesce("m", "clase")).alias("clase"), F.col("clase").alias("old"))
        jump = new.join(new.select(F.col("id").alias("clase"), F.col("clase").alias("c2")), "clase").select("id", F.least("clase", "c2").alias("clase"), "old")
        new = cut(jump)
        labels = new.select("id", "clase")
        if new.where("clase != old").isEmpty():
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """`key`, clase, enlaces: class of connected near duplicates (its least key) and the number of different texts similar to this one.

    Texts without words or null are in no class, nor are those of which no
    copy has a key.  Equal shingle sets count as one text.
    """
    members, pairs = similar_pairs(df, key, similar)
    members = members.where("rep is not null")
    pairs = cut(pairs)
    degree = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("enlaces"))
    linked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    classes = components(linked, pairs)
    return members.join(classes.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left").select(key, F.coalesce("clase", "rep").alias("clase"), F.coalesce("enlaces", F.lit(0)).alias("enlaces"))


def similarity_degrees(pairs: DataFrame, top: int = 20) -> DataFrame:
    """id, vecinos, media of the texts with the most neighbours in a similarity graph."""
    pairs = cut(pairs)
    both = pairs.select(F.col("a").alias("id"), "jaccard").unionByName(pairs.select(F.col("b").alias("id"), "jaccard"))
    per = both.groupBy("id").agg(F.count(F.lit(1)).alias("vecinos"), F.avg("jaccard").alias("m"))
    # by the mean itself, but for what the order of its sum changes
    return per.orderBy(F.desc("vecinos"), F.desc(F.round("m", 12)), "id").limit(top).select("id", "vecinos", F.round("m", 6).alias("media"))


# ---------------------------------------------------------------- n-gram model


def grams(df: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """contexto (n - 1 tokens), token of every position, with the ends of each text marked."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    whole = F.concat(F.array(*[F.lit("<s>")] * (n - 1)), toks, F.array(F.lit("</s>")))
    d = df.where(F.col(text).isNotNull()).select(whole.alias("w"))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.array_join(F.slice("w", i, n - 1), " ").alias("contexto"), F.get("w", i + n - 2).alias("token")))
    return d.select(F.explode(each).alias("g")).select("g.*")


def ngram_counts(df: DataFrame, n: int = 3) -> DataFrame:
    """contexto, token, veces."""
    return grams(df, n).groupBy("contexto", "token").agg(F.count(F.lit(1)).alias("veces"))


def lm_stats(counts: DataFrame) -> DataFrame:
    """contextos, tipos (distinct tokens, and the mark of the beginning), veces."""
    return counts.agg(F.count_distinct("contexto").alias("contextos"), (F.count_distinct("token") + 1).alias("tipos"), F.sum("veces").alias("veces"))


def perplexity(counts: DataFrame, texts: DataFrame, n: int = 3, add: float = 0.1) -> DataFrame:
    """tokens, perplejidad of texts under the counts: add-`add` smoothing; unigrams where a context was never seen."""
    counts = cut(counts)
    totals = counts.groupBy("contexto").agg(F.sum("veces").alias("tc"))
    uni = counts.groupBy("token").agg(F.sum("veces").alias("u"))
    whole = F.broadcast(counts.agg((F.count_distinct("token") + 1).alias("v"), F.sum("veces").alias("t")))
    seen = grams(texts, n).groupBy("contexto", "token").agg(F.count(F.lit(1)).alias("k"))
    d = seen.join(counts, ["contexto", "token"], "left").join(totals, "contexto", "left").join(uni, "token", "left").join(whole)
    p = F.when(F.col("tc").isNotNull(), (F.coalesce("veces", F.lit(0)) + add) / (F.col("tc") + add * F.col("v"))).otherwise((F.coalesce("u", F.lit(0)) + add) / (F.col("t") + add * F.col("v")))
    return d.agg(F.sum("k").alias("tokens"), F.round(F.exp(-F.sum(F.col("k") * F.log(F.greatest(p, F.lit(1e-12)))) / F.sum("k")), 4).alias("perplejidad"))


def compare_training(dirty: DataFrame, clean: DataFrame, valid: DataFrame, n: int = 3) -> DataFrame:
    """modelo, tokens, perplejidad of the same texts under a model of dirty and one of clean texts."""
    return perplexity(ngram_counts(dirty, n), valid, n).withColumn("modelo", F.lit("sucio")).unionByName(perplexity(ngram_counts(clean, n), valid, n).withColumn("modelo", F.lit("limpio")))


def drawn(counts: DataFrame, by: Sequence[str], draws: int, temperature: float, seed: int) -> DataFrame:
    """`by`, tokens: so many tokens of each context, drawn with a chance of veces ** (1 / temperature).

    The greatest of log(veces) / temperature plus Gumbel noise is such a draw,
    so it is an aggregation with partial results; the noise is a hash.
    """
    def noise(i: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), *by, "token"), 11) + 0.5) * F.lit(2.0**-53)
        return -F.log(-F.log(u))

    weight = F.log("veces") / max(0.1, temperature)
    made = counts.groupBy(*by).agg(*[F.max_by("token", F.struct(weight + noise(i), "token")).alias(f"t{i}") for i in range(draws)])
    return made.select(*by, F.array(*[f"t{i}" for i in range(draws)]).alias("tokens"))


def generate(counts: DataFrame, prompt: str = "", most: int = 50, temperature: float = 0.8, seed: int = 42, n: int = 3, draws: int = 8) -> str:
    """A text that follows the model from a prompt, to the end of a text or `most` tokens.

    The next tokens of all contexts are drawn beforehand, in one pass over the
    counts, and written to the shared folder by hash of the context; each step
    then reads one row of one bucket.  A context that never occurred is
    followed by a token of the whole corpus.  The i-th step takes the draw
    i mod `draws`.
    """
    spark = counts.sparkSession
    folder, buckets = f"{shared_folder(spark)}/generate-{uuid.uuid4().hex}", partitions(spark)
    bucket = F.pmod(F.xxhash64("contexto"), F.lit(buckets)).cast("int")
    try:
        drawn(counts, ["contexto"], draws, temperature, seed).withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(folder)
        anywhere = drawn(counts.groupBy("token").agg(F.sum("veces").alias("veces")), [], draws, temperature, seed).first()
        follow = spark.read.parquet(folder)
        text = re.findall(r"\w+|[.,;:¿?¡!]", prompt.lower())
        window = deque(["<s>"] * (n - 1) + text, maxlen=n - 1)
        for i in range(most):
            key = F.lit(" ".join(window))
            at = follow.where((F.col("bucket") == F.pmod(F.xxhash64(key), F.lit(buckets))) & (F.col("contexto") == key)).first() or anywhere
            token = at["tokens"][i % draws]
            if token is None or token == "</s>":
                break
            text.append(token)
            window.append(token)
    finally:
        store.delete(folder)
    return re.sub(r" (?=[.,;:?!])", "", " ".join(text))


# ---------------------------------------------------------------- byte-pair vocabulary


END = "</w>"


def word_table(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """palabra, veces, primera (key and position of its first occurrence)."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
    return df.where("text is not null").select(key, F.posexplode(w).alias("pos", "palabra")).groupBy("palabra").agg(F.count(F.lit(1)).alias("veces"), F.min(F.struct(key, "pos")).alias("primera"))


def joined(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """The symbols with each occurrence of the pair, from the left, made one."""
    out: list[str] = []
    for s in symbols:
        # a symbol that was just made can't be the first of another pair, as it is longer than either
        if out and (out[-1], s) == pair:
            out[-1] += s
        else:
            out.append(s)
    return out


def learn_merges(words: list[tuple[str, int]], merges: int) -> list[tuple[str, str]]:
    """The most frequent adjacent pairs, merged one after the other; of equally frequent ones the first to occur in the table.

    Pair counts are kept up to date from the words that a merge changes only.
    """
    table = [[*w, END] for w, _ in words]
    times = [n for _, n in words]
    count: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, s in enumerate(table):
        for p in zip(s, s[1:]):
            count[p] += times[i]
            where[p].add(i)
    out: list[tuple[str, str]] = []
    while len(out) < merges and count:
        most = max(count.values())
        tied = [p for p, n in count.items() if n == most]
        best = tied[0] if len(tied) == 1 else min(tied, key=lambda p: min((i, next(j for j, q in enumerate(zip(table[i], table[i][1:])) if q == p)) for i in [min(where[p])]))
        out.append(best)
        for i in list(where[best]):
            s = table[i]
            for p in zip(s, s[1:]):
                count[p] -= times[i]
                where[p].discard(i)
            table[i] = new = joined(s, best)
            for p in zip(new, new[1:]):
                count[p] += times[i]
                where[p].add(i)
        count = Counter({p: n for p, n in count.items() if n > 0})
    return out


def train_bpe(df: DataFrame, merges: int = 500, key: str = "doc_id") -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Merges and vocabulary of a corpus, from all of its words in order of first occurrence (the driver holds the distinct words)."""
    words = [(r["palabra"], r["veces"]) for r in word_table(df, key).orderBy("primera").select("palabra", "veces").toLocalIterator()]
    made = learn_merges(words, merges)
    tokens = sorted({c for w, _ in words for c in w} | ({END} if words else set())) + [a + b for a, b in made]
    return made, {t: i for i, t in enumerate(dict.fromkeys(tokens))}


class _Bpe:
    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, vocabulary = self.broadcast.value
        rank = {m: i for i, m in enumerate(merges)}
        known: dict[str, list[int]] = {}

        def word(w: str) -> list[int]:
            s = [*w, END]
            while len(s) > 1:
                p = min(zip(s, s[1:]), key=lambda q: rank.get(q, len(rank)))
                if p not in rank:
                    break
                s = joined(s, p)
            return [vocabulary[t] for t in s if t in vocabulary]

        for b in batches:
            out = []
            for words in b.column(1).to_pylist():
                ids: list[int] = []
                for w in words or []:
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = word(w)
                    ids += known[w]
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], [b.schema.names[0], "ids"])


def encode_bpe(df: DataFrame, merges: list[tuple[str, str]], vocabulary: dict[str, int], key: str = "doc_id") -> DataFrame:
    """`key`, ids of each text; characters that the vocabulary lacks are left out, null texts give an empty list."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((merges, vocabulary))
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0).alias("w")).mapInArrow(_Bpe(shared), f"`{key}` {kind}, ids array<int>")


def decode_bpe(ids: list[int], vocabulary: dict[str, int]) -> str:
    names = {i: t for t, i in vocabulary.items()}
    return "".join(names.get(i, "") for i in ids).replace(END, " ").strip()


def write_shards(encoded: DataFrame, folder: str, share: float = 0.9, vocabulary: dict[str, int] | None = None, key: str = "doc_id") -> DataFrame:
    """Ids as parquet shards by side (parte=train, parte=val: by the hash of the key), written by the executors, and vocab.json; parte, documentos, tokens.

    A row is a document with its ids, so a trainer may read any number of
    shards at once, in any order.
    """
    from brocal.operators.ranking import split

    sides = split(encoded, key, share).withColumn("parte", F.when(F.col("parte") == "train", "train").otherwise("val"))
    sides.write.mode("overwrite").partitionBy("parte").parquet(f"{folder}/ids")
    if vocabulary is not None:
        store.write_text(f"{folder}/vocab.json", json.dumps(vocabulary, ensure_ascii=False))
    written = encoded.sparkSession.read.parquet(f"{folder}/ids")
    return written.groupBy("parte").agg(F.count(F.lit(1)).alias("documentos"), F.sum(F.size("ids")).cast("bigint").alias("tokens"))


def vocabulary_stats(df: DataFrame, encoded: DataFrame, merges: Sequence[tuple[str, str]], vocabulary: dict[str, int], key: str = "doc_id") -> DataFrame:
    """metrica, valor: size of the vocabulary, merges, documents, characters, tokens, characters a token, tokens that occur."""
    chars = df.where("text is not null").agg(F.count(F.lit(1)).cast("double").alias("documentos"), F.sum(F.length("text")).cast("double").alias("caracteres"))
    used = encoded.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("tokens"), F.count(F.lit(1)).cast("double").alias("usados"))
    one = chars.join(used).withColumns({"vocabulario": F.lit(float(len(vocabulary))), "fusiones": F.lit(float(len(merges))), "caracteres_por_token": F.round(F.col("caracteres") / F.col("tokens"), 4)})
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metrica"), F.col(c).alias("valor")) for c in one.columns])).alias("x")).select("x.*")


def tokens_of(encoded: DataFrame, vocabulary: dict[str, int], key: str = "doc_id") -> DataFrame:
    """`key`, tokens: the names of the ids, in order."""
    spark = encoded.sparkSession
    names = [t for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
    table = F.broadcast(spark.createDataFrame([(names,)], "names array<string>"))
    return encoded.join(table).select(key, F.transform("ids", lambda i: F.get("names", i)).alias("tokens"))
