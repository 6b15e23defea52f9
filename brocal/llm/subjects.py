"""Subject areas of documents, from labelling functions whose accuracies a latent model learns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brocal.llm.prose import parts, raw_words, words
from brocal.session import cut, ship

#: Labelled documents from which the lexicon is fitted, at most; and the longest of them, in characters.
SAMPLE, SAMPLE_CHARS = 20_000, 50_000
#: One in so many of them is kept back for the accuracies.
HELD_BACK = 5
#: Labelled documents that must have a term; smoothing of its subjects; the share that its subject must have.
LEAST, SMOOTH, PURE = 2, 1.0, 0.5
#: Evidence with which a sentence is about a subject.
SENTENCE = 3.0
#: Upper ends of the bins of a subject's share of the prose.
SHARES = (0.04, 0.08, 0.12, 0.15, 0.18, 0.21, 0.24, 0.27, 0.32, 0.4, 0.55, 0.75, 1.01)
#: Times that a subject must be over its general rate in a source to count as usual there; or under it, as unusual.
LIFT = 1.5
#: Posterior from which a subject is assigned.
ASSIGN = 0.5
ROUNDS = 60

#: What the four labelling functions can say: share bin; section and address: nothing (1) or yes; source: unusual, nothing, usual.
WIDTHS = (len(SHARES), 3, 3, 3)


#: Terms that a task counts before it hands them on; characters of documents whose sentences are judged at once.
HELD, AT_ONCE = 300_000, 2_000_000


def terms(tokens: list[str]) -> list[str]:
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def count_terms(subjects: list[str]):
    """term, known (places of the subjects of a document), n (such documents that have the term)."""
    place = {s: i for i, s in enumerate(subjects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], Counter] = {}

        def handed_on() -> pa.RecordBatch:
            rows = [(t, list(known), n) for known, c in total.items() for t, n in c.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int64())], ["term", "known", "n"])

        for b in batches:
            for text, labels in zip(b.column("text").to_pylist(), b.column("labels").to_pylist()):
                known = tuple(sorted(place[x] for x in labels if x in place))
                if text and known:
                    total.setdefault(known, Counter()).update({t for s in parts(text)[0] for t in terms(words(s))})
                    if sum(map(len, total.values())) > HELD:
                        yield handed_on()
        if total:
            yield handed_on()

    return run


def lexicon_of(rows: list, subjects: int) -> dict[str, tuple[int, float]]:
    """Term -> its subject and the evidence for it."""
    if not rows:
        return {}
    m = np.array([[r[f"n{i}"] for i in range(subjects)] for r in rows])
    prior = m.sum(axis=0) / max(1e-9, m.sum())
    n = m.sum(axis=1, keepdims=True)
    p = (m + SMOOTH * prior) / (n + SMOOTH)
    best = p.argmax(axis=1)
    out = {}
    for r, k, x in zip(rows, best.tolist(), p[np.arange(len(m)), best].tolist()):
        w = float(np.log(x / max(prior[k], 1e-9)))
        if x >= PURE and w > 0.7:
            out[r["term"]] = (k, w)
    return out


class _Ids(dict):
    """Numbers of the words of the lexicon by word as written, 0 for others; emptied when there are many."""

    MOST = 500_000

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        got = self[word] = self.known.get(word if word.isascii() else words(word)[0], 0)
        return got


class Voter:
    """The labelling functions."""

    def __init__(self, lexicon: dict[str, tuple[int, float]], subjects: int, sources: dict[str, list[int]]):
        self.lexicon, self.n, self.sources = lexicon, subjects, sources
        number = {w: i + 1 for i, w in enumerate(sorted({w for t in lexicon for w in t.split(" ")}))}
        self.ids, self.size = _Ids(number), len(number) + 1
        self.one = np.zeros(self.size, np.int64), np.zeros(self.size)
        pair = []
        for t, (k, w) in lexicon.items():
            a, _, b = t.partition(" ")
            if b:
                pair.append((number[a] * self.size + number[b], k, w))
            else:
                self.one[0][number[a]], self.one[1][number[a]] = k, w
        pair.sort()
        self.pairs = np.array([x[0] for x in pair], np.int64), np.array([x[1] for x in pair], np.int64), np.array([x[2] for x in pair])

    def subjects(self, sentences: list[str]) -> list[int]:
        """The subject that each sentence is about, or -1."""
        ids, ends = [], []
        for s in sentences:
            ids += map(self.ids.__getitem__, raw_words(s))
            ids.append(0)
            ends.append(len(ids))
        if not ids or not self.n:
            return [-1] * len(sentences)
        ids = np.array(ids, np.int64)
        owner = np.repeat(np.arange(len(ends)), np.diff([0, *ends])) * self.n
        k, w = self.one
        found = np.bincount(owner + k[ids], w[ids], len(ends) * self.n)
        keys, pk, pw = self.pairs
        if len(keys):
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            key = ids[both] * self.size + ids[both + 1]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            found += np.bincount(owner[both[hit]] + pk[at[hit]], pw[at[hit]], len(ends) * self.n)
        found = found.reshape(len(ends), self.n)
        best = found.argmax(axis=1)
        return np.where(found[np.arange(len(ends)), best] > SENTENCE, best, -1).tolist()

    def __call__(self, documents: list[tuple[str, str | None, str | None]]) -> Iterator[list[tuple[int, int]]]:
        """Per document (text, title, source): (subject, pattern of votes) of each subject of which there is any prose."""
        number: dict[str, int] = {}
        cut = []
        for text, title, _ in documents:
            prose, headings, addresses = parts(text)
            cut.append(([number.setdefault(s, len(number)) for s in prose], [number.setdefault(h, len(number)) for h in [*headings, title or ""] if h], addresses))
        about, size = self.subjects(list(number)), [len(s) for s in number]
        for (_, _, source), (prose, headings, addresses) in zip(documents, cut):
            room = [0] * self.n
            for i in prose:
                if about[i] >= 0:
                    room[about[i]] += size[i]
            total = sum(room)
            if not total:
                yield []
                continue
            titled = {about[i] for i in headings}
            addressed = Counter(h[0] for a in addresses for w in words(a) if (h := self.lexicon.get(w)))
            usual = self.sources.get(source or "", None)
            out = []
            for k, r in enumerate(room):
                if r:
                    share = r / total
                    votes = (
                        next(i for i, top in enumerate(SHARES) if share < top),
                        2 if k in titled else 1,
                        2 if addressed[k] else 1,
                        1 if usual is None else usual[k],
                    )
                    pattern = 0
                    for v, width in zip(votes, WIDTHS):
                        pattern = pattern * width + v
                    out.append((k, pattern))
            yield out


def unpack(pattern: int) -> tuple[int, ...]:
    out = []
    for width in reversed(WIDTHS):
        pattern, v = divmod(pattern, width)
        out.append(v)
    return tuple(reversed(out))


class _Vote:
    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = getattr(self.broadcast, "voter", None)
        if voter is None:
            # the worker keeps the broadcast, so all its tasks share one voter
            voter = self.broadcast.voter = Voter(*self.broadcast.value)
        for b in batches:
            texts, titles, sources = (b.column(c).to_pylist() for c in ("text", "title", "source"))
            rows, subject, pattern = [], [], []
            held, size = [], 0
            for i, text in enumerate([*texts, None]):
                if text:
                    held.append(i)
                    size += len(text)
                if held and (size >= AT_ONCE or i == len(texts)):
                    for j, votes in zip(held, voter([(texts[j], titles[j], sources[j]) for j in held])):
                        for k, p in votes:
                            rows.append(j)
                            subject.append(k)
                            pattern.append(p)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(subject, pa.int32()), pa.array(pattern, pa.int32())], [b.schema.names[0], "k", "patron"])


def learn(counts: dict[tuple[int, int], float], known: dict[tuple[int, int, int], float], subjects: int) -> dict[tuple[int, int], float]:
    """Posterior of each (subject, pattern), by expectation and maximisation.

    Whether a document is about a subject is latent; each labelling function
    says what it says with probabilities that depend only on that, the same for
    all subjects.  `counts` are over all documents; `known` (subject, pattern,
    truth) over the labelled ones kept back, which weigh as much in all.
    """
    keys = sorted(set(counts) | {(k, p) for k, p, _ in known})
    if not keys:
        return {}
    n = np.array([counts.get(x, 0.0) for x in keys])
    votes = np.array([unpack(p) for _, p in keys])
    subject = np.array([k for k, _ in keys])
    yes = np.array([known.get((k, p, 1), 0.0) for k, p in keys])
    no = np.array([known.get((k, p, 0), 0.0) for k, p in keys])
    weight = max(1.0, n.sum() / max(1.0, yes.sum() + no.sum()))
    # to begin with, a subject holds where it has about a quarter of the prose
    post = np.where(np.array(SHARES)[votes[:, 0]] > 0.21, 0.9, 0.1)
    for _ in range(ROUNDS):
        one, zero = n * post + weight * yes, n * (1 - post) + weight * no
        rate = (np.bincount(subject, one, subjects) + 1) / (np.bincount(subject, one + zero, subjects) + 2)
        log = np.log(rate[subject]) - np.log(1 - rate[subject])
        for j, width in enumerate(WIDTHS):
            a = np.bincount(votes[:, j], one, width) + 0.5
            b = np.bincount(votes[:, j], zero, width) + 0.5
            ratio = np.log(a / a.sum()) - np.log(b / b.sum())
            if j == 0:
                ratio = np.maximum.accumulate(ratio)  # more of the prose never speaks less for it
            else:
                ratio[1] = 0.0  # a function that says nothing is no evidence
            log = log + ratio[votes[:, j]]
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return dict(zip(keys, post.tolist()))


def subject_posteriors(documents: DataFrame, subjects: DataFrame, labels: DataFrame, key: str = "doc_id", calibrate: bool = True) -> DataFrame:
    """`key`, subject, posterior: for each document and subject of which its prose says anything.

    1. Lexicon: of at most SAMPLE labelled documents (those with the smallest
       hashes of `key`; none longer than SAMPLE_CHARS), all but one in
       HELD_BACK give the words and word pairs that speak for one subject.
       Terms are counted by the executors.
    2. Every document is cut into prose (code, menus, footers, markup set
       aside).  The labelling functions vote on each subject: lexicon (the
       share of the prose with a subject that sentences about this one make
       up), sections (title and headings), addresses (links, hashtags), source
       (whether the subject is usual there, by the sample).
    3. Patterns of votes are counted over all documents; a latent model learns
       how accurate each function is and gives each pattern its posterior.
       With `calibrate`, the labels kept back weigh as much in this as all
       documents; without, accuracies are learned from the votes alone.

    Two reads of the documents, no shuffle of texts; the vote table is written
    to the shared folder between.  To the driver go the lexicon and the counts
    of patterns, bounded by the sample and the number of patterns.

    Nulls: no text, no row; title, source and language may be null.  Labels of
    unknown subjects or documents are left out, repeated ones count once.
    Without labels there is no lexicon and no row.  Extra columns are not
    looked at.
    """
    spark = documents.sparkSession
    ship(spark)
    names = [r[0] for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    chosen = labels.where("subject is not null").groupBy(key).agg(F.collect_set("subject").alias("labels"))
    chosen = cut(chosen.orderBy(F.xxhash64(key), key).limit(SAMPLE))
    docs = documents.select(key, *[c if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("text", "title", "source")])
    sample = docs.join(F.broadcast(chosen), key).where(F.length("text") <= SAMPLE_CHARS)
    held = F.pmod(F.xxhash64(F.lit("held"), F.col(key)), F.lit(HELD_BACK)) == 0
    columns = [f"n{i}" for i in range(len(names))]
    share = F.col("n") / F.size("known")
    counted = sample.where(~held).select("text", "labels").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(count_terms(names), "term string, known array<int>, n long")
    counted = counted.groupBy("term").agg(*[F.sum(F.when(F.array_contains("known", F.lit(i)), share).otherwise(0.0)).alias(c) for i, c in enumerate(columns)])
    lexicon = lexicon_of(counted.where(sum(F.col(c) for c in columns) >= LEAST - 0.01).collect(), len(names)) if names else {}

    usual: dict[str, list[int]] = {}
    rates = sample.where(~held).select("source", F.explode("labels").alias("s")).groupBy("source", "s").count().collect()
    by, whole, every = {}, Counter(), 0
    for r in rates:
        by.setdefault(r["source"] or "", Counter())[r["s"]] += r["count"]
        whole[r["s"]] += r["count"]
        every += r["count"]
    for source, c in by.items():
        n = sum(c.values())
        lift = [((c[s] + 2 * whole[s] / every) / (n + 2)) / max(1e-9, whole[s] / every) for s in names]
        usual[source] = [2 if x >= LIFT else 0 if x <= 1 / LIFT else 1 for x in lift]

    shared = spark.sparkContext.broadcast((lexicon, len(names), usual))
    kind = documents.schema[key].dataType.simpleString()
    votes = cut(docs.select(key, "text", "title", "source").mapInArrow(_Vote(shared), f"`{key}` {kind}, k int, patron int"))
    counts = {(r["k"], r["patron"]): float(r["count"]) for r in votes.groupBy("k", "patron").count().collect()}
    order = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    judged = votes.join(F.broadcast(chosen.where(held)), key).select("k", "patron", F.array_contains("labels", F.get(order, F.col("k"))).cast("int").alias("y"))
    known = {(r["k"], r["patron"], r["y"]): float(r["count"]) for r in judged.groupBy("k", "patron", "y").count().collect()} if calibrate else {}
    posterior = [(k, p, x) for (k, p), x in learn(counts, known, len(names)).items()]
    table = spark.createDataFrame(posterior, "k int, patron int, posterior double")
    return votes.join(F.broadcast(table), ["k", "patron"]).select(key, F.get(order, F.col("k")).alias("subject"), "posterior")


def assigned(posteriors: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, subject of the documents that are about it more probably than not."""
    return posteriors.where(F.col("posterior") >= ASSIGN).select(key, "subject")


def composition(posteriors: DataFrame, subjects: DataFrame) -> DataFrame:
    """The corpus by subject: documents assigned, and expected by the posteriors."""
    by = posteriors.groupBy("subject").agg(F.count_if(F.col("posterior") >= ASSIGN).alias("documentos"), F.round(F.sum("posterior"), 3).alias("esperados"))
    return subjects.select("subject").distinct().join(by, "subject", "left").select("subject", F.coalesce("documentos", F.lit(0)).alias("documentos"), F.coalesce("esperados", F.lit(0.0)).alias("esperados"))
