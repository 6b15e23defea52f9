"""Text that was decoded with a wrong encoding: found by improbable character pairs, restored by inverse mappings."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brocal.session import cut, ship

#: Encodings with which text may have been decoded wrongly; the first stands for latin-1 too.
ENCODINGS = ("cp1252", "cp1250", "iso8859-2", "cp1251", "cp850", "cp437", "cp858", "mac_roman", "iso8859-15", "cp1254", "koi8-r", "cp866")
#: Bytes without a character in cp1252: a decoder that skips errors loses them.
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
#: How improbable a pair must be (in nats below independence) before it speaks for damage.
SLACK = 1.2
#: Score of a run with lost characters from which its text counts as damaged.
LOST_SCORE = 2.0
#: Pairs that are rarer than this among all pairs of the corpus count as never seen: no more than 1 / RARE pairs are broadcast.
RARE = 1e-7

#: Characters from here on are told apart by block only, so that the table of pairs stays small.
BLOCKS_FROM = 0x2E80
_M = BLOCKS_FROM + 0x1100
_JUMP = _M * _M
_EDGE = 0  # U+0000 stands for the beginning and end of a text
_LOST = BLOCKS_FROM  # the replacement character, apart from its block
#: Text that can't speak for normal pairs: replacement and control characters, bytes of UTF-8 as characters, question marks inside words.
SUSPECT = (
    "[\\x{80}-\\x{9f}\\x{ad}\\x{fffd}\\x{192}\\x{f8ff}]"
    "|[\\x{c2}-\\x{f4}\\x{102}\\x{139}][\\x{80}-\\x{bf}\\x{152}-\\x{192}\\x{2c6}\\x{2dc}\\x{2013}-\\x{203a}\\x{20ac}\\x{2122}\\x{104}-\\x{17e}\\x{2c7}-\\x{2dd}]"
    "|[\\x{413}\\x{412}\\x{432}\\x{440}][\\x{80}-\\x{bf}\\x{402}-\\x{40f}\\x{452}-\\x{45f}\\x{490}\\x{491}\\x{401}\\x{451}\\x{2013}-\\x{203a}\\x{20ac}\\x{2116}\\x{2122}]"
    "|[\\x{251c}\\x{252c}\\x{256c}\\x{2567}\\x{2568}\\x{2564}][\\x{80}-\\x{ff}\\x{2502}\\x{2551}-\\x{256c}\\x{2591}-\\x{2593}\\x{2310}]|[\\x{393}\\x{221a}\\x{ac}\\x{201a}\\x{d4}][\\x{80}-\\x{ff}\\x{2190}-\\x{22ff}]"
    "|\\p{Ll}[\\x{a1}-\\x{a9}\\x{201a}\\x{2021}\\x{20ac}](?:\\p{L}|$)"
    "|\\p{L}\\?\\p{L}|(?:^|[\\s#])\\?\\p{L}|\\?\\?|\\?[^\\S\\n]\\?"
)


def _symbol_class(cp: int) -> int:
    if cp == _EDGE:
        return 0
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if ch.isspace() and cp < 0x80:
        return 1
    if cp < 0x80:
        return 2 if cat == "Ll" else 3 if cat == "Lu" else 4 if cat == "Nd" else 11 if ch == "?" else 5
    if cat in ("Cc", "Cn", "Co"):
        return 6
    if cat[0] == "L" and cp < 0x250:
        return 7 if cat == "Ll" else 8
    return 9 if cat[0] == "L" else 12


_CLASS = np.array([_symbol_class(cp) for cp in range(BLOCKS_FROM)] + [10] * (_M - BLOCKS_FROM))
_CLASSES = 13
#: Whose characters can be the trace of damage; only pairs with one of them are judged.
_ODD = np.isin(_CLASS, (6, 7, 8, 9, 10, 11, 12))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol ids of all texts, an edge before, between and after them; and where each text begins."""
    cps = np.frombuffer(("\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    starts = np.flatnonzero(cps == 0)
    ids = np.where(cps < BLOCKS_FROM, cps, BLOCKS_FROM + (cps >> 8))
    ids[cps == 0xFFFD] = _LOST
    return ids, starts


def symbol(ch: str) -> int:
    cp = ord(ch)
    return cp if cp < BLOCKS_FROM else _LOST if cp == 0xFFFD else BLOCKS_FROM + (cp >> 8)


def pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of adjacent pairs, and of the pairs around a single blank (-1 where there is none), by position of the first."""
    near = ids[:-1] * _M + ids[1:]
    over = np.full(len(near), -1, np.int64)
    blank = np.flatnonzero(ids[1:-1] == 32)
    over[blank] = _JUMP + ids[blank] * _M + ids[blank + 2]
    return near, over


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        texts = b.column(0).to_pylist()
        for at in range(0, len(texts), 2000):
            near, over = pairs(symbols(texts[at : at + 2000])[0])
            for keys in (near[near != 0], over[over >= 0]):
                k, n = np.unique(keys, return_counts=True)
                total.update(dict(zip(k.tolist(), n.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["par", "veces"])


class _Scores(dict):
    """Scores of two characters in a row (`jump`: around a blank), reckoned once each."""

    def __init__(self, model: PairModel, jump: int):
        self.model, self.jump = model, jump * _JUMP

    def __missing__(self, two: str) -> float:
        got = self[two] = self.model.score(self.jump + symbol(two[0]) * _M + symbol(two[1]))
        return got


class PairModel:
    """Mutual information of character pairs in a corpus, also of characters with classes of characters.

    `keys` and `counts` are arrays, the keys in order.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.cache = keys, counts, {}
        self.near, self.over = _Scores(self, 0), _Scores(self, 1)
        self.tables = []
        for jump in (0, 1):
            of = (keys >= _JUMP) == bool(jump)
            n = counts[of]
            a, b = np.divmod(keys[of] - jump * _JUMP, _M)
            one, two = (np.bincount(x, n, _M) for x in (a, b))
            left_kinds, right_kinds = (np.bincount(x, minlength=_M) for x in (a, b))
            a_c = np.bincount(a * _CLASSES + _CLASS[b], n, _M * _CLASSES)
            c_b = np.bincount(b * _CLASSES + _CLASS[a], n, _M * _CLASSES)
            left, right = (np.bincount(_CLASS[x], n, _CLASSES) for x in (a, b))
            self.tables.append((max(1.0, float(n.sum())), one, two, a_c, c_b, left_kinds, right_kinds, left, right))

    def known(self, ch: str) -> bool:
        return self.tables[0][1][symbol(ch)] > 0

    def score(self, key: int) -> float:
        """How much the pair speaks for damage: positive if it is less probable than by chance."""
        got = self.cache.get(key)
        if got is None:
            got = self.cache[key] = self._score(key)
        return got

    def _score(self, key: int) -> float:
        jump = key >= _JUMP
        total, one, two, a_c, c_b, lk, rk, left, right = self.tables[jump]
        a, b = divmod(key - _JUMP if jump else key, _M)
        if not (_ODD[a] or _ODD[b]):
            return -1.0
        at = int(np.searchsorted(self.keys, key))
        c = int(self.counts[at]) if at < len(self.keys) and self.keys[at] == key else 0
        pmi = lambda n, e: math.log((n + 0.5) / (e + 0.5))
        worst = min(
            pmi(c, one[a] * two[b] / total),
            pmi(a_c[a * _CLASSES + _CLASS[b]], one[a] * right[_CLASS[b]] / total),
            pmi(c_b[b * _CLASSES + _CLASS[a]], two[b] * left[_CLASS[a]] / total),
        )
        if jump:
            return -worst - SLACK - 0.8
        fresh = 0.0
        if c == 0:
            # a neighbour that never occurred beside a character that often did
            fresh = max(math.log((one[a] + 1) / (lk[a] + 1)) if _ODD[a] else 0, math.log((two[b] + 1) / (rk[b] + 1)) if _ODD[b] else 0) / 2
            if (_ODD[a] and not one[a]) or (_ODD[b] and not two[b]):
                fresh = max(fresh, 2.0)
        return max(-worst, fresh) - SLACK


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time (Ruzzo and Tompa)."""
    total = 0.0
    stack: list = []  # begin, end, sum before, sum after
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(b, e, y - x) for b, e, x, y in stack]


def _byte_map(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding == "cp1252":
        for b in range(0x80, 0x100):
            out.setdefault(chr(b), b)
    return out


_MAPS = {e: _byte_map(e) for e in ENCODINGS}
#: Per encoding, the characters that can begin a UTF-8 sequence.
_LEADS = {e: frozenset(ch for ch, b in to.items() if 0xC2 <= b <= 0xF4) for e, to in _MAPS.items()}
#: Encodings of one byte a character, as (decoded with, written in).
SWAPS = tuple((w, r) for w in ("cp1252", "cp850", "cp437", "mac_roman", "cp1250", "cp1251", "iso8859-2") for r in ("cp850", "cp437", "cp1252", "mac_roman", "cp1250", "cp1251", "iso8859-2") if w != r)
#: What speaks for damage must reach this before a swap is tried, and fall to this share by it.
SWAP_SCORE, SWAP_LEFT = 1.2, 0.35
_TURNED = {(w, r): {ch: got for ch, b in _MAPS[w].items() for got in [{v: k for k, v in _MAPS[r].items()}.get(b)] if got} for w, r in SWAPS}


def _decoded(text: str, at: int, to: dict[str, int]) -> tuple[str, int] | None:
    """The character whose UTF-8 bytes the characters from `at` are, and their number."""
    lead = to.get(text[at])
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return None
    n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if at + n > len(text):
        return None
    raw = [lead]
    for ch in text[at + 1 : at + n]:
        b = to.get(ch)
        if b is None or not 0x80 <= b <= 0xBF:
            return None
        raw.append(b)
    try:
        ch = bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return (ch, n) if unicodedata.category(ch) not in ("Cn", "Co", "Cs") else None


_GONE = re.compile("[\x80-\x9f\ufffd]")


class Judge:
    """Finds damage in one text and takes back what can be."""

    def __init__(self, model: PairModel):
        self.model = model

    def scores(self, text: str) -> tuple[list[float], float]:
        """By position, what speaks for damage between characters i - 1 and i; and the sum of it all."""
        wide = "\0" + text.replace("\0", " ") + "\0"
        out = list(map(self.model.near.__getitem__, map(add, wide, wide[1:])))
        total = sum(x for x in out if x > 0)
        i = text.find(" ")
        while i >= 0:
            over = self.model.over[wide[i] + wide[i + 2]]
            if over > 0:
                total += over
            if over > out[i]:
                out[i] = over
            i = text.find(" ", i + 1)
        return out, total

    def around(self, text: list[str] | str, at: list[int]) -> float:
        """The part of that sum in which the characters `at` (in order, none a blank) have a share."""
        total, n, done, last, one_before = 0.0, len(text), -1, -9, -9
        near, over = self.model.near, self.model.over
        for i in at:
            for j in range(max(i, done + 1), i + 2):  # the pairs of j - 1 and j
                if (x := near[(text[j - 1] if j else "\0") + (text[j] if j < n else "\0")]) > 0:
                    total += x
            done = i + 1
            if i and text[i - 1] == " " and i - 2 not in (last, one_before) and (x := over[(text[i - 2] if i > 1 else "\0") + text[i]]) > 0:
                total += x
            if i + 1 < n and text[i + 1] == " " and (x := over[text[i] + (text[i + 2] if i + 2 < n else "\0")]) > 0:
                total += x
            last, one_before = i, last
        return total

    def runs(self, text: str, scores: list[float]) -> list[tuple[int, int, float]]:
        """Improbable runs as character ranges; a pair's score lies between characters i - 1 and i."""
        return [(max(0, b - 1), min(len(text), e), s) for b, e, s in segments(scores)]

    def undo(self, text: str, spans: list[tuple[int, int, float]]) -> tuple[str, int]:
        """One round of the inverse mapping that changes most inside the runs."""
        at, last = [], -1
        for b, e, _ in spans:
            for i in range(max(b - 1, last + 1), e):
                if text[i] > "\x7f":
                    at.append(i)
            last = max(last, e - 1)
        best, most = [], 0
        for name, to in _MAPS.items():
            leads, hits, n, strange, free = _LEADS[name], [], 0, 0, 0
            for i in at:
                if i < free or text[i] not in leads or (got := _decoded(text, i, to)) is None:
                    continue
                free = i + got[1]
                hits.append((i, free, got[0]))
                n += got[1]
                strange += not self.model.known(got[0]) and (0x180 <= ord(got[0]) < 0x370 or 0x700 <= ord(got[0]) < 0x2010)
            if n - 2 * strange > most:
                best, most = hits, n - 2 * strange
        out, done = [], 0
        for b, e, ch in best:
            out += (text[done:b], ch)
            done = e
        return "".join([*out, text[done:]]), most

    def swap(self, text: str, spans: list[tuple[int, int, float]], before: float) -> str:
        """The inverse mapping between two encodings of one byte a character that makes the runs most probable."""
        if before < SWAP_SCORE:
            return text
        at = sorted({i for b, e, _ in spans for i in range(b, e) if text[i] > "\x7f"})
        old = [text[i] for i in at]
        now, tried = list(text), {tuple(old)}
        rest = before - self.around(text, at)
        best, out = before * SWAP_LEFT, None
        for turned in _TURNED.values():
            new = tuple(turned.get(ch, ch) for ch in old)
            if new in tried:
                continue
            tried.add(new)
            if not all(map(self.model.known, new)):
                continue
            for i, ch in zip(at, new):
                now[i] = ch
            if (w := rest + self.around(now, at)) < best:
                best, out = w, "".join(now)
        return text if out is None else out

    def refill(self, text: str, spans: list[tuple[int, int, float]]) -> str:
        """Put back bytes that a decoder skipped: a lead byte as a character whose next byte has none."""
        for b, e, _ in spans:
            for i in range(b, min(e + 1, len(text))):
                if not "\xc3" <= text[i] <= "\xdf":
                    continue
                wide = "\0\0" + text[max(0, i - 2) : i + 3] + "\0\0"
                near, at = list(wide), min(i, 2) + 2
                now = self.around(near, [at])
                for lost in UNDEFINED:
                    near[at] = ch = bytes([ord(text[i]), lost]).decode("utf-8")
                    if self.model.known(ch) and self.around(near, [at]) < now - 0.5:
                        text = text[:i] + ch + text[i + 1 :]
                        break
        return text

    def __call__(self, text: str) -> tuple[bool, str | None]:
        """Whether the text is damaged, and the original if it could be restored whole."""
        scores, weight = self.scores(text)
        spans = self.runs(text, scores)
        now = text
        while True:
            # each round makes the text shorter, so it ends however often it was decoded
            new, n = self.undo(now, spans)
            if not n:
                break
            scores, after = self.scores(new)
            if now is text and after >= weight:
                break
            now, spans = new, self.runs(new, scores)
        if now is not text:
            now = self.refill(now, spans)
            return True, None if self.lost(now, self.runs(now, self.scores(now)[0])) else self.whole(now)
        if self.gone(text, spans):
            return True, None
        now = self.refill(text, spans)
        if now is text:
            now = self.swap(text, spans, weight)
        if now is not text:
            return True, self.whole(now)
        return (True, None) if self.lost(text, spans) else (False, None)

    def whole(self, text: str) -> str | None:
        """The text, unless it has characters that the corpus doesn't know, or sequences that could still be taken back."""
        return text if all(c < "\x80" or self.model.known(c) for c in text) and not self.undo(text, [(0, len(text), 0.0)])[1] else None

    def gone(self, text: str, spans: list[tuple[int, int, float]]) -> bool:
        """Characters in the runs that stand for lost bytes: replacement characters, C1 controls."""
        return any(_GONE.search(text, b, e) for b, e, _ in spans)

    def lost(self, text: str, spans: list[tuple[int, int, float]]) -> bool:
        """Characters that no mapping brings back: question marks in their place, or pieces of a sequence."""
        if self.gone(text, spans):
            return True
        for b, e, s in spans:
            piece = text[max(0, b - 1) : e + 1]
            if s >= LOST_SCORE and "?" in piece:
                at = text.find("?", max(0, b - 1))
                token = re.search(r"\S*$", text[:at])[0] + re.match(r"\S*", text[at:])[0]
                if not re.search(r"[/=&]|www\.", token):
                    return True
            if s >= LOST_SCORE and re.search("[ðâïÂÃ][\xa0-\xbf]|ð|â[^\x00-\x7f]|ï¸", piece) and not re.search(r"[a-zà-ÿ][âïð][a-zà-ÿ]", piece):
                return True
        return False


class _Find:
    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = getattr(self.broadcast, "model", None)
        if model is None:
            # the worker keeps the broadcast, so all its tasks share one model
            model = self.broadcast.model = PairModel(*self.broadcast.value)
        judge = Judge(model)
        for b in batches:
            column = b.column("texto").to_pylist()
            keep, restored = [], []
            for at in range(0, len(column), 2000):
                for i in suspects(model, column[at : at + 2000]):
                    bad, original = judge(column[at + i])
                    if bad:
                        keep.append(at + i)
                        restored.append(original)
            if keep:
                i = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(i) for c in ("tabla", "fila_id", "campo", "texto")], pa.array(restored, pa.string())], ["tabla", "fila_id", "campo", "texto", "original"])


def suspects(model: PairModel, texts: list[str]) -> list[int]:
    """Which texts have any pair that speaks for damage."""
    ids, starts = symbols(texts)
    odd = _ODD[ids]
    near = np.flatnonzero(odd[:-1] | odd[1:])
    over = np.flatnonzero((ids[1:-1] == 32) & (odd[:-2] | odd[2:]))
    hit = np.zeros(len(texts), bool)
    for at, keys in ((near, ids[near] * _M + ids[near + 1]), (over, _JUMP + ids[over] * _M + ids[over + 2])):
        k, back = np.unique(keys, return_inverse=True)
        bad = np.array([model.score(x) > 0 for x in k.tolist()], bool)
        hit[np.searchsorted(starts, at[bad[back]], side="right") - 1] = True
    return np.flatnonzero(hit).tolist()


def _can_be_odd(column: str) -> Column:
    """Whether the text has a character that damage can leave: any beyond ASCII, or a question mark."""
    c = F.col(column)
    return (F.octet_length(c) != F.char_length(c)) | F.contains(c, F.lit("?"))


def pair_counts(texts: DataFrame, column: str = "texto") -> tuple[np.ndarray, np.ndarray]:
    """Counts of character pairs over all texts that carry no trace of damage: keys in order, counts.

    Pairs with less than RARE of all occurrences count as never seen, so the
    result is bounded by 1 / RARE pairs, whatever the alphabet; characters of
    large scripts and emoji are told apart by block.
    """
    ship(texts.sparkSession)
    clean = texts.where(F.col(column).isNotNull() & ~(_can_be_odd(column) & F.col(column).rlike(SUSPECT))).select(column)
    counted = cut(clean.mapInArrow(count_pairs, "par long, veces long").groupBy("par").agg(F.sum("veces").alias("veces")))
    least = (counted.agg(F.sum("veces")).first()[0] or 0) * RARE
    rows = counted.where(F.col("veces") >= least).toArrow()
    keys, n = rows.column("par").to_numpy(), rows.column("veces").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def garbled(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The damaged of the rows (tabla, fila_id, campo, texto), with `original` where it can be restored whole.

    1. Character pairs are counted over all texts without a trace of damage
       (`pair_counts`); the score of a pair is its mutual information there,
       that of a character with the other's class of characters too, turned
       round, so that improbable pairs score above zero.
    2. Maximal scoring segments isolate the improbable runs of a text.
    3. Inside the runs only, each inverse mapping (encode with one of
       ENCODINGS, decode as UTF-8) is tried sequence by sequence; it counts if
       the pairs become more probable.  This repeats, as often as it changes
       anything, for text that went through more than one wrong encoding.
    4. Runs in which characters were lost (replacement characters, question
       marks where pairs make them improbable, broken sequences) are damage
       without an original, except bytes that have only one way back.

    Nulls and empty texts are whole.  Text may be of any length.  Repeated
    rows come out as often as they come in; the ids may be null.  Extra
    columns are left out.
    """
    spark = texts.sparkSession
    ship(spark)
    rows = texts.select("tabla", "fila_id", "campo", "texto").where("texto is not null and texto != ''")
    counts = pair_counts(rows) if counts is None else counts
    shared = spark.sparkContext.broadcast(counts)
    return rows.where(_can_be_odd("texto")).mapInArrow(_Find(shared), "tabla string, fila_id string, campo string, texto string, original string")
