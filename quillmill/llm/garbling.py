"""Texts read in another encoding than they were written in (problem 10).

A smoothed character trigram model is trained on the clean records of the corpus itself. Every candidate
chain, encoding back with the wrong codec and decoding with the right one, is scored by the model; the
likeliest is accepted if it gains more than a margin that is validated on held-out segments taken as clean
and on the same garbled on purpose. Characters that a codec left as replacement marks can't be restored;
that they were lost is one more candidate, scored by the model like the others.

All is decided on distinct things: documents give distinct segments, these give distinct words, and each
distinct word is scored once a model, for all chains. The best gains of its words bound a segment's gain, so
only the few segments whose bound passes the margin are looked at chain by chain.
"""

from __future__ import annotations

import codecs
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import persisted

# Public names of the codecs that texts are mistaken for and written in.
SINGLE_BYTE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp1253", "cp1254"]
MULTI_BYTE = ["cp932", "gbk", "euc_jp", "big5", "euc_kr"]
TRUE_ONLY = ["utf-8"]

#: Bits of the model's hashed tables (trigrams, their histories, bigrams) at first; all grow by two while more than FULL of the trigrams' slots are taken, up to MOST_BITS, which bounds the model to 108 MB. Characters have a slot each.
BITS, MOST_BITS, FULL = (20, 18, 18), 24, 1 / 8
CHARACTERS = 0x110000
#: Weight of the shorter history in the smoothing, and the characters that unseen ones stand for.
BACKING, UNSEEN = 1.5, 70_000
#: Share of garbled segments assumed when the margin weighs misses against false alarms.
PRIOR = 0.04
#: Words whose scores a worker remembers, and their longest length: 64 MB at most.
REMEMBERED, SHORT = 50_000, 64
#: Words that are scored together.
TOGETHER = 256
#: Characters that are scored together.
PART = 100_000
#: Share of the distinct segments that is held out of the training, to validate the margin, and the distinct segments below which none are.
HELD, FEW = 1 / 8, 2000
#: Least margin: the log odds of the assumed share.
LEAST = float(np.log((1 - PRIOR) / PRIOR))
#: Width and number of the bins of gains above it; margins end at 20.
BIN = 1 / 64
BINS = int((20 - LEAST) / BIN) + 1
#: Steps of how rare a segment's rarest trigram is, four to each doubling.
RARITIES = 128

_SEGMENT = re.compile(r"(?<=[.!?。！？])[ \t]+|[\r\n]+")
_WORD = re.compile(r"[^ \t\r\n\f\v]+")
_DIGITS = re.compile(r"[0-9]+")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_DAMAGED = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
MARK = "\ufffd"


@lru_cache(64)
def _tables(codec: str):
    """(decoding text, encoding map) of a one-byte codec; bytes it leaves undefined stand for themselves."""
    decoded = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return decoded, {ord(c): b for b, c in reversed(list(enumerate(decoded)))}


def to_bytes(text: str, codec: str) -> bytes | None:
    """Text back in the bytes of a codec, or None where it has other characters."""
    try:
        if codec in SINGLE_BYTE:
            return codecs.charmap_encode(text, "strict", _tables(codec)[1])[0]
        return text.encode(codec)
    except UnicodeError:
        return None


def from_bytes(data: bytes, codec: str) -> str | None:
    try:
        if codec in SINGLE_BYTE:
            return codecs.charmap_decode(data, "strict", _tables(codec)[0])[0]
        return data.decode(codec)
    except UnicodeError:
        return None


#: The codecs of a chain: every one of the first with every one of the second.
WRONG, RIGHT = SINGLE_BYTE + MULTI_BYTE, TRUE_ONLY + MULTI_BYTE + SINGLE_BYTE
#: All chains as steps (wrong, right). Text garbled twice through UTF-8 gains only when both steps are undone.
CHAINS = [((w, r),) for w in WRONG for r in RIGHT] + [((w, "utf-8"), (v, "utf-8")) for w in SINGLE_BYTE for v in SINGLE_BYTE]
#: The candidate beside them: marks stand for characters that a codec lost, any of which may have been there.
LOST = len(CHAINS)


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences and lines that have a character beyond ASCII."""
    start = 0
    for m in _SEGMENT.finditer(text):
        if _BEYOND.search(text, start, m.start()):
            yield start, m.start()
        start = m.end()
    if _BEYOND.search(text, start):
        yield start, len(text)


def words_of(segment: str) -> list[str]:
    """Words with a character beyond ASCII, each with two characters of its context on either side.

    Digits, which no codec changes, count as one; a character beyond ASCII in the context, which may be
    garbled itself, and the ends of the segment have marks of their own.
    """
    found = []
    for m in _WORD.finditer(segment):
        if m[0].isascii():
            continue
        a, b = m.span()
        left, right = segment[max(0, a - 2) : a], segment[b : b + 2]
        left, right = (_DIGITS.sub("0", _BEYOND.sub("\x01", x)) for x in (left, right))
        found.append(f"{left.rjust(2, chr(2))}{_DIGITS.sub('0', m[0])}{right.ljust(2, chr(2))}")
    return found


def _parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, long ones in overlapping parts, in groups of at most about PART characters, with their places."""
    places, group, held = [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - 2), PART):
            part = text[start : start + PART + 2]
            if held + len(part) > PART and group:
                yield places, group
                places, group, held = [], [], 0
            places.append(k)
            group.append(part)
            held += len(part)
    if group:
        yield places, group


def _slots(texts: list[str], bits: tuple[int, int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of each character but the first two of the texts in the five tables, and the text it belongs to."""
    padded = "".join(texts)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    keep = np.ones(len(codes), bool)
    keep[first] = keep[first + 1] = False
    at = np.flatnonzero(keep)
    a, b, c = codes[at - 2], codes[at - 1], codes[at]
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        ab, bc = a * m1 + b * m2, b * m1 + c * m2
        abc = ab * m3 + c * m2
        tables = [(x ^ (x >> np.uint64(29))) * m1 >> np.uint64(64 - n) for x, n in zip((abc, ab, bc), bits, strict=True)]
    return [t.astype(np.int64) for t in (*tables, b, c)], owner[at]


def _empty(bits: tuple[int, int, int], kind=np.float64) -> list[np.ndarray]:
    return [np.zeros(n, kind) for n in (*(1 << b for b in bits), CHARACTERS, CHARACTERS)]


@dataclass
class Model:
    """Counts in the five tables, the number of characters, and the bits of the hashed ones."""

    counts: list[np.ndarray]
    total: float
    bits: tuple[int, int, int] = BITS

    def __getstate__(self) -> tuple:
        """Only the filled slots are sent to workers, so a broadcast is as large as what the corpus fills."""
        at = [np.flatnonzero(t) for t in self.counts]
        return [(a.astype(np.int32), t[a]) for a, t in zip(at, self.counts, strict=True)], self.total, self.bits

    def __setstate__(self, state: tuple) -> None:
        filled, self.total, self.bits = state
        self.counts = _empty(self.bits, np.float32)
        for table, (at, n) in zip(self.counts, filled, strict=True):
            table[at] = n

    def plus(self, other: Model) -> Model:
        return Model([a + b for a, b in zip(self.counts, other.counts, strict=True)], self.total + other.total, self.bits)

    def fill(self) -> float:
        """Share of the trigrams' slots in use, which is about the chance that a new trigram meets another's count."""
        return float((self.counts[0] > 0).mean())

    def logs(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(places, owner, characters, log probabilities) of groups of texts."""
        c3, ch2, c2, ch1, c1 = self.counts
        for places, group in _parts(texts):
            (s3, h2, s2, h1, s1), owner = _slots(group, self.bits)
            p1 = (c1[s1] + 0.5) / (self.total + 0.5 * UNSEEN)
            p2 = np.minimum(1, (c2[s2] + BACKING * p1) / (ch1[h1] + BACKING))
            p3 = np.minimum(1, (c3[s3] + BACKING * p2) / (ch2[h2] + BACKING))
            yield places, owner, s1, np.log(p3)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text as a word."""
        result = np.zeros(len(texts))
        for places, owner, _, logs in self.logs(texts):
            result += np.bincount(np.array(places)[owner], logs, len(texts))
        return result

    def rarest(self, texts: list[str]) -> np.ndarray:
        """Least count of a trigram in each text."""
        result = np.full(len(texts), np.inf)
        for places, group in _parts(texts):
            slots, owner = _slots(group, self.bits)
            np.minimum.at(result, np.array(places)[owner], self.counts[0][slots[0]])
        return result

    def surprise(self, texts: list[str], character: str) -> np.ndarray:
        """What the occurrences of a character cost each text, as a positive number."""
        result = np.zeros(len(texts))
        for places, owner, codes, logs in self.logs(texts):
            result -= np.bincount(np.array(places)[owner], np.where(codes == ord(character), logs, 0), len(texts))
        return result


def count_ngrams(counted: dict[str, float], into: list[np.ndarray], bits: tuple[int, int, int] = BITS) -> None:
    times = np.fromiter(counted.values(), np.float64, len(counted))
    for places, group in _parts(list(counted)):
        slots, owner = _slots(group, bits)
        weight = times[np.array(places)[owner]]
        for table, slot in zip(into, slots, strict=True):
            np.add.at(table, slot, weight)


#: What the candidates add to the log likelihood of a word: numbers of those that can be applied, and gains.
Gains = tuple[np.ndarray, np.ndarray]


def candidates(word: str) -> tuple[list[int], list[int], list[str]]:
    """(numbers of the chains that change a word in its context, the text of each, the distinct texts after the word itself)."""
    left, core, right = word[:2], word[2:-2], word[-2:]
    chains, of, seen = [], [], {word: 0}
    for w in range(len(WRONG)):
        if (data := to_bytes(core, WRONG[w])) is None:
            continue
        for t in range(len(RIGHT)):
            if (text := from_bytes(data, RIGHT[t])) is not None and text != core:
                chains.append(w * len(RIGHT) + t)
                of.append(seen.setdefault(left + text + right, len(seen)))
                if RIGHT[t] == "utf-8" and w < len(SINGLE_BYTE):
                    for v, codec in enumerate(SINGLE_BYTE):
                        again = to_bytes(text, codec)
                        again = None if again is None else from_bytes(again, "utf-8")
                        if again is not None and again != text:
                            chains.append(len(WRONG) * len(RIGHT) + w * len(SINGLE_BYTE) + v)
                            of.append(seen.setdefault(left + again + right, len(seen)))
    return chains, of, list(seen)


class Scorer:
    """Gains of all candidates for words and segments under one model."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, Gains] = {}

    def score(self, words: list[str]) -> list[Gains]:
        """Gains of each word, scored together."""
        texts, found = [], []
        for word in words:
            chains, of, distinct = candidates(word)
            found.append((chains, of, len(texts)))
            texts += distinct
        scores = self.model.scores(texts) if texts else np.zeros(0)
        lost = self.model.surprise(words, MARK) if any(MARK in w for w in words) else np.zeros(len(words))
        result = []
        for (chains, of, at), gone in zip(found, lost, strict=True):
            gains = scores[at + np.array(of, np.int64)] - scores[at]
            more = ([LOST], [gone]) if gone else ([], [])
            result.append((np.array([*chains, *more[0]], np.int64), np.array([*gains, *more[1]], np.float32)))
        return result

    def gains(self, words: list[str]) -> list[Gains]:
        """The same, with those that this worker remembers."""
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        fresh: dict[str, Gains] = {}
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            fresh |= dict(zip(part, self.score(part), strict=True))
        if len(self.known) + len(fresh) > REMEMBERED:
            kept = {w: self.known[w] for w in words if w in self.known}
            self.known = {}
            fresh |= kept
        result = [fresh[w] if w in fresh else self.known[w] for w in words]
        self.known |= {w: g for w, g in fresh.items() if len(w) <= SHORT}
        return result

    def totals(self, segment: str) -> np.ndarray:
        total = np.zeros(len(CHAINS) + 1)
        for numbers, gains in self.gains(words_of(segment)):
            total[numbers] += gains
        return total

    def best(self, segment: str) -> tuple[float, int]:
        """Gain and number of the likeliest candidate of a segment."""
        total = self.totals(segment)
        chain = int(np.argmax(total))
        return float(total[chain]), chain

    def restore(self, segment: str, margin: float) -> tuple[str | None, bool]:
        """(the segment with its chains undone, or None if none is accepted; whether characters in it are lost).

        Chains are undone as long as one gains more than the margin. As each adds to the likelihood, none
        can come back, so this ends.
        """
        found = None
        while _BEYOND.search(segment):
            total = self.totals(segment)
            chain = int(np.argmax(total[:LOST]))
            if total[chain] <= margin:
                return found, bool(total[LOST] > margin)
            found = segment = apply_chain(segment, chain)
        return found, False


def apply_chain(segment: str, chain: int) -> str:
    def undo(m: re.Match) -> str:
        text = m[0]
        if text.isascii():
            return text
        for wrong, right in CHAINS[chain]:
            data = to_bytes(text, wrong)
            text = None if data is None else from_bytes(data, right)
            if text is None:
                return m[0]
        return text

    return _WORD.sub(undo, segment)


def garble(segment: str, chain: int) -> str | None:
    """The segment read wrongly on purpose, or None where the codecs can't hold it."""
    text = segment
    for wrong, right in reversed(CHAINS[chain]):
        data = to_bytes(text, right)
        text = None if data is None else from_bytes(data, wrong)
        if text is None:
            return None
    return None if text == segment or not _BEYOND.search(text) else text


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer for a broadcast model in a worker; its memory of words serves all tasks."""
    key = (id(shared.value), shared.value.total)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


@lru_cache(100_000)
def _utf8_codecs(word: str) -> int:
    """Bits of the wrong codecs in which a word is strict UTF-8."""
    found = 0
    for k, wrong in enumerate(WRONG):
        data = to_bytes(word, wrong)
        if data is not None and not data.isascii() and from_bytes(data, "utf-8") is not None:
            found |= 1 << k
    return found


def looks_garbled(segment: str) -> bool:
    """Whether a segment shows without a model that it may be garbled: marks of lost characters, or a codec in which all its words beyond ASCII are strict UTF-8.

    Chains to other codecs don't show: nearly all clean text in one-byte codecs is valid in some multi-byte one.
    """
    if _DAMAGED.search(segment):
        return True
    common = -1
    for m in _WORD.finditer(segment):
        if not m[0].isascii():
            common &= _utf8_codecs(m[0])
            if not common:
                return False
    return common > 0


_OCCURRENCES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("segment", T.StringType())])
_SEGMENTS = T.StructType([T.StructField("segment", T.StringType()), T.StructField("n", T.LongType()), T.StructField("garbled", T.BooleanType()), T.StructField("damaged", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType()))])


def _tasks(df: DataFrame) -> DataFrame:
    """As many parts as the session asks for, so that small tables are still scored by all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Corpus:
    """Tables in the shared folder: docs; occurrences (doc_id, segment); segments (sid, segment, n, garbled, damaged, held); vocabulary (wid, word); pairs (sid, wid)."""

    docs: DataFrame
    occurrences: DataFrame
    segments: DataFrame
    vocabulary: DataFrame
    pairs: DataFrame

    @staticmethod
    def of(docs: DataFrame) -> Corpus:
        """docs: doc_id and text."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, parts = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for a, b in segments(text):
                        ids.append(doc)
                        parts.append(text[a:b])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], names=_OCCURRENCES.names)

        def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                flags = [pa.array([f(t) for t in texts], pa.bool_()) for f in (looks_garbled, lambda t: bool(_DAMAGED.search(t)))]
                yield pa.record_batch([*batch.columns, *flags, pa.array([words_of(t) for t in texts], pa.list_(pa.string()))], names=_SEGMENTS.names)

        beyond = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
        occurrences = persisted(beyond.mapInArrow(split, _OCCURRENCES), "p10-occurrences")
        counted = _tasks(occurrences.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
        low = F.xxhash64("segment") < int(-(2**63) + 2**64 * HELD)
        taken = persisted(counted.mapInArrow(take_apart, _SEGMENTS).withColumns({"sid": F.monotonically_increasing_id(), "held": low}), "p10-segments")
        listed = taken.select("sid", F.explode("words").alias("word"))
        vocabulary = persisted(listed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("wid", F.monotonically_increasing_id()).select("wid", "word"), "p10-words")
        pairs = persisted(listed.join(vocabulary, "word").select("sid", "wid"), "p10-pairs")
        return Corpus(docs, occurrences, taken, vocabulary, pairs)


_COUNTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.DoubleType())])


def train(corpus: Corpus, clean: DataFrame, bits: tuple[int, int, int] = BITS) -> Model:
    """A model of the clean segments (sid, n).

    A segment that is there n times weighs the root of n, so copies of one text can't make the model. The
    weights are added up by distinct word, then each task adds up the n-grams of its words in tables of
    fixed size and sends the filled slots, which are summed by slot; so what is shuffled and collected is
    bounded by the tables, not by the corpus.
    """
    weights = corpus.pairs.join(clean.select("sid", F.sqrt("n").alias("w")), "sid").groupBy("wid").agg(F.sum("w").alias("w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _empty(bits)
        for batch in batches:
            count_ngrams(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), tables, bits)
        for k, table in enumerate(tables):
            slots = np.flatnonzero(table)
            for start in range(0, len(slots), 100_000):
                part = slots[start : start + 100_000]
                yield pa.record_batch([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)), pa.array(table[part])], names=_COUNTS.names)

    filled = corpus.vocabulary.join(weights, "wid").select("word", "w").mapInArrow(count, _COUNTS).groupBy("part", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most the slots of the tables
    part, slot, n = (filled.column(k).to_numpy() for k in range(3))
    tables = _empty(bits, np.float32)
    for k, table in enumerate(tables):
        table[slot[part == k]] = n[part == k]
    return Model(tables, float(tables[4].sum()), bits)


def train_to_fit(corpus: Corpus, clean: DataFrame) -> Model:
    """train, with tables wide enough for the corpus."""
    bits = BITS
    while (model := train(corpus, clean, bits)).fill() > FULL and bits[0] < MOST_BITS:
        bits = tuple(b + 2 for b in bits)
    return model


_BOUNDS = T.StructType([T.StructField("wid", T.LongType()), T.StructField("bound", T.FloatType())])
_JUDGED = T.StructType([T.StructField("sid", T.LongType()), T.StructField("gain", T.DoubleType())])


def suspects(corpus: Corpus, model, margin: float, among: DataFrame | None = None) -> DataFrame:
    """Segments (sid, segment) whose words' best gains add up to more than the margin; no other has a candidate beyond it.

    model: broadcast. among: sids to look at, all if not given. Each distinct word is scored once.
    """
    pairs = corpus.pairs if among is None else corpus.pairs.join(among.select("sid"), "sid", "left_semi")
    words = corpus.vocabulary if among is None else corpus.vocabulary.join(pairs.select("wid").distinct(), "wid", "left_semi")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            highest = []
            for k in range(0, len(texts), TOGETHER):
                highest += [max(0.0, float(gains.max())) if len(gains) else 0.0 for _, gains in scorer.score(texts[k : k + TOGETHER])]
            yield pa.record_batch([batch.column(0), pa.array(highest, pa.float32())], names=_BOUNDS.names)

    bounds = persisted(_tasks(words).mapInArrow(bound, _BOUNDS).where("bound > 0"), "p10-bounds")
    # A hair below the margin, as single gains are rounded.
    sids = pairs.join(bounds, "wid").groupBy("sid").agg(F.sum("bound").alias("bound")).where(F.col("bound") > margin - 1e-3).select("sid")
    return corpus.segments.join(sids, "sid").select("sid", "segment")


def _near(found: DataFrame) -> DataFrame:
    """Segments with those of alike words in one task, so that few workers score a word again."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, F.array_max(F.transform(F.split("segment", "[ \\t\\r\\n\\f]+"), lambda w: F.struct(F.octet_length(w) - F.length(w), w))))


def dirty(corpus: Corpus, model: Model, margin: float, among: DataFrame | None = None) -> DataFrame:
    """(sid, gain) of the segments with a candidate that gains more than the margin."""
    shared = corpus.pairs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            gains = [scorer.best(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(gains, pa.float64())], names=_JUDGED.names)

    return persisted(_near(suspects(corpus, shared, margin, among)).mapInArrow(judge, _JUDGED).where(F.col("gain") > margin), "p10-dirty")


_GAINS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("rarest", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])


def validated_margin(corpus: Corpus, held: DataFrame, model: Model) -> float:
    """The gain beyond which a chain is accepted: where misses and false alarms, weighed by PRIOR, are fewest.

    held: distinct segments (sid, segment, garbled) that the model was not trained on. Those that don't look
    garbled are scored, whole, as they are and once garbled by a chain drawn by their text, whose undoing is
    the least that a garbled one gains. As they are, all count as clean but the assumed share, PRIOR, with the
    rarest trigrams (in steps of RARITIES), which keeps the sample's own garbled ones out. Tasks send
    histograms; a margin is an edge of their bins, so its cost is exact and it lies within BIN of the best.
    """
    fair = held.where("not garbled").select("sid", "segment")
    shared = corpus.pairs.sparkSession.sparkContext.broadcast(model)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, RARITIES, BINS + 1), np.int64)
        known = shared.value
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bad = [garble(t, random.Random(t).randrange(len(CHAINS))) for t in texts]
            listed = [(words_of(t), words_of(b) if b is not None else None) for t, b in zip(texts, bad, strict=True)]
            words = list(dict.fromkeys(w for pair in listed for ws in pair if ws for w in ws))
            score = dict(zip(words, known.scores(words), strict=True)) if words else {}
            plain = list(dict.fromkeys(w for ws, _ in listed for w in ws))
            count = dict(zip(plain, known.rarest(plain), strict=True)) if plain else {}
            for (ws, worse), gain in zip(listed, own, strict=True):
                rarest = min(RARITIES - 1, int(4 * np.log2(1 + min(count[w] for w in ws))))
                bins[0, rarest, bin_of(gain)] += 1
                if worse is not None:
                    bins[1, rarest, bin_of(sum(score[w] for w in ws) - sum(score[w] for w in worse))] += 1
        at = np.nonzero(bins)
        yield pa.record_batch([*(pa.array(x.astype(np.int32)) for x in at), pa.array(bins[at])], names=_GAINS.names)

    # A gain of at most LEAST is in the first bin, whatever it is.
    scored = fair.join(dirty(corpus, model, LEAST, fair), "sid", "left").select("segment", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    bins = np.zeros((2, RARITIES, BINS + 1))
    for *at, n in _tasks(scored).mapInArrow(gains, _GAINS).groupBy("kind", "rarest", "bin").agg(F.sum("n")).collect():  # at most the bins
        bins[tuple(at)] = n
    share = np.cumsum(bins[0].sum(axis=1)) / max(1, bins[0].sum())
    return margin_of(bins[0, int(np.searchsorted(share, PRIOR)) + 1 :].sum(axis=0), bins[1].sum(axis=0))


def bin_of(gain: float) -> int:
    """The least k with gain <= LEAST + k * BIN, at most BINS."""
    return int(np.clip(np.ceil((gain - LEAST) / BIN), 0, BINS))


def margin_of(clean: np.ndarray, garbled: np.ndarray) -> float:
    """The best margin by histograms of gains; LEAST where nothing is known."""
    if not clean.sum() or not garbled.sum():
        return LEAST
    cost = PRIOR * np.cumsum(garbled) / garbled.sum() + (1 - PRIOR) * (1 - np.cumsum(clean) / clean.sum())
    return LEAST + BIN * int(np.flatnonzero(cost[:BINS] <= cost[:BINS].min() + 1e-9)[0])


def fit(docs: DataFrame | Corpus) -> tuple[Model, float]:
    """Model and margin of a corpus: trained on what doesn't look garbled, then again on what gains at most LEAST by the first.

    The segments whose hash is in the lowest HELD of its range are held out of both trainings and validate the
    margin; then the counts of those that are clean by the first model and theirs are added, so the model has
    all of the corpus. A corpus of fewer than FEW distinct segments has none to spare: its margin is LEAST.
    """
    corpus = docs if isinstance(docs, Corpus) else Corpus.of(docs)
    few = corpus.segments.count() < FEW
    rest = corpus.segments if few else corpus.segments.where("not held")
    first = train_to_fit(corpus, rest.where("not garbled"))

    def clean(part: DataFrame, model: Model) -> DataFrame:
        return part.where("not damaged").join(dirty(corpus, model, LEAST, None if few else part), "sid", "left_anti")

    model = train(corpus, clean(rest, first), first.bits)
    if few:
        return model, LEAST
    held = corpus.segments.where("held")
    margin = validated_margin(corpus, held, model)
    first = first.plus(train(corpus, held.where("not garbled"), first.bits))
    return model.plus(train(corpus, clean(held, first), first.bits)), margin


_HITS = T.StructType([T.StructField("segment", T.StringType()), T.StructField("better", T.StringType()), T.StructField("lost", T.BooleanType())])
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("lost", T.BooleanType())])


def hits(corpus: Corpus, model: Model, margin: float) -> DataFrame:
    """segment, better, lost of the distinct segments that are found: better is null where nothing could be undone."""
    shared = corpus.pairs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            better, lost = zip(*(scorer.restore(t, margin) for t in texts), strict=True) if texts else ((), ())
            safe = [b if b is None else b.encode("utf-8", "replace").decode() for b in better]
            yield pa.record_batch([batch.column(1), pa.array(safe, pa.string()), pa.array(lost, pa.bool_())], names=_HITS.names)

    return persisted(_near(suspects(corpus, shared, margin)).mapInArrow(judge, _HITS).where("better is not null or lost"), "p10-hits")


def found_ids(corpus: Corpus, model: Model, margin: float) -> DataFrame:
    """doc_id of each document with a segment that is found."""
    return corpus.occurrences.join(hits(corpus, model, margin), "segment", "left_semi").select("doc_id").distinct()


def inspect(docs: DataFrame | Corpus, model: Model, margin: float) -> DataFrame:
    """doc_id, found, restored, lost of each document with a segment that is found.

    restored: the text with all accepted chains undone where something was undone, else null. lost: whether
    characters are lost for good in it. Defined results: null, empty and ASCII texts are not found; repeated
    rows are treated alike; no text is cut.
    """
    corpus = docs if isinstance(docs, Corpus) else Corpus.of(docs)
    listed = corpus.occurrences.join(hits(corpus, model, margin), "segment").groupBy("doc_id").agg(F.collect_set(F.struct("segment", "better", "lost")).alias("hits"))  # the segments of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, lost = [], [], []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                judged = {h["segment"]: h for h in known}
                parts, at, seen, gone = [], 0, False, False
                for a, b in segments(text):
                    if (hit := judged.get(text[a:b])) is not None:
                        seen, gone = True, gone or hit["lost"]
                        if hit["better"] is not None:
                            parts += [text[at:a], hit["better"]]
                            at = b
                found.append(seen)
                texts.append("".join([*parts, text[at:]]) if parts else None)
                lost.append(gone)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.bool_()), pa.array(texts, pa.string()), pa.array(lost, pa.bool_())], names=_OUT.names)

    rows = corpus.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.join(listed, "doc_id").mapInArrow(run, _OUT)
