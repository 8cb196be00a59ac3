"""Phrase collocation mining by best-first branch-and-bound growth.

Words are lower-cased (A-Z), texts are split into pieces at ``. , ; : ! ?``
and line ends, and pieces into words at spaces and tabs. Per language a
phrase of 2 to ``LONGEST`` words that occurs ``LEAST`` times or more in
pieces is a candidate; with a its count, and l, r the counts of its two
parts at a cut, its score is the least floor(SCALE a / (l + r)) over its
cuts (of equals the one after the fewest words). A candidate goes if its
words lie in a longer candidate with at least ``SHARE`` of its count. The
result has each language's first ``TOP`` by score, count and phrase.

Growth. Words and pairs are counted over the whole corpus; longer phrases
grow from pairs by one word at a time. Of any phrase that begins with a
prefix p of first word w, a is at most f(p) and the right part of the cut
after w is at least a, so no score is above

    bound(p) = floor(SCALE f(p) / (f(w) + f(p))),

which only falls as p grows: it is admissible. The prefixes of best bound
are grown first, down to a limit theta per language; then every phrase of a
score of at least theta is known. Whether such a phrase survives is decided
by its one-word extensions to either side (if a longer candidate covers it,
the extension between them does), which are counted as well. If ``TOP`` of
them survive, or nothing is left to grow, the language is settled, ties
included; else theta falls to let ``FASTER`` times as many prefixes grow.

A pass counts the windows of the documents that a fixed-size filter of
``FILTER_BITS`` bits admits (built from the frontier by Spark's bitmap
aggregates; a window that it admits wrongly is counted and then dropped).
A filter looks at nothing but the phrase and its language, so a phrase is
counted everywhere or nowhere, and counts are exact: they are added by the
phrase's text, and windows are told apart by their bytes. Pairs are first
counted by a 64-bit hash alone; only those whose hash reaches ``LEAST``
are counted by text.

Null text counts as empty and a null language as ``und``; empty and blank
texts have no words; very long texts and words are taken whole; repeated
rows count each; doc_id, other columns and their names are ignored; ties
are settled as above; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .byte_bpe import ragged
from .stages import Stage, release, with_package

LEAST = 30
LONGEST = 4
SCALE = 2_000_000
#: Percent of a candidate's count at which a longer candidate covers it.
SHARE = 80
TOP = 2000
#: Pairs of best bound that grow in the first round, and the growth of that number.
FIRST, FASTER = 8000, 4
#: Bits of a filter (8 MB); a fuller one admits more windows, the result is the same.
FILTER_BITS = 26
#: Bytes of text in a block; a worker holds some 50 times as much at its peak.
BLOCK = 1 << 20
#: Phrases of a batch that Python hands on.
ROWS = 1 << 16

_PIECE_END = ~T._table([*b".,;:!?", *range(0x0A, 0x0E)])
_WORD = T._table([*b".,;:!? \t", *range(0x0A, 0x0E)])


# ---- windows of a block ----------------------------------------------------

@dataclass
class Block:
    """Words of a block of texts."""

    words: T.Words
    hashes: np.ndarray  # of the words
    piece: np.ndarray   # number of the piece of each word
    lang: np.ndarray    # language code of each word
    names: list[str]    # of the codes
    salts: np.ndarray   # of the codes

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words inside a piece."""
        n = len(self.piece) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.zeros(0, np.int64)

    def keys(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each word on, and their language."""
        h = T.window_hashes(self.hashes, size)
        return T.mix(h ^ self.salts[self.lang[: len(h)]])


def language_salts(names: list[str]) -> np.ndarray:
    raw = [x.encode() for x in names]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(x) for x in raw], np.int64)
    return T.span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends, seed=3)


def read_block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Block:
    data = T.lower(data)
    w = T.words(data, offsets, _WORD)
    owner = w.owner()
    new = np.ones(len(owner), bool)
    if len(owner):
        stops = np.flatnonzero(_PIECE_END[data])
        new[1:] = (np.searchsorted(stops, w.starts[1:]) != np.searchsorted(stops, w.ends[:-1])) | (owner[1:] != owner[:-1])
    lang = pc.dictionary_encode(rows.column("lang").cast(pa.string()))
    names = lang.dictionary.to_pylist()
    return Block(w, w.hashes(), np.cumsum(new), lang.indices.to_numpy(zero_copy_only=False)[owner], names, language_salts(names))


def _admits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, size)]))


def _texts(docs: DataFrame) -> DataFrame:
    with_package(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def counted(docs: DataFrame, size: int, chosen=None) -> DataFrame:
    """(lang, phrase, a): the number of occurrences of the windows of ``size``
    words that ``chosen`` (of a Block and the first words) admits."""
    def of_block(block):  # what a block holds is freed before the next is read
        at = block.windows(size)
        if chosen is not None and len(at):
            at = at[chosen(block, at)]
        if not len(at):
            return
        joined, word_starts, word_ends = T.joined_words(block.words)
        lang = block.lang[at]
        for code in np.unique(lang).tolist():
            mine = at[lang == code]
            starts, ends = word_starts[mine], word_ends[mine + size - 1]
            one, number = T.distinct_spans(joined, starts, ends)
            n = np.bincount(number, minlength=len(one))
            for lo in range(0, len(one), ROWS):
                part = one[lo: lo + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.names[code]] * len(part), pa.string()), _strings(joined, starts[part], ends[part]), pa.array(n[lo: lo + ROWS])],
                    names=["lang", "phrase", "n"])

    def run(batches):
        for rows, data, offsets in T.blocks(batches, limit=BLOCK):
            yield from of_block(read_block(rows, data, offsets))

    return _texts(docs).mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def pair_hashes(docs: DataFrame) -> DataFrame:
    """(key, n) of all pairs of words, by their hash alone."""
    def of_block(block):
        at = block.windows(2)
        return np.unique(block.keys(2)[at], return_counts=True) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches):
        for rows, data, offsets in T.blocks(batches, limit=BLOCK):
            key, n = of_block(read_block(rows, data, offsets))
            for lo in range(0, len(key), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(key[lo: lo + ROWS])), pa.array(n[lo: lo + ROWS])], names=["key", "n"])

    return _texts(docs).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


# ---- filters ---------------------------------------------------------------

def phrase_keys(phrases: DataFrame) -> DataFrame:
    """(key): the hash of each (lang, phrase), as ``Block.keys`` has it."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches, "phrase"):
            w = T.words(data, offsets, _WORD)
            names = rows.column("lang").to_pylist()
            salts, h, size = language_salts(names), w.hashes(), w.counts
            key = np.zeros(len(names), np.uint64)
            for n in np.unique(size[size > 0]).tolist():
                mine = np.flatnonzero(size == n)
                key[mine] = T.mix(T.window_hashes(h, n)[w.first[mine]] ^ salts[mine])
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(key))], names=["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key bigint")


def filter_bits(spark: SparkSession, keys: DataFrame):
    """A broadcast filter of FILTER_BITS bits, those of the given keys set."""
    at = F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1
    maps = (keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
                .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow())
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, part in zip(maps["bucket"].to_pylist(), maps["bits"]):
        part = np.frombuffer(part.as_buffer(), np.uint8)
        bits[(bucket - 1) * len(part): bucket * len(part)] = part
    return spark.sparkContext.broadcast(bits)


def _itself(bits, size: int):
    return lambda block, at: _admits(bits.value, block.keys(size)[at])


def _extends(grown, covered, size: int):
    """Windows one word longer than a phrase of ``grown`` at their begin or
    one of ``covered`` at their end."""
    def chosen(block: Block, at: np.ndarray) -> np.ndarray:
        keys = block.keys(size - 1)
        return _admits(grown.value, keys[at]) | _admits(covered.value, keys[at + 1])
    return chosen


# ---- scores ----------------------------------------------------------------

def _ratio(a: Column, rest: Column) -> Column:
    """floor(SCALE a / rest), exact beyond 64 bits."""
    return F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)")).cast("decimal(38,0)"), rest.cast("decimal(21,0)"))


def _sum(a: Column, b: Column) -> Column:
    return a.cast("decimal(20,0)") + b.cast("decimal(20,0)")


def _words_of(phrase: Column, low: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), low, n), " ")


def scored(phrases: DataFrame, size: int, known: dict[int, DataFrame]) -> DataFrame:
    """``phrases`` (lang, phrase, a) with l, r and score of the lowest-scoring
    cut, and ``bound``. ``known``: the counts of all parts by their length; a
    phrase with an unknown part has no score."""
    out = phrases.withColumn("_n", F.lit(size))
    for k in range(1, size):
        for name, low, n in ((f"_l{k}", 1, k), (f"_r{k}", k + 1, size - k)):
            part = known[n].select("lang", F.col("phrase").alias("_part"), F.col("a").alias(name))
            out = out.withColumn("_part", _words_of(F.col("phrase"), low, n)).join(part, ["lang", "_part"], "left").drop("_part")
    cuts = [F.struct(_ratio(F.col("a"), _sum(F.col(f"_l{k}"), F.col(f"_r{k}"))).alias("score"), F.lit(k).alias("k"),
                     F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in range(1, size)]
    whole = F.lit(True)
    for k in range(1, size):
        whole = whole & F.col(f"_l{k}").isNotNull() & F.col(f"_r{k}").isNotNull()
    least = F.when(whole, cuts[0] if size == 2 else F.least(*cuts))
    return (out.withColumn("_cut", least)
               .select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"),
                       _ratio(F.col("a"), _sum(F.col("_l1"), F.col("a"))).alias("bound")))


def _limits(pairs: DataFrame, grown: int) -> DataFrame:
    """(lang, theta): the bound of the pair of rank ``grown``; 0 where all grow.
    Bounds are whole numbers of at most SCALE / 2, so their histogram is small."""
    steps = pairs.groupBy("lang", "bound").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bound")))
    return (steps.withColumn("above", above).groupBy("lang")
                 .agg(F.coalesce(F.max(F.when(F.col("above") >= grown, F.col("bound"))), F.lit(0)).alias("theta")))


def _uncovered(phrases: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """The phrases of ``size`` words that none of the candidates one word longer covers."""
    parts = (longer.select("lang", F.explode(F.array(_words_of(F.col("phrase"), 1, size), _words_of(F.col("phrase"), 2, size))).alias("phrase"), "a")
                   .groupBy("lang", "phrase").agg(F.max("a").alias("_most")))
    both = phrases.join(parts, ["lang", "phrase"], "left")
    covers = F.col("_most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * SHARE
    return both.where(~F.coalesce(covers, F.lit(False))).drop("_most")


# ---- growth ----------------------------------------------------------------

def grow(docs: DataFrame, known: dict[int, DataFrame], pairs: DataFrame, limits: DataFrame, least: int) -> DataFrame:
    """All surviving candidates (lang, phrase, a, l, r, score) of a score of
    at least their language's theta, by growing the prefixes of such a bound."""
    spark = docs.sparkSession
    found = []
    level, known = pairs.join(limits, "lang"), dict(known)
    for size in range(3, LONGEST + 1):
        grown = filter_bits(spark, phrase_keys(level.where("bound >= theta")))
        best = level.where("score >= theta").select("lang", "phrase", "a", "l", "r", "score")
        covered = filter_bits(spark, phrase_keys(best))
        longer = Stage(counted(docs, size, _extends(grown, covered, size)).where(F.col("a") >= least), f"phrases-{size}").df
        found.append(_uncovered(best, longer, size - 1))
        # parts that no prefix led to; their phrases have a bound high enough
        parts = longer
        if size > 3:
            prefix = level.where("bound >= theta").select("lang", F.col("phrase").alias("_prefix"))
            parts = longer.join(prefix, [longer["lang"] == prefix["lang"], _words_of(longer["phrase"], 1, size - 1) == F.col("_prefix")], "left_semi")
            for n in range(3, size):
                wanted = parts.select("lang", F.explode(F.array(*[_words_of(F.col("phrase"), k, n) for k in range(1, size - n + 2)])).alias("phrase"))
                wanted = Stage(wanted.distinct().join(known[n], ["lang", "phrase"], "left_anti"), "phrase-parts").df
                if not wanted.isEmpty():
                    more = counted(docs, n, _itself(filter_bits(spark, phrase_keys(wanted)), n))
                    more = Stage(more.join(wanted, ["lang", "phrase"], "left_semi"), "phrase-parts").df
                    known[n] = known[n].unionByName(more)
        known[size] = longer
        level = Stage(scored(parts, size, known).join(limits, "lang"), f"scored-{size}").df
        release(spark)
    found.append(level.where("score >= theta").select("lang", "phrase", "a", "l", "r", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language), score."""
    spark = docs.sparkSession
    words = Stage(counted(docs, 1), "words").df
    totals = Stage(words.groupBy("lang").agg(F.sum("a").alias("n")), "word-totals").df
    words = words.where(F.col("a") >= least)
    often = filter_bits(spark, pair_hashes(docs).where(F.col("n") >= least).select("key"))
    counts = Stage(counted(docs, 2, _itself(often, 2)).where(F.col("a") >= least), "pairs").df
    pairs = Stage(scored(counts, 2, {1: words}), "scored-2").df
    release(spark)
    settled, grown = [], first
    while True:
        limits = Stage(_limits(pairs, grown), "limits").df
        found = Stage(grow(docs, {1: words, 2: counts}, pairs, limits, least), "found").df
        some = limits.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("survivors")), "lang", "left")
        some = Stage(some.withColumn("open", (F.col("theta") > 0) & (F.coalesce("survivors", F.lit(0)) < top)), "settled").df
        settled.append(found.join(some.where("not open").select("lang"), "lang", "left_semi"))
        if some.where("open").isEmpty():
            break
        pairs = pairs.join(some.where("open").select("lang"), "lang", "left_semi")
        grown *= FASTER
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (every.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
                 .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
