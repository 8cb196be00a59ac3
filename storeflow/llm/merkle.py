"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are phrases of a paragraph, paragraphs are lines, a section is a run
of ``FAN`` paragraphs, the root is over the sections. Phrases end at
punctuation and after words with certain last letters, so their bounds
follow the text and an insertion moves no later bound. Every node's hash is
over its children's hashes; the root is a SHA-256 over the section hashes
and the text's length. The fingerprint string holds all four levels:

    root ; sections ; paragraphs ; leaves      (hex, comma-separated)

Roots of equal texts are equal. ``likeness`` compares two leaf levels (the
Dice share of their distinct hashes); ``differing`` descends only branches
whose hashes differ and gives the paragraphs that were edited.

Everything is DataFrame expressions. Null text counts as empty text (one
paragraph without phrases); extra columns are ignored; rows that repeat a
doc_id are neighbours in the order of (doc_id, text hash), so each has one
next row; an empty table gives an empty result; a single document is its
own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stage, keyed_text

#: Paragraphs in a section.
FAN = 8
#: A phrase ends after a space after punctuation or one of these letters;
#: it keeps the space, so that the leaves hold the whole text.
PHRASE_END = r"(?<=[.!?;:|*dgs][ \t])"


def _tree(text: Column) -> Column:
    """Paragraph texts split in phrases."""
    return F.transform(F.split(text, "\n"), lambda p: F.split(p, PHRASE_END))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Columns <prefix>leaves (hash of each phrase), <prefix>paras, <prefix>sects
    (hashes) and <prefix>root (hex) of the text column."""
    hashed = F.transform(_tree(F.col(text)), lambda p: F.transform(p, lambda x: F.xxhash64(x)))
    nested = df.withColumn("_nested", hashed)
    out = (nested.withColumn(f"{prefix}leaves", F.flatten("_nested"))
                 .withColumn(f"{prefix}paras", F.transform("_nested", lambda p: F.xxhash64(p)))
                 .drop("_nested"))
    starts = F.sequence(F.lit(0), F.floor((F.size(f"{prefix}paras") - 1) / FAN).cast("int"))
    out = out.withColumn(f"{prefix}sects", F.transform(
        starts, lambda i: F.xxhash64(F.slice(F.col(f"{prefix}paras"), i * FAN + 1, F.lit(FAN)))))
    return out.withColumn(f"{prefix}root", F.sha2(F.concat_ws(
        ",", F.octet_length(text).cast("string"), _hexes(f"{prefix}sects")), 256))


def _hexes(hashes: str) -> Column:
    return F.array_join(F.transform(F.col(hashes), lambda h: F.lower(F.hex(h))), ",")


def fingerprint(prefix: str) -> Column:
    """The fingerprint string of a tree made by ``with_tree``."""
    return F.concat_ws(";", F.col(f"{prefix}root"), _hexes(f"{prefix}sects"), _hexes(f"{prefix}paras"), _hexes(f"{prefix}leaves"))


def likeness(a: str, b: str) -> Column:
    """Dice share of two leaf levels' distinct hashes, 0 to 1; equal empty
    levels are alike."""
    x, y = F.array_distinct(F.col(a)), F.array_distinct(F.col(b))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def differing(a: str, b: str) -> Column:
    """Numbers of the paragraphs at which two trees (prefixes ``a`` and ``b``)
    differ, found under the sections that differ."""
    part = lambda p, i: F.slice(F.col(f"{p}paras"), i * FAN + 1, F.lit(FAN))
    last = F.greatest(F.size(f"{a}sects"), F.size(f"{b}sects")) - 1
    sections = F.filter(F.sequence(F.lit(0), last),
                        lambda i: ~F.get(f"{a}sects", i).eqNullSafe(F.get(f"{b}sects", i)))
    inside = F.transform(sections, lambda i: F.transform(
        F.arrays_zip(part(a, i).alias("x"), part(b, i).alias("y")),
        lambda z, k: F.when(z["x"].eqNullSafe(z["y"]), F.lit(None)).otherwise(i * FAN + k)))
    return F.array_compact(F.flatten(inside))


#: What tells rows apart: doc_id (0 for null), a hash of the text (and of
#: whether doc_id is null), code points. None is null.
KEY = ["k_id", "k_text", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    return keyed_text(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k_text"),
        F.char_length("text").cast("bigint").alias("n_chars"))


def neighbours(texts: DataFrame) -> DataFrame:
    """One row per row of ``keyed`` in descending doc_id: doc_id, its key, its
    number ``at``, and number and key of the row whose next row it is
    (``of_at``, ``of_k_id`` ...). Numbers come from range-sorted blocks of
    narrow rows; a block's first row takes its predecessor from the last of
    the block before."""
    blocks = Stage(texts.select("doc_id", *KEY).orderBy(F.col("doc_id").desc_nulls_last(), "k_text", "n_chars")
                        .withColumn("block", F.spark_partition_id())
                        .withColumn("mid", F.monotonically_increasing_id()), "merkle-order").df
    sums = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"),
                                       F.max_by(F.struct(*KEY), "mid").alias("last_key"))
    # one row per sort partition, whatever the number of documents
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", "first", (F.sum("n").over(order) - F.col("n")).alias("offset"), F.sum("n").over(whole).alias("total"),
                       F.coalesce(F.lag("last_key").over(order), F.last("last_key").over(whole)).alias("carry"))
    inside = Window.partitionBy("block").orderBy("mid")
    return (blocks.join(F.broadcast(sums), "block")
                  .withColumn("at", F.col("offset") + F.col("mid") - F.col("first"))
                  .withColumn("of", F.coalesce(F.lag(F.struct(*KEY)).over(inside), F.col("carry")))
                  .select("doc_id", *KEY, "at", F.pmod(F.col("at") - 1, F.col("total")).alias("of_at"),
                          *[F.col(f"of.{k}").alias(f"of_{k}") for k in KEY]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_paragraphs for every text and its edited
    text: the last third of its code points replaced by the first as many
    (or all) of the next text in descending doc_id (after the last: the
    first). Texts are shuffled once, by their key; of the next text only the
    part that is used and the leaf hashes travel."""
    texts = keyed(docs)
    order = Stage(neighbours(texts), "merkle-neighbours").df
    rows = texts.groupBy(*KEY).agg(F.first("text").alias("text")).join(order, KEY)
    third = lambda chars: F.floor(chars / 3).cast("int")
    given = with_tree(rows, "text", "next_").select(
        *[F.col(f"of_{k}").alias(k) for k in KEY], "of_at", F.array_distinct("next_leaves").alias("next_leaves"),
        F.substring(F.col("text"), F.lit(1), third(F.col("of_n_chars"))).alias("given")).alias("given")
    own = rows.select("doc_id", *KEY, "at", "text").alias("own")
    # the number is compared by difference: rows stay dealt by their key alone
    same = [F.col(f"own.{k}") == F.col(f"given.{k}") for k in KEY] + [F.col("own.at") - F.col("given.of_at") == 0]
    n = F.col("n_chars")
    out = own.join(given, same).select("own.doc_id", "own.n_chars", "own.text", "given.given", "given.next_leaves").select(
        "doc_id", "n_chars", "text", "next_leaves",
        F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - third(n)), F.col("given")).alias("edited"))
    out = with_tree(with_tree(out, "text", ""), "edited", "edited_")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("").alias("fingerprint"), fingerprint("edited_").alias("edited_fingerprint"),
        likeness("leaves", "edited_leaves").alias("near_edited"), likeness("leaves", "next_leaves").alias("near_next"),
        differing("", "edited_").alias("edited_paragraphs"))
