"""Licence scan: sparse TF-IDF cosine to templates, then path inheritance.

Every file's whole text is scanned. A header is any passage as long as a
template (a shorter text is one passage; around the template's rarest term an
end of the text may cut it); a licence file is a file whose
whole text is close to a template, or whose name says so and that has a
header. Both are compared by the cosine of TF-IDF vectors: term counts times
ln((1 + files) / (1 + files with the term)) + 1, where frequencies of all
template terms are counted over all files and words outside every template
count as met in no file. A file's own licence is its best header of at least
``HEADER`` cosine (of equals the first id). A directory's licence is the best
of the licence files in it (cosine at least ``WHOLE``; of equals the first
id). A file without a header takes the licence of its nearest ancestor
directory that has one, found by joining paths.

Null text counts as empty; a null path is in no directory (own licence only);
repeated paths and rows each give a row; extra columns are ignored; without
templates, or in an empty table, nothing is found.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .decontamination import Lookup
from .stages import Stage, with_package

HEADER = 0.8
WHOLE = 0.7
LICENCE_NAMES = r"(?i)^(license|licence|copying|notice|unlicense)([.\-_].*)?$"

#: Notices by which a text states its licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@dataclass
class Templates:
    """Templates as term sequences over their common vocabulary."""

    ids: list[str]
    terms: list[list[int]]  # hashes
    idf: dict[int, float] = field(default_factory=dict)
    unmet: float = 1.0
    anchor: list[tuple[int, int]] = field(default_factory=list)  # (hash, offset) of the rarest term
    norm: list[float] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)

    @classmethod
    def of(cls, templates: dict[str, str]) -> Templates:
        names = sorted(templates)
        data, offsets = T.text_buffer(pa.array([templates[k] for k in names], pa.string()))
        w = T.words(T.lower(data), offsets, T.ALNUM)
        h = w.hashes().tolist()
        pairs = [(k, h[a:b]) for k, a, b in zip(names, w.first, w.first[1:]) if b > a]
        return cls([k for k, _ in pairs], [x for _, x in pairs])

    def weigh(self, n_files: int, frequency: dict[int, int]) -> None:
        self.unmet = float(np.log(1 + n_files) + 1)
        self.idf = {t: float(np.log((1 + n_files) / (1 + frequency.get(t, 0))) + 1) for x in self.terms for t in x}
        for x in self.terms:
            k = min(range(len(x)), key=lambda i: (-self.idf[x[i]], i))
            self.anchor.append((x[k], k))
            self.counts.append(Counter(x))
            self.norm.append(self.length(self.counts[-1]))

    def length(self, counts: Counter) -> float:
        return float(np.sqrt(sum((n * self.idf.get(t, self.unmet)) ** 2 for t, n in counts.items())))

    def cosines(self, counts: Counter) -> list[float]:
        """Cosine to every template of a text's term counts."""
        own = self.length(counts)
        out = []
        for theirs, norm in zip(self.counts, self.norm):
            dot = sum(n * counts.get(t, 0) * self.idf[t] ** 2 for t, n in theirs.items())
            out.append(dot / (own * norm) if own else 0.0)
        return out


def term_frequency(files: DataFrame, templates: Templates) -> tuple[int, dict[int, int]]:
    """Number of files, and files with each template term, over all files;
    the result is as small as the templates."""
    terms = np.unique(np.array([t for x in templates.terms for t in x], np.uint64))

    def run(batches):
        look, n, met = Lookup(terms), 0, np.zeros(len(terms), np.int64)
        for rows, data, offsets in T.blocks(batches):
            w = T.words(T.lower(data), offsets, T.ALNUM)
            at, k = look.find(w.hashes())
            pair = np.unique(w.owner()[at] * max(len(terms), 1) + k)
            if len(pair):
                met += np.bincount(pair % len(terms), minlength=len(terms))
            n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(terms))], pa.int32()), pa.array([n, *met.tolist()], pa.int64())],
                                         names=["term", "n"])

    found = {r.term: r.n for r in files.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), {int(t): found.get(k, 0) for k, t in enumerate(terms.tolist())}


def headers(files: DataFrame, templates, header: float = HEADER, whole: float = WHOLE) -> DataFrame:
    """Per file: its best header (id, cosine) of at least ``header``, and the
    best template for its whole text where that is at least ``whole``.
    ``templates``: a broadcast Templates. Running sums bound the cosine of every
    passage (a repeated term lengthens it only more); those that may be near
    enough are then compared exactly."""
    def run(batches):
        known = templates.value
        look = Lookup(np.array([t for x in known.terms for t in x], np.uint64))
        square = np.array([known.idf[t] ** 2 for t in look.keys.tolist()])
        weights = [np.array([c.get(t, 0) for t in look.keys.tolist()]) * square for c in known.counts]
        for rows, data, offsets in T.blocks(batches):
            w = T.words(T.lower(data), offsets, T.ALNUM)
            h, owner, counts, n = w.hashes(), w.owner(), w.counts, len(offsets) - 1
            found: list = [(None, 0.0)] * n
            full: list = [(None, 0.0)] * n
            at, k = look.find(h)
            if len(at):
                cost = np.full(len(h), known.unmet ** 2)
                cost[at] = square[k]
                length = np.concatenate([[0.0], np.cumsum(cost)])
                for t, x in enumerate(known.terms):
                    gain = np.zeros(len(h) + 1)
                    gain[at + 1] = weights[t][k]
                    gain = np.cumsum(gain)
                    begin, end = _passages(w.first, owner, at[h[at] == np.uint64(known.anchor[t][0])] - known.anchor[t][1], known.anchor[t][1], len(x))
                    dot = gain[end] - gain[begin]
                    near = np.flatnonzero((dot > 1e-6) & (dot >= (header - 1e-6) * known.norm[t] * np.sqrt(length[end] - length[begin])))
                    for a, b in zip(begin[near].tolist(), end[near].tolist()):
                        i, score = int(owner[a]), known.cosines(Counter(h[a:b].tolist()))[t]
                        if score >= header - 1e-9 and (-score, known.ids[t]) < (-found[i][1], found[i][0] or "\U0010ffff"):
                            found[i] = known.ids[t], score
                own = _squares(h, owner, cost, n)
                dots = np.stack([np.bincount(owner[at], weights[t][k], n) / known.norm[t] for t in range(len(known.ids))])
                for i in np.flatnonzero((counts > 0) & (dots.max(0) >= (whole - 1e-6) * np.sqrt(own)) & (dots.max(0) > 0)).tolist():
                    scores = known.cosines(Counter(h[w.first[i]: w.first[i + 1]].tolist()))
                    best = min(range(len(scores)), key=lambda t: (-scores[t], known.ids[t]))
                    full[i] = known.ids[best], scores[best]
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("path"),
                pa.array([x for x, _ in found], pa.string()), pa.array([round(s, 9) for _, s in found]),
                pa.array([x for x, _ in full], pa.string()), pa.array([round(s, 9) for _, s in full])],
                names=["doc_id", "path", "header_id", "header_score", "whole_id", "whole_score"])

    return files.mapInArrow(run, "doc_id bigint, path string, header_id string, header_score double, whole_id string, whole_score double")


def _passages(first: np.ndarray, owner: np.ndarray, around: np.ndarray, offset: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of every passage of ``size`` words inside a text, of texts
    that are shorter, and of passages from ``around`` on (where the rarest term
    is at its ``offset``) that an end of the text cuts."""
    begin = np.arange(len(owner))
    begin = begin[begin + size <= first[1:][owner]]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    text = owner[around + offset]
    low, high = np.maximum(around, first[text]), np.minimum(around + size, first[text + 1])
    cut = high - low < size
    return np.concatenate([begin, first[short], low[cut]]), np.concatenate([begin + size, first[short + 1], high[cut]])


def _squares(h: np.ndarray, owner: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """The squared length of each text's vector; ``cost`` is a word's squared weight."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    times = np.diff(np.append(new, len(h)))
    return np.bincount(owner[new], times.astype(float) ** 2 * cost[order][new], n)


def directory(path):
    """The directory of a path; the top directory is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path):
    """All directories above, the nearest first, the top directory last."""
    parts = F.split(path, "/")
    up = F.sequence(F.size(parts), F.lit(0), F.lit(-1))
    return F.transform(up, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(files: DataFrame, templates: dict[str, str] | None = None, header: float = HEADER, whole: float = WHOLE) -> DataFrame:
    """``files``: doc_id, path, text. Per row: doc_id, path, license, origin
    ('header', 'file', 'inherited' or null), score, from_directory."""
    spark = with_package(files.sparkSession)
    files = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"),
                         F.coalesce("text", F.lit("")).alias("text"))
    known = Templates.of(TEMPLATES if templates is None else templates)
    known.weigh(*term_frequency(files, known))
    found = Stage(headers(files, spark.sparkContext.broadcast(known), header, whole), "licence-headers").df
    named = F.regexp_like(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENCE_NAMES))
    is_file = (F.col("whole_score") >= whole) | (F.coalesce(named, F.lit(False)) & (F.col("header_score") >= header))
    file_id = F.when(F.col("whole_score") >= whole, F.col("whole_id")).otherwise(F.col("header_id"))
    file_score = F.when(F.col("whole_score") >= whole, F.col("whole_score")).otherwise(F.col("header_score"))
    own = (found.withColumn("is_file", is_file).withColumn("has_header", F.col("header_score") >= header)
                .withColumn("own_id", F.when(F.col("is_file"), file_id).when(F.col("has_header"), F.col("header_id")))
                .withColumn("own_score", F.when(F.col("is_file"), file_score).when(F.col("has_header"), F.col("header_score")))
                .withColumn("directory", directory(F.col("path"))))
    # one licence per directory: highest score, of equals the first id
    declared = (own.where("is_file and directory is not null").groupBy("directory")
                   .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_id").alias("id"))).alias("best"))
                   .select(F.col("directory").alias("ancestor"), F.col("best.id").alias("found")))
    # directories are few beside files: the nearest licensed ancestor of each
    above = (own.where("directory is not null").select("directory").distinct()
                .select("directory", F.posexplode(ancestors(F.col("directory"))).alias("distance", "ancestor"))
                .join(declared, "ancestor")
                .groupBy("directory").agg(F.min(F.struct("distance", "ancestor", "found")).alias("near"))
                .select("directory", F.col("near.ancestor").alias("from_directory"), F.col("near.found").alias("inherited")))
    rest = own.join(above, "directory", "left")
    origin = (F.when(F.col("is_file"), "file").when(F.col("has_header"), "header")
               .when(F.col("inherited").isNotNull(), "inherited"))
    return rest.select("doc_id", "path", F.coalesce("own_id", "inherited").alias("license"), origin.alias("origin"),
                       F.col("own_score").alias("score"),
                       F.when(origin == "inherited", F.col("from_directory")).alias("from_directory"))
