"""Substring deduplication: repeated lines and sentences, by global digests of normalised units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent_limit, join_frequent, materialise, small_batches, unpacked, whole_row

LEAST_WORDS = 8
_BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def split_units(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of the units of ``text`` with ``least_words`` words or more.

    Units end at line breaks and, within a line, after . ! or ? before white space.  The normal
    form is lower case with single spaces, without punctuation at the ends.
    """
    at = 0
    for stop, after in [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        unit = text[at:stop]
        if len(unit) >= 2 * least_words - 1:
            words = unit.lower().split()
            if len(words) >= least_words:
                lead = len(unit) - len(unit.lstrip())
                yield at + lead, at + len(unit.rstrip()), len(words), " ".join(words).strip(" .,;:!?\"'()[]-")
        at = after


def units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit: doc_id, start, end (code points), words, digest, first_here.

    ``first_here`` is the start of the same unit's first occurrence in its document.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, words, digests, firsts = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                here: dict[bytes, int] = {}
                for start, end, n, form in split_units(text or "", least_words):
                    digest = hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=16).digest()
                    rows.append(i)
                    starts.append(start)
                    ends.append(end)
                    words.append(n)
                    digests.append(digest)
                    firsts.append(here.setdefault(digest, start))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    *(pa.array(x, pa.int32()) for x in (starts, ends, words)),
                    pa.array(digests, pa.binary()),
                    pa.array(firsts, pa.int32()),
                ],
                names=["doc_id", "start", "end", "words", "digest", "first_here"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start int, end int, words int, digest binary, first_here int")


def find_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The units to remove: all but the earliest occurrence by (doc_id, start) of each normal form.

    One row per removed unit: doc_id, start, end (offsets in the original text, code points),
    words, first_doc_id (where the kept occurrence is) and n_docs (documents that hold the unit).
    Rows with the same id are one document; null ids rank last.  Units of fewer than
    ``least_words`` words are never removed.  Null and empty texts have no units; an empty table
    gives no rows; other columns are ignored.
    """
    found = materialise(units(docs, least_words), "units")
    # copies of a form in one document are one row, so the earliest document is the least id; both
    # steps combine frequent forms before their shuffle
    held = found.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    first = held.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs"), F.sum("n").alias("n")
    )
    first = materialise(first.filter("n > 1"), "repeated")
    frequent = first.filter(F.col("n") > frequent_limit(found.count())).select("digest")
    met = join_frequent(found, first.drop("n"), "digest", frequent)
    later = (F.col("start") != F.col("first_here")) | ~F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    return met.filter(later).select("doc_id", "start", "end", "words", "first_doc_id", "n_docs")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from ``text``; ``removed`` holds their original offsets.

    All rows stay; line breaks around a removed unit stay too.  The ids must be unique.  A column
    ``removed`` of ``docs`` is given as ``removed_in``.
    """
    spans = (
        find_repeats(docs, least_words)
        .groupBy(F.col("doc_id").alias("cut_id"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "first_doc_id"))).alias("spans"))
    )
    empty = F.expr("cast(array() as " + spans.schema["spans"].dataType.simpleString() + ")")
    cut = F.expr(
        "array_join(transform(sequence(0, size(spans)), i -> substring(whole,"
        " if(i = 0, 0, spans[i - 1].end) + 1,"
        " if(i = size(spans), char_length(whole), spans[i].start) - if(i = 0, 0, spans[i - 1].end))), '')"
    )
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("whole"), whole_row(docs))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("cut_id")), "left").withColumn("spans", F.coalesce("spans", empty))
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col("whole")).alias("text")
    kept = [text if name == "text" else c for c, name in zip(unpacked(docs, ["removed"]), docs.columns)]
    return joined.select(*kept, F.col("spans").alias("removed"))
