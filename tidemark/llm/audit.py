"""Filter interaction audit: what each of five filters removes at each step of every order, per part of the corpus.

Copies are found by sorting: documents are dealt by ranges of (fingerprint, doc_id), sorted by fingerprint, full text and doc_id,
and compared with their predecessors. Ranges do not split by text, so their bounds stay small on the driver; what a range's first
fingerprint shares with ranges before it is mended from one row for each text under the last fingerprint of every range. All
that is asked then follows from the number of documents of each part with each set of failures, which add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: The filters by letter; filter number b of them is bit b of a failure mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BLANK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of A to D: few words, few different words, many capitals, a forbidden character. Null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    solid = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(solid != "", F.split(solid, _BLANK)).otherwise(F.array().cast("array<string>"))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    tests = (n < 200, 100 * different < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(t, 1 << b).otherwise(0) for b, t in enumerate(tests)), F.lit(0))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, id, part, mask) of one range: the rows without their texts, with E's bit where an earlier row says so.

    Rows under the range's first fingerprint that no row of the range makes a copy carry fp and digest, to be looked up; ends
    (part null) are the texts under the last fingerprint, each with its least id. State is one row, and the texts of one fingerprint.
    """
    most = np.iinfo(np.int64).max
    first = last_fp = last_text = None
    least, ends = most, {}
    sha = lambda t: hashlib.sha256(t.as_py().encode("utf-8", "surrogatepass")).digest()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, text = batch.column(0).to_numpy(), batch.column(1)
        known = pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column(2), most).to_numpy()
        same = np.zeros(n, bool)
        same[0] = last_text is not None and last_fp == fp[0] and last_text.as_py() == text[0].as_py()
        same[1:] = fp[1:] == fp[:-1]
        near = np.flatnonzero(same[1:]) + 1
        same[near] = pc.equal(text.take(pa.array(near)), text.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        if same[0]:
            starts = np.concatenate([[0], starts])
        run = np.searchsorted(starts, np.arange(n), "right") - 1
        lowest = np.minimum.reduceat(ids, starts)
        if same[0]:
            lowest[0] = min(lowest[0], least)
        copy = known & (ids > lowest[run])
        if first is None:
            first = fp[0]
        is_open = known & ~copy & (fp == first)
        digests: dict[int, bytes] = {}
        for r in np.unique(run[is_open]).tolist():
            digests[r] = sha(text[int(starts[r])])
        if last_fp != fp[-1]:
            ends = {}
        for r in np.flatnonzero(fp[starts] == fp[-1]).tolist():
            d = digests.get(r) or sha(text[int(starts[r])])
            ends[d] = min(ends.get(d, most), int(lowest[r]))
        least, last_fp, last_text = int(lowest[-1]), fp[-1], text[n - 1]
        mask = batch.column(4).to_numpy() | np.where(copy, COPY, 0)
        looked = [digests[r] if o else None for r, o in zip(run.tolist(), is_open.tolist(), strict=True)] if is_open.any() else [None] * n
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(mask.astype(np.int32)), pa.array(fp, mask=~is_open), pa.array(looked, pa.binary())], names=["id", "part", "mask", "fp", "digest"])
    if rows := [(i, d) for d, i in ends.items() if i != most]:
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.array([last_fp] * k, pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["id", "part", "mask", "fp", "digest"])


def failure_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, part, mask) of every row, right for any fingerprint, quick for one that seldom collides. Null texts and sources are empty ones. A text is a copy (E) if a smaller id has it; a null
    id is not smaller or larger than any, and rows that share text and least id are no copies of each other."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    rows = docs.select(fingerprint(whole).alias("fp"), whole, F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"))
    in_order = rows.repartitionByRange("fp", "id").sortWithinPartitions("fp", "text", "id")
    found, _ = written(in_order.withColumn("mask", failures(F.col("text"))).mapInArrow(_compared, "id long, part string, mask int, fp long, digest binary"), "audit-masks")
    ends = found.where("part is null").groupBy("fp", "digest").agg(F.min("id").alias("least"))
    looked = found.where("part is not null and fp is not null").join(ends, ["fp", "digest"], "left")
    mended = looked.select("id", "part", F.when(F.col("least") < F.col("id"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))
    return found.where("part is not null and fp is null").select("id", "part", "mask").unionByName(mended)


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part with each set of failures; of these those labelled good and toxic.

    Several label rows of one id count together; documents without a label or an id are neither good nor toxic."""
    each = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    marks = marks.where("id is not null and (g or t)").groupBy("id").agg(F.max(F.coalesce("g", F.lit(False))).alias("g"), F.max(F.coalesce("t", F.lit(False))).alias("t"))
    known = each.where("id is not null").join(marks, "id", "left").select("part", "mask", "n", "g", "t")
    rest = each.where("id is null").select("part", "mask", "n", F.lit(None).cast("boolean").alias("g"), F.lit(None).cast("boolean").alias("t"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return known.unionByName(rest).groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("g").alias("good"), counted("t").alias("toxic"))


def interactions(counters: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    Counters of a part are 32 at most, so the rows made for them do not grow with the documents."""
    order = F.split(F.lit(",".join(ORDERS)), ",")[F.floor(F.col("i") / 5).cast("int")]
    steps = counters.select("*", F.explode(F.sequence(F.lit(0), F.lit(5 * len(ORDERS) - 1))).alias("i")).select("*", order.alias("filter_order"), (F.col("i") % 5 + 1).alias("step"))
    place = lambda f: F.instr("filter_order", f)
    bit = sum((F.when(place(f) == F.col("step"), 1 << b).otherwise(0) for b, f in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(place(f) < F.col("step"), 1 << b).otherwise(0) for b, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("bit", bit).withColumn("earlier", F.col("mask").bitwiseAND(before) != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    here = F.col("fails") & ~F.col("earlier")
    total = lambda test, c="n": F.sum(F.when(test, F.col(c)).otherwise(0))
    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(~F.col("earlier") & ~F.col("fails")).alias("kept"), total(here).alias("removed"), total(F.col("fails") & F.col("earlier")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of documents and labels. Every part that has a row gets its 600 rows, zeros included; no documents, no rows.
    Repeated rows count each. Long texts are sorted and split whole. failure_masks() and part_counters() say what nulls give."""
    counters, path = written(part_counters(failure_masks(docs), labels), "audit-counters")
    out, _ = written(interactions(counters), "audit")
    drop(docs.sparkSession, path)
    return out
