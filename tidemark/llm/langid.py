"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, mixed, unused, written

UNKNOWN = "und"
#: Hash buckets, lengths of n-grams, and the additive smoothing.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.1
#: Languages of one block of the model. With BUCKETS that bounds one broadcast (32 MB) and what the driver holds at a time.
LANGUAGE_BLOCK = 256
#: Code points that numpy works on at a time.
_CHUNK = 1 << 17
_SPACE = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    #: BUCKETS x languages
    log_likelihood: np.ndarray


def _letters() -> np.ndarray:
    """Code points of the first plane in lower case, all that is no letter as a space."""
    return np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i if c.isalpha() else _SPACE for i in range(1 << 16)], np.uint32)


_TABLE: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams and the row of each, in pieces of bounded size; long texts go over several pieces, overlapping by an n-gram.

    A text ends in two spaces, so that its last n-grams hold its end and none reaches into the next text.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    held, rows, size = [], [], 0
    tail = max(ORDERS) - 1

    def ready() -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(codes < (1 << 16), _TABLE[0][np.minimum(codes, 0xFFFF)], codes).astype(np.uint64)
        lengths = np.array([len(t) for t in held])
        owner = np.repeat(np.array(rows), lengths)
        last = np.repeat(np.cumsum(lengths), lengths) - tail
        begins = np.arange(len(codes)) < last
        out, whose = [], []
        key = np.zeros(len(codes), np.uint64)
        for n in range(1, tail + 2):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[: len(codes) - n + 1] = low[n - 1 :]
            key = (key << np.uint64(21)) | shifted
            if n in ORDERS:
                kept = begins & (low != _SPACE) if n == 1 else begins
                out.append((mixed(key[kept] * np.uint64(4) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
                whose.append(owner[kept])
        return np.concatenate(out), np.concatenate(whose)

    for i, text in enumerate(texts):
        text += " " * tail
        for at in range(0, max(1, len(text) - tail), _CHUNK):
            part = text[at : at + _CHUNK + tail]
            held.append(part)
            rows.append(i)
            size += len(part)
            if size >= _CHUNK:
                yield ready()
                held, rows, size = [], [], 0
    if held:
        yield ready()


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a whole partition by language and bucket; the bucket -1 counts documents."""
    known: dict[str, int] = {}
    counts: list[np.ndarray] = []

    def flushed() -> Iterator[pd.DataFrame]:
        for lang, k in known.items():
            at = np.flatnonzero(counts[k])
            yield pd.DataFrame({"lang": lang, "bucket": at - 1, "n": counts[k][at]})

    for batch in batches:
        for lang, texts in batch.groupby("lang").text:
            if lang not in known:
                if len(known) == 64:
                    yield from flushed()
                    known, counts = {}, []
                known[lang] = len(known)
                counts.append(np.zeros(BUCKETS + 1, np.int64))
            own = counts[known[lang]]
            own[0] += len(texts)
            for buckets, _ in chunks(texts.tolist()):
                own[1:] += np.bincount(buckets, minlength=BUCKETS)
    yield from flushed()


def _sums(labelled: DataFrame, text: str, lang: str) -> tuple[DataFrame, str]:
    """(lang, bucket, n) of all labelled rows as a table; the bucket -1 counts documents. Rows without a text, a letter or a
    language teach nothing."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    return written(rows.mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "langid")


def _block(sums: DataFrame, documents: dict[str, int], languages: list[str]) -> Model:
    got = sums.where((F.col("bucket") >= 0) & F.col("lang").isin(languages)).toPandas()
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    table[got.bucket.to_numpy(int), np.searchsorted(languages, got.lang.to_numpy(object))] += got.n.to_numpy(float)
    prior = np.array([documents[x] for x in languages], float)
    return Model(languages, np.log(prior / sum(documents.values())), np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def fit_blocks(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Iterator[Model]:
    """The model of all languages, LANGUAGE_BLOCK of them at a time in the order of their names; each holds its own columns of the
    matrix and the priors among all languages.

    Every partition counts its own rows, Spark adds the counts by (language, bucket), and the driver gets the sums of one block
    at a time, whatever the size of the corpus.
    """
    sums, path = _sums(labelled, text, lang)
    documents = {r.lang: r.n for r in sums.where("bucket = -1").collect()}
    languages = sorted(documents)
    for at in range(0, len(languages), LANGUAGE_BLOCK):
        yield _block(sums, documents, languages[at : at + LANGUAGE_BLOCK])
    drop(labelled.sparkSession, path)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all labelled rows in one piece, for LANGUAGE_BLOCK languages or fewer."""
    blocks = list(fit_blocks(labelled, text, lang))
    if len(blocks) > 1:
        raise ValueError("more languages than one block holds: use fit_blocks")
    return blocks[0] if blocks else Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))


def log_scores(texts: list[str], model: Model) -> np.ndarray:
    """Rows x languages: logarithms of prior times likelihood."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for buckets, rows in chunks(texts):
        order = np.argsort(rows, kind="stable")
        buckets, rows = buckets[order], rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(first):
            for k in range(len(model.languages)):
                total[rows[first], k] += np.add.reduceat(model.log_likelihood[:, k][buckets], first, dtype=np.float64)
    return total


def score(texts: list[str], model: Model) -> np.ndarray:
    """Rows x languages: posterior probabilities."""
    total = log_scores(texts, model)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model | Iterable[Model], text: str = "text", into: str = "language") -> DataFrame:
    """docs with one more column: struct<lang, score>. The log-probability matrix is broadcast, block by block.

    Each block keeps a text's best language so far and the sum over all languages so far, so that any number of languages
    gives the same scores as one matrix. UNKNOWN with score 0 where the text is null or has no letter, or the model knows no
    language. Map-only; other columns pass through, one named like the new one is replaced; ties go to the first language in
    order.
    """
    spark = docs.sparkSession
    best = F.lit(None).cast("struct<lang:string,top:double,all:double>")
    held, out = unused(docs, "best"), docs
    out = out.withColumn(held, best)
    for block in [model] if isinstance(model, Model) else model:
        if block.languages:
            out = out.withColumn(held, _over_block(spark.sparkContext.broadcast(block))(F.col(f"`{text}`"), F.col(held)))
    found = F.col(held)
    score_ = F.exp(found["top"] - found["all"])
    known = F.struct(found["lang"].alias("lang"), F.least(score_, F.lit(1.0)).alias("score"))
    return out.withColumn(into, F.when(found["lang"].isNotNull(), known).otherwise(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))).drop(held)


def _over_block(shared):
    @F.pandas_udf("struct<lang:string,top:double,all:double>")
    def over(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array(own.languages, object)
        for batch, before in batches:
            lang, top, whole = before["lang"].to_numpy(object).copy(), before["top"].to_numpy(float).copy(), before["all"].to_numpy(float).copy()
            asked = np.array([i for i, t in enumerate(batch) if has_letter(t)], int)
            for at in range(0, len(asked), 1024):
                some = asked[at : at + 1024]
                logs = log_scores([batch.iat[i] for i in some], own)
                first = logs.argmax(axis=1)
                highest = logs.max(axis=1)
                added = highest + np.log(np.exp(logs - highest[:, None]).sum(axis=1))
                new = np.isnan(top[some])
                better = new | (highest > np.where(new, -np.inf, top[some]))
                lang[some[better]], top[some[better]] = names[first[better]], highest[better]
                whole[some] = np.where(new, added, np.logaddexp(np.where(new, 0.0, whole[some]), added))
            yield pd.DataFrame({"lang": lang, "top": top, "all": whole})

    return over


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo folds, is 0. A null id is kept."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == 0, F.lit(True))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    model = fit_blocks(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model, into="_language").select("doc_id", held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))


def known_languages(docs: DataFrame) -> DataFrame:
    """The documents in a language that the model knows, with their own columns; those it calls UNKNOWN go."""
    model, into = fit_blocks(docs.where(~held_out())), unused(docs, "language")
    return identify(docs, model, into=into).where(F.col(into)["lang"] != UNKNOWN).drop(into)
