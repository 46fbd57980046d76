"""Language of web pages by fusing evidence in Bayes' rule.

What speaks for a language is the likelihood of the page's words, the language its markup declares, and a prior from its
address. Word likelihoods come from counts of hashed words over all texts whose language is known. Every language of the texts
takes part; likelihoods are shipped for as many at a time as fit a fixed size, with a pass over the pages for each. A first posterior from words alone is summed by declared language and by host, registered domain and suffix; these sums
give how often each declaration goes with each language, and a prior per host that is smoothed towards its domain's, that
towards its suffix's, and that towards the prior over all pages. A page's own share is taken out of the sums that it is judged by.

Sums are of whole millionths, so they do not depend on the order of tasks; a host with a third of all pages costs one row
per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import LOWER, PIECES, slices, word_hashes

BUCKETS = 1 << 15
#: Likelihoods that are shipped at once.
MODEL_BYTES = 1 << 25
#: Up to so many languages sums are columns of one aggregate, beyond that rows.
COLUMNS = 64
#: Numbers of one kind that are looked at together.
CELLS = 1 << 20
#: A text counts as if it had at most so many words.
EVIDENCE = 50
#: Pages that a level's own counts must outweigh.
STRENGTH = 5.0
MILLION = 1_000_000

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

_U = np.uint64


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes(column, PIECES, LOWER)
    return (words & _U(BUCKETS - 1)).astype(np.int64), first


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: n for n, name in enumerate(languages)}
        for batch in slices(batches, "text"):
            rows, first = _buckets(batch.column(1))
            own = np.repeat([number[x] for x in batch.column(0).to_pylist()], np.diff(first)).astype(np.int64)
            cells, n = np.unique(own * BUCKETS + rows, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells // BUCKETS, pa.int32()), pa.array(cells % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    return run


class WordModel:
    """Counts of hashed words in all texts with a known language, as a table, and smoothed likelihoods for a run of languages."""

    def __init__(self, docs: DataFrame, scratch, lang: str = "lang", text: str = "text"):
        known = docs.select(F.lower(F.trim(F.col(lang))).alias("lang"), F.col(text).alias("text")).where("lang <> '' and text is not null")
        self.languages = sorted(row["lang"] for row in known.select("lang").distinct().collect())
        self.counts = scratch.put(known.mapInArrow(_count(self.languages), "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        got = self.counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(BUCKETS)
        sums[got["bucket"].to_numpy()] = got["n"].to_numpy()
        self.share = (sums + 1) / (sums.sum() + BUCKETS)

    def part(self, start: int, end: int) -> np.ndarray:
        """Log likelihood of each hashed word in the languages from start to before end; zeros without any language."""
        table = np.zeros((end - start, BUCKETS))
        if not self.languages:
            return table
        got = self.counts.where(F.col("lang").between(start, end - 1)).toArrow()
        table[got["lang"].to_numpy() - start, got["bucket"].to_numpy()] = got["n"].to_numpy()
        table += 0.5 * BUCKETS * self.share
        return np.log(table) - np.log(table.sum(1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_evidence(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Log likelihood of each text in each language, as of at most `EVIDENCE` words; zeros without words."""
    rows, first = _buckets(column)
    count = np.diff(first)
    sums = np.zeros((len(count), len(model)))
    full = np.flatnonzero(count)
    for n in range(len(model) if len(full) else 0):
        sums[full, n] = np.add.reduceat(model[n][rows], first[:-1][full])
    return sums * (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _portions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // width)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def fused(evidence: np.ndarray, own: np.ndarray, declared: np.ndarray, levels: list[np.ndarray], total: np.ndarray) -> np.ndarray:
    """The posterior: evidence and own first posterior, sums of the page's declaration, of suffix, domain and host, and of all pages.

    All sums hold the page itself, which is taken out first.
    """
    k = evidence.shape[1]
    rest = np.maximum(total - own, 0)
    everywhere = rest + 1
    prior = everywhere / everywhere.sum(1, keepdims=True)
    for level in levels:
        counts = np.maximum(level - own, 0)
        prior = (counts + STRENGTH * prior) / (counts.sum(1, keepdims=True) + STRENGTH)
    said = np.maximum(declared - own, 0)
    base = (rest + 1) / (rest.sum(1, keepdims=True) + k)
    likely = (said + base) / (rest + 1)  # of this declaration, given each language
    return softmax(evidence + np.log(prior) + np.log(likely))


def identify(pages: DataFrame, docs: DataFrame, scratch, page_id: str = "page_id", url: str = "url", html: str = "html", lang: str = "lang", text: str = "text", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row per page: page_id, lang, confidence (0 to 1, six places), text_lang (from words alone), declared, host.

    Ties go to the first language by name. A null or empty page has no words and no declaration, an address without a
    host no place in the hierarchy; the prior over all pages then decides. A declaration that is no language of the texts
    counts as a declaration of its own kind. Repeated pages are pages each. Without any text of known language lang and
    text_lang are null and confidence is 0; an empty table gives no rows. Other columns are not looked at.
    """
    model = WordModel(docs, scratch, lang, text)
    languages, k = model.languages, max(1, len(model.languages))
    context = pages.sparkSession.sparkContext
    kind = pages.schema[page_id].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    raw = pages.select(
        F.col(page_id).alias("page_id"), F.nullif(host, F.lit("")).alias("host"), F.coalesce(F.lower(F.regexp_extract(F.col(html), DECLARED, 1)), F.lit("")).alias("declared"),
        F.regexp_replace(F.col(html), HIDDEN, " ").alias("text"),
    )

    def first_look(df: DataFrame, start: int, end: int, fields: str) -> DataFrame:
        """The text, which is the last column, gives way to its evidence for a run of languages."""
        shipped = context.broadcast(model.part(start, end))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                evidence = text_evidence(batch.column("text"), shipped.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(evidence, pa.float64())], names=[*batch.schema.names[:-1], "evidence"])

        return df.mapInArrow(run, f"{fields}, evidence array<double>")

    def first_posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, k):
            evidence = np.asarray(batch.column("evidence").flatten(), float).reshape(-1, k)
            own = np.rint(softmax(evidence) * MILLION).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(own, pa.int64())], names=[*batch.schema.names, "own"])

    fields, step = f"page_id {kind}, host string, declared string", max(1, model_bytes // (8 * BUCKETS))
    if k <= step:
        judged = first_look(raw, 0, k, fields)
    else:
        raw = scratch.put(raw.withColumn("row", F.monotonically_increasing_id()))
        parts = [scratch.put(first_look(raw.select("row", "text"), n, min(n + step, k), "row bigint")).withColumnRenamed("evidence", f"e{n}") for n in range(0, k, step)]
        judged = raw.drop("text")
        for part in parts:
            judged = judged.join(part, "row")
        judged = judged.select("page_id", "host", "declared", F.concat(*[f"e{n}" for n in range(0, k, step)]).alias("evidence"))

    labels = F.split("host", r"\.")
    looked = scratch.put(
        judged.mapInArrow(first_posterior, f"{fields}, evidence array<double>, own array<bigint>")
        .withColumn("domain", F.when(F.col("host").isNotNull(), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))
        .withColumn("suffix", F.element_at(labels, -1))
    )

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        if k <= COLUMNS:
            return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("own")[n]) for n in range(k)]).alias("own"))
        each = df.select(*keys, F.posexplode("own").alias("n", "x")).groupBy(*keys, "n").agg(F.sum("x").alias("x"))
        return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("own"))

    by_host = scratch.put(summed(looked.where("host is not null"), "host", "domain", "suffix"))
    by_domain = summed(by_host, "domain", "suffix")
    by_suffix = summed(by_domain, "suffix")
    said = scratch.put(summed(looked, "declared"))
    total = summed(said).first()
    total = np.array(total[0] if total and total[0] and total[0][0] is not None else [0] * k, float) / MILLION
    levels = by_host.select("host", "domain", "suffix", F.col("own").alias("h")).join(by_domain.select("domain", F.col("own").alias("d")), "domain")
    levels = scratch.put(levels.join(by_suffix.select("suffix", F.col("own").alias("s")), "suffix").select(F.col("host").alias("at"), "h", "d", "s"))
    gathered = looked.join(levels, looked["host"] == levels["at"], "left").join(said.select(F.col("declared").alias("said"), F.col("own").alias("m")), F.col("declared") == F.col("said"), "left")
    none = F.array_repeat(F.lit(0).cast("long"), k)
    ready = gathered.select("page_id", "host", "declared", "evidence", "own", *[F.coalesce(c, none).alias(c) for c in ("m", "s", "d", "h")])

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, k):
            columns = [np.asarray(batch.column(n).flatten(), float).reshape(-1, k) for n in range(3, 9)]
            evidence, own, m, s, d, h = columns[0], *[c / MILLION for c in columns[1:]]
            found = fused(evidence, own, m, [s, d, h], total) if len(evidence) else np.zeros((0, k))
            names = pa.array([*languages] or [None], pa.string())
            best, words = (names.take(pa.array(x.argmax(1) if len(x) else np.zeros(0, np.int64), pa.int64())) for x in (found, own))
            sure = np.round(found.max(1, initial=0), 6) if languages else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), best, pa.array(sure, pa.float64()), words, batch.column(2), batch.column(1)], names=["page_id", "lang", "confidence", "text_lang", "declared", "host"])

    return ready.mapInArrow(last_look, f"page_id {kind}, lang string, confidence double, text_lang string, declared string, host string")
