"""Language identification by Bayesian fusion of several kinds of evidence.

The posterior over languages multiplies a tempered likelihood of the text
(hashed letter trigrams), the reliability of what the document declares, the
language that its address names, and a prior of its host, smoothed through
the host's parent domains towards the corpus (grouped counts of all rows).
A background class of unordered letters takes text of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import row_key, small_or_joined, table, text_or_empty

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Share of declarations and addresses that are taken to be right, weight of the parent in a host prior.
DECLARED, ADDRESS, SMOOTHING, UNKNOWN_PRIOR = 0.9, 0.8, 20.0, 1e-3
#: Languages that are modelled at most.
MOST_LANGUAGES = 64
#: Trigrams of a text count as independent up to about this many.
TEMPER = 40.0
_ASCII = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-case letters of a whole text; other characters are spaces."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_ASCII) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            seen[lang] = seen.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
    if seen:
        yield pd.DataFrame({"lang": list(seen), "counts": [c.astype("<i8").tobytes() for c in seen.values()]})


def _declared(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and lang <> '' and text is not null and doc_id is not null")


def modelled(docs: DataFrame, most: int = MOST_LANGUAGES) -> list[str]:
    """The ``most`` languages that the most rows declare, ties by name, in their own order."""
    counts = _declared(docs).groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(most).collect())


def fit(docs: DataFrame, per_language: int = 1000, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language), the background last.

    Modelled are the ``most`` languages that the most rows declare, ties by
    name; a rarer declaration counts as none. Fitted on at most
    ``per_language`` rows of each, those whose ids hash lowest in each of as
    many buckets -- the documented bounds of this classifier's sample. Map
    tasks reduce the buckets first, so a language that most rows declare is no
    task's work alone. Rows without a text, a language or an id are not used.
    """
    known = _declared(docs).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    often = modelled(docs, most)
    buckets = known.where(F.col("lang").isin(often)).groupBy("lang", F.pmod("h", F.lit(per_language)).alias("b"))
    ids = buckets.agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id")).select("doc_id", "lang")
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    rows = sample.select("lang", "text").repartition(8).mapInPandas(_count, "lang string, counts binary").collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs) + 1, BUCKETS))
    for r in rows:
        counts[langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    total = counts.sum(axis=0)
    shared = (total + 0.5) / (total + 0.5).sum()
    p = (counts[:-1] + 500 * shared) / (counts[:-1].sum(axis=1, keepdims=True) + 500)
    flat = np.full((1, BUCKETS), 1 / BUCKETS)
    return langs, np.log(np.vstack([0.98 * p + 0.02 / BUCKETS, flat])).T.astype(np.float32)


def _likelihood(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = model.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                t = trigrams(text)
                out.append((table_[t].mean(axis=0, dtype=np.float64) * (TEMPER * len(t) / (TEMPER + len(t)))).tolist() if len(t) else None)
            yield pdf.drop(columns="text").assign(loglik=out)

    return run


def address_language(url: Column, langs: list[str]) -> Column:
    """The language that a path segment or the country suffix of the host names; null if none of ``langs``."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[-_][a-zA-Z]+)?(?:/|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return F.coalesce(*[F.when(x.isin(langs), x) for x in (path, suffix)]) if langs else F.lit(None).cast("string")


def host_prior(rows: DataFrame, langs: list[str], levels: list[str]) -> DataFrame:
    """(first level, prior array): declared languages counted per level, each smoothed towards the next, the last towards all rows.

    A host that declares nothing has the prior of its next level.
    """
    known = rows.where(F.col("declared").isin(langs)) if langs else rows.limit(0)
    each = F.array(*[F.coalesce(F.sum((F.col("declared") == x).cast("double")), F.lit(0.0)) for x in langs])
    world = known.agg(each.alias("c")).first()
    top = np.array(world["c"] if world and world["c"] and world["c"][0] is not None else [0.0] * len(langs)) + 1.0
    base = F.array(*[F.lit(float(x)) for x in top / top.sum()])
    counts = (rows if langs else known).groupBy(*levels).agg(each.alias("c"))
    prior: Column = base
    for i in range(len(levels) - 1, -1, -1):
        if i:
            up = counts.groupBy(levels[i]).agg(F.array(*[F.sum(F.element_at("c", k + 1)) for k in range(len(langs))]).alias(f"_c{i}"))
            counts = counts.join(up, levels[i], "left")
    for i in range(len(levels) - 1, -1, -1):
        c = F.col(f"_c{i}") if i else F.col("c")
        n = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        prior = F.zip_with(c, prior, lambda x, p: x + p * SMOOTHING)
        prior = F.transform(prior, (lambda n: lambda x: x / (n + SMOOTHING))(n))  # a second argument of the inner function would be the index
    return counts.select(levels[0], prior.alias("prior"))


def identify(rows: DataFrame, keep: list[str], langs: list[str], model: np.ndarray, levels: list[str]) -> DataFrame:
    """Posterior for rows of (``keep``, text, declared, address, ``levels``): adds language, confidence and accepted.

    Null or letterless text has no text evidence: its language is "und" and it
    is not accepted. Undeclared rows and unknown hosts fall back on the other
    evidence. Extra columns not in ``keep`` are dropped.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    cols = [*keep, "declared", "address", levels[0]]
    cols = list(dict.fromkeys(cols))
    small = rows.select(*cols, text_or_empty().alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields if f.name != "text"] + ["loglik array<double>"])
    scored = small.mapInPandas(_likelihood(shared), schema)
    prior = host_prior(rows.select("declared", *levels), langs, levels)
    joined = scored.join(prior, scored[levels[0]].eqNullSafe(prior[levels[0]]), "left").drop(prior[levels[0]])
    flat = F.array(*[F.lit(1.0 / max(1, len(langs)))] * len(langs))
    k = max(2, len(langs))

    def says(col: str, right: float, i: int) -> Column:
        c = F.col(col)
        return F.when(c.isNull() | ~c.isin(langs), 0.0).when(c == langs[i], float(np.log(right))).otherwise(float(np.log((1 - right) / (k - 1))))

    logs = [F.log(F.element_at(F.coalesce("prior", flat), i + 1)) + says("declared", DECLARED, i) + says("address", ADDRESS, i) + F.element_at("loglik", i + 1) for i in range(len(langs))]
    logs.append(F.lit(float(np.log(UNKNOWN_PRIOR))) + F.element_at("loglik", len(langs) + 1))
    out = joined.withColumn("_l", F.array(*logs)).withColumn("_m", F.array_max("_l"))
    names = F.array(*[F.lit(x) for x in [*langs, UNKNOWN]])
    total = F.aggregate(F.col("_l"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
    best = F.element_at(names, F.array_position("_l", F.col("_m")).cast("int"))
    return out.select(
        *keep,
        F.when(F.col("loglik").isNull(), UNKNOWN).otherwise(best).alias("language"),
        F.when(F.col("loglik").isNull(), 0.0).otherwise(1.0 / total).alias("confidence"),
    ).withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= 0.5))


def identify_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, language, confidence, accepted of every document: ``lang`` is its declaration, ``source`` its host.

    A null source is a host of its own. Columns besides ``keep``, whatever
    their names, are not looked at.
    """
    langs, model = fit(docs)
    rows = docs.select(*keep, "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("address"), F.coalesce("source", F.lit("")).alias("host"))
    return identify(rows, [*keep], langs, model, ["host"])


def page_evidence(pages: DataFrame, langs: list[str]) -> DataFrame:
    """(page_id, text, declared, address, host, domain, suffix): what a raw page says of its language; null markup and addresses say nothing."""
    markup = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    rows = pages.select("page_id", text.alias("text"), F.when(markup != "", markup).alias("declared"), address_language(F.col("url"), langs).alias("address"), host.alias("host"))
    return rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def identify_pages(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, language, confidence, accepted of raw pages: markup language, address suffix and hosts under their parent domains."""
    return identify(page_evidence(pages, langs), ["page_id"], langs, model, ["host", "domain", "suffix"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns as they are.

    Every row is judged by itself, whatever other rows have its id, or none.
    """
    rows = docs.withColumn("_row", row_key(docs))
    no = small_or_joined(identify_documents(rows, ("doc_id", "_row")).where("not accepted").select("doc_id", "_row").distinct(), "rejected")
    return rows.join(no, rows["doc_id"].eqNullSafe(no["doc_id"]) & (rows["_row"] == no["_row"]), "left_anti").select(*docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, confidence, accepted of all ``documents``.

    Null, empty and letterless texts are "und" and not accepted; null or
    repeated ids keep their rows; an empty table gives no rows.
    """
    return identify_documents(table(spark, sf_dir, "documents"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the whole fusion; the trigrams are fitted on the documents' declared languages."""
    langs, model = fit(table(spark, sf_dir, "documents"))
    return identify_pages(table(spark, sf_dir, "pages"), langs, model)


def op3_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, language, p): the prior of every host of ``pages``, smoothed through its domain and suffix towards all pages."""
    docs = table(spark, sf_dir, "documents")
    langs = modelled(docs)
    rows = page_evidence(table(spark, sf_dir, "pages"), langs).select("declared", "host", "domain", "suffix")
    prior = host_prior(rows, langs, ["host", "domain", "suffix"])
    return prior.select("host", F.explode(F.map_from_arrays(F.array(*map(F.lit, langs)), F.col("prior"))).alias("language", "p")).withColumn("p", F.round("p", 9))
