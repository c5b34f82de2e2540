"""Language identification by Bayesian fusion of evidence.

For each language the log-probabilities of independent evidence add up:

* the text, by character trigrams (hashed, smoothed counts) of a model fitted on
  a bounded sample of each language's labelled documents, however rare it is;
  trigrams overlap and repeat, so their sum is tempered;
* the declared markup language and the address's suffix (a country's or a path's
  language), each right with a fixed probability;
* the host, by how often its texts alone suggest each language: counts of the
  host, smoothed towards its registered domain, that towards its top-level
  domain, that towards all rows. These come from grouped aggregations; a row's own
  vote is taken out of its host's counts.

One more hypothesis, "und", stands for text of none of the languages: all
trigrams alike. A row is rejected if "und" wins, if it has no trigram at all, or
if the best posterior is below a threshold.

Counts are pre-aggregated by host. Rows without a host go round the join; the rows
of hosts with more than one row in HOT (so fewer than HOT hosts) are joined to their
counts in SALT parts. Null or empty texts, and texts without letters, have no trigrams:
they get the best language of the other evidence and are rejected. Null hosts,
suffixes and declarations give no evidence. Repeated rows count as often as they
occur.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, read, tune

#: Labelled documents of a language that the trigram counts are taken from, at most: those with the smallest hashes.
FIT_ROWS = 1_000
#: Rows of the sample's table that are broadcast, at most; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
HASHES = 1 << 15
#: Weight of a trigram's log-probability, and the number of trigrams beyond which a text counts as this many.
TEMPER, ENOUGH = 0.3, 400
#: Prior of "und", chance that a declaration or suffix is right, least posterior.
UND, RIGHT_DECLARED, RIGHT_SUFFIX, LEAST = 0.001, 0.9, 0.8, 0.4
#: Rows' worth of the parent's shares in a host's or domain's.
PRIOR = 5.0
HOT, SALT = 64, 16
STEP_CHARS = 1_000_000

# Languages that country domains suggest.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}
# Second labels under which country domains are registered.
SECOND_LEVEL = "ac co com edu gob gov gouv ltd me mil ne net or org plc sch".split()

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")


def visible(page: str) -> str:
    """A page's text: scripts, styles, comments and tags become blanks, entities characters."""
    return _html.unescape(_DROP.sub(" ", page))


def codes(text: str) -> np.ndarray:
    """Letters in lower case, runs of anything else as one blank."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((a >= 97) & (a <= 122)) | ((a >= 0xAA) & (a != 0xD7) & (a != 0xF7) & ~((a >= 0x2000) & (a <= 0x2BFF)))
    a = np.where(letter, a, 32)
    return a[letter | np.concatenate([[True], letter[:-1]])] if len(a) else a


def trigrams(text: str) -> np.ndarray:
    """Hashes of the trigrams that hold a letter."""
    a = np.concatenate([[32], codes(text), [32]]).astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = (a[:-2] * np.uint64(0x9E3779B1) + a[1:-1]) * np.uint64(0x85EBCA77) + a[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
    return h[a[1:-1] != 32].astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # (HASHES, languages + 1): log-probabilities; the last is "und"


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT_ROWS) -> Model:
    """Trigram counts of at most `most` distinct texts of each language, added up on the executors; HASHES numbers for each language reach the driver."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    # hashes below a bound that leaves a few times as many of a language as are taken, then the least of those
    each = rows.select("lang", "h").distinct()
    sizes = each.groupBy(F.col("lang").alias("of")).count()
    order = F.xxhash64("h")
    few = each.join(sizes, F.col("lang") == F.col("of")).where(F.col("count") * (F.shiftrightunsigned(order, 1) / float(1 << 63)) <= 4.0 * most + 100)
    use = cut(few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "h"))).where(F.col("k") <= most).select("lang", "h"))  # at most `most` rows of a language
    use = F.broadcast(use) if use.count() <= BROADCAST_ROWS else use
    rows = rows.join(use, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(text), minlength=HASHES)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "hash": at, "n": n[at]})

    got = rows.mapInArrow(run, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    got = got.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()) | {r["of"] for r in sizes.collect()})
    place = {x: k for k, x in enumerate(languages)}
    n = np.full((HASHES, len(languages) + 1), 0.1)
    n[got.column("hash").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    n[:, -1] = 1.0
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def evidence(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihoods (texts, languages + 1), and the number of trigrams."""
    out, count = np.zeros((len(texts), len(model.languages) + 1)), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), STEP_CHARS):
            t = trigrams(text[at : at + STEP_CHARS])
            count[k] += len(t)
            out[k] += model.logs[t].sum(axis=0, dtype=np.float64)
    return out * (TEMPER * np.minimum(1.0, ENOUGH / np.maximum(count, 1)))[:, None], count


def with_evidence(rows: DataFrame, model: Model, *, html: bool = False) -> DataFrame:
    """rows (with text) with logs array<double>, trigrams long; the text is dropped, other columns stay."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            texts = b.column("text")
            plain = [texts[k].as_py() or "" for k in range(b.num_rows)]
            logs, n = evidence([visible(t) for t in plain] if html else plain, shared.value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(logs), pa.list_(pa.float64())), pa.array(n)], names=[*keep, "logs", "trigrams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", logs array<double>, trigrams long"
    return rows.mapInArrow(run, schema)


def _told(name: Column, languages: list[str], right: float) -> Column:
    """Log-probabilities of being told this language; none if it is unknown or null. "und" is told anything."""
    k = len(languages)
    wrong = (1 - right) / max(1, k - 1)
    given = F.array(*[F.when(name == x, float(np.log(right))).otherwise(float(np.log(max(wrong, 1e-9)))) for x in languages], F.lit(float(np.log(1 / max(1, k)))))
    return F.when(name.isin(languages), given).otherwise(F.array(*[F.lit(0.0)] * (k + 1)))


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """rows (id, declared, suffix, host, domain, top, logs, trigrams) to (id, lang, confidence, text_lang, host_rows, accepted)."""
    languages, k = model.languages, len(model.languages)
    if not k:
        return rows.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(0).cast("long").alias("host_rows"), F.lit(False).alias("accepted"))
    best = F.array_position("logs", F.array_max("logs")).cast("int") - 1
    rows = cut(rows.withColumn("vote", F.when((F.col("trigrams") > 0) & (best < k), best)))
    n = [F.sum(F.when(F.col("vote") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(k)]
    hosts = cut(rows.where("host is not null and vote is not null").groupBy("host").agg(F.first("domain").alias("domain"), F.first("top").alias("top"), *n))
    add = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    whole = hosts.agg(*add).first()
    count = sum(x or 0 for x in whole)
    base = [((x or 0) + 1.0) / (count + k) for x in whole]

    def shares(table: DataFrame, parent: list) -> list[Column]:
        total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
        return [(F.col(f"n{i}") + PRIOR * p) / (total + PRIOR) for i, p in enumerate(parent)]

    tops = hosts.groupBy("top").agg(*add)
    tops = tops.select("top", F.array(*shares(tops, [F.lit(x) for x in base])).alias("above"))
    domains = hosts.groupBy("domain", "top").agg(*add).join(tops, "top")
    domains = domains.select("domain", F.array(*shares(domains, [F.col("above")[i] for i in range(k)])).alias("above"))
    hosts = hosts.join(domains, "domain").select("host", F.array(*[F.col(f"n{i}").cast("double") for i in range(k)]).alias("counts"), "above")
    known = rows.where("host is not null")
    sizes = known.groupBy("host").count()
    least = (sizes.agg(F.sum("count")).first()[0] or 0) / HOT
    hot = [r["host"] for r in sizes.where(F.col("count") > least).collect()]  # fewer than HOT
    salts = F.when(F.col("host").isin(hot), SALT).otherwise(1)
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = known.withColumn("salt", F.pmod(F.xxhash64("id", "trigrams"), salts).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    alone = rows.where("host is null").select("*", F.lit(None).cast("array<double>").alias("counts"), F.lit(None).cast("array<double>").alias("above"))
    rows = joined.unionByName(alone)
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    own = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
    prior = [
        F.when(F.col("counts").isNull(), base[i]).otherwise((F.col("counts")[i] - F.when(F.col("vote") == i, 1.0).otherwise(0.0) + PRIOR * F.col("above")[i]) / (total - own + PRIOR)) for i in range(k)
    ]
    rows = rows.withColumn("prior", F.array(*[F.log(p * (1 - UND)) for p in prior], F.lit(float(np.log(UND))))).withColumn("told", _told(F.col("declared"), languages, RIGHT_DECLARED)).withColumn("near", _told(F.col("suffix"), languages, RIGHT_SUFFIX))
    rows = rows.withColumn("sum", F.array(*[F.col("logs")[i] + F.col("prior")[i] + F.col("told")[i] + F.col("near")[i] for i in range(k + 1)]))
    top = F.array_max("sum")
    at = F.array_position("sum", top).cast("int")
    sure = 1 / F.aggregate("sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("sum")))
    names = F.array(*[F.lit(x) for x in [*languages, "und"]])
    rows = rows.select("id", F.element_at(names, at).alias("lang"), sure.alias("confidence"), F.when(F.col("vote").isNotNull(), F.element_at(names, F.col("vote") + 1)).alias("text_lang"), F.coalesce(total, F.lit(0.0)).cast("long").alias("host_rows"), "trigrams")
    return rows.select("id", "lang", "confidence", "text_lang", "host_rows", ((F.col("lang") != "und") & (F.col("trigrams") > 0) & (F.col("confidence") >= LEAST)).alias("accepted"))


def address(url: Column) -> dict[str, Column]:
    """host, domain (as registered: its last two labels, or three where the second to last is one that countries register under; an IP address whole), top (its last label; of an IP address all), and the language that the country or a two-letter first folder suggests."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    labels = F.split(F.rtrim(host, F.lit(".")), r"\.")
    number = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^\[")
    top = F.when(number, host).otherwise(F.element_at(labels, -1))
    many = F.when((F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL), 3).otherwise(2)
    domain = F.when(number, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - many + 1, F.lit(1)), many), "."))
    folder = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    countries = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    known = lambda x: F.when(host != "", x)
    return {"host": known(host), "domain": known(domain), "top": known(top), "suffix": F.coalesce(countries[top], F.when(folder != "", folder))}


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html): the declared language is that of the html tag."""
    tune(pages.sparkSession)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    rows = pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.when(declared != "", declared).alias("declared"), *[c.alias(n) for n, c in address(F.col("url")).items()])
    return fuse(with_evidence(rows, model, html=True), model)


def identify_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Documents of sources: the language column is what is declared, the source is the host."""
    tune(docs.sparkSession)
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("declared"), F.lit(None).cast("string").alias("suffix"), source.alias("host"), source.alias("domain"), F.when(source.isNotNull(), "").alias("top"))
    return fuse(with_evidence(rows, model), model)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, by a model of the documents' languages."""
    return identify_pages(read(spark, sf_dir, "pages"), fit(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "page_id")
