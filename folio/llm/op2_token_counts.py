"""Token counts with a digest cache.

A text's digest (SHA-256 of its UTF-8; a null text is empty, and that is all the
normalisation there is, since anything more could change a count) and the
tokenizer file's digest name a stored count. Digests that the cache lacks are
encoded once each and appended; every document then takes its count from the
cache by a join.

Only texts that occur once in the cache's misses travel, each once for each task
that holds it, so a text with a third of all rows costs one row a task. Digests of
more than one document in HOT (so fewer than HOT of them) are joined to their counts
by a broadcast, all others by a shuffle.
Repeated rows give repeated results; rows with a null id are kept.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import plain, read, scratch, tune

VOCABULARY = "byte_bpe_50k.json"
CACHE = "digest binary, n_tokens long"
#: A digest of more than one document in so many is hot.
HOT = 1000
#: Words whose counts a worker remembers.
MEMO_WORDS = 300_000
#: Characters encoded at once.
STEP_CHARS = 2_000_000
_loaded: dict = {}


class Counter:
    """Counts of one tokenizer file, as its library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.words = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.library = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.words = regex.compile(public_tokenizers.PATTERN).findall
            self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def splits(self, text: str) -> bool:
        """Whether a word's count does not depend on its neighbours and our pattern cuts as the library does: no added token, and only characters whose class no Unicode version changes."""
        if self.words is None or any(x in text for x in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def counts(self, texts: list[str]) -> list[int]:
        out: list = [None] * len(texts)
        whole, parts, new = [], [], set()
        for k, text in enumerate(texts):
            if self.splits(text):
                parts.append((k, words := self.words(text)))
                new.update(words)
            else:
                whole.append(k)
        if whole:
            for k, n in zip(whole, self.library([texts[k] for k in whole])):
                out[k] = n
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        missing = list(new.difference(self.memo))
        self.memo.update(zip(missing, self.library(missing)))
        for k, words in parts:
            out[k] = sum(map(self.memo.__getitem__, words))
        return out


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def version(path: str) -> str:
    """Digest of the tokenizer's file: part of the cache's key."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty if there are none yet. Two runs may have appended a digest each, so it is made distinct."""
    path = f"{cache}/tokenizer={version(tokenizer)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode the texts of docs (digest, text) that the cache lacks, and append them."""
    spark = docs.sparkSession
    tune(spark)

    def run(batches):
        count = counter(tokenizer).counts
        for b in batches:
            digests, column = b.column("digest"), b.column("text")
            got, step, size = [], [], 0
            for k in range(b.num_rows):
                step.append(column[k].as_py())
                size += len(step[-1])
                if size >= STEP_CHARS or k == b.num_rows - 1:
                    got += count(step)
                    step, size = [], 0
            yield pa.RecordBatch.from_pydict({"digest": digests, "n_tokens": pa.array(got, pa.int64())})

    misses = docs.dropDuplicates(["digest"]).join(cached(spark, cache, tokenizer).select("digest"), "digest", "left_anti")
    misses.select("digest", "text").mapInArrow(run, CACHE).write.mode("append").parquet(f"{cache}/tokenizer={version(tokenizer)}")


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; cache: a folder that all executors share, kept from run to run."""
    tokenizer = tokenizer or public_tokenizers.path(VOCABULARY)
    keyed = plain(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    fill(keyed.select("digest", "text"), cache, tokenizer)
    counts = cached(docs.sparkSession, cache, tokenizer)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    least = sized.count() / HOT
    hot = [r["digest"] for r in sized.groupBy("digest").count().where(F.col("count") > least).select("digest").collect()] if least >= 1 else []  # fewer than HOT
    few = F.broadcast(counts.where(F.col("digest").isin([bytes(x) for x in hot])))
    is_hot = F.col("digest").isin([bytes(x) for x in hot])
    joined = sized.join(counts, "digest", "left") if not hot else sized.where(~is_hot).join(counts, "digest", "left").union(sized.where(is_hot).join(few, "digest", "left"))
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh cache each time, so each run counts every text itself."""
    return count_tokens(read(spark, sf_dir, "documents"), scratch(spark, "token-cache"))
