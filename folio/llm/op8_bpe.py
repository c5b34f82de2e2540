"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Every text is cut into pre-tokens; the distinct ones meet in buckets by hash,
each is encoded once, and its ids go back to the positions it came from
(:mod:`exchange`). Decoding joins ids to the vocabulary's token-byte table, which
is a file of fixed size: each worker holds it, and the join is a gather by id.

Null texts are empty; an empty text has no ids. Repeated rows give repeated
results. Rows with a null id are kept. Special tokens never occur.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import exchange
from .common import plain, read, tune

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_loaded: dict = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file; a worker keeps it."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after another, and each token's start and size."""
    if (path, "table") not in _loaded:
        e = encoding(path)
        words = [b""] * (e.max_token_value + 1)
        for w, i in e._mergeable_ranks.items():
            words[i] = w
        sizes = np.array([len(w) for w in words], np.int64)
        _loaded[path, "table"] = (np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return _loaded[path, "table"]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, starts, sizes = token_table(path)
    out, step = [], 1 << 16
    for k in range(0, len(ids), step):
        part = ids[k : k + step]
        out.append(flat[exchange.ragged(starts[part], sizes[part])].tobytes())
    return b"".join(out)


def _words(pattern: str):
    compiled = regex.compile(pattern)
    return compiled.findall


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>); with digests, (doc_id, n_tokens, ids_sha256, decoded_sha256) instead of the ids."""
    spark = docs.sparkSession
    tune(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    docs = plain(docs, id_col, text_col)
    buckets = buckets or exchange.buckets_for(docs)
    rows = exchange.blocks(docs, _words(public_tokenizers.PATTERN), str.encode, buckets)

    def value(lists):
        e, own, store, starts, sizes = encoding(path), {}, [], [], []
        at = 0
        for words, _ in lists:
            for w in words:
                if w not in own:
                    own[w] = len(starts)
                    got = e.encode_ordinary(w.decode())
                    store.extend(got)
                    starts.append(at)
                    sizes.append(len(got))
                    at += len(got)
        flat, starts, sizes = np.array(store, np.uint32), np.array(starts, np.int64), np.array(sizes, np.int64)
        for words, _ in lists:
            k = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
            yield [*exchange.narrow(sizes[k]), exchange.short(flat[exchange.ragged(starts[k], sizes[k])])]

    def whole(_, docs, parts):
        per = np.zeros(int(docs.sizes.sum()), np.int32)
        for _, pos, word, got in parts:
            per[pos] = exchange.widen(*got[:2])[word]
        starts = np.cumsum(per, dtype=np.int64) - per
        flat = np.zeros(int(per.sum(dtype=np.int64)), np.uint16 if encoding(path).max_token_value < 1 << 16 else np.uint32)
        for _, pos, word, got in parts:
            size = exchange.widen(*got[:2])
            first, mine = np.cumsum(size) - size, exchange.long(got[2], int(size.sum()))
            flat[exchange.ragged(starts[pos], size[word])] = mine[exchange.ragged(first[word], size[word])]
        del starts
        edge = np.concatenate([[0], np.cumsum(per, dtype=np.int64)])[np.concatenate([[0], np.cumsum(docs.sizes)])]
        head = {"doc_id": pa.array(docs.ids, pa.int64()), "n_tokens": np.diff(edge)[docs.of]}
        each = [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]
        if not digests:
            return pa.table(head | {"ids": pa.array([each[k].astype(np.int32) for k in docs.of.tolist()], pa.list_(pa.int32()))})
        of = pa.array(docs.of)
        ids, text = (pa.array([hashlib.sha256(f(x)).hexdigest() for x in each], pa.string()) for f in (lambda x: x.astype("<u4").tobytes(), lambda x: decode_ids(x, path)))
        return pa.table(head | {"ids_sha256": ids.take(of), "decoded_sha256": text.take(of)})

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return exchange.assemble(exchange.values(rows, value, buckets), whole, schema, buckets)


def decode(tokens: DataFrame, path: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from arrays of ids; null ids decode to no bytes, an id outside the vocabulary is an error."""
    tune(tokens.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "decoded": pa.array([decode_ids(np.array(x or [], np.int64), path) for x in b.column("ids").to_pylist()], pa.binary())})

    return tokens.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, decoded binary")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digests=True)
