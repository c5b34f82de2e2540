"""Token counts, byte-level BPE, SimHash, fingerprints, suffix tree: against brute force on small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken  # noqa: F401
import xxhash
from hypothesis import given, settings, strategies as st
from llm_samples import TEXTS, prose
from pyspark.sql import functions as F

from folio.llm import exchange, op2_token_counts as op2, op3_simhash as op3, op7_fingerprints as op7, op8_bpe as op8, op9_pst as op9


ORDER = lambda r: tuple((x is not None, x) for x in r)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=ORDER)


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(op2.VOCABULARY))
    cache = f"file://{tmp_path}/cache"
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in TEXTS), key=ORDER)
    assert rows(op2.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    files = {p for p in (tmp_path / "cache").rglob("*.parquet")}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in TEXTS}) == stored.select("digest").distinct().count()
    # all hits: nothing is appended
    assert rows(op2.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert spark.read.parquet(cache).count() == stored.count() and files <= {p for p in (tmp_path / "cache").rglob("*.parquet")}
    # another tokenizer has counts of its own
    other = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=other)
    got = rows(op2.count_tokens(docs, cache, other), "doc_id", "n_tokens")
    assert got == sorted(((i, len(model.encode(t or ""))) for i, t in TEXTS), key=ORDER)
    assert op2.count_tokens(empty, cache).count() == 0


def test_word_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(op2.VOCABULARY))
    texts = [chr(a) + "x" + chr(b) + chr(b) + " 1" for a in range(256) for b in (9, 32, 65, 133, 160, 233)] + ["  a", "a  ", "\n\n a\t"]
    assert op2.counter(public_tokenizers.path(op2.VOCABULARY)).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_bpe(spark, docs, empty):
    e = op8.encoding(public_tokenizers.path(op8.VOCABULARY))
    ids = [(i, e.encode_ordinary(t or "")) for i, t in TEXTS]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha((t or "").encode())) for (i, x), (_, t) in zip(ids, TEXTS)), key=ORDER)
    assert rows(op8.encode(docs, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    whole = op8.encode(docs, buckets=3)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["ids"]) for r in whole.where("doc_id is not null").collect()) == sorted((True, i, x) for i, x in ids if i is not None)
    back = op8.decode(whole).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in back) == sorted((i, (t or "").encode()) for i, t in TEXTS if i is not None)
    assert op8.encode(empty, digests=True).count() == 0 and op8.encode(empty).count() == 0
    assert bytes(op8.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["decoded"]) == b""


def test_bpe_over_many_blocks(spark, docs, monkeypatch):
    want = rows(op8.encode(docs, digests=True), "doc_id", "ids_sha256")
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 50)
    assert rows(op8.encode(docs, digests=True), "doc_id", "ids_sha256") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), max_size=200), st.lists(st.binary(max_size=20), max_size=40))
def test_packing(numbers, words):
    a = np.array(numbers, np.int64)
    assert exchange.widen(*exchange.unpack(exchange.pack(*exchange.narrow(a)))).tolist() == numbers
    assert exchange.unpack_words(*exchange.unpack(exchange.pack(*exchange.pack_words(words)))) == words


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(spark, docs, empty):
    got = rows(op3.near_duplicates(docs), "doc_id", "fp", "component_id")
    named = [(i, brute_fingerprint(t)) for i, t in TEXTS if i is not None]
    label = brute_components([f for _, f in named])
    want = []
    for k, (i, f) in enumerate(named):
        want.append((i, f, min(j for m, (j, _) in enumerate(named) if label[m] == label[k])))
    for i, t in TEXTS:
        if i is None:
            f = brute_fingerprint(t)
            same = [c for _, g, c in want if g == f]
            want.append((None, f, same[0] if same else None))
    assert got == sorted(((i, f - (1 << 64) if f >> 63 else f, c) for i, f, c in want), key=ORDER)
    assert op3.near_duplicates(empty).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 260), st.integers(1, 8))
def test_links_span_what_pairs_link(seed, n, flips):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)[rng.integers(0, max(1, n // 20), n)]
    for _ in range(flips):
        f = f ^ ((np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64))
    f = np.unique(f)

    def labels(u, v):
        p = list(range(len(f)))

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in zip(u, v):
            a, b = root(int(a)), root(int(b))
            p[max(a, b)] = min(a, b)
        return [root(x) for x in range(len(f))]

    i, j = np.triu_indices(len(f), 1)
    near = np.bitwise_count(f[i] ^ f[j]) <= 3
    want = labels(i[near], j[near])
    f = f[:, None]
    a, b = op3.spread(f)
    assert labels(a, b) == want and len(a) <= max(0, len(f) - 1)
    assert (op3.near_pairs(f[i], f[j]) == near).all()
    u, v, _ = zip(*op3._links(np.zeros(len(f), np.int64), f, np.arange(len(f)))) if len(f) > 1 else ((), (), ())
    assert labels(np.concatenate(u) if u else [], np.concatenate(v) if v else []) == want


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies(spark, docs, empty):
    import random

    r, texts = random.Random(9), []
    for g in range(12):
        words = prose(1000 + g, 150).split()
        for copy in range(r.randrange(1, 6)):
            new = list(words)
            for _ in range(r.randrange(0, 7)):
                new[r.randrange(len(new))] = f"changed{copy}"
            texts.append((100 * g + copy, " ".join(new)))
    texts += [(5000 + k, f"{texts[0][1]} x{k}") for k in range(60)]  # a large bucket
    got = {x["doc_id"]: x["component_id"] for x in op3.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    label = {i: i for i, _ in texts}
    for _ in range(4):
        for i, a in texts:
            for j, b in texts:
                a_, b_ = shingles(a), shingles(b)
                if label[i] > label[j] and len(a_ & b_) >= 0.8 * len(a_ | b_):
                    label[i] = label[j]
    assert got == label
    many = op3.near_copies(docs).collect()
    assert len(many) == len(TEXTS) and {x["component_id"] for x in many if x["doc_id"] in (4, 5, 6)} == {4}
    assert {x["component_id"] for x in many if x["doc_id"] in (1, 3, -7)} == {-7}
    assert op3.near_copies(empty).count() == 0


def test_near_copies_in_large_buckets_are_exact(spark):
    """Shared beginnings of 160 shingles and own ends: of 20 words each pair has a similarity of exactly 0.8, of 23 words 0.777."""
    base = [prose(7, 400), prose(8, 400)]
    start = [[f"{w}{k}" for k, w in enumerate(b.split()[:164])] for b in base]
    texts = [(1000 * g + k, " ".join([*start[g], *(f"own{k}x{j}" for j in range(own))])) for g, own in enumerate((20, 23)) for k in range(70)]
    got = {x["doc_id"]: x["component_id"] for x in op3.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in texts}


def test_near_copies_in_parts(spark, monkeypatch):
    """Buckets dealt in parts: links between rows of different parts, some in chains only, among many rows just less similar."""
    import random

    monkeypatch.setattr(op3, "TASK", 2000)
    r, words, texts = random.Random(5), prose(21, 400).split()[:130], []
    for k in range(60):
        new = list(words)
        for at in r.sample(range(0, 130, 6), 3):
            new[at] = f"own{k}x{at}"
        texts.append((k, " ".join(new)))
    for k in range(60, 66):  # a link to one of those only
        new = texts[7 * (k - 60)][1].split()
        new[-1] = f"end{k}"
        texts.append((k, " ".join(new)))
    got = {x["doc_id"]: x["component_id"] for x in op3.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets, label = [shingles(t) for _, t in texts], list(range(len(texts)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert len(set(label)) > 10 and any(i != x for i, x in enumerate(label))
    assert got == dict(enumerate(label))


def test_near_copies_of_few_words(spark):
    """8 words and one more (4 shingles of 5), 16 and three more (12 of 15): exactly 0.8."""
    texts = []
    for k in range(120):
        words = [f"w{k}x{j}" for j in range(8 if k % 2 else 16)]
        more = [f"m{k}x{j}" for j in range(1 if k % 2 else 3)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + more))]
    got = {x["doc_id"]: x["component_id"] for x in op3.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in texts}


def wide_rows(seed, n):
    """Fingerprints around four centres, sizes of sets around FEW and a quarter of very few shingles, groups; and which pairs are near, told pair by pair."""
    rng, wide = np.random.default_rng(seed), op3.Wide(5, 0.8)
    flips = rng.random((n, 512)) < rng.uniform(0.05, 0.2, n)[:, None]
    fp = rng.integers(0, 2**63, (4, 8), dtype=np.uint64)[rng.integers(0, 4, n)] ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    size = np.where(rng.random(n) < 0.25, 10, rng.integers(55, 75, n))
    group = rng.integers(0, n // 2 + 1, n) if seed % 2 else np.arange(n)
    apart = np.bitwise_count(fp[:, None] ^ fp).sum(axis=2)
    least, most = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
    return wide, fp, size, group, (least >= 0.8 * most) & (apart <= np.where(least >= wide.FEW, wide.radius, wide.loose)) & (group[:, None] != group)


@pytest.mark.parametrize("seed", range(6))
def test_fingerprints_tell_which_near_copies_are_asked(seed):
    """In cells of any size, and for sets of few shingles as well."""
    sizes = [1, 2, 3, 7, 40, 48, 49, 64, 130, 200][seed % 3 :]
    n, key = sum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    wide, fp, size, group, near = wide_rows(seed, n)
    rng = np.random.default_rng(100 + seed)
    band, bands = rng.integers(0, 3, len(sizes)).astype(np.int32)[key], rng.integers(0, 40, (n, 25)).astype(np.uint32)
    earlier = ((bands[:, None] == bands) & (np.arange(25) < band[:, None, None])).any(axis=2)
    want = (near & ~earlier & (key[:, None] == key)).any(axis=1)
    assert (op3._asked(key, band, fp, size, group, bands, wide) == want).all() and 0 < want.sum() < n


@pytest.mark.parametrize("seed", range(6))
def test_near_copies_are_linked_by_fingerprints_and_shingles(seed):
    """Tasks of any size, of one side and of two: links span the pairs that are near by their fingerprints and similar by their shingles, and no others."""
    n, tasks, want = [2, 3, 30, 48, 49, 150], [], []
    for t, m in enumerate(n):
        wide, fp, size, group, near = wide_rows(10 * seed + t, m)
        rng = np.random.default_rng(seed)
        side = rng.integers(0, 2, m) if (seed + t) % 3 == 0 else np.full(m, 2)
        sets = [np.sort(rng.permutation(k + 3)[:k]).astype(np.uint64) for k in size.tolist()]
        tasks.append([(1000 * t + k, 1000 * t + int(group[k]), int(side[k]), fp[k].tobytes(), sets[k]) for k in range(m)])
        both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        link = near & (both >= 0.8 * (size[:, None] + size - both)) & ((side[:, None] == 2) | (side[:, None] != side))
        want.append((link, group))
    us, vs = op3.joined_tasks(tasks, wide)
    for t, (link, group) in enumerate(want):
        here = [(u - 1000 * t, v - 1000 * t) for u, v in zip(us, vs) if u // 1000 == t]
        assert all(v // 1000 == t for u, v in zip(us, vs) if u // 1000 == t) and len(here) < len(set(group.tolist()))

        def labels(pairs):
            label = list(range(len(group)))
            for a, b in [*pairs, *((k, group.tolist().index(g)) for k, g in enumerate(group.tolist()))]:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        assert labels(here) == labels(np.argwhere(link).tolist())


def test_limit_of_few_shingles():
    """4 shingles in 5: the chance that a bit differs, over all outcomes; no other sets of that similarity differ more."""
    ones = np.array(np.meshgrid(*[[0, 1]] * 5)).reshape(5, -1)
    assert op3._most_apart(0.8, 64) == ((2 * ones[:4].sum(axis=0) > 4) != (2 * ones.sum(axis=0) > 5)).mean() == 0.1875


def test_every_near_pair_shares_a_bucket(spark):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**63, 200, dtype=np.uint64)
    g = f.copy()
    for _ in range(3):
        g ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    keys = lambda c: F.array(*[op3.block_key(F.col(c), k) for k in range(20)])
    d = spark.createDataFrame([(int(np.int64(a)), int(np.int64(b))) for a, b in zip(f.view(np.int64), g.view(np.int64))], "a long, b long")
    assert d.select(F.arrays_overlap(keys("a"), keys("b")).alias("x")).where("not x").count() == 0
    assert d.select(F.explode(keys("a")).alias("k")).distinct().count() == 200 * 20




def test_fingerprints(spark, docs, empty):
    got = {(r["doc_id"], r["text"]): r for r in op7.with_next(docs).collect()}
    named = sorted(((i, t or "") for i, t in TEXTS if i is not None))
    for k, (i, t) in enumerate(named):
        assert got[i, t]["next_text"] == named[(k + 1) % len(named)][1] or i == 13
    assert got[None, prose(5, 40)]["next_text"] == prose(5, 40)
    assert op7.with_next(docs).count() == len(TEXTS)
    assert op7.with_next(empty).count() == 0
    one = op7.with_next(docs.where("doc_id = 1")).first()
    assert one["next_text"] == one["text"] and one["sketch"] == one["next_sketch"]


def test_sketches(spark):
    texts = [(k, prose(k, n)) for k, n in enumerate((0, 1, 4, 5, 6, 40, 400, 3000))]
    d = spark.createDataFrame([(k, t, f"{t} {texts[(k + 1) % 8][1]}") for k, t in texts], "doc_id long, text string, both string")
    d = d.withColumn("w", op7.words_of(F.col("text"))).withColumn("h", op7.hashes_of(F.col("w")))
    # the shingles' hashes, one by one, by a plain expression of their words
    want = d.select("doc_id", "w", "h").collect()
    runs = [(r["doc_id"], k, *r["w"][k : k + 5]) for r in want for k in range(len(r["w"]) - 4)]
    plain = {(r["i"], r["k"]): r["h"] for r in spark.createDataFrame(runs, "i long, k long, a string, b string, c string, d string, e string").select("i", "k", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()}
    for r in want:
        assert r["w"] == texts[r["doc_id"]][1].split()
        assert r["h"] == [plain[r["doc_id"], k] for k in range(len(r["w"]) - 4)] if len(r["w"]) > 4 else len(r["h"]) == min(1, len(r["w"]))
    unsigned = lambda h: h & (2**64 - 1)
    s = op7.sketched(d, "text", "s").collect()
    for r in s:
        low = sorted({unsigned(h) for h in r["h"]})
        keep = max(op7.LEAST, sum(h < 2**64 // op7.SCALE for h in low))
        assert [unsigned(h ^ -(1 << 63)) for h in r["s"]] == low[:keep]
    # a union's sketch follows from the sketches of its parts
    both = spark.createDataFrame([(s[a]["h"], s[b]["h"], s[a]["h"] + s[b]["h"]) for a, b in ((6, 7), (2, 6), (5, 4), (0, 6), (0, 0))], "x array<long>, y array<long>, z array<long>")
    of = lambda c: op7.kept(F.sort_array(F.array_distinct(F.transform(c, op7.ordered))))
    assert all(x["m"] == x["w"] for x in both.select(of("x").alias("x"), of("y").alias("y"), of("z").alias("w")).select(op7.merged(F.col("x"), F.col("y")).alias("m"), "w").collect())


def test_containment_estimates(spark):
    """Of unequal texts: near the true share; of short ones: exactly that."""
    rows = []
    for k in range(40):
        n, m = (30, 30) if k % 2 else (600, 6000)
        words = [f"w{k}x{j}" for j in range(n)]
        cut = n * (k % 5) // 5
        rows.append((k, " ".join(words), " ".join([*words[:cut], *(f"o{k}x{j}" for j in range(m))])))
    d = spark.createDataFrame(rows, "k long, a string, b string")
    for r in op7.sketched(op7.sketched(d, "a", "x"), "b", "y").select("k", op7.containment(F.col("x"), F.col("y")).alias("c")).collect():
        a, b = (op_shingles(t) for t in rows[r["k"]][1:])
        share = len(a & b) / len(a)
        assert abs(r["c"] - share) < (0.13 if len(a) > 100 else 0.4)
    few = spark.createDataFrame([("a b c d e f g h i", "x a b c d e f g"), ("", ""), ("a", ""), ("", "a"), ("a b", "a b")], "a string, b string")
    got = [r["c"] for r in op7.sketched(op7.sketched(few, "a", "x"), "b", "y").select(op7.containment(F.col("x"), F.col("y")).alias("c")).collect()]
    assert got == [3 / 5, 1.0, 0.0, 0.0, 1.0]


def op_shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_ranges_follow_rows(spark, monkeypatch):
    rows = [(k, f"text {k}") for k in range(2000)] + [(2**60, "far"), (-(2**62), "near")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in op7.with_ranges(d).groupBy("range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 900 and sum(sizes) == len(rows) + len(sizes)
    got = {r["doc_id"]: r["next_text"] for r in op7.with_next(d).collect()}
    order = sorted(rows)
    assert got == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def test_fingerprints_query(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op7.op7_fingerprints(spark, str(tmp_path)).collect()
    named = sorted((i, t or "") for i, t in TEXTS if i is not None)
    after = [named[(k + 1) % len(named)][1] for k in range(len(named))]
    want = Counter()
    for (i, t), n in [*zip(named, after), *(((None, t or ""), t or "") for i, t in TEXTS if i is None)]:
        q = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (r["n_chars"] > 0 or r["fingerprint"] == "") for r in got)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op7.op7_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_near_next_and_edited(spark, tmp_path):
    texts = [(k, prose(100 + k // 2 if k < 4 else 200 + k, 400)) for k in range(8)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op7.op7_fingerprints(spark, str(tmp_path)).collect():
        t, n = texts[r["doc_id"]][1], texts[(r["doc_id"] + 1) % 8][1]
        q = len(t) // 4
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
        assert (r["near_next"] == 1) == (t == n) and r["near_next"] in (1,) or r["near_next"] < 0.2
        assert (0.55 < r["near_edited"] < 0.95) or t == n


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_base_scores(spark, docs, empty):
    got = rows(op9.score(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in TEXTS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, t in TEXTS), key=ORDER)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(a[5] == pytest.approx(b[5], rel=1e-9) for a, b in zip(got, want))
    assert op9.score(empty).count() == 0


def test_tree_learns_order(spark):
    import random

    r = random.Random(1)
    pairs = {"red": "fox", "blue": "sky", "old": "man", "big": "dog"}
    texts = [(k, " ".join(f"{a} {pairs[a]}" for a in r.choices(list(pairs), k=60))) for k in range(200)]
    got = op9.score(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    assert got and all(x["score"] > 0.62 * x["base_score"] for x in got)  # the second of a pair is certain


def brute_tree(texts, modulus=10):
    """Scores by dictionaries of contexts of any length, one state at a time."""
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 0
    token = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b""]
    c = Counter(w for i, t in texts if not held(i) for w in token(t))
    mass = sum(c.values()) + op9.ADD * (len(c) + 1)
    own = set(sorted(c, key=lambda w: -c[w])[: op9.OWN])  # in the test all words are
    assert len(c) <= op9.OWN
    symbol = lambda w: w if w in own else op9.class_of(w)
    base = {w: c[w] + op9.ADD for w in own} | {k: op9.ADD for k in range(op9.CLASSES)}
    base = {s: x / sum(base.values()) for s, x in base.items()}
    follow = {}
    for i, t in texts:
        s = ["start", *map(symbol, token(t))]
        for k in range(1, len(s)):
            for d in range(1, min(op9.DEPTH, k) + 1):
                follow.setdefault(tuple(s[k - d : k]), Counter())[s[k]] += not held(i)

    known = {}

    def chance(context):
        """Distribution of the longest state kept that ends the context."""
        if context not in known:
            if not context:
                known[context] = base
            else:
                parent, n = chance(context[1:]), {s: x for s, x in follow.get(context, Counter()).items() if x}
                total = sum(n.values())
                nats = sum(x * math.log(x / total / parent[s]) for s, x in n.items())
                keep = total >= op9.STATE and nats >= op9.LEAST * total and 2 * nats >= len(n) + op9.DEVIATIONS * math.sqrt(2 * len(n))
                known[context] = {s: (n.get(s, 0) + op9.PRIOR * p) / (total + op9.PRIOR) for s, p in parent.items()} if keep else parent
        return known[context]

    out = []
    for i, t in texts:
        s, score = ["start", *map(symbol, token(t))], 0.0
        for k, w in enumerate(token(t), 1):
            score += math.log10((c[w] + op9.ADD) / mass) + math.log10(chance(tuple(s[max(0, k - op9.DEPTH) : k]))[s[k]] / base[s[k]])
        out.append((i, score))
    return out, known, base


def test_tree_scores(spark, monkeypatch):
    import random

    monkeypatch.setattr(op9, "STEP", 700)
    r = random.Random(5)
    after = {}
    texts = []
    for k in range(260):
        words = ["the", "garden"]
        for _ in range(r.randrange(0, 90)):
            # what follows depends on four words
            choice = after.setdefault(tuple(words[-4:]), r.sample("the garden Of".split(), 1))
            words.append(r.choice(choice) if r.random() < 0.9 else f"rare{r.randrange(400)}")
        texts.append((k, " ".join(words)))
    texts += [(7, texts[3][1]), (None, "the garden of nowhere"), (1000, None), (1001, ""), (1001, "")]
    want, known, base = brute_tree(texts)
    assert max(len(c) for c in known if known[c] is not known.get(c[1:], base)) == op9.DEPTH  # states of all lengths
    assert all(sum(p.values()) == pytest.approx(1) for p in known.values())
    got = rows(op9.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)), "doc_id", "score")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5)


def test_states_grow_with_the_corpus():
    """The same texts ten times over: contexts too rare before are states."""
    rng = np.random.default_rng(0)
    base = np.full(op9.CLASSES + 5, 1 / (op9.CLASSES + 5))
    code = np.unique(rng.integers(0, 5, 400) << op9.BITS * 4 | rng.integers(0, 5, 400) << op9.BITS * 3 | rng.integers(0, 5, 400) << op9.BITS * 2 | rng.integers(0, 5, 400) << op9.BITS | rng.integers(0, 2, 400))
    n = np.full(len(code), 2)
    kept = []
    for times in (1, 10, 100):
        root = op9.Root(np.zeros((op9.START + 1, op9.START + 1), np.int64), base)
        p = op9.deepened(code, n * times, root)
        kept.append(len(np.unique(p.round(12))))
    assert kept[0] < kept[1] <= kept[2]


def test_blocks_of_empty_texts(spark, monkeypatch):
    """Empty and equal texts fill blocks too."""
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 64 * 50)
    d = spark.createDataFrame([(k, "" if k % 2 else "same words") for k in range(1000)], "doc_id long, text string").coalesce(1)
    packed = exchange.blocks(d, str.split, str.encode, 4)
    assert packed.where("meta is not null").count() >= 10
    assert op8.encode(d, digests=True).count() == 1000


def test_changed_blocks_are_an_error(spark):
    rows_ = exchange.blocks(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string").coalesce(1), str.split, str.encode, 2)
    part = rows_.where("post is null or bucket <> 0")
    with pytest.raises(Exception, match="input changed"):
        exchange.assemble(part, lambda block, docs, parts: None, "x long", 2).collect()


def test_counts_of_hot_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op2, "HOT", 5)
    d = spark.createDataFrame([(k, "the same text" if k % 2 else f"text {k}") for k in range(60)], "doc_id long, text string")
    got = rows(op2.count_tokens(d, f"file://{tmp_path}/cache"), "doc_id", "n_tokens")
    count = op2.counter(public_tokenizers.path(op2.VOCABULARY)).counts
    assert got == [(k, count(["the same text" if k % 2 else f"text {k}"])[0]) for k in range(60)]
