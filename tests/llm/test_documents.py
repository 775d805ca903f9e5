"""Operators on documents against brute force, with nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import contextlib
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tabsmith import session
from tabsmith.llm import bpe, components, mixing, quality, repetition, simhash
from tabsmith.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, source string, fp string, size string, kept string, score string"
WORD = r"[^\x20\x09-\x0D]+"


def sample_texts(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(n)]
    for k in range(0, n, 6):  # near copies
        words = texts[k].split()
        words[rng.randrange(len(words))] = "other"
        texts[(k + 3) % n] = " ".join(words)
    return texts + [None, "", " \t\n", "One", "a b", "A  B", texts[0], texts[0], "x\x1cy z", "word " * 30_000,
                    "line one is here\nline two\nline one is here\n\n", "# a * b & c <|im_end|> $%"]


@contextlib.contextmanager
def many_partitions(spark):
    values = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def docs(spark):
    texts = sample_texts()
    rows = [(i, t, [None, "", "b", "a", "hot", "hot", "hot"][i % 7], "f", "s", "k", "c") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[2], None, None, None, None, None), (None, None, "a", "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------- SimHash

def slow_fingerprint(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, linked):
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def test_simhash_groups(docs):
    rows = docs.collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    distinct = sorted(set(prints))
    pairs = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:] if (a ^ b).bit_count() <= 4]
    roots = slow_components(distinct, pairs)
    least = {}
    for r, f in zip(rows, prints):
        if r["doc_id"] is not None:
            least[roots[f]] = min(least.get(roots[f], r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(roots[f]))) for r, f in zip(rows, prints))
    out = simhash.near_groups(docs).withColumn("hex", simhash.hex_fingerprint(simhash.F.col("fp"))).collect()
    assert sorted((str(r["doc_id"]), r["hex"], str(r["component_id"])) for r in out) == want
    assert pairs


def test_simhash_shards_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 900, dtype=np.uint64)
    near = base[rng.integers(0, 900, 900)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    hot = np.full(900, base[0])
    for _ in range(6):
        hot ^= rng.integers(0, 2, 900).astype(np.uint64) << rng.integers(0, 64, 900).astype(np.uint64)
    x = np.unique(np.concatenate([base, near, hot]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = simhash.near_links(fps, 4, sample_rows=500, shard_rows=200)
    found = {int(np.int64(r["a"]).view(np.uint64)): int(np.int64(r["b"]).view(np.uint64)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in found.items())
    pairs = [(int(a), int(b)) for k, a in enumerate(x) for b in x[k + 1:][np.bitwise_count(x[k + 1:] ^ a) <= 4]]
    got = [(int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in links.collect()]
    keys = [int(v) for v in x]
    assert slow_components(keys, got) == slow_components(keys, pairs)


def test_simhash_hot_and_rare_fingerprints_take_the_same_way_out(spark, monkeypatch):
    rows = [(i, f"fp {'hot' if i % 2 else i % 7}") for i in range(60)] + [(None, "fp hot"), (7, "fp hot")]
    own = spark.createDataFrame(rows, "id long, fp string")
    classes = own.groupBy("fp").agg(simhash.F.count("*").alias("n"), simhash.F.min("id").alias("first"))
    want = sorted(map(str, own.join(classes, "fp").select("fp", "id", "first").collect()))
    for share in (1, 3, 1_000):  # no fingerprint, one, all are hot
        monkeypatch.setattr(simhash, "HOT_SHARE", share)
        got = simhash.with_class(own, classes).select("fp", "id", "first").collect()
        assert sorted(map(str, got)) == want


def test_simhash_keeps_one_of_each_group(docs, empty):
    groups = simhash.near_groups(docs)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    n = groups.select(simhash.F.coalesce("component_id", simhash.F.lit(-1))).distinct().count()
    assert kept.count() == n
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(set(ids)) == len(ids)
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0


def test_simhash_stores_small_tables_in_few_files(spark, docs, monkeypatch):
    """With many shuffle partitions that nothing merges, each file costs a task and, on a local disk, three processes."""
    files, stored = [], session.cut_lineage

    def seen(df, *rows):
        out = stored(df, *rows)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "cut_lineage", seen)
    monkeypatch.setattr(components, "cut_lineage", seen)
    with many_partitions(spark):
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
        assert len(files) > 4 and max(files) <= max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    assert found == {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}


# -------------------------------------------------------------------- mixing

def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else weight[s] * rest / w for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mix_plan(docs, empty):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(WORD, r["text"] or ""))
    want = slow_targets(sizes)
    out = mixing.plan_mix(docs).collect()
    assert len(out) == len(rows)
    text = {r["doc_id"]: (r["text"], r["source"]) for r in rows if r["doc_id"] is not None}
    for r in out:
        if r["doc_id"] is None:
            continue
        t, source = text[r["doc_id"]]
        assert r["size"] == len(re.findall(WORD, t or "")) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        rate = want[source] / sizes[source] if sizes[source] else 0
        key = hashlib.md5(f"{r['seed']}\x1f{r['doc_id']}\x1f{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        assert r["copies"] == int(rate) + (int(key[:12], 16) / 2 ** 48 < rate - int(rate))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sorted(map(str, mixing.plan_mix(docs.repartition(3)).collect())) == sorted(map(str, out))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.plan_mix(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "abcdefg"[min(6, i % 20)]) for i in range(6000)]
    out = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.groupBy("target").agg({"taken": "sum"}).collect()
    assert len(got) == 7
    assert all(abs(r[1] - r[0]) < 0.1 * r[0] for r in got)


def test_mix_takes_the_nearest_seed(spark, sf):
    """Small sources, too: each takes what the best of the seeds gives, near its target unless one text is too large."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    out = mixing.plan_mix(docs).collect()
    groups = {}
    for r in out:
        groups.setdefault(rows[r["doc_id"]][0], []).append(r)
    for source, own in groups.items():
        target, rate = own[0]["target"], own[0]["target"] / own[0]["source_size"]

        def taken(seed):
            total = 0
            for r in own:
                digest = hashlib.md5((rows[r["doc_id"]][1] or "").encode()).hexdigest()
                u = int(hashlib.md5(f"{seed}\x1f{r['doc_id']}\x1f{digest}".encode()).hexdigest()[:12], 16) / 2 ** 48
                total += (int(rate) + (u < rate - int(rate))) * r["size"]
            return total
        gaps = [abs(taken(s) - target) for s in range(mixing.SEEDS)]
        assert {r["seed"] for r in own} == {gaps.index(min(gaps))}
        assert sum(r["taken"] for r in own) == taken(own[0]["seed"])
        assert min(gaps) <= max(0.1 * target, max(r["size"] for r in own))


# ----------------------------------------------------------------------- BPE

def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(tokenizer_file())
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = bpe.encode(docs, tokenizer_file(), decoded_col="decoded")
    digest = {r["doc_id"]: r for r in bpe.digests(out).collect()}
    for r in out.collect():
        ids = tool.encode(rows[r["doc_id"]], add_special_tokens=False).ids if r["doc_id"] is not None else r["ids"]
        assert r["ids"] == ids and r["decoded"] == tool.decode(ids, skip_special_tokens=False)
        if r["doc_id"] is not None:
            d = digest[r["doc_id"]]
            assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert d["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.digests(bpe.encode(empty, tokenizer_file(), decoded_col="decoded")).count() == 0
    again = bpe.decode(out.select("doc_id", "ids", "decoded"), tokenizer_file(), name="again")
    assert again.filter("again <> decoded").count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_joins_are_repaired(file, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "MEAN_CHUNK", 8)
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "CHUNKS", 20)
    monkeypatch.setattr(bpe.chunk_ends, "__defaults__", (8,))
    path = public_tokenizers.path(file)
    tool, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(1)
    odd = ["", " ", "  a  b ", "<|startoftext|>x <|endoftext|>", "it's  don't we'll", "e\u0301 \u0301a", "a\x0bb\x0c c\x85d e",
           "漢字 かな 123 45", "😀" * 40 + " x" + "y" * 500, "Ihr ΟΔΟΣ Σ", " " * 300 + "x" + " " * 300, "a\n\n b\t \n c, d; e!? 'tis"]
    texts = odd + ["".join(rng.choices("ab cdé'., \n\t1", k=rng.randint(1, 400))) for _ in range(300)]
    assert any(len(bpe.chunk_ends(t)) > 3 for t in texts)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids.tolist()) == tool.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_words_that_end_in_marks_once_normalised(file):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(file)
    tool, codec = Tokenizer.from_file(path), bpe.Codec(path)
    words = ["M\u0130", "\u0130", "KAD\u0130", "k\u0131z", "\u09b9\u09df", "\u09aa\u09dc", "\u09ac\u09be\u0982\u09b2\u09be", "\u0915\u0958",
             "\u0915\u093c", "\u0939\u0948", "\ufb2a", "\u05e9\ufb2b", "\u05e9\u05dc", "caf\u00e9", "cafe\u0301", "\u1112\u1161", "word", "\u03a3"]
    texts = [w + m for w in words for m in [*bpe.MARKS, "?!", "...", ""]]
    texts += [" ".join(texts), "\n".join(reversed(texts)), " ".join(w + "," for w in words for _ in range(3))]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids, ascii(text)
    codec = bpe.Codec(path)
    for text in reversed(texts):  # one by one, from other caches
        assert codec.encode([text])[0].tolist() == tool.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_texts_without_spaces_dont_fill_the_caches(file, monkeypatch):
    import sys

    import public_tokenizers
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1 << 20)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 1 << 20)
    path = public_tokenizers.path(file)
    tool, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(9)
    texts = ["".join(rng.choices("漢字かな交じり文の例", k=20_000)) for _ in range(6)]
    texts += ["".join(rng.choices("ABCDEFGHabcdefgh0123+/", k=20_000)) for _ in range(6)]
    texts += ["\n".join(rng.choices(["one", "zwei", "trois,", "漢字", "4\t5"], k=8_000)) for _ in range(6)]
    texts += ["\t".join(f"w{rng.randrange(9 ** 6)}" for _ in range(4_000)) for _ in range(6)]
    assert max(len(bpe.chunk_ends(t)) for t in texts[:12]) == 1 and min(len(bpe.chunk_ends(t)) for t in texts[12:]) > 5
    for text in texts:
        assert codec.encode([text])[0].tolist() == tool.encode(text, add_special_tokens=False).ids
    for cache in (codec.pieces, codec.chunks, codec.joins):
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for half in (cache.young, cache.old) for k, v in half.items())
        assert held <= 1 << 20


# --------------------------------------------------------------------- rules

def slow_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines, dup = text.split("\n"), 0
    for k, line in enumerate(lines):
        dup += bool(re.search(WORD, line)) and line in lines[:k]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed)


def slow_excess(text):
    words = re.findall(WORD, text or "")
    worst, total = 0.0, sum(map(len, words))
    for n, limit in repetition.NGRAM_LIMITS.items():
        seen, inside = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k:k + n])
            inside |= set(range(k, k + n)) if gram in seen else set()
            seen.add(gram)
        worst = max(worst, sum(len(words[k]) for k in inside) / total / limit if total else 0.0)
    return worst


def test_quality_rules(docs, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    out = repetition.quality_rules(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        if r["doc_id"] is None or len(texts[r["doc_id"]] or "") > 10_000:
            continue
        want = slow_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["dup_ngram_excess"] == pytest.approx(slow_excess(texts[r["doc_id"]]))
        assert not (r["base_failed"] and r["kept"])
    assert repetition.keep_good(docs).columns == docs.columns
    assert repetition.keep_good(docs).count() == sum(r["kept"] for r in out)
    assert repetition.quality_rules(empty).count() == 0 and repetition.keep_good(empty).count() == 0


def test_rolling_hash_collisions_are_compared(monkeypatch):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 4, 400)
    h = np.zeros(400 - 4, np.uint64)  # every hash collides
    every, later = repetition.repeats(ids, h, 5)
    grams = [tuple(ids[k:k + 5]) for k in range(396)]
    assert every.tolist() == [k for k, g in enumerate(grams) if grams.count(g) > 1]
    assert later.tolist() == [k for k, g in enumerate(grams) if g in grams[:k]]


# ---------------------------------------------------------------- classifier

def test_classifier_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id")
    rows = [r for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 5
    right = [(r["score"] >= 0.3) == bool(r["quality"]) for r in rows]
    assert np.mean(right) > 0.9


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = quality.train(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    d = docs.select(quality.held_out(quality.F.col("doc_id")).alias("h"), "doc_id").collect()
    assert all(r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in d)


def test_classifier_learns_from_all_labelled_rows_and_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["The", "cat", "sat,", "on", "it.", "#", "12", "AND", "dogs", "ran!", "|", "trees"]
    texts = [" ".join(rng.choice(words[:8] if i % 3 else words[3:], rng.integers(3, 30))) for i in range(9000)]
    good = [int(rng.random() < (0.7 if i % 3 else 0.4)) for i in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (1, texts[1])], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int"))
    own = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(texts[i]) for i in own]), np.array([good[i] for i in own])
    assert len(own) > 6000 and np.allclose(model["mean"], x.mean(0)) and np.allclose(model["sd"], x.std(0) + 1e-9)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    w = np.array(model["weights"])
    raw = z @ w
    lost = 1 / (1 + np.exp(raw[y == 1][:, None] - raw[y == 0][None, :]))  # of every pair
    grad = (lost.mean(0) @ z[y == 0] / (y == 0).sum() - lost.mean(1) @ z[y == 1] / (y == 1).sum()) + quality.RIDGE * w
    assert np.abs(w).max() > 0.1 and np.abs(grad).max() < 2e-5
    ordered, k = np.sort(raw), int((y == 0).sum())
    assert model["at"] == pytest.approx((ordered[k - 1] + ordered[k]) / 2, abs=1e-9)


def test_classifier_steps_have_few_tasks_whatever_the_partitions(spark, sf, monkeypatch):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    files, stored, cores = [], session.cut_lineage, spark.sparkContext.defaultParallelism

    def seen(df, *rows):
        out = stored(df, *rows)
        files.append(len(out.inputFiles()))
        return out

    want = quality.train(docs, labels)
    monkeypatch.setattr(quality, "cut_lineage", seen)
    with many_partitions(spark):
        model = quality.train(docs, labels)
        assert 0 < max(files) <= cores
        spark.sparkContext.setJobGroup("one-step", "")
        rows = spark.range(200).selectExpr("transform(sequence(1, 15), k -> cast(sin(id * k) as double)) as x", "int(id % 2) as y").coalesce(1)
        size = len(quality.FEATURES)
        slots, sums = quality.summed_on_grid(rows, np.zeros(size), np.ones(size), np.ones(size), quality.STEP)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup("one-step") for k in tracker.getJobInfo(j).stageIds]
        assert max(k.numTasks for k in stages if k) <= cores
    assert len(set(slots.tolist())) == len(slots) and sums[:, 0].sum() == pytest.approx(200)
    assert model["at"] == pytest.approx(want["at"], abs=1e-6) and np.allclose(model["weights"], want["weights"], atol=1e-6)
