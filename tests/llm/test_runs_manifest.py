"""Periodic runs and Merkle manifests against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import merkle, queries, runs


def naive_runs(words, exponent=4, least=6):
    """Every maximal stretch, from the definition."""
    n, out = len(words), []
    for s in range(n):
        for p in range(1, (n - s) // exponent + 1):
            if s and words[s - 1] == words[s - 1 + p]:
                continue
            e = s + p
            while e < n and words[e] == words[e - p]:
                e += 1
            smaller = any(all(words[i] == words[i + d] for i in range(s, e - d)) for d in range(1, p))
            if e - s >= max(least, exponent * p) and not smaller:
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _text(rng):
    words = [str(rng.randrange(rng.choice([1, 2, 2, 3, 5, 30]))) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 90]))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        p = 1 + (len(words) - a) // rng.randrange(3, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_against_the_definition():
    rng = random.Random(3)
    total = 0
    for _ in range(40):
        texts = [_text(rng) for _ in range(rng.randrange(1, 25))]
        for words, found in zip(texts, runs.find_runs(texts)):
            assert found == naive_runs(words)
            ids = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, np.int64)
            assert found == runs.runs_by_period(ids, 4, 6)
            total += len(found)
    assert total > 100


def test_grammar_derives_the_words():
    rng = random.Random(4)
    texts = [_text(rng) for _ in range(30)]
    ids = np.array([int(w) for t in texts for w in t])
    g = runs.Grammar(ids, np.cumsum([len(t) for t in texts]))
    assert g.count

    def expand(sym):
        if sym < g.n_words:
            return [sym]
        return expand(g.left[sym - g.n_words]) + expand(g.right[sym - g.n_words])
    for sym in range(g.n_words, g.n_words + g.count):
        at = g.at[sym - g.n_words]
        assert expand(sym) == ids[at:at + g.sizes[sym]].tolist()
    first = dict(zip(np.cumsum([0] + [len(t) for t in texts]).tolist(), texts))
    for sym, at in zip(g.roots, g.root_at):
        assert [str(x) for x in expand(sym)] == first[int(at)]


def test_long_texts_and_collisions(monkeypatch):
    long = ["a"] * 50_000
    assert runs.find_runs([long]) == [[(0, 50_000, 1)]]
    tail = [str(i) for i in range(9_000)] * 5
    assert runs.find_runs([tail, ["x"]]) == [[(0, 45_000, 9_000)], []]
    rng = random.Random(8)
    texts = [_text(rng) for _ in range(40)]
    want = runs.find_runs(texts)
    monkeypatch.setattr(runs, "_MOD", np.int64(7))  # nearly all hashes collide
    assert [r for r, w in zip(runs.find_runs(texts), want) if w] == [w for w in want if w]


def test_periodic_runs_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a " * 6, "x"), (3, "a " * 6, "x"), (4, " \n\tb a b a\nb a b\x0ba é", "x"), (None, "a a a a a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert runs.periodic_runs(docs).count() == 6
    assert (out[1]["n_words"], out[1]["runs"], out[1]["collapsed"]) == (0, [], "")
    assert (out[2]["n_words"], out[2]["runs"]) == (0, [])
    assert [tuple(r) for r in out[3]["runs"]] == [(0, 6, 1)] and out[3]["collapsed"] == "a"
    assert [tuple(r) for r in out[4]["runs"]] == [(0, 8, 2)] and out[4]["collapsed"] == "b a é"
    assert out[None]["runs"] == []
    assert runs.periodic_runs(docs.filter("doc_id = 9")).count() == 0
    kept = runs.periodic_runs(docs.withColumnRenamed("text", "body").withColumn("__runs", F.lit(7)), "body")
    assert "__runs" in kept.columns and kept.filter("`__runs` = 7").count() == 6
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=2)


def test_periodic_runs_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op11_periodic_runs(spark, sf).collect()
    assert len(out) == len(docs)
    planted = 0
    for r in out:
        words = [w for w in (docs[r["doc_id"]] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        ids = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, np.int64)
        want = runs.runs_by_period(ids, 4, 6)
        drop = set()
        for s, length, p in want:
            drop |= set(range(s + p, s + length))
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
    assert planted > 5


# ------------------------------------------------------------------ manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests):
    """Root and, for each digest, its steps (place, others)."""
    if not digests:
        return None, []
    steps, nodes, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(nodes) > 1:
        groups = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, path in enumerate(steps):
            run, place = groups[at[k] // 16], at[k] % 16
            path.append((place, "".join(run[:place] + run[place + 1:])))
            at[k] //= 16
        nodes = [sha("".join(g)) for g in groups]
    return nodes[0], steps


def brute_manifest(rows):
    """rows (group, key, digest, check) -> {(group, key, digest): [(subroot, root, proof, folded)]}"""
    groups = {}
    for g, k, d, c in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, d, c))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute_tree([x[2] for x in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (has, k, d, c), path in zip(groups[g], trees[g][1]):
            value = c or d
            for place, others in path + top:
                value = sha(others[:64 * place] + value + others[64 * place:])
            out.append((g, k if has else None, d, trees[g][0], root, sha("".join(o for _, o in path + top)), value, value == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 256, 257], [4096, 4097, 1, 8200], [2] * 40])
def test_manifest_against_brute_force(spark, sizes):
    rows = [(f"s{i}" if i else None, k, sha(f"{i},{k}"), sha("x") if k % 7 == 3 else None) for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, d string, c string")
    out = merkle.prove(df, "d", "g", "k", check_col="c")
    got = sorted((tuple(r) for r in out.select("g", "k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_edges(spark):
    schema = "g string, k long, d string, c string, tree string, pos int, block int, n int, `row` int, digest string, root string"
    rows = [(None, None, sha("a"), None), (None, None, sha("a"), None), ("", 1, sha("b"), sha("b")), ("", None, sha("c"), None),
            ("é", 5, sha("d"), sha("e")), ("Z", 5, sha("d"), None), ("z", 5, sha("f"), None), ("z", 5, sha("e"), None)]
    df = spark.createDataFrame([(*r, "t", 1, 2, 3, 4, "dd", "mine") for r in rows], schema)
    out = merkle.prove(df, "d", "g", "k", check_col="c", proofs=True)
    assert {"tree", "pos", "block", "n", "row", "digest"} <= set(out.columns) and out.filter("tree = 't' and `row` = 4 and digest = 'dd'").count() == 8
    got = sorted((tuple(r) for r in out.select("g", "k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == brute_manifest(rows)
    for r in out.collect():
        assert merkle.fold(r["leaf"], [(s["place"], s["others"]) for s in r["proof"]]) == r["root"]
    assert merkle.prove(df.filter("k = 77"), "d", "g", "k").count() == 0
    hashed = spark.createDataFrame([(1, None, "é"), (None, "", None)], "a long, b string, c string").select(merkle.leaf(F.col("a"), F.col("b"), F.col("c")).alias("h"))
    assert [r[0] for r in hashed.collect()] == [sha("1:1-2:é"), sha("-0:-")]


def test_partial_witnesses_grow():
    tree = merkle.Appender(2)
    nodes = [tree.append(sha(str(k))) for k in range(18)]
    assert nodes[16].witness == [sha("17")] and nodes[17].witness == [sha("16")]
    assert nodes[3].witness == [sha(str(k)) for k in range(16) if k != 3]
    assert nodes[3].parent.witness == []  # its run's sibling is still open
    top = tree.finish()
    assert nodes[3].parent.witness == [sha(sha("16") + sha("17"))]
    assert all(merkle.fold(n.digest, tree.steps(n, [])) == top for n in nodes)
