import re

import numpy as np
import pytest
import xxhash

from fieldfold.llm import components, queries, simhash

from .helpers import AWKWARD, awkward, empty, table


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_components(rows):
    """(id, fingerprint, least id of the component) by comparing all pairs."""
    f = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_awkward_rows(spark):
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in AWKWARD]
    df = awkward(spark).withColumn("text", __import__("pyspark.sql.functions", fromlist=["substring"]).substring("text", 1, 3000))
    assert sorted((tuple(r) for r in simhash.report(df).collect()), key=str) == slow_components(rows)
    assert simhash.report(empty(spark)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    every = [tuple(r) for r in df.collect()]
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(every)  # values of clashing columns, too
    assert sorted((r[1] or "" for r in got if (r[1] or "").strip()), key=str) == sorted({r[1] for r in every if (r[1] or "").strip()}, key=str)
    assert sum(not (r[1] or "").strip() for r in got) == 1


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op4_simhash(spark, sf_dir).collect()), key=str) == slow_components(rows)


@pytest.mark.parametrize("seed", range(3))
def test_trie_join_misses_no_link(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([base] + [base[r.integers(0, 60, 150)] ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)) for _ in range(3)])
    f = np.unique(near)
    root = simhash.trie_join(f, 3, chunk=64)
    apart = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    want = np.arange(len(f))
    for _ in range(len(f)):
        new = np.array([want[a].min() for a in apart])
        if (new == want).all():
            break
        want = new
    assert (root == want).all()


def test_components(spark):
    r = np.random.default_rng(5)
    e = r.integers(-50, 300, (200, 2))
    got = {x.node: x.root for x in components.components(spark.createDataFrame([tuple(map(int, p)) for p in e], "a long, b long")).collect()}
    from fieldfold.operators.graph import roots

    e = e[e[:, 0] != e[:, 1]]
    assert got == dict(zip(*(v.tolist() for v in roots(e[:, 0], e[:, 1])), strict=True))


def test_crowded_groups_are_dealt_again(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    monkeypatch.setattr(simhash, "A_GROUP", 1)
    monkeypatch.setattr(simhash, "FEW", 1)
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in {slow_fingerprint(t) for _, t in rows}], "f long")
    assert simhash.dealt(distinct).groupBy("f").count().agg({"count": "max"}).first()[0] > 4
    assert sorted((tuple(r) for r in queries.op4_simhash(spark, sf_dir).collect()), key=str) == slow_components(rows)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def alike(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_are_found_and_others_stay(spark):
    """Copies with words changed here and there, or a run of words replaced, against the exact similarity of all pairs."""
    r = np.random.default_rng(2)
    rows, number = [], 0
    for _ in range(60):
        w = [f"w{int(x)}" for x in r.zipf(1.3, int(r.integers(60, 400))) % 4000]
        rows.append((number, " ".join(w)))
        number += 1
        for _ in range(3):
            v, n = list(w), len(w)
            if r.random() < 0.5:
                for i in r.integers(0, n, max(1, int(n * 0.012))):
                    v[i] = f"x{int(r.integers(9999))}"
            else:
                i, m = int(r.integers(0, n // 2)), max(1, int(n * 0.05))
                v[i : i + m] = [f"y{int(r.integers(9999))}" for _ in range(m)]
            rows.append((number, " ".join(v)))
            number += 1
    kept = {x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()}
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    later = {i for i, _ in links}
    assert len(later) > 100
    missed = later & kept
    assert len(missed) <= 0.05 * len(later), (len(missed), len(later))
    clean = {i for i in range(len(rows)) if all(alike(sets[i], sets[j]) < 0.6 for j in range(len(rows)) if j != i)}
    assert clean <= kept


@pytest.mark.parametrize("doc_id", [None, 8])
def test_unrelated_rows_without_an_own_id_all_stay(spark, doc_id):
    texts = ["rivers run down from the hills to the wide grey sea in spring", "nine bright lamps hang over the old wooden bridge by the mill", "she counted every ship that left harbour before the storm came in"]
    kept = simhash.keep_one(table(spark, [(doc_id, t) for t in texts] + [(doc_id, texts[0])])).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
