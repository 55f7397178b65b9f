import hashlib

import numpy as np
import pytest

from fieldfold.llm import blocks, level_windows, queries, suffix_ranks

from .helpers import awkward, empty, table


class Spec:
    def __init__(self, kind, window):
        self.kind, self.window, self.run = kind, window, (suffix_ranks if kind == "bytes" else level_windows).deduplicate

    def deduplicate(self, df):
        return self.run(df, self.window)


BYTES, WORDS = Spec("bytes", 100), Spec("space", 20)


def brute(rows, spec):
    """Removal by a dictionary of first positions; equal (doc, start) are one position."""
    docs = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    parts = [d if spec.kind == "bytes" else d.split() for _, d in docs]
    first = {}
    for (i, _), p in zip(docs, parts, strict=True):
        for s in range(len(p) - spec.window + 1):
            w = p[s : s + spec.window] if spec.kind == "bytes" else tuple(p[s : s + spec.window])
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, _), p in zip(docs, parts, strict=True):
        step = np.zeros(len(p) + 1, int)
        for s in range(len(p) - spec.window + 1):
            w = p[s : s + spec.window] if spec.kind == "bytes" else tuple(p[s : s + spec.window])
            if first[w] < (i, s):
                step[s] += 1
                step[s + spec.window] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = np.frombuffer(p, np.uint8)[~gone].tobytes() if spec.kind == "bytes" else b" ".join(x for x, g in zip(p, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i if i != -(2**63) else None, len(p), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("spec", [BYTES, WORDS, Spec("bytes", 7), Spec("space", 3)])
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, spec, seed):
    r = np.random.default_rng(seed)
    bits = [" ".join(r.choice(["ab", "ba", "c", "dd", "e"], int(r.integers(1, 40)))) for _ in range(12)]
    rows = [(int(i), " ".join(r.choice(bits, int(r.integers(0, 6))))) for i in r.permutation(40)]
    rows += [(50, "z" * 300), (51, "z" * 350), (52, "zy" * 160), (53, " ".join(["w"] * 60))]
    assert got(spec.deduplicate(table(spark, rows))) == brute(rows, spec)


@pytest.mark.parametrize("spec", [BYTES, WORDS])
def test_awkward_rows(spark, spec):
    from .helpers import AWKWARD

    assert got(spec.deduplicate(awkward(spark))) == brute(AWKWARD, spec)
    assert spec.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("spec", [BYTES, WORDS])
def test_small_blocks_and_segments_change_nothing(spark, monkeypatch, spec):
    rows = [(i, f"{'shared passage of some length, ' * (6 + i)}{i}") for i in range(30)]
    monkeypatch.setattr(blocks, "BLOCK", 700)
    monkeypatch.setattr(blocks, "SEGMENT", {"bytes": 150, "space": 30})
    monkeypatch.setattr(blocks, "BUCKETS", 5)
    assert got(spec.deduplicate(table(spark, rows))) == brute(rows, spec)


@pytest.mark.parametrize(("name", "spec"), [("op3_suffix_array_dedup", BYTES), ("op7_substring_dedup", WORDS)])
def test_query_on_the_table(spark, sf_dir, name, spec):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.queries()[name](spark, sf_dir).collect()
    spans = "n_spans" in out[0]
    assert sorted((r.doc_id, r[1], r.n_removed, r.n_spans if spans else 0, r.kept_sha256) for r in out) == sorted((a, b, c, d if spans else 0, e) for a, b, c, d, e in brute(rows, spec))
