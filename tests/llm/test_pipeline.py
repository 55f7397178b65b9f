import corpus_pipeline
from fieldfold.llm import decontaminate, pii, queries, quality_rules
from fieldfold.llm.common import documents, materialise, table

from .test_simhash import alike, shingles
from .test_text_ops import plain_spans, slow_report


def test_stages_against_brute_force(spark, sf_dir):
    docs, seen = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf_dir)
        seen[name] = before
        if name != "packing":
            assert out.columns == docs.columns
            docs = materialise(out, name)
    after = lambda name: [t for k, t in zip(seen, list(seen.values())[1:], strict=False) if k == name][0]
    rules = quality_rules.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    kept = {r.doc_id for r in quality_rules.judge(documents(spark, sf_dir), rules).where("kept").collect()}
    assert {d for d, _ in after("quality_rules")} == kept
    left, sets = {d for d, _ in after("simhash")}, {d: shingles(t) for d, t in seen["simhash"]}
    ids = sorted(sets)
    near = {d: [e for e in ids if e < d and alike(sets[d], sets[e]) >= 0.8] for d in ids}
    copies = {d for d in ids if near[d]}
    assert len(copies & left) <= 0.05 * len(copies) and len(copies) > 5
    assert {d for d in copies if any(sets[d] == sets[e] for e in near[d])}.isdisjoint(left)
    assert {d for d in ids if all(alike(sets[d], sets[e]) < 0.6 for e in ids if e != d)} <= left
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {d for d, _ in after("decontamination")} == {r[0] for r in slow_report(seen["decontamination"], bench) if not r[-1]}
    masked, model = dict(after("pii")), pii.trained()
    for d, t in seen["pii"]:
        ((base, every),) = pii.all_spans([t], model)
        assert base == plain_spans(t) and masked[d] == pii.masked(t, every)
    assert decontaminate.WINDOW == 10 and queries.tokenizer_path("byte_bpe_50k.json")


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("start = 0").count() == out.select("doc_id").distinct().count() > 0


def test_awkward_and_empty_tables_go_through_all_stages(spark, sf_dir):
    from .helpers import awkward, empty

    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, empty(spark), sf_dir).count() == 0
        if name == "packing":
            pieces = out.collect()
            assert sum(r.start == 0 for r in pieces) == docs.count()
        else:
            assert out.columns == docs.columns
            before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
            if name == "pii":  # nothing personal here: all rows and columns as they were
                assert sorted(map(str, before)) == sorted(map(str, after))
            assert {str(r) for r in after} <= {str(r) for r in before}
            texts = [r[1] for r in after]
            assert all(texts) and (name == "quality_rules" or len(set(texts)) == len(texts))
            docs = materialise(out, name)
