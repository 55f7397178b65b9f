import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldfold.llm import decontaminate, license_scan, packing, pii, quality_rules, queries, sharding, tagger, token_store
from fieldfold.llm.encode import Encoder

from .helpers import AWKWARD, awkward, empty, table


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# ---- op1 ----

def test_shards_fit_and_follow_the_hash(spark, sf_dir):
    got = sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20_000).collect()
    docs = documents(spark, sf_dir)
    assert len(got) == len(docs)
    size = {}
    for r in got:
        bits = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:9] + hashlib.md5((docs[r.doc_id] or '').encode()).hexdigest()[:6], 16):060b}"
        assert bits.startswith(r.shard) and len(r.shard) == r.shard_depth and r.n_bytes == len((docs[r.doc_id] or "").encode())
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(size[r.shard] == r.shard_bytes for r in got)
    alone = [s for s in size if sum(r.shard == s for r in got) == 1]
    assert all(b <= 20_000 or s in alone for s, b in size.items())
    for s in size:  # only oversized buckets split
        if s:
            assert sum(b for t, b in size.items() if t.startswith(s[:-1])) > 20_000


def test_shard_edges(spark):
    df = awkward(spark).withColumns({c: F.lit("y") for c in ("shard_bytes", "shard_depth", "prefix", "n_bytes", "row", "at")})
    out = sharding.assign(df, 64)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and sharding.assign(empty(spark), 64).count() == 0
    seven = {r.shard for r in rows if r.doc_id == 7}
    assert len(seven) == 1
    kept = [c for c in df.columns if c not in sharding.OWN]
    assert out.columns == [*kept, *sharding.OWN]
    assert sorted(map(str, df.select(kept).collect())) == sorted(map(str, out.select(kept).collect()))


def test_rows_without_an_id_are_told_apart_by_text(spark):
    rows = [(None, f"text number {i} of a row without an id") for i in range(300)]
    assert max(r.shard_bytes for r in sharding.assign(table(spark, rows), 1000).collect()) <= 1000


# ---- op2 ----

def fresh(name):
    """The library's own tokenizer, with nothing set."""
    return Tokenizer.from_file(queries.tokenizer_path(name))


def ids(name, text, end):
    return [*fresh(name).encode(text or "", add_special_tokens=False).ids, end]


def test_token_store_round_trip(spark, sf_dir):
    docs, at = documents(spark, sf_dir), 0
    got = {r.doc_id: r for r in queries.op2_token_store(spark, sf_dir).collect()}
    t = fresh("word_bpe_49k.json")
    for d in sorted(docs):
        want = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_token_store_edges_and_single_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 256)
    files = token_store.write(awkward(spark), f"file://{tmp_path}/t", queries.tokenizer_path("word_bpe_49k.json"), 2)
    assert sum(f[1] for f in files) == len(AWKWARD)
    assert token_store.read(spark, files).count() == len(AWKWARD)
    (three,) = token_store.fetch([f[0] for f in files], {3}).values()
    assert three.tolist() == ids("word_bpe_49k.json", "one", 2)
    assert token_store.round_trip(empty(spark), queries.tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_a_partition_goes_on_in_new_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_DOCS", 3)
    path = queries.tokenizer_path("word_bpe_49k.json")
    files = token_store.write(awkward(spark), f"file://{tmp_path}/t", path, 2)
    assert max(f[1] for f in files) <= 3 and sum(f[1] for f in files) == len(AWKWARD)
    one = sorted(map(tuple, token_store.read(spark, files).collect()), key=str)
    monkeypatch.undo()
    assert one == sorted(map(tuple, token_store.round_trip(awkward(spark), path, 2).collect()), key=str)


def test_damage_is_noticed(tmp_path):
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    sink = io.BytesIO()
    w = token_store.Writer(sink)
    for i in range(50):
        w.add(i, np.random.default_rng(i).integers(0, 2**32, 40_000, dtype=np.uint32).tobytes())
    w.close()
    data = bytearray(sink.getvalue())
    r = token_store.Reader(Source(bytes(data)))
    r.document(30)
    assert r.frames_read == 1 and len(r.table) > 10
    data[200] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_store.Reader(Source(bytes(data))).document(0)


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_encoding_is_exact(name, leading):
    e, r, plain = Encoder(queries.tokenizer_path(name), leading), np.random.default_rng(3), fresh(name)
    signs = list("aB's éÉßΣ\n.,!9<|>x-\t 'lİ#")
    texts = ["".join(r.choice(signs, 30)) for _ in range(3000)] + ["", " ", "\n", "a <|endoftext|> b's it's don't", "x\n\n\ny  z", "trailing \n"]
    added = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", " ", "\n", "a", "é", "x.", "<|endoftext|><|endoftext|>"]
    texts += ["".join(r.choice(added, int(r.integers(1, 8)))) for _ in range(2000)]
    for t in texts:
        assert e.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


# ---- op5 ----

def plain_spans(text):
    found = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 12 <= len(d) <= 19 and luhn) or (k == 3 and 9 <= len(d) <= 15):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(0)
    for _ in range(20_000):
        t = "".join(r.choice(list("a1.@+- ()9 ."), 30))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1.2.3.4.5.6.7.8.9", "1.2.3.4.5.6.7.999.1.1.1.1", "256.1.1.1.2.2.2.2", "007.0000255.1.1.", ".1.1.1.1..2.2.2.2", "1.2.3"):
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans(".1.1." + "9" * 300_000) == []
    long_run = "a" * 200_000 + "@b.c" + "9" * 5000
    assert pii.base_spans(long_run)[0] == (0, 0, 200_004 + 5000)


def test_tagger_on_held_out_spans():
    m = tagger.trained()
    x, y, texts = tagger.labelled(300, 96, 12345)
    tags, _ = m.decode(x)
    assert (tags == y).mean() > 0.95 and (tags == y)[y > 0].mean() > 0.85
    hit = total = made = 0
    for c, t in enumerate(texts):
        want, at = set(), 0
        while at < 96:
            if y[at, c] % 2 == 1:
                end = at + 1
                while end < 96 and y[end, c] == y[at, c] + 1:
                    end += 1
                if 0 < at and end < 96:
                    want.add((at, (int(y[at, c]) - 1) // 2, end))
                at = end
            else:
                at += 1
        ((_, every),) = pii.all_spans([t], m)
        hit, total, made = hit + len(want & set(every)), total + len(want), made + len(every)
    assert hit / total > 0.9, (hit, total, made)


def test_tagger_alone_on_texts_of_the_table():
    """Trained on generated texts only, it marks what the patterns find in the documents, of which it has seen none."""
    import pyarrow.parquet as pq

    m, hit, total = tagger.trained(), 0, 0
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t and pii.base_spans(t)]
    for t in texts:
        c, found = tagger.classes(t), []
        starts = pii.window_starts(len(c))
        for at, spans in zip(starts, pii.window_spans(m, [c[a : a + pii.WIDTH] for a in starts]), strict=True):
            found += [(a + at, b + at, k, w) for a, b, k, w in spans]
        want = pii.base_spans(t)
        hit, total = hit + len({(s, e, k) for s, k, e in want} & set(pii.reconcile(found))), total + len(want)
    assert total > 50 and hit / total > 0.93, (hit, total)


def test_decoding_without_the_search_where_no_span_gains():
    m = tagger.trained()
    x, _, _ = tagger.labelled(200, 96, 99)
    tags, _ = m.decode(x)
    e, (tr, st) = m.scores(x), m._moves()
    best, back = st + e[0], []
    for t in range(1, len(x)):
        s = best[:, :, None] + tr
        back.append(s.argmax(1))
        best = s.max(1) + e[t]
    path = [best.argmax(1)]
    for step in back[::-1]:
        path.append(step[np.arange(x.shape[1]), path[-1]])
    assert (np.array(path[::-1]) == tags).all()


def test_numbers_beside_each_other_are_found():
    cards, m = ("7536784127813050", "4845168114407329", "4550997810720808", "7536784127813050"), tagger.trained()
    for a, b in zip(cards, cards[1:], strict=False):
        t = f"some words before {a} {b} and some words after"
        at = [(t.index(x), t.index(x) + 16) for x in (a, b)]
        assert [pii._sound(t, *x, 2) for x in at] == at
        ((base, every),) = pii.all_spans([t], m)
        assert base == [] and every == [(x, 2, y) for x, y in at]
    t = "some words before +1 (826) 555-4081 190.137.223.204 and some words after"
    assert pii.masked(t, pii.all_spans([t], m)[0][1]) == "some words before [PHONE] [IP] and some words after"


def test_gradients():
    m = tagger.Tagger(hidden=3)
    x, y, _ = tagger.labelled(3, 7, 1)
    _, g = m.loss(x, y)
    r = np.random.default_rng(0)
    for name, v in m.p.items():
        for _ in range(3):
            i = tuple(int(r.integers(n)) for n in v.shape)
            if name == "tr" and not tagger.ALLOWED[i] or name == "st" and not tagger.BEGIN[i]:
                continue
            old = v[i]
            v[i] = old + 1e-5
            up = m.loss(x, y)[0]
            v[i] = old - 1e-5
            down = m.loss(x, y)[0]
            v[i] = old
            assert abs((up - down) / 2e-5 - g[name][i]) < 1e-4, name


def test_pii_query_and_mask(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for r in queries.op5_pii(spark, sf_dir).collect():
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, pii.written(want).split(","))) <= set(r.spans.split(","))
    df = awkward(spark)
    assert pii.find(df).count() == len(AWKWARD) and pii.find(empty(spark)).count() == 0
    masked = pii.mask(table(spark, [(1, "write to a.b@c.org or +1 (375) 555-4393 now"), (2, None), (3, "no data")])).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["write to [EMAIL] or [PHONE] now", None, "no data"] and masked[0].n_chars == len(masked[0].text)


# ---- op6 ----

def test_packing_is_whole_and_tight(spark, sf_dir):
    docs = documents(spark, sf_dir)
    t0 = fresh("byte_bpe_50k.json")
    want = {d: [*t0.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    got = queries.op6_packing(spark, sf_dir).collect()
    spots, seq = {}, {}
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        spots.setdefault(r.doc_id, []).append((r.start, r.length))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, pieces in spots.items():
        assert sum(n for _, n in pieces) == len(want[d])
    for pieces in seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert set(spots) == set(docs)


def test_equal_rows_spread_over_ranges(spark):
    rows = [(5, "the very same row again and again " * 20)] * 4000
    got = packing.pack(table(spark, rows), queries.tokenizer_path("byte_bpe_50k.json"), 1)
    spread = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 40)).count().collect()]
    assert len(spread) == 4 and max(spread) < 2 * min(spread)


def test_packing_edges(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = packing.pack(awkward(spark), path, 1).collect()
    assert sum(r.start == 0 for r in got) == len(AWKWARD) and packing.pack(empty(spark), path, 1).count() == 0


def test_hilbert_neighbours_touch():
    n = 8
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 2, indexing="ij"), -1).reshape(-1, 2)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    cube = np.stack(np.meshgrid(*[np.arange(4)] * 4, indexing="ij"), -1).reshape(-1, 4)
    order = cube[np.argsort(packing.hilbert(cube, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- op8 ----

def slow_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    inside = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality_statistics(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = queries.op8_quality_rules(spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_stats(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    rows = sorted((tuple(r)[:7] for r in quality_rules.judge(awkward(spark), quality_rules.DecisionList()).collect()), key=str)
    assert rows == sorted(((i, *slow_stats(t)) for i, t in AWKWARD), key=str)
    assert quality_rules.judge(empty(spark), quality_rules.DecisionList()).count() == 0
    assert quality_rules.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).rules == []


def test_rules_hold_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.fit(docs.where("doc_id % 2 = 0"), labels)
    j = quality_rules.judge(docs.where("doc_id % 2 = 1"), rules).where("not base_failed").join(labels, "doc_id")
    c = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert c.get((0, False), 0) / (c.get((0, False), 0) + c.get((0, True), 0)) > 0.95
    assert c.get((1, False), 0) / (c.get((1, True), 0) + 1) < 0.005


def test_learned_list_is_readable():
    r = np.random.default_rng(0)
    x = r.random((2000, len(quality_rules.FEATURES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 4] < 0.2))
    rules = quality_rules.learn(x, bad)
    hits = np.zeros(len(x), bool)
    for rule in rules.rules:
        hits |= quality_rules._covers(x, rule)
    assert (hits == bad).mean() > 0.97 and "symbols_a_word >" in str(rules)
    assert quality_rules.learn(x, np.zeros(len(x), bool)).rules == []


# ---- op9 ----

def slow_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def base_of(rows):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)


def slow_base(items):
    out = []
    for i, t in items:
        n, at = slow_places(t)
        out.append((i, n, len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


def test_license_base(spark, sf_dir):
    rows = queries.op9_license_scan(spark, sf_dir).collect()
    assert base_of(rows) == slow_base(documents(spark, sf_dir).items())
    more = AWKWARD + [(20, "Under the MIT license, under the mit LICENSE. CC-BY-NC cc by nc nc"), (21, "under the mit\nlicense Apache License, Version 2.0"), (21, "Kelvin K under THE mit license")]
    df = table(spark, more)
    assert base_of(license_scan.scan(df).collect()) == slow_base(more)
    assert license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(awkward(spark)).count() == len(AWKWARD)


def test_license_method_allows_edits(spark):
    text = "intro " * 20 + "This work is licensed under the GNU GPL General Public License."
    (r,) = license_scan.scan(table(spark, [(1, text)])).collect()
    assert r.labels == "gpl-3" and r.base_labels == "" and 0.75 <= r.score < 1
    (r,) = license_scan.scan(table(spark, [(1, "the general public is licensed to read this work")])).collect()
    assert r.labels == "" and r.score == 0


def common_share(text, phrase):
    """The words in common of a text and a notice, by their longest common subsequence."""
    a, b = re.findall(r"[a-z0-9]+", text.lower()), phrase.split()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return 2 * best[-1][-1] / (len(a) + len(b))


def test_license_notices_and_scores(spark):
    """Every notice whole, with words put in, and with words lost: its label, and a score beside that of brute force."""
    r, rows, want = np.random.default_rng(4), [], {}
    for i, (phrase, label) in enumerate(license_scan.NOTICES.items()):
        w = phrase.split()
        put, lost = list(w), [x for j, x in enumerate(w) if j != len(w) // 2]
        for at in sorted(r.integers(3, len(w) - 3, 2).tolist(), reverse=True):
            put.insert(at, "zzz")
        for j, v in enumerate((w, put, lost)):
            rows.append((10 * i + j, "some words before it. " + " ".join(v).capitalize() + ". And some after it."))
            want[10 * i + j] = (label, common_share(" ".join(v), phrase))
    for x in license_scan.scan(table(spark, rows)).collect():
        label, score = want[x.doc_id]
        if x.n_base == 0:
            assert abs(x.score - score) < 0.15, (x, score)
        if score >= 0.85:
            assert label in x.labels.split(","), (x, label, score)
    mit = next(iter(license_scan.NOTICES)).split()
    edited = " ".join([*mit[:5], "x x x", *mit[5:10], "x x x", *mit[10:15], "x x x", *mit[15:]])
    (x,) = license_scan.scan(table(spark, [(1, edited)])).collect()
    assert x.labels == "mit" and 0.75 <= x.score < 0.9


def test_license_scan_of_long_texts_takes_its_time_in_proportion(spark):
    import time

    took = {}
    for n in (4_000, 16_000, 64_000):
        text = " ".join(["granted free of charge to any person", "copy of this software and", "w"] * (n // 7))
        began = time.time()
        license_scan.scan(table(spark, [(1, text)])).collect()
        took[n] = time.time() - began
    assert took[64_000] < 8 * max(1.0, took[16_000]), took


# ---- op10 ----

def slow_report(docs, bench):
    win = {}
    for item, t in bench:
        w = decontaminate.words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            win.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, items = decontaminate.words(t), set(), set()
        for m in {len(k) for k in win}:
            for s in range(len(w) - m + 1):
                if (x := win.get(tuple(w[s : s + m]))) is not None:
                    hit.update(range(s, s + m))
                    items |= x
        named = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op10_decontamination(spark, sf_dir).collect()), key=str)
    assert got == slow_report(documents(spark, sf_dir).items(), bench)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_decontamination_edges(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    bench = [(1, "than ten words in"), (2, None), (3, "!!"), (4, "stands here twice AND it has more than ten words in it, and then some more words"), (5, "ten"), (None, "a row that is repeated"), (4, "no such thing anywhere in the texts of this table, really not at all")]
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("item", F.lit(1))
    df = awkward(spark)
    got = sorted((tuple(r)[:6] for r in decontaminate.report(df, b).collect()), key=str)
    want = slow_report(AWKWARD, bench)
    assert got == want
    assert decontaminate.keep_clean(df, b).count() == sum(not r[-1] for r in want)
    assert decontaminate.report(empty(spark), b).count() == 0
    assert decontaminate.report(df, b.where("item_id < 0")).where("contaminated").count() == 0
