"""The methods against independent versions, and the cases that caps, hubs, ties and odd inputs make."""

import hashlib
import itertools
import random
import re
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from test_operators import awkward, brute_components, brute_fingerprint, brute_lines, brute_links, brute_spans, clashing
from tidemark.llm import decontamination, html_text, line_dedup, packing, pii, quality_classifier, quality_rules, queries, secret_scan, simhash, token_rollup, tokens
from tidemark.llm.common import joined
from tidemark.llm.tokenizing import default_vocabulary, encode


# hashes and joins


def test_spans_hash_alike_wherever_they_stand():
    rng = random.Random(3)
    words = [bytes(rng.randrange(33, 127) for _ in range(rng.choice([1, 5, 40, 70_000]))) for _ in range(60)]
    picked = [rng.choice(words) for _ in range(200)]
    data = np.frombuffer(b" ".join(picked), np.uint8)
    assert len(data) > 2 << 20
    starts, ends, _ = tokens.word_spans(data, np.array([0, len(data)]))
    seen = {}
    for word, h in zip(picked, tokens.span_hashes(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("least", [0, 3, 1000])
def test_hot_keys_are_joined_like_others(spark, least):
    left = spark.range(300).select((F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 40)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    got = joined(left, right, "k", "n", least, 10)
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "n").collect()))


# op1


def test_links_name_the_nearest_parts(spark):
    rng = random.Random(7)
    bits = ["client_id=abcd", "https://a.b.c/d", "password: hunter22", "AKIA" + "Z" * 16, "0a" * 13, "auth_key=zzzzzzzz", "x" * 150, "aB3" * 12, "login=" + "u" * 700]
    texts = [" ".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(80)] + ["client_id=abcd " * 700 + "auth_key=zzzzzzzz"]
    kinds = {v: secret_scan.PART[k] for k, v in secret_scan.ORDER.items()}
    for scope in (0, 60):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in secret_scan.scan(frame, scope=scope).collect():
            text = texts[r.doc_id]
            parts = sorted(set(brute_spans(text) + [(m.start(), secret_scan.ORDER[k], m.end()) for k, _, p in secret_scan.WEAK for m in re.finditer(p, text)]))
            assert [tuple(x) for x in r.weak] == brute_links(text, scope)
            for x in r.links:
                for name in ("identifier", "secret"):
                    near = [(max(p[0] - x.e, x.s - p[2], 0), p) for p in parts if p != (x.s, x.k, x.e) and kinds[p[1]] == name and p[0] <= x.e + scope and p[2] >= x.s - scope]
                    assert (tuple(x[name]) if x[name] else None) == (min(near)[1] if near else None)


# op2


def test_token_query_against_its_four_batches(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choices(["alpha", "beta", "gamma's", "  x", "é"], k=6))
    rows = []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines + rng.sample(lines, rng.randint(0, len(lines))))))
    # ids that stand twice, one row changed by the revision and one not; a missing id; missing texts
    rows += [(3, "one two\nthree"), (4, "same\nsame\nsame"), (None, "lost\nlost"), (None, None), (61, None), (62, "")]
    docs = [{"doc_id": i, "text": t, "lang": rng.choice(["en", None]), "source": rng.choice(["s", "t"])} for i, t in rows]
    labels = [{"doc_id": i, "quality": rng.choice([0, 1, None]), "toxic": rng.choice([0, 0, 1])} for i in range(63)] + [{"doc_id": 3, "quality": 0, "toxic": 0}]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])
    pq.write_table(pa.Table.from_pylist(docs, schema), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels), tmp_path / "labels.parquet")
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    poor = {r["doc_id"] for r in labels if r["quality"] == 0} - toxic
    want = Counter()
    for r in docs:
        if r["doc_id"] in toxic:
            continue
        text = r["text"] or ""
        if r["doc_id"] in poor:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        for name, n in ((token_rollup.BPE, len(encode(text, default_vocabulary()))), (token_rollup.WORDS, len(re.findall(r"[^\x20\x09-\x0D]+", text)))):
            want[r["source"], r["lang"], name, "docs"] += 1
            want[r["source"], r["lang"], name, "tokens"] += n
    got = {}
    for r in queries.op2_token_counts(spark, f"file://{tmp_path}").collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == dict(want)


def test_rollup_has_one_writer_a_batch_and_compacts(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    counts = spark.createDataFrame([("s", "en", "t", 5), ("s", None, "t", 7)], "source string, lang string, tokenizer string, n_tokens long")
    won = []
    writers = [threading.Thread(target=lambda: won.append(token_rollup.Rollup(spark, f"file://{tmp_path}/r").commit("x", token_rollup.inserts(counts)))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(won) == [False, False, False, True] and rollup.batches() == ["x"]
    totals = lambda: sorted(map(tuple, rollup.totals().collect()), key=str)
    assert rollup.commit("y", token_rollup.inserts(counts)) and rollup.commit("empty", counts.limit(0).transform(token_rollup.inserts))
    before = totals()
    assert rollup.compact() and totals() == before and rollup.batches() == ["empty", "x", "y"]
    assert not rollup.commit("x", token_rollup.inserts(counts)) and rollup.commit("z", token_rollup.deletes(counts))
    assert rollup.compact() and before == [(a, b, c, n * 2, t * 2) for a, b, c, n, t in totals()]
    last = totals()
    rollup.vacuum()
    assert totals() == last and not rollup.commit("y", token_rollup.inserts(counts)) and len(rollup.files.names("data")) == 1


# op3


def test_line_dedup_with_hot_lines(spark):
    rng = random.Random(2)
    lines = ["a licence line that very many documents hold", "another line of some length that repeats", "Short", "", "  A Licence line that very many documents HOLD "]
    rows = [(rng.choice([i, i, i // 2, None]), "\n".join(rng.choices(lines + [f"a line of its own, number {i} of all"], k=rng.randint(1, 5)))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hub in (1, 50_000):
        got = sorted(map(tuple, line_dedup.dedup_lines(frame, hub=hub).collect()), key=str)
        assert got == brute_lines(rows)


# op4


def exhaustive(items, texts, same=0.8, paraphrase=0.6, answered=0.75):
    """Best accepted share of every pair over all stretches: near copies, and paraphrases, without any cosine."""
    near, para = set(), set()
    for doc, text in texts.items():
        words = np.array(decontamination._ids_of(text), np.int64)
        for key, ids in items.items():
            m, reach = len(ids), decontamination.reach_of(len(ids))
            answer = ids[-max(3, m // 4) :]
            sums = np.concatenate([[0], np.cumsum(np.isin(words, ids))])
            ends = np.minimum(np.arange(len(words)) + reach, len(words))
            for s in np.flatnonzero(sums[ends] - sums[:-1] >= paraphrase * m - 1e-9).tolist():
                part = words[s : s + reach].tolist()
                lcs = decontamination.common_subsequence(ids, part) / m
                if lcs >= same:
                    near.add((doc, key))
                elif lcs >= paraphrase and decontamination.common_subsequence(answer, part) / len(answer) >= answered:
                    para.add((doc, key))
    return near, para - near


def reworded(rng, words, filler, share):
    """Words lost, replaced or put in at ``share`` of the places before the answer."""
    out, kept = [], len(words) - max(3, len(words) // 4)
    for i, w in enumerate(words):
        if i < kept and rng.random() < share:
            out += rng.choice([[], [rng.choice(filler)], [w, rng.choice(filler)]])
        else:
            out.append(w)
    return out


def test_retrieval_against_exhaustive_subsequences(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    raw = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(11)
    texts = {r.doc_id: r.text for r in docs.collect()}
    filler = [w for t in list(texts.values())[:80] for w in (t or "").split()]
    for n, (text, share) in enumerate(itertools.product(raw.values(), (0.15, 0.35, 0.45, 0.5, 0.55))):
        texts[10_000 + n] = " ".join(rng.choices(filler, k=rng.randint(0, 150)) + reworded(rng, text.split(), filler, share) + rng.choices(filler, k=rng.randint(0, 90)))
    items = {k: decontamination._ids_of(t) for k, t in raw.items()}
    near, para = exhaustive(items, texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame, bench).collect()}
    assert near <= got.keys() <= near | para
    assert len(para) > 40 and len(para & got.keys()) >= 0.9 * len(para)
    assert all(r.lcs >= 0.8 or r.cosine >= 0.4 and r.answer >= 0.75 and r.lcs >= 0.6 for r in got.values())
    # the cosine decides for paraphrases: those below it, and no others, are left out
    strictly = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench, min_cosine=1.1).collect()}
    assert strictly == near
    # small blocks of items change nothing
    again = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench, block=64).collect()}
    assert again == got.keys()


def test_items_of_equal_text_and_very_long_texts(spark):
    words = [f"w{i}" for i in range(3000)]
    rng = random.Random(1)
    item = "the quick brown fox jumps over a lazy dog while seven wizards boil quince jelly"
    long = " ".join(rng.choices(words, k=600_000))
    docs = [(1, f"{long} {item.upper()} {long}"), (2, "the quick brown fox"), (3, item), (3, item), (None, item)]
    bench = spark.createDataFrame([("a", item), ("b", item), ("c", None), ("d", ""), (None, item)], "item_id string, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(d, k): 2 if d == 3 else 1 for d in (1, 3, None) for k in ("a", "b", None)})
    assert all(r.lcs == 1 and r.answer == 1 for r in got)


# op5


def test_path_lengths_against_a_walk_of_each_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality_rules.FEATURES))).astype(np.float32)
    forest = quality_rules.grow(x, trees=9)

    def walk(tree, row):
        feature, split, child, depth = (part[tree] for part in (forest.feature, forest.split, forest.child, forest.depth))
        node = 0
        while feature[node] >= 0:
            node = child[node] + int(row[feature[node]] >= split[node])
        return depth[node]

    probes = np.concatenate([x[:20], x[:5] * 9])
    harmonic = sum(1 / i for i in range(1, forest.size))
    expected = 2 * harmonic - 2 * (forest.size - 1) / forest.size
    want = [2 ** (-np.mean([walk(t, row) for t in range(9)]) / expected) for row in probes]
    assert np.allclose(forest.score(probes), want, rtol=2e-3)


def test_threshold_comes_from_good_and_bad_rows():
    rng = np.random.default_rng(4)
    good, bad = (rng.normal(loc=c, size=(400, len(quality_rules.FEATURES))).astype(np.float32) for c in (0, 9))
    forest = quality_rules.grow(good[:200])
    x, is_good = np.concatenate([good[200:], bad]), np.arange(600) < 200
    alone = quality_rules.calibrated(forest, x[is_good], is_good[is_good]).threshold
    both = quality_rules.calibrated(forest, x, is_good).threshold
    scores = forest.score(x)
    assert alone < both < scores[~is_good].min() and (scores[is_good] <= both).mean() >= 0.995


def test_rules_are_learned_from_all_labelled_rows(spark):
    n = 12_000
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", k), F.lit(5000)).cast("string"))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", F.concat(words, F.expr("repeat(' ! | #', cast(doc_id % 40 = 0 as int) * 20)")))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 40 == 0, 0).otherwise(1).alias("quality"))
    forest = quality_rules.learn(docs, labels)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    seen = quality_rules.measured(docs).join(labels, "doc_id").where((F.col("quality") == 0) | (F.pmod(order, F.lit(2)) == 1)).select("quality", "features").collect()
    x, good = np.array([r.features for r in seen], np.float32), np.array([r.quality == 1 for r in seen])
    assert len(seen) > 5000 and forest.size == 256 and len(forest.feature) == 128
    found = forest.threshold
    assert abs(quality_rules.calibrated(forest, x, good).threshold - found) < 1e-12


def test_rules_hold_on_rows_that_taught_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    taught = (F.col("doc_id") % 3 != 0) & F.col("quality").isNotNull()
    forest = quality_rules.learn(docs, labels.where(taught))
    quality = {r.doc_id: r.quality for r in labels.where(~taught).collect()}
    judged = [(quality[r.doc_id], r.kept) for r in quality_rules.judge(docs, forest).collect() if r.doc_id in quality and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) >= 0.95 and not any(k for q, k in judged if q == 0)


# op6


@pytest.mark.parametrize("capacity", [1, 33, 4096, 8192])
def test_packing_at_other_capacities(spark, capacity):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = packing.pack(docs.limit(40) if capacity < 64 else docs, capacity=capacity).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(itertools.accumulate([r.length for r in own[:-1]], initial=0)) and own[-1].offset + own[-1].length <= capacity
    want = Counter(r.doc_id for r in docs.collect())
    tokens_of = Counter()
    for r in rows:
        tokens_of[r.doc_id] += r.length
    assert all(tokens_of[r.doc_id] == r.doc_tokens * want[r.doc_id] for r in rows)


def test_packing_refuses_odd_capacities(spark):
    for capacity in (0, -1, (1 << 20) + 1):
        with pytest.raises(ValueError):
            packing.pack(awkward(spark), capacity=capacity)


def test_packing_covers_repeated_rows(spark):
    odd = awkward(spark)
    want = Counter()
    for r in odd.collect():
        ids = np.append(encode(r.text or "", default_vocabulary()), np.array([1], "<u4"))
        want[r.doc_id] += len(ids)
    got = Counter()
    for r in packing.pack(clashing(odd)).collect():
        got[r.doc_id] += r.length
    assert got == want


# op7


@pytest.mark.parametrize("hub", [1])
def test_hubs_are_joined_like_others(spark, hub):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    records = []
    for i in range(120):
        text = rng.choice([base[i % 6], base[i % 6].replace("w1 ", "w2 ", 1), "", f"{base[i % 6]} w{i % 9}"])
        records.append((rng.choice([i, i, None]), text))
    frame = spark.createDataFrame(records, "doc_id long, text string")
    prints = [brute_fingerprint(t) for _, t in records]
    comp = brute_components(set(prints))
    least = {}
    for (i, _), p in zip(records, prints):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame, hub=hub).collect())
    assert got == sorted((str(i), f"{p:016x}", str(least.get(comp[p]))) for (i, _), p in zip(records, prints))


def test_near_duplicates_are_told_apart_by_text(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"q{rng.getrandbits(40)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (5, d), (5, d), (None, None), (9, "")]
    kept = simhash.drop_near_duplicates(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, b), (None, c), (None, c), (5, d), (5, d), (9, "")])


# op8


def test_large_and_small_hosts_lose_the_same_runs(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"v{rng.getrandbits(40)}" for _ in range(n))
    rare = words(15)
    pages = [(i, "https://big.example/x", f"<div>{words(12)}</div>" + (f"<div>{rare}</div>" if i % 256 == 7 else "")) for i in range(1000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in html_text.extract(frame).collect():
        assert len(r.text.split()) == 12 and r.n_recurring == (15 if r.page_id % 256 == 7 else 0)


def test_the_suffix_array_decides_silent_text(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"v{rng.getrandbits(40)}" for _ in range(n))
    notice = words(20)
    own = [[words(9), words(9)] for _ in range(12)]
    # boilerplate within a block, more and less than half of it
    pages = [(i, "https://s.example/x", f"<div>{a} {notice} {b}</div><div>{notice}</div>") for i, (a, b) in enumerate(own)]
    near = words(60)
    pages += [(100 + i, "https://two.example/x", f"<div>{near} {words(3)}</div>") for i in range(2)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    off = {r.page_id: r.text for r in html_text.extract(frame, min_pages=10_000).collect()}
    for i, (a, b) in enumerate(own):
        assert got[i] == f"{a} {b}" and off[i] == f"{a} {notice} {b} {notice}"
    assert all(len(got[100 + i].split()) == 63 for i in range(2))  # two near copies lose nothing


def test_covered_tokens_are_those_of_all_repeated_substrings():
    rng = random.Random(9)
    streams = [" ".join(rng.choices("abcd", k=rng.randint(0, 50))) for _ in range(24)]
    raw = " ".join(streams)
    offsets = np.cumsum([0] + [len(s) + 1 for s in streams])
    offsets[-1] = len(raw)
    for least in (2, 3):
        covered, first = html_text.recurring(np.frombuffer(raw.encode(), np.uint8), offsets, np.zeros(24, int), 8, None, least)
        tokens_of = [s.split() for s in streams]
        # every length from 8 on, not only the depth of the suffix order
        want = [set() for _ in streams]
        for length in range(8, 51):
            held = {}
            for n, t in enumerate(tokens_of):
                for i in range(len(t) - length + 1):
                    held.setdefault(tuple(t[i : i + length]), []).append((n, i))
            for places in held.values():
                if len({n for n, _ in places}) >= least:
                    for n, i in places:
                        want[n] |= set(range(i, i + length))
        for n in range(24):
            assert set(np.flatnonzero(covered[first[n] : first[n + 1]])) == want[n]


def test_tags_that_never_end_and_names_that_mislead():
    began = time.time()
    assert html_text.blocks("<p>ok</p>" + '<a "' * 250_000) == [(1, False, "ok")]
    assert html_text.blocks("<div>" * 100_000 + "</p>" * 100_000) == [] and html_text.blocks("<!" * 300_000) == []
    html_text.blocks('<p title="a>text <b>x</b> ' * 40_000)
    assert time.time() - began < 20
    text = lambda page: " ".join(t for z, _, t in html_text.blocks(page) if z == html_text.MAIN)
    assert html_text.blocks('<p title="a>text</p><p>more</p>') == [(1, False, "text"), (1, False, "more")]
    kept = "<div class='side-effects'>a</div><p id='share-prices'>b</p><p class='cookie-recipe'>c</p><p class='commentary'>d</p><span class='notice'>e</span>"
    lost = "<div class='share'>-</div><div id=cookieNotice>-</div><div class='x related-posts'>-</div><p class='ad-slot-3'>-</p><section id='user_comments'>-</section>"
    assert text(f"<article>{kept}{lost}</article>") == "a b c d e"
    assert text("<article><p>a <span class='ad'>-<span>-</span>-</span> b <i hidden>-</i> c<span class=ads><div>-</div></span> d</p><p>e<b class='advert'>-</p><p>f</p></article>") == "a b c d e f"


# op9


def test_forward_pass_and_gradients_against_plain_ones():
    rng = np.random.default_rng(1)
    bag = np.array([0, 3, 4, 9, 12])
    x = rng.normal(size=(12, quality_classifier.N_FEATURES))
    y = np.array([1.0, 0, 1, 0])
    model = quality_classifier.train(x.copy(), bag, y, steps=3)
    p, w = model.prepared(x), model.weights
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def plain():
        out = []
        for a, b in itertools.pairwise(bag):
            hs = [np.tanh(row @ w["W"] + w["b"]) for row in p[a:b]]
            energies = [sum(w["w"][j] * np.tanh(h @ w["V"][:, j]) * sigmoid(h @ w["U"][:, j]) for j in range(len(w["w"]))) for h in hs]
            weights = np.exp(energies) / np.sum(np.exp(energies))
            out.append(sigmoid(sum(k * h for k, h in zip(weights, hs, strict=True)) @ w["u"] + w["c"]))
        return np.array(out)

    assert np.allclose(model.score(x, bag), plain())
    loss = lambda: -np.mean(y * np.log(plain()) + (1 - y) * np.log(1 - plain()))
    for name, grad in model.gradients(p, bag, y).items():
        w[name] = np.array(w[name], float)
        for at in list(np.ndindex(w[name].shape))[:: max(1, w[name].size // 7)]:
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = loss()
            w[name][at] = old - 1e-5
            down = loss()
            w[name][at] = old
            assert np.isclose((up - down) / 2e-5, grad[at], atol=1e-6), name


# op10


def plain_feistel(a, b, p, q, key, kind):
    for r in range(8):
        other = b if r % 2 == 0 else a
        f = int(hashlib.sha256("|".join([f"{key}|{kind}", str(p), str(q), str(r), str(other)]).encode()).hexdigest()[:15], 16)
        a, b = ((a + f) % p, b) if r % 2 == 0 else (a, (b + f) % q)
    return a, b


def test_feistel_against_a_plain_one(spark):
    rows = [(a, b, p, q) for p, q in ((189, 773), (10, 100), (7, 1)) for a, b in ((0, 0), (p - 1, q - 1), (p // 2, q // 3))]
    frame = spark.createDataFrame(rows, "a long, b long, p long, q long")
    got = frame.select("*", pii.feistel(F.col("a"), F.col("b"), F.col("p"), F.col("q"), "k", "t").alias("x")).collect()
    assert all((r.x.a, r.x.b) == plain_feistel(r.a, r.b, r.p, r.q, "k", "t") for r in got)


def test_different_dates_get_different_ones(spark):
    day = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(146_097).select(day.alias("d"))
    late = days.where("dayofmonth(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("text"))
    first = days.where("pmod(hash(d), 5) = 0").select(F.date_format("d", "dd/MM/yyyy").alias("text"))
    slashed = late.unionByName(first)
    got = pii.pseudonymise(slashed, "k")
    r = got.agg(F.count("*").alias("n"), F.count_distinct("text").alias("d"), F.sum("n_dates").alias("dates"), F.count_if(~F.col("text").rlike(r"^[0-9]{2}/[0-9]{2}/(?:1[89]|2[01])[0-9]{2}$")).alias("odd")).first()
    assert (r.n, r.d, r.dates, r.odd) == (slashed.count(), slashed.count(), slashed.count(), 0)
    # what can only be month first stays so, and all of these dates are reached
    back = pii.pseudonymise(late, "k")
    assert back.select("text").exceptAll(late).count() == 0 and back.distinct().count() == 88_497


def test_numbers_abroad_keep_their_country_and_long_mailboxes_go(spark):
    numbers = {"+49 30 123456": "49", "+49 30 123457": "49", "+351 21 123 4567": "351", "+7 495 123 45 67": "7", "+44 20 7946 0958": "44", "+1 212 555 0100": "1", "+852 2345 6789": "852", "(212) 555-0100": ""}
    mails = ["m" * 70 + "@example.com", "x@" + "a." * 12 + "example.org", "Ab.9_" * 40 + "@b.co", "q" * 33 + "@b.co"]
    rows = list(enumerate([f"call {n} now" for n in numbers] + mails))
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = [r.text for r in got]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for (number, code), text, r in zip(numbers.items(), new, got):
        out = text[5:-4]
        assert r.n_numbers == 1 and shape(out) == shape(number) and out != number
        assert not code or re.sub("[^0-9]", "", out).startswith(code)
    assert len(set(new)) == len(new)
    for mail, text in zip(mails, new[len(numbers) :]):
        assert shape(text) == shape(mail) and text != mail and text.partition("@")[2] == mail.partition("@")[2]
    plan = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# pipeline


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, docs in (("odd", clashing(awkward(spark))), ("none", awkward(spark).limit(0))):
        d = f"file://{tmp_path}/{name}"
        for table, frame in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            frame.write.parquet(f"{d}/{table}.parquet")
        packed = corpus_pipeline.run(spark, d).collect()
        if name == "none":
            assert not packed
            continue
        stage_docs = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, stage_docs, d)
            assert out.columns == docs.columns
            stage_docs = spark.createDataFrame(out.collect(), docs.schema)
        texts = Counter((r.doc_id, r.text) for r in stage_docs.collect())
        assert texts and max(texts.values()) <= 2 and {r.doc_id for r in packed} == {i for i, _ in texts}


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("max_bucket", [2, 32])
def test_similar_texts_against_all_pairs(spark, max_bucket):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 300))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "ONE two", "one TWO", texts[0].upper()]
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    marked = frame.select("n", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    at = {r.mark: r.text for r in marked.collect()}
    sets = {m: shingle_set(t) for m, t in at.items()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8 - 1e-12}
    got = {(r.a, r.b) for r in simhash.similar(marked.select("mark", "text"), max_bucket=max_bucket, hub=1 if max_bucket == 2 else 50_000).collect()}
    assert got <= want and len(want) > 100
    joined_by = lambda edges: {frozenset(g) for g in _groups(sets, edges)}
    # with small buckets and stars alone nearly all groups stay whole, too
    assert len(joined_by(got) ^ joined_by(want)) <= (0 if max_bucket == 32 else 4)


def test_similar_texts_lose_no_link_in_large_buckets(spark):
    # chains of copies, each like its neighbours alone, and texts that share a passage and no more: keys of many texts that aren't all alike
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=30)
    texts = [" ".join(rng.choices(words, k=20) + passage + rng.choices(words, k=20)) for _ in range(40)]
    for _ in range(4):
        link = rng.choices(words, k=100)
        for _ in range(45):
            link = link[2:] + rng.choices(words, k=2) if rng.random() < 0.7 else link[12:] + rng.choices(words, k=12)
            texts.append(" ".join(link))
    marked = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("mark"), "text")
    sets = {r.mark: shingle_set(r.text) for r in marked.collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8 - 1e-12}
    groups = {frozenset(g) for g in _groups(sets, want)}
    assert 60 < len(groups) < len(sets) - 60
    for max_bucket in (2, 8):
        got = {(r.a, r.b) for r in simhash.similar(marked, max_bucket=max_bucket).collect()}
        assert got <= want and {frozenset(g) for g in _groups(sets, got)} == groups


def test_no_pair_at_the_bound_is_lost(spark):
    # 45 shingles each, 40 in common: a similarity of 0.8 and no more; bands of min-hashes lose about one such pair in 500
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(k, " ".join(t)) for k in range(2500) for base in [draw(49)] for t in (base, base[5:] + draw(5))]
    marked = spark.createDataFrame(rows, "k long, text string").select("k", F.xxhash64("text").alias("mark"), "text")
    assert simhash.similar(marked.select("mark", "text")).select("a", "b").distinct().count() == 2500


def _groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return out.values()


def test_the_pipelines_near_duplicates_are_similar(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, similarity=0.8).collect()}
    close = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    texts = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    holders = {}
    for i in sorted(close):
        for s in texts[i]:
            holders.setdefault(s, []).append(i)
    pairs = {p for ids in holders.values() if len(ids) < 200 for p in itertools.combinations(ids, 2)}
    alike = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    # what stays holds no two alike; what went is like something that was there
    assert alike and not [p for p in alike if p[0] in kept and p[1] in kept]
    assert kept < close and close - kept == {b for g in _groups(close, alike) for b in g if b != min(g)}


def test_near_duplicates_leave_only_the_ids_that_go(spark, monkeypatch):
    """In slices, too, the same stays; no copy of the texts is left."""
    from tidemark.control.files import Files, shared_dir

    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(words[i * 30 : i * 30 + 60]) for i in range(12)]
    texts += [f"{t} extra{i}" for i, t in enumerate(texts[:5])] + texts[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    there = Files(spark, shared_dir(spark))
    monkeypatch.setattr(simhash, "SLICE", 1 << 11)
    before = set(there.names("."))
    out = simhash.drop_near_duplicates(docs, similarity=0.8)
    assert {x.rsplit("-", 1)[0] for x in set(there.names(".")) - before} <= {"near-copies", "similar-copies"}
    assert {r.doc_id for r in out.collect()} == set(range(12))


def test_texts_stay_where_they_are_when_some_are_left_out(spark, monkeypatch):
    """However large Spark takes a list of ids to be: neither stage of the pipeline shuffles or keeps a copy of all texts."""
    from tidemark.control.files import Files, shared_dir

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 30 : i * 30 + 60]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(f"{t} extra{i}" for i, t in enumerate(texts[:5])), texts[0]])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, texts[7])], "item_id long, text string")
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real, plans = simhash.written, {}

    def seen(df, label):
        plans[label] = plan_of(df)
        return real(df, label)

    monkeypatch.setattr(simhash, "written", seen)
    there = Files(spark, shared_dir(spark))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = simhash.drop_near_duplicates(docs, similarity=0.8)
        before = set(there.names("."))
        clean = decontamination.decontaminate(docs, bench)
        assert {x.rsplit("-", 1)[0] for x in set(there.names(".")) - before} <= {"hits"}
        for plan in (plan_of(apart), plan_of(clean), *(plans[x] for x in ("fingerprints-apart", "similar-texts", "apart-texts"))):
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {r.doc_id for r in apart.collect()} == set(range(12))
        assert {r.doc_id for r in clean.collect()} == set(range(18)) - {7}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_that_cannot_be_similar_do_not_travel_by_key(spark, monkeypatch):
    """Texts of very different lengths share a passage: their keys are sent nowhere. Those of one length that can be similar are found."""
    passage, fresh = [f"p{i}" for i in range(40)], itertools.count()
    grown = [" ".join(passage + [f"x{next(fresh)}" for _ in range(n)]) for n in (10, 40, 90, 180, 350)]
    rows = {}
    real = simhash.written

    def seen(df, label):
        out = real(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", seen)
    marked = spark.createDataFrame(list(enumerate(grown)), "mark long, text string")
    assert simhash.similar(marked).count() == 0
    assert rows["apart-keys"][0] and rows["apart-rows"] == [0]
    # by place, too: the passage is a ninth of each text, the order of the hashes is as good as drawn
    even = [" ".join([f"y{next(fresh)}" for _ in range(160)] + passage[:24]) for _ in range(6)]
    marked = spark.createDataFrame(list(enumerate([*even, even[4] + " end", even[5] + " end"])), "mark long, text string")
    got = {(r.a, r.b) for r in simhash.similar(marked).collect()}
    assert got == {(4, 6), (5, 7)}
