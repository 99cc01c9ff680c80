"""Corpus operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddsframe.llm import htmltext, langid, mixing, packing, search, sharding, simhash, suffixarray, suffixes, toxicity, winnowing
from oddsframe.llm.components import components
from oddsframe.llm.shared import documents
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


def test_permutation_inverts(spark):
    for total in (1, 2, 3, 7, 100, 1009):
        rows = spark.range(total).select(F.col("id").alias("n"), F.lit(total).cast("long").alias("t"))
        placed = sharding.permuted(rows, "n", "t", seed=5)
        found = {r["n"]: r["position"] for r in placed.collect()}
        assert sorted(found.values()) == list(range(total))
        places = placed.select((F.col("position") % 4).alias("shard"), F.floor(F.col("position") / 4).alias("slot"), "n")
        assert all(r["number"] == r["n"] for r in sharding.row_number_at(places, total, 4, seed=5).collect())


def test_entropy_target(docs):
    rows, plan = mixing.solved(docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "big").otherwise(F.col("source"))), 9.0, 2.0, None)
    weights = [r["weight"] for r in plan.collect()]
    assert math.isclose(sum(weights), 1, abs_tol=1e-9)
    assert math.isclose(-sum(w * math.log(w) for w in weights), 2.0, abs_tol=1e-4)


def test_repeat_limit_and_budget(docs):
    rows = mixing.mixture(docs, max_repeats=1.5).collect()
    spent = Counter()
    for r in rows:
        spent[r["source"]] += r["tokens"]
    natural = {r["source"]: r["n"] for r in docs.withColumn("w", mixing.n_words(F.col("text"))).groupBy("source").agg(F.sum("w").alias("n")).collect()}
    assert max(spent[s] / natural[s] for s in natural) <= 1.5 + 1e-6 and min(spent[s] / natural[s] for s in natural) >= 1.0 - 1e-9
    blocks = Counter(r["block"] for r in rows)
    assert min(blocks) == 0 and len(blocks) == max(blocks) + 1


def total(found):
    return sum(map(packing.cost, found[2]))


def test_packing_is_sound_and_never_dearer_than_one_length():
    rng = np.random.default_rng(3)
    kinds = [[600] * 1000, [700] * 1000, [512] * 77, [1] * 3000, [8192] * 9 + [5] * 40, [*rng.integers(3000, 5000, 200), *rng.integers(1, 300, 900)], rng.integers(1, 8193, 800), rng.integers(1, 200, 2000)]
    for kind in kinds:
        sizes = sorted((int(x) for x in kind), reverse=True)
        found = packing.best_fit(sizes)
        used = Counter()
        for k, at, size in zip(*found[:2], sizes):
            assert at == used[k]
            used[k] += size
        assert [next(n for n in packing.LENGTHS if n >= used[k]) for k in range(len(used))] == found[2]
        for n in packing.LENGTHS:
            if n >= sizes[0]:
                assert total(found) <= -(-len(sizes) // (n // sizes[0])) * packing.cost(n) + 1e-6 if sizes[0] == sizes[-1] else total(found) <= total(packing.packed(sizes, packing.LENGTHS, n))
    assert total(packing.best_fit([600] * 1000)) <= 748_160 and total(packing.best_fit([700] * 1000)) <= 934_400


def test_packing_is_near_the_optimum_of_small_cases():
    rng = np.random.default_rng(8)
    ratios = []
    for _ in range(40):
        sizes = sorted((int(x) for x in rng.integers(100, 4000, rng.integers(1, 8))), reverse=True)
        ratios.append(total(packing.best_fit(sizes)) / brute.least_packing_cost(sizes, packing.LENGTHS, packing.cost))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.25 and np.mean(ratios) < 1.03


def test_equal_rows_keep_the_budget(spark):
    rows = [(1, "x", "a b c d e f g h i j")] * 30 + [(k, "x", "one two three") for k in range(2, 60)] + [(99, "y", "w " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    spent = Counter()
    plan = mixing.solved(df, 2.0, None, 900)[1].collect()
    for r in mixing.mixture(df, budget=900).collect():
        spent[r["source"]] += r["tokens"]
    assert all(spent[r["name"][2:]] <= r["budget"] for r in plan)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_ball_links_connect_everything(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for seed in list(fps)[:12]:  # chains and clusters of near values
        at = seed
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                at ^= 1 << int(b)
            fps.add(at)
    fps = sorted(fps)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = components(simhash.links(rows, radius, bucket_values=20_000))
    roots = {r["node"]: r["root"] for r in found.collect()}
    names = [roots.get(int(np.uint64(f).astype(np.int64)), ("alone", f)) for f in fps]
    want = brute.classes(fps, radius)
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_meeting_survives_false_neighbours():
    """Values that only share their low bits, with the least member a stranger."""
    a = np.uint64(0b1011)
    group = np.array([1 << 40 | 0b111, int(a), int(a) ^ 1, int(a) ^ 2, int(a) ^ 4], np.uint64)
    links = set()
    for mask in simhash.ball(2):
        for bucket in range(1):
            home, bits = simhash._spread(group ^ mask, 1)
            x, y = simhash.meet(np.r_[group, group], np.ones(2 * len(group), np.uint16), np.r_[bits, np.full(len(group), bits[1])].astype(np.uint32), bucket, 1, 4)
            links |= set(zip(x.tolist(), y.tolist()))
    assert all(bin(x ^ y).count("1") <= 4 for x, y in links)


def test_components_of_long_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1400)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {found[k] for k in range(301)} == {0} and {found[k] for k in range(1000, 1400)} == {1000}


def test_near_duplicates(docs, texts):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute.simhash(t) for _, t in texts]
    roots = brute.classes(fps)
    least = {}
    for (i, _), root in zip(texts, roots):
        least[root] = min(i, least.get(root, i))
    assert found == {i: (f"{f:016x}", least[r]) for (i, _), f, r in zip(texts, fps, roots)}


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70)).astype(np.uint8)
        data = x.tobytes()
        assert suffixarray.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: data[i:])
    wide = rng.integers(0, 3000, 5000)
    order = suffixarray.suffix_array(wide)
    assert all(wide[a : a + 50].tolist() <= wide[b : b + 50].tolist() for a, b in zip(order[:-1], order[1:]))


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_passages(docs, texts, monkeypatch, hot):
    if hot:  # everything that is at all frequent goes window by window
        monkeypatch.setattr(suffixes, "HOT_ROWS", 0)
        monkeypatch.setattr(suffixes, "HOT_SHARE", 0.002)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_passages(docs).collect()}
    want = {i: (len((t or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, runs) in zip(texts, brute.cut_repeats([t for _, t in texts]))}
    assert found == want


def test_repeats_over_pieces_and_periods(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    rng = np.random.default_rng(2)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 900))
    rows = [(1, base), (2, "x" * 50 + base[100:700] + "y" * 250), (3, "ab" * 300), (4, "z" + base[250:349] + "z" + base[500:601]), (5, "ab" * 70), (6, base[::-1] + base[:120])]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in found] == [(n, runs) for _, n, runs in brute.cut_repeats([t for _, t in rows])]


def test_winnowing(docs, texts):
    found = {r["doc_id"]: r for r in winnowing.fingerprints(docs).collect()}
    down = texts[::-1]
    for k, (i, text) in enumerate(down):
        following = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        if len(text) < 900:
            chosen = [brute.winnow(t, winnowing.GRAM, winnowing.WINDOW) for t in (text, other)]
            assert [found[i]["fingerprint"], found[i]["edited_fingerprint"]] == ["".join(f"{h:08x}{p:08x}" for h, p in c) for c in chosen]
            a, b = ({h for h, _ in c} for c in chosen)
            assert math.isclose(found[i]["near_edited"], len(a & b) / len(a | b) if a | b else 1.0)


def test_languages(docs, texts):
    model = langid.learn(docs)
    profiles = langid.Profiles(model)
    plain = {lang: {"".join(chr(g >> 2 >> 20 * (2 - k) & 0xFFFFF) or "" for k in range(3))[: g & 3].replace("\0", " "): r for g, r in ranks.items()} for lang, ranks in model.items()}
    for _, text in texts[:40]:
        assert profiles.judge([text[:600]])[0] == pytest.approx(brute.out_of_place(text[:600], plain, langid.PROFILE))
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) for r in rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(documents(spark, sf), labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([s >= 0.5 for s in good]) < 0.1


def test_toxicity_tolerates_gaps(spark):
    clean = ["the weather is fine and the garden grows", "a letter came from the town hall today", "we walked along the river until night", "she reads a long book about trains"]
    insults = ["dumbhead", "stinkface", "blockwit"]
    docs, marks = [], []
    for k in range(400):
        text = clean[k % 4] + f" number {k} and more words from {clean[(k + 1) % 4]}"
        docs.append((k, text if k % 2 else text + f". You {insults[k // 2 % 3]} and {insults[k // 4 % 3]}!"))
        marks.append((k, 0, 1 - k % 2))
    machine = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    scores = machine.score(["you d.u.m.b.h.e.a.d, a dumbhead", "such dumxbhead, stinkfxace", "a stink-face, st.ink.face", "a stinkface, b l o c k w i t", clean[0], "", "a walk by the river"])
    assert (scores[:4] > 0.5).all() and (scores[4:] < 0.5).all()


def test_triple_weights_are_the_kernel():
    words = [bytes(c - 96 for c in w.encode()) for w in ("idiot", "idxiot", "stupid", "a", "banana")]
    dense = toxicity.vectors(words)
    by_pairs = np.zeros((len(words), len(words)))
    for i, u in enumerate(words):
        for j, v in enumerate(words):
            for a in range(len(u)):
                for b in range(a + 1, len(u)):
                    for c in range(b + 1, min(len(u), a + toxicity.SPAN)):
                        for x in range(len(v)):
                            for y in range(x + 1, len(v)):
                                for z in range(y + 1, min(len(v), x + toxicity.SPAN)):
                                    if (u[a], u[b], u[c]) == (v[x], v[y], v[z]):
                                        by_pairs[i, j] += toxicity.DECAY ** (c - a + 1 + z - x + 1)
    scale = toxicity.mass(np.array([len(w) for w in words]))
    scale[scale == 0] = 1
    assert np.allclose(dense @ dense.T, by_pairs / scale[:, None] / scale[None, :], atol=1e-5)


def test_search_prunes_and_stays_exact(spark, docs):
    index = search.forward_index(docs).collect()
    words, counts = (np.concatenate([np.frombuffer(r[c], t) for r in index]) for c, t in (("words", np.uint64), ("counts", np.uint32)))
    owner = np.repeat(np.arange(len(index)), [len(r["counts"]) // 4 for r in index])
    known, terms = np.unique(words, return_inverse=True)
    sizes = np.array([len(r["counts"]) // 4 for r in index])
    shard = search.Shard(np.array([r["doc_id"] for r in index]), np.array([r["length"] for r in index]), sizes, terms, counts, counts / (1.0 + counts), len(known))
    opened = total = 0
    for pick in range(0, 200, 7):
        asked = np.unique(terms[owner == pick])[:40]
        scores = np.zeros(len(index))
        for t, o, c in zip(terms, owner, counts):
            if t in set(asked.tolist()):
                scores[o] += c / (1.0 + c)
        found, value, n = shard.best(asked, 5)
        want = sorted(range(len(index)), key=lambda i: (-round(scores[i], search.DIGITS), index[i]["doc_id"]))[:5]
        assert np.allclose(value, scores[want]) and shard.ids[found].tolist() == [index[i]["doc_id"] for i in want]
        opened, total = opened + n, total + shard.n_blocks
        if pick > 30:
            break
    assert opened <= total


def test_search_in_query_blocks(docs):
    asked = docs.where("doc_id % 40 = 0")
    whole = search.search(docs, asked, k=4).collect()
    parts = search.search(docs, asked, k=4, query_words=500).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 4 * asked.count()


def test_page_layout():
    page = """<!DOCTYPE html><title>no</title><style>.x{display:none} #y , b.z{color:red}</style><body>Hello <b>big</b>
 world<p>One<p>Two &amp; three<br>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li class=x>no</ul><div style="DISPLAY : none">no</div><div>d1</div><div>d2</div>
<table><caption>Cap<tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>wide cell here<tr><td rowspan=2>tall<td>1<tr><td>2</table>after<pre>  a
   b</pre><select><option>no<option selected>o2</select><details><summary>sum</summary>no</details><p hidden>no</p>end<script>no</script>"""
    want = "Hello big world\n\nOne\n\nTwo & three\nfour\n\n- a\n- b\n\n  3. x\n  4. y\n\nd1\nd2\n\nCap\nName   Qty\napple  3\nwide cell here\ntall   1\n       2\n\nafter\n\n  a\n   b\n\no2\nsum\nend"
    assert htmltext.visible_text(page) == want
    assert htmltext.visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert htmltext.visible_text("a < b & c <") == "a < b & c <"


def test_pipeline_stages(spark, texts):
    """Each stage of run() against what brute force keeps of its input."""
    steps = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SMALL)
    scores = toxicity.scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 0")
    kept = steps["toxicity"](spark, docs, SMALL)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in scores.select("doc_id").collect())

    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    roots = brute.classes([brute.simhash(t) for _, t in rows])
    unique = steps["simhash_neardup"](spark, kept, SMALL)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({min(i for (i, _), r in zip(rows, roots) if r == root) for root in set(roots)})

    rows = sorted((r["doc_id"], r["text"]) for r in unique.collect())
    clean = steps["suffix_array_dedup"](spark, unique, SMALL)
    want = [(i, data.decode("utf-8", "ignore")) for (i, _), (data, _, _) in zip(rows, brute.cut_repeats([t for _, t in rows]))]
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == want

    mixed = steps["temperature_mixing"](spark, clean, SMALL)
    emitted = mixing.mixture(clean, max_repeats=2.0, seed=7)
    assert Counter(r[0] for r in mixed.select("doc_id").collect()) == Counter(r[0] for r in emitted.select("doc_id").collect())

    packed = steps["best_fit_packing"](spark, mixed, SMALL).collect()
    tokens, bins = Counter(), Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["tokens"]
        bins[r["sequence"], r["capacity"]] += r["tokens"]
    want = Counter()
    for r in mixed.select("doc_id", "text").collect():
        want[r["doc_id"]] += len(brute.words(r["text"]))
    assert tokens == want
    assert all(n == min(x for x in packing.LENGTHS if x >= used) for (s, n), used in bins.items() if s is not None)
