"""Substring and near dedup, resampling, neighbours and the pipeline against brute force."""

import hashlib
import itertools
import math
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlab.llm import near, neighbours, quality, substrings
from textlab.llm.queries import QUERIES


def split(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def cut_plainly(rows, window):
    """[(doc_id, kept words, n_removed)] by looking at every window."""
    least = {}
    order = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        words = split(text)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            least[key] = min(least.get(key, doc), doc, key=order)
    out = []
    for doc, text in rows:
        words = split(text)
        gone = set()
        for p in range(len(words) - window + 1):
            if order(least[tuple(words[p : p + window])]) < order(doc):
                gone.update(range(p, p + window))
        out.append((doc, " ".join(w for i, w in enumerate(words) if i not in gone), len(gone)))
    return out


def test_cover_has_every_difference():
    pairs = itertools.product(substrings.COVER, repeat=2)
    assert {(a - b) % substrings.PERIOD for a, b in pairs} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "SMALL_BLOCK", 2000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4000)
    draw = random.Random(seed)
    stock = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.randint(30, 160))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [draw.choice(stock) if draw.random() < 0.5 else " ".join(f"o{draw.random()}" for _ in range(draw.randint(0, 40))) for _ in range(3)]
        text = draw.choice([" ", "\n", "  "]).join(parts)
        start = draw.randrange(60)
        rows.append((i, text if draw.random() < 0.7 else " ".join(text.split()[start:])))
    rows += [(i + 100, rows[0][1]) for i in range(20)]
    found = substrings.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {d: (k, n) for d, k, n in cut_plainly(rows, 50)}
    assert {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in found} == want
    assert any(n for _, n in want.values())
    for r in found:
        words = split(dict(rows)[r["doc_id"]])
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(gone) == r["n_removed"] and " ".join(w for i, w in enumerate(words) if i not in gone) == r["kept_text"]


def test_repeats_of_odd_documents(documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = sorted(map(str, cut_plainly(rows, 50)))
    found = substrings.find_repeats(documents)
    assert sorted(str((r["doc_id"], r["kept_text"], r["n_removed"])) for r in found.collect()) == want
    kept = substrings.cut_repeats(documents, n_chars="n_chars")
    assert kept.columns == documents.columns and kept.schema["shard"] == documents.schema["shard"]
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert texts[3]["text"] is None and texts[5]["text"] == " \t\n " and texts[7]["text"] == "seven goes on" and texts[7]["n_chars"] == 13
    assert substrings.find_repeats(no_documents).count() == 0 and substrings.cut_repeats(no_documents).count() == 0
    with pytest.raises(ValueError):
        substrings.find_repeats(documents, cover=(0, 1))


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_darts_estimate_weighted_jaccard(weighting):
    draw = np.random.default_rng(1)
    elements = draw.integers(0, 2**63, 600).astype(np.uint64)
    a, b = draw.integers(1, 9, 600).astype(float), draw.integers(1, 9, 600) * 0.75
    if weighting == "set":
        a, b = np.ones(600), np.ones(600)
        a[500:], b[:100] = 0, 0
    sets = [(elements[w > 0], w[w > 0]) for w in (a, b)]
    owner = np.repeat([0, 1], [len(e) for e, _ in sets])
    k = 4000
    made = near.dart_signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]), owner, 2, k)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((made[0] == made[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / k)
    alone = near.dart_signatures(*sets[0], np.zeros(len(sets[0][0]), np.int64), 1, k)
    assert (alone[0] == made[0]).all()  # a set's signature depends on nothing else


def near_plainly(rows, least=0.8):
    """doc_id -> smallest doc_id of its class."""
    sets = [set(near.shingles((t or "").encode())[0].tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) / union >= least:
            parent[root(i)] = root(j)
    order = lambda d: (d is not None, d or 0)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(d)
    return sorted((str(rows[i][0]), str(min(classes[root(i)], key=order))) for i in range(len(rows)))


@pytest.mark.parametrize("members", [1000, 12])
def test_near_duplicates(spark, members, monkeypatch):
    monkeypatch.setattr(near, "GROUP_MEMBERS", members)
    draw = random.Random(4)
    base = [[f"w{draw.randrange(4000)}" for _ in range(draw.randint(60, 200))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = list(draw.choice(base[:2] if i < 90 else base))
        for _ in range(draw.choice([0, 1, 2, 5, 8, 20])):
            words[draw.randrange(len(words))] = f"n{draw.random()}"
        rows.append((1000 - i, " ".join(words)))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=60, rows=6).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in found) == near_plainly(rows)
    stays = [r["doc_id"] for r in found if r["kept"]]
    assert sorted(stays) == sorted({r["class_id"] for r in found})


def test_large_groups_of_texts_that_are_not_near(spark, monkeypatch):
    """One template in many unlike pages: the groups stay large, a few pages are near, and one pass finds them."""
    monkeypatch.setattr(near, "GROUP_MEMBERS", 40)
    calls, groups = [], near._groups

    def counted(*given):
        calls.append(1)
        assert len(calls) < 5, "a group is met again and again"
        return groups(*given)

    monkeypatch.setattr(near, "_groups", counted)
    draw = random.Random(9)
    template = " ".join(f"t{i}" for i in range(170))
    own = [" ".join(f"p{i}w{j}" for j in range(draw.choice([28, 32, 34]))) for i in range(600)]
    rows = [(i, f"{template} {text}") for i, text in enumerate(own)]
    rows += [(600 + i, f"{template} {own[i]} and {i} more") for i in range(60, 80)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=60, rows=6).collect()
    plain = near_plainly(rows)
    assert len({c for _, c in plain}) == 600
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in found) == plain


def test_near_duplicates_of_odd_documents(documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = near.near_duplicates(documents).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in found) == near_plainly(rows)
    assert sum(r["kept"] for r in found) == len({(r["class_id"], r["class_id"] is None) for r in found})
    kept = near.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in found)
    assert near.near_duplicates(documents, weighting="count").count() == len(rows)
    assert near.near_duplicates(no_documents).count() == 0 and near.keep_one(no_documents).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where(F.xxhash64("doc_id") % 2 == 0)
    found = quality.classify(docs, train).join(labels.where(F.xxhash64("doc_id") % 2 != 0), "doc_id")
    by = {r["quality"]: r["share"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert by[1] > 0.97 and by[0] < 0.2


def test_quality_weights_equal_a_plain_count(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, None), (None, 1), (6, 1)], "doc_id long, quality int")
    model = quality.fit(documents, labels)
    counts = np.zeros((2, 1 << quality.BUCKET_BITS))
    for r in documents.collect():
        found = np.bincount(quality.features(r["text"]), minlength=counts.shape[1])
        counts[0] += found
        counts[1] += found * (r["doc_id"] in (1, 6))
    raw, good = (np.log((c / c.sum() + 3 / len(c)) / 4) for c in counts)
    assert np.allclose(model.log_ratio, good - raw) and model.share == pytest.approx(0.75 + math.sqrt(0.75 * 0.25 / 4))
    rows = quality.classify(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r["doc_id"] in (3, 4):
            assert r["log_weight"] == 0 and r["n_features"] == 0
    keys = sorted((r["sample_key"] for r in rows), reverse=True)
    assert {r["kept"] for r in rows if r["sample_key"] >= keys[round(model.share * len(keys)) - 1]} == {True}
    assert quality.keep_good(documents, labels).count() == sum(r["kept"] for r in rows)
    assert quality.keep_good(documents, labels).columns == documents.columns
    assert quality.keep_good(documents, labels.where("false")).count() == documents.count()
    assert quality.classify(no_documents, labels).count() == 0


def test_gumbel_draws_in_proportion(spark):
    """Of two rows, the one of weight w is drawn first with probability w / (w + 1)."""
    frame = spark.range(20000).withColumn("t", F.lit("x"))
    share = frame.select(F.avg((quality.gumbel("id", "t", 1) + math.log(3) > quality.gumbel("id", "t", 2)).cast("double"))).first()[0]
    assert abs(share - 0.75) < 0.015


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = [((i * 7919) % 1000) / 7 if i % 3 else 2.5 for i in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(frame, "v", k, bins=4, few=10) == sorted(values, reverse=True)[k - 1]


def nearest_plainly(rows, k):
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            ranked = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = ranked[:k]
    return out


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * draw.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # one very common vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, block_rows=128).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    truth = nearest_plainly(rows, 10)
    assert set(found) == set(truth)
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert got == [(i + 1, *p) for i, p in enumerate(sorted((s, v) for _, s, v in got))]
        hits += len({v for _, _, v in got} & {v for _, v in truth[q]})
    assert hits / (10 * len(truth)) >= 0.9


@pytest.mark.parametrize("ids", [30, 400])
def test_neighbours_of_repeated_rows(spark, ids):
    """Every row 20 times, and one id with very many vectors, give what the rows once give."""
    random_ = np.random.default_rng(5)
    vectors = random_.normal(size=(ids, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(ids, [float(x) for x in v]) for v in random_.normal(size=(300, 8)) + 9]
    frame = spark.createDataFrame(rows * 20, "vec_id long, embedding array<double>")
    asked = list(range(0, ids, max(1, ids // 30)))
    found = {}
    for r in neighbours.nearest(frame, F.col("vec_id").isin(asked), block_rows=128).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in asked:
        least = {}
        for i, v in rows:
            if i != q:
                least[i] = min(least.get(i, math.inf), math.dist(v, vectors[q]))
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11)) and len({g[1] for g in got}) == 10
        assert all(math.isclose(g[2], least[g[1]], abs_tol=1e-9) for g in got)
        hits += len({g[1] for g in got} & set(sorted(least, key=lambda i: (least[i], i))[:10]))
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [1.0]), (9, [0.0, 2.0]), (None, [1.0, 2.0]), (10, [0.0, 2.0])]
    frame = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, query_id string")
    found = neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(0, 1, 100), (0, 2, 9), (0, 3, 10), (100, 1, 0), (100, 2, 9), (100, 3, 10)}
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 0"), F.lit(True)).count() == 0


def test_pipeline_stages(spark, documents, no_documents, sf_dir):
    columns = documents.columns
    for start in (documents, no_documents):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), documents.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.select("doc_id", "start").distinct().count() == packed.count()
        assert (packed.count() > 0) == (start is documents)


def test_a_pipeline_run_leaves_its_last_input_only(spark, sf_dir):
    from textlab.plans.durable import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    packed = corpus_pipeline.run(spark, sf_dir)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"))
    assert tokens.count() > 0 and tokens.where("n != of").count() == 0
    made = [p.name for p in set(folder.iterdir()) - before if not re.fullmatch(r"[0-9a-f-]{36}", p.name)]
    assert [n for n in made if n.startswith("stage-")] == [n for n in made if n.startswith("stage-substring_dedup-")]
    assert len([n for n in made if n.startswith("stage-")]) == 1 and len(made) <= 3  # packing's own beside it


def test_pipeline_equals_the_operators(spark, sf_dir):
    """Every stage keeps what its operator's query says, on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = QUERIES["op2_quality_classifier"](spark, sf_dir).where("kept").select("doc_id")
    first = stages["quality"](spark, docs, sf_dir)
    assert sorted(r[0] for r in first.select("doc_id").collect()) == sorted(r[0] for r in good.collect())
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    newest = {}
    for d, t in rows:
        key = hashlib.sha256(t.encode().lower()).digest()
        newest[key] = max(newest.get(key, -1), d)
    second = stages["exact_dedup"](spark, spark.createDataFrame(first.collect(), docs.schema), sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert sorted(d for d, _ in rows) == sorted(newest.values())
    third = stages["near_dedup"](spark, spark.createDataFrame(second.collect(), docs.schema), sf_dir)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({int(c) for _, c in near_plainly(rows)})
    rows = [(r["doc_id"], r["text"]) for r in third.collect()]
    fourth = stages["substring_dedup"](spark, spark.createDataFrame(third.collect(), docs.schema), sf_dir)
    want = {d: (t if not n else k) for (d, t), (_, k, n) in zip(rows, cut_plainly(rows, 50))}
    assert {r["doc_id"]: r["text"] for r in fourth.collect()} == want


def test_nearest_of_repeated_ids_and_of_extreme_vectors(spark):
    """A repeated query id asks with its smallest vector whatever the partitions; no square overflows or vanishes."""
    near = [(i, [float(i), 1.0]) for i in range(1, 11)]
    rows = near + [(0, [0.5, 1.0]), (0, [10.5, 1.0]), (0, [30.0, 1.0])]
    for parts in (1, 2, 5):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        found = neighbours.nearest(frame, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
        assert [r["vec_id"] for r in found] == [1, 2, 3] and [r["score"] for r in found] == [0.5, 1.5, 2.5]
    for size in (1e200, 1e-200, 1e307):
        frame = spark.createDataFrame([(i, [size * (i + 1), size]) for i in range(4)], "vec_id long, embedding array<double>")
        found = neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
        assert [r["vec_id"] for r in found] == [1, 2, 3] and [r["score"] / size for r in found] == pytest.approx([1, 2, 3])
    frame = spark.createDataFrame([(i, [(-1.0) ** i * 1.7e308] * 3) for i in range(3)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 0.0), (1, float("inf"))]
