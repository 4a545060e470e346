"""Quality scores, centroid clusters and source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgewise.llm import centroids, divergence, quality
from edgewise.llm.base import table

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# source divergence


def plain_audit(rows, min_docs, ranks):
    """Everything from whole texts, without chunks, witnesses or blocks."""
    docs = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = {t for t, n in seen.items() if n >= min_docs}
        count = {s: Counter() for d in docs if (s := d[1]) is not None and d[0] == lang}
        for d in docs:
            if d[0] == lang:
                count[d[1]].update({t: n for t, n in d[2].items() if t in kept})
        whole = sum(count.values(), Counter())

        def share(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "The", "the,", "(cat)", "cat-cat", "a1b", "é\xa0x", "ÀB", "x_y", "12", "\x1cq", "Z z", "ß", "dog.Cat", "…"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é"])) for _ in range(80)]
    rows += [(None, "en", "none"), ("", "fr", "empty"), ("only here", "it", None), ("alone", "pt", "p"), ("alone", "pt", "p"), ("alone", "pt", "p"), (" \n", "pt", "q")]
    rows += [("big " * 30_000 + "tail", "en", "a")] * 2
    df = spark.createDataFrame([(i % 7, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value long, term string")
    monkeypatch.setattr(divergence, "CELLS", 40)  # many blocks
    for parts, size in ((1, 1 << 20), (5, 20)):
        monkeypatch.setattr(divergence, "BATCH_BYTES", size)
        monkeypatch.setattr(divergence, "BLOCK", size)
        monkeypatch.setattr(divergence, "ROWS", 7 if size == 20 else 50_000)
        got = divergence.audit(df.coalesce(parts), ranks=9)
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 9)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_without_rows_or_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    got = divergence.audit(spark.createDataFrame([("rare", "en", "a"), (None, "en", "b")], schema)).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randrange(1, 10 ** rng.randint(1, 13))
        count = rng.randrange(0, total)
        assert divergence.shares(np.array([count]), np.int64(total))[0] == 1 + 10**9 * (count + 1) // total


# centroid clusters


def plain_clusters(rows, k, rounds, size, seed):
    kept = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [tuple(sum(x) // len(members[j]) for x in zip(*members[j])) if j in members else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, j in found:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, d, per[j], sum(per.values()), sha[j]) for i, d, j in found], key=str)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    points = [rng.normal(i % 3, 0.3, 6).tolist() for i in range(90)]
    rows = [(i, p) for i, p in enumerate(points)] + [(7, points[7])] * 3 + [(7, points[8])] + [(100 + i, [0.5] * 6) for i in range(30)]
    rows += [(None, [0.25] * 6), (201, None), (202, []), (203, [1.0] * 5), (204, [1.0] * 7), (205, [None] + [1.0] * 5), (206, [float("nan")] * 6), (207, [float("inf")] * 6), (208, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x", [2.0]) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string, lead array<double>")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, axes in ((5, 2), (8, 6), (3, 1)):
        got = centroids.clusters(df.repartition(3), k=k, rounds=4, size=6, seed=3, axes=axes)
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(exact, k, 4, 6, 3)


def test_few_vectors_none_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clusters(spark.createDataFrame([], schema)).count() == 0
    assert centroids.clusters(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.0])], schema)
    assert sorted((r["vec_id"], r["distance"]) for r in centroids.clusters(two, size=2).collect()) == [(1, 0), (2, 0)]
    with pytest.raises(ValueError, match="beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e9, -1e30])], schema), size=2)


def test_the_filter_is_a_lower_bound_and_spares_work():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 400, (8, 64)).round().astype(np.int64)
    v = (centre[rng.integers(0, 8, 3000)] + rng.normal(0, 60, (3000, 64))).round().astype(np.int64)
    mean = v.mean(axis=0)
    axes = np.linalg.eigh(np.cov(v.T.astype(float)))[1][:, ::-1][:, :8].copy()
    rotate = centroids.Rotation(mean, axes)
    cluster, distance, verified = centroids.nearest(v, *rotate(v.astype(float)), centre, rotate)
    all_d = ((v[:, None] - centre[None]) ** 2).sum(axis=2)
    assert (distance == all_d.min(axis=1)).all() and (cluster == all_d.argmin(axis=1)).all()
    assert verified < 1.5 * len(v)


# quality


def test_dual_descent_reaches_the_least_objective():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 8))) for _ in range(60)]
    y = np.where(rng.random(60) < 0.3, -1.0, 1.0)
    at, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    x = rng.normal(size=len(at))
    w = quality.fit_dual(at, sizes, x, y, 30, cost=0.5, epochs=2000, tolerance=1e-6)
    dense = np.zeros((60, 31))
    dense[np.repeat(np.arange(60), sizes), at] = x
    dense[:, 30] = 1

    def objective(w):
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (dense @ w)).sum()

    plain = np.zeros(31)
    best = objective(plain)
    for t in range(1, 20_000):  # subgradient steps, strongly convex
        plain -= (plain - 0.5 * dense.T @ (y * (y * (dense @ plain) < 1))) / t
        best = min(best, objective(plain))
    assert objective(w) <= best + 1e-3


def test_ratios_and_places_by_hand():
    at, sizes, y = np.array([0, 1, 1, 2]), np.array([2, 1, 1]), np.array([1, 1, 0])
    r = quality.log_ratios(at, sizes, y, 4)
    one, zero = np.array([2, 3, 1, 1]), np.array([1, 1, 2, 1])
    assert np.allclose(r, np.log(one / one.sum()) - np.log(zero / zero.sum()))
    tokens = quality.Tokens()
    a = quality.places("one two", tokens)
    # 2 words, 1 pair, 1 shape (both are lower case), 1 pair of shapes
    assert len(a) == 5 and set(a) <= set(quality.places("zero one two", tokens))
    assert len(quality.places("", tokens)) == len(quality.places(None, tokens)) == 0


def test_curve_follows_the_margins():
    rng = np.random.default_rng(0)
    margins = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margins - 1)))).astype(int)
    slope, offset = quality.fit_curve(margins, y)
    assert abs(slope - 2) < 0.2 and abs(offset + 1) < 0.2
    assert quality.fit_curve(-margins, y)[0] == 0.0


def test_quality_on_labels_it_has_not_seen(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    again = {r["doc_id"]: r for r in quality.quality(docs, flipped).collect()}
    assert all(got[i]["score"] == again[i]["score"] for i in got), "a held-out label was used"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    seen = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    right = sum(g["predicted"] == q for g, q in seen)
    assert len(seen) > 50 and right >= 0.95 * len(seen)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (3, "other words"), (None, "plain words"), (4, "A!! " * 60_000), (5, "good text here"), (6, "B!! BAD!!")]
    docs = spark.createDataFrame([(i, t, 9, "s", 1) for i, t in rows], "doc_id long, text string, score int, predicted string, n int").repartition(2)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, 0), (6, None), (None, 0), (1, 1), (99, 0)], "doc_id long, quality int")
    found = quality.quality(docs, labels)
    assert sorted(found.columns) == sorted(["doc_id", "text", "n", "held_out", "score", "predicted"])
    got = found.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["text"] == "plain words"}) == 1
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_a_labelled_id_of_many_rows_gives_one_example(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(500)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "quality", examples=20)
    assert rows.count() <= 20 and rows.count() == rows.select("row").distinct().count()
