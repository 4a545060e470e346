"""One document of each group, where ids do not tell groups apart."""

import random

import pytest
from pyspark.sql import functions as F

from edgewise.llm import grammar, imatch, sharding, simhash, toxicity
from edgewise.plans.scratch import Scratch


def _text(seed):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=60))


def test_unlinked_texts_with_null_or_equal_ids_all_stay(spark):
    a, b, c, d, e = map(_text, range(5))
    # a and b: no id; c and d: one id; e: two rows, one without an id; f: equal rows
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, e), (None, e), (11, _text(5)), (11, _text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, c), (7, d), (9, e), (11, _text(5))], key=str)


def test_linked_texts_without_ids_leave_one(spark):
    copies = [(None, _text(1))] * 3 + [(None, _text(1).upper())]
    docs = spark.createDataFrame([*copies, (None, _text(2))], "doc_id long, text string")
    assert len({r["text"].lower() for r in simhash.one_of_each(docs).collect()}) == simhash.one_of_each(docs).count() == 2


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_links_are_those_of_the_radius(spark, radius, hot):
    """Crowded values and plain probes against all pairs, for every radius that is taken."""
    import random

    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(12)}
    for p in list(prints):
        for _ in range(4):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 6)):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    groups = simhash.plan(simhash.bit_counts(df), len(signed), radius)
    found = simhash.links(df, groups, radius, hot, Scratch(spark, "t")).collect()

    def parts(edges):
        low = {p: p for p in signed}
        for _ in signed:
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        return low

    due = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius]
    assert parts([(r["src"], r["dst"]) for r in found]) == parts(due)


def test_a_larger_radius_is_refused(spark):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), [(list(range(64)), 5)], 5, 10, None)


def test_short_formats_and_the_rest_of_a_run_are_scored():
    values = [f"q{i % 10}Z-{(i * 37) % 1000:03d}k{i % 7}" for i in range(60)]  # 9 characters
    automaton = grammar.Automaton(values).merge()
    plain = grammar.Words({})
    scanner = grammar.Scanner({"assign": automaton}, plain, min(map(len, values)), grammar.THRESHOLD)
    found = scanner.spans("see q3Z-111k2 there")[1]
    assert found == [(4, 13, "assign")]
    # a credential joined to a base span by a mark of its own
    text = "AKIA" + "A" * 16 + "/q5Z-185k5"
    base, spans = scanner.spans(text)
    assert [x[2] for x in base] == ["access"] and (0, 20, "access") in spans
    assert all(a >= 20 for a, _, k in spans if k == "assign")


def test_texts_outside_of_the_band_differ(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "epsilon"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, parts=2).collect()}
    assert len({got[i] for i in (1, 2, 3)}) == 3 and got[4] == got[5] != got[1]


def test_shards_of_a_key_named_like_a_result(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(9000)], "bytes long, cell long")
    got = sharding.extendible_shards(rows, ["bytes", "cell"], F.lit(10), 1000)
    assert got.columns == ["key_bytes", "cell", "bytes", "depth", "shard", "shard_bytes"] and got.count() == 9000
    one = sharding.extendible_shards(rows.selectExpr("1L as bytes"), ["bytes"], F.lit(10), 50).groupBy("shard", "shard_bytes").count().collect()
    assert sum(r["count"] for r in one) == 9000 and all(r["shard_bytes"] == 10 * r["count"] <= 50 for r in one)


def test_a_labelled_id_of_many_rows_is_one_example(spark):
    docs = spark.createDataFrame([(1, f"bad word {i}") for i in range(300)] + [(i, "fine text") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).groupBy("is_toxic").count().collect()
    assert sum(r["count"] for r in got) == 358


def test_a_joined_lexicon_gives_the_same_rows(spark, monkeypatch):
    from edgewise.llm.base import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (None, "odd words"), (5000, "")], docs.schema))
    sent = sorted(map(tuple, imatch.fingerprints(docs, parts=4).collect()), key=str)
    monkeypatch.setattr(imatch, "MAX_TERMS", 0)
    assert sorted(map(tuple, imatch.fingerprints(docs, parts=4).collect()), key=str) == sent and len(sent) == 203


def test_fingerprints_equal_a_plain_version(spark):
    """Frequencies, edits and signatures in plain loops over all documents."""
    import hashlib
    import math
    from collections import Counter

    import numpy as np

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(60)], k=rng.randint(0, 40))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = Counter(t for text in texts for t in imatch.terms_of(text).tolist())
    n = len(texts)
    band = {t for t, c in df.items() if n * math.exp(-imatch.HIGH_IDF) <= c <= n * math.exp(-imatch.LOW_IDF)}
    printer = imatch.Printer(np.array(sorted(band), np.uint64), imatch.SUBSETS)

    def signature(text):
        terms = [t for t in sorted(set(imatch.terms_of(text).tolist()))]
        chosen = [t for t in terms if t in band] or terms
        if not chosen:
            return (0, [[0] * imatch.SUBSETS for _ in range(imatch.LEVELS)])
        level = max(1, round(math.log2(len(chosen) / imatch.SHARE)))
        out = [[0] * imatch.SUBSETS for _ in range(imatch.LEVELS)]
        for s in range(imatch.SUBSETS):
            for t in chosen:
                drawn = imatch.mix(np.array([t], np.uint64) ^ printer.salts[s])
                for i in range(imatch.LEVELS):
                    if int(drawn[0]) >> (64 - level - i) == 0:
                        out[i][s] = (out[i][s] + (int(imatch.mix(drawn)[0]) | 1 << 40)) & (1 << 64) - 1
        return (level, [[h & 0xFFFFFF | (1 << 24 if h else 0) for h in row] for row in out])

    def shown(signed):
        return f"{signed[0]:02d}:" + "".join(f"{h & 0xFFFFFF:06x}" if h else "------" for row in signed[1] for h in row)

    got = {r["doc_id"]: r for r in imatch.fingerprints(docs, parts=3).collect()}
    for i, text in enumerate(texts):
        following = texts[i - 1]  # descending order; after 0 comes the last
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, theirs = map(signature, (text, edited, following))
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (shown(own), shown(changed))
        for name, other in (("near_edited", changed), ("near_next", theirs)):
            assert got[i][name] == imatch.likeness(*((s, np.array(h, np.uint64)) for s, h in (own, other)))
