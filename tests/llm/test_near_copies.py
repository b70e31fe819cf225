"""Near copies against all pairs found by brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from folioflow.llm import common, near_copies, simhash
from folioflow.llm.common import table


def groups_by_brute_force(texts):
    """For each text the smallest number of its component; every pair of texts is compared."""
    sets, known = [near_copies.shingles(t) for t in texts], near_copies._Hashes()
    fps = [simhash.majority(h) if len(h := near_copies.hashes(t, known)) else 0 for t in texts]
    fits = lambda a, b: 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))
    close = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if texts[a] == texts[b] or close(a, b) or (fits(a, b) and near_copies.near(sets[a], sets[b]))]
    up = list(range(len(texts)))
    for _ in texts:
        before = list(up)
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    return up, pairs


def survivors(rows):
    """Ids that stay of rows (id, text) with ids apart: the smallest of each component."""
    rows = sorted(rows)
    up, _ = groups_by_brute_force([(t or "").encode() for _, t in rows])
    return sorted({rows[k][0] for k in up})


def test_no_near_copy_stays(spark):
    """Copies with 1 to 12 changed words, chains of them, short texts, equal texts, null ids and repeated rows."""
    rows, doc = [], 0
    for base in range(12):
        words = [f"w{base}x{k * 7919 % 211}" for k in range(160)]
        for step in range(13):
            rows.append((doc, " ".join(words[: 12 * 13 - 12 * step] + [f"new{base}{k}" for k in range(step)] + words[12 * 13 - 12 * step :])))
            doc += 1
    shared = " ".join(f"common{k}" for k in range(40))
    rows += [(doc + k, f"{shared} {' '.join(f'own{k}y{j}' for j in range(3 + k))}") for k in range(40)]
    rows += [(900, "one two"), (901, "ONE two"), (902, "one three"), (903, ""), (904, None), (905, " "), (906, "one  two"), (900, "one two")]
    rows = sorted(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "only without id")], "doc_id long, text string")
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in near_copies.one_of_each(docs).collect())
    up, pairs = groups_by_brute_force([(t or "").encode() for _, t in rows])
    assert len(pairs) > 300 and kept == [-1] + sorted({rows[k][0] for k in up})
    # SimHash alone leaves such pairs
    assert any((simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() > simhash.RADIUS for a, b in pairs if rows[a][1] and rows[b][1])
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_a_large_group_is_not_paired_out(spark):
    """Copies of one text with 1 to 6 changed words each, most of them not near each other: none is lost, few are compared."""
    rng, base = random.Random(5), [f"b{k}" for k in range(160)]
    rows = []
    for doc in range(240):
        words = list(base)
        for k in rng.sample(range(4, 156), 1 if doc % 8 == 0 else rng.choice((2, 4, 5, 6))):
            words[k] = f"own{doc}x{k}"
        rows.append((doc, " ".join(words)))
    met, verified = [], near_copies._verified
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_copies, "_verified", lambda pairs, *more: (met.append(pairs.distinct().count()), verified(pairs, *more))[1])
        kept = sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == survivors(rows) and 50 < len(kept) < 200
    assert met[-1] < 3 * len(rows)  # the last step; the steps before meet one head a shingle


def test_texts_meet_wherever_they_are_near(spark):
    """What the last step pairs, without links known before, holds every near pair; once each."""
    rng, known, rows, sets = random.Random(11), near_copies._Hashes(), [], []
    for doc in range(150):
        words = [f"c{doc % 3}x{k}" for k in range(rng.choice((30, 90, 100)))]
        for k in rng.sample(range(len(words)), rng.randrange(4)):
            words[k] = f"own{doc}x{k}" if rng.random() < 0.6 else f"shared{rng.randrange(3)}"
        h = np.unique(near_copies.hashes(" ".join(words).encode(), known))
        sets.append(set(h.tolist()))
        order = sorted(h.tolist(), key=lambda x: (x % 5, x))
        rows += [(x - 2**63, doc, len(h), at, doc) for at, x in enumerate(order[: len(h) + 1 + (-4 * len(h) // 5)])]
    rest = common.materialise(spark.createDataFrame(rows, "token long, copy long, n int, at int, root long"))
    for first in (near_copies.FIRST, 2):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_copies, "FIRST", first)
            met = [tuple(r) for r in near_copies._meetings(rest).collect()]
        near = {(a, b) for b in range(150) for a in range(b) if near_copies.near(sets[a], sets[b])}
        assert len(near) > 100 and near <= set(met) and (first == 2 or len(met) == len(set(met)))


def test_columns_with_clashing_names_stay(spark):
    """Columns named as those inside the operator, repeated rows, null ids; and the way without broadcasts."""
    names = "id copy fp part task counts n key none root token first u v _id _copy _key _gone_id".split()
    texts = ["a b c d e f g", "a b c d e f g", "other words that stand alone here", None, "", "x y z"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)] + [(5, "x y z", *[f"{n}5" for n in names])] * 3 + [(None, "x y z", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    want = {0: texts[0], 2: texts[2], 3: None, 5: "x y z"}
    for bound in (near_copies.BROADCAST_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_copies, "BROADCAST_ROWS", bound)
            m.setattr(simhash, "BROADCAST_ROWS", bound)
            m.setattr(common, "BROADCAST_ROWS", bound)
            m.setattr(common, "HOT_ROWS", 2)
            out = near_copies.one_of_each(docs)
            got = out.collect()
        assert out.columns == docs.columns and {r.doc_id: r.text for r in got} == want and len(got) == 4
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def test_spread_joins_are_joins(spark):
    """Hot keys, keys without a partner, both ways."""
    left = common.materialise(spark.range(5000).selectExpr("id AS x", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN 8 ELSE id END AS k"))
    right = common.materialise(spark.range(0, 5000, 2).selectExpr("id AS k", "id * 10 AS y").where("k <> 8"))
    for how in ("inner", "left"):
        want = sorted((r.x, r.k, r.y) for r in left.join(right, "k", how).collect() if r.y is not None)
        lost = left.join(right, "k", how).where("y IS NULL").count()
        for bound in (common.BROADCAST_ROWS, 0):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(common, "BROADCAST_ROWS", bound)
                out = common.spread_join(left, right, "k", how)
                assert sorted((r.x, r.k, r.y) for r in out.collect() if r.y is not None) == want and out.where("y IS NULL").count() == lost


def test_pipeline_leaves_no_near_copy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    docs = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "/root/testdata/sf0.01")
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert len(texts) > 800 and groups_by_brute_force(texts)[1] == []


def test_marks_never_rule_out_near_copies():
    rng, known = random.Random(3), near_copies._Hashes()
    for n in (3, 10, 100, 2000):
        for _ in range(30):
            words = [f"w{rng.randrange(5 * n)}" for _ in range(n)]
            other = list(words)
            for _ in range(rng.randrange(1 + n // 20)):
                other[rng.randrange(n)] = f"x{rng.randrange(n)}"
            a, b = " ".join(words).encode(), " ".join(other).encode()
            one, two = (near_copies.marks_of(np.unique(near_copies.hashes(t, known))) for t in (a, b))
            assert near_copies.plausible(one, two) or not near_copies.near(near_copies.shingles(a), near_copies.shingles(b))
    strangers = [near_copies.marks_of(np.unique(near_copies.hashes(" ".join(f"{k}y{j}" for j in range(300)).encode(), known))) for k in (1, 2)]
    assert not near_copies.plausible(*strangers)
