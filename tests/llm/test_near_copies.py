from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import near_copies, similar
from hearthgrid.llm.similar import shingle_sets
from hearthgrid.llm.words import mix
from tests.llm.helpers import ODD_ROWS, as_rows, documents, sentences, words
from tests.llm.test_simhash import plain_components
from tests.llm.test_similar import copies, plain_groups


def plain_code(hashes):
    bits = 0
    for i in range(near_copies.PRINT_LONGS):
        salted = [int(h) for h in mix(hashes + np.uint64(i))]
        for b in range(64):
            bits |= (sum(h >> b & 1 for h in salted) * 2 > len(salted)) << (64 * i + b)
    return bits


def plain_near_groups(rows, radius, similarity=0.8, width=5):
    """The least key of each row's group: codes within the radius, and the similarity."""
    bodies = sorted({tuple(words(r[1])) for r in rows})
    sets = {b: shingle_sets([" ".join(b)], width)[1] for b in bodies}
    codes = {b: plain_code(s) for b, s in sets.items()}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        near = (codes[a] ^ codes[b]).bit_count() <= radius
        return both and near and both >= similarity * len(np.union1d(sets[a], sets[b])) - 1e-9

    group = plain_components(bodies, linked)
    least = {}
    for r in rows:
        if r[0] is not None:
            g = group[tuple(words(r[1]))]
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], least.get(group[tuple(words(r[1]))])) for r in rows), key=str)


def found(df, **options):
    got = near_copies.near_copies(df, **options).select("doc_id", "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("radius, rounds, tiles", [(near_copies.RADIUS, 2, (32_768, 65_536)), (10, 0, (7, 9)), (10, 2, (7, 9))])
def test_groups_are_of_near_codes_and_similar_sets(spark, monkeypatch, radius, rounds, tiles):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies.near_pairs, "__defaults__", tiles)
    rows = copies(3) + ODD_ROWS
    expected = plain_near_groups(rows, radius)
    if radius == near_copies.RADIUS:
        assert expected == plain_groups(rows)
    else:
        # The code decides as well: some similar texts are farther apart than ten bits.
        assert len({r[1] for r in expected}) > len({r[1] for r in plain_groups(rows)})
    assert found(documents(spark, rows).repartition(4), radius=radius) == expected


def test_stage_takes_its_pairs_from_simhash(spark, folder, monkeypatch):
    """Without near codes the stage links no texts of different words."""
    rows = copies(4)
    bodies = {tuple(words(r[1])) for r in rows}
    assert len(plain_groups(rows)) > len({g for _, g in plain_groups(rows)})
    defaults = near_copies.without_near_copies.__defaults__
    monkeypatch.setattr(near_copies.without_near_copies, "__defaults__", (*defaults[:-1], -1))
    kept = corpus_pipeline.keep_one_of_each_group(spark, documents(spark, rows), folder)
    assert kept.count() == len(bodies)


def test_one_python_worker_for_each_task(spark):
    """Steps that follow each other inside a task would each hold a worker of its own."""
    df = documents(spark, as_rows(sentences(20, 4)))
    prints = near_copies.text_prints(df, "doc_id", "text", 5)
    wanted = prints.select("print").distinct()
    for found in (prints, similar._sets(df, "text", 5, wanted.localCheckpoint())):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") + plan.count("EvalPython") == 1, plan


def test_the_map_has_the_bits_of_its_prints(spark):
    made = similar.bodies([*sentences(50, 7), "", None, "A b", "a B"])
    assert made[-4] == made[-3] and made[-2] == made[-1]
    known = similar._print_map(spark.createDataFrame([(p,) for p in made], "print binary"))
    bit = similar._print_bits(made)
    assert (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).all()
    assert np.unpackbits(known).sum() == len(set(bit.tolist()))


def side(sets):
    """A block's side of some sets of hashes, as tasks read it."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    n = np.array([len(s) for s in sets], np.int64)
    return near_copies.side_of({
        "print": mix(np.arange(2 * len(sets), dtype=np.uint64) + n.sum().astype(np.uint64)).tobytes(),
        "label": np.arange(len(sets)).tobytes(),
        "n": n.tobytes(),
        "code": near_copies.set_fingerprints(doc, hashes, len(sets)).tobytes(),
        "bits": b"".join(near_copies.parity_maps(doc, hashes, len(sets))),
        "shingles": hashes.tobytes(),
    })


def hash_sets(sizes, seed):
    draw = np.random.default_rng(seed)
    return [np.unique(draw.integers(0, 1 << 63, n, np.uint64)) for n in sizes]


def pairs_of(own, other, radius=128):
    found = near_copies.block_pairs(own, other, radius, 0.8, True, 0)
    return {(int(a), int(b)) for i, j in found for a, b in zip(np.broadcast_to(i, len(j)), j, strict=True)}


def test_maps_of_long_texts_rule_out_unrelated_ones():
    """With maps of 512 bits for all, every such pair of 1,500 runs and more was verified."""
    sizes = [40, 500, 520, 1500, 1600, 2040, 2060, 9000]
    own = hash_sets(sizes, 1)
    unrelated = hash_sets([n + n // 50 for n in sizes], 2)
    # Of each size class and across the lengths of maps: some hashes less, as many new ones.
    alike = [np.unique(np.concatenate([s[: len(s) - len(s) // 12], u[: len(s) // 12 + 1]])) for s, u in zip(own, unrelated, strict=True)]
    found = pairs_of(side(own), side([*unrelated, *alike]))
    for i, s in enumerate(own):
        for j, t in enumerate([*unrelated, *alike]):
            both = len(np.intersect1d(s, t))
            if len(s) < len(t):
                assert ((i, j) in found) == (both >= 0.8 * len(np.union1d(s, t)))
    assert {(i, len(own) + i) for i in range(len(own))} <= found


def test_maps_of_two_lengths_are_compared_at_the_shorter():
    small, more = hash_sets([1000, 100], 3)
    large = np.union1d(small, more)
    a, b = side([small]), side([large])
    assert (a["at"][1], b["at"][1]) == (1024 // 64, 2048 // 64)
    for own, other in ((a, b), (b, a)):
        bits = int(near_copies.differing_bits(own, 0, other, np.array([0]))[0])
        assert 0 < bits <= 100 and bits % 2 == 0


def test_pairs_within_a_block_are_decided_by_their_sets():
    base = hash_sets([400], 5)[0]
    # 0.82 to the first, less among each other; one is too far from all.
    near = [np.delete(base, np.arange(k, k + 72)) for k in (0, 100, 200)]
    far = np.delete(base, np.arange(300, 400))
    own, other = side([far, *near]), side([base])
    given = [(np.array([i]), np.array([0])) for i in range(4)]
    found = [(int(i[0]), int(j[0])) for i, j in near_copies.similar_pairs(iter(given), own, other, 0.8)]
    # Labels 0 of both sides are one, so the far one is left out, as pairs of one label are.
    assert found == [(1, 0), (2, 0), (3, 0)]
    own["label"] = own["label"] + 10
    assert [int(i[0]) for i, _ in near_copies.similar_pairs(iter(given), own, other, 0.8)] == [1, 2, 3]
    # What is linked already is not linked again.
    assert len(list(near_copies.similar_pairs(iter(given * 2), own, other, 0.8))) == 3


def test_blocks_are_not_shuffled_for_the_blocks_they_meet(spark):
    """Each met block took a copy of all its rows through a shuffle."""
    df = documents(spark, as_rows(sentences(200, 9)))
    prints = near_copies.text_prints(df, "doc_id", "text", 5)
    rows = prints.where("n > 0").dropDuplicates(["print"]).withColumn("label", F.xxhash64("print")).localCheckpoint()
    met = near_copies.near_pairs(rows, near_copies.RADIUS, 0.8, True, 0, 7, 9)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "CartesianProduct" in below and "Exchange" not in below and "Repartition" not in below
    # Each row is stored once for either side, however many blocks there are.
    blocks = near_copies.size_blocks(rows, 7, 9).selectExpr("own", "length(n) div 8 as n").groupBy("own").sum("n").collect()
    assert sorted(tuple(b) for b in blocks) == [(False, rows.count()), (True, rows.count())]
