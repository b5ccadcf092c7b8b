"""The SimHash index of the pipeline's near-duplicate stage."""

from __future__ import annotations

import random

from helixplan.llm import near_copies as N


def test_fingerprints_tie_what_min_hashes_miss(spark):
    rng, texts = random.Random(4), []
    for base in range(16):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        copy = list(words)
        copy[rng.randrange(1500)] = f"new{base}"
        texts += [" ".join(words), " ".join(copy)]
    sets = [N.shingle_set(t) for t in texts]
    near = {i for i in range(0, 32, 2) if bin((N.set_print(sets[i]) ^ N.set_print(sets[i + 1])) & (2**64 - 1)).count("1") <= 2}
    # One segment of 900 min-hashes leaves most of these pairs without a shared variant.
    by = N._multipliers(900)
    met = {i for i in range(0, 32, 2) if set(N.variants(N.signature(sets[i], by), 1).tolist()) & set(N.variants(N.signature(sets[i + 1], by), 1).tolist())}
    assert len(near - met) > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(docs, segments=1, width=900).collect()}
    assert got == {i + d: i for i in near | met for d in (0, 1)}
