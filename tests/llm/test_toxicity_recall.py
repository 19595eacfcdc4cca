"""The toxicity chain on labelled rows fewer than words: rare telling words must be learnt, not the noise around them."""

import numpy as np

from adloom.llm import toxicity


def corpus(count: int) -> list[tuple[int, str, int]]:
    """One text in eight is toxic; it holds one or two of twelve insults, in up to 300 invented words."""
    r = np.random.default_rng(11)
    parts = ["ba", "do", "ki", "lu", "me", "no", "pra", "ste", "vi", "zo"]
    rows = []
    for i in range(count):
        words = ["".join(r.choice(parts, r.integers(2, 4))) for _ in range(r.integers(20, 300))]
        for n in r.choice(12, r.integers(1, 3), replace=False) if i % 8 == 0 else []:
            words.insert(int(r.integers(0, len(words))), "gruff" + "abcdefghijkl"[n])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    return rows


def test_rare_insults_are_caught_in_unlabelled_texts(spark):
    rows = corpus(2_400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 1_600], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.keep_clean(docs.filter("doc_id >= 1600"), labels.limit(0)).collect()}
    assert kept == set(range(1_600, 2_400))
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    toxic = [i for i, _, y in rows if y and i >= 1_600]
    clean = [i for i, _, y in rows if not y and i >= 1_600]
    assert sum(i not in kept for i in toxic) >= 0.9 * len(toxic)
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_words_without_effect_weigh_nothing(spark):
    rows = corpus(1_600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    insults = {f for c in "abcdefghijkl" for f in toxicity.features(f"gruff{c}".encode())}
    assert insults <= set(chain.columns.tolist())
    assert len(chain.columns) < 100  # of about 1,100 words
