"""The text operators against brute force, the libraries themselves, and inputs with holes."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from adloom.llm import chunk_bpe, components, jaccard, langid, neighbours, packing, quality, substring, token_counts, toxicity, warc
from adloom.llm.queries import VOCABULARY
from adloom.llm.work import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids_sha256 string, component_id long, kept boolean, start int"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def documents():
    base, passage = prose(150), prose(60)
    near = base.split()
    near[70] = "changed"
    texts = [base, base, " ".join(near), None, "", "one", "two words", prose(90) + " " + passage + " " + prose(30), passage + "\n" + prose(80),
             "it " * 300, "x" * 20_000, prose(6_000), "Ünï <|endoftext|> DON'T 漢字 \x1c ﬁ İ " * 3, " \t\n", base.upper()]
    for _ in range(25):  # copies that are more and more different
        w = rng.choice([base, passage + " " + base]).split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(None, base, None, None, None)]


ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "clash", 7, True, 1) for r in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, none, library):
    got = by_id(token_counts.token_counts(docs, VOCABULARY))
    for i, text, *_ in ROWS:
        n = len(ids_of(library, text))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0


def test_chunk_reuse_round_trip(docs, none, library):
    got = by_id(chunk_bpe.digests(docs, VOCABULARY))
    small = by_id(chunk_bpe.encode(docs, VOCABULARY, bits=2))
    back = by_id(chunk_bpe.decode(chunk_bpe.encode(docs, VOCABULARY), VOCABULARY))
    for i, text, *_ in ROWS:
        ids = ids_of(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert small[i].ids == ids and back[i].text == decoded
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert chunk_bpe.digests(none, VOCABULARY).count() == 0


def test_equal_chunks_are_encoded_once():
    coder = chunk_bpe.ChunkIds(VOCABULARY)
    text = prose(3_000).encode()
    coder.encode([text])
    before = coder.encoded
    coder.encode([b"another start " + text])
    assert coder.encoded - before <= 3 and coder.reused > 10


def check_packing(pieces, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        for p in own:
            part = np.array(ids[doc][p.start:p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32 and p.doc_tokens == len(ids[doc]) == sum(x.length for x in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1]) and sum(p.length for p in own) <= 2048
    return by_doc, by_sequence


def test_packing(docs, none, library):
    ids = {i: ids_of(library, t) + [1] for i, t, *_ in ROWS}
    by_doc, by_sequence = check_packing(packing.pack(docs, VOCABULARY).collect(), ids)
    assert set(by_doc) == set(ids)
    assert sum(sum(p.length for p in s) < 2048 for s in by_sequence.values()) <= 3  # one a partition
    assert packing.pack(none, VOCABULARY).count() == 0


def test_levels_choose_the_smallest_sum_of_squares():
    levels, r = packing.Levels(16), random.Random(1)
    for _ in range(300):
        size = r.randint(1, 15)
        counts = levels.counts.copy()
        options = {}
        for h in [0] + [h for h in range(1, 16) if counts[h] and h + size <= 16]:
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            options[h] = int((c[1:16] ** 2).sum())
        best = min(options.values())
        assert levels.choose(size) == max(h for h, v in options.items() if v == best)
        levels.place((1, 0, b"\0\0\0\0" * size, size))


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard(docs, none, k, percent):
    named = [r for r in ROWS if r[0] is not None]
    got = by_id(jaccard.jaccard_join(docs, k, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == brute_components(named, k, percent)
    assert got[None].component_id is None
    if k == 5:
        kept = jaccard.first_of_group(docs.union(docs.filter("doc_id = 0")), k, percent)
        want = {c for _, c in brute_components(named, k, percent).values()}
        assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(want) and kept.columns == docs.columns
        assert jaccard.jaccard_join(none, k, percent).count() == 0


def test_every_linked_pair_shares_a_signature():
    r = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (4, 9, 10, 11, 19, 40, 130, 700):
            for _ in range(12):
                a = r.integers(0, 2**63, n).astype(np.uint64)
                keep = -(-2 * n * percent // (100 + percent))
                b = np.concatenate([a[:keep], r.integers(0, 2**63, n - keep).astype(np.uint64)])
                for x, y in ((a, b), (a, a[: -(-n * percent // 100)])):
                    x, y = np.unique(x), np.unique(y)
                    if jaccard.linked(x, y, percent) and len(np.setxor1d(x, y)):
                        s, t = jaccard.signatures([x, y], percent)
                        assert len(np.intersect1d(s, t)), (percent, n)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 90)] + [(200, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Steps(spark, "test"))
    assert {r.node: r.comp for r in got.collect()} == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 90)}}


def brute_substring(rows, n=20):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])}
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - n + 1):
            key = tuple(w[p:p + n])
            if key in first:
                gone |= set(range(p, p + n))
            else:
                first[key] = (i, p)
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def test_substring(docs, none):
    want = brute_substring(ROWS)
    got = by_id(substring.dedup_digests(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items() if i is not None} == {i: w[:3] for i, w in want.items()}
    assert got[None].n_removed == 0
    cut = by_id(substring.dedup_texts(docs))
    for i, text, *_ in ROWS[:-1]:
        assert cut[i].text == (text if not want[i][1] else " ".join(want[i][3]))
    assert substring.dedup_texts(docs).columns == docs.columns and substring.dedup_digests(none).count() == 0


def test_quality_rules(spark, docs, none):
    good = "\n".join(prose(12) + "." for _ in range(10))
    menu = "\n".join(" | ".join(rng.choice(VOCAB) for _ in range(9)) for _ in range(20))
    rows = [(0, good), (1, menu), (2, good + "\nLicensed under the Apache License."), (3, good + "\n" + menu), (4, None), (5, prose(10)), (6, "so it is " * 40)]
    got = by_id(quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].kept for i in range(7)] == [True, False, True, False, False, False, False]
    assert [got[i].base_failed for i in range(7)] == [False, False, False, False, True, True, True]
    assert got[2].clean_text == good and got[6].n_repeat_words == 120 and got[3].lost_words == 20 * 17
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r.doc_id for r in quality.clean_lines(docs).filter("kept").collect()}
    assert quality.clean_lines(none).count() == 0


def test_languages(spark):
    near = {"aa": "the and of to in that was with", "bb": "der die und nicht ein auch schön für"}
    rows = [(i, " ".join(rng.choice(near[n].split()) for _ in range(40)), n, None) for i in range(200) for n in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows + [(900, None, "aa", None), (901, "12 34", "bb", None), (None, "the of", None, None)], "doc_id long, text string, lang string, score string")
    got = by_id(langid.language_id(df))
    assert all(got[i].lang_pred == n and 0 <= got[i].score <= 1 for i, _, n, _ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert langid.language_id(df.filter("doc_id = -1")).count() == 0


def test_toxicity_chain(spark, docs):
    rows = [(i, prose(60) + (" vile filth scum" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(df, labels))
    held = [i for i in range(1, 400, 2)] + [i for i in range(0, 400, 4)]
    right = [got[i].toxic == (i % 4 == 0) for i in held]  # 200 labelled texts of 60 random words: not all are sure
    assert sum(right) >= 0.95 * len(right), sum(right) / len(right)
    assert {r.doc_id for r in toxicity.keep_clean(df, labels).collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.toxicity(df.filter("doc_id = -1"), labels).count() == 0
    assert toxicity.toxicity(docs, labels.filter("doc_id = -1")).count() == len(ROWS)


def test_neighbours_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 16))
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x.astype(np.float32))]
    odd = [(1000, None, 1.0), (1020, [0.0] * 16, 1.0), (1040, [float("nan")] + [1.0] * 15, 1.0), (1060, [None] + [1.0] * 15, 1.0), (1080, [1.0], 1.0), (None, [1.0] * 16, 1.0)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, score double").repartition(3)
    got = collections.defaultdict(list)
    for row in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    v = x.astype(np.float32).astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        score = (v * v[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        hits += len(set(best) & {f[1] for f in found})
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and all(abs(score[i] - s) < 1e-9 for _, i, s in found)
        assert [f[1] for f in found] == [i for _, i in sorted((-s, i) for _, i, s in found)]
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest(df.filter("vec_id = -1")).count() == 0


def test_warc_round_trip(spark):
    big, small = "<p>" + "é" * 200 + "</p>\r\n\r\nWARC/1.1\r\n", "tiny"
    rows = [(3, "http://a\r\nX: y", big), (1, None, big), (2, "u", small), (5, "u", small), (7, "u", None), (9, "u", prose(50_000)), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {3: ("revisit", 1), None: ("revisit", 1)}
    assert warc.archive_pages(pages.filter("page_id = -1")).count() == 0


def test_whole_file_and_member_gzip_are_read_alike(tmp_path):
    made = [warc.response(i, "u", p, hashlib.sha256(p).hexdigest()) for i, p in enumerate([b"", b"a\r\n\r\nb", b"x" * 500_000])]
    for name, data in (("whole", gzip.compress(b"".join(made))), ("members", b"".join(map(gzip.compress, made)))):
        (tmp_path / name).write_bytes(data)
        assert list(warc.records(str(tmp_path / name))) == made


def test_pipeline_stages(spark, tmp_path, library):
    good = ["\n".join(prose(14) + "." for _ in range(8)) for _ in range(30)]
    texts = good + [g + " vile filth scum." for g in good[:8]] + ["\n".join([good[3], "A last line that is new here."])] + ["| " * 200]
    passage = prose(55) + "."
    texts += [prose(60) + ".\n" + passage + "\n" + prose(60) + "." for _ in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("|" not in t), int("vile" in t)) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = [r for r in rows if "vile" not in r[1] and "|" not in r[1]]
    groups = brute_components(left, 5, 80)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    cut = brute_substring(left)
    ids = {i: ids_of(library, " ".join(cut[i][3])) + [1] for i, *_ in left}
    by_doc, _ = check_packing(corpus_pipeline.run(spark, folder).collect(), ids)
    assert set(by_doc) == set(ids)


def test_warc_repeated_page_id_keeps_its_other_payload(spark):
    """Page 7 twice: payload X (also page 3's) and payload Y (only here). Only the X record revisits page 3."""
    x, y = "x" * 300, "y" * 300
    pages = spark.createDataFrame([(3, "https://a.org/3", x), (7, "https://a.org/7", x), (7, "https://a.org/7b", y)],
                                  "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_pages(pages).collect())
    dx, dy = hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(y.encode()).hexdigest()
    assert got == sorted([(3, 300, "response", None, dx), (7, 300, "revisit", 3, dx), (7, 300, "response", None, dy)])


def test_substring_repeated_doc_id_keeps_its_own_factors(spark):
    """doc 1 = A (30 words); doc 5 twice, once A and once other words B: only the A row of doc 5 loses words."""
    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_digests(docs, window=20).collect())
    assert got == [(1, 30, 0), (5, 30, 30), (5, 40, 0)]
    clash = docs.withColumn("_doc", F.lit(1)).withColumn("_found", F.lit("x"))
    texts_ = sorted((r.doc_id, len(r.text.split()) if r.text else 0, r._doc, r._found) for r in substring.dedup_texts(clash, 20).collect())
    assert texts_ == [(1, 30, 1, "x"), (5, 0, 1, "x"), (5, 40, 1, "x")]


def test_looked_up_windows_carry_no_text_marks(spark):
    """The mark of a row goes through every shuffle of the windows: a fixed 8 bytes, and still one per text."""
    a, b = prose(40), prose(40)
    docs = spark.createDataFrame([(1, a + " " + b), (2, a), (2, b + " tail"), (2, None)], "doc_id long, text string")
    found = substring.duplicate_factors(docs, 20)
    assert dict(found.dtypes)["fp"] == "bigint"
    got = {(r.doc_id, r.fp): [tuple(f) for f in r.found] for r in found.collect()}
    marks = {r.text: r.fp for r in docs.select("text", substring.fingerprint(F.col("text")).alias("fp")).collect()}
    assert got == {(2, marks[a]): [(0, 40, 1)], (2, marks[b + " tail"]): [(0, 40, 1)]}


def test_toxicity_without_labels_keeps_every_row(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "z z z"), (2, "d e")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.p_toxic, r.toxic) for r in toxicity.toxicity(docs, none).collect()) == [(1, None, False), (1, None, False), (2, None, False)]
    assert toxicity.keep_clean(docs, none).count() == 3


def test_first_of_group_keeps_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text, 7, 8)], "doc_id long, text string, _other int, _rank int")
    assert [(r.doc_id, r._other, r._rank) for r in jaccard.first_of_group(docs).collect()] == [(1, 5, 6)]


def test_jaccard_refuses_thresholds_it_cannot_keep_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    for bad in (50, 75, 100):
        with pytest.raises(ValueError, match="lose no link"):
            jaccard.jaccard_join(docs, 3, bad)
