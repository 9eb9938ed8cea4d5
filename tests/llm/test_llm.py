"""Operators against brute force and the public libraries, and the cases each of them defines."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.llm import ann, bpe, fingerprint, jaccard, license, packing, quality, toxicity, url_filter, warc
from riskflow.llm.common import cut_points, held_out, materialize, range_of, remove, scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 5003} é{i}" for i in range(60_000))
TEXTS = [(1, "one two three four five six seven"), (2, "One, two; three four five six seven!"), (3, None), (4, ""), (None, "a b c"),
         (5, LONG), (6, LONG + " tail"), (7, "  \n"), (8, "<|endoftext|> x \x1c y"), (9, "a b c"), (9, "a b c")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns whose names operators use inside."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({"lang": F.lit("en"), "node": F.lit(1), "root": F.lit("x"), "score": F.lit(2), "th": F.lit(3), "_n": F.lit(4)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def test_search_finds_nearly_all_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 48)).astype(np.float32).astype(float)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3001, None), (3002, [0.0] * 48), (3003, [float("nan")] * 48), (3004, [None] * 48), (None, x[0].tolist()), (3005, [1.0, 2.0]), (3006, [])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    coded = ann.index(vectors)
    assert coded.count() == 3001
    got = ann.search(coded, coded.filter("vec_id % 20 = 0"), 20, row_block=700, query_block=40).toPandas()
    hits = 0
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(axis=1)
        ids = np.delete(np.arange(3000), q)
        best = ids[np.lexsort((ids, -score[ids]))][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, score[own.vec_id])
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.97 * 150 * 20
    assert got[got.query_id == 200].sort_values("rank").vec_id.tolist() == [i for i in range(100, 121) if i != 200][:20]
    assert ann.search(coded, coded.filter("vec_id = 3005"), 20).count() == 0
    assert ann.search(ann.index(vectors.limit(0)), coded, 20).count() == 0


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_score_every_row(spark, docs, none, module, label):
    sf = "/root/testdata/sf0.1"
    known, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.fit(known, labels)
    got = module.score(known, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    rank = got.score.rank()
    ones, zeros = (got[label] == 1).sum(), (got[label] == 0).sum()
    assert (rank[got[label] == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > 0.8
    rows = module.score(docs, model, ("doc_id",)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 9}) == 1
    assert module.score(none, model).count() == 0
    untaught = module.fit(known, labels.limit(0))
    assert module.score(known.limit(5), untaught).count() == 5


def test_a_repeated_labelled_id_is_sampled_once(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id") % 10).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    marks = many.select("doc_id", F.lit(1).alias("quality")).distinct()
    rows = quality.labelled_sample(many, marks, "quality", 10_000)
    ids = [r.doc_id for r in rows.collect()]
    assert len(ids) == len(set(ids)) == marks.filter(~held_out(F.col("doc_id"))).count()
    first = lambda df: sorted((r.doc_id, r.text) for r in quality.labelled_sample(df, marks, "quality", 10_000).collect())
    assert rows.columns == ["doc_id", "text", "lang", "label"] and first(many) == first(many.repartition(5))


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EN.example.net/en/y?q", "http://example.com/de/", "http://notexample.com/de/", "http://x.org/fr/#a", "http://x.net",
            None, "", "no scheme", "http://a.b.example.net/fr/", "http://example.net/en", "x://é.net/", "http://net/", "a://b://c.net/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/"), (1, urls[1]), (1, urls[1])], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit(1), "top": F.lit(2), "key": F.lit(3), "part": F.lit(4)})
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.net/", "block"), ("example.net/en/y", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("bad", "block"), (None, "block")]

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
            host = lowered(host)
        fits = [(len(r), r, v) for r, v in rules if r and "/" in r for h in [r[:r.index("/")]]
                if (host == h or host.endswith("." + h)) and path.startswith(r[r.index("/"):])]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    table = spark.createDataFrame(rules, "rule string, verdict string")
    got = sorted((r.page_id is None, r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.filter("page_id is not null"), table).collect())
    assert got == sorted((False, r.page_id, *brute(r.url)) for r in pages.filter("page_id is not null").collect())
    assert url_filter.judge(pages, table).count() == len(urls) + 3
    assert {r.verdict for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_entropy_is_that_of_the_byte_counts():
    data = np.frombuffer(b"aaaaaaaaaaaaaaaabcdefghijklmnopqrstuvabababababababab the end", np.uint8)
    for s, e in enumerate(fingerprint.entropies(data)):
        p = np.bincount(data[s:s + 16]) / 16
        p = p[p > 0]
        assert abs(e - 1000 * -(p * np.log2(p)).sum() / 4) <= 1


def test_copies_on_two_sides_of_a_length_border_are_alike():
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"etaoinshrdlu cmfwyp ", np.uint8)
    for shorter, longer, least in ((250, 262, 0.6), (30, 34, 0.9), (255, 257, 0.7), (31, 32, 0.9), (200, 300, 0.5)):
        near, far = [], []
        for _ in range(30):
            text, other = (rng.choice(letters, longer).tobytes() for _ in range(2))
            copy, plain, strange = map(fingerprint.digest, fingerprint.features([text[:shorter], text, other]))
            back = fingerprint.from_text(fingerprint.text_form(copy))
            near.append(fingerprint.likeness(back, plain))
            far.append(fingerprint.likeness(copy, strange))
            assert near[-1] == pytest.approx(fingerprint.likeness(plain, copy))
        assert np.mean(near) > least and np.mean(far) < 0.1, (shorter, np.mean(near), np.mean(far))
    a, b = map(fingerprint.digest, fingerprint.features([b"abc", b""]))
    assert fingerprint.likeness(a, a) == 1.0 and fingerprint.likeness(a, b) == 0.0 and fingerprint.text_form(b) == "0:"


def test_only_texts_without_bytes_have_an_empty_digest():
    texts = [b"-" * 300, b"01" * 200, b"ab" * 150, b"abcdefghij" * 40, b"-" * 500, b"-" * 40, b"x", b""]
    made = [fingerprint.digest(f) for f in fingerprint.features(texts)]
    assert [fingerprint.text_form(m) == "0:" for m in made] == [False] * 7 + [True]
    for i in range(4):
        for j in range(8):
            same = i == j or {i, j} == {0, 4} or (i, j) == (0, 5)
            got = fingerprint.likeness(made[i], made[j])
            assert got == pytest.approx(1.0) if same else got < 0.2, (i, j, got)


def test_fingerprints_beside_the_next_document(spark, docs, none):
    rows = sorted(((d is None, d or 0, t or "") for d, t in TEXTS))
    texts = [t for _, _, t in rows]
    for size in (1, 1 << 30):
        got = fingerprint.compared(docs, size).collect()
        assert len(got) == len(TEXTS)
        assert sorted(r.edited_sha256 for r in got) == sorted(
            hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1]))
        own = {r.doc_id: r for r in got}
        assert own[5].near_next > 0.95 and own[3].near_next == 1.0 and own[4].fingerprint == "0:" and own[5].n_chars == len(LONG)
        assert len({r.fingerprint for r in got if r.doc_id == 9}) == 1
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert plain[5] == own[5].fingerprint and fingerprint.likeness(*[fingerprint.from_text(plain[5])] * 2) == 1.0
    assert fingerprint.compared(none).count() == 0 and fingerprint.compared(docs.filter("doc_id = 1")).count() == 1


def test_jaccard_classes_are_those_of_brute_force(spark, docs, none):
    base = [f"b{i}" for i in range(60)]
    many = [(100 + i, " ".join(base[:i % 60] + [f"new{i}"] + base[i % 60 + 1:])) for i in range(200)]
    rows = TEXTS + many
    got = jaccard.classify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1))).collect()

    def shingles(t):
        w = WORD.findall(lowered(t))
        return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w) or t or ""])

    sets = [shingles(t) for _, t in rows]
    distinct = list(dict.fromkeys(sets))
    links = {s: [o for o in distinct if o != s and len(s & o) >= 0.8 * len(s | o)] for s in distinct}
    expected = []
    for (d, _), s in zip(rows, sets):
        seen, stack = {s}, [s]
        while stack:
            for o in links[stack.pop()]:
                if o not in seen:
                    seen.add(o)
                    stack.append(o)
        ids = [x for (x, _), o in zip(rows, sets) if o in seen and x is not None]
        expected.append((d or 0, min(ids), len(links[s]), sets.count(s)))
    assert sorted((r.doc_id or 0, r.class_id, r.n_links, r.n_copies) for r in got) == sorted(expected)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9]
    assert jaccard.classify(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_least_matches_is_the_beta_posterior():
    for n in (32, 96):
        m = jaccard.least_matches(0.8, 1e-6, n)
        grid = np.linspace(0, 1, 200_001)
        tail = lambda k: (d := grid**k * (1 - grid) ** (n - k))[grid >= 0.8].sum() / d.sum()
        assert tail(m) >= 0.99e-6 and tail(m - 1) < 1.01e-6


def test_license_places(spark, none):
    texts = ["The MIT License, and the Apache-License", "general public license General Public License", "general public, license general", None, "", "mit", "LICENSED under the\nApache License, Version 2.0 é",
             "permission is hereby granted free of charge to any other person obtaining a copy of this software", "mit license " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (5, "mit"), (5, "mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit(1), "template": F.lit(2), "words": F.lit(3)})
    got = license.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id == 5:
            continue
        words = WORD.findall(lowered(texts[r.doc_id]))
        places = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "mit" and by[7].n_base == 0 and by[6].score == 1.0 and by[4].score == 0.0 and by[3].labels == ""
    assert license.scan(none).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-170, 1.0])
def test_search_finds_rows_of_any_size(size):
    hits = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(300, 32)) * (1e-175 if size == 1e-170 else 1.0)
        q = rng.normal(size=32)
        x[7] = q * size if size != 1e-170 else q / np.abs(q).max() * size
        codes, length, fit = ann.encode(x)
        found, score = ann.nearest(q, -1, np.arange(300), x, codes, length, fit, 5, ann.BOUND)
        best = np.lexsort((np.arange(300), -(x * q).sum(axis=1)))[:5]
        hits += len(set(found) & set(best))
        assert found[0] == 7 and np.array_equal(score, (x[found] * q).sum(axis=1))
    assert hits >= 95


def test_rows_that_repeat_go_to_different_blocks(spark):
    rows = [(1, [1.0, float(i)]) for i in range(3000)] + [(20, [0.0, 1.0])] + [(3, [0.0, 9000.0])] * 3
    coded = ann.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    got = ann.search(coded, coded.filter("vec_id = 20"), 4, row_block=100).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 9000.0)] * 3 + [(1, 2999.0)]


def plain_share(words, template, slack):
    """Largest share of the template's pairs in a window of diagonals, in the template's order."""
    pairs = list(zip(template, template[1:]))
    hits = [(p, t) for p in range(len(words) - 1) for t in range(len(pairs)) if (words[p], words[p + 1]) == pairs[t]]
    best = 0
    for low in {p - t for p, t in hits}:
        inside = sorted((p, t) for p, t in hits if low <= p - t <= low + slack)
        run = []
        for i, (p, t) in enumerate(inside):
            run.append(1 + max((run[j] for j in range(i) if inside[j][0] < p and inside[j][1] < t), default=0))
        best = max(best, *run)
    return best / len(pairs)


def test_license_labels_are_verified_in_order_and_templates_come_from_a_table(spark):
    long = " ".join(f"word{i * 7 % 300}" for i in range(300))
    bsd = next(p for p, n in license.NOTICES.items() if n == "bsd").split()
    pairs = [bsd[i:i + 2] for i in range(len(bsd) - 1)]
    texts = ["x " + " ".join(bsd), " ".join(w for p in reversed(pairs) for w in p), " ".join(w for p in pairs for w in p), long, " ".join(long.split()[40:]), " ".join(reversed(long.split())),
             " ".join(w for i, w in enumerate(long.split()) for w in ([w, "and"] if i % 40 == 7 else [w])), " ".join(bsd[:6] + ["z"] * 9 + bsd[6:]), "released under the old mit license", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(n, t) for t, n in license.NOTICES.items()] + [("long", long), ("long", long), ("short", "word"), (None, "a b"), ("none", None)], "label string, text string")
    for got in (license.scan(df, notices=table).collect(), license.scan(df, notices=table, sent_words=0).collect()):
        by = {r.doc_id: r for r in got}
        for i, text in enumerate(texts):
            shares = {n: plain_share(text.split(), t.split(), max(license.SLACK, len(t.split()) // license.SLACK_WORDS)) for t, n in [*license.NOTICES.items(), (long, "long")]}
            base = {n for p, n in license.BASE.items() if p in text}
            assert set(filter(None, by[i].labels.split(","))) == base | {n for t, n in [*license.NOTICES.items(), (long, "long")] if plain_share(
                text.split(), t.split(), max(license.SLACK, len(t.split()) // license.SLACK_WORDS)) >= license.LEAST_SHARE}, (i, shares)
        assert by[0].labels == "bsd" and by[1].labels == "" and by[3].labels == by[4].labels == by[6].labels == "long" and by[5].labels == ""
    with pytest.raises(ValueError, match="two words"):
        license.scan(df, notices={"one": "x"})


def test_bpe_equals_the_library(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.Codec(bpe.vocabulary())
    odd = ["", " ", "don't we'll\n\n x", "<|endoftext|>a <|endoftext|>", "x\x1cy\x1d z", "\U0001f44d\U0001f3fd ok\u0085d", "\u0557\u0558 \U0001f9ff\u0c5c", "é" * 3000, "漢字 1²½ ٣٤", "a\x00b", "aaaaaaaaaaaaaaaaaaaaa"]
    for text in odd + [t for _, t in TEXTS if t]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) and packing.FastIds(bpe.vocabulary())(text).tolist() == ids
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t in TEXTS)
    assert bpe.digest(docs).filter("doc_id in (3, 4)").select("n_tokens").distinct().first()[0] == 0
    assert bpe.digest(none).count() == 0


@pytest.mark.parametrize("window,spaces", [(64, 2), (2048, 16)])
def test_packing_keeps_every_id_once(spark, docs, none, window, spaces):
    fast = packing.FastIds(bpe.vocabulary())
    many = [(d, t) for d, t in TEXTS if d not in (None, 9)] + [(1000 + i, "word " * (i % 90)) for i in range(300)]
    got = packing.pack(spark.createDataFrame(many, "doc_id long, text string").repartition(3), window=window, open_windows=spaces).toPandas()
    for d, text in many:
        ids, at = np.append(fast(text or ""), np.uint32(1)), 0
        for r in got[got.doc_id == d].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    fills = got.groupby("sequence_id").length.sum()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist()
    assert fills.max() <= window and (window - fills).sum() <= 0.02 * fills.sum() + 2 * window
    assert packing.pack(docs).count() >= len(TEXTS) and packing.pack(none).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "n", big), (None, None, "é" * 5000), (7, "dup", big + "y"), (7, "dup", big + "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"salt": F.lit(1), "low": F.lit(2)})
    path = f"file://{tmp_path}/a"
    manifest = warc.write(pages, path, file_bytes=300, shard_bytes=600).collect()
    assert sum(r.records for r in manifest) == len(rows) and len(manifest) > 2
    (tmp_path / "a" / "shard-999999-00000.warc.gz").write_bytes(b"left by a lost task")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, path).collect())
    data = [(p or 0, (h or "").encode()) for p, _, h in rows]
    again = lambda p, d: len(d) >= 100 and d == big.encode() and p != 2
    assert got == sorted((p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again(p, d) else "response", 2 if again(p, d) else 0) for p, d in data)
    second = warc.write(pages.repartition(4), f"file://{tmp_path}/b", file_bytes=300, shard_bytes=600).collect()
    assert sorted(manifest) == sorted(second)
    warc.write(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_archives_give_urls_back_as_they_were(spark, tmp_path):
    urls = ["http://b/\r\nX: y", "http://b/%0D%0AX: y", "%0A\n%25", "\x00\x7f é%", "", None, "http://a/%7F"]
    warc.write(spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, html string"), f"file://{tmp_path}/u")
    got = {r.page_id: r.url for r in warc.read_archives(spark, f"file://{tmp_path}/u").collect()}
    assert [got[i] for i in range(len(urls))] == urls


def test_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * F.col("id")).alias("v"))
    cuts = cut_points(df, "v", 200)
    assert len(cuts) > 128 and cuts == sorted(set(cuts)) and cuts == cut_points(df.repartition(7), "v", 200)
    for r in df.select("v", range_of(F.col("v"), cuts).alias("n")).collect():
        assert r.n == sum(c <= r.v for c in cuts)
    assert cut_points(df.limit(0), "v", 5) == []


def test_pipeline_keeps_columns_and_runs_on_nothing(spark, table, none):
    docs = table("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_pipeline_leaves_the_last_input_and_the_tables_its_rows_are_read_from(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    packed = corpus_pipeline.run(spark, SF)
    rows = packed.count()
    left = sorted(re.sub(r"-[0-9a-f]{8}-.*", "", n) for n in set(os.listdir(base)) - before)
    assert [n for n in left if n.startswith("pipeline-")] == ["pipeline-ngram_jaccard"]
    assert {n for n in left if n.startswith("llm-")} <= {"llm-pieces"} and len(left) == 2
    assert rows > 0 and packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_scratch_removes_tables_also_after_an_error(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    outside = materialize(spark.range(3), "outside")
    with pytest.raises(ValueError), scratch(spark):
        assert materialize(spark.range(5), "inside").count() == 5
        with scratch(spark):
            materialize(spark.range(7), "innermost")
        assert not [n for n in os.listdir(base) if n.startswith("llm-innermost")]
        raise ValueError
    assert [n.startswith("llm-outside") for n in set(os.listdir(base)) - before] == [True] and outside.count() == 3
    remove(spark, [f"{base}/never-written"])


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)} and "pipeline" in names


def test_archive_of_many_members_is_read_in_steps():
    blocks = [b"x" * n for n in (0, 1, 100, 3 * warc.STEP, 70_000)] * 40
    data = b"".join(warc.member(warc.record(i, None, b, len(b), "d", "response", None)) for i, b in enumerate(blocks))
    assert [body for _, body in warc.parse(data)] == blocks
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(data[:-9]))
