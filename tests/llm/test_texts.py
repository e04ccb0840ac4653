"""Sharding, language ID, mixing, coding, pages and the pipeline on edge cases and against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import url_reference
from labelmill.llm import htmltext, idfile, langid, mixing, shard, spbpe, urlfilter
from labelmill.llm.queries import ORACLE_SQL, QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "Ünïcödé ñ 漢字 😀", "don't. it's, x.y 12.5", "line\nline\r\n\ttab", "a" * 3000, " " * 200 + "x" + " " * 40, "<|endoftext|> <s> <0x0A>", "▁▁ \u2581x", "\x00\x1f", "e\u0301 é", "same", "same"]


def docs(spark, more=()):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None)[i % 3], len(t or ""), i, "x") for i, t in enumerate([*ODD, *more])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, topic string").repartition(3)


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(1000).select((F.col("id") % 400).alias("k"), F.lit("t").alias("slot")).unionByName(spark.createDataFrame([(None, "n")] * 37, "k long, slot string"))
    got = shard.shard_rows(df, "k", 8, rows_per_part=100).select("shard", "slot").collect()
    by = Counter(r["shard"] for r in got)
    assert sorted(by.values()) == [129] * 3 + [130] * 5 and set(by) == set(range(8))
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    again = shard.shard_rows(df, "k", 8, rows_per_part=100).select("shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert shard.shard_rows(df.limit(0), "k", 8).count() == 0
    assert shard.shard_rows(df.limit(3), "k", 8).count() == 3


def test_shards_of_one_hot_key_and_odd_names(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("_part"), F.col("id").alias("first_"), F.create_map(F.lit("m"), F.col("id")).alias("row_"))
    out = shard.shard_rows(df, "k", 8, rows_per_part=50)
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [375] * 8 and all(r["_part"] == r["first_"] == r["row_"]["m"] for r in rows)
    corner = Counter(r["shard"] for r in rows if r["_part"] < 1000)  # a shuffle: every shard has about a third of its rows from here
    assert all(90 < n < 160 for n in corner.values())


def test_communication_matrix():
    rng = random.Random(1)
    parts = [rng.randrange(0, 60) for _ in range(30)] + [1000]
    total = sum(parts)
    shards = [total // 8 + (i < total % 8) for i in range(8)]
    m = shard.communication_matrix(parts, shards, 5)
    assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == shards
    draws = [shard.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.15) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    assert shard.hypergeometric(rng, 5, 0, 3) == 3 and shard.hypergeometric(rng, 0, 5, 3) == 0


def test_shard_query_matches_the_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_hypergeometric_shards"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_pieces_equal_the_library(spark):
    rng = random.Random(2)
    letters = list(" aabtheinréñ漢😀\n\t▁'|19.,>s") + ["the ", "tion", " " * 37, "aaaa"]
    df = docs(spark, ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)])
    model = tokenizer("piece_bpe_32k.model")
    library = spbpe.encoder(model).library
    out = spbpe.encode_decode(df.withColumn("decoded", F.lit(1)), model)
    assert out.columns == [*df.columns, "piece_ids", "decoded"]
    for r in out.collect():
        ids = library.encode(r["text"] or "")
        assert r["piece_ids"] == ids, r["text"]
        assert r["decoded"] == (library.decode(ids) if ids else "")
    for r in spbpe.coded_digests(df, model).join(df, "doc_id").collect():
        ids = library.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert spbpe.encode_decode(df.limit(0), model).count() == 0


def test_pieces_are_the_same_when_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(spbpe, "REMEMBERED", 2)
    table = spbpe.encoder(tokenizer("piece_bpe_32k.model"))
    memory = spbpe.Memory(table)
    for text in ("one two three", "two three four", ""):
        assert [i for own, _ in memory.encode([text])[0] for i in own] == table.library.encode(text)


def test_id_segments_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2047, 2048, 2049, 5000):
        for ids in (rng.integers(0, 49408, n), np.arange(n) % 3, np.zeros(n, dtype=int), rng.zipf(1.3, n) % 49408):
            ids = ids.astype(np.int32)
            assert (idfile.decode(idfile.encode(ids)) == ids).all()
    for n in (16 * 1024 - 1, 16 * 1024 * 3 + 5, 600_000):  # more streams, more blocks, a short last block
        ids = (rng.zipf(1.2, n) % 49408).astype(np.int32)
        assert (idfile.decode(idfile.encode(ids)) == ids).all()
    for at in (-400, -3000):
        segment = bytearray(idfile.encode(np.arange(3000, dtype=np.int32)))
        segment[at] ^= 1
        with pytest.raises(ValueError):
            idfile.decode(bytes(segment))
    with pytest.raises(ValueError):
        idfile.decode(bytes(segment[:-4]))
    with pytest.raises(ValueError):
        idfile.encode(np.array([65535]))


def test_ids_of_documents_are_small(spark):
    """Below a static order-0 code of the same ids, and below the bytes that zlib takes for them."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate([flat for flat, _ in idfile.Words(tokenizer("word_bpe_49k.json")).encode(pa.array(texts, pa.string()))])
    coded = idfile.encode(ids)
    assert (idfile.decode(coded) == ids).all()
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(coded) < 1.05 * -(share * np.log2(share)).sum() / 8 * len(ids)
    assert len(coded) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_commonest_ids_equal_a_count():
    """Of each context the commonest ids, of equals the smallest, a row for each place; contexts seen too rarely are left out."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 5000):
        ctx, ids = rng.zipf(1.5, n).clip(0, 300), rng.zipf(1.3, n).clip(0, 65534)
        for most, least in ((3, 1), (2, 2)):
            seen = {}
            for c, i in zip(ctx.tolist(), ids.tolist()):
                seen.setdefault(c, Counter())[i] += 1
            want = []
            for c in sorted(c for c in seen if seen[c].total() >= least):
                top = sorted(seen[c].items(), key=lambda x: (-x[1], x[0]))[:most] + [(65535, 0)] * most
                want.append((c, seen[c].total(), [i for i, _ in top[:most]], [k for _, k in top[:most]]))
            got = idfile._best(((ctx << 16) | ids).astype(np.uint32), most, least)
            assert got[2].shape == got[3].shape == (most, len(want))
            assert list(zip(got[0].tolist(), got[1].tolist(), got[2].T.tolist(), got[3].T.tolist())) == want


def test_plain_words_skip_the_normaliser():
    """Latin words equal the library's without its normaliser; where a letter's ids would differ, nothing is skipped."""
    path, rng = tokenizer("word_bpe_49k.json"), random.Random(9)
    words = idfile.Words(path)
    assert words.plain is not words.library and words.plain.normalizer is None
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    texts = ["".join(rng.choice(letters[:80] if rng.random() < 0.5 else letters) for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    flat, count = (np.concatenate(c) for c in zip(*words.encode(pa.array(texts, pa.string()))))
    ends = np.cumsum(count)
    for t, e, n in zip(texts, ends.tolist(), count.tolist()):
        assert flat[e - n : e].tolist() == [*words.library.encode(t, add_special_tokens=False).ids, 1], t
    assert (other := idfile.Words(tokenizer("byte_bpe_50k.json"))).plain is other.library


def test_each_distinct_run_is_looked_up_once():
    """A known run costs one lookup of a chunk; a new one costs a second after it was learnt."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    words = idfile.Words(tokenizer("word_bpe_49k.json"))
    words.known, texts = Counted(words.known), pa.array(["one two three two one", "four one"], pa.string())
    first = np.concatenate([flat for flat, _ in words.encode(texts)])
    Counted.asked = 0
    assert (np.concatenate([flat for flat, _ in words.encode(texts)]) == first).all()
    assert Counted.asked == 4


def test_words_equal_the_library():
    words, rng = idfile.Words(tokenizer("word_bpe_49k.json")), random.Random(5)
    parts = list("abAB z'12.,$<|>\t\n'st rell éÉñßçİıſKÅǻ…—ªº²½٣中あ  \x1c\x85\x0b\x00≠<'") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "'LL", "</w>", "ǅ", "Σς", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert words.cut and words.lower
    for words.REMEMBERED in (1_000_000, 50):
        found = list(words.encode(pa.array([*texts, None], pa.string())))
        flat, count = (np.concatenate(c) for c in zip(*found))
        ends = np.cumsum(count)
        for t, e, n in zip(texts, ends.tolist(), count.tolist()):
            assert flat[e - n : e].tolist() == [*words.library.encode(t, add_special_tokens=False).ids, 1], t
        assert len(count) == 2001 and count[-1] == 1


def test_id_files_equal_the_library(spark, tmp_path, monkeypatch):
    path = tokenizer("word_bpe_49k.json")
    df = docs(spark, ["Hello, World. the cat sat." * 40, "Été.à,b c.D"])
    segments = idfile.write_ids(df, path, str(tmp_path / "ids"))
    got = {r["doc_id"]: r for r in idfile.read_ids(segments).collect()}
    library, at = idfile.Words(path).library, 0
    for r in df.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())), r["text"]
        at += len(ids)
    assert idfile.read_ids(idfile.write_ids(df.limit(0), path)).count() == 0
    same = spark.createDataFrame([(None, "a"), (None, "b c"), (7, "d"), (7, "d"), (7, None)], "doc_id long, text string")
    assert Counter(r["n_tokens"] for r in idfile.read_ids(idfile.write_ids(same.withColumn("n", F.lit(1)), path)).collect()) == {2: 3, 3: 1, 1: 1}


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op5_nearest_centroid_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    df = docs(spark)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", F.lit("x")), model).collect()}
    for i, t in enumerate(ODD):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters), t
        assert letters or (got[i]["rejected"] and got[i]["score"] == 0.0)
    assert got[13]["lang_pred"] == got[14]["lang_pred"]
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.fit(df.filter("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    far = langid.identify(spark.createDataFrame([(1, "Быстрая лиса прыгает")], "doc_id long, text string"), langid.fit(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert far.first()["rejected"]


def test_foreign_texts_are_rejected_and_own_ones_kept(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(source)
    foreign = ["Szybki brązowy lis przeskakuje nad leniwym psem i wraca do domu. " * 8, "Kiire pruun rebane hüppab üle laisa koera ja läheb siis koju magama. " * 8, "Het is vandaag mooi weer en morgen wordt het nog warmer. " * 20]
    got = langid.identify(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in got)
    own = langid.identify(source, model).agg(F.avg(F.col("rejected").cast("double")).alias("gone"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert own["gone"] <= 0.003 and own["right"] >= 0.99


def test_language_sample_is_bounded_for_repeated_ids(spark):
    df = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(df.unionByName(df.select("doc_id", F.lit("x" * 500).alias("text"), F.lit("xx").alias("lang"))), per_language=20)
    assert model.languages == ["en", "xx"] and langid.identify(df, model).filter("lang_pred <> 'en'").count() == 0


def cosines(texts, model_texts):
    """Brute force: TF-IDF of hashed n-gram counts and cosines, by dictionaries."""
    grams = lambda t: Counter({i: int(n) for i, n in enumerate(langid.counts([t])[0]) if n})
    fitted = [grams(t) for t in model_texts]
    df = Counter(g for c in fitted for g in c)
    weight = lambda c: {g: np.log1p(n) * (np.log((1 + len(fitted)) / (1 + df[g])) + 1) for g, n in c.items()}
    unit = lambda v: {g: x / max(1e-12, sum(y * y for y in v.values()) ** 0.5) for g, x in v.items()}
    centres = [unit(weight(c)) for c in fitted]
    return [[sum(x * c.get(g, 0.0) for g, x in unit(weight(grams(t))).items()) for c in centres] for t in texts]


def test_language_scores_equal_brute_force(spark):
    """With one row a language the centroid is that row."""
    fitted = {"aa": "lorem ipsum dolor sit amet lorem", "bb": "viele kleine worte und satze"}
    model = langid.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(fitted.items())], "doc_id long, text string, lang string"))
    texts = ["lorem kleine", "satze und worte", "dolor dolor dolor ipsum und"]
    want = cosines(texts, list(fitted.values()))
    for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        assert r["score"] == pytest.approx(max(want[r["doc_id"]]), abs=1e-5) and r["lang_pred"] == list(fitted)[int(np.argmax(want[r["doc_id"]]))]


def test_mixing_equals_its_sql(spark):
    got = sorted(map(tuple, QUERIES["op7_mix_to_targets"](spark, DATA).select("doc_id", "topic", "n_words", "chance", "sampled").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, topic, n_words, chance, sampled from ({ORACLE_SQL['op7_mix_to_targets']}) z").fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 2e-6 and g[4] == w[4]


@pytest.mark.parametrize("local", [100, 0])
def test_raking_meets_targets_and_holds_full_cells(spark, local, caplog):
    rows = [("x", "u", 1000), ("x", "v", 1000), ("y", "u", 10), ("y", "v", 300)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long")
    share = lambda d, s: spark.createDataFrame(list(s.items()), f"{d} string, share double")
    wants = {"a": {"x": 0.8, "y": 0.2}, "b": {"u": 0.7, "v": 0.3}}
    got = mixing.rake(cells, {d: share(d, s) for d, s in wants.items()}, 0.5, 30, local=local).collect()
    assert all(-1e-9 <= r["w"] <= r["tokens"] for r in got) and max(r["w"] / r["tokens"] for r in got) == 1  # one cell is full
    for d, s in wants.items():
        assert {v: sum(r["w"] for r in got if r[d] == v) / 1155 for v in s} == pytest.approx(s, abs=2e-6)
    assert not caplog.records
    got = mixing.rake(cells, {"a": share("a", {"x": 0.2, "y": 0.8})}, 0.5, 3, local=local).collect()  # y has 310 of the 924 wanted
    assert {v: sum(r["w"] for r in got if r["a"] == v) for v in "xy"} == pytest.approx({"x": 845, "y": 310})
    assert len(caplog.records) == 2 and mixing.rake(cells.limit(0), {"a": share("a", {"x": 1.0})}, 0.5).count() == 0


def test_expected_shares_meet_their_targets(spark):
    """Over the whole documents every marginal and the budget are within 1 % of their targets."""
    df = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = df.select(*mixing.DIMENSIONS, "n_words", "chance").collect()
    total = sum(r["n_words"] for r in rows)
    assert sum(r["n_words"] * r["chance"] for r in rows) == pytest.approx(total / 2, rel=1e-6)
    for d in mixing.DIMENSIONS:
        have, got = Counter(), Counter()
        for r in rows:
            have[r[d] or "?"] += r["n_words"]
            got[r[d] or "?"] += r["n_words"] * r["chance"] / (total / 2)
        smooth = {v: n ** mixing.POWERS[d] for v, n in have.items()}
        aim, whole = {}, {v: n / (total / 2) for v, n in have.items()}
        while not aim or any(aim[v] > whole[v] + 1e-12 for v in aim):  # what a value cannot give falls to the others
            full = {v for v in aim if aim[v] >= whole[v]}
            rest = (1 - sum(whole[v] for v in full)) / sum(smooth[v] for v in have if v not in full)
            aim = {v: whole[v] if v in full else smooth[v] * rest for v in have}
        for v in have:
            assert got[v] == pytest.approx(aim[v], rel=0.01), (d, v)
        if d != "topic":  # the rare topics are taken whole
            assert aim == pytest.approx({v: n / sum(smooth.values()) for v, n in smooth.items()})


def test_pipeline_mixes_to_its_budget(spark):
    """The rare source is taken whole, and what it cannot give comes from the other: 1,550 of 3,100, not 1,411."""
    df = spark.createDataFrame([(i, "word", "en", "rare" if i < 100 else "s", 4) for i in range(3100)], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r["source"] for r in corpus_pipeline.mix(spark, df, DATA).collect())
    assert got["rare"] == 100 and abs(sum(got.values()) - 1550) < 80


def test_mixing_edge_cases(spark):
    df = docs(spark)
    assert mixing.mixed(df.withColumns({"_source": F.lit(1), "source_": F.lit(2), "LANG_": F.lit(3), "w": F.lit(4)})).columns[-8:-4] == ["_source", "source_", "LANG_", "w"]
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "topic", "n_words", "chance", "sampled"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r["chance"] <= 1 and r["n_words"] >= 1 for r in rows)
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "- x\n- y\n  - z\n- w"), ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"), ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
    ("a<script>if (a</b>) '<p>'</script><style>p{}</style>b<!-- c", "ab"), ("<div hidden>x</div><p style='display : none'>y</p>z", "z"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;&amp;&eacute;&#33;", "<&é!"), ("<title>t</title><body>x</i></div>y", "xy"), ("a <b>b</b> c", "a b c"), ("<p>a</p", "a"), ("< a <3", "< a <3"),
])
def test_layout(page, text):
    assert htmltext.to_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ('<p title="the hidden gem">a', "a"), ('<p class="js hidden sm">a', "a"), ('<body data-style="display:none">a', "a"), ("<p style='display:none;display:block'>a", "a"),
    ("<p style='display:none!important;display:block'>a</p>b", "b"), ("<p class='a'hidden>a</p>b", "b"), ("<p hidden=until-found>a</p>b", "b"), ("<p STYLE=visibility:hidden>a</p>b", "b"),
    ("<table><tr class='x hidden y'><td title='a hidden b'>c<td hidden>d</table>", "c"),
    ("<head><title>T</title>Welcome <b>b</b>", "Welcome b"), ("<head><title>T</title><li>one<li>two", "- one\n- two"), ("<head><td>x", "x"), ("<head><dt>x<dd>y", "x\n  y"),
    ("<head><title>T</title>Welcome", "Welcome"),     ("<p style=\"font:'x'; display:none\">a</p>b", "b"), ("<div style='visibility:hidden'>a<i style='visibility:visible'>b</i>c</div>d", "b\nd"),
    ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
    ("<head>\n<title>T</title>\n<style>s</style>\n</head>\n<body>b", "b"),
])
def test_what_is_visible(page, text):
    assert htmltext.to_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><td><p>a</p><p>b</p><ul><li>x<li>y</ul></td><td>q</td></tr><tr><td>1<td>2</table>", "a    q\n\nb\n\n- x\n- y\n1    2"),
    ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"), ("<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e</table>", "a  B  c\nd     e"),
    ("<table><tr><td><pre>x\n  y</pre><td>z</table>", "x    z\n  y"), ("<table><tr><td colspan=2>head<td>c<tr><td>1<td>22<td>3</table>x", "head   c\n1  22  3\n\nx"),
    ("<table><tr><td colspan=2>wide heading text<td>z<tr><td>a<td>b<td>c</table>", "wide heading text  z\na  b               c"),
    ("<table><tr><td>a<td><td>b<tr><td>c<td hidden>x<td style='visibility:hidden'>y<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>日本<td>x<tr><td>abc<td>y<tr><td>e\u0301e\u0301<td>z</table>", "日本  x\nabc   y\ne\u0301e\u0301    z"),
    ("<table><tr><td colspan=1000>a<tr><td>b<td>c</table>", "a\nb  c"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td>x<td>" + "<table><tr><td>a<td>" * 20 + "q" + "</table>" * 20 + "<tr><td>y<td>z</table>", "x" + "  a" * 20 + "  q\ny  z"),
    ("<table><tr><td data-colspan=3>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"), ("<table><tr><td>a<br>b<td>c<br>d</table>", "a  c\nb  d"),
])
def test_cells_are_blocks(page, text):
    assert htmltext.to_text(page) == text


def test_tables_equal_a_grid(spark):
    """Random tables of plain cells, some over several columns or rows, against a grid filled cell by cell."""
    rng = random.Random(9)
    for _ in range(300):
        rows = [[("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={r}>{t}" for t, c, r in row) for row in rows) + "</table>"
        grid, places = {}, []
        for y, row in enumerate(rows):
            x = 0
            for t, c, r in row:
                while (y, x) in grid:
                    x += 1
                for i in range(c):
                    for j in range(r):
                        grid[y + j, x + i] = (y, x)
                places.append((y, x, t, c))
                x += c
        wide = {}
        for y, x, t, c in sorted(places, key=lambda p: p[3]):  # what a cell needs beyond its columns widens the last one
            have = sum(wide.get(i, 0) for i in range(x, x + c)) + 2 * c - 2
            wide[x + c - 1] = wide.get(x + c - 1, 0) + max(0, len(t) - have)
        lines = []
        for y in range(len(rows)):
            line = ""
            for _, x, t, c in (p for p in places if p[0] == y):
                start = sum(wide.get(i, 0) + 2 for i in range(x))
                assert len(line) <= start  # every cell begins where its column does
                line = line.ljust(start) + t.ljust(sum(wide.get(i, 0) for i in range(x, x + c)) + 2 * c - 2) + "  "
            lines.append(line.rstrip())
        assert htmltext.to_text(page).split("\n") == "\n".join(lines).strip("\n").split("\n"), page


def test_deep_and_long_pages(spark):
    assert htmltext.to_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert "x" in htmltext.to_text("<table><tr><td>" * 300 + "x")
    assert len(htmltext.to_text("<p>word " * 50_000)) > 200_000
    df = spark.createDataFrame([(1, "<p>a", "b"), (2, None, "c"), (1, "<p>a", "b")], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in htmltext.extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert htmltext.extract_text(df.limit(0)).count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.COM/x", "http://com/", "http://com", "https://www.example.com/en/1?x", "https://Example.com/en/", "http://x.net/es/a#b", "http://net?es/", "ftp://a.b://c/d", "http://xcom/", "http://x.net/fr", "http://É.com/\n/y"]
    df = spark.createDataFrame([(i, u, "<p>the cat example net</p>", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path = url_parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fit = [(len(t), v, t) for v, t in urlfilter.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        assert got[i]["rule"] == (max(fit)[2] if fit else None), u
        if fit:
            assert got[i]["verdict"] == max(fit)[1]
        else:
            assert got[i]["verdict"] == ("block" if got[i]["score"] > 0 else "allow")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_names_split_into_known_words():
    words = urlfilter.Unigrams.of({"cheap": 50, "pills": 40, "the": 500, "he": 300, "ap": 3})
    assert words.split("cheappills") == ["cheap", "pills"]
    assert words.split("") == [] and "".join(words.split("qqqzz")) == "qqqzz"


def test_splits_cost_the_least_of_all_splits():
    rng = random.Random(12)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(6)}
        words, token = urlfilter.Unigrams.of(counts), "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        unknown = lambda n: np.log(sum(counts.values())) + (n - 1) * np.log(10)  # noqa: B023, E731
        cost = lambda parts: sum(words.cost.get(p, unknown(len(p))) for p in parts)  # noqa: B023, E731
        every = ([token[i:j] for i, j in zip([0, *cuts], [*cuts, len(token)])] for n in range(len(token)) for cuts in itertools.combinations(range(1, len(token)), n))
        assert cost(words.split(token)) == pytest.approx(min(map(cost, every))), (counts, token)


def test_long_words_and_tokens(spark):
    """Words of more letters than a piece, and a token of a hundred thousand letters."""
    long, tail = "abcdefghij" * 5, "klmnopqrst" * 3
    rows = [(0, f"http://{long}{tail}cat.org/{'x' * 100_000}", f"{long} {tail} cat cat {long} " + "other words " * 200), (1, f"http://{long[:45]}.org/{tail}z", f"{tail}y {long}{long}")]
    got = {r["page_id"]: r["words"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == [long, tail, "cat", "org", "x" * 100_000]
    words = urlfilter.Unigrams.of({long: 2, tail: 1, "cat": 2, f"{tail}y": 1, long * 2: 1, "other": 200, "words": 200})
    assert got[1] == [*words.split(long[:45]), "org", *words.split(f"{tail}z")]


def test_verdicts_of_held_out_rules(spark):
    """Urls that a rule decides, judged without it by the words of the others: right for most, and more often than the commoner verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    judged = urlfilter.judge(pages).filter("rule is not null")
    seen, held = (judged.filter(f"crc32(cast(page_id as string)) % 4 {how} 0").select("host", "path", "verdict") for how in ("<>", "="))
    words = urlfilter.Unigrams.of({r["word"]: r["n"] for r in urlfilter.word_counts(pages, "html").collect()})
    model, split = url_reference.fit(seen, words), url_reference.Splitter(words)
    rows = held.collect()
    right = sum((model.score(split.words(r["host"], r["path"])) > 0) == (r["verdict"] == "block") for r in rows)
    common = max(Counter(r["verdict"] for r in rows).values())
    print("held-out urls:", len(rows), "right:", right, "commoner verdict:", common)
    assert len(rows) > 200 and right / len(rows) >= 0.8 and right > common


def test_naive_bayes_equals_counts(spark):
    rows = [("a.b", "/x/y", "block"), ("a.c", "/x", "allow"), ("a.b", "/1/2", "block")]
    words = urlfilter.Unigrams.of({w: 10 for w in "abcxy"})
    model = url_reference.fit(spark.createDataFrame(rows, "host string, path string, verdict string"), words)
    count = {v: Counter(w for h, p, x in rows if x == v for w in url_reference.Splitter(words).words(h, p)) for v in ("block", "allow")}
    vocabulary = set(count["block"]) | set(count["allow"])
    for w in vocabulary:
        odds = np.log((count["block"][w] + 1) / (sum(count["block"].values()) + len(vocabulary))) - np.log((count["allow"][w] + 1) / (sum(count["allow"].values()) + len(vocabulary)))
        assert model.weight[w] == pytest.approx(odds)
    assert model.prior == pytest.approx(np.log(3 / 2))


def test_models_hold_every_word(spark, monkeypatch):
    """The verdicts follow from the counts of all words, also of those that occur once: equal to one model in memory."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(300):
        tail = ("com", "net/es", "net/fr", "org")[i % 4].split("/")
        rows.append((i, f"http://{word()}{word()}.{tail[0]}/{'/'.join([*tail[1:], word() + word(), str(i), word() + 'qq'])}", f"<p>{word()} {word()} once{'abcdef'[i % 6] * (i // 6 % 15 + 1)}"))
    rows += [(300, None, "zz"), (300, None, None), (301, rows[0][1], "solitary"), (302, "http://x.org/solitaryword", "word")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    counts = {r["word"]: r["n"] for r in urlfilter.word_counts(df, "html").collect()}
    assert counts["solitary"] == 1 and sum(counts.values()) == sum(len((t or "").replace("<p>", "").split()) for _, _, t in rows)
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows)
    unigrams = urlfilter.Unigrams.of(counts)
    model = url_reference.fit(spark.createDataFrame([(r["host"], r["path"], r["verdict"] if r["rule"] else None) for r in got], "host string, path string, verdict string"), unigrams)
    splitter = url_reference.Splitter(unigrams)
    for r in got:
        words = splitter.words(r["host"], r["path"])
        assert r["words"] == [w[2:] for w in words] and r["score"] == pytest.approx(model.score(words), abs=1e-9)
        assert r["rule"] or r["verdict"] == ("block" if r["score"] > 0 else "allow")
    assert next(r for r in got if r["page_id"] == 302)["words"][-2:] == ["solitary", "word"]


def test_pipeline_stages(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    df, seen = source, source.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.land(stage(spark, df, DATA))
        assert df.columns == source.columns, name
        assert 0 < df.count() <= seen, name
        seen = df.count()
    last = corpus_pipeline.STAGES[-1][1](spark, df, DATA)
    assert last.count() == seen and corpus_pipeline.run(spark, DATA).count() == seen
    odd = docs(spark).select(*source.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0
        stage(spark, odd, DATA).collect()
