"""Plans and sizes that must not grow faster than the tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordprism.operators import annotate, catalog, classify, embed, explain, geometry, layout, surrogates, svm, tokens, topics, views
from wordprism.plans import blocks, sieve
from wordprism.plans import tables as plan_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, *items):
    return spark.createDataFrame([(f"t_{i}", text, "x") for i, text in enumerate(items)], "text_id string, text string, label string")


def test_encoder_digests_a_token_once(spark):
    many = " ".join(f"word{i % 7}, x" for i in range(400))
    data = texts(spark, many, "", None, "one", "  two\tthree ")
    got = embed.encode_hashed(data, keep=("label",), dimensions=11)
    assert "conv(" not in plan(got) and "Generate" not in plan(got)
    found = {(r["text_id"], r["pos"]): r for r in got.collect()}
    assert len(found) == 3 * 400 + 1 + 2
    cut = found["t_4", 1]
    assert (cut["token"], cut["start"], cut["end"], cut["label"]) == ("three", 6, 11, "x")

    import hashlib

    def own(token):
        return np.array([*np.frombuffer(hashlib.md5(token.encode()).digest(), ">u2"), *np.frombuffer(hashlib.md5(b"1:" + token.encode()).digest(), ">u2")])[:11] / 65535 - 0.5

    assert np.allclose(found["t_3", 0]["vec"], own("one")) and np.allclose(cut["vec"], (own("two") + own("three")) / 2)
    assert np.allclose(found["t_0", 3]["vec"], (own("x") + own("word1") + own(",")) / 3)
    assert got.drop("vec", "start", "end").schema == embed.encode_hashed(data, keep=("label",), spans=False).drop("vec").schema


def test_pooling_is_hash_aggregated(spark):
    data = texts(spark, "a b c", "d")
    shown = plan(embed.mean_pool(embed.encode_hashed(data), 8, data))
    assert "HashAggregate" in shown and "ObjectHashAggregate" not in shown and "SortAggregate" not in shown


def test_copies_of_a_row_do_not_grow_with_the_table():
    few, many = (blocks.block_count(n, 64 * n, 12) for n in (20_000, 600_000))
    assert few == many == 10
    assert blocks.block_count(60, 180, 8, 16) == 4 and blocks.block_count(0, 0, 8) == 1
    assert blocks.block_count(1 << 20, 1 << 28, 12) == (1 << 28) // blocks.BLOCK_CELLS  # blocks stay in bounds


@pytest.mark.parametrize("sparse", [False, True])
def test_silhouette_tile_by_tile(spark, monkeypatch, sparse):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1100, 3))  # three tiles in the only block
    x[700] = x[3]
    label = np.array(["a", "b", "c"])[rng.integers(0, 3, 1100)]
    df = spark.createDataFrame([(f"p{i}", str(label[i]), x[i].tolist()) for i in range(1100)], "text_id string, label string, vec array<double>")
    if sparse:
        df = df.select("text_id", "label", F.sequence(F.lit(0), F.lit(2)).cast("array<long>").alias("idx"), F.col("vec").alias("val"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = np.stack([d[:, label == c].sum(axis=1) for c in "abc"], axis=1)
    size = np.array([(label == c).sum() for c in "abc"])
    own = np.searchsorted(["a", "b", "c"], label)
    a = mean[np.arange(1100), own] / (size[own] - 1)
    other = mean / size
    other[np.arange(1100), own] = np.inf
    b = other.min(axis=1)
    expected = ((b - a) / np.maximum(a, b)).mean()
    for rows in (4096, 300):
        assert geometry.silhouette(df, block_rows=rows).first()["silhouette"] == pytest.approx(expected)


def test_draws_of_a_small_table_are_spread(spark):
    predictions = spark.createDataFrame([("t", "x", 0.5)], "text_id string, predicted string, predicted_prob double")
    coef = spark.createDataFrame([(c, t, 0.1) for c in "xy" for t in "abc"], "class string, token string, weight double")
    classes = spark.createDataFrame([(c, 0.0, -1.0, 0.0) for c in "xy"], "class string, bias double, a double, b double")
    values = spark.createDataFrame([("t", "a", 1.0)], "text_id string, token string, value double")
    phi = values.select("text_id", "token", F.col("value").alias("phi"))
    rows = explain.infidelity(values, predictions, phi, classify.LinearModel(coef, classes))
    assert "REPARTITION_BY_NUM" in plan(rows)
    assert rows.count() == 1


def test_only_proper_nouns_are_moved(spark):
    data = texts(spark, "we met New York City and Paris", "York")
    tagged = annotate.pos_tags(annotate.words(data), annotate.lexicon(spark), annotate.tag_names(spark))
    names = spark.createDataFrame([("new york city", "GPE"), ("york", "LOC")], "name string, entity string")
    rows = annotate.named_entities(tagged, names)
    assert plan(rows).split("== Initial Plan ==")[-1].count("hashpartitioning(text_id") == 1
    got = {(r["text_id"], r["word"]): r["entity"] for r in rows.collect()}
    assert got["t_0", "York"] == got["t_0", "City"] == "GPE" and got["t_0", "Paris"] == "NAME" and got["t_1", "York"] == "LOC" and got["t_0", "we"] is None
    assert rows.count() == tagged.count()


def test_features_are_written_without_a_sort(spark, tmp_path):
    data = texts(spark, "a b c", "d e").repartition(1)
    vectors = embed.encode_hashed(data).withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2))))
    sorts = []
    listener_conf = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    real = type(vectors.write).parquet

    def spied(self, path, *args, **kwargs):
        sorts.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return real(self, path, *args, **kwargs)

    type(vectors.write).parquet, kept = spied, real
    try:
        catalog.save_features(vectors, str(tmp_path), "d", "m")
    finally:
        type(vectors.write).parquet = kept
    assert int(sorts[0]) > 0 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == listener_conf
    back = catalog.scan(spark, str(tmp_path), "features", layer=2)
    assert back.count() == 5 and sorted(r["token"] for r in back.collect()) == list("abcde")


def test_noise_is_drawn_by_key(spark):
    keys = [b"t_1:cat", "t_2:été".encode()]
    noise = explain.gaussian_noise(1537, keys, 3)
    unit = "(cast(conv(substr(md5('1537:t_2:été:1:{0}'), 1, 12), 16, 10) as double) + 0.5) / 281474976710656D"
    sql = f"select sqrt(-2 * ln({unit.format('u')})) * cos(2 * pi() * {unit.format('v')})"
    assert noise.shape == (2, 3) and noise[1, 1] == pytest.approx(spark.sql(sql).first()[0], abs=1e-12)


def test_svm_blocks_are_solved_in_tasks_of_their_own(spark, monkeypatch):
    data = spark.createDataFrame([(f"t_{i}", "ab"[i % 2]) for i in range(40)], "text_id string, label string")
    values = spark.createDataFrame([(f"t_{i}", f"k{i % 2}", 1.0) for i in range(40)], "text_id string, token string, value double")
    vocab = spark.createDataFrame([("k0", 0), ("k1", 1)], "token string, idx long")
    rounds, real = [], svm.stored

    def spied(df, name):
        kept = real(df, name)
        if name == "round":
            rounds.append(kept)
        return kept

    monkeypatch.setattr(svm, "stored", spied)
    svm.fit_dual(values, data, vocab, block_cells=40)  # 80 cells
    files = rounds[0].where("kind = 2").select("block", F.input_file_name().alias("file"))  # a task writes one file
    assert files.count() == files.select("file").distinct().count() == 2


def test_only_usual_words_meet_the_texts(spark, monkeypatch):
    data = texts(spark, *["Blue sky x@y.org sky", "blue Sea", "rare blue"] * 10).unionByName(texts(spark, "blue sea")).withColumn(
        "text_id", F.when(F.col("text") != "rare blue", F.col("text_id"))  # ids that repeat, or are null
    )
    words = tokens.prepared_words(data)
    assert sorted(map(tuple, words.collect()), key=str) == sorted(map(tuple, words.distinct().collect()), key=str)
    seen, real = [], topics.stored

    def spied(df, name):
        kept = real(df, name)
        if name == "usual":
            seen.append({r["term"]: r["total"] for r in kept.collect()})
        return kept

    monkeypatch.setattr(topics, "stored", spied)
    terms = topics.count_terms(words, data.withColumn("text_id", F.lit("t")).limit(30))
    assert seen == [{"blue": 21, "sky": 10, "sea": 11}]  # "rare" is one row, below 5 % of the texts
    assert {r["term"]: r["df"] for r in terms.collect()} == {"blue": 21, "sky": 10, "sea": 11}
    matrix = topics.count_matrix(words, terms.where("term != 'blue'"))
    assert plan(matrix).index("Join") > plan(matrix).index("HashAggregate") and matrix.count() == 21  # joined below the counts


def test_vectors_are_written_once(spark, monkeypatch):
    cells = spark.createDataFrame([(f"t{i}", w, k, 1) for i in range(8) for k, w in enumerate("abcdef") if (i + k) % 2], "text_id string, term string, idx long, n long")
    terms = cells.select("idx", "term").distinct()
    names, real = [], topics.stored

    def spied(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(topics, "stored", spied)
    vectors = topics.term_vectors(cells, cells.select("text_id").distinct(), 6, "n")
    _, mixed = topics.fit_lda(vectors, terms, 2)
    assert names.count("vectors") == 1 and mixed.count() == 16
    weights = cells.select("text_id", "term", "idx", F.col("n").cast("double").alias("weight"))
    topics.fit_svd(weights, cells.select("text_id").distinct(), terms, 2)
    assert names.count("vectors") == 2


def test_words_are_annotated_once(spark):
    data = texts(spark, "Re-use the-cat, cat 3rd x-", "the-cat Cat the-cat!", "", None)
    lookups = annotate.lexicon(spark), annotate.tag_names(spark)
    none = spark.createDataFrame([("the",)], "word string")
    single = annotate.occurrences(annotate.named_entities(annotate.pos_tags(annotate.numbered_words(data), *lookups)), none)
    counted = annotate.counted_words(data)
    assert counted.count() == counted.select("word").distinct().count()
    grouped = annotate.occurrences(annotate.named_entities(annotate.pos_tags(counted, *lookups)), none)
    expected = sorted(map(tuple, views.token_table(single).collect()), key=str)
    assert sorted(map(tuple, views.token_table(grouped, "n").collect()), key=str) == expected and ("cat", 4, "the-cat") in [r[:3] for r in expected]


def tables(spark, path):
    """The tables that selections read, a few rows each."""
    docs = [(i, ("chat noir chat", "noir mais", "cat sat", None)[i % 4], ("fr", "en")[i % 2]) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, "fr", [0.1 * i, 0.0]) for i in range(12)], "vec_id long, label string, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_spans_of_a_selection_are_cut_once(spark, monkeypatch, tmp_path):
    from wordprism.queries import select as selections
    from wordprism.queries import views as shown

    cuts, real = [], selections.spans

    def spied(*args):
        cuts.append(1)
        return real(*args)

    monkeypatch.setattr(selections, "spans", spied)
    monkeypatch.setattr(shown, "spans", spied)
    tables(spark, tmp_path)
    found = shown.q_span_dedup(spark, str(tmp_path))
    assert len(cuts) == 1 and found.where("token = 'noir' and start in (0, 5)").count() == 6  # the most frequent word, on ties the later


def test_explained_tokens_go_to_the_occurrences(spark):
    scores = spark.createDataFrame([("x", f"k{i}", 1.0) for i in range(3)], "class string, token string, score double")
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 5).alias("token"), F.col("id").cast("string").alias("text_id"))
    found = catalog.tokens_of_explanation(scores, rows)
    assert "Exchange hashpartitioning" not in plan(found) and found.count() == 120
    assert catalog.tokens_of_explanation(scores, rows, rows.select("token")).count() == 120
    with pytest.raises(Exception, match="k2"):
        catalog.tokens_of_explanation(scores, rows, rows.select("token").where("token <> 'k2'")).collect()


def test_only_kept_tokens_are_weighed(spark, tmp_path):
    from wordprism.queries import base

    tables(spark, tmp_path)
    whole = base.token_weights(spark, str(tmp_path))
    kept = whole.select("token").distinct().orderBy("token").limit(2)
    own = base.token_weights(spark, str(tmp_path), kept=kept)
    order = ["text_id", "token"]
    assert own.orderBy(*order).collect() == whole.join(kept, "token", "left_semi").select(*whole.columns).orderBy(*order).collect()
    shown = plan(own)  # the join stands below the means
    assert shown.index("LeftSemi") > shown.index("HashAggregate")


def test_tokens_of_an_explanation_are_counted_once(spark, monkeypatch, tmp_path):
    from wordprism.queries import explain as queries

    counts, real = [], queries.content_frequency

    def spied(*args):
        counts.append(1)
        return real(*args)

    monkeypatch.setattr(queries, "content_frequency", spied)
    many = [(i, " ".join(f"w{'abcdefgh'[k]} " * (k + 1 + i % 2) for k in range(8)), ("fr", "en")[i % 2]) for i in range(16)]
    spark.createDataFrame(many, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.jn_token_explanation(spark, str(tmp_path))
    tokens_of = {r["token"] for r in found.collect()}
    assert len(counts) == 1 and "wd" in tokens_of and "wh" not in tokens_of  # the most frequent token is no kept one


def test_vectors_are_measured_within_their_text(spark):
    data = texts(spark, "a b a. a", "b c", "", None).unionByName(texts(spark, "c a")).withColumn("text_id", F.when(F.col("text") != "b c", F.col("text_id")))
    for how in ("norm", "mean"):
        rows = embed.encode_hashed(data, spans=False, measure=how)
        assert rows.columns == ["text_id", "layer", "token", "total", "n"] and rows.where("token = 'a' and n = 3").count() == 1
        whole = embed.token_weights(embed.encode_hashed(data, spans=False), how, embed.DIMENSIONS)
        got = {r[:3]: r["weight"] for r in embed.token_weights(rows, how).collect()}
        assert got == pytest.approx({r[:3]: r["weight"] for r in whole.collect()}, rel=1e-12) and len(got) == 6


def test_sieve_loses_no_row_of_a_key(spark):
    keys = spark.range(300).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("token"))
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("token"), "id")
    left = sieve.Sieve(keys, "token").sifted(rows)
    assert "Join" not in plan(left).split("Subquery")[0] and left.where("id < 300").count() == 299 and left.count() < 2_500
    assert sieve.Sieve(keys.limit(0), "token").sifted(rows).count() == 0


def test_scaled_cells_are_not_moved_by_text(spark):
    cells = spark.createDataFrame([(f"t{i}" if i else None, w, float(i + 1)) for i in range(6) for w in "ab"], "text_id string, token string, weight double")
    split = spark.createDataFrame([(f"t{i}" if i else None, "test" if i == 5 else "train") for i in range(6)], "text_id string, part string")
    train, tokens_of = split.where("part = 'train'"), cells.select("token").distinct()
    shuffled = classify.fit_minmax(cells, train, tokens_of, others=split.where("part = 'test'"))
    assert "hashpartitioning(text_id" not in plan(shuffled)
    scaler = classify.fit_minmax(cells, train, tokens_of)
    assert sorted(shuffled.collect()) == sorted(scaler.collect())
    own = classify.apply_minmax(cells, scaler.withColumn("lo", F.when(F.col("token") == "a", 0.5).otherwise(0.0)), split, complete=True)
    assert plan(own).count("LeftSemi") < plan(classify.apply_minmax(cells, scaler, split)).count("LeftSemi")
    assert own.where("text_id is not null").count() == 10


def test_shuffled_files_go_with_the_table(spark, monkeypatch, tmp_path):
    import os

    from wordprism.plans.tables import stored

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]

    def shuffled():
        return {f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    kept = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not shuffled() - before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_svm_rounds_go_over_the_near_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, width = 240, 6
    x = np.abs(rng.normal(size=(n, width)))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > x[:, 1]).astype(int)
    ids = [f"t_{i}" if i else None for i in range(n)]  # a row without an id has the constant only
    data = spark.createDataFrame([(t, "ab"[k]) for t, k in zip(ids, y)], "text_id string, label string")
    values = spark.createDataFrame([(t, f"k{j}", float(x[i, j])) for i, t in enumerate(ids) for j in range(width)], "text_id string, token string, value double")
    vocab = spark.createDataFrame([(f"k{j}", j) for j in range(width)], "token string, idx long")
    met, real = [], svm.stored

    def spied(df, name):
        kept = real(df, name)
        if name == "round":
            met.append(kept.where("kind = 3").count())
        return kept

    monkeypatch.setattr(svm, "stored", spied)
    fit = svm.fit_dual(values, data, vocab, block_cells=n * (width + 1) // 2)
    assert met[0] == met[-1] == n and min(met) < n  # the ends meet all rows, which gives the true gap
    assert fit.duals.count() == 2 * n
    assert all(r["primal"] - r["dual"] <= 1e-3 * r["primal"] for r in fit.gaps.collect())
    assert all(r["within"] and r["bounded"] for r in svm.certificate(values, data.where("text_id is not null"), fit).collect())


def test_weights_of_single_rows_are_not_moved(spark, tmp_path):
    from wordprism.queries import base

    docs = [(1, "cat sat cat"), (2, "cat dog"), (2, "dog dog"), (None, "cat"), (None, "cat sat"), (3, None)]
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = base.token_weights(spark, str(tmp_path))
    whole = embed.token_weights(tokens.without_stop_words(embed.encode_hashed(base.texts(spark, str(tmp_path)), spans=False), base.stop_words(spark)), "norm", embed.DIMENSIONS)
    weights = {r[:3]: r["weight"] for r in got.collect()}
    assert weights == pytest.approx({r[:3]: r["weight"] for r in whole.collect()}, rel=1e-12) and len(weights) == got.count() == 6
    once, _ = tokens.single_rows(base.texts(spark, str(tmp_path)))
    rows = embed.token_weights(embed.encode_hashed(once, spans=False, measure="norm"), single=True)
    assert "HashAggregate" not in plan(rows) and {r["text_id"] for r in rows.collect()} == {"doc_1"}


def test_proper_nouns_are_tagged_alone(spark):
    data = texts(spark, "The acme Paris Ltd and Rome-2 ate", "éclair Élan 3rd x_ing USING using", "", None)
    lexicon = annotate.lexicon(spark).unionByName(spark.createDataFrame([("acme", "NNP")], "word string, tag string"))
    rows, names = annotate.words(data), annotate.tag_names(spark)
    tagged, nouns = annotate.pos_tags(rows, lexicon, names), annotate.proper_nouns(rows, lexicon, names)
    assert sorted(nouns.collect()) == sorted(tagged.where("tag = 'NNP'").collect())
    assert {r["word"] for r in nouns.collect()} == {"acme", "Paris", "Ltd", "Rome-2", "Élan", "USING"}
    known = spark.createDataFrame([("paris ltd", "ORG"), ("acme paris ltd", "FIRM")], "name string, entity string")
    whole, own = annotate.named_entities(tagged, known), annotate.named_entities(tagged, known, nouns=nouns)
    assert sorted(map(str, own.collect())) == sorted(map(str, whole.collect())) and own.where("entity = 'FIRM'").count() == 3


def test_words_are_tagged_by_the_first_rule(spark):
    words = "a walking walked early table sensible joyful famous active final glass cars s is 12 . , : ; - ! é Ünder ing Ending élanced x-ing % _s{} zed {".split() + [None]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", annotate.form_tag(F.col("word")).alias("tag"))
    found = {r["word"]: r["tag"] for r in got.collect()}
    by_rules = F.lit(annotate.OTHER_TAG)
    for tag, pattern in reversed(annotate.TAG_RULES):
        by_rules = F.when(F.col("word").rlike(pattern), tag).otherwise(by_rules)
    assert found == {r["word"]: r["tag"] for r in got.select("word", by_rules.alias("tag")).collect()}
    assert (found["Ending"], found["cars"], found["glass"], found["12"]) == ("NNP", "NNS", "NN", "CD")


@pytest.mark.parametrize("share", [0.01, 0.4])
def test_samples_are_kept_by_what_differs(share):
    rng = np.random.default_rng(3)
    n, samples, m = 3, 40, 7
    same = rng.random((n, samples, m)) >= share
    same[1, :, 2] ^= True  # a feature in which most samples leave the row's bin
    packed = surrogates._packed(same, np.array(list("abcdefg")))
    assert (packed["bits"] is None) == (share == 0.01)
    kept, z = surrogates._Same(n, samples, packed), same.astype(float)
    w, rv, u = rng.random((n, samples)), rng.normal(size=(n, samples)), rng.normal(size=(n, m))
    mean = (w[:, :, None] * z).sum(axis=1) / w.sum(axis=1)[:, None]
    found, sums = kept.centred(w, rv, w.sum(axis=1))
    assert np.allclose(found, mean) and np.allclose(sums, (rv[:, :, None] * (z - mean[:, None])).sum(axis=1))
    assert np.allclose(kept.times(u), (z * u[:, None]).sum(axis=2))


def test_blocks_of_a_partition_come_whole():
    rows = [pd.DataFrame({"block": b, "k": range(len(b))}) for b in ([1, 1, 2], [2, 2], [], [2, 5], [7])]
    assert [(b, len(part)) for b, part in surrogates._by_block(iter(rows))] == [(1, 2), (2, 4), (5, 1), (7, 1)]


def test_layouts_keep_the_last_positions_only(spark, monkeypatch, tmp_path):
    import os

    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(f"p{i}", rng.normal(size=3).tolist()) for i in range(40)], "text_id string, vec array<double>")
    folders, real = [], layout.stored

    def spied(df, name):
        kept = real(df, name)
        if name == "spots":
            folders.append(os.path.dirname(kept.inputFiles()[0]).removeprefix("file://").removeprefix("file:"))
        return kept

    monkeypatch.setattr(layout, "stored", spied)
    rows = layout.tsne(points, epochs=3)
    points.write.parquet(f"{tmp_path}/rows")
    assert len(folders) == 4 and [os.path.exists(f) for f in folders] == [False] * 3 + [True] and rows.count() == 40
    with pytest.raises(ValueError, match="no stored table"):
        plan_tables.discard(spark.read.parquet(f"{tmp_path}/rows"))
