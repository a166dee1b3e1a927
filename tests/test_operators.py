"""Hand cases, edge cases and invariants on small literal tables."""

import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordprism.functions import text as tx
from wordprism.functions.geometry import in_polygon
from wordprism.operators import annotate, catalog, classify, embed, explain, geometry, layout, neighbours, regions, sample, select, stats, surrogates, svm, topics, views
from wordprism.operators import tokens as tk
from wordprism.sources import corpus, tokenmap
from wordprism.sources.stopwords import stop_words

TEXTS = "text_id string, ord long, text string, processed_text string, label string, topic string"


def texts(spark, *rows):
    return spark.createDataFrame([(f"t_{i}", i, t, None, label, None) for i, (t, label) in enumerate(rows)], TEXTS)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_spans_cut_the_text_exactly(spark):
    long = " ".join(f"wörd{i}," for i in range(500))
    data = texts(spark, ("The  cat-fish\n sat.", "a"), ("", "a"), (long, "b"), ("   ", "b"))
    spans = tk.token_spans(data, neighbours=True).join(data.select("text_id", "text"), "text_id")
    bad = spans.where(F.expr("substring(text, start + 1, end - start) <> token"))
    assert bad.count() == 0
    assert rows(spans.where("text_id = 't_0'"), "pos", "token", "start", "end")[:3] == [
        (0, "The", 0, 3), (1, "cat", 5, 8), (2, "-", 8, 9)]
    assert spans.where("text_id = 't_2'").count() == 1000
    chain = {r["pos"]: r for r in spans.where("text_id = 't_2'").collect()}
    assert all(chain[p]["after"] == chain[p + 1]["token"] and chain[p + 1]["before"] == chain[p]["token"] for p in range(999))


def test_token_predicates(spark):
    values = ["3d5", "1,000", "12", "1st", "1stfoo", "80s", "1980s", "abc", "-5", "ß"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = {r["t"]: (r["n"], r["o"], r["d"], r["l"]) for r in df.select(
        "t", tx.is_number("t").alias("n"), tx.is_ordinal("t").alias("o"), tx.is_decade("t").alias("d"), tx.has_letter("t").alias("l")).collect()}
    assert got["3d5"] == (True, False, False, True)
    assert got["1,000"][0] and got["12"][0] and got["-5"][0] and not got["abc"][0]
    assert got["1stfoo"][1] and got["1980s"][2] and got["80s"][2]
    assert not got["ß"][3]


def test_stop_words_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_bytes(b"foo\r\nbar\r\n")
    words = {r["word"] for r in stop_words(spark, str(path)).collect()}
    assert {"foo", "bar", "the", "monday", "may"} <= words
    kept = tk.content_tokens(tk.tokens(texts(spark, ("The foo ran on Monday 1st", "a"))), stop_words(spark, str(path)))
    assert rows(kept, "token") == [("ran",)]


def test_map_and_normalise(spark):
    df = spark.createDataFrame([("the été the the", "ÀÉî")], "a string, b string")
    row = df.select(tx.map_text("a", {"the": "THE", "THE": "x$1", "t": "no"}).alias("m"), tx.normalize_text("b").alias("n")).first()
    assert row["m"] == "x$1 été x$1 x$1" and row["n"] == "aei"


def test_highlight_drops_overlaps(spark):
    data = texts(spark, ("abcdef", "x"), ("plain", "x"))
    spans = spark.createDataFrame([("t_0", 0, 3), ("t_0", 2, 4), ("t_0", 4, 5), ("t_0", 4, 5)], "text_id string, start int, end int")
    assert rows(views.highlighted(data, spans), "html") == [("ab<mark>cd</mark><mark>e</mark>f",), ("plain",)]


@pytest.mark.parametrize(("sizes", "n", "expected"), [
    ([10, 10, 10], 9, [3, 3, 3]), ([10, 10, 10], 10, [4, 4, 2]), ([2, 10, 10], 12, [2, 5, 5]),
    ([2, 10, 10], 13, [2, 6, 5]), ([10, 10, 10, 10], 5, [2, 2, 1, 0]),
])
def test_quota_numbers(sizes, n, expected):
    assert sample.quota_numbers(sizes, n) == expected


def test_quota_too_large():
    with pytest.raises(ValueError):
        sample.quota_numbers([1, 1, 1], 4)


def test_sampling_and_split(spark):
    data = texts(spark, *[("x", label) for label, size in (("a", 50), ("b", 6), ("c", 5), ("d", 2), ("e", 1)) for _ in range(size)])
    assert sample.stratified(data, 20).count() == 20
    split = sample.train_test(data, 5)
    got = {r["class"]: (r["train"], r["test"]) for r in sample.split_report(split).collect()}
    assert got == {"a": (45, 5), "b": (1, 5), "c": (4, 1), "d": (1, 1), "e": (1, 0), "total": (52, 12)}
    firsts = rows(split.where("part = 'test' and label in ('c', 'd')"), "text_id")
    assert firsts == [("t_56",), ("t_61",)]


def test_frequency_filters(spark):
    flat = spark.createDataFrame([(f"w{i}", 5) for i in range(80)], "token string, frequency long")
    assert stats.iqr_filter(flat, 3).count() == 0
    assert stats.zipf_filter(flat).count() == 70
    words = [(f"w{i:03d}", f) for i, f in enumerate([1, 4, 5, 6, 7, 8, 9, 10, 11, 200, 5000])]
    df = spark.createDataFrame(words, "token string, frequency long")
    inner = np.log10([f for _, f in words if 3 < f < 5000])
    q1, q3 = np.quantile(inner, [0.25, 0.75])
    low, high = max(3, 10 ** (q1 - 0.1 * (q3 - q1))), min(5000, 10 ** (q3 + 1.5 * (q3 - q1)))
    expected = sorted((t,) for t, f in words if low < f < high)
    assert rows(stats.iqr_filter(df, 3), "token") == expected
    assert rows(stats.zipf_filter(df), "token") == expected


def test_alignment(spark):
    data = texts(spark, ("a well-known cat", "x"))
    tags = annotate.words(data).withColumn("tag_desc", F.lit("d")).withColumn("entity", F.lit(None).cast("string"))
    got = rows(annotate.align(tk.token_spans(data), tags.where("word <> 'cat'")), "token", "tag_word")
    assert ("known", "well-known") in got and ("well", "well-known") in got
    tokens = annotate.align(tk.token_spans(data), tags.where("word <> 'cat'")).where("token = 'cat'").first()
    assert tokens["tag_word"] is None and tokens["tag_idx"] is None


def test_word_tokens_equal_the_general_alignment(spark):
    many = " ".join(["state-of-the-art, - it's x--y -z well-known-", "été-ñ 3-4 _a-b_", "a-", "(b-c)"] * 40)
    data = texts(spark, (many, "x"), ("", "x"), (None, "x"), ("-", "x"), ("a-b", "y"), ("  lead-in \n-\n end-", "y"))
    tags = annotate.named_entities(annotate.pos_tags(annotate.numbered_words(data, ("label",)), annotate.lexicon(spark), annotate.tag_names(spark)))
    got = annotate.word_tokens(tags)
    columns = ("text_id", "pos", "token", "start", "end", "tag_idx", "tag_word", "tag_desc", "tag_start", "tag_end")
    general = annotate.align(tk.token_spans(data), annotate.pos_tags(annotate.words(data), annotate.lexicon(spark), annotate.tag_names(spark)))
    assert rows(got, *columns) == rows(general, *columns) and got.where("label is null").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Window" not in plan and "Exchange range" not in plan


def test_entities_by_run(spark):
    data = texts(spark, ("we met New York City and Paris", "x"))
    tagged = annotate.pos_tags(annotate.words(data), annotate.lexicon(spark), annotate.tag_names(spark))
    names = spark.createDataFrame([("new york city", "GPE")], "name string, entity string")
    got = {r["word"]: r["entity"] for r in annotate.named_entities(tagged, names).collect()}
    assert got == {"we": None, "met": None, "New": "GPE", "York": "GPE", "City": "GPE", "and": None, "Paris": "NAME"}


def test_pooling_of_empty_text(spark):
    data = texts(spark, ("", "x"), ("cat", "x"))
    pooled = {r["text_id"]: r["vec"] for r in embed.mean_pool(embed.encode_hashed(data), 8, data).collect()}
    assert pooled["t_0"] == [0.0] * 8 and any(pooled["t_1"])
    assert embed.resolve_layers([-1, 0], 13) == [12, 0]


@pytest.mark.parametrize("width", [1, 8, 768])
def test_pooling_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    x, mask = rng.normal(size=(30, width)), (rng.random(30) > 0.3).astype(float)
    mask[20:24] = 0.0  # a text whose tokens are all masked
    owner = [f"t_{0 if i < 20 else 1 if i < 24 else 2}" for i in range(30)]
    rows_ = [(owner[i], 3, float(mask[i]), [float(v) for v in x[i]]) for i in range(30)] + [("t_2", 3, 1.0, None)]
    data = spark.createDataFrame(rows_, "text_id string, layer int, m double, vec array<double>").repartition(3)
    everyone = spark.createDataFrame([("t_0",), ("t_1",), ("t_2",), ("t_9",)], "text_id string")
    pooled = embed.mean_pool(data, width, everyone, mask=F.col("m"))
    got = {r["text_id"]: r["vec"] for r in pooled.collect()}
    for text, part in (("t_0", slice(0, 20)), ("t_2", slice(24, 30))):
        assert np.allclose(got[text], (x[part] * mask[part, None]).sum(axis=0) / mask[part].sum())
    assert got["t_1"] == got["t_9"] == [0.0] * width
    assert "Generate" not in pooled._jdf.queryExecution().executedPlan().toString()


def holds(x, y, corners):
    """Even-odd rule, border included."""
    odd = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("cells", [1, 4, 32])
def test_many_polygons(spark, cells):
    rng = np.random.default_rng(cells)
    shapes = {f"r{i}": [(float(a), float(b)) for a, b in np.round(8 * (rng.normal(size=(int(rng.integers(3, 9)), 2)) * 2 + rng.normal(size=2))) / 8] for i in range(60)}
    shapes |= {"square": [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], "closed": [(0.0, 0.0), (2.0, 0.0), (1.0, 2.0), (0.0, 0.0)], "line": [(-1.0, -1.0), (1.0, 1.0)], "dot": [(0.5, 0.5)],
               "comb": [(0.0, 0.0), (5.0, 0.0), (5.0, 3.0), (4.0, 1.0), (3.0, 3.0), (2.0, 1.0), (1.0, 3.0)]}
    points = [(float(a), float(b)) for a, b in np.vstack([np.round(rng.normal(size=(150, 2)) * 24) / 8, rng.integers(-2, 6, (60, 2)) / 2])] + [(99.0, 0.0)]
    table = spark.createDataFrame([(i, x, y, "own", 7) for i, (x, y) in enumerate(points)] + [(900, None, 1.0, "x", 7), (901, float("nan"), 1.0, "x", 7)], "id int, x double, y double, polygon string, cx int")
    polygons = spark.createDataFrame([*shapes.items(), ("none", []), ("null", None), ("nan", [(0.0, float("nan")), (1.0, 1.0), (9.0, 9.0)])], "polygon string, corners array<struct<x:double,y:double>>")
    got = regions.in_polygons(table, polygons, cells)
    assert sorted(got.columns) == ["cx", "id", "polygon", "x", "y"]
    assert rows(got, "id", "polygon") == sorted((i, p) for i, (x, y) in enumerate(points) for p, c in shapes.items() if holds(x, y, c))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert regions.in_polygons(table, polygons.where("false"), cells).count() == 0
    assert regions.in_polygons(table.where("false"), polygons, cells).count() == 0


def silhouette_by_hand(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = [j for j, l in enumerate(labels) if l == own and j != i]
        if not same:
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, [j for j, l in enumerate(labels) if l == o]].mean() for o in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


def test_silhouette_over_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[10] = x[11]
    labels = ["a"] * 40 + ["b"] * 19 + ["c"]
    df = spark.createDataFrame([(f"p{i:02d}", labels[i], x[i].tolist()) for i in range(60)], "text_id string, label string, vec array<double>")
    got = geometry.silhouette(df, block_rows=16).first()["silhouette"]
    assert got == pytest.approx(silhouette_by_hand(x, labels))
    sparse = df.select("text_id", "label", F.sequence(F.lit(0), F.lit(2)).cast("array<long>").alias("idx"), F.col("vec").alias("val"))
    assert geometry.silhouette(sparse, block_rows=16).first()["silhouette"] == pytest.approx(got)
    assert geometry.silhouette(df.withColumn("label", F.lit("a"))).first()["silhouette"] is None


def neighbours_by_hand(names, x, k):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    order = [sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], names[j]))[:k] for i in range(len(x))]
    return [(names[i], r, names[j], d[i, j]) for i, o in enumerate(order) for r, j in enumerate(o, 1)]


@pytest.mark.parametrize("dims, k, cell_rows", [(2, 4, 16), (2, 1, 8), (7, 5, 512), (3, 15, 3), (1, 400, 32)])
def test_nearest_against_all_pairs(spark, monkeypatch, dims, k, cell_rows):
    """Clusters, ties on a grid, equal rows; blocks and visitor groups small enough to be split."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neighbours, "REGION_ROWS", 40)
    monkeypatch.setattr(neighbours, "VISITORS", 20)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(size=(120, dims)) + 9 * (np.arange(120) % 4)[:, None], rng.integers(0, 3, (60, dims)).astype(float), np.ones((25, dims))])
    names = [f"p{i * 7 % len(x):03d}" for i in range(len(x))]
    table = [(n, v.tolist(), "x", 1) for n, v in zip(names, x)] + [("nothing", None, "x", 1), (None, [0.0] * dims, "x", 1)]
    df = spark.createDataFrame(table, "text_id string, vec array<double>, cell string, bound int").repartition(3)
    report = {}
    got = neighbours.nearest(df, k, cell_rows, report)
    expected = neighbours_by_hand(names, x, k)
    assert [r[:3] for r in rows(got, "text_id", "rank", "neighbour", "distance")] == [r[:3] for r in sorted(expected)]
    assert np.allclose([r[3] for r in rows(got, "text_id", "rank", "neighbour", "distance")], [r[3] for r in sorted(expected)])
    assert report["rows"] == len(x)
    if (dims, cell_rows) == (2, 8):
        assert report["visits"] < len(x) * report["cells"] / 2 and report["copies"] < report["visits"]


def test_nearest_of_few_rows(spark):
    schema = "text_id string, vec array<double>"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([("a", [1.0]), ("b", None)], schema)).count() == 0
    two = spark.createDataFrame([("b", [1.0]), ("a", [1.0])], schema)
    assert rows(neighbours.nearest(two), "text_id", "rank", "neighbour", "distance") == [("a", 1, "b", 0.0), ("b", 1, "a", 0.0)]


def test_projections(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 4)) + 6 * k for k in range(2)])
    df = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(x)], "text_id string, vec array<double>")
    got = np.array([(r["x"], r["y"]) for r in geometry.pca(df).orderBy("text_id").collect()])
    c = x - x.mean(axis=0)
    _, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(got.std(axis=0) * math.sqrt(60), s[:2]) and abs(got.mean()) < 1e-9
    for method in (layout.tsne, layout.umap):
        placed = np.array([(r["x"], r["y"]) for r in method(df, epochs=20).orderBy("text_id").collect()])
        assert np.isfinite(placed).all() and len(placed) == 60
        assert silhouette_by_hand(placed, [0] * 30 + [1] * 30) > 0.4


@pytest.mark.parametrize("n, size", [(40, 0.1), (400, 20.0), (3000, 90.0)])
def test_push_against_exact_sums(spark, n, size):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2)) * size / 6 + rng.integers(0, 3, (n, 1)) * size / 4
    spots = spark.createDataFrame([(i, *map(float, v), 0.0, 0.0, 1.0, 1.0) for i, v in enumerate(x)], layout._FIELDS)
    pushed, total = layout.repulsion(spots)
    got = np.array([(r["px"], r["py"]) for r in pushed.orderBy("node").collect()])
    d = x[:, None] - x[None]
    near = 1 / (1 + (d**2).sum(-1))
    exact = (d * near[..., None] ** 2).sum(axis=1)
    assert abs(total - (near.sum() - n)) < 0.01 * (near.sum() - n)
    assert np.sqrt(((got - exact) ** 2).sum() / (exact**2).sum()) < 0.01


def test_tsne_settles(spark, monkeypatch):
    monkeypatch.setattr(layout, "EARLY", 10)
    monkeypatch.setattr(layout, "CHECKED", 8)
    monkeypatch.setattr(layout, "SETTLED", 0.05)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(40, 5)) + 8 * k for k in range(3)])
    df = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "text_id string, vec array<double>")
    report = {}
    placed = np.array([(r["x"], r["y"]) for r in layout.tsne(df, perplexity=10, report=report).orderBy("text_id").collect()])
    seen = report["divergence"]
    assert seen[-1] < 0.7 * seen[0] and report["epochs"][-1] < layout.MOST_EPOCHS - 1
    assert seen[-2] - seen[-1] < layout.SETTLED * seen[-1]
    assert silhouette_by_hand(placed, [0] * 40 + [1] * 40 + [2] * 40) > 0.6


def test_layouts_of_few_rows(spark):
    schema = "text_id string, vec array<double>"
    for method in (layout.tsne, layout.umap):
        assert method(spark.createDataFrame([], schema)).count() == 0
        assert rows(method(spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], schema)), "text_id", "x", "y") == [("a", 0.0, 0.0)]
        same = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)
        placed = method(same, epochs=2).collect()
        assert len(placed) == 3 and all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in placed)


def test_polygon(spark):
    shape = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]
    cases = [(1, 1, True), (2, 3, False), (2, 2, True), (4, 4, True), (0, 2, True), (5, 1, False), (3, 3, True)]
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in cases], "x double, y double, e boolean")
    assert df.where(in_polygon("x", "y", shape) != F.col("e")).count() == 0


def selection(spark, **views_):
    return spark.createDataFrame([(v, t, None, None) for v, ids in views_.items() for t in ids] or [], "view string, text_id string, start int, end int")


@pytest.mark.parametrize(("views_", "loose", "strict"), [
    ({}, [], []),
    ({"word": "ab"}, ["a", "b"], ["a", "b"]),
    ({"lasso": "ab", "text": "bc"}, ["b"], ["b"]),
    ({"lasso": "ab", "class": "cd"}, [], []),
    ({"lasso": "ab", "class": "cd", "word": "xa"}, ["a", "x"], []),
])
def test_intersection_fold(spark, views_, loose, strict):
    rows_ = selection(spark, **{k: list(v) for k, v in views_.items()})
    assert [t for (t,) in rows(select.intersect(rows_), "text_id")] == loose
    assert [t for (t,) in rows(select.intersect(rows_, strict=True), "text_id")] == strict


def test_sankey_and_nodes(spark):
    scores = [("a", f"t{i}", float(i)) for i in range(8)] + [("b", f"t{i}", 1.0) for i in range(8)] + [("c", "t0", -1.0), ("c", "t1", 0.5)]
    attribution = spark.createDataFrame(scores, "class string, token string, score double")
    links = views.sankey_links(attribution)
    assert rows(links.where("class = 'a'"), "token") == [(f"t{i}",) for i in range(3, 8)]
    assert rows(links.where("class <> 'a'"), "class", "token") == [("c", "t1")]
    nodes = {(r["type"], r["node"]): r["fixed_value"] for r in views.sankey_nodes(links, attribution.select("class")).collect()}
    assert nodes["class", "b"] == 0.25 and nodes["class", "a"] is None and ("token", "t1") in nodes


def test_pages(spark):
    data = texts(spark, *[("x", "a")] * 21)
    got = rows(views.pages(data), "page", "label", "has_previous", "has_next")
    assert got == [(0, "1-10", False, True), (1, "11-20", True, True), (2, "21-21", True, False)]
    assert rows(views.page(data, 2), "row", "text_id") == [(21, "t_20")]
    assert views.pages(data.limit(0)).count() == 0


def test_names_round_trip(spark):
    names = ["ds-10_text.npz", "ds-10_BERT_token_info.npz", "ds-10_BERT-b8_sentence_proj-PCA.npz",
             "ds-10_BERT-b100_class_explanation-LIME.npz"]
    parsed = catalog.parse_names(spark.createDataFrame([(n,) for n in names], "name string"))
    built = catalog.artifact_name(*[F.col(c) for c in ("dataset", "model", "layer", "kind", "method")])
    assert parsed.where(F.concat(built, F.lit(".npz")) != F.col("name")).count() == 0
    assert {r["layer"] for r in parsed.collect()} == {None, 8, 100}


def test_store_keeps_what_others_wrote(spark, tmp_path):
    root = str(tmp_path)
    for dataset, label in (("one", "a"), ("two", "b")):
        catalog.save_texts(texts(spark, ("x", label)), root, dataset)
    point = spark.createDataFrame([("t_0", 8, "PCA", 1.0, 2.0)], "text_id string, layer int, method string, x double, y double")
    score = spark.createDataFrame([(8, "PCA", 0.5)], "layer int, method string, sh double")
    for layer in (8, 12):
        catalog.save_projection(point.withColumn("layer", F.lit(layer)), score.withColumn("layer", F.lit(layer)), root, "one", "m")
    got = rows(catalog.stored_artifacts(spark, root).na.fill(-1).na.fill(""), "dataset", "kind", "layer", "method")
    assert got == [("one", "sentence", 8, "PCA"), ("one", "sentence", 12, "PCA"), ("one", "text", -1, ""), ("two", "text", -1, "")]
    assert rows(catalog.scan(spark, root, "text", dataset="one"), "label") == [("a",)]


def test_missing_token_is_an_error(spark):
    a = spark.createDataFrame([("x", "known", 1.0), ("x", "lost", 1.0)], "class string, token string, score double")
    o = spark.createDataFrame([("known", "t_0")], "token string, text_id string")
    with pytest.raises(Exception, match="lost"):
        catalog.tokens_of_explanation(a, o).collect()


def small_model(spark):
    """Three texts, six tokens, two classes."""
    rng = np.random.default_rng(11)
    x = np.round(rng.random((3, 6)) * (rng.random((3, 6)) > 0.3), 3)
    w = np.round(rng.normal(size=(2, 6)), 3)
    values = [(f"t_{i}", f"k{j}", float(x[i, j])) for i in range(3) for j in range(6) if x[i, j]]
    coef = [(c, f"k{j}", float(w[i, j])) for i, c in enumerate("ab") for j in range(6)]
    model = classify.LinearModel(
        spark.createDataFrame(coef, "class string, token string, weight double"),
        spark.createDataFrame([("a", 0.2, -1.5, 0.1), ("b", -0.1, -1.0, 0.0)], "class string, bias double, a double, b double"),
    )
    data = texts(spark, ("x", "a"), ("x", "b"), ("x", "a"))
    return x, w, spark.createDataFrame(values, "text_id string, token string, value double"), model, data


def prob(x, w):
    p = 1 / (1 + np.exp(np.array([-1.5, -1.0]) * (x @ w.T + [0.2, -0.1]) + [0.1, 0.0]))
    return p / p.sum(axis=-1, keepdims=True)


def shapley_walks(x, w, called, permutations):
    """Mean logit steps along the given orders of the tokens, for rows that turn from each background row into ``x[i]``."""
    logit = lambda p: np.log(p / (1 - p))
    phi = np.zeros(x.shape)
    for i, c in enumerate(called):
        f = lambda s: logit(np.mean([prob(np.where(np.isin(range(x.shape[1]), s), x[i], bg), w)[c] for bg in x]))
        for order in permutations:
            for at, j in enumerate(order):
                phi[i, j] += (f(order[:at + 1]) - f(order[:at])) / len(permutations)
    return phi


@pytest.mark.parametrize("n", [1, 10])
def test_shap_walks_the_permutations(spark, n):
    x, w, values, model, data = small_model(spark)
    predictions = classify.predict(values, data, model)
    called = [int(p.argmax()) for p in prob(x, w)]
    orders = [sorted(range(6), key=lambda j: hashlib.md5(f"1537:{p}:k{j}".encode()).hexdigest()) for p in range(n)]
    got = {(r["text_id"], r["token"]): r["phi"] for r in surrogates.permutation_shap(values, predictions, model, n).collect()}
    expected = shapley_walks(x, w, called, orders)
    for i in range(3):
        mean = np.mean([prob(bg, w)[called[i]] for bg in x])
        full = prob(x[i], w)[called[i]]
        own = [got.get((f"t_{i}", f"k{j}"), 0.0) for j in range(6)]
        assert own == pytest.approx(expected[i], abs=1e-9)
        assert sum(own) == pytest.approx(np.log(full / (1 - full)) - np.log(mean / (1 - mean)), abs=1e-9)


def test_shap_tends_to_shapley_values(spark):
    x, w, values, model, data = small_model(spark)
    predictions = classify.predict(values, data, model)
    exact = shapley_walks(x, w, [int(p.argmax()) for p in prob(x, w)], list(itertools.permutations(range(6))))
    got = {(r["text_id"], r["token"]): r["phi"] for r in surrogates.permutation_shap(values, predictions, model, 400).collect()}
    assert np.abs([[got.get((f"t_{i}", f"k{j}"), 0.0) for j in range(6)] for i in range(3)] - exact).max() < 0.02
    assert surrogates.permutation_shap(values, predictions.where("false"), model).count() == 0
    one = surrogates.permutation_shap(values, predictions.limit(1), model)
    assert one.count() == 0  # a row that is its own background


def test_lime_follows_the_weights(spark):
    rng = np.random.default_rng(2)
    x = rng.random((40, 5))
    values = spark.createDataFrame([(f"t_{i}", f"k{j}", float(x[i, j])) for i in range(40) for j in range(5)], "text_id string, token string, value double")
    w = np.array([4.0, -4.0, 0.0, 2.0, 0.0])
    model = classify.LinearModel(
        spark.createDataFrame([(c, f"k{j}", float(s * w[j])) for c, s in (("a", 1), ("b", -1)) for j in range(5)], "class string, token string, weight double"),
        spark.createDataFrame([(c, 0.0, -1.0, 0.0) for c in "ab"], "class string, bias double, a double, b double"),
    )
    data = texts(spark, *[("x", "a")] * 40)
    test = data.where("text_id = 't_0'")
    predictions = classify.predict(values, test, model)
    phi = {r["token"]: r["phi"] for r in surrogates.lime(values, data, predictions, model, samples=2000, block=2).collect()}
    sign = 1 if predictions.first()["predicted"] == "a" else -1
    cuts = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for j in (0, 1):  # being in the outer quarter moves the output the way the weight says
        bin_ = np.searchsorted(cuts[:, j], x[0, j])
        if bin_ in (0, 3):
            assert np.sign(phi[f"k{j}"]) == sign * np.sign(w[j]) * (1 if bin_ == 3 else -1)
    assert len(phi) == 5 and max(abs(phi["k2"]), abs(phi["k4"])) < max(abs(phi["k0"]), abs(phi["k1"]))


def test_scaling_keeps_zeros(spark):
    cells = spark.createDataFrame([("t_0", "a", 2.0), ("t_1", "a", 4.0), ("t_0", "b", 3.0), ("t_2", "b", 6.0)], "text_id string, token string, weight double")
    data = texts(spark, ("x", "p"), ("x", "p"), ("x", "q"))
    scaler = classify.fit_minmax(cells, data.where("ord < 2"), cells.select("token").distinct())
    assert rows(scaler, "token", "lo", "span") == [("a", 2.0, 2.0), ("b", 0.0, 3.0)]
    scaled = rows(classify.apply_minmax(cells, scaler, data), "text_id", "token", "value")
    assert scaled == [("t_0", "a", 0.0), ("t_0", "b", 1.0), ("t_1", "a", 1.0), ("t_2", "a", -1.0), ("t_2", "b", 2.0)]


def test_svm_separates(spark):
    rng = np.random.default_rng(4)
    data = texts(spark, *[("x", "abc"[i % 3]) for i in range(60)])
    values = spark.createDataFrame([(f"t_{i}", f"k{j}", float((j == i % 3) + 0.1 * rng.random())) for i in range(60) for j in range(4)], "text_id string, token string, value double")
    vocab = spark.createDataFrame([(f"k{j}", j) for j in range(4)], "token string, idx long")
    model = classify.fit_svm(values, data, vocab)
    with pytest.raises(RuntimeError, match="gap"):
        classify.fit_svm(values, data, vocab, most_rounds=0)
    predicted = classify.predict(values, data, model)
    assert predicted.where("label <> predicted").count() == 0
    report = stats.class_report(predicted, model.classes)
    assert stats.report_summary(report).first()["f1"] == 1.0


def svm_reference(x, y, c):
    """Weights (the last one is the bias) by projected gradients on the dual of 0.5 |w|^2 + c * hinge, run to the end."""
    x = np.hstack([x, np.ones((len(x), 1))])
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(len(x)), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(60000):
        alpha = np.clip(alpha + step * (1 - gram @ alpha), 0, c)
    return (alpha * y) @ x


@pytest.mark.parametrize("block_cells, c", [(1 << 20, 1.0), (1 << 20, 5.0), (100, 1.0)])
def test_svm_reaches_the_optimum(spark, block_cells, c):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(48, 4)) * (rng.random((48, 4)) > 0.4), 3)
    x[5] = 0.0  # a row without cells
    labels = np.array(["p" if v > 0 else "q" if v > -0.7 else "r" for v in x[:, 0] + 0.4 * rng.normal(size=48)])
    data = texts(spark, *[("x", label) for label in labels], ("x", None))
    cells = [(f"t_{i}", f"k{j}", float(x[i, j])) for i in range(48) for j in range(4) if x[i, j]] + [("t_48", "k0", 9.0), ("other", "k1", 9.0)]
    values = spark.createDataFrame(cells, "text_id string, token string, value double")
    vocab = spark.createDataFrame([(f"k{j}", j) for j in range(4)] + [("unused", 4)], "token string, idx long")
    gap = 1e-3
    fit = svm.fit_dual(values, data, vocab, c=c, gap=gap, block_cells=block_cells)
    weights = {(r["class"], r["token"]): r["weight"] for r in fit.coef.collect()}
    bias = {r["class"]: r["bias"] for r in fit.bias.collect()}
    assert len(weights) == 15 and all(weights[k, "unused"] == 0.0 for k in "pqr")
    for r in fit.gaps.collect():
        k = r["class"]
        assert -1e-9 <= r["primal"] - r["dual"] <= gap * r["primal"]
        best = svm_reference(x, np.where(labels == k, 1.0, -1.0), c)
        off = np.array([*(weights[k, f"k{j}"] for j in range(4)), bias[k]]) - best
        assert off @ off / 2 <= gap * r["primal"] + 1e-6
    checked = rows(svm.certificate(values, data, fit, c=c, gap=gap), "class", "n_rows", "n_own", "within", "bounded", "settled")
    assert checked == [(k, 48, int((labels == k).sum()), True, True, True) for k in "pqr"]
    wrong = fit._replace(coef=fit.coef.withColumn("weight", F.when(F.col("token") == "k0", F.col("weight") + 0.5).otherwise(F.col("weight"))))
    assert svm.certificate(values, data, wrong, c=c, gap=gap).where("within").count() == 0
    with pytest.raises(ValueError, match="label"):
        svm.fit_dual(values, data.where("label is null"), vocab)


def test_sigmoids_settle_at_the_least_loss(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(1.0, 1.0, 40), rng.normal(-1.0, 2.0, 60)])
    hit = np.arange(100) < 40
    table = [("a", float(v), bool(h)) for v, h in zip(m, hit)] + [("b", float(v), bool(v > 0)) for v in m] + [("c", 0.5, True), ("c", 0.5, True)]
    got = {r["class"]: (r["a"], r["b"]) for r in classify.fit_sigmoids(spark.createDataFrame(table, "class string, m double, hit boolean")).collect()}
    for name, own in (("a", hit), ("b", m > 0)):
        t = np.where(own, (own.sum() + 1) / (own.sum() + 2), 1 / ((~own).sum() + 2))

        def slope(a, b):
            p = 1 / (1 + np.exp(a * m + b))
            return abs(((t - p) * m).sum()), abs((t - p).sum())

        assert max(slope(*got[name])) < 1e-3
    assert np.isfinite(got["c"]).all()
    with pytest.raises(RuntimeError, match="settled"):
        classify.fit_sigmoids(spark.createDataFrame(table, "class string, m double, hit boolean"), most_steps=1)


def test_svm_blocks_hold_back_where_they_agreed():
    rows = pd.DataFrame({"text_id": ["t_0", "t_1"], "y": [0, 1], "idx": [[-1], [3]], "val": [[1.0], [1.0]]})
    known = pd.DataFrame({"kind": [0, 0], "idx": [-1, 3], "text_id": None, "v": [[0.0, 0.0]] * 2, "h": [[4.0, 4.0], [1.0, 1.0]]})
    block = svm._Block(rows, known, 2)
    moves, change = block.ascend(1.0, np.array([1.0, 0.0]), 1e-9, (0, 0))
    assert moves.tolist() == [[0.25, 0.0], [1.0, 0.0]]  # as if four blocks moved the first weight; the settled class stays
    assert change.tolist() == [[0.25, 0.0], [-1.0, 0.0]]
    block.w[:, 0], block.alpha[:, 0] = [1.0, -1.0], 1.0
    assert not np.any(block.ascend(1.0, np.array([1.0, 0.0]), 1e-9, (1, 0))[0])


def test_queries_predict_and_explain_with_the_svm(spark, monkeypatch):
    """k0 separates the classes; k1 moves the class centroids but says less."""
    from wordprism.queries import explain as queries
    from wordprism.registry import QUERIES

    points = [("a", 0.0, 0.0)] * 30 + [("a", 0.0, 1.0)] * 10 + [("b", 0.4, 1.0)] * 30 + [("b", 0.4, 0.0)] * 10
    points += [("a", 0.0, 0.0), ("a", 0.0, 1.0), ("b", 0.4, 1.0), ("b", 0.4, 0.0)]
    values = spark.createDataFrame([(f"t_{i}", k, v) for i, p in enumerate(points) for k, v in zip(("k0", "k1"), p[1:]) if v], "text_id string, token string, value double")
    split = spark.createDataFrame([(f"t_{i}", p[0], i, "train" if i < 80 else "test") for i, p in enumerate(points)], "text_id string, label string, ord long, part string")
    s = queries.Setting(values.select("token").distinct(), None, split, None, values)
    model = queries.svm_model(s)
    monkeypatch.setattr(queries, "setting", lambda *_: s)
    monkeypatch.setattr(queries, "svm_model", lambda _: model)  # fitted once
    assert rows(QUERIES["ml_predict"](spark, "").where("label <> predicted"), "text_id") == [("t_81",), ("t_83",)]
    assert QUERIES["ml_svm_predict"](spark, "").where("label = predicted and predicted_prob > 0.5").count() == 4
    assert rows(QUERIES["agg_svm_class_report"](spark, ""), "class", "f1", "support") == [("a", 1.0, 2), ("b", 1.0, 2)]
    assert QUERIES["agg_svm_report_summary"](spark, "").first()["accuracy"] == 1.0
    phi = {(r["text_id"], r["token"]): r["phi"] for r in QUERIES["ml_svm_shap"](spark, "").collect()}
    assert phi["t_81", "k0"] > abs(phi["t_81", "k1"]) and phi["t_83", "k0"] > abs(phi["t_83", "k1"])
    monkeypatch.setattr(surrogates, "lime", functools.partial(surrogates.lime, samples=500))
    scores = {(r["method"], r["class"], r["token"]): r["score"] for r in QUERIES["snk_svm_explanation"](spark, "").collect()}
    assert len(scores) == 8 and all(scores[m, c, "k0"] > scores[m, c, "k1"] for m in ("LIME", "SHAP") for c in "ab")


def test_reports_with_a_class_nobody_called(spark):
    p = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "a")], "label string, predicted string")
    report = {r["class"]: r for r in stats.class_report(p, spark.createDataFrame([("a",), ("b",)], "class string")).collect()}
    assert report["b"]["precision"] == 0.0 and report["a"]["recall"] == 1.0 and report["a"]["accuracy"] == pytest.approx(2 / 3)


def test_nmf_loss_does_not_rise(spark):
    rng = np.random.default_rng(6)
    cells = [(f"t_{i}", f"k{j}", j, float(v)) for i in range(30) for j, v in enumerate(rng.random(8) * (rng.random(8) > 0.4)) if v]
    matrix = spark.createDataFrame(cells, "text_id string, term string, idx long, weight double")
    terms = spark.createDataFrame([(f"k{j}", j, 1) for j in range(8)], "term string, idx long, df long")
    components, _, losses = topics.fit_nmf(matrix, terms, 2)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    assert topics.topic_words(components).count() == 2
    with pytest.raises(RuntimeError, match="settled"):
        topics.fit_nmf(matrix, terms, 2, 6)


def test_infidelity_of_exact_attribution_is_small(spark):
    x, w, values, model, data = small_model(spark)
    predictions = classify.predict(values, data, model)
    none = spark.createDataFrame([], "text_id string, token string, phi double")
    per_row = explain.infidelity(values, predictions, none, model)
    assert per_row.count() == 3 and per_row.where("infidelity < 0 or infidelity > 0.01").count() == 0


# --- sources --------------------------------------------------------------------


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('ID,TITLE,ABSTRACT,Computer Science,Physics,Mathematics,Statistics,Quantitative Biology,Quantitative Finance\n'
                    '1," A ","two\nlines ""q"" ",0,1,1,0,0,0\n2,B,C,0,0,0,0,0,0\n')
    got = rows(corpus.abstracts_csv(spark, str(path)), "text_id", "text", "label")
    assert got == [("PaperAbstract_1", 'A two\nlines "q"', "physics"), ("PaperAbstract_2", "B C", "compsci")]
    path = tmp_path / "reviews.csv"
    path.write_text("Id,Score,Text\n1,2,\"it''s\"\n2,3,ok\n3,,none\n")
    got = rows(corpus.reviews_csv(spark, str(path)), "text_id", "text", "label")
    assert got == [("AmazonFoodReviews_1", 'it"s', "bad"), ("AmazonFoodReviews_2", "ok", "good")]


def test_folder_and_stories(spark, tmp_path):
    for name, text in (("sport/001", "a\n\nb "), ("sport/002", ""), ("tech/001", "x" * 5000), ("tech/002", "x" * 5001)):
        file = tmp_path / "root" / f"{name}.txt"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = rows(corpus.folder_corpus(spark, str(tmp_path / "root"), tokens=spark.createDataFrame([(0, "a", "z")], "ord int, key string, value string")), "text_id", "label", "text")
    assert got == [("BBCNews_sport_001", "sport", "z b"), ("BBCNews_tech_001", "tech", "x" * 5000)]
    path = tmp_path / "stories.txt"
    path.write_text(" one \ntwo\n<|endoftext|>\nthree\n\n<|endoftext|>\nlost\n")
    got = rows(corpus.delimited_stories(spark, str(path)), "text_id", "text")
    assert got == [("TinyStories_3", "onetwo"), ("TinyStories_6", "three")]


def test_one_file_per_row(spark, tmp_path):
    from wordprism.sources.folders import write_folders

    data = [("a b c", "x+1", "one\ntwo", 1), ("a b c", "né.w", "", 2), ("é", "z", None, 3), ("é", "100%", "x" * 30, 4)]
    df = spark.createDataFrame(data, "folder string, name string, text string, extra int").repartition(3)
    for root in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        write_folders(df, root)
        write_folders(df.limit(1), root)  # a task that runs again
        got = rows(corpus.folder_corpus(spark, root, prefix="p"), "text_id", "label", "text")
        assert got == [("p_a b c_x+1", "a b c", "one two"), ("p_é_100%", "é", "x" * 30)]
    assert len(list((tmp_path / "one").glob("*/*.txt"))) == 4
    with pytest.raises(Exception, match="no name"):
        write_folders(spark.createDataFrame([("a/b", "x", "y")], "folder string, name string, text string"), str(tmp_path / "three"))


def test_token_map(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_text("a  b\nc\na\td\n")
    read = tokenmap.token_map(spark, str(path))
    assert rows(read, "ord", "key", "value") == [(0, "a", "b"), (1, "c", ""), (2, "a", "d")]
    hand = spark.createDataFrame([("a c ac", "t$1")], "x string, y string")
    assert tokenmap.replace_words(hand, "x", read).first()["x"] == "d  ac"
    assert tokenmap.replace_words(hand, "x", read.limit(0)).first()["x"] == "a c ac"
    odd = spark.createDataFrame([(0, "a", "x$1\\"), (1, "ac", "\\E")], "ord int, key string, value string")
    assert tokenmap.replace_words(hand, "x", odd).first()["x"] == "x$1\\ c \\E"
    path.write_text("a b c\n")
    with pytest.raises(Exception, match="two fields"):
        tokenmap.token_map(spark, str(path)).collect()


def test_silhouette_leaves_out_points_without_label(spark):
    from wordprism.operators.geometry import silhouette

    points = [("a", "x", [0.0, 0.0]), ("b", "x", [0.0, 1.0]), ("c", "y", [40.0, 0.0]), ("d", "y", [40.0, 1.0])]
    kind = "text_id string, label string, vec array<double>"
    plain = silhouette(spark.createDataFrame(points, kind)).first()
    assert silhouette(spark.createDataFrame([*points, ("e", None, [0.0, 0.5])], kind)).first() == plain
    assert plain.n == 4 and plain.n_classes == 2


def test_texts_without_words_stay(spark):
    from wordprism.operators.tokens import prepared_texts, prepared_words
    from wordprism.operators.topics import assign_topics

    texts = spark.createDataFrame([("a", "Blue sky blue"), ("b", "12 !"), ("c", "")], "text_id string, text string")
    assert dict(prepared_texts(prepared_words(texts), texts).collect()) == {"a": "blue sky", "b": "", "c": ""}
    mixed = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0)], "text_id string, topic int, weight double")
    names = spark.createDataFrame([(0, "none"), (1, "sky")], "topic int, name string")
    assert dict(assign_topics(mixed, names, texts).collect()) == {"a": "sky", "b": "none", "c": "none"}


def test_package_travels_as_an_archive(spark):
    import zipfile

    from wordprism.session import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert {"wordprism/__init__.py", "wordprism/session.py", "wordprism/operators/svm.py"} <= set(names) and all(n.endswith(".py") for n in names)
