"""Phrases, importance resampling and b-bit MinHash on small tables against plain re-statements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from wordprism.llm import importance_resample as R
from wordprism.llm import minhash_dedup as M
from wordprism.llm import phrase_mining as P
from wordprism.llm import words as W

#: columns beside doc_id, text and lang clash with names that the operators use
DOCS = "doc_id long, text string, lang string, n long, node string, weight string, rank string, k string, phrase string, score string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, 1, "x", "x", "x", "x", "x", "x") for d, t, g in rows], DOCS)


def corpus(seed=3, size=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "ñ", "日本", "don't", "New", "YORK", "x y"]
    phrase = ["New York city", "of the  united\tstates", "in. order; to"]
    rows = []
    for i in range(size):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts.append(rnd.choice(phrase) if rnd.random() < 0.3 else rnd.choice(words))
            parts.append(rnd.choice([" ", " ", " ", ", ", "\n", "  ", "\t"]))
        rows.append((i * 5 % 61, "".join(parts), rnd.choice(["en", "de", None])))
    long = " ".join(rnd.choice(words) for _ in range(30000))
    rows += [(700, long, "en"), (701, None, "en"), (702, "", None), (703, " \n.;", "de"), (704, "one", "en"), (None, rows[3][1], "en"), (None, "no id here", None)]
    rows += [rows[0], rows[0], (5, "other text of the same id " * 5, "de")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def phrases_of(rows, least, longest, covered, top):
    counts, sizes = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i:i + k])] += 1
    wanted = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in wanted.items():
        if any(
            g == lang and len(w) > len(words) and 100 * b >= covered * a and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))
            for (g, w), b in wanted.items()
        ):
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        row = (-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]])
        out.setdefault(lang, []).append(row)
    return [
        (lang, rank, p.decode(), -a, x, y, sizes[lang], -s)
        for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)
    ]


@pytest.mark.parametrize("least, longest, covered, top, counters", [(3, 4, 80, 2000, 1 << 19), (2, 5, 60, 7, 4), (5, 2, 80, 50, 1), (2, 3, 101, 2000, 8)])
def test_phrases_against_plain_counts(docs, rows, least, longest, covered, top, counters):
    got = [tuple(r) for r in P.mine_phrases(docs, least, longest, covered, top, counters=counters).collect()]
    assert got and sorted(got) == sorted(phrases_of(rows, least, longest, covered, top))


def test_phrases_of_nothing(spark, empty):
    assert P.mine_phrases(empty).count() == 0
    assert P.mine_phrases(frame(spark, [(1, None, None), (2, "", "en"), (3, "too few words", "en")])).count() == 0


def test_hot_phrase_and_exact_products(spark):
    docs = frame(spark, [(i, "hot phrase " * 300, "en") for i in range(200)])
    top = P.mine_phrases(docs, counters=2).where("phrase = 'hot phrase'").collect()
    assert P.mine_phrases(docs, counters=2, factor=10**15).count()
    longer = P.frequent_phrases(docs).where("k = 2").collect()
    assert {(r.phrase, r.f) for r in longer} == {("hot phrase", 60000), ("phrase hot", 59800)} and not top


def test_summary_keeps_every_frequent_item():
    rnd = np.random.default_rng(1)
    stream = np.concatenate([rnd.integers(0, 1 << 62, 40000), np.repeat(np.arange(50), rnd.integers(28, 40, 50)), np.zeros(9000, np.int64)]).astype(np.uint64)
    rnd.shuffle(stream)
    values, counts = np.unique(stream, return_counts=True)
    frequent = set(values[counts >= 30].tolist())
    for capacity in (8, 300, 2 * len(stream) // 30, 1 << 17):
        summary = P.Summary(30, capacity)
        for part in np.array_split(stream, 37):
            summary.add(*np.unique(part, return_counts=True))
        assert frequent <= set(summary.survivors().tolist())
        assert summary.taken < 30 and (summary.capacity == capacity or capacity <= len(stream) // 30)
        assert capacity < 1 << 17 or set(summary.survivors().tolist()) == frequent


def test_filter_has_no_false_negative(spark):
    grams = W.mix(np.arange(5000, dtype=np.uint64))
    table = P.survivor_filter(spark.createDataFrame([(int(g),) for g in grams.view(np.int64)], "gram long"))
    assert table.has(grams).all() and table.has(W.mix(np.arange(5000, 25000, dtype=np.uint64))).mean() < 0.05
    assert not P.survivor_filter(spark.createDataFrame([], "gram long")).has(grams).any()


def test_crcs_from_prefixes(rows):
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        assert R.running_crcs(data[:n]).tolist() == [zlib.crc32(data[:i].tobytes()) for i in range(n + 1)]
    texts = [t for _, t, _ in rows]
    n_words, found = R.feature_crcs(pa.array(texts, pa.string()), 3)
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    assert n_words.tolist() == [len(w) for w in split]
    for k, crcs in enumerate(found, 1):
        assert crcs.tolist() == [zlib.crc32(" ".join(w[i:i + k]).encode()) for w in split for i in range(len(w) - k + 1)]


def importance_of(rows, target, percent, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(" ".join(x) for x in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))))
    out = []
    for doc, text, _ in rows:
        words, buckets = features(text)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(buckets), weight, score, len(words) >= least))
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0], out[i][1], out[i][2]))
    rank = {i: k for k, i in enumerate(order[:percent * len(order) // 100], 1)}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


@pytest.mark.parametrize("percent, least", [(25, 20), (60, 1), (0, 3), (100, 5)])
def test_importance_against_plain_sums(spark, docs, rows, percent, least):
    target = ["New York city of the united states", None, "", "日本 Été"]
    table = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = [tuple(r) for r in R.importance(docs, table, percent, least).collect()]
    assert sorted(got, key=repr) == sorted(importance_of(rows, target, percent, least), key=repr)


def test_importance_of_nothing(spark, docs, empty):
    assert R.importance(empty, docs).count() == 0
    rows = R.importance(docs, empty, least_words=1).collect()
    assert len(rows) == docs.count() and sum(r.rank is not None for r in rows) == 25 * sum(r.n_features > 0 for r in rows) // 100


def test_resample_returns_whole_rows(docs):
    target = docs.where("lang = 'de'")
    drawn = {r.doc_id for r in R.importance(docs, target).where("rank is not null").collect()}
    got = R.resample(docs, target)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == drawn - {None}


def shingles(text, k):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", lower(text)) if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def groups_of(rows, k, percent):
    sets = [shingles(t, k) for _, t, _ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    name = lambda i: least.get(root(i)) if sets[i] else rows[i][0]
    return [(rows[i][0], len(sets[i]), name(i), name(i) is None or rows[i][0] == name(i)) for i in range(len(rows))]


def near_copies(seed=9):
    rnd = random.Random(seed)
    rows = list(corpus(seed))
    words = [f"v{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    for i in range(60):  # one family: chains of small edits, so that only paths hold it together
        base = list(base)
        base[rnd.randrange(300)] = rnd.choice(words)
        rows.append((1000 + 7 * i % 60, " ".join(base), "en"))
    for i in range(40):  # a family just below the threshold
        text = [rnd.choice(words) if rnd.random() < 0.02 else w for w in base]
        rows.append((2000 + i, " ".join(text), "en"))
    rows += [(None, " ".join(base) + " end", "en"), (None, "unnamed pair of words here", "en"), (None, "Unnamed pair of words here", "en")]
    return rows


@pytest.mark.parametrize("shingle, percent, crowd", [(5, 85, 512), (3, 85, 3), (1, 60, 512)])
def test_groups_against_all_pairs(spark, monkeypatch, shingle, percent, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    rows = near_copies()
    bands, size = (38, 5) if percent == 85 else (60, 2)
    got = [tuple(r) for r in M.near_duplicates(frame(spark, rows).repartition(3), shingle, percent, bands, size).collect()]
    assert sorted(got, key=repr) == sorted(groups_of(rows, shingle, percent), key=repr)


def test_groups_of_nothing(spark, empty):
    assert M.near_duplicates(empty).count() == 0
    got = M.near_duplicates(frame(spark, [(3, None, "en"), (None, "", "en"), (4, " ", "en")])).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(3, 0, 3, True), (None, 0, None, True), (4, 0, 4, True)]))


def test_estimate_is_corrected_for_chance(spark):
    rnd = np.random.default_rng(2)
    n = 1024
    for share in (0.3, 0.6, 0.85):
        common = rnd.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
        rest = rnd.integers(0, 1 << 63, 2000 - len(common)).astype(np.uint64)
        half = len(rest) // 2
        sets = [np.unique(np.concatenate([common, rest[:half]])), np.unique(np.concatenate([common, rest[half:]]))]
        for bits in (1, 2, 4):
            planes = M.packed(M.minima(sets, n), bits).view(np.int64).tolist()
            row = spark.createDataFrame([tuple(planes)], "x array<long>, y array<long>")
            got = row.select(M.estimate(M.matches(row.x, row.y, n, bits), n, bits)).first()[0]
            assert abs(got - share) < 0.07
    assert M.least_matches(190, 2, 85) < 190 * (0.85 + 0.15 / 4)
