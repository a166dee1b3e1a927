"""Training-data operators on small tables against plain re-statements."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordprism.llm import block_neighbours, decontaminate, minhash_dedup, ngram_join, quality_gam, separator_scan, shard_tree, source_mix, substring_dedup, token_coder, token_files, token_ids, url_filter
from wordprism.llm import words as W
from wordprism.llm.components import components

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, source string, size string, tag string, shard int, low long"  # the last names clash on purpose


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ñ", "日本", "don't", "x.y"]
    line = " ".join(rnd.choice(words) for _ in range(30))
    texts = [None, "", "   \n", "one", "one two", "ONE two", "a\u00a0b c", "<|endoftext|> x", "same " * 40, line, line.upper(), line + " more"]
    for _ in range(40):
        new = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))
        texts.append(rnd.choice(["", line + "\n"]) + new)
    texts += [" ".join(rnd.choice(words) for _ in range(9000))]
    near = texts[-1].split(" ")
    near[17] = "changed"
    texts.append(" ".join(near))
    rows = [(i * 3 % 97, t) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[9]), (None, "nothing like it"), (500, texts[9]), (-4, texts[20])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, f"s{(d or 0) % 3}" if d != 6 else None, "x", "y", 1, 2) for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_grams(rows):
    texts = [t for _, t in rows]
    found = W.find(pa.array(texts, pa.string()))
    raw = found.data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(found.start, found.end)]
    assert [words[a:b] for a, b in zip(found.row[:-1], found.row[1:])] == [split(t) for t in texts]
    assert len(set(zip(words, found.hash.tolist()))) == len(set(words)) == len(set(found.hash.tolist()))
    parts = list(W.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), limit=100))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts


def test_tokens_equal_the_library(rows):
    pieces = [" ", "  ", "\n", "a", "Z", "é", "ñ", "1", "'s", "!", "<|endoftext|>", "\u3000", "\u00a0", "日本", "😀", "\x00", "\x1c", "\x85", "\t", "\r\n", "ſ", "²"]
    rnd = random.Random(2)
    texts = [t or "" for _, t in rows] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for plain in (False, True):
        encoder = token_ids.Encoder(token_ids.vocabulary_path(), plain, cache_chunks=50)
        want = [e.ids for e in token_ids.library(token_ids.vocabulary_path(), plain).encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):  # the second time from the cache
            ids, count = encoder.encode(pa.array(texts))
            assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("kind", ["zipf", "plain", "same", "cycle"])
def test_coder_round_trip(kind):
    rnd = np.random.default_rng(3)
    flat = {"zipf": rnd.zipf(1.4, 30000) % 50257, "plain": rnd.integers(0, 65536, 30000), "same": np.zeros(30000), "cycle": np.arange(30000) % 7}[kind].astype(np.uint16)
    blocks = [flat[:4096], flat[4096:4097], flat[4097:8000], flat[8000:8128], flat[8128:12000], flat[:0]]
    coded = token_coder.encode(blocks)
    back = token_coder.decode(coded)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert all((a == b).all() for a, b in zip(token_coder.decode(coded[2:3]), blocks[2:3]))  # blocks are independent
    if kind in ("same", "cycle"):
        assert len(coded[0]) < 1000
    if kind == "zipf":
        assert len(coded[0]) < 2 * 4096
    broken = bytearray(coded[0])
    broken[19] ^= 255
    with pytest.raises(ValueError):
        token_coder.decode([bytes(broken)])


def test_separator_scan(spark, docs, rows, empty):
    library = token_ids.library(token_ids.vocabulary_path(), True)
    want = sorted((d if d is not None else -99, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    got = separator_scan.token_counts(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens) for r in got) == want and all(r.terminated for r in got)
    assert separator_scan.token_counts(empty).count() == 0
    rnd = random.Random(5)
    blocks, whole = [], {}
    for file in range(4):
        ids = [9 if rnd.random() < 0.2 else rnd.randint(10, 20) for _ in range(rnd.randint(1, 60))]
        whole[file] = ids
        at = 0
        for number in range(20):
            size = rnd.randint(0, 8)
            part = ids[at:] if number == 19 else ids[at:at + size]
            blocks.append((file, number, bytearray(np.array(part, "<u2").tobytes())))
            at += len(part)
    got = {(r.file, r.ordinal): (r.start, r.n_tokens, r.terminated) for r in separator_scan.scan(spark.createDataFrame(blocks, "file int, block int, ids binary"), 9).collect()}
    want = {}
    for file, ids in whole.items():
        start = n = 0
        for at, x in enumerate([*ids, None]):
            if x == 9 or x is None and at > start:
                want[file, n] = (start, at - start, x == 9)
                start, n = at + 1, n + 1
    assert got == want


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(300, 16)).astype(np.float32)
    base[40:60] = base[3]
    base[60:64] *= 1e6
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (906, [1.0, 3.0]), (None, rows[5][1]), rows[7], (8, rows[100][1])]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<float>, score string")
    asked = table.where("vec_id % 10 = 0 or vec_id > 900")
    got = {}
    for r in block_neighbours.nearest(table, asked, 5, query_rows=7, tile_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for q in sorted({i for i, _ in good if i % 10 == 0 or i > 900}):
        vec = min(v for i, v in good if i == q)
        best = {}
        for i, v in good:
            if i != q and len(v) == len(vec):
                d = 0.0
                for a, b in zip(vec, v):
                    d += (a - b) * (a - b)
                best[i] = min(best.get(i, np.inf), float(np.sqrt(d)))
        want = [(k + 1, i, d) for k, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:5])]
        assert sorted(got.get(q, [])) == want, q
    assert block_neighbours.nearest(table.limit(0), asked.limit(0)).count() == 0


def brute_groups(rows, k, percent):
    def shingles(text):
        w = split(lower(text))
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) or same_id:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_ngram_join(docs, rows, empty, k, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, k, percent).collect()), key=repr)
    assert got == brute_groups(rows, k, percent)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = f"n{rnd.randrange(40)}"
        rows.append((1000 - i, " ".join(copy)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(frame(spark, rows)).collect())
    assert got == sorted(brute_groups(rows, 3, 90))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (12, 12), (None, 4), *[(100 + i, 101 + i) for i in range(40)]]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark, docs, rows, empty):
    got = shard_tree.shard_documents(docs, 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    where = {}
    assert all(where.setdefault(r.doc_id, r.shard) == r.shard for r in got)
    assert shard_tree.shard_documents(empty).count() == 0
    keys = spark.range(20000)
    for n in range(1, 13):
        both = keys.select(shard_tree.assign(keys.id, shard_tree.layout(n)).alias("a"), shard_tree.assign(keys.id, shard_tree.layout(n + 1)).alias("b"))
        assert both.where(f"a <> b and b <> {n}").count() == 0
    heavy = [(r, k, s, 3.0 if s == 2 else w) for r, k, s, w in shard_tree.layout(8)]
    both = keys.select(shard_tree.assign(keys.id, shard_tree.layout(8)).alias("a"), shard_tree.assign(keys.id, heavy).alias("b"))
    assert both.where("a <> b and b <> 2").count() == 0
    assert abs(both.where("b = 2").count() - 20000 * 3 / 10) < 400
    plan = shard_tree.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix(spark, docs, rows, empty):
    got = source_mix.mixing_plan(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + len(split(r.text))
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = goal - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r.size == len(split(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert source_mix.mix(empty).count() == 0
    clash = docs.select("*", *[F.lit("own").alias(c) for c in ("_source", "source_size", "target", "rate", "copies", "_copy", "_row")])
    back = source_mix.mix(clash)
    assert back.columns == clash.columns and back.schema == clash.schema
    assert sorted(map(repr, back.distinct().collect())) == sorted(map(repr, clash.join(back.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_semi").distinct().select(*clash.columns).collect() + [r for r in back.where("doc_id is null or text is null").distinct().collect()]))
    bare = spark.range(30000).selectExpr("cast(null as long) as doc_id", "case when id % 3 = 0 then 'a' end as source", "concat('w', id, repeat(' x', int(id % 20))) as text")
    for r in source_mix.mixing_plan(bare).selectExpr("source", "target", "size * copies as t").groupBy("source").agg(F.max("target").alias("target"), F.sum("t").alias("t")).collect():
        assert abs(r.t - r.target) < 0.03 * r.target
    many = spark.range(30000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 7 = 0 then 'b' end as source", "repeat('x ', int(id % 20)) as text")
    taken = {r.source: r for r in source_mix.mixing_plan(many).selectExpr("source", "target", "size * copies as t").groupBy("source").agg({"target": "max", "t": "sum"}).collect()}
    assert all(abs(r["sum(t)"] - r["max(target)"]) < 0.03 * r["max(target)"] for r in taken.values())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/x?q#f", "http://a.example.net/de/", "http://notexample.com/de/", "https://x.example.com/de/y", "http://example.com", "http://example.com/de",
            "ftp://a.org/fr/z", "http://org/fr/", "a://b://net/", "http://net", "http://.net/", "http://net./", "http://u@s.net:80/", "x://\nnet/a"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, urls[3], "h")], "page_id long, url string, host string")

    def judge(url, rules):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = lower(rest[:cut]), rest[cut:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        best = max(((len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        return host, path, best[1] if best else None, best[2] if best else "allow"

    many = [*url_filter.RULES, *[("block", f"h{i}.example.com", "/" + "x" * (i % 9)) for i in range(500)]]
    for rules in (url_filter.RULES, many):
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules(spark, rules)).collect()), key=repr)
        want = sorted(((i, *judge(u, rules)) for i, u in [*enumerate(urls), (3, urls[3]), (None, urls[3])]), key=repr)
        assert got == want
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules(spark)).count() == 0
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string"))
    assert none.where("verdict = 'allow' and rule is null").count() == pages.count()


def alnum(text):
    out, word = [], ""
    for c in lower(text) + " ":
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


@pytest.mark.parametrize("shard_words", [1_000_000, 15])
def test_contamination(spark, docs, rows, empty, shard_words):
    long = alnum(rows[[len(t or "") for _, t in rows].index(max(len(t or "") for _, t in rows))][1])
    items = [(1, " ".join(long[100:125])), (2, " ".join(long[110:130])), (3, "one, TWO"), (4, None), (5, "!!"), (6, " ".join(long[200:210])), (7, " ".join(long[200:209]) + " zz"), (1, " ".join(long[300:312])), (8, " ".join(long[400:405])), (None, "one"), (10, "same " * 12)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_hit int")
    windows = {}
    for i, t in items:
        w = alnum(t)
        if w:
            for at in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[at:at + 10]), set()).add(i if i is None else str(i))
    want = []
    for d, t in rows:
        w, hit, names = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in windows:
                    hit |= set(range(at, at + n))
                    names |= windows[tuple(w[at:at + n])]
        want.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), bool(hit)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench, 10, shard_words).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_cuts_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after it come some more words", 5, "k"), (2, item, 5, "k"), (3, "clean", 5, "k"), (4, None, 5, "k")], "doc_id long, text string, n_chars long, extra string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "Before, ! after it come some more words" and got[1].n_chars == len(got[1].text) and got[3].n_chars == 5 and got[1].extra == "k"


def test_token_files(spark, docs, rows, empty):
    library = token_ids.library(token_ids.vocabulary_path(), False)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.encode_documents(docs).collect()))
    start = 0
    for s, d, n, crc in got:
        assert s == start
        start += n
    ids = [d if d is not None else -1000 for _, d, _, _ in got]
    assert ids == sorted(ids)
    want = []
    for d, t in rows:
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((d, len(x), zlib.crc32(x.tobytes())))
    assert sorted([g[1:] for g in got], key=repr) == sorted(want, key=repr)
    assert token_files.encode_documents(empty).count() == 0
    to = token_files.write_coded(docs)
    back = token_files.read_ids(spark.read.schema(token_files._SEGMENT).parquet(to)).collect()
    assert sorted((r.doc_id or -1, library.decode(r.ids[:-1], skip_special_tokens=False)) for r in back) == sorted((d or -1, t or "") for d, t in rows)


def test_quality(spark, docs, empty):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "ma", "ren", "st") for b in ("ing", "er", "a", "ion")]
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.7
        text = ". ".join(" ".join(rnd.choice(words) for _ in range(8)) for _ in range(5)) if good else " | ".join([rnd.choice(words)] * 30) + "!!"
        rows.append((i, text))
        labels.append((i, int(good), "x"))
    labels += [(3, None, "x"), (None, 1, "x"), (5, 7, "x")]
    table, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_gam.train(table, marks)
    got = quality_gam.score_documents(table, model).collect()
    truth = dict((d, q) for d, q, _ in labels[:600])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.doc_id: r.score for r in quality_gam.score_documents(table, quality_gam.train(table, marks)).collect()} == {r.doc_id: r.score for r in got}
    odd = quality_gam.score_documents(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_gam.keep_good(docs, model).columns == docs.columns
    assert quality_gam.score_documents(empty, quality_gam.train(empty, marks)).count() == 0
    flat = quality_gam.train(table, marks.limit(0))
    assert {r.score for r in quality_gam.score_documents(table, flat).collect()} == {0.5}


@pytest.mark.parametrize("shard_words", [400_000, 60])
def test_substring_dedup(docs, rows, empty, shard_words):
    first = {}
    for d, t in rows:
        w = split(t)
        for at in range(len(w) - 12):
            if d is not None:
                key = tuple(w[at:at + 13])
                first[key] = min(first.get(key, d), d)
    want = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for at in range(len(w) - 12):
            if d is not None and first[tuple(w[at:at + 13])] < d:
                gone |= set(range(at, at + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs, shard_words=shard_words).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_holds_no_hot_anchor(spark, monkeypatch):
    """One line in every text, each time between other words: its anchor's passages are never held together."""
    rnd = random.Random(8)
    line = " ".join(f"line{i}" for i in range(15))
    some = lambda n: " ".join(f"v{rnd.randrange(9)}" for _ in range(n))
    rows = [(d, f"{some(8)} {line} {some(8)}") for d in range(1, 300)] + [(300, " ".join([line] * 50)), (-1, line[:-1] + "x")]
    rows += [(7, rows[9][1]), (None, line)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = substring_dedup._dealt(docs.selectExpr("doc_id", "text", "xxhash64(text) tag"), 13, 5, 60).orderBy("anchor", "part", "doc_id")
    held, search = [], substring_dedup._covered

    def spy(found, passages, *rest):
        held.append(sum(len(p) for p in passages.to_pylist()))
        return search(found, passages, *rest)

    monkeypatch.setattr(substring_dedup, "_covered", spy)
    list(substring_dedup._shards(13, 60)(iter(dealt.toArrow().to_batches(max_chunksize=7))))
    assert max(held, default=0) <= 2 * 360 and dealt.where("part is not null").count()
    first = {}
    for d, t in rows:
        for at in range(len(w := split(t)) - 12):
            if d is not None:
                first[tuple(w[at:at + 13])] = min(first.get(tuple(w[at:at + 13]), d), d)
    want = []
    for d, t in rows:
        w = split(t)
        gone = {k for at in range(len(w) - 12) if d is not None and first[tuple(w[at:at + 13])] < d for k in range(at, at + 13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.dedup_substrings(docs, shard_words=60).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_wavelet_and_index():
    rnd = np.random.default_rng(2)
    symbols = rnd.integers(0, 13, 700)
    tree = substring_dedup.WaveletTree(symbols, 13)
    who, at = rnd.integers(0, 13, 200), rnd.integers(0, 701, 200)
    assert tree.rank(who, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(who, at)]


def test_dense_family_is_joined_up_by_few_links(spark, monkeypatch):
    """Texts with one change link with all, texts with two changes only with those: pairs across are many, links needed few."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for spot in ((5 + 3 * i,) if i % 10 == 7 else (5 + 3 * i, 5 + 3 * ((i + 20) % 60))):
            words[spot] = f"new{i}"
        texts.append(" ".join(words))
    sizes, real = [], minhash_dedup.components

    def counted(links):
        sizes.append(links.count())
        return real(links)

    monkeypatch.setattr(minhash_dedup, "components", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    sets = [{tuple(t.split(" ")[k:k + 5]) for k in range(196)} for t in texts]
    name = list(range(60))
    for _ in range(60):
        name = [min(name[j] for j in range(60) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in range(60)]
    assert found == dict(enumerate(name)) and len(set(name)) == 1
    assert max(sizes) <= 2 * len(texts)
