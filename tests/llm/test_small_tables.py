"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import chat_format, decontamination, exact_dedup, language_id, language_model, ngram_join, packing, quality, toxicity, url_filter
from furrow.llm.prefix_tree import link_sets
from furrow.llm.text_arrays import buffers, shingles, words
from furrow.operators import components

random = np.random.default_rng(12)
VOCABULARY = ["The", "cat", "sat", "on", "a", "mat", "éclair", "ñandú", "x", "quick-brown", "Ünder", "l'eau"]


def text(n):
    return " ".join(random.choice(VOCABULARY, n).tolist())


LONG = text(30_000)
BASE = text(60)
TEXTS = [None, "", " \t\n", "one", "one two", "ONE two", BASE, BASE, BASE + " end", "start " + BASE, BASE.replace("cat", "dog", 1), text(60), LONG, LONG, LONG + " tail", "日本語 text", "a\u00a0b"]


def table(spark, texts=TEXTS, first=0):
    """Texts with ids, a null id, a repeated row, and columns whose names operators use themselves."""
    rows = [(first + i, t) for i, t in enumerate(texts)] + [(None, "null id"), (first + 6, texts[6] if len(texts) > 6 else "r")]
    clash = ("digest", "salt", "bucket", "k1", "n", "gram", "score", "gone_id", "hit_id", "slot", "label", "id")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in clash})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# words and shingles


def test_words_and_shingles_of_whole_texts():
    data, offsets = buffers(pa.array(TEXTS))
    of, hashes = words(data, offsets)
    spelled = [w for t in TEXTS for w in tokens(t)]
    assert [len(tokens(t)) for t in TEXTS] == np.bincount(of, minlength=len(TEXTS)).tolist()
    assert len(set(zip(spelled, hashes.tolist()))) == len(set(spelled)) == len(set(hashes.tolist()))
    _, at = shingles(of, hashes, 4, len(TEXTS))
    want = [len({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))}) if w else 0 for w in map(tokens, TEXTS)]
    assert np.diff(at).tolist() == want


# 1 chat formatting

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 0, "system", "a"), (3, 0, "user", "</s>[INST] ok [/INST]"), (3, 1, "assistant", "\\ <|end|><|turn|> \\\\ <s</s>"),
    (4, 0, None, "no role"), (4, None, "user", "first"), (5, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "x"), (6, 0, "a<|text|>b", LONG), (7, 0, "system", ""), (7, 1, "user", "é日"), (7, 2, "assistant", "ß\n"),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_chats(df).withColumn("turns", chat_format.parse_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    found = {r.conv_id: r for r in out.collect()}
    for conv in {c[0] for c in CHATS}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        r = found[conv]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        for s in r.segments[1::3]:
            assert not any(c in s.text for c in chat_format.ChatTemplate().controls)
    assert [found[k].valid for k in (1, 2, 3, 4, 5, 6, 7)] == [True, False, True, False, False, False, True]
    assert [found[k].bad_turn for k in (2, 5)] == [1, 1] and found[7].complete and not found[5].complete
    assert chat_format.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(close="\\")


def test_chat_format_is_native(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4 exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.unhex(F.lit("00"))])
def test_copies_even_when_digests_collide(spark, digest):
    df = table(spark)
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r.text or ""].append(-1 if r.doc_id is None else r.doc_id)
    want = collections.Counter()
    for t, ids in groups.items():
        for i in ids:
            want[(i, max(ids), len(ids), i == max(ids))] += 1
    found = exact_dedup.exact_dedup(df, digest=digest).collect()
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept) for r in found) == want
    if digest is exact_dedup.sha256_of:
        assert all(bytes(r.digest).hex() in {hashlib.sha256((t or "").encode()).hexdigest() for t in groups} for r in found)
        kept = exact_dedup.drop_copies(df)
        assert kept.columns == df.columns and kept.select("text").distinct().count() == kept.select("doc_id", "text").distinct().count()
        assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# 6 n-gram join


def brute_join(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = {i: i for i in sets}
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if v == high else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(count):
    out = []
    base = text(80).split()
    for _ in range(count):
        w = list(base)
        for _ in range(int(random.integers(0, 8))):
            w[int(random.integers(0, len(w)))] = f"w{random.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"n": 5, "num": 80}, {"bucket_grams": 200, "order_size": 10}])
def test_joined_components(spark, options):
    docs = table(spark, TEXTS + near_copies(40) + [BASE + " " + text(20) for _ in range(5)])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, **options).collect()}
    want = brute_join([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], options.get("n", 4), options.get("num", 85), 100)
    assert found.pop(None) == (1, None)
    assert found == want
    if not options:
        kept = ngram_join.keep_one_of_each(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}
        assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_prefix_tree_equals_all_pairs():
    for _ in range(60):
        sets = []
        for _ in range(int(random.integers(1, 5))):
            base = random.choice(300, int(random.integers(1, 90)), replace=False)
            for _ in range(int(random.integers(1, 7))):
                s = set(base.tolist()) ^ set(random.integers(0, 300, int(random.integers(0, 6))).tolist())
                sets.append(np.array(sorted(s or {1}), np.uint64))
        label = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[i] if v == label[j] else v for v in label]
        got = link_sets(sets, 85, 100).tolist()
        assert [got.index(v) for v in got] == [label.index(v) for v in label]


def test_components_of_edges(spark):
    edges = [(int(a), int(b)) for a, b in random.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)]
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


# 8 decontamination


def test_passages_are_found_and_quotes_are_not(spark):
    item = "the heron stood by the old stone bridge while seven grey barges drifted slowly towards the harbour mouth at dusk"
    other = "quarterly figures of the northern mills show a steady rise in output although prices of raw wool fell again"
    edited = item.replace("seven", "sevn").replace("slowly", "slowlyy")
    inside = [item, f"{LONG} {item} {LONG}", item.upper().replace(" ", "!! "), edited, f"x {other}. {item}\n", "  ".join(item.split()), item[10:105]]
    outside = [None, "", "the heron stood by the old stone bridge", text(50), LONG, " ".join(reversed(item.split()))]
    docs = table(spark, inside + outside)
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "short"), (5, item)], "item_id long, text string")
    for block in (1_000_000, 150):
        hits = {(r.doc_id, r.item_id): r for r in decontamination.find_contamination(docs, bench, block_chars=block).collect()}
        assert set(hits) == {(k, i) for k in range(len(inside)) for i in (1, 5)} | {(4, 2)}
        assert hits[0, 1].edits == 0 and hits[3, 1].edits > 0
        r = hits[1, 1]
        assert "stone bridge while seven" in (inside[1].lower()[r.start : r.end])
    left = decontamination.drop_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(inside), len(inside) + len(outside))) | {None} and left.columns == docs.columns
    assert decontamination.find_contamination(empty(spark), bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).count() == 0


# 9 packing


def test_every_token_has_one_place(spark):
    docs = table(spark)
    lengths = (16, 64, 256, 1024)
    rows = packing.pack_documents(docs, lengths=lengths, group_pieces=10).collect()
    counts = collections.Counter()
    bins = collections.defaultdict(list)
    for r in rows:
        counts[r.doc_id] += r.n_tokens
        bins[r.bin_id].append((r.place, r.n_tokens, r.bin_length))
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tokens(r.text)) + 1
    assert counts == want
    for pieces in bins.values():
        pieces.sort()
        assert all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(pieces)) and pieces[0][0] == 0
        used = sum(p[1] for p in pieces)
        assert {p[2] for p in pieces} == {min(x for x in lengths if x >= used)}
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_fills_bins():
    sizes = np.minimum(8192, np.exp(random.normal(5.5, 1.2, 5000)).astype(int) + 1)
    bin_, place, length = packing.pack(sizes)
    used = np.bincount(bin_, sizes)
    capacity = np.zeros(len(used), int)
    capacity[bin_] = length
    assert (used <= capacity).all() and used.sum() / capacity.sum() > 0.99
    assert [len(x) for x in packing.pack(np.zeros(0, np.int64))] == [0, 0, 0]


# 7 language model


def brute_scores(train, texts):
    """Modified Kneser-Ney over bigrams, from the definition."""
    sents = [tokens(t) + [None] for t in train]
    c, bi = collections.Counter(w for s in sents for w in s), collections.Counter(p for s in sents for p in zip([0, *s[:-1]], s))

    def discounts(values):
        n = [sum(v == k for v in values) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y, 0.0), k) for k in (1, 2, 3)]

    d = discounts(bi.values())
    ends = collections.Counter(v for _, v in bi)
    e = discounts(ends.values())
    rest = sum(e[min(n, 3)] for n in ends.values()) / max(1, len(bi)) if bi else 1.0
    total, left = collections.Counter(), collections.Counter()
    for (u, _), n in bi.items():
        total[u] += n
        left[u] += d[min(n, 3)]

    def p(u, v):
        alone = max(ends[v] - e[min(ends[v], 3)], 0) / max(1, len(bi)) + rest / (len(c) + 1)
        n = bi[u, v]
        return (n - d[min(n, 3)]) / total[u] + left[u] / total[u] * alone if total[u] else alone

    n_all = sum(c.values())
    out = []
    for t in texts:
        s = tokens(t) + [None]
        out.append((len(s), sum(c[w] > 0 for w in s), n_all, sum(math.log10((c[w] + 0.1) / (n_all + 0.1 * (len(c) + 1))) for w in s), sum(math.log10(p(u, v)) for u, v in zip([0, *s[:-1]], s))))
    return out, p, c


@pytest.mark.parametrize("shards", [None, 1, 37])
def test_kneser_ney_equals_its_definition(spark, shards):
    train, scored = table(spark, TEXTS[:14]), table(spark, [*TEXTS, "cat unseen mat", "unseen unheard"])
    model = language_model.train_language_model(train, shards=shards)
    rows = scored.select("text").collect()
    want, p, c = brute_scores([r.text for r in train.select("text").collect()], [r.text for r in rows])
    assert sum(p("cat", w) for w in c) + p("cat", "never") == pytest.approx(1.0)
    got = [tuple(r)[1:6] for r in language_model.score_texts(scored, model).collect()]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9)


def test_language_model_without_texts(spark):
    model = language_model.train_language_model(empty(spark))
    assert all(r.score == 0 and r.base_score == pytest.approx(0) for r in language_model.score_texts(table(spark), model).collect())
    assert language_model.score_texts(empty(spark), model).count() == 0


# 2, 3, 10 classifiers


def test_unseen_misspellings_are_toxic(spark):
    bad = ["idiots", "moronic", "scumbag"]
    docs = [(i, text(40) + (f" {bad[i // 3 % 3]} {bad[(i // 3 + 1) % 3]}" if i % 3 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(df, labels)
    probe = table(spark, [text(40), text(20) + " idiotz " + text(20), text(20) + " scumbagg " + text(20), None, "", " ", LONG])
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, model).collect()}
    assert score[1] > 0.5 and score[2] > 0.5 and max(score[k] for k in (0, 3, 4, 5, 6)) < 0.5
    assert all(0 <= s <= 1 for s in score.values())
    for own in (labels.where("toxic = 1"), labels.limit(0)):
        one = toxicity.train_toxicity(df, own)
        assert {round(r.score) for r in toxicity.score_toxicity(probe, one).collect()} == {int(own.count() > 0)}
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_languages(spark):
    words_of = {"en": "the and with that house water".split(), "de": "und der mit dass Häuser Wasser".split(), "es": "y el con que niño agua".split()}
    rows = [(i, " ".join(random.choice(words_of[k], 30).tolist()), k) for i, k in enumerate(list(words_of) * 40)] + [(999, "odd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_language_model(df)
    assert model.languages == ("de", "en", "es")
    probe = table(spark, ["the water and that house", "mit dem Wasser und der", "el niño con agua", None, "", "12 34 !!", "\n", LONG, "日本"])
    found = {r.doc_id: r for r in language_id.predict_language(probe, model).collect()}
    assert [found[k].lang_pred for k in range(7)] == ["en", "de", "es", "und", "und", "und", "und"]
    assert all(found[k].score == 0 for k in range(3, 7)) and found[8].lang_pred != "und" and all(0 <= r.score <= 1 for r in found.values())
    kept = language_id.keep_languages(probe, model)
    assert kept.columns == probe.columns and {r.doc_id for r in kept.collect()} & set(range(7)) == {0, 1, 2}
    nothing = language_id.train_language_model(df.limit(0))
    assert {r.lang_pred for r in language_id.predict_language(probe, nothing).collect()} == {"und"}
    assert language_id.predict_language(empty(spark), model).count() == 0


def test_quality_ranks_unseen_texts(spark):
    good = [(i, ". ".join(text(12) for _ in range(6))) for i in range(150)]
    bad = [(1000 + i, " ".join((w + "!!!").upper() for w in text(60).split()) if i % 2 else " ".join([text(3)] * 20)) for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality")).where("doc_id % 5 > 0")
    model = quality.train_quality(df, labels)
    found = {r.doc_id: r.score for r in quality.score_quality(df, model).collect()}
    held = [i for i in found if i % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i < 1000) for i in held]) > 0.95
    odd = quality.score_quality(table(spark), model).collect()
    assert len(odd) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in odd)
    for own, want in ((labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0), (labels.limit(0), 0)):
        one = quality.train_quality(df, own)
        assert {round(r.score) for r in quality.score_quality(df.limit(5), one).collect()} == {want}
    assert quality.score_quality(empty(spark), model).count() == 0


# 5 url filter

RULES = [url_filter.Rule(*r) for r in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"))]
URLS = [
    ("http://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"), ("https://EXAMPLE.com/en/71?x=1", "example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"), ("x://example.net/de/8#f", "example.net", "/de/8", "example.net/de/8", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("example.com/en/7", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("http://", "", "", None, None), ("a://b://c/en/", "b:", "//c/en/", None, None), ("http://host?q=/en/", "host", "", None, None), ("http://com/en/", "com", "/en/", "com/en/", "block"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(None, None), (0, URLS[0][0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    labelled = pages.withColumn("verdict", url_filter.best_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), RULES)["verdict"])
    found = collections.defaultdict(list)
    for r in url_filter.judge_urls(pages, url_filter.train_url_model(labelled), RULES).collect():
        found[r.page_id].append(r)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        for r in found[i]:
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("block", "allow") and (verdict is None or r.verdict == verdict)
    assert len(found[0]) == 2 and len(found[None]) == 1
    assert url_filter.judge_urls(pages.limit(0), url_filter.train_url_model(labelled.limit(0)), RULES).count() == 0


def test_trees_learn_lexical_features():
    urls = [f"https://site{k}.org/{'a/' * (k % 3)}page" for k in range(200)] + [f"http://x{k}.win/{k * 7919}?a={k}&b=2&c=3" for k in range(200)]
    blocked = np.repeat([0.0, 1.0], 200)
    model = url_filter.fit(urls[::2], blocked[::2])
    assert ((model.probability(urls[1::2]) >= 0.5) == blocked[1::2]).mean() > 0.97
    assert (url_filter.fit(urls, np.ones(400)).probability([None, "x"]) > 0.5).all() and (url_filter.fit([], np.zeros(0)).probability([None]) < 0.5).all()


def test_folds_follow_crc32(spark):
    from furrow.llm.shared import fold

    rows = spark.range(200).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
