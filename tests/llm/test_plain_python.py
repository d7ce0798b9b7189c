"""The numpy kernels against the same formulas in plain Python, text by text."""

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import language_id, packing, quality, toxicity, url_filter
from furrow.llm.text_arrays import buffers
from tests.llm.test_small_tables import LONG, TEXTS, empty, table, tokens

BLANK = re.compile(r"[\x20\x09-\x0D]")
random = np.random.default_rng(31)


def gram_hash(chars):
    """FNV-like steps over code points, finalised; 32 bits."""
    h = (0x811C9DC5 + 0x9E3779B1 * len(chars)) & 0xFFFFFFFF
    for c in chars:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        h ^= h >> 15
    h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
    return h ^ (h >> 13)


# 2 toxicity


def words_of(text):
    return [w for w in BLANK.sub(" ", (text or "").lower()).split(" ") if w]


def toxic_grams(text, sizes, buckets):
    """{bucket: weight}: each word's n-grams, spaces around it included, share its part of the mean."""
    out = collections.Counter()
    words = words_of(text)
    for w in words:
        grams = [f" {w} "[k : k + n] for n in sizes for k in range(len(w) + 3 - n) if len(w) + 3 - n > 0]
        for g in grams:
            out[gram_hash(g) & (buckets - 1)] += toxicity.SCALE / len(grams) / len(words)
    return out


def test_toxicity_is_a_mean_of_means():
    sizes, buckets = (3, 4, 5), 1 << 10
    model = toxicity.ToxicityModel(random.normal(size=buckets), 0.3, sizes)
    texts = [t for t in TEXTS if t != LONG and (t is None or len(t) < 10_000)]
    got = toxicity.score_texts(model, *buffers(pa.array(texts)))
    for t, p in zip(texts, got):
        logit = sum(w * model.weight[b] for b, w in toxic_grams(t, sizes, buckets).items()) + model.bias
        assert p == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-9)
    doc, bucket, weight = toxicity._rows(*buffers(pa.array(texts)), sizes, buckets)
    for i, t in enumerate(texts):
        assert dict(zip(bucket[doc == i].tolist(), weight[doc == i].tolist())) == pytest.approx(dict(toxic_grams(t, sizes, buckets)))


def test_toxicity_trains_alike_whatever_the_partitions(spark):
    rows = [(i, " ".join(random.choice(["calm", "kind", "rude", "vile"], 6).tolist())) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.col("text").contains("vile").cast("int").alias("toxic"))
    one, many = (toxicity.train_toxicity(docs.repartition(n), labels) for n in (1, 7))
    assert np.allclose(one.weight, many.weight) and one.bias == pytest.approx(many.bias)


# 3 language id


def language_grams(text, sizes, buckets):
    s = " " + BLANK.sub(" ", (text or "").lower()) + " "
    for n in sizes:
        for k in range(len(s) - n + 1):
            g = s[k : k + n]
            blank = " " in g[1:2] if n > 2 else g[0] == g[-1] == " "
            if not blank:
                yield gram_hash(g) & (buckets - 1)


def test_language_posterior_is_naive_bayes(spark):
    docs = {"en": "the water and that old house", "de": "das Wasser und der alte Häuser", "es": "el agua y la niña"}
    rows = [(i, t, k) for i, (k, t) in enumerate(list(docs.items()) * 3)]
    sizes, buckets, smoothing = (1, 2, 3), 1 << 8, 0.5
    model = language_id.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=buckets)
    counts = {k: collections.Counter(g for _, t, own in rows if own == k for g in language_grams(t, sizes, buckets)) for k in docs}
    log = {k: [math.log((counts[k][b] + smoothing) / (sum(counts[k].values()) + smoothing * buckets)) for b in range(buckets)] for k in docs}
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + list(docs.values()) + ["nin 123", "1 2", "ß"]
    names, score = language_id.score_texts(model, *buffers(pa.array(texts)))
    for t, name, p in zip(texts, names, score):
        total = {k: sum(log[k][g] for g in language_grams(t, sizes, buckets)) for k in sorted(docs)}
        best = max(total, key=total.get)
        if not any(c.isalpha() for c in t or ""):
            assert (name, p) == ("und", 0)
        else:
            assert name == best and p == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), rel=1e-4)


# 5 url filter


def plain_lexical(url):
    url = (url or "").encode()
    scheme, found, rest = url.partition(b"://")
    host, path, tail = re.match(rb"(?s)([^/?#]*)([^?#]*)(.*)", rest).groups()
    query = tail.partition(b"#")[0][1:] if tail.startswith(b"?") else b""
    n = max(1, len(url))
    lower = bytes(c + 32 if 65 <= c < 91 else c for c in url)
    letter = [48 <= c < 58 or 97 <= c < 123 or c >= 128 for c in lower]
    parts = [p for p in path.split(b"/") if p]
    labels = bytes(c + 32 if 65 <= c < 91 else c for c in host).split(b".")
    entropy = [-sum(v / len(x) * math.log2(v / len(x)) for v in collections.Counter(x).values()) if x else 0.0 for x in (url, host)]
    runs = [len(list(g)) for k, g in itertools.groupby(letter) if k]
    values = [
        len(url), len(host), len(path), len(labels), len(parts), sum(48 <= c < 58 for c in url) / n, url.count(b"-") / n, letter.count(False) / n, *entropy,
        len([p for p in query.split(b"&") if p]), b"#" in url, bool(found) and lower.startswith(b"https://") or lower == b"https", max(runs, default=0),
    ]
    first = parts[0] if parts else b""
    return [float(v) for v in values], (labels[-1], b".".join(labels[-2:]), first, (labels[-1], first))


def urls(count):
    letters = list("aB1-_.:/?#&=é") + ["://", "http://", "https://", "www.", "/en/", "?a=", "&b="]
    return [None, "", "https", "://", "a://b", "http://x.y.z/a//b/?&p=1&&q#f?&r", *("".join(random.choice(letters, int(random.integers(1, 14))).tolist()) for _ in range(count))]


def test_lexical_features_equal_their_definition():
    some = urls(600)
    features, keys = url_filter.lexical(*buffers(pa.array(some, pa.large_string())))
    spelled = [plain_lexical(u) for u in some]
    for u, got, (want, _) in zip(some, features, spelled):
        assert got.tolist() == pytest.approx(want), u
    for k in range(len(url_filter.SUFFIXES)):
        pairs = {(int(h[k]), s[k]) for h, (_, s) in zip(keys, spelled)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert [len(x) for x in url_filter.lexical(*buffers(pa.array([], pa.large_string())))] == [0, 0]


def test_every_verdict_is_the_longest_rules_or_the_trees(spark):
    rules = [url_filter.Rule(*r) for r in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("allow", "a.org", "/"), ("block", "org", "/a/"))]
    made = [f"{s}://{h}{p}{q}" for s, h, p, q in itertools.product(("http", "X"), ("com", "Example.COM", "b.example.com", "notexample.com", "example.net", "a.org", "org"), ("", "/en/", "/en/7", "/de/8", "/es/", "/a/b"), ("", "?x=/en/", "#/de/"))]
    some = made + urls(200) + ["http://com/en/" + "x" * 200_000]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    labelled = pages.withColumn("verdict", url_filter.best_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), rules)["verdict"])
    model = url_filter.train_url_model(labelled)
    score = model.probability(some)
    found = {r.page_id: r for r in url_filter.judge_urls(pages, model, rules).collect()}
    assert len(found) == len(some)
    for i, u in enumerate(some):
        _, has, rest = (u or "").partition("://")
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups() if has else ("", "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        assert r.verdict == (best.verdict if best else "block" if score[i] >= 0.5 else "allow") and r.score == pytest.approx(score[i])


# 9 packing


def plain_pack(sizes, lengths, cost, look):
    """Best fit by looking at every open bin and every size still to come."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    coming = collections.Counter(sizes)
    bins, rooms = [], collections.defaultdict(list)
    for i in order:
        size = sizes[i]
        coming[size] -= 1
        fitting = sorted(r for r, own in rooms.items() if own and r >= size)
        if fitting:
            have = fitting[0]
            b = rooms[have].pop()
        else:
            price = {}
            for c in lengths:
                if c >= size:
                    room, filled = c - size, size
                    for s in sorted((s for s, n in coming.items() if n > 0), reverse=True):
                        if s <= room and price.setdefault(("looks", c), 0) < look:
                            price["looks", c] += 1
                            take = min(coming[s], room // s)
                            room, filled = room - take * s, filled + take * s
                    price[c] = cost(c) / filled
            have = min((p, c) for c, p in price.items() if not isinstance(c, tuple))[1]
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        rooms[have - size].append(b)
    return sorted((min(c for c in lengths if c >= sum(sizes[i] for i in own)), sorted(sizes[i] for i in own)) for own in bins)


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_best_fit(seed):
    draw = np.random.default_rng(seed)
    lengths = tuple(sorted({int(v) for v in draw.integers(8, 120, 4)}))
    sizes = draw.integers(1, lengths[-1] + 1, int(draw.integers(1, 120)))
    if seed % 3 == 0:
        sizes = np.minimum(sizes, 1 + sizes // 7)  # many ties
    look = int(draw.integers(1, 7))
    bin_, place, length = packing.pack(sizes, lengths, packing.attention_cost, look)
    got = sorted((int(length[bin_ == b][0]), sorted(sizes[bin_ == b].tolist())) for b in range(bin_.max() + 1))
    assert got == plain_pack(sizes.tolist(), lengths, packing.attention_cost, look)
    for b in range(bin_.max() + 1):
        own = np.flatnonzero(bin_ == b)
        own = own[np.argsort(place[own])]
        assert place[own].tolist() == np.concatenate([[0], np.cumsum(sizes[own])[:-1]]).tolist()


def test_packing_of_ties_and_repeats(spark):
    docs = table(spark, ["a b c"] * 30 + ["a"] * 30 + [None, "", "x " * 40])
    rows = packing.pack_documents(docs, lengths=(4, 8, 16), group_pieces=16).collect()
    bins = collections.Counter()
    for r in rows:
        bins[r.bin_id] += r.n_tokens
    assert all(used <= 16 for used in bins.values()) and sum(bins.values()) == sum(len(tokens(r.text)) + 1 for r in docs.collect())
    assert collections.Counter(r.doc_id for r in rows)[62] == 3 and packing.pack_documents(empty(spark)).count() == 0


# 10 quality


def plain_features(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
    letters = max(1, sum(map(len, words)))
    symbols = {c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|"}

    def share(kind):
        return sum(c in kind for c in raw) / letters

    def again(keys):
        return 1 - len(set(keys)) / len(keys) if keys else 0.0

    lines = []
    for line in raw.split(b"\n"):
        own = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in re.split(rb"[\x20\x09-\x0D]+", line) if w]
        if own:
            lines.append(tuple(sorted(own)))
    some = max(1, len(words))
    caps = sum(len(w) >= 2 and sum(65 <= c < 91 for c in w) >= 0.8 * len(w) for w in words)
    return [
        math.log1p(len(words)), sum(map(len, words)) / some, share(range(65, 91)), share(range(48, 58)), share(symbols), share(b".,;:?"), share(b"!"), share(b"|"), share(range(128, 256)),
        raw.count(b"\n") / some, again(low), again(lines), again(list(zip(low, low[1:]))), sum(len(w) > 15 for w in words) / some, caps / some,
    ]


def test_quality_features_equal_their_definition():
    pieces = ["The", "cat", "SAT", "on,", "a", "mat!", "|", "x9", "\n", "\n", "\t", " ", "éé", "extraordinarilylongword", "--", "#@", "AB"]
    texts = [*TEXTS[:12], *(" ".join(random.choice(pieces, int(n)).tolist()) for n in random.integers(1, 60, 60)), "a\nb\na\nb a\na b", "\n\n", "x\n"]
    got = quality.features(*buffers(pa.array(texts)))
    for t, row in zip(texts, got):
        assert row.tolist() == pytest.approx(plain_features(t), abs=1e-9), repr(t)


def test_quality_score_is_a_weighted_sum_of_hinges(spark):
    x = random.normal(size=(300, 15))
    label = (x[:, 0] + 0.3 * x[:, 3] > 0.2).astype(int)
    model = quality.fit(x, label, float(label.mean()))
    for row, p in zip(x[:40], model.probability(x[:40])):
        wide = list(row) + [max(0.0, row[k] - h) for k, own in enumerate(model.knots) for h in own]
        raw = sum((v - m) / s * w for v, m, s, w in zip(wide, model.mean, model.scale, model.weight))
        assert p == pytest.approx(1 / (1 + math.exp(-(raw - model.threshold) / model.spread)))
    assert np.mean((model.probability(x) >= 0.5) == label) > 0.95
    pairs = [(a, b) for a in np.flatnonzero(label)[:60] for b in np.flatnonzero(1 - label)[:60]]
    raw = model.raw(x)
    assert np.mean([raw[a] > raw[b] for a, b in pairs]) > 0.97


def test_quality_learns_from_every_labelled_text(spark):
    """More texts of a class than any sample took; the few of the other class are copied to several blocks."""
    texts = [" ".join(["word"] * int(n)) + "." for n in random.integers(1, 400, 9000)] + [" ".join(["BUY!"] * int(n)) for n in random.integers(1, 400, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = df.select("doc_id", (F.col("doc_id") < 9000).cast("int").alias("quality"))
    model = quality.train_quality(df, labels)
    x = quality.features(*buffers(pa.array(texts)))
    assert model.mean[:15].tolist() == pytest.approx(x.mean(axis=0).tolist(), abs=1e-9)
    wide = quality._expand(x, model.knots)
    assert (model.scale**2 * (model.scale != 1)).tolist() == pytest.approx(np.where(model.scale != 1, wide.var(axis=0), 0).tolist(), abs=1e-9)
    ranked = np.sort(x[:, 0])
    assert model.knots[0].tolist() == pytest.approx(np.unique([ranked[int(q * 9199 + 0.5)] for q in quality.HINGES]).tolist(), abs=1e-6)
    raw = np.sort(model.raw(x))
    assert model.threshold == pytest.approx((raw[199] + raw[200]) / 2)
    assert model.raw(x[9000:]).max() < model.threshold < model.raw(x[:9000]).min()


def test_quality_blocks_hold_every_text_once_and_partners_for_it(spark):
    rows = [(i, int(i >= 300), [float(i)] * 15) for i in range(7000)] + [(5, 0, [5.0] * 15)]  # one row twice
    found = quality._in_blocks(spark.createDataFrame(rows, "id long, label int, x array<double>").repartition(5), 6700, 301)
    own = []
    for r in found.collect():
        block = tuple(np.frombuffer(r[k]).reshape(-1, 15) for k in ("good", "bad")) + (r.good_counts, r.bad_counts)
        own += quality._own(block)[:, 0].tolist()
        assert len(quality._differences(lambda v: v, block, 4)) == 4 * max(len(block[0]), len(block[1]))
    assert sorted(own) == sorted(r[2][0] for r in rows)
    assert found.count() == 4


def test_quality_pairs_are_distinct_and_leave_no_text_out():
    for many, few in ((9, 4), (4, 9), (5, 5), (7, 1)):
        good, bad = np.arange(many)[:, None] * 1.0, np.arange(few)[:, None] * 100.0
        d = quality._differences(lambda x: x, (good, bad, True, True), 3)[:, 0].tolist()
        found = {(round(v) % 100, (round(v) % 100 - round(v)) // 100) for v in d}
        assert len(d) == len(found) == min(3, many, few) * max(many, few)
        assert {g for g, _ in found} == set(range(many)) and {b for _, b in found} == set(range(few))


def test_quality_weights_minimise_the_loss_of_pairs():
    x = random.normal(size=(240, 15))
    label = (x[:, 0] + random.normal(size=240) > 0.2).astype(int)
    model = quality.fit(x, label, float(label.mean()), decay=0.01)
    z = (quality._expand(x, model.knots) - model.mean) / model.scale
    d = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])  # all pairs, as the table is small

    def loss(w):
        return np.logaddexp(0, -d @ w).mean() + 0.005 * (w @ w)

    best = loss(model.weight)
    assert all(loss(model.weight + 0.02 * random.normal(size=len(model.weight))) > best for _ in range(50))
