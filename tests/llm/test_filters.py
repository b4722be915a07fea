"""op4, op5, op6, op9, op10 and the pipeline's stages."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import decontamination, quality_classifier, quality_rules, toxicity, url_filter
from tests.llm import data

BAD = ["vilework", "vileword", "vilething"]


# -- op4 ------------------------------------------------------------------------


def toxic_corpus(n: int = 400, seed: int = 2):
    rng = random.Random(seed)
    docs, labels, where = [], [], {}
    for i in range(n):
        parts = [data.sentence(rng, 10) for _ in range(6)]
        toxic = int(rng.random() < 0.25)
        if toxic:
            k = rng.randrange(6)
            parts[k] = parts[k].replace(" ", f" {rng.choice(BAD)}{rng.choice(['', 'es', 'ing'])} ", 1)
            where[i] = k
        docs.append((i, " ".join(parts)))
        labels.append((i, toxic))
    return docs, labels, where


def test_toxicity_finds_documents_and_sentences(spark):
    docs, labels, where = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [int(found[i].score >= 0.5) == dict(labels)[i] for i in held]
    assert len(held) > 50 and np.mean(right) > 0.97
    text = dict(docs)
    named = [all(any(w in text[i][s.start : s.stop] for w in BAD) for s in found[i].spans) and found[i].spans for i in where if found[i].score >= 0.5]
    assert np.mean([bool(x) for x in named]) > 0.97


def test_held_out_labels_do_not_count(spark):
    docs, labels, _ = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lied = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [
        {r.doc_id: r.score for r in toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, lied)
    ]
    assert scores[0] == scores[1]


def test_toxicity_of_awkward_rows(spark):
    docs = data.documents(spark)
    for rows in ([(k, k % 2) for k in range(30)] + [(3, None), (None, 1), (5, 1)], [(k, 0) for k in range(30)], []):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
        found = toxicity.toxicity(docs, labels).collect()
        assert len(found) == len(data.rows()) and all(0 <= r.score <= 1 for r in found)
        assert {r.score for r in found if r.doc_id in (30, 31, 32)} == {0.0}
    model = toxicity.fit([])
    assert toxicity.keep_below(docs, model).count() == len(data.rows())
    assert toxicity.score(data.empty(spark), model).count() == 0


def test_long_clean_texts_are_kept(spark):
    docs, labels, _ = toxic_corpus()
    rng = random.Random(9)
    clean = " ".join(data.sentence(rng, 10) for _ in range(6000))
    mixed = clean + f" The {BAD[0]} of {BAD[1]} is {BAD[2]}."
    long = [(1000, clean), (1001, mixed), (1002, "Nothing known. " * 40_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = spark.createDataFrame(long, "doc_id long, text string")
    assert {r.doc_id for r in toxicity.keep_below(found, model).collect()} == {1000, 1002}
    scores = {r.doc_id: r.score for r in toxicity.score(found, model).collect()}
    assert scores[1002] == 0 and scores[1001] >= 0.5


def test_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id % 3000 AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    rows = toxicity.sample(labels, "toxic", 1000).collect()
    assert 850 <= len(rows) <= 1000 and len({r.id for r in rows}) == len(rows)
    assert toxicity.sample(labels, "toxic", 3000).count() == 3000


def test_fit_reads_long_texts_whole(spark):
    rng = random.Random(10)
    d = spark.createDataFrame([(1, " ".join(f"w{rng.randint(0, 10**6)}x." for _ in range(9000)))], "doc_id long, text string")
    (row,) = toxicity.bags(d, spark.createDataFrame([(1, 0)], "id long, y int"))
    assert len(row["sizes"]) // 4 == 9000


# -- op5 ------------------------------------------------------------------------


def url_by_hand(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule_by_hand(host, path):
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http:///en/7",
    "https://A.Example.COM/en/7#x",
    "https://example.com/en/8?y=/en/7",
    "http://example.net/de/8",
    "http://x.example.net/de/9",
    "http://notexample.net/de/8",
    "ftp://b.org/es/?q",
    "http://borg/es/",
    "http://com/en/",
    "http://ÄB.com/EN/",
    "http://a.com?x=http://b.org/es/",
    "http://a.com#/en/",
    "http://casino-royal.test/slots/bonus.html",
    "http://news.example.test/en/2019/report.html",
    "http://a\nb.com/en/\nx?y",
    "x" * 5000 + "://" + "h" * 5000 + "/" + "p" * 5000,
]


def test_urls_by_hand(spark):
    pages = spark.createDataFrame([(k, u, "clash", 1.0) for k, u in enumerate(URLS)] + [(3, URLS[3], "x", 2.0)], "page_id long, url string, host string, score double")
    found = url_filter.url_filter(pages).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path = url_by_hand(URLS[r.page_id])
        rule = rule_by_hand(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule[1] + rule[2] if rule else None)
        assert r.verdict == (rule[0] if rule else "block" if r.score >= 0.5 else "allow")
    verdict = {r.page_id: r.verdict for r in found}
    assert verdict[URLS.index("http://casino-royal.test/slots/bonus.html")] == "block"
    assert verdict[URLS.index("http://news.example.test/en/2019/report.html")] == "allow"
    assert url_filter.judge(pages.where("page_id < 0"), url_filter.train(pages.limit(0).selectExpr("url", "1 AS label"))).count() == 0


def test_url_model_on_held_out_hosts(spark):
    """Every host stands in the table once, so none of the tested ones was trained on."""
    seed = url_filter.seed_table(spark)
    assert len({url_by_hand(u)[0] for u, _ in url_filter.SEED}) == len(url_filter.SEED) <= url_filter.MAX_SEED
    fold = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    model = url_filter.train(seed.where(~fold))
    test = seed.where(fold).withColumn("page_id", F.monotonically_increasing_id())
    found = url_filter.judge(test, model).join(test.select("page_id", "label"), "page_id").collect()
    hit = sum(r.label == 1 and r.score >= 0.5 for r in found)
    assert hit >= 0.9 * sum(r.label == 1 for r in found) and hit >= 0.9 * sum(r.score >= 0.5 for r in found)


def test_url_model_blocks_what_no_rule_judges(spark):
    bad = ["www.lucky-poker-bonus.example.com", "m.adult-dating.test", "cheap-viagra-pills.example.net", "spamtracker.invalid", "best-casino-slots.org"]
    good = ["www.village-library.example.com", "m.harbour-museum.test", "gardenjournal.example.net", "ththan.example.com", "county-railway.org"]
    pages = spark.createDataFrame([(k, f"https://{h}/fr/{k}1") for k, h in enumerate(bad + good)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert [found[k].verdict for k in range(10)] == ["block"] * 5 + ["allow"] * 5
    assert all(found[k].rule is None for k in range(10))


def test_url_scores_by_hand(spark):
    """Scores from the hashes of Spark and the sums of Python."""
    model = ([((7 * k) % 13 - 6) / 3 for k in range(url_filter.SLOTS)], 0.25)
    urls = ["http://abc.de/x", "http://aaaa.aa", "http://", None, "https://WWW.Casino.net/en/?q"]
    found = {r.page_id: r.score for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model).collect()}
    for k, url in enumerate(urls):
        host, path = url_by_hand(url)
        grams = {(t, x[i : i + n]) for t, raw, x in (("h", host, f"^{host}$"), ("p", path, path + "$")) if raw for n in url_filter.GRAMS for i in range(len(x) - n + 1)}
        slots = set()
        if grams:
            rows = spark.createDataFrame(sorted(grams), "t string, g string").select(F.pmod(F.xxhash64("t", "g"), F.lit(url_filter.SLOTS)).alias("s")).collect()
            slots = {r.s for r in rows}
        z = sum(model[0][s] for s in slots) / max(len(slots), 1) ** 0.5 + model[1]
        assert abs(found[k] - 1 / (1 + np.exp(-z))) < 1e-6


def test_url_model_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = url_filter.url_filter(spark.range(1).selectExpr("id AS page_id", "'http://a.b/c' AS url"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan
    assert pages.count() == 1


# -- op6 ------------------------------------------------------------------------


def leaks_by_hand(docs, items):
    out = set()
    for i, text in docs:
        ws = (text or "").lower().split()
        for k, item in items:
            it = (item or "").lower().split()
            width = min(len(it), 13)
            if not it:
                continue
            for shift in range(-len(it), len(ws) + 1):
                same = [0 <= shift + j < len(ws) and ws[shift + j] == it[j] for j in range(len(it))]
                if any(sum(same[s : s + width]) >= 0.8 * width for s in range(len(it) - width + 1)):
                    out.add((i, k))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(data.WORDS) + str(rng.randint(0, 30)) for _ in range(2 * k + 1))) for k in range(15)] + [(15, None), (16, ""), (17, "a b c")]
    docs = []
    for i in range(120):
        words = [rng.choice(data.WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))]
        if i % 4:
            leak = (items[i % 15][1]).split()
            for _ in range(rng.randint(0, 4)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = leak if i % 2 else leak[: len(leak) * 2 // 3]
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    want = leaks_by_hand(docs, items)
    keyed = decontamination.with_key(d, "doc_id")
    found = {(r.key.id, r.item_id) for r in decontamination.verified(keyed, b).collect()}
    assert found == want and len(want) > 50
    assert {len(items[k][1].split()) for _, k in want} >= {1, 3, 5, 7, 9, 11, 13, 15}


def test_every_tolerated_change_leaves_a_seed():
    for n in range(1, 14):
        lost = n - decontamination.needed_of(n)
        if n < decontamination.WINDOW:
            places = [set(range(a, a + k)) for a, k in decontamination.parts_of(n)]
            assert sum(map(len, places)) == n and all(places)
        else:
            places = [{at + k for k in m} for m in decontamination.MASKS for at in range(n - m[-1])]
        for gone in itertools.combinations(range(n), lost):
            assert any(not p & set(gone) for p in places), (n, gone)


@pytest.mark.parametrize("rows", [500_000, 0])
def test_leaks_of_awkward_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    docs = data.documents(spark)
    first = data.rows()[0][1]
    b = spark.createDataFrame([(1, " ".join(first.split()[3:20])), (1, " ".join(first.split()[3:20])), (2, None)], "item_id long, text string")
    found = decontamination.contaminated(docs, b).collect()
    assert len(found) == len(data.rows())
    assert {r.doc_id for r in found if r.contaminated} == {0, 34} and all(r["items"] in ([], [1]) for r in found)
    assert decontamination.contaminated(docs, b.limit(0)).where("contaminated").count() == 0
    assert decontamination.contaminated(data.empty(spark), b).count() == 0


# -- op9 ------------------------------------------------------------------------


def junk(rng, kind):
    words = [rng.choice(data.WORDS) for _ in range(60)]
    return [" ".join(w.upper() + "!!" for w in words[:9] * 7), " ".join(words[:1] * 80), " | ".join(words), " ".join(w + rng.choice(["***", "###", "%%%"]) for w in words)][kind % 4]


def test_weak_labels_find_junk(spark):
    rng = random.Random(4)
    glue = ["the", "of", "and", "to", "in"]
    good = lambda: "\n".join(" ".join(x + " " + rng.choice(glue) for x in data.sentence(rng, 8)[:-1].split()) + "." for _ in range(6))
    docs = [(i, good() if i % 5 else junk(rng, i // 5), i % 5 > 0) for i in range(600)]
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    found = {r.doc_id: r for r in quality_classifier.quality_classifier(d).collect()}
    assert np.mean([found[i].kept == ok for i, _, ok in docs]) > 0.97
    assert np.mean([(found[i].posterior >= 0.5) == ok for i, _, ok in docs]) > 0.97


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    k, n = len(quality_classifier.LABELLERS), 20_000
    truth = rng.random(n) < 0.7
    says_good = np.where(truth[:, None], 0.995, np.linspace(0.1, 0.6, k)[None, :])
    votes = np.where(rng.random((n, k)) < 0.3, 0, np.where(rng.random((n, k)) < says_good, 1, -1))
    counts: dict = {}
    for v in votes:
        code = quality_classifier.pattern_of(tuple(v))
        counts[code] = counts.get(code, 0) + 1
    found = quality_classifier.expectation_maximisation(counts)
    assert abs(found["share"] - 0.7) < 0.03
    assert np.abs(found["votes"][:, 0] - np.linspace(0.1, 0.6, k)).max() < 0.06
    assert quality_classifier.expectation_maximisation({})["posterior"] == {}


def em_by_hand(rows, rounds):
    """Posteriors of "good", a row at a time."""
    k = len(rows[0])
    kind = []
    for v in rows:
        bad = [j for j in range(k) if v[j] < 0]
        kind.append([0.1] + [0.9 / len(bad) if j in bad else 0.0 for j in range(k)] if bad else [0.9] + [0.1 / k] * k)
    for _ in range(rounds):
        mass = [sum(w[c] for w in kind) for c in range(k + 1)]
        share = [(m + 0.5) / (sum(mass) + 0.5 * (k + 1)) for m in mass]
        says = [[(sum(w[c] for w, v in zip(kind, rows) if v[j] > 0) + 0.5) / (sum(w[c] for w, v in zip(kind, rows) if v[j]) + 1) for j in range(k)] for c in range(k + 1)]
        for i, v in enumerate(rows):
            like = []
            for c in range(k + 1):
                p = share[c]
                for j in range(k):
                    p *= says[c][j] if v[j] > 0 else 1 - says[c][j] if v[j] < 0 else 1
                like.append(p)
            kind[i] = [x / sum(like) for x in like]
    return [w[0] for w in kind]


def test_em_equals_brute_force():
    rng = random.Random(6)
    k = len(quality_classifier.LABELLERS)
    rows = [tuple(rng.choice([1, 1, 1, 0, -1 if rng.random() < 0.4 else 1]) for _ in range(k)) for _ in range(200)]
    counts: dict = {}
    for v in rows:
        counts[quality_classifier.pattern_of(v)] = counts.get(quality_classifier.pattern_of(v), 0) + 1
    found = quality_classifier.expectation_maximisation(counts, 15)["posterior"]
    want = em_by_hand(rows, 15)
    assert max(abs(found[quality_classifier.pattern_of(v)] - p) for v, p in zip(rows, want)) < 1e-9


def test_features_of_long_texts_all_count(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(1, " ".join(f"w{rng.randint(0, 9)}{'abcdefghij'[rng.randint(0, 9)] * rng.randint(1, 19)}{rng.choice('xyz')}{rng.choice('uvw')}." for _ in range(60_000)))], "doc_id long, text string")
    (row,) = quality_classifier.training_rows(quality_classifier.read(docs), 1, {p: 0.5 for p in range(3**7)})
    words = docs.first().text.split()
    assert len(np.frombuffer(row["slots"], np.int32)) == len({s for w in words for s in quality_classifier.Features()[w]}) + 2


def test_classifier_of_awkward_rows(spark):
    found = quality_classifier.quality_classifier(data.documents(spark)).collect()
    assert len(found) == len(data.rows()) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found)
    assert not any(r.kept for r in found if r.doc_id in (30, 31, 32))
    assert quality_classifier.quality_classifier(data.empty(spark)).count() == 0


# -- op10 -----------------------------------------------------------------------


def base_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows: dict = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    again = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_base_statistics_by_hand():
    rng = random.Random(3)
    texts = ["", " ", "a b c d e a b c d e", "a a a a a a", "x\nx\n\n\nx \n x", "é#*$%&|<> ü b", "one"] + [
        " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)
    ]
    for t in texts:
        assert quality_rules.statistics_of(t) == base_by_hand(t), t


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(7)
    docs = [(i, data.paragraph(rng, 6) if i % 10 else junk(rng, 2 + (i // 10) % 2), "en" if i % 2 else "fr", "s0" if i % 3 else "s1") for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(d).collect()}
    assert np.mean([found[i] for i in found if i % 10]) > 0.99
    assert np.mean([found[i] for i in found if i % 10 == 0]) < 0.05


def closest(values, share):
    """The least value that ``share`` of the rows do not exceed."""
    v = np.sort(values)
    return v[int(np.ceil(share * len(v))) - 1]


def outliers_by_hand(q):
    """Squared distances of the rows of one group (whole numbers), by plain numpy."""
    rules = quality_rules
    lean = max(rules.TARGET_ROWS / (len(q) + rules.TARGET_ROWS), rules.LEAST_TARGET)
    sd = rules.GRID * np.array(rules.TARGET_SD)

    def fit(rows, share):
        own = max(rules.TARGET_ROWS / (len(rows) + rules.TARGET_ROWS), rules.LEAST_TARGET)
        s = np.cov(rows.T, bias=True) * rules.consistency(share)
        return rows.mean(axis=0), (1 - own) * s + own * np.diag(sd**2)

    def far(model):
        d = q - model[0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(model[1]), d)

    median = np.array([closest(c, 0.5) for c in q.T])
    spread = np.array([closest(abs(c - m), 0.5) for c, m in zip(q.T, median)])
    scale = np.sqrt((1.48 * spread) ** 2 + rules.LEAST_TARGET * sd**2)
    z = (q - median) / scale
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    u = np.round(np.divide(1000 * z, norm, out=np.zeros_like(z), where=norm > 0)) / 1000
    signs = 0.9 * 4 * (u.T @ u) / len(q) + 0.1 * np.eye(4)
    found = []
    for core, share in ((np.eye(4), rules.CORE), (signs, rules.CORE), (np.eye(4), 0.5)):
        model = (median, scale[:, None] * core * scale[None, :])
        for step in range(rules.STEPS):
            rank = np.round(np.log1p(far(model)) * rules.DISTANCE_GRID)
            model = fit(q[rank <= closest(rank, share if step == 0 else rules.CORE)], rules.CORE)
        found.append(model)
    best = min(found, key=lambda m: np.linalg.slogdet(m[1])[1])
    near = q[far(best) <= rules.quantile_of(rules.REWEIGHT)]
    assert lean and len(near)
    return far(fit(near, rules.REWEIGHT))


def test_outliers_equal_plain_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 400), ("b", 60)):
        shape = rng.normal(size=(4, 4)) * 9
        x = rng.normal(size=(n, 4)) @ shape + rng.integers(-200, 200, 4)
        x[: n // 5] += rng.normal(size=(n // 5, 4)) * 150
        rows += [(g, *map(int, v)) for v in np.round(x)]
    points = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, grp string, q0 int, q1 int, q2 int, q3 int").repartition(3)
    model = quality_rules.models(points)
    found = {r.doc_id: r.d2 for r in quality_rules.with_distance(points, model).collect()}
    want = np.concatenate([outliers_by_hand(np.array([r[1:] for r in rows if r[0] == g], float)) for g in "ab"])
    assert np.allclose([found[k] for k in range(len(rows))], want, rtol=1e-6, atol=1e-6)
    assert 0.1 < np.mean(want > quality_rules.CUTOFF) < 0.25


def test_consistency_of_a_normal_core():
    assert abs(quality_rules.quantile_of(0.75) - 5.3853) < 1e-3
    assert abs(quality_rules.quantile_of(0.975) - 11.1433) < 1e-3
    x = np.random.default_rng(0).normal(size=(200_000, 4))
    near = x[np.square(x).sum(axis=1) <= quality_rules.quantile_of(0.75)]
    assert abs(quality_rules.consistency(0.75) * near.var() - 1) < 0.02


@pytest.mark.parametrize("groups", [10_000, 0])
def test_outliers_of_many_groups(spark, monkeypatch, groups):
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", groups)
    docs = data.documents(spark)
    found = quality_rules.quality_rules(docs).collect()
    assert len(found) == len(data.rows()) and all(r.d2 is not None for r in found)


def test_quality_rules_of_awkward_rows(spark):
    found = quality_rules.quality_rules(data.documents(spark)).collect()
    assert len(found) == len(data.rows())
    by = {r.doc_id: r for r in found}
    for i, t, *_ in data.rows():
        assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == base_by_hand(t or "")
        failed = by[i].n_words < 10 or 100 * by[i].n_repeat_words > 20 * by[i].n_words
        assert by[i].base_failed == failed and not (failed and by[i].kept)
    assert quality_rules.quality_rules(data.empty(spark)).count() == 0
