"""Language fusion, toxicity, compression and decision lists: brute force where exact, held-out accuracy where learned."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from fixtures import documents, labels, prose
from pyspark.sql import functions as F

from marginalia.llm import common, compression, decision_list, language, queries, toxicity

ACCURACY_DIR = "/root/testdata/sf0.01"


def _auc(scores, truth) -> float:
    order = np.argsort(np.argsort(scores)) + 1.0
    positive = truth == 1
    n = positive.sum()
    return (order[positive].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def _held_out(spark, query, column):
    rows = query(spark, ACCURACY_DIR).join(spark.read.parquet(f"{ACCURACY_DIR}/labels.parquet"), "doc_id").where("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r[column] for r in rows])


def test_logistic_fit_on_separable_and_on_noisy_data():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3))
    truth = (x[:, 0] > 0).astype(float)
    weights = common.fit_logistic(np.hstack([x, 1e3 * x**2]), truth)
    assert np.isfinite(weights).all() and ((common.logistic(np.hstack([x, 1e3 * x**2]), weights) > 0.5) == truth).mean() > 0.97
    coin = (rng.random(500) < 0.3).astype(float)
    assert abs(common.logistic(x, common.fit_logistic(x, coin)).mean() - coin.mean()) < 1e-3
    assert common.fit_logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


def test_a_capped_class_keeps_its_share(spark):
    rng = np.random.default_rng(1)
    truth = (rng.random(40_000) < 0.12).astype(float)
    x = rng.standard_normal((40_000, 1)) + truth[:, None]
    given = labels(spark, [(i, int(t), None) for i, t in enumerate(truth)])
    fits, rules = [], []
    features = [(i, *[float(v)] * len(decision_list.FEATURES)) for i, v in enumerate(x[:, 0])]
    frame = spark.createDataFrame(features, "doc_id bigint, " + ", ".join(f"{f} double" for f in decision_list.FEATURES))
    for cap in (50_000, 4000):
        ids = common.labelled_ids(given, "quality", 5, 0, cap)
        rows = ids.collect()
        at, y = [r.doc_id for r in rows], np.array([r.label for r in rows], dtype=float)
        counts = np.array([r.weight for r in rows])
        assert abs(counts @ y / counts.sum() - 0.12) < 0.01 and (cap < 50_000 or set(counts) == {1.0})
        fits.append(common.logistic(np.linspace(-2, 3, 11)[:, None], common.fit_logistic(x[at], y, counts=counts)))
        flipped = ids.withColumn("label", 1 - F.col("label"))  # the rare class is the one to reject
        rules.append([str(rule[0].feature) for rule in decision_list.learn(frame.join(flipped, "doc_id"), decision_list.ListOptions(max_rules=1, cuts=10))])
    assert np.abs(fits[0] - fits[1]).max() < 0.04
    assert rules[0] == rules[1], "no rule that fails the precision over all labels passes on the capped ones"


def test_compression_finds_held_out_junk(spark):
    scores, predicted, truth = _held_out(spark, queries.op5_compression_quality, "quality")
    assert _auc(scores, truth) > 0.9 and (predicted == truth).mean() > 0.95


def test_compression_does_not_read_held_out_labels(spark):
    docs, given = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = given.withColumn("quality", F.when(common.id_fold(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, given) == compression.fit(docs, flipped)


@pytest.mark.parametrize("rows", [(), ((1, 1, 0),), ((1, 1, 0), (7, 0, 1), (99, 0, 1), (8, None, None))])
def test_models_take_awkward_tables(spark, rows):
    docs, given = documents(spark, extra=True), labels(spark, rows)
    scored = compression.score(docs, compression.fit(docs, given)).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 for r in scored)
    toxic = toxicity.score(docs, toxicity.fit(docs, given)).collect()
    assert len(toxic) == 12 and all(0 <= r.score <= 1 for r in toxic)
    ruled = decision_list.quality_rules(docs, common.labelled_ids(given, "quality", 1, -1, 100)).collect()
    assert len(ruled) == 12 and {r.kept for r in ruled if r.doc_id in (4, 5, 6)} == {False}
    none = documents(spark, [])
    assert compression.score(none, compression.fit(none, given)).count() == 0
    assert toxicity.score(none, toxicity.fit(none, given)).count() == 0


def test_accepted_rows_keep_the_table(spark):
    docs = documents(spark, extra=True)
    model = compression.fit(docs, labels(spark))
    every, none = compression.accepted_rows(docs, model, 0.0), compression.accepted_rows(docs, model, 1.1)
    assert every.columns == docs.columns and none.count() == 0
    assert sorted(map(repr, every.collect())) == sorted(map(repr, docs.collect()))
    scores = [r.score for r in compression.score(docs, model).collect()]
    assert compression.accepted_rows(docs, model, 0.5).count() == sum(s >= 0.5 for s in scores)


def test_toxicity_finds_held_out_insults(spark):
    scores, predicted, truth = _held_out(spark, queries.op3_kneser_ney_toxicity, "toxic")
    assert _auc(scores, truth) > 0.8 and (predicted == truth).mean() > 0.94


def _plain_model(tables, df, others):
    """P(word | previous) and the backoff P(word) of both classes as functions, straight from the definition."""

    def off(counts):
        n = Counter(min(c, 5) for c in counts)
        share = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        found = {k: k - (k + 1) * share * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)}
        return lambda c: max(0.0, min(found[min(c, 3)], min(c, 3) - 0.01))

    total = others + 1 + sum(n + 1 for n in df.values())
    shared = lambda w: (df[w] + 1) / total if w in df else (others + 1) / total
    sides = []
    for table in tables:
        kinds = Counter(w for _, w in table)
        cut, types = off(kinds.values()), sum(kinds.values())
        left = sum(map(cut, kinds.values())) / types if types else 1.0

        def lower(w, kinds=kinds, cut=cut, types=types, left=left):
            own = (kinds[w] - cut(kinds[w])) / types if kinds.get(w) else 0.0
            return own + left * shared(w)

        cut2, after, back = off(table.values()), Counter(), Counter()
        for (p, _), n in table.items():
            after[p] += n
            back[p] += cut2(n)

        def upper(p, w, table=table, cut2=cut2, after=after, back=back, lower=lower):
            own = (table[p, w] - cut2(table[p, w])) / after[p] if (p, w) in table else 0.0
            return own + (back[p] / after[p] if after[p] else 1.0) * lower(w)

        sides.append((upper, lower))
    return sides


def _built(tables, df, others):
    words = sorted(df | {"": 0})
    ids = {w: i + 1 for i, w in enumerate(words)}
    pairs = sorted(set(tables[0]) | set(tables[1]))
    counts = np.array([[t.get(p, 0) for t in tables] for p in pairs]).reshape(-1, 2)
    previous, word = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    return toxicity.build(pa.array(words, pa.large_string()), np.array([df.get(w, 0) for w in words], float), others, previous, word, counts)


def _counted(texts):
    counts = Counter()
    for text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        counts.update(set(zip(["", *words[:-1]], words, strict=True)))
    return dict(counts)


def test_kneser_ney_ratios_equal_the_definition():
    rng = np.random.default_rng(4)
    texts = [[" ".join(rng.choice([f"w{i}" for i in range(12)] + own, 15)) for _ in range(20)] for own in (["bad", "bad2"], ["good"])]
    tables = [_counted(side) for side in texts]
    df = {w: 3 + i for i, w in enumerate(sorted({w for t in tables for _, w in t}))}
    model = _built(tables, df, 50.0)
    plain = _plain_model(tables, df | {"": 0}, 50.0)
    for upper, lower in plain:  # both are distributions, all unknown words together being one
        assert abs(sum(lower(w) for w in [*df, "", None]) - 1) < 1e-9
        assert all(abs(sum(upper(p, w) for w in [*df, "", None]) - 1) < 1e-9 for p in ("", "w3", "bad", "never"))
    for text in [*texts[0][:3], *texts[1][:3], "bad w1 never bad never never good w2", "never", ""]:
        words = text.split()
        full, back = toxicity.word_ratios(toxicity.token_lists(pa.array([text])), model)
        for at, w in enumerate(words):
            p, w = (words[at - 1] if at else ""), (w if w in df else None)
            (u1, l1), (u0, l0) = plain
            assert abs(full[at] - math.log(u1(p, w) / u0(p, w))) < 1e-9 and abs(back[at] - math.log(l1(w) / l0(w))) < 1e-9


def test_an_expression_seen_twice_moves_the_score():
    plain = [f"a{i} b{i} c{i}" for i in range(40)]
    tables = [_counted(plain[:20] + ["odd thing a1", "odd thing b2"]), _counted(plain[20:] + ["a1 b2", "b2 c3"])]
    df = Counter({w: 5 for t in tables for _, w in t})
    model = _built(tables, dict(df), 100.0)
    x = toxicity.features(pa.array(["a1 a2 b5 odd thing c7 c9", "a1 a2 b5 a3 b25 c7 c9", ""]), model, 3)
    assert x[0, 0] > x[1, 0] + 0.05 and x[0, 1] > x[1, 1] and not x[2].any()


def test_features_equal_a_text_by_text_computation(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + ["", None, "one", "two words"]
    tables = [_counted(texts[:20]), _counted(texts[20:45])]
    df = Counter(w for t in texts for w in set(re.findall(r"[^\W_]+", (t or "").lower())))
    model = _built(tables, {w: df[w] for t in tables for _, w in t}, 1000.0)
    got = toxicity.features(pa.array([t or "" for t in texts]), model, 25)
    for text, row in zip(texts, got, strict=True):
        lists = toxicity.token_lists(pa.array([text or ""]))
        assert lists.flatten().to_pylist() == re.findall(r"[^\W_]+", (text or "").lower())
        full, back = toxicity.word_ratios(lists, model)
        if not len(full):
            assert not row.any()
            continue
        n = len(back)
        middle = [np.sort(v)[n // 2] for v in (full, back)]
        window = max(back[max(0, e - 25) : e].sum() / min(n, 25) for e in range(1, n + 1))
        top = np.sort(back)[-max(1, n // 50) :].mean()
        want = [full.mean() - middle[0], back.mean() - middle[1], window - middle[1], top - middle[1], back.max() - middle[1], np.log1p(n)]
        assert row == pytest.approx(want, abs=1e-9)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{ACCURACY_DIR}/documents.parquet")
    given = spark.read.parquet(f"{ACCURACY_DIR}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    wrong = given.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, labels_) for labels_ in (given, wrong))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.bigram, two.bigram)


def test_shared_counts_cover_every_word_of_every_document(spark, monkeypatch):
    texts = ["the bad day", "the the rare1 rare2", "day rare1", None, ""]
    for rows in (1, 1 << 19):
        monkeypatch.setattr(toxicity, "PARTIAL_ROWS", rows)
        counts = toxicity._document_counts(documents(spark, [(i, t, "a", "s") for i, t in enumerate(texts)], extra=True))
        assert {r.word: r.n for r in counts.collect()} == {"the": 2, "bad": 1, "day": 2, "rare1": 2, "rare2": 1}
    known = spark.createDataFrame([("the",), ("bad",), ("",), ("never",)], "word string")
    shared, others = toxicity._shared_counts(counts, known)
    assert sorted(map(tuple, (r.values() for r in shared.to_pylist()))) == [("bad", 1), ("the", 2)] and others == (2 + 2 + 1) + 3


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_decision_list_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{ACCURACY_DIR}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{ACCURACY_DIR}/labels.parquet").collect()}
    frame = queries.op8_decision_list(spark, ACCURACY_DIR)
    assert not re.search("Python|Arrow|Pandas", plan_of(frame))
    rows = frame.collect()
    for r in rows:
        base = _base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and not (r.base_failed and r.kept)
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert np.mean([kept for kept, q in judged if q == 1]) > 0.97 and np.mean([kept for kept, q in judged if q == 0]) < 0.2


def test_repeated_windows_of_awkward_texts(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d", "x\ny\nx\n\n \nx", "　a b c", "a b c d e f a b c d e g a b c d e", prose(1, 20_000), None]
    docs = documents(spark, [(i, t, "a", "s") for i, t in enumerate(texts)])
    for r in decision_list.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(texts[r.doc_id]), r.doc_id


def test_covering_learns_a_conjunction_and_prunes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        values = [float(v) for v in rng.random(len(decision_list.FEATURES))]
        rows.append((i, int(not (values[2] > 0.7 and values[6] < 0.4)), 1.0, *values))
    schema = "doc_id bigint, label int, weight double, " + ", ".join(f"{f} double" for f in decision_list.FEATURES)
    rules = decision_list.learn(spark.createDataFrame(rows, schema))
    names = list(decision_list.FEATURES)
    got = {(c.feature, c.above) for c in rules[0]}
    assert {(names[2], True), (names[6], False)} <= got and str(rules[0][0])
    frame = spark.createDataFrame(rows, schema)
    kept, _ = decision_list.verdict(rules)
    assert np.mean([r.kept == bool(r.label) for r in frame.select("label", kept.alias("kept")).collect()]) > 0.95


def _fused(pages, model, options):
    """The posterior of every page, restated with dictionaries."""
    n, rows = len(model.languages), []
    for page_id, url, html in pages:
        log = language.text_evidence(language.page_text(html or ""), model, options)
        q = np.exp(log) / np.exp(log).sum()
        said = language.DECLARED.search(html or "")
        rows.append((page_id, *language.address_parts(url or ""), said[1].lower() if said else "", log, q))
    total = sum(r[6] for r in rows)
    general = (total + 1 / n) / (total.sum() + 1)
    sums = {k: Counter() for k in (1, 2, 3, 4)}
    for k in sums:
        for r in rows:
            sums[k][r[k]] = sums[k][r[k]] + r[6]
    out = {}
    for page_id, host, domain, suffix, declared, log, q in rows:
        smooth = lambda own, parent, q=q: (np.maximum(own - q, 0) + options.strength * parent) / (np.maximum(own - q, 0).sum() + options.strength)
        logs = log + np.log(smooth(sums[1][host], smooth(sums[2][domain], general)))
        for k, value in ((3, suffix), (4, declared)):
            c = sums[k][value]
            logs = logs + np.log((c + options.table_smoothing * c.sum() / total.sum() + 1e-12) / (total + options.table_smoothing))
        out[page_id] = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    return out


PAGES = [
    (1, "https://www.a.example.fr/fr/1", "<html lang='fr'><article>Éa or ti</article></html>"),
    (2, "https://www.a.example.fr/fr/2", "<html lang=de><body>ba ne ti or</body>"),
    (3, None, None),
    (4, "", ""),
    (5, "not an address", "<p>ba ti ne or éa"),
    (6, "//user@b.example.fr:80", "<html LANG=\"EN-us\"><script>ba</script>"),
    (6, "//user@b.example.fr:80", "<html LANG=\"EN-us\"><script>ba</script>"),
    (None, "http://a.example.fr/x", "<main>" + "ba ne " * 9000 + "</main>"),
]


def test_language_fusion_equals_brute_force(spark, sf_dir):
    options = language.LanguageOptions()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit_text(docs, options)
    awkward = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"host": F.lit("x"), "q": F.lit(1), "lang": F.lit(None).cast("string")})
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for frame in (awkward, given):
        want = _fused([(r.page_id, r.url, r.html) for r in frame.select("page_id", "url", "html").collect()], model, options)
        rows = language.identify(frame, docs, options).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert np.allclose(r.posterior, want[r.page_id], atol=1e-6) and abs(r.confidence - max(r.posterior)) < 1e-9
            assert r.lang in model.languages


def test_rare_languages_have_models_of_their_own(spark):
    rows = [(i, prose(i, 40), "aa", "s") for i in range(600)] + [(1000 + i, f"zq{chr(97 + i)}x wv{chr(98 + i)}k " * 20, f"r{i}", "s") for i in range(8)]
    rows.append((None, "hyljk jkpyl " * 20, "rn", "s"))
    model = language.fit_text(documents(spark, rows), language.LanguageOptions(sample=50))
    assert model.languages == ("aa", *(f"r{i}" for i in range(8)), "rn")
    for _, text, lang, _ in rows[-9:]:
        evidence = language.text_evidence(text, model, language.LanguageOptions())
        assert model.languages[int(evidence.argmax())] == lang
    whole = language.fit_text(documents(spark, rows[:600]), language.LanguageOptions())
    assert np.exp(model.log_share[0]).max() < np.exp(whole.log_share[0]).max(), "the frequent language is a sample"


def test_language_without_labels_or_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert {r.lang for r in language.identify(pages, documents(spark, [])).collect()} == {"und"}
    assert language.identify(pages.where("false"), documents(spark)).count() == 0


def test_address_parts():
    assert language.address_parts("HTTP://WWW.A.Example.de:80/de-at/x") == ("www.a.example.de", "example.de", "de/de")
    assert language.address_parts("https://x.org/deep/de") == ("x.org", "x.org", "org/")
    assert language.address_parts("mailto:x") == ("", "", "")
