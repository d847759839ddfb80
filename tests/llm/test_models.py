"""Language identification and the toxicity network against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snippetlake.llm import langid, toxicity

VOWELS = {"en": "the of and to in is that", "fr": "le la les des et dans qui", "xx": "qo zuq woz quzo zaq oq"}


def grams_of(text):
    data = (text or "").lower().encode()
    letter = [97 <= c <= 122 or c >= 128 for c in data]
    codes = [c if letter[i] else 32 for i, c in enumerate(data) if letter[i] or i + 1 == len(data) or letter[i + 1]]
    grams = [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 19 for a, b, c in zip(codes, codes[1:], codes[2:])]
    return grams, sum(letter)


def posteriors(rows):
    """(language, posterior) of rows (text, markup, address, host) by the formulas, one row at a time."""
    marks = [m[:2].lower() if m else None for _, m, _, _ in rows]
    names = [a.split("://")[1].split("/")[0].lower() if a else "" for _, _, a, _ in rows]
    ends = [n.rsplit(".", 1)[1] if "." in n else None for n in names]
    hosts = [h for *_, h in rows]
    domains = [".".join(h.split(".")[-2:]) if h and "." in h else "" for h in hosts]
    grams = [grams_of(t) for t, *_ in rows]
    declared = defaultdict(Counter)
    for (g, _), m in zip(grams, marks):
        if m:
            declared[m].update(g)
    languages = [*langid.SEEDS, *sorted(m for m, c in declared.items() if m not in langid.SEEDS and sum(c.values()) >= langid.ENOUGH)]
    logs = []
    for m in languages:
        counts = declared[m] + Counter(grams_of(f" {langid.SEEDS[m]} ")[0] if m in langid.SEEDS else [])
        total = sum(counts.values()) + 0.1 * langid.BUCKETS
        logs.append([math.log((counts[b] + 0.1) / total) for b in range(langid.BUCKETS)])
    k = len(languages)
    like = [[min(1, langid.WEIGHT / max(len(g), 1)) * sum(table[b] for b in g) for table in logs] for g, _ in grams]
    flat = [-min(1, langid.WEIGHT / max(len(g), 1)) * len(g) * math.log(langid.BUCKETS) for g, _ in grams]
    spoken = [x.index(max(x)) if letters else None for x, (_, letters) in zip(like, grams)]

    def votes(values):
        out = defaultdict(lambda: [0] * k)
        for v, s in zip(values, spoken):
            if v and s is not None:
                out[v][s] += 1
        return out

    whole = votes(["all"] * len(rows))["all"]
    shares = [(x + 1) / (sum(whole) + k) for x in whole]
    by_mark, by_end, by_host, by_domain = map(votes, (marks, ends, hosts, domains))
    smooth = lambda own, above: [(x + 20 * a) / (sum(own) + 20) for x, a in zip(own, above)]
    out = []
    for i in range(len(rows)):
        trust = [[math.log((n + 1) / (w + 20)) for n, w in zip(table[v], whole)] if v in table else [0.0] * k for table, v in ((by_mark, marks[i]), (by_end, ends[i]))]
        above = smooth(by_domain[domains[i]], shares) if domains[i] in by_domain else shares
        prior = smooth(by_host[hosts[i]], above) if hosts[i] in by_host else shares
        score = [like[i][j] + trust[0][j] + trust[1][j] + math.log(prior[j] * (1 - langid.NO_LANGUAGE)) for j in range(k)]
        enough = grams[i][1] >= langid.ENOUGH
        score.append(flat[i] + math.log(langid.NO_LANGUAGE) + min(trust[0]) + min(trust[1]) if enough else -1e9)
        best = score.index(max(score))
        named = [*languages, langid.UNDETERMINED][best] if grams[i][1] else langid.UNDETERMINED
        out.append((named, 1 / sum(math.exp(x - max(score)) for x in score)))
    return out


def test_posterior_by_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        m = rng.choice(list(VOWELS))
        text = " ".join(rng.choice(VOWELS[m if rng.random() < 0.9 else "en"].split()) for _ in range(rng.randrange(0, 40)))
        name = f"{rng.choice('ab')}.{m}site.{rng.choice([m, 'com'])}"
        declared = rng.choice([m, m.upper() + "-AT", None, "en", "yy"])
        rows.append((text + rng.choice(["", ".", " 12"]), declared, f"http://{name}/p?{i}" if i % 3 else None, name if i % 4 else None))
    rows += [(None, "fr", None, None), ("12 34", None, "http://x.fr/", "x"), ("\x01\x02" * 40 + "ßж世q" * 30, "en", None, None), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, url string, host string").repartition(5)
    got = {r.id: r for r in langid.judge(docs, langid.Columns(address="url", host="host")).collect()}
    expected = posteriors(rows)
    assert {name for name, _ in expected} >= {"en", "fr", "xx", "und"}
    for i, (name, posterior) in enumerate(expected):
        assert got[i].posterior == pytest.approx(posterior, rel=2e-3)
        assert got[i].language == name or posterior < 0.5001


def logit(own, start, model):
    """One text through the network, one word, filter and width at a time."""
    rows = [[float(a) + float(b) for a, b in zip(model.embedding[o], model.embedding[s])] for o, s in zip(own, start)]
    total = float(model.output[-1])
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(rows)):
                inside = range(min(width, len(rows) - at))
                best = max(best, float(model.bias[w * toxicity.FILTERS + f]) + sum(float(model.filters[w][j][d, f]) * rows[at + j][d] for j in inside for d in range(toxicity.DIMS)))
            total += best * float(model.output[w * toxicity.FILTERS + f])
    return total


def small_set(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 40)
    rng = np.random.default_rng(5)
    texts = [(rng.integers(0, 40, n), rng.integers(0, 40, n)) for n in (0, 1, 2, 3, 9, 14, 30, 5)]
    return texts, np.array([0, 1, 0, 1, 1, 0, 0, 1])


def test_forward_pass(monkeypatch):
    texts, y = small_set(monkeypatch)
    model = toxicity._train(texts, y)
    expected = [logit(own, start, model) for own, start in texts]
    assert toxicity._score_texts(texts, model) == pytest.approx(expected, abs=1e-4)
    bounds = np.cumsum([0, *[len(own) for own, _ in texts]])
    own, start = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
    pooled, _ = toxicity._pooled(model.embedding[own] + model.embedding[start], np.arange(len(own)), bounds, model)
    assert toxicity._logits(pooled, model) == pytest.approx(expected, abs=1e-4)


def test_one_step_follows_the_gradient(monkeypatch):
    """The first step of training is Adagrad along finite differences of the loss."""
    texts, y = small_set(monkeypatch)
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    start = toxicity._train(texts, y)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    after = toxicity._train(texts, y)
    wide = toxicity.Model(start.embedding.astype(float), [f.astype(float) for f in start.filters], start.bias.astype(float), start.output.astype(float), 0.0, {})

    def loss():
        return sum(math.log1p(math.exp(-z if label else z)) for z, label in ((logit(*t, wide), label) for t, label in zip(texts, y))) / len(y)

    rng = np.random.default_rng(6)
    pairs = [(wide.embedding, after.embedding), *zip(wide.filters, after.filters), (wide.bias, after.bias), (wide.output, after.output)]
    moved = 0
    for values, stepped in pairs:
        for at in rng.choice(values.size, min(values.size, 12), replace=False):
            where, was, e = np.unravel_index(at, values.shape), values.flat[at], 1e-5
            values[where] = was + e
            up = loss()
            values[where] = was - e
            slope = (up - loss()) / (2 * e)
            values[where] = was
            assert stepped[where] == pytest.approx(was - toxicity.RATE * slope / math.sqrt(1e-2 + slope**2), abs=2e-3)
            moved += abs(slope) > 1e-3
    assert moved > 10


def test_score_of_whole_texts(spark, monkeypatch):
    """Scores in Spark are those of the loop over the words' buckets."""
    made = ["one two three", "", None, "bad bad one", "Two, (three) " * 50]
    _, _, own, start = toxicity._coded(pa.array(made))
    codes, bounds, *_ = toxicity._coded(pa.array(made))
    rng = np.random.default_rng(7)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    filters = [rng.normal(size=(w, toxicity.DIMS, toxicity.FILTERS)).astype("float32") for w in toxicity.WIDTHS]
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIMS)).astype("float32"), filters, rng.normal(size=n).astype("float32"), rng.normal(0, 0.2, n + 1).astype("float32"), 0.3, {"": 0.5})
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made)], "doc_id long, text string, lang string").repartition(3)
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    for i in range(len(made)):
        part = codes[bounds[i] : bounds[i + 1]]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(logit(own[part], start[part], model) + 0.3))), abs=1e-4)


def test_every_labelled_text_is_trained_on(spark, monkeypatch):
    """Beyond one group the mean of the groups' models is taken, each from the counts of all texts."""
    monkeypatch.setattr(toxicity, "GROUP", 60)
    made = [(i, f"plain word {'vile' if i % 4 == 0 else 'kind'} number{i % 7} " * 3, "en", int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, toxic int")
    seen = []
    mean = toxicity._mean_model
    monkeypatch.setattr(toxicity, "_mean_model", lambda rows, groups: seen.append((rows.count(), groups)) or mean(rows, groups))
    usable = F.col("doc_id") % 3 != 0
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), usable)
    assert len(seen) == 1 and seen[0][0] > 300 and seen[0][1] > 2
    got = {r.id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == bool(y) for i, _, _, y in made)
    assert 0 < model.thresholds["en"] < 1
