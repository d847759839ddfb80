"""WARC transactions, filter interactions and source divergence against brute force on small odd tables."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from snippetlake.llm import divergence, filteraudit, warc
from snippetlake.session import cut

DOCS = "doc_id bigint, text string, lang string, source string, part string, mask int, digest string, n bigint, gid bigint, lid bigint, value bigint"
CLASH = ("clash", 7, "clash", 1, 2, 3, 4)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- WARC

PAYLOADS = [None, "", "\r\n", "\r\n\r\n", "x\r\n\r", "\r\r\n\r\n\n", "a\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 3000, "same", "<p>\x00</p>"]


def payloads(rng, n):
    return [rng.choice(PAYLOADS) if rng.random() < 0.6 else "".join(rng.choice(["\r", "\n", "\r\n", "é", "b c"]) for _ in range(rng.randrange(40))) for _ in range(n)]


def page_rows():
    rng = random.Random(2)
    made = [(rng.choice([None, rng.randrange(60)]), rng.choice([None, "", "nothing", "http://a.b/c d?e\r\n#f"]), h, "clash", "clash") for h in payloads(rng, 150)]
    return made + made[:20]


def expected_pages(made):
    least = {}
    for page, _, html, *_ in made:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html, *_ in made:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = least.get(html or "")
        again = first is not None and page != first
        out.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    return collections.Counter(out)


def archived(spark, made, parts=3):
    folder = warc.new_folder(spark)
    table = spark.createDataFrame(made, "page_id bigint, url string, html string, capture string, sha string").repartition(parts)
    warc.write(table, folder)
    return folder


def test_pages_come_back_through_their_transactions(spark):
    made = page_rows()
    found = cut(warc.records(spark, archived(spark, made)))
    assert collections.Counter(rows(warc.pages(warc.transactions(found)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) == expected_pages(made)
    nested = warc.transactions(found).collect()
    assert len(nested) == len(made) and len({r.capture for r in nested}) == len(made)
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and r.response.id == r.capture for r in nested)


def test_payloads_survive_whole(spark):
    made = [(i, "http://a/", h, "", "") for i, h in enumerate(payloads(random.Random(5), 120))]
    found = warc.records(spark, archived(spark, made, 2), with_payload=True)
    got = {bytes(r.payload) for r in found.where("type = 'response'").select("payload").collect()}
    assert got == {(h or "").encode() for _, _, h, *_ in made}


def test_files_follow_the_format(spark):
    """A reader that goes by Content-Length alone finds the same records."""
    made = page_rows()
    folder = archived(spark, made, 2).removeprefix("file:")
    import pathlib

    kinds = collections.Counter()
    for file in pathlib.Path(folder).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1].decode()] += 1
            data = rest[size + 4 :]
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(made)


def test_captures_that_name_their_requests(spark):
    """Concurrent-to counts in either direction; strangers are in no transaction."""
    parts = [("response", "r1", ["q1"]), ("request", "q1", []), ("metadata", "m1", ["r1"]), ("metadata", "m2", ["r1"]), ("request", "q9", ["gone"]), ("revisit", "r2", [])]
    schema = f"{warc.RECORD}"
    table = spark.createDataFrame([(k, i, c, None, None, None, None, None, {}) for k, i, c in parts], schema)
    got = {r.capture: ([q.id for q in r.requests or []], [m.id for m in r.metadata or []]) for r in warc.transactions(table).collect()}
    assert got == {"r1": (["q1"], ["m1", "m2"]), "r2": ([], [])}


@pytest.mark.parametrize("spoil", [lambda d: d[:-30], lambda d: d.replace(b"same", b"SAME")])
def test_damage_is_not_passed_over(spark, spoil, tmp_path):
    import pathlib

    folder = pathlib.Path(archived(spark, [(1, None, "same", "", "")], 1).removeprefix("file:"))
    file = next(folder.glob("*.gz"))
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(spoil(gzip.decompress(file.read_bytes()))))
    with pytest.raises(Exception, match="truncated|does not have the digest"):
        warc.records(spark, str(tmp_path)).collect()


def test_archives_are_read_without_a_shuffle(spark):
    plan = warc.records(spark, archived(spark, [(1, None, "x", "", "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# ---------------------------------------------------------------- filters


def audit_rows():
    rng = random.Random(4)
    texts = [None, "", " \t", "A", "a " * 250, " ".join(f"w{i}" for i in range(220)), "ABC $ " + "d " * 30, "x|y", " ".join(f"W{i}" for i in range(300)) + "\x0b#", "é " * 201 + "É"]
    made = []
    for _ in range(160):
        made.append((rng.choice([None, *range(70)]), rng.choice(texts), None, rng.choice([None, "", "s1", "s1", "s1", "s2"]), *CLASH))
    return made


def expected_audit(made, labels):
    least = {}
    for doc, text, *_ in made:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    per = collections.defaultdict(list)
    for doc, text, _, source, *_ in made:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        first = least.get(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        fails |= {"D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (doc is None or doc > first)}
        per[source or ""].append((fails, doc in good, doc in toxic))
    out = []
    for part, docs in per.items():
        shapley, mine = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = order[: step - 1]
                alive = [d for d in docs if not any(d[0][y] for y in before)]
                gone = [d for d in alive if d[0][x]]
                redundant = sum(d[0][x] for d in docs) - len(gone)
                unique = sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                shapley[x] += len(gone)
                mine.append((part, order, step, len(alive) - len(gone), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone), x))
        out += [(*m[:-1], shapley[m[-1]]) for m in mine]
    return sorted(out)


def test_filter_interactions(spark):
    made = audit_rows()
    labels = [(d, random.Random(d).choice([0, 1, None]), d % 2) for d in range(0, 80, 3)] + [(None, 1, 1), (3, 1, 0), (3, 0, 0)]
    docs = spark.createDataFrame(made, DOCS)
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(rows(got)) == expected_audit(made, labels)


def test_audit_shuffles_no_text_and_runs_no_python(spark):
    docs = spark.createDataFrame(audit_rows(), DOCS).repartition(2)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    plan = filteraudit.masked(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan


def test_interactions_of_two_filters(spark):
    table = spark.createDataFrame([("p", 0, 1, 0), ("p", 1, 0, 0), ("p", 3, 1, 1), ("p", 3, 0, 0), ("q", 2, 0, 1)], "part string, mask int, good bigint, toxic bigint")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.interactions(table, "XY").collect()}
    assert got[("p", "XY", 1)] == (1, 3, 0, 1, 1, 1, 4) and got[("p", "XY", 2)] == (1, 0, 2, 0, 0, 0, 2)
    assert got[("p", "YX", 1)] == (2, 2, 0, 0, 1, 1, 2) and got[("q", "XY", 2)] == (0, 1, 0, 1, 0, 1, 2)
    assert len(got) == 8


# ---------------------------------------------------------------- divergence


def divergence_rows():
    rng = random.Random(6)
    words = ["the", "The", "ÉTÉ", "été", "a1b", "x", "naïve", "日本", "can't", "ab-cd", "zz\x00yy"] + [f"w{chr(97 + i)}" for i in range(26)]
    made = []
    for i in range(240):
        text = rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        made.append((i % 50, text, rng.choice([None, "en", "en", "fr"]), rng.choice([None, "s1", "s1", "s2", "é3"]), *CLASH))
    made += [(1, "the " * 500, "en", "s1", *CLASH)] * 12
    return made + [(2, None, "en", "empty", *CLASH), (3, "rare words", "xx", "s1", *CLASH), (4, None, "xx", "s2", *CLASH)]


def expected_divergence(made):
    n, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, source, *_ in made:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= 10]
        sources, v = [s for x, s in groups if x == lang], len(kept)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = lambda s, t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * v)  # noqa: E731, B023
        q = lambda t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * v)  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p(s, t), p(o, t)) for t in kept)) for o in sources if o != s]
            term = [(t, f(p(s, t), q(t))) for t in kept if n[lang, s][t] > 0 and p(s, t) > q(t)]
            for part, items, most in (("pair", pair, None), ("term", term, 10)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "shard"), [(64, 1 << 18), (3, 1 << 18), (64, 2)])
def test_divergence(spark, monkeypatch, bits, shard):
    """Also where every digest has collided, and where the sources of a language are in several shards."""
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "CELLS", 16)
    made = divergence_rows()
    got = divergence.audit(spark.createDataFrame(made, DOCS).repartition(3), bits=bits)
    assert sorted(rows(got)) == expected_divergence(made)


def test_shares_of_huge_counts(spark):
    many = [(3 * 10**12, 5 * 10**13, 10**9), (0, 1, 1), (10**14, 10**14, 5)]
    got = spark.createDataFrame(many, "a bigint, b bigint, c bigint").select(divergence.share(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (a + 2) // (b + 2 * c) for a, b, c in many]


def test_counting_shuffles_fixed_widths(spark):
    """The rows of the counting shuffle have no string."""
    docs = spark.createDataFrame(divergence_rows(), DOCS).select("text", "lang", "source")
    counted = docs.select(F.lit(1).cast("long").alias("lid"), F.lit(1).cast("long").alias("gid"), "text").na.fill("")
    out = counted.mapInArrow(divergence._counts((1 << 64) - 1), "lid bigint, gid bigint, digest bigint, n bigint, docs bigint")
    assert [t for _, t in out.dtypes] == ["bigint"] * 5 and out.count() > 0
