import random
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import plain, sql_rows  # noqa: E402

from celltide.llm import components, decontam, langid, license, mixing, neardup, queries, sharding, tokencount, topk, toxicity, urlfilter  # noqa: E402
from celltide.llm.common import Scratch  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "a"), (2, "", "a"), (None, "one two three", None), (5, "x" * 5000, "b"), (6, "Ab ab ab ab.\nMIT", "b"), (6, "Ab ab ab ab.\nMIT", "b"), (7, " \t\n", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 1.0) for r in ODD], "doc_id long, text string, source string, kept string, size double")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert plain(queries.queries()[name](spark, FOLDER).toPandas()) == sql_rows(queries.oracle_sql()[name], FOLDER)


def test_licenses_in_full_and_wrapped(spark):
    full = dict(license.FULL)
    header = textwrap.fill(dict(license.TEMPLATES)["GPL-3.0-or-later"], 60)
    code = "\n".join(f"int x{i} = f{i}(a{i});" for i in range(30))
    commented = "\n".join(f" * {x}" for x in header.splitlines())
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A B\n\n" + full["MIT"]), (2, f"/*\n{commented}\n */\n{code}"), (3, f"{code}\n{full['BSD-2-Clause']}\n{code}"),
        (4, "Some words before. Released under the MIT License. And some more words after it"), (5, code), (None, f"{code}\n{header}\n{code}\n{header}\n{code}"),
        (7, "a b\nReleased under the MIT License.\nc d"), (8, f"{code}\n{full['Apache-2.0']}\n{code}"),
    ]
    got = {r["doc_id"]: (r["n_units"], r["license"]) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == "MIT" and got[2] == (1, "GPL-3.0-or-later") and got[3][1] == "BSD-2-Clause" and got[4] == (1, "MIT")
    assert got[5] == (0, None) and got[None] == (2, "GPL-3.0-or-later") and got[7] == (1, "MIT") and got[8][1] == "Apache-2.0"


def test_odd_rows_keep_their_number(spark, odd):
    n = len(ODD)
    bench = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "item_id long, text string")
    assert mixing.mix(odd).count() == n and mixing.mix(odd.limit(0)).count() == 0
    assert neardup.near_duplicates(odd).count() == n and neardup.near_duplicates(odd.limit(0)).count() == 0
    found = decontam.find(odd, bench)
    assert found.count() == n and found.where("n_hit = 4").count() == 2
    assert decontam.find(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.clean(odd, bench, max_coverage=0.9).count() == n and decontam.clean(odd, bench).columns == odd.columns
    assert sharding.shard(odd, ["a", "b"]).where("shard is null").count() == 0
    assert license.scan(odd).count() == n and license.scan(odd).where("n_units > 0").count() == 0
    assert tokencount.token_counts(odd).count() == n
    assert toxicity.severity(odd, toxicity.fit([], [])).where("toxic").count() == 0
    model = langid.fit({}, langid.Pieces(["a", "b"]))
    assert {r[0] for r in odd.select(langid.predict(odd, model).alias("p")).select("p.lang_pred").collect()} == {"und"}


def test_near_duplicates_brute(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"z{rng.randrange(3)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(120)}


def test_near_duplicates_of_short_texts_in_tiles(spark, monkeypatch):
    # many short texts about one, at the query's own settings: links past the most central text are found in tiles
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "TILE", 20_000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(40)
            w[at] = f"{w[at]}x{rng.randrange(2)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(38)} for t in texts]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, neardup.Config(words=3, percent=85)).collect()}
    assert got == {i: find(i) for i in range(150)} and len(set(got.values())) > 1


def test_estimate_is_near():
    rng = np.random.default_rng(0)
    a = neardup.multipliers(240)
    for j in (0.3, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        h = rng.integers(0, 2**64, 2 * n - both, np.uint64)
        ra, rb = (neardup.registers(x, a, 1.02, 4000)[None] for x in (h[:n], h[n - both :]))
        assert abs(neardup.estimate(ra, rb, np.array([n]), np.array([n]), 1.02)[0] - j) < 0.12


def test_automaton_brute():
    rng = random.Random(5)
    word = lambda k: " ".join(f"v{rng.randrange(4)}" for _ in range(k))
    for _ in range(60):
        items = [(i, word(rng.randrange(0, 9)).encode()) for i in range(6)]
        a = decontam.Automaton.build(items, 4)
        w = word(rng.randrange(0, 40)).encode().split()
        spans, found = a.match(np.fromiter((a.ids.get(x, 0) for x in w), np.int64, len(w)))
        hit, want = set(), set()
        for i, t in items:
            t = t.split()
            n = min(4, len(t))
            for k in range(len(t) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[k : k + n]:
                        hit |= set(range(p, p + n))
                        want.add(i)
        assert (found, {k for b, e in spans for k in range(b, e)}) == (want, hit)


def test_several_automata_agree(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one, many = (decontam.find(docs, bench, max_words=m).select(cols).toPandas() for m in (10**6, 300))
    assert plain(one) == plain(many)


def test_clean_by_several_automata_agrees(spark):
    w = [f"w{i}" for i in range(100)]
    bench = spark.createDataFrame([(k, " ".join(w[b:e])) for k, (b, e) in enumerate([(0, 20), (14, 28), (30, 50), (50, 64), (70, 82)])], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(w[:n]), n) for k, n in enumerate((28, 64, 100, 5))] + [(9, " ".join(w[:28] + [f"x{i}" for i in range(60)]), 0)], "doc_id long, text string, n_chars long")
    one, many = (sorted(map(tuple, decontam.clean(docs, bench, max_words=m).collect())) for m in (10**6, 20))
    assert one == many and {r[0] for r in one} == {3, 9}


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "aba"])
    rng = np.random.default_rng(2)
    prob = np.append(rng.random(pieces.n), 0.0)[:, None]

    def every(w):
        return 1.0 if not w else sum(prob[pieces.ids[w[:k]], 0] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces.ids)

    model = langid.Model(pieces, ["x"], prob)
    for w in ("a", "abab", "bbaaba"):
        assert np.isclose(model.word_scores([w])[0, 0], np.log(every("▁" + w)))
        assert np.isclose(model._long(w)[0], np.log(every("▁" + w)))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(docs, ~held)
    p = docs.where(held).select("lang", langid.predict(docs, model).alias("p")).select("lang", "p.lang_pred").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97


def test_ordinal_thresholds():
    rng = random.Random(0)
    grades = [rng.randrange(4) for _ in range(600)]
    texts = [" ".join([f"n{rng.randrange(30)}" for _ in range(8)] + [f"bad{k}" for k in rng.sample(range(8), 2 * g)]).encode() for g in grades]
    m = toxicity.fit(texts[:400], grades[:400])
    mean, grade = m.predict(texts[400:])
    assert list(m.thresholds) == sorted(m.thresholds) and (grade == np.array(grades[400:])).mean() > 0.9
    assert np.corrcoef(mean, grades[400:])[0, 1] > 0.95


def test_grades_of_the_query_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").withColumn("grade", F.col("toxic"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = toxicity.train(known.where(~held))
    rows = known.where(held)
    got = toxicity.severity(rows, model).join(rows.select("doc_id", "grade").withColumnRenamed("grade", "is"), "doc_id").toPandas()
    assert (got.grade[got["is"] == 1] == 1).mean() > 0.8 and (got.grade[got["is"] == 0] == 0).mean() > 0.98
    # by the formula: P(grade <= k) = 1 / (1 + exp(score - threshold_k))
    text = {r["doc_id"]: r["text"].encode() for r in rows.collect()}
    for r in got.head(20).itertuples():
        score = sum(model.weights.get(w, 0.0) for w in toxicity.features(text[r.doc_id]))
        assert np.isclose(r.expected_severity, 1 - 1 / (1 + np.exp(score - model.thresholds[0])))


def test_toxicity_learns_distinct_texts(spark):
    # copies of one text leave room for others; null grades and texts go, and too many grades are an error
    rows = [("same text here", 0)] * 500 + [(f"kind word{i}", 0) for i in range(30)] + [(f"vile word{i}", 1) for i in range(30)] + [(None, 1), ("x", None)]
    df = spark.createDataFrame(rows, "text string, grade int")
    m = toxicity.train(df, sample_rows=25)
    assert m.predict([b"vile word3", b"kind word3"])[1].tolist() == [1, 0]
    with pytest.raises(ValueError):
        toxicity.train(df, max_grades=1)
    assert toxicity.severity(df.select(F.lit(1).alias("doc_id"), "text").limit(0), m).count() == 0


def test_kept_trees_over_rounds_of_edits(spark):
    rng = random.Random(8)
    count = tokencount.count_with()
    texts = ["word and more " * 400, "ab12" * 900, "x" * 3000, "", None, "don't it's; 'tis 'll\n\n a  b", "a"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    docs = tokencount.token_counts(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, extra string"), size=64)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == sorted((i, count(t or "")) for i, t in rows)
    kind = "array<struct<at int, remove int, put string>>"
    now = {i: t for i, t in enumerate(texts)}
    for _ in range(3):
        edits = {i: [(rng.randrange(60), rng.randrange(9), rng.choice(["", " new ", "'s", "9z"])) for _ in range(2)] for i in now}
        put = spark.createDataFrame(list(edits.items()), f"doc_id long, edits {kind}")
        docs = spark.createDataFrame(tokencount.edited_counts(docs.select("doc_id", "text", "tree").join(put, "doc_id"), size=64).collect(), "doc_id long, text string, n_tokens long, n_tokens_before long, n_reencoded long, rebuilt boolean, tree " + tokencount.TREE)
        for i, t in now.items():
            for at, cut, new in edits[i] if t is not None else ():
                at = min(at, len(t))
                t = t[:at] + new + t[at + cut :]
            now[i] = t
        for r in docs.collect():
            assert r["text"] == now[r["doc_id"]] and r["n_tokens"] == count(r["text"] or "") and not r["rebuilt"]
            assert r["n_reencoded"] < 1000 or r["doc_id"] == 2
    # the tree of another text, and an edit that is null
    other = docs.select("doc_id", F.lit("two words").alias("text"), "tree", F.lit(None).cast(kind).alias("edits")).where("doc_id = 0")
    assert [(r["n_tokens"], r["rebuilt"]) for r in tokencount.edited_counts(other).collect()] == [(2, True)] * 2


def test_edits_equal_a_full_count():
    rng = random.Random(1)
    count = tokencount.count_with()
    for _ in range(40):
        text = "".join(rng.choice(["ab", " ", "  ", "x1", "\n", " don't", "é", ".", "'s", "'", "-", "7", "\t", "\u00a0", "\x1c", "字", "²"]) for _ in range(rng.randrange(0, 400)))
        tree = tokencount.Tree(text, count, size=16)
        for _ in range(8):
            at, cut, put = rng.randrange(len(text) + 1), rng.randrange(12), rng.choice(["", " ", "new words", " x", "  "])
            text = text[:at] + put + text[at + cut :]
            tree.edit(at, cut, put)
            assert tree.text() == text and tree.total == count(text)
            assert tokencount.Tree(text, count, 16, tree.keep()).total == count(text)
    long = "word and more " * 5000
    tree = tokencount.Tree(long, count)
    tree.reencoded = 0
    tree.edit(30_000, 5, "other")
    assert tree.reencoded < 3000


def test_top_k_brute_with_ties():
    rng = np.random.default_rng(4)
    m = rng.integers(-2, 3, (50, 3))
    ids = np.sort(rng.permutation(50)).astype(np.int64)
    for q in (0, 7):
        s = topk.product(m[q : q + 1], m)[0]
        want = sorted((k for k in range(50) if k != q), key=lambda k: (-s[k], k))[:5]
        assert topk.best_of(s, ids, q, 5).tolist() == want


def test_top_k_tree(spark):
    rows = [(i, [float((i * k) % 7 - 3) / 64 for k in range(1, 5)] if i % 9 else None) for i in range(200)]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised("e").alias("v"))
    small, whole = (topk.top_k(v, F.col("vec_id") % 20 == 0, 4, *b).toPandas() for b in ((4, 8), (1000, 1000)))
    assert plain(small) == plain(whole) and len(small) > 0


def test_top_k_brute_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [(i * k) % 5 - 2.0 for k in (1, 2)]) for i in range(60)] + [(20, [1.0, 1.0]), (20, [1.0, 1.0]), (21, []), (22, None), (23, [nan, 1.0]), (24, [1.0, None]), (None, [1.0, 1.0])]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [3.0, 1.0, 0.5])]  # of another length
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, e array<double>, score int").select("vec_id", topk.quantised("e", 4.0).alias("v"), "score")
    good = [(i, [int(np.floor(4 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in good if i % 20 == 0}:
        mine = {tuple(v) for i, v in good if i == q}
        found = sorted(((-sum(a * b for a, b in zip(m, v, strict=True)), i) for m in mine for i, v in good if i != q and len(v) == len(m)))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:7])}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, 2, 9)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shards_of_the_query(spark):
    import hashlib

    t = sharding.lookup_table(queries.SHARDS)
    got = queries.op7_sharding(spark, FOLDER).collect()
    assert all(r["slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % len(t) and r["shard"] == queries.SHARDS[t[r["slot"]]] for r in got)


def test_table_is_claimed_in_turns():
    # each shard claims, in its turn, the first free slot in its own order
    names, size = ["a", "b", "c"], 31
    import hashlib

    free, want, orders = set(range(size)), {}, []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:], "big") % (size - 1) + 1
        orders.append([(at + i * step) % size for i in range(size)])
        assert set(orders[-1]) == free
    k = 0
    while free:
        slot = next(x for x in orders[k] if x in free)
        want[slot] = k
        free.discard(slot)
        k = (k + 1) % 3
    assert sharding.lookup_table(names, size) == [want[i] for i in range(size)]


def test_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(names, 1009)
    sizes = np.bincount(t)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert np.mean([a != b for a, b in zip(t, fewer, strict=True)]) < 0.4
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_aliases_inherit_blocks(spark):
    page = lambda i, url, to=None, kind="c": (i, url, None if to is None else f"<head><link rel='canonical' href=\"{to}\"></head>" if kind == "c" else f'<meta http-equiv="refresh" content="0; url={to}">')
    rows = [
        page(1, "http://a.de/x", "http://bad.com/en/1"), page(2, "http://b.de/y", "http://a.de/x", "r"), page(3, "http://c.de/"), page(4, None), page(5, "no url"),
        page(6, "https://ok.example.com/en/7", "http://z.com/en/2"), page(7, "http://q.de/r", "/en/9"), page(8, "http://f.de/", "http://example.com/en/70"), page(9, "http://f.de/g", "http://bad.com/en/5"), page(10, "http://f.de/", "http://f.de/g"),
    ]
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got[1] == ("block", None) and got[2] == ("block", None) and got[3] == ("allow", None)
    assert got[4] == got[5] == ("allow", None) and got[6] == ("allow", "example.com/en/7") and got[7] == ("allow", None)
    assert got[8][0] == got[9][0] == got[10][0] == "allow"  # an explicitly allowed alias outweighs a blocked one


def test_targets_are_resolved(spark):
    link = lambda to, base="": f"<head>{base}<link rel=canonical href='{to}'></head>"
    rows = [
        (1, "http://a.de/x/y/z", link("../../en/1")), (2, "http://b.de/q", link("en/1", '<base href="http://bad.com/">')), (3, "http://c.de/q", link("http:&#x2F;&#47;bad.com/en/1?a=1&amp;b=2")),
        (4, "http://d.de/q", link("http://bad.com/./x/../en/1")), (5, "http://bad.com/en/1?a=1&b=2", None), (6, "http://bad.com/x", link("/en/1")), (7, "http://all.org", None), (8, "http://e.de", link("http://all.org/")),
    ]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, verdict string, node int")
    rules = [("bad.com/en/", "block"), ("all.org/", "block")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block"}
    # as many rules as are joined instead
    many = rules + [(f"h{i}.net/p{i}/", "block") for i in range(300)]
    more = pages.unionByName(spark.createDataFrame([(20, "http://w.h7.net/p7/x", None, "", 1), (21, "http://h7.net/p8/", None, "", 1), (22, None, None, None, None)], pages.schema))
    got2 = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge(more, many).collect()}
    assert {i: v for i, (v, _) in got2.items() if i < 20} == got and got2[20] == ("block", "h7.net/p7/") and got2[21] == got2[22] == ("allow", None)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_languages_of_odd_rows_and_brute(spark):
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba"])
    rng = np.random.default_rng(5)
    prob = np.concatenate([rng.random((pieces.n, 2)) + 0.01, np.zeros((1, 2))])
    model = langid.Model(pieces, ["x", "y"], prob)

    def every(w, k):
        return 1.0 if not w else sum(prob[pieces.ids.get(w[:n], 0), k] * every(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in pieces.ids or n == 1)

    rows = [(1, "ab ba, AB!", "k"), (1, "ab ba, AB!", "k"), (None, "bbab", None), (3, "12 .", "k"), (4, None, "k"), (5, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = docs.select("text", langid.predict(docs, model).alias("p")).select("text", "p.*").collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split()]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [np.prod([every("▁" + w, k) for w in words]) for k in (0, 1)]
        assert r["lang_pred"] == "xy"[int(np.argmax(total))] and np.isclose(r["score"], max(total) / sum(total))


def test_clean_keeps_columns_of_any_name(spark):
    w = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(None, " ".join(w[:20])), (2, " ".join(w[10:25])), (2, None)], "item_id long, text string")
    rows = [(1, " ".join(w), 5, "k", [1]), (1, " ".join(w), 5, "k", [1]), (None, " ".join(w), 6, "k", None), (3, "clean words", 11, "k", [2]), (4, None, None, "k", [3]), (5, " ".join(w[:12]), 1, "k", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `row` string, `x.y` array<int>")
    one, many = (sorted(map(repr, decontam.clean(docs, bench, max_words=m).collect())) for m in (10**6, 10))
    assert one == many and len(one) == 5 and decontam.clean(docs, bench).columns == docs.columns
    left = " " + " ".join(w[25:])
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in decontam.clean(docs, bench).collect()} == {(1, left, len(left)), (None, left, len(left)), (3, "clean words", 11), (4, None, None)}
    for m in (10**6, 10):
        found = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontam.find(docs, bench, max_words=m).collect()}
        assert found == {(1, 25, 1), (None, 25, 1), (3, 0, 0), (4, 0, 0), (5, 12, 0)}


def test_weights_per_document(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), (F.col("id") % 4 + 1).alias("q"))
    r = mixing.mix(docs, (1.0,), 0.5, 2.0, weight_col="q").toPandas().set_index("doc_id")
    assert abs(r.taken.sum() - 800) <= 4
    by = r.taken.groupby(r.index % 4).sum()
    assert by[3] > by[0]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = p.identify_language(spark, docs, FOLDER)
    assert out.columns == docs.columns and out.count() > 0.98 * docs.where("text rlike '[a-z]'").count()
    clean = p.decontaminate(spark, docs, FOLDER)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert clean.columns == docs.columns and decontam.find(clean, bench).where("contaminated").count() == 0
    mixed = p.mix_sources(spark, docs, FOLDER)
    assert mixed.columns == docs.columns


def test_repeat_holds_each_row_as_often_as_the_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 7)) if i % 11 else None, [None, "a", "b", "c"][i % 4], "x") for i in range(300)] + [(None, "w w", "a", "y")]
    # one id for many texts, rows without an id, and rows alike in everything
    rows += [(7, f"w w {i}", "b", "x") for i in range(200)] + [(None, f"n {i}", "c", "x") for i in range(200)] + [(9, "s s s", "d", "x")] * 301
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got, mixed = mixing.repeat(docs, weight_col=F.length("text")), mixing.mix(docs, weight_col=F.length("text")).toPandas()
    assert got.columns == docs.columns and len(mixed) == len(rows)
    want = mixed[mixed.copies > 0].groupby(["doc_id", "source", "size"], dropna=False).copies.sum()
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    have = got.groupBy("doc_id", "source", size.alias("size")).count().toPandas().set_index(["doc_id", "source", "size"])["count"]
    assert have.sort_index().tolist() == want.sort_index().tolist() and len(have) == len(want)
    by = mixed.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all() and (mixed.taken <= 2 * mixed["size"]).all()
    assert mixing.repeat(docs.limit(0)).count() == 0


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (7, text("c")), (7, text("d")), (7, text("d")), (None, text("e")), (None, text("e")), (None, text("f")), (None, text("c"))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = p.drop_near_duplicates(spark, docs, FOLDER)
    want = [(1, text("a")), (2, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (None, text("f"))]
    assert got.columns == docs.columns and sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_every_label_is_learned(spark):
    # copies of one text, and a language of long texts only
    rows = [("the cat sat on the mat", "en")] * 60 + [(f"der hund und die katze {k}", "de") for k in range(20)] + [("le chat est ici " * 40, "fr")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), sample_docs=1, sample_chars=300)
    assert model.langs == ["de", "en", "fr"]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_components_brute(spark, monkeypatch, rows):
    """Against union-find: a hub, a chain, loops, repeats and null ends, with broadcast and with shuffled minima."""
    rng = np.random.Generator(np.random.PCG64(5))
    edges = [(0, int(i)) for i in rng.integers(1000, 1400, 500)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7), (3, None), (None, None)]
    edges += [tuple(map(int, x)) for x in rng.integers(3000, 3200, (120, 2))]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    monkeypatch.setattr(components, "BROADCAST_ROWS", rows)
    with Scratch(spark) as s:
        found = components.connected_components(spark.createDataFrame(edges, "u long, v long"), s)
        assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in root}
        assert components.connected_components(spark.createDataFrame([], "u long, v long"), s).isEmpty()


def test_stages_take_columns_of_any_name(spark):
    """All but the last return the columns of their input, whatever those are called."""
    import corpus_pipeline as p

    names = ["__id", "__hash", "k_id", "d", "p", "id", "hash", "a.b", "__p"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 30")
    docs = docs.union(docs.where("doc_id < 3")).select("*", *[F.col("doc_id").alias(n) for n in names])
    for stage in (p.identify_language, p.drop_near_duplicates, p.decontaminate, p.mix_sources):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        kept = out.select("doc_id", *[F.col(f"`{n}`") for n in names]).collect()
        assert kept and all(set(r) == {r[0]} for r in kept)
    assert p.drop_near_duplicates(spark, docs, FOLDER).count() == docs.select("doc_id").distinct().count() - len(_copies(docs))


def _copies(docs):
    """Ids of documents with the text of an earlier one."""
    first, found = {}, set()
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        if first.setdefault(r.text, r.doc_id) != r.doc_id:
            found.add(r.doc_id)
    return found
