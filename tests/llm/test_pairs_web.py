"""Jaccard join, components, SentencePiece, URL filter, HTML extraction and the pipeline against brute force."""

import html as stdlib_html
import random
import re
import time
import tracemalloc
import weakref

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import corpus_pipeline
from pyspark.sql import functions as F
from panelquant.llm import common, components, html, jaccard, langid, pieces, queries, urls

from .tables import LONG, collected, documents


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_classes(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, len(sets[i]), low.get(root(i)) if sets[i] else doc, root(i)) for i, (doc, _) in enumerate(rows)]


def near_copies(rng, groups=12, members=14):
    """Groups of edited copies whose similarities lie around the threshold, and texts that share a passage."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(25)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([4, 12, 40, 150]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts.append(" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]))
    return texts


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_near_classes(spark, size, percent):
    rng = random.Random(size)
    texts = near_copies(rng)
    rng.shuffle(texts)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "É x"), (907, "é x"), (3, texts[3]), (3, texts[7]),
            (None, texts[5]), (None, "nobody has this text"), (None, "nobody has this text"), (910, LONG), (911, LONG + "end")]
    out = jaccard.near_classes(documents(spark, rows, "node"), size=size, percent=percent).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    want = brute_classes(rows, size, percent)
    assert got == sorted((w[:3] for w in want), key=str)
    classes = len({w[3] for w in want if w[1] and w[2] is not None})
    kept = {(r.doc_id, r.row_id) for r in out if r.kept and r.n_shingles and r.component_id is not None}
    assert len(kept) == classes


def test_drop_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(4, base), (2, base + " more"), (9, "other"), (5, None), (None, base), (9, "other")], "row")
    out = jaccard.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert [r["doc_id"] for r in collected(out, "doc_id")] == [2, 5, 9, 9]
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("Some wörds, and  more\n\twords " * 20).encode()
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "PIECE", 50)
    assert np.array_equal(whole, jaccard.word_hashes(text))
    assert len(set(jaccard.word_hashes(b"a A b ab a b").tolist())) == 3


def test_worker_keeps_tables_of_one_step(monkeypatch):
    class Task:
        stage = 1

        @classmethod
        def get(cls):
            return cls

        @classmethod
        def stageId(cls):  # noqa: N802
            return cls.stage

    monkeypatch.setattr(common, "TaskContext", Task, raising=False)
    model, texts = pieces.installed_model(), pa.array(["a b c d e f"])
    near, lists = jaccard._signature(80, 5).func, jaccard._ngram_lists(5).func
    for other in (near, lists):
        tables = weakref.ref(pieces._load(model))
        assert pieces._load(model) is tables()
        other(texts)
        assert tables() is not None  # a step of the same stage
        Task.stage += 1
        other(texts)
        assert tables() is None


def test_ngram_lists_are_no_python_integers():
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(2000)) for _ in range(100)]
    values, total = pa.array(texts), 100 * 1996
    run = jaccard._ngram_lists(5).func
    run(values[:1])
    tracemalloc.start()
    try:
        out = run(values)
        assert tracemalloc.get_traced_memory()[1] < 24 * total
    finally:
        tracemalloc.stop()
    assert [len(x) for x in out] == [1996] * 100
    assert sorted(out[7].as_py()) == sorted(jaccard.ngrams(texts[7].encode(), 5).view(np.int64).tolist())
    assert jaccard._signature(80, 5).func(pa.array(["", None, "a b"])).to_pylist()[:2] == [{"n": 0, "node": None, "l": 0, "prefix": []}] * 2


def test_stages_get_long_texts_in_bounded_batches(spark, tmp_path):
    key, n, length = "spark.sql.execution.arrow.maxBytesPerBatch", 60, 400_000
    spark.createDataFrame([(1, "ten words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, ["short text", None, ""])
    texts = spark.range(0, n, 1, 1).select(F.repeat(F.lit("w "), length // 2).alias("text"))
    size = F.arrow_udf(lambda values: pa.array([values.nbytes] * len(values), pa.int64()), "long")
    largest = lambda: texts.select(size("text").alias("size")).agg(F.max("size")).first()[0]
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            assert largest() > 2 * common.BATCH_BYTES
            stage(spark, docs, str(tmp_path))
            if name != "exact_dedup":  # runs no Python
                assert largest() < common.BATCH_BYTES + 2 * length, name
        for own, then in (("1m", "1m"), ("1g", str(common.BATCH_BYTES))):
            spark.conf.set(key, own)
            common.bound_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.unset(key)


def test_shuffle_of_prefixes_is_let_go_before_ngrams(spark, monkeypatch):
    done, settle, lists = [], jaccard.settle, jaccard._ngram_lists
    monkeypatch.setattr(jaccard, "settle", lambda df: (settle(df), done.append("written"))[0])
    monkeypatch.setattr(jaccard, "free_shuffles", lambda spark: done.append("freed"))
    monkeypatch.setattr(jaccard, "_ngram_lists", lambda size: (lists(size), done.append("n-grams"))[0])
    jaccard.near_classes(documents(spark, ["a b c d e f g", "a b c d e f g h", "x y"]))
    assert done[done.index("n-grams") - 2:][:2] == ["written", "freed"]


def test_prefixes_are_counted_in_tasks_that_follow_the_ngrams(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GRAMS_A_TASK", 100)
    rows = [(node, [node * 100 + k for k in range(40)] + [-1 - node % 7, -50]) for node in range(50)]
    nodes = spark.createDataFrame(rows, "node long, prefix array<int>").coalesce(1)
    tasks = []
    groups = type(nodes).groupBy
    monkeypatch.setattr(type(nodes), "groupBy", lambda self, *cols: tasks.append(self.rdd.getNumPartitions()) or groups(self, *cols))
    repeated = jaccard._repeated(nodes)
    assert tasks[-1] == 1 + 50 * 42 // 100
    assert sorted(r.gram for r in repeated.collect()) == sorted([-50, *range(-7, 0)])
    assert not jaccard._repeated(nodes.limit(0)).collect()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_pieces_match_the_model_without_dropout():
    import sentencepiece

    model = pieces.installed_model()
    p, sp = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(10)
    parts = ["the", "ing", " ", "  ", "É", "語", "\n", "12", "²", "foo_bar", "();", "antidis", "x" * 70, "‍", "नम", "A"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert p.encode(text) == sp.encode(text)
        for dropout in (0.1, 0.5, 1.0):
            ids = p.encode(text, rng.randrange(9), dropout, seed=3)
            assert p.decode(ids) == text
    assert p.decode(p.encode("a▁b ▁")) == "a▁b ▁"
    varied = {tuple(p.encode("representations of straightforward", k, 0.3, seed=1)) for k in range(4)}
    assert len(varied) > 1 and p.encode("of it", 5, 0.3, 1) == p.encode("of it", 5, 0.3, 1)
    for _ in range(1000):
        chunk, key = " " + "".join(rng.choice(["th", "er", "ing", "a", "語"]) for _ in range(rng.randint(0, 25))), rng.getrandbits(30)
        assert p._merge_short(chunk, key, 1 << 27) == p._merge_long(chunk, key, 1 << 27)


def test_every_occurrence_skips_merges_of_its_own(monkeypatch):
    p, rng = pieces.Pieces(pieces.installed_model()), random.Random(12)
    word = "representations"
    over_texts = {tuple(ids.tolist()) for ids in p.encode_many([word] * 400, list(range(400)), 0.1, 1)}
    assert len(over_texts) > 8  # with four variants there were at most four
    chunks = [" " + word] * 400
    keys = pieces.occurrence_keys(1, [7], np.array([400]))
    assert len({tuple(p.merge(c, k, 107374182)) for c, k in zip(chunks, keys.tolist(), strict=True)}) > 8
    assert 0.05 < np.mean([pieces._hash(k, 0, 5) < 107374182 for k in keys.tolist()]) < 0.15
    parts = ["the", "ing", " ", "  ", "É", "語", "\n", "12", "foo_bar", "();", "antidis", "x" * 70, " " * 9, "A"]
    for _ in range(60):  # what is remembered gives the ids of merging each occurrence alone
        monkeypatch.setattr(pieces, "CACHED", rng.choice([10, 600_000]))
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(20)]
        doc_keys = [rng.getrandbits(64) - (1 << 63) for _ in texts]
        cut = [p.chunks(" " + t) if t else [] for t in texts]
        keys = iter(pieces.occurrence_keys(3, doc_keys, np.array([len(c) for c in cut])).tolist())
        dropout = rng.choice([0.1, 0.5, 1.0])
        for chunks, ids in zip(cut, p.encode_many(texts, doc_keys, dropout, 3), strict=True):
            assert ids.tolist() == [i for c in chunks for i in p.merge(c, next(keys), int(dropout * (1 << 30)))]


def test_pieces_table(spark):
    texts = ["Hello  world\n", None, "", LONG, "same", "same", "  lead"]
    docs = documents(spark, [*enumerate(texts), (None, "no id")], "ids")
    model = pieces.installed_model()
    out = collected(pieces.decode(pieces.encode(docs, model, dropout=0.2), model, out="back"), "doc_id")
    assert [r["back"] for r in out] == ["no id", "Hello  world\n", "", "", LONG, "same", "same", "  lead"]
    both = collected(pieces.round_trip(docs, model, dropout=0.2), "doc_id")
    assert [(r["coded"]["ids"], r["coded"]["text"]) for r in both] == [(r["ids"], r["back"]) for r in out]
    assert pieces.encode(docs.limit(0), model).count() == pieces.round_trip(docs.limit(0), model).count() == 0


def brute_ranks(edges, seeds, steps, unit):
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    mass = {h: m for h, m in seeds.items() if m > 0}
    for _ in range(steps):
        new = {h: m * 3 // 20 for h, m in seeds.items() if m > 0}
        for a, b in edges:
            if mass.get(a):
                new[b] = new.get(b, 0) + mass[a] * 17 // (20 * degree[a])
        mass = {h: m for h, m in new.items() if m > 0}
    return mass


def test_urls(spark):
    rng = random.Random(11)
    hosts = [f"h{i}.org" for i in range(12)] + ["bad.net", "sub.bad.net", "x.example.net", "y.example.com", "z.org"]
    rows, edges = [], set()
    for k in range(120):
        host = rng.choice(hosts)
        to = [rng.choice(hosts) for _ in range(rng.randint(0, 3))]
        page = "".join(f'<a class="l" href="{rng.choice(["http:", "HTTPS:", ""])}//{t.upper()}/p?q">t</a> <a href=\'/own\'>o</a>' for t in to)
        edges |= {(host, t) for t in to if t != host}
        rows.append((k, f"https://{host}{rng.choice(['/fr/1', '/en/2', '/de/', '', '?x', '/fr'])}", page))
    rows += [(200, None, None), (201, "no scheme", "<a href='http://h1.org'>x</a>"), (202, "HTTP://A.NET#f", ""), (203, "ftp://org/fr/x?y#z", None), (203, "ftp://org/fr/x?y#z", None), (204, "://net/", "")]
    pages = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, host string")
    out = urls.judge(pages).collect()
    assert len(out) == len(rows)
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    ruled, seeds = {}, {}
    for k, url, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        ruled[k] = (host, path, fit[0][1] if fit else None, fit[0][0] if fit else None)
        n = seeds.setdefault(host, [0, 0, 0])
        n[0] += 1
        if fit:
            n[1 if fit[0][0] == "allow" else 2] += 1
    seeds.pop("", None)
    trust = brute_ranks(sorted(edges), {h: n[1] * urls.UNIT // n[0] for h, n in seeds.items()}, 200, urls.UNIT)
    distrust = brute_ranks(sorted((b, a) for a, b in edges), {h: n[2] * urls.UNIT // n[0] for h, n in seeds.items()}, 200, urls.UNIT)
    for r in out:
        host, path, rule, verdict = ruled[r.page_id]
        bad = distrust.get(host, 0) - trust.get(host, 0) >= 0.5 * urls.UNIT * 3 // 20
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if bad else "allow"))
    assert {"allow", "block"} == {r.verdict for r in out if r.rule is None}
    assert urls.judge(pages.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.drop("host").toPandas())
    want = con.execute(queries.ORACLE["op4_url_filter"]).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, want)) == sorted(key((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out)


def test_ranks_on_long_chains_are_converged(spark):
    edges = [(f"c{k + 1}", f"c{k}") for k in range(14)] + [(f"f{k + 1}", f"f{k}") for k in range(24)] + [("f0", f"s{k}") for k in range(200)]
    bad = ["c0", *(f"s{k}" for k in range(200))]
    out, back = {}, {}
    for a, b in edges:
        back.setdefault(b, []).append(a)
    wave = dict.fromkeys(bad, 0.15)
    for _ in range(200):  # distrust walks from a host to those that link to it
        for h, m in wave.items():
            out[h] = out.get(h, 0) + m
        new = {}
        for h, m in wave.items():
            for a in back.get(h, ()):
                new[a] = new.get(a, 0) + 0.85 * m / len(back[h])
        wave = new
    links = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(h, 0, urls.UNIT) for h in bad], "host string, trust long, distrust long")
    got = {r.host: r.distrust / urls.UNIT for r in urls.propagate(links, seeds).collect()}
    assert all(got.get(h, 0) == pytest.approx(m, abs=1e-4) for h, m in out.items())
    blocked = {h for h, m in got.items() if m >= 0.075}
    assert {f"c{k}" for k in range(15)} & blocked == {f"c{k}" for k in range(5)}
    assert {f"f{k}" for k in range(25)} <= blocked


PAGE = """<html><head><title>t</title><script>var a="</p><p>x";</script><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you.</div>
<article><h1>Head&amp;line</h1><p>One  paragraph<br>with &lt;b&gt; &eacute; and <a href=x>a link</a> in it that goes on for a while.<p>Short.
<div class="ad">Buy now, this is the best offer of the week for all readers of this page.</div><p class="comment">I like this article very much, thank you for all of it.</p>
<aside><p>Related: this and that, with many words in a long teaser that nobody reads.</p></aside><p>The end</article>
<form><p>Your name here please</p><input></form><div id="comments"><p>First! What a nice article, I read all of it twice.</p></div><footer>&copy; all</footer></body>"""
MAIN = "Head&line\n\nOne paragraph with <b> é and a link in it that goes on for a while.\n\nShort.\n\nThe end"


def test_html(spark):
    tree = html.train(spark)
    rows = html.labelled_table()
    assert len(rows) <= 300 and all(html.keeps(tree, tuple(x)) == (y > 0.5) for x, y in rows)
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", PAGE[:PAGE.index("The end") + 7], "x"), (4, "u", "<article><p>" + LONG + "</article>", "x"), (5, "u", "<p <", "x")],
                                  "page_id long, url string, html string, text string")
    out = collected(html.extract(pages, tree), "page_id")
    assert [r["text"] for r in out][:4] == [MAIN, "", "", MAIN] and out[4]["text"] == " ".join(LONG.split())
    assert html.extract(pages.limit(0), tree).count() == 0


def test_html_of_deep_and_stray_tags():
    page = "<div>" * 20_000 + "</section>" * 20_000 + "<p>one</p></div><nav><p>menu</div>" + "</div>" * 5 + "<article><p>two</article>"
    begin = time.process_time()
    found = html.blocks(page)
    assert time.process_time() - begin < 3
    assert [(b.furniture, b.article) for b in found] == [(False, False), (True, False), (False, True)]


def test_html_articles(spark):
    tree = html.train(spark)
    for page_id, page in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(stdlib_html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("<(?:p|h1)>", article)]
        assert html.main_text(page, tree) == "\n\n".join(p for p in parts if p), page_id


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = langid.train(docs)
    chance = 1 / len(model.families) / (2 if all(len(m) > 1 for m in model.members.values()) else 1)
    keep = {i for i, t in rows.items() if any(c.isalpha() for c in t or "") and model.predict(t.encode())[1] >= chance + 0.05 * (1 - chance)}
    first = {}
    for i in sorted(keep):
        first.setdefault(rows[i], i)
    keep = sorted(first.values())
    comp = {i: c for i, _, c, _ in brute_classes([(i, rows[i]) for i in keep], 5, 80)}
    keep = [i for i in keep if comp[i] == i]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    wins = {tuple(w[i:i + 10]) for t in bench for w in [low(t)] for i in range(max(1, len(w) - 9))}
    keep = [i for i in keep if not any(tuple(w[k:k + 10]) in wins for w in [low(rows[i])] for k in range(max(1, len(w) - 9)))]
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == keep
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in out)
    assert len(corpus_pipeline.STAGES) == 5
    odd = documents(spark, [(None, None), (1, None), (2, ""), (3, "12 34"), (4, "the text of it"), (4, "the text of it"), (None, "some words here")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, odd = odd.columns, stage(spark, odd, sf)
        assert odd.columns == before
    assert sorted(r.text for r in odd.collect()) == ["some words here", "the text of it"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
