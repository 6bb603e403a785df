"""Edge rules and brute-force comparisons of the text operators on small tables."""

import base64
import hashlib
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tickweave.llm import exact_topk, graph, hilbert_ann, html_extract, mixing, ngram_join, packing, queries, secrets, toxicity, url_rules, warc
from tickweave.llm.text import shingle_hashes, word_hashes

WORDS = [f"w{i}" for i in range(400)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double, key long")


def _doc(i, text):
    return (i, text, "s", "en", 0, 1.0, 7)


def test_html_region_and_edges(spark):
    page = '<html><body><nav><a href=x>Home</a> <a href=y>About</a></nav><div class="ad">Buy now please.</div><article><h1>One</h1><p>Two <b>th</b>ree &amp; four<br>five.</p><aside>skip</aside><p>Six</p></article><footer>bye</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (3, "u", "", "y"), (4, "u", "plain words", "z"), (5, "u", "<p>open <b", "z")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(df).orderBy("page_id").collect()]
    want = "One Two three & four five. Six"
    assert got[:5] == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain words", 11)]
    assert html_extract.extract_main_text(df.limit(0), weight=html_extract.weights({}, {})).count() == 0


def test_mixing_meets_margins_and_edges(spark):
    rows = [(i, " ".join(["w"] * (10 + i % 7)), f"s{i % 3}", "en" if i % 4 else "de", 0, 0.0, 0) for i in range(300)] + [(900, None, None, None, 0, 0.0, 0), (901, "", "s1", "en", 0, 0.0, 0)]
    df = _docs(spark, rows)
    goals = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"short": 1.0}}
    out = mixing.mix(df, goals=goals)
    share = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
    total = sum(share.values())
    assert abs(share["s0"] / total - 0.5) < 1e-4 and abs(share["s2"] / total - 0.2) < 1e-4
    assert out.agg(F.max("probability")).head()[0] == 1.0
    assert out.filter("doc_id >= 900").agg(F.min("probability")).head()[0] == 1.0
    assert mixing.mix(df.limit(0)).count() == 0


def test_secrets_spans_ledger_and_redaction(spark):
    texts = ['é password = "abcdefgh1" x', "AKIA" + "B" * 12 + " token:short", "f" * 40, "TOKEN='" + "a1" * 20 + "'", None, "", "nothing"]
    df = _docs(spark, [_doc(i, t) for i, t in enumerate(texts)] + [_doc(0, texts[0])])
    found, added = secrets.scan_versions(df, "doc_id", "text")
    kinds = [r.kind for r in secrets.BASE_RULES]
    got = {r["path"]: r["s"] for r in found.select("path", secrets.listed(kinds).alias("s")).collect()}
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for i, t in enumerate(texts):
        want = [(m.start(), k, m.end()) for k, p in (("assign", assign), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))) for m in p.finditer(t or "") if len(m[2] if k == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[k]]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want, key=lambda w: (w[0], kinds.index(w[1])))), t
    assert found.count() == 8 and added.count() == 3 * 6  # the repeated row and the two empty texts share blobs
    again, more = secrets.scan_versions(df, "doc_id", "text", added)
    assert more.count() == 0 and sorted(map(tuple, again.select("path", secrets.listed(kinds)).collect())) == sorted(map(tuple, found.select("path", secrets.listed(kinds)).collect()))
    spans = spark.createDataFrame([("0123456789", [(2, 4)], [(3, 6)])], "t string, a array<struct<start:long,stop:long>>, b array<struct<start:long,stop:long>>")
    assert spans.select(secrets.redact(F.col("t"), ["a", "b"])).head()[0] == "01[secret]6789"


def _vectors(spark, n=400, d=8):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((n, d)) * rng.uniform(0.1, 5, (n, 1))).astype(np.float32)
    v[50:90] = v[50]  # ties
    rows = [(i, [float(x) for x in v[i]], 0, 0) for i in range(n)] + [(7, [float(x) for x in v[7]], 0, 0), (n, None, 0, 0), (n + 1, [1.0, None] * 4, 0, 0), (n + 2, [float("nan")] * 8, 0, 0), (n + 3, [], 0, 0)]
    return v.astype(np.float64), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int")


def _brute(scores, k):
    return [(q, r + 1, int(c)) for q, s in scores for r, c in enumerate(sorted((c for c in range(len(s)) if c != q), key=lambda c: (-s[c], c))[:k])]


def test_exact_topk_equals_brute_force(spark):
    v, df = _vectors(spark)
    z = np.floor(v * 1024).astype(np.int64)
    want = _brute([(q, z @ z[q]) for q in range(0, 400, 10)], 10)
    got = exact_topk.top_k(df, F.col("vec_id") % 10 == 0, block_rows=64, query_rows=16)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted(want)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_ann_recall_and_whole_small_tables(spark):
    v, df = _vectors(spark)
    want = set(_brute([(q, v @ v[q]) for q in range(0, 400, 20)], 20))
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in hilbert_ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert len(want & got) / len(want) > 0.99
    assert hilbert_ann.search(df.limit(0), F.lit(True)).count() == 0
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 2), -1).reshape(-1, 2)
    at = grid[np.argsort(hilbert_ann.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()  # a curve: every step goes to a neighbouring cell


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  world \n\n x", " lead", "a\n b \nc", "é ß <|endoftext|> y", "word " * 3000, "", None, "tab\t x", "trail "]
    rows = packing.pack(_docs(spark, [_doc(i, t) for i, t in enumerate(texts)] + [_doc(0, texts[0])]), queries.TOKENIZER).collect()
    tok = Tokenizer.from_file(queries.TOKENIZER)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        own = sorted({(r["start"], r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] == i})
        assert np.frombuffer(b"".join(o[2] for o in own), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0], t
        assert all(n & (n - 1) == 0 and n <= 1024 for _, n, _ in own)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>", 0), (2, "http://a/", "<p>é</p>", 0), (3, None, None, 0), (4, "u", "", 0), (5, "u\r\nx", "z", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, data int")
    got = {r["page_id"]: r for r in warc.archive_and_read(df, path=str(tmp_path / "w")).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4, 5)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    assert all(got[i]["payload_digest"] == digest(t or "") and got[i]["payload_bytes"] == len((t or "").encode()) for i, _, t, _ in rows)
    records = {r["page_id"]: bytes(r["record"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    head, _, rest = records[2].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4 and rest.endswith("<p>é</p>\r\n\r\n".encode())
    assert warc.archive_and_read(df.limit(0), path=str(tmp_path / "e")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 80))) for _ in range(40)]
    for base in (3, 4, 5):
        for _ in range(15):
            w = texts[base].split()
            for _ in range(rng.integers(0, 3)):
                if w:
                    w[rng.integers(len(w))] = str(rng.choice(WORDS))
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, "...", "one two", "one two"]
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    n = len(texts)
    links = [sum(near(sets[i], sets[j]) for j in range(n) if j != i) for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *[root[j] for j in range(n) if near(sets[i], sets[j])]]) for i in range(n)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(_docs(spark, [_doc(i, t) for i, t in enumerate(texts)])).collect()}
    assert got == {i: (root[i], links[i]) for i in range(n)}


def test_components_and_hashes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 4), (6, 6), (9, 10), (None, 3)], "a long, b long")
    assert {(r["node"], r["root"]) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (4, 4), (5, 4)}
    h, o = word_hashes(["A b", None, "b a", "", "é"])
    assert o.tolist() == [0, 0, 2, 2, 4] and h[0] == h[3] and h[1] == h[2]
    assert len(shingle_hashes(h, o, 5)[0]) == 3 and shingle_hashes(*word_hashes([]), 0)[0].size == 0


def test_url_rules(spark):
    urls = ["http://A.Net/x?y", "https://example.net/en/1", "https://m.example.net/en", "http://sub.example.com/de/q", "x://org/fr/", "http://notexample.net/", None, "no scheme", "http://q.io/casino/1?k=2", "http://net"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, f"http://h{i % 7}.io/{'casino' if i % 2 else 'news'}/{i}", 1) for i in range(200)], "page_id long, url string, tokens int")
    labels = spark.createDataFrame([(100 + i, 0 if i % 2 else 1, 0) for i in range(200)] + [(101, 0, None), (8, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("net/", "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2:] == (None, "block") and got[9] == ("net", "", None, "allow")
    assert url_rules.judge(pages, labels.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def test_toxicity_held_out_accuracy(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1500):
        w, bad = list(rng.choice(WORDS, rng.integers(5, 60))), i % 3 == 0
        if bad:
            for _ in range(max(2, len(w) // 15)):
                w[rng.integers(len(w))] = str(rng.choice(["vile", "foul", "nasty"]))
        rows.append(_doc(i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [_doc(5000, None), _doc(5001, ""), _doc(0, rows[0][1])]
    docs, marks = _docs(spark, rows), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    held = [(r["predicted"], r["doc_id"] % 3 == 0) for r in out if r["held_out"] and r["doc_id"] < 1500]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows)
    assert {r["predicted"] for r in out if r["doc_id"] >= 5000} == {0}
    assert toxicity.train(docs, marks.limit(0)) is None and toxicity.score(docs.limit(0), None).count() == 0


def test_near_duplicates_among_texts_of_one_pool(spark):
    rng = np.random.default_rng(11)
    n, planted = 8000, 400
    member = np.zeros((n + planted, 60), np.float32)
    for i in range(n):
        member[i, rng.choice(60, 36, replace=False)] = 1
    for i in range(planted):  # near copies of some: three of 36 words are others
        member[n + i] = member[i]
        member[n + i, rng.choice(np.flatnonzero(member[i] == 1), 3, replace=False)] = 0
        member[n + i, rng.choice(np.flatnonzero(member[i] == 0), 3, replace=False)] = 1
    texts = [" ".join(WORDS[w] for w in np.flatnonzero(m)) for m in member]
    common = member[n:] @ member.T
    near = common >= 0.8 * (72 - common) - 1e-4
    near[np.arange(planted), np.arange(n, n + planted)] = False
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(_docs(spark, [_doc(i, t) for i, t in enumerate(texts)]), size=1).collect()}
    lost = [i for i in range(planted) if got[n + i] < near[i].sum()]
    assert near.any(1).all() and len(lost) <= 2, f"{len(lost)} of {planted} lost"


def test_blocks_of_a_class_of_many_short_texts(spark):
    head = " ".join(WORDS[:30])
    docs = _docs(spark, [_doc(i, f"{head} n{i}") for i in range(4500)])  # 27 shingles each, 26 of them shared
    signed = ngram_join._signatures(docs.select("doc_id", "text"), 5)
    texts = signed.select("key", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "n_shingles", "labels").checkpoint()
    root = texts.agg(F.min("key")).head()[0]
    found = ngram_join._verified(docs.select("doc_id", "text"), texts, texts.select(F.col("key").alias("node"), F.lit(root).alias("root")), 0.8, 5).checkpoint()
    assert {r["rows"] for r in found.groupBy("key").agg(F.count("*").alias("rows")).collect()} == {3}  # three blocks: with itself and two others
    assert {r["links"] for r in found.groupBy("key").agg(F.sum("links").alias("links")).collect()} == {4499}
    assert graph.components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select("root").distinct().count() == 1


def test_bucket_links_connect_all_likely_pairs():
    rng = np.random.default_rng(12)
    labels = rng.integers(0, 256, (60, 192), dtype=np.uint8)
    for i in range(40):  # chains and stars of texts that share 80 percent of the bytes
        labels[20 + i] = labels[rng.integers(0, 20 + i)]
        labels[20 + i, rng.choice(192, 38, replace=False)] = rng.integers(0, 256, 38)
    for sides in (np.zeros(60, int), rng.integers(0, 2, 60)):
        likely = [(i, j) for i in range(60) for j in range(60) if i != j and (labels[i] == labels[j]).mean() >= 0.656 and (not sides.any() or sides[i] != sides[j])]
        tails, heads = ngram_join.likely_forest(labels, sides, 0.656)
        assert set(zip(tails.tolist(), heads.tolist())) <= set(likely) and len(set(heads.tolist())) == len(heads)
        roots = []
        for links in (likely, list(zip(tails, heads))):
            root = list(range(60))
            for _ in range(60):
                for a, b in links:
                    root[a] = root[b] = min(root[a], root[b])
            roots.append(root)
        assert roots[0] == roots[1]


def test_toxicity_counts_unlike_training_documents(spark):
    rng = np.random.default_rng(6)
    texts = [f"{a} {b} common phrase" for a, b in rng.choice(WORDS, (300, 2))]
    rows = [(i, t, int(i % 3 == 0), 1) for i, t in enumerate(texts)]
    near = " ".join(WORDS[:60])
    rows += [(1000 + c * 10 + i, f"{near} x{i}", c, 1) for c in (0, 1) for i in range(4)] + [(2000, texts[1], 0, 1), (2001, texts[1], 1, 1), (2002, texts[2], 0, 0)]
    got = {r["doc_id"] for r in toxicity._tables(spark.createDataFrame(rows, "doc_id long, text string, toxic int, part int")).collect()}
    pairs = [set(zip(["", *t.split()], t.split())) for t in texts]
    kept = []
    for i in range(300):
        if not any(j % 3 == 0 == i % 3 or (j % 3 and i % 3) for j in kept if len(pairs[i] & pairs[j]) >= 0.8 * len(pairs[i] | pairs[j])):
            kept.append(i)
    assert got == {*kept, 1000, 1010, 2001}


def test_warc_leaves_no_table_behind_and_takes_any_path(spark):
    before = {t.name for t in spark.catalog.listTables()}
    pages = spark.createDataFrame([(1, "u", "<p>same</p>"), (2, "u", "<p>same</p>"), (3, None, None)], "page_id long, url string, html string")
    got = sorted(tuple(r)[:1] + (r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect())
    assert [g[1:] for g in got] == [("revisit", 2), ("response", None), ("response", None)]
    root = tempfile.mkdtemp(prefix="spark-") + "/it's a path"
    data = spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"x"))], "sha256 string, data binary")
    data.write.parquet(f"{root}/payloads")
    assert spark.read.parquet(f"{root}/payloads").count() == 1
    name = f"b_{abs(hash(root))}"
    data.write.bucketBy(1, "sha256").sortBy("sha256").option("path", f"{root}-b/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    assert warc.read_payloads(spark, f"{root}-b", 1).collect()[0]["data"] == b"x"
    assert {t.name for t in spark.catalog.listTables()} == before


def test_comparing_a_block_holds_no_doubles_of_all_pairs():
    import tracemalloc

    rng = np.random.default_rng(3)
    bases = [rng.integers(1, 2**62, 30, dtype=np.uint64) for _ in range(150)]
    sets = [np.unique(np.append(bases[i % 150][: 30 - i // 450], np.uint64(i))) for i in range(1500)]
    copies = np.arange(1500, dtype=np.float64) % 3 + 1
    tracemalloc.start()
    links, root = ngram_join.compare_block(sets, np.zeros(1500, int), copies, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000
    for i in (0, 255, 256, 1023, 1499):
        near = [j for j in range(1500) if j != i and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-6]
        assert links[i] == sum(copies[j] for j in near) and root[i] == i % 150


def test_raking_of_few_cells_shuffles_nothing(spark):
    rows = [(f"s{i % 4}", f"l{i % 3}", f"t{i % 2}", 100 + 7 * i) for i in range(12)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(3)
    plans = {}
    for most in (mixing.CELLS_PER_TASK, 0):
        kept, mixing.CELLS_PER_TASK = mixing.CELLS_PER_TASK, most
        try:
            goals = mixing._together(mixing.cut(mixing.smoothed_targets(mixing._together(cells), list(mixing.MARGINS))))
            raked = mixing.rake(goals, 4)
            plans[most] = raked._jdf.queryExecution().executedPlan().toString().count("Exchange"), {tuple(r)[:3]: r["raked"] for r in raked.collect()}
        finally:
            mixing.CELLS_PER_TASK = kept
    (few, one), (many, dealt) = plans.values()
    assert few == 0 and many > 0
    for m in range(3):
        own = {v: sum(r[3] for r in rows if r[m] == v) ** mixing.SMOOTHING for v in {r[m] for r in rows}}
        for v, w in own.items():
            assert abs(sum(x for k, x in one.items() if k[m] == v) - w / sum(own.values())) < 0.05
    assert all(abs(one[k] - dealt[k]) < 1e-12 for k in one) and len(one) == 12
