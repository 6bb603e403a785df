"""Operators against plain rewritings of their methods, and odd inputs."""

import dataclasses
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.llm import exact_topk, hilbert_ann, html_extract, mixing, ngram_join, packing, queries, secrets, toxicity, url_rules, warc
from tickweave.llm.text import word_hashes

WORDS = [f"w{i}" for i in range(400)]


def test_ann_windows_find_neighbours_without_scanning(spark):
    rng = np.random.default_rng(21)
    n, d = 6000, 64
    v = rng.standard_normal((n, d))
    v[:1500] = rng.standard_normal((30, d))[np.arange(1500) % 30] + 0.3 * v[:1500]  # clusters
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = hilbert_ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    v = v.astype(np.float64)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        assert np.allclose(g["score"], s[g["vec_id"]], atol=1e-12, rtol=0) and len(g) == 20
        s[q] = -9
        hits += len(set(g["vec_id"]) & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * got["query_id"].nunique()) > 0.9
    # rows in visited windows, over all curves, plus the window means: clearly under one full scan
    assert hilbert_ann.visited_share(n) * hilbert_ann.CURVES + hilbert_ann.CURVES / hilbert_ann.WINDOW < 0.8


def test_ann_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(1, 60)] + [(100 + i, [float(i), 2.0]) for i in range(30)] + [(200, [0.0, 0.0, 0.0]), (201, []), (202, None), (203, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(300 + i, [5.0, 5.0, 5.0]) for i in range(50)] + [(300, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert_ann.search(df, F.lit(True), k=5).toPandas()
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and any(v)}
    for q, v in good.items():
        s = sorted(((-float(np.dot(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v)))[:5]
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == [i for _, i in s], q
    assert set(got["query_id"]) == set(good)
    near = hilbert_ann.search(df.limit(3), F.lit(True)).toPandas()  # fewer candidates than k: all
    assert (near.groupby("query_id").size() == 2).all()


def _plain_models(docs, corpus, vocabulary_above, deviations):
    """log P(w | h) of both classes by dictionaries; docs: (words, class); words below the bound count as '*'."""
    seen = [Counter(), Counter()]
    pairs = [Counter(), Counter()]
    for words, c in docs:
        seen[c].update(set(words))
        pairs[c].update(set(zip(["^", *words], words)))
    vocabulary = {w for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] > vocabulary_above}
    name = lambda w: w if w in vocabulary else "*"
    before = defaultdict(set)
    for words in corpus:
        for h, w in zip(["^", *words], words):
            before[name(w)].add(h)
    contexts = {w: len(before[w]) + 0.5 for w in [*vocabulary, "*"]}
    smooth = {w: n / sum(contexts.values()) for w, n in contexts.items()}
    size = [sum(s.values()) for s in seen]
    take = lambda n, e: min(n, max(toxicity.MIN_DISCOUNT, e + deviations * math.sqrt(e)))
    models = []
    for c in (0, 1):
        more = {w: seen[c][w] - take(seen[c][w], (seen[0][w] + seen[1][w]) * size[c] / sum(size)) for w in vocabulary}
        left = 1 - sum(more.values()) / size[c]
        single = {w: more.get(w, 0) / size[c] + left * smooth[w] for w in contexts}
        behind = [Counter(), Counter()]
        for k in (0, 1):
            for (h, _), n in pairs[k].items():
                behind[k][h] += n
        extra = {}
        for (h, w), n in pairs[c].items():
            if (h in vocabulary or h == "^") and w in vocabulary:
                expected = (pairs[0][h, w] + pairs[1][h, w]) * behind[c][h] / (behind[0][h] + behind[1][h])
                extra[h, w] = (n - take(n, expected)) / behind[c][h]
        rest = defaultdict(lambda: 1.0)
        for (h, _), x in extra.items():
            rest[h] -= x
        models.append(lambda h, w, extra=extra, rest=rest, single=single: math.log(extra.get((h, w), 0) + rest[h] * single[name(w)]))
        assert abs(sum(single.values()) - 1) < 1e-9
    return models


def test_kneser_ney_equals_plain_dictionaries(spark):
    rng = np.random.default_rng(8)
    docs = []
    for i in range(50):
        words = [f"v{int(x)}" for x in rng.zipf(1.6, rng.integers(5, 40)) % 60]
        if i % 2:
            words += ["you", "vile", "fool"] * int(rng.integers(1, 3))
        docs.append((words, i % 2))
    corpus = [w for w, _ in docs] + [[f"v{int(x)}" for x in rng.zipf(1.6, 30) % 60] for _ in range(20)]
    deviations = 1.0
    training = spark.createDataFrame([(" ".join(w), c) for w, c in docs], "text string, toxic int")
    singles = toxicity._counts(training, None)
    sizes = np.array(singles.agg(F.sum("c0"), F.sum("c1")).head(), float)
    words = singles.filter(F.col("c0") + F.col("c1") > toxicity.MIN_DISCOUNT).select(F.col("w").alias("key"), "c0", "c1").toPandas()
    words["key"] = words["key"].to_numpy(np.int64).view(np.uint64)
    words = words.sort_values("key", ignore_index=True)
    vocabulary = words["key"].to_numpy(np.uint64)
    pairs = toxicity._counts(training, vocabulary)
    behind = pairs.groupBy("h").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    strong = pairs.filter("w <> 0").join(behind, "h").toPandas()
    plain = {toxicity.word_hashes([w])[0][0]: w for w in {x for ws in corpus for x in ws}}
    before = defaultdict(set)
    for ws in corpus:
        for h, w in zip(["^", *ws], ws):
            before[w if word_hashes([w])[0][0] in set(vocabulary.tolist()) else "*"].add(h)
    contexts = np.array([len(before[plain[k]]) for k in vocabulary] + [len(before["*"])], float)
    model = toxicity.class_models(words, sizes, contexts, strong, deviations)
    want = _plain_models(docs, corpus, toxicity.MIN_DISCOUNT, deviations)
    texts = [" ".join(w) for w, _ in docs[:20]] + ["never seen words", "", None, "you vile fool"]
    per_word, counts = model.log_likelihoods(texts)
    for t, got, n in zip(texts, per_word, counts, strict=True):
        ws = (t or "").split()
        assert n == len(ws)
        for c in (0, 1):
            assert abs(got[c] * max(n, 1) - sum(want[c](h, w) for h, w in zip(["^", *ws], ws))) < 1e-6, t
    assert per_word[-1][1] > per_word[-1][0] + 0.5


def test_context_sketches_count_distinct_contexts(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"c{int(x)} word" for x in rng.integers(0, 3000, 400)) for _ in range(40)] + ["a rare", "b rare", None, ""]
    keys = np.sort(word_hashes(["word rare"])[0])
    out = toxicity.context_sketches(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text", keys).toPandas()
    maps = np.zeros((3, toxicity.BITMAPS), np.uint32)
    maps[toxicity.places(keys, out["w"].to_numpy(np.int64).view(np.uint64))] = np.ascontiguousarray(out[[f"b{j}" for j in range(8)]].to_numpy(np.int64)).view(np.uint32)
    n = dict(zip(keys.tolist(), toxicity.distinct_contexts(maps)))
    true = len({m for t in texts for m in re.findall(r"(\w+) word", t or "")})
    assert abs(n[int(word_hashes(["word"])[0][0])] / true - 1) < 0.6 and 0.5 < n[int(word_hashes(["rare"])[0][0])] < 5


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, 20)) + (" vile foul" if i % 2 else ""), 1.0, 1, 0) for i in range(400)]
    rows += [(1000, "plain " * 100_000 + "end", 0.0, 0, 0), (None, "w1 w2", 0.0, 0, 0), (1001, None, 0.0, 0, 0), (1, rows[1][1], 0.0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, toxic int")  # clashing names
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(400)] + [(None, 1, 0), (2, None, 0)], "doc_id long, toxic int, text int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all() and out["doc_id"].isna().sum() == 1
    held = out[out["held_out"] & (out["doc_id"] < 400)]
    assert ((held["doc_id"] % 2 == 1) == (held["predicted"] == 1)).mean() > 0.95
    assert out[out["doc_id"] == 1]["score"].nunique() == 1
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None  # one class only
    none = toxicity.score(docs, None).toPandas()
    assert isinstance(none, pd.DataFrame) and set(none["score"]) == {0.0} and set(none["predicted"]) == {0}


def test_rows_without_id_and_repeated_ids_in_the_near_duplicate_join(spark):
    a = " ".join(WORDS[:40])
    b = " ".join(WORDS[100:140])
    rows = [(None, a), (1, a + " more"), (2, b), (2, "quite another text of its own"), (2, b), (3, b + " more"), (None, "alone without id here"), (None, "alone without id here"), (None, None), (4, ""), (4, ""), (5, "w " * 150_000)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2) for i, t in rows], "doc_id long, text string, key int, root int, class_id int")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, 1), (1, 1, 1), (2, 2, 2), (2, 2, 0), (2, 2, 2), (3, 2, 2), (None, None, 1), (None, None, 1), (None, None, 0), (4, 4, 0), (4, 4, 0), (5, 5, 0)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], (r["text"] or "")[:40]) for r in kept.collect()), key=str)
    assert left == sorted([(1, a[:40]), (2, b[:40]), (2, "quite another text of its own"), (None, "alone without id here"), (None, ""), (4, ""), (4, ""), (5, ("w " * 20))], key=str)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_scan_equals_all_regions():
    rng = np.random.default_rng(31)
    for _ in range(300):
        scores = [round(float(x), 1) for x in rng.normal(-0.3, 1, rng.integers(0, 25))]
        begin, end = html_extract.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert abs(sum(scores[begin:end]) - max([0.0, *sums])) < 1e-9
    assert html_extract.best_region([1.0, -1.0, 1.0]) == (0, 1)  # a tie: the first


def test_pages_with_ordinary_markup():
    text = " ".join(["word"] * 150)
    art = f"<p>{text}</p><p>{text}</p>"
    pages = {
        "names that contain one": [f'<body><div class="content has-sidebar">{art}</div>', f'<div class="post no-comments">{art}</div>', f'<div id="page-header-fixed">{art}</div>', f'<div class="alert-story">{art}</div>'],
        "one form": [f"<body><form action=x><div>{art}</div></form></body>"],
        "optional end tags": [f'<ul><li class="nav-item">A<li class="nav-item">B</ul><div>{art}</div>', f'<table><tr><td class="menu">A<td>{art}</table>', f"<body><div>{art.replace('</p>', '')}</div>"],
        "unclosed": [f"<body><aside>see also<article>{art}</article></body>", f"<body><aside>see also<div>{art}</div></body>"],
        "a block named as an advert that holds the page": [f'<body><div class="ad">{art}</div><p>x</p></body>'],
    }
    weight = html_extract.weights({}, {})
    for name, found in pages.items():
        for page in found:
            assert html_extract.main_text(page, weight).count("word") == 300, name
    left = f'<body><header>H</header><nav>N</nav><div class="cookie-notice">C</div><div class="site-footer">F</div>{art}<form><label>L</label></form><div class="post-comments"><p>{text[:60]} R</p></div><span class="ad">S</span><footer>Z</footer>'
    assert html_extract.main_text(left, weight) == f"{text} {text}"
    deep = "<div>" * 20_000 + art + "</section>" * 20_000
    assert html_extract.main_text(deep, weight).count("word") == 300
    long = f"<article>{art * 400}</article>"
    assert html_extract.main_text(long, weight).count("word") == 300 * 400


def test_a_second_run_scans_only_unseen_pairs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    kinds = [r.kind for r in secrets.BASE_RULES]
    first = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "token = abcdefgh1"), (3, None)], "p long, t string")
    out = secrets.scan_with_ledger(first, "p", "t", path, first=True)
    assert sorted((r["path"], r["s"]) for r in out.select("path", secrets.listed(kinds).alias("s")).collect()) == [(1, "assign:0:17"), (2, "assign:0:17"), (3, "")]
    assert spark.read.parquet(path).count() == 2 * 3
    # the next version: one new text, two old ones under other paths, and a newer version of one rule
    newer = tuple(dataclasses.replace(r, version=2) if r.kind == "hex" else r for r in secrets.BASE_RULES)
    second = spark.createDataFrame([(1, "token = abcdefgh1"), (7, "x " + "f" * 40), (8, "")], "p long, t string")
    unseen = secrets.scan_unseen(second, "t", spark.read.parquet(path), newer)
    old, new = hashlib.sha256(b"token = abcdefgh1").hexdigest(), hashlib.sha256(b"x " + b"f" * 40).hexdigest()
    assert {(r["blob"], r["rule"]) for r in unseen.collect()} == {(old, "hex@2"), (hashlib.sha256(b"").hexdigest(), "hex@2"), (new, "assign@1"), (new, "access@1"), (new, "hex@2")}
    out = secrets.scan_with_ledger(second, "p", "t", path, first=False, rules=newer)
    assert sorted((r["path"], r["s"]) for r in out.select("path", secrets.listed(kinds).alias("s")).collect()) == [(1, "assign:0:17"), (7, "hex:2:42"), (8, "")]
    assert spark.read.parquet(path).count() == 6 + 5 and secrets.scan_unseen(second, "t", spark.read.parquet(path), newer).isEmpty()


def test_secrets_of_a_very_long_text(spark):
    piece = "é token = abcdefgh1, " + "0" * 40 + " pw token:x\n"
    text = piece * 3000
    found, _ = secrets.scan_versions(spark.createDataFrame([(1, text)], "p long, t string"), "p", "t")
    row = found.head()
    n = len(piece)
    assert [(s["start"], s["stop"]) for s in row["assign"]] == [(i * n + 2, i * n + 19) for i in range(3000)]
    assert [(s["start"], s["stop"]) for s in row["hex"]] == [(i * n + 21, i * n + 61) for i in range(3000)]


def test_archive_of_odd_rows_and_damaged_payloads(spark, tmp_path):
    rows = [(1, "u", "a\r\n\r\nb", 1), (1, "u", "a\r\n\r\nb", 1), (2, "u", "tiny", 1), (3, "v", "tiny", 1), (4, None, "long enough é", 1), (5, "w", "long enough é", 1), (6, "x", None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 int")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_and_read(df, revisit_from_bytes=5, path=str(tmp_path / "w")).collect())
    assert got == [(1, "response", None, 6), (1, "response", None, 6), (2, "response", None, 4), (3, "response", None, 4), (4, "revisit", 5, 14), (5, "response", None, 14), (6, "response", None, 0)]
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.read_records(spark, str(tmp_path / "w"), warc.n_buckets(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    records = {r["page_id"]: bytes(r["record"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert records[1].endswith(b"\r\n\r\na\r\n\r\nb\r\n\r\n") and records[4].endswith(b"\r\n\r\n\r\n\r\n") and b"WARC-Target-URI" not in records[4]
    stored = spark.read.parquet(str(tmp_path / "w" / "payloads"))
    damaged = stored.withColumn("data", F.when(F.length("data") == 4, F.lit(b"tinY")).otherwise(F.col("data")))
    damaged.write.parquet(str(tmp_path / "d" / "payloads"))
    spark.read.parquet(str(tmp_path / "w" / "headers")).write.parquet(str(tmp_path / "d" / "headers"))
    for read in (warc.read_payloads, warc.read_records):
        with pytest.raises(Exception, match="payload differs from its digest"):
            read(spark, str(tmp_path / "d")).collect()


def _plain_rules(urls, least, confidence, most=3):
    """Minimal token sets for blocking by looking at all sets of up to three tokens."""
    where = defaultdict(set)
    for i, (tokens, _) in enumerate(urls):
        for t in tokens:
            where[t].add(i)
    groups = defaultdict(list)
    for t, at in where.items():
        if len(at) >= least:
            groups[frozenset(at)].append(t)
    items = {min(g, key=lambda t: (len(t), t)): at for at, g in groups.items()}
    found = {}
    for size in range(1, most + 1):
        for some in itertools.combinations(sorted(items), size):
            at = frozenset.intersection(*[items[t] for t in some])
            hits = sum(urls[i][1] for i in at)
            if hits >= least and hits >= confidence * len(at) - 1e-12 and not any(set(k) < set(some) for k in found):
                found[some] = hits / len(at)
    return found


def test_mined_rules_equal_plain_mining(spark):
    rng = np.random.default_rng(17)
    urls = []
    for i in range(400):
        tokens = {f"host={'a' if i % 3 else 'b'}.io", "scheme=http"} | {f"path=p{int(x)}" for x in rng.integers(0, 8, 3)}
        urls.append((sorted(tokens), bool(("path=p1" in tokens and "path=p2" in tokens) or ("path=p5" in tokens and i % 3 == 0)) ^ bool(rng.random() < 0.05)))
    df = spark.createDataFrame(urls, "tokens array<string>, block boolean")
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine_rules(df, "tokens", "block", 0.01, 0.8).collect()}
    want = _plain_rules(urls, 5, 0.8)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # one url of many tokens, repeated: its tokens are one item
    deep = spark.createDataFrame([([f"path=t{i:02d}" for i in range(40)], True)] * 20 + [(["x"], False)] * 20, "tokens array<string>, block boolean")
    assert [r["antecedent"] for r in url_rules.mine_rules(deep, "tokens", "block").collect()] == [["path=t00"]]
    assert url_rules.mine_rules(df, "tokens", "block", 0.99).isEmpty() and url_rules.mine_rules(df.limit(0), "tokens", "block").isEmpty()


def test_judging_odd_urls(spark):
    long = "http://" + ".".join(["d"] * 30) + "/" + "/".join(f"s{i}" for i in range(3000)) + "?" + "&".join(f"k{i}=1" for i in range(500))
    pages = spark.createDataFrame([(i, long, 1, 2) for i in range(30)] + [(None, "http://a.net/", 1, 2), (50, "", 1, 2), (50, "", 1, 2)], "page_id long, url string, verdict int, block int")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int")
    out = url_rules.judge(pages, labels)
    got = out.collect()
    assert len(got) == 33 and {r["verdict"] for r in got if r["page_id"] is not None and r["page_id"] < 30} == {"block"}
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_packing_worker_keeps_few_chunks_and_those_in_use():
    tokenizer, common = packing.CachedTokenizer(queries.TOKENIZER), [f"often{i}" for i in range(1000)] + ["é\n"]
    for k in range(12):
        texts = [" ".join([*common, *(f"once{k}x{j}" for j in range(i, i + 4000))]) for i in range(0, 40_000, 4000)] + [None, "", " ", "\0a b", "a  \tx é\n b "]
        ids, lengths = tokenizer.ids(pa.array(texts))
        whole = [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in whole for i in x] and lengths.tolist() == [len(x) for x in whole]
    # 480,000 different ones were asked for; a block adds its own to those kept
    assert len(tokenizer.known) < packing.MAX_CACHED + 42_000 <= 350_000 and set(common[1:]) <= set(tokenizer.known)
    tokenizer._forget()
    assert set(common[1:]) <= set(tokenizer.known) and len(tokenizer.known) < 3000
    assert tokenizer.ids(pa.array(texts))[0].tolist() == ids.tolist()


def test_buckets_are_matrices_without_padding(spark, tmp_path):
    rows = [(i, "word " * (i * 37 % 1500), 1, 2) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket int, length int").repartition(3), queries.TOKENIZER)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b")).toPandas()
    assert not back.duplicated(["bucket", "bucket_sequence"]).any() and (back["bucket"] == back["length"]).all()
    for length, part in back.groupby("bucket"):
        assert np.stack([np.frombuffer(b, "<u4") for b in part["ids"]]).shape == (len(part), length)
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.TOKENIZER)
    assert empty.count() == 0 and empty.columns == pieces.columns


def test_topk_of_mixed_dimensions_and_large_components(spark):
    rng = np.random.default_rng(2)
    big = [[float(x) for x in rng.integers(-(2**19), 2**19, 4)] for _ in range(30)]  # products beyond 2^53
    rows = [(i, v, 1) for i, v in enumerate(big)] + [(100 + i, [float(x) for x in rng.normal(0, 10 ** (i % 4), 6)], 1) for i in range(200)] + [(400, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int")
    got = exact_topk.top_k(df, F.col("vec_id") % 5 == 0, block_rows=16, query_rows=8).collect()
    whole = {i: [math.floor(x * 1024) for x in v] for i, v, _ in rows}
    for q in [i for i in whole if i % 5 == 0]:
        want = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in want], q
    huge = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        exact_topk.top_k(huge, F.lit(True)).collect()


def test_mixing_of_repeated_rows_and_clashing_names(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 9)), f"s{i % 4}", "en" if i % 3 else None, "x", 1, 0.5, 1.0) for i in range(200)]
    rows += [rows[7]] * 3 + [(None, "w w w", "s1", "en", "x", 1, 0.5, 1.0), (None, "another text w", "s2", "en", "x", 1, 0.5, 1.0), (9, "a second text of id nine", "s3", None, "x", 1, 0.5, 1.0)]
    schema = "doc_id long, text string, source string, lang string, topic string, n_tokens int, _p double, probability double"
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows) and out[out["doc_id"] == 7]["selected"].nunique() == 1
    assert out["probability"].between(0, 1).all() and set(out["lang"]) == {"en", "(none)"}
    left = mixing.draw(docs)
    assert left.columns == docs.columns
    chosen = Counter((None if pd.isna(i) else int(i), s) for i, s, c in zip(out["doc_id"], out["source"], out["selected"], strict=True) if c)
    assert Counter((r["doc_id"], r["source"]) for r in left.collect()) == chosen and 0 < sum(chosen.values()) < len(rows)
    assert mixing.draw(docs.limit(0)).count() == 0
