"""The whole pipeline against brute force on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tickweave.llm import mixing, queries

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _classes(texts):
    """Least id reached over links of Jaccard 0.8 of five-word shingles, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def _redacted(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [m.span() for p, n in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)) for m in re.finditer(p, text) if len(m[0]) >= n]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def _drawn(rows):
    """Ids that raked weights and the draw by id keep; rows: id -> (source, lang, text)."""
    tokens = {i: len([w for w in re.split("[ \n\r\t]+", t) if w]) for i, (_, _, t) in rows.items()}
    cell_of = {i: (s, g, "short" if tokens[i] < 150 else "medium" if tokens[i] < 600 else "long") for i, (s, g, _) in rows.items()}
    total = defaultdict(float)
    for i, c in cell_of.items():
        if tokens[i]:
            total[c] += tokens[i]
    weight, goals = dict(total), []
    for m in range(3):
        own = defaultdict(float)
        for c, n in total.items():
            own[c[m]] += n
        powered = {v: n**mixing.SMOOTHING for v, n in own.items()}
        goals.append({v: n / sum(powered.values()) for v, n in powered.items()})
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            now = defaultdict(float)
            for c, w in weight.items():
                now[c[m]] += w
            weight = {c: w * goals[m][c[m]] / now[c[m]] for c, w in weight.items()}
    top = max(weight[c] / total[c] for c in total)
    kept = set()
    for i, c in cell_of.items():
        p = round(weight[c] / total[c] / top, 9) if tokens[i] else 1.0
        if int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 16.0**13 < p:
            kept.add(i)
    return kept


def test_pipeline_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in queries.op10_toxicity(spark, sf).filter("predicted = 1").collect()}
    clean = {i: r["text"] or "" for i, r in docs.items() if i not in toxic}
    root = _classes(clean)
    rows = {i: (docs[i]["source"] or "(none)", docs[i]["lang"] or "(none)", _redacted(t)) for i, t in clean.items() if root[i] == i}
    kept = _drawn(rows)
    assert 0 < len(kept) < len(rows) < len(clean) < len(docs)

    got = corpus_pipeline.run(spark, sf).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert len({r["sequence_id"] for r in got}) == len(got) and set(pieces) == kept
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(rows[i][2], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, n in sorted(own):
            assert (start, n) == (at, len(ids)) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_stages_keep_columns_and_bear_odd_rows(spark, sf):
    odd = [(i, t, s, g, n, 1.0, 7, "x", 3, 9) for i, t, s, g, n in ((1, None, None, None, None), (2, "", "a", "en", 0), (None, "some words here", "a", None, 15), (4, "key token = abcdefgh12", "b", "de", 22), (4, "key token = abcdefgh12", "b", "de", 22), (5, "long " * 20_000, "b", "en", 100_000))]
    schema = "doc_id long, text string, source string, lang string, n_chars long, score double, key long, topic string, n_tokens int, predicted int"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(rows)
    redacted = corpus_pipeline.redact_secrets(spark, spark.createDataFrame(odd, schema), sf).filter("doc_id = 4").collect()
    assert [(r["text"], r["n_chars"]) for r in redacted] == [("key [secret]", 12)] * 2


def test_redaction_reaches_rows_without_id(spark, sf):
    rows = [(i, "key token = abcdefgh12", "b", "de", 22, 1.0) for i in (None, None, 1)] + [(None, "plain", "b", "de", 5, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")
    got = sorted((r["text"], r["n_chars"]) for r in corpus_pipeline.redact_secrets(spark, docs, sf).collect())
    assert got == [("key [secret]", 12)] * 3 + [("plain", 5)]


def test_stages_leave_columns_of_any_name_alone(spark, sf):
    # one id with several texts reaches the part of the join that tells rows apart
    texts = [(1, "one text of quite a few words here"), (1, "another text that has its own id not"), (1, "one text of quite a few words here"), (None, "key token = abcdefgh12"), (2, "key token = abcdefgh12"), (3, None), (4, "")]
    names = ["hex", "assign", "access", "_blob", "_id", "_text", "_source", "_lang", "_mixed", "_key", "_wanted", "__id", "blob", "key", "kept", "lost", "worded", "stays", "chosen", "root", "class_id", "verdict", "_verdict", "rep", "path", "a.b", "kind"]
    rows = [(i, t, "s", "en", len(t or ""), *[f"{n} {k}" for n in names]) for k, (i, t) in enumerate(texts)]
    fields = ", ".join(["doc_id long", "text string", "source string", "lang string", "n_chars long", *[f"`{n}` string" for n in names]])
    docs = spark.createDataFrame(rows, fields)
    whole = {tuple(r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns and {tuple(r[5:]) for r in got} <= whole, name
        if name == "ngram_join":
            kept = sorted((r["doc_id"], r["text"]) for r in got if r["text"])
            assert kept == sorted([(1, texts[0][1]), (1, texts[1][1]), (2, texts[4][1])])
        if name in ("toxicity", "secret_scan"):
            assert len(got) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(rows)
