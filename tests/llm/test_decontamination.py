"""Benchmark decontamination against brute force, and odd inputs."""

import hashlib
import random
import re

from tickweave.llm import decontamination
from tickweave.llm.decontamination import contamination, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA, ITEMS = "doc_id long, text string, item_id long, words string, spans int", "item_id long, text string, doc_id int"


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _brute(text, items):
    """(words, hit word positions, item ids, code point spans of hit words)."""
    found = [(m.group(), m.span()) for m in WORD.finditer(_fold(text))]
    ws, hit, ids = [w for w, _ in found], set(), set()
    for item, t in items:
        iw = WORD.findall(_fold(t))
        k = min(10, len(iw))
        windows = {tuple(iw[s : s + k]) for s in range(len(iw) - k + 1)} if iw else set()
        for s in range(len(ws) - k + 1) if iw else ():
            if tuple(ws[s : s + k]) in windows:
                hit |= set(range(s, s + k))
                if item is not None:
                    ids.add(str(item))
    return len(ws), hit, sorted(ids), found


def _check(spark, docs, items, **more):
    got = contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), **more)
    rows = sorted(got.collect(), key=lambda r: (str(r["doc_id"]), r["n_words"], str(r["spans"])))
    want = sorted(((d[0], *_brute(d[1], [i[:2] for i in items])) for d in docs), key=lambda r: (str(r[0]), r[1]))
    assert sorted((str(r["doc_id"]), r["n_words"], tuple(r["items"]), sum(s["n_words"] for s in r["spans"])) for r in rows) == sorted((str(i), n, tuple(ids), len(hit)) for i, n, hit, ids, _ in want)
    return got, rows


def _tables(seed=5):
    rng = random.Random(seed)
    vocab = ["ein", "Übung", "数据", "a", "b1", "x", "the", "of", "naïve", "42"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "  ", "\x00", "—", "\x7f"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 9, 10, 11, 25])) if i % 7 else t, 0) for i, t in enumerate([None, "", "...", *[""] * 27])]
    items += [(None, make(12), 0), (3, items[3][1], 0), (2, make(14), 0), (1, "a", 0)]
    docs = []
    for i in range(60):
        parts = [make(rng.choice([0, 4, 30]))]
        for _ in range(rng.choice([0, 1, 2])):
            parts += [(rng.choice(items)[1] or "").upper(), make(rng.choice([0, 5]))]
        docs.append((i, " ".join(parts), i, "w", 1))
    return docs + [(None, items[5][1], 0, "w", 1), (7, docs[7][1], 7, "w", 1), (90, None, 0, None, 1), (91, "", 0, None, 1), (92, "?!", 0, None, 1)], items


def test_equals_brute_force_with_one_automaton_and_with_many(spark):
    docs, items = _tables()
    _check(spark, docs, items)
    _check(spark, docs[:20], items[:12] + items[-2:], max_bytes=400)


def test_spans_point_into_the_original_text(spark):
    docs, items = _tables(9)
    got, rows = _check(spark, docs, items)
    texts = {d[0]: d[1] for d in docs if d[0] is not None}
    seen = 0
    for r in rows:
        if r["doc_id"] is None or not r["spans"]:
            continue
        _, hit, _, found = _brute(texts[r["doc_id"]], [i[:2] for i in items])
        covered = set()
        for s in r["spans"]:
            own = range(s["first_word"], s["first_word"] + s["n_words"])
            assert (s["start"], s["stop"]) == (found[own[0]][1][0], found[own[-1]][1][1])
            covered |= set(own)
            seen += 1
        assert covered == hit
    assert seen > 20
    one = next(r for r in report(got).collect() if r["n_items"] > 1)
    names = next(r["items"] for r in rows if r["doc_id"] == one["doc_id"] and r["n_words"] == one["n_words"])
    assert one["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() and one["contaminated"]


def test_windows_neither_cross_texts_nor_end_inside_words(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = [(1, "w0 w1 w2 w3 w4", 0, "", 0), (2, "w5 w6 w7 w8 w9", 0, "", 0), (3, f"x{item}", 0, "", 0), (4, f"{item}0", 0, "", 0), (5, item.replace(" ", "--"), 0, "", 0)]
    _, rows = _check(spark, docs, [(1, item, 0)])
    assert [r["doc_id"] for r in rows if r["spans"]] == [5]


def test_empty_tables_and_long_texts(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert contamination(docs, items).count() == 0
    _, rows = _check(spark, [(1, "some words", 0, "", 0), (2, None, 0, "", 0)], [])
    assert all(not r["spans"] for r in rows)
    item = " ".join(f"q{i}" for i in range(30))
    long = f"{'long ' * 600_000}{item} {'tail ' * 600_000}"
    many = spark.createDataFrame([(1, long, 0, "", 0), (2, f"{item} " * 20_000, 0, "", 0)], SCHEMA)
    got = {r["doc_id"]: r for r in report(contamination(many, spark.createDataFrame([(4, item, 0)], ITEMS))).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (1_200_030, 30, 1)
    assert (got[2]["n_words"], got[2]["n_hit"]) == (600_000, 600_000)
    assert decontamination.BLOCK_BYTES < len(long)
