"""Token alignment against a plain rewriting, and odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tickweave.llm import alignment, queries

SCHEMA = "doc_id long, text string, n_a int, pair string, block int"


def _byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


def _plain(rows):
    """(doc_id, text) -> contract columns, by whole encodings and sets of ends."""
    a_model, b_model = Tokenizer.from_file(queries.TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    a_model.encode_special_tokens = True
    byte_of = _byte_of()
    out, holders = [], Counter()
    for i, text in rows:
        groups, links = [], Counter()
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text, num_threads=1)
            spell_a = [bytes(byte_of[c] for c in a_model.id_to_token(x)) for x in a]
            spell_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b_model.id_to_piece(x)) for x in b)]
            want = (" " + text).encode()
            if b"".join(spell_a) == b"".join(spell_b) == want:
                ends = [np.cumsum([len(t) for t in s]).tolist() for s in (spell_a, spell_b)]
                begin = [0, 0]
                rank = [{e: k + 1 for k, e in enumerate(es)} for es in ends]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    upto = [r[cut] for r in rank]
                    own = [a[begin[0] : upto[0]], b[begin[1] : upto[1]]]
                    groups.append(own)
                    links.update((x, y) for x in own[0] for y in own[1])
                    begin = upto
        holders.update(links.keys())
        out.append((i, groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    for i, groups, links in out:
        written = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        yield (
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]),
            sum(n * holders[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )


def _hold(df, rows):
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()]
    assert sorted(got, key=str) == sorted(_plain(rows), key=str)


def test_query_equals_plain_alignment(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _hold(queries.op12_token_alignment(spark, sf), rows)


def test_odd_texts(spark):
    texts = [
        None, "", " ", "  two  blanks ", "\n", "tab\tand\nlines\r\n", "<|endoftext|> is <s> text </s>", "▁ own blank", "a▁b", "naïve Übung 数据 🙂🙂 中文", "\x00 nul \x00", "é combined", "ﬁ ligature ½", "x" * 3000, "=" * 500, "ab" * 400,
        "　wide blanks ", "🙂" * 50, "नमस्ते दुनिया", "0123456789" * 20, "﻿bom", "​zero", "İstanbul ſ", " lead", "trail ", "same text", "same text",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same text"), (3, "another row of an id"), (2**60 + 1, "far id")]
    df = spark.createDataFrame([(i, t, 5, "p", 1) for i, t in rows], SCHEMA)
    _hold(alignment.align(df, queries.TOKENIZER, queries.PIECES), rows)
    _hold(alignment.align(df.repartition(3), queries.TOKENIZER, queries.PIECES, block_bytes=200), rows)
    assert alignment.align(df.limit(0), queries.TOKENIZER, queries.PIECES).count() == 0


def test_long_texts_and_large_groups(spark, monkeypatch):
    long = "lines of ordinary text, then more\n" * 40_000
    rows = [(1, long), (2, "短い文" * 300)]
    df = spark.createDataFrame([(i, t, 5, "p", 1) for i, t in rows], SCHEMA)
    _hold(alignment.align(df, queries.TOKENIZER, queries.PIECES), rows)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    ends_a, ends_b = np.array([1, 200, 400]), np.array([2, 299, 300])
    whole = alignment._grouped_links(a, b, ends_a, ends_b, np.array([0, 0, 1]), 4)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 10**9)
    assert all(np.array_equal(x, y) for x, y in zip(whole, alignment._grouped_links(a, b, ends_a, ends_b, np.array([0, 0, 1]), 4), strict=True))


def test_gallop_finds_common_ends():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = []
        for _ in range(rng.integers(1, 5)):
            last = int(rng.integers(1, 400))
            lists.append([sorted({last, *rng.integers(1, last + 1, rng.integers(0, 200)).tolist()}) for _ in range(2)])
        base, flat, sizes = 0, ([], []), ([], [])
        for pair in lists:
            for k in (0, 1):
                flat[k].extend(base + x for x in pair[k])
                sizes[k].append(len(pair[k]))
            base += pair[0][-1]
        a, b = (np.array(x) for x in flat)
        in_a, in_b = alignment.common_ends(a, b, *(np.array(x) for x in sizes))
        assert a[in_a].tolist() == sorted(set(flat[0]) & set(flat[1])) == b[in_b].tolist()


def test_pieces_never_hold_a_blank_behind_a_character():
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    assert not [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search("[^▁]▁", p)]
