"""Cross-tokenizer alignment against whole texts encoded by the libraries and plain sets of byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from lodestar.llm import alignment as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, docs):
    """The contract's result by other means: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    a_lib, b_lib = libraries
    spelt = L.byte_characters()
    kept, counts = [], Counter()
    for doc_id, text in docs:
        ok = bool(text)
        a = b = []
        if ok:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_bytes = [bytes(spelt[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
            ok = b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()
        if not ok:
            kept.append((doc_id, [], [], [], []))
            continue
        spans = []
        for x in (a_bytes, b_bytes):
            at, own = 0, []
            for y in x:
                own.append((at, at + len(y)))
                at += len(y)
            spans.append(own)
        # Overlapping tokens: by the bytes themselves
        owner = [[], []]
        for k in (0, 1):
            for n, (s, e) in enumerate(spans[k]):
                owner[k] += [n] * (e - s)
        links = sorted(set(zip(*owner, strict=True)))
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, x, y = [], [], []
        i = j = 0
        for end in sorted(ends):
            x, y = [], []
            while i < len(a) and spans[0][i][1] <= end:
                x.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                y.append(str(b[j]))
                j += 1
            groups.append(f"{','.join(x)}|{','.join(y)}")
        pairs = [(a[p], b[q]) for p, q in links]
        counts.update(pairs)
        kept.append((doc_id, a, b, groups, pairs))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(d, len(a), len(b), len(g), len(p), sum(counts[x] == highest[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, p in kept]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", "a\n", "a \n b", "a\n\n  b", "a   b\t c", "x\x1c y \x1f  z", "▁", "a▁ b", "naïve café 北京 \U0001f600 x", "<|endoftext|> <s> <0x41> </s> <unk>", "a\x00b \x00",
    "don't we'll  I'M", "1234567 12 3.14", "über space em 　 ideographic", "é combining", "﻿bom", "word " * 300, "x" * 3000, "ab" * 5000 + " end", " \t \n \r\n  ", "tail space ", "tail spaces   ", "\ttab first", "a​b", "ﬁ ligature Ⅳ ½",
]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query_equals_brute_force(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(L.op12_alignment(spark, SF)) == sorted(plain(libraries, docs), key=str)


def test_odd_texts_many_blocks_repeated_rows_and_clashing_columns(spark, libraries):
    docs = [(k % 29 or None, t) for k, t in enumerate(ODD * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS block", "1 AS key", "'y' AS keys", "2 AS count").repartition(3)
    for size in (100, L.BLOCK_BYTES):
        assert rows_of(L.align(df, A, B, size)) == sorted(plain(libraries, docs), key=str)
    assert L.align(df.where("false"), A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(L.align(nothing, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_parts_over_several_reads_are_those_of_the_whole_text(monkeypatch):
    for text in ODD[2:]:
        whole = [p for some in L.parts_of(text) for p in some]
        monkeypatch.setattr(L, "AT_ONCE", 2)
        assert [p for some in L.parts_of(text) for p in some] == whole
        monkeypatch.undo()
        assert "".join(whole) == " " + text


def test_groups_are_components_of_the_overlap_graph():
    n = lambda *x: np.array(x, np.int64)
    (first, second) = L.aligned(n(5, 6, 7, 1), n(2, 3, 6, 10), n(8, 9, 10, 2, 3, 4), n(1, 3, 6, 7, 8, 10), n(6, 10))
    assert first[:4] == (3, 3, 2, "5,6|8,9;7|10") and [(k >> 32, k & 2**32 - 1) for k in first[4]] == [(5, 8), (5, 9), (6, 9), (7, 10)]
    assert second[:4] == (1, 3, 1, "1|2,3,4")
    edges = np.random.default_rng(1).integers(0, 200, (2, 150))
    root = L.united(200, *edges)
    plain = list(range(200))
    for i, j in edges.T.tolist():
        low, high = sorted((plain[i], plain[j]))
        plain = [low if x == high else x for x in plain]
    assert root.tolist() == plain


def test_words_are_encoded_once_whatever_marks_end_them(libraries, monkeypatch):
    aligner = L.Aligner(A, B)
    encoded, several = [], aligner._several
    monkeypatch.setattr(aligner, "_several", lambda parts: (encoded.extend(parts), several(parts))[1])
    block = L.Block(aligner)
    words = ["naïve", "Maß", "often", "X"]
    clean = [(k, f"x {w}{m} y") for k, (w, m) in enumerate((w, m) for w in words for m in ("", ".", ",", "!!", ",%%%", "?!;:", ".....", ")", "'s.", "7.", ".\n"))]
    block.add(clean)
    assert [encoded.count(f" {w}") for w in words] == [1] * 4 and not {" often.", " often,%%%"} & {*encoded}
    odd = [(100, "▁often. x"), (101, None), (102, "X² ², ́. often\u0301. ª. ﬁ."), (103, " ".join(t for _, t in clean))]
    block.add(odd)
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for made in block.batches() for r in made.to_pylist() if r["keys"] is None]
    assert got == [(d, *n, digest) for d, *n, _, _, digest in plain(libraries, clean + odd)]


def test_short_texts_are_learned_together(monkeypatch):
    asked, learn = [], L.Aligner.learn
    monkeypatch.setattr(L.Aligner, "learn", lambda self, parts: (asked.append(list(parts)), learn(self, parts))[1])
    block = L.Block(L.Aligner(A, B))
    block.add([(k, f"some word{k} here") for k in range(50)])
    assert len(asked) == 1 and len(asked[0]) == 52
