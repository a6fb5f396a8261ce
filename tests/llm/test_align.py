"""Alignment of two tokenizers against whole-text encoding and comparison of every token pair."""

import hashlib
import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from tessera.llm import align  # noqa: E402
from tessera.llm.bpe import CHARACTERS  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def expected(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    back = {c: b for b, c in enumerate(CHARACTERS)}
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, total = [], Counter()
    for doc_id, text in rows:
        x = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = s.encode(text) if text else []
        xb = [bytes(back[c] for c in t.id_to_token(i)) for i in x]
        yb = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + text).encode() if text else b""
        if b"".join(xb) != whole or b"".join(yb) != whole:
            x, y, xb, yb = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        xe, ye = ends(xb), ends(yb)
        links = []
        for i in range(len(x)):
            for j in range(len(y)):
                if xe[i] - len(xb[i]) < ye[j] and ye[j] - len(yb[j]) < xe[i]:
                    links.append((x[i], y[j]))
        groups, i, j = [], 0, 0
        for cut in sorted(set(xe) & set(ye)):
            u = [x[k] for k in range(i, len(x)) if xe[k] <= cut]
            v = [y[k] for k in range(j, len(y)) if ye[k] <= cut]
            i, j = i + len(u), j + len(v)
            groups.append(",".join(map(str, u)) + "|" + ",".join(map(str, v)))
        total.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(n, most.get(b, 0))
    for doc_id, n_a, n_b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), digest)


def texts():
    rng = random.Random(2)
    some = ["hello", "straße", "naïve", "日本語テキスト", "🙂", "don't", "foo();\r\n\tbar", "12345", "<|endoftext|>", "<s>", "<0x41>", "antidisestablishment", " x", "a　 b", "\n\n", "  two", "x\u0085 y", "λόγος", "́", "\x1c q", "w.\n  indented", "ciónñas"]
    out = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    out += [None, "", " ", "   ", "\n", "a", " a", "a ", "  a  b ", "x▁y", "tab\tand\x00null", "﻿bom", "é‍", "word " * 300, "ab" * 400, "é" * 300, ";\r;\r x;\r", *some]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (3, out[3]), (None, out[4])]


@pytest.mark.parametrize("block", [align.BLOCK, 200])
def test_alignment(spark, block):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, block int, n_a string").repartition(3)
    found = align.align(df, A, B, block=block)
    assert found.columns == ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, (tuple(r) for r in found.drop("block").collect()))) == sorted(map(str, expected(rows)))


def test_empty_table(spark):
    assert not align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect()
