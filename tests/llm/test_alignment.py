"""Alignment against the tokenizer libraries' own offsets, token by token."""

import dataclasses
import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm import alignment, registry


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_tokens(libraries, text):
    """[(id, bytes)] of either tokenizer, by the libraries themselves."""
    t, sp = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in letter):
        letter[b] = chr(256 + i)
    back = {v: k for k, v in letter.items()}
    e = t.encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(back[c] for c in name)) for i, name in zip(e.ids, e.tokens)]
    second = []
    for i in sp.encode(text):
        name = sp.id_to_piece(i)
        second.append((i, bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()))
    return first, second


def brute(libraries, rows):
    docs = []
    for i, text in rows:
        a, b = byte_tokens(libraries, text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []

        def ranges(tokens):
            at, out = 0, []
            for k, x in tokens:
                out.append((at, at + len(x), k))
                at += len(x)
            return out

        ra, rb = ranges(a), ranges(b)
        links = [(x[2], y[2]) for x in ra for y in rb if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in ra} & {y[1] for y in rb})
        low, parts = 0, []
        for c in cuts:
            parts.append(",".join(str(x[2]) for x in ra if low < x[1] <= c) + "|" + ",".join(str(y[2]) for y in rb if low < y[1] <= c))
            low = c
        docs.append((i, len(ra), len(rb), len(cuts), links, ";".join(parts)))
    count = Counter(p for d in docs for p in set(d[4]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, na, nb, groups, links, text in docs:
        out.append((i, na, nb, groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def run(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("block", F.lit(1)).withColumn("a", F.lit("x"))
    return sorted((tuple(r) for r in alignment.align_tokenizers(df.repartition(3), *registry.aligned_tokenizers()).collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    pieces = ["the", " cat", "cat", "  ", "\n", "\t", "naïve", "日本語", "🙂", "don't", "1234", "</s>", "<|endoftext|>", "<0x41>", "▁", " ", "é", "é", "...", "ß", "İ", "​", "x" * 40]
    return [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "block", "step"), [(1, 2 << 20, 1 << 18), (2, 300, 4)])
def test_equals_brute_force(spark, libraries, monkeypatch, seed, block, step):
    """One block, and many blocks linked a few tokens at a time."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "STEP", step)
    rows = texts(seed, 120)
    got = run(spark, rows)
    assert got == brute(libraries, rows)
    assert sum(r[1] > 0 for r in got) > 20


def test_ids_equal_the_library(libraries):
    """The byte-level vocabulary in tiktoken gives the ids of its own library, special strings as plain text, and very long texts too."""
    both = alignment.tokenizers(*registry.aligned_tokenizers())
    for _, text in [*texts(3, 300), (0, "word " * 40_000), (1, "a" * 3000)]:
        assert both.first(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_odd_rows(spark, libraries):
    rows = [(1, None), (2, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (4, " "), (5, "\x00\x01"), (6, "a b " * 30_000)]
    assert [r[:3] for r in run(spark, rows) if r[0] in (1, 2)] == [(1, 0, 0), (2, 0, 0)]
    short = rows[:-1]
    assert run(spark, short) == brute(libraries, short)
    assert run(spark, []) == []
    assert [r[0] for r in run(spark, [("k", "x y")], "string")] == ["k"]
    x = {r[0]: r for r in run(spark, rows)}[6]
    a, b = byte_tokens(libraries, rows[-1][1])
    assert x[1:3] == (len(a), len(b))


def test_driver_table(spark, libraries):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 1500)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = sorted((tuple(r) for r in alignment.align_tokenizers(d, *registry.aligned_tokenizers()).collect()), key=str)
    assert got == brute(libraries, rows)


def test_segments_are_encoded_as_the_whole(libraries, monkeypatch):
    """Cut at spaces, both tokenizers give the ids of the whole text, and so they do in one call for all segments; without a cut the result is the same."""
    both = alignment.tokenizers(*registry.aligned_tokenizers())
    assert both.apart
    uncut = dataclasses.replace(both, apart=False)
    monkeypatch.setattr(alignment, "CHUNK", 60)
    rows = [t for _, t in [*texts(7, 400), (0, " lead"), (1, "trail  "), (5, "trail "), (6, "a b \n "), (2, "a\u00a0 b\x1c c\u2003 d"), (3, " "), (4, "  "), (8, ""), (9, "plain words only")]]
    for text in rows:
        parts = alignment.segments(text)
        assert "".join(" " + p for p in parts) == " " + text
        whole = alignment.tokens(both, text)
        if whole and text:
            (a, n_a), (b, n_b), good = alignment.encode_segments(both, parts)
            assert a.tolist() == whole[0].tolist() and b.tolist() == whole[1].tolist() and good.all() and len(n_a) == len(n_b) == len(parts)
    one, other = (alignment.read_block(x, pa.array(rows, pa.string())) for x in (both, uncut))
    assert (one.numbers == other.numbers).all() and one.digests == other.digests and (one.pairs == other.pairs).all() and (one.documents == other.documents).all()
    assert all((x == y).all() for x, y in zip(one.times + one.place, other.times + other.place, strict=True))
