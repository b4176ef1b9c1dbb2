"""Decontamination, licences, spans, BPE and chat against brute force, exact round trips and SQL."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headwater.llm import bpe, chat, decontaminate, licences, registry, spans
from headwater.llm import words as W

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_words_against_regex():
    texts = ["", "Hello, WORLD", "é1 x.y\nZ", "...", "a" * 50, "ÀB c", "end."]
    w = W.words(pa.array(texts), ascii_only=True)
    got = [[w.text(i) for i in range(a, b)] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert got == [WORD.findall(ascii_lower(t)) for t in texts]
    ids = collections.defaultdict(set)
    for i in range(len(w.start)):
        ids[w.text(i)].add(int(w.hash[i]))
    assert all(len(x) == 1 for x in ids.values()) and len({min(x) for x in ids.values()}) == len(ids)
    s, at = W.shingles(w.hash, w.offsets)
    assert np.diff(at).tolist() == [max(n - 4, min(n, 1)) for n in np.diff(w.offsets).tolist()]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("places", F.lit(0))


# Decontamination.


def bag(words):
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else collections.Counter([tuple(words)] if words else [])


def brute_matches(docs, items):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        for i, item in items:
            b = bag(WORD.findall((item or "").lower()))
            size = sum(b.values())
            if not size or not s:
                continue
            k = min(size, len(s))
            for a in range(len(s) - k + 1):
                c = collections.Counter(s[a : a + k])
                both = sum((b & c).values())
                if both >= 0.8 * (size + k - both) - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rnd.choice([3, 5, 8, 20, 40]))) for i in range(30)]
    docs = []
    for d in range(240):
        w = make(rnd.choice([0, 4, 30, 300]))
        if d % 2:
            item = list(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 1, 3])):
                item[rnd.randrange(len(item))] = "changed"
            at = rnd.randint(0, len(w))
            w = w[:at] + item[: len(item) - (d % 7 == 0)] + w[at:]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1]).upper() + " tail " * 5000)]
    benchmark = [(i, " ".join(t)) for i, t in items] + [(77, None), (78, ""), (79, "rep " * 30)]
    docs.append((903, "x y z " + "rep " * 30))
    b = spark.createDataFrame(benchmark, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate.find_benchmark(docs_of(spark, docs), b)
    want = brute_matches(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs_of(spark, docs), b).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_benchmark(docs_of(spark, docs), b.limit(0)).count() == 0
    assert decontaminate.find_benchmark(docs_of(spark, []), b).count() == 0


def test_many_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(15)]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(docs_of(spark, [(i + 100, "pre " + t) for i, t in items]), b)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(i + 100, i) for i in range(15)]


def test_rows_without_an_id_of_their_own_are_cleaned(spark):
    item = " ".join(f"q{j}" for j in range(12))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(None, "pre " + item), (None, "clean words"), (4, item + " post"), (4, "other clean words"), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.keep_clean(docs_of(spark, docs), b).collect()]
    assert sorted(kept, key=str) == sorted([docs[1], docs[3], docs[4]], key=str)


def test_lookup_misses_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.Index([(i, " ".join(f"t{i}n{j}" for j in range(30))) for i in range(50)])
    prints = np.concatenate([index.prints ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for n in (1, 10, 19, 25)])
    w, i = index.lookup(prints)
    near = np.bitwise_count(prints[:, None] ^ index.prints) <= decontaminate.RADIUS
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*np.nonzero(near), strict=True))


# Licences.


def test_base_phrases_against_regex(spark):
    rnd = random.Random(3)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "version", "under", "gnu", "é", "x"]
    docs = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 5, 80])))) for i in range(200)]
    docs += [(900, None), (901, "CC-BY general PUBLIC license"), (902, "ccby"), (903, "Ügeneral public license")]
    got = {r["doc_id"]: r for r in licences.scan_licences(docs_of(spark, docs)).collect()}
    for d, t in docs:
        w = WORD.findall(ascii_lower(t or ""))
        places = [(i, label) for i in range(len(w)) for p, label in licences.BASE.items() if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_matching_statistics_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        templates = [[rnd.randrange(4) for _ in range(rnd.randint(1, 9))] for _ in range(4)]
        text = [rnd.randrange(5) for _ in range(40)]
        a = licences.Automaton([(str(i), t) for i, t in enumerate(templates)], [templates[0]])
        joined = [tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
        every = set(joined)
        for i, state, size in a.stream(text):
            assert size == max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in every), default=0)
            if size:
                run = text[i + 1 - size : i + 1]
                want = [(t, j) for t, x in enumerate(templates) for j in range(len(x)) if x[max(0, j + 1 - size) : j + 1] == run]
                assert a.ends[state] == want


def test_templates_are_found(spark):
    mit = licences.TEMPLATES["mit"][1]
    docs = [(1, "intro words " + mit.title() + " outro"), (2, mit.replace("deal in", "trade in")), (3, "Licensed under CC BY-NC 4.0."), (4, "the software of the copy")]
    got = {r["doc_id"]: r for r in licences.scan_licences(docs_of(spark, docs)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["spans"][0]["first_word"] == 2
    assert got[2]["labels"] == "mit" and 0.8 <= got[2]["score"] < 1
    assert "cc-by-nc-4.0" in got[3]["labels"] and got[3]["base_labels"] == "cc-by"
    assert got[4]["labels"] == "" and got[4]["score"] == 0
    assert licences.scan_licences(docs_of(spark, [])).count() == 0


def test_chains_against_all_chains():
    """The best chain that ends in each match, against trying every sequence of matches."""
    rnd = random.Random(9)

    def every(own, i):
        end, place, size = own[i]
        yield size, end - size + 1
        for j in range(len(own)):
            e, p, _ = own[j]
            new = min(size, end - e, place - p)
            if e < end and p < place and new > 0 and e >= end - size - licences.GAP:
                for covered, first in every(own, j):
                    yield covered + new, first

    for _ in range(200):
        own = sorted({(rnd.randint(5, 25), rnd.randint(5, 20), rnd.randint(3, 5)) for _ in range(rnd.randint(1, 8))})
        got = list(licences.chains([(7, e, p, n) for e, p, n in own]))
        assert [(t, last) for t, _, last, _ in got] == [(7, e) for e, _, _ in own]
        for i, (_, first, _, covered) in enumerate(got):
            ways = list(every(own, i))
            assert covered == max(c for c, _ in ways) and first in {f for c, f in ways if c == covered}


def test_whole_texts(spark):
    """Every whole licence is told among other words, as it is and with some words changed, and so are its kin."""
    rnd, docs, want = random.Random(4), [], {}
    texts = [(label, text) for label, every in licences.whole_texts().items() for text in every]
    assert len(texts) >= 11 and sum(len(t.split()) for _, t in texts) > 1400
    for label, text in texts:
        for change in (0, 0.02):
            w = [x if rnd.random() >= change else "zzz" for x in text.split()]
            docs.append((len(docs), " ".join(["lorem"] * rnd.randint(0, 9) + w + ["ipsum"] * 5)))
            want[docs[-1][0]] = label
    docs.append((999, " ".join(texts[0][1].split()[:30] + ["other"] * 200)))
    got = {r["doc_id"]: r for r in licences.scan_licences(docs_of(spark, docs)).collect()}
    for d, label in want.items():
        labels = [x for x in got[d]["labels"].split(",") if x != "gpl"]
        assert label in labels and set(labels) <= {label, "unlicense" if label == "unlicense" else label, "cc0" if label == "unlicense" else label}, (label, labels)
        span = max((x for x in got[d]["spans"] if x["label"] == label), key=lambda x: x["last_word"] - x["first_word"])
        assert span["last_word"] - span["first_word"] + 1 > 0.75 * (got[d]["n_words"] - 14)
    assert "gpl" in got[[d for d, x in want.items() if x == "gpl-3.0"][0]]["base_labels"]


# Sentence spans.


def sentences(text):
    """(sentences with what follows each, their words) in plain Python."""
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(ascii_lower(text))]
    h = W.words(pa.array([text]), ascii_only=True).hash.tolist()
    begins = [i for i, (s, _, _) in enumerate(words) if i == 0 or re.search(r"[.!?\n\r]", text[words[i - 1][1] : s])]
    starts = []
    for a, b in zip(begins, [*begins[1:], len(words)]):
        last = a
        for i in range(a, b):
            if b - a > 12 and i - a >= 4 and h[i] < min(h[i - 4 : i]) and h[i] <= min(h[i : min(i + 5, b)]):
                last = i
            if (i - last) % 12 == 0:
                starts.append(i)
    return words, starts


def brute_dedup(docs):
    out, seen = {}, {}
    parsed = {}
    for d, text in sorted(docs):
        words, starts = sentences(text or "")
        ends = [*starts[1:], len(words)]
        runs = {}
        for i in range(len(starts)):
            for j in range(i + 2, len(starts) + 1):
                if ends[j - 1] - starts[i] >= 16:
                    key = tuple(w for _, _, w in words[starts[i] : ends[j - 1]])
                    runs[i] = (key, j)
                    seen.setdefault(key, (d, i))
                    break
        parsed[d] = (text or "", words, starts, runs)
    for d, (text, words, starts, runs) in parsed.items():
        gone = {k for i, (key, j) in runs.items() if seen[key] != (d, i) for k in range(i, j)}
        at = [words[s][0] for s in starts] + [len(text)]
        pre = text[: at[0]] if starts and 0 not in gone else "" if starts else text
        out[d] = (pre + "".join(text[at[i] : at[i + 1]] for i in range(len(starts)) if i not in gone) if gone else text, len(starts), len(gone))
    return out


def test_spans_against_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n)).capitalize() + rnd.choice([". ", "!\n", "? "])
    passages = ["".join(say(rnd.randint(4, 30)) for _ in range(6)) for _ in range(5)]
    docs = []
    for d in range(60):
        body = [say(rnd.choice([1, 3, 9, 40])) for _ in range(rnd.randint(0, 9))] + ["Short common line. "] * (d % 3)
        if d % 2:
            body.insert(rnd.randint(0, len(body)), rnd.choice(passages))
        docs.append((d, "  " + "".join(body)))
    docs += [(100, None), (101, ""), (102, docs[5][1]), (103, "é " * 40), (104, passages[0] + "between. " + passages[0])]
    got = {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in spans.dedup_spans(docs_of(spark, docs)).collect()}
    assert got == brute_dedup(docs)
    assert got[102][0].strip() in ("", "Short common line.", "Short common line. Short common line.") and any(x[2] for x in got.values())
    assert spans.dedup_spans(docs_of(spark, [])).count() == 0
    assert spans.dedup_spans(docs_of(spark, [(None, passages[0]), (None, passages[0])])).where("n_removed > 0").count() == 0


def test_an_edit_inside_a_long_sentence_moves_few_cuts(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    docs = [(1, " ".join(words)), (2, " ".join(["fresh", *words[:5], *words[6:]])), (3, "other words before " + " ".join(words[100:180])), (4, " ".join(f"z{i}" for i in range(90)))]
    got = {r["doc_id"]: r["text"].split() for r in spans.dedup_spans(docs_of(spark, docs)).collect()}
    assert got[1] == words and len(got[4]) == 90 and len(got[2]) < 30 and len(got[3]) < 35


def test_texts_without_an_id_of_their_own_are_documents(spark):
    """Null ids and repeated ids: a repeat is found between any two texts, and each text loses only its own sentences."""
    say = lambda name: "".join(f"{name}{i} " * 9 + ". " for i in range(4))
    passage, again, lone = say("p"), say("q"), say("r")
    null = {"short": (None, "Alone. " + passage), "long": (None, say("s") + say("t") + say("u")), "a": (None, say("v") + again), "b": (None, again)}
    same = {"x": (7, say("x") + passage), "y": (7, say("y") + say("z") + say("w")), "m": (8, say("m") + lone), "n": (8, say("n") + say("o") + lone)}
    rows = [(1, passage), *null.values(), *same.values()]
    got = {(r["doc_id"], r["n_sentences"], r["text"]) for r in spans.dedup_spans(docs_of(spark, rows)).collect()}
    left = {t for _, _, t in got}
    assert len(got) == len(rows) and passage in left and null["long"][1] in left and same["y"][1] in left
    assert "Alone. " in left and say("x") in left
    assert sum(again in t for t in left) == 1 and sum(lone in t for t in left) == 1
    assert {(d, t) for d, _, t in got if "s1 " in t or "y1 " in t} == {null["long"], same["y"]}


# BPE.


def test_bpe_round_trip(spark):
    path, pattern = registry.tokenizer()
    enc = bpe.encoding(path, pattern)
    rnd = random.Random(4)
    pool = ["the", "l'été", "don't", "123", "!?", "\n\n", "  ", "\t", "日本語", "🙂", " ", "<|endoftext|>", "a" * 30, "'s"]
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 3, 400])))) for i in range(30)] + [(99, None), (98, "x" * 300), (97, "word " * 40_000)]
    got = {r["doc_id"]: r for r in bpe.bpe(docs_of(spark, docs), path, pattern, with_ids=True).collect()}
    for d, t in docs:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        r = got[d]
        assert bytes(r["ids"]) == ids.tobytes() and bytes(r["decoded"]) == (t or "").encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for size in (1, 7, 50):
        for _, t in docs[:30]:
            assert "".join(bpe.parts(t, size)) == t
            assert [i for p in bpe.parts(t, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert bpe.decode(enc, bpe.encode(enc, "🙂")[:1]) == "🙂".encode()[: len(bpe.decode(enc, bpe.encode(enc, "🙂")[:1]))]
    assert bpe.bpe(docs_of(spark, []), path, pattern).count() == 0


# Chat.


def test_chat_equals_sql_and_python(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    q = con.execute(registry.SQL["op6_chat_format"])
    names = [c[0] for c in q.description]
    got = registry.QUERIES["op6_chat_format"](spark, SF)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(q.fetchall())


@pytest.mark.parametrize("text", ["", "\\", "<|end|>", "<\\|end|>", "[INST] a [/INST]</s><s>", "<<SYS>>x<</SYS>>", "\\\\<|", "<<|turn|>>", "a\\<|also|>\n$1"])
def test_control_strings_survive(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "user", "two"), (1, 2, text, "three"), (1, 3, "assistant", text), (1, 3, "assistant", text), (1, None, None, None), (None, 0, "assistant", "q")]
    f = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)))
    out = {r["conv_id"]: r for r in f.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    want = [("", ""), ("user", text), ("user", "two"), (text, "three"), ("assistant", text), ("assistant", text)]
    assert [tuple(t) for t in out[1]["turns"]] == want and [tuple(t) for t in out[None]["turns"]] == [("assistant", "q")]
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"]
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", out[1]["formatted"])
    d = {r["conv_id"]: r for r in chat.digest(f).collect()}[1]
    assert d["n_turns"] == 6 and d["loss_chars"] == 2 * len(text)
    assert d["loss_sha256"] == hashlib.sha256((text * 2).encode()).hexdigest()
    assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
