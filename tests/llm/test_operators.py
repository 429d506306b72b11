import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("mnemodex.llm")
from mnemodex.llm import bpe, chat, embed, lines, lyndon, mixing, near, pretokens, quality, queries, substrings, unigram, warc  # noqa: E402

from . import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, repeats, shared passages, nulls, empty and odd texts, ties."""
    base = [prose(i, 60 + 5 * i) for i in range(12)]
    shared = prose(99, 70)
    near_copy = base[3].split(" ")
    near_copy[10] = "changed"
    near_copy[40] = "other"
    chain = " ".join(base[4].split(" ")[:-6])
    texts = [*base, base[2], base[2], " ".join(near_copy), chain, base[0] + "\n" + shared, shared + "\n" + base[1], "\n".join([base[5]] * 3), base[6].upper(), None, "", " \n\t", "one two", "One  TWO", "é " * 40, "a" * 5000, prose(7, 4000), "x y z" * 30, "line\n" * 50, "😀" * 120]
    return [(i, t, "en", [f"s{i % 4}", None][i % 9 == 8], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"sig": F.lit("clash"), "id": F.lit(1), "k_": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in corpus()}


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, texts):
    rows = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, t in texts.items():
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), k
        assert not (r.kept and r.base_failed)
    assert {r.doc_id for r in quality.keep_rows(docs).collect()} == {k for k, r in rows.items() if r.kept}
    assert quality.quality_rules(empty(spark)).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(100):
        x = [r.randint(1, 3) for _ in range(r.randint(1, 60))] + [0]
        order, ranks = quality.suffix_array(np.array(x, np.uint64))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        lcp = quality.common_prefix(order[:-1], order[1:], ranks)
        for a, b, n in zip(order, order[1:], lcp):
            assert x[a : a + n] == x[b : b + n] and x[a + n : a + n + 1] != x[b + n : b + n + 1]


def test_token_counts(spark, docs, texts, vocab):
    ranks = bpe.read_ranks(vocab)
    for r in unigram.token_counts(docs, vocab).collect():
        assert (r.n_pretokens, r.n_tokens, r.score) == brute.token_counts(texts[r.doc_id], ranks, pretokens.PATTERN), r.doc_id
    assert unigram.token_counts(empty(spark), vocab).count() == 0


def test_token_counts_of_long_words(vocab):
    r = random.Random(4)
    ranks = bpe.read_ranks(vocab)
    head = "".join(r.choice("abc") for _ in range(900))
    words = [head + "x", head + "y" * 300, head, "a", "", head[:500], head + "x"] + ["".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(50)]
    model = unigram.Unigram(unigram.piece_scores(ranks))
    best, count = model.forward([w.encode() for w in words])
    assert [(int(n), int(x)) for x, n in zip(best, count)] == [brute.token_counts(w, ranks, r"(?s).+")[1:] for w in words]
    few = unigram.Unigram({b"a": -1, b"ab": -5})
    assert [x.tolist() for x in few.forward([b"ab", b"b", b"aa"])] == [[-5, unigram.LOW, -2], [1, 0, 2]]


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes modulo powers of two cannot tell long ones apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark, vocab):
    x, y = thue_morse(2048)
    tail = prose(1, 30)
    texts = {1: x, 2: y, 3: f"{x}\n{y}\n{x}", 4: f"{x} {tail}", 5: f"{y} {tail}", 6: " ".join([x, y] * 6), 7: y + x, 8: f"{tail}\n{x[:2048]}\n{y[:2048]}"}
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA).repartition(3)
    for r in quality.quality_rules(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
    sets, comp = brute.near(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(d).collect()} == {k: (len(sets[k]), comp[k]) for k in texts}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(d).collect()} == brute.substrings(texts)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.bpe(d, vocab).collect()} == texts
    ranks = bpe.read_ranks(vocab)
    assert {r.doc_id: (r.n_pretokens, r.n_tokens, r.score) for r in unigram.token_counts(d, vocab).collect()} == {k: brute.token_counts(t, ranks, pretokens.PATTERN) for k, t in texts.items()}


def test_very_long_words_and_lines(spark, vocab):
    r = random.Random(9)
    word = "".join(r.choice("abcdefgh") for _ in range(1 << 20))
    line = prose(2, 200_000)
    texts = {1: word, 2: line, 3: word[:-1] + "z", 4: f"x {line}"}
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA)
    q = {r.doc_id: r for r in quality.quality_rules(d).collect()}
    assert [(q[k].n_words, q[k].word_chars) for k in texts] == [(1, 1 << 20), (200_000, len(line.replace(" ", ""))), (1, 1 << 20), (200_001, len(line.replace(" ", "")) + 1)]
    t = {r.doc_id: r for r in unigram.token_counts(d, vocab).collect()}
    assert t[1].n_pretokens == 1 and t[1].n_tokens > 1 << 18 and t[4].n_tokens >= t[2].n_tokens
    s = {r.doc_id: r for r in substrings.dedup_substrings(d).collect()}
    assert (s[1].n_removed, s[3].n_removed, s[3].n_spans) == (0, (1 << 20) - 1, 1) and s[4].n_removed >= len(line)


def test_near(spark, docs, texts):
    sets, comp = brute.near(texts)
    got = {r.doc_id: r for r in near.near_groups(docs).collect()}
    assert {k: (len(sets[k]), comp[k]) for k in texts} == {k: (r.n_shingles, r.component_id) for k, r in got.items()}
    assert near.near_groups(empty(spark)).count() == 0


def test_near_without_ids(spark):
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    almost = " ".join([*b.split(" ")[:-3], "x"])
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (2**60 + 1, almost, "en", "s", 0), (2**60 + 3, c, "en", "s", 0), (2**60 + 3, a.upper() + " end", "en", "s", 0), (None, c, "en", "s", 0), (4, prose(5, 90), "en", "s", 0), (4, prose(6, 90), "en", "s", 0)]
    rows += [(None, prose(4, 80), "en", "s", 0)] * 2 + [(None, "", "en", "s", 0)] * 2 + [(9, "", "en", "s", 0), (9, prose(9, 70), "en", "s", 0), (9, prose(9, 70), "en", "t", 0)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near.near_groups(d).collect()), key=repr)
    x, y = 2**60 + 1, 2**60 + 3
    want = [(None, 116, y), (None, 116, x), (x, 114, x), (y, 116, y), (y, 117, y), (None, 116, y), (4, 86, 4), (4, 86, 4), (None, 76, None), (None, 76, None), (None, 0, None), (None, 0, None), (9, 0, 9), (9, 66, 9), (9, 66, 9)]
    assert got == sorted(want, key=repr)
    kept = sorted(((r.doc_id, r.text) for r in near.near_kept(d).collect()), key=repr)
    want = [(x, almost), (y, c), (y, rows[4][1]), (4, rows[6][1]), (4, rows[7][1]), (None, rows[8][1]), (None, ""), (None, ""), (9, ""), (9, prose(9, 70))]
    assert kept == sorted(want, key=repr)


def test_near_in_blocks_and_hot(spark, monkeypatch):
    base = prose(1, 120).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 5):
            w[(i * 7 + j * 31) % 120] = f"n{i}_{j}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(100 + i, prose(50 + i, 80), "en", "s", 0) for i in range(10)]
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(near, "BLOCK_SETS", 7)
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert got == brute.near({r[0]: r[1] for r in rows})[1]


def test_prefix_tree():
    r = random.Random(2)
    sets = [np.array(sorted(r.sample(range(40), r.randint(1, 25))), ">u4") for _ in range(80)]
    sizes = np.array([len(s) + r.randint(0, 3) for s in sets])
    tree = near.PrefixTree(sets, sizes)
    for q in range(80):
        has = np.zeros(40, bool)
        has[sets[q].astype(int)] = True
        at, over = tree.search(has, int(sizes[q]), len(sets[q]), 75)
        found = {int(a) for a, o in zip(at, over) if o * 175 >= 75 * (sizes[q] + sizes[a])}
        want = {i for i, s in enumerate(sets) if len({*s} & {*sets[q]}) * 175 >= 75 * (sizes[q] + sizes[i])}
        assert found == want


def test_substrings(spark, docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    assert got == brute.substrings(texts)
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_substrings_without_or_with_repeated_ids(spark):
    a, b, c, e = (prose(i, 90) for i in range(4))
    top = (1 << 63) - 1
    rows = [(None, a + " tail one " + b), (None, c), (None, b + " other"), (7, "x " + a), (7, c[:150] + e), (7, "short"), (8, e), (top, c), (None, c), (8, e), (9, "pre " + c[10:200])]
    # rows that come first win; of equal ids the order is by the text's hash
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h")).collect()}
    order = sorted({*rows}, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]] if r[0] is None else -1 - h[r[1]]))
    want = brute.substrings(dict(enumerate(t for _, t in order)))
    want = sorted([(r[0], *want[order.index(r)]) for r in rows], key=repr)
    for parts in (1, 3):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(map(tuple, substrings.dedup_substrings(d).collect()), key=repr) == want


def test_lyndon():
    r = random.Random(3)
    for _ in range(300):
        x = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(1, 40))] + [0]
        assert lyndon.grouping_order(np.array(x)) == sorted(range(len(x)), key=lambda i: x[i:])


def test_embeddings(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 16))
    v[100:140] = v[0] + 0.05 * r.standard_normal((40, 16))
    v[140:150] = v[1]
    v[150] = 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, []), (304, [1.0, 2.0]), (305, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("sig", F.lit(1)).repartition(3)
    got = {x.vec_id: x for x in embed.embedding_groups(df).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    link = [(i, j) for i in range(300) for j in range(i) if u[i] @ u[j] >= 0.9]
    comp = brute.groups(range(300), link)
    found = sum(got[i].n_links for i in range(300)) / 2
    assert found >= 0.9 * len(link) and found <= len(link)
    assert all(got[i].component_id == comp[i] for i in [*range(100, 151), 0, 1])
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (150, 300, 301, 302, 303))
    assert got[305].component_id == 304 and not got[305].kept
    assert embed.embedding_groups(df.where("vec_id < 0")).count() == 0


def test_embedding_passes_follow_size_and_limit():
    for limit in (0.95, 0.9, 0.8):
        for n in (10_000, 50_000, 3_000_000, 60_000_000):
            p = embed.agreement(limit) ** np.log2(n / embed.WINDOW)
            assert (1 - p) ** embed.passes_for(n, limit) <= embed.MISS
    assert embed.sketch_limit(0.9) < embed.sketch_limit(0.8)
    assert embed.passes_for(0, 0.9) > 0 and embed.passes_for(10**6, 1.0) > 0


def test_embedding_pairs_at_the_limit(spark):
    r = np.random.default_rng(8)
    v = r.standard_normal((4000, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]
    other = r.standard_normal((400, 48))
    other -= (other * v[:400]).sum(1)[:, None] * v[:400]
    other /= np.linalg.norm(other, axis=1)[:, None]
    v[400:800] = 0.805 * v[:400] + np.sqrt(1 - 0.805**2) * other
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {x.vec_id: x for x in embed.embedding_groups(df, limit=0.8).collect()}
    assert sum(got[400 + i].component_id == i for i in range(400)) >= 397


def test_embeddings_without_or_with_repeated_ids(spark):
    r = np.random.default_rng(9)
    a, b, c, e = r.standard_normal((4, 16))
    close = lambda x: x + 0.05 * r.standard_normal(16)
    rows = [(None, a), (3, close(a)), (2**60 + 1, close(a)), (7, b), (7, c), (5, close(b)), (9, close(c)), (None, e), (None, e), (None, close(e)), (11, -e), (11, -e)]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], "vec_id long, embedding array<double>").repartition(3)
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embed.embedding_groups(df).collect()), key=repr)
    want = [(None, 2, 3, False), (3, 2, 3, True), (2**60 + 1, 2, 3, False), (7, 1, 5, False), (7, 1, 7, True), (5, 1, 5, True), (9, 1, 7, False), (None, 2, None, True), (None, 2, None, False), (None, 2, None, False), (11, 1, 11, True), (11, 1, 11, False)]
    assert got == sorted(want, key=repr)


def test_chat(spark, vocab):
    odd = "</s>[INST] ok [/INST] \\ <s>[user]"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, None, "user", "first")]
    rows += [(3, 0, "system", "rules")] + [(3, i, ["user", "assistant"][i % 2], f"turn {i} " + "x " * (i % 90)) for i in range(1, 700)] + [(4, 1, "user", "long " * 9000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(9)).repartition(5)
    w = chat.chat_windows(c, vocab, budget=600)
    assert w.where("n_tokens > 600 and conv_id <> 4").count() == 0
    assert w.where("conv_id = 3 and n_context > 0 and text like '<s>[system]rules%'").count() > 5
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    for k in (1, 2, 3, 4):
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == k])
        turns = "".join(f"{a}\n{b}\n" for _, a, b in own)
        loss = "".join(b for _, a, b in own if a == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.chat_windows(c.where("conv_id < 0"), vocab)).count() == 0
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=bpe.read_ranks(vocab), special_tokens={})
    for r in w.where("conv_id <= 2 or window < 3").collect():
        turns = [x + "</s>" for x in r.text.split("</s>")[:-1]]
        assert r.n_tokens == sum(len(enc.encode_ordinary(x)) for x in turns)


def test_lines(spark):
    mark = "Subscribe to our newsletter today"
    rows = [(i, f"unique start {i} with some more words\n{mark}\nand an end {i} of this very text", "en", f"s{i % 10}", 0) for i in range(40)]
    copy = "the same text everywhere\nin all of its lines"
    rows += [(100 + i, copy, "en", f"s{i}", 0) for i in range(10)] + [(200, None, "en", "s1", 0), (201, "", "en", None, 0), (202, "\n\n", "en", "s2", 0)]
    rows += [(300 + i, f"local {i}\nonly on seven sites", "en", f"s{i % 7}", 0) for i in range(30)]
    d = spark.createDataFrame(rows + rows[:1], SCHEMA).withColumn("h", F.lit(0)).repartition(3)
    got = lines.dedup_lines(d).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_removed == 1 and mark not in by[i].text and f"end {i} of" in by[i].text for i in range(40))
    assert all(by[100 + i].text == "" and by[100 + i].n_removed == 2 for i in range(10))
    for how in (None, 0.5):
        part = {r.doc_id: r.text for r in lines.dedup_lines(d, max_removed=how).collect()}
        assert all(part[100 + i] == copy for i in range(10)) and mark not in part[0]
    names = {n: F.lit(5) for n in ("own_", "bad_", "kept_", "k_", "t_", "k", "x", "r", "t", "bad", "kept", "n", "N_Lines", "n_removed", "line", "a.b")}
    odd = lines.dedup_lines(d.withColumns(names))
    assert odd.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "h", *[n for n in names if n.lower() not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r.own_, r["a.b"], r.n_lines, r.n_removed) for r in odd.collect()} == {(r.doc_id, r.text, 5, 5, r.n_lines, r.n_removed) for r in got}
    assert by[200].text is None and by[200].n_lines == 0 and by[202].text == "\n\n"
    assert all(by[300 + i].n_removed == 0 for i in range(30))
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_bpe(spark, docs, texts, vocab):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=bpe.read_ranks(vocab), special_tokens={})
    for r in bpe.bpe(docs, vocab).collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and r.decoded == t.encode()
    assert bpe.bpe(empty(spark), vocab).count() == 0


def test_bpe_odd_texts(vocab):
    import pyarrow as pa
    import tiktoken

    from mnemodex.llm.common import utf8

    ranks = bpe.read_ranks(vocab)
    enc = tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alpha = [chr(i) for i in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0x300, 0x661, 0x2167, 0x1F600, 0x10FFFF]]
    ts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["".join(r.choice("ab \n\t\x85\xa0'stlrevmd1!") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = [*bpe.Codec(ranks).encode(*utf8(pa.array(ts)))]
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in ts]
    # a rank table whose merges make lower ranks: words are then encoded alone
    odd = {bytes([i]): i + 10 for i in range(256)} | {b"abc": 1, b"bc": 500, b"ab": 400, b"aa": 3, b"aaa": 2}
    one = bpe.Codec(odd)
    other = tiktoken.Encoding("odd", pat_str=pretokens.PATTERN, mergeable_ranks=odd, special_tokens={})
    ts = ["".join(r.choice("abc") for _ in range(r.randint(0, 20))) for _ in range(500)]
    assert [x.tolist() for x in one.encode(*utf8(pa.array(ts)))] == [other.encode_ordinary(t) for t in ts]


def test_warc(spark):
    rows = [(1, "http://a/ b\n", "same"), (2, "http://c/é", "same"), (3, None, None), (4, "u", ""), (5, "v", "other"), (5, "v", "other"), (None, "w", "x"), (6, "z", "HTTP/1.1\r\n\r\nWARC/1.0" * 3), (7, "z", "same")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("sha", "again_id", "refers_to", "there", "own", "first")}).repartition(2)
    got = {(r.page_id, r.payload_bytes): r for r in warc.write_and_read(p).collect()}
    assert [got[k].record_type for k in ((1, 4), (2, 4), (7, 4), (3, 0), (4, 0), (5, 5), (None, 1))] == ["response", "revisit", "revisit", "response", "revisit", "response", "response"]
    assert got[2, 4].refers_to == 1 and got[4, 0].refers_to == 3 and got[1, 4].refers_to is None
    assert warc.write_and_read(p).count() == len(rows)
    assert warc.write_and_read(p.where("page_id < 0")).count() == 0


def test_arc_versions():
    for v in (1, 2):
        data = warc.arc_archive("n.arc", v, "20240102030405", [("http://a/", b"p\n\nq"), ("", b"")])
        recs = [*warc.arc_records(data)]
        assert [r["body"].split(b"\r\n\r\n", 1)[1] for r in recs] == [b"p\n\nq", b""]
        (head, block), = warc.warc_records(warc.to_warc(recs[0], 1))
        assert head["WARC-Date"] == "2024-01-02T03:04:05Z" and block == recs[0]["body"]
        (info, _), (again, cut) = warc.warc_records(warc.warc_info("n.warc", "20240102030405") + warc.to_warc(recs[0], 9, (1, "http://a/")))
        assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == "n.warc"
        assert again["WARC-Refers-To"] == head["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == head["WARC-Target-URI"] and again["WARC-Refers-To-Date"] == head["WARC-Date"]
        assert again["WARC-Record-ID"] != head["WARC-Record-ID"] and cut.endswith(b"\r\n\r\n") and b"X-Page" not in cut
        with pytest.raises(ValueError):
            [*warc.arc_records(data[:-3])]


def test_mixing(spark, docs, texts):
    rows = mixing.taken(docs).collect()
    source = {r[0]: r[3] for r in corpus()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode().split()) and r.taken <= 2 * r.size
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    want = brute.targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 64 * 3
    assert sorted(map(tuple, mixing.taken(docs.repartition(7)).collect())) == sorted(map(tuple, rows))
    assert mixing.taken(empty(spark)).count() == 0
    twice = mixing.taken(docs.union(docs)).collect()
    assert len(twice) == 2 * len(rows) and all(r.taken <= 2 * r.size for r in twice)


@pytest.mark.parametrize("sizes", [[10, 1, 1], [100, 3, 50, 7, 7, 2, 900], [5], [0, 4], [7, 7, 7, 7]])
def test_targets(spark, sizes):
    d = {f"s{i}": n for i, n in enumerate(sizes)}
    t = mixing.targets(spark.createDataFrame([*d.items()], "source string, source_size long"))
    assert {r.source: round(r.target, 6) for r in t.collect()} == {k: round(v, 6) for k, v in brute.targets(d).items()}


def test_mixed_documents_keep_words(spark, docs):
    spans, _ = mixing.mix(docs)
    total = spans.agg(F.sum(F.col("last") - F.col("first"))).first()[0]
    m = mixing.mixed_documents(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    assert m.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == total


def test_mixed_documents_of_repeated_rows(spark):
    rows = [(i % 7 if i % 3 else None, prose(i % 5, 150), "en", "s", 0) for i in range(40)] + [(1, prose(1, 150), "de", "s", 0)] * 3
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    total = sum(r.taken for r in mixing.taken(d).collect())
    m = mixing.mixed_documents(d, ["doc_id", "text", "lang", "source", "n_chars"]).select("lang", mixing.n_words(F.col("text")).alias("n")).collect()
    assert sum(r.n for r in m) == total > 0
    assert all(r.n <= 150 for r in m)  # a row for each document and pass takes each of its words at most once
    assert sum(r.n for r in m if r.lang == "de") <= 2 * 3 * 150


def test_packing_does_not_follow_the_cluster(spark, docs):
    d = mixing.numbered(docs)
    got = [sorted(map(tuple, mixing.pack(d, spread).select("source", "doc_id", "row", "size", "start").collect()), key=repr) for spread in (1, 8, 57, 4096)]
    assert got[0] == got[1] == got[2] == got[3] == sorted(map(tuple, mixing.pack(d).select("source", "doc_id", "row", "size", "start").collect()), key=repr)


def test_mixing_against_a_plain_loop(spark, docs):
    rows = [(r[0], r[3], r[1]) for r in corpus()] + [(500 + i, f"tiny{i}", prose(i, 3 + i)) for i in range(9)] + [(600, "none", " "), (601, "none", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for block in (64, 7):
        got = {r.doc_id: r.taken for r in mixing.taken(d, block=block).collect()}
        assert got == dict(zip([r[0] for r in rows], brute.mixed(rows, block)))


def test_small_sources_come_near_their_targets(spark):
    r = random.Random(8)
    rows = [(i, f"s{i % 500}", prose(i, r.randint(20, 60))) for i in range(500)] + [(1000 + i, "big", prose(i, 900)) for i in range(40)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).collect()
    source, taken, target = {i: s for i, s, _ in rows}, {}, {}
    for x in got:
        s = source[x.doc_id]
        taken[s], target[s] = taken.get(s, 0) + x.taken, x.target
        assert x.taken <= 2 * x["size"]
    assert len(taken) == 501 and all(abs(taken[s] - target[s]) <= max(1, 0.02 * target[s]) for s in taken)
    assert abs(sum(taken.values()) / sum(x["size"] for x in got) - 1.5) < 0.01


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        d = spark.range(n).select("id", mixing.permute(F.col("id"), F.lit(n).cast("long"), F.xxhash64(F.lit(7), F.lit("s"), F.lit(0).cast("long"))).alias("x"))
        got = [r.x for r in d.orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and got == [brute.permuted(i, n, brute.xx(7, "s", ("long", 0))) for i in range(n)]
    steps = [(b - a) % 1000 for a, b in zip(got, got[1:])]
    assert len(set(steps)) > 500  # no rotation, no constant stride


def test_shard_counts_are_multinomial(spark):
    """Counts of a source over shards vary as independent draws do, and the settled slots meet the quotas."""
    t = spark.createDataFrame([("a", 64 * 2000, 64 * 3000.0), ("b", 64 * 3000, 64 * 1000.0), ("c", 64 * 500, 64 * 1000.0)], "source string, source_size long, target double")
    q = mixing.quotas(t, 64)
    assert [(r.quota, r.lo, r.hi) for r in q.orderBy("lo").collect()] == [(3000, 0, 3000), (1000, 3000, 4000), (1000, 4000, 5000)]
    drawn = mixing.draw(q, 5000, 50, 7)
    n = [r.n for r in mixing.shard_counts(drawn).where("src = 'a'").collect()]
    assert len(n) == 100 and 0.6 < np.var(n) / (50 * 0.6 * 0.4) < 1.5
    s = mixing.settle(drawn, q, 5000, 7)
    assert {(r.src, r.n, r.d, r.hi) for r in s.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("j").alias("d"), F.max("j").alias("hi")).collect()} == {("a", 3000, 3000, 2999), ("b", 1000, 1000, 999), ("c", 1000, 1000, 999)}
    moved = s.join(drawn.select("id", F.col("src").alias("was")), "id").where("src <> was").count()
    assert s.count() == s.select("id").distinct().count() == 5000 and 0 < moved < 200


def test_embeddings_unite_only_verified_pairs(spark):
    """Vectors in a loose cloud, of cosines around 0.7, chain under coarse hashes: none may be united."""
    r = np.random.default_rng(2)
    middle = r.standard_normal(64)
    v = middle / np.linalg.norm(middle) + 0.65 * r.standard_normal((3000, 64)) / 8
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)))]
    comp = brute.groups(range(3000), link)
    assert 0.6 < np.median(u[:100] @ u[100:200].T) < 0.8
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {x.vec_id: x.component_id for x in embed.embedding_groups(df).collect()}
    sizes = np.unique([*got.values()], return_counts=True)[1]
    assert sizes.max() <= np.unique([*comp.values()], return_counts=True)[1].max()
    assert all(comp[got[i]] == comp[i] for i in range(3000))


def test_components(spark):
    from mnemodex.llm import graph

    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(30)] + [(200, 300 + i) for i in range(50)] + [(7, 7)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()}
    want = brute.groups({v for e in edges for v in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
