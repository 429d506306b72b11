"""Invariants of recall: filters prefer, scope and supersession exclude."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemodex.functions import constants as C
from mnemodex.functions import text as T
from mnemodex.operators import listing, logs, retrieval, storage, transcripts


@pytest.fixture(scope="module")
def parts(spark):
    n = 60
    v = spark.createDataFrame([(i, [1.0 - i / 100, (i * 7 % 11) / 50.0]) for i in range(n)], "id long, vector array<float>")
    t = spark.createDataFrame([(i, f"apple pear {'plum ' * (i % 5)} note {i}") for i in range(n)] + [(n, "the and for")], "id long, text string")
    m = spark.createDataFrame([(i, "session" if i % 3 == 0 else "memory", C.TYPES[i % 6], [f"t{i % 4}", "all"], i - 1 if i % 10 == 9 else None) for i in range(n - 5)], "id long, kind string, type string, tags array<string>, supersedes long")
    return v, t, m


def ask(**how):
    return retrieval.Request([1.0, 0.1], "plum apple", candidates=20, **how)


def ids(df):
    return [r.id for r in df.collect()]


def test_filters_never_change_the_number_of_results(parts):
    for how in ({}, {"tags": ["nowhere"]}, {"tags": ["t1", "t1"]}, {"types": ["fact"]}, {"tags": ["all"], "types": ["doc"]}):
        assert len(ids(retrieval.recall(*parts, ask(**how)))) == 5


def test_scope_of_every_kind_hides_only_what_has_no_metadata(parts):
    a = ids(retrieval.recall(*parts, ask(limit=20, kinds=["memory", "session"])))
    assert a and all(i < 55 for i in a)


def test_scope_before_draw(parts):
    v, _, m = parts
    got = ids(retrieval.dense_topk_scoped(v, m, [1.0, 0.1], 15, ["session"]))
    assert len(got) == 15 and all(i % 3 == 0 for i in got)


def test_superseded_come_back_with_their_replacement_gone(parts):
    v, t, m = parts
    shown = ids(retrieval.recall(v, t, m, ask(limit=20)))
    assert 8 not in shown
    assert 8 in ids(retrieval.recall(v, t, m.where("id <> 9"), ask(limit=20)))


def test_no_lexical_pass_and_empty_queries(parts):
    v, t, m = parts
    assert not any(r.lexical for r in retrieval.recall(v, t, m, ask(lexical_weight=-1)).collect())
    assert retrieval.bm25_topk(t, T.analyze("the and a"), 5).count() == 0
    assert retrieval.dense_topk(v, [1.0, 0.0], 0).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        retrieval.dense_topk(v, [1.0, 0.0, 0.0], 5).collect()


def test_pages_join_to_the_longer_list(parts):
    a, b, whole = (ids(retrieval.recall(*parts, ask(limit=n, offset=o))) for n, o in ((5, 0), (5, 5), (10, 0)))
    assert a + b == whole


def test_repeated_query_terms_count_twice(parts):
    t = parts[1]
    one, two = ({r.id: r.score for r in retrieval.bm25_scores(t, q).collect()} for q in (["plum"], ["plum", "plum"]))
    assert all(abs(two[k] - 2 * one[k]) < 1e-5 for k in one)


def test_neighbours(parts, spark):
    v = parts[0]
    got = retrieval.neighbours(v.where("id < 3"), v, 4).collect()
    assert len(got) == 12 and all(r.id != r.neighbour for r in got)
    raw = {r.id: r.vector for r in v.collect()}
    for q in range(3):
        best = sorted(((round(sum(a * b for a, b in zip(raw[q], raw[o])), 6), -o) for o in raw if o != q), reverse=True)[:4]
        assert [(r.similarity, -r.neighbour) for r in sorted((x for x in got if x.id == q), key=lambda x: x.rank)] == best


def test_byte_length_rule_and_marks():
    assert T.analyze("é a I’d 42 7 naïve") == ["é", "42", "naïve"]


def test_snippets_and_spans(spark):
    d = spark.createDataFrame([("word " * 100,), ("é" * 400,), ("short",), ("x" * 321,)], "t string")
    got = [r.s for r in d.select(T.snippet(F.col("t")).alias("s")).collect()]
    assert [g.truncated for g in got] == [True, True, False, True]
    assert all(len(g.text.encode()) <= 323 for g in got) and got[0].text.endswith("word…") and got[1].text == "é" * 160 + "…"
    s = spark.createDataFrame([("a..b",), (" a ",), ("a..",)], "t string").select(T.parse_span(F.col("t")).alias("s")).collect()
    assert [tuple(r.s) for r in s] == [("a", "b"), ("a", "a"), ("a", "a")]


def test_uri(spark):
    good = "0" * 31 + "A"
    d = spark.createDataFrame([(f"mnemodex://session/{good}/transcript",), (f"mnemodex://memory/{good}/transcript",), ("other://memory/1",), (f"mnemodex://memory/{good}",)], "t string")
    got = [r.u for r in d.select(T.parse_uri(F.col("t")).alias("u")).collect()]
    assert tuple(got[0]) == ("session", good.lower(), True) and got[1] is None and got[2] is None and tuple(got[3]) == ("memory", good.lower(), False)


def test_cursor():
    assert listing.decode_cursor(listing.encode_cursor("2024", "x")) == ("2024", "x")
    with pytest.raises(ValueError):
        listing.decode_cursor("YWJj")


def test_keyset_walk_sees_everything_once(spark):
    rows = [(i, "memory", "fact", None, None if i % 7 == 3 else (i * 13) % 20) for i in range(50)]
    r = spark.createDataFrame(rows, "id long, kind string, type string, supersedes long, created_at long")
    tags = spark.createDataFrame([], "id long, tag string")
    seen, after = [], None
    while True:
        page = listing.list_records(r, tags, after=after, page=9).collect()
        seen += [(x.created_at, x.id) for x in page]
        if not page or not page[0].more:
            break
        after = seen[-1]
    assert seen == sorted([(x[4], x[0]) for x in rows], key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))


def test_rejected_writes_do_not_advance(spark):
    w = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 5), (1, 5, 2), (2, 1, 1), (2, 2, 0)], "id long, seq long, expect long")
    got = {(r.id, r.seq): (r.accepted, r.version) for r in logs.head_cas(w, "id", "seq", "expect").collect()}
    assert got == {(1, 1): (True, 1), (1, 2): (False, 1), (1, 3): (True, 2), (1, 4): (False, 2), (1, 5): (True, 3), (2, 1): (False, 0), (2, 2): (True, 1)}


def test_oversize_message_has_its_own_chunk(spark):
    t = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 50, 1, 9])], "session string, pos long, bytes long")
    assert [r.chunk for r in transcripts.chunk_numbers(t, target=10).orderBy("pos").collect()] == [0, 0, 1, 2, 2]


def test_occupancy_and_compaction():
    with pytest.raises(ValueError):
        storage.check_occupancy(3, 0)
    storage.check_occupancy(3, 0, forced=True)
    assert logs.due_for_compaction(70_000, 100_000) and not logs.due_for_compaction(60_000, 0) and not logs.due_for_compaction(70_000, 400_000)


def test_withdraw_all_or_none(spark):
    q = spark.createDataFrame([("a", None), ("b", "2024-01-01 00:00:00"), ("c", None)], "record_id string, claimed_at string").withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    ids_ = spark.createDataFrame([("a",), ("b",)], "record_id string")
    assert storage.withdraw_all(q, ids_, "2024-01-01 00:05:00").count() == 3
    assert storage.withdraw_all(q, ids_, "2024-01-01 01:00:00").count() == 1


def test_arguments():
    assert retrieval.parse_scope(None) == [] and retrieval.parse_scope([" session", "memory"]) == ["session", "memory"] and retrieval.parse_types([" fact "]) == ["fact"]
    refused = [lambda x=x: retrieval.parse_scope([x]) for x in ("x", "all", "ALL", "Memory", "memories", "sessions", "")] + [lambda x=x: retrieval.parse_types([x]) for x in ("x", "Fact", "")]
    for bad in (*refused, lambda: retrieval.decode_rank_cursor("r1:5:AAAAAAAA", "q")):
        with pytest.raises(ValueError):
            bad()
    assert retrieval.decode_rank_cursor(retrieval.encode_rank_cursor("q", 15), "q") == 15


def test_words_behind_a_resume():
    id_, read = "0123456789abcdef" * 2, retrieval.read_resume
    for words, want in {
        (): ("", "", 30), ("recent",): ("recent", "", 30), ("RECENT", "7"): ("recent", "", 7), ("recent", "", "+7"): ("recent", "", 7), (id_.upper(), "", "100"): ("id", id_, 100), (f"mnemodex://session/{id_}", "3"): ("address", id_, 3),
        ("plan", "the", "trip"): ("topic", "plan the trip", 30), ("plan", "2024"): ("topic", "plan 2024", 30), ("plan", "the", "5"): ("topic", "plan the", 5), ("", "harbour survey"): ("topic", "harbour survey", 30), ("", "", "9"): ("", "", 9),
    }.items():
        assert read(*words) == want, words
    for words in [("recent", "foo"), ("recent", "0"), (id_, "more"), (id_, "3", "4"), (id_, "", "0"), (id_, "", "101"), (id_, "", "-1"), (f"mnemodex://memory/{id_}",), ("mnemodex://session/ab",), ("plan", "the", "0"), ("", "", "words"), ("", "harbour", "survey")]:
        with pytest.raises(ValueError):
            read(*words)


def test_hints_and_advice(spark):
    n, yes, no = F.lit, F.lit(True), F.lit(False)
    row = spark.range(1).select(
        listing.browse_hint(n(0), yes, yes, n(3)).alias("a"), listing.browse_hint(n(0), yes, no, n(3)).alias("b"), listing.write_advice(n(2), n(1), n(1)).alias("c"), listing.browse_hint(n(0), yes, yes, n(0)).alias("f"), listing.browse_hint(n(0), yes, yes, n(3), yes).alias("g"),
        listing.browse_hint(n(0), no, no, n(0), missing=n(4)).alias("h"), retrieval.recall_hint(n(0), n(0), n(4), n(0), n(1)).alias("d"), retrieval.recall_hint(n(2), n(0), n(4), n(9), n(1)).alias("e"), retrieval.recall_hint(n(2), n(0), n(0), n(9), n(1)).alias("i"),
        retrieval.recall_hint(n(0), n(0), n(0), n(0), n(5)).alias("j"), retrieval.recall_hint(n(0), n(5), n(4), n(0), n(5), n(2)).alias("k"),
    ).first()
    assert "replaced" in row.a and row.b == "the filters select nothing" and row.c == "2 near duplicates; every tag is common" and row.f == row.g == "the listing ends here" and "restored" in row.h
    assert "scope" in row.d and row.e == "the scope removed candidates: 4" and row.i == "" and row.j == "nothing to search" and row.k == "nothing ranks past this cursor; not restored: 2"


def test_claims_keep_their_owner(spark):
    q = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", "other"), (2, "b", None, None), (3, "c", "2024-01-01 00:00:00", "me")], "seq long, record_id string, claimed_at string, claimed_by string").withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    marked = storage.mark_claims(q, q.where("seq = 2"), "2024-01-02 00:00:00", "me")
    assert {r.seq: r.claimed_by for r in marked.collect()} == {1: "other", 2: "me", 3: "me"}
    free = storage.release_claims(marked, q.where("seq = 3"))
    assert {r.seq: (r.claimed_at is None, r.claimed_by) for r in free.collect()} == {1: (False, "other"), 2: (False, "me"), 3: (True, None)}


def test_clipped_titles(spark):
    def plain(title, limit):  # the rule, in a plain loop
        t = " ".join(title.split())
        if len(t) <= limit:
            return t
        cut = limit - 1
        while cut > limit // 2 and t[cut] != " ":
            cut -= 1
        if t[cut] != " ":
            cut = limit - 1
        return t[:cut].strip() + "…"

    import random

    r = random.Random(4)
    texts = ["".join(r.choice("ab \n😀") for _ in range(r.randrange(40))) for _ in range(300)] + ["", " ", "a" * 30]
    for width in (5, 10, 20):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clip_title(F.col("t"), width).alias("c")).orderBy("i").collect()
        assert [x.c for x in got] == [plain(t, width) for t in texts]


def test_hashing_embedder(spark):
    d = spark.createDataFrame([("apple pear",), ("pear apple",), ("",)], "t string")
    v = [r.v for r in d.select(retrieval.hashing_embedder(32)(F.col("t")).alias("v")).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[2])


def go_snippet(text, limit=320):
    """The rule by bytes, plainly."""
    b = text.strip().encode()
    if len(b) <= limit:
        return b.decode(), False
    cut = limit
    while cut > 0 and b[cut : cut + 1] not in (b" ", b"\n", b"\t"):
        cut -= 1
    if cut < limit // 2:
        cut = limit
        while cut > 0 and b[cut] & 0xC0 == 0x80:
            cut -= 1
    return b[:cut].decode().strip() + "…", True


def test_snippet_by_the_byte_rule(spark):
    import random

    r = random.Random(3)
    texts = ["a" * 200 + " " + "b" * 119 + " c", "a" * 320 + " b", "a" * 319 + "é" + " tail", "  " + "x" * 400, "x" * 159 + " " + "y" * 400, "x" * 160 + " " + "y" * 400, "é " * 200, "\n\t spaced \n" + "w " * 300]
    texts += ["".join(r.choice(["a", "é", "😀", " ", "\n", "word"]) for _ in range(r.randint(90, 400))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.snippet(F.col("t")).alias("s")).collect()
    assert [(r.s.text, r.s.truncated) for r in got] == [go_snippet(r.t) for r in got]


def test_equal_vectors_tie_by_id(spark):
    import random

    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(33)] for _ in range(4)]
    v = spark.createDataFrame([(i, base[i % 4]) for i in range(203)], "id long, vector array<double>").repartition(5)
    got = retrieval.neighbours(v.where("id in (0, 101)"), v, 60).collect()
    for q in (0, 101):
        ids = [x.neighbour for x in sorted((x for x in got if x.id == q), key=lambda x: x.rank)]
        assert ids[: len([i for i in range(q % 4, 203, 4) if i != q])][:40] == [i for i in range(q % 4, 203, 4) if i != q][:40]


def test_wrong_width_is_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="dimensions"):
        retrieval.dense_topk(v, [1.0], 3).collect()


def test_stored_index_scores_alike(parts):
    t = parts[1]
    for q in (["plum"], ["plum", "plum", "tree"], ["absent"]):
        a = {r.id: round(r.score, 9) for r in retrieval.bm25_scores(t, q).collect()}
        assert a == {r.id: round(r.score, 9) for r in retrieval.bm25_indexed(*retrieval.postings(t), q).collect()}


def test_gold_by_labels_is_counted_in_parts(spark):
    """Labels of any share, ties, a vector of no label and a query alone with its own: as a plain loop counts them, and as stated pairs give."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)).round(1).astype(np.float32)
    v[200:240] = v[0]
    labels = [None if i % 29 == 3 else 99 if i == 50 else int(i % 7 > 4) for i in range(300)]
    vectors = spark.createDataFrame([(i, x.tolist(), l) for i, (x, l) in enumerate(zip(v, labels))], "id long, vector array<float>, label int")
    queries = vectors.where("id % 10 = 0 or id = 3")
    want = {}
    for q in [*range(0, 300, 10), 3]:
        sims = retrieval._exact(v[q].astype(float), v.astype(float))
        gold = [i for i in range(300) if i != q and labels[i] is not None and labels[i] == labels[q]]
        best = min(((-sims[i], i) for i in gold), default=None)
        middle = sorted(sims[i] for i in gold)[len(gold) // 2] if gold else None
        others = [i for i in range(300) if i != q and i not in gold and labels[i] is not None]
        want[q] = (1 + sum((-sims[i], i) < best for i in range(300) if i != q), sum(sims[i] >= middle for i in others)) if gold else (None, None)
    got = {r.query_id: (r["rank"], r.density) for r in retrieval.gold_standing(queries, vectors).collect()}
    assert got == want and want[50] == (None, None)
    known = vectors.where("label is not null")
    pairs = queries.select(F.col("id").alias("query_id"), "label").join(known.select("id", "label"), "label").select("query_id", "id")
    stated = retrieval.gold_standing(queries.select("id", "vector"), known.select("id", "vector"), pairs)
    assert {r.query_id: r.density for r in stated.collect()} == {q: d for q, (_, d) in want.items()}


def test_bracket_holds_the_value_at_a_place():
    rng = np.random.default_rng(6)
    for _ in range(200):
        parts = [np.sort(rng.integers(0, 50, rng.integers(1, 900)).astype(float)) for _ in range(rng.integers(1, 5))]
        every = np.sort(np.concatenate(parts))
        place = int(rng.integers(0, len(every)))
        lo, hi = retrieval._bracket(place, [len(p) for p in parts], [p[retrieval._places(len(p))].tolist() for p in parts])
        assert lo <= every[place] <= hi
