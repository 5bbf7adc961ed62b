"""Packing, mixing and splitting: conservation, limits, bounds."""

import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewright.llm import mixing as X, packing as K, splitting as S
from tidewright.llm.tokens import tokenizer

DOCS = "doc_id long, text string, source string, tokens int, bin string"


# ---------------------------------------------------------------- packing
def optimum(sizes, capacity):
    """The least number of containers, by trying."""
    for n in range(1, len(sizes) + 1):
        def place(i, free):
            if i == len(sizes):
                return True
            return any(free[b] >= sizes[i] and (free.__setitem__(b, free[b] - sizes[i]) or place(i + 1, free) or free.__setitem__(b, free[b] + sizes[i])) for b in range(n))
        if place(0, [capacity] * n):
            return n
    return 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bound_and_packing(sizes):
    best = optimum(sorted(sizes, reverse=True), 20)
    bins = K.best_fit_decreasing(sizes, 20)
    load = Counter()
    for b, s in zip(bins, sizes):
        load[b] += s
    assert max(load.values()) <= 20
    assert K.lower_bound(Counter(sizes), 20) <= best <= len(load)
    assert K.lower_bound(Counter(sizes), 20) >= -(-sum(sizes) // 20)


def test_dual_functions_beat_the_sum():
    assert K.lower_bound({11: 6}, 20) == 6 and K.lower_bound({7: 9}, 20) == 5 and K.lower_bound({}, 20) == 0


def settings_table(spark, rows):
    return spark.createDataFrame(rows, "setting_name string, capacity int")


def test_containers(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 5, 63, 64, 65, 130, 400] + [rng.randrange(1, 60) for _ in range(10)])) for i in range(900)] + [(5, 7), (5, 7)]
    items = K.items_of(spark.createDataFrame(sizes, "doc_id long, tokens long"), settings_table(spark, [("a", 64), ("b", 200)]))
    packed = K.materialize(K.pack(items, rounds=3, group_size=100), "packed")
    for name, cap in (("a", 64), ("b", 200)):
        rows = K.containers(packed).where(F.col("setting_name") == name).collect()
        assert all(r.used_tokens == sum(i.tokens for i in r["items"]) <= cap and r.unused_tokens == cap - r.used_tokens for r in rows)
        got = Counter((i.doc_id, i.part) for r in rows for i in r["items"])
        want = Counter((d, p) for d, n in sizes for p in range(-(-n // cap)))
        assert got == want
        by = Counter()
        for r in rows:
            for i in r["items"]:
                by[i.doc_id] += i.tokens
        assert by == Counter({d: sum(n for e, n in sizes if e == d) for d, n in sizes if n})
    for r in K.packing_report(packed).collect():
        assert r.least_containers <= r.containers <= r.least_containers * 1.05 + 1


def test_packing_nothing(spark):
    none = K.items_of(spark.createDataFrame([], "doc_id long, tokens long"), settings_table(spark, [("a", 64)]))
    assert K.containers(K.pack(none)).count() == 0
    docs = spark.createDataFrame([(1, None, "s", 1, "x"), (2, "", "s", 1, "x"), (3, " ", None, 1, "x")], DOCS)
    assert sorted((r.doc_id, r.tokens > 0) for r in K.document_sizes(docs).collect()) == [(1, False), (2, False), (3, True)]


# ---------------------------------------------------------------- mixing
TARGETS = "mix_name string, doc_source string, target_weight double, max_repeats int, tokens string"


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, None, rng.choice(["Blog", "blog ", "page", "PAGE", "faq", None, " "]), rng.choice([0, 1, 30, 50, 80, 200]), "x") for i in range(3000)]
    docs += [(5000 + i, None, "tiny", 40, "x") for i in range(20)]
    targets = [("m", "blog", 50.0, 1, "x"), ("m", "page", 30.0, 2, "x"), ("m", "tiny", 20.0, 4, "x"), ("m", "none", 7.0, 3, "x"), ("n", "FAQ", 1.0, 1, "x"), ("z", "none", 1.0, 1, "x")]
    t = spark.createDataFrame(targets, TARGETS)
    sel = X.materialize(X.mix(spark.createDataFrame(docs, DOCS), t, block_tokens=100), "selection")
    rows = sel.collect()
    uses = Counter((r.mix_name, r.doc_id) for r in rows)
    source = {d[0]: (d[2] or "").strip().lower() for d in docs}
    cap = {(m, s.lower()): k for m, s, _, k, _ in targets}
    assert all(n <= cap[m, source[d]] for (m, d), n in uses.items())
    assert len({(r.mix_name, r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    total = Counter()
    for r in rows:
        total[r.mix_name, r.doc_source] += r.tokens
    m = {s: total["m", s] / sum(v for (x, _), v in total.items() if x == "m") for s in ("blog", "page", "tiny")}
    assert abs(m["blog"] - 0.5) < 0.04 and abs(m["page"] - 0.3) < 0.04 and abs(m["tiny"] - 0.2) < 0.04
    early = [r for r in rows if r.mix_name == "m" and r.slot < 12]
    assert {r.doc_source for r in early} == {"blog", "page", "tiny"}
    rep = {(r.mix_name, r.doc_source): r for r in X.shares(sel, t).collect()}
    assert rep["m", "none"].tokens == 0 and rep["z", "none"].actual_share == 0 and rep["n", "faq"].actual_share == 1


def test_mix_nothing(spark):
    docs, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "blog", 1.0, 1, "x")], TARGETS)
    assert X.mix(docs, t).count() == 0
    assert X.mix(spark.createDataFrame([(1, "x", "blog", 5, "x")], DOCS), t.limit(0)).count() == 0
    one = X.mix(spark.createDataFrame([(1, "x", "blog", 5, "x")], DOCS), t).collect()
    assert [(r.doc_id, r.repeat_no) for r in one] == [(1, 1)]


def test_running_start(spark):
    rows = spark.createDataFrame([(g, i, i % 5 + 1) for g in ("a", "b") for i in range(200)], "g string, i int, v int").withColumn("_bucket", F.floor(F.col("i") / 30))
    got = {(r.g, r.i): r.at for r in X.running_start(rows, ["g"], ["i"], F.col("v"), "at").collect()}
    want = list(itertools.accumulate((i % 5 + 1 for i in range(200)), initial=0))
    assert all(got[g, i] == want[i] for g in ("a", "b") for i in range(200))


# ---------------------------------------------------------------- splitting
TOK = tokenizer()
PIECES = ["word", " and", ". ", "\n\n", "\n", "# Title\n", "<p>", "</p>", "{\"a\":1},", "x" * 300, "é", " ", "    ", "😀", "1234567890" * 9, "\r\n\r\n", "?!", "字" * 120, "' s"]


def check_split(text, limit, overlap):
    ps = S.Splitter(TOK).pieces(text, limit, overlap)
    if TOK.count(text) <= limit:
        assert ps == ([(0, len(text), TOK.count(text), 0)] if text else [])
        return ps
    at = 0
    for k, (a, b, n, shared) in enumerate(ps):
        assert TOK.count(text[a:b]) == n <= limit
        assert a <= at < b and (k == 0 or shared == TOK.count(text[a:at]))
        if k and overlap:
            assert overlap <= shared <= overlap + 2 * S.LONG, (shared, overlap)
        at = b
    assert at == len(text)
    return ps


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=30, max_size=250), st.sampled_from([(64, 0), (64, 16), (200, 32)]))
def test_pieces(parts, setting):
    check_split("".join(parts), *setting)


def test_natural_boundaries():
    text = "\n\n".join(f"# Part {k}\n\n" + " ".join(f"This is sentence number {j} of the part." for j in range(12)) for k in range(8))
    ps = check_split(text, 256, 32)
    assert all(text[b - 1] == "\n" or text[:b].rstrip().endswith(".") for _, b, _, _ in ps)


@pytest.mark.parametrize("text", ["", " ", "a", "x" * 20000, "字" * 3000, "\n" * 3000, "a " * 5000])
def test_odd_texts(text):
    check_split(text, 256, 32)


def test_no_room():
    with pytest.raises(ValueError):
        S.Splitter(TOK).pieces("a", 40, 32)


def test_split_table(spark):
    long = "Some words here. " * 400
    docs = spark.createDataFrame([(1, long, "s", 1, "x"), (1, long, "s", 1, "x"), (2, None, "s", 1, "x"), (3, "", "s", 1, "x"), (4, "short", "s", 1, "x")], DOCS)
    rows = S.split_documents(docs, [("p", 256, 32), ("q", 100_000, 0)]).collect()
    assert {r.doc_id for r in rows} == {1} and {r.setting_name for r in rows} == {"p"}
    assert all(r.text == long[r.start_pos - 1 : r.end_pos] for r in rows) and len(rows) == 2 * rows[0].pieces
    assert S.split_documents(docs.limit(0), [("p", 256, 32)]).count() == 0 and S.split_documents(docs, []).count() == 0


def test_certificates_and_deviations(spark):
    """Partitions add up to the packing and never lie below their bound; the deviation of a mix is that of its worst beginning."""
    import random

    from tidewright.llm import mixing, packing

    rng = random.Random(4)
    sizes = spark.createDataFrame([(i, rng.randrange(0, 230)) for i in range(900)], "doc_id long, tokens long")
    settings = spark.createDataFrame([("a", 100), ("b", 64)], "setting_name string, capacity int")
    packed = packing.materialize(packing.pack(packing.items_of(sizes, settings), group_size=200), "packed")
    rows = packing.packing_certificates(packed).collect()
    bins = {r.setting_name: r.containers for r in packing.packing_report(packed).collect()}
    assert {s: sum(r.containers for r in rows if r.setting_name == s) for s in bins} == bins
    assert all(r.containers >= r.least_containers and r.certified == (r.containers == r.least_containers) for r in rows)
    docs = spark.createDataFrame([(i, "xy"[i % 2], rng.randrange(1, 90)) for i in range(400)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "x", 3.0, 2), ("m", "y", 1.0, 2), ("m", "none", 1.0, 1)], "mix_name string, doc_source string, target_weight double, max_repeats int")
    chosen = packing.materialize(mixing.mix(docs, targets), "mixed")
    by_slot = {}
    for r in chosen.collect():
        by_slot.setdefault(r.slot, []).append((r.doc_source, r.tokens))
    total, so_far, most = sum(t for v in by_slot.values() for _, t in v), {"x": 0, "y": 0}, {"x": 0.0, "y": 0.0}
    for slot in sorted(by_slot):
        here = {s for s, _ in by_slot[slot]}
        for when in (0, 1):
            if when:
                for s, t in by_slot[slot]:
                    so_far[s] += t
            for s in here:
                most[s] = max(most[s], abs(so_far[s] - {"x": 0.75, "y": 0.25}[s] * sum(so_far.values())) / total)
    got = {r.doc_source: r.largest_deviation for r in mixing.deviations(chosen, targets).collect()}
    assert got == {s: round(v, 6) for s, v in most.items()}
