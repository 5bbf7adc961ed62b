"""New mentions against accepted ones: pieces of the rule, and the whole against brute force."""

import random
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidewright.llm import mentions as M

SCHEMA = "citation_id long, ingest_batch int, source_url string, title string, mention_context string, id long, t string, chunks int"


def test_page_key():
    same = [
        "https://www.Site.example/a%2Db/c/?id=7&x=1#top", "http://site.example/a-b/c?x=1&id=7&utm_source=f&fbclid=2", "HTTPS://SITE.EXAMPLE:443/a-b/c?id=7&ref=share&x=1",
        "https://m.site.example/a-b//c/?x=1&id=7", " https://old.site.example/a-b/c?id=7&x=1#:~:text=see ",
    ]
    assert len({M.page_key(u) for u in same}) == 1
    other = ["https://site.example/a-b/d?id=7&x=1", "https://site.example/a-b/c?id=8&x=1", "https://site.example/A-b/c?id=7&x=1", "https://site.example:8080/a-b/c?id=7&x=1", "https://sub.site.example/a-b/c?id=7&x=1"]
    assert len({M.page_key(u) for u in [same[0], *other]}) == 6
    assert M.page_key(None) is None and M.page_key("  ") is None


def test_title_key():
    for t in ("How do you sort it?", "Re: how do you sort it", "[Crosspost] How do you SORT it", "(repost) How do you sort it!", "How do you sort it | Tarnyard", "Re: Re: how do you sort it "):
        assert M.title_key(t) == "how do you sort it", t
    assert M.title_key("Regular thread no. 5") != M.title_key("Regular thread no. 6")
    assert M.title_key(None) == "" and M.title_key("?!") == "" and M.title_key("[only]") == "only"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_words_in_order(a, b):
    assert M.in_order(a, b) == plain_lcs(a, b)


def ends(data, grain):
    return M.cut(np.frombuffer(data, dtype=np.uint8), np.array([0]), *grain).tolist()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.sampled_from([g[2:] for g in M.GRAINS]))
def test_chunks_cover_the_text(data, grain):
    found = ends(data, grain)
    assert found == sorted(set(found)) and found[-1] == len(data)
    # What follows a cut does not depend on what stands before the window.
    again = ends(b"some other beginning" + data, grain)
    assert {e + 20 for e in found if e >= grain[1]} <= set(again)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab cé", min_size=1, max_size=60), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=8))
def test_chunks_do_not_depend_on_what_is_cut_with_them(texts):
    """A text has the same chunks alone and among others; equal pieces have equal hashes under equal salts only."""
    data, salts, words = [t.encode() for t, _ in texts], [s for _, s in texts], [20] * len(texts)
    hashes, sizes, least = M.chunked(data, salts, words)
    for i in range(len(texts)):
        alone = M.chunked(data[i : i + 1], salts[i : i + 1], words[:1])
        assert alone[0][0].tolist() == hashes[i].tolist() and alone[1][0].tolist() == sizes[i].tolist() and alone[2][0] == least[i]
        other = M.chunked(data[i : i + 1], [salts[i] ^ 1], words[:1])
        assert not set(other[0][0].tolist()) & set(hashes[i].tolist())
        pieces = {data[i][a:b] for a, b in zip([0, *ends(data[i], (4, 2))], ends(data[i], (4, 2)))}
        assert len(hashes[i]) == len(pieces) and least[i] == sum(map(len, pieces))


def test_coverage_at_the_limit_of_the_rule():
    """Where every fifth word, at random, is another one, coverage nominates the pair, whatever the length."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(3000)]
    for n in (5, 6, 8, 9, 12, 16, 20, 32, 33, 40, 64, 80, 300):
        for _ in range(60):
            a = [rng.choice(words) for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), n // 5):
                b[i] = rng.choice(words)
            b += [rng.choice(words) for _ in range(rng.choice([0, n // 2, n]))]
            assert M.repeats(a, b)
            hashes, sizes, least = M.chunked([" ".join(x).encode() for x in (a, b)], [7, 7], [len(a), len(b)])
            other = set(hashes[1].tolist())
            assert sum(s for h, s in zip(hashes[0].tolist(), sizes[0].tolist()) if h in other) >= M.COVERAGE * min(least), n


def brute(rows):
    pages, texts, out = {}, [], []
    first = min((b or 0 for _, b, *_ in rows), default=0)
    for i, b, u, t, c in sorted(rows, key=lambda r: (r[1] or 0, r[0])):
        p, k, w = M.page_key(u), M.title_key(t), M.plain_words(c)
        hits = ([pages[p]] if p in pages else []) + [j for j, kk, ww in texts if k and kk == k and w and M.repeats(ww, w)]
        if (b or 0) > first and hits:
            out.append((min(hits), i))
            continue
        if p:
            pages.setdefault(p, i)
        if k and w:
            texts.append((i, k, w))
    return sorted(out)


def made(seed, n, hot=True):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        b = rng.choice([None, 0]) if i < n // 2 else 1 + 3 * (2 * i - n) // n  # arrival and ids rise together
        k = 0 if hot and rng.random() < 0.35 else rng.randrange(12)
        words = list(bases[k])
        for _ in range(rng.choice([0, 0, 1, 3, 8, 40])):
            j = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[j] = rng.choice(vocabulary)
            else:
                words.insert(j, rng.choice(vocabulary))
        title = rng.choice([f"Title number {k}", f"[Tag] title NUMBER {k}", f"Title number {k} | Site", None, "", "Title number 99"])
        text = rng.choice([" ".join(words), " ".join(words).upper(), "<p>" + ", ".join(words) + ".</p>", None, "", " ".join(words[: len(words) // 2])])
        url = rng.choice([None, "", f"https://s.example/p/{rng.randrange(60)}", f"http://www.s.example/p/{rng.randrange(60)}/?utm_source=x", f"https://s.example/view?id={i}"])
        rows.append((i, b, url, title, text))
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in M.repeated_mentions(df).select("citation_id_a", "citation_id_b").collect())


def test_against_brute_force(spark):
    rows = made(11, 350)
    want = brute(rows)
    assert len(want) > 50
    assert found(spark, rows) == want


def test_copies_in_one_batch(spark):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(1, 0, None, "Old", "one two three"), *[(i, 1, None, "T", text) for i in range(10, 60)], (70, 2, "https://a.example/", None, None), (71, 2, "http://a.example", "T", text)]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 50


def test_long_text_and_chain(spark):
    long = [f"v{k % 997}" for k in range(6000)]
    near = [w if k % 9 else "changed" for k, w in enumerate(long)]
    far = [w if k % 9 else "changed" if k % 2 else "again" for k, w in enumerate(near)]
    rows = [(1, 0, None, "L", " ".join(long)), (2, 1, None, "L", " ".join(near)), (3, 1, None, "L", " ".join(far)), (4, 2, None, "L", "short one")]
    assert found(spark, rows) == brute(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, None, None, None), (2, 1, None, None, None), (3, 1, "", "", "")]) == []


def test_batch_taken_once(spark):
    rows = made(4, 60)
    df = M.prepare(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    store = M.AcceptedMentions(spark)
    store.ingest(df, "one", history=True)
    n = store.keys().count()
    assert store.ingest(df, "one").count() == 0 and store.keys().count() == n
    again = M.AcceptedMentions(spark, root=store.root)
    assert again.texts().count() == store.texts().count() and again.keys().count() == n


def test_heavy_chunks(spark, monkeypatch):
    """With every chunk of more than three texts heavy, and most texts under one title, nothing is lost on texts that differ."""
    monkeypatch.setattr(M, "HEAVY", 3)
    rng = random.Random(8)
    phrases = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(8)) for _ in range(12)]
    rows = []
    for i in range(160):
        words = " ".join(rng.choice(phrases) for _ in range(4)).split() + [f"u{rng.randrange(40)}x{j}" for j in range(20)]
        rows.append((i, i // 40, None, "Hot" if i % 3 else f"Title {i % 7}", " ".join(words)))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + i, 3, None, rows[-1][3], " ".join(words)))
    rows.sort(key=lambda r: (r[1], r[0]))
    assert found(spark, rows) == brute(rows)


def test_heavy_chunks_hide_no_earlier_citation(spark):
    """The first text with the chunks of an article holds it but is too long to be repeated; two of the later versions also repeat each other."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    article, rest, aside = ([word() for _ in range(n)] for n in (80, 120, 9))
    rows = [(1, 0, None, "Hot", " ".join(article + rest)), (2, 0, None, "Hot", " ".join(article))]
    for i in range(70):
        words = list(article)
        words[40:40] = aside if i in (20, 50) else [word()]
        words.append(word())  # else the end of the text would be a chunk that the first does not have
        rows.append((10 + i, 1, None, "Hot", " ".join(words)))
    assert len(brute(rows)) == 70
    assert found(spark, rows) == brute(rows)


def test_heavy_chunks_of_small_part(spark, monkeypatch):
    """Blocks compare texts of which heavy chunks are a small part, also those of one batch that repeat nothing stored."""
    monkeypatch.setattr(M, "HEAVY", 4)
    monkeypatch.setattr(M, "BLOCK", 7, raising=False)
    rng = random.Random(5)
    stock, rows = [f"stock{k}" for k in range(6)], []
    for i in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(50)] + stock
        rows.append((i, i % 3, None, "Hot", " ".join(words)))
        for j in range(2):  # every sixth word is another one, so that few chunks are left
            changed = [w if k % 6 else f"c{rng.randrange(10**6)}" for k, w in enumerate(words)]
            rows.append((1000 + 2 * i + j, i % 3 + j, None, "Hot", " ".join(changed)))
    assert len(brute(rows)) > 60
    assert found(spark, rows) == brute(rows)


def test_title_with_a_short_tail(spark):
    """Contexts that are a title and a word or two repeat each other by the rule."""
    title = " ".join(f"{c}{k}word" for k, c in enumerate("abcdefghijklmnopqrstuvwxyzabcd"))
    texts = [title, *[f"{title} {tail}" for tail in ("foo bar", "baz", "Site", "edit typo")], f"{title} " + " ".join(f"rest{k}" for k in range(28))]
    rows = [(i, i, None, title, t) for i, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows) == [(0, i) for i in range(1, 6)]


@pytest.mark.parametrize("heavy,later", [(3, (200,)), (64, (200,)), (3, (200, 201)), (16, (200, 201)), (64, (201, 200))])
def test_what_a_batch_holds_besides_changes_nothing(spark, monkeypatch, heavy, later):
    """Seventy long texts hold the forty words of a short one; both later texts repeat the short one, whatever else is in their batch."""
    monkeypatch.setattr(M, "HEAVY", heavy)
    word = lambda k: f"{'abcdefgh'[k % 8]}{k * 7919 % 10007}"
    core = [word(k) for k in range(40)]
    rows = [(i, 0, None, "Hot", " ".join([word(1000 * i + k) for k in range(60)] + core + [word(1000 * i + 500 + k) for k in range(60)])) for i in range(1, 71)]
    rows.append((100, 0, None, "Hot", " ".join(core)))
    own = [word(90_000 + k) for k in range(9)]
    text = {200: own[:5] + core + own[5:], 201: own[:5] + core + own[5:8] + ["changed"]}
    rows += [(i, 1, None, "Hot", " ".join(text[i])) for i in later]
    assert found(spark, rows) == brute(rows) == sorted((100, i) for i in later)


@pytest.mark.parametrize("heavy", [3, 16, 64])
def test_one_by_one_or_at_once(spark, monkeypatch, heavy):
    """The result does not depend on how the arrivals are cut into batches, as batches only tell when a row is decided."""
    monkeypatch.setattr(M, "HEAVY", heavy)
    rows = [(i, 0 if i < 40 else 1, None, "Hot title", t) for i, _, _, _, t in made(23, 90) if t]
    want = brute(rows)
    assert len(want) > 10 and found(spark, rows) == want
    if heavy == 16:
        split = [(i, 0 if b == 0 else i, u, t, c) for i, b, u, t, c in rows if i < 44]
        assert found(spark, split) == [p for p in want if p[1] < 44]


def test_store_opens_in_another_application(spark, tmp_path):
    """One process takes in history and a batch; another finds, appends, merges the runs and removes what no longer counts."""
    rows = made(31, 60)
    code = """
import sys
sys.path[:0] = %r
import tests.llm.test_mentions as t
from pyspark.sql import SparkSession
from tidewright.llm import mentions as M
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.checkpoint.dir", "file://%s/scratch").getOrCreate())
store, rows = M.AcceptedMentions(spark, "file://%s/store"), t.made(31, 60)
for k in (0, 1):
    store.ingest(M.prepare(spark.createDataFrame([(*r, 1, "x", 2) for r in rows if (r[1] or 0) == k], t.SCHEMA)), f"b{k}", history=k == 0)
""" % (sys.path[:6], tmp_path, tmp_path)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    store = M.AcceptedMentions(spark, f"file://{tmp_path}/store")
    frame = lambda k: M.prepare(spark.createDataFrame([(*r, 1, "x", 2) for r in rows if (r[1] or 0) == k], SCHEMA))
    assert store.ingest(frame(1), "b1").count() == 0
    got = [tuple(r) for k in (2, 3) for r in store.ingest(frame(k), f"b{k}").collect()]
    late = {r[0] for r in rows if (r[1] or 0) > 1}
    assert sorted(got) == [p for p in brute(rows) if p[1] in late] and got
    before = (store.keys().count(), store.texts().count())
    store.compact(every=True)
    store.vacuum()
    assert (store.keys().count(), store.texts().count()) == before and len(store.manifest.read()[1]["runs"]) == 1


def test_null_and_repeated_ids(spark):
    rows = [(1, 0, None, "T", "one two three four five"), (2, 1, None, "T", "one two three four five"), (2, 1, None, "T", "one two three four five"), (None, 1, None, "T", "one two three four five")]
    assert found(spark, rows) == [(1, 2)]
