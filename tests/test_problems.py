"""Messages, sessions and change feeds against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidewright.operators import changefeed, messages, sessions

T0 = dt.datetime(2020, 1, 1)
EVENTS = "delivery_id long, ingest_batch int, event_id string, event_ts timestamp, client_id string, _key string, _row string"


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def events(spark, rows):
    return spark.createDataFrame([(d, b, e, at(s), c, "x", "y") for d, b, e, s, c in rows], EVENTS)


def drops(rows):
    best = {}
    for d, _, e, s, _ in rows:
        if e is None:
            continue
        k, o = e.strip(" \t\r\n\xa0").lower(), (s is None, s or 0, d)
        best[k] = min(best.get(k, o), o)
    keep = {o[2] for o in best.values()}
    return sorted(d for d, _, e, _, _ in rows if e is not None and d not in keep)


CASES = [
    (1, 0, "A", 10, "c"), (2, 0, "a ", 10, "c"), (3, 1, " A\t", 5, "c"), (4, 1, None, 1, "c"), (5, 2, None, 1, "c"), (6, 2, "b", None, "c"),
    (7, 3, "B", None, None), (8, 3, "b", 99, " C "), (9, None, "d", 4, ""), (10, 3, "", 1, "c"), (11, 3, "  ", 0, "c"), (12, 1, "z" * 5000, 3, "c"), (13, 2, "Z" * 5000, 2, "c"),
]


@pytest.mark.parametrize("runs", [1, 3])
def test_repeated_deliveries(spark, runs):
    got = sorted(r[0] for r in messages.repeated_deliveries(events(spark, CASES), runs).collect())
    assert got == drops(CASES)


def test_repeated_deliveries_random(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 1, 2, 5]), rng.choice([None, "hot", "Hot ", "hot", "x", "Y", "y"] + [f"e{k}" for k in range(30)]), rng.choice([None, *range(20)]), "c") for i in range(400)]
    assert sorted(r[0] for r in messages.repeated_deliveries(events(spark, rows), 4).collect()) == drops(rows)


def test_messages_empty_and_idempotent(spark):
    empty = events(spark, [])
    assert messages.repeated_deliveries(empty).count() == 0
    store = messages.MessageStore(spark, ["_key", "_row"])
    store.upsert(events(spark, CASES), "one")
    before = sorted(map(str, store.messages().collect()))
    store.upsert(events(spark, CASES), "one")
    store.upsert(events(spark, CASES), "the same rows in another batch")
    store.compact()
    assert sorted(map(str, store.runs().select("_key", "_ts", "_id", "_row").collect())) == before
    again = messages.MessageStore(spark, ["_key", "_row"], root=store.root)
    assert again.runs().count() == len(before)


def plain_sessions(rows, gap):
    by = {}
    for c, s in rows:
        if c is not None and c.strip() and s is not None:
            by.setdefault(c.strip().lower(), []).append(s * 1_000_000)
    out = []
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    for c, ts in by.items():
        ts = sorted(t + base for t in ts)
        start = last = ts[0]
        n = 0
        for t in ts:
            if t - last > gap:
                out.append((c, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((c, start, last, n))
    return sorted(out)


def session_rows(spark, rows):
    return spark.createDataFrame([(c, at(s), 1) for c, s in rows], "client_id string, event_ts timestamp, start_us int")


def test_sessions_in_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "A ", "b", "hot", "hot", "hot", None, " "]), rng.choice([None] + [rng.randrange(0, 400_000) for _ in range(40)])) for _ in range(600)]
    rows += [("edge", 0), ("edge", 1800), ("edge", 3601), ("bridge", 0), ("bridge", 3000)]
    late = [("bridge", 1500), ("edge", 90_000), ("hot", 86_399), ("hot", 86_401)]
    table = sessions.SessionTable(spark)
    for k, part in enumerate((rows[:200], rows[200:], [], late)):
        table.upsert(session_rows(spark, part), f"b{k}")
    table.upsert(session_rows(spark, late), "b3")
    assert sorted(tuple(r) for r in table.sessions().select(*sessions.COLUMNS).collect()) == plain_sessions(rows + late, sessions.GAP_US)


def test_sessions_of_nothing(spark):
    assert sessions.sessions_of_messages(events(spark, [])).count() == 0
    assert sessions.local_sessions(session_rows(spark, [(None, 1), ("a", None)])).count() == 0


FEED = "feed_seq long, received_at timestamp, platform string, content_id string, event string, last_modified timestamp, content string, us string, kind int, _seq string"


def feed(spark, rows):
    return spark.createDataFrame([(q, at(r), p, c, e, at(m), f"text {q}", "x", 1, "y") for q, r, p, c, e, m in rows], FEED)


def kind(e):
    w = (e or "").strip().lower().replace("_", ".").split(".")[-1]
    return {"unpublish": "u", "unpublished": "u", "trashed": "u", "publish": "p", "published": "p", "delete": "d", "deleted": "d", "create": "c", "created": "c"}.get(w, "x")


def plain_table(rows):
    seen, state = set(), {}
    order = []
    for q, r, p, c, e, m in sorted(rows, key=lambda x: x[0]):
        if c is None or not c.strip():
            continue
        t = m if m is not None else r
        k = (p, c.strip(), t, kind(e))
        if k not in seen:
            seen.add(k)
            order.append((-1e18 if t is None else t, q, (p, c.strip()), kind(e)))
    for t, q, key, k in sorted(order, key=lambda x: x[:2]):
        state[key] = None if k == "d" else q
    return sorted((str(k[0]), k[1], q) for k, q in state.items() if q is not None)


WORDINGS = ["content.created", " CONTENT.UPDATED ", "Entry.publish", "Entry.unpublish", "post_trashed", "delete", "content.deleted", "Entry.save", None, "", "create"]


def feed_rows(seed, n=500):
    rng = random.Random(seed)
    return [(i, rng.choice([None, rng.randrange(50)]), rng.choice(["wp", "wp", None]), rng.choice(["hot", " hot ", "hot", None, "", "  "] + [f"c{k}" for k in range(20)]),
             rng.choice(WORDINGS), rng.choice([None, rng.randrange(50)])) for i in range(n)]


@pytest.mark.parametrize("batches", [1, 4])
def test_changes(spark, batches):
    rows = feed_rows(7)
    got = sorted((str(r.platform), r.content_id, r.feed_seq) for r in changefeed.apply_changes(None, feed(spark, rows), batches).collect())
    assert got == plain_table(rows)


def test_changes_on_a_base(spark):
    first, later = feed_rows(1), [(q + 1000, (r or 0) + 100, p, c, e, 100 if m is None else m + 100) for q, r, p, c, e, m in feed_rows(2)]
    base = changefeed.apply_changes(None, feed(spark, first), 2)
    out = changefeed.apply_changes(base, feed(spark, later), 3)
    assert sorted((str(r.platform), r.content_id, r.feed_seq) for r in out.collect()) == plain_table([x for x in first] + later)
    assert changefeed.apply_changes(base, feed(spark, []), 3).count() == base.count()
    assert set(out.columns) == set(base.columns)


def test_kinds(spark):
    df = spark.createDataFrame([(w,) for w in WORDINGS], "e string").select("e", changefeed.change_kind(F.col("e")).alias("k"))
    names = {"c": "created", "x": "updated", "p": "published", "u": "unpublished", "d": "deleted"}
    assert all(r.k == names[kind(r.e)] for r in df.collect())


def test_store_opens_in_another_application(spark, tmp_path):
    """One process upserts; another reads, upserts, merges the runs and removes the older files."""
    code = """
import sys
sys.path[:0] = %r
import tests.test_problems as t
from pyspark.sql import SparkSession
from tidewright.operators import messages
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.sql.warehouse.dir", "%s/warehouse").getOrCreate())
store = messages.MessageStore(spark, ["_key", "_row"], root="file://%s/store")
store.upsert(t.events(spark, t.CASES[:6]), "one")
store.upsert(t.events(spark, t.CASES[4:9]), "two")
""" % (sys.path[:6], tmp_path, tmp_path)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    store = messages.MessageStore(spark, ["_key", "_row"], root=f"file://{tmp_path}/store")
    assert store.runs().count() > 0
    store.upsert(events(spark, CASES[:6]), "one")
    store.upsert(events(spark, CASES), "three")
    store.compact()
    store.vacuum()
    kept = {r[0] for r in store.runs().select("_id").collect()}
    assert kept == {c[0] for c in CASES} - set(drops(CASES)) and store.buckets == 2


def test_a_state_is_committed_once(spark, tmp_path):
    from tidewright.operators.manifest import Manifest

    one, two = Manifest(spark, f"file://{tmp_path}/m"), Manifest(spark, f"file://{tmp_path}/m")
    assert one.commit(0, {"a": 1}) == 1
    with pytest.raises(RuntimeError):
        two.commit(0, {"a": 2})
    assert two.read() == (1, {"a": 1})
    for k in range(1, 5):
        one.commit(k, {"a": k + 1})
    one.vacuum()
    assert two.read() == (5, {"a": 5})
