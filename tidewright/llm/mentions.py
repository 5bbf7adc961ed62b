"""New mentions against all accepted ones (problem 1).

Method: content-defined chunking. Rolling-hash boundaries cut the normalized words of a mention into chunks; a persistent table leads from
chunk hash to the accepted citation; the bytes of the chunks that two texts share, over the bytes of the shorter, are their coverage, and only
pairs of enough coverage pass on to the exact rule on words. Chunk hashes are salted with the normalized title, as only texts of equal titles can
repeat each other, so stock phrases do not meet across titles, and a text whose title nothing else has asks for no chunk at all. What a batch
accepts is appended as one run; history is never chunked, compared or resolved again, and of the stored rows only those of the batch's titles and
keys go on to a join.

Equal texts are one class, held once with its first accepted citation, so a group of copies costs one row of each table.
"""

from __future__ import annotations

import hashlib
import html
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidewright.operators.manifest import Manifest
from tidewright.session import delete_path, release, scratch_path, spread

#: Parameters that track the way to a page and do not choose it.
TRACKING = re.compile(
    r"^(utm_\w*|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|ttclid|mc_cid|mc_eid|igshid|igsh|ref|ref_src|ref_source|ref_url|"
    r"referrer|share|share_id|shared|_hsenc|_hsmi|hsctatracking|spm|cmpid|campaign_id|mkt_tok|oly_enc_id|vero_id|wt_mc|trk|trkcampaign|"
    r"_ga|_gl|s_cid|ncid|amp|at_medium|at_campaign|pk_\w+|mtm_\w+|piwik_\w+|utm)$"
)
SAME_SITE = re.compile(r"^(?:www\d?|m|mobile|old|new|np|amp|i)\.(?=[^.]+\.)")
UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>@]*)?/?>|<!--.*?-->", re.S)
LINK = re.compile(r"!?\[([^\]\n]*)\]\((?:https?:)?[^)\s]*\)")
BRACKETED_START = re.compile(r"^\s*[\[({【][^\])}】]{1,40}[\])}】]\s*[:\-–—]?\s*")
BRACKETED_END = re.compile(r"\s*[\[({【][^\])}】]{1,40}[\])}】]\s*$")
PREFIX = re.compile(r"^\s*(?:re|fwd?|aw|wg|rv|tr|repost|crosspost|cross-post|x-?post|update[d]?|edit(?:ed)?|ask hn|show hn|tell hn|psa|via)\s*(?:\[\d+\]|\(\d+\))?\s*:\s*", re.I)
SITE_END = re.compile(r"\s+(?:\||::|»|·|•|—|–)\s*[^|]{1,40}$|\s+-\s+[^\W\d_]+(?:\.\w+)?\s*$")

#: Grains of chunks as (fewest words, most words, bytes on average, bytes of the rolling window). Two texts that can repeat each other have at most
#: twice as many words as one another, so whatever the shorter's range is, the other has chunks of that grain, too. The first grain cuts behind every
#: blank: where a text has a handful of words, larger chunks might share nothing though four of five words stand.
GRAINS = ((1, 16, 0, 1), (9, 64, 4, 2), (33, 1 << 62, 8, 3))
COVERAGE = 0.1  # share of the shorter text's bytes that nominates a pair; under random edits at the limit of the rule the least was 0.17
HEAVY = 64  # a chunk of more texts of a title nominates the first of them; all that hold such chunks are compared in blocks, by words
BLOCK = 512  # texts on each side of a block
FEW = 100_000  # rows of a batch up to which hashes of its titles and keys are broadcast, 8 bytes each; beyond, the joins shuffle
FAN = 8  # runs of like size that are merged into one
SHARE, LENGTHS = 0.8, 0.5
_GEAR, _BYTE = np.frombuffer(hashlib.shake_256(b"tidewright gear").digest(512 * 8), dtype=np.uint64).reshape(2, 256)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 20  # bytes of texts that are cut at once


def page_key(url: str | None) -> str | None:
    """What an address serves: without scheme, default port, letter case of the host, site prefixes, tracking, fragment, order of parameters."""
    if not isinstance(url, str) or not url.strip():
        return None
    u = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://|^//", "", url.strip())
    u, _, fragment = u.partition("#")
    u, _, query = u.partition("?")
    host, slash, path = u.partition("/")
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":(?:80|443)?$", "", host).rstrip(".")
    host = SAME_SITE.sub("", host)

    def plain(s: str) -> str:
        def one(m):
            b = int(m.group(1), 16)
            return chr(b) if b in UNRESERVED else m.group(0).upper()

        return PERCENT.sub(one, s)

    path = re.sub(r"/{2,}", "/", plain("/" + path))
    path = re.sub(r"/(?:index\.(?:html?|php))$", "/", path).rstrip("/")
    pairs = []
    for p in re.split(r"[&;]", query.replace("+", "%20")):
        name, eq, value = p.partition("=")
        name = plain(name)
        if name and not TRACKING.match(name.lower()):
            pairs.append(name + "=" + plain(value))
    key = host + path + ("?" + "&".join(sorted(pairs)) if pairs else "")
    return key + ("#" + fragment if fragment[:1] in ("!", "/") else "")


def plain_words(text: str | None) -> list[str]:
    """Words in order, without markup, case and punctuation."""
    if not isinstance(text, str):
        return []
    if "<" in text:
        text = TAG.sub(" ", text)
    if "](" in text:
        text = LINK.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    return WORD.findall(text.lower().replace("’", "").replace("'", ""))


def title_key(title: str | None) -> str:
    """The words of a title without added tags; '' if nothing is left."""
    if not isinstance(title, str):
        return ""
    t = title.strip()
    while True:
        s = t
        for p in (BRACKETED_START, PREFIX, BRACKETED_END, SITE_END):
            rest = p.sub("", s, count=1)
            if WORD.search(rest):
                s = rest
        if s == t:
            break
        t = s
    return " ".join(plain_words(t))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def cut(data: np.ndarray, starts: np.ndarray, modulus: int, window: int) -> np.ndarray:
    """Ends of the content-defined chunks of texts that lie one after another: where the rolling hash of the last bytes divides evenly, and at
    each text's end. Equal stretches cut alike wherever they stand. Modulus 0 cuts behind blanks."""
    if modulus:
        g = _GEAR[data]
        h, place = g.copy(), np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        for k in range(1, window):
            h[k:] += np.where(place[k:] >= k, g[:-k] << np.uint64(k), np.uint64(0))
        at = (h >> np.uint64(7)) % np.uint64(modulus) == 0
    else:
        at = data == 32
    at[np.append(starts[1:], len(data)) - 1] = True
    return np.nonzero(at)[0] + 1


def chunk_rows(texts: list[bytes], salts: np.ndarray, modulus: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, bytes) of the distinct chunks of each text. The hash is a polynomial of the chunk's bytes, salted and mixed."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.append(0, np.cumsum([len(x) for x in texts], dtype=np.int64)[:-1])
    ends = cut(data, starts, modulus, window)
    begins = np.append(0, ends[:-1])
    power = np.full(len(data), _BASE, dtype=np.uint64)
    power[0] = 1
    total = np.append(np.uint64(0), np.cumsum(_BYTE[data] * np.cumprod(power, dtype=np.uint64), dtype=np.uint64))
    back = np.full(len(data) + 1, _BACK, dtype=np.uint64)
    back[0] = 1
    value = (total[ends] - total[begins]) * np.cumprod(back, dtype=np.uint64)[begins]
    of = np.searchsorted(starts, begins, side="right") - 1
    size = ends - begins
    value = _mixed(value + _mixed(salts[of] + np.uint64(modulus)) + size.astype(np.uint64)).view(np.int64)
    order = np.lexsort((value, of))
    of, value, size = of[order], value[order], size[order]
    new = np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))
    return of[new], value[new], size[new]


def chunked(texts: list[bytes], salts: list[int], words: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Of each text the hashes and bytes of its chunks in the grains its number of words asks for, and the bytes that coverage is measured by: those
    of the grain with the fewest. The title at the opening counts like all words, as the rule counts it: it alone can make a repeat."""
    hashes: list[list] = [[] for _ in texts]
    sizes: list[list] = [[] for _ in texts]
    least = [0] * len(texts)
    for fewest, most, modulus, window in GRAINS:
        mine = [i for i, n in enumerate(words) if fewest <= n <= most]
        at = 0
        while at < len(mine):
            part, held = [], 0
            while at < len(mine) and (not part or held + len(texts[mine[at]]) <= SLICE):
                part.append(mine[at])
                held += len(texts[mine[at]])
                at += 1
            of, value, size = chunk_rows([texts[i] for i in part], np.array([salts[i] & (2**64 - 1) for i in part], dtype=np.uint64), modulus, window)
            edge = np.searchsorted(of, np.arange(len(part) + 1))
            for k, i in enumerate(part):
                hashes[i].append(value[edge[k] : edge[k + 1]])
                sizes[i].append(size[edge[k] : edge[k + 1]])
                n = int(sizes[i][-1].sum())
                least[i] = min(least[i], n) if least[i] else n
    none = np.zeros(0, dtype=np.int64)
    return [np.concatenate(x) if x else none for x in hashes], [np.concatenate(x) if x else none for x in sizes], least


def in_order(a: list[str], b: list[str]) -> int:
    """The most words that stand in the same order in both (longest common subsequence), with one bit for each word of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def repeats(a: list[str], b: list[str]) -> bool:
    """The rule on mention_context: the shorter has half the words of the longer, and four fifths of its words stand in order in the other."""
    short, long = sorted((len(a), len(b)))
    return bool(short) and 2 * short >= long and 5 * in_order(a, b) >= 4 * short


PREPARED = "id long, batch int, u string, t string, th long, title_key string, text string, bytes long, hs array<bigint>, lens array<bigint>"


def prepare(rows: DataFrame) -> DataFrame:
    """citation_id, ingest_batch, page key, class, title key, words and chunks of each citation; row by row, without history.

    Rows without citation_id are left out, as nothing could name them."""
    plain = rows.where("citation_id is not null").select(
        F.col("citation_id").cast("long").alias("id"), F.coalesce(F.col("ingest_batch").cast("int"), F.lit(0)).alias("batch"), "source_url", "title", "mention_context"
    )

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            pages, classes, titles, keys, texts, data, counts = [], [], [], [], [], [], []
            for url, title, context in zip(*cols):
                page, key, words = page_key(url), title_key(title), plain_words(context)
                pages.append("u" + hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest() if page else None)
                if not key or not words:
                    for out in (classes, titles, keys, texts):
                        out.append(None)
                    data.append(b"")
                    counts.append(0)
                    continue
                text = " ".join(words)
                name, raw = key.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                classes.append("t" + hashlib.md5(name + b"\0" + raw).hexdigest())
                titles.append(xxhash.xxh64_intdigest(name) - (1 << 63))
                keys.append(key)
                texts.append(text)
                data.append(raw)
                counts.append(len(words))
            hashes, sizes, least = chunked(data, [x or 0 for x in titles], counts)
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in hashes], dtype=np.int64)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (hashes, sizes)]
            arrays = [batch.column(0), batch.column(1), pa.array(pages, pa.string()), pa.array(classes, pa.string()), pa.array(titles, pa.int64()), pa.array(keys, pa.string()), pa.array(texts, pa.string()), pa.array(least, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "batch", "u", "t", "th", "title_key", "text", "bytes", "hs", "lens"])

    return plain.mapInArrow(run, PREPARED)


def _repeats(ka: pd.Series, a: pd.Series, kb: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x == y and repeats(s.split(" "), t.split(" ")) for x, s, y, t in zip(ka, a, kb, b)], dtype=bool)


NEAR = "t string, own boolean, other string, n long"


def _blocked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """NEAR of the texts of two blocks of one title that repeat each other.

    The rule needs four fifths of the words of the shorter in order, so at least as many in common; only pairs that have them reach it.
    """
    texts = [s.split(" ") for s in right["text"]]
    held: dict[tuple[str, int], list[int]] = {}
    for j, words in enumerate(texts):
        for x in _numbered(words):
            held.setdefault(x, []).append(j)
    at = {x: np.array(js) for x, js in held.items()}
    size, other, stored = np.array([len(w) for w in texts], dtype=np.int64), right["t"].to_numpy(), ~right["own"].to_numpy(dtype=bool)
    n, title = right["n"].to_numpy(), right["title_key"].to_numpy()
    out = []
    for t, key, text, n_own, known, n_known in left[["t", "title_key", "text", "n", "known", "n_known"]].itertuples(index=False):
        words = text.split(" ")
        hits = [at[x] for x in _numbered(words) if x in at]
        if not hits:
            continue
        # What repeats a stored text is no citation that others could repeat, and only lower stored ones than that text matter to it.
        asked = stored & (n < n_known) if known else stored | (n < n_own)
        short, long = np.minimum(size, len(words)), np.maximum(size, len(words))
        common = np.bincount(np.concatenate(hits), minlength=len(texts))
        passed = np.nonzero(asked & (other != t) & (title == key) & (2 * short >= long) & (5 * common >= 4 * short))[0]
        # All stored ones are accepted, so the lowest that is repeated is the one to report.
        for j in sorted(passed[stored[passed]], key=lambda j: n[j]):
            if repeats(words, texts[j]):
                out.append((t, False, other[j], n[j]))
                break
        for j in passed[~stored[passed]]:
            if repeats(words, texts[j]):
                out.append((t, True, other[j], n[j]))
    return pd.DataFrame(out, columns=["t", "own", "other", "n"])


def _numbered(words: list[str]) -> list[tuple[str, int]]:
    """Each word with how often it stood before, so that sets of them meet as often as the words do."""
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen.get(w, 0)
        seen[w] = k + 1
        out.append((w, k))
    return out


KEY, TEXT, CHUNK = 0, 1, 2
ROWS = "th long, h long, n long, bytes long, key string, title_key string, text string"


class AcceptedMentions:
    """The accepted citations under `root`: keys (page key or text class -> first accepted citation), texts (citation -> words) and the
    chunk-to-record table (chunk hash -> citation). All are plain files, read by path, so any application can open the store.

    A batch adds one run, in directories by kind and by range of the title's (keys: the key's) hash. A batch reads the ranges of its own titles
    only, and of these only the rows of its titles go on. Runs of like size are merged, `FAN` at a time, so files stay few and each row is written
    again a logarithmic number of times.

    A null or blank address leads nowhere; a title without words, a null one, or a mention without words repeats no text. Of several accepted
    citations that a row repeats, the lowest is reported. Rows of one batch are decided in the order of citation_id, as if one by one; citation_id
    rises with arrival. A null ingest_batch counts as history. A citation that comes again with the same citation_id, address and text is the same citation. A batch that was taken in before
    is not taken in again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, ranges: int = 4):
        self.spark = spark
        self.root = root or scratch_path(spark, "mentions")
        self.manifest = Manifest(spark, self.root)
        version, _ = self.manifest.read()
        if not version:
            self.manifest.commit(0, {"ranges": ranges, "next": 0, "runs": [], "applied": []})

    # ------------------------------------------------------------ storage
    def _stored(self, kind: int, ranges: set | None = None) -> DataFrame:
        """Rows of a kind in the given ranges of hashes (all, if none are given)."""
        _, state = self.manifest.read()
        wanted = range(state["ranges"]) if ranges is None else sorted(ranges)
        paths = [f"{self.root}/run={r['run']}/kind={kind}/p={p}" for r in state["runs"] for p in wanted if [kind, p] in r["parts"]]
        if not paths:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*paths)

    def keys(self) -> DataFrame:
        return self._stored(KEY).select("key", "n")

    def texts(self) -> DataFrame:
        return self._stored(TEXT).select("n", "title_key", "text")

    def _write_run(self, rows: DataFrame, run: int) -> dict:
        """rows: ROWS, kind, p. Files of bounded size, in order of hash; a range that a hot title fills is split over tasks."""
        path = f"{self.root}/run={run}"
        delete_path(self.spark, path)  # a run that a failed attempt left behind
        count = Observation()
        rows = rows.hint("rebalance", "kind", "p").sortWithinPartitions("kind", "p", "th", "h")
        rows.observe(count, F.count("*").alias("rows"), F.collect_set(F.struct("kind", "p")).alias("parts")).write.partitionBy("kind", "p").parquet(path)
        return {"run": run, "rows": count.get["rows"], "parts": sorted([x["kind"], x["p"]] for x in count.get["parts"])}

    def _append(self, accepted: DataFrame, classes: DataFrame, part: str) -> None:
        """accepted: n, u, t. classes: the texts of the batch. What is stored of a class goes by its first accepted citation."""
        version, state = self.manifest.read()
        p = lambda c: F.pmod(c, F.lit(state["ranges"])).cast("int").alias("p")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        first = accepted.where("t is not null").groupBy("t").agg(F.min("n").alias("n"))
        own = F.array(F.struct(F.lit(TEXT).alias("kind"), F.lit(None).cast("long").alias("h"), F.col("title_key"), F.col("text")))
        chunks = F.transform("hs", lambda h: F.struct(F.lit(CHUNK).alias("kind"), h.alias("h"), F.lit(None).cast("string").alias("title_key"), F.lit(None).cast("string").alias("text")))
        texts = classes.drop("n").join(first, "t").select("th", "n", "bytes", F.explode(F.concat(own, chunks)).alias("r"))
        texts = texts.select("th", "r.h", "n", "bytes", none("string", "key"), "r.title_key", "r.text", "r.kind", p(F.col("th")))
        hashed = self._first_of(self._each(accepted)).withColumn("th", F.xxhash64("key"))
        keys = hashed.select("th", none("long", "h"), "n", none("long", "bytes"), "key", none("string", "title_key"), none("string", "text"), F.lit(KEY).alias("kind"), p(F.col("th")))
        run = self._write_run(texts.unionByName(keys), state["next"])
        self.manifest.commit(version, state | {"next": state["next"] + 1, "runs": [*state["runs"], run], "applied": [*state["applied"], part]})
        self.compact()

    def compact(self, every: bool = False) -> None:
        """Merges the last runs into one, sorted again, while there are `FAN` of like size, or all of them; nothing is decided anew."""
        while True:
            version, state = self.manifest.read()
            runs = state["runs"]
            tier = lambda r: len(np.base_repr(max(1, r["rows"]), FAN))
            last = runs if every else runs[-FAN:]
            if len(last) < 2 or not every and (len(last) < FAN or len({tier(r) for r in last}) > 1):
                return
            path = self.spark.read.option("basePath", self.root).schema(f"{ROWS}, run int, kind int, p int")
            rows = path.parquet(*[f"{self.root}/run={r['run']}" for r in last]).drop("run")
            run = self._write_run(rows, state["next"])
            self.manifest.commit(version, state | {"next": state["next"] + 1, "runs": [*runs[: -len(last)], run]})

    def vacuum(self) -> None:
        """Removes the runs that no longer count and the lists of cases. Not while others read an older state or a list."""
        _, state = self.manifest.read()
        live = {r["run"] for r in state["runs"]}
        for k in range(state["next"]):
            delete_path(self.spark, f"{self.root}/_work-{k}")
            if k not in live:
                delete_path(self.spark, f"{self.root}/run={k}")

    # ------------------------------------------------------------ candidates
    @staticmethod
    def _only(rows: DataFrame, hashes: DataFrame, few: bool) -> DataFrame:
        """Rows of the given title or key hashes: read in place where the hashes are few enough to be sent around."""
        hashes = hashes.select("th")
        return rows.join(F.broadcast(hashes) if few else hashes, "th", "left_semi")

    def _probes(self, classes: DataFrame, ranges: set, few: bool, write) -> tuple[DataFrame, int, int]:
        """The classes whose title another text has, in the batch or in the store, as no other can repeat a different text; how many they are; and
        the most texts of a title."""
        titles = classes.select("th")
        shared = titles.unionByName(self._only(self._stored(TEXT, ranges).select("th"), titles, few)).groupBy("th").agg(F.count("*").alias("texts")).where("texts > 1")
        probes, seen = write(classes.join(F.broadcast(shared) if few else shared, "th"), "probes", F.max("texts").alias("most"))
        return probes.drop("texts"), seen["rows"], seen["most"] or 0

    def _near(self, probes: DataFrame, hits, most: int, ranges: set, few: bool, write) -> DataFrame:
        """NEAR: (t, other) of different texts that repeat each other, t of the batch; other is a class of the batch (own) or a stored citation (b, n).

        A chunk that more than HEAVY texts of a title share - a stock phrase, or a piece of a text of which there are many versions - would pair all
        of them once for each such chunk. It nominates the first of them only, and the texts that hold such chunks are compared in blocks.
        """
        chunks = probes.select("t", "th", "n", "bytes", F.explode(F.arrays_zip("hs", "lens")).alias("c")).select("t", "th", "n", "bytes", "c.hs", "c.lens")
        own = chunks.select("th", F.col("hs").alias("h"), F.lit(True).alias("own"), F.col("t").alias("other"), "n", "bytes")
        stored = self._only(self._stored(CHUNK, ranges).select("th", "h", "n", "bytes"), probes, few)
        posts = own.unionByName(stored.select("th", "h", F.lit(False).alias("own"), F.lit("").alias("other"), "n", "bytes"))
        heavy, light = None, posts
        if most > HEAVY:
            posts, _ = write(posts, "posts")
            first = F.min(F.struct("n", "own", "other", "bytes")).alias("first")
            counts = posts.groupBy("th", "h").agg(F.count("*").alias("texts"), F.max("own").alias("asked"), first)
            heavy, seen = write(counts.where((F.col("texts") > HEAVY) & F.col("asked")).select("th", "h", "first"), "heavy")
            heavy = heavy if seen["rows"] else None
        if heavy is not None:
            lone = heavy.select("th", "h", *[F.col(f"first.{c}").alias(c) for c in ("own", "other", "n", "bytes")])
            light = posts.join(heavy.select("th", "h"), ["th", "h"], "left_anti").unionByName(lone)
        asked = chunks.select(F.col("t").alias("a"), F.col("bytes").alias("a_bytes"), "th", F.col("hs").alias("h"), F.col("lens").alias("len"))
        met = asked.join(light, ["th", "h"]).where("other <> a")
        # A pair within the batch is the same from both sides.
        turned = F.col("own") & (F.col("a") > F.col("other"))
        met = met.select("th", "own", "n", "len", F.least("a_bytes", "bytes").alias("of"), turned.alias("turned"), F.when(turned, F.col("other")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("other")).alias("other"))
        side = lambda x: F.coalesce(F.sum(F.when(F.col("turned") == x, F.col("len"))), F.lit(0))
        cover = met.groupBy("th", "a", "own", "other", F.when(~F.col("own"), F.col("n")).alias("n")).agg(F.greatest(side(True), side(False)).alias("shared"), F.min("of").alias("of"))
        near, _ = write(self._verified(cover.where(F.col("shared") >= COVERAGE * F.col("of")), probes, ranges, few), "near")
        if heavy is None:
            return near
        return near.unionByName(self._near_in_blocks(probes, posts, heavy.select("th", "h"), near, hits, ranges, few, write)).distinct()

    def _verified(self, pairs: DataFrame, probes: DataFrame, ranges: set, few: bool) -> DataFrame:
        """NEAR of the pairs that the rule on words holds for."""
        left = pairs.join(probes.select(F.col("t").alias("a"), F.col("title_key").alias("ka"), F.col("text").alias("ta")), "a")
        right = probes.select(F.col("t").alias("other"), F.col("title_key").alias("kb"), F.col("text").alias("tb"))
        stored = self._only(self._stored(TEXT, ranges), probes, few).select("th", "n", F.col("title_key").alias("kb"), F.col("text").alias("tb"))
        columns = ["a", "own", "other", "n", "ka", "ta", "kb", "tb"]
        rows = left.where("own").join(right, "other").select(*columns).unionByName(left.where("not own").join(stored, ["th", "n"]).select(*columns))
        kept = rows.where(F.pandas_udf(_repeats, "boolean")("ka", "ta", "kb", "tb"))
        both = F.when(F.col("own"), F.array(F.struct(F.col("a").alias("t"), "other"), F.struct(F.col("other").alias("t"), F.col("a").alias("other")))).otherwise(F.array(F.struct(F.col("a").alias("t"), "other")))
        return kept.select("own", "n", F.explode(both).alias("p")).select("p.t", "own", "p.other", "n")

    def _near_in_blocks(self, probes: DataFrame, posts: DataFrame, heavy: DataFrame, near: DataFrame, hits, ranges: set, few: bool, write) -> DataFrame:
        """NEAR of the texts that hold heavy chunks: every pair of a title, but those that cannot change what is reported."""
        holders = posts.join(heavy, ["th", "h"], "left_semi").select("th", "own", "other", "n").distinct()
        text = self._only(self._stored(TEXT, ranges), probes, few).select("th", "n", "title_key", "text")
        old, _ = write(holders.where("not own").select("th", "n").join(text, ["th", "n"]), "heavy_old")
        # The first accepted citation that a text is known to repeat; it is a case then, whatever else is found.
        hit = hits(near).groupBy(F.col("key").alias("t")).agg(F.min("n").alias("known"))
        new = holders.where("own").select(F.col("other").alias("t")).join(probes.select("t", "th", "n", "title_key", "text"), "t").join(hit, "t", "left")
        new, _ = write(new, "heavy_new")
        lone = new.where("known is null")
        right = old.withColumns({"own": F.lit(False), "t": F.lit("")}).unionByName(lone.drop("known").withColumn("own", F.lit(True)))
        lowest = old.groupBy("th").agg(F.min("n").alias("lowest"))
        left = new.join(lowest, "th", "left").where("known is null or lowest < known").drop("lowest")
        blocks = lambda rows, name: rows.groupBy("th").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        count = blocks(left, "lefts").join(blocks(right, "rights"), "th")
        count, _ = write(count, "blocks")
        place = F.abs(F.hash("n", "t")).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left, right = (x.join(count, "th") for x in (left, right))
        left = left.withColumns({"i": F.pmod(place, "lefts").cast("int"), "j": every("rights"), "n_known": F.coalesce("known", F.lit(0)), "known": F.col("known").isNotNull()})
        right = right.withColumns({"j": F.pmod(place, "rights").cast("int"), "i": every("lefts")})
        by = ["th", "i", "j"]
        pairs = left.drop("lefts", "rights").groupBy(*by).cogroup(right.drop("lefts", "rights").groupBy(*by)).applyInPandas(_blocked, NEAR)
        pairs, _ = write(pairs, "heavy_near")
        back = pairs.where("own").select(F.col("other").alias("t"), "own", F.col("t").alias("other"), F.lit(None).cast("long").alias("n"))
        plain = pairs.withColumn("n", F.when(~F.col("own"), F.col("n")))
        return plain.unionByName(back)

    # ------------------------------------------------------------ decisions
    @staticmethod
    def _each(rows: DataFrame) -> DataFrame:
        """n, key: the page key and the class of each row."""
        return rows.select("n", F.explode(F.array("u", "t")).alias("key")).where("key is not null")

    @staticmethod
    def _first_of(each: DataFrame) -> DataFrame:
        return each.groupBy("key").agg(F.min("n").alias("n"))

    @classmethod
    def _least(cls, rows: DataFrame, others: DataFrame, near: DataFrame) -> DataFrame:
        """n, least: of each row the lowest of the others under its page key, its class, or a class near it, where there is one. near: t, other."""
        each = cls._each(rows)
        asked = each.unionByName(each.join(near, each["key"] == near["t"]).select("n", F.col("other").alias("key")))
        return asked.join(cls._first_of(cls._each(others)).withColumnRenamed("n", "least"), "key").groupBy("n").agg(F.min("least").alias("least"))

    def ingest(self, prepared: DataFrame, part: str, history: bool = False) -> DataFrame:
        """Takes in one prepared batch; returns (citation_id_a, citation_id_b) of the rows that repeat an accepted citation."""
        empty = self.spark.createDataFrame([], "citation_id_a long, citation_id_b long")
        _, state = self.manifest.read()
        if part in state["applied"]:
            return empty
        work = f"{self.root}/_work-{state['next']}"

        def write(df: DataFrame, name: str, *more) -> tuple[DataFrame, dict]:
            """Each step is written down before the next uses it several times; a plan of all of them would grow with every round."""
            seen, schema = Observation(), df.schema
            df.observe(seen, F.count("*").alias("rows"), *more).write.mode("overwrite").parquet(f"{work}/{name}")
            return self.spark.read.schema(schema).parquet(f"{work}/{name}"), seen.get

        rows = prepared.select(F.col("id").alias("n"), "u", "t")
        kept = F.min_by(F.struct("th", "title_key", "text", "bytes", "hs", "lens"), "id").alias("x")
        classes = prepared.where("t is not null").groupBy("t").agg(kept, F.min("id").alias("n")).select("t", "x.*", "n")
        if history:
            self._append(rows, classes, part)
            return empty
        p = lambda c: F.collect_set(F.pmod(c, F.lit(state["ranges"])))
        size = prepared.agg(F.count("*").alias("rows"), p(F.col("th")).alias("titles"), p(F.xxhash64("u")).alias("u"), p(F.xxhash64("t")).alias("t")).first()
        few, ranges = size["rows"] <= FEW, {int(x) for x in size["titles"]}
        classes, _ = write(classes, "classes")
        each = self._each(rows).withColumn("th", F.xxhash64("key"))
        stored = self._only(self._stored(KEY, {int(x) for x in size["u"] + size["t"]}).select("th", "key", "n"), each, few).select("key", "n")

        def hits(near: DataFrame) -> DataFrame:
            """(key, n): stored citations under a page key, a class, or near a class."""
            return stored.unionByName(near.where("not own").select(F.col("t").alias("key"), "n"))

        probes, probing, most = self._probes(classes, ranges, few, write)
        near = self._near(probes, hits, most, ranges, few, write) if probing else self.spark.createDataFrame([], NEAR)
        least = each.select("n", "key").join(hits(near).groupBy("key").agg(F.min("n").alias("least")), "key").groupBy("n").agg(F.min("least").alias("least"))
        seen, _ = write(rows.distinct().join(least, "n", "left"), "seen")
        cases, taken, near, k = [seen.where("least is not null")], [], near.where("own").select("t", "other"), 0
        waiting = seen.where("least is null").drop("least")
        while True:
            # Open rows below all open rows that they could repeat are accepted; open rows that repeat one of those are cases.
            late = F.col("least") < F.col("n")
            tried, count = write(waiting.join(self._least(waiting, waiting, near), "n", "left"), f"tried{k}", F.sum(late.cast("int")).alias("late"))
            late = F.coalesce(late, F.lit(False))
            taken.append(tried.where(~late).drop("least"))
            if not count["late"]:
                break
            tried = tried.where(late).drop("least")
            left, count = write(tried.join(self._least(tried, taken[-1], near).where("least < n"), "n", "left"), f"left{k}", F.sum(F.col("least").isNull().cast("int")).alias("open"))
            cases.append(left.where("least is not null"))
            waiting, k = left.where("least is null").drop("least"), k + 1
            if not count["open"]:
                break
        self._append(reduce(DataFrame.unionByName, taken), classes, part)
        for name in ("classes", "probes", "posts", "heavy", "near", "heavy_old", "heavy_new", "blocks", "heavy_near"):
            delete_path(self.spark, f"{work}/{name}")
        release(self.spark)
        return reduce(DataFrame.unionByName, cases).select(F.col("least").alias("citation_id_a"), F.col("n").alias("citation_id_b"))


def repeated_mentions(citations: DataFrame) -> DataFrame:
    """(citation_id_a, citation_id_b): the first batch is history, each other is taken in after the ones before it."""
    spark = citations.sparkSession
    path = scratch_path(spark, "prepared")
    prepare(spread(citations)).withColumn("part", F.col("batch")).write.partitionBy("part").parquet(path)
    # As many numbers as there are batches.
    numbers = sorted(r[0] for r in spark.read.schema("part int").parquet(path).select("part").distinct().collect())
    store = AcceptedMentions(spark)
    found = [spark.createDataFrame([], "citation_id_a long, citation_id_b long")]
    for k in numbers:
        found.append(store.ingest(spark.read.schema(PREPARED).parquet(f"{path}/part={k}"), f"b{k}", history=k == numbers[0]))
    delete_path(spark, path)
    return reduce(DataFrame.unionByName, found)
