"""Oversized texts in pieces cut at natural boundaries (problem 8).

Method: a recursive separator hierarchy. A text is split by sections; a part that is still too large by paragraphs, then sentences, then words,
then characters; the parts are packed greedily into pieces up to the limit, and each piece after the first begins with the end of the one
before. Each text is worked on alone, so there is no shuffle; its size in tokens is found once, as the counts of the stretches that the
tokenizer's own pattern splits it into, and every piece is a run of those stretches, so its size is known without tokenizing it again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewright.session import spread
from tidewright.llm.tokens import VOCABULARY, Tokenizer, tokenizer

#: Starts of sections: markdown and HTML headings, rules, form feeds, headings of version lists.
SECTION = re.compile(r"^(?=#{1,6}\s)|(?=<(?:h[1-6]|section|article)\b)|^(?=(?:-{3,}|\*{3,}|_{3,}|={3,})\s*$)|(?<=\f)|^(?=\[?v?\d+\.\d+(?:\.\d+)?\]?\b[^\n]{0,40}$)", re.M | re.I)
#: Ends of paragraphs: blank lines, closing block tags.
PARAGRAPH = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:(?:\r\n?|\n)[^\S\r\n]*)+|</(?:p|div|li|ul|ol|table|tr|section|article|blockquote|pre|dd|dt|h[1-6])>\s*|<(?:br|hr)\s*/?>\s*", re.I)
#: Ends of sentences: closing punctuation before white space, line ends, ends of JSON members.
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?=\s)\s*|[。！？]|[\r\n]+\s*|[}\]],\s*|\",(?=\s)\s*|;\s+")
LONG = 16  # a stretch of more tokens is cut into shorter ones before anything else


def _atoms(text: str, tok: Tokenizer, stretches: list[str], counts: list[int], marks: list[int]) -> tuple[list[int], list[int], bool]:
    """Starts (with the end of the text) and token counts of the shortest stretches that are kept whole; whether stretches of the pattern had
    to be cut, so that sums of counts are no longer exact. They are cut at marks inside them, and where they have more than LONG tokens."""
    starts = list(accumulate(map(len, stretches), initial=0))
    inside = {}
    for p in marks:
        i = bisect_right(starts, p) - 1
        if i < len(stretches) and starts[i] < p and not text[starts[i] : p].isspace():
            inside.setdefault(i, []).append(p)
    if not inside and max(counts, default=0) <= LONG:
        return starts, counts, False
    out, sizes = [], []
    for i, (s, n) in enumerate(zip(stretches, counts)):
        if n <= LONG and i not in inside:
            out.append(starts[i])
            sizes.append(n)
            continue
        ends = [*inside.get(i, ()), starts[i + 1]]
        at = starts[i]
        for end in ends:
            while at < end:
                stop = end
                size = tok.count(text[at:stop])
                if size > LONG:
                    stop = min(end, at + max(1, (end - at) * (LONG // 2) // size))
                    size = tok.count(text[at:stop])
                    while size > LONG and stop - at > 1:
                        stop = at + (stop - at) // 2
                        size = tok.count(text[at:stop])
                out.append(at)
                sizes.append(size)
                at = stop
    return [*out, len(text)], sizes, True


def _cuts(positions: list[int], starts: list[int]) -> list[int]:
    """Positions in the text as numbers of atoms: the last atom that does not start after the position."""
    out = sorted({bisect_right(starts, p) - 1 for p in positions})
    return [c for c in out if 0 < c < len(starts) - 1]


class Splitter:
    """Cuts one text after another."""

    def __init__(self, tok: Tokenizer):
        self.tok, self.text = tok, None

    def pieces(self, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, tokens, shared tokens) of the pieces in characters, from 0; a text within the limit is one piece.

        Without what a piece shares with the one before, the pieces joined are the text. The shared part is the shortest run of whole stretches
        (words, mostly) at the end of a piece with at least `overlap` tokens. The limit must leave room for it.
        """
        if limit - overlap <= 2 * LONG:
            raise ValueError("the limit must exceed the overlap by more than 32 tokens")
        self.read(text)
        if self.total <= limit:
            return [(0, len(text), self.total, 0)] if text else []
        if self.starts is None:
            self._prepare()
        starts, counts = self.starts, self.counts
        room = limit - overlap - LONG
        bounds = [i for i, _ in self._units(0, len(counts), 0, room)]
        bounds.append(len(counts))
        out, begin, fresh, shared, k = [], 0, 0, 0, 1
        while fresh < len(counts):
            while k + 1 < len(bounds) and self.size(begin, bounds[k + 1]) <= limit:
                k += 1
            end = bounds[k]
            size = self.exact(begin, end)
            while size > limit:  # the sum of the counts of cut stretches can fall short of the count of the whole
                if k > 1 and bounds[k - 1] > fresh:
                    k -= 1
                    end = bounds[k]
                else:
                    bounds.insert(k, end - 1)
                    end -= 1
                size = self.exact(begin, end)
            out.append((starts[begin], starts[end], size, shared))
            fresh, k = end, k + 1
            begin = self._back(begin, end, overlap)
            shared = self.exact(begin, end)
        return out

    def read(self, text: str) -> int:
        """The size of a text; what was found out about the text before is forgotten, unless it is the same."""
        if self.text != text:
            self.text, self.starts = text, None
            self.stretches = self.tok.stretches(text)
            self.counted = self.tok.counts(self.stretches)
            self.total = sum(self.counted)
        return self.total

    def _prepare(self) -> None:
        text = self.text
        sections = [m.start() for m in SECTION.finditer(text)]
        paragraphs, sentences = ([m.end() for m in p.finditer(text)] for p in (PARAGRAPH, SENTENCE))
        self.starts, self.counts, self.cut = _atoms(text, self.tok, self.stretches, self.counted, sorted({*sections, *paragraphs, *sentences}))
        self.sums = list(accumulate(self.counts, initial=0))
        self.levels = [_cuts(x, self.starts) for x in (sections, paragraphs, sentences)]

    def exact(self, i: int, j: int) -> int:
        """Tokens of the atoms i to j as a text of their own."""
        return self.tok.count(self.text[self.starts[i] : self.starts[j]]) if self.cut else self.size(i, j)

    def size(self, i: int, j: int) -> int:
        """Tokens of the atoms i to j as a text of their own: white space at its end, which no longer stands before anything, counts as one stretch. Near enough, where stretches had to be cut."""
        n = self.sums[j] - self.sums[i]
        k, text, starts = j, self.text, self.starts
        while k > i and text[starts[k - 1] : starts[k]].isspace():
            k -= 1
        if j - k > 1:
            n += self.tok.counts([text[starts[k] : starts[j]]])[0] - (self.sums[j] - self.sums[k])
        return n

    def _units(self, i: int, j: int, level: int, room: int) -> Iterator[tuple[int, int]]:
        """The parts of i to j, each within the room."""
        if self.sums[j] - self.sums[i] <= room:
            yield i, j
            return
        if level < 3:
            cuts = self.levels[level]
            inside = cuts[bisect_right(cuts, i) : bisect_left(cuts, j)]
            for a, b in zip([i, *inside], [*inside, j]):
                yield from self._units(a, b, level + 1, room)
            return
        # words, and where a word is too long, characters: as much as fits
        a = i
        while self.sums[j] - self.sums[a] > room:
            b = bisect_right(self.sums, self.sums[a] + room, a + 1, j + 1) - 1
            c = b
            while c > a and not self._word(c):
                c -= 1
            b = c if c > a else max(b, a + 1)
            yield a, b
            a = b
        yield a, j

    def _word(self, i: int) -> bool:
        """Whether atom i begins a word: it begins with white space or follows it."""
        at = self.starts[i]
        return self.text[at].isspace() or self.text[at - 1].isspace()

    def _back(self, begin: int, end: int, overlap: int) -> int:
        """Where the next piece begins: the latest place before `end` from which at least `overlap` tokens are shared, at a word if one is near."""
        if overlap <= 0:
            return end
        b = bisect_right(self.sums, self.sums[end] - overlap, begin, end) - 1
        while b > begin and self.exact(b, end) < overlap:
            b -= 1
        c = b
        while c > begin + 1 and not self._word(c) and self.sums[end] - self.sums[c] < overlap + LONG // 2:
            c -= 1
        b = c if self._word(c) and overlap <= self.exact(c, end) <= overlap + LONG else b
        return max(b, begin + 1)


PIECES = "setting_name string, doc_id bigint, piece_no int, pieces int, start_pos bigint, end_pos bigint, tokens int, shared_tokens int, text string"


def split_documents(documents: DataFrame, settings: list[tuple[str, int, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of each text that is longer than a setting (name, limit, overlap): positions in code points, from 1, end included.

    Texts within the limit, null and empty ones have no pieces here. Repeated rows are cut each. A long text without any boundary is cut
    between characters. Extra columns are not carried along.
    """
    least = min((limit for _, limit, _ in settings), default=0)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(tokenizer(vocabulary))
        for pdf in frames:
            rows, held = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if not isinstance(text, str) or len(text.encode("utf-8", "surrogatepass")) <= least:  # no token is shorter than a byte
                    continue
                if splitter.read(text) <= least:
                    continue
                for name, limit, overlap in settings:
                    found = splitter.pieces(text, limit, overlap)
                    if len(found) < 2:
                        continue
                    for n, (a, b, size, shared) in enumerate(found):
                        rows.append((name, doc, n + 1, len(found), a + 1, b, size, shared, text[a:b]))
                        held += b - a
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in PIECES.split(", ")]
    if not settings:
        return documents.sparkSession.createDataFrame([], PIECES)
    # Long texts come in runs, so few large tasks would end far apart.
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), 3).mapInPandas(cut, PIECES)


def split_settings(settings: DataFrame) -> list[tuple[str, int, int]]:
    """The 'split' rows; a fixed handful, which is checked."""
    rows = settings.where("purpose = 'split' and max_tokens > 0").select("setting_name", "max_tokens", F.coalesce("overlap_tokens", F.lit(0))).orderBy("setting_name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 settings")
    return [tuple(r) for r in rows]
