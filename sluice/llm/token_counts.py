"""Exact token counts of texts and of all their prefixes, for SentencePiece BPE models.

Prefix dynamic programming.  No piece of such a model spans the step from a
visible character to a blank, nor a line feed, so a text falls into segments
(blanks with the visible characters after them) whose tokens never merge:

    count[end of segment k] = count[end of segment k-1] + tokens(segment k)

``PrefixCounts`` stores this table for a text, and ``inside`` carries it on to
every code point within a segment, again without encoding the prefixes: the
tokens of a prefix are the tokens of a shorter prefix plus one last token that
is compatible with the token before it.  A truncation or budget question is one
binary search plus one such segment.

Edge cases: null and empty texts have no bytes and no tokens; very long texts have
their whole table in one task's memory, two numbers a segment; segments that are
long themselves are not remembered; repeated rows give repeated result rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_of, ship

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Segments whose token counts a Python worker keeps at once (two generations).
CACHE = 300_000


class SegmentCounter:
    """Token counts of texts for one SentencePiece BPE model."""

    _open: dict[str, SegmentCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = [p for p in self.pieces if BLANK in p.lstrip(BLANK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces span segments: {crossing[:5]}")
        self.ids = {p: i for i, p in enumerate(self.pieces) if not self.sp.is_byte(i) and not self.sp.is_control(i)}
        self.longest = max(map(len, self.ids))
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def open(cls, path: str) -> SegmentCounter:
        """One counter per file and Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def segments(self, text: str) -> list[str]:
        """The segments of a text in order; ``\\n`` is one of its own.

        A segment is as the model sees it, with blanks as spaces; the model puts
        one space before the text.
        """
        if not text:
            return []
        text = " " + text.replace(BLANK, " ")
        return re.findall(r"\n| *[^ \n]+| +", text)

    def learn(self, segments: list[str]) -> None:
        """Look segments up that have no count yet."""
        # The library puts a space before each text: it stands for the segment's own
        # first blank, or, before a line feed that takes two tokens, for none.
        asked = [s[1:] if s[0] == " " else "\n" + s for s in segments]
        got = self.sp.encode(asked, num_threads=1)
        if len(self.new) + len(got) > CACHE:
            self.old, self.new = self.new, {}
        for s, ids, a in zip(segments, got, asked, strict=True):
            # A lone blank before the end is asked as the empty text, which has no tokens.
            self.new[s] = 1 if not a else len(ids) - 2 * (s[0] != " ")

    def counts(self, text: str) -> list[int]:
        """Tokens of each segment."""
        segments, new, old = self.segments(text), self.new, self.old
        while True:
            try:
                return [new[s] for s in segments]
            except KeyError:
                missing = [s for s in dict.fromkeys(segments) if s not in new]
                for s in missing:
                    if s in old:
                        new[s] = old[s]
                self.learn([s for s in missing if s not in new] or missing)
                if new is not self.new:  # a generation ended: keep what this text needs
                    for s in segments:
                        if s not in self.new and (known := new.get(s, old.get(s))) is not None:
                            self.new[s] = known
                new, old = self.new, self.old

    def total(self, text: str) -> int:
        return sum(self.counts(text))

    # -- within a segment ---------------------------------------------------

    def inside(self, segment: str) -> list[int]:
        """Exact token counts of the segment's prefixes of 0, 1, 2 ... code points.

        ``last[i]`` is the last token of the encoding of the first i code points;
        the one token that ends there and is compatible with ``last`` at its
        start extends that encoding.
        """
        if segment == "\n":
            return [0, len(self.encode(segment))]
        s = segment.replace(" ", BLANK)
        n = len(s)
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                token = s[j:i]
                if token in self.ids and self.encode(token) == (token,) and (j == 0 or self.compatible(last[j], token)):
                    count[i], last[i] = count[j] + 1, token
                    break
            else:  # a character without a piece falls to bytes, which never merge
                count[i], last[i] = count[i - 1] + len(s[i - 1].encode()), ""
        return count

    def encode(self, s: str) -> tuple[str, ...]:
        """Pieces of a string as it stands, without the space the library adds."""
        ids = self.sp.encode("\n" + s.replace(BLANK, " "))
        return tuple(self.pieces[i] for i in ids[2:])

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are when they stand side by side."""
        return not left or self.encode(left + right) == (left, right)


class PrefixCounts:
    """The prefix table of one text."""

    def __init__(self, counter: SegmentCounter, text: str | None):
        self.counter, self.text = counter, text or ""
        self.segments = counter.segments(self.text)
        counts = np.array(counter.counts(self.text), np.int64)
        lengths = np.fromiter(map(len, self.segments), np.int64, len(self.segments))
        #: Tokens and code points before each segment, and after the last.
        self.tokens = np.concatenate([[0], np.cumsum(counts)])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])  # counts the leading blank
        self.total = int(self.tokens[-1])

    def at(self, chars: int) -> int:
        """Exact token count of the first ``chars`` code points."""
        if chars <= 0:
            return 0
        at = min(chars, len(self.text)) + 1
        k = int(np.searchsorted(self.ends, at, "right")) - 1
        if self.ends[k] == at:
            return int(self.tokens[k])
        return int(self.tokens[k]) + self.counter.inside(self.segments[k])[at - int(self.ends[k])]

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.tokens, budget, "right")) - 1
        inner = self.counter.inside(self.segments[k])
        room = budget - int(self.tokens[k])
        most = max(i for i, c in enumerate(inner) if c <= room)
        return max(0, int(self.ends[k]) + most - 1)


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: doc_id, ends, tokens: the table that answers any later prefix or budget question.

    ``tokens[k]`` is the exact token count of the first ``ends[k]`` code points, at the
    end of every segment; both begin with 0.
    """
    ship(docs.sparkSession)
    path = model or file_of(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SegmentCounter.open(path)
        kind = pa.list_(pa.int64())
        for b in batches:
            tables = [PrefixCounts(counter, (t.as_py() or b"").decode("utf-8", "replace")) for t in b.column(1)]
            # The library's own blank before the text is no prefix of it.
            ends, tokens = ([np.maximum(t.ends - 1, 0) for t in tables], [np.where(t.ends > 1, t.tokens, 0) for t in tables])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, kind), pa.array(tokens, kind)], ["doc_id", "ends", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, ends array<long>, tokens array<long>")


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model: str | None = None
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens (the last cell of its prefix table), over_limit, fit_chars.

    ``fit_chars``: code points of the longest prefix of at most ``limit`` tokens.
    """
    ship(docs.sparkSession)
    path = model or file_of(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SegmentCounter.open(path)
        for b in batches:
            n_bytes, n_tokens, fit = [], [], []
            for value in b.column(1):
                raw = value.as_py() or b""
                table = PrefixCounts(counter, raw.decode("utf-8", "replace"))
                n_bytes.append(len(raw))
                n_tokens.append(table.total)
                fit.append(table.fit(limit))
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
