"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Every document becomes its token ids and one end id.  Only documents longer than
the sequence length are cut, into pieces of that length and a rest.

1. Histogram.  One pass over the texts gives the pieces and how many there are
   of each length: at most ``max_len`` numbers, whatever the size of the corpus.
2. Patterns.  A length class is a range of ``grid`` lengths; patterns are the
   multisets of up to ``depth`` classes whose upper ends fill a sequence exactly.
3. Fit.  Non-negative least squares finds how often each pattern repeats so that
   the classes used match the histogram; the counts are rounded down.
4. Patterns are filled, longest pieces first, never beyond what is there; the
   room that a pattern leaves, and all residual pieces, go by best fit on the
   histogram (longest first into the fullest sequence with room), which works on
   counts of equal sequences, not on single documents.
5. A plan row says: the pieces of length L numbered from r on lie in the sequences
   numbered from s on, at offset o.  Pieces get their number within a length
   from per-task counts, so no length, however common, meets in one task.

Edge cases: a null or empty text is the end id alone; a null id is kept; repeated
rows are packed each on its own; an empty table gives no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_of, materialize, ship

TOKENIZER, END_ID, MAX_LEN = "word_bpe_49k.json", 1, 4096
#: Words and letter runs whose ids a Python worker keeps at once (words: two generations).
CACHE = 400_000
#: How a tokenizer file must normalise and split for its words to be independent of each other.
_NORMALIZERS, _SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids by a word-level BPE of the ``tokenizers`` library, with a memory of words.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are those of its blank-separated words in order.  Words of ASCII and Latin
    letters and common punctuation, which normalise character by character, are
    split by the file's own pattern and each run goes to its BPE model; all other
    words go through the whole tokenizer.  Files that normalise or split in another
    way are refused.
    """

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        import regex
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.model = self.tok.model
        made = json.loads(Path(path).read_text())
        steps = [(made.get("normalizer") or {}).get("normalizers", []), (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        split, level = (steps[1] + [{}, {}])[:2]
        if [[x["type"] for x in part] for part in steps] != [_NORMALIZERS, _SPLITTERS] or not split.get("invert") or level.get("add_prefix_space"):
            raise ValueError(f"{path} normalises or splits words in a way that isn't known here")
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        pattern = split["pattern"]["Regex"]
        self.runs = regex.compile(pattern).findall
        #: The same pattern for lower-case ASCII, where the faster module can stand in.
        self.ascii_runs = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        self.plain = re.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]+").fullmatch
        self.alphabet = _byte_alphabet()
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.run_ids: dict[str, bytes] = {}

    @classmethod
    def open(cls, path: str) -> WordIds:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self.plain(text) and not (self.special and self.special.search(text)):
            found, out = self.run_ids, []
            for run in (self.ascii_runs if text.isascii() else self.runs)(text.lower()):
                ids = found.get(run)
                if ids is None:
                    if len(found) >= CACHE:
                        found.clear()
                    spelt = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
                    ids = found[run] = self.pack([t.id for t in self.model.tokenize(spelt)])
                out.append(ids)
            return b"".join(out)
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        words, known = text.split(), self.words
        parts = list(map(known.get, words))
        if None in parts:
            if len(known) > CACHE:
                self.old, self.words = known, {}
                known = self.words
            old = self.old
            for i, ids in enumerate(parts):
                if ids is None:
                    w = words[i]
                    if (ids := known.get(w)) is None:
                        ids = known[w] = old.get(w) or self.word(w)
                    parts[i] = ids
        return b"".join(parts)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth numbers a task's pieces of one length."""
    ship(docs.sparkSession)
    path = tokenizer or file_of(TOKENIZER)
    end = struct.pack("<I", end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = WordIds.open(path), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.ids(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    length = len(part) // 4
                    rows.append((doc, k, at // 4, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def patterns(classes: int, depth: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` classes 1..classes that sum to ``classes``, fewest parts first, at most ``most``.

    The bound keeps the least-squares problem small; what no pattern covers is
    residual, and residual pieces are packed exactly.
    """
    found: list[tuple[int, ...]] = []

    def extend(left: int, least: int, parts: int, so_far: tuple[int, ...]) -> None:
        if parts == 1:
            if left >= least and len(found) < most:
                found.append((*so_far, left))
            return
        for x in range(least, left // parts + 1):
            extend(left - x, x, parts - 1, (*so_far, x))

    for parts in range(2, depth + 1):
        extend(classes, 1, parts, ())
    return found


def non_negative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by accelerated projected gradient."""
    if not a.size:
        return np.zeros(a.shape[1])
    step = 1.0 / max(np.linalg.norm(a @ a.T, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def plan(histogram: dict[int, int], max_len: int = MAX_LEN, grid: int = 32, depth: int = 3, most: int = 20_000) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first, count, sequence, offset) for a histogram of piece lengths.

    The pieces numbered first .. first+count-1 of a length lie in as many
    sequences, numbered on from ``sequence``, each at ``offset``.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    given: Counter[int] = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    #: room -> runs (first sequence, how many) of sequences with that much room
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted

    def put(length: int, count: int, sequence: int, room: int) -> None:
        rows.append((length, given[length], count, sequence, max_len - room))
        given[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    def reopen(room: int, sequence: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in open_runs:
                open_runs[room] = []
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            open_runs[room].append((sequence, count))

    if whole := left.get(max_len):
        put(max_len, whole, sequences, max_len)
        sequences += whole

    lengths = sorted(left)

    def lengths_upto(top: int) -> Iterator[int]:
        return (lengths[i] for i in range(int(np.searchsorted(lengths, top, "right")) - 1, -1, -1))

    # Patterns on classes; class k holds lengths (k-1)*grid+1 .. k*grid.
    classes = max_len // grid
    by_class: dict[int, list[int]] = {}
    for n in sorted(left):
        by_class.setdefault(-(-n // grid), []).append(n)
    tried = [p for p in patterns(classes, depth, most) if all(k in by_class for k in p)]
    if tried:
        a = np.zeros((classes + 1, len(tried)))
        for j, p in enumerate(tried):
            for k in p:
                a[k, j] += 1
        b = np.zeros(classes + 1)
        for k, members in by_class.items():
            b[k] = sum(left[n] for n in members)
        for j, times in sorted(enumerate(np.floor(non_negative_fit(a, b))), key=lambda x: -x[1]):
            todo = int(times)
            while todo > 0:
                picked, used, room = [], Counter(), max_len
                for k in reversed(tried[j]):  # longest of the class first; the last takes the room left
                    top = room if len(picked) == len(tried[j]) - 1 else k * grid
                    n = next((n for n in lengths_upto(top) if left.get(n, 0) > used[n]), None)
                    if n is None or n <= (k - 1) * grid:
                        break
                    picked.append(n)
                    used[n] += 1
                    room -= n
                if len(picked) < len(tried[j]):
                    break
                count = min([todo, *(left[n] // c for n, c in used.items())])
                room = max_len
                for n in picked:
                    put(n, count, sequences, room)
                    room -= n
                reopen(room, sequences, count)
                sequences += count
                todo -= count

    # Residual pieces and the patterns' spare room: best fit, longest first.
    for n in sorted(left, reverse=True):
        while left.get(n, 0):
            at = int(np.searchsorted(rooms, n))
            if at == len(rooms):
                per = max_len // n
                count = max(1, left[n] // per) if per > 1 else left[n]
                filled = min(per, left[n])
                for k in range(filled):
                    put(n, count, sequences, max_len - k * n)
                reopen(max_len - filled * n, sequences, count)
                sequences += count
                continue
            room = rooms[at]
            sequence, there = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room], rooms[at]
            per = min(room // n, left[n])
            count = min(there, left[n] // per)
            for k in range(per):
                put(n, count, sequence, room - k * n)
            reopen(room - per * n, sequence, count)
            reopen(room, sequence + count, there - count)
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, max_len, tokenizer, end_id), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    # A length has one count per task; counts add up to where each task's numbers begin.
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, first, count, sequence, offset in plan(histogram, max_len):
        by_length.setdefault(length, []).append((first, sequence, offset))
    table = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in by_length.items()}
    sent = spark.sparkContext.broadcast(table)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n in np.unique(length):
                first, at, place = sent.value[int(n)]
                mine = np.flatnonzero(length == n)
                k = np.searchsorted(first, nth[mine], "right") - 1
                sequence[mine] = at[k] + nth[mine] - first[k]
                offset[mine] = place[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [f.split()[0] for f in schema.split(", ")])

    numbered = cut.join(begins, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    return numbered.mapInArrow(place, schema)
