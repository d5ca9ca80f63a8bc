"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is removed if an earlier line (by doc_id, then place) has a word set of
Jaccard similarity ``THRESHOLD`` or more; lines without words always stay.

1. Words fall into ``BUCKETS`` hash buckets whose counts over all texts rank them: a
   word's key is its bucket's frequency class, then its hash, so sorted keys run
   from rare to common.  Any one order of all words makes the prefix filter exact.
2. Equal word sets become one row, that of their first line, with a number and the
   keys of the prefix: sets as similar as asked for share a key there.
3. Lists are by key and band of lengths.  A row stands in that of its own band with its
   whole prefix and finds there, as the longer one, rows of its band and of the band
   below; to be found, these bring only the few keys that a longer partner leaves
   needed.  A pair goes on if its lengths, the places of the key in both, and the
   parity bits of both sets allow the overlap needed; pairs that met on fewer keys
   than a similar pair must go.  Where over ``SHORT`` rows of a band bring a key, its rows are
   first held against the first row of their length; what matches is removed and
   needs no further partner.  Rows still unmatched meet those with the key whose
   length lies in their own or a neighbouring band.  The keys are joined in ``PASSES``
   parts; a pair's common keys are summed over the parts.
4. Pairs are verified on the words of both lines, each line's likeliest pair first.

Sets are told apart by 96 bits of hash; all similarities are taken on words.

Edge cases: null and empty texts have no lines to remove (a null stays null); very
long texts and lines are taken whole; null ids come before all others; documents of
one id are ordered by the hash of their text; identical rows (id and text) count
once and all get the same result; ties cannot occur, as places differ; an empty
table gives no rows.  Other columns of the input are ignored by ``find`` and kept by
``deduplicate``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, words

#: Jaccard similarity as a fraction.
THRESHOLD = (4, 5)
BUCKETS = 1 << 16
#: Bits by which documents without a line to verify are left out early.
DOC_BITS = 1 << 20
#: Rows of a band that bring a key and are met one by one, at most.
SHORT = 512
LEADER_ROUNDS = 2
#: Parts of the keys whose lists are joined one after the other: each takes its share of the disk.
PASSES = 2
#: Sets of more words than this have 128 parity bits instead of 64.
WIDE = 96
#: A set brings one key more than it must for each so many words: pairs of long sets then meet on several.
EXTRA = 64
_HASH_BITS = 57


def _spaced(text: Column) -> Column:
    """The text with a space for every blank but the line feed; null is empty.  Splitting at one character is the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _word_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def frequency_classes(docs: DataFrame, text_col: str) -> str:
    """The frequency class of every bucket as text, comma-separated: ``BUCKETS`` numbers, whatever the size of the corpus."""
    each = docs.select(F.explode(F.split(F.replace(_spaced(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = each.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    classes = materialize(counts.select("b", F.least(F.lit(62), F.floor(2 * F.log2(F.col("n") + 1))).cast("int").alias("k")), "classes")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(classes, "b", "left").na.fill(0, ["k"])
    part = F.sort_array(F.collect_list(F.struct("b", "k")))
    parts = every.groupBy(F.shiftright("b", 9).alias("p")).agg(F.array_join(F.transform(part, lambda x: x["k"].cast("string")), ",").alias("ks"))
    out = ",".join(r["ks"] for r in sorted(parts.collect(), key=lambda r: r["p"]))
    discard(classes)
    return out


def first_lines(docs: DataFrame, classes: str, id_col: str, text_col: str) -> DataFrame:
    """(sid, pos, n, lo, hi, prefix): the first line of every word set, numbered.

    ``pos`` is (doc_id, text hash, line number); ``prefix`` holds the rarest keys;
    ``lo`` and ``hi`` are parity bits (``hi`` is 0 in sets of up to ``WIDE`` words).
    """
    num, den = THRESHOLD
    # Folded by the optimizer to one constant array.  Of bytes: the driver holds its text in the description of every plan.
    table = F.expr(f"cast(split('{classes}', ',') as array<tinyint>)")
    lines = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.posexplode(F.split(_spaced(F.col(text_col)), "\n")).alias("ln", "line"))

    def key(w: Column) -> Column:
        h = F.xxhash64(w)
        # An array without nulls is sorted as plain longs.
        rank = F.coalesce(F.get(table, _bucket(h)).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(rank, _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))

    # Taking out the key of the empty word leaves each other key once.
    keys = F.sort_array(F.array_except(F.transform(F.split("line", " "), key), F.array(key(F.lit("")))))
    keyed = lines.select("d", "t", "ln", keys.alias("s"))

    def folded(bit) -> Column:
        return F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", bit(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    n = F.size("s")
    whole = folded(lambda x: F.lit(1).cast("long"))
    upper = F.when(n > WIDE, folded(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    length = (n - F.ceil(n * num / den) + 1).cast("int")
    rows = keyed.select(
        F.xxhash64("s").alias("s1"),
        F.hash("s", F.lit(1)).alias("s2"),
        F.struct(
            F.struct("d", "t", "ln").alias("pos"), n.alias("n"), whole.alias("whole"), upper.alias("hi"), F.slice("s", F.lit(1), length).alias("prefix")
        ).alias("x"),
    )
    # Lines without words go only here: a filter above would have all keys computed twice.
    firsts = rows.groupBy("s1", "s2").agg(F.min("x").alias("x")).where("x.n > 0")
    return firsts.select(F.monotonically_increasing_id().alias("sid"), "x.pos", "x.n", F.col("x.whole").bitwiseXOR(F.col("x.hi")).alias("lo"), "x.hi", "x.prefix")


def _allowed(a: str, b: str) -> Column:
    """Whether two rows that share a key can be similar, by length, place of the key and parity bits.

    All rows of a similar pair pass, not only that of its first common key.
    """
    num, den = THRESHOLD
    na, nb, ia, ib = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}i"), F.col(f"{b}i")
    both = na + nb
    length = (den * na >= num * nb) & (den * nb >= num * na)
    lo, hi = F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")), F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))
    differ = F.when(F.least(na, nb) > WIDE, F.bit_count(lo) + F.bit_count(hi)).otherwise(F.bit_count(lo.bitwiseXOR(hi)))
    place = (num + den) * (F.least(ia, ib) + F.least(na - ia, nb - ib)) >= num * both
    return length & ((num + den) * differ <= (den - num) * both) & place


def _band(n: Column) -> Column:
    """Lengths that a similar pair can have lie in the same or in neighbouring bands."""
    num, den = THRESHOLD
    return F.floor(F.log(n.cast("double")) / math.log(den / num)).cast("int")


def _overlap(na: Column, nb: Column) -> Column:
    """Words that a similar pair of these lengths has in common, at least."""
    num, den = THRESHOLD
    return F.ceil(num * (na + nb) / (num + den))


def _prefix(n: Column) -> Column:
    num, den = THRESHOLD
    return n - F.ceil(n * num / den) + 1


def _short_prefix(n: Column, band: Column) -> Column:
    """Keys by which a set of ``n`` words finds all similar sets of ``band`` that are no shorter; 0 if there can be none.

    The longer the other set, the more words must be common, the fewer keys will do.
    """
    num, den = THRESHOLD
    least = F.ceil(F.pow(F.lit(den / num), band) * (1 - 1e-9))  # of the band; a rounded length must not exceed it
    keys = n - _overlap(n, F.greatest(n, least)) + 1 + F.floor(n / EXTRA)
    return F.when(num * least <= den * n, F.least(keys, _prefix(n))).otherwise(0).cast("int")


def _needed(na: Column, nb: Column) -> Column:
    """Keys that a similar pair of these lengths meets on, at least.

    Of its prefix, each set lacks in the other no more words than the overlap spares;
    the rest of the prefix that ends at the rarer key lies in the other prefix.
    """
    n, m = F.least(na, nb), F.greatest(na, nb)
    both = _overlap(n, m)
    return F.least(_short_prefix(n, _band(m)) - n + both, _prefix(m) - m + both)


def _bit(d: Column, t: Column) -> Column:
    """A document's place in a bitmap of ``DOC_BITS`` bits, from 1: only then do buckets count from 1."""
    return F.pmod(F.xxhash64(d, t), F.lit(DOC_BITS)) + 1


def _maybe_in(bits: DataFrame, bit: Column) -> Column:
    """Column: whether ``bit`` is among the numbers ``b`` of a table; the bitmap's size doesn't depend on the table's."""
    parts = bits.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    size = 4096  # bytes of each part; parts count from 1
    whole = bytearray(DOC_BITS // 8)
    for r in parts:
        whole[(r["k"] - 1) * size : r["k"] * size] = r["m"]
    place = (F.bitmap_bucket_number(bit) - 1) * size + F.floor(F.bitmap_bit_position(bit) / 8) + 1
    byte = F.conv(F.hex(F.call_function("substring", F.lit(whole), place.cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.bitmap_bit_position(bit) % 8).cast("int"))) != 0


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(sid): sets that come second in a pair (a, b, c) of sets whose words are similar, as a table ``name``.

    Each set is first held against the earlier set with the largest ``c``; only sets
    that this leaves meet all others.
    """
    num, den = THRESHOLD
    at = firsts.select("sid", "pos")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(at, "sid")
    of_doc = materialize(wanted.groupBy("pos.d", "pos.t").agg(F.collect_list(F.struct("pos.ln", "sid")).alias("at")), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("d0"), F.xxhash64(text_col).alias("t0"), F.col(text_col).alias("_text"))
    texts = texts.where(_maybe_in(of_doc.select(_bit(F.col("d"), F.col("t")).alias("b")), _bit(F.col("d0"), F.col("t0"))))
    found = of_doc.join(texts.withColumn("_lines", _word_lines(F.col("_text"))).drop("_text"), F.col("d").eqNullSafe(F.col("d0")) & (F.col("t") == F.col("t0")))
    lines = found.select("d", "t", F.explode(F.transform("at", lambda x: F.struct(x["sid"].alias("sid"), x["ln"].alias("ln"), F.get("_lines", x["ln"]).alias("line")))).alias("x"))
    sets = lines.select("x.sid", F.struct("d", "t", "x.ln").alias("pos"), F.array_distinct(words(F.col("x.line"))).alias("w")).dropDuplicates(["sid"])
    sets = materialize(sets, "line_sets")
    at = sets.select("sid", "pos")
    placed = pairs.join(at.toDF("a", "pa"), "a").join(at.toDF("b", "pb"), "b")
    second = F.col("pa") > F.col("pb")
    placed = placed.select(F.when(second, F.col("a")).otherwise(F.col("b")).alias("sid"), F.when(second, F.col("b")).otherwise(F.col("a")).alias("other"), "c")
    placed = materialize(placed, "placed")

    def similar(rows: DataFrame) -> DataFrame:
        one = rows.join(sets.select("sid", F.col("w").alias("wa")), "sid")
        two = one.join(sets.select(F.col("sid").alias("other"), F.col("w").alias("wb")), "other")
        common = F.size(F.array_intersect("wa", "wb"))
        return two.where((num + den) * common >= num * (F.size("wa") + F.size("wb"))).select("sid").distinct()

    likeliest = placed.groupBy("sid").agg(F.max_by("other", "c").alias("other"))
    near = materialize(similar(likeliest), "nearest")
    left = placed.join(near, "sid", "left_anti")
    found = materialize(near.union(similar(left)), name)
    discard(sets, of_doc, placed, near)
    return found


_PARTS = ("sid", "n", "i", "lo", "hi")


def _listed(rows: DataFrame, *also: str) -> DataFrame:
    rows = rows.select(F.posexplode("prefix").alias("i", "key"), "sid", "n", "lo", "hi", *also)
    # A list is no longer than the count of its key's bucket.
    high = F.shiftright("key", _HASH_BITS) >= int(2 * math.log2(SHORT))
    return rows.select(F.hash("key").alias("k"), *_PARTS, *also, high.alias("high"))


def postings(firsts: DataFrame) -> DataFrame:
    """(k, i, sid, n, lo, hi, high): a row for every prefix key of every set; keys that occur often are ``high``."""
    return _listed(firsts)


def offers(firsts: DataFrame, *above: int) -> DataFrame:
    """(k, i, sid, n, lo, hi, band, high): the keys by which longer sets find a set, in bands so far above its own."""
    rows = firsts.withColumn("band", F.explode(F.array(*(_band(F.col("n")) + j for j in above))))
    return _listed(rows.withColumn("prefix", F.slice("prefix", F.lit(1), _short_prefix(F.col("n"), F.col("band")))), "band")


def _list_of(p: DataFrame, band: Column, s: str) -> DataFrame:
    """Rows by the number ``g`` of their list, a key and a band: one long is sorted by radix."""
    g = F.shiftleft(F.col("k").cast("long"), 8).bitwiseOR(band.cast("long"))
    return p.select(g.alias("g"), *(F.col(c).alias(f"{s}{c}") for c in _PARTS))


def _side(p: DataFrame, s: str, *also: str) -> DataFrame:
    return p.select("k", *also, *(F.col(c).alias(f"{s}{c}") for c in _PARTS))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) by number, the lengths, and the most that a common key's place leaves for the overlap."""
    rest = F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi"))
    return rows.select(F.least("xsid", "ysid").alias("a"), F.greatest("xsid", "ysid").alias("b"), F.col("xn") + F.col("yn"), _needed(F.col("xn"), F.col("yn")), rest).toDF("a", "b", "both", "needed", "rest")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of ``_met`` by pair, with the number ``c`` of keys that the pair met on."""
    return rows.groupBy("a", "b", "both", "needed").agg(F.count("*").alias("c"), F.max("rest").alias("rest"))


def _in_long_lists(every: DataFrame, long_lists: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(pairs met in long lists, tables of removed sets, tables to discard)."""
    hot = every.join(long_lists, "k", "left_semi").join(firsts.select("sid", "pos"), "sid")
    hot = materialize(hot.select("k", *_PARTS, "pos"), "hot")
    probes, heads, gone, spent = hot, hot, [], [hot]
    for turn in range(LEADER_ROUNDS):
        lead = heads.groupBy("k", "n").agg(F.min(F.struct("pos", "i", "lo", "hi", "sid")).alias("x"))
        lead = lead.select("k", F.col("n").alias("yn"), *(F.col(f"x.{c}").alias(f"y{c}") for c in ("i", "lo", "hi", "sid")))
        mine = _side(probes, "x").join(lead, "k").where((F.col("xn") == F.col("yn")) & (F.col("xsid") != F.col("ysid")) & _allowed("x", "y"))
        near = materialize(_met(mine).select("a", "b", F.lit(0).alias("c")).distinct(), "led")
        gone.append(verified(near, firsts, docs, id_col, text_col, f"leaders{turn}"))
        probes = materialize(probes.join(gone[-1], "sid", "left_anti"), f"probes{turn}")
        spent += [near, probes]
        led = lead.select(F.col("k").alias("lk"), F.col("ysid").alias("lsid"))
        heads = probes.join(led, (probes.k == led.lk) & (probes.sid == led.lsid), "left_anti")
    mine = _side(probes.withColumn("xpos", F.col("pos")), "x", "xpos").withColumn("band", F.explode(F.array(*(_band(F.col("xn")) + j for j in (-1, 0, 1)))))
    theirs = _side(hot.withColumn("ypos", F.col("pos")), "y", "ypos").withColumn("band", _band(F.col("yn")))
    rest = mine.join(theirs, ["k", "band"]).where((F.col("ypos") < F.col("xpos")) & _allowed("x", "y"))
    return _met(rest), gone, spent


def matched(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid): the sets that a similar set precedes."""
    every = postings(firsts)
    counts = offers(firsts, 0).where("high").groupBy("k", "band").agg(F.count("*").alias("c"))
    long_lists = materialize(counts.where(F.col("c") > SHORT).select("k").distinct(), "long_lists")
    gone, spent, longer, shorter, parts = [], [long_lists], every, offers(firsts, 0, 1), []
    if not long_lists.isEmpty():
        hot_pairs, gone, more = _in_long_lists(every, long_lists, firsts, docs, id_col, text_col)
        spent += more
        longer, shorter = longer.join(long_lists, "k", "left_anti"), shorter.join(long_lists, "k", "left_anti")
        # A pair's later set is either removed by now or has met all its partners, so counts below are whole where they matter.
        parts.append(materialize(_counted(hot_pairs), "met"))
    order = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xsid") < F.col("ysid")))
    for turn in range(PASSES):
        mine = F.pmod("k", F.lit(PASSES)) == turn
        x, y = _list_of(shorter.where(mine), F.col("band"), "x"), _list_of(longer.where(mine), _band(F.col("n")), "y")
        parts.append(materialize(_counted(_met(x.join(y, "g").where(order & _allowed("x", "y")))), "met"))
    num, den = THRESHOLD
    pairs = reduce(DataFrame.union, parts).groupBy("a", "b", "both", "needed").agg(F.sum("c").alias("c"), F.max("rest").alias("rest"))
    pairs = pairs.where((F.col("c") >= F.col("needed")) & ((num + den) * F.col("rest") >= num * F.col("both")))
    pairs = materialize(pairs.select("a", "b", "c"), "pairs")
    gone.append(verified(pairs, firsts, docs, id_col, text_col, "similar"))
    later = materialize(reduce(DataFrame.union, gone).distinct(), "later")
    discard(pairs, *parts, *spent, *gone)
    return later


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, kept): per document with a line that stays, the numbers of those lines.

    ``d`` is the id, ``t`` the hash of the text; lines without words are not listed.
    """
    firsts = materialize(first_lines(docs, frequency_classes(docs, text_col), id_col, text_col), "firsts")
    later = matched(docs, firsts, id_col, text_col)
    stay = firsts.select("sid", "pos").join(later, "sid", "left_anti")
    kept = materialize(stay.groupBy("pos.d", "pos.t").agg(F.collect_list("pos.ln").alias("kept")), "kept")
    discard(firsts, later)
    return kept


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus ``{prefix}n_lines`` and ``{prefix}n_removed``.

    ``n_lines`` counts the lines that hold a word.
    """
    kept = find(docs, id_col, text_col).select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("kept").alias("_kept"))
    # The input's columns get numbers meanwhile, so none can clash with those of this join.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    text, at = F.col(names[text_col]), F.col(names[id_col])
    keyed = own.withColumns({"_id": at.cast("long"), "_hash": F.xxhash64(text), "_lines": _word_lines(text)})
    joined = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")), "left")
    blank = F.filter(F.transform("_lines", lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    joined = joined.withColumn("_blank", blank).withColumn("_kept", F.coalesce("_kept", F.array().cast("array<int>")))
    left = F.array_join(F.transform(F.sort_array(F.concat("_kept", "_blank")), lambda i: F.get("_lines", i)), "\n")
    n_lines = F.size("_lines") - F.size("_blank")
    out = {c: F.col(n) for c, n in names.items()} | {text_col: F.when(text.isNotNull(), left)}
    return joined.select(
        *(v.alias(c) for c, v in out.items()),
        n_lines.cast("long").alias(f"{prefix}n_lines"),
        (n_lines - F.size("_kept")).cast("long").alias(f"{prefix}n_removed"),
    )
