"""Line dedup by a segment-partition edit join.

Two distinct lines are linked if their edit distance is at most the threshold
of the shorter one: a sixteenth of its length, at least 1 and at most ``MOST``
(or one number for all lines). Lines shorter than ``shortest`` only equal
themselves. Lengths fall into classes of one threshold *t*. If *t* + 1 segments
are cut from the shorter line, the longer one has one of them as a substring,
with as many edits before it as segments stand before it. The first half of the
segments is cut from the start of the line and the others from its end, so that
a segment is shifted by at most as many places as segments stand between it and
the end it is cut from, whatever the lengths. Each line is
indexed under the segments of its class, probes its own class and the one below
with the substrings that can be aligned, and the pairs that meet are verified
by banded bit-parallel edit distance.

Most segments are in one line only. A blocked Bloom filter of all segments lets
through the substrings that may be one, and a second one the segments that two
lines have or a substring that came through may meet, so that few of either are shuffled. Of the
segments that linked lines share, one, the *i*-th, has *i* edits before it and
at most *t* - *i* after it. So each segment carries the counts of the most
frequent characters in two parts on either side of it, one next to it and one at
the end of the line; two lines meet there only if either side differs by no more
than its own share of the edits allows (lengths are compared first, before any
line is read again for its counts), and a segment
stays with a line only if another line meets it there, so that lines which share
no more than a phrase, and near copies of one text that are too far apart, are
neither paired nor moved again. Lines that share a
segment are compared with the earliest of them first; those linked with it go
and need no other comparison. Only lines that are left after ``ROUNDS`` such
rounds are compared with all earlier lines of the segment.

A line of a document goes if an equal or a linked line comes earlier (by
document id, then line number) in any document. Lines without a word are
neither compared nor removed. Only DataFrame functions run here.

Lines are compared once per distinct text, found with map-side aggregation, so
a line that is in a third of all documents is one row. Distinct lines and texts
are told apart by 128-bit hashes.

Edge cases: a null text stays null; a text all of whose lines go is empty.
Rows with equal id and text count as one document and lose the same lines. A
null id comes first. Extra columns stay as they are, whatever their names, but
for columns called ``__n_lines`` and ``__n_removed``, which are replaced. An
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import WORD, let, removed, written

MOST = 8  # edits that replace, drop or add one word
SHORTEST = 24  # default of ``shortest``: in shorter lines one edit is a word
#: Rounds in which the lines of a segment meet its earliest line before they meet all others.
ROUNDS = 2
#: Pairs up to which the ids of their lines are broadcast (some 64 bytes each).
FEW_PAIRS = 500_000
#: Characters whose counts must nearly agree before a pair is made.
COUNTED = " etaoinsrhldcumg"
#: Most characters of a part of a line in which they are counted.
PART = 256
#: Parts of a line beside a segment: the start of the line, what comes before and after the segment, and the end of the line.
BEFORE, AFTER = ("start", "before"), ("after", "end")
KEY_BITS = 48  # of the hash of a segment; shorter keys shuffle in fewer bytes, and pairs are verified anyway
_BITS = 62  # width of the bit vectors; additions stay within a signed 64-bit number
_LONGEST = 1 << 13  # lines from here on are one class


def limit(n: int, threshold: int | None = None) -> int:
    """Most edits between linked lines the shorter of which has ``n`` characters."""
    return max(1, min(MOST, n // 16)) if threshold is None else threshold


def classes(threshold: int | None = None, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(shortest length, threshold) of the classes; each is at least as wide as its threshold, so a line probes two."""
    out, lo = [], shortest
    while not out or lo <= _LONGEST:
        t = limit(lo, threshold)
        out.append((lo, t))
        lo = max(lo + max(lo // 4, t), shortest) if threshold is not None or t == MOST else (t + 1) * 16
    return out


def _shifts(threshold: int) -> list[tuple[int, int]]:
    """(i, shift) under which a line probes a class.

    Take the last segment *i* with at least *i* edits before it: it is whole, with *i* edits before it and at most
    ``threshold - i`` after it. Its distance from the start of the line changes by no more than the former, that from
    the end by no more than the latter.
    """
    return [(i, shift) for i in range(threshold + 1) for shift in range(-min(i, threshold - i), min(i, threshold - i) + 1)]


def _of_class(values: list[int]) -> Column:
    """What the list says for the class of a row."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("class") + 1)


def _keyed(sized: DataFrame, known: list[tuple[int, int]], ways: Callable[[int], list[tuple[int, int]]], where: Column | None = None) -> DataFrame:
    """(key, lid, n, class, i, at): hashes of class, number and text of segments, the class, their number and place, cut from lines
    (lid, line, raw, n, class, own) in the ways (i, shift) that ``where`` (a condition on shift and own) lets through.

    One row per way comes first and one small expression makes its key, which the JVM compiles; all keys of a line in
    one expression are too large for that, and so is the code of a task that does more here than it must. Where every character is one byte, segments are cut from the bytes (raw), as a
    cut from a string counts its characters from the first; equal segments have the same bytes either way.
    """
    choice = None
    for t in sorted({t for _, t in known}):
        # shift from where the segment stands if it is cut from the start, and places from the end if it is cut from there
        own = F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.lit(shift).alias("shift"), F.lit(i if 2 * i <= t else i - t - 1).alias("sizes"), F.lit(2 * i > t).alias("back")) for i, shift in ways(t)])
        at = F.col("t") == t
        choice = F.when(at, own) if choice is None else choice.when(at, own)
    rows = sized.select("lid", "line", "raw", "n", "class", "own", _of_class([t for _, t in known]).alias("t"), _of_class([lo // (t + 1) for lo, t in known]).alias("size"))
    rows = rows.select("lid", "line", "raw", "n", "class", "own", "size", (F.length("raw") == F.col("n")).alias("narrow"), F.explode(choice).alias("w"))
    rows = rows if where is None else rows.where(where)
    at = F.when(F.col("w.back"), F.col("n")).otherwise(F.lit(0)) + F.col("w.sizes") * F.col("size") + F.col("w.shift")
    rows = rows.select("lid", "line", "raw", "n", "class", "size", "narrow", F.col("w.i").alias("i"), at.alias("at"))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n"))
    cut = lambda c: F.col(c).substr(F.col("at") + 1, F.col("size"))
    segment = F.when(F.col("narrow"), cut("raw")).otherwise(cut("line").cast("binary"))
    key = F.xxhash64("class", "i", segment).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    return rows.where(fits).select(key.alias("key"), "lid", "n", F.col("class").cast("byte").alias("class"), "i", "at")


def _most(n: Column, threshold: int | None) -> Column:
    """``limit`` as a column."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST), F.floor(n / 16).cast("int"))) if threshold is None else F.lit(threshold)


def _counts(text: Column) -> Column:
    """How often each of ``COUNTED`` is in a text, in four bits each.

    The bits are those of a ring of 8 counts of which neighbours differ by one bit, so the bits that differ between two
    texts are at most as many as the counts differ by.
    """
    ring = F.array(*[F.lit((1 << k) - 1 if k < 4 else 0xF & (0xF << (k - 4))).cast("bigint") for k in range(8)])
    total = F.lit(0).cast("bigint")
    for k, letter in enumerate(COUNTED):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(F.element_at(ring, count.bitwiseAND(F.lit(7)) + 1), 4 * k))
    return total


def _beside(shared: DataFrame, lines: DataFrame, known: list[tuple[int, int]]) -> DataFrame:
    """Rows of ``_shared_keys`` with the counts of characters in the parts beside the segment, and all columns of ``lines`` but the line.

    A part has half the characters that any line that is linked by the segment has on that side.
    Parts do not overlap and each begins or ends with the segment or the line, so an edit is in one of them at most: it
    takes one character from it and adds one, itself or by what it moves over the other end of the part.
    """
    rows = shared.withColumns({"t": _of_class([t for _, t in known]), "size": _of_class([lo // (t + 1) for lo, t in known]), "least": _of_class([lo for lo, _ in known])})
    before, after = F.col("i").cast("int"), F.col("t") - F.col("i")  # segments there; as many edits at most
    half = lambda c: F.least(F.lit(PART), F.greatest(F.lit(0), F.floor(c / 2).cast("int")))
    near = lambda k: half(k * (F.col("size") - 1))
    across = lambda k, other: half(F.col("least") - (other + 1) * F.col("size") - k)
    from_start = 2 * before <= F.col("t")
    rows = rows.withColumns({"left": F.when(from_start, near(before)).otherwise(across(before, after)),
                             "right": F.when(from_start, across(after, before)).otherwise(near(after))})
    rows = rows.join(lines, "lid")
    at, left, right = F.col("at"), F.col("left"), F.col("right")
    cut = lambda skipped, length: F.substr("line", skipped + 1, length)
    parts = [cut(F.lit(0), left), cut(at - left, left), cut(at + F.col("size"), right), cut(F.col("n") - right, right)]
    others = [c for c in lines.columns if c not in ("lid", "line")]
    # one function for all parts: written out for each, the code is too long for the JVM to compile
    rows = rows.select("key", "lid", "n", "entry", "i", "at", *others, F.transform(F.array(*parts), _counts).alias("counts"))
    return rows.select("*", *[F.get("counts", F.lit(k)).alias(name) for k, name in enumerate(BEFORE + AFTER)]).drop("counts")


def _side_near(parts: tuple[str, str], x: Column, y: Column, edits: Column) -> Column:
    """Whether one side of a segment (its length in either line, its counts) differs by at most what so many edits can change."""
    bits = sum((F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}"))) for name in parts), F.lit(0))
    return (F.abs(x - y) <= edits) & (bits <= 2 * edits)  # an edit changes two counts; without parts, edits are not below 0


def _pieces_near(a: Column, b: Column, most: Column) -> Column:
    """Whether of twice ``most`` + 2 pieces of line a all but ``most`` are in line b, within ``most`` places: an edit takes one piece."""
    def found(p: Column) -> Column:
        size = F.floor(F.length(p["a"]) / p["n"]).cast("int").alias("size")

        def seen(q: Column, k: Column) -> Column:
            at = k * q["size"]  # characters before the piece; what lies before the line is cut off
            lo, hi = F.greatest(F.lit(0), at - q["most"]), at + q["size"] + q["most"]
            return F.substr(q["b"], lo + 1, hi - lo).contains(F.substr(q["a"], at + 1, q["size"])).cast("int")

        row = F.struct(p["a"].alias("a"), p["b"].alias("b"), p["most"].alias("most"), p["n"].alias("n"), size)
        return let(row, lambda q: F.aggregate(F.sequence(F.lit(0), q["n"] - 1), F.lit(0), lambda total, k: total + seen(q, k)))

    return let(F.struct(a.alias("a"), b.alias("b"), (2 * most + 2).alias("n"), most.alias("most")), lambda p: found(p) >= p["n"] - p["most"])


def _unlike(a: Column, b: Column) -> Column:
    """Two lines without their common beginning and their common end (a, b): their edit distance is that of the lines."""
    steps = F.array(*[F.lit(1 << k) for k in range(_LONGEST.bit_length(), -1, -1)])

    def common(x: Column, y: Column) -> Column:  # how many characters at the start are the same, found by halving steps
        return F.aggregate(steps, F.lit(0), lambda at, k: F.when(
            (at + k <= F.least(F.length(x), F.length(y))) & (F.substr(x, at + 1, k) == F.substr(y, at + 1, k)), at + k).otherwise(at))

    def tails(p: Column, cut: Column) -> Column:
        return F.struct(F.substr(p["a"], cut + 1).alias("a"), F.substr(p["b"], cut + 1).alias("b"))

    def trimmed(p: Column) -> Column:
        return let(common(p["a"], p["b"]), lambda cut: tails(p, cut))

    back = let(trimmed(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b")))
    return let(back, trimmed)


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two lines if at most ``threshold`` (under 30), else a larger number.

    One bit vector holds the vertical differences of the cells within ``threshold`` of the diagonal; it moves down one
    row with each character of the second line.
    """
    mask, top = (1 << _BITS) - 1, 1 << (_BITS - 1)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    long_ = lambda x: F.lit(x).cast("bigint")

    def of(first: Column, second: Column) -> Column:
        n, m = F.size(first), F.size(second)

        def step(state: Column, char: Column) -> Column:
            at = state["j"]
            matches = long_(0)
            for d in range(-threshold, threshold + 1):  # bit of row j + d
                hit = F.coalesce(F.get(first, at + d) == char, F.lit(False))
                matches = matches.bitwiseOR(F.when(hit, long_(1 << (_BITS - 1 - threshold + d))).otherwise(long_(0)))

            def column(x: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(long_(mask))
                return let(d0, lambda d: let(vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(long_(mask))), lambda hp: next_state(d, hp, d.bitwiseAND(vp))))

            def next_state(d: Column, hp: Column, hn: Column) -> Column:
                down = F.shiftrightunsigned(d, 1)
                diagonal = at < n - threshold  # the lower edge of the band still moves along the diagonal
                edge = F.call_function("shiftrightunsigned", long_(top >> 1), F.greatest(F.lit(0), at - (n - threshold)))
                gain = F.when(diagonal, (d.bitwiseAND(long_(top)) == 0).cast("int")).otherwise(
                    (hp.bitwiseAND(edge) != 0).cast("int") - (hn.bitwiseAND(edge) != 0).cast("int"))
                return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(long_(mask))).alias("vp"),
                                down.bitwiseAND(hp).alias("vn"), (state["distance"] + gain).cast("int").alias("distance"), (at + 1).cast("int").alias("j"))

            return let(matches, column)

        first_state = F.struct(long_(mask & ~((1 << (_BITS - threshold - 1)) - 1)).alias("vp"), long_(0).alias("vn"),
                               F.lit(threshold).cast("int").alias("distance"), F.lit(0).cast("int").alias("j"))
        far = F.lit(threshold + 1)
        return F.when(F.abs(n - m) > threshold, far).when(F.least(n, m) <= threshold, F.levenshtein(F.concat_ws("", first), F.concat_ws("", second))).otherwise(
            F.aggregate(second, first_state, step, lambda s: s["distance"]))

    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), lambda p: of(p["a"], p["b"]))


def _shared_keys(lines: DataFrame, threshold: int | None, shortest: int) -> DataFrame:
    """(key, lid, n, class, i, at, entry): the segments (entry) and aligned substrings of lines (lid, line) under keys that two lines may share."""
    known = classes(threshold, shortest)
    rows = lines.select("lid", "line", F.col("line").cast("binary").alias("raw"), F.length("line").alias("n")).where(F.col("n") >= shortest)
    own = sum(((F.col("n") >= lo).cast("int") for lo, _ in known[1:]), F.lit(0))
    sized = rows.select("lid", "line", "raw", "n", own.alias("class"))
    # the class below is probed too if a line of it can be linked
    ends = F.element_at(F.array(*[F.lit(lo - 1 + t) for (lo, _), (_, t) in zip(known[1:], known)]), F.col("class")) if len(known) > 1 else F.lit(-1)
    below = F.when(F.col("class") == 0, False).otherwise(F.col("n") <= ends)
    probed = sized.withColumn("own", F.explode(F.when(below, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    probed = probed.withColumn("class", F.when(F.col("own"), F.col("class")).otherwise(F.col("class") - 1))

    entries = _keyed(sized.withColumn("own", F.lit(True)), known, lambda t: [(i, 0) for i in range(t + 1)])
    probes = _keyed(probed, known, _shifts, ~(F.col("own") & (F.col("w.shift") == 0)))  # the others are the entries themselves

    sizes = F.element_at(F.array(*[F.lit(t + 1) for _, t in known]), F.col("class") + 1)
    n_blocks = bloom.blocks_for(sized.agg(F.sum(sizes)).first()[0] or 0)
    # one task sees all entries of a key, so it knows whether there are several
    dealt = entries.select(bloom.block_of(F.col("key"), n_blocks).alias("block"), "key").repartition("block")
    counted = dealt.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"))
    filters = written(bloom.fold(counted, {"any": None, "several": F.col("n") > 1}), "segments")

    hits = bloom.passing(probes, "key", [(filters, n_blocks, "any")])
    hits = written(hits.withColumn("entry", F.lit(False)), "probes")
    # one filter of what several lines have and of what is probed: looking up two makes the code of a task too long for the JVM to compile
    wanted = [bloom.bloom_filter(hits, n_blocks, prefix="met"), filters.select("block", *[F.col(c).alias(to) for c, to in zip(bloom.longs("several"), bloom.longs("met"))])]
    wanted = written(wanted[0].unionByName(wanted[1]).groupBy("block").agg(*[F.bit_or(c).alias(c) for c in bloom.longs("met")]), "met")
    met = written(bloom.passing(entries, "key", [(wanted, n_blocks, "met")]).withColumn("entry", F.lit(True)), "entries")
    removed(filters, wanted)
    return hits.unionByName(met)


def _may_link(threshold: int | None, counted: bool = True) -> Column:
    """Whether rows x and y are of two lines that meet under a key, one of them by a segment of its own, and can be linked by so
    many edits before the segment as its number says, and the others after it; by lengths alone if not ``counted``."""
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.entry") | F.col("y.entry")) & (F.col("x.lid") != F.col("y.lid"))
    i = F.col("x.i").cast("int")
    before, after = (BEFORE, AFTER) if counted else ((), ())
    beyond = _side_near(after, F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"), _most(F.least("x.n", "y.n"), threshold) - i)
    return on & _side_near(before, F.col("x.at"), F.col("y.at"), i) & beyond


def _pairs(x: DataFrame, y: DataFrame, threshold: int | None, where: Column | None = None) -> DataFrame:
    """Pairs (a, b) of lines that meet under a key and can be linked."""
    on = _may_link(threshold)
    met = x.alias("x").join(y.alias("y"), on if where is None else on & where)
    return met.select(F.least("x.lid", "y.lid").alias("a"), F.greatest("x.lid", "y.lid").alias("b")).distinct()


def _verified(pairs: DataFrame, lines: DataFrame, threshold: int | None) -> DataFrame:
    """The linked ones of ``pairs``, with all other columns of ``lines`` as <name>_a and <name>_b."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    if pairs.count() <= FEW_PAIRS:  # their lines are picked out where they are
        ids = F.broadcast(ids)
    some = lines.join(ids, "lid", "left_semi")
    of = lambda side: some.select(F.col("lid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in lines.columns if c != "lid"])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    a, b = F.col("line_a"), F.col("line_b")
    both = both.withColumn("most", _most(F.least(F.length(a), F.length(b)), threshold))
    both = both.where(_pieces_near(a, b, F.col("most")))
    top = MOST if threshold is None else threshold
    # what the JVM's own banded distance leaves out costs far less than an aggregate over the characters
    both = both.where(F.levenshtein(a, b, top).between(0, F.col("most")))
    return both.where(let(_unlike(a, b), lambda rest: edit_distance(rest["a"], rest["b"], top)) <= F.col("most"))


def linked_lines(lines: DataFrame, threshold: int | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(a, b) of linked lines, given distinct lines (lid, line); each pair once, a < b."""
    rows = _beside(_shared_keys(lines, threshold, shortest), lines.select("lid", "line"), classes(threshold, shortest))
    return _verified(_pairs(rows.where("entry"), rows, threshold), lines.select("lid", "line"), threshold).select("a", "b")


def later_lines(lines: DataFrame, threshold: int | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(lid) of the lines that are linked with one that comes earlier, given distinct lines (lid, line, first).

    Under each key, lines first meet the earliest one, then the next one that has not gone, ``ROUNDS`` times; those that
    are left meet all earlier lines they have not met.
    """
    shared = _shared_keys(lines.select("lid", "line"), threshold, shortest)
    # rows that meet nobody make no pair, whatever the round; most are told by their lengths, without the lines
    near = written(shared.alias("x").join(shared.alias("y"), _may_link(threshold, counted=False), "left_semi"), "near")
    removed(shared)
    keys = written(_beside(near, lines.select("lid", "line", "first"), classes(threshold, shortest)), "keys")
    removed(near)
    rows = written(keys.alias("x").join(keys.alias("y"), _may_link(threshold), "left_semi"), "keys")
    removed(keys)

    def gone(pairs: DataFrame) -> DataFrame:
        found = _verified(pairs, lines.select("lid", "line", "first"), threshold)
        return written(found.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("lid")).distinct(), "later")

    earlier = F.col("x.first") < F.col("y.first")
    left, met, later = rows, None, None
    for _ in range(ROUNDS):
        fresh = left.where("entry") if met is None else left.where("entry").join(met.select("key", "lid"), ["key", "lid"], "left_anti")
        earliest = written(fresh.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), "first").alias("e")).select("key", "e.*"), "earliest")
        met = earliest if met is None else met.unionByName(earliest)
        more = gone(_pairs(earliest, left, threshold, earlier))
        later = more if later is None else later.unionByName(more)
        left = written(left.join(later, "lid", "left_anti"), "left")
    rest = rows.join(met.select("key", "lid"), ["key", "lid"], "left_anti")
    return later.unionByName(gone(_pairs(rest, left, threshold, earlier))).distinct()


def _hashes(c) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(c), F.xxhash64(c, F.lit(1))]


def distinct_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lid, line, first): every distinct line with a word, and the place (key, hashes of the text, line number) where it comes first."""
    h1, h2 = _hashes(text)
    rows = docs.select(F.col(key).alias("k"), h1.alias("h1"), h2.alias("h2"), F.posexplode(F.split(text, "\n")).alias("no", "line")).where(
        F.col("line").rlike(WORD))
    l1, l2 = _hashes("line")
    lines = rows.groupBy(l1.alias("l1"), l2.alias("l2")).agg(F.min(F.struct("k", "h1", "h2", "no")).alias("first"), F.min("line").alias("line"))
    return lines.select(F.struct("l1", "l2").alias("lid"), "line", "first")


def dedup(docs: DataFrame, threshold: int | None = None, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The documents with the lines that stay; ``__n_lines`` and ``__n_removed`` count lines with a word and those that went."""
    lines = written(distinct_lines(docs, key, text), "lines")
    stay = lines.select("lid", "first").join(later_lines(lines, threshold, shortest), "lid", "left_anti").select("first.*")
    kept = written(stay.groupBy("k", "h1", "h2").agg(F.array_sort(F.collect_list("no")).alias("nos")), "kept")
    removed(lines)
    # the row itself is one column, so that its columns may have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("rk"), F.col(f"`{text}`").alias("text"))
    h1, h2 = _hashes("text")
    same = F.col("rk").eqNullSafe(F.col("k")) & (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2"))
    joined = rows.select("row", "rk", h1.alias("r1"), h2.alias("r2")).join(kept, same, "left").withColumn("text", F.col(f"row.`{text}`"))
    nos = F.coalesce("nos", F.expr("CAST(array() AS array<int>)"))
    # one flag per line up to the last that stays, so that looking one up does not depend on how many there are
    gaps = F.zip_with(nos, F.concat(F.array(F.lit(-1)), nos), lambda a, b: F.concat(F.repeat(F.lit("0"), F.coalesce(a - b - 1, F.lit(0))), F.when(a.isNotNull(), "1").otherwise("")))
    flagged = joined.select("row", "text", F.size(nos).alias("n_kept"), F.split(F.array_join(gaps, ""), "").alias("flags"), F.split("text", "\n").alias("lines"))
    remains = F.filter("lines", lambda x, i: ~x.rlike(WORD) | F.coalesce(F.get(F.col("flags"), i) == "1", F.lit(False)))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(F.filter("lines", lambda x: x.rlike(WORD)))), F.lit(0))
    new = F.when(F.col("text").isNotNull(), F.array_join(remains, "\n"))
    out = flagged.select("row", new.alias("new"), n_lines.alias("n"), "n_kept")
    names = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    return out.select(*[(F.col("new") if c == text else F.col(f"row.`{c}`")).alias(c) for c in names], F.col("n").alias("__n_lines"),
                      (F.col("n") - F.col("n_kept")).alias("__n_removed"))
