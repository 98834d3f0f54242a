"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form that each goes back to.

Of two words one edit apart, the longer one (of equally long ones either) is cut
into two disjoint chunks, its halves; one edit leaves a half as it is. The other
word gives its positional grams: those of the halves' lengths whose position
lies within a shift of one of a half's, where the shift is the difference of the
lengths (other grams could meet no chunk). The half that holds the edit is cut
once more, and the part that the edit leaves alone goes along with the chunk, so
that only words which agree on about three quarters meet. Pairs that meet are
verified by their edit distance.

Words that agree on three quarters can still be many. A key with more than
``MOST`` rows is left out of that join; its rows meet under the same key, with
one character of the remaining part left out, where a group has no more members
than the alphabet has letters. So no pair is lost and no group gives all pairs.

Edge cases: null and empty texts have no words, repeated rows are counted as
often as they come, a null id counts as the empty string; ties between forms go
to the smallest word in code-point order. An empty table gives an empty result.
Other columns of the documents are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Code points and occurrences that a word needs, and how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Rows of a key beyond which its group is divided, and keys of divided groups up to which they are broadcast (16 bytes each).
MOST, BROADCAST_KEYS = 64, 1_000_000
#: Entries that a task counts before it hands them on, and characters of a text looked at together.
HELD_WORDS, PIECE_CHARS = 300_000, 1 << 20
LETTERS = "a-zÀ-ÿ"


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that cut no run of letters."""
    other, at = re.compile(f"[^{LETTERS}]"), 0
    while len(text) - at > PIECE_CHARS:
        end = other.search(text, at + PIECE_CHARS)
        if not end:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:]


def _counted(drop_every: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, crc32, held = re.compile(f"[{LETTERS}]{{{least},}}").findall, zlib.crc32, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = crc32(f"{'' if key is None else key}:".encode())
                for piece in _pieces(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                    counts = Counter(find(piece))
                    if drop_every:
                        for word in [w for w in counts if not crc32(w.encode(), seed) % drop_every]:
                            at = crc32(word.encode(), seed) % len(word)
                            if len(word) > least:
                                held[word[:at] + word[at + 1:]] += counts[word]
                            del counts[word]
                    held.update(counts)
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                drop_every: int | None = None) -> DataFrame:
    """Words (runs of letters, A-Z lower-cased) and how often they come in all texts.

    With ``drop_every``, a run loses one code point where that number divides the crc32 of ``<id>:<run>`` (at that crc32 modulo its length).
    """
    rows = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    counted = rows.mapInArrow(_counted(drop_every, least_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Per place of the edit (a quarter of a word of ``length``): hash of chunk and part left alone, and the quarter itself.

    ``word`` is that word (shift 0 and its own length) or one that has lost ``-shift`` characters of the quarter.
    """
    half = F.floor(length / 2)
    a, b = F.floor(half / 2), half + F.floor((length - half) / 2)

    def cut(start: Column, end: Column) -> Column:
        return F.substr(word, start + 1, end - start)

    zero, s = F.lit(0), F.lit(shift)
    second, first = cut(half + s, length + s), cut(zero, half)
    cases = [  # (chunk, part of the other half that stays, the quarter that holds the edit)
        (second, cut(a + s, half + s), cut(zero, a + s)),
        (second, cut(zero, a), cut(a, half + s)),
        (first, cut(b + s, length + s), cut(half, b + s)),
        (first, cut(half, b), cut(b, length + s)),
    ]
    return F.array(*[F.struct(F.xxhash64(length.cast("int"), F.lit(i), chunk, rest).alias("key"), quarter.alias("quarter"))
                     for i, (chunk, rest, quarter) in enumerate(cases)])


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, both ways round: word, n, near, near_n. ``words`` has one row per word."""
    own = words.select("word", "n", F.explode(_keys(F.col("word"), F.length("word"), 0)).alias("k"), F.lit(False).alias("shorter"))
    less = words.select("word", "n", F.explode(_keys(F.col("word"), F.length("word") + 1, -1)).alias("k"), F.lit(True).alias("shorter"))
    rows = written(own.unionByName(less).select("k.key", "k.quarter", "word", "n", "shorter"), "chunks")

    many = written(rows.groupBy("key").count().where(F.col("count") > MOST).select("key"), "groups")
    if many.count() <= BROADCAST_KEYS:
        many = F.broadcast(many)

    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        x, y = rows.where("NOT shorter").alias("x"), rows.alias("y")
        on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("y.shorter") | (F.col("x.word") < F.col("y.word"))]
        both = x.join(y, on).where(F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1)
        return both.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))

    found = met(rows.join(many, "key", "left_anti"), ["key"])
    hot = rows.join(many, "key", "left_semi")
    places = F.sequence(F.lit(1), F.length("quarter"))

    def without(i: Column) -> Column:
        return F.concat(F.substr("quarter", F.lit(1), i - 1), F.substr("quarter", i + 1))

    # replaced: the quarter without its i-th character on either side; lost: that on the longer side, the whole quarter on the shorter
    replaced = hot.where("NOT shorter").select("*", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), without(i).alias("rest")))).alias("p"))
    lost = hot.where("NOT shorter").select("*", F.explode(F.array_distinct(F.transform(places, lambda i: F.struct(F.lit(0).alias("place"), without(i).alias("rest"))))).alias("p"))
    whole = hot.where("shorter").select("*", F.struct(F.lit(0).alias("place"), F.col("quarter").alias("rest")).alias("p"))
    divided = replaced.unionByName(lost).unionByName(whole).select("key", F.col("p.place").alias("place"), F.col("p.rest").alias("rest"), "word", "n", "shorter")
    # equally long words meet at their places, others at place 0
    same = met(divided.where("place > 0"), ["key", "place", "rest"])
    other = divided.where("place = 0")
    x, y = other.where("NOT shorter").alias("x"), other.where("shorter").alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("key", "rest")]
    shorter = x.join(y, on).where(F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1).select(
        F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))
    pairs = found.unionByName(same).unionByName(shorter).distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with every form followed to the last one, by pointer doubling (word, root).

    A form is at least ``TIMES`` times as frequent as its word, so chains are short and have no cycles.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(nxt, "root", "left")
        stepped = written(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return links


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Per word (word, n): its form (its most frequent near word, if that is ``times`` as frequent), root, n, n_near, form_n."""
    words = written(words.select("word", "n"), "words")
    best = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form = -F.col("best.minus") >= times * F.col("n")
    near = written(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "near")
    last = roots(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
