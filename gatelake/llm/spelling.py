"""Spelling variants: words one edit apart, found over an index of variable-length grams.

A dictionary of frequent grams is kept, pruned by their count over all words. A word between its two end marks is
decomposed at each place into the shortest gram that is not frequent, so common beginnings give longer, rarer grams. The
extent of a gram depends on its own letters alone, so an edit affects just the grams that cover its place; the largest
such number is the word's bound. Of two words one edit apart all other grams are shared. Hence they meet in the lists of
the bound + 1 rarest grams of each, and only these lists are merged; pairs that meet are verified letter by letter.

Words of neighbouring lengths c and c + 1 form class c. Its grams have at most half the c + 2 places, so that no edit
can cover all grams of a word and no pair is missed. Lists are told apart by class, gram and place. Long ones are cut
into slices that are merged pairwise.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, tasks

SHORTEST = 6        # code points of a word
OCCURRENCES = 5
FORM_TIMES = 5      # a form occurs so many times as often as the word
DAMAGE = 199        # a run is damaged if this divides its hash
LEAST_GRAM, LARGEST_GRAM = 2, 12
FREQUENT = 32       # a gram that occurs more often is extended,
FEW_GRAMS = 65_536  # and the bound rises so that there are at most so many of them
LIST_LIMIT = 2048   # words of a list merged at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "[^A-Za-z\\u00C0-\\u00FF]+"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of whole texts that are long and frequent enough, damaged runs counted as what is left."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), _PARTS)).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")  # for these the fast function lowers A to Z alone
    rows = rows.where(F.length("run") >= SHORTEST).select(
        "id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (hashed % F.length("run")).cast("int")
    left = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    found = rows.select(F.when(hashed % DAMAGE == 0, left).otherwise(F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def largest_gram(length: int) -> int:
    """Of words in the class of this length."""
    return min(LARGEST_GRAM, (length + 2) // 2)


def frequent_grams(vocabulary: DataFrame) -> frozenset[str]:
    """The pruned dictionary: all grams with more than the threshold of places in words, at most FEW_GRAMS.

    The threshold grows with the number of counted grams, which bounds what the driver gets and the tasks are sent.
    """
    marked = vocabulary.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    size = F.length("w")
    longest = F.least(F.lit(LARGEST_GRAM), F.floor(size / 2)) - 1  # the largest gram itself is never extended
    grams = marked.where(longest >= LEAST_GRAM).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), size - LEAST_GRAM), lambda p: F.transform(
        F.sequence(F.lit(LEAST_GRAM), F.greatest(F.lit(LEAST_GRAM), F.least(longest, size - p)).cast("int")), lambda q: F.substr("w", p + 1, q))))).alias("gram"))
    counts = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.gram for r in counts.where(F.col("n") > max(FREQUENT, -(-total // FEW_GRAMS))).select("gram").collect())


def decomposed(word: str, longest: int, frequent: frozenset[str]) -> list[tuple[int, str]]:
    """(place, gram) for each place of the marked word: the shortest gram that is not frequent or of full length.

    Where the word ends before, the place has none.
    """
    marked, out = f"^{word}$", []
    for p in range(len(marked) - LEAST_GRAM + 1):
        for end in range(p + LEAST_GRAM, min(p + longest, len(marked)) + 1):
            gram = marked[p:end]
            if end - p == longest or gram not in frequent:
                out.append((p, gram))
                break
    return out


def affected(grams: list[tuple[int, str]], size: int) -> int:
    """The largest number of grams that one edit of a letter can affect: that cover one place between the marks."""
    cover = np.zeros(size + 3, np.int64)
    for p, gram in grams:
        cover[p] += 1
        cover[p + len(gram)] -= 1
    return int(np.cumsum(cover)[1:size + 1].max(initial=0))


def one_edit(a: str, b: str, at: int = 0) -> bool:
    """Whether one inserted, deleted or replaced code point makes one from the other.

    b is as long as a, and another word, or one longer; the first `at` code points are known to be equal.
    """
    for i in range(at, len(a)):
        if a[i] != b[i]:
            return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]
    return len(b) > len(a)


def postings(vocabulary: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """(class, gram, place, word, n, longer, quota): all grams of every word, as the shorter and as the longer of a class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for kind in (len(word), len(word) - 1):
                    if kind >= SHORTEST:
                        grams = decomposed(word, largest_gram(kind), frequent)
                        quota = affected(grams, len(word)) + 1
                        out += [(kind, gram, p, word, n, kind < len(word), quota) for p, gram in grams]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int32()), strict=True)],
                ["class", "gram", "place", "word", "n", "longer", "quota"])

    return vocabulary.select("word", "n").mapInArrow(run, "class int, gram string, place int, word string, n long, longer boolean, quota int")


def lists(rows: DataFrame) -> DataFrame:
    """(class, gram, place, tree, ask, in_tree, word, n, longer): the lists that need merging, long ones in slices.

    Of each word its quota of rarest grams is kept, in an order all words share. A gram of the longer word may stand one
    place further on, so it is listed for both places.
    """
    counts = rows.groupBy("class", "gram").agg(F.count(F.lit(1)).alias("frequency"))
    order = Window.partitionBy("class", "word").orderBy("frequency", "gram", "place")  # the grams of one word
    rare = rows.join(counts, ["class", "gram"]).withColumn("nth", F.row_number().over(order)).where("nth <= quota")
    places = F.when(F.col("longer"), F.array(F.col("place"), F.col("place") - 1)).otherwise(F.array("place"))
    listed = stored(rare.select("class", "gram", F.explode(places).alias("place"), "word", "n", "longer"), "gram-lists")
    key = ["class", "gram", "place"]
    large = stored(listed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LIST_LIMIT), "long-lists")
    slices = F.coalesce(F.ceil(F.col("size") / LIST_LIMIT).cast("int"), F.lit(1))
    cut = listed.join(large, key, "left").withColumn("mine", F.pmod(F.xxhash64("word"), slices).cast("int")).select(
        *key, "word", "n", "longer", "mine", F.explode(F.sequence(F.lit(0), slices - 1)).alias("other"))
    return cut.select(*key, F.least("mine", "other").alias("tree"), F.greatest("mine", "other").alias("ask"),
                      (F.col("mine") <= F.col("other")).alias("in_tree"), "word", "n", "longer")


class WordList:
    """Words of a class that share a gram, by their first and by their last letters: an edit leaves one half as it is."""

    def __init__(self, kind: int) -> None:
        self.half = kind // 2
        self.firsts: dict[str, list[tuple[str, int, bool]]] = {}
        self.lasts: dict[str, list[tuple[str, int, bool]]] = {}

    def add(self, word: str, n: int, longer: bool) -> None:
        self.firsts.setdefault(word[:self.half], []).append((word, n, longer))
        self.lasts.setdefault(word[-self.half:], []).append((word, n, longer))

    def near(self, word: str, longer: bool) -> list[tuple[str, int]]:
        """Verified words; two of the longer length are left to the class of that length."""
        first, half = word[:self.half], self.half
        out = [(w, n) for w, n, more in self.firsts.get(first, ())
               if not (longer and more) and (one_edit(word, w, half) if more else one_edit(w, word, half))]
        return out + [(w, n) for w, n, more in self.lasts.get(word[-half:], ())
                      if not (longer and more) and (one_edit(word, w) if more else one_edit(w, word)) and not w.startswith(first)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, asks, lists, longer, n, word) come sorted by list, listed words first; gives the verified pairs.

    Lists are told apart by a hash. Should two meet in one, their pairs are verified like any other; two of different
    classes are kept apart by the length of the words.
    """
    now, held = None, WordList(0)
    for batch in batches:
        out = []
        key, asks, lists_, longer = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[:4])
        for key, ask, listed, more, n, word in zip(key, asks, lists_, longer, batch.column(4).to_numpy().tolist(), batch.column(5).to_pylist(), strict=True):
            kind = (key, len(word) - more)
            if kind != now:
                now, held = kind, WordList(kind[1])
            if ask:
                out += [(other, m, word, n) for other, m in held.near(word, more)]
            if listed:
                held.add(word, n, more)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "n_a", "b", "n_b"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words of vocabulary(word, n) that are one edit apart, once."""
    cut = lists(stored(postings(vocabulary, frequent_grams(vocabulary)), "postings"))
    met = cut.select(F.xxhash64("class", "gram", "place", "tree", "ask").alias("list"), ((F.col("tree") == F.col("ask")) | ~F.col("in_tree")).alias("asks"),
                     F.col("in_tree").alias("lists"), "longer", "n", "word", "class")
    met = met.repartition(tasks(vocabulary.sparkSession), "list").sortWithinPartitions("list", "class", F.col("lists").desc()).drop("class")
    pairs = met.mapInArrow(_merged, "a string, n_a long, b string, n_b long")
    swap = F.col("a") > F.col("b")
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("n_a", "n_b"), ("b", "a"), ("n_b", "n_a"))]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), stored: the last of the forms that follow one another from each word of forms(word, form).

    A form is several times as frequent as its word, so a chain is short, and every round doubles the steps taken.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A null text has no words and a null id hashes as the empty string; repeated rows count each. The form is the near
    word of largest n, ties to the smallest, if it occurs FORM_TIMES as often, else null; the root follows forms to the
    last. An empty table gives no rows; other columns are not read.
    """
    vocabulary = stored(words(docs, id_col, text_col), "vocabulary")
    pairs = stored(near_words(vocabulary), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("times")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("times")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("times")).alias("below"), "near")).alias("best"))
    is_form = -F.col("best.below") >= FORM_TIMES * F.col("n")
    judged = stored(vocabulary.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.below")).alias("form_n")), "forms")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
