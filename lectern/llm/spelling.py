"""Spelling variants: words one edit apart, and the frequent form that a rare one stands for.

Each word has a mask with a bit for each letter, set where the letter occurs an
odd number of times. One inserted or deleted letter flips one bit, a replaced
one two at most, so of three bands of the mask one at least stays as it is.
Words meet where a band, the length (a word also offers itself to words shorter
by one) and one half of the letters are equal, as an edit leaves one half as it
is; a pair is taken at the first of its equal bands and halves, passes if the
masks differ in two bits at most, and is verified by its edit distance. Without
the halves the pairs that meet, and the time, grow with the square of the
vocabulary.

A word's form is its most frequent near word, if that is ``ratio`` times as
frequent at least. Frequencies grow along forms, so these end in a root, found by
jumps that double.

Edge cases: a null text has no words; a null doc_id counts as an empty one in the
hash that decides which letters are left out; repeated rows count each; ties of
frequency go to the word that is first by code points; a very long text is
one row, whose words are counted as they are read; an empty table gives an empty
result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import partitions, stored

#: A word's letters; A to Z are lower-cased, no others are.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs, by hash, loses a letter.
TYPOS = 199
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
BANDS = 3
#: Pairs that a bucket may cost, whatever the cluster, before it is dealt out.
LEAST_COST = 1_000_000


def lowered(run: Column) -> Column:
    """A to Z in lower case, other letters as they are."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS, typos: int = TYPOS) -> DataFrame:
    """(word), a row for each run of letters, of which one in typos, by a hash of document and run, has lost one."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_lt_doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_lt_run"))
    runs = runs.where(F.char_length("_lt_run") >= least_chars).select("_lt_doc", lowered(F.col("_lt_run")).alias("_lt_run"))
    h, n = F.crc32(F.concat("_lt_doc", F.lit(":"), "_lt_run")), F.char_length("_lt_run")
    at = (F.col("_lt_h") % n).cast("int")
    cut = F.concat(F.left("_lt_run", at), F.substring(F.col("_lt_run"), at + 2, n))
    word = F.when(F.col("_lt_h") % typos == 0, cut).otherwise(F.col("_lt_run"))
    return runs.withColumn("_lt_h", h).select(word.alias("word")).where(F.char_length("word") >= least_chars)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words that occur often enough; added up where they are read first."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def masked(words: DataFrame) -> DataFrame:
    """Adds length and the bands m0, m1, m2 of the mask: letters a to z, then U+00C0 to U+00FF, are dealt to the bands in turn."""
    letters = "transform(filter(split(word, ''), c -> c <> ''), c -> if(ascii(c) < 128, ascii(c) - 97, ascii(c) - 166))"
    rows = words.withColumn("length", F.char_length("word")).withColumn("_lt_at", F.expr(letters))
    band = lambda b: F.expr(f"aggregate(filter(_lt_at, x -> x % {BANDS} = {b}), 0L, (acc, x) -> acc ^ shiftleft(1L, x div {BANDS}))")
    return rows.withColumns({f"m{b}": band(b) for b in range(BANDS)}).drop("_lt_at")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), once for each two of words (word, n; different words) that are one edit apart.

    A bucket that would cost more than a fair part is dealt over several tasks,
    its shorter words copied to each.
    """
    rows = stored(masked(words), "masks")
    masks = [f"m{b}" for b in range(BANDS)]
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(m).alias("value")) for b, m in enumerate(masks)]))
    keyed = rows.withColumn("_lt_band", bands).select("word", "n", "length", *masks, "_lt_band.*")

    def halves(at):
        """The word as one of at letters or, if it is longer, as what one of at letters may have become: its first half, its second."""
        half = (at / 2).cast("int")
        both = F.array(F.struct(F.lit(0).alias("half"), F.left("word", half).alias("part")), F.struct(F.lit(1).alias("half"), F.right("word", at - half).alias("part")))
        return F.transform(both, lambda x: F.struct(x["half"].alias("half"), F.xxhash64("value", at, x["part"]).alias("bucket")))

    key = ["band", "half", "bucket"]
    word = F.struct("word", "n", "length", *masks)
    short = keyed.select("band", F.inline(halves(F.col("length"))), word.alias("a"))
    long = keyed.select("band", F.inline(F.concat(halves(F.col("length")), halves(F.col("length") - 1))), word.alias("b"))
    sizes = short.groupBy(*key).agg(F.count("*").alias("s")).join(long.groupBy(*key).agg(F.count("*").alias("l")), key)
    sizes = stored(sizes.where("s * l > 100"), "buckets")
    total = sizes.agg(F.sum(F.col("s") * F.col("l"))).first()[0] or 0
    limit = max(LEAST_COST, math.ceil(total / (4 * partitions(words.sparkSession))))  # so at most 4 x partitions buckets are hot
    hot = F.broadcast(sizes.where(F.col("s") * F.col("l") > limit).select(*key, F.least(F.col("l"), F.ceil(F.col("s") * F.col("l") / limit)).cast("long").alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    b = long.join(hot, key, "left").select(*key, F.pmod(F.xxhash64("b.word"), salts).alias("salt"), "b")
    a = short.join(hot, key, "left").select(*key, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "a")
    same = lambda m: F.col(f"a.{m}") == F.col(f"b.{m}")
    first = (F.col("band") == 0) | ((F.col("band") == 1) & ~same("m0")) | ((F.col("band") == 2) & ~same("m0") & ~same("m1"))
    middle = (F.col("a.length") / 2).cast("int")
    once = (F.col("half") == 0) | (F.left("a.word", middle) != F.left("b.word", middle))
    flips = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in masks), F.lit(0))
    ordered = (F.col("b.length") == F.col("a.length") + 1) | ((F.col("b.length") == F.col("a.length")) & (F.col("a.word") < F.col("b.word")))
    met = a.join(b.hint("merge"), [*key, "salt"]).where(ordered & first & once & (flips <= 2))
    pairs = met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, form; null: none), which have no cycles; each round doubles what it jumps."""
    at = stored(links.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = at.join(jump, "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved"))
        new = stored(new, "roots")
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for words (word, n)."""
    words = stored(words, "words")
    pairs = stored(near_pairs(words), "near")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("w"))).alias("best"))
    found = words.join(best, "word", "left")
    stands = -F.col("best.k") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("best.w")).alias("form"), F.when(stands, -F.col("best.k")).alias("form_n")), "forms")
    return found.join(rooted(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of docs (doc_id, text) with the words that they are variants of."""
    return variants(vocabulary(occurrences(docs)))
