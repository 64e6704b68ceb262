"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius share one. A shuffle on variants brings them
together, colliding pairs are deduplicated and verified, and connected
components follow by label propagation.

``near_duplicates`` links by the bits of one fingerprint over shingles.
``keep_one`` is for texts that share a stated part of their shingles: such texts
differ in few words but in many shingles, so it hashes the set of words into
six fingerprints of 30 bits, calls texts that meet in the ball of any of them
candidates, and verifies these by the exact Jaccard similarity of their
shingles. First a text meets the least and the greatest of its
fingerprint and its balls and is compared with the ``LEADERS`` of them that lead
the most texts, which joins large groups of copies cheaply; then all candidates
of small balls that are not yet joined are compared. In balls of more
than ``LARGEST`` texts each text meets the one that has the fewest rare
shingles, the middle of a group of edits, and after that only those that can
still be similar by a rare shingle that both have or by what they differ in from
the reference of their group, the shingles that most of its texts have, so that
no member of a ball goes unseen and a large group isn't compared pair by pair. Chance
meetings would grow with the square of the texts: fingerprints get a bit more
for each doubling of the rows and one more of them for every three bits, which
keeps what they find (``sizes``).

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; a bit that exactly half of the hashes have is 0; a component without any
doc_id has a null component_id; repeated rows share a component; of documents
under one id that with the smallest hash of its text comes first; a very long
text is hashed whole, in blocks; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import NULL_ID, partitions, row_hash, skew_join, small_batches, stored, tidy

RADIUS = 2
SHINGLE = 3
SEED = 42
#: What keep_one takes: words in a shingle, the least similarity, and the fingerprints of words.
WORDS, SIMILARITY = 5, 0.8
PARTS, BITS = 6, 30
#: Bits in which the fingerprints of similar texts differ, at most, as a share of all of them.
FAR = 0.2
#: Texts of a ball that are all compared, at most; a shingle in as many texts of larger balls is rare.
LARGEST = 32
#: Rows that BITS and PARTS are for.
ROWS = 1 << 16
#: Leaders that a text is compared with before it is known what they join; what they leave is compared later.
LEADERS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 over word shingles, as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space
    if not found:
        return 0
    if len(found) < shingle:
        h = np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(shingle))))
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(found) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_lt_doc, _lt_text (a hash that tells texts under one id apart), _lt_fp for each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(x, shingle) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["_lt_doc", "_lt_text", "_lt_fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_lt_doc"), row_hash(F.col("text")).alias("_lt_text"), F.col("text").alias("_lt_t"))
    return rows.mapInArrow(tidy(run), "_lt_doc long, _lt_text long, _lt_fp long")


def variants(radius: int) -> list[int]:
    """Masks of all bit changes within half the radius, as signed integers."""
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + radius % 2 + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) that connect what pairs within the radius would.

    A ball of half the radius holds few distinct fingerprints. For an even
    radius all of them lie within the radius of each other, so each is linked
    to the least of its ball, which loses no component.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    balls = distinct.select("_lt_fp", F.explode(F.array(*[F.lit(m).cast("long") for m in variants(radius)])).alias("_lt_mask"))
    balls = balls.select("_lt_fp", F.col("_lt_fp").bitwiseXOR(F.col("_lt_mask")).alias("_lt_variant"))
    met = balls.withColumn("_lt_least", F.min("_lt_fp").over(W.partitionBy("_lt_variant")))
    pairs = met.filter("_lt_fp <> _lt_least").select(F.col("_lt_fp").alias("a"), F.col("_lt_least").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """(n, l): each node of the edges (a, b) with the least node that it can reach.

    Least labels of neighbours, then a jump to the label's own label, until no
    label changes; every round is written to the shared folder. Labels only fall,
    so the rounds end.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(labels, both.b == labels.n).groupBy("a").agg(F.min("l").alias("m"))
        least = labels.join(near, labels.n == near.a).select("n", "l", F.least("l", "m").alias("k"))
        jump = labels.select(F.col("n").alias("k"), F.col("l").alias("j"))
        new = stored(least.join(jump, "k", "left").select("n", F.coalesce(F.least("k", "j"), "k").alias("k"), (F.col("l") != F.coalesce(F.least("k", "j"), "k")).alias("moved")), "labels")
        changed = new.filter("moved").limit(1).count()
        labels = new.select("n", F.col("k").alias("l"))
        if not changed:
            return labels


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Rows (_lt_doc, _lt_text, _lt_fp), and a row for each fingerprint: its rows, component and that component's first row."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("_lt_doc").isNull().alias("no"), F.col("_lt_doc").alias("doc"), F.col("_lt_text").alias("text")))
    distinct = stored(rows.groupBy("_lt_fp").agg(F.count("*").alias("_lt_rows"), first.alias("_lt_first")), "distinct")
    found = components(links(distinct.select("_lt_fp"), radius))
    joined = distinct.join(found, distinct._lt_fp == found.n, "left").withColumn("_lt_class", F.coalesce("l", "_lt_fp")).drop("n", "l")
    joined = stored(joined, "classes")
    heads = stored(joined.groupBy("_lt_class").agg(F.min("_lt_first").alias("_lt_head"), F.count("*").alias("_lt_n")), "first")
    return rows, stored(skew_join(joined.drop("_lt_first"), heads, "_lt_class", "_lt_n", F.xxhash64("_lt_fp"), "inner"), "heads")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs."""
    rows, found = classes(docs, radius, shingle)
    joined = skew_join(rows, found.drop("_lt_class"), "_lt_fp", "_lt_rows", row_hash(F.col("_lt_doc"), F.col("_lt_text")))
    return joined.select(F.col("_lt_doc").alias("doc_id"), F.lower(F.lpad(F.hex("_lt_fp"), 16, "0")).alias("fingerprint"), F.col("_lt_head")["doc"].alias("component_id"))


def sizes(rows: int) -> tuple[int, int]:
    """Fingerprints and their bits for so many rows: a bit more for each doubling, one fingerprint more for every three bits."""
    more = max(0, math.ceil(math.log2(max(rows, 1) / ROWS)))
    bits = min(64, BITS + more)
    return PARTS + -(-more // 3), bits


def sketch(text: str | None, parts: int = PARTS, bits: int = BITS) -> list[int]:
    """Majority bits of hashes over the different words of a text, cut into parts, as signed integers."""
    import numpy as np
    from xxhash import xxh3_128_digest

    found = list(set((text or "").encode("utf-8", "surrogatepass").lower().split()))
    ones = np.zeros((-(-parts * bits // 128), 128), np.int64)
    for seed, row in enumerate(ones):
        for at in range(0, len(found), 65536):
            raw = b"".join(xxh3_128_digest(w, seed) for w in found[at : at + 65536])
            row += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    high = (2 * ones > len(found)).ravel()[: parts * bits].reshape(parts, bits)
    padded = np.zeros((parts, 64), bool)
    padded[:, :bits] = high
    return np.packbits(padded, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def named(text: Column) -> Column:
    """A text's name among all texts: a 64-bit hash of it and its length."""
    return F.xxhash64(text, F.char_length(text))


def sketches(docs: DataFrame, parts: int = PARTS, bits: int = BITS) -> DataFrame:
    """_lt_doc, _lt_text and _lt_parts (an array of fingerprints) for each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = pa.array([sketch(x, parts, bits) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["_lt_doc", "_lt_text", "_lt_parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_lt_doc"), named(F.col("text")).alias("_lt_text"), F.col("text").alias("_lt_t"))
    return rows.mapInArrow(tidy(run), "_lt_doc long, _lt_text long, _lt_parts array<long>")


def meeting(values: DataFrame, bits: int = BITS) -> DataFrame:
    """(p, ball, v) for the balls (radius 1) of values (p, v; different) in which two values or more lie; all others are left where they are counted."""
    masks = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(bits)]
    key = F.struct("p", "ball") if bits > 60 else (F.col("p").cast("long") * F.lit(1 << bits) + F.col("ball")).alias("key")
    balls = values.select("p", "v", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")).select("p", F.col("v").bitwiseXOR(F.col("m")).alias("ball"), "m")
    if bits > 60:
        met = balls.withColumn("k", F.count("*").over(W.partitionBy("p", "ball")))
    else:  # one number for a ball and one for the mask is all that travels
        met = balls.select(key, "m").withColumn("k", F.count("*").over(W.partitionBy("key"))).where("k > 1")
        met = met.select(F.expr(f"key div {1 << bits}").cast("int").alias("p"), (F.col("key") % (1 << bits)).alias("ball"), "m", "k")
    return met.where("k > 1").select("p", "ball", F.col("ball").bitwiseXOR(F.col("m")).alias("v"))


def candidates(texts: DataFrame, bits: int = BITS, met: DataFrame | None = None) -> DataFrame:
    """Different pairs (l, n) of texts (_lt_text, _lt_parts): each n with the ends l of its value, ends of a value with those of its balls.

    Equal fingerprints are one value, so a ball (radius 1) holds bits + 1 values
    at most; values in many texts are joined by salted keys. met: their meetings.
    """
    nodes = texts.select(F.col("_lt_text").alias("n"), F.posexplode("_lt_parts").alias("p", "v"))
    values = stored(nodes.groupBy("p", "v").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("_lt_n")), "distinct")
    met = stored(meeting(values.select("p", "v"), bits), "meetings") if met is None else met
    over = W.partitionBy("p", "ball")
    ends = met.withColumn("low", F.min("v").over(over)).withColumn("high", F.max("v").over(over))
    ends = ends.select("p", "v", F.explode(F.array("low", "high")).alias("end")).filter("v <> end").distinct()
    first = values.select("p", F.col("v").alias("end"), F.col("least").alias("l"))
    between = ends.join(first, ["p", "end"]).join(values, ["p", "v"]).select("l", F.explode(F.array_distinct(F.array("least", "most"))).alias("n"))
    key = F.struct("p", "v").alias("k")
    shared = stored(values.filter("_lt_n > 1").select(key, F.array("least", "most").alias("leaders"), "_lt_n"), "shared")
    within = skew_join(nodes.select("n", key), shared, "k", "_lt_n", F.xxhash64("n"), "inner")
    return between.union(within.select(F.explode("leaders").alias("l"), "n")).filter("l <> n").distinct()


def _flips(a: str, b: str, parts: int) -> list[Column]:
    """Bits in which the parts of two texts' fingerprints differ."""
    return [F.bit_count(F.col(a)[q].bitwiseXOR(F.col(b)[q])) for q in range(parts)]


def close(pairs: DataFrame, texts: DataFrame, parts: int = PARTS, bits: int = BITS, far: float = FAR) -> DataFrame:
    """Those of pairs (l, n) whose fingerprints differ in few bits overall, so that texts that met by chance in one part don't travel."""
    of = lambda n, s: texts.select(F.col("_lt_text").alias(n), F.col("_lt_parts").alias(s))
    return pairs.join(of("l", "s"), "l").join(of("n", "t"), "n").where(sum(_flips("s", "t", parts), F.lit(0)) <= int(far * parts * bits)).select("l", "n")


def leading(pairs: DataFrame, most: int = LEADERS) -> DataFrame:
    """Of pairs (l, n; stored) those of each n with the l that lead the most texts, so that texts of a group are compared with the same few.

    For steps whose pairs only save others from being compared: a later one must
    compare all that are not joined.
    """
    led = pairs.groupBy("l").agg(F.count("*").alias("led"))
    order = W.partitionBy("n").orderBy(F.desc("led"), "l")
    return pairs.join(led, "l").withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("l", "n")


def gathered(some: DataFrame, *more: str) -> DataFrame:
    """A row for each text of some (n, p, ball; and more of it): its balls as an array, so that what is joined to a text is joined once."""
    return some.groupBy("n").agg(*[F.first(c).alias(c) for c in more], F.collect_list(F.struct("p", "ball")).alias("balls"))


def opened(texts: DataFrame, bits: int = BITS, met: DataFrame | None = None) -> DataFrame:
    """Balls (p, ball) in which classes meet: their texts as rows n, c, s, p, v, ball and their number k; of texts as remaining takes them."""
    nodes = texts.select(F.col("_lt_text").alias("n"), F.col("_lt_class").alias("c"), F.col("_lt_parts").alias("s"), F.posexplode("_lt_parts").alias("p", "v"))
    values = stored(nodes.groupBy("p", "v").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")), "values")
    met = stored(meeting(values.select("p", "v"), bits), "meetings") if met is None else met
    # A value in several classes is a ball of its own where no other value meets it.
    alone = values.where("low <> high").select("p", F.col("v").alias("ball"), "v").join(met.select("p", "ball").distinct(), ["p", "ball"], "left_anti")
    within = stored(met.unionByName(alone).join(values, ["p", "v"]), "within")
    balls = within.groupBy("p", "ball").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("k").alias("k"))
    balls = stored(balls.where("low <> high").select("p", "ball", "k"), "mixed")
    return stored(nodes.join(within.select("p", "ball", "v").join(balls, ["p", "ball"]), ["p", "v"]), "members")


def remaining(texts: DataFrame, bits: int = BITS, parts: int = PARTS, far: float = FAR, met: DataFrame | None = None) -> DataFrame:
    """All pairs (l, n) of texts (_lt_text, _lt_parts, _lt_class; stored) of different classes that meet in a ball, each once."""
    return together(opened(texts, bits, met), bits, parts, far)


def together(some: DataFrame, bits: int = BITS, parts: int = PARTS, far: float = FAR) -> DataFrame:
    """Pairs (l, n) of different classes in the balls of some (as opened gives them), each once where all balls are there.

    A pair is taken at the first part in which it meets and there at the lesser
    of the balls that it shares; hot balls are dealt over several tasks, one side
    of their pairs copied to each.
    """
    total = some.agg(F.sum("k")).first()[0] or 0  # k rows of k texts each
    limit = max(1_000_000, math.ceil(total / (4 * partitions(some.sparkSession))))  # so at most 4 x partitions balls are hot
    some = some.withColumn("salts", F.least(F.col("k"), F.ceil(F.col("k") * F.col("k") / limit)).cast("long"))
    a = some.select("p", "ball", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.struct("n", "c", "s", "v").alias("a"))
    b = some.select("p", "ball", F.pmod(F.xxhash64("n"), F.col("salts")).alias("salt"), F.struct("n", "c", "s", "v").alias("b"))
    apart = F.col("a.v").bitwiseXOR(F.col("b.v"))
    here = F.when(apart == 0, F.col("ball") == F.col("a.v")).otherwise(F.col("ball") < F.col("ball").bitwiseXOR(apart))
    flips = _flips("a.s", "b.s", parts)
    good = (F.col("a.n") < F.col("b.n")) & (F.col("a.c") != F.col("b.c")) & here & (sum(flips, F.lit(0)) <= int(far * parts * bits))
    for q in range(parts - 1):
        good = good & F.when(F.col("p") > q, flips[q] > 2).otherwise(True)
    return a.join(b.hint("merge"), ["p", "ball", "salt"]).where(good).select(F.col("a.n").alias("l"), F.col("b.n").alias("n"))


def hashed(text: str | None, shingle: int = WORDS):
    """Different hashes of a text's shingles, in order; a text with fewer words than a shingle has one, of all its words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < shingle:
        return np.array([xxh64_intdigest(b" ".join(found))], np.uint64)
    grams = map(b" ".join, zip(*(found[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(found) - shingle + 1))


def profiles(texts: DataFrame, shingle: int = WORDS, largest: int = LARGEST) -> DataFrame:
    """n, size, common, rare and hs of texts (n, text; one row each): how many shingles they have, how many of them are in more than largest texts, the others as (k, h), those in the fewest texts first, and all in order."""
    small_batches(texts.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [hashed(x, shingle).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["n", "hs"])

    all_ = stored(texts.select("n", "text").mapInArrow(tidy(run), "n long, hs array<long>"), "shingles")
    rows = all_.select("n", F.explode("hs").alias("h"))
    few = rows.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") <= largest)
    rare = rows.join(few, "h").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("rare"))
    size = F.size("hs").cast("long")
    return all_.join(rare, "n", "left").select("n", size.alias("size"), (size - F.coalesce(F.size("rare"), F.lit(0))).alias("common"), "rare", "hs")


def middles(held: DataFrame, of: DataFrame, parts: int = PARTS, bits: int = BITS, far: float = FAR) -> DataFrame:
    """Pairs (l, n): the text of each ball with the least share of rare shingles (of: profiles), and texts of other classes there; held: texts n, c, s and their balls."""
    share = (1 - F.col("common") / F.col("size")).alias("share")
    some = held.join(of.select("n", "size", "common"), "n").select("n", "c", "s", share, F.explode("balls").alias("at"))
    some = stored(some.select("n", "c", "s", "share", "at.p", "at.ball"), "placed")
    ends = some.groupBy("p", "ball").agg(F.min(F.struct("share", "n", "c", "s")).alias("a"))
    met = some.join(ends, ["p", "ball"]).where((F.col("c") != F.col("a.c")) & (sum(_flips("s", "a.s", parts), F.lit(0)) <= int(far * parts * bits)))
    return met.select(F.col("a.n").alias("l"), "n").distinct()


def grouped(placed: DataFrame) -> DataFrame:
    """n, g and home of texts (n, share, at: a ball): texts that share a ball share a group g; home: a text's own group.

    A ball goes by its text with the least share of rare shingles. Of these texts
    that of the most texts is a text's home, and the greatest home of the texts
    in balls that go by one text is the group of these balls, so that nearly all
    balls around a text that was edited often are of one group.
    """
    balls = stored(placed.groupBy("at").agg(F.min(F.struct("share", "n"))["n"].alias("m"), F.count("*").alias("_lt_n")), "balls")
    led = stored(skew_join(placed.select("n", "at"), balls, "at", "_lt_n", F.xxhash64("n"), "inner").select("n", "m").distinct(), "led")
    most = stored(led.groupBy("m").agg(F.count("*").alias("k"), F.count("*").alias("_lt_n")), "most")
    own = stored(skew_join(led, most, "m", "_lt_n", F.xxhash64("n"), "inner").groupBy("n").agg(F.max(F.struct("k", "m")).alias("home")), "homes")
    of = stored(led.join(own, "n").groupBy("m").agg(F.max("home")["m"].alias("g"), F.count("*").alias("_lt_n")), "of")
    home = own.select("n", F.col("home.m").alias("home"))
    shared = skew_join(led, of, "m", "_lt_n", F.xxhash64("n"), "inner").select("n", "g")
    return shared.union(home.select("n", F.col("home").alias("g"))).distinct().join(home, "n")


def differences(held: DataFrame, of: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Texts n, c (of held: n, c and their balls) by their differences from what most texts of a group have, a row for each of a text's groups.

    The shingles in more than half of the texts at home in a group are its
    reference; a text differs by those it lacks and those it has besides.
    balance: so many, less the share of its own size that two similar texts may
    differ in for each shingle of both. others: differences without rare
    shingles, in an order that all texts of the group have; mask: 256 bits, one
    of which each of them sets; width: of the reference.
    Texts of which too much is rare to be similar by common shingles are left out.
    """
    known = of.join(held, "n").where(F.col("common") >= F.ceil(similarity * F.col("size") - 1e-6))
    known = stored(known.withColumn("share", 1 - F.col("common") / F.col("size")), "common")
    groups = stored(grouped(known.select("n", "share", F.explode("balls").alias("at"))), "groups")
    own = groups.where("g = home").select("n", "g")
    have = stored(own.join(known.select("n", "hs"), "n").select("g", F.explode("hs").alias("h")).groupBy("g", "h").agg(F.count("*").alias("k")).where("k > 1"), "have")
    all_ = stored(groups.groupBy("g").agg(F.count("*").alias("_lt_n"), F.count(F.when(F.col("g") == F.col("home"), 1)).alias("homes")), "all")
    most = have.join(all_.select("g", "homes"), "g").where("2 * k > homes").groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "h")))["h"].alias("ref"))
    none = F.array().cast("array<long>")
    refs = stored(all_.join(most, "g", "left").select("g", "_lt_n", F.coalesce("ref", none).alias("ref")), "references")
    some = groups.join(known.select("n", "c", "size", "hs", F.coalesce(F.col("rare")["h"], none).alias("rare")), "n")
    some = skew_join(some, refs, "g", "_lt_n", F.xxhash64("n"), "inner")
    some = some.withColumn("lacks", F.array_except("ref", "hs")).withColumn("more", F.array_except("hs", "ref"))
    balance = F.size("lacks") + F.size("more") - (1 - similarity) / (1 + similarity) * F.col("size")
    others = F.concat("lacks", F.array_except("more", "rare"))  # array_except keeps the order of its first array
    some = some.select("n", "c", "g", "home", "size", balance.alias("balance"), others.alias("others"), F.size("ref").alias("width"))
    word = "aggregate(filter(others, h -> (shiftright(h, 6) & 3) = {}), 0L, (all, h) -> all | shiftleft(1L, cast(h & 63 as int)))"
    return some.withColumn("mask", F.array(*[F.expr(word.format(q)) for q in range(4)]))


def centred(apart: DataFrame) -> DataFrame:
    """apart (differences) with the text of the least balance in each group, a (balance, n, c), and the class of most of its texts, top."""
    by = apart.groupBy("g", "c").agg(F.count("*").alias("k"), F.min(F.struct("balance", "n", "c")).alias("a"))
    of = stored(by.groupBy("g").agg(F.min("a").alias("a"), F.max(F.struct("k", "c"))["c"].alias("top"), F.sum("k").alias("_lt_n")), "centres")
    return skew_join(apart, of, "g", "_lt_n", F.xxhash64("n"), "inner")


def certain(apart: DataFrame) -> DataFrame:
    """Pairs (l, n): the text of the least balance in each group, and texts of other classes that can't but be similar to it.

    Texts with balances of 0 or less together are similar, as they differ from
    each other in no more than both do from the reference. Then each of them is
    also similar to the text of the least balance, so none of these pairs but
    those with it has to be met.
    """
    met = centred(apart).where((F.col("c") != F.col("a.c")) & (F.col("a.balance") + F.col("balance") <= 1e-6))
    return met.select(F.col("a.n").alias("l"), "n").distinct()


def bounded(some: DataFrame, of: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (l, n) of different classes in balls of some (n, c, p, ball) that can be similar, by their profiles of; loses none that is."""
    held = gathered(some, "c")
    return within_bounds(held, of, stored(differences(held, of, similarity), "apart"), similarity)


def within_bounds(held: DataFrame, of: DataFrame, apart: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As bounded, of texts n, c and their differences apart (stored).

    Shingles are ordered, rare ones first. The first that similar texts share is
    near both their beginnings: a rare one brings them together itself. If it is
    a common one then they share no rare one, and are compared by what they
    differ in from the reference of their group. With balances of 0 or less
    together they are similar; else they must have half the sum of their balances
    of these differences in common, none of them rare, and the first of these is
    near both their beginnings again. The lesser balance looks in steps of the
    greater, as it needs the more in common the greater that is. Texts of the
    class that most of a group are in don't look for each other.
    """
    known = stored(of.drop("hs").join(held.select("n", "c"), "n"), "known")
    need = similarity / (1 + similarity)
    least = lambda share: F.ceil(share * F.col("size") - 1e-6)
    order = lambda a, b: (F.col(a + ".size") < F.col(b + ".size")) | ((F.col(a + ".size") == F.col(b + ".size")) & (F.col(a + ".n") < F.col(b + ".n")))
    fits = order("a", "b") & (F.col("a.c") != F.col("b.c")) & (F.col("a.size") >= similarity * F.col("b.size") - 1e-6)

    def first(share: float, side: str) -> DataFrame:
        heads = known.where("rare is not null").select("n", "c", "size", F.explode(F.slice("rare", F.lit(1), (F.col("size") - least(share) + 1).cast("int"))).alias("x"))
        return heads.where("x.k > 1").select(F.col("x.h").alias("h"), F.struct("n", "c", "size").alias(side))

    rare = first(2 * need, "a").join(first(similarity, "b").hint("merge"), "h").where(fits)

    now = stored(centred(apart.drop("c").join(held.select("n", "c"), "n")), "centred")
    sure = now.where(F.col("a.balance") + F.col("balance") <= 1e-6).select("g", "n", "c", "balance", F.col("a.c").alias("own"))
    odd = sure.where("c <> own").select("g", F.struct("n", "c", "balance").alias("x"))  # none where certain has been followed
    sure = odd.join(sure.select("g", F.struct("n", "c", "balance").alias("y")), "g").where((F.col("x.c") != F.col("y.c")) & (F.col("x.balance") + F.col("y.balance") <= 1e-6))

    step = lambda balance: F.floor(F.log1p(F.greatest(balance, F.lit(0.0)) / F.greatest(F.col("width") / 4, F.lit(1.0))) / math.log(1.15))
    least = F.col("balance") - (1 - similarity) / (1 + similarity) / similarity * F.col("size") - 1e-6  # what a text has in common with one of less balance
    now = now.withColumn("inner", F.col("c") == F.col("top")).withColumn("many", F.size("others"))
    heads = F.slice("others", F.lit(1), F.greatest(F.lit(0), F.least(F.col("many"), F.col("many") - F.ceil(least) + 1)).cast("int"))
    each = now.select("g", "n", "c", "home", "size", "balance", "width", "inner", "many", "mask", F.posexplode(heads).alias("at", "h"))
    each = each.withColumn("left", F.col("many") - F.col("at"))  # so many can be in common from here on
    text = F.struct("n", "c", "home", "size", "balance", "left", "many", "mask")
    far = 2 * F.col("left") - F.col("balance") + 1e-6  # a greater balance would need more
    to = F.when(F.col("inner"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    lesser = each.where(far >= F.col("balance")).select("g", "h", "balance", "width", to.alias("to"), far.alias("far"), text.alias("a"))
    lesser = lesser.select("g", "h", "a", "to", F.explode(F.sequence(step(F.col("balance")), step(F.col("far")))).alias("step")).select("g", "h", "a", "step", F.explode("to").alias("inner"))
    greater = each.select("g", "h", step(F.col("balance")).alias("step"), "inner", text.alias("b"))
    both = F.col("a.balance") + F.col("b.balance")
    lower = (F.col("a.balance") < F.col("b.balance")) | ((F.col("a.balance") == F.col("b.balance")) & (F.col("a.n") < F.col("b.n")))
    sized = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6
    alone = lambda a, b: sum((F.bit_count(F.col(a + ".mask")[q].bitwiseAND(F.bitwise_not(F.col(b + ".mask")[q]))) for q in range(4)), F.lit(0))
    shared = F.least(F.col("a.left"), F.col("b.left"), F.col("a.many") - alone("a", "b"), F.col("b.many") - alone("b", "a"))  # at most; a bit that one has alone is of a difference, or more, that it has alone
    enough = (both > 1e-6) & (2 * shared >= both - 1e-6)
    once = (F.col("a.home") != F.col("b.home")) | (F.col("g") == F.col("a.home"))  # texts of one home meet there
    common = lesser.join(greater.hint("merge"), ["g", "h", "step", "inner"]).where(lower & (F.col("a.c") != F.col("b.c")) & sized & enough & once)

    pairs = rare.select(F.col("a.n").alias("l"), F.col("b.n").alias("n")).union(common.select("a.n", "b.n")).union(sure.select("x.n", "y.n"))
    return pairs.select(F.least("l", "n").alias("l"), F.greatest("l", "n").alias("n")).distinct()


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """Those of pairs (l, n; stored) whose texts (n, text; one row each) have the Jaccard similarity or more.

    The rows of a leader follow its own text, in as many parts as its pairs need.
    A text with fewer words than a shingle has one, all its words.
    """
    parts = partitions(pairs.sparkSession)
    limit = max(1000, math.ceil(pairs.count() / (2 * parts)))  # so at most 2 x parts leaders are hot
    hot = pairs.groupBy("l").count().filter(F.col("count") > limit).select("l", F.ceil(F.col("count") / limit).cast("long").alias("salts"))
    dealt = stored(pairs.join(F.broadcast(hot), "l", "left").select("l", "n", F.pmod(F.xxhash64("n"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt")), "dealt")
    members = dealt.join(texts, "n").select("l", "salt", F.lit(True).alias("member"), "n", "text")
    leaders = dealt.select("l", "salt").distinct().join(texts.select(F.col("n").alias("l"), "text"), "l")
    rows = members.union(leaders.select("l", "salt", F.lit(False), "l", "text"))
    rows = rows.repartition(parts, "l", "salt").sortWithinPartitions("l", "salt", "member")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = None
        for b in batches:
            out = []
            for l, member, n, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not member:
                    own = hashed(text, shingle)
                    continue
                other = hashed(text, shingle)
                if min(len(own), len(other)) >= similarity * max(len(own), len(other)):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= similarity * (len(own) + len(other) - both):
                        out.append((l, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["l", "n"])

    small_batches(pairs.sparkSession)
    return rows.mapInArrow(tidy(run), "l long, n long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, parts: int | None = None, bits: int | None = None) -> DataFrame:
    """The first document by doc_id (ids before null) of each group of equal or similar texts, with its own columns; repeated rows leave one.

    Texts are told apart by 64 bits and their length. Null, empty and blank texts
    are similar to each other and to nothing else; ties, one id under several
    texts, go by the text's hash; an empty table stays empty.
    """
    fair = sizes(docs.count())
    parts, bits = parts or fair[0], bits or fair[1]
    rows = sketches(docs, parts, bits)
    first = F.min(F.struct(F.col("_lt_doc").isNull().alias("no"), F.col("_lt_doc").alias("doc"), F.col("_lt_text").alias("text")))
    texts = stored(rows.groupBy("_lt_text").agg(first.alias("_lt_first"), F.first("_lt_parts").alias("_lt_parts")), "texts")
    keyed = docs.withColumn("_lt_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_lt_text", named(F.col("text")))

    def only(of: DataFrame, heads: DataFrame) -> DataFrame:
        heads = heads.select(F.coalesce(F.col("_lt_first")["doc"], F.lit(NULL_ID)).alias("_lt_doc"), F.col("_lt_first")["text"].alias("_lt_text"))
        return of.join(heads, ["_lt_doc", "_lt_text"], "left_semi").dropDuplicates(["_lt_doc", "_lt_text"])

    def found(of: DataFrame) -> DataFrame:
        met = only(keyed.select("_lt_doc", "_lt_text", "text"), texts.join(of, "_lt_text", "left_semi"))
        return stored(met.select(F.col("_lt_text").alias("n"), "text"), "met")

    def alike(pairs: DataFrame) -> DataFrame:
        return similar(pairs, found(pairs.select(F.col("l").alias("_lt_text")).union(pairs.select("n")).distinct()), similarity, shingle).toDF("a", "b")

    def classed(links: DataFrame) -> DataFrame:
        reached = components(links)
        return texts.join(reached, texts._lt_text == reached.n, "left").withColumn("_lt_class", F.coalesce("l", "_lt_text")).drop("n", "l")

    met = stored(meeting(texts.select(F.posexplode("_lt_parts").alias("p", "v")).distinct(), bits), "meetings")
    ends = stored(close(candidates(texts, bits, met), texts, parts, bits), "ends")
    near = stored(alike(stored(leading(ends), "pairs")), "near")
    some = opened(stored(classed(near).select("_lt_text", "_lt_parts", "_lt_class"), "classed"), bits, met)
    large = stored(gathered(some.where(F.col("k") > LARGEST), "c", "s"), "large")
    known = stored(profiles(found(large.select(F.col("n").alias("_lt_text"))), shingle), "profiles")
    central = leading(stored(middles(large, known, parts, bits), "middles"))
    apart = stored(differences(large, known, similarity), "apart")
    pairs = together(some.where(F.col("k") <= LARGEST), bits, parts).union(central).union(certain(apart)).distinct()
    near = stored(near.unionByName(alike(stored(pairs, "pairs"))), "near")
    now = stored(classed(near).select(F.col("_lt_text").alias("n"), F.col("_lt_class").alias("c")), "classed")
    rest = stored(within_bounds(large.select("n").join(now, "n"), known, apart, similarity), "pairs")
    whole = classed(near.unionByName(alike(rest))).groupBy("_lt_class")
    return only(keyed, whole.agg(F.min("_lt_first").alias("_lt_first"))).select(*docs.columns)
