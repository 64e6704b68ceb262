"""Substring dedup by super-k-mer partitioning.

Windows of 20 words are routed by their minimiser, the least hash of 3 words in
a row. Consecutive windows that share one travel as one packed string to its
bucket; there strings with one minimiser are sorted together and their windows
counted exactly, by their words. Equal strings of one map task are combined
before the shuffle, so a stretch that very many documents share arrives once
from each task; what is removed there already doesn't go to the bucket. Minimisers that would fill a good part of a bucket are found on
a sample of the documents, which only plans the routing; their windows travel
singly, by a hash of the whole window, and so spread over all buckets.

Edge cases: a null text has no words, and its kept text is empty; texts under
20 words are kept whole; rows with one doc_id and one text are the same document
and get the same result; rows with one doc_id and other texts are ordered by a
hash of the text; null ids come first; an empty table gives an empty result;
a very long text is split and hashed whole by one task; windows of one document
that are equal are tied by their start; other columns pass through, and the
columns added here replace any of the same name (names that start with _lt_ are
not to be used).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NULL_ID, pack, partitions, row_hash, small_batches, tidy, unpack, with_fields

WINDOW = 20
GRAM = 3
#: Bytes of text that a bucket stands for.
BUCKET_BYTES = 4 << 20
#: Bytes of text that are combined before the shuffle.
CELL_BYTES = 4 << 20
#: zstd level of what travels: higher ones save a few hundredths of the shuffle for several times the time.
LEVEL = 6
#: Documents looked at, at least, to find minimisers that are too common; more where there are many buckets.
PLAN_DOCS = 8000


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _rolled(hashes, n):
    """A hash of each n neighbours, in order."""
    import numpy as np

    count = len(hashes) - n + 1
    out = hashes[:count].copy()
    for k in range(1, n):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count])
    return _mix(out)


def super_kmers(docs: list[list[bytes]], window: int = WINDOW, gram: int = GRAM):
    """Words of all documents, and arrays (doc, first word, windows, minimiser hash) of their super-k-mers.

    A run ends where the leftmost least gram changes its place, so no run holds
    a window twice. first word counts over all documents together.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    if window - gram >= 255:
        raise ValueError("runs of windows are counted in a byte")
    flat = [w for d in docs for w in d]
    none = np.zeros(0, np.int64)
    if len(flat) < window:
        return flat, none, (none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    of_word = np.fromiter(map(xxh64_intdigest, number), np.uint64, len(number))
    hashes = of_word[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))]
    least = _rolled(hashes, gram)
    at = np.arange(len(least))
    left, have = window - gram + 1, 1
    while have < left:  # the least of twice as many neighbours, each time
        step = min(have, left - have)
        a, b = least[:-step], least[step:]
        at = np.where(a <= b, at[:-step], at[step:])
        least = np.minimum(a, b)
        have += step
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    begins = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(docs)), lengths)[: len(at)]
    starts = np.nonzero(np.arange(len(at)) + window <= (begins + lengths)[doc])[0]
    if not len(starts):
        return flat, begins, (none, none, none, none.astype(np.uint64), hashes)
    place = at[starts]
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = starts[new]
    count = np.diff(np.append(np.nonzero(new)[0], len(starts)))
    return flat, begins, (doc[first], first, count, least[first], hashes)


def _singly(runs, hot, window):
    """Runs with a hot minimiser as single windows under a hash of the window."""
    import numpy as np

    doc, first, count, key, hashes = runs
    mask = np.isin(key, hot)
    if not mask.any():
        return doc, first, count, key
    n = count[mask]
    start = np.repeat(first[mask], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = hashes[start].copy()
    for k in range(1, window):
        own = _mix(own * np.uint64(0xD6E8FEB86659FD93) + hashes[start + k])
    doc, first, count, key = (np.concatenate(x) for x in ((doc[~mask], np.repeat(doc[mask], n)), (first[~mask], start), (count[~mask], np.ones(len(start), np.int64)), (key[~mask], _mix(own))))
    order = np.argsort(first, kind="stable")
    return doc[order], first[order], count[order], key[order]


def _cells(batches, most: int) -> Iterator[list]:
    """Rows (id, hash, words) of Arrow batches, joined to cells, each in order of id and hash without repeated rows."""
    rows, held = [], 0

    def cell():
        rows.sort(key=lambda r: r[:2])
        return rows[:1] + [b for a, b in pairwise(rows) if a[:2] != b[:2]]

    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if t:
                rows.append((i, h, t.encode("utf-8", "surrogatepass").split()))
                held += len(t)
                if held >= most:
                    yield cell()
                    rows, held = [], 0
    if rows:
        yield cell()


def _sent(batches, hot, buckets, window, gram):
    """Packed super-k-mers of each cell by bucket; of equal ones the first travels, the others are removed here, in a row of a negative bucket."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    for cell in _cells(batches, CELL_BYTES):
        flat, begins, runs = super_kmers([r[2] for r in cell], window, gram)
        if not len(runs[0]):
            continue
        doc, first, count, key = _singly(runs, hot, window)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        ends = first + count + window - 1
        packed = [b" ".join(flat[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
        seen: dict[bytes, int] = {}
        own = np.fromiter((seen.setdefault(p, i) == i for i, p in enumerate(packed)), bool, len(packed))
        ids = np.array([r[0] for r in cell], np.int64)
        salt = np.array([r[1] for r in cell], np.int64)
        start = first - begins[doc]
        order = np.lexsort((key, bucket))
        order = order[own[order]]
        some, edges = np.unique(bucket[order], return_index=True)
        out = []
        for k, a, b in zip(some.tolist(), edges.tolist(), [*edges.tolist()[1:], len(order)]):
            go = order[a:b]
            table, at = np.unique(doc[go], return_inverse=True)
            blob = pack([ids[table], salt[table], at.astype(np.uint32), start[go].astype(np.uint32), count[go].astype(np.uint8), np.diff(key[go] >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32), b"\n".join([packed[i] for i in go.tolist()])], LEVEL)
            out.append((k, blob))
        gone = np.nonzero(~own)[0]
        if len(gone):
            table, at = np.unique(doc[gone], return_inverse=True)
            spread = xxh64_intdigest(ids.tobytes() + salt.tobytes()) >> 2
            out.append((-1 - spread, pack([ids[table], salt[table], at.astype(np.uint32), start[gone].astype(np.uint32), count[gone].astype(np.uint8)], LEVEL)))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["_lt_bucket", "_lt_blob"])


def _repeats(blobs: list[bytes], window: int):
    """(id, hash, first window, windows) of all runs of windows that start earlier elsewhere."""
    import numpy as np

    parts = [unpack(b) for b in blobs]
    ids, salt, start, count, key = (np.concatenate(x) for x in zip(*((p[0][p[2]], p[1][p[2]], p[3].astype(np.int64), p[4].astype(np.int64), np.cumsum(p[5].astype(np.uint64))) for p in parts)))
    strings = [s for p in parts if len(p[2]) for s in p[6].split(b"\n")]
    order = np.lexsort((start, salt, ids, key))
    edges = np.nonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))[0] if len(order) else np.zeros(1, np.int64)
    found = []
    for a in np.nonzero(np.diff(edges) > 1)[0].tolist():
        first: dict[bytes, int] = {}  # of each string: the row that starts first
        for i in order[edges[a] : edges[a + 1]].tolist():
            j = first.setdefault(strings[i], i)
            if j != i and (ids[i], salt[i], start[i]) != (ids[j], salt[j], start[j]):  # a repeated row is not another document
                found.append((ids[i], salt[i], start[i], count[i]))
        if len(first) < 2:
            continue
        best: dict[bytes, tuple] = {}
        mine = []
        for s, i in first.items():  # in order of (id, hash), but runs of one document may lie anywhere
            w = s.split(b" ")
            at = (int(ids[i]), int(salt[i]))
            for j in range(int(count[i])):
                x = b" ".join(w[j : j + window])
                here = (*at, int(start[i]) + j)
                mine.append((x, here))
                if best.setdefault(x, here) > here:
                    best[x] = here
        found += [(*here[:3], 1) for x, here in mine if best[x] < here]
    return [np.array([f[k] for f in found], np.int64) for k in range(4)]


def _counted(batches, window):
    """Ranges for each bucket's blobs, which come one after another, and those of runs that their cells removed."""
    import numpy as np
    import pyarrow as pa

    def out(ids, salt, start, count):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(salt, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64())], ["_lt_id", "_lt_hash", "s", "n"])

    now, blobs = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k < 0:
                ids, salt, at, start, count = unpack(blob)
                yield out(ids[at], salt[at], start.astype(np.int64), count.astype(np.int64))
                continue
            if k != now and blobs:
                yield out(*_repeats(blobs, window))
                blobs = []
            now = k
            blobs.append(blob)
    if blobs:
        yield out(*_repeats(blobs, window))


def _kept(batches, width: int, window: int):
    """The first width columns, and the words left outside the ranges in the last."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        total, removed, kept = [], [], []
        for t, ranges in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()):
            w = (t or "").encode("utf-8", "surrogatepass").split()
            total.append(len(w))
            if ranges:
                step = np.zeros(len(w) + 1, np.int64)
                for r in ranges:
                    step[r["s"]] += 1
                    step[r["s"] + r["n"] + window - 1] -= 1
                stay = np.nonzero(np.cumsum(step[:-1]) == 0)[0]
                w = [w[i] for i in stay.tolist()]
            removed.append(total[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*b.schema.names[:width], "n_words", "n_removed", "kept_text"])


def _common(rows: DataFrame, docs: int, buckets: int, window: int, gram: int):
    """Hashes of minimisers that would fill over half a bucket, found on a sample; at most 2 x buckets of them."""
    import numpy as np

    every = max(1, docs // max(PLAN_DOCS, buckets // 4))

    def run(batches):
        import pyarrow as pa

        for cell in _cells(batches, CELL_BYTES):
            key, n = np.unique(super_kmers([r[2] for r in cell], window, gram)[2][3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["k", "n"])

    sample = rows.filter(F.pmod(row_hash(F.col("_lt_id"), F.lit("plan")), F.lit(every)) == 0)
    counts = sample.mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(16.0), F.col("t") / (2 * buckets)))
    return np.array([r.k for r in hot.select("k").collect()], np.int64).view(np.uint64)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_lt_id, _lt_hash of documents, and first window s and number n of runs of windows that start earlier elsewhere."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*_identity(), F.col("text").alias("_lt_t"))
    seen = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    buckets = max(partitions(spark), (seen.b or 0) // BUCKET_BYTES)
    hot = _common(rows, seen.n, buckets, window, gram)
    sent = rows.mapInArrow(tidy(lambda it: _sent(it, hot, buckets, window, gram)), "_lt_bucket long, _lt_blob binary")
    met = sent.repartition(partitions(spark), "_lt_bucket").sortWithinPartitions("_lt_bucket")
    return met.mapInArrow(tidy(lambda it: _counted(it, window)), "_lt_id long, _lt_hash long, s long, n long")


def _identity():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_lt_id"), row_hash(F.col("text")).alias("_lt_hash")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_removed and kept_text: words left when those covered by a window that starts earlier elsewhere go."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    ranges = repeats(docs, window, gram).groupBy("_lt_id", "_lt_hash").agg(F.collect_list(F.struct("s", "n")).alias("_lt_ranges"))
    keyed = docs.select(*docs.columns, *_identity())
    joined = keyed.join(ranges, ["_lt_id", "_lt_hash"], "left").select(*docs.columns, F.col("text").alias("_lt_t"), "_lt_ranges")
    width = len(docs.columns)
    return joined.mapInArrow(tidy(lambda it: _kept(it, width, window)), with_fields(docs, "n_words long, n_removed long, kept_text string"))
