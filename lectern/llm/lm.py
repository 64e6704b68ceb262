"""Language-model scores by deleted interpolation.

P(w | v) mixes three maximum-likelihood estimates: c(v,w)/c(v), c(w)/N and
1/(V+1). The weights depend on a bucket of the context's frequency and are
learned by expectation-maximisation on held-out counts: one seventh of the
training documents (the tuning fold) is left out of the counts for that, and put
back for the final ones. Every step of EM sums over all held-out counts, at full
precision, where they lie.

Counts are of all training documents. A cell of documents sends its distinct
words and pairs of words, as sorted hashes with their counts, to buckets by
hash; a bucket adds up and answers in the same order; the cell's own packed
record of word numbers, sent along, takes the answers. No text moves, and equal
words of a cell move once. A cell's work and rows grow with its own words, never
with the number of buckets: buckets that it has nothing for get nothing, and
where each gets little, the rows are slices of one array.

Words are told apart by XXH64, pairs of words by 64 bits mixed of two of these;
of 10^11 different pairs about 270 would share their hash with another one and
be counted together.

Edge cases: a null text is an empty one and has one token, the end; a null
doc_id belongs to training; repeated rows each count and each get a score, and
ties need no order; a very long text is one cell, held whole by one task; with
no training document every estimate is the uniform one; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
Cells depend on the order of rows, so the input should be a stored table: then a
lost task makes the same cells again.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import from_planes, pack, partitions, planes, small_batches, stored, unpack

FOLDS = 7
HELD_OUT, TUNING = 2, 5
#: Bytes of text in a cell, and that a bucket stands for.
CELL_BYTES = 10 << 20
BUCKET_BYTES = 16 << 20
#: Hashes for each bucket, on average, from which on a cell packs them by bucket.
DENSE = 256
CONTEXTS = 65
#: EM ends after so many rounds, or when no weight moves by more than this.
ROUNDS = 60
SETTLED = 1e-5
LEAST_WEIGHT = 1e-6
END, START = b"\n", b" "  # no word has these


def _hashes(words):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 5) for w in words), np.uint64, len(words))


def _pairs(of_word, number, lengths):
    """A hash of each token and the one before it; START, the last of of_word, before each document."""
    import numpy as np

    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(lengths) - lengths] = len(of_word) - 1
    h = (of_word[before] * np.uint64(0x9E3779B97F4A7C15)) ^ (of_word[before] >> np.uint64(29))
    h = (h + of_word[number]) * np.uint64(0xD6E8FEB86659FD93)
    return before, h ^ (h >> np.uint64(32))


def _cells(batches):
    rows, held = [], 0
    for b in batches:
        for i, fold, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            w = (t or "").encode("utf-8", "surrogatepass").lower().split()
            w.append(END)
            rows.append((i, fold, w))
            held += len(t or "") + 64
            if held >= CELL_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _slices(raw, edges):
    """Byte slices of an array of records at edges, without a copy of each."""
    import numpy as np
    import pyarrow as pa

    offsets = (np.asarray(edges, np.int64) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


ASKED = "to long, cell long, slot long, dense boolean, blob binary"
ANSWERED = "cell long, slot long, dense boolean, blob binary, n_all long, v_all long, n_main long, v_main long"


def _batch(schema: str, *columns):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    n = len(columns[1])
    made = [c if isinstance(c, pa.Array) else pa.array([None] * n if c is None else c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    made += [pa.nulls(n, kinds[k]) for _, k in fields[len(columns) :]]
    return pa.RecordBatch.from_arrays(made, [f for f, _ in fields])


def _sent(cell: int, kind: int, h, counts, buckets: int):
    """Rows for the buckets of hashes h and their counts; kind 0: words, 1: pairs."""
    import numpy as np

    own = (h % np.uint64(buckets)).astype(np.int64)
    go = np.argsort(own, kind="stable")
    some, edges = np.unique(own[go], return_index=True)
    edges = np.append(edges, len(h))
    h, counts = h[go] // np.uint64(buckets), [c[go] for c in counts]
    dense = len(h) >= DENSE * len(some)
    if dense:
        blobs = [pack([planes(np.diff(h[a:b], prepend=np.uint64(0))), *(planes(c[a:b]) for c in counts)]) for a, b in pairwise(edges.tolist())]
    else:
        raw = np.empty(len(h), [("h", "<u8"), ("main", "<u4"), ("tune", "<u4")])
        raw["h"], raw["main"], raw["tune"] = h, *counts
        blobs = _slices(raw, edges)
    return _batch(ASKED, some, [cell] * len(some), 2 * some + kind, [dense] * len(some), blobs)


def _asked(batches, buckets: int):
    """Of each cell: what it asks of each bucket, and its record."""
    import numpy as np
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    part = TaskContext.get().partitionId()
    for k, rows in enumerate(_cells(batches)):
        lengths = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
        fold = np.array([r[1] for r in rows], np.uint8)
        flat = [w for r in rows for w in r[2]]
        names = dict.fromkeys(flat)
        names.pop(END)
        names = [END, *names, START]
        index = {w: i for i, w in enumerate(names)}
        number = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))
        words = b"\n".join(names[1:-1])
        cell = xxh64_intdigest(f"{part}/{k}/{rows[0][0]}/{len(rows)}".encode() + words) >> 1
        of_word = _hashes(names)
        of_token = np.repeat(fold, lengths)
        main, tune = (of_token != HELD_OUT) & (of_token != TUNING), of_token == TUNING
        one = [np.bincount(number[m], minlength=len(names)).astype(np.uint32) for m in (main, tune)]
        one[0][-1], one[1][-1] = np.count_nonzero((fold != HELD_OUT) & (fold != TUNING)), np.count_nonzero(fold == TUNING)
        pair, at = np.unique(_pairs(of_word, number, lengths)[1], return_inverse=True)
        two = [np.bincount(at[m], minlength=len(pair)).astype(np.uint32) for m in (main, tune)]
        order = np.argsort(of_word)
        yield _sent(cell, 0, of_word[order], [c[order] for c in one], buckets)
        yield _sent(cell, 1, pair, two, buckets)
        ids = np.array([r[0] or 0 for r in rows], np.int64)
        none = np.array([r[0] is None for r in rows], np.uint8)
        small = number.astype(np.uint16) if len(names) < 65536 else number.astype(np.uint32)
        record = pack([ids, none, fold, lengths.astype(np.uint32), planes(small), bytes([small.itemsize]), words], 3)
        yield _batch(ASKED, [-1 - cell], [cell], [-1], [True], [record])


def _answered(batches, buckets: int):
    """Sums of each bucket, given back to every cell in the order it asked; cells' own records pass through."""
    import numpy as np

    start = _hashes([START])[0] // np.uint64(buckets)
    starts = int(_hashes([START])[0] % np.uint64(buckets))
    raw = np.dtype([("h", "<u8"), ("main", "<u4"), ("tune", "<u4")])

    def read(dense, blob):
        if not dense:
            rows = np.frombuffer(blob, raw)
            return rows["h"], rows["main"], rows["tune"]
        h, main, tune = unpack(blob)
        return np.cumsum(from_planes(h, np.uint64)), from_planes(main, np.uint32), from_planes(tune, np.uint32)

    def answer(slot, asked):
        parts = [read(d, b) for _, d, b in asked]
        h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        main, tune = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(h)).astype(np.uint64) for k in (1, 2))
        sums = [[None] * len(asked) for _ in range(4)]
        if not slot & 1:  # the totals of a bucket's words go along with its first answer
            real = (h != start) | (slot >> 1 != starts)
            every = main + tune
            for s, x in zip(sums, (every[real].sum(), np.count_nonzero(every[real]), main[real].sum(), np.count_nonzero(main[real]))):
                s[0] = int(x)
        edges = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
        dense = len(at) >= DENSE * len(asked)
        if dense:
            blobs = [pack([planes(main[at[a:b]]), planes(tune[at[a:b]])]) for a, b in pairwise(edges)]
        else:
            blobs = _slices(np.rec.fromarrays([main[at], tune[at]], dtype=[("main", "<u8"), ("tune", "<u8")]), edges)
        return _batch(ANSWERED, [c for c, _, _ in asked], [slot] * len(asked), [dense] * len(asked), blobs, *sums)

    now, asked = None, []
    for b in batches:
        for cell, slot, dense, blob in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
            if slot != now and asked:
                yield answer(now, asked)
                asked = []
            now = slot
            if slot < 0:
                yield _batch(ANSWERED, [cell], [slot], [True], [blob])
            else:
                asked.append((cell, dense, blob))
    if asked:
        yield answer(now, asked)


def _known(record: bytes, replies: list[tuple[int, bool, bytes]], buckets: int) -> tuple:
    """A cell's record with the counts of its words, START last, and of each token's pair; and the held-out counts of its tuning documents.

    Held-out counts are (bucket of the context, the pair's estimate, the word's count, tokens).
    """
    import numpy as np

    ids, none, fold, lengths, raw, kind, words = unpack(record)
    lengths = lengths.astype(np.int64)
    number = from_planes(raw, f"u{kind[0]}").astype(np.int64)
    of_word = _hashes([END, *(words.split(b"\n") if words else []), START])
    before, h = _pairs(of_word, number, lengths)
    pair, at = np.unique(h, return_inverse=True)

    def read(dense, blob):
        if not dense:
            rows = np.frombuffer(blob, "<u8").reshape(-1, 2)
            return rows[:, 0], rows[:, 1]
        return [from_planes(x, np.uint64) for x in unpack(blob)]

    parts = sorted(replies, key=lambda r: r[0])
    parts = [[read(d, b) for s, d, b in parts if s & 1 == k] for k in (0, 1)]

    def restored(k, h, order):
        place = order[np.argsort((h[order] % np.uint64(buckets)).astype(np.int64), kind="stable")]
        found = []
        for j in (0, 1):
            out = np.empty(len(h), np.int64)
            out[place] = np.concatenate([p[j] for p in parts[k]]).astype(np.int64)
            found.append(out)
        return found

    main, tune = restored(0, of_word, np.argsort(of_word))
    pair_main, pair_tune = restored(1, pair, np.arange(len(pair)))
    every, pairs = main + tune, (pair_main + pair_tune)[at]
    mine = np.repeat(fold == TUNING, lengths)
    context = main[before[mine]]
    p = np.where(context > 0, pair_main[at[mine]] / np.maximum(context, 1), 0.0)
    held = [_context(context), p, main[number[mine]]]
    order = np.lexsort(held[::-1])
    held = [x[order] for x in held]
    first = np.nonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in held], axis=0)]))[0] if len(order) else order
    held = [*(x[first] for x in held), np.diff(np.append(first, len(order)))]
    return pack([ids, none, fold, lengths.astype(np.uint32), raw, kind, planes(every), planes(pairs)], 3), held


#: Of cells with all answers: rows with a blob; rows of totals; rows of held-out counts (context, p, word, n_all tokens).
MET = "blob binary, context long, p double, word long, n_all long, v_all long, n_main long, v_main long"


def _met(batches, buckets: int):
    """What cells are once they have all answers, as rows of MET."""

    def whole():
        blob, held = _known(record, replies, buckets)
        yield _batch(MET, [blob], [None])
        yield _batch(MET, None, *held)

    now, record, replies = None, None, []
    for b in batches:
        for cell, slot, dense, blob, *sums in zip(*(c.to_pylist() for c in b.columns)):
            if cell != now:
                if record:
                    yield from whole()
                now, record, replies = cell, None, []
            if sums[0] is not None:
                yield _batch(MET, None, [None], [None], [None], *([x] for x in sums))
            if slot < 0:
                record = blob
            else:
                replies.append((slot, dense, blob))
    if record:
        yield from whole()


def _context(c):
    """The bucket of a context's frequency: bits of the number."""
    import numpy as np

    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def learned(held: DataFrame, total: int, distinct: int):
    """Weights (pair, word, uniform) of each context bucket from held-out counts (context, p, word, tokens), by EM.

    A round is one sum over all rows, which gives at most CONTEXTS rows. Sums are
    rounded to 9 decimals a token, so that their order doesn't show.
    """
    import numpy as np

    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (CONTEXTS, 1))
    weights[0] = [0.0, 0.5, 0.5]
    for _ in range(ROUNDS):
        of = lambda k: F.get(F.lit(weights[:, k].tolist()), F.col("context").cast("int"))
        parts = F.array(of(0) * F.col("p"), of(1) * (F.col("word") / max(1, total)), of(2) / (distinct + 1))
        shares = held.select("context", "tokens", parts.alias("x")).withColumn("t", F.col("tokens") / (F.col("x")[0] + F.col("x")[1] + F.col("x")[2]))
        found = shares.groupBy("context").agg(*(F.sum(F.col("x")[k] * F.col("t")).alias(f"s{k}") for k in range(3)), F.sum("tokens").alias("n")).collect()
        moved = 0.0
        for r in found:
            w = np.maximum(np.round(np.array([r.s0, r.s1, r.s2]) / r.n, 9), LEAST_WEIGHT * np.array([r.context > 0, 1, 1]))
            w /= w.sum()
            moved = max(moved, float(np.abs(w - weights[r.context]).max()))
            weights[r.context] = w
        if moved <= SETTLED:
            break
    return weights


def scored(docs: DataFrame) -> tuple[DataFrame, object]:
    """A row for each document with its figures, and the learned weights."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, size // BUCKET_BYTES)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(0)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), fold, "text")
    asked = rows.mapInArrow(lambda it: _asked(it, buckets), ASKED)
    answered = asked.repartition(n, "to").sortWithinPartitions("to", "slot").mapInArrow(lambda it: _answered(it, buckets), ANSWERED)
    met = answered.repartition(n, "cell").sortWithinPartitions("cell")
    cells = stored(met.mapInArrow(lambda it: _met(it, buckets), MET), "lm-cells")

    totals = cells.where("v_all is not null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_all", "v_all", "n_main", "v_main"))).first()
    n_all, v_all, n_main, v_main = totals
    weights = learned(cells.where("context is not null").select("context", "p", "word", F.col("n_all").alias("tokens")), n_main, v_main)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for blob in b.column(0).to_pylist():
                ids, none, fold, lengths, raw, kind, every, pairs = unpack(blob)
                lengths, n = lengths.astype(np.int64), len(ids)
                number, every, pairs = from_planes(raw, f"u{kind[0]}").astype(np.int64), from_planes(every, np.int64), from_planes(pairs, np.int64)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                before[np.cumsum(lengths) - lengths] = len(every) - 1
                doc = np.repeat(np.arange(n), lengths)
                word, context = every[number], every[before]
                w = weights[_context(context)]
                p = w[:, 0] * np.where(context > 0, pairs / np.maximum(context, 1), 0.0) + w[:, 1] * (word / max(1, n_all)) + w[:, 2] / (v_all + 1)
                base = np.log10((word + 1) / (n_all + v_all + 1))
                add = [np.bincount(doc, x, n) for x in (word > 0, base, np.log10(p))]
                columns = [pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(fold == HELD_OUT), pa.array(lengths, pa.int64()), pa.array(add[0].astype(np.int64)), pa.array([n_all] * n, pa.int64()), pa.array(add[1]), pa.array(add[2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return cells.where("blob is not null").select("blob").mapInArrow(score, schema), weights
