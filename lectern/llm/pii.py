"""Personal data: spans by rules, and more of them by a character-level bidirectional LSTM with CRF transitions.

Rules find what is written by the book. The tagger (``tagger``, trained in numpy)
learns from windows around the rules' own matches, before their numbers are
checked, and from altered and made-up spans: broken by a line's end, with other
separators, without a plus, with words for signs. So it finds what rules miss.
Every character of a text is read, in windows that overlap. Each window is
decoded by itself; then the spans of all windows of a text are reconciled:
pieces that a window's end cut and that overlap become one, of spans that
overlap those stay whose scores add up to most, and what touches a rule's span
goes. What is left must pass the check of its kind: four numbers to 255,
thirteen to nineteen digits with Luhn's sum, seven to fifteen digits, a name, a
sign for at and a domain.

The tagger is fitted on at most ``FIT_TEXTS`` different texts, those with the
least hashes of all that have an at sign or three digits in a row, ``FIT_WINDOWS``
windows of each at most.

Edge cases: a null text is an empty one, without spans; equal texts get equal
spans; a text of any length is read whole, ``ROWS`` windows at a time; a table
without a text to learn from gets rules only; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the rules; fixed values. Quantifiers that never need to give back don't.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

FIT_TEXTS, FIT_WINDOWS = 2000, 4
#: Characters of a window in training and in use, how far windows overlap, and windows side by side.
FIT_CHARS, CHARS, OVERLAP, ROWS = 80, 256, 48, 1024
HIDDEN, ROUNDS, MADE_UP = 12, 5, 200
#: What a span's labels must gain over staying outside.
LEAST_SCORE = 2.0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    twice = [int(c) * 2 for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def shapes(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the rules' patterns, by kind and start, before their numbers are checked."""
    found = []
    if "@" in text:
        free = 0
        for m in AT_DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in NAME:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                free = m.end()
    found += [(1, *m.span()) for m in IP.finditer(text)]
    found += [(2, *m.span()) for m in CARD.finditer(text)]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text)]
    return found


def right(kind: int, value: str) -> bool:
    """Whether a match of a rule passes its check."""
    if kind == 1:
        return all(map(small, value.split(".")))
    n = digits(value)
    return kind == 0 or (13 <= len(n) <= 19 and luhn(n) if kind == 2 else 9 <= len(n) <= 15)


def base(text: str) -> list[tuple[int, int, int]]:
    """Spans by rules alone."""
    return [s for s in shapes(text) if right(s[0], text[s[1] : s[2]])]


def plausible(kind: int, value: str) -> bool:
    """Whether a span that the tagger adds can be what it is taken for."""
    n = digits(value)
    if kind == 0:
        sides = re.split(r"@|\bat\b", value)
        return len(sides) == 2 and any(c.isalnum() for c in sides[0]) and re.search(r"[^\W_](?:\s*\W\s*|\s+dot\s+)[^\W_]", sides[1]) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(map(small, parts)) and not any(c.isalpha() for c in value)
    if any(c.isalpha() for c in value):
        return False
    return 13 <= len(n) <= 19 and luhn(n) if kind == 2 else 7 <= len(n) <= 15


# Labelled windows


def checked(number: str) -> str:
    """A number whose last digit makes Luhn's sum right."""
    return next(n for n in (number[:-1] + str(k) for k in range(10)) if luhn(n))


def made_up(rnd, kind: int) -> str:
    """A span by the book."""
    num = lambda n: "".join(str(k) for k in rnd.integers(0, 10, n))
    word = lambda a, b: "".join(chr(97 + k) for k in rnd.integers(0, 26, rnd.integers(a, b)))
    if kind == 0:
        return rnd.choice([word(2, 9), word(1, 7) + "." + word(2, 8), word(2, 7) + num(2), word(3, 9) + "." + num(2)]) + "@" + word(3, 9) + rnd.choice(["", num(1), "-" + word(2, 5), "." + word(3, 8)]) + "." + rnd.choice(["com", "org", "net", "de", "fr", "es", "co.uk"])
    if kind == 1:
        return ".".join(str(k) for k in rnd.integers(0, 256, 4))
    if kind == 2:
        n = checked(num(rnd.choice([13, 15, 16, 16, 16, 16, 19])))
        gap = rnd.choice(["", "", " ", "-"])
        return gap.join(n[k : k + 4] for k in range(0, len(n), 4))
    lead = "+" + str(rnd.integers(1, 99)) + " "
    return lead + rnd.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(2)}.{num(4)}.{num(4)}", num(9), f"{num(3)}-{num(4)}"])


def altered(rnd, kind: int, value: str) -> str:
    """A span as rules don't know it."""
    if rnd.random() < 0.35:
        at = int(rnd.integers(1, max(2, len(value))))
        return value[:at] + "\n" + value[at:]
    if kind == 0:
        at, dot = rnd.choice([(" @ ", "."), (" at ", "."), ("[at]", "."), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", " . ")])
        name, _, domain = value.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return value.replace(".", rnd.choice(["[.]", " . ", ". ", "(.)"]))
    if kind == 2:
        n = digits(value)
        return rnd.choice([".", "/", "_", "  ", " - "]).join(n[k : k + 4] for k in range(0, len(n), 4))
    n = digits(value)[-10:]
    return rnd.choice([f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", "00" + str(rnd.integers(1, 99)) + " " + n, value.replace("+", "+ "), value.replace(" ", "/")])


def distraction(rnd) -> str:
    """Digits that are nobody's."""
    num = lambda n: "".join(str(k) for k in rnd.integers(0, 10, n))
    return rnd.choice([f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:{num(2)}:{num(2)}", f"{num(2)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"#{num(6)}", "".join(rnd.choice(list("0123456789abcdef"), 40)), f"{num(4)}", f"{num(3)},{num(3)}", f"id {num(7)}", "@" + num(3), f"${num(3)}.{num(2)}", "".join(rnd.choice(list("0123456789abcdef"), 18))])


def windows(batches):
    """Arrow batches of texts to rows (chars, spans): pieces of FIT_CHARS around matches and around other digits, spans as kind, start, end."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        texts, spans = [], []
        for text in b.column(0).to_pylist():
            rnd = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "little"))
            found = [s for s in shapes(text) if s[0] != 2 or 13 <= len(digits(text[s[1] : s[2]])) <= 19]
            places = [s[1] for s in found] + [m.start() for m in list(re.finditer("[0-9]{3}|@", text))[:50]] + [int(rnd.integers(0, len(text)))]
            order = rnd.permutation(len(places))[: FIT_WINDOWS - 1].tolist() + [len(places) - 1]
            for k in dict.fromkeys(order):
                start = max(0, places[k] - int(rnd.integers(5, FIT_CHARS // 2)))
                end = start + FIT_CHARS
                if any(a < start < e or a < end < e for _, a, e in found):
                    continue
                texts.append(text[start:end])
                spans.append([x for kind, a, e in found if start <= a and e <= end for x in (kind, a - start, e - start)])
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["chars", "spans"])


def spliced(rnd, text: str, spans: list, make) -> tuple[str, list]:
    """text with spans, one of which make(kind, value) rewrites, or at a random gap, where make(None, "") writes a new one."""
    whole = [tuple(spans[k : k + 3]) for k in range(0, len(spans), 3)]
    if whole:
        kind, a, e = whole[int(rnd.integers(len(whole)))]
        new = make(kind, text[a:e])
    else:
        gaps = [m.end() for m in re.finditer(r"\s", text[: FIT_CHARS - 40])]
        a = e = gaps[int(rnd.integers(len(gaps)))] if gaps else 0
        kind, new = make(None, "")
        new, whole = (new, [(kind, a, e)] if kind is not None else [])
        text = text[:a] + " " + text[a:]
    grown, out = len(new) - (e - a), []
    for k, s, t in whole:
        out += [k, s, e + grown] if (s, t) == (a, e) else [k, s + grown, t + grown] if s >= e else [k, s, t]
    return text[:a] + new + text[e:], out


def lesson(rows: list, seed: int = 11):
    """Symbols and labels (windows, steps) for training, from labelled windows and from altered and made-up spans put into them."""
    import numpy as np

    from lectern.llm import tagger

    rnd = np.random.default_rng(seed)
    plain = [r for r in rows if not r[1]]
    marked = [r for r in rows if r[1]]
    out = list(rows)
    out += [spliced(rnd, t, s, lambda kind, v: altered(rnd, kind, v)) for t, s in marked]
    for n in range(MADE_UP * len(KINDS)):
        text = plain[int(rnd.integers(len(plain)))][0] if plain else ""
        kind = n % len(KINDS)
        value = made_up(rnd, kind)
        out.append(spliced(rnd, text, [], lambda *_: (kind, value if n // len(KINDS) % 2 else altered(rnd, kind, value))))
        out.append(spliced(rnd, text, [], lambda *_: (None, distraction(rnd))))
    steps = FIT_CHARS + 24
    ids, labels = np.full((len(out), steps), tagger.PAD, np.uint16), np.zeros((len(out), steps), np.int64)
    for row, (text, spans) in enumerate(out):
        text = (text or " ")[:steps]
        ids[row, : len(text)] = tagger.symbols(text)
        for kind, a, e in zip(*(spans[k::3] for k in range(3))):
            if e <= len(text):
                labels[row, a], labels[row, a + 1 : e] = 2 * kind + 1, 2 * kind + 2
    return ids, labels


def suited(docs: DataFrame, most: int) -> DataFrame:
    """text and _lt_h (its hash) of the texts to learn from, with hashes up to most; only these are searched for signs and digits."""
    hashed = docs.select("text", F.xxhash64("text").alias("_lt_h"))
    return hashed.where(F.when(F.col("_lt_h") <= most, F.col("text").rlike("@|[0-9]{3}")).otherwise(False))


def bound(docs: DataFrame, n: int) -> int | None:
    """The n-th least hash of different texts to learn from, or the greatest where there are fewer; None where there are none.

    Searched among ever more of the hashes: first of as many rows as should hold eight times n.
    """
    rows, share = docs.count(), 8 * n
    while True:
        most = 2**63 - 1 if share >= rows else -(2**63) + 2**64 * share // rows
        found = suited(docs, most).select("_lt_h").distinct().orderBy("_lt_h").limit(n).agg(F.max("_lt_h").alias("last"), F.count("*").alias("k")).first()
        if found.k == n or share >= rows:
            return found["last"]
        share *= 8


def fit(docs: DataFrame) -> dict | None:
    """The tagger's parameters, learned in one task from a bounded number of texts of docs; None where there are none."""
    from lectern.llm import tagger

    last = bound(docs, FIT_TEXTS)
    if last is None:
        return None
    some = suited(docs, last).groupBy("_lt_h").agg(F.first("text").alias("text")).select("text")

    def run(batches):
        import pyarrow as pa

        rows = sorted({(t, tuple(s)) for b in batches for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        if rows:
            found = tagger.trained(*lesson([(t, list(s)) for t, s in rows]), len(KINDS), HIDDEN, ROUNDS)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)])], ["model"])

    learned = some.mapInArrow(windows, "chars string, spans array<int>").repartition(1).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(learned.model) if learned else None


# Spans


def starts(n: int) -> list[int]:
    """Where the windows of a text of n characters begin; the last one reaches its end."""
    return [0] if n <= CHARS else [*range(0, n - CHARS, CHARS - OVERLAP), n - CHARS]


def tagged(p: dict, group: list) -> list[tuple[int, int, int, int, float]]:
    """(row, kind, start, end, score) in windows (a list of symbol arrays), those of about one length side by side."""
    import numpy as np

    from lectern.llm import tagger

    order, out = sorted(range(len(group)), key=lambda k: len(group[k])), []
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        ids = np.full((len(group[some[-1]]), len(some)), tagger.PAD, np.uint16)
        for col, k in enumerate(some):
            ids[: len(group[k]), col] = group[k]
        if not len(ids):
            continue
        f, b = tagger.hidden(p, ids)
        open_ = np.flatnonzero(~tagger.outside(p, f, b))
        by: dict[int, list] = {}
        for col in open_.tolist():
            by.setdefault(len(group[some[col]]), []).append(col)
        for n, cols in by.items():
            e = tagger.scores(p, f[:n, cols], b[:n, cols])
            labels = tagger.decoded(p, e)
            for c, col in enumerate(cols):
                path = labels[:, c]
                for a in np.flatnonzero((path % 2 == 1)).tolist():
                    end = a + 1
                    while end < n and path[end] == path[a] + 1:
                        end += 1
                    gain = float(e[np.arange(a, end), c, path[a:end]].sum() - e[a:end, c, 0].sum())
                    out.append((some[col], int(path[a]) // 2, a, end, gain))
    return out


def reconciled(text: str, rules: list, found: list) -> list[tuple[int, int, int]]:
    """Spans to add to those of rules: of found (kind, start, end, score, cut), over the whole text."""
    whole: list[list] = []
    for kind, a, e, score, cut in sorted(found):
        last = whole[-1] if whole else None
        if last and last[0] == kind and a < last[2] and (cut or last[4]):
            last[2], last[3], last[4] = max(last[2], e), max(last[3], score), True
        else:
            whole.append([kind, a, e, score, cut])
    ends = sorted((e, a, kind, score) for kind, a, e, score, _ in whole if score >= LEAST_SCORE)
    best: list[tuple[float, list]] = [(0.0, [])]  # the best choice among the spans that end first
    for k, (e, a, kind, score) in enumerate(ends):
        before = best[bisect.bisect_right(ends, a, hi=k, key=lambda x: x[0])]
        with_it = (before[0] + score, (before[1], (kind, a, e)))
        best.append(max(best[-1], with_it, key=lambda x: x[0]))
    chosen, at = [], best[-1][1]
    while at:
        at, span = at
        chosen.append(span)
    out = []
    for kind, a, e in reversed(chosen):
        while a < e and text[a].isspace():
            a += 1
        while a < e and text[e - 1].isspace():
            e -= 1
        k = bisect.bisect_left(rules, a + 1, key=lambda s: s[1])
        if a < e and not any(s[1] < e and s[2] > a for s in rules[max(0, k - 8) : k + 8]) and plausible(kind, text[a:e]):
            out.append((kind, a, e))
    return out


def found_in(texts: list[str], p: dict | None) -> list[tuple[list, list]]:
    """(rules' spans, added spans), both by kind and start, of each text."""
    from lectern.llm import tagger

    rules = [base(t) for t in texts]
    raw: list[list] = [[] for _ in texts]

    def close(pool):
        for row, kind, a, e, score in tagged(p, [w for _, _, _, w in pool]):
            k, start, n, w = pool[row]
            cut = (a == 0 and start > 0) or (e == len(w) and start + e < n)
            raw[k].append((kind, start + a, start + e, score, cut))

    pool = []
    for k, text in enumerate(texts if p else []):
        ids = tagger.symbols(text)
        for s in starts(len(ids)) if len(ids) else []:
            pool.append((k, s, len(ids), ids[s : s + CHARS]))
            if len(pool) == 4 * ROWS:
                close(pool)
                pool = []
    if pool:
        close(pool)
    return [(r, sorted(reconciled(t, sorted(r, key=lambda s: s[1]), list(set(x))))) for t, r, x in zip(texts, rules, raw)]


def detect(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), in code points, end exclusive, by kind as in KINDS, then start."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = found_in([t or "" for t in b.column(1).to_pylist()], model)
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": e} for k, a, e in f[side]] for f in found], pa.list_(span)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id long, base {spans}, added {spans}")
