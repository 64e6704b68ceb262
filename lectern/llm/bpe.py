"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one last token that BPE
would leave there. The suffix automaton of all tokens, moved on by each byte,
holds the longest end of the prefix that occurs inside of a token; the tokens
that end at the prefix are ends of that match, found along suffix links. The
longest of them that BPE would not have merged differently with the last token
before it (the pair-compatibility test) is the one to store. Following the
stored tokens back from the end gives the ids.

The automaton is built once, on the driver, from the vocabulary; its transitions
never grow. A worker makes it once and keeps what it has met of pieces (their
ids as bytes, so that garbage collection has nothing to follow) and pairs, both
bounded.

Edge cases: a null text is empty and has no ids; a very long text is encoded
whole, piece by piece; special tokens in a text get their own id, as the
tokenizers library does; other columns pass through, and the columns added here
replace any of the same name (names that start with _lt_ are not to be used);
repeated rows each count and get equal results, so there are no ties; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, tidy, with_fields

#: Splits a text before merges; fixed by the vocabulary file's byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids each worker keeps, at most; beyond that it starts anew.
KEPT_PIECES = 400_000
KEPT_BYTES = 64
#: Pairs of tokens whose compatibility each worker keeps, at most.
KEPT_PAIRS = 500_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The suffix automaton of many strings: each of its states stands for strings that occur inside of them at the same ends.

    A string that is given whole is the longest of its state, as it also occurs
    with nothing before it.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _exact(self, at: int, byte: int) -> int:
        """The state of at's longest string and byte, split from the one that holds longer strings too."""
        to = self.next[at][byte]
        if self.length[to] == self.length[at] + 1:
            return to
        part = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = part
        while at >= 0 and self.next[at].get(byte) == to:
            self.next[at][byte] = part
            at = self.link[at]
        return part

    def add(self, text: bytes) -> None:
        last = 0
        for byte in text:
            if byte in self.next[last]:
                last = self._exact(last, byte)
                continue
            at, last = last, self._state(self.length[last] + 1, {}, 0)
            while at >= 0 and byte not in self.next[at]:
                self.next[at][byte] = last
                at = self.link[at]
            if at >= 0:
                self.link[last] = self._exact(at, byte)

    def state(self, text: bytes) -> int:
        at = 0
        for byte in text:
            at = self.next[at][byte]
        return at

    def tables(self) -> tuple:
        """Transitions as arrays of state x 256 + byte and the next state; suffix links; lengths."""
        import numpy as np

        n = sum(map(len, self.next))
        keys = np.fromiter((s << 8 | b for s, to in enumerate(self.next) for b in to), np.int64, n)
        to = np.fromiter((t for to in self.next for t in to.values()), np.int32, n)
        return keys, to, np.array(self.link, np.int32), np.array(self.length, np.int32)


class _Kept(dict):
    """Ids of pieces that were met before, as bytes of 32-bit numbers; others are encoded, and short ones kept."""

    def __init__(self, bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = array("I", self.bpe.piece(raw)).tobytes()
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def tables(spec: bytes) -> dict:
    """What encoding and decoding need of a byte-level vocabulary, given as the bytes of a tokenizers file: plain values and arrays."""
    data = json.loads(spec)
    names, vocab = byte_names(), data["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    raw = lambda s: bytes(names[c] for c in s)
    # Inside, bytes are numbered by their value and merged tokens after them by rank.
    inner = {c: b for c, b in names.items()}
    halves = [(b, b) for b in range(256)]
    joined: dict[tuple[int, int], int] = {}
    for a, b in merges:
        pair = (inner[a], inner[b])
        joined[pair] = len(halves)
        inner.setdefault(a + b, len(halves))
        halves.append(pair)
    outer = [0] * len(halves)
    by_bytes: dict[bytes, int] = {}
    for s, t in inner.items():
        outer[t] = vocab[s]
        by_bytes[raw(s)] = t
    automaton = Automaton()
    for s in by_bytes:
        automaton.add(s)
    ends = {automaton.state(s): t for s, t in by_bytes.items()}
    special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
    named = {i: raw(s) for s, i in vocab.items() if s not in special} | {i: s.encode() for s, i in special.items()}
    return {"halves": halves, "joined": joined, "outer": outer, "automaton": automaton.tables(), "ends": ends, "special": special, "bytes": [named.get(i, b"") for i in range(max(named) + 1)]}


class Bpe:
    """Encoder and decoder of a vocabulary's tables; what it keeps is bounded."""

    def __init__(self, made: dict):
        import regex

        self.halves, self.joined, self.outer, self.special, self.bytes = (made[k] for k in ("halves", "joined", "outer", "special", "bytes"))
        keys, to, link, length = made["automaton"]
        ends, lengths = made["ends"], length.tolist()
        # A state: {byte: state}, the tokens (and lengths) that end its longest string, the longest first, those that
        # end its shorter ones too, its length, and the state of its suffix link.
        states = [[{}, (), (), n, None] for n in lengths]
        for k, t in zip(keys.tolist(), to.tolist()):
            states[k >> 8][0][k & 255] = states[t]
        for s in length.argsort(kind="stable").tolist()[1:]:
            shorter = states[link[s]]
            states[s][1:3] = ((ends[s], lengths[s], ends[s] << 32), *shorter[1]) if s in ends else shorter[1], shorter[1]
            states[s][4] = shorter
        self.root = states[0]
        self.pieces = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept = _Kept(self)
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: no merge across the seam comes before those that built them."""
        joined, halves = self.joined, self.halves
        limit = len(halves)
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = halves[a][1]
                if a == limit:
                    limit = b + 1
                    b = halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = halves[b][0]
                if b + 1 == limit:
                    limit = a
                    a = halves[a][1]
                    if a == limit:
                        return True

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece, by dynamic programming over its prefixes."""
        last = [(-1, 0, 0)]
        near, whole, part, size, link = self.root
        long, end, pairs = 0, 0, self.pairs  # long: of the longest end of the prefix that occurs inside of a token
        for byte in text:
            while (to := near.get(byte)) is None:
                near, whole, part, size, link = link
                long = size
            near, whole, part, size, link = to
            long += 1
            end += 1
            for token in whole if long == size else part:
                if end > token[1]:
                    before = last[end - token[1]]
                    key = before[2] | token[0]
                    if (fits := pairs.get(key)) is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(before[0], token[0])
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("no token fits a prefix")
        ids = []
        while end:
            token, size, _ = last[end]
            ids.append(self.outer[token])
            end -= size
        return ids[::-1]

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as bytes of 32-bit numbers."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return b"".join(map(self.kept.__getitem__, self.pieces(text)))
        out: list[bytes] = []
        for part in self.around.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out.extend(map(self.kept.__getitem__, self.pieces(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _over(df: DataFrame, spec: bytes, drop: list[str], of: str, fields: str, make) -> DataFrame:
    """df without drop, with the columns that make(encoder, values of column of) gives."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tables(spec))  # of one vocabulary, some ten MB whatever the data
    left = [c for c in df.columns if c not in drop]
    width = len(left)

    def run(batches):
        import pyarrow as pa

        made = shared.value  # a worker reads a broadcast once, so its tasks share the encoder
        if "encoder" not in made:
            made["encoder"] = Bpe(made)
        bpe = made["encoder"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *make(bpe, b.column(width).to_pylist())], schema=_names(b, width, fields))

    return df.select(*left, F.col(of).alias("_lt_of")).mapInArrow(tidy(run), with_fields(df.select(*left), fields))


def _names(batch, width: int, fields: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([*[batch.schema.field(k) for k in range(width)], *[pa.field(n, kinds[k]) for n, k in (f.strip().split(" ") for f in fields.split(","))]])


def encode(df: DataFrame, spec: bytes, text: str = "text") -> DataFrame:
    """df with ids: the token ids of the column text."""
    import pyarrow as pa

    return _over(df, spec, ["ids"], text, "ids array<int>", lambda bpe, xs: [pa.array([bpe.encode(x) for x in xs], pa.list_(pa.int32()))])


def decode(df: DataFrame, spec: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the column ids."""
    import pyarrow as pa

    return _over(df, spec, [text], ids, f"{text} string", lambda bpe, xs: [pa.array([bpe.decode(x or []) for x in xs], pa.string())])


def digests(df: DataFrame, spec: bytes, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: encode, then decode, in one pass that sends no ids through the JVM."""
    import pyarrow as pa

    def make(bpe, xs):
        import hashlib

        n, a, b = [], [], []
        for x in xs:
            raw = bpe.packed(x)
            ids = memoryview(raw).cast("I").tolist()
            n.append(len(ids))
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _over(df, spec, ["n_tokens", "ids_sha256", "decoded_sha256"], text, new, make)
