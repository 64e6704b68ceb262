"""A deterministic sharded WARC writer, and a reader.

Pages are range-sorted by page_id into shards whose bounds depend on the table
alone, and whose number grows with its bytes: a table below SPREAD x SHARD_BYTES
is dealt into at most SPREAD shards of 8 MB or more, so that it is written in
parallel, a larger one into shards of SHARD_BYTES. First come ranges, with bounds
in the plan, then each range's own bounds. A page_id that fills several shards is
cut by the hashes of its payloads. Each shard is one stream of gzip members,
rolled to a new file whenever the file's compressed size is reached, so that the
number of files follows the compressed bytes; headers, record ids and digests are
made anew from the payload. Tasks write under temporary names and report their files; the
report of the attempts that succeeded is the manifest, which then renames the
files. Readers open what the manifest names, nothing else.

Files go through pyarrow's file systems (file, hdfs, s3, gs), so the folder must
be one of these.

Edge cases: a null html is an empty payload; a null url is written as a urn of
the page; a null page_id is written as empty and sorts first; among equal
payloads all rows with the smallest page_id are responses, and where no row has
an id all are; repeated rows are a record each, with an id of their own; a very
long payload is one record, held whole; an empty table gives no files and an
empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NULL_ID, place, shared_dir, skew_join, small_batches, stored

#: Payload bytes of a shard, about, in large tables; in small ones, and how many shards those have at most; and ranges of shards, at most.
SHARD_BYTES = 4 << 30
SMALL_BYTES = 8 << 20
SPREAD = 256
MOST_RANGES = 4096
#: Compressed size at which a file is closed.
ROLL_BYTES = 128 << 20
#: Pages looked at for each range or shard, about, to place its bounds.
PLAN_PAGES = 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
#: Written as the date of every record, so that equal inputs give equal files.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temporary string, shard long, file long, records long, bytes long, sha256 string"


def base32_sha1(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, payload_key: str, nth: int) -> str:
    """Of the nth record of a page with that payload."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"urn:page:{'' if page_id is None else page_id}:{payload_key}:{nth}").urn


def record(page_id, url, payload: bytes, refers_to=None, nth: int = 0) -> bytes:
    """One WARC record. A revisit has the payload's headers, not the payload."""
    from urllib.parse import quote

    at = f"urn:page:{'' if page_id is None else page_id}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base32_sha1(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_record_id(page_id, digest, nth)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {at}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to, digest, 0)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream):
    """Records of an uncompressed stream: dictionaries of the fields, the payload of responses checked against its digest."""

    def fields():
        found = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b": ")
            found[k.decode().lower()] = v.decode()
        return found

    def number(x):
        return int(x) if x else None

    while (line := stream.readline()):
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = fields()
        block = stream.read(int(head["content-length"]))
        if f"sha1:{base32_sha1(block)}" != head["warc-block-digest"] or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"damaged record {head['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
            raise ValueError(f"damaged payload {head['warc-record-id']}")
        yield {"page_id": number(head["x-page-id"]), "url": head["warc-target-uri"], "payload_bytes": length, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": number(head.get("x-refers-to-page-id")), "payload": payload if head["warc-type"] == "response" else None}


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Rolled:
    """Writes one shard's records to files that are closed at a compressed size."""

    def __init__(self, files, folder: str, shard: int, roll: int):
        self.files, self.folder, self.shard, self.roll = files, folder, shard, roll
        self.done, self.out = [], None

    def add(self, raw: bytes) -> None:
        import gzip
        import hashlib

        if self.out is None:
            self.name = f"part-{self.shard:09d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.n, self.bytes, self.sha = self.files.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.n += 1
        self.bytes += len(member)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.shard, len(self.done), self.n, self.bytes, self.sha.hexdigest()))
            self.out = None


def _batch(rows, schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _write(batches, folder: str, roll: int):
    """Rows (shard, page_id, kind, url, html, refers_to) in order; one of kind 0 has the key of a payload that its page's later rows revisit."""
    import hashlib

    files, at = _files(folder)
    out, done, now, known, met = None, [], None, {}, {}
    for b in batches:
        for shard, page, kind, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
            if page != now:
                now, known, met = page, {}, {}
            if kind == 0:
                known[url] = refers
                continue
            if out is None or out.shard != shard:
                if out:
                    out.close()
                    done += out.done
                out = _Rolled(files, at, shard, roll)
            payload = (html or "").encode("utf-8", "surrogatepass")
            key = f"{hashlib.sha1(payload).hexdigest()}-{len(payload)}"
            met[key] = nth = met.get(key, -1) + 1
            out.add(record(page, url, payload, known.get(key), nth))
    if out:
        out.close()
        done += out.done
    yield _batch(done, MANIFEST)


def _rename(batches, folder: str):
    from pyarrow import fs

    files, at = _files(folder)
    for b in batches:
        for name, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if files.get_file_info(f"{at}/{temporary}").type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                files.move(f"{at}/{temporary}", f"{at}/{name}")
        yield b


def _payload_key(html):
    html = F.coalesce(html, F.lit(""))
    return F.concat_ws("-", F.sha1(html), F.octet_length(html))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, payload key and refers_to of the pages whose payload another page with a smaller id has."""
    rows = pages.filter(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least).select(F.col("page_id").cast("long").alias("page_id"), _payload_key(F.col("html")).alias("_lt_key"))
    rows = stored(rows, "payloads")
    shared = rows.groupBy("_lt_key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_lt_rows")).filter("_lt_rows > 1")
    found = skew_join(rows, stored(shared, "shared"), "_lt_key", "_lt_rows", F.monotonically_increasing_id(), "inner")
    return found.filter("page_id is not null and page_id <> refers_to").select("page_id", F.col("_lt_key").alias("url"), "refers_to").distinct()


def _bounded(rows: DataFrame, points: DataFrame, pages: int, shards: int) -> tuple[DataFrame, int]:
    """rows with shard, from their point and those of all pages (_lt_point: page_id, hash of payload); and the number of shards.

    The bounds of ranges are quantiles of a sample of points by hash, taken to
    the driver; those of a range's shards are quantiles of a larger sample, found
    where the range's sample meets, and broadcast: 16 bytes for each shard.
    """
    ranges = min(MOST_RANGES, shards)
    within = -(-shards // ranges)

    def sample(wanted: int) -> DataFrame:
        every = max(1, pages // (PLAN_PAGES * wanted))
        return points.filter(F.pmod(F.xxhash64("_lt_point"), F.lit(every)) == 0).distinct()

    met = [tuple(r[0]) for r in sample(ranges).orderBy("_lt_point").collect()]
    bounds = sorted({met[len(met) * k // ranges] for k in range(1, ranges)}) if met else []
    literal = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(h).cast("long").alias("h")) for v, h in bounds])
    place_ = lambda df: df.withColumn("_lt_range", place(F.col("_lt_point"), literal, len(bounds)) if bounds else F.lit(0).cast("long"))
    rows = place_(rows)
    if within == 1:
        return rows.withColumnRenamed("_lt_range", "shard"), len(bounds) + 1
    own = place_(sample(shards)).groupBy("_lt_range").agg(F.sort_array(F.collect_set("_lt_point")).alias("_lt_all"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(within - 1)), lambda k: F.get("_lt_all", F.floor(F.size("_lt_all") * k / within).cast("int")))
    own = own.select("_lt_range", cuts.alias("_lt_cuts"))
    rows = rows.join(F.broadcast(own), "_lt_range", "left")
    inside = F.coalesce(place(F.col("_lt_point"), F.col("_lt_cuts"), within - 1), F.lit(0))
    return rows.withColumn("shard", F.col("_lt_range") * within + inside).drop("_lt_range", "_lt_cuts"), (len(bounds) + 1) * within


def n_shards(payload_bytes: int, rows: int, shard_bytes: int = SHARD_BYTES, small_bytes: int = SMALL_BYTES, spread: int = SPREAD) -> int:
    """Shards of a table: one for each shard_bytes, and up to spread of small_bytes; never more than rows."""
    return max(1, min(rows, max(-(-payload_bytes // shard_bytes), min(spread, -(-payload_bytes // small_bytes)))))


def write(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_BYTES) -> tuple[str, DataFrame]:
    """Writes pages (page_id, url, html) as WARC files to a new or empty folder; its name and the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    seen = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    shards = n_shards(seen.b or 0, seen.n, shard_bytes)
    page = F.col("page_id").cast("long")
    point = lambda key: F.struct(F.coalesce(page, F.lit(NULL_ID)).alias("v"), F.xxhash64(key).alias("h"))
    whole = pages.select(page.alias("page_id"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"), point(_payload_key(F.col("html"))).alias("_lt_point"))
    marks = revisits(pages, least).select("page_id", F.lit(0).alias("kind"), "url", F.lit(None).cast("string").alias("html"), "refers_to", point(F.col("url")).alias("_lt_point"))
    dealt, n = _bounded(whole.unionByName(marks), whole.select("_lt_point"), seen.n, shards)
    dealt = dealt.repartitionByRange(min(n, 100_000), "shard").sortWithinPartitions("shard", "_lt_point", "kind", F.xxhash64("html", "url"))
    files, at = _files(folder)
    files.create_dir(at, recursive=True)
    written = stored(dealt.select("shard", "page_id", "kind", "url", "html", "refers_to").mapInArrow(lambda it: _write(it, folder, roll_bytes), MANIFEST), "warc-written")
    manifest = stored(written.repartition(max(1, min(n, 10_000)), "name").mapInArrow(lambda it: _rename(it, folder), MANIFEST), "warc-named")
    manifest.orderBy("name").write.parquet(f"{folder}/_manifest")
    return folder, spark.read.parquet(f"{folder}/_manifest")


def read(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files that the manifest names; page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        import gzip

        files, at = _files(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for r in parse(stream):
                        rows.append((*list(r.values())[:6], r["payload"] if payloads else None))
                        if len(rows) == 500:
                            yield _batch(rows, schema)
                            rows = []
                yield _batch(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("name").repartition(min(n, 10_000), "name").mapInArrow(run, schema)
