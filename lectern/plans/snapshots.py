"""Immutable corpora: built in an attempt's folder, named by their content, published by a rename, found by a catalog.

Everything is files of one root folder of any Hadoop file system:

    attempts/<id>/state.json          building, accepted or rejected
    corpora/<digest>/...              tables, manifest.json, retrieval.json
    accepted/<number>.json            commits, numbered, each written once
    active.json                       the active pair, replaced by a rename

A digest covers logical rows, sorted, not files, as Parquet files also hold
what wrote them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import ConfigUnavailableError, CorpusUnavailableError, EvidenceError, VersionUnavailableError
from lectern.operators import digests, graph, ingest, search, validate
from lectern.shared import state

SCHEMA_VERSION = 2
TABLES = ("units", "notes", "edges", "adjacency", "tokens", "blocks", "stats")
#: What a baseline configuration says; fixed values of the contract.
BASELINE = {"lanes": ["lexical", "official"], "lexical": {"algorithm": "fts5-bm25", "candidate_pool_size": 100}, "context": {"before": 3, "after": 3}, "official": {"depth": 1}, "ranking": ["lane_priority", "raw_score", "canonical_order"]}
FAULTS = ("after_commit", "after_checkpoint", "after_close", "after_reconcile", "after_file_fsync", "after_rename", "after_registration")


class BuildFault(RuntimeError):
    """Raised on purpose at a stage of a build, for tests."""


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Store:
    """Small files and folders of a Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm, self._gateway = root.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self._configuration = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self._configuration)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        """Writes a file, readable by its owner only, under a temporary name and gives it its own; without overwrite only one of several writers succeeds, the others get FileExistsError."""
        target, temporary = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, False)
        try:
            self.fs.setPermission(temporary, self._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        try:
            self._named(temporary, target, overwrite)
        finally:
            self.fs.delete(temporary, False)

    def _named(self, temporary, target, overwrite: bool) -> None:
        """Gives a file its name in one step: a link on a local file system, whose rename replaces, elsewhere a rename that fails where the name is taken."""
        local = self.fs.makeQualified(target).toUri()
        if local.getScheme() == "file" and not overwrite:
            os.link(self.fs.makeQualified(temporary).toUri().getPath(), local.getPath())
            return
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._configuration).rename(temporary, target, options)
        except Exception as e:
            if not overwrite and self.fs.exists(target):
                raise FileExistsError(target.toString()) from e
            raise

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} could not be renamed")

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []


@dataclass(frozen=True)
class Corpus:
    """Normalized tables: units (reference, book, canonical_order, text, content_hash, source_spans), notes, edges."""

    units: DataFrame
    notes: DataFrame
    edges: DataFrame
    source_format: str = "table"
    source_profile: str = "table-v1"


def row_nodes(df: DataFrame, key: str) -> DataFrame:
    """The nodes of a table's digest tree, rows placed by their key's hash among about as many as there are."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return digests.table(digests.tree(df, digests.place(F.col(key), df.count()), line))


def top(nodes: DataFrame) -> str:
    """The root's digest, from the nodes of a tree."""
    row = digests.root(nodes.where(F.col("level") == digests.LEVELS - 1)).first()
    return sha256(canonical([row.n, row.digest]))


def rows_digest(df: DataFrame, key: str) -> str:
    """A digest of a table's rows."""
    return top(row_nodes(df, key))


#: Tables whose rows a corpus's digest covers, and their keys.
DIGESTED = {"units": "reference", "notes": "note_id", "edges": "edge_id"}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.root = spark, Store(spark, root), root.rstrip("/")
        self._hashed: dict[tuple, dict[str, str]] = {}

    def accepted(self) -> list[dict]:
        """What was accepted, in the order of commits."""
        return [json.loads(self.store.read(f"accepted/{n}")) for n in self._commits()]

    def _commits(self) -> list[str]:
        return [n for n in self.store.names("accepted") if re.fullmatch("[0-9]{12}[.]json", n)]

    def _built(self, key: str) -> dict | None:
        return next((a for a in self.accepted() if a["build_key"] == key), None)

    def register(self, record: dict, before_commit=lambda: None) -> dict:
        """Commits a record under the next number, or returns the one that was there for its build key.

        Commits are files that only one writer can create. Who finds its number
        taken reads what others committed in the meantime and tries the next.
        """
        self.store.make("accepted")
        while True:
            if (there := self._built(record["build_key"])) is not None:
                return there
            number = int(([*self._commits()] or ["0"])[-1].partition(".")[0]) + 1
            before_commit()
            try:
                self.store.create(f"accepted/{number:012d}.json", canonical(record))
                return record
            except FileExistsError:
                continue

    def latest(self) -> dict | None:
        return (self.accepted() or [None])[-1]

    def attempts(self) -> list[dict]:
        return [json.loads(self.store.read(f"attempts/{n}/state.json")) for n in self.store.names("attempts")]

    def active(self) -> dict | None:
        text = self.store.read("active.json")
        return json.loads(text) if text else None

    def activate(self, corpus_version: str, retrieval_config: str) -> None:
        found = next((a for a in self.accepted() if (a["corpus_version"], a["retrieval_config"]) == (corpus_version, retrieval_config)), None)
        if found is None:
            raise ValueError("only an accepted corpus with its own configuration can be active")
        self.verify(found["artifact_digest"])
        self.store.create("active.json", canonical({"corpus_version": corpus_version, "retrieval_config": retrieval_config}), overwrite=True)

    def verify(self, digest: str) -> dict:
        """The manifest of a published corpus, whose rows are hashed again."""
        text, config = self.store.read(f"corpora/{digest}/manifest.json"), self.store.read(f"corpora/{digest}/retrieval.json")
        if text is None or config is None:
            raise CorpusUnavailableError("the corpus is incomplete")
        manifest = json.loads(text)
        core = {k: v for k, v in manifest.items() if k not in ("artifact_digest", "corpus_version")}
        if self._digests(f"corpora/{digest}") != manifest["rows"] or sha256(canonical(core) + config) != digest:
            raise CorpusUnavailableError(f"the corpus differs from its digest{self._places(digest)}")
        return manifest

    def _files(self, folder: str) -> tuple:
        """Names, sizes and times of the files that a corpus's digest covers, without the folder's own name, which a rename changes."""
        base = self.store._path(folder).toUri().getPath()
        return tuple((name.partition(base)[2], size, time_) for t in DIGESTED for name, size, time_ in state(self.spark, f"{self.root}/{folder}/{t}"))

    def _digests(self, folder: str) -> dict[str, str]:
        """Digests of a written corpus's tables; files that this process has hashed, and that are as they were, aren't hashed again."""
        files = self._files(folder)
        if files not in self._hashed:
            self._hashed[files] = {t: rows_digest(self.spark.read.parquet(f"{self.root}/{folder}/{t}"), key) for t, key in DIGESTED.items()}
        return self._hashed[files]

    def _places(self, digest: str) -> str:
        """Where a corpus differs from the nodes that were written with it: tables and numbers of leaves."""
        at = f"{self.root}/corpora/{digest}"
        if not self.store.exists(f"corpora/{digest}/digests"):
            return ""
        nodes = self.spark.read.parquet(f"{at}/digests")
        found = {t: [r.nth for r in digests.differing(nodes.where(F.col("table") == t), row_nodes(self.spark.read.parquet(f"{at}/{t}"), key)).orderBy("nth").limit(5).collect()] for t, key in DIGESTED.items()}
        return "".join(f"; {t}: leaves {n}" for t, n in found.items() if n)

    def build(self, corpus: Corpus, approval: dict, recipe: str, expected: DataFrame, importer: str = "0.1.0", fault: str | None = None) -> dict:
        """Validates, writes and publishes a corpus; building the same again returns what is there."""

        def reached(stage):
            if fault == stage:
                raise BuildFault(stage)

        findings = validate.validate_corpus(corpus.units, corpus.notes, corpus.edges, expected).limit(20).collect()
        if findings:
            raise ValueError(f"the corpus has findings: {[tuple(f) for f in findings]}")
        normalized = rows_digest(corpus.units, "reference")
        key = sha256(canonical({"approval": approval, "recipe_fingerprint": recipe, "normalized_digest": normalized, "schema_version": SCHEMA_VERSION, "importer_version": importer}))
        if (there := self._built(key)) is not None:
            self.verify(there["artifact_digest"])
            return there
        attempt = uuid.uuid4().hex
        state = {"attempt_id": attempt, "build_key": key, "state": "building"}
        self.store.make(f"attempts/{attempt}")
        self.store.create(f"attempts/{attempt}/state.json", canonical(state))
        try:
            self._write(corpus, f"{self.root}/attempts/{attempt}/corpus")
            for stage in FAULTS[:3]:
                reached(stage)
            rows = self._reconciled(corpus, f"attempts/{attempt}/corpus", normalized)
            reached("after_reconcile")
            config = canonical({**BASELINE, "normalized_digest": normalized})
            core = {"schema_version": SCHEMA_VERSION, "source_approval": approval, "source_profile": corpus.source_profile, "source_format": corpus.source_format, "recipe_fingerprint": recipe, "normalized_digest": normalized, "rows": rows, "retrieval_config": f"baseline-{sha256(config)[:24]}", "importer_version": importer}
            digest = sha256(canonical(core) + config)
            manifest = {"artifact_digest": digest, "corpus_version": f"corpus-{digest[:24]}", **core}
            self.store.create(f"attempts/{attempt}/corpus/manifest.json", canonical(manifest))
            self.store.create(f"attempts/{attempt}/corpus/retrieval.json", config)
            reached("after_file_fsync")
            self.store.make("corpora")
            if self.store.exists(f"corpora/{digest}"):
                self.store.delete(f"attempts/{attempt}/corpus")
            else:
                self.store.rename(f"attempts/{attempt}/corpus", f"corpora/{digest}")
            reached("after_rename")
            self.verify(digest)
            record = {"corpus_version": manifest["corpus_version"], "retrieval_config": core["retrieval_config"], "artifact_digest": digest, "normalized_digest": normalized, "build_key": key, "manifest": manifest, "config": json.loads(config), "accepted_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())}
            reached("after_registration")
            record = self.register(record)
            self.store.create(f"attempts/{attempt}/state.json", canonical({**state, "state": "accepted", "corpus_version": record["corpus_version"]}), overwrite=True)
            return record
        except BaseException as e:
            code = "injected_fault" if isinstance(e, BuildFault) else "build_failed"
            self.store.create(f"attempts/{attempt}/state.json", canonical({**state, "state": "rejected", "error_code": code}), overwrite=True)
            raise

    def _write(self, corpus: Corpus, folder: str) -> None:
        """Tables sorted by what lookups filter on, so that Parquet's statistics skip most of them."""
        put = lambda df, name, *order: (df.sortWithinPartitions(*order) if order else df).write.parquet(f"{folder}/{name}")
        put(corpus.units.repartitionByRange("canonical_order"), "units", "canonical_order")
        put(corpus.notes, "notes", "note_id")
        put(corpus.edges, "edges", "edge_id")
        units = self.spark.read.parquet(f"{folder}/units")
        put(graph.adjacency(graph.ordered_edges(self.spark.read.parquet(f"{folder}/edges"), units)), "adjacency", "src")
        put(search.tokenized(units), "tokens")
        tokens = self.spark.read.parquet(f"{folder}/tokens")
        put(search.statistics(tokens), "stats")
        put(search.blocks(tokens, self.spark.read.parquet(f"{folder}/stats")).repartitionByRange("term", "block"), "blocks", "term", "block")

    def _reconciled(self, corpus: Corpus, folder: str, normalized: str) -> dict[str, str]:
        """Digests of what was written, which must be those of what was meant; the index must cover all units. The trees are kept beside the tables."""
        at = f"{self.root}/{folder}"
        for t, key in DIGESTED.items():
            row_nodes(self.spark.read.parquet(f"{at}/{t}"), key).withColumn("table", F.lit(t)).write.mode("append").parquet(f"{at}/digests")
        nodes = self.spark.read.parquet(f"{at}/digests")
        rows = self._hashed[self._files(folder)] = {t: top(nodes.where(F.col("table") == t)) for t in DIGESTED}
        wanted = {"units": normalized, "notes": rows_digest(corpus.notes, "note_id"), "edges": rows_digest(corpus.edges, "edge_id")}
        docs = self.spark.read.parquet(f"{at}/tokens").select(F.col("doc").alias("canonical_order"))
        units = self.spark.read.parquet(f"{at}/units").select("canonical_order")
        if rows != wanted or not validate.reconcile(docs, units).isEmpty():
            raise ValueError("what was written differs from the corpus")
        return rows

    def pin(self, corpus_version: str | None = None, retrieval_config: str | None = None) -> Snapshot:
        if corpus_version is None:
            active = self.active()
            if active is None:
                raise CorpusUnavailableError("no usable corpus is active")
            corpus_version, retrieval_config = active["corpus_version"], active["retrieval_config"]
        found = next((a for a in self.accepted() if a["corpus_version"] == corpus_version), None)
        if found is None:
            raise VersionUnavailableError(corpus_version)
        if found["retrieval_config"] != retrieval_config:
            raise ConfigUnavailableError("the corpus has another configuration")
        return Snapshot(self.spark, f"{self.root}/corpora/{found['artifact_digest']}", found)


@dataclass
class Snapshot:
    """A pinned corpus: tables bound to one immutable folder."""

    spark: SparkSession
    folder: str
    record: dict

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise EvidenceError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def normalized(extracted: DataFrame, notes: DataFrame, raw_edges: DataFrame, expected: DataFrame, valid: DataFrame) -> Corpus:
    """A corpus from extracted rows: places in the structure, hashes, and an edge for each member of each list of targets."""
    units = ingest.with_hash(ingest.canonical_order(extracted, expected))
    units = units.withColumn("book", F.split("reference", "/")[1])
    checked = ingest.grammar_strict(raw_edges, "target", valid)
    members = ingest.edge_expand(checked.where("state is not null").withColumn("target", F.col("normalized_text")))
    edges = ingest.edge_ids(ingest.targets(members.drop("target")))
    return Corpus(units, notes, edges.select("edge_id", "origin_reference", "origin_anchor", "target", "source_attribution", "grammar_version", "source_spans"))
