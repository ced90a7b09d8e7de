"""Stores on a file system: JSON-lines collections with a manifest, graph tables, logs, whole files and backups."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodequery.functions.similarity import is_valid_vector
from lodequery.operators.chunking import CHUNK, OVERLAP, chunk_documents, records_of_chunks
from lodequery.operators.embedding import with_embedding
from lodequery.operators.versions import current_version
from lodequery.storage import remove, written

VERSION = "1.0.0"
_ID = re.compile(r"[a-zA-Z0-9_-]{1,64}")
RECORD = "id string, collection_id string, vector array<double>, text string, content_ref string, metadata string, created_at string, updated_at string, seq bigint"
LOG = "event_id string, session_id string, agent_id string, timestamp string, event_type string, stage string, action string, target string, result string, error string, metadata string, prev_hash string, hash string, sequence_number bigint"


_NAMES = [c.split(" ")[0] for c in RECORD.split(", ")]


class CorruptedStore(ValueError):
    """What is stored can't be read as what it should be."""


class IncompatibleStore(ValueError):
    """What is stored has a version that this code doesn't read."""


def collection_id(name: str) -> str:
    """A collection's id, trimmed; letters, digits, "_" and "-" only, so it can't leave its folder."""
    name = name.strip()
    if not _ID.fullmatch(name):
        raise ValueError(f"not a collection id: {name!r}")
    return name


def is_collection_id(name: Column) -> Column:
    """The same for a column of names."""
    return F.coalesce(F.trim(name).rlike(f"^{_ID.pattern}$"), F.lit(False))


def slug(name: str) -> str:
    """An id made of a collection's name."""
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9_-]+", "-", name.strip().lower()))


def _read_text(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:  # the file system's checksum doesn't fit, among others
        raise CorruptedStore(f"{path} can't be read") from e


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside its place and then moved there in one step."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    final, part = hadoop.Path(path), hadoop.Path(path + ".part")
    out = final.getFileSystem(conf).create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else final.getFileSystem(conf).getUri(), conf).rename(part, final, how)


class TableStore(Protocol):
    """Where a collection's records are kept: what a :class:`CollectionStore` asks of a storage."""

    def read(self) -> DataFrame | None: ...

    def put(self, df: DataFrame) -> None: ...

    def drop(self) -> None: ...


class _Versions:
    """Tables kept as folders of one version each and a small file that names the current one. A new version is whole
    before the name changes, so a reader sees the old one or the new one and a crash loses neither; the version before is
    kept for those who still read it, older ones are deleted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _names(self) -> list[str]:
        text = _read_text(self.spark, f"{self.path}/current")
        return text.split() if text else []

    def current(self) -> str | None:
        names = self._names()
        return f"{self.path}/{names[0]}" if names else None

    def read(self) -> DataFrame | None:
        path = self.current()
        return self.spark.read.parquet(path) if path else None

    def drop(self) -> None:
        _delete(self.spark, self.path)

    def put(self, df: DataFrame) -> None:
        names = self._names()
        new = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{new}")
        _write_text(self.spark, f"{self.path}/current", " ".join([new, *names[:1]]))
        for old in names[1:]:
            _delete(self.spark, f"{self.path}/{old}")


class CollectionStore:
    """Collections of records below a folder: ``manifest.json``, and ``records/collection_id=.../``, where each change is a
    new version (:class:`_Versions`). ``table(spark, path)``: another storage for the records."""

    def __init__(self, spark: SparkSession, base: str, table: Callable[[SparkSession, str], TableStore] = _Versions):
        self.spark, self.base, self.table = spark, base.rstrip("/"), table

    def manifest(self) -> dict | None:
        text = _read_text(self.spark, f"{self.base}/manifest.json")
        if text is None:
            return None
        try:
            found = json.loads(text)
            version = str(found["version"])
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptedStore(f"{self.base}/manifest.json: {e}") from e
        if version.split(".")[0] != VERSION.split(".")[0]:
            raise IncompatibleStore(f"version {version}, not {VERSION}")
        return found

    def _save(self, manifest: dict) -> None:
        _write_text(self.spark, f"{self.base}/manifest.json", json.dumps(manifest | {"version": VERSION, "updated_at": datetime.now(timezone.utc).isoformat()}))

    def create(self, name: str, dimension: int, metric: str = "cosine", metadata_schema: dict | None = None) -> str:
        if not name.strip() or dimension <= 0:
            raise ValueError("a collection has a name and a dimension above 0")
        cid = collection_id(slug(name))
        held = self.manifest() or {"created_at": datetime.now(timezone.utc).isoformat(), "collections": []}
        if any(c["collection_id"] == cid for c in held["collections"]):
            raise ValueError(f"collection {cid} exists")
        held["collections"].append({"collection_id": cid, "name": name.strip(), "dimension": dimension, "metric": metric, "metadata_schema": metadata_schema})
        self._save(held)
        return cid

    def collections(self) -> list[dict]:
        return (self.manifest() or {"collections": []})["collections"]

    def drop(self, cid: str) -> bool:
        cid = collection_id(cid)
        held = self.manifest()
        kept = [c for c in self.collections() if c["collection_id"] != cid]
        if held is None or len(kept) == len(held["collections"]):
            return False
        self._save(held | {"collections": kept})
        self._table(cid).drop()
        return True

    def with_counts(self) -> list[dict]:
        """Collections with the number of their live records, counted now."""
        return [c | {"record_count": self.records(c["collection_id"]).count()} for c in self.collections()]

    def _info(self, cid: str) -> dict:
        info = next((c for c in self.collections() if c["collection_id"] == collection_id(cid)), None)
        if info is None:
            raise KeyError(cid)
        return info

    def _table(self, cid: str) -> TableStore:
        return self.table(self.spark, f"{self.base}/records/collection_id={collection_id(cid)}")

    def records(self, cid: str) -> DataFrame:
        stored = self._table(cid).read()
        if stored is None:
            return self.spark.createDataFrame([], RECORD)
        return stored.withColumn("collection_id", F.lit(cid)).select(*_NAMES)

    def upsert(self, cid: str, new: DataFrame, embed: Callable[[DataFrame, int], DataFrame] = with_embedding) -> None:
        """Records with the new ones in place of those of equal ids; of several new ones of an id the last by seq counts.

        Texts without a vector get one by ``embed(records, dimension)``. All are checked before anything is written: each
        needs an id and a vector of the collection's dimension.
        """
        info = self._info(cid)
        for c, t in (x.split(" ", 1) for x in RECORD.split(", ")):
            if c not in new.columns:
                new = new.withColumn(c, F.lit(None).cast(t))
        new = written(embed(new.withColumn("collection_id", F.lit(cid)).select(*_NAMES), info["dimension"]), "upsert")
        bad = new.where(F.col("id").isNull() | ~is_valid_vector(F.col("vector"), info["dimension"])).select("id").limit(1).collect()
        if bad:
            remove(new)
            raise ValueError(f"record {bad[0][0]!r} has no id or no vector of {info['dimension']} finite numbers")
        latest = current_version(new, "id", ("seq",))
        kept = self.records(cid).join(latest.select("id"), "id", "left_anti")
        self._table(cid).put(latest.unionByName(kept).drop("collection_id"))
        remove(new)

    def update(self, cid: str, changes: DataFrame, embed: Callable[[DataFrame, int], DataFrame] = with_embedding) -> int:
        """Stored records with what ``changes`` (``id`` and any columns of a record) says of them, nulls meaning no change;
        a new text without a new vector is embedded again. Returns how many records changed; ids that aren't stored
        change nothing."""
        info = self._info(cid)
        for c, t in (x.split(" ", 1) for x in RECORD.split(", ")):
            if c not in changes.columns:
                changes = changes.withColumn(c, F.lit(None).cast(t))
        last = current_version(changes.where("id is not null").select(*_NAMES), "id", ("seq",))
        stored = self.records(cid)
        other = [c for c in _NAMES if c not in ("id", "collection_id", "vector", "seq")]
        both = stored.alias("o").join(last.alias("n"), "id")
        text = F.col("n.text").isNotNull() & ~F.col("n.text").eqNullSafe(F.col("o.text"))
        vector = F.when(F.col("n.vector").isNotNull(), F.col("n.vector")).when(text, F.lit(None)).otherwise(F.col("o.vector"))
        made = both.select("id", F.col("o.seq").alias("seq"), vector.alias("vector"), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in other])
        changed = made.count()
        if changed:
            self.upsert(cid, made, embed)
        return changed

    def delete(self, cid: str, ids: DataFrame) -> int:
        """Without the records of ``ids (id)``; returns how many there were."""
        gone = ids.select("id").distinct()
        stored = self.records(cid)
        n = stored.join(gone, "id", "left_semi").count()
        if n:
            self._table(cid).put(stored.join(gone, "id", "left_anti").drop("collection_id"))
        return n

    def ingest(self, cid: str, documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, source: str = "inline_text", embed: Callable[[DataFrame, int], DataFrame] = with_embedding) -> None:
        """The chunks of ``document_id, text`` as records of a collection."""
        self.upsert(cid, records_of_chunks(chunk_documents(documents, size, overlap), cid, source).withColumn("seq", F.xxhash64("id")), embed)


def read_records_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines file; a line that isn't a record with an id and a vector fails the read, and is named."""
    rows = spark.read.schema(RECORD + ", _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=False)
    broken = F.col("_bad").isNotNull() | F.col("id").isNull() | F.col("vector").isNull()
    good = F.when(broken, F.raise_error(F.concat(F.lit("not a record: "), F.coalesce("_bad", F.to_json(F.struct("id", "text")))))).otherwise(F.col("id")).cast("string")
    return rows.withColumn("id", good).drop("_bad")


def write_records_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("collection_id").option("partitionOverwriteMode", "dynamic").json(path)


def read_log_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Entries of an audit log, and the number of lines that can't be read. The file is read once: the entries are written
    to the shared folder, and the bad lines counted meanwhile."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", LOG + ", _bad string", how).alias("r")).select("r.*")
    bad = F.col("_bad").isNotNull() | F.col("event_id").isNull()
    seen = Observation()
    entries = written(rows.observe(seen, F.count_if(bad).alias("bad")).where(~bad).drop("_bad"), "log")
    return entries, seen.get["bad"]


def expire_log(log: DataFrame, now: datetime, max_age_days: int) -> tuple[DataFrame, DataFrame]:
    """Entries to keep and entries to archive, by age; an anchor row isn't needed, for each entry keeps its prev_hash."""
    old = F.col("ts") < F.lit(now) - F.expr(f"interval {int(max_age_days)} days")
    return log.where(~old), log.where(old)


def save_tables(spark: SparkSession, base: str, names: tuple[str, ...], tables: dict[str, DataFrame]) -> None:
    """Tables as a new folder of the store, which the manifest names once all are written; the folder before stays for its readers."""
    text = _read_text(spark, f"{base}/manifest.json")
    before = json.loads(text) if text else {}
    folder = f"v-{uuid.uuid4().hex}"
    for name in names:
        if name in tables:
            tables[name].write.parquet(f"{base}/{folder}/{name}")
    _write_text(spark, f"{base}/manifest.json", json.dumps({"version": VERSION, "folder": folder, "before": before.get("folder")}))
    if before.get("before"):
        _delete(spark, f"{base}/{before['before']}")


def load_tables(spark: SparkSession, base: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """What :func:`save_tables` has saved last; nothing without a manifest. The version must be this one exactly."""
    text = _read_text(spark, f"{base}/manifest.json")
    if text is None:
        return {}
    try:
        manifest = json.loads(text)
        version, folder = manifest["version"], manifest["folder"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptedStore(f"{base}/manifest.json: {e}") from e
    if version != VERSION:
        raise IncompatibleStore(f"version {version}, not {VERSION}")
    return {n: spark.read.parquet(f"{base}/{folder}/{n}") for n in names if _exists(spark, f"{base}/{folder}/{n}")}


GRAPH_TABLES = ("entities", "relationships", "evidence", "mentions")
NETWORK_TABLES = ("peers", "capabilities", "reputation", "blocked")


def save_graph(spark: SparkSession, base: str, **tables: DataFrame) -> None:
    save_tables(spark, base, GRAPH_TABLES, tables)


def load_graph(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return load_tables(spark, base, GRAPH_TABLES)


def save_network(spark: SparkSession, base: str, **tables: DataFrame) -> None:
    save_tables(spark, base, NETWORK_TABLES, tables)


def load_network(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return load_tables(spark, base, NETWORK_TABLES)


SESSION = "id string, agent_id string, task string, status string, history array<struct<status:string,at:string,reason:string>>"


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions as JSON lines, in the place of those stored."""
    names = [c.split(" ")[0] for c in SESSION.split(", ")]
    _Versions(sessions.sparkSession, path).put(sessions.select(F.to_json(F.struct(*[F.col(c) for c in names if c in sessions.columns])).alias("value")))


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Stored sessions; none where nothing is stored or what is stored can't be read."""
    try:
        at = _Versions(spark, path).current()
        rows = spark.read.parquet(at) if at else spark.createDataFrame([], "value string")
    except Exception:  # noqa: BLE001 - by contract a store that can't be read is an empty one
        rows = spark.createDataFrame([], "value string")
    return rows.select(F.from_json("value", SESSION).alias("s")).select("s.*").where("id is not null")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, source, text``: each file as a document named by its base name."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    return files.select(F.regexp_extract("source", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("document_id"), "source", "text")


def file_digests(spark: SparkSession, base: str, content: bool = False) -> DataFrame:
    """``path, size, sha256`` of every file below a folder, and its ``content`` if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = "^(?:file:)?/*" + re.escape(re.sub(r"^file:/*|^/*", "", base.rstrip("/"))) + "/"
    return files.select(F.regexp_replace("path", prefix, "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else []))


def backup_digest(digests: DataFrame) -> DataFrame:
    """One row: files, bytes and the hash of all files' names and hashes in order of name, "path:sha256" lines joined by
    line feeds. The lines stream through one task in order; none holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, files, size = hashlib.sha256(), 0, 0
        for b in batches:
            for path, n, digest in zip(*(b.column(c).to_pylist() for c in ("path", "size", "sha256"))):
                whole.update((("\n" if files else "") + f"{path}:{digest}").encode())
                files, size = files + 1, size + (n or 0)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64()), pa.array([size], pa.int64()), pa.array([whole.hexdigest()])], ["files", "bytes", "sha256"])

    rows = digests.select("path", F.col("size").cast("bigint").alias("size"), "sha256").repartition(1).sortWithinPartitions("path")
    return rows.mapInArrow(run, "files bigint, bytes bigint, sha256 string")


def create_backup(spark: SparkSession, base: str, target: str) -> dict:
    """Every file below a folder, with its content and hash, as the table ``target/files``, and a manifest with the hash of all."""
    files = file_digests(spark, base, content=True)
    files.write.parquet(f"{target}/files")
    total = backup_digest(spark.read.parquet(f"{target}/files")).first().asDict()
    _write_text(spark, f"{target}/manifest.json", json.dumps({"version": VERSION, **total}))
    return total


def check_backup(spark: SparkSession, target: str) -> DataFrame:
    """``path, problem`` of a backup: files whose content isn't what their hash says, and, under the path "", a hash of all
    that isn't the manifest's."""
    stored = spark.read.parquet(f"{target}/files")
    manifest = json.loads(_read_text(spark, f"{target}/manifest.json") or "{}")
    wrong = stored.where(F.sha2("content", 256) != F.col("sha256")).select("path", F.lit("changed").alias("problem"))
    whole = backup_digest(stored).where(F.col("sha256") != F.lit(manifest.get("sha256"))).select(F.lit("").alias("path"), F.lit("incomplete").alias("problem"))
    return wrong.unionByName(whole)


def restore_backup(spark: SparkSession, target: str, base: str, overwrite: bool = False) -> DataFrame:
    """``path, state``: a sound backup's files written below a folder that all executors see: restored, skipped (there
    already) or refused (a path that leaves the folder). An unsound backup is not restored."""
    if not check_backup(spark, target).isEmpty():
        raise CorruptedStore(f"{target} is not what was backed up")
    folder = re.sub(r"^file:/*", "/", base).rstrip("/")
    stored = spark.read.parquet(f"{target}/files").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                at = Path(folder, path)
                if at.exists() and not overwrite:
                    states.append("skipped")
                    continue
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(at.name + ".part")
                part.write_bytes(content)
                part.replace(at)
                states.append("restored")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(states, pa.string())], ["path", "state"])

    done = safe_paths(stored).mapInArrow(run, "path string, state string")
    refused = stored.select("path").join(safe_paths(stored).select("path"), "path", "left_anti").select("path", F.lit("refused").alias("state"))
    return written(done.unionByName(refused), "restored")


def verify_backup(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``path, problem``: files that are missing, changed or not in the manifest."""
    both = stored.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def safe_paths(paths: DataFrame) -> DataFrame:
    """Paths that stay below the folder they are restored to."""
    return paths.where(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\"))
