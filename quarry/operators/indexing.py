"""The stored index: files become documents, chunks and postings, written by segments under a pointer for each revision.

A run compares the listing with what is stored, and reads what differs. An unchanged file keeps its rows; one that can't be read keeps its last good
chunks and is marked stale; any other is replaced whole. Documents of sources that were listed and no longer have their
file are marked deleted, those of sources that could not be listed stay. One writer at a time, by lease.

Cases: a null or empty file has no text and is an issue. An index without a revision reads as empty tables.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import posixpath
import re
import threading
import time
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import text as T
from quarry.functions.chunking import chunks as cut
from quarry.functions.dates import resolve
from quarry.operators.candidates import canonical_ids, leaders
from quarry.operators import serving
from quarry.operators.maintenance import mark_missing
from quarry.session import read_small, scratch, ship, stored, write_small
from quarry.sources.files import discover_all, literal_path
from quarry.sources.formats import BY_CONTENT, Unreadable, read

#: Beside a chunk's text its folded form and heading, and what is indexed of its document's title and path and of its heading:
#: those of the first chunk, and of the first that has the heading.
FOLDED = "heading:string,folded:string,index_title:string,index_path:string,index_heading:string"
CHUNK = f"struct<chunk_id:string,ordinal:long,section:string,headings:array<string>,locator:string,text:string,content_hash:string,{FOLDED}>"
DOCUMENT = (
    "doc_id string, source_id string, source_kind string, path string, relative_path string, extension string, title string, size long, modified timestamp, "
    "effective_date timestamp, date_source string, content_hash string, needs_ocr boolean, warnings array<string>, chunk_count long"
)
#: A file's outcome: unchanged, issue (with code and message) or draft (with chunks).
RESULT = f"{DOCUMENT}, outcome string, code string, message string, chunks array<{CHUNK}>"
DOCUMENTS = f"{DOCUMENT}, family_key string, family_confidence double, stale boolean, deleted boolean, extraction_error string, generation string, canonical_id string, "
DOCUMENTS += "segment string, folded_title string, folded_path string, outranked_by array<struct<source_id:string,source_kind:string>>"
CHUNKS = "doc_id string, chunk_id string, ordinal long, section string, headings array<string>, locator string, text string, content_hash string, segment string, " + FOLDED.replace(":", " ").replace(",", ", ")
POSTINGS = "doc_id string, chunk_id string, field string, term string"
RUNS = "run_id string, started timestamp, seconds double, phase string, discovered long, indexed long, unchanged long, failed long, deleted long, bytes long"
ISSUES = "run_id string, source_id string, path string, code string, message string"
#: Tables that are written whole; chunks and postings are written by segment.
#: Changed files that are read by path.
MOST_LISTED = 10_000
TABLES = {"documents": DOCUMENTS, "runs": RUNS, "issues": ISSUES}
names = lambda schema: [c.split()[0] for c in re.sub(r"<[^ ]*>", "", schema).split(", ")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode(errors="surrogatepass")).hexdigest()


def path_key(path: str) -> str:
    """A path as a key: cleaned, composed Unicode."""
    scheme, mark, rest = path.rpartition("://") if "://" in path else ("", "", path)
    return unicodedata.normalize("NFC", scheme + mark + posixpath.normpath(rest))


def source_identity(kind: str, root: str) -> str:
    """What a source's rows belong to: another folder or kind is another source."""
    return sha(f"v1\0{kind}\0{path_key(root)}")


def content_digest(parts: list) -> str:
    """Hash over the chunks of a document: of their sections, headings, places and texts, in order."""
    return sha("".join(f"{b.section}\0{chr(0x1F).join(b.headings)}\0{b.locator}\0{b.text}\n" for b in parts))


def extract(batches: Iterator[pa.RecordBatch], today: dt.date, full: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """RESULT of files with the stored hash (known) of those that are stored and not stale; a file in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            f = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            data, name = f.pop("content") or b"", posixpath.basename(f["relative_path"])
            stem, known = name[: len(name) - len(f["extension"])] or name, f.pop("known")
            f["size"] = f.pop("length")
            row = f | {"doc_id": f"doc_{sha(path_key(f['path']))[:24]}", "title": stem, "outcome": "draft"}
            row["content_hash"] = hashlib.sha256(data).hexdigest()
            try:
                if full or known != row["content_hash"]:
                    document = read(stem, f["extension"], data, today)
                    parts = cut(document.blocks)
                    if f["extension"] in BY_CONTENT:
                        row["content_hash"] = content_digest(parts)
                    if full or known != row["content_hash"]:
                        day, by = resolve(stem, posixpath.dirname(f["path"]), f["source_kind"], document.blocks, document.evidence, document.modified, f["modified"], today)
                        suffix, title, heads = row["doc_id"][-8:], document.title.strip() or stem, set()
                        cuts = [{"chunk_id": f"chunk_{sha(b.text)[:16]}_{suffix}_{i}", "ordinal": i, "section": b.section, "headings": list(b.headings), "locator": b.locator, "text": b.text, "content_hash": sha(b.text)} for i, b in enumerate(parts)]
                        for i, c in enumerate(cuts):
                            heading = T.fold(" / ".join(c["headings"]))
                            c |= {"heading": heading, "folded": T.fold(c["text"]), "index_title": None if i else T.fold(title), "index_path": None if i else T.fold(f["relative_path"]), "index_heading": None if heading in heads else heading or None}
                            heads.add(heading)
                        row |= {"title": title, "effective_date": day, "date_source": by, "needs_ocr": document.needs_ocr, "warnings": document.warnings, "chunk_count": len(cuts), "chunks": cuts}
                    else:
                        row["outcome"] = "unchanged"
                else:
                    row["outcome"] = "unchanged"
            except Unreadable as e:
                row |= {"outcome": "issue", "code": e.code, "message": str(e)}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def processed(files: DataFrame, known: DataFrame, today: dt.date, full: bool = False) -> DataFrame:
    """RESULT of each of files (source_id, source_kind and the columns of discover()); known is (path, content_hash, stale)."""
    spark = files.sparkSession
    ship(spark)
    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    seen = known.select("path", F.when(~F.col("stale"), F.col("content_hash")).alias("known"))
    both = files.join(seen, "path", "left")
    return both.mapInArrow(partial(extract, today=today, full=full, schema=schema), RESULT)


def changed_only(files: DataFrame, known: DataFrame, today: dt.date, full: bool = False) -> DataFrame:
    """RESULT of files, of which only those are read that are new, stale, or of another length or time than is known.

    The listing is compared first. Up to MOST_LISTED changed files are read by their paths; where there are more, as in a
    first run, one scan reads them all.
    """
    spark = files.sparkSession
    if full or known.isEmpty():
        return processed(files, known, today, full)
    own = known.where("NOT stale").select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("doc_id").alias("_doc_id"), F.col("content_hash").alias("_hash"), F.col("title").alias("_title"))
    listing = stored(files.drop("content").join(own, "path", "left"), "index-listing")
    same = (F.col("length") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    new = listing.where(~F.coalesce(same, F.lit(False))).select([c for c in files.columns if c != "content"])
    paths = [r.path for r in new.select("path").limit(MOST_LISTED + 1).collect()]
    schema = StructType.fromDDL(RESULT)
    touched = {"doc_id": F.col("_doc_id"), "content_hash": F.col("_hash"), "title": F.col("_title"), "size": F.col("length"), "outcome": F.lit("unchanged")}
    kept = listing.where(same).select([(touched.get(f.name, F.col(f.name) if f.name in listing.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])
    if not paths:
        return kept
    if len(paths) > MOST_LISTED:
        read_ = files.join(new.select("path"), "path", "left_semi")
    else:
        # one read gives length, time and content of the same bytes
        content = spark.read.format("binaryFile").load([literal_path(p) for p in paths]).select("path", F.col("modificationTime").alias("modified"), "length", "content")
        read_ = new.drop("modified", "length").join(content, "path").select(files.columns)
    return kept.unionByName(processed(read_, known, today))


def outcomes(old: DataFrame, results: DataFrame, generation: str) -> DataFrame:
    """The documents after results, but for what is missing: unchanged rows are touched, unreadable ones stale, drafts replaced."""
    own = [c for c in old.columns if c not in ("size", "modified", "generation", "stale", "extraction_error")]
    found = results.where("outcome <> 'draft'").select("doc_id", F.col("size").alias("_size"), F.col("modified").alias("_modified"), "outcome", "message")
    kept = old.join(results.where("outcome = 'draft'").select("doc_id"), "doc_id", "left_anti").join(found, "doc_id", "left")
    bad = F.col("outcome") == "issue"
    kept = kept.select(
        *[F.when(F.col("outcome").isNotNull(), False).otherwise(F.col(c)).alias(c) if c == "deleted" else F.col(c) for c in own],
        F.coalesce("_size", "size").alias("size"), F.coalesce("_modified", "modified").alias("modified"),
        F.when(F.col("outcome").isNotNull(), F.lit(generation)).otherwise(F.col("generation")).alias("generation"),
        F.when(bad, True).when(F.col("outcome").isNotNull(), False).otherwise(F.col("stale")).alias("stale"), F.when(bad, F.col("message")).when(F.col("outcome").isNull(), F.col("extraction_error")).alias("extraction_error"),
    )
    k = T.family_key(T.normalize_text(F.col("title")))
    later = {"segment": F.lit(generation), "folded_title": T.normalize_text(F.col("title")), "folded_path": T.normalize_text(F.col("relative_path")), "outranked_by": F.lit(None)}
    new = results.where("outcome = 'draft'").withColumn("_k", k).select(
        *[c.split()[0] for c in DOCUMENT.split(", ")], F.col("_k.key").alias("family_key"), F.col("_k.confidence").alias("family_confidence"),
        F.lit(False).alias("stale"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("extraction_error"), F.lit(generation).alias("generation"), F.lit(None).cast("string").alias("canonical_id"),
        *[c.cast(old.schema[n].dataType).alias(n) for n, c in later.items() if n in old.columns],
    )
    return kept.unionByName(new)


def canonical(docs: DataFrame) -> DataFrame:
    """docs with canonical_id and outranked_by anew, over documents that aren't deleted and have a hash; null for the others."""
    live = docs.where(~F.col("deleted") & (F.coalesce("content_hash", F.lit("")) != ""))
    live = live.select("doc_id", "content_hash", "relative_path", "source_id", "source_kind", F.col("effective_date").cast("date").alias("effective_date"))
    ids = canonical_ids(live).select("doc_id", "canonical_id")
    return docs.drop("canonical_id", "outranked_by").join(ids, "doc_id", "left").join(leaders(live), "doc_id", "left")


def postings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """POSTINGS: distinct terms of each chunk by field.

    Words of the title and path belong to the first chunk alone, those of a heading to the first chunk that has it.
    """
    terms = lambda c: F.explode(T.folded_terms(c)).alias("term")
    body = chunks.select("doc_id", "chunk_id", F.lit("body").alias("field"), terms(F.col("text")))
    first = chunks.groupBy("doc_id", F.array_join("headings", " / ").alias("heading")).agg(F.min(F.struct("ordinal", "chunk_id")).alias("c"))
    heads = first.where("heading <> ''").select("doc_id", F.col("c.chunk_id").alias("chunk_id"), F.lit("heading").alias("field"), terms(T.normalize_text(F.col("heading"))))
    top = chunks.where("ordinal = 0").select("doc_id", "chunk_id").join(docs.select("doc_id", "title", "relative_path"), "doc_id")
    of = lambda c, name: top.select("doc_id", "chunk_id", F.lit(name).alias("field"), terms(T.normalize_text(F.col(c))))
    return reduce(DataFrame.unionByName, [body, heads, of("title", "title"), of("relative_path", "path")])


class Busy(Exception):
    """Another writer holds the lease."""


class Overtaken(Busy):
    """Another writer has committed, or taken the lease, since this one began: nothing of its work is committed."""


@dataclass(frozen=True)
class Snapshot:
    """One revision: tables stay readable, whatever is committed meanwhile, until its files' time of grace is over."""

    spark: SparkSession
    root: str
    pointer: dict

    @property
    def revision(self) -> int:
        return self.pointer["revision"]

    @property
    def segments(self) -> list[str]:
        return self.pointer["segments"]

    def table(self, name: str) -> DataFrame:
        """documents, chunks, postings, runs or issues."""
        if name == "postings":
            return self.postings()
        if name == "chunks":
            paths = [f"{self.root}/segments/{s}/chunks" for s in self.segments]
            if not paths:
                return self.spark.createDataFrame([], CHUNKS)
            # a document's chunks are those of the segment that it names
            return self.spark.read.schema(CHUNKS).parquet(*paths).join(self.table("documents").select("doc_id", "segment"), ["doc_id", "segment"], "left_semi").select(names(CHUNKS))
        at = self.pointer.get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], TABLES[name])

    def postings(self) -> DataFrame:
        """POSTINGS: a row for each chunk, field and term, from the stored entries."""
        index = self.serving("terms")
        rows = [self.spark.read.parquet(f"{p}/postings").withColumn("segment", F.lit(s)) for (s, p), stats in zip(index.parts, index._stats, strict=True) if stats["filled"]]
        if not rows:
            return self.spark.createDataFrame([], POSTINGS)
        each = reduce(DataFrame.unionByName, [r.select("term", "segment", "doc_id", "ordinal", "mask") for r in rows])
        fields = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(bit) != 0, F.lit(f)) for f, bit in serving.FIELDS.items()]), lambda x: x.isNotNull())
        ids = self.table("chunks").select("doc_id", "ordinal", "segment", "chunk_id")
        return each.join(ids, ["doc_id", "ordinal", "segment"]).select("doc_id", "chunk_id", F.explode(fields).alias("field"), "term")

    def serving(self, kind: str) -> serving.Postings:
        """The stored terms, or trigrams, of all segments."""
        return (serving.Trigrams if kind == "trigrams" else serving.Postings)(self.spark, [(s, f"{self.root}/segments/{s}/{kind}") for s in self.segments])


def index_rows(chunks: DataFrame) -> DataFrame:
    """What the postings of chunks are made from."""
    return chunks.select("doc_id", "ordinal", F.col("index_title").alias("title"), F.col("index_heading").alias("heading"), F.col("index_path").alias("path"), F.col("folded").alias("body"))


class Index:
    """The index below root, in any store that Spark writes.

    A commit writes one segment with the chunks and postings of the documents that have changed, and the narrow table of
    documents, in which each names the segment that holds its chunks: others' rows of it are dead. Then it creates the
    pointer of the next revision, which only one writer can. The highest pointer that can be read is current, so that a
    crash at any step leaves the revision before. Segments beyond MOST_SEGMENTS are merged, all but the first.

    A lease is a numbered file: the highest number holds, until its time is over. It is renewed as long as a run works.
    """

    LEASE_SECONDS, GRACE_SECONDS, MOST_SEGMENTS = 30, 600, 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.owner = spark, root.rstrip("/"), uuid.uuid4().hex
        self._lease: str | None = None

    # files of a few bytes beside the tables

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return sorted(str(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, name: str) -> dict | None:
        return read_small(self.spark, f"{self.root}/{name}")

    def _create(self, name: str, value: dict, new: bool = True) -> bool:
        return write_small(self.spark, f"{self.root}/{name}", value, new)

    # state

    def current(self) -> dict:
        """The pointer: revision, segments and the paths of tables; revision 0 before the first commit."""
        for name in reversed(self._names("pointers")):
            found = self._load(f"pointers/{name}")
            if found:
                return found
        return {"revision": 0, "number": 0, "segments": []}

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.root, self.current())

    @property
    def revision(self) -> int:
        return self.current()["revision"]

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def commit(self, tables: dict[str, DataFrame], segments: list[str], base: Snapshot) -> int:
        """The next revision: tables as given, the others as in base, whose successor it is; Overtaken if base has one."""
        at = f"tables/{int(time.time() * 1000):014d}-{uuid.uuid4().hex[:8]}"
        pointer = base.pointer | {"revision": base.revision + 1, "segments": segments, "written": time.time()}
        for name, df in tables.items():
            df.select(names(TABLES[name])).write.parquet(f"{self.root}/{at}/{name}")
            pointer[name] = f"{at}/{name}"
        taken = [int(n.split(".")[0]) for n in self._names("pointers")]
        pointer["number"] = max([*taken, base.pointer["number"]]) + 1
        newer = [n for n in taken if n > base.pointer["number"] and self._load(f"pointers/{n:012d}.json")]
        if newer or (self._lease and not self.holds()) or not self._create(f"pointers/{pointer['number']:012d}.json", pointer):
            raise Overtaken(f"revision {base.revision} isn't current any more")
        self._clean(pointer)
        return pointer["revision"]

    def _clean(self, current: dict) -> None:
        """Delete pointers whose grace is over, and what no other pointer names any more."""
        kept, old = [current], []
        for name in self._names("pointers"):
            p = self._load(f"pointers/{name}")
            if p is None or p["number"] == current["number"]:
                continue
            (kept if time.time() - p["written"] < self.GRACE_SECONDS else old).append(p)
        used = {p[t] for p in kept for t in TABLES if t in p} | {f"segments/{s}" for p in kept for s in p["segments"]}
        for p in old:
            for path in {p[t] for t in TABLES if t in p} | {f"segments/{s}" for s in p["segments"]}:
                if path not in used:
                    fs, target = self._path(path)
                    fs.delete(target, True)
            fs, target = self._path(f"pointers/{p['number']:012d}.json")
            fs.delete(target, False)

    # lease

    def _holder(self) -> tuple[str | None, dict]:
        for name in reversed(self._names("leases")):
            found = self._load(f"leases/{name}")
            if found:
                return name, found
        return None, {"owner": None, "until": 0.0}

    def acquire(self, now: float | None = None) -> None:
        """Take the lease, or that of an owner whose time is over; Busy otherwise."""
        now = time.time() if now is None else now
        _, held = self._holder()
        if held["owner"] != self.owner and held["until"] > now:
            raise Busy(held["owner"])
        number = max([int(n.split(".")[0]) for n in self._names("leases")], default=0) + 1
        name = f"{number:012d}.json"
        if not self._create(f"leases/{name}", {"owner": self.owner, "until": now + self.LEASE_SECONDS}):
            raise Busy("another writer")
        self._lease = name
        for old in self._names("leases"):
            if old < name:
                fs, p = self._path(f"leases/{old}")
                fs.delete(p, False)

    def holds(self) -> bool:
        """Whether the lease is still this writer's: the highest number is its own."""
        return self._lease is not None and (self._names("leases") or [None])[-1] == self._lease

    def renew(self, now: float | None = None) -> bool:
        """Prolong the lease; False where it was lost."""
        if not self.holds():
            return False
        self._create(f"leases/{self._lease}", {"owner": self.owner, "until": (time.time() if now is None else now) + self.LEASE_SECONDS}, new=False)
        return True

    def release(self) -> None:
        """Give the lease up, if it is still this writer's."""
        if self.holds():
            self._create(f"leases/{self._lease}", {"owner": self.owner, "until": 0.0}, new=False)
        self._lease = None

    # writers

    def run(self, sources: list[dict], today: dt.date, full: bool = False) -> dict:
        """Index the sources once; returns the run's row. Nothing is committed where nothing has changed."""
        self.acquire()
        over = threading.Event()

        def keep() -> None:
            while not over.wait(self.LEASE_SECONDS / 3) and self.renew():
                pass

        keeper = threading.Thread(target=keep, daemon=True)
        keeper.start()
        try:
            with scratch(self.spark):
                return self._run(sources, today, full)
        finally:
            over.set()
            keeper.join()
            self.release()

    def segment(self, label: str, chunks: DataFrame, base: Snapshot, replaced: DataFrame | None = None) -> None:
        """Write a segment of chunks (CHUNKS but for its name); replaced (doc_id) are documents of base whose rows it replaces."""
        top = f"{self.root}/segments/{label}"
        chunks.withColumn("segment", F.lit(label)).select(names(CHUNKS)).write.parquet(f"{top}/chunks")
        rows = index_rows(self.spark.read.schema(CHUNKS).parquet(f"{top}/chunks"))
        gone = None
        if replaced is not None and base.segments:
            gone = index_rows(stored(base.table("chunks").join(replaced, "doc_id", "left_semi"), "index-gone"))
        serving.build(rows, f"{top}/terms", gone=gone)
        serving.build_trigrams(rows, f"{top}/trigrams", gone=gone)

    def merge(self, docs: DataFrame, segments: list[str], label: str) -> tuple[DataFrame, list[str]]:
        """(docs, segments) with all segments but the first as one, named label: live rows alone, frequencies summed."""
        first, *rest = segments
        top = f"{self.root}/segments/{label}"
        live = self.spark.read.schema(CHUNKS).parquet(*[f"{self.root}/segments/{s}/chunks" for s in rest]).join(docs.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        live.withColumn("segment", F.lit(label)).select(names(CHUNKS)).write.parquet(f"{top}/chunks")
        rows = index_rows(self.spark.read.schema(CHUNKS).parquet(f"{top}/chunks"))
        for kind, write in (("terms", serving.build), ("trigrams", serving.build_trigrams)):
            parts = [f"{self.root}/segments/{s}/{kind}" for s in rest]
            stats = [read_small(self.spark, f"{p}/stats.json") for p in parts]
            terms = reduce(DataFrame.unionByName, [self.spark.read.schema("term string, df long, best int, total long").parquet(f"{p}/terms") for p in parts])
            counts = terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("best").alias("best"), F.sum("total").alias("total"))
            write(rows, f"{top}/{kind}", counts=counts.withColumn("n", F.lit(sum(s["chunks"] for s in stats))).withColumn("size", F.lit(sum(s["total"] for s in stats))))
        return docs.withColumn("segment", F.when(F.col("segment").isin(rest), F.lit(label)).otherwise(F.col("segment"))), [first, label]

    def _run(self, sources: list[dict], today: dt.date, full: bool) -> dict:
        began, run_id, base = time.time(), f"run_{uuid.uuid4().hex[:12]}", self.snapshot()
        files, problems = discover_all(self.spark, sources)
        old = base.table("documents")
        empty = "source_id string, source_kind string, path string, relative_path string, extension string, modified timestamp, length long, content binary"
        files = files if files is not None else self.spark.createDataFrame([], empty)
        results = stored(changed_only(files, old.where("NOT deleted"), today, full), "index-results")
        counts = Observation()
        touched = results.where("outcome <> 'unchanged'")
        docs = outcomes(old, results, run_id)
        # only a whole listing tells what is gone
        listed = [s["id"] for s in sources if s.get("enabled", True) and s.get("paths") is None and s["id"] not in {p["source_id"] for p in problems}]
        scanned = self.spark.createDataFrame([(x,) for x in listed], "source_id string")
        gone = mark_missing(docs.select("doc_id", "source_id"), results, scanned, "doc_id", "source_id").where("deleted").select("doc_id")
        docs = docs.join(gone.withColumn("_gone", F.lit(True)), "doc_id", "left").withColumn("_was", F.coalesce("deleted", F.lit(False))).withColumn("deleted", F.coalesce("_gone", "deleted")).drop("_gone")
        observed = docs.observe(counts, F.sum((F.col("deleted") & ~F.col("_was")).cast("long")).alias("deleted"))
        docs = stored(canonical(stored(observed.drop("_was"), "index-outcomes")).select(names(DOCUMENTS)), "index-documents")
        # one pass over the narrow rows of the results
        n = results.agg(*[F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in ("draft", "unchanged", "issue")], F.sum("size").alias("size")).first().asDict()
        n = {k: v or 0 for k, v in n.items()}
        run = {
            "run_id": run_id, "started": dt.datetime.fromtimestamp(began, dt.UTC).replace(tzinfo=None), "seconds": time.time() - began, "phase": "failed" if n["issue"] and not n["draft"] + n["unchanged"] or (problems and len(problems) == len(sources)) else "complete",
            "discovered": n["draft"] + n["unchanged"] + n["issue"], "indexed": n["draft"], "unchanged": n["unchanged"], "failed": n["issue"], "deleted": counts.get["deleted"] or 0, "bytes": n["size"],
        }
        issues = touched.where("outcome = 'issue'").select(F.lit(run_id).alias("run_id"), "source_id", "path", "code", "message")
        issues = issues.unionByName(self.spark.createDataFrame([{"run_id": run_id, **p} for p in problems], ISSUES))
        if run["indexed"] or run["failed"] or run["deleted"] or problems:
            segments = list(base.segments)
            if run["indexed"]:
                drafts = touched.where("outcome = 'draft'")
                self.segment(run_id, drafts.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*"), base, drafts.select("doc_id"))
                segments.append(run_id)
            if len(segments) > self.MOST_SEGMENTS:
                docs, segments = self.merge(docs, segments, f"merged_{run_id}")
            rows = self.spark.createDataFrame([run], RUNS)
            self.commit({"documents": docs, "runs": base.table("runs").unionByName(rows), "issues": base.table("issues").unionByName(issues)}, segments, base)
        return run

    def purge(self, source_ids: list[str]) -> dict:
        """Delete everything of some sources; returns how much went. What stays is written as one segment."""
        base = self.snapshot()
        old = base.table("documents")
        gone = old.where(F.col("source_id").isin(source_ids))
        counts = {"documents": gone.count(), "chunks": base.table("chunks").join(gone.select("doc_id"), "doc_id", "left_semi").count()}
        if counts["documents"]:
            label = f"purged_{uuid.uuid4().hex[:12]}"
            keep = stored(canonical(old.where(~F.col("source_id").isin(source_ids))).withColumn("segment", F.lit(label)).select(names(DOCUMENTS)), "index-documents")
            self.segment(label, base.table("chunks").join(keep.select("doc_id"), "doc_id", "left_semi"), base)
            self.commit({"documents": keep}, [label], base)
        return counts

    def invalidate(self, moved: list[str]) -> int:
        """Mark the documents of sources whose identity has changed as deleted; returns their number."""
        base = self.snapshot()
        old = base.table("documents")
        n = old.where(F.col("source_id").isin(moved) & ~F.col("deleted")).count()
        if n:
            docs = canonical(old.withColumn("deleted", F.col("deleted") | F.col("source_id").isin(moved)))
            self.commit({"documents": stored(docs.select(names(DOCUMENTS)), "index-documents")}, base.segments, base)
        return n

    def clear(self) -> int:
        """Empty the index; the revision still rises."""
        return self.commit({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}, [], self.snapshot())

    # reports

    def status(self) -> dict:
        """Counts of the current generation and of each source."""
        docs = self.table("documents").where("NOT deleted")
        own = F.col("doc_id") == F.col("canonical_id")
        row = docs.agg(F.count("*").alias("documents"), F.sum(own.cast("long")).alias("canonical"), F.sum(F.col("stale").cast("long")).alias("stale"), F.sum(F.when(own, F.col("chunk_count")).otherwise(0)).alias("canonical_chunks")).first()
        sources = {r.source_id: r["count"] for r in docs.groupBy("source_id").count().collect()}
        return {"revision": self.revision, "sources": sources, **{k: v or 0 for k, v in row.asDict().items()}}

    def recent(self, table: str, n: int = 20) -> DataFrame:
        """The last runs, or the issues of the last runs."""
        if table == "runs":
            return self.table("runs").orderBy(F.desc("started"), "run_id").limit(n)
        order = Window.orderBy(F.desc("started"), "run_id")
        runs = self.table("runs").select("run_id", "started").orderBy(F.desc("started")).limit(n).withColumn("_r", F.row_number().over(order))
        return self.table("issues").join(F.broadcast(runs), "run_id").orderBy("_r", "source_id", "path").limit(n).drop("_r", "started")

    def consistency(self) -> DataFrame:
        """One row of counts; all but the first three are 0 in a sound index."""
        docs, chunks, terms = (self.table(t) for t in ("documents", "chunks", "postings"))
        one = lambda df, name: df.agg(F.count("*").alias(name))
        live = docs.where("NOT deleted")
        counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
        parts = [
            one(docs, "documents"), one(chunks, "chunks"), one(terms, "postings"), one(chunks.join(docs, "doc_id", "left_anti"), "orphan_chunks"), one(terms.join(chunks, "chunk_id", "left_anti"), "orphan_postings"),
            one(chunks.groupBy("doc_id", "ordinal").count().where("count > 1"), "repeated_ordinals"), one(live.join(counted, "doc_id", "left").where("coalesce(n, 0) <> chunk_count"), "wrong_chunk_counts"),
            one(live.where("canonical_id IS NOT NULL").join(live.select(F.col("doc_id").alias("canonical_id")), "canonical_id", "left_anti"), "lost_canonical"), one(docs.where("coalesce(source_id, '') = ''"), "without_source"),
        ]
        return reduce(DataFrame.crossJoin, parts)  # one row each
