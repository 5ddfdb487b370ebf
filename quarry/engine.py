"""The engine over one stored index: configuration, indexing, search, retrieval, citations and versions.

Requests are checked before anything runs: unknown fields and values out of range are errors. Answers are plain values.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import posixpath
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.dates import search_date
from quarry.functions.query import QueryPlan, distinct, lexical_terms, understand, weigh
from quarry.operators import activities as A
from quarry.operators import citations as C
from quarry.operators import search as S
from quarry.operators.candidates import first_in_scope
from quarry.operators.indexing import Busy, Index, Snapshot, path_key, source_identity
from quarry.operators.maintenance import reconcile
from quarry.operators.serving import caps, merged
from quarry.session import scratch, stored

# What a new source of each kind reads, and the folders that no source reads.
EXTENSIONS = {
    "design": (".docx", ".md", ".markdown", ".txt", ".html", ".htm", ".pdf", ".xmind", ".xlsx", ".xlsm", ".xls", ".csv"),
    "table": (".xlsx", ".xlsm", ".xls", ".csv", ".json", ".yaml", ".yml"),
}
EXCLUDED = (".git", ".svn", "node_modules")
SORTS, MODES = ("newest", "relevance", "hybrid"), ("lexical", "semantic", "hybrid", "auto")


class BadRequest(ValueError):
    """A request or configuration with unknown fields or values out of range."""


def checked(kind: type, value: dict) -> Any:
    """A dataclass from plain values; BadRequest for what it doesn't have."""
    unknown = set(value) - {f.name for f in fields(kind)}
    if unknown:
        raise BadRequest(f"unknown fields: {', '.join(sorted(unknown))}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    except TypeError as e:
        raise BadRequest(str(e)) from e


@dataclass(frozen=True)
class Source:
    """A folder of documents."""

    id: str
    kind: str
    root: str
    label: str = ""
    enabled: bool = True
    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = EXCLUDED
    max_bytes: int = 128 << 20

    def __post_init__(self) -> None:
        if self.kind not in EXTENSIONS or not self.id.strip():
            raise BadRequest(f"source {self.id!r} of kind {self.kind!r}")
        if not (posixpath.isabs(self.root) or "://" in self.root):
            raise BadRequest(f"{self.root!r} isn't an absolute path")
        if not 1 <= self.max_bytes <= 2 << 30:
            raise BadRequest("max_bytes")
        object.__setattr__(self, "extensions", tuple(e.lower() for e in self.extensions) or EXTENSIONS[self.kind])
        object.__setattr__(self, "exclude", tuple(dict.fromkeys((*EXCLUDED, *self.exclude))))

    @property
    def identity(self) -> str:
        return source_identity(self.kind, self.root)


@dataclass(frozen=True)
class Config:
    """What an engine works by. Sources must not lie in one another."""

    sources: tuple[Source, ...] = ()
    sort: str = "newest"
    limit: int = 12
    evidence: int = 24_000
    synonyms: bool = True
    scan_minutes: int = 10

    def __post_init__(self) -> None:
        ids, roots = [s.id for s in self.sources], [path_key(s.root) for s in self.sources]
        if len(set(ids)) < len(ids) or self.sort not in SORTS or not 1 <= self.limit <= 100 or not 2_000 <= self.evidence <= 60_000 or self.scan_minutes < 1:
            raise BadRequest("configuration out of range")
        if any(i != j and (a + "/").startswith(b + "/") for i, a in enumerate(roots) for j, b in enumerate(roots)):
            raise BadRequest("a source lies in another")

    @classmethod
    def load(cls, text: str) -> Config:
        """From JSON; BadRequest where it isn't one or has other fields."""
        try:
            value = json.loads(text)
        except ValueError as e:
            raise BadRequest(f"not JSON: {e}") from e
        if not isinstance(value, dict) or not isinstance(value.get("sources", []), list):
            raise BadRequest("not a configuration")
        return checked(cls, value | {"sources": [checked(Source, s) for s in value.get("sources", [])]})

    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.dump().encode()).hexdigest()


@dataclass(frozen=True)
class Request:
    """A search."""

    query: str
    sort: str = ""
    mode: str = "auto"
    limit: int = 0
    excerpts: int = 3
    latest_per_family: bool = False
    source_ids: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    section_types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    updated_after: str = ""
    updated_before: str = ""

    def __post_init__(self) -> None:
        if (self.sort and self.sort not in SORTS) or self.mode not in MODES or not 0 <= self.limit <= 100 or not 1 <= self.excerpts <= 10 or set(self.source_kinds) - set(EXTENSIONS):
            raise BadRequest("a search out of range")
        for d in (self.updated_after, self.updated_before):
            if d:
                try:
                    search_date(d)
                except ValueError as e:
                    raise BadRequest(str(e)) from e


@dataclass(frozen=True)
class Retrieval(Request):
    """A search for evidence."""

    documents: int = 8
    chunks_per_document: int = 4
    characters: int = 0
    document_ids: tuple[str, ...] = ()


def short_date(at: dt.datetime) -> str:
    """A day where it is midnight, else to the second."""
    return at.date().isoformat() if at.time() == dt.time() else at.replace(microsecond=0, tzinfo=None).isoformat() + "Z"


def rounded(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


class Unsettled(RuntimeError):
    """The configuration or the index kept changing while an answer was made."""


#: How often an answer is made anew where its files went or the configuration changed; candidates that vectors are compared for.
ATTEMPTS, COMPARED = 3, 80
#: Candidates of anchors, of the substring scan, and below how many the scan is made, by limit.
MOST_EXACT, MOST_LIKE, LIKE_RANK = 240, 800, 10.0
FEW = lambda limit: max(24, limit * 3)


@dataclass
class Vectors:
    """Embeddings of chunks (chunk_id, embedding), and how a question gets one."""

    table: DataFrame
    embed: Callable[[str], list[float]]


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config, today: Callable[[], dt.date] = lambda: dt.datetime.now(dt.UTC).date(), vectors: Vectors | None = None):
        self.spark, self.index, self.config, self.today, self.vectors = spark, Index(spark, root), config, today, vectors

    # index

    def update(self, source_ids: tuple[str, ...] | None = None, full: bool = False, paths: dict[str, list[str]] | None = None) -> dict:
        """Index all sources, or some; an unknown or disabled one is an error. Sources that have moved start anew.

        With paths, of these sources only the files that are named are looked at.
        """
        known = {s.id for s in self.config.sources if s.enabled}
        if source_ids is not None and set(source_ids) - known:
            raise BadRequest(f"no such source in use: {sorted(set(source_ids) - known)}")
        chosen = [asdict(s) | ({"paths": paths[s.id]} if paths and s.id in paths else {}) for s in self.config.sources if s.id in (known if source_ids is None else source_ids)]
        return self.index.run(chosen, self.today(), full)

    def reconfigure(self, config: Config) -> dict[str, str]:
        """Take a new configuration: sources that are gone are purged, those with another folder or kind invalidated."""
        rows = lambda c: self.spark.createDataFrame([(s.id, s.identity) for s in c.sources], "id string, identity string")
        change = {r.id: r.change for r in reconcile(rows(self.config), rows(config), "id", "identity").collect()}
        gone, moved = ([k for k, v in change.items() if v == x] for x in ("removed", "changed"))
        self.config = config
        if gone:
            self.index.purge(gone)
        if moved:
            self.index.invalidate(moved)
        return change

    def status(self) -> dict:
        runs = [r.asDict() for r in self.index.recent("runs").collect()]
        return self.index.status() | {"runs": runs, "issues": [r.asDict() for r in self.index.recent("issues").collect()], "fingerprint": self.config.fingerprint}

    # answers

    def _settled(self, answer: Callable[[Snapshot], dict]) -> dict:
        """answer of one revision, made anew where its files went or the configuration changed meanwhile."""
        for _ in range(ATTEMPTS):
            fingerprint = self.config.fingerprint
            try:
                with scratch(self.spark):
                    out = answer(self.index.snapshot())
            except Exception as e:  # noqa: BLE001 - of the store: a file of a revision that is gone
                if "FileNotFound" in str(e) or "FILE_NOT_EXIST" in str(e) or "PATH_NOT_FOUND" in str(e):
                    continue
                raise
            if self.config.fingerprint == fingerprint:
                return out
        raise Unsettled("the index or its configuration kept changing")

    def _documents(self, at: Snapshot, source_ids: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
        """Documents that count within a scope: of equal contents the first among the sources in use that are asked for."""
        ids = [s.id for s in self.config.sources if s.enabled and (not source_ids or s.id in source_ids)]
        return at.table("documents").where(~F.col("deleted") & first_in_scope(ids, kinds))

    def _chunks(self, at: Snapshot, docs: DataFrame) -> DataFrame:
        """Chunks of docs with the folded columns that search reads; they were folded when they were indexed."""
        own = docs.select("doc_id", F.col("folded_title").alias("title"), F.col("folded_path").alias("relative_path"), "source_id", "source_kind", "extension", "family_key", F.col("effective_date").cast("date").alias("effective_date"))
        return at.table("chunks").select("doc_id", "ordinal", "chunk_id", "section", "heading", F.col("folded").alias("chunk_text")).join(own, "doc_id")

    def _pool(self, at: Snapshot, docs: DataFrame, r: Request, plan: QueryPlan, limit: int, excerpts: int) -> tuple[DataFrame, QueryPlan]:
        """(candidate chunks with their rank, plan with the corpus's weights): postings first, texts of candidates alone.

        Exact anchors, weighted concepts (or words, where no concept has a weight) and substrings of titles, headings and
        paths are merged. Where few of them hold what the question asks for, texts are scanned for substrings too.
        """
        terms, heads = at.serving("terms"), at.serving("trigrams")
        live = at.table("documents").select("doc_id", "segment")
        own = docs.select("doc_id", "segment", "canonical_id", F.col("folded_path").alias("relative_path"), F.col("effective_date").cast("date").alias("effective_date"))
        narrow = own.drop("canonical_id")
        found, weights = terms.weighted(plan, live)
        plan = weigh(plan, weights) if plan.concepts else plan
        cap, each = caps(limit, excerpts, plan.tables)
        anchors = distinct([*plan.document_anchors, *(g.entity for g in plan.named)])
        exact = stored(heads.candidates(anchors, narrow, min(MOST_EXACT, cap), live), "search-exact") if anchors else None
        ranked = [terms.concept_candidates(found, narrow, cap, each) if found else terms.lexical_candidates(plan.terms, narrow, cap), heads.candidates(plan.terms, narrow, cap, live)]
        pool = stored(merged(exact, ranked, own), "search-pool")
        chunks = self._chunks(at, docs)
        rows = stored(self._filters(r).of(chunks.join(F.broadcast(pool), ["doc_id", "ordinal"])), "search-candidates")
        others = [a for a in plan.anchors if a not in plan.document_anchors]
        held = S._any(map(S.holds, plan.document_anchors)) | S._any(map(S.holds, plan.primary)) if plan.primary else F.lit(True)
        held = reduce(lambda x, y: x & y, [S.holds(a) for a in others] + ([S._any(map(S.holds, plan.document_anchors))] if plan.document_anchors else []), held)
        if rows.where(held).count() < FEW(limit) and pool.count() < 4 * FEW(limit):
            words = [w for w in lexical_terms(r.query, self.config.synonyms) if len(w) > 1][:12]
            any_of = S._any(F.col(c).contains(w) for w in words for c in ("chunk_text", "title", "relative_path"))
            like = self._filters(r).of(chunks).where(any_of).join(pool.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")
            like = like.orderBy(F.desc("effective_date"), "relative_path", "doc_id", "ordinal").limit(MOST_LIKE).withColumn("rank", F.lit(LIKE_RANK))
            rows = stored(rows.unionByName(like.select(rows.columns)), "search-candidates")
        return rows, plan

    def _semantic(self, r: Request, rows: DataFrame) -> tuple[DataFrame | None, list[str]]:
        """((doc_id, ordinal, similarity) of the first candidates that have a vector, warnings)."""
        if r.mode == "lexical" or (r.mode == "auto" and self.vectors is None):
            return None, []
        if self.vectors is None:
            return None, ["no embeddings: words alone are compared"]
        asked = F.array(*[F.lit(float(x)) for x in self.vectors.embed(r.query)])
        first = rows.orderBy("rank", F.desc("effective_date"), "relative_path", "chunk_id").limit(COMPARED).select("doc_id", "ordinal", "chunk_id")
        near = self.vectors.table.select("chunk_id", "embedding").join(F.broadcast(first), "chunk_id").select("doc_id", "ordinal", F.round(F.greatest(F.lit(0.0), T.cosine(F.col("embedding"), asked)), 6).alias("similarity"))
        return stored(near, "search-similar"), []

    def _filters(self, r: Request) -> S.Filters:
        day = lambda x: search_date(x).date() if x else None
        return S.Filters(r.source_ids, r.source_kinds, r.section_types, r.extensions, (), day(r.updated_after), day(r.updated_before))

    def _shown(self, at: Snapshot, hits: DataFrame, docs: DataFrame, terms: list[str], limit: int) -> list[dict]:
        """Excerpts with citations of the chosen chunks: texts are fetched for these alone."""
        rows = hits.select("doc_id", "relevance", F.posexplode("ordinals").alias("k", "ordinal"))
        both = at.table("chunks").drop("segment", "heading").join(F.broadcast(rows), ["doc_id", "ordinal"]).join(docs.select("doc_id", "title", "path", "relative_path", "source_kind", "effective_date", "date_source", "family_key", "stale"), "doc_id")
        e = C.excerpts(F.col("text"), F.col("locator"), F.col("chunk_id"), F.col("content_hash"), terms, limit)
        return [r.asDict(True) for r in both.withColumn("e", e).drop("text", "folded").collect()]

    def search(self, request: dict | Request) -> dict:
        """Documents with excerpts. Sources that aren't in use give none, with a warning."""
        r = request if isinstance(request, Request) else checked(Request, request)
        return self._settled(lambda at: self._search(r, at))

    def _search(self, r: Request, at: Snapshot) -> dict:
        plan, began = understand(r.query, self.config.synonyms), time.time()
        sort = r.sort or ("newest" if plan.latest else self.config.sort)
        warnings = [f"no such source in use: {s}" for s in r.source_ids if s not in {x.id for x in self.config.sources if x.enabled}]
        limit = r.limit or self.config.limit
        docs = self._documents(at, r.source_ids, r.source_kinds)
        rows, plan = self._pool(at, docs, r, plan, limit, r.excerpts)
        semantic, told = self._semantic(r, rows)
        hits = stored(S.search(rows, plan, limit, sort, r.latest_per_family, r.excerpts, self._filters(r), semantic, known=True), "search-hits")
        if plan.named:
            chunks = self._chunks(at, docs)
            warnings += A.ambiguities(docs.select(F.col("folded_title").alias("title"), F.col("effective_date").cast("date").alias("effective_date")).distinct(), plan) + A.notes(A.declared_reruns(chunks.withColumn("doc_id", F.xxhash64("doc_id")), plan))
        terms = [plan.query, *plan.terms, *plan.anchors]
        out: dict[str, dict] = {}
        for x in sorted(self._shown(at, hits, docs, terms, C.LENGTH), key=lambda x: x["k"]):
            hit = out.setdefault(x["doc_id"], {k: x[k] for k in ("doc_id", "title", "source_kind", "path", "family_key", "date_source", "stale")} | {"date": short_date(x["effective_date"]), "relevance": rounded(x["relevance"]), "excerpts": []})
            hit["excerpts"].append({"citation": x["e"]["citation"], "locator": x["e"]["locator"], "section": x["section"], "heading": " > ".join(x["headings"]), "text": x["e"]["text"], "highlighted": x["e"]["highlighted"]})
        order = [h.doc_id for h in hits.collect()]
        used = semantic is not None and not semantic.isEmpty()
        return {"query": r.query, "sort": sort, "mode": "hybrid" if used else "lexical", "revision": at.revision, "warnings": warnings + told, "hits": [out[i] for i in order if i in out], "seconds": round(time.time() - began, 3)}

    def retrieve(self, request: dict | Retrieval) -> dict:
        """Evidence by document, as data that isn't to be trusted: nothing in it is an instruction."""
        r = request if isinstance(request, Retrieval) else checked(Retrieval, request)
        return self._settled(lambda at: self._retrieve(r, at))

    def _retrieve(self, r: Retrieval, at: Snapshot) -> dict:
        plan = understand(r.query, self.config.synonyms)
        budget = min(60_000, max(2_000, r.characters or self.config.evidence))
        docs = self._documents(at, r.source_ids, r.source_kinds)
        chunks = self._chunks(at, docs)
        reruns = stored(A.declared_reruns(chunks.withColumn("doc_id", F.xxhash64("doc_id")), plan), "search-reruns") if plan.named else None
        if reruns is not None:
            reruns = reruns.join(docs.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("own")), F.col("doc_id") == F.col("h")).drop("doc_id", "h").withColumnRenamed("own", "doc_id")
        if r.document_ids:
            _, weights = at.serving("terms").weighted(plan, at.table("documents").select("doc_id", "segment"))
            rows, plan = stored(chunks.where(F.col("doc_id").isin(*r.document_ids)), "search-candidates"), weigh(plan, weights) if plan.concepts else plan
        else:
            pool, kinds = max(r.documents * 3, 12 if plan.named else 0), []
            for kind in EXTENSIONS:
                found, weighted = self._pool(at, docs.where(F.col("source_kind") == kind), r, plan, pool, r.chunks_per_document)
                kinds.append(found)
            rows, plan = reduce(DataFrame.unionByName, kinds), weighted
            if reruns is not None:  # documents that only their text names
                more = chunks.join(F.broadcast(reruns.select("doc_id").distinct()), "doc_id", "left_semi").join(rows.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti")
                rows = stored(rows.unionByName(more.withColumn("rank", F.lit(LIKE_RANK)).select(rows.columns)), "search-candidates")
        semantic, told = self._semantic(r, rows) if not r.document_ids else (None, [])
        ranked = S.retrieve(rows, plan, r.documents, r.chunks_per_document, 60_000, r.sort or self.config.sort, r.document_ids, self._filters(r), reruns, known=True, semantic=semantic)
        hits = stored(ranked.groupBy("doc_id").agg(F.min("position").alias("position"), F.lit(0.0).alias("relevance"), F.transform(F.array_sort(F.collect_list(F.struct("used", "ordinal"))), lambda x: x["ordinal"]).alias("ordinals")), "search-hits")
        order = {h.doc_id: h.position for h in hits.collect()}
        length = min(C.TARGETED_LENGTH, max(C.LENGTH, budget // (max(1, len(r.document_ids)) * r.chunks_per_document))) if r.document_ids else C.LENGTH
        found = self._shown(at, hits, docs, [plan.query, *plan.terms, *plan.anchors], length)
        used, cut, out = 0, False, {}
        for x in sorted(found, key=lambda x: (order[x["doc_id"]], x["k"])):
            used += C.length16(x["e"]["text"])
            if used > budget:
                used, cut = used - C.length16(x["e"]["text"]), True
                break
            d = out.setdefault(x["doc_id"], {"doc_id": x["doc_id"], "title": x["title"], "date": short_date(x["effective_date"]), "date_source": x["date_source"], "path": x["path"], "evidence": []})
            d["evidence"].append({"citation": x["e"]["citation"], "locator": x["e"]["locator"], "section": x["section"], "heading": " > ".join(x["headings"]), "text": x["e"]["text"]})
        missing = [i for i in r.document_ids if i not in order]
        warnings = told + [f"not there, not in use or filtered out: {', '.join(missing)}"] * bool(missing)
        if reruns is not None:
            warnings += A.ambiguities(docs.select(F.col("folded_title").alias("title"), F.col("effective_date").cast("date").alias("effective_date")).distinct(), plan) + A.notes(reruns)
        return {"trust": "untrusted_reference_data", "query": r.query, "revision": at.revision, "truncated": cut, "characters": used, "warnings": warnings, "documents": list(out.values())}

    def read_citation(self, citation: str, expected_revision: int | None = None) -> dict:
        ids = [s.id for s in self.config.sources if s.enabled]
        at = self.index.snapshot()
        return C.read_citation(at.table("documents"), at.table("chunks"), citation, at.revision, expected_revision, ids)

    def versions(self, document_id: str = "", family_key: str = "", limit: int = 30) -> list[dict]:
        """A family's documents, the newest first."""
        if bool(document_id) == bool(family_key) or not 1 <= limit <= 100:
            raise BadRequest("give a document or a family, and a limit to 100")
        docs = self._documents(self.index.snapshot())
        if document_id:
            row = docs.where(F.col("doc_id") == document_id).first()
            if row is None:
                return []
            family_key = row.family_key
        rows = docs.where(F.col("family_key") == family_key).orderBy(F.desc("effective_date"), "relative_path", "doc_id").limit(limit).collect()
        return [{"doc_id": x.doc_id, "title": x.title, "date": short_date(x.effective_date), "date_source": x.date_source, "path": x.path, "stale": x.stale} for x in rows]


@dataclass
class Job:
    """Indexing beside other work: started, paused between sources, resumed, stopped; a pause before the start holds it."""

    engine: Engine
    progress: list[dict] = field(default_factory=list)
    state: str = "idle"

    def __post_init__(self) -> None:
        self._go, self._stop, self._thread = threading.Event(), threading.Event(), None
        self._go.set()

    def start(self, full: bool = False, retry_from: float = 0.25, retry_to: float = 5.0) -> None:
        """Run source after source; a lease held by another is waited for, longer each time."""
        if self._thread and self._thread.is_alive():
            raise Busy("this job runs")
        self._stop.clear()
        self.progress.clear()

        def work() -> None:
            self.state = "running"
            for s in [s for s in self.engine.config.sources if s.enabled]:
                wait = retry_from
                while not self._stop.is_set():
                    self._go.wait()
                    if self._stop.is_set():
                        break
                    try:
                        self.progress.append({"source": s.id} | self.engine.update((s.id,), full))
                        break
                    except Busy:
                        self._stop.wait(wait)
                        wait = min(retry_to, wait * 2)
            self.state = "stopped" if self._stop.is_set() else "complete"

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def pause(self) -> None:
        self._go.clear()
        self.state = "paused"

    def resume(self) -> None:
        self._go.set()
        self.state = "running" if self._thread and self._thread.is_alive() else "idle"

    def stop(self) -> None:
        self._stop.set()
        self._go.set()

    def wait(self, seconds: float | None = None) -> str:
        if self._thread:
            self._thread.join(seconds)
        return self.state


def with_sources(config: Config, **changes: Source | None) -> Config:
    """config with sources added, replaced or (None) removed by id."""
    kept = {s.id: s for s in config.sources} | changes
    return replace(config, sources=tuple(s for s in kept.values() if s is not None))
