"""The engine: one indexed root with its tables, the requests it answers, and its place among other roots.

Every request is a plan over the root's tables; only pages of results reach the driver.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import asdict, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopegrain.functions.text import clean_query, content_hash
from scopegrain.operators import chunkers, fold, scopes, search, sync, tags
from scopegrain.shared import materialise, release
from scopegrain.sources import files, models
from scopegrain.sources.store import Store, registered

#: Settings of a root unless given or stored.
DEFAULTS: dict[str, Any] = {"extensions": list(files.EXTENSIONS), "ignore": list(files.IGNORE), "chunk_size": 512, "chunk_overlap": 64, "tags": 50, "strategy": "warn"}
#: Sessions kept for each client.
SESSIONS = 10


class Engine:
    """Index, search and maintain one root. ``embedder`` turns texts into vectors; the default one is local.

    Settings given here stand over those stored with the index, which stand over the defaults. ``registry`` names the folder
    of a table of roots: an engine that has one finds the roots above and below its own there, leaves their files to those
    below, and can search them all.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: models.Embedder | None = None, params: search.SearchParams | None = None, registry: str | None = None, **settings: Any) -> None:
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self.store = Store(spark, store)
        self.registry = Store(spark, registry) if registry else None
        self.embedder = embedder or models.hashing()
        self.params = params or search.SearchParams()
        self.settings = {**self.store.settings(DEFAULTS), **settings}
        self._ask = models.cached(self.embedder)
        self._sessions: OrderedDict[tuple[str, int], DataFrame] = OrderedDict()
        self._seq: dict[str, int] = {}

    # indexing

    def _scan(self) -> DataFrame:
        nested = None
        if self.registry is not None:
            prefix = f"{self.root}/"
            nested = self.registry.read("roots").filter(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("path"))
        return files.scan(self.spark, self.root, tuple(self.settings["extensions"]), tuple(self.settings["ignore"]), nested)

    def _chunks(self, documents: DataFrame) -> DataFrame:
        made = chunkers.chunk_documents(documents, "path", "path", "content", self.settings["chunk_size"], self.settings["chunk_overlap"]).drop("id")
        hashed = made.join(documents.select("path", "hash"), "path")
        return models.embed_column(hashed, "content", self.embedder)

    def _files(self, documents: DataFrame, above: int) -> DataFrame:
        return sync.numbered(documents.select("path", "hash", "size", "mtime", F.current_timestamp().alias("indexed_at")), ["path"], above)

    def build_tags(self) -> None:
        """Choose the tags, assign them to chunks and files and count their edges anew; all three tables change at once."""
        chunks = self.store.read("chunks")
        chosen = tags.choose_tags(chunks, "id", "content", self.settings["tags"]).withColumnRenamed("term", "name").withColumnRenamed("score", "weight")
        fresh = materialise(models.embed_column(sync.numbered(chosen, ["name"], 0), "name", self.embedder), "tags")
        assigned = materialise(tags.assign_tags(chunks, "id", "content", fresh), "assigned")
        of_file = chunks.select("id", "path").join(self.store.read("files").select(F.col("id").alias("file_id"), "path"), "path")
        carried = assigned.join(of_file, "id").select("file_id", "tag_id").distinct()
        self.store.write(tags=fresh, edges=tags.edges_of(assigned), file_tags=carried)
        release(fresh), release(assigned)

    def _save(self, chunks: DataFrame, listed: DataFrame, **more: DataFrame) -> None:
        """Chunks with their vectors, files, and the vectors' main axes, all at once."""
        held = materialise(chunks, "chunks")
        vectors = held.filter("vector is not null").select("id", "vector")
        self.store.write(chunks=held.drop("vector"), vectors=vectors, files=listed, axes=search.main_axes(vectors, self.params), **more)
        release(held)

    def init(self) -> dict[str, int]:
        """Index the root from scratch, tag graph included; whatever stood there before is replaced."""
        self.store.save_settings(self.settings)
        self.register()
        documents = materialise(self._scan(), "documents")
        fresh = materialise(self._chunks(documents), "chunks")
        mark, width = models.fingerprint(self.embedder)
        meta = self.spark.createDataFrame([(1, "local", width, mark, 1)], "id bigint, model_id string, dimensions int, fingerprint string, is_active int").withColumn("created_at", F.current_timestamp())
        self._save(sync.numbered(fresh, ["path", "start_line", "chunk_index"], 0), self._files(documents, 0), model_meta=meta)
        self.build_tags()
        release(documents), release(fresh)
        return self.status()

    def _whole(self) -> DataFrame:
        """The chunks with their vectors."""
        return self.store.read("chunks").join(self.store.read("vectors"), "id", "left")

    def _apply(self, documents: DataFrame, diff: DataFrame) -> None:
        come = documents.join(diff.filter(F.col("status").isin("added", "updated")), "path", "left_semi")
        fresh = materialise(self._chunks(come), "fresh")
        stay = self.store.read("files").join(diff.filter("status <> 'same'"), "path", "left_anti")
        top = self.store.read("files").agg(F.max("id")).first()[0] or 0
        self._save(sync.apply_changes(self._whole(), fresh.withColumn("stale", F.lit(0)), diff), stay.unionByName(self._files(come, top)))
        release(fresh)

    def sync(self, force: bool = False, rebuild_tags: bool = False) -> dict[str, int]:
        """Bring the tables up to date with the root; files without chunks count as indexed. Doing it twice changes nothing."""
        self.load()
        documents = materialise(self._scan(), "documents")
        diff = materialise(sync.changes(documents, self.store.read("files"), force), "changes")
        counts = sync.change_counts(diff).first().asDict()
        if any(counts.values()):
            self._apply(documents, diff)
            if rebuild_tags:
                self.build_tags()
        release(documents), release(diff)
        return {**counts, "total_chunks": self.store.read("chunks").count()}

    def load(self) -> None:
        """Check that the index is there: an error if the root was never indexed; lost vectors are made again from the chunks."""
        if not self.store.exists():
            raise FileNotFoundError(f"{self.root} is not indexed; init comes first")
        if not self.store.has("vectors"):
            self.recover()

    def recover(self) -> None:
        """Embed all stored chunks anew, as after a lost or outdated index."""
        vectors = materialise(models.embed_column(self.store.read("chunks").select("id", "content"), "content", self.embedder).filter("vector is not null").select("id", "vector"), "recovered")
        self.store.write(vectors=vectors, axes=search.main_axes(vectors, self.params))
        release(vectors)

    # other roots

    def register(self) -> None:
        """Enter the root in the registry, below the deepest root above it; roots below it move below it."""
        if self.registry is not None:
            self.registry.write(roots=registered(self.registry.read("roots"), self.root, self.store.folder))

    def members(self, scope: str) -> list[tuple[str, str]]:
        """(path, store) of the roots that a search from here covers; a scope's roots are few, each an index of its own."""
        if scope == "local" or self.registry is None:
            return [(self.root, self.store.folder)]
        roots = self.registry.read("roots")
        covered = scopes.members(roots, scopes.ancestors(roots), scope).join(roots.filter(F.col("path") == self.root).select("id"), "id", "left_semi")
        return [(r.path, r.store) for r in roots.join(covered.select(F.col("member_id").alias("id")), "id", "left_semi").orderBy("path").collect()]

    def _other(self, path: str, store: str) -> Engine:
        return self if path == self.root else Engine(self.spark, path, store, self.embedder, self.params)

    # searching

    def _hits(self, vector: list[float], enhanced: bool, params: search.SearchParams) -> DataFrame:
        """(query_id, rank, ...) of one query over this root alone."""
        self.load()
        asked = self.spark.createDataFrame([(0, vector)], "query_id bigint, vector array<double>")
        now = self.store.version()
        chunks, vectors, known = (self.store.read(t, now) for t in ("chunks", "vectors", "tags"))
        if enhanced and known.limit(1).count():
            return search.enhanced_search(chunks, known, self.store.read("edges", now), asked, params, self.store.read("axes", now), vectors)
        plain = search.basic_search(vectors, chunks, asked, params)
        return plain.withColumns({"matched": F.lit(None).cast("array<string>"), "is_secondary": F.lit(False), "logic_depth": F.lit(0.5), "mode": F.lit("precise")})

    def search(self, query: str, enhanced: bool = True, max_tokens: int | None = None, level: int | None = None, client: str = "", top_k: int | None = None, min_similarity: float | None = None, scope: str = "local") -> tuple[str, DataFrame]:
        """The session's name and the folded hits of a query.

        ``scope`` is local, bubble (and the root above), cascade (and the roots right below) or merge (and all roots above and
        those right below). Hits of other roots have their paths seen from here; of hits at one place the best counts.
        """
        given = {"top_k": top_k, "min_similarity": min_similarity}
        params = replace(self.params, **{k: v for k, v in given.items() if v is not None})
        cleaned = self.spark.range(1).select(clean_query(F.lit(query)).alias("q")).first().q
        vector = list(self._ask(cleaned))
        columns = ["query_id", "root", "id", "path", "chunk_index", "start_line", "end_line", "content", "heading", "score", "similarity", "rank", "is_secondary", "matched", "logic_depth", "mode"]
        parts = []
        for path, store in self.members(scope):
            own = self._other(path, store)._hits(vector, enhanced, params)
            seen = F.col("path") if path == self.root else F.concat(F.lit(f"{os.path.relpath(path, self.root)}/"), F.col("path"))
            parts.append(own.withColumns({"root": F.lit(path), "path": seen}).select(*columns))
        hits = reduce(DataFrame.unionByName, parts)
        if len(parts) > 1:
            depth = F.first(F.when(F.col("root") == self.root, F.col("logic_depth")), True).over(Window.partitionBy("query_id"))
            hits = scopes.merged_hits(hits.withColumn("logic_depth", F.coalesce(depth, "logic_depth")), params.top_k)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        hits = materialise(hits.withColumn("rank", place), "hits")
        self._seq[client] = self._seq.get(client, 0) + 1
        self._sessions[client, self._seq[client]] = hits
        own = [k for k in self._sessions if k[0] == client]
        for old in own[:-SESSIONS]:
            release(self._sessions.pop(old))
        folded = fold.fold_forced(hits, level) if level is not None else fold.fold_budget(hits, max_tokens) if max_tokens else fold.fold(hits)
        return f"S{self._seq[client]}", folded.orderBy("rank")

    def read(self, session: str, indices: list[int], level: int = 3, client: str = "", direction: str = "both") -> DataFrame:
        """Hits of a session by place at a level of detail; 4 and more add the chunks before or after, or both."""
        hits = self._sessions[client, int(session[1:])].filter(F.col("rank").isin(*indices))
        shown = fold.fold_forced(hits, min(level, 3))
        if level < 4:
            return shown.orderBy("rank")
        stores = {r.root: None for r in hits.select("root").distinct().collect()}
        held = {path: store for path, store in self.members("merge") if path in stores}
        parts = []
        for path in stores:
            chunks = self._other(path, held.get(path, self.store.folder)).store.read("chunks")
            own = hits.filter(F.col("root") == path).select("id")
            # The hits' files only; a page has few.
            wanted = chunks.join(F.broadcast(own), "id", "left_semi").select("path").distinct()
            near = chunks.join(F.broadcast(wanted), "path", "left_semi")
            around = fold.neighbours(near.select("id", F.col("path").alias("file_id"), "start_line"), direction).select("id", "before_id", "after_id")
            for side in ("before", "after"):
                around = around.join(near.select(F.col("id").alias(f"{side}_id"), F.col("content").alias(side)), f"{side}_id", "left")
            parts.append(around.withColumn("root", F.lit(path)))
        return shown.join(reduce(DataFrame.unionByName, parts), ["root", "id"], "left").orderBy("rank")

    # looking

    def status(self) -> dict[str, Any]:
        """Counts and sizes of the index."""
        row = self.store.read("vectors").agg(F.count("vector").alias("vectors"), F.max(F.size("vector")).alias("dimensions")).first()
        width = row.dimensions if row.dimensions and row.dimensions > 0 else 0
        return {
            "root": self.root,
            "files": self.store.read("files").count(),
            "chunks": self.store.read("chunks").count(),
            "vectors": row.vectors,
            "dimensions": width,
            "memory_bytes": row.vectors * width * 4,
            "tags": self.store.read("tags").count(),
            "edges": self.store.read("edges").count(),
            "stored_bytes": self.store.bytes(),
        }

    def config(self, key: str | None = None) -> Any:
        own = {**self.settings, **asdict(self.params)}
        return own if key is None else own.get(key)

    def tag_inspect(self, name: str | None = None) -> DataFrame:
        known, edges = self.store.read("tags"), self.store.read("edges")
        return tags.list_tags(known, edges) if name is None else tags.inspect_tag(known, edges, name)

    def tree(self) -> list[dict[str, Any]]:
        """(path, depth, vectors, tags) of this root and all roots below it, by path; a root is an index of its own."""
        roots = [(self.root, self.store.folder)]
        if self.registry is not None:
            below = self.registry.read("roots").filter(F.col("path").startswith(f"{self.root}/")).orderBy("path").collect()
            roots += [(r.path, r.store) for r in below]
        out = []
        for path, folder in roots:
            store = Store(self.spark, folder)
            depth = sum(path.startswith(f"{other}/") for other, _ in roots)
            out.append({"path": path, "depth": depth, "vectors": store.read("vectors").count(), "tags": store.read("tags").count()})
        return out

    def folders(self, depth: int = 2) -> DataFrame:
        """(folder, files, chunks): the root's folders down to a depth, each with all that lies below it."""
        each = self.store.read("files").select("path").join(self.store.read("chunks").groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left")
        parts = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        return each.select(F.explode(folders).alias("folder"), "n").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))

    def check_model(self) -> str:
        """none, rebuild or warn: what the stored fingerprint says about the present embedder."""
        mark, width = models.fingerprint(self.embedder)
        row = self.store.read("model_meta").filter("is_active = 1").first()
        if row is None or row.fingerprint is None or row.fingerprint == mark:
            return "none"
        return "rebuild" if row.dimensions != width or self.settings["strategy"] == "rebuild" else "warn"

    def take(self, batch: DataFrame, number: int = 0) -> None:
        """One micro-batch (path, content) of a landing folder: null contents go, others come or change. Repeatable."""
        events = materialise(batch, "events")
        documents = events.filter("content is not null").select("path", "content", content_hash("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime"))
        indexed = self.store.read("files").join(events.select("path"), "path", "left_semi")
        diff = materialise(sync.changes(documents, indexed), "changes")
        self._apply(documents, diff)
        release(diff), release(events)


class Engines:
    """The latest few engines by root; the one unused for longest goes first."""

    def __init__(self, most: int = 3) -> None:
        self.most, self._held = most, OrderedDict()

    def get(self, root: str, make: Any) -> Engine:
        if root not in self._held:
            self._held[root] = make(root)
        self._held.move_to_end(root)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
        return self._held[root]
