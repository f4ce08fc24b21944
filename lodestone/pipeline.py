"""The whole way: files or rows into the store and the index, queries to ranked and rendered results.

Everything works on batches of queries (query_id, text)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import providers as P
from lodestone.config import Config
from lodestone.operators import chunking as C
from lodestone.operators import cite, compress, crawl, evaluate, fusion
from lodestone.operators import dense as D
from lodestone.operators.cache import ResultCache
from lodestone.operators.index import SparseIndex
from lodestone.operators.sparse import top_k
from lodestone.sources import store as K

MODES = ("hybrid", "dense", "bm25")


class Engine:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embed: P.Embedder | None = None, score: P.Scorer | None = None, generate: P.Generator | None = None, cache: bool = False) -> None:
        """``cache``: keep embeddings by text in the folder, so that each text is embedded once."""
        self.spark, self.config = spark, config or Config()
        self.store = K.ChunkStore(spark, f"{folder}/chunks")
        self.index = SparseIndex(spark, f"{folder}/index", id_type="string")
        self.cache = ResultCache(spark, f"{folder}/embeddings", "array<float>") if cache else None
        self.embed, self.score, self.generate = embed or P.HashedWords(self.config.dimension), score or P.SharedWords(), generate or P.FirstSentences()

    # --- into the store

    def ingest(self, docs: DataFrame, id_col: str = "source_path", text_col: str = "content") -> dict:
        """Rows to chunks with vectors, upserted, and the index brought in line; what was done."""
        if self.config.hierarchical:
            rows = C.hierarchical(docs, id_col, text_col, self.config.chunk_size, self.config.chunk_overlap)
            parents, children = rows.where("doc_level = 'parent'"), rows.where("doc_level = 'child'")
            if self.config.embed_parents:
                children, parents = rows, None
        else:
            cut = C.chunks(docs, partial(C.fixed, size=self.config.chunk_size, overlap=self.config.chunk_overlap), id_col, text_col)
            place = {"chunk_index": F.col("chunk_index"), "source": F.col(id_col).cast("string")}
            children, parents = cut.withColumn("doc_id", K.content_id(F.col("content"), place)), None
        rows = P.embedded(children, self.embed, cache=self.cache)
        # one change of the store for both levels
        self.store.upsert(rows if parents is None else rows.unionByName(parents, allowMissingColumns=True))
        added, removed = self.sync()
        return {"chunks": self.store.count(), "indexed": added, "unindexed": removed}

    def ingest_files(self, paths: list[str]) -> dict:
        return self.ingest(K.read_files(self.spark, paths))

    def ingest_pages(self, pages: DataFrame, seeds: list[str], **options) -> dict:
        """Pages (url, html) reached from the seeds."""
        from lodestone.functions.text import html_text

        found = crawl.crawl(pages, seeds, **options)
        return self.ingest(found.select(F.col("url").alias("source_path"), html_text(F.col("html")).alias("content")))

    def _embedded(self) -> DataFrame:
        return self.store.chunks().where("embedding is not null")

    def sync(self) -> tuple[int, int]:
        return self.index.sync(self._embedded(), "doc_id", "content")

    def rebuild(self) -> int:
        return self.index.rebuild(self._embedded(), "doc_id", "content")

    def clear(self, confirm: bool = False) -> bool:
        if self.store.clear(confirm):
            self.index.clear()
        return confirm

    def stats(self) -> dict:
        return {"store": self.store.info(), "index": self.index.stats(), "healthy": self.store.healthy()}

    # --- out of it

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int | None = None, scope: str | None = None, language: str | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank, content, parent_id) by dense, bm25 or hybrid search, of one language if asked."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        c = self.config
        wanted = K.level_filter(scope or c.search_scope)
        rows = self._embedded().where(wanted if language is None else wanted & (F.col("language_code") == language))
        runs = []
        if mode != "bm25":
            asked = P.embedded(queries, self.embed, "text", cache=self.cache).select("query_id", "embedding")
            runs.append(D.dense(rows.select("doc_id", "embedding"), asked, c.dense_k, least=c.min_similarity))
        if mode != "dense":
            # what is out of scope goes before the cut to k
            runs.append(self.index.search(queries, c.sparse_k, within=rows.select("doc_id")))
        best = fusion.rrf(runs, k or c.fused_k, c.rrf_constant) if len(runs) > 1 else runs[0].where(F.col("rank") <= (k or c.fused_k))
        return best.join(rows.select("doc_id", "content", "parent_id"), "doc_id").select("query_id", "doc_id", "score", "rank", "content", "parent_id")

    def context(self, queries: DataFrame, mode: str = "hybrid") -> DataFrame:
        """search, children merged to parents, reranked and cut to the context's size."""
        c = self.config
        found = self.search(queries, mode)
        every = self.store.chunks().select("doc_id", "content")
        parents = every.select(F.col("doc_id").alias("parent_id"), F.length("content").alias("length"))
        merged = top_k(fusion.auto_merge(found, parents, c.merge_children), c.fused_k).join(every, "doc_id")
        best = P.reranked(queries, merged, self.score, c.rerank_k)
        rows = best.select("query_id", "doc_id", "score", "rank", "content")
        short = compress.compressed(rows, c.context_characters).select("query_id", "doc_id", "content", "key_facts")
        return rows.drop("content").join(short, ["query_id", "doc_id"])

    def query(self, queries: DataFrame, mode: str = "hybrid") -> DataFrame:
        """(query_id, answer, quality, sufficient, recommendation, bibliography)."""
        found = self.context(queries, mode)
        answers = P.generated(P.prompts(queries, found), self.generate)
        judged = evaluate.context_scores(queries, found)
        listed = cite.bibliography(cite.sources(found))
        out = answers.join(evaluate.retrieval_quality(found), "query_id", "left").join(judged, "query_id", "left").join(listed, "query_id", "left")
        return out.select("query_id", "answer", F.coalesce("quality", F.lit(0.0)).alias("quality"), "sufficient", "recommendation", "bibliography")
