"""An index of many corpora in one: each is apart from the others, and all are made and asked in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.core import join_checked, prepare, written
from skein.engine import Engine
from skein.functions import scope
from skein.functions import text as X
from skein.operators import chunking, entities, graph, mentions
from skein.operators.components import connected_components
from skein.sources.snapshots import Change, Snapshot
from skein.sources.store import Store

#: The column by which each table that depends on a whole corpus is kept apart.
_KEYS = {"mentions": "passage_id", "entities": "entity_id", "support": "passage_id", "incidence": "su_id", "passage_entity": "passage_id", "idf": "entity_id", "passage_adjacency": "src"}
_OWN = "corpus"


class Corpora(Engine):
    """An Engine whose documents and questions name their corpus (corpus_name). The rows are those of an index for each.

    All ids are keys that begin with the corpus (functions.scope), so that joins and groups by them stay within it; what has no
    such key, as the vector search, the band of terms, the links of names and idf, takes the corpus beside. index() makes those
    corpora anew that got passages, all in one plan; the rows of the others are copied. A corpus may be as large as the table: no
    step deals by corpus. A null corpus is the one with the empty name.
    """

    within = _OWN

    def index(self, docs: DataFrame, text_col: str = "text", corpus_col: str = "corpus_name") -> Snapshot:
        """Adds passages and commits a new version, as Engine.index does; where no passage is new, the version stays."""
        prepare(self.spark)
        c, change = self.config, self.snapshots.change()
        rows = docs.where(F.col(text_col).isNotNull()).select(scope.scoped(F.col(corpus_col), X.content_id("passage-", F.col(text_col))).alias("id"), F.col(text_col).alias("text"))
        new = written(rows.dropDuplicates(["id"]).join(change.read("passages", Store.schema).select("id"), "id", "left_anti"), "new")
        if change.has("passages") and not new.limit(1).count():
            return self.snapshots.latest()
        touched = written(new.select(scope.prefix(F.col("id")).alias("touched")).distinct(), "touched")
        change.append("passages", new.select("id", "text", self.embed(F.col("text")).alias("embedding")))
        cut = chunking.semantic_units(new.select(F.col("id").alias("passage_id"), "text"), "passage_id", "text", c.unit_percentile, c.unit_min_words, c.unit_max_words, c.embed_dim)
        cut = cut.select("passage_id", "pos", scope.beside(F.col("passage_id"), X.content_id("su-", F.col("text"))).alias("su_id"), "text")
        change.append("passage_units", cut)
        units = self._of(change.read("passage_units"), "passage_id", touched)
        fresh = units.select(F.col("su_id").alias("id"), "text").dropDuplicates(["id"]).join(change.read("units", Store.schema).select("id"), "id", "left_anti")
        change.append("units", fresh.select("id", "text", self.embed(F.col("text")).alias("embedding")))
        owners = units.groupBy("su_id").agg(F.max("passage_id").alias("passage_id"), F.first("text").alias("text")) if c.unit_passage == "last" else units.select("su_id", "passage_id", "text").distinct()
        found = written(self._extracted(change, owners), "mentions")
        nodes, support = self._resolved(found)
        weights = written(graph.passage_weights(support), "weights")
        passages = self._of(change.read("passages"), "id", touched).select(F.col("id").alias("passage_id"), "text")
        adjacency = chunking.adjacency(passages.withColumn(_OWN, scope.prefix(F.col("passage_id"))), within=[_OWN]).drop(_OWN)
        made = {"mentions": found, "entities": nodes, "support": support, "incidence": graph.incidence(support), "passage_entity": weights, "idf": graph.idf_within(weights, passages), "passage_adjacency": adjacency}
        for name, df in made.items():
            kept = self._of(change.read(name), _KEYS[name], touched, "left_anti").unionByName(df) if change.has(name) else df
            change.replace(name, kept)
        return change.commit()

    def _of(self, df: DataFrame, key: str, touched: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows of the corpora that got passages, or of the others."""
        return join_checked(df, touched, scope.prefix(F.col(key)) == F.col("touched"), how)

    def _extracted(self, change: Change, owners: DataFrame) -> DataFrame:
        """As in Engine; an extractor that reads whole corpora is told by `within` which unit is of which. mention_id is that of an index of its own."""
        whole = getattr(self.extractor, "whole_corpus", False)
        found = mentions.mention_records(self.extractor(owners, within=scope.prefix)) if whole else super()._extracted(change, owners)
        parts = [scope.bare(F.col("passage_id")), scope.bare(F.col("su_id")), *map(F.col, ("normalized_name", "char_start", "char_end"))]
        return found.withColumn("mention_id", X.mention_id(*parts))

    def _resolved(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entities, support): names are linked within a corpus, and an entity of two corpora is two."""
        c = self.config
        m = entities.normalised(found)
        m = written(m.withColumn("name_key", scope.beside(F.col("passage_id"), F.col("normalized_name"))), "mentions")
        vectors = written(entities.name_vectors(m, c.embed_dim, "name_key"), "clusters")
        links = written(entities.name_links(vectors, max(c.merge_cosine, 0.90), c.merge_name_similarity, many=True), "links")
        nodes, support = entities.canonical(m, connected_components(links), c.embed_dim, "name_key")
        key = scope.beside(F.col("cluster"), F.col("entity_id"))
        return nodes.withColumn("entity_id", key), support.withColumn("entity_id", key)

    def index_corpus(self, docs: DataFrame, text_col: str = "context", corpus_col: str = "corpus_name") -> Snapshot:
        """Cuts the whole texts of all corpora into numbered passages and indexes those."""
        c = self.config
        keyed = docs.where(F.col(text_col).isNotNull()).select(scope.scoped(F.col(corpus_col), F.md5(text_col)).alias("doc"), F.col(text_col).alias("text"))
        chunks = chunking.chunk_corpus(keyed, "doc", "text", c.chunk_tokens, c.chunk_overlap, c.chunk_semantic, c.search_window, self.count_tokens)
        return self.index(chunks.select(scope.corpus_of(F.col("doc")).alias("corpus_name"), "text"))

    def _scoped(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn(_OWN, scope.prefix(F.col(key)))

    def _asked(self, questions: DataFrame) -> DataFrame:
        return questions.select("query_id", "question", scope.named(F.col("corpus_name")).alias(_OWN))
