"""The facade: index documents, retrieve for questions, answer them. All tables are kept below one folder, in versions, and can be read by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.config import Config
from skein.core import prepare, written
from skein.functions import providers
from skein.operators import chunking, graph, mentions, resolution, retrieval
from skein.plans import qa
from skein.sources.snapshots import Change, Snapshot, Snapshots
from skein.sources.store import Store, missing, uncached

TABLES = ("passages", "units", "passage_units", "mentions", "entities", "support", "incidence", "passage_entity", "idf", "passage_adjacency")
_UNITS = "schema_version int, passage_id string, pos int, su_id string, text string"


class _Texts:
    """A table of texts as the version in use has it."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    def read(self) -> DataFrame:
        return self.engine.snapshot().read(self.name, Store.schema)


class Engine:
    """An index in a folder. version: the one that is read (None: the newest at each call); index() always builds on the newest."""

    #: The column that keeps corpora apart, where an index has many (see corpora.Corpora).
    within: str | None = None

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, extractor: Callable[[DataFrame], DataFrame] = providers.salient_terms, embedder: Callable | None = None, reranker: Callable | None = None, version: int | None = None, count_tokens: Callable[[str], int] | None = None):
        prepare(spark)
        self.spark, self.config, self.extractor, self.version, self.count_tokens = spark, config or Config(), extractor, version, count_tokens
        self.snapshots = Snapshots(spark, folder)
        self.folder = self.snapshots.folder
        self.embed = embedder or providers.hashed_embedder(self.config.embed_dim)
        self.rerank = reranker or providers.overlap_score
        self.passages, self.units = _Texts(self, "passages"), _Texts(self, "units")
        #: What the last index() of this object changed: names, clusters made anew, clusters in all.
        self.changes: dict[str, int] = {}

    def snapshot(self) -> Snapshot:
        return self.snapshots.latest() if self.version is None else self.snapshots.at(self.version)

    def index(self, docs: DataFrame, text_col: str = "text") -> Snapshot:
        """Adds passages and commits a new version, in which all tables fit together; until then, and if it fails, readers see the one before.

        Only new passages are cut, only new units are read for mentions, and only the clusters that changed mentions touch are
        made anew. An extractor that counts over the whole corpus (`whole_corpus`, as the default one) reads all units each time.
        """
        c, change = self.config, self.snapshots.change()
        self._add(change, "passages", "passage-", docs, text_col)
        stored = change.read("passages", Store.schema).select(F.col("id").alias("passage_id"), "text")
        new = written(uncached(stored, change.read("cut_passages", "schema_version int, passage_id string"), schema.EXTRACTIONS_VERSION), "new")
        version = F.lit(schema.EXTRACTIONS_VERSION).alias("schema_version")
        cut = chunking.semantic_units(new, "passage_id", "text", c.unit_percentile, c.unit_min_words, c.unit_max_words, c.embed_dim)
        change.append("passage_units", cut.select(version, "passage_id", "pos", F.concat(F.lit("su-"), F.md5("text")).alias("su_id"), "text"))
        change.append("cut_passages", new.select(version, "passage_id"))  # those without units as well
        units = change.read("passage_units", _UNITS).where(F.col("schema_version") == schema.EXTRACTIONS_VERSION)
        self._add(change, "units", "su-", units)
        owners = units.groupBy("su_id").agg(F.max("passage_id").alias("passage_id"), F.first("text").alias("text")) if c.unit_passage == "last" else units.select("su_id", "passage_id", "text").distinct()
        found = written(self._extracted(change, owners), "mentions")
        change.replace("mentions", found)
        self.changes = resolution.update(change, found, c.merge_cosine, c.merge_name_similarity, dim=c.embed_dim)
        of = change.read("support")
        weights = written(graph.passage_weights(of), "weights")
        for name, df in {"incidence": graph.incidence(of), "passage_entity": weights, "idf": graph.idf(weights, stored.count()), "passage_adjacency": chunking.adjacency(stored)}.items():
            change.replace(name, df)
        return change.commit()

    def _add(self, change: Change, name: str, prefix: str, texts: DataFrame, text_col: str = "text") -> None:
        """Embeds and appends the texts that a table doesn't have."""
        new = missing(texts, change.read(name, Store.schema), prefix, text_col)
        change.append(name, new.select("id", "text", self.embed(F.col("text")).alias("embedding")))

    def _extracted(self, change: Change, owners: DataFrame) -> DataFrame:
        """The mention records of all units (su_id, passage_id, text); what an extractor said about a unit is kept and not asked again."""
        if getattr(self.extractor, "whole_corpus", False):
            return mentions.mention_records(self.extractor(owners))
        version = F.lit(schema.EXTRACTIONS_VERSION).alias("schema_version")
        asked = change.read("extracted_units", "schema_version int, su_id string").where(F.col("schema_version") == schema.EXTRACTIONS_VERSION)
        new = written(owners.join(asked.select("su_id"), "su_id", "left_anti"), "unread")
        kind = f"schema_version int, {providers.EXTRACTED}"
        if new.limit(1).count():
            change.append("extractions", self.extractor(new).select(version, *[x.split()[0] for x in providers.EXTRACTED.split(", ")]))
            change.append("extracted_units", new.select(version, "su_id"))
        kept = change.read("extractions", kind).where(F.col("schema_version") == schema.EXTRACTIONS_VERSION).drop("schema_version", "passage_id").distinct()
        return mentions.mention_records(kept.join(owners.select("su_id", "passage_id"), "su_id").select(*[x.split()[0] for x in providers.EXTRACTED.split(", ")]))

    def index_corpus(self, docs: DataFrame, text_col: str = "context") -> Snapshot:
        """Cuts whole texts into numbered passages (see Config.chunk_tokens) and indexes those."""
        c = self.config
        keyed = docs.select(F.md5(text_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
        chunks = chunking.chunk_corpus(keyed, "doc", "text", c.chunk_tokens, c.chunk_overlap, c.chunk_semantic, c.search_window, self.count_tokens)
        return self.index(chunks.select("text"))

    def _scoped(self, df: DataFrame, key: str) -> DataFrame:
        """A table with the corpus of its key, where there are many."""
        return df

    def _asked(self, questions: DataFrame) -> DataFrame:
        return questions.select("query_id", "question")

    def _mentioned(self, questions: DataFrame, nodes: DataFrame, given: DataFrame | None = None) -> DataFrame:
        """(query_id, ord, embedding) of the mentions of questions, with their corpus where there are many; by default the names of known entities."""
        m = mentions.query_mentions(mentions.known_names(questions, nodes, self.within)) if given is None else given
        m = m.select("query_id", "ord", self.embed(F.col("embedding_text")).alias("embedding"))
        if self.within is not None:
            m = m.join(questions.select("query_id", self.within), "query_id")
        return written(m, "query-mentions")

    def table(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def register_views(self, prefix: str = "") -> None:
        """Views of one version's tables."""
        now = self.snapshot()
        for name in TABLES:
            now.read(name).createOrReplaceTempView(prefix + name)

    def retrieve(self, questions: DataFrame, query_mentions: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, passage_id, score) of questions (query_id, question), from one version of the index. Mentions default to the known entities' names in a question, of any number of words."""
        now = self.snapshot()
        q = written(self._asked(questions).withColumn("embedding", self.embed(F.concat(F.lit(self.config.question_prefix), F.coalesce("question", F.lit(""))))), "questions")
        nodes = self._scoped(now.read("entities"), "entity_id")
        m = self._mentioned(q, nodes, query_mentions)
        passages = self._scoped(now.read("passages").select(F.col("id").alias("passage_id"), "text", "embedding"), "passage_id")
        units = self._scoped(now.read("units").select(F.col("id").alias("su_id"), "embedding"), "su_id")
        got = retrieval.retrieve(q, m, nodes, now.read("incidence"), units, now.read("passage_entity"), now.read("idf"), passages, self.config, within=self.within)
        if self.config.rerank:
            texts = got.join(passages.select("passage_id", "text"), "passage_id").join(q.select("query_id", "question"), "query_id")
            got = retrieval.rerank(texts, self.rerank(F.col("question"), F.col("text")), self.config.top_k).select("query_id", "rank", "passage_id", "score")
        return got

    def seeds(self, questions: DataFrame) -> DataFrame:
        """(query_id, ord, entity_id, score, canonical_name, entity_type): what a question's mentions are linked to."""
        q, nodes = self._asked(questions), self._scoped(self.table("entities"), "entity_id")
        return retrieval.seed_metadata(retrieval.seed_entities(self._mentioned(q, nodes), nodes, within=self.within), nodes)

    def rag_qa(self, questions: DataFrame, reader=providers.extractive_answer, query_mentions: DataFrame | None = None) -> DataFrame:
        """Answers with the passages read. reader: a column of prompts to a column of responses, as providers.chat_provider gives."""
        passages = self.passages.read().select(F.col("id").alias("passage_id"), "text")
        return qa.answers(qa.prompts(self.retrieve(questions, query_mentions), passages, questions), reader)
