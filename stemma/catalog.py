"""The stored catalog with one method per tool.

Every method returns a DataFrame. Where the tool takes one id, question or text,
the method also takes a DataFrame of many; a single value is a batch of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import sql_rules as R
from stemma.functions.text import strip
from stemma.operators import catalog as C
from stemma.operators import graph as G
from stemma.operators import search as V
from stemma.operators import sql_texts as Q
from stemma.operators.refresh import refresh_catalog
from stemma.schemas import ASSETS, EDGES
from stemma.sources import snapshots as SN


def _names(allowed: Sequence[str]) -> Column:
    return F.array(*[F.lit(a) for a in allowed]).cast("array<string>")


class Catalog:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store

    @property
    def assets(self) -> DataFrame:
        return SN.load_snapshot(self.spark, self.store, "assets", ASSETS)

    @property
    def edges(self) -> DataFrame:
        return SN.load_snapshot(self.spark, self.store, "edges", EDGES)

    @property
    def vectors(self) -> DataFrame:
        return SN.load_vector_collection(self.spark, self.store)

    def _batch(self, value: str | DataFrame, column: str) -> DataFrame:
        if isinstance(value, DataFrame):
            return value
        return self.spark.createDataFrame([(value if column == "sql" else value.strip(),)], f"{column} string")

    def _graph(self, *ids: str | DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and assets; for ids given as values only the part around them."""
        if any(isinstance(i, DataFrame) for i in ids):
            return self.edges, self.assets
        return G.around([i.strip() for i in ids], self.edges, self.assets)

    def refresh(self, documents: DataFrame) -> DataFrame:
        return refresh_catalog(documents, self.store)

    # ---- search ----------------------------------------------------------------

    def search_data_assets(self, query: str | DataFrame, top_k: int = 5) -> DataFrame:
        """Hits per question; a DataFrame of questions has query_id and text."""
        questions = self._questions(query)
        return V.stored_hits(questions, self.vectors, top_k)

    def search_similar_queries(self, query: str | DataFrame, top_k: int = 3) -> DataFrame:
        return self.search_data_assets(query, top_k)

    def search_by_table(self, table: str | DataFrame) -> DataFrame:
        return G.search_by_table(self._batch(table, "asset_id"), *self._graph(table))

    def search_by_owner(self, owner: str) -> DataFrame:
        return C.search_by_owner(self.assets, owner)

    # ---- lineage and impact ----------------------------------------------------

    def get_lineage(self, asset: str | DataFrame, direction: str = "both") -> DataFrame:
        requests = self._batch(asset, "asset_id")
        if "direction" not in requests.columns:
            requests = requests.withColumn("direction", F.lit(direction))
        return G.asset_lineage(requests, *self._graph(asset))

    def analyze_data_usage(self, asset: str | DataFrame) -> DataFrame:
        return G.data_usage(self._batch(asset, "asset_id"), *self._graph(asset))

    def usage_items(self, asset: str | DataFrame) -> DataFrame:
        ids = self._batch(asset, "asset_id").select("asset_id").distinct()
        return G.usage_items(*self._graph(asset)).join(ids, "asset_id", "left_semi")

    def assess_change_impact(self, asset: str | DataFrame, change: str = "") -> DataFrame:
        """A DataFrame of changes has request_id, field_asset and change_text."""
        if not isinstance(asset, DataFrame):
            asset = self.spark.createDataFrame(
                [(0, asset, change)], "request_id long, field_asset string, change_text string"
            )
        return G.change_impact(asset, self.edges, self.assets)

    def affected_assets(self, asset: str | DataFrame, change: str = "") -> DataFrame:
        """The assets behind the counts of ``assess_change_impact``, once per change target."""
        if not isinstance(asset, DataFrame):
            asset = self.spark.createDataFrame(
                [(0, asset, change)], "request_id long, field_asset string, change_text string"
            )
        return G.affected_assets(asset, self.edges, self.assets)

    def compare_data_assets(self, asset1: str | DataFrame, asset2: str = "") -> DataFrame:
        """A DataFrame of pairs has asset1 and asset2."""
        pairs, graph = asset1, self._graph(asset1, asset2)
        if not isinstance(pairs, DataFrame):
            pairs = self.spark.createDataFrame([(asset1, asset2)], "asset1 string, asset2 string")
        return G.compare_assets(pairs, *graph)

    def persist_scores(self) -> None:
        """Store the resolved score of every asset whose score rises."""
        risen = G.resolve_impact_scores(self.edges, self.assets).select("asset_id", "score")
        scored = self.assets.join(risen, "asset_id", "left").withColumn("impact_score", F.col("score"))
        SN.save_snapshot(scored.select(*ASSETS.fieldNames()), self.store, "assets")

    # ---- SQL -------------------------------------------------------------------

    def generate_query(self, description: str | DataFrame, top_k: int = 5) -> DataFrame:
        """Chat messages per question; the model's replies go to ``query_results``."""
        questions = self._questions(description)
        hits = V.stored_hits(questions, self.vectors, top_k)
        return V.question_prompts(V.context_of_hits(questions, hits))

    def query_results(self, replies: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
        """Checked results of model replies (column ``reply``); ``allowed`` tables, none for no check."""
        listed = replies.withColumn("_allowed", _names(allowed))
        return Q.reply_results(listed, allowed="_allowed").drop("_allowed")

    def validate_query(self, sql: str | DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
        listed = self._batch(sql, "sql").withColumn("_allowed", _names(allowed))
        checked = Q.validate_sql_texts(listed, allowed="_allowed").drop("_allowed")
        result = R.validation_result(F.when(~F.col("valid"), F.col("reason")))
        return checked.withColumn("_r", result).drop("valid", "reason").select("*", "_r.*").drop("_r")

    def explain_query(self, sql: str | DataFrame) -> DataFrame:
        return self._batch(sql, "sql").withColumn("explanation", R.explain_query(F.col("sql")))

    def suggest_optimizations(self, sql: str | DataFrame) -> DataFrame:
        return self._batch(sql, "sql").withColumn("suggestions", R.suggest_optimizations(F.col("sql")))

    # ---- browsing --------------------------------------------------------------

    def get_catalog_summary(self) -> DataFrame:
        return C.catalog_summary(self.assets)

    def list_tables(self, pattern: str | None = None) -> DataFrame:
        return C.list_tables(self.assets, pattern)

    def list_reports(self, owner: str | None = None) -> DataFrame:
        return C.list_reports(self.assets, owner)

    def list_etl_processes(self) -> DataFrame:
        return C.list_etl_processes(self.assets)

    def get_asset_details(self, asset: str | DataFrame) -> DataFrame:
        return G.asset_details(self._batch(asset, "asset_id"), *self._graph(asset))

    def _questions(self, query: str | DataFrame) -> DataFrame:
        if isinstance(query, DataFrame):
            return query
        one = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        return one.withColumn("text", strip(F.col("text")))
