"""The engine's interface: DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import cache, decide, detect, interact, model, session
from corvane.sources import files
from corvane.streaming import guard


class Engine:
    """Screens tables of texts with fixed settings."""

    def __init__(self, spark: SparkSession, settings: decide.Settings | None = None):
        self.spark, self.settings = spark, settings or decide.Settings()

    def analyze(self, texts: DataFrame) -> DataFrame:
        """One decision per row of ``text`` (and scan_target, policy_profile, workspace_id)."""
        return decide.analyze(texts, self.settings)

    def analyze_output(self, texts: DataFrame) -> DataFrame:
        return self.analyze(texts.withColumn("scan_target", F.lit("output")))

    def analyze_sessions(self, turns: DataFrame) -> DataFrame:
        """Decisions of ``session_id, turn, text`` in the light of their sessions."""
        return session.judge(self.analyze(turns), self.settings)

    def analyze_interaction(self, turns: DataFrame) -> DataFrame:
        return interact.analyze_interactions(turns, self.settings)

    def redact(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("redacted_text", detect.redact_secrets(detect.redact_pii(F.col("text"))))

    def analyze_documents(self, path: str) -> DataFrame:
        """Decisions on the texts of files, with how well they could be read."""
        return self.analyze(files.documents(self.spark, path).withColumn("scan_target", F.lit("input")))

    def analyze_with_model(self, texts: DataFrame, responders: dict[str, Callable[[str, str], str]], deadline: float = model.DEADLINE) -> DataFrame:
        """Decisions in which model-backed detectors ask their scorer, ``responders[detector](prompt, text) -> reply``,
        where the gate is open; its findings come before the patterns'. A scorer that takes longer than
        ``deadline`` seconds makes its detector unavailable for the text, which then isn't simply let pass."""
        replies = {name: cache.fresh(texts.columns, f"_reply{k}") for k, name in enumerate(responders)}
        settings = replace(self.settings, replies=replies)
        d = decide.screen_cheap(texts, settings)
        for name, responder in responders.items():
            d = model.ask(d, name, responder, replies[name], deadline)
        return decide.decide(decide.screen_models(d, settings), settings).drop(*replies.values())

    def analyze_with_memory(self, texts: DataFrame, threats: DataFrame, allowed: DataFrame, id_column: str = "vec_id") -> DataFrame:
        """Decisions on texts with embeddings: near a known safe one ALLOW, near a known threat that threat."""
        return self.analyze(cache.recalled(texts, threats, allowed, id_column))

    def stream_output(self, tokens: DataFrame) -> DataFrame:
        """Guards a stream of ``stream_id, seq, token, last``."""
        return guard.guard(tokens, self.settings)

    def screen_streams(self, tokens: DataFrame) -> DataFrame:
        """The same over finished streams: where each stops, and why."""
        return guard.screened(tokens, self.settings)

    def explain(self, decisions: DataFrame) -> DataFrame:
        return decide.explain(decisions)

    def report(self, decisions: DataFrame) -> DataFrame:
        """Adds ``report`` (JSON) and ``markdown`` to explained decisions."""
        d = decide.explain(decisions)
        return d.withColumns({"report": decide.report_json(d), "markdown": decide.report_markdown(d)})

    def score_with(self, texts: DataFrame, scorer) -> DataFrame:
        """Adds ``model_score`` of a scorer, ``str -> float``, where the gate is open; other rows get null and never reach it."""

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else scorer(t)).astype("float64")

        seen = decide.screen(texts, self.settings)
        return seen.withColumn("model_score", run(F.when(F.col("gate_open"), F.substring("text", 1, model.ASKED))))
