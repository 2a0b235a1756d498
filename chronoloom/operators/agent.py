"""Channels and steps of an agent: traversal hits, lookups, connections, prompts, tool runs, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import graph as G
from chronoloom.operators import retrieval as R
from chronoloom.operators import routing as Q


def traversal_hits(edges: DataFrame, seed: str, depth: int, k: int) -> DataFrame:
    """id, score: what lies around a seed by (depth, id), scored 1 / (1 + 0.3 place); the seed is left out."""
    found = G.hop_distances(edges, seed, depth).where(F.col("distance") > 0).orderBy("distance", "id").limit(k)
    place = F.row_number().over(Window.orderBy("distance", "id")) - 1  # over the k hits
    return found.select("id", (1.0 / (1.0 + 0.3 * place)).alias("score"))


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    """The best hit for a name."""
    return R.keyword_search(entities, name, 1)


def find_connections(edges: DataFrame, a: str, b: str, depth: int = 4) -> DataFrame:
    """id, hops of all that lies on a path from a to b of at most ``depth`` edges: reached from both ends."""
    one, two = G.hop_distances(edges, a, depth), G.hop_distances(edges, b, depth).withColumnRenamed("distance", "other")
    return one.join(two, "id").where(F.col("distance") + F.col("other") <= depth).select("id", (F.col("distance") + F.col("other")).alias("hops"))


def prompt(question: str, context: list[str], history: list[tuple[str, str]], system: str = "Answer from the context.", turns: int = 5) -> list[dict]:
    """Messages for a language model: system, the last turns, the question with its context."""
    last = [{"role": r, "content": c} for r, c in history[-turns:]]
    return [{"role": "system", "content": system}, *last, {"role": "user", "content": "\n".join(["Context:", *context, "", f"Question: {question}"])}]


def save_history(spark: SparkSession, turns: list[tuple[str, str]], path: str) -> None:
    """A conversation as JSON lines with its order."""
    spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(turns)], "turn int, role string, content string").coalesce(1).write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(r["role"], r["content"]) for r in spark.read.schema("turn int, role string, content string").json(path).orderBy("turn").collect()]


def run_tool(engine, tool: str, question: str, k: int = 10) -> DataFrame:
    """One tool of a plan over the engine's frames."""
    if tool in ("rag_retrieve", "search_entities", "entity_lookup"):
        return engine.search(question, k)
    if tool == "communities":
        return engine.communities()
    if tool == "conflict_scan":
        from chronoloom.operators.ingest import detect_conflicts

        valid = engine.relationships.where("valid_until IS NULL AND expired_at IS NULL")
        return detect_conflicts(valid, valid).where("conflict = 'contradiction' AND new_id > old_id")
    if tool == "summaries":
        return G.summaries(engine.communities().where("level = 0").select("id", "community"), engine.entities)
    raise ValueError(f"no such tool: {tool}")


def process(engine, message: str, k: int = 10) -> tuple[str, dict[str, DataFrame]]:
    """The intent of a message and the results of the tools its plan names, as far as they need no more arguments."""
    intent, tools = engine.spark.range(1).select(Q.chat_intent(F.lit(message)), Q.plan_tools(F.lit(message))).first()
    known = {"rag_retrieve", "search_entities", "entity_lookup", "communities", "conflict_scan", "summaries"}
    return intent, {t: run_tool(engine, t, message, k) for t in tools.split(",") if t in known}


def evaluate(answers: DataFrame) -> DataFrame:
    """Report over answers (question_type, predicted, truth, latency)."""
    return Q.eval_report(answers.select("question_type", Q.judge(F.col("predicted"), F.col("truth")).alias("correct"), "latency"))
