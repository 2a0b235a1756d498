"""Query classification, strategies, contexts, budgets, judging and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as T

#: Indicators of the four query types, in the order in which they are tried.
QUERY_TYPES = (
    ("temporal", "when|before|after|during|history|changed|used to|previously|was|were|in 2|in 1|timeline|evolution|over time".split("|")),
    ("global", "summarize|overview|main topics|all |everything|what are the|list all|theme|how many".split("|")),
    ("multihop", "connected|related|relationship between|path|how does|influence|impact|through".split("|")),
)
#: Indicators of the eight intents and what each counts.
INTENTS = (
    ("temporal", 1.0, "when|what year|what month|timeline|history|before|after|during|since|until|between|date|time|recent|latest|earliest|first|last|in 2|in 1|happened".split("|")),
    ("causal", 1.0, "why|cause|because|reason|led to|result|effect|consequence|impact|due to|how did|what caused|root cause".split("|")),
    ("hypothetical", 1.5, "what if|what would|hypothetically|had not|hadn't|without|suppose|imagine|could have|counterfactual".split("|")),
    ("comparative", 1.0, "compare|versus|vs|difference|differ|similar|contrast|better|worse|advantage|between|compared to".split("|")),
    ("aggregative", 1.0, "how many|how much|count|total|number of|average|most|least|percentage|all|list all|every".split("|")),
    ("multihop", 1.2, "who does|through|chain|connected to|relationship between|path from|report to|boss of|manager of|leads to|via".split("|")),
    ("exploratory", 0.8, "tell me about|explain|describe|overview|what is|who is|summarize|introduction".split("|")),
)
FACTUAL = "who what where which name is are does do".split()
ORDER = ("factual", "temporal", "causal", "hypothetical", "comparative", "aggregative", "multihop", "exploratory")
#: Phrases of the chat intents, in the order in which they are tried.
CHAT = (
    ("explain", "what is|what are|explain|define|describe|tell me about|how does|how do"), ("explore", "connected to|related to|neighbors of|links from|expand|show connections"),
    ("temporal_compare", "changed|evolved|differ|before and after|over time|progression|trend"), ("time_travel", "as of|at time|back in|in 2|snapshot|point in time|version from"),
    ("find_contradictions", "contradict|conflict|inconsisten|disagree|opposing|wrong"), ("summarize", "summarize|summary|overview|recap|tldr|key points|main ideas"),
    ("search", "find|search|look up|locate|where is|which paper|who|list all"), ("trace_relationship", "path between|connection between|how is .* related to|trace|link between|chain from"),
    ("discover_themes", "themes|clusters|communities|topics|group|categories|patterns"), ("filter_graph", "filter|show only|hide|focus on|narrow|just show|remove"),
)
#: Tools that a chat intent runs.
TOOLS = {
    "explain": ("rag_retrieve", "entity_lookup"), "explore": ("entity_lookup", "expand_neighborhood"), "temporal_compare": ("temporal_diff",), "time_travel": ("snapshot",), "find_contradictions": ("conflict_scan",),
    "summarize": ("rag_retrieve", "summaries"), "search": ("search_entities",), "trace_relationship": ("shortest_path",), "discover_themes": ("communities",), "filter_graph": ("filter",), "general": ("rag_retrieve",),
}


def query_type(query: Column) -> Column:
    low = F.lower(query)
    out = F.when(F.lit(False), F.lit(""))
    for name, words in QUERY_TYPES:
        out = out.when(T.contains_any(low, words), F.lit(name))
    return out.otherwise("local")


def intent_scores(query: Column) -> dict[str, Column]:
    low = F.lower(query)
    found = {name: T.count_contained(low, words) * weight for name, weight, words in INTENTS}
    factual = F.lit(0.0)
    for w in FACTUAL:
        factual = factual + F.when(low.startswith(w) | low.contains(f" {w} "), 0.5).otherwise(0.0)
    found["factual"] = factual
    top = F.greatest(*[found[n] for n in ORDER])
    found["exploratory"] = found["exploratory"] + F.when(top < 0.5, 1.0).otherwise(0.0)
    return found


def intent(query: Column) -> Column:
    """The intent with the highest score, of equal ones the first in ORDER."""
    s = intent_scores(query)
    top = F.greatest(*[s[n] for n in ORDER])
    out = F.when(F.lit(False), F.lit(""))
    for n in ORDER:
        out = out.when(s[n] == top, F.lit(n))
    return out


def chat_intent(message: Column) -> Column:
    low = F.lower(message)
    out = F.when(F.lit(False), F.lit(""))
    for name, words in CHAT:
        out = out.when(T.contains_any(low, words.split("|")), F.lit(name))
    return out.when(low.contains("?"), "explain").otherwise("general")


def plan_tools(message: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in TOOLS.items() for x in (F.lit(k), F.lit(",".join(v)))]), chat_intent(message))


def running_cost(df: DataFrame, group: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """df with spent (whole micro-dollars so far, in the group) and over_budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(F.floor(F.col(cost) * 1e6).cast("bigint")).over(w)).withColumn("over_budget", F.col("spent") > F.lit(int(budget * 1e6)))


def context_budget(df: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """The prefix of each group's rows that fits the budget, with the running total as used."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(F.col(tokens).cast("bigint")).over(w)).where(F.col("used") <= budget)


def judge(predicted: Column, truth: Column) -> Column:
    """Right if either holds the other, without case; an empty truth wants an abstention."""
    p, t = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
    silent = T.contains_any(p, ["don't know", "do not know", "not enough information", "no information", "cannot answer", "unknown"])
    return F.when(t == "", silent).when(p == "", False).otherwise(p.contains(t) | t.contains(p))


def eval_report(results: DataFrame) -> DataFrame:
    """question_type (null: all), n, accuracy, mean_latency of results (question_type, correct, latency)."""
    return results.rollup("question_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("latency").alias("mean_latency"))


@dataclass(frozen=True)
class Ablation:
    """Which parts a configuration leaves on."""

    name: str
    vector: bool = True
    keyword: bool = True
    graph: bool = True
    rerank: bool = True
    temporal: bool = True
    memory: bool = True
    multigraph: bool = True
    community: bool = True


ABLATIONS = (
    Ablation("full"), Ablation("no_vector", vector=False), Ablation("no_keyword", keyword=False), Ablation("no_graph", graph=False), Ablation("no_rerank", rerank=False),
    Ablation("no_temporal", temporal=False), Ablation("no_memory", memory=False), Ablation("no_multigraph", multigraph=False), Ablation("no_community", community=False),
)


def assemble_context(entities: DataFrame, facts: DataFrame, communities: DataFrame, budget: int) -> DataFrame:
    """line_no, line: sections of entities, facts (current or historical) and communities until the budget is full.

    Inputs are the bounded answers of a search: entities (name, summary), facts (fact, current), communities (summary).
    """
    part = lambda df, n, line: df.select(F.lit(n).alias("section"), line.alias("line"))
    rows = part(entities, 1, F.concat("name", F.lit(": "), F.coalesce("summary", F.lit(""))))
    rows = rows.unionByName(part(facts, 2, F.concat(F.when(F.col("current"), F.lit("current: ")).otherwise(F.lit("historical: ")), F.col("fact"))))
    rows = rows.unionByName(part(communities, 3, F.col("summary")))
    w = Window.orderBy("section", "line")
    used = rows.withColumn("tokens", T.estimate_tokens(F.col("line"))).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where(F.col("used") <= budget).select(F.row_number().over(w).alias("line_no"), "line")
