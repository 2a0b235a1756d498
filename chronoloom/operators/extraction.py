"""Entities, relations, causes, concepts, sections and profiles out of text and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text as T

#: Relation patterns (name, pattern); the first match of each counts.
RELATIONS = (
    ("WORKS_AT", r"(.+?)\s+(?:works at|works for|employed by|joined)\s+(.+)"), ("FOUNDED", r"(.+?)\s+(?:founded|co-founded|started|created)\s+(.+)"), ("LOCATED_IN", r"(.+?)\s+(?:is located in|based in|headquartered in)\s+(.+)"),
    ("ACQUIRED", r"(.+?)\s+(?:acquired|bought|merged with)\s+(.+)"), ("IS_A", r"(.+?)\s+(?:is a|is an|serves as)\s+(.+)"), ("COLLABORATES_WITH", r"(.+?)\s+(?:collaborates with|partners with|works with)\s+(.+)"),
)
#: Causal patterns (name, pattern, confidence, whether the cause stands first).
CAUSES = (
    ("caused", r"(.+?)\s+(?:caused|led to|resulted in|triggered)\s+(.+)", 0.8), ("because", r"(?:because|since|due to)\s+(.+?),\s*(.+)", 0.7), ("therefore", r"(.+?)\s+(?:therefore|thus|consequently|hence)\s+(.+)", 0.75),
    ("if", r"if\s+(.+?)\s+then\s+(.+)", 0.6), ("enabled", r"(.+?)\s+(?:enabled|allowed|made possible)\s+(.+)", 0.7),
)
#: Patterns of named entities (type, pattern, confidence), earlier ones first.
ENTITY_PATTERNS = (
    ("Person", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", 0.7),
    ("Organization", r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\s+(?:Inc|Corp|LLC|Ltd|Labs|AI|Research|Foundation|Institute|University|Company)\b", 0.8),
    ("Organization", r"\b(Google|Microsoft|Apple|Amazon|Meta|Anthropic|OpenAI|DeepMind|Tesla|Netflix|Uber|Stripe|Databricks|Snowflake|Cohere|Mistral|Stability)\b", 0.95),
    ("Location", r"\b(New York|San Francisco|London|Tokyo|Berlin|Paris|Seattle|Austin|Boston|Silicon Valley|Bay Area|Palo Alto|Mountain View)\b", 0.9),
    ("Date", r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,?\s+\d{4})?)\b", 0.85),
    ("Technology", r"\b(GPT-\d+|Claude|Gemini|Llama|BERT|Transformer|Kubernetes|Docker|React|Rust|Python|TypeScript|GraphRAG|Neo4j)\b", 0.9),
)
#: Endings of technical words, and words that are no concepts.
TECHNICAL = ("tion", "sion", "ment", "ence", "ance", "ity", "ism", "ous", "ive", "ical", "graph", "net", "former")
NO_CONCEPTS = (
    "abstract", "introduction", "conclusion", "references", "acknowledgements", "appendix", "the", "and", "for", "with", "this", "that", "from", "which", "their", "these", "those",
    "been", "have", "will", "would", "could", "should", "also", "such",
)
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "et al.", "i.e.", "e.g.", "Fig.", "vs.")


def relation_pairs(text: Column) -> Column:
    """array<struct<source, relation, target>>: the first match of each pattern."""
    parts = [F.when(text.rlike(f"(?i){p}"), F.struct(F.trim(F.regexp_extract(text, f"(?i){p}", 1)).alias("source"), F.lit(n).alias("relation"), F.trim(F.regexp_extract(text, f"(?i){p}", 2)).alias("target"))) for n, p in RELATIONS]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def causal_pairs(text: Column) -> Column:
    """array<struct<cause, effect, kind, confidence>>."""
    parts = [F.when(text.rlike(f"(?i){p}"), F.struct(F.trim(F.regexp_extract(text, f"(?i){p}", 1)).alias("cause"), F.trim(F.regexp_extract(text, f"(?i){p}", 2)).alias("effect"), F.lit(n).alias("kind"), F.lit(c).alias("confidence"))) for n, p, c in CAUSES]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def concepts(text: Column) -> Column:
    """Capitalised phrases, acronyms of two to six letters and technical words of six letters or more, distinct
    without case, but for NO_CONCEPTS.  Letters of all scripts count where a word ends."""
    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
    kinds = (r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", r"[A-Z]{2,6}", f"(?i:[a-z]{{3,}}(?:{'|'.join(TECHNICAL)}))")
    found = [F.regexp_extract_all(text, F.lit(rf"(?<!{word})({k})(?!{word})"), 1) for k in kinds]
    return F.array_except(F.transform(F.concat(*found), F.lower), T.array_of(NO_CONCEPTS))


def window_chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """key, chunk, start, piece: fixed windows over the text with single blanks (characters; bytes of ASCII)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    step = size - overlap
    rows = df.where(F.col(text).isNotNull()).select(key, flat.alias("_t")).where("_t != ''")
    at = F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)), F.lit(step))
    return rows.select(key, F.posexplode(at).alias("chunk", "start"), "_t").select(key, "chunk", "start", F.expr(f"substring(_t, start, {size})").alias("piece"))


def profile(text: Column) -> dict[str, Column]:
    """Whether text can be extracted, mean bytes a line, academic score and the parse strategy."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    mean = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.octet_length(x)) / F.greatest(F.size(lines), F.lit(1))
    low = F.lower(text)
    academic = T.count_contained(low, ["abstract", "introduction", "references", "conclusion", "method", "results", "et al"])
    tables = F.size(F.filter(lines, lambda x: (F.size(F.split(x, r"\|")) > 3) | (F.size(F.split(x, r"\t")) > 3)))
    math_ = text.rlike(r"[∑∫√≤≥±∂]|\\frac|\\sum|\$[^$]+\$")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]")))
    columns = F.when((mean < 50) & (F.size(lines) > 20), 2).otherwise(1)
    return {
        "extractable": F.octet_length(text) > 100, "mean_line": mean, "academic": academic, "tables": tables, "math": math_, "sections": numbered, "columns": columns,
        "strategy": F.when((columns > 1) | math_ | (tables > 0), "structured").otherwise("fast"),
    }


def split_sentences(text: str) -> list[str]:
    """Sentences end at . ! ? once over ten bytes are gathered, but not after an abbreviation."""
    out, buffer = [], ""
    for c in text:
        buffer += c
        if c in ".!?" and len(buffer.encode()) > 10 and not buffer.rstrip().endswith(ABBREVIATIONS):
            if buffer.strip():
                out.append(buffer.strip())
            buffer = ""
    return out + ([buffer.strip()] if buffer.strip() else [])


def recognise(text: str) -> list[tuple[str, str, int, int, float]]:
    """name, type, start, stop, confidence; spans that overlap an earlier pattern's are left out."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern, confidence in ENTITY_PATTERNS:
        for m in re.finditer(pattern, text):
            a, b = m.span(1)
            if any(c <= a < d or c < b <= d for c, d in taken):
                continue
            taken.append((a, b))
            out.append((m[1], kind, a, b, confidence))
    return sorted(out, key=lambda x: x[2])


def walk_json(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Entities (name, type) and edges (source, relation, target) of a JSON text; broken JSON gives none."""
    try:
        root = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return [], []
    entities, edges = [], []
    stack = [(root, None)]
    while stack:
        value, parent = stack.pop()
        if isinstance(value, list):
            stack += [(v, parent) for v in reversed(value)]
        elif isinstance(value, dict):
            name = value.get("name") if isinstance(value.get("name"), str) else None
            if name:
                entities.append((name, next((value[k] for k in ("type", "entity_type", "category") if isinstance(value.get(k), str)), "Entity")))
                if parent:
                    edges.append((parent, "HAS_MEMBER", name))
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    stack.append((v, name or parent))
                elif isinstance(v, str) and name and k not in ("name", "type", "entity_type", "category", "summary", "description", "bio", "id") and v[:1].isupper() and len(v.encode()) < 100 and "\n" not in v:
                    entities.append((v, "Entity"))
                    edges.append((name, k.upper(), v))
    return list(dict.fromkeys(entities)), list(dict.fromkeys(edges))


def extract_entities(df: DataFrame, key: str, text: str, limit_bytes: int = 100_000) -> DataFrame:
    """key, name, entity_type, start, stop, confidence, error: named entities of each text.

    Empty texts give nothing; texts over ``limit_bytes`` give one row with error 'input too large'.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["k"], frame["t"]):
                if not t or not t.strip():
                    continue
                if len(t.encode()) > limit_bytes:
                    out.append((k, None, None, None, None, None, "input too large"))
                    continue
                out += [(k, *x, None) for x in recognise(t)]
            yield pd.DataFrame(out, columns=[key, "name", "entity_type", "start", "stop", "confidence", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, name string, entity_type string, start int, stop int, confidence double, error string")


def extract_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, source, relation, target: entities (relation null, target the type) and edges of JSON texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["k"], frame["t"]):
                e, r = walk_json(t)
                out += [(k, n, None, y) for n, y in e] + [(k, a, b, c) for a, b, c in r]
            yield pd.DataFrame(out, columns=[key, "source", "relation", "target"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, source string, relation string, target string")


HEADINGS = "abstract introduction background related work method methods methodology approach experiments evaluation results discussion conclusion conclusions references acknowledgements appendix".split()


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section (from 0), heading, body: text cut at numbered, capital or well-known headings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame["k"], frame["t"]):
                if not t or not t.strip():
                    continue
                heading, body, n = "Document", [], 0
                for line in t.split("\n"):
                    s = line.strip()
                    bare = re.sub(r"^(?:#+\s*|\d+(?:\.\d+)*\.?\s+)", "", s)
                    is_heading = s and len(s) < 80 and (bare.lower() in HEADINGS or s.startswith("#") or bool(re.match(r"^\d+(\.\d+)*\.?\s+[A-Z][^.!?]{2,60}$", s)) or (s.isupper() and 3 < len(s) < 60))
                    if is_heading:
                        if any(x.strip() for x in body):
                            out.append((k, n, heading, "\n".join(body).strip()))
                            n += 1
                        heading, body = bare, []
                    else:
                        body.append(line)
                if any(x.strip() for x in body):
                    out.append((k, n, heading, "\n".join(body).strip()))
            yield pd.DataFrame(out, columns=[key, "section", "heading", "body"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, section int, heading string, body string")


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw, title, year, doi, arxiv of the references after a References line."""
    tail = F.regexp_extract(text, r"(?is)\n\s*(?:\d+\.?\s+)?references\s*\n(.*)$", 1)
    rows = df.select(key, F.explode(F.split(tail, r"\n(?=\s*(?:\[|\d+\.\s))")).alias("raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+", " "))).where("length(raw) > 10")
    r = F.col("raw")
    return rows.select(key, "raw", T.reference_title(r).alias("title"), T.extract_year(r).alias("year"), T.extract_doi(r).alias("doi"), T.extract_arxiv(r).alias("arxiv"))


def chunk_sentences(df: DataFrame, key: str, text: str, tokens: int = 128) -> DataFrame:
    """key, chunk, piece: sentences (ended by . ! ? or a line) packed up to 4 x tokens bytes, joined by ". "."""
    parts = F.filter(F.transform(F.split(F.col(text), r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")
    size = 4 * tokens
    fold = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.octet_length(F.element_at(acc, -1)) + 2 + F.octet_length(s) <= size), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(". "), s)))).otherwise(F.concat(acc, F.array(s))),
    )
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(fold).alias("chunk", "piece"))


def chunk_sections(df: DataFrame, key: str, text: str, limit: int = 512, least: int = 50) -> DataFrame:
    """key, section, chunk, piece, words: paragraphs of each section packed to ``limit`` words, each piece after the
    first starting with the last sentence before it; a small last piece joins the one before where it fits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, n, body in zip(frame["k"], frame["section"], frame["body"]):
                pieces: list[list[str]] = []
                current: list[str] = []
                fresh = 0  # words of current beyond the overlap
                for paragraph in [p.split() for p in re.split(r"\n\s*\n", body) if p.strip()]:
                    while paragraph:
                        room = limit - len(current)
                        if fresh and len(paragraph) > room:
                            pieces.append(current)
                            tail = split_sentences(" ".join(current))[-1].split()
                            current, fresh = (tail if len(tail) <= limit // 4 else []), 0
                            continue
                        current, fresh = current + paragraph[:room], fresh + min(room, len(paragraph))
                        paragraph = paragraph[room:]
                if fresh:
                    if pieces and fresh < least and len(pieces[-1]) + fresh <= limit:
                        pieces[-1] = pieces[-1] + current[len(current) - fresh :]
                    else:
                        pieces.append(current)
                out += [(k, n, i, " ".join(p), len(p)) for i, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=[key, "section", "chunk", "piece", "words"])

    kind = df.schema[key].dataType.simpleString()
    return sections(df, key, text).withColumnRenamed(key, "k").mapInPandas(run, f"{key} {kind}, section int, chunk int, piece string, words int")


def ontology_prompt(entity_types: list[tuple[str, str]], relation_types: list[tuple[str, str]]) -> str:
    """Types with their descriptions as markdown for an extraction prompt."""
    part = lambda title, rows: [f"## {title}", *[f"- **{n}**: {d}" for n, d in rows], ""] if rows else []
    return "\n".join([*part("Entity types", entity_types), *part("Relationship types", relation_types)])
