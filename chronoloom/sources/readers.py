"""Sources and sinks: texts, messages, JSON, extracted PDF pages, paper feeds, evaluation sets, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as T


def text_episodes(spark: SparkSession, path: str) -> DataFrame:
    """One episode per file: id (hash of the path), name, source_type, content."""
    rows = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_path"))
    return rows.select(F.sha2("name", 256).alias("id"), "name", F.lit("text").alias("source_type"), F.col("value").alias("content"))


def message_episodes(df: DataFrame, actor: str, content: str, key: str) -> DataFrame:
    """Chat turns as episodes "actor: content"."""
    return df.select(F.col(key).cast("string").alias("id"), F.lit("message").alias("source_type"), F.concat_ws(": ", actor, content).alias("content"))


def json_episodes(df: DataFrame, content: str, key: str) -> DataFrame:
    """JSON values as episodes; what doesn't parse is marked."""
    return df.select(F.col(key).cast("string").alias("id"), F.lit("json").alias("source_type"), F.col(content).alias("content"), F.try_parse_json(content).isNotNull().alias("valid"))


def pages(df: DataFrame, key: str, text: str, size: int = 3000) -> DataFrame:
    """key, page, content: extracted text cut at blank lines into pages of about ``size`` characters (500 at least)."""
    size = max(size, 500)
    parts = T.paragraphs(F.col(text))
    fold = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) < size), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n\n"), p)))).otherwise(F.concat(acc, F.array(p))),
    )
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(fold).alias("page", "content"))


def pdf_files(spark: SparkSession, folder: str, extract=None) -> DataFrame:
    """path, text, error of the PDF files of a folder; ``extract`` turns bytes to text and runs in Arrow batches.

    No PDF library is assumed: without ``extract`` every row carries an error instead of text.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            texts, errors = [], []
            for content in frame["content"]:
                try:
                    texts.append(extract(bytes(content)) if extract else None)
                    errors.append(None if extract else "no extractor")
                except Exception as error:  # noqa: BLE001  (a broken file must not fail the others)
                    texts.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def arxiv_feed(spark: SparkSession, path: str) -> DataFrame:
    """Papers of Atom XML files: id, title, published, summary."""
    rows = spark.read.format("xml").option("rowTag", "entry").load(path)
    clean = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " ")).alias(c)
    return rows.select("id", clean("title"), F.col("published").cast("timestamp").alias("published"), clean("summary"))


def scholar_json(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a JSON answer with a data list: paper_id, title, year, citation_count."""
    rows = spark.read.option("multiLine", True).schema("data array<struct<paperId:string,title:string,year:int,citationCount:int>>").json(path)
    return rows.select(F.explode("data").alias("p")).select(F.col("p.paperId").alias("paper_id"), "p.title", "p.year", F.col("p.citationCount").alias("citation_count"))


def pubmed_json(spark: SparkSession, path: str) -> DataFrame:
    """Summaries by id: pmid, title, pubdate."""
    rows = spark.read.option("multiLine", True).schema("result map<string, struct<uid:string,title:string,pubdate:string>>").json(path)
    return rows.select(F.explode("result").alias("k", "v")).where("k != 'uids'").select(F.col("k").alias("pmid"), "v.title", "v.pubdate")


EVAL_SCHEMA = "question_id string, question_type string, question string, answer string, question_date string, haystack_sessions array<array<struct<role:string,content:string>>>"


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Turns of nested sessions: question_id, session, turn, role, content."""
    rows = spark.read.option("multiLine", True).schema(EVAL_SCHEMA).json(path)
    s = rows.select("question_id", F.posexplode("haystack_sessions").alias("session", "turns"))
    return s.select("question_id", "session", F.posexplode("turns").alias("turn", "t")).select("question_id", "session", "turn", "t.role", "t.content")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as csv, json or parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def latex(rows: list[dict]) -> str:
    """A small report (a list of rows) as a LaTeX table."""
    if not rows:
        return ""
    head = list(rows[0])
    escape = lambda x: str(x).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%")
    lines = [r"\begin{tabular}{" + "l" * len(head) + "}", " & ".join(map(escape, head)) + r" \\ \hline", *[" & ".join(escape(r[h]) for h in head) + r" \\" for r in rows], r"\end{tabular}"]
    return "\n".join(lines)
