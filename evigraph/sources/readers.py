"""Readers and writers of graph files, text corpora and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evigraph.operators.evaluation import require_unique_cases

# Names under which the columns of a triple may come.
SYNONYMS = {
    "head": ("head", "head_entity", "source", "subject", "h"),
    "relation": ("relation", "relation_code", "predicate", "rel", "r"),
    "tail": ("tail", "tail_entity", "target", "object", "t"),
}
TRIPLE_COLUMNS = ("head_entity", "head_id", "relation_code", "internal_relation_id", "tail_entity", "tail_id", "time_id")
CASE_SYNONYMS = {
    "case_id": ("case_id", "id"), "query": ("query", "question"), "reference_answer": ("reference_answer", "expected_answer", "expected"),
    "category": ("category",), "difficulty": ("difficulty",), "expected_route": ("expected_route",),
}


def first_non_empty(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that df has with a value other than blank; null without one."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not empty: column value."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """name, id from lines of "name ... number" or JSON objects; lines of neither kind are skipped, the last line of a name wins (files by path)."""
    # a split is read in order, so the place in it and the split's start give the place in the file
    at = F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), at.alias("at")).filter("value <> ''")
    pairs = lines.filter("value like '{%'").select("at", F.explode(F.from_json("value", "map<string,int>")).alias("name", "id"))
    plain = lines.filter("value not like '{%'").select("at", F.regexp_extract("value", r"^(.*\S)\s+(\S+)$", 1).alias("name"), F.expr(r"try_cast(regexp_extract(value, '^(.*\\S)\\s+(\\S+)$', 2) as int)").alias("id"))
    return pairs.unionByName(plain).filter("name <> '' and id is not null").groupBy("name").agg(F.max_by("id", "at").alias("id"))


def read_triple_lines(spark: SparkSession, path: str, entities: DataFrame, relations: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Triples from lines split by tabs, or else by white space; ids joined by exact name, time_id "0" by default.

    entities and relations are (name, id). With max_rows, only so many valid lines are read.
    """
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be above 0")
    parts = read_lines(spark, path).select(F.when(F.size(F.split("value", "\t")) >= 3, F.split("value", "\t")).otherwise(F.split("value", r"\s+")).alias("p")).filter("size(p) >= 3")
    rows = parts.select(*(F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(("head_entity", "relation_code", "tail_entity"))), F.coalesce(F.nullif(F.trim(F.get("p", 3)), F.lit("")), F.lit("0")).alias("time_id"))
    rows = rows if max_rows is None else rows.limit(max_rows)
    out = rows.join(entities.select(F.col("name").alias("head_entity"), F.col("id").alias("head_id")), "head_entity", "left")
    out = out.join(entities.select(F.col("name").alias("tail_entity"), F.col("id").alias("tail_id")), "tail_entity", "left")
    return out.join(relations.select(F.col("name").alias("relation_code"), F.col("id").alias("internal_relation_id")), "relation_code", "left").select(*TRIPLE_COLUMNS)


def read_triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, relation, dst, time_id, score, ord from a CSV file with a header, whatever its columns are called; incomplete rows are dropped."""
    raw = spark.read.csv(path, header=True)
    score = F.coalesce(first_non_empty(raw, ("score", "weight", "confidence", "similarity")).try_cast("double") if hasattr(Column, "try_cast") else first_non_empty(raw, ("score", "weight")).cast("double"), F.lit(1.0))
    out = raw.select(*(first_non_empty(raw, SYNONYMS[k]).alias(a) for k, a in (("head", "src"), ("relation", "relation"), ("tail", "dst"))), F.coalesce(first_non_empty(raw, ("time_id", "time")), F.lit("0")).alias("time_id"), score.alias("score"), F.lit(0).alias("ord"))
    return out.filter("src is not null and relation is not null and dst is not null")


def write_triples_csv(triples: DataFrame, path: str) -> None:
    triples.select(*TRIPLE_COLUMNS).write.mode("overwrite").csv(path, header=True)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges; an error for a graph without nodes."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if nodes.isEmpty():
        raise ValueError("the graph has no nodes")
    return nodes, edges


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt", max_chars: int | None = None) -> DataFrame:
    """path, text of every file below a folder; max_chars, where given, cuts each."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw if max_chars is None else raw.withColumn("text", F.substring("text", 1, max_chars))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def validate_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem for files that are missing or differ."""
    j = expected.alias("e").join(actual.alias("a"), "path", "left")
    problem = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("a.size") != F.col("e.size"), "size").when(F.col("a.sha256") != F.col("e.sha256"), "checksum")
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines or a JSON list; a case named twice is an error."""
    raw = spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    for box in ("cases", "questions", "data", "items", "examples", "test_cases"):
        if box in raw.columns and isinstance(raw.schema[box].dataType, t.ArrayType):
            raw = raw.select(F.explode(box).alias("c")).select("c.*")
            break
    lists = [F.coalesce(*(F.col(n) for n in names if n in raw.columns)).alias(out) for out, names in (("keywords", ("keywords", "expected_keywords")),) if any(n in raw.columns for n in names)]
    return require_unique_cases(raw.select(*(first_non_empty(raw, names).alias(k) for k, names in CASE_SYNONYMS.items()), *lists))


def upsert_by_id(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace those of existing with the same id."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def get_by(store: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """Rows of a store by ids, by a condition, or by both; all rows without either."""
    out = store if ids is None else store.join(ids.select(key), key, "left_semi")
    return out if where is None else out.filter(where)


def delete_by(store: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """The store without the rows that get_by finds; a condition that is null deletes nothing. One of both must be given."""
    if ids is None and where is None:
        raise ValueError("ids or where must be given")
    if ids is None:
        return store.filter(~F.coalesce(where, F.lit(False)))
    if where is None:
        return store.join(ids.select(key), key, "left_anti").select(store.columns)
    named = ids.select(key).distinct().withColumn("_named", F.lit(True))
    return store.join(named, key, "left").filter(F.col("_named").isNull() | ~F.coalesce(where, F.lit(False))).select(store.columns)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object or list that may go over several lines."""
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in UTF-8; null fields are left out."""
    df.write.mode("overwrite").json(path)


def event_lines(events: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """value: one JSON line an event, the columns named in hidden replaced by a mark where they hold something."""
    shown = [F.when(F.col(c).isNotNull(), F.lit("[redacted]")).alias(c) if c in hidden else F.col(c) for c in events.columns]
    return events.select(F.to_json(F.struct(*shown)).alias("value"))
