"""Secret scans with corpus-wide ownership, as DataFrame expressions only.

Three base patterns find labelled assignments, access keys and long hex strings. A fourth, wider
pattern proposes bare high-entropy words; whether such a word is kept depends on the whole corpus:
candidate hashes are counted by distinct repositories and owners. A value seen under many owners
is a copied example, a value that belongs to one owner looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import Scratch

#: Kinds in their order, each with its pattern, the group that must be long enough and that length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("word", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, kind: str) -> Column:
    """array<struct<start,end,ord,kind,secret>> of one kind, leftmost and non-overlapping, in code points.

    Between matches, the text is split by the same pattern, so lengths of gaps and matches give
    the offsets. Matches whose tested group is too short are consumed and then dropped.
    """
    ord_, (_, pattern, group, least) = next((i, k) for i, k in enumerate(KINDS) if k[0] == kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ord:int,kind:string,secret:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
            F.when(
                F.length(p["value"]) >= least,
                F.array_append(
                    acc["out"],
                    F.struct(
                        (acc["at"] + F.length(p["gap"])).alias("start"),
                        (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                        F.lit(ord_).alias("ord"),
                        F.lit(kind).alias("kind"),
                        p["value"].alias("secret"),
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    none = F.array().cast("array<struct<start:int,end:int,ord:int,kind:string,secret:string>>")
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _live_word(s: Column) -> Column:
    """A bare word that could be a generated credential: letters of both cases and digits mixed, or a long hex-like mix."""
    v = s["secret"]
    return v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")


def _digest(found: Column) -> Column:
    """kind:start:end joined by commas in span order."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str, text: str, repository: str, owner: str, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """Find secrets in every text; returns one row per row of docs.

    Columns: key, base (array of the base spans), spans (these and the bare words whose value
    occurs under at most ``max_owners`` distinct owners and ``max_repositories`` distinct
    repositories over the whole corpus and which overlap no base span), n_live and n_shared (spans
    whose value is owner-specific, and those whose value is widely copied). A null text is scanned
    as empty; a null owner or repository counts as one named "". Repeated rows each keep their
    result, and equal values of one owner count once. An empty table gives no rows. Only the four
    named columns are read, so other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.save(_candidates(docs.select(F.col(key).alias("_key"), F.col(text).alias("_body"), F.col(repository).alias("_r"), F.col(owner).alias("_o")), "_body", "_r", "_o").drop("_body", "_r", "_o"), "rows")
    found = rows.filter(HAS_CANDIDATES)
    judged = _judged(found, max_owners, max_repositories).select(
        "_text",
        F.transform("_judged", lambda s: s["span"]).alias("spans"),
        F.size(F.filter("_judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_judged", lambda s: ~s["live"])).cast("long").alias("n_shared"),
    )
    none = F.lit(0).cast("long")
    clean = rows.filter(f"not ({HAS_CANDIDATES})").select(F.col("_key").alias(key), "base", F.col("base").alias("spans"), none.alias("n_live"), none.alias("n_shared"))
    return found.join(judged, "_text").select(F.col("_key").alias(key), "base", "spans", "n_live", "n_shared").unionByName(clean)


#: Rows of _candidates with anything to judge.
HAS_CANDIDATES = "size(base) > 0 or size(_words) > 0"


def _candidates(docs: DataFrame, text: str, repository: str, owner: str) -> DataFrame:
    """docs with _repo, _owner, base, _words (bare words that overlap no base span) and _text (a digest of the text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        "*",
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.array_sort(F.concat(*(spans(body, k) for k in BASE))).alias("base"),
        F.filter(spans(body, "word"), _live_word).alias("_words"),
        F.sha2(body, 256).alias("_text"),
    )
    return out.withColumn("_words", F.filter("_words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))


def _judged(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """_text and _judged: array<struct<span, live>> in span order, without bare words that are widely copied."""
    seen = found.select("_text", "_repo", "_owner", F.explode(F.concat("base", "_words")).alias("span")).withColumn("_hash", F.sha2("span.secret", 256))
    by = seen.groupBy("_hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_n"))
    owners = by.select("_hash", "_owner").distinct().groupBy("_hash").agg(F.count(F.lit(1)).alias("_owners"))
    repos = by.select("_hash", "_repo").distinct().groupBy("_hash").agg(F.count(F.lit(1)).alias("_repos"))
    spread = owners.join(repos, "_hash").select("_hash", ((F.col("_owners") <= max_owners) & (F.col("_repos") <= max_repositories)).alias("live"))
    return (
        seen.select("_text", "span", "_hash")
        .distinct()
        .join(spread, "_hash")
        .groupBy("_text")
        .agg(F.array_sort(F.collect_list(F.when(F.col("live") | (F.col("span.kind") != "word"), F.struct("span", "live")))).alias("_judged"))
    )


def redact_secrets(docs: DataFrame, text: str, repository: str, owner: str, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """docs, all columns, with every kept span of text replaced: by <SECRET> where its value is owner-specific, by <EXAMPLE> where it is widely copied.

    Overlapping spans are replaced once, by the first one's mark. Only texts with candidates are
    shuffled. Nulls, repeats and empty tables as in scan_secrets; columns may have any name.
    """
    names = docs.columns
    text, repository, owner = (f"c{names.index(c)}" for c in (text, repository, owner))
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    marked = _candidates(docs, text, repository, owner)
    found = marked.filter(HAS_CANDIDATES)
    judged = _judged(found, max_owners, max_repositories)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(
        "_judged",
        start,
        lambda acc, s: F.when(s["span"]["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["span"]["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                s["span"]["end"].alias("at"),
                F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["span"]["start"] - acc["at"]), F.when(s["live"], "<SECRET>").otherwise("<EXAMPLE>")).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    changed = found.join(judged, "_text").withColumn(text, body).select(docs.columns)
    return marked.filter(f"not ({HAS_CANDIDATES})").select(docs.columns).unionByName(changed).toDF(*names)


def digest_columns(scanned: DataFrame, key: str) -> DataFrame:
    """Counts by base kind and the digests of the spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return scanned.select(key, *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), "n_live", "n_shared")
