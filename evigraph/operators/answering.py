"""Answers composed by rules from selected evidence, as Column expressions over each query's rows.

A query's selected evidence (at most evidence.MAX_SELECTED rows) is gathered into one array in its
order; everything else is computed within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import evidence as E

# Relation groups and the names that belong to each.
CANONICAL = {
    "spouse": ("spouse", "wife", "husband", "partner", "配偶", "妻子", "丈夫"),
    "occupation": ("occupation", "job", "profession", "work_as", "worked_as", "职业"),
    "birth_place": ("birth_place", "birthplace", "place_of_birth", "born_in", "出生地"),
    "nationality": ("nationality", "citizenship", "citizen_of", "国籍"),
    "position": ("position", "office", "held_position", "president", "职位"),
    "country": ("country", "located_in", "part_of", "所属国家"),
    "capital": ("capital", "capital_of", "首都"),
}
# What a question asks for (group, label, words), the first that holds.
INTENTS = (
    ("spouse", "妻子", ("妻子", "老婆", "夫人", "太太", "配偶", "spouse", "wife")),
    ("spouse", "丈夫", ("丈夫", "老公", "先生", "husband")),
    ("occupation", "职业", ("职业", "工作", "职务", "做什么", "occupation", "job", "profession")),
    ("birth_place", "出生地", ("出生地", "出生在哪里", "哪里出生", "出生于", "born", "birthplace", "birth place")),
    ("nationality", "国籍", ("国籍", "哪个国家的人", "是哪国人", "nationality", "citizen")),
    ("position", "职位", ("职位", "职称", "担任", "总统", "position", "office", "president")),
    ("country", "所属国家", ("哪个国家", "所属国家", "国家", "country")),
    ("capital", "首都", ("首都", "capital")),
)
# Names of groups in answers, sentences of each group, and words that ask how two things are related.
LABELS = {"spouse": "配偶", "occupation": "职业", "birth_place": "出生地", "nationality": "国籍", "position": "职位", "country": "所属国家", "capital": "首都"}
FACTS = {"occupation": " 的职业是 ", "birth_place": " 的出生地是 ", "nationality": " 的国籍相关信息指向 ", "position": " 担任或关联的职位是 ", "country": " 所属或关联的国家是 ", "capital": " 的首都相关信息指向 "}
ASKS_RELATION = ("什么关系", "有什么关系", "关系是什么", "relationship", "relation")
# Sentences of answers.
SURE, GENERIC_UNSURE, FACT_UNSURE = "根据已有信息，", "从已有信息看，可以谨慎判断：", "从已有信息看，"
CAUTION, FACT_CAUTION = "不过，目前信息并不充分，因此这个结论需要谨慎理解。", "不过，目前依据有限，这个结论需要谨慎理解。"
INDIRECT, NO_TEXT = "相关对象之间存在间接联系：", "从已有信息看，这个问题有一定相关依据，但还不足以形成非常确定的结论。"
CLARIFY = "请你补充得更具体一些，例如你想问哪个对象、它和谁的关系，或者你想了解哪方面信息。"
ERROR = "抱歉，我刚刚处理这个问题时遇到了一点问题。你可以换一种问法，或者补充更多上下文后再试。"
UNANSWERABLE = "目前可用信息不足，不能可靠回答这个问题。你可以补充更具体的对象、关系或背景信息，我再继续帮你分析。"
MISSING = ("目前我没有找到足够可靠的信息来回答这个问题，尤其是关于“", "”的部分还不够明确。你可以补充更完整的名称、上下文，或者换一种更具体的问法。")
REASON = " 因此目前不能可靠回答。你可以补充更具体的对象、关系或背景信息，我再继续帮你分析。"
# Terms that answers don't show, and lines that they don't hold.
TERMS = {
    "知识图谱": "已有信息", "KG-RAG": "当前系统", "KGRAG": "当前系统", "kg_rag": "当前系统", "knowledge graph": "已有信息", "实体链接": "对象识别", "实体抽取": "对象识别", "图谱检索": "信息查找",
    "检索节点": "处理步骤", "路由节点": "处理步骤", "LangGraph": "当前系统", "StateGraph": "当前系统", "内部流程": "处理过程", "内部路由": "处理过程",
}
INNER_LINES = r"(?i)^(?:route|node|state|metadata|trace|debug|error_stage|answerability|semantic_score)\s*[:：]"
SMALL_WORDS = ("of", "the", "and", "in", "on", "for", "to")


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """Trimmed, lower case, _ as space, runs of white space as one (the answers' variant: - stays)."""
    return F.regexp_replace(F.translate(F.lower(_strip(text)), "_", " "), r"\s+", " ")


def display(entity: Column) -> Column:
    """A node key as a name: barack_obama to Barack Obama; texts with a space or · stay."""
    raw = _strip(entity)
    under = F.translate(raw, "-", "_")
    parts = F.filter(F.split(under, "_"), lambda p: p != "")
    cased = F.transform(parts, lambda p, i: F.when((i > 0) & F.lower(p).isin(*SMALL_WORDS), F.lower(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
    return F.when(raw.rlike("[ ·]"), raw).when(F.size(parts) == 0, under).otherwise(F.array_join(cased, " "))


def canonical(relation: Column) -> Column:
    """The group of a relation's name; names of no group stay, in lower case with _ for - and space."""
    raw = F.translate(F.lower(_strip(relation)), "- ", "__")
    out = raw
    for group, names in CANONICAL.items():
        out = F.when(raw.isin(*names), group).otherwise(out)
    return out


def label(relation: Column) -> Column:
    group, out = canonical(relation), F.coalesce(F.nullif(_strip(relation), F.lit("")), F.lit("相关"))
    for name, shown in LABELS.items():
        out = F.when(group == name, shown).otherwise(out)
    return out


def intent(query: Column) -> Column:
    """struct<group, label> of what a question asks for; nulls if it asks for none of the groups."""
    q, out = plain(query), F.struct(F.lit(None).cast("string").alias("group"), F.lit(None).cast("string").alias("label"))
    for group, shown, words in reversed(INTENTS):
        out = F.when(F.greatest(*(F.contains(q, F.lit(w)) for w in (*words, "\0"))), F.struct(F.lit(group).alias("group"), F.lit(shown).alias("label"))).otherwise(out)
    return out


def mentioned(entity: Column, query: Column) -> Column:
    """Whether a question holds an entity's name or a part of it of three characters or more."""
    e, q = plain(entity), plain(query)
    parts = F.filter(F.split(e, r"[\s_·.\-]+"), lambda p: F.length(p) >= 3)
    return (e != "") & (q != "") & (F.contains(q, e) | F.exists(parts, lambda p: F.contains(q, p)))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the tokens of a, of two characters or more, that b has."""
    words = lambda x: F.array_distinct(F.filter(F.split(plain(x), "[\\s,，。！？?;；:：()（）\"'“”]+"), lambda t: F.length(t) >= 2))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))


def best_item(items: Column, query: Column) -> Column:
    """The item that fits a question best: its score, half a point for each end named, and 0.2 of the overlap; the first of equals."""

    def rank(e: Column, i: Column) -> Column:
        ends = F.when(mentioned(e["src"], query), 0.5).otherwise(0.0) + F.when(mentioned(e["dst"], query), 0.5).otherwise(0.0)
        return F.struct(F.round(T.clip(e["score"]) + ends + 0.2 * token_overlap(query, e["text"]), 9).alias("s"), (-i).alias("o"), e.alias("e"))

    return F.array_max(F.transform(items, rank))["e"]


def basis(items: Column) -> Column:
    """The sentence that names the first three items' texts; empty without any."""
    whole = lambda e: F.when((e["src"] != "") & (e["dst"] != ""), F.concat(e["src"], F.lit(" 与 "), e["dst"], F.lit(" 存在“"), e["label"], F.lit("”关系。")))
    shown = F.transform(F.slice(items, 1, 3), lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(_strip(e["text"]), F.lit("")), whole(e))))
    said = F.filter(shown, lambda x: x.isNotNull())
    return F.when(F.size(said) > 0, F.concat(F.lit("依据是："), F.array_join(said, " "))).otherwise("")


def _paragraphs(*parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), _strip), lambda p: p != ""), "\n\n")


def with_direct_fact(rows: DataFrame) -> DataFrame:
    """rows (query, items, verdict) with fact: the answer to a question for one fact, or for how two things are related; null where evidence gives none.

    Each step is a column of its own, so that no expression is computed or compiled twice.
    """
    query, verdict = F.col("query"), F.col("verdict")
    start = F.when(verdict == "uncertain", FACT_UNSURE).otherwise(SURE)
    out = rows.withColumn("_asked", intent(query))
    out = out.withColumn("_best", best_item(F.filter("items", lambda e: e["group"] == F.col("_asked.group")), query)).withColumn("_how", best_item(F.filter("items", lambda e: _strip(e["relation"]) != ""), query))
    best, how = F.col("_best"), F.col("_how")
    out = out.withColumn("_s", mentioned(best["src"], query)).withColumn("_t", mentioned(best["dst"], query))
    spouse = (best["group"] == "spouse") & F.contains(plain(query), plain(best["dst"])) & (best["dst"] != "")
    out = out.withColumn("_turned", F.when(F.col("_s") != F.col("_t"), F.col("_t")).otherwise(spouse))
    subject, value = F.when(F.col("_turned"), best["dst"]).otherwise(best["src"]), F.when(F.col("_turned"), best["src"]).otherwise(best["dst"])
    middle = F.concat(F.lit(" 的"), F.col("_asked.label"), F.lit("是 "))
    for name, words in FACTS.items():
        middle = F.when(best["group"] == name, words).otherwise(middle)
    fact = _paragraphs(F.concat(start, subject, middle, value, F.lit("。")), F.when(verdict == "uncertain", FACT_CAUTION), basis(F.array(best)))
    pair = F.concat(start, how["src"], F.lit(" 和 "), how["dst"])
    related = F.concat(pair, F.when(how["group"] == "spouse", " 是配偶关系。").otherwise(F.concat(F.lit(" 存在“"), how["label"], F.lit("”关系。"))))
    asks = F.greatest(*(F.contains(plain(query), F.lit(w)) for w in ASKS_RELATION))
    full = lambda e: e.isNotNull() & (e["src"] != "") & (e["dst"] != "")
    out = out.withColumn("fact", F.when(full(best), fact).when(asks & full(how), _paragraphs(related, basis(F.array(how)))))
    return out.drop("_asked", "_best", "_how", "_s", "_t", "_turned")


def with_generic(rows: DataFrame) -> DataFrame:
    """rows (items, verdict) with said: an answer from relations (three at most), else paths (two), else neighbours (three), else the first text."""
    of = lambda kind, n: F.slice(F.filter("items", lambda e: F.lower(e["evidence_type"]) == kind), 1, n)
    out = rows.withColumn("_rel", of("relation", 3)).withColumn("_path", of("path", 2)).withColumn("_near", of("neighbor", 3))

    def listed(found: str, tell) -> Column:
        return F.array_join(F.filter(F.transform(found, tell), lambda x: x.isNotNull()), "；")

    def tie(between: str):
        return lambda e: F.when((e["src"] != "") & (e["dst"] != ""), F.concat(e["src"], F.lit(" 与 "), e["dst"], F.lit(between), e["label"], F.lit("”关系"))).otherwise(F.nullif(_strip(e["text"]), F.lit("")))

    start = F.when(F.col("verdict") == "answerable", SURE).otherwise(GENERIC_UNSURE)
    first = _strip(F.get("items", 0)["text"])
    main = (
        F.when(F.size("_rel") > 0, F.concat(start, listed("_rel", tie(" 之间存在“")), F.lit("。")))
        .when(F.size("_path") > 0, F.concat(start, F.lit(INDIRECT), listed("_path", lambda e: F.when(F.size(e["path"]) > 0, F.array_join(F.transform(e["path"], display), " → ")).otherwise(F.nullif(_strip(e["text"]), F.lit("")))), F.lit("。")))
        .when(F.size("_near") > 0, F.concat(start, listed("_near", tie(" 存在“")), F.lit("。")))
        .when(first != "", F.concat(start, first))
        .otherwise(NO_TEXT)
    )
    out = out.withColumn("said", _paragraphs(main, F.when(F.col("verdict") == "uncertain", CAUTION), basis(F.col("items"))))
    return out.drop("_rel", "_path", "_near")


def sanitize(answer: Column) -> Column:
    """An answer without the system's own terms and without lines of its inner state."""
    out = _strip(answer)
    for old, new in TERMS.items():
        out = F.regexp_replace(out, rf"(?iu)\Q{old}\E", new)
    out = F.regexp_replace(out, r"(?iU)\bKG\b", "当前系统")
    return _strip(F.array_join(F.filter(F.split(out, "\n"), lambda line: ~F.trim(line).rlike(INNER_LINES)), "\n"))


def compose(queries: DataFrame, selected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, answer, generation_type, answerability, semantic_score, citations (E1, E2, ...) of every query.

    queries: query_id, query and, if there, clarify and failed (boolean), clarifying_question,
    ungrounded (names), scoring_reason. A question that must be clarified comes first, then one that
    failed, then one without evidence or an answerable verdict; only answers by rules cite.
    """
    named = selected.filter("selected").withColumns({"src": display(F.col("source_entity")), "dst": display(F.col("target_entity")), "group": canonical(F.col("relation")), "label": label(F.col("relation"))})
    fields = ["evidence_type", "src", "dst", "relation", "group", "label", "path", "text", "score"]
    rows = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sel_rank", *fields))).alias("items"))
    has = lambda c, kind: F.col(c) if c in queries.columns else F.lit(None).cast(kind)
    q = queries.select("query_id", "query", *(has(c, k).alias(c) for c, k in (("clarify", "boolean"), ("failed", "boolean"), ("clarifying_question", "string"), ("ungrounded", "array<string>"), ("scoring_reason", "string"))))
    out = q.join(verdicts.select("query_id", "answerability", "semantic"), "query_id", "left").join(rows, "query_id", "left").withColumn("verdict", F.coalesce("answerability", F.lit("unanswerable")))
    kind = F.when(F.col("clarify"), "clarification").when(F.col("failed"), "error_fallback").when((F.col("verdict") == "unanswerable") | F.col("items").isNull(), "unanswerable").otherwise("rule")
    out = with_generic(with_direct_fact(out.withColumn("kind", kind)))
    names = F.array_join(F.slice(F.filter(F.coalesce("ungrounded", F.array().cast("array<string>")), lambda n: _strip(n) != ""), 1, 3), "、")
    reason = _strip(F.col("scoring_reason"))
    sorry = F.when(names != "", F.concat(F.lit(MISSING[0]), names, F.lit(MISSING[1]))).when(reason != "", F.concat(reason, F.lit(REASON))).otherwise(UNANSWERABLE)
    asked = F.coalesce(F.nullif(_strip(F.col("clarifying_question")), F.lit("")), F.lit(CLARIFY))
    said = F.when(F.col("kind") == "clarification", asked).when(F.col("kind") == "error_fallback", ERROR).when(F.col("kind") == "unanswerable", sorry).otherwise(F.coalesce("fact", "said"))
    cited = F.when(F.col("kind") == "rule", F.transform("items", lambda e, i: F.concat(F.lit("E"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("raw", said).withColumn("citations", cited)
    return out.select("query_id", sanitize(F.col("raw")).alias("answer"), F.col("kind").alias("generation_type"), F.col("verdict").alias("answerability"), T.clip(F.col("semantic")).alias("semantic_score"), "citations")


def answer(queries: DataFrame, fused: DataFrame) -> DataFrame:
    """Select, judge and compose: answers to queries (query_id, query) from fused evidence."""
    selected, _ = E.search.settle(E.select_evidence(E.score_evidence(fused, queries)).filter("selected"), "selected")
    return compose(queries, selected, E.answerability(queries, selected))
