"""Mentions of entities in questions, found by rules as Column expressions; nothing leaves the JVM.

Each rule gives raw texts. These are cleaned, checked and located in the question; then equal ones
are merged and long ones that hold a better short one are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules, their confidence, and their patterns with the groups that name an entity.
ATTRIBUTES = "妻子|老婆|夫人|太太|丈夫|老公|先生|配偶"
FACTS = "职业|工作|职位|职务|身份|国籍|出生地|首都|作者|创始人|所属国家"
LINKS = "有什么关系|的关系是什么|什么关系|之间是什么关系|之间有什么联系|有什么联系|是什么关系"
QUOTED = ("《([^》]{1,80})》", "“([^”]{1,80})”", '"([^"]{1,80})"', "'([^']{1,80})'", "「([^」]{1,80})」", "『([^』]{1,80})』")
POSSESSIVE = (
    f"(.+?)的(?:{ATTRIBUTES})(?:是谁|是什么|叫什么|是哪位|$|[？?])",
    f"(.+?)的(?:{FACTS})(?:是什么|是谁|在哪里|是哪|有哪些|$|[？?])",
    f"(?:谁是|哪位是)(.+?)的(?:{ATTRIBUTES})",
    "(.+?)(?:出生在哪里|在哪里出生|出生于哪里|出生于哪|是哪国人|来自哪里)",
    "(.+?)(?:是哪个国家的人|是哪国人|属于哪个国家)",
    r"(?:what\s+is|what's)\s+(.+?)['’]s\s+(?:occupation|job|profession|nationality|birthplace|birth\s+place)\??",
    r"(?:who\s+is|who's)\s+(?:the\s+)?(?:wife|husband|spouse)\s+of\s+(.+?)\??",
    r"(?:where\s+was)\s+(.+?)\s+born\??",
)
RELATION = (
    f"(.+?)和(.+?)(?:{LINKS})", f"(.+?)与(.+?)(?:{LINKS})", "(.+?)到(.+?)(?:是否存在路径|有什么路径|的路径是什么|怎么连接)", "(.+?)是否(?:连接|认识|关联|相关于)(.+)", "(.+?)(?:连接到|关联到|相关于)(.+)",
    "(.+?)属于(.+)", r"what\s+is\s+the\s+relationship\s+between\s+(.+?)\s+and\s+(.+?)\??", r"how\s+is\s+(.+?)\s+related\s+to\s+(.+?)\??",
)
ABOUT = (
    "(?:介绍一下|介绍|说明一下|说明|解释一下|解释|分析一下|分析)(.+)", "(?:关于|有关)(.+?)(?:的信息|的内容|的情况|是什么|有哪些|$|[？?])", "(.+?)(?:是什么|是谁|属于什么|有哪些关系|有哪些相关对象|有哪些相关内容|相关的对象有哪些|相关内容有哪些)",
    r"(?:什么是|who is|what is|tell me about|explain|describe)\s+(.+)", "(?:和|与)(.+?)(?:相关的对象有哪些|相关内容有哪些|相关的信息有哪些)",
)
PROPER = (r"\b(?:[A-Z][a-zA-Z0-9_\-']+)(?:\s+(?:[A-Z][a-zA-Z0-9_\-']+|of|and|the|for|in|on|de|van|von)){0,6}\b", r"\b[A-Z]{2,}(?:-[A-Z0-9]+)?\b")
MIXED = (r"[一-鿿]{1,20}\s*[A-Za-z][A-Za-z0-9_\-]{1,20}", r"[A-Za-z][A-Za-z0-9_\-]{1,20}\s*[一-鿿]{1,20}")
CONFIDENCE = (0.95, 0.93, 0.90, 0.82, 0.78, 0.75)

# What is taken off a mention, and what none may be.
EDGES = " \t\r\n:：,，.。?？!！;；、()（）[]【】{}<>《》\"'“”‘’"
LEADING = ("请问", "麻烦", "帮我看看", "帮我查一下", "帮我分析一下", "我想知道", "我想问", "请介绍", "介绍一下", "介绍", "关于", "有关", r"the\s+", r"a\s+", r"an\s+", r"who\s+is\s+", r"what\s+is\s+", r"what's\s+", r"tell\s+me\s+about\s+")
TRAILING = ("是什么", "是谁", "有哪些", "有什么", "怎么样", "怎么回事", "的关系", "相关内容", "相关对象", "的信息", "的情况", r"\?", "？", "。", r"\.", ",", "，", ";", "；")
OWNED = (
    f"(.+?)的(?:{ATTRIBUTES})$", f"(.+?)的(?:{FACTS})$", "(.+?)(?:出生在哪里|在哪里出生|出生于哪里|来自哪里)$", "(.+?)(?:是哪个国家的人|是哪国人|属于哪个国家)$", "(.+?)(?:相关的对象|相关内容|相关信息)$",
    r"(.+?)['’]s\s+(?:wife|husband|spouse|occupation|job|profession|nationality|birthplace|birth\s+place)$", r"(?:the\s+)?(?:wife|husband|spouse)\s+of\s+(.+)$",
)
SUFFIX = f"的(?:{ATTRIBUTES}|{FACTS})$|(?i:'s (?:wife|husband|spouse|occupation|job|profession|nationality|birthplace|birth place)$)"
NAME_LIKE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+|[A-Z]{2,}|[一-鿿]{2,}|[A-Za-z].*[一-鿿]|[一-鿿].*[A-Za-z]"
NO_MENTION = (
    "谁", "什么", "哪里", "哪个", "哪些", "多少", "如何", "为什么", "怎么", "怎么办", "怎么样", "关系", "路径", "实体", "对象", "内容", "信息", "情况", "介绍", "说明", "解释", "分析", "这个", "那个", "它", "他", "她",
    *ATTRIBUTES.split("|"), *FACTS.split("|"),
    "who", "what", "where", "which", "why", "how", "relation", "relationship", "path", "entity", "object", "thing", "information", "about", "explain", "describe", "tell", "me",
    "wife", "husband", "spouse", "occupation", "job", "profession", "nationality", "birthplace", "capital",
)
MIN_CONFIDENCE, MAX_MENTIONS = 0.3, 8
#: Mentions longer than this name nothing; confidences closer than CLOSE count as equal; a mention may be RIVAL better than the one that ousts it.
LONGEST, CLOSE, RIVAL = 80, 0.05, 0.2

_ITEM = "struct<rule:int,pattern:int,ord:int,text:string>"
_FULL = "struct<key:string,text:string,start:int,end:int,confidence:double,suffix:boolean,named:boolean>"


def _anchored(pattern: str) -> str:
    """A pattern that begins with any text matches from the start of a line if at all; saying so keeps long texts linear."""
    return f"(?iudU)(?:\\A|(?<=\\n)){pattern}" if pattern.startswith("(.+?)") else f"(?iudU){pattern}"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(texts: Column) -> Column:
    """An array of raw mentions, each without what leads to it, what it is asked about, and outer punctuation."""

    def led(t: Column) -> Column:
        t = _strip(F.regexp_replace(t, r"(?U)\s+", " "))
        for p in LEADING:
            t = _strip(F.regexp_replace(t, f"(?iuU)^{p}", ""))
        return F.btrim(t, F.lit(EDGES))

    def owner(t: Column) -> Column:
        found = (F.btrim(F.regexp_extract(t, _anchored(p), 1), F.lit(EDGES)) for p in OWNED)
        return F.coalesce(*(F.when((x != "") & (x != t), x) for x in found), t)

    def ended(t: Column) -> Column:
        t = F.btrim(t, F.lit(EDGES))
        for p in TRAILING:
            t = _strip(F.regexp_replace(t, f"(?iu){p}$", ""))
        return F.btrim(t, F.lit(EDGES))

    return F.transform(F.transform(F.transform(texts, led), owner), ended)


def valid(text: Column) -> Column:
    """Whether a cleaned text may be a mention."""
    return (text != "") & (F.length(text) <= LONGEST) & ((F.length(text) > 1) | text.rlike("^[A-Z]")) & ~F.lower(text).isin(*NO_MENTION) & ~text.rlike(r"(?U)^[\W_]+$|^\d+$")


def span(query: Column, text: Column) -> Column:
    """start and end of a text in a question: as it is, in any case, or without white space; -1 where absent."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    exact = F.instr(query, text)
    any_case = F.instr(F.lower(query), F.lower(text))
    solid = F.instr(bare(query), bare(text))
    places = F.filter(F.sequence(F.lit(1), F.length(query)), lambda i: ~F.substring(query, i, F.lit(1)).rlike(r"(?U)^\s$"))
    first = F.when(exact > 0, exact).otherwise(any_case)
    start = F.when(first > 0, first - 1).when(solid > 0, F.get(places, solid - 1) - 1).otherwise(-1)
    end = F.when(first > 0, first - 1 + F.length(text)).when(solid > 0, F.get(places, solid + F.length(bare(text)) - 2)).otherwise(-1)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _raw(query: Column) -> Column:
    """What every rule's patterns take out of a question, in the rules' order."""

    def items(rule: int, pattern: int, found: Column) -> Column:
        return F.transform(found, lambda t, i: F.struct(F.lit(rule).alias("rule"), F.lit(pattern).alias("pattern"), i.cast("int").alias("ord"), t.alias("text")))

    parts = [items(0, 0, F.concat(*(F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in QUOTED)))]
    for rule, patterns in ((1, POSSESSIVE), (2, RELATION), (3, ABOUT)):
        for k, p in enumerate(patterns):
            groups = range(1, 3) if rule == 2 else range(1, 2)
            parts.append(items(rule, k, F.array(*(F.regexp_extract(query, _anchored(p), g) for g in groups))))
    for rule, patterns in ((4, PROPER), (5, MIXED)):
        parts.append(items(rule, 0, F.concat(*(F.regexp_extract_all(query, F.lit(f"(?U){p}"), F.lit(0)) for p in patterns))))
    return F.concat(*parts).cast(f"array<{_ITEM}>")


def _with_text(items: Column, texts: Column) -> Column:
    return F.zip_with(items, texts, lambda m, t: F.struct(m["rule"].alias("rule"), m["pattern"].alias("pattern"), m["ord"].alias("ord"), t.alias("text")))


def _better(new: Column, old: Column) -> Column:
    """Whether a later mention of the same name replaces the earlier one."""
    surer = new["confidence"] > old["confidence"] + CLOSE
    shorter = (F.abs(new["confidence"] - old["confidence"]) <= CLOSE) & (F.length(new["text"]) < F.length(old["text"]))
    return F.when(old["suffix"] & ~new["suffix"], True).when(new["suffix"] & ~old["suffix"], False).otherwise(surer | shorter)


def _merged(items: Column) -> Column:
    """One mention a key, in the order in which keys came up."""

    def step(seen: Column, m: Column) -> Column:
        known = F.exists(seen, lambda o: o["key"] == m["key"])
        return F.when(known, F.transform(seen, lambda o: F.when((o["key"] == m["key"]) & _better(m, o), m).otherwise(o))).otherwise(F.concat(seen, F.array(m)))

    return F.aggregate(items, F.array().cast(f"array<{_FULL}>"), step)


def _pruned(items: Column) -> Column:
    """Without mentions that overlap a shorter one which is cleaner or more like a name, and not much less sure."""

    def ousts(o: Column, m: Column) -> Column:
        overlap = (m["end"] > m["start"]) & (o["end"] > o["start"]) & (F.greatest(m["start"], o["start"]) < F.least(m["end"], o["end"]))
        near = overlap | F.contains(m["key"], o["key"]) | F.contains(o["key"], m["key"])
        why = m["suffix"] | (F.contains(m["key"], o["key"]) & o["named"])
        return (m["key"] != o["key"]) & near & why & (F.length(o["text"]) < F.length(m["text"])) & (o["confidence"] >= m["confidence"] - RIVAL)

    return F.filter(items, lambda m: ~F.exists(items, lambda o: ousts(o, m)))


def extract(questions: DataFrame, min_confidence: float = MIN_CONFIDENCE, max_mentions: int = MAX_MENTIONS) -> DataFrame:
    """query_id, rank, mention, start, end (code points, end exclusive), confidence of every question (query_id, query).

    Of possessive, relation and about patterns, the first that names something counts; of the other
    rules, all. Ranked by confidence, place, length; at most max_mentions a question. Null, empty
    and blank questions have none; repeated rows are each answered.
    """
    q = F.col("_q")
    found = questions.select("query_id", _strip(F.coalesce(F.col("query"), F.lit(""))).alias("_q")).filter("_q <> ''").withColumn("_raw", _raw(q))
    found = found.withColumn("_raw", F.filter("_raw", lambda m: m["text"] != "")).withColumn("_t", clean(F.transform("_raw", lambda m: m["text"])))
    found = found.withColumn("_m", F.filter(_with_text(F.col("_raw"), F.col("_t")), lambda m: valid(m["text"]) & (span(q, m["text"])["start"] >= 0)))
    one_pattern = lambda m: m["rule"].isin(0, 4, 5) | ~F.exists("_m", lambda o: (o["rule"] == m["rule"]) & (o["pattern"] < m["pattern"]))
    found = found.withColumn("_m", F.filter("_m", one_pattern)).withColumn("_t", clean(F.transform("_m", lambda m: m["text"])))
    sure = F.array(*map(F.lit, CONFIDENCE))

    def full(m: Column) -> Column:
        text, at = m["text"], span(q, m["text"])
        key = F.btrim(F.regexp_replace(F.translate(F.lower(text), "_", " "), r"(?U)\s+", " "), F.lit(EDGES))
        parts = (key.alias("key"), text.alias("text"), at["start"].alias("start"), at["end"].alias("end"), F.get(sure, m["rule"]).alias("confidence"), text.rlike(SUFFIX).alias("suffix"), text.rlike(NAME_LIKE).alias("named"))
        return F.struct(*parts)

    found = found.withColumn("_m", F.filter(_with_text(F.col("_m"), F.col("_t")), lambda m: valid(m["text"])))
    found = found.withColumn("_m", F.filter(F.transform("_m", full), lambda m: (m["start"] >= 0) & (m["confidence"] >= min_confidence)).cast(f"array<{_FULL}>"))
    found = found.withColumn("_m", _merged(F.col("_m"))).withColumn("_m", _pruned(F.col("_m")))
    order = F.transform("_m", lambda m, i: F.struct((-m["confidence"]).alias("c"), m["start"].alias("s"), F.length(m["text"]).alias("n"), i.alias("i"), m.alias("m")))
    top = F.slice(F.array_sort(order), 1, max_mentions)
    out = found.select("query_id", F.posexplode(top).alias("at", "o"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("o.m.text").alias("mention"), F.col("o.m.start").alias("start"), F.col("o.m.end").alias("end"), F.col("o.m.confidence").alias("confidence"))
