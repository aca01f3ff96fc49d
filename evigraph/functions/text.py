"""Text normalisers, tokenizers and match scores as Column functions.

The variants differ on purpose; each is named by what uses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in keyword search, in re-ranking and in evidence scoring.
KEYWORD_STOPS = "的 了 和 与 或 是 有 在 对 中 什么 哪些 哪个 怎么 如何 关系 介绍 说明 解释 the a an of and or to in on for with about what how why".split()
RERANK_STOPS = "的 了 和 与 或 是 有 在 中 对 为 什么 哪些 哪个 怎么 如何 关系 介绍 说明 解释 分析 the a an of and or to in on for with about what how why".split()
EVIDENCE_STOPS = "什么 怎么 如何 哪些 关系 联系 相关 the and for with what who how why which".split()
CJK = "一-鿿"


def clip(x: Column) -> Column:
    """Into [0, 1]; null and NaN give 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def light(text: Column) -> Column:
    """Lower case; _ and - as space; runs of white space as one; trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  "), r"\s+", " "))


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one, trimmed (evaluation's variant)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def mention(text: Column) -> Column:
    """Accents off, _ as space, white space collapsed, lower case, outer punctuation off.

    Accents of Latin letters are removed by a fixed map; other letters stay.
    """
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    one = F.trim(F.regexp_replace(F.translate(bare, "_", " "), r"\s+", " "))
    return F.regexp_replace(one, r"^[^a-z0-9\u0080-￿]+|[^a-z0-9\u0080-￿]+$", "")


# Accented Latin letters and their bases.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


# Outer punctuation, what a mention may begin or end with, and texts that name nothing.
OUTER = " \t\r\n.,;:!?，。；：！？\"'“”‘’()（）[]【】{}<>《》、"
PREFIXES = ("请问", "帮我看看", "帮我查一下", "帮我分析一下", "我想知道", "我想问", "关于", "有关", "介绍一下", "介绍", "解释一下", "解释", "说明一下", "说明", r"the\s+", r"a\s+", r"an\s+")
SUFFIXES = ("是什么", "是谁", "有哪些", "有什么", "怎么样", "怎么回事", "的关系", "之间的关系", "相关内容", "相关对象", "的信息", "的情况", r"\?", "？", "。", r"\.")
NO_ENTITY = (
    "谁", "什么", "哪里", "哪个", "哪些", "多少", "如何", "为什么", "怎么", "怎么办", "怎么样", "关系", "路径", "实体", "对象", "内容", "信息", "情况", "介绍", "说明", "解释", "分析",
    "这个", "那个", "它", "他", "她", "who", "what", "where", "which", "why", "how",
    "relation", "relationship", "path", "entity", "object", "thing", "information", "about", "explain", "describe", "tell", "me",
)


def entity_name(text: Column) -> Column:
    """White space collapsed and outer punctuation off; the case stays."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), F.lit(OUTER))


def node_key(text: Column) -> Column:
    """Accents off, _ and - as space, white space collapsed, lower case; punctuation stays."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.translate(bare, "_-", "  "), r"\s+", " "))


def clean_mention(text: Column) -> Column:
    """The name without the phrases that lead to it or follow it, each taken off once, in their order."""
    out = entity_name(text)
    for p in PREFIXES:
        out = F.trim(F.regexp_replace(out, f"(?i)^{p}", ""))
    for p in SUFFIXES:
        out = F.trim(F.regexp_replace(out, f"(?i){p}$", ""))
    return F.btrim(out, F.lit(OUTER))


def valid_entity(text: Column) -> Column:
    """Whether a text can name an entity: 1 to 120 characters, a single one only A to Z, neither digits nor signs alone, not a word that names nothing."""
    name = entity_name(text)
    single = (F.length(name) > 1) | name.rlike("^[A-Z]$")
    return (name != "") & (F.length(name) <= 120) & single & ~name.rlike(r"^\p{Nd}+$") & ~name.rlike(r"^[^\p{L}\p{N}]+$") & ~F.trim(F.lower(name)).isin(*NO_ENTITY)


def tokens(text: Column, stops: list[str]) -> Column:
    """Words of letters, digits and _, then runs of Chinese characters, then pairs of these in longer runs; distinct, in order."""
    body = light(text)
    words = F.regexp_extract_all(body, F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    runs = F.regexp_extract_all(body, F.lit(f"([{CJK}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 4), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    found = F.array_distinct(F.concat(words, runs, pairs))
    return F.array_except(found, F.array(*map(F.lit, stops))) if stops else found


def evidence_tokens(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(F.regexp_extract_all(low, F.lit(f"([{CJK}]{{2,}})"), F.lit(1)), F.regexp_extract_all(low, F.lit("([a-zA-Z0-9_]{2,})"), F.lit(1)))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, EVIDENCE_STOPS)))


def _hits(query: Column, body: Column) -> Column:
    return F.size(F.filter(query, lambda t: F.contains(body, t)))


def keyword_score(query: Column, text_tokens: Column, body: Column) -> Column:
    """Overlap of query tokens with a text: coverage, density and a bonus for the whole phrase; tokens inside words if there is no overlap."""
    common = F.size(F.array_intersect(query, text_tokens))
    scored = 0.65 * common / F.greatest(F.size(query), F.lit(1)) + 0.25 * common / F.greatest(F.size(text_tokens), F.lit(1)) + F.when(F.contains(body, F.array_join(query, " ")), 0.10).otherwise(0.0)
    hits = _hits(query, body)
    return F.when((F.size(query) == 0) | (F.size(text_tokens) == 0), 0.0).when(common > 0, clip(scored)).when(hits > 0, clip(0.25 + 0.1 * hits)).otherwise(0.0)


def overlap_score(query: Column, text_tokens: Column, body: Column) -> Column:
    """Re-ranking's overlap of query tokens with a text."""
    common = F.size(F.array_intersect(query, text_tokens))
    hits = _hits(query, body)
    scored = 0.75 * common / F.greatest(F.size(query), F.lit(1)) + 0.25 * common / F.greatest(F.size(text_tokens), F.lit(1))
    return F.when((F.size(query) == 0) | (F.size(text_tokens) == 0), 0.0).when(common > 0, clip(scored)).when(hits > 0, clip(0.2 + 0.1 * hits)).otherwise(0.0)


def _entity_form(text: Column) -> Column:
    """Trimmed, lower case; _ and - as space; runs of white space as one."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.translate(F.lower(trimmed), "_-", "  "), r"\s+", " ")


def entity_score(terms: Column, text: Column, metadata: Column) -> Column:
    """Share of entity terms that a text or its metadata holds; empty terms don't count, repeated ones do."""
    asked = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), _entity_form), lambda t: t != "")
    body = F.concat(_entity_form(text), F.lit(" "), _entity_form(metadata))
    hits = F.size(F.filter(asked, lambda t: F.contains(body, t)))
    return F.when(F.size(asked) == 0, 0.0).otherwise(hits / F.size(asked))


def length_score(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, 0.0).when(n.between(40, 500), 1.0).when(n.between(15, 39) | n.between(501, 1200), 0.75).when(n < 15, 0.45).otherwise(0.55)


def text_overlap(query: Column, text: Column) -> Column:
    """0.4 of the Jaccard similarity and 0.6 of the recall of the query's evidence tokens."""
    return token_overlap(evidence_tokens(query), evidence_tokens(text))


def token_overlap(a: Column, b: Column) -> Column:
    """text_overlap of a query's and a text's evidence tokens."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(clip(0.4 * both / F.size(F.array_union(a, b)) + 0.6 * both / F.size(a)))


def estimate_tokens(text: Column) -> Column:
    """ASCII characters by four and others by one and a half, at least 1; 0 for an empty text."""
    body = F.coalesce(text, F.lit(""))
    ascii_ = F.length(F.regexp_replace(body, r"[^\x00-\x7F]", ""))
    return F.when(body == "", 0).otherwise(F.greatest(F.lit(1), F.floor(ascii_ / 4 + (F.length(body) - ascii_) / 1.5).cast("int")))


def strip(text: Column) -> Column:
    """Without white space of any script around it; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")


def ascii_count(text: Column) -> Column:
    """How many ASCII characters a text has."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def prefix_tokens(text: Column, budget: int, ascii_before: Column | int = 0, others_before: Column | int = 0) -> Column:
    """The longest beginning of a text that keeps within budget, where so many characters come before it."""
    letters = F.split(F.substring(text, 1, 4 * budget + 4), "")
    first = [F.lit(x) if isinstance(x, int) else x for x in (ascii_before, others_before)]
    start = F.struct(first[0].cast("long").alias("a"), first[1].cast("long").alias("o"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        own = F.when(F.ascii(c) < 128, 1).otherwise(0)
        a, o, i = s["a"] + own, s["o"] + 1 - own, s["i"] + 1
        return F.struct(a.alias("a"), o.alias("o"), i.alias("i"), F.when(F.floor(a / 4 + o / 1.5) <= budget, i).otherwise(s["n"]).alias("n"))

    return F.substring(text, F.lit(1), F.aggregate(letters, start, step, lambda s: s["n"]))


def trim_tokens(text: Column, budget: int) -> Column:
    """The longest beginning of a text whose estimate is at most budget, without white space at its end; a text that fits stays as it is."""
    if budget <= 0:
        return F.lit("")
    body = F.coalesce(text, F.lit(""))
    return F.when(estimate_tokens(body) <= budget, body).otherwise(rstrip(prefix_tokens(body, budget)))


def quoted(text: Column) -> Column:
    """Texts within one of the pairs of quotes, without white space around them."""
    parts = [r'"([^"\n]{1,80})"', r"“([^”\n]{1,80})”", r"「([^」\n]{1,80})」", r"『([^』\n]{1,80})』", r"《([^》\n]{1,80})》"]
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in parts))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def proper_names(text: Column) -> Column:
    """Runs of capitalised ASCII words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Za-z0-9_.-]*(?: [A-Z][A-Za-z0-9_.-]*)*)\b"), F.lit(1))


# Questions that say too little, and patterns of the router, in their order.
VAGUE = ("这个呢", "这个是什么", "这是什么", "什么意思", "然后呢", "怎么办", "说说", "介绍一下", "它呢", "他呢", "她呢", "这个", "那个")
DIRECT = (
    "写一段", "帮我写", "写一个", "改写", "润色", "翻译", "总结(?:这段|以下|上面|本文|文章|邮件|代码)", "概括", "扩写", "缩写", "优化这段", "修改这段", "解释这段代码", "分析这段代码",
    "生成代码", "写代码", r"\bpython\b", r"\bjava\b", r"c\+\+", "报错", r"\bbug\b", "邮件", "简历", r"cover\s*letter", "论文润色", "摘要怎么写", "致谢怎么写", "语法", "计算",
)
RELATION = (
    "(.+?)(?:和|与)(.+?)(?:有什么关系|是什么关系|的关系|之间的联系)", "(.+?)到(.+?)(?:的路径|是否存在路径|怎么连接)", "(.+?)(?:通过什么路径|连接到|是否连接|是否认识)(.+)",
    "(.+?)(?:有哪些关系|有哪些邻居|相关实体|相关的实体)", "(.+?)(?:属于什么|属于哪一类|的上位实体|的下位实体)", "(?:查询|查找|寻找).*(?:关系|路径|邻居|三元组)",
    r"\b(?:relation|path|neighbor|triple|connected|related)\b",
)
FACTS = ("关系", "路径", "邻居", "三元组", "上位实体", "下位实体", "属于哪一类", "连接到", "是否连接", "相关实体")
ENTITY = ("^谁(?:是|和|与)", ".+(?:是谁|属于哪里|隶属于|创始人是谁|负责人是谁)$", "(?:哪两个|哪些).*(?:有关|相连|属于)", r"\bwho\s+is\b", r"\bwhich\b.*\b(?:related|connected|belongs)\b")


#: A boundary of a word of ASCII letters, digits and _ only.
ASCII_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def route(query: Column, ascii_words: bool = False) -> Column:
    """clarify, direct_llm or kg_rag; the first rule that holds decides.

    With ascii_words, a letter beyond ASCII ends a word, as in RE2's patterns; else it is part of the word.
    """
    bound = lambda p: p.replace(r"\b", ASCII_BOUND) if ascii_words else p
    q = F.trim(F.coalesce(query, F.lit("")))
    low = F.lower(q)
    compact = F.regexp_replace(low, r"[\s。！？!?，,；;：:]+", "")
    one_of = lambda patterns: low.rlike(bound("|".join(f"(?:{p})" for p in patterns)))
    capitals = F.size(F.regexp_extract_all(q, F.lit(bound(r"\b([A-Z][A-Za-z0-9_.-]*)\b")), F.lit(1)))
    return (
        F.when((F.length(low) <= 1) | compact.isin(*VAGUE), "clarify")
        .when(one_of(DIRECT), "direct_llm")
        .when(one_of(RELATION) | one_of(FACTS) | one_of(ENTITY) | (capitals >= 2), "kg_rag")
        .otherwise("direct_llm")
    )


# What counts as a secret in a memory.
SENSITIVE = (r"(?i)\b(api[_ -]?key|access[_ -]?token|secret|password|passwd)\b\s*[:=]\s*\S+", r"(?i)\bsk-[a-z0-9_-]{12,}\b", r"(?i)\b(bearer)\s+[a-z0-9._~-]{12,}\b")


def sensitive(text: Column) -> Column:
    return F.coalesce(F.greatest(*(text.rlike(p) for p in SENSITIVE)), F.lit(False))
