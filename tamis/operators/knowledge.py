"""Observations from texts and sessions: extraction, topics, tags, the store's views and updates, tips and facts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamis.functions.batches import counted, in_task, join_codes, lower_texts, token_spans
from tamis.functions.literals import held, may_match
from tamis.functions.text import STOP_WORDS, ascii_bounds, once, text_or_empty, tokens

#: Tags by what a text speaks of; one before a colon is the parent of those behind it. Fixed values.
TAGS = [
    ("security", "보안|security|안전|safety|취약|vulnerab"), ("security:injection", "injection|인젝션|주입|sqli|xss|ssrf|ssti"), ("security:auth", "인증|authentication|auth|login|oauth|jwt|토큰"),
    ("security:crypto", "암호|encrypt|decrypt|hash|cipher|tls|ssl"), ("security:exploit", "exploit|익스플로잇|payload|rce|reverse.?shell"), ("testing", "테스트|test|spec|coverage|jest|vitest|pytest|unittest"),
    ("devops", "deploy|배포|docker|ci\\/cd|npm|kubernetes|k8s|컨테이너"), ("devops:cloud", "aws|azure|gcp|클라우드|cloud|lambda|s3|ec2"), ("devops:monitoring", "모니터링|monitoring|logging|로깅|grafana|prometheus"),
    ("frontend", "react|vue|svelte|angular|css|html|component|프론트"), ("backend", "server|서버|api|database|sql|rest|graphql|백엔드"), ("backend:db", "database|데이터베이스|postgres|mysql|mongo|redis|sqlite"),
    ("git", "\\bgit\\b|commit|push\\b|branch|merge|\\bpr\\b|rebase"), ("performance", "성능|optimize|performance|cache|speed|latency|레이턴시"), ("debug", "debug|디버그|error|에러|bug|버그|crash|fix"),
    ("lang:typescript", "typescript|타입스크립트|\\.ts\\b"), ("lang:python", "python|파이썬|\\.py\\b|\\bpip\\b|conda"), ("lang:go", "\\bgo\\b|golang|\\.go\\b"), ("lang:rust", "rust|cargo|\\.rs\\b"),
    ("ai", "ai\\b|인공지능|machine.?learning|llm|gpt|claude|모델"), ("ai:prompt", "prompt|프롬프트|injection|system.?prompt"), ("ai:mcp", "mcp|model.?context|tool.?use"),
    ("research", "연구|research|논문|paper|학술|academic|재단"), ("policy", "정책|policy|법제도|규제|regulation|government|정부"), ("social-problem", "사회문제|social.?problem|재난|disaster|교통|주거|환경"),
    ("technology-matching", "기술.?매칭|tech.?match|솔루션|solution|실증|demonstration"), ("data-collection", "데이터.?수집|data.?collect|모니터링|crawl|scrape|크롤"), ("open-source", "오픈소스|open.?source|github|npm|mit.?license"),
]
#: Up to so many words' frequencies are sent to the tasks, at 16 bytes each.
SENT_WORDS = 8_000_000
#: Different words that a task counts before it passes them on.
HELD_WORDS = 500_000
#: What users want, the first that fits. Fixed values.
INTENTS = [
    ("코드 리뷰", "리뷰|review|검토|봐봐|봐줘|체크"), ("버그 수정", "fix|고치|수정|bug|에러|error|안돼|doesn.t work"), ("기능 구현", "만들|create|build|add|추가|implement|구현"), ("리팩토링", "refactor|리팩토|정리|clean|개선"),
    ("보안 분석", "보안|security|취약|vulnerab|audit|감사|scan"), ("배포", "deploy|배포|publish|push|release|npm"), ("테스트", "test|테스트|검증|verify"), ("디버깅", "debug|디버그|trace|로그|log"),
    ("설정", "설정|setup|install|config|설치"), ("분석", "분석|analyze|조사|찾아|search|scan"), ("문서화", "문서|doc|readme|설명"), ("최적화", "최적화|optimize|performance|성능|빠르"), ("아키텍처 매핑", "map|매핑|구조|architecture|onboard"),
]
#: What a tool does, in words. Fixed values.
STEPS = {"Bash": "명령어로 상태 확인", "Read": "파일 구조 파악", "Grep": "패턴 검색", "Edit": "코드 수정", "Write": "새 파일 생성", "Agent": "에이전트 위임", "WebSearch": "웹 검색"}
#: Languages of edited files. Fixed values.
LANGUAGES = {"ts": "TypeScript", "js": "JavaScript", "py": "Python", "rs": "Rust", "go": "Go", "java": "Java", "kt": "Kotlin", "swift": "Swift", "rb": "Ruby", "php": "PHP"}
CORRECTION = "(?i)아니|말고|대신|다시|바꿔|아닌데|그거\\s*말고|no[,.]?\\s*(not|don't|instead)|wait|actually|wrong|instead"
APPROVAL = "(?i)좋아|완벽|됐어|됐다|고마워|감사|ㅇㅇ|ㄱㄱ|ㅇㅋ|good|perfect|great|thanks|nice|works|다음|이제|next"
INSIGHT = "(?i)(?:이유는?|because|때문에|핵심은?|중요한\\s*(?:것|점)은?|결론은?|요약하면)\\s*[:：]?\\s*(.{20,120})"
#: Forms of advice, the first that fits, and words that no tip begins with. Fixed values.
TIPS = [
    ("명령어", "에서는?\\s+.{5,40}(?:해야|필요|써야|붙여야|사용해야)"), ("command", "(?:use|need|must|should|always|never)\\s+.{5,50}"), ("경로", "경로는?\\s+.{5,40}"), ("해결", "(?:해결|fix|solved|resolved).{5,40}(?:으로|by|with|via)"),
    ("설정", "(?:설정|config|set).{5,30}(?:해야|to|=)"), ("주의", "(?:주의|caution|warning|avoid|don't).{5,40}"), ("대신", ".{5,30}대신\\s+.{5,30}"), ("instead", ".{5,30}instead of\\s+.{5,30}"),
]
NO_TIP = ["users", "home", "mnt", "tmp", "claude", "dist", "src", "node", "npm", "git", "http", "https", "com", "org", "json", "file", "path", "data", "test", "true", "false", "null", "있습니다", "합니다", "입니다", "습니다", "했습니다", "대신", "주의", "에러", "하지", "그리고"]
FACTS = "(?i)^.{3,20}(?:는|은|이)\\s+.{3,40}(?:이다|입니다|다|임)|경로|path|url|port|version|버전|기본값|default|기본\\s*설정|호환|compatible|support|지원"
JUNK = ["(?i)^tool_(use|result)\\b", "(?i)\"(command|usage|input_?tokens|cache_?creation|file_?path)\"\\s*:", "(?s)^[{\\[].*[}\\]]$", "(?i)double press esc|to edit your message|re-read .*message", "^(cp|mv|rm|cd|ls|cat)\\s+[\"'/.]", "(?i)^(i need a|let me |okay,|sure,|thanks|알겠|좋아요?[,.]|잠깐|흠,)"]


def tags_of(c: Column) -> Column:
    """Tags of a text, in the order of the list; a parent is dropped where one of its children is there."""
    found = lambda x: F.array_compact(F.array(*[F.when(may_match(x["strings"], f"(?i){p}") & x["text"].rlike(ascii_bounds(f"(?i){p}")), F.lit(t)) for t, p in TAGS]))
    read = once(F.lower(c), lambda low: F.struct(low.alias("text"), held(low, [f"(?i){p}" for _, p in TAGS]).alias("strings")))
    return once(once(read, found), lambda tags: F.filter(tags, lambda t: t.contains(":") | ~F.exists(tags, lambda s: s.startswith(F.concat(t, F.lit(":"))))))


def label(c: Column, most: int = 80, otherwise: str = "unknown") -> Column:
    """A label of letters, digits, dots, underlines, colons and single hyphens, `most` characters at most."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}._:-]+", "-"), "-+", "-")
    short = F.substring(F.regexp_replace(clean, "^[-.:]+|[-.:]+$", ""), 1, most)
    return F.when(short == "", otherwise).otherwise(short)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, n, sentence): stretches of 16 to 499 characters between . ! ? and line ends, without markup,
    logs and numbers."""
    s = docs.select(id_col, *keep, F.posexplode(F.split(text_or_empty(text_col), "[.!?\\n]")).alias("n", "s")).select(id_col, *keep, "n", F.trim("s", F.lit(" \t\r\f")).alias("sentence"))
    size = F.length("sentence")
    return s.where((size > 15) & (size < 500) & ~F.col("sentence").rlike("(?i)^[<{]|task-notification|system-reminder|┌──") & ~F.col("sentence").rlike("^[0-9]+$"))


def _frequencies(spoken: DataFrame) -> DataFrame:
    """(code, n): in how many sentences each word stands; under code 0, how many hold a word at all."""

    def count(batches):
        import pyarrow as pa

        def rows(codes, n):
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

        codes, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            _, _, own, at = token_spans(*lower_texts(batch.column(0)))
            total += len(np.unique(at))
            # each word once a sentence
            own = own[np.unique(join_codes(own, at.astype(np.uint64)), return_index=True)[1]]
            codes, n = counted(np.concatenate([codes, own]), np.concatenate([n, np.ones(len(own), np.int64)]))
            if len(codes) > HELD_WORDS:
                yield rows(codes, n)
                codes, n = codes[:0], n[:0]
        yield rows(codes, n)
        yield rows(np.zeros(1, np.uint64), np.array([total]))

    return spoken.select("sentence").mapInArrow(in_task(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _best(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most of each text's values and its first place; at are texts by number, first where each begins."""
    most = np.maximum.reduceat(values, first)
    size = np.diff(np.append(first, len(values)))
    places = np.flatnonzero(values == np.repeat(most, size))
    return most, places[np.unique(at[places], return_index=True)[1]]


def _chosen(column, weights) -> list[str]:
    """The topics of sentences; weights gives what each code weighs alone."""
    data, offsets = lower_texts(column)
    starts, ends, codes, at = token_spans(data, offsets)
    out = ["general"] * len(column)
    if not len(codes):
        return out
    known, word = np.unique(codes, return_inverse=True)
    _, place, times = np.unique(at * len(known) + word, return_inverse=True, return_counts=True)
    v = times[place] * weights(known)[word]
    heavy, pair = v > 1, np.zeros(len(v))
    both = np.flatnonzero(heavy[:-1] & heavy[1:] & (at[:-1] == at[1:]))
    pair[both] = (v[both] + v[both + 1]) * 1.5
    texts, first = np.unique(at, return_index=True)
    one, one_at = _best(np.round(v, 6), at, first)
    two, two_at = _best(np.round(pair, 6), at, first)
    text, paired = data.tobytes(), two > one
    for row, p, i, j in zip(texts.tolist(), paired.tolist(), one_at.tolist(), two_at.tolist()):
        if p:
            out[row] = f"{text[starts[j] : ends[j]].decode()} {text[starts[j + 1] : ends[j + 1]].decode()}"
        else:
            out[row] = text[starts[i] : ends[i]].decode()
    return out


def topics(spoken: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of sentences() with topic: the word, or pair of neighbours, of most weight; general where there is no word.

    A word weighs its count times ln((N + 1) / (df + 1)) + 1 over all sentences; a pair one and a half of the sum of its
    words' weights if both are above 1. Of equal ones the first word counts, words before pairs. Document frequencies are
    those of the whole table, so the result does not hang on the order in which sentences come. The frequencies of words in
    two sentences or more go to the tasks, SENT_WORDS at most; beyond that, words are joined with them."""
    often = _frequencies(spoken).where("n > 1 or code = 0").persist()
    try:
        if often.count() > SENT_WORDS:
            return _topics_joined(spoken, id_col)
        found = often.toArrow()
    finally:
        often.unpersist()
    codes, n = found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = codes.argsort()
    sent = spoken.sparkSession.sparkContext.broadcast((codes[order], n[order]))

    def choose(batches):
        import pyarrow as pa

        codes, n = sent.value

        def weights(own):
            at = np.minimum(codes.searchsorted(own), len(codes) - 1)
            return np.log((float(n[0]) + 1) / (np.where(codes[at] == own, n[at], 1) + 1)) + 1

        for batch in batches:
            topic = pa.array(_chosen(batch.column("sentence"), weights), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, topic], names=[*batch.schema.names, "topic"])

    return spoken.mapInArrow(in_task(choose), StructType([*spoken.schema.fields, StructField("topic", StringType())]))


def _topics_joined(spoken: DataFrame, id_col: str) -> DataFrame:
    """topics() with frequencies joined to every word."""
    keys = [c for c in spoken.columns if c != "sentence"]
    # a row for the one element, as else a filter of sentences without words would split them a second time
    w = spoken.select(*keys, F.explode(F.array(tokens("sentence"))).alias("w"))
    # a run of so many characters is a word whatever it is, as no stop word is as long
    long = f"[a-z가-힣0-9-]{{{max(map(len, STOP_WORDS)) + 1}}}"
    total = spoken.where(F.lower("sentence").rlike(long) | (F.size(tokens("sentence")) > 0)).count()
    df = w.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", (F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    each = w.select(*keys, F.posexplode("w").alias("p", "term")).join(idf, "term")
    met = each.select(*keys, F.struct("p", "term", "idf").alias("t"), F.lit(None).cast("string").alias("sentence"))
    met = met.unionByName(spoken.select(*keys, F.lit(None).cast(met.schema["t"].dataType).alias("t"), "sentence"))
    # by texts, so that what is grouped by a text and something else later needs no other shuffle
    whole = met.repartition(F.col(id_col)).groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("t"), F.collect_list("sentence").alias("s"))
    weigh = lambda t: F.transform(t, lambda x: F.struct(x["term"].alias("term"), (F.size(F.filter(t, lambda y: y["term"] == x["term"])) * x["idf"]).alias("v")))

    def options(words):
        def of(x, i):
            after = F.get(words, i + 1)
            pair = F.when((x["v"] > 1) & (after["v"] > 1), F.struct(F.round((x["v"] + after["v"]) * 1.5, 6).alias("v"), (-i - 1_000_000).alias("p"), F.concat(x["term"], F.lit(" "), after["term"]).alias("topic")))
            return F.array(F.struct(F.round(x["v"], 6).alias("v"), (-i).alias("p"), x["term"].alias("topic")), pair)

        return F.array_max(F.flatten(F.transform(words, of)))

    best = whole.select(*keys, "s", once(once(F.col("t"), weigh), options)["topic"].alias("topic"))
    return best.select(*keys, F.explode("s").alias("sentence"), "topic").select(*spoken.columns, F.coalesce("topic", F.lit("general")).alias("topic"))


def extract_observations(docs: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source_id, domain, topic, content, tags, confidence, access_count, valid): of each text and topic the longest
    sentence, the first of equal ones. id is 12 hexadecimal digits of domain, topic and the content's first 50 characters;
    of observations with one id the one from the smallest source stays."""
    d = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"), label(F.col(domain_col)).alias("domain"))
    t = topics(sentences(d, id_col, "_text", ("domain",)), id_col)
    best = t.groupBy(id_col, "topic").agg(F.min(F.struct((-F.length("sentence")).alias("l"), "n", "sentence", "domain")).alias("b"))
    rows = best.select(id_col, label(F.col("topic"), otherwise="general").alias("topic"), F.col("b.sentence").alias("content"), "b.domain")
    rows = rows.withColumn("id", F.substring(F.sha2(F.concat_ws(":", "domain", "topic", F.substring("content", 1, 50)), 256), 1, 12))
    first = rows.groupBy("id").agg(F.min(F.struct(F.col(id_col).alias("source_id"), "content", "domain", "topic")).alias("o")).select("id", "o.*")
    return first.select("id", "source_id", "domain", "topic", "content", tags_of(F.col("content")).alias("tags"), F.lit(0.7).alias("confidence"), F.lit(0).alias("access_count"), F.lit(True).alias("valid"))


def ingest(docs: DataFrame, findings: DataFrame, store: DataFrame | None, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New observations of the documents without findings(id) and with no standing directive, unknown to the store."""
    from tamis.operators.injection import standing_directive

    clean = docs.join(findings.select(F.col(id_col).alias("_b")).distinct(), F.col(id_col) == F.col("_b"), "left_anti").where(standing_directive(text_or_empty(text_col)).isNull())
    found = extract_observations(clean, domain_col, id_col, text_col)
    found = found.where(standing_directive(F.col("content")).isNull())
    return found if store is None else found.join(store.select(F.col("id").alias("_s")), F.col("id") == F.col("_s"), "left_anti")


def find_observations(store: DataFrame, domain: str | None = None, topic: str | None = None, any_tag: list[str] | None = None) -> DataFrame:
    """Valid observations of a domain, a topic and with any of the tags, whichever are asked for."""
    out = store.where("valid")
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    return out if any_tag is None else out.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tag))))


def store_statistics(store: DataFrame) -> DataFrame:
    """One row: total, valid, domains, topics, mean_confidence and mean_access of the valid ones."""
    valid = F.col("valid")
    return store.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.countDistinct("domain").alias("domains"), F.countDistinct("topic").alias("topics"), F.round(F.avg(F.when(valid, F.col("confidence"))), 6).alias("mean_confidence"), F.round(F.avg(F.when(valid, F.col("access_count"))), 6).alias("mean_access"))


def touched(store: DataFrame, returned: DataFrame) -> DataFrame:
    """store with one access more for each returned id."""
    hit = returned.select(F.col("id").alias("_r")).distinct()
    return store.join(hit, F.col("id") == F.col("_r"), "left").withColumn("access_count", F.col("access_count") + F.col("_r").isNotNull().cast("int")).drop("_r")


def lean_view(store: DataFrame) -> DataFrame:
    """What is shown of observations: id, content, domain, tags, trusted; those with a standing directive are left out and
    an unknown source is not trusted."""
    from tamis.operators.injection import standing_directive

    return store.where(F.col("valid") & standing_directive(F.col("content")).isNull()).select("id", "content", "domain", "tags", F.col("source_id").isNotNull().alias("trusted"))


def is_junk(c: Column) -> Column:
    """Raw machine output or filler."""
    t = F.trim(c)
    out = F.length(t) < 12
    for p in JUNK:
        out = out | t.rlike(p)
    return out


def common_keywords(store: DataFrame, by: str = "domain", share: float = 0.5, most: int = 10) -> DataFrame:
    """(by, word, n): words in at least that share of a group's observations, `most` of them."""
    w = store.select(by, F.explode(F.array_distinct(tokens("content"))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    size = store.groupBy(F.col(by).alias("_g")).agg(F.count("*").alias("size"))
    often = w.join(size, F.col(by) == F.col("_g")).where(F.col("n") >= share * F.col("size"))
    return often.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))).where(F.col("r") <= most).select(by, "word", "n")


def _untagged(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "^\\[[^\\]]+\\]\\s*", ""))


def tips(store: DataFrame) -> DataFrame:
    """(id, trigger, advice, domain, confidence) of valid observations that advise something."""
    c = F.col("content")
    trigger = F.coalesce(*[F.when(c.rlike(f"(?i){p}"), F.lit(t)) for t, p in TIPS])
    advice = F.trim(F.regexp_replace(_untagged(c), "\\s+", " "))
    ok = F.col("valid") & F.length(c).between(15, 200) & ~c.startswith("[수정]") & ~c.rlike("^\\[.*\\]\\s*(명령어|파일|패턴|코드|에이전트)") & ~F.lower(F.split(c, "\\s")[0]).isin(*NO_TIP) & ~c.rlike("^\\||\\|---|대신\\s+.{0,5}$|^\\*\\*|^>")
    rows = store.where(ok).select("id", trigger.alias("trigger"), advice.alias("advice"), "domain", F.round(F.least(F.lit(0.8), F.col("confidence") + 0.1), 6).alias("confidence"))
    return rows.where("trigger is not null and length(advice) >= 15")


def facts(store: DataFrame) -> DataFrame:
    """(id, statement, domain, references) of valid observations that state something."""
    s = _untagged(F.col("content"))
    ok = F.col("valid") & F.length("content").between(10, 150) & s.rlike(FACTS) & ~s.rlike("^\\||^```|^http|^#|^\\*\\*|^>|대신|하지만|근본적") & (F.length(s) >= 15) & ~s.rlike("[:\\-—]$")
    return store.where(ok).select("id", s.alias("statement"), "domain", (F.col("access_count") + 1).alias("references"))


def knowledge(store: DataFrame, tier: str | None = None) -> DataFrame:
    """(tier, id, content, domain) of tips and facts, without those that carry a standing directive."""
    from tamis.operators.injection import standing_directive

    rows = tips(store).select(F.lit("tip").alias("tier"), "id", F.col("advice").alias("content"), "domain").unionByName(facts(store).select(F.lit("fact").alias("tier"), "id", F.col("statement").alias("content"), "domain"))
    rows = rows.where(standing_directive(F.col("content")).isNull())
    return rows if tier is None else rows.where(F.col("tier") == tier)


def knowledge_report(store: DataFrame) -> DataFrame:
    """(domain, observations, tips, facts)."""
    t = knowledge(store).groupBy(F.col("domain").alias("_d")).agg(F.count_if(F.col("tier") == "tip").alias("tips"), F.count_if(F.col("tier") == "fact").alias("facts"))
    return store.groupBy("domain").agg(F.count("*").alias("observations")).join(t, F.col("domain") == F.col("_d"), "left").select("domain", "observations", F.coalesce("tips", F.lit(0)).alias("tips"), F.coalesce("facts", F.lit(0)).alias("facts"))


def intent_of(c: Column) -> Column:
    """What a user wants, null if nothing fits."""
    return F.coalesce(*[F.when(F.lower(c).rlike(f"(?i){p}"), F.lit(n)) for n, p in INTENTS])


def approach_of(calls: Column) -> Column:
    """The tools of a turn in words, each once, in order."""
    names = F.array_distinct(F.transform(calls, lambda c: c["name"]))
    words = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    return F.array_join(F.transform(names, lambda n: F.coalesce(words[n], F.concat(n, F.lit(" 사용")))), " → ")


def domain_of_path(c: Column) -> Column:
    """The last part of a path, unknown for an empty one."""
    parts = F.filter(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit("unknown"))


def paired_calls(uses: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Tool uses with the result of the same id in the same message, null where none came."""
    r = results.select(*[F.col(k).alias(f"_{k}") for k in key], "result").dropDuplicates([f"_{k}" for k in key])
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    return uses.join(r, on, "left").drop(*[f"_{k}" for k in key])


def session_tools(messages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per session: tools used, files modified (by Edit and Write), both in order of name, and the last folder worked in."""
    called = messages.select(id_col, "turn", F.explode_outer("calls").alias("c"))
    changed = F.when(F.col("c.name").isin("Edit", "Write"), F.col("c.path"))
    folder = F.when(F.col("c.path").isNotNull(), F.regexp_replace("c.path", "/[^/]*$", ""))
    return called.groupBy(id_col).agg(F.sort_array(F.collect_set("c.name")).alias("tools"), F.sort_array(F.collect_set(changed)).alias("files"), F.max_by(folder, F.when(folder.isNotNull(), F.struct("turn", "c.path"))).alias("folder"))


def session_observations(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, turn, kind, text): what a session teaches. messages hold role, text and calls (name, path, result).

    approach: two tools or more after a request with an intent, up to four turns back; correction: a user's correction
    between two assistant turns, up to three away; recovery: a failing tool and a turn without failures within three; validated:
    approval right after two tools or more; insight: an explaining phrase of a long turn without tools; edit: a changed file
    in a known language. Windows only, one shuffle by session."""
    order = Window.partitionBy(id_col).orderBy(turn_col)
    back = lambda n: order.rowsBetween(-n, -1)
    m = messages.withColumn("t", text_or_empty("text")).withColumn("n_calls", F.size("calls"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    m = m.withColumn("request", F.last(F.when(user & (F.length("t") > 10) & ~F.col("t").startswith("<"), F.col("t")), ignorenulls=True).over(back(4)))
    said = F.when(assistant & (F.length("t") > 10), F.when(F.col("n_calls") > 0, approach_of(F.col("calls"))).otherwise(F.substring("t", 1, 80)))
    m = m.withColumn("said", said).withColumn("approach", approach_of(F.col("calls"))).withColumn("intent", intent_of(F.col("request")))
    m = m.withColumn("was", F.last("said", ignorenulls=True).over(back(3))).withColumn("then", F.first("said", ignorenulls=True).over(order.rowsBetween(1, 3)))
    bad = F.exists("calls", lambda c: c["result"].rlike("(?i)error|fail|denied|not found"))
    fine = assistant & (F.col("n_calls") > 0) & ~F.exists("calls", lambda c: c["result"].rlike("(?i)error|fail"))
    m = m.withColumn("bad", assistant & F.coalesce(bad, F.lit(False))).withColumn("fix", F.first(F.when(fine, F.col("approach")), ignorenulls=True).over(order.rowsBetween(1, 3)))
    before = lambda c: F.lag(c).over(order)
    m = m.withColumn("b_role", before("role")).withColumn("b_calls", before("n_calls")).withColumn("b_approach", before("approach")).withColumn("b_intent", before("intent"))
    plain = (F.length("t") >= 20) & ~F.col("t").startswith("<") & ~F.col("t").startswith("{")
    tool = F.get(F.filter("calls", lambda c: c["result"].rlike("(?i)error")), 0)["name"]
    insight = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("t", INSIGHT, 1), "\\*\\*", ""), "`", ""))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    edits = F.transform(F.filter("calls", lambda c: (c["name"] == "Edit") & language[F.lower(F.element_at(F.split(c["path"], "\\."), -1))].isNotNull()), lambda c: F.concat(F.lit("["), F.col("intent"), F.lit(":"), language[F.lower(F.element_at(F.split(c["path"], "\\."), -1))], F.lit("] 코드 수정으로 해결")))

    def one(kind, on, text):
        return F.when(on, F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))

    found = F.concat(
        one("approach", plain & assistant & (F.col("n_calls") >= 2) & F.col("intent").isNotNull() & (F.length("approach") > 20), F.concat(F.lit("["), F.col("intent"), F.lit("] "), F.col("approach"))),
        one("correction", plain & user & F.col("t").rlike(CORRECTION) & (F.length("was") > 10) & (F.length("then") > 10), F.concat(F.lit("[수정] "), F.substring("was", 1, 40), F.lit(" 대신 "), F.substring("then", 1, 40))),
        one("recovery", plain & F.col("bad") & F.col("fix").isNotNull(), F.concat(F.lit("에러 복구: "), F.coalesce(tool, F.lit("도구")), F.lit(" 실패 후 "), F.col("fix"), F.lit("로 해결"))),
        one("validated", plain & user & F.col("t").rlike(APPROVAL) & (F.col("b_role") == "assistant") & (F.col("b_calls") >= 2) & F.col("b_intent").isNotNull() & (F.length("b_approach") > 20), F.concat(F.lit("["), F.col("b_intent"), F.lit(":성공] "), F.col("b_approach"))),
        one("insight", plain & assistant & (F.length("t") > 100) & (F.col("n_calls") == 0) & (F.length(insight) > 20) & (F.length(insight) < 120), F.concat(F.lit("[인사이트] "), insight)),
        F.when(plain & assistant & F.col("intent").isNotNull(), F.transform(edits, lambda e: F.struct(F.lit("edit").alias("kind"), e.alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")),
    )
    return m.select(id_col, turn_col, F.explode(found).alias("f")).select(id_col, turn_col, "f.kind", "f.text")
