"""Search by more than the words of a query: stems, loanwords, synonyms and neighbours, over weighted memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import tokens
from tamis.functions.words import LOANWORDS, STEM_RULES, stem, transliterate
from tamis.operators.store import met_terms, text_sizes

#: What a term's frequency counts for if its stem is met instead of it, or its loanword. Loss of weight a day.
STEM_WEIGHT, LOAN_WEIGHT, DECAY = 0.7, 0.6, 0.005
#: Up to so many words are looked for in the tasks that read the memories; they are broadcast.
SENT_WORDS = 1_000_000


def _forms(t: Column) -> Column:
    """A token, its stem where that differs, and its loanword."""
    return F.array_compact(F.array(t, F.when(stem(t) != t, stem(t)), transliterate(t)))


def term_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): every token, its stem where that differs, and its loanword; one key may come from several tokens.

    Null texts have none; rows that share an id count as one."""
    return docs.select(id_col, F.explode(tokens(text_col)).alias("t")).select(id_col, F.explode(_forms(F.col("t"))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def _words_of(terms: DataFrame) -> DataFrame:
    """(word, term): all words that term_keys() has under each distinct term, whatever text holds them: no more than one for
    each rule of stems and each loanword."""
    t = F.col("term")
    by_rule = [F.when(t.endswith(put), F.concat(F.left(t, F.length(t) - len(put)), F.lit(suffix))) for suffix, put, _ in STEM_RULES]
    loans: dict[str, list[str]] = {}
    for ko, en in LOANWORDS.items():
        loans.setdefault(ko, []).append(en)
        loans.setdefault(en, []).append(ko)
    other = F.try_element_at(F.create_map(*[F.lit(x) for pair in loans.items() for x in pair]), t)
    may = F.array_compact(F.concat(F.array(t, *by_rule), F.coalesce(other, F.array().cast("array<string>"))))
    return terms.select("term", F.explode(F.array_distinct(may)).alias("word")).where(F.array_contains(_forms(F.col("word")), t)).select("word", "term")


def synonyms(groups: DataFrame, group_col: str = "group", word_col: str = "word") -> DataFrame:
    """(word, synonym) from words that share a group, in lower case; a word is no synonym of its own."""
    w = groups.select(F.col(group_col).alias("g"), F.lower(word_col).alias("word")).where("g is not null and word is not null").distinct()
    return w.join(w.withColumnRenamed("word", "synonym"), "g").where("word <> synonym").select("word", "synonym").distinct()


def expand_queries(queries: DataFrame, known: DataFrame | None = None, related: DataFrame | None = None, per_word: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, source, related_to): the distinct tokens of queries and what they lead to, each once, by the first of
    the ways original, synonym, stem, transliteration, synonym of that, cooccurrence, in order of the query's tokens.

    known has (word, synonym); related (word, rank, neighbour), of which the first per_word count."""
    own = queries.select(F.col(id_col).alias("query_id"), F.posexplode(tokens(text_col)).alias("at", "w")).groupBy("query_id", "w").agg(F.min("at").alias("at"))
    row = lambda df, way, step, term, to, n: df.where(term.isNotNull()).select("query_id", "at", F.lit(step).alias("step"), term.alias("term"), F.lit(way).alias("source"), to.alias("related_to"), n.alias("n"))
    w, none = F.col("w"), F.lit("")
    rows = [row(own, "original", 0, w, F.lit(None).cast("string"), none), row(own, "stem", 2, F.when(stem(w) != w, stem(w)), w, none), row(own, "transliteration", 3, transliterate(w), w, none)]
    if known is not None:
        s = known.select(F.col("word").alias("_k"), "synonym")
        rows.append(row(own.join(s, w == F.col("_k")), "synonym", 1, F.col("synonym"), w, F.col("synonym")))
        loan = own.withColumn("t", transliterate(w)).where("t is not null")
        rows.append(row(loan.join(s, F.col("t") == F.col("_k")), "synonym", 4, F.col("synonym"), F.col("t"), F.col("synonym")))
    if related is not None:
        r = related.where(F.col("rank") <= per_word).select(F.col("word").alias("_k"), "neighbour", "rank")
        rows.append(row(own.join(r, w == F.col("_k")), "cooccurrence", 5, F.col("neighbour"), w, F.lpad(F.col("rank").cast("string"), 9, "0")))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    first = Window.partitionBy("query_id", "term").orderBy((F.col("step") > 0).cast("int"), "at", "step", "n")
    return every.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("query_id", "term", "source", "related_to")


def memory_search(store: DataFrame, asked: DataFrame, now: Column, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(query_id, rank, id, score): the k best memories for each query's terms (query_id, term).

    A term that a memory holds counts with its frequency, else its stem with 0.7 of that of the stem, else its loanword with
    0.6. Scores are BM25 with the rarity of the term as asked, times exp(-0.005 days since accessed_at), 0.5 + confidence / 2
    and 1 + 0.1 ln(1 + access_count); only scores above zero count, ties go by id. The store needs the columns confidence,
    access_count and accessed_at. Words that lead to no term asked for are dropped in the task that reads the memory; beyond
    SENT_WORDS of them, by a join.
    """
    rows = store.select(F.col(id_col).alias("id"), "confidence", "access_count", "accessed_at")
    texts = store.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    q = asked.select("query_id", F.col("term").alias("q")).distinct().persist()  # else what leads to it is worked out for every use
    forms = q.select("q").distinct().select("q", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("q").alias("term")), F.struct(F.lit(1).alias("way"), stem(F.col("q")).alias("term")), F.struct(F.lit(2).alias("way"), transliterate(F.col("q")).alias("term")))).alias("f")).select("q", "f.*").where("term is not null")
    wanted = _words_of(forms.select("term").distinct()).persist()
    words = wanted.select("word").distinct().limit(SENT_WORDS + 1).toArrow().column(0).to_pylist()
    if len(words) <= SENT_WORDS:
        posted, whole = met_terms(texts, words, "id", "text")
        keys = posted.withColumnRenamed("term", "word").join(wanted, "word").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
        sizes = text_sizes(texts, "id", "text")
    else:
        sizes = texts.select("id", F.size(tokens("text")).alias("len"))
        whole, keys = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")), term_keys(texts, "id", "text")
    whole = whole.first()
    met = keys.join(forms, "term")
    rarity = met.where("way = 0").groupBy("q").agg(F.count("*").alias("df"))
    rarity = rarity.select("q", F.log((F.lit(float(whole.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    best = met.groupBy("q", "id").agg(F.min(F.struct("way", "tf")).alias("m"))
    tf = F.col("m.tf") * F.element_at(F.array(F.lit(1.0), F.lit(STEM_WEIGHT), F.lit(LOAN_WEIGHT)), F.col("m.way") + 1)
    hits = best.select("q", "id", tf.alias("tf")).join(rarity, "q").join(sizes, "id").join(q, "q")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(whole.mean)))
    sums = hits.groupBy("query_id", "id").agg(F.sum(part).alias("s")).join(rows, "id")
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("accessed_at").cast("timestamp"))) / 86_400_000_000
    score = F.round(F.col("s") * F.exp(-DECAY * days) * (0.5 + F.col("confidence") * 0.5) * (1 + F.log1p("access_count") * 0.1), 6)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return sums.select("query_id", "id", score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
