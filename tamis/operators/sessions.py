"""Session logs as tables: roll-ups, topics, summaries, intents, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import STOP_WORDS, text_or_empty

#: Words of code and of log metadata that name no topic. Fixed values.
NOISE_WORDS = (
    "task-notification task-id tool-use-id toolu output-file tmp claude-1000 system-reminder task-tools taskupdate taskcreate "
    "tasklist taskget taskstop taskoutput completed in_progress stale relevant reminder applicable mention agent agentid internal "
    "const let var function return import export from type interface class new async await true false null undefined string "
    "number boolean void any src dist node npm git file files code run error errors test tests https http www com json yaml yml "
    "tsx jsx css html env log console process path index config result results output input data value values name names key "
    "keys map set list array line lines total count check find add update create delete remove read write open close start stop "
    "end done status version build"
).split()


def topic_words(c) -> Column:
    """Distinct words of a message that may name a topic."""
    words = F.split(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z가-힣0-9 \\t\\n\\r\\f-]", " "), "[ \\t\\n\\r\\f]+")

    def names(w):
        usual = (F.length(w) > 2) & ~w.isin(*STOP_WORDS, *NOISE_WORDS)
        digits = ~w.rlike("^[0-9a-f]{6,}$") & ~w.rlike("^[0-9]+$")
        return usual & digits & ~w.startswith("-home-") & ~(w.contains("-") & w.rlike("[0-9a-f]{4,}"))

    return F.array_distinct(F.filter(words, names))


def session_topics(messages: DataFrame, k: int = 10, least: int = 3, id_col: str = "conv_id") -> DataFrame:
    """(id, rank, topic, n): words in at least `least` user messages of a session, the k commonest."""
    w = messages.where("role = 'user'").select(id_col, F.explode(topic_words("text")).alias("topic"))
    n = w.groupBy(id_col, "topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "topic"))).where(F.col("rank") <= k)


def session_rollup(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per session: messages, by role, characters, first and last turn, and a summary line."""
    first = F.min_by(F.when(F.col("role") == "user", text_or_empty("text")), F.when(F.col("role") == "user", F.col(turn_col)))
    line = F.coalesce(F.substring(F.split_part(first, F.lit("\n"), F.lit(1)), 1, 120), F.lit("Empty session"))
    out = messages.groupBy(id_col).agg(
        F.count("*").alias("n_messages"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length(text_or_empty("text"))).alias("n_chars"),
        F.min(turn_col).alias("first_turn"),
        F.max(turn_col).alias("last_turn"),
        line.alias("line"),
    )
    return out.select("*", F.concat("line", F.lit(" ["), F.col("n_messages").cast("string"), F.lit(" messages]")).alias("summary")).drop("line")


def replies(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, turn, waited, request_chars): every assistant turn with the user turn it answers, up to four turns back."""
    w = Window.partitionBy(id_col).orderBy(turn_col).rowsBetween(-4, -1)
    user = lambda c: F.last(F.when(F.col("role") == "user", c), ignorenulls=True).over(w)
    out = messages.withColumn("asked", user(F.col(turn_col))).withColumn("request_chars", user(F.length(text_or_empty("text"))))
    return out.where("role = 'assistant' and asked is not null").select(id_col, turn_col, (F.col(turn_col) - F.col("asked")).alias("waited"), F.col("request_chars").cast("long").alias("request_chars"))
