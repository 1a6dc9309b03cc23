"""Statistical signs of injected or encoded text: entropy, scripts, tokens, repetition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import count_matches, raw_tokens, text_or_empty

LATIN, CYRILLIC = "[A-Za-zÀ-ɏ]", "[Ѐ-ӿ]"
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{2060}-\\x{2069}\\x{FEFF}\\x{202A}-\\x{202E}]"


def character_histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ch, n) of every character of every text."""
    return docs.select(id_col, F.explode(F.split(F.col(text_col), "")).alias("ch")).where("ch <> ''").groupBy(id_col, "ch").agg(F.count("*").alias("n"))


def text_entropy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entropy): bits per character of the whole text; texts without characters are left out."""
    h = character_histogram(docs, id_col, text_col)
    sums = h.groupBy(id_col).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(id_col, F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def entropy_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 64, step: int = 16, most: float = 4.5, most_wide: float = 6.5) -> DataFrame:
    """(id, offset, bits) of windows above the threshold; a window that overlaps one already reported is skipped.

    Counting characters in every window is quadratic in native functions, so windows are sorted and counted in bulk.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def bits_of(windows: np.ndarray) -> np.ndarray:
        x = np.sort(windows, axis=1)
        new = np.ones(x.shape, bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]
        at = np.flatnonzero(new.ravel())
        n = np.diff(np.append(at, x.size)).astype(float)
        return np.log2(size) - np.bincount(at // size, n * np.log2(n), len(x)) / size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, offsets, bits = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                if len(codes) < size:
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(codes, size)[::step]
                wide = ((windows >= 0x2E80) & ((windows <= 0xD7FF) | ((windows >= 0xF900) & (windows <= 0xFAFF)) | ((windows >= 0xFF00) & (windows <= 0xFFEF)))).mean(1) > 0.3
                value, free = bits_of(windows), 0
                for k in np.flatnonzero(value > np.where(wide, most_wide, most)).tolist():
                    if k * step >= free:
                        ids.append(i)
                        offsets.append(k * step)
                        bits.append(round(float(value[k]), 6))
                        free = k * step + size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(offsets, pa.int32()), pa.array(bits, pa.float64())], names=["id", "offset", "bits"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, offset int, bits double")


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, repeats, offset) of one character twenty times or more, or a unit of two to eight characters; equal runs are
    told apart, each with its own place."""
    def runs(pattern):
        # what stands between two runs tells where the next one begins
        whole = F.lit("(" + pattern.replace("\\1", "\\2") + ")")
        cut = docs.select(id_col, text_or_empty(text_col).alias("t")).where(F.col("t").rlike(pattern)).select(id_col, F.regexp_extract_all("t", whole, F.lit(1)).alias("runs"), F.split("t", pattern).alias("parts"))
        size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
        placed = F.transform("runs", lambda r, i: F.struct(r.alias("run"), (size(F.slice("parts", 1, i + 1)) + size(F.slice("runs", 1, i))).alias("offset")))
        return cut.select(id_col, F.explode(placed).alias("r")).select(id_col, "r.run", "r.offset")

    one = runs("(.)\\1{19,}").select(id_col, F.substring("run", 1, 1).alias("unit"), F.length("run").alias("repeats"), "offset")
    more = runs("(.{2,8}?)\\1{19,}").withColumn("unit", F.regexp_extract("run", "^(.{2,8}?)\\1{19,}", 1)).where(F.size(F.array_distinct(F.filter(F.split("unit", ""), lambda c: c != ""))) > 1)
    return one.unionByName(more.select(id_col, "unit", F.floor(F.length("run") / F.length("unit")).cast("int").alias("repeats"), "offset"))


def script_mixing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, severity): sentences of Latin with Cyrillic."""
    s = docs.select(id_col, F.posexplode(F.split(text_col, "[.!?\\n]+")).alias("sentence_no", "s"))
    latin, cyrillic = F.col("s").rlike(LATIN), F.col("s").rlike(CYRILLIC)
    severity = F.when(latin & cyrillic, "high")
    return s.select(id_col, "sentence_no", severity.alias("severity")).where("severity is not null")


def encoding_signs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: share of invisible characters, and whether it bears the marks of base64 or percent encoding."""
    t, n = text_or_empty(text_col), F.greatest(F.length(text_or_empty(text_col)), F.lit(1))
    return docs.select(
        id_col,
        F.round(count_matches(text_col, INVISIBLE) / n, 6).alias("invisible"),
        (count_matches(text_col, INVISIBLE) / n > 0.05).alias("hidden"),
        ((F.length(t) >= 20) & (count_matches(text_col, "[+=]") / n > 0.03) & t.rlike("[A-Za-z0-9+/=]{40}")).alias("base64_like"),
        ((F.length(t) >= 20) & (count_matches(text_col, "%") / n > 0.05) & (count_matches(text_col, "%[0-9A-Fa-f]{2}") > 5)).alias("percent_like"),
    )


def token_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: total and distinct tokens, mean length, share of capitals among letters, long and mixed-script tokens."""
    k = docs.select(id_col, F.col(text_col).alias("t"), raw_tokens(text_col).alias("w"))
    letters, capitals = F.regexp_count(text_or_empty("t"), F.lit("[A-Za-z]")), F.regexp_count(text_or_empty("t"), F.lit("[A-Z]"))
    total = F.aggregate(F.transform("w", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)
    return k.select(
        id_col,
        F.size("w").cast("long").alias("total_tokens"),
        F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x)))).cast("long").alias("unique_tokens"),
        F.when(F.size("w") > 0, F.round(total / F.size("w"), 2)).otherwise(0.0).alias("mean_length"),
        F.when(letters > 0, F.round(capitals / letters, 3)).otherwise(0.0).alias("uppercase_ratio"),
        F.size(F.filter("w", lambda x: F.length(x) > 50)).cast("long").alias("long_tokens"),
        F.size(F.filter("w", lambda x: x.rlike(LATIN) & x.rlike(CYRILLIC))).cast("long").alias("mixed_tokens"),
    )


def repeated_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(id, token, n) of tokens, in lower case, that a text repeats."""
    w = docs.select(id_col, F.explode(raw_tokens(text_col)).alias("w")).groupBy(id_col, F.lower("w").alias("token")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= least)


def caps_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """(id, first_token, n) of runs of tokens whose letters, two or more, are all capitals."""
    w = docs.select(id_col, F.posexplode(raw_tokens(text_col)).alias("p", "w"))
    letters = F.regexp_replace("w", "[^a-zA-Z]", "")
    caps = w.where((F.length(letters) >= 2) & (letters == F.upper(letters)))
    run = caps.withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy(id_col).orderBy("p")))
    return run.groupBy(id_col, "island").agg(F.min("p").alias("first_token"), F.count("*").alias("n")).where(F.col("n") >= least).select(id_col, "first_token", "n")
