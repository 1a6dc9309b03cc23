"""Benchmark decontamination by template windows: typed placeholders for numbers, names and units, and slot checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import chunks, flat_texts, gram_hash, in_task, mix, word_hashes, word_spans

#: Words of a template window; an item with fewer words is one window.
WINDOW = 8
#: A window with fewer literal words than this is hashed with its fillers, or templates of placeholders meet anything.
LEAST_LITERALS = 4
#: Share of an item's windows that one stretch of a document must hold, or so many windows in all.
LEAST_SHARE, LEAST_WINDOWS = 0.5, 13
#: Up to so many benchmark windows their hashes are sent to the tasks (8 bytes each) to drop other windows early.
SENT_WINDOWS = 2_000_000
#: Up to so many contaminated documents their ids are broadcast when rows are dropped (8 bytes each).
SENT_IDS = 200_000
#: Unit names that follow a number. Fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs d day days week weeks month months year years hour hours minute minutes second seconds mph kmh w kw v a hz khz mhz ghz kb mb gb tb c f k usd eur gbp dollars euros cents percent meters metres kilometers kilometres miles feet inches pounds grams kilograms liters litres"

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 punctuation, 2 digit
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA11, 0xA22, 0xA33))
_unit_hashes: list = []


def _of_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without case, as Unicode folds it; the words stay as many as they were."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of every word at each level, and the texts' bounds; words lose punctuation and case.

    Level 0 holds the word itself, level 1 types numbers and units, level 2 names as well. A number is a word of digits
    and punctuation; a unit is a listed unit right after a number; a name is a capitalised word that neither begins a
    text nor follows a word that ends in one of . ! ? : ; or a line's end. Only level 2 goes by the text's case.
    """
    starts, _, _ = word_spans(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * 3, np.zeros(len(offsets), np.int64)
    lead = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    data, offsets = folded(data, offsets)
    starts, ends, _ = word_spans(data, offsets)
    kind = _CLASS[data]
    punct = np.concatenate([[0], np.cumsum(kind == 1)])
    digit = np.concatenate([[0], np.cumsum(kind == 2)])
    whole = (ends - starts) > (punct[ends] - punct[starts])  # words of punctuation alone are no words
    starts, ends, capital = starts[whole], ends[whole], capital[whole]
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * 3, bounds
    keep = kind != 1
    shift = np.concatenate([[0], np.cumsum(keep)])
    literal = word_hashes(data[keep], shift[starts], shift[ends])
    digits = digit[ends] - digit[starts]
    number = (digits > 0) & (digits + punct[ends] - punct[starts] == ends - starts)
    fresh = np.ones(len(starts), bool)
    last = data[ends[:-1] - 1]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    fresh[1:] = np.isin(last, np.frombuffer(b".!?:;", np.uint8)) | (breaks[starts[1:]] > breaks[ends[:-1]])
    fresh[bounds[:-1][bounds[:-1] < len(starts)]] = True
    if not _unit_hashes:
        _unit_hashes.append(np.sort(_of_words(UNITS.split())))
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    after[bounds[:-1][bounds[:-1] < len(starts)]] = False
    unit = after & np.isin(literal, _unit_hashes[0])
    typed = np.where(number, _NUMBER, np.where(unit, _UNIT, literal))
    return [literal, typed, np.where(capital & ~fresh & ~number & ~unit, _NAME, typed)], bounds


def _windows(data, offsets, widths=None):
    """(text, first word, width, level) and hash of every template window, the levels' codes, and the texts' bounds.

    Every window is hashed by its words without case, and at each level that types some more of them and leaves enough.
    Windows are of the given widths; without these, of WINDOW words, or of all words of a text that has fewer.
    """
    levels, bounds = templates(data, offsets)
    sizes = np.diff(bounds)
    out = []
    for width in widths or (WINDOW, *sorted({int(s) for s in sizes if 0 < s < WINDOW})):
        first = np.arange(max(len(levels[0]) - width + 1, 0))
        text = np.searchsorted(bounds, first, side="right") - 1
        ok = (first + width <= bounds[text + 1]) & (bool(widths) | (sizes[text] == width) | (width == WINDOW))
        fewer = np.zeros(len(first), np.int64)
        for level, code in enumerate(levels):
            filled = np.concatenate([[0], np.cumsum(code != levels[0])])
            slots = filled[first + width] - filled[first]
            at = np.flatnonzero(ok & ((level == 0) | (slots > fewer) & (width - slots >= min(LEAST_LITERALS, width))))
            h = gram_hash(code, width)[at]
            out.append((text[at], first[at], np.full(len(at), width), np.full(len(at), level), mix(h + np.uint64(1)) if level == 0 else h))
            fewer = slots
    text, first, width, level, h = (np.concatenate(x) for x in zip(*out))
    return (text, first, width, level), h, levels, bounds


def template_windows(texts: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None, widths: list[int] | None = None) -> DataFrame:
    """Rows (id, pos, width, h, fills): every window and level, or those whose hash is in only; fills are the hashes of what the
    level's slots hold, none where the words themselves are hashed."""
    kind = texts.schema[id_col].dataType.simpleString()
    sent = None if only is None else texts.sparkSession.sparkContext.broadcast(np.sort(only))

    def scan(batches):
        import pyarrow as pa

        known = None if sent is None else sent.value
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                (text, first, width, level), h, levels, bounds = _windows(data[part[0] : part[-1]], part - part[0], widths)
                if known is not None:
                    at = np.searchsorted(known, h)
                    hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h)) if len(known) else []
                    text, first, width, level, h = text[hit], first[hit], width[hit], level[hit], h[hit]
                codes, literal = np.array(levels), levels[0]
                for c in range(0, len(h), 100_000):
                    t, f, w, k = (x[c : c + 100_000] for x in (text, first, width, level))
                    at = f[:, None] + np.arange(WINDOW)
                    inside = np.arange(WINDOW) < w[:, None]
                    at = np.minimum(at, len(literal) - 1)
                    slot = inside & (codes[k[:, None], at] != literal[at])
                    fills = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(slot.sum(1))]), pa.int32()), pa.array(literal[at][slot].view(np.int64)))
                    ids = batch.column(0).take(pa.array(t + a))
                    yield pa.RecordBatch.from_arrays([ids, pa.array((f - bounds[t]).astype(np.int64)), pa.array(w.astype(np.int32)), pa.array(h[c : c + 100_000].view(np.int64)), fills], names=["id", "pos", "width", "h", "fills"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(in_task(scan), f"id {kind}, pos long, width int, h long, fills array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: id, item_id, n_windows (distinct windows met), share, reworded.

    A document holds an item when one stretch of it meets at least half of the item's windows (or LEAST_WINDOWS of
    them), by their words whatever their case or by a template. A stretch is one alignment of the two, or neighbouring
    ones that words put in or left out (up to about half as many as the item has) set apart. Windows that meet by a template alone count where the
    stretch's slots are consistent: whatever fills a slot of the item is everywhere in them replaced by the same thing.
    An item of fewer than WINDOW words is one window, looked for at every place of every document: an item of one or
    two words is held by all documents with these words. With fewer than LEAST_LITERALS literal words of its own, an
    item is met by its words only.
    reworded says that some slot was filled differently. Null and empty texts hold nothing;
    documents with a null id are compared like others and share their decision; repeated rows count once; items with
    equal texts are all reported; empty tables give no rows.
    """
    from tamis.llm.common import materialize

    items = materialize(template_windows(benchmark, item_col, item_text_col).dropDuplicates(["id", "pos", "h"]), "bench-windows")
    only = None
    if items.count() <= SENT_WINDOWS:
        only = np.array([r.h for r in items.select("h").distinct().collect()], np.int64).view(np.uint64)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WINDOW values at most
    found = template_windows(docs, id_col, text_col, only, widths)
    i = items.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "h", F.col("fills").alias("item_fills"))
    met = found.join(i, "h").where(F.size("fills") == F.size("item_fills")).withColumn("shift", F.col("pos") - F.col("item_pos")).dropDuplicates(["id", "item", "item_pos", "shift", "h"])
    met = materialize(met, "bench-met")
    sizes = items.groupBy(F.col("id").alias("item")).agg(F.countDistinct("pos").alias("size"), (F.max("pos") + F.max("width")).alias("words"))
    # a stretch is one shift (part 0), or a band of shifts (part 1) narrower than the item, so that its next copy is in another
    band = F.floor(F.col("shift") / F.greatest(F.floor(F.col("words") / 2), F.lit(1)))
    parts = F.array(*(F.struct(F.lit(part).alias("part"), key.alias("key")) for part, key in ((0, F.col("shift")), (1, band), (1, band - 1))))
    near = met.join(sizes, "item").withColumn("stretch", F.explode(parts))
    at = near.groupBy("id", "item", "stretch", "item_pos").agg(F.max(F.size("fills") == 0).alias("literal"), F.collect_set(F.arrays_zip("fills", "item_fills")).alias("z"))
    slots = at.where(~F.col("literal")).select("id", "item", "stretch", F.explode(F.flatten("z")).alias("z")).groupBy("id", "item", "stretch", F.col("z.item_fills").alias("was")).agg((F.min("z.fills") != F.max("z.fills")).alias("torn"))
    torn = slots.where("torn").select(F.col("id").alias("o_id"), F.col("item").alias("o_item"), F.col("stretch").alias("o_stretch")).distinct().withColumn("torn", F.lit(True))
    sums = at.groupBy("id", "item", "stretch").agg(F.count("*").alias("n"), F.sum(F.col("literal").cast("long")).alias("n_literal"))
    sums = sums.join(torn, F.col("id").eqNullSafe(F.col("o_id")) & F.col("item").eqNullSafe(F.col("o_item")) & (F.col("stretch") == F.col("o_stretch")), "left").withColumn("n_windows", F.when(F.col("torn"), F.col("n_literal")).otherwise(F.col("n")))
    held = sums.join(sizes, "item").where((F.col("n_windows") >= LEAST_SHARE * F.col("size")) | (F.col("n_windows") >= LEAST_WINDOWS))
    out = held.groupBy("id", "item").agg(F.max("n_windows").alias("n_windows"), F.max(F.col("n_windows") / F.col("size")).alias("share"), F.min(F.col("n") > F.col("n_literal")).alias("reworded"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "n_windows", "share", "reworded")


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """One row per row of docs: id, contaminated, item_ids (ascending), reworded."""
    held = contaminated(docs, benchmark, id_col, text_col, **columns)
    by_doc = held.groupBy(F.col(id_col).alias("_held")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("reworded").alias("reworded"))
    kind = by_doc.schema["item_ids"].dataType
    rows = docs.select(id_col).join(by_doc, F.col(id_col).eqNullSafe(F.col("_held")), "left")
    return rows.select(id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(kind)).alias("item_ids"), F.coalesce("reworded", F.lit(False)).alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """docs without the contaminated documents; all columns are kept."""
    from tamis.llm.common import materialize

    bad = materialize(contaminated(docs, benchmark, id_col, text_col, **columns).select(F.col(id_col).alias("_held")).distinct(), "bench-bad")
    bad = F.broadcast(bad) if bad.count() <= SENT_IDS else bad
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_held"]), "left_anti")
