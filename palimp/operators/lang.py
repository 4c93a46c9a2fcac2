"""Language profiles and detection, literal masking, and pluggable translation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp import model
from palimp.functions.text import has_letter, squeeze
from palimp.operators.verify import stage
from palimp.session import ship_by_value

ship_by_value(__name__)

# Fragment separators and literal patterns, in their order.
SEPARATOR = r"\s*[|•·‣▪◦]\s*|\s{2,}"
LITERALS = [
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"(?i)\b(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|org|net|edu|io|gov)(?:/\S*)?\b",
    r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*,\s*[A-Z]{2}\b",
    r"\+?\d[\d\-\(\)\.\s]{6,}\d",
    r"\b(?:[A-Z]\.){1,}[A-Z]?\b",
    r"\b[A-Z]{2,5}\b",
    r"\b\d[\d,.\-/]*\b",
]
#: A character that every match of a pattern holds; texts without it are spared the pattern.
NEEDED = {LITERALS[0]: "@", LITERALS[2]: ","}
MIN_DETECT_LETTERS = 3
LOG_SCALE = 1_000_000
#: Bytes of one array of a language profile that goes out to the tasks.
PROFILE_BYTES = 64 << 20
#: Texts of one call of a model, and characters of its error that are kept.
MODEL_BATCH, ERROR_CHARS = 64, 100


# --- language profiles ----------------------------------------------------------------------------

def trigrams(text: Column) -> Column:
    """All overlapping three-character pieces: every third piece from three starting points."""
    t = F.lower(squeeze(text))
    return F.concat(*[F.regexp_extract_all(F.substring(t, i, 1 << 30) if i > 1 else t, F.lit("(?s).{3}"), F.lit(0)) for i in (1, 2, 3)])


def train_profile(labelled: DataFrame) -> DataFrame:
    """(lang, text) to (lang, gram, n, total, logp); logp is the scaled integer log share of the gram in its language."""
    known = labelled.where(F.col("lang").isin(list(model.LANGUAGES)))
    grams = known.select("lang", F.explode_outer(trigrams(F.col("text"))).alias("gram")).where("gram is not null")
    counts = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    # One row per supported language.
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total")))
    return counts.join(totals, "lang").withColumn("logp", _scaled_log(F.col("n"), F.col("total")))


def _scaled_log(n: Column, total: Column) -> Column:
    return F.round(F.ln(n / total) * LOG_SCALE).cast("bigint")


def _gram_id(gram: Column) -> Column:
    """The three code points of a gram in one number, so that no two grams share one."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("bigint")  # noqa: E731  the code point, also beyond ASCII
    return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)


def _profile_parts(profile: DataFrame, floors: dict[str, int], most_bytes: int):
    """Sorted gram ids and, per language, what a gram adds over the floor; in parts of bounded size, by ranges of ids."""
    langs = sorted(floors)
    known = [F.coalesce(F.max(F.when(F.col("lang") == c, F.col("logp") - floors[c])), F.lit(0)).cast("int").alias(c) for c in langs]
    wide = profile.groupBy("gram").agg(*known).select(_gram_id(F.col("gram")).alias("id"), *langs)
    n = wide.count()
    n_parts = max(1, -(-n * (8 + 4 * len(langs)) // most_bytes))
    if n_parts > 1:
        wide = stage(wide, "profile-wide")
        cuts = wide.approxQuantile("id", [i / n_parts for i in range(1, n_parts)], 0.25 / n_parts)
        edges = [None, *sorted({int(c) for c in cuts}), None]
    else:
        edges = [None, None]
    for low, high in zip(edges, edges[1:]):
        mine = wide.where((F.lit(low is None) | (F.col("id") >= F.lit(low or 0))) & (F.lit(high is None) | (F.col("id") < F.lit(high or 0))))
        held = mine.toArrow()
        ids = held["id"].to_numpy()
        order = np.argsort(ids)
        gain = np.stack([held[c].to_numpy() for c in langs], axis=1)[order] if langs else np.zeros((len(ids), 0), dtype=np.int32)
        yield ids[order], gain


def _part_scores(ids: np.ndarray, gain: np.ndarray):
    """The sum over a text's grams of what those in this part of the profile add, per language, by binary search."""

    @F.pandas_udf("array<bigint>")
    def scores(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            total = np.zeros(gain.shape[1], dtype=np.int64)
            if len(codes) < 3 or not len(ids):
                return total
            grams, times = np.unique((codes[:-2] << 42) + (codes[1:-1] << 21) + codes[2:], return_counts=True)
            at = np.minimum(np.searchsorted(ids, grams), len(ids) - 1)
            known = ids[at] == grams
            return (gain[at[known]].astype(np.int64) * times[known, None]).sum(axis=0)

        return texts.map(one)

    return scores


def detect_language(texts: DataFrame, keys: list[str], profile: DataFrame, most_bytes: int = PROFILE_BYTES) -> DataFrame:
    """(keys.., text) to (keys.., lang): the language with the highest summed log share, ties by code.

    Null below three letters. The profile is a sorted array of packed grams; a text's grams are looked up in it inside the
    row, so nothing is exploded and nothing but the keys is moved. A profile beyond the bound goes out in several arrays,
    one after the other over the same row.
    """
    floors = {r.lang: r.floor for r in profile.select("lang", _scaled_log(F.lit(0.5), F.col("total")).alias("floor")).distinct().collect()}
    langs = sorted(floors)
    if not langs:
        return texts.select(*keys, F.lit(None).cast("string").alias("lang"))
    letters = F.coalesce(F.length(F.regexp_replace("text", r"\P{L}", "")), F.lit(0))
    plain = F.lower(squeeze(F.col("text")))
    parts = [_part_scores(ids, gain)(plain) for ids, gain in _profile_parts(profile, floors, most_bytes)]
    made = texts.select(*keys, (letters >= MIN_DETECT_LETTERS).alias("enough"), F.greatest(F.length(plain) - 2, F.lit(0)).cast("bigint").alias("n"), F.array(*parts).alias("parts"))
    score = lambda i, c: F.col("n") * floors[c] + F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p[i])
    best = F.array_max(F.array(*[F.struct(score(i, c).alias("s"), (-F.lit(i)).alias("o"), F.lit(c).alias("lang")) for i, c in enumerate(langs)]))
    return made.select(*keys, F.when(F.col("enough") & (F.col("n") > 0), best["lang"]).alias("lang"))


def document_language(detected: DataFrame, doc: str, order: str) -> DataFrame:
    """First detected language of each document in page order."""
    return detected.groupBy(doc).agg(F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col(order))).alias("lang"))


def carry_forward(blocks: DataFrame, doc: str, order: str, source: str | None = None) -> DataFrame:
    """Blocks without a language take the first one detected earlier in their document; an explicit source wins.

    The first detection is one row per document, found by aggregation, so no document is sorted.
    """
    if source is not None:
        return blocks.withColumn("effective", F.lit(source))
    found = F.when(F.col("lang").isNotNull(), F.col(order))
    first = blocks.groupBy(doc).agg(F.min(found).alias("_at"), F.min_by("lang", found).alias("_first"))
    return blocks.join(first, doc).withColumn(
        "effective", F.when(F.col(order) >= F.col("_at"), F.col("_first"))).drop("_at", "_first")


# --- literals -------------------------------------------------------------------------------------

def fragments(line: Column) -> Column:
    """Array of (part, sep): text between separators, and the separator after each."""
    p = "(?U)" + SEPARATOR
    parts, seps = F.split(line, p, -1), F.regexp_extract_all(line, F.lit(p), F.lit(0))
    return F.transform(parts, lambda x, i: F.struct(x.alias("part"), F.coalesce(F.get(seps, i), F.lit("")).alias("sep")))


def _pattern_spans(text: Column, pattern: str, needed: str = "") -> Column:
    """(s, e) of each match: the lengths of the pieces around the matches give the offsets.

    Matches and pieces are bound by a function of one element, so that each is found once per text and not once per match.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def placed(found: Column, pieces: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, F.size(acc["spans"])))
            end = start + F.length(m)
            return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("s"), end.alias("e"))).alias("spans"))

        return F.aggregate(found, empty, step, lambda acc: acc["spans"])

    def spans(found: Column) -> Column:
        split = F.array(F.split(text, pattern, -1))
        return F.when(F.size(found) == 0, none).otherwise(F.get(F.transform(split, lambda pieces: placed(found, pieces)), F.lit(0)))

    found = F.when(F.contains(text, F.lit(needed)) | text.isNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(found), spans), F.lit(0))


def term_pattern(term: str) -> str:
    special = set("\\^$.|?*+()[]{}")
    return r"(?U)\b" + "".join("\\" + c if c in special else c for c in term) + r"\b"


def literal_spans(text: Column, extra_terms: list[str] | None = None) -> Column:
    """Chosen literal spans: left-most first, longer first, none overlapping."""
    every = F.concat(*[_pattern_spans(text, term_pattern(t)) for t in extra_terms or []], *[_pattern_spans(text, "(?U)" + p, NEEDED.get(p, "")) for p in LITERALS])
    ordered = F.array_sort(F.transform(every, lambda r: F.struct(r["s"].alias("s"), (-r["e"]).alias("o"))))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<s:int,e:int>>").alias("chosen"))

    def choose(acc: Column, r: Column) -> Column:
        taken = F.struct((-r["o"]).alias("last"), F.array_append(acc["chosen"], F.struct(r["s"].alias("s"), (-r["o"]).alias("e"))).alias("chosen"))
        return F.when(r["s"] >= acc["last"], taken).otherwise(acc)

    return F.aggregate(ordered, start, choose, lambda acc: acc["chosen"])


#: Private-use code points, from which each text's marker is chosen.
PRIVATE = (0xE000, 0xF8FF)
_PRIVATE = f"[{chr(PRIVATE[0])}-{chr(PRIVATE[1])}]"


def marker(text: Column) -> Column:
    """A private-use character that the text does not hold; null where it holds them all."""
    every = F.transform(F.sequence(F.lit(PRIVATE[0]), F.lit(PRIVATE[1])), lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32"))
    used = F.regexp_extract_all(text, F.lit(_PRIVATE), F.lit(0))
    return F.when(F.size(used) == 0, F.lit(chr(PRIVATE[0]))).otherwise(F.get(F.array_except(every, used), F.lit(0)))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def mask(text: Column, spans: Column) -> Column:
    """(masked, saved, mark): spans become numbers between marks, counted from the last one; ``saved`` holds them by number.

    The mark is a character that the text does not hold, so nothing of the text is taken for a marker. A text that holds
    every such character is not masked.
    """
    mark = marker(text)
    spans = F.when(mark.isNull(), F.array().cast("array<struct<s:int,e:int>>")).otherwise(spans)
    n = F.size(spans)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit("").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        number = (n - 1 - acc["k"]).cast("string")
        return F.struct(r["e"].alias("at"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], cut(text, acc["at"], r["s"]), mark, number, mark).alias("out"))

    masked = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.length(text))))
    saved = F.reverse(F.transform(spans, lambda r: cut(text, r["s"], r["e"])))
    return F.struct(masked.alias("masked"), saved.alias("saved"), mark.alias("mark"))


def _pieces(text: Column, mark: Column) -> Column:
    """Text and marked numbers in turn."""
    return F.when(mark.isNull(), F.array(text)).otherwise(F.split(text, mark, -1))


def restore(text: Column, saved: Column, mark: Column) -> Column:
    """The text with its literals back, in one pass: what a literal holds is not searched again. A number that was not given
    out, or one without its closing mark, stays as it is."""
    pieces = _pieces(text, mark)

    def back(x: Column, i: Column) -> Column:
        literal = F.get(saved, x.try_cast("int"))
        closed = i < F.size(pieces) - 1
        return F.when(i % 2 == 0, x).when(closed & literal.isNotNull(), literal).otherwise(F.concat(mark, x, F.when(closed, mark).otherwise(F.lit(""))))

    return F.array_join(F.transform(pieces, back), "")


def residual(masked: Column, mark: Column) -> Column:
    """What is left of a masked text without its markers."""
    return F.array_join(F.filter(_pieces(masked, mark), lambda x, i: i % 2 == 0), "")


# --- translation ----------------------------------------------------------------------------------

def told(translate: Callable[[list[str]], list[str]], texts: list[str]) -> list[tuple[str, str | None]]:
    """(text, error) for each text. A model must give one text for each it gets; a call that raises or breaks this is halved
    until the texts it fails on stand alone, and these keep their source with the error."""
    try:
        given = list(translate(texts))
        if len(given) != len(texts):
            raise ValueError(f"model gave {len(given)} texts for {len(texts)}")
        if not all(isinstance(t, str) for t in given):
            raise TypeError("model gave something that is not a text")
        return [(t, None) for t in given]
    except Exception as exc:
        if len(texts) < 2:
            return [(t, f"{exc}"[:ERROR_CHARS] or type(exc).__name__) for t in texts]
        half = len(texts) // 2
        return told(translate, texts[:half]) + told(translate, texts[half:])


def model_column(translate: Callable[[list[str]], list[str]], most: int = MODEL_BATCH):
    """A model over lists of at most ``most`` texts as a vectorised function on ``array<string>``; null entries pass through.

    Being non-deterministic, the call is neither repeated in nor moved by filters on its result.
    """
    @F.pandas_udf("array<struct<text:string,error:string>>")
    def run(batch: pd.Series) -> pd.Series:
        flat = [t for row in batch for t in row if t is not None]
        done = (r for at in range(0, len(flat), most) for r in told(translate, flat[at : at + most]))
        return pd.Series([[None if t is None else dict(zip(("text", "error"), next(done))) for t in row] for row in batch])

    return run.asNondeterministic()


def translate_lines(lines: DataFrame, translate: Callable[[list[str]], list[str]], target: str = "en",
                    protect_terms: list[str] | None = None, most: int = MODEL_BATCH) -> DataFrame:
    """lines(.., lang, text) with ``translated`` and ``error``. ``protect_terms`` are kept from the model like literals.

    A line is split into fragments, literals are masked, the model sees what holds a letter, the literals
    come back. Lines already in the target language and blank ones stay. Fragments remain arrays of their
    line, so nothing is shuffled.
    """
    active = (F.col("lang") != target) & (squeeze(F.col("text")) != "")
    split = lines.withColumn("_parts", F.when(active, fragments(F.col("text"))))
    split = split.withColumn("_spans", F.transform("_parts", lambda f: literal_spans(f["part"], protect_terms)))
    # The row keeps its order through two steps: mask by position, then hand plain arrays to the model.
    masked = split.withColumn("_masked", F.transform(F.arrays_zip("_parts", "_spans"), lambda z: mask(z["_parts"]["part"], z["_spans"])))
    asked = F.transform("_masked", lambda m: F.when(has_letter(residual(m["masked"], m["mark"])), m["masked"]))
    told = masked.withColumn("_told", model_column(translate, most)(F.coalesce(asked, F.array().cast("array<string>"))))
    zipped = F.arrays_zip("_parts", "_masked", "_told")
    rebuilt = F.transform(zipped, lambda z: F.concat(
        F.when(z["_told"].isNull(), z["_parts"]["part"]).otherwise(restore(z["_told"]["text"], z["_masked"]["saved"], z["_masked"]["mark"])), z["_parts"]["sep"]))
    errors = F.array_join(F.transform(F.filter("_told", lambda t: t["error"].isNotNull()), lambda t: t["error"]), "; ")
    done = told.withColumn("translated", F.when(F.col("_parts").isNull(), F.col("text")).otherwise(F.array_join(rebuilt, "")))
    return done.withColumn("error", F.nullif(errors, F.lit(""))).drop("_parts", "_spans", "_masked", "_told")
