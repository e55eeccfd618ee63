"""Translation pairs: checks, gate, entities, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import text
from pairforge.functions.seeded import uniform, weighted
from pairforge.functions.similarity import bleu_score

#: Target languages, and the languages their schemas may be translated to, with weights.
LANGUAGES = ("es", "tr", "ru", "zh", "ja", "hi", "de", "uk", "kk", "ro")
SCHEMA_LANGUAGES = {
    "tr": {"tr": 0.8, "de": 0.2},
    "ru": {"ru": 0.8, "zh": 0.2},
    "zh": {"zh": 0.8, "ru": 0.2},
    "ja": {"ja": 0.8, "zh": 0.2},
    "hi": {"hi": 0.8, "hi_typed": 0.2},
    "de": {"de": 0.8, "fr": 0.2},
    "uk": {"uk": 0.5, "ru": 0.5},
    "kk": {"kk": 0.5, "ru": 0.5},
    "ro": {"ro": 0.5, "ru": 0.25, "fr": 0.25},
}
#: Least and most length ratio; score weights; thresholds of the decision.
RATIO = (0.3, 3.0)
SEMANTIC_WEIGHT, BACK_WEIGHT = 0.4, 0.6
PASS, REVIEW = 0.72, 0.60
#: Function words that tell languages apart by default.
STOP_WORDS = {
    "en": ("the", "of", "and", "is", "what", "which", "how", "are"),
    "es": ("el", "la", "de", "que", "los", "cuál", "es", "en"),
    "de": ("der", "die", "das", "und", "ist", "welche", "wie", "von"),
    "fr": ("le", "la", "les", "des", "et", "est", "quel", "dans"),
    "tr": ("ve", "bir", "hangi", "kaç", "olan", "için", "bu", "nedir"),
    "ro": ("și", "care", "este", "din", "cel", "pentru", "sunt", "câte"),
}
#: Character ranges that tell a language's script.
SCRIPTS = {"ru": r"[\x{0400}-\x{04FF}]", "uk": r"[іїєґІЇЄҐ]", "kk": r"[әғқңөұүһӘҒҚҢӨҰҮҺ]", "zh": r"[\x{4E00}-\x{9FFF}]", "ja": r"[\x{3040}-\x{30FF}]", "hi": r"[\x{0900}-\x{097F}]"}


def length_ratio(original: str, translation: str) -> Column:
    """Length of the translation over that of the original, 0 for an empty original."""
    return text.ratio(text.char_count(translation), text.char_count(original))


def length_ok(original: str, translation: str, lo: float = RATIO[0], hi: float = RATIO[1]) -> Column:
    return length_ratio(original, translation).between(lo, hi)


def detected_language(x: str) -> Column:
    """By script, else by most function words, else null. A stand-in for a model."""
    listed = sorted({w for ws in STOP_WORDS.values() for w in ws})
    # one search finds the words of all languages, and lambdas bind what it found, so that it is made once
    hits = F.regexp_extract_all(F.lower(F.col(x)), F.lit(r"(?U)\b(" + "|".join(listed) + r")\b"), F.lit(1))
    languages = F.array(*map(F.lit, STOP_WORDS))

    def counted(words: Column) -> Column:
        return F.array(*[F.size(F.filter(words, lambda w: w.isin(*ws))) for ws in STOP_WORDS.values()])

    def most(counts: Column) -> Column:
        return F.when(F.array_max(counts) > 0, F.element_at(languages, F.array_position(counts, F.array_max(counts)).cast("int")))

    by_words = F.get(F.transform(F.transform(F.array(hits), counted), most), F.lit(0))
    by_script = F.lit(None).cast("string")
    for lang, script in SCRIPTS.items():
        by_script = F.when(F.col(x).rlike(script), F.lit(lang)).otherwise(by_script)
    any_script = "[" + "".join(s[1:-1] for s in SCRIPTS.values()) + "]"
    return F.when(F.col(x).rlike(any_script), by_script).otherwise(by_words)


def language_match(x: str, expected: Column, found: Column | None = None) -> Column:
    """False below three characters, true where nothing is detected; informative only. ``found`` is the language, if it is known."""
    language = detected_language(x) if found is None else found
    return F.when(text.char_count(x) < 3, F.lit(False)).otherwise(F.coalesce(language == expected, F.lit(True)))


def suspicious(x: str, strict_compat: bool = False) -> Column:
    """Empty, shorter than two characters, without a letter of any script, or digits only.

    ``strict_compat`` counts Latin and Cyrillic letters alone.
    """
    letter = r"[a-zA-Zа-яА-ЯçğıöşüÇĞİÖŞÜñáéíóúÑÁÉÍÓÚ]" if strict_compat else r"\p{L}"
    return F.coalesce(F.length(text.strip(x)), F.lit(0)).__lt__(2) | ~F.coalesce(F.col(x).rlike(letter), F.lit(False))


def verdict(original: str, translation: str, expected: Column | None = None) -> Column:
    """struct(is_valid, reason, length_ratio, language_match)."""
    ratio = length_ratio(original, translation)
    reason = F.when(~text.non_blank(translation), "empty").when(suspicious(translation), "suspicious").when(~ratio.between(*RATIO), "length_ratio")
    match = language_match(translation, expected) if expected is not None else F.lit(None).cast("boolean")
    return F.struct(reason.isNull().alias("is_valid"), F.coalesce(reason, F.lit("ok")).alias("reason"), ratio.alias("length_ratio"), match.alias("language_match"))


def combined(semantic: str, back: str) -> Column:
    """Weighted score; a lone score passes through."""
    s, b = F.col(semantic), F.col(back)
    return F.when(s.isNotNull() & b.isNotNull(), SEMANTIC_WEIGHT * s + BACK_WEIGHT * b).otherwise(F.coalesce(s, b))


def decision(score: Column) -> Column:
    """pass, review (not kept) or fail; accept where there is no score."""
    return F.when(score.isNull(), "accept").when(score >= PASS, "pass").when(score >= REVIEW, "review").otherwise("fail")


def gate(df: DataFrame, original: str = "original_text", translation: str = "translation", semantic: str = "semantic_similarity", back: str = "back_translation_similarity") -> DataFrame:
    """Heuristics, combined score, stage and ``keep``."""
    out = df.withColumn("verdict", verdict(original, translation)).withColumn("combined_similarity", combined(semantic, back))
    stage = F.when(~F.col("verdict.is_valid"), "heuristic").otherwise(decision(F.col("combined_similarity")))
    return out.withColumn("quality_stage", stage).withColumn("keep", F.col("quality_stage").isin("pass", "accept"))


def split_outputs(df: DataFrame, keep: str = "keep") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    yes = F.coalesce(F.col(keep), F.lit(False))
    return df.filter(yes), df.filter(~yes)


def heuristic_batch(df: DataFrame, original: str, translation: str, lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heuristic filter alone over a batch: accepted rows, rejected rows with their reason, and counts by language."""
    judged = df.withColumn("_v", verdict(original, translation)).withColumn("keep", F.col("_v.is_valid"))
    yes, no = split_outputs(judged.withColumn("reason", F.col("_v.reason")).drop("_v"))
    counts = judged.groupBy(lang).agg(F.count(F.lit(1)).alias("total"), F.count_if("keep").alias("accepted"), F.count_if(~F.col("keep")).alias("rejected"))
    return yes.drop("keep", "reason"), no.drop("keep"), counts


def merged_entities(entities: Column, priority: Sequence[str] = ("PERSON", "ORG", "GPE", "LOC")) -> Column:
    """Entities of three or more characters, the first of each text without regard to case, priority labels first.

    ``entities`` is an array of structs with ``text`` and ``label``; its order is kept otherwise.
    """
    long = F.filter(entities, lambda e: F.length(e["text"]) > 2)
    ranked = F.array_sort(
        F.transform(long, lambda e, i: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), e["label"]), F.lit(0)), F.lit(len(priority) + 1)).alias("rank"), i.alias("at"), e.alias("e")))
    )
    firsts = F.filter(F.transform(ranked, lambda r: r["e"]), lambda e, i: F.array_position(F.transform(ranked, lambda r: F.lower(r["e"]["text"])), F.lower(e["text"])) == i + 1)
    return firsts


def looked_up(df: DataFrame, dictionary: DataFrame, key: str = "entity", value: str = "title") -> DataFrame:
    """Left join with a supplied dictionary; disambiguation pages count as misses, a row with a null value is a known miss."""
    known = dictionary.select(F.lower(key).alias("_k"), F.when(~F.lower(F.coalesce(F.col(value), F.lit(""))).contains("disambiguation"), F.col(value)).alias(value), F.lit(True).alias("cached")).dropDuplicates(["_k"])
    return df.join(known, F.lower(F.col(key)) == F.col("_k"), "left").drop("_k").withColumn("cached", F.coalesce("cached", F.lit(False)))


def schema_plan(lang: Column, row_key: Column, filtered: Column, seed: int = 42) -> Column:
    """The language a row's schema is translated to: for half of the rows, none for prompt-filtered rows or unlisted languages."""
    out = F.lit(None).cast("string")
    for name, options in SCHEMA_LANGUAGES.items():
        out = F.when(lang == name, weighted(list(options), list(options.values()), seed, f"schema-{name}", row_key)).otherwise(out)
    chosen = uniform(seed, "schema", row_key) < 0.5
    return F.when(chosen & (F.coalesce(filtered, F.lit("")) != "prompt"), out)


def fan_out(df: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Every row once for each language."""
    return df.withColumn("lang", F.explode(F.array(*map(F.lit, languages))))


def pair_metrics(df: DataFrame, original: str, translation: str) -> DataFrame:
    """Add lengths, words and sentences of both sides and their ratios."""
    out = df.withColumns(
        {
            "chars_original": text.char_count(original),
            "chars_translation": text.char_count(translation),
            "words_original": text.word_count(original),
            "words_translation": text.word_count(translation),
            "sentences_original": text.sentence_count(original),
            "sentences_translation": text.sentence_count(translation),
        }
    )
    return out.withColumns({"length_ratio": text.ratio(F.col("chars_translation"), F.col("chars_original")), "word_ratio": text.ratio(F.col("words_translation"), F.col("words_original"))})


def report(df: DataFrame) -> DataFrame:
    """One row over :func:`pair_metrics`: counts, and mean, extremes and sample deviation of the ratios."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("length_ratio", "word_ratio") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    return df.agg(F.count(F.lit(1)).alias("n"), *stats, F.avg("words_original").alias("mean_words_original"), F.avg("words_translation").alias("mean_words_translation"))


def bleu_share(df: DataFrame, reference: str, candidate: str, above: float = 0.5) -> DataFrame:
    """Mean BLEU and the share above a bound."""
    return df.select(bleu_score(F.col(reference), F.col(candidate)).alias("b")).agg(F.avg("b").alias("mean_bleu"), F.avg((F.col("b") > above).cast("double")).alias("share_above"))
