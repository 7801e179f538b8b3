"""Quality rules by distribution divergence (native: DataFrame functions only).

A document's character-class histogram and its common-word histogram are compared
with references of its language by the Jensen-Shannon distance (base 2, 0 to 1).
Each comparison has a guard: below a minimum length the histogram is noise and the
rule does not apply; short texts get a wider limit for words. Signs of markup and tables are a
class of their own, apart from punctuation. The references and limits are parameters; nothing is
fitted, so each row is judged by itself: one scan, no shuffle.

Defined results: a null text counts as empty (all counts 0, ``base_failed`` true,
``kept`` false). A null or unknown language is judged by the reference that suits
the text best. Three-word windows are compared by hash: 52 bits in texts of up to 4,096 words,
64 bits in longer ones. Repeated rows each get their own result row. Only the two named columns
are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import SPACE_CLASS, bind, words_of

# Usual shares of frequent function words in running text, per language.
COMMON_WORDS = {
    "en": {"the": .060, "of": .033, "and": .029, "to": .026, "in": .021, "a": .021, "is": .011, "that": .011, "for": .009, "it": .009, "was": .009, "on": .007, "with": .007, "as": .007, "be": .006},
    "de": {"der": .033, "die": .032, "und": .028, "in": .019, "den": .013, "von": .011, "zu": .010, "das": .010, "mit": .009, "sich": .008, "des": .008, "auf": .008, "für": .007, "ist": .007},
    "es": {"de": .062, "la": .038, "que": .029, "el": .027, "en": .026, "y": .025, "los": .017, "se": .013, "del": .012, "las": .011, "un": .010, "por": .009, "con": .008, "no": .008, "una": .008},
    "fr": {"de": .048, "la": .030, "le": .024, "et": .022, "les": .019, "en": .014, "des": .017, "un": .011, "du": .013, "une": .010, "est": .009, "que": .009, "pour": .008},
}
#: Usual shares of lower case a-z, upper case A-Z, digits, spaces, other ASCII, the signs #*$%&|<> and the rest.
CHARACTER_CLASSES = {
    "en": [.785, .022, .008, .165, .020, .001, .000],
    "de": [.765, .055, .008, .135, .022, .001, .015],
    "es": [.770, .022, .008, .162, .020, .001, .018],
    "fr": [.760, .022, .008, .162, .023, .001, .025],
}
#: Largest distance of the classes, by language: between the good and the bad of the labelled documents.
CHARACTER_LIMITS = {"en": 0.195, "de": 0.20, "es": 0.205, "fr": 0.21}


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; ``min_chars`` and ``min_words`` guard the two comparisons.

    Below ``full_words`` the limit for words grows with the square root of what is missing.
    """

    min_words_base: int = 50
    max_repeat_percent: int = 50
    max_char_distance: dict = field(default_factory=lambda: CHARACTER_LIMITS)
    max_word_distance: float = 0.30
    min_chars: int = 200
    min_words: int = 50
    full_words: int = 100
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)
    character_classes: dict = field(default_factory=lambda: CHARACTER_CLASSES)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares that each sum to 1."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _doubles(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


#: Positions below this are packed into the low bits of a window's hash.
PACKED = 4096


def _repeat_words(words: Column, n: Column) -> Column:
    """Positions covered by three-word windows that occur at least twice, for ``n`` words.

    Sorting puts equal hashes side by side; the positions of those are sorted again and each
    adds up to three new words. In texts of up to ``PACKED`` words a window is one long, 52 bits of
    its hash and then its position; in longer ones a struct of the whole hash and the position.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.sequence(F.lit(0), n - 3)

    def repeated(windows, same):
        return bind(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)))

    def covered(at):
        return bind(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda s, x: s + x))

    low, high = F.lit(PACKED - 1).cast("long"), F.lit(-PACKED).cast("long")
    short = repeated(F.transform(starts, lambda i: window(i).bitwiseAND(high).bitwiseOR(i.cast("long"))), lambda a, b: a.bitwiseXOR(b).bitwiseAND(high) == 0)
    long = repeated(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.cast("long").alias("i"))), lambda a, b: a["h"] == b["h"])
    short, long = F.transform(short, lambda x: x.bitwiseAND(low)), F.transform(long, lambda x: x["i"])
    return F.when(n < 4, F.lit(0).cast("long")).when(n <= PACKED, covered(short)).otherwise(covered(long))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """One row per document row: counts, distances, ``base_failed`` and ``kept``.

    ``keep`` names columns of ``docs`` that stay in a struct column ``row``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [F.struct(*keep).alias("row")] if keep else []
    d = docs.select(*own, F.col(doc_id).alias("doc_id"), t.alias("t"), F.col(lang).alias("lang"), words_of(F.col(text)).alias("words"))
    size = lambda regex: F.length(F.regexp_replace("t", regex, ""))  # noqa: E731  characters left without the class
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    every = sorted({w for ws in rules.common_words.values() for w in ws})
    cases = sorted({v for w in every for v in (w, w.capitalize(), w.upper())})
    langs = sorted(rules.common_words)

    d = d.select(
        *own and ["row"], "doc_id", "lang",
        F.size("words").alias("n"),
        F.length("t").alias("chars"), size(SPACE_CLASS + "+").alias("word_chars"), size("[#*$%&|<>]+").alias("no_symbols"),
        size("[a-z]+").alias("no_lower"), size("[A-Z]+").alias("no_upper"), size("[0-9]+").alias("no_digit"), size("[^\\x00-\\x7F]+").alias("no_wide"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bind(F.col("words"), lambda w: _repeat_words(w, F.size(w))).alias("n_repeat_words"),
        F.transform(F.filter("words", lambda w: w.isin(cases)), F.lower).alias("common"),
    )

    def shares(counts: list[Column], total: Column) -> Column:
        return F.array(*(c.cast("double") / F.greatest(total, F.lit(1)) for c in counts))

    chars, spaces = F.col("chars"), F.col("chars") - F.col("word_chars")
    lower, upper, digits, signs, wide = (F.col("chars") - F.col(f"no_{c}") for c in ("lower", "upper", "digit", "symbols", "wide"))
    d = d.withColumn("classes", shares([lower, upper, digits, spaces, chars - lower - upper - digits - spaces - signs - wide, signs, wide], chars))

    def word_distance(code: str) -> Column:
        ref = rules.common_words[code]
        counts = F.transform(F.array(*map(F.lit, ref)), lambda w: (F.size("common") - F.size(F.array_remove("common", w))).cast("double") / F.greatest(F.col("n"), F.lit(1)))
        full = bind(counts, lambda c: F.concat(c, F.array(F.lit(1.0) - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))
        return js_distance(full, _doubles([*ref.values(), 1 - sum(ref.values())]))

    def char_distance(code: str) -> Column:
        ref = rules.character_classes[code]
        return js_distance(F.col("classes"), _doubles([x / sum(ref) for x in ref]))

    def of_language(distance) -> Column:
        """A struct of what it is beyond its limit, and the distance: of the document's language, or of the one with the least."""
        out = F.array_min(F.array(*(distance(code) for code in langs)))
        for code in langs:
            out = F.when(F.col("lang") == code, distance(code)).otherwise(out)
        return out

    n = F.col("n")
    char = of_language(lambda code: bind(char_distance(code), lambda x: F.struct((x - rules.max_char_distance[code]).alias("beyond"), x.alias("distance"))))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(rules.full_words)) / F.greatest(n, F.lit(1))))
    word = of_language(lambda code: bind(word_distance(code), lambda x: F.struct((x - rules.max_word_distance * wider).alias("beyond"), x.alias("distance"))))
    d = d.withColumns({"char": F.when(chars >= rules.min_chars, char), "word": F.when(n >= rules.min_words, word)})
    failed = (n < rules.min_words_base) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    near = (F.coalesce("char.beyond", F.lit(0.0)) <= 0) & (F.coalesce("word.beyond", F.lit(0.0)) <= 0)
    return d.select(
        *own and ["row"], "doc_id", n.cast("long").alias("n_words"), F.col("word_chars").cast("long"), signs.cast("long").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", F.col("char.distance").alias("char_distance"), F.col("word.distance").alias("word_distance"), failed.alias("base_failed"), (~failed & near).alias("kept"),
    )
