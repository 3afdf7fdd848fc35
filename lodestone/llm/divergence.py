"""Quality rules by distribution divergence (DataFrame functions only).

A document's histogram over character classes, and its histogram over the common words
of its language, are compared with the language's reference by the Jensen-Shannon
distance.  References are the mean histograms of the corpus itself, one for each of a
fixed set of languages, so they follow the text at hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_sql import let, words
from lodestone.operators.lookup import maybe_among
from lodestone.scratch import materialize, only_result

# Frequent function words of each language; any other language has the empty list.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "with", "on", "be", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que", "dans", "pour", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "eine"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una"],
}
LANGUAGES = (*COMMON_WORDS, "und")

#: Documents shorter than this many words are judged by the base rules alone: their histograms are noise.
MIN_WORDS_CLASSES = 50
MIN_WORDS_COMMON = 200
#: Jensen-Shannon distances (base 2, so from 0 to 1) above which a document is rejected.  Both lie above the largest
#: that any labelled good document has among 10,000 (sf0.1) and 51,282 rows: 0.26 by classes and 0.245 by words, where
#: of the labelled bad ones long enough that pass the base rules 97 % are over 0.25 by words.
MAX_CLASS_DISTANCE = 0.29
MAX_COMMON_DISTANCE = 0.25
#: Histogram entries are whole parts of this, so that sums don't depend on the order of rows.
UNIT = 1_000_000

#: Repeated hashes of a text's windows up to which each window's is looked up among them.
FEW = 64

N_CLASSES = 7


def language(lang: Column) -> Column:
    """The reference a document is held against: its own language's, or the one that the rest share."""
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("und"))


def _covered_words(w: Column, at: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more, of those at the places ``at``: sort windows, compare neighbours, merge runs."""

    def windows(w: Column) -> Column:
        def one(i: Column) -> Column:
            a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("p"))

        return F.array_sort(F.transform(at, one))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(s: Column) -> Column:
        # an index outside the array gives null, which is not the same as anything
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(windows(w), lambda s: let(places(s), covered))


def _repeated_words(w: Column) -> Column:
    """``_covered_words`` of the windows whose hash another one has; no window is repeated without that.

    Where more than FEW hashes come twice, of all windows, since looking each up would take longer.
    """
    every = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(every, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def among(h: Column, t: Column) -> Column:
        at = F.when(F.size(t) > FEW, every).otherwise(F.filter(every, lambda i: F.array_contains(t, F.get(h, i))))
        return F.when(F.size(t) > 0, let(at, lambda p: _covered_words(w, p))).otherwise(F.lit(0))

    found = let(hashes, lambda h: let(twice(h), lambda t: among(h, t)))
    return F.when(F.size(w) >= 3, found).otherwise(F.lit(0)).cast("long")


def _shares(counts: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, counts)
    return F.array(*[F.floor(c * UNIT / F.greatest(total, F.lit(1))).cast("long") for c in counts])


def _classes(text: Column) -> Column:
    """Counts of lower case, white space, upper case, digits, sentence marks, symbols, and anything else; then the symbols of the base rule.

    Each class is counted by removing it, so every later pattern sees only what is left.
    """

    def cut(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, pattern, "")

    def count(a: Column, b: Column) -> Column:
        return (F.length(a) - F.length(b)).cast("long")

    rest = ["[\\x20\\x09-\\x0D]+", "\\p{Lu}+", "\\p{Nd}+", "[.,;:!?'\"()\\-]+", "[\\p{S}\\p{P}]+"]

    def further(seen: list[Column], patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            symbols = count(seen[1], cut(seen[1], "[#*$%&|<>]+"))
            return F.array(*counts, F.length(seen[-1]).cast("long"), symbols)
        return let(cut(seen[-1], patterns[0]), lambda t: further([*seen, t], patterns[1:], [*counts, count(seen[-1], t)]))

    return let(cut(text, "\\p{Ll}+"), lambda t: further([text, t], rest, [count(text, t)]))


def _common(w: Column, lang: Column) -> Column:
    """Counts of the common words of the document's language, then of all other words."""
    lists = [(k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()]
    own = reduce(lambda e, kv: F.when(lang == kv[0], kv[1]).otherwise(e), lists, F.array(*[F.lit("\x00")] * 15))
    low = F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: F.array_contains(own, x))
    return let(low, lambda c: F.concat(
        F.transform(own, lambda o: (F.size(c) - F.size(F.array_remove(c, o))).cast("long")), F.array((F.size(w) - F.size(c)).cast("long"))
    ))


def features(text: Column, lang: Column) -> Column:
    """One struct: the base figures, and the two histograms in parts of UNIT."""
    whole = F.coalesce(text, F.lit(""))
    lang = language(lang)

    def lines(t: Column) -> Column:
        with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
        return let(with_word, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))

    def build(w: Column, c: Column) -> Column:
        n = F.size(w).cast("long")
        repeated = _repeated_words(w)
        return let(repeated, lambda r: F.struct(
            n.alias("n_words"),
            (F.length(whole) - F.get(c, F.lit(1))).cast("long").alias("word_chars"),
            F.get(c, F.lit(N_CLASSES)).alias("n_symbols"),
            lines(whole).alias("n_dup_lines"),
            r.alias("n_repeat_words"),
            ((n < 50) | (r * 100 > n * 50)).alias("base_failed"),
            lang.alias("language"),
            _shares([F.get(c, F.lit(i)) for i in range(N_CLASSES)]).alias("classes"),
            let(_common(w, lang), lambda k: _shares([F.get(k, F.lit(i)) for i in range(16)])).alias("common"),
        ))

    return let(words(text), lambda w: let(_classes(whole), lambda c: build(w, c)))


def language_references(feats: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms by language over all documents long enough to be judged.

    Every document weighs the same, so one huge text can't bend a reference.  There are
    at most ``len(LANGUAGES)`` rows of 23 sums, which is what the driver gets; the sums
    are of whole numbers and taken by partial aggregation.
    """
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(16)]
    found = {}
    for row in feats.where(F.col("n_words") >= MIN_WORDS_CLASSES).groupBy("language").agg(*sums).collect():
        pair = []
        for k, n in (("c", N_CLASSES), ("w", 16)):
            part = [row[f"{k}{i}"] for i in range(n)]
            pair.append([x / max(sum(part), 1) for x in part])
        found[row["language"]] = tuple(pair)
    return found


def distance(shares: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of a histogram in parts of UNIT and a reference."""

    def parts(p: Column) -> Column:
        total = F.greatest(F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))

        def term(x: Column, q: Column) -> Column:
            a = x / total
            m = (a + q) / 2
            return F.when(x > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

        each = F.zip_with(p, reference, term)
        return F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    return let(shares, parts)


def verdict(feats: Column, references: dict[str, tuple[list[float], list[float]]]) -> Column:
    """Struct of both distances and ``kept``; ``feats`` must be a column, since it is used often."""

    def of(which: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for lang, pair in sorted(references.items()):
            out = F.when(feats["language"] == lang, F.array(*map(F.lit, pair[which]))).otherwise(out)
        return out

    classes = F.when(feats["n_words"] >= MIN_WORDS_CLASSES, distance(feats["classes"], of(0)))
    common = F.when((feats["n_words"] >= MIN_WORDS_COMMON) & (feats["language"] != "und"), distance(feats["common"], of(1)))
    far = let(classes, lambda a: let(common, lambda b: F.struct(
        a.alias("class_distance"),
        b.alias("common_distance"),
        (~feats["base_failed"] & (F.coalesce(a, F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce(b, F.lit(0.0)) <= MAX_COMMON_DISTANCE)).alias("kept"),
    )))
    return far


def quality(df: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` with every base figure, both distances and ``kept``: one row for each row of ``df``.

    Texts are read once: the narrow features are cut as a table, references are summed
    from it, and the verdicts are row by row.  A null or empty text has no words, fails
    the base rule and is rejected.  A null language is held against the reference of all
    unlisted languages, and by character classes only.  Rows may repeat.
    """
    feats = materialize(df.select(*keep, features(F.col(text_col), F.col(lang_col)).alias("__f")), "quality")
    refs = language_references(feats.select("__f.*"))
    judged = feats.withColumn("__v", verdict(F.col("__f"), refs))
    return judged.select(*keep, "__f.*", "__v.*")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that pass, whole.

    The features, which cost most, are made once and cut as a narrow table with a 128-bit
    key of what they are made of; texts aren't copied to disk.  The references are summed
    from it, and the keys of rejected rows are cut.  Texts are then read again: those that
    a bitmap of the rejected keys doesn't have pass unshuffled, the others are held against
    the keys themselves.
    """
    made_of = [F.col(c) for c in (text_col, lang_col)]
    own = [F.struct(F.lit(k), *made_of, *[c.isNull() for c in made_of]) for k in range(2)]
    keyed = df.select(F.struct(*df.columns).alias("own"), *[F.xxhash64(x).alias(f"k{k}") for k, x in enumerate(own)])

    def rejected() -> DataFrame:
        feats = materialize(df.select(*[F.xxhash64(x).alias(f"k{k}") for k, x in enumerate(own)], features(F.col(text_col), F.col(lang_col)).alias("f")), "judged")
        refs = language_references(feats.select("f.*"))
        return feats.where(~verdict(F.col("f"), refs)["kept"]).select("k0", "k1").distinct()

    gone = only_result(rejected, "rejected")
    doubtful = maybe_among(keyed, "k0", gone, "doubtful")
    sure = doubtful.where("not doubtful").select("own.*")
    return sure.unionByName(doubtful.where("doubtful").join(gone, ["k0", "k1"], "left_anti").select("own.*"))
