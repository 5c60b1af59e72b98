"""Quality rules: divergence of character-class and common-word histograms from language references.

Native: DataFrame functions only. A language's reference is counted over all of its documents.
A document is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of its histogram from
its language's is above a limit; the limit is wider for short documents, whose histograms are noisy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import SPACE, durable, join_small, keeps_names, public

SYMBOLS = "#*$%&|<>"
#: Character classes counted one by one; blanks and the rest (other letters: lower case, or without case) follow.
CLASSES = {"upper": "A-Z", "digit": "0-9", "symbol": SYMBOLS, "mark": r"!\x22'()+,\x2D./:;=?@\x5B-`{}~", "wide": r"^\x00-\x7F"}
N_CLASSES = len(CLASSES) + 2
#: Common words: words of letters; so many of the most frequent of a language.
COMMON = r"^\p{L}+$"
N_COMMON = 24
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWX"
#: Places of windows in a text take so many bits beside their hash; longer texts are counted another way.
PLACE_BITS = 24
#: Limits of the distances; a document of n words may be off by its slack / sqrt(n) more.
MAX_CHARS, MAX_WORDS = 0.13, 0.12
CHARS_SLACK, WORDS_SLACK = 1.4, 2.0
#: Guards: a histogram is not judged below so many words, nor by a reference of fewer words.
MIN_WORDS, MIN_REFERENCE = 50, 1000
#: Base rules.
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def _count(text: Column, chars: str) -> Column:
    """How many characters of a class; few are taken out, so this is one quick pass."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def with_words(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add _text (null: empty), _lang (null: ''), _words and _rare, the text without small Latin letters and
    blanks: most of a text goes through one pattern only."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_lang", F.coalesce(F.col(lang), F.lit("")))
    return df.withColumns({"_words": F.array_remove(F.split("_text", SPACE), ""), "_rare": F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", "")})


def _classes(df: DataFrame) -> DataFrame:
    """Add _chars, the histogram; ``df`` has word_chars."""
    few = [F.col("n_symbols") if k == "symbol" and "n_symbols" in df.columns else _count(F.col("_rare"), c) for k, c in CLASSES.items()]
    named = df.select("*", *[c.cast("long").alias(f"_c{i}") for i, c in enumerate(few)], F.length("_text").cast("long").alias("_n"))
    parts = [F.col(f"_c{i}") for i in range(len(few))]
    out = named.withColumn("_chars", F.array(*parts, F.col("_n") - F.col("word_chars"), F.col("word_chars") - sum(parts[1:], parts[0])))
    return out.drop(*[f"_c{i}" for i in range(len(few))], "_n")


def _word_chars() -> Column:
    return F.length(F.array_join("_words", "")).cast("long")


def _sizes(worded: DataFrame) -> DataFrame:
    return worded.select("*", F.size("_words").cast("long").alias("n_words"), _word_chars().alias("word_chars"), _count(F.col("_rare"), SYMBOLS).cast("long").alias("n_symbols"))


def references(worded: DataFrame) -> DataFrame:
    """Per _lang: ref_chars and ref_words (shares), common (the words), ref_n (words counted).

    One pass: with a document's words goes, as one more word that begins with a blank as no other does, the list
    of its number of words and its character classes. Words stay plain strings: a structure for each costs more than its count.
    """
    sized = _classes(worded.select("_lang", "_text", "_words", "_rare", _word_chars().alias("word_chars")))
    own = F.concat(F.lit(" "), F.concat_ws(" ", F.size("_words"), *[F.get("_chars", F.lit(i)) for i in range(N_CLASSES)]))
    counted = sized.select("_lang", F.explode(F.concat("_words", F.array(own))).alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("n"))
    counted = durable(counted.where(F.col("w").startswith(" ") | F.col("w").rlike(COMMON)), "quality-words")
    told = counted.where(F.col("w").startswith(" ")).select("_lang", "n", F.split(F.ltrim("w"), " ").cast("array<long>").alias("own"))
    sum_of = lambda i: F.sum(F.get("own", F.lit(i)) * F.col("n"))
    sums = told.groupBy("_lang").agg(sum_of(0).alias("ref_n"), *[sum_of(i + 1).alias(f"s{i}") for i in range(N_CLASSES)])
    top = counted.where(~F.col("w").startswith(" ")).withColumn("r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= N_COMMON)
    lists = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    out = sums.join(lists, "_lang", "left")
    total = sum([F.col(f"s{i}") for i in range(1, N_CLASSES)], F.col("s0"))
    top_n = F.coalesce(F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    words = F.coalesce(F.transform("top", lambda x: x["n"] / F.col("ref_n")), F.array().cast("array<double>"))
    return out.select(
        "_lang", "ref_n",
        F.array(*[F.coalesce(F.try_divide(F.col(f"s{i}"), total), F.lit(0.0)) for i in range(N_CLASSES)]).alias("ref_chars"),
        F.concat(words, F.array(F.coalesce(F.try_divide(F.col("ref_n") - top_n, F.col("ref_n")), F.lit(0.0)))).alias("ref_words"),
        F.coalesce(F.transform("top", lambda x: x["w"]), F.array().cast("array<string>")).alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of equal length."""
    def side(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: side(a, b) + side(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2))


def _three(i: Column) -> Column:
    """The words of a window, by the place of its first."""
    return F.slice("_words", i + 1, F.lit(3))


def _covered(places: Column) -> Column:
    """How many words the windows at these places cover, places in any order, repeated or not."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def _by_words() -> Column:
    """n_repeat_words by sorting the windows themselves: exact, for whatever the hashes cannot settle."""
    n = F.size("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(_three(i).alias("w"), i.alias("i"))))
    ordered = F.sort_array(windows)
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(n, F.lit(1))), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    return F.coalesce(_covered(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))), F.lit(0).cast("long"))


def base_rules(worded: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows of three words become hashes; a text whose hashes all differ has no equal windows. In others
    they become numbers, 40 bits of the hash before PLACE_BITS of the place, so that sorting them makes
    equal windows neighbours: n log n for one text, however long. Words are compared where hashes meet;
    should they differ there, or places not fit, windows are sorted whole.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    df = _sizes(worded).select("*", lines.alias("_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    windows = F.transform(F.slice("_hashes", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    df = df.withColumn("_windows", windows).drop("_hashes")
    packed = F.transform("_windows", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    differ = F.size("_windows") == F.size(F.array_distinct("_windows"))
    df = df.withColumn("_sorted", F.when(differ, F.array().cast("array<long>")).otherwise(F.sort_array(packed)))
    met = F.filter(
        F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted"), F.lit(1))), lambda a, b: F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.struct(place(a).alias("a"), place(b).alias("b")))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("_met", met)
    sure = (n < 1 << PLACE_BITS) & F.forall("_met", lambda x: _three(x["a"]) == _three(x["b"]))
    places = F.concat(F.transform("_met", lambda x: x["a"]), F.transform("_met", lambda x: x["b"]))
    repeated = F.when(F.size("_met") == 0, F.lit(0).cast("long")).when(sure, _covered(places)).otherwise(_by_words())
    df = df.withColumn("n_repeat_words", F.when((n < 1 << PLACE_BITS) | (F.size("_sorted") == 0), repeated).otherwise(_by_words()))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_lines", "_windows", "_sorted", "_met")


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


@keeps_names
def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns of ``df`` with the base figures, both distances and ``kept``.

    Null text counts as empty, null lang as a language of its own. Texts under MIN_WORDS words
    and languages under MIN_REFERENCE words get null distances and no rejection by them (the base
    rules still hold). Rows are judged one by one: repeated rows each get the same verdict.
    An empty table gives no rows. Columns named like the added ones are replaced.
    """
    worded = with_words(public(df, *ADDED), text, lang)
    refs = durable(references(worded.select("_text", "_lang", "_words", "_rare")), "quality-refs")
    rows = join_small(_classes(base_rules(worded)), refs, ["_lang"])
    # one letter a word tells which common word it is; the others, most of a text, have none
    marks = F.array_join(F.transform(F.filter("_words", lambda w: F.array_contains("common", w)), lambda w: F.substring(F.lit(_LETTERS), F.array_position("common", w).cast("int"), F.lit(1))), "")
    rows = rows.withColumn("_marks", marks)
    hits = [(F.length("_marks") - F.length(F.replace("_marks", F.lit(c), F.lit("")))) for c in _LETTERS]
    shares = F.transform(F.slice(F.array(*hits), F.lit(1), F.size("common")), lambda k: k / F.col("n_words"))
    p_words = F.concat(shares, F.array((F.col("n_words") - F.length("_marks")) / F.col("n_words")))
    all_chars = F.aggregate("_chars", F.lit(0).cast("long"), lambda a, c: a + c)
    rows = rows.withColumn("_all_chars", all_chars)
    p_chars = F.transform("_chars", lambda c: c / F.col("_all_chars"))
    judged = (F.col("n_words") >= MIN_WORDS) & (F.col("ref_n") >= MIN_REFERENCE)
    rows = rows.withColumn("char_distance", F.when(judged, distance(p_chars, F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when(judged, distance(p_words, F.col("ref_words"))))
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    far = (F.col("char_distance") > MAX_CHARS + CHARS_SLACK / root) | (F.col("word_distance") > MAX_WORDS + WORDS_SLACK / root)
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return rows.drop("_text", "_lang", "_words", "_rare", "_chars", "_all_chars", "_marks", "ref_chars", "ref_words", "ref_n", "common")


@keeps_names
def kept_rows(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``df`` that pass, with their own columns.

    The verdict generates each row once or not at all. As a filter the optimiser would push it below
    the steps it is made of, and compute each of them again wherever a later one names it.
    """
    judged = judge(df, text, lang)
    names = [c for c in public(df).columns if c.lower() not in ADDED]
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select(*[f"`{c}`" for c in names], once.alias("_once")).drop("_once")
