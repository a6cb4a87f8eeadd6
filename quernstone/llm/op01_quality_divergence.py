"""Quality rules: divergence of documents from their language's references. [native]

Method.  Two histograms describe a document: its characters by class and its
common words by identity (all others in one bin).  The same histograms summed
over all documents of a language that pass the base rules are that language's
references; they are taken three times, without the documents that stood too
far from the last ones, so that junk doesn't shape them.  A document is rejected if its Jensen-Shannon distance (base 2,
0..1) from a reference exceeds a limit, for histograms that hold enough: short
texts are guarded by a minimum length and by an allowance for sampling noise.
A document in none of the known languages, or in one with too few words for a
reference, is held against the nearest.

Everything is built-in expressions.  Words are split once per row and bound to
a lambda variable; no row is exploded but to add up the references, which is
combined before its shuffle.  The references (a fixed number of languages and
bins) come to the driver and go back as constants.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import WS, cut
from quernstone.llm.stopwords import ALL_STOP_WORDS, STOP_WORDS

#: A histogram counts only from so many entries on.
MIN_CHARS, MIN_WORDS = 200, 40
#: A language's reference is one only from so many words on; documents of others are held against the nearest.
MIN_REFERENCE = 2000
#: Greatest distance, and the allowance c / sqrt(entries).
CHAR_LIMIT, WORD_LIMIT = 0.16, 0.30
CHAR_NOISE, WORD_NOISE = 0.8, 1.2
#: Wider limits for the documents that make up the references, round by round.
TRIM = ((0.25, 0.45), (0.18, 0.36))
#: Character classes in the order of ``_class_counts``.
CLASSES = ("vowel", "consonant", "upper", "other_letter", "number", "punctuation", "other")


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def repeat_words(words: Column, k: int = 5) -> Column:
    """Words that lie in a k-word window which occurs twice or more (64-bit window hashes)."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == e["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == e["h"])))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(F.lit(k), p[F.least(i + 1, F.size(p) - 1)] - x)).otherwise(F.lit(k))),
                F.lit(0),
                lambda a, x: a + x,
            )

        return let(by_hash, lambda s: let(positions(s), total))

    return F.when(F.size(words) < k + 1, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def common_counts(words: Column) -> Column:
    """[(word, count)] of the common words of any language, by run length of the sorted hits."""
    hits = F.filter(F.transform(words, F.lower), lambda w: w.isin(sorted(ALL_STOP_WORDS)))

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda w, i: F.when((i == F.size(s) - 1) | (s[F.least(i + 1, F.size(s) - 1)] != w), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda at, i: F.struct(s[at].alias("w"), (at - F.when(i == 0, F.lit(-1)).otherwise(e[F.greatest(i - 1, F.lit(0))])).alias("n"))))

    return let(F.sort_array(hits), runs)


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """One narrow row per document with all counts."""
    lang = docs[lang_col] if lang_col else F.lit(None).cast("string")
    text = F.coalesce(docs[text_col], F.lit(""))
    df = docs.select(docs[id_col].alias("doc_id"), lang.alias("lang"), text.alias("t"))
    # characters: each class is what one more replacement takes away
    df = df.withColumn("r0", F.regexp_replace("t", f"[{WS}]+", ""))
    for i, cls in enumerate(("[aeiou]+", "[b-df-hj-np-tv-z]+", "[A-Z]+", "\\p{L}+", "\\p{N}+", "[.,;:!?'\"()-]+")):
        df = df.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", cls, ""))
    n = [F.length(f"r{i}").cast("long") for i in range(7)]
    classes = F.array(*[n[i] - n[i + 1] for i in range(6)], n[6])
    symbols = F.length("r4") - F.length(F.regexp_replace("r4", "[#*$%&|<>]+", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    of_words = let(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), common_counts(w).alias("common")))
    df = df.select(
        "doc_id",
        "lang",
        of_words.alias("w"),
        n[0].alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        classes.alias("classes"),
    )
    failed = (F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))
    return df.select("doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "classes", "w.common")


def references(rows: DataFrame) -> dict[str, dict]:
    """Per known language: class shares and common-word shares over all documents that pass the base rules."""
    known = rows.filter(F.col("lang").isin(list(STOP_WORDS)) & ~F.col("base_failed"))
    sums = known.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))])
    words = known.select("lang", F.explode("common").alias("x")).groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n"))
    out = {}
    for row in sums.collect():  # a row per known language
        if row["n_words"] < MIN_REFERENCE:
            continue
        chars = [row[f"c{i}"] for i in range(len(CLASSES))]
        out[row["lang"]] = {"chars": [c / max(1, sum(chars)) for c in chars], "n_words": row["n_words"], "words": {}}
    for row in words.collect():  # known languages x listed words at most
        ref = out.get(row["lang"])
        if ref and row["w"] in STOP_WORDS[row["lang"]]:
            ref["words"][row["w"]] = row["n"] / max(1, ref["n_words"])
    return out


def _half(p: Column, q: Column) -> Column:
    """A bin's part of the divergence in nats."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.ln(p / m)).otherwise(F.lit(0.0)) / 2 + F.when(q > 0, q * F.ln(q / m)).otherwise(F.lit(0.0)) / 2


_LN2 = 0.6931471805599453


def _distance(nats: Column) -> Column:
    return F.sqrt(F.greatest(nats / _LN2, F.lit(0.0)))


def char_distance(classes: Column, total: Column, ref: Column) -> Column:
    bins = F.sequence(F.lit(0), F.lit(len(CLASSES) - 1))
    return _distance(F.aggregate(bins, F.lit(0.0), lambda a, i: a + _half(classes[i] / total, ref["chars"][i])))


def word_distance(common: Column, n_words: Column, ref: Column) -> Column:
    """Bins that the document lacks add half their share times ln 2."""

    def of(hits: Column) -> Column:
        sums = F.aggregate(
            hits,
            F.struct(F.lit(0.0).alias("own"), F.lit(0.0).alias("seen"), F.lit(0.0).alias("bins")),
            lambda a, x: F.struct((a["own"] + x["p"]).alias("own"), (a["seen"] + x["q"]).alias("seen"), (a["bins"] + _half(x["p"], x["q"])).alias("bins")),
        )
        return let(sums, lambda s: s["bins"] + (ref["listed"] - s["seen"]) * (_LN2 / 2) + _half(F.greatest(1.0 - s["own"], F.lit(0.0)), F.greatest(1.0 - ref["listed"], F.lit(0.0))))

    hits = F.filter(F.transform(common, lambda x: F.struct((x["n"] / n_words).alias("p"), ref["words"][x["w"]].alias("q"))), lambda x: x["q"].isNotNull())
    return _distance(let(hits, of))


def judged(rows: DataFrame, refs: dict[str, dict], char_limit: float, word_limit: float) -> DataFrame:
    """Adds both distances and ``odd``: one of them is over its limit."""
    total = F.greatest(F.col("word_chars"), F.lit(1))
    count = F.greatest(F.col("n_words"), F.lit(1))
    known = json.dumps([{"lang": k, "chars": r["chars"], "words": r["words"], "listed": sum(r["words"].values())} for k, r in sorted(refs.items())], ensure_ascii=False)
    every = F.from_json(F.lit(known), "array<struct<lang:string,chars:array<double>,words:map<string,double>,listed:double>>")
    own = F.when(F.col("lang").isin(sorted(refs)), F.filter(every, lambda r: r["lang"] == F.col("lang"))).otherwise(every) if refs else every
    far = let(
        own,
        lambda near: F.struct(
            F.array_min(F.transform(near, lambda r: char_distance(F.col("classes"), total, r))).alias("c"),
            F.array_min(F.transform(near, lambda r: word_distance(F.col("common"), count, r))).alias("w"),
        ),
    )
    rows = rows.withColumn("far", far).withColumn("char_distance", F.col("far.c")).withColumn("word_distance", F.col("far.w")).drop("far")
    odd = ((F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > char_limit + CHAR_NOISE / F.sqrt(total))) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > word_limit + WORD_NOISE / F.sqrt(count))
    )
    return rows.withColumn("odd", F.coalesce(odd, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, base verdict, both distances and the final verdict of every document.

    Null and empty texts have zero counts and fail the base rules; a null or
    unknown language takes the nearest reference; repeated rows are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    rows = cut(features(docs, id_col, text_col, lang_col))
    refs = references(rows)
    for chars, words in TRIM:
        refs = references(judged(rows, refs, chars, words).filter("not odd"))
    rows = judged(rows, refs, CHAR_LIMIT, WORD_LIMIT)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("odd")).alias("kept"), "char_distance", "word_distance"
    )
