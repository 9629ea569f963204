"""Quality rules by distribution divergence, in built-in functions only.

A document's histogram over character classes and its histogram over the common words of its language are each
compared to the language's reference by Jensen-Shannon distance. References are sums over all documents that pass
the base rules, so they follow the corpus. A distance is only trusted above a minimum length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared

#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "as", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "des"],
    "fr": ["de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()[]{}-_/\\@=+~^`"
CLASSES = ["upper", "symbol", "punct", "other"]
WORDS = len(next(iter(COMMON.values())))

MAX_CLASS_DISTANCE = 0.15
MAX_WORD_DISTANCE = 0.30
MIN_CHARS = 200
MIN_WORDS = 50
MIN_WORDS_COMPARED = 100
_IDX = 24  # bits of a packed window that hold its place


def _count(chars: str) -> Column:
    return F.length("_rare") - F.length(F.translate("_rare", chars, ""))


def _shown(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def _covered(starts: Column) -> Column:
    """Words under 3-word windows that begin at the sorted places starts."""
    own = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3)).cast("int")).cast("long"))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: windows are sorted by hash, so equal ones are neighbours; neighbours are compared word by word.

    Should unequal windows ever share a hash, that document sorts its windows by their words instead.
    """
    i64 = lambda c: c.cast("long")
    low = F.lit((1 << _IDX) - 1).cast("long")
    places = F.when((F.col("n_words") >= 3) & (F.col("n_words") < 1 << _IDX), F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.transform(places, lambda i: F.xxhash64(*_shown(F.col("words"), i))))
    # most documents have no window twice and need no sort
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    packed = F.sort_array(F.transform("_h", lambda x, i: F.shiftleft(x, _IDX).bitwiseOR(i64(i))))
    df = df.withColumn("_w", F.when(some, packed).otherwise(F.array().cast("array<bigint>"))).drop("_h")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, _IDX) == F.shiftright(y, _IDX), F.lit(False))

    def before(j: Column) -> Column:
        return F.when(j > 0, F.get(F.col("_w"), j - 1))

    df = df.withColumn("_d", F.filter(F.col("_w"), lambda x, j: same(x, before(j)) | same(x, F.get(F.col("_w"), j + 1))))

    def differ(x: Column, j: Column) -> Column:
        y = F.when(j > 0, F.get(F.col("_d"), j - 1))
        at = lambda z: (z.bitwiseAND(low)).cast("int")
        pairs = zip(_shown(F.col("words"), at(x)), _shown(F.col("words"), at(y)))
        unequal = F.lit(False)
        for a, b in pairs:
            unequal = unequal | (a != b)
        return same(x, y) & unequal

    df = df.withColumn("_clash", (F.size(F.filter(F.col("_d"), differ)) > 0) | (F.col("n_words") >= 1 << _IDX))
    df = df.withColumn("_s", F.sort_array(F.transform("_d", lambda x: x.bitwiseAND(low))))
    all_places = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0)))
    exact = F.when(F.col("_clash"), F.sort_array(F.transform(all_places, lambda i: F.struct(F.array(*_shown(F.col("words"), i)).alias("w"), i64(i).alias("i"))))).otherwise(F.array().cast("array<struct<w:array<string>,i:bigint>>"))
    df = df.withColumn("_e", exact)
    twice = F.filter(F.col("_e"), lambda x, j: F.coalesce(x["w"] == F.when(j > 0, F.get(F.col("_e"), j - 1)["w"]), F.lit(False)) | F.coalesce(x["w"] == F.get(F.col("_e"), j + 1)["w"], F.lit(False)))
    df = df.withColumn("_s", F.when(F.col("_clash"), F.sort_array(F.transform(twice, lambda x: x["i"]))).otherwise(F.col("_s")))
    return df.withColumn("n_repeat_words", _covered(F.col("_s"))).drop("_w", "_d", "_clash", "_s", "_e")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base counts and both histograms. A null text has none; a null or unknown lang has no common words."""
    own = F.col("_t")
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("words", F.array_remove(F.split(own, "[ \\t-\\r]+"), ""))
    # what is neither a small Latin letter nor white space is a few hundredths of a text; classes are counted in that
    df = df.withColumns({"n_words": F.size("words").cast("long"), "_rare": F.regexp_replace(own, "[a-zß-öø-ÿ \\t-\\r]+", "")})
    df = df.withColumn("_lines", F.filter(F.split(own, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    listed = F.col(lang)
    common = F.lit(None).cast("array<string>")
    for code, words in COMMON.items():
        common = F.when(listed == code, F.array(*[F.lit(w) for w in words])).otherwise(common)
    every = sorted({w for ws in COMMON.values() for w in ws})
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": _count(SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_upper": F.length(F.regexp_replace("_rare", "\\P{Lu}+", "")).cast("long"),
            "_punct": _count(PUNCTUATION).cast("long"),
            "_f": F.filter(F.col("words"), lambda w: w.isin(*every, *[w.capitalize() for w in every])),
        }
    )
    df = _with_repeats(df.drop("_t", "_lines", "_rare", text))
    df = df.withColumn("_f", F.transform("_f", lambda w: F.lower(w))).drop("words")
    hits = F.transform(common, lambda c: F.size(F.filter(F.col("_f"), lambda w: w == c)).cast("long"))
    df = df.withColumn("words_hist", F.coalesce(hits, F.array().cast("array<bigint>"))).drop("_f")
    other = F.col("word_chars") - F.col("_upper") - F.col("n_symbols") - F.col("_punct")
    hist = F.array("_upper", "n_symbols", "_punct", F.greatest(other, F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumns({"class_hist": hist, "base_failed": failed}).drop("_upper", "_punct")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance to base 2, from 0 to 1; null if either histogram has nothing."""
    n, m = _sum(counts), _sum(reference)

    def part(p: Column, q: Column) -> Column:
        mid = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mid)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / mid)).otherwise(F.lit(0.0))

    terms = F.zip_with(counts, reference, lambda x, y: part(x.cast("double") / n, y.cast("double") / m))
    return F.when((n > 0) & (m > 0) & (F.size(counts) == F.size(reference)), F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0))))


def references(feats: DataFrame, lang: str = "lang") -> DataFrame:
    """One row for each language of COMMON, and one under null for all others.

    The first reference sums all documents that pass the base rules. The second sums those of them that are no farther
    from the first than documents of their language are on average, so that junk doesn't describe the language.
    """
    first = _sums(feats, lang)
    df = _with_reference(feats.where(~F.col("base_failed")), first, lang).withColumn("_far", distance(F.col("class_hist"), F.col("_class_ref")))
    mean = df.groupBy(_code(lang).alias("_m")).agg(F.avg("_far").alias("_mean"))
    near = df.join(F.broadcast(mean), _code(lang).eqNullSafe(F.col("_m"))).where(F.col("_far") <= F.col("_mean") * (1 + 1e-9))  # sums of doubles have no fixed order
    return _sums(near.drop("_ref", "_class_ref", "_words_ref"), lang)


def _code(lang: str) -> Column:
    return F.when(F.col(lang).isin(*COMMON), F.col(lang))


def _with_reference(feats: DataFrame, refs: DataFrame, lang: str) -> DataFrame:
    few = F.broadcast(refs.withColumnRenamed("_code", "_ref"))  # a row for each language of COMMON and one more
    return feats.join(few, _code(lang).eqNullSafe(F.col("_ref")), "left")


def _sums(feats: DataFrame, lang: str) -> DataFrame:
    code = _code(lang)
    sums = [F.sum(F.get("class_hist", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.coalesce(F.get("words_hist", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(WORDS)]
    sums += [F.sum("n_words").alias("n")]
    ref = feats.where(~F.col("base_failed")).groupBy(code.alias("_code")).agg(*sums)
    hits = [F.col(f"w{i}") for i in range(WORDS)]
    rest = F.col("n") - sum(hits[1:], hits[0])
    return ref.select("_code", F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("_class_ref"), F.array(*hits, rest).alias("_words_ref"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The input's columns but the text, with the counts, both distances, base_failed and kept.

    Every row gets one row. A null or empty text has counts of 0 and fails the base rules. Repeated rows are judged
    each for itself. Null and unknown languages share one reference and are judged by character classes alone.
    A distance that can't be had (nothing to compare, fewer than MIN_CHARS characters in words, or MIN_WORDS_COMPARED words)
    rejects nothing. Columns of the input with the names of results are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    judged = _verdict(shared.keep(features(_whole(docs, text, lang, rest), "_text", "_lang"), "quality"), "_lang", max_class, max_word)
    return judged.select(*[F.col("whole")[c].alias(c) for c in rest], *RESULTS)


#: Columns that judge adds.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _whole(docs: DataFrame, text: str, lang: str, names: list[str]) -> DataFrame:
    """Text and language under names of their own, with columns of the input as one struct, so no names clash."""
    whole = F.struct(*[docs[c] for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    return docs.select(docs[text].alias("_text"), docs[lang].alias("_lang"), whole.alias("whole"))


def _verdict(feats: DataFrame, lang: str, max_class: float, max_word: float) -> DataFrame:
    df = _with_reference(feats, references(feats, lang), lang)
    seen = F.aggregate("words_hist", F.lit(0).cast("long"), lambda a, x: a + x)
    bins = F.when(F.size("words_hist") > 0, F.concat("words_hist", F.array(F.col("n_words") - seen)))
    df = df.withColumns(
        {
            "class_distance": F.when(F.col("word_chars") >= MIN_CHARS, distance(F.col("class_hist"), F.col("_class_ref"))),
            "word_distance": F.when(F.col("n_words") >= MIN_WORDS_COMPARED, distance(bins, F.col("_words_ref"))),
        }
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return df.withColumn("kept", ~F.col("base_failed") & ~far).drop("_ref", "_class_ref", "_words_ref", "class_hist", "words_hist")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of docs whose documents are kept, unchanged.

    No row is matched by id, so repeated and null ids do no harm, and equal rows have one verdict. Null and empty texts
    fail the base rules. An empty table gives no rows. Other columns may have any names.
    """
    names = docs.columns
    feats = shared.keep(features(_whole(docs, text, lang, names), "_text", "_lang"), "quality")
    judged = _verdict(feats, "_lang", max_class, max_word)
    return judged.where("kept").select(*[F.col("whole")[c].alias(c) for c in names])


def _sql() -> str:
    listed = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    symbols = SYMBOLS.replace("|", "\\|").replace("$", "\\$").replace("*", "\\*")
    punct = "".join("\\" + c if c in "[]\\^-" else "''" if c == "'" else c for c in PUNCTUATION)
    common = " ".join(f"WHEN '{code}' THEN {listed(words)}" for code, words in COMMON.items())
    div = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"

    def far(kind: str, ref: str) -> str:
        return f"""SELECT doc_id, sqrt(greatest(sum({div}) / 2, 0)) AS d FROM (
          SELECT h.doc_id, CAST(h.n AS DOUBLE) / sum(h.n) OVER (PARTITION BY h.doc_id) AS p, r.q FROM hist h JOIN {ref} r
          ON h.code IS NOT DISTINCT FROM r.code AND h.kind = r.kind AND h.bin = r.bin WHERE h.kind = '{kind}') GROUP BY doc_id HAVING sum(p) > 0"""

    def ref(where: str) -> str:
        return f"""SELECT code, kind, bin, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY code, kind) AS q
          FROM hist WHERE doc_id IN (SELECT doc_id FROM base WHERE NOT base_failed{where}) GROUP BY code, kind, bin"""

    return f"""
WITH t AS (
  SELECT doc_id, CASE WHEN lang IN ({", ".join("'" + c + "'" for c in COMMON)}) THEN lang END AS code, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
n AS (SELECT *, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^{symbols}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^{punct}]', '', 'g')) AS BIGINT) AS n_punct,
        CAST(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (
        SELECT doc_id, words, unnest(range(1, greatest(n_words - 1, 1))) AS i FROM n)),
m AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (
        SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(3, coalesce(next - i, 3))) AS BIGINT) AS n_repeat_words FROM m GROUP BY doc_id),
base AS (SELECT n.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
           n_words < {MIN_WORDS} OR 100 * coalesce(r.n_repeat_words, 0) > 50 * n_words AS base_failed FROM n LEFT JOIN r ON n.doc_id = r.doc_id),
common AS (SELECT doc_id, code, n_words, list_filter(list_transform(words, lambda x: CASE WHEN x = lower(x) OR (upper(x[1]) || lower(x[2:])) = x THEN lower(x) ELSE '' END), lambda x: x <> '') AS low,
             CASE code {common} END AS wanted FROM n),
counted AS (SELECT doc_id, code, n_words, unnest(range(1, {WORDS + 1})) AS bin, low, wanted FROM common WHERE code IS NOT NULL),
wc AS (SELECT doc_id, code, n_words, bin, len(list_filter(low, lambda x: x = wanted[bin])) AS n FROM counted),
hist AS (
  SELECT doc_id, code, 'class' AS kind, unnest([1, 2, 3, 4]) AS bin,
         unnest([n_upper, n_symbols, n_punct, greatest(word_chars - n_upper - n_symbols - n_punct, 0)]) AS n FROM base
  UNION ALL SELECT doc_id, code, 'word', bin, n FROM wc
  UNION ALL SELECT doc_id, code, 'word', {WORDS + 1}, any_value(n_words) - sum(n) FROM wc GROUP BY doc_id, code),
ref1 AS ({ref("")}),
far1 AS ({far("class", "ref1")}),
mean AS (SELECT code, avg(d) AS mean FROM far1 f JOIN base b ON f.doc_id = b.doc_id WHERE NOT base_failed GROUP BY code),
near AS (SELECT f.doc_id FROM far1 f JOIN base b ON f.doc_id = b.doc_id JOIN mean m ON b.code IS NOT DISTINCT FROM m.code WHERE f.d <= m.mean * (1 + 1e-9)),
ref2 AS ({ref(" AND doc_id IN (SELECT doc_id FROM near)")}),
fc AS ({far("class", "ref2")}),
fw AS ({far("word", "ref2")})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (CASE WHEN word_chars >= {MIN_CHARS} THEN coalesce(fc.d, 0) ELSE 0 END > {MAX_CLASS_DISTANCE}
                             OR CASE WHEN n_words >= {MIN_WORDS_COMPARED} THEN coalesce(fw.d, 0) ELSE 0 END > {MAX_WORD_DISTANCE}) AS kept
FROM base b LEFT JOIN fc ON b.doc_id = fc.doc_id LEFT JOIN fw ON b.doc_id = fw.doc_id
"""


#: The same in SQL. Ids must differ.
ORACLE = _sql()
