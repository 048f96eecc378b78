"""Answer and query text as Column expressions: normalisation, overlap scores, terms, flags.

Everything here is a built-in expression (higher-order functions included), so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of queries.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "what", "when", "where", "which", "who",
)
#: Phrases of an answer that abstains.
MISSING_PATTERNS = (
    "i don't know", "i do not know", "cannot determine", "can't determine", "not enough information", "insufficient information",
    "provided context does not", "context does not", "no information", "unknown", "unclear",
)
#: Words of opposite polarity and opposite pairs.
YES = ("yes", "true", "correct", "supported")
NO = ("no", "false", "incorrect", "unsupported")
OPPOSITES = (
    ("alive", "dead"), ("increase", "decrease"), ("increased", "decreased"), ("higher", "lower"), ("before", "after"), ("current", "former"), ("won", "lost"),
)
_WORD = r"[A-Za-z0-9][A-Za-z0-9_'-]*"


def let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """fn of a struct of values that are computed once, however often fn names them (also inside lambdas)."""
    bound = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.element_at(F.transform(bound, fn), 1)


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    return F.when(F.lower(squeeze(c)) == "nan", "").otherwise(squeeze(c))


def normalize(c: Column) -> Column:
    """Lower case without ASCII punctuation, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Punct}", ""))


def tokens(c: Column) -> Column:
    n = normalize(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def _occurrences(a: Column, t: Column) -> Column:
    return F.size(F.filter(a, lambda e: e == t))


def _repeats(x: Column) -> Column:
    """Each token of an array as often as it comes again."""
    return let(lambda s: F.filter(s["x"], lambda t, i: (i > 0) & (F.get(s["x"], i - 1) == t)), x=F.sort_array(x))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: the tokens of both once, and those that come again in both."""
    again = lambda s: F.aggregate(F.array_intersect(s["p"], s["q"]), F.lit(0), lambda acc, t: acc + F.least(_occurrences(s["p"], t), _occurrences(s["q"], t)))
    return F.size(F.array_intersect(a, b)) + let(again, p=_repeats(a), q=_repeats(b))


def _f1(common: Column, n: Column, m: Column) -> Column:
    p, r = common / n, common / m
    return F.when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays."""
    return _f1(overlap(a, b), F.size(a), F.size(b))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for t in a:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays (in Arrow batches: no column expression fills a table well)."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        return 2 * lcs_length(list(x), list(y)) / (len(x) + len(y))

    def scores(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=float)

    return F.pandas_udf(scores, "double")(a, b)


def text_f1(a: Column, b: Column) -> Column:
    """Token F1 of two texts."""
    return let(lambda s: token_f1(s["a"], s["b"]), a=tokens(a), b=tokens(b))


def _contained(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def _split(n: Column) -> Column:
    """Tokens of a normalised text."""
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def substring_match(a: Column, b: Column) -> Column:
    """Either normalised text contains the other; empty ones match nothing."""
    return let(lambda s: _contained(s["x"], s["y"]), x=normalize(a), y=normalize(b))


def _with_f1(fn: Callable[[Column, Column, Column], Column], a: Column, b: Column) -> Column:
    """fn of both normalised texts and their token F1."""
    inner = lambda s: let(lambda t: fn(t["x"], t["y"], t["f"]), x=s["x"], y=s["y"], f=let(lambda t: token_f1(t["p"], t["q"]), p=_split(s["x"]), q=_split(s["y"])))
    return let(inner, x=normalize(a), y=normalize(b))


def lexically_equal(a: Column, b: Column, threshold: float = 0.92) -> Column:
    return _with_f1(lambda x, y, f: _contained(x, y) | ((x != "") & (y != "") & (f >= threshold)), a, b)


def entailment(a: Column, b: Column) -> Column:
    """Struct of heuristic entailment, contradiction and neutral scores."""

    def scores(x: Column, y: Column, f: Column) -> Column:
        e = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.when(_contained(x, y), F.greatest(f, F.lit(0.95))).otherwise(f)))
        return F.struct(e.alias("entailment"), F.lit(0.05).alias("contradiction"), F.greatest(F.lit(0.0), 1 - e - 0.05).alias("neutral"))

    return _with_f1(scores, a, b)


def text_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def fingerprint(model: str, texts: Column) -> Column:
    """16 hex digits for the texts of an array in order, as one model sees them."""
    return text_hash(F.array_join(F.transform(texts, lambda t: F.concat(F.lit(model + "\n"), t)), "\n"))


def cache_key(kind: str, key: Column, text: Column) -> Column:
    """16 hex digits for a text of a kind; the parts are set apart by a character that no text holds."""
    return text_hash(F.concat_ws("\0", F.lit(kind), key, text))


#: Forms of a timestamp, and of a date in running text with what it is parsed by.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMddHHmmss", "yyyyMMdd")
DATE_FORMS = (
    (r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b", ("d MMMM yyyy", "d MMM yyyy")), (r"\b[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}\b", ("MMMM d, yyyy", "MMM d, yyyy")),
    (r"\b\d{4}-\d{2}-\d{2}\b", ("yyyy-MM-dd",)), (r"\b\d{4}/\d{2}/\d{2}\b", ("yyyy/MM/dd",)),
)


def parse_time(c: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """A timestamp by the first format that fits; null if none does or the text stands for a missing one."""
    text = F.trim(c)
    return F.when((text != "") & (F.lower(text) != "nan"), F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)))


def date_in_text(c: Column, lines: int = 25, most: int = 2500) -> Column:
    """The first date in the head of a text, of the first form that has one."""
    head = F.left(F.array_join(F.slice(F.split(F.coalesce(c, F.lit("")), "\n"), 1, lines), "\n"), F.lit(most))

    def of(text: Column, pattern: str, formats: tuple[str, ...]) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        one = lambda t: F.coalesce(*(F.try_to_timestamp(F.initcap(F.regexp_replace(t, r"\s+", " ")), F.lit(f)) for f in formats))
        return F.get(F.filter(F.transform(found, one), lambda t: t.isNotNull()), F.lit(0))

    return let(lambda s: F.coalesce(*(of(s["head"], *form) for form in DATE_FORMS)), head=head)


def derived_seed(base: int, *parts: Column) -> Column:
    """Seeds by v * 33 + code point, modulo 2**32, over the parts in turn."""
    chars = F.filter(F.split(F.concat(*parts), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(base).cast("long"), lambda v, c: F.pmod(v * 33 + F.ascii(c), F.lit(1 << 32)))


def words_of(c: Column) -> Column:
    """Word-like tokens, as written."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({_WORD})"), 1)


def bare(t: Column) -> Column:
    return F.regexp_replace(t, r"^['\-_]+|['\-_]+$", "")


def _stop(t: Column) -> Column:
    return t.isin(*STOPWORDS)


def query_terms(c: Column, most: int = 24) -> Column:
    """Lowered distinct query words in order, without stop words."""
    bared = F.transform(words_of(F.lower(c)), bare)
    return F.slice(F.array_distinct(F.filter(bared, lambda t: (F.length(t) >= 2) & ~_stop(t))), 1, most)


def focus_terms(c: Column, most: int = 6) -> Column:
    """Words from the first capitalised one on, without stop words; repeats stay."""
    return let(lambda s: _focus(s["raw"], most), raw=words_of(c))


def _focus(raw: Column, most: int) -> Column:
    capital = F.array_position(F.transform(raw, lambda t: ~_stop(bare(F.lower(t))) & t.rlike("^[A-Z]")), True).cast("int")
    rest = F.when(capital > 0, F.slice(raw, F.greatest(capital, F.lit(1)), F.greatest(F.size(raw), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(rest, lambda t: bare(F.lower(t))), lambda t: (F.length(t) >= 2) & ~_stop(t)), 1, most)


def quoted(t: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def query_ladder(focus: Column, terms: Column, title: Column | None = None, title_terms: Column | None = None) -> Column:
    """Ever broader match queries: the title as a phrase, all of its first 8 terms, all of the first 6 to 3 focus terms,
    of the first 8, 6, 4, 3 terms, any of 12 terms of title and question."""
    step = lambda a, n, least, sep: F.when(F.size(a) >= least, F.array_join(F.transform(F.slice(a, 1, n), quoted), sep))
    steps = [step(focus, n, n, " AND ") for n in (6, 5, 4, 3)] + [step(terms, n, n, " AND ") for n in (8, 6, 4, 3)]
    if title is not None:
        steps = [F.when(title != "", quoted(title)), step(title_terms, 8, 1, " AND "), *steps]
    both = terms if title_terms is None else F.concat(title_terms, terms)
    return F.array_distinct(F.array_compact(F.array(*steps, step(both, 12, 1, " OR "))))


def any_query(title_terms: Column, terms: Column, most: int = 24) -> Column:
    """One broad match query: any of the distinct terms of title and question."""
    return F.array_join(F.transform(F.slice(F.array_distinct(F.concat(title_terms, terms)), 1, most), quoted), " OR ")


def _without_suffix(t: Column) -> Column:
    """Drops -ing or -ed from a word that is long enough."""
    n = F.length(t)
    ing = t.endswith("ing") & (n > 5)
    return F.when(ing, F.left(t, n - 3)).when(t.endswith("ed") & (n > 4), F.left(t, n - 2)).otherwise(t)


def _singular(t: Column) -> Column:
    """Turns -ies to y or drops -s from a word that is long enough."""
    n = F.length(t)
    return F.when(t.endswith("ies") & (n > 5), F.concat(F.left(t, n - 3), F.lit("y"))).when(t.endswith("s") & (n > 4), F.left(t, n - 1)).otherwise(t)


def stem(t: Column) -> Column:
    return _singular(_without_suffix(t))


def search_tokens(c: Column) -> Column:
    """Stemmed words; one pass a step, so that no step's expression is repeated inside the next."""
    stemmed = words_of(F.lower(c))
    for step in (bare, _without_suffix, _singular):
        stemmed = F.transform(stemmed, step)
    return F.filter(stemmed, lambda t: (F.length(t) >= 2) & ~_stop(t))


def search_rows(df, text: Column, keys: list[str], name: str = "term"):
    """``search_tokens`` of a text as one row a token, keys beside it: flat columns, one step a projection, so that all of it is compiled."""
    out = df.select(*keys, F.explode(words_of(F.lower(text))).alias(name))
    for step in (bare, _without_suffix, _singular):
        out = out.withColumn(name, step(F.col(name)))
    return out.filter((F.length(name) >= 2) & ~_stop(F.col(name)))


def numbers(c: Column) -> Column:
    """Numbers of a text without separators, signs of per cent or ordinal endings."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?<!\w)([+-]?\d[\d,]*(?:\.\d+)?(?:%|st|nd|rd|th)?)"), 1)
    return F.array_distinct(F.transform(raw, lambda t: F.replace(F.regexp_replace(F.regexp_replace(t, "%+$", ""), "(st|nd|rd|th)$", ""), F.lit(","), F.lit(""))))


def numbers_disagree(a: Column, b: Column) -> Column:
    """Each side has a number that the other lacks."""
    return let(lambda s: (F.size(F.array_except(s["x"], s["y"])) > 0) & (F.size(F.array_except(s["y"], s["x"])) > 0), x=numbers(a), y=numbers(b))


def _polarity(t: Column) -> Column:
    yes, no = (F.arrays_overlap(t, F.array(*map(F.lit, words))) for words in (YES, NO))
    return F.when(yes & ~no, "yes").when(no & ~yes, "no")


def contradicts(a: Column, b: Column) -> Column:
    """Opposite polarity, an opposite pair, or disjoint numbers in similar texts."""
    pattern = F.lit(r"\b(\d+(?:\.\d+)?)\b")

    def judge(s: Column) -> Column:
        x, y = s["x"], s["y"]
        opposed = reduce(lambda p, q: p | q, [(x.contains(u) & y.contains(v)) | (x.contains(v) & y.contains(u)) for u, v in OPPOSITES])
        m, n = F.regexp_extract_all(x, pattern, 1), F.regexp_extract_all(y, pattern, 1)
        apart = (F.size(m) > 0) & (F.size(n) > 0) & ~F.arrays_overlap(m, n)
        similar = let(lambda t: token_f1(t["p"], t["q"]), p=_split(x), q=_split(y)) >= 0.35
        return (x != "") & (y != "") & (F.coalesce(_polarity(_split(x)) != _polarity(_split(y)), F.lit(False)) | opposed | (apart & similar))

    return let(judge, x=normalize(a), y=normalize(b))


def is_missing(c: Column, patterns: tuple[str, ...] = MISSING_PATTERNS) -> Column:
    plain = [p.translate(str.maketrans("", "", "'")) for p in patterns]
    return let(lambda s: (s["x"] == "") | reduce(lambda p, q: p | q, [s["x"].contains(t) for t in plain]), x=normalize(c))


def accuracy(answer: Column, gold: Column, threshold: float = 0.75) -> Column:
    """Struct of exact, substring, F1 and correct."""

    def scores(x: Column, y: Column, f: Column) -> Column:
        exact, sub = (x == y) & (y != ""), _contained(x, y)
        return F.struct(exact.cast("int").alias("exact_match"), sub.cast("int").alias("substring_match"), f.alias("token_f1"), (exact | sub | (f >= threshold)).cast("int").alias("correct"))

    return _with_f1(scores, answer, gold)


def accuracy_of(rows, answer: str, gold: str, threshold: float = 0.75):
    """rows with all fields of the score of an answer: correct, exact_match, substring_match, token_f1 and rouge_l."""
    scored = rows.withColumn("_s", accuracy(F.col(answer), F.col(gold), threshold)).withColumn("rouge_l", rouge_l(tokens(F.col(answer)), tokens(F.col(gold))))
    return scored.select(*rows.columns, "_s.correct", "_s.exact_match", "_s.substring_match", "_s.token_f1", "rouge_l")


def quality_label(answer: Column, current: Column, stale: Column, threshold: float = 0.75) -> Column:
    """missing, ambiguous, perfect_current, perfect_stale or harmful_other."""
    match = lambda ref: lexically_equal(answer, ref, threshold)

    def label(s: Column) -> Column:
        return (
            F.when(s["missing"], "missing").when(s["c"] & s["s"] & s["differ"], "ambiguous")
            .when(s["c"], "perfect_current").when(s["s"], "perfect_stale").otherwise("harmful_other")
        )

    return let(label, missing=is_missing(answer), c=match(current), s=match(stale), differ=normalize(current) != normalize(stale))


def title_of(c: Column, most: int = 180) -> Column:
    """The first line of 8 characters or more, else the text, cut."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), squeeze), lambda s: F.length(s) >= 8)
    return F.left(F.coalesce(F.get(lines, 0), squeeze(c)), F.lit(most))


def word_chunks(c: Column, size: int = 180, shared: int = 40, least: int = 80) -> Column:
    """Windows of words as array<struct<chunk_index, chunk>>; short ones are left out and not numbered."""
    return let(lambda s: chunks_of_words(s["words"], size, shared, least), words=words_between(c))


def words_between(c: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(squeeze(c), " "), "")


def chunks_of_words(words: Column, size: int = 180, shared: int = 40, least: int = 80) -> Column:
    """``word_chunks`` of an array of words."""
    step = max(1, size - shared)
    last = F.greatest(F.ceil((F.size(words) - size) / F.lit(step)), F.lit(0)).cast("int")
    texts = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * step + 1, size), " "))
    kept = F.filter(texts, lambda t: F.length(t) >= least)
    return F.when(F.size(words) > 0, F.transform(kept, lambda t, i: F.struct(i.alias("chunk_index"), t.alias("chunk"))))


def char_chunks(c: Column, size: int = 1200, shared: int = 200) -> Column:
    """Windows of characters cut at a blank, as array<struct<chunk_index, chunk>> from 1."""
    return let(lambda s: _char_chunks(s["text"], size, shared), text=squeeze(c))


def _char_chunks(text: Column, size: int, shared: int) -> Column:
    if size <= shared:
        shared = size // 5
    step = max(1, size - shared)
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")

    def window(k: Column) -> Column:
        raw = F.substring(text, k * step + 1, F.lit(size))
        cut = F.when(F.instr(raw, " ") > 0, F.regexp_replace(raw, " [^ ]*$", "")).otherwise(raw)
        return F.trim(F.when(k * step + size < F.length(text), cut).otherwise(raw))

    kept = F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda t: t != "")
    return F.when(text != "", F.transform(kept, lambda t, i: F.struct((i + 1).alias("chunk_index"), t.alias("chunk"))))


def token_estimate(c: Column, per_token: float = 3.6, extra: int = 16) -> Column:
    return (F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(per_token)) + extra).cast("long")


#: Forms of secrets and of a user's folder that must not be published.
SECRETS = {
    "sk_key": r"\bsk-[A-Za-z0-9_-]{20,}\b", "hf_token": r"\bhf_[A-Za-z0-9]{20,}\b", "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._-]{24,}\b", "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "user_path": r"[A-Za-z]:\\Users\\[^\\\s]+",
}


def secrets(c: Column) -> Column:
    """Struct of flags: which secrets a text holds."""
    return F.struct(*(F.coalesce(c.rlike(p), F.lit(False)).alias(k) for k, p in SECRETS.items()))
