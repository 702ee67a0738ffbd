"""Native column functions on text, arrays and scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits in any script.
TOKEN = r"[\p{L}\p{N}]+"
#: Characters that a cleaned query keeps (fixed value).
KEPT = r"[^a-zA-Z0-9 \-.,?/()§]"


def tokens(c: Column) -> Column:
    """Lower-case words, in order. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_blank(c: Column) -> Column:
    """Null, empty, or the placeholder "unknown": all count as missing."""
    return c.isNull() | F.trim(F.lower(c)).isin("", "unknown")


def compact(c: Column) -> Column:
    """Only a-z and 0-9, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def filter_words(c: Column, stop: Iterable[str] = ()) -> Column:
    """Words of a filter field: dots dropped, split at other signs, stop words out."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\.", ""), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def clean_query(c: Column) -> Column:
    """White space to single blanks, unusual signs out, lower case."""
    one = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), KEPT, "")
    return F.trim(F.lower(F.regexp_replace(one, " +", " ")))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a blank, repeats kept; none where there are fewer words.

    The array is zipped with itself, shifted: nothing that reads the whole array stands inside a lambda,
    where it would be evaluated for every element.
    """
    out = words
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(words, shift + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(out, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def grounded(span: Column, source: Column, share: float = 0.85) -> Column:
    """Whether a span stands in the source word for word, or at least ``share`` of its trigrams do."""
    grams = ngrams(span, 3)
    held = F.size(F.filter(grams, lambda g: F.array_contains(ngrams(source, 3), g)))
    whole = F.instr(F.concat(F.lit(" "), F.array_join(source, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(span, " "), F.lit(" "))) > 0
    return whole | ((F.size(grams) > 0) & (held >= share * F.size(grams)))


def slugify(c: Column, most: int = 50) -> Column:
    """Lower case, blanks to hyphens, other signs out, at most so many characters, no hyphen at an end."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most), "-+$", "")


def title_of(c: Column, most: int = 60) -> Column:
    """A text's first characters, cut at a word's end with an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.substring(one, 1, most)
    head = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(head, F.lit("…")))


def canonical_key(kind: Column, number: Column, year: Column, registry: Column | None = None) -> Column:
    """TYPE-NUMBER[-REGISTRY]-YEAR; missing parts leave no hyphen."""
    parts = [F.upper(kind), number.cast("long").cast("string")] + ([F.upper(registry)] if registry is not None else []) + [year.cast("string")]
    return F.concat_ws("-", *parts)


def hash_split(key: Column, salt: str, test_percent: int = 40) -> Column:
    """"test" or "dev" by the first 32 bits of a SHA-256."""
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key), 256), 1, 8), 16, 10).cast("long")
    return F.when(number % 100 < test_percent, "test").otherwise("dev")


def script(c: Column) -> Column:
    """The script that a text is in: arabic, accented latin or plain."""
    return F.when(c.rlike(r"[\x{0600}-\x{06FF}]"), "arabic").when(c.rlike(r"[\x{00C0}-\x{024F}]"), "accented").otherwise("plain")


def sigmoid(x: Column) -> Column:
    """The logistic function, safe for large values of either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def card_date(c: Column) -> Column:
    """d.M.yyyy (also with - or /) or yyyy-MM-dd as a date; null for anything else or impossible."""
    own = F.trim(c)
    day_first = F.regexp_replace(own, "[-/]", ".")
    return F.when(own.rlike(r"^\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}$"), F.try_to_date(day_first, "d.M.yyyy")).when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(own, "yyyy-MM-dd"))


def last_year(c: Column) -> Column:
    """The last 4-digit year (1900 to 2099) of a text, or null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?:19|20)[0-9]{2}"), F.lit(0)), F.lit(-1)).cast("int")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as norm one."""
    norm = lambda v: F.sqrt(dot(v, v))
    safe = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share; (0, 0) without trials."""
    n, p = total.cast("double"), successes.cast("double") / total
    middle, spread, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (F.when(n > 0, (middle - spread) / base).otherwise(0.0), F.when(n > 0, (middle + spread) / base).otherwise(0.0))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at bround(p (n - 1)) of the sorted values; null for none."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround(p * (F.size(ordered) - 1), 0).cast("int"))


def phrase_hits(text: Column, phrases: Iterable[str]) -> Column:
    """The distinct phrases found between non-letters, longest first, sorted."""
    longest = sorted(phrases, key=lambda p: (-len(p), p))
    pattern = r"(?:^|[^a-z])(" + "|".join(longest) + r")(?:[^a-z]|$)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))
