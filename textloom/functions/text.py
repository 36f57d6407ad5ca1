"""Text expressions over columns, all evaluated in the JVM.

Offsets and lengths count code points unless a name says bytes. Character classes are Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One word of the retrieval tokenizer.
WORD = r"[\p{L}\p{N}]+"
#: One token of the estimating counter: up to four letters or digits, or one sign.
TOKEN = r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]"
#: ISO time stamps and numbers as the line normaliser masks them.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end adds none, and empty text has none."""
    text = F.regexp_replace(col(c), r"\r\n", "\n")
    text = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.length(col(c)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def unlines(c: Column | str) -> Column:
    return F.array_join(col(c), "\n")


def words(c: Column | str) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def embedding_tokens(c: Column | str) -> Column:
    """Words that may hold _ and -, and the character trigrams of the text without white space."""
    low = F.lower(col(c))
    grams = F.regexp_extract_all(F.regexp_replace(low, r"(?U)\s+", ""), F.lit("(?s)(?=(...))"), F.lit(1))
    return F.concat(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), grams)


def count_tokens(c: Column | str) -> Column:
    """Estimated tokens: runs of up to four letters or digits, and signs. Deterministic, no vocabulary needed."""
    return F.regexp_count(col(c), F.lit(TOKEN))


def image_tokens(width: Column | str, height: Column | str) -> Column:
    return F.greatest(F.floor(col(width) * col(height) / 750), F.lit(85)).cast("long")


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def short_hash(c: Column | str) -> Column:
    """The first eight bytes of SHA-256 in hex."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def line_hashes(c: Column | str) -> Column:
    return F.transform(lines(c), lambda x: F.substring(F.sha2(x, 256), 1, 16))


def first_sentence(c: Column | str, most: int = 200) -> Column:
    """Text up to the first . ! or ?, trimmed and cut to ``most`` characters."""
    return F.substring(F.trim(F.element_at(F.split(col(c), r"[.!?]", 2), 1)), 1, most)


def keywords(c: Column | str, least_bytes: int = 4) -> Column:
    return F.filter(words(c), lambda w: F.octet_length(w) >= least_bytes)


def normal_line(c: Column | str) -> Column:
    """Time stamps and numbers masked, trimmed: lines that differ in those only become equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), TIMESTAMP, "<TS>"), r"\d+", "<N>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def role(c: Column | str) -> Column:
    """assistant, system, or user for anything else."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin("assistant", "system"), low).otherwise(F.lit("user"))


def ratio(compressed: Column | str, original: Column | str) -> Column:
    return F.when(col(original) == 0, F.lit(1.0)).otherwise(F.least(col(compressed) / col(original), F.lit(1.0)))


def repeats(text: Column | str, block: Column | str) -> Column:
    """Non-overlapping occurrences of a block."""
    return F.when(F.length(col(block)) > 0, ((F.length(col(text)) - F.length(F.replace(col(text), col(block), F.lit("")))) / F.length(col(block))).cast("int")).otherwise(F.lit(0))


def middle_lines(array: Column | str, most: int, message: str) -> Column:
    """Head and tail halves of too many lines, with a marker that counts what is left out between them."""
    a, half = col(array), most // 2
    marker = F.array(F.replace(F.lit(message), F.lit("{n}"), (F.size(a) - 2 * half).cast("string")))
    return F.when(F.size(a) <= most, a).otherwise(F.concat(F.slice(a, 1, half), marker, F.slice(a, F.size(a) - half + 1, F.lit(half))))


def bounded(text: Column | str, most: int, marker: str = "\n...\n") -> Column:
    """Head and tail of too long a text."""
    c, head = col(text), most // 2
    tail = most - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.expr(f"substring({text if isinstance(text, str) else 'text'}, -{tail}, {tail})") if isinstance(text, str) else F.right(c, F.lit(tail))))


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


def topics(c: Column | str, table: dict[str, list[str]], otherwise: str = "general") -> Column:
    """Sorted topics whose keywords occur anywhere in the lower-cased text."""
    low = F.lower(col(c))
    found = F.array_sort(F.array_compact(F.array(*(F.when(contains_any(low, k), F.lit(t)) for t, k in table.items()))))
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found)


def section_name(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")


def dependencies(c: Column | str) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(r"(?im)^depends_on:\s*(.+)$"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), section_name), lambda x: x != "")


def complexity(c: Column | str) -> Column:
    """simple, medium or complex by token and sign counts and cues of several steps."""
    tokens, signs = count_tokens(c), F.regexp_count(col(c), F.lit(r"[,;:?!]"))
    steps = contains_any(F.lower(col(c)), [" then ", "after that", "step by step", "compare", "tradeoff", "architecture"])
    return F.when((tokens > 80) | (signs >= 4) | steps, "complex").when((tokens <= 20) & (signs <= 1), "simple").otherwise("medium")


def _names(found: Column, stop: list[str], loud: bool) -> Column:
    """Lower-cased words that begin with a capital and are three bytes or more, without stop words; without ``loud``
    none of capitals only beyond four bytes."""
    low = [w.lower() for w in stop]

    def stays(w: Column) -> Column:
        ok = (F.octet_length(w) >= 3) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(low)
        return ok if loud else ok & ~(w.rlike(r"^\p{Lu}+$") & (F.octet_length(w) > 4))

    return F.array_distinct(F.transform(F.filter(found, stays), F.lower))


def entities(c: Column | str, stop: list[str], most: int | None = 40) -> Column:
    """Names among the words of a text, cut at all signs."""
    found = _names(F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0)), stop, loud=False)
    return found if most is None else F.slice(found, 1, most)


def spaced_entities(c: Column | str, stop: list[str], most: int | None = 5) -> Column:
    """Names among the words of a text as white space parts them, without signs around them."""
    spaced = F.transform(F.split(col(c), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    found = _names(spaced, stop, loud=True)
    return found if most is None else F.slice(found, 1, most)


def entity_id(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(col(c))), r"[^\p{L}\p{N}\s_-]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def predicate(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(col(c))), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(kept, r"(?U)[\s-]+", "_")


def fact_id(subject: Column | str, pred: Column | str, kind: Column | str, value: Column | str) -> Column:
    return short_hash(F.concat_ws("|", col(subject), col(pred), F.concat_ws(":", col(kind), F.lower(F.trim(col(value))))))


def relative_dates(c: Column | str, ts: Column | str) -> Column:
    """Each relative date word followed by the date it means, seen from ``ts``."""
    day = F.to_date(col(ts))
    friday = F.when(F.dayofweek(day) == 6, day).otherwise(F.date_sub(F.next_day(day, "FRI"), 7))
    iso, month = lambda d: F.date_format(d, "yyyy-MM-dd"), lambda d: F.date_format(d, "MMMM yyyy")
    week = lambda d: F.concat(F.lit("week of "), iso(d))
    # The phrases, in the order in which they are looked for, and the form of each date.
    table = [
        ("yesterday", iso(F.date_sub(day, 1))), ("last week", week(F.date_sub(day, 7))), ("last month", month(F.date_sub(day, 30))), ("last year", (F.year(day) - 1).cast("string")),
        ("this week", week(day)), ("this month", month(day)), ("today", iso(day)), ("tomorrow", iso(F.date_add(day, 1))), ("last Friday", iso(friday)), ("recently", F.concat(F.lit("around "), F.date_format(day, "yyyy-MM"))),
    ]
    out = col(c)
    for phrase, value in table:
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{phrase}\b"), F.concat(F.lit(f"{phrase} ["), value, F.lit("]")))
    return out


def parsed_score(c: Column | str) -> Column:
    """The first number of a reply, out of ten, between 0 and 1."""
    return F.least(F.greatest(F.expr("try_cast(" + f"regexp_extract({c}, '[0-9]+([.][0-9]+)?', 0)" + " as double)") / 10, F.lit(0.0)), F.lit(1.0))


def keyword_overlap(query: Column | str, c: Column | str) -> Column:
    """Share of the query's distinct words that occur anywhere in the text."""
    q, low = F.array_distinct(words(query)), F.lower(col(c))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.filter(q, lambda w: F.contains(low, w))) / F.size(q))
